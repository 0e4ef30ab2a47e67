"""Results of jobs: envelopes, tables for export, look-ups, and orders of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHECK_COLUMNS = ("code", "severity", "passed", "path", "message", "expected", "actual", "difference")
CORRECTION_COLUMNS = ("field_path", "original", "corrected", "method", "reason")
AUDIT_COLUMNS = ("ts", "actor", "action", "field_path", "old", "new")


def nested_rows(records: DataFrame, key: str, column: str, wanted: tuple[str, ...]) -> DataFrame:
    """record_id, pos and the wanted fields of each struct in a column of arrays; fields that it lacks are null."""
    held = {f.name for f in records.schema[column].dataType.elementType.fields}
    rows = records.select(F.col(key).alias("record_id"), F.posexplode(column).alias("pos", "x"))
    return rows.select("record_id", "pos", *[(F.col(f"x.{c}") if c in held else F.lit(None)).cast("string").alias(c) for c in wanted])


def check_table(records: DataFrame, key: str, column: str = "checks") -> DataFrame:
    return nested_rows(records, key, column, CHECK_COLUMNS)


def correction_table(records: DataFrame, key: str, column: str = "corrections") -> DataFrame:
    return nested_rows(records, key, column, CORRECTION_COLUMNS)


def audit_table(records: DataFrame, key: str, column: str = "history") -> DataFrame:
    return nested_rows(records, key, column, AUDIT_COLUMNS)


def envelopes(records: DataFrame, by: list[str], order: str, exported_at: str) -> DataFrame:
    """by and json: one envelope for each group, its records as documents[] in order.

    A group is one upload's records (a few); for a whole table use export.documents(), a document a row.
    """
    rest = [c for c in records.columns if c not in by]
    docs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*rest).alias("d")))), lambda x: x["d"])
    g = records.groupBy(*by).agg(docs.alias("documents"))
    return g.select(*by, F.to_json(F.struct(F.lit("1.0").alias("export_version"), F.lit(exported_at).alias("exported_at"), "documents")).alias("json"))


def job_results(jobs: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """key, n_documents and result: the stored result of each job, with its records in order; a job without records has none."""
    rest = [c for c in records.columns if c != key]
    docs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*rest).alias("d")))), lambda x: x["d"])
    met = jobs.join(records.groupBy(key).agg(docs.alias("documents"), F.count("*").alias("n")), key, "left")
    return met.select(key, F.coalesce("n", F.lit(0)).alias("n_documents"), F.to_json(F.struct(F.col(key).alias("job_id"), F.col("status"), F.coalesce("documents", F.from_json(F.lit("[]"), records.select(F.array(F.struct(*rest)).alias("d")).schema["d"].dataType)).alias("documents"))).alias("result"))


def write_results(results: DataFrame, path: str, partitions: int = 16) -> None:
    """Results as Parquet, partitioned by a hash of the job, each run in place of what it wrote for the same part before."""
    part = F.pmod(F.xxhash64(results.columns[0]), F.lit(partitions)).alias("part")
    results.select("*", part).write.mode("overwrite").partitionBy("part").parquet(path)


def ocr_artifact(pages: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """key and json: the pages of each document (page, width, height, kind) with their tokens, in order."""
    fields = [c for c in tokens.columns if c not in (key, "page")]
    own = tokens.groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct(*["token_id", *[c for c in fields if c != "token_id"]]))).alias("tokens"))
    rest = [c for c in pages.columns if c != key]
    met = pages.join(own, [key, "page"], "left")
    return met.groupBy(key).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("page", *[c for c in rest if c != "page"], "tokens"))).alias("pages"))).alias("json"))


def artifacts(files: DataFrame, key: str, path: str) -> DataFrame:
    """key and names: the distinct base names of a job's files, in order."""
    return files.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list(F.regexp_extract(path, "([^/]*)$", 1)))).alias("names"))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key."""
    return rows.where(F.col(key) == F.lit(value))


def document_at(documents: Column, index: Column) -> Column:
    """The document at an index from 0; null beyond the end or below 0."""
    return F.when(index >= 0, F.get(documents, index))


def segment_pages(segments: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The pages (key, page, ...) of each segment (key, segment, first_page, last_page)."""
    span = segments.withColumn("page", F.explode(F.sequence("first_page", "last_page"))).select(key, "segment", "page")
    return span.join(pages, [key, "page"])


def queue(jobs: DataFrame) -> DataFrame:
    """Queued jobs, first come first."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id")


def places(rows: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """Adds place (from 1) over the whole table in an order whose columns tell rows apart.

    The rows are sorted by ranges; counts of the ranges give each its first place, so no task sees them all.
    """
    part = F.spark_partition_id()
    held = rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumns({"_part": part, "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return held.join(F.broadcast(before), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def events_of(events: DataFrame, job: str, value) -> DataFrame:
    """A job's events in the order in which they were written."""
    return by_key(events, job, value).orderBy("id")


def line_order(line_no: Column) -> Column:
    """What a user's list of lines is sorted by: the number of the line, 0 if it has none."""
    return F.coalesce(F.regexp_extract(F.trim(line_no), r"^(-?\d+)(?:\.0*)?$", 1).try_cast("int"), F.lit(0))


def checks_by_severity(checks: DataFrame, key: str) -> DataFrame:
    """key, severity, n and codes (in order) of the checks of a record."""
    return checks.groupBy(key, "severity").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("code")).alias("codes"))


def inserted(jobs: DataFrame, events: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, events) with new jobs: queued, at progress 0 and attempt 0, each with an event that says so."""
    states = {"status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(0.0), "attempt": F.lit(0)}
    rows = new.withColumns(states)
    said = rows.select(F.col("id").alias("job_id"), F.col("created_at").alias("ts"), F.lit("queued").alias("stage"), F.lit("info").alias("level"), F.lit("Job queued").alias("message"))
    return jobs.unionByName(rows, allowMissingColumns=True), events.unionByName(said, allowMissingColumns=True)


def scores(predictions: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    """by, n, accuracy, precision, recall and f1 of two columns of truth values (0 where nothing is to divide)."""
    count = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    g = predictions.groupBy(*by).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    g = g.withColumns({"n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    both = F.col("precision") + F.col("recall")
    return g.select(*by, "n", ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"))
