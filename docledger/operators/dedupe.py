"""Duplicate documents over a table of keys: job_id, doc_index, sha256, supplier_gstin, invoice_no_norm, invoice_date, total_amount, supplier_name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions import similarity

LEVEL = {"exact_file": 1, "business_key": 2, "near": 3}


def _pair(a: DataFrame, b: DataFrame, on: list[str], extra: Column | None = None) -> DataFrame:
    """Joins two sides (columns a_*, b_*) of different jobs on equal keys; null keys never meet."""
    cond = F.col("a_job_id") != F.col("b_job_id")
    for k in on:
        cond = cond & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return a.join(b, cond if extra is None else cond & extra)


def sides(keys: DataFrame, against: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    other = keys if against is None else against
    return keys.select([F.col(c).alias(f"a_{c}") for c in keys.columns]), other.select([F.col(c).alias(f"b_{c}") for c in other.columns])


def _once(df: DataFrame) -> DataFrame:
    """The rows of a table, computed once for all the joins that read them; Spark drops them when the table is no longer used."""
    return df.localCheckpoint(eager=False)


def candidates(keys: DataFrame, jobs: DataFrame, exclude_job: str | None = None) -> DataFrame:
    """Keys of completed jobs."""
    done = jobs.where("status = 'completed'").select(F.col("id").alias("job_id"))
    out = keys.join(done, "job_id")
    return out if exclude_job is None else out.where(F.col("job_id") != exclude_job)


OUT = ["a_job_id", "a_doc_index", "b_job_id", "b_doc_index"]


def exact_file(keys: DataFrame, against: DataFrame | None = None) -> DataFrame:
    a, b = sides(keys, against)
    return _pair(a, b, ["sha256"]).select(*OUT, F.lit("exact_file").alias("kind"), F.lit(1.0).alias("score"), F.lit("sha256").alias("reason"))


def _same(name: str) -> Column:
    return F.coalesce(F.col(f"a_{name}") == F.col(f"b_{name}"), F.lit(False))


def business_key(keys: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """Same supplier and number, and the same date or total; the date is the reason if both are."""
    a, b = sides(keys, against)
    reason = F.when(_same("invoice_date"), "invoice_date").otherwise("total_amount")
    return _pair(a, b, ["supplier_gstin", "invoice_no_norm"], _same("invoice_date") | _same("total_amount")).select(*OUT, F.lit("business_key").alias("kind"), F.lit(0.95).alias("score"), reason.alias("reason"))


DAYS = 3


def near(keys: DataFrame, least: float = 85.0, against: DataFrame | None = None) -> DataFrame:
    """Same supplier, dates within three days, totals within a cent, and numbers alike.

    Dates fall into buckets of four days and meet in their own and both neighbouring ones, so that a large supplier does not
    become one group; the built-in bounds prune before the similarity is measured in Arrow batches.
    """
    a, b = sides(keys, against)
    width = DAYS + 1
    a = a.withColumn("bucket", F.floor(F.datediff("a_invoice_date", F.lit("1970-01-01")) / width)).withColumn("cents", F.col("a_total_amount") * 100)
    b = b.withColumn("own", F.floor(F.datediff("b_invoice_date", F.lit("1970-01-01")) / width)).withColumn("b_bucket", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    close = (F.abs(F.datediff("a_invoice_date", "b_invoice_date")) <= DAYS) & (F.abs(F.col("a_total_amount") - F.col("b_total_amount")) <= F.lit("0.01").cast("decimal(18,2)"))
    x, y = F.col("a_invoice_no_norm"), F.col("b_invoice_no_norm")
    met = _pair(a, b, ["supplier_gstin"], (F.col("bucket") == F.col("b_bucket")) & close & similarity.can_reach(x, y, least))
    met = met.withColumn("ratio", similarity.ratio(x, y)).where(F.col("ratio") >= least)
    return met.select(*OUT, F.lit("near").alias("kind"), F.greatest(F.lit(0.60), F.least(F.lit(0.90), F.col("ratio") / 100)).alias("score"), F.lit("invoice_no").alias("reason"))


#: So many documents of one total and band of lengths meet without a look at their names first.
CROWD = 100


def near_without_supplier(keys: DataFrame, number: float = 85.0, name: float = 90.0, against: DataFrame | None = None) -> DataFrame:
    """Documents without a tax number, by number and name alike and totals close or missing.

    Documents meet by their totals (the same or the next cent) and by bands of their numbers' lengths, which mostly leaves few
    to compare. Where more than CROWD have one total and band, or none, they must also have names that are alike: there distinct
    names meet first (similar_names), and alike names bring their documents.
    """
    bare = "coalesce(supplier_gstin, '') = '' and invoice_no_norm <> '' and supplier_name <> ''"
    held = ["job_id", "doc_index", "invoice_no_norm", "total_amount", "supplier_name"]
    keys = _once(keys.where(bare).select(*held))
    other = keys if against is None else _once(against.where(bare).select(*held))
    a, b = sides(keys, other)
    without = lambda df: bool(df.agg(F.bool_or(F.col("total_amount").isNull())).head()[0])
    open_a = without(keys)
    open_b = open_a if against is None else without(other)
    money = F.col("a_total_amount").isNull() | F.col("b_total_amount").isNull() | (F.abs(F.col("a_total_amount") - F.col("b_total_amount")) <= F.lit("0.01").cast("decimal(18,2)"))
    x, y = F.col("a_invoice_no_norm"), F.col("b_invoice_no_norm")
    # Numbers within the bound differ little in length, so bands of lengths join.
    band = 4
    a = a.withColumn("band", F.floor(F.length(x) / band))
    reach = lambda n, sign: F.floor((n + sign * F.ceil(n * (100 - number) * 2 / number)) / band)
    b = b.withColumn("band", F.explode(F.sequence(F.greatest(reach(F.length(y), -1), F.lit(0)), reach(F.length(y), 1))))
    # Where both totals are there they lie in the same or the next cent: that joins too. Those without a total meet all, those with
    # one meet them in a place of their own, so that one join does for all.
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    every, unknown = F.lit(-(2**62)).cast("long"), F.lit(-(2**62) - 1).cast("long")
    known = F.array(cents("a_total_amount"), *([unknown] if open_b else []))
    a = a.withColumn("cents", F.explode(F.when(F.col("a_total_amount").isNull(), F.array(every)).otherwise(known)))
    c = cents("b_total_amount")
    b = b.withColumn("cents", F.explode(F.when(F.col("b_total_amount").isNull(), F.array(unknown, every)).otherwise(F.array(c - 1, c, c + 1, *([every] if open_a else [])))))
    place = ["band", "cents"]
    crowds = _once(a.groupBy(*place).count().where(F.col("count") > CROWD).select(*place, F.lit(True).alias("crowded")))
    a, b = (df.join(crowds, place, "left").withColumn("crowded", F.coalesce("crowded", F.lit(False))) for df in (a, b))
    called = lambda df, side: df.where("crowded").select(F.col(f"{side}_supplier_name").alias("name")).distinct()
    alike = similar_names(called(a, "a"), called(b, "b"), name).groupBy("a_name").agg(F.collect_list("b_name").alias("names"))
    # Of other documents no name is looked up: their own keys spread them over the tasks.
    a = a.withColumn("a_name", F.when(F.col("crowded"), F.col("a_supplier_name")).otherwise(F.col("a_job_id"))).join(alike, "a_name", "left")
    a = a.withColumn("name", F.explode(F.when(F.col("crowded"), F.col("names")).otherwise(F.array(F.lit("")))))
    b = b.withColumn("name", F.when(F.col("crowded"), F.col("b_supplier_name")).otherwise(F.lit("")))
    a, b = a.select(*[c for c in a.columns if c.startswith("a_") and c != "a_name"], *place, "name"), b.drop("crowded")
    m, n = F.col("a_supplier_name"), F.col("b_supplier_name")
    met = a.join(b, [*place, "name"]).where((F.col("a_job_id") != F.col("b_job_id")) & money & similarity.can_reach(x, y, number) & similarity.can_reach(m, n, name))
    met = met.withColumns({"r1": similarity.ratio(x, y), "r2": similarity.ratio(m, n)}).where((F.col("r1") >= number) & (F.col("r2") >= name))
    return met.select(*OUT, F.lit("near").alias("kind"), F.greatest(F.lit(0.60), F.least(F.lit(0.90), (F.col("r1") + F.col("r2")) / 200)).alias("score"), F.lit("supplier_name").alias("reason")).dropDuplicates(OUT)


def similar_names(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a_name, b_name and r2: distinct names (column name) of both sides that are alike to `least`.

    Of a name of length n, cut into one piece more than edits are possible, one piece stands unharmed in any name alike to it,
    moved by as many places as there are edits at most.
    """
    t = least / 100
    room = F.floor(F.length("name") * (1 - t) * 2 / t + similarity.TINY).cast("int")
    n = F.length("name")
    cut = lambda i, k: F.floor(n * i / k).cast("int")
    piece = lambda i, k: F.struct(cut(i, k).alias("at"), F.substr(F.col("name"), cut(i, k) + 1, cut(i + 1, k) - cut(i, k)).alias("text"))
    x = a.withColumn("k", room + 1).withColumn("p", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: piece(i, F.col("k"))))).select(F.col("name").alias("a_name"), F.col("p.at").alias("at"), F.col("p.text").alias("text"), n.alias("n")).where("text <> ''")
    sizes = x.select(F.length("text").alias("size")).distinct()
    widths = F.broadcast(sizes.agg(F.collect_set("size").alias("sizes")))
    y = b.withColumn("n2", n).withColumn("one", F.lit(1)).join(widths.withColumn("one", F.lit(1)), "one")
    y = y.withColumn("size", F.explode("sizes")).where(F.col("size") <= F.col("n2")).withColumn("at2", F.explode(F.sequence(F.lit(0), F.col("n2") - F.col("size"))))
    y = y.select(F.col("name").alias("b_name"), "at2", "n2", F.substr(F.col("name"), F.col("at2") + 1, F.col("size")).alias("text"))
    most = F.floor((F.col("n") + F.col("n2")) * (1 - t) + similarity.TINY)
    met = x.join(y, "text").where((F.abs(F.col("at") - F.col("at2")) <= most) & (F.abs(F.col("n") - F.col("n2")) <= most)).select("a_name", "b_name").distinct()
    # Pairs are small and costly to compare: by their size alone they would end in one task.
    met = met.repartition(met.sparkSession.sparkContext.defaultParallelism).where(similarity.can_reach(F.col("a_name"), F.col("b_name"), least)).withColumn("r2", similarity.ratio(F.col("a_name"), F.col("b_name")))
    return met.where(F.col("r2") >= least)


def matches(keys: DataFrame, against: DataFrame | None = None) -> DataFrame:
    """The first kind that holds of each pair: exact file, business key, near; an empty tax number is a missing one. against: the other side, if not keys."""
    missing = F.nullif("supplier_gstin", F.lit(""))
    keys = keys.withColumn("supplier_gstin", missing)
    against = keys if against is None else against.withColumn("supplier_gstin", missing)
    keys, against = _once(keys), _once(against) if against is not keys else None
    rest = business_key(keys, against).unionByName(near(keys, against=against)).unionByName(near_without_supplier(keys, against=against))
    rest = rest.groupBy(*OUT).agg(F.min_by(F.struct("kind", "score", "reason"), F.when(F.col("kind") == "business_key", 2).otherwise(3)).alias("m"))
    # Pairs of one file go out as they come: there are as many as the squares of its copies, and no other kind can be before them.
    files = lambda df, side: df.groupBy(F.col("job_id").alias(f"{side}_job_id"), F.col("doc_index").alias(f"{side}_doc_index")).agg(F.collect_set("sha256").alias(f"{side}_files"))
    other = keys if against is None else against
    rest = rest.join(files(keys, "a"), ["a_job_id", "a_doc_index"]).join(files(other, "b"), ["b_job_id", "b_doc_index"]).where(~F.arrays_overlap("a_files", "b_files"))
    slim = lambda df: df.select("job_id", "doc_index", "sha256").distinct()
    return exact_file(slim(keys), slim(other)).select(*OUT, "kind", "score", "reason").union(rest.select(*OUT, "m.kind", "m.score", "m.reason"))


def with_batch(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Candidates of both: those kept before, and those of the same batch; of one document (job and index) the kept one counts."""
    x = old.withColumn("_from", F.lit(0)).unionByName(batch.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in x.columns if c not in ("job_id", "doc_index", "_from")]
    return x.groupBy("job_id", "doc_index").agg(F.min_by(F.struct(*rest), "_from").alias("r")).select("job_id", "doc_index", "r.*")


def within_batch(keys: DataFrame, batch: str) -> DataFrame:
    """Business-key matches of a document with an earlier one (seq) of its batch: same supplier and number, and same date or total."""
    a, b = keys.select([F.col(c).alias(f"a_{c}") for c in keys.columns]), keys.select([F.col(c).alias(f"b_{c}") for c in keys.columns])
    cond = (F.col(f"a_{batch}") == F.col(f"b_{batch}")) & (F.col("a_seq") > F.col("b_seq")) & (F.col("a_supplier_gstin") == F.col("b_supplier_gstin")) & (F.col("a_invoice_no_norm") == F.col("b_invoice_no_norm"))
    return a.join(b, cond & (_same("invoice_date") | _same("total_amount"))).select(F.col(f"a_{batch}").alias(batch), "a_seq", "b_seq")


def classes(keys: DataFrame, on: list[str]) -> DataFrame:
    """job_id, doc_index, first_job, first_index and members: each document of a class of two or more that agree in `on`, and the
    class's first document (least job and index). A file that came m times gives m rows, not all its pairs. Null keys are no class.
    """
    full = keys.where(" and ".join(f"{c} is not null" for c in on))
    g = full.groupBy(*on).agg(F.min(F.struct("job_id", "doc_index")).alias("f"), F.count("*").alias("members")).where("members > 1")
    return full.join(g, on).select("job_id", "doc_index", F.col("f.job_id").alias("first_job"), F.col("f.doc_index").alias("first_index"), "members")


def exact_classes(keys: DataFrame) -> DataFrame:
    """Classes of documents of one file content."""
    return classes(keys, ["sha256"])


def business_classes(keys: DataFrame) -> DataFrame:
    """Classes of documents of one supplier, number and date, and of one supplier, number and total, with the key that holds them."""
    by_date = classes(keys, ["supplier_gstin", "invoice_no_norm", "invoice_date"]).withColumn("reason", F.lit("invoice_date"))
    return by_date.union(classes(keys, ["supplier_gstin", "invoice_no_norm", "total_amount"]).withColumn("reason", F.lit("total_amount")))
