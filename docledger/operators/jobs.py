"""Job state as tables: upserts, folds of events, recovery, expiry, limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key over both tables; columns that one lacks are null there."""
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r"))
    return last.select(*keys, "r.*")


def fold(events: DataFrame, key: str, seq: str, state: str, ts: str, started: str, finished: tuple[str, ...]) -> DataFrame:
    """The present state of each job, when it first started and first finished, and its events."""
    return events.groupBy(key).agg(
        F.max_by(state, seq).alias("state"),
        F.min(F.when(F.col(state) == started, F.col(ts))).alias("started_at"),
        F.min(F.when(F.col(state).isin(*finished), F.col(ts))).alias("finished_at"),
        F.count("*").alias("n_events"),
    )


def latest(jobs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group: the first in order."""
    return jobs.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def cached(jobs: DataFrame, now: Column) -> DataFrame:
    """The newest completed job of each content and options that has not expired."""
    live = jobs.where((F.col("status") == "completed") & (F.col("expires_at") > now))
    return latest(live, ["sha256", "options_json"], [F.desc("created_at"), F.desc("id")])


def recover(jobs: DataFrame) -> DataFrame:
    """After a crash: what was in work is queued again, or failed from the second attempt on."""
    busy, worn = F.col("status") == "processing", F.col("attempt") >= 2
    return jobs.withColumns({"status": F.when(busy & worn, "failed").when(busy, "queued").otherwise(F.col("status")), "error_code": F.when(busy & worn, "RECOVERY_FAILED"), "attempt": F.when(busy & ~worn, F.col("attempt") + 1).otherwise(F.col("attempt"))})


def retry(jobs: DataFrame, keys: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs queued again without results, and the keys without theirs."""
    again = jobs.join(ids.select(F.col("id"), F.lit(True).alias("_again")), "id", "left")
    on = F.coalesce("_again", F.lit(False))
    out = again.withColumns({"status": F.when(on, "queued").otherwise(F.col("status")), "attempt": F.when(on, F.col("attempt") + 1).otherwise(F.col("attempt"))}).drop("_again")
    return out, keys.join(ids.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def without_parents(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The children whose parent is gone."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def expired(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(F.col("expires_at") <= now)


def review_fold(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of events (record, seq, action, field, new): the last edit of each field, and each record's state after the last decision."""
    edits = events.where("action = 'edit'").groupBy("record", "field").agg(F.max_by("new", "seq").alias("value")).withColumns({"status": F.lit("human_verified"), "confidence": F.lit(1.0)})
    state = F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").when(F.col("action") == "reopen", "pending")
    decided = events.withColumn("state", state).groupBy("record").agg(F.coalesce(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("seq"))), F.lit("pending")).alias("state"), F.count("*").alias("n_events"))
    return edits, decided


def stage_durations(events: DataFrame, key: str, ts: str, order: list[str]) -> DataFrame:
    """Seconds until the next event of the job."""
    return events.withColumn("seconds", F.unix_timestamp(F.lead(ts).over(W.partitionBy(key).orderBy(*order))) - F.unix_timestamp(ts))


def rate_limited(events: DataFrame, client: str, client_type: str, ts: str, seq: str, most: int = 60, seconds: int = 60) -> DataFrame:
    """Whether each write is turned away: `most` accepted ones lie in the last `seconds`. Only accepted ones count, so this folds in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[float] = []
        out = []
        for t in pdf.sort_values(["t", seq]).itertuples():
            kept = [x for x in kept if t.t - x < seconds]
            full = len(kept) >= most
            if not full:
                kept.append(t.t)
            out.append((getattr(t, client), getattr(t, seq), full))
        return pd.DataFrame(out, columns=[client, seq, "limited"])

    rows = events.select(client, seq, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(client).applyInPandas(run, f"{client} {client_type}, {seq} long, limited boolean")


def would_limit(events: DataFrame, client: str, ts: str, most: int = 60, seconds: int = 60) -> DataFrame:
    """The built-in bound from above: all attempts of the last seconds count."""
    t = F.unix_timestamp(ts)
    w = W.partitionBy(client).orderBy(t).rangeBetween(-seconds + 1, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("limited", F.col("recent") > most)


def breaker(calls: DataFrame, by: str, by_type: str, ts: str, seq: str, ok: str, most: int = 5, seconds: int = 60, closed_for: int = 60) -> DataFrame:
    """by, seq, open (this call is turned away) and trips (this call opens the breaker).

    `most` failures within `seconds` since the last success open the breaker for `closed_for` seconds; calls in that time are
    turned away and count for nothing. What counts follows from what was let through, so this folds in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold_breaker(pdf.sort_values(["t", seq])[["t", seq, "good"]].itertuples(index=False), [], None, most, seconds, closed_for)[0], columns=[seq, "open", "trips"]).assign(**{by: pdf[by].iloc[0]})[[by, seq, "open", "trips"]]

    rows = calls.select(by, seq, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), F.col(ok).alias("good"))
    return rows.groupBy(by).applyInPandas(run, f"{by} {by_type}, {seq} long, open boolean, trips boolean")


def fold_breaker(calls, failures: list[float], until: float | None, most: int, seconds: int, closed_for: int) -> tuple[list[tuple], list[float], float | None]:
    """(rows (seq, open, trips), times of the failures that count, until when it is open) after calls (time, seq, good) in order."""
    out = []
    for t, seq, good in calls:
        if until is not None and t < until:
            out.append((seq, True, False))
            continue
        until = None
        if good:
            failures = []
        else:
            failures = [x for x in failures if t - x <= seconds] + [t]
        trips = not good and len(failures) >= most
        if trips:
            until = t + closed_for
        out.append((seq, False, trips))
    return out, failures, until


def timed_out(events: DataFrame, key: str, ts: str, seq: str, started: str, finished: tuple[str, ...], state: str, seconds: int = 300) -> DataFrame:
    """key, timed_out and n_kept: whether a job was still at work `seconds` after its start, and its events up to then (its partial output)."""
    start = F.min(F.when(F.col(state) == started, F.unix_micros(F.col(ts).cast("timestamp")))).over(W.partitionBy(key))
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    x = events.withColumns({"_start": start, "_late": (t - start) > seconds * 1_000_000})
    done = F.max(F.when(F.col(state).isin(*finished) & ~F.col("_late"), True))
    g = x.groupBy(key).agg(F.max(F.coalesce("_late", F.lit(False))).alias("late"), F.coalesce(done, F.lit(False)).alias("done"), F.count_if(~F.coalesce("_late", F.lit(False))).alias("n_kept"))
    return g.select(key, (F.col("late") & ~F.col("done")).alias("timed_out"), "n_kept")
