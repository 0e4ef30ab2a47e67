"""Intake, deduplication and limits over streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import dedupe, jobs
from docledger.sources import files


def intake(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """New files of a folder, with hash and kind, at most `per_trigger` in a batch."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(folder)
    return stream.select("path", F.col("modificationTime").alias("ts"), "length", F.sha2("content", 256).alias("sha256"), files.magic(F.col("content")).alias("kind"), "content")


def idempotent(stream: DataFrame, keys: list[str], ts: str = "ts", hours: int = 24) -> DataFrame:
    """The first of each content and options within a day; state older than that is dropped."""
    return stream.withWatermark(ts, f"{hours} hours").dropDuplicatesWithinWatermark(keys)


def states(stream: DataFrame, key: str, seq: str, state: str) -> DataFrame:
    """The present state of each job, updated by each batch."""
    return stream.groupBy(key).agg(F.max_by(state, seq).alias("state"), F.count("*").alias("n_events"))


def rate_limit(stream: DataFrame, client: str, client_type: str, seq: str, ts: str = "ts", most: int = 60, seconds: int = 60, forget: bool = True) -> DataFrame:
    """Whether each write is turned away; the accepted times of the last seconds are a client's state.

    forget: the state goes when a client is idle. Such a stream always has a batch to run, so it must not be run to an end.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["_t", seq])
        out = []
        for t, s in zip(rows["_t"], rows[seq]):
            kept = [x for x in kept if t - x < seconds]
            full = len(kept) >= most
            if not full:
                kept.append(float(t))
            out.append((key[0], s, full))
        state.update((kept,))
        if forget:
            state.setTimeoutDuration(max(1, seconds) * 1000)
        yield pd.DataFrame(out, columns=[client, seq, "limited"])

    timed = stream.select(client, seq, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"))
    return timed.groupBy(client).applyInPandasWithState(run, f"{client} {client_type}, {seq} long, limited boolean", "kept array<double>", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")


def incremental_matches(stream: DataFrame, table: str, path: str, checkpoint: str, out: str):
    """Matches of new documents with all before them and with each other (once: a_job_id is the greater), then the new ones join the table of keys.

    Each batch reads the keys so far, writes its matches and its keys under its own batch number, so that a batch that runs
    again replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = df.cache()
        new.write.mode("overwrite").parquet(f"{path}/{table}/batch={number:09d}")
        old = spark.read.parquet(f"{path}/{table}").where(F.col("batch") < number).drop("batch")
        before = dedupe.matches(new, old)
        beside = dedupe.matches(new).where("a_job_id > b_job_id")
        found = before.unionByName(beside).select("a_job_id", "b_job_id").distinct()
        found.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")
        new.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def breaker(stream: DataFrame, client: str, client_type: str, seq: str, ok: str, ts: str = "ts", most: int = 5, seconds: int = 60, closed_for: int = 60) -> DataFrame:
    """client, seq, open (the call is turned away) and trips: as jobs.breaker(), with the failures that count as each client's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        failures, until = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(list(batches)).sort_values(["_t", seq])
        out, failures, until = jobs.fold_breaker(rows[["_t", seq, "_ok"]].itertuples(index=False), failures, until, most, seconds, closed_for)
        state.update((failures, until))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[client, seq, "open", "trips"])

    timed = stream.select(client, seq, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"), F.col(ok).alias("_ok"))
    return timed.groupBy(client).applyInPandasWithState(run, f"{client} {client_type}, {seq} long, open boolean, trips boolean", "failures array<double>, until double", "append", "NoTimeout")


def lifetimes(stream: DataFrame, key: str, key_type: str, ts: str, hours: float = 24.0, lateness: str = "0 seconds") -> DataFrame:
    """key and expired_at of jobs that nothing was heard of for some hours: event time decides, and their state goes."""

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame([(keys[0], pd.Timestamp(last + int(hours * 3_600_000), unit="ms"))], columns=[key, "expired_at"])
            return
        seen = max(int(pd.to_datetime(b[ts]).max().value // 1_000_000) for b in batches)
        last = max(seen, state.get[0]) if state.exists else seen
        state.update((last,))
        state.setTimeoutTimestamp(last + int(hours * 3_600_000))
        yield from ()

    return stream.withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, expired_at timestamp", "last long", "append", "EventTimeTimeout")


def deadlines(stream: DataFrame, key: str, key_type: str, ts: str, state_col: str, started: str, finished: tuple[str, ...], seconds: int = 300, lateness: str = "0 seconds") -> DataFrame:
    """key, outcome (done or timed_out) and n_events: a job's end, or what it had done when its time was up.

    The clock is event time from the job's start; what comes after its end is left out.
    """

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        names = [key, "outcome", "n_events"]
        if state.hasTimedOut:
            begun, n, over = state.get
            state.remove()
            if not over:
                yield pd.DataFrame([(keys[0], "timed_out", n)], columns=names)
            return
        begun, n, over = state.get if state.exists else (None, 0, False)
        rows = pd.concat(list(batches)).sort_values(ts)
        for t, s in zip(rows[ts], rows[state_col]):
            at = int(pd.Timestamp(t).value // 1_000_000)
            if over:
                break
            if begun is None and s == started:
                begun = at
            if begun is not None and at > begun + seconds * 1000:
                over = True
                yield pd.DataFrame([(keys[0], "timed_out", n)], columns=names)
                break
            n += 1
            if s in finished:
                over = True
                yield pd.DataFrame([(keys[0], "done", n)], columns=names)
        state.update((begun, n, over))
        if begun is not None:
            state.setTimeoutTimestamp(max(begun + seconds * 1000, state.getCurrentWatermarkMs()) + 1)

    held = stream.withWatermark(ts, lateness)
    return held.groupBy(key).applyInPandasWithState(run, f"{key} {key_type}, outcome string, n_events int", "begun long, n int, over boolean", "append", "EventTimeTimeout")


def replayable(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str):
    """Writes each batch under its number, so that a batch that runs again after a crash, or with retried jobs, replaces what it wrote.

    latest() reads the result: of a key's rows in all batches the last counts.
    """

    return stream.writeStream.foreachBatch(lambda df, number: replace_batch(df, number, path, keys, seq)).option("checkpointLocation", checkpoint)


def replace_batch(df: DataFrame, number: int, path: str, keys: list[str], seq: str) -> None:
    """The last row of each key of a batch, in place of what the batch of that number wrote before."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")
    last.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")


def latest(spark: SparkSession, path: str, keys: list[str], seq: str) -> DataFrame:
    """What replayable() wrote: the last row of each key."""
    rows = spark.read.parquet(path).drop("batch")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")
