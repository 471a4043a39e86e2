"""Structured Streaming forms of ingestion, rate limiting and conversation windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslane.operators.table import ingest
from corpuslane.session import exists


def start_ingest(files: DataFrame, table: str, checkpoint: str, name: str = "filename", text: str = "text", once: bool = True) -> StreamingQuery:
    """Appends the chunks of new contents of a stream of files (filename, text) to a Parquet table.

    Each micro-batch is held against what the table has; a batch that runs again adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        held = spark.read.parquet(table).select("content_id") if exists(spark, table) else None
        ingest(batch, held, name, text).write.mode("append").parquet(table)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rate_limited_stream(requests: DataFrame, most: int, seconds: int, client: str = "user_id", at: str = "ts", key: str = "event_id", expire: bool = False) -> DataFrame:
    """(key, client, at, allowed): the sliding log of the batch form, with the allowed times of a client as state.

    The state holds at most `most` times; with expire it goes when its client has been silent for `seconds` of
    processing time, for streams that run on (a trigger that ends, as availableNow, would wait for timeouts forever).
    Requests of one trigger are taken in order of time; later ones than those already decided are not reordered.
    """
    t = dict(requests.dtypes)

    def run(_: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["micros", key])
        allowed = []
        for now in rows["micros"]:
            log = [x for x in log if x > now - seconds * 1_000_000]
            allowed.append(len(log) < most)
            if allowed[-1]:
                log.append(int(now))
        state.update((log,))
        if expire:
            state.setTimeoutDuration(seconds * 1000)
        yield rows.assign(allowed=allowed)[[key, client, at, "allowed"]]

    keyed = requests.where(F.col(client).isNotNull() & F.col(at).isNotNull()).select(key, client, at, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    return keyed.groupBy(client).applyInPandasWithState(run, f"{key} {t[key]}, {client} {t[client]}, {at} {t[at]}, allowed boolean", "log array<bigint>", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


def history_stream(turns: DataFrame, keep: int = 20) -> DataFrame:
    """(conv_id, history): the last turns of each conversation after every trigger, as an array of role and text."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in state.get[0]] if state.exists else []
        rows = pd.concat(list(batches))
        held = sorted([*held, *zip(rows["turn"].astype(int).tolist(), rows["role"], rows["text"])])[-keep:]
        state.update((held,))
        yield pd.DataFrame({"conv_id": [k[0]], "turns": [len(held)], "history": [[f"{r}: {t}" for _, r, t in held]]})

    kind = dict(turns.dtypes)["conv_id"]
    return turns.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandasWithState(run, f"conv_id {kind}, turns int, history array<string>", "held array<struct<turn:bigint,role:string,text:string>>", "update", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", at: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n): requests per window and kind; events later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
