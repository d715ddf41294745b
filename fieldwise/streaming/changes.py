"""Change detection, intake, harvest and audit chains as streams.

What a stream has to remember stands in Spark's keyed state (RocksDB), a value or a map for each source, question or chain. A batch reads and writes the state of its own keys alone, nothing of earlier batches;
outputs are files that Spark commits once for each batch, so a stream that is started again goes on where it stopped and repeats nothing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from fieldwise.operators.changes import GENESIS, block_sha256

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Rows of a stream through a processor with a state for each key. The session's state store becomes RocksDB, which such processors need."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")


def files(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastHash(StatefulProcessor):
    """The last snapshot of a source."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, event_id long, content_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).drop_duplicates(["ts", "event_id"]).sort_values(["ts", "event_id"])
        at = self.last.get() if self.last.exists() else None
        at = at and (pd.Timestamp(at[0]), at[1], at[2])
        out = []
        for ts, event_id, own in zip(got["ts"], got["event_id"], got["content_hash"], strict=True):
            if at is None or (ts, event_id) > at[:2]:
                out.append((key[0], event_id, "NEW" if at is None else "UNCHANGED" if at[2] == own else "UPDATED"))
                at = (ts, event_id, own)
            elif (ts, event_id) < at[:2]:
                out.append((key[0], event_id, "LATE"))
        self.last.update((at[0].to_pydatetime(), int(at[1]), at[2]))
        yield pd.DataFrame(out, columns=["source_id", "event_id", "status"])

    def close(self) -> None:
        pass


def watch_changes(snapshots: DataFrame, sink_path: str, checkpoint: str) -> StreamingQuery:
    """Write NEW, UNCHANGED and UPDATED events of a stream (source_id, event_id, ts, content_hash), by order of ts and event_id.

    A snapshot older than the last one known is LATE and changes nothing; the last one, sent again, is dropped."""
    rows = snapshots.select("source_id", "event_id", "ts", "content_hash")
    return files(keyed(rows, "source_id", LastHash(), "source_id string, event_id long, status string"), sink_path, checkpoint)


def once_within(chunks: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Rows whose key wasn't seen within the delay; the state is bounded by it."""
    return chunks.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def once_ever(chunks: DataFrame, key: str, store_path: str, checkpoint: str) -> StreamingQuery:
    """Add the rows of a stream whose key was never seen, exactly: keys of any age stay in the keyed state."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return files(chunks.dropDuplicates([key]), store_path, checkpoint)


class KnownAnswers(StatefulProcessor):
    """The answers of a question."""

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "h string", "version long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        question, q = key[0], hashlib.sha256(key[0].encode()).hexdigest()
        hashes = sorted({hashlib.sha256(f"{question}\n{a}".encode()).hexdigest() for got in rows for a in got["answer"]})
        before = n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for h in hashes:
            if not self.known.containsKey((h,)):
                n += 1
                self.known.updateValue((h,), (n,))
                out.append((q, h, "SUPERSEDES" if before else "NEW", n, "PENDING"))
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["q", "h", "status", "version", "moderation"])

    def close(self) -> None:
        pass


def watch_harvest(answers: DataFrame, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Harvest a stream of (question, answer): pairs that are known are skipped; all others wait in the moderation queue, NEW or, where the question had answers before this batch, SUPERSEDES, with the next version."""
    rows = answers.select("question", "answer").where("question is not null and answer is not null")
    return files(keyed(rows, "question", KnownAnswers(), "q string, h string, status string, version long, moderation string"), queue_path, checkpoint)


class Tip(StatefulProcessor):
    """The last block of a chain."""

    def init(self, handle) -> None:
        self.tip = handle.getValueState("tip", "block_index long, block_sha256 string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        index, before = self.tip.get() if self.tip.exists() else (-1, GENESIS)
        got, out = pd.concat(list(rows)).sort_values("event_id", kind="stable"), []
        for event_id, payload in zip(got["event_id"], got["payload"], strict=True):
            index, last = index + 1, before
            before = block_sha256(key[0], index, event_id, payload, last)
            out.append((key[0], index, event_id, payload, last, before))
        self.tip.update((index, before))
        yield pd.DataFrame(out, columns=["chain", "block_index", "event_id", "payload", "previous_sha256", "block_sha256"])

    def close(self) -> None:
        pass


def append_audit(events: DataFrame, chain_path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events (chain, event_id, payload) to hash chains, each micro-batch by event_id, from where its chains stand."""
    rows = events.select("chain", "event_id", "payload")
    return files(keyed(rows, "chain", Tip(), "chain string, block_index long, event_id long, payload string, previous_sha256 string, block_sha256 string"), chain_path, checkpoint)
