"""Structured Streaming forms: tumbling and sliding windows, deduplication, refractory events."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import dedupe
from tidemark.sources.shared import shared_dir

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; file or folder."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def closed(stream: DataFrame, rows: DataFrame, days: int = 60) -> DataFrame:
    """``stream`` and one more event, ``days`` after the last of ``rows``: the watermark passes all windows before it, so that they are put out and their state goes."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tidemark/closing-{uuid.uuid4().hex}"
    last = rows.agg((F.max("ts").cast("timestamp") + F.make_dt_interval(F.lit(days))).alias("ts"))
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in stream.schema if f.name != "ts"}
    last.select(*[F.col("ts") if c == "ts" else nulls[c].alias(c) for c in stream.columns]).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def tumbling(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """R2: a day's row comes once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").cast("date").alias("date"), "event_type", "n", "value")


def sliding(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """A window's row comes once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date(F.col("w.end") - F.expr("interval 1 day")).alias("date"), "event_type", "n")


def first_seen(stream: DataFrame, key: list[str], late: str = "40 days") -> DataFrame:
    """One row of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


class _Refractory(StatefulProcessor):
    """The day of a key's last event; a timer drops it once no event can be within its time any more."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "day long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for ts in sorted(t for b in rows for t in b["ts"]):
            day = ts.date().toordinal()
            if last is None or day - last > self.days:
                kept.append(ts)
                last = day
        if kept:
            self.last.update((last,))
            self.handle.registerTimer((last + self.days + 1 - 719163) * 86_400_000)
            yield pd.DataFrame({"user_id": key[0], "event_type": key[1], "ts": kept})

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        # an event taken since has a timer of its own
        if self.last.exists() and (self.last.get()[0] + self.days + 1 - 719163) * 86_400_000 <= expired.getExpiryTimeInMs():
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def _rocksdb(spark: SparkSession) -> None:
    """Streams with state variables need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def refractory(stream: DataFrame, days: int = 7, late: str = "40 days") -> DataFrame:
    """An event of a key is emitted if none was within ``days`` days before; one value of state for each key, dropped after its time."""
    _rocksdb(stream.sparkSession)
    return stream.withWatermark("ts", late).groupBy("user_id", "event_type").transformWithStateInPandas(_Refractory(days), "user_id long, event_type string, ts timestamp", "Append", "EventTime")


#: Buckets that a state variable's keys are dealt into, and entries of a scope held in memory before they go back to state.
BUCKETS, HELD = 4096, 1 << 20


class _Buckets:
    """A state variable that maps a key to values, its keys dealt into buckets.

    A bucket is read once and written once while a batch holds it, however many of its keys occur: a call to state costs
    more than an item. An entry has the time that it was put at where entries are forgotten ``ttl_ms`` after it.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str, ttl_ms: int | None):
        self.state = handle.getMapState(name, "bucket int", f"keys array<{key}>, vals array<{value}>, at array<long>", ttl_ms)
        self.ttl_ms = ttl_ms

    def begin(self, now: int) -> None:
        self.now, self.held, self.changed, self.size, self.new = now, {}, set(), 0, not self.state.exists()

    def _bucket(self, n: int) -> dict:
        if n not in self.held:
            # nothing is asked of an empty variable
            found = None if self.new else self.state.getValue((n,))
            self.held[n] = {}
            for key, value, at in zip(*found) if found else ():
                if self.ttl_ms is None or at + self.ttl_ms > self.now:
                    self.held[n].setdefault(key, []).append((value, at))
                    self.size += 1
        return self.held[n]

    def of(self, n: int, key) -> list[tuple]:  # noqa: ANN001
        """(value, at) of a key, in the order they were put."""
        return self._bucket(n).get(key, [])

    def put(self, n: int, key, value) -> None:  # noqa: ANN001
        self._bucket(n).setdefault(key, []).append((value, self.now))
        self.changed.add(n)
        self.size += 1

    def flush(self) -> None:
        for n in self.changed:
            entries = [(key, value, at) for key, found in self.held[n].items() for value, at in found]
            self.state.updateValue((n,), tuple(map(list, zip(*entries))))
        self.begin(self.now)


def _dealt(key: str) -> int:
    return zlib.crc32(key.encode()) % BUCKETS


class _Flagging(StatefulProcessor):
    """Duplicate status of a scope's items in their order; an item reads the buckets that what it may repeat lies in and no more.

    Of ``max_bits`` + 1 parts of a fingerprint, two that differ in at most ``max_bits`` bits have one equal at
    least; retained fingerprints are listed under each of their parts.
    """

    def __init__(self, max_bits: int, ttl_ms: int | None):
        self.max_bits, self.ttl_ms = max_bits, ttl_ms
        edges = [64 * i // (max_bits + 1) for i in range(max_bits + 2)]
        self.parts = [(a, (1 << (b - a)) - 1, max(0, b - a - (BUCKETS.bit_length() - 1))) for a, b in zip(edges, edges[1:])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = lambda name, key, value: _Buckets(handle, name, key, value, self.ttl_ms)
        self.urls = kept("urls", "string", "string")
        self.texts = kept("texts", "string", "string")
        self.retained = kept("retained", "long", "long")
        self.flagged = kept("flagged", "string", "string")
        self.kept = (self.urls, self.texts, self.retained, self.flagged)

    def _near(self, fp: int) -> bool:
        """Whether ``fp`` is near a retained fingerprint; if it isn't, it is retained."""
        places = []
        for i, (shift, mask, low) in enumerate(self.parts):
            bits = (fp >> shift) & mask
            # a bucket has the values of a part that begin alike; as a key a value is a signed long
            n, key = i * BUCKETS + (bits >> low), bits - (1 << 64) if bits >> 63 else bits
            if any(((fp ^ x) & (1 << 64) - 1).bit_count() <= self.max_bits for x, _ in self.retained.of(n, key)):
                return True
            places.append((n, key))
        for n, key in places:
            self.retained.put(n, key, fp)
        return False

    def _status(self, r) -> str:  # noqa: ANN001
        if r.canon is not None:
            n = _dealt(r.canon)
            if first := self.urls.of(n, r.canon):
                return "duplicate_url" if first[0][0] == r.community else "crosspost"
            self.urls.put(n, r.canon, r.community)
        if r.text_key is None:
            return "unique"
        n = _dealt(r.text_key)
        if self.texts.of(n, r.text_key):
            return "duplicate_exact"
        self.texts.put(n, r.text_key, None)
        return "near_duplicate" if self._near(int(r.fp)) else "unique"

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        batch = pd.concat([b.astype({"fp": object}) for b in rows], ignore_index=True).sort_values(["published_at", "doc_id"], kind="stable")
        batch = batch.astype(object).where(batch.notna(), None)
        for kept in self.kept:
            kept.begin(timers.getCurrentProcessingTimeInMs() if self.ttl_ms is not None else 0)
        out = []
        for r in batch.itertuples(index=False):
            status = self._status(r)
            if status in ("duplicate_exact", "near_duplicate") and r.author_hash is not None:
                n = _dealt(r.author_hash)
                if self.flagged.of(n, r.author_hash):
                    status = "bot_repeat"
                else:
                    self.flagged.put(n, r.author_hash, None)
            out.append((*key, r.doc_id, r.published_at, status))
            if sum(kept.size for kept in self.kept) > HELD:
                for kept in self.kept:
                    kept.flush()
        for kept in self.kept:
            kept.flush()
        yield pd.DataFrame(out, columns=["scope", "doc_id", "published_at", "status"])

    def close(self) -> None:
        pass


def flagged(stream: DataFrame, scope: str = "source", max_bits: int = dedupe.MAX_BITS, ttl_ms: int | None = None) -> DataFrame:
    """Every item with its duplicate status, near copies included: (scope, doc_id, published_at, status).

    ``stream`` has doc_id, published_at, url, community, text, author_hash and the column ``scope``, within
    which items are compared. Items that arrive in order of publication, in whatever batches, get the statuses
    of the batch form; in one batch they are put in order. Texts stay in the JVM: keys and fingerprints travel.
    With ``ttl_ms`` what an item may repeat is forgotten after that time. A null text or URL repeats nothing.
    """
    _rocksdb(stream.sparkSession)
    rows = dedupe.narrow(stream, F.col(scope).cast("string").alias("scope"), "author_hash", dedupe.fingerprint())
    return rows.groupBy("scope").transformWithStateInPandas(_Flagging(max_bits, ttl_ms), "scope string, doc_id long, published_at timestamp, status string", "Append", "None")


def drain(query: DataFrame) -> DataFrame:
    """Run a stream over what is there and return what it wrote: a table in the shared folder, its state beside it."""
    spark = query.sparkSession
    base = f"{shared_dir(spark)}/tidemark/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    run = query.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{base}/out").select(*query.columns)
