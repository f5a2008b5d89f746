"""Structured Streaming: discovery packets, federation synchronization, incremental scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestry.operators.federation import Checkpoint
from attestry.operators.governance import unseen
from attestry.sources.store import Store

STALE_SECONDS = 30
_UUID4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
_KEYS = ("client_id", "hostname", "installed_version", "address", "api_port")


def valid_packet(payload: Column) -> Column:
    """Whether a JSON packet has a canonical UUID4 client_id, known keys only and a port in range; anything else is dropped."""
    data = F.from_json(payload, "client_id string, hostname string, installed_version string, address string, api_port long")
    keys = F.json_object_keys(payload)
    known = F.forall(keys, lambda k: k.isin(*_KEYS))
    port = data["api_port"]
    return F.coalesce(known & data["client_id"].rlike(_UUID4) & (port.isNull() | port.between(1, 65535)), F.lit(False))


def parse_packets(raw: DataFrame, payload: str = "payload", seen: str = "seen_at") -> DataFrame:
    data = F.from_json(F.col(payload), "client_id string, hostname string, installed_version string, address string, api_port long")
    return raw.where(valid_packet(F.col(payload))).select(data.alias("d"), F.col(seen).alias("last_seen")).select("d.*", "last_seen")


def latest_clients(packets: DataFrame, keep_names: bool = False) -> DataFrame:
    """One row a client: first and last seen, and its last packet; with keep_names the last hostname and version that weren't null.

    All are mergeable aggregates, so the same expression serves batch and stream.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("last_seen"))) if keep_names else F.max_by(c, "last_seen")
    return packets.groupBy("client_id").agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), last("hostname").alias("hostname"), last("installed_version").alias("installed_version"))


def upsert(registry: DataFrame, packets: DataFrame) -> DataFrame:
    """registry(client_id, first_seen, last_seen, hostname, installed_version, state) with packets merged in: first_seen and state stay, new clients are DISCOVERED."""
    new = latest_clients(packets)
    out = registry.alias("r").join(new.alias("n"), "client_id", "full_outer")
    return out.select(
        "client_id", F.coalesce("r.first_seen", "n.first_seen").alias("first_seen"), F.greatest("r.last_seen", "n.last_seen").alias("last_seen"), F.coalesce("n.hostname", "r.hostname").alias("hostname"),
        F.coalesce("n.installed_version", "r.installed_version").alias("installed_version"), F.coalesce("r.state", F.lit("DISCOVERED")).alias("state"),
    )


def visible(registry: DataFrame, now: Column, stale_after: int = STALE_SECONDS) -> DataFrame:
    """Clients with stale (never seen, or longer ago than stale_after seconds); stale ones are hidden unless ADOPTED."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    out = registry.withColumn("stale", F.col("last_seen").isNull() | (age > stale_after))
    return out.where(~F.col("stale") | (F.col("state") == "ADOPTED"))


def set_adopted(registry: DataFrame, client_id: str, adopted: bool = True) -> DataFrame:
    """registry with one client's state flipped, and whether that changed anything."""
    target = "ADOPTED" if adopted else "DISCOVERED"
    mine = F.col("client_id") == client_id
    return registry.withColumn("changed", mine & (F.col("state") != target)).withColumn("state", F.when(mine, F.lit(target)).otherwise(F.col("state")))


REGISTRY = "client_id string, first_seen timestamp, last_seen timestamp, hostname string, installed_version string, state string"


def registry_sink(store: Store):
    """A foreachBatch writer that keeps the registry table of a store: each batch is merged in once, and readers see whole versions."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change = store.begin()
        if change.base["notes"].get("registry_batch", -1) >= batch_id:
            return
        old = change.read("registry") if "registry" in change.tables else batch.sparkSession.createDataFrame([], REGISTRY)
        change.replace("registry", upsert(old, batch))
        change.commit(registry_batch=batch_id)

    return write


class Liveness(StatefulProcessor):
    """When a client is first seen, goes stale and comes back, told by event-time timers: one state and one timer a client."""

    def __init__(self, stale_after: int, forget_after: int) -> None:
        self.stale_after, self.forget_after = stale_after * 1000, forget_after * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("client", "first_seen long, last_seen long, stale boolean, hostname string, installed_version string")

    def _told(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            frame = pd.DataFrame(rows, columns=["status", "at", "first_seen", "last_seen", "hostname", "installed_version"])
            for c in ("at", "first_seen", "last_seen"):
                frame[c] = pd.to_datetime(frame[c], unit="ms")
            frame.insert(0, "client_id", key[0])
            yield frame

    def _wait(self, until: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, last, stale, host, version = self.state.get() if self.state.exists() else (None, None, True, None, None)
        frame = pd.concat(list(rows)).sort_values(["last_seen", "hostname", "installed_version"], kind="stable", na_position="first")
        out = []
        for at, h, v in zip(frame["last_seen"].astype("datetime64[ms]").astype("int64"), frame["hostname"], frame["installed_version"]):
            if last is not None and at < last:
                continue  # an older packet changes nothing
            if not stale and at - last > self.stale_after:  # it went stale between two packets of one batch
                out.append(("stale", last + self.stale_after, first, last, host, version))
                stale = True
            first, last, host, version = at if first is None else first, at, h if isinstance(h, str) else None, v if isinstance(v, str) else None
            if stale:
                out.append(("seen", at, first, last, host, version))
                stale = False
        self.state.update((first, last, stale, host, version))
        self._wait(last + self.stale_after)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, last, stale, host, version = self.state.get()
        if stale:  # long gone
            self.state.clear()
            return
        self.state.update((first, last, True, host, version))
        self._wait(last + max(self.forget_after, self.stale_after + 1))
        yield from self._told(key, [("stale", last + self.stale_after, first, last, host, version)])

    def close(self) -> None:
        pass


def liveness(packets: DataFrame, stale_after: int = STALE_SECONDS, forget_after: int = 86_400, late: str = "0 seconds") -> DataFrame:
    """Changes of a stream of packets(client_id, hostname, installed_version, last_seen): (client_id, status, at, first_seen, last_seen, hostname, installed_version).

    status is seen for a new or returning client and stale once its last packet is over
    stale_after seconds old in event time, whether other packets of its own show that or
    only those of others (a timer). Packets later than late are dropped; a client that is
    silent for forget_after seconds is new when it returns. To be written in update mode.
    """
    kind = "client_id string, status string, at timestamp, first_seen timestamp, last_seen timestamp, hostname string, installed_version string"
    own = packets.select("client_id", "hostname", "installed_version", F.col("last_seen").cast("timestamp").alias("last_seen")).withWatermark("last_seen", late)
    return own.groupBy("client_id").transformWithStateInPandas(Liveness(stale_after, forget_after), kind, "update", "eventTime")


def changes_sink(store: Store, name: str):
    """A foreachBatch writer that appends each batch once: its number is committed with it, so one that comes again is known."""

    def write(batch: DataFrame, batch_id: int) -> None:
        change = store.begin()
        if change.base["notes"].get(f"{name}_batch", -1) >= batch_id:
            return
        change.append(name, batch)
        change.commit(**{f"{name}_batch": batch_id})

    return write


class _SeenIds:
    """Exchange ids in keyed state, one entry an id."""

    def __init__(self, state) -> None:
        self.state = state

    def __contains__(self, exchange_id: str) -> bool:
        return self.state.containsKey((exchange_id,))

    def add(self, exchange_id: str) -> None:
        self.state.updateValue((exchange_id,), (True,))


class SyncProcessor(StatefulProcessor):
    """Sequence-checked synchronization: a checkpoint a participant, and the ids applied as entries of a map, in keyed state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("checkpoint", "next long, version long")
        self.seen = _SeenIds(handle.getMapState("seen", "exchange_id string", "applied boolean"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        n, v = self.state.get() if self.state.exists() else (1, 0)
        at = Checkpoint(n, v, self.seen)
        frame = pd.concat(list(rows)).sort_values(["arrival", "exchange_id"], kind="stable")
        frame["outcome"] = [at.step(e, int(s), int(v)) for e, s, v in zip(frame["exchange_id"], frame["sequence"], frame["version"])]
        self.state.update((at.next, at.version))
        yield frame[["participant_id", "exchange_id", "sequence", "version", "outcome"]]

    def close(self) -> None:
        pass


def sync_stream(exchanges: DataFrame) -> DataFrame:
    """Outcomes of a stream of exchanges(participant_id, exchange_id, sequence, version, arrival)."""
    return exchanges.groupBy("participant_id").transformWithStateInPandas(
        SyncProcessor(), "participant_id string, exchange_id string, sequence long, version long, outcome string", "append", "none"
    )


def scan_sink(entries_path: str):
    """A foreachBatch writer that appends references of an inventory stream no entry has yet."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(entries_path)
        except Exception as e:  # only a table that isn't there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            have = spark.createDataFrame([], "source_profile string, origin_memory_id string")
        new = unseen(batch.select("source_profile", "origin_memory_id").distinct(), have).withColumn("batch_id", F.lit(batch_id))
        new.write.mode("append").parquet(entries_path)

    return write


def last_packets(packets: DataFrame) -> DataFrame:
    """The last packet of each client whole, by (last_seen, hostname), in batch."""
    w = W.partitionBy("client_id").orderBy(F.desc("last_seen"), F.desc("hostname"))
    return packets.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
