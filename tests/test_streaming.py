from datetime import datetime

from pyspark.sql import functions as F

from attestry.sources.store import Store
from attestry.streaming import feeds

T = lambda s: datetime(2024, 1, 1, 0, 0, s)
UUID = "00000000-0000-4000-8000-00000000000%d"


def test_packets_are_checked(spark):
    rows = [('{"client_id": "%s", "api_port": 80}' % (UUID % 1),), ('{"client_id": "%s", "api_port": 0}' % (UUID % 1),), ('{"client_id": "nope"}',), ('{"client_id": "%s", "x": 1}' % (UUID % 1),), ("not json",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(feeds.valid_packet(F.col("p")).alias("v")).collect()
    assert [r["v"] for r in got] == [True, False, False, False, False, False]


def packets(spark, rows):
    return spark.createDataFrame(rows, "client_id string, hostname string, installed_version string, last_seen timestamp")


def test_upsert_keeps_first_seen_and_state(spark):
    one = feeds.upsert(spark.createDataFrame([], "client_id string, first_seen timestamp, last_seen timestamp, hostname string, installed_version string, state string"), packets(spark, [("a", "h", "1", T(1)), ("b", "h", "1", T(2))]))
    adopted = feeds.set_adopted(one, "a")
    two = feeds.upsert(adopted.drop("changed"), packets(spark, [("a", None, "2", T(9)), ("c", "x", "1", T(5))]))
    got = {r["client_id"]: (r["first_seen"], r["last_seen"], r["state"]) for r in two.collect()}
    assert got == {"a": (T(1), T(9), "ADOPTED"), "b": (T(2), T(2), "DISCOVERED"), "c": (T(5), T(5), "DISCOVERED")}
    seen = {r["client_id"]: r["stale"] for r in feeds.visible(two, F.lit(T(36)).cast("timestamp")).collect()}
    assert seen == {"a": False}
    later = {r["client_id"]: r["stale"] for r in feeds.visible(two, F.lit(T(50)).cast("timestamp")).collect()}
    assert later == {"a": True}  # stale ones are hidden unless adopted


def test_names_survive_empty_packets(spark):
    p = packets(spark, [("a", "h", "1", T(1)), ("a", None, None, T(2))])
    assert feeds.latest_clients(p).first()["hostname"] is None
    assert feeds.latest_clients(p, keep_names=True).first()["hostname"] == "h"


def stream(spark, tmp_path, frames, schema):
    base = str(tmp_path / "in")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(base)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(base)


def test_registry_stream(spark, tmp_path):
    frames = [packets(spark, [("a", "h", "1", T(1))]), packets(spark, [("a", "k", "2", T(4)), ("b", "h", "1", T(2))])]
    out = str(tmp_path / "registry")
    source = stream(spark, tmp_path, frames, frames[0].schema)
    store = Store(spark, f"file://{out}")
    q = source.writeStream.foreachBatch(feeds.registry_sink(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = store.read("registry")
    feeds.registry_sink(store)(frames[0].withColumn("hostname", F.lit("again")), 1)  # a batch that comes again
    assert store.versions() == [1, 2]
    assert {(r["client_id"], r["first_seen"], r["last_seen"]) for r in last.collect()} == {("a", T(1), T(4)), ("b", T(2), T(2))}


def test_scan_stream_adds_only_new_references(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "source_profile string, origin_memory_id string")
    frames = [make([("p", "1"), ("p", "2"), ("p", "1")]), make([("p", "2"), ("q", "1")])]
    out = str(tmp_path / "entries")
    q = stream(spark, tmp_path, frames, frames[0].schema).writeStream.foreachBatch(feeds.scan_sink(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r[0], r[1]) for r in spark.read.parquet(out).select("source_profile", "origin_memory_id").collect()) == [("p", "1"), ("p", "2"), ("q", "1")]


def test_sync_stream_keeps_its_checkpoint_between_batches(spark, tmp_path):
    schema = "participant_id string, exchange_id string, sequence long, version long, arrival long"
    frames = [spark.createDataFrame([("p", "e1", 1, 1, 1), ("p", "e3", 3, 3, 2)], schema), spark.createDataFrame([("p", "e1", 1, 1, 3), ("p", "e2", 2, 2, 4)], schema)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = feeds.sync_stream(stream(spark, tmp_path, frames, frames[0].schema)).writeStream.format("memory").queryName("sync_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["exchange_id"], r["outcome"]) for r in spark.table("sync_out").collect()) == [("e1", "applied"), ("e1", "duplicate"), ("e2", "applied"), ("e3", "retry")]


def test_clients_go_stale_by_timer(spark, tmp_path):
    """In update mode: by the packets of others, between two packets of one batch, and back again; late and repeated packets change nothing."""
    at = lambda m, s: datetime(2024, 1, 1, 0, m, s)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batches = [
        [("a", "h", "1", at(0, 1)), ("b", None, "1", at(0, 2)), ("b", "k", "2", at(0, 20))],
        [("b", "k", "2", at(0, 40)), ("c", "x", "1", at(0, 0))],  # a is 39 seconds old; c is before the watermark, which drops packets from the next batch on
        [("a", "h", "3", at(1, 30)), ("b", "k", "2", at(0, 45)), ("d", None, None, at(1, 0)), ("d", None, None, at(1, 41)), ("d", "between", None, at(1, 10))],
        [("e", "h", "1", at(9, 0)), ("f", "h", "1", at(0, 5))],
    ]
    frames = [packets(spark, rows) for rows in batches]
    store = Store(spark, f"file://{tmp_path}/changes")
    source = stream(spark, tmp_path, frames, frames[0].schema)
    q = feeds.liveness(source).writeStream.outputMode("update").foreachBatch(feeds.changes_sink(store, "changes")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["client_id"], r["at"], r["status"]) for r in store.read("changes").collect())
    assert got == sorted([
        ("a", at(0, 1), "seen"), ("a", at(0, 31), "stale"), ("a", at(1, 30), "seen"), ("a", at(2, 0), "stale"), ("b", at(0, 2), "seen"), ("b", at(1, 15), "stale"), ("c", at(0, 0), "seen"), ("c", at(0, 30), "stale"),
        ("d", at(1, 0), "seen"), ("d", at(1, 40), "stale"), ("d", at(1, 41), "seen"), ("d", at(2, 11), "stale"), ("e", at(9, 0), "seen"),
    ])
