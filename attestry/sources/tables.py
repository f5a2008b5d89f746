"""Projections of plain tables onto the engine's inputs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.sources.store import Conflict, shared_folder


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def entries(spark: SparkSession, base: str, vectors: bool = False) -> DataFrame:
    """Collective entries: references to memories with their lifecycle."""
    docs = table(spark, base, "documents").select("doc_id", "source")
    labels = table(spark, base, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    out = docs.join(labels, "doc_id", "left").select(
        (F.col("doc_id") + 1).alias("id"),
        F.concat(F.lit("agent"), (F.col("doc_id") % 3).cast("string"), F.lit(":"), "source").alias("source_profile"),
        F.col("doc_id").cast("string").alias("origin_memory_id"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("is_promoted"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("is_revoked"),
        F.when(F.col("doc_id") % 10 != 9, F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))")).alias("validated_at"),
    )
    if vectors:
        out = out.join(table(spark, base, "embeddings").select((F.col("vec_id") + 1).alias("id"), "embedding"), "id", "left")
    return out


def memories(spark: SparkSession, base: str) -> DataFrame:
    """Source memories: text and dates by (source_profile, origin_memory_id)."""
    return table(spark, base, "documents").select(
        F.concat(F.lit("agent"), (F.col("doc_id") % 3).cast("string"), F.lit(":"), "source").alias("source_profile"),
        F.col("doc_id").cast("string").alias("origin_memory_id"),
        F.col("text").alias("content"),
        F.when(F.col("doc_id") % 10 != 9, F.expr("date_add(date'2024-01-01', cast(doc_id % 30 as int))")).alias("event_date"),
        F.when(F.col("doc_id") % 4 != 3, "day").otherwise("unknown").alias("event_date_precision"),
    )


def assertions(spark: SparkSession, base: str) -> DataFrame:
    """State assertions with their precision: one per event, the user as subject."""
    precision = F.element_at(F.array(*map(F.lit, ("day", "hour", "minute", "second"))), (F.col("event_id") % 4 + 1).cast("int"))
    events = table(spark, base, "events").withColumn("precision", precision)
    return events.select(
        (F.col("event_id") + 1).alias("evidence_id"), F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"),
        F.col("event_type").alias("state"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"), F.lit(None).cast("string").alias("end_time"), "precision",
    )


def evidence_texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "events").select(
        (F.col("event_id") + 1).alias("entry_id"),
        F.concat(F.lit("Case "), F.col("event_id").cast("string"), F.lit(" changed from open to "), "event_type", F.lit(" on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(".")).alias("text"),
    )


def state_of(spark: SparkSession, base: str, *names: str) -> str:
    """A digest of the files of tables (names, lengths, times), which changes when they do."""
    seen = []
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        seen += [f"{s.getPath().toString()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(at)]
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def keyword_index(spark: SparkSession, base: str):
    """The keyword index of the tables as they are, written to the shared folder by whoever asks first."""
    from attestry.operators.keyword_index import KeywordIndex

    index = KeywordIndex(spark, f"{shared_folder(spark)}/attestry-keyword-{KeywordIndex.FORMAT}-{state_of(spark, base, 'documents', 'labels')}")
    if not index.store.versions():
        try:
            index.rebuild(entries(spark, base), memories(spark, base))
        except Conflict:
            pass  # another session was faster
    return index


def similarity_graph(spark: SparkSession, base: str, threshold: float):
    """The similarity graph of the tables as they are, written to the shared folder by whoever asks first."""
    from attestry.operators.similarity import SimilarityGraph

    state = state_of(spark, base, "documents", "labels", "embeddings")
    graph = SimilarityGraph(spark, f"{shared_folder(spark)}/attestry-graph-{threshold}-{state}", threshold)
    if not graph.store.versions():
        try:
            graph.refresh(entries(spark, base, vectors=True))
        except Conflict:
            pass  # another session was faster
    return graph
