"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Positional, checked_broadcast, materialize, unit_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of sizes(source, source_size): weights repeat in code-point order, null last.

    A source takes weight x level words, never over most x its size; the level is the one
    at which all targets add up to share x all sizes, which is where resharing the excess
    by weight ends. Works on one row per source, so the ordered windows see sources only.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    all_rows = W.partitionBy()
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("weight").over(by_room.rowsBetween(0, W.unboundedFollowing)).alias("above"),
        (F.sum("source_size").over(all_rows) * F.lit(share)).alias("total"),
    )
    level = (F.col("total") - F.col("below")) / F.col("above")  # if all from here on share what is left
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    found = F.first("level", ignorenulls=True).over(by_room.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.withColumn("met", found).select(
        "source", "source_size", F.when(F.col("met").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("weight") * F.col("met"))).alias("target")
    )


def _rate(source_size: Column, target: Column) -> Column:
    return F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))


def _copies(rate: Column, chance: Column) -> Column:
    """floor(rate) copies and one more with the chance of the fraction."""
    return F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")


def _chance(seed: str, id_col: str, text_col: str) -> Column:
    return unit_hash(F.lit(seed), F.col(id_col), F.md5(F.col(text_col).cast("binary")))


def _with_targets(docs: DataFrame, source_col: str, targets: DataFrame) -> DataFrame:
    side = targets.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    side = checked_broadcast(side, targets.count(), 100_000)
    return docs.join(side, F.col(source_col).eqNullSafe(F.col("__source")), "left").drop("__source")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **policy) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target and copies (0 to 2).

    Words are counted once, into a narrow table. Sizes are added up per source before the
    shuffle, so a source with a third of all rows is as cheap as any; rates come back by a
    broadcast join when sources are few (counted) and a skew-splitting join otherwise. The
    fractional copy is decided by the md5 of seed, id and text: reruns agree, and only rows
    equal in id and text are decided alike. Null and wordless texts and sources
    without words have size 0 and no copies; null ids hash as an empty text. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    sized = materialize(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), _chance(seed, id_col, text_col).alias("chance")
    ))
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **policy))
    met = _with_targets(sized, "source", targets)
    copies = _copies(_rate(F.col("__source_size"), F.col("__target")), F.col("chance"))
    return met.select(
        "doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **policy) -> DataFrame:
    """The mixture itself: every document emitted as often as plan_mix() says, columns unchanged, whatever their names.

    Words are counted once, for the sources' sizes; documents are then only asked whether
    they hold a word.
    """
    own = Positional(docs)
    at_id, at_text, at_source = own(id_col), own(text_col), own(source_col)
    totals = own.frame.groupBy(F.col(at_source).alias("source")).agg(F.sum(word_count(F.col(at_text))).alias("source_size"))
    met = _with_targets(own.frame, at_source, materialize(source_targets(totals, **policy)))
    copies = _copies(_rate(F.col("__source_size"), F.col("__target")), _chance(seed, at_id, at_text))
    some = met.where(F.col(at_text).rlike(WORD)).withColumn("__copies", copies.cast("int")).where("__copies > 0")
    return own.back(some.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))))
