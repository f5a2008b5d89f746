"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all operators: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; a local one only in local mode where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
            current = spark.sparkContext.getCheckpointDir()
        found = current
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize()."""
    path = getattr(df, "_attestry_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one call of an operator, deleted together when it is done with them."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        out = materialize(df)
        self.tables.append(out)
        return out

    def keep(self, *wanted: DataFrame) -> None:
        """Delete all tables but those wanted."""
        self.tables = [t for t in self.tables if all(t is not w for w in wanted)]
        self.clear()

    def clear(self) -> None:
        for table in self.tables:
            discard(table)
        self.tables.clear()


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Keep Arrow batches small, so that long texts don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Positional:
    """A table under names that no added column can clash with, and the way back."""

    def __init__(self, docs: DataFrame) -> None:
        self.columns = docs.columns
        self.names = [f"__c{k}" for k in range(len(self.columns))]
        self.frame = docs.toDF(*self.names)

    def __call__(self, name: str) -> str:
        """The present name of a column."""
        return self.names[self.columns.index(name)]

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        """df with the old columns under their old names, and the added ones, which replace old ones of the same name."""
        kept = [(n, c) for n, c in zip(self.names, self.columns) if c not in added]
        return df.select(*[n for n, _ in kept], *added).toDF(*[c for _, c in kept], *added)


def row_hash(docs: DataFrame, seed: int = 1) -> Column:
    """A 64-bit hash of all columns of a row, which tells null from any value and in which column it stands."""
    parts: list[Column] = []
    for name, kind in docs.dtypes:
        own = F.col(f"`{name}`")
        nested = kind.startswith(("map", "array", "struct"))
        parts += [own.isNull(), F.to_json(own, {"ignoreNullFields": "false"}) if nested else own]
    return F.xxhash64(F.lit(seed), *parts)


def sample_rows(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str, most_bytes: int = 96 << 20) -> pd.DataFrame:
    """Rows (__id, columns of picked, __text) of a bounded sample picked(__id, ...), one an id, sorted by id.

    Of rows that repeat an id the one with the smallest hash of its text counts. Ids come in
    the order of their md5; one whose text doesn't fit into what is left of most_bytes is
    passed over, so repeated ids and long texts can't fill the driver.
    """
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    met = own.join(F.broadcast(picked), "__id")
    size = F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long")
    others = [c for c in picked.columns if c != "__id"]
    first = met.groupBy("__id", *others).agg(F.min(F.struct(F.xxhash64("__text").alias("h"), size.alias("n"))).alias("f"))
    sizes = first.select("__id", *others, "f.h", "f.n", F.md5(F.col("__id").cast("string").cast("binary")).alias("m")).toPandas().sort_values(["m", "__id"], kind="stable")
    left, fits = most_bytes, []
    for n in sizes["n"]:
        fits.append(n <= left)
        left -= n if fits[-1] else 0
    sizes = sizes[fits]
    if not len(sizes):
        return pd.DataFrame(columns=["__id", *others, "__text"])
    kinds = dict(picked.dtypes)
    chosen = docs.sparkSession.createDataFrame(sizes[["__id", *others, "h"]].itertuples(index=False, name=None), ", ".join(f"`{c}` {kinds[c]}" for c in ("__id", *others)) + ", h long")
    rows = own.join(F.broadcast(chosen), (own["__id"] == chosen["__id"]) & (F.xxhash64("__text") == F.col("h"))).select(chosen["__id"], *others, "__text")
    out = rows.dropDuplicates(["__id"]).toPandas().sort_values("__id", kind="stable")
    out["__text"] = [t if isinstance(t, str) else None for t in out["__text"]]
    return out


def join_weighed(left: DataFrame, right: DataFrame, key: list[str], total: int) -> DataFrame:
    """left joined with right(key, n, ...) of unique keys, n the rows of left that have the key.

    Keys of a large share of the rows are broadcast, at most 20,000 of them, so no task
    gets all rows of one; the others meet by shuffle.
    """
    many = F.col("n") > max(200, total // 20_000)
    heavy, light = F.broadcast(right.where(many).drop("n")), right.where(~many).drop("n")
    columns = [*left.columns, *[c for c in right.columns if c not in (*key, "n")]]
    return left.join(heavy, key).select(*columns).union(left.join(heavy.select(*key), key, "left_anti").join(light, key).select(*columns))


def checked_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast df when its counted rows stay within most; else leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null where the value is null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) from the md5 of the columns as text; the same in any engine."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def byte_words(text: bytes | None) -> list[bytes]:
    """bytes.split() splits on exactly the six ASCII white-space characters of WORD."""
    return text.split() if text else []


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable position of each of n nodes over the links a-b."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
