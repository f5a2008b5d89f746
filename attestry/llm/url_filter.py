"""URL filtering against dated lists: entries become intervals, captures meet those active when fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, join_weighed, materialize

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower-cased host without a final dot; null where there is none."""
    found = F.lower(F.rtrim(F.regexp_extract(url, _HOST, 1), F.lit(".")))
    return F.when(found != "", found)


def patterns(url: Column) -> Column:
    """All keys that can list a url: 'd:' and each of its domains, 'p:' and its host with each leading part of its path."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")))
    parts = F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda x: x != "")
    paths = F.when(
        F.size(parts) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("p:"), name, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(name.isNotNull(), F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity (list, pattern, valid_from, valid_to) of entries(list, pattern, action, at).

    An 'add' holds until the pattern's next entry in the same list, 'remove' ends it, and
    an open interval has a null end. Of entries of one instant a removal counts last.
    Entries without pattern or date, and repeated ones, change nothing. The history of a
    pattern is ordered by itself; histories are short where lists are large.
    """
    known = entries.where("pattern is not null and at is not null and action in ('add', 'remove')").dropDuplicates(["list", "pattern", "action", "at"])
    order = W.partitionBy("list", "pattern").orderBy("at", "action")
    return known.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add' and (valid_to is null or at < valid_to)").select(
        "list", "pattern", F.col("at").alias("valid_from"), "valid_to"
    )


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched", most_broadcast: int = 200_000) -> DataFrame:
    """One row per capture: page_id, url, fetched, n_active, first_pattern, blocked.

    n_active counts the entries active at fetch time that list the url by domain or path.
    Verdicts are found once per distinct (url, fetched) and joined back, so repeated
    captures keep a row each and meet the lists once; those of a large share of all captures
    get theirs by broadcast. Intervals are broadcast up to most_broadcast rows (counted); beyond,
    patterns that list something are joined by key, frequent ones by broadcast. A url without
    host, a null url or fetch time meets no entry. Empty lists block nothing, an empty table
    gives an empty result, and other columns of captures are ignored.
    """
    valid = materialize(intervals(entries))
    n = valid.count()
    own = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched"))
    dated = own.where("url is not null and fetched is not null")
    times = materialize(dated.groupBy("url", "fetched").agg(F.count("*").alias("n")))
    asked = times.select("url", "fetched", F.explode(patterns(F.col("url"))).alias("pattern"))
    holds = F.expr("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    if n <= most_broadcast:
        active = asked.join(F.broadcast(valid), "pattern").where(holds)
    else:
        # patterns of a large share of the urls are few, and the history of each is short: they are broadcast
        counts = asked.groupBy("pattern").agg(F.count("*").alias("n"))
        listed = materialize(valid.groupBy("pattern").agg(F.collect_list(F.struct("valid_from", "valid_to")).alias("spans")).join(counts, "pattern"))
        each = join_weighed(asked, listed, ["pattern"], times.count())
        active = each.select("url", "fetched", "pattern", F.explode("spans").alias("s")).select("url", "fetched", "pattern", "s.*").where(holds)
    found = active.groupBy("url", "fetched").agg(F.count("*").alias("n_active"), F.min("pattern").alias("first_pattern"))
    verdicts = materialize(times.join(found, ["url", "fetched"], "left"))
    met = join_weighed(dated, verdicts, ["url", "fetched"], own.count()).select("page_id", "url", "fetched", "n_active", "first_pattern")
    rest = own.where("url is null or fetched is null").withColumns({"n_active": F.lit(None).cast("long"), "first_pattern": F.lit(None).cast("string")})
    discard(times)
    return met.union(rest).select(
        "page_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "first_pattern", F.col("n_active").isNotNull().alias("blocked")
    )
