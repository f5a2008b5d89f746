"""Retrieval channels, fusion, reranking, explanation and evaluation.

A channel is a DataFrame (entry_id, score, rank); ranks start at 1 and follow score, then
entry_id, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.functions import vectors as vx
from attestry.operators.governance import governed_entries
from attestry.schema import CHANNELS

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Channels that a step of a route admits candidates from (fixed values).
ADMITTED = {
    "semantic": ("keyword", "semantic", "graph"), "lexical": ("keyword", "semantic", "graph"), "temporal": ("keyword", "semantic", "temporal", "graph"),
    "entity": ("keyword", "semantic", "entity", "graph"), "relationship": ("keyword", "semantic", "entity", "graph"),
}


def ranked(rows: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """rows cut to limit by order, then numbered: the cut is a distributed top-k, so the numbering window sees limit rows only."""
    order = order or (F.desc("score"), F.asc("entry_id"))
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


# ---- keyword --------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; underscores part words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def times(column: str, term: str) -> Column:
    """How often a term is among the words of a column."""
    return F.size(F.filter(column, lambda x: x == F.lit(term)))


def postings(entries: DataFrame, memories: DataFrame, stem: bool = False) -> DataFrame:
    """(entry_id, source_profile, term, tf, dl) of governed entries with text that isn't blank; stemmed terms lose their diacritics first."""
    from attestry.operators.keyword_index import fold

    rows = governed_entries(entries).select(F.col("id").alias("entry_id"), "source_profile", "origin_memory_id").join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"])
    rows = rows.where(F.length(F.trim("content")) > 0).select("entry_id", "source_profile", words(fold(F.col("content")) if stem else F.col("content")).alias("w"))
    each = rows.select("entry_id", "source_profile", F.size("w").alias("dl"), F.explode("w").alias("term"))
    if stem:
        each = each.withColumn("term", tx.stem_column("term"))
    return each.groupBy("entry_id", "source_profile", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def stem_counts(words: Column, terms: list[str]) -> Column:
    """How often each term is among the stems of a word list; each distinct word of a batch is stemmed once."""
    place = {t: i for i, t in enumerate(terms)}

    @F.arrow_udf("array<int>")
    def counts(values: pa.Array) -> pa.Array:
        flat = values.flatten().dictionary_encode()
        out = np.zeros((len(values), len(terms)), np.int32)
        if len(flat):
            which = np.array([place.get(tx.stem(x), -1) for x in flat.dictionary.to_pylist()])
            term = which[flat.indices.to_numpy()]
            doc = np.repeat(np.arange(len(values)), values.value_lengths().fill_null(0).to_numpy())
            np.add.at(out, (doc[term >= 0], term[term >= 0]), 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(terms), dtype=np.int32)), pa.array(out.ravel()))

    return counts.asNondeterministic()(words)  # so that filters on counts don't run it once more a term


def index_report(entries: DataFrame, memories: DataFrame) -> DataFrame:
    """How many governed entries an index rebuild takes, and how many it skips for want of text."""
    rows = governed_entries(entries).select("id", "source_profile", "origin_memory_id").join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"], "left")
    filled = F.coalesce(F.length(F.trim("content")), F.lit(0)) > 0
    return rows.agg(F.count("*").alias("governed"), F.count_if(filled).alias("indexed"), F.count_if(~filled).alias("skipped"))


def bm25(entries: DataFrame, memories: DataFrame, query: str, limit: int = 10, profile: str | None = None, stem: bool = False) -> DataFrame:
    """Keyword channel: BM25 over any of the query's terms (k1 1.2, b 0.75, IDF at least 1e-6).

    For a search without an index: it reads all texts, twice; stemmed, only counts are
    joined with their entries; KeywordIndex answers from postings. Statistics are those of all texts; the best
    4 x limit are cut before the profile filter, so a profile may get fewer than limit.
    Underscores part terms, diacritics count unless stem is set. A limit of 0 or less gives
    nothing.
    """
    from attestry.operators.keyword_index import fold_one

    terms = [p for t in tx.match_terms(query) for p in (fold_one(t) if stem else t).split("_") if p]
    terms = list(dict.fromkeys(tx.stem(t) if stem else t for t in terms))
    rows = governed_entries(entries).select(F.col("id").alias("entry_id"), "source_profile", "origin_memory_id").join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"])
    rows = rows.where(F.length(F.trim("content")) > 0)
    if not terms or limit <= 0:
        return rows.where("false").select("entry_id", "source_profile", F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("rank"))
    if stem:
        from attestry.operators.keyword_index import words as folded

        # words are counted where the texts lie, and only counts meet the entries
        w = memories.where(F.length(F.trim("content")) > 0).select("source_profile", "origin_memory_id", folded(F.col("content")).alias("w"))
        counted = w.select("source_profile", "origin_memory_id", F.size("w").alias("dl"), stem_counts(F.col("w"), terms).alias("c"))
        own = governed_entries(entries).select(F.col("id").alias("entry_id"), "source_profile", "origin_memory_id")
        docs = own.join(counted, ["source_profile", "origin_memory_id"]).select("entry_id", "source_profile", "dl", *[F.col("c")[i].alias(f"t{i}") for i in range(len(terms))])
    else:
        # one pass of a regular expression finds the query's words alone; no array of all words is built
        low = F.lower("content")
        found = F.regexp_extract_all(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])({'|'.join(terms)})(?![\p{{L}}\p{{N}}])"), F.lit(1))
        # the generator is a fence: a filter pushed below it would run the expressions once more for each term
        split = rows.select("entry_id", "source_profile", F.explode(F.array(F.struct(F.regexp_count(low, F.lit(r"[\p{L}\p{N}]+")).alias("dl"), found.alias("w")))).alias("x"))
        docs = split.select("entry_id", "source_profile", "x.dl", *[times("x.w", t).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = docs.where(" or ".join(f"t{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(LEAST_IDF))
        tf = F.col(f"t{i}")
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    best = hits.select("entry_id", "source_profile", score.alias("score")).orderBy(F.desc("score"), "entry_id").limit(limit * 4)
    if profile is not None:
        best = best.where(F.col("source_profile") == profile)
    return ranked(best, limit=limit)


# ---- semantic -------------------------------------------------------------------------


def semantic(entries: DataFrame, vector, top_k: int = 10, profile: str | None = None) -> DataFrame:
    """Semantic channel: cosine to a query vector over usable vectors of governed entries, filtered before the cut."""
    q = vx.literal(vector)
    rows = governed_entries(entries, profile).where(vx.usable(F.col("embedding"), len(vector)))
    return ranked(rows.select(F.col("id").alias("entry_id"), "source_profile", vx.cosine(F.col("embedding"), q).alias("score")), limit=top_k)


def legacy_vector_search(entries: DataFrame, vector, top_k: int = 10) -> DataFrame:
    """Cosine over vectors of the query's length, zero ones included with score 0; a zero query lists zero vectors first, all by id."""
    size = len(vector)
    q = F.array(*[F.lit(float(x)).cast("float") for x in vector])
    rows = governed_entries(entries).where(F.size("embedding") == size).withColumn("n", vx.norm(F.col("embedding")))
    zero = not any(vector)
    score = F.lit(0.0) if zero else F.when(F.col("n") > 0, vx.dot(F.col("embedding"), q) / (F.col("n") * vx.norm(q))).otherwise(0.0)
    rows = rows.select(F.col("id").alias("entry_id"), "source_profile", score.alias("score"), (F.col("n") > 0).cast("int").alias("filled"))
    order = (F.asc("filled"), F.asc("entry_id")) if zero else (F.desc("score"), F.asc("entry_id"))
    return ranked(rows, *order, limit=top_k).drop("filled")


# ---- time -----------------------------------------------------------------------------


def event_window(entries: DataFrame, memories: DataFrame, first: str, last: str, limit: int = 50, profile: str | None = None) -> DataFrame:
    """Temporal channel by event date: governed entries whose memory has a date of day precision from first to last inclusive."""
    rows = governed_entries(entries, profile).select(F.col("id").alias("entry_id"), "source_profile", "origin_memory_id").join(memories, ["source_profile", "origin_memory_id"])
    day = F.col("event_date").cast("string").try_cast("date")
    rows = rows.where(F.col("event_date_precision") == "day").withColumn("event_date", day).where(F.col("event_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return ranked(rows.select("entry_id", "source_profile", "event_date", F.lit(1.0).alias("score")), F.asc("event_date"), F.asc("entry_id"), limit=limit)


def recency(entries: DataFrame, memories: DataFrame, reference: str, limit: int = 50, profile: str | None = None) -> DataFrame:
    """Temporal channel by age at a stated time: 1/(1 + days), times to come count as now; the newest id of equal ones first."""
    rows = governed_entries(entries, profile).select(F.col("id").alias("entry_id"), "source_profile", "origin_memory_id").join(memories, ["source_profile", "origin_memory_id"])
    times = [F.col(c).cast("string").try_cast("timestamp_ntz") for c in ("timestamp", "created_at") if c in memories.columns]
    rows = rows.withColumn("at", F.coalesce(*times)).where("at is not null")
    age = (F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 86_400_000_000
    scored = rows.select("entry_id", "source_profile", "at", (1 / (1 + F.greatest(age, F.lit(0.0)))).alias("score"))
    return ranked(scored, F.desc("score"), F.desc("at"), F.desc("entry_id"), limit=limit)


# ---- entities -------------------------------------------------------------------------


def entity_channel(entries: DataFrame, entities: DataFrame, resolutions: DataFrame, mentions: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Entries that mention the active entity whose normalized name the whole query is, by settled resolutions only."""
    named = entities.where("status = 'active'").select("entity_id", tx.entity_key(F.col("canonical_name")).alias("key"))
    found = named.where(F.col("key") == F.lit(tx.name_key(query))).select("entity_id")
    settled = resolutions.where("decision = 'same_entity'").select(F.col("proposed_entity_id").alias("entity_id"), "mention_id")
    m = mentions.select("mention_id", F.col("collective_entry_id").alias("entry_id"), "source_profile", "source_memory_id")
    rows = found.join(settled, "entity_id").join(m, "mention_id")
    gov = governed_entries(entries).select(F.col("id").alias("entry_id"), "source_profile")
    rows = rows.join(gov, ["entry_id", "source_profile"], "left_semi").select("entry_id", "source_profile", "source_memory_id").distinct()
    return ranked(rows.withColumn("score", F.lit(1.0)), F.desc("score"), F.asc("entry_id"), F.asc("source_profile"), F.asc("source_memory_id"), limit=limit)


# ---- fusion ---------------------------------------------------------------------------


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in channels.items():
        part = rows.select(F.lit(name).alias("channel"), "entry_id", F.col("score").cast("double").alias("score"), "rank")
        out = part if out is None else out.union(part)
    return out


def candidates(channels: DataFrame, limit: int, order: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The first limit entries in channel order, then rank; of an entry's places the first counts."""
    position = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])[F.col("channel")]
    first = channels.groupBy("entry_id").agg(F.min(F.struct(position.alias("channel_order"), "rank")).alias("p"))
    return ranked(first.select("entry_id", "p.channel_order", F.col("p.rank").alias("place")), F.asc("channel_order"), F.asc("place"), F.asc("entry_id"), limit=limit).drop("place")


def fuse(channels: DataFrame, universe: DataFrame | None = None, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (k + rank) over channels.

    Ranks are taken anew inside the universe of candidates; a channel lists an entry once,
    at its best place. Columns <channel>_rank and <channel>_contribution are 0 or null
    where a channel has no part in an entry.
    """
    weights = weights or {}
    rows = channels.groupBy("channel", "entry_id").agg(F.min("rank").alias("rank"))
    if universe is not None:
        rows = rows.join(universe.select("entry_id"), "entry_id", "left_semi")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("channel").orderBy("rank", "entry_id")).cast("long"))
    weight = F.create_map(*[x for c in CHANNELS for x in (F.lit(c), F.lit(float(weights.get(c, 1.0))))])[F.col("channel")]
    rows = rows.withColumn("contribution", weight / (k + F.col("rank")))
    each = [e for c in CHANNELS for e in (
        F.max(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank"), F.coalesce(F.max(F.when(F.col("channel") == c, F.col("contribution"))), F.lit(0.0)).alias(f"{c}_contribution"),
    )]
    fused = rows.groupBy("entry_id").agg(*each)
    fused = fused.withColumn("fused_score", sum((F.col(f"{c}_contribution") for c in CHANNELS), F.lit(0.0)))
    return fused.withColumn("fused_rank", F.row_number().over(W.orderBy(F.desc("fused_score"), "entry_id")).cast("long"))


def lexical_score(query: str) -> Callable[[Column], Column]:
    """A reranker that needs no model: the share of the query's terms that a text holds."""
    terms = list(dict.fromkeys(p for t in tx.match_terms(query) for p in t.split("_") if p))

    def score(content: Column) -> Column:
        held = words(content)
        return sum((F.array_contains(held, t).cast("double") for t in terms), F.lit(0.0)) / max(1, len(terms))

    return score


def rerank(fused: DataFrame, contents: DataFrame, scorer: Callable[[Column], Column], candidate_limit: int = 20, top_k: int = 10) -> DataFrame:
    """The first candidate_limit fused entries scored by content and cut to top_k, with the change of rank.

    Blank or missing contents and scores that aren't finite raise.
    """
    bounded = fused.orderBy("fused_rank").limit(candidate_limit).join(contents.select("entry_id", "content"), "entry_id", "left")
    checked = F.when(F.coalesce(F.length(F.trim("content")), F.lit(0)) == 0, F.raise_error(F.lit("candidate without content"))).otherwise(F.col("content"))
    scored = bounded.withColumn("reranker_score", scorer(checked).cast("double"))
    sound = F.when(F.isnan("reranker_score") | (F.abs("reranker_score") == float("inf")), F.raise_error(F.lit("score is not finite"))).otherwise(F.col("reranker_score"))
    scored = scored.withColumn("reranker_score", sound)
    scored = scored.withColumn("reranker_rank", F.row_number().over(W.orderBy(F.desc("reranker_score"), "entry_id")).cast("long")).where(F.col("reranker_rank") <= top_k)
    return scored.select("entry_id", "fused_score", "fused_rank", "reranker_score", "reranker_rank", (F.col("fused_rank") - F.col("reranker_rank")).alias("rank_change"))


def model_scorer(predict: Callable, query: str) -> Callable[[Column], Column]:
    """A reranker from predict(pairs) -> scores, run in Arrow batches."""

    def score(content: Column) -> Column:
        @F.arrow_udf("double")
        def run(values: pa.Array) -> pa.Array:
            return pa.array([float(x) for x in predict([(query, t) for t in values.to_pylist()])], pa.float64())

        return run(content)

    return score


def with_provenance(results: DataFrame, provenance: DataFrame) -> DataFrame:
    """results with a sorted provenance array; empty where none is recorded."""
    listed = provenance.dropDuplicates(["entry_id", "source_profile", "origin_memory_id"]).groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("source_profile", "origin_memory_id", "created_at"))).alias("provenance"))
    empty = F.array().cast("array<struct<source_profile:string,origin_memory_id:string,created_at:string>>")
    return results.join(listed, "entry_id", "left").withColumn("provenance", F.coalesce("provenance", empty))


def temporal_context(results: DataFrame, channel: DataFrame | None, source: str = "event_date") -> DataFrame:
    """results with temporal_relevant, temporal_score and date_source (source: event_date, or timestamp for recency); entries outside the channel aren't relevant."""
    if channel is None:
        return results.withColumns({"temporal_relevant": F.lit(False), "temporal_score": F.lit(0.0), "date_source": F.lit("unknown")})
    side = channel.select("entry_id", F.col("score").alias("__t"))
    return results.join(side, "entry_id", "left").select(
        *results.columns, F.col("__t").isNotNull().alias("temporal_relevant"), F.coalesce("__t", F.lit(0.0)).alias("temporal_score"), F.when(F.col("__t").isNotNull(), source).otherwise("unknown").alias("date_source")
    )


def evidence_signal(evidence: DataFrame) -> DataFrame:
    """Per entry: evidence, observed and inferred, mean confidence, quality = (observed share + mean confidence) / 2."""
    out = evidence.groupBy("entry_id").agg(
        F.count("*").alias("evidence_count"), F.count_if(F.col("evidence_kind") == "observed").alias("observed_count"), F.count_if(F.col("evidence_kind") == "inferred").alias("inferred_count"), F.avg("confidence").alias("average_confidence")
    )
    return out.withColumn("quality", 0.5 * F.col("observed_count") / F.col("evidence_count") + 0.5 * F.coalesce("average_confidence", F.lit(0.0)))


def admission(intent: str) -> tuple[str, ...]:
    """Channels in the order in which their results become candidates: those of the intent's route, then entity and temporal ones."""
    asked = {c for r in tx.ROUTES[intent] for c in ADMITTED[r]}
    first = [c for c in ("keyword", "semantic", "temporal", "entity", "graph") if c in asked]
    return (*first, *(c for c in ("entity", "temporal") if c not in asked))


def hybrid(
    entries: DataFrame, memories: DataFrame, query: str, vector=None, limit: int = 10, candidate_limit: int = 40, profile: str | None = None,
    window: tuple[str, str] | None = None, reference: str | None = None, edges: DataFrame | Callable[[DataFrame], DataFrame] | None = None, entity: DataFrame | None = None, weights: dict[str, float] | None = None, k: int = 60, index=None,
    keyword_limit: int | None = None, semantic_limit: int | None = None, temporal_limit: int | None = None, seed_limit: int = 5, limit_per_seed: int = 4, route: str | None = None,
) -> DataFrame:
    """The whole retrieval: channels, bounded candidates, fusion, temporal context, top limit.

    Keyword, semantic (where a vector is given and the script allows it) and graph (where
    edges are given) always take part; event date or recency by request, entities where their
    channel is given. Candidates are admitted in the channel order of the route (an intent, by
    default semantic), then entity and temporal ones while room remains. The channels run
    when this is called, once, and leave a few hundred rows. An empty query has no keyword
    hits; a recency search needs a reference time. Keywords are looked up in an index
    (KeywordIndex) where one is given, else in the texts. edges are a graph, or a function
    that gives the edges of seeds(entry_id).
    """
    from attestry.operators.graph import expand

    if not 1 <= limit <= 100 or not 1 <= candidate_limit <= 100 or limit > 50 and limit != candidate_limit:
        raise ValueError("limit must be 1 to 50 and candidate_limit 1 to 100")
    if not query.strip():
        return fuse(entries.sparkSession.createDataFrame([], "channel string, entry_id long, rank long")).transform(temporal_context, None)
    keyword_limit, semantic_limit = keyword_limit or candidate_limit, semantic_limit or candidate_limit
    keyword = index.search(query, keyword_limit, profile, entries) if index is not None else bm25(entries, memories, query, keyword_limit, profile)
    channels = {"keyword": keyword}
    if vector is not None:
        channels["semantic"] = semantic(entries, vector, semantic_limit, profile)
    if edges is not None:
        early = union_channels(channels)
        early = early.sparkSession.createDataFrame(early.collect(), early.schema)  # at most keyword_limit and semantic_limit rows
        channels = {c: early.where(F.col("channel") == c) for c in channels}
        seeds = candidates(early, seed_limit, ("keyword", "semantic")).select("entry_id", F.col("rank").alias("seed_pos"))
        channels["graph"] = expand(seeds, edges(seeds) if callable(edges) else edges, entries, limit_per_seed, profile)
    temporal = None
    if window is not None:
        temporal = channels["temporal"] = event_window(entries, memories, *window, limit=temporal_limit or candidate_limit, profile=profile)
    elif reference is not None:
        temporal = channels["temporal"] = recency(entries, memories, reference, temporal_limit or candidate_limit, profile)
    if entity is not None:
        channels["entity"] = entity
    listed = union_channels(channels)
    listed = listed.sparkSession.createDataFrame(listed.collect(), listed.schema)  # at most candidate_limit rows a channel, needed twice below
    universe = candidates(listed, candidate_limit, admission(route or "semantic"))
    fused = fuse(listed, universe, k, weights).where(F.col("fused_rank") <= limit)
    fused = fused.sparkSession.createDataFrame(fused.collect(), fused.schema)  # at most candidate_limit rows
    return temporal_context(fused, None if temporal is None else listed.where("channel = 'temporal'"), "event_date" if window is not None else "timestamp")


def search(
    entries: DataFrame, memories: DataFrame, query: str, vector=None, limit: int = 10, rerank_with: Callable[[Column], Column] | None = None,
    provenance: DataFrame | None = None, evidence: DataFrame | None = None, route: bool = True, **options,
) -> DataFrame:
    """The whole answer to a query: routed channels, fusion, reranking, provenance, evidence and an explanation.

    Every channel that is given runs; with route, the query's intent says in which order their
    results become candidates. A query in a script that vectors don't support has no semantic
    channel. The first candidate_limit fused results are reranked and cut to limit; without a
    reranker the fused order stays. rank is the place in the answer. Provenance is an array,
    evidence the signal of evidence_signal(); absent where unasked. A blank query gives nothing.
    """
    if not tx.latin_only(query):
        vector = None
    most = options.get("candidate_limit", 20)
    options = {"candidate_limit": 20, "keyword_limit": 20, "semantic_limit": 20, "route": tx.intent_of(query) if route else None, **options}
    if limit > 50:
        raise ValueError("limit must be 1 to 50")
    wide = most if rerank_with is not None else limit
    fused = hybrid(entries, memories, query, vector, wide, **options)
    out = fused.join(explain(fused).select("entry_id", "channels", "main_channel"), "entry_id")
    if rerank_with is None:
        out = out.withColumns({"reranker_score": F.lit(None).cast("double"), "rank": F.col("fused_rank")})
    else:
        keys = ["source_profile", "origin_memory_id"]
        found = governed_entries(entries).select(F.col("id").alias("entry_id"), *keys).join(F.broadcast(fused.select("entry_id")), "entry_id", "left_semi")
        contents = found.join(memories.select(*keys, "content"), keys).select("entry_id", "content")
        placed = rerank(fused, contents, rerank_with, most, limit).select("entry_id", "reranker_score", F.col("reranker_rank").alias("rank"))
        out = out.join(placed, "entry_id")
    if provenance is not None:
        out = with_provenance(out, provenance.join(F.broadcast(fused.select("entry_id")), "entry_id", "left_semi"))
    if evidence is not None:
        out = out.join(evidence_signal(evidence.join(F.broadcast(fused.select("entry_id")), "entry_id", "left_semi")), "entry_id", "left")
    return out


def diagnostics(channels: DataFrame, results: DataFrame) -> DataFrame:
    """Per channel: the entries it listed, those it gave to the results and its share of their fused score."""
    listed = channels.groupBy("channel").agg(F.countDistinct("entry_id").alias("listed"))
    parts = results.select("fused_score", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_rank").alias("place"), F.col(f"{c}_contribution").alias("part")) for c in CHANNELS])).alias("p"))
    used = parts.groupBy("p.channel").agg(F.count("p.place").alias("given"), (F.sum("p.part") / F.sum("fused_score")).alias("share"))
    return listed.join(used, "channel", "left")


def explain(results: DataFrame) -> DataFrame:
    """How each channel took part: channels with a rank and the one that gave most."""
    parts = F.array(*[F.struct(F.col(f"{c}_contribution").alias("part"), F.lit(-i).alias("o"), F.lit(c).alias("channel")) for i, c in enumerate(CHANNELS)])
    named = F.filter(F.array(*[F.when(F.col(f"{c}_rank").isNotNull(), F.lit(c)) for c in CHANNELS]), lambda x: x.isNotNull())
    return results.select("entry_id", "fused_rank", "fused_score", named.alias("channels"), F.array_max(parts)["channel"].alias("main_channel"))


def retrieval_metrics(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision@k over what was retrieved within k, recall@k over what is relevant, reciprocal rank over all."""
    flagged = results.join(relevant.select("query_id", "entry_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "entry_id"], "left")
    per = flagged.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("retrieved"), F.count_if((F.col("rank") <= k) & F.col("hit")).alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first")
    )
    wanted = relevant.select("query_id", "entry_id").distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = wanted.join(per, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return out.select(
        "query_id", F.when(F.col("retrieved") > 0, hits / F.col("retrieved")).otherwise(0.0).alias("precision"), (hits / F.col("relevant")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank")
    )


def macro_average(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"mean_{c}") for c in ("precision", "recall", "reciprocal_rank")])
