"""Entity mentions, resolution, relationships and the entity graph."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.operators.governance import governed_entries
from attestry.sources.store import Store, arrow_batches, few

NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
METHOD = "deterministic-v1"
#: Technologies by pattern; a caller passes its own (fixed values).
TECHNOLOGIES = (
    "Python", "SQLite", "FastAPI", "Uvicorn", "OpenCV", "Linux", "Ubuntu", "Git", "Forgejo",
    "BM25", "RRF", "FTS5", "NLP", "API", "HTTP", "JSON", "SQL",
    r"GPT-\d+(?:\.\d+)?", r"Qwen\d*", "Devstral",
)
#: Words that a project's name doesn't hold (fixed values).
NOISE = frozenset(("all", "current", "local", "location", "repository", "state", "the"))
#: A project's name after and before a word that marks it (fixed values).
PROJECT_AFTER = re.compile(r"\b(?:project|repository|application|codebase)\s+(?:named\s+|called\s+)?([A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*){1,5})")
PROJECT_BEFORE = re.compile(r"\b([A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*){1,5})\s+(?:project|repository|application|codebase)\b")
#: Predicates with their patterns and confidence (fixed values).
PREDICATES = (
    ("uses", r"\b(?:uses|use|using|utilizes|utilises)\b", 0.95), ("contains", r"\b(?:contains|contain)\b", 0.95), ("part_of", r"\b(?:is\s+)?(?:a\s+)?part\s+of\b", 0.95),
    ("depends_on", r"\b(?:depends\s+on|depend\s+on)\b", 0.95), ("created_by", r"\b(?:was\s+)?created\s+by\b", 0.95), ("maintained_by", r"\b(?:is\s+)?maintained\s+by\b", 0.95),
    ("associated_with", r"\b(?:is\s+)?associated\s+with\b", 0.90), ("related_to", r"\b(?:is\s+)?related\s+to\b", 0.90), ("derived_from", r"\b(?:is\s+)?derived\s+from\b", 0.90),
    ("has_profile", r"\b(?:has|have)\s+(?:a\s+)?profile\b", 0.90), ("mentions", r"\b(?:mentions|mention)\b", 0.85),
)
#: Words of conjecture (fixed values).
CUES = (
    r"suggests?", "suggesting", r"implies?", "implying", r"indicates?", "indicating", r"appears?\s+to", r"seems?\s+to",
    "probably", "possibly", "perhaps", "likely", "may", "might", "could",
)
_CUES = re.compile(rf"\b(?:{'|'.join(CUES)})\b", re.I)
_PATTERNS = tuple((p, re.compile(x, re.I), c) for p, x, c in PREDICATES)
_MENTION = "array<struct<mention_text:string,entity_type:string,confidence:double>>"
_RELATION = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"


def find_mentions(text: str | None, technologies: tuple[str, ...] = TECHNOLOGIES) -> list[tuple[str, str, float]]:
    """Technologies by name and projects by a marker word beside a capitalized name of two words or more; one each, sorted."""
    if not text or not text.strip():
        return []
    found: dict[tuple[str, str], tuple[str, str, float]] = {}

    def add(name: str, kind: str, confidence: float) -> None:
        name = " ".join(name.split())
        if name:
            found.setdefault((name.casefold(), kind), (name, kind, confidence))

    if technologies:
        for m in re.finditer(rf"\b(?:{'|'.join(technologies)})\b", text, re.I):
            add(m[0], "technology", 0.95)
    for name in PROJECT_AFTER.findall(text) + PROJECT_BEFORE.findall(text):
        name = re.sub(r"^(?:the|a|an)\s+", "", " ".join(name.split()), flags=re.I)
        parts = {w.casefold() for w in name.split()}
        if len(name.split()) >= 2 and not parts & NOISE:
            add(name, "project", 0.90)
    return sorted(found.values(), key=lambda x: (x[0].casefold(), x[1]))


def find_relationships(text: str | None, names: list[str] | None) -> list[tuple[str, str, str, float]]:
    """Relations said outright: two known names in one sentence with a predicate between, at most four words on either side of it.

    A word of conjecture earlier in the sentence suppresses it.
    """
    if not text or not names or len(set(n.casefold() for n in names)) < 2:
        return []
    names = sorted({" ".join(n.strip(" .,;:!?").split()) for n in names} - {""})
    spans = {n: [m.span() for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text, re.I)] for n in names}
    out = set()
    for subject in names:
        for a, end in spans[subject]:
            start = max(text.rfind(c, 0, a) for c in ".!?;") + 1
            if _CUES.search(text, start, a):
                continue
            for other in names:
                if other.casefold() == subject.casefold():
                    continue
                for b, _ in spans[other]:
                    between = text[end:b] if b > end else ""
                    if not between or re.search(r"[.!?;]", between):
                        continue
                    for predicate, pattern, confidence in _PATTERNS:
                        m = pattern.search(between)
                        if m and len(between[: m.start()].split()) <= 4 and len(between[m.end() :].split()) <= 4:
                            out.add((subject, predicate, other, confidence))
    return sorted(out, key=lambda x: (x[0].casefold(), x[1], x[2].casefold()))


_MENTION_ARROW = pa.list_(pa.struct([("mention_text", pa.string()), ("entity_type", pa.string()), ("confidence", pa.float64())]))
_RELATION_ARROW = pa.list_(pa.struct([("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("confidence", pa.float64())]))


# these functions are marked as not deterministic only so that no filter inferred from explode() runs them once more below a join


def _mentioned(found: list[tuple]) -> list[dict]:
    return [dict(zip(("mention_text", "entity_type", "confidence"), m)) for m in found]


def _related(found: list[tuple]) -> list[dict]:
    return [dict(zip(("subject", "predicate", "object", "confidence"), r)) for r in found]


def mention_column(text: Column, technologies: tuple[str, ...] = TECHNOLOGIES) -> Column:
    """find_mentions() of a column; a text that comes again in a batch is read once."""

    @F.arrow_udf(_MENTION)
    def mentions(values: pa.Array) -> pa.Array:
        each = values.dictionary_encode("encode")
        return pa.array([_mentioned(find_mentions(t, technologies)) for t in each.dictionary.to_pylist()], _MENTION_ARROW).take(each.indices)

    return mentions.asNondeterministic()(text)


def relationship_column(text: Column, names: Column) -> Column:
    @F.arrow_udf(_RELATION)
    def relations(values: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([_related(find_relationships(t, n)) for t, n in zip(values.to_pylist(), lists.to_pylist())], _RELATION_ARROW)

    return relations.asNondeterministic()(text, names)


def reading_column(text: Column, technologies: tuple[str, ...] = TECHNOLOGIES) -> Column:
    """(mentions, relations) of a text, the relations those between its own mentions; a text that comes again in a batch is read once."""

    @F.arrow_udf(f"struct<mentions:{_MENTION},relations:{_RELATION}>")
    def read(values: pa.Array) -> pa.Array:
        each = values.dictionary_encode("encode")
        texts = each.dictionary.to_pylist()
        found = [find_mentions(t, technologies) for t in texts]
        said = [find_relationships(t, [m[0] for m in f]) for t, f in zip(texts, found)]
        columns = [pa.array(map(_mentioned, found), _MENTION_ARROW), pa.array(map(_related, said), _RELATION_ARROW)]
        return pa.StructArray.from_arrays(columns, ["mentions", "relations"]).take(each.indices)

    return read.asNondeterministic()(text)


def read_texts(entries: DataFrame, memories: DataFrame, technologies: tuple[str, ...] = TECHNOLOGIES) -> DataFrame:
    """One row a governed entry and text of its memory, with the mentions and the relations of that text."""
    rows = governed_entries(entries).join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"])
    read = reading_column(F.col("content"), technologies).alias("read")
    return rows.select(F.col("id").alias("collective_entry_id"), "source_profile", F.col("origin_memory_id").alias("source_memory_id"), read).select("collective_entry_id", "source_profile", "source_memory_id", "read.*")


#: What a mention's id is made of, and the same id as SQL.
MENTION_KEY = ("collective_entry_id", "source_memory_id", "source_profile", "mention_text", "entity_type", "extraction_method")
_HASHED = f"sha1(concat(unhex('{NAMESPACE}'), cast(concat_ws('|', cast(collective_entry_id as string), {', '.join(MENTION_KEY[1:])}) as binary)))"
MENTION_ID = (
    f"transform(array({_HASHED}), h -> concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), concat('5', substring(h, 14, 3)), "
    "concat(substring('89ab', cast(conv(substring(h, 17, 1), 16, 10) as int) % 4 + 1, 1), substring(h, 18, 3)), substring(h, 21, 12)))[0] as mention_id"
)


def _with_ids(each: DataFrame) -> DataFrame:
    """Mentions with name-based ids."""
    out = each.select("collective_entry_id", "source_profile", "source_memory_id", "m.*", F.lit(METHOD).alias("extraction_method"))
    key = F.concat_ws("|", F.col("collective_entry_id").cast("string"), *MENTION_KEY[1:])
    return out.withColumn("mention_id", tx.uuid5(NAMESPACE, key))


def extract_mentions(entries: DataFrame, memories: DataFrame, technologies: tuple[str, ...] = TECHNOLOGIES, read: DataFrame | None = None) -> DataFrame:
    """Mentions of governed entries with name-based ids; from read, where read_texts() of them was kept."""
    if read is None:
        rows = governed_entries(entries).join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"])
        read = rows.select(F.col("id").alias("collective_entry_id"), "source_profile", F.col("origin_memory_id").alias("source_memory_id"), mention_column(F.col("content"), technologies).alias("mentions"))
    return _with_ids(read.select("collective_entry_id", "source_profile", "source_memory_id", F.explode("mentions").alias("m")))


def entity_keys(entities: DataFrame) -> DataFrame:
    """(entity_type, key) of active entities, how many have it and the smallest."""
    return entities.where("status = 'active'").groupBy("entity_type", tx.entity_key(F.col("canonical_name")).alias("key")).agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))


def _decided(mentions: DataFrame, keys: DataFrame, ids: tuple[str, ...] = ("mention_id",)) -> DataFrame:
    rows = mentions.withColumn("key", tx.entity_key(F.col("mention_text"))).join(keys, ["entity_type", "key"], "left")
    decision = F.when(F.col("n") == 1, "same_entity").when(F.col("n") > 1, "ambiguous").otherwise("new_entity")
    return rows.select(
        *ids, F.when(F.col("n") == 1, F.col("entity_id")).alias("proposed_entity_id"), decision.alias("decision"), F.when(F.col("n") > 1, 0.0).otherwise(1.0).alias("confidence"), F.lit("exact_normalized_name").alias("method")
    )


def _settled(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """Mentions with the one entity of their name, told by the name and not by a join of ids."""
    return mentions.withColumn("key", tx.entity_key(F.col("mention_text"))).join(keys.where("n = 1").drop("n"), ["entity_type", "key"]).drop("key")


def resolve(mentions: DataFrame, entities: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One decision a mention by (type, normalized name): one active entity same_entity 1, several ambiguous 0, none new_entity 1; decided mentions keep theirs."""
    out = _decided(mentions, entity_keys(entities))
    if existing is None:
        return out
    return out.join(existing.select("mention_id"), "mention_id", "left_anti").union(existing.select(*out.columns))


def bootstrap(mentions: DataFrame) -> DataFrame:
    """Entities from mentions alone: the first mention of a (type, key) in (entry, text) order names it. A hot name costs one row a task."""
    keyed = mentions.withColumn("key", tx.entity_key(F.col("mention_text"))).where("key <> ''")
    first = keyed.groupBy("entity_type", "key").agg(F.min(F.struct("collective_entry_id", "mention_text", "mention_id")).alias("f"), F.count("*").alias("mention_count"))
    entity_id = tx.uuid5(NAMESPACE, F.concat_ws("|", F.lit("entity"), "entity_type", "key"))
    return first.select(entity_id.alias("entity_id"), F.col("f.mention_text").alias("canonical_name"), "entity_type", F.lit("active").alias("status"), F.col("f.mention_id").alias("first_mention_id"), "mention_count")


#: What tells two rows of evidence apart.
EVIDENCE_KEY = ["entity_id", "collective_entry_id", "source_memory_id", "source_profile", "original_mention", "method"]
TOLD_KEY = ["relationship_id", "collective_entry_id", "source_memory_id", "source_profile", "evidence_reference", "method"]


def entity_evidence(mentions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """One row per settled (entity, entry, memory, profile, mention, method); never content."""
    settled = resolutions.where("decision = 'same_entity'").select("mention_id", F.col("proposed_entity_id").alias("entity_id"))
    return _evidence(mentions.join(settled, "mention_id")).dropDuplicates(EVIDENCE_KEY)


def _evidence(settled: DataFrame) -> DataFrame:
    return settled.select("entity_id", "collective_entry_id", "source_memory_id", "source_profile", F.col("mention_text").alias("original_mention"), F.col("extraction_method").alias("method"), "confidence")


def extract_relationships(entries: DataFrame, memories: DataFrame, mentions: DataFrame) -> DataFrame:
    """Relations said in governed entries between their own mentions."""
    names = mentions.groupBy(F.col("collective_entry_id").alias("id")).agg(F.sort_array(F.collect_set("mention_text")).alias("names")).where(F.size("names") > 1)
    rows = governed_entries(entries).join(names, "id").join(memories.select("source_profile", "origin_memory_id", "content"), ["source_profile", "origin_memory_id"])
    each = rows.select(F.col("id").alias("collective_entry_id"), "source_profile", F.col("origin_memory_id").alias("source_memory_id"), F.explode(relationship_column(F.col("content"), F.col("names"))).alias("r"))
    return each.select("collective_entry_id", "source_profile", "source_memory_id", "r.*").withColumn("relationship_kind", F.lit("explicit"))


def several_texts(entries: DataFrame, memories: DataFrame) -> DataFrame:
    """(collective_entry_id) of governed entries that come in several rows or whose memory does, by keys alone."""
    own = governed_entries(entries).select(F.col("id").alias("collective_entry_id"), "source_profile", "origin_memory_id")
    rows = own.groupBy("collective_entry_id").agg(F.count("*").alias("n")).where("n > 1").select("collective_entry_id")
    keys = memories.groupBy("source_profile", "origin_memory_id").agg(F.count("*").alias("n")).where("n > 1").select("source_profile", "origin_memory_id")
    return rows.union(own.join(few(keys), ["source_profile", "origin_memory_id"], "left_semi").select("collective_entry_id")).distinct()


def _spread(read: DataFrame) -> DataFrame:
    each = read.select("collective_entry_id", "source_profile", "source_memory_id", F.explode("relations").alias("r"))
    return each.select("collective_entry_id", "source_profile", "source_memory_id", "r.*").withColumn("relationship_kind", F.lit("explicit"))


def said_in_texts(entries: DataFrame, memories: DataFrame, technologies: tuple[str, ...] = TECHNOLOGIES) -> DataFrame:
    """extract_relationships() between the mentions that extract_mentions() finds, in one pass over the texts.

    An entry with one text has the names of that text, so they are found and related at once;
    only the texts of other entries are sent to the names of all of them.
    """
    many = several_texts(entries, memories)
    if many.isEmpty():
        return _spread(read_texts(entries, memories, technologies))
    many = few(many)
    one, other = (entries.join(many.withColumnRenamed("collective_entry_id", "id"), "id", how) for how in ("left_anti", "left_semi"))
    crowd = extract_relationships(other, memories, extract_mentions(other, memories, technologies))
    return _spread(read_texts(one, memories, technologies)).unionByName(crowd)


def record_relationships(found: DataFrame, mentions: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships, relationship_evidence): both ends must be settled as one entity; ids are by name, so recording again changes nothing."""
    rows = _between(found, mentions, resolutions)
    return _relationships(rows), _told(rows).dropDuplicates(TOLD_KEY)


def _between(found: DataFrame, mentions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """found with the settled entities of both ends."""
    settled = mentions.join(resolutions.where("decision = 'same_entity'").select("mention_id", "proposed_entity_id"), "mention_id").select(
        "collective_entry_id", F.lower("mention_text").alias("k"), F.col("proposed_entity_id").alias("e")
    ).distinct()
    s = settled.select("collective_entry_id", F.col("k").alias("sk"), F.col("e").alias("subject_entity_id"))
    o = settled.select("collective_entry_id", F.col("k").alias("ok"), F.col("e").alias("object_entity_id"))
    rows = found.withColumns({"sk": F.lower("subject"), "ok": F.lower("object")}).join(s, ["collective_entry_id", "sk"]).join(o, ["collective_entry_id", "ok"])
    return _identified(rows.drop("sk", "ok"))


def _named(read: DataFrame, keys: DataFrame) -> DataFrame:
    """_between() of entries with one text: both ends are mentions of their own row."""
    rows = read.select("collective_entry_id", "source_profile", "source_memory_id", "mentions", F.explode("relations").alias("r")).select("*", "r.*").drop("r").withColumn("relationship_kind", F.lit("explicit"))
    for end in ("subject", "object"):
        rows = rows.withColumn("m", F.explode(F.expr(f"filter(mentions, x -> lower(x.mention_text) = lower({end}))")))
        rows = rows.withColumns({"entity_type": F.col("m.entity_type"), "key": tx.entity_key(F.col("m.mention_text"))}).join(keys.where("n = 1").select("entity_type", "key", F.col("entity_id").alias(f"{end}_entity_id")), ["entity_type", "key"]).drop("m", "entity_type", "key")
    return _identified(rows.drop("mentions"))


def _identified(rows: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.lit("relationship"), "subject_entity_id", "predicate", "object_entity_id", "relationship_kind")
    return rows.withColumn("relationship_id", tx.uuid5(NAMESPACE, key))


def _relationships(rows: DataFrame) -> DataFrame:
    return rows.groupBy("relationship_id", "subject_entity_id", "predicate", "object_entity_id", "relationship_kind").agg(F.max("confidence").alias("confidence")).withColumn("status", F.lit("active"))


def _told(rows: DataFrame) -> DataFrame:
    return rows.select("relationship_id", "collective_entry_id", "source_memory_id", "source_profile", F.concat_ws(" ", "subject", "predicate", "object").alias("evidence_reference"), F.lit(METHOD).alias("method"), "confidence")


def rebuild(entries: DataFrame, memories: DataFrame, technologies: tuple[str, ...] = TECHNOLOGIES) -> dict[str, DataFrame]:
    """All derived tables anew: mentions, entities, resolutions, entity evidence, relationships, relationship evidence."""
    mentions = extract_mentions(entries, memories, technologies)
    entities = bootstrap(mentions)
    resolutions = resolve(mentions, entities)
    relationships, relationship_evidence = record_relationships(extract_relationships(entries, memories, mentions), mentions, resolutions)
    return {
        "mentions": mentions, "entities": entities, "resolutions": resolutions, "entity_evidence": entity_evidence(mentions, resolutions), "relationships": relationships, "relationship_evidence": relationship_evidence,
    }


def mixed_sources(mentions: DataFrame) -> DataFrame:
    """(collective_entry_id, error) of entries whose mentions name several profiles or memories; nothing is said of their relations."""
    one = mentions.groupBy("collective_entry_id").agg(*[F.min(c).alias(f"{c}_a") for c in ("source_profile", "source_memory_id")], *[F.max(c).alias(f"{c}_b") for c in ("source_profile", "source_memory_id")])
    apart = ~F.col("source_profile_a").eqNullSafe(F.col("source_profile_b")) | ~F.col("source_memory_id_a").eqNullSafe(F.col("source_memory_id_b"))
    return one.where(apart).select("collective_entry_id", F.lit("mentions of one entry have mixed sources").alias("error"))


#: What a rebuild leaves in its store.
REBUILT = ("mentions", "entities", "resolutions", "entity_evidence", "relationships", "relationship_evidence", "failures", "report")


def rebuild_into(store: Store, entries: DataFrame, memories: DataFrame, technologies: tuple[str, ...] = TECHNOLOGIES) -> int:
    """All tables of REBUILT anew, as one version of a store; returns its number.

    Texts are read and extracted once: every later table comes from those written before it.
    Until the commit, and so after a crash at any step, readers have the version before. The
    report is one row of counts; an entry with mixed sources fails and has no relations.
    """
    change = store.begin()
    own, most = ["collective_entry_id", "source_profile", "source_memory_id"], 1_000_000
    with arrow_batches(store.spark):
        read = change.replace("read", read_texts(entries, memories, technologies))
        found = extract_mentions(entries, memories, technologies, read)
        # ids are hashes that don't compress, nine tenths of both tables if they were written: readers make them of the columns they are made of
        change.shown["mentions"] = [MENTION_ID if c == "mention_id" else c for c in found.columns]
        mentions = change.replace("mentions", found.drop("mention_id"))
        entities = change.replace("entities", bootstrap(mentions))
        keys = few(entity_keys(entities))
        change.shown["resolutions"] = [MENTION_ID, "proposed_entity_id", "decision", "confidence", "method"]
        resolutions = change.replace("resolutions", _decided(mentions, keys, MENTION_KEY))
        # an entry with one text has each mention and relation once: only rows of the others are marked, and sent to be told apart
        several = change.replace("several", read.groupBy("collective_entry_id").agg(F.count("*").alias("n")).where("n > 1").select("collective_entry_id"))
        marked = read.join(few(several.withColumn("many", F.lit(True)), most), "collective_entry_id", "left").withColumn("many", F.coalesce("many", F.lit(False)))
        if several.count() > most:
            marked = change.replace("marked", marked)
        settled = _settled(marked.select(*own, "many", F.explode("mentions").alias("m")).select(*own, "many", "m.*", F.lit(METHOD).alias("extraction_method")), keys)
        evidence = change.replace("entity_evidence", _evidence(settled.where("not many")).unionByName(_evidence(settled.where("many")).dropDuplicates(EVIDENCE_KEY)))
        failures = change.replace("failures", mixed_sources(marked.where("many and size(mentions) > 0")))
        sound = marked.where("many").join(few(failures.select("collective_entry_id"), most), "collective_entry_id", "left_anti")
        sound = change.replace("sound", _with_ids(sound.select(*own, F.explode("mentions").alias("m"))))
        rows, said = _named(marked.where("not many"), keys).withColumn("many", F.lit(False)), read.where(F.size("relations") > 0).join(few(several, most), "collective_entry_id", "left_anti").agg(F.coalesce(F.sum(F.size("relations")), F.lit(0)))
        others = None
        if not sound.isEmpty():
            ids = few(sound.select(F.col("collective_entry_id").alias("id")).distinct(), most)
            others = change.replace("others", extract_relationships(entries.join(ids, "id", "left_semi"), memories, sound))
            rows = rows.unionByName(_between(others, sound, _decided(sound, keys)).withColumn("many", F.lit(True)))
        rows = change.replace("related", rows)
        relationships = change.replace("relationships", _relationships(rows))
        told = change.replace("relationship_evidence", _told(rows.where("not many")).unionByName(_told(rows.where("many")).dropDuplicates(TOLD_KEY)))
    counts = {
        "entries": governed_entries(entries).agg(F.count("*")), "mentions": mentions.agg(F.count("*")), "entities": entities.agg(F.count("*")), "resolutions": resolutions.agg(F.count("*")),
        "ambiguous": resolutions.agg(F.count_if(F.col("decision") == "ambiguous")), "entity_evidence": evidence.agg(F.count("*")), "said": said,
        "relationships": relationships.agg(F.count("*")), "relationship_evidence": told.agg(F.count("*")), "failed": failures.agg(F.count("*")),
    }
    row = {k: df.first()[0] for k, df in counts.items()}
    row["said"] += others.count() if others is not None else 0
    change.replace("report", store.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row)))
    for name in ("read", "several", "marked", "sound", "others", "related"):
        change.tables.pop(name, None)
    return change.commit(rebuilt=row["entries"])


def graph_nodes(entities: DataFrame, mentions: DataFrame, resolutions: DataFrame, gov: DataFrame) -> DataFrame:
    """Active entities with their governed mentions counted and profiles listed."""
    kept = mentions.join(gov.select(F.col("id").alias("collective_entry_id")), "collective_entry_id", "left_semi")
    used = kept.join(resolutions.where("decision = 'same_entity'").select("mention_id", F.col("proposed_entity_id").alias("entity_id")), "mention_id")
    counts = used.groupBy("entity_id").agg(F.count("*").alias("mention_count"), F.sort_array(F.collect_set("source_profile")).alias("source_profiles"))
    return entities.where("status = 'active'").select("entity_id", "canonical_name", "entity_type").join(counts, "entity_id").select("entity_id", "canonical_name", "entity_type", "mention_count", "source_profiles")


def graph_edges(entities: DataFrame, mentions: DataFrame, resolutions: DataFrame, relationships: DataFrame, gov: DataFrame) -> DataFrame:
    """mention edges entry to entity (one each, the last mention's confidence) and relationship edges between active entities, mentioned or not."""
    kept = mentions.join(gov.select(F.col("id").alias("collective_entry_id")), "collective_entry_id", "left_semi")
    active = entities.where("status = 'active'").select("entity_id")
    used = kept.join(resolutions.where("decision = 'same_entity'").select("mention_id", F.col("proposed_entity_id").alias("entity_id")), "mention_id").join(active, "entity_id", "left_semi")
    m = used.groupBy("collective_entry_id", "entity_id").agg(F.max_by("confidence", "mention_id").alias("confidence"))
    mention = m.select(F.concat(F.lit("entry:"), F.col("collective_entry_id").cast("string")).alias("source"), F.concat(F.lit("entity:"), F.col("entity_id").cast("string")).alias("target"), F.lit("mentions").alias("edge_type"), "confidence")
    r = relationships.where("status = 'active'").join(active.withColumnRenamed("entity_id", "subject_entity_id"), "subject_entity_id", "left_semi").join(active.withColumnRenamed("entity_id", "object_entity_id"), "object_entity_id", "left_semi")
    related = r.select(F.concat(F.lit("entity:"), F.col("subject_entity_id").cast("string")), F.concat(F.lit("entity:"), F.col("object_entity_id").cast("string")), "predicate", "confidence")
    return mention.union(related)


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows numbered in the total order of keys, for presentation."""
    return rows.withColumn("position", F.row_number().over(W.orderBy(*keys)).cast("long"))
