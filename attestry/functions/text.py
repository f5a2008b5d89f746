"""Text functions as column expressions, with Arrow functions where built-ins can't say it."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query intents by their patterns, case-insensitive (fixed values).
INTENTS = {
    "temporal": r"\bwhen\b|\bdate\b|\bdated\b|\byear\b|\bmonth\b|\bday\b|\bbefore\b|\bafter\b|\bduring\b|\bsince\b|\buntil\b|\brecent(?:ly)?\b|\blast\s+(?:week|month|year)\b|\bthis\s+(?:week|month|year)\b",
    "entity": r"\bwho\s+is\b|\bwhat\s+is\s+(?:the\s+)?(?:person|entity|project|company|team)\b|\bentity\b|\bperson\b|\bprofile\b|\babout\s+[A-Z][\w-]*\b",
    "relationship": r"\brelationship\b|\brelated\s+to\b|\bconnected\s+to\b|\bconnection\b|\bbetween\s+.+\s+and\s+.+\b|\bdepends\s+on\b|\bassociated\s+with\b|\blink(?:ed)?\s+to\b",
    "lexical": r"\bexact(?:ly)?\b|\bexact\s+match\b|\bverbatim\b|\bphrase\b|\bkeyword\b|\bcontains?\b|\bliteral(?:ly)?\b",
}
#: Channels of each intent (fixed values).
ROUTES = {
    "semantic": ["semantic"], "lexical": ["lexical"], "temporal": ["temporal", "semantic"], "entity": ["entity", "semantic"],
    "relationship": ["relationship", "entity", "semantic"], "hybrid": ["lexical", "semantic", "temporal", "entity", "relationship"],
}
#: What is masked, in this order (fixed values).
EMAIL = r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+"
PHONE = r"(?:\+?1[-\.\s]?)?(?:\(?\d{3}\)?[-\.\s]?\d{3}[-\.\s]?\d{4})"


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_observation(text: Column) -> Column:
    """Case-folded words without punctuation, single blanks."""
    return collapse(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_\s]", " "))


def observation_hash(text: Column) -> Column:
    return F.sha2(normalize_observation(text), 256)


def content_hash(text: Column) -> Column:
    """Hash of a text with white space collapsed and case kept."""
    return F.sha2(collapse(text), 256)


def normalize_name(text: Column) -> Column:
    """Entity key of a name whose Unicode form is already composed: only letters and digits, case-folded."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}]+", " "))


def name_key(text: str) -> str:
    """Entity key of one name: letters and digits of its NFKC form, case-folded, single blanks between."""
    return " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", text).casefold()).split())


@F.arrow_udf(StringType())
def normalize_name_nfkc(values: pa.Array) -> pa.Array:
    """name_key() of a column."""
    return pa.array([None if t is None else name_key(t) for t in values.to_pylist()], pa.string())


def entity_key(text: Column) -> Column:
    """name_key() of a column: ASCII names, whose NFKC form is their own, stay in the JVM."""
    return F.coalesce(normalize_name_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), normalize_name(text))


def canonical_json(metadata: Column) -> Column:
    """A map of strings as compact JSON with its keys in order; null for null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata))))


def tokens(text: Column) -> Column:
    """Distinct words of a normalized observation."""
    return F.array_distinct(F.filter(F.split(normalize_observation(text), " "), lambda x: x != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two sets; two empty sets are alike."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def sequence_ratio(left: str, right: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp ratio; 0 where a quick upper bound already falls below least."""
    matcher = SequenceMatcher(None, left, right, autojunk=False)
    if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least:
        return 0.0
    return matcher.ratio()


def sequence_similarity(left: Column, right: Column, least: float = 0.0) -> Column:
    @F.arrow_udf("double")
    def ratio(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else sequence_ratio(x, y, least) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())

    return ratio(left, right)


def query_intent(query: Column) -> Column:
    """The one intent a query shows, hybrid for several, semantic for none."""
    q = collapse(query)
    signs = {k: q.rlike(f"(?i){p}") for k, p in INTENTS.items()}
    count = sum((s.cast("int") for s in signs.values()), F.lit(0))
    found = F.coalesce(*[F.when(s, F.lit(k)) for k, s in signs.items()])
    return F.when(count > 1, "hybrid").when(count == 1, found).otherwise("semantic")


def intent_of(query: str) -> str:
    """query_intent() of one query, without a job."""
    q = re.sub(r"\s+", " ", query).strip()
    found = [k for k, p in INTENTS.items() if re.search(p, q, re.IGNORECASE | re.ASCII)]
    return "hybrid" if len(found) > 1 else found[0] if found else "semantic"


def route(intent: Column) -> Column:
    pairs = [x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.create_map(*pairs)[intent]


def script(text: Column) -> Column:
    """latin, non_latin, mixed or unknown, by the letters of a text."""
    latin, other = text.rlike(r"\p{IsLatin}"), text.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    return F.when(latin & other, "mixed").when(latin, "latin").when(other, "non_latin").otherwise("unknown")


def semantic_supported(text: Column) -> Column:
    return ~script(text).isin("non_latin", "mixed")


def latin_only(query: str) -> bool:
    """Whether the NFKC form of one query has no letter of another script than Latin."""
    return all(unicodedata.name(c, "LATIN").find("LATIN") >= 0 for c in unicodedata.normalize("NFKC", query) if c.isalpha())


def masked(text: Column) -> Column:
    """Text with e-mail addresses, then phone numbers, replaced."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[REDACTED]"), PHONE, "[REDACTED]")


def masked_fields(text: Column) -> Column:
    return F.filter(F.array(F.when(text.rlike(EMAIL), F.lit("email")), F.when(text.rlike(PHONE), F.lit("phone"))), lambda x: x.isNotNull())


def match_terms(query: str) -> list[str]:
    """Terms of a keyword query: blank-parted, stripped of all but letters, digits and underscores."""
    found = [re.sub(r"[^\w]", "", t) for t in query.split()]
    return list(dict.fromkeys(t.lower() for t in found if t))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Name-based (SHA-1) UUID, the same as Python's uuid5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def short_id(prefix: str, size: int, *parts: Column, joiner: str = "|") -> Column:
    """prefix and the first size digits of the SHA-256 of the joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(joiner, *parts), 256), 1, size))


# ---- stemming -------------------------------------------------------------------------

_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _V and not (w[i] == "y" and i > 0 and _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1*", r"\1", kinds)))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix rules of the Porter stemmer, steps 2 to 4 (fixed values).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words with other letters than a-z stay as they are."""
    w = word
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, new in sorted(rules, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            head = w[: -len(end)]
            if _measure(head) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.arrow_udf(StringType())
def stem_column(values: pa.Array) -> pa.Array:
    each = values.dictionary_encode()
    return pa.array([stem(v) for v in each.dictionary.to_pylist()], pa.string()).take(each.indices)
