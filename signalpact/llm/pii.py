"""Personal data: fixed patterns, then information-theoretic sanitisation of what still reveals them.

The patterns find the protected entities. Terms that stand near an entity are then measured on the whole
corpus: with p(entity | term) estimated from document counts, a term discloses the share

    PMI(entity; term) / IC(entity) = log(p(entity | term) / p(entity)) / -log p(entity)

of an entity's information. Terms beyond the threshold would let a reader restore the entity after it is
masked, so they are generalised (figures and capitalised words) or removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalpact.llm.text import free_names, per_text, quoted, table, text_bytes
from signalpact.session import cut_lineage

#: Kinds of the fixed patterns in the order of the output.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on each side of an entity that are its context.
REACH = 4
#: Documents in which a term must stand near an entity before it is measured.
SUPPORT = 2
#: Share of an entity's information that a term may disclose.
DISCLOSURE = 0.8
#: Bytes of candidate terms that are sent to every task; beyond it they are joined.
BROADCAST_BYTES = 4 << 20
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ANY = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each @ that no earlier match took."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; code points, end exclusive."""
    if not text or not _ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _key(word: str) -> str:
    """Terms are compared without case and without punctuation at either end."""
    return word.strip(".,;:!?()[]{}\"'|#$%&*<>").lower()


def entity_name(text: str, span: tuple[int, int, int]) -> str:
    """One name per protected value: kind and value, separators of numbers left out."""
    start, kind, end = span
    value = text[start:end].lower()
    return f"{kind}:{value}" if kind < 2 else f"{kind}:{''.join(c for c in value if c.isdigit())}"


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int = REACH) -> set[tuple[str, str]]:
    """Distinct (entity, term) of a text: terms within ``reach`` words of the entity that touch no entity."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    free = [True] * len(words)
    places = []
    for start, _, end in spans:
        first = max(bisect_left(starts, start + 1) - 1, 0)
        last = bisect_left(starts, end) - 1
        places.append((first, last))
        for i in range(first, last + 1):
            free[i] = False
    out = set()
    for span, (first, last) in zip(spans, places, strict=True):
        entity = entity_name(text, span)
        for i in (*range(max(first - reach, 0), first), *range(last + 1, min(last + 1 + reach, len(words)))):
            term = _key(text[slice(*words[i])]) if free[i] else ""
            if term:
                out.add((entity, term))
    return out


def _document_frequency(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, df) of ``terms`` over all documents. The terms are broadcast if their measured size allows."""
    spark = docs.sparkSession
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        known = spark.sparkContext.broadcast(frozenset(r[0] for r in terms.collect()))  # at most BROADCAST_BYTES

        def make():
            wanted = known.value
            short = frozenset(map(len, wanted))

            def work(texts: list) -> dict:
                found = []
                for t in texts:
                    words = set(text_bytes(t).split())
                    keys = {_key(w.decode()) for w in words}
                    found.append([k for k in keys if len(k) in short and k in wanted])
                return {"terms": found}

            return work

        hits = per_text(docs, [], text, make, "terms array<string>")
        return hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def make_all():
        return lambda texts: {"terms": [list({_key(w.decode()) for w in set(text_bytes(t).split())} - {""}) for t in texts]}

    words = per_text(docs, [], text, make_all, "terms array<string>")
    counted = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(terms, "term", "left_semi")


def disclosing_terms(
    docs: DataFrame, text_col: str = "text", reach: int = REACH, support: int = SUPPORT, disclosure: float = DISCLOSURE,
) -> DataFrame:
    """(entity, term, disclosure): terms that give away at least ``disclosure`` of an entity's information.

    Counted over all documents; a pair is measured from ``support`` documents on.
    """
    def make():
        def work(texts: list) -> dict:
            out = []
            for t in texts:
                spans = base_spans(t)
                pairs = contexts(t, spans, reach) if spans else ()
                names = {entity_name(t, s) for s in spans}
                out.append([{"entity": e, "term": k} for e, k in pairs] + [{"entity": e, "term": None} for e in names])
            return {"pairs": out}

        return work

    pairs = per_text(docs, [], text_col, make, "pairs array<struct<entity: string, term: string>>")
    counted = cut_lineage(
        pairs.select(F.inline("pairs")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support),
        "pairs",
    )
    near = counted.where("term IS NOT NULL")
    entities = counted.where("term IS NULL").select("entity", F.col("n").alias("n_entity"))
    total = docs.count()
    frequency = cut_lineage(_document_frequency(docs, text_col, near.select("term").distinct()), "terms")
    share = F.least(F.col("n") / F.col("df"), F.lit(1.0))
    p = F.col("n_entity") / F.lit(float(max(total, 1)))
    measured = F.when(p < 1, F.ln(share / p) / -F.ln(p)).otherwise(0.0)  # an entity of every document is no secret
    return (
        near.join(entities, "entity").join(frequency, "term")
        .select("entity", "term", measured.alias("disclosure")).where(F.col("disclosure") >= disclosure)
    )


def find_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT,
    disclosure: float = DISCLOSURE, keep: list[str] | None = None, name: str = "spans",
) -> DataFrame:
    """(``keep``, spans): all spans of every row, patterns and disclosing terms.

    ``keep`` defaults to the id and may hold the text; ``name`` is that of the added column. ``spans`` is an array of (start, kind, end), sorted; kind 4 is a term. A
    term is marked in the documents that hold the entity it discloses, wherever it stands there outside
    the patterns. A null or empty text has no spans; repeated rows are treated alike.
    """
    flagged = cut_lineage(disclosing_terms(docs, text_col, reach, support, disclosure).select("entity", "term"), "disclosing")
    size = flagged.agg(F.sum(F.octet_length("entity") + F.octet_length("term") + 128)).first()[0] or 0
    keep = keep or [id_col]

    def mark(text: str | None, spans: list, terms: set) -> list:
        if terms:
            taken = [(a, b) for a, _, b in spans]
            starts = [a for a, _ in taken]
            tops = np.maximum.accumulate([b for _, b in taken]).tolist()
            for m in _WORD.finditer(text):
                if _key(m[0]) in terms:
                    last = bisect_left(starts, m.end()) - 1
                    if last < 0 or tops[last] <= m.start():
                        spans.append((m.start(), len(KINDS), m.end()))
            spans.sort()
        return [{"start": a, "kind": k, "end": b} for a, k, b in spans]

    schema = f"`{name}` array<struct<start: int, kind: int, end: int>>"
    if size <= BROADCAST_BYTES:
        by_entity: dict[str, set[str]] = {}
        for entity, term in flagged.collect():  # at most BROADCAST_BYTES
            by_entity.setdefault(entity, set()).add(term)
        known = docs.sparkSession.sparkContext.broadcast(by_entity)

        def make():
            def work(texts: list) -> dict:
                out = []
                for t in texts:
                    spans = base_spans(t)
                    terms = set().union(*(known.value.get(entity_name(t, s), ()) for s in spans)) if spans else set()
                    out.append(mark(t, spans, terms))
                return {name: out}

            return work

        return per_text(docs, keep, text_col, make, schema)

    # Beyond the bound: each row's entities are joined with the flagged terms and brought back by row number.
    row, pair = free_names(docs, "_row", "_both")
    needed = map(quoted, dict.fromkeys([*keep, text_col]))
    numbered = cut_lineage(docs.select(*needed, F.monotonically_increasing_id().alias(row)), "numbered")

    def names():
        return lambda texts: {"entities": [list({entity_name(t, s) for s in base_spans(t)}) for t in texts]}

    held = per_text(numbered, [row], text_col, names, "entities array<string>").select(row, F.explode("entities").alias("entity"))
    terms = held.join(flagged, "entity").groupBy(row).agg(F.collect_set("term").alias("terms")).select(
        row, F.struct("terms").alias(pair))
    whole = numbered.join(terms, row, "left").withColumn(pair, F.struct(F.col(quoted(text_col)).alias("text"), F.col(pair)["terms"].alias("terms")))

    def make_joined():
        return lambda rows: {name: [mark(r["text"], base_spans(r["text"]), set(r["terms"] or ())) for r in rows]}

    return per_text(whole, keep, pair, make_joined, schema)


def _general(word: str) -> str:
    """The generalisation of a term: figures keep their number of digits, capitalised words become a class."""
    if any(c.isdigit() for c in word):
        return re.sub(r"[0-9]", "0", word)
    return "[NAME]" if word[:1].isupper() else ""


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every pattern replaced by its kind and every term generalised or removed."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:  # an overlap is masked once
            at = max(at, end)
            continue
        out.append(text[at:start])
        out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else _general(text[start:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text sanitised; all other columns and all rows stay. See :func:`find_spans`."""
    others = [c for c in docs.columns if c != text_col]
    spans, pair, clean = free_names(docs, "_spans", "_both", "_clean")
    found = find_spans(docs, text_col=text_col, keep=docs.columns, name=spans, **options).select(
        *map(quoted, others), F.struct(F.col(quoted(text_col)).alias("text"), F.col(spans).alias("spans")).alias(pair))

    def make():
        return lambda rows: {clean: [
            masked(r["text"], [(s["start"], s["kind"], s["end"]) for s in r["spans"]]) for r in rows]}

    out = per_text(found, others, pair, make, f"{clean} string")
    return out.withColumnRenamed(clean, text_col).select(*map(quoted, docs.columns))


def op7_information_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents: counts and digest of the patterns, and the list with the added terms."""
    found = find_spans(table(spark, sf_dir, "documents"))
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*(F.lit(k) for k in (*KINDS, TERM)))

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(text_of(F.filter("spans", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
    )
