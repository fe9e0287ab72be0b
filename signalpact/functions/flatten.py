"""Flattening nested JSON objects to dotted keys inside one row: no explode, no shuffle.

All functions take and return SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from signalpact.functions.paths import ODD, json_path, name, quotable, quoted, root_object
from signalpact.model import MAX_DEPTH

# An overflow needs the document, the root object and MAX_DEPTH + 1 objects below it.
OVERFLOW_BRACES = MAX_DEPTH + 3
OVERFLOW_BYTES = 5 * (MAX_DEPTH + 1)
ALL_LEVELS = str(MAX_DEPTH + 1)


def is_object(value: str) -> str:
    return f"startswith(schema_of_variant({value}), 'OBJECT')"


def brace_count(payload: str) -> str:
    return f"(length({payload}) - length(replace({payload}, '{{', '')))"


def _entry(key: str, value: str, depth: str, text: str | None = None) -> str:
    """An entry with the schema tag of its value; only an object's starts with OBJECT<."""
    known = f", 'text', {text}" if text else ""
    return f"named_struct('key', {key}, 'value', {value}, 'depth', {depth}, 'tag', schema_of_variant({value}){known})"


#: An entry to be opened.
_OPEN = "startswith(e.tag, 'OBJECT')"


def _members(value: str, key: str, depth: str) -> str:
    """Entries of the members of a VARIANT object, NULL if it is none."""
    return (f"transform(map_entries(try_variant_get({value}, '$', 'map<string,variant>')), c -> "
            f"{_entry(f"concat_ws('.', {key}, c.key)", 'c.value', depth)})")


def _given(variable: str, value: str, body: str) -> str:
    """``body`` with a variable that is computed once."""
    return f"get(transform(array({value}), {variable} -> {body}), 0)"


def _text_members(text: str, key: str, depth: str) -> str:
    """The same read from the object's text: in document order and with repeated keys, as a map that comes
    from JSON keeps every member it was given. Only objects that may hold objects are read as text too,
    which a second brace tells. ``text`` is used more than once, so it must be cheap."""
    at = f"concat_ws('.', {key}, t.key)"
    return (f"CASE WHEN {brace_count(text)} > 1 "
            f"THEN zip_with({_read_members(text)}, {_read_texts(text)}, (t, s) -> {_entry(at, 't.value', depth, 's')}) "
            f"ELSE transform({_read_members(text)}, t -> {_entry(at, 't.value', depth, 'cast(NULL AS string)')}) END")


def _read_members(text: str) -> str:
    """Members (key, value VARIANT) of an object's text, repeated ones too."""
    return f"map_entries(from_json({text}, 'map<string,variant>'))"


def _read_texts(text: str) -> str:
    """The texts of the same members."""
    return f"map_values(from_json({text}, 'map<string,string>'))"


def _opened(first: str, below: str, levels: str) -> str:
    """Entries ``first`` with all objects opened ``levels`` times; without objects one look at them is all."""
    step = f"flatten(transform(acc, e -> CASE WHEN {_OPEN} THEN {below} ELSE array(e) END))"
    return (f"aggregate(sequence(1, greatest(least({levels}, {ALL_LEVELS}), 1)), {first}, "
            f"(acc, i) -> CASE WHEN exists(acc, e -> {_OPEN}) THEN {step} ELSE acc END)")


def _marks(value: str) -> str:
    """Opening and closing marks (``<``, ``>``) of the objects of a VARIANT outside of arrays.

    They stand in its schema; where that has arrays, those are taken out of its text, innermost first.
    """
    names = f"regexp_replace(s, '`[^`]*`', '')"
    plain = f"replace(replace(to_json({value}), {quoted(chr(92) * 2)}, ''), {quoted(chr(92) + chr(34))}, '')"
    marks = f"""regexp_replace(regexp_replace({plain}, '"[^"]*"', ''), {quoted(r'[^{}\[\]]+')}, '')"""
    arrays = "length(j) - length(replace(j, '[', ''))"
    inner = quoted(r"\[[{}]*\]")
    bare = f"aggregate(sequence(0, {arrays}), j, (a, i) -> CASE WHEN contains(a, '[') THEN regexp_replace(a, {inner}, '') ELSE a END)"
    return _given("s", f"schema_of_variant({value})", (
        f"CASE WHEN contains(s, 'ARRAY<') THEN {_given('j', marks, f"translate({bare}, '{{}}', '<>')")} "
        f"ELSE regexp_replace({names}, '[^<>]+', '') END"))


def nests_deeper(value: str, levels: str) -> str:
    """Whether objects are left in a VARIANT after taking away the innermost ones ``levels`` times.

    Arrays are leaves. Of repeated keys a VARIANT has the last.
    """
    return f"aggregate(sequence(1, {levels}), {_marks(value)}, (m, i) -> replace(m, '<>', '')) <> ''"


def keep_last(entries: str) -> str:
    """One entry per key, the last one given. ``entries`` must be a column: it is read once per key."""
    keys = f"array_distinct(transform({entries}, e -> e.key))"
    return (
        f"CASE WHEN size({keys}) = size({entries}) THEN {entries} "
        f"ELSE transform({keys}, k -> element_at(filter({entries}, e -> e.key = k), -1)) END"
    )


def _count(text: str, part: str) -> str:
    return f"((octet_length({text}) - octet_length(replace({text}, {quoted(part)}, ''))) div {len(part)})"


def _written(payload: str) -> str:
    """Members that a text shows by its names; NULL if white space before colons or escapes leave that open."""
    loose = " OR ".join(f"contains({payload}, {quoted(x)})" for x in (*(w + ":" for w in " \t\n\r"), chr(92) + "u"))
    return f"CASE WHEN NOT ({loose}) THEN {_count(payload, chr(34) + ':')} END"


def _lost(payload: str, doc: str, schema: str) -> str:
    """Members that the text shows and the parsed document lacks, repeated names of the root aside.

    The schema of a document names each member once, unless objects in arrays share one or names are quoted.
    """
    keys = f"json_object_keys({payload})"
    known = f"CASE WHEN {ODD} THEN size({keys}) - size(array_distinct({keys})) ELSE 0 END"
    shared = " OR ".join(f"contains({schema}, {quoted(x)})" for x in ("ARRAY<OBJECT", "ARRAY<VARIANT", "`"))
    held = f"CASE WHEN {shared} THEN {_count(f'to_json({doc})', chr(34) + ':')} ELSE {_count(schema, ': ')} END"
    return f"{_written(payload)} - {held} - {known}"


def add_entries(df: DataFrame, text: str, doc: str, roots: Iterable[str], levels: str, when: str) -> DataFrame:
    """Add ``__flat_<root>``: flat entries (key, value, depth, tag) below each root, one per key, arrays whole.

    A parsed document keeps the last of repeated keys only. So its names are counted against those in the
    text, and where the text shows any more the roots are read from it: objects of one name all count, of
    leaves with one flat key the last, of repeated roots the first. (Texts whose names can't be counted
    count as such: nothing but time is lost.) Done in steps of one column each, as lambdas would evaluate
    a shared input once per use.
    """
    base = [name(c) for c in df.columns]
    more = f"({when} AND coalesce({_lost(text, doc, '__schema')} <> 0, true))"
    first = df.selectExpr(*base, f"schema_of_variant({doc}) AS __schema").selectExpr(*base, *[
        f"CASE WHEN {more} THEN NULL WHEN {when} THEN {_members(root_object(text, doc, r), quoted(r), '0')} END AS __first_{r}"
        for r in roots], f"{more} AS __more")
    below = _members("e.value", "e.key", "e.depth + 1")
    opened = first.selectExpr(*base, "__more", *[
        f"CASE WHEN NOT __more THEN {leaves_of(f'CASE WHEN exists(__first_{r}, e -> {_OPEN}) THEN {_opened(f"__first_{r}", below, levels)} ELSE __first_{r} END')} "
        f"END AS __open_{r}" for r in roots])
    keys = "transform(__open_{0}, e -> e.key)"
    told = opened.selectExpr(*base, *[f"__open_{r}" for r in roots], *[
        f"CASE WHEN __more OR size(array_distinct({keys.format(r)})) <> size(__open_{r}) "
        f"THEN coalesce({leaves_of(all_entries(text, r, levels))}, {_NONE}) END AS __told_{r}" for r in roots])
    return told.selectExpr(*base, *[
        f"CASE WHEN {when} THEN coalesce(CASE WHEN __told_{r} IS NOT NULL THEN {keep_last(f'__told_{r}')} ELSE __open_{r} END, {_NONE}) "
        f"END AS __flat_{r}" for r in roots])


_NONE = "cast(array() AS array<struct<key:string,value:variant,depth:int,tag:string>>)"


def leaves_of(entries: str) -> str:
    return (f"transform(filter({entries}, e -> e.tag IS NOT NULL), "
            "e -> named_struct('key', e.key, 'value', e.value, 'depth', e.depth, 'tag', e.tag))")


def all_entries(text: str, root: str, levels: str | None = None) -> str:
    """All entries below a root (the first of that name), read from the text alone; repeated keys included."""
    own = f"get_json_object({text}, {json_path([root])})"
    below = _text_members("e.text", "e.key", "e.depth + 1")
    return _given("o", own, _opened(_text_members("o", quoted(root), "0"), below, levels or brace_count(text)))


def last_at(text: str, root: str, key: str) -> str:
    """Value of one flat key read from the text, so that the later of two spellings wins."""
    return f"try_element_at(filter({all_entries(text, root)}, e -> e.tag IS NOT NULL AND e.key = {quoted(key)}), -1).value"


def repeated_at(text: str, root: str, segments: list[str]) -> str:
    """The same where no key holds a dot: only objects on the way to the value are read."""
    objects = f"array(get_json_object({text}, {json_path([root])}))"
    for s in segments[:-1]:
        inner = f"CASE WHEN t.key = {quoted(s)} AND {is_object('t.value')} THEN s END"
        objects = f"flatten(transform({objects}, o -> filter(zip_with({_read_members('o')}, {_read_texts('o')}, (t, s) -> {inner}), s -> s IS NOT NULL)))"
    held = f"filter({_read_members('o')}, t -> t.key = {quoted(segments[-1])} AND NOT {is_object('t.value')})"
    return f"try_element_at(flatten(transform({objects}, o -> {held})), -1).value"


def spelled_with_dots(text: str, segments: list[str]) -> str:
    """Whether some key of the document may hold a dot that stands for these nested segments. An escape can spell
    any letter of a key, so any of a letter counts.
    """
    dotted = [f"contains({text}, {quoted(a + '.' + b)})" for a, b in zip(segments, segments[1:])]
    return " OR ".join([f"contains({text}, {quoted(chr(92) + 'u')})", *dotted])


def given_twice(text: str, segments: list[str]) -> str:
    """Whether an object on the way to these nested segments may be given twice."""
    # substring_index gives the whole text when there is no second one
    return " OR ".join(f"octet_length(substring_index({text}, {quoted(chr(34) + s + chr(34))}, 2)) <> octet_length({text})" for s in segments[:-1])


def value_at(text: str, root: str, root_column: str, below: list[str]) -> str:
    """VARIANT at a flat key; a key with a dot in its name can spell it as well, and objects may repeat.

    Keys a literal path can't hold (quotes, brackets) are looked up among the flat entries.
    """
    if not all(map(quotable, below)):
        return last_at(text, root, ".".join([root, *below]))
    nested = f"try_variant_get({root_column}, {json_path(below)}, 'variant')"
    if len(below) == 1:
        return nested
    key = ".".join([root, *below])
    return (f"CASE WHEN {spelled_with_dots(text, below)} THEN {last_at(text, root, key)} "
            f"WHEN {given_twice(text, below)} THEN {repeated_at(text, root, below)} ELSE {nested} END")


def text_overflows(payload: str) -> str:
    """Depth test for text the JSON reader gave up on because of its own nesting limit."""
    strings, others = quoted(r'"(?:[^"\\]|\\.)*"'), quoted(r"[^{}\[\]]")
    marks = f"split(regexp_replace(regexp_replace({payload}, {strings}, ''), {others}, ''), '')"
    arrays = "acc.arrays + CASE m WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END"
    objects = "acc.objects + CASE WHEN acc.arrays > 0 THEN 0 WHEN m = '{' THEN 1 WHEN m = '}' THEN -1 ELSE 0 END"
    return (
        f"aggregate({marks}, named_struct('objects', 0, 'arrays', 0, 'deepest', 0), (acc, m) -> "
        f"named_struct('objects', {objects}, 'arrays', {arrays}, 'deepest', greatest(acc.deepest, {objects})), "
        f"acc -> acc.deepest >= {OVERFLOW_BRACES})"
    )


def too_deep(payload: str, doc: str, roots: Iterable[str]) -> str:
    """Whether any root object nests deeper than permitted; nearly free for ordinary documents.

    Taking away all permitted levels must leave no object behind.
    """
    left = " OR ".join(
        f"coalesce({nests_deeper(root_object(payload, doc, r), ALL_LEVELS)}, false)" for r in roots
    )
    return (
        f"coalesce(octet_length({payload}) >= {OVERFLOW_BYTES} AND {brace_count(payload)} >= {OVERFLOW_BRACES} "
        f"AND CASE WHEN {doc} IS NULL THEN {text_overflows(payload)} ELSE {left} END, false)"
    )
