"""SQL text that reads single values out of a JSON payload.

Expressions are built as text and handed over once per column: a contract can need hundreds of
them, and composing each from Column calls would cost a driver round trip per node.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column name as SQL."""
    return "`" + column.replace("`", "``") + "`"


def quotable(segment: str) -> bool:
    """Whether a key can stand in a literal JSON path."""
    return not any(c in segment for c in "'\"?\\[]")


def json_path(segments: Iterable[str]) -> str:
    """A JSON path as SQL literal."""
    return quoted("$" + "".join(f"['{s}']" for s in segments))


#: Column that says a document must be read from its text, see :func:`repeats_root`.
ODD = "__odd"


def repeats_root(payload: str) -> str:
    """Whether a key of the document root is given twice.

    A parsed document keeps the last of repeated keys; a repeated root key must yield its first value, so
    those few documents are read from the text instead. Keys spelled with escapes are decoded.
    """
    keys = f"json_object_keys({payload})"
    return f"coalesce(size(array_distinct({keys})) <> size({keys}), false)"


def first_texts(texts: dict[str, list[str]]) -> tuple[dict[str, str], dict[str, str]]:
    """First non-empty text of each list, NULL when all are empty, in two steps of columns.

    The first step is a plain coalesce, which is right unless it meets an empty string; only then
    does the second go through the list again. An ordinary event costs one lookup per missing path.
    """
    first = {n: f"coalesce({', '.join(t)})" for n, t in texts.items()}
    then = {
        n: f"CASE WHEN {n} = '' THEN get(filter(array({', '.join(t)}), t -> t <> ''), 0) ELSE {n} END"
        for n, t in texts.items()
    }
    return first, then


def root_object(payload: str, doc: str, key: str) -> str:
    """Sub-document under a root key as VARIANT (first one wins when the key is repeated)."""
    steps = json_path([key])
    return (
        f"CASE WHEN {ODD} THEN try_parse_json(get_json_object({payload}, {steps})) "
        f"ELSE try_variant_get({doc}, {steps}, 'variant') END"
    )


def sealed(df: DataFrame, keep: list[str], fields: dict[str, str]) -> DataFrame:
    """Project ``fields`` as one generated row.

    A later filter on them stays above. Over a plain projection the optimizer would inline the
    expressions into the filter and parse every document once more.
    """
    row = ", ".join(f"{quoted(n)}, {e}" for n, e in fields.items())
    return df.selectExpr(*[name(c) for c in keep], f"inline(array(named_struct({row})))")
