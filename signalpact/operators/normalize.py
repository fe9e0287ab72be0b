"""Raw JSON events to the canonical form: event name, identity keys, flat properties."""

from __future__ import annotations

from pyspark.sql import DataFrame

from signalpact.functions import flatten as fl
from signalpact.functions.paths import ODD, first_texts, json_path, name, quoted, repeats_root, sealed
from signalpact.functions.typed import Paths
from signalpact.model import MAX_DEPTH, Mapping
from signalpact.session import accept_repeated_keys

ROOTS = ("properties", "context")
# fixed value: the message of an event nested too deeply
DEPTH_ERROR = f"excessive json nesting: depth exceeds limit of {MAX_DEPTH}"
DOC, TEXTS = "__doc", "__texts_of"


def parse(df: DataFrame, payload: str, mapping: Mapping = Mapping(), doc: str = DOC) -> DataFrame:
    """Add the parsed document, whether it must be read from its text (ODD), and the texts of all name paths,
    read from the document at once (TEXTS)."""
    accept_repeated_keys(df.sparkSession)
    text, paths = name(payload), name_texts(mapping)
    whole = df.selectExpr("*", f"try_parse_json({text}) AS {doc}", f"{repeats_root(text)} AS {ODD}")
    return whole.selectExpr("*", f"{paths.read(doc)} AS {TEXTS}") if paths.plain else whole


def name_texts(mapping: Mapping) -> Paths:
    """Every path of the mapping as text."""
    known = [p for found in (mapping.event_paths, *mapping.identity_paths.values()) for p in found]
    return Paths([tuple(p.split(".")) for p in known], "string")


def _name_text(text: str, paths: Paths, path: str) -> str:
    """Text at a name path, NULL where it is absent, null, an object or an array."""
    plain = f"get_json_object({text}, {json_path(path.split('.'))})"
    found = paths.at(TEXTS, tuple(path.split("."))) if paths.plain else plain
    return f"CASE WHEN {ODD} THEN {plain} ELSE {found} END"


def identity_names(mapping: Mapping) -> list[str]:
    """Keys an event can carry; ``anonymousId`` may also stand in for ``userId``."""
    return sorted({*mapping.identity_paths, *(["userId"] if "anonymousId" in mapping.identity_paths else [])})


def read_names(
    df: DataFrame, text: str, mapping: Mapping, event: str | None, identity: dict[str, str],
    first: dict[str, str] | None = None, then: dict[str, str] | None = None,
) -> DataFrame:
    """Add the event name (column ``event``, an empty string when no path holds one) and one text
    column per identity key (key -> column, NULL when empty) to a parsed frame.

    ``first`` and ``then`` are further columns for the two projections this takes: every
    projection less is a copy of the row less.
    """
    wanted = {}
    if event is not None:
        wanted[event] = tuple(mapping.event_paths)
    for key, column in identity.items():
        own = tuple(mapping.identity_paths.get(key, ()))
        stand_in = tuple(mapping.identity_paths.get("anonymousId", ())) if key == "userId" else ()
        wanted[column] = own + stand_in
    paths = name_texts(mapping)
    one, two = first_texts({n: [_name_text(text, paths, p) for p in found] for n, found in wanted.items() if found})
    if event in two:
        two[event] = f"coalesce({two[event]}, '')"
    one.update(first or {})
    step = df.selectExpr("*", *[f"{e} AS {n}" for n, e in one.items()])
    kept = [name(c) for c in step.columns if c not in two]
    return step.selectExpr(*kept, *[f"{e} AS {n}" for n, e in {**two, **(then or {})}.items()])


def _identity_map(columns: dict[str, str]) -> str:
    pairs = ", ".join(f"{quoted(key)}, {column}" for key, column in columns.items())
    return f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)"


def _identity_columns(mapping: Mapping) -> dict[str, str]:
    return {k: f"__id_{i}" for i, k in enumerate(identity_names(mapping))}


def extract_event_name(
    df: DataFrame, payload: str = "payload", mapping: Mapping = Mapping()
) -> DataFrame:
    """Add ``event``: the first non-empty name, else an empty string."""
    named = read_names(parse(df, payload, mapping), name(payload), mapping, "__name", {})
    return sealed(named, [c for c in df.columns if c != "event"], {"event": "__name"})


def extract_identity(
    df: DataFrame, payload: str = "payload", mapping: Mapping = Mapping()
) -> DataFrame:
    """Add ``identity``, MAP<STRING,STRING> of the identity keys that are set."""
    columns = _identity_columns(mapping)
    found = read_names(parse(df, payload, mapping), name(payload), mapping, None, columns)
    return sealed(found, [c for c in df.columns if c != "identity"], {"identity": _identity_map(columns)})


def _with_entries(df: DataFrame, payload: str, roots: tuple[str, ...], mapping: Mapping = Mapping()) -> DataFrame:
    """Parse once, then add per root its flat entries and one flag for excessive depth."""
    text = name(payload)
    opened = parse(df, payload, mapping).selectExpr(
        "*", f"{fl.brace_count(text)} AS __levels", f"{fl.too_deep(text, DOC, roots)} AS __deep")
    return fl.add_entries(opened, text, DOC, roots, "__levels", "NOT __deep")


def flatten_events(
    df: DataFrame, root: str = "properties", id_col: str = "event_id", payload: str = "payload"
) -> DataFrame:
    """One row per leaf below ``root``: (id, key, value VARIANT, depth); arrays are leaves.

    Events nested too deeply give no rows; find them with :func:`depth_guard`.
    """
    flat = _with_entries(df.select(id_col, payload), payload, (root,))
    return sealed(flat, [id_col], {"__flat": f"__flat_{root}"}).selectExpr(name(id_col), "inline(__flat)").drop("tag")


def depth_guard(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``too_deep``: some object below properties or context exceeds the depth limit."""
    text = name(payload)
    return sealed(parse(df, payload), df.columns, {"too_deep": fl.too_deep(text, DOC, ROOTS)})


def normalize(
    df: DataFrame, payload: str = "payload", mapping: Mapping = Mapping()
) -> DataFrame:
    """Canonical events: adds ``event``, ``identity``, ``properties`` and ``error``.

    ``properties`` is MAP<STRING,VARIANT> over both roots; an event nested too deeply has NULL
    properties and the reason in ``error``. Everything happens inside the row.
    """
    text = name(payload)
    columns = _identity_columns(mapping)
    flat = _with_entries(df, payload, ROOTS, mapping)
    whole = read_names(flat, text, mapping, "__name", columns, first={
        "__all": f"concat({', '.join(f'__flat_{r}' for r in ROOTS)})"})
    kept = [c for c in df.columns if c not in ("event", "identity", "properties", "error")]
    return sealed(whole, kept, {
        "event": "__name", "identity": _identity_map(columns),
        "properties": "map_from_arrays(transform(__all, e -> e.key), transform(__all, e -> e.value))",
        "error": f"CASE WHEN __deep THEN {quoted(DEPTH_ERROR)} END",
    })
