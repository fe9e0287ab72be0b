"""Validation of raw events against a contract: one pass, one join, no shuffle, no state."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Observation, functions as F

from signalpact.functions import flatten as fl
from signalpact.functions.checks import (
    ABSENT, ERROR_DDL, STRING, Value, checks_of, error, errors_of, kind_of, literal_spec,
)
from signalpact.functions.paths import ODD, name, quoted, root_object, sealed
from signalpact.model import Contract, Mapping
from signalpact.operators.compiled import WORD_BITS, CompiledContract, compile_contract
from signalpact.operators.normalize import (
    DEPTH_ERROR, DOC, ROOTS, TEXTS, identity_names, parse, read_names,
)

# fixed value: the message of an event without identity
IDENTITY_ERROR = "identity_required: no recognized identity properties found"
SALTS = 16
NO_ERRORS = f"cast(array() AS array<{ERROR_DDL}>)"


def validate(
    df: DataFrame,
    contract: Contract | CompiledContract,
    payload: str = "payload",
    mapping: Mapping = Mapping(),
    identity_gate: bool = True,
    event: str | Column | None = None,
    with_errors: bool = True,
) -> DataFrame:
    """Add ``event``, ``status`` (valid / invalid / error) and ``errors`` to every raw event.

    ``event`` replaces the name found in the payload (a string is a literal name).
    ``with_errors=False`` leaves ``errors`` out, for counts and routing without reasons.
    Input columns of these names (in any case) are replaced. Works the same on batch and streaming
    frames.
    """
    compiled = contract if isinstance(contract, CompiledContract) else compile_contract(contract)
    text = name(payload)
    kept = [c for c in df.columns if c.lower() not in ("event", "status", "errors")]
    wanted = _identity_columns(compiled, mapping, identity_gate)

    given = [] if event is None else [(F.lit(event) if isinstance(event, str) else event).alias("__name")]
    parsed = parse(df.select(*[F.col(name(c)) for c in kept], *given), payload, mapping)
    roots = {} if compiled.checks is None else {f"__root_{r}": root_object(text, DOC, r) for r in ROOTS}
    opened = read_names(
        parsed, text, mapping, None if given else "__name", {k: f"__id_{i}" for k, i in wanted.items()},
        first=roots, then={"__deep": fl.too_deep(text, DOC, ROOTS)},
    )
    dropped = (TEXTS,) if compiled.checks is None else (TEXTS, DOC, ODD)
    gated = opened.selectExpr(*[name(c) for c in opened.columns if c not in dropped], f"{_identity_ok(compiled, wanted, identity_gate)} AS __identified")
    if compiled.checks is None:     # before the join: every step after it would copy the rules of the event
        gated = _with_leaves(gated, compiled, text, wanted)
    joined = _join_rules(gated, compiled, payload)
    active = "(NOT __deep AND __identified AND __event IS NOT NULL AND __broken IS NULL)"
    check = _check_as_data if compiled.checks is None else _check_as_code
    checked = check(joined, compiled, text, wanted, active, with_errors)

    def lone(rule: str, detail: str) -> str:
        return f"array({error(quoted(''), rule, detail)})"

    known_name = "coalesce(__name, '')"
    fields = {"event": known_name, "status": (
        "CASE WHEN __deep THEN 'error' WHEN NOT __identified THEN 'invalid' "
        "WHEN __event IS NULL OR __broken IS NOT NULL THEN 'error' "
        "WHEN __any THEN 'invalid' ELSE 'valid' END"
    )}
    if with_errors:
        fields["errors"] = (
            f"CASE WHEN __deep THEN {lone('depth', quoted(DEPTH_ERROR))} "
            f"WHEN NOT __identified THEN {lone('identity', quoted(IDENTITY_ERROR))} "
            f"WHEN __event IS NULL THEN {lone('unknown_event', f"concat('event ', {known_name}, ' not found')")} "
            f"WHEN __broken IS NOT NULL THEN {lone('contract', '__broken')} ELSE __failed END"
        )
    return sealed(checked, kept, fields)


def _identity_columns(
    compiled: CompiledContract, mapping: Mapping, identity_gate: bool
) -> dict[str, int]:
    """Identity keys worth reading: those of the gate and those with constraints."""
    known = set(identity_names(mapping))
    used = set(compiled.identity_keys) if identity_gate else set()
    if compiled.checks is None:
        used |= known
    else:
        used |= {c["property"] for c in compiled.checks}
    return {k: i for i, k in enumerate(sorted(known & used))}


def _identity_ok(compiled: CompiledContract, wanted: dict[str, int], gate: bool) -> str:
    if not gate or not compiled.identity_keys:
        return "true"
    found = [f"__id_{wanted[k]} IS NOT NULL" for k in compiled.identity_keys if k in wanted]
    return " OR ".join(found) or "false"


def _join_rules(df: DataFrame, compiled: CompiledContract, payload: str) -> DataFrame:
    """Left join on the event name: broadcast within the size bound, else a salted shuffle."""
    on = F.col("__name") == F.col("__event")
    if compiled.broadcast:
        return df.join(F.broadcast(compiled.rules), on, "left")
    # One event name may hold a third of all rows: spread it over copies of its rules. Equal payloads
    # share a copy; a partition they overfill is split by the adaptive skew join.
    salted = compiled.rules.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slot = F.pmod(F.xxhash64(F.col(name(payload))), F.lit(SALTS)).cast("int")
    keyed = df.withColumn("__slot", slot)
    return keyed.join(salted, on & (F.col("__slot") == F.col("__salt")), "left").drop("__slot", "__salt")


def _check_as_code(
    df: DataFrame, compiled: CompiledContract, text: str, wanted: dict[str, int], active: str,
    with_errors: bool,
) -> DataFrame:
    """Few distinct checks: each becomes a literal expression, switched on by the event's mask."""
    words = [c for c in df.columns if c.startswith("__mask_")]
    by_prop: dict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(compiled.checks):
        by_prop[c["property"]].append(i)
    props = sorted(by_prop)
    others = [name(c) for c in df.columns if c not in words]

    def bits_set(prefix: str, ids: list[int]) -> str:
        per_word: dict[int, int] = defaultdict(int)
        for i in ids:
            per_word[i // WORD_BITS] |= 1 << (i % WORD_BITS)
        return "(" + " OR ".join(f"({prefix}_{w} & {m}L) <> 0" for w, m in per_word.items()) + ")"

    masked = df.selectExpr(
        *others, *[f"CASE WHEN {active} THEN {w} ELSE 0L END AS {w}" for w in words]
    )
    values, kinds, pairs = [], [], []
    for n, prop in enumerate(props):
        root, *below = prop.split(".")
        specs = [compiled.checks[i] for i in by_prop[prop]]
        own = f"__id_{wanted[prop]}" if prop in wanted else None
        held = root in ROOTS and bool(below)
        if held:
            # The value is a column of its own, so its kind and its forms share one lookup.
            found = fl.value_at(text, root, f"__root_{root}", below)
            found = f"CASE WHEN {bits_set('__mask', by_prop[prop])} THEN {found} END"
            values += [f"{found} AS __v{n}", f"schema_of_variant({found}) AS __t{n}"]
            kind, string = kind_of(f"__t{n}", f"__v{n}"), f"try_variant_get(__v{n}, '$', 'string')"
            number = f"try_variant_get(__v{n}, '$', 'double')"
        else:
            kind, string, number = str(ABSENT), "cast(NULL AS string)", "cast(NULL AS double)"
        # A key that names an identity is its text, whatever the properties hold.
        if own:
            kind = f"CASE WHEN {own} IS NOT NULL THEN {STRING} ELSE {kind} END"
            string = f"coalesce({own}, {string})"
        kinds.append(f"{kind} AS __k{n}")
        if any(c["type"] == "string" and any(
                c[f] is not None for f in ("min_length", "max_length", "pattern", "allowed")) for c in specs):
            kinds.append(f"{string} AS __s{n}")
        if any(c["type"] in ("integer", "number") and (c["min"] is not None or c["max"] is not None) for c in specs):
            kinds.append(f"{number} AS __n{n}")
        value = Value(f"__k{n}", f"__s{n}", f"__n{n}")
        for i in by_prop[prop]:
            pairs += checks_of(value, literal_spec(compiled.checks[i]), bits_set("__mask", [i]))

    with_values = masked.selectExpr("*", *values)
    base = [c for c in others if not c.startswith("`__root_")]
    ready = with_values.selectExpr(*base, *words, *kinds)

    # All conditions go into bit words in generated code; error structs are built from the bits
    # and only for events that have any.
    failed_words = []
    for w in range(0, max(len(pairs), 1), WORD_BITS):
        bits = [f"CASE WHEN {cond} THEN {1 << k}L ELSE 0L END"
                for k, (cond, _) in enumerate(pairs[w:w + WORD_BITS])]
        failed_words.append(" | ".join(bits) or "0L")
    told = [f"__k{n}" for n in range(len(props))] if with_errors else []
    flagged = ready.selectExpr(
        *base, *told, *[f"{x} AS __failed_{w}" for w, x in enumerate(failed_words)])
    some = " OR ".join(f"__failed_{w} <> 0" for w in range(len(failed_words)))
    if not with_errors:
        return flagged.selectExpr(*base, f"({some}) AS __any")
    slots = [f"CASE WHEN {bits_set('__failed', [k])} THEN {err} END" for k, (_, err) in enumerate(pairs)]
    listed = f"CASE WHEN {some} THEN array({', '.join(slots)}) END" if slots else f"cast(NULL AS array<{ERROR_DDL}>)"
    filled = flagged.selectExpr(*base, f"({some}) AS __any", f"{listed} AS __slots")
    return filled.selectExpr(*base, "__any", f"coalesce(array_compact(__slots), {NO_ERRORS}) AS __failed")


def _with_leaves(df: DataFrame, compiled: CompiledContract, text: str, wanted: dict[str, int]) -> DataFrame:
    """Add ``__leaves``, the values of the event by property: flattened as deep as any property name."""
    base = [name(c) for c in df.columns if c not in (DOC, ODD)]
    read = "(NOT __deep AND __identified)"
    # One level more than any property name has, so that no unopened object bears a property's name.
    counted = df.selectExpr("*", f"least({fl.brace_count(text)}, {compiled.levels + 1}) AS __levels")
    entries = fl.add_entries(counted, text, DOC, ROOTS, "__levels", read)

    def leaf(key: str, tag: str, own: str, held: str, text: str) -> str:
        return f"named_struct('key', {key}, 'leaf', named_struct('tag', {tag}, 'own', {own}, 'held', {held}, 'text', {text}))"

    none = "cast(NULL AS string)"
    own = ", ".join(leaf(quoted(k), none, f"__id_{i}", "cast(NULL AS variant)", none) for k, i in wanted.items())
    flat = f"concat({', '.join(f'coalesce(__flat_{r}, array())' for r in ROOTS)})"
    leaves = f"transform({flat}, e -> {leaf('e.key', 'e.tag', none, 'e.value', "try_variant_get(e.value, '$', 'string')")})"
    every = f"concat(filter(array({own}), e -> e.leaf.own IS NOT NULL), {leaves})" if own else leaves
    return entries.selectExpr(*base, f"CASE WHEN {read} THEN map_from_entries({every}) END AS __leaves")


def _check_as_data(
    df: DataFrame, compiled: CompiledContract, text: str, wanted: dict[str, int], active: str,
    with_errors: bool,
) -> DataFrame:
    """Many distinct checks: the event's leaves meet its rules by key.

    Checks and leaves are two maps by property, zipped through a hash table inside the row: the work
    grows with their number, not with the product. The errors of absent values stand in the rules.
    """
    base = [name(c) for c in df.columns if c not in ("__leaves", "__checks")]
    typed = f"""named_struct(
        'kind', CASE WHEN v.own IS NOT NULL THEN {STRING} ELSE {kind_of('v.tag', 'v.held')} END,
        'text', coalesce(v.own, v.text),
        'number', CASE WHEN v.tag IN ('BIGINT', 'DOUBLE') OR startswith(v.tag, 'DECIMAL') THEN try_cast(v.text AS double) END)"""
    value = Value("x.kind", "x.text", "x.number")
    each = f"flatten(transform(array({typed}), x -> array_compact(transform(cs.checks, c -> {errors_of(value, 'c')}))))"
    checked = df.selectExpr(*base, f"""CASE WHEN {active} THEN map_zip_with(
        __checks, __leaves, (k, cs, v) -> CASE WHEN v IS NULL THEN cs.absent WHEN cs IS NOT NULL THEN {each} END) END AS __found""")
    failed = checked.selectExpr(
        *base, f"coalesce(flatten(flatten(array_compact(map_values(__found)))), {NO_ERRORS}) AS __failed")
    return failed.selectExpr("*", "size(__failed) > 0 AS __any")


def error_strings(errors: str | Column = "errors") -> Column:
    """Errors as text, the form dead-letter records and feeds carry."""
    return F.transform(errors, lambda e: F.when(
        e["property"] == "", e["detail"]
    ).when(e["rule"].isin("required"), F.concat(F.lit("(root): "), e["detail"])
    ).otherwise(F.concat(e["property"], F.lit(": "), e["detail"])))


def route(validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, error) frames. Each read evaluates the source; to write all three in
    one pass use :func:`signalpact.sources.sinks.write_routed`."""
    return tuple(validated.filter(F.col("status") == s) for s in ("valid", "invalid", "error"))


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def observe_validation(validated: DataFrame, name: str = "validation") -> tuple[DataFrame, Observation]:
    """Attach outcome counts to whatever action the frame is used in."""
    seen = Observation(name)
    # A stream reports through its listener, under the name alone.
    return validated.observe(
        name if validated.isStreaming else seen, F.count(F.lit(1)).alias("total"), _count("valid").alias("valid"),
        _count("invalid").alias("invalid"), _count("error").alias("error"),
    ), seen


def event_metrics(validated: DataFrame, batch: int = 0) -> DataFrame:
    """Outcome counts per event name and the findings by rule, of one batch: telemetry per event.

    Names no contract knows come from the payloads and are unbounded, so they share the row ``''``.
    """
    unknown = F.exists("errors", lambda e: e["rule"] == "unknown_event")
    rules = ("required", "type", "min", "max", "min_length", "max_length", "pattern", "enum")
    return validated.groupBy(F.when(unknown, "").otherwise(F.col("event")).alias("event")).agg(
        F.count(F.lit(1)).alias("total"), _count("valid").alias("valid"),
        _count("invalid").alias("invalid"), _count("error").alias("error"),
        *[F.sum(F.expr(f"size(filter(errors, e -> e.rule = '{r}'))")).cast("bigint").alias(f"rule_{r}") for r in rules],
    ).withColumn("batch_id", F.lit(batch).cast("bigint"))


def summary(validated: DataFrame) -> DataFrame:
    """Per event name: total, valid, invalid and error counts (partial aggregation first)."""
    return validated.groupBy("event").agg(
        F.count(F.lit(1)).alias("total"), _count("valid").alias("valid"),
        _count("invalid").alias("invalid"), _count("error").alias("error"),
    )
