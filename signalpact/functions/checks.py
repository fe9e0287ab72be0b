"""The checks on one property value as SQL text, for fixed bounds and for bounds held as data."""

from __future__ import annotations

from dataclasses import dataclass

from signalpact.functions.paths import quoted

ERROR_DDL = "struct<property:string,rule:string,detail:string>"


# Kinds of a value. Small numbers, as every check compares them.
ABSENT, STRING, INTEGER, NUMBER, BOOLEAN, NULL, ARRAY = range(7)
KIND_NAMES = {STRING: "string", INTEGER: "integer", NUMBER: "number", BOOLEAN: "boolean",
              NULL: "null", ARRAY: "array"}


def kind_of(tag: str, value: str) -> str:
    """Kind of a VARIANT with a given schema tag; a number without fraction is an integer.

    Objects were flattened away, so one that is left means the key itself is absent.
    """
    number = f"try_variant_get({value}, '$', 'double')"
    return (
        f"CASE WHEN {tag} IS NULL THEN {ABSENT} WHEN {tag} = 'STRING' THEN {STRING} "
        f"WHEN {tag} = 'BIGINT' THEN {INTEGER} "
        f"WHEN startswith({tag}, 'DECIMAL') OR {tag} = 'DOUBLE' THEN "
        f"CASE WHEN {number} % 1 = 0 THEN {INTEGER} ELSE {NUMBER} END "
        f"WHEN {tag} = 'BOOLEAN' THEN {BOOLEAN} WHEN {tag} = 'VOID' THEN {NULL} "
        f"WHEN startswith({tag}, 'ARRAY') THEN {ARRAY} ELSE {ABSENT} END"
    )


@dataclass(frozen=True)
class Value:
    """A property value of one event as SQL text: its kind, text and number."""

    kind: str
    text: str
    number: str

    @property
    def present(self) -> str:
        return f"{self.kind} <> {ABSENT}"

    @property
    def numeric(self) -> str:
        return f"{self.kind} IN ({INTEGER}, {NUMBER})"

    def has_type(self, type_name: str) -> str:
        """Whether a present value has a JSON type (an object never is one, see kind_of)."""
        if type_name == "number":
            return f"({self.numeric})"
        kinds = {n: k for k, n in KIND_NAMES.items()}
        return f"({self.kind} = {kinds[type_name]})" if type_name in kinds else "false"

    @property
    def kind_name(self) -> str:
        """JSON type name of a present value, for messages."""
        cases = " ".join(f"WHEN {k} THEN '{n}'" for k, n in KIND_NAMES.items())
        return f"CASE {self.kind} {cases} END"


@dataclass(frozen=True)
class Spec:
    """What to check, as SQL text; None for a check that is known not to be wanted.

    ``type_name`` is the declared type where it is fixed, else None and ``type`` tells it per row.
    """

    property: str
    type: str
    type_name: str | None
    required: str
    min: str | None = None
    max: str | None = None
    min_length: str | None = None
    max_length: str | None = None
    pattern: str | None = None
    allowed: str | None = None


def error(prop: str, rule: str, detail: str) -> str:
    return f"named_struct('property', {prop}, 'rule', '{rule}', 'detail', {detail})"


def _plain(number: str) -> str:
    """A bound as text, without a trailing ``.0``."""
    return f"regexp_replace(cast({number} AS string), '\\\\.0$', '')"


def _rules(v: Value, s: Spec) -> dict[str, tuple[str, str]]:
    """Condition and error struct per rule that the spec can raise, in rule-name order.

    Conditions of bounds hold for numbers, those of lengths, pattern and enum for strings.
    """
    out: dict[str, tuple[str, str]] = {}

    def add(rule: str, condition: str, detail: str) -> None:
        out[rule] = condition, error(s.property, rule, detail)

    if s.allowed is not None:
        add("enum", f"NOT array_contains({s.allowed}, {v.text})",
            f"concat({s.property}, ' must be one of the following: ', array_join({s.allowed}, ', '))")
    if s.max is not None:
        add("max", f"{v.number} > {s.max}", f"concat('Must be less than or equal to ', {_plain(s.max)})")
    if s.max_length is not None:
        add("max_length", f"char_length({v.text}) > {s.max_length}",
            f"concat('String length must be less than or equal to ', {s.max_length})")
    if s.min is not None:
        add("min", f"{v.number} < {s.min}", f"concat('Must be greater than or equal to ', {_plain(s.min)})")
    if s.min_length is not None:
        add("min_length", f"char_length({v.text}) < {s.min_length}",
            f"concat('String length must be greater than or equal to ', {s.min_length})")
    if s.pattern is not None:
        add("pattern", f"NOT rlike({v.text}, {s.pattern})", f"concat('Does not match pattern \\'', {s.pattern}, '\\'')")
    add("required", f"{s.required} AND NOT ({v.present})", f"concat({s.property}, ' is required')")
    add("type", v.present, f"concat('Invalid type. Expected: ', {s.type}, ', given: ', {v.kind_name})")
    return out


ON_NUMBER, ON_TEXT = ("max", "min"), ("enum", "max_length", "min_length", "pattern")


def checks_of(v: Value, s: Spec, guard: str = "true") -> list[tuple[str, str]]:
    """(condition, error struct) per check that a spec of fixed type can raise, in rule-name order.

    After a type mismatch only the type error is raised.
    """
    right_type = v.has_type(s.type_name)
    fits = f"{guard} AND {right_type}"
    allowed = {
        **{r: fits for r in ON_NUMBER if s.type_name in ("number", "integer")},
        **{r: fits for r in ON_TEXT if s.type_name == "string"},
        **({"required": guard} if s.required != "false" else {}), "type": f"{guard} AND NOT {right_type}",
    }
    return [(f"{allowed[r]} AND {condition}", err) for r, (condition, err) in _rules(v, s).items() if r in allowed]


def errors_of(v: Value, row: str) -> str:
    """Errors of one value against a check held as data (struct ``row``); NULL if it passes.

    Only the rules of the value's kind are looked at, and only where the check has any.
    """
    rules = _rules(v, data_spec(row))
    cases = " ".join(
        f"WHEN '{t}' THEN {v.has_type(t)}" for t in ("string", "number", "integer", "boolean", "array", "null"))

    def some(names: tuple[str, ...]) -> tuple[str, str]:
        fields = {"enum": "allowed"}
        asked = " OR ".join(f"{row}.{fields.get(r, r)} IS NOT NULL" for r in names)
        return f"({asked})", "array_compact(array(" + ", ".join(f"CASE WHEN {rules[r][0]} THEN {rules[r][1]} END" for r in names) + "))"

    on_number, number_errors = some(ON_NUMBER)
    on_text, text_errors = some(ON_TEXT)
    return (
        f"CASE WHEN NOT ({v.present}) THEN CASE WHEN {row}.required THEN array({rules['required'][1]}) END "
        f"WHEN NOT coalesce(CASE {row}.type {cases} END, false) THEN array({rules['type'][1]}) "
        f"WHEN {v.kind} = {STRING} THEN CASE WHEN {on_text} THEN {text_errors} END "
        f"WHEN {v.numeric} THEN CASE WHEN {on_number} THEN {number_errors} END END"
    )


def absent_errors(rows: str) -> str:
    """Errors per check of an array of checks held as data where the value is absent; NULL if all pass."""
    missing = _rules(Value(str(ABSENT), "''", "0"), data_spec("c"))["required"][1]
    found = f"filter(transform({rows}, c -> CASE WHEN c.required THEN array({missing}) END), e -> e IS NOT NULL)"
    return f"nullif({found}, cast(array() AS array<array<{ERROR_DDL}>>))"


def literal_spec(check) -> Spec:
    """Spec of one constraint row with its bounds as literals."""
    def lit(value, wrap=str):
        return None if value is None else wrap(value)

    return Spec(
        property=quoted(check["property"]), type=quoted(check["type"]), type_name=check["type"],
        required="true" if check["required"] else "false",
        min=lit(check["min"], lambda x: f"double({x!r})"), max=lit(check["max"], lambda x: f"double({x!r})"),
        min_length=lit(check["min_length"]), max_length=lit(check["max_length"]),
        pattern=lit(check["pattern"], quoted),
        allowed=lit(check["allowed"], lambda xs: "array(" + ", ".join(map(quoted, xs)) + ")" if xs
                    else "cast(array() AS array<string>)"),
    )


def data_spec(row: str) -> Spec:
    """Spec whose bounds are fields of a struct; a missing bound is NULL and never fails."""
    f = {n: f"{row}.{n}" for n in (
        "property", "type", "required", "min", "max", "min_length", "max_length", "pattern", "allowed")}
    return Spec(type_name=None, **f)
