"""Expected results of the registered queries as SQL over the driver's tables.

Validation results are computed from the ``events`` columns by CASE and modulo alone; no payload
is ever built or parsed here, so the SQL is independent of the code it checks.
"""

from __future__ import annotations

ENUM_TEXT = "properties.category must be one of the following: c0, c1, c2, c3"
PATTERN_TEXT = "Does not match pattern ''^K[0-9]{2}$''"
MIN = "Must be greater than or equal to "
MAX = "Must be less than or equal to "
SHORT = "String length must be greater than or equal to "
LONG = "String length must be less than or equal to "


def wrong_type(expected: str, given: str) -> str:
    return f"Invalid type. Expected: {expected}, given: {given}"


# (property, rule, condition, detail) in the order errors are listed
CHECKS_V1 = [
    ("context.ip", "type", "i % 23 = 0", wrong_type("string", "null")),
    ("properties.category", "enum", "{et} IN ('click','purchase','signup') AND k % 5 = 4", ENUM_TEXT),
    ("properties.code", "min_length", "{et} IN ('view','purchase','signup') AND k < 10", SHORT + "3"),
    ("properties.code", "pattern", "{et} IN ('view','purchase','signup') AND k < 10", PATTERN_TEXT),
    ("properties.metadata.source", "max_length", "i % 11 <> 0 AND i % 29 = 0", LONG + "3"),
    ("properties.metadata.source", "required", "i % 11 = 0", "properties.metadata.source is required"),
    ("properties.price", "max", "{et} = 'purchase' AND i % 13 <> 0 AND value > 400", MAX + "400"),
    ("properties.price", "min", "{et} = 'purchase' AND i % 13 <> 0 AND value < 1", MIN + "1"),
    ("properties.price", "type", "{et} IN ('click','purchase','signup') AND i % 13 = 0",
     wrong_type("number", "string")),
    ("properties.qty", "max", "{et} IN ('purchase','signup') AND k > 95", MAX + "95"),
    ("properties.qty", "min", "{et} IN ('purchase','signup') AND k < 5", MIN + "5"),
]
# The second version wants prices as text; whole numbers are told apart from others.
CHECKS_V2 = [c for c in CHECKS_V1 if c[0] != "properties.price"]
CHECKS_V2.insert(6, (
    "properties.price", "type", "{et} IN ('click','purchase','signup') AND i % 13 <> 0", ""))

EVENTS = """
e AS (
  SELECT event_id AS i, event_type AS et, user_id, value, ts,
         CAST(regexp_extract(props, '[0-9]+') AS INT) AS k
  FROM events
),
c AS (
  SELECT *, (i % 7 <> 0 OR i % 2 = 0) AS idok,
         CASE WHEN i % 7 <> 0 THEN CAST(user_id AS VARCHAR)
              WHEN i % 2 = 0 THEN 'a' || CAST(user_id AS VARCHAR) END AS uid,
         CASE WHEN i % 11 = 0 THEN NULL WHEN i % 29 = 0 THEN 'website' ELSE 'web' END AS source,
         (i % 19 = 0 AND i % 17 <> 0) AS by_prop
  FROM e
)"""


def _errors(checks, et: str, sep: str, item) -> str:
    cases = [f"CASE WHEN {cond.format(et=et)} THEN '{item(p, r, d)}' END" for p, r, cond, d in checks]
    return f"concat_ws('{sep}', " + ", ".join(cases) + ")"


def _code(p, r, d):
    return f"{p}:{r}"


def _text(p, r, d):
    return f"(root): {d}" if r == "required" else f"{p}: {d}"


def _outcomes(checks=CHECKS_V1, et="et", gate=True, known="et <> 'error'") -> str:
    no_id = "NOT idok" if gate else "FALSE"
    return f"""WITH {EVENTS},
r AS (
  SELECT *, {_errors(checks, et, ';', _code)} AS codes, {_errors(checks, et, ' | ', _text)} AS texts
  FROM c
),
v AS (
  SELECT *,
    CASE WHEN {no_id} THEN 'invalid' WHEN NOT ({known}) THEN 'error'
         WHEN codes <> '' THEN 'invalid' ELSE 'valid' END AS status,
    CASE WHEN {no_id} THEN ':identity' WHEN NOT ({known}) THEN ':unknown_event' ELSE codes END AS errors,
    CASE WHEN {no_id} THEN 'identity_required: no recognized identity properties found'
         WHEN NOT ({known}) THEN 'event ' || et || ' not found' ELSE texts END AS messages
  FROM r
)
"""


def _single_checks(*rules: str) -> str:
    parts = [
        f"SELECT i AS event_id, '{p}' AS property, '{r}' AS rule, '{d}' AS detail FROM c "
        f"WHERE idok AND et <> 'error' AND {cond.format(et='et')}"
        for p, r, cond, d in CHECKS_V1 if r in rules
    ]
    return f"WITH {EVENTS}\n" + "\nUNION ALL\n".join(parts)


def _leaf(key, depth, text="NULL", number="NULL", is_null="FALSE", where="TRUE") -> str:
    return (
        f"SELECT i AS event_id, '{key}' AS key, {depth} AS depth, CAST({text} AS VARCHAR) AS text, "
        f"CAST({number} AS DOUBLE) AS number, {is_null} AS is_null FROM c WHERE {where}"
    )


def _type_by(n: str) -> str:
    return f"CASE WHEN {n} % 3 = 0 THEN 'number' WHEN {n} % 3 = 1 THEN 'string' ELSE 'boolean' END"


REGISTRY = f"""
pt AS (SELECT DISTINCT p_brand AS event, p_type FROM part),
shared AS (
  SELECT p_type, p_size, min(p_partkey) AS k FROM part GROUP BY p_type, p_size
),
won AS (
  SELECT event, p_size, max(p_type) AS p_type FROM pt JOIN shared USING (p_type) GROUP BY event, p_size
),
props AS (
  SELECT event, 'properties.s' || p_size AS property, {_type_by('k')} AS type,
         k % 2 = 0 AS required, p_type AS description,
         CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max,
         CAST(NULL AS INT) AS max_length, CAST(NULL AS VARCHAR) AS pattern
  FROM won JOIN shared USING (p_type, p_size)
  UNION ALL
  SELECT p_brand, 'properties.p' || p_partkey,
         CASE WHEN p_partkey % 5 = 0 THEN 'enum' ELSE {_type_by('p_size')} END,
         p_partkey % 4 = 0, p_name,
         CASE WHEN p_partkey % 5 = 0 THEN 'e' || (p_size % 10) END,
         CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE), p_size + 10,
         CASE WHEN p_size % 2 = 0 THEN '^[a-z]+$' END
  FROM part
),
enums AS (
  SELECT 'e' || (p_size % 10) AS name, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS allowed
  FROM part WHERE p_size % 10 < 7 GROUP BY 1
)"""


def _side(new: bool) -> str:
    keep, req, length = (5, 3, 4) if new else (7, 4, 3)
    size = "p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END" if new else "p_size"
    return (
        f"SELECT p_brand AS event, 'properties.p' || p_partkey AS property, "
        f"{_type_by('(' + size + ')')} AS type, p_partkey % {req} = 0 AS required, "
        f"p_size % {length} AS enum FROM part WHERE p_partkey % {keep} <> 0"
    )


def _side_events(new: bool) -> str:
    keep = 5 if new else 7
    moved = "CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END" if new else "0"
    return (
        f"SELECT DISTINCT p_brand || '-' || p_size AS event, 't' || (p_size % 3 + {moved}) AS entity "
        f"FROM part WHERE p_partkey % {keep} <> 0"
    )


PROPERTY_DIFF = f"""WITH o AS ({_side(False)}), n AS ({_side(True)}),
b AS (SELECT event FROM o INTERSECT SELECT event FROM n),
j AS (
  SELECT coalesce(o.event, n.event) AS event, coalesce(o.property, n.property) AS property,
         o.property IS NULL AS added, n.property IS NULL AS gone,
         o.type AS ot, n.type AS nt, o.required AS orq, n.required AS nrq, o.enum AS oe, n.enum AS ne
  FROM o FULL OUTER JOIN n ON o.event = n.event AND o.property = n.property
  WHERE coalesce(o.event, n.event) IN (SELECT event FROM b)
),
d AS (
  SELECT event, property, 'REMOVED (BREAKING)' AS t, TRUE AS breaking FROM j WHERE gone
  UNION ALL SELECT event, property, 'ADDED', FALSE FROM j WHERE added
  UNION ALL SELECT event, property, 'TYPE CHANGE ' || ot || ' -> ' || nt || ' (BREAKING)', TRUE
    FROM j WHERE NOT gone AND NOT added AND ot <> nt
  UNION ALL SELECT event, property, 'NOW REQUIRED (BREAKING)', TRUE
    FROM j WHERE NOT gone AND NOT added AND NOT orq AND nrq
  UNION ALL SELECT event, property, 'ENUM CHANGED (POTENTIAL BREAKING)', TRUE
    FROM j WHERE NOT gone AND NOT added AND oe <> ne
),
diff AS (
  SELECT event, property, 'event [' || event || '] prop [' || property || ']: ' || t AS change, breaking FROM d
)
"""


def _pick(n: str) -> str:
    return (f"CASE {n} % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' "
            "WHEN 3 THEN 'signup' ELSE 'error' END")


NODES = f"""WITH nd AS (
  SELECT c_custkey AS i, c_custkey // 10 AS f, 'F' || (c_custkey // 10) AS flow,
         'N' || c_custkey AS node, 'N' || (c_custkey + 1) AS dst,
         (c_custkey % 10 = 0 AND (c_custkey // 10) % 6 <> 0) AS opens
  FROM customer
),
u AS (
  SELECT *, CASE WHEN opens THEN {_pick('f')} WHEN i % 3 = 2 THEN {_pick('i')} END AS event FROM nd
),
ed AS (
  SELECT flow, node AS src, dst,
         CASE i % 3 WHEN 0 THEN 'transition' WHEN 1 THEN 'condition' ELSE 'timeout' END AS kind,
         CASE i % 3 WHEN 0 THEN '' WHEN 2 THEN 'timeout: 24h' ELSE
           CASE i % 4 WHEN 0 THEN '$event.properties.price > 10'
                      WHEN 1 THEN 'x == 1 and $event.properties.qty < 3 or $event.zzz'
                      WHEN 2 THEN '$event.missing' ELSE 'default' END END AS label
  FROM nd
)
"""

PURCHASES = f"WITH {EVENTS}, m AS (SELECT * FROM c WHERE et = 'purchase')\n"
QTY_PRICE = "k AS qty, value AS price"

ORACLE: dict[str, str] = {
    "read_events": "SELECT event_id, props AS payload FROM events",
    "stream_validate_counts": _outcomes() + """
SELECT et AS event, count(*) AS total, count(*) FILTER (status = 'valid') AS valid,
       count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'error') AS error
FROM v GROUP BY et""",
    "snapshot_roundtrip": f"""WITH {EVENTS}
SELECT i AS id, 'sha_a' AS sha, et AS event_name, epoch_us(ts) AS created_us, k AS qty
FROM c WHERE i % 2 = 0""",
    "snapshots_by_event": f"""WITH {EVENTS}
SELECT et AS event_name, count(*) AS payloads, CAST(sum(k) AS BIGINT) AS qty
FROM c WHERE i % 2 = 0 GROUP BY et""",
    "dlq_records": _outcomes() + f"""
SELECT {QTY_PRICE}, messages AS errors, TRUE AS stamped FROM v WHERE status = 'invalid'""",
    "dlq_webhook_envelope": _outcomes() + """
SELECT k AS qty, messages AS errors, 'edge' AS source FROM v WHERE status = 'invalid'""",
    "result_feed": _outcomes() + """
SELECT et AS name, status = 'valid' AS is_valid, messages AS errors FROM v WHERE status <> 'error'""",
    "extract_event_name": "SELECT event_id, event_type AS event FROM events",
    "extract_identity": f"""WITH {EVENTS}
SELECT i AS event_id, uid AS "user",
       CASE WHEN i % 7 = 0 AND i % 2 = 0 THEN uid END AS anonymous, CAST(NULL AS VARCHAR) AS wallet,
       CASE WHEN NOT idok THEN 0 WHEN i % 7 = 0 THEN 2 ELSE 1 END AS found
FROM c""",
    "identity_fallback": f"""WITH {EVENTS}
SELECT i AS event_id, uid AS "user" FROM c WHERE i % 7 = 0 AND i % 2 = 0""",
    "flatten_properties": f"WITH {EVENTS}\n" + "\nUNION ALL\n".join([
        _leaf("properties.price", 0, number="value"),
        _leaf("properties.category", 0, "'c' || (k % 5)"),
        _leaf("properties.code", 0, "'K' || k"),
        _leaf("properties.qty", 0, number="k"),
        _leaf("properties.tags", 0, "'[\"a\",\"b\"]'"),
        _leaf("properties.metadata.source", 1, "source", where="source IS NOT NULL"),
        _leaf("properties.event_name", 0, "et", where="by_prop"),
    ]),
    "flatten_context": f"WITH {EVENTS}\n" + "\nUNION ALL\n".join([
        _leaf("context.ip", 0, "CASE WHEN i % 23 <> 0 THEN '10.0.0.1' END", is_null="i % 23 = 0"),
        _leaf("context.library.name", 1, "'sdk'"),
    ]),
    "depth_guard": "SELECT event_id, 95 + event_id % 12 >= 102 AS too_deep FROM events",
    "normalize_events": f"""WITH {EVENTS}
SELECT i AS event_id, et AS event, uid AS "user",
       7 + CASE WHEN source IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN by_prop THEN 1 ELSE 0 END AS keys,
       source, value AS price, TRUE AS ok
FROM c""",
    "custom_mapping": f"""WITH {EVENTS}
SELECT i AS event_id, 'K' || k AS event, uid AS account, 'sdk' AS library FROM c""",
    "resolve_inheritance": f"WITH {REGISTRY}\nSELECT event, property, type, required, description FROM props",
    "detect_import_cycles": """WITH p AS (
  SELECT p_partkey AS k, p_partkey // 7 AS b FROM part
),
g AS (
  SELECT b, count(*) AS n, string_agg('P' || k, ' -> ' ORDER BY k) AS chain FROM p GROUP BY b
)
SELECT 'B' || b AS event,
  CASE WHEN b % 5 = 0 THEN 'circular dependency detected in mixins: [' || chain || ' -> P' || (b * 7) || ']'
       ELSE 'mixin X' || b || ' not found' END AS error
FROM g WHERE n = 7 AND b % 5 IN (0, 1)""",
    "constraint_table": f"""WITH {REGISTRY}
SELECT event, property, CASE WHEN allowed IS NOT NULL THEN 'string' ELSE type END AS type, required,
       min, max, CAST(NULL AS INT) AS min_length, max_length, pattern, allowed
FROM props LEFT JOIN enums ON type = 'enum' AND ref = name""",
    "resolve_enum_refs": f"""WITH {REGISTRY}
SELECT property, CASE WHEN allowed IS NOT NULL THEN 'string' ELSE type END AS type, ref, allowed
FROM props LEFT JOIN enums ON ref = name WHERE type = 'enum'""",
    "merge_fragments": """
SELECT p_brand AS name, arg_max(p_name, p_partkey) AS body FROM part WHERE p_size % 4 <> 0 GROUP BY p_brand""",
    "extract_contract": NODES + """,
r AS (
  SELECT *, row_number() OVER (PARTITION BY event ORDER BY flow, node) AS rn FROM u WHERE event IS NOT NULL
)
SELECT event, 'Auto-extracted: ' || flow AS description, 'properties.n' || i AS properties
FROM r WHERE rn = 1""",
    "contract_catalogue": f"""WITH {REGISTRY}
SELECT event, 'All of ' || event AS description, property, type,
       CASE WHEN required THEN 'REQUIRED' ELSE 'OPTIONAL' END AS requirement
FROM props""",
    "identity_gate": f"WITH {EVENTS}\nSELECT i AS event_id, idok AS identified FROM c",
    "check_required": _single_checks("required"),
    "check_type": _single_checks("type"),
    "check_bounds": _single_checks("min", "max"),
    "check_length": _single_checks("min_length", "max_length"),
    "check_pattern": _single_checks("pattern"),
    "check_enum": _single_checks("enum"),
    "validate_events": _outcomes() + "SELECT i AS event_id, et AS event, status, errors FROM v",
    # Without the gate a purchase without identity misses its required userId.
    "validate_no_identity": _outcomes(
        CHECKS_V1 + [("userId", "required", "{et} = 'purchase' AND NOT idok", "userId is required")],
        gate=False,
    ) + "SELECT i AS event_id, et AS event, status, errors FROM v",
    "validate_event_override": _outcomes(et="'click'", gate=False, known="TRUE")
    + "SELECT i AS event_id, 'click' AS event, status, errors FROM v",
    "unknown_event_errors": _outcomes()
    + "SELECT i AS event_id, messages AS reason FROM v WHERE status = 'error'",
    "route_counts": _outcomes() + """
SELECT CASE status WHEN 'valid' THEN 'accepted' WHEN 'invalid' THEN 'rejected' ELSE 'error' END AS route,
       count(*) AS events, CAST(sum(i) AS BIGINT) AS id_sum
FROM v GROUP BY 1""",
    "validation_metrics": _outcomes() + """
SELECT count(*) AS total, count(*) FILTER (status = 'valid') AS valid,
       count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'error') AS error FROM v""",
    "check_parity": _outcomes(
        CHECKS_V2 + [("userId", "required", "{et} = 'purchase' AND NOT idok", "")],
        gate=False, known="et NOT IN ('error', 'view')",
    ) + """,
f AS (
  SELECT *, row_number() OVER (PARTITION BY et ORDER BY i) AS rn FROM v WHERE status <> 'valid' AND i % 2 = 0
)
SELECT et AS event_name, i AS id, errors FROM f WHERE rn = 1""",
    "diff_events": f"""WITH o AS (SELECT DISTINCT event FROM ({_side_events(False)})),
n AS (SELECT DISTINCT event FROM ({_side_events(True)}))
SELECT event, 'event [' || event || ']: ADDED' AS change, FALSE AS breaking
FROM n WHERE event NOT IN (SELECT event FROM o)
UNION ALL
SELECT event, 'event [' || event || ']: REMOVED (BREAKING)', TRUE
FROM o WHERE event NOT IN (SELECT event FROM n)""",
    "diff_properties": PROPERTY_DIFF + "SELECT event, property, change, breaking FROM diff",
    "diff_entity": f"""
SELECT o.event, 'event [' || o.event || ']: ENTITY CHANGE ' || o.entity || ' -> ' || n.entity AS change,
       FALSE AS breaking
FROM ({_side_events(False)}) o JOIN ({_side_events(True)}) n ON o.event = n.event
WHERE o.entity <> n.entity""",
    "impact_gate": PROPERTY_DIFF + """
SELECT count(*) AS findings, count(*) > 0 AS failed, 'all' AS scope FROM diff
UNION ALL
SELECT count(*), count(*) > 0, 'breaking' FROM diff WHERE breaking""",
    "typed_model": PURCHASES + """
SELECT i AS event_id, CASE WHEN i % 23 <> 0 THEN '10.0.0.1' END AS "context.ip",
       'sdk' AS "context.library.name", 'c' || (k % 5) AS "properties.category",
       'K' || k AS "properties.code", source AS "properties.metadata.source",
       value AS "properties.price", k AS "properties.qty", '["a","b"]' AS "properties.tags", uid AS "userId"
FROM m""",
    "materialized_model": PURCHASES + f"SELECT i AS event_id, {QTY_PRICE} FROM m",
    "model_missing_columns": f"""WITH {REGISTRY}
SELECT event, property FROM props
WHERE required AND NOT (property LIKE 'properties.s%'
      AND CAST(regexp_extract(property, '[0-9]+') AS INT) % 2 = 0
      AND CAST(regexp_extract(property, '[0-9]+') AS INT) < 50)""",
    "model_null_counts": PURCHASES + """,
n AS (
  SELECT count(*) AS total, count(*) FILTER (i % 23 = 0) AS ip, count(*) FILTER (source IS NULL) AS source,
         count(*) FILTER (uid IS NULL) AS uid FROM m
)
SELECT 'context.ip' AS property, ip AS nulls, total FROM n
UNION ALL SELECT 'context.library.name', 0, total FROM n
UNION ALL SELECT 'properties.metadata.source', source, total FROM n
UNION ALL SELECT 'properties.price', 0, total FROM n
UNION ALL SELECT 'userId', uid, total FROM n""",
    "flow_edges": NODES + "SELECT flow, src, dst, kind, label FROM ed",
    "orphan_targets": NODES + """
SELECT flow, src, dst, kind, 'node ' || src || ': orphaned ' || kind || ' target ' || dst AS error
FROM ed WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.flow = ed.flow AND nd.node = ed.dst)""",
    "uncontracted_events": """
SELECT event_type AS event, count(*) AS seen FROM events
WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup') GROUP BY event_type""",
    "unused_events": """
SELECT event FROM (VALUES ('click'), ('purchase'), ('signup'), ('refund')) x(event)
WHERE event NOT IN (SELECT event_type FROM events)""",
    "bad_gate_refs": NODES + """,
has(event, property) AS (
  VALUES ('click', 'properties.price'), ('purchase', 'properties.price'), ('signup', 'properties.price'),
         ('purchase', 'properties.qty'), ('signup', 'properties.qty')
),
refs AS (
  SELECT f, flow, node, CASE i % 4 WHEN 0 THEN 'properties.price' WHEN 1 THEN 'properties.qty'
                                   WHEN 2 THEN 'missing' END AS property
  FROM u WHERE NOT opens AND i % 3 = 1 AND i % 4 <> 3
)
SELECT flow, node, property FROM refs
WHERE f IN (SELECT f FROM u WHERE opens)
  AND NOT EXISTS (SELECT 1 FROM u JOIN has USING (event) WHERE u.f = refs.f AND has.property = refs.property)""",
}
ORACLE["validation_summary"] = ORACLE["stream_validate_counts"]


def _rule_count(rule: str) -> str:
    hits = [f"CAST({cond.format(et='et')} AS INT)" for _, r, cond, _ in CHECKS_V1 if r == rule]
    return f"CAST(coalesce(sum({' + '.join(hits)}) FILTER (idok AND et <> 'error'), 0) AS BIGINT) AS rule_{rule}"


ORACLE["validate_salted"] = ORACLE["validate_events"]
ORACLE["event_metrics"] = _outcomes() + f"""
SELECT CASE WHEN status = 'error' THEN '' ELSE et END AS event, count(*) AS total, count(*) FILTER (status = 'valid') AS valid,
       count(*) FILTER (status = 'invalid') AS invalid, count(*) FILTER (status = 'error') AS error,
       {', '.join(map(_rule_count, ('type', 'required', 'min', 'max')))}
FROM v GROUP BY ALL"""
ORACLE["dlq_malformed"] = f"""WITH {EVENTS}
SELECT k AS qty, 'identity_required: no recognized identity properties found' AS errors FROM c"""
_GATES = ORACLE["bad_gate_refs"].replace("SELECT flow, node, property FROM refs", """SELECT 'gate', node,
  'flow ' || flow || ', node ' || node || ': property ' || property || ' is unknown to the events of the flow' FROM refs""")
ORACLE["lint_contract"] = _GATES + """
UNION ALL SELECT 'target', src, 'flow ' || flow || ': node ' || src || ': orphaned ' || kind || ' target ' || dst
FROM ed WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.flow = ed.flow AND nd.node = ed.dst)
UNION ALL SELECT 'event', node, 'node ' || node || ' of flow ' || flow || ' uses event ' || event || ', which the plan does not define'
FROM u WHERE event = 'error'
UNION ALL SELECT 'orphan', event, 'event ' || event || ' is used by no flow (orphan event)'
FROM (VALUES ('click'), ('view'), ('purchase'), ('signup')) x(event) WHERE event NOT IN (SELECT event FROM u WHERE event IS NOT NULL)"""
ORACLE["lint_contract"] = f"SELECT * FROM ({ORACLE['lint_contract']}) x(rule, subject, error)"

_MODEL = """
has(event, property) AS (
  SELECT event, property FROM (VALUES ('click'), ('view'), ('purchase'), ('signup')) a(event),
    (VALUES ('context.ip'), ('context.library.name'), ('properties.metadata.source')) b(property)
  UNION ALL VALUES ('click', 'properties.price'), ('click', 'properties.category'), ('view', 'properties.code'),
    ('purchase', 'properties.price'), ('purchase', 'properties.category'), ('purchase', 'properties.qty'), ('purchase', 'properties.tags'),
    ('purchase', 'properties.code'), ('purchase', 'userId'),
    ('signup', 'properties.price'), ('signup', 'properties.category'), ('signup', 'properties.qty'), ('signup', 'properties.tags'),
    ('signup', 'properties.code')
), held AS (
  SELECT et AS event, property, value, k, CASE property WHEN 'context.ip' THEN i % 23 <> 0 WHEN 'properties.metadata.source' THEN source IS NOT NULL
         WHEN 'userId' THEN uid IS NOT NULL ELSE TRUE END AS there
  FROM c JOIN has ON has.event = c.et
)
"""
ORACLE["typed_models_all"] = f"""WITH {EVENTS}, {_MODEL}
SELECT event, property, count(*) FILTER (there) AS held,
       round(CASE WHEN property = 'properties.price' THEN sum(value) END, 2) AS number_sum,
       CAST(CASE WHEN property = 'properties.qty' THEN sum(k) END AS BIGINT) AS whole_sum
FROM held GROUP BY event, property HAVING count(*) FILTER (there) > 0"""
ORACLE["null_counts_all"] = f"""WITH {EVENTS}, {_MODEL}
SELECT event, property, count(*) FILTER (NOT there) AS nulls, count(*) AS total FROM held
WHERE property IN ('context.ip', 'context.library.name', 'properties.metadata.source')
   OR event = 'purchase' AND property IN ('properties.price', 'userId') GROUP BY event, property"""
_SECOND = _outcomes(CHECKS_V2, known="et NOT IN ('error', 'view')")
ORACLE["reload_between_batches"] = f"""SELECT * FROM ({_outcomes()} SELECT i AS event_id, et AS event, status, errors FROM v WHERE i % 2 = 0)
UNION ALL SELECT * FROM ({_SECOND} SELECT i AS event_id, et AS event, status, errors FROM v WHERE i % 2 = 1)"""
_REPEATED = """concat_ws(';', CASE WHEN k % 5 = 4 THEN 'properties.category:enum' END,
  CASE WHEN i % 4 = 0 THEN 'properties.metadata.source:max_length' END, CASE WHEN i % 3 = 0 THEN 'properties.price:type' END)"""
ORACLE["validate_repeated_keys"] = f"""WITH {EVENTS}, x AS (SELECT i AS event_id, {_REPEATED} AS errors FROM c)
SELECT event_id, CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS status, errors,
       CASE WHEN errors = '' THEN 'valid' ELSE 'invalid' END AS data_status, errors AS data_errors FROM x"""
ORACLE["flatten_repeated_keys"] = """SELECT event_id,
  'properties.category,properties.metadata.medium,properties.metadata.source,properties.price' AS keys FROM events"""
ORACLE["validate_wide_contract"] = f"""WITH {EVENTS},
w AS (
  SELECT ['click', 'view', 'purchase', 'signup', 'error'][CAST(p_partkey % 5 + 1 AS INT)] AS et,
         's' || p_size || '_' || (p_partkey % 8) AS name, min(p_partkey) AS pk
  FROM part GROUP BY ALL
), given AS (
  SELECT i, 's' || ((i + 5 * j) % 50 + 1) || '_' || (j % 8) AS name, (i + j) % 2 = 0 AS numeric, k
  FROM e, (SELECT unnest(range(10)) AS j)
), met AS (
  SELECT e.i, e.et, pk, g.name IS NOT NULL AS there, g.numeric, g.k,
         there AND CASE WHEN pk % 3 = 1 THEN NOT g.numeric ELSE g.numeric END AS fits
  FROM e LEFT JOIN w ON w.et = e.et LEFT JOIN given g ON g.i = e.i AND g.name = w.name
), counted AS (
  SELECT i, et, CAST(count(*) FILTER (pk % 4 = 0 AND NOT there) AS INT) AS n_required, CAST(count(*) FILTER (there AND NOT fits) AS INT) AS n_type,
         CAST(count(*) FILTER (fits AND pk % 3 <> 1 AND k > 50 + pk % 50) AS INT) AS n_max,
         CAST(count(*) FILTER (fits AND pk % 3 = 1 AND length('v' || k) > 1 + pk % 3) AS INT) AS n_max_length
  FROM met GROUP BY i, et
)
SELECT i AS event_id, et AS event, CASE WHEN n_required + n_type + n_max + n_max_length = 0 THEN 'valid' ELSE 'invalid' END AS status,
       n_required, n_type, n_max, n_max_length FROM counted"""
ORACLE["outbox_redelivery"] = _outcomes() + """
SELECT k AS qty, CASE WHEN CAST(k AS VARCHAR) LIKE '1%' THEN 2 ELSE 1 END AS posts, 1 AS arrived FROM v WHERE status = 'invalid'"""
ORACLE["check_parity_ranges"] = ORACLE["check_parity"]
ORACLE["snapshots_saved_twice"] = """SELECT CASE WHEN event_id % 2 = 0 THEN 'sha_a' ELSE 'sha_b' END AS sha, event_type AS event_name,
       count(*) AS samples, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL"""
ORACLE["wide_models_read_back"] = f"""WITH {EVENTS}
SELECT et AS model, i AS event_id, k AS qty, value AS price, 'K' || k AS code, CASE WHEN i % 23 <> 0 THEN '10.0.0.1' END AS ip
FROM c WHERE et IN ('purchase', 'signup')"""
