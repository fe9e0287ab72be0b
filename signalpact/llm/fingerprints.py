"""Document fingerprints: invertible Bloom lookup tables of paragraph digests. Native: SQL functions only.

A table has three parts of four cells; a digest lies in one cell of each part. A cell holds a count and the
exclusive or of its digests and of their checks. Subtracting the tables of two versions cancels what both
have; peeling then takes out cells with a single digest, one after the other, until nothing is left. If
peeling gets stuck, the digests of both versions go into a larger table: blocks of twelve cells, dealt by
the digests' leading bits. Blocks that still get stuck are dealt further on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalpact.functions.paths import name
from signalpact.llm.text import table

PARTS, CELLS = 3, 4
#: Bits of a digest (15 hex digits of MD5), and those taken by one dealing into 8 blocks.
BITS, DEAL = 60, 3
#: Digests of both versions up to which a block is peeled at once.
LOAD = 8
#: Rows of a range of ids on average, and ranges at most.
RANGE_ROWS, RANGES = 4096, 4096
#: A sentence of a line; line ends, and the marks behind a sentence, end a paragraph.
PARAGRAPH = r"[^.!?\n]+[.!?]*|[.!?]+"
_ZERO = "named_struct('c', 0, 'k', 0L, 'h', 0L)"


def _check(key: str) -> str:
    """A check of a digest that is far from linear in its bits, so that a mixture of digests does not pass."""
    return f"(({key} % 2147483647L) * ({key} % 2147483629L))"


def _lies(key: str, part: str, cell: str) -> str:
    return f"(shiftright({key}, 20 * {part}) & {CELLS - 1}) = {cell}"


def digests(text: str) -> str:
    """Distinct digests of the paragraphs of a text."""
    found = f"filter(transform(regexp_extract_all({text}, r'{PARAGRAPH}', 0), p -> trim(p)), p -> p <> '')"
    return f"array_distinct(transform({found}, p -> cast(conv(substr(md5(cast(p AS binary)), 1, {BITS // 4}), 16, 10) AS bigint)))"


def sketch(items: str, key: str = "e", sign: str = "1") -> str:
    """Table of an array's digests; ``key`` and ``sign`` tell them of an item ``e``."""
    cells = [
        f"aggregate({items}, {_ZERO}, (x, e) -> IF({_lies(key, str(part), str(cell))}, named_struct("
        f"'c', x.c + {sign}, 'k', x.k ^ {key}, 'h', x.h ^ {_check(key)}), x))"
        for part in range(PARTS) for cell in range(CELLS)
    ]
    return f"array({', '.join(cells)})"


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells: str) -> str:
    """struct(ok, a, b) of a difference: whether it was resolved, and how many digests only a and only b has."""
    place = f"(i div {CELLS})", f"i % {CELLS}"
    single = f"abs(x.c) = 1 AND x.h = {_check('x.k')} AND {_lies('x.k', *place)}"
    pure = f"array_distinct(array_compact(transform(s.cells, (x, i) -> CASE WHEN {single} THEN named_struct('k', x.k, 'c', x.c) END)))"
    left = (f"transform(s.cells, (x, i) -> aggregate(p, x, (y, e) -> IF({_lies('e.k', *place)}, named_struct("
            f"'c', y.c - e.c, 'k', y.k ^ e.k, 'h', y.h ^ {_check('e.k')}), y)))")
    taken = (f"named_struct('cells', {left}, 'a', s.a + size(filter(p, e -> e.c = 1)), 'b', s.b + size(filter(p, e -> e.c = -1)), "
             "'go', size(p) > 0)")
    return (
        f"aggregate(sequence(0, {PARTS * CELLS}), named_struct('cells', {cells}, 'a', 0, 'b', 0, 'go', true), "
        f"(s, round) -> CASE WHEN s.go THEN transform(array({pure}), p -> {taken})[0] ELSE s END, "
        "s -> named_struct('ok', forall(s.cells, x -> x.c = 0 AND x.k = 0L AND x.h = 0L), 'a', s.a, 'b', s.b))"
    )


def resolve(a: str, b: str) -> str:
    """struct(ok, a, b) by larger tables, whatever the difference.

    A block of many digests is dealt into eight, others are peeled and dealt only if that fails. After
    BITS / DEAL dealings a block holds one digest, which always peels.
    """
    signed = f"concat(transform({a}, k -> named_struct('k', k, 's', 1)), transform({b}, k -> named_struct('k', k, 's', -1)))"
    tried = f"transform(s.todo, t -> named_struct('t', t, 'r', CASE WHEN size(t) <= {LOAD} THEN {peel(sketch('t', 'e.k', 'e.s'))} END))"
    dealt = (f"transform(sequence(0, 7), g -> filter(z.t, e -> (shiftright(e.k, {BITS - DEAL} - {DEAL} * level) & 7) = g))")
    step = (
        "named_struct('todo', filter(flatten(transform(filter(w, z -> NOT coalesce(z.r.ok, false)), z -> " + dealt + ")), t -> size(t) > 0), "
        "'a', s.a + aggregate(w, 0, (n, z) -> n + IF(coalesce(z.r.ok, false), z.r.a, 0)), "
        "'b', s.b + aggregate(w, 0, (n, z) -> n + IF(coalesce(z.r.ok, false), z.r.b, 0)))"
    )
    return (
        f"aggregate(sequence(0, {BITS // DEAL}), named_struct('todo', array({signed}), 'a', 0, 'b', 0), "
        f"(s, level) -> CASE WHEN size(s.todo) = 0 THEN s ELSE transform(array({tried}), w -> {step})[0] END, "
        "s -> named_struct('ok', size(s.todo) = 0, 'a', s.a, 'b', s.b))"
    )


def printed(cells: str) -> str:
    """A table as text: count, digests and checks of every cell, in hexadecimal."""
    return f"array_join(transform({cells}, x -> lower(concat(hex(x.c), '.', hex(x.k), '.', hex(x.h)))), '-')"


def likeness(a: str, difference: str) -> str:
    """Common digests by all digests; 1 if neither text has any."""
    every = f"(size({a}) + {difference}.b)"
    return f"IF({every} = 0, 1D, cast(size({a}) - {difference}.a AS double) / {every})"


def compare(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add a column per pair of digest columns (x, y): their likeness. Tables are the columns x_cells, y_cells.

    The fingerprints are subtracted and peeled first; only where this fails, larger tables follow.
    """
    columns = [name(c) for c in df.columns]
    first = df.selectExpr("*", *[f"{peel(subtract(f'{x}_cells', f'{y}_cells'))} AS {n}_first" for n, (x, y) in pairs.items()])
    then = first.selectExpr(*columns, *[f"CASE WHEN {n}_first.ok THEN {n}_first ELSE {resolve(x, y)} END AS {n}_difference" for n, (x, y) in pairs.items()])
    return then.selectExpr(*columns, *[f"{likeness(x, f'{n}_difference')} AS {n}" for n, (x, _) in pairs.items()])


def with_next(rows: DataFrame, carried: str) -> DataFrame:
    """``rows`` (id, ...) with ``next``: the column ``carried`` of the row that follows by id, after the last that of the first.

    Ids are dealt into ranges by their quantiles; the first row of a range is also sent to the range before.
    Rows of equal id follow one another by text. Nulls come first.
    """
    n = rows.count()
    ranges = min(max(1, -(-n // RANGE_ROWS)), RANGES)
    cuts = []
    if ranges > 1:
        shares = ", ".join(repr(i / ranges) for i in range(1, ranges))
        cuts = sorted(set(rows.selectExpr(f"percentile_approx(id, array({shares}), {20 * ranges}) AS cuts").first().cuts or []))
    wide = max(1, round(len(cuts) ** 0.5))  # cuts are looked up in two steps
    steps = [f"array({', '.join(f'{c}L' for c in cuts[i:i + wide])})" for i in range(0, len(cuts), wide)]
    if cuts:
        coarse = f"array({', '.join(f'{c}L' for c in cuts[::wide])})"
        placed = rows.selectExpr("*", f"size(filter({coarse}, c -> c <= id)) AS step").selectExpr(
            "*", f"CASE WHEN coalesce(step, 0) <= 0 THEN 0 ELSE (step - 1) * {wide} + size(filter(get(array({', '.join(steps)}), step - 1), c -> c <= id)) END AS place")
    else:
        placed = rows.selectExpr("*", "0 AS place")
    heads = placed.groupBy("place").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("head"))
    by = Window.orderBy("place")  # RANGES rows at most
    last = F.max("place").over(Window.partitionBy())
    heads = heads.select(F.col("place").alias("at"), F.col("head.id").alias("least"), F.coalesce(F.lag("place").over(by), last).alias("before"))
    sent = placed.join(F.broadcast(heads), placed.place == heads["at"]).selectExpr(
        *[name(c) for c in rows.columns],
        "explode(IF(id <=> least, array(named_struct('place', place, 'again', 0), named_struct('place', before, 'again', 1)), "
        "array(named_struct('place', place, 'again', 0)))) AS spot")
    order = Window.partitionBy("spot.place").orderBy("spot.again", F.col("id").asc_nulls_first(), "text")
    return sent.withColumn("next", F.lead(carried).over(order)).where("spot.again = 0").drop("spot")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the table of the text's distinct paragraph digests. The edited text has its last half
    replaced by as many first characters of the next document. Likeness is common digests by all digests,
    recovered by peeling; two texts without paragraphs have 1. A null text is empty; equal texts have equal
    fingerprints; rows that repeat an id follow one another by text; an empty table gives no rows; other
    columns are ignored. Ids must be whole numbers (null: before all others).
    """
    text = f"coalesce({name(text_col)}, '')"
    rows = docs.selectExpr(f"cast({name(id_col)} AS bigint) AS id", f"{text} AS text", f"{digests(text)} AS own").selectExpr("*", f"{sketch('own')} AS own_cells")
    placed = with_next(rows.selectExpr("*", "named_struct('text', text, 'own', own, 'cells', own_cells) AS all"), "all").drop("all")
    edited = placed.selectExpr(
        "id", "length(text) AS n", "own", "own_cells", "next.own AS after", "next.cells AS after_cells",
        "concat(left(text, length(text) - length(text) div 2), left(next.text, cast(length(text) div 2 AS int))) AS edited")
    known = edited.selectExpr("*", "sha2(edited, 256) AS edited_sha256", f"{digests('edited')} AS changed").selectExpr("*", f"{sketch('changed')} AS changed_cells")
    near = compare(known.drop("edited"), {"near_edited": ("own", "changed"), "near_next": ("own", "after")})
    return near.selectExpr(
        f"id AS {name(id_col)}", "cast(n AS bigint) AS n_chars", "edited_sha256", f"{printed('own_cells')} AS fingerprint",
        f"{printed('changed_cells')} AS edited_fingerprint", "near_edited", "near_next")


def op11_invertible_lookup_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their next documents."""
    return fingerprint(table(spark, sf_dir, "documents"))


def _keys_sql(text: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({text}, '{PARAGRAPH}'), lambda p: trim(p)), lambda p: p <> '')"
    return f"list_distinct(list_transform({found}, lambda p: CAST('0x' || substr(md5(p), 1, {BITS // 4}) AS BIGINT)))"


def _print_sql(keys: str) -> str:
    def xor(own: str, of: str) -> str:
        return f"list_reduce(list_prepend(0::BIGINT, list_transform({own}, lambda k: {of})), lambda a, b: xor(a, b))"

    cells = []
    for part in range(PARTS):
        for cell in range(CELLS):
            own = f"list_filter({keys}, lambda k: ((k >> {20 * part}) & {CELLS - 1}) = {cell})"
            cells.append(f"lower(hex(CAST(len({own}) AS BIGINT)) || '.' || hex({xor(own, 'k')}) || '.' || hex({xor(own, '(k % 2147483647) * (k % 2147483629)')}))")
    return " || '-' || ".join(cells)


def _near_sql(a: str, b: str) -> str:
    every = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {every} = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / {every} END"


OP11_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), following AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS other FROM base
), edited AS (
  SELECT *, substr(text, 1, n - n // 2) || substr(other, 1, n // 2) AS changed FROM following
), keyed AS (
  SELECT doc_id, n, sha256(changed) AS edited_sha256, {_keys_sql('text')} AS own, {_keys_sql('changed')} AS edit, {_keys_sql('other')} AS after FROM edited
)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, {_print_sql('own')} AS fingerprint, {_print_sql('edit')} AS edited_fingerprint,
       {_near_sql('own', 'edit')} AS near_edited, {_near_sql('own', 'after')} AS near_next
FROM keyed
"""
