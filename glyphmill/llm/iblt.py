"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A document's units are its lines, long ones cut every 32 words; their 64-bit digests are a set. A
sketch has three tables of cells, each with a count and the XOR of digests and of check values; every
digest is in one cell of each table. Cells of two sketches subtract. Peeling takes the digests out of
the cells that hold a single one until no cell is left, which recovers the digests in which the
documents differ, by side. The small sketch of the fingerprint is tried first; where it doesn't peel,
its counts say about how many digests differ, and sketches of that size are tried, each twice the last.

Sketches are sorted arrays of the cells in use. Adding, subtracting and peeling all put arrays of
cells together, sort them by place and merge neighbours, so the work is n log n in a document's units.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import Workspace, running

#: Cells a table of the fingerprint; rounds of peeling; sketches that are tried at most, each of twice the cells.
BASE, ROUNDS, TRIES = 8, 64, 24
WORDS = 32
_NAMES = itertools.count()


def _let(value: str, body) -> str:
    """body(name) with a name for a value that is computed once."""
    name = f"v{next(_NAMES)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _digests(text: str) -> str:
    return rf"array_distinct(transform(regexp_extract_all({text}, '(?:\\S++[^\\S\\n]*+){{1,{WORDS}}}+', 0), u -> xxhash64(rtrim(u))))"


def _cells(digest: str, sign: str, cells: str) -> str:
    """The three cells of a digest, one in each table."""
    place = lambda v: f"CAST({v} * {cells} + pmod(shiftrightunsigned(h, {21 * v}), {cells}) AS INT)"
    three = lambda x: ", ".join(f"named_struct('j', {place(v)}, 'c', {sign}, 'k', {digest}, 'x', {x})" for v in range(3))
    return f"element_at(transform(array(xxhash64({digest})), h -> " + _let(f"xxhash64({digest}, 1)", lambda x: f"array({three(x)})") + "), 1)"


def _merged(cells: str) -> str:
    """Cells of one place added up; sorted by place."""
    add = "(a, e) -> named_struct('j', a.j, 'c', a.c + e.c, 'k', a.k ^ e.k, 'x', a.x ^ e.x)"
    one = lambda o, s, n: f"if({n} = 1, get({o}, {s}), aggregate(slice({o}, {s} + 2, {n} - 1), get({o}, {s}), {add}))"
    groups = lambda o, b: f"transform({b}, (s, r) -> " + _let(f"coalesce(get({b}, r + 1), size({o})) - s", lambda n: one(o, "s", n)) + ")"
    begins = lambda o: f"filter(sequence(0, size({o}) - 1), i -> i = 0 OR get({o}, i).j <> get({o}, i - 1).j)"
    return _let(f"sort_array({cells})", lambda o: f"if(size({o}) = 0, {o}, " + _let(begins(o), lambda b: groups(o, b)) + ")")


def _sketch(digests: str, cells: str) -> str:
    """The cells in use of a set of digests."""
    return _merged(f"flatten(transform({digests}, d -> {_cells('d', '1', cells)}))")


def _less(a: str, b: str) -> str:
    """Sketch a without sketch b."""
    return _merged(f"concat({a}, transform({b}, e -> named_struct('j', e.j, 'c', -e.c, 'k', e.k, 'x', e.x)))")


def _peeled(sketch: str, cells: str) -> str:
    """named_struct(left, right): the digests that a difference of sketches holds of either side; NULL if it doesn't peel."""
    used = lambda x: f"filter({x}, e -> e.c <> 0 OR e.k <> 0 OR e.x <> 0)"
    pure = "array_distinct(transform(filter(z.cells, e -> abs(e.c) = 1 AND e.x = xxhash64(e.k, 1)), e -> named_struct('c', e.c, 'k', e.k)))"
    side = lambda p, c: f"transform(filter({p}, e -> e.c = {c}), e -> e.k)"
    taken = lambda p: f"flatten(transform({p}, f -> {_cells('f.k', '-f.c', cells)}))"
    step = _let(pure, lambda p: f"if(size({p}) = 0, named_struct('cells', z.cells, 'left', z.left, 'right', z.right, 'over', true), "
                f"named_struct('cells', {used(_merged(f'concat(z.cells, {taken(p)})'))}, 'left', concat(z.left, {side(p, 1)}), 'right', concat(z.right, {side(p, -1)}), 'over', false))")  # fmt: skip
    none = "CAST(array() AS ARRAY<BIGINT>)"
    begin = f"named_struct('cells', {used(sketch)}, 'left', {none}, 'right', {none}, 'over', false)"
    loop = f"aggregate(sequence(1, {ROUNDS}), {begin}, (z, i) -> if(z.over OR size(z.cells) = 0, z, {step}))"
    return _let(loop, lambda z: f"if(size({z}.cells) = 0, named_struct('left', {z}.left, 'right', {z}.right), NULL)")


def _expected(difference: str, a: str, b: str) -> str:
    """About how many digests differ, from the counts of the cells of the fingerprints' difference.

    The counts of a table spread about their mean by the number of digests that differ; each digest
    moves one count by one.
    """
    squares = f"aggregate({difference}, 0D, (t, e) -> t + e.c * e.c)"
    spread = f"({squares} / 3 - pow(size({a}) - size({b}), 2) / {BASE}) * {BASE / (BASE - 1)}"
    return f"greatest({spread}, CAST(abs(size({a}) - size({b})) AS DOUBLE), 4D)"


def _difference(a: str, b: str, sketch_a: str, sketch_b: str) -> str:
    """named_struct(left, right): the digests of only a and of only b, by their sketches.

    Sketches grow up to one cell a digest and table, where all but about one pair in millions peel, and
    then change by a cell a try; the sets are only compared should no try have peeled.
    """
    again = lambda m: _peeled(_less(_sketch(a, m), _sketch(b, m)), m)
    size = lambda d: f"CAST(least({BASE} + 0.6D * {d} * pow(2, t), {2 * BASE}D + size({a}) + size({b}) + t) AS INT)"
    kind = "STRUCT<left: ARRAY<BIGINT>, right: ARRAY<BIGINT>>"
    tries = lambda d: f"aggregate(sequence(0, {TRIES - 1}), CAST(NULL AS {kind}), (y, t) -> if(y IS NOT NULL, y, {_let(size(d), again)}))"
    exact = f"named_struct('left', array_except({a}, {b}), 'right', array_except({b}, {a}))"
    return _let(_less(sketch_a, sketch_b), lambda s: f"coalesce({_peeled(s, str(BASE))}, {_let(_expected(s, a, b), tries)}, {exact})")


def _likeness(a: str, b: str, difference: str) -> str:
    """|A and B| / |A or B| from the digests that differ; 1 for two empty sets."""
    sizes, d = f"(size({a}) + size({b}))", f"(size({difference}.left) + size({difference}.right))"
    return f"if({sizes} = 0, 1D, CAST({sizes} - {d} AS DOUBLE) / ({sizes} + {d}))"


def _text(sketch: str, digests: str) -> str:
    cell = "concat(lpad(lower(hex(e.j)), 2, '0'), lower(hex(e.c)), '.', lpad(lower(hex(e.k)), 16, '0'), lpad(lower(hex(e.x)), 16, '0'))"
    return f"concat(size({digests}), ':', array_join(transform({sketch}, e -> {cell}), ','))"


def _free(frame: DataFrame, *wanted: str) -> list[str]:
    """Names for columns in between that the frame doesn't have."""
    return [next(n for n in itertools.chain([w], (f"{w}{i}" for i in itertools.count())) if n.lower() not in {c.lower() for c in frame.columns}) for w in wanted]


def fingerprints(documents: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """The documents with ``column``: the sketch of each whole text as a string. Null counts as empty; a column of that name is replaced, all others stay."""
    digests, sketch = _free(documents, "_digests", "_sketch")
    made = documents.withColumn(digests, F.expr(_digests(f"coalesce({text}, '')")))
    made = made.withColumn(sketch, F.expr(_sketch(digests, str(BASE))))
    return made.withColumn(column, F.expr(_text(sketch, digests))).drop(digests, sketch)


def differences(pairs: DataFrame, left: str, right: str, column: str = "near") -> DataFrame:
    """The rows with ``column``, only_left and only_right: likeness (0 to 1) of the fingerprints of the texts
    ``left`` and ``right``, and the recovered digests of the paragraphs that only one of them has, sorted.

    Null counts as empty; columns of these names are replaced, all others stay.
    """
    a, b, s, t, d = _free(pairs, "_a", "_b", "_s", "_t", "_d")
    made = pairs.withColumn(a, F.expr(_digests(f"coalesce({left}, '')"))).withColumn(b, F.expr(_digests(f"coalesce({right}, '')")))
    made = made.withColumn(s, F.expr(_sketch(a, str(BASE)))).withColumn(t, F.expr(_sketch(b, str(BASE))))
    made = made.withColumn(d, F.expr(_difference(a, b, s, t)))
    found = {column: F.expr(_likeness(a, b, d)), "only_left": F.expr(f"sort_array({d}.left)"), "only_right": F.expr(f"sort_array({d}.right)")}
    return made.withColumns(found).drop(a, b, s, t, d)


def _followers(documents: DataFrame, work: Workspace) -> DataFrame:
    """(doc_id, next_id): the next smaller id, after the smallest the largest. Ids are numbered by a distributed sort."""
    ids = documents.where("doc_id IS NOT NULL").select("doc_id").distinct()
    ranked = running(ids, work, "ids", [F.col("doc_id")], {})
    total = ranked.agg(F.count("*").alias("total"))  # one row
    before = ranked.crossJoin(F.broadcast(total)).selectExpr("doc_id", "if(place = 0, total - 1, place - 1) AS place")
    return before.join(ranked.selectExpr("doc_id AS next_id", "place"), "place").select("doc_id", "next_id")


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row, and
    removed and added: the recovered digests of the paragraphs that the edit took out and put in.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document by descending doc_id; after the last comes the first, and a lone document follows
    itself. A null text is empty. A row without a doc_id has no next one: nothing replaces its end, and
    near_next is 0. Where rows share the next doc_id, the one with the least beginning is taken.
    """
    work = Workspace(documents.sparkSession, "iblt")
    k = "CAST(char_length(text) DIV 3 AS INT)"
    every = documents.selectExpr("doc_id", "coalesce(text, '') AS text")
    # both joins read one exchange of the texts, so only the beginnings are sent a second time
    docs = every.where("doc_id IS NOT NULL")
    owners = docs.selectExpr("doc_id", f"{k} AS k").distinct().join(_followers(documents, work), "doc_id").withColumnsRenamed({"doc_id": "owner", "k": "own_k"})
    begun = docs.join(owners, docs["doc_id"] == owners["next_id"])
    begun = begun.selectExpr("owner", "own_k", "named_struct('begin', left(text, own_k), 'digests', " + _digests("text") + ") AS p")
    begun = begun.repartition("owner").groupBy("owner", "own_k").agg(F.min("p").alias("p"))
    rows = docs.join(begun, (docs["doc_id"] == begun["owner"]) & F.expr(f"{k} - own_k = 0"), "left").select("doc_id", "text", "p")
    alone = every.where("doc_id IS NULL").withColumn("p", F.lit(None).cast(begun.schema["p"].dataType))
    rows = rows.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.selectExpr("doc_id", "n_chars", "text", f"concat(left(text, CAST(n_chars - {k} AS INT)), coalesce(p.begin, '')) AS edited", "p.digests AS c")
    rows = rows.withColumn("a", F.expr(_digests("text"))).withColumn("b", F.expr(_digests("edited")))
    rows = rows.selectExpr("doc_id", "n_chars", "sha2(edited, 256) AS edited_sha256", "a", "b", "c", "coalesce(c, CAST(array() AS ARRAY<BIGINT>)) AS d")
    rows = rows.withColumns({f"s{x}": F.expr(_sketch(x, str(BASE))) for x in "abd"})
    rows = rows.withColumns({"edit": F.expr(_difference("a", "b", "sa", "sb")), "next": F.expr(f"if(c IS NULL, NULL, {_difference('a', 'd', 'sa', 'sd')})")})
    changed = "array_join(transform(sort_array(edit.{0}), d -> lpad(lower(hex(d)), 16, '0')), ',')"
    return rows.selectExpr(
        "doc_id", "n_chars", "edited_sha256", f"{_text('sa', 'a')} AS fingerprint", f"{_text('sb', 'b')} AS edited_fingerprint",
        f"{_likeness('a', 'b', 'edit')} AS near_edited", f"if(c IS NULL, 0D, {_likeness('a', 'd', 'next')}) AS near_next",
        f"{changed.format('left')} AS removed", f"{changed.format('right')} AS added",
    )
