"""Queries over the standard tables: each runs one operator on structured text that is made from table columns.

The SQL beside each query says the expected rows by construction from the same columns; it knows nothing
of the parsers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as fx
from glyphmill.functions.udfs import escape_special, exploded, scalar, unescape_special
from glyphmill.operators import backfill, batches, extraction, mapping, pool, translation
from glyphmill.parse import anvil, component, njson, nbt, pointer, rules, snbt, textmodel
from glyphmill.parse.tree import Num
from glyphmill.plans import catalog
from glyphmill.plans.patterns import Condition, PointerPattern, any_match, first_match_index
from glyphmill.sources import world

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- pools, mappings, batches -----------------------------------------------------------------------


@query("SELECT DISTINCT text FROM documents WHERE text IS NOT NULL")
def pool_distinct(spark, sf):
    return pool.text_pool(_t(spark, sf, "documents"), "text")


@query("SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE conv_id % 2 = 0 AND text IS NOT NULL)")
def missing_pool(spark, sf):
    said = _t(spark, sf, "conversations")
    known = said.where("conv_id % 2 = 0").selectExpr("text AS source", "CAST(NULL AS STRING) AS target")
    return pool.missing_pool(pool.text_pool(said, "text"), known)


_FORMAT = "CASE WHEN doc_id % 3 = 0 THEN 'json_str' ELSE 'plain_str' END"


@query(
    f"""WITH pool AS (SELECT {_FORMAT} AS format, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text FROM documents),
    cache AS (SELECT 'json_str' AS format, text FROM documents WHERE doc_id % 5 = 0)
    SELECT DISTINCT format, text FROM pool p WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.format = p.format AND c.text = p.text)"""
)
def cache_skip_by_format(spark, sf):
    docs = _t(spark, sf, "documents")
    texts = docs.selectExpr(f"{_FORMAT} AS format", "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text")
    return pool.to_translate(texts, docs.where("doc_id % 5 = 0").selectExpr("'json_str' AS format", "text AS source"))


_MAP = "SELECT concat(p_name, '#', p_partkey) AS source, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_type, ':', p_brand) END AS target FROM part WHERE p_partkey % 2 = 0"


def _part_map(spark, sf):
    return _t(spark, sf, "part").where("p_partkey % 2 = 0").selectExpr("concat(p_name, '#', p_partkey) AS source", "CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_type, ':', p_brand) END AS target")


@query(
    f"""WITH m AS ({_MAP}) SELECT l_orderkey, l_linenumber, content, target AS replacement
    FROM (SELECT l_orderkey, l_linenumber, concat(p_name, '#', p_partkey) AS content FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN m ON content = source WHERE target IS NOT NULL"""
)
def mapping_lookup(spark, sf):
    leaves = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.expr("l_partkey = p_partkey")).selectExpr("l_orderkey", "l_linenumber", "concat(p_name, '#', p_partkey) AS content")
    return mapping.lookup(leaves, _part_map(spark, sf))


@query(
    f"""WITH m AS ({_MAP}) SELECT p_brand, count(*) FILTER (target IS NOT NULL) AS translated, count(*) FILTER (source IS NOT NULL AND target IS NULL) AS untranslatable,
    count(*) FILTER (source IS NULL) AS missing FROM part LEFT JOIN m ON concat(p_name, '#', p_partkey) = source GROUP BY p_brand"""
)
def mapping_counts(spark, sf):
    texts = _t(spark, sf, "part").selectExpr("p_brand", "concat(p_name, '#', p_partkey) AS text")
    return mapping.counts(texts, _part_map(spark, sf), "p_brand")


@query(
    f"""WITH m AS ({_MAP}), n AS (SELECT concat(p_name, '#', p_partkey) AS source, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS target FROM part WHERE p_partkey % 3 = 0)
    SELECT coalesce(n.source, m.source) AS source, CASE WHEN n.source IS NOT NULL THEN n.target ELSE m.target END AS target FROM m FULL JOIN n ON m.source = n.source"""
)
def mapping_merge(spark, sf):
    later = _t(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("concat(p_name, '#', p_partkey) AS source", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_name END AS target")
    return mapping.merged(_part_map(spark, sf), later)


_GROUPS = "SELECT concat('pack', l_suppkey % 5) AS source, concat('f', l_partkey % 300, '.json') AS path, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS flag FROM lineitem"


@query(f"WITH g AS ({_GROUPS}) SELECT source, path, max(ord) AS ord FROM g GROUP BY source, path")
def replacement_groups(spark, sf):
    rows = _t(spark, sf, "lineitem").selectExpr("concat('pack', l_suppkey % 5) AS source", "concat('f', l_partkey % 300, '.json') AS path", "l_orderkey * 10 + l_linenumber AS ord", "l_returnflag AS flag")
    return mapping.last_group_per_path(rows).select("source", "path", "ord").distinct()


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS "start", l_linenumber * 10 + CAST(l_quantity AS INT) % 13 AS "end" FROM lineitem),
    w AS (SELECT *, lag("end") OVER (PARTITION BY l_orderkey ORDER BY "start", "end") AS before FROM s) SELECT l_orderkey, "start", "end" FROM w WHERE "start" <= before"""
)
def overlap_detect(spark, sf):
    spans = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber * 10 AS start", "l_linenumber * 10 + CAST(l_quantity AS INT) % 13 AS end")
    return mapping.overlapping(spans, "l_orderkey")


_FROM = "SELECT concat('key.', p_partkey) AS key, p_name AS value, p_partkey AS ord FROM part WHERE p_size <> 7"
_TO = "SELECT concat('key.', p_partkey) AS key, concat('to ', p_type, p_size) AS value, p_partkey AS ord FROM part WHERE p_brand <> 'Brand#12'"


@query(f"WITH f AS ({_FROM}), t AS ({_TO}), j AS (SELECT coalesce(f.value, t.key) AS source, t.value AS target, t.ord FROM t LEFT JOIN f ON f.key = t.key) SELECT source, arg_max(target, ord) AS target FROM j GROUP BY source")
def lang_combine(spark, sf):
    """Each language lacks the keys of some parts: those of one size, and those of one brand."""
    part = _t(spark, sf, "part")
    source = part.where("p_size <> 7").selectExpr("concat('key.', p_partkey) AS key", "p_name AS value", "p_partkey AS ord")
    target = part.where("p_brand <> 'Brand#12'").selectExpr("concat('key.', p_partkey) AS key", "concat('to ', p_type, p_size) AS value", "p_partkey AS ord")
    return mapping.language_pairs(source, target)


@query(
    """WITH RECURSIVE t AS (SELECT source, doc_id, CAST(floor(length(text) / 1.5) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    c AS (SELECT source, doc_id, tokens, n, CAST(0 AS BIGINT) AS chunk, tokens AS total FROM t WHERE n = 1
    UNION ALL SELECT t.source, t.doc_id, t.tokens, t.n, c.chunk + CASE WHEN c.total > 0 AND c.total + t.tokens > 2048 THEN 1 ELSE 0 END,
    CASE WHEN c.total > 0 AND c.total + t.tokens > 2048 THEN t.tokens ELSE c.total + t.tokens END FROM c JOIN t ON t.source = c.source AND t.n = c.n + 1)
    SELECT source, doc_id, tokens, chunk FROM c"""
)
def greedy_chunks(spark, sf):
    return batches.greedy_chunks(_t(spark, sf, "documents"), "source", "doc_id")


_TERM_LIST = ("THE ", "token", "License", "und", "Que", "entr", "of thE")


@query("SELECT doc_id, term FROM documents JOIN (VALUES " + ", ".join(f"('{t}')" for t in _TERM_LIST) + ") v(term) ON contains(lower(text), lower(term))")
def term_match(spark, sf):
    return batches.applicable_terms(_t(spark, sf, "documents"), list(_TERM_LIST), "doc_id")


# --- scalar functions -------------------------------------------------------------------------------

_MIXED = "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '-- 12 !' ELSE '日本' END AS t FROM events"


def _mixed(spark, sf):
    return _t(spark, sf, "events").selectExpr("event_id AS id", "CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN CAST(value AS STRING) WHEN 2 THEN '-- 12 !' ELSE '日本' END AS t")


@query(f"SELECT id FROM ({_MIXED}) WHERE id % 4 IN (0, 3)")
def readable_filter(spark, sf):
    return _mixed(spark, sf).where(fx.readable(F.col("t"))).select("id")


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def blank_filter(spark, sf):
    rows = _t(spark, sf, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN ' \t\n' WHEN 1 THEN props ELSE event_type END AS t")
    return rows.where(fx.not_blank(F.col("t"))).select("event_id")


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS is_id FROM part")
def namespaced_id(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('minecraft:', lower(p_type)) WHEN 1 THEN p_type ELSE concat(p_name, ':', p_type) END AS t")
    return rows.select("p_partkey", fx.is_namespaced_id(F.col("t")).alias("is_id"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS is_key FROM part")
def translate_key(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN concat('item.', lower(p_type), '.name') WHEN 1 THEN concat('a.b', p_size) WHEN 2 THEN p_name ELSE concat('.', p_type) END AS t")
    return rows.select("p_partkey", fx.is_translate_key(F.col("t")).alias("is_key"))


@query("SELECT doc_id, replace(text, chr(10), '↠nl↠') AS hidden, text AS shown FROM documents")
def newline_sentinel(spark, sf):
    docs = _t(spark, sf, "documents")
    return docs.select("doc_id", fx.hide_newlines(F.col("text")).alias("hidden"), fx.show_newlines(fx.hide_newlines(F.col("text"))).alias("shown"))


@query("SELECT p_partkey, concat(p_name, '$UNICODE_E001$', p_type, '$UNICODE_200B$', chr(10), '$UNICODE_0009$') AS escaped, concat(p_name, chr(57345), p_type, chr(8203), chr(10), chr(9)) AS unescaped FROM part")
def unicode_escape(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, '', p_type, '​', '\n', '\t') AS t").withColumn("escaped", scalar(escape_special, "string", "t"))
    return rows.select("p_partkey", "escaped", scalar(unescape_special, "string", "escaped").alias("unescaped"))


@query(r"""SELECT p_partkey, concat('"', p_name, '\"\n\\', p_type, '"') AS quoted, concat('''', p_name, '\''', '''') AS single, concat(p_name, '"', chr(10), '\', p_type) AS back FROM part""")
def quote_unquote(spark, sf):
    t = F.concat("p_name", F.lit('"\n\\'), "p_type")
    rows = _t(spark, sf, "part").select("p_partkey", fx.double_quoted(t).alias("quoted"), fx.single_quoted(F.concat("p_name", F.lit("'"))).alias("single"))
    return rows.withColumn("back", fx.double_unquoted(F.col("quoted")))


@query("SELECT doc_id, CAST(floor(length(text) / 1.5) AS INT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", fx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS name, CASE WHEN page_id % 2 = 0 THEN 'json' ELSE '' END AS ext FROM (SELECT page_id, concat('data/x.y/f', page_id, CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '' END) AS p FROM pages)")
def path_parts(spark, sf):
    rows = _t(spark, sf, "pages").selectExpr("page_id", "concat('data/x.y/f', page_id, CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '' END) AS p")
    return rows.select("page_id", fx.file_name(F.col("p")).alias("name"), fx.extension(F.col("p")).alias("ext"))


# --- pointers ---------------------------------------------------------------------------------------

_POINTERS = """SELECT l_orderkey, l_linenumber, concat(CASE WHEN l_partkey % 3 = 0 THEN '>#Entities>' ELSE '>#block_entities>' END, l_linenumber,
 CASE l_suppkey % 4 WHEN 0 THEN '>#CustomName' WHEN 1 THEN '>#text' WHEN 2 THEN '>#front_text>#messages' ELSE '>#Pos' END) AS pointer FROM lineitem"""


def _pointers(spark, sf):
    names = F.expr("CASE l_suppkey % 4 WHEN 0 THEN array('CustomName') WHEN 1 THEN array('text') WHEN 2 THEN array('front_text', 'messages') ELSE array('Pos') END")
    head = F.when(F.col("l_partkey") % 3 == 0, F.lit("Entities")).otherwise(F.lit("block_entities"))
    tail = F.aggregate(names, F.lit(""), lambda a, x: F.concat(a, fx.pointer_key(x)))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(fx.pointer_key(head), fx.pointer_index(F.col("l_linenumber")), tail).alias("pointer"))


@query("SELECT p_partkey, concat('>#', replace(p_name, ' ', '&>'), '>', p_size, '>#', p_brand) AS pointer, replace(p_name, ' ', '>') AS first_key, concat(p_size, '') AS second FROM part")
def pointer_encode(spark, sf):
    part = _t(spark, sf, "part").withColumn("k", F.translate("p_name", " ", ">"))
    made = part.select("p_partkey", F.concat(fx.pointer_key(F.col("k")), fx.pointer_index(F.col("p_size")), fx.pointer_key(F.col("p_brand"))).alias("pointer"))
    return made.select("p_partkey", "pointer", scalar(lambda x: str(pointer.decode(x)[0]), "string", "pointer").alias("first_key"), scalar(lambda x: str(pointer.decode(x)[1]), "string", "pointer").alias("second"))


@query(f"SELECT l_orderkey, l_linenumber FROM ({_POINTERS}) WHERE pointer LIKE '%>#CustomName'")
def pointer_right(spark, sf):
    return _pointers(spark, sf).where(PointerPattern("right", ">#CustomName").column(F.col("pointer"))).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({_POINTERS}) WHERE pointer LIKE '>#Entities>%' AND pointer LIKE '%>#text'")
def pointer_regex(spark, sf):
    return _pointers(spark, sf).where(PointerPattern("regex", r">#Entities>\d+>#text$").column(F.col("pointer"))).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({_POINTERS}) WHERE pointer = '>#Entities>3>#CustomName'")
def pointer_equal(spark, sf):
    return _pointers(spark, sf).where(PointerPattern("equal", ">#Entities>3>#CustomName").column(F.col("pointer"))).select("l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber FROM ({_POINTERS}) WHERE pointer NOT LIKE '%>#Pos'")
def pointer_negative(spark, sf):
    return _pointers(spark, sf).where(PointerPattern("right", ">#Pos", negative=True).column(F.col("pointer"))).select("l_orderkey", "l_linenumber")


@query(
    f"""SELECT l_orderkey, l_linenumber, pointer LIKE '%>#CustomName' OR (pointer LIKE '>#Entities>%' AND pointer LIKE '%>#text') OR (pointer LIKE '>#block%' AND pointer LIKE '%>#messages') AS matched,
    CASE WHEN pointer LIKE '%>#messages' THEN 0 WHEN pointer LIKE '>#Ent%' THEN 1 WHEN pointer LIKE '%>#CustomName' THEN 2 END AS first FROM ({_POINTERS})"""
)
def pointer_first_match(spark, sf):
    own = [PointerPattern("right", ">#messages"), PointerPattern("regex", "^>#Ent"), PointerPattern("right", ">#CustomName")]
    return _pointers(spark, sf).select("l_orderkey", "l_linenumber", any_match(catalog.NBT, F.col("pointer")).alias("matched"), first_match_index(own, F.col("pointer")).alias("first"))


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY pointer, l_linenumber) AS place FROM ({_POINTERS})")
def pointer_sort(spark, sf):
    from pyspark.sql import Window

    return _pointers(spark, sf).select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("pointer", "l_linenumber")).alias("place"))


# --- commands ---------------------------------------------------------------------------------------


def _spans(spark, sf, made: str, *keys: str, table: str = "part") -> DataFrame:
    rows = _t(spark, sf, table).selectExpr(*keys, f"{made} AS line")
    return extraction.command_spans(rows, "line").drop("line", "ordinal")


def _span_sql(start: str, content: str, syntax: str, fmt: str, keys: str = "p_partkey", table: str = "part", where: str = "TRUE") -> str:
    syntax = f"'{syntax}'" if syntax else "CAST(NULL AS VARCHAR)"
    return f'SELECT {keys}, CAST({start} AS INT) AS "start", CAST({start} + length({content}) - 1 AS INT) AS "end", {content} AS content, {syntax} AS syntax, \'{fmt}\' AS format FROM {table} WHERE {where}'


@query(_span_sql("4", "p_name", "", "plain_str"))
def cmd_say_greedy(spark, sf):
    return _spans(spark, sf, "concat('say ', p_name)", "p_partkey")


_TELL = """concat('{"text":"', p_name, '","color":"red"}')"""


@query(_span_sql("11", _TELL, "", "json_str"))
def cmd_tellraw(spark, sf):
    return _spans(spark, sf, f"concat('tellraw @a ', {_TELL})", "p_partkey")


@query(_span_sql("15", "p_type", "", "plain_str"))
def cmd_title_plain_fallback(spark, sf):
    return _spans(spark, sf, "concat('title @a title ', p_type)", "p_partkey")


@query(_span_sql("28 + length(CAST(p_size AS VARCHAR))", "p_name", "", "plain_str"))
def cmd_execute_run(spark, sf):
    return _spans(spark, sf, "concat('execute as @e', p_size, ' at @s run say ', p_name)", "p_partkey")


@query("""SELECT p_partkey, p_partkey % 3 = 0 AS is_macro, 'say' AS name, CAST(CASE WHEN p_partkey % 3 = 2 THEN 6 ELSE 5 END AS INT) AS first, split_part(p_name, ' ', 1) AS argument FROM part""")
def cmd_macro_slash(spark, sf):
    """A macro's dollar, a slash or white space before the name: where the first argument then starts."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat(CASE p_partkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '/' ELSE '  ' END, 'say ', p_name) AS line")
    return extraction.parsed_commands(rows, "line").select("p_partkey", "is_macro", "name", F.col("starts")[0].alias("first"), F.col("args")[0].alias("argument"))


@query("SELECT p_partkey, 'tell' AS name FROM part WHERE p_partkey % 4 = 3")
def cmd_comment_skip(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat(CASE p_partkey % 4 WHEN 0 THEN '# ' WHEN 1 THEN '\\\\' WHEN 2 THEN '$ ' ELSE '' END, 'tell @a ', p_name) AS line")
    return extraction.parsed_commands(rows, "line").select("p_partkey", "name")


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0")
def cmd_bad_close_skip(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('setblock {a:', CASE WHEN p_partkey % 2 = 0 THEN '[1]' ELSE '[1' END, '} ', p_type) AS line")
    return extraction.parsed_commands(rows, "line").select("p_partkey")


@query("""SELECT p_partkey, 3 AS argc, concat('{a:"', p_name, '",b:[1, 2]}') AS second, concat('"', p_name, ' \\" x"') AS third FROM part""")
def cmd_arg_split(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", r"""concat('c ', p_type, ' {a:"', p_name, '",b:[1, 2]} "', p_name, ' \\" x"') AS line""")
    made = extraction.parsed_commands(rows, "line")
    return made.select("p_partkey", F.size("args").alias("argc"), F.col("args")[1].alias("second"), F.col("args")[2].alias("third"))


@query(_span_sql("13", "concat('\"', p_name, '\"')", "DoubleQuoteString", "plain_str", where="p_partkey % 2 = 0") + " UNION ALL " + _span_sql("14", "p_type", "LiteralString", "plain_str", where="p_partkey % 2 = 1"))
def selector_name(spark, sf):
    return _spans(spark, sf, "concat('kill @e[name=', CASE WHEN p_partkey % 2 = 0 THEN concat('\"', p_name, '\"') ELSE concat('!', p_type) END, ',limit=1]')", "p_partkey")


@query(_span_sql("34", "concat('''', p_name, '''')", "SingleQuoteString", "snbt_str"))
def item_stack_new(spark, sf):
    return _spans(spark, sf, """concat("give @s minecraft:stick[item_name='", p_name, "',damage=3]")""", "p_partkey")


@query(_span_sql("28", "concat('\"', p_name, '\"')", "DoubleQuoteString", "snbt_str"))
def item_stack_old(spark, sf):
    return _spans(spark, sf, "concat('give @p stick{display:{Name:\"', p_name, '\"}}')", "p_partkey")


@query(_span_sql("43", "concat('\"', p_name, '\"')", "DoubleQuoteString", "snbt_str"))
def block_nbt(spark, sf):
    return _spans(spark, sf, "concat('data merge entity @s {Tags:[a],CustomName: \"', p_name, '\"}')", "p_partkey")




@query("SELECT p_partkey, p_size % 4 + 1 <= 3 AS most, p_size % 4 + 1 = 3 AS exactly FROM part")
def with_size_bound(spark, sf):
    rows = extraction.parsed_commands(_t(spark, sf, "part").selectExpr("p_partkey", "concat('c', repeat(' x', p_size % 4 + 1)) AS line"), "line")
    most, exact = Condition("with_size", number=3), Condition("with_size", number=3, strict=True)
    return rows.select("p_partkey", most.column(F.col("raw"), F.col("args")).alias("most"), exact.column(F.col("raw"), F.col("args")).alias("exactly"))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_type LIKE '%O%'")
def command_conditions(spark, sf):
    rows = extraction.parsed_commands(_t(spark, sf, "part").selectExpr("p_partkey", "concat('c ', CASE WHEN p_size % 2 = 0 THEN 'set' ELSE 'get' END, ' ', p_type) AS line"), "line")
    wanted = Condition("and", (Condition("at", (Condition("equal", text="set"),), number=1), Condition("none", (Condition("at", (Condition("regex", text="^[^O]*$"),), number=2),))))
    return rows.where(wanted.column(F.col("raw"), F.col("args"))).select("p_partkey")


# --- SNBT, JSON, components -------------------------------------------------------------------------


@query("SELECT p_partkey, p_size AS b, p_size * 100 AS s, p_partkey AS i, p_partkey * 10000000000 AS l, p_retailprice AS d, 'byte short int long double' AS kinds FROM part")
def snbt_numbers(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('{b:', p_size, 'b, s:', p_size * 100, 'S,i:', p_partkey, ',l:', p_partkey * 10000000000, 'L,d:', p_retailprice, '}') AS t")

    def run(text):
        tree = snbt.to_tree(snbt.parse(text))
        yield {k: v.value for k, v in tree.items()} | {"kinds": " ".join(v.kind for v in tree.values())}

    return exploded(rows, run, "b long, s long, i long, l long, d double, kinds string", "t").drop("t")


@query("""SELECT p_partkey, concat('{"a":"', p_name, ' ''s \\"q\\"","b":["', p_type, '"]}') AS standard FROM part""".replace('\\\\"', '\\"'))
def njson_standardize(spark, sf):
    rows = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit("{'a':'"), "p_name", F.lit(" \\'s \"q\"','b':[\""), "p_type", F.lit('"]}')).alias("t"))
    return rows.select("p_partkey", scalar(lambda x: njson.standardize(x, njson.FILE), "string", "t").alias("standard"))


_JSON = """concat('{"display":{"title":"', p_name, '","size":', p_size, ',"other":"', p_brand, '"},"lines":[1,"', p_type, '"], "extra_": {"text":"', p_name, '"},}')"""


@query("""SELECT p_partkey, '>#display>#title' AS pointer, p_name AS content, 'plain_str' AS format FROM part UNION ALL SELECT p_partkey, '>#display>#other', p_brand, 'plain_str' FROM part
UNION ALL SELECT p_partkey, '>#lines>1', p_type, 'plain_str' FROM part UNION ALL SELECT p_partkey, '>#extra_', concat('{"text":"', p_name, '"}'), 'json_obj' FROM part""")
def json_leaves(spark, sf):
    everything = catalog.builtin().with_custom("replace", mcjson=None)
    rows = _t(spark, sf, "part").selectExpr("p_partkey", f"{_JSON} AS t")
    return extraction.json_leaves(rows, "t", everything).select("p_partkey", F.col("outer_pointer").alias("pointer"), "content", "format")


@query("SELECT p_partkey, '>#display>#title' AS pointer, p_name AS content FROM part")
def json_extract(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", f"{_JSON} AS t")
    return extraction.json_leaves(rows, "t").select("p_partkey", F.col("outer_pointer").alias("pointer"), "content")


@query("""SELECT p_partkey, '>#functions>0>#tag' AS outer_pointer, '>#display>#Name' AS inner_pointer, p_name AS content FROM part""")
def structure_in_json(spark, sf):
    """SNBT inside JSON: the tag of a loot table's function."""
    rows = _t(spark, sf, "part").select("p_partkey", F.concat(F.lit('{"functions":[{"function":"minecraft:set_nbt","tag":"{display:{Name:\''), "p_name", F.lit("'},x:1s}\"}]}")).alias("t"))
    return extraction.json_leaves(rows, "t").select("p_partkey", "outer_pointer", "inner_pointer", "content")


_STRIP_IN = """CASE p_partkey % 5 WHEN 0 THEN concat('{"text":"', p_name, '","color":"red"}') WHEN 1 THEN '{"translate":"item.name"}' WHEN 2 THEN concat('[{"text":"', p_type, '"}]')
 WHEN 3 THEN concat('{"text":"', p_size, '"}') ELSE concat('{"text":"', p_name, '","extra":["', p_type, '"]}') END"""


@query(
    f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'simplified' WHEN 1 THEN 'untranslatable' WHEN 2 THEN 'simplified' WHEN 3 THEN 'untranslatable' ELSE 'cannot_strip' END AS strip_kind,
    CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 2 THEN p_type ELSE {_STRIP_IN} END AS strip_text, p_partkey % 5 = 2 AS is_single_list FROM part"""
)
def strip_component(spark, sf):
    return translation.stripped(_t(spark, sf, "part").selectExpr("p_partkey", f"{_STRIP_IN} AS t", "'json_str' AS f"), "t", "f").drop("t", "f")


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat('{"text":"', p_brand, '","color":"red"}') WHEN 2 THEN concat('[{"text":"', p_brand, '"}]') ELSE p_brand END AS target FROM part"""
)
def destrip_component(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", f"{_STRIP_IN} AS t", "'json_str' AS f", "p_brand AS new")
    return translation.destripped(rows, "t", "f", "new").select("p_partkey", "target")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS is_component, p_partkey % 4 IN (0, 1, 2) AS has_field, p_partkey % 4 IN (0, 1) AS has_text FROM part")
def component_flags(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", """CASE p_partkey % 4 WHEN 0 THEN concat('{"text":"', p_name, '"}') WHEN 1 THEN '{"translate":"a.b"}' WHEN 2 THEN concat('{"text":{"text":"', p_name, '"}}') ELSE concat('{"n":', p_size, '}') END AS t""")
    is_component = scalar(lambda x: component.is_component(component.read_json(x)), "boolean", "t")

    def has_text(x: str) -> bool:
        tree = component.read_json(x)
        return component.is_component(tree) and textmodel.has_text(textmodel.read(tree))

    return rows.select("p_partkey", is_component.alias("is_component"), fx.has_component_field(F.col("t")).alias("has_field"), scalar(has_text, "boolean", "t").alias("has_text"))


# --- rules and the model's protocol -----------------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT p_brand, substring(p_brand, 7) AS n FROM part) SELECT concat('{"text":"', p_brand, '"}') AS source, CASE WHEN CAST(n AS INT) % 2 = 0 THEN concat('{"text":"Mark ', n, '"}') END AS target FROM b
UNION ALL SELECT concat(p_brand, ' raw (x)'), CASE WHEN CAST(n AS INT) % 2 = 0 THEN concat(n, ' done') END FROM b""")
def mtlx_translate(spark, sf):
    """A rule book for the brands of even numbers, by component and by raw text."""
    part = _t(spark, sf, "part")
    numbers = range(0, 100, 2)
    body = "\n".join(f"|Brand#{n}| ==> |Mark {n}|" for n in numbers)
    raw = "\n".join(f"|Brand#{n} raw (x)| ==> |{n} done|" for n in numbers)
    book = rules.RuleBook.read(f"---mtl---\n{body}\n---raw---\n{raw}\n")
    texts = part.select(F.concat(F.lit('{"text":"'), "p_brand", F.lit('"}')).alias("text")).unionByName(part.select(F.concat("p_brand", F.lit(" raw (x)")).alias("text"))).distinct()
    return translation.by_rules(texts, book)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('|', p_name, '&|&&|') END AS shape FROM part""")
def mtlx_template(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", """CASE WHEN p_partkey % 2 = 0 THEN concat('{"text":"', p_name, '|&"}') ELSE concat('{"translate":"', p_name, '"}') END AS t""")
    return rows.select("p_partkey", scalar(rules.key, "string", "t").alias("shape"))


@query("SELECT o_orderkey, CAST(i AS INT) AS i, CASE WHEN i <> 1 THEN concat(o_orderpriority, i) END AS translated FROM orders, (VALUES (0), (1), (2)) v(i) WHERE o_orderkey % 3 <> 0")
def response_parse(spark, sf):
    head = f"CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '{translation.TRANSLATED}' END"
    text = f"concat({head}, '\n[2] ', o_orderpriority, '2\n[0] old\n[0] ', o_orderpriority, '0\n{translation.TERMS}\n{{\"a\": \"b\"}}\n{translation.END}')"
    rows = _t(spark, sf, "orders").selectExpr("o_orderkey", f"{text} AS r", "3 AS n")
    return translation.response_lines(rows, "r", "n").drop("r", "n")


# --- back-fill --------------------------------------------------------------------------------------


@query("""SELECT p_partkey, concat('say {X', p_size, '} and "', p_brand, '"') AS filled FROM part""")
def backfill_spans(spark, sf):
    rows = _t(spark, sf, "part").selectExpr(
        "p_partkey", "concat('say ', p_name, ' and ', p_type) AS t",
        "array(named_struct('start', 9 + length(p_name), 'end', 8 + length(p_name) + length(p_type), 'replacement', p_brand, 'syntax', 'LiteralString'), named_struct('start', 4, 'end', 3 + length(p_name), 'replacement', concat('{X', p_size, '}'), 'syntax', CAST(NULL AS STRING))) AS s",
    )
    return backfill.filled_commands(rows, "t", "s").select("p_partkey", "filled")


@query("""SELECT p_partkey, concat('{"display":{"title":"new ', p_brand, '","size":', p_size, ',"other":"', p_brand, '"},"lines":[1,"', p_type, '"],"extra_":{"text":"', p_type, '"}}') AS filled FROM part""")
def json_backfill(spark, sf):
    new = "array(named_struct('pointer', '>#display>#title', 'format', 'plain_str', 'replacement', concat('new ', p_brand)), named_struct('pointer', '>#extra_', 'format', 'json_obj', 'replacement', concat('{\"text\":\"', p_type, '\"}')), named_struct('pointer', '>#lines>7', 'format', 'plain_str', 'replacement', 'lost')) AS r"
    rows = _t(spark, sf, "part").selectExpr("p_partkey", f"{_JSON} AS t", new)
    return backfill.filled_trees(rows, "t", "r").select("p_partkey", "filled")


@query("""SELECT p_partkey, concat('{l:[{text:"', p_name, '"},{text:"', p_brand, '"}],n:', p_size, 's}') AS filled FROM part""")
def nbt_list_normalise(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('{l:[\"', p_name, '\",{text:\"', p_type, '\"}],n:', p_size, 's}') AS t", "array(named_struct('pointer', '>#l>1>#text', 'format', 'snbt_str', 'replacement', p_brand)) AS r")
    return backfill.filled_trees(rows, "t", "r", "snbt").select("p_partkey", "filled")


# --- regions ----------------------------------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN 'overworld' WHEN 1 THEN 'nether' WHEN 2 THEN 'my/x' ELSE 'the_end' END AS dimension,
    CASE l_suppkey % 3 WHEN 0 THEN 'terrain' WHEN 1 THEN 'poi' ELSE 'entities' END AS kind, CAST(l_partkey - 100 AS INT) AS x, CAST(-l_suppkey AS INT) AS z FROM lineitem WHERE l_linenumber <> 1"""
)
def region_coords(spark, sf):
    path = """concat(CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'DIM-1/' WHEN 2 THEN 'dimensions/my/x/' ELSE 'dimensions/minecraft/the_end/' END,
     CASE l_suppkey % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'poi' ELSE 'entities' END, '/r.', l_partkey - 100, CASE WHEN l_linenumber = 1 THEN '' ELSE concat('.', -l_suppkey) END, '.mca') AS path"""
    rows = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", path)
    return rows.withColumn("p", world.region_place(F.col("path"))).where("p IS NOT NULL").select("l_orderkey", "l_linenumber", "p.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS sector, CAST(l_quantity AS BIGINT) AS count FROM lineitem")
def chunk_offset_decode(spark, sf):
    """Header entries taken apart."""
    rows = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey * 256 + CAST(l_quantity AS BIGINT) AS entry")
    return rows.select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(fx.chunk_place(F.col("entry")), ("sector", "count"), strict=True)))


@query("SELECT l_orderkey, CAST(greatest(2, max(l_partkey + l_linenumber)) AS BIGINT) AS sectors, CAST(max((CAST(l_quantity AS BIGINT) * 1000 + 4095) // 4096) AS BIGINT) AS largest FROM lineitem GROUP BY l_orderkey")
def necessary_sectors(spark, sf):
    """A region for each order: the sectors that its header of line items asks for."""
    rows = _t(spark, sf, "lineitem").selectExpr("l_orderkey", "l_partkey * 256 + l_linenumber AS entry", "CAST(l_quantity AS BIGINT) * 1000 AS size")
    return rows.groupBy("l_orderkey").agg(fx.necessary_sectors(F.col("entry")).alias("sectors"), F.max(fx.sector_count(F.col("size"))).alias("largest"))


@query("SELECT p_brand, p_partkey // 1024 AS region, CAST(p_partkey % 1024 AS INT) AS chunk_index, p_partkey AS id, p_name AS name, CAST(1 + p_partkey % 1024 % 3 AS INT) AS kind FROM part")
def region_roundtrip(spark, sf):
    """Every part written as a chunk, read and decoded."""

    def read(raw):
        for c in anvil.read(bytes(raw)):
            tree = c.tree()
            yield {"chunk_index": c.index, "id": tree["id"].value, "name": tree["name"], "kind": c.kind}

    return exploded(region_files(spark, sf), read, "chunk_index int, id long, name string, kind int", "content", drop=["content"])


def region_files(spark, sf):
    """(p_brand, region, content): a region for each brand and 1024 part keys, with a chunk for each part."""
    parts = _t(spark, sf, "part").selectExpr("p_brand", "p_partkey DIV 1024 AS region", "CAST(p_partkey % 1024 AS INT) AS i", "p_partkey AS id", "p_name AS name")
    made = parts.groupBy("p_brand", "region").agg(F.collect_list(F.struct("i", "id", "name")).alias("cells"))

    def build(rows):
        chunks = [anvil.Chunk(r["i"], 1 + r["i"] % 3, b"", 7).replaced({"id": Num("long", r["id"]), "name": r["name"]}) for r in rows]
        yield {"content": anvil.write(chunks)}

    return exploded(made, build, "content binary", "cells", drop=["cells"])


@query("SELECT p_partkey, CAST(p_partkey % 1024 AS INT) AS chunk_index, '>#block_entities>0>#CustomName' AS pointer, p_name AS content FROM part")
def region_extract(spark, sf):
    """One region a part, with one named block entity."""

    def build(i: int, name: str) -> bytes:
        tree = {"xPos": Num("int", int(i)), "block_entities": [{"id": "chest", "CustomName": name}]}
        return anvil.write([anvil.Chunk(int(i) % 1024, anvil.ZLIB, b"", 0).replaced(tree)])

    rows = _t(spark, sf, "part").select("p_partkey", scalar(build, "binary", "p_partkey", "p_name").alias("content"))
    return world.region_texts(rows).where("error IS NULL").select("p_partkey", "chunk_index", F.col("outer_pointer").alias("pointer"), "content")


@query("SELECT p_partkey, p_name AS name, p_size AS size, CAST(p_retailprice AS DOUBLE) AS price FROM part")
def nbt_roundtrip(spark, sf):
    def trip(name, size, price):
        tree = nbt.read_gzip(nbt.write_gzip({"n": name, "s": Num("short", int(size)), "p": [Num("double", float(price))]}))
        yield {"name": tree["n"], "size": tree["s"].value, "price": tree["p"][0].value}

    return exploded(_t(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), trip, "name string, size int, price double", "p_name", "p_size", "p_retailprice").drop("p_name", "p_size", "p_retailprice")


# --- conversions and records ------------------------------------------------------------------------


@query("SELECT p_partkey, p_size AS i, p_partkey * 10000000000 AS l, CASE WHEN p_partkey = 0 THEN 'int int' ELSE 'int long' END AS kinds, 1 AS flag FROM part")
def json_to_nbt(spark, sf):
    from glyphmill.parse import convert

    rows = _t(spark, sf, "part").selectExpr("p_partkey", "concat('{\"i\":', p_size, ',\"l\":', p_partkey * 10000000000, ',\"b\":true}') AS t")

    def run(text):
        tree = nbt.read(nbt.write(convert.json_to_nbt(njson.parse(text))))[1]
        yield {"i": tree["i"].value, "l": tree["l"].value, "kinds": f"{tree['i'].kind} {tree['l'].kind}", "flag": tree["b"].value}

    return exploded(rows, run, "i int, l long, kinds string, flag int", "t").drop("t")


@query("SELECT p_brand AS source, p_type AS path, p_partkey AS part, p_name AS content FROM part")
def interchange_groups(spark, sf):
    from glyphmill.operators import interchange

    leaves = _t(spark, sf, "part").selectExpr("p_brand AS source", "p_type AS path", "CAST(p_partkey AS INT) AS ordinal", "p_name AS content")
    groups = interchange.to_groups(leaves, "datapack")
    return interchange.from_groups(groups, "datapack").selectExpr("source", "path", "CAST(ordinal AS BIGINT) AS part", "content")


@query("SELECT p_partkey, p_name AS found FROM part WHERE p_size % 2 = 0")
def pointer_access(spark, sf):
    def run(text):
        try:
            yield {"found": pointer.access(njson.parse(text), ("a", 1, "b>c"))}
        except (KeyError, IndexError, TypeError):
            return

    rows = _t(spark, sf, "part").selectExpr("p_partkey", "CASE WHEN p_size % 2 = 0 THEN concat('{\"a\":[0,{\"b>c\":\"', p_name, '\"}]}') ELSE '{\"a\":[0]}' END AS t")
    return exploded(rows, run, "found string", "t").drop("t")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat('["', p_name, '","', p_type, '"]') ELSE concat('{"text":"', p_name, '","color":"red"}') END AS content FROM part""".replace("CASE p_partkey % 3 WHEN 0 THEN p_name", "CASE p_partkey % 3 WHEN 0 THEN concat('\"', p_name, '\"')"))
def pool_simplified(spark, sf):
    """Components in their shortest form."""
    rows = _t(spark, sf, "part").selectExpr("p_partkey", """CASE p_partkey % 3 WHEN 0 THEN concat('{"text":"', p_name, '"}') WHEN 1 THEN concat('{"text":"', p_name, '","extra":[{"text":"', p_type, '"}]}') ELSE concat('{"text":"', p_name, '","color":"red"}') END AS content""")
    return pool.simplified(rows)


@query("SELECT p_partkey, p_partkey % 3 = 0 AS valid FROM part")
def format_validate(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('{\"text\":\"', p_name, '\"}') WHEN 1 THEN concat('{\"odd\":\"', p_name, '\"}') ELSE concat('{\"text\":', p_name) END AS t", "'json_str' AS f")
    return rows.select("p_partkey", scalar(translation.validate, "boolean", "t", "f").alias("valid"))


# --- more of the translation loop -------------------------------------------------------------------


@query("SELECT DISTINCT 'plain_str' AS format, p_name AS source, upper(p_name) AS target, 'translated' AS status FROM part")
def translate_mock(spark, sf):
    """Chunks by budget through a model that answers in capitals."""
    texts = _t(spark, sf, "part").selectExpr("'plain_str' AS format", "p_name AS text").distinct()

    def model(message: str) -> str:
        body = message.split(translation.START + "\n")[1].split("\n")
        return translation.TRANSLATED + "\n" + "\n".join(x.upper() for x in body) + f"\n{translation.TERMS}\n{{}}\n{translation.END}"

    return translation.translate(texts, model, budget=64)


@query(f"SELECT p_partkey, concat(CASE WHEN p_name LIKE '%ring%' THEN 'Ring => R' || chr(10) ELSE '' END, '{translation.START}', chr(10), '[0] ', p_name, chr(10), '[1] ', p_type, '↠nl↠x') AS message FROM part")
def message_build(spark, sf):
    rows = _t(spark, sf, "part").selectExpr("p_partkey", "array(p_name, concat(p_type, '\nx')) AS t")
    return rows.select("p_partkey", scalar(lambda t: translation.message(list(t), {"Ring": "R", "zzz": "Z"}), "string", "t").alias("message"))


@query("SELECT concat(p_name, p_partkey) AS source, CASE WHEN p_size % 3 = 2 THEN p_type END AS target FROM part WHERE p_size % 3 <> 1")
def export_results(spark, sf):
    """Translated texts, and untranslatable ones without a target; untranslated ones are left out."""
    kinds = "CASE p_size % 3 WHEN 0 THEN 'untranslatable' WHEN 1 THEN 'untranslated' ELSE 'translated' END AS status"
    return translation.exported(_t(spark, sf, "part").selectExpr("concat(p_name, p_partkey) AS source", "CASE WHEN p_size % 3 = 2 THEN p_type END AS target", kinds))


@query("SELECT l_orderkey, l_linenumber, '\"TEXT\"' AS replacement FROM lineitem")
def replace_constant(spark, sf):
    return mapping.replace_all(_t(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "replacement")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat('say ', p_brand) ELSE concat('say ', p_name) END AS filled FROM part""")
def command_replace(spark, sf):
    """A command in NBT, replaced by a mapping; without a target it comes back as it was."""
    from glyphmill.parse.backfill import by_mapping, replace_found
    from glyphmill.parse.extract import nbt_texts

    def run(name: str, brand: str, size: int) -> str:
        (found,) = nbt_texts({"tile": {"Command": f"say {name}"}}, catalog.builtin())
        return replace_found(found, by_mapping({name: brand} if size % 2 == 0 else {name: None}))

    return _t(spark, sf, "part").select("p_partkey", scalar(run, "string", "p_name", "p_brand", "p_size").alias("filled"))


@query("SELECT p_partkey, CAST(i AS INT) AS \"start\", CAST(i AS INT) AS \"end\" FROM (SELECT p_partkey, p_name, unnest(range(length(p_name))) AS i FROM part) WHERE substring(p_name, i + 1, 1) = 'e'")
def find_all(spark, sf):
    from glyphmill.functions.udfs import found_ranges

    return found_ranges(_t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "e").drop("p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 3 <> 0 AS old, l_partkey % 3 <> 1 AS new FROM lineitem")
def dimension_layout(spark, sf):
    path = F.expr("CASE l_partkey % 3 WHEN 0 THEN 'dimensions/minecraft/overworld/region/r.0.0.mca' WHEN 1 THEN 'region/r.0.0.mca' ELSE 'dimensions/my/x/region/r.0.0.mca' END")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", world.in_layout(path, False).alias("old"), world.in_layout(path, True).alias("new"))


@query("SELECT p_partkey, CAST(p_partkey % 1024 AS INT) AS chunk_index, p_size AS x, -p_size AS z, p_type AS status, 2 AS n FROM part")
def typed_chunks(spark, sf):
    def build(key: int, size: int, status: str) -> bytes:
        tree = {"DataVersion": Num("int", 3000), "xPos": Num("int", int(size)), "zPos": Num("int", -int(size)), "Status": status, "block_entities": [{"id": "a"}, {"id": "b"}]}
        return anvil.write([anvil.Chunk(int(key) % 1024, anvil.GZIP, b"", 0).replaced(tree)])

    rows = _t(spark, sf, "part").select("p_partkey", scalar(build, "binary", "p_partkey", "p_size", "p_type").alias("content"))
    return world.typed_chunks(rows, "terrain").selectExpr("p_partkey", "chunk_index", "chunk_x AS x", "chunk_z AS z", "chunk_status AS status", "chunk_n_block_entities AS n")


# the rest registers itself
from glyphmill import queries_texts, queries_worlds  # noqa: E402, F401
