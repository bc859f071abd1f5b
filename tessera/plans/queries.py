"""One query for each operator over the driver's tables, with the same result in DuckDB's SQL where SQL can say it.

The second version of a document is made in the query itself: every fifth line goes, every seventh gets
a year. Tables are made of order lines, facts of order totals, tasks of orders, task events of events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.functions import values
from tessera.operators import align, batches, candidates, diffs, facts, golden, graph, pages, reports, rules, tables, tasks
from tessera.plans import compare
from tessera.sources import documents as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units of the documents and of their second versions."""
    old = lines_of(spark, sf_dir)
    new = old.where("ordinal % 5 <> 3").withColumn("line", F.when(F.col("ordinal") % 7 == 2, F.concat("line", F.lit(" 2024"))).otherwise(F.col("line")))
    return compare.units(old), compare.units(new)


SQL_LINES = "SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS ordinal FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)"
SQL_COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SQL_IGNORED = "，,。；;：:“”\"‘’''（）()【】[]、 *|~"
SQL_UNITS = f"""
lines AS ({SQL_LINES}),
old AS (SELECT doc_id AS pair, ordinal, translate({SQL_COLLAPSE.format("line")}, '{SQL_IGNORED}', '') AS text FROM lines WHERE trim(line) <> ''),
new AS (SELECT doc_id AS pair, ordinal, translate({SQL_COLLAPSE.format("CASE WHEN ordinal % 7 = 2 THEN line || ' 2024' ELSE line END")}, '{SQL_IGNORED}', '') AS text FROM lines WHERE trim(line) <> '' AND ordinal % 5 <> 3),
b AS (SELECT * FROM old WHERE text <> ''), t AS (SELECT * FROM new WHERE text <> ''),
b1 AS (SELECT pair, text, min(ordinal) AS base FROM b WHERE length(text) >= 4 GROUP BY ALL HAVING count(*) = 1),
t1 AS (SELECT pair, text, min(ordinal) AS target FROM t WHERE length(text) >= 4 GROUP BY ALL HAVING count(*) = 1),
a AS (SELECT pair, base, target FROM b1 JOIN t1 USING (pair, text))"""


# --- text ----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {SQL_COLLAPSE.format('text')} AS normalized FROM documents")
def q_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, ordinal, translate({SQL_COLLAPSE.format('line')}, '{SQL_IGNORED}', '') AS match FROM ({SQL_LINES}) WHERE trim(line) <> ''")
def q_match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select("doc_id", "ordinal", tx.match_text(tx.collapse(F.col("line"))).alias("match"))


@query(f"SELECT doc_id, array_to_string(list_sort(regexp_extract_all(text, '{tx.NUMBER}')), ' ') AS numbers, regexp_replace(text, '{tx.NUMBER}', '#', 'g') AS skeleton FROM documents")
def q_numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(tx.value_tokens(F.col("text")), " ").alias("numbers"), tx.number_skeleton(F.col("text")).alias("skeleton"))


@query("""SELECT conv_id, turn, substr(text, 1, 20) AS summary, replace(lower(regexp_replace(text, '[\\s,，]+', '', 'g')), 'ß', 'ss') AS value,
 CASE WHEN turn % 3 = 0 THEN '' ELSE turn::VARCHAR END || '.5%' AS share FROM conversations""")
def q_candidate_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text's value, and shares written as 百分之0.5, 0.5 % and 0.5."""
    c = table(spark, sf_dir, "conversations")
    number = F.expr("if(turn % 3 = 0, '', cast(turn as string))")
    share = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("百分之 "), number, F.lit(".5"))).when(F.col("turn") % 3 == 0, F.lit(" .5 ％")).otherwise(F.concat(number, F.lit(".5")))
    return c.select("conv_id", "turn", tx.summary(F.col("text"), 20).alias("summary"), tx.candidate_value(F.col("text"), F.lit("TEXT")).alias("value"), tx.candidate_value(share, F.lit("PERCENTAGE")).alias("share"))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(text, '[\\x{3400}-\\x{9fff}]{2,8}|[A-Za-z]{2,}|[0-9]+'), lambda t: t NOT IN ('the', 'der')), lambda t: lower(t)))), ' ') AS terms FROM conversations""")
def q_context_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(tx.context_terms(F.col("text"), ["the", "der"])), " ").alias("terms"))


@query("SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, coalesce(regexp_matches(url, '^https?://[^/?#@]+') AND NOT regexp_matches(url, '^https?://(localhost|127\\.|10\\.|192\\.168\\.)'), false) AS allowed FROM pages")
def q_url_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.sanitize_url(F.col("url")).alias("clean"), tx.url_allowed(F.col("url")).alias("allowed"))


@query("SELECT doc_id, 'id_' || substr(sha256('=' || lang || chr(31) || '=' || source || chr(31) || '=' || doc_id), 1, 24) AS id FROM documents WHERE lang IS NOT NULL")
def q_stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", tx.stable_id("id_", F.col("lang"), F.col("source"), F.col("doc_id")).alias("id"))


ALIASES = {"the": "ARTICLE", "then": "TIME", "las": "ARTICLE_ES", "des": "ARTICLE_FR", "der": "ARTICLE_DE"}


@query(
    "SELECT doc_id, arg_min(name, struct_pack(a := pos, b := n)) FILTER (WHERE pos > 0) AS field FROM (SELECT doc_id, name, instr(lower(text), word) AS pos, -length(word) AS n FROM documents, (VALUES "
    + ", ".join(f"('{a}', '{c}')" for a, c in ALIASES.items())
    + ") AS v(word, name)) GROUP BY doc_id"
)
def q_field_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.earliest_alias(F.lower("text"), ALIASES).alias("field"))


# --- pairing versions ----------------------------------------------------------------------------


@query(f"WITH {SQL_UNITS} SELECT * FROM a")
def q_anchor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unique_anchors(*versions(spark, sf_dir)).select("pair", F.col("base").cast("long"), F.col("target").cast("long"))


SQL_COVER = """(SELECT pair, sum(length(text))::BIGINT AS {p}_chars, coalesce(sum(length(text)) FILTER (WHERE hit), 0)::BIGINT AS {p}_matched, count(*) FILTER (WHERE hit IS NULL) AS {p}_unmatched
 FROM {u} LEFT JOIN (SELECT DISTINCT pair, {p} AS ordinal, true AS hit FROM a) USING (pair, ordinal) GROUP BY pair)"""


@query(f"WITH {SQL_UNITS} SELECT * FROM {SQL_COVER.format(p='base', u='b')} FULL JOIN {SQL_COVER.format(p='target', u='t')} USING (pair)")
def q_anchor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.anchored_coverage(*versions(spark, sf_dir)).drop("base_coverage", "target_coverage")


@query(f"""WITH {SQL_UNITS}, x AS (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY ordinal) AS nth FROM b), y AS (SELECT *, row_number() OVER (PARTITION BY pair, text ORDER BY ordinal) AS nth FROM t)
SELECT pair, text, x.ordinal AS base, y.ordinal AS target FROM x JOIN y USING (pair, text, nth)""")
def q_moved_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.moved(*versions(spark, sf_dir))


@query(f"""WITH {SQL_UNITS} SELECT pair, round(coalesce(sum(length(text)) FILTER (WHERE hit) / sum(length(text)), 0), 6) AS share
FROM b LEFT JOIN (SELECT DISTINCT pair, text, true AS hit FROM t) USING (pair, text) GROUP BY pair""")
def q_moved_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.moved_share(*versions(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query()
def q_version_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.version_diffs(*versions(spark, sf_dir))


@query()
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = compare.version_diffs(*versions(spark, sf_dir)).where("before is not null and after is not null")
    return changed.select("pair", "diff_id", sim.indel_ratio("before", "after").alias("similarity"), sim.diff_segments("before", "after").alias("segments"))


@query()
def q_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", sim.indel_ratio("p_name", "p_type").alias("indel"), sim.partial_ratio("p_name", "p_type").alias("partial"), sim.block_similarity("p_name", "p_brand").alias("blocks"))


SQL_ROWS = "li AS (SELECT l_orderkey, l_linenumber, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one for each number (the numbers repeat in the table)."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_linestatus", "l_quantity", "l_returnflag")])


# --- differences ---------------------------------------------------------------------------------


def perturbed_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 7 <> 0").withColumns({"o_totalprice": F.expr("if(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)"), "o_orderkey": F.expr("if(o_orderkey % 11 = 0, -o_orderkey, o_orderkey)")})
    return o, new


SQL_NEW_ORDERS = "new AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"""WITH {SQL_NEW_ORDERS} SELECT * FROM (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'ADDED' WHEN n.o_orderkey IS NULL THEN 'DELETED' WHEN o.o_totalprice <> n.o_totalprice THEN 'CHANGED' END AS kind,
 o.o_totalprice AS old_price, n.o_totalprice AS new_price FROM orders o FULL JOIN new n ON o.o_orderkey = n.o_orderkey) WHERE kind IS NOT NULL""")
def q_keyed_row_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diffs.keyed_diff(*perturbed_orders(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return d.select("o_orderkey", "kind", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query(f"""WITH {SQL_ROWS}, x AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM li), y AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM li WHERE l_linenumber % 3 <> 0)
SELECT l_orderkey, place, CASE WHEN x.l_quantity IS NULL THEN 'ADDED' WHEN y.l_quantity IS NULL THEN 'DELETED' ELSE 'CHANGED' END AS kind FROM x FULL JOIN y USING (l_orderkey, place) WHERE x.l_quantity IS DISTINCT FROM y.l_quantity""")
def q_positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = order_rows(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    return diffs.positional_diff(li, li.where("l_linenumber % 3 <> 0"), ["l_orderkey"], "l_linenumber", ["l_quantity"]).select("l_orderkey", F.col("place").cast("long").alias("place"), "kind")


@query("""WITH e AS (SELECT event_type, event_id, user_id, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY event_type ORDER BY event_id) <= 5 THEN 0 ELSE 1 END AS b FROM events),
r AS (SELECT *, sum(b) OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM e)
SELECT event_type, run::BIGINT AS run, min(event_id) AS first, max(event_id) AS last, count(*) AS units, sum(user_id)::BIGINT AS chars FROM r GROUP BY ALL""")
def q_missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    r = diffs.islands(e, ["event_type"], "event_id", 5)
    return r.groupBy("event_type", F.col("run").cast("long").alias("run")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("units"), F.sum("user_id").alias("chars"))


@query("""WITH s AS (SELECT user_id, event_id AS first, event_id + CAST(floor(value) AS BIGINT) AS last FROM events),
m AS (SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY user_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS b FROM s),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(first) AS first, max(last) AS last, count(*) AS spans FROM r GROUP BY user_id, run""")
def q_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + F.floor("value")).alias("last"))
    return diffs.interval_union(e, ["user_id"])


def document_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in diffs.PRIORITY])
    return table(spark, sf_dir, "documents").select(F.md5("text").alias("signature"), F.col("doc_id").alias("ordinal"), kinds[(F.col("doc_id") % 7).cast("int")].alias("kind"), F.array("source").alias("places"))


SQL_KINDS = "[" + ", ".join(f"'{k}'" for k in diffs.PRIORITY) + "]"


@query(f"""WITH d AS (SELECT md5(text) AS signature, doc_id AS ordinal, {SQL_KINDS}[doc_id % 7 + 1] AS kind, doc_id % 7 AS p, source FROM documents)
SELECT signature, arg_min(ordinal, struct_pack(p := p, o := ordinal)) AS ordinal, arg_min(kind, struct_pack(p := p, o := ordinal)) AS kind, array_to_string(list_sort(list_distinct(list(source))), ',') AS places, count(*) - 1 AS replaced FROM d GROUP BY signature""")
def q_dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.dedup_merge(document_diffs(spark, sf_dir), ["signature"]).withColumn("places", F.array_join("places", ","))


@query("""WITH d AS (SELECT md5(text) AS signature, doc_id AS ordinal, doc_id % 7 AS p FROM documents), w AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY p, ordinal) AS n, first_value(ordinal) OVER (PARTITION BY signature ORDER BY p, ordinal) AS stays FROM d)
SELECT signature, ordinal, stays FROM w WHERE n > 1""")
def q_dedup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.dedup_audit(document_diffs(spark, sf_dir), ["signature"]).select("signature", "ordinal", "stays")


@query("SELECT source AS pair, doc_id, 'diff_' || lpad(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::VARCHAR, 6, '0') AS diff_id FROM documents")
def q_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pair"), "doc_id", "n_chars")
    return diffs.renumber(d, ["pair"], [F.desc("n_chars"), F.col("doc_id")]).select("pair", "doc_id", "diff_id")


@query()
def q_deoverlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("first"), (F.col("event_id") + F.floor("value")).alias("last"), F.length("event_type").alias("priority"), "event_type")
    return diffs.deoverlap(e, ["user_id"])


def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("DELETED", "ADDED", "DELETED", "MODIFIED")])
    return lines_of(spark, sf_dir).select(F.col("doc_id").alias("pair"), "ordinal", kinds[(F.col("ordinal") % 4).cast("int")].alias("kind"), F.col("ordinal").alias("paragraph"), F.col("line").alias("text"))


@query()
def q_merge_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.merge_deletions(line_diffs(spark, sf_dir))


@query()
def q_recompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.recompose(line_diffs(spark, sf_dir))


# --- tables --------------------------------------------------------------------------------------


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a table: a row for each line, a column each for line number, status, quantity and flag."""
    li = order_rows(spark, sf_dir)
    texts = F.array(F.col("l_linenumber").cast("string"), F.col("l_linestatus"), F.col("l_quantity").cast("int").cast("string"), F.expr("if(l_linenumber % 2 = 0, '', l_returnflag)"))
    c = li.select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("table"), (F.col("l_linenumber") - 1).alias("row"), F.posexplode(texts).alias("col", "text"))
    return c.withColumns({"logical": F.lit(None).cast("string"), "row_span": F.lit(1), "col_span": F.lit(1), "place": F.concat_ws(".", "row", "col")})


SQL_CELLS = SQL_ROWS + """, cells AS (SELECT l_orderkey AS doc, l_linenumber - 1 AS row, unnest([0, 1, 2, 3]) AS col, unnest([l_linenumber::VARCHAR, l_linestatus, trunc(l_quantity)::INT::VARCHAR, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag END]) AS text FROM li)"""


@query(f"WITH {SQL_CELLS}, f AS (SELECT *, min(row) OVER (PARTITION BY doc) AS first FROM cells) SELECT doc, string_agg(text, '|' ORDER BY col) FILTER (WHERE row = first) AS header, max(col) + 1 AS columns, count(DISTINCT row) AS rows FROM f GROUP BY doc")
def q_table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.headers(cells(spark, sf_dir)).select("doc", "header", "columns", "rows")


@query(f"WITH {SQL_CELLS} SELECT doc, row, string_agg(text, '|' ORDER BY col) AS texts FROM cells GROUP BY doc, row")
def q_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dense_rows(cells(spark, sf_dir)).select("doc", "row", F.array_join("texts", "|").alias("texts"))


@query(f"""WITH {SQL_CELLS}, m AS (SELECT *, CASE WHEN col = 1 THEN 'S' ELSE row || ',' || col END AS logical FROM cells)
SELECT doc, logical, min(row) AS row, min(col) AS col, coalesce(arg_min(text, row * 1000 + col) FILTER (WHERE trim(text) <> ''), '') AS text, count(*) AS physical FROM m GROUP BY doc, logical""")
def q_logical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = cells(spark, sf_dir).withColumn("logical", F.when(F.col("col") == 1, "S"))
    return tables.logical_cells(merged).select("doc", "logical", "row", "col", "text", F.size("places").cast("long").alias("physical"))


@query(f"""WITH {SQL_CELLS} SELECT doc, row, col, text, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY doc, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM cells""")
def q_vertical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.vertical_context(cells(spark, sf_dir)).select("doc", "row", "col", "text", "above")


@query(f"""WITH {SQL_CELLS} SELECT doc, row, col, text, lag(text) OVER (PARTITION BY doc, row ORDER BY col) AS label FROM cells""")
def q_left_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.left_labels(cells(spark, sf_dir)).select("doc", "row", "col", "text", "label")


def two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders as tables of one document and of a changed one."""
    a = cells(spark, sf_dir).withColumns({"table": F.col("doc"), "doc": F.lit(1)})
    return a, a.where("not (table % 3 = 0 and row = 2)").withColumn("text", F.when((F.col("col") == 2) & (F.col("table") % 5 == 0), F.concat("text", F.lit("0"))).otherwise(F.col("text")))


@query(f"""WITH {SQL_CELLS}, n AS (SELECT doc, row, col, CASE WHEN col = 2 AND doc % 5 = 0 THEN text || '0' ELSE text END AS text FROM cells WHERE NOT (doc % 3 = 0 AND row = 2))
SELECT c.doc AS "table", row, col, c.text AS before, n.text AS after FROM cells c JOIN n USING (doc, row, col) WHERE c.text <> n.text""")
def q_cell_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_changes(*two_tables(spark, sf_dir)).drop("doc")


@query(f"""WITH {SQL_CELLS}, n AS (SELECT doc, row, count(*) AS n FROM cells GROUP BY ALL), o AS (SELECT doc, count(*) AS rows FROM n GROUP BY doc), w AS (SELECT doc, count(*) AS rows FROM n WHERE NOT (doc % 3 = 0 AND row = 2) GROUP BY doc)
SELECT doc AS "table", o.rows AS old_rows, w.rows AS new_rows FROM o FULL JOIN w USING (doc) WHERE o.rows IS DISTINCT FROM w.rows""")
def q_shape_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.shape_changes(*two_tables(spark, sf_dir))
    return s.select("table", F.size("old").cast("long").alias("old_rows"), F.when(F.col("new").isNotNull(), F.size("new")).cast("long").alias("new_rows"))


@query(f"""WITH {SQL_CELLS}, o AS (SELECT doc, row, min(text) FILTER (WHERE col = 0) AS key FROM cells GROUP BY ALL), n AS (SELECT * FROM o WHERE NOT (doc % 3 = 0 AND row = 2))
SELECT doc AS "table", o.row AS old_row, n.row AS new_row, CASE WHEN doc IN (SELECT doc FROM n) THEN 'KEY' ELSE 'PLACE' END AS by FROM o FULL JOIN n USING (doc, key)""")
def q_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (tables.dense_rows(x) for x in two_tables(spark, sf_dir))
    return tables.pair_rows(a, b).select("table", F.col("old.row").alias("old_row"), F.col("new.row").alias("new_row"), "by")


@query(f"""WITH {SQL_CELLS}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc, row ORDER BY col) AS label FROM cells) SELECT doc AS "table", row, col, label FROM l WHERE text = '' AND label <> '' AND NOT (doc % 3 = 0 AND row = 2)""")
def q_required_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.required_blanks(*two_tables(spark, sf_dir)).drop("doc")


@query()
def q_column_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (tables.dense_rows(x) for x in two_tables(spark, sf_dir))
    return tables.column_map(a, b)


@query()
def q_match_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumns({"table": (F.col("doc") % 8).cast("int"), "row": F.col("row") + 10 * F.floor(F.col("doc") / 8).cast("int"), "doc": (F.col("doc") / 64).cast("int")})
    h = tables.headers(c).withColumnRenamed("doc", "pair")
    return tables.match_tables(h, h.where("table <> 3"))


# --- facts, rules, reports -----------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r FROM lineitem)
SELECT o_orderkey, coalesce(['CONFLICT', 'CONSISTENT', 'UNCERTAIN'][min(r) + 1], 'MISSING') AS status FROM orders LEFT JOIN s ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def q_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.expr("case l_returnflag when 'R' then 'CONFLICT' when 'A' then 'CONSISTENT' else 'UNCERTAIN' end").alias("s"))
    worst = li.groupBy("o_orderkey").agg(facts.roll_up(F.col("s")).alias("s"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(worst, "o_orderkey", "left").select("o_orderkey", F.coalesce("s", F.lit("MISSING")).alias("status"))


def order_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Order totals as target facts; a reference file with every third missing and every fifth changed, and one in another unit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    t = o.select(F.col("o_orderkey").alias("fact"), F.concat(F.lit("total_"), F.col("o_orderkey").cast("string")).alias("field"), F.lit("QUANTITY").alias("kind"), F.concat(F.col("p").cast("string"), F.lit(" USD")).alias("raw"))
    a = t.where("fact % 3 <> 0").withColumns({"file": F.lit("a"), "raw": F.expr("if(fact % 5 = 0, concat('9', raw), raw)")})
    b = t.withColumns({"file": F.lit("b"), "raw": F.expr("if(fact % 2 = 0, replace(raw, 'USD', 'kg'), raw)")})
    refs = a.unionByName(b)
    return facts.with_forms(t), facts.with_forms(refs), facts.default_mapping(t, refs), refs.select("file").distinct()


@query("""WITH c AS (SELECT o_orderkey AS fact, 'a' AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'CONSISTENT' END AS status FROM orders
UNION ALL SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 2 = 0 THEN 'UNCERTAIN' ELSE 'CONSISTENT' END FROM orders),
r AS (SELECT fact, min(list_position(['CONFLICT', 'CONSISTENT', 'UNCERTAIN', 'MISSING'], status)) AS p FROM c GROUP BY fact)
SELECT fact, file, status, ['CONFLICT', 'CONSISTENT', 'UNCERTAIN', 'MISSING'][p] AS overall FROM c JOIN r USING (fact)""")
def q_fact_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fact_matrix(*order_facts(spark, sf_dir)).select("fact", "file", "status", "overall")


@query("""WITH c AS (SELECT o_orderkey AS fact, 'a' AS file, CASE WHEN o_orderkey % 3 = 0 THEN 'MISSING' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'CONSISTENT' END AS status FROM orders
UNION ALL SELECT o_orderkey, 'b', CASE WHEN o_orderkey % 2 = 0 THEN 'UNCERTAIN' ELSE 'CONSISTENT' END FROM orders)
SELECT 'RISK' AS kind, 'SOURCE_CONFLICT' AS code, fact, file FROM c WHERE status = 'CONFLICT' UNION ALL SELECT 'REVIEW', 'SOURCE_UNCERTAIN', fact, file FROM c WHERE status = 'UNCERTAIN'
UNION ALL SELECT 'PASSED', 'FACT_CONSISTENT', fact, NULL FROM c GROUP BY fact HAVING NOT bool_or(status = 'CONFLICT') AND bool_or(status = 'CONSISTENT')""")
def q_matrix_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.matrix_items(facts.fact_matrix(*order_facts(spark, sf_dir)))


@query("""SELECT o_orderkey AS fact, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS value, 'usd' AS unit FROM orders""")
def q_normal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = order_facts(spark, sf_dir)[0]
    return t.select("fact", F.col("form.value").alias("value"), F.col("form.unit").alias("unit"))


RULES = [
    {"validation_id": "net_over_1000", "expression": {"op": "greater_or_equal", "left": {"op": "multiply", "args": [{"op": "fact", "concept_id": "price"}, {"op": "subtract", "args": [{"op": "literal", "value": "1"}, {"op": "fact", "concept_id": "discount"}]}]}, "right": {"op": "literal", "value": "1000"}}},
    {"validation_id": "price_is_quantity", "expression": {"op": "equals", "left": {"op": "fact", "concept_id": "price"}, "right": {"op": "fact", "concept_id": "quantity"}, "tolerance": "10"}},
]


@query("""WITH v AS (SELECT review, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS discount, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM (SELECT *, l_orderkey || '/' || l_linenumber AS review FROM lineitem)),
g AS (SELECT review, count(DISTINCT price) AS np, count(DISTINCT discount) AS nd, count(DISTINCT quantity) AS nq, min(price) AS price, min(discount) AS discount, min(quantity) AS quantity FROM v GROUP BY review)
SELECT review, 'net_over_1000' AS validation_id, CASE WHEN np > 1 OR nd > 1 THEN 'REVIEW_REQUIRED' WHEN price * (1 - discount) >= 1000 THEN 'PASSED' ELSE 'FAILED' END AS status FROM g
UNION ALL SELECT review, 'price_is_quantity', CASE WHEN np > 1 OR nq > 1 THEN 'REVIEW_REQUIRED' WHEN abs(price - quantity) <= 10 THEN 'PASSED' ELSE 'FAILED' END FROM g""")
def q_rule_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("decimal(18,2)").alias("value")) for n, c in (("price", "l_extendedprice"), ("discount", "l_discount"), ("quantity", "l_quantity"))]))
    f = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("review"), named.alias("f")).select("review", "f.*", F.lit("x").alias("file"))
    return rules.verdicts(f, RULES).select("review", "validation_id", "status")


@query("""SELECT o_custkey, count(DISTINCT o_orderstatus) AS values, count(DISTINCT o_orderstatus) > 1 AS ambiguous FROM orders GROUP BY o_custkey""")
def q_ambiguous_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.countDistinct("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(n.alias("values"), (n > 1).alias("ambiguous"))


@query("""WITH e AS (SELECT DISTINCT doc_id AS a FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS b, count(*) AS n FROM labels GROUP BY doc_id)
SELECT coalesce(a, b) AS doc_id, CASE WHEN b IS NULL THEN 'MISSING' WHEN a IS NULL THEN 'UNEXPECTED' ELSE 'DUPLICATE' END AS error FROM e FULL JOIN r ON a = b WHERE b IS NULL OR a IS NULL OR n > 1""")
def q_coverage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.coverage_errors(table(spark, sf_dir, "documents").where("doc_id % 2 = 0"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT l.doc_id, l.quality FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND contains(d.text, '.'))""")
def q_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact"), F.col("doc_id").alias("file"), F.lit(0).alias("block"), F.lit(".").alias("evidence"), "quality")
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.lit(0).alias("block"), "text")
    return facts.ungrounded(f, b).select(F.col("fact").alias("doc_id"), "quality")


@query("""WITH d AS (SELECT doc_id, text, substr(text, 11, 8) AS q FROM documents WHERE length(text) > 10), x AS (SELECT *, len(list_filter(range(1, 8), lambda k: substr(q, 1, k) = substr(q, length(q) - k + 1, k) AND k < length(q))) > 0 AS bordered FROM d)
SELECT doc_id, CASE WHEN bordered THEN len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(q)) = q)) ELSE (length(text) - length(replace(text, q, ''))) // length(q) END AS hits, instr(text, q) - 1 AS first FROM x""")
def q_quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = d.select("doc_id", F.substring("text", 11, 8).alias("quote"))
    return facts.quote_hits(q, d).select("doc_id", F.col("hits").cast("long").alias("hits"), F.col("first").cast("long").alias("first"))


@query("""WITH p AS (SELECT a.p_partkey AS t_id, b.p_partkey AS r_id, 100 * (a.p_size = b.p_size)::INT + 20 * (a.p_type = b.p_type)::INT AS score FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
SELECT t_id, r_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY t_id ORDER BY score DESC, r_id) AS rank FROM p WHERE score > 0) WHERE rank <= 3""")
def q_topk_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    return facts.top_by_terms(p, p, ["p_brand"], {"size": 100, "type": 20}, 3).select("t_id", "r_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS t FROM documents), c AS (SELECT t, min(doc_id) AS r_id, count(*) AS members FROM w WHERE len(t) > 0 GROUP BY t)
SELECT a.doc_id AS l_id, c.r_id, c.members, round(len(list_intersect(a.t, c.t)) / len(list_distinct(list_concat(a.t, c.t))), 6) AS score FROM w a JOIN c ON a.doc_id % 50 = 0
 WHERE 10 * len(list_intersect(a.t, c.t)) >= 6 * len(list_distinct(list_concat(a.t, c.t)))""")
def q_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document against all classes of documents with equal token sets, from a similarity of 0.6 on."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.retrieval_tokens(F.col("text")).alias("tokens"))
    return facts.similar_sets(d.where("id % 50 = 0"), d, 60).select("l_id", "r_id", "members", F.round("score", 6).alias("score"))


def copy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked with the first of equal text, and with the first of equal first line."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.md5(F.split_part("text", F.lit("\n"), F.lit(1))).alias("h"))
    star = lambda c: d.join(d.groupBy(c).agg(F.min("doc_id").alias("a")), c).where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    return star("m").unionByName(star("h")).distinct()


@query("""WITH RECURSIVE d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS x, min(doc_id) OVER (PARTITION BY md5(split_part(text, chr(10), 1))) AS y FROM documents),
e AS (SELECT doc_id AS a, x AS b FROM d WHERE x <> doc_id UNION SELECT x, doc_id FROM d WHERE x <> doc_id UNION SELECT doc_id, y FROM d WHERE y <> doc_id UNION SELECT y, doc_id FROM d WHERE y <> doc_id),
r(node, far) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.far = e.a) SELECT node, min(far) AS component FROM r GROUP BY node""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected(copy_edges(spark, sf_dir))


@query()
def q_clique_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = copy_edges(spark, sf_dir)
    comp = graph.connected(e)
    return graph.complete_groups(e.join(comp.withColumnRenamed("node", "a"), "a"), 4)


@query("SELECT lang, n_chars, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS members, count(*) > 3 AS blocked FROM documents GROUP BY lang, n_chars HAVING count(*) > 1")
def q_value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", F.col("doc_id").alias("id"))
    return graph.value_buckets(d, ["lang", "n_chars"]).withColumn("members", F.array_join("members", ","))


@query("SELECT source, sha256(to_json(list_sort(list(struct_pack(doc_id := doc_id, lang := lang))))::VARCHAR) AS fingerprint FROM documents GROUP BY source")
def q_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.topology(table(spark, sf_dir, "documents"), "source", "doc_id", "lang")


@query("SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, array_to_string(list_sort(list_distinct(list(n_chars::VARCHAR))), ',') AS places FROM documents GROUP BY source")
def q_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "lang", F.array(F.col("n_chars").cast("string")).alias("places"))
    return graph.merge_groups(d, "source", F.col("doc_id"), "places").withColumn("places", F.array_join("places", ","))


@query("SELECT user_id, event_type AS code, arg_min(props, event_id) AS message, min(event_id) AS first, bool_or(value > 90) AS review, count(*) AS n FROM events GROUP BY user_id, event_type")
def q_warning_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("code"), F.col("props").alias("message"), F.col("event_id").alias("seq"), (F.col("value") > 90).alias("review"))
    return reports.warning_rollup(e, ["user_id"])


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS large FROM events GROUP BY user_id")
def q_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return reports.statistics(e, ["user_id"], {"errors": F.col("event_type") == "error", "purchases": F.col("event_type") == "purchase", "large": F.col("value") > 50})


PATTERNS = {"PERCENT": "%", "DIGIT": "[0-9]", "QUESTION": "[?]"}


@query("SELECT doc_id AS doc, v.rule, length(regexp_extract(text, '(?s)^(.*?)(' || v.pattern || ')', 1)) + 1 AS at, regexp_extract(text, v.pattern) AS found FROM documents, (VALUES ('PERCENT', '%'), ('DIGIT', '[0-9]'), ('QUESTION', '[?]')) AS v(rule, pattern) WHERE regexp_matches(text, v.pattern)")
def q_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit(0).alias("place"), "text")
    return reports.unresolved(d, PATTERNS).select("doc", "rule", F.col("at").cast("long").alias("at"), "found")


@query("""WITH h AS (SELECT source AS pair, v.category, bool_and(regexp_matches(text, v.pattern)) AS every FROM documents, (VALUES ('STOP', '[.]'), ('LETTER', '[a-z]'), ('DIGIT', '[0-9]')) AS v(category, pattern) GROUP BY ALL),
c AS (SELECT DISTINCT source AS pair, v.category FROM documents, (VALUES ('STOP', '[.]'), ('LETTER', '[a-z]'), ('DIGIT', '[0-9]')) AS v(category, pattern) WHERE doc_id % 97 = 5 AND regexp_matches(text, v.pattern))
SELECT pair, category FROM h WHERE every AND NOT EXISTS (SELECT 1 FROM c WHERE c.pair = h.pair AND c.category = h.category)""")
def q_passed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("pair"), F.col("doc_id").alias("doc"), "text")
    return reports.passed_checks(d, d.where("doc % 97 = 5"), {"STOP": "[.]", "LETTER": "[a-z]", "DIGIT": "[0-9]"})


def report_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("pair"), F.concat(F.lit("diff_"), F.col("doc_id").cast("string")).alias("diff_id"), F.expr("if(lang = 'en', 'MODIFIED', 'ADDED')").alias("kind"),
        F.expr("if(doc_id % 4 = 0, 'INFERRED', 'CONFIRMED')").alias("certainty"), F.expr("if(doc_id % 10 = 1, 'OCR_LOW_CONFIDENCE_VARIANCE', null)").alias("reason"),
    )
    r = table(spark, sf_dir, "labels").select(F.lit("src0").alias("pair"), F.col("doc_id").cast("string").alias("validation_id"), F.expr("if(quality = 0, 'FAILED', 'PASSED')").alias("status"), F.lit("NUMERIC_RULE_FAILED").alias("reason"))
    w = table(spark, sf_dir, "benchmark").select(F.lit("src1").alias("pair"), F.concat(F.lit("W"), F.col("item_id").cast("string")).alias("code"), (F.col("item_id") % 2 == 0).alias("review"))
    return d, r, w


@query("""SELECT source AS pair, CASE WHEN lang = 'en' THEN 'MODIFIED' ELSE 'ADDED' END AS code, 'DIFF' AS source, 'diff_' || doc_id AS ref FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 10 <> 1
UNION ALL SELECT 'src0', 'NUMERIC_RULE_FAILED', 'RULE', doc_id::VARCHAR FROM labels WHERE quality = 0""")
def q_risk_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, r, _ = report_inputs(spark, sf_dir)
    return reports.risk_items(d, r)


@query("""SELECT source AS pair, CASE WHEN doc_id % 10 = 1 THEN 'OCR_LOW_CONFIDENCE_VARIANCE' WHEN lang = 'en' THEN 'MODIFIED' ELSE 'ADDED' END AS code, 'DIFF' AS source, 'diff_' || doc_id AS ref FROM documents WHERE doc_id % 4 = 0 OR doc_id % 10 = 1
UNION ALL SELECT 'src1', 'W' || item_id, 'WARNING', NULL FROM benchmark WHERE item_id % 2 = 0""")
def q_review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, w = report_inputs(spark, sf_dir)
    return reports.review_items(d, w)


@query("""WITH r AS (SELECT source AS review, doc_id AS ref FROM documents), a AS (SELECT source AS review, doc_id + CASE WHEN source = 'src3' THEN 1000000 ELSE 0 END AS ref, 'Text ' || doc_id AS text FROM documents WHERE doc_id % 2 = 0)
SELECT r.review, r.ref, coalesce(CASE WHEN r.review <> 'src3' THEN 'Text ' || a.ref || '。' END, 'Check ' || r.ref || '。') AS advice, r.review <> 'src3' AND a.ref IS NOT NULL AS from_model FROM r LEFT JOIN a USING (review, ref)""")
def q_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("review"), F.col("doc_id").alias("ref"))
    a = d.where("ref % 2 = 0").select("review", F.expr("ref + if(review = 'src3', 1000000, 0)").alias("ref"), F.concat(F.lit("Text "), F.col("ref").cast("string")).alias("text"))
    return reports.advice(d, a, F.concat(F.lit("Check "), F.col("ref").cast("string"), F.lit("。")))


@query("""SELECT count(*) FILTER (WHERE l.quality = (d.n_chars > 1000)::INT) AS matched, count(*) FILTER (WHERE l.quality <> (d.n_chars > 1000)::INT) AS mismatched, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE d.doc_id IS NULL) AS stale, 0::BIGINT AS repeated FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def q_golden_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fingerprint"), (F.col("n_chars") > 1000).cast("int").alias("outcome"))
    return golden.validate(a, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fingerprint"), F.col("quality").alias("outcome")))


@query("SELECT d.doc_id AS fingerprint, coalesce('q' || l.quality, 'NEW') AS classification FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def q_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fingerprint"), F.lit("NEW").alias("classification"), F.lit(None).cast("string").alias("note"))
    old = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fingerprint"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("classification"), F.lit("x").alias("note"))
    return golden.carry_forward(g, old).select("fingerprint", "classification")


# --- pages and batches ---------------------------------------------------------------------------


def paged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), "ordinal", F.floor(F.col("ordinal") / 4).cast("int").alias("page"), F.col("line").alias("text"), F.length("line").alias("chars"))


SQL_PAGED = f"paged AS (SELECT doc_id AS doc, ordinal, (ordinal // 4)::INT AS page, line AS text, length(line) AS chars FROM ({SQL_LINES}) WHERE trim(line) <> '')"


@query(f"WITH {SQL_PAGED} SELECT doc, page, string_agg(text, chr(10) ORDER BY ordinal) AS text FROM paged GROUP BY doc, page")
def q_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_texts(paged_lines(spark, sf_dir))


@query(f"WITH {SQL_PAGED}, p AS (SELECT doc, page, sum(chars) AS chars FROM paged GROUP BY ALL) SELECT doc, median(chars)::DOUBLE AS median_chars FROM p WHERE chars > 0 GROUP BY doc")
def q_page_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_median(paged_lines(spark, sf_dir))


@query(f"""WITH {SQL_PAGED}, b AS (SELECT doc, ordinal, CASE WHEN ordinal % 3 = 1 THEN NULL ELSE page END AS page FROM paged), w AS (SELECT *, lag(page) OVER (PARTITION BY doc ORDER BY ordinal) AS p, lead(page) OVER (PARTITION BY doc ORDER BY ordinal) AS n, CASE WHEN lead(ordinal) OVER (PARTITION BY doc ORDER BY ordinal) % 4 = 0 THEN 'TABLE' END AS k FROM b)
SELECT doc, ordinal, CASE WHEN page IS NOT NULL THEN page WHEN p = n THEN p WHEN ordinal % 4 <> 0 AND k = 'TABLE' AND n = p + 1 THEN p END AS filled FROM w""")
def q_page_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paged_lines(spark, sf_dir).withColumns({"page": F.expr("if(ordinal % 3 = 1, null, page)"), "type": F.expr("if(ordinal % 4 = 0, 'TABLE', 'PARAGRAPH')")})
    return pages.interpolate(b).select("doc", "ordinal", "filled")


@query(f"WITH {SQL_PAGED} SELECT doc, CASE WHEN min(page) = max(page) THEN min(page)::VARCHAR ELSE min(page) || '–' || max(page) END AS label FROM paged GROUP BY doc")
def q_page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_range(paged_lines(spark, sf_dir))


@query("""WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, n, 0 AS batch, chars AS total, 1 AS k FROM u WHERE n = 1 UNION ALL
SELECT u.conv_id, u.turn, u.n, CASE WHEN r.total + u.chars > 500 OR r.k + 1 > 6 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.total + u.chars > 500 OR r.k + 1 > 6 THEN u.chars ELSE r.total + u.chars END, CASE WHEN r.total + u.chars > 500 OR r.k + 1 > 6 THEN 1 ELSE r.k + 1 END FROM r JOIN u ON u.conv_id = r.conv_id AND u.n = r.n + 1)
SELECT conv_id, turn, batch FROM r""")
def q_chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), F.lit(1).alias("units"))
    return batches.plan_batches(c, ["conv_id"], "turn", {"chars": 500, "units": 6}).select("conv_id", "turn", "batch")


@query("SELECT conv_id, turn, concat_ws(chr(10), lag(text) OVER w, text, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def q_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "context")


@query("SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) > 3 THEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END::INT AS part FROM conversations")
def q_recovery_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.recovery_split(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", True).select("conv_id", "turn", "part")


@query("SELECT conv_id, turn, CAST(ceil((256 + 220 * turn + 48 * length(role)) / 2) AS BIGINT) AS tokens FROM conversations")
def q_output_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", batches.output_tokens(F.col("turn"), F.length("role")).alias("tokens"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.read_through(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])[1]


@query("SELECT l.doc_id, 1 - l.quality AS quality, l.quality AS old FROM labels l WHERE l.doc_id % 2 = 0")
def q_insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "labels").select("doc_id", "quality")
    new = store.withColumn("quality", F.expr("if(doc_id % 2 = 0, 1 - quality, quality)"))
    return batches.insert_once(store, new, ["doc_id"], "quality")[1].withColumnRenamed("_old", "old")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 9 ELSE quality END AS quality FROM labels")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return batches.upsert(store, store.where("doc_id % 3 = 0").withColumn("quality", F.lit(9)), ["doc_id"])


@query(f"""WITH {SQL_PAGED}, c AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS u, row_number() OVER (PARTITION BY doc ORDER BY ordinal DESC) AS d FROM paged), k AS (SELECT doc, ordinal FROM c WHERE u <= 4 OR d <= 4 OR ordinal % 6 = 0),
x AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS u, row_number() OVER (PARTITION BY doc ORDER BY ordinal DESC) AS d FROM k) SELECT doc, ordinal FROM x WHERE u <= 6 OR d <= 6""")
def q_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = paged_lines(spark, sf_dir).withColumns({"type": F.expr("if(ordinal % 6 = 0, 'TABLE', 'PARAGRAPH')"), "heading": F.lit(False)})
    return batches.overview(b, most=12).select("doc", "ordinal")


# --- tasks ---------------------------------------------------------------------------------------


def order_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: P pending, O running, F failed; every fourth is a first try, the others retry the one before."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.expr("case o_orderstatus when 'P' then 'PENDING' when 'O' then 'RUNNING' else 'FAILED' end").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("heartbeat_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), F.col("o_orderpriority").alias("task_type"), F.lit("w").alias("worker_id"), F.expr("if(o_orderkey % 4 = 0, null, o_orderkey - 1)").alias("source_task_id"),
    )


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def q_task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.page(order_tasks(spark, sf_dir), 3, 20, F.col("status") == "PENDING").select("id", "created_at")


@query("SELECT o_orderpriority AS task_type, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS id, arg_min(o_orderkey % 4, struct_pack(d := o_orderdate, k := o_orderkey))::INT + 1 AS attempt_count, 'RUNNING' AS status FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 < 3 GROUP BY o_orderpriority")
def q_claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.claim_next(order_tasks(spark, sf_dir), "w1", F.lit("2024-01-01").cast("timestamp"), ["task_type"]).select("task_type", "id", "attempt_count", "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 4 >= 3 THEN 'WORKER_LOST' END AS error FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 3600 SECOND")
def q_stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.recover_stale(order_tasks(spark, sf_dir), F.lit("1997-01-01").cast("timestamp"), 3600).select("id", "status", "error")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS event_type, max(ts) AS ts, count(*) AS events FROM events GROUP BY user_id")
def q_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.current_state(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""WITH RECURSIVE r(id, up, steps) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION ALL SELECT r.id, r.up - 1, r.steps + 1 FROM r WHERE r.up % 4 <> 0 AND r.up IN (SELECT o_orderkey FROM orders))
SELECT id, min(up) AS root, max(steps) AS steps FROM r GROUP BY id""")
def q_retry_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.lineage(order_tasks(spark, sf_dir).select("id", "source_task_id"))


@query("SELECT o_orderkey + 1000000000 AS id, o_orderkey AS source_task_id, 'PENDING' AS status, 0 AS attempt_count FROM orders WHERE o_orderstatus = 'F'")
def q_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.retry(order_tasks(spark, sf_dir), F.col("id") + 1000000000, F.lit("2024-01-01").cast("timestamp")).select("id", "source_task_id", "status", "attempt_count")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' - INTERVAL 30 DAY")
def q_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.expired(order_tasks(spark, sf_dir), F.lit("1995-01-01").cast("timestamp"), 30).select("id")


@query("""WITH m AS (SELECT 'src' || (CASE WHEN n = 0 THEN '1' ELSE '1' || n END) AS old, 'file' || n AS new FROM range(0, 10) t(n)), r AS (SELECT DISTINCT source || ':' || lang AS ref FROM documents)
SELECT ref, coalesce((SELECT arg_max(new || substr(ref, length(old) + 1), length(old)) FROM m WHERE starts_with(ref, old)), ref) AS new_ref FROM r""")
def q_remap_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", "lang").alias("ref")).distinct()
    mapping = spark.range(10).select(F.expr("concat('src1', if(id = 0, '', cast(id as string)))").alias("old"), F.concat(F.lit("file"), F.col("id").cast("string")).alias("new"))
    return tasks.remap_references(refs, mapping)


@query("SELECT c_custkey AS id, (c_custkey % 3 + c_custkey % 5)::INT AS risk_count, (c_custkey % 2)::INT AS review_count FROM customer")
def q_backfill_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part: Callable[[int], Column] = lambda n: (F.col("c_custkey") % n).cast("int")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), part(3).alias("high"), part(5).alias("medium"), part(2).alias("low"), F.lit(None).cast("int").alias("info"))
    return tasks.backfill_counts(c).select("id", "risk_count", "review_count")


@query(f"""SELECT l_orderkey AS review, CAST(sum(CAST(l_quantity AS DECIMAL({values.DECIMAL[8:-1]}))) AS DECIMAL(38,2)) AS total FROM lineitem GROUP BY l_orderkey""")
def q_value_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("l_quantity").cast("string"), F.lit(" pcs"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review"), values.number(raw).alias("v")).groupBy("review").agg(F.sum("v").cast("decimal(38,2)").alias("total"))


# --- candidates ----------------------------------------------------------------------------------


def found_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


@query("SELECT doc_id, count(*) AS percentages FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[-+]?([0-9]{1,3}([,，][0-9]{3})+|[0-9]+)([.][0-9]+)?\\s*(%|％|百分之)')) FROM documents) GROUP BY doc_id")
def q_percentage_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_spans(spark, sf_dir).where("kind = 'PERCENTAGE'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("percentages"))


@query()
def q_numeric_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.numeric_candidates(found_spans(spark, sf_dir), ["doc_id"])


SQL_LABEL = f"""CASE WHEN length(m) BETWEEN 1 AND 40 AND NOT regexp_matches(m, '[，。；;：:]') AND NOT regexp_matches(m, '{tx.LISTED}') THEN regexp_replace(m, '{tx.CLAUSE_NUMBER}', '') END"""


@query(f"""WITH l AS (SELECT doc_id AS doc, ordinal, translate({SQL_COLLAPSE.format("line")}, '{SQL_IGNORED}', '') AS m FROM ({SQL_LINES}) WHERE trim(line) <> '')
SELECT doc, ordinal, last_value({SQL_LABEL} IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM l""")
def q_last_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines_of(spark, sf_dir).select(F.col("doc_id").alias("doc"), "ordinal", tx.collapse(F.col("line")).alias("text"))
    return candidates.with_chapter(d, strict=False).select("doc", "ordinal", "chapter")


@query()
def q_page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document against the same lines cut in two, with a page for every ten halves."""
    local = lines_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.lit("PARAGRAPH").alias("kind"), "ordinal", F.col("line").alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.filter(F.array(F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))), lambda p: p != "")
    external = local.select("file", "kind", "ordinal", F.posexplode(parts).alias("i", "text")).select("file", "kind", (F.col("ordinal") * 2 + F.col("i")).alias("ordinal"), "text", F.floor(F.col("ordinal") / 5).cast("int").alias("page"))
    return pages.align_pages(local, external)


@query()
def q_document_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.document_similarity(*versions(spark, sf_dir))


from tessera.plans import assembly as _assembly  # noqa: E402, F401  registers its queries beside these
