"""Registered queries of uploads, price records, searches, batches and reports, with their DuckDB
equivalents.  Uploads: one sheet a brand, a title row, the header and a row a part; every third sheet has
no name column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle import api
from brindle.functions import scores, text
from brindle.operators import brands, columns, hotel, pricing, results, retrieval, tokenizer
from brindle.plans import flows, records
from brindle.plans.catalogue import BM25_SQL, JACCARD_SQL, LATEST_SQL, PREFERRED, QUOTE_ORDER, SCORED_PARTS, SCORED_SQL, SPEC_WORDS, P, SIZE, catalog, dictionaries, latest_procurements, latest_quotes, named, query, requests, scored_parts, table
from brindle.sources import workbooks

ORD = "string_split(p_brand, '#')[2]::INT"
SHEET = "Brand#2"


def uploads(spark, sf) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_size", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1).alias("row_idx"))
    ord_ = F.substring_index("p_brand", "#", -1).cast("int")
    cells = lambda *c: F.array(*[F.lit(x) if x is None or isinstance(x, str) else x for x in c])
    row = lambda d, at, c: d.select(F.col("p_brand").alias("sheet"), ord_.alias("sheet_ord"), at.alias("row_idx"), c.alias("cells"))
    b = p.select("p_brand").distinct()
    head = F.when(ord_ % 3 == 0, cells("备注", "编码", "数量")).otherwise(cells("客户名称", "商品名称", "数量"))
    body = cells("c", F.when(F.col("p_size") % 9 > 0, F.concat(F.lit(" "), "p_name")), F.col("p_size").cast("string"))
    return row(b, F.lit(0), cells("Tender 2024", None, None)).unionByName(row(b, F.lit(1), head)).unionByName(row(p, F.col("row_idx"), body))


ITEMS_SQL = "SELECT row_number() OVER (ORDER BY " + ORD + ", p_partkey) - 1 AS item_index, p_name AS raw_name FROM part WHERE p_size % 9 > 0 AND {0}"


@query(ITEMS_SQL.format(f"{ORD} % 3 > 0"))
def upload_parse(spark, sf):
    """S3 S8 U1 U2 U5 P1 P5 P6 W6 FL1 UD9: sheets without a name column are left out."""
    return flows.parse_upload(uploads(spark, sf)).items


@query(f"SELECT DISTINCT p_brand AS sheet, CASE WHEN {ORD} % 3 = 0 THEN '备注|编码|数量' ELSE '客户名称|商品名称|数量' END AS labels FROM part")
def upload_sheets(spark, sf):
    """S7 UD9."""
    return flows.parse_upload(uploads(spark, sf)).sheets.select("sheet", F.array_join("columns", "|").alias("labels"))


@query("SELECT * FROM (VALUES (0, '客户名称'), (1, '商品名称'), (2, '数量')) t(ord, name)")
def upload_common_columns(spark, sf):
    """The columns the sheets with names share."""
    return flows.parse_upload(uploads(spark, sf)).columns


@query(ITEMS_SQL.format(f"p_brand = '{SHEET}'"))
def upload_one_sheet(spark, sf):
    """An explicit sheet, header row and a label the column is contained in."""
    return flows.parse_sheet(uploads(spark, sf), SHEET, "商品名称列", 1)


@query(ITEMS_SQL.format(f"{ORD} = (SELECT min({ORD}) FROM part WHERE {ORD} % 3 = 0)"))
def upload_first_sheet(spark, sf):
    """No sheet has a name column, so the first counts; the column is asked for in part."""
    return flows.parse_upload(uploads(spark, sf).where("sheet_ord % 3 = 0"), column="编").items


@query(ITEMS_SQL.format("true"))
def upload_with_fallback(spark, sf):
    """P7 UD4 UD17 S20: a pluggable answer names the column where no rule does."""
    return flows.parse_with_fallback(uploads(spark, sf), lambda labels: "编码" if "编码" in labels else None)


@query(f"SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS row_idx, p_size::VARCHAR AS amount FROM part WHERE p_brand = '{SHEET}' ORDER BY p_partkey LIMIT 10")
def upload_preview(spark, sf):
    """T6 UD12: the first ten rows of a sheet."""
    return flows.upload_preview(uploads(spark, sf), SHEET).select("row_idx", F.get("cells", F.lit(2)).alias("amount"))


@query(f"SELECT DISTINCT p_brand AS sheet, CASE WHEN {ORD} % 3 > 0 THEN 1 ELSE 0 END AS header, CASE WHEN {ORD} % 3 > 0 THEN '商品名称' END AS name_column FROM part")
def header_legacy(spark, sf):
    """S5 P2."""
    cells = uploads(spark, sf)
    headers = columns.first_keyword_rows(cells)
    return headers.join(columns.name_columns(workbooks.sheet_columns(cells, headers), columns.LEGACY_STRONG, None), "sheet")


@query(f"SELECT DISTINCT p_brand AS sheet, CASE WHEN {ORD} % 3 > 0 THEN 1 ELSE 0 END AS header FROM part")
def header_exact(spark, sf):
    """S15."""
    return columns.exact_header_rows(uploads(spark, sf))


@query(
    f"""WITH r AS (SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS k, 'c | ' || CASE WHEN p_size % 9 > 0 THEN ' ' || p_name ELSE '' END || ' | ' || p_size AS l FROM part
UNION ALL SELECT DISTINCT p_brand, 0, 'Tender 2024 |  | ' FROM part
UNION ALL SELECT DISTINCT p_brand, 1, CASE WHEN {ORD} % 3 = 0 THEN '备注 | 编码 | 数量' ELSE '客户名称 | 商品名称 | 数量' END FROM part)
SELECT sheet, string_agg('Row' || k || ': ' || l, chr(10) ORDER BY k) AS text FROM r WHERE k < 25 GROUP BY 1"""
)
def rows_text(spark, sf):
    """P8."""
    return columns.rows_as_text(uploads(spark, sf))


@query(f"SELECT p_brand AS sheet, {ORD} AS sheet_ord, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS row_idx, p_partkey::VARCHAR AS code, p_name || '&<a>' AS name FROM part UNION ALL SELECT DISTINCT p_brand, {ORD}, 0, 'code', '品名' FROM part")
def workbook_codec(spark, sf):
    """Each brand's rows written as a workbook and read back, where they lie."""
    ord_ = F.substring_index("p_brand", "#", -1).cast("int")
    rows = table(spark, sf, "part").select("p_brand", ord_.alias("o"), "p_partkey", F.concat("p_name", F.lit("&<a>\x01")).alias("name"))

    def through(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("p_partkey")
        book = workbooks.workbook_bytes({frame["p_brand"].iloc[0]: (["code", "品名"], zip(frame["p_partkey"].astype(str), frame["name"]))})
        return pd.DataFrame([(s, int(frame["o"].iloc[0]), k, *cells) for s, _, k, cells in workbooks.parse_workbook(book)], columns=["sheet", "sheet_ord", "row_idx", "code", "name"])

    return rows.groupBy("p_brand").applyInPandas(through, "sheet string, sheet_ord int, row_idx int, code string, name string")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size::VARCHAR END AS a, CASE WHEN p_size % 5 > 0 THEN p_name END AS b FROM part WHERE p_size % 15 > 0")
def blank_rows(spark, sf):
    """FL3."""
    p = table(spark, sf, "part").select(F.when(P("p_size") % 15 > 0, P("p_partkey")).alias("id"), F.when(P("p_size") % 3 > 0, SIZE()).alias("a"), F.when(P("p_size") % 5 > 0, P("p_name")).alias("b"))
    return results.drop_empty_rows(p)


@query("SELECT DISTINCT trim(p_type) AS word, length(trim(p_type)) AS length FROM part WHERE p_size % 4 > 0 AND p_brand = 'Brand#2'")
def word_lists(spark, sf):
    """S13 S14."""
    raw = table(spark, sf, "part").select(F.when(P("p_size") % 4 > 0, F.concat(F.lit(" "), P("p_brand"))).alias("category"), F.concat(F.lit(" "), P("p_type"), F.lit(" ")).alias("word"))
    return brands.word_dictionary(raw, "category", "word", SHEET)


@query("SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'a|油' ELSE '' END AS core_tokens, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part")
def catalog_reader(spark, sf):
    """S10."""
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.when(P("p_size") % 2 == 0, '["a", "油"]').otherwise("nan").alias("core_tokens"), F.when(P("p_size") % 3 > 0, P("p_brand")).alias("brand"))
    out = records.read_catalog(raw, lists=["core_tokens"], texts=["brand"])
    return out.withColumn("core_tokens", F.array_join("core_tokens", "|"))


@query("SELECT p_partkey AS id, p_name || '!' AS name, length(p_name) AS n, 'x' || p_size AS note, p_size AS last, 'id,name,n,note,last' AS labels FROM part")
def insert_columns(spark, sf):
    """S16 F18."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(P("p_name"), F.lit("\x00!\x0b")).alias("name"), P("p_size").alias("last"), F.length("p_name").alias("n"), F.concat(F.lit("x\x1f"), SIZE()).alias("note"))
    out = records.with_columns_after(p, "name", ["n", "note"])
    return out.withColumn("labels", F.lit(",".join(out.columns)))


@query("SELECT p_partkey AS id, p_size::VARCHAR AS whole, p_size || '.5' AS half, p_name || 'ab' AS clean FROM part")
def number_format(spark, sf):
    """F17 F18."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), text.format_number(P("p_size").cast("double")).alias("whole"), text.format_number(P("p_size") + 0.5).alias("half"), text.strip_control(F.concat(P("p_name"), F.lit("\x07a\x7fb\x08"))).alias("clean"))


# --------------------------------------------------------------------------- order lines


@query("SELECT p_partkey AS item_index, CASE WHEN p_size % 2 = 0 THEN '香脆鸡 (' ELSE '青豆 方 (' END || '雨润牌) ' || p_size || 'KG' AS preprocessed_name, 'special' AS preprocess_method FROM part")
def special_items(spark, sf):
    """Categories, countries and the character table come from tables."""
    lists = spark.createDataFrame([("category", "豆制品", None), ("category", "小食", None), ("country", "智利", None), ("char", "鷄", "鸡")], "kind string, word string, other string")
    words = records.Dictionaries(brands.brand_dictionary(table(spark, sf, "part"), "p_brand"), **records.order_line_lists(lists))
    zh = F.concat(F.when(P("p_size") % 2 == 0, "小食 香脆鷄").otherwise("豆制品 青豆 方"), F.lit(" (雨润) "), SIZE(), F.lit("KG PER PC 冰鲜 智利"))
    line = F.concat(F.lit("SNACKS "), F.upper("p_name"), F.lit(" DR CHN "), zh, F.lit(" ("), zh, F.lit(")"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_index"), line.alias("raw_name"))
    return records.preprocess_items(items, words).select("item_index", "preprocessed_name", "preprocess_method")


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS seq, 'SNACKS 小食 香脆椒 ' || p_size || 'KG' AS original, '香脆椒 ' || p_size || 'KG' AS name FROM part WHERE p_size % 3 > 0")
def order_line_export(spark, sf):
    """S18."""
    line = F.when(P("p_size") % 3 == 0, "NO CHINESE").when(P("p_size") % 3 == 1, F.concat(F.lit("SNACKS 小食 香脆椒 "), SIZE(), F.lit("KG "))).otherwise(F.concat(F.lit(" SNACKS 小食 香脆椒 "), SIZE(), F.lit("KG")))
    return hotel.export_order_lines(table(spark, sf, "part").select("p_partkey", line.alias("line")), "line", "p_partkey")


# --------------------------------------------------------------------------- tokens


@query("SELECT p_partkey AS id, list_concat(['酱油', '阿宝', '玉米', '散称'], CASE WHEN p_size % 2 = 0 THEN ['大块', '头肉'] ELSE ['平底锅'] END) AS tokens FROM part")
def tokens_fallback(spark, sf):
    """A segmenter of pairs takes over where the cover finds no word."""
    pairs = lambda run: [run[k : k + 2] for k in range(0, len(run), 2)]
    n = named(spark, sf, "酱油阿宝玉米 称重 ", F.when(P("p_size") % 2 == 0, "大块头肉").otherwise("平底锅"))
    words = ["酱油", "玉米", "平底锅"]
    return n.select("id", tokenizer.tokenize([], words, pairs)(F.col("name")).alias("tokens"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_size || 'kg' AS name, CASE WHEN p_size % 2 = 0 THEN '非转基因' ELSE '一级' END AS attributes, '酱油' AS word FROM part")
def sql_functions(spark, sf):
    """UD1: tokenizer and attribute words called from SQL."""
    api.register(spark, spec_words=SPEC_WORDS, detail_words=["非转基因", "一级"])
    view = named(spark, sf, P("p_name"), " ", SIZE(), "kg").withColumn("size", F.lit(1)).drop("size")
    view.join(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id").createOrReplaceTempView("brindle_names")
    return spark.sql("SELECT id, name, array_join(brindle_attributes(CASE WHEN p_size % 2 = 0 THEN '非转基因油' ELSE '一级油' END), ',') AS attributes, element_at(brindle_tokens(concat(name, ' 酱油')), -1) AS word FROM brindle_names")


# --------------------------------------------------------------------------- prices

RECORD_SQL = f"""rec AS (SELECT l_partkey::VARCHAR AS code, p_name AS product_name, 'Q' || o_orderkey AS quote_name, round(l_extendedprice, 2) AS unit_price, round(l_extendedprice - l_tax, 2) AS unit_price_without_tax,
 CASE WHEN l_linenumber % 2 = 0 THEN round(l_discount, 2) END AS purchase_price, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag ELSE '' END AS tax_rate, o_orderpriority AS company, c_name AS customer_name, c_mktsegment AS project_site, s_name AS supplier_name, l_linestatus AS unit,
 strftime(o_orderdate, '%Y-%m-%d') AS quote_time, o_orderstatus AS valid_period, o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_suppkey, contains(c_name, '77') OR contains(c_name, '13') AS p
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey),
kept AS (SELECT * FROM (SELECT *, bool_or(p) OVER (PARTITION BY code) AS any_p FROM rec) WHERE p OR NOT any_p),
last AS (SELECT *, count(*) OVER (PARTITION BY code) AS records_count, row_number() OVER (PARTITION BY code ORDER BY {LATEST_SQL}) AS k FROM kept)"""


def price_rows(spark, sf) -> DataFrame:
    o, li, c, s, p = (table(spark, sf, t) for t in ("orders", "lineitem", "customer", "supplier", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    return rows.select(
        F.col("l_partkey").alias("code"), F.col("p_name").alias("product_name"), F.concat(F.lit("Q"), F.col("o_orderkey").cast("string")).alias("quote_name"), F.col("l_extendedprice").alias("unit_price"), (F.col("l_extendedprice") - F.col("l_tax")).alias("unit_price_without_tax"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount").cast("string")).otherwise("-").alias("purchase_price"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_returnflag")).alias("tax_rate"), F.col("o_orderpriority").alias("company"), F.col("c_name").alias("customer_name"), F.col("c_mktsegment").alias("project_site"),
        F.col("s_name").alias("supplier_name"), F.col("l_linestatus").alias("unit"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("quote_time"), F.col("o_orderstatus").alias("valid_period"), *QUOTE_ORDER,
    )


@query("WITH " + RECORD_SQL + " SELECT code, " + ", ".join(flows.QUOTE_TEXTS + flows.QUOTE_PRICES) + ", records_count FROM last WHERE k = 1")
def quote_record(spark, sf):
    """All 14 fields of the latest quote, preferred customers first."""
    return flows.quote_records(price_rows(spark, sf), QUOTE_ORDER, PREFERRED)


@query(
    """SELECT code, product_name, supplier_name, start_time, end_time, procurement_price, records_count FROM (SELECT l_partkey::VARCHAR AS code, p_name AS product_name, s_name AS supplier_name, strftime(l_shipdate, '%Y-%m-%d') AS start_time, '' AS end_time, round(l_extendedprice, 2) AS procurement_price,
 count(*) OVER (PARTITION BY l_partkey) AS records_count, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_suppkey DESC) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey) WHERE k = 1"""
)
def procurement_record(spark, sf):
    """All 6 fields."""
    li, s, p = (table(spark, sf, t) for t in ("lineitem", "supplier", "part"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(p, li.l_partkey == p.p_partkey)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_suppkey"]
    rows = rows.select(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(".0")).alias("code"), F.col("p_name").alias("product_name"), F.col("s_name").alias("supplier_name"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.col("l_extendedprice").alias("procurement_price"), *order)
    return flows.procurement_records(rows, order)


@query(
    f"""WITH quotes AS (SELECT l_partkey AS code, round(l_extendedprice / l_quantity, 6) AS unit_price, c_name AS customer, o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {LATEST_SQL}) AS k FROM quotes) WHERE k = 1)
SELECT p_partkey::VARCHAR AS code, p_name AS name, customer, unit_price FROM part LEFT JOIN q ON q.code = p_partkey"""
)
def price_json(spark, sf):
    """Fields read back from the JSON of a priced result."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("item_index"), F.col("p_partkey").alias("code"))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_index"), F.col("p_name").alias("name"))
    out = pricing.assemble(p, items, latest_quotes(spark, sf), latest_procurements(spark, sf))
    got = lambda path: F.get_json_object("json", path)
    return out.select(got("$.code").alias("code"), got("$.name").alias("name"), got("$.quote.customer").alias("customer"), got("$.quote.unit_price").cast("double").alias("unit_price"))


@query("SELECT c_custkey, c_custkey % 3 < 2 AS hit FROM customer")
def customer_pattern(spark, sf):
    """FL9."""
    c = table(spark, sf, "customer")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " shangri-la").when(F.col("c_custkey") % 3 == 1, "香格里拉大酒店"))
    return c.select("c_custkey", flows.preferred_customer(name).alias("hit"))


# --------------------------------------------------------------------------- matches

RANKED_SQL = "WITH " + JACCARD_SQL + BM25_SQL + SCORED_SQL
BY_SCORE = "SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s"
BY_CONFIDENCE = f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS sr FROM s) WHERE sr <= 50), f AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(confidence, 2) DESC, sr) AS rank FROM t), quotes AS (SELECT l_partkey AS code, round(l_extendedprice / l_quantity, 6) AS unit_price, o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey), lq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY {LATEST_SQL}) AS k FROM quotes) WHERE k = 1)"


@query(RANKED_SQL.replace("<= 200", "<= 500") + f"SELECT q, doc_id, round(score, 6) AS score, rank FROM ({BY_SCORE}) WHERE rank <= 50")
def extended_recall(spark, sf):
    """R6."""
    return retrieval.match(requests(spark, sf), catalog(spark, sf), 50, 500).select("q", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 1 THEN 0.0 ELSE 0.35 END AS brand_bonus, CASE WHEN p_size % 2 = 0 AND p_size % 3 <> 1 THEN 0.3 ELSE 0.0 END AS bulk_bonus FROM part")
def bonuses(spark, sf):
    """R10."""
    asked = F.when(P("p_size") % 4 == 0, P("p_brand")).when(P("p_size") % 4 == 1, "").otherwise("Brand")
    spec, found = F.when(P("p_size") % 2 == 0, "").otherwise("500g"), F.when(P("p_size") % 3 == 0, "散称").when(P("p_size") % 3 == 1, "500g").otherwise("称重 箱")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scores.brand_bonus(asked, P("p_brand")).alias("brand_bonus"), scores.bulk_bonus(spec, found).alias("bulk_bonus"))


def _priced(spark, sf) -> DataFrame:
    q, c = requests(spark, sf), catalog(spark, sf).withColumn("code", F.col("doc_id"))
    blank = spark.createDataFrame([(-1, " ", [], "", "", [])], "q long, core_name string, core_tokens array<string>, brand string, spec string, attributes array<string>")
    key = lambda d: d.withColumn("code", F.col("code").cast("string"))
    return flows.match_and_price(q.unionByName(blank), c, key(latest_quotes(spark, sf)), key(latest_procurements(spark, sf)))


@query(RANKED_SQL + ", " + BY_CONFIDENCE + " SELECT f.q, f.doc_id::VARCHAR AS confirmed, (SELECT least(count(*) - 1, 9) FROM f g WHERE g.q = f.q AND g.rank <= 10) AS alternatives, lq.unit_price FROM f LEFT JOIN lq ON lq.code = f.doc_id WHERE f.rank = 1 UNION ALL SELECT -1, NULL, 0, NULL")
def match_priced(spark, sf):
    """UD8 R14 R16 T7 J5 J6: all requests and a blank one, matched, confirmed and priced."""
    out = _priced(spark, sf)
    return out.select("q", "confirmed", F.greatest(F.size("alternatives"), F.lit(0)).cast("long").alias("alternatives"), "quote.unit_price")


@query(RANKED_SQL + ", " + BY_CONFIDENCE + " SELECT f.q, f.doc_id AS code, f.rank, lq.unit_price FROM f LEFT JOIN lq ON lq.code = f.doc_id WHERE f.rank = 2 AND f.q = (SELECT min(q) FROM f WHERE rank = 2)")
def select_alternative(spark, sf):
    """The second match of the first request that has one, with its prices."""
    out = _priced(spark, sf)
    one = out.where("size(alternatives) > 0").select(F.min_by(F.struct("q", F.get("alternatives", F.lit(0))["code"].alias("code")), "q").alias("x")).first().x
    key = lambda d: d.withColumn("code", F.col("code").cast("string"))
    got = flows.select_and_price(out, one.q, one.code, key(latest_quotes(spark, sf)), key(latest_procurements(spark, sf)))
    return got.select("q", "code", "rank", "quote.unit_price")


@query(
    RANKED_SQL.replace("<= 200", "<= 500")
    + f", f AS (SELECT * FROM ({BY_SCORE}) WHERE rank <= 50) SELECT a.q, a.doc_id, a.core_name AS name, a.brand, a.spec, array_to_string(a.attributes, ', ') AS attributes, round(a.score, 4) AS score, (SELECT count(*) FROM f b WHERE b.q = a.q) AS n_labels, '[1] ' || a.core_name || '  (编码:' || a.doc_id || ', 得分:' || printf('%.4f', round(a.score, 4)) || ')' AS label FROM f a WHERE rank = 1"
)
def search_labels(spark, sf):
    """The best product of each request and the labels of up to 50."""
    out = flows.search_product(requests(spark, sf), catalog(spark, sf))
    return out.select("q", "doc_id", "name", "brand", "spec", "attributes", "score", F.size("labels").cast("long").alias("n_labels"), F.get("labels", F.lit(0)).alias("label"))


@query(f"SELECT item_index + 1 AS seq, raw_name AS customer_name, c.code::VARCHAR AS selected_code, raw_name AS selected_name, 1.0::DOUBLE AS selected_score FROM ({ITEMS_SQL.format(f'{ORD} % 3 > 0')}) JOIN (SELECT p_name, min(p_partkey) AS code FROM part GROUP BY 1) c ON c.p_name = raw_name")
def batch_sheets(spark, sf):
    """The names of all sheets against the catalog that holds them: the first product of the same name
    has the best score of both kinds."""
    return flows.batch_sheets(uploads(spark, sf), dictionaries(spark, sf), catalog(spark, sf), "商品名称")


@query("SELECT p_partkey AS id, p_partkey::VARCHAR AS product_code, p_name AS product_name, round(p_size / 50, 2)::DOUBLE AS confidence, CASE WHEN p_size % 2 = 0 THEN round(p_size / 70, 4) ELSE 0.0 END::DOUBLE AS score, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS detected_brand, p_size || 'g' AS normalized_spec, p_name AS core_name, [p_type] AS attributes, p_type AS cat1, '' AS unit, 'False' AS is_yihai, p_brand AS brand, '' AS spec FROM part")
def result_projection(spark, sf):
    """P9."""
    p = table(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product_code"), P("p_name").alias("product_name"), (P("p_size") / 50).alias("confidence"), F.when(P("p_size") % 2 == 0, P("p_size") / 70).alias("score"), F.when(P("p_size") % 3 > 0, P("p_brand")).alias("detected_brand"),
        F.concat(SIZE(), F.lit("g")).alias("normalized_spec"), P("p_name").alias("core_name"), F.array("p_type").alias("attributes"), P("p_type").alias("cat1"), F.lit(None).cast("string").alias("unit"), F.lit("False").alias("is_yihai"), P("p_brand").alias("brand"), F.lit(None).cast("string").alias("spec"),
    )
    return flows.result_rows(rows, "id")


@query("SELECT count(*) FILTER (WHERE p_size % 4 > 0) AS matched, count(*) AS total FROM part")
def matched_counts(spark, sf):
    """A8."""
    return results.match_counts(scored_parts(spark, sf), "confidence")


@query("SELECT p_brand AS sheet, count(*) AS rows FROM part GROUP BY 1")
def rows_by_sheet(spark, sf):
    """A10."""
    return results.by_sheet(scored_parts(spark, sf).withColumnRenamed("p_brand", "sheet"))


@query(f"WITH {SCORED_PARTS} SELECT p_partkey FROM s WHERE confidence BETWEEN 0.2 AND 0.6 OR (confidence IS NULL AND score BETWEEN 0.2 AND 0.6)")
def score_bounds(spark, sf):
    """FL4 FL5: bounds inside the scores, both counted in."""
    return results.score_range(scored_parts(spark, sf), 0.2, 0.6).select("p_partkey")


@query("SELECT p_partkey AS q, CASE WHEN c < 0.2 OR c >= 0.6 THEN p_partkey ELSE p_partkey + 1 END AS doc_id, c >= 0.2 AND c < 0.6 AS verified FROM (SELECT *, p_size / 50 AS c FROM part)")
def judge_batches(spark, sf):
    """UD16 T7 FL5: a judge that refuses calls of more than 30 pairs and leaves out its last answer."""
    p = table(spark, sf, "part").withColumn("c", P("p_size") / 50)
    found = p.select(F.col("p_partkey").alias("q"), P("p_name").alias("raw_name"), F.col("p_partkey").alias("doc_id"), F.col("c").alias("confidence"))
    cand = p.select(F.col("p_partkey").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank"), "p_partkey").select("q", "rank", (F.col("p_partkey") + F.when(F.col("rank") < 6, 1).otherwise(2)).alias("doc_id"), F.lit("yes").alias("name"))

    def judge(pairs):
        return [True] * (len(pairs) - 1) if len(pairs) <= retrieval.PAIRS_A_CALL else [False] * len(pairs)

    return retrieval.review(found, cand, judge).select("q", "doc_id", "verified")


# --------------------------------------------------------------------------- reports


@query("SELECT p_type, CASE p_type WHEN 'PROMO' THEN '饮料' WHEN 'LARGE' THEN '水果' ELSE p_type END AS category, count(*) AS n FROM part GROUP BY 1, 2")
def quote_categories(spark, sf):
    """DO1."""
    p = table(spark, sf, "part")
    kind = F.when(P("p_type") == "PROMO", "水饮类").when(P("p_type") == "LARGE", "水果类").otherwise(P("p_type"))
    return p.groupBy("p_type", flows.quote_category(kind).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT coalesce(bucket, 'total') AS bucket, round(sum(p_retailprice), 2) AS amount, round((sum(p_retailprice) - sum(p_size)) / sum(p_retailprice), 6) AS margin FROM (SELECT *, CASE WHEN p_brand = 'Brand#2' THEN 'own' ELSE 'other' END || '/' || CASE WHEN p_size % 2 = 0 THEN 'direct' ELSE 'warehouse' END AS bucket FROM part) GROUP BY ROLLUP(bucket)")
def margin_summary(spark, sf):
    """DO2."""
    return flows.margin_summary(table(spark, sf, "part"), P("p_brand") == SHEET, P("p_size") % 2 == 0, P("p_retailprice"), P("p_size"))


@query("SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS k, count(*) OVER () AS n FROM part WHERE p_type = 'PROMO' AND contains(p_name, 'ring')) WHERE k // 10 = least(1, (n - 1) // 10)")
def list_search(spark, sf):
    """DO4: the second page of ten, or the last, of a filtered list."""
    rows = results.picker(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), ["PROMO"], None, "ring", "p_type", ("p_name",))
    return results.page(rows, ["p_partkey"], 2, 10).select("p_partkey", "p_name")


@query("SELECT p_type, count(*) FILTER (WHERE p_size % 3 = 0) AS market, count(*) FILTER (WHERE p_size % 3 = 1) AS fixed, count(*) FILTER (WHERE p_size % 3 = 2) AS agreed FROM part GROUP BY 1")
def category_matrix(spark, sf):
    """DO5."""
    p = table(spark, sf, "part").withColumn("mode", F.element_at(F.array(F.lit("market"), F.lit("fixed"), F.lit("agreed")), (P("p_size") % 3 + 1).cast("int")))
    return flows.category_matrix(p, "p_type", "mode", ["market", "fixed", "agreed"])


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN round(p_retailprice / p_size * 1000, 4) WHEN p_size % 3 = 1 THEN round(p_retailprice / p_size, 4) END AS price FROM part")
def unit_prices(spark, sf):
    """DO6."""
    unit = F.when(P("p_size") % 3 == 0, "g").when(P("p_size") % 3 == 1, "L").otherwise("箱")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), flows.unit_price(P("p_retailprice"), P("p_size"), unit).alias("price"))
