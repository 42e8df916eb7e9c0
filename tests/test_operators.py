"""Retrieval, prices, sheets, workbooks, streams; every registered query against DuckDB."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import brands, columns, pricing, results, retrieval
from brindle.plans import catalogue, catalogue_flows, records  # noqa: F401  the second adds its queries
from brindle.sources import workbooks
from brindle.streaming import events

SF = "/root/testdata/sf0.001"


def test_bm25(spark):
    docs = spark.createDataFrame([(1, ["酱油", "味极鲜"]), (2, ["酱油"]), (3, ["大豆油"])], "doc_id long, core_tokens array<string>")
    q = spark.createDataFrame([(0, ["酱油"])], "q long, core_tokens array<string>")
    got = {r.doc_id: round(r.bm25, 6) for r in retrieval.bm25_scores(q, retrieval.bm25_index(docs)).collect()}
    assert got == {1: 0.383676, 2: 0.529582}


def test_brand_guard(spark):
    rows = [(1, k, "x", "x" if k < 5 else "y") for k in range(7)] + [(2, k, "x", "x" if k < 4 else "y") for k in range(7)]
    df = spark.createDataFrame(rows, "q int, doc_id int, q_brand string, brand string")
    assert {r.q: r["count"] for r in retrieval.brand_guard(df).groupBy("q").count().collect()} == {1: 5, 2: 7}


def test_self_retrieval(spark):
    cat = catalogue.catalog(spark, SF)
    asked = cat.groupBy("core_name", "core_tokens", "brand", "spec", "attributes").agg(F.min("doc_id").alias("q"))
    best = retrieval.match(asked, cat, 1).select("q", "doc_id").join(cat.select("doc_id", F.col("core_name").alias("found")), "doc_id").join(asked, "q")
    assert best.count() == asked.count() and best.where("found <> core_name").count() == 0


def test_equal_queries_and_products(spark, monkeypatch):
    """Equal queries are answered once and equal products scored up to the recall size; the answers are those of all pairs."""
    texts = ["酱油 味极鲜", "酱油", "大豆油 酱油"]
    cat = spark.createDataFrame([(k, texts[k % 3], texts[k % 3].split(" ")[:: 1 if k % 2 else -1], "乙" if k % 5 else "甲", f"{k % 4}g", ["x"]) for k in range(150)], "doc_id long, core_name string, core_tokens array<string>, brand string, spec string, attributes array<string>")
    rows = [(1000 + k, texts[k % 3], texts[k % 3].split(" "), "甲" if k % 2 else None, "1g" if k % 2 else None, ["x"]) for k in range(60)] + [(1, " ", [], None, None, [])]
    asked = spark.createDataFrame(rows, "q long, core_name string, core_tokens array<string>, brand string, spec string, attributes array<string>")
    some = asked.where("q > 1")
    plain = retrieval.rerank(retrieval.union_recall(retrieval.bm25_scores(some, retrieval.bm25_index(cat)), retrieval.bigram_scores(some, cat, 7), 7), some, cat, 3)
    shown = lambda d: sorted((r.q, r.rank, r.doc_id, round(r.score, 9)) for r in d.collect())
    want, scored, scores = shown(plain), [], retrieval.bm25_scores
    monkeypatch.setattr(retrieval, "bm25_scores", lambda *a: scored.append(scores(*a)) or scored[0])
    got = retrieval.match(asked, cat, 3, 7)
    assert got.columns == plain.columns and shown(got) == want and len(want) == 180
    assert scored[0].count() <= 6 * 3 * 7  # kinds of queries, kinds of products, recall size


def test_prices(spark):
    rows = [("1", 1.0, "old 77", 1), ("1", 2.0, "new", 2), ("2", 3.0, "x", None), ("2", 4.0, "y", 1)]
    q = spark.createDataFrame(rows, "code string, price double, customer string, at int")
    got = {r.code: (r.price, r.records_count) for r in pricing.latest(q, "code", ["at", "price"], ["price"], pricing.preferred(F.col("customer"), ["77", ""])).collect()}
    assert got == {"1": (1.0, 1), "2": (4.0, 2)}
    codes = spark.createDataFrame([(" 1.0 ",), ("9",)], "c string")
    assert {r.c: r.price for r in pricing.lookup(codes, q.where("at = 2"), "c", "code").collect()} == {" 1.0 ": 2.0, "9": None}


def test_brand_ties(spark):
    b = spark.createDataFrame([("aa",), ("ab",), ("b",)], "brand string")
    n = spark.createDataFrame([("xabaa",), ("海天牌ab",), ("zz",), (None,)], "name string")
    assert {r.name: r.detected_brand for r in brands.detect_brands(n, b).collect()} == {"xabaa": "ab", "海天牌ab": "海天", "zz": None, None: None}


NAMES = [
    (["序号", "客户名称", "产品编号", "品名", "数量"], "品名"), (["客户名称", "商品"], "商品"), (["产品编号", "产品"], "产品"),
    (["goods.name", "qty"], "goods.name"), (["客户名称", "菜式"], None),
]


def test_name_columns(spark):
    rows = [(str(k), j, n) for k, (names, _) in enumerate(NAMES) for j, n in enumerate(names)]
    got = {r.sheet: r.name_column for r in columns.name_columns(spark.createDataFrame(rows, "sheet string, ord int, name string")).collect()}
    assert got == {str(k): want for k, (_, want) in enumerate(NAMES)}


def test_workbooks(spark, tmp_path):
    sheets = {"a": (["投标 2024", None, None], [["序号", "品名", "数量"], [1, "酱油\x01", 2.5], [2, None, 3], [3, " 醋 ", 4]]), "b": (["品名", "数量"], [["盐", 1], ["糖", 2]])}
    (tmp_path / "x.xlsx").write_bytes(workbooks.workbook_bytes(sheets))
    (tmp_path / "y.txt").write_text("no")
    cells = workbooks.read_workbooks(spark, str(tmp_path)).cache()
    headers = columns.header_rows(cells)
    assert {r.sheet: r.header for r in headers.collect()} == {"a": 1, "b": 0}
    names = workbooks.sheet_columns(cells, headers)
    assert [r.name for r in columns.common_columns(names, cells.select("sheet", "sheet_ord").distinct()).orderBy("ord").collect()] == ["品名", "数量"]
    assert [(r.item_index, r.raw_name) for r in columns.union_items(cells, headers, "品名").orderBy("item_index").collect()] == [(0, "酱油"), (1, "醋"), (2, "盐"), (3, "糖")]
    assert workbooks.read_workbooks(spark, str(tmp_path), 1).count() == 2


def test_results(spark):
    rows = spark.createDataFrame([(1, 0.5, None), (2, 0.7, None), (3, None, None), (4, None, 0.1)], "id int, confidence double, score double")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(results.score_range(rows, 0.0, 0.6)) == [1, 3, 4] and ids(results.score_range(rows, 0.1, 0.6)) == [1, 4]
    with pytest.raises(ValueError):
        results.score_range(rows, 1.0, 0.0)
    assert ids(results.page(rows, ["id"], 9, 3)) == [4]


def test_upload_to_priced_match(spark):
    words = records.Dictionaries(spark.createDataFrame([("海天",)], "brand string"), ["酱油", "味极鲜"], ["一级"])
    raw = spark.createDataFrame([("c1", "海天牌味极鲜酱油1L/瓶"), ("c2", "大豆油(禁用)"), ("c3", "白醋500ML")], "code string, name string")
    cat = records.build_catalog(raw, words, "code", "name")
    assert cat.count() == 2
    items = spark.createDataFrame([(0, "味极鲜酱油 1L/瓶"), (1, "白醋")], "item_index int, raw_name string")
    price = spark.createDataFrame([("c1", 9.5)], "code string, unit_price double")
    got = {r.item_index: (r.top_match.code if r.top_match else None, r.quote.unit_price if r.quote else None) for r in records.preprocess_and_match(items, cat, words, price, price).collect()}
    assert got == {0: ("c1", 9.5), 1: ("c3", None)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"item_index": 1, "raw_name": "x"}\n')
    seen = []
    q = events.match_stream(spark, str(tmp_path / "in"), "item_index int, raw_name string", str(tmp_path / "cp"), lambda df, k: seen.append(df.count()))
    q.awaitTermination(60)
    assert sum(seen) == 1 and events.progress(q)["status"] == "done"


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
