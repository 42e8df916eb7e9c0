"""Uploads, batches, searches, the public functions and the command line."""

import pytest
from pyspark.sql import functions as F

from brindle import __main__ as cli
from brindle import api
from brindle.operators import columns, results, retrieval, tokenizer
from brindle.plans import catalogue, catalogue_flows, flows, records
from brindle.sources import workbooks

SF = "/root/testdata/sf0.001"
CELLS = "sheet string, sheet_ord int, row_idx int, cells array<string>"


def cells(spark, *sheets):
    return spark.createDataFrame([(name, k, j, row) for k, (name, rows) in enumerate(sheets) for j, row in enumerate(rows)], CELLS)


def names(df):
    return [(r.item_index, r.raw_name) for r in df.orderBy("item_index").collect()]


def test_upload_of_a_workbook(spark, tmp_path):
    """A workbook on disk, through the whole flow; other file types are passed over."""
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook_bytes({"one": (["品名", "数量"], [["油", 1], [None, 2], [" 盐 ", 3]]), "two": (["备注"], [["x"]])}))
    (tmp_path / "b.txt").write_text("no workbook")
    up = flows.parse_upload(workbooks.read_workbooks(spark, str(tmp_path)).drop("file"))
    assert names(up.items) == [(0, "油"), (1, "盐")]
    assert {r.sheet: r.columns for r in up.sheets.collect()} == {"one": ["品名", "数量"], "two": ["备注"]}
    assert [r.name for r in up.columns.orderBy("ord").collect()] == ["品名", "数量"]


def test_upload_choices(spark):
    c = cells(spark, ("a", [["备注", "品名"], ["x", "油"]]), ("b", [["商品名称", "品名"], ["盐", "糖"]]), ("c", [["产地", "单位"], ["甲", "乙"]]))
    assert names(flows.parse_upload(c).items) == [(0, "油"), (1, "糖")]  # only 品名 is common
    assert names(flows.parse_upload(c, sheet="b").items) == [(0, "盐")]
    assert names(flows.parse_upload(c, sheet="b", column="品").items) == [(0, "盐")]
    assert names(flows.parse_upload(c, sheet="none").items) == []
    assert names(flows.parse_upload(c, column="单位").items) == []
    assert names(flows.parse_sheet(c, "c", "单位(箱)")) == [(0, "乙")]
    assert names(flows.parse_sheet(c, "c", "价格")) == []
    assert names(flows.parse_with_fallback(c, lambda labels: "产地名" if "产地" in labels else None)) == [(0, "油"), (1, "盐"), (2, "甲")]
    assert names(flows.parse_upload(c.limit(0)).items) == []


def test_batch_is_its_parts(spark):
    up, words, cat = catalogue_flows.uploads(spark, SF).where("sheet_ord < 6"), catalogue.dictionaries(spark, SF), catalogue.catalog(spark, SF)
    got = {r.seq: r for r in flows.batch_sheets(up, words, cat, "商品名称").collect()}
    items = {k + 1: n for k, n in names(flows.parse_upload(up, column="商品名称").items)}
    assert {k: r.customer_name for k, r in got.items()} == items
    known = {r.core_name for r in cat.select("core_name").distinct().collect()}
    assert all(r.selected_name == r.customer_name for r in got.values() if r.customer_name in known and r.selected_name != "未匹配")
    assert any(r.selected_code for r in got.values())


def test_matcher_keeps_its_index(spark, tmp_path):
    cat, asked = catalogue.catalog(spark, SF), catalogue.requests(spark, SF)
    kept = api.ProductMatcher(cat, catalogue.dictionaries(spark, SF), str(tmp_path / "index"))
    row = lambda d: sorted((r.q, r.doc_id, r.rank) for r in d.select("q", "doc_id", "rank").collect())
    assert row(kept.match(asked, 3)) == row(retrieval.match(asked, cat, 3))


def test_public_functions(spark):
    words = records.Dictionaries(spark.createDataFrame([("金龙鱼",)], "brand string"), ["大豆油"], ["一级"])
    got = api.normalize_query(spark, "金龙鱼牌一级大豆油5L", words)
    assert got["detected_brand"] == "金龙鱼" and got["attributes"] == ["一级"] and got["normalized_spec"] == "5L"
    df = spark.createDataFrame([("大豆油 5L",)], "n string")
    row = df.select(api.normalize_product_name(F.col("n")).alias("a"), api.tokens_to_json(api.tokenize_text(F.col("n"), [], ["大豆油"])).alias("t")).first()
    assert row.a == "大豆油 5L" and row.t == '["大豆油","5L"]'


def test_command_line(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,金龙鱼牌大豆油5L\n")
    (tmp_path / "brands.csv").write_text("brand\n金龙鱼\n")
    assert cli.main(["normalize", "-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out"), "--brands", str(tmp_path / "brands.csv"), "--log-level", "ERROR"]) == 0
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["id", "name", *cli.RECORD_COLUMNS] and got.first().detected_brand == "金龙鱼"
    (tmp_path / "lines.csv").write_text("line\nSNACKS 小食 香脆椒\nPLAIN\n")
    assert cli.main(["order-lines", "-i", str(tmp_path / "lines.csv"), "-o", str(tmp_path / "orders"), "--name", "line", "--log-level", "ERROR"]) == 0
    assert [r.name for r in spark.read.parquet(str(tmp_path / "orders")).collect()] == ["香脆椒"]


@pytest.mark.parametrize("answer", ["没有", None])
def test_fallback_without_an_answer(spark, answer):
    labels = spark.createDataFrame([("s", 0, "产地")], "sheet string, ord int, name string")
    assert columns.detect_with_fallback(labels, lambda _: answer) == (None, None)


def test_spec_hits():
    t = tokenizer.Tokenizer([], ["酱油", "玉米"])
    assert t.hits(["酱油", "玉米", "阿"]) == 4 + ("阿" in tokenizer.LEGAL_SINGLES)


def test_numbers_over_runs(spark):
    rows = spark.createDataFrame([(k,) for k in (5, 1 << 21, 3, (1 << 33) + 2, 1 << 33, (1 << 21) + 9)], "at long")
    got = {r.at: r.k for r in results.numbered(rows, "at", "k", 0).collect()}
    assert got == {v: k for k, v in enumerate(sorted(got))}
    assert results.numbered(rows.limit(0), "at", "k").count() == 0
