"""Header rows, name columns and common columns of uploaded sheets, as relational rules over
cells(sheet, sheet_ord, row_idx, cells ARRAY<STRING>) and columns(sheet, ord, name)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- fixed values
STRONG = [
    "商品名称", "品名", "产品名称", "商品名", "货品名称", "物料名称", "品种名称", "货物名称", "物资名称",
    "物品名称", "物件名称", "货品名", "物料名", "产品名", "Item Name", "Product Name", "Name", "Description", "描述",
    "规格型号", "型号规格", "品牌规格",
]
LOOSE = ["商品", "货品", "物料", "产品", "物品"]
LEGACY_STRONG = STRONG[:9]
NOT_PRODUCT = ["客户", "公司", "联系人", "销售员", "供应商", "部门", "备注"]
EXACT_NAMES = ["商品名称", "标准产品名称", "产品名称", "品名"]


def suspicious(c: Column) -> Column:
    """A title or metadata rather than a column name."""
    return F.startswith(c, F.lit("Unnamed")) | F.contains(F.lower(c), F.lit("tender")) | c.rlike("招标|投标") | (F.length(c) > 40)


def not_product(c: Column) -> Column:
    return c.rlike("|".join(NOT_PRODUCT))


def header_rows(cells: DataFrame, max_scan: int = 20) -> DataFrame:
    """(sheet, header): among the first max_scan rows with two texts or more and at most half of their
    width in digits, the first of most texts, rows with a name keyword first; else 0."""
    has = F.filter(F.transform("cells", lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    digits = F.size(F.filter(has, lambda x: F.regexp_replace(x, r"[.\-]", "").rlike(r"^\d+$")))
    words = F.array(*[F.lit(w.lower()) for w in STRONG])
    key = F.exists(has, lambda x: ~suspicious(x) & F.exists(words, lambda w: F.contains(F.lower(x), w)))
    rows = cells.where(F.col("row_idx") < max_scan).select("sheet", "row_idx", F.size(has).alias("n"), digits.alias("digits"), F.size("cells").alias("width"), key.alias("key"))
    fit = (F.col("n") >= 2) & (F.col("digits") <= F.col("width") * 0.5)
    rank = F.when(fit, F.struct((~F.col("key")).alias("k"), (-F.col("n")).alias("n"), F.col("row_idx").alias("r")))
    return rows.groupBy("sheet").agg(F.coalesce(F.min(rank)["r"], F.lit(0)).alias("header"))


def first_keyword_rows(cells: DataFrame, max_scan: int = 6) -> DataFrame:
    """(sheet, header): the first of max_scan rows with a keyword, else 0."""
    words = F.array(*map(F.lit, LEGACY_STRONG))
    hit = F.exists("cells", lambda x: F.exists(words, lambda w: F.contains(F.coalesce(x, F.lit("")), w)))
    return cells.groupBy("sheet").agg(F.coalesce(F.min(F.when(hit & (F.col("row_idx") < max_scan), F.col("row_idx"))), F.lit(0)).alias("header"))


def exact_header_rows(cells: DataFrame, max_scan: int = 6) -> DataFrame:
    """(sheet, header): the first of max_scan rows with one of the exact name columns, else 0."""
    hit = F.exists("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))).isin(*EXACT_NAMES))
    return cells.groupBy("sheet").agg(F.coalesce(F.min(F.when(hit & (F.col("row_idx") < max_scan), F.col("row_idx"))), F.lit(0)).alias("header"))


def name_columns(columns: DataFrame, strong: list[str] = STRONG, loose: list[str] | None = LOOSE) -> DataFrame:
    """(sheet, name_column): strong keywords in their order, then loose ones without 编 and 码, then
    anything with 名称 or name; suspicious columns never, non-product ones only by a strong keyword.
    Null if there is none.  loose=None leaves out the second round."""
    name = F.col("name")
    ok = ~suspicious(name)
    free = ok & ~not_product(name)
    first = lambda words: F.array_position(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)), F.lit(True)).cast("int")
    way = lambda k, hit, kw: F.when(hit, F.struct(F.lit(k).alias("round"), kw.alias("kw"), F.col("ord").alias("ord")))
    ways = [way(0, ok & (first(strong) > 0), first(strong))]
    if loose:
        ways.append(way(1, free & ~name.rlike("[编码]") & (first(loose) > 0), first(loose)))
    ways.append(way(2, free & (F.contains(name, F.lit("名称")) | F.contains(F.lower(name), F.lit("name"))), F.lit(0)))
    rank = F.coalesce(*ways)
    return columns.groupBy("sheet").agg(F.min_by("name", F.when(rank.isNotNull(), rank)).alias("_c"), F.min(rank).alias("_r")).select("sheet", F.when(F.col("_r").isNotNull(), F.col("_c")).alias("name_column"))


def pick_column(columns: DataFrame, asked: str, both_ways: bool = False) -> DataFrame:
    """(sheet, name): the column asked for, else the first that contains it (or, both_ways, is in it)."""
    near = F.contains("name", F.lit(asked)) | (F.lit(both_ways) & F.contains(F.lit(asked), F.col("name")))
    rank = F.when(F.col("name") == asked, F.struct(F.lit(0).alias("k"), F.col("ord").alias("o"))).when(near, F.struct(F.lit(1).alias("k"), F.col("ord").alias("o")))
    return columns.withColumn("_r", rank).where("_r is not null").groupBy("sheet").agg(F.min_by("name", "_r").alias("name"))


def distinct_columns(columns: DataFrame) -> DataFrame:
    """The first of columns with the same label."""
    return columns.groupBy("sheet", "name").agg(F.min("ord").alias("ord"))


def common_columns(columns: DataFrame, sheets: DataFrame) -> DataFrame:
    """(ord, name) of columns all sheets have, in the first sheet's order; without any, all of the first.

    sheets: (sheet, sheet_ord)."""
    cols = distinct_columns(columns).join(sheets, "sheet")
    total = sheets.agg(F.count("*").alias("total"), F.min("sheet_ord").alias("first"))
    per = cols.groupBy("name").agg(F.count("*").alias("n"), F.min_by("ord", "sheet_ord").alias("ord"), F.min("sheet_ord").alias("so"))
    per = per.join(F.broadcast(total), F.lit(True)).where("so = first")
    shared = F.col("n") == F.col("total")
    any_ = F.max(shared).over(Window.partitionBy())
    return per.withColumn("shared", shared).withColumn("any", any_).where("shared or not any").select("ord", "name")


def detect_with_fallback(columns: DataFrame, ask: Callable[[list[str]], str | None] | None = None) -> tuple[str | None, str | None]:
    """(column, method) of one sheet: the rule, or else a pluggable answer that must match a column
    exactly or by containment either way; method is rule, ai or None."""
    rule = name_columns(columns).first()
    if rule and rule.name_column:
        return rule.name_column, "rule"
    names = [r.name for r in columns.orderBy("ord").select("name").collect()]  # one sheet's header
    said = ask(names) if ask else None
    if said:
        hit = next((n for n in names if n == said), None) or next((n for n in names if said in n or n in said), None)
        if hit:
            return hit, "ai"
    return None, None


def rows_as_text(cells: DataFrame, rows: int = 25, width: int = 100) -> DataFrame:
    """(sheet, text): the first rows as `RowN: a | b`, for a column detector's prompt."""
    cell = lambda x: F.substring(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/")), 1, width)
    line = F.concat(F.lit("Row"), F.col("row_idx").cast("string"), F.lit(": "), F.array_join(F.transform("cells", cell), " | "))
    return cells.where(F.col("row_idx") < rows).groupBy("sheet").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def sheet_items(cells: DataFrame, at: DataFrame) -> DataFrame:
    """(item_index, raw_name): non-blank cells under the header in a column of each sheet, in sheet and row
    order, numbered from 0.

    at: (sheet, header, at), the column's place; sheets without one give nothing.  A sheet is numbered in
    one task (its format bounds it), all sheets by the sums of those before."""
    rows = cells.join(F.broadcast(at.where("at >= 0")), "sheet").where("row_idx > header").select("sheet", "sheet_ord", "row_idx", F.trim(F.get("cells", F.col("at"))).alias("raw_name")).where("raw_name <> ''")
    per = rows.groupBy("sheet", "sheet_ord").agg(F.count("*").alias("_n"))
    per = per.select("sheet", (F.sum("_n").over(Window.orderBy("sheet_ord", "sheet")) - F.col("_n")).alias("_first"))  # a row a sheet
    inside = F.row_number().over(Window.partitionBy("sheet").orderBy("row_idx")) - 1
    return rows.withColumn("_k", inside).join(F.broadcast(per), "sheet").select((F.col("_first") + F.col("_k")).alias("item_index"), "raw_name")


def union_items(cells: DataFrame, headers: DataFrame, column: str) -> DataFrame:
    """(item_index, raw_name): sheet_items() of a named column over all sheets that have it."""
    at = cells.join(headers, "sheet").where("row_idx = header").select("sheet", "header", (F.array_position("cells", F.lit(column)) - 1).cast("int").alias("at"))
    return sheet_items(cells, at)
