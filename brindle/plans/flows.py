"""Uploads, single searches, batches of sheets and priced results, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import columns, pricing, results, retrieval
from brindle.plans import records
from brindle.sources import workbooks

# --------------------------------------------------------------------------- uploads


MAX_LABELS = 200_000


@dataclass
class Upload:
    """items (item_index, raw_name), columns (ord, name) of the merged sheets, sheets (sheet, columns)."""

    items: DataFrame
    columns: DataFrame
    sheets: DataFrame


def _small(df: DataFrame) -> DataFrame:
    """A table of a workbook's sheets or labels as a local one, so that what is built on it stays a small
    plan; refused beyond MAX_LABELS rows."""
    rows = df.limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError("too many sheets or columns")
    return df.sparkSession.createDataFrame(rows, df.schema)


def sheet_overview(cells: DataFrame) -> DataFrame:
    """(sheet, columns): the labels of each sheet, from its header row alone."""
    return _label_lists(workbooks.sheet_columns(cells, columns.header_rows(cells)))


def _label_lists(labels: DataFrame) -> DataFrame:
    return labels.groupBy("sheet").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("columns"))


def _places(cells: DataFrame, headers: DataFrame, labels: DataFrame, picked: DataFrame) -> DataFrame:
    """(sheet, header, at) of a column (sheet, name) of each sheet."""
    where = columns.distinct_columns(labels).join(picked, ["sheet", "name"]).select("sheet", F.col("ord").cast("int").alias("at"))
    return _small(headers.join(where, "sheet"))


def parse_upload(cells: DataFrame, sheet: str | None = None, column: str | None = None) -> Upload:
    """Names of a workbook's sheets (cells as of read_workbooks).

    Without a sheet, all sheets with a recognised name column count, or the first one if there is none;
    several are cut to their common columns first.  The column is the one asked for (or the first that
    contains it), else the recognised one; sheets without it are passed over.  An unknown sheet: no items."""
    order, headers = _small(cells.select("sheet", "sheet_ord").distinct()), _small(columns.header_rows(cells))
    labels = _small(workbooks.sheet_columns(cells, headers))
    if sheet is not None:
        targets = order.where(F.col("sheet") == sheet)
    else:
        found = columns.name_columns(labels).where("name_column is not null").select("sheet", F.lit(True).alias("ok"))
        every = Window.partitionBy()  # a row a sheet
        marked = order.join(found, "sheet", "left").withColumn("any", F.max("ok").over(every)).withColumn("first", F.min("sheet_ord").over(every))
        targets = marked.where("ok or (any is null and sheet_ord = first)").select("sheet", "sheet_ord")
    some = labels.join(targets.select("sheet"), "sheet")
    common = columns.common_columns(some, targets)
    kept = some.join(common.select("name"), "name", "left_semi")
    bare = some.join(kept.select("sheet").distinct(), "sheet", "left_anti")  # nothing in common: all of it
    kept = kept.select("sheet", "ord", "name").unionByName(bare.select("sheet", "ord", "name"))
    picked = columns.pick_column(kept, column) if column is not None else columns.name_columns(kept).where("name_column is not null").toDF("sheet", "name")
    return Upload(columns.sheet_items(cells, _places(cells, headers, labels, picked)), common, _label_lists(labels))


def parse_sheet(cells: DataFrame, sheet: str, column: str, header: int | None = None) -> DataFrame:
    """(item_index, raw_name) of one sheet by an explicit column and header row; the column may contain the
    label asked for or be contained in it."""
    own = cells.where(F.col("sheet") == sheet)
    headers = columns.header_rows(own) if header is None else own.select("sheet").distinct().withColumn("header", F.lit(header))
    labels = workbooks.sheet_columns(own, headers)
    return columns.sheet_items(own, _places(own, headers, labels, columns.pick_column(labels, column, both_ways=True)))


def parse_with_fallback(cells: DataFrame, ask: Callable[[list[str]], str | None] | None = None) -> DataFrame:
    """(item_index, raw_name) of all sheets; where no rule finds the column, ask(labels) may name it.

    Only the sheets without a recognised column are asked about, one by one on the driver."""
    headers = _small(columns.header_rows(cells))
    labels = _small(workbooks.sheet_columns(cells, headers))
    rule = columns.name_columns(labels)
    picked = rule.where("name_column is not null").toDF("sheet", "name")
    said = []
    for r in rule.where("name_column is null").orderBy("sheet").collect() if ask else []:  # a row a sheet
        name, how = columns.detect_with_fallback(labels.where(F.col("sheet") == r.sheet).select("sheet", "ord", "name"), ask)
        if how == "ai":
            said.append((r.sheet, name))
    if said:
        picked = picked.unionByName(cells.sparkSession.createDataFrame(said, "sheet string, name string"))
    return columns.sheet_items(cells, _places(cells, headers, labels, picked))


def upload_preview(cells: DataFrame, sheet: str, n: int = 10) -> DataFrame:
    """The first n rows under a sheet's header, blank rows left out."""
    headers = columns.header_rows(cells.where(F.col("sheet") == sheet))
    rows = cells.join(F.broadcast(headers), "sheet").where("row_idx > header").where(F.exists("cells", lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
    return results.preview(rows.select("row_idx", "cells"), ["row_idx"], n)


# --------------------------------------------------------------------------- prices

#: Fields of a price record: texts (null: empty), prices (two decimals or null).
QUOTE_TEXTS = ["product_name", "quote_name", "tax_rate", "company", "customer_name", "project_site", "supplier_name", "unit", "quote_time", "valid_period"]
QUOTE_PRICES = ["unit_price", "unit_price_without_tax", "purchase_price"]
PROCUREMENT_TEXTS = ["product_name", "supplier_name", "start_time", "end_time"]
PROCUREMENT_PRICES = ["procurement_price"]
#: Fixed value: customers once preferred without being asked for.
PREFERRED_CUSTOMER = r"(?i)香格里拉|Shangri[-\s]?La"


def preferred_customer(c: Column) -> Column:
    return F.coalesce(c.rlike(PREFERRED_CUSTOMER), F.lit(False))


def _record(rows: DataFrame, order: list, texts: list[str], prices: list[str], prefer: Column | None) -> DataFrame:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts] + [text.safe_price(F.col(c).cast("string")).alias(c) for c in prices]
    return pricing.latest(rows.withColumn("code", text.code_key(F.col("code"))), "code", order, fields, prefer)


def quote_records(quotes: DataFrame, order: list, customers: list[str] | None = None) -> DataFrame:
    """code and the 14 fields of its latest quote, of preferred customers first.  quotes: code, QUOTE_TEXTS,
    QUOTE_PRICES and what `order` needs."""
    return _record(quotes, order, QUOTE_TEXTS, QUOTE_PRICES, pricing.preferred(F.col("customer_name"), customers) if customers else None)


def procurement_records(rows: DataFrame, order: list) -> DataFrame:
    """code and the 6 fields of its latest procurement price."""
    return _record(rows, order, PROCUREMENT_TEXTS, PROCUREMENT_PRICES, None)


def with_prices(rows: DataFrame, quotes: DataFrame, procurement: DataFrame, code: str = "code") -> DataFrame:
    """rows with `quote` and `procurement` structs, null where a code has none."""
    pack = lambda d, name: d.select(F.col("code").alias("_code"), F.struct(*[c for c in d.columns if c != "code"]).alias(name))
    out = rows.withColumn("_key", text.code_key(F.col(code)))
    for d, name in ((quotes, "quote"), (procurement, "procurement")):
        out = out.join(pack(d, name), F.col("_key") == F.col("_code"), "left").drop("_code")
    return out.drop("_key")


# --------------------------------------------------------------------------- matches

RESULT_TEXTS = ["product_code", "product_name", "detected_brand", "normalized_spec", "core_name", "cat1", "unit", "is_yihai", "brand", "spec"]


def result_rows(matches: DataFrame, *keep: str) -> DataFrame:
    """The 13 fields a match is shown with (null texts empty, confidence to 2 decimals, score to 4), behind
    the columns to keep."""
    t = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in RESULT_TEXTS}
    number = lambda c, n: F.round(F.coalesce(F.col(c), F.lit(0.0)), n).alias(c)
    lists = F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes")
    first = [t["product_code"], t["product_name"], number("confidence", 2), number("score", 4), t["detected_brand"], t["normalized_spec"], t["core_name"], lists]
    return matches.select(*keep, *first, *[t[c] for c in RESULT_TEXTS[5:]])


def match_and_price(asked: DataFrame, catalog: DataFrame, quotes: DataFrame, procurement: DataFrame, top_n: int = 10, code: str = "code") -> DataFrame:
    """All queries (as of retrieval.match) at once: q, top_match, alternatives, confirmed (the top match's
    code), quote and procurement of it, without customer preference.  Queries that match nothing, blank ones
    too, keep a row with null matches."""
    found = retrieval.match(asked, catalog, top_n, order_by="confidence")
    best = retrieval.nested(found, [code, "score", "confidence"])
    rows = asked.select("q").join(best, "q", "left").withColumn("confirmed", F.col(f"top_match.{code}").cast("string"))
    return with_prices(rows, quotes, procurement, "confirmed")


def select_and_price(matched: DataFrame, q, chosen, quotes: DataFrame, procurement: DataFrame, code: str = "code") -> DataFrame:
    """The top match or alternative of query q with code `chosen`, with its prices; empty if there is none."""
    every = F.concat(F.filter(F.array("top_match"), lambda x: x.isNotNull()), F.coalesce("alternatives", F.array().cast(matched.schema["alternatives"].dataType)))
    rows = matched.select("q", F.explode(every).alias("m")).select("q", "m.*")
    return with_prices(results.select_alternative(rows, "q", q, code, chosen), quotes, procurement, code)


def search_product(asked: DataFrame, catalog: DataFrame, top_n: int = 50, recall_size: int = 500, name: str = "core_name") -> DataFrame:
    """q, the best product's code, name, brand, spec, attributes (joined) and score, and the labels of the
    top_n products by score.  Blank queries have no row."""
    found = retrieval.match(asked, catalog, top_n, recall_size).withColumn("score", F.round("score", 4))
    label = F.concat(text.candidate_label(F.col("rank"), F.col(name)), F.lit("  (编码:"), F.col("doc_id").cast("string"), F.lit(", 得分:"), text.recall_label(F.col("score")), F.lit(")"))
    blank = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    best = F.struct("doc_id", F.col(name).alias("name"), blank(F.col("brand"), "未识别").alias("brand"), blank(F.col("spec"), "无").alias("spec"), blank(F.array_join("attributes", ", "), "无").alias("attributes"), "score")
    per = found.groupBy("q").agg(F.min_by(best, "rank").alias("b"), F.sort_array(F.collect_list(F.struct("rank", label.alias("label")))).alias("l"))
    return per.select("q", "b.*", F.transform("l", lambda x: x["label"]).alias("labels"))


def batch_sheets(cells: DataFrame, words: records.Dictionaries, catalog: DataFrame, column: str, top_k: int = 10) -> DataFrame:
    """All names of a workbook's sheets, matched: seq (from 1), customer_name, selected_code,
    selected_name and selected_score of the best product by score, `未匹配` where there is none."""
    items = parse_upload(cells, column=column).items
    found = records.match_items(items.select("item_index", F.col("raw_name").alias("preprocessed_name")), catalog, words, top_k, 500, "score")
    best = found.where("rank = 1").select(F.col("q").alias("item_index"), F.col("doc_id").cast("string").alias("selected_code"), F.col("core_name").alias("_name"), F.round("score", 4).alias("selected_score"))
    out = items.join(best, "item_index", "left")
    return out.select((F.col("item_index") + 1).alias("seq"), F.col("raw_name").alias("customer_name"), "selected_code", F.coalesce("_name", F.lit("未匹配")).alias("selected_name"), "selected_score")


# --------------------------------------------------------------------------- reports

#: First-level classes and the quote categories they are shown under (others keep theirs).
QUOTE_CATEGORIES = {"水饮类": "饮料", "水果类": "水果", "鲜水产": "水产"}


def quote_category(c: Column) -> Column:
    out = c
    for k, v in QUOTE_CATEGORIES.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def margin_summary(rows: DataFrame, own: Column, direct: Column, price: Column, cost: Column) -> DataFrame:
    """(bucket, amount, margin): gross margin of own and other brands, direct and from the warehouse, and
    of all; one aggregation."""
    kind = F.concat(F.when(own, "own").otherwise("other"), F.lit("/"), F.when(direct, "direct").otherwise("warehouse"))
    per = rows.select(kind.alias("bucket"), price.alias("p"), cost.alias("c")).rollup("bucket").agg(F.sum("p").alias("amount"), F.sum("c").alias("cost"))
    return per.select(F.coalesce("bucket", F.lit("total")).alias("bucket"), F.round("amount", 2).alias("amount"), F.round((F.col("amount") - F.col("cost")) / F.col("amount"), 6).alias("margin"))


def category_matrix(rows: DataFrame, category: str, mode: str, modes: list) -> DataFrame:
    """Counts by category (rows) and price mode (columns)."""
    return rows.groupBy(category).pivot(mode, modes).count().na.fill(0)


def unit_price(price: Column, size: Column, unit: Column) -> Column:
    """Price of 1000 g or mL; null for other units and sizes of 0."""
    factor = F.when(unit.isin("g", "mL"), 1000.0).when(unit.isin("kg", "L"), 1.0)
    return F.when(size > 0, F.round(price / size * factor, 4))
