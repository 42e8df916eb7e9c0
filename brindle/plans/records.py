"""Whole flows: records from names, the catalog build, and upload to priced matches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import specs, text
from brindle.operators import brands as brand_ops
from brindle.operators import hotel, pricing, results, retrieval, tokenizer


class Dictionaries:
    """Brand table (brand), specification, detail and quality words, hotel lists."""

    def __init__(self, brands: DataFrame, spec_words: Iterable[str] = (), detail_words: Iterable[str] = (), quality_words: Iterable[str] = (), categories: list[str] = hotel.CATEGORIES, countries: list[str] = hotel.COUNTRIES, traditional: dict[str, str] | None = None):
        self.brands, self.spec_words, self.detail_words, self.quality_words = brands, list(spec_words), list(detail_words), list(quality_words)
        self.categories, self.countries, self.traditional = categories, countries, traditional


def process_records(names: DataFrame, words: Dictionaries, name_col: str = "name", brand_col: str | None = None) -> DataFrame:
    """names with detected_brand, normalized_name, tokens, core_name, raw_spec, normalized_spec,
    core_tokens, attributes and the JSON of the three lists.

    A given brand that is no placeholder wins over detection.  Brands the tokenizer knows are those of
    the dictionary, up to its limit; the detected brand leads the tokens."""
    rows = brand_ops.detect_brands(names, words.brands, name_col)
    if brand_col:
        given = F.trim(F.col(brand_col))
        rows = rows.withColumn("detected_brand", F.coalesce(F.when(~given.isin(*brand_ops.NOT_BRANDS), given), "detected_brand"))
    raw, brand = F.col(name_col), F.col("detected_brand")
    rows = rows.withColumn("normalized_name", text.normalize_name(raw, brand))
    cut = tokenizer.tokenize([r.brand for r in words.brands.limit(tokenizer.MAX_WORDS + 1).toLocalIterator()], words.spec_words)
    tokens = cut(F.col("normalized_name"))
    rows = rows.withColumn("tokens", tokens).withColumn("tokens", F.when(F.coalesce(brand, F.lit("")) != "", F.concat(F.array(brand), F.filter("tokens", lambda t: t != brand))).otherwise(F.col("tokens")))
    rows = rows.withColumn("core_name", specs.core_name(F.col("normalized_name"), words.quality_words))
    rows = rows.withColumn("raw_spec", specs.raw_spec(raw, brand)).withColumn("normalized_spec", specs.extract_spec(F.col("normalized_name")))
    rows = rows.withColumn("core_tokens", specs.core_tokens(F.col("tokens"), brand)).withColumn("attributes", tokenizer.attributes(words.detail_words)(raw))
    for c in ("tokens", "core_tokens", "attributes"):
        rows = rows.withColumn(f"{c}_json", F.to_json(c))
    return rows


def read_catalog(raw: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """A stored catalog with its JSON lists decoded (broken or null: empty) and null texts empty."""
    decoded = {c: text.json_list(F.col(c)) for c in lists} | {c: F.coalesce(F.col(c), F.lit("")) for c in texts}
    return raw.withColumns(decoded)


def order_line_lists(lists: DataFrame) -> dict:
    """The categories, countries and traditional arguments of Dictionaries from a table (kind, word, other)
    of kinds category, country and char; at most MAX_WORDS rows."""
    rows = lists.limit(tokenizer.MAX_WORDS + 1).collect()
    if len(rows) > tokenizer.MAX_WORDS:
        raise ValueError("too many words")
    of = lambda kind: [r.word for r in rows if r.kind == kind]
    return {"categories": of("category"), "countries": of("country"), "traditional": {r.word: r.other for r in rows if r.kind == "char"}}


def build_catalog(raw: DataFrame, words: Dictionaries, code_col: str, name_col: str) -> DataFrame:
    """Catalog rows of a product master without discontinued products; doc_id is the code's hash."""
    rows = results.drop_discontinued(results.drop_blank(raw, name_col), name_col)
    out = process_records(rows, words, name_col)
    return out.withColumn("doc_id", F.xxhash64(F.col(code_col).cast("string"))).withColumn("brand", F.coalesce("detected_brand", F.lit(""))).withColumnRenamed("normalized_spec", "spec")


def with_columns_after(df: DataFrame, name_col: str, added: list[str]) -> DataFrame:
    """df with the added columns moved right behind the name column and texts freed of control characters."""
    rest = [c for c in df.columns if c not in added]
    at = rest.index(name_col) + 1
    clean = [text.strip_control(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes if c in rest]
    return df.select(*clean[:at], *[text.strip_control(F.col(c)).alias(c) if dict(df.dtypes)[c] == "string" else F.col(c) for c in added], *clean[at:])


def preprocess_items(items: DataFrame, words: Dictionaries, name_col: str = "raw_name") -> DataFrame:
    """items with preprocessed_name and preprocess_method: order-line clean-up if the task is one of order
    lines, normalisation otherwise.  One branch for the whole task."""
    mode = hotel.processing_mode(items, name_col).first().mode
    if mode == "special":
        name = hotel.clean_order_line(F.col(name_col), words.categories, words.countries, words.traditional)
    else:
        name = text.normalize_name(F.col(name_col))
    return items.withColumn("preprocessed_name", name).withColumn("preprocess_method", F.lit(mode))


def match_items(items: DataFrame, catalog: DataFrame, words: Dictionaries, top_n: int = 10, recall_size: int = 500, order_by: str = "confidence") -> DataFrame:
    """Ranked candidates of (item_index, preprocessed_name) items."""
    rows = process_records(items.withColumnRenamed("preprocessed_name", "name"), words)
    # tokenised once, though recall and re-ranking each read it
    q = rows.select(F.col("item_index").alias("q"), F.when(F.col("core_name") != "", F.col("core_name")).otherwise(F.trim("name")).alias("core_name"), "core_tokens", F.coalesce("detected_brand", F.lit("")).alias("brand"), F.col("normalized_spec").alias("spec"), "attributes").persist()
    return retrieval.match(q, catalog, top_n, recall_size, order_by)


def preprocess_and_match(items: DataFrame, catalog: DataFrame, words: Dictionaries, quotes: DataFrame, procurement: DataFrame, code_col: str = "code", top_n: int = 10) -> DataFrame:
    """item_index, raw_name, preprocessed_name, preprocess_method, top_match, alternatives, quote and
    procurement.  quotes and procurement: one row a `code`."""
    ready = preprocess_items(items, words)
    found = match_items(ready.select("item_index", "preprocessed_name"), catalog, words, top_n)
    fields = [code_col, "score", "confidence", "brand", "spec", "core_name", "attributes"]
    best = retrieval.nested(found, fields).withColumnRenamed("q", "item_index")
    out = ready.join(best, "item_index", "left").withColumn("code", F.col(f"top_match.{code_col}"))
    pack = lambda d, name: d.select("code", F.struct(*[c for c in d.columns if c != "code"]).alias(name))
    return out.join(pack(quotes, "quote"), "code", "left").join(pack(procurement, "procurement"), "code", "left").drop("code")


__all__ = ["Dictionaries", "build_catalog", "match_items", "preprocess_and_match", "preprocess_items", "pricing", "process_records", "with_columns_after"]
