"""Brands in names: the dictionary join by substring containment, rewritten as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.specs import leading_brand

NOT_BRANDS = ("无", "nan", "None", "")


def brand_dictionary(raw: DataFrame, col: str) -> DataFrame:
    """(brand): trimmed, distinct, without placeholders."""
    return raw.select(F.trim(F.col(col).cast("string")).alias("brand")).where(F.col("brand").isNotNull() & ~F.col("brand").isin(*NOT_BRANDS)).distinct()


def word_dictionary(raw: DataFrame, category: str, word: str, only: str | None = None) -> DataFrame:
    """(word, length) of rows with a category and a word, longest first in use; only: one category."""
    rows = raw.where(F.col(category).isNotNull() & (F.trim(word) != ""))
    if only is not None:
        rows = rows.where(F.trim(category) == only)
    return rows.select(F.trim(word).alias("word")).distinct().withColumn("length", F.length("word"))


def detect_brands(names: DataFrame, brands: DataFrame, name_col: str = "name", max_len: int | None = None) -> DataFrame:
    """names with detected_brand: the text before 牌 at the start, or else the longest dictionary brand
    in the name (ties: the first position, then the brand in order), or null.  max_len: longer brands are
    left out.

    Distinct names are cut into substrings no longer than the longest brand and joined on equality, so
    the work grows with the text, not with names times brands."""
    texts = names.select(F.col(name_col).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    length = F.length("brand")
    lens = brands.where(length <= max_len) if max_len else brands
    # one row a length, and no more lengths than the longest brand has characters
    lens = lens.select(length.alias("n")).where("n > 0").distinct().agg(F.sort_array(F.collect_list("n")).alias("_lens"))
    cuts = texts.join(F.broadcast(lens), F.lit(True)).select("_t", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_t"), F.lit(1)))).alias("_at"), "_lens")
    cuts = cuts.select("_t", "_at", F.explode("_lens").alias("_n")).where("_at + _n - 1 <= length(_t)").select("_t", "_at", F.substring("_t", F.col("_at"), F.col("_n")).alias("brand"))
    hits = cuts.join(brands, "brand").groupBy("_t").agg(F.min_by("brand", F.struct(-F.length("brand"), "_at", "brand")).alias("_b"))
    return names.join(hits, names[name_col] == hits["_t"], "left").withColumn("detected_brand", F.coalesce(leading_brand(F.col(name_col)), F.col("_b"))).drop("_t", "_b")
