"""The public functions, by the names callers use: names, tokens and batches, and their SQL registration."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import retrieval, tokenizer
from brindle.plans import records


def normalize_product_name(name: Column, brand: Column | None = None) -> Column:
    return text.normalize_name(name) if brand is None else text.normalize_name(name, brand)


def tokenize_text(name: Column, brands: Iterable[str] = (), spec_words: Iterable[str] = ()) -> Column:
    return tokenizer.tokenize(brands, spec_words)(name)


def tokens_to_json(tokens: Column) -> Column:
    return F.to_json(tokens)


def normalize_batch(names: DataFrame, words: records.Dictionaries, name_col: str = "name", brand_col: str | None = None) -> DataFrame:
    return records.process_records(names, words, name_col, brand_col)


def normalize_query(spark: SparkSession, name: str, words: records.Dictionaries) -> dict:
    """The record of one name."""
    return normalize_batch(spark.createDataFrame([(name,)], "name string"), words).first().asDict()


class ProductMatcher:
    """A catalog prepared once for many searches: its index is written under `path` and read again."""

    def __init__(self, catalog: DataFrame, words: records.Dictionaries, path: str):
        spark = catalog.sparkSession
        catalog.write.mode("overwrite").parquet(f"{path}/catalog")
        self.catalog, self.words = spark.read.parquet(f"{path}/catalog"), words
        retrieval.write_index(retrieval.bm25_index(self.catalog), path)
        self.index = retrieval.read_index(spark, path)

    def match(self, queries: DataFrame, top_n: int = 10, recall_size: int = 200, order_by: str = "score") -> DataFrame:
        return retrieval.match(queries, self.catalog, top_n, recall_size, order_by, self.index)


def register(spark: SparkSession, brands: Iterable[str] = (), spec_words: Iterable[str] = (), detail_words: Iterable[str] = ()) -> None:
    """SQL functions brindle_tokens(name) and brindle_attributes(name), both array<string>."""
    cut, find = tokenizer.Tokenizer(brands, spec_words), tokenizer.attribute_finder(detail_words)

    @F.pandas_udf("array<string>")
    def tokens(names: pd.Series) -> pd.Series:
        return names.fillna("").map(cut)

    @F.pandas_udf("array<string>")
    def attributes(names: pd.Series) -> pd.Series:
        return names.fillna("").map(find)

    spark.udf.register("brindle_tokens", tokens)
    spark.udf.register("brindle_attributes", attributes)
