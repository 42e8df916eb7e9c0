"""Latest quote and procurement price by product code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import code_key


def preferred(customer: Column, keywords: list[str]) -> Column:
    """The customer's name contains any keyword (empty keywords do not count, repeats do no harm)."""
    words = [w for w in dict.fromkeys(k.strip() for k in keywords) if w]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.coalesce(customer, F.lit("")), F.lit(w))
    return hit


def latest(rows: DataFrame, key: str, order: list, fields: list[str], prefer: Column | None = None) -> DataFrame:
    """One row a key: `fields` of the last row by `order` (expressions, greatest wins, nulls last) and
    records_count, the rows considered.  If any row of a key is preferred only those are considered.

    A single aggregation with map-side combination; no row of a key is gathered."""
    pick = F.struct(*order)
    value = F.struct(*fields)
    if prefer is None:
        out = rows.groupBy(key).agg(F.max_by(value, pick).alias("v"), F.count("*").alias("records_count"))
    else:
        rows = rows.withColumn("_p", prefer)
        out = rows.groupBy(key).agg(F.max_by(value, F.struct("_p", *order)).alias("v"), F.count_if("_p").alias("_n"), F.count("*").alias("_all"))
        out = out.withColumn("records_count", F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_all")))
    return out.select(key, "v.*", "records_count")


def lookup(codes: DataFrame, priced: DataFrame, code: str, key: str) -> DataFrame:
    """codes with the columns of priced; null where a code has none.  Codes meet as trimmed strings."""
    p = priced.withColumn("_key", code_key(F.col(key))).drop(key)
    return codes.withColumn("_key", code_key(F.col(code))).join(p, "_key", "left").drop("_key")


def assemble(results: DataFrame, items: DataFrame, quotes: DataFrame, procurement: DataFrame) -> DataFrame:
    """results (item_index, code, ...) with item names, quote and procurement structs, and JSON of all."""
    pack = lambda d, name: d.select(F.col("code"), F.struct(*[c for c in d.columns if c != "code"]).alias(name))
    rows = results.join(items, "item_index", "left").join(pack(quotes, "quote"), "code", "left").join(pack(procurement, "procurement"), "code", "left")
    return rows.withColumn("json", F.to_json(F.struct(*rows.columns)))
