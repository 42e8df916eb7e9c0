"""Filters, pages, re-selection and export of match results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_blank(rows: DataFrame, col: str) -> DataFrame:
    """Rows with a name, trimmed."""
    return rows.withColumn(col, F.trim(F.col(col).cast("string"))).where(F.col(col) != "")


def drop_discontinued(rows: DataFrame, col: str, mark: str = "禁用") -> DataFrame:
    return rows.where(~F.contains(F.coalesce(col, F.lit("")), F.lit(mark)))


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    return rows.na.drop("all")


def score_range(rows: DataFrame, low: float, high: float, sure: str = "confidence", score: str = "score") -> DataFrame:
    """Rows with low <= confidence (or else score) <= high; unscored rows if low <= 0."""
    if low > high:
        raise ValueError("low is above high")
    s = F.coalesce(sure, score)
    return rows.where(s.between(low, high) | (s.isNull() & F.lit(low <= 0)))


def page(rows: DataFrame, order: list, number: int, size: int = 15) -> DataFrame:
    """Page `number` (from 1) in order, clamped into range."""
    last = max(1, -(-rows.count() // size))
    k = min(max(number, 1), last) - 1
    return rows.orderBy(*order).offset(k * size).limit(size)


def preview(rows: DataFrame, order: list, n: int = 10) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def select_alternative(candidates: DataFrame, index: str, item: int, code_col: str, code) -> DataFrame:
    """The candidate of an item with a code; empty if there is none."""
    return candidates.where((F.col(index) == item) & (F.col(code_col) == code)).orderBy("rank").limit(1)


def reselect(rows: DataFrame, changes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """rows with cols overwritten where changes has the key (null changes leave a value)."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in rows.columns])


def export(rows: DataFrame, matches: DataFrame, keys: list[str], after: str, added: list[str]) -> DataFrame:
    """rows with matches' added columns put right behind column `after`."""
    out = rows.join(matches.select(*keys, *added), keys, "left")
    at = rows.columns.index(after) + 1
    return out.select(*rows.columns[:at], *added, *rows.columns[at:])


def first_seen(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the place they are first seen at."""
    return rows.groupBy(col).agg(F.min(order).alias("first_at"))


def picker(rows: DataFrame, categories: list[str] | None = None, active: str | None = None, keyword: str = "", cat: str = "cat1", names: tuple[str, ...] = ("stdName", "name")) -> DataFrame:
    """Products of the chosen categories whose names contain the keyword (case counts)."""
    hit: Column = F.lit(keyword == "")
    for n in names:
        hit = hit | F.contains(F.coalesce(n, F.lit("")), F.lit(keyword))
    out = rows.where(hit)
    if categories:
        out = out.where(F.col(cat).isin(*categories))
    return out.where(F.col(cat) == active) if active else out


def match_counts(results: DataFrame, code: str = "product_code") -> DataFrame:
    return results.agg(F.count_if(F.col(code).isNotNull()).alias("matched"), F.count("*").alias("total"))


def by_sheet(results: DataFrame) -> DataFrame:
    return results.groupBy("sheet").agg(F.count("*").alias("rows"))


NUMBERED_RUN = 20  # bits of an order that are numbered in one task


def numbered(rows: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """rows with `name`: their place, from `start`, by an integral column without repeats.

    Values that agree but for their last NUMBERED_RUN bits are numbered in one task, such runs by the sums
    of those before, so only a row a run meets in one place."""
    run = F.shiftright(F.col(order).cast("long"), NUMBERED_RUN)
    per = rows.groupBy(run.alias("_run")).agg(F.count("*").alias("_n"))
    per = per.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(order))
    out = rows.withColumn("_run", run).withColumn("_k", inside).join(per, "_run")
    return out.select(*rows.columns, (F.col("_first") + F.col("_k") + start - 1).alias(name))


def ranked(rows: DataFrame, per: list[str], order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
