"""Clean-up of bilingual hotel order lines: `ENGLISH ... 类目 品名 (品牌) 规格 储存 国家 (...)`.

All steps are Column -> Column.  Traditional characters are folded by a character table the caller
supplies (phrases are not converted)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import let, squeeze
from brindle.operators.results import numbered

# --------------------------------------------------------------------------- fixed values
STORAGE_TYPES = ["干货", "冰鲜", "急冻", "常温"]
SUB_CATEGORIES = ["整粒", "果茸", "果肉", "果泥", "腌制食品"]
BUTTER, BUTTER_KINDS = "黄油", ["无盐", "咸味", "淡味", "原味"]
#: Category and country lists are parameters; these are enough for the example lines.
CATEGORIES = ["小食", "酱料", "干果", "火腿", "黄油", "日本清酒", "调味品", "罐头水果"]
COUNTRIES = ["中国", "日本", "韩国", "法国", "美国", "意大利", "泰国", "澳大利亚", "新西兰", "英国"]


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


def fold_traditional(c: Column, table: dict[str, str] | None) -> Column:
    return F.translate(c, "".join(table), "".join(table.values())) if table else c


def drop_trailing_bracket(c: Column) -> Column:
    """Cut the balanced bracket a text ends with; an unbalanced one stays.

    Depths are counted from the end over the positions of brackets of the closing kind only."""
    return let(F.trim(c), _drop_bracket)


def _drop_bracket(t: Column) -> Column:
    def cut(open_: str, close: str) -> Column:
        marks = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(t, i, F.lit(1)).alias("ch"))), lambda m: m["ch"].isin(open_, close))
        state = F.aggregate(
            F.reverse(marks),
            F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at")),
            lambda acc, m: F.when(acc["at"] > 0, acc).otherwise(
                F.struct(
                    (acc["depth"] + F.when(m["ch"] == close, 1).otherwise(-1)).alias("depth"),
                    F.when((m["ch"] == open_) & (acc["depth"] == 1), m["i"]).otherwise(0).alias("at"),
                )
            ),
        )
        return let(state["at"], lambda at: F.when(at > 0, F.rtrim(F.substring(t, F.lit(1), at - 1))).otherwise(t))

    return F.when(F.endswith(t, F.lit(")")), cut("(", ")")).when(F.endswith(t, F.lit("）")), cut("（", "）")).otherwise(t)


def chinese_part(c: Column, categories: list[str] = CATEGORIES, table: dict[str, str] | None = None) -> Column:
    """From the first known category that stands alone, or else from the first CJK character; ''."""
    whole = drop_trailing_bracket(drop_trailing_bracket(fold_traditional(F.coalesce(c, F.lit("")), table)))
    return let(whole, lambda t: _from_category(t, categories))


def _from_category(t: Column, categories: list[str]) -> Column:
    at = F.regexp_instr(t, F.lit(rf"(?U)(?:^|(?<=\s)){_any(categories)}(?=\s|$)"))
    first = F.regexp_instr(t, F.lit("[一-鿿]"))
    return F.when(at > 0, F.trim(F.substring(t, at, F.length(t)))).when(first > 0, F.trim(F.substring(t, first, F.length(t)))).otherwise("")


def drop_suffix(c: Column, countries: list[str] = COUNTRIES) -> Column:
    """Country, storage type and country again, one of each, from the end."""
    t = F.trim(c)
    for words in (countries, STORAGE_TYPES, countries):
        t = F.trim(F.regexp_replace(t, f"{_any(words)}$", "")) if words else t
    return t


def drop_category(c: Column, categories: list[str] = CATEGORIES) -> Column:
    """Cut the leading category (and sub-category) unless it is part of the name: nothing, a bracket, a
    lone CJK character, or a kind of butter follows.  Without a known one, cut a short first CJK word."""
    return let(F.trim(c), lambda t: _drop_category(t, categories))


def _drop_category(t: Column, categories: list[str]) -> Column:
    cat = F.regexp_extract(t, f"^{_any(categories)}", 0)
    rest = F.trim(F.substring(t, F.length(cat) + 1, F.length(t)))
    cut = F.trim(F.regexp_replace(rest, f"^{_any(SUB_CATEGORIES)}", ""))
    nxt = F.regexp_extract(cut, r"^\S+", 0)
    keep = (rest == "") | cut.rlike("^[(（]") | ((cat == BUTTER) & nxt.isin(*BUTTER_KINDS)) | nxt.rlike("^[一-鿿]$")
    head, tail = F.regexp_extract(t, r"^(\S+)\s+(.*)$", 1), F.regexp_extract(t, r"^(\S+)\s+(.*)$", 2)
    loose = F.when(head.rlike("^[一-鿿]{1,6}$") & (tail != "") & ~tail.rlike("^[(（]"), tail).otherwise(t)
    return F.when(cat != "", F.when(keep, t).otherwise(cut)).otherwise(loose)


def drop_packing(c: Column) -> Column:
    """`PER BOX`, state and country codes, BTL before digits, 4-5 digit codes, 员工厨, a last `, n`."""
    for pattern in (r"(?iU)\s+PER\s+\w+", r"(?U)\s+FZ\b", r"(?U)\s+CH\b", r"(?U)\s+DR\b", r"(?U)\bBTL(?=\d)", r"(?U)\s+[A-Z]{2,3}\b", r"(?U)\s+\d{4,5}\b", r"\s*员工厨", r",\s*\d+\s*$"):
        c = F.regexp_replace(c, pattern, "")
    return F.trim(c)


def mark_brands(c: Column) -> Column:
    """牌 behind each bracketed text that does not end in it."""
    c = F.regexp_replace(c, r"\(([^)]+)(?<!牌)\)", "($1牌)")
    return F.regexp_replace(c, r"（([^）]+)(?<!牌)）", "（$1牌）")


def clean_order_line(c: Column, categories: list[str] = CATEGORIES, countries: list[str] = COUNTRIES, table: dict[str, str] | None = None) -> Column:
    """The customer's product name in an order line; '' without any CJK character."""

    def finish(part):
        out = squeeze(mark_brands(drop_packing(drop_category(drop_suffix(part, countries), categories))))
        return F.when(part == "", "").otherwise(out)

    return let(chinese_part(c, categories, table), finish)


def is_order_line(c: Column) -> Column:
    """Capital prefix, some CJK, and CJK in the last bracket."""
    t = F.trim(F.coalesce(c, F.lit("")))
    last = F.substring_index(F.substring_index(t, "(", -1), ")", 1)
    closed = F.contains(t, F.lit("(")) & F.contains(F.substring_index(t, "(", -1), F.lit(")"))
    return t.rlike(r"^[A-Z]{2,10}\s") & t.rlike("[一-鿿]") & closed & last.rlike("[一-鿿]")


def processing_mode(items: DataFrame, name_col: str = "raw_name", index_col: str = "item_index", sample: int = 10) -> DataFrame:
    """(hits, sampled, mode): special if at least half of the first items, and one at least, are order
    lines.  Blank names count in the sample."""
    first = items.orderBy(index_col).limit(sample)
    votes = first.agg(F.count_if(is_order_line(F.col(name_col))).alias("hits"), F.count("*").alias("sampled"))
    return votes.withColumn("mode", F.when((F.col("sampled") > 0) & (F.col("hits") >= F.greatest(F.lit(1.0), F.col("sampled") * 0.5)), "special").otherwise("normal"))


def export_order_lines(lines: DataFrame, col: str, order: str, **lists) -> DataFrame:
    """(seq, original, name) of lines with a result, numbered by an integral column without repeats."""
    rows = lines.where(F.trim(col) != "").select(F.col(order).alias("_o"), F.trim(col).alias("original"), clean_order_line(F.trim(col), **lists).alias("name")).where("name <> ''")
    return numbered(rows, "_o", "seq").select("seq", "original", "name")
