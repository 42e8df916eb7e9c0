"""Specifications, core names, brands in names, and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MORE_COUNTERS, let, squeeze

# --------------------------------------------------------------------------- fixed values
N = r"\d+(?:\.\d+)?"
UNITS = "(?:g|mL|kg|ml|L|cm|mm|dm|m)"
BOARD = MORE_COUNTERS + "板"
BOX = BOARD + "箱"
SPEC = rf"{N}\s*[*xX×]\s*{N}\s*[{BOX}]|{N}{UNITS}\s*[*xX×]\s*{N}|{N}{UNITS}|{N}[{BOARD}]"
RAW_SPEC = (
    rf"{N}\s*(?:kg|KG|g|G|克|千克|ml|mL|ML|L|l|升|毫升|斤|两|磅|盎司|lb|oz|cm|mm)"
    rf"|{N}\s*[{BOX}]|{N}\s*[*xX×]\s*{N}(?:\s*[{BOX}])?|{N}\s*/\s*[包瓶袋盒罐桶箱]"
)
PACKS = "箱包袋盒罐桶瓶杯碗盘件板"
SLASH_PACK = "[/／]\\s*([包瓶袋盒罐桶箱件板])"
#: In the order in which the first that occurs is taken.
BULK_TERMS = ["散称", "散装", "称重", "散卖", "过秤"]
BRAND_HEAD = r"^([A-Za-z0-9一-鿿\s\-·]{1,10}?)牌"


def leading_brand(c: Column) -> Column:
    """The text before 牌 at the start of a name (ten characters at most), or null."""
    b = F.trim(F.regexp_extract(c, BRAND_HEAD, 1))
    return F.when(b != "", b)


def extract_spec(c: Column) -> Column:
    """Specification parts of a normalised name, joined by blanks."""
    return let(c, _spec_parts)


def _spec_parts(c: Column) -> Column:
    parts = F.regexp_extract_all(c, F.lit(f"({SPEC})"), F.lit(1))
    bulk = F.coalesce(*[F.when(F.contains(c, F.lit(t)), F.array(F.lit(t))) for t in BULK_TERMS], F.array().cast("array<string>"))
    packs = F.array_distinct(F.regexp_extract_all(c, F.lit(SLASH_PACK), F.lit(1)))
    return let(F.concat(parts, bulk), lambda known: F.array_join(F.concat(known, F.filter(packs, lambda p: ~F.array_contains(known, p))), " "))


def core_name(c: Column, quality_words: list[str] | None = None) -> Column:
    """What is left of a normalised name without its specification and quality words (longest first)."""
    c = F.regexp_replace(c, SPEC, "")
    c = F.regexp_replace(c, r"[/／]\s*[包瓶袋盒罐桶箱件板]", "")
    c = F.regexp_replace(c, rf"(?<![一-鿿])[{PACKS}](?![一-鿿])", "")
    for t in BULK_TERMS:
        c = F.replace(c, F.lit(t), F.lit(""))
    c = F.regexp_replace(c, r"[*xX×/／\-]+", "")
    for w in sorted(set(quality_words or ()), key=lambda w: (-len(w), w)):
        c = F.replace(c, F.lit(w), F.lit(""))
    return squeeze(c)


def raw_spec(c: Column, brand: Column | None = None) -> Column:
    """Specification parts of a name as it was given."""
    if brand is not None:
        some = F.coalesce(brand, F.lit("")) != ""
        c = F.when(some, F.replace(F.replace(c, F.concat(brand, F.lit("牌")), F.lit("")), brand, F.lit(""))).otherwise(c)

    def collect(t):
        parts = F.regexp_extract_all(t, F.lit(f"({RAW_SPEC})"), F.lit(1))
        packs = F.regexp_extract_all(t, F.lit(SLASH_PACK), F.lit(1))
        return F.array_join(F.aggregate(packs, parts, lambda acc, p: F.when(F.contains(F.array_join(acc, " "), p), acc).otherwise(F.concat(acc, F.array(p)))), " ")

    return let(c, collect)


def core_tokens(tokens: Column, brand: Column) -> Column:
    """Tokens that are neither brand, specification, package nor bulk term."""
    pack = lambda t: F.array_contains(F.array(*map(F.lit, PACKS)), t)
    times = lambda t: t.isin("*", "×", "x", "X")

    def keep(t, i):
        after = F.get(tokens, i + 1)
        number = t.rlike(rf"^{N}$")
        counted = after.isNotNull() & (pack(after) | times(after) | after.rlike(rf"^{N}[{BOX}]$"))
        drop = (
            (F.coalesce(t == brand, F.lit(False)) & (F.coalesce(brand, F.lit("")) != ""))
            | t.rlike(rf"(?iu)^{N}{UNITS}$") | t.rlike(rf"^{N}[{BOARD}]$")
            | (number & F.coalesce(counted, F.lit(False))) | times(t) | pack(t) | t.isin(*BULK_TERMS)
        )
        return ~drop

    return F.filter(tokens, keep)


# --------------------------------------------------------------------------- similarity

QUANTITY_WORD = rf"([a-zA-Z]+|[{BOARD}])"


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({N})"), F.lit(1)))


def units_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(QUANTITY_WORD), F.lit(1)))


def recall_bigrams(c: Column) -> Column:
    """Distinct character pairs without blanks; a shorter text is its own pair, an empty one has none."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    n = F.length(t)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def name_bigrams(c: Column) -> Column:
    """Distinct character pairs, blanks inside included; none for shorter texts."""
    n = F.length(c)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def mutual(a: Column, b: Column) -> Column:
    """One of two non-empty texts contains the other."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))
