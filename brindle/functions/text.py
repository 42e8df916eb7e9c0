"""Scalar normalisation of product names, as Column -> Column functions of built-ins.

Order matters; normalize_name() is the whole pipeline.  Java's classes are made Unicode-aware with
(?U), and \\p{N} is added where superscripts count as word characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- fixed values
#: Full-width forms fold by a constant distance; these three fold by name.
FOLD_EXTRA = {"　": " ", "【": "[", "】": "]", "。": "."}
MULTIPLY = "×xXχΧ"
NUMBER = r"(\d+(?:\.\d+)?)"
#: (pattern of the unit, factor, unit), applied in this order, in any case.
WEIGHT_UNITS = [("(?:kg|公斤)", 1000.0, "g"), ("斤", 500.0, "g"), ("克", 1.0, "g"), ("两", 50.0, "g"), ("(?:lb|磅)", 453.592, "g"), ("(?:oz|盎司)", 28.3495, "g")]
#: A litre sign at the very end of a name stays as it is.
VOLUME_UNITS = [("(?:L|升)(?!$)", 1000.0, "mL"), ("ml", 1.0, "mL"), ("(?:m³|m3|立方米)", 1000000.0, "mL")]
LENGTH_UNITS = [("厘米", "cm"), ("毫米", "mm"), ("分米", "dm")]
COUNTERS = "包瓶袋盒罐桶件支条根个片块粒双组套"
MORE_COUNTERS = COUNTERS + "份杯提张把串排版"
BRAND_SUFFIXES = ["牌", "品牌", "公司", "集团", "企业"]
WEIGHING_TERMS = ["称重", "散装称重", "散称", "散卖", "论斤称", "按重量"]
LOOSE = "散称"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"




def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, so that steps that use their input several times do not
    multiply the expression when they are chained."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --------------------------------------------------------------------------- cleaning


def fold_width(c: Column) -> Column:
    """Full-width characters to their half-width forms."""
    wide = [chr(k) for k in range(0xFF01, 0xFF5F)]
    return F.translate(c, "".join(wide) + "".join(FOLD_EXTRA), "".join(chr(ord(w) - 0xFEE0) for w in wide) + "".join(FOLD_EXTRA.values()))


def fold_multiply(c: Column) -> Column:
    """All multiplication signs, letters x included, to `*`."""
    return F.translate(c, MULTIPLY, "*" * len(MULTIPLY))


def clean_symbols(c: Column) -> Column:
    """Runs of other symbols to one blank."""
    return F.regexp_replace(c, r"(?U)[^\w\p{N}\s一-鿿*+\-/.()\[\]{}]+", " ")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def clean(c: Column) -> Column:
    return squeeze(clean_symbols(fold_multiply(fold_width(c))))


# --------------------------------------------------------------------------- units


def _replace_each(c: Column, pattern: str, make) -> Column:
    """Replace every match of pattern by make(its first group): split, map and join."""

    def swap(text):
        new = F.concat(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), make), F.array(F.lit("")))
        return F.array_join(F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("kept"), new.alias("new")), lambda z: F.concat(z["kept"], z["new"])), "")

    return let(c, swap)


def _plain_number(v: Column) -> Column:
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(F.format_string("%.2f", v))


def weight_units(c: Column) -> Column:
    """Weights in g; whole values without decimals, others with two."""
    for unit, factor, name in WEIGHT_UNITS:
        c = _unit(c, unit, factor, name)
    return c


def _unit(c: Column, unit: str, factor: float, name: str) -> Column:
    def make(x):
        return F.concat(let(x.cast("double") * factor, _plain_number), F.lit(name))

    return _replace_each(c, rf"(?iu){NUMBER}\s*{unit}", make)


def volume_units(c: Column) -> Column:
    for unit, factor, name in VOLUME_UNITS:
        c = _unit(c, unit, factor, name)
    return F.regexp_replace(c, r"(?U)(\d+)\s*M[Ll]\b", "$1mL")


def length_units(c: Column) -> Column:
    def make(name):
        return lambda x: F.concat(F.when(F.contains(x, F.lit(".")), x).otherwise(F.regexp_replace(x, r"^0+(?=\d)", "")), F.lit(name))

    for unit, name in LENGTH_UNITS:
        c = _replace_each(c, rf"{NUMBER}\s*{unit}", make(name))
    return c


def gram_variants(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"(?U){NUMBER}\s*G\b", "$1g"), rf"(?U){NUMBER}\s*克\b", "$1g")


def packages(c: Column) -> Column:
    """`20包/箱` to `20包 箱`, `500g*12袋` to `500g 12袋`, the same for mL."""
    c = F.regexp_replace(c, rf"(\d+[{COUNTERS}箱])\s*/\s*([箱件组套包盒])", "$1 $2")
    for unit in ("g", "mL"):
        c = F.regexp_replace(c, rf"(\d+(?:\.\d+)?{unit})\s*\*\s*(\d+)\s*([{COUNTERS}])", "$1 $2$3")
    return c


# --------------------------------------------------------------------------- brand, brackets, terms


def _cut_first(c: Column, what: Column) -> Column:
    at = F.position(what, c)
    return F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(what), F.length(c)))


def strip_brand(c: Column, brand: Column | None = None) -> Column:
    """Cut out the first brand with its suffix, or else the brand; then drop suffixes behind CJK runs."""
    if brand is not None:
        b = F.trim(brand)
        names = [F.concat(b, F.lit(s)) for s in BRAND_SUFFIXES] + [b]

        def cut(t):
            return reduce(lambda rest, n: F.when(F.contains(t, n), _cut_first(t, n)).otherwise(rest), reversed(names), t)

        c = let(c, lambda t: F.when(F.coalesce(b, F.lit("")) != "", squeeze(cut(t))).otherwise(t))
    for s in BRAND_SUFFIXES:
        c = F.regexp_replace(c, rf"([一-鿿]+){s}", "$1")
    return c


def open_brackets(c: Column) -> Column:
    """Brackets to blanks, their contents kept."""
    body = r"[(（\[]([^)）\]]*)[)）\]]"
    return squeeze(F.regexp_replace(F.regexp_replace(c, body + r"(?=\d|[a-zA-Z])", " $1 "), body, " $1 "))


def bracket_contents(c: Column) -> Column:
    bodies = F.regexp_extract_all(c, F.lit(r"[(（\[]([^)）\]]*)[)）\]]"), F.lit(1))
    return F.filter(F.transform(bodies, lambda x: F.trim(x)), lambda x: x != "")


def weighing_terms(c: Column) -> Column:
    for term in WEIGHING_TERMS:
        c = F.replace(c, F.lit(term), F.lit(LOOSE))
    return c


def normalize_name(name: Column, brand: Column | None = None) -> Column:
    """The whole pipeline; null or empty names give ''."""
    c = volume_units(weight_units(clean(name)))
    c = packages(gram_variants(length_units(c)))
    c = squeeze(weighing_terms(open_brackets(strip_brand(c, brand))))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(c)


# --------------------------------------------------------------------------- small conversions


def is_number(c: Column) -> Column:
    return F.coalesce(F.trim(c).try_cast("double").isNotNull(), F.lit(False))


def format_number(v: Column) -> Column:
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))


def safe_price(c: Column) -> Column:
    """Two decimals, null where there is no number."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), F.round(d, 2))


def safe_text(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit(""))


def json_list(c: Column) -> Column:
    """Words of a JSON list; [] for null and broken text."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def confidence_label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string("%.2f", c))


def recall_label(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("-")).otherwise(F.format_string("%.4f", c))


def candidate_label(rank: Column, name: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(name, F.lit("")))


def parse_flag(c: Column) -> Column:
    """true and false in any case; null for anything else."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s == "true", True).when(s == "false", False)


def code_key(c: Column) -> Column:
    """Product codes as trimmed strings, without the `.0` of numeric cells."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
