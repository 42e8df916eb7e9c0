"""Re-ranking bonuses and the explainable confidence of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .specs import mutual, name_bigrams, numbers_in, units_in

# fixed values
BASE_WEIGHTS = (0.6, 0.4)
BRAND_BONUS, BULK_BONUS, ATTRIBUTE_BONUS = 0.35, 0.3, 0.15
BULK_WORDS = ("散称", "称重", "散装")
CONFIDENCE_WEIGHTS = {"brand": 0.25, "spec": 0.25, "name": 0.5}


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def base_score(bm25: Column, bm25_max: Column, jaccard: Column, jaccard_max: Column) -> Column:
    a, b = BASE_WEIGHTS
    floor = lambda m: F.greatest(F.coalesce(m, F.lit(1.0)), F.lit(1e-9))
    return F.coalesce(bm25, F.lit(0.0)) / floor(bm25_max) * a + F.coalesce(jaccard, F.lit(0.0)) / floor(jaccard_max) * b


def spec_bonus(query: Column, found: Column) -> Column:
    q, d = numbers_in(query), numbers_in(found)
    shared = F.arrays_overlap(q, d)
    bonus = F.when(shared & F.arrays_overlap(units_in(query), units_in(found)), 0.5).when(shared, 0.4).when((F.size(q) > 0) & (F.size(d) > 0), -0.1).otherwise(0.0)
    return F.when((_text(query) == "") | (_text(found) == ""), 0.0).otherwise(bonus)


def attribute_bonus(query: Column, found: Column) -> Column:
    q = F.array_distinct(query)
    return F.coalesce(F.size(F.array_intersect(q, found)) / F.greatest(F.size(q), F.lit(1)) * ATTRIBUTE_BONUS, F.lit(0.0))


def brand_bonus(query: Column, found: Column) -> Column:
    return F.when(mutual(query, found), BRAND_BONUS).otherwise(0.0)


def bulk_bonus(query_spec: Column, found_spec: Column) -> Column:
    loose = F.lit(False)
    for w in BULK_WORDS:
        loose = loose | F.contains(F.coalesce(found_spec, F.lit("")), F.lit(w))
    return F.when((F.coalesce(query_spec, F.lit("")) == "") & loose, BULK_BONUS).otherwise(0.0)


def brand_confidence(query: Column, found: Column) -> Column:
    q, d = _text(query), _text(found)
    return F.when((q == "") & (d == ""), 1.0).when(q == "", 0.8).when(d == "", 0.1).when(mutual(q, d), 1.0).otherwise(0.0)


def spec_confidence(query: Column, found: Column) -> Column:
    q, d = _text(query), _text(found)
    qn, dn = numbers_in(q), numbers_in(d)
    words = F.when(q == d, 1.0).when(mutual(q, d), 0.5).otherwise(0.0)
    counts = F.when(F.arrays_overlap(qn, dn), F.when(F.arrays_overlap(units_in(q), units_in(d)), 1.0).otherwise(0.7)).otherwise(0.5)
    return F.when(d == "", 0.2).when((F.size(qn) == 0) | (F.size(dn) == 0), words).otherwise(counts)


def name_confidence(query: Column, found: Column) -> Column:
    """Dice coefficient of character pairs, to four decimals."""
    q, d = _text(query), _text(found)
    a, b = name_bigrams(q), name_bigrams(d)
    dice = F.round(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)), 4)
    return (
        F.when((q == "") & (d == ""), 1.0).when((q == "") | (d == ""), 0.0)
        .when((F.size(a) == 0) & (F.size(b) == 0), F.when(q == d, 1.0).otherwise(0.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(dice)
    )


def confidence(q_brand: Column, q_spec: Column, q_core: Column, d_brand: Column, d_spec: Column, d_core: Column) -> Column:
    """Weighted mean of the dimensions that take part: brand if either side has one, the specification
    if the query has one, the name always; not rounded."""
    w = CONFIDENCE_WEIGHTS
    brand = F.when((_text(q_brand) != "") | (_text(d_brand) != ""), w["brand"]).otherwise(0.0)
    spec = F.when(_text(q_spec) != "", w["spec"]).otherwise(0.0)
    total = brand + spec + w["name"]
    return (brand * brand_confidence(q_brand, d_brand) + spec * spec_confidence(q_spec, d_spec) + w["name"] * name_confidence(q_core, d_core)) / total
