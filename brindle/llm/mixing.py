"""Mixing sources to target weights with a low-discrepancy schedule.

Slot i of the mix has the golden-ratio point frac(i * phi), in exact integer arithmetic; the source
whose interval of cumulative target shares holds the point gets the slot.  The slots of a source are
ranked, and rank r takes block r of the source: its documents in a fixed pseudo-random order, cut
into blocks of equal numbers of words, read twice at most.  All ranks and offsets are two-level
prefix sums, so a source with a third of all rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: The golden ratio's fraction in 10**-18, and its denominator.
GOLDEN, ONE = 618033988749894848, 10**18
WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 128
CELLS = 1024


def words_in(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, repeat: int = 2) -> DataFrame:
    """(source, source_size, weight, target, rn) for rows (source, size).

    Sources in code-point order, null last, take the weights in turn and split share * all words by
    weight; a target stops at repeat * source_size, and its excess is shared again until none is
    above.  In order of source_size / weight the stopped ones come first, so one running sum finds
    them.  One row a source is all that meets in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", w).withColumn("cap", F.lit(repeat) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rn"))
    earlier, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(all_).cast("double") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    per = per.withColumn("weights", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    per = per.withColumn("stopped", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    last = lambda c: F.first(F.when(~F.col("stopped"), F.col(c)), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(last("left") * F.col("weight") / last("weights"))
    return per.withColumn("target", target).select("source", "source_size", "weight", "target", "rn")


def _offsets(rows: DataFrame, keys: list[str], bucket: str, order: list, value: str) -> DataFrame:
    """Adds `offset`: the sum of value over earlier rows of the same keys (bucket, then order)."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_base", F.sum("_s").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_s")).drop("_s")
    same = None
    for k in [*keys, bucket]:
        same = (rows[k].eqNullSafe(sums[k])) if same is None else same & rows[k].eqNullSafe(sums[k])
    out = rows.join(sums, same).drop(*[sums[k] for k in [*keys, bucket]])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("offset", F.col("_base") + F.sum(value).over(inside) - F.col(value)).drop("_base")


def slot_schedule(targets: DataFrame, n_slots: int) -> DataFrame:
    """(slot, rn, rank): the source (by its number) and the rank within it of each slot."""
    spark = targets.sparkSession
    order = Window.orderBy("rn")
    total = F.sum("target").over(Window.partitionBy())
    edge = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = lambda c: F.floor(F.least(c, F.lit(1.0)) * ONE).cast("decimal(38,0)")
    spans = targets.where("target > 0").select("rn", cut((edge - F.col("target")) / total).alias("lo"), cut(edge / total).alias("hi"), F.col("rn") == F.max("rn").over(Window.partitionBy()))
    spans = spans.toDF("rn", "lo", "hi", "last").withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0))).withColumn("hi", F.when(F.col("last"), F.lit(ONE)).otherwise(F.col("hi")))
    cell = lambda c: F.floor(c / (ONE // CELLS)).cast("long")
    spans = spans.where("hi > lo").select("rn", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(CELLS).cast("long")))).alias("cell"))
    point = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(GOLDEN).cast("decimal(18,0)"), F.lit(ONE).cast("decimal(19,0)"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.cast("decimal(38,0)").alias("point"))
    slots = slots.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where("point >= lo and point < hi").select("slot", "rn", (F.col("slot") / 16384).cast("long").alias("run"), F.lit(1).cast("long").alias("one"))
    return _offsets(slots, ["rn"], "run", ["slot"], "one").select("slot", "rn", F.col("offset").alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, block_words: int = BLOCK_WORDS, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix.

    documents: id_col, size, source_size, target (of its source), taken.  One row per input row.
    pieces: slot, id_col, source, pass (0 or 1), from_word, to_word: what each slot reads, in order.
    A document is read in pieces up to twice.  Null or wordless text has size 0 and takes nothing;
    null source is a source of its own; null or repeated ids are separate rows; an empty table gives
    none.  Other columns are ignored.  The same rows give the same mix, whatever their order."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("digest"))
    rows = materialise(rows, "sizes")
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    targets = materialise(source_targets(rows.select("source", "size"), weights, share), "targets")
    rows = _offsets(rows.withColumn("bucket", F.substring("key", 1, 3)), ["source"], "bucket", ["key", "size", "digest"], "size")
    rows = materialise(rows, "offsets")
    total = targets.agg(F.sum("target")).first()[0]
    n_slots = -(-int(total or 0) // block_words)
    named = targets.withColumnRenamed("source", "_s")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    passes = rows.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("offset") + F.col("pass") * F.col("source_size"))
    block = lambda c: F.floor(c / block_words).cast("long")
    parts = passes.where("size > 0").withColumn("rank", F.explode(F.sequence(block(F.col("at")), block(F.col("at") + F.col("size") - 1))))
    used = slot_schedule(targets, n_slots)
    pieces = parts.join(used, ["rn", "rank"]).select(
        "slot", "id", "digest", "source", "size", "offset", "pass",
        F.greatest(F.col("rank") * block_words - F.col("at"), F.lit(0)).alias("from_word"),
        F.least((F.col("rank") + 1) * block_words - F.col("at"), F.col("size")).alias("to_word"),
    )
    pieces = materialise(pieces, "pieces")
    taken = pieces.groupBy("source", "offset").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")).toDF("_source", "_offset", "taken")
    out = rows.join(taken, F.col("source").eqNullSafe(F.col("_source")) & (F.col("offset") == F.col("_offset")) & (F.col("size") > 0), "left")
    out = out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
    return out, pieces.withColumnRenamed("id", id_col)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, all columns kept: a row for each pass over a document, its
    text cut behind the last word taken.

    Rows that agree in id, text and source are mixed as separate rows, whose other columns are those of the
    one of least hash, so reruns agree.  Null and wordless texts are never taken; null ids and sources are
    values like others; texts of any length are read whole; an empty table gives none."""
    _, pieces = mix(docs, id_col, text_col, source_col, **options)
    # ranks 0, 1, ... of a source are all taken, so a pass takes a document's words from the first on
    per = pieces.groupBy("source", "offset", "pass", id_col, "digest", "size").agg(F.max("to_word").alias("_n"))
    per = per.groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest"), F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(F.struct("offset", "pass", "_n", "size"))).alias("_takes"))
    if docs.columns.count("_key"):
        raise ValueError("a column named _key")
    keys, other = [id_col, source_col, "_key"], [c for c in docs.columns if c not in (id_col, source_col, text_col)]
    rows = docs.withColumn("_key", F.xxhash64(text_col)).groupBy(*keys).agg(F.first(text_col).alias(text_col), F.min_by(F.struct(*other, F.lit(0).alias("_none")), F.xxhash64(*other, F.lit(0))).alias("_other"))
    rows = rows.select(*[F.col("_other").getField(c).alias(c) if c in other else F.col(c) for c in docs.columns], "_key")
    joined = rows.join(per, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_digest")) & F.col(source_col).eqNullSafe(F.col("_source")))
    joined = joined.select(*docs.columns, F.explode("_takes").alias("_take"))
    blank = r"[\x20\x09-\x0D]+"
    body = F.regexp_replace(text_col, "^" + blank, "")
    rest = F.element_at(F.split(body, F.lit(blank), (F.col("_take._n") + 1).cast("int")), -1)
    text = F.when(F.col("_take._n") >= F.col("_take.size"), F.col(text_col)).otherwise(F.substring(body, F.lit(1), F.length(body) - F.length(rest)))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
