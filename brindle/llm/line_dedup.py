"""Repeated line runs, found by a suffix array over line ids; later copies are deleted.

A document is the sequence of its lines' 64-bit ids.  Lines that occur once end every repeat, so only
stretches of repeated lines go on, one row a line (a suffix).  Prefix doubling ranks the suffixes:
rank[0] by line id, and rank[k + 1](i) is the place of (rank[k](i), rank[k](i + 2**k)) among all such
pairs in a distributed sort, so rank[k] is the order of the suffix array by the first 2**k lines.
Suffixes that agree in their first L lines are an interval of the array with a longest common prefix of
at least L; with 2**k <= L < 2**(k + 1) it is the one of rank[k](i) and rank[k](i + L - 2**k).

A run counts from min_words words on.  Every maximal repeated run is the union of its shortest runs
that long from each of its lines forward and backward, so it is enough to look up these: in each
interval the first occurrence by (document id, line) stays, and what all others cover is deleted.

Only DataFrame functions are used; nothing but a suffix is held by one row until deleted intervals are
gathered by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, release

MIN_WORDS = 50
_LOWEST = -(1 << 63)
_PLACE = ["id", "digest", "stretch", "pos"]


def _ranked(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """rows with `name`: the place of (first, second) in the sorted order of all such pairs.

    Pairs are sorted by range over all tasks; the number of the partition and the row in it make up the
    place, so ranks rise with the order but are not dense."""
    pairs = rows.select(F.col(first).alias("_a"), F.col(second).alias("_b")).distinct().repartitionByRange("_a", "_b").sortWithinPartitions("_a", "_b")
    pairs = materialise(pairs.withColumn(name, F.monotonically_increasing_id() + 1), "ranks")
    out = materialise(rows.join(pairs, (F.col(first) == F.col("_a")) & (F.col(second) == F.col("_b"))).drop("_a", "_b", "_next"), "suffixes")
    release(pairs)
    return out


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, first, last): merged line intervals that are later copies, for each document.

    id is the document's id (the lowest long for null), digest the hash of its text."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(F.col(text_col)).alias("digest"), F.col(text_col).alias("t"))
    lines = base.select("id", "digest", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "digest", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    lines = materialise(lines, "lines")
    place = F.struct("id", "digest", "pos")
    often = lines.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("h")
    doc = Window.partitionBy("id", "digest").orderBy("pos")
    kept = lines.join(often, "h", "left_semi").distinct().repartition("id", "digest").withColumn("stretch", F.col("pos") - F.row_number().over(doc))
    stretch = Window.partitionBy("id", "digest", "stretch")
    upto = stretch.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("after", F.sum("w").over(upto)).withColumn("total", F.sum("w").over(stretch)).where(F.col("total") >= min_words)
    kept = kept.withColumn("before", F.col("after") - F.col("w"))
    # Shortest run forward: the first line whose `after` reaches before + min_words; backward: the last
    # line whose `before` leaves min_words up to after.  Both by a running bound over merged events.
    event = F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("after").alias("at_f"), F.col("before").alias("at_b"), F.col("pos").alias("p")),
        F.struct(F.lit(1).alias("kind"), (F.col("before") + min_words).alias("at_f"), (F.col("after") - min_words).alias("at_b"), F.lit(None).cast("int").alias("p")),
    ))
    ev = kept.select("id", "digest", "stretch", "pos", "h", event.alias("e")).select("id", "digest", "stretch", "pos", "h", "e.*")
    run = lambda *o: stretch.orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("end", F.min("p").over(run(F.desc("at_f"), "kind"))).withColumn("start", F.max("p").over(run("at_b", "kind"))).where("kind = 1")
    rows = materialise(ev.select(*_PLACE, "h", "start", "end"), "suffixes")
    width = F.greatest(F.coalesce(F.col("end") - F.col("pos"), F.lit(0)), F.coalesce(F.col("pos") - F.col("start"), F.lit(0))) + 1
    longest = rows.agg(F.max(width)).first()[0] or 1
    rows, k = _ranked(rows.withColumn("_next", F.lit(0).cast("long")), "h", "_next", "rank0").drop("h"), 0
    while 2 << k <= longest:
        beyond = F.coalesce(F.lead(f"rank{k}", 1 << k).over(stretch.orderBy("pos")), F.lit(0).cast("long"))
        rows, k = _ranked(rows.withColumn("_next", beyond), f"rank{k}", "_next", f"rank{k + 1}"), k + 1
    ends = F.explode(F.array(F.struct(F.col("pos").alias("a"), F.col("end").alias("b")), F.struct(F.col("start").alias("a"), F.col("pos").alias("b"))))
    runs = rows.select("id", "digest", "stretch", ends.alias("r")).select("id", "digest", "stretch", "r.*").where("a is not null and b is not null").distinct()
    runs = runs.withColumn("len", F.col("b") - F.col("a") + 1).withColumn("k", F.floor(F.log2(F.col("len").cast("double"))).cast("int"))
    runs = runs.withColumn("mid", (F.col("b") + 1 - F.pow(F.lit(2.0), F.col("k"))).cast("int"))
    ranks = rows.select("id", "digest", "stretch", F.col("pos").alias("at"), F.array(*(f"rank{j}" for j in range(k + 1))).alias("ranks"))
    look = lambda at, name: ranks.withColumnsRenamed({"at": at, "ranks": name})
    runs = runs.join(look("a", "_x"), ["id", "digest", "stretch", "a"]).join(look("mid", "_y"), ["id", "digest", "stretch", "mid"])
    runs = materialise(runs.select("id", "digest", "a", "b", "len", F.get("_x", F.col("k")).alias("x"), F.get("_y", F.col("k")).alias("y")), "runs")
    here = F.struct("id", "digest", "a")
    first = runs.groupBy("len", "x", "y").agg(F.min(here).alias("lo"), F.max(here).alias("hi")).where("lo <> hi").drop("hi")
    later = runs.join(first, ["len", "x", "y"]).where(here > F.col("lo")).select("id", "digest", "a", "b").distinct()
    order = Window.partitionBy("id", "digest").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return later.groupBy("id", "digest", "island").agg(F.min("a").alias("first"), F.max("b").alias("last")).drop("island")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_col freed of later copies of line runs, and n_lines, n_removed added.

    Lines end at line feeds, words are `[^\\x20\\x09-\\x0D]+`, and a run lies in one document and holds
    at least min_words words.  The first copy by (id, line) stays, also where copies overlap.  Rows that
    agree in id and text are one document; equal ids with other texts are ordered by text hash; null
    ids come first.  Null text stays null with 0 lines; an empty text has one empty line.  If every
    line goes, the text is empty.  Empty table: no rows.  Columns of docs named like the two new ones
    are replaced."""
    gone = repeated_runs(docs, id_col, text_col, min_words)
    gone = gone.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "last")).alias("_gone")).toDF("_gid", "_gdigest", "_gone")
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*keep, F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("_gid"), F.xxhash64(F.col(text_col)).alias("_gdigest"))
    out = rows.join(gone, ["_gid", "_gdigest"], "left")
    cut = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(cut, lambda x, i: ~F.exists("_gone", lambda g: (i >= g["first"]) & (i <= g["last"]))), "\n")
    removed = F.coalesce(F.aggregate("_gone", F.lit(0), lambda a, g: a + (g["last"] - g["first"] + 1)), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(left)
    n = F.coalesce(F.size(cut), F.lit(0))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(n)
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in keep], n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
