"""Exact n-gram Jaccard self-join as a metric-space join: pivots, Voronoi regions, windows, recursion.

Jaccard distance d = 1 - |x n y| / |x u y| is a metric, and documents link when d <= r (r = 0.25).
Documents with equal sets are one point (a class) throughout, so copies are never expanded.

1. Lonely points.  A point with a partner shares at least ceil(0.75 n) of its n shingles with it, and so
   enough of the first ones in an order common to all points.  Points that share fewer of these with
   any other class are farther than r from everything and leave (exact; about nine in ten).
2. Neighbourhoods and pivots.  Unrelated points are at distance 1, where the triangle inequality says
   nothing, so candidates meet by shingles: linked points share one of their first
   n - ceil(0.75 n) + 1.  Neighbourhoods of the same points are one.  The least point of each is its
   pivot, and the distance of every point of the neighbourhood to it is computed from the whole sets.
3. Voronoi regions.  Each point belongs to the region of its nearest pivot; pivots own theirs.
4. Windows.  If x links with y of the region of pivot q, then d(x, q) <= d(y, q) + r.  So x is replicated
   into the regions of its neighbours' pivots q, of two regions into the one of lesser name, unless
   d(x, q) exceeds by more than r the largest d(y, q) of a neighbour y there.
5. Recursion.  Regions of more than BLOCK shingles are split in the same way by further pivots of their own,
   LEVELS times; what is still larger is joined in blocks, each block of points against each run of others.
6. A region is joined exactly: an inverted index of its sets counts the overlaps, and
   |d(x, q) - d(y, q)| > r rules points out before.  Points within r of their pivot, and points in one
   component by then, need not be compared with each other.

Sets are compared by 64-bit shingle hashes.  Links are sent as a spanning set."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import all_shingles, components, keep_probable, materialise, release, row_slices, small_batches, string_buffers, word_hashes

#: Shingles put last in the order, at most this many (8 MB).  Affects speed, never the result.
MAX_FREQUENT = 1 << 20
#: A shingle that one slice of a batch holds in so many documents counts towards the frequent ones.
LOCAL_REPEATS = 2
FREQUENT = 16
COUNT_BYTES = 1 << 23
#: Classes that a task remembers to send the shingles of copies once.
SEEN = 1 << 16
#: Points sent along with one copy of a pivot.
SALT_ROWS = 64
#: Shingles of the points that a task holds or compares at once, and levels of the recursion.
BLOCK, LEVELS = 1 << 20, 3
#: Pivots that split a large region.
MAX_SPLIT = 8
SLACK = 1e-9


def _sets(text: pa.Array, n: int):
    """The shingle set (sorted distinct hashes) of each text of a batch."""
    for lo, hi in row_slices(text):
        w, bounds = word_hashes(*string_buffers(text.slice(lo, hi - lo)))
        sh, at = all_shingles(w, bounds, n)
        for i in range(hi - lo):
            yield np.unique(sh[at[i] : at[i + 1]])


def _set_hash(s: np.ndarray) -> int:
    """One signed 64-bit hash of a set (order free: hashes are mixed again, then added)."""
    with np.errstate(over="ignore"):
        h = (s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        total = (h * (h | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(np.uint64(total).astype(np.int64))


def _in_order(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
    """A set in the common order, the frequent shingles last, and the number of the others."""
    if not len(often) or not len(s):
        return s, len(s)
    at = np.searchsorted(often, s)
    at[at == len(often)] = 0
    late = often[at] == s
    return np.concatenate((s[~late], s[late])), int(len(s) - late.sum())


def _extra(n: int) -> int:
    """Shingles that the test for lonely points looks at beyond the first n - ceil(0.75 n)."""
    return n // 8 + 1


def _frequent(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Sorted hashes of frequent shingles: all from the least power of two on that leaves MAX_FREQUENT at
    most, so what the driver gets is bounded."""

    def count(batches):
        for b in batches:
            for lo, hi in row_slices(b.column(0), COUNT_BYTES):
                v, c = np.unique(np.concatenate(list(_sets(b.column(0).slice(lo, hi - lo), n))), return_counts=True)
                keep = c >= LOCAL_REPEATS
                yield pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(c[keep])], ["s", "c"])

    counts = materialise(docs.select(text).mapInArrow(count, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT), "counts")
    least, many = None, 0
    for power, m in sorted(counts.groupBy(F.floor(F.log2("c")).alias("p")).count().collect(), reverse=True):  # 63 rows at most
        many += m
        if many > MAX_FREQUENT:
            break
        least = 1 << power
    if least is None:
        return np.zeros(0, np.uint64)
    got = counts.where(F.col("c") >= least).select("s").toArrow()
    release(counts)
    return np.sort(got.column(0).to_numpy().view(np.uint64))


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, p, inter, uni) for distinct pairs (x, p) of classes, from their whole sets.

    A pivot is copied once for SALT_ROWS of its points, so a pivot of a third of all points spreads over
    many tasks; each task reads its rows in order and holds one pivot at a time."""
    salts = pairs.groupBy("p").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("m"))
    left = pairs.join(salts, "p").select("p", F.pmod(F.xxhash64("x"), F.col("m")).alias("salt"), "x", F.col("x").alias("h"))
    pivots = salts.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long") - 1)).alias("salt"), F.lit(None).cast("long").alias("x"), F.col("p").alias("h"))
    rows = left.unionByName(pivots).join(sets.select("h", "set"), "h").select("p", "salt", F.col("x").isNotNull().alias("side"), "x", "set")
    rows = rows.repartition("p", "salt").sortWithinPartitions("p", "salt", "side")

    def measure(batches):
        pivot = np.zeros(0, np.uint64)
        for b in batches:
            p, x = b.column(0).to_pylist(), b.column(3).to_pylist()
            out = []
            for i, raw in enumerate(b.column(4)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if x[i] is None:
                    pivot = s.copy()
                else:
                    both = _overlap(pivot, s)
                    out.append((x[i], p[i], both, len(s) + len(pivot) - both))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["x", "p", "inter", "uni"])

    return rows.mapInArrow(measure, "x long, p long, inter long, uni long")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum())


class _Region:
    """The points of a region (or of a block of it), sorted by their distance to the pivot, with an
    inverted index."""

    def __init__(self, points: list):
        points.sort(key=lambda p: p[1])
        self.h, self.d, self.component = (np.array([p[k] for p in points]) for k in range(3))
        self.n = np.array([len(p[3]) for p in points])
        every = np.concatenate([p[3] for p in points])
        order = np.argsort(every, kind="stable")
        self.owner = np.repeat(np.arange(len(points), dtype=np.int32), self.n)[order]
        self.tokens, self.at = np.unique(every[order], return_index=True)
        self.at = np.append(self.at, len(every))

    def links(self, d: float, component: int, s: np.ndarray, r: float, num: int, den: int) -> np.ndarray:
        """Points within r of s, one of each other component that has any."""
        lo, hi = np.searchsorted(self.d, d - r - SLACK, "left"), np.searchsorted(self.d, d + r + SLACK, "right")
        if not np.any(self.component[lo:hi] != component):
            return np.zeros(0, np.int64)
        t = np.searchsorted(self.tokens, s)
        t[t == len(self.tokens)] = 0
        t = t[self.tokens[t] == s]
        first, many = self.at[t], self.at[t + 1] - self.at[t]
        ends = np.cumsum(many)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)
        both = np.bincount(self.owner[rows], minlength=len(self.h))[lo:hi]
        found = lo + np.flatnonzero((den * both >= num * (self.n[lo:hi] + len(s) - both)) & (self.component[lo:hi] != component))
        return found[np.unique(self.component[found], return_index=True)[1]]


def _join_regions(members: DataFrame, probes: DataFrame, sets: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links (src, dst) between probes and members of the same cell; both (cell, h, d, component, n).

    A cell is cut into blocks of members and runs of probes of about `block` shingles, each pair of them
    a task's group of its own."""
    parts = lambda rows, name: rows.groupBy("cell").agg(F.ceil(F.sum("n") / block).cast("long").alias(name), F.min("component").alias(f"{name}_lo"), F.max("component").alias(f"{name}_hi"))
    cut = parts(members, "blocks").join(parts(probes, "runs"), "cell").where(F.least("blocks_lo", "runs_lo") != F.greatest("blocks_hi", "runs_hi")).select("cell", "blocks", "runs")
    cut = materialise(cut, "cut")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("h"), F.col(c))
    inside = members.join(cut, "cell").select("cell", one("blocks").alias("block"), each("runs").alias("run"), F.lit(False).alias("probe"), "h", "d", "component")
    others = probes.join(cut, "cell").select("cell", each("blocks").alias("block"), one("runs").alias("run"), F.lit(True).alias("probe"), "h", "d", "component")
    rows = inside.unionByName(others).join(sets.select("h", "set"), "h").select("cell", "block", "run", "probe", "h", "d", "component", "set")
    rows = rows.repartition("cell", "block", "run").sortWithinPartitions("cell", "block", "run", "probe")
    r = 1 - num / den

    def search(batches):
        key, held, region, into = None, [], None, {}
        for b in batches:
            out = []
            for *at, probe, h, d, component, raw in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    key, held, region, into = at, [], None, {}
                s = np.frombuffer(raw, np.uint64)
                if not probe:
                    held.append((h, d, component, s))
                elif held:
                    region = region or _Region(held)
                    while component in into:  # components that links of this group have joined are one
                        component = into[component]
                    for y in region.links(d, component, s, r, num, den):
                        out.append((h, int(region.h[y])))
                        into[int(region.component[y])] = component
                        region.component[region.component == region.component[y]] = component
            cols = list(zip(*out)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["src", "dst"])

    return rows.mapInArrow(search, "src long, dst long")


def _points(docs: DataFrame, text: str, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signatures, classes, points): id, digest (hash of the text), n and h of every row; h and rep of every class; h, n, set and
    prefix of the classes that may have partners."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(docs, text, words))
    need = lambda n: -(-num * n // den)

    def signatures(batches):
        seen: set[int] = set()
        for b in batches:
            ns, hs, late, firsts = [], [], [], []
            for s in _sets(b.column(1), words):
                k = len(s)
                h = _set_hash(s) if k else None
                ns.append(k)
                hs.append(h)
                s, rare = _in_order(s, frequent.value)
                m = min(k - need(k) + _extra(k), k)
                late.append(max(m - rare, 0))
                firsts.append(None if h is None or h in seen else s[: min(m, rare)].view(np.int64))
                if len(seen) < SEEN:
                    seen.add(h)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ns, pa.int64()), pa.array(hs, pa.int64()), pa.array(late, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], ["id", "digest", "n", "h", "late", "firsts"])

    sig = materialise(docs.select("_id", text, F.xxhash64(text)).mapInArrow(signatures, "id long, digest long, n long, h long, late long, firsts array<long>"), "sig")
    some = sig.where("n > 0 and id is not null")
    # a copy may be the one that a null id hides, so copies send their shingles whatever their id
    sent = sig.where("firsts is not null").groupBy("h").agg(F.count("*").alias("sent"))
    classes = materialise(some.groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("late").alias("late")).join(sent, "h"), "classes")
    shingle = Window.partitionBy("s")
    met = sig.where("firsts is not null").select("h", F.explode("firsts").alias("s")).withColumn("lo", F.min("h").over(shingle)).withColumn("hi", F.max("h").over(shingle)).where("lo <> hi")
    met = met.groupBy("h").agg(F.count("*").alias("met"))
    enough = F.greatest(F.lit(1), (F.col("n") / 8).cast("long"))  # one less than _extra(n) for the rounding of both sizes
    alive = classes.join(met, "h", "left").where(F.coalesce(F.col("met"), F.lit(0)) / F.col("sent") + F.col("late") >= enough).select(F.col("rep").alias("id"), "h")
    alive = materialise(alive, "alive")
    near = keep_probable(docs.select(F.col("_id").alias("id"), F.col(text).alias("t")), "id", alive.select("id"), alive.count())
    rows = near.join(alive, "id").dropDuplicates(["id", "h", "t"]).select("h", "t")

    def sets(batches):
        for b in batches:
            out = []
            for h, s in zip(b.column(0).to_pylist(), _sets(b.column(1), words)):
                if _set_hash(s) == h:  # ids that occur with several texts
                    first, _ = _in_order(s, frequent.value)
                    out.append((h, len(s), s.tobytes(), first[: len(s) - need(len(s)) + 1].view(np.int64)))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], ["h", "n", "set", "prefix"])

    points = materialise(rows.mapInArrow(sets, "h long, n long, set binary, prefix array<long>"), "points")
    return sig, classes.select("h", "rep"), points


def _neighbourhoods(points: DataFrame, num: int, den: int) -> DataFrame:
    """(scope, g, h, p): points h that share a shingle of their prefixes, and their pivot p; of equal
    neighbourhoods one.  Overlapping size bands of ratio den / num keep out what no link can join."""
    band = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
    rows = points.select("h", F.explode("prefix").alias("s"), band.alias("band"))
    rows = rows.select("h", "s", F.explode(F.array("band", F.col("band") - 1)).alias("band")).select(F.xxhash64("s", "band").alias("g"), "h")
    groups = rows.groupBy("g").agg(F.count("*").alias("c"), F.min("h").alias("p"), F.bit_xor(F.xxhash64("h")).alias("a"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("b")).where("c > 1")
    groups = groups.groupBy("c", "p", "a", "b").agg(F.min("g").alias("g")).select("g", "p")
    return rows.join(groups, "g").select(F.lit(0).cast("long").alias("scope"), "g", "h", "p")


def _owners(near: DataFrame) -> DataFrame:
    """(scope, p): the pivots that own a region, of (scope, h, p, d): those that are the least point of all
    their neighbourhoods, and for points that meet none of these the nearest they meet.

    A few pivots thus hold a group of near copies, though each of its many neighbourhoods names one."""
    least = near.select("scope", "p").distinct().join(near.select("scope", F.col("h").alias("p")), ["scope", "p"], "left_anti")
    met = near.join(least.withColumn("least", F.lit(True)), ["scope", "p"], "left")
    met = met.groupBy("scope", "h").agg(F.max("least").alias("least"), F.min(F.struct("d", "p")).alias("m")).where("least is null")
    return least.unionByName(met.select("scope", F.col("m.p").alias("p"))).distinct()


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """Links documents whose sets of word n-grams have den * |intersection| >= num * |union|.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case.  One row per input row: id_col,
    n_shingles, class_id (equal for equal sets; null without words), component_id, component_class (the least
    class_id reachable, which tells apart components that share their least id), text_hash (xxhash64).
    Fewer words than `words`: the whole sequence is the only shingle.  Null text or none: empty set,
    linked with nothing, component_id = id.  Rows with a null id link with nothing and have a null
    component.  Repeated ids are separate rows, and the component of each follows its own text.
    Very long texts are read whole.  Empty table: no rows.  Other columns of docs are ignored.  Ids are
    cast to long.  An overlap of num/den must be > 1/2.  block and levels affect speed, never the result."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    sig, classes, points = _points(docs, "_t", words, num, den)
    size = points.select("h", "n")
    linked = F.lit(den) * F.col("inter") >= F.lit(num) * F.col("uni")
    r = 1 - num / den
    rows = materialise(_neighbourhoods(points, num, den), "near")
    spark = docs.sparkSession
    known = spark.createDataFrame([], "x long, p long, inter long, uni long")
    comp, edges, joins = None, None, []
    for level in range(levels):
        # distances to the pivots of a point's neighbourhoods that no level before has computed
        wanted = rows.where("h <> p").select(F.col("h").alias("x"), "p").distinct()
        tested = known.union(materialise(_distances(wanted.join(known, ["x", "p"], "left_anti") if level else wanted, points), "tested"))
        far = tested.select(F.col("x").alias("h"), "p", (1 - F.col("inter") / F.col("uni")).alias("d"))
        if comp is None:
            comp = components(tested.where(linked).select(F.col("x").alias("src"), F.col("p").alias("dst")))
            comp = materialise(size.join(comp.withColumnRenamed("id", "h"), "h", "left").select("h", "n", F.coalesce("component", "h").alias("component")), "component")
        near = rows.select("scope", "h", "p").distinct().where("h <> p").join(far, ["h", "p"])
        own = _owners(near) if level == 0 else rows.select("scope", "p").distinct()
        own = materialise(own, "own")
        nearest = near.join(own, ["scope", "p"]).join(own.withColumnRenamed("p", "h"), ["scope", "h"], "left_anti").groupBy("scope", "h").agg(F.min(F.struct("d", "p")).alias("m")).select("scope", "h", F.col("m.p").alias("p"), F.col("m.d").alias("d"))
        voronoi = nearest.unionByName(own.select("scope", F.col("p").alias("h"), "p", F.lit(0.0).alias("d")))
        voronoi = materialise(voronoi.join(comp, "h").select("scope", "h", F.col("p").alias("pivot"), "d", "component", "n"), "voronoi")
        # windows: points of a neighbourhood to the regions of the others there
        at = rows.select("scope", "g", "h").distinct().join(voronoi, ["scope", "h"])
        there = at.groupBy("scope", "g", F.col("pivot").alias("q")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("d").alias("reach"))
        ask = at.join(there, ["scope", "g"]).where("q < pivot and (lo <> hi or lo <> component)").groupBy("scope", "h", "q", "component", "n").agg(F.max("reach").alias("reach"))
        ask = materialise(ask, "ask")
        more = ask.where("h <> q").select(F.col("h").alias("x"), F.col("q").alias("p")).distinct().join(tested, ["x", "p"], "left_anti")
        tested = tested.union(materialise(_distances(more, points), "tested"))
        far = tested.select(F.col("x").alias("h"), F.col("p").alias("q"), (1 - F.col("inter") / F.col("uni")).alias("d"))
        window = ask.join(far, ["h", "q"]).where(F.col("d") <= F.col("reach") + r + SLACK)
        name = lambda p: F.xxhash64("scope", p, F.lit(level)).alias("cell")
        members = voronoi.select(name("pivot"), "h", "d", "component", "n")
        probes = materialise(window.select(name("q"), "h", "d", "component", "n").unionByName(members.where(F.col("d") > r - SLACK)), "probes")
        known = tested
        large = None
        if level + 1 < levels:
            both = members.unionByName(window.select(name("q"), "h", "d", "component", "n"))
            large = materialise(both.groupBy("cell").agg(F.sum("n").alias("total")).where(F.col("total") > block).join(probes.select("cell").distinct(), "cell", "left_semi"), "large")
            if large.isEmpty():
                large = None
        if large is None:
            joins.append((members, probes))
            break
        joins.append((members.join(large, "cell", "left_anti"), probes.join(large, "cell", "left_anti")))
        # recursion: large regions with their windows are neighbourhoods with pivots of their own
        inner = both.join(large, "cell").select("cell", "h", "total").distinct()
        slot = F.pmod(F.xxhash64("h", F.lit(level)), F.least(F.ceil(F.col("total") / block) + 1, F.lit(MAX_SPLIT)))
        chosen = inner.groupBy("cell", slot.alias("slot")).agg(F.min("h").alias("p")).select("cell", "p")
        rows = materialise(inner.select("cell", "h").join(chosen, "cell").select(F.col("cell").alias("scope"), F.col("cell").alias("g"), "h", "p"), "near")
    found = known.where(linked).select(F.col("x").alias("src"), F.col("p").alias("dst"))
    for members, probes in joins:
        found = found.union(materialise(_join_regions(members, probes, points, num, den, block), "links"))
    comp = components(found)

    label = classes.join(comp.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    least = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "component").select("h", "component_id", F.col("component").alias("component_class"))
    out = sig.where("n > 0 and id is not null").join(label, "h").select("id", "n", F.col("h").alias("class_id"), "component_id", "component_class", "digest")
    rest = sig.where("n = 0 or id is null").select("id", "n", F.col("h").alias("class_id"), F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component_class"), "digest")
    return out.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id", "component_class", F.col("digest").alias("text_hash"))
