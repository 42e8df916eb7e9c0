"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1, where cosine >= t means a distance of at most r = sqrt(2 - 2 t).  A
coarse quantiser deals them into inverted lists; residuals get one code byte for each subspace.
* Sufficient probes: partners in different cells lie on both sides of the plane between the two
  centroids, so their distances to it add up to r at most and the lesser is at most r / 2.  x probes
  a cell unless it is farther than r / 2 from that plane, or farther than r from the ball around the
  cell's members.  The partner nearer to the plane reports the link, for both ends.
* Asymmetric distances: the table of distances from x to all subspace codes gives |x - q(y)| by
  lookups; with e = |y - q(y)| stored beside the code, |x - q(y)| > r + e rules y out.
* Exact rerank: the cosine of what is left, in double precision.
No step loses a link, whatever the data.  A query's row and its table cost as much as some hundred
distances each, so there are as many cells as a cell has vectors, and a subspace has a code for every
four of these: a table is never larger than what is read from it.  The index is fitted on a bounded sample
and holds every vector.  Equal vectors are one entry with a count.  Lists are cut into blocks and queries into runs, so a list of
any size spreads over many tasks; a task sends the links of a run as a spanning set of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, least_hashes, materialise, small_batches

SAMPLE = 20_000  # vectors that fit the quantisers
MAX_CELLS = 4096
SUBSPACES, LEAST_CODES, CODES = 16, 16, 256
BLOCK, RUN, PROBED = 2048, 8192, 1024
SLACK = 1e-6


def sizes(total: int) -> tuple[int, int]:
    """Cells, and codes of a subspace, for so many vectors."""
    cells = min(MAX_CELLS, max(1, int(total**0.5)))
    return cells, min(CODES, max(LEAST_CODES, total // cells // 4))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[lo : lo + 4096] @ c.T, axis=1) for lo in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids and subspace codebooks, fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, cells: int, subspaces: int = SUBSPACES, codes: int = CODES):
        self.dim = sample.shape[1]
        self.centroids = _kmeans(sample, cells, 8, 1)
        res = sample - self.centroids[_nearest(sample, self.centroids)]
        self.cuts = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        self.books = [_kmeans(res[:, a:b], codes, 6, 2 + a) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray):
        """Cell, codes and quantisation error of unit vectors."""
        cell = _nearest(x, self.centroids)
        res = x - self.centroids[cell]
        codes = np.stack([_nearest(res[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return cell, codes.astype(np.uint8), np.sqrt(((res - back) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, cell: np.ndarray, radii: np.ndarray, r: float) -> np.ndarray:
        """Boolean (vector, cell): cells to look for vectors within r in that are not nearer to the plane."""
        c = self.centroids
        d2 = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)
        apart = np.sqrt(np.maximum((c * c).sum(axis=1)[:, None] - 2 * c @ c.T + (c * c).sum(axis=1), 0))[cell]
        plane = d2 - d2[np.arange(len(x)), cell][:, None] <= 2 * (apart + SLACK) * (r / 2 + SLACK)
        return plane & (np.sqrt(d2) <= radii + r + SLACK)

    def reports(self, x: np.ndarray, own: np.ndarray, h: np.ndarray, y: np.ndarray, cell: int, ph: np.ndarray) -> np.ndarray:
        """Which links of x (cells own, keys h) with y (one cell, keys ph) are x's to report: those in
        its own cell and those where it is the nearer to the plane.  Sums run by row, so that both ends
        come to the same answer."""
        c = self.centroids
        gap = lambda u, at, over: ((u - c[over]) ** 2).sum(axis=1) - ((u - c[at]) ** 2).sum(axis=1)
        there = np.full(len(own), cell)
        gx, gy = gap(x, own, there), gap(y, there, own)
        return (own == cell) | (gx < gy) | ((gx == gy) & (h < ph))

    def distances2(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances of queries to coded vectors of one cell, by table lookups."""
        res = x - self.centroids[cell]
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            part = res[:, a:b]
            table = ((part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)).astype(np.float32)
            out += np.take(table, codes[:, m], axis=1)
        return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """Links all pairs of vectors of equal dimension with cosine >= threshold (> 0).

    One row per input row: id_col, n_links, component_id (least id reachable), kept (is its own
    component).  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing.  Repeated ids are separate rows that share no link by their id; rows of null id link with
    nothing and are not kept.  Empty table: no rows.  Other columns are ignored."""
    small_batches(vectors.sparkSession)
    kind = "array<double>"
    good = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).withColumn("ok", F.coalesce(good, F.lit(False)) & F.col("id").isNotNull())

    keyed = materialise(rows.where("ok").select("id", "v", F.xxhash64("v").alias("h")), "vectors")
    classes = materialise(keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    links, counts = [], []
    for dim in [r[0] for r in classes.select(F.size("v")).distinct().collect()]:
        e, n = _links(classes.where(F.size("v") == dim), dim, threshold, sample)
        links.append(e)
        counts.append(n)
    spark = vectors.sparkSession
    edges, near = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "h long, m long")
    for e, n in zip(links, counts):
        edges, near = edges.union(e), near.union(n)
    comp = components(edges)
    label = classes.select("h", "rep", "n").join(near.groupBy("h").agg(F.sum("m").alias("m")), "h", "left").join(comp.withColumnRenamed("id", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    label = label.join(label.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("h", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("id", "h").join(label, "h").select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(classes: DataFrame, dim: int, threshold: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """(spanning edges between classes, number of vectors in other classes linked to each class)."""
    spark = classes.sparkSession
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    total = classes.count()
    picked = least_hashes(classes, "h", sample, total).select("v").toArrow().column(0).combine_chunks()
    cells, size = sizes(total)
    index = spark.sparkContext.broadcast(Index(_unit(picked.flatten().to_numpy().reshape(-1, dim)), cells, codes=size))

    def encode(batches):
        for b in batches:
            x = _unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            cell, codes, err = index.value.encode(x)
            far = np.sqrt(((x - index.value.centroids[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(far)], ["h", "n", "v", "cell", "codes", "err", "far"])

    coded = materialise(classes.select("h", "n", "v").mapInArrow(encode, "h long, n long, v array<double>, cell int, codes binary, err double, far double"), "coded")
    lists = {c: (far, n) for c, far, n in coded.groupBy("cell").agg(F.max("far"), F.count("*")).collect()}  # a row a cell, MAX_CELLS at most
    radii, blocks = np.full(MAX_CELLS, -np.inf), np.zeros(MAX_CELLS, np.int64)
    for c, (far, n) in lists.items():
        radii[c], blocks[c] = far, -(-n // BLOCK)

    def probe(batches):
        k = len(index.value.centroids)
        for b in (b.slice(lo, PROBED) for b in batches for lo in range(0, b.num_rows, PROBED)):
            x = _unit(b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            hit = index.value.probes(x, b.column(3).to_numpy(), radii[:k], r)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.flatnonzero(h).astype(np.int32) for h in hit], pa.list_(pa.int32()))], ["h", "n", "v", "own", "cells"])

    asked = coded.select("h", "n", "v", F.col("cell").alias("own")).mapInArrow(probe, "h long, n long, v array<double>, own int, cells array<int>")
    asked = materialise(asked, "asked")
    # a list goes, in blocks, to as many runs as its own queries make
    asks = dict(asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect())
    split = F.broadcast(spark.createDataFrame([(int(c), int(blocks[c]), -(-asks[c] // RUN)) for c in lists if c in asks], "cell int, blocks long, runs long"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    one = lambda c: F.pmod(F.xxhash64("h"), F.col(c))
    queries = asked.select("h", "n", "v", "own", F.explode("cells").alias("cell")).join(split, "cell")
    queries = queries.select("cell", each("blocks").alias("block"), one("runs").alias("run"), F.lit(True).alias("query"), "h", "n", "v", F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("err"), "own")
    posts = coded.join(split, "cell").select("cell", one("blocks").alias("block"), each("runs").alias("run"), F.lit(False).alias("query"), "h", "n", "v", "codes", "err", F.col("cell").alias("own"))
    work = posts.unionByName(queries).repartition("cell", "block", "run").sortWithinPartitions("cell", "block", "run", "query")

    def search(batches):
        key, held, block = None, [], None
        for b in batches:
            at = np.stack([b.column(k).to_numpy() for k in range(3)], axis=1)
            query, h, n, err, own = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 8, 9))
            x = _unit(b.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            codes = b.column(7)
            step = np.flatnonzero(np.any(at[1:] != at[:-1], axis=1) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip([0, *step], [*step, len(at)]):
                if lo == hi:
                    continue
                if key != tuple(at[lo]):
                    key, held, block = tuple(at[lo]), [], None
                if not query[lo]:
                    held.append((h[lo:hi], n[lo:hi], x[lo:hi], np.frombuffer(b"".join(codes.slice(lo, hi - lo).to_pylist()), np.uint8).reshape(hi - lo, -1), err[lo:hi]))
                elif held or block:
                    if block is None:
                        block = [np.concatenate(c) for c in zip(*held)]
                        held = []
                    for q in range(lo, hi, 1024):
                        yield from match(*(c[q : min(q + 1024, hi)] for c in (x, h, n, own)), int(key[0]), *block)

    def match(x, h, n, own, cell, ph, pn, px, codes, err):
        i, j = np.nonzero(index.value.distances2(x, cell, codes) <= ((r + err + SLACK) ** 2 + SLACK).astype(np.float32))
        i, j = (a[h[i] != ph[j]] for a in (i, j))
        keep = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], px[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.zeros(0)]) >= threshold
        i, j = i[keep], j[keep]
        mine = np.concatenate([index.value.reports(x[a], own[a], h[a], px[c], cell, ph[c]) for a, c in ((i[k : k + 65536], j[k : k + 65536]) for k in range(0, len(i), 65536))] or [np.zeros(0, bool)])
        i, j = i[mine], j[mine]
        if not len(i):
            return
        m = np.bincount(i, pn[j].astype(np.float64), len(x)).astype(np.int64)
        some = np.flatnonzero(m)
        over = own[i] != cell
        back = np.bincount(j[over], n[i[over]].astype(np.float64), len(ph)).astype(np.int64)
        they = np.flatnonzero(back)
        first = np.full(len(x), -1)
        first[i[::-1]] = j[::-1]
        a = np.concatenate((h[some], ph[first[i]]))
        b = np.concatenate((ph[first[some]], ph[j]))
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        null = lambda k: pa.nulls(k, pa.int64())
        ends, counts = np.concatenate((h[some], ph[they])), np.concatenate((m[some], back[they]))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(ends), null(len(pairs))]), pa.concat_arrays([pa.array(counts), null(len(pairs))]), pa.concat_arrays([null(len(ends)), pa.array(pairs[:, 0])]), pa.concat_arrays([null(len(ends)), pa.array(pairs[:, 1])])], ["h", "m", "src", "dst"])

    found = materialise(work.mapInArrow(search, "h long, m long, src long, dst long"), "found")
    return found.where("src is not null").select("src", "dst"), found.where("h is not null").select("h", "m")
