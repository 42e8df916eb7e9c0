"""Benchmark decontamination with SimHash over item-sized windows.

An item of L words is held against every window of L words of every document (the whole document,
if it is shorter).  Shingles are five words; the similarity of a window and an item is the sum of the
lesser multiplicities of their shingles over the sum of the greater.
1. Windows without any shingle of an item of their length have similarity 0 and are skipped.
2. The others get a 256-bit SimHash of their shingles, from running sums.  The k-th occurrence of a
   shingle in a window is an element of its own, so the similarity is that of two sets of elements
   and a repeated shingle weighs no more than as many different ones.
3. A multi-index finds the items: fingerprints are cut into LANES blocks of 64 bits, and of two
   fingerprints within RADIUS bits at least one block differs in at most RADIUS // LANES bits (one in
   sixty of chance pairs does), so the union over the blocks loses none; the whole distance is checked
   next.
4. The exact similarity decides.
At similarity 0.75 the fingerprints differ in 44 bits on average, 6 standard deviation; RADIUS lies
some 6 deviations above, and chance pairs (128 on average) lie 5 above it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _R, _rng_u64, all_shingles, mix64, row_slices, shingles, small_batches, string_buffers, word_hashes

WORDS, RADIUS, LANES = 5, 84, 4
#: Words of items that one pass over the documents takes along (about 32 MB: shingles and counts of each
#: item, and all shingles once more by length and over all); more items, more passes.
PASS_WORDS = 1 << 20
_LANE = _rng_u64(21, LANES)
#: Pairs of windows and items compared at once (16 MB for each block).
PAIRS = 1 << 21


def signs(sh: np.ndarray) -> np.ndarray:
    """(shingle, 256) of +1 and -1."""
    lanes = np.stack([mix64(sh ^ lane) for lane in _LANE], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def elements(sh: np.ndarray, k: np.ndarray) -> np.ndarray:
    """One hash for the k-th (from 1) occurrence of each shingle."""
    return sh + (k - 1).astype(np.uint64) * _R


class Occurrences:
    """Positions of equal shingles, to count them in windows."""

    def __init__(self, sh: np.ndarray):
        self.span = 2 * len(sh) + 1
        group = np.unique(sh, return_inverse=True)[1].reshape(-1).astype(np.int64)
        self.key = group * self.span + np.arange(len(sh))
        self.sorted = np.sort(self.key)
        self.rank = np.searchsorted(self.sorted, self.key)

    def since(self, p: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each shingle p in start..p."""
        return self.rank[p] - np.searchsorted(self.sorted, self.key[p] - (p - start)) + 1

    def until(self, p: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Occurrences of each shingle p in p..end - 1."""
        return np.searchsorted(self.sorted, self.key[p] + (end - p)) - self.rank[p]


def window_sums(sh: np.ndarray, at: Occurrences, first: int, count: int, m: int) -> np.ndarray:
    """Sums of signs of the elements of the windows of m shingles at first, first + 1, ..."""
    p = np.arange(first, first + m)
    out = np.empty((count, 64 * LANES), np.int32)
    out[0] = 0
    for lo in range(0, m, 4096):
        q = p[lo : lo + 4096]
        out[0] += signs(elements(sh[q], at.since(q, np.full(len(q), first)))).sum(axis=0, dtype=np.int32)
    if count > 1:
        gone, new = np.arange(first, first + count - 1), np.arange(first + m, first + m + count - 1)
        out[1:] = signs(elements(sh[new], at.since(new, gone + 1)))
        out[1:] -= signs(elements(sh[gone], at.until(gone, gone + m)))
    return np.cumsum(out, axis=0, dtype=np.int32)


def simhash(sums: np.ndarray) -> np.ndarray:
    """(window, LANES) of 64-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def _shared(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> int:
    """Sum of the lesser counts of the values that two sorted sets (a, n) and (b, m) share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.where(b[at] == a, np.minimum(n, m[at]), 0).sum())


class ItemIndex:
    """Items of one length: shingles, multiplicities, fingerprints and the multi-index."""

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int):
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(s, return_counts=True) for _, s in items]
        self.size = [len(s) for _, s in items]
        self.prints = np.concatenate([simhash(window_sums(s, Occurrences(s), 0, 1, len(s))) for _, s in items])
        self.radius = radius
        self.all = np.unique(np.concatenate([s for _, s in items]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius."""
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, PAIRS // len(self.ids))
        for lo in range(0, len(prints), step):
            part = prints[lo : lo + step]
            hit = np.zeros((len(part), len(self.ids)), bool)
            for b in range(LANES):
                hit |= np.bitwise_count(part[:, b, None] ^ self.prints[:, b]) <= self.radius // LANES
            w, i = np.nonzero(hit)
            ok = np.bitwise_count(part[w] ^ self.prints[i]).sum(axis=1, dtype=np.int32) <= self.radius
            found.append(np.stack((w[ok] + lo, i[ok]), axis=1))
        return tuple(np.concatenate(found).T)


class Matcher:
    """All items of one pass, by length."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, num: int = 3, den: int = 4):
        self.num, self.den, self.short, by_length = num, den, {}, {}
        for i, text in items:
            w, _ = word_hashes(*string_buffers(pa.array([text], pa.string())))
            if len(w) >= WORDS:
                by_length.setdefault(len(w), []).append((i, shingles(w, WORDS)))
            elif len(w):  # the whole sequence is its only shingle
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w, len(w))[0]), []).append(i)
        self.by_length = {k: ItemIndex(v, radius) for k, v in by_length.items()}
        self.all = np.unique(np.concatenate([x.all for x in self.by_length.values()] or [np.zeros(0, np.uint64)]))
        self.door = np.zeros(1 << 16, bool)
        self.door[(self.all & np.uint64(0xFFFF)).astype(np.int64)] = True

    def documents(self, text: pa.Array):
        """Per document with a match: (row, {item: (similarity, first word of the best window)})."""
        for lo, hi in row_slices(text):
            for d, found in self._slice(text.slice(lo, hi - lo)):
                yield lo + d, found

    def _slice(self, text: pa.Array):
        data, off = string_buffers(text)
        w, bounds = word_hashes(data, off)
        sh, at = all_shingles(w, bounds, WORDS)
        maybe = np.flatnonzero(self.door[(sh & np.uint64(0xFFFF)).astype(np.int64)])
        maybe = maybe[np.isin(sh[maybe], self.all)]
        rows = set(np.unique(np.searchsorted(at, maybe, "right") - 1).tolist())
        tiny = {}
        for k, table in self.short.items():
            grams, gram_at = all_shingles(w, bounds, k)
            for p in np.flatnonzero(np.isin(grams, np.array(list(table), np.uint64))).tolist():
                d = int(np.searchsorted(gram_at, p, "right") - 1)
                if bounds[d + 1] - bounds[d] >= k:
                    for i in table[int(grams[p])]:
                        tiny.setdefault(d, {}).setdefault(i, (1.0, p - int(gram_at[d])))
        for d in sorted(rows | set(tiny)):
            found = self._document(sh[at[d] : at[d + 1]], int(bounds[d + 1] - bounds[d])) if d in rows else {}
            found |= tiny.get(d, {})
            if found:
                yield d, found

    def _document(self, sh: np.ndarray, words: int) -> dict:
        found: dict = {}
        at = None
        for length, index in self.by_length.items():
            hits = np.flatnonzero(np.isin(sh, index.all))
            if not len(hits):
                continue
            m = min(length, words) - WORDS + 1 if words >= WORDS else len(sh)
            last = len(sh) - m
            mark = np.zeros(last + 2, np.int32)
            np.add.at(mark, np.minimum(np.maximum(hits - m + 1, 0), last + 1), 1)
            np.add.at(mark, np.minimum(hits, last) + 1, -1)
            at = at or Occurrences(sh)
            starts = np.flatnonzero(np.cumsum(mark)[: last + 1] > 0)
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                for lo in range(0, len(run), 4096):  # bounded memory in long runs
                    part = run[lo : lo + 4096]
                    win, item = index.candidates(simhash(window_sums(sh, at, int(part[0]), len(part), m)))
                    for k, i in zip(win.tolist(), item.tolist()):
                        both = _shared(*np.unique(sh[part[k] : part[k] + m], return_counts=True), *index.sets[i])
                        most = m + index.size[i] - both
                        if self.den * both >= self.num * most:
                            name = index.ids[i]
                            if name not in found or both / most > found[name][0]:
                                found[name] = (both / most, int(part[k]))
        return found


def _passes(items: DataFrame, id_col: str, text_col: str):
    """Items in lists of at most PASS_WORDS words (or one longer item), so what a pass broadcasts is
    bounded whatever the number of items."""
    small_batches(items.sparkSession)
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        n = len(r.t) // 2 + 1
        if held and size + n > PASS_WORDS:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, similarity, word_at): each document that holds an item with similarity >= 0.75
    in some window, the best similarity and the first word (from 0) of the first best window.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z as a-z.  Items of fewer than five words must occur as they
    are.  Null texts, wordless items, null item ids: no match.  Repeated document rows give repeated
    rows, and a repeated item id is one item of several texts, each document's best taken over rows of
    equal id.  Null document ids are kept.  Empty tables: no rows.  Other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    out = spark.createDataFrame([], "d long, i long, similarity double, word_at long")
    for some in _passes(items, item_col, item_text):
        matcher = spark.sparkContext.broadcast(Matcher(some))

        def match(batches, matcher=matcher):
            for b in batches:
                ids = b.column(0).to_pylist()
                hits = [(ids[k], i, s, p) for k, found in matcher.value.documents(b.column(1)) for i, (s, p) in found.items()]
                c = list(zip(*hits)) if hits else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64())], ["d", "i", "similarity", "word_at"])

        out = out.union(rows.mapInArrow(match, "d long, i long, similarity double, word_at long"))
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_col), "similarity", "word_at")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that find_leaks() would report; all columns kept, one pass, no shuffle.

    Null and empty texts stay, null and repeated ids are rows like others, each judged by its own whole text;
    items that are null or wordless remove nothing; an empty table of either kind is no error."""
    at = docs.columns.index(text_col)
    for some in _passes(items, item_col, item_text):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(some))

        def clean(batches, matcher=matcher):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, _ in matcher.value.documents(b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
