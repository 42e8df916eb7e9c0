"""Quality classifier from weak labels, without any gold label.

Eleven overlapping heuristic labellers vote keep, reject or abstain on each document.  Votes are counted
by pattern over all documents (at most 3**11 rows, whatever the corpus), and expectation-maximisation
on these counts estimates each labeller's votes given the hidden class, and each pattern's posterior.
The posteriors of a bounded sample then train a logistic scorer on hashed features of words and of
word-shape pairs, which scores every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _SPACE, least_hashes, materialise, mix64, row_slices, small_batches, string_buffers, word_hashes

#: Documents that train the scorer, those of the least id hash.
SAMPLE = 3000
WORD_DIMS = SHAPE_DIMS = 1 << 12
DIMS = WORD_DIMS + SHAPE_DIMS + 1
THRESHOLD = 0.5
ABSTAIN, REJECT, KEEP = 0, 1, 2
#: The first DETECTORS labellers look for one fault each and are silent otherwise; the next says keep
#: where none of them found any; the rest judge both ways.
LABELLERS, DETECTORS = 11, 7

#: Function words of the languages at hand.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with be by this at from or an "
    "le la les de des et un une du en que pour est dans au "
    "der die das und ist in den von zu mit für im dem nicht "
    "el los las y del para por una con su se al lo"
).split()
#: Bytes that prose seldom holds.
SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LATER = np.zeros(256, bool)  # later bytes of a character
_LATER[0x80:0xC0] = True


def _known(words) -> np.ndarray:
    return np.sort(word_hashes(*string_buffers(pa.array([" ".join(words)])))[0])


_FUNCTION = _known(dict.fromkeys(FUNCTION_WORDS))
_PIPE = _known(["|"])


def _sum(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of flags between bounds."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):  # what lies between two runs with flags is empty
        out[some] = np.add.reduceat(flags, bounds[:-1][some], dtype=np.int64)
    return out


class Texts:
    """Words and counts of a batch of texts."""

    def __init__(self, text: pa.Array):
        self.data, self.off = string_buffers(text)
        self.w, self.bounds = word_hashes(self.data, self.off)
        self.n = np.diff(self.bounds)
        body = self.data[self.off[0] : self.off[-1]]
        at = self.off - self.off[0]
        self.at, self.body = at, body
        self.solid = _sum(~_SPACE[body] & ~_LATER[body], at)
        self.symbols = _sum(_IS_SYMBOL[body], at)
        self.upper, self.lower = _sum(_UPPER[body], at), _sum(_LOWER[body], at)
        self.bangs = _sum(body == 33, at)
        self.stops = _sum(body == 46, at)
        same = np.zeros(len(self.w), bool)
        same[1:] = self.w[1:] == self.w[:-1]
        same[self.bounds[:-1][self.n > 0]] = False
        self.same = same
        self.repeats = _sum(same, self.bounds)
        self.pipes = _sum(self.w == _PIPE[0], self.bounds)
        self.function = _sum(np.isin(self.w, _FUNCTION), self.bounds)

    def votes(self) -> np.ndarray:
        """(document, labeller) of ABSTAIN, REJECT, KEEP."""
        n, solid = np.maximum(self.n, 1), np.maximum(self.solid, 1)
        distinct = np.array([len(np.unique(self.w[a:b])) for a, b in zip(self.bounds, self.bounds[1:])], np.float64).reshape(-1)
        letters = self.upper + self.lower
        some, many = self.n >= 5, self.n >= 30

        def vote(reject, keep=False, may=True):
            return np.where(may & (self.n > 0), np.where(reject, REJECT, np.where(keep, KEEP, ABSTAIN)), ABSTAIN)

        share = lambda x: x / n
        found = [
            vote(share(self.repeats) > 0.15, may=some),
            vote(self.symbols / solid > 0.06),
            vote(self.upper > 0.4 * letters, may=letters >= 10),
            vote(share(self.pipes) > 0.15, may=some),
            vote(share(self.bangs) > 0.2, may=some),
            vote(distinct < 0.25 * np.sqrt(n) + 0.02 * n, may=many),
            vote((self.symbols + self.bangs) / n > 0.5, may=some),
        ]
        judged = [
            vote(False, ~np.any(np.stack(found) == REJECT, axis=0)),
            vote((solid / n > 14) | (solid / n < 1.6), (solid / n > 2.5) & (solid / n < 9), some),
            vote(share(self.stops) < 0.003, (share(self.stops) > 0.02) & (share(self.stops) < 0.4), many),
            vote(share(self.function) < 0.03, share(self.function) > 0.08, many),
        ]
        return np.stack(found + judged, axis=1).astype(np.int64)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, dimension, value) of the hashed features: shares of a document's words."""
        doc = np.repeat(np.arange(len(self.n)), self.n)
        if not len(doc):
            return doc, doc, doc.astype(float)
        solid = ~_SPACE[self.body]
        before = np.concatenate(([False], solid[:-1]))
        before[self.at[:-1][self.at[:-1] < len(solid)]] = False
        begin = np.flatnonzero(solid & ~before)
        after = np.concatenate((solid[1:], [False]))
        cut = self.at[1:-1]
        after[cut[(cut > 0) & (cut <= len(solid))] - 1] = False
        end = np.flatnonzero(solid & ~after) + 1
        total = lambda flags: np.add.reduceat(flags, begin, dtype=np.int32)  # noqa: E731  blanks behind a word hold none
        size = end - begin
        up, sym, low = total(_UPPER[self.body]), total(_IS_SYMBOL[self.body] | (self.body == 33)), total(_LOWER[self.body])
        shape = (up > 0).astype(np.uint64) | ((up > 1) & (up >= low)).astype(np.uint64) << np.uint64(1) | (sym > 0).astype(np.uint64) << np.uint64(2) | np.isin(self.body[end - 1], [44, 46]).astype(np.uint64) << np.uint64(3) | self.same.astype(np.uint64) << np.uint64(4) | np.minimum(size // 3, 5).astype(np.uint64) << np.uint64(5) | np.isin(self.w, _FUNCTION).astype(np.uint64) << np.uint64(8)
        word = (self.w % np.uint64(WORD_DIMS)).astype(np.int64)
        earlier = np.concatenate(([np.uint64(511)], shape[:-1]))
        earlier[self.bounds[:-1][self.n > 0]] = np.uint64(511)
        pair = WORD_DIMS + (mix64(shape * np.uint64(1024) + earlier + np.uint64(1)) % np.uint64(SHAPE_DIMS)).astype(np.int64)
        value = 1.0 / self.n[doc]
        return np.concatenate((doc, doc)), np.concatenate((word, pair)), np.concatenate((value, value))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Probability that each document is to be kept."""
        doc, dim, value = self.features()
        z = np.bincount(doc, weights[dim] * value, len(self.n)) + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: posterior of KEEP by pattern, P(vote | class) as (class, labeller,
    vote) and the prior of KEEP.

    A detector's vote is its firing, out of all documents; others' votes are out of those they judge.
    Silence says nothing by itself: faults exclude each other, so in a document that shows one the
    silent detectors do not vouch for it; that none has fired is one vote to keep.  It begins at the votes weighed by their surprise, -log of the
    share of votes they have, as rejections are rare.  No votes: the prior."""
    votes = np.stack([patterns == REJECT, patterns == KEEP], axis=2).astype(float)
    judged = votes.sum(axis=2)
    judged[:, : DETECTORS + 1] = 1
    usual = (np.einsum("p,pmv->mv", counts, votes) + 0.5) / (counts @ judged + 1)[:, None]
    pull = np.einsum("pmv,mv->pv", votes, -np.log(np.minimum(usual, 1)))
    post = (pull[:, 1] + 0.5) / (pull.sum(axis=1) + 0.6)
    table, prior = np.full((2, patterns.shape[1], 2), 0.5), 0.5
    for _ in range(rounds):
        weight = np.stack((counts * (1 - post), counts * post))
        table = (np.einsum("cp,pmv->cmv", weight, votes) + 0.5) / (weight @ judged + 1)[:, :, None]
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        logit = np.log(prior / (1 - prior)) + np.einsum("pmv,mv->p", votes, np.log(table[1]) - np.log(table[0]))
        new = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
        done = np.abs(new - post).max(initial=0) < 1e-7
        post = new
        if done:
            break
    return post, table, prior


def fit_scorer(doc: np.ndarray, dim: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels y by full-batch Adam over sparse features; both classes
    weigh the same."""
    w, m, v = np.zeros(DIMS), np.zeros(DIMS), np.zeros(DIMS)
    if not len(y):
        return w
    balance = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for t in range(1, rounds + 1):
        z = np.bincount(doc, w[dim] * value, len(y)) + w[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * balance / 2
        g = np.bincount(dim, miss[doc] * value, DIMS) + ridge * w
        g[-1] = miss.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    """Scorer weights with the labellers' estimated accuracies."""

    def __init__(self, weights, table, prior):
        self.weights, self.table, self.prior = weights, table, prior


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Vote counts over all documents, EM, and the scorer of the sample."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def vote(batches):
        for b in batches:
            parts = [Texts(b.column(1).slice(lo, hi - lo)).votes() for lo, hi in row_slices(b.column(1))]
            codes = np.concatenate(parts) @ (3 ** np.arange(LABELLERS)) if parts else []
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), b.column(0)], ["code", "id"])

    kind = docs.schema[id_col].dataType.simpleString()
    voted = materialise(rows.mapInArrow(vote, f"code long, id {kind}"), "votes")
    count = voted.groupBy("code").count().toArrow()
    codes, counts = count.column(0).to_numpy(), count.column(1).to_numpy().astype(float)
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    post, table, prior = fit_votes(codes[:, None] // 3 ** np.arange(LABELLERS) % 3, counts) if len(codes) else (np.zeros(0), np.full((2, LABELLERS, 2), 0.5), 0.5)
    key = F.xxhash64("id")
    last = least_hashes(voted.select(key.alias("k")), "k", sample, int(counts.sum())).agg(F.max("k")).first()[0]
    if last is None:
        return Model(np.zeros(DIMS), table, prior)

    def train(batches):
        for b in (b.slice(lo, hi - lo) for b in batches for lo, hi in row_slices(b.column(1))):
            texts = Texts(b.column(1))
            codes = texts.votes() @ (3 ** np.arange(LABELLERS))
            doc, dim, value = texts.features()
            cell, at = np.unique(doc * DIMS + dim, return_inverse=True)
            total = np.bincount(at, value, len(cell)) if len(cell) else np.zeros(0)
            lo = np.searchsorted(cell // DIMS, np.arange(len(codes) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array([(cell[a:z] % DIMS).astype(np.int32) for a, z in zip(lo, lo[1:])], pa.list_(pa.int32())), pa.array([total[a:z] for a, z in zip(lo, lo[1:])], pa.list_(pa.float64())), b.column(2)], ["code", "dims", "values", "k"])

    some = rows.withColumn("k", key).where(F.col("k") <= last).mapInArrow(train, "code long, dims array<int>, values array<double>, k long")
    got = some.orderBy("k", "code", "dims").limit(sample).toArrow()
    dims, values = (got.column(k).combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64())) for k in (1, 2))
    doc = np.repeat(np.arange(got.num_rows), dims.value_lengths().to_numpy())
    y = post[np.searchsorted(codes, got.column(0).to_numpy())]
    return Model(fit_scorer(doc, dims.flatten().to_numpy(), values.flatten().to_numpy(), y), table, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with quality_score (probability of KEEP) and quality_keep; one pass, no shuffle.

    Null and wordless texts score by the scorer's constant alone and are kept only if that is enough.
    Columns of docs named like the two new ones are replaced."""
    small_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    docs = docs.drop("quality_score", "quality_keep")
    at = docs.columns.index(text_col)
    schema = docs.select("*", F.lit(0.0).alias("quality_score"), F.lit(True).alias("quality_keep")).schema

    def add(batches):
        for b in batches:
            parts = [Texts(b.column(at).slice(lo, hi - lo)).scores(weights.value) for lo, hi in row_slices(b.column(at))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(s >= threshold)], [*b.schema.names, "quality_score", "quality_keep"])

    return docs.mapInArrow(add, schema)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on docs and score them: docs with quality_score and quality_keep.

    Null, empty, repeated and very long texts and null ids are scored like all others; an empty table
    gives no rows; the same rows give the same scores."""
    return score(docs, fit(docs, id_col, text_col, sample), text_col, threshold)

