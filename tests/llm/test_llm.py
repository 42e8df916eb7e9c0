"""The llm operators against brute force, round trips and held-out labels, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import json
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import _common, chat, decontaminate, embed_dedup, encoding, licenses, line_dedup, mixing, quality, queries, token_counts, token_files
from brindle.llm.jaccard_join import _extra, _in_order, _Region, ngram_jaccard_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def shingle_set(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def docs_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --------------------------------------------------------------------------- shared tools


def test_word_hashes_of_segments(monkeypatch):
    texts = ["", "a b  A", "one two three four five " * 30, " lead", "tail ", "x" * 500, "é à\tb\x0bc"]
    whole = _common.word_hashes(*_common.string_buffers(pa.array(texts)))
    monkeypatch.setattr(_common, "SEGMENT", 64)
    cut = _common.word_hashes(*_common.string_buffers(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert np.diff(whole[1]).tolist() == [len(words(t)) for t in texts]
    assert len(set(whole[0].tolist())) == len({w for t in texts for w in words(t)})


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(12)]
    got = {r.id: r.component for r in _common.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = groups(edges, {x for e in edges for x in e})
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_keep_probable(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    ids = spark.createDataFrame([(k,) for k in range(0, 5000, 100)], "id long")
    got = {r.k for r in _common.keep_probable(df, "k", ids, 50).collect()}
    assert set(range(0, 5000, 100)) <= got and len(got) < 500


# --------------------------------------------------------------------------- 1 quality


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gold = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    rows = quality.classify(docs, sample=400).join(gold, "doc_id").select("quality_keep", "quality").collect()
    lost = sum(not r.quality_keep and r.quality == 1 for r in rows)
    kept = sum(r.quality_keep and r.quality == 0 for r in rows)
    assert lost <= 0.01 * len(rows) and kept <= 0.1 * sum(r.quality == 0 for r in rows)


def test_quality_edges(spark):
    rows = [(1, None, "x"), (None, "the cat and the dog sat on the mat.", "y"), (1, "", "z"), (2, "word " * 60_000, "z"), (3, "!! ## $$ %% ** !!", None)]
    out = quality.classify(docs_frame(spark, rows, ", quality_keep string"))
    assert out.columns.count("quality_keep") == 1 and out.count() == 5
    assert quality.classify(docs_frame(spark, [])).count() == 0
    empty = quality.Texts(pa.array(["", None], pa.string()))
    assert empty.votes().shape == (2, quality.LABELLERS) and (empty.votes() == 0).all()


SYMBOLS = set("#$%&*+/<=>@[\\]^_`{|}~")


def brute_votes(text):
    w = words(text)
    n, solid = len(w), [c for c in text or "" if c not in " \t\n\v\f\r"]
    if not n:
        return [quality.ABSTAIN] * quality.LABELLERS
    symbols, bangs = sum(c in SYMBOLS for c in solid), solid.count("!")
    upper, lower = sum("A" <= c <= "Z" for c in solid), sum("a" <= c <= "z" for c in solid)
    function = sum(x in quality.FUNCTION_WORDS for x in w) / n
    stops, long = solid.count(".") / n, len(solid) / n
    fires = [
        n >= 5 and sum(a == b for a, b in zip(w, w[1:])) / n > 0.15,
        symbols / len(solid) > 0.06,
        upper + lower >= 10 and upper > 0.4 * (upper + lower),
        n >= 5 and w.count("|") / n > 0.15,
        n >= 5 and bangs / n > 0.2,
        n >= 30 and len(set(w)) < 0.25 * n**0.5 + 0.02 * n,
        n >= 5 and (symbols + bangs) / n > 0.5,
    ]
    judge = lambda may, reject, keep: quality.ABSTAIN if not may else quality.REJECT if reject else quality.KEEP if keep else quality.ABSTAIN
    return [judge(True, x, False) for x in fires] + [
        judge(True, False, not any(fires)), judge(n >= 5, long > 14 or long < 1.6, 2.5 < long < 9), judge(n >= 30, stops < 0.003, 0.02 < stops < 0.4), judge(n >= 30, function < 0.03, function > 0.08),
    ]


def test_votes_and_scores_by_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()] + ["", None, " \n", "a | b | c | d", "STOP!! NOW!! é É", "x " * 4000]
    some = quality.Texts(pa.array(texts, pa.string()))
    assert some.votes().tolist() == [brute_votes(t) for t in texts]
    weights = np.random.default_rng(2).normal(size=quality.DIMS)
    doc, dim, value = some.features()
    z = np.full(len(texts), weights[-1])
    for d, k, v in zip(doc.tolist(), dim.tolist(), value.tolist()):
        z[d] += weights[k] * v
    assert np.allclose(some.scores(weights), 1 / (1 + np.exp(-z)))
    assert all(abs(value[doc == d].sum() - 2 * (n > 0)) < 1e-9 for d, n in enumerate(some.n))
    rows = docs_frame(spark, list(enumerate(texts)))
    a, b = ({r.doc_id: r.quality_score for r in quality.classify(x).collect()} for x in (rows, rows.repartition(3)))
    assert a == b  # the same rows, the same scores


def test_vote_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.8
    votes = np.zeros((4000, quality.LABELLERS), int)
    fault = rng.integers(0, 4, 4000)
    for m in range(4):
        votes[(~truth & (fault == m)) | (rng.random(4000) < 0.005), m] = quality.REJECT
    votes[:, quality.DETECTORS] = np.where((votes[:, : quality.DETECTORS] == quality.REJECT).any(axis=1), 0, quality.KEEP)
    votes[:, 8] = np.where(rng.random(4000) < 0.8, np.where(truth, quality.KEEP, quality.REJECT), quality.KEEP)
    u, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table, prior = quality.fit_votes(u, n.astype(float))
    assert abs(prior - truth.mean()) < 0.05 and ((post[inv.reshape(-1)] > 0.5) == truth).mean() > 0.96
    assert table[1, 8, 1] > table[0, 8, 1]


# --------------------------------------------------------------------------- 2 licences


def test_licenses(spark):
    rows = [
        (1, "First line.\nLicensed under the Apache License, Version 2.0.\nend"), (2, "All rights reserved."), (2, "Released under the MIT License."),
        (3, "This work is licensed under the GNU General Public License, version 3."), (None, "Licensed under CC BY-NC 4.0."),
        (4, "You need a fishing license for the lake near the old mill."), (5, None), (6, ""), (7, "nothing here " * 5000), (8, "Licensed under the terms of the Grey Goose agreement of 1831."),
    ]
    got = sorted((r.doc_id or 0, r.paragraph, r.family) for r in licenses.scan(docs_frame(spark, rows)).collect())
    assert got == [(0, 0, "cc-by-nc-4.0"), (1, 1, "apache-2.0"), (2, 0, "mit"), (2, 0, "proprietary"), (3, 0, "gpl-3.0"), (4, 0, "unknown"), (8, 0, "unknown")]


def test_wrapped_licenses(spark):
    import textwrap

    long = [(f, t) for f, t in licenses.TEMPLATES if len(t) > 120]
    rows, want = [], []
    for k, (f, t) in enumerate(long):
        for width in (40, 75):
            d = len(rows)
            body = "\n".join(" * " + x for x in textwrap.wrap(t, width))
            rows.append((d, f"/*\n * A tool to sort apples\n *\n{body}\n *\n */\nint main() {{}}"))
            want.append((d, 3, f, True))
    rows += [(100, "Some words of the day\nPermission\nto land was asked for\n\nPublic\ndomain"), (101, "All rights reserved.\nReleased under the MIT License.\nOur license server is down today.")]
    want += [(100, 4, "unknown", False), (101, 0, "proprietary", True), (101, 1, "mit", True), (101, 2, "unknown", False)]
    got = licenses.scan(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.paragraph, r.family, r.confirmed) for r in got) == sorted(want)


PROBES = ["CC BY 4.0", "SPDX: MIT", "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"]


def test_licenses_without_cues_and_edges(spark):
    """Notices without a cue word, repeated rows, an extra column of a clashing name and an empty table."""
    rows = [(k, f"Some prose of the day.\n{t}\nmore prose", "x") for k, t in enumerate(PROBES)] + [(0, f"Some prose of the day.\n{PROBES[0]}\nmore prose", "x"), (50, "To the extent possible under law, the author has waived\nall copyright and related rights to this work. This work is dedicated to the public domain.", "x")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(docs_frame(spark, rows, ", family string")).collect())
    assert got == [(0, 1, "cc-by-4.0"), (0, 1, "cc-by-4.0"), (1, 1, "mit"), (2, 1, "mit"), (3, 1, "isc"), (50, 0, "cc0")]
    assert licenses.scan(docs_frame(spark, [])).count() == 0


def test_licenses_planted_recall(spark):
    """Notices cut at either end and wrapped at random widths, among prose of the corpus."""
    import textwrap

    rng = np.random.default_rng(8)
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) between 200 and 3000").orderBy("doc_id").limit(120).collect()]
    rows, want = [], []
    for k, text in enumerate(prose):
        family, notice = licenses.TEMPLATES[k % len(licenses.TEMPLATES)]
        w = notice.split()
        if len(w) > 12:
            w = w[int(rng.integers(0, len(w) // 6)) :]
        body = "\n".join(textwrap.wrap(" ".join(w), int(rng.integers(35, 90))))
        rows.append((k, f"{text}\n\n{body}\n\nend"))
        want.append((k, family))
    got = {(r.doc_id, r.family) for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert sum(x in got for x in want) >= 0.9 * len(want)


# --------------------------------------------------------------------------- 3 decontamination


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            if not v:
                continue
            n = min(5, len(v))
            target = Counter(tuple(v[k : k + n]) for k in range(len(v) - n + 1))
            size = min(len(v), len(w))
            best = None
            for s in range(len(w) - size + 1):
                win = w[s : s + size]
                here = Counter(tuple(win[k : k + n]) for k in range(len(win) - n + 1))
                both = (here & target).total()
                most = (here | target).total()
                if most and both * 4 >= most * 3 and (best is None or both / most > best[0]):
                    best = (both / most, s)
            if best:
                out[d, i] = best
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate((3, 12, 14, 20, 30, 37, 59))] + [(99, ""), (98, "a a a a a a a a a a")]
    docs = []
    for d in range(60):
        body = list(rng.choice(vocab, 80))
        i = items[d % 7][1].split()
        if d % 4 == 1:
            i = [*i[: len(i) // 2], "edit", *i[len(i) // 2 :]]
        if d % 4 == 2:
            i = [w.upper() for w in i][: max(1, len(i) - 1)]
        docs.append((d, " ".join(body[:30] + i + body[30:]) if d % 5 else " ".join(i)))
    docs += [(100, None), (101, ""), (102, "a " * 200), (103, items[4][1] + " " + "long " * 60_000)]
    df = docs_frame(spark, docs, "").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([*items, (None, "x"), (5, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.word_at) for r in decontaminate.find_leaks(df.drop("item_id"), it).collect()}
    want = brute_leaks([d for d in docs if d[0] != 103], items)
    assert {k: v for k, v in got.items() if k[0] != 103} == want and got[103, 4] == (1.0, 0)
    clean = {r.doc_id for r in decontaminate.decontaminate(df, it).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df.limit(0), it).count() == 0 and decontaminate.find_leaks(df, it.limit(0)).count() == 0


def test_decontamination_of_repeated_shingles(spark):
    rng = np.random.default_rng(12)
    items, docs = [], []
    for k, (n, cut) in enumerate([(100, 12), (100, 12), (200, 26), (200, 26), (400, 55)]):
        item = [f"i{k}w{j}" for j in range(n)]
        if k % 2:  # blanks of its own at the end
            item[-cut // 2 :] = ["____"] * len(item[-cut // 2 :])
        copy = [*item[:-cut], *["[MASK]"] * cut]
        items.append((k, " ".join(item)))
        docs += [(2 * k, " ".join(copy)), (2 * k + 1, " ".join([*rng.choice(["p", "q"], 30), *copy, *["[MASK]"] * 9, "end"]))]
    got = {(r.doc_id, r.item_id): (r.similarity, r.word_at) for r in decontaminate.find_leaks(docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert got == want and len(want) >= 8


def test_window_sums_count_occurrences():
    sh = np.random.default_rng(13).integers(0, 6, 60, dtype=np.uint64)
    for m in (1, 7, 60):
        got = decontaminate.window_sums(sh, decontaminate.Occurrences(sh), 0, 61 - m, m)
        for s in range(61 - m):
            win = sh[s : s + m]
            k = np.array([(win[: j + 1] == x).sum() for j, x in enumerate(win)])
            assert (got[s] == decontaminate.signs(decontaminate.elements(win, k)).sum(axis=0, dtype=np.int32)).all()


def test_multi_index_guarantee():
    rng = np.random.default_rng(5)
    items = [(k, rng.integers(0, 1 << 64, 30, dtype=np.uint64)) for k in range(20)]
    index = decontaminate.ItemIndex(items, 40)
    for _ in range(50):
        k, flips = int(rng.integers(20)), rng.choice(256, 40, replace=False)
        bits = np.unpackbits(index.prints[k].view(np.uint8))
        bits[flips] ^= 1
        w, i = index.candidates(np.packbits(bits).view(np.uint64)[None])
        assert k in i.tolist()
    # few chance pairs get past the blocks
    a, b = rng.integers(0, 1 << 64, (2, 20_000, decontaminate.LANES), dtype=np.uint64)
    near = np.bitwise_count(a ^ b) <= decontaminate.RADIUS // decontaminate.LANES
    assert near.any(axis=1).mean() < 0.05


# --------------------------------------------------------------------------- 4 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 16))
    rows = [(k, [float(np.float32(x)) for x in base[k % 30] + rng.normal(size=16) * (0.02 if k % 3 else 0.12)]) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(20)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [float("inf")] * 16), (None, rows[5][1]), (2006, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, sample=120).collect()}
    x = np.array([v for _, v in rows])
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    ids = [k for k, _ in rows]
    comp = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(cos >= 0.95)) if a < b], ids)
    assert {k: got[k] for k in ids} == {i: (int((cos[n] >= 0.95).sum()) - 1, comp[i], comp[i] == i) for n, i in enumerate(ids)}
    assert got[None] == (0, None, False) and all(got[k] == (0, k, True) for k in range(2000, 2007))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_low_intrinsic_dimension(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4)) @ rng.normal(size=(4, 256))
    x = np.concatenate((x, x[:100], 3 * x[:50]))  # equal vectors, and equal directions
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    want = {k: int(n) - 1 for k, n in enumerate(links.sum(axis=1))}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    assert {k: n for k, (n, _) in got.items()} == want
    assert {k: c for k, (_, c) in got.items()} == groups([(a, b) for a, b in zip(*np.nonzero(links)) if a < b], list(want))


def test_tables_are_no_longer_than_lists():
    """On vectors without structure a subspace's table has no more entries than it gives distances, and no link is lost."""
    for total in (1, 300, 10_000, 50_000, 1_000_000, 10_000_000):
        cells, codes = embed_dedup.sizes(total)
        assert cells <= embed_dedup.MAX_CELLS and embed_dedup.LEAST_CODES <= codes <= embed_dedup.CODES
        assert codes <= max(embed_dedup.LEAST_CODES, total / cells / 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 32))
    x[2000:2200] = x[:200] + rng.normal(size=(200, 32)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells, codes = embed_dedup.sizes(len(x))
    index, r = embed_dedup.Index(x, cells, codes=codes), 0.1**0.5
    cell, code, err = index.encode(x)
    radii = np.array([np.sqrt(((x[cell == c] - index.centroids[c]) ** 2).sum(axis=1)).max(initial=-np.inf) for c in range(cells)])
    hit, seen = index.probes(x, cell, radii, r), set()
    entries = given = 0
    for c in range(cells):
        q, held = np.flatnonzero(hit[:, c]), np.flatnonzero(cell == c)
        entries, given = entries + len(q) * codes, given + len(q) * len(held)
        i, j = np.nonzero(index.distances2(x[q], c, code[held]) <= (r + err[held] + 1e-6) ** 2 + 1e-6)
        seen |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(q[i], held[j]) if a != b}
    assert entries <= given
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(x @ x.T >= 0.95)) if a < b} <= seen


# --------------------------------------------------------------------------- 5 Jaccard join


def test_jaccard_join(spark):
    rng = np.random.default_rng(9)
    vocab = [f"v{k}" for k in range(300)]
    rows = []
    for g in range(12):
        body = list(rng.choice(vocab, int(rng.integers(4, 120))))
        for c in range(14):
            t = list(body)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = f"x{rng.integers(9)}"
            rows.append((len(rows), " ".join(t[: len(t) - int(rng.integers(0, 8)) or None])))
    rows += [(900, None), (901, " \n"), (902, "one two"), (903, "ONE  two"), (904, "z " * 30_000), (905, "z " * 6)]
    shared = " ".join(rng.choice(vocab, 60))
    rows += [(1000 + k, shared + " " + " ".join(rng.choice(vocab, 50))) for k in range(40)]
    sets = {d: shingle_set(t) for d, t in rows}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {d: (len(sets[d]), c) for d, c in groups(links, ids).items()}
    df = docs_frame(spark, [(*r, 1) for r in rows], ", component_id int")
    got = ngram_jaccard_join(df)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert ngram_jaccard_join(df.limit(0)).count() == 0
    again = docs_frame(spark, [(7, "a b c d e f"), (7, "other text of some words here"), (None, "a b c d e f"), (9, "A b c d e f")])
    assert sorted(((r.doc_id or -1), (r.component_id or -1)) for r in ngram_jaccard_join(again).collect()) == [(-1, -1), (7, 7), (7, 7), (9, 7)]


@pytest.mark.parametrize(("block", "levels"), [(1 << 20, 3), (300, 3), (60, 2), (60, 1)])
def test_jaccard_regions_split_exactly(spark, block, levels):
    """Groups whose members lie around the radius of each other, in one region or in many small ones."""
    rng = np.random.default_rng(31)
    rows = []
    for size, change in ((60, 5), (40, 3), (30, 4)):
        body = [f"b{size}w{k}" for k in range(110)]
        for _ in range(size):
            t = list(body)
            for at in rng.choice(len(t), int(rng.integers(0, change)), replace=False):
                t[int(at)] = f"n{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(t[int(rng.integers(0, 6)) :])))
    sets = {d: shingle_set(t) for d, t in rows}
    links = [(a, b) for a in sets for b in range(a + 1, len(rows)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(links, list(sets))
    assert 3 < len(set(want.values())) < len(rows)
    got = ngram_jaccard_join(docs_frame(spark, rows), block=block, levels=levels)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_lonely_points_have_no_partner():
    """Of linked sets, each shares max(1, n // 8) of its first shingles with the first ones of the other."""
    rng = np.random.default_rng(3)
    for _ in range(4000):
        n = int(rng.integers(1, 60))
        m = int(rng.integers(-(-3 * n // 4), 4 * n // 3 + 1))
        least = -(-75 * (n + m) // 175)
        both = int(rng.integers(least, max(least, min(n, m)) + 1))
        if both > min(n, m):
            continue
        every = rng.permutation(np.arange(n + m - both, dtype=np.uint64))
        often = np.sort(rng.choice(every, len(every) // 3, replace=False))
        firsts = []
        for s in (every[:n], np.concatenate((every[:both], every[n:]))):
            s, rare = _in_order(np.sort(s), often)
            firsts.append((set(s[: len(s) - -(-75 * len(s) // 100) + _extra(len(s))].tolist()), len(s)))
        (a, n), (b, m) = firsts
        assert len(a & b) >= max(1, n // 8, m // 8)


def test_region_links():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, int(rng.integers(1, 60)))) for _ in range(80)]
    gap = lambda a, b: 1 - len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    region = _Region([(k, gap(s, sets[0]), k, s) for k, s in enumerate(sets)])
    for k, s in enumerate(sets):
        got = sorted(region.h[region.links(gap(s, sets[0]), k, s, 0.5, 1, 2)].tolist())
        assert got == [j for j, t in enumerate(sets) if j != k and gap(s, t) <= 0.5]


# --------------------------------------------------------------------------- 6, 7 token files

TEXTS = ["", " ", "a", " a", "a  b", "a\n\nb", "a \n b", "x\ty \tz", "it's <|endoftext|> we'll", "<|endoftext|>", "é 日本 語\n한국", "1 2 3", "tail ", "\x1c q\x85r", "w" * 40_000, "so long " * 9000]


def test_encoder_is_the_library():
    for special in (False, True):
        e = encoding.PieceEncoder(queries.vocabulary(), special)
        want = [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
        assert e.encode(TEXTS) == want and e.encode(TEXTS) == want


def test_a_word_is_encoded_once_whatever_follows():
    e, given = encoding.PieceEncoder(queries.vocabulary()), []

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **how):
            given.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

        def tokenize(self, word):
            given.append(word)
            return self.inner.tokenize(word)

    words = [a + b + c for a in "BcdfG" for b in ("aeu", "ié", "oß") for c in "lmnrst"]
    text = " ".join(w + tail for tail in ("", ".", ",", "...", "!?", ".%%%") for w in words)
    want = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids, e.dtype).tobytes()
    e.tokenizer, e.model = Spy(e.tokenizer), Spy(e.tokenizer.model)
    assert e.encode([text]) == [want]
    assert sum(map(len, given)) <= 2 * sum(len(w) + 1 for w in words)


def test_words_and_their_ends(tmp_path):
    """Random texts, and a vocabulary with an added token that may lie in a word."""
    rng = np.random.default_rng(4)
    some = ["a", "Zab", "é", "ª", "×", "ɐ", "ǅ", "中", "²", "_", "'", "'s", "’", ".", ",", "<|", "<|endoftext|>", "\n", "\t", "1", "e\u0301", *" " * 8]
    texts = ["".join(rng.choice(some, int(rng.integers(1, 40)))) for _ in range(4000)]
    added = encoding.PieceEncoder(queries.vocabulary()).tokenizer
    added.add_tokens(["ab"])
    added.save(str(tmp_path / "added.json"))
    for path, by_word in ((queries.vocabulary(), True), (str(tmp_path / "added.json"), False)):
        e = encoding.PieceEncoder(path, keep=300)
        assert e.by_word == by_word
        want = [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x for lo in range(0, len(texts), 100) for x in e.encode(texts[lo : lo + 100])] == want


def test_python_handles_new_parts_only():
    """Parts that repeat are no Python objects, and known parts are those used most."""
    e = encoding.PieceEncoder(queries.vocabulary(), keep=40)
    words = [a + b for a in ("no", "Mi", "été", "x1") for b in ("ra", "pe.", "tu,", "ß")]
    once, often = [" ".join(words)], [" ".join(words * 400)] * 3
    e.encode(once)
    want = [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch(often, add_special_tokens=False)]
    tracemalloc.start()
    assert e.encode(often) == want
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 40 * 3 * 400 * len(words)  # a str in a list is more than 50 bytes
    # what is used again and again stays, what came once goes; a part is as long as it needs to be
    many = [" ".join(f"{w}{c}{d}" for c in "abcdefg" for d in "hijkl") for w in words[:4]]
    for t in many:
        e.encode([t, *once])
        assert len(e.names) <= 2 * e.keep + 35 + len(words) and len(e.names) == len(e.ids) == len(e.uses) == len(set(e.names.to_pylist()))
    e._forget()
    assert len(e.names) == e.keep and {"nope", "Mitu", "étéß", "x1ra"} <= set(e.names.to_pylist())
    long = ["".join(chr(0x4E00 + 100 * k + j % 97) for j in range(4000)) for k in range(5)]
    assert all(e.encode([t]) == [np.array(e.tokenizer.encode(t).ids, e.dtype).tobytes()] and e.names.nbytes < 3 * 13_000 for t in long) and e.encode([]) == []


def test_lots():
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"i": i, "t": t} for i, t in rows], pa.schema([("i", pa.int64()), ("t", pa.string())]))
    rows = [(1, "a" * 50), (None, None), (3, "b" * 500), (4, ""), (5, "c"), (5, "d")]
    got = list(encoding.lots([batch(*rows[:2]), batch(), batch(*rows[2:])], 120))
    assert [(i, t) for ids, texts in got for i, t in zip(ids, texts, strict=True)] == [(i, t or "") for i, t in rows]
    assert [len(ids) for ids, _ in got] == [2, 1, 3] and list(encoding.lots([], 9)) == []


@pytest.mark.parametrize("n", [0, 1, 3, 1023, 1024, 1025, 9000])
def test_pack_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 60, 40_000, 1 << 32):
        v = rng.integers(0, top, n)
        v[n // 3 : n // 2] = 0
        w, at, esc, esc_at = token_files.pack(v)
        assert (token_files.unpack(w, at, esc, esc_at, n) == v).all()
        assert all((token_files.unpack(w, at, esc, esc_at, n, only=k) == v[1024 * k : 1024 * (k + 1)]).all() for k in range(len(at) - 1))


def test_token_files(spark, tmp_path):
    rows = [(50 - k, t, "x") for k, t in enumerate(TEXTS)] + [(3, None, "y"), (3, "twice", "y"), (None, "no id", "z")]
    df = docs_frame(spark, rows, ", start string").repartition(3)
    token_files.write_token_files(df, f"file://{tmp_path}/t", queries.vocabulary(), 2)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    e = encoding.PieceEncoder(queries.vocabulary())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (i, t, _) in zip(got, order, strict=True):
        ids = [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    crc = {r.start: r.ids_crc32 for r in token_files.digest(token_files.read_token_files(spark, f"file://{tmp_path}/t")).collect()}
    assert all(crc[r.start] == zlib.crc32(r.ids) for r in got)
    short = token_files.read_token_files(spark, f"file://{tmp_path}/t", digests=True)
    assert short.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and {r.start: r.ids_crc32 for r in short.collect()} == crc
    token_files.write_token_files(df.limit(0), f"file://{tmp_path}/e", queries.vocabulary(), 2)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_token_counts(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(100, None), (None, "no id")]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs_frame(spark, rows).repartition(2), f"file://{tmp_path}/f", queries.vocabulary(), 50256).collect()}
    e = encoding.PieceEncoder(queries.vocabulary(), True)
    assert got == {i: len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_separator_scan_stitches_blocks(spark):
    flat = [9, 1, 1, 9, 9, 2, 2, 2, 2, 2, 9, 3]
    for size in (1, 2, 3, 5, 20):
        blocks = [(0, k, 2, bytearray(np.array(flat[k * size : (k + 1) * size], "<u2").tobytes())) for k in range(-(-len(flat) // size))]
        df = spark.createDataFrame(blocks, "file int, number long, width int, ids binary")
        assert [r.n_tokens for r in token_counts.separator_scan(df, 9).orderBy("ordinal").collect()] == [0, 2, 0, 5, 1]


# --------------------------------------------------------------------------- 8 mixing


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(rng.integers(0, 400)), str(rng.choice(["a", "b", "c", "é", "Z"], p=[0.6, 0.1, 0.1, 0.1, 0.1]))) for k in range(400)]
    rows += [(900, None, "a"), (901, "x y z", None), (901, "x y", None), (None, "q " * 30, "b"), (902, "n " * 20_000, "c")]
    df = docs_frame(spark, rows, ", source string")
    got = mixing.mix(df)[0].collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.discard(s)
        if not open_:
            break
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 3 * mixing.BLOCK_WORDS for s in order)
    again = mixing.mix(df.repartition(7))[0].collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    text = mixing.mixed_texts(df.withColumn("slot", F.lit(1)))
    assert sum(len(words(r.text)) for r in text.collect()) == sum(taken.values()) and text.columns == ["doc_id", "text", "source", "slot"]
    assert mixing.mix(df.limit(0))[0].count() == 0


# --------------------------------------------------------------------------- 9 line dedup


def brute_lines(rows, least):
    lines = {(d, t): t.split("\n") for d, t in rows if t is not None}
    count = {k: [len(words(x)) for x in v] for k, v in lines.items()}
    seen, gone = set(), {k: set() for k in lines}
    # every run of at least `least` words that occurred at an earlier (document, line)
    for k in sorted(lines, key=lambda k: k[0]):
        v = lines[k]
        for a in range(len(v)):
            run, n = (), 0
            for b in range(a, len(v)):
                run, n = (*run, v[b]), n + count[k][b]
                if n >= least and run in seen:
                    gone[k] |= set(range(a, b + 1))
            run, n = (), 0
            for b in range(a, len(v)):
                run, n = (*run, v[b]), n + count[k][b]
                if n >= least:
                    seen.add(run)
    return {k: "\n".join(x for n, x in enumerate(v) if n not in gone[k]) for k, v in lines.items()}


def test_line_dedup(spark):
    rng = np.random.default_rng(6)
    pool = [" ".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(0, 9, 12)]
    rows = [(k, "\n".join(rng.choice(pool, int(rng.integers(1, 25))))) for k in range(40)]
    block = "\n".join(pool[:6])
    rows += [(100, "head\n" + block + "\ntail"), (101, block), (102, "x\n" + block), (103, ""), (104, "one\n" * 40)]
    df = docs_frame(spark, [*[(*r, "c") for r in rows], (105, None, "c")], ", n_lines string")
    out = line_dedup.dedup_lines(df, min_words=12)
    got = {r.doc_id: (r.text, r.n_lines) for r in out.collect()}
    want = brute_lines(rows, 12)
    assert {d: got[d][0] for d, _ in rows} == {d: t for (d, _), t in want.items()}
    assert got[105] == (None, 0) and got[103] == ("", 1) and out.columns.count("n_lines") == 1
    long = " ".join(f"p{k}" for k in range(55))
    pair = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs_frame(spark, [(None, long + "\nmine"), (1, "own\n" + long), (1, "own\n" + long)])).collect()}
    assert pair == {None: long + "\nmine", 1: "own"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- 10 chats


@pytest.mark.parametrize("text", ["", "plain", "</turn>", "### x: ", "\\### Assistant: </turn> ok", "\\", "\\\\</turn>\\", "####</turn></turn>", " </turn>\n### a: b </turn>\n", "a\nb"])
def test_turn_round_trip(text):
    a, lo, hi = chat.render("user", text)
    b, _, _ = chat.render("odd: ### \\role", text)
    assert list(chat.parse(a + b)) == [("user", text), ("odd: ### \\role", text)] and chat.unescape(a[lo:hi]) == text
    with pytest.raises(ValueError):
        list(chat.parse(a + "rest"))


def test_layouts(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}),
        (2, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}),
        (3, {"prompt": "hi", "completion": "yo"}), (4, {"output": "yo", "instruction": "hi", "input": "there"}),
        (5, {"answer": "yo", "question": "hi", "system": "be"}), (6, {"unknown": 1}),
    ]
    df = spark.createDataFrame([*[(k, json.dumps(r)) for k, r in records], (7, None), (8, "{broken"), (9, '{"messages": []}')], "conv_id long, record string")
    got = {}
    for r in chat.to_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    chat2 = [("user", "hi"), ("assistant", "yo")]
    assert got == {1: chat2, 2: chat2, 3: chat2, 4: [("user", "hi\nthere"), ("assistant", "yo")], 5: [("system", "be"), *chat2], 6: [(None, None)], 7: [(None, None)], 8: [(None, None)], 9: [(None, None)]}
    assert chat.fingerprint(["a", "b[].c"]) == chat.fingerprint(["b[].c", "a"]) != chat.fingerprint(["a"])


def test_layouts_with_further_fields_and_unknown_ones(spark):
    records = [
        (1, {"messages": [{"role": "user", "content": "hi", "name": "x"}, {"content": None, "role": "bot"}], "id": 4}),
        (2, {"weird": "lost text"}), (3, {"turn": 0, "role": "Assistant", "text": "a", "at": {"x": []}}), (3, {"turn": 1, "role": "assistant", "text": "b" * 70_000}), (1, {"weird": ""}),
    ]
    turns = chat.to_turns(spark.createDataFrame([(k, json.dumps(r), "x") for k, r in records], "conv_id long, record string, text string"))
    assert sorted(r.conv_id for r in chat.unread(turns).collect()) == [1, 2]
    parts = chat.format_chats(turns).collect()
    assert sorted(p.conv_id for p in parts) == [1, 3] and "lost" not in str(parts)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 0 and got[3].n_turns == 2 and got[3].loss_chars == 70_000
    assert chat.to_turns(spark.createDataFrame([], "conv_id long, record string")).count() == 0


def test_tables_of_each_layout_are_their_records(spark):
    talk = "array<struct<{}:string,{}:string>>"
    tables = [
        ("turn long, role string, text string, extra int", [(0, "user", None, 1), (1, None, "x", None)]),
        ("messages " + talk.format("role", "content"), [([("human", "hi"), ("assistant", None)],)]),
        ("conversations " + talk.format("from", "value"), [([("human", "hi"), (" GPT", "yo"), ("other", "z")],)]),
        ("prompt string, completion string", [("p", "c"), ("", "c")]),
        ("instruction string, input string, output string", [("i", "j", "o"), ("i", "", "o")]),
        ("system string, question string, answer string", [("s", "q", "a")]),
    ]
    for schema, rows in tables:
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "conv_id long, " + schema)
        records = df.select("conv_id", F.to_json(F.struct(*df.columns[1:]), {"ignoreNullFields": "false"}).alias("record"))
        row = lambda d: sorted((r.conv_id, r.turn, r.role, r.text, r.layout) for r in d.collect())
        assert row(chat.table_turns(df)) == row(chat.to_turns(records))
    empty = spark.createDataFrame([(1, None), (2, [])], "conv_id long, messages " + talk.format("role", "content"))
    assert sorted(r.conv_id for r in chat.unread(chat.table_turns(empty)).collect()) == [1, 2]
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1, "x")], "conv_id long, weird string"))


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    rows = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x" * 9000), (None, 0, "system", "é"), (1, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    said = [("user", ""), ("assistant", "a"), ("assistant", "b</turn>"), ("assistant", "")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256, got[1].n_turns) == (9, hashlib.sha256(b"ab</turn>").hexdigest(), 4)
    assert got[2].loss_chars == 0 and got[None].n_turns == 1
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


# --------------------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    plain = lambda d: sorted(tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert sorted(got.columns) == cols and plain(got) == plain(want)


def test_near_duplicates_of_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = ("".join(f"{x}{k} " for k in range(40)) for x in "abc")
    rows = [(1, a), (2, a + "more"), (2, b), (3, c), (3, c), (4, c + "more"), (None, a), (5, None)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(*r, "en", "s", 1) for r in rows], DOCS), SF)
    assert sorted((r.doc_id or 0, r.text) for r in got.where("text is not null").collect()) == sorted([(0, a), (1, a), (2, b), (3, c)])
    assert [r.doc_id for r in got.where("text is null").collect()] == [5]


ODD = [(1, "a word " * 300, "en", "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0), (2, "", "en", None, 0), (2, "other words of a text that is here", "en", None, 0), (3, "one two three four five six " * 20_000, "en", "t", 9), (3, "one two three four five six " * 20_000, "en", "t", 9), (4, " \n", "en", "t", 2)]


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_with_odd_rows(spark, stage):
    import corpus_pipeline

    name, f = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame([(*r, "x") for r in ODD], DOCS + ", quality_keep string")
    got = f(spark, docs, SF).collect()
    text = lambda rows: sorted((r[0] or -1, r[1] or "") for r in rows)
    if stage == 0:
        assert set(text(got)) <= set(text(ODD))
    if stage == 1:  # one of the two repeated rows goes
        want = text(ODD)
        want.remove((3, ODD[5][1]))
        assert text(got) == want
    if stage == 2:
        assert text(got) == text(ODD)
    if stage == 3:
        plain = Counter(t for _, t in text(ODD))
        assert all(any(t.strip().startswith(r.text.strip()[:20]) for t in plain) and words(r.text) for r in got) and {r.source for r in got} <= {"s", "t", None}
    if stage == 4:
        enc = encoding.PieceEncoder(queries.vocabulary(), False).tokenizer
        ids = [np.array([*enc.encode(t or "", add_special_tokens=False).ids, queries.END_ID], "<u4").tobytes() for _, t, *_ in ODD]
        assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((o[0] or -1, len(x) // 4, zlib.crc32(x)) for o, x in zip(ODD, ids))
        starts = sorted((r.start, r.n_tokens) for r in got)
        assert [s for s, _ in starts] == list(np.cumsum([0, *[n for _, n in starts[:-1]]]))
    assert f(spark, docs.limit(0), SF).count() == 0
    if stage < 4:
        assert tuple(f(spark, docs, SF).columns) == corpus_pipeline.COLUMNS


def test_mixture_keeps_sources_apart(spark):
    rows = [(1, "a b c d", "en", s, 7) for s in ("x", "y", None)] + [(2, "e f", "en", "x", 3), (2, "e f", "de", "x", 3)]
    docs = spark.createDataFrame(rows, DOCS)
    pick = lambda d: sorted((r.source or "", r.doc_id, r.text, r.lang) for r in mixing.mixed_texts(d, block_words=1).collect())
    got = pick(docs)
    assert {s for s, *_ in got} == {"x", "y", ""} and got == pick(docs.repartition(5))


def test_token_counts_with_odd_rows(spark, tmp_path):
    rows = [(None, None, 1), (None, "a b", 1), (5, "a b", 1), (5, "a b", 1), (6, "", 1)]
    got = token_counts.count_tokens(docs_frame(spark, rows, ", n_tokens int"), str(tmp_path / "a"), queries.vocabulary(), queries.END_OF_TEXT)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got.collect()) == [(-1, 0), (-1, 2), (5, 2), (5, 2), (6, 0)]
    assert token_counts.count_tokens(docs_frame(spark, []), str(tmp_path / "b"), queries.vocabulary(), queries.END_OF_TEXT).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.quality_filter(spark, docs, SF).cache()
    one = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    sets = {r.doc_id: shingle_set(r.text) for r in kept.collect()}
    ids = sorted(sets)
    comp = groups([(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])], ids)
    assert {r.doc_id for r in one.collect()} == set(comp.values()) and one.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, one, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [(set(zip(*[words(t)[k:] for k in range(5)])), len(words(t))) for _, t in items]
    whole = {r.doc_id for r in one.collect() if any(g <= shingle_set(r.text) for g, _ in grams)}
    assert {r.doc_id for r in one.collect()} - {r.doc_id for r in clean.collect()} == whole
    mixed = corpus_pipeline.mixture(spark, clean, SF)
    assert mixed.columns == docs.columns
    last = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [r.start for r in last] == [sum(x.n_tokens for x in last[:k]) for k in range(len(last))] and [r.doc_id for r in last] == sorted(r.doc_id for r in last)
    assert len(last) == mixed.count()
