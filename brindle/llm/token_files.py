"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits with as many ids as the selector says.  Ids that do
not fit ESCAPE_BITS are coded as the escape value and kept in a separate list, so that 4 ids of a
16-bit vocabulary fit a word.  Blocks of BLOCK ids start on a word; a chunk (one row of the file)
holds the words of whole documents, the word offset and escape offset of each block, and the
documents' ids and lengths.  The file is a Parquet folder that Spark writes and commits, so any store
and lost executors are fine; `shard` numbers its parts in ascending order of document id."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import CACHE_LIMIT, encoder, lots, slices

#: Ids a word and bits an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
ESCAPE_BITS = 15
CHUNK_IDS = 1 << 16
SCHEMA = "shard int, chunk int, first long, n_ids long, words binary, word_at array<int>, escapes binary, escape_at array<int>, doc_ids array<long>, doc_lens array<long>"


@functools.cache
def _bits_table(escape_bits: int) -> np.ndarray:
    return np.array([k.bit_length() for k in range(1 << escape_bits)], np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK, escape_bits: int = ESCAPE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset by block, escapes, escape offset by block) of an array of ids < 2**32."""
    ids = np.asarray(ids)
    n, mark = len(ids), (1 << escape_bits) - 1
    blocks = -(-n // block)
    high = ids >= mark
    escapes = ids[high].astype("<u4")
    escape_at = np.concatenate(([0], np.cumsum(high)))[np.minimum(np.arange(blocks + 1) * block, n)]
    v = np.minimum(ids, mark).astype(np.uint32)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(1, np.int64), escapes, escape_at
    # bits of each id, a block a row; what lies behind a block counts as 0 bits
    wide = np.zeros((blocks, block + int(COUNTS[0])), np.uint8)
    need = np.zeros(blocks * block, np.uint8)
    need[:n] = _bits_table(escape_bits)[v]
    wide[:, :block] = need.reshape(blocks, block)
    choice = np.full((blocks, block), len(COUNTS) - 1, np.uint8)
    rows, tops, c = np.arange(blocks), wide, 1  # tops[:, i]: most bits among c ids from i on
    for s in range(len(COUNTS) - 2, -1, -1):  # the last that fits packs most
        more = int(COUNTS[s]) - c
        tops, c = np.maximum(tops[:, :-more], tops[:, more:]), c + more
        fits = tops[:, :block] <= np.uint8(BITS[s])
        some = fits.any(axis=1)
        if not some.all():  # blocks that fit none of this count fit no larger one
            rows, tops, fits = rows[some], tops[some], fits[some]
        if not len(rows):
            break
        if len(rows) == blocks:
            np.copyto(choice, np.uint8(s), where=fits)
        else:
            held = choice[rows]
            np.copyto(held, np.uint8(s), where=fits)
            choice[rows] = held
    choice = choice.reshape(-1)
    take = np.append(COUNTS[choice], 0)
    pos, stop = np.arange(blocks) * block, np.minimum(np.arange(1, blocks + 1) * block, n)
    starts = [pos]
    while True:  # all blocks step from word to word together; those that have ended wait
        pos = np.minimum(pos + take[pos], stop)
        starts.append(pos)
        if len(starts) % 16 == 0 and (pos == stop).all():
            break
    starts = np.stack(starts, axis=1)
    start = starts[starts < stop[:, None]]
    sel = choice[start]
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.zeros((blocks, block + int(COUNTS[0])), np.uint64)  # zeros behind each block
    whole = n // block
    padded[:whole, :block] = v[: whole * block].reshape(whole, block)
    padded[whole:, : n - whole * block] = v[whole * block :]
    padded, place = padded.reshape(-1), start + start // block * int(COUNTS[0])
    for s in np.unique(sel):
        if BITS[s] == 0:
            continue
        rows = np.flatnonzero(sel == s)
        at, word = place[rows], words[rows]
        for k in range(COUNTS[s]):
            word |= padded[at + k] << np.uint64(k * BITS[s])
        words[rows] = word
    word_at = np.searchsorted(start, np.minimum(np.arange(blocks + 1) * block, n))
    return words.astype("<u8"), word_at, escapes, escape_at


def unpack(words: np.ndarray, word_at: np.ndarray, escapes: np.ndarray, escape_at: np.ndarray, n: int, block: int = BLOCK, escape_bits: int = ESCAPE_BITS, only: int | None = None) -> np.ndarray:
    """The ids again, or those of block `only`, found by its offsets; all words at once."""
    if only is not None:
        words, escapes = words[word_at[only] : word_at[only + 1]], escapes[escape_at[only] : escape_at[only + 1]]
        n, word_at = min(block, n - only * block), np.array([0, len(words)])
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    # the last word of a block may be part empty: what it holds is what the block still lacks
    before = np.concatenate(([0], np.cumsum(count)))
    blocks = len(word_at) - 1
    full = np.minimum(np.arange(1, blocks + 1) * block, n) - np.arange(blocks) * block
    if blocks:
        last = np.asarray(word_at[1:]) - 1
        count = count.copy()
        count[last] -= before[np.asarray(word_at[1:])] - before[np.asarray(word_at[:-1])] - full
    at = np.concatenate(([0], np.cumsum(count)))[:-1]
    out = np.zeros(n + COUNTS[0], np.uint64)
    order = {}
    for s in np.unique(sel):
        if BITS[s]:
            order[s] = np.flatnonzero(sel == s)
    for s, rows in order.items():
        vals = (words[rows, None] >> (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        keep = np.arange(COUNTS[s]) < count[rows, None]
        out[(at[rows, None] + np.arange(COUNTS[s]))[keep]] = vals[keep]
    out = out[:n].astype("<u4")
    out[out == (1 << escape_bits) - 1] = escapes
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: int = CACHE_LIMIT) -> None:
    """Encode whole texts, append end_id to each, and write them to `path` in ascending id order.

    Null text: only the end id.  Null ids come first, repeated ids in order of their text (null
    first).  An empty table writes an empty file.  Memory is bounded by a lot of texts or the longest text,
    and by the encoder's `keep` parts."""
    if docs.schema[id_col].dataType.simpleString() != "bigint":
        docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).repartitionByRange("id").sortWithinPartitions("id", "t")

    def encode(batches):
        enc, shard, chunk, first = encoder(tokenizer, keep=keep), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], enc.dtype).tobytes()
        for ids, texts in lots(batches):
            coded = [x + end for x in enc.encode(texts)]
            lens = [len(x) // enc.dtype.itemsize for x in coded]
            for lo, hi in slices(lens, CHUNK_IDS):
                flat = np.frombuffer(b"".join(coded[lo:hi]), enc.dtype)
                words, word_at, esc, esc_at = pack(flat)
                row = dict(shard=[shard], chunk=[chunk], first=[first], n_ids=[len(flat)], words=[words.tobytes()], word_at=[word_at], escapes=[esc.tobytes()], escape_at=[esc_at], doc_ids=[ids[lo:hi]], doc_lens=[lens[lo:hi]])
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds)], list(row))
                chunk, first = chunk + 1, first + len(flat)

    rows.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark, path: str, digests: bool = False) -> DataFrame:
    """One row per document of a token file: doc_id, start, n_tokens, ids (little-endian uint32), or with
    digests ids_crc32 of these, taken where a chunk is decoded, so that the ids stay there.

    start counts the ids of all documents before; shards are prefix-summed, chunks hold their own
    place.  Chunks are decoded independently."""
    name, kind, of = ("ids_crc32", pa.int64(), zlib.crc32) if digests else ("ids", pa.binary(), bytes)
    raw = spark.read.schema(SCHEMA).parquet(path)
    total = raw.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = total.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.array(r["word_at"]), np.frombuffer(r["escapes"], "<u4"), np.array(r["escape_at"]), r["n_ids"])
                lens = np.array(r["doc_lens"], np.int64)
                stop = np.cumsum(lens)
                data = memoryview(ids.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * len(lens), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["first"] + stop - lens), pa.array(lens), pa.array([of(data[4 * (e - n) : 4 * e]) for e, n in zip(stop.tolist(), lens.tolist())], kind)],
                    ["shard", "doc_id", "at", "n_tokens", name],
                )

    rows = raw.mapInArrow(decode, f"shard int, doc_id long, at long, n_tokens long, {name} {'long' if digests else 'binary'}")
    # a row a shard, and a shard a task of the writer
    return rows.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", name)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_token_files()."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
