"""Token counts of flat, unindexed token files by a separator scan.

A flat file is a run of ids in which an end-of-document id closes each document; nothing says where
documents begin.  It is stored as numbered blocks of fixed size, cut without regard to documents.
Each block is searched for the separator in one vectorised pass; what lies before its first and
behind its last separator is stitched to its neighbours by prefix sums over the blocks of the file."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise
from .encoding import encoder, lots

BLOCK_IDS = 1 << 16


def write_flat_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Flat files of the ids of all texts, end_id after each: one file a task, rows (file, block,
    ids), and beside them manifest rows (file, ordinal, names) with the document ids in file order.

    Special-token strings in a text are encoded as ordinary text, so end_id occurs only as the
    separator.  Null and empty texts: the separator alone.  Null and repeated ids are documents like others;
    ids are cast to long; an empty table makes files without blocks; other columns are ignored.  Ids are written as 2 bytes where the vocabulary
    allows, little-endian; at most a block and a lot of texts are held."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def write(batches):
        enc, file = encoder(tokenizer, special_as_text=True), TaskContext.get().partitionId()
        end, size = np.array([end_id], enc.dtype).tobytes(), block_ids * enc.dtype.itemsize
        held, block, ordinal = b"", 0, 0

        def rows(kind, number, ids, names):
            return pa.RecordBatch.from_arrays([pa.array([file] * len(number), pa.int32()), pa.array([kind] * len(number), pa.int32()), pa.array(number, pa.int64()), pa.array(ids, pa.binary()), pa.array(names, pa.list_(pa.int64()))], ["file", "width", "number", "ids", "names"])

        for names, texts in lots(batches):
            held += b"".join(x + end for x in enc.encode(texts))
            full = len(held) // size
            yield rows(enc.dtype.itemsize, list(range(block, block + full)), [held[k * size : (k + 1) * size] for k in range(full)], [None] * full)
            held, block = held[full * size :], block + full
            yield rows(None, [ordinal], [None], [names])
            ordinal += len(names)
        if held:
            yield rows(enc.dtype.itemsize, [block], [held], [None])

    flat.mapInArrow(write, "file int, width int, number long, ids binary, names array<long>").write.option("compression", "zstd").parquet(path)


def separator_scan(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, n_tokens): length, without the separator, of each document of flat files.

    blocks: (file, number, width, ids), any order, width bytes an id.  Ids behind the last separator
    of a file count as a document too (a file that was cut off).  No blocks: no rows."""

    def search(batches):
        for b in batches:
            out = []
            for file, number, width, ids in zip(*(c.to_pylist() for c in b.columns)):
                v = np.frombuffer(ids, f"<u{width}")
                at = np.flatnonzero(v == end_id)
                inner = (np.diff(at) - 1).tolist() if len(at) else []
                out.append((file, number, len(at), int(at[0]) if len(at) else len(v), len(v) - int(at[-1]) - 1 if len(at) else 0, inner))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "number", "seps", "head", "tail", "inner"])

    found = blocks.select("file", "number", "width", "ids").mapInArrow(search, "file int, number long, seps long, head long, tail long, inner array<long>")
    found = materialise(found, "separators")  # a few numbers a block, and one a document; read twice below
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("*", F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("first"))
    # The document that is open at the start of a block with separators has ordinal `first`; its
    # length is the sum of the tail that opened it and of all heads up to its separator.
    open_ = (
        scan.select("file", F.explode(F.array(F.struct(F.col("first").alias("ordinal"), F.col("head").alias("n"), (F.col("seps") > 0).alias("closed")), F.struct((F.col("first") + F.col("seps")).alias("ordinal"), F.col("tail").alias("n"), F.lit(False).alias("closed")))).alias("e"))
        .groupBy("file", "e.ordinal").agg(F.sum("e.n").alias("n_tokens"), F.max("e.closed").alias("closed"))
        .where("closed or n_tokens > 0").drop("closed")
    )
    whole = scan.select("file", "first", F.posexplode("inner").alias("k", "n_tokens")).select("file", (F.col("first") + 1 + F.col("k")).alias("ordinal"), "n_tokens")
    return open_.unionByName(whole)


def count_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files to `path`, scan them, and name the documents: id_col, n_tokens.

    One row per input row, repeated and null ids too; null and empty texts have 0 tokens; an empty table gives
    no rows; other columns are ignored."""
    write_flat_files(docs, path, tokenizer, end_id, id_col, text_col)
    rows = docs.sparkSession.read.schema("file int, width int, number long, ids binary, names array<long>").parquet(path)
    counts = separator_scan(rows.where("width is not null"), end_id)
    names = rows.where("width is null").select("file", F.col("number").alias("base"), F.posexplode("names").alias("k", id_col)).select("file", (F.col("base") + F.col("k")).alias("ordinal"), id_col)
    return names.join(counts, ["file", "ordinal"]).select(id_col, "n_tokens")
