"""Thin queries over the llm operators, op<N>_<name>, and DuckDB SQL where it can express them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embed_dedup, licenses, line_dedup, mixing, quality, token_counts, token_files
from ._common import materialise, new_path
from .jaccard_join import ngram_jaccard_join

END_ID = 2  # closes a document in token files
END_OF_TEXT = 50256  # closes a document in flat files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.round("quality_score", 6).alias("quality_score"), "quality_keep")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select("doc_id", "paragraph", "family", "similarity", "confirmed")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(), END_ID)
    return token_files.read_token_files(spark, path, digests=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), new_path(spark, "flat"), vocabulary(), END_OF_TEXT)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = json.dumps({"messages": [{"role": r, "content": tricky} for r in ("user", "assistant")]})
    records = spark.createDataFrame([(-7, more)], "conv_id long, record string")
    turns = chat.table_turns(rows.withColumn("conv_id", F.col("conv_id").cast("long"))).unionByName(chat.to_turns(records))
    return chat.read_chats(materialise(chat.format_chats(turns), "chats"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_licenses, op3_decontamination, op4_embedding_dedup, op5_ngram_jaccard, op6_token_files, op7_token_counts, op8_mixing, op9_line_dedup, op10_chat_formatting)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
_BLANK = "[^\\x20\\x09-\\x0D]+"

ORACLES = {
    "op3_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS l, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' ')) AS g FROM b WHERE len(w) >= 5),
ig AS (SELECT item_id, g, count(*) AS c FROM (SELECT item_id, unnest(g) AS g FROM i) GROUP BY 1, 2),
dg AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda k: {{'p': k - 1, 'g': array_to_string(w[k:k+4], ' ')}})) AS x FROM d WHERE len(w) >= 5),
hit AS (SELECT dg.doc_id, dg.n, i.item_id, i.l, dg.x.p AS p, dg.x.g AS g, ig.c FROM dg JOIN ig ON ig.g = dg.x.g JOIN i ON i.item_id = ig.item_id),
win AS (SELECT *, unnest(range(greatest(0, p - (least(l, n) - 4) + 1), least(p, n - least(l, n)) + 1)) AS s FROM hit),
per AS (SELECT doc_id, item_id, s, g, any_value(l) AS l, any_value(n) AS n, least(count(*), any_value(c)) AS both_ FROM win GROUP BY 1, 2, 3, 4),
sim AS (SELECT doc_id, item_id, s, sum(both_)::DOUBLE / (least(any_value(l), any_value(n)) - 4 + any_value(l) - 4 - sum(both_)) AS sim FROM per GROUP BY 1, 2, 3),
best AS (SELECT doc_id, item_id, max(sim) AS similarity FROM sim WHERE sim >= 0.75 GROUP BY 1, 2)
SELECT best.doc_id, best.item_id, best.similarity, min(sim.s)::BIGINT AS word_at FROM best JOIN sim ON sim.doc_id = best.doc_id AND sim.item_id = best.item_id AND sim.sim = best.similarity GROUP BY 1, 2, 3
""",
    "op4_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e) AND list_bool_and(list_transform(e, lambda x: isfinite(x))) AND list_bool_or(list_transform(e, lambda x: x <> 0))),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) >= 0.95 * a.norm * b.norm),
r(id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
""",
    "op5_ngram_jaccard": f"""
WITH RECURSIVE
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY 1, 2
""",
    "op8_mixing": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_BLANK}')), 0)::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][((rn - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wts FROM w),
m AS (SELECT *, cap * wts <= lft * weight AS stopped FROM o),
f AS (SELECT lft, wts FROM m WHERE NOT stopped ORDER BY cap / weight, rn LIMIT 1),
t AS (SELECT m.*, CASE WHEN stopped THEN cap::DOUBLE ELSE (SELECT lft FROM f) * weight / (SELECT wts FROM f) END AS target FROM m),
e AS (SELECT *, sum(target) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS edge, sum(target) OVER () AS total FROM t WHERE target > 0),
hi AS (SELECT rn, CASE WHEN rn = max(rn) OVER () THEN 1000000000000000000::HUGEINT ELSE floor(least(edge / total, 1.0) * 1e18)::HUGEINT END AS hi FROM e),
sp AS (SELECT rn, coalesce(lag(hi) OVER (ORDER BY rn), 0) AS lo, hi FROM hi),
sl AS (SELECT i, (i::HUGEINT * 618033988749894848) % 1000000000000000000 AS p FROM range((SELECT (ceil(floor(sum(target)) / 128))::BIGINT FROM t)) x(i)),
k AS (SELECT sp.rn, count(*) AS k FROM sl JOIN sp ON p >= lo AND p < hi GROUP BY 1),
x AS (SELECT d.*, t.source_size, t.target, t.rn, sum(size) OVER (PARTITION BY t.rn ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS ofs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, coalesce(k, 0) * 128 - ofs)) + greatest(0, least(size, coalesce(k, 0) * 128 - ofs - source_size)))::BIGINT AS taken
FROM x LEFT JOIN k ON k.rn = x.rn
""",
    "op9_line_dedup": f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(list_transform(ls, lambda x: len(regexp_extract_all(x, '{_BLANK}')))) AS w FROM d WHERE text IS NOT NULL),
b AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS aft FROM l),
f AS (SELECT a.doc_id, a.pos AS a, min(z.pos) AS z FROM b a JOIN b z ON z.doc_id = a.doc_id AND z.pos >= a.pos AND z.aft >= a.aft - a.w + 50 GROUP BY 1, 2
      UNION SELECT z.doc_id, max(a.pos) AS a, z.pos AS z FROM b z JOIN b a ON z.doc_id = a.doc_id AND z.pos >= a.pos AND z.aft >= a.aft - a.w + 50 GROUP BY 1, 3),
r AS (SELECT f.doc_id, a, z, array_to_string(ls[a+1:z+1], chr(10)) AS run FROM f JOIN d ON d.doc_id = f.doc_id),
later AS (SELECT doc_id, a, z FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS k FROM r) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(a, z + 1)) AS p FROM later) GROUP BY 1)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ps), 0)::BIGINT AS n_removed,
  md5(CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(len(ls)), lambda i: NOT list_contains(ps, i)), lambda i: ls[i+1]), chr(10)) END) AS text_md5
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
""",
    "op10_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || body || ' </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY 1
""",
}
