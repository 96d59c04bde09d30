"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dup, html_text, line_dedup, mixing, near_dup, packing, secrets, topk, toxicity
from .common import Scratch, shared_dir

TOKENIZER = "word_bpe_49k.json"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return topk.search(_read(spark, sf_dir, "embeddings"), scratch, F.col("vec_id") % 50 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as scratch:
        model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), scratch)
    scored = toxicity.score(docs, model)
    return scored.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    return chat_format.digests(chat_format.prefix_targets(own.unionByName(added)))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        cut = packing.pieces(_read(spark, sf_dir, "documents"), tokenizer_path())
        documents, cost = packing.WIDE
        return scratch.keep(packing.pack(cut, scratch, max_documents=documents, max_cost=cost * packing.SEQUENCE**2))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = near_dup.classes(_read(spark, sf_dir, "documents"), scratch)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_read(spark, sf_dir, "documents")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"), html_text.trained(folder=shared_dir(spark)))


def op8_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        return embedding_dup.classes(_read(spark, sf_dir, "embeddings"), scratch)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = line_dedup.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"), scratch)
    return found


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        sized = scratch.table(mixing.sizes(_read(spark, sf_dir, "documents")))
        found = mixing.with_repeats(sized, mixing.plan(sized, scratch))
        return scratch.keep(
            found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))
        )


QUERIES = {
    "op1_topk": op1_topk,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_near_dup": op5_near_dup,
    "op6_secrets": op6_secrets,
    "op7_html_text": op7_html_text,
    "op8_embedding_dup": op8_embedding_dup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
)"""

_OP1 = f"""{_VECTORS},
i AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM v WHERE vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM i q JOIN i c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP8 = f"""{_VECTORS},
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a
), labels AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = labels.vec_id) AS n_links,
  component_id, vec_id = component_id AS kept
FROM labels
"""

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total,
    sum(24 + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
      + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR n = total) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

_OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS key
  FROM documents
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
), rooms AS (SELECT *, CAST(cap AS DOUBLE) / weight AS room FROM ranked),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS level
  FROM rooms WINDOW w AS (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size,
    CASE WHEN lv <= room THEN lv * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM (SELECT *, (SELECT level FROM levels WHERE level <= room ORDER BY room, source NULLS LAST LIMIT 1) AS lv FROM levels)
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goal
), runs AS (
  SELECT s.doc_id, s.size, s.key, p.source, p.source_size, p.target, p.whole,
    p.target - p.whole * p.source_size AS rest, sum(s.size) OVER w AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
  WINDOW w AS (PARTITION BY s.source ORDER BY s.key, s.size ROWS UNBOUNDED PRECEDING)
), cuts AS (
  SELECT *, max(CASE WHEN rest > 0 AND 2 * upto - size < 2 * rest THEN key ELSE '' END) OVER (PARTITION BY source) AS cut FROM runs
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN key <= cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM cuts
"""

ORACLE_SQL = {"op1_topk": _OP1, "op8_embedding_dup": _OP8, "op3_chat_format": _OP3, "op10_mixing": _OP10}
