"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .common import documents


def op1_packing(spark, sf_dir):
    from .packing import pack

    return pack(documents(spark, sf_dir))


def op2_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op3_quality(spark, sf_dir):
    from .quality import score

    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).select("doc_id", "text_score", "page_score", "score", "keep")


def op4_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "source")).select("doc_id", "source", "mix_block", "mix_position")


def op5_ann(spark, sf_dir):
    from .ann import search

    return search(documents(spark, sf_dir, "embeddings"))


def op6_langid(spark, sf_dir):
    from .langid import languages

    return languages(documents(spark, sf_dir))


def op7_sharding(spark, sf_dir):
    from .sharding import shard

    return shard(documents(spark, sf_dir))


def op8_binary(spark, sf_dir):
    from .binary import digests, packed

    return digests(packed(documents(spark, sf_dir)))


def op9_topk(spark, sf_dir):
    from .topk import search

    return search(documents(spark, sf_dir, "embeddings"))


def op10_html(spark, sf_dir):
    from .html import extract

    return extract(documents(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_quality, op4_mixing, op5_ann, op6_langid, op7_sharding, op8_binary, op9_topk, op10_html)}

ORACLE_SQL: dict[str, str] = {
    "op9_topk": """
WITH u AS (
  SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL
), bad AS (
  SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR NOT isfinite(x)
), c AS (
  SELECT vec_id, i, CAST(floor(64 * x) AS BIGINT) AS x FROM u ANTI JOIN bad USING (vec_id)
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(sum(q.x * r.x) AS BIGINT) AS score
  FROM c AS q JOIN c AS r ON q.i = r.i AND q.vec_id <> r.vec_id
  WHERE q.vec_id % 20 = 0
  GROUP BY q.vec_id, r.vec_id
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM k WHERE "rank" <= 20
""",
}
