"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from sitelens.llm import (alignment, balltree, benchmark, covertree, language, lines, pieces, ranking, secrets, sharding,
                          simhash, suffixes, toxicity)
from sitelens.llm.common import id_crc, table

QueryFn = Callable[[SparkSession, str], DataFrame]
SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), id_crc("doc_id") % 3 != 1)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc("doc_id") % 5 == 0
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, extra=held_out)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, max_bits=2)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), length=200).drop("spans")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_counts(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


QUERIES: dict[str, QueryFn] = {f.__name__: f for f in (
    op1_sharding, op2_language, op3_pieces, op4_cover_tree, op5_toxicity, op6_simhash, op7_secrets, op8_suffixes, op9_decontamination, op10_lines,
    op11_ranking, op12_alignment, op13_ball_tree)}


def _jump_sql(shards: int) -> str:
    """Jump consistent hash of column ``k`` (hugeint) as a fold over the jump numbers."""
    state = "{'k': k, 'b': -1::BIGINT, 'j': 0::BIGINT}"
    key = f"((s.k * {sharding.JUMP_MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT)"
    nxt = (f"{{'k': {key}, 'b': s.j, 'j': floor((s.j + 1)::DOUBLE * "
           f"(2147483648::DOUBLE / ((({key} // 8589934592::HUGEINT) + 1)::DOUBLE)))::BIGINT}}")
    steps = f"[{state}] || list_transform(range({shards}), lambda i: {state})"
    return f"list_reduce({steps}, lambda s, i: CASE WHEN s.j < {shards} THEN {nxt} ELSE s END).b::INTEGER"


SHARDING_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, x: CASE WHEN c % 2 = 1
      THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS c
    FROM range(256) r(i))),
d AS (
  SELECT doc_id, coalesce(strlen("text"), 0) + 8 AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         list_transform(regexp_extract_all(hex(encode("text")), '..'),
                        lambda x: (strpos('0123456789ABCDEF', x[1]) * 16 + strpos('0123456789ABCDEF', x[2]) - 17)::BIGINT) AS bytes
  FROM documents),
e AS (
  SELECT doc_id, size::BIGINT AS size, h,
         CASE WHEN bytes IS NOT NULL THEN xor(4294967295::BIGINT, list_reduce([4294967295::BIGINT] || bytes,
              lambda c, x: xor(c // 256, crc_table.t[(xor(c, x) % 256) + 1]))) END AS text_crc32,
         list_reduce([0::HUGEINT] || list_transform(range(1, 17), lambda i: (strpos('0123456789abcdef', substr(h, i, 1)) - 1)::HUGEINT),
                     lambda a, x: a * 16 + x) AS k
  FROM d, crc_table),
s AS (SELECT doc_id, size, h, text_crc32, {_jump_sql(SHARDS)} AS shard, {_jump_sql(SHARDS + 1)} AS grown_shard FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY substr(h, 17), doc_id NULLS FIRST, size, text_crc32 NULLS FIRST) - 1 AS slot,
       grown_shard
FROM s
"""

DECONTAMINATION_SQL = r"""
WITH w AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
b AS (
  SELECT item_id, regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n,
         array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS phrase
  FROM b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM p),
x AS (
  SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM w, sizes, unnest(range(1, len(ws) - n + 2)) u(i)),
h AS (SELECT DISTINCT x.r, x.i, x.n, p.item_id FROM x JOIN p ON x.phrase = p.phrase AND x.n = p.n),
hit AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, unnest(range(0, n)) u(k) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

LINES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, "text", string_split("text", chr(10)) AS ls FROM documents),
u AS (
  SELECT r, doc_id, i, ls[i] AS line,
         trim(regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS norm
  FROM d, unnest(range(1, len(ls) + 1)) x(i) WHERE "text" IS NOT NULL),
p AS (
  SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM u),
k AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, s) > 1 AS gone FROM p),
g AS (
  SELECT r, count(*) FILTER (norm <> '') AS n_units, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(CAST(s AS BIGINT) || ':' || CAST(s + length(line) AS BIGINT), ',' ORDER BY s) FILTER (gone), '') AS spans,
         coalesce(string_agg(line, chr(10) ORDER BY s) FILTER (NOT gone), '') AS kept
  FROM k GROUP BY r)
SELECT doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(spans, '') AS spans, CASE WHEN "text" IS NOT NULL THEN kept END AS kept_text
FROM d LEFT JOIN g USING (r)
"""

RANKING_SQL = r"""
WITH w AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
q AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS i FROM benchmark)),
t AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
d AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM w GROUP BY r),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
      FROM t, c GROUP BY term),
m AS (SELECT r, doc_id, 75 + (25 * n * n_docs) // n_terms AS m FROM d, c),
s AS (
  SELECT i, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""

BALL_TREE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.r AS other, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM e q JOIN e c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op1_sharding": SHARDING_SQL, "op9_decontamination": DECONTAMINATION_SQL,
                              "op10_lines": LINES_SQL, "op11_ranking": RANKING_SQL, "op13_ball_tree": BALL_TREE_SQL}
