"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, where the package that holds them is installed."""
    if find_spec("public_tokenizers") is None:
        raise ModuleNotFoundError("public_tokenizers holds the vocabulary files; pass a path to the operator instead")
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"), plain=True)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import embedding_duplicates

    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_duplicates

    return substring_duplicates(table(spark, sf_dir, "documents"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_mix_sources, op2_token_counts, op3_language_id, op4_substring_dedup, op5_pack_sequences, op6_toxicity, op7_near_dedup, op8_embedding_dedup, op9_neighbours, op10_quality]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS n_full,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS most FROM by_source),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
targets AS (SELECT *, least(most, max(level) OVER () * weight) AS target FROM levels),
plan AS (
  SELECT source, source_size, target, source_size::DOUBLE / n_full AS mean_size,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS ratio
  FROM targets),
parts AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, ratio - floor(ratio) AS part, target - floor(ratio) * source_size AS rest FROM plan),
ranked AS (
  SELECT s.doc_id, s.size, s.source, p.source_size, p.target, p.whole, p.rest,
         CASE WHEN s.size > 0 AND p.part > 0
              THEN s.u / (1 - s.u) / (p.part / (1 - p.part) * sqrt(s.size / p.mean_size)) END AS q
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
run AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER
      (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id ASC NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ranked),
taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0
                 ELSE whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END END AS copies
  FROM run)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM taken
"""


#: Windows as strings, which joining by a space spells without doubt, and words by place.
OP4_SQL = r"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM split, unnest(range(1, len(ws) - 11)) t(i) WHERE len(ws) >= 13 AND doc_id IS NOT NULL),
least_id AS (SELECT k, min(doc_id) AS low FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, x FROM windows JOIN least_id USING (k), unnest(range(i, i + 13)) u(x) WHERE doc_id > low),
words AS (SELECT r, x, ws[x] AS w FROM split, unnest(range(1, len(ws) + 1)) v(x)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY x) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, x) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""


OP8_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""

#: Exact search; the index finds the same on tables as small as those that DuckDB compares.
OP9_SQL = """
WITH good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op4_substring_dedup": OP4_SQL, "op8_embedding_dedup": OP8_SQL, "op9_neighbours": OP9_SQL}
