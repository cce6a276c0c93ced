"""One query for each operator, over its whole table."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import (
    alignment,
    exact,
    language,
    mixing,
    packing,
    passages,
    phrases,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    tokens,
    vectors,
)

Query = Callable[[SparkSession, str], DataFrame]


@functools.cache
def _archive() -> str:
    """The package as a zip file."""
    top = Path(__file__).resolve().parents[2]
    base = Path(tempfile.mkdtemp(prefix="siftline-code-")) / "siftline"
    return shutil.make_archive(str(base), "zip", top, "siftline")


_shipped: set[str] = set()


def shipped(query: Query) -> Query:
    """The query, after this package's code has been given to the executors, once a session."""

    @functools.wraps(query)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        if app not in _shipped:
            spark.sparkContext.addPyFile(_archive())
            _shipped.add(app)
        return query(spark, sf_dir)

    return call


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_documents(spark, sf_dir))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, sf_dir)).drop("kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_documents(spark, sf_dir))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_documents(spark, sf_dir))


ALL: tuple[Query, ...] = (
    op1_embedding_near_duplicates,
    op2_quality_rules,
    op3_language_id,
    op4_quality_classifier,
    op5_secret_scan,
    op6_token_counts,
    op7_source_mixture,
    op8_substring_dedup,
    op9_best_fit_packing,
    op10_simhash_near_duplicates,
    op11_token_alignment,
    op12_collocations,
    op13_exact_dedup,
)

# Words are told by patterns that DuckDB's engine shares; integers of 128 bits keep products exact.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists
), found AS (
    SELECT lang, 1 AS m, w[i] AS phrase, w[i] AS w1, NULL AS w2, NULL AS w3 FROM words
    UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1], w[i], w[i + 1], NULL FROM words WHERE i + 1 <= len(w)
    UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], w[i], w[i + 1], w[i + 2]
    FROM words WHERE i + 2 <= len(w)
), f AS (
    SELECT lang, m, phrase, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS f
    FROM found GROUP BY lang, m, phrase
), total AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), often AS (
    SELECT * FROM f WHERE f >= 10
), cuts AS (
    SELECT lang, m, phrase, f AS a, 1 AS k, w1 AS first, substr(phrase, length(w1) + 2) AS rest FROM often WHERE m > 1
    UNION ALL SELECT lang, m, phrase, f, 2, w1 || ' ' || w2, w3 FROM often WHERE m = 3
), scored AS (
    SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r,
        (1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN often x ON x.lang = c.lang AND x.phrase = c.first AND x.m = c.k
    JOIN often y ON y.lang = c.lang AND y.phrase = c.rest AND y.m = c.m - c.k
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase, m ORDER BY score, k) = 1
), covers AS (
    SELECT lang, phrase, max(longer) AS longer FROM (
        SELECT lang, w1 || ' ' || w2 AS phrase, f AS longer FROM often WHERE m = 3
        UNION ALL SELECT lang, w2 || ' ' || w3, f FROM often WHERE m = 3) GROUP BY lang, phrase
), kept AS (
    SELECT s.* FROM lowest s LEFT JOIN covers c ON s.m = 2 AND c.lang = s.lang AND c.phrase = s.phrase
    WHERE c.longer IS NULL OR 100 * c.longer < 50 * s.a
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Query]:
    return {q.__name__: shipped(q) for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op12_collocations": COLLOCATIONS_SQL, "op13_exact_dedup": EXACT_SQL}
