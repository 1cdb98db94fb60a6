"""The operators applied to the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.llm import (
    fingerprints,
    htmltext,
    importance,
    lines,
    lm,
    neighbours,
    packing,
    pieces,
    quality,
    repeats,
    secrets,
    simhash,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]

SIMHASH_WORDS, SIMHASH_BITS = 3, 3
PACKED_TOKENS = 2048
REPEATED_BYTES = 400
NEIGHBOURS = 20
GOOD = 0.3
LINE_EDITS, LINE_CHARS = 1, 20
DRAWN_PERCENT, DRAWN_WORDS, FEATURE_BUCKETS, DRAW_SEED = 25, 20, 10_000, 7
COMPONENTS = 8


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(
        table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, NEIGHBOURS)


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_with_edits(table(spark, folder, "documents"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(
        table(spark, folder, "documents"), SIMHASH_WORDS, SIMHASH_BITS)


def op4_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), REPEATED_BYTES)


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(
        table(spark, folder, "documents"), table(spark, folder, "labels"), GOOD)


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(
        table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"),
                        tokenizer_path("word_bpe_49k.json"), PACKED_TOKENS)


def op10_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.deduplicated_digest(
        table(spark, folder, "documents"), LINE_EDITS, LINE_CHARS)


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"),
        DRAWN_PERCENT, DRAWN_WORDS, FEATURE_BUCKETS, DRAW_SEED)


def op12_html(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), COMPONENTS)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_neighbours, op2_fingerprints, op3_simhash, op4_lm, op5_repeats, op6_quality,
    op7_secrets, op8_pieces, op9_packing, op10_lines, op11_importance, op12_html,
    op13_whitening)}
ORACLES: dict[str, str] = {
    # A table of this size is searched whole, so the exact answer is the operator's.
    "op1_neighbours": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, e.vec_id, score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) AS rank
            FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
                  WHERE vec_id % 20 = 0) q,
                 (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e,
                 LATERAL (SELECT list_inner_product(q.v, e.v) AS score)
            WHERE e.vec_id <> q.vec_id)
        WHERE rank <= 20""",
    # Every distinct run's bytes go through the table of the CRC one by one.
    "op11_importance": r"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (SELECT side, row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (
  SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
feats AS (SELECT side, row, f, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feats)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(
    range(0, len(h) // 2), lambda i:
      16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS b
  FROM bytes, tab),
counts AS (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t
  FROM feats JOIN buckets USING (f) GROUP BY b),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1.0::DOUBLE) * (tt + 10000)::DOUBLE))) AS BIGINT) AS g FROM counts, totals),
weights AS (SELECT row, sum(n) AS n_features, floor(sum(n * g) / sum(n)::DOUBLE) AS weight
  FROM feats JOIN buckets USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY row),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
    coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296))) AS score
  FROM words LEFT JOIN weights USING (row) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
  CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM ranked""",
}
