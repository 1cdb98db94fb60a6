"""Target-distribution importance resampling over hashed word n-grams.

A feature is a run of one or two words; its bucket is the CRC-32 of its UTF-8 bytes modulo the
number of buckets. The logarithm of the ratio of a bucket's share in the target texts to its
share in the corpus is its gain, a document's weight is the mean gain of its features, and
documents are drawn without replacement by the largest weights plus Gumbel noise (a function of
the document's id, so the draw can be repeated).

The hashing is done for an Arrow batch at once: the batch's distinct features are grouped by
their length in bytes, every group is a two-dimensional array of bytes, all CRCs of a group
are carried forward one column at a time, and the buckets are scattered back to the features'
places.

Three passes: bucket counts (a table row per bucket and task), weights, and a sort by score by
ranges, numbered by the sizes of the ranges. Neither texts nor features are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_only, map_arrow, partitions, stored, utf8

#: Features above this many bytes are few and of many lengths: zlib takes them one by one.
LONGEST_ROW = 128
#: Bytes of text whose features are held at once. A longer text is a slab of its own.
SLAB = 1 << 20
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()
#: Lower-cases A-Z and turns every byte that is in no word into a space: a word is made of
#: digits, Latin letters and whatever is not ASCII.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """The CRC-32 of every row of a two-dimensional array of bytes, column by column."""
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for place in range(rows.shape[1]):
        state = CRC[(state ^ rows[:, place]) & 0xFF] ^ (state >> np.uint32(8))
    return ~state


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of the byte strings ``data[start:start + size]``."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for length, members in zip(lengths.tolist(), np.split(order, first[1:])):
        if length <= LONGEST_ROW:
            cells = starts[members][:, None] + np.arange(length)
            out[members] = crc_rows(data[cells])
        else:
            out[members] = [zlib.crc32(data[s:s + length]) for s in starts[members].tolist()]
    return out


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, how many features each text has, and how many words.

    The features of a text are contiguous; their order inside a text is not defined.
    """
    words, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.translate(_LETTERS).split()
        counts[i] = len(own)
        words += own
    if not words:
        return np.zeros(0, np.int64), counts * 0, counts
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    known = coded.dictionary
    offsets = np.frombuffer(known.buffers()[1], np.int64)[known.offset:known.offset + len(known) + 1]
    data = np.frombuffer(known.buffers()[2], np.uint8)
    starts, sizes = offsets[:-1], np.diff(offsets)
    single = crcs(data, starts, sizes)[codes] % buckets

    doc = np.repeat(np.arange(len(texts)), counts)
    left = np.flatnonzero(doc[1:] == doc[:-1])
    # The codes of a pair fit into 32 bits: a slab has fewer words than that.
    pairs, which = np.unique(codes[left] * len(known) + codes[left + 1], return_inverse=True)
    first, second = pairs // len(known), pairs % len(known)
    pair_sizes = sizes[first] + 1 + sizes[second]
    pair_starts = np.r_[0, np.cumsum(pair_sizes)]
    joined = np.full(int(pair_starts[-1]), 32, np.uint8)
    _scatter(joined, pair_starts[:-1], data, starts[first], sizes[first])
    _scatter(joined, pair_starts[:-1] + sizes[first] + 1, data, starts[second], sizes[second])
    double = crcs(joined, pair_starts[:-1], pair_sizes)[which] % buckets

    owner = np.r_[doc, doc[left]]
    order = np.argsort(owner, kind="stable")
    return (np.r_[single, double].astype(np.int64)[order],
            np.bincount(owner, minlength=len(texts)), counts)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray,
             sizes: np.ndarray) -> None:
    """Copies ``data[at:at + size]`` to ``out[to:]`` for all rows at once."""
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + within] = data[np.repeat(at, sizes) + within]


def _slabs(texts: list[bytes]):
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLAB:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def bucket_counts(texts: DataFrame, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any.

    A task sends one row per bucket, whatever it reads.
    """
    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            found = utf8(batch)
            for a, b in _slabs(found):
                sums += np.bincount(features(found[a:b], buckets)[0], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": sums[used]})

    some = texts.select(F.coalesce(texts["text"].cast("string"), F.lit("")).alias("text"))
    return map_arrow(some, count, "bucket bigint, n bigint").groupBy("bucket").agg(
        F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """The gain of every bucket in thousandths, with one added to every count; rounded down."""
    sides = bucket_counts(corpus, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")) \
        .unionByName(bucket_counts(target, buckets).select(
            "bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    rows = sides.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toPandas()
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    s[rows.bucket], t[rows.bucket] = rows.s, rows.t
    ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(int).tolist()


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight: the mean gain of each text's features, rounded
    down; 0 for a text without any."""
    table = np.asarray(gain, np.int64)

    def score(batches):
        for batch in batches:
            texts = utf8(batch)
            words, sizes, weights = [], [], []
            for a, b in _slabs(texts):
                found, each, counted = features(texts[a:b], len(table))
                sums = np.r_[0, np.cumsum(table[found])]
                ends = np.cumsum(each)
                total = sums[ends] - sums[ends - each]
                words.append(counted)
                sizes.append(each)
                weights.append(np.where(each > 0, total // np.maximum(each, 1), 0))
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), *(pa.array(np.concatenate(x))
                                                for x in (words, sizes, weights))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return map_arrow(documents_only(docs), score,
                     "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _noise(seed: int):
    """floor(1000 * Gumbel noise) of a document, from the first 32 bits of a SHA-256."""
    first = F.conv(F.substring(F.sha2(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    share = (first.cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20,
             buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank, one row per document.

    ``docs`` has doc_id and text, ``target`` has text. Documents of at least ``min_words`` words
    take part in the draw; ``rank`` counts the drawn ones from the largest score down, ties to
    the smaller doc_id, and is null for all others.

    A null text is an empty one: no features, weight 0, not drawn. A null doc_id is hashed like
    the empty string and comes after equal scores. Rows with the same doc_id have the same noise
    and are drawn each for itself; which of two wholly equal ones comes first is not defined. An
    empty corpus gives an empty table, an empty target gives all buckets the same count in it.
    Texts are taken whole; a task holds about a hundred bytes per word of its longest text.
    Other columns are ignored, whatever their names.
    """
    weighed = weigh(docs, gains(docs, target, buckets))
    takes = F.col("n_words") >= min_words
    scored = stored(weighed.withColumn("score", F.col("weight") + _noise(seed))
                    .withColumn("takes", takes).withColumn("row", F.monotonically_increasing_id()))
    # Ranges of one total order, down to single rows, so equal scores never crowd a task.
    order = [F.desc("takes"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    numbered = stored(scored.repartitionByRange(partitions(docs), *order)
                      .sortWithinPartitions(*order)
                      .withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(
        F.count("*").alias("rows"), F.count_if("takes").alias("taking")).toPandas().sort_values("part")
    drawn = int(sizes.taking.sum()) * percent // 100
    before = pd.DataFrame({"part": sizes["part"], "before": sizes["rows"].cumsum() - sizes["rows"]})
    # One row per range: as many as shuffle partitions.
    offsets = docs.sparkSession.createDataFrame(before, "part bigint, before bigint")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    return numbered.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("takes") & (rank <= drawn), rank).alias("rank"))
