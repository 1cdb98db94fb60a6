"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes marks possible boundaries; chunks are normalised, that is,
boundaries before the normal size must pass a harder mask than those after it. The digests of
the chunks, each with its chunk's length, are the fingerprint. An insertion or a cut moves
only the chunks it touches, so the length of the chunks two fingerprints share, over the
length of those of the first, measures how much of the first text the second contains.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import documents_only, map_arrow, partitions, utf8

WINDOW = 32
LEAST, NORMAL, MOST = 32, 64, 256
HARD, EASY = np.uint32(0x7F << 25), np.uint32(0x1F << 25)
GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 2**32, 256, dtype=np.uint32)
#: Bytes hashed at once.
SLAB = 1 << 21
LENGTH_BITS = 0xFFFF


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gears of the last 32, the older the further left."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(width)
        h, width = longer, 2 * width
    return h


def chunk_sets(texts: list[bytes]) -> list[set[int]]:
    """Per text the set of chunk digests; the low 16 bits of each are the chunk's length."""
    out: list[set[int]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLAB):
            size += len(texts[end])
            end += 1
        out += _slab(texts[at:end])
        at = end
    return out


def _slab(texts: list[bytes]) -> list[set[int]]:
    # A cut lies at least 32 bytes after the last, so no hash that counts sees another text.
    h = gear_hash(np.frombuffer(b"".join(texts), np.uint8))
    places = np.flatnonzero((h & EASY) == 0)
    hard = ((h[places] & HARD) == 0).tolist()
    ends = np.cumsum([len(t) for t in texts])
    firsts = np.searchsorted(places, np.r_[0, ends]).tolist()
    places = places.tolist()
    out, begin = [], 0
    for k, text in enumerate(texts):
        out.append(_chunks(text, begin, places[firsts[k]:firsts[k + 1]],
                           hard[firsts[k]:firsts[k + 1]]))
        begin = int(ends[k])
    return out


def _chunks(text: bytes, begin: int, places: list[int], hard: list[bool]) -> set[int]:
    digest, found, n = xxhash.xxh3_64_intdigest, set(), len(text)
    start, k, most = 0, 0, len(places)
    while start < n:
        cut = min(start + MOST, n)
        while k < most:
            end = places[k] - begin + 1
            if end >= cut:
                break
            size = end - start
            if size >= NORMAL or size >= LEAST and hard[k]:
                cut = end
                break
            k += 1
        piece = text[start:cut]
        found.add(digest(piece) & ~LENGTH_BITS | len(piece))
        start = cut
    return found


def written(chunks: set[int]) -> str:
    return base64.b64encode(np.array(sorted(chunks), ">u8").tobytes()).decode()


def read(fingerprint: str) -> set[int]:
    return set(np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist())


def containment(a: set[int], b: set[int]) -> float:
    """Share of a's chunks, by length, that are in b too; 1 for two empty sets."""
    if not a or not b:
        return float(a == b)
    return sum(x & LENGTH_BITS for x in a & b) / sum(x & LENGTH_BITS for x in a)


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what they share.

    The edited text has its last third replaced by the beginning of the next document, in
    descending order of doc_id (null ids last, equal ids by text), the first following the
    last. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. An empty text has the empty fingerprint, which is like an empty
    one only; the next document of a lone document is itself.

    Documents are dealt to ranges of doc_id; the first of each range also visits the range
    before it, so that every task knows the successor of its last document.
    """
    docs = documents_only(docs)
    count = partitions(docs)
    tops = _tops(docs, count)
    bucket = _bucket(F.col("doc_id"), tops or [0])
    if tops:
        ends = F.array(*[F.lit(x).cast("bigint") for x in tops])
        visits = F.when(F.get(ends, bucket) == F.col("doc_id"),
                        F.array((bucket + 1) % len(tops)))
    else:  # ids are null in all rows, so the first by text follows the last
        first = docs.agg(F.min("text")).first()[0]
        visits = F.when(F.col("text") == F.lit(first), F.array(F.lit(0)))
    dealt = docs.select("doc_id", "text", F.explode(F.concat(
        F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("guest"))),
        F.transform(F.coalesce(visits, F.array().cast("array<int>")),
                    lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("guest"))),
    )).alias("to")).select("to.bucket", "to.guest", "doc_id", "text")
    ordered = dealt.repartition(count, "bucket").sortWithinPartitions(
        "bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return map_arrow(ordered, _pairs, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"))


def _tops(docs: DataFrame, count: int) -> list[int]:
    """The largest doc_id of each of at most ``count`` + 1 ranges of about equal size.

    Quantiles are doubles and may miss a large id, so they only part the ids into ranges; the
    ends are looked up.
    """
    shares = [(k + 1) / count for k in range(count)]
    splits = docs.agg(F.percentile_approx("doc_id", shares, 20 * count)).first()[0]
    ranges = _bucket(F.col("doc_id"), sorted(set(splits or [0])))
    rows = docs.where("doc_id is not null").groupBy(ranges.alias("range")).agg(
        F.max("doc_id").alias("top")).collect()  # a row per range
    return sorted(r["top"] for r in rows)


def _bucket(value, splits: list[int]):
    """How many splits are smaller, by binary search; 0 for null."""
    array = F.array(*[F.lit(x).cast("bigint") for x in splits])
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, s: F.when(F.get(array, low + s - 1) < value, low + s).otherwise(low))


def _pairs(batches):
    """Each document with the one after it, over the sorted rows of a partition."""
    last = None
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                        batch.column(2).to_pylist(), utf8(batch)))
        if last is not None:
            rows.insert(0, last)
        pairs, size = [], 0
        for row, after in zip(rows, rows[1:]):
            if not row[1] and row[0] == after[0]:
                pairs.append((row, after))
                size += len(row[3])
                if size > SLAB:
                    yield _described(pairs)
                    pairs, size = [], 0
        if pairs:
            yield _described(pairs)
        last = rows[-1] if rows else None


def _described(pairs) -> pa.RecordBatch:
    texts = [pairs[0][0][3]]
    edited, lengths = [], []
    for row, after in pairs:
        own = row[3].decode("utf-8", "replace")
        third = len(own) // 3
        head = after[3][:4 * third].decode("utf-8", "ignore")[:third]
        edited.append((own[:len(own) - third] + head).encode())
        lengths.append(len(own))
        texts.append(after[3])
    # The successor of one pair is mostly the first of the next pair.
    firsts, k = [], 0
    for i, (row, _) in enumerate(pairs):
        if i and row is not pairs[i - 1][1]:
            texts.insert(k + 1, row[3])
            k += 1
        firsts.append(k)
        k += 1
    sets = chunk_sets(texts)
    changed = chunk_sets(edited)
    own = [sets[i] for i in firsts]
    return pa.RecordBatch.from_arrays([
        pa.array([row[2] for row, _ in pairs], pa.int64()),
        pa.array(lengths, pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([written(s) for s in own], pa.string()),
        pa.array([written(s) for s in changed], pa.string()),
        pa.array([containment(a, b) for a, b in zip(own, changed)], pa.float64()),
        pa.array([containment(a, sets[i + 1]) for a, i in zip(own, firsts)], pa.float64()),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next"])
