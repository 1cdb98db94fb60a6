"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits meet at a third one that lies within half of r
of both. Every distinct fingerprint therefore stands at all its variants within that ball, the
variants are dealt to partitions, and fingerprints that stand at the same variant are verified
and linked. For an odd r the two halves differ by one bit: pairs at r bits have different
parity, so only those of even parity take the larger ball; and as most of the r bits lie in
one half of the word, its extra variants may keep to one half.

A partition is the part of the variants with the same image under a linear map of the bits.
So it is enough to send a fingerprint there once: the task knows which of its variants belong
to it and makes them itself.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_only, map_arrow, ship, stored, utf8
from stagewise.llm.components import components

SEED = 42
#: Variants that one task holds at a time, about.
VARIANTS_PER_GROUP = 1 << 21
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in more than half of the hashes of all word shingles, repeats included."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) <= words:
        return digest(join(tokens), SEED)
    n = len(tokens) - words + 1
    hashes = np.fromiter((digest(join(s), SEED) for s in
                          zip(*[tokens[k:] for k in range(words)])), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        part = hashes[k:k + COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp, the 64 bits as a signed number, per document."""
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in utf8(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(documents_only(docs), run, "doc_id bigint, fp bigint")


class Balls:
    """The masks of a distance's balls and how their variants are dealt to 2**k groups."""

    def __init__(self, distance: int, bits: int):
        self.near = _masks(range(distance // 2 + 1), [range(64)])
        halves = [range(32), range(32, 64)]
        self.far = _masks([(distance + 1) // 2] if distance % 2 else [], halves)
        self.rows = np.random.Generator(np.random.PCG64(3)).integers(
            1, 2**64, bits, dtype=np.uint64)
        self.near_image, self.far_image = self.image(self.near), self.image(self.far)

    def image(self, values: np.ndarray) -> np.ndarray:
        """The linear map: one parity per row."""
        out = np.zeros(len(values), np.uint64)
        for k, row in enumerate(self.rows):
            out |= (np.bitwise_count(values & row).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
        return out

    def groups(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every group that has a variant of a fingerprint, with the fingerprint's index."""
        at = self.image(fps)
        even = np.bitwise_count(fps) % 2 == 0
        near = np.unique(self.near_image)
        far = np.setdiff1d(self.far_image, near)
        pairs = [(at[:, None] ^ near[None, :], np.arange(len(fps))),
                 (at[even][:, None] ^ far[None, :], np.flatnonzero(even))]
        return (np.concatenate([g.ravel() for g, _ in pairs]),
                np.concatenate([np.repeat(i, g.shape[1]) for g, i in pairs]))

    def links(self, fps: np.ndarray, group: int, distance: int) -> np.ndarray:
        """Verified pairs, as two columns, of fingerprints that meet at a variant of the group."""
        fps = np.unique(fps)
        near = self._variants(fps, self.near, self.near_image, group)
        even = fps[np.bitwise_count(fps) % 2 == 0]
        far = self._variants(even, self.far, self.far_image, group)
        keys, owners = np.r_[near[0], far[0]], np.r_[near[1], far[1]]
        order = np.argsort(keys, kind="stable")  # those of the near ball come first
        keys, owners, is_near = keys[order], owners[order], order < len(near[0])
        if not len(keys):
            return np.empty((0, 2), np.uint64)
        new = np.r_[True, keys[1:] != keys[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        pick = ~new & is_near[first]
        pairs = np.stack([owners[first[pick]], owners[pick]], 1)
        pairs = pairs[(pairs[:, 0] != pairs[:, 1])
                      & (np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance)]
        return np.unique(pairs, axis=0) if len(pairs) else pairs

    def _variants(self, fps, masks, images, group):
        at, found = self.image(fps) ^ np.uint64(group), []
        order = np.argsort(at, kind="stable")
        marks, begins = np.unique(at[order], return_index=True)
        for mark, own in zip(marks, np.split(order, begins[1:])):
            wanted = masks[images == mark]
            if len(wanted):
                keys = fps[own][:, None] ^ wanted[None, :]
                found.append((keys.ravel(), np.repeat(fps[own], len(wanted))))
        if not found:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found))


def _masks(sizes, ranges) -> np.ndarray:
    found = {sum(1 << b for b in c) for s in sizes for r in ranges for c in combinations(r, s)}
    return np.array(sorted(found), np.uint64)


def links(classes: DataFrame, count: int, distance: int) -> DataFrame:
    """u, v: for all distinct fingerprints, a set of pairs at ``distance`` or less that
    connects the same fingerprints as all such pairs do."""
    per_fp = len(Balls(distance, 0).near) + len(Balls(distance, 0).far) // 2
    bits = max(3, int(np.ceil(np.log2(max(1, count * per_fp / VARIANTS_PER_GROUP)))))
    balls = Balls(distance, bits)

    def deal(batches):
        for batch in batches:
            fps = column(batch, "fp").to_numpy().view(np.uint64)
            groups, owners = balls.groups(fps)
            order = np.argsort(groups, kind="stable")
            marks, begins = np.unique(groups[order], return_index=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(marks.astype(np.int64)),
                pa.array([fps[x].tobytes() for x in np.split(owners[order], begins[1:])]
                         if len(marks) else [], pa.binary())], ["part", "fps"])

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        fps = np.frombuffer(b"".join(group["fps"]), np.uint64)
        pairs = balls.links(fps, int(key[0]), distance).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    dealt = map_arrow(classes.select("fp"), deal, "part bigint, fps binary")
    return dealt.groupBy("part").applyInPandas(meet, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that is
    reachable over links of at most ``distance`` differing bits.

    A null, empty or blank text has fingerprint zero, which is linked like any other. Equal
    fingerprints are one class, however many documents have them; no pairs of documents are
    made. A null id cannot name a component: one with null ids only has a null component_id.
    """
    ship(docs.sparkSession)
    marked = stored(fingerprints(docs, words))
    named = _grouped(marked, distance)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(ids, "component").select("fp", "component_id")
    return marked.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(marked: DataFrame, distance: int) -> DataFrame:
    """fp, least (the smallest doc_id with it) and component, for every distinct fingerprint."""
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes, classes.count(), distance))
    return stored(classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")))


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The documents without near-duplicates: one of each group stays, with all its columns.

    It is the one with the smallest doc_id; a document without an id only where its whole group
    has none. Which of several rows with that id and fingerprint stays is not defined. An id
    names no document here: unlike documents with the same id, or without one, all stay.
    """
    ship(docs.sparkSession)
    mark = F.pandas_udf(_fingerprint_series(words), "bigint")
    tagged = stored(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        docs["doc_id"].cast("bigint").alias("doc_id"),
        mark(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("fp")))
    named = _grouped(tagged.select("doc_id", "fp"), distance)
    keep = named.groupBy("component").agg(
        F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("best")).select(
        _row_key(F.col("best.fp"), F.col("best.least")).alias("key"))
    # Copies with one id meet before the shuffle; the join needs no further one.
    single = tagged.groupBy(_row_key(F.col("fp"), F.col("doc_id")).alias("key")).agg(
        F.first("row").alias("row"))
    return single.join(keep, "key", "left_semi").select("row.*")


def _row_key(fp, doc_id):
    return F.concat_ws("/", fp.cast("string"), doc_id.cast("string"))


def _fingerprint_series(words: int):
    def marks(texts):  # a series of texts
        found = np.array([fingerprint(t.encode(), words) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return marks
