"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of the threshold's length that covers it also starts somewhere else.
The suffix array is a sparse one: each text is cut at marks that its content alone chooses (the
smallest hash of a few bytes in a small window), so equal strings are cut at the same places,
and only marks are ranked. A mark's rank stands for the phrase up to the next mark; the first
pairs of neighbouring phrases are named where the text is cut, since all of its marks are at
hand. Each round then groups the marks by rank, drops those that are alone, and ranks the others
again by the pair of their rank and the rank that lies 2, 4, ... marks further on, until a mark
is unique or its phrases are all that every string with this first mark is sure to hold; the
last pair overlaps to end exactly there. Pairs are named by digests of the two ranks, so that no
global numbering is needed.

A mark that is left has twins as far as the marks of its strings tell; the bytes before the
first and after the last of them decide. It is compared by a digest of all bytes of all strings
it is the first mark of, taken when the text is cut: where that reach is repeated, so are all of
them. What remains are marks around the ends of repeats; their strings are compared in runs of a
few, in the same way, and those of the runs that are left one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import (
    column,
    documents_only,
    map_arrow,
    ship,
    small_batches,
    stored,
    utf8,
)

#: Neighbouring strings of a run; bits of the filter that says which documents may be needed;
#: the most frequent keys that are looked up apart, so that no task gets all rows of one.
RUN, FILTER_BITS, HOT = 16, 1 << 24, 512
#: Phrases that a mark's rank stands for when the text is cut, at most; documents whose texts a
#: task holds as bytes at once.
START, HELD = 2, 1000

_rng = np.random.Generator(np.random.PCG64(17))
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)


class Marks:
    """Where texts are cut, for one threshold.

    All marks between the first and the last window of a string are chosen inside it. The first
    lies in its first ``window`` bytes, the last in its last ``window + gram - 1``, so ``span``
    bytes after its first mark every string still holds every mark.
    """

    def __init__(self, length: int):
        self.length = length
        self.window = 1 << max(0, int(np.log2(max(1, length / 3))))
        self.gram = min(16, max(1, length // 8))
        self.span = length - 2 * self.window - self.gram + 2

    def of(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the marks; first and last start of the strings whose first mark each is
        (first > last: of none); and how many phrases it is ranked by."""
        if len(data) < self.length:
            return (np.empty(0, np.int64),) * 4
        h = GEAR[data]
        grams = self._polynomials(h)
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x85EBCA77)
        at = np.arange(len(grams), dtype=np.uint64)
        low = grams.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - at)
        width = 1
        while width < self.window:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        chosen = 0xFFFFFFFF - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        last = np.minimum(np.r_[first[1:], len(chosen)] - 1, len(data) - self.length)
        marks = chosen[first]
        phrases = np.searchsorted(marks, marks + self.span, "right") - np.arange(len(marks)) - 1
        return marks, first, last, phrases


    def _polynomials(self, h: np.ndarray) -> np.ndarray:
        """For every place, the polynomial of the next ``gram`` values, by doubling."""
        out, done, part, size, power = None, 0, h, 1, 0x9E3779B1
        while True:
            if self.gram & size:
                out = part if out is None else out[:-size] * np.uint32(power) + part[done:]
                done += size
            if 2 * size > self.gram:
                return out
            part = part[:-size] * np.uint32(power) + part[size:]
            power, size = power * power % (1 << 32), 2 * size


def _parts(batches):
    """The batches in parts of at most HELD rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, HELD):
            yield batch.slice(a, HELD)


def _signed(digest: int) -> int:
    return digest - ((digest >> 63) << 64)


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns where null equals null; the left columns, then the right's others."""
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(right[c])
    return left.join(right, same, how).select(
        left["*"], *[right[c] for c in right.columns if c not in on])


MARK = ["doc_id", "digest"]
POSITIONS = "doc_id bigint, digest bigint, first int, last int, anchor int, reach bigint"


def _shared(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys of two rows and more, with their number."""
    return stored(rows.groupBy(*on).agg(F.count("*").alias("times")).where("times > 1"))


def _among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows with one of the keys (``on``, none of them null, and ``times``).

    The HOT most frequent keys are broadcast; no other can hold more than a HOT-th of the rows.
    """
    hot = F.broadcast(keys.orderBy(F.desc("times"), *on).limit(HOT).select(*on))
    others = rows.join(hot, on, "left_anti").join(keys.select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(others)


def doubled(marks: DataFrame, step: int = 1) -> DataFrame:
    """row, place, core: the marks that are not alone with all the phrases they are ranked by;
    with any further columns of ``marks``.

    ``marks`` has a row's number, a mark's place in it, its number of phrases and the rank of
    its first ``step`` phrases (of all, or of its few bytes, where there are fewer).
    """
    alive, done = marks, []
    more = [c for c in marks.columns if c not in ("row", "place", "phrases", "rank")]
    while True:
        alive = stored(_among(alive, _shared(alive, ["rank"]), ["rank"]))
        longest = alive.agg(F.max("phrases")).first()[0]
        if not done:
            done.append(alive.where(F.col("phrases") < step).select(
                "row", "place", F.col("rank").alias("core"), *more))
        if longest is None or longest < step:
            break
        # The rank a step further on; for the last pair, where its phrases end with the mark's.
        further = alive.where(F.col("phrases") >= step).select(
            F.col("row").alias("r"), F.col("place").alias("p"), F.col("rank").alias("next"))
        ahead = F.least(F.col("phrases") - step, F.lit(step))
        pairs = alive.where(F.col("phrases") >= step).withColumn("p", F.col("place") + ahead)
        pairs = stored(pairs.join(further.withColumnRenamed("r", "row"), ["row", "p"]))
        done.append(pairs.where(F.col("phrases") < 2 * step).select(
            "row", "place", F.xxhash64("phrases", "rank", "next").alias("core"), *more))
        alive = pairs.where(F.col("phrases") >= 2 * step).select(
            "row", "place", "phrases", F.xxhash64("rank", "next").alias("rank"), *more)
        step *= 2
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    return stored(_among(settled, _shared(settled, ["core"]), ["core"]))


def repeated_strings(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, strings: for documents that hold repeated strings, the ranges (begin,
    end; inclusive) of the starts of all of them.

    A document is known by its doc_id and the digest of its text; equal rows share them, and
    then all their strings are repeated.
    """
    marks = stored(map_arrow(
        docs.withColumn("row", F.monotonically_increasing_id()), _marks(length),
        "row bigint, doc_id bigint, digest bigint, place int, phrases int, rank bigint, "
        "reach bigint, first int, last int, anchor int"))
    owners = marks.where("place = 0").select("row", *MARK)
    alive = doubled(marks.drop(*MARK), START).where("first <= last")
    whole, around = _by_reach(alive, ["row"])
    runs = stored(map_arrow(_texts_with(docs, _of_documents(around, owners, "at")), _runs(length),
                            POSITIONS + ", core bigint"))
    more, around = _by_reach(runs, MARK)
    strings = stored(map_arrow(_texts_with(docs, around), _strings(length),
                               "doc_id bigint, digest bigint, begin int, string binary"))
    single = _among(strings, _shared(strings, ["string"]), ["string"]).select(
        *MARK, "begin", F.col("begin").alias("end"))
    ranges = F.collect_list(F.struct("begin", "end")).alias("strings")
    return _of_documents(whole.groupBy("row").agg(ranges), owners, "strings").unionByName(
        more.union(single).groupBy(*MARK).agg(ranges)).groupBy(*MARK).agg(
        F.flatten(F.collect_list("strings")).alias("strings"))


def _of_documents(rows: DataFrame, owners: DataFrame, lists: str) -> DataFrame:
    """The lists by document instead of by row; equal rows are one document."""
    return rows.join(owners, "row").groupBy(*MARK).agg(
        F.flatten(F.collect_list(lists)).alias(lists))


def _by_reach(rows: DataFrame, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """The ranges of starts whose whole reach is repeated; and, of each shared core with a reach
    that is alone, one position for each of its reaches, by document (``own``: the columns that name it)."""
    reach = ["core", "reach"]
    reaches = stored(rows.groupBy(*reach).agg(
        F.count("*").alias("times"),
        F.min(F.struct(*own, "first", "last", "anchor")).alias("one")))
    whole = _among(rows, reaches.where("times > 1").select(*reach, "times"), reach).select(
        *own, F.col("first").alias("begin"), F.col("last").alias("end"))
    ends = reaches.groupBy("core").agg(
        F.min("times").alias("least"), F.sum("times").alias("all"), F.count("*").alias("times")).where(
        "least = 1 and all > 1").select("core", "times")
    return whole, stored(_among(reaches, stored(ends), ["core"]).select("one.*").groupBy(*own).agg(
        F.collect_list(F.struct("first", "last", "anchor")).alias("at")))


def _filter(marks: DataFrame) -> np.ndarray:
    """Bits of all documents in a filter of fixed size; a set bit may stand for others, too."""
    words = marks.select(F.pmod("digest", F.lit(FILTER_BITS)).alias("bit")).groupBy(
        (F.col("bit") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toArrow()  # FILTER_BITS / 32 rows at most, some bytes each
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def _texts_with(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The documents that are marked, compressed, with their marks."""
    chosen = docs.sparkSession.sparkContext.broadcast(_filter(marks))
    return _joined(_squeezed(docs, chosen, True), marks, MARK)


def _digest(text: bytes) -> int:
    return _signed(xxhash.xxh64_intdigest(text, 9))


def _marks(length: int):
    """The marks of each text with the rank of their first START phrases and the reach of the
    strings whose first mark each is (0: of none). The first mark of a row names its document."""
    cuts = Marks(length)

    def run(batches):
        names = ["row", "doc_id", "digest", "place", "phrases", "rank", "reach", "first", "last",
                 "anchor"]
        for batch in _parts(batches):
            out, ready = [], 0
            for row, doc, text in zip(column(batch, "row").to_pylist(),
                                      column(batch, "doc_id").to_pylist(), utf8(batch)):
                at, first, last, phrases = cuts.of(np.frombuffer(text, np.uint8))
                n = len(at)
                if not n:
                    continue
                own = np.zeros(n, np.int64)
                own[0] = _digest(text)
                out.append((np.full(n, row), [doc] + [None] * (n - 1), own,
                            *(x.astype(np.int32) for x in (np.arange(n), phrases)),
                            _ranks(text, at, phrases, cuts.gram), _reaches(text, at, first, last, length),
                            *(x.astype(np.int32) for x in (first, last, at))))
                ready += n
                if ready > 100_000:
                    yield _together(out, names)
                    out, ready = [], 0
            if out:
                yield _together(out, names)

    return run


def _ranks(text: bytes, at: np.ndarray, phrases: np.ndarray, gram: int) -> np.ndarray:
    """The ranks of the marks: of START phrases, or of all where there are fewer."""
    digest = xxhash.xxh3_64_intdigest
    ends = at + gram
    ends[:-1] = np.where(phrases[:-1] > 0, ends[1:], ends[:-1])
    ranks = np.array([digest(text[a:b]) for a, b in zip(at.tolist(), ends.tolist())], np.uint64)
    step = 1
    while step < START:
        more = np.flatnonzero(phrases > step)  # the last pair overlaps
        ahead = np.minimum(phrases[more] - step, step)
        pairs = ranks[more] * np.uint64(0x9E3779B97F4A7C15) + ranks[more + ahead]
        pairs ^= pairs >> np.uint64(32)
        ranks[more] = pairs * np.uint64(0xD6E8FEB86659FD93)
        step *= 2
    few = np.minimum(phrases, START).astype(np.uint64)
    return (ranks ^ few * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)


def _reaches(text: bytes, at: np.ndarray, first: np.ndarray, last: np.ndarray,
             length: int) -> np.ndarray:
    """Digests of all bytes of the strings whose first mark each is."""
    digest, out = xxhash.xxh3_64_intdigest, np.zeros(len(at), np.uint64)
    some = np.flatnonzero(first <= last)
    # Where the mark lies in its reach counts, too.
    out[some] = np.array(
        [digest(text[b:e], a - b) for a, b, e in zip(
            at[some].tolist(), first[some].tolist(), (last[some] + length).tolist())], np.uint64)
    return out.view(np.int64)


def _together(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One batch of the columns of several texts; ids may be null."""
    columns = [pa.array([x for ids in c for x in ids], pa.int64()) if name == "doc_id"
               else pa.array(np.concatenate(c)) for name, c in zip(names, zip(*parts))]
    return pa.RecordBatch.from_arrays(columns, names)


def _rows(rows: list[tuple], *ranks: str) -> pa.RecordBatch:
    names = ("doc_id", "digest", "first", "last", "anchor", "reach", *ranks)
    small = ("first", "last", "anchor")
    return pa.RecordBatch.from_arrays(
        [pa.array(v, pa.int32() if n in small else pa.int64())
         for v, n in zip(zip(*rows) if rows else [[]] * len(names), names)], list(names))


def _squeezed(docs: DataFrame, chosen=None, wanted: bool = True) -> DataFrame:
    """doc_id, digest and the compressed text, for shuffles; with a filter only of documents
    that are in it, or only of those that are not."""
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in _parts(batches):
            rows = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), utf8(batch)):
                own = _digest(text)
                if chosen is not None:
                    bit = own % FILTER_BITS
                    if bool(chosen.value[bit // 32] >> np.uint32(bit % 32) & 1) != wanted:
                        continue
                rows.append((doc, own, squeeze(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(
                    zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.binary()))],
                ["doc_id", "digest", "blob"])

    return map_arrow(docs, run, "doc_id bigint, digest bigint, blob binary")


def _marked(batches):
    """Each document's id and digest, text and marked positions."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc, own, blob, at in zip(*(column(batch, c).to_pylist()
                                        for c in ("doc_id", "digest", "blob", "at"))):
            yield doc, own, expand(blob), at


def _runs(length: int):
    """The strings of each marked position in runs, by their distance from the anchor, so that
    equal strings fall into equal places of a run; with the bytes that all strings of a full
    run hold, and all bytes of those that are there."""
    size = max(1, min(RUN, length // 4))

    def run(batches):
        digest, out = xxhash.xxh3_64_intdigest, []
        for doc, own, text, at in _marked(batches):
            for x in at:
                a, first = x["anchor"], x["first"]
                while first <= x["last"]:
                    near = (a - first) // size * size
                    last = min(x["last"], a - near)
                    core = digest(text[a - near:a - near - size + 1 + length], near)
                    reach = digest(text[first:last + length], a - first)
                    out.append((doc, own, first, last, a, _signed(reach), _signed(core)))
                    first = last + 1
            if len(out) > 100_000:
                yield _rows(out, "core")
                out = []
        yield _rows(out, "core")

    return run


def _strings(length: int):
    """Every string of the marked positions, with a digest of 128 bits."""
    def run(batches):
        digest = xxhash.xxh3_128_digest
        for doc, own, text, at in _marked(batches):
            starts = np.concatenate([np.arange(x["first"], x["last"] + 1) for x in at])
            yield pa.RecordBatch.from_arrays([
                pa.array([doc] * len(starts), pa.int64()),
                pa.array(np.full(len(starts), own, np.int64)), pa.array(starts.astype(np.int32)),
                pa.array([digest(text[i:i + length]) for i in starts.tolist()], pa.binary())],
                ["doc_id", "digest", "begin", "string"])

    return run


def _cut(length: int, keep_text: bool):
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _parts(batches):
            rows = []
            for blob, ranges in zip(column(batch, "blob").to_pylist(),
                                    column(batch, "strings").to_pylist()):
                text, parts, at, spans, gone = expand(blob), [], 0, 0, 0
                for begin, end in sorted((r["begin"], r["end"] + length) for r in ranges or ()):
                    if begin > at or not spans:
                        parts.append(text[at:begin])
                        spans += 1
                        gone += end - begin
                        at = end
                    elif end > at:
                        gone += end - at
                        at = end
                parts.append(text[at:])
                kept = b"".join(parts)
                rows.append((len(text), gone, spans, hashlib.sha256(kept).hexdigest(),
                             kept if keep_text else None))
            columns = list(zip(*rows)) if rows else [[]] * 5
            arrays = [column(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]],
                      pa.array(columns[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                arrays.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_share (of its bytes; 0 where
    there are none) per document, and with ``keep_text`` the bytes that stay, as ``kept``.

    Texts are UTF-8 bytes, a null text is empty. Every byte goes that lies in a string of
    ``length`` bytes which also starts elsewhere, in the same document or another; strings do
    not reach over documents, may overlap themselves, and are judged on the input. Texts
    shorter than ``length`` keep everything. A text is cut in one piece: a very long one takes
    some forty bytes of memory a byte.
    """
    ship(docs.sparkSession)
    with small_batches(docs.sparkSession, HELD):
        return stored(_removed(documents_only(docs), length, keep_text))


def _removed(rows: DataFrame, length: int, keep_text: bool) -> DataFrame:
    found = stored(repeated_strings(rows, length))
    chosen = rows.sparkSession.sparkContext.broadcast(_filter(found))
    none = F.lit(None).cast(found.schema["strings"].dataType).alias("strings")
    texts = _squeezed(rows, chosen, False).select("doc_id", "digest", "blob", none).union(
        _joined(_squeezed(rows, chosen, True), found, MARK, "left"))
    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
              "kept_sha256 string" + ", kept binary" * keep_text)
    share = F.coalesce(F.try_divide("n_removed", "n_bytes"), F.lit(0.0)).alias("removed_share")
    return map_arrow(texts, _cut(length, keep_text), schema).select(
        *[c.split()[0] for c in schema.split(", ")[:5]], share, *["kept"] * keep_text)
