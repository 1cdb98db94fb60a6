"""Line dedup with a segment-partition edit join.

Two lines at an edit distance of at most t share one of the t + 1 segments that either is split
into, up to a small shift that depends on the lengths. So every line is indexed under its
segments and probes the segments of lines as long as itself or up to t shorter, and lines that
meet are verified by a banded bit-parallel edit distance. Lines that are linked, directly or
through others, are one class, and only its first line in the corpus stays.

A segment that very many lines share is refined instead of paired: with one edit allowed, its
lines must agree in one half of the rest too, and so on until the groups are small or one
character is left, where all members are linked by one star.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.llm.common import (
    column,
    documents_only,
    map_arrow,
    parts,
    ship,
    stored,
    utf8,
)
from stagewise.llm.components import components

#: Shorter lines (after normalisation) never count as duplicates.
LEAST_CHARS = 20
#: Lines under one segment up to which they are verified pair by pair.
PAIRED = 32
#: Bits of the filter that says which lines' texts may be needed.
FILTER_BITS = 1 << 24


def normalised(line: str) -> str:
    return " ".join(line.split()).lower()


def line_id(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Bit d of state e says that with e edits, of b as much is read as steps were made, and of a
    d - most characters more. Only these 2 * most + 1 diagonals are kept.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    shortest, start = min(n, m), 0
    while start < shortest and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end, shortest = 0, shortest - start
    while end < shortest and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[:len(a) - end], b[:len(b) - end]
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + most)
    band = (1 << (2 * most + 1)) - 1
    states = [((1 << (e + 1)) - 1) << most & band for e in range(most + 1)]
    for j, c in enumerate(b):
        same = places.get(c, 0) >> j & band
        before, states = states, [states[0] & same]
        for e in range(1, most + 1):
            states.append((before[e] & same | before[e - 1] | before[e - 1] >> 1
                           | states[e - 1] << 1) & band)
        if not states[-1]:
            return False
    return bool(states[most] >> (len(a) - len(b) + most) & 1)


def segments(n: int, count: int) -> list[tuple[int, int]]:
    """Start and size of the segments of a text of n characters, the longer ones last."""
    small, longer = divmod(n, count)
    out, at = [], 0
    for k in range(count):
        size = small + (k >= count - longer)
        out.append((at, size))
        at += size
    return out


def keys(text: str, most: int, low: int = 0, high: int = 0, salt: int = 0):
    """(key, is indexed, low, high) of all segments under which the text stands.

    Only the part without the first ``low`` and the last ``high`` characters is split; the
    returned low and high leave out the segment too, where one edit is allowed.
    """
    digest, n = xxhash.xxh3_64_intdigest, len(text) - low - high
    for short in range(max(0, n - most), n + 1):
        shift = n - short
        for k, (at, size) in enumerate(segments(short, most + 1)):
            first = max(at - k, at + shift - (most - k))
            last = min(at + k, at + shift + (most - k))
            for begin in range(max(0, first), min(last, n - size) + 1):
                piece = text[low + begin:low + begin + size]
                mark = digest(f"{salt}:{short}:{k}:{piece}".encode())
                mark -= (mark >> 63) << 64
                rest = (low + size, high) if k == 0 else (low, high + size)
                yield mark, not shift and begin == at, *rest


def _line_batches(batches, least: int):
    """Per document of each batch its row number and its long enough lines."""
    for batch in batches:
        for row, text in enumerate(utf8(batch)):
            if text:
                lines = text.decode("utf-8", "replace").split("\n")
                yield batch, row, [(k, x) for k, x in
                                   enumerate(map(normalised, lines)) if len(x) >= least]


def doc_key(doc_id: int | None, text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(f"{doc_id}:".encode() + text)


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """Stored: doc, doc_id, line (number from 0), id of every long enough line."""
    def run(batches):
        for batch in chain.from_iterable(map(parts, batches)):
            rows, ids = ([], [], [], []), column(batch, "doc_id").to_pylist()
            texts = utf8(batch)
            for _, row, lines in _line_batches([batch], least):
                own = doc_key(ids[row], texts[row])
                for k, x in lines:
                    for out, value in zip(rows, (own, ids[row], k, line_id(x))):
                        out.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(
                    rows, (pa.binary(), pa.int64(), pa.int32(), pa.binary()))],
                ["doc", "doc_id", "line", "id"])

    return stored(map_arrow(docs, run, "doc binary, doc_id bigint, line int, id binary"))


STANDING = "key bigint, id binary, low int, high int, indexed boolean"


def _standing(texts: DataFrame, most: int, least: int) -> DataFrame:
    """Where each line of the documents stands, once per batch."""
    def run(batches):
        for batch in batches:
            seen = set()
            for part in parts(batch):
                rows = []
                for _, _, lines in _line_batches([part], least):
                    for _, x in lines:
                        own = line_id(x)
                        if own not in seen:
                            seen.add(own)
                            rows += [(mark, own, low, high, inside)
                                     for mark, inside, low, high in keys(x, most)]
                yield _table(rows, ("key", "id", "low", "high", "indexed"))

    return map_arrow(texts, run, STANDING)


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "id": pa.binary(), "low": pa.int32(), "high": pa.int32()}
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kinds.get(n, pa.bool_()))
         for v, n in zip(zip(*rows) if rows else [[]] * len(names), names)], list(names))


def _shared_keys(rows: DataFrame) -> DataFrame:
    """The rows under keys where an indexed line meets another one, without repetitions."""
    half = F.xxhash64("id")
    busy = rows.groupBy("key").agg(
        F.min(half).alias("a"), F.max(half).alias("b"), F.bool_or("indexed").alias("any")).where(
        "a <> b and any").select("key")
    columns = [c for c in rows.columns if c != "indexed"]
    return rows.join(busy, "key", "left_semi").groupBy(*columns).agg(
        F.bool_or("indexed").alias("indexed"))


def _filter(ids: DataFrame) -> np.ndarray:
    """Bits of all ids in a filter of fixed size; a set bit may also stand for another id."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = ids.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    found = words.toArrow()  # FILTER_BITS / 32 rows at most, some bytes each
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def _texts(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """Stored: id, x (the line) of the given ids."""
    chosen = docs.sparkSession.sparkContext.broadcast(_filter(ids))
    seed = 42  # of Spark's own hash function

    def run(batches):
        for batch in batches:
            seen = set()
            for part in parts(batch):
                found = {}
                for _, _, lines in _line_batches([part], least):
                    for _, x in lines:
                        own = line_id(x)
                        bit = xxhash.xxh64_intdigest(own, seed)
                        bit = (bit - ((bit >> 63) << 64)) % FILTER_BITS
                        if own not in seen and chosen.value[bit // 32] >> np.uint32(bit % 32) & 1:
                            found[own] = x
                seen.update(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.binary()),
                     pa.array(list(found.values()), pa.string())], ["id", "x"])

    rows = map_arrow(docs, run, "id binary, x string").join(ids, "id", "left_semi")
    return stored(rows.dropDuplicates(["id"]))


def links(docs: DataFrame, most: int, least: int) -> DataFrame:
    """u, v: pairs of line ids that connect all lines at an edit distance of 1 to ``most``."""
    # Written once: the keys are used twice, and making them costs more than reading them.
    level = stored(_shared_keys(stored(_standing(docs, most, least))))
    texts = _texts(docs, level.select("id").distinct(), least)
    if most > 1:
        return stored(_verified(level, texts, most))
    found = []
    while True:
        sized = level.join(level.groupBy("key").agg(F.count("*").alias("n")), "key")
        found.append(stored(_verified(sized.where(F.col("n") <= PAIRED), texts, most)))
        hot = sized.where(F.col("n") > PAIRED).drop("n")
        if hot.isEmpty():
            break
        level, stars = _refined(hot, texts)
        found.append(stars)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def _verified(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Links among the lines that stand under a key with an indexed one."""
    one = rows.where("indexed").select("key", F.col("id").alias("u"))
    two = rows.select("key", F.col("id").alias("v"), "indexed")
    pairs = one.join(two, "key").where("u < v or (u > v and not indexed)").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    with_texts = pairs.join(texts.select(F.col("id").alias("u"), F.col("x").alias("a")), "u").join(
        texts.select(F.col("id").alias("v"), F.col("x").alias("b")), "v")

    def run(batches):
        for batch in batches:
            near = [within(a, b, most) for a, b in zip(
                column(batch, "a").to_pylist(), column(batch, "b").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return map_arrow(with_texts.select("u", "v", "a", "b"), run, "u binary, v binary")


def _refined(hot: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next level's rows under shared keys, and the links of parts that need no next one.

    Under one key the texts are equal outside their parts without ``low`` and ``high``; the
    parts of indexed lines have one length, those of the others are longer by one.
    """
    def run(batches):
        for batch in batches:
            out = []
            for key, own, low, high, indexed, x in zip(*(
                    column(batch, c).to_pylist() for c in
                    ("key", "id", "low", "high", "indexed", "x"))):
                part = x[low:len(x) - high]
                shorter = len(part) if indexed else len(part) - 1
                if shorter > 1:
                    out += [(mark, own, l2, h2, indexed, False)
                            for mark, inside, l2, h2 in keys(x, 1, low, high, key)
                            if inside == indexed]
                    continue
                if indexed or not shorter:
                    out.append((key, own, 0, 0, indexed, True))
                if shorter:
                    for c in {part} if indexed else {part[1:], part[:1]}:
                        mark = xxhash.xxh3_64_intdigest(f"{key}={c}".encode())
                        out.append((mark - ((mark >> 63) << 64), own, 0, 0, indexed, True))
            yield _table(out, ("key", "id", "low", "high", "indexed", "ended"))

    rows = stored(map_arrow(
        hot.join(texts, "id").select("key", "id", "low", "high", "indexed", "x"), run,
        STANDING + ", ended boolean"))
    ended = rows.where("ended").select("key", "id", "indexed").distinct()
    centre = ended.where("indexed").groupBy("key").agg(F.min("id").alias("u"))
    stars = ended.join(centre, "key").where("id <> u").select("u", F.col("id").alias("v"))
    return stored(_shared_keys(rows.where("not ended").drop("ended"))), stored(stars.distinct())


def duplicate_lines(docs: DataFrame, most: int = 1, least: int = LEAST_CHARS) -> DataFrame:
    """doc, lines: per document (by its key) the numbers of the lines that are not the first of
    their class, in the order of doc_id (null last), key and line number."""
    rows = documents_only(docs)
    seen = occurrences(rows, least)
    order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "doc", "line")
    firsts = seen.groupBy("id").agg(F.min(order).alias("best"), F.count("*").alias("n"))
    classes = components(links(rows, most, least))
    several = stored(firsts.join(classes, F.col("id") == F.col("node"), "left").where(
        "n > 1 or component is not null").select(
        "id", "best", F.coalesce("component", "id").alias("component")))
    best = several.groupBy("component").agg(F.min("best").alias("kept"))
    kept = several.join(best, "component").select("id", "kept")
    return seen.join(kept, "id").where(order != F.col("kept")).groupBy("doc").agg(
        F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, most: int = 1, least: int = LEAST_CHARS) -> DataFrame:
    """The documents with every line removed that repeats an earlier one or differs from one by
    at most ``most`` edits, directly or through others; all rows and columns stay.

    Lines end at newlines and are compared lower-cased with white space squeezed. Lines of
    fewer than ``least`` characters always stay. A document may lose all its lines; a null
    text stays null. Repeated rows (same id and text) are one document. A column n_chars
    follows the new text.
    """
    ship(docs.sparkSession)
    names, kinds = docs.columns, docs.schema
    packed = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "text" else f
                           for f in kinds] + [T.StructField("__doc", T.BinaryType())])
    plain = docs.withColumn("text", F.col("text").cast("string")).withColumn(
        "doc_id", F.col("doc_id").cast(kinds["doc_id"].dataType))
    at = names.index("text")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in chain.from_iterable(map(parts, batches)):
            texts = utf8(batch)
            ids = column(batch, "doc_id").to_pylist()
            arrays = batch.columns
            arrays[at] = pa.array([None if t is None else squeeze(t) for t in texts], pa.binary())
            keys = [doc_key(None if i is None else int(i), t or b"") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.binary())],
                                             [*names, "__doc"])

    def unpack(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in chain.from_iterable(map(parts, batches)):
            texts = []
            for blob, drop in zip(column(batch, "text").to_pylist(),
                                  column(batch, "__lines").to_pylist()):
                text = None if blob is None else expand(blob).decode("utf-8", "replace")
                if drop:
                    drop = set(drop)
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                texts.append(text)
            arrays = batch.columns[:len(names)]
            arrays[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                arrays[k] = pa.array([None if t is None else len(t) for t in texts],
                                     pa.int64()).cast(arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names)

    found = duplicate_lines(docs, most, least).select(
        F.col("doc").alias("__doc"), F.col("lines").alias("__lines"))
    joined = map_arrow(plain, pack, packed).join(found, "__doc", "left")
    return map_arrow(joined.select(*[F.col(f"`{n}`") for n in names], "__lines"), unpack, kinds)


def deduplicated_digest(docs: DataFrame, most: int = 1, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_kept_lines, n_kept_chars, kept_sha256 of every document's text after
    the dedup; an empty text has one line, a text without lines left none."""
    rows = documents_only(docs)
    count = F.size(F.split("text", "\n", -1))
    counted = rows.select("doc_id", "text", count.cast("bigint").alias("n_lines"))
    kept = dedup_lines(counted, most, least)
    left = F.when((F.col("text") == "") & (F.col("n_lines") > 1), 0).otherwise(count)
    return kept.select("doc_id", "n_lines", left.cast("bigint").alias("n_kept_lines"),
                       F.length("text").cast("bigint").alias("n_kept_chars"),
                       F.sha2("text", 256).alias("kept_sha256"))
