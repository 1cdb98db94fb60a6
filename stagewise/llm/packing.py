"""Packing: concatenate all documents' tokens and cut them into sequences of fixed length.

Two passes. The first tokenizes and stores the ids with each document's start inside its
partition; one total per partition gives, by a prefix sum, where each partition starts. The
second cuts every document at the multiples of the length and writes a boundary record per
piece. Nothing is shuffled but one total per partition.
"""

from __future__ import annotations

import os
import zlib
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_only, map_arrow, parts, stored, utf8

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
#: Words kept with their ids in a Python worker, in two generations, and their longest form.
CACHED_WORDS, CACHED_BYTES = 300_000, 64
#: Closing marks, without the apostrophe, which may begin a word's ending.
MARKS = b".,;:!?%$&*#)"
#: Byte-level tokenizers write a byte as the character of its number where that is visible, and
#: the other bytes in their order as the characters from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(_HIDDEN)}
_workers: dict = {}


class WordEncoder:
    """Encodes text word by word with a cache.

    For tokenizers that never join what ASCII white space parts (their pre-tokenizer drops
    white space), the ids of a text are those of its words in a row; where the tokenizer also
    parts words before closing marks and lower-cases them, so do we before the look-up.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new, self.old = {}, {}
        self.parts = self._parts_alike()

    def _parts_alike(self) -> bool:
        """Whether this is a lower-casing byte-level tokenizer that parts words before closing
        marks, so that far fewer words are different: tried on the marks and on some words."""
        def ids(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        words = ["Word", "x1", "É", "naïve", "Größe", "zażółć", "the", "antidisestablishment"]
        marks = [chr(c) for c in MARKS] + ["...", "?!", "%%%"]
        return all(ids(f"{w}{m}") == ids(w.lower()) + ids(m) for w in words for m in marks) \
            and all(self._direct(w.lower()) in (None, ids(w)) for w in words)

    def _direct(self, word: str) -> list[int] | None:
        """The ids of a lower-cased word that is one token to be merged: Latin letters only, on
        which the tokenizer's normaliser and splitter have nothing to do."""
        if not word.isalpha() or max(word) > "\u017f" or word != word.lower():
            return None
        return [t.id for t in self.tokenizer.model.tokenize(
            word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS))]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            words = (text.lower() if self.parts else text).split()
            found = list(map(self.new.get, words))
            if None in found:
                extra = self._learn({w for w, x in zip(words, found) if x is None})
                found = [self.new[w] if w in self.new else extra[w] for w in words]
            out.append(b"".join(found))
            if len(self.new) > CACHED_WORDS:
                self.old, self.new = self.new, {}
        return out

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Adds the words to the cache; returns those too long for it."""
        new, old, long, rest = self.new, self.old, {}, []
        for w in words:
            if w in old:
                new[w] = old[w]
            else:
                rest.append(w)
        cores = {w: _core(w) if self.parts else w for w in rest}
        parts = set(cores.values()) | {w[len(c):] for w, c in cores.items() if len(c) < len(w)}
        known, hard = {}, []
        for part in parts:
            ids = new.get(part) or old.get(part)
            if ids is None and self.parts:
                direct = self._direct(part.decode("utf-8", "replace"))
                ids = None if direct is None else array("I", direct).tobytes()
            if ids is None:
                hard.append(part)
            else:
                known[part] = ids
        encoded = self.tokenizer.encode_batch_fast(
            [part.decode("utf-8", "replace") for part in hard], add_special_tokens=False)
        known.update((part, array("I", e.ids).tobytes()) for part, e in zip(hard, encoded))
        for w, c in cores.items():
            ids = known[c] if len(c) == len(w) else known[c] + known[w[len(c):]]
            (new if len(w) <= CACHED_BYTES else long)[w] = ids
            if len(c) < len(w) and len(c) <= CACHED_BYTES:
                new[c] = known[c]
        return long


def _core(word: bytes) -> bytes:
    """The word without its closing marks, where these follow a letter or number (of the
    lower-cased word: one capital becomes a letter and a mark)."""
    core = word.rstrip(MARKS)
    if len(core) == len(word) or not core:
        return word
    return core if core[-20:].decode("utf-8", "ignore").lower()[-1:].isalnum() else word


def encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: which ids of a document lie where in which sequence.

    ``tokenizer`` is the path of a tokenizer file on every executor. A document is its ids and
    ``end_id``, so an empty or null text still has one id. Sequences are full but for the
    last. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    ids = tokenized(docs, tokenizer, end_id)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    starts = [0, *accumulate(r["n"] for r in totals)]
    bases = ids.sparkSession.createDataFrame(
        [(r["part"], s) for r, s in zip(totals, starts)], "part int, base bigint")
    placed = ids.join(F.broadcast(bases), "part").select(  # a row per partition
        "doc_id", "ids", (F.col("base") + F.col("local")).alias("at"))
    return map_arrow(placed, _cutter(length), PIECES)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Stored table: doc_id, ids (two bytes each where they all fit), n, part, and the ids
    before the document in its partition."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        part, local, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode
        for batch in chain.from_iterable(map(parts, batches)):
            blobs = [x + end for x in encode(utf8(batch))]
            counts = [len(x) // 4 for x in blobs]
            begins = [local, *accumulate(counts, initial=local)][1:-1] if counts else []
            local += sum(counts)
            yield pa.RecordBatch.from_arrays([
                column(batch, "doc_id"),
                pa.array([_narrow(x) for x in blobs], pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array([part] * len(counts), pa.int32()),
                pa.array(begins, pa.int64()),
            ], ["doc_id", "ids", "n", "part", "local"])

    return stored(map_arrow(documents_only(docs), run,
                            "doc_id bigint, ids binary, n bigint, part int, local bigint"))


def _narrow(blob: bytes) -> bytes:
    """A mark and the ids, in two bytes each if they fit."""
    ids = np.frombuffer(blob, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if ids.max() < 65536 else b"\4" + blob


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u2" if blob[0] == 2 else "<u4", offset=1).astype("<u4")


def _cutter(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, blob, at in zip(column(batch, "doc_id").to_pylist(),
                                     column(batch, "ids").to_pylist(),
                                     column(batch, "at").to_pylist()):
                ids = _wide(blob)
                start = 0
                while start < len(ids):
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, len(ids) - start)
                    crc = zlib.crc32(ids[start:start + size].tobytes())
                    rows.append((doc, start, size, crc, len(ids), sequence, offset))
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                 "offset"])

    return run
