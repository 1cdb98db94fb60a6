"""SentencePiece encoding and decoding as shortest paths of a weighted transducer.

Compiled from a model file: the normaliser (the longest match in the model's table of
replacements, then spaces become the mark, one in front), an arc per piece with its score as
weight, and arcs that spell any other character with its bytes. The model's own symbols are
never replaced; byte-pair models cut the input at them. The transducer is composed with an input on the fly: a state of the composition is a place in the
input and the last piece, and the tropical-semiring shortest path is the encoding.

In a byte-pair model the weights alone do not give the right pieces, as merges are greedy. Its
transducer therefore has an arc from one piece to the next only where merging the two pieces'
text alone gives these two pieces again. A path all of whose arcs are of this kind is what the
merges make of the whole input, so exactly one path is left.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stagewise.llm.common import column, documents_only, map_arrow, utf8

MARK = "▁"
# Numbers of the fields and kinds in a model file.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Inputs whose encoding a worker keeps (two generations), and pairs of pieces it has tried.
CACHED, PAIRS = 300_000, 600_000


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; values are integers or bytes."""
    at = 0

    def number():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size


class Replacements:
    """A model's table of replacements: the size of a trie in bytes, the trie as a double array
    of 32-bit units, and the replacing strings, each ended by a zero byte."""

    def __init__(self, table: bytes):
        size = struct.unpack_from("<I", table)[0]
        self.trie = np.frombuffer(table, "<u4", size // 4, 4).tolist()
        self.strings = table[4 + size:]
        self.longest = lru_cache(maxsize=1 << 16)(self._longest)
        #: Characters that begin no entry of the trie's first level stay as they are.
        self.first = re.compile(b"[" + b"".join(
            re.escape(bytes([c])) for c in range(256) if self._child(self._below(0), c)) + b"]")

    def _below(self, at: int) -> int:
        unit = self.trie[at]
        return at ^ unit >> 10 << ((unit & 512) >> 6)

    def _child(self, at: int, byte: int) -> bool:
        place = at ^ byte
        return place < len(self.trie) and self.trie[place] & 0x800000FF == byte

    def _longest(self, data: bytes) -> tuple[int, bytes]:
        """Length of the longest entry that the bytes begin with (0: none), and what replaces it."""
        at, length, found = self._below(0), 0, b""
        for n, byte in enumerate(data, 1):
            if not self._child(at, byte):
                break
            place = at ^ byte
            at = self._below(place)
            if self.trie[place] >> 8 & 1:
                begin = self.trie[at] & 0x7FFFFFFF
                length, found = n, self.strings[begin:self.strings.index(b"\0", begin)]
        return length, found

    def apply(self, text: str) -> str:
        data, out, at = text.encode(), [], 0
        while match := self.first.search(data, at):
            begin = match.start()
            out.append(data[at:begin])
            length, found = self.longest(data[begin:begin + 32])
            if not length:  # the whole character stays
                length = 1 + (data[begin] >= 0xC0) + (data[begin] >= 0xE0) + (data[begin] >= 0xF0)
                found = data[begin:begin + length]
            out.append(found)
            at = begin + length
        out.append(data[at:])
        return b"".join(out).decode("utf-8", "replace")


class Transducer:
    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == PIECES:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                normalizer = dict(_fields(value))
        self.merging = trainer.get(3, UNIGRAM) == BPE
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE) or trainer.get(24):
            raise ValueError("only unigram and byte-pair models with the mark in front of words")
        if not normalizer.get(5, 1):
            raise ValueError("only models that write spaces as marks")
        self.replaced = Replacements(normalizer[2]) if normalizer.get(2) else None
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.arcs = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds))
                     if kind == NORMAL}
        own = {p: k for k, (p, kind) in enumerate(zip(self.pieces, self.kinds)) if kind == USER}
        self.symbols = re.compile("(" + "|".join(
            map(re.escape, sorted(own, key=len, reverse=True))) + ")") if own else None
        self.own = own
        weights = [self.scores[k] for k in self.arcs.values()]
        self.bytes = {int(p[1:-1], 16): k for k, (p, kind) in
                      enumerate(zip(self.pieces, self.kinds)) if kind == BYTE}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.penalty = 10 - min(weights, default=0.0)
        if not self.merging:  # an own symbol weighs a little more than as many best pieces
            self.arcs |= own
            for p, k in own.items():
                self.scores[k] = len(p.encode()) * max(weights, default=0.0) - 0.1
        self.longest = max(map(len, self.arcs), default=1)
        lost = trainer.get(44, " \u2047 ".encode())
        self.spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else
                        lost if kind == UNKNOWN else b"" if kind == CONTROL else p.encode()
                        for p, kind in zip(self.pieces, self.kinds)]
        joined = any(MARK in p.lstrip(MARK) for p in self.arcs)
        broken = "".join(c for c in "\n\r\t" if not any(c in p for p in self.arcs))
        # No piece reaches over the end of a unit, so units are encoded one by one.
        self.units = re.compile("(?s).+" if joined else
                                f"{MARK}+[^{MARK}{broken}]*|[^{MARK}{broken}]+|[{broken or MARK}]")
        self.tried: dict[int, bool] = {}
        if self.merging:
            self._merge_order()
        self.new, self.old = {}, {}

    def normalise(self, text: str) -> str:
        if self.replaced and self.symbols:
            parts = self.symbols.split(text)
            parts[::2] = map(self.replaced.apply, parts[::2])
            text = "".join(parts)
        elif self.replaced:
            text = self.replaced.apply(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", MARK)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        text, out = self.normalise(text), []
        if self.symbols and self.merging:
            parts = self.symbols.split(text)
            for part, symbol in zip(parts[::2], parts[1::2]):
                out += [*self._encoded(part), struct.pack("<I", self.own[symbol])]
            text = parts[-1]
        out += self._encoded(text)
        ids = b"".join(out)
        if len(self.bytes) < 256:  # unknown characters in a row are one unknown piece
            numbers = np.frombuffer(ids, "<u4")
            lost = numbers == self.unknown
            ids = numbers[~(lost & np.r_[False, lost[:-1]])].tobytes() if lost.any() else ids
        return ids

    def _encoded(self, text: str) -> list[bytes]:
        """The ids of each unit of a normalised text."""
        out = []
        for unit in self.units.findall(text):
            ids = self.new.get(unit)
            if ids is None:
                ids = self.old.get(unit)
                if ids is None:
                    ids = np.array(self.shortest_path(unit), "<u4").tobytes()
                if len(self.new) > CACHED:
                    self.old, self.new = self.new, {}
                if len(unit) <= 64:
                    self.new[unit] = ids
            out.append(ids)
        return out

    def shortest_path(self, unit: str) -> list[int]:
        """The ids of the best path from the first to the last place of the unit."""
        if not self.merging:
            return self._lightest_path(unit)
        if not self.ordered:
            return [k for piece in self._merged(unit, 1) for k in self.spell(piece)]
        return self._only_path(unit)

    def _lightest_path(self, unit: str) -> list[int]:
        """States are places only, as any piece may follow any other. Of equally light paths to
        a place the one whose last piece is longest is taken; the library's choice depends on
        how it rounds."""
        arcs, n = self.arcs, len(unit)
        weight, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - self.longest), end):
                key = arcs.get(unit[begin:end])
                if key is None and begin < end - 1:
                    continue
                cost = weight[begin] + (self.penalty if key is None else -self.scores[key])
                if cost < weight[end]:
                    weight[end], came[end] = cost, begin
        return self._spelled(unit, came)

    def _only_path(self, unit: str) -> list[int]:
        """All weights are zero and one path is left, so the first one found to the end is it.

        The walk takes the longest arc first. A place from which it did not reach the end is
        not tried again: all ways to a place end in the same piece.
        """
        n, follows, tried = len(unit), self.follows, self.tried
        place, last, dead = 0, -1, set()
        path, left = [], [self._arcs_at(unit, 0)]
        while place < n:
            while left[-1]:
                end, key = left[-1].pop()
                if end in dead:
                    continue
                if last < 0 or key < 0:
                    break
                pair = last << 32 | key
                fits = tried.get(pair)
                if fits is None:
                    fits = tried[pair] = follows(last, key)
                if fits:
                    break
            else:
                dead.add(place)
                left.pop()
                place, last = path.pop()
                continue
            path.append((place, last))
            place, last = end, key
            if place < n:
                left.append(self._arcs_at(unit, place))
        if len(tried) > PAIRS:
            tried.clear()
        cuts = [p for p, _ in path] + [n]
        return [k for a, b in zip(cuts, cuts[1:]) for k in self.spell(unit[a:b])]

    def _arcs_at(self, unit: str, begin: int) -> list[tuple[int, int]]:
        """End and id of every arc at a place, the longest last; -1: a character without piece."""
        known, found = self.prefixes, []
        for end in range(begin + 1, len(unit) + 1):
            key = known.get(unit[begin:end])
            if key is None:
                break
            if key >= 0:
                found.append((end, key))
        return found if found and found[0][0] == begin + 1 else [(begin + 1, -1), *found]

    def _spelled(self, unit: str, came: list[int]) -> list[int]:
        out, end = [], len(unit)
        while end:
            out.append(unit[came[end]:end])
            end = came[end]
        return [k for piece in reversed(out) for k in self.spell(piece)]

    def spell(self, piece: str) -> list[int]:
        key = self.arcs.get(piece)
        if key is not None:
            return [key]
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in piece.encode()]
        return [self.unknown]

    def _merge_order(self) -> None:
        """Per piece when it is merged (0: a character), its two parts, and whether merging its
        own text gives it at all."""
        order = sorted((k for p, k in self.arcs.items() if len(p) > 1),
                       key=lambda k: -self.scores[k])
        self.turn, self.parts = [0] * len(self.pieces), [None] * len(self.pieces)
        self.whole = [len(p) == 1 for p in self.pieces]
        for turn, k in enumerate(order, 1):
            self.turn[k] = turn
        for k in order:
            parts = self._merged(self.pieces[k], 2)
            if len(parts) == 2 and parts[0] in self.arcs and parts[1] in self.arcs:
                self.whole[k], self.parts[k] = True, (self.arcs[parts[0]], self.arcs[parts[1]])
        # Undoing merges from the last on needs parts that are merged before what they make; a
        # file that was not trained may have others, and is merged step by step.
        self.ordered = all(self.turn[part] < self.turn[k]
                           for k in order if self.parts[k] for part in self.parts[k])
        self.prefixes = {p[:n]: -1 for p in self.arcs for n in range(1, len(p))}
        self.prefixes |= {p: k for p, k in self.arcs.items() if self.whole[k]}

    def _merged(self, text: str, least: int) -> list[str]:
        """Greedy merging until so many parts are left or none fit: always the best-scored pair,
        the first of equals."""
        parts, arcs, turn = list(text), self.arcs, self.turn
        while len(parts) > least:
            best, at = None, -1
            for k in range(len(parts) - 1):
                key = arcs.get(parts[k] + parts[k + 1])
                if key is not None and (best is None or turn[key] < best):
                    best, at = turn[key], k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text leaves them as they are: their merges are undone
        from the last on, and none may join the parts at the border at an earlier turn."""
        pieces, arcs, turn, parts = self.pieces, self.arcs, self.turn, self.parts
        limit = len(pieces)
        while True:
            joined = arcs.get(pieces[left] + pieces[right])
            if joined is not None and turn[joined] < limit:
                return False
            if turn[left] > turn[right]:
                limit, left = turn[left], parts[left][1]
            elif turn[right]:
                limit, right = turn[right] + 1, parts[right][0]
            else:
                return True

    def decode(self, ids: bytes) -> str:
        spelled = self.spelled
        raw = b"".join([spelled[k] for k in np.frombuffer(ids, "<u4").tolist()])
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, packed) per document; an empty or null text
    has none. ``model`` is the path of a SentencePiece file on every executor."""
    def run(batches):
        transducer = compiled(model)
        for batch in batches:
            ids = [transducer.encode(t.decode("utf-8", "replace")) for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_arrow(documents_only(docs), run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids count as none."""
    def run(batches):
        transducer = compiled(model)
        for batch in batches:
            texts = [transducer.decode(x or b"") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256 and whether decoding gave the
    text back, per document, in one pass. A text that holds the mark itself, or the replacement
    of broken UTF-8, does not come back as it was; that is the model's rule."""
    def run(batches):
        transducer = compiled(model)
        is_byte = np.array([kind == BYTE for kind in transducer.kinds])
        for batch in batches:
            rows = []
            for text in utf8(batch):
                ids = transducer.encode(text.decode("utf-8", "replace"))
                decoded = transducer.decode(ids).encode()
                numbers = np.frombuffer(ids, "<u4")
                rows.append((len(numbers), int(is_byte[numbers].sum()), zlib.crc32(ids),
                             hashlib.sha256(decoded).hexdigest(), decoded == text))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_sha256",
                 "round_trip"])

    return map_arrow(documents_only(docs), run, (
        "doc_id bigint, n_pieces bigint, n_byte_pieces bigint, ids_crc32 bigint, "
        "decoded_sha256 string, round_trip boolean"))
