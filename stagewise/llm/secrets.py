"""Secret scans with recursive decoding.

Each text is the first layer of a worklist. A layer is searched for secrets; then URL escapes,
Unicode escapes, base64 and hex blobs, compressed data and 16-bit text in it are unwrapped into
further layers, whatever the layer itself came from, until nothing new appears. Layers already
seen are not searched again, which ends cycles. Every layer knows which characters of the whole text each of its characters came from,
so findings are reported as spans of the text itself: byte by byte through escapes, base64 and
hex; a compressed stream only as a whole.

What is looked for is ASCII, so decoded bytes are taken as one character each, and need not be
readable throughout. Base64 is tried at all four alignments, since a blob may follow other
characters of its alphabet, and over line ends.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_only, map_arrow, ship, utf8

KINDS = ("assign", "access", "hex")
# What the three kinds of secret look like.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bytes of unfolded data searched at a time, and those searched again with the next piece.
PIECE, OVERLAP = 1 << 24, 1 << 16

PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|"
                    r"\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BLOB = re.compile(r"[A-Za-z0-9+/_-]{16,}")
# Only from the first character of a line on, else a long line is read from each of its characters.
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+")
HEXES = re.compile(r"[0-9A-Fa-f]{16,}")
#: What makes decoded bytes worth a layer: a secret or something to unwrap.
WORTH = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)|AKIA|%[0-9A-Fa-f]{2}|\\[uUx]|&#|"
    rb"[A-Za-z0-9+/_-]{16}")
#: What compressed data begins with: gzip, zlib with any window, bzip2, xz and lzma, Zstandard.
STREAM = re.compile(
    rb"\x1f\x8b\x08|\x08[\x1d\x5b\x99\xd7]|\x18[\x19\x57\x95\xd3]|\x28[\x15\x53\x91\xcf]|"
    rb"\x38[\x11\x4f\x8d\xcb]|\x48[\x0d\x4b\x89\xc7]|\x58[\x09\x47\x85\xc3]|"
    rb"\x68[\x05\x43\x81\xde]|\x78[\x01\x5e\x9c\xda]|BZh[1-9]\x31\x41\x59|\xfd7zXZ\x00|"
    rb"\x5d\x00\x00[\x00\x10\x20\x40\x80][\x00-\x08]|\x28\xb5\x2f\xfd")
STREAM_IN_TEXT = re.compile(STREAM.pattern.decode("latin-1"))
#: Characters of 16 bits, so many in a row: every other byte is zero.
WIDE = 8
WIDE_TEXT = re.compile(rb"(?s)(?:.\0){%d}|(?:\0.){%d}" % (WIDE, WIDE))
#: Blobs at the end of a piece, which may go on in the next one, read backwards.
LAST_BLOB = re.compile(rb"[A-Za-z0-9+/_\s-]*")
_FROM_URL = str.maketrans("-_", "+/")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the secrets in one layer as it stands."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def scan(text: str) -> tuple[list, list]:
    """Base findings and all findings, each sorted by start, kind and end."""
    base = find(text)
    found = set(base)
    work, seen = [(text, None)], set()
    while work:
        layer, where = work.pop()
        for inner, starts, ends in _unwrap(layer):
            if where is not None:
                starts, ends = where[0][starts], where[1][ends - 1]
            place = (hashlib.blake2b(inner.encode("utf-8", "surrogatepass")).digest(),
                     int(starts[0]), int(ends[-1]))
            if place in seen:
                continue
            seen.add(place)
            for start, kind, end in find(inner):
                found.add((int(starts[start]), kind, int(ends[end - 1])))
            work.append((inner, (starts, ends)))
    return sorted(base), sorted(found)


def _unwrap(layer: str):
    """Layers one step inside this one, with the start and the end in this layer of what each
    of their characters came from."""
    if "%" in layer:
        yield from _replaced(layer, PERCENT, lambda m: chr(int(m[1], 16)))
    if "\\" in layer or "&#" in layer:
        yield from _replaced(layer, ESCAPE, _character)
    for m in BLOB.finditer(layer):
        yield from _base64(m[0], np.arange(m.start(), m.end()))
    if "\n" in layer:
        for m in WRAPPED.finditer(layer):
            at = np.array([i for i, c in enumerate(m[0], m.start()) if not c.isspace()])
            yield from _base64("".join(m[0].split()), at)
    for m in HEXES.finditer(layer):
        for phase in (0, 1):
            digits = m[0][phase:]
            digits = digits[:len(digits) // 2 * 2]
            first = m.start() + phase + 2 * np.arange(len(digits) // 2)
            yield from _layers(bytes.fromhex(digits), first, first + 2)
    if "\0" in layer or STREAM_IN_TEXT.search(layer):
        data = layer.encode("latin-1", "replace")  # a byte for each character
        yield from _narrowed(data)
        yield from _streams(data)


def _base64(blob: str, at: np.ndarray):
    """The layers of a run of base64 characters that stand at the given places of a layer."""
    blob = blob.translate(_FROM_URL)
    for phase in range(4):
        body = blob[phase:]
        if len(body) % 4 == 1:
            body = body[:-1]
        if len(body) < 8:
            continue
        data = binascii.a2b_base64(body + "=" * (-len(body) % 4))
        if not _worth(data):
            continue
        byte = np.arange(len(data))
        yield from _layers(data, at[phase + byte * 4 // 3],
                           at[phase + (byte * 8 + 7) // 6] + 1)


def _worth(data: bytes) -> bool:
    return bool(WORTH.search(data) or STREAM.search(data) or WIDE_TEXT.search(data))


def _layers(data: bytes, starts: np.ndarray, ends: np.ndarray):
    """The text that bytes hold, if it holds a secret or something to unwrap."""
    if _worth(data):
        yield data.decode("latin-1"), starts, ends


def _narrowed(data: bytes):
    """Stretches of 16-bit text, of either byte order and at any place, without their zeros."""
    zero = np.frombuffer(data, np.uint8) == 0
    for phase in (0, 1):
        edges = np.flatnonzero(np.diff(np.r_[False, zero[phase::2], False]))
        for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if last - first >= WIDE:
                # Before, between and after the zeros.
                at = np.arange(2 * first + phase - 1, min(2 * last + phase, len(data)), 2)
                at = at[at >= 0]
                text = np.flatnonzero(~zero[at])
                if len(text) >= WIDE:  # more than the zeros that fill a gap
                    at = at[text[0]:text[-1] + 1]
                    yield from _layers(data[at[0]:at[-1] + 1:2], at, at + 1)


def _streams(data: bytes):
    """What the compressed streams in the data hold."""
    for m in STREAM.finditer(data):
        for inner, used in _unfolded(memoryview(data)[m.start():]):
            yield from _layers(inner, np.full(len(inner), m.start()),
                               np.full(len(inner), min(m.start() + used, len(data))))


def _unpacked(data):
    """What a compressed stream holds, piece by piece: at most about PIECE bytes and how many bytes of
    the data the stream takes (all, while that is open), None once the data ends before the
    stream does. A broken stream ends where it breaks."""
    if data[:2] == b"BZ":
        unpacker, broken = bz2.BZ2Decompressor(), OSError
    elif data[:1] in (b"\xfd", b"\x5d"):
        unpacker, broken = lzma.LZMADecompressor(), lzma.LZMAError
    elif data[:4] == b"\x28\xb5\x2f\xfd":
        unpacker, broken = zstandard.ZstdDecompressor().decompressobj(), zstandard.ZstdError
    else:
        unpacker, broken = zlib.decompressobj(wbits=47), zlib.error
    fed, tail = 0, b""
    try:
        while not unpacker.eof:
            if isinstance(unpacker, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
                piece = b"" if unpacker.needs_input else unpacker.decompress(b"", PIECE)
                if unpacker.needs_input and not piece and not unpacker.eof:
                    if fed == len(data):
                        break
                    piece = unpacker.decompress(data[fed:], PIECE)
                    fed = len(data)
            elif broken is zlib.error:
                piece = unpacker.decompress(tail if fed else data, PIECE)
                fed, tail = len(data), unpacker.unconsumed_tail
                if not piece and not tail:
                    break
            else:
                # Fed in small steps, so that what comes out of one is bounded.
                if fed >= len(data):
                    break
                piece = unpacker.decompress(data[fed:fed + 4096])
                fed += 4096
            yield piece, len(data)
    except broken:
        yield b"", len(data)
        return
    if unpacker.eof:
        yield b"", min(fed, len(data)) - len(unpacker.unused_data)
    else:
        yield b"", None


def _unfolded(data):
    """The content of a compressed stream in overlapping pieces, each with how many bytes of
    the data the stream takes."""
    kept, used = b"", len(data)
    for piece, used in _unpacked(data):
        kept += piece
        if len(kept) >= PIECE and used is not None:
            yield kept, used
            kept = kept[min(max(0, len(kept) - OVERLAP), _open_from(kept)):]
    if kept:
        yield kept, len(data) if used is None else used


def _open_from(data: bytes) -> int:
    """Where the first compressed stream begins that the end of these bytes cuts, as it stands or
    in a blob."""
    first = next((m.start() for m in STREAM.finditer(data) if _cut(memoryview(data)[m.start():])),
                 len(data))
    blob = len(data) - LAST_BLOB.match(data[::-1]).end()
    if blob < first:
        for inner, _, _ in _unwrap(data[blob:].decode("ascii")):
            inner = inner.encode("latin-1", "replace")
            if any(_cut(memoryview(inner)[m.start():]) for m in STREAM.finditer(inner)):
                return blob
    return first


def _cut(data) -> bool:
    """Whether a compressed stream goes on where the data ends."""
    used = 0
    for _, used in _unpacked(data):
        pass
    return used is None


def _replaced(layer: str, pattern: re.Pattern, decode):
    """The layer with every escape in it replaced, if that changes anything."""
    parts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(layer):
        inner = decode(m)
        if inner is None:
            continue
        plain = np.arange(last, m.start(), dtype=np.int64)
        parts += [layer[last:m.start()], inner]
        starts += [plain, [m.start()]]
        ends += [plain + 1, [m.end()]]
        last = m.end()
    if parts:
        plain = np.arange(last, len(layer), dtype=np.int64)
        yield ("".join([*parts, layer[last:]]), np.concatenate([*starts, plain]).astype(np.int64),
               np.concatenate([*ends, plain + 1]).astype(np.int64))


def _character(m: re.Match) -> str | None:
    code = next(x for x in m.groups() if x is not None)
    value = int(code, 10 if m[6] is not None else 16)
    return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else None


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex (of the text as it stands),
    base_sha256 (of those spans written down) and spans (with those in nested layers, at the
    characters that their bytes came from; in compressed data, at the whole stream).

    A null or empty text has none: zero counts, the digest of nothing, empty spans. Each
    document is handled by itself, so copies, ties and hot sources need nothing special; a
    very long text is held by one task, with 16 bytes for each character of a layer. Unfolded
    data is searched in pieces of 16 MB; a stream in it that a piece cuts, as it stands or in a
    blob, is held whole with the next piece.
    """
    return map_arrow(documents_only(docs), _scan_batches, (
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string"))


def _scan_batches(batches):
    for batch in batches:
        counts, digests, spans = ([], [], []), [], []
        for text in utf8(batch):
            base, found = scan(text.decode("utf-8", "replace"))
            for kind in range(3):
                counts[kind].append(sum(x[1] == kind for x in base))
            digests.append(hashlib.sha256(written(base).encode()).hexdigest())
            spans.append(written(found))
        yield pa.RecordBatch.from_arrays([
            column(batch, "doc_id"), *[pa.array(c, pa.int64()) for c in counts],
            pa.array(digests, pa.string()), pa.array(spans, pa.string()),
        ], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def redact(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every stretch covered by spans replaced by one mask."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with all secrets in their text masked, all columns kept.

    A null text stays null. A column n_chars, if there is one, follows the new text.
    """
    ship(docs.sparkSession)
    masked = F.pandas_udf(_redact_series(mask), "string")
    out = docs.withColumn("text", masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _redact_series(mask: str):
    def masked(texts):  # a series of texts
        def one(text):
            found = scan(text)[1] if text else []
            return redact(text, found, mask) if found else text
        return texts.map(one, na_action="ignore")

    return masked
