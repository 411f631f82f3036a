"""Secret scan with a recursive decoding worklist.

Every text is the root layer.  A layer is scanned for secrets and unwrapped:
percent escapes and Unicode escapes of the whole layer, and every base64 run of
it, also as one with the lines that it is wrapped into, whose bytes are decompressed, all members and frames of them, as often as
they start with a known magic number.  Layers that are partly or not at all text
are scanned like the others; escapes that stand for no character stay as they
are.  New layers join the worklist until none is left; a layer whose digest
the document has already seen is not taken again, so cycles (a compressed file
that holds itself) end.  Each character of a layer keeps the root span it comes
from: escapes map one by one, what lies inside a base64 run maps to the run."""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spans, sha256_hex, text_frame

# The contract's patterns and their least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
#: ``opaque`` marks a compressed run whose contents pass ``max_layer_bytes``: they are
#: scanned in windows, and only what spans windows or is compressed again is not unpacked.
ORDER = {"assign": 0, "access": 1, "hex": 2, "opaque": 3}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\[uUx]([0-9A-Fa-f]+?)(?=\\|$)")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]++={0,2})")
URL_SAFE = str.maketrans("-_", "+/")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The contract's base spans of one layer."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


class Layer:
    """A decoded text and, for each of its characters, where it stands in the root."""

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def root_span(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


class Inside:
    """The place of every character of a layer that lies inside one run of the root."""

    def __init__(self, at: int):
        self.at = at

    def __getitem__(self, i):
        return () if isinstance(i, slice) else self.at


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    """Characters with their places; bytes that are no UTF-8 stay escaped.  None if all do."""
    raw = bytes.fromhex(run.replace("%", ""))
    out, at, decoded = [], 0, False
    for c in raw.decode("utf-8", "surrogateescape"):
        if "\udc80" <= c <= "\udcff":
            out.extend((run[i], i, i + 1) for i in range(at, at + 3))
            at += 3
            continue
        width = 3 * len(c.encode())
        out.append((c, at, at + width))
        at, decoded = at + width, True
    return out if decoded else None


def _escapes(run: str) -> list[tuple[str, int, int]] | None:
    """Characters with their places; units that are no character stay escaped.  None if all do."""
    units = [(int(m[1], 16), m.start(), m.end()) for m in ONE_ESCAPE.finditer(run)]
    out, i, decoded = [], 0, False
    while i < len(units):
        code, start, end = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, end = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2]
            i += 1
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            out.extend((run[k], k, k + 1) for k in range(start, end))
        else:
            out.append((chr(code), start, end))
            decoded = True
        i += 1
    return out if decoded else None


def unescape(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every decodable run of ``pattern`` decoded; None if there is none."""
    text, starts, ends, at = [], [], [], 0
    inside = isinstance(layer.starts, Inside)
    for m in pattern.finditer(layer.text):
        chars = decode(m[0])
        if chars is None:
            continue
        text.append(layer.text[at:m.start()])
        starts.extend(layer.starts[at:m.start()])
        ends.extend(layer.ends[at:m.start()])
        for c, s, e in chars:
            text.append(c)
            if not inside:
                starts.append(layer.starts[m.start() + s])
                ends.append(layer.ends[m.start() + e - 1])
        at = m.end()
    if not at:
        return None
    text.append(layer.text[at:])
    if inside:
        return Layer("".join(text), layer.starts, layer.ends)
    starts.extend(layer.starts[at:])
    ends.extend(layer.ends[at:])
    return Layer("".join(text), starts, ends)


#: What the decompressors raise on bytes that are not theirs; zstd's own error is told by its name.
REFUSED = (zlib.error, OSError, EOFError, lzma.LZMAError, RuntimeError, ValueError)


#: Starts of the members and frames that are unpacked; zstd's skippable frames hold nothing.
MAGIC = re.compile(rb"(?P<gzip>\x1f\x8b)|(?P<zlib>\x78)|(?P<bz2>BZh)|(?P<xz>\xfd7zXZ\x00)"
                   rb"|(?P<zstd>\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18)")
PADDING = re.compile(rb"\x00*")
SPACES = re.compile(rb"\x20{2,}")
#: Bytes that a window of a layer that is too large shares with the next one.
OVERLAP = 1 << 16
#: Bytes that a decompressor gets at first and at most, and that it gives at most.  zstd has
#: no bound on what it gives; a block of 4 bytes can make 128 KB.
LEAST_IN, MOST_IN, PIECE = 1 << 10, 1 << 16, 1 << 20


def _decompressor(kind: str):
    if kind == "zstd":
        import zstandard
        return zstandard.ZstdDecompressor().decompressobj()
    if kind == "bz2":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if kind == "xz" else zlib.decompressobj(47 if kind == "gzip" else 15)


def _inflate(data: bytes, raw: list[bytes]) -> Iterator[bytes]:
    """What the members or frames of ``data`` hold, in pieces.

    ``raw`` gets the bytes from the first member on that is none, is cut short or
    is refused, so all of ``data`` if it is not a compressed stream."""
    at = 0
    while at < len(data):
        m = MAGIC.match(data, at)
        if m is None:
            raw.append(data[at:])
            return
        kind, here, step = m.lastgroup, at, LEAST_IN
        try:
            d = _decompressor(kind)
            while not d.eof and here < len(data):
                fed, here = data[here:here + step], here + step
                if kind == "zstd":
                    yield d.decompress(fed)
                    continue
                yield d.decompress(fed, PIECE)
                while not d.eof and (d.unconsumed_tail if kind in ("gzip", "zlib") else not d.needs_input):
                    yield d.decompress(d.unconsumed_tail if kind in ("gzip", "zlib") else b"", PIECE)
                step = min(2 * step, MOST_IN)
        except Exception as e:
            if not isinstance(e, REFUSED) and type(e).__name__ != "ZstdError":
                raise
            raw.append(data[at:])
            return
        if not d.eof:
            raw.append(data[at:])
            return
        at = PADDING.match(data, min(here, len(data)) - len(d.unused_data)).end()


def _text(data: bytes) -> str:
    """The bytes as text, one character each if they are no UTF-8: the patterns are ASCII."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _windows(pieces: Iterator[bytes], most: int) -> Iterator[str]:
    """The joined pieces as texts of about ``most`` bytes.

    Each starts with the end of the one before, where runs of spaces, the only part
    of a secret without bound that must be seen whole, become one space."""
    held: list[bytes] = []
    carry, size = b"", 0
    for piece in pieces:
        held.append(piece)
        size += len(piece)
        if size >= most:
            window = b"".join([carry, *held])
            yield _text(window)
            carry = SPACES.sub(b" ", window)[-OVERLAP:]
            held, size = [], 0
    if held:
        yield _text(b"".join([carry, *held]))


def unpacked(run: str, most: int) -> Iterator[str | None]:
    """The texts inside a base64 run: what its compressed layers come to, all members of
    each, and of every layer what is not compressed.

    A layer of over ``most`` bytes gives None and its windows, and is not unpacked further."""
    body = run.rstrip("=").translate(URL_SAFE)
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return
    seen: set[bytes] = set()
    while data and (digest := hashlib.sha256(data).digest()) not in seen:
        seen.add(digest)
        raw: list[bytes] = []
        got, size = [], 0
        pieces = _inflate(data, raw)
        for piece in pieces:
            got.append(piece)
            size += len(piece)
            if size > most:
                yield None
                yield from _windows(chain([b"".join(got)], pieces), most)
                got = []
        yield from map(_text, raw)
        data = b"".join(got)


def base64_runs(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of every run, and of every block of runs of equal length
    that follow each other line by line, with the shorter line that ends it."""
    tried = 0
    for m in BASE64.finditer(text):
        start, end = m.span()
        yield start, end, m[0]
        if start < tried or m[0][-1] == "=":
            continue
        lines, total = [m[0]], len(m[0])
        while n := NEXT_LINE.match(text, end):
            size = len(n[1])
            # a word after a block without a short line is none if base64 cannot be so long
            if size > len(m[0]) or size < len(m[0]) and n[1][-1] != "=" and (total + size) % 4 == 1:
                break
            lines.append(n[1])
            total, end = total + size, n.end()
            if size < len(m[0]):
                break  # this line may start a block of its own
            tried = end
            if n[1][-1] == "=":
                break
        if len(lines) > 1:
            yield start, end, "".join(lines)


def _inner(layer: Layer, max_layer_bytes: int, found: set[Span]) -> Iterator[Layer]:
    """The layers inside a layer; ``found`` gets its opaque spans."""
    escaped = []
    if "%" in layer.text:
        escaped.append(unescape(layer, PERCENT, _percent))
    if "\\" in layer.text:
        escaped.append(unescape(layer, ESCAPE, _escapes))
    yield from filter(None, escaped)
    for start, end, run in base64_runs(layer.text):
        s, e = layer.root_span(start, end)
        for got in unpacked(run, max_layer_bytes):
            if got is None:
                found.add(("opaque", s, e))
            elif got:
                yield Layer(got, Inside(s), Inside(e))


def find_secrets(text: str, max_layer_bytes: int = 64 << 20) -> tuple[list[Span], list[Span]]:
    """(base spans, spans added by decoding), both in code points of ``text``."""
    base = scan(text)
    found: set[Span] = set()
    seen = {hashlib.sha256(text.encode()).digest()}
    # one layer after the other is made, so of a large one a single window is held
    work = [_inner(Layer(text, range(len(text)), range(1, len(text) + 1)), max_layer_bytes, found)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        # the place is part of the key: a payload that stands twice is reported twice
        where = f"{new.starts[0]}:{new.ends[-1]}:"
        digest = hashlib.sha256((where + new.text).encode()).digest()
        if digest not in seen:
            seen.add(digest)
            found.update((k, *new.root_span(s, e)) for k, s, e in scan(new.text))
            work.append(_inner(new, max_layer_bytes, found))
    return base, sorted(found - set(base))


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 max_layer_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added), one row per input row.

    The counts and the digest cover the base spans of the text itself; ``spans``
    holds them and those found in decoded layers.  A compressed run that inflates
    past ``max_layer_bytes`` is scanned to its end in overlapping windows and also
    reported whole as ``opaque``, for what is encoded in it is only unpacked as far as
    it lies within a window.

    Null text counts as empty (no spans); a null id stays null; repeated rows are
    scanned one by one; an empty table gives an empty result; very long texts are
    scanned whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, added = find_secrets(text, max_layer_bytes)
                n = {k: sum(x[0] == k for x in base) for k in ORDER}
                rows.append((doc_id, n["assign"], n["access"], n["hex"], sha256_hex(join_spans(base, ORDER)),
                             join_spans(base + added, ORDER), len(added)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)] if rows else
                                             [pa.array([], t) for t in [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    texts = text_frame(docs, id_col, text_col)
    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
