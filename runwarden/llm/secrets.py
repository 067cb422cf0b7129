"""Secrets in texts and in what is encoded inside them.

A worklist of layers starts with the text. Every layer is scanned with the base patterns; its percent-encoded,
escaped, base64, UTF-16 and compressed parts are unwrapped into further layers until nothing new appears, whether
or not a layer is text. Escapes are those of program texts, URLs and markup (``_ESCAPES``). Base64 may run over line
ends, indents, spaces and written-out line ends. Data deflated without a header bear no mark, so they are opened only
where they fill a whole base64 run. A layer whose content has been seen on its own way down is not opened again, so
cycles end. Every layer carries, for each of its bytes, the span of the original text that it came from; spans are
code points, end exclusive.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runwarden.llm.tables import adding

# The base patterns, in the order in which kinds sort, and their least lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BYTES = tuple(re.compile(x.pattern.encode(), x.flags & re.I) for x in (_ASSIGN, _ACCESS, _HEX))
_VALUE_LEAST = 12
_KEYWORD = re.compile(rb"passw|secret|token|api_?key")

_PERCENT = re.compile(rb"(?:%[0-9A-Fa-f]{2})+")
_PERCENT_TOKEN = re.compile(rb"(?:%[0-9A-Fa-f]{2}|[^\s%])+")
_PERCENT_BYTE = re.compile(rb"%[0-9A-Fa-f]{2}|.", re.S)
# Escapes of characters, by form; runs of one form are decoded together, so that surrogates meet.
_UNITS = (rb"\\u([0-9A-Fa-f]{4})", rb"%u([0-9A-Fa-f]{4})")
_POINTS = (rb"\\U([0-9A-Fa-f]{8})", rb"\\u\{([0-9A-Fa-f]{1,6})\}", rb"&#[xX]([0-9A-Fa-f]{1,8});", rb"&#([0-9]{1,9});")
_OCTETS = rb"\\x([0-9A-Fa-f]{2})"
_NAMES = {b"&amp;": b"&", b"&lt;": b"<", b"&gt;": b">", b"&quot;": b'"', b"&apos;": b"'"}
_ESCAPES = re.compile(
    b"|".join([*(b"(?:" + x.replace(b"(", b"(?:") + b")+" for x in (*_UNITS, *_POINTS, _OCTETS)), *_NAMES])
)
# at least 16 characters of one run, or of runs on lines that follow each other
_BASE64 = re.compile(
    rb"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_\r\n-]{16})[A-Za-z0-9+/_-]++(?:[\r\n]++[A-Za-z0-9+/_-]++)*+={0,2}"
)
_LINE = re.compile(rb"[A-Za-z0-9+/_-]++={0,2}")
_LEAST = 16
# pieces of at least 16 characters, but for the last, between white space and written-out line ends
_PIECES = re.compile(
    rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:\s|\\[nrt])++[A-Za-z0-9+/_-]{16,}+)*+"
    rb"(?:(?:\s|\\[nrt])++[A-Za-z0-9+/_-]++)?={0,2}"
)
_PIECE = re.compile(rb"(?:\s|\\[nrt])++|([A-Za-z0-9+/_-]++={0,2})")
_SPACED = re.compile(rb"[\x20\t\v\f\\]")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
# UTF-16 of either order; what is looked for has at least 16 characters, all ASCII
_WIDE = re.compile(rb"\0?(?:[\t\n\r\x20-\x7e]\0){15,}[\t\n\r\x20-\x7e]?")
# layers over this many bytes are kept in an unnamed temporary file instead of memory
_HELD = 1 << 24
_STEP = 1 << 20

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind number) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    # the regular expressions need one of these strings, which a search of bytes finds fast
    if _KEYWORD.search(text.encode("utf-8", "surrogatepass").lower()):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _VALUE_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


Data = bytes | mmap.mmap


def _byte_spans(data: Data) -> list[Span]:
    """The base patterns of a layer; their characters are ASCII, so bytes that are not UTF-8 do not matter."""
    found = []
    if len(data) > _HELD or _KEYWORD.search(data.lower()):
        found += [(m.start(), m.end(), 0) for m in _BYTES[0].finditer(data) if len(m[2]) >= _VALUE_LEAST]
    if data.find(b"AKIA") >= 0:
        found += [(m.start(), m.end(), 1) for m in _BYTES[1].finditer(data)]
    return found + [(m.start(), m.end(), 2) for m in _BYTES[2].finditer(data)]


class _Layer:
    """Decoded bytes with their original span: one for all of them, or one for each (None: the text itself).

    ``blob`` tells that all of it was decoded, so that it may be binary.
    """

    def __init__(self, data: Data, start, end, way: frozenset, blob: bool) -> None:
        self.data, self.start, self.end, self.way, self.blob = data, start, end, way, blob
        self.plain = start is None and data.isascii()

    def each(self) -> tuple[np.ndarray, np.ndarray]:
        """The span of every byte; in the text it is that of the byte's character."""
        if self.start is None:
            self.start = np.cumsum(np.frombuffer(self.data, np.uint8) & 0xC0 != 0x80) - 1
            self.end = self.start + 1
        return self.start, self.end

    def original(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.start, int):
            return self.start, self.end
        if self.plain:
            return start, end
        starts, ends = self.each()
        return int(starts[start]), int(ends[end - 1])

    def mark(self) -> bytes:
        return hashlib.blake2b(self.data, digest_size=16).digest()

    def place(self) -> tuple:
        if isinstance(self.start, int):
            return self.start, self.end, self.blob
        starts, ends = self.each()
        return hashlib.blake2b(starts.tobytes() + ends.tobytes(), digest_size=16).digest(), self.blob


def _held(chunks: Iterable[bytes]) -> Data:
    """All chunks as one; long ones as a mapped file, which ends with the object."""
    parts, size, file = [], 0, None
    for chunk in chunks:
        size += len(chunk)
        parts.append(chunk)
        if size > _HELD:
            file = file or tempfile.TemporaryFile()
            file.writelines(parts)
            parts = []
    if file is None:
        return b"".join(parts)
    with file:
        file.flush()
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)


def _opener(data: Data, at: int):
    head = data[at : at + 6]
    if head[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0 and not head[1] & 0x20:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head == b"\xfd7zXZ\x00" else None


class _Streams:
    """Chunks of what is compressed at ``at``, over all members that follow each other; ``at`` moves to their end."""

    def __init__(self, data: Data, at: int) -> None:
        self.data, self.at, self.whole = data, at, False

    def __iter__(self) -> Iterator[bytes]:
        data = self.data
        while (opener := _opener(data, self.at)) is not None:
            fed, size = self.at, 512
            try:
                while not opener.eof:
                    chunk = data[fed : fed + size]
                    if not chunk:
                        return
                    fed, size = fed + len(chunk), min(2 * size, _STEP)
                    yield from self._emptied(opener, chunk)
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                return
            self.at, self.whole = fed - len(opener.unused_data), True
            # zeros may fill up the space between members
            after = self.at
            while data[after : after + 1] == b"\0":
                after += 1
            if _opener(data, after) is None:
                return
            self.at, self.whole = after, False

    @staticmethod
    def _emptied(opener, chunk: bytes) -> Iterator[bytes]:
        if hasattr(opener, "unconsumed_tail"):
            while chunk and not opener.eof:
                yield opener.decompress(chunk, _STEP)
                chunk = opener.unconsumed_tail
        else:
            yield opener.decompress(chunk, _STEP)
            while not opener.eof and not opener.needs_input:
                yield opener.decompress(b"", _STEP)


def _compressed(data: Data) -> Iterator[tuple[Data, int, int]]:
    """(content, start, end) of gzip, zlib, bzip2 and xz data anywhere in the bytes; cut off data reaches to their end."""
    at = 0
    while m := _MAGIC.search(data, at):
        streams = _Streams(data, m.start())
        content = _held(streams)
        at = streams.at if streams.at > m.start() else m.start() + 1
        if content:
            yield content, m.start(), streams.at if streams.whole else len(data)


def _inflated(data: Data) -> Data | None:
    """Content of deflated bytes without a header, if they are nothing but one such stream."""
    if data[:1] and data[0] & 6 == 6:  # no such kind of block
        return None
    opener = zlib.decompressobj(-15)

    def chunks() -> Iterator[bytes]:
        for at in range(0, len(data), _STEP):
            yield from _Streams._emptied(opener, data[at : at + _STEP])

    try:
        content = _held(chunks())
    except zlib.error:
        return None
    return content if opener.eof and not opener.unused_data else None


def _replaced(layer: _Layer, pattern: re.Pattern, decode: Callable[[bytes], bytes | None]) -> _Layer | None:
    """The layer with each match decoded in place and the rest kept, or None if nothing changes."""
    data, one = layer.data, isinstance(layer.start, int)
    starts, ends, changed = [], [], False

    def chunks() -> Iterator[bytes]:
        nonlocal changed
        at = 0
        for m in pattern.finditer(data):
            new = decode(m[0])
            if new is None or new == m[0]:
                continue
            changed = True
            yield from kept(at, m.start())
            yield new
            if not one:
                base_start, base_end = layer.each()
                starts.append(np.full(len(new), base_start[m.start()]))
                ends.append(np.full(len(new), base_end[m.end() - 1]))
            at = m.end()
        if changed:
            yield from kept(at, len(data))

    def kept(start: int, end: int) -> Iterator[bytes]:
        if not one:
            base_start, base_end = layer.each()
            starts.append(base_start[start:end])
            ends.append(base_end[start:end])
        for at in range(start, end, _STEP):
            yield data[at : min(at + _STEP, end)]

    new = _held(chunks())
    if not changed:
        return None
    if one:
        return _Layer(new, layer.start, layer.end, layer.way, layer.blob)
    return _Layer(new, np.concatenate(starts), np.concatenate(ends), layer.way, layer.blob)


def _percent(part: bytes) -> bytes:
    return bytes.fromhex(part.replace(b"%", b"").decode())


def _unescaped(part: bytes) -> bytes | None:
    """What a run of escapes of one form stands for; None if it is no text."""
    if part in _NAMES:
        return _NAMES[part]
    for form in _UNITS:
        if re.match(form, part):
            units = b"".join(int(x, 16).to_bytes(2, "little") for x in re.findall(form, part))
            return units.decode("utf-16-le", "replace").encode()
    if re.match(_OCTETS, part):
        return bytes(int(x, 16) for x in re.findall(_OCTETS, part))
    form = next(x for x in _POINTS if re.match(x, part))
    points = [int(x, 10 if form == _POINTS[-1] else 16) for x in re.findall(form, part)]
    good = all(p < 0x110000 and not 0xD800 <= p < 0xE000 for p in points)
    return "".join(map(chr, points)).encode() if good else None


def _percent_words(layer: _Layer) -> Iterator[_Layer]:
    """Compressed data and UTF-16 in the percent-encoded words of a text; in blobs both are seen once decoded in place."""
    for token in _PERCENT_TOKEN.finditer(layer.data):
        if b"%" not in token[0]:
            continue
        data = _PERCENT.sub(lambda m: _percent(m[0]), token[0])
        if not _MAGIC.search(data) and not _WIDE.search(data):
            continue
        units = list(_PERCENT_BYTE.finditer(token[0]))
        wide = ((m[0].replace(b"\0", b""), *m.span()) for m in _WIDE.finditer(data))
        for content, first, last in chain(_compressed(data), wide):
            place = layer.original(token.start() + units[first].start(), token.start() + units[last - 1].end())
            yield _Layer(content, *place, layer.way, True)


def _decoded(run: bytes) -> Iterator[tuple[Data, int]]:
    """(content, characters skipped) of a base64 run, read from each of its first four characters.

    What starts anywhere in the run is inside one of the four, since the bytes before it do not matter.
    """
    run = run.rstrip(b"=").replace(b"+", b"-").replace(b"/", b"_")

    def chunks(skipped: int) -> Iterator[bytes]:
        end = len(run) - ((len(run) - skipped) % 4 == 1)
        for at in range(skipped, end, _STEP):
            part = run[at : min(at + _STEP, end)]
            yield base64.b64decode(part + b"=" * (-len(part) % 4), b"-_")

    for skipped in range(4):
        yield _held(chunks(skipped)), skipped


def _opened(layer: _Layer) -> Iterator[_Layer]:
    """Layers one step further in."""
    data = layer.data
    if layer.blob:
        for content, first, last in _compressed(data):
            yield _Layer(content, *layer.original(first, last), layer.way, True)
        for m in _WIDE.finditer(data):
            yield _Layer(m[0].replace(b"\0", b""), *layer.original(*m.span()), layer.way, True)
    if data.find(b"%") >= 0:
        if not layer.blob:
            yield from _percent_words(layer)
        if new := _replaced(layer, _PERCENT, _percent):
            yield new
    marks = (b"\\u", b"\\U", b"\\x", b"%u", b"&")
    if any(data.find(x) >= 0 for x in marks) and (new := _replaced(layer, _ESCAPES, _unescaped)):
        yield new
    for m in _BASE64.finditer(data):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        for start, end in lines:
            if end - start >= _LEAST:
                place = layer.original(start, end)
                for new, skipped in _decoded(data[start:end]):
                    yield _Layer(new, *place, layer.way, True)
                    if not skipped and (inner := _inflated(new)):
                        yield _Layer(inner, *place, layer.way, True)
        if len(lines) > 1:
            yield from _joined_lines(layer, lines)
    for m in _PIECES.finditer(data):
        if _SPACED.search(m[0]):
            pieces = [(m.start() + x.start(1), m.start() + x.end(1)) for x in _PIECE.finditer(m[0]) if x[1]]
            yield from _joined_lines(layer, pieces)


def _joined_lines(layer: _Layer, lines: list[tuple[int, int]]) -> Iterator[_Layer]:
    """Base64 in several pieces; each byte has the span of the pieces that its characters are in."""
    sizes = np.array([end - start for start, end in lines])
    whole = b"".join(layer.data[start:end] for start, end in lines)
    if len(whole) < _LEAST:
        return
    line = np.repeat(np.arange(len(lines)), sizes)
    places = [layer.original(start, end) for start, end in lines]
    same = len(set(places)) == 1
    starts, ends = np.array(places).T
    for new, skipped in _decoded(whole):
        if not skipped and (inner := _inflated(new)):
            yield _Layer(inner, layer.original(*lines[0])[0], layer.original(*lines[-1])[1], layer.way, True)
        if same:
            yield _Layer(new, *places[0], layer.way, True)
            continue
        # byte i comes from the bits 8 i to 8 i + 7, six to a character
        first = np.arange(len(new)) * 8 // 6 + skipped
        last = (np.arange(len(new)) * 8 + 7) // 6 + skipped
        yield _Layer(new, starts[line[first]], ends[line[last]], layer.way, True)


def all_spans(text: str) -> list[Span]:
    """Base spans and those found in unwrapped layers, mapped to the text; each once, in order."""
    found = set(base_spans(text))
    # a layer that comes again with the same content and place would show the same again
    seen = set()
    # the worklist holds what is still to be opened at each depth, so one layer is held at a time
    work = [_opened(_Layer(text.encode("utf-8", "surrogatepass"), None, None, frozenset(), False))]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if not new.data:
            continue
        mark = new.mark()
        if mark in new.way or (known := (mark, new.place())) in seen:
            continue
        seen.add(known)
        new.way |= {mark}
        for start, end, kind in _byte_spans(new.data):
            first, last = new.original(start, end)
            found.add((first, last, kind))
        work.append(_opened(new))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that touch or overlap give one mask."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start > at or (start == at and not out):
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


_SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string"


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` and n_assign, n_access, n_hex, base_sha256, spans, clean_text.

    The counts and the digest are those of the base patterns on the text itself; spans also hold what the
    unwrapped layers show; clean_text has all spans masked and is null for a null text. A null text counts as
    empty. Rows are handled where they are, nothing is shuffled. Columns that have an added name are replaced.
    """

    def compute(texts: list[str | None]) -> list[pa.Array]:
        counts, digest, spans, clean = [], [], [], []
        for text in texts:
            base = base_spans(text or "")
            every = all_spans(text or "")
            kinds = [k for *_, k in base]
            counts.append([kinds.count(k) for k in range(3)])
            digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(every))
            clean.append(None if text is None else masked(text, every))
        numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        return [*numbers, *(pa.array(x, pa.string()) for x in (digest, spans, clean))]

    return adding(docs.withColumn(text_column, F.col(text_column).cast("string")), text_column, compute, _SCAN)
