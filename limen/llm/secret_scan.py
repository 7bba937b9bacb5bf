"""Secret scan with a recursive decoding worklist.

A text is the first layer. From each layer of the worklist further ones are unwrapped, each scanned in turn, until none
comes that was not met at the same place:

* the whole layer with its percent escapes, or its Unicode escapes (``\\uXXXX`` with surrogates, ``\\u{X}``,
  ``\\UXXXXXXXX``, ``\\xXX``, ``&#N;``, ``&#xX;``, full-width forms), replaced, so that plain and escaped parts of a
  secret meet;
* every run of base64 letters (standard or URL-safe, also wrapped over lines) at each of its four alignments, since
  what stands before a secret's encoding may look like it;
* every run of ASCII in two-byte units (UTF-16 of either order) in a decoded layer;
* every compressed stream (gzip, zlib, bzip2, xz) that starts in a decoded layer, in pieces of bounded size.

Layers are bytes, and each knows where its bytes lie in the layer that it came from: a span found ten layers deep is
carried down to characters of the text. Escapes map exactly, base64 to the characters that hold the bytes, a
compressed stream to the whole of itself.

Kinds, each leftmost and without overlap, on every layer: ``assign``, ``access``, ``hex`` (see PATTERNS). Spans of the
first layer are the base ones; unwrapping adds spans and takes none away.

Defined results: a null text is empty; an empty text has no spans; equal spans of one kind from several layers are
one, with the shortest way to it; equal rows give equal rows; null ids stay null; an empty table gives an empty
result. Layers are met depth first, so only those on the way to the present one are held. The layers of one text hold
at most ``MOST_DECODED`` bytes and 64 for each of its own: a text whose streams unfold to more (a bomb) is flagged ``complete`` = false, never dropped, and keeps what was found; matches in
a compressed stream that are longer than ``OVERLAP`` may be found in parts, which all lie at the same place. Other
columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex")
#: The assignment as the contract words it; the length of group 2 is checked after the match.
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A failing match of these two takes a whole run, in which no other match fits: the length can stand in the pattern.
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
LEAST_HEX = 16
LEAST_VALUE = 12
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

URL = re.compile(rb"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(rb"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&\#[0-9]{1,7};|&\#[xX][0-9A-Fa-f]{1,6};|\xef\xbc[\x81-\xbf]|\xef\xbd[\x80-\x9e]")
#: 22 letters of base64 hold 16 bytes, the least that a secret has; a line of 60 may go on in the next one.
LEAST_BASE64, WRAPPED = 22, 60
#: 16 ASCII characters or more in units of two bytes, least significant first or last.
WIDE = re.compile(rb"(?:[\x09-\x7e]\x00){16,}|(?:\x00[\x09-\x7e]){16,}")
_WIDE_SIGN = re.compile(rb"\x00[\x09-\x7e]\x00[\x09-\x7e]\x00[\x09-\x7e]\x00")
_STANDARD = bytes.maketrans(b"-_", b"+/")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00")

#: Bytes of a piece of an unfolded stream, and how much of a piece the next one repeats.
PIECE = 4 << 20
OVERLAP = 1 << 16
MOST_DECODED = 1 << 30


def _marking(letters: bytes) -> bytes:
    """A table that leaves ``a`` where one of letters stood and a blank elsewhere."""
    return bytes(97 if x in letters else 32 for x in range(256))


_DIGITS = b"0123456789"
_HEX = _marking(_DIGITS + b"abcdef")
_BASE64 = _marking(_DIGITS + bytes(range(65, 91)) + bytes(range(97, 123)) + b"+/_-")


def runs(marked: bytes, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of at least so many marks."""
    sought = b"a" * least
    at = marked.find(sought)
    while at >= 0:
        end = marked.find(b" ", at)
        yield at, end if end >= 0 else len(marked)
        at = marked.find(sought, end) if end >= 0 else -1


def matches(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the secrets in one layer."""
    small = data.lower()
    starts = set()
    for word in KEYWORDS:
        at = small.find(word)
        while at >= 0:
            starts.add(at)
            at = small.find(word, at + 1)
    after = 0
    for at in sorted(starts):
        if at >= after and (m := ASSIGN.match(data, at)):
            after = m.end()
            if m.end(2) - m.start(2) >= LEAST_VALUE:
                yield "assign", at, after
    if b"AKIA" in data:
        for m in ACCESS.finditer(data):
            yield "access", m.start(), m.end()
    for start, end in runs(data.translate(_HEX), LEAST_HEX):
        yield "hex", start, end


class Layer:
    """Bytes, and how a span of them maps to the layer they came from."""

    way: tuple[str, ...] = ()

    def __init__(self, data: bytes, parent: "Layer | None" = None, way: str = ""):
        self.data, self.parent = data, parent
        if parent:
            self.way = (*parent.way, way)

    def below(self, start: int, end: int) -> tuple[int, int]:
        return start, end

    def rest(self) -> Iterator[bytes]:
        """What follows these bytes, where they are a piece of a stream."""
        return iter(())

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span in bytes of the first layer."""
        layer = self
        while layer.parent:
            start, end = layer.below(start, end)
            layer = layer.parent
        return start, end


class Escaped(Layer):
    """A layer with escapes replaced: (start here, end here, start below, end below) of each."""

    def __init__(self, parent: Layer, way: str, found: list[tuple[int, int, bytes]]):
        parts, at, here, self.marks = [], 0, 0, []
        for start, end, new in found:
            parts += [parent.data[at:start], new]
            here += start - at
            self.marks.append((here, here + len(new), start, end))
            here += len(new)
            at = end
        parts.append(parent.data[at:])
        super().__init__(b"".join(parts), parent, way)

    def below(self, start: int, end: int) -> tuple[int, int]:
        def place(x: int, last: bool) -> int:
            k = bisect_right(self.marks, x, key=lambda m: m[0]) - 1
            if k < 0:
                return x
            here, stop, low, high = self.marks[k]
            if x >= stop:
                return high + x - stop
            return high if last else low

        return place(start, False), place(end - 1, True) + (0 if self._inside(end - 1) else 1)

    def _inside(self, x: int) -> bool:
        k = bisect_right(self.marks, x, key=lambda m: m[0]) - 1
        return k >= 0 and x < self.marks[k][1]


class Base64(Layer):
    """What a run of base64 letters holds; ``at`` is where its letters start below, breaks are line ends in them."""

    def __init__(self, parent: Layer, data: bytes, at: int, breaks: list[tuple[int, int]]):
        super().__init__(data, parent, "base64")
        self.at, self.breaks = at, breaks

    def _letter(self, k: int) -> int:
        i = bisect_right(self.breaks, k, key=lambda x: x[0]) - 1
        return self.at + k + (self.breaks[i][1] if i >= 0 else 0)

    def below(self, start: int, end: int) -> tuple[int, int]:
        return self._letter(8 * start // 6), self._letter(-(-8 * end // 6) - 1) + 1


class Wide(Layer):
    """ASCII that stood in units of two bytes from ``at``."""

    def __init__(self, parent: Layer, data: bytes, at: int):
        super().__init__(data, parent, "utf16")
        self.at = at

    def below(self, start: int, end: int) -> tuple[int, int]:
        return self.at + 2 * start, self.at + 2 * end


class Unfolded(Layer):
    """A piece of a compressed stream: all of it lies where the stream lies."""

    def __init__(self, parent: Layer, way: str, data: bytes, start: int, end: int):
        super().__init__(data, parent, way)
        self.start, self.end = start, end

    def below(self, start: int, end: int) -> tuple[int, int]:
        return self.start, self.end


def percent(layer: Layer) -> Iterator[Layer]:
    if found := [(m.start(), m.end(), bytes([int(m[0][1:], 16)])) for m in URL.finditer(layer.data)]:
        yield Escaped(layer, "url", found)


def _unit(token: bytes) -> int:
    if token[:1] == b"\xef":
        return ord(token.decode()) - 0xFEE0  # a full-width form of ASCII
    if token[:1] == b"&":
        return int(token[3:-1], 16) if token[2:3] in b"xX" else int(token[2:-1])
    return int(token[2:].strip(b"{}"), 16)


def escapes(layer: Layer) -> Iterator[Layer]:
    found: list[tuple[int, int, bytes]] = []
    high = None  # a first half of a surrogate pair: its start, its end and its value
    for m in UNICODE.finditer(layer.data):
        unit = _unit(m[0])
        if high and high[1] == m.start() and 0xDC00 <= unit < 0xE000:
            found.append((high[0], m.end(), chr(0x10000 + (high[2] - 0xD800) * 1024 + unit - 0xDC00).encode()))
            high = None
            continue
        high = (m.start(), m.end(), unit) if 0xD800 <= unit < 0xDC00 else None
        if m[0][:2] == b"\\x":
            found.append((m.start(), m.end(), bytes([unit])))
        elif unit < 0x110000 and not 0xD800 <= unit < 0xE000:
            found.append((m.start(), m.end(), chr(unit).encode()))
    if found:
        yield Escaped(layer, "unicode", found)


def base64_runs(layer: Layer) -> Iterator[Layer]:
    marked, after = layer.data.translate(_BASE64), 0
    for start, end in runs(marked, LEAST_BASE64):
        if start < after:
            continue
        # lines: where each starts below, less the letters before it
        lines, letters, line = [], layer.data[start:end], start
        while end - line >= WRAPPED and (gap := re.compile(rb"\r?\n").match(layer.data, end)):
            line, end = gap.end(), marked.find(b" ", gap.end())
            end = end if end >= 0 else len(marked)
            lines.append((len(letters), line - start - len(letters)))
            letters += layer.data[line:end]
        after = end
        letters = letters.translate(_STANDARD)
        for skip in range(4):
            part = letters[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]  # one letter over holds no byte
            yield Base64(layer, base64.b64decode(part + b"=" * (-len(part) % 4)), start + skip, [(k - skip, gone) for k, gone in lines])


def wide(layer: Layer) -> Iterator[Layer]:
    if layer.parent and _WIDE_SIGN.search(layer.data):
        for m in WIDE.finditer(layer.data):
            yield Wide(layer, m[0].replace(b"\x00", b""), m.start())


def _decompressor(magic: bytes):
    if magic[:1] == b"\x1f":
        return "gzip", zlib.decompressobj(31)
    if magic[:1] == b"\x78":
        return "zlib", zlib.decompressobj(15)
    return ("bzip2", bz2.BZ2Decompressor()) if magic[:1] == b"B" else ("xz", lzma.LZMADecompressor())


def _pieces(magic: bytes, feeds: Iterable[bytes]) -> Iterator[tuple[bytes, int | None]]:
    """(bytes unfolded, where the stream ends in feeds if it is known by now) of a stream."""
    way, stream = _decompressor(magic)
    taken = 0
    try:
        for feed in feeds:
            taken += len(feed)
            while piece := stream.decompress(feed, PIECE):
                feed = stream.unconsumed_tail if way in ("gzip", "zlib") else b""
                yield piece, taken - len(stream.unused_data) if stream.eof else None
                if stream.eof:
                    return
            if stream.eof:
                yield b"", taken - len(stream.unused_data)
                return
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        return


def streams(layer: Layer) -> Iterator[Layer]:
    """Pieces of the streams that start in a decoded layer, each with the end of the one before; a stream that breaks
    off gives what came before, and reaches to the layer's end. One piece is held at a time: a stream that goes on
    where its layer, itself a piece, ends is fed by the pieces that follow."""
    if not layer.parent:
        return  # a text is no binary: streams come escaped or encoded
    after = 0
    for m in MAGIC.finditer(layer.data):
        if m.start() < after:
            continue

        def pieces(m=m):
            return _pieces(m[0], chain([memoryview(layer.data)[m.start() :]], layer.rest()))

        kept, end = b"", None
        for k, (piece, known) in enumerate(pieces()):
            if end is None:  # a stream of more than a piece is unfolded twice, first to see where it ends
                end = known or next((e for _, e in pieces() if e), None) or len(layer.data)
                end = min(len(layer.data), m.start() + end)
            unfolded = Unfolded(layer, _decompressor(m[0])[0], kept + piece, m.start(), end)
            unfolded.rest = lambda k=k, pieces=pieces: (p for p, _ in islice(pieces(), k + 1, None))
            yield unfolded
            kept = piece[-OVERLAP:]
            if known:
                after = m.start() + known


UNWRAP = (percent, escapes, base64_runs, wide, streams)


def found(data: bytes, most: int = MOST_DECODED) -> tuple[list[tuple[str, int, int]], dict[tuple[str, int, int], tuple[str, ...]], bool]:
    """(base spans, all spans with the way to each, whether all layers were scanned), in bytes of data."""
    first = Layer(data)
    base = list(matches(data))
    spans = {x: () for x in base}
    work = [unwrap(first) for unwrap in UNWRAP]
    met, room = {(0, len(data), hashlib.sha1(data).digest())}, most + 64 * len(data)
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.data:
            continue
        room -= len(layer.data)
        if room < 0:
            return base, spans, False
        key = (*layer.origin(0, len(layer.data)), hashlib.sha1(layer.data).digest())
        if key in met:
            continue  # the same bytes at the same place: a cycle, or another way to what was scanned
        met.add(key)
        for kind, start, end in matches(layer.data):
            span = (kind, *layer.origin(start, end))
            if span not in spans or len(layer.way) < len(spans[span]):
                spans[span] = layer.way
        work.extend(unwrap(layer) for unwrap in UNWRAP)
    return base, spans, True


def in_characters(data: bytes, spans: list[tuple[str, int, int]]) -> dict[int, int]:
    """Offsets in characters of the byte offsets that spans use."""
    out, at, chars = {}, 0, 0
    for x in sorted({x for _, *pair in spans for x in pair}):
        chars += len(data[at:x].decode("utf-8", "ignore"))
        at = out[x] = x
        out[x] = chars
    return out


def _order(span: tuple) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


RESULT = "id {id}, n_assign long, n_access long, n_hex long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long,way:string>>, complete boolean"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_DECODED) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex (of base spans), base and spans (characters, end exclusive, in order),
    spans with the layers unwrapped on the way (``url>base64``; empty for base ones), complete."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from limen.llm.secret_scan import KINDS, _order, found, in_characters

        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        deep = pa.struct([*span, ("way", pa.string())])
        for b in batches:
            out = []
            for x in b.column(1).cast(pa.binary()):
                data = x.as_py()
                base, spans, complete = found(data, most)
                place = in_characters(data, list(spans))
                plain = [(k, place[s], place[e]) for k, s, e in sorted(base, key=_order)]
                ways = [(k, place[s], place[e], ">".join(spans[k, s, e])) for k, s, e in sorted(spans, key=_order)]
                out.append((*(sum(k == kind for k, *_ in plain) for kind in KINDS), plain, ways, complete))
            cols = list(zip(*out)) if out else [[]] * 6
            named = [[dict(zip(("kind", "start", "end", "way"), s)) for s in row] for row in cols[3]], [[dict(zip(("kind", "start", "end", "way"), s)) for s in row] for row in cols[4]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(named[0], pa.list_(span)), pa.array(named[1], pa.list_(deep)), pa.array(cols[5], pa.bool_())],
                ["id", "n_assign", "n_access", "n_hex", "base", "spans", "complete"],
            )

    return rows.mapInArrow(run, RESULT.format(id=id_type)).withColumnRenamed("id", id_col)


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() with its spans as text: base_sha256 (of the base spans' list) and spans, ``kind:start:end`` by comma."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(df, id_col, text_col).select(id_col, "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), "complete")
