"""Secret scans with a recursive decoding worklist.

Every text is scanned for three kinds of secret (PATTERNS). The worklist starts with the text itself; a layer taken from
it is scanned, then unwrapped: percent escapes and Unicode or character-reference escapes give a new layer of the whole
layer's text, a base64 run gives one of what it holds (after undoing gzip, zlib, bzip2 or zstd, as often as they nest).
New layers join the worklist until none is new; a layer whose content was seen before is not taken again, which ends
cycles. Each layer's characters map to the span of the document they came from, so a secret found at any depth is
reported at its place in the document. Base64 broken into lines of one width is also read joined. A run that does not
decode to text as a whole (other characters of the alphabet may stand before or behind what was encoded, as in
`key/...` or `x-...`) is decoded at each of the four alignments, and what is readable or opens a compressed block in it
is a layer that maps to its part of the run. Decoded bytes are read as UTF-8, or as UTF-16 where every second byte is
zero. All members of a compressed block are read as a stream; what it holds is scanned in overlapping windows, so memory is bounded, not coverage. What a layer keeps besides its text is one entry
for each match that was rewritten.
Bounds that remain: one base64 run may inflate to BOMB bytes (all nested formats together), zstd windows to EXPANSION,
formats nest 64 deep, and a run inside a layer of several windows may be cut if longer than EXPANSION characters.

A null text is an empty one; overlapping and equal findings are reported once for each kind and place; rows are mapped
one by one, so repeated rows and other columns do not matter; an empty table gives no row.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import re
import string
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from itertools import chain
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import annotate, text_array

#: Kind, pattern, group measured, least length.
PATTERNS = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
#: The same hex runs, without stopping at each short one.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = [p[0] for p in PATTERNS]
EXPANSION = 16 << 20
#: What one base64 run may inflate to, in bytes.
BOMB = 1 << 30
#: Characters of a window, those it shares with the next at least, and bytes inflated at a time.
WINDOW, OVERLAP, STEP = 4 << 20, 1 << 16, 1 << 20
#: A text without a match of this holds no secret and nothing to unwrap.
_ANY = r"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|&#|[A-Za-z0-9+/_-]{16}"
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|(?:\\U[0-9A-Fa-f]{8})+|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Inside decoded bytes: text, and what may open a compressed block.
_STRETCH = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){10,}")
_WIDE = [(re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){10,}"), "utf-16-le"), (re.compile(rb"(?:\x00[\t\r\n\x20-\x7e]){10,}"), "utf-16-be")]
_OPENS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)+={0,2}")
_RUN = string.ascii_letters + string.digits + "+/_-=%\\"


class Finding(NamedTuple):
    start: int
    rank: int
    end: int
    layers: str

    @property
    def text(self) -> str:
        return f"{KINDS[self.rank]}:{self.start}:{self.end}"


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the leftmost non-overlapping matches of each kind that are long enough, in that order."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "hex":
            out += [(m.start(), rank, m.end()) for m in _LONG_HEX.finditer(text)]
        else:
            out += [(m.start(), rank, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(out)


class Rewrites:
    """Where the characters of a rewritten layer stood in the layer below it: four 32-bit numbers for each rewritten match."""

    def __init__(self, under: Rewrites | tuple[int, int] | None):
        self.under = under
        self.made, self.made_end, self.old, self.old_end = (array("i") for _ in range(4))

    def add(self, made: int, size: int, old: int, old_end: int) -> None:
        """The match from old to old_end became `size` characters from `made` on."""
        for column, value in zip((self.made, self.made_end, self.old, self.old_end), (made, made + size, old, old_end), strict=True):
            column.append(value)

    def below(self, start: int, end: int) -> tuple[int, int]:
        """The span there of a span here that is not empty; places never run backwards, so its ends decide."""
        i, j = bisect_right(self.made, start) - 1, bisect_right(self.made, end - 1) - 1
        if i >= 0:
            start = self.old[i] if start < self.made_end[i] else self.old_end[i] + start - self.made_end[i]
        if j >= 0:
            end = self.old_end[j] + max(0, end - self.made_end[j])
        return start, end


class Layer(NamedTuple):
    text: str
    place: Rewrites | tuple[int, int] | None  # a span of the document for all of it, or None: the document itself
    names: tuple[str, ...]
    window: bool = False  # one of several that make up a layer

    def span(self, start: int, end: int) -> tuple[int, int]:
        place = self.place
        while isinstance(place, Rewrites):
            start, end = place.below(start, end)
            place = place.under
        return place or (start, end)


def _rewritten(layer: Layer, pattern: re.Pattern, decode, name: str) -> Layer | None:
    """The layer with each match replaced by what it decodes to, or None if nothing decodes."""
    pieces, at, length, places = [], 0, 0, Rewrites(layer.place)
    for m in pattern.finditer(layer.text):
        made = decode(m.group())
        if made is None:
            continue
        length += m.start() - at
        places.add(length, len(made), m.start(), m.end())
        pieces += [layer.text[at : m.start()], made]
        length += len(made)
        at = m.end()
    if not pieces:
        return None
    pieces.append(layer.text[at:])
    # Below a layer that is one span as a whole, every character is of that span.
    place = layer.place if isinstance(layer.place, tuple) else places
    return Layer("".join(pieces), place, (*layer.names, name))


def _from_percent(run: str) -> str | None:
    return unquote_to_bytes(run).decode("utf-8", "replace")


def _from_escape(run: str) -> str | None:
    if run[0] == "&":
        return html.unescape(run)
    if run.startswith("\\u{"):
        code = int(run[3:-1], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run[1] == "x":
        return bytes.fromhex(run.replace("\\x", "")).decode("utf-8", "replace")
    if run[1] == "U":
        return bytes.fromhex(run.replace("\\U", "")).decode("utf-32-be", "replace")
    return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")


def _format(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if len(head) > 2 and head[0] & 0x8F == 0x08 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if head[:3] == b"BZh" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


class _Source:
    """Chunks as a readable file."""

    def __init__(self, chunks):
        self.chunks, self.rest = iter(chunks), b""

    def read(self, size: int = -1) -> bytes:
        while not self.rest:
            if (more := next(self.chunks, None)) is None:
                return b""
            self.rest = more
        out, self.rest = (self.rest, b"") if size < 0 else (self.rest[:size], self.rest[size:])
        return out


def _member_chunks(name: str, source: _Source):
    if name == "zstd":
        import zstandard

        with zstandard.ZstdDecompressor(max_window_size=EXPANSION).stream_reader(source, read_across_frames=True) as reader:
            while data := reader.read(STEP):
                yield data
        return
    rest = source.read(STEP)
    while rest:
        one = bz2.BZ2Decompressor() if name == "bzip2" else zlib.decompressobj(31 if name == "gzip" else 15)
        while not one.eof:
            if name == "bzip2":
                out, rest, waits = one.decompress(rest, STEP), b"", one.needs_input
            else:
                out = one.decompress(rest, STEP)
                rest, waits = one.unconsumed_tail, len(out) < STEP and not one.unconsumed_tail
            if out:
                yield out
            if waits and not one.eof:
                rest = source.read(STEP)
                if not rest:
                    return
        rest = one.unused_data
        while len(rest) < 4 and (more := source.read(STEP)):
            rest += more
        if _format(rest) != name:
            return


def _members(name: str, chunks, left: list[int], failed: list[bool]):
    """What all members hold, until an error (noted in failed) or until nothing is left of the bound."""
    try:
        for data in _member_chunks(name, _Source(chunks)):
            if left[0] <= 0:
                return
            left[0] -= len(data)
            yield data
    except (zlib.error, OSError, ValueError, EOFError):
        failed[0] = True
    except Exception as error:  # zstandard's own error class
        if type(error).__name__ != "ZstdError":
            raise
        failed[0] = True


def _readable(text: str) -> bool:
    """Whether a decoded text has hardly any control characters."""
    plain = text.replace("\t", "").replace("\r", "").replace("\n", "")
    return bool(text) and (plain.isprintable() or sum(not c.isprintable() for c in plain) <= len(text) // 20)


def _encoding(head: bytes) -> str:
    """UTF-16 by its mark, or because every second byte of the first 64 or fewer is zero (nearly all); else UTF-8."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    pairs = min(len(head), 64) // 2
    for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        if pairs >= 5 and 10 * head[first : 2 * pairs : 2].count(0) >= 9 * pairs and not head[1 - first : 2 * pairs : 2].count(0):
            return name
    return "utf-8"


def _windows(chunks, encoding: str = "utf-8"):
    """(text, whether one of several) of a stream as far as it is text; a run at a window's end opens the next."""
    decoder, held, fresh, several = codecs.getincrementaldecoder(encoding)(), "", 0, False
    try:
        for data in chunks:
            more = decoder.decode(data)
            held, fresh = held + more, fresh + len(more)
            if fresh >= WINDOW and 2 * fresh >= len(held):
                several = True
                if _readable(held):
                    yield held, True
                run = len(held) - len(held.rstrip(_RUN))
                held, fresh = held[-max(OVERLAP, min(run, EXPANSION)) :], 0
        held += decoder.decode(b"", True)
    except UnicodeDecodeError:
        if not several:
            return
    if (fresh or not several) and _readable(held):
        yield held, several


def _texts(source, names: tuple[str, ...], left: list[int]):
    """(text, names, several) of what source() streams, below as many compressed formats as nest."""
    head = _Source(source()).read()[:64]
    name = _format(head[:4])
    if name and len(names) <= 64:
        failed = [False]
        yield from _texts(lambda: _members(name, source(), left, failed), (*names, name), left)
        if not failed[0]:
            return
    for text, several in _windows(source(), _encoding(head)):
        yield text, names, several


def _joined(text: str):
    """(start, end, run) of base64 in lines of one width, of which the last may be shorter."""
    for m in _LINES.finditer(text):
        lines = [(x.start(), x.end(), x.group()) for x in re.finditer(r"[^\r\n]+", m.group())]
        k = 0
        while k < len(lines):
            width, first = len(lines[k][2]), k
            while k + 1 < len(lines) and len(lines[k + 1][2]) == width and "=" not in lines[k][2]:
                k += 1
            # A shorter line ends a block; a longer one opens another.
            if k + 1 < len(lines) and len(lines[k + 1][2]) < width and "=" not in lines[k][2]:
                k += 1
            if k > first and width >= 16:
                yield m.start() + lines[first][0], m.start() + lines[k][1], "".join(x[2] for x in lines[first : k + 1])
            k += 1


def _unwrapped(layer: Layer):
    """The layers directly below."""
    if "%" in layer.text and (below := _rewritten(layer, _PERCENT, _from_percent, "url")):
        yield below._replace(window=layer.window)
    if ("\\" in layer.text or "&#" in layer.text) and (below := _rewritten(layer, _ESCAPE, _from_escape, "unicode")):
        yield below._replace(window=layer.window)
    runs = ((m.start(), m.end(), m.group(), True) for m in _BASE64.finditer(layer.text))
    for start, end, found, straight in chain(runs, ((*x, False) for x in _joined(layer.text))):
        run = found.rstrip("=").translate({45: 43, 95: 47})
        whole = False
        if len(run) % 4 != 1:
            a, b = layer.span(start, end)
            for text, names, several in _texts(_chunked(_decoded(run)), ("base64",), [BOMB]):
                whole = True
                yield Layer(text, (a, b), (*layer.names, *names), several)
        if whole:
            continue
        for text, names, several, first, last in _aligned(run):
            a, b = layer.span(start + first, start + min(last, len(run))) if straight else layer.span(start, end)
            yield Layer(text, (a, b), (*layer.names, *names), several)


def _decoded(run: str) -> bytes:
    return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)


def _chunked(data: bytes, begin: int = 0):
    return lambda: (data[k : k + STEP] for k in range(begin, len(data), STEP))


def _aligned(run: str):
    """(text, names, several, first and last character of the run) of what is readable at any of the four alignments."""
    for skip in range(min(4, len(run))):
        part = run[skip:]
        data = _decoded(part[:-1] if len(part) % 4 == 1 else part)
        place = lambda at: skip + at // 3 * 4
        for m in _STRETCH.finditer(data):
            yield m.group().decode("utf-8", "replace"), ("base64",), False, place(m.start()), place(m.end() + 2)
        for pattern, encoding in _WIDE:
            for m in pattern.finditer(data):
                yield m.group().decode(encoding), ("base64",), False, place(m.start()), place(m.end() + 2)
        for m in _OPENS.finditer(data):
            if m.start() or skip:  # the block at the very start was read with the whole run
                for text, names, several in _texts(_chunked(data, m.start()), ("base64",), [BOMB]):
                    if len(names) > 1:
                        yield text, names, several, place(m.start()), len(run)


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[Finding]]:
    """The matches in the text itself, and all findings with those of unwrapped layers."""
    base = scan(text)
    found = {(s, r, e): Finding(s, r, e, "") for s, r, e in base}
    work = deque([Layer(text, None, ())])
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}

    def visit(layer: Layer) -> None:
        if layer.names:
            for start, rank, end in scan(layer.text):
                a, b = layer.span(start, end)
                found.setdefault((a, rank, b), Finding(a, rank, b, ">".join(layer.names)))
        for below in _unwrapped(layer):
            # A base64 run may recur elsewhere: the place belongs to what makes a layer new.
            place = below.span(0, len(below.text)) if below.text else (0, 0)
            key = hashlib.blake2b(f"{place}".encode() + below.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                # Windows are not queued: one is held at a time.
                visit(below) if below.window else work.append(below)

    while work:
        visit(work.popleft())
    return base, sorted(found.values())


def redact(text: str, findings: list[Finding], mark: str = "[secret]") -> str:
    """The text with each (merged) finding replaced."""
    out, at = [], 0
    for f in findings:
        if f.end <= at:
            continue
        if f.start >= at:
            out += [text[at : f.start], mark]
        at = f.end
    return "".join([*out, text[at:]])


def _each(texts: pa.Array):
    """(text, whether it may hold anything) for each text."""
    return zip(texts.to_pylist(), pc.match_substring_regex(texts, _ANY).to_pylist(), strict=True)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Each row with `findings` (kind, start, end, layers) and `redacted` (null where nothing was found)."""
    schema = "findings array<struct<kind:string,start:int,end:int,layers:string>>, redacted string"

    def run(_, texts: pa.Array) -> dict[str, pa.Array]:
        rows, clean = [], []
        for text, maybe in _each(text_array(texts)):
            found = find_secrets(text)[1] if maybe else []
            rows.append([{"kind": KINDS[f.rank], "start": f.start, "end": f.end, "layers": f.layers} for f in found])
            clean.append(redact(text, found) if found else None)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layers", pa.string())]))
        return {"findings": pa.array(rows, kind), "redacted": pa.array(clean, pa.string())}

    return annotate(docs, run, schema)


def digest_documents(docs: DataFrame) -> DataFrame:
    """Each row with the counts and digest of base findings, and all spans as text."""

    def run(_, texts: pa.Array) -> dict[str, pa.Array]:
        counts, digests, spans = [], [], []
        for text, maybe in _each(text_array(texts)):
            base, found = find_secrets(text) if maybe else ([], [])
            counts.append([sum(r == k for _, r, _ in base) for k in range(len(KINDS))])
            digests.append(hashlib.sha256(",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e in base).encode()).hexdigest())
            spans.append(",".join(f.text for f in found))
        table = np.array(counts, dtype=np.int64).reshape(-1, len(KINDS))
        return {f"n_{k}": pa.array(table[:, i]) for i, k in enumerate(KINDS)} | {"base_sha256": pa.array(digests, pa.string()), "spans": pa.array(spans, pa.string())}

    return annotate(docs, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with every secret replaced; n_chars, where there is one, counts the new text. Rows without findings stay as they are."""
    columns = []
    for c in docs.columns:
        old = F.col(f"row.`{c}`")
        if c == "text":
            old = F.coalesce(F.col("redacted"), old)
        elif c == "n_chars":
            old = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast(docs.schema[c].dataType)).otherwise(old)
        columns.append(old.alias(c))
    return scan_documents(docs).select(*columns)
