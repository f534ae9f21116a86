"""Secret scanning with a recursive decoding worklist.

The base patterns run over the whole text. Then wrapped layers are taken off: percent escapes, Unicode and HTML
escapes, base64, hex, and gzip, zlib, bzip2, xz or zstd streams inside base64 or hex, broken into lines or not. Each layer is scanned again and its own
wrapped parts join the worklist, until none is left. A layer with a text that came from the same place before isn't entered again,
so that cycles end, and a text that is wrapped twice is found at both places. Each layer knows for each of its characters the range of the document it came from; spans found in
it are mapped back.
"""

from __future__ import annotations

import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm._tables import freeing, read
from scholium.runtime import ship

KINDS = ("assign", "access", "hex")
#: Bytes of one piece of an unpacked layer, longer ones are several; of what is unpacked at once. Texts themselves are read whole, whatever their length.
UNPACKED, PART = 1 << 26, 1 << 20
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of any length with the short ones dropped

_TOKEN = re.compile(r"\S+")
#: Tokens on either side of an escape that are decoded with it, where only spaces part them: no pattern spans more than three.
REACH = 2
_PERCENT_ONE = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE_ONE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|quot|apos|amp|equals|colon|lt|gt);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+(?:\r\n?|\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: How the known kinds of streams begin in base64.
_STREAM = re.compile("H4sI|Qlpo|/Td6|KLUv|eAE|eF[4-7]|eJ[w-z]|eN[o-r]")
_HEX_RUN = re.compile(r"[0-9a-fA-F]+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Every pattern and every wrapping needs as many neighbouring ASCII characters; bytes without them hold nothing.
_ASCII = re.compile(r"[\t-\x7e]{6}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost and without overlap in each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """Text and, for each character, where in the document it comes from; whole: all of it from one range."""

    __slots__ = ("text", "starts", "ends", "whole", "chain")

    def __init__(self, text, starts=None, ends=None, whole=None, chain=""):
        self.text, self.starts, self.ends, self.whole, self.chain = text, starts, ends, whole, chain

    def at(self, s: int, e: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return (s, e) if self.starts is None else (self.starts[s], max(self.ends[s:e]))


def _around(t: str, one: re.Pattern):
    """Stretches (start, end) of tokens with escapes and their neighbours in a line, apart from each other."""
    tokens = [m.span() for m in _TOKEN.finditer(t)]
    first = [a for a, _ in tokens]
    last, lo, hi = -1, 0, -1
    for m in one.finditer(t):
        i = bisect_right(first, m.start()) - 1
        if i == last:
            continue
        last, a, z = i, i, i
        while a > max(0, i - REACH) and not t[tokens[a - 1][1] : tokens[a][0]].strip(" "):
            a -= 1
        while z < min(len(tokens) - 1, i + REACH) and not t[tokens[z][1] : tokens[z + 1][0]].strip(" "):
            z += 1
        if a <= hi:
            hi = max(hi, z)
            continue
        if hi >= 0:
            yield tokens[lo][0], tokens[hi][1]
        lo, hi = a, z
    if hi >= 0:
        yield tokens[lo][0], tokens[hi][1]


def _pieces(layer: _Layer, s: int, e: int, one: re.Pattern, decode) -> _Layer:
    text, starts, ends, at = [], [], [], s
    for m in one.finditer(layer.text, s, e):
        for i in range(at, m.start()):
            a, b = layer.at(i, i + 1)
            text.append(layer.text[i]), starts.append(a), ends.append(b)
        a, b = layer.at(m.start(), m.end())
        got = decode(m.group())
        text.append(got)
        starts += [a] * len(got)
        ends += [b] * len(got)
        at = m.end()
    for i in range(at, e):
        a, b = layer.at(i, i + 1)
        text.append(layer.text[i]), starts.append(a), ends.append(b)
    return _Layer("".join(text), starts, ends)


def _unpercent(x: str) -> str:
    return bytes.fromhex(x.replace("%", "")).decode("utf-8", "replace")


def _unescape(x: str) -> str:
    if x[0] == "&":
        return {"&equals;": "=", "&colon;": ":"}.get(x) or html.unescape(x)
    return codecs.decode(x, "unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _members(raw: bytes):
    """What the known kinds of streams at the beginning of raw unpack to, one after another, in parts of at most PART bytes."""
    while raw:
        if raw.startswith(b"\x1f\x8b") or raw[:2] in (b"x\x01", b"x\x5e", b"x\x9c", b"x\xda"):
            d = zlib.decompressobj(31 if raw.startswith(b"\x1f\x8b") else 15)
            while not d.eof:
                got = d.decompress(raw, PART)
                raw = d.unconsumed_tail
                yield got
                if not got and not raw:
                    break
        elif raw.startswith((b"BZh", b"\xfd7zXZ")):
            d = bz2.BZ2Decompressor() if raw.startswith(b"BZh") else lzma.LZMADecompressor()
            while not d.eof:
                yield d.decompress(raw, PART)
                raw = b""
                if not d.eof and d.needs_input:
                    break
        elif raw.startswith(b"\x28\xb5\x2f\xfd"):
            d = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            while got := d.read(PART):
                yield got
            return
        else:
            return
        raw = d.unused_data.lstrip(b"\0") if d.eof else b""


def _unpack(raw: bytes):
    """raw decompressed, if it begins a known kind of stream, as far as it isn't damaged, in pieces of UNPACKED bytes that overlap by half."""
    held = bytearray()
    more = False
    try:
        for got in _members(raw):
            held += got
            while len(held) >= UNPACKED:
                yield bytes(held[:UNPACKED])
                del held[: UNPACKED // 2]
                more = True
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):
        pass
    if len(held) > (UNPACKED // 2 if more else 0):
        yield bytes(held)


def _unwrapped(layer: _Layer):
    """The layers directly inside this one."""
    t = layer.text
    if "%" in t:
        for s, e in _around(t, _PERCENT_ONE):
            yield "url", _pieces(layer, s, e, _PERCENT_ONE, _unpercent)
    if "\\" in t or "&" in t:
        for s, e in _around(t, _ESCAPE_ONE):
            yield "escape", _pieces(layer, s, e, _ESCAPE_ONE, _unescape)
    for m in _BASE64.finditer(t):
        yield from _decoded(layer, m.group(), range(*m.span()))
    if "\n" in t or "\r" in t:
        for at in _wrapped(t):
            yield from _decoded(layer, "".join([t[i] for i in at]), at)


def _wrapped(t: str):
    """Places of the characters of runs broken into lines: lines of one width, with and without the line before and the one after, and all that follow each other."""
    for m in _LINES.finditer(t):
        lines = [x.span() for x in _LINE.finditer(t, *m.span())]
        width = [b - a for a, b in lines]
        edges = [0, *[i for i in range(1, len(lines)) if width[i] != width[i - 1]], len(lines)]
        parts = {(0, len(lines))}
        for a, z in zip(edges[:-1], edges[1:]):
            parts |= {(x, y) for x in (max(a - 1, 0), a) for y in (z, min(z + 1, len(lines))) if y - x > 1}
        for a, z in sorted(parts):
            if sum(width[a:z]) >= 12:
                yield [i for x, y in lines[a:z] for i in range(x, y)]


def _decoded(layer: _Layer, x: str, at):
    """The layers in a run of base64 or hex, whose characters stand at these places of the layer. Letters that happen to stand before it shift it, so every shift is tried."""
    body = x.rstrip("=")
    if not (body.isalpha() and (body.islower() or body[1:].islower()) and len(body) < 64):
        code = body.replace("-", "+").replace("_", "/")
        for k in range(4):
            some = code[k : len(code) - ((len(code) - k) % 4 == 1)]
            if len(some) < 11:
                break
            raw = binascii.a2b_base64(some + "=" * (-len(some) % 4))
            yield from _bytes_layer(raw, layer, at[k:], layer.at(at[k], at[-1] + 1), "base64")
        for m in _STREAM.finditer(code, 1):
            k = m.start()
            head = code[k : min(len(code), k + 4096)]
            if next(_unpack(binascii.a2b_base64(head[: len(head) // 4 * 4])), None):
                some = code[k : len(code) - ((len(code) - k) % 4 == 1)]
                yield from _bytes_layer(binascii.a2b_base64(some + "=" * (-len(some) % 4)), layer, at[k:], layer.at(at[k], at[-1] + 1), "base64")
    if len(body) >= 24 and _HEX_RUN.fullmatch(body):
        for k in range(2):
            some = body[k : len(body) - (len(body) - k) % 2]
            yield from _bytes_layer(bytes.fromhex(some), layer, at[k:], layer.at(at[k], at[-1] + 1), "hex")


def _texts(raw: bytes):
    """What bytes may say: as UTF-8, and as UTF-16 of either order."""
    for code in ("utf-8", "utf-16-le", "utf-16-be"):
        text = raw.decode(code, "replace")
        if _ASCII.search(text):
            yield text


def _bytes_layer(raw: bytes, layer: _Layer, at, whole: tuple[int, int], name: str):
    packed = False
    for got in _unpack(raw):
        packed = True
        for text in _texts(got):
            yield name + "+compressed", _Layer(text, whole=whole)
    if packed:
        return
    for text in _texts(raw):
        if layer.whole or len(text) != len(raw):
            yield name, _Layer(text, whole=whole)
            continue
        if name == "hex":
            first, last = [2 * i for i in range(len(raw))], [2 * i + 1 for i in range(len(raw))]
        else:
            first = [i // 3 * 4 + i % 3 for i in range(len(raw))]
            last = [min(len(at), k + 2) - 1 for k in first]
        yield name, _Layer(text, [layer.at(at[k], at[k] + 1)[0] for k in first], [layer.at(at[k], at[k] + 1)[1] for k in last])


def _identity(text: str, place: tuple[int, int]) -> bytes:
    return hashlib.sha256(repr(place).encode() + text.encode("utf-8", "surrogatepass")).digest()


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base spans of a text, and the further ones found in its layers as (kind number, start, end, layers).

    Null counts as empty. Equal spans count once.
    """
    text = text or ""
    base = base_spans(text)
    known, more = set(base), []
    seen = {_identity(text, (0, len(text)))}
    layer = _Layer(text)
    work = [(layer, _unwrapped(layer))]
    while work:  # the innermost first, so that only one piece of a long layer is held
        layer, inside = work[-1]
        how, inner = next(inside, (None, None))
        if inner is None:
            work.pop()
            continue
        if not inner.text or inner.text == layer.text:
            continue
        key = _identity(inner.text, inner.whole or (inner.starts[0], inner.ends[-1]))
        if key in seen:
            continue
        seen.add(key)
        inner.chain = f"{layer.chain}>{how}".lstrip(">")
        for kind, s, e in base_spans(inner.text):
            span = (kind, *inner.at(s, e))
            if span not in known:
                known.add(span)
                more.append((*span, inner.chain))
        work.append((inner, _unwrapped(inner)))
    return base, more


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans))


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, layers string, redacted string"


def scan_texts(texts: list[str | None], redact: bool) -> list[list]:
    cols: list[list] = [[] for _ in range(8)]
    for t in texts:
        base, more = scan(t)
        n = [0, 0, 0]
        for k, _, _ in base:
            n[k] += 1
        spans = base + [x[:3] for x in more]
        row = [*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), len(more), ",".join(sorted({x[3] for x in more})), None]
        if redact:
            row[7] = mask(t, spans)
        for c, v in zip(cols, row):
            c.append(v)
    return cols


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each union of overlapping spans replaced by the first one's kind in angle brackets; null stays null."""
    if not spans or text is None:
        return text
    out, at, end, kind = [], 0, -1, 0
    for s, k, e in sorted((s, k, e) for k, s, e in spans):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(f"<{KINDS[kind]}>")
            at = end
        out.append(text[at:s])
        end, kind = e, k
    return "".join([*out, f"<{KINDS[kind]}>", text[end:]])


def find_secrets(df: DataFrame, text: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """The kept columns of each row, and n_assign, n_access, n_hex (base spans), base_sha256, spans (all spans, in code
    points), n_decoded (spans found in layers), layers (how they were wrapped) and, with redact, the text with all spans masked.

    A null text counts as empty, and stays null when redacted. Empty tables give no rows. Repeated rows are scanned each on its own. A kept column
    whose name clashes with one of these, in any case of letters, comes out with _in after it.
    """
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    out_name = {c: c + "_in" if c.lower() in names else c for c in keep}
    own = {f.name: f"c{i}" for i, f in enumerate(df.schema) if f.name in keep}  # while the scan runs, as names may hold anything
    fields = [*[f"{own[f.name]} {f.dataType.simpleString()}" for f in df.schema if f.name in own], _SCHEMA]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                cols = scan_texts(part.column(len(own)).to_pylist(), redact)
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(part.columns[: len(own)] + [pa.array(c, t) for c, t in zip(cols, kinds)], [*own.values(), *names])

    out = df.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()], F.col(f"`{text}`").alias("__text")).mapInArrow(freeing(run), ", ".join(fields))
    return out.select(*[F.col(o).alias(out_name[c]) for c, o in own.items()], *[n for n in names if redact or n != "redacted"])


def op9_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


QUERIES = {"op9_secret_layers": op9_secret_layers}
