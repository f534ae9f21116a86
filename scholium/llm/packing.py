"""Order-preserving packing: documents stay in their order; dynamic programming chooses the cuts between sequences.

A sequence may hold `capacity` tokens. Cuts cost: at a document's end nothing, at a sentence's end a little, elsewhere more; padding costs its
tokens. With f(j) the least cost of everything before boundary j,

    f(j) = penalty(j) + min over i with pos(j) - pos(i) <= capacity of f(i) + capacity - (pos(j) - pos(i)),

so f(i) + pos(i) is all that matters of i, and its sliding-window minimum is kept by a monotone queue: each boundary enters and leaves
once. Boundaries are all sentence and document ends, and between them clause ends and, in longer stretches, places in mid-sentence, thinned out to one in GRID tokens.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm._shingles import SEGMENT, words
from scholium.llm._tables import freeing, give_back, read
from scholium.runtime import ship

CAPACITY, END_ID = 4096, 2
#: What a cut costs, in tokens of padding.
SENTENCE_CUT, CLAUSE_CUT, HARD_CUT = 2, 6, 16
#: A hard boundary is offered every so many tokens inside a longer sentence or clause.
HARD_EVERY = 32
#: Of the boundaries in a stretch of so many tokens that end neither a sentence nor a document, only the cheapest is offered, and none beside a sentence's end.
GRID = 16
#: Tokens gathered before cuts are chosen; the last sequences' worth is chosen again with what follows.
GATHER, REDO = 1 << 19, 8

#: Distinct words remembered by a process, some 150 bytes each; beyond it the memory starts anew.
_CACHE_WORDS = 800_000


class WordTokens:
    """Token ids of whole texts, by white-space word.

    The vocabulary's normaliser, splitter and merges never look across ASCII white space, so a text's ids are its
    words' ids in a row. Words are told apart by 64-bit hashes, found for a megabyte at a time in numpy; each distinct word is
    tokenised once while the process remembers it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.tok = Tokenizer.from_file(path)
        self.index: dict[int, int] = {}  # by a word's 64-bit hash
        self.pool = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int32)
        self.used = 0
        vocab = self.tok.get_vocab()
        # the same merges without normaliser and splitter, for words that are normal already
        spec = json.loads(self.tok.to_str())
        self.lean = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many are each word's."""
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.int32, int(n.sum())), n

    def _plain_ids(self, words: list[bytes], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words in the merges' own letters, with a space before each further part: encoded in one go, as each part ends in an id that closes it."""
        ids = np.array(self.lean.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.int32)
        closing = np.flatnonzero(self.closes[ids])
        last = np.cumsum(parts) - 1
        if len(closing) != last[-1] + 1 or closing[-1] != len(ids) - 1:
            raise AssertionError("a part without a closing id")
        return ids, np.diff(closing[last], prepend=-1)

    def _add(self, keys: list[int], raw: list[bytes]) -> list[int]:
        """Remembers words; the result is the order of the arguments in which they are numbered."""
        plain, lean, parts, other = [], [], [], []
        for k, w in enumerate(raw):
            if w.isalpha():  # of bytes: ASCII letters
                plain.append(k), lean.append(w.lower()), parts.append(1)
                continue
            body, mark = (w[:-1], w[-1:]) if w[-1] in b".,!?;:" else (w, b"")
            if body.isalpha():
                plain.append(k), lean.append(body.lower() + b" " + mark), parts.append(2)
                continue
            if not body.isascii():
                x = body.decode("utf-8", "replace")
                if x.isalpha() and "\u03a3" not in x and is_normalized("NFC", x) and (x := x.lower()).isalpha():
                    x = x.encode().decode("latin-1").translate(_LETTERS).encode()
                    plain.append(k), lean.append(x + b" " + mark if mark else x), parts.append(2 if mark else 1)
                    continue
            other.append(k)
        ids, n = self._plain_ids(lean, parts) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        if other:
            more, m = self._ids([raw[k].decode("utf-8", "replace") for k in other])
            ids, n = np.concatenate([ids, more]), np.concatenate([n, m])
        first, at = len(self.index), self.used
        while at + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        while first + len(raw) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.count = np.concatenate([self.count, np.zeros(len(self.count), np.int64)])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.uses), np.int32)])
        self.pool[at : at + len(ids)] = ids
        self.count[first : first + len(raw)] = n
        self.start[first : first + len(raw)] = at + np.cumsum(n) - n
        self.used = at + len(ids)
        order = plain + other
        self.index.update(zip([keys[k] for k in order], range(first, first + len(raw))))
        return order

    def _forget(self) -> None:
        """Keeps the words met in more megabytes than most, half the bound at most."""
        n = len(self.index)
        least = max(2, int(np.partition(self.uses[:n], n - _CACHE_WORDS // 2)[n - _CACHE_WORDS // 2]) + 1)
        keep = np.flatnonzero(self.uses[:n] >= least)
        number = np.full(n, -1)
        number[keep] = np.arange(len(keep))
        number = number.tolist()
        self.index = {w: number[k] for w, k in self.index.items() if number[k] >= 0}
        m = self.count[keep]
        ends = np.cumsum(m)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.pool[np.repeat(self.start[keep] - (ends - m), m) + np.arange(total)]
        self.pool[:total], self.used = flat, total
        self.count[: len(keep)], self.start[: len(keep)] = m, ends - m
        self.uses[: len(keep)] = self.uses[keep] // 2
        self.uses[len(keep) :] = 0

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or b"") < SEGMENT):
                size += len(texts[to] or b"") + 1
                to += 1
            out += self._encode([t or b"" for t in texts[at:to]])
            at = to
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > _CACHE_WORDS:
            self._forget()
        raw = b" ".join(texts)
        h, start, end = words(np.frombuffer(raw, np.uint8))
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(start, first)
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        found = list(map(self.index.get, keys))
        if None in found:
            new = [k for k, x in enumerate(found) if x is None]
            at = where[new]
            first_new = len(self.index)
            order = self._add([keys[k] for k in new], [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            for x, k in enumerate(order, first_new):
                found[new[k]] = x
        k = np.array(found, np.int64)
        self.uses[k] += 1
        # first the distinct words' ids, close together, then all words' from these
        n = self.count[k]
        ends = np.cumsum(n)
        near = self.pool[np.repeat(self.start[k] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        back = back.astype(np.int32)
        begin = (ends - n).astype(np.int32)[back]
        n = n.astype(np.int32)[back]
        ends = np.cumsum(n)
        flat = near[np.repeat(begin - (ends - n).astype(np.int32), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        ends = np.append(0, ends)[bounds]
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _letters() -> dict[int, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _letters()
_TOKENS: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    """One for each process, as its cache is worth keeping."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def cut_prices(vocab: dict[str, int]) -> np.ndarray:
    """By id: what a cut after it costs, where that ends a sentence or a clause; else 0, for none."""
    out = np.zeros(max(vocab.values()) + 1, np.int8)
    for w, i in vocab.items():
        if w.endswith("</w>") and (w := w[:-4]):
            out[i] = SENTENCE_CUT if set(w) <= set(".!?") else CLAUSE_CUT if set(w) <= set(",;:|") else 0
    out[END_ID] = 0
    return out


def choose_cuts(pos: np.ndarray, cost: np.ndarray, capacity: int = CAPACITY, more: bool = False) -> list[int]:
    """Indices into pos of the chosen cuts, the last included; if more follows, the last chosen is the least wasteful of those a sequence could end at last. pos rises from above 0, in steps of at most capacity; cost is each cut's penalty."""
    where, price = pos.tolist(), cost.tolist()
    n = len(where)
    back, total = [0] * n, [0] * n
    # the queue, from head to tail: f(i) + pos(i), pos(i) and i of the candidates, least first
    least, place, which, head, tail = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), 0, 0
    for j in range(n):
        p = where[j]
        low = p - capacity
        while place[head] < low:
            head += 1
        v = least[head] + price[j] + capacity  # f(j) + pos(j)
        back[j] = which[head]
        while tail >= head and least[tail] >= v:
            tail -= 1
        tail += 1
        least[tail], place[tail], which[tail] = v, p, j
        total[j] = v
    cuts, j = [], n - 1
    if more:
        waste = np.array(total) - pos  # f
        near = np.searchsorted(pos, where[-1] - capacity, side="right")
        j = int(near + waste[near:].argmin())
    while j >= 0:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _boundaries(length: int, price: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one document: the positions after which a cut may come, and what each costs. price: of a cut after each id, 0 for none."""
    marks = np.flatnonzero(price)
    costs = price[marks].astype(np.int64)
    marks = marks + 1
    if not len(marks) or marks[-1] != length:
        marks, costs = np.append(marks, length), np.append(costs, 0)
    costs[-1] = 0
    gaps = np.diff(marks, prepend=0)
    step, grid = min(HARD_EVERY, max(1, cap // 4)), min(GRID, max(1, cap // 4))  # so that no gap is longer than a sequence
    long = np.flatnonzero(gaps > step)
    if len(long):
        hard = np.concatenate([np.arange(marks[k] - gaps[k] + step, marks[k], step) for k in long])
        marks, costs = np.concatenate([marks, hard]), np.concatenate([costs, np.full(len(hard), HARD_CUT)])
        order = np.argsort(marks, kind="stable")
        marks, costs = marks[order], costs[order]
    # every sentence's and the document's end; of a short stretch without any, the cheapest, and of those the last
    stretch = marks // grid
    order = np.lexsort((-marks, costs, stretch))
    first = np.concatenate([[True], stretch[1:] != stretch[:-1]])
    keep = costs <= SENTENCE_CUT
    keep[order[first]] = True
    return marks[keep], costs[keep]


def pack_stream(docs: Iterable[tuple[object, np.ndarray]], price: np.ndarray, capacity: int = CAPACITY) -> Iterator[list[tuple]]:
    """Pieces (key, start, ids, document's tokens, sequence from 0, offset) of documents in their order, in lists. price: by id, of a cut after it."""
    held: list[tuple] = []  # (key, ids, first token not yet packed)
    size, seq = 0, 0

    def flush(last: bool):
        nonlocal held, size, seq
        if not held:
            return
        pos, cost, base = [], [], 0
        for _, ids, done in held:
            m, c = _boundaries(len(ids), price[ids], capacity)
            k = np.searchsorted(m, done, side="right")
            pos.append(m[k:] - done + base)
            cost.append(c[k:])
            base += len(ids) - done
        pos, cost = np.concatenate(pos), np.concatenate(cost)
        cuts = pos[choose_cuts(pos, cost, capacity, not last)]
        if not last:
            cuts = cuts[:-REDO]
        out, begin = [], 0
        d, (key, ids, done) = 0, held[0]
        for cut in cuts:
            offset = 0
            while begin < cut:
                n = min(int(cut) - begin, len(ids) - done)
                out.append((key, done, ids[done : done + n], len(ids), seq, offset))
                begin, offset, done = begin + n, offset + n, done + n
                if done == len(ids):
                    d += 1
                    if d == len(held):
                        break
                    key, ids, done = held[d]
            seq += 1
        held = [(key, ids, done), *held[d + 1 :]] if d < len(held) else []
        size = sum(len(ids) - done for _, ids, done in held)
        yield out

    for key, ids in docs:
        held.append((key, ids, 0))
        size += len(ids)
        if size >= GATHER:
            yield from flush(False)
    yield from flush(True)


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, digest: bool = False) -> DataFrame:
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of each piece; with digest, ids_crc32 in place of ids: the checksum of
    the ids as little-endian unsigned 32-bit integers.

    A document is its text's ids and then END_ID; a null or empty text is END_ID alone, a document each. Each partition packs its own rows
    in their order: no row moves. Sequence ids are the partition's number times 2**33 plus the sequence's there. Null and
    repeated keys stay as they are; each row is packed. Empty tables give no rows. Other columns of df are left aside. A key named like a result, in any case of letters, comes out with _in after it.
    """
    ship(df.sparkSession)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind, name = df.schema[key].dataType.simpleString(), "ids_crc32" if digest else "ids"
    rest = ("start", "length", name, "doc_tokens", "sequence_id", "offset")
    key_as = key + "_in" if key.lower() in rest else key

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        give_back()
        tok = tokens_of(tokenizer)
        price = cut_prices(tok.tok.get_vocab())

        def docs():
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    part = b.slice(at, 500)
                    for k, ids in zip(part.column(0).to_pylist(), tok.encode(part.column(1).to_pylist())):
                        yield k, np.append(ids, np.int32(END_ID))

        for pieces in pack_stream(docs(), price, capacity):
            for at in range(0, len(pieces), 5000):
                some = pieces[at : at + 5000]
                lengths = np.array([len(p[2]) for p in some], np.int64)
                if digest:
                    ids = pa.array([zlib.crc32(p[2].astype("<u4").tobytes()) for p in some], pa.int64())
                else:
                    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[2] for p in some]).astype(np.int32)))
                sizes = [pa.array([p[k] for p in some], pa.int64()) for k in (3, 5)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in some], keys), pa.array([p[1] for p in some], pa.int64()), pa.array(lengths), ids, sizes[0], pa.array([first + p[4] for p in some], pa.int64()), sizes[1]],
                    ["key", "start", "length", name, "doc_tokens", "sequence_id", "offset"],
                )

    from pyspark.sql.pandas.types import to_arrow_type

    keys = to_arrow_type(df.schema[key].dataType)
    out = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(freeing(run), f"key {kind}, start long, length long, {name} {'long' if digest else 'array<int>'}, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("key").alias(key_as), *rest)


def op6_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


QUERIES = {"op6_order_preserving_packing": op6_order_preserving_packing}
