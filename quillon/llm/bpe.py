"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a vocabulary entry as a whole.
Tier two: the bytes of any other pre-token form a linked list, and a heap of neighbouring pairs by rank and position
merges them. Each worker remembers the ids of chunks between blanks, so a chunk's pre-tokens are looked up once; a word that
also stands beside marks is merged once for all of its chunks.
"""
from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections import defaultdict

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct chunks whose ids a worker remembers, and the longest that is remembered.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 64
_CODECS: dict[tuple[str, str], "Codec"] = {}


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's content. A path with a scheme is read by Spark, any other by the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


class PerfectHash:
    """Minimal perfect hash: keys fall into buckets, and each bucket has a displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n = n = max(1, len(keys))
        self.buckets = m = max(1, n // load)
        groups: list[list[tuple[int, int]]] = [[] for _ in range(m)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            groups[(h >> 64) % m].append((h & 0xFFFFFFFFFFFFFFFF, i))
        self.shift, self.slots = [0] * m, [-1] * n
        order, at = sorted(range(m), key=lambda g: -len(groups[g])), 0
        for at, g in enumerate(order):
            if len(groups[g]) < 2:
                break
            d = 0
            while True:
                d += 1
                spots = [self._slot(h, d) for h, _ in groups[g]]
                if len(set(spots)) == len(spots) and all(self.slots[s] < 0 for s in spots):
                    break
            self.shift[g] = d
            for s, (_, i) in zip(spots, groups[g]):
                self.slots[s] = i
        free = (s for s in range(n) if self.slots[s] < 0)
        for g in order[at:]:
            if len(groups[g]) == 1:
                s = next(free)
                self.shift[g], self.slots[s] = -s - 1, groups[g][0][1]

    def _slot(self, h: int, d: int) -> int:
        return ((h ^ (d * 0x9E3779B97F4A7C15)) % 0xFFFFFFFFFFFFFFC5) % self.n

    def find(self, key: bytes) -> int:
        """The number of the only key that may equal ``key``; the caller compares."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 64) % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._slot(h & 0xFFFFFFFFFFFFFFFF, d)]


class Codec:
    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.words = [base64.b64decode(a) for a, _ in pairs]
        self.ids = [int(b) for _, b in pairs]
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.rank = dict(zip(self.words, self.ids))
        self.by_id = dict(zip(self.ids, self.words))
        self.hash = PerfectHash(self.words)
        #: For each entry, what gives the entry that it forms with the next, or -1; for each byte, what it forms with each byte.
        after: dict[int, dict[int, int]] = {}
        for w, r in self.rank.items():
            for i in range(1, len(w)):
                if w[:i] in self.rank and w[i:] in self.rank:
                    after.setdefault(self.rank[w[:i]], {})[self.rank[w[i:]]] = r
        self.forms = defaultdict(lambda none={}.get: none, {a: x.get for a, x in after.items()})
        self.two = [[self.rank.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)]
        self.byte = [self.rank.get(bytes([i]), -1) for i in range(256)]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def pre_token(self, piece: bytes) -> bytes:
        """Packed ids of one pre-token."""
        at = self.hash.find(piece)
        if self.words[at] == piece:
            return self.packed[at]
        return array("I", self.merge(piece)).tobytes()

    def merge(self, piece: bytes) -> list[int]:
        """Merges the pair of lowest rank, the leftmost of equal ones, until no neighbours form an entry."""
        n, forms, two, push, pop = len(piece), self.forms, self.two, heapq.heappush, heapq.heappop
        part = list(map(self.byte.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # what each part forms with the next; a heap's entry that says otherwise is out of date
        pair = [two[a][b] for a, b in zip(piece, piece[1:])]
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        pair.append(-1)
        heapq.heapify(heap)
        while heap:
            x = pop(heap)
            r = x // n
            i = x - r * n
            if pair[i] != r:
                continue
            j = after[i]
            part[i], part[j], pair[j] = r, -1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = x = forms[r](part[k], -1)
                if x >= 0:
                    push(heap, x * n + i)
            else:
                pair[i] = -1
            k = before[i]
            if k >= 0:
                pair[k] = x = forms[part[k]](r, -1)
                if x >= 0:
                    push(heap, x * n + k)
        return [x for x in part if x >= 0]

    def plain(self, text: str) -> bytes:
        return b"".join([self.word(x[1:]) if x[0] == " " and x[1:].isalpha() else self.pre_token(x.encode()) for x in self.split(text)])

    def word(self, letters: str) -> bytes:
        """Packed ids of a blank and letters, which are one pre-token and the same as the chunk of those letters."""
        if (ids := self.known.get(letters)) is None:
            ids = self.pre_token(b" " + letters.encode())
            if len(letters) <= CACHE_CHARS:
                self.known[letters] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Packed ids. A single blank or line break between other characters always begins a pre-token, so the text
        is cut there and each chunk looked up; texts with any other white space are split as a whole."""
        if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or OTHER_SPACE(text):
            return self.plain(text)
        first, *chunks = text.replace("\n", " \n").split(" ")
        found = list(map(self.known.get, chunks))
        if None in found:
            new: dict[str, bytes] = {}
            for i, x in enumerate(found):
                if x is None:
                    c = chunks[i]
                    if (ids := new.get(c)) is None:
                        ids = self.word(c) if c.isascii() and c.isalpha() else self.plain(c if c[0] == "\n" else " " + c)
                        new[c] = ids
                    found[i] = ids
            self.known.update((c, x) for c, x in new.items() if len(c) <= CACHE_CHARS)
        out = self.plain(first) + b"".join(found)
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.by_id.__getitem__, memoryview(ids).cast("I").tolist() if ids else ()))


#: White space, by Unicode, besides the blank and the line break.
OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0  -     　]").search


def codec(ranks: bytes, pattern: str) -> Codec:
    key = (xxhash.xxh3_128_hexdigest(ranks), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _mapped(df: DataFrame, source: str, target: str, kind: str, step) -> DataFrame:
    """``df`` with ``target`` = ``step(value of source)``, a batch at a time."""
    keep = [c for c in df.columns if c != target]
    at = keep.index(source)
    schema = ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in df.select(*[F.col(f"`{c}`") for c in keep]).dtypes) + f", `{target}` {kind}"

    def run(batches):
        call = step()
        for batch in batches:
            yield from _slices(batch, at, call, target)

    return df.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, at: int, call, target: str):
    out, size, begin = [], 0, 0
    for i, x in enumerate(batch.column(at)):
        out.append(call(x.as_py()))
        size += len(out[-1] or b"")
        if size > 16_000_000 or i + 1 == batch.num_rows:
            part = batch.slice(begin, i + 1 - begin)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, target])
            out, size, begin = [], 0, i + 1


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the text's token ids as little-endian unsigned 32-bit integers in one binary value.

    Strings of special tokens are ordinary text. Null text: no ids (an empty value). Every other column, repeated rows
    included, is passed through; a column already named like ``ids`` is replaced.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(df.sparkSession, ranks_path))

    def step():
        c = codec(ranks.value, pattern)
        return lambda x: c.encode(x) if x else b""

    return _mapped(df, text, ids, "binary", step)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids. Null ids: an empty value."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(df.sparkSession, ranks_path))

    def step():
        c = codec(ranks.value, pattern)
        return lambda x: c.decode(x) if x else b""

    return _mapped(df, ids, decoded, "binary", step)
