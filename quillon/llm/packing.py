"""Packing by power-of-two decomposition.

Every document becomes token ids plus an end id; that run is cut into pieces whose lengths are powers of two: as many
of the full sequence length as fit, then the binary digits of the rest from high to low. Pieces of equal length
share a bucket, and each piece is one sequence, so no sequence crosses documents and none needs padding.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import documents, give_back, released, slices

#: Distinct chunks, and ids of them, that a worker remembers from one step to the next; bytes of text that one step takes, but for a longer text.
CACHE_CHUNKS, CACHE_IDS, STEP_BYTES = 150_000, 1_500_000, 2_000_000
#: Chunks that are encoded together; a letter and a mark, which the tokenizer always parts.
JOIN, MARKS = 200, r'([a-zA-Z])([.,;:!?)"])'
_ENCODERS: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of a tokenizer that drops white space, found once for each distinct chunk between blanks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges without normalizer and patterns, for words that need neither; the model is held once
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        suffix = self.tokenizer.model.end_of_word_suffix
        #: Which ids end a word, and the character that stands for each byte in the vocabulary.
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.words.get_vocab().items() if t.endswith(suffix)]] = True
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.of_byte = dict(zip([*printed, *(x for x in range(256) if x not in printed and x != 32)], [*printed, *range(256, 288), *range(289, 324)]))
        self.clear()

    def clear(self):
        #: Number of each known chunk; the ids of all of them in a row, and where those of a chunk end. Chunk 0 is empty.
        self.number: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(2, np.int64)

    def _add(self, chunks: list[str], ids: np.ndarray, count: np.ndarray):
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks))))
        used, total = int(self.ends[-1]), int(self.ends[-1]) + len(ids)
        if total > len(self.ids):
            self.ids = np.append(self.ids[:used], np.zeros(2 * total - used, "<u4"))
        self.ids[used:total] = ids
        self.ends = np.append(self.ends, used + np.cumsum(count))

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any chunks, and how many each has. Chunks are encoded many to a text, and told apart by their places in it."""
        groups, ids, count = [chunks[i: i + JOIN] for i in range(0, len(chunks), JOIN)], [], []
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            start = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
            ids.append(np.array(e.ids, "<u4"))
            place = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            count.append(np.bincount(np.searchsorted(start, place, side="right"), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(count)

    def _encoded_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of lower-case letters: the last id of each is one that ends a word."""
        groups = [" ".join(words[i: i + JOIN]).encode().decode("latin1").translate(self.of_byte) for i in range(0, len(words), JOIN)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.words.encode_batch_fast(groups, add_special_tokens=False)])
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]), prepend=-1)

    def _learn(self, chunks: list[str]):
        words = list(map(_is_word, chunks))
        for encode, kind in ((self._encoded_words, True), (self._encoded, False)):
            new = [c for c, w in zip(chunks, words) if w is kind]
            for i in range(0, len(new), 100 * JOIN):
                self._add(new[i: i + 100 * JOIN], *encode(new[i: i + 100 * JOIN]))

    def _ids_of(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        shift = self.ends[:-1][number] - (np.cumsum(count) - count)
        return self.ids[np.repeat(shift, count) + np.arange(int(count.sum()))]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's followed by ``end_id``; and the number of ids of each text."""
        if len(self.number) > CACHE_CHUNKS or self.ends[-1] > CACHE_IDS:
            self.clear()
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # but for special strings, case does not matter
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKS, r"\1 \2")
        lists = pc.split_pattern(texts, " ")
        chunks = lists.flatten().dictionary_encode()
        words = chunks.dictionary.to_pylist()
        if new := [w for w in words if w not in self.number]:
            self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        code = number[chunks.indices.to_numpy()]
        size = np.diff(self.ends)[code]
        stop = np.cumsum(pc.list_value_length(lists).to_numpy())  # texts have one chunk at least
        upto = np.cumsum(size)
        n = np.diff(upto[stop - 1], prepend=0) + 1
        out = np.full(int(n.sum()), end_id, "<u4")
        inside = np.ones(len(out), bool)
        inside[np.cumsum(n) - 1] = False
        out[inside] = self._ids_of(code, size)
        return out, n


def _is_word(chunk: str) -> bool:
    """Whether nothing about a chunk needs to be normalized or cut: letters before U+0250 in lower case (beyond, case depends on neighbours)."""
    return chunk.isalpha() and max(chunk) < "\u0250" and chunk.lower() == chunk


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
        give_back()  # what reading the vocabulary took
    return _ENCODERS[path]


def pieces(n: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, length)`` of the pieces of runs of ``n`` ids: powers of two, none above ``max_len``, largest first."""
    bits = max_len >> np.arange(1, max_len.bit_length())
    rest = (n % max_len)[:, None] & bits
    own, bit = np.nonzero(rest)
    which = np.concatenate([np.repeat(np.arange(len(n)), n // max_len), own])
    length = np.concatenate([np.full(int((n // max_len).sum()), max_len), bits[bit]])
    order = np.argsort(which, kind="stable")
    return which[order], length[order]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_len: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, start, length, bucket, doc_tokens, ids, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; ``bucket`` is the binary logarithm of
    the length (write with ``partitionBy("bucket")`` to have one folder a length). ``max_len`` is a power of two.
    Null and empty texts give the end id alone. Rows that repeat a ``doc_id``, or have none, are packed each for itself.
    Only ``doc_id`` and ``text`` are read. An empty table gives no rows.
    The work is per row: no shuffle, and a batch of documents is all that a task holds.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    schema = "doc_id long, start long, length long, bucket int, doc_tokens long, ids binary"

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, 1, STEP_BYTES):
                ids, n = enc.encode(part.column(1), end_id)
                which, length = pieces(n, max_len)
                ends = np.cumsum(length)  # pieces follow each other as the ids do
                start = ends - length - (np.cumsum(n) - n)[which]
                held = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int32)), pa.py_buffer(ids)])
                columns = [part.column(0).take(pa.array(which)), *map(pa.array, (start, length, np.log2(length).astype(np.int32), n[which])), held]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "bucket", "doc_tokens", "ids"])
        enc.clear()

    out = documents(docs).mapInArrow(released(run), schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
