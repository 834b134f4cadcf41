"""Packing, byte-level BPE and fingerprints against brute force."""
import base64
import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import bpe, imatch, packing
from quillon.llm.queries import QUERIES

EDGE = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "Hello  world\n\n it's  12 <|endoftext|> É x y\r\n"), (5, "a"), (None, "b b"), (7, "word " * 9000), (8, "ab" * 3000), (9, "\x00\x01 ß 中文 🎉"), (10, "to <|startoftext|> be<|endoftext|>.")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in EDGE], "doc_id long, text string, length double, ids string")


def test_pieces():
    which, length = packing.pieces(np.array([4096 * 2 + 5, 1, 4096]), 4096)
    assert which.tolist() == [0, 0, 0, 0, 1, 2] and length.tolist() == [4096, 4096, 4, 1, 1, 4096]
    which, length = packing.pieces(np.arange(1, 300), 16)
    assert np.bincount(which, weights=length).tolist() == list(range(1, 300)) and set(length.tolist()) == {1, 2, 4, 8, 16}


def test_ids_of_hard_chunks():
    """Special strings, marks behind words, capitals, joined characters and a cache that is cleared, against the library alone."""
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(P.path("word_bpe_49k.json")), packing.ChunkEncoder(P.path("word_bpe_49k.json"))
    random.seed(8)
    hard = ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "word's.", "It'S", "'s", "n't,", "e\u0301a,", "\u0301", "ΑΣ,", "ΑΣ", "İ.", "ǅ", "ﬁ,", "Ærø!", "a\x0bb", "\u2028", "x\u00a0y", "\u1100\u1161", "½,", "a" * 300, '"q"', "...", "3.14", "中文,", "🎉!", "\x00", "\r"]
    for clear in (10 ** 9, 5):
        packing.CACHE_CHUNKS, before = clear, packing.CACHE_CHUNKS
        texts = [" ".join(random.choices(hard, k=random.randint(0, 40))) for _ in range(60)] + ["", " ", "\n\n", *hard]
        for part in (texts[:30], texts[30:], texts):
            ids, n = enc.encode(pa.array(part), 2)
            ends = np.cumsum(n)
            assert [ids[e - k: e].tolist() for e, k in zip(ends, n)] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in part]
        packing.CACHE_CHUNKS = before


def _packed(df, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    expected = sorted((i is None, i or 0, tok.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens, list(struct.unpack(f"<{r.length}I", r.ids)), r.sequence_id, r.offset))
    assert len({x[4] for p in rows.values() for x in p}) == sum(map(len, rows.values())) and all(x[5] == 0 for p in rows.values() for x in p)
    found = []
    for doc, pieces in rows.items():
        runs: list[list] = []
        for start, length, total, ids, _, _ in pieces:  # the rows of a document come together
            if start == 0:
                runs.append([])
            assert start == len(runs[-1]) and length == len(ids)
            runs[-1] += ids
        found += [(doc is None, doc or 0, r) for r in runs]
    assert sorted(found) == expected


def test_packing(spark, edge, sf_dir):
    path = P.path("word_bpe_49k.json")
    _packed(packing.pack(edge, path), EDGE)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _packed(packing.pack(docs, path), [(r.doc_id, r.text) for r in docs.collect()])
    assert packing.pack(edge.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge, path, max_len=100)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)


def test_perfect_hash(codec):
    h = codec.hash
    assert sorted(h.slots) == list(range(len(codec.words)))
    assert all(h.find(w) == i for i, w in enumerate(codec.words))


def test_bpe_random(tik, codec):
    random.seed(1)
    letters = " \n\t\r  aabB'slreé中文1２ \x1c\x85!?ſ"
    for _ in range(5000):
        s = "".join(random.choice(letters) for _ in range(random.randint(0, 16)))
        ids = codec.encode(s)
        assert list(memoryview(ids).cast("I")) == tik.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


def test_bpe_word_beside_marks_is_merged_once(tik, monkeypatch):
    own, seen = bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda piece: seen.append(piece) or merge(piece))
    text = "A thtionblend, thtionblend. thtionblend (thtionblend) thtionblend&&& thtionblend"
    assert list(memoryview(own.encode(text)).cast("I")) == tik.encode_ordinary(text)
    assert seen.count(b" thtionblend") == 1


def test_bpe_forgets(tik, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 40)
    own = bpe.Codec(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    random.seed(2)
    for _ in range(300):
        text = " ".join(random.choice("thtion ble naux queé X9 end, (a)".split()) * random.randint(1, 4) for _ in range(9))
        assert list(memoryview(own.encode(text)).cast("I")) == tik.encode_ordinary(text)
        assert len(own.known) <= 40


def test_bpe_columns(edge, tik):
    out = bpe.decode(bpe.encode(edge, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert set(out.columns) == {"doc_id", "text", "length", "ids", "decoded"}
    for r in out.collect():
        ids = tik.encode_ordinary(r.text or "")
        assert r.ids == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == (r.text or "").encode()
    assert bpe.encode(edge.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_op8(spark, sf_dir, tik):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_op6(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op6_imatch"](spark, sf_dir).collect()}
    prints = {}
    for i, (doc, text) in enumerate(docs):
        after, half, r = docs[(i + 1) % len(docs)][1], len(text) // 2, rows[doc]
        edited = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (text != after or r.near_next == 1)


@pytest.mark.parametrize("spread", [1, 1_000_003, 1 << 40])
def test_neighbours_of_sparse_and_missing_ids(spark, monkeypatch, spread):
    """Ids next to each other and far apart, below zero, repeated and missing: the next document is right, and ranges hold several rows."""
    monkeypatch.setattr(imatch, "BUCKET", 40)
    random.seed(spread)
    rows = [((i - 150) * spread, f"text {random.randrange(60)} of {'many words ' * (i % 3)}") for i in range(400)] + [(None, random.choice("abcé") * (i % 9) + f" {i}") for i in range(90)] + [(5 * spread, "zz"), (5 * spread, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(((i is None, -(i or 0), (t or "").encode()) for i, t in rows))
    expected = []
    for n, (_, _, t) in enumerate(order):
        text, after = t.decode(), order[(n + 1) % len(order)][2].decode()
        half = len(text) // 2
        expected.append((str(None if order[n][0] else -order[n][1]), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    out = imatch.edited_fingerprints(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in out) == sorted(expected)
    keyed = docs.where("doc_id is not null").selectExpr("doc_id as key", "1 as part")
    sizes = [r["count"] for r in imatch._ranges(keyed).groupBy("part", "low").count().collect()]
    assert sum(sizes) == 402 and (spread == 1 or max(sizes) <= 40) and len(sizes) <= 402 / 2
    assert imatch.edited_fingerprints(docs.limit(0)).count() == 0


def test_fingerprint_by_hand(spark):
    docs = [(i, f"common w{i % 7} v{i % 5} x{i % 3} rare{i}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = imatch.lexicon(df, min_idf=0.5, max_idf=3.0)
    lex = {r.term: r["mask"] for r in words.collect()}
    assert set(lex) == {f"w{i}" for i in range(7)} | {f"v{i}" for i in range(5)} | {f"x{i}" for i in range(3)}
    out = imatch.fingerprints(df, ["doc_id"], "text", words).collect()
    sets = [sorted(t for t in text.split() if t in lex) for _, text in docs]
    by_doc = {r.doc_id: r.prints for r in out}
    for i, s in enumerate(sets):
        assert len(by_doc[i]) == imatch.SUBSETS + 1
        for j, x in enumerate(by_doc[i][1:]):
            assert (x is None) == (not [t for t in s if lex[t] >> j & 1])
        for k in range(i):
            for j in range(imatch.SUBSETS):
                a, b = ([t for t in q if lex[t] >> j & 1] for q in (s, sets[k]))
                assert (by_doc[i][j + 1] == by_doc[k][j + 1]) == (a == b)


def test_edited_edge_rows(spark):
    rows = [(5, None, 1), (5, "same words here", 2), (5, "same words here", 2), (None, "no id", 3), (1_000_000, "far away text", 4), (-3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int")
    out = imatch.edited_fingerprints(df).collect()
    assert len(out) == len(rows) and all(0 <= r.near_next <= 1 for r in out)
    assert imatch.edited_fingerprints(df.limit(0)).count() == 0
    one = imatch.edited_fingerprints(df.where("doc_id = 1000000")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"far awafar aw").hexdigest()


def _near_group(spark, n, group):
    """``group`` copies of one text with 2% of the words changed in each, side by side, among texts of other words."""
    import random

    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = r.sample(vocabulary, 150)
    texts = [" ".join(r.choice(vocabulary) if r.random() < 0.02 else w for w in base) if i < group else " ".join(r.choices(vocabulary, k=150)) for i in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n, group", [(900, 300), (60, 20), (900, 9)])
def test_near_copies_agree_in_groups_of_any_size(spark, n, group):
    rows = {r.doc_id: r for r in imatch.edited_fingerprints(_near_group(spark, n, group)).collect()}
    inside = [rows[i].near_next for i in range(1, group)]
    outside = [rows[i].near_next for i in range(group + 1, n)]
    assert sum(inside) / len(inside) > 0.4 and min(inside) > 0.1
    assert sum(outside) / len(outside) < 0.1


def test_fingerprints_sum_in_pairs(spark):
    """A sum for two subsets at once gives what a sum for each gives, and there are half as many."""
    df = spark.createDataFrame([(i, f"Common w{i % 7} v{i % 5} x{i % 3} rare{i} " + " ".join(f"t{i * j}" for j in range(40))) for i in range(60)] + [(99, " ., "), (98, "alone")], "doc_id long, text string")
    words = imatch.lexicon(df, min_idf=0.5, max_idf=3.0).localCheckpoint()
    out = imatch.fingerprints(df, ["doc_id"], "text", words)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("bit_xor(") <= imatch.SUBSETS + 2
    rows = df.select("doc_id", F.explode(F.expr(imatch.terms("text"))).alias("term")).join(words.select("term", F.lit(True).alias("band")), "term", "left")
    rows = rows.select("doc_id", "band", F.xxhash64("term").alias("h"), F.expr(imatch.subsets("term")).alias("mask")).collect()
    for r in out.collect():
        mine = [x for x in rows if x.doc_id == r.doc_id]
        for found, of in ((r.prints, [x for x in mine if x.band]), (r.every, mine)):
            expected = []
            for held in [of, *([x for x in of if x["mask"] >> i & 1] for i in range(imatch.SUBSETS))]:
                number = 0
                for x in held:
                    number ^= x.h & 0xFFFFFFFF
                expected.append(number - 2**31 if held else None)
            few = of is not mine and (len(of) < imatch.FEW or len(of) * imatch.FEW_ONE_IN < len(mine))
            assert found == (None if few else expected)
    assert {r.doc_id for r in out.collect()} == {*range(60), 98}
