"""The pipeline's stages, each on what its predecessor kept, against brute force."""
import struct
import subprocess
import sys

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.common import save
from tests.llm.test_pairs import linked, removed


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(save(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_columns_and_ids(steps):
    for before, after in zip(steps[:4], steps[1:5]):
        assert before.columns == after.columns and before.dtypes == after.dtypes
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert steps[1].count() > 0.6 * steps[0].count()


def test_one_of_near_copies_stays(steps):
    expected = {c for _, _, c in linked([(r.doc_id, r.text) for r in steps[2].collect()], 5, 80, 100)}
    assert {r.doc_id for r in steps[3].collect()} == expected


def test_repeated_passages_are_cut(steps):
    before = {r.doc_id: r.text or "" for r in steps[3].collect()}
    counts = sorted(before.items())
    expected = removed([t.encode() for _, t in counts], corpus_pipeline.PASSAGE_BYTES)
    after = {r.doc_id: r for r in steps[4].collect()}
    assert set(after) == set(before)
    changed = sum(1 for i in before if after[i].text != before[i])
    assert changed == sum(1 for n, gone, _, _ in expected if gone)
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_packed_ids(steps):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    ids = {}
    for r in steps[5].orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, []).extend(struct.unpack(f"<{r.length}I", r.ids))
    assert ids == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}


def test_stages_bound_arrow_batches(spark, sf_dir):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 9000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 400).alias("text"))
    old = spark.conf.get(key)
    try:
        for held, most in (("64m", 2001), ("67108864b", 2001), ("1m", 525), ("200kb", 105)):
            spark.conf.set(key, held)
            corpus_pipeline.pack_sequences(spark, rows, sf_dir)
            assert 50 < max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= most
    finally:
        spark.conf.set(key, old)


def test_encoder_holds_its_model_once():
    """Reading the vocabulary a second time took 30 MB of each worker."""
    code = "import resource, sys; from quillon.llm import packing; now = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; a = now(); packing.encoder(sys.argv[1]); print((now() - a) / 1024)"
    assert float(subprocess.run([sys.executable, "-c", code, P.path("word_bpe_49k.json")], capture_output=True, text=True, check=True).stdout) < 54


def test_hard_rows(spark, sf_dir):
    """Null ids and texts, very long ones, repeated rows, clashing names and an empty table, through every stage."""
    names = ["doc_id", "text", "score", "keep", "_node", "kept", "n_bytes", "_h", "label", "block", "ids", "length"]
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, "a text of another kind " * 12), (2, text + " more"), (None, text), (None, None), (3, None), (4, ""), (5, " \n"), (6, "long " * 60_000), (7, "é" * 300), (8, "x " + "é" * 300)]
    df = spark.createDataFrame([(i, t, *range(10)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:]))
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            before, docs = docs, save(stage(spark, docs, sf_dir), "test")
            assert docs.columns == names and docs.dtypes == before.dtypes
            if name == "n-gram Jaccard join" and docs.count():
                assert not docs.where("doc_id = 2").count() and docs.where(F.col("text") == text).where("doc_id is not null").count() <= 1
        assert corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).select("doc_id", "start").count() >= docs.count()


def test_passages_go_whatever_survives(spark, sf_dir):
    out = corpus_pipeline.cut_repeated_passages(spark, spark.createDataFrame([(7, "é" * 300), (8, "x " + "é" * 300)], "doc_id long, text string"), sf_dir)
    assert {r.doc_id: r.text for r in out.collect()} == {7: "", 8: "x "}
