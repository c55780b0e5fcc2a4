"""The pipeline's stages against plain versions of what each is to do with its own input."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import test_near_dup
import test_secret_scan
from cyclewise import shared
from cyclewise.llm import decontaminate, quality


@pytest.fixture(scope="module")
def stages(spark, small):
    """Each stage's input and output rows, in order."""
    rows, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = shared.settle(stage(spark, rows, small), "tested-stage")
        out.append((rows, after))
        rows = after
    return out


def plain(rows):
    return {tuple(r) for r in rows.collect()}


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "near-duplicates", "benchmark decontamination", "secret scan", "BPE encoding",
    ]


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, small, stages):
    before, after = stages[0]
    trees = quality.fit_on(before, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r.doc_id for r in quality.score(before, trees, "doc_id").collect() if r.score >= 0.7}
    assert plain(after) == {r for r in plain(before) if r[0] in good} and 0 < len(good) < before.count()


def test_copies_from_four_fifths_up(spark, small, frame):
    """Pairs of a similarity of 0.8 and 0.81 are linked, one just below 0.8 isn't."""

    def pair(first, words):
        base = [f"p{first}w{i}" for i in range(words)]
        copy = [f"{w}x" if i % 40 == 20 and i < 160 else w for i, w in enumerate(base)]  # four words, five shingles each
        return [(first, " ".join(base)), (first + 1, " ".join(copy))]

    pairs = [*pair(0, 200), *pair(10, 184), *pair(20, 183)]
    alike = [len(a & b) / len(a | b) for a, b in zip(*[map(test_near_dup.shingles, (t for _, t in pairs))] * 2)]
    assert 0.81 < alike[0] < 0.82 and alike[1] == 0.8 and 0.79 < alike[2] < 0.8
    kept = corpus_pipeline.keep_firsts(spark, frame(pairs), small)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10, 20, 21]


def test_whole_groups_from_four_fifths_up(stages):
    before, after = stages[1]
    rows = plain(before)
    kept = {r[0] for r in test_near_dup.brute([(r[0], r[1]) for r in rows], 80) if r[3]}
    assert plain(after) == {r for r in rows if r[0] in kept} and len(kept) < len(rows)


def test_no_leaks(spark, small, stages):
    before, after = stages[2]
    split = lambda t: [w for w in map(decontaminate.term, (t or "").split()) if w]
    grams = lambda ws: set(zip(*(ws[i:] for i in range(5))))
    tests = [grams(split(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {r for r in plain(before) if not any(len(t & grams(split(r[1]))) >= 0.5 * len(t) for t in tests)}
    assert plain(after) == clean


def test_no_secrets(stages):
    before, after = stages[3]
    told = {r[0]: r for r in plain(after)}
    assert len(told) == before.count()
    for row in plain(before):
        spans = test_secret_scan.brute(row[1])
        assert (told[row[0]] == row) == (spans == "")
        assert test_secret_scan.brute(told[row[0]][1]) == "" and told[row[0]][4] == len(told[row[0]][1])


def test_ids(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run(spark, small, stages):
    last = stages[-1][1].drop("ids")
    assert plain(corpus_pipeline.run(spark, small).drop("ids")) == plain(last)


@pytest.mark.parametrize("rows", ["none", "edges"])
def test_odd_documents(spark, small, frame, edge_pairs, rows):
    """Empty tables, nulls, and columns with clashing names go through every stage."""
    docs = frame(edge_pairs if rows == "edges" else [])
    for name, stage in corpus_pipeline.STAGES:
        out = shared.settle(stage(spark, docs, small), "odd")
        if name != "BPE encoding":
            assert out.columns == docs.columns
        if name != "quality classifier":  # which may send all of these away
            docs = out
    kept = len({pair for pair, row in zip(edge_pairs, test_near_dup.brute(edge_pairs)) if row[3]})
    assert docs.count() == (0 if rows == "none" else kept)
