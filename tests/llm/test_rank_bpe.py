"""Rank-file BPE against the tiktoken library."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cyclewise.llm import queries, rank_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = ["a", "b", " ", "  ", "\n", "\t", "th", "tion", "'st", "'S", "é", "ü", "中", "🙂", "\u0085", "\xa0", "\x1c", "\x1f", "²", "Ⅷ",
          "!?", ".", "_", "12", "<|endoftext|>", "The", "=-", "​", "ſ"]


def library_of(path):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=rank_bpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module", params=[PATH, MULTI])
def both(request):
    return rank_bpe.encoder(request.param, PATTERN), library_of(request.param), request.param


def check(both, text):
    machine, library, path = both
    ids = np.frombuffer(machine.packed(text), dtype="<u4")
    assert ids.tolist() == library.encode_ordinary(text)
    assert b"".join(rank_bpe.decoder(path).parts(ids)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_any_text(both, text):
    check(both, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_characters(both, text):
    check(both, text)


def test_rows_of_tokens(both):
    """Tokens joined at random, so that longest matches often have to be taken back."""
    own = random.Random(3)
    tokens = [t for t in rank_bpe.read_ranks(both[2]) if len(t) > 1]
    for _ in range(3000):
        check(both, b"".join(own.choice(tokens).strip() for _ in range(own.randint(1, 8))).decode("utf-8", "ignore"))


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000, "-=" * 3000, "thethe" * 1500, "é" * 3000, "\n" * 999 + "x", "12" * 999])
def test_long_pieces(both, text):
    check(both, text)


def test_time_grows_with_the_piece():
    encode = rank_bpe.table(PATH).encode
    own = random.Random(4)
    piece = "".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 18))
    spent = []
    for size in (1 << 14, 1 << 14, 1 << 18):
        start = time.perf_counter()
        encode(piece[:size])
        spent.append(time.perf_counter() - start)
    assert spent[2] < 16 * spent[1] * 4


def test_backtracking(tmp_path):
    """The longest token first would leave a rest that merging never makes: places are left and not entered again."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    own, library = rank_bpe.table(str(path)), library_of(path)
    for text in ("abc", "abcb", "aabc", "abcabc", "abbc", "bcabcb" * 50, "ab"):
        assert own.encode(text) == library.encode_ordinary(text)


def test_single_bytes_are_needed(tmp_path):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        rank_bpe.RankTable(str(path))


def test_rows(frame, edge_pairs):
    library = library_of(PATH)
    rows = rank_bpe.round_trip(frame(edge_pairs), PATH, PATTERN, "doc_id").collect()
    want = []
    for i, t in edge_pairs:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_ids_and_back(frame, edge_pairs):
    encoded = rank_bpe.encode(frame(edge_pairs), PATH, PATTERN, "doc_id")
    back = rank_bpe.decode(encoded, PATH, "doc_id")
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t in edge_pairs), key=str)


def test_no_rows(frame):
    assert rank_bpe.round_trip(frame([]), PATH, PATTERN, "doc_id").count() == 0
    assert rank_bpe.decode(rank_bpe.encode(frame([]), PATH, PATTERN), PATH).count() == 0


def test_query(spark, small):
    library = library_of(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.queries()["op13_rank_bpe"](spark, small).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
