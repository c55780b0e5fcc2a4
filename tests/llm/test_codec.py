"""Byte-pair encoding, decoding and counting against the tokenizers library."""

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cyclewise.llm import bpe_codec, texts, token_count, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "th", "tion", "'st", "'S", "é", "ü", "中", "🙂", "\u0085", " ", "\x1c", "\x1f", "²", "Ⅷ",
          "!?", ".", "_", "12", "<|endoftext|>", "<|", "The", "=-", "​", "ſ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text, machine=None):
    return np.frombuffer((machine or bpe_codec.encoder(PATH)).packed(text), dtype="<u4").tolist()


def check(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of(text) == want
    assert token_count.counter(PATH).count(text) == len(want)
    assert "".join(bpe_codec.Decoder(PATH).parts(np.array(want, dtype="<u4"))) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
def test_any_text(library, text):
    check(library, text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_any_characters(library, text):
    check(library, text)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000, "-=" * 3000, "thethe" * 1500, "é" * 3000, "\n" * 999 + "x", "12" * 999])
def test_long_pieces(library, text):
    check(library, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "e", "ing", "tion", "er", "=", "-", "an", "the"]), min_size=60, max_size=400).map("".join))
def test_tokens_are_emitted_early_and_right(library, text):
    """A buffer of 16 bytes beyond the lookahead gives the same tokens."""
    assert ids_of(text, bpe_codec.Encoder(PATH, step=16)) == library.encode(text, add_special_tokens=False).ids


def test_buffer_is_bounded(library):
    machine = bpe_codec.Transducer(vocab.vocabulary(PATH), step=64)
    ahead = bpe_codec.lookahead(vocab.vocabulary(PATH))
    out, text = [], "thertionthe" * 500
    for i in range(0, len(text), 10):
        out += machine.feed(text[i : i + 10].encode())
        assert len(machine._buffer) <= 2 * (ahead + 64)
    out += machine.finish()
    assert out == library.encode(text, add_special_tokens=False).ids


class Merges:
    """A vocabulary made of a list of merges over a and b."""

    def __init__(self, merges):
        symbols = ["a", "b"]
        self.ranks, self.made = {}, []
        for left, right in merges:
            self.ranks[symbols.index(left), symbols.index(right)] = len(self.made)
            self.made.append(len(symbols))
            symbols.append(left + right)
        self.bytes_of = [s.encode() for s in symbols]
        self.byte_ids = {ord("a"): 0, ord("b"): 1}


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_lookahead_is_sufficient(data):
    """Whatever follows a token by more than the lookahead leaves it as it is."""
    symbols, merges = ["a", "b"], []
    for _ in range(data.draw(st.integers(1, 6))):
        pair = data.draw(st.tuples(st.sampled_from(symbols), st.sampled_from(symbols)))
        if pair[0] + pair[1] not in symbols:
            merges.append(pair)
            symbols.append(pair[0] + pair[1])
    book = Merges(merges)
    text = data.draw(st.text("ab", min_size=1, max_size=40))
    whole = bpe_codec.merged([book.byte_ids[ord(c)] for c in text], book)
    machine = bpe_codec.Transducer(book, step=1)
    assert [*machine.feed(text.encode()), *machine.finish()] == whole
    assert len(text) - token_count.merges_of([book.byte_ids[ord(c)] for c in text], book) == len(whole)


def test_decoder_waits_for_whole_characters():
    back = bpe_codec.Decoder(PATH)
    ids = ids_of("🙂é")
    parts = [back.feed(np.array([i])) for i in ids]
    assert "".join(parts) == "🙂é" and "" in parts


def test_memo_is_bounded():
    calls = []
    memo = texts.Memo(lambda k: calls.append(k) or k.upper(), entries=8)
    assert [memo[str(i % 50)] for i in range(200)] == [str(i % 50) for i in range(200)]
    assert len(memo) <= 5 and len(memo._old) <= 5
    assert memo["x" * 1000] and "x" * 1000 not in memo


def test_documents(spark, frame, edge_pairs, library):
    docs = frame(edge_pairs)
    rows = bpe_codec.encode(docs, PATH, "doc_id").collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in edge_pairs]
    order = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=order) == sorted(want, key=order)
    digests = bpe_codec.round_trip(docs, PATH, "doc_id").collect()
    plain = [(i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
             for (i, t), (_, ids) in zip(edge_pairs, want)]
    assert sorted(map(str, map(tuple, digests))) == sorted(map(str, plain))
    back = bpe_codec.decode(bpe_codec.encode(docs, PATH, "doc_id"), PATH, "doc_id").collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t in edge_pairs)
    counts = token_count.count_tokens(docs, PATH, "doc_id").collect()
    told = [(i, len((t or "").encode()), len(ids), len(ids) > 1024) for (i, t), (_, ids) in zip(edge_pairs, want)]
    assert sorted(map(str, map(tuple, counts))) == sorted(map(str, told))


def test_no_documents(spark, frame):
    assert bpe_codec.round_trip(frame([]), PATH, "doc_id").collect() == []
    assert token_count.count_tokens(frame([]), PATH, "doc_id").collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bpe_codec.decode(nothing, PATH, "doc_id").collect() == [(1, None)]


def test_all_pieces_go_through_the_transducer(spark, monkeypatch):
    """On a given table: each different piece is fed to a transducer, and the ids are those that it emitted."""
    fed, emitted = [], {}

    class Watched(bpe_codec.Transducer):
        def __init__(self, *args):
            super().__init__(*args)
            self.read, self.told = bytearray(), []
            fed.append(self)

        def feed(self, data):
            self.read += data
            for token in super().feed(data):
                self.told.append(token)
                yield token

        def finish(self):
            for token in super().finish():
                self.told.append(token)
                yield token

    monkeypatch.setattr(bpe_codec, "Transducer", Watched)
    machine = bpe_codec.Encoder(PATH)
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids = [ids_of(t, machine) for t in rows]
    for watched in fed:
        emitted[bytes(watched.read)] = watched.told
    for text, want in zip(rows, ids):
        again = []
        for plain, special in machine.vocabulary.segments(text):
            again += [i for piece in vocab.pieces(plain) for i in emitted[piece.encode()]]
            again += [] if special is None else [special]
        assert again == want
    assert sum(len(w.told) for w in fed) > 10_000


@pytest.mark.parametrize("text", ["a word and another " * 2_600_000, "ab" * 5_000_000], ids=["words", "one piece"])
def test_memory_stays_flat(text):
    """Beyond a text of many megabytes itself, encoding and decoding it hold a few of its parts at a time."""
    machine, back = bpe_codec.encoder(PATH), bpe_codec.Decoder(PATH)
    for packed in machine.parts(text[:100_000]):
        back.feed(np.frombuffer(packed, dtype="<u4"))
    back.finish()
    tracemalloc.start()
    size, most = 0, 0
    for packed in machine.parts(text):
        size += len(back.feed(np.frombuffer(packed, dtype="<u4")))
        most = max(most, len(packed))
    size += len(back.finish())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == len(text) and most < 1 << 20 and peak < len(text) + (40 << 20)
