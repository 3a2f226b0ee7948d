"""The transducer against the tiktoken library, and the stream decoder against Python's."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import awkward_docs, no_docs
from tidewrack.llm import byte_bpe as B

PATH, MULTI = (public_tokenizers.path(f"byte_bpe_{x}50k.tiktoken") for x in ("", "multi_"))


def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(path), special_tokens={})


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), dtype=np.uint32).tolist()


@pytest.fixture(scope="module", params=[PATH, MULTI])
def both(request):
    return B.Encoder(B.read_ranks(request.param), public_tokenizers.PATTERN), library(request.param)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("abe thinrsABC019.,'’\n\t éèß日本語\U0001f600́|<>"), max_size=80))
def test_encodes_like_the_library(both, text):
    own, want = both
    assert ids_of(own, text) == want.encode_ordinary(text)


def test_runs_of_tokens(both):
    own, want = both
    rng, tokens = random.Random(5), sorted(own.transducer.ranks)
    for _ in range(1500):
        data = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        if data not in own.transducer.ranks:
            assert own.transducer.encode(data) == own.transducer.merged(data)


def test_few_states_give_the_same():
    ranks = B.read_ranks(PATH)
    small, want = B.Encoder(ranks, public_tokenizers.PATTERN, states=40), library(PATH)
    rng = random.Random(6)
    for _ in range(100):
        text = "".join(rng.choice(["the ", "ing", "aaaa", "zq", "1234", "é", "  \n"]) for _ in range(40))
        assert ids_of(small, text) == want.encode_ordinary(text)
    assert len(small.transducer.states) < 200


def test_one_long_piece_takes_bounded_lookahead(both):
    own, want = both
    text = "abcde" * 3000 + "e" * 9000
    assert ids_of(own, text) == want.encode_ordinary(text)
    longest = max(map(len, own.transducer.ranks))
    assert all(len(window) < longest for window, _ in own.transducer.states)


def test_tokens_that_merges_do_not_build():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257}
    own = B.Encoder(ranks, r"\p{L}+|.")
    want = tiktoken.Encoding("odd", pat_str=r"\p{L}+|.", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzab", "abxyz xyz", "xyxyz"):
        assert ids_of(own, text) == want.encode_ordinary(text)


@settings(max_examples=500, deadline=None)
@given(data=st.one_of(st.binary(max_size=40), st.text(max_size=20).map(lambda s: s.encode()[1:])), cuts=st.lists(st.integers(0, 40)))
def test_stream_decodes_like_python(data, cuts):
    at = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    stream = B.Utf8Stream()
    parts = [stream.feed(data[a:b]) for a, b in zip(at, at[1:])]
    assert "".join([*parts, stream.end()]) == data.decode("utf-8", "replace")


def test_stream_holds_back_at_most_three_bytes():
    stream = B.Utf8Stream()
    assert [stream.feed(bytes([b])) for b in "a\U0001f600".encode()] == ["a", "", "", "", "\U0001f600"]


def test_pieces_are_forgotten_in_turn(monkeypatch):
    monkeypatch.setattr(B, "PIECES", 5)
    own, want = B.Encoder(B.read_ranks(PATH), public_tokenizers.PATTERN), library(PATH)
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join(rng.choices(["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "theta", "iota"], k=12))
        assert ids_of(own, text) == want.encode_ordinary(text)
    assert len(own.known) <= 5 and len(own.before) <= 5


def test_awkward_rows_round_trip(spark):
    docs = awkward_docs(spark, ["<|endoftext|> it's 日本語 \U0001f600", "x" * 50_000]).withColumn("ids", docs_ids()).repartition(3)
    done = B.decoded(B.encoded(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    want = library(PATH)
    assert len(done) == docs.count()
    for r in done:
        text = r.text or ""
        assert r.decoded == text
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want.encode_ordinary(text)
        assert r.words == "w" and r.rank == 2
    at_once = B.encoded(docs, PATH, public_tokenizers.PATTERN, decoded_into="label").collect()
    assert sorted((r.text or "", bytes(r.ids), r.label) for r in at_once) == sorted((r.text or "", bytes(r.ids), r.decoded) for r in done)
    assert B.decoded(B.encoded(no_docs(spark), PATH, public_tokenizers.PATTERN), PATH).count() == 0


def docs_ids():
    from pyspark.sql import functions as F

    return F.lit("clashing")


def test_query_against_library(spark):
    from tests.oracle import DATA
    from tidewrack.llm.queries import QUERIES

    want = library(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    rows = QUERIES["op13_byte_bpe"](spark, f"{DATA}/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(want.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
