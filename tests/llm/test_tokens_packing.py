import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewrack.llm import dac, packing, tokens
from tidewrack.llm.common import shared_folder

from .helpers import awkward_docs, no_docs

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    None,
    "",
    "  two  blanks\n\n and\tlines \r\n x ",
    "It's they'LL 'S we've 12 345 a1b2 — “quoted” §3…",
    "Élan vital, naïve ĲǰŉŒ İstanbul ǅ straße",
    "日本語 テキスト emoji 👍🏽 é ؀ ² ½ \x1c \x85 \xa0 end",
    "<|endoftext|> in the text <|startoftext|>",
    "a" * 5000 + " " + "the cat " * 4000,
    "\\ \" ' `` '' 's's it''s",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_cached_ids_are_the_librarys(path):
    rng = random.Random(4)
    signs = "aZéß 19.,'’\n\t-_|<>"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(400)]
    own = tokens.Encoder(path, cache_words=200)
    plain = Tokenizer.from_file(path)
    for _ in range(2):
        for x, ids in zip(texts, own.encode(texts), strict=True):
            assert ids.tolist() == plain.encode(x or "", add_special_tokens=False).ids, repr(x)


def test_segment_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, top, n, dtype=np.uint32) for top, n in ((256, 700), (70_000, 900), (2**32, 50), (5, 0), (300, 1))]
    keys = [None, -5, 2**62, 0, 7]
    segment = dac.Segment(dac.write_segment(keys, ids))
    whole = np.concatenate(ids)
    assert segment.doc_ids == keys
    assert segment.all().tolist() == whole.tolist()
    assert [segment.get(i) for i in range(len(whole))] == whole.tolist()
    assert dac.Segment(dac.write_segment([], [])).all().tolist() == []


def test_token_files(spark):
    docs = awkward_docs(spark, TEXTS).repartition(3)
    path = shared_folder(spark)
    dac.write_tokens(docs, path, WORD, 2, segment_ids=1000)
    got = dac.read_tokens(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(WORD)
    left, at = defaultdict(list), 0
    for r in docs.select("doc_id", "text").collect():
        left[r["doc_id"]].append(plain.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    keys = [r["key"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(keys) == docs.count()
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at
        left[r["key"]].remove(ids)
        at += len(ids)
    dac.write_tokens(no_docs(spark), path + "-empty", WORD, 2)
    assert dac.read_tokens(spark, path + "-empty").count() == 0


def test_every_id_lies_in_one_piece(spark):
    docs = awkward_docs(spark, [*TEXTS, *("word " * n for n in range(1, 2000, 97))]).repartition(3)
    got = packing.pack(docs, BYTE).collect()
    plain = Tokenizer.from_file(BYTE)
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for a in range(0, len(ids), packing.CAPACITY):
            part = ids[a : a + packing.CAPACITY]
            want[(r["doc_id"], a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    have = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        have[(r["key"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for own in sequences.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) <= packing.CAPACITY
    assert packing.pack(no_docs(spark), BYTE).count() == 0


def test_patterns_meet_the_demand_with_little_waste():
    rng = np.random.default_rng(2)
    size, demand = np.unique(rng.integers(1, 65, 5000), return_counts=True)
    used = packing.solve(size, demand, 64)
    assert (sum(c * n for c, n in used) == demand).all()
    assert all((c * size).sum() <= 64 for c, _ in used)
    bins, least = sum(n for _, n in used), (size * demand).sum() / 64
    big = demand[size > 32].sum()
    assert bins <= 1.02 * max(least, big) + 3
    assert packing.solve(size[:0], demand[:0], 64) == []


def test_knapsack_against_all_choices():
    size, value = np.array([3, 4, 7]), np.array([0.3, 0.45, 0.8])
    counts = packing.best_pattern(value, size, 14)
    best = max(a * 0.3 + b * 0.45 + c * 0.8 for a in range(5) for b in range(4) for c in range(3) if 3 * a + 4 * b + 7 * c <= 14)
    assert (counts * size).sum() <= 14 and abs(counts @ value - best) < 1e-9


def test_keys_beside_nulls_stay_whole(spark):
    """Keys that doubles cannot hold, with a null in the same partition."""
    keys = [(1 << 60) + 1, None, (1 << 60) + 3]
    docs = spark.createDataFrame([(k, f"text number {i}") for i, k in enumerate(keys)], "doc_id long, text string").coalesce(1)
    assert [r["key"] for r in packing.pack(docs, BYTE).collect()].count((1 << 60) + 1) == 1
    assert {r["key"] for r in packing.pack(docs, BYTE).collect()} == set(keys)
    path = shared_folder(spark)
    dac.write_tokens(docs, path, WORD, 2)
    assert [r["key"] for r in dac.read_tokens(spark, path).orderBy("start").collect()] == [None, (1 << 60) + 1, (1 << 60) + 3]


def test_pieces_hold_few_texts_at_once(spark, monkeypatch):
    held, tasks, docs = [], [], no_docs(spark)

    class Watched(tokens.Encoder):
        def encode(self, texts):
            held.append(len(texts))
            return super().encode(texts)

    own = Watched(BYTE)
    monkeypatch.setattr(packing, "encoder", lambda path: own)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: tasks.append(f))
    packing.pieces(docs, BYTE, 1, 50)
    keys = [None, *range(2**60, 2**60 + 1200)]
    texts = [TEXTS[i % 7] if i % 40 else "a b " * 60 for i in range(1201)]
    batch = pa.record_batch([pa.array(keys, pa.int64()), pa.array(texts)], names=["key", "text"])
    found = [x for part in tasks[0](iter([batch])) for x in part.to_pylist()]
    assert held == [500, 500, 201]
    assert list(dict.fromkeys(x["key"] for x in found)) == keys
    whole = defaultdict(int)
    for x in found:
        assert x["start"] == whole[x["key"]] and 0 < x["length"] <= 50
        whole[x["key"]] += x["length"]
    assert all(whole[x["key"]] == x["doc_tokens"] for x in found)


def test_layout_needs_no_python_workers(spark):
    plan = packing.pack(awkward_docs(spark), BYTE)._jdf.queryExecution().toString()
    assert "LocalTableScan" in plan or "LocalRelation" in plan
    assert "ExistingRDD" not in plan and "ExternalRDD" not in plan
