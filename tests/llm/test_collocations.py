"""Phrase counts and collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import awkward_docs, lower, no_docs
from tidewrack.llm import collocations as C


def pieces(text):
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text))]


def plain_counts(rows):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, total


def plain(rows, least, top):
    counts, total = plain_counts(rows)
    candidates = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                if 100 * a >= 100 * candidates[lang, words[i : i + k]]:
                    gone.add((lang, words[i : i + k]))
    out = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    }


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "Of", "alpha", "beta", "gamma", "é", "日本", "x", "y", "zed", "omega", "a"]
    rows = []
    for _ in range(n):
        text = " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(0, 40)))
        text += rng.choice(["", ". ", "\t", "!new york city\n", " new york city, new york", " the the the the the the"])
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(lang, t, 1, "p", 2, "m") for lang, t in rows], "lang string, text string, n int, phrase string, size int, mark string")


def read(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("held, burst", [(C.HELD, C.BURST), (40, 3)])
def test_against_plain_counting(spark, held, burst):
    rows = corpus(300, 1)
    docs = frame(spark, rows).repartition(4)
    got = C.collocations(docs, least=8, top=50, held=held, burst=burst)
    assert read(got) == plain(rows, 8, 50)
    counts, total = plain_counts(rows)
    found = {(r.lang, tuple(r.phrase.split(" ")) if r.size else ()): r.n for r in C.frequent_phrases(docs, least=8, held=held, burst=burst).collect()}
    assert found == {g: n for g, n in counts.items() if n >= 8} | {(lang, ()): n for lang, n in total.items() if n}


def test_small_blocks_and_new_dictionaries(spark, monkeypatch):
    rows = corpus(120, 2)
    texts = [t for _, t in rows]
    want, _ = plain_counts([("en", t) for t in texts])
    monkeypatch.setattr(C, "WORDS", 6)
    whole = C._blocks
    monkeypatch.setattr(C, "_blocks", lambda t: whole(t, 23))
    got = Counter()
    for lengths in ((1,), (2,), (3,), (4, 5)):
        counter = C._Counter(lengths, 0, None, 30, 4)
        runs = [r for batch in [*counter.texts("en", texts), *counter.rest()] for r in batch.to_pylist()]
        for run in runs:
            assert run["prefixes"] and len(run["prefixes"]) == len(run["rests"]) == len(run["counts"])
            for prefix, rest, n in zip(run["prefixes"], run["rests"], run["counts"]) if run["size"] else ():
                got["en", tuple(f"{prefix} {rest}".split())] += n
                assert len(prefix.split(" ")) == min(2, run["size"])
    assert got == want


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_trie_bursts_and_spills_sorted_subtrees(k):
    rng, trie, want = random.Random(4), C.HatTrie(k, burst=4), Counter()
    for _ in range(800):
        first, rests = rng.randrange(1, 9), [sum(rng.randrange(1, 9) << C.ID * j for j in range(k - 1)) for _ in range(4)]
        trie.add(first, rests, [1, 2, 3, 4])
        for rest, n in zip(rests, [1, 2, 3, 4]):
            want[first, rest] += n
    assert trie.size == len(want)
    assert all((type(x) is dict) == (k > 2) for x in trie.root.values())
    got, seen = Counter(), set()
    for keep in (len(want) // 2, 0):
        for first, rests, counts in trie.spill(keep):
            assert rests == sorted(rests) and first not in seen
            seen.add(first)
            got.update({(first, rest): n for rest, n in zip(rests, counts)})
        assert trie.size <= keep
    assert got == want and trie.size == 0


def test_distinct_rows():
    rng = random.Random(9)
    for k in range(1, 6):
        rows = [tuple(rng.choice([0, 1, 5, C.MASK]) for _ in range(k)) for _ in range(500)]
        columns, counts = C._distinct([np.array(c, dtype=np.int64) for c in zip(*rows)])
        assert dict(zip(zip(*(c.tolist() for c in columns)), counts.tolist())) == Counter(rows)


def test_products_beyond_64_bits(spark):
    rows = [("en", "u v ") for _ in range(300)] + [("en", "w " * 9000)] * 40
    got = {tuple(r)[2:] for r in C.collocations(frame(spark, rows), least=100).collect()}
    assert ("u v", 300, 300, 300, 360600, 1000 * 360600 // 300) in got
    big = spark.createDataFrame([(4 * 10**18, 9 * 10**18, 3 * 10**18, 8 * 10**18)], "a long, n long, l long, r long")
    score = big.selectExpr(
        "(cast(1000 as decimal(38,0)) * cast(7 as decimal(20,0)) * cast(n as decimal(20,0)))"
        " div (cast(l as decimal(20,0)) * cast(2 as decimal(20,0))) as s"
    ).first()["s"]
    assert score == 1000 * 7 * 9 * 10**18 // (2 * 3 * 10**18)


def test_awkward_rows(spark):
    docs = awkward_docs(spark).withColumnRenamed("label", "lang").repartition(3)
    rows = [("l", r.text) for r in docs.collect()]
    assert read(C.collocations(docs, least=2, top=9)) == plain(rows, 2, 9)
    assert C.collocations(no_docs(spark)).count() == 0
    assert C.collocations(awkward_docs(spark).selectExpr("cast(null as string) as lang", "text")).count() >= 1
