import random
import re

import numpy as np

from tidewrack.llm import decontaminate as d

from .helpers import awkward_docs, lower, no_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text, items, window=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


def common(a, b):
    """Length of the common beginning."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def some_texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "cat", "sat", "on", "mat", "dog", "ran", "É", "x1"]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))) for _ in range(n)]


def items_of(texts):
    long = [t for t in texts if len(t.split()) > 25]
    return [(1, " ".join(long[0].split()[3:20])), (2, long[1]), (12, "Cat, SAT on;"), (3, None), (4, "..."), (1, "dog ran dog"), (None, "x1 x1 x1")]


def test_suffix_array_and_search():
    rng = np.random.default_rng(3)
    ids = np.r_[0, rng.integers(0, 4, 400), 0].astype(np.int32)
    at = np.flatnonzero(ids)

    def suffix(p):
        end = p + int(np.argmax(ids[p:] == 0))
        return ids[p:end].tolist()

    order = d.suffix_array(ids, at, 50)
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in at)


def test_hits_and_items(spark):
    texts = some_texts(5)
    items = items_of(texts)
    docs = awkward_docs(spark, [*texts, "pre " + texts[0] + " post"])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (10**6, 40):  # one pass, and a pass for each small block
        found = d.contamination(docs, benchmark, block_chars=block_chars)
        got = found.select("doc_id", "text", "contamination", d.n_hit().alias("n_hit"), "fingerprint").collect()
        assert len(got) == docs.count()
        for r in got:
            n, hit, names = plain(r["text"], items)
            c = r["contamination"]
            ranges = [p for a, b in zip(c["ranges"][::2], c["ranges"][1::2]) for p in range(a, b)]
            assert (c["n_words"], ranges, c["items"], r["n_hit"]) == (n, hit, names, len(hit))
            assert r["fingerprint"] == "f"
    kept = {tuple(r) for r in d.decontaminated(docs, benchmark).select("doc_id", "text").collect()}
    assert kept == {(r["doc_id"], r["text"]) for r in got if not plain(r["text"], items)[1]}


def test_longest_matches(spark):
    texts = some_texts(6, 25)
    items = items_of(texts)[:3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {(r["item"], r["start"]): r for r in d.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    words = [WORD.findall(lower(t)) for t in texts]
    for item, t in items:
        own = WORD.findall(lower(t))
        for i in range(len(own)):
            best = max((common(own[i:], w[p:]), -doc, -p) for doc, w in enumerate(words) for p in range(len(w)))
            if best[0] >= 3:  # the shortest window
                r = got[(str(item), i)]
                assert (r["length"], -r["doc"], -r["place"]) == best


def test_longest_matches_of_awkward_rows(spark):
    """Keys that doubles cannot hold beside a null in one partition, repeated and empty rows; ties go to the smaller key."""
    items = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    big, kind = (1 << 60) + 1, "doc_id long, text string"
    rows = [(big + 2, "x one two three four five six"), (None, "one two three four five six"), (big, "one two three four five six"), (big, ""), (7, None)]
    got = d.longest_matches(spark.createDataFrame(rows, kind).coalesce(1), items, window=3).collect()
    assert {(r["item"], r["start"], r["length"], r["doc"], r["place"]) for r in got} == {("1", i, 6 - i, big, i) for i in range(4)}
    got = d.longest_matches(spark.createDataFrame(rows[:2], kind).coalesce(1), items, window=3).collect()
    assert {(r["doc"], r["place"] - r["start"]) for r in got} == {(big + 2, 1)}
    got = d.longest_matches(spark.createDataFrame(rows[1:2] * 2, kind).coalesce(1), items, window=3).collect()
    assert {r["doc"] for r in got} == {None} and len(got) == 4
    assert d.longest_matches(spark.createDataFrame([], kind), items).count() == 0
    assert d.longest_matches(spark.createDataFrame(rows, kind), items.limit(0)).count() == 0


def test_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert d.decontaminated(awkward_docs(spark), benchmark).count() == 9
    assert d.decontaminated(no_docs(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
