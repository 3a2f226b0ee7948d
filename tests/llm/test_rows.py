"""Operators that work row by row or conversation by conversation."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.llm import chat, language_id, license_scan, lm, topk, url_filter
from tidewrack.llm.elias_fano import EliasFano, Trie

from .helpers import awkward_docs, lower, no_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


# --- license scans


LICENSED = [
    "Licensed under CC BY-NC 4.0. Licensed under cc\nby, all rights RESERVED; all rights reserved.",
    "x " * 37 + "This work is licensed under the GNU General Public License, version 3.",
    "Permission is granted, free of charge, to any person obtaining a copy of this software and associated files",
    "released under the \u212a MIT license; released under the mit license",
    "general public licence; general publiclicense; cc é by",
    "the the the license license of of software",
]


def plain_scan(text, templates):
    words = WORD.findall(lower(text))
    places, labels, score = [], set(), 0.0
    for t in templates:
        own = t.text.split()
        n = len(own)
        if t.phrase:
            at = [i for i in range(len(words)) if words[i : i + n] == own]
            places += [(i, t.label) for i in at]
            score = max(score, 1.0 if at else 0.0)
            continue
        need = math.ceil(t.share * len(set(own)) - 1e-9)
        for k in range(len(words)):
            overlap = len(set(own) & set(words[k : k + 2 * n]))
            if overlap >= need:
                labels.add(t.label)
                score = max(score, overlap / len(set(own)))
    base = {b for _, b in places}
    starts = [i for i, _ in places]
    return (
        len(words), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
    )


def test_license_scan_is_the_plain_one(spark):
    templates = [*license_scan.PHRASES, *license_scan.NOTICES]
    docs = awkward_docs(spark, LICENSED)
    got = [tuple(r) for r in license_scan.scan(docs).collect()]
    want = {(r["doc_id"], *plain_scan(r["text"], templates)) for r in docs.collect()}
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[2] for r in got) == 5 and {"mit", "gpl-3.0", "cc-by-nc"} <= {x for r in got for x in r[6].split(",")}
    assert license_scan.scan(no_docs(spark)).count() == 0


def test_license_scan_has_no_python(spark):
    plan = license_scan.scan(awkward_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_notices_are_found_at_every_place(spark):
    """Whatever stands before them, whole, with gaps, in another order, and just short of the threshold."""
    mit, gpl = "licensed under the terms of the mit license", "licensed under the gnu general public license version 3"
    grant = next(t.text for t in license_scan.NOTICES if t.text.startswith("permission")).split()
    some = [mit, gpl, " ".join(grant), " so ".join(grant), " ".join(grant[::-1]), " ".join(grant[4:]), " ".join(grant[6:]), gpl[:-2]]
    texts = [f"{'word ' * n}{x} {'the mit ' * (n % 3)}end" for x in some for n in range(13)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    templates = [*license_scan.PHRASES, *license_scan.NOTICES]
    got = {r["key"]: r for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        assert tuple(got[i])[1:] == plain_scan(text, templates), text
        if i < 26:
            assert ("mit" if i < 13 else "gpl-3.0") in got[i]["labels"].split(",")


def test_crowded_prefix_words(spark):
    rng = random.Random(8)
    words = ["license", "mit", "the", "under", "released", "licensed", "gnu", "x", "spdx", "identifier", "cc", "by"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 300))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    templates = [*license_scan.PHRASES, *license_scan.NOTICES]
    got = {(r["key"], *tuple(r)[1:]) for r in license_scan.scan(docs).collect()}
    assert got == {(i, *plain_scan(t, templates)) for i, t in enumerate(texts)}


def test_repeated_rows_count_once(spark):
    docs = spark.createDataFrame([(1, LICENSED[0])] * 3, "doc_id long, text string")
    assert [r["n_base"] for r in license_scan.scan(docs).collect()] == [plain_scan(LICENSED[0], license_scan.PHRASES)[1]]


# --- top k


def plain_top(rows, k):
    vectors = {}
    for key, v in rows:
        if key is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * float(np.float32(x))) for x in v]
        vectors[key] = min(vectors.get(key, q), q)
    out = set()
    for a, q in vectors.items():
        if a % 20:
            continue
        near = sorted((-sum(x * y for x, y in zip(q, v)), b) for b, v in vectors.items() if b != a)[:k]
        out |= {(a, i + 1, b, -s) for i, (s, b) in enumerate(near)}
    return out


@pytest.mark.parametrize("k, block", [(5, 50), (200, 1000)])
def test_top_k_is_the_plain_one(spark, k, block):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 24)]) for i in range(140)]
    rows += [(i, rows[3][1]) for i in range(200, 230)]  # many alike
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 3), (303, [float("inf")]), (304, []), (305, [2.0] * 5)]
    rows += [(40, rows[1][1]), (None, rows[1][1]), rows[0], (320, [0.0] * 24)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, score double, v string")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, vector_block=block, query_block=4)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_top(rows, k)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x, y = rng.integers(-40, 40, (2, 30, 19)).astype(float)
    exact = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    last = np.zeros_like(exact)
    for s in topk.SEGMENTS:
        a, b = topk.statistics(x, s), topk.statistics(y, s)
        bound = ((a[:, None] - b[None]) ** 2).sum(axis=2)
        assert (bound <= exact + 1e-6).all() and bound.mean() >= last.mean() - 1e-9
        last = bound


# --- chat formatting


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] \\ <|im_end|> <s> <<SYS>>"), (1, 2, "user", None),
    (1, 3, "assistant", ""), (1, 4, "assistant", "日本 \\\\<\\/s> é"), (2, 5, None, "x"), (2, 5, None, "x"),
    (None, None, "assistant", "no id"), (3, 0, "</s>", "role with a mark"), (4, 0, "assistant", "long " * 30000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "f", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, n int")
    done = chat.format_turns(chat.turns_of_table(df))
    read = done.select("conv", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"))
    want = defaultdict(list)
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0)):
        want[conv].append((role or "", text or ""))
    got = read.collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r["t"]] == want[r["conv"]]
        assert r["l"] == "".join(t for role, t in want[r["conv"]] if role == "assistant")
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())
    assert chat.format_turns(chat.turns_of_table(df.limit(0))).count() == 0


@settings(max_examples=3, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("<>/s[]INST\\|SYa \n"), max_size=30), min_size=60, max_size=60))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame([(0, i, "assistant" if i % 2 else t[:5], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat.format_turns(chat.turns_of_table(df)).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in r["t"]] == texts


def test_records_of_many_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "extra": {"x": 1}},
        {"prompt": "a", "response": "b", "id": 4},
        {"system": "s", "prompt": "a", "completion": "b"},
        {"instruction": "a", "input": "", "output": "b"},
        {"instruction": "a", "input": "c", "output": "b"},
        {"instruction": "a", "output": "b", "input": None},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), "x") for i, r in enumerate(records)] + [(90, None, "x"), (91, "{no json", "x")], "id long, rec string, role string")
    got = defaultdict(list)
    for r in chat.turns_of_records(df, "id", "rec").orderBy("conv", "place").collect():
        got[r["conv"]].append((r["role"], r["text"]))
    ab = [("user", "a"), ("assistant", "b")]
    assert dict(got) == {0: ab, 1: ab, 2: ab, 3: [("system", "s"), *ab], 4: ab, 5: [("user", "a\n\nc"), ("assistant", "b")], 6: ab}
    assert len({chat.fingerprint(x.paths()) for x in chat.LAYOUTS}) == len(chat.LAYOUTS)


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, "a")], "id long, body string"))


# --- language model


def plain_lm(rows, strength):
    def words(t):
        return [*[w for w in re.split("[ \t-\r]", lower(t)) if w], None]

    one, two = Counter(), Counter()
    for key, text in rows:
        if zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 1:
            w = words(text)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    for key, text in rows:
        w = words(text)
        base = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        both = [(two[u, x] + strength * b) / (one[u] + strength) for u, x, b in zip([None, *w], w, base)]
        yield key, len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, base)), sum(map(math.log10, both))


def test_language_model_is_the_plain_one(spark, monkeypatch):
    docs = awkward_docs(spark, [f"the cat {i % 7} sat on the {i % 3} mat" for i in range(60)]).repartition(3)
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1
    got = lm.score(docs, train).select("key", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = list(plain_lm([(r["doc_id"], r["text"]) for r in docs.collect()], lm.STRENGTH))
    order = lambda r: tuple((x is not None, x or 0) for x in r[:5])
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=2e-3, abs=1e-2)
    assert lm.score(no_docs(spark), F.lit(True)).count() == 0
    assert {r["n_known"] for r in lm.score(docs, F.lit(False)).collect()} == {0}


def test_keys_beside_nulls_stay_whole(spark):
    """Keys that doubles cannot hold, with a null in the same partition."""
    keys = [(1 << 60) + 1, None, (1 << 60) + 3]
    docs = spark.createDataFrame([(k, f"the cat sat on mat {i} of the twelve big mats there") for i, k in enumerate(keys)], "doc_id long, text string").coalesce(1)
    assert {r["key"] for r in lm.score(docs, F.lit(True)).collect()} == set(keys)


def test_small_blocks_give_the_same(spark):
    docs = awkward_docs(spark, [f"the cat {i % 7} sat on the {i % 3} mat" for i in range(60)]).repartition(3)
    columns = ("key", "n_tokens", "n_known", "train_tokens")
    small, whole = (
        sorted(((*(r[c] for c in columns), round(r["base_score"], 6), round(r["score"], 6)) for r in x.collect()), key=repr)
        for x in (lm.score(docs, F.lit(True), block_tokens=40), lm.score(docs, F.lit(True)))
    )
    assert small == whole
    block = lm.Block()
    for i, t in enumerate(["a b a", None, "b " * 300]):
        block.add(i, t, True)
    assert [len(x) for x in block.docs] == [4, 1, 301] and len(block.numbers) == 3


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(500)), [0, 2**40, 2**40, 2**61], [3] * 300 + [10**6] * 200])
def test_elias_fano(values):
    x = EliasFano.of(np.array(values, dtype=np.int64))
    assert x.all().tolist() == values
    assert x.get(np.arange(len(values))).tolist() == values


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 900) * 2**50, rng.integers(0, 200, 900) * 2**30)})
    codes = np.arange(1, len(pairs) + 1)
    u, w = (np.array(x, dtype=np.int64) for x in zip(*pairs))
    trie = Trie(u, w, codes)
    assert trie.find(u, w).tolist() == codes.tolist()
    held = dict(zip(pairs, codes.tolist()))
    a, b = rng.integers(0, 55, 2000) * 2**50, rng.integers(0, 210, 2000) * 2**30
    assert trie.find(a, b).tolist() == [held.get(p, 0) for p in zip(a.tolist(), b.tolist())]
    assert Trie(u[:0], w[:0], codes[:0]).find(u, w).tolist() == [0] * len(u)


# --- language ID


SPEECH = {"en": "the house and water with that", "de": "das haus und wasser mit der über", "fr": "la maison et l'eau avec été"}


def test_languages_held_out(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(rng.choice(SPEECH[lang].split(), 12)), None if i % 10 == 0 else lang, "c"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    train = docs.filter("doc_id % 3 != 1 or doc_id % 2 = 0")
    model = language_id.train(language_id.training_rows(train))
    got = language_id.identify(docs, model).select("doc_id", "lang_pred", "lang_score").collect()
    assert len(got) == 300
    assert sum(r["lang_pred"] == ("en", "de", "fr")[r["doc_id"] % 3] for r in got) >= 295
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    odd = language_id.identify(awkward_docs(spark), model).select("doc_id", "lang_pred", "fp").collect()
    assert len(odd) == 9 and {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    assert language_id.identify(no_docs(spark), model).count() == 0
    nothing = language_id.train(language_id.training_rows(no_docs(spark)))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_kernel_by_products_is_the_kernel():
    texts = ["abab", "banana", "ab"]
    codes = [set(language_id.gram_codes(t).tolist()) for t in texts]
    vocabulary = np.array(sorted(set().union(*codes)), dtype=np.uint32)
    slots = language_id.Model([], vocabulary, np.zeros((0, 0))).slots()
    x = language_id.presence(texts, slots, len(vocabulary))
    for i in range(3):
        for j in range(3):
            want = len(codes[i] & codes[j]) / math.sqrt(len(codes[i]) * len(codes[j]))
            assert x[i] @ x[j] == pytest.approx(want, rel=1e-5)


# --- URL filters


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def plain_rule(url):
    rest = (url or "").partition("://")[2]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = lower(rest[:cut]), rest[cut:]
    path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = []
    for rule, says in RULES:
        h, s, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p):
            fits.append((len(rule), rule, says))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    urls = [
        None, "", "no scheme/x", "http://", "https://A.Example.NET/en/1?x#y", "http://example.net/EN/", "http://NET/a", "http://net",
        "ftp://x.org/fr/é?://b.net/", "http://xnet/a", "http://a.net?/q", "http://example.com/de", "http://example.com/de/\n1#é",
        "a://b://c.net/x", "http://É.net/", *(f"http://bad{i}.net/ads/{i}" for i in range(40)), *(f"http://ok{i}.org/fr/news/{i}" for i in range(40)),
        "http://bad7.com/ads/7", "http://ok3.com/news/3", "http://bad7.com/ads/7",
    ]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = url_filter.judge(df, url_filter.labelled_urls(df, RULES), RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, says = plain_rule(r["url"])
        assert (r["url_host"], r["url_path"], r["url_rule"]) == (host, path, rule), r["url"]
        assert r["url_verdict"] == (says or ("block" if r["url_score"] > 0.5 else "allow"))
    verdict = {r["url"]: r["url_verdict"] for r in got}
    assert verdict["http://bad7.com/ads/7"] == "block" and verdict["http://ok3.com/news/3"] == "allow"
    assert url_filter.judge(df.limit(0), url_filter.labelled_urls(df.limit(0), RULES), RULES).count() == 0


def test_small_table_knows_paths():
    model = url_filter.train(url_filter.small_table())
    hosts = ("ridgeway-tools.org", "www.oakvalley.com", "m.brightfield.net")
    bad = ("/online-casino/free-bets", "/en/poker-online", "/adult-videos/7.html", "/de/pills-for-less", "/fr/casino-bonus/")
    good = ("/en/12", "/de/7.html", "/about", "/library/opening-hours", "/news/weather", "/fr/museum/", "/en/train-times.html", "/2021/05/cooking-class")
    for h in hosts:
        assert [x for x in bad if model.score(h, x) <= 0.5] == [] and [x for x in good if model.score(h, x) > 0.5] == []
    assert model.score("best-casino.acme.com", "/en/12") > 0.5 > model.score("school-library.acme.com", "/en/12")


def test_sha_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
