"""The pipeline and the queries over the smallest test tables, against plain versions."""

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.oracle import DATA, compare, duck
from tidewrack.llm import oracles, queries

from .helpers import awkward_docs, lower, no_docs
from .test_decontaminate import plain

SMALL = f"{DATA}/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(text):
    words = lower(text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_dedup(rows):
    """Smallest ids of the groups linked by a similarity of 0.8 or more; texts without words are alike."""
    sets = {key: shingles(text) for key, text in rows}
    group = {key: key for key in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {key for key in sets if top(key) == key}


def check_packed(rows, packed):
    plain_ids = Tokenizer.from_file(BYTE)
    want = set()
    for key, text in rows:
        ids = np.array(plain_ids.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want |= {(key, a, zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)}
    got = packed.collect()
    assert {(r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got} == want and len(got) == len(want)
    sums = defaultdict(int)
    for r in got:
        sums[r["sequence_id"]] += r["length"]
    assert max(sums.values()) <= 2048


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    docs = docs.limit(150).union(spark.createDataFrame([(900_000, None, None, "s", 0), (900_001, "12 !", "en", "s", 4)], docs.schema))
    docs = corpus_pipeline.step_table(docs)
    before = rows_of(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "packing":
            check_packed(before, out)
            continue
        assert out.columns == docs.columns
        out = corpus_pipeline.step_table(out)
        after = rows_of(out)
        if name == "language_id":
            want = [r for r in before if r[1] is not None and any(c.isalpha() for c in r[1])]
        elif name == "near_dedup":
            kept = plain_dedup(before)
            want = [r for r in before if r[0] in kept]
        else:
            want = [r for r in before if not plain(r[1], items)[1]]
            assert len(want) < len(before)
        assert sorted(after) == sorted(want)
        docs, before = out, after


def test_stages_take_awkward_tables(spark):
    shape = [F.col(c) for c in ("doc_id", "text", "label", "rank", "class")]
    for docs in (awkward_docs(spark).select(*shape, F.lit("en").alias("lang")), no_docs(spark).select(*shape, "lang")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name == "packing":
                out.count()
            else:
                assert out.columns == docs.columns
                docs = corpus_pipeline.step_table(out)


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "one two three four")] * 3 + [(2, "one two three four"), (None, "x y z w")], "doc_id long, text string")
    assert sorted(rows_of(corpus_pipeline.near_dedup(spark, docs, SMALL)), key=str) == [(1, "one two three four"), (None, "x y z w")]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_agree_with_sql(spark, name):
    assert compare(spark, duck(SMALL), queries.QUERIES[name], oracles.ORACLES[name], SMALL) is None


def test_dedup_by_text_whatever_the_ids(spark):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "its own words and no others"), (None, "p q r s t u"), (None, "p q r s t u ")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int")
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, SMALL))
    assert sorted((k, x.strip()) for k, x in got if k) == [rows[0], rows[2]]
    assert [x.strip() for k, x in got if k is None] == ["p q r s t u"]


def test_language_stage_fills_in_and_keeps(spark):
    shape = "doc_id long, text string, lang string"
    unlearned = spark.createDataFrame([(1, "no label here", None), (2, "12 !", None)], shape)
    assert rows_of(corpus_pipeline.known_language(spark, unlearned, SMALL)) == [(1, "no label here")]
    english, german = "the river and the house of the town", "der Fluss und das Haus der kleinen Stadt"
    rows = [(i, f"{(english, german)[i % 2]} {i}", ("en", "de")[i % 2]) for i in range(60)]
    docs = spark.createDataFrame([*rows, (100, german + " 7", None), (101, english, "xx")], shape)
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, SMALL).collect()}
    assert len(got) == 62 and got[100] == "de" and got[101] == "xx"
