import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewrack.llm import simhash
from tidewrack.llm.components import components

from .helpers import awkward_docs, lower, no_docs


def plain_fingerprint(text):
    words = [w for w in lower(text).translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))


def plain_groups(codes):
    codes = list(codes)
    group = {c: c for c in codes}
    changed = True
    while changed:
        changed = False
        for a in codes:
            for b in codes:
                if (a ^ b).bit_count() <= 2 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return group


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_the_plain_one():
    for text in (None, "", "a", "A b", "a b c", "a\x0bb\tc\n d \x1c e", "É à B c d e " * 50):
        assert simhash.fingerprint(text) == signed(plain_fingerprint(text))


def test_long_text_crosses_the_chunk():
    words = [f"w{i}" for i in range(simhash.CHUNK + 700)]
    assert simhash.fingerprint(" ".join(words)) == signed(plain_fingerprint(" ".join(words)))


def clustered(n, seed):
    rng = random.Random(seed)
    codes, base = set(), rng.getrandbits(64)
    while len(codes) < n:
        code = base
        for _ in range(rng.randrange(5)):
            code ^= 1 << rng.randrange(64)
        codes.add(code if rng.random() < 0.8 else rng.getrandbits(64))
    return sorted(codes)


def test_tree_finds_all_within_the_radius():
    codes = clustered(300, 1)
    tree = simhash.BKTree(np.array(codes, dtype=np.uint64))
    for code in codes[:60]:
        want = {i for i, c in enumerate(codes) if (c ^ code).bit_count() <= 2}
        assert set(tree.within(code, 2)) == want


def test_links_connect_what_pairs_would(spark):
    codes = clustered(220, 2)
    want = plain_groups(codes)
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    for tree_size in (1000, 3):  # all in trees; nearly all by neighbour keys
        links = [(r["a"], r["b"]) for r in simhash.near_links(df, tree_size).collect()]
        group = {signed(c): signed(c) for c in codes}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in links:
            assert want[a & (2**64 - 1)] == want[b & (2**64 - 1)]
            group[top(a)] = top(b)
        mine = {c: top(signed(c)) for c in codes}
        assert len({(mine[c], want[c]) for c in codes}) == len(set(mine.values())) == len(set(want.values()))


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (3, 2), (None, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_rows(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau"
    docs = awkward_docs(spark, [base, base.upper(), base + " end"])
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert len(found) == docs.count()
    prints = {}
    for r in docs.select("doc_id", "text").collect():
        prints.setdefault(plain_fingerprint(r["text"]), set()).add(r["doc_id"])
    groups = plain_groups(prints)
    for key, code, component in found:
        code &= 2**64 - 1
        assert key in prints[code]
        reached = {k for c in prints if groups[c] == groups[code] for k in prints[c] if k is not None}
        assert component == (min(reached) if reached else None)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


def test_extra_columns_stay(spark):
    marked = simhash.fingerprints(awkward_docs(spark).drop("fingerprint"))
    assert marked.filter(F.col("key") != "k").count() == 0


def changed(words, every, rng):
    """The words with about one in ``every`` replaced."""
    return " ".join(f"new{rng.random()}" if rng.random() < 1 / every else w for w in words)


def test_near_copies_of_a_crowded_group(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    rows = [(i, changed(base, 150, rng)) for i in range(700)]  # one crowded group
    rows += [(1000 + i, " ".join(f"u{i}x{rng.randrange(9000)}" for _ in range(120))) for i in range(40)]  # alone
    rows += [(2000 + i, changed(rows[700 + i][1].split(), 8, rng)) for i in range(40)]  # too different from those
    rows += [(3000 + i, rows[700 + i][1] + " end") for i in range(40)]  # near copies of those
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["key"]: r["component"] for r in simhash.near_copies(docs).collect()}
    assert len(got) == len(rows)
    assert sum(got[i] == 0 for i in range(700)) >= 690
    for i in range(40):
        assert got[1000 + i] == got[3000 + i] == 1000 + i and got[2000 + i] == 2000 + i


def test_near_copies_of_awkward_rows(spark):
    got = {r["key"]: r["component"] for r in simhash.near_copies(awkward_docs(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 6, 7: 7, 8: 8}
    assert simhash.near_copies(no_docs(spark)).count() == 0


def plain_copies(rows):
    """Smallest key of each key's group, from all pairs."""
    sets = {}
    for key, text in rows:
        words = lower(text).split()
        sets[key] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    group = {key: key for key in sets}

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    return {key: top(key) for key in sets}


def edited(words, places):
    return " ".join(f"e{random.random()}" if i in places else w for i, w in enumerate(words))


def star(first, n, rng, size=300, edits=6):
    """A source under the key ``first`` and copies of it that are closer to it than to each other."""
    base = [f"s{first}x{i}" for i in range(size)]
    return [(first, " ".join(base))] + [(first + 1 + i, edited(base, set(rng.sample(range(size), edits)))) for i in range(n)]


def copies_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["key"]: r["component"] for r in simhash.near_copies(docs).collect()}


def test_near_copies_of_stars(spark):
    rng = random.Random(5)
    rows = star(0, 20, rng, edits=6) + star(1000, 200, rng, edits=6)
    got = copies_of(spark, rows)
    assert got == plain_copies(rows)
    assert sum(v == 1000 for v in got.values()) > 150


def test_long_lists_are_settled_whole(spark):
    rng = random.Random(6)
    words = [f"c{i}" for i in range(200)]
    chain = []
    for i in range(40):  # only neighbours are alike
        chain.append((i, " ".join(words)))
        for at in rng.sample(range(200), 3):
            words[at] = f"n{i}x{at}"
    passage = [f"p{i}" for i in range(400)]
    shared = [(1000 + i, " ".join(passage + [f"q{i % 60}x{j}" for j in range(80)]) + " end" * (i // 60)) for i in range(90)]
    rows = chain + shared + star(2000, 40, rng)
    want = plain_copies(rows)
    assert sum(v == 0 for v in want.values()) == 40 and sum(v < k for k, v in want.items() if 1000 <= k < 2000) == 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.select("doc_id", F.xxhash64("text").alias("node"))
    found = nodes.join(simhash.copy_groups(docs, crowd=5, rounds=1, part_size=4), "node")
    named = found.groupBy("component").agg(F.min("doc_id").alias("least"), F.collect_list("doc_id").alias("ids"))
    assert {i: r["least"] for r in named.collect() for i in r["ids"]} == want


def test_near_copies_that_repeat_lines(spark):
    rows = []
    for i in range(0, 60, 2):
        body = [f"b{i}x{j}" for j in range(400)]
        rows += [(i + k, " ".join(body + [f"r{i + k}x{j}" for j in range(8)] * 40)) for k in (0, 1)]
    got = copies_of(spark, rows)
    assert got == plain_copies(rows) == {i: i - i % 2 for i in range(60)}


def test_parities_fold():
    rng = np.random.default_rng(3)
    for n in (0, 1, 256, 257, 3000, 40_000):
        hashes = rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64)
        bits = simhash._parity(hashes)
        assert simhash.WORDS[0] <= len(bits) <= simhash.WORDS[1]
        for words in (1, 2, 4):
            buckets = (hashes.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * words)
            odd = np.bincount(buckets.astype(np.int64), minlength=64 * words) & 1
            assert (simhash._folded(bits[None], words)[0] == np.packbits(odd.astype(np.uint8)).view(np.int64)).all()


def test_sizes_on_both_sides_of_a_width_of_parities(spark):
    rng = random.Random(9)
    base = [f"m{i}" for i in range(290)]
    rows = [(i, edited(base[: 290 - i % 45], set(rng.sample(range(240), 3)))) for i in range(120)]  # 241 to 286 shingles
    rows += [(500 + i, " ".join(base[:200] + [f"l{i}x{j}" for j in range(1500 + 300 * i)])) for i in range(8)]  # long ones first as hubs
    rows += [(600 + i, " ".join(base[:60] + [f"k{i}x{j}" for j in range(200)])) for i in range(60)]  # a passage in common only
    want = plain_copies(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = docs.select("doc_id", F.xxhash64("text").alias("node"))
    for settings in ({}, {"crowd": 5, "rounds": 1, "part_size": 16}):
        got = {}
        for r in nodes.join(simhash.copy_groups(docs, **settings), "node").collect():
            got.setdefault(r["component"], set()).add(r["doc_id"])
        groups = {}
        for k, v in want.items():
            groups.setdefault(v, set()).add(k)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_copies_are_found_by_fingerprints_first(spark, monkeypatch):
    rng = random.Random(13)
    rows = star(0, 60, rng, size=600, edits=2) + star(1000, 20, rng, edits=9)
    # apart by their words, alike by a line that both repeat
    rows += [(2000 + i, " ".join([f"x{i}y{j}" for j in range(60)] + ["the same few words"] * 200)) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.xxhash64("text"))
    ids = {r["node"]: r["doc_id"] for r in docs.collect()}
    prints = {}
    for i, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(i)
    near = plain_groups(prints)
    marked = simhash.fingerprints(docs).select("node", F.col("fingerprint").alias("fp"))
    for size in (simhash.TREE_SIZE, 2):
        group = {i: i for i in ids.values()}
        pairs = [(ids[r["a"]], ids[r["b"]]) for r in simhash.fingerprint_pairs(marked, size).collect()]
        for _ in rows:
            for a, b in pairs:
                group[a] = group[b] = min(group[a], group[b])
        named = {}
        for c, own in prints.items():
            named.setdefault(near[c], []).extend(own)
        assert group == {i: min(own) for own in named.values() for i in own}
    searched = []
    monkeypatch.setattr(simhash, "near_links", lambda v, *a, plain=simhash.near_links: searched.append(v.count()) or plain(v, *a))
    assert copies_of(spark, rows) == plain_copies(rows)
    assert searched == [len(prints)]
