"""SimHash near-duplicates: fingerprints, BK-trees per shard, connected groups.

Two 64-bit fingerprints that differ in at most two bits agree on two of four
bands at least, so every such pair meets in a shard keyed by two agreeing bands.
A shard's distinct fingerprints form a BK-tree (children keyed by their integer
Hamming distance to the parent) that each of them searches, following only the
edges within the radius. A tree does not list the pairs it finds: it joins
them up and returns one link per member, so a dense shard stays linear.

Trees are built in the tasks where their shards meet rather than gathered on
the driver and broadcast: the trees together are as large as the set of
fingerprints, which must not pass through the driver. A shard of more than
``tree_size`` members is no tree: its members are settled by the exact
neighbour keys of `neighbour_links`, whose groups cannot exceed 65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, release_memory, step_table
from .components import components
from .tokens import forget

RADIUS = 2
TREE_SIZE = 512
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of word shingles as a signed 64-bit integer; 0 without words.

    A-Z is lower-cased, words are runs of anything but ASCII white space, and
    a text of fewer words is one shingle. A bit is set if it is set in over
    half of the shingles' XXH64 (seed 42), repeats counted.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = map(b" ".join, zip(*[words[i:] for i in range(min(shingle, len(words)))]))
    ones, n = np.zeros(64, dtype=np.int64), max(1, len(words) - shingle + 1)
    for _ in range(0, n, CHUNK):
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in islice(joined, CHUNK)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """Every row with its ``fingerprint`` (long), row by row, no shuffle."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    return docs.withColumn("fingerprint", of(F.col(f"`{text}`")))


class BKTree:
    """BK-tree over distinct 64-bit values; node i's children by distance."""

    def __init__(self, values: np.ndarray):
        self.codes: list[int] = values.astype(np.uint64).tolist()
        self.children: list[dict[int, int]] = [{} for _ in self.codes]
        codes = self.codes
        for i in range(1, len(codes)):
            at = 0
            while (nxt := self.children[at].setdefault((codes[at] ^ codes[i]).bit_count(), i)) != i:
                at = nxt

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits away."""
        found, todo, codes = [], [0] if self.codes else [], self.codes
        while todo:
            at = todo.pop()
            d = (codes[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if len(edges) > 2 * radius + 1:
                todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
            else:
                todo += [node for k, node in edges.items() if abs(k - d) <= radius]
        return found

    def groups(self, radius: int) -> np.ndarray:
        """For each node the first node of its group, groups being linked within the radius."""
        root = list(range(len(self.codes)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, code in enumerate(self.codes):
            for j in self.within(code, radius):
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return np.array([top(i) for i in range(len(root))], dtype=np.int64)


def shard_keys(fp: str, bands: int = RADIUS + 2):
    """Array of (bands, key): every choice of two of the fingerprint's bands."""
    width = 64 // bands
    part = [F.shiftrightunsigned(F.col(fp), i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)]
    return F.array(
        *[
            F.struct(F.lit(k).alias("bands"), (part[i] * F.lit(1 << width) + part[j]).alias("key"))
            for k, (i, j) in enumerate(combinations(range(bands), 2))
        ]
    )


def neighbour_links(values: DataFrame) -> DataFrame:
    """Links (a, b) between values ``fp`` at most two bits apart, exactly, for sets of any density.

    Two such values share a value that is at most one bit from both. Each
    value is listed under itself and its 64 one-bit neighbours; a list holds
    65 values at most, whatever the data.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    near = values.select("fp", F.explode(F.transform(flips, lambda k: k.bitwiseXOR(F.col("fp")))).alias("key"))
    lists = near.groupBy("key").agg(F.collect_set("fp").alias("fps")).filter("size(fps) > 1")
    return lists.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b").distinct()


def near_links(values: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (a, b) between the distinct values ``fp`` that differ in at most two bits.

    Not every pair is listed, but the links connect exactly what the pairs
    would connect.
    """
    spread = values.select("fp", F.explode(shard_keys("fp")).alias("s")).select("fp", "s.bands", "s.key")
    sizes = spread.groupBy("bands", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # written out, so that a crowded shard's rows can be split among tasks while its size is looked up
    sized = step_table(spread.join(sizes, ["bands", "key"]))
    shards = (
        sized.filter(F.col("members") <= tree_size).groupBy("bands", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    )

    def joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for fps in part["fps"]:
                fps = np.sort(np.asarray(fps, dtype=np.int64))
                first = BKTree(fps.view(np.uint64)).groups(RADIUS)
                linked = first != np.arange(len(first))
                a.append(fps[linked])
                b.append(fps[first[linked]])
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    crowded = sized.filter(F.col("members") > tree_size).select("fp").distinct()
    return shards.mapInPandas(joined, "a long, b long").union(neighbour_links(crowded))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, tree_size: int = TREE_SIZE
) -> DataFrame:
    """(key, fingerprint, component) for every row.

    ``component`` is the smallest key reachable over links of at most two
    differing bits. Texts without words (null ones too) have fingerprint zero
    and are linked like any other. Rows that repeat a key each get a row; a
    null key counts for no component, which is null only if its whole group
    has no other. An empty table gives an empty one; columns other than key
    and text are not used.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = step_table(fingerprints(own, "text", shingle).select("key", "fingerprint"))
    values = step_table(marked.groupBy("fingerprint").agg(F.min("key").alias("least")))
    groups = components(near_links(values.select(F.col("fingerprint").alias("fp")), tree_size))
    grouped = values.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")
    )
    named = grouped.groupBy("group").agg(F.min("least").alias("component"))
    settled = grouped.join(named, "group").select("fingerprint", "component")
    return marked.join(settled, "fingerprint").select("key", "fingerprint", "component")


# Near copies by similarity: an exact join on the rarest shingles of each text.

SAMPLE = 8000  # texts from which the order of shingles is taken; any order gives the same result
COMMON = 200_000
CROWD = 32
ROUNDS = 4
PART = 4096  # texts of an open list that one task compares with as many others
SLICE = 500  # texts or pairs that a task holds as Python objects
WORDS = (4, 512)  # of 64 bits in a text's parities, at least and at most: a bit or two for each shingle in between


def _shingles(text: str | None, shingle: int) -> Iterator[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return map(b" ".join, zip(*[words[i:] for i in range(min(shingle, len(words)))]))


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in _shingles(text, shingle)), dtype=np.uint64).view(np.int64))


def _parity(h: np.ndarray) -> np.ndarray:
    """A bit for each bucket of hashes: whether it holds an odd number of them.

    The number of buckets is a power of two that grows with the number of
    hashes; parities of more buckets fold to those of fewer (`_folded`).
    """
    words = min(max(WORDS[0], 1 << max(0, (len(h) - 1) // 64).bit_length()), WORDS[1])
    odd = np.bincount((h.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities over ``words`` words, from those over a multiple."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _parity_differs(x: str, y: str, least: float):
    """Column: the number of differing parities of two texts whose sizes allow the similarity."""
    k, (x, y) = F.least(F.size(x), F.size(y)), (F.col(x), F.col(y))
    for _ in range(math.ceil(math.log2(1 / least))):  # sizes allow no more halvings
        x, y = (
            F.when(
                F.size(v) > k,
                F.zip_with(
                    F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")),
                    F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")),
                    lambda a, b: a.bitwiseXOR(b),
                ),
            ).otherwise(v)
            for v in (x, y)
        )
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def _common(own: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, in order, and in how many of them they stand."""
    n = own.count()
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 32))
    sample = own if n <= SAMPLE else own.filter(place < (1 << 32) * SAMPLE // n)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [np.zeros(0, np.int64), *(_hashes(x, shingle) for x in part["text"])]
            yield pd.DataFrame({"h": np.concatenate(found)})

    texts = sample.groupBy("node").agg(F.first("text").alias("text")).select("text")
    counts = texts.mapInPandas(listed, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    rows = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h, n = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The rarest shingles of a text: two texts of similarity ``least`` share one of them at least."""
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
    return h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1] if len(h) else h


def fingerprint_pairs(marked: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """Pairs (a, b), a < b, that connect the texts ``node`` whose fingerprints ``fp`` are linked by `near_links`.

    The first text of a fingerprint stands for it; the others of the same
    fingerprint are its pairs, so a group of copies stays linear.
    """
    first = step_table(marked.groupBy("fp").agg(F.min("node").alias("first")))
    same = marked.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (first.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in ("a", "b"))
    near = near_links(first.select("fp"), tree_size).join(left, "a").join(right, "b")
    return same.union(near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")))


def copy_groups(
    docs: DataFrame, text: str = "text", shingle: int = 5, least: float = 0.8, crowd: int = CROWD, rounds: int = ROUNDS, part_size: int = PART
) -> DataFrame:
    """(node, component) for every distinct text; ``node`` is the text's xxhash64.

    Texts whose sets of word shingles have a Jaccard similarity of ``least``
    or more are linked, exactly. Most copies are found by their SimHash: the
    BK-trees of the fingerprints give pairs (`fingerprint_pairs`), the
    similarity of each is measured, and those that reach it make the first
    groups. Similar texts whose fingerprints differ in more bits are found by
    an exact join, which looks only for pairs across these groups. Shingles
    are put in one order, those that a sample shows to be common last; texts
    of that similarity share one of the first n - ceil(least n) + 1 of their n
    shingles, so each text is listed under those. A list of at most ``crowd``
    texts gives all its pairs. In a longer one all texts are compared with a
    hub, the text that stands in most long lists, and those not linked to it
    with the next hub, ``rounds`` times. Where this leaves a list in several
    groups, the pairs across them are compared, in parts of bounded size. A
    pair goes at once where sizes or the bits of parity of its shingles rule
    the similarity out; what is left is decided on the shingles of the two
    texts. Texts without words are alike.
    """
    own = docs.select(F.xxhash64(f"`{text}`").alias("node"), F.col(f"`{text}`").alias("text"))
    distinct = own.groupBy("node").agg(F.first("text").alias("text"))
    order = own.sparkSession.sparkContext.broadcast(_common(own, shingle))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        release_memory()
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = part.column(1).to_pylist()
                found = [_hashes(x, shingle) for x in texts]
                fp = pa.array([fingerprint(x) for x in texts], pa.int64())
                prefix = pa.array([_prefix(h, *order.value, least) for h in found], pa.list_(pa.int64()))
                bits = pa.array([_parity(h) for h in found], pa.list_(pa.int64()))
                n = pa.array([len(h) for h in found], pa.int32())
                yield pa.record_batch([part.column(0), n, fp, prefix, bits], names=["node", "n", "fp", "prefix", "bits"])

    def jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of texts that reach the similarity."""
        of = lru_cache(4)(lambda x: frozenset(_shingles(x, shingle)))

        def share(x: frozenset, y: frozenset) -> float:
            both = len(x & y)
            return both / max(1, len(x) + len(y) - both)

        release_memory()
        for batch in batches:
            good = []
            # few texts at a time: their sets are many times as large
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                texts = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
                good += [share(of(x), of(y)) >= least - 1e-12 for x, y in texts]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    values = step_table(
        distinct.select("node", "text").mapInArrow(marks, "node long, n int, fp long, prefix array<long>, bits array<long>")
    )
    allowed = F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that reach the similarity.

        A bit of parity that differs is a shingle that only one text has:
        pairs with too many go at once, and only the texts of the others are
        moved and compared.
        """
        left, right = (
            values.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in ("a", "b")
        )
        whole = F.col("na") + F.col("nb")
        fits = allowed & ((whole - _parity_differs("bitsa", "bitsb", least)) / 2 >= least / (1 + least) * whole - 1e-6)
        some = step_table(pairs.distinct().join(left, "a").join(right, "b").filter(fits).select("a", "b"))
        asked = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = step_table(own.join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
        left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in ("a", "b"))
        both = some.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
        good = step_table(both.mapInArrow(jaccard, "a long, b long"))
        drop_table(texts)
        drop_table(some)
        return good

    found = [alike(fingerprint_pairs(values.filter("n > 0").select("node", "fp")))]
    copies = step_table(components(found[0]))
    # ``g`` is the group that a text's fingerprint has brought it into
    grouped = values.select("node", "n", "prefix").join(copies, "node", "left").withColumn("g", F.coalesce("component", "node"))
    spread = grouped.select("node", "n", "g", F.explode("prefix").alias("share"))
    sizes = values.select(F.explode("prefix").alias("share")).groupBy("share").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # written out, so that a crowded list's rows can be split among tasks; only short lists are ever gathered
    sized = step_table(spread.join(sizes, "share"))
    few = sized.filter(F.col("members") <= crowd).groupBy("share")
    lists = few.agg(F.sort_array(F.collect_list(F.struct("node", "n", "g"))).alias("m")).select("m").distinct()
    # long lists of the same texts are one, known by digests of 128 bits
    long = sized.filter(F.col("members") > crowd).select("share", "node", "n", "g")
    digest = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(38,0)")).alias(f"d{i}") for i in range(2)]
    same = long.groupBy("share").agg(F.count(F.lit(1)).alias("members"), *digest)
    one = same.groupBy("members", "d0", "d1").agg(F.min("share").alias("share")).select("share")
    long = step_table(long.join(one, "share").withColumnRenamed("share", "lid"))

    def short_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of short lists, of different groups, whose sizes allow the similarity."""
        for part in parts:
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for nodes, sizes, groups in zip(part["nodes"], part["sizes"], part["groups"]):
                x, y = np.triu_indices(len(nodes), 1)
                fits = np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y]) - 1e-9
                fits &= groups[x] != groups[y]
                a.append(nodes[x[fits]])
                b.append(nodes[y[fits]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def all_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different groups whose sizes and parities allow the similarity."""
        rows = rows.sort_values("n", kind="stable")
        nodes, sizes, groups, part = (rows[c].to_numpy() for c in ("node", "n", "g", "part"))
        bits = [x.view(np.uint64) for x in rows["bits"]]  # set bits of negative numbers are counted without their sign
        words = np.array([len(x) for x in bits])
        # rows are in the order of their sizes, so those of as many words of parities stand together
        edges = {w: np.searchsorted(words, [w, w + 1]) for w in np.unique(words).tolist()}
        whole_bits = {w: np.stack(bits[slice(*edge)]) for w, edge in edges.items()}
        folded: dict[tuple[int, int], np.ndarray] = {}
        two = part.min() != part.max()  # two parts of a list: pairs inside one are another group's
        ends = np.searchsorted(sizes, sizes / least + 1e-6, side="right")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, end in enumerate(ends):
            fits = groups[i + 1 : end] != groups[i]
            if two:
                fits &= part[i + 1 : end] != part[i]
            places, own = np.flatnonzero(fits) + i + 1, words[i]
            for w, (first, last) in edges.items():
                at = places[(places >= first) & (places < last)]
                if not len(at):
                    continue
                if (w, own) not in folded:
                    folded[w, own] = _folded(whole_bits[w], own)
                differ = np.bitwise_count(folded[w, own][at - first] ^ bits[i]).sum(axis=1, dtype=np.int64)
                whole = sizes[i] + sizes[at]
                at = at[(whole - differ) / 2 >= least / (1 + least) * whole - 1e-6]
                a.append(np.full(len(at), nodes[i]))
                b.append(nodes[at])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    few = lists.select(F.col("m.node").alias("nodes"), F.col("m.n").alias("sizes"), F.col("m.g").alias("groups"))
    found.append(alike(few.mapInPandas(short_pairs, "a long, b long")))

    def linked() -> DataFrame:
        return reduce(DataFrame.union, found)

    scores = long.groupBy("node").agg(F.count(F.lit(1)).alias("score"))
    left, crowded = step_table(long.join(scores, "node")), False
    for _ in range(rounds):
        hubs = left.groupBy("lid").agg(F.max(F.struct("score", "node", "n", "g")).alias("h"), F.count(F.lit(1)).alias("k"))
        hubs = hubs.filter("k > 1").select("lid", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.g").alias("hub_g"))
        # those of the hub's own group are linked to it
        asked = step_table(left.join(hubs, "lid").filter("g <> hub_g"))
        if asked.isEmpty():
            break
        crowded = True
        fits = F.least("n", "hub_n") >= least * F.greatest("n", "hub_n") - 1e-9
        found.append(alike(asked.filter(fits).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))))
        told = found[-1].select(F.col("a").alias("node"), F.col("b").alias("hub"))
        told = told.union(told.select(F.col("hub").alias("node"), F.col("node").alias("hub")))
        left = asked.join(told, ["node", "hub"], "left_anti").select("node", "lid", "n", "g", "score")
    groups = step_table(components(linked()))
    if crowded:
        placed = long.drop("g").join(groups, "node", "left").withColumn("g", F.coalesce("component", "node"))
        # an open list is dealt into parts of bounded size; each two of them, and each alone, are one task's pairs
        open_lists = placed.groupBy("lid").agg(
            F.min("g").alias("g0"), F.max("g").alias("g1"), F.ceil(F.count(F.lit(1)) / part_size).cast("int").alias("dealt")
        )
        dealt = placed.join(open_lists.filter("g0 <> g1").select("lid", "dealt"), "lid").join(values.select("node", "bits"), "node")
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("dealt")).cast("int"))
        both = F.transform(F.sequence(F.lit(0), F.col("dealt") - 1), lambda j: F.array(F.least("part", j), F.greatest("part", j)))
        dealt = dealt.select("lid", "node", "n", "g", "part", "bits", F.explode(both).alias("pair"))
        rest = dealt.groupBy("lid", "pair").applyInPandas(all_pairs, "a long, b long")
        found.append(alike(rest))
        if not found[-1].isEmpty():
            groups = step_table(components(linked()))
    wordless = values.filter("n = 0").agg(F.min("node")).first()[0]
    component = F.when(F.col("n") == 0, F.lit(wordless)).otherwise(F.coalesce("component", "node"))
    return values.select("node", "n").join(groups, "node", "left").select("node", component.alias("component"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, component) for every key and text: the groups of `copy_groups`, named by their smallest key.

    Null keys are left out; rows that repeat key and text are one. A key that
    stands on texts of several groups gets a row for each.
    """
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("key is not null")
    groups = copy_groups(own, "text", shingle, least)
    rows = step_table(own.select("key", F.xxhash64("text").alias("node")).join(groups, "node").select("key", "component").distinct())
    named = rows.groupBy("component").agg(F.min("key").alias("least"))
    return rows.join(named, "component").select("key", F.col("least").alias("component"))
