"""Phrase collocations, counted in HAT-tries that spill sorted runs.

A task counts the phrases of its texts in a trie: shallow nodes keyed by word
ids, and below them hash containers from the rest of a phrase to its count. A
container that grows too large bursts into a node with a container for each
next word. A trie over its bound spills whole subtrees, those that repeat
least first, as sorted runs, and starts them anew; Spark's shuffle brings the
runs of one prefix partition (the hash of a phrase's first two words)
together, where counts are added up. Phrases are cut into prefix and rest, and
those with a common beginning lie side by side, so that runs compress well.

Phrases are counted by length. A phrase can be frequent only if all shorter
ones in it are, so each pass skips places whose shorter phrases are known to
be rare. What is known travels as a bitmap of fixed size: a frequent phrase is
never missing in it, and a rare one that shares a bit only costs its count.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import step_table

LONGEST = 5
BURST = 4096
#: Phrases a task's tries hold before they spill, and words before it starts anew.
HELD = 800_000
WORDS = 400_000
BLOCK = 1 << 21
#: Phrases from which a row of spilled runs is full.
RUN = 1 << 14
#: Bits of a word's id: a block has at most half as many words as bytes.
ID = 21
MASK = (1 << ID) - 1
#: Bits of the map of frequent phrases.
BITS = 1 << 25
UNKNOWN = "und"
# Every separator becomes a dot, tabs become blanks, A-Z lower case: a dot is no part of any word.
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_table = bytes(46 if b in _SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_cut = re.compile(rb"[ .]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Container(dict):
    """Rest of a phrase, its ids packed into one number, to its count."""


class HatTrie:
    """Counts of sequences of ``k`` ids: nodes by id at the top, hash containers below."""

    def __init__(self, k: int, burst: int = BURST):
        self.k, self.burst, self.size = k, burst, 0
        self.root: dict[int, dict] = {}

    def add(self, first: int, rests: list[int], counts: list[int]) -> None:
        """Add counts of sequences that begin with ``first``; the other ids are packed, ``ID`` bits each."""
        child = self.root.get(first)
        if child is None:
            child = self.root[first] = Container()
        if child.__class__ is Container:
            self._fill(child, rests, counts)
            if len(child) > self.burst and self.k > 2:
                self.root[first] = self._burst(child, self.k - 2)
        else:
            for rest, n in zip(rests, counts):
                self._add(child, self.k - 2, rest, n)

    def _fill(self, container: Container, rests: list[int], counts: list[int]) -> None:
        before, get = len(container), container.get
        for rest, n in zip(rests, counts):
            container[rest] = get(rest, 0) + n
        self.size += len(container) - before

    def _add(self, node: dict, left: int, rest: int, n: int) -> None:
        """Add one sequence below a node, ``left`` ids standing after the node's own."""
        while True:
            shift = ID * left
            key, rest = rest >> shift, rest & ((1 << shift) - 1)
            child = node.get(key)
            if child is None:
                child = node[key] = Container()
            if child.__class__ is Container:
                break
            node, left = child, left - 1
        self._fill(child, [rest], [n])
        if len(child) > self.burst and left > 1:
            node[key] = self._burst(child, left - 1)

    @staticmethod
    def _burst(container: Container, left: int) -> dict:
        """A node with a container for each first id of the container's entries."""
        node: dict[int, dict] = {}
        shift = ID * left
        for rest, n in container.items():
            node.setdefault(rest >> shift, Container())[rest & ((1 << shift) - 1)] = n
        return node

    def _containers(self, node: dict, prefix: int, left: int) -> Iterator[tuple[int, int, Container]]:
        """(prefix, ids after it, container) of everything below."""
        if node.__class__ is Container:
            yield prefix, left, node
        else:
            for key, child in node.items():
                yield from self._containers(child, prefix << ID | key, left - 1)

    def spill(self, keep: int = 0) -> Iterator[tuple[int, list[int], list[int]]]:
        """Whole subtrees (first id, packed rests, counts), until no more than ``keep`` entries stay.

        Subtrees whose entries repeat least go first; each entry is one of a subtree's run, in order.
        """
        worth = []
        for first, child in self.root.items():
            below = [c for _, _, c in self._containers(child, 0, self.k - 1)]
            size = sum(map(len, below))
            worth.append((sum(sum(c.values()) for c in below) / size, first, size))
        for _, first, size in sorted(worth):
            if self.size <= keep:
                break
            entries = []
            for prefix, left, container in self._containers(self.root.pop(first), 0, self.k - 1):
                high = prefix << ID * left
                entries += [(high | rest, n) for rest, n in container.items()] if high else container.items()
            self.size -= size
            entries.sort()
            yield first, [e[0] for e in entries], [e[1] for e in entries]


class Words(defaultdict):
    """Ids of words by first appearance; 0 is the separator."""

    def __init__(self) -> None:
        super().__init__()
        self.text: list[bytes] = []
        self[b"."]

    def __missing__(self, word: bytes) -> int:
        self.text.append(word)
        self[word] = number = len(self.text) - 1
        return number


def _distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of up to five columns of ids, in order, and how often each stands."""
    packed, low = columns[0], columns[1:3]
    for own in low:
        packed = packed << ID | own
    if len(columns) > 3:
        threes, packed = np.unique(packed, return_inverse=True)
        for own in columns[3:]:
            packed = packed << ID | own
    found, counts = np.unique(packed, return_counts=True)
    out = []
    for _ in columns[3:]:
        out.append(found & MASK)
        found = found >> ID
    if len(columns) > 3:
        found = threes[found]
    for _ in low:
        out.append(found & MASK)
        found = found >> ID
    return [found, *out[::-1]], counts


def _blocks(texts: list[str | None], block: int = BLOCK) -> Iterator[list[bytes]]:
    """Words and separators of some texts, in blocks that end between words; a separator ends each text."""
    held, size = [], 0
    for text in texts:
        data, begin = (text or "").encode("utf-8", "surrogatepass").translate(_table), 0
        while begin < len(data):
            cut = _cut.search(data, begin + block - size) if len(data) - begin > block - size else None
            end = cut.start() if cut else len(data)
            held.append(data[begin:end])
            size, begin = size + end - begin, end
            if size >= block:
                yield b"".join(held).replace(b".", b" . ").split()
                held, size = [], 0
        held.append(b".")
    if held:
        yield b"".join(held).replace(b".", b" . ").split()


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _MIX
    return h ^ (h >> np.uint64(29))


def _lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 7)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words))


class _Counter:
    """Phrase counts of one task: tries by language and length, words' ids and hashes, the map of shorter phrases."""

    def __init__(self, lengths: tuple[int, ...], known: int, bits: np.ndarray | None, held: int, burst: int):
        self.lengths, self.known, self.bits, self.held, self.burst = lengths, known, bits, held, burst
        self.tries: dict[tuple[str, int], HatTrie] = {}
        self.totals: Counter[str] = Counter()
        self._new_words()

    def _new_words(self) -> None:
        self.words, self.hashes = Words(), np.zeros(1, np.uint64)

    def _hash_words(self) -> np.ndarray:
        """XXH64 of all words by id."""
        more = self.words.text[len(self.hashes) :]
        if more:
            self.hashes = np.concatenate([self.hashes, _word_hashes(more)])
        return self.hashes

    def marks(self, lang: str, ids: list[np.ndarray]) -> np.ndarray:
        """Hashes of phrases; ``ids`` holds their first words, second words, ..."""
        word = self._hash_words()
        h = np.full(len(ids[0]), _lang_seed(lang), dtype=np.uint64)
        for own in ids:
            h = _mixed(h, word[own])
        return h

    def texts(self, lang: str, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
        """Count the phrases of some texts of a language; yields what spills."""
        before = np.zeros(0, np.int64)
        for words in _blocks(texts):
            ids = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
            self.totals[lang] += int(np.count_nonzero(ids))
            for k in self.lengths:
                # the last words of the block before belong to phrases that end in this one
                self._phrases(lang, np.concatenate([before[max(0, len(before) - k + 1) :], ids]), k)
            before = np.concatenate([before, ids])
            before = before[max(0, len(before) - max(self.lengths) + 1) :]
            if sum(t.size for t in self.tries.values()) > self.held or len(self.words.text) > WORDS:
                whole = len(self.words.text) > WORDS
                yield from self.runs(0 if whole else 0.5)
                if whole:
                    kept = [self.words.text[i] for i in before.tolist()]
                    self._new_words()
                    before = np.array([self.words[w] for w in kept], dtype=np.int64)

    def _phrases(self, lang: str, ids: np.ndarray, k: int) -> None:
        n = len(ids) - k + 1
        if n <= 0:
            return
        inside = ids != 0
        good = np.logical_and.reduce([inside[j : j + n] for j in range(k)])
        if self.known:
            f, m = self.known, len(ids) - self.known + 1
            marks = self.marks(lang, [ids[j : j + m] for j in range(f)]) % np.uint64(BITS)
            frequent = (self.bits[marks >> np.uint64(3)] >> (marks & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            good &= np.logical_and.reduce([frequent[j : j + n] for j in range(k - f + 1)])
        at = np.flatnonzero(good)
        if not len(at):
            return
        columns, counts = _distinct([ids[at + j] for j in range(k)])
        if k == 1:  # words hang together under one node
            columns = [np.zeros_like(columns[0]), *columns]
        if (lang, k) not in self.tries:
            self.tries[lang, k] = HatTrie(len(columns), self.burst)
        rests = columns[1]
        for own in columns[2:4]:
            rests = rests << ID | own
        rests = rests.tolist()
        if k == 5:
            rests = [high << ID | low for high, low in zip(rests, columns[4].tolist())]
        counts, first = counts.tolist(), columns[0]
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
        add = self.tries[lang, k].add
        for a, b in zip(cuts, cuts[1:]):
            add(int(first[a]), rests[a:b], counts[a:b])

    def runs(self, keep: float = 0) -> Iterator[pa.RecordBatch]:
        """What the tries spill down to a share of themselves."""
        for (lang, k), trie in self.tries.items():
            firsts, rests, counts = [], [], []
            for first, own, n in trie.spill(int(keep * trie.size)):
                firsts.append((first, len(own)))
                rests += own
                counts += n
                if len(rests) >= RUN:
                    yield self._rows(lang, k, firsts, rests, counts)
                    firsts, rests, counts = [], [], []
            if rests:
                yield self._rows(lang, k, firsts, rests, counts)

    def _rows(self, lang: str, k: int, firsts: list[tuple[int, int]], rests: list[int], counts: list[int]) -> pa.RecordBatch:
        """Runs as one row: (lang, size, prefixes, rests, counts)."""
        ids = []
        if k == 5:
            ids.append(np.array([r & MASK for r in rests], dtype=np.int64))
            rests = [r >> ID for r in rests]
        packed = np.array(rests, dtype=np.int64)
        for _ in range(min(k - 1, 3) or 1):
            ids.append(packed & MASK)
            packed = packed >> ID
        if k > 1:
            first, often = np.array(firsts, dtype=np.int64).T
            ids.append(np.repeat(first, often))
        text = pa.array(self.words.text, pa.binary())
        words = [text.take(pa.array(own)) for own in ids[::-1]]
        prefixes, after = _joined(words[:2]), _joined(words[2:]) if k > 2 else pa.array([""] * len(rests))
        return _row(lang, k, prefixes, after, pa.array(counts, pa.int64()))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """All that is left, and the number of words of each language (length 0)."""
        yield from self.runs()
        for lang, n in self.totals.items():
            if n and 1 in self.lengths:
                yield _row(lang, 0, pa.array([""]), pa.array([""]), pa.array([n]))


def _joined(words: list[pa.Array]) -> pa.Array:
    found = pc.binary_join_element_wise(*words, pa.scalar(b" ")) if len(words) > 1 else words[0]
    return found.cast(pa.string())


def _row(lang: str, k: int, *columns: pa.Array) -> pa.RecordBatch:
    whole = pa.array([0, len(columns[0])], pa.int32())
    values = [pa.array([lang]), pa.array([k], pa.int32()), *(pa.ListArray.from_arrays(whole, c) for c in columns)]
    return pa.record_batch(values, names=["lang", "size", "prefixes", "rests", "counts"])


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """The map of some phrases (lang, phrase): ``BITS`` bits, whatever their number."""

    @F.pandas_udf("long")
    def mark(langs: pd.Series, texts: pd.Series) -> pd.Series:
        found = np.zeros(len(texts), dtype=np.int64)
        for i, (lang, phrase) in enumerate(zip(langs, texts)):
            h = np.full(1, _lang_seed(lang), dtype=np.uint64)
            for word in _word_hashes(phrase.encode("utf-8", "surrogatepass").split(b" ")):
                h = _mixed(h, word)
            found[i] = int(h[0] % np.uint64(BITS))
        return pd.Series(found)

    # Spark's bitmaps count from 1
    marked = phrases.select((mark("lang", "phrase") + 1).alias("mark"))
    maps = marked.groupBy(F.expr("bitmap_bucket_number(mark)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(mark))").alias("bits")
    )
    whole = np.zeros(BITS // 8, dtype=np.uint8)
    for bucket, own in maps.collect():
        whole[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(own)] = np.frombuffer(bytes(own), dtype=np.uint8)
    return whole


def counted(
    docs: DataFrame, lengths: tuple[int, ...], least: int, shorter: DataFrame | None = None, held: int = HELD, burst: int = BURST
) -> DataFrame:
    """(lang, size, phrase, n) of the phrases of some lengths that stand at least ``least`` times in a language.

    ``docs`` has lang and text; ``shorter`` are the frequent phrases of the
    length before the shortest. With length 1 there is also a row of size 0
    for each language, with the number of its words.
    """
    spark, known, bits = docs.sparkSession, 0, None
    if shorter is not None:
        known, bits = min(lengths) - 1, spark.sparkContext.broadcast(_bitmap(shorter))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counter(lengths, known, bits.value if bits else None, held, burst)
        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("text")
            for lang in pc.unique(langs).to_pylist():
                yield from counts.texts(lang, texts.filter(pc.equal(langs, lang)).to_pylist())
        yield from counts.rest()

    runs = docs.mapInArrow(part, "lang string, size int, prefixes array<string>, rests array<string>, counts array<long>")
    entries = runs.select("lang", "size", F.explode(F.arrays_zip("prefixes", "rests", "counts")).alias("e"))
    entries = entries.select("lang", F.col("e.prefixes").alias("prefix"), "size", F.col("e.rests").alias("rest"), "e.counts")
    merged = entries.repartition("lang", "prefix").groupBy("lang", "prefix", "size", "rest").agg(F.sum("counts").alias("n"))
    phrase = F.when(F.col("rest") == "", F.col("prefix")).otherwise(F.concat_ws(" ", "prefix", "rest"))
    found = merged.filter((F.col("n") >= least) | (F.col("size") == 0))
    return step_table(found.select("lang", "size", phrase.alias("phrase"), "n"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, size, phrase, n) of all words and phrases of up to five words that stand ``least`` times; size 0: all words."""
    own = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"))
    own = own.filter("text is not null")
    levels = [counted(own, (1,), least, None, held, burst)]
    for lengths in ((2,), (3,), (4, 5)):
        shorter = levels[-1].filter(F.col("size") == min(lengths) - 1)
        levels.append(counted(own, lengths, least, shorter, held, burst))
    return reduce(DataFrame.union, levels)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, top: int = 2000, held: int = HELD, burst: int = BURST
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to five words.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces
    and at blanks and tabs into words; null texts have none, a null language
    is ``und``. A phrase that stands a >= ``least`` times is a candidate; a cut
    into a first part that stands l times and a rest that stands r times gives
    floor(1000 a n / (l r)), n being the language's words; the cut with the
    lowest score counts, the first of several. A candidate inside a longer
    one that stands as often goes. ``top`` by score, then a, then phrase (in
    byte order). Repeated rows count as often as they stand; an empty table
    gives an empty one; other columns are not used.
    """
    found = step_table(frequent_phrases(docs, text, lang, least, held, burst))
    candidates = found.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))
    # a longer candidate as frequent reaches a candidate through phrases one word longer, all as frequent
    inner = F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)")
    )
    longer = candidates.filter("size >= 3").select("lang", F.explode(inner).alias("phrase"), "a")
    kept = candidates.join(longer, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("*", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "*",
        F.expr("substring_index(phrase, ' ', k)").alias("first_part"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest_part"),
    )
    counts = found.filter("size >= 1")
    left = counts.select("lang", F.col("phrase").alias("first_part"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest_part"), F.col("n").alias("r"))
    words = found.filter("size = 0").select("lang", "n")
    joined = cuts.join(left, ["lang", "first_part"]).join(right, ["lang", "rest_part"]).join(words, "lang")
    score = F.expr(
        "(cast(1000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0)))"
        " div (cast(l as decimal(20,0)) * cast(r as decimal(20,0)))"
    )
    best = joined.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn(
        "rank", F.row_number().over(order).cast("long")
    )
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
