"""Benchmark decontamination with suffix arrays over the training text.

The training documents that a task reads in one batch are a shard. Its words
become ids (0: a word no benchmark item has, and the border between documents),
and the suffixes that can begin a match are sorted into a suffix array. Every
suffix of every benchmark item is looked up by binary search, one word deeper
at a time, which gives its longest verbatim match and all places of its window.
Documents are searched where they are read; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, step_table

WINDOW = 10
#: Benchmark text held by a task at once; a larger benchmark is searched in several passes.
BLOCK_CHARS = 16_000_000
FOUND = "n_words long, ranges array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of 0-9, a-z and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Suffixes:
    """All suffixes of the benchmark items, and which of them begin a window."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        words, item, left, width = [np.zeros(0, np.int64)], [], [], []
        names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(names)}
        for name, text in items:
            own = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            words.append(np.array([*own, 0], dtype=np.int64))
            item += [place[name]] * len(own) + [-1]
            left += [*range(len(own), -1, -1)]
            width += [min(window, len(own))] * (len(own) + 1)
        self.names = np.array(names, dtype=object)
        self.words = np.concatenate(words)
        self.item, self.left, self.width = (np.array(x, dtype=np.int64) for x in (item, left, width))
        self.starts = np.flatnonzero(self.item >= 0)
        self.shortest = int(self.width[self.starts].min(initial=window))
        self.longest = int(self.left.max(initial=0))

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.int32, count=len(words))


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes beginning at ``at``, sorted by their first ``depth`` words; a suffix ends at its first 0.

    ``ids`` ends with a 0. Groups of equal prefixes are refined word by word,
    and only those that still hold several suffixes are looked at again.
    """
    order, group, open_ = at.copy(), np.zeros(len(at), dtype=np.int64), np.arange(len(at))
    base = int(ids.max(initial=0)) + 1
    for d in range(depth):
        if not len(open_):
            break
        key = group[open_] * base + ids[order[open_] + d]
        turn = np.argsort(key, kind="stable")
        order[open_], key = order[open_][turn], key[turn]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        group[open_] = np.repeat(open_[first], size)
        open_ = open_[np.repeat(size > 1, size) & (key % base > 0)]
    return order


def _bound(ids, order, lo, hi, d, word, right):
    """First slot in [lo, hi) whose suffix has at depth d a word of ``word`` or more (more, if ``right``)."""
    lo, hi = lo.copy(), hi.copy()
    while len(todo := np.flatnonzero(lo < hi)):
        mid = (lo[todo] + hi[todo]) >> 1
        value = ids[order[mid] + d]
        below = value <= word[todo] if right else value < word[todo]
        lo[todo[below]] = mid[below] + 1
        hi[todo[~below]] = mid[~below]
    return lo


def search(ids: np.ndarray, order: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, ...]:
    """For every suffix of ``tests.starts``: its longest match and the places of its window.

    Returns (length, lo, hi, from, to): the longest match has that length and
    stands at ``order[lo:hi]``, the window (if the suffix begins one) at
    ``order[from:to]``. Matches shorter than the shortest window are not in
    the array, so their length may be reported as less.
    """
    n = len(tests.starts)
    length = np.zeros(n, np.int64)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    from_, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, width = tests.left[tests.starts], tests.width[tests.starts]
    todo = np.arange(n)
    for d in range(tests.longest):
        todo = todo[left[todo] > d]
        word = tests.words[tests.starts[todo] + d]
        a = _bound(ids, order, lo[todo], hi[todo], d, word, False)
        b = _bound(ids, order, a, hi[todo], d, word, True)
        todo, a, b = todo[a < b], a[a < b], b[a < b]
        if not len(todo):
            break
        lo[todo], hi[todo], length[todo] = a, b, d + 1
        whole = width[todo] == d + 1
        from_[todo[whole]], to[todo[whole]] = a[whole], b[whole]
    return length, lo, hi, from_, to


class Shard:
    """The documents of one batch: word ids, borders and the suffix array."""

    def __init__(self, texts: Sequence[str | None], tests: Suffixes):
        words = [tests.codes(words_of(x)) for x in texts]
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        border = np.zeros(1, np.int32)
        self.ids = np.concatenate([border, *(x for w in words for x in (w, border))])
        self.first = 1 + np.r_[0, np.cumsum(self.counts + 1)[:-1]][: len(words)]
        zeros = np.flatnonzero(self.ids == 0)
        known = np.flatnonzero(self.ids)
        run = zeros[np.searchsorted(zeros, known)] - known
        self.order = suffix_array(self.ids, known[run >= tests.shortest], tests.longest)
        self.length, self.longest_lo, self.longest_hi, self.lo, self.hi = search(self.ids, self.order, tests)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1


def _ranges(flags: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true, one after another: s0, e0, s1, e1, ..."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))


def hits(texts: Sequence[str | None], before: Sequence, tests: Suffixes) -> pd.DataFrame:
    """Per text: number of words, ranges of words inside a window's occurrence, items with such windows."""
    shard = Shard(texts, tests)
    size = shard.hi - shard.lo
    which = np.repeat(np.arange(len(size)), size)
    slot = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(shard.lo, size)
    place = shard.order[slot]
    change = np.zeros(len(shard.ids) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + tests.width[tests.starts[which]], -1)
    hit = np.cumsum(change)[:-1] > 0
    pairs = np.unique(np.c_[shard.document(place), tests.item[tests.starts[which]]], axis=0)
    items: dict[int, list[str]] = {}
    for doc, item in pairs.tolist():
        items.setdefault(doc, []).append(tests.names[item])
    ranges, found = [], []
    for i, old in enumerate(before):
        own = hit[shard.first[i] : shard.first[i] + shard.counts[i]]
        if old is not None and len(old["ranges"]):
            own = own.copy()
            for a, b in np.asarray(old["ranges"]).reshape(-1, 2):
                own[a:b] = True
        ranges.append(_ranges(own) if own.any() else [])
        found.append(sorted({*items.get(i, ()), *(old["items"] if old is not None else ())}))
    return pd.DataFrame({"n_words": shard.counts, "ranges": ranges, "items": found})


def blocks_of(benchmark: DataFrame, key: str, text: str, block_chars: int) -> Iterator[list]:
    """The benchmark as (id text, text) lists of about ``block_chars`` characters, one at a time to the driver."""
    own = benchmark.select(
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("k"), F.col(f"`{text}`").alias("t")
    )
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    at = F.pmod(F.xxhash64("k", "t"), F.lit(n))
    return (own.filter(at == i).collect() for i in range(n))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Every row with ``contamination`` added: struct of n_words, ranges and items.

    ``ranges`` lists starts and ends (s0, e0, s1, ...) of the words that stand
    inside an occurrence of a window of ``window`` consecutive benchmark words
    (a shorter item is one window; an item without words is none); ``items``
    are the ids, as sorted text, with such a window. Null texts have no words;
    repeated rows stay repeated; an empty benchmark hits nothing; rows of the
    benchmark that share an id are one item.
    """
    found = docs
    for k, block in enumerate(blocks_of(benchmark, item, item_text, block_chars)):
        shared = docs.sparkSession.sparkContext.broadcast([(r["k"], r["t"]) for r in block])
        if k:
            found = step_table(found)
            found = found.withColumn("contamination", _more(shared, window)(F.col(f"`{text}`"), F.col("contamination")))
        else:
            found = found.withColumn("contamination", _first(shared, window)(F.col(f"`{text}`")))
    return found


def _first(shared, window: int):
    """The search of the first benchmark block."""

    @F.pandas_udf(FOUND)
    def searched(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tests = Suffixes(shared.value, window)
        for texts in parts:
            yield hits(texts.tolist(), [None] * len(texts), tests)

    return searched


def _more(shared, window: int):
    """The search of a further block, added to what the earlier ones found."""

    @F.pandas_udf(FOUND)
    def searched(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        tests = Suffixes(shared.value, window)
        for texts, before in parts:
            yield hits(texts.tolist(), before.to_dict("records"), tests)

    return searched


def n_hit(column: str = "contamination"):
    """Number of hit words, from the ranges of a contamination column."""
    signed = F.transform(F.col(f"{column}.ranges"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with the columns they came with.

    Null and empty texts stay, repeated rows stay repeated, an empty table or
    benchmark drops nothing.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    found = contamination(rows, benchmark, text="text", **options)
    return found.filter(F.size("contamination.items") == 0).select("row.*")


def longest_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(item, start, length, doc, place): the longest verbatim match of every benchmark suffix over all shards.

    Suffixes whose longest match is shorter than the shortest window have no
    row; ties go to the smaller document key, null ones last, then place. Null
    and empty texts match nothing; rows that repeat a key are texts of their
    own. Without documents or items there are no rows.
    """
    # keys pass through Python as text: pandas turns numbers beside a null into doubles
    digits = F.col(f"`{key}`").cast("long").cast("string").alias("doc")
    own = docs.select(digits, F.col(f"`{text}`").alias("text"))
    kind = "item string, start long, length long, doc string, place long"
    all_found = docs.sparkSession.createDataFrame([], kind)
    for block in blocks_of(benchmark, item, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast([(r["k"], r["t"]) for r in block])

        def searched(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            tests = Suffixes(shared.value, window)
            begin = np.flatnonzero(np.r_[True, tests.item[:-1] < 0])
            for part in parts:
                keys = [(k is None, int(k or 0)) for k in part["doc"]]
                part = part.iloc[sorted(range(len(keys)), key=keys.__getitem__)]
                shard = Shard(part["text"].tolist(), tests)
                got = np.flatnonzero(shard.length >= tests.shortest)
                slots = zip(shard.longest_lo[got].tolist(), shard.longest_hi[got].tolist())
                place = np.array([shard.order[a:b].min() for a, b in slots], dtype=np.int64)
                doc = shard.document(place)
                at = tests.starts[got]
                yield pd.DataFrame(
                    {
                        "item": tests.names[tests.item[at]],
                        "start": at - begin[np.searchsorted(begin, at, side="right") - 1],
                        "length": shard.length[got],
                        "doc": part["doc"].to_numpy()[doc],
                        "place": place - shard.first[doc],
                    }
                )

        all_found = all_found.union(own.mapInPandas(searched, kind))
    all_found = all_found.withColumn("doc", F.col("doc").cast("long"))
    order = F.struct((-F.col("length")).alias("less"), F.isnull("doc").alias("unnamed"), "doc", "place")
    best = F.min(order).alias("best")
    return (
        all_found.groupBy("item", "start")
        .agg(best)
        .select("item", "start", (-F.col("best.less")).alias("length"), "best.doc", "best.place")
    )
