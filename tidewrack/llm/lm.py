"""Language-model scoring with a sharded Elias-Fano bigram trie.

Texts are read in blocks. A block asks, for each of its distinct words and
distinct bigrams once, how often the whole training corpus has it; the asking
and the counting are one exchange: a shard gets all blocks' requests for its
words and bigrams, adds up their training counts, builds its trie and answers
from it. A second exchange takes the answers back to the blocks, which hold
the order of the words and add up each document's scores. Words are counted
by their text; bigrams by hashes of 62 and 40 bits of their two words. A word
or bigram that fills a third of the corpus is one request per block like any
other.

The model: p(w | u) = (c(u, w) + strength * p(w)) / (c(u) + strength), with
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); it sums to one over the vocabulary
and one place for all unknown words, up to the quantisation of the trie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, step_table
from .elias_fano import Trie

END = b"\n"  # no word holds white space; also the context of a text's first word
#: Weight of the word model, in counts; chosen by held-out likelihood on documents apart from the tests.
STRENGTH = 300.0
BLOCK_TOKENS = 3_000_000
#: Steps of the quantised log10 of counts; code 0 means absent.
STEPS = 4000
WORD_BITS = np.uint64((1 << 40) - 1)


class Numbers(dict):
    """Numbers for words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, and one end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Block:
    """Some documents as numbers of the block's own distinct words."""

    def __init__(self):
        self.numbers = Numbers()
        self.numbers[END] = 0
        self.docs: list[np.ndarray] = []
        self.keys: list = []
        self.train: list[bool] = []
        self.size = 0

    def add(self, key, text: str | None, train: bool) -> None:
        own = words_of(text)
        self.docs.append(np.fromiter(map(self.numbers.__getitem__, own), dtype=np.int32, count=len(own)))
        self.keys.append(key)
        self.train.append(train)
        self.size += len(own)


def blocks(parts: Iterator[pd.DataFrame], block_tokens: int = BLOCK_TOKENS) -> Iterator[tuple[int, Block]]:
    """The task's documents in blocks of bounded size, each with an id that the same scan gives again."""
    base, n, block = TaskContext.get().partitionId() << 32, 0, Block()
    for part in parts:
        for key, text, train in zip(part["key"], part["text"], part["train"]):
            block.add(key, text, bool(train))
            if block.size >= block_tokens:
                yield base + n, block
                n, block = n + 1, Block()
    if block.docs:
        yield base + n, block


class Layout:
    """Which shard each word and bigram of a block belongs to, and in which order they are asked."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, shards: int):
        before = np.r_[0, tokens[:-1]]
        before[np.cumsum(lengths) - lengths] = 0
        key = before.astype(np.int64) << 32 | tokens
        pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.before = before
        self.u, self.w = pairs >> 32, pairs & 0xFFFFFFFF
        self.word_shard = (hashes % np.uint64(shards)).astype(np.int64)
        mixed = (hashes[self.u] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.w]) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.pair_shard = ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(self.word_shard, kind="stable")
        self.pair_order = np.argsort(self.pair_shard, kind="stable")
        edges = np.arange(shards + 1)
        self.word_edges = np.searchsorted(self.word_shard[self.word_order], edges)
        self.pair_edges = np.searchsorted(self.pair_shard[self.pair_order], edges)


def hashes_of(words) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def _counts(c: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes; those of 255 and more apart."""
    return np.minimum(c, 255).astype(np.uint8).tobytes(), c[c >= 255].astype("<u8").tobytes()


def _uncounts(small: bytes, large: bytes) -> np.ndarray:
    c = np.frombuffer(small, dtype=np.uint8).astype(np.int64)
    c[c == 255] = np.frombuffer(large, dtype="<u8")
    return c


REQUEST = (
    "block long, shard int, words binary, counts binary, large_counts binary, contexts binary, sizes binary, "
    "low binary, high binary, pair_counts binary, large_pair_counts binary"
)


def requests(shards: int, block_tokens: int = BLOCK_TOKENS):
    """What each block asks of each shard."""

    def asked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block_id, block in blocks(parts, block_tokens):
            words = list(block.numbers)
            hashes = hashes_of(words)
            tokens, lengths = np.concatenate(block.docs), np.array([len(x) for x in block.docs])
            layout = Layout(tokens, lengths, hashes, shards)
            learn = np.repeat(np.array(block.train), lengths)
            counts = np.bincount(tokens[learn], minlength=len(words))
            pair_counts = np.bincount(layout.pair_of[learn], minlength=len(layout.u))
            rows = []
            for s in range(shards):
                own = layout.word_order[layout.word_edges[s] : layout.word_edges[s + 1]]
                pairs = layout.pair_order[layout.pair_edges[s] : layout.pair_edges[s + 1]]
                if not len(own) and not len(pairs):
                    continue
                u, w = layout.u[pairs], hashes[layout.w[pairs]] & WORD_BITS
                first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
                rows.append(
                    (
                        block_id,
                        s,
                        b" ".join(words[i] for i in own.tolist()),
                        *_counts(counts[own]),
                        (hashes[u[first]] >> np.uint64(2)).astype("<u8").tobytes(),
                        np.diff(np.r_[first, len(u)]).astype("<u4").tobytes(),
                        (w & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
                        (w >> np.uint64(32)).astype(np.uint8).tobytes(),
                        *_counts(pair_counts[pairs]),
                    )
                )
                if len(rows) == 64:
                    yield pd.DataFrame(rows, columns=_names(REQUEST))
                    rows = []
            yield pd.DataFrame(rows, columns=_names(REQUEST))

    return asked


def _names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


ANSWER = "block long, shard int, totals binary, large_totals binary, codes binary, tokens long, distinct long"


def quantised(counts: np.ndarray) -> np.ndarray:
    return (1 + np.rint(np.log10(counts) * STEPS)).astype(np.uint16)


def unquantised(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10 ** ((codes.astype(float) - 1) / STEPS), 0.0)


def answers(part: pd.DataFrame) -> pd.DataFrame:
    """A shard: counts of its words, a trie of its bigrams, and what every block asked of them.

    The first row also carries the shard's numbers of training tokens and
    distinct training words.
    """
    part = part.sort_values("block", kind="stable")
    total: dict[bytes, int] = {}
    asked = [raw.split(b" ") if raw else [] for raw in part["words"]]
    for own, small, large in zip(asked, part["counts"], part["large_counts"]):
        for w, c in zip(own, _uncounts(small, large).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
    u = [np.repeat(np.frombuffer(c, "<u8"), np.frombuffer(n, "<u4")) for c, n in zip(part["contexts"], part["sizes"])]
    w = [np.frombuffer(a, "<u4") | np.frombuffer(b, np.uint8).astype(np.uint64) << np.uint64(32) for a, b in zip(part["low"], part["high"])]
    ends = np.cumsum([len(x) for x in u])
    u, w = np.concatenate(u).astype(np.int64), np.concatenate(w).astype(np.int64)
    counts = np.concatenate([_uncounts(a, b) for a, b in zip(part["pair_counts"], part["large_pair_counts"])])
    order = np.lexsort((w, u))
    su, sw = u[order], w[order]
    new = np.r_[True, (su[1:] != su[:-1]) | (sw[1:] != sw[:-1])][: len(su)]
    first = np.flatnonzero(new)
    summed = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    known = summed > 0
    trie = Trie(su[first][known], sw[first][known], quantised(summed[known]))
    codes = np.zeros(len(u), dtype=np.uint16)
    codes[order] = trie.find(su[first], sw[first])[np.cumsum(new) - 1]
    found = pd.DataFrame({"block": part["block"], "shard": part["shard"]})
    sums = [_counts(np.array([total[x] for x in own], dtype=np.int64)) for own in asked]
    found["totals"], found["large_totals"] = [a for a, _ in sums], [b for _, b in sums]
    found["codes"] = [codes[a:b].astype("<u2").tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)]
    found["tokens"] = [sum(total.values())] + [0] * (len(part) - 1)
    found["distinct"] = [sum(c > 0 for c in total.values())] + [0] * (len(part) - 1)
    return found


TEXTS = "block long, keys array<string>, train array<boolean>, lengths binary, tokens binary, hashes binary"


def texts(parts: Iterator[pd.DataFrame], block_tokens: int = BLOCK_TOKENS) -> Iterator[pd.DataFrame]:
    """The blocks themselves: the order of their words."""
    for block_id, block in blocks(parts, block_tokens):
        lengths = np.array([len(x) for x in block.docs], dtype="<i8").tobytes()
        tokens, hashes = np.concatenate(block.docs).astype("<i4").tobytes(), hashes_of(block.numbers).tobytes()
        yield pd.DataFrame([(block_id, block.keys, block.train, lengths, tokens, hashes)], columns=_names(TEXTS))


SCORES = "key string, train boolean, n_tokens long, n_known long, base_score double, score double"


def scores(shards: int, n: int, v: int, strength: float):
    """Scores of a block's documents from its answers."""

    def of(answered: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if len(block) != 1:
            raise ValueError("a block met no or several texts: the two scans of the documents differ")
        row = block.iloc[0]
        tokens, hashes = np.frombuffer(row["tokens"], "<i4"), np.frombuffer(row["hashes"], "<u8")
        lengths = np.frombuffer(row["lengths"], "<i8")
        layout = Layout(tokens, lengths, hashes, shards)
        answered = answered.sort_values("shard")
        counts, codes = np.zeros(len(hashes), np.int64), np.zeros(len(layout.u), np.uint16)
        counts[layout.word_order] = np.concatenate([_uncounts(a, b) for a, b in zip(answered["totals"], answered["large_totals"])])
        codes[layout.pair_order] = np.concatenate([np.frombuffer(x, "<u2") for x in answered["codes"]])
        base = (counts + 0.5) / (n + 0.5 * (v + 1))
        pair = (unquantised(codes) + strength * base[layout.w]) / (counts[layout.u] + strength)
        first = np.cumsum(lengths) - lengths
        return pd.DataFrame(
            {
                "key": list(row["keys"]),
                "train": list(row["train"]),
                "n_tokens": lengths,
                "n_known": np.add.reduceat((counts > 0)[tokens].astype(np.int64), first),
                "base_score": np.add.reduceat(np.log10(base)[tokens], first),
                "score": np.add.reduceat(np.log10(pair)[layout.pair_of], first),
            }
        )

    return of


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", strength: float = STRENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(key, train, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model learns from the rows where ``train`` is true and scores all.
    Null texts are empty: one end token. Rows that repeat a key are documents
    of their own; an empty table gives an empty one; without training rows
    every word is unknown. Other columns are not used.
    """
    spark = docs.sparkSession
    # keys pass through Python as text: pandas turns numbers beside a null into doubles
    digits = F.col(f"`{key}`").cast("long").cast("string").alias("key")
    own = docs.select(digits, F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    shards = partitions(spark)
    answered = step_table(
        own.mapInPandas(requests(shards, block_tokens), REQUEST).groupBy("shard").applyInPandas(answers, ANSWER)
    )
    n, v = answered.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ordered = own.mapInPandas(partial(texts, block_tokens=block_tokens), TEXTS)
    found = answered.groupBy("block").cogroup(ordered.groupBy("block")).applyInPandas(scores(shards, n, v, strength), SCORES)
    return found.withColumns({"key": F.col("key").cast("long"), "train_tokens": F.lit(n).cast("long")})
