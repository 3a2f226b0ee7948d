"""Token-id files with directly addressable codes.

Documents are put in the order of their ids by a range exchange; each task
writes its documents' token ids as segments and the table of segments is
stored by Spark, so a lost task only writes its own segments again. A segment
splits ids into 8-bit chunks: level 0 has the lowest chunk of every id, level
k + 1 a chunk for each id of level k whose continuation bit is set. A rank
directory over each bitmap leads to any id without decoding others.

Segment bytes, little-endian: magic, number of documents, ids and levels;
document ids (int64), their null bits, lengths (uint32); then for every level its
size, chunks, bitmap and the ranks before each 512-bit block (uint32).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions
from .tokens import encoder

MAGIC = b"TWDAC1\0\0"
BLOCK = 512
SEGMENT_IDS = 1 << 20


def _bits(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed bitmap and the number of set bits before each block."""
    whole = np.zeros(-(-len(flags) // BLOCK) * BLOCK, dtype=np.uint8)
    whole[: len(flags)] = flags
    ones = whole.reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    return np.packbits(whole, bitorder="little"), (np.cumsum(ones) - ones).astype("<u4")


def write_segment(doc_ids: Sequence[int | None], ids: Sequence[np.ndarray]) -> bytes:
    """A segment's bytes from its documents' ids."""
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    values = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.uint32)
    levels, rest = [], values
    while len(rest) or not levels:
        more = rest > 255
        bitmap, ranks = _bits(more)
        levels += [struct.pack("<Q", len(rest)), rest.astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
    head = struct.pack("<8sQQQ", MAGIC, len(keys), len(values), len(levels) // 4)
    lengths = np.array([len(x) for x in ids], dtype="<u4")
    return b"".join([head, keys.tobytes(), np.packbits(null, bitorder="little").tobytes(), lengths.tobytes(), *levels])


class Segment:
    """A segment's bytes, addressed where they lie."""

    def __init__(self, raw: bytes):
        magic, docs, self.size, n = struct.unpack_from("<8sQQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = 32

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += found.nbytes
            return found

        keys = take("<i8", docs)
        null = np.unpackbits(take("u1", -(-docs // 8)), count=docs, bitorder="little")
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), null.tolist())]
        self.ends = np.cumsum(take("<u4", docs), dtype=np.int64)
        self.levels = []
        for _ in range(n):
            count = int(take("<u8", 1)[0])
            blocks = -(-count // BLOCK)
            self.levels.append((take("u1", count), take("u1", blocks * BLOCK // 8), take("<u4", blocks)))

    def get(self, i: int) -> int:
        """The id at place i: one chunk, bit and rank per level, nothing else is decoded."""
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            part = bitmap[block * BLOCK // 8 : (i >> 3) + 1].copy()
            part[-1] &= (1 << (i & 7)) - 1
            i = int(ranks[block]) + int(np.bitwise_count(part).sum())
            shift += 8
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level from the highest."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            own[np.flatnonzero(np.unpackbits(bitmap, count=len(own), bitorder="little"))] |= values << np.uint32(8)
            values = own
        return values


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", segment_ids: int = SEGMENT_IDS
) -> None:
    """Encode every text, append ``end_id`` and write segments in ascending order of the key to ``path``.

    Null texts are empty; null keys come first; rows that repeat a key are
    ordered by a hash of their text. An empty table gives a table without
    segments. Other columns are not used.
    """
    own = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    own = own.withColumn("tie", F.xxhash64("text"))
    ordered = own.repartitionByRange(partitions(docs.sparkSession), "key", "tie").sortWithinPartitions("key", "tie", "text")

    def written(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, before, end = encoder(tokenizer), 0, np.array([end_id], dtype=np.uint32)
        for part in parts:
            keys = [None if k is None else int(k) for k in part["key"]]
            ids = [np.r_[x, end] for x in tokens.encode(part["text"].tolist())]
            total = np.cumsum([len(x) for x in ids])
            cuts = np.flatnonzero(np.diff(total // segment_ids)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                n = sum(map(len, ids[a:b]))
                row = {"part": TaskContext.get().partitionId(), "before": before, "n_ids": n}
                yield pd.DataFrame([row | {"segment": write_segment(keys[a:b], ids[a:b])}])
                before += n

    # keys pass through Python as text: pandas turns numbers beside a null into doubles
    digits = F.col("key").cast("string").alias("key")
    ordered.select(digits, "text").mapInPandas(written, "part int, before long, n_ids long, segment binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) of every document in the files; ids are little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Only one number for
    each task that wrote passes through the driver.
    """
    segments = spark.read.schema("part int, before long, n_ids long, segment binary").parquet(path)
    first, starts = 0, []
    for part, n in sorted(map(tuple, segments.groupBy("part").agg(F.sum("n_ids")).collect())):
        starts.append((part, first))
        first += n
    bases = F.broadcast(spark.createDataFrame(starts, "part int, base long"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for base, before, raw in zip(part["base"], part["before"], part["segment"]):
                segment = Segment(raw)
                ids = segment.all().astype("<u4")
                begins = np.r_[0, segment.ends[:-1]]
                yield pd.DataFrame(
                    {
                        "key": pd.array(segment.doc_ids, dtype="Int64"),
                        "start": base + before + begins,
                        "ids": [ids[a:b].tobytes() for a, b in zip(begins.tolist(), segment.ends.tolist())],
                    }
                )

    return (
        segments.join(bases, "part")
        .select("base", "before", "segment")
        .mapInPandas(read, "key long, start long, ids binary")
    )
