"""Byte-level BPE as a finite-state transducer, and decoding as a stream.

The merges of a rank file are compiled, state by state as texts ask for them,
into a deterministic transducer over bytes. It rests on two facts. The
encoding of a prefix of a piece is the encoding of a shorter prefix and one
more token; and a list of tokens is an encoding if each two neighbours are the
encoding of their joined bytes. A state is what can still matter of all
prefixes so far: the places where an unfinished token may begin (the
lookahead, never longer than the longest token) and the token that ends at
each. The edge for a byte writes the last token of the prefix it completes.
These tokens lead back from any place to the one before it; where the ways
back from all open places meet, tokens are certain and are emitted. A piece
takes one table step a byte, however long it is.

States are dropped when there are too many and built again when asked for, as
lazily determinised automata do.

Decoding feeds the bytes of the ids, chunk by chunk, to a state machine for
UTF-8 that holds back at most the three bytes of an unfinished character.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PLAIN, SPACED, forget

# Fixed value: the pattern that `tokens.SPACED` cuts plain texts by, which takes half the time there.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Bounds of what a Python worker keeps: states with their edges, results for pieces (twice as many), pairs of tokens.
STATES = 250_000
PIECES = 220_000
PAIRS = 150_000
#: Longer pieces are not kept.
PIECE_CHARS = 64
CHUNK = 1 << 16
ROWS = 500
START = -1
SETTLED = -2


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of lines with base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Bytes of a piece after which certain tokens are emitted.
SETTLE = 4096
#: What a state knows of a place: bytes since then, and the token that ends there.
Place = tuple[int, int]


class Transducer:
    """Bytes of one piece to token ranks, as the merges of lowest rank first would give them."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.open = {token[:i] for token in ranks for i in range(1, len(token))}
        #: Tokens that their own merges do not build: they stand for a whole piece only.
        self.odd = {t for t in ranks if len(t) > 1 and self.merged(t) != [ranks[t]]}
        self.bound = states
        self.reset()

    def reset(self) -> None:
        """Drop all states but the first."""
        self.number: dict[tuple[bytes, tuple[Place, ...]], int] = {}
        self.states: list[tuple[bytes, tuple[Place, ...]]] = []
        self.edges: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._state(b"", ((0, START),))

    def merged(self, data: bytes) -> list[int]:
        """The ranks of some bytes by joining the neighbours of lowest rank; for pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _meets(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if a == START:
            return True
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def _state(self, window: bytes, places: tuple[Place, ...]) -> int:
        """The number of a state."""
        key = (window, places)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """The edge of a state for a byte, built and kept: the next state, and the token that ends there."""
        window, places = self.states[state]
        window += bytes((byte,))
        end, last, open_places = len(window), None, []
        for back, token in places:
            joined = window[end - back - 1 :]
            if last is None and joined in self.ranks and joined not in self.odd and self._meets(token, self.ranks[joined]):
                last = self.ranks[joined]
            if joined in self.open:
                open_places.append((back + 1, token))
        if last is None:
            raise ValueError(f"no token for byte {byte}: a rank file has to hold all single bytes")
        open_places.append((0, last))
        target = self._state(window[end - open_places[0][0] :], tuple(open_places))
        edge = self.edges[state << 8 | byte] = (target, last)
        return edge

    def _way(self, last: list[int], at: int) -> list[int]:
        """Places after the first up to ``at``, each the end of a token; ``last`` has the last token at each place."""
        way, length = [], self.length
        while at:
            way.append(at)
            at -= length[last[at - 1]]
        way.reverse()
        return way

    def _settled(self, state: int, last: list[int]) -> tuple[list[int], list[int]]:
        """Tokens that are certain in a state, and the last tokens at the places after them."""
        n = len(last)
        ways = [self._way(last, n - back) for back, _ in self.states[state][1]]
        shared = 0
        while all(len(w) > shared and w[shared] == ways[0][shared] for w in ways):
            shared += 1
        return [last[at - 1] for at in ways[0][:shared]], last[ways[0][shared - 1] if shared else 0 :]

    def encode(self, piece: bytes) -> list[int]:
        """Ranks of a piece."""
        if piece in self.odd:
            return [self.ranks[piece]]
        state, last, out, edges = 0, [], [], self.edges
        for byte in piece:
            edge = edges.get(state << 8 | byte)
            if edge is None:
                if len(self.states) > self.bound:
                    kept = self.states[state]
                    self.reset()
                    state, edges = self._state(*kept), self.edges
                edge = self._step(state, byte)
            state, token = edge
            last.append(token)
            if len(last) > SETTLE:
                certain, last = self._settled(state, last)
                out += certain
        out += [last[at - 1] for at in self._way(last, len(last))]
        return out


class Encoder:
    """Texts to token ranks: pieces by a pattern, each by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = STATES):
        import regex

        self.transducer = Transducer(ranks, states)
        self.pieces = regex.compile(pattern)
        self.plain = SPACED if pattern == SPACED_PATTERN else None
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, kept with those of the latest other pieces."""
        own = self.before.get(piece)
        if own is None:
            own = array("I", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self.known) >= PIECES:
                self.before, self.known = self.known, {}
            self.known[piece] = own
        return own

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: none) as native unsigned 32-bit integers; few pieces are held at a time."""
        found, parts, known, text = [], [], self.known.get, text or ""
        cut = self.plain if self.plain and (text.isascii() or PLAIN.fullmatch(text)) else self.pieces
        for match in cut.finditer(text):
            piece = match.group()
            own = known(piece)
            if own is None:
                own = self._piece(piece)
                known = self.known.get
            parts.append(own)
            if len(parts) > CHUNK:
                found.append(b"".join(parts))
                parts = []
        return b"".join([*found, *parts])


# State machine for UTF-8: the byte range each state takes next and the state it leads to; 0 is between characters.
_NEXT = {
    1: (0x80, 0xBF, 0),
    2: (0x80, 0xBF, 1),
    3: (0x80, 0xBF, 2),
    4: (0xA0, 0xBF, 1),
    5: (0x80, 0x9F, 1),
    6: (0x90, 0xBF, 2),
    7: (0x80, 0x8F, 2),
}
_runs = re.compile(rb"[\x00-\x7f]+|[\x80-\xff]+")


def _lead(byte: int) -> int | None:
    """The state after a first byte that is not ASCII; none if no character begins so."""
    if 0xC2 <= byte <= 0xDF:
        return 1
    if 0xE0 <= byte <= 0xEF:
        return {0xE0: 4, 0xED: 5}.get(byte, 2)
    return {0xF0: 6, 0xF4: 7}.get(byte, 3) if 0xF0 <= byte <= 0xF4 else None


class Utf8Stream:
    """Text from bytes that come in any chunks; each broken sequence gives one replacement character."""

    def __init__(self) -> None:
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        """The characters that are complete by now."""
        out: list[str] = []
        for run in _runs.finditer(data):
            part = run.group()
            if part[0] < 0x80:
                out += [self.end(), part.decode("ascii")]
                continue
            whole, held, state = bytearray(), self.held, self.state
            for byte in part:
                if state:
                    low, high, after = _NEXT[state]
                    if low <= byte <= high:
                        held.append(byte)
                        state = after
                        if not state:
                            whole += held
                            held.clear()
                        continue
                    whole += b"\xef\xbf\xbd"
                    held.clear()
                    state = 0
                lead = _lead(byte)
                if lead is None:
                    whole += b"\xef\xbf\xbd"
                else:
                    held.append(byte)
                    state = lead
            self.state = state
            out.append(whole.decode("utf-8"))
        return "".join(out)

    def end(self) -> str:
        """What is left of an unfinished character."""
        broken = "�" if self.held else ""
        self.state = 0
        self.held.clear()
        return broken


def decode(ids: bytes, token: Callable[[int], bytes]) -> Iterator[str]:
    """Text of ids in unsigned 32-bit integers, part by part as characters become complete."""
    stream, own = Utf8Stream(), np.frombuffer(ids, dtype=np.uint32)
    for i in range(0, len(own), CHUNK):
        yield stream.feed(b"".join(map(token, own[i : i + CHUNK].tolist())))
    yield stream.end()


def _little(ids: bytes) -> bytes:
    """Native unsigned 32-bit integers to little-endian ones, and back."""
    return ids if sys.byteorder == "little" else np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes()


@lru_cache(1)
def _encoder(path: str, pattern: str) -> Encoder:
    """The worker's transducer for a file; its tables are bounded."""
    return Encoder(read_ranks(path), pattern)


@lru_cache(1)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def encoded(
    docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", decoded_into: str | None = None
) -> DataFrame:
    """Every row with its text's token ids added as bytes (little-endian unsigned 32-bit), replaced if there.

    Each match of ``pattern`` is encoded by itself by the ranks in the file
    ``path``, without special tokens. Null and empty texts have no ids.
    ``decoded_into`` names a further column for what the ids decode to, which
    saves a second pass. Repeated rows stay repeated, an empty table stays
    empty, and other columns pass as the Arrow arrays they are. A batch is
    worked on `ROWS` rows at a time.
    """
    both = decoded_into is not None
    names = [into, decoded_into] if both else [into]
    rows = docs.drop(*names).withColumns(dict.fromkeys(names, F.lit(None).cast("binary")))
    rows = rows.withColumns({decoded_into: F.lit(None).cast("string")}) if both else rows
    kept = [c for c in docs.columns if c not in names]
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("\0text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        encoder = _encoder(path, pattern)
        token = encoder.transducer.token.__getitem__
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [encoder.encode(x) for x in part.column(len(kept)).to_pylist()]
                columns = [*part.columns[: len(kept)], pa.array(map(_little, ids), pa.binary())]
                if both:
                    columns.append(pa.array(("".join(decode(x, token)) for x in ids), pa.string()))
                yield pa.record_batch(columns, names=[*kept, *names])

    return own.mapInArrow(coded, rows.select(*[F.col(f"`{c}`") for c in [*kept, *names]]).schema)


def decoded(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Every row with the text of its token ids added, replaced if there.

    Ids are read in chunks; bytes that are no UTF-8 become U+FFFD, one for
    each broken sequence. Null ids give an empty text; an id that the file
    does not have, or bytes that are no whole ids, are an error.
    """

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = _tokens(path).__getitem__
        for rows in parts:
            yield pd.Series(["".join(decode(_little(raw or b""), token)) for raw in rows], dtype=object)

    return docs.withColumn(into, texts(F.col(f"`{ids}`")))
