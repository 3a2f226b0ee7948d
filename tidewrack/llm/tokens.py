"""Encoding whole texts with a public tokenizer file, by cached words.

Most of a corpus is words seen before. A text is cut where the file's own
pre-tokenizer cuts it, and the ids of each piece come from a bounded cache;
pieces not in it are encoded by the tokenizers library, many at a time. Texts
with characters beyond Latin letters and common signs, or with what may be a
special token, are encoded whole by the library.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

#: Words of each of the two generations of the cache, and their characters.
CACHE_WORDS = 200_000
CACHE_CHARS = 12_000_000
PART_CHARS = 1_000_000
# The pre-tokenizer patterns of the two kinds of files, over the characters of plain texts.
_L, _N, _S = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "0-9", r"\t-\r "
_SIGNS = "¡¿«»§°·×–—‘’“”…€"
PLAIN = re.compile(rf"[\x00-\x7f{_L}{_SIGNS}]*")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(rf" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BARE = re.compile(rf"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_S}{_L}{_N}]+")
JOINED = 256


class Encoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.cache_words, self.chars = cache_words, 0
        tokens = self.tokenizer.get_vocab()
        #: Files that lower-case and drop white space mark word ends; the others keep the blank before a word.
        self.bare = any(t.endswith("</w>") for t in tokens)
        self.cut = _BARE if self.bare else SPACED
        self.edge = np.zeros(max(tokens.values()) + 1, dtype=bool)
        for t, i in tokens.items():
            self.edge[i] = t.endswith("</w>") if self.bare else t.startswith("Ġ")

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]

    def _learn(self, pieces: list[str]) -> None:
        """Put pieces in the cache; words are encoded joined, and told apart by the tokens at their edges."""
        words = [p for p in pieces if p.isalpha()] if self.bare else [p for p in pieces if p[1:].isalpha() and p[0] == " "]
        known = set(words)
        for p, ids in zip(rest := [p for p in pieces if p not in known], self._encode(rest)):
            self.cache[p] = ids.tobytes()
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for own, ids in zip(groups, self._encode([(" " if self.bare else "").join(g) for g in groups])):
            at = np.flatnonzero(self.edge[ids])
            ends = (at + 1 if self.bare else np.r_[at[1:], len(ids)]) * 4
            raw, begin = ids.tobytes(), 0
            for p, end in zip(own, ends.tolist(), strict=True):
                self.cache[p] = raw[begin:end]
                begin = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), without any end id; some texts at a time, so that few are held in pieces."""
        out, part, chars = [], [], 0
        for x in texts:
            part.append(x or "")
            chars += len(part[-1])
            if chars > PART_CHARS:
                out += self._encode_part(part)
                part, chars = [], 0
        return out + self._encode_part(part)

    def _encode_part(self, texts: list[str]) -> list[np.ndarray]:
        pieces: list[list[str] | None] = []
        for x in texts:
            plain = "<|" not in x and (x.isascii() or PLAIN.fullmatch(x))
            pieces.append(self.cut.findall(x.lower() if self.bare else x) if plain else None)
        # words that were not asked for during a whole generation are forgotten
        if len(self.cache) > self.cache_words or self.chars > CACHE_CHARS:
            self.before, self.cache, self.chars = self.cache, {}, 0
        missing = {p for own in pieces if own for p in own}.difference(self.cache)
        self.chars += sum(map(len, missing))
        kept = missing.intersection(self.before)
        self.cache.update((p, self.before[p]) for p in kept)
        self._learn(list(missing.difference(kept)))
        get, out = self.cache.__getitem__, []
        for x, own in zip(texts, pieces):
            out.append(self._encode([x])[0] if own is None else np.frombuffer(b"".join(map(get, own)), dtype="<u4"))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; kept between batches and tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Give back the memory of earlier stages' encoders, in a worker that Spark uses again for other work."""
    if _encoders:
        _encoders.clear()
        gc.collect()
