"""Language identification by a string kernel.

The kernel of two texts is the blended spectrum kernel on presence: the number
of byte n-grams (lengths 1 to 4) both contain, over the geometric mean of
their own numbers. A Nyström map to a bounded set of landmark texts makes it
finite, and one-versus-rest kernel ridge regression learns the languages.
Grams outside the landmarks' own cannot add to a kernel value with a landmark,
so texts are held as presence vectors over the landmarks' grams, and a batch
is scored by matrix products: presence x landmarks x coefficients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample
from .tokens import forget

SIZES = (1, 2, 3, 4)
UNKNOWN = "und"
HASH_BITS = 22
SHARPNESS = 8.0
_letter = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return text is not None and _letter.search(text) is not None


def gram_codes(text: str) -> np.ndarray:
    """Codes of all byte n-grams of the lower-cased whole text, all lengths one after another."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    codes = []
    for n in SIZES:
        if len(b) < n:
            break
        g = np.full(len(b) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            g = g * np.uint32(0x01000193) ^ b[i : len(b) - n + 1 + i]
        codes.append((g * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(codes) if codes else np.zeros(0, np.uint32)


@dataclass
class Model:
    """``coefficients``: vocabulary x languages, the product of landmarks, Nyström map and ridge weights."""

    languages: list[str]
    vocabulary: np.ndarray
    coefficients: np.ndarray

    def slots(self) -> np.ndarray:
        """Gram code -> place in the vocabulary, its length for grams that no landmark has."""
        found = np.full(1 << HASH_BITS, len(self.vocabulary), dtype=np.int32)
        found[self.vocabulary] = np.arange(len(self.vocabulary))
        return found

    def scores(self, texts: Sequence[str], slots: np.ndarray, batch: int = 64) -> np.ndarray:
        """One row per text: the share of each language, from the regression values."""
        shares = np.zeros((len(texts), len(self.languages)))
        for i in range(0, len(texts), batch):
            raw = SHARPNESS * (presence(texts[i : i + batch], slots, len(self.vocabulary)) @ self.coefficients)
            e = np.exp(raw - raw.max(axis=1, keepdims=True))
            shares[i : i + batch] = e / e.sum(axis=1, keepdims=True)
        return shares


def presence(texts: Sequence[str], slots: np.ndarray, size: int) -> np.ndarray:
    """Rows of presence over the vocabulary, each scaled to length one."""
    x = np.zeros((len(texts), size + 1), dtype=np.float32)
    for row, text in zip(x, texts):
        row[slots[gram_codes(text)]] = 1
    x = x[:, :size]
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def fit(texts: Sequence[str], languages: Sequence[str], landmarks: int = 240, ridge: float = 1e-2) -> Model:
    """Learn from labelled texts; the first ``landmarks`` of them, languages in turn, are the landmarks."""
    names = sorted(set(languages))
    by = {n: [i for i, x in enumerate(languages) if x == n] for n in names}
    turn = [q[k] for k in range(max(map(len, by.values()), default=0)) for q in by.values() if k < len(q)]
    chosen = [texts[i] for i in turn[:landmarks]]
    if not chosen:
        return Model([], np.zeros(0, np.uint32), np.zeros((0, 0)))
    vocabulary = np.unique(np.concatenate([np.unique(gram_codes(x)) for x in chosen]))
    model = Model(names, vocabulary, np.zeros((0, 0)))
    slots = model.slots()
    marks = presence(chosen, slots, len(vocabulary)).T
    value, vector = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = value > 1e-5 * value.max()
    nystroem = vector[:, keep] / np.sqrt(value[keep])
    k = [presence(texts[i : i + 64], slots, len(vocabulary)) @ marks for i in range(0, len(texts), 64)]
    z = np.concatenate(k).astype(np.float64) @ nystroem
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in languages])
    # languages weigh the same, however many examples each has
    cost = np.array([1 / (len(names) * len(by[x])) for x in languages])[:, None]
    w = np.linalg.solve(z.T @ (cost * z) + ridge / len(texts) * np.eye(z.shape[1]), z.T @ (cost * y))
    model.coefficients = (marks @ (nystroem @ w)).astype(np.float32)
    return model


def training_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 3000
) -> DataFrame:
    """At most ``rows`` labelled texts, chosen by the hash of their keys (a bounded, documented sample)."""
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    return bounded_sample(own.filter("text is not null and lang is not null"), rows, "key").select("text", "lang")


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", landmarks: int = 240, ridge: float = 1e-2) -> Model:
    """Fit on a bounded table of labelled texts, which is read to the driver."""
    found = labelled.select(f"`{text}`", f"`{lang}`").collect()
    rows = list(dict.fromkeys((r[0], r[1]) for r in found if r[1] is not None and has_letter(r[0])))
    return fit([r[0] for r in rows], [r[1] for r in rows], landmarks, ridge)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``lang_score`` (0 to 1) added, replaced if they were there.

    Texts that are null or have no letter are ``und`` with score 0, and so is
    everything if nothing was learned. Repeated rows stay repeated, an empty
    table stays empty; whole texts are read, in batches of bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        own = shared.value
        slots = own.slots()
        for texts in parts:
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [i for i, x in enumerate(texts) if own.languages and has_letter(x)]
            values = own.scores([texts.iloc[i] for i in at], slots)
            for i, row in zip(at, values):
                best = int(row.argmax())
                lang[i], score[i] = own.languages[best], float(row[best])
            yield pd.DataFrame({"lang": lang, "score": score})

    # Spark may move a filter on the result below it and predict twice; it does not for what it takes as not repeatable
    predicted = predicted.asNondeterministic()
    # the row goes beside, so that no name of its columns can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), predicted(F.col(f"`{text}`")).alias("found"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")]
    return rows.select(*kept, F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("lang_score"))
