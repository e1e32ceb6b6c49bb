"""Language identification: the family first, then one-versus-one linear machines within it.

A text is a vector of hashed character pairs and triples of its letters, over the whole text, in blocks. A first
set of one-versus-one linear support vector machines decides the family, a second one the language
among the learned languages of that family. All machines minimise the squared hinge loss; they
are fitted on the driver on a bounded sample (``SAMPLE`` texts of each language, as vectors of ``DIMENSIONS``
numbers) and broadcast as one matrix of ``DIMENSIONS`` x number of machines.

Families are fixed values of general knowledge; a learned language that is not listed is a family of its own.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be
learned. Only one learned language is always predicted. Repeated rows are judged each; other columns stay, and give
way to an added column of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns
from .samples import fold, sampled

DIMENSIONS = 4096
SAMPLE = 400
BLOCK = 1 << 20
UNDETERMINED = "und"
#: Weight of the squared length of a machine's normal, and steps of the fit.
RIDGE, STEPS = 1e-4, 150
#: Margins are turned into scores by the logistic function at this slope.
SLOPE = 4.0

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy br gd",
    "indic": "hi ur bn mr gu pa ne si",
    "turkic": "tr az kk ky uz tk",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Square roots of the shares of hashed pairs and triples, of length 1; None without a letter."""
    counts, found, carry = np.zeros(dimensions), False, np.zeros(0, np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "replace"), "<u4")
        letter = _letters()[codes]
        found |= bool(letter.any())
        codes = np.concatenate([carry, np.where(letter, codes, 32).astype(np.uint32)])
        carry = codes[-2:]
        if len(codes) < 3:
            continue
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        pair = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)
        triple = (pair ^ (pair >> np.uint32(15))) * np.uint32(0xC2B2AE35) + c * np.uint32(0x27D4EB2F)
        words = (a != 32) | (b != 32)
        for grams, kept in ((pair, words), (triple, words & (b != 32))):
            grams = grams ^ (grams >> np.uint32(13))
            grams = (grams * np.uint32(0x5BD1E995)) >> np.uint32(16)
            counts += np.bincount(grams[kept] % np.uint32(dimensions), minlength=dimensions)
    if not found:
        return None
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def fit_machine(x: np.ndarray, positive: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Weights of a linear machine (the last one is the bias): squared hinge loss, accelerated descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y = np.where(positive, 1.0, -1.0).astype(x.dtype)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(x.dtype)
    rate = 1.0 / (2 * 2.0 + 2 * ridge)  # rows have length 1, and 1 for the bias
    w = np.zeros(x.shape[1], x.dtype)  # the sample's own precision, so that it is never copied
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ ahead))
        gradient = -2 * (x.T @ (share * y * short)) + 2 * ridge * ahead
        new, t_new = ahead - rate * gradient, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = (new + (t - 1) / t_new * (new - w)).astype(x.dtype), new, t_new
    return w.astype(np.float64)


@dataclass
class Model:
    """Machines as columns of one matrix, and what they separate."""

    families: list[str]
    languages: dict[str, list[str]]
    machines: list[tuple[str, str]]  # (the positive one, the other): of two families or two languages
    weights: np.ndarray

    def _winner(self, names: list[str], margins: dict) -> tuple[str, float]:
        """By votes, then by the sum of margins, then by name; with its least margin."""
        if len(names) == 1:
            return names[0], float("inf")

        def against(a: str) -> list[float]:
            return [margins[a, b] if (a, b) in margins else -margins[b, a] for b in names if b != a]

        best = min(names, key=lambda a: (-sum(m > 0 for m in against(a)), -sum(against(a)), a))
        return best, min(against(best))

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text) if text and self.families else None
        if x is None:
            return UNDETERMINED, 0.0
        some = np.flatnonzero(x)
        values = x[some] @ self.weights[some] + self.weights[-1]
        margins = dict(zip(self.machines, values.tolist()))
        family, sure = self._winner(self.families, margins)
        language, also = self._winner(self.languages[family], margins)
        return language, float(1 / (1 + np.exp(-SLOPE * max(-20.0, min(sure, also, 20.0)))))


def fit(x: np.ndarray, languages: list[str]) -> Model:
    """Machines between families, and between the languages of each family."""
    family = np.array([f"family {FAMILY_OF.get(code, code)}" for code in languages])
    codes = np.array(languages)
    families = sorted(set(family.tolist()))
    members = {f: sorted(set(codes[family == f].tolist())) for f in families}
    machines, weights = [], []
    for names, labels in [(families, family), *((m, codes) for m in members.values())]:
        for a, b in combinations(names, 2):
            rows = (labels == a) | (labels == b)
            machines.append((a, b))
            weights.append(fit_machine(x[rows], labels[rows] == a))
    matrix = np.array(weights).T if weights else np.zeros((x.shape[1] + 1 if len(x) else 1, 0))
    return Model(families, members, machines, matrix)


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE
) -> Model:
    """A model from a bounded sample of the rows that have a language and a text with letters."""
    given = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")
    ).where("lang is not null and text is not null and id is not null")
    some, _ = sampled(given, "lang", "id", per_language)

    def start():
        def numbers(value: str) -> tuple:
            x = vector(value)
            if x is None:
                return None, None
            kept = np.flatnonzero(x)
            return kept.astype(np.uint16).tobytes(), x[kept].astype(np.float32).tobytes()

        return numbers

    added = T.StructType(
        [
            T.StructField("places", T.BinaryType()),
            T.StructField("shares", T.BinaryType()),
        ]
    )
    rows = add_columns(some, ["text"], added, start, ["id", "lang"]).where("places is not null")
    rows = sorted(rows.collect(), key=lambda r: (str(r.id), r.lang))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, row in enumerate(rows):
        x[i, np.frombuffer(row.places, np.uint16)] = np.frombuffer(row.shares, np.float32)
    return fit(x, [r.lang for r in rows])


def identify(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return add_columns(docs, [text], added, lambda: shared.value.predict, keep)


#: The fold that is held out, and of how many.
HELD_OUT, FOLDS = 2, 4


def held_out(df: DataFrame, id_col: str = "doc_id"):
    return F.coalesce(fold(df[f"`{id_col}`"], FOLDS) == HELD_OUT, F.lit(False))
