"""Toxicity: a classifier regularised by counterfactuals.

Features of a text are its words and their beginnings (present or not, over the whole text). The
classifier is a sparse logistic regression, fitted on a bounded sample of labelled rows
(``SAMPLE`` of each label). In every sampled text identity terms are swapped for others of their
group, and the square of the change this makes to the score's log odds is added to the loss: a
term that names a group cannot carry the verdict, so neutral mentions of it are not taken for toxic.

Only the sampled texts' features reach the driver; the model is broadcast, at most ``MOST_FEATURES`` weights.

Defined results: a null or empty text has no feature and gets the base score; without both labels every text gets the
share of label 1, or 0; repeated rows are scored each; other columns stay, and give way to an added
column of the same name.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import add_columns
from .samples import fold, sampled

SAMPLE = 2_500
MOST_FEATURES = 20_000
#: Sampled texts that must hold a feature.
LEAST_TEXTS = 3
#: The least chi-square of a feature against the label: what less than one in a million reaches by chance.
LEAST_UNUSUAL = 25.0
BEGINNINGS = (4, 5, 6)
#: Weights of the absolute values, and of the counterfactual term; steps of the fit.
SPARSITY, COUNTERFACTUAL, STEPS = 1e-5, 5.0, 1500
#: Swapped versions of a text.
SWAPS = 2
#: Words remembered per worker.
REMEMBERED = 1 << 17

# Identity terms by group; the terms of a group are swapped for each other.
IDENTITY_GROUPS = (
    "woman man", "women men", "female male", "girl boy", "girls boys", "mother father", "wife husband",
    "gay straight lesbian bisexual heterosexual homosexual queer", "trans transgender cisgender",
    "black white asian latino hispanic african european arab indigenous",
    "christian muslim jewish hindu buddhist sikh catholic protestant atheist",
    "christians muslims jews hindus buddhists sikhs catholics protestants atheists",
    "immigrant refugee foreigner citizen native", "immigrants refugees foreigners citizens natives",
    "deaf blind disabled autistic", "old young elderly teenage",
    "american mexican chinese indian french german spanish russian turkish nigerian",
)
_SWAP = {
    term: [group.split()[(i + k) % len(group.split())] for k in range(1, len(group.split()))]
    for group in IDENTITY_GROUPS
    for i, term in enumerate(group.split())
}
_WORD = re.compile(r"\w+")


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    parts = [f"{word} ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(p.encode()) for p in parts]


def features(words: set[str]) -> np.ndarray:
    """Sorted hashes of all features of a text."""
    return np.array(sorted({f for w in words for f in features_of(w)}), np.uint32)


def swapped(words: set[str], swaps: int = SWAPS) -> list[set[str]]:
    """The words with every identity term swapped, in up to ``swaps`` ways; none without such a term."""
    terms = words & _SWAP.keys()
    if not terms:
        return []
    return [
        (words - terms) | {_SWAP[t][k % len(_SWAP[t])] for t in terms} for k in range(swaps)
    ]


def _design(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, feature places) of the entries of a 0/1 matrix; ``names`` are sorted."""
    if not rows or not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found = np.concatenate(rows)
    places = np.minimum(np.searchsorted(names, found), len(names) - 1)
    known = names[places] == found
    return numbers[known], places[known]


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -20.0

    def scorer(self):
        """A function of a text; words met before are remembered."""
        known: dict[str, tuple] = {}
        weights, bias = self.weights, self.bias

        def score(text: str | None) -> tuple[float, int]:
            hits = set()
            for word in words_in(text):
                found = known.get(word)
                if found is None:
                    found = tuple(f for f in features_of(word) if f in weights)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(word) < 64:
                        known[word] = found
                hits.update(found)
            odds = bias + sum(weights[f] for f in sorted(hits))
            value = float(1 / (1 + np.exp(-max(-40.0, min(40.0, odds)))))
            return value, int(value >= 0.5)

        return score


def fit(
    texts: list[np.ndarray], labels: list, swaps: list, share: float | None = None, counterfactual: float = COUNTERFACTUAL
) -> Model:
    """A model of feature arrays, labels, and (text number, feature array) of swapped texts.

    ``share`` is the share of label 1 that the bias is set for, the sample's if None.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        given = share if share is not None else (float(y.mean()) if len(y) else 0.0)
        return Model({}, float(np.log(max(given, 1e-9) / max(1 - given, 1e-9))))
    found, texts_with = np.unique(np.concatenate(texts), return_counts=True)
    toxic, times = np.unique(np.concatenate([t for t, label in zip(texts, labels) if label]), return_counts=True)
    hits = np.zeros(len(found))
    hits[np.searchsorted(found, toxic)] = times
    ones = y.sum()
    expected = texts_with * (ones / len(y))
    unusual = (hits - expected) ** 2 / np.maximum(expected * (1 - ones / len(y)), 1e-9)
    unusual[texts_with < LEAST_TEXTS] = -1
    usual = np.lexsort((found, -unusual))[:MOST_FEATURES]
    names = np.sort(found[usual[unusual[usual] >= LEAST_UNUSUAL]])
    m, n = len(names), len(y)
    rows, columns = _design(texts, names)
    # the change of the log odds under a swap: the text's features less those of its swapped version
    changed = [(i, s) for i, s in swaps]
    a_rows, a_columns = _design([texts[i] for i, _ in changed], names)
    b_rows, b_columns = _design([s for _, s in changed], names)
    w, bias = np.zeros(m), 0.0
    ahead, ahead_bias, t = w.copy(), bias, 1.0
    most = np.bincount(rows, minlength=n).max(initial=0) + 1
    more = np.bincount(a_rows, minlength=1).max() + np.bincount(b_rows, minlength=1).max()
    rate = 1.0 / (0.25 * most + (2 * counterfactual * more if changed else 0))
    share = ones / n if share is None else share
    balance = np.where(y > 0, share / ones, (1 - share) / (n - ones))
    for _ in range(STEPS):
        z = np.bincount(rows, ahead[columns], n) + ahead_bias
        error = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gradient = np.bincount(columns, error[rows], m)
        if changed and counterfactual:
            k = len(changed)
            gap = np.bincount(a_rows, ahead[a_columns], k) - np.bincount(b_rows, ahead[b_columns], k)
            pull = 2 * counterfactual * gap / k
            gradient = gradient + np.bincount(a_columns, pull[a_rows], m)
            gradient = gradient - np.bincount(b_columns, pull[b_rows], m)
        new = ahead - rate * gradient
        new = np.sign(new) * np.maximum(0.0, np.abs(new) - rate * SPARSITY)
        new_bias = ahead_bias - rate * error.sum()
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    return Model({int(f): float(v) for f, v in zip(names, w) if v}, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic",
    per_label: int = SAMPLE, counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """A model from a bounded sample of the labelled rows of ``labels`` that ``docs`` holds."""
    given = labels.select(
        F.col(f"`{id_col}`").alias("id"), (F.col(f"`{label}`") > 0).cast("int").alias("toxic")
    ).where("id is not null and toxic is not null")
    some, counts = sampled(given, "toxic", "id", per_label)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = texts.join(F.broadcast(some), "id")  # bounded: about 2 * per_label rows

    def start():
        def numbers(value: str | None) -> tuple:
            words = words_in(value)
            return features(words).tobytes(), [features(s).tobytes() for s in swapped(words)]

        return numbers

    # hashes travel and stay as bytes, four for each feature
    added = T.StructType(
        [T.StructField("own", T.BinaryType()), T.StructField("swaps", T.ArrayType(T.BinaryType()))]
    )
    rows = add_columns(joined, ["text"], added, start, ["id", "toxic"]).collect()
    rows = sorted(rows, key=lambda r: (str(r.id), r.toxic, bytes(r.own)))
    swaps = [(i, np.frombuffer(s, np.uint32)) for i, r in enumerate(rows) for s in r.swaps]
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    own = [np.frombuffer(r.own, np.uint32) for r in rows]
    return fit(own, [r.toxic for r in rows], swaps, share, counterfactual)


def score(
    docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
    names: tuple[str, str] = ("score", "predicted"),
) -> DataFrame:
    """``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) beside the columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return add_columns(docs, [text], added, lambda: shared.value.scorer(), keep)


#: The fold that is held out, and of how many.
HELD_OUT, FOLDS = 0, 5


def held_out(df: DataFrame, id_col: str = "doc_id"):
    return F.coalesce(fold(df[f"`{id_col}`"], FOLDS) == HELD_OUT, F.lit(False))
