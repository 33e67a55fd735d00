"""Toxicity classifier with counterfactual regularisation.

Features are presences of words and of word beginnings in a document. The features are
picked from a bounded labelled sample by how differently the classes use them. A
logistic model is fitted on them with one more penalty: for every labelled text that
names a group of people, a copy with the identity terms swapped for others of the same
kind is made, and another with a neutral word in their place; the squared change of the score
(log-odds) between text and copies is added to the loss. The model thus learns that
naming a group is not toxic as such, whichever group it is.
Identity terms are always among the features, so that the penalty reaches them.

Nulls, empties: a null text counts as empty and gets the score of a text without any
feature. Without labels of both classes every score is the share of label 1 (0.5
without any label). Repeated rows and ties score alike; extra columns pass through
``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty
from .learning import labelled_sample, sigmoid

#: Identity terms by kind; a term is swapped for another one of its kind and language.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("she", "he"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"),
    ("old", "young"), ("elderly", "youth"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("frau", "mann"), ("juden", "christen", "muslime"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("femme", "homme"), ("juifs", "chrétiens", "musulmans"), ("étrangers", "immigrés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("judíos", "cristianos", "musulmanes"), ("extranjeros", "inmigrantes"),
)
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Standard errors by which the classes must differ for a feature to be used.
LEAST_Z = 4.0
#: Words kept in a worker's memo of word -> features.
MEMO = 100_000


def word_features(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:n]}" for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def swap_identities(words: Iterable[str], kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> set[str] | None:
    """The words with every identity term replaced by the next one of its kind; None
    where there is no such term."""
    to = {t: kind[(i + 1) % len(kind)] for kind in kinds for i, t in enumerate(kind)}
    words = set(words)
    return {to.get(w, w) for w in words} if not words.isdisjoint(to) else None


def neutral_words(words: Iterable[str], kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> set[str]:
    """The words with every identity term replaced by a neutral one (which is no feature)."""
    return set(words) - {t for kind in kinds for t in kind}


@dataclass
class ToxicityModel:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray | None = None  # intercept first
    prior: float = 0.5

    def scorer(self):
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.prior)
        index, weights, memo = self.index, self.weights, {}

        def of(word: str) -> tuple[int, ...]:
            if len(memo) >= MEMO:
                memo.clear()
            got = memo[word] = tuple(index[f] for f in word_features(word) if f in index)
            return got

        def margin(text: str) -> float:
            on: set[int] = set()
            for w in words_of(text):
                got = memo.get(w)
                on.update(of(w) if got is None else got)
            return float(weights[0] + weights[[i + 1 for i in on]].sum()) if on else float(weights[0])

        return lambda texts: sigmoid(np.array([margin(t) for t in texts], dtype=float))

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a score of 0 to 1 (higher: label 1 is likelier)."""
        return docs.withColumn(name, self.column(text_or_empty(text_col)))

    def column(self, text: Column) -> Column:
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            score = model.scorer()
            for s in batches:
                yield pd.Series(score(s.tolist()))
            del score
            give_back()

        return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(text)


def _pick_features(bags: list[list[str]], y: np.ndarray, most: int, least_docs: int) -> list[str]:
    """Features whose document share differs most between the classes, in standard errors."""
    pos = Counter()
    for bag, t in zip(bags, y):
        if t:
            pos.update({f for w in bag for f in word_features(w)})
    pos = {f: n for f, n in pos.items() if n >= least_docs}
    neg = dict.fromkeys(pos, 0)
    for bag, t in zip(bags, y):
        if not t:
            for f in {f for w in bag for f in word_features(w)} & neg.keys():
                neg[f] += 1
    n1, n0 = int(y.sum()), int((1 - y).sum())
    names = sorted(pos)
    a = np.array([pos[f] for f in names], float)
    b = np.array([neg[f] for f in names], float)
    share = (a + b + 1) / (n1 + n0 + 2)
    z = (a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return [names[i] for i in np.argsort(-np.abs(z), kind="stable")[:most] if abs(z[i]) >= LEAST_Z]


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", bound: int = 6_000,
                 features: int = 2_048, least_docs: int = 3, swap_penalty: float = 1.0, l2: float = 1e-3, steps: int = 400) -> ToxicityModel:
    """Fit on at most ``bound`` labelled rows (half of them per class). A feature has to occur in
    ``least_docs`` of them; the ``features`` that tell the classes apart best are used."""
    rows = labelled_sample(docs, labels, target, bound)
    if len(rows) == 0:
        return ToxicityModel()
    y, weight = rows["y"].to_numpy(float), rows["weight"].to_numpy(float)
    prior = float((weight * y).sum() / weight.sum())
    if rows["y"].nunique() < 2:
        return ToxicityModel(prior=prior)
    # a list of words per text, each word one shared object
    shared: dict[str, str] = {}
    bags = [[shared.setdefault(w, w) for w in words_of(t)] for t in rows["text"]]
    del rows, shared
    names = _pick_features(bags, y, features, least_docs=least_docs)
    names += [f for f in (f"w:{t}" for kind in IDENTITY_TERMS for t in kind) if f not in set(names)]
    index = {f: i for i, f in enumerate(names)}

    def matrix(bags: Sequence[Iterable[str]]) -> np.ndarray:
        x = np.zeros((len(bags), len(names) + 1), np.float32)
        x[:, 0] = 1
        for i, bag in enumerate(bags):
            on = {index[f] for w in bag for f in word_features(w) if f in index}
            x[i, [j + 1 for j in on]] = 1
        return x

    x = matrix(bags)
    swapped = [(i, s) for i, bag in enumerate(bags) if (s := swap_identities(bag)) is not None]
    swapped += [(i, neutral_words(bags[i])) for i, _ in swapped]
    delta = x[[i for i, _ in swapped]] - matrix([s for _, s in swapped]) if swapped else np.zeros((0, x.shape[1]), np.float32)
    return ToxicityModel(index, _descend(x, y, weight / weight.sum(), delta, swap_penalty, l2, steps), prior)


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, delta: np.ndarray, swap_penalty: float,
             l2: float, steps: int) -> np.ndarray:
    """Accelerated gradient descent on: weighted log loss + l2 |w|^2 / 2 +
    swap_penalty * mean squared log-odds change under the swaps."""
    x, delta = x.astype(np.float32, copy=False), delta.astype(np.float32, copy=False)
    weight, y, one = weight.astype(np.float32), y.astype(np.float32), np.float32
    w = np.zeros(x.shape[1], np.float32)
    pen = np.full(len(w), l2, np.float32)
    pen[0] = 0
    m = max(1, len(delta))

    def top(f) -> float:
        """The largest curvature, by power iteration, with a margin."""
        v = np.random.default_rng(3).normal(size=len(w)).astype(np.float32)
        for _ in range(50):
            u = f(v / one(np.linalg.norm(v) or 1.0))
            v = u
        return 1.2 * float(np.linalg.norm(v))

    curve = 0.25 * top(lambda v: x.T @ (weight * (x @ v))) + l2
    if len(delta):
        curve += 2 * swap_penalty / m * top(lambda v: delta.T @ (delta @ v))
    rate, look, t = one(1.0 / curve), w.copy(), 1.0
    for _ in range(steps):
        grad = x.T @ (weight * (sigmoid(x @ look) - y)) + pen * look
        if len(delta):
            grad += one(2 * swap_penalty / m) * (delta.T @ (delta @ look))
        new = look - rate * grad
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + one((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w.astype(float)
