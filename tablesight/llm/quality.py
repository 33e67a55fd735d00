"""Quality classifier by compression.

Zstandard dictionaries are built from texts labelled good and bad. A text that the
good dictionary shortens more than the bad one is likely good: the difference of the
two compressed sizes, divided by the text's bytes and by its plain compressed size, is
turned into a probability by a logistic calibration on other labelled texts.

Labels are learnt from a bounded sample (``bound`` rows, half of them per class at
most): the first part builds the dictionaries, the rest calibrates. Every text is
scored whole.

Nulls, empties: a null text counts as empty; an empty text gets the score that the
calibration gives to a difference of zero. Without labels of both classes the score is
the share of label 1, or 0.5 without any label. Repeated rows and ties score alike;
extra columns pass through ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_or_empty
from .learning import fit_logistic, labelled_sample, sigmoid

#: Sizes of the dictionaries in bytes: a small one holds the most frequent strings, a
#: large one more of the vocabulary. Each gives one difference.
DICT_SIZES = (4_096, 16_384, 65_536, 262_144)
LEVEL = 3


@dataclass
class QualityModel:
    dictionaries: list[tuple[bytes, bytes]] = field(default_factory=list)  # (good, bad)
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    prior: float = 0.5

    def scorer(self):
        """Function from a list of texts to scores, with compressors made once."""
        import zstandard as zstd

        plain = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
        pairs = []
        for good, bad in self.dictionaries:
            made = []
            for raw in (good, bad):
                d = zstd.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))
            pairs.append(made)

        def features(texts) -> np.ndarray:
            out = np.zeros((len(texts), 2 * len(pairs)))
            for i, text in enumerate(texts):
                raw = text.encode("utf-8", "replace")
                n, p = max(1, len(raw)), len(plain.compress(raw))
                less = [len(bad.compress(raw)) - len(good.compress(raw)) for good, bad in pairs]
                out[i] = [d / size for d in less for size in (n, p)]
            return out

        def score(texts) -> np.ndarray:
            if self.weights is None:
                return np.full(len(texts), self.prior)
            x = (features(texts) - self.mean) / self.scale
            return sigmoid(self.weights[0] + x @ self.weights[1:])

        score.features = features
        return score

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


def _train(texts: list[str], size: int) -> bytes:
    """A zstandard dictionary; the plain bytes serve where there is too little text to build one."""
    import zstandard as zstd

    raw = [t.encode("utf-8", "replace") for t in texts]
    try:
        return zstd.train_dictionary(size, raw, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(raw)[:size] or b"\n" * 8


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = 8_000,
                l2: float = 0.3) -> QualityModel:
    rows = labelled_sample(docs, labels, target, bound)
    if len(rows) == 0:
        return QualityModel()
    prior = float((rows["weight"] * rows["y"]).sum() / rows["weight"].sum())
    if rows["y"].nunique() < 2:
        return QualityModel(prior=prior)
    # every other text of a class builds the dictionaries, the rest calibrates
    turn = rows.sample(frac=1.0, random_state=5).groupby("y").cumcount().reindex(rows.index) % 2
    build, cal = rows[turn == 0], rows[turn == 1]
    if cal["y"].nunique() < 2:
        cal = build
    good, bad = (build.loc[build["y"] == y, "text"].tolist() for y in (1, 0))
    model = QualityModel([(_train(good, s), _train(bad, s)) for s in DICT_SIZES], prior=prior)
    x = model.scorer().features(cal["text"].tolist())
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights = fit_logistic((x - model.mean) / model.scale, cal["y"].to_numpy(float), cal["weight"].to_numpy(), l2)
    return model
