"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte classes whose shares are statistics.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"()-", b"!?", b"|", b"#$%&*@^~=+<>{}[]\\/_`"]
N_STATS = len(CLASSES) + 10
COUNTED = np.zeros((256, len(CLASSES)))
for _i, _c in enumerate(CLASSES):
    COUNTED[list(_c), _i] = 1


def statistics(data: bytes) -> list[float]:
    """Transformed statistics of a whole UTF-8 text: angles of shares, logarithms of sizes."""
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    shares = list(histogram @ COUNTED / n) + [histogram[128:].sum() / n]
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    kinds = set(words)
    ends = sum(not w[-1:].isalnum() and w[-1] < 128 for w in kinds)
    shares += [len(kinds) / nw, len(set(lines)) / nl, ends / max(1, len(kinds)),
               sum(w.isupper() for w in kinds) / max(1, len(kinds)), sum(w.isdigit() for w in kinds) / max(1, len(kinds)),
               sum(len(x) == 1 for x in kinds) / max(1, len(kinds))]
    return [*np.arcsin(np.sqrt(np.clip(shares, 0, 1))), np.log1p(len(words)), np.log1p(len(data) / nw), np.log1p(nw / nl)]


def stats_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(x or b""), np.float64) for x in data])
    return of(text.cast("binary"))


@dataclass
class Model:
    """Per class (0, 1): log prior, mean and inverse Cholesky factor; None where none was seen."""

    prior: list
    mean: list
    factor: list
    logdet: list

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of log densities."""
        if None in self.prior:
            seen = [p is not None for p in self.prior]
            return np.full(len(x), 0.5 if not any(seen) else float(seen[1]))
        density = []
        for prior, mean, factor, logdet in zip(self.prior, self.mean, self.factor, self.logdet):
            density.append(prior - 0.5 * (logdet + (((x - mean) @ factor.T) ** 2).sum(axis=1)))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(rows: DataFrame, stats: str = "stats", label: str = "label", pooled: float = 0.05, ridge: float = 0.01) -> Model:
    """Class moments over all labelled rows in one aggregate (two rows reach the driver).

    Covariances are shrunk towards the pooled one and that towards a multiple
    of the identity, so that they can always be factored.  Labels other than
    0 and 1 are ignored.
    """
    d = N_STATS
    x = [F.col(stats)[i] for i in range(d)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    got = {r[0]: r[1:] for r in rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(F.count(F.lit(1)), *sums).collect()}
    total = sum(r[0] for r in got.values())
    prior, mean, covs = [None, None], [None, None], [None, None]
    for c, (n, *s) in got.items():
        s = np.array(s)
        m = s[:d] / n
        second = np.zeros((d, d))
        second[np.tril_indices(d)] = s[d:] / n
        second = second + np.tril(second, -1).T
        prior[c], mean[c], covs[c] = float(np.log(n / total)), m, second - np.outer(m, m)
    shared = sum(got[c][0] * covs[c] for c in got) / max(1, total) if got else None
    factor, logdet = [None, None], [None, None]
    for c in got:
        cov = (1 - pooled) * covs[c] + pooled * shared
        cov = (1 - ridge) * cov + ridge * max(np.trace(shared) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factor[c], logdet[c] = np.linalg.inv(lower), 2 * float(np.log(np.diag(lower)).sum())
    return Model(prior, mean, factor, logdet)


def score_of(stats: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")
    return of(stats)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def with_stats(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """docs with the array of its texts' statistics; null texts count as empty."""
    return docs.withColumn(out, stats_of(docs[text]))


def train(rows: DataFrame, labels: DataFrame, key: str = "doc_id", stats: str = "stats", label: str = "quality") -> Model:
    """Fit on the labelled rows (key, stats) that aren't held out.  Repeated labels of a key count
    once (the smallest); null keys and labels are ignored."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(label).alias("label"))
    held = rows.where(~held_out(rows[key])).select(rows[key].alias("__key"), rows[stats].alias("stats"))
    return fit(held.join(known, "__key"))


def scored(rows: DataFrame, model: Model, stats: str = "stats", out: str = "quality_score") -> DataFrame:
    """rows with the probability `out` of label 1 in place of the statistics, one row per input row."""
    return rows.withColumn(out, score_of(rows[stats], model)).drop(stats)
