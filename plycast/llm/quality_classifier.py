"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are sampled up to stated bounds; a linear scorer is fitted to the
non-negative unbiased risk  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)); the prior is estimated from how far the
unlabelled share of a set can fall below the positive share of it. Every document is then scored.

Only rows whose crc32(doc_id as text) mod 5 is not 0 are learned from; doc_id, labels, lang and source are no inputs
of a score. Defined cases: a null or empty text has zero word features and gets the score of such a text; a null
doc_id is not held out; repeated rows get equal results and are one row of a sample; samples order rows by a hash of
doc_id, so ties do not depend on partitions; a very long text is read whole; columns other than doc_id and text are not
looked at; without positives the score is 0.5 everywhere; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import cut, map_rows

#: Bounds of the samples that the model is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
HASHED = 1024
DENSE = 9
CUT = 0.3
_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARK = b"#*$%&|<>!{}[]=_\\^~"


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = zlib.crc32(word) % HASHED
        return h


_BUCKETS = _Buckets()


def features(text: str | None) -> np.ndarray:
    b = (text or "").encode()
    words = b.split()
    n, size = len(words), max(1, len(b))
    out = np.zeros(HASHED + DENSE, np.float32)
    if n:
        out[:HASHED] = np.sqrt(np.bincount(np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, n), minlength=HASHED) / n)
    kinds = len(set(words))
    letters = max(1, sum(w[:1].isalpha() for w in words))
    out[HASHED:] = (
        np.log1p(n), (size - len(b.translate(None, _MARK))) / size, (size - len(b.translate(None, _UPPER))) / size, (size - len(b.translate(None, _DIGIT))) / size,
        (len(b) - n) / max(1, n), kinds / max(1, n), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), b.count(b"\n") / max(1, n), letters / max(1, n),
    )
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def risk(pos: np.ndarray, unl: np.ndarray, w: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of the logistic loss."""
    loss = lambda z: np.logaddexp(0, z).mean()
    return prior * loss(-(pos @ w)) + max(0.0, loss(unl @ w) - prior * loss(pos @ w))


def gradient(pos: np.ndarray, unl: np.ndarray, w: np.ndarray, prior: float | None) -> np.ndarray:
    """The risk's descent direction: its gradient, or, where the share of negatives would fall below 0, the way back up
    from there. With prior None, that of plain logistic regression of positives against unlabelled."""
    zp, zu = pos @ w, unl @ w
    up, uu = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    good, bad, rest = pos.T @ (up - 1) / len(pos), pos.T @ up / len(pos), unl.T @ uu / len(unl)  # of R_P(+), R_P(-), R_U(-)
    if prior is None:
        return good + rest
    loss = lambda z: np.logaddexp(0, z).mean()
    return prior * good + rest - prior * bad if loss(zu) >= prior * loss(zp) else prior * bad - rest


def _risk_fit(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> np.ndarray:
    """Adam on ``gradient``."""
    w, m, v = np.zeros(pos.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = gradient(pos, unl, w, prior) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The least ratio of unlabelled to positive share over sets of high scores that hold half the positives or more."""
    own = np.arange(len(pos)) % 2 == 0
    other = np.arange(len(unl)) % 2 == 0
    w = _risk_fit(pos[own], unl[other], None, steps=120)
    p, u = np.sort(pos[~own] @ w), np.sort(unl[~other] @ w)
    if not len(p) or not len(u):
        return 0.5
    at = p[(np.linspace(0.01, 0.5, 50) * len(p)).astype(int)]
    share = lambda x: 1 - np.searchsorted(x, at) / len(x)
    return float(np.clip((share(u) / np.maximum(share(p), 1e-9)).min(), 0.05, 0.99))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, float]:
    """Weights (with mean and scale folded in, the intercept last) and the class prior."""
    some = lambda df, n: df.dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    taught = labels.filter(~held_out() & (F.col("quality") == 1)).select(F.col("doc_id").cast("long"))
    free = docs.filter(~held_out()).select(F.col("doc_id").cast("long"))
    good = frozenset(r[0] for r in some(taught, max_positive))  # bounded by the parameters
    other = frozenset(r[0] for r in some(free, max_unlabelled))

    def chosen(cols: list[list]) -> Iterator[tuple]:
        for doc_id, text in zip(*cols, strict=True):
            if doc_id in good or doc_id in other:
                yield doc_id, doc_id in good, doc_id in other, features(text).tobytes()

    def fitted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({r[0]: r for b in it for r in zip(*b.to_pydict().values(), strict=True)}.values())
        read = lambda k: np.array([np.frombuffer(r[3], np.float32) for r in rows if r[k]], np.float64).reshape(-1, HASHED + DENSE)
        pos, unl = read(1), read(2)
        w, prior = np.zeros(HASHED + DENSE + 1), 0.5
        if len(pos) > 1 and len(unl) > 1:
            mean, scale = unl.mean(0), np.maximum(unl.std(0), 1e-3)
            scale[:HASHED] = np.maximum(scale[:HASHED], 0.05) * 4  # words weigh less than shape
            z = lambda x: np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
            pos, unl = z(pos), z(unl)
            prior = estimate_prior(pos, unl)
            w = _risk_fit(pos, unl, prior)
            w[-1] -= (w[:-1] * mean / scale).sum()
            w[:-1] /= scale
        yield pa.RecordBatch.from_pydict({"w": [w.tolist()], "prior": [prior]})

    sample = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, good boolean, free boolean, x binary", chosen)
    row = cut(sample.repartition(1).mapInArrow(fitted, "w array<double>, prior double")).first()
    return np.array(row[0]), row[1]


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    w = np.asarray(w)

    def rows(cols: list[list]) -> Iterator[tuple]:
        for doc_id, held, text in zip(*cols, strict=True):
            p = float(1 / (1 + np.exp(-np.clip(features(text) @ w[:-1] + w[-1], -30, 30))))
            yield doc_id, held, p, int(p >= CUT)

    return map_rows(docs.select(F.col("doc_id").cast("long"), held_out().alias("held"), "text"), "doc_id long, held_out boolean, score double, predicted int", rows)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)[0])
