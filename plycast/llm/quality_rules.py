"""Quality rules: heuristics, then an importance-weight test.

The method is the hashed n-gram log-likelihood ratio: word uni- and bigrams fall into a fixed number of buckets;
one multinomial is counted over trusted documents and one over all documents; a document's score is the mean
log ratio over its n-grams, and a fixed threshold decides every document.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows each get their own equal
result and count each; a ratio equal to the threshold is kept; a very long text is read whole, in time n log n; without
trusted documents both multinomials are flat and only the base rules decide; columns other than doc_id and text are not
looked at and, whatever their names, kept by ``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import SPACES, map_rows

BUCKETS = 1 << 16
#: Ids of trusted documents are sent to all tasks up to this many, else texts are shuffled to them; all of them count.
MAX_SENT = 1_000_000
#: Mean log ratio per n-gram. Text made like the trusted documents scores about 0 or more.
THRESHOLD = -0.12
SMOOTH = 1.0
MIN_WORDS, REPEAT_PCT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"


class _Hashes(dict):
    """Word to 32-bit hash; kept for a worker's life, emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


_HASHES = _Hashes()


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate([h % np.uint64(BUCKETS), pairs >> np.uint64(48)]).astype(np.int64)


def repeat_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    name, length = at, 1
    while length < size:  # exact names of windows: rank pairs of shorter windows, the second as far on as it can be
        step = min(length, size - length)
        left, right = name[: n - length - step + 1], name[step:]
        name = np.unique(left * (int(name.max()) + 1) + right, return_inverse=True)[1]
        length += step
    found = np.bincount(name)[name] > 1
    mark = np.zeros(n + 1, np.int64)
    start = np.flatnonzero(found)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + size, -1)
    return int((np.cumsum(mark[:n]) > 0).sum())


def base_rules(text: str | None) -> tuple[list[bytes], int, int, int, int, bool]:
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    repeated = repeat_words(words)
    n = len(words)
    return words, chars, symbols, len(lines) - len(set(lines)), repeated, n < MIN_WORDS or 100 * repeated > REPEAT_PCT * n


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Log ratio for each bucket; ``trusted`` has doc_ids of the target. One pass over all of ``docs``."""
    ids = trusted.select("doc_id").dropna().distinct().withColumn("trusted", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= MAX_SENT else ids

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), np.int64)
        for batch in it:
            for near, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()
                if words:
                    c = np.bincount(ngram_buckets(words), minlength=BUCKETS)
                    both[0] += c
                    if near:
                        both[1] += c
        some = np.flatnonzero(both[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "raw", "target"])

    parts = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("trusted", "text").mapInArrow(counts, "bucket int, raw long, target long")
    total = parts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[total.iloc[:, 0]], target[total.iloc[:, 0]] = total.iloc[:, 1], total.iloc[:, 2]
    share = lambda c: (c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)
    return np.log(share(target)) - np.log(share(raw)) if target.sum() else np.zeros(BUCKETS)


def score(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    def rows(cols: list[list]) -> Iterator[tuple]:
        for doc_id, text in zip(*cols, strict=True):
            words, *counts, failed = base_rules(text)
            llr = float(ratio[ngram_buckets(words)].mean()) if words else 0.0
            yield (doc_id, len(words), *counts, failed, llr, not failed and llr >= threshold)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), schema, rows)


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, trusted), threshold)


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    ratio = fit(docs, trusted)
    names = docs.columns
    at = names.index("text")

    def passing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for text in batch.column(at):
                words, *_, failed = base_rules(text.as_py())
                keep.append(not failed and float(ratio[ngram_buckets(words)].mean()) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(passing, docs.schema)
