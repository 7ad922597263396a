"""MinHash fingerprints of texts, and how like they are to those of edited texts and of neighbours.

A text is the sequence of its words (split at ASCII white space) with four blanks before and after it; each five in a row are
a shingle, so that a text of n words has n + 4 of them and the shortest one has some. Shingles are hashed to 64 bits and put
through ``SLOTS`` permutations x -> a x + b mod 2^64 (a odd) in numpy; a signature is the least value of each. A fingerprint
keeps a byte of each (b-bit MinHash); the likeness of two is the share of equal bytes, less what chance makes equal.

``near_duplicates`` joins bands of four slots in Spark. In each bucket the smallest id meets the others, and the Jaccard
similarity of their shingle sets, from the whole texts, decides whether they are linked. Where a bucket's members are in
more than one class after that, those outside of its first class meet all that are in another class than theirs, so that no
link between texts that share a band is lost, though those of one class are not all compared.

Defined cases: a null text is empty; texts without words have a fingerprint of zeros, like each other and nothing else; rows
are ordered by doc_id, null first, then by text; a single document is its own next one; other columns play no part. A
text is hashed in pieces, so a very long one takes memory of eight bytes a word.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import blank_null, components, cut, map_batches, map_rows, spread_join, written

WORDS, SLOTS, ROWS, PIECE, REMEMBERED = 5, 128, 4, 1 << 20, 400_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
BLANKS = np.zeros(WORDS - 1, np.uint64)
#: How many shingles are permuted at once: SLOTS numbers each, which fit a processor's cache.
AT_ONCE = 512


class _Hashes(dict):
    """Words' hashes; frequent words are met before the room is used up."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = h
        return h


def permutations(slots: int = SLOTS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 1 << 63, (2, slots), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def word_hashes(text: str, known: dict) -> np.ndarray:
    data, at, found = text.encode("utf-8", "surrogatepass"), 0, []
    while at < len(data):
        gap = SPACE.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        words = data[at:end].split()
        found.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of each five words in a row, blanks included: the i-th ends with the i-th word, or i - n blanks later."""
    n = len(words) + WORDS - 1
    if not len(words):
        return np.empty(0, np.uint64)
    row, h = np.concatenate([BLANKS, words, BLANKS]), np.zeros(n, np.uint64)
    for k in range(WORDS):
        h = (h ^ row[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least(x: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each permutation; of no shingle, the greatest number."""
    a, b = perms
    out, room = np.full(len(a), np.iinfo(np.uint64).max), np.empty((min(len(x), AT_ONCE), len(a)), np.uint64)
    for at in range(0, len(x), AT_ONCE):
        own = x[at : at + AT_ONCE]
        values = np.multiply(own[:, None], a, out=room[: len(own)])
        values += b
        np.minimum(out, values.min(0), out=out)
    return out


def fingerprint(signature: np.ndarray) -> bytes:
    """A byte of each slot; zeros if there are no shingles."""
    if signature[0] == signature[-1] == np.iinfo(np.uint64).max:
        return bytes(len(signature))
    return ((signature >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity: 1 for equal fingerprints, 0 for what chance would give or less."""
    if a == b:
        return 1.0
    if not any(a) or not any(b):
        return 0.0
    same = int((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).sum())
    return max(0.0, (same * 256 - len(a)) / (len(a) * 255))


def bands(signature: np.ndarray) -> list[int]:
    """A hash of each ``ROWS`` slots and the band's number."""
    return [xxhash.xxh64_intdigest(signature[i : i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, len(signature), ROWS)]


def _banded(columns: list[list]) -> Iterator[tuple]:
    known, perms = _Hashes(), permutations()
    for number, text in zip(*columns, strict=True):
        yield number, bands(least(shingles(word_hashes(text, known)), perms))


def _alike(share: float):
    def rows(columns: list[list]) -> Iterator[tuple]:
        known = _Hashes()
        for a, b, one, other in zip(*columns, strict=True):
            x, y = (np.unique(shingles(word_hashes(t, known))) for t in (one, other))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= share * (len(x) + len(y) - both):
                yield a, b

    return rows


def _verified(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Pairs a, b whose texts are alike."""
    text = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    return cut(map_rows(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b"), "a long, b long", _alike(share)))


def near_duplicates(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id and class_id, the smallest doc_id that links of a Jaccard similarity of ``share`` or more reach, for each row.
    Equal texts are one; null ids are none's class but their own texts'. With bands of four of 128 slots a pair at 0.8
    meets in one at least but for one in ten million."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text"))
    d = d.select("*", F.struct(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"), F.length("text").alias("n")).alias("same"))
    equal = cut(d.groupBy("same").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    one = d.groupBy("same").agg(F.first("text").alias("text"))
    texts = written(one.join(equal, "same").select("id", "text"))
    index = written(map_rows(texts, "id long, keys array<long>", _banded).select("id", F.explode("keys").alias("key")))
    first = index.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    links = _verified(spread_join(index, first, ["key"], "n").filter("id <> a").select("a", F.col("id").alias("b")).distinct(), texts, share)
    part = cut(equal.select("id").join(components(links), F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("part")))
    held = index.join(part, "id")
    torn = held.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "low", "n")
    left = cut(spread_join(held, torn, ["key"], "n"))
    a, b = left.filter("part <> low").alias("a"), left.alias("b")
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.low")) | (F.col("a.id") < F.col("b.id")))
    more = a.join(b, (F.col("a.key") == F.col("b.key")) & apart).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    roots = components(links.unionByName(_verified(more, texts, share)))
    own = equal.join(roots, F.col("id") == F.col("node"), "left").select("same", "least", "copies", F.coalesce("root", "id").alias("root"))
    ids = own.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    of_text = cut(spread_join(cut(own), cut(ids), ["root"], "n").select("same", "copies", "class_id"))
    return spread_join(d.select("doc_id", "same"), of_text, ["same"], "copies").select("doc_id", "class_id")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


class _Prints:
    """Fingerprints of a text and of its edited one, with the shingles of their common beginning permuted once."""

    def __init__(self) -> None:
        self.known, self.perms = _Hashes(), permutations()

    def pair(self, text: str, changed: str) -> tuple[bytes, bytes]:
        one, other = word_hashes(text, self.known), word_hashes(changed, self.known)
        n = min(len(one), len(other))
        apart = np.flatnonzero(one[:n] != other[:n])
        common = int(apart[0]) if len(apart) else n
        a, b = shingles(one), shingles(other)
        shared = least(a[:common], self.perms)
        return tuple(fingerprint(np.minimum(shared, least(x[common:], self.perms))) for x in (a, b))

    def alone(self, text: str) -> bytes:
        return fingerprint(least(shingles(word_hashes(text, self.known)), self.perms))


PRINTED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
STEP = f"kind string, task int, text string, {PRINTED}"


def _row(doc_id: int | None, text: str, own: bytes, changed: str, changed_print: bytes, following: bytes) -> tuple:
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return doc_id, len(text), sha, own, changed_print, likeness(own, changed_print), likeness(own, following)


def _in_order(texts: Iterator[tuple[int | None, str]], task: int) -> Iterator[tuple]:
    """Rows of a task in order: each is done when the fingerprint of the next one is known. The first and the last text of
    the task are given out for the tasks beside it."""
    prints, before, waiting, blank = _Prints(), None, None, (None,) * 6
    for doc_id, text in texts:
        if before is None:
            yield "first", task, text, doc_id, *blank
        else:
            changed = edited(before[1], text)
            own, changed_print = prints.pair(before[1], changed)
            if waiting:
                yield "done", task, None, *_row(*waiting, own)
            waiting = (*before, own, changed, changed_print)
        before = (doc_id, text)
    if before:
        if waiting:
            yield "done", task, None, *_row(*waiting, prints.alone(before[1]))
        yield "last", task, before[1], before[0], *blank


def _steps(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    def texts() -> Iterator[tuple[int | None, str]]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True)

    return itertools.batched(_in_order(texts(), TaskContext.get().partitionId()), 500)


def _last_rows(columns: list[list]) -> Iterator[tuple]:
    prints = _Prints()
    for doc_id, text, following in zip(*columns, strict=True):
        changed = edited(text, following)
        own, changed_print = prints.pair(text, changed)
        yield _row(doc_id, text, own, changed, changed_print, prints.alone(following))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document, see ``PRINTED``; digests and fingerprints are binary. Texts are sorted by ranges once, so that
    neighbours meet in a task; where tasks meet, their first and last texts are joined, one pair a task."""
    order = ["doc_id", "tie", "text"]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null().alias("text")).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions(*order).select("doc_id", "text")
    stored = written(map_batches(d, STEP, _steps))
    ends = stored.filter("kind <> 'done'").select("kind", "task", "doc_id", "text")
    tasks = sorted(r.task for r in ends.filter("kind = 'first'").select("task").collect())  # a number for each task
    follow = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, next int")
    first = ends.filter("kind = 'first'").select(F.col("task").alias("next"), F.col("text").alias("following"))
    last = ends.filter("kind = 'last'").join(F.broadcast(follow), "task").join(first, "next").select("doc_id", "text", "following")
    return stored.filter("kind = 'done'").select(*(c.split()[0] for c in PRINTED.split(", "))).unionByName(map_rows(last, PRINTED, _last_rows))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """The same with lowercase hex."""
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return document_fingerprints(docs).withColumns(hexed)
