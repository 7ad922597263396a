"""Product codes of vectors: each part of a vector becomes the number of its nearest codebook entry, found in a GNAT.

Vectors become integers, so all sums and comparisons are exact. A codebook's entries stand in a geometric near-neighbour
access tree: a node has split points far from each other, each other entry goes to its nearest split point, and of each pair
of a split point and another one's entries the least and greatest distance between them are stored. A query's distance to a
split point then rules out every set whose range lies strictly beyond the query's best distance so far. Square roots and
their sums are rounded outwards, so no entry at the least distance is ruled out, and what is left is compared by integer
squared distance, ties by number.

Codebooks are means over all vectors: tasks sum by part and entry, and 4 x 256 sums meet at the driver in each round.

Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; vectors shorter than the longest
kept one are filled up with zeros, as is the longest to a multiple of four; components of 2^16 or more are taken as that,
so that squared distances fit 64 bits; null vec_ids come last among ids, equal ones are ordered by their vectors; null labels
count together; fewer than 256 vectors give fewer entries; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries that are not split further.
SPLITS, BUCKET = 8, 12
#: Integers stay below this, so that squared distances of up to 512 dimensions stay below 2^63.
BOUND = 1 << 26
ROWS = 4096


def _squares(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = points - to
    return np.einsum("ij,ij->i", gap, gap)


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _root_below(d: np.ndarray) -> np.ndarray:
    """Not above the square root of an integer, though the integer and its root are rounded."""
    return np.maximum(_below(_below(np.sqrt(d.astype(np.float64)))), 0)


def _root_above(d: np.ndarray) -> np.ndarray:
    return _above(_above(np.sqrt(d.astype(np.float64))))


class Gnat:
    """A tree over integer points; ``members`` are their numbers in ``points``."""

    def __init__(self, points: np.ndarray, members: np.ndarray | None = None) -> None:
        members = np.arange(len(points)) if members is None else members
        self.points, self.kids = points, []
        if len(members) <= BUCKET:
            self.splits = members
            return
        own = points[members]
        gaps = [_squares(own, own[0])]  # from each split point to all members
        chosen = [0]
        nearest = gaps[0].copy()
        while len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            gaps.append(_squares(own, own[chosen[-1]]))
            nearest = np.minimum(nearest, gaps[-1])
        if len(chosen) == 1:  # all members are equal: the first of them is never beaten
            self.splits = members[:1]
            return
        self.splits, gaps = members[chosen], np.array(gaps)
        home, rest = gaps.argmin(0), np.ones(len(members), bool)
        rest[chosen] = False
        for k in range(len(chosen)):
            mine = (home == k) & rest
            if mine.any():
                near, far = _root_below(gaps[:, mine].min(1)), _root_above(gaps[:, mine].max(1))
                self.kids.append((k, near, far, Gnat(points, members[mine])))

    def search(self, queries: np.ndarray, best: np.ndarray, number: np.ndarray, rows: np.ndarray) -> int:
        """Improves ``best`` (squared distances) and ``number`` at ``rows``; gives how many distances it took."""
        if not len(rows):
            return 0
        mine, gaps = queries[rows], np.empty((len(self.splits), len(rows)), np.int64)
        for k, member in enumerate(self.splits):
            gaps[k] = _squares(mine, self.points[member])
            better = (gaps[k] < best[rows]) | ((gaps[k] == best[rows]) & (member < number[rows]))
            best[rows[better]], number[rows[better]] = gaps[k][better], member
        took = gaps.size
        if not self.kids:
            return took
        low, high, home = _root_below(gaps), _root_above(gaps), gaps.argmin(0)
        # the set of a query's nearest split point first, as it lowers the best distance for the others
        for first in (True, False):
            for k, near, far, kid in self.kids:
                reach = _root_above(best[rows])
                out = (_below(low - reach) > far[:, None]) | (_above(high + reach) < near[:, None])
                took += kid.search(queries, best, number, rows[((home == k) == first) & ~out.any(0)])
        return took


def nearest(tree: Gnat, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each query's nearest entry (of the lowest number), its squared distance, and the number of distances that were taken."""
    best, number = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(tree.points))
    return number, best, tree.search(queries, best, number, np.arange(len(queries)))


def integers(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """Rows id, label and ints of the vectors that are kept."""
    d = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("v", lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), F.floor(x * SCALE).cast("double"))).cast("int"))
    return d.filter(F.coalesce(sound, F.lit(False))).select("id", "label", whole.alias("ints"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of lists as one array, filled up with zeros to ``width``."""
    out, size, flat = np.zeros((len(column), width), np.int64), column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy()
    out[np.arange(width) < size[:, None]] = flat
    return out


def _split(rows: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(x) for x in np.split(rows, PARTS, axis=1)]


def _batches(it: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in it:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, _split(matrix(piece.column(piece.schema.get_field_index(name)), width))


def first_codebooks(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids: 256 rows at most."""
    rows = kept.orderBy(F.col("id").asc_nulls_last(), "ints").select("ints").limit(ENTRIES).collect()
    return _split(matrix(pa.array([r.ints for r in rows], pa.list_(pa.int64())), width))


def improved(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Codebooks whose entries are the floors of the means of the parts that are nearest to them."""
    trees, size = [Gnat(b) for b in books], width // PARTS
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, size), np.int64)
        for _, parts in _batches(it, "ints", width):
            for p, own in enumerate(parts):
                number, _, _ = nearest(trees[p], own)
                n[p] += np.bincount(number, minlength=ENTRIES)
                np.add.at(total[p], number, own)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], schema=schema)

    found = kept.select("ints").mapInArrow(sums, "part int, entry int, n long, total array<long>")
    added = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(size)]
    out = [b.copy() for b in books]
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # 1,024 rows at most
        out[r.part][r.entry] = np.floor_divide(np.array(r[3:], np.int64), r.n)
    return out


def encoded(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """id, label, code and error of each vector."""
    trees = [Gnat(b) for b in books]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, parts in _batches(it, "ints", width):
            found = [nearest(t, own) for t, own in zip(trees, parts, strict=True)]
            code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            texts = pa.array([bytes(c).hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), texts, pa.array(sum(f[1] for f in found))], names=["id", "label", "code", "error"])

    types = dict(kept.dtypes)
    return kept.select("id", "label", "ints").mapInArrow(rows, f"id {types['id']}, label {types['label']}, code string, error long")


def fitted(kept: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """Codebooks of the kept vectors, and the width they are filled up to."""
    width = -(-(kept.agg(F.max(F.size("ints"))).first()[0] or 0) // PARTS) * PARTS
    books = first_codebooks(kept, width)
    for _ in range(rounds):
        books = improved(kept, books, width)
    return books, width


def codebook_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row per kept vector: its code, its error, its label's error, and the digest of all codebooks."""
    kept = written(integers(vectors, id, vector, label))
    books, width = fitted(kept)
    done = written(encoded(kept, books, width).select("id", "code", "error", F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name")))
    of_label = written(done.groupBy("none", "name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    return spread_join(done, of_label, ["none", "name"], "n").select(F.col("id").alias(id), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
