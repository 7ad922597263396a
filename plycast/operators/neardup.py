"""A corpus before it is embedded: which chunks speak of positions, and which are near copies of another.

Near copies are found by MinHash: the least of ``SLOTS`` hashes over a text's shingles of five words, in bands of ``ROWS``
slots. In each bucket of a band the smallest id leads; the others are verified against it by the Jaccard similarity of their
shingle sets, and those that fail stay for the next leader among them. A round tries twice as many leaders as the one before,
so the rounds grow with the logarithm of a bucket's leaders, and a member meets at most twice as many as there are.

Of each text only two hashes of its shingle set, the set's size and the bands are stored; the shingles, which take more room
than the text, are made again where two texts are compared. Only texts that share a bucket are stored for that, and only
while the rounds run; a bucket's leaders are sent to its members by parts of ``PART`` of them, and shuffle files go with each
step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plycast.functions import lineage

WORDS, SLOTS, ROWS, LEAST = 5, 64, 4, 0.8
#: Members of a bucket that are compared in one task, and pairs up to which they are sent to the texts instead of meeting them.
PART, FEW = 1000, 20_000
#: What a chunk that is worth retrieving speaks of: a move or square, or a plan.
MOVE = r"(?i)\b(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?[+#]?|O-O(?:-O)?)(?![\w-])"
PLAN = r"(?i)\b(?:plan|idea|threat|weak\w*|attack\w*|defen[cs]\w*|better|worse|because|instead|should|control\w*|develop\w*|pressure|initiative)\b"


def speaks_of_positions(text: Column) -> Column:
    """A move or square with a word of plans or comparison beside it; null texts do not."""
    return F.coalesce(text.rlike(MOVE) & text.rlike(PLAN), F.lit(False))


def _word(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number's own pseudo-random one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(lower: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def of(text: str | None) -> np.ndarray:
        words = [w for w in (text or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        if len(known) > 200_000:
            known.clear()
        x = np.array([known[w] if w in known else known.setdefault(w, _word(w)) for w in words], np.uint64)
        if not len(x):
            return x.astype(np.int64)
        n = min(WORDS, len(x))
        h = np.full(len(x) - n + 1, n, np.uint64)
        for i in range(n):  # each place of a word changes what comes out
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + len(h)])
        return np.unique(h).view(np.int64)

    return pd.Series([of(t) for t in lower], dtype="object")


def shingle_set(text: Column) -> Column:
    """Hashes of each five words in a row, in lower case, once each; of fewer words, of them all; of none, nothing."""
    return F.pandas_udf(_shingles, "array<bigint>")(F.lower(text))


def _least(shingles: pd.Series, slots: pd.Series) -> pd.Series:
    """The least hash of each slot, from shingles by parts, so that a long text takes no more memory than a short one."""
    add = _mixed(np.arange(1, 1 + int(slots.iloc[0]) if len(slots) else 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(x: np.ndarray) -> np.ndarray:
        h, low = np.asarray(x, np.int64).view(np.uint64), np.full(len(add), 2**64 - 1, np.uint64)
        for i in range(0, len(h), 4096):
            low = np.minimum(low, _mixed(h[None, i : i + 4096] ^ add[:, None]).min(1))
        return low.view(np.int64)

    return pd.Series([of(x) for x in shingles], dtype="object")


def _bands(least: str, slots: int) -> Column:
    band = lambda b: F.xxhash64(b, F.slice(least, b * ROWS + 1, F.lit(ROWS)))
    return F.transform(F.sequence(F.lit(0), F.lit(slots // ROWS - 1)), band)


def signatures(sets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """id and bands, the hash of each ``ROWS`` least values, from id and shingles; sets without any have none."""
    least = sets.filter(F.size("shingles") > 0).withColumn("least", F.pandas_udf(_least, "array<bigint>")("shingles", F.lit(slots)))
    return least.select("id", _bands("least", slots).alias("bands"))


def _marks(lower: pd.Series, slots: pd.Series) -> pd.DataFrame:
    """128 hashed bits of each shingle set (a and b), its size (n) and its least hashes."""
    sets = _shingles(lower)
    hashed = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
    a, b = (np.array([int.from_bytes(h[i : i + 8], "little", signed=True) for h in hashed], np.int64) for i in (0, 8))
    return pd.DataFrame({"a": a, "b": b, "n": np.array([len(x) for x in sets], np.int32), "least": _least(sets, slots)})


def marks(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """id, same (equal for equal shingle sets, with their size n) and bands, from id and text."""
    mark = F.pandas_udf(_marks, "a bigint, b bigint, n int, least array<bigint>")(F.lower("text"), F.lit(slots))
    m = df.select("id", mark.alias("mark")).select("id", "mark.*")
    return m.select("id", F.struct("a", "b", "n").alias("same"), _bands("least", slots).alias("bands"))


def _near(least: float, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of a member and one of its ``leaders`` whose Jaccard similarity is ``least`` or more, from rows in order of key and
    part in which the leaders, which have no such list, come before the members."""

    def jaccard(a: np.ndarray, b: np.ndarray) -> float:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, theirs = None, {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):  # so that not all of a batch's shingles are held at once
                keys, parts, ids, texts, lists = (c.to_pylist() for c in whole.slice(start, 1000).columns)
                pairs = []
                for key, part, id, own, leaders in zip(keys, parts, ids, _shingles(texts), lists, strict=True):
                    if (key, part) != at:
                        at, theirs = (key, part), {}
                    if leaders is None:
                        theirs.setdefault(id, []).append(own)
                    else:
                        pairs += [(id, x) for x in leaders if any(jaccard(own, y) >= least for y in theirs.get(x, ()))]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pairs, strict=True), schema, strict=True)], schema=schema)

    return found


def verified(met: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of the different pairs (id, leader) of ``met`` whose texts' shingle sets are similar enough. A pair is compared at
    the smallest key it meets at, so that a member's text is sent once for all of its leaders there."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pairs = met.groupBy("id", "leader").agg(F.min("key").alias("key"))
    members = pairs.groupBy("key", "id").agg(F.collect_list("leader").alias("leaders"))
    parts = members.groupBy("key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = members.join(parts, "key").select("id", "key", F.pmod(F.hash("id"), "parts").alias("part"), "leaders")
    leaders = pairs.select(F.col("leader").alias("id"), "key").distinct().join(parts, "key")
    wanted = dealt.unionByName(leaders.select("id", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), allowMissingColumns=True)
    if pairs.count() <= FEW:
        wanted = F.broadcast(wanted)
    rows = texts.join(wanted, "id").select("key", "part", "id", F.lower("text").alias("text"), "leaders")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", F.col("leaders").isNotNull())
    schema = met.select("id", "leader").schema
    return rows.mapInArrow(_near(least, to_arrow_schema(schema)), schema).distinct()


def settle(df: DataFrame) -> DataFrame:
    """A checkpoint whose shuffle files go when it is made."""
    return lineage.settle(lineage.once(df))


def _followers(near: Column) -> Column:
    """Of pairs (id, leader) in order of id, the ids whose leader is not itself one of them."""
    none = F.slice(F.transform(near, lambda x: x["id"]), 1, 0)
    return F.aggregate(near, none, lambda s, x: F.when(F.array_contains(s, x["leader"]), s).otherwise(F.array_union(s, F.array(x["id"]))))


def _links(left: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """id and leader of those that are near a leader of a bucket, from the buckets' members (key, id, n) and their texts."""
    links, width = None, 1
    while not left.isEmpty():
        place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
        tried = settle(left.withColumn("place", place).filter(F.col("place") <= width).select("key", F.col("id").alias("leader"), F.col("n").alias("its")))
        # sets of unlike sizes can't be similar enough, so they need not be fetched
        met = left.join(tried, "key").filter((F.col("id") > F.col("leader")) & (F.least("n", "its") >= F.greatest("n", "its") * least))
        met = settle(met.select("key", "id", "leader"))
        good = settle(met.join(verified(met, texts, least), ["id", "leader"]))
        if width > 1:  # one that is near a leader before it is none
            among = good.join(tried.select("key", F.col("leader").alias("id")), ["key", "id"])
            near = F.array_sort(F.collect_list(F.struct("id", "leader")))
            good = settle(good.join(among.groupBy("key").agg(_followers(near).alias("leader")).select("key", F.explode("leader").alias("leader")), ["key", "leader"], "left_anti"))
        found = good.select("id", "leader").distinct()
        links = found if links is None else links.unionByName(found)
        last = tried.groupBy("key").agg(F.max("leader").alias("last"))
        left = left.join(last, "key").filter(F.col("id") > F.col("last")).drop("last")
        left = settle(left.join(good.select("key", "id").distinct(), ["key", "id"], "left_anti"))
        width *= 2
    return links


def near_copies(df: DataFrame, id: str, text: str, least: float = LEAST) -> DataFrame:
    """id, leader and copies for each row: of texts with equal shingle sets the smallest id stands for all (``copies`` of
    them); it has the smallest leader that it meets in a bucket at a Jaccard similarity of ``least`` or more, or itself.
    Texts without words are copies of each other."""
    docs = df.select(F.col(id).alias("id"), F.col(text).alias("text"))
    every = settle(marks(docs))
    first = settle(every.groupBy("same").agg(F.min("id").alias("stand"), F.count("*").alias("copies"), F.min_by("bands", "id").alias("bands")))
    left = first.filter("same.n > 0").select(F.col("stand").alias("id"), "same.n", F.explode("bands").alias("key"))
    left = settle(left.join(left.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "key"))
    links = None
    if not left.isEmpty():
        with lineage.stored(docs.join(left.select("id").distinct(), "id", "left_semi")) as texts:
            links = _links(left, texts, least)
    found = first.select("stand", "copies") if links is None else first.join(links.groupBy(F.col("id").alias("stand")).agg(F.min("leader").alias("leader")), "stand", "left")
    found = found.withColumn("leader", F.least("stand", F.coalesce("leader", "stand")) if links is not None else F.col("stand"))
    return every.select("id", "same").join(first.select("same", "stand"), "same").join(found, "stand").select("id", "stand", "leader", "copies")
