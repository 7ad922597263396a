"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into 3 segments. Of at most 4 differing bits, some segment holds at most one, so two
linked fingerprints agree in that segment but for one bit. Every fingerprint is indexed under each segment with each
one of its bits left out (64 keys), and keys are joined by equality. The join's condition verifies the distance and
keeps a pair at one key only: at its first segment with at most one differing bit, and there at that bit. Distinct
fingerprints take part, so copies cost nothing, and a dense cluster is linked to one representative at each key instead
of pair by pair; links become components by star contraction. Keys are short, so unlike fingerprints meet by chance, the
more the larger the table is: the members of a key are compared where they were sorted, and only links leave the task.
Rows of a hot key stay where they are, and its figures are sent to them; at a crowded key only members that also agree
in one of five slices of their other bits are compared.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows get equal results; a
component of null doc_ids only has a null component_id; of the rows that tie for a component's smallest doc_id
``keep_one`` keeps one, the same one each time; a very long text is read whole, its shingles hashed one after another;
columns of any name are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plycast.llm.common import components, cut, keyed, map_rows, spread_join, unpacked

SHINGLE, SEED, BITS = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key of more than total / HOT fingerprints is hot, one of more than CROWD is crowded.
HOT, CROWD = 100, 1000
#: Keys of at most so many members are compared many at a time.
SMALL = 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        cuts = [(0, len(line))]
    else:
        cuts = zip([0, *(ends[:-size] + 1).tolist()], ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in cuts], np.uint64)
    parts = h.view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(parts[:, k], minlength=256) @ _OF_BYTE for k in range(8)])
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, __id, __key and fp (as a signed number) for each row."""
    own = keyed(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "__id", "__key", "text")

    def rows(cols: list[list]) -> Iterator[tuple]:
        for doc_id, row, key, text in zip(*cols, strict=True):
            yield doc_id, row, key, fingerprint(text, size)

    return map_rows(own, "doc_id long, __id long, __key long, fp long", rows)


def _index(fps: DataFrame) -> DataFrame:
    """Each row of distinct fingerprints under its 64 keys."""
    keys = []
    for s, (at, width) in enumerate(SEGMENTS):
        seg = F.shiftrightunsigned("fp", at).bitwiseAND((1 << width) - 1)
        keys += [F.lit((s * 32 + j) << 22).bitwiseOR(seg.bitwiseAND(~(1 << j) & ((1 << width) - 1))) for j in range(width)]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "*")


def _linked(most: int) -> Column:
    """Of rows a and b at one key: they differ in ``most`` bits at most, and this is the one key at which the pair counts."""
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    parts = [F.shiftrightunsigned(x, at).bitwiseAND((1 << width) - 1) for at, width in SEGMENTS]
    few = [F.bit_count(p) <= 1 for p in parts]
    first = F.when(few[0], 0).when(few[1], 1).otherwise(2)
    tag = F.shiftright(F.col("a.key"), 22)
    segment, bit = F.shiftright(tag, 5), tag.bitwiseAND(31)
    part = F.when(segment == 0, parts[0]).when(segment == 1, parts[1]).otherwise(parts[2])
    once = (segment == first) & F.when(part == 0, bit == 0).otherwise(F.bit_count(part - 1) == bit)
    return (F.bit_count(x) <= most) & once


def links(fps: DataFrame, most: int = BITS) -> DataFrame:
    """All pairs a < b of distinct ``fp`` values at ``most`` (at most 5) or fewer differing bits."""
    index = _index(fps.select("fp").distinct())
    a, b = index.alias("a"), index.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _linked(most)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def hot_keys(known: DataFrame, share: int = HOT) -> DataFrame | None:
    """The keys that hold more than one in ``share`` of the distinct fingerprints (some with half as many are among them), or
    None. A key's members are those of two values of its segment, so the values are counted, three rows a fingerprint; fewer
    than 2 * share values of a segment, and 22 keys of each, can be hot."""
    masks = [((1 << width) - 1) << at for at, width in SEGMENTS]
    values = [F.struct(F.lit(s).alias("s"), F.col("fp").bitwiseAND(m - (1 << 64) if m >> 63 else m).alias("fp")) for s, m in enumerate(masks)]
    n = known.count()
    counted = known.select(F.explode(F.array(*values)).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    keys = _index(counted.filter(F.col("n") * 2 * share > max(n, CROWD * share)).select("v.fp", "v.s"))
    hot = cut(keys.filter(F.shiftright("key", 27) == F.col("s")).select("key").distinct())
    return None if hot.isEmpty() else hot


def _split(index: DataFrame, hot: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the index at other keys and at hot ones."""
    if hot is None:
        return index, None
    return index.join(F.broadcast(hot), "key", "left_anti"), index.join(F.broadcast(hot), "key", "left_semi")


def _told(warm: DataFrame, **figures: Column) -> DataFrame:
    """Rows of hot keys with aggregates of their key: summed up in the tasks and, bounded like the keys, sent to the rows."""
    told = cut(warm.groupBy("key").agg(*(c.alias(k) for k, c in figures.items())))
    return warm.join(F.broadcast(told), "key")


def _slices(most: int) -> Column:
    """The bits outside of the key's segment in ``most`` + 1 slices, one of which is equal in any linked pair."""
    width = -(-43 // (most + 1))
    segment = F.shiftright("key", 27)
    rest = F.when(segment == 0, F.shiftrightunsigned("fp", 22))
    for s, (at, long) in enumerate(SEGMENTS[1:], 1):
        low, high = F.col("fp").bitwiseAND((1 << at) - 1), F.shiftrightunsigned("fp", at + long) if at + long < 64 else F.lit(0).cast("long")
        rest = rest.when(segment == s, low.bitwiseOR(F.shiftleft(high, at)))
    return F.array(*(F.shiftrightunsigned(rest, i * width).bitwiseAND((1 << width) - 1).bitwiseOR((i + 1) << width) for i in range(most + 1)))


def _sliced(segment: int, fp: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """What ``_slices`` gives for members of one key of that segment, slice by slice."""
    at, long = SEGMENTS[segment]
    width, bits = -(-43 // (most + 1)), fp.view(np.uint64)
    rest = bits & np.uint64((1 << at) - 1)
    if at + long < 64:
        rest = rest | bits >> np.uint64(at + long) << np.uint64(at)
    for i in range(most + 1):
        yield rest >> np.uint64(i * width) & np.uint64((1 << width) - 1)


def _counts(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What ``_linked`` says of the key: for differences ``x`` of pairs at most 5 bits apart, whether they count there."""
    parts = np.stack([x >> np.uint64(at) & np.uint64((1 << width) - 1) for at, width in SEGMENTS])
    segment, bit = key >> 27, key >> 22 & 31
    part = parts[segment, np.arange(len(x))]
    bits = np.bitwise_count(part)
    first = (np.bitwise_count(parts) <= 1).argmax(axis=0)
    return (segment == first) & np.where(bits == 0, bit == 0, part == np.uint64(1) << bit.astype(np.uint64))


def _spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs that connect what all pairs (a, b) connect; ``label`` has the smallest member reached so far, before
    and after."""
    picked, rest = [], np.arange(len(a))
    while True:
        low, high = np.minimum(label[a[rest]], label[b[rest]]), np.maximum(label[a[rest]], label[b[rest]])
        apart = low != high
        if not apart.any():
            return np.concatenate([*picked, np.empty(0, np.int64)]).astype(np.int64)
        rest, low, high = rest[apart], low[apart], high[apart]
        taken, at = np.unique(high, return_index=True)
        picked.append(rest[at])
        to = np.arange(len(label))
        to[taken] = low[at]
        while not np.array_equal(further := to[to], to):
            to = further
        label[:] = to[label]


def _apart(key: int, fp: np.ndarray, part: np.ndarray, main: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different parts at ``most`` or fewer differing bits that count at the key, in blocks: those outside
    of part ``main`` with all."""
    outside = np.flatnonzero(part != main)
    step = max(1, 1_000_000 // len(fp))
    for at in range(0, len(outside), step):
        a = outside[at : at + step]
        x = (fp[a, None] ^ fp).view(np.uint64)
        i, j = np.nonzero((np.bitwise_count(x) <= most) & (part[a, None] != part) & ((part == main) | (fp[a, None] < fp)))
        once = _counts(np.full(len(i), key), x[i, j])
        yield a[i[once]], j[once]


def _compared(key: np.ndarray, fp: np.ndarray, part: np.ndarray, most: int, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints a and b of pairs that connect, at each key, what the links that count there connect; from whole keys in
    order. Fewer pairs than members leave a key."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    few = sizes <= SMALL
    ends, at = np.repeat((starts + sizes)[few], sizes[few]), np.flatnonzero(np.repeat(few, sizes))
    a, b = [], []
    for d in range(1, SMALL):
        left = at + d < ends
        at, ends = at[left], ends[left]
        x = (fp[at] ^ fp[at + d]).view(np.uint64)
        near = np.flatnonzero((part[at] != part[at + d]) & (np.bitwise_count(x) <= most))
        near = near[_counts(key[at[near]], x[near])]
        a.append(at[near])
        b.append(at[near] + d)
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        picked = _spanning(np.arange(len(key)), a, b)
        yield fp[a[picked]], fp[b[picked]]
    for start, n in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        own, of = fp[start : start + n], part[start : start + n]
        parts, at, place, counts = np.unique(of, return_index=True, return_inverse=True, return_counts=True)
        if len(parts) == 1:
            continue
        main, label, k = parts[counts.argmax()], at[place], int(key[start])
        for same in [np.arange(n)] if n <= crowd else _same_slice(k >> 27, own, most):
            for a, b in _apart(k, own[same], of[same], main, most):
                a, b = same[a], same[b]
                picked = _spanning(label, a, b)
                yield own[a[picked]], own[b[picked]]


def _same_slice(segment: int, fp: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of members of one key that share a slice."""
    for value in _sliced(segment, fp, most):
        order = np.argsort(value, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff(value[order])) + 1)


def _met(index: DataFrame, most: int, crowd: int) -> DataFrame:
    """Links between different parts. A key's rows meet in a task, in which they are compared; links that connect them leave it."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for cols in _compared(*(np.concatenate(c) for c in zip(*rows, strict=True)), most, crowd):
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for batch in it:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key = cols[0]
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if at or (held and held[-1][0][-1] != key[-1]):
                yield from done([*held, [c[:at] for c in cols]])
                held = []
            held.append([c[at:].copy() for c in cols])
        if held:
            yield from done(held)

    own = index.select("key", "fp", "part").repartition("key").sortWithinPartitions("key")
    return own.mapInArrow(batches, "a long, b long")


def _met_hot(warm: DataFrame, most: int, crowd: int) -> DataFrame:
    """The same at hot keys, whose rows do not meet in one task."""
    left = _told(warm, low=F.min("part"), high=F.max("part"), most=F.min_by("part", "fp"), n=F.count("*"))
    left = cut(left.filter("low <> high").select("key", "fp", "part", "most", "n"))
    left = left.withColumn("slice", F.explode(F.when(F.col("n") > crowd, _slices(most)).otherwise(F.array(F.lit(0).cast("long")))))
    a, b = left.filter("part <> most").alias("a"), left.alias("b")
    apart = (F.col("a.part") != F.col("b.part")) & ((F.col("b.part") == F.col("b.most")) | (F.col("a.fp") < F.col("b.fp")))
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.slice") == F.col("b.slice")) & apart & _linked(most))
    return both.select("a.fp", "b.fp").toDF("a", "b")


def cluster_links(fps: DataFrame, most: int = BITS, share: int = HOT, crowd: int = CROWD) -> DataFrame:
    """Links that connect what ``links`` connects, without a dense cluster's pairs. At each key the members within reach of
    the smallest one are linked to it alone. Where a key's members are not all connected by that, those outside of one
    component are compared with all that are in another component than theirs; where they are more than ``crowd``, with
    those of them that share a slice of the other bits."""
    known = cut(fps.select("fp").distinct())
    hot = hot_keys(known, share)
    cold, warm = _split(_index(known), hot)
    met = cold.withColumn("centre", F.min("fp").over(Window.partitionBy("key")))
    if warm is not None:
        met = met.unionByName(_told(warm, centre=F.min("fp")))
    near = (F.col("fp") != F.col("centre")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= most)
    star = cut(met.filter(near).select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct())
    part = cut(known.join(components(star), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("part")))
    cold, warm = _split(_index(part), hot)
    both = _met(cold, most, crowd)
    if warm is not None:
        both = both.union(_met_hot(warm, most, crowd))
    return star.union(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, most: int = BITS) -> DataFrame:
    """For each row doc_id, __id, __key, fp, component_id (the smallest doc_id that links reach) and root (the component's smallest fp)."""
    own = cut(fingerprints(docs, size))
    roots = components(cluster_links(own, most))
    of_fp = own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    named = cut(of_fp.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    known = cut(spread_join(named.select("fp", "copies", "root"), ids, ["root"], "n"))
    return spread_join(own, known, ["fp"], "copies")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, most: int = BITS) -> DataFrame:
    """One row of each component stays: the one of the smallest doc_id (then text key), once if it is repeated."""
    own = near_duplicates(docs, size, most)
    kept = own.groupBy("root").agg(F.min(F.struct("__id", "__key")).alias("k")).select("k.*")
    again = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.xxhash64(*(f"row.`{c}`" for c in _hashable(docs)))))
    return keyed(docs).join(kept, ["__id", "__key"]).withColumn("copy", again).filter("copy = 1").select(*unpacked(docs))


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
