"""Merkle manifest of a table: content-addressed nodes, and proofs that leaf requests collect on their way down.

Each row is a leaf. The leaves of a group (a source) stand in the order of their ids; runs of ``FAN`` become a node until
one is left, the group's subroot, and subroots become the root in the same way. A node is stored once per level as a record
from its digest to its children's digests. A request is a leaf's rank; its digits to the base ``FAN`` are its way from the
root. Requests at the same node go down together: at each level a node's record is found by its digest, the children with
requests are entered, and the digests left and right of each are added to its path. A leaf's path, reversed, is its proof.

Nothing but the number of leaves per level is seen by the driver. Ranks come from a sort by ranges, whose tasks count
their own rows; a group that runs on over several tasks adds what earlier ones hold, one number a task.

Defined cases: a null value is ``-`` and a null group is a group, the first; null ids come first; rows of the same id
are ordered by digest, and repeated rows have neighbouring ranks and the proofs of these; an empty text is ``0:``; an empty table has no
root and gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plycast.llm.common import cut, spread_join, written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANKED = "g string, id long, leaf string, payload string, task int, whole boolean, place long"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row; digests are parts as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's ``FIELDS``, some of them changed."""
    return digest(*(field(changed.get(f, F.col(f))) for f in FIELDS))


def ranked(leaves: DataFrame) -> DataFrame:
    """Adds rank (from 0, within the group g, by id and then leaf) to rows g, id, leaf, payload; g is never null."""
    order, names = ["g", "id", "leaf", "tie"], [c.split()[0] for c in RANKED.split(", ")]
    # equal rows are dealt out by a number of their own, so that many copies of one are not one task's
    d = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's place in its group's run in this task, and whether the group certainly began in this task."""
        task, last, at, begun = TaskContext.get().partitionId(), None, 0, False
        for batch in it:
            if not batch.num_rows:
                continue
            g, i = batch.column(0), np.arange(batch.num_rows)
            fresh = np.ones(len(i), bool)
            fresh[0] = g[0].as_py() != last
            fresh[1:] = pc.not_equal(g.slice(1), g.slice(0, len(i) - 1)).to_numpy(zero_copy_only=False)
            start = np.maximum.accumulate(np.where(fresh, i, -1))
            place = np.where(start < 0, i + at, i - start)
            whole = (start > 0) | (last is not None if fresh[0] else begun)
            last, at, begun = g[-1].as_py(), int(place[-1]) + 1, bool(whole[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(i), task, np.int32)), pa.array(whole), pa.array(place)], names=names)

    placed = written(d.select("g", F.col("id").cast("long").alias("id"), "leaf", "payload").mapInArrow(places, RANKED))
    # of each task only the first group can have begun in an earlier one
    held = placed.groupBy("task", "g").agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole"))
    before = F.sum("n").over(Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    earlier = held.withColumn("before", before).filter("not whole and before > 0").select("task", F.lit(False).alias("whole"), "before")
    return placed.join(F.broadcast(earlier), ["task", "whole"], "left").select("g", "id", "leaf", "payload", (F.col("place") + F.coalesce("before", F.lit(0))).alias("rank"))


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From leaves (g, rank, leaf): for each level from 1 on its records (digest, kids, n: how many nodes have it), and of each
    group its subroot and the depth it stands at (g, subroot, depth)."""
    level, records, tops, most = leaves.select("g", "rank", F.col("leaf").alias("digest")), [], [], leaves.agg(F.max("rank")).first()[0] or 0
    while most:
        kids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])
        up = written(level.groupBy("g", F.floor(F.col("rank") / FAN).alias("rank")).agg(kids.alias("kids")))
        # a first node of one child has no other beside it: the child is what remains of its group
        only = (F.col("rank") == 0) & (F.size("kids") == 1)
        tops.append(up.filter(only).select("g", F.col("kids")[0].alias("subroot"), F.lit(len(tops)).alias("depth")))
        nodes = up.filter(~only).withColumn("digest", digest(F.array_join("kids", "")))
        records.append(nodes.groupBy("digest").agg(F.first("kids").alias("kids"), F.count("*").alias("n")))
        level, most = nodes.select("g", "rank", "digest"), most // FAN
    last = level.select("g", F.col("digest").alias("subroot"), F.lit(len(tops)).alias("depth"))
    return records, functools.reduce(DataFrame.unionByName, tops, last)


def _entered(d: Column, *more: Column) -> Column:
    """The child at a digit, with those that are not selected added to the path."""
    sides = F.struct(F.array_join(F.slice("kids", F.lit(1), d["digit"]), "").alias("before"), F.array_join(F.slice("kids", d["digit"] + 2, F.lit(FAN)), "").alias("after"))
    return F.struct((F.col("rank") * FAN + d["digit"]).alias("rank"), F.get("kids", d["digit"]).alias("digest"), F.array_append("path", sides).alias("path"), *more)


def _enters(d: Column) -> Column:
    return _entered(d)


def _met(d: Column) -> Column:
    """The same at a leaf, with its request."""
    return _entered(d, d["asked"].alias("asked"))


def descend(starts: DataFrame, records: list[DataFrame], requests: DataFrame) -> DataFrame:
    """From starts (g, subroot, depth, path) down to the requested leaves (g, rank, asked): rows asked, subroot, digest and
    path, an array of (before, after) from the root to the leaf. A rank of a group is requested once at most."""
    wanted, asked = [requests.select("g", "rank", "asked")], ["asked"]
    for _ in records:
        digits = F.collect_list(F.struct((F.col("rank") % FAN).cast("int").alias("digit"), *asked))
        wanted.append(cut(wanted[-1].groupBy("g", F.floor(F.col("rank") / FAN).alias("rank")).agg(digits.alias("digits"))))
        asked = []
    begin = lambda depth: starts.filter(F.col("depth") == depth).select("g", F.lit(0).cast("long").alias("rank"), "subroot", F.col("subroot").alias("digest"), "path")
    here = begin(len(records))
    for depth in range(len(records), 0, -1):
        found = spread_join(here.join(wanted[depth], ["g", "rank"]), records[depth - 1], ["digest"], "n")
        here = found.select("g", "subroot", F.inline(F.transform("digits", _enters if depth > 1 else _met)))
        if depth > 1:  # groups of fewer levels begin where they stand
            here = here.unionByName(begin(depth - 1))
    cols = ["asked", "subroot", "digest", "path"]
    alone = begin(0).join(wanted[0], ["g", "rank"]).select(*cols)
    return here.select(*cols).unionByName(alone) if records else alone


def siblings(path: Column) -> Column:
    """What a proof holds, from the leaf's level to the root's."""
    return F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.reverse(path), leaf, lambda h, s: digest(s["before"], h, s["after"]))


def group_key(group: Column) -> Column:
    """Never null, ordered as the groups are by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(docs: DataFrame, payload: Column | None = None, group: str = "source", id: str = "doc_id") -> dict:
    """leaves (g, id, leaf, payload, rank), records of the groups' trees by level, sources (g, subroot, depth, srank), and the
    records (above) of the tree over them with its root, null for an empty table. ``payload`` rides along as text."""
    payload = F.lit(None).cast("string") if payload is None else payload
    # stored before they are sorted, as a sort by ranges reads its input twice
    leaves = ranked(written(docs.select(group_key(F.col(group)).alias("g"), F.col(id).cast("long").alias("id"), leaf_digest().alias("leaf"), payload.alias("payload"))))
    records, tops = build(leaves)
    tops = cut(tops)
    order = ranked(tops.select(F.lit("").alias("g"), F.lit(None).cast("long").alias("id"), F.col("g").alias("leaf"), F.lit(None).cast("string").alias("payload")))
    sources = cut(tops.join(order.select(F.col("leaf").alias("g"), F.col("rank").alias("srank")), "g"))
    above, root = build(sources.select(F.lit("").alias("g"), F.col("srank").alias("rank"), F.col("subroot").alias("leaf")))
    one = root.first()
    return {"leaves": leaves, "records": records, "sources": sources, "above": above, "root": one and one.subroot, "top": root}


def proofs(made: dict, requests: DataFrame) -> DataFrame:
    """For requests (g, rank, asked) of a manifest: asked, leaf, subroot, root, path (from the root down)."""
    none = F.array().cast("array<struct<before:string,after:string>>")
    whom = made["sources"].select(F.lit("").alias("g"), F.col("srank").alias("rank"), F.struct("g", "depth").alias("asked"))
    starts = descend(made["top"].withColumn("path", none), made["above"], whom)
    down = descend(cut(starts.select("asked.g", F.col("digest").alias("subroot"), "asked.depth", "path")), made["records"], requests)
    return down.select("asked", F.col("digest").alias("leaf"), "subroot", F.lit(made["root"]).alias("root"), "path")


def tampered(text: Column) -> Column:
    """A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """A row per document: its digests, the digest of its proof, and the root that its proof gives from the leaf as it is after
    the tampering of every fifth document or so."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, F.when(hit, leaf_digest(text=tampered(F.col("text")))))
    all_of_them = made["leaves"].select("g", "rank", F.struct("id", "payload").alias("asked"))
    p = proofs(made, all_of_them)
    p = p.select(
        F.col("asked.id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("asked.payload", "leaf"), F.col("path")).alias("folded_root"),
    )
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))
