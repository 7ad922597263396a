"""Removal of long repeated byte strings by a sparse suffix array with deep-shallow sorting.

Two equal strings of ``LENGTH`` bytes have their anchor, the byte with the smallest hash of the ``GRAM`` bytes after it,
at the same place. So only suffixes at anchors are sorted, about one in 90 bytes, and the windows that share an anchor
are compared together:

1. Each task finds its documents' anchors and, for each, the run of windows that it owns. Anchors whose owned text was
   met before in the task are decided there; one row of each goes on, so a group of copies costs a row per task.
2. Rows meet by the anchor's hash, in order, and are read as a stream. Owned texts met twice are repeated as a whole;
   anchors met once are not. What is left shares its anchor with others that own different text.
3. Of those, the owned text is fetched and sorted, the part from the anchor on and the reversed part before it: deep-
   shallow sorting, multikey quicksort for the first ``SHALLOW`` bytes and a blind trie for groups that agree so far.
   The common prefixes of neighbours tell, for each window, whether another one equals it. A hot anchor, one of more
   than ``GROUP`` different owned texts, is split before its texts are fetched: its windows are dealt by their hash over
   all tasks and counted, so no task sorts a group that grows with the corpus.

Each document's covered bytes are then cut out. Equality of owned texts and of a hot anchor's windows is that of two
independent 64-bit hashes.

Defined cases: null text is empty; a text under ``LENGTH`` bytes has no match; two rows of equal text are two documents,
so both lose all windows (there is no tie to break); overlapping matches in one document count; very long texts are read
in blocks of ``BLOCK`` bytes; columns other than doc_id and text are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import blank_null, cut, keyed, map_batches, map_rows, spread_join, written

LENGTH, GRAM, SHALLOW, GROUP = 200, 24, 32, 20_000
WIDTH = LENGTH - GRAM + 1  # places for an anchor in a window
BLOCK = 1 << 23
SEEN = 400_000  # owned texts that a task remembers at once
MAX_SENT = 50_000  # hot anchors that are sent to all tasks
_PLACE = np.uint64((1 << 24) - 1)
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)]


def anchors(data: bytes) -> list[tuple[int, int, int, int]]:
    """(hash, place, bytes before it that its first window starts, number of its windows less one) in order."""
    out: list[tuple[int, int, int, int]] = []
    for base in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[base : base + BLOCK + LENGTH - 1]
        n = len(part) - GRAM + 1
        words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        h = words[:n] * _C[0] + words[8 : 8 + n] * _C[1] + words[16 : 16 + n] * _C[2]
        h ^= h >> np.uint64(32)
        h *= _C[3]
        h ^= h >> np.uint64(29)
        least, span = (h & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= WIDTH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WIDTH:
            least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span :])
        at = (least & _PLACE).astype(np.int64)  # of each window's anchor
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:], [len(at)]]) - 1
        spot = at[first]
        out += zip(h[spot].astype(np.int64).tolist(), (spot + base).tolist(), (spot - first).tolist(), (last - first).tolist(), strict=True)
    return out


def _pack(place: int, back: int, more: int) -> int:
    return place << 16 | back << 8 | more


def _unpack(x: int) -> tuple[int, int, int]:
    return x >> 16, x >> 8 & 255, x & 255


ROWS = "kind int, h long, own long, __id long, __key long, at long"
#: kinds of rows: decided (all owned windows repeat), met once, met before with the same owned text
DECIDED, ONCE, AGAIN = 0, 1, 2


def _first_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[int, int], list] = {}
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        rows = done + [(x[3], k[0], k[1], x[0], x[1], x[2]) for k, x in seen.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        done.clear()
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.int64()] * 5, strict=True)], ["kind", "h", "own", "__id", "__key", "at"])

    for b in it:
        for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            data = text.as_py().encode()
            for h, place, back, more in anchors(data):
                start = place - back
                own = xxhash.xxh64_intdigest(data[start : start + more + LENGTH], back << 8 | more)
                k, at = (h, own - (1 << 64) if own >> 63 else own), _pack(place, back, more)
                x = seen.get(k)
                if x is None:
                    seen[k] = [row, key, at, ONCE]
                else:
                    if x[3] == ONCE:
                        x[3] = AGAIN
                        done.append((DECIDED, key ^ x[2], 0, x[0], x[1], x[2]))
                    done.append((DECIDED, key ^ at, 0, row, key, at))
            if len(seen) > SEEN or len(done) > SEEN:
                yield batch()
    yield batch()


def _second_pass(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of h and own. Out: decided ones, and those that need a look (their h is shared, their own text is not)."""
    out: list[tuple] = []
    h = own = None
    lone = None  # the open run's only row so far, if met once
    shared = False  # whether h has had another own text
    shown = False  # whether the open run has given a row to be looked at

    def look(x: tuple, n: int) -> None:
        # of an own text that is decided, one row still takes part, for others to be compared to
        out.append((n, x[1], x[3], x[4], x[5]))

    head = None  # first row of the open run
    pending = None  # first run of this h, not shown yet, as (row, kind)

    def close_run() -> None:
        nonlocal pending, shown
        if head is None:
            return
        kind = ONCE if lone is not None else AGAIN
        if shared:
            look(head, kind)
        else:
            pending = (head, kind)

    for b in it:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if x[0] == DECIDED:
                out.append((DECIDED, 0, x[3], x[4], x[5]))
                continue
            if x[1] != h:
                close_run()
                h, own, head, lone, shared, pending = x[1], x[2], x, x if x[0] == ONCE else None, False, None
            elif x[2] != own:
                close_run()
                if pending is not None:
                    look(*pending)
                    pending = None
                own, head, lone, shared = x[2], x, x if x[0] == ONCE else None, True
            else:
                if lone is not None:
                    out.append((DECIDED, 0, lone[3], lone[4], lone[5]))
                    lone = None
                if x[0] == ONCE:
                    out.append((DECIDED, 0, x[3], x[4], x[5]))
        if out:
            yield _looked(out)
            out.clear()
    close_run()
    yield _looked(out)


def _looked(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] + [pa.int64()] * 4, strict=True)], ["kind", "h", "__id", "__key", "at"])


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo = 0
    while n - lo > 1:  # a and b agree up to lo, and differ before n
        mid = (lo + n) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            n = mid
    return lo


def _blind_trie(texts: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of a group that agrees up to ``depth``: a trie that keeps branching bytes and lengths only."""
    tree = None  # (length, {byte: child}) inside, a list of equal texts as a leaf; byte -1 where a text ends
    for i in group:
        s = texts[i]
        if tree is None:
            tree = [i]
            continue
        byte = lambda x, n: x[n] if n < len(x) else -1
        node = tree
        while isinstance(node, tuple):  # blind descent to some leaf
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        other = texts[node[0]]
        same = depth + _common(s[depth:], other[depth:])
        if same == len(s) == len(other):
            node.append(i)
            continue
        up, node = None, tree
        while isinstance(node, tuple) and node[0] < same:
            up, node = (node, byte(s, node[0])), node[1][byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte(s, same)] = [i]
        else:
            fork = (same, {byte(other, same): node, byte(s, same): [i]})
            if up is None:
                tree = fork
            else:
                up[0][1][up[1]] = fork
    order, stack = [], [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            order += node
        elif node:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return order


def deep_shallow(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``texts``, and the common prefix of each with the one before it in that order."""
    order: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1 or depth < 0:  # below 0: all of them are equal
            order += group
        elif depth >= SHALLOW:
            order += _blind_trie(texts, group, depth)
        else:  # multikey quicksort, four bytes at a time
            key = [texts[i][depth : depth + 4] for i in group]
            pivot = key[len(key) // 2]
            less = [i for i, k in zip(group, key, strict=True) if k < pivot]
            same = [i for i, k in zip(group, key, strict=True) if k == pivot]
            more = [i for i, k in zip(group, key, strict=True) if k > pivot]
            if more:
                stack.append((more, depth))
            stack.append((same, depth + 4 if len(pivot) == 4 else -1))
            if less:
                stack.append((less, depth))
    lcp = [0] + [_common(texts[a], texts[b]) for a, b in zip(order, order[1:], strict=False)]
    return np.array(order), np.array(lcp)


def repeated_windows(members: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """For members (owned text, bytes before the anchor, windows less one), which of their windows another member has."""
    right = [t[back:] for t, back, _ in members]
    left = [t[:back][::-1] for t, back, _ in members]
    back = np.array([x[1] for x in members])
    more = np.array([x[2] for x in members])
    found = [np.zeros(x[2] + 1, bool) for x in members]
    ranks = []
    for texts in (right, left):
        order, lcp = deep_shallow(texts)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ranks.append((rank, lcp))
    first, last = -int(back.max()), int((more - back).max())
    step = max(1, 400_000 // len(members))
    for at in range(first, last + 1, step):  # a row per offset, a column per member
        offset = np.arange(at, min(at + step, last + 1))[:, None]
        name = np.zeros((len(offset), len(members)), np.int64)
        for (rank, lcp), depth in zip(ranks, (LENGTH + offset, -offset), strict=True):
            name = name * (len(members) + 1) + np.cumsum(lcp[None, :] < depth, axis=1)[:, rank]
        away = (offset < -back) | (offset > more - back)
        name[away] = -1 - np.nonzero(away)[1]  # members without a window there stand alone
        order = np.argsort(name, axis=1, kind="stable")
        sorted_ = np.take_along_axis(name, order, 1)
        same = sorted_[:, 1:] == sorted_[:, :-1]
        twice = np.zeros(name.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        rows, cols = np.nonzero(twice)
        for o, i in zip((rows + at).tolist(), order[rows, cols].tolist(), strict=True):
            found[i][o + members[i][1]] = True
    return found


def _third_pass(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in order of h. Out: covered bytes."""
    group: list[tuple] = []
    out: list[tuple] = []

    def close() -> None:
        marks = repeated_windows([(x[5], *_unpack(x[4])[1:]) for x in group]) if len(group) > 1 else []
        for x, mark in zip(group, marks, strict=False):
            if x[1] != ONCE:
                continue
            place, back, _ = _unpack(x[4])
            on = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
            out.extend((x[2], x[3], place - back + a, place - back + z - 1 + LENGTH) for a, z in zip(on[::2].tolist(), on[1::2].tolist(), strict=True))
        group.clear()

    for b in it:
        for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if group and x[0] != group[0][0]:
                close()
            group.append(x)
        if len(out) > 100_000:
            yield out
            out = []
    close()
    yield out


SPANS = "__id long, __key long, start long, stop long"


def _owned(data: bytes, at: int) -> bytes:
    place, back, more = _unpack(at)
    return data[place - back : place - back + more + LENGTH]


def covered(texts: DataFrame) -> DataFrame:
    """__id, __key, start and stop of byte runs that repeat; they may overlap. ``texts`` has __id, __key and text."""
    met = texts.mapInArrow(_first_pass, ROWS).repartition("h").sortWithinPartitions("h", "own").mapInArrow(_second_pass, "kind int, h long, __id long, __key long, at long")
    met = written(met)
    place, back, more = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    whole = met.filter(F.col("kind") == DECIDED).select("__id", "__key", (place - back).alias("start"), (place - back + more + LENGTH).alias("stop"))
    look = met.filter(F.col("kind") != DECIDED)
    hot = cut(look.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).drop("n"))  # a row for GROUP others at most
    some = hot.count()
    if some:
        hot = F.broadcast(hot) if some <= MAX_SENT else hot
        spread = _windows(look.join(hot, "h", "left_semi"), texts)
        look = look.join(hot, "h", "left_anti")

    def owned(cols: list[list]) -> Iterator[tuple]:
        for row, key, text, own in zip(*cols, strict=True):
            data = text.encode()
            for x in own:
                yield x["h"], x["kind"], row, key, x["at"], _owned(data, x["at"])

    fetched = map_rows(_with_text(look, texts), "h long, kind int, __id long, __key long, at long, data binary", owned)
    small = map_batches(fetched.repartition("h").sortWithinPartitions("h", "__id", "__key", "at"), SPANS, _third_pass)
    return whole.union(small).union(spread) if some else whole.union(small)


def _with_text(look: DataFrame, texts: DataFrame) -> DataFrame:
    own = look.groupBy("__id", "__key").agg(F.collect_list(F.struct("kind", "h", "at")).alias("look"))
    return texts.join(own, ["__id", "__key"]).select("__id", "__key", "text", "look")


def _windows(look: DataFrame, texts: DataFrame) -> DataFrame:
    """The windows of hot anchors, each dealt by its hash, that another one equals."""

    def each(cols: list[list]) -> Iterator[tuple]:
        for row, key, text, own in zip(*cols, strict=True):
            data = text.encode()
            for x in own:
                (spot, back, more), part = _unpack(x["at"]), _owned(data, x["at"])
                for k in range(more + 1):
                    w = xxhash.xxh64_intdigest(part[k : k + LENGTH], 1)
                    yield x["h"], w - (1 << 64) if w >> 63 else w, row, key, spot - back + k, x["kind"]

    every = written(map_rows(_with_text(look, texts), "h long, window long, __id long, __key long, start long, kind int", each))
    often = cut(every.groupBy("h", "window").agg(F.count("*").alias("n"), F.max("kind").alias("most")).filter(f"n > 1 or most = {AGAIN}").drop("most"))
    return spread_join(every, often, ["h", "window"], "n").select("__id", "__key", "start", (F.col("start") + LENGTH).alias("stop"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _joined(spans: list | None, n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted((x["start"], x["stop"]) for x in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(z, out[-1][1])
        else:
            out.append((a, z))
    return out


def suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row."""

    def rows(cols: list[list]) -> Iterator[tuple]:
        for row, text, spans in zip(*cols, strict=True):
            data = text.encode()
            runs, kept, at = _joined(spans, len(data)), hashlib.sha256(), 0
            for a, z in runs:
                kept.update(data[at:a])
                at = z
            kept.update(data[at:])
            yield None if row == -(1 << 63) else row, len(data), sum(z - a for a, z in runs), len(runs), kept.hexdigest()

    texts = keyed(docs.select("doc_id", "text")).select("__id", "__key", blank_null().alias("text"))
    spans = covered(texts).groupBy("__id", "__key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return map_rows(texts.join(spans, ["__id", "__key"], "left").select("__id", "text", "spans"), RESULT, rows)
