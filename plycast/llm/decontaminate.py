"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: numbers (in digits or English words, a run of words being one), names (runs of words capitalised
inside a sentence) and units (after a number, or glued to it, or a sign like that of a currency) become typed placeholders,
all other words their lower-case letters without outer punctuation. Windows of ``WINDOW`` canonical
words of the documents are hash-joined to those of the benchmark. A match carries the values in the slots of both
sides; along one alignment, each value of the item must stand for one value of the document and the other way round,
else the windows with that slot do not count. A document leaks an item if matching windows make up ``SHARE`` of the item's windows.

A Bloom filter, sized by the number of the benchmark's windows up to a fixed bound, keeps most document windows from
being shuffled at all; the join after it is exact and needs no broadcast. Items that differ in their slots' values only are one
template and are told apart again at the end. Documents meet templates at the templates' rarest windows, as many as a
leaking document cannot lack; only for the pairs so found are all windows looked up.

Placeholders alone would miss copies of short items, where a first word may count as a name on one side only, and of items
of numbers and names. Items of one window at most, or without a window of ``LITERALS`` words besides placeholders, are
therefore looked for by exact windows too: lower-case words without outer punctuation, numbers and names as they are.

Defined cases: null or short texts have no windows; an item of fewer than ``WINDOW`` words is one window of its own
length, and one of fewer than ``LITERALS`` words is looked for word by word only; repeated rows (same doc_id and text) are one
document; very long texts are windowed whole; an empty table on either side gives an empty result (``drop_contaminated``:
all rows); other columns are not looked at and, whatever their names, kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plycast.llm.common import cut, keyed, map_rows, spread_join, unpacked

WINDOW, LITERALS, SHARE = 8, 4, 0.5
#: Bits of the Bloom filter: 16 for each benchmark window, at least and at most so many (64 MB, for 33 million windows).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
_UNITS = frozenset("mm cm m km in ft mi mg g kg lb lbs oz ml l s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters kilometre kilometres kilometers mile miles foot feet inch inches gram grams kilogram kilograms kilograms pound pounds litre litres liter liters dollar dollars euro euros cent cents percent degree degrees mph kmh".split())
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*[a-z%]{0,3}")
#: Numbers as English words (fixed values).
_COUNTS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
#: Signs that stand for units (fixed values).
_SIGNS = {"$": "dollars", "€": "euros", "£": "pounds", "%": "percent", "°": "degrees"}
#: A number with a sign before it or a sign or letters behind it, without a gap.
_GLUED = re.compile(r"([$€£])?([+-]?\d(?:[\d.,:/]*\d)?)([a-z]+|[€$£%°])?")
_DIGIT = re.compile(r"\d")
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x, 7)) for x in ("<number>", "<name>", "<unit>"))
_EXACT = np.uint64(xxhash.xxh64_intdigest("<exact>", 7))  # keeps exact windows apart from the others
_IS_NUM, _IS_NAME, _IS_UNIT, _ENDS, _IS_GLUED, _IS_COUNT = (np.uint64(1 << k) for k in range(6))
_FLAGS = np.uint64(63)
_OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¿¡«»„“”‘’…–—"


_BESIDE = "".join(c for c in _OUTER if c not in "$%+-")


def _apart(word: str) -> list[str] | None:
    """The number and the unit of a word that has both, the end of the sentence kept."""
    core = word.strip(_BESIDE)
    met = _GLUED.fullmatch(core.lower())
    if not met or bool(met[1]) == bool(met[3]):
        return None
    unit = _SIGNS.get(met[1] or met[3], met[3])
    if unit not in _UNITS:
        return None
    tail = word.rstrip("\"')»“”’")[-1:]
    return [met[2], unit + (tail if tail in tuple(".!?:…") else "")]


class _Forms(dict):
    """A word's hash with flags in its lowest bits; 0 for a word of punctuation alone."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        core = word.strip(_OUTER)
        low = core.lower()
        if not core:
            form = 0
        else:
            number = bool(_NUMBER.fullmatch(low))
            count = low in _COUNTS or "-" in low and all(x in _COUNTS for x in low.split("-"))
            name = not number and core[0].isupper() and core[1:].islower()
            form = xxhash.xxh64_intdigest(low, 7) & ~63 | number | name << 1 | (low in _UNITS) << 2 | (word.rstrip("\"')»“”’")[-1:] in tuple(".!?:…")) << 3
            form |= (_DIGIT.search(low) is not None and _apart(word) is not None) << 4 | count << 5
            form = form or 64
        self[word] = form
        return form


_FORMS = _Forms()


def _forms(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_FORMS.__getitem__, words), np.uint64, len(words))


def canonical(text: str) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Canonical hashes, whether each is a placeholder, the words they came from, and the words' own hashes. A number that a
    unit is glued to becomes two words; a run of number words, or of names, becomes one."""
    words = text.split()
    form = _forms(words)
    if not form.all():
        words = [w for w, f in zip(words, form, strict=True) if f]
        form = form[form > 0]
    if not len(form):
        return form, form > 0, words, form
    if (form & _IS_GLUED).any():
        words = [x for w, glued in zip(words, (form & _IS_GLUED > 0).tolist(), strict=True) for x in (_apart(w) if glued else [w])]
        form = _forms(words)
    before = lambda x: np.concatenate([[False], x[:-1]])
    count = form & _IS_COUNT > 0
    number = (form & _IS_NUM > 0) | count
    starts = np.concatenate([[True], form[:-1] & _ENDS > 0])
    unit = (form & _IS_UNIT > 0) & before(number)
    name = (form & _IS_NAME > 0) & ~starts & ~unit & ~number
    own = form & ~_FLAGS
    on = (count & before(number) | name & before(name)) & ~starts
    if on.any():  # the rest of a run goes into its first word
        first = np.flatnonzero(~on)
        ends = np.append(first[1:], len(words))
        words = [words[i] if k == i + 1 else " ".join(w.strip(_OUTER) for w in words[i:k]) for i, k in zip(first.tolist(), ends.tolist(), strict=True)]
        joined = own[first]
        for at in np.flatnonzero(ends - first > 1).tolist():
            joined[at] = np.bitwise_xor.reduce(own[first[at] : ends[at]] * (2 * np.arange(ends[at] - first[at], dtype=np.uint64) + np.uint64(1)))
        own, number, unit, name = joined, number[first], unit[first], name[first]
    out = own.copy()
    for mask, value in ((number, _NUM), (unit, _UNIT), (name, _NAME)):
        out[mask] = value
    return out, number | unit | name, words, own


def windows(tokens: np.ndarray, slots: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows, and which have words enough besides placeholders."""
    n = len(tokens) - size + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, bool)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = (h ^ tokens[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    filled = np.concatenate([[0], np.cumsum(slots)])
    return h, size - (filled[size:] - filled[:-size]) >= min(LITERALS, size)


def exact_windows(own: np.ndarray, size: int) -> np.ndarray:
    return windows(own, np.zeros(len(own), bool), size)[0] ^ _EXACT


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(34) & np.uint64(bits - 1)).astype(np.int64)


def bloom_of(bench: DataFrame) -> np.ndarray:
    """The filter's bytes, put together from parts of at most 64 KB that tasks have filled."""
    bits = LEAST_BITS
    n = bench.select("h").distinct().count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    at = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 34).bitwiseAND(bits - 1)))

    def filled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in it:
            x = np.unique(b.column(0).to_numpy())
            for part in np.unique(x >> 19):
                own = x[x >> 19 == part] & ((1 << 19) - 1)
                np.bitwise_or.at(parts.setdefault(int(part), np.zeros(1 << 16, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.tobytes() for p in parts.values()], pa.binary())], ["part", "bytes"])

    parts = bench.select(at.alias("bit")).distinct().repartition(F.shiftright("bit", 19)).select("bit").mapInArrow(filled, "part long, bytes binary")
    bloom = np.zeros(bits // 8, np.uint8)
    for part, held in parts.toLocalIterator():
        own = bloom[part << 16 : (part + 1) << 16]
        own |= np.frombuffer(held, np.uint8)[: len(own)]
    return bloom


def _values(words: list[str], slots: np.ndarray, at: int, size: int) -> list[str]:
    return [words[k].strip(_OUTER).lower() for k in range(at, at + size) if slots[k]]


def benchmark_windows(items: DataFrame) -> DataFrame:
    """The windows of each item. Items of one ``template`` have the same windows, and values in their slots that are equal or
    differ at the same places, so that they leak alike; the values themselves are numbered from the item's start."""

    def rows(cols: list[list]) -> Iterator[tuple]:
        for item_id, text in zip(*cols, strict=True):
            tokens, slots, words, own = canonical(text or "")
            size = min(WINDOW, len(tokens))
            if not size:
                continue
            h, good = windows(tokens, slots, size)
            good &= size >= LITERALS
            n, number = int(good.sum()), {}
            held = [(at, size, False, n, int(h[at].astype(np.int64)), [str(number.setdefault(v, len(number))) for v in _values(words, slots, at, size)]) for at in np.flatnonzero(good).tolist()]
            if not n or len(h) == 1:
                h = exact_windows(own, size)
                held += [(at, size, True, len(h), x, []) for at, x in enumerate(h.astype(np.int64).tolist())]
            template = xxhash.xxh3_128_hexdigest(repr(held))
            for row in held:
                yield item_id, template, *row

    return map_rows(items.select(F.col("item_id").cast("long"), "text"), "item_id long, template string, item_at int, size int, exact boolean, n_windows int, h long, item_slots array<string>", rows)


def candidates(found: DataFrame, bench: DataFrame, share: float) -> DataFrame:
    """__id, text_key and template of all that can reach ``share``. To do so with k of a template's m windows, a document must
    hold one of any m - k + 1 of them: the rarest are taken, so that a window of very many templates and documents makes
    pairs only for templates that have nothing rarer."""
    seen = found.groupBy("h").agg(F.count("*").alias("n"))
    all_of = Window.partitionBy("template")  # an item's windows
    rank = F.row_number().over(all_of.orderBy(F.coalesce("n", F.lit(0)), "item_at", "exact"))
    most = F.count("*").over(all_of) - F.greatest(F.ceil(F.col("n_windows") * share), F.lit(1)) + 1
    rare = cut(bench.join(seen, "h", "left").withColumns({"rank": rank, "most": most}).filter("rank <= most and n is not null").select("h", "template", "n").distinct())
    return spread_join(found.select("__id", "text_key", "h"), rare, ["h"], "n").select("__id", "text_key", "template").distinct()


def leaking_templates(docs: DataFrame, items: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """A row for each document and each template that it leaks, and the items of the templates."""
    held_by = cut(benchmark_windows(items))
    bench = held_by.drop("item_id").distinct()
    sizes = [tuple(r) for r in bench.select("size", "exact").distinct().collect()]  # twice WINDOW values at most
    bloom = bloom_of(bench)
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def rows(cols: list[list]) -> Iterator[tuple]:
        bits = held.value
        for doc_id, key, text in zip(*cols, strict=True):
            tokens, slots, words, own = canonical(text or "")
            none = np.zeros(len(slots), bool)
            for size, exact in sizes:
                held_in = none if exact else slots
                h, good = windows(tokens, slots, size) if not exact else (exact_windows(own, size), np.ones(max(len(own) - size + 1, 0), bool))
                if not len(h):
                    continue
                a, b = _bits(h, 8 * len(bits))
                good &= (bits[a >> 3] >> (a & 7).astype(np.uint8) & 1 > 0) & (bits[b >> 3] >> (b & 7).astype(np.uint8) & 1 > 0)
                for k in np.flatnonzero(good).tolist():
                    yield doc_id, key, k, int(h[k].astype(np.int64)), _values(words, held_in, k, size)

    own = keyed(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("__key").alias("text_key"), "text")
    found = map_rows(own, "doc_id long, text_key long, doc_at int, h long, doc_slots array<string>", rows)
    found = cut(found.withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63)))))
    near = cut(candidates(found, bench, share))
    asked = cut(bench.join(near.groupBy("template").agg(F.count("*").alias("n")), "template"))
    both = spread_join(near, asked, ["template"], "n").join(found, ["__id", "text_key", "h"])
    both = cut(both.filter(F.size("doc_slots") == F.size("item_slots")).withColumn("line", F.col("doc_at") - F.col("item_at")).distinct())
    on = ["__id", "text_key", "template", "line"]
    # one value on either side for each value on the other
    pairs = both.select(*on, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*on, F.col("s.item_slots").alias("item"), F.col("s.doc_slots").alias("doc")).distinct()
    good = both
    for own, other, slots in (("item", "doc", "item_slots"), ("doc", "item", "doc_slots")):
        torn = pairs.groupBy(*on, own).agg(F.count(other).alias("n")).filter("n > 1").groupBy(*on).agg(F.collect_set(own).alias("torn"))
        good = good.join(torn, on, "left").filter(f"torn is null or not arrays_overlap({slots}, torn)").drop("torn")
    hits = good.groupBy("doc_id", "text_key", "template").agg(
        F.countDistinct("item_at").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.min("doc_at").cast("long").alias("first_word"),
        (F.max(F.col("doc_at") + F.col("size"))).cast("long").alias("end_word"), F.count_distinct(F.when(F.size("item_slots") > 0, F.col("item_at"))).alias("n_slotted"))
    return hits.filter(F.col("n_matched") >= share * F.col("n_windows")), held_by.select("item_id", "template").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """A row for each document and each item that it leaks; ``text_key`` tells apart texts under one doc_id. If an item_id has
    several texts, the row is that of the one with the most windows matched."""
    hits, items_of = leaking_templates(docs, items, share)
    figures = ("n_matched", "n_windows", "first_word", "end_word", "n_slotted")
    one = hits.join(items_of, "template").groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct(*figures)).alias("x"))
    return one.select("doc_id", "text_key", "item_id", *(f"x.{c}" for c in figures))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that leak no item, with the same columns."""
    bad = leaking_templates(docs, items, share)[0].select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("text_key").alias("__key")).distinct()
    return keyed(docs).join(bad, ["__id", "__key"], "left_anti").select(*unpacked(docs))
