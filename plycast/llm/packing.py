"""Best-two-fit packing of token sequences.

Documents are tokenized and only longer ones are cut. Pieces are then dealt evenly into groups of at most
``GROUP`` pieces, and each group is packed by itself: a bin is filled greedily with the longest piece that fits;
then its smallest piece is replaced by two unpacked pieces if they fill the gap that it leaves more tightly.
The unused end of one bin per group is what the split into groups can cost.

Defined cases: a null or empty text becomes one piece of the closing id alone; repeated rows are packed each; a very long
text is cut into pieces of ``capacity``; pieces of one length are alike to the packing; columns other than doc_id and text
are not looked at; a null doc_id stays null; an empty table gives an empty table.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import cut, map_rows

MODEL = "word_bpe_49k.json"
CAPACITY = 2048
GROUP = 50_000
END = struct.pack("<I", 0)
#: Bytes of words and ids that a worker remembers, about; longer words are looked up each time.
MAX_BYTES, LONG = 240_000_000, 100
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ASCII marks that the vocabulary's splitter keeps apart from letters before them; "'" and "<" can begin more.
_MARKS = b"!\"#$%&()*+,-./:;=>?@[\\]^`{|}~"


class Words(dict):
    """Token ids of words, packed as little-endian 32-bit numbers. The tokenizer splits at white space."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library, self.held = Tokenizer.from_file(path), 0

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(_MARKS)
        text = core.decode()
        # letters that the library's normaliser splits up or joins are left to it together with what follows them
        plain = text.isalpha() and (low := text.lower()).isalpha() and "Σ" not in text and all(unicodedata.is_normalized("NFC", x) for x in (text, low))
        if plain and len(core) < len(word):
            ids = self[core] + self[word[len(core) :]]
        elif plain and low != text:
            ids = self[low.encode()]
        else:
            ids = self.encoded(word.decode())
        if len(word) < LONG:
            self.held += len(word) + len(ids) + 150
            if self.held > MAX_BYTES:
                self.clear()
                self.held = 0
            self[word] = ids
        return ids

    def encoded(self, text: str) -> bytes:
        got = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(got)}I", *got)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(1)
def words_of(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, model: str = MODEL, capacity: int = CAPACITY) -> DataFrame:
    def rows(cols: list[list]) -> Iterator[tuple]:
        import public_tokenizers

        words = words_of(model if "/" in model else public_tokenizers.path(model))
        for doc_id, text in zip(*cols, strict=True):
            ids = words.ids(text or "") + END
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), PIECES, rows)


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes into ``lengths`` (1 to capacity each)."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(n, []).append(i)
    there = mirror = 0  # bit n: pieces of length n wait; bit capacity - n: the same, mirrored
    for n in waiting:
        there |= 1 << n
        mirror |= 1 << (capacity - n)

    def take(n: int) -> int:
        nonlocal there, mirror
        i = waiting[n].pop()
        if not waiting[n]:
            there &= ~(1 << n)
            mirror &= ~(1 << (capacity - n))
        return i

    def give(n: int, i: int) -> None:
        nonlocal there, mirror
        waiting[n].append(i)
        there |= 1 << n
        mirror |= 1 << (capacity - n)

    bins = []
    while there:
        own, gap = [], capacity
        while fits := there & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            own.append((n, take(n)))
            gap -= n
        if gap and own:
            small, i = own[-1]  # the last that fitted is the smallest
            for total in range(small + gap, small, -1):
                pair = there & (mirror >> (capacity - total))  # bit a: lengths a and total - a wait
                if total % 2 == 0 and pair >> (total // 2) & 1 and len(waiting[total // 2]) < 2:
                    pair &= ~(1 << (total // 2))
                if pair:
                    a = pair.bit_length() - 1
                    own[-1:] = [(a, take(a)), (total - a, take(total - a))]
                    give(small, i)
                    break
        bins.append([i for _, i in own])
    return bins


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Groups are dealt evenly, whatever the pieces are."""

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)  # ``group`` small rows, about
        lengths = t.column("length").to_pylist()
        first = TaskContext.get().partitionId() << 40
        order, seq, offset = [], [], []
        for k, own in enumerate(best_two_fit(lengths, capacity)):
            order += own
            seq += [first + k] * len(own)
            offset += [0, *accumulate(lengths[i] for i in own[:-1])]
        t = t.take(pa.array(order, pa.int64())).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from t.combine_chunks().to_batches(10_000)

    found = cut(found)
    groups = max(1, -(-found.count() // group))
    return found.repartition(groups).mapInArrow(packed, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, model: str = MODEL, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, model, capacity), capacity)
