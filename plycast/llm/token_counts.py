"""Token counts by a compiled finite-state transducer.

The vocabulary's pieces are compiled into a deterministic transducer over characters. A state is a node of the pieces'
Aho-Corasick automaton (the longest end of what was read that can still grow into a piece) and, for each of that end's
places where a piece may yet begin, the last token of the text up to there and how many tokens fewer it has. Of the
pieces that end at a character exactly one may follow the token before it, as two tokens stand side by side in a
tokenized text if and only if their joined text is tokenized into these two. So the next state is determined, and the
transition is annotated with the number of tokens that it adds (0 or less where pieces join). Transitions are compiled
from pieces and merge scores when first taken; the vocabulary's library only reads the file.

Between two characters that no piece holds next to each other the machine is in a state that does not depend on what
came before. A chunk of text therefore maps any state to (head before its first such place, tokens between, tail after
its last); only head and tail are left to be run when the neighbours are known. Such maps compose associatively. Texts
above ``CHUNK`` characters are dealt out as rows of chunks, which Spark maps in parallel and composes in rounds of
``FAN`` neighbours; shorter ones are counted where they stand.

Defined cases: a null text counts as empty and has 0 tokens and 0 bytes; repeated rows each get a row; a null doc_id
stays null; very long texts cost time in proportion and no task more than a chunk, unless they hold no boundary at all;
columns other than doc_id and text are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import blank_null, cut, keyed, map_batches, map_rows

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK = 1 << 16
FAN = 64
#: Bounds of what a worker remembers: compiled states, and bytes of segments with known counts, about.
MAX_STATES, MAX_BYTES = 220_000, 100_000_000
_SPACE = "▁"
_ANY = -1  # the last token where no piece can reach back over the boundary
#: What a chunk maps to: (head, None, "") if it has no boundary, else (head, tokens, tail).
Map = tuple[str, int | None, str]


class State(dict):
    """Transitions: character to (next state, tokens added). ``back``: for each place where a piece may begin, by its
    distance, the last token before it and the number of tokens up to it less those up to here."""

    __slots__ = ("back", "machine", "node")

    def __init__(self, machine: Transducer, node: int, back: dict[int, tuple[int, int]]):
        super().__init__()
        self.machine, self.node, self.back = machine, node, back

    def __missing__(self, char: str) -> tuple[State, int]:
        arc = self[char] = self.machine.compiled(self, char)
        return arc


class Transducer:
    """Counts the tokens of whole texts from pieces and their merge scores."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = {p: k for k, p in enumerate(pieces)}
        self.names, self.scores = list(pieces), pieces
        if any(c not in pieces for p in pieces for c in p) or any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in pieces):
            raise ValueError("a vocabulary of another kind")
        self.known = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self._automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.bare, self.spaced = _Counts(self, ""), _Counts(self, _SPACE)
        self.states: dict[tuple, State] = {}
        self._forget()

    def _automaton(self) -> None:
        goto, depth, ends = [{}], [0], [-1]
        for p, k in self.pieces.items():
            at = 0
            for c in p:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    depth.append(depth[at] + 1)
                    ends.append(-1)
                at = goto[at][c]
            ends[at] = k
        back, queue = [0] * len(goto), list(goto[0].values())
        for at in queue:
            for c, to in goto[at].items():
                x = back[at]
                while x and c not in goto[x]:
                    x = back[x]
                back[to] = goto[x].get(c, 0)
                queue.append(to)
        self.goto, self.depth, self.ends, self.back = goto, depth, ends, back
        self.chains: dict[int, tuple] = {}

    def chain(self, node: int) -> tuple[tuple[int, ...], tuple[tuple[int, int], ...]]:
        """Lengths of the ends of a node's text that can grow into pieces, and those that are pieces; longest first."""
        if node not in self.chains:
            sizes, whole, at = [], [], node
            while at:
                sizes.append(self.depth[at])
                if self.ends[at] >= 0:
                    whole.append((self.ends[at], self.depth[at]))
                at = self.back[at]
            self.chains[node] = tuple(sizes), tuple(whole)
        return self.chains[node]

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by the rule itself: join the neighbours of highest score, leftmost first."""
        parts, score = list(text), self.scores.get
        joint = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while any(x is not None for x in joint):
            i = joint.index(max(x for x in joint if x is not None))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joint[i]
            if i:
                joint[i - 1] = score(parts[i - 1] + parts[i])
            if i < len(joint):
                joint[i] = score(parts[i] + parts[i + 1])
        return parts

    def follows(self, before: int, piece: int) -> bool:
        k = before, piece
        if k not in self.fits:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits.clear()
            own = [self.names[piece]] if before == _ANY else [self.names[before], self.names[piece]]
            if len(own) == 2 and own[0][-1] + own[1][0] not in self.known:  # nothing joins them; the piece stands by itself
                self.fits[k] = self.follows(_ANY, piece)
            else:
                self.fits[k] = self.merged("".join(own)) == own
        return self.fits[k]

    def _forget(self) -> None:
        """Memory stays bounded: what is forgotten is compiled again when met again."""
        for s in self.states.values():
            s.clear()
        self.states.clear()
        self.fresh = State(self, 0, {0: (_ANY, 0)})
        self.states[0, _ANY, ()] = self.fresh

    def compiled(self, s: State, char: str) -> tuple[State, int]:
        if len(self.states) > MAX_STATES:
            self._forget()
        node = s.node
        while node and char not in self.goto[node]:
            node = self.back[node]
        node = self.goto[node].get(char, 0)
        if not node:  # no piece holds this character: its bytes are the tokens
            return self.fresh, len(char.encode())
        sizes, whole = self.chain(node)
        back, last, added = s.back, None, 0
        for k, size in whole:
            before, fewer = back[size - 1]
            if self.follows(before, k):
                last, added = k, fewer + 1
                break
        if len(sizes) == 1:  # nothing from before the character can reach over it
            places = ((_ANY, -1),)
        else:
            places = tuple([(before, fewer - added) for before, fewer in [back[size - 1] for size in sizes]])
        key = node, last, places
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(self, node, dict(zip((0, *sizes), ((last, 0), *places), strict=True)))
        return to, added

    def run(self, text: str) -> int:
        """Tokens of a text whose first character no piece reaches over from before."""
        s, n = self.fresh, 0
        for c in text:
            s, k = s[c]
            n += k
        return n

    def chunk(self, text: str) -> Map:
        """Boundaries are between characters that no piece holds next to each other; white space gives most of them."""
        first = next((i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.known), None)
        if first is None:
            return text, None, ""
        last = next(i for i in range(len(text) - 1, 0, -1) if text[i - 1 : i + 1] not in self.known)
        return text[:first], self.segments(text[first:last]), text[last:]

    def segments(self, text: str) -> int:
        """Like ``run``; the counts of segments between spaces and line feeds are remembered."""
        lines = text.split("\n")
        total = len(lines) - 1
        for line in lines:
            words = line.split(_SPACE)
            if words[0]:
                total += self.bare[words[0]]
            if "" in words[1:]:
                total += sum(self.run(x) for x in re.findall(f"{_SPACE}+[^{_SPACE}]*", line[len(words[0]) :]))
            else:
                total += sum(map(self.spaced.__getitem__, words[1:]))
        return total

    def compose(self, maps: Iterable[Map]) -> Map:
        """The map of chunks that follow each other; work is in proportion to their heads and tails."""
        head: list[str] = []
        tail: list[str] = []
        tokens: int | None = None
        for h, n, t in maps:
            if tokens is None:
                head.append(h)
                if n is not None:
                    tokens, tail = n, [t]
            elif n is None:
                tail.append(h)
            else:
                tokens, tail = tokens + self.run("".join([*tail, h])) + n, [t]
        return "".join(head), tokens, "".join(tail)

    def total(self, m: Map) -> int:
        return self.run(m[0]) + (m[1] or 0) + self.run(m[2])

    def count(self, text: str, size: int = CHUNK) -> int:
        return self.total(self.compose(map(self.chunk, chunks(text, size)))) if len(text) > size else self.segments(spelled(text))


class _Counts(dict):
    def __init__(self, machine: Transducer, before: str):
        super().__init__()
        self.machine, self.before, self.held = machine, before, 0

    def __missing__(self, word: str) -> int:
        n = self.machine.run(self.before + word)
        if len(word) < 200:
            self.held += 4 * len(word) + 150
            if self.held > MAX_BYTES:
                self.clear()
                self.held = 0
            self[word] = n
        return n


def spelled(text: str) -> str:
    """As the vocabulary spells a text: a space before it, and a mark for each space."""
    return _SPACE + text.replace(" ", _SPACE) if text else ""


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    for at in range(0, len(text), size):
        part = text[at : at + size]
        yield part.replace(" ", _SPACE) if at else spelled(part)


@lru_cache(1)
def transducer(model: str) -> Transducer:
    """Compiled from a file of the tokenizer folder or from a path."""
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
    normal = (k for k in range(library.get_piece_size()) if not (library.is_unknown(k) or library.is_control(k) or library.is_byte(k) or library.is_unused(k)))
    return Transducer({library.id_to_piece(k): library.get_score(k) for k in normal})


def _counted(found: DataFrame, model: str) -> DataFrame:
    """Tokens of ``text`` for texts of one chunk."""

    def rows(cols: list[list]) -> Iterator[tuple]:
        t = transducer(model)
        for doc_id, size, text in zip(*cols, strict=True):
            yield doc_id, size, t.segments(spelled(text))

    return map_rows(found, "doc_id long, n_bytes long, n_tokens long", rows)


def _composed(maps: DataFrame, model: str) -> DataFrame:
    """Rows in order of a text and chunk: each ``FAN`` neighbours become one."""

    def batches(it: Iterator) -> Iterator:
        key, group = None, []

        def done() -> tuple:
            return (*key, *transducer(model).compose(group))

        for b in it:
            out = []
            for *k, at, head, tokens, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = (*k, at // FAN)
                if k != key:
                    if group:
                        out.append(done())
                    key, group = k, []
                group.append((head, tokens, tail))
            yield out
        if group:
            yield [done()]

    dealt = maps.repartition("__id", "__key", F.expr(f"at div {FAN}")).sortWithinPartitions("__id", "__key", "at")
    return map_batches(dealt, maps.schema, batches)


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, size: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``model`` is a file name of the tokenizer folder or a path."""
    d = keyed(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), "__id", "__key", blank_null().alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    short = _counted(d.filter(F.length("text") <= size).select("doc_id", n_bytes, "text"), model)

    def dealt(cols: list[list]) -> Iterator[tuple]:
        for *k, text in zip(*cols, strict=True):
            for at, part in enumerate(chunks(text, size)):
                yield *k, at, part

    def mapped(cols: list[list]) -> Iterator[tuple]:
        t = transducer(model)
        for *k, part in zip(*cols, strict=True):
            yield *k, *t.chunk(part)

    long = d.filter(F.length("text") > size)
    key = "doc_id long, n_bytes long, copies long, __id long, __key long, at long"
    parts = map_rows(long.select("doc_id", n_bytes, "__id", "__key", "text"), "doc_id long, n_bytes long, __id long, __key long, at long, part string", dealt)
    # rows of one text share its chunks; the shuffle also spreads the chunks of a very long text
    parts = parts.groupBy("doc_id", "n_bytes", "__id", "__key", "at").agg(F.count("*").alias("copies"), F.first("part").alias("part"))
    maps = cut(map_rows(parts.select("doc_id", "n_bytes", "copies", "__id", "__key", "at", "part"), f"{key}, head string, tokens long, tail string", mapped))
    most = maps.agg(F.max("at")).first()[0] or 0
    while most:
        maps, most = _composed(maps, model), most // FAN

    def totals(cols: list[list]) -> Iterator[tuple]:
        t = transducer(model)
        for doc_id, n, copies, *m in zip(*cols, strict=True):
            yield doc_id, n, t.total(tuple(m)), copies

    whole = map_rows(maps.select("doc_id", "n_bytes", "copies", "head", "tokens", "tail"), "doc_id long, n_bytes long, n_tokens long, copies long", totals)
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "n_bytes", "n_tokens")
    return short.union(whole).withColumn("over_limit", F.col("n_tokens") > limit)
