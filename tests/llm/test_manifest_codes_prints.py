"""Merkle manifest, vector codes and fingerprints against plain versions, and on odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plycast.llm import fingerprints, gnat, merkle
from tests.llm.test_llm import CLASH, TEXTS, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(d):
    return sha(*("-" if d[f] is None else f"{len(str(d[f]).encode())}:{d[f]}" for f in merkle.FIELDS))


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_manifest(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d["source"], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf_of(d))) for s in order}
    trees = {s: levels_of([leaf_of(d) for d in own[s]]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for si, s in enumerate(order):
        for i, d in enumerate(own[s]):
            leaf = h = leaf_of(d)
            if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0 and d["text"] is not None:
                h = leaf_of({**d, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"])})
            proof = []
            for tree, k in ((trees[s], i), (top, si)):
                for level in tree[:-1]:
                    a = k // 16 * 16
                    before, after = level[a:k], level[k + 1 : a + 16]
                    proof += before + after
                    h, k = sha(*before, h, *after), k // 16
            out.append((d["doc_id"], leaf, trees[s][-1][0], top[-1][0], sha(*proof), h, h == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def documents(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return d.withColumns({c: F.lit("x") for c in ("g", "id", "leaf", "payload", "rank", "digest", "kids", "path", "asked", *CLASH)})


def test_manifest_on_odd_rows(spark):
    """A source of two levels and more, one of one row, one of 16, one of 17, null ones; null ids, repeated rows, empty and long texts."""
    rows = [(i, "hot", "en", 5, f"Text {i}") for i in range(300)] + [(9000, "alone", None, None, None), (None, None, None, 0, ""), (-5, None, "de", 1, "É")]
    rows += [(1000 + i, "sixteen", "fr", i, prose(i, 5).title()) for i in range(16)] + [(2000 + i, "seventeen", "fr", i, "A" * i) for i in range(17)]
    rows += [(7, "hot", "en", 5, "Text 7")] * 40 + [(8, "hot", "en", 5, None), (None, "hot", None, None, "Q"), (5000, "hot", "en", 1, "LONG " * 100_000), (1, "", "x", 1, "empty source")]
    rows += [(10_000 + i, f"s{i}", "en", 1, "Of Many Sources") for i in range(40)]
    random.Random(3).shuffle(rows)
    docs = documents(spark, rows)
    want = plain_manifest([d.asDict() for d in docs.collect()])
    assert rows_of(merkle.merkle_manifest(docs.repartition(5)), *PROOF) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(3, "a", "en", 1, "X")] * 16])
def test_small_manifests(spark, rows):
    docs = documents(spark, rows)
    assert rows_of(merkle.merkle_manifest(docs), *PROOF) == plain_manifest([d.asDict() for d in docs.collect()])


def test_some_leaves_are_requested(spark):
    """A request of few leaves gets the paths that a request of all gets, and reads no leaf beside them."""
    docs = documents(spark, [(i, f"s{i % 3}", "en", 1, str(i)) for i in range(500)])
    made = merkle.manifest(docs)
    every = made["leaves"].select("g", "rank", F.struct("id").alias("asked"))
    paths = lambda p: {r.id: (r.leaf, r.subroot, r.path) for r in p.select("asked.id", "leaf", "subroot", "path").collect()}
    whole, some = paths(merkle.proofs(made, every)), paths(merkle.proofs(made, every.filter("asked.id in (0, 17, 499)")))
    assert len(whole) == 500 and some == {k: whole[k] for k in (0, 17, 499)}


def test_ranks_run_on_over_tasks(spark):
    rows = [("hot" if i % 3 else f"s{i % 7}", (i * 37) % 1000, "x", None) for i in range(1000)]
    d = spark.createDataFrame(rows, "g string, id long, leaf string, payload string").repartition(7)
    got = {}
    for r in merkle.ranked(d).collect():
        got.setdefault(r.g, []).append((r["rank"], r.id))
    for g, found in got.items():
        assert [k for k, _ in sorted(found)] == list(range(len(found))), g
        assert [i for _, i in sorted(found)] == sorted(i for _, i in found)


def brute(points, queries):
    d = ((queries[:, None, :] - points[None]) ** 2).sum(-1)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("seed", range(12))
def test_the_tree_finds_the_nearest_of_the_lowest_number(seed):
    """Against all distances: few different points (ties and repeats), clusters, one dimension, large numbers, one point."""
    r = np.random.default_rng(seed)
    n, dims, span = [(256, 16, 400), (200, 2, 3), (256, 1, 9), (5, 4, 50), (1, 3, 5), (256, 8, gnat.BOUND)][seed % 6]
    points = r.integers(-span, span + 1, (n, dims))
    if seed > 5:
        points = np.concatenate([points[: n // 2 or 1], points])[:n]
    queries = np.concatenate([r.integers(-span, span + 1, (500, dims)), points])
    number, best, took = gnat.nearest(gnat.Gnat(points), queries)
    want = brute(points, queries)
    assert (number == want[0]).all() and (best == want[1]).all()
    assert took <= n * len(queries)


def test_subtrees_are_ruled_out():
    r = np.random.default_rng(0)
    centres = r.integers(-100_000, 100_000, (16, 8))
    points = np.repeat(centres, 16, 0) + r.integers(-50, 50, (256, 8))
    queries = points + r.integers(-9, 9, points.shape)
    number, best, took = gnat.nearest(gnat.Gnat(points), queries)
    assert (number == brute(points, queries)[0]).all() and took < 0.25 * 256 * 256


def test_roots_are_rounded_outwards():
    x = np.array([0, 1, 2, 3, (1 << 53) + 1, (1 << 62) - 1, ((1 << 31) - 1) ** 2])
    low, high = gnat._root_below(x), gnat._root_above(x)
    for v, a, b in zip(x.tolist(), low.tolist(), high.tolist(), strict=True):
        from fractions import Fraction

        assert Fraction(a) ** 2 <= v <= Fraction(b) ** 2


def plain_codes(rows):
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    width = -(-max(len(v) for _, v, _ in good) // 4) * 4
    ints = [[max(-gnat.BOUND, min(gnat.BOUND, int(np.floor(np.float64(x) * 1024)))) for x in v] for _, v, _ in good]
    q = np.array([v + [0] * (width - len(v)) for v in ints], np.int64).reshape(len(good), 4, width // 4)
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, ints[k]))[:256]
    books = [q[first, p].copy() for p in range(4)]
    for _ in range(4):
        for p in range(4):
            home = brute(books[p], q[:, p])[0]
            for e in set(home.tolist()):
                own = q[home == e, p]
                books[p][e] = own.sum(0) // len(own)
    ends = [brute(books[p], q[:, p]) for p in range(4)]
    errors, of_label = sum(e[1] for e in ends), {}
    for (_, _, lab), e in zip(good, errors.tolist(), strict=True):
        of_label[lab] = of_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{e[0][k]:02x}" for e in ends), int(errors[k]), of_label[lab], digest) for k, (i, _, lab) in enumerate(good)), key=repr)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("kind", ["many", "few", "odd", "none", "null"])
def test_vector_codes_against_brute_force(spark, kind):
    r = np.random.default_rng(len(kind))
    f = lambda n, d: [[float(np.float32(x)) for x in v] for v in r.normal(0, 0.3, (n, d))]
    if kind == "many":
        rows = [(int(i), v, int(i) % 3 if i % 4 else None) for i, v in zip(r.permutation(700), f(700, 12), strict=True)]
        rows += [rows[0]] * 300 + [(5000 + i, rows[5][1], 1) for i in range(300)] + [(6000, None, 1), (6001, [1.0] * 11 + [float("nan")], 1), (6002, [float("inf")] * 12, 2), (6003, [None] * 12, 2)]
    elif kind == "few":
        rows = [(i, v, None) for i, v in enumerate(f(30, 8))]
    elif kind == "odd":
        rows = [(i, v[: 1 + i % 6], i) for i, v in enumerate(f(40, 6))] + [(None, [1e30, -1e30], 1), (None, [0.5], 1), (50, [], 2)]
    else:
        rows = [] if kind == "none" else [(1, None, 1), (2, [float("nan")], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "ints", "v", "n", "none", "name", "code", "error")})
    assert rows_of(gnat.vector_codes(d.repartition(4)), *CODES) == plain_codes(rows)


def plain_print(text, seed=1):
    """From the definition, one shingle at a time."""
    a, b = (x.tolist() for x in fingerprints.permutations())
    words = [fingerprints.xxhash.xxh64_intdigest(w) for w in text.encode().split()]
    if not words:
        return "00" * fingerprints.SLOTS
    row, top, mins = [0] * 4 + words + [0] * 4, (1 << 64) - 1, [(1 << 64) - 1] * len(a)
    for k in range(len(words) + 4):
        h = 0
        for w in row[k : k + 5]:
            h = ((h ^ w) * 0x9E3779B97F4A7C15) & top
            h ^= h >> 29
        h = (h * 0xBF58476D1CE4E5B9) & top
        h ^= h >> 32
        mins = [min(m, (x * h + y) & top) for m, x, y in zip(mins, a, b, strict=True)]
    return bytes((m >> 32) & 255 for m in mins).hex()


PRINTS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def plain_report(rows):
    texts = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        n = len(t) // 4
        changed = (t[:-n] if n else t) + following[:n]
        own, other, after = (bytes.fromhex(plain_print(x)) for x in (t, changed, following))
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own.hex(), other.hex(), fingerprints.likeness(own, other), fingerprints.likeness(own, after)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_against_plain_ones(spark, parts):
    rows = [(i * 3, t[:9000] if t else t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (-4, prose(1, 20)), (10**12, "  ÀÉ 😀")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tie", "kind", "task", "next", "following", "fingerprint", "n_chars")})
    conf = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        assert rows_of(fingerprints.fingerprint_report(d.repartition(2)), *PRINTS) == plain_report(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, prose(3, 9))], [(1, "a b"), (2, "a b")]])
def test_fingerprints_of_few(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(fingerprints.fingerprint_report(d), *PRINTS) == plain_report(rows)


def test_repeated_ids_and_rows(spark):
    """Rows of one id are ordered by a hash of their texts; each has its row, and equal texts equal fingerprints."""
    rows = [(1, prose(i % 5, 30)) for i in range(50)] + [(None, None)] * 3
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 53 and len({r.fingerprint for r in got}) == 6


def test_likeness_follows_jaccard():
    p = fingerprints._Prints()
    words = prose(5, 4000).split()
    for share in (0.0, 0.3, 0.6, 0.9):
        n = int(len(words) * share)
        other = words[:n] + prose(9, len(words) - n).split()
        a, b = (set(fingerprints.shingles(fingerprints.word_hashes(" ".join(x), p.known)).tolist()) for x in (words, other))
        true = len(a & b) / len(a | b)
        assert abs(fingerprints.likeness(*p.pair(" ".join(words), " ".join(other))) - true) < 0.15


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    text = prose(2, 5000) + "\x0b" + "y" * 3000 + "\n" * 500
    whole = fingerprints._Prints().alone(text)
    monkeypatch.setattr(fingerprints, "PIECE", 700)
    assert fingerprints._Prints().alone(text) == whole
    assert fingerprints._Prints().pair(text, text) == (whole, whole)


def test_near_duplicates_against_all_pairs(spark):
    """Groups of near copies, chains, a dense group around no centre, equal texts, short and empty ones, null ids."""
    r, rows = random.Random(2), []
    for g in range(25):
        base = prose(g, r.randint(40, 120)).split()
        for _ in range(r.randint(1, 7)):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = f"changed{r.randint(0, 9)}"
            rows.append((r.randint(0, 10**6), " ".join(own)))
    base = prose(99, 150).split()
    rows += [(2_000_000 + k, " ".join(f"new{i}" if i < 4 * k else w for i, w in enumerate(base))) for k in range(12)]  # a chain
    rows += [(7, None), (8, ""), (9, " \n"), (11, "a b"), (12, "a b"), (12, "a  b"), (None, rows[0][1]), (None, "only a null id here")]
    got = fingerprints.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    h = fingerprints._Hashes()
    sets = [frozenset(fingerprints.shingles(fingerprints.word_hashes(t or "", h)).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for k in range(i):
            both = len(a & sets[k])
            if both >= 0.8 * (len(a) + len(sets[k]) - both):
                root[find(i)] = find(k)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    want = sorted(((d, min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr)
    assert sorted(((x.doc_id, x.class_id) for x in got), key=repr) == want
    assert len(set(map(find, range(len(rows))))) < len(rows) - 40


def test_near_duplicates_of_an_empty_table(spark):
    assert fingerprints.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
