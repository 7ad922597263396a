"""Each operator against a brute-force version, and on nulls, empty and odd texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plycast.llm import common, decontaminate, html_extraction, line_dedup, packing, pii, quality_classifier, quality_rules, simhash, suffix_dedup, token_counts

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    parts = ["an", "the", "ro", "mi", "sel", "ta", "qu", "el", "or", "in"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    BASE, BASE, BASE.replace("the", "tho", 1), None, "", " \t\n ", "one", "a b c", "x" * 700, "ab " * 400,
    prose(2, 60) + "\n" + prose(3, 30) + "\n" + prose(4, 40), prose(5, 50) + "\n\n" + prose(3, 30) + "\n" + prose(4, 40), prose(3, 30) + "\nOf.\n" + prose(6, 30),
    "Of.\nOf.\nOf.", "é😀 " + prose(7, 40) + " ñ", "mail a.b+c@d-e.example.org, 10.0.0.255 and 1.2.3.256; card 4111 1111 1111 1111, call +1 (555) 123-4567.", prose(8, 9000),
    "| # * $ % & < >", "line one is here for all of us to read today\n" * 5,
]
CLASH = ("__id", "__key", "row", "text_key", "host", "n_words", "kept", "spans", "rank", "h", "fp", "score", "piece", "pos", "component_id", "item_id")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, repeated rows, ids that share a number, ties, and columns with the names of results."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, BASE), (3, BASE), (None, BASE), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit("x") for c in CLASH}).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def held(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def runs_of(texts):
    """Lines to delete, by hand: each suffix against all earlier ones; what they share counts from 40 characters on."""
    lines, gone = {}, collections.defaultdict(set)
    for key, t in texts:
        lines[key] = [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip(" \t\x0b\x0c\r")]
    starts = sorted((key, i) for key in lines for i in range(len(lines[key])))
    for n, (key, i) in enumerate(starts):
        for other, j in starts[:n]:
            same = list(itertools.takewhile(lambda ab: ab[0][1] == ab[1][1], zip(lines[key][i:], lines[other][j:])))
            if sum(len(a[1]) for a, _ in same) >= 40:
                gone[key].update(a[0] for a, _ in same)
    return gone


def test_line_dedup(docs, empty, spark):
    keyed = line_dedup.keyed(docs.select("doc_id", "text")).select("__id", "__key", "row.doc_id", "text").collect()
    gone = runs_of({((r["__id"], r["__key"]), r.text) for r in keyed})
    want = collections.Counter()
    for r in keyed:
        cut = gone[(r["__id"], r["__key"])]
        want[(r.doc_id, r.text and "\n".join(x for p, x in enumerate(r.text.split("\n")) if p not in cut), len(cut))] += 1
    got = line_dedup.line_dedup(docs)
    assert collections.Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == want
    assert sum(n for *_, n in want) > 5
    assert line_dedup.line_dedup(empty).count() == 0 == line_dedup.clean_lines(empty).count()
    clean = line_dedup.clean_lines(docs)
    assert clean.columns == docs.columns and {r["__id"] for r in clean.collect()} == {"x"}
    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in clean.collect()) == collections.Counter((i, t, None if t is None else len(t)) for (i, t, _), n in want.items() for _ in range(n))


def test_line_dedup_against_brute_force(spark):
    """Few short lines, so that runs of all lengths repeat, nest and overlap."""
    r = random.Random(12)
    words = ["alpha beta", "gamma", "delta eps", "zeta", "", "eta theta iota"]
    texts = [(k, "\n".join(r.choice(words) for _ in range(r.randint(0, 14)))) for k in range(40)]
    whole = "\n".join(r.choice(words) for _ in range(37))
    texts += [(50, whole), (51, "x\n" + whole), (52, whole.split("\n", 9)[9] + "\nend"), (53, "same\n" * 30)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    keys = {x.doc_id: (x["__id"], x["__key"]) for x in line_dedup.keyed(d).select("row.doc_id", "__id", "__key").collect()}
    gone = runs_of({(keys[k], t) for k, t in texts})
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(d).collect()}
    assert got == {k: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[keys[k]]) for k, t in texts}
    found = {(x["__id"], x.i): x.lcp for x in line_dedup.common_prefixes(line_dedup.ranks(line_dedup.numbered(d).cache())).collect()}
    own = {k: [x for x in t.split("\n") if x] for k, t in texts}
    starts = [(k, i) for k in sorted(own) for i in range(len(own[k]))]
    same = lambda a, b: sum(1 for _ in itertools.takewhile(lambda ab: ab[0] == ab[1], zip(own[a[0]][a[1] :], own[b[0]][b[1] :])))
    want = {s: max((same(s, e) for e in starts[:n]), default=0) for n, s in enumerate(starts)}
    assert found == {(k, i + 1): n for (k, i), n in want.items() if n}


def test_line_dedup_steps_are_few_and_send_no_samples(spark, monkeypatch):
    """Ranks are numbered, not sorted by ranges whose samples the driver gets; a step of intervals without many rows is one
    execution; those with many are counted first and give the same."""
    r = random.Random(7)
    whole = [f"line {r.randint(0, 50)}" for _ in range(40)]
    texts = [(k, "\n".join(whole[a : a + r.randint(2, 30)])) for k, a in enumerate(r.choices(range(30), k=30))] + [(99, "\n".join(whole))]
    lines = line_dedup.numbered(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    found = lambda: sorted(map(tuple, line_dedup.common_prefixes(line_dedup.ranks(lines)).collect()))
    few = found()
    assert not any("rangepartitioning" in p for p in plans)
    steps, levels = len(plans), (max(x[-1] for x in few)).bit_length()
    assert levels >= 4 and steps <= 4 + 2 * levels
    monkeypatch.setattr(line_dedup, "MANY", 2)
    assert found() == few and len(plans) > 2 * steps


def test_line_dedup_finds_runs_over_lines(spark):
    """Runs of short lines, longer than one doubling step, in order only."""
    run = "\n".join(f"part {k}" for k in range(12))
    other = "\n".join(f"part {k}" for k in (3, 1, 2, 0, 5, 4, 7, 6, 9, 8, 11, 10))
    d = spark.createDataFrame([(1, "head\n" + run), (2, run + "\ntail"), (3, other)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_runs) for r in line_dedup.line_dedup(d).collect()}
    assert got == {1: ("head\n" + run, 0), 2: ("tail", 1), 3: (other, 0)}


def test_suffix_dedup(docs, empty, held, monkeypatch):
    count = collections.Counter()
    for _, t in held:
        b = (t or "").encode()
        count.update(b[k : k + 200] for k in range(len(b) - 199))
    want = collections.Counter()
    for i, t in held:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                mark[k : k + 200] = True
        spans = int((np.diff(mark.astype(int)) == 1).sum()) + int(mark[0])
        want[(i, len(b), int(mark.sum()), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())] += 1
    for group in (20_000, 1):  # the second takes every shared anchor as hot
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        assert collections.Counter(map(tuple, suffix_dedup.suffix_array_dedup(docs).collect())) == want
    assert suffix_dedup.suffix_array_dedup(empty).count() == 0


def test_windows_of_a_group():
    r = random.Random(4)
    for n in (2, 3, 6, 7, 40):
        core, members = bytes(r.choice(b"ab") for _ in range(377)), []
        for _ in range(n):
            t = bytearray(core)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(377)] = r.choice(b"xyz")
            back = r.randint(0, 176)
            more = r.randint(0, back)
            members.append((bytes(t[176 - back : 176 - back + more + 200]), back, more))
        seen = collections.Counter((k - b, t[k : k + 200]) for t, b, m in members for k in range(m + 1))
        for (t, b, m), mark in zip(members, suffix_dedup.repeated_windows(members), strict=True):
            assert mark.tolist() == [seen[(k - b, t[k : k + 200])] > 1 for k in range(m + 1)]


def test_deep_shallow_sorts():
    r = random.Random(5)
    for _ in range(30):
        stem = bytes(r.choice(b"ab") for _ in range(50))
        texts = [stem[: r.randint(0, 50)] + bytes(r.choice(b"abc") for _ in range(r.randint(0, 6))) for _ in range(60)]
        order, lcp = suffix_dedup.deep_shallow(texts)
        assert [texts[i] for i in order] == sorted(texts)
        assert all(suffix_dedup._common(texts[a], texts[b]) == n for a, b, n in zip(order, order[1:], lcp[1:]))


def fingerprint_by_hand(t):
    w = WORD.findall((t or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, held):
    fps = [fingerprint_by_hand(t) for _, t in held]
    comp = list(range(len(held)))
    for _ in held:
        for a, b in itertools.combinations(range(len(held)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                comp[a] = comp[b] = min(comp[a], comp[b])
    least = {c: min((held[i][0] for i in range(len(held)) if comp[i] == c and held[i][0] is not None), default=None) for c in set(comp)}
    want = collections.Counter((held[i][0], f"{fps[i]:016x}", least[comp[i]]) for i in range(len(held)))
    plain = docs
    assert collections.Counter(map(tuple, simhash.simhash_near_dedup(plain).collect())) == want
    kept = simhash.keep_one(plain)
    assert kept.count() == len(set(comp)) and kept.columns == plain.columns and {r["__id"] for r in kept.collect()} == {"x"}
    assert simhash.simhash_near_dedup(empty).count() == 0


def test_links_are_found_at_every_distance(spark):
    r = random.Random(6)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in list(values):
        for n in (1, 3, 4, 5):
            for b in r.sample(range(64), n):
                v ^= 1 << b
            values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    got = sorted(map(tuple, simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()))
    want = sorted((a, b) for a, b in itertools.permutations(signed, 2) if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    assert got == want and want


def test_a_dense_cluster_has_few_links(spark):
    """Links of a dense cluster and of chains connect the same fingerprints as all pairs do."""
    r = random.Random(16)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 2000:
        v = centre
        for b in r.sample(range(64), r.randint(1, 3)):
            v ^= 1 << b
        values.add(v)
    for _ in range(30):
        v = r.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for b in r.sample(range(64), 4):
                v ^= 1 << b
    values = list(values)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    n_pairs = 0
    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 4:
            n_pairs += 1
            root[max(top(a), top(b))] = min(top(a), top(b))
    want = {frozenset(v for v in values if top(v) == t) for t in {top(v) for v in values}}
    got = simhash.cluster_links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")).collect()
    assert all(((x.a ^ x.b) & (1 << 64) - 1).bit_count() <= 4 for x in got) and len(got) < n_pairs / 5
    root = {v: v for v in values}
    for x in got:
        a, b = top(x.a % (1 << 64)), top(x.b % (1 << 64))
        root[max(a, b)] = min(a, b)
    assert {frozenset(v for v in values if top(v) == t) for t in {top(v) for v in values}} == want


@pytest.mark.parametrize("share, crowd", [(simhash.HOT, simhash.CROWD), (1, 10**9)])
def test_links_at_a_hot_key(spark, share, crowd):
    """Unlike fingerprints with one segment in common are not compared pair by pair, and no link of theirs is lost."""
    r = random.Random(26)
    at, width = simhash.SEGMENTS[1]
    same = r.getrandbits(width) << at
    values = {r.getrandbits(64) & ~(((1 << width) - 1) << at) | same for _ in range(1200)}
    for v in sorted(values)[:200]:
        for b in r.sample(range(64), r.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    assert simhash.hot_keys(fps, share).count() == width and simhash.hot_keys(fps.limit(300), share) is None
    known = np.array(sorted(values), np.uint64)
    want = {frozenset((int(a), int(b))) for a in known for b in known[np.bitwise_count(known ^ a) <= simhash.BITS] if a != b}
    got = [frozenset((x.a % (1 << 64), x.b % (1 << 64))) for x in simhash.cluster_links(fps, share=share, crowd=crowd).collect()]
    assert len(want) >= 200 and set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 40])
def test_keys_that_meet_by_chance_are_compared_in_place(spark, crowd, tmp_path):
    """Unlike fingerprints at one key leave no rows behind the index: only links do, and none of them is lost."""
    r = random.Random(36)
    at, width = simhash.SEGMENTS[0]
    same = [r.getrandbits(width) for _ in range(30)]
    values = {r.getrandbits(64) >> width << width | same[i % 30] for i in range(3000)}
    for v in sorted(values)[::10]:
        for b in r.sample(range(64), r.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    known = np.array(sorted(values), np.uint64)
    want = {frozenset((int(a), int(b))) for a in known for b in known[np.bitwise_count(known ^ a) <= simhash.BITS] if a != b}
    fps = spark.createDataFrame([(int(v),) for v in known.view(np.int64)], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        links = simhash.cluster_links(fps, crowd=crowd)
        got = [frozenset((x.a % (1 << 64), x.b % (1 << 64))) for x in links.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) >= 300 and set(got) == want and len(got) == len(want)
    index = simhash._index(fps).count()
    nodes, seen = [links._jdf.queryExecution().executedPlan().finalPhysicalPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Generate":
            seen.append(node.metrics().apply("numOutputRows").value())
        below = node.plan() if "QueryStage" in node.nodeName() else None
        nodes += [below] if below is not None else [node.children().apply(i) for i in range(node.children().size())]
    assert seen == [index], seen


def test_a_key_gives_fewer_links_than_members():
    """Members of a dense key that no centre connects are connected by few links, with slices too."""
    r = random.Random(46)
    centre = r.getrandbits(42) << 22
    members = sorted({centre ^ sum(1 << b for b in r.sample(range(22, 64), 2)) for _ in range(500)} | {centre ^ (1 << 42) - (1 << 22)})
    fp = np.array(members, np.uint64).view(np.int64)
    for crowd in (10**9, 100):
        got = list(simhash._compared(np.zeros(len(fp), np.int64), fp, fp, 4, crowd))
        a, b = (np.concatenate(c) for c in zip(*got, strict=True))
        assert len(a) == len(fp) - 2 and (np.bitwise_count((a ^ b).view(np.uint64)) <= 4).all()
        assert len(simhash._spanning(np.arange(len(fp)), np.searchsorted(np.array(members), a.view(np.uint64)), np.searchsorted(np.array(members), b.view(np.uint64)))) == len(fp) - 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(30) if i % 10 != 9] + [(5, 25), (100, 100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == (0 if i < 10 or i >= 20 else 10) for i in range(30))


def test_components_of_stars_take_one_look(spark, monkeypatch):
    """Edges that are stars already are not dealt out again to see that nothing changes; others end as stars."""
    cuts = []
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: cuts.append(1) or cut(df))
    found = common.components(spark.createDataFrame([(9, i) for i in range(10, 20)] + [(3, 2), (5, 5)], "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(3, 2), *((i, 9) for i in range(10, 20))] and len(cuts) == 2
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    r = random.Random(56)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)]
    least = list(range(300))
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    found = common.components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == [(i, x) for i, x in enumerate(least) if i != x]


def test_what_is_stored_leaves_no_shuffle_files(spark):
    """Shuffle files of a stored step go at once, not when the driver collects its garbage; the session's setting stays."""
    top = spark.conf.get("spark.local.dir")
    files = lambda: {f for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    stored = common.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert common.heat(stored, "count") == (143, 1000)
    for _ in range(100):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


ITEMS = [(1, "When Anna walked 12 km from the old mill to the wide river, how long did she need at 4 km per hour?"), (2, prose(20, 30)), (3, "short one"), (4, None), (5, prose(21, 6))]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("h", F.lit(1))


def test_decontamination(spark, items):
    swapped = "Then when Bertha walked 30 km from the old mill to the wide river, how long did she need at 5 km per hour? " + prose(22, 40)
    rows = [
        (1, prose(23, 50) + " " + ITEMS[0][1] + " " + prose(24, 50)), (2, swapped), (3, prose(25, 80)), (4, prose(26, 20) + " " + ITEMS[1][1].upper() + " " + prose(27, 9)), (5, None), (6, ""),
        (7, prose(28, 20) + " " + " ".join(ITEMS[1][1].split()[:9]) + " " + prose(29, 20)), (8, ITEMS[4][1]), (1, prose(30, 30)), (None, ITEMS[1][1]), (4, prose(26, 20) + " " + ITEMS[1][1].upper() + " " + prose(27, 9)),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(2), "item_id": F.lit(9), "text_key": F.lit(0)})
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(d, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (8, 5), (None, 2)}
    kept = decontaminate.drop_contaminated(d, items)
    assert kept.columns == d.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted((i or 0, len(t or "")) for k, (i, t) in enumerate(rows) if k not in (0, 1, 3, 7, 9, 10))
    assert decontaminate.decontaminate(d.limit(0), items).count() == 0 == decontaminate.decontaminate(d, items.limit(0)).count()


def test_decontamination_finds_copies_of_numbers_and_short_items(spark):
    texts = ["What is 12 + 34 * 56 - 78?", "Who wrote the play called Hamlet?", "Name three primes", "1 2 3 4 5 6 7 8 9 10 11 12"]
    item = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(k, f"{prose(40, 30)}\nQuestion 5\n{t}\n{prose(41, 30)}") for k, t in enumerate(texts)]
    rows += [(10, f"{prose(40, 30)} What is 12 + 34 * 56 - 79? {prose(41, 30)} name two primes"), (11, "Who wrote the song called Hamlet?"), (12, None)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), item).collect()}
    assert got == {(k, k) for k in range(4)}


def canonical_by_hand(text):
    """(form, is a placeholder, words) of each canonical word, one rule after the other."""
    words = []
    for w in (text or "").split():
        m = re.fullmatch(r"[(\"']*([$€£]?)([+-]?\d+(?:[.,:/]\d+)*)([a-z]*|[%€£$°])([.!?:,;)\"']*)", w.lower())
        unit = m and (decontaminate._SIGNS.get(m[1] or m[3], m[3]) if bool(m[1]) != bool(m[3]) else None)
        words += [m[2], unit + ("." if set(m[4]) & set(".!?:") else "")] if unit in decontaminate._UNITS else [w]
    marked, after_number, start = [], False, True
    for w in words:
        core = w.strip(decontaminate._OUTER)
        if not core:
            continue
        low = core.lower()
        count = all(x in decontaminate._COUNTS for x in low.split("-"))
        number = count or bool(re.fullmatch(r"[+-]?\d[\d.,:/]*[a-z%]{0,3}", low))
        unit = low in decontaminate._UNITS and after_number
        name = not number and not unit and not start and core[0].isupper() and core[1:].islower()
        kind = "<number>" if number else "<unit>" if unit else "<name>" if name else ""
        if marked and not start and (count and marked[-1][1] == "<number>" or kind == "<name>" == marked[-1][1]):
            marked[-1] = (marked[-1][0], kind, marked[-1][2] + " " + low)
        else:
            marked.append((kind or low, kind, low))
        after_number, start = number, w.rstrip("\"')»“”’")[-1:] in tuple(".!?:…")
    return [(form, bool(kind), low) for form, kind, low in marked]


def leaks_by_hand(doc, item, share=0.5):
    d, q = canonical_by_hand(doc), canonical_by_hand(item)
    size = min(8, len(q))
    if not size:
        return False
    spans = lambda x: range(len(x) - size + 1)
    plain = lambda x, at: sum(not t[1] for t in x[at : at + size]) >= min(4, size)
    own = [at for at in spans(q) if size >= 4 and plain(q, at)]
    matched, total = set(), 0
    for line in range(-len(q), len(d)):
        met = [at for at in own if 0 <= at + line <= len(d) - size and [t[0] for t in q[at : at + size]] == [t[0] for t in d[at + line : at + line + size]]]
        pairs = {(q[k][2], d[k + line][2]) for at in met for k in range(at, at + size) if q[k][1]}
        a, b = collections.Counter(x for x, _ in pairs), collections.Counter(y for _, y in pairs)
        fine = [at for at in met if all(a[q[k][2]] == 1 == b[d[k + line][2]] for k in range(at, at + size) if q[k][1])]
        if fine:
            matched.update(fine)
            total = max(total, len(own))
    if not own or len(spans(q)) == 1:
        for at in spans(q):
            if any([t[2] for t in q[at : at + size]] == [t[2] for t in d[x : x + size]] for x in spans(d)):
                matched.add(at)
                total = max(total, len(spans(q)))
    return bool(matched) and len(matched) >= share * total


def test_decontamination_against_brute_force(spark):
    """Questions with other numbers, names and units, whole, cut, torn and among other words."""
    r = random.Random(31)
    stems = ["when {n} walked {a} {u} from the old mill and {m} walked {b} {u} how far were {n} and {m} apart then", "a box of {a} {u} costs as much as {b} others and {n} buys {c} of them for the whole house", "{a} + {b} = {c}", "who wrote to {n} then", "{n} {m} {a} {b} {c} {n} {m} {a} {b} {c} went", "so {n} and {m} paid ${a} for the {b}kg of old rye that {n} had left in {c} days"]
    some = lambda: r.choice([str(r.randint(1, 9)), "two", "forty-five", "three hundred"])
    fill = lambda t: t.format(n=r.choice(["Anna", "Bob", "Cleo Smith"]), m=r.choice(["Dora", "Emil", "Anna"]), u=r.choice(["km", "kg", "hours"]), a=some(), b=some(), c=r.randint(1, 99))
    questions = list(enumerate(fill(r.choice(stems)) for _ in range(14)))
    rows = []
    for k in range(160):
        words = fill(r.choice(stems)).split()
        if r.random() < 0.3:
            words = words[r.randint(0, 5) :]
        if words and r.random() < 0.3:
            words[r.randrange(len(words))] = r.choice(["7", "Bob", "kg", "mill"])
        rows.append((k, " ".join([prose(500 + k, r.randint(0, 6)), r.choice(["", "So.", "Then"]), *words, prose(800 + k, r.randint(0, 6))])))
    rows += [(200 + i, t) for i, t in questions]
    got = {(x.doc_id, x.item_id) for x in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(questions, "item_id long, text string")).collect()}
    want = {(i, j) for i, t in rows for j, q in questions if leaks_by_hand(t, q)}
    assert got == want and len([1 for i, _ in want if i < 200]) > 10


REWORDED = [
    ("other numbers and names", "If {Emil} drives 312 km along the coast road in 7 hours and then rests for 3 hours before supper how fast was the car on average"),
    ("other units", "If {Emil} drives 312 miles along the coast road in 7 days and then rests for 3 days before supper how fast was the car on average"),
    ("two-word names", "If {Emil Brandt} drives 312 km along the coast road in 7 hours and then rests for 3 hours before supper how fast was the car on average"),
    ("number words", "If {Emil} drives three hundred twelve km along the coast road in seven hours and then rests for three hours before supper how fast was the car on average"),
    ("hyphens", "If {Emil} drives forty-five km along the coast road in twenty-two hours and then rests for eleven hours before supper how fast was the car on average"),
    ("glued units", "If {Emil} drives 312km along the coast road in 7h and then rests for 3h before supper how fast was the car on average"),
    ("signs", "If {Emil} drives $312 along the coast road in 7% and then rests for 3% before supper how fast was the car on average"),
]


def test_items_of_one_template_and_one_opening(spark):
    opening = "please read the following question with care and answer it in one word"
    same = [(k, f"A farmer sells {k + 3} sheep and {2 * k + 50} goats at the market every single week") for k in range(300)]
    other = [(1000 + k, f"{opening} {' '.join(f'w{k}x{j}' for j in range(30))}") for k in range(300)]
    item = spark.createDataFrame(same + other, "item_id long, text string")
    rows = [(k, f"note{k} {opening} and then nothing more about it note{k}") for k in range(300)]
    rows += [(500, "so A farmer sells 77 sheep and 81 goats at the market every single week then"), (501, f"see {other[7][1]} end"), (502, "A farmer sells 5 sheep and 5 goats at the market every single week")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.decontaminate(docs, item).collect()}
    assert {i for d, i in got if d == 500} == set(range(300)) and {i for d, i in got if d == 501} == {1007} and {d for d, _ in got} <= {500, 501, 502}
    assert decontaminate.benchmark_windows(item).filter("item_id < 1000").select("template").distinct().count() == 1


def test_rewordings_of_seven_kinds_are_found(spark, asked):
    """Each within other words, and each with numbers that contradict the item's equal ones is not whole any more."""
    plain = lambda t: t.replace("{", "").replace("}", "")
    item = spark.createDataFrame([(1, plain(asked)), (2, prose(77, 30))], "item_id long, text string")
    rows = [(k, f"{prose(600 + k, 40)} {plain(t)}? {prose(700 + k, 40)}") for k, (_, t) in enumerate(REWORDED)] + [(100 + k, prose(900 + k, 120)) for k in range(20)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), item).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, 1) for k in range(len(REWORDED))}
    assert all(r.n_slotted > 0 for r in got)


def test_words_become_canonical():
    forms = lambda t: " ".join(f for f, _, _ in canonical_by_hand(t))
    for a, b in (("costs $45.", "costs 30 dollars."), ("went 250km to", "went two hundred and km to".replace(" and", "")), ("saw Anna Lee go", "saw Bob go"), ("took 45% of", "took 3 percent of"), ("in 4h. Then", "in four hours. Then"), ("3 million km", "7 km")):
        assert forms(a) == forms(b)
    for t in ("The 1st and 2nd of 1,000.50 (4h) \"$3\" -5 +7km 5% 12:30 1/2 one-two twenty One Two. Three Four's A B 9€, 10€. x5 5x5 3kms °5 5°", "one", "Anna Anna. Bob Cleo Dora 5 6 seven eight 9 ten kg kg"):
        out, slots, words, own = decontaminate.canonical(t)
        want = canonical_by_hand(t)
        assert slots.tolist() == [x[1] for x in want]
        assert [" ".join(w.strip(decontaminate._OUTER) for w in x.split()).lower() for x in words] == [x[2] for x in want]


def test_decontamination_asks_for_consistent_slots(spark):
    item = spark.createDataFrame([(1, "give 7 apples to the tall man and 7 pears to the small boy near the gate")], "item_id long, text string")
    same, torn = (f"give {a} apples to the tall man and {b} pears to the small boy near the gate" for a, b in ((9, 9), (9, 4)))
    d = spark.createDataFrame([(1, same), (2, torn)], "doc_id long, text string")
    n = {r.doc_id: r.n_matched for r in decontaminate.decontaminate(d, item, share=0.01).collect()}
    assert n == {1: 10, 2: 1}


def base_by_hand(t):
    t = t or ""
    w = [x.decode() for x in WORD.findall(t.encode())]
    five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + k for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for k in range(5)}
    full = [x for x in t.split("\n") if WORD.search(x.encode())]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def buckets_by_hand(t):
    w = [zlib.crc32(x) for x in (t or "").encode().split()]
    two = [((a * 0x9E3779B97F4A7C15 + c) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 48 for a, c in zip(w, w[1:])]
    return np.array([x % 65536 for x in w] + two, np.int64)


def ratio_by_hand(texts, trusted):
    """Log ratio of each bucket, from (doc_id, text) pairs and trusted doc_ids."""
    raw, target = np.zeros(65536), np.zeros(65536)
    for i, t in texts:
        np.add.at(raw, buckets_by_hand(t), 1)
        if i in trusted:
            np.add.at(target, buckets_by_hand(t), 1)
    return np.log((target + 1) / (target.sum() + 65536)) - np.log((raw + 1) / (raw.sum() + 65536))


def test_quality_rules(docs, empty, held):
    ids = docs.filter("doc_id in (0, 10, 11, 14)").select("doc_id")
    got = quality_rules.quality_rules(docs, ids, threshold=-1.5).collect()

    assert collections.Counter((r.doc_id, *tuple(r)[1:7]) for r in got) == collections.Counter((i, *base_by_hand(t)) for i, t in held)
    assert all(r.kept == (not r.base_failed and r.llr >= -1.5) for r in got) and any(r.kept for r in got)

    # the score, with multinomials counted by hand
    ratio = ratio_by_hand(held, {r[0] for r in ids.collect()})
    buckets = [buckets_by_hand(t) for _, t in held]
    want = sorted((i or -1, round(float(ratio[x].mean()), 9) if len(x) else 0.0) for (i, _), x in zip(held, buckets, strict=True))
    assert sorted((r.doc_id if r.doc_id else (r.doc_id or -1), round(r.llr, 9)) for r in got) == want
    assert quality_rules.quality_rules(empty, ids).count() == 0
    assert quality_rules.quality_rules(docs, ids.limit(0)).count() == len(held)
    kept = quality_rules.keep_good(docs, ids, threshold=-1.5)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("sent", [0, quality_rules.MAX_SENT])
def test_all_trusted_documents_count(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "MAX_SENT", sent)
    n = 6000
    d = spark.range(2 * n).selectExpr("if(id = 0, null, id) as doc_id", "concat('w', id % 50, ' common') as text")
    ratio = quality_rules.fit(d, spark.range(n).selectExpr("id as doc_id").union(spark.range(n)))
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i in range(2 * n):
        b = quality_rules.ngram_buckets([b"w%d" % (i % 50), b"common"])
        raw[b] += 1
        target[b] += 0 < i < n
    share = [(c + quality_rules.SMOOTH) / (c.sum() + quality_rules.SMOOTH * quality_rules.BUCKETS) for c in (target, raw)]
    assert np.allclose(ratio, np.log(share[0] / share[1]), rtol=0, atol=1e-12)


def test_repeat_words_where_names_do_not_fit_one_number():
    words = [str(i).encode() for i in range(9000)] + [b"a", b"b", b"c", b"d", b"e"] * 2
    assert quality_rules.repeat_words(words) == 10


PAGES = {
    "plain": "<html><body><nav><a>menu</a></nav><article><h1>Title</h1><p>One &amp; two.<br>Three</p><p>Four</p></article><footer>foot</footer></body></html>",
    "noise": "<body><header>top</header><div class='cookie-notice'>agree</div><main><p>Text  one\n two</p><div class=\"ad\">buy</div><aside>side</aside><form><p>mail</p></form><ul><li>item</ul><div id=comments><p>nice</p></div></main><script>var a='<p>no</p>'</script></body>",
    "unclosed": "<article><p><b>Bold<br><p>Next<p>Last <i>one</article>",
    "bare": "<p>no host article</p>",
    "odd": "a < b &lt;c&gt; <!-- <p>x</p> --> <p title='>'>d</p",
}


def test_html_extraction(spark):
    rows = [(k, "https://a.example.org/x", h) for k, h in enumerate(PAGES.values())] + [(7, None, None), (8, "https://a.example.org/y", ""), (0, "https://a.example.org/x", PAGES["plain"])]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("x")})
    got = [(r.page_id, r.text, r.n_chars) for r in html_extraction.extract(d).collect()]
    want = {0: "Title\nOne & two. Three\nFour", 1: "Text one two\nitem", 2: "Bold\nNext\nLast one", 3: "no host article", 4: None, 7: "", 8: ""}
    assert len(got) == len(rows)
    assert all(t == want[i] and n == len(t) for i, t, n in got if want[i] is not None)
    assert html_extraction.extract(d.limit(0)).count() == 0


def of(page):
    return html_extraction.wrap(html_extraction.parse(page))


def test_wrappers_fold_and_align():
    w = html_extraction.merge(of("<ul><li>a</li><li>b</li></ul><p>x</p>"), of("<ul><li>a</li></ul><div>y</div><p>z</p>"))
    kids = {k.label: k for k in w.kids}
    assert "+" in kids["ul"].kids[0].quant and "?" in kids["div"].quant and kids["p"].text == -1 and kids["p"].quant == ""
    pairs = of("<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd><dt>e</dt><dd>f</dd></dl>").kids[0]
    assert [(k.label, k.quant) for k in pairs.kids] == [("dt", "+"), ("dd", "+")]
    again = html_extraction.loaded(html_extraction.dumped(w))
    assert [g.row() for g in html_extraction._under(again)] == [g.row() for g in html_extraction._under(w)]


def host_page(k, body):
    menu = "".join(f"<li><a href=/{x}>{x} {k % 2}</a></li>" for x in ("Home", "News", "Shop"))
    return f'<html><body><div class="m"><ul>{menu}</ul></div><div class="c1"><h1>Headline {k}</h1>{body}<div class="b7">Write to our desk for more of this</div></div><div class="z">All rights stay with the host</div></body></html>'


def test_the_wrapper_tells_article_from_boilerplate(spark):
    """A host without article elements, with names inside the article that elsewhere mean boilerplate."""
    body = [f'<p>Opening words number {k} of a text.</p><div class="notice">The part {k} of the text that tells of {k * 7} things at some length, for all to read.</div><div class="share-price">It closed at {k * 3}.</div><p>Last words {k}.</p><div class="ad">Buy {k}</div>' for k in range(8)]
    want = {k: f"Headline {k}\nOpening words number {k} of a text.\nThe part {k} of the text that tells of {k * 7} things at some length, for all to read.\nIt closed at {k * 3}.\nLast words {k}." for k in range(8)}
    rows = [(k, "http://h.example.org/x", host_page(k, b)) for k, b in enumerate(body)]
    # by hand: a block of the host that is the same on all pages, links, and the advert go, all else is article
    d = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extraction.extract(d).collect()} == want
    alone = {r.page_id: r.text for r in html_extraction.extract(d, infer=False).collect()}
    assert all(alone[k] == want[k] + "\nWrite to our desk for more of this" for k in alone)


def extracted(spark, pages, infer=True):
    d = spark.createDataFrame([(i, f"https://host.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extraction.extract(d.repartition(3), infer).collect()}


@pytest.mark.parametrize("tag", ["article", "div"])
def test_thousands_of_groups_before_the_article(spark, tag):
    """120 menus of 60 differently named blocks each, more groups than a stored wrapper keeps: the lightest give way."""
    menus = ("<div class=m%s>%s</div>" % (chr(97 + k % 26) * (1 + k // 26), "".join(f"<div class=b{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}><a href=x>go</a></div>" for i in range(60))) for k in range(120))
    rows = list(menus)
    menus = "".join(f"<div class=part{c}>{''.join(rows[40 * j : 40 * j + 40])}</div>" for j, c in enumerate("abc"))
    texts = [[prose(10 * n + k, 30) + "." for k in range(3)] for n in range(4)]
    pages = [f"<html><body>{menus}<{tag} class=story>{''.join(f'<p>{t}</p>' for t in x)}</{tag}></body></html>" for x in texts]
    assert sum(1 for _ in html_extraction._under(html_extraction.wrap(html_extraction.parse(pages[0])))) > html_extraction.MAX_NODES
    assert extracted(spark, pages) == {n: "\n".join(x) for n, x in enumerate(texts)}


@pytest.mark.parametrize("n", [1, 5])
def test_a_page_in_a_form_and_forms_in_pages(spark, n):
    texts = [[prose(10 * k + j, 40) + "." for j in range(3)] for k in range(n)]
    body = lambda x: "<div class=menu><a href=a>One</a> <a href=b>Two</a></div><div class=story>" + "".join(f"<p>{t}</p>" for t in x) + "<form action=join><p>Join our list today</p><input name=q><button>Go</button></form></div>"
    whole = [f"<html><body><form id=aspnetForm method=post>{body(x)}</form></body></html>" for x in texts]
    plain = [f"<html><body>{body(x)}<form><label>Search</label><input></form></body></html>" for x in texts]
    want = {k: "\n".join(x) for k, x in enumerate(texts)}
    assert extracted(spark, whole) == want
    assert extracted(spark, plain) == want


def test_lists_of_links_in_an_article_stay(spark):
    """Between paragraphs, differing from page to page; the host's own menu and links behind the article go."""
    links = lambda k, n: "".join(f"<li><a href=u{j}>{prose(100 * k + j, 3)}</a></li>" for j in range(n))
    menu = "<ul>" + "".join(f"<li><a href=m{j}>Section {chr(65 + j)}</a></li>" for j in range(6)) + "</ul>"
    pages, want = [], {}
    for k in range(5):
        one, two = prose(7 * k, 50) + ".", prose(7 * k + 1, 50) + "."
        pages.append(f"<html><body>{menu}<article><p>{one}</p><ul>{links(k, 4 + k)}</ul><p>{two}</p></article></body></html>")
        want[k] = "\n".join([one, *(prose(100 * k + j, 3) for j in range(4 + k)), two])
    assert extracted(spark, pages) == want


def test_rounds_of_folding_give_one_wrapper_a_host(spark):
    pages = [(i, f"https://h{i % 7}.example/", f"<body><div class=a>{prose(i, 9)}</div><div class=b{'x' * (i % 3)}>same</div></body>") for i in range(200)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(40)
    got = html_extraction.wrappers(d).collect()
    assert sorted(r.host for r in got) == sorted(f"h{k}.example" for k in range(7))
    assert sum(html_extraction.loaded(r.wrapper).pages for r in got) == 200


def test_copies_of_a_page_are_no_boilerplate(spark):
    page = "<body><article><h1>One</h1><p>The same text on all pages of the host.</p></article></body>"
    d = spark.createDataFrame([(k, "http://h.example.org/x", page) for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in html_extraction.extract(d).collect()} == {"One\nThe same text on all pages of the host."}


@pytest.mark.parametrize(
    "page", ["<div>" * 2000 + "x", "<article>" + "<p>a</p><div>b</div>" * 10000, "".join(f"<{'p div ul h2 pre section'.split()[k * k % 7 % 6]}>w" for k in range(20000)), "<a " * 8000, '<a "' * 8001, "<p x='" * 5000, "<" * 20000, "<!x" * 20000, "<i>" * 9000 + "<p></p>" * 9000]
)
def test_odd_pages_take_little_time(page):
    began = time.time()
    w = html_extraction.merge(of(page), of(page))
    html_extraction.article(page, html_extraction.place(html_extraction.loaded(html_extraction.dumped(w))))
    assert time.time() - began < 5


def test_packing(docs, empty, held):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    want = collections.Counter()
    for i, t in held:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.best_fit_packing(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [0, *itertools.accumulate(n for _, n in b[:-1])] and sum(n for _, n in b) <= 2048
    assert len(bins) == -(-sum(n for b in bins.values() for _, n in b) // 2048)
    assert packing.best_fit_packing(empty).count() == 0


def test_two_documents_take_a_smaller_ones_place():
    bins = packing.best_two_fit([6, 3, 2, 2], 10)
    assert sorted(sorted((6, 3, 2, 2)[i] for i in b) for b in bins) == [[2, 2, 6], [3]]
    r = random.Random(7)
    lengths = [r.randint(1, 2048) for _ in range(3000)]
    bins = packing.best_two_fit(lengths)
    assert sorted(itertools.chain(*bins)) == list(range(3000)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1.01 * sum(lengths) / 2048 + 1


def test_words_are_the_tokenizers():
    import public_tokenizers

    words = packing.Words(public_tokenizers.path(packing.MODEL))
    r = random.Random(8)
    parts = ["a", "B", "é", "Σ", "ΑΣ", "İ", ".", "!!", "'s", "n't", "<|endoftext|>", "1", "２", "³", " ", "\n", "\t", "　", "\x1c", "\x85", "é", "́", "日", "ﬁ", "%%%", "_", "K"]
    for _ in range(3000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert words.ids(x) == np.array(words.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), x


def test_every_letter_before_every_mark():
    import public_tokenizers

    words = packing.Words(public_tokenizers.path(packing.MODEL))
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    for k, mark in enumerate(["", *map(chr, packing._MARKS)]):
        # all before some marks; a share of them, and those that normalisation changes, before the others
        own = letters if mark in ("", ".", "%") else [c for c in letters if ord(c) % 29 == k or not unicodedata.is_normalized("NFC", c)]
        for before in ("", "a"):
            for at in range(0, len(own), 2000):
                x = " ".join(before + c + mark for c in own[at : at + 2000])
                assert words.ids(x) == np.array(words.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_counts(docs, empty, held):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    want = collections.Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in held)
    assert collections.Counter(map(tuple, token_counts.token_counts(docs).collect())) == want
    assert token_counts.token_counts(empty).count() == 0
    assert collections.Counter(map(tuple, token_counts.token_counts(docs, size=64).collect())) == want  # in chunks, composed by Spark
    t = token_counts.transducer(token_counts.MODEL)
    r = random.Random(9)
    parts = [" ", " ", "\n", "a", "b", "the", "é", "▁", "\t", "<s>", "\x00", "日", "  ", "Er.", "\r\n", "　", "ÜBER", "1", "    "]
    for _ in range(4000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert {t.count(x, size) for size in (1, 2, 3, 1 << 16)} == {len(sp.encode(x))}, x
    for n in range(1, 80):
        for x in (" " * n, "a" + " " * n + "b", "é" * n, "ab" * n, "\n " * n):
            assert t.count(x) == t.count(x, 16) == len(sp.encode(x)), x


def test_states_are_forgotten_and_compiled_again(monkeypatch):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(token_counts.MODEL))
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_BYTES", 5000)
    t = token_counts.transducer.__wrapped__(token_counts.MODEL)
    for x in TEXTS:
        assert t.count(x or "") == len(sp.encode(x or ""))


def test_composition_is_associative():
    t = token_counts.transducer(token_counts.MODEL)
    maps = [t.chunk(x) for x in token_counts.chunks(BASE + "日日日 the\n\n  end", 7)]
    whole = t.total(t.compose(maps))
    for k in range(1, len(maps)):
        assert t.total(t.compose([t.compose(maps[:k]), t.compose(maps[k:])])) == whole == t.count(BASE + "日日日 the\n\n  end")


def test_quality_classifier(spark, docs, empty):
    good = [(i, prose(1000 + i, 80)) for i in range(160)]
    bad = [(500 + i, " ".join(w + "%%%" for w in prose(3000 + i, 60).split())) for i in range(160)]
    d = spark.createDataFrame(good + bad + [(None, "x"), (990, None), (990, None)], "doc_id long, text string").withColumns({"score": F.lit(1), "lang": F.lit("en")})
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_classifier(d, labels).collect()
    assert len(got) == 323 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 990]
    assert len(held) > 30 and np.mean([r.predicted == (r.doc_id < 500) for r in held]) > 0.95
    assert 0.3 < quality_classifier.fit(d, labels)[1] < 0.75  # half of the unlabelled texts are good
    assert quality_classifier.quality_classifier(empty, labels).count() == 0
    assert {r.score for r in quality_classifier.quality_classifier(docs, labels.limit(0)).collect()} == {0.5}


def test_risk_and_its_gradient():
    r = np.random.default_rng(3)
    pos, unl, w = r.normal(0.5, 1, (60, 7)), r.normal(0, 1, (90, 7)), r.normal(0, 0.3, 7)
    plain = 0.4 * np.mean([np.log1p(np.exp(-x @ w)) for x in pos]) + max(0, np.mean([np.log1p(np.exp(x @ w)) for x in unl]) - 0.4 * np.mean([np.log1p(np.exp(x @ w)) for x in pos]))
    assert abs(quality_classifier.risk(pos, unl, w, 0.4) - plain) < 1e-12
    step = np.eye(7) * 1e-6
    slope = [(quality_classifier.risk(pos, unl, w + e, 0.4) - quality_classifier.risk(pos, unl, w - e, 0.4)) / 2e-6 for e in step]
    assert np.allclose(quality_classifier.gradient(pos, unl, w, 0.4), slope, atol=1e-6)
    # where the negatives' part is below 0, the step leads back up
    far = np.full(7, 3.0)
    part = lambda v: np.logaddexp(0, unl @ v).mean() - 0.99 * np.logaddexp(0, pos @ v).mean()
    assert part(far) < 0 and np.allclose(quality_classifier.gradient(pos, unl, far, 0.99), [-(part(far + e) - part(far - e)) / 2e-6 for e in step], atol=1e-5)


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_the_prior_is_found(prior):
    r = np.random.default_rng(4)
    one = lambda n, m: np.hstack([r.normal(m, 1, (n, 4)), np.ones((n, 1))])
    unl = np.vstack([one(int(4000 * prior), 1.5), one(4000 - int(4000 * prior), -1.5)])
    assert abs(quality_classifier.estimate_prior(one(2000, 1.5), unl[r.permutation(4000)]) - prior) < 0.08


def test_held_out_accuracy(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.01"
    if not Path(d).is_dir():
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").distinct()
    got = quality_classifier.quality_classifier(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and np.mean([x.predicted == x.quality for x in got]) > 0.95


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    n = [int(c) for c in v if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(n) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(n[::-1])) % 10 == 0
    return kind == "email" or 8 <= len(n) <= 15


def base_of(t):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, t or "") if passes(k, m[0])]


ODD = ["a@b.c_x@d.e y", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 5", "4111-1111-1111-1111, é😀 a@b.co +1 (555) 123-4567.", "5 5 5 " * 400, "9" * 5000, "a" * 5000 + "@", "+12 3", "x@y", "1 " * 9000 + "2"]


def test_pii(spark, docs, empty, held):
    d = docs.select("doc_id", "text", "spans", "h").union(spark.createDataFrame([(900 + i, t, "x", "x") for i, t in enumerate(ODD)], "doc_id long, text string, spans string, h string"))
    want = collections.Counter()
    for i, t in held + [(900 + i, t) for i, t in enumerate(ODD)]:
        b = base_of(t)
        want[(i, *(sum(k == x for x, *_ in b) for k in KINDS), hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in b).encode()).hexdigest())] += 1
    got = pii.pii(d).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got)
    assert pii.pii(empty).count() == 0 == pii.redact(empty).count()
    assert pii.redact(docs).columns == docs.columns and {r["__id"] for r in pii.redact(docs).collect()} == {"x"}
    text = pii.redact(d.filter("doc_id = 903")).first().text
    assert text == "[card], é😀 [email] [phone]."


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"{prose(50 + i, 6)} the zanzibar office wrote from chief@corp.example.org about {prose(80 + i, 5)}") for i in range(6)]
    rows += [(100 + i, f"{prose(200 + i, 8)} the office wrote again from there about it") for i in range(60)]
    got = {r.doc_id: r.spans for r in pii.pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows[:6]:
        spans = [x.split(":") for x in got[i].split(",")]
        assert [t[int(a) : int(z)] for k, a, z in spans if k == "email"] == ["chief@corp.example.org"]
        assert [t[int(a) : int(z)] for k, a, z in spans if k == "term"] == ["zanzibar"]
    assert all(got[i] == "" for i, _ in rows[6:])


def test_terms_anywhere_give_a_group_away(spark):
    far = " ".join(f"filler{'abcdefgh'[k % 8]}" for k in range(30))
    rows = [(i, f"the Zanzibar desk {far} case no {i} wrote as p{i}@corp.example.org about case no {i} {far} and ZANZIBAR") for i in range(12)]
    rows += [(50, rows[0][1]), (51, "a zanzibar of no address")] + [(100 + i, f"the desk wrote about case no {i} {far}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("x"), "__id": F.lit("y")})
    got = {r.doc_id: r.spans for r in pii.pii(d).collect()}
    for i, t in rows:
        terms = [t[int(a) : int(z)] for k, a, z in (x.split(":") for x in got[i].split(",") if x) if k == "term"]
        assert terms == re.findall("zanzibar", t, re.I)
    out = pii.redact(d)
    assert out.columns == d.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {i: re.sub("zanzibar", "[term]", re.sub(r"p\d+@corp\.example\.org", "[email]", t), flags=re.I) for i, t in rows}


def terms_by_hand(texts):
    """Disclosing terms of different texts, from counts of whole documents."""
    letters = r"[^\W\d_]{4,}"
    d_e, d_t, d_et = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for k, t in enumerate(texts):
        entities = set()
        for kind, a, z in base_of(t):
            v = re.sub("[^0-9]", "", t[a:z]) if kind in ("card", "phone") else t[a:z].lower()
            group = {"email": v.split("@")[-1], "ip": v.rpartition(".")[0], "card": v[:6], "phone": v[:4]}[kind]
            entities |= {(kind, "value", v), (kind, "group", group), (kind, "kind")}
        secret = [m[0] for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}", t) if len(re.sub("[^0-9]", "", m[0])) >= 4 and len(re.sub("[^A-Za-z]", "", m[0])) >= 2]
        entities |= {("secret", "value", x.lower()) for x in secret} | ({("secret", "group", ""), ("secret", "kind")} if secret else set())
        rest = re.sub(r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}", " ", re.sub(KINDS["email"], " ", t))
        terms = {x.lower() for x in re.findall(letters, rest)}
        d_e.update(entities)
        d_t.update(terms)
        for e in entities:
            for x in terms:
                d_et[e, x].add(k)
    out, n = set(), len(texts)
    for (e, x), ks in d_et.items():
        pmi = np.log(n * len(ks) / (d_e[e] * d_t[x]))
        if len(ks) >= pii.SUPPORT and pmi > 0 and pmi >= pii.DISCLOSE * np.log(n / d_e[e]) - 1e-12 and len(ks) * pmi >= pii.EVIDENCE:
            out.add(x)
    return out


def test_terms_against_brute_force(spark):
    """Names planted beside an address, a network and a secret: all are found, and nothing that the counts do not give."""
    r = random.Random(17)
    names = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(4)) + "x" for _ in range(30)]
    texts = []
    for k in range(700):
        t = [prose(5000 + k, r.randint(3, 30)), f"case {k}"]
        if k < 180:
            who = names[k % 30]
            t[1:1] = [r.choice([who, who.title(), who.upper()]), prose(9000 + k, r.randint(0, 20)), (f"{who[:3]}{k % 3}@mail{k % 30}.example.org", f"10.{k % 30}.7.{k}", f"{k % 30:02d}" + hashlib.md5(str(k % 30).encode()).hexdigest())[k % 30 % 3]]
        texts.append(" ".join(t))
    want = terms_by_hand(texts)
    assert len(want & set(names)) >= 0.9 * len(names)
    d = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.pii(d).collect()}
    for k, t in enumerate(texts):
        found = [t[int(a) : int(z)].lower() for kind, a, z in (x.split(":") for x in got[k].split(",") if x) if kind == "term"]
        hidden = [m.span() for p in (KINDS["email"], r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}") for m in re.finditer(p, t)]
        assert found == [m[0].lower() for m in re.finditer(r"[^\W\d_]{4,}", t) if m[0].lower() in want and not any(a < m.end() and m.start() < z for a, z in hidden)], k
    redacted = {x.doc_id: x.text.lower() for x in pii.redact(d).collect()}
    assert not any(x in re.findall(r"[^\W\d_]{4,}", redacted[k]) for k in range(180) for x in want & set(names))


def test_a_long_text_of_matches_takes_little_time(spark):
    t = "4111 1111 1111 1111, " * 15000 + "a@b.co " * 15000 + "12 345 " * 50000
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    began = time.time()
    r = pii.pii(d).first()
    assert (r.n_card, r.n_email) == (15000, 15000) and time.time() - began < 40
    assert pii.redact(d).first().text == "[card], " * 15000 + "[email] " * 15000 + "12 345 " * 50000


def test_an_entity_of_every_document_is_not_given_away(spark):
    d = spark.createDataFrame([(i, f"{prose(i, 6)} report p{i}@corp.example.org") for i in range(6)], "doc_id long, text string")
    assert all(r.spans.startswith("email") and "term" not in r.spans for r in pii.pii(d).collect())


def test_pipeline_keeps_columns(spark, small):
    import corpus_pipeline

    d = spark.read.parquet(f"{small}/documents.parquet")
    out = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, small).cache()
        assert name == "best_fit_packing" or out.schema == d.schema
    assert 0 < out.select("doc_id").distinct().count() < d.count()
    assert corpus_pipeline.run(spark, small).count() == out.count()


def test_stages_take_odd_tables(docs, empty, small):
    """Nulls in every column, empty texts, repeated rows and clashing names go through each stage; so does an empty table."""
    import corpus_pipeline

    d = docs.union(docs.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema)))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(docs.sparkSession, d, small)
        got = out.collect()
        assert stage(docs.sparkSession, empty, small).count() == 0
        if name != "best_fit_packing":
            assert out.columns == d.columns
            assert all(r["__id"] in ("x", None) and r["spans"] in ("x", None) for r in got)
        n = {"quality_rules": lambda: len(got) < d.count(), "line_dedup": lambda: len(got) == d.count(), "simhash_near_dedup": lambda: len({r.text or "" for r in got}) == len(got), "decontamination": lambda: len(got) == d.count(), "best_fit_packing": lambda: len(got) >= d.count()}
        assert n[name](), name


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages by hand: what passes, without later copies of runs, one of each near copies, no leaks, in pieces."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(41)
    shared = "\n".join(prose(600 + k, 9) for k in range(4))
    question = (7, "when Anna walked 3 km from the old mill and Emil walked 5 km how far were they apart then")
    texts = []
    for k in range(70):
        lines = [prose(7000 + 20 * k + j, r.randint(4, 20)) for j in range(r.randint(1, 6))]
        if k % 9 == 3:
            lines[1:1] = shared.split("\n")
        if k % 13 == 5:
            lines.append(question[1].replace("3", str(k)).replace("Emil", "Dora"))
        if k % 11 == 7:
            lines = [" ".join(w + "%%" for w in x.split()) for x in lines]
        texts.append((k, "\n".join(lines)))
    texts += [(100, texts[0][1]), (101, texts[20][1] + " end"), (102, None), (103, ""), (104, "too short"), (105, "again and again " * 30), (106, prose(77, 4000)), (20, texts[20][1])]
    good = {k for k in range(70) if k % 6 != 1 and k % 11 != 7} | {100, 101, 105, 106}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k in good), 0) for k in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([question], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    ratio = ratio_by_hand(texts, good)
    kept = [(i, t) for i, t in texts if not base_by_hand(t)[-1] and ratio[buckets_by_hand(t)].mean() >= quality_rules.THRESHOLD]
    assert 40 < len(kept) < len(texts) - 5
    keys = {(x.doc_id, x.text): (x["__id"], x["__key"]) for x in line_dedup.keyed(spark.createDataFrame(kept, "doc_id long, text string")).select("row.doc_id", "text", "__id", "__key").collect()}
    gone = runs_of({(keys[x], x[1]) for x in kept})
    clean = [(i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[keys[i, t]])) for i, t in kept]
    assert clean != kept
    one, fps = {}, {x: fingerprint_by_hand(x[1]) for x in clean}
    group = {x: x for x in fps}
    for _ in range(len(fps)):
        before = dict(group)
        for a, b in itertools.combinations(fps, 2):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    one = sorted(set(group.values()))
    last = [(i, t) for i, t in one if not leaks_by_hand(t, question[1])]
    assert len(last) < len(one) < len(clean)
    tk = Tokenizer.from_file(public_tokenizers.path(packing.MODEL))
    want = collections.Counter()
    for i, t in last:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, d).collect()
    assert collections.Counter(tuple(x)[:5] for x in got) == want
    assert len({x.sequence_id for x in got}) == -(-sum(x.length for x in got) // 2048)


def test_sql_gives_the_same(spark, small):
    import duckdb

    from plycast.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, small)
        got = con.execute(sql)
        cols = [x[0] for x in got.description]
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, got.fetchall()))


def test_queries_of_one_session_keep_their_tables(spark, small):
    """A pipeline that removes its stages' tables leaves those of queries in other threads."""
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline
    from plycast.llm import common
    from plycast.llm.queries import QUERIES

    left = lambda: {f for f in os.listdir(common.shared(spark)) if f.startswith("table-")}
    before = left()
    rows = lambda name: sorted(map(repr, QUERIES[name](spark, small).collect()))
    names = ["op4_suffix_array_dedup", "op1_line_dedup", "op10_pii"] * 2
    with ThreadPoolExecutor(4) as pool:
        whole = pool.submit(lambda: sorted(map(repr, (r[:5] for r in corpus_pipeline.run(spark, small).collect()))))
        found = list(pool.map(rows, names))
        packed = whole.result()
    assert packed == sorted(map(repr, (r[:5] for r in corpus_pipeline.run(spark, small).collect())))
    assert found[:3] == found[3:] and all(found)
    made = left() - before
    with common.tables() as mine:
        assert rows("op4_suffix_array_dedup") == found[0]
    assert mine and {os.path.basename(p) for p in mine} == left() - before - made
    common.discard(spark, *mine)
    assert left() - before == made
