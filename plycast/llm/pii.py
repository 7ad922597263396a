"""Personal data: fixed patterns, then information-theoretic sanitisation, in DataFrame operations alone.

The patterns find e-mail addresses, IP numbers, card numbers (Luhn), phone numbers and secrets (long runs of letters
and digits mixed, as keys and tokens are). The protected entities are these values, the groups that they belong to (an
address's domain, an IP number's network, a card's issuer, a phone number's prefix) and, as a last step back, their
kinds. A term (a word of ``TERM`` letters or more outside of addresses and secrets) discloses an entity by its pointwise
mutual information, estimated from document frequencies over the whole corpus. Where that is above 0 and ``DISCLOSE`` or
more of the entity's information content, so that the term all but gives the entity away, rests on ``SUPPORT`` or more
documents with different surroundings of the entity, and amounts to ``EVIDENCE`` nats or more over all documents with
both (chance alone gives that to one pair in e^EVIDENCE), every occurrence of the term in any document becomes a span
too, of kind ``term``. ``redact`` generalises all spans, terms included, to their kinds.

Nothing pairs terms with terms; pairs are of a document's entities and its different terms. They are counted before
anything is joined to them. Places in a text are running sums by doubling, so time grows with n log n of its matches.

Defined cases: null text is empty and has no spans; matches of a kind are leftmost and do not overlap, those that fail
their test are dropped; spans of different kinds may overlap; terms are read from left to right together with addresses
and secrets, whose letters are no terms; repeated rows get equal results and count as one document in the frequencies of
pairs, entities and terms; terms of equal scores are all kept; other columns are not looked at (``redact`` keeps them,
whatever their names); an empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plycast.llm.common import blank_null, cut, keyed, spread_join, unpacked, written

# Possessive quantifiers keep the patterns' matches but stop them from trying a long run again at each of its characters.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of digits, and only those of 16 to 19
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
SECRET = "(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+"
KINDS = {**PATTERNS, "secret": SECRET}
#: What a text must hold for a kind to be looked for at all.
_HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike("[0-9](?:[ -]?[0-9]){15}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: t.rlike("[A-Za-z0-9]{24}"),
}
#: ``REACH`` characters on either side are the surroundings of a value.
TERM, REACH, SUPPORT, DISCLOSE, EVIDENCE = 4, 60, 3, 0.95, 14.0
#: Terms, and documents that hold disclosing ones, are sent to all tasks up to this many, else joined by a shuffle.
MAX_SENT = 50_000
_WORD = rf"\p{{L}}{{{TERM},}}+"
#: Rows with a span that is no term.
_SOME = " or ".join(f"size({k}) > 0" for k in KINDS)
_BYTE = "^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))


_TESTS = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda x: x.rlike(_BYTE)),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
    "secret": lambda v: v.rlike("[A-Za-z].*[A-Za-z]") & (F.length(_digits(v)) >= 4),
}


#: A match: its place in code points, its place in bytes, and its text.
_MATCH = "array<struct<start:int,end:int,from:int,to:int,value:string>>"


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, join) -> Column:
    """For each place of an array, ``join`` (associative) over all up to there, by doubling."""
    steps = lambda a: F.transform(F.sequence(F.lit(0), F.log2(F.greatest(F.size(a), F.lit(1))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    further = lambda a, step: F.transform(a, lambda x, i: F.when(i >= step, join(F.get(a, i - step), x)).otherwise(x))
    return _bound(values, lambda a: F.aggregate(steps(a), a, further))


def matches(text: Column, pattern: str) -> Column:
    """All matches: the texts between them give their places."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))

    def placed(b: Column) -> Column:
        ends = lambda f: _running(F.transform(b["values"], lambda v, i: f(F.get(b["gaps"], i)) + f(v)), lambda x, y: x + y)

        def one(e: Column) -> Column:
            end, to = (lambda i: F.get(e["chars"], i)), (lambda i: F.get(e["bytes"], i))
            return F.transform(b["values"], lambda v, i: F.struct((end(i) - F.length(v)).alias("start"), end(i).alias("end"), (to(i) - F.octet_length(v)).alias("from"), to(i).alias("to"), v.alias("value")))

        plain = F.length(text) == F.octet_length(text)
        return _bound(ends(F.length), lambda c: _bound(F.struct(c.alias("chars"), F.when(plain, c).otherwise(ends(F.octet_length)).alias("bytes")), one))

    return _bound(both, placed)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind, its matches that pass their test."""
    passing = lambda k: lambda m: _TESTS[k](m["value"])
    return {k: F.when(_HINTS[k](text), F.filter(matches(text, p), passing(k))).otherwise(F.array().cast(_MATCH)) for k, p in KINDS.items()}


def _every(kinds: tuple[str, ...]) -> Column:
    tagged = lambda k: lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["from"].alias("from"), m["to"].alias("to"), F.lit(k).alias("kind"), m["value"].alias("value"))
    return F.array_sort(F.concat(*(F.transform(k, tagged(k)) for k in kinds)))


def _generalised(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted spans replaced by its kind in brackets; spans that overlap go as the first of them."""

    def replaced(s: Column) -> Column:
        def pieces(b: Column) -> Column:
            reach, raw = (lambda i: F.coalesce(F.get(b["ends"], i - 1), F.lit(0))), b["raw"]
            piece = lambda m, i: F.when(m["from"] < reach(i), "").otherwise(F.concat(F.substring(raw, reach(i) + 1, m["from"] - reach(i)).cast("string"), F.lit("["), m["kind"], F.lit("]")))
            return F.concat(F.array_join(F.transform(s, piece), ""), F.substring(raw, reach(F.size(b["ends"])) + 1, F.octet_length(raw)).cast("string"))

        ends = _running(F.transform(s, lambda m: m["to"]), F.greatest)
        return _bound(F.struct(ends.alias("ends"), text.cast("binary").alias("raw")), pieces)

    return F.when(F.size(spans) > 0, _bound(spans, replaced)).otherwise(text)


def _with_base(docs: DataFrame) -> DataFrame:
    """The rows as ``row``, their keys, texts and spans of each kind."""
    d = keyed(docs).withColumn("text", blank_null())
    return d.select("row", "__id", "__key", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))


_HIDES = f"{PATTERNS['email']}|{SECRET}"


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    rest = F.when(F.contains(text, F.lit("@")) | _HINTS["secret"](text), F.regexp_replace(text, _HIDES, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0)), F.lower))


def _places(text: Column, terms: Column) -> Column:
    """Matches of those terms."""
    told = F.filter(matches(text, f"{_HIDES}|{_WORD}"), lambda m: F.array_contains(terms, F.lower(m["value"])))
    return F.when(terms.isNull(), F.array().cast(_MATCH)).otherwise(told)


def _entities(found: DataFrame) -> DataFrame:
    """A row for each document and entity in it, with a hash of the surroundings, one for copies of a document."""

    def told(raw: Column) -> Column:
        def one(m: Column) -> Column:
            lo = F.greatest(m["from"] - REACH, F.lit(0))
            around = F.xxhash64(F.substring(raw, lo + 1, m["from"] - lo), F.substring(raw, m["to"] + 1, F.lit(REACH)))
            return F.struct(m["kind"].alias("kind"), m["value"].alias("value"), around.alias("around"))

        return F.transform(_every(tuple(KINDS)), one)

    m = found.select("__id", "__key", F.explode(_bound(F.col("text").cast("binary"), told)).alias("m"))
    kind, value = F.col("m.kind"), F.lower("m.value")
    whole = F.when(kind.isin("email", "secret"), value).when(kind == "ip", F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(_digits(value))
    group = F.when(kind == "email", F.regexp_extract(whole, "@(.*)$", 1)).when(kind == "ip", F.substring_index(whole, ".", 3)).when(kind == "card", F.substring(whole, 1, 6)).when(kind == "phone", F.substring(whole, 1, 4)).otherwise("")
    every = F.array(F.xxhash64(kind, F.lit("value"), whole), F.xxhash64(kind, F.lit("group"), group), F.xxhash64(kind, F.lit("kind")))
    return m.select("__id", "__key", F.explode(every).alias("entity"), "m.around").groupBy("__id", "__key", "entity").agg(F.min("around").alias("around"))


def supported(entities: DataFrame, words: DataFrame) -> DataFrame:
    """entity, d_e, term and d_et of the pairs that stand in documents enough with different surroundings."""
    pairs = entities.join(words, ["__id", "__key"]).select("entity", "d_e", "around", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "d_e", "term", "around").agg(F.count("*").alias("n"))
    return pairs.groupBy("entity", "d_e", "term").agg(F.sum("n").alias("d_et"), F.count("*").alias("support")).filter(F.col("support") >= SUPPORT).drop("support")


def disclosing(docs: DataFrame) -> DataFrame:
    """A row for each document and each disclosing term in it."""
    every = keyed(docs.select("doc_id", "text")).select("__id", "__key", blank_null().alias("text"))
    n = every.select("__id", "__key").distinct().count()
    hinted = functools.reduce(lambda x, y: x | y, (h(F.col("text")) for h in _HINTS.values()))
    some = every.filter(hinted)
    # stored, as a filter on spans would find them twice
    some = written(some.select("__id", "__key", "text", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))).filter(_SOME)
    entities = cut(_entities(some))
    words = written(some.select("__id", "__key", _terms(F.col("text")).alias("terms")).dropDuplicates(["__id", "__key"]))
    # entities of fewer documents can have no support, and need no pairs; kinds are entities of very many
    of_entity = cut(entities.groupBy("entity").agg(F.count("*").alias("d_e")).filter(F.col("d_e") >= SUPPORT))
    entities = spread_join(entities, of_entity.withColumn("n", F.col("d_e")), ["entity"], "n")
    # a term stands in as many documents at least as it does beside entities; pairs that fail on that alone need no count
    beside = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("d_least"))
    pmi = lambda d_t: F.log(F.lit(n) * F.col("d_et") / (F.col("d_e") * F.col(d_t)))
    told = lambda d_t: (pmi(d_t) > 0) & (pmi(d_t) >= DISCLOSE * F.log(F.lit(n) / F.col("d_e"))) & (F.col("d_et") * pmi(d_t) >= EVIDENCE)
    kept = cut(supported(entities, words).join(beside, "term").filter(told("d_least")).drop("d_least"))
    wanted = kept.select("term").distinct()
    n_wanted = wanted.count()
    if not n_wanted:
        return some.select("__id", "__key", F.lit("").alias("term")).filter(F.lit(False))
    wanted = F.broadcast(wanted) if n_wanted <= MAX_SENT else wanted
    held = cut(every.select("__id", "__key", F.explode(_terms(F.col("text"))).alias("term")).join(wanted, "term", "left_semi").distinct())
    of_term = held.groupBy("term").agg(F.count("*").alias("d_t"))
    return held.join(kept.join(of_term, "term").filter(told("d_t")).select("term").distinct(), "term", "left_semi")


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as ``row``, their text and the spans of each kind, terms last."""
    found = _with_base(docs)
    own = cut(disclosing(docs).groupBy("__id", "__key").agg(F.collect_set("term").alias("terms")))
    own = F.broadcast(own) if own.count() <= MAX_SENT else own
    return found.join(own, ["__id", "__key"], "left").select("row", "text", *KINDS, _places(F.col("text"), F.col("terms")).alias("term"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


def pii(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts, a hash of the base spans, all spans and how many the method adds."""
    base = F.concat(*(_listed(k, F.col(k)) for k in PATTERNS))
    more = F.concat(_listed("secret", F.col("secret")), _listed("term", F.col("term")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS]
    added = [F.size(k).cast("long").alias(f"n_{k}") for k in ("secret", "term")]
    every = sum((F.size(k) for k in KINDS), F.size("term")).cast("long").alias("n_spans")
    out = with_spans(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, more), ",").alias("spans"), *added, every)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span that ``pii`` finds in ``text`` generalised to its kind; a null text stays null."""
    done = _generalised(F.col("text"), _every((*KINDS, "term")))
    return with_spans(docs).select(*unpacked(docs, text=F.when(F.col("row.text").isNotNull(), done)))
