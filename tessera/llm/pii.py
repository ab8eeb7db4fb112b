"""Operator 1: personal data by weak supervision, in DataFrame and SQL functions only.

Base spans follow fixed patterns and checks (email, ip, card, phone). Beside them the method looks
at candidates: base matches of either outcome, and looser forms (spelled-out addresses, numbers
without a country code, IPv6). Four labelers vote on each candidate: the pattern check, a gazetteer
(domain endings, card issuers, country codes, private networks), the words before it, and its
edges. Expectation-maximisation estimates from the votes alone how reliable each labeler is for
each kind (one fold over counts of vote patterns, whose number is bounded by the votes' values),
and its posteriors train a naive Bayes span classifier. Candidates it is sure of (``SURE``) and
which overlap no base span are added; base spans always stay.

How it runs: one scan cuts the candidates out of the texts into a small table; statistics are
bounded counts, and the trained classifier is a few dozen numbers in the plan, so adding spans
needs no join and no text is shuffled. Patterns use possessive quantifiers and look-behinds, which
match the same spans but neither recurse nor run quadratically on long texts. Positions are running
sums over the gaps between matches, overlaps are found by running ends over sorted spans, and running
values take as many rounds as the number of values has bits, so n spans of a text cost n log n.
A candidate's context is at most 30 characters, over one earlier match of its pattern at most.

Defined cases: a null text is the empty text, which has no spans and the digest of the empty string;
rows are independent, so repeated rows and null or equal doc_ids keep their own spans; further
columns are ignored (kept by ``redact``); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, table, text_or_empty

#: In the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone")
SURE, ROUNDS = 0.95, 25

# The patterns of the contract, without backtracking.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

# Looser forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
# Gazetteers.
GAZETTEER = {
    "email": r"(?i)(\.|[\[(]dot[\])] ?)(com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|shop|site|store|tech|cloud|[a-z]{2})$",
    "ip": r"^(10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|fe80:|2001:)",
    "card": r"^(4|5[0-8]|2[2-7]|3[0-9]|6011|6[2-7])",
    "phone": r"^\+ ?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])",
}
# Words that speak for a kind, and words that speak against any.
FOR = {
    "email": r"(e-?mail|contact|write to|correo|courriel|adresse)\W*$",
    "ip": r"(\bip|host|server|login from|address|adresse)\W*$",
    "card": r"(card|visa|mastercard|credit|payment|karte|carte|tarjeta)\W*(number|no|nr)?\W*$",
    "phone": r"(tel|phone|call|fax|mobile|cell|telefon|tel[eé]fono|t[eé]l[eé]phone)\W*(number|no|nr)?\W*$",
}
AGAINST = r"(version|isbn|token|order|invoice|section|chapter|serial|sku)\W*(number|no|nr)?\W*$"

_CANDIDATE = "struct<k:int,s:int,e:int,m:string,l:string,r:string,shape:int>"
#: Characters in one piece of a text.
PIECE = 1024


def _q(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _running(values: str, op: str) -> str:
    """SQL: running values of an array of integers under an associative ``op`` over ``x`` and ``y``.

    In each round a value takes in the one that stands twice as far before it as in the last round.
    """
    step = f"transform(v, (x, i) -> if(i < shiftleft(1, d), x, transform(array(get(v, i - shiftleft(1, d))), y -> {op})[0]))"
    return f"transform(array({values}), vs -> aggregate(sequence(0, int(ceil(log2(greatest(size(vs), 2)))) - 1), vs, (v, d) -> {step}))[0]"


def _matches(kind: int, pattern: str, shape: str, text: str) -> str:
    """SQL: candidates of one pattern, placed by the lengths of the matches and of the gaps before them.

    ``shape`` is SQL over the match ``m``: 2 for a base span, 1 for a loose form, 0 for a failed one,
    -1 for none.
    """
    before = "if(length(get(gaps, n)) >= 30 or n = 0, get(gaps, n), concat(get(ms, n - 1), get(gaps, n)))"
    after = "if(get(gaps, n + 1) = '' and n + 1 < size(ms), get(ms, n + 1), get(gaps, n + 1))"
    ends = _running("transform(ms, (m, n) -> length(get(gaps, n)) + length(m))", "x + y")
    each = f"named_struct('k', {kind}, 's', get(ends, n) - length(m), 'e', get(ends, n), 'm', m, 'l', lower(right({before}, 30)), 'r', left({after}, 1), 'shape', {shape})"
    placed = f"transform(array({ends}), ends -> filter(transform(ms, (m, n) -> {each}), c -> c.shape >= 0))[0]"
    found = f"transform(array(split({text}, {_q(pattern)}, -1)), gaps -> {placed})[0]"
    return f"transform(array(regexp_extract_all({text}, {_q(pattern)}, 0)), ms -> if(size(ms) = 0, cast(array() as array<{_CANDIDATE}>), {found}))[0]"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_SMALL = "forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(right(x, 4) as int), 0) <= 255)"
_BASE = {
    "email": (EMAIL, "2"),
    "ip": (IP, f"if({_SMALL}, 2, 0)"),
    "card": (CARD, f"case when length({_DIGITS}) not between 13 and 19 then -1 when length({_DIGITS}) >= 14 and luhn_check({_DIGITS}) then 2 else 0 end"),
    "phone": (PHONE, f"if(length({_DIGITS}) between 10 and 15, 2, -1)"),
}


def candidates(text: str = "text") -> str:
    """SQL over a text: all candidates, base matches first."""
    parts = [_matches(KINDS.index(k), *_BASE[k], text) for k in KINDS] + [_matches(KINDS.index(k), p, "1", text) for k, p in LOOSE.items()]
    return f"concat({', '.join(parts)})"


def _by_kind(of: dict[str, str], otherwise: str = "0") -> str:
    return "case c.k " + " ".join(f"when {KINDS.index(k)} then {sql}" for k, sql in of.items()) + f" else {otherwise} end"


#: The votes (-1 against, 0 none, 1 for) and shape values of a candidate ``c``, as SQL.
VOTES = {
    "pattern": "c.shape - 1",
    "gazetteer": _by_kind({k: f"if(c.m rlike {_q(p)}, 1, {0 if k in ('ip', 'phone') else -1})" for k, p in GAZETTEER.items()}),
    "context": _by_kind({k: f"case when c.l rlike {_q(p)} then 1 when c.l rlike {_q(AGAINST)} then -1 else 0 end" for k, p in FOR.items()}),
    "edges": "if(right(c.l, 1) rlike '[a-z0-9_]' or c.r rlike '[A-Za-z0-9_]', -1, 1)",
}
FEATURES = VOTES | {
    "digits": "least(5, length(regexp_replace(c.m, '[^0-9]', '')) div 4)",
    "breaks": "least(3, length(regexp_replace(c.m, '[A-Za-z0-9]', '')))",
}


def counts(found: DataFrame, spots: str = "spots") -> DataFrame:
    """How often each combination of kind and features occurs; ``found`` has the array ``spots``."""
    each = found.select(F.explode(spots).alias("c")).select("c.k", *[F.expr(sql).cast("int").alias(name) for name, sql in FEATURES.items()])
    return each.groupBy("k", *FEATURES).agg(F.count("*").cast("double").alias("n"))


def reliabilities(combinations: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """k, prior, yes and no: P(vote | personal or not) of each labeler (rows) and vote (columns).

    A labeler that abstains (vote 0) says nothing; its other two votes share the probability.

    Expectation-maximisation as one fold over the vote patterns of each kind, of which there are at
    most 3 to the number of labelers.
    """
    names = list(VOTES)
    patterns = combinations.groupBy("k", *names).agg(F.sum("n").alias("n"))
    rows = patterns.groupBy("k").agg(F.collect_list(F.struct(F.array(*names).alias("v"), "n")).alias("pats"))
    lik = "aggregate(zip_with(p.v, th.{0}, (v, row) -> if(v = 0, 1D, element_at(row, v + 2))), 1D, (x, y) -> x * y)"
    yes, no = f"th.prior * {lik.format('yes')}", f"(1 - th.prior) * {lik.format('no')}"
    expect = f"transform(pats, p -> named_struct('v', p.v, 'yes', p.n * ({yes}) / (({yes}) + ({no})), 'no', p.n * ({no}) / (({yes}) + ({no}))))"

    def table_of(side: str) -> str:
        cell = f"(aggregate(q, 0D, (s, p) -> s + if(element_at(p.v, l) = v, p.{side}, 0D)) + 1D) / (aggregate(q, 0D, (s, p) -> s + if(element_at(p.v, l) = 0, 0D, p.{side})) + 2D)"
        return f"transform(sequence(1, {len(names)}), l -> transform(sequence(-1, 1), v -> {cell}))"

    total = "aggregate(q, 0D, (s, p) -> s + p.{0})"
    maximise = f"transform(array({expect}), q -> named_struct('prior', ({total.format('yes')} + 1D) / ({total.format('yes')} + {total.format('no')} + 2D), 'yes', {table_of('yes')}, 'no', {table_of('no')}))[0]"
    start = f"named_struct('prior', 0.5D, 'yes', array_repeat(array(0.2D, 0D, 0.8D), {len(names)}), 'no', array_repeat(array(0.8D, 0D, 0.2D), {len(names)}))"
    return rows.select("k", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (th, i) -> {maximise})").alias("th")).select("k", "th.*")


def weights(combinations: DataFrame, votes: DataFrame) -> dict[tuple[int, str, int], float]:
    """Log odds of the span classifier by (kind, feature, value); feature '' is the prior."""
    names = list(VOTES)
    lik = "aggregate(zip_with(array({1}), {0}, (v, row) -> if(v = 0, 1D, element_at(row, v + 2))), 1D, (x, y) -> x * y)"
    yes, no = lik.format("yes", ", ".join(names)), lik.format("no", ", ".join(names))
    soft = combinations.join(F.broadcast(votes), "k").withColumn("q", F.expr(f"prior * {yes} / (prior * {yes} + (1 - prior) * {no})"))
    long = soft.select("k", "n", "q", F.explode(F.create_map(F.lit(""), F.lit(0), *[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "value"))
    sums = long.groupBy("k", "feature", "value").agg(F.sum(F.col("n") * F.col("q")).alias("yes"), F.sum(F.col("n") * (1 - F.col("q"))).alias("no")).collect()
    prior = {r.k: (r.yes, r.no) for r in sums if r.feature == ""}
    found = {(k, "", 0): math.log((y + 1) / (n + 1)) for k, (y, n) in prior.items()}
    for r in sums:
        if r.feature and not (r.feature in VOTES and r.value == 0):
            y, n = prior[r.k]
            found[r.k, r.feature, r.value] = math.log((r.yes + 0.5) / (y + 3)) - math.log((r.no + 0.5) / (n + 3))
    return found


def classifier(model: dict[tuple[int, str, int], float]) -> str:
    """SQL: the probability that candidate ``c`` is personal data."""

    def score(k: int) -> str:
        parts = [f"{model.get((k, '', 0), -9.0)!r}D"]
        for name, sql in FEATURES.items():
            if cases := sorted((v, w) for (kind, f, v), w in model.items() if kind == k and f == name):
                parts.append(f"case {sql} " + " ".join(f"when {v} then {w!r}D" for v, w in cases) + " else 0D end")
        return " + ".join(parts)

    return f"1 / (1 + exp(-({_by_kind({k: score(i) for i, k in enumerate(KINDS)}, '0D')})))"


def train(spotted: DataFrame, spots: str = "spots") -> tuple[DataFrame, str]:
    """Rows with their candidates (array ``spots``) as a table in the shared folder, and the classifier learned from them."""
    found = cut(spotted)
    combinations = cut(counts(found, spots))
    return found, classifier(weights(combinations, reliabilities(combinations)))


def _spans(c: str, model: str, sure: float) -> str:
    """SQL: base and added spans of the candidates ``c``, by start and kind.

    An added span overlaps no base span, and no added one before it that overlaps none.
    """
    base = f"transform(filter({c}, c -> c.shape = 2), c -> named_struct('s', c.s, 'a', 0, 'k', c.k, 'e', c.e))"
    sure_of = f"transform(filter({c}, c -> c.shape < 2 and {model} >= {sure}), c -> named_struct('s', c.s, 'a', 1, 'k', c.k, 'e', c.e))"
    # How far base spans reach up to a span, where the next one starts, and how far the free added ones before it reach.
    reach = _running("transform(mg, x -> if(x.a = 0, x.e, 0))", "greatest(x, y)")
    next_ = f"transform(reverse({_running('transform(reverse(mg), x -> if(x.a = 0, -x.s, -2147483647))', 'greatest(x, y)')}), x -> -x)"
    free = "(x.a = 1 and x.s >= get(reach, i) and x.e <= get(nexts, i))"
    others = _running(f"transform(mg, (x, i) -> if({free}, x.e, 0))", "greatest(x, y)")
    stays = f"transform(mg, (x, i) -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'stays', x.a = 0 or {free} and x.s >= coalesce(get(others, i - 1), 0)))"
    kept = f"transform(array({reach}), reach -> transform(array({next_}), nexts -> transform(array({others}), others -> filter({stays}, c -> c.stays))[0])[0])[0]"
    kept = f"transform(array(array_sort(concat(base, added))), mg -> {kept})[0]"
    both = f"if(size(added) = 0, {_simple('array_sort(base)')}, {_simple(kept)})"
    return f"transform(array({base}), base -> transform(array({sure_of}), added -> {both})[0])[0]"


def _simple(spans: str) -> str:
    return f"transform({spans}, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))"


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, c -> concat_ws(':', element_at({names}, c.k + 1), c.s, c.e)), ',')"


def find(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, base (array of struct s, k, e) and spans (likewise, with the added ones)."""
    spotted = text_or_empty(docs, "doc_id").select("doc_id", F.expr(candidates()).alias("spots"))
    found, model = train(spotted)
    return found.select("doc_id", F.expr(f"array_sort({_simple('filter(spots, c -> c.shape = 2)')})").alias("base"), F.expr(_spans("spots", model, sure)).alias("spans"))


def _stretch(start: str, end: str) -> str:
    """SQL: the characters from ``start`` to before ``end`` of the text whose pieces of ``PIECE`` characters are ``ps``."""
    first, last = f"({start}) div {PIECE}", f"({end} - 1) div {PIECE}"
    several = f"concat(substring(get(ps, int({first})), ({start}) % {PIECE} + 1, {PIECE}), if({last} > {first} + 1, array_join(transform(sequence({first} + 1, {last} - 1), j -> get(ps, int(j))), ''), ''), left(get(ps, int({last})), ({end} - 1) % {PIECE} + 1))"
    return f"case when {end} <= {start} then '' when {first} = {last} then substring(get(ps, int({first})), ({start}) % {PIECE} + 1, {end} - ({start})) else {several} end"


def redact(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; n_chars follows."""
    spots = fresh(docs, "_spots")
    found, model = train(docs.withColumn(spots, F.expr(candidates("coalesce(text, '')"))), spots)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    upto = _running("transform(spans, x -> x.e)", "greatest(x, y)")
    parts = f"transform(array({upto}), upto -> transform(spans, (x, i) -> transform(array(coalesce(get(upto, i - 1), 0)), z -> if(x.s >= z, concat({_stretch('z', 'x.s')}, element_at({names}, x.k + 1)), ''))[0]))[0]"
    rest = f"transform(array(array_max(transform(spans, c -> c.e))), z -> {_stretch('z', 'length(text)')})"
    pieces = f"if(length(text) <= {PIECE}, array(text), regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0))"
    text = f"transform(array({_spans(spots, model, sure)}), spans -> if(size(spans) = 0, text, transform(array({pieces}), ps -> array_join(concat({parts}, {rest}), ''))[0]))[0]"
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), F.expr(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: counts and digest of the base spans and all spans of each document."""
    found = find(table(spark, sf_dir, "documents"))
    number = [F.expr(f"size(filter(base, c -> c.k = {i}))").cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *number, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))
