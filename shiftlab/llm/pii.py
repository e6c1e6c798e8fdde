"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans.  Three labelers vote on each (+1 personal data, -1 not,
0 no opinion): the strict pattern with its checks, gazetteers, and the words
before the span.  Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind; its posteriors are the
soft labels on which a naive-Bayes span classifier (votes and shape) is
trained.  Spans of the strict patterns always stay; the classifier decides on
the others.  What reaches the driver are counts of vote and shape patterns,
whose number is bounded by the features, not by the data.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The strict patterns, fixed.  Possessive quantifiers and look-behinds do not
# change what matches; they keep long runs linear: a run that fails at its first
# character fails at the others.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose spans the classifier decides on.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
# Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "us", "ca")
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mail|contact|kontakt|correo|courriel|write|schreib|escrib)\W{0,3}\w{0,4}\W{0,3}$",
    "ip": r"(?i)(?:\bip|address|adresse|direcci\w+|host|server|servidor|serveur|login)\W{0,3}\w{0,4}\W{0,3}$",
    "card": r"(?i)(?:card|visa|master\w*|amex|karte|carte|tarjeta|credit\w*|pago|payment)\W{0,3}\w{0,6}\W{0,3}$",
    "phone": r"(?i)(?:tel|phone|fon|call|fax|mobil\w*|tel\w+|llam\w+|appel\w*|anruf\w*)\W{0,3}\w{0,4}\W{0,3}$",
}
#: Words that say a number is something else.
OTHER = r"(?i)(?:version|ver|isbn|issn|order|bestellung|pedido|commande|no|nr|section|rev|page|id)\W{0,3}$"
CONTEXT_CHARS = 32
THRESHOLD = 0.5
ROUNDS = 50
SPAN = "struct<kind:string,start:int,end:int,strict:boolean,votes:array<int>,shape:array<string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of leftmost non-overlapping matches, in code points.

    The pieces between matches come from a split by the same pattern, so that
    starts follow from lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,m:string>>"

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(
            F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)),
                       lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    out = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(k):
        d = F.substring(digits, n - k, F.lit(1)).cast("int")  # k = 0: the last digit
        twice = d * 2
        return F.when(k % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of the strict pattern passes its checks."""
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_like(p, F.lit("^0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?$")))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        last = F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))
        return F.when(last.isin(*TOP_DOMAINS), 1).when(F.regexp_like(last, F.lit("^[0-9]+$")), -1).otherwise(0)
    if kind == "ip":
        first = F.regexp_extract(m, "^([0-9]+)", 1).cast("decimal(38,0)")
        return F.when(first.isin(0, 255), -1).when(first.between(1, 223), 1).otherwise(0)
    digits = _digits(m)
    if kind == "card":  # issuer ranges
        return F.when(F.regexp_like(digits, F.lit("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")), 1).otherwise(-1)
    return F.when(F.regexp_like(digits, F.lit("^(?:0{3}|1{3}|9{9})")), -1).when(
        F.regexp_like(m, F.lit(r"^\+(?:1|3[0-9]|4[0-9])")), 1).otherwise(0)


def _judged(kind: str, text: Column, span: Column, strict: Column) -> Column:
    left = F.substring(text, F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0)) + 1,
                       F.least(span["start"], F.lit(CONTEXT_CHARS)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    context = F.when(F.regexp_like(left, F.lit(CONTEXT[kind])), 1).when(
        F.regexp_like(left, F.lit(OTHER)), -1).otherwise(0)
    edge = F.when(F.regexp_like(F.right(left, F.lit(1)), F.lit(r"^[\p{L}\p{N}_/]$")), "stuck").otherwise("free")
    tail = F.when(F.regexp_like(after, F.lit(r"^[\p{L}\p{N}_/]$")), "stuck").otherwise("free")
    size = F.least(F.length(_digits(span["m"])), F.lit(20)).cast("string")
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                    strict.alias("strict"),
                    F.array(F.when(strict, 1).otherwise(-1), _gazetteer(kind, span["m"]), context).alias("votes"),
                    F.array(edge, tail, size).alias("shape"))


def candidates(text: Column) -> Column:
    """All proposed spans of a text with votes and shape, by kind and start; null text: none."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    for kind in KINDS:
        tried = matches(text, STRICT[kind])
        if kind == "card":  # other numbers are no near misses
            tried = F.filter(tried, lambda x: F.length(_digits(x["m"])).between(13, 19))
        parts.append(F.transform(tried, _judge(kind, text, True)))
        if kind in LOOSE:
            parts.append(F.transform(matches(text, LOOSE[kind]), _judge(kind, text, False)))
    return F.concat(*parts)


def _judge(kind: str, text: Column, strict: bool):
    def judge(span):
        return _judged(kind, text, span, valid(kind, span["m"]) if strict else F.lit(False))

    return judge


def _pattern_counts(spans: DataFrame, column: str) -> list[tuple]:
    one = spans.select(F.explode(column).alias("s")).select("s.kind", "s.votes", "s.shape")
    return [(r["kind"], tuple(r["votes"]), tuple(r["shape"]), r["count"])
            for r in one.groupBy("kind", "votes", "shape").count().toLocalIterator()]


def reliabilities(counts: list[tuple], rounds: int = ROUNDS) -> tuple[dict, dict]:
    """EM over vote patterns: ((kind, votes) -> posterior, (kind, labeler, truth, vote) -> rate).

    Starts from the sums of votes; pseudo-counts that hold a labeler for better
    than chance keep the two classes from changing places.
    """
    votes: dict[tuple, float] = defaultdict(float)
    for kind, v, _, n in sorted(counts):
        votes[kind, v] += n
    post = {k: 1 / (1 + math.exp(-2.0 * (2 * k[1][0] + sum(k[1][1:])))) for k in votes}
    rate: dict[tuple, float] = {}
    for _ in range(rounds):
        total = {kind: [1.0, 1.0] for kind in KINDS}
        seen: dict[tuple, float] = {(kind, j, y, v): 4.0 if v == (1 if y else -1) else 1.0
                                    for kind in KINDS for j in range(3) for y in (0, 1) for v in (-1, 0, 1)}
        for (kind, v), n in votes.items():
            for y, q in ((1, post[kind, v]), (0, 1 - post[kind, v])):
                total[kind][y] += n * q
                for j, x in enumerate(v):
                    seen[kind, j, y, x] += n * q
        rate = {(kind, j, y, x): s / sum(seen[kind, j, y, z] for z in (-1, 0, 1)) for (kind, j, y, x), s in seen.items()}
        for kind, v in votes:
            odds = math.log(total[kind][1] / total[kind][0]) + sum(
                math.log(rate[kind, j, 1, x] / rate[kind, j, 0, x]) for j, x in enumerate(v))
            post[kind, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post, rate


def train(counts: list[tuple], rounds: int = ROUNDS) -> dict[str, float]:
    """Log odds of the span classifier by feature ("kind|place|value"); "kind|prior" is the prior."""
    post, _ = reliabilities(counts, rounds)
    soft: dict[tuple, list[float]] = defaultdict(lambda: [1.0, 1.0])
    for kind, votes, shape, n in sorted(counts):
        q = post[kind, votes]
        for feature in [f"{kind}|prior", *_features(kind, votes, shape)]:
            soft[feature][1] += n * q
            soft[feature][0] += n * (1 - q)
    weight = {}
    for feature, (no, yes) in soft.items():
        base_no, base_yes = soft[feature.split("|")[0] + "|prior"]
        weight[feature] = math.log(yes / no) if feature.endswith("|prior") else math.log((yes / base_yes) / (no / base_no))
    return weight


def _features(kind: str, votes, shape) -> list[str]:
    return [*(f"{kind}|v{j}|{x}" for j, x in enumerate(votes)), *(f"{kind}|s{j}|{x}" for j, x in enumerate(shape))]


def _score(model: dict[str, float], s: Column) -> Column:
    table = F.create_map(*[x for k, v in sorted(model.items()) for x in (F.lit(k), F.lit(float(v)))]) if model else None
    if table is None:
        return F.lit(0.0)
    get = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    total = get(F.concat(s["kind"], F.lit("|prior")))
    for j in range(3):
        total = total + get(F.concat(s["kind"], F.lit(f"|v{j}|"), s["votes"][j].cast("string")))
        total = total + get(F.concat(s["kind"], F.lit(f"|s{j}|"), s["shape"][j]))
    return 1.0 / (1.0 + F.exp(-total))


def fit(spans: DataFrame, column: str = "spans") -> dict[str, float]:
    """The span classifier, from all proposed spans of a table (column from :func:`candidates`)."""
    return train(_pattern_counts(spans, column))


def accepted(spans: Column, model: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """The strict spans, and those others that the classifier accepts and that overlap no strict
    one and no earlier accepted one; struct<kind, start, end, strict> by kind and start."""
    strict = F.filter(spans, lambda s: s["strict"])
    free = F.filter(spans, lambda s: ~s["strict"] & (_score(model, s) >= threshold) & ~F.exists(
        strict, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    rank = {k: i for i, k in enumerate(KINDS)}

    def slim(s):
        place = sum((F.when(s["kind"] == k, i).otherwise(0) for k, i in rank.items()), F.lit(0))
        return F.struct(place.cast("int").alias("place"), s["start"].alias("start"), s["end"].alias("end"),
                        s["kind"].alias("kind"), s["strict"].alias("strict"))

    kind = "array<struct<place:int,start:int,end:int,kind:string,strict:boolean>>"
    free = F.aggregate(
        F.array_sort(F.transform(free, slim)), F.array().cast(kind),
        lambda acc, s: F.when(F.exists(acc, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])), acc)
        .otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(F.concat(F.transform(strict, slim), free))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first span's ``[KIND]``; null stays null."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(
        a["out"], F.substring(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def redact(docs: DataFrame, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    Trained on all spans of ``docs`` themselves; same columns, same rows.  Null
    and empty texts stay as they are, equal rows get equal texts, an empty table
    trains nothing and gives no rows.
    """
    proposed = candidates(F.col(text))
    model = fit(docs.select(proposed.alias("spans")))
    return docs.withColumn(text, redacted(F.col(text), accepted(proposed, model, threshold)))
