"""Personal data by weak supervision, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their spans always
stay. A wider pattern finds candidates. Labelers vote on every candidate (personal, not
personal, no opinion): the base patterns, the shape of the digits, gazetteers of titles and of
words that name contact data or plain numbers, and the words before it. Expectation-maximisation
over the vote patterns estimates how reliable each labeler is without any label; the resulting
probabilities train a naive Bayes classifier of spans on features the labelers do not see whole.
Candidates over its threshold that overlap no base span are added.

Vote patterns (at most 3^5) and feature values (under 100) are counted by the cluster over all
rows; only these counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarkash.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

# Possessive loops and look-behinds keep each pattern linear on very long runs and find the same
# leftmost matches as the plain forms: a start inside a run fails wherever the run's start fails.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = (
    r"(?i)(?:\G|(?<![a-z0-9._%+@-]))(?:"
    r"(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra)\.?\x20[A-ZÀ-Þ][a-zß-ÿ]++"
    r"|[a-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[a-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[a-z0-9-]++)++"
    r"|(?:password|passwd|pwd|token|secret|ssn|iban)\x20?[=:]\x20?\"?[A-Za-z0-9]{6,}+"
    r"|\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){5,}+)"
)
MAYBE = r"(?i)[0-9]|@|[(\[]at[)\]]|\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|sr|sra)\b|password|passwd|pwd|token|secret|ssn|iban"
BLOCK = 128  # spans whose offsets are summed at a time
MARKS = 1024  # code points of a piece of a text's mask
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "sr", "sra")
CONTACT = ("mail", "e-mail", "email", "phone", "tel", "telephone", "call", "contact", "fax", "mobile", "card", "account", "address", "name", "ip", "kontakt", "telefon", "anruf", "correo", "adresse", "password", "token", "secret", "ssn", "iban")
PLAIN = ("page", "version", "isbn", "order", "item", "figure", "chapter", "section", "number", "no", "id", "price", "year", "seite", "nummer", "numero", "version", "table")
LABELERS = ("base", "shape", "title", "context", "digits")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,hit,before>> of the leftmost matches that do not overlap, in code points.

    ``before`` is the text since the match before, that match included. Offsets are summed in
    blocks, so that the work grows with the matches and not with their square.
    """
    empty = F.array().cast("array<struct<s:int,e:int,hit:string,before:string>>")
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["h"])
        one = F.struct(s.alias("s"), e.alias("e"), x["h"].alias("hit"), F.concat(x["last"], x["p"]).alias("before"))
        return F.struct(e.alias("at"), F.array_append(acc["found"], one).alias("found"))

    def blocks(found: Column) -> Column:
        h = found["h"]
        last = F.concat(F.array(F.lit("")), h)
        pairs = F.zip_with(F.zip_with(F.slice(found["p"], F.lit(1), F.size(h)), h, lambda p, x: F.struct(p.alias("p"), x.alias("h"))), F.slice(last, F.lit(1), F.size(h)), lambda x, y: F.struct(x["p"].alias("p"), x["h"].alias("h"), y.alias("last")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        return _let(pairs, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda i: F.aggregate(F.slice(x, i * BLOCK + 1, F.lit(BLOCK)), start, step)))

    def shifted(x: Column) -> Column:
        add = lambda acc, y: F.struct((acc["at"] + y["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
        starts = F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), add)["starts"]
        move = lambda y, at: F.transform(y["found"], lambda z: F.struct((z["s"] + at).alias("s"), (z["e"] + at).alias("e"), z["hit"].alias("hit"), z["before"].alias("before")))
        return F.flatten(F.zip_with(x, starts, move))

    return _let(F.struct(hits.alias("h"), parts.alias("p")), lambda f: F.when(F.size(f["h"]) == 0, empty).otherwise(_let(blocks(f), shifted)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
        return F.forall(F.split(hit, r"\."), small)
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(F.substring(digits, 1, 19))
    return F.length(digits).between(8, 15)


def _holder(kind: str):
    return lambda x: _holds(kind, x["hit"])


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind. A card needs 16 digits and the others a sign of their own, so most texts are not scanned."""
    out = {}
    for kind, sign in zip(KINDS, ("@", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){15}", r"\+[0-9]"), strict=True):
        maybe = F.contains(text, F.lit(sign)) if kind == "email" else F.regexp_like(text, F.lit(sign))
        found = F.filter(_spans(text, BASE[kind]), _holder(kind))
        bare = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        out[kind] = F.when(maybe, bare).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return out


def _marks(spans: Column, size: Column) -> Column:
    """Pieces of MARKS characters of a mask of the text: 1 within a span, 0 elsewhere; none without spans."""
    gap = lambda x, i: x["s"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["e"])
    runs = F.transform(spans, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.repeat(F.lit("1"), x["e"] - x["s"])))
    mask = F.concat(F.array_join(runs, ""), F.repeat(F.lit("0"), size - F.element_at(spans, -1)["e"]))
    return F.when(F.size(spans) > 0, F.regexp_extract_all(mask, F.lit(f".{{1,{MARKS}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _overlaps(x: Column, marks: Column) -> Column:
    """Whether a span touches a marked character: only the pieces it lies in are read."""
    first, last = F.floor(x["s"] / MARKS).cast("int"), F.floor((x["e"] - 1) / MARKS).cast("int")
    held = F.array_join(F.slice(marks, first + 1, last - first + 1), "")
    return (F.size(marks) > 0) & F.contains(F.substring(held, x["s"] - first * MARKS + 1, x["e"] - x["s"]), F.lit("1"))


def _candidates(text: Column, marks: Sequence[Column]) -> Column:
    """array<struct<s,e,kind,votes,features>>: votes are 1, 0 or -1 (no opinion), one a labeler."""

    def judged(x: Column) -> Column:
        hit, digits = F.lower(x["hit"]), _digits(x["hit"])
        n, size = F.length(digits), F.length(x["hit"])
        before = F.regexp_extract_all(F.lower(F.right(x["before"], F.lit(40))), F.lit("[a-z-]+"), F.lit(0))
        near = F.slice(before, F.greatest(F.size(before) - 2, F.lit(1)), F.lit(3))
        near = F.when(F.size(before) > 0, near).otherwise(F.array().cast("array<string>"))
        first = F.regexp_extract(hit, "^[a-z]+", 0)
        mail = F.regexp_like(hit, F.lit(r"@|[(\[]at[)\]]"))
        secret = F.regexp_like(hit, F.lit(r"^(?:password|passwd|pwd|token|secret|ssn|iban)\x20?[=:]"))
        title = first.isin(*TITLES) & ~mail & ~secret
        words = lambda names: F.arrays_overlap(near, F.array(*[F.lit(w) for w in names]))
        yes, no, none = F.lit(1), F.lit(0), F.lit(-1)
        separated = F.regexp_like(x["hit"], F.lit(r"[()+]|[0-9][\x20-][0-9]"))
        date = F.regexp_like(hit, F.lit(r"^(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})$"))
        numeric = ~mail & ~secret & ~title
        votes = [
            F.when(touches(x), yes).otherwise(none),
            F.when(mail | secret, yes).when(date, no).when(numeric & separated & n.between(9, 19), yes).when(numeric & (n < 8), no).otherwise(none),
            F.when(title, yes).otherwise(none),
            F.when(words(CONTACT) | secret, yes).when(words(PLAIN), no).otherwise(none),
            F.when(numeric & ~separated & ~n.between(8, 19), no).when(numeric & F.regexp_like(hit, F.lit(r"^\+")), yes).otherwise(none),
        ]
        kind = F.when(mail, "email").when(secret, "secret").when(title, "name").when(n >= 16, "number").otherwise("phone")
        features = [
            F.concat(F.lit("kind="), kind),
            F.concat(F.lit("digits="), F.least(n, F.lit(20)).cast("string")),
            F.concat(F.lit("share="), F.when(size > 0, F.round(n / size * 4)).otherwise(0).cast("int").cast("string")),
            F.concat(F.lit("size="), F.least(F.floor(size / 6), F.lit(8)).cast("string")),
            F.concat(F.lit("date="), date.cast("string")),
            F.concat(F.lit("sep="), separated.cast("string")),
            F.concat(F.lit("near="), F.when(words(CONTACT), "contact").when(words(PLAIN), "plain").otherwise("none")),
        ]
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), kind.alias("kind"), F.array(*votes).alias("votes"), F.array(*features).alias("features"))

    def touches(x: Column) -> Column:
        out = F.lit(False)
        for m in marks:
            out = out | _overlaps(x, m)
        return out

    none = "array<struct<s:int,e:int,kind:string,votes:array<int>,features:array<string>>>"
    return F.when(F.regexp_like(text, F.lit(MAYBE)), F.transform(_spans(text, CANDIDATE), judged)).otherwise(F.array().cast(none))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30, prior: float = 0.5) -> tuple[dict, dict]:
    """(probability of each vote pattern, labelers' {name: (hit rate, false rate)}) by EM.

    A labeler's opinion is taken as independent of the others given the class; no opinion says
    nothing. Rates start from better than chance and are smoothed by two counts.
    """
    share, hit, false = prior, [0.8] * len(LABELERS), [0.2] * len(LABELERS)
    posterior: dict[tuple[int, ...], float] = {}
    for _ in range(rounds if patterns else 0):
        for votes, _n in patterns:
            yes, no = math.log(share), math.log(1 - share)
            for j, v in enumerate(votes):
                if v >= 0:
                    yes += math.log(hit[j] if v else 1 - hit[j])
                    no += math.log(false[j] if v else 1 - false[j])
            posterior[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(n for _, n in patterns)
        share = min(0.99, max(0.01, sum(n * posterior[v] for v, n in patterns) / total))
        for j in range(len(LABELERS)):
            said = [(v, n) for v, n in patterns if v[j] >= 0]
            for rates, weight in ((hit, lambda v: posterior[v]), (false, lambda v: 1 - posterior[v])):
                whole = sum(n * weight(v) for v, n in said)
                start = 0.8 if rates is hit else 0.2
                rates[j] = (sum(n * weight(v) for v, n in said if v[j] == 1) + 2 * start) / (whole + 2)
        # a labeler better than chance keeps its meaning
        for j in range(len(LABELERS)):
            if hit[j] < false[j]:
                hit[j], false[j] = false[j], hit[j]
    return posterior, {name: (hit[j], false[j]) for j, name in enumerate(LABELERS)}


def personal_data(docs: DataFrame, threshold: float = 0.8, rounds: int = 30) -> DataFrame:
    """doc_id, base and spans: arrays of struct(kind, s, e) for every row, in code points, ends exclusive.

    ``base`` holds the base patterns' spans by kind, then start; ``spans`` these and the added ones
    in the same order, the added kinds (name, number, secret and further email and phone) after
    the base kinds. A null text counts as empty and has none; repeated rows stay; an empty table
    gives no rows and trains nothing; other columns are not read.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base_spans(text).items()])
    rows = rows.withColumn("base", F.concat(*[F.transform(k, _named(k)) for k in KINDS]))
    rows = rows.withColumns({f"{k}_marks": _marks(F.col(k), F.length(text)) for k in KINDS})
    found = cut(rows.select("doc_id", "base", _candidates(text, [F.col(f"{k}_marks") for k in KINDS]).alias("found")))
    each = found.select(F.explode("found").alias("x"))
    patterns = [(tuple(r.votes), r.n) for r in each.groupBy(F.col("x.votes").alias("votes")).agg(F.count("*").alias("n")).collect()]  # 3^5 at most
    posterior, _ = estimate(sorted(patterns), rounds)
    belief = F.lit(0.0)
    for votes, p in posterior.items():
        belief = F.when(F.col("x.votes") == F.array(*[F.lit(v) for v in votes]), F.lit(p)).otherwise(belief)
    sums = each.select(belief.alias("p"), F.explode("x.features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # under 100 values
    total = sum(r.yes + r.no for r in sums if r.f.startswith("kind=")) or 1.0
    yes_all = sum(r.yes for r in sums if r.f.startswith("kind="))
    odds = {r.f: math.log((r.yes + 0.5) / (yes_all + 5)) - math.log((r.no + 0.5) / (total - yes_all + 5)) for r in sums}
    start = math.log((yes_all + 0.5) / (total - yes_all + 0.5))
    table = F.create_map(*[y for f, w in sorted(odds.items()) for y in (F.lit(f), F.lit(w))]) if odds else F.create_map(F.lit(""), F.lit(0.0))

    def added(x: Column) -> Column:
        margin = F.aggregate(x["features"], F.lit(start), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return (margin > math.log(threshold / (1 - threshold))) & (x["votes"][0] != 1)  # touches no base span

    extra = F.transform(F.filter("found", added), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    place = F.create_map(*[y for i, k in enumerate((*KINDS, "name", "number", "secret")) for y in (F.lit(k), F.lit(i))])
    order = F.array_sort(F.transform(F.concat("base", extra), lambda x: F.struct(F.element_at(place, x["kind"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return found.select("doc_id", "base", F.transform(order, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).alias("spans"))


def is_kind(kind: str):
    return lambda x: x["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
