"""Insertions by levels give what one ordered pass gives."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarkash.functions.script import POSTFIXES
from tarkash.operators import insertion


def strip(word):
    return next((word[: -len(p)] for p in POSTFIXES if word.endswith(p) and len(word) > len(p) + 1), None)


def plain_fill(lexicon, best, fan, blocked, most):
    lex = {r: n for r, n, _ in lexicon}
    natives, soft, out = set(lex.values()), sum(0 < w < 100 for _, _, w in lexicon), set()
    for roman, native, n in sorted(best, key=lambda x: (strip(x[1]) is not None, -max(x[2], fan.get(x[1], 0)), x[0])):
        if soft >= most:
            break
        stem = strip(native)
        if roman in blocked or roman in lex or stem in natives or (stem and soft < int(most * 0.92)) or len(native) > 16:
            continue
        e = max(n, fan.get(native, 0))
        out.add((roman, native, 85 if e >= 40 or n >= 8 else 80 if e >= 8 or n >= 2 else 75))
        natives.add(native)
        soft += 1
    return out


@pytest.mark.parametrize("most", [0, 5, 14, 15, 40, 10_000])
def test_soft_fill(spark, most):
    rng = random.Random(most)
    stems = ["કખ", "ગઘ", "ચછ", "જઝ", "ટઠ"]
    natives = [s + "".join(ends) for s in stems for k in range(4) for ends in itertools.product(("માં", "ના", "થી"), repeat=k)]
    best = [(f"r{i:03}", rng.choice(natives), rng.choice([1, 1, 2, 9])) for i in range(120)]
    lexicon = [("r003", "કખ", 50), ("x", "ગઘના", 200)]
    fan = {n: rng.choice([1, 8, 50]) for n in natives[::3]}
    frames = (
        spark.createDataFrame(lexicon, "roman string, native string, weight int"),
        spark.createDataFrame(best, "roman string, native string, n int"),
        spark.createDataFrame(list(fan.items()), "native string, fan_in int"),
        spark.createDataFrame([("r007",)], "roman string"),
    )
    got = {tuple(r) for r in insertion.soft_fill(*frames, most=most).collect()}
    assert got == plain_fill(lexicon, best, fan, {"r007"}, most)


def test_capped_words(spark):
    words = ["કખ", "કખના", "કખનાથી", "કખનાથીમાં", "ગઘના", "ગઘનાથી", "ક", None, "કખ"]
    kept, seen = [], set()
    for w in sorted({w for w in words if w}, key=lambda w: (strip(w) is not None, len(w), w)):
        if strip(w) not in seen:
            kept.append(w)
            seen.add(w)
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    assert {r.word for r in insertion.capped_words(rows).collect()} == set(kept)
    assert insertion.capped_words(rows, most=2).count() == 2
    assert insertion.capped_words(rows.limit(0)).count() == 0


def test_prune_upgrade_and_precedence(spark):
    lexicon = spark.createDataFrame([("a", "કખ", 75), ("b", "કખના", 75), ("c", "કખના", 200), ("d", "ક ખ", 50), ("e", None, 75)], "roman string, native string, weight int")
    assert {r.roman for r in insertion.prune_soft(lexicon).collect()} == {"a", "c", "e"}
    best = spark.createDataFrame([("a", "કખ", 9), ("c", "કખના", 1)], "roman string, native string, n int")
    fan = spark.createDataFrame([("કખ", 1)], "native string, fan_in int")
    assert {(r.roman, r.weight) for r in insertion.upgrade_soft(lexicon, best, fan).collect()} == {("a", 85), ("b", 75), ("c", 200), ("d", 50), ("e", 75)}
    pair = lambda rows: spark.createDataFrame(rows, "roman string, native string")
    personal = spark.createDataFrame([("p", "4", 950), ("q", "4", 100), ("s", "4", 2000), ("t", "4", 650)], "roman string, native string, weight int")
    got = insertion.precedence(pair([("s", "1")]), pair([("p", "2"), ("q", "2")]), pair([("p", "3"), ("r", "3")]), personal)
    assert {tuple(r) for r in got.collect()} == {("s", "1", 1000), ("p", "4", 700), ("q", "2", 800), ("r", "3", 900), ("t", "4", 650)}


def test_depth(spark):
    rows = spark.createDataFrame([("કખનાથી",), ("કખ",), ("",), (None,)], "w string")
    assert [r[0] for r in rows.select(insertion.depth(F.col("w"))).collect()][:3] == [2, 0, 0]


def test_dictionary_and_bare_fill(spark):
    rng = random.Random(1)
    natives = ["".join(x) for k in range(4) for x in itertools.product(("કખ", "ના", "થી", "માં"), repeat=k) if x]
    pairs = {"".join(rng.choices("abc", k=rng.randint(1, 6))): rng.choice(natives) for _ in range(150)}
    known, out = {"કખના"}, set()
    for roman, native in sorted(pairs.items(), key=lambda x: (len(x[0]), x[0])):
        if roman != "a" and not any(native.endswith(p) and native[: -len(p)] in known for p in insertion.DICTIONARY_POSTFIXES):
            known.add(native)
            out.add((roman, native, 80))
    lexicon = spark.createDataFrame([("a", "કખના", 50)], "roman string, native string, weight int")
    rows = spark.createDataFrame(list(pairs.items()), "roman string, native string")
    assert {tuple(r) for r in insertion.dictionary_fill(lexicon, rows).collect()} == out
    best = spark.createDataFrame([("a", "કખ", 9), ("b", "ગઘ", 1), ("c", "ચછ", 2), ("d", "કખના", 9), ("e", "જઝ", 9)], "roman string, native string, n int")
    got = insertion.bare_fill(lexicon, best, spark.createDataFrame([("e",)], "roman string"), 1)
    assert [tuple(r) for r in got.collect()] == [("c", "ચછ", 80)]
