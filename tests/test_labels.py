import random

from pyspark.sql import functions as F

from tarkash.functions.script import POSTFIXES
from tarkash.operators import labels


def test_failure_signals(spark):
    rows = spark.createDataFrame([("kem", "કેમ", ["કીમ"]), ("khu", "ખુ", []), ("hu", "હુ", None), ("station", "સ્ટેશન", ["x"])], "r string, g string, m array<string>")
    got = [r[0] for r in rows.select(labels.failure_signals(F.col("r"), F.col("g"), F.col("m"))).collect()]
    assert got[0] == ["vowel_length", "nasal_anusvara"] and got[1] == ["aspiration"] and got[2] == ["unknown"]
    assert got[3] == ["dental_retroflex", "nasal_anusvara", "conjunct_virama", "loanword_spelling"]


def test_merge_labels(spark):
    model = [("aaaa", [("કખ", -1.0)]), ("bbbb", [("કખ", -1.0), ("ક", -1.5)]), ("cccc", [("કખ", -1.0), ("ક", -3.0)]), ("dddd", [("્", -1.0)]), ("ee", [("ક", 0.0)]), ("ffff", []), ("gggg", None)]
    rows = spark.createDataFrame(model, "roman string, candidates array<struct<native:string,log_prob:double>>")
    gold = spark.createDataFrame([("bbbb", "ગ"), ("cccc", "ગ")], "roman string, native string")
    got = {tuple(r) for r in labels.merge_labels(rows, gold, 1.0, 4).collect()}
    assert got == {("aaaa", "કખ", "novel_added"), ("bbbb", "ગ", "kept_gold"), ("cccc", "કખ", "overridden"), ("dddd", "્", "rejected_invalid")}


def test_boost_equals_one_ordered_pass(spark):
    rng = random.Random(4)
    words = sorted({rng.choice(["કખ", "ગઘ", "ચછ", "મમ"]) + "".join(rng.choices(["ના", "થી", "માં"], k=rng.randint(0, 3))) for _ in range(60)})
    counts = {"ગઘ": 7, "ચછના": 90}
    wanted = dict(counts)
    for w in words:
        stem = next((w[: -len(p)] for p in POSTFIXES if w.endswith(p) and len(w) > len(p) + 1), None)
        if stem not in wanted:
            wanted[w] = max(wanted.get(w, 0), 50)
    got = labels.boost(spark.createDataFrame(list(counts.items()), "word string, n int"), spark.createDataFrame([(w,) for w in [*words, None]], "word string"))
    assert {r.word: r.n for r in got.collect()} == wanted


def test_stress_gates_and_leads(spark):
    keys = spark.createDataFrame([("av",), ("a",), ("ava",), ("",), (None,)], "roman string")
    assert [r.roman for r in labels.stress(keys, 5).collect()] == ["a", "av", "ava", "aa", "avaa"]
    assert {r.roman for r in labels.stress(keys, 99).collect()} == {"a", "av", "ava", "aa", "avaa", "ai", "aw", "awa"}
    rows = spark.createDataFrame([(0.5, 3.0), (0.4, None)], "top1 double, p95 double")
    assert [r.failures for r in labels.gates(rows, [("top1", ">=", 0.45), ("p95", "<=", 5.0)]).collect()] == [[], ["top1", "p95"]]
    scores = spark.createDataFrame([("a", -1.0), ("a", -3.0), ("b", -1.0)], "k string, s double")
    assert {(r.k, r.lead) for r in labels.lead_over_next(scores, "k", "s").collect()} == {("a", 2.0), ("b", None)}
