"""Each rule by the change it makes to one row's score."""

import math

import pytest
from pyspark.sql import functions as F

from tarkash.operators import menu, scoring

ROW = "typed string, native string, key string, source string, weight double, cost double, tier int, closeness int, provenance array<string>, index int"


def scored(spark, rows, known=(), lexicon=(), learnt=None, key=None):
    """typed, native, key, source, weight, cost, tier of each row; the points of a short native are given back."""
    merged = spark.createDataFrame([(*r, 0, [], i) for i, r in enumerate(rows)], ROW)
    known = spark.createDataFrame(list(known), "native string, score double, evidence long, unigram long, attested boolean, spell_ok boolean")
    lexicon = spark.createDataFrame(list(lexicon), "roman string, native string, weight int")
    learnt = learnt and spark.createDataFrame(learnt, "typed string, native string, explicit_count int, preferred boolean")
    short = F.length("native") < 0.7 * F.length("typed")
    out = scoring.score(merged, known, lexicon, learnt)
    return {(tuple(r[k] for k in key) if key else r.native): r for r in out.withColumn("score", F.col("score") + F.when(short, 2.0).otherwise(0.0)).collect()}


def one(spark, typed, native, key=None, source="phonetic", weight=0.0, cost=0.0, tier=2, **tables):
    return scored(spark, [(typed, native, key or typed, source, weight, cost, tier)], **tables)[native]


# typed, native and the points of all rules together, the short-native rule aside.
CASES = [
    ("k", "ક", 0.0), ("khe", "ખેય", -4.0), ("n", "ન", 2.5), ("n", "ણ", -0.35), ("de", "ડે", -1.2), ("de", "દે", 0.5), ("she", "શે", 3.0),
    ("she", "સે", -3.0), ("se", "શે", -0.55), ("se", "સે", 0.15), ("ze", "ઝે", 0.5), ("ze", "જે", -0.35), ("himmt", "હિમ્મત", 5.5),
    ("himmt", "હિંમત", -6.5), ("unk", "ઉંક", 0.35), ("aav", "આવ", 3.5), ("aav", "અવ", -4.0), ("par", "પર", 0.0), ("paray", "પારય", -3.8 - 1.2 + 0.2),
    ("ke", "કા", -1.6), ("kaamaa", "કામા", 0.4 + 2.5),
]


def test_points_of_phonetic_forms(spark):
    rows = [(t, n, t, "phonetic", 0.0, 0.0, 2) for t, n, _ in CASES]
    got = scored(spark, rows, key=("typed", "native"))
    for typed, native, points in CASES:
        assert math.isclose(got[typed, native].score, points - 0.15, abs_tol=1e-9), (typed, native)


def test_base_score(spark):
    known = [("ઘર", 2.0, 900, 900, True, True)]
    got = one(spark, "ghr", "ઘર", source="strict", weight=200.0, tier=0, known=known, lexicon=[("ghr", "ઘર", 200)])
    assert math.isclose(got.score, 0.35 * math.log1p(200) + 2.8 + 0.35 + 0.55 * math.log1p(900) + 2.0 + 0.6 * math.log1p(900) / math.log1p(1), rel_tol=1e-9)
    assert got.tier == 0 and one(spark, "ghr", "🏠", source="emoji", weight=10.0, tier=5).score == pytest.approx(0.55 * math.log1p(10))


def test_soft_entries_and_morphs(spark):
    soft = one(spark, "ghr", "ઘર", source="strict", weight=50.0, tier=1)
    assert math.isclose(soft.score, 0.15 * 0.35 * math.log1p(50) - 2.8)
    rows = [("ghr", "ઘર", "ghr", "strict", 200.0, 0.0, 0), ("ghr", "ઘરવ", "ghrv", "fuzzy", 0.0, 0.0, 0), ("ghr", "ખર", "khr", "fuzzy", 0.0, 0.0, 0)]
    got = scored(spark, rows, lexicon=[("ghr", "ઘર", 200)])
    assert math.isclose(got["ઘર"].score, 0.35 * math.log1p(200) + 6.5 + 2.0) and got["ઘર"].tier == 0
    assert math.isclose(got["ઘરવ"].score, -8.5) and got["ઘરવ"].tier == 1 and got["ખર"].tier == 1


def test_learnt_choices(spark):
    rows = [("ke", "કે", "ke", "phonetic", 0.0, 0.0, 2), ("ke", "કી", "ke", "phonetic", 0.0, 0.0, 2)]
    got = scored(spark, rows, learnt=[("ke", "કે", 2, True), ("ke", "કી", 1, False)])
    assert got["કે"].tier == -1 and got["કે"].score > 80
    assert math.isclose(got["કી"].score, -0.15 + math.log1p(1) / 3.5 + 1.2 * math.log1p(1))


def test_siblings(spark):
    rows = [("pdi", "પડી", "pdi", "strict", 50.0, 0.0, 1), ("pdi", "પદિ", "pdi", "stem_matra", 100.0, 0.0, 1)]
    got = scored(spark, rows, lexicon=[("pdi", "પડી", 50)])
    assert math.isclose(got["પડી"].score, 0.15 * 0.35 * math.log1p(50) - 2.8 + 5.5 - 1.2)
    assert math.isclose(got["પદિ"].score, 0.35 * math.log1p(100) - 2.0 + 0.5)
    known = [("શાંતિ", 5.0, 9000, 9000, True, True)]
    rows = [("shanti", "શાન્તિ", "shanti", "strict", 100.0, 0.0, 0), ("shanti", "શાંતિ", "shaanti", "fuzzy", 200.0, 1.0, 1)]
    assert scored(spark, rows, known=known, lexicon=[("shanti", "શાન્તિ", 100)])["શાન્તિ"].tier == 1


def test_strip_and_lengthening(spark):
    pairs = [("vinash", "vinas"), ("vinash", "vinah"), ("chhe", "ce"), ("swagat", "svaagat"), ("gai", "gaai"), ("ka", "kaa"), (None, "a"), ("", "")]
    rows = spark.createDataFrame(pairs, "t string, k string").select(scoring.digraph_strip(F.col("t"), F.col("k")), scoring.vowel_lengthened(F.col("t"), F.col("k"))).collect()
    assert [r[0] for r in rows] == [True, False, True, False, False, False, False, False]
    assert [r[1] for r in rows] == [False, False, False, True, False, False, False, False]


def arbitrated(spark, rows, model):
    merged = spark.createDataFrame([(*r, 0, [], i) for i, r in enumerate(rows)], ROW)
    known = spark.createDataFrame([], "native string, score double, evidence long, unigram long, attested boolean, spell_ok boolean")
    lexicon = spark.createDataFrame([], "roman string, native string, weight int")
    model = spark.createDataFrame(model, "typed string, native string, log_prob double")
    return {r.native: r for r in scoring.score(merged, known, lexicon, model=model).collect()}


def test_a_model_takes_the_exact_place(spark):
    rows = [("ke", "કી", "ke", "strict", 0.0, 0.0, 0), ("ke", "કે", "ke", "neural", 0.0, 0.0, 2)]
    got = arbitrated(spark, rows, [("ke", "કે", -1.0), ("ke", "કી", -4.0)])
    assert (got["કે"].tier, got["કી"].tier, got["કે"].provenance) == (0, 1, ["neural_arbitration"])
    assert math.isclose(got["કે"].score, 3.0 + 3.0) and math.isclose(got["કી"].score, -4.5 - 3.0)
    near = arbitrated(spark, rows, [("ke", "કે", -1.0), ("ke", "કી", -3.9)])
    assert (near["કે"].tier, near["કી"].tier) == (2, 0)
    assert arbitrated(spark, rows, [])["કી"].tier == 0
    rows = [("kes", "કેશ", "kes", "strict", 0.0, 0.0, 0), ("kes", "કેસ", "kes", "neural", 0.0, 0.0, 2)]
    assert arbitrated(spark, rows, [("kes", "કેસ", -1.2), ("kes", "કેશ", 0.0)])["કેસ"].tier == 0
    assert arbitrated(spark, rows, [("kes", "કેસ", -1.3), ("kes", "કેશ", 0.0)])["કેસ"].tier == 2


def test_short_natives_lose_two_points(spark):
    row = [("kemekem", "ક", "kemekem", "phonetic", 0.0, 0.0, 2, 0, [], 0), ("ke", "કે", "ke", "phonetic", 0.0, 0.0, 2, 0, [], 1)]
    known = spark.createDataFrame([], "native string, score double, evidence long, unigram long, attested boolean, spell_ok boolean")
    got = scoring.score(spark.createDataFrame(row, ROW), known, spark.createDataFrame([], "roman string, native string, weight int")).collect()
    assert {r.native: r.score for r in got} == {"ક": -2.15, "કે": -0.15}


def test_ranked_menu(spark):
    rows = scored(spark, [("ke", "કે", "ke", "phonetic", 0.0, 0.0, 2), ("ke", "ke", "ke", "latin", 0.0, 0.0, 3)])
    df = spark.createDataFrame([r.asDict() for r in rows.values()], ROW + ", score double, evidence long, attested boolean")
    assert [r.native for r in menu.ranked(df, "typed").orderBy("rank").collect()] == ["કે", "ke"]
