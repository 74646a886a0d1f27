import pytest
from pyspark.sql import functions as F

from tarkash.functions.spellings import LATTICE, Spellings, lattice, query_costs
from tarkash.operators import candidates as c
from tarkash.operators import lookup
from tarkash.operators.validity import validity


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("ghar", "ઘર", 200), ("keTli", "કેટલી", 50), ("mulya", "મૂલ્ય", 150), ("poshatun", "પોષતું", 120), ("shabd", "શબ્દ", 300), ("kam", "કામ", 200), ("gharvala", "ઘરવાળા", 90), ("jaa", "જા", 200), ("koi", "કોઈ", 200)]
    return spark.createDataFrame(rows, "roman string, native string, weight int")


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame([("ઘર", 900, 950, True), ("કામ", 400, 0, False), ("મૂલ્ય", 0, 0, True)], "native string, unigram long, stem long, attested boolean")


def typed(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "typed string")


def got(df, *columns):
    return {tuple(r[x] for x in columns) for r in df.collect()}


def test_hits(spark, lexicon):
    rows = got(c.hits(typed(spark, "ghar", "ketli", "none", ""), lexicon), "typed", "native", "source", "cost", "tier")
    assert rows == {("ghar", "ઘર", "strict", 0.0, 0), ("ketli", "કેટલી", "fuzzy", 2.0, 1)}
    assert c.hits(typed(spark, "ghar").limit(0), lexicon).count() == 0


def test_lattice_equals_the_relational_form(spark):
    words = spark.createDataFrame([("ketli",), ("shabdo",)], "word string")
    rows = lookup.lattice(words, LATTICE, 2, 40, F.when(F.length("word") <= 6, 4.0).otherwise(6.0)).collect()
    for w in ("ketli", "shabdo"):
        assert {(r.form, r.cost) for r in rows if r.word == w} == set(lattice(w).items())
    found = query_costs("ketli", Spellings())
    assert found["ketli"] == 0.0 and found["keTli"] == 2.0 and set(lattice("ketli")) <= set(found) and None in found.values()


def test_stems(spark, lexicon):
    assert got(c.sign_stems(typed(spark, "shabdo", "koie", "o"), lexicon), "typed", "native", "weight") == {("shabdo", "શબ્દો", 300.0)}
    none = spark.createDataFrame([], "native string")
    rows = got(c.postposition_stems(typed(spark, "gharmaa", "gharomaa", "jaane", "mulyathi"), lexicon, none), "typed", "native", "key")
    assert rows == {("gharmaa", "ઘરમાં", "gharmaa"), ("gharomaa", "ઘરોમાં", "gharomaa"), ("mulyathi", "મૂલ્યથી", "mulyathi")}
    assert ("kamta", "કામતા") in got(c.inflected_stems(typed(spark, "kamta"), lexicon), "typed", "native")


def test_compounds(spark, lexicon, evidence):
    sure = validity(lexicon, evidence)
    rows = got(c.compounds(typed(spark, "gharshabd", "gharkamshabd", "gharkamketli", "ghar"), lexicon, sure), "typed", "native", "cost")
    assert rows == {("gharshabd", "ઘરશબ્દ", 1.0), ("gharkamshabd", "ઘરકામશબ્દ", 2.0)}


def test_near_exact_and_completions(spark, lexicon):
    assert got(c.near_exact(typed(spark, "poshatu", "ghar"), lexicon), "typed", "native", "tier", "cost") == {("poshatu", "પોષતું", 0, 1.5)}
    assert got(c.near_exact(typed(spark, "poshat"), lexicon), "native", "tier", "cost") == {("પોષતું", 0, 3.0)}
    index = lexicon.select(F.explode(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("roman"))), lambda k: F.substring("roman", F.lit(1), k))).alias("prefix"), "roman", "native", "weight")
    assert got(c.completions(typed(spark, "gh", "ghar", "g"), index, 1), "typed", "native") == {("gh", "ઘર"), ("ghar", "ઘરવાળા")}


def test_emoji_and_phonetic(spark, lexicon, evidence):
    code = spark.createDataFrame([("ghar", "🏠", 10, 0.9), ("ghar", "🏡", 20, 0.9), ("ghar", "⛺", 5, 0.1)], "code string, emoji string, weight int, confidence double")
    native = spark.createDataFrame([("ઘર", "🏘", 1, 0.95)], "native string, emoji string, weight int, confidence double")
    t = typed(spark, "ghar")
    assert got(c.emoji(t, c.hits(t, lexicon), code, native), "native") == {("🏘",), ("🏡",)}
    known = validity(lexicon, evidence)
    rows = got(c.phonetic(typed(spark, "kaam", "ghar"), known), "typed", "native", "tier")
    assert ("kaam", "કામ", 1) in rows and ("ghar", "ઘર", 1) in rows


def test_merge_keeps_the_best_tier(spark, lexicon, evidence):
    t = typed(spark, "ghar")
    rows = {r.native: r for r in c.merge(c.phonetic(t, validity(lexicon, evidence)), c.hits(t, lexicon), c.latin(t)).collect()}
    home = rows["ઘર"]
    assert (home.tier, home.source, home.provenance, home.closeness) == (0, "strict", ["phonetic", "strict"], 100)
    assert rows["ghar"].tier == 3


def test_validity(spark, evidence):
    words = spark.createDataFrame([("ઘર",), ("ઘરમાં",), ("મૂલ્ય",), ("અજ",), (None,)], "native string")
    rows = {r.native: r for r in validity(words, evidence).collect()}
    assert set(rows) == {"ઘર", "ઘરમાં", "મૂલ્ય", "અજ"}
    assert (rows["ઘર"].attested, rows["ઘર"].evidence, rows["ઘર"].uni_strong) == (True, 950, True)
    assert (rows["ઘરમાં"].attested, rows["ઘરમાં"].stem, rows["ઘરમાં"].present) == (True, 950, False)
    assert (rows["મૂલ્ય"].attested, rows["મૂલ્ય"].spell_ok, rows["મૂલ્ય"].stem) == (False, True, 50)
    assert rows["અજ"].score == 0.0 and not rows["અજ"].attested


def test_modelled_words(spark, evidence):
    known = validity(spark.createDataFrame([("ઘર",), ("અજ",)], "native string"), evidence)
    model = spark.createDataFrame([("ghar", "ઘર", -0.1), ("ghar", "અજ", -2.0), ("ghar", "ઝઝ", -3.0)], "typed string, native string, log_prob double")
    assert got(c.modelled(model, known), "native", "source", "weight", "tier") == {("ઘર", "neural", 950.0, 1), ("અજ", "neural", 0.0, 2), ("ઝઝ", "neural", 0.0, 2)}
