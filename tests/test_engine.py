"""From typed words to menus: the whole plan on a small lexicon, its gates and its families."""

import random

import pytest
from pyspark.sql import functions as F

from tarkash.operators import candidates as c
from tarkash.operators import emoji, engine, evaluation, menu, metrics, training
from tarkash.operators.validity import validity
from tarkash.sources import sinks


@pytest.fixture(scope="module")
def tables(spark):
    lexicon = spark.createDataFrame([("ghar", "ઘર", 900), ("wah", "વાહ", 700), ("wahan", "વાહન", 500), ("kam", "કામ", 80), ("mane", "માને", 75)], "roman string, native string, weight int")
    evidence = spark.createDataFrame([("ઘર", 900, 950, True), ("વાહ", 300, 300, True), ("કામ", 700, 800, True), ("મને", 5000, 0, True), ("વાહન", 200, 0, True)], "native string, unigram long, stem long, attested boolean")
    index = lexicon.select(F.explode(F.transform(F.sequence(F.lit(2), F.length("roman")), lambda k: F.substring("roman", F.lit(1), k))).alias("prefix"), "roman", "native", "weight")
    by_code = spark.createDataFrame([("wah", "🤩", 90, 0.98), ("ghar", "🏠", 10, 0.4)], "code string, emoji string, weight int, confidence double")
    exceptions = spark.createDataFrame([("ne", "ને")], "roman string, native string")
    return engine.Tables(lexicon, evidence, exceptions, index, by_code, largest=5000)


def asked(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "typed string")


def test_menus_of_typed_words(spark, tables):
    got = {r.typed: r.menu for r in engine.menus(asked(spark, "wah", "GHAR", "ghar", "ne", "kam", "x.com", "12", "", None), tables).collect()}
    assert set(got) == {"wah", "ghar", "ne", "kam", "x.com", "12"}
    assert got["x.com"] == ["x.com"] and got["12"] == ["12"]
    assert got["wah"][:2] == ["વાહ", "wah"] and "🤩" in got["wah"] and "વાહન" in got["wah"]
    assert got["wah"].index("🤩") < got["wah"].index("વાહન")
    assert got["ghar"][:2] == ["ઘર", "ghar"] and got["ne"][:2] == ["ને", "ne"] and got["kam"][:2] == ["કામ", "kam"]
    assert all(len(m) <= 6 and len(set(m)) == len(m) for m in got.values())


def test_families_can_be_turned_off(spark, tables):
    policy = engine.Policy().without("emoji", "completion", "phonetic", "latin")
    got = {r.typed: r.menu for r in engine.menus(asked(spark, "wah"), tables, policy).collect()}
    assert got == {"wah": ["વાહ"]}
    with pytest.raises(ValueError, match="unknown"):
        engine.Policy().without("nothing")


def test_script_forms_are_gated_beside_an_exact_entry(spark):
    forms = spark.createDataFrame([("t", x, (i, 0)) for i, x in enumerate(["ક", "ખ", "ગ", "ઘ", "ચ"])], "typed string, native string, at struct<a:int,b:int>")
    known = spark.createDataFrame([("ક", 1.0, 900, True, True, True), ("ખ", 1.0, 800, True, True, True), ("ગ", 1.0, 10, True, True, True), ("ઘ", 1.0, 0, False, False, True), ("ચ", 1.0, 700, True, False, False)], "native string, score double, unigram long, attested boolean, spell_ok boolean, present boolean")
    seen = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], "typed string, native string, source string, weight double, tier int")
    take = lambda s, most=5: [r.native for r in c.phonetic(None, known, most, s, 50, forms).collect()]
    none = seen(("ઝ", "fuzzy", 50.0, menu.DICT))
    assert set(take(none)) == {"ક", "ખ", "ચ"}  # after two frequent forms the rare ones stay away
    assert set(take(none, 2)) == {"ક", "ખ"}
    assert set(take(seen(("ઝ", "strict", 900.0, menu.EXACT)))) == {"ક", "ખ"}  # two beside a strong strict entry
    assert set(take(seen(("ઝ", "near_exact", 900.0, menu.EXACT)))) == {"ક", "ખ"}  # an exact entry that is neither strict nor weak: known forms only
    assert "ક" not in take(seen(("ક", "fuzzy", 50.0, menu.DICT)))
    assert "ચ" in take(seen(("ઝ", "strict", 50.0, menu.EXACT)))


def test_a_lone_letter_has_its_twin(spark):
    rows = {r.native: r["at"].a for r in c.script_forms(asked(spark, "n", "gh")).collect()}
    assert rows["ન"] == 0 and rows["ણ"] == 1


def test_menus_of_a_stream(spark, tables, tmp_path):
    source, out = tmp_path / "in", []
    asked(spark, "ghar", "wah").write.json(str(source))
    stream = spark.readStream.schema("typed string").json(str(source))
    policy = engine.Policy().without("phonetic")
    query = engine.of_stream(stream, tables, lambda rows, _: out.extend(rows.collect()), policy).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(120)
    assert {r.typed: r.menu[0] for r in out} == {"ghar": "ઘર", "wah": "વાહ"}


def test_the_layout_case(spark):
    rows = [(0, "વાહ", 1, 0.0), (1, "વહ", 1, 0.0), (2, "વાઅહ", 1, 0.0), (3, "વાહન", 1, 0.0), (4, "wah", 3, 0.0), (5, "વાહક", 4, 0.0), (6, "🤩", 5, 0.98)]
    items = spark.createDataFrame([(rows,)], "items array<struct<rank:int,native:string,tier:int,confidence:double>>")
    assert items.select(menu.layout(F.col("items"))).first()[0] == ["વાહ", "wah", "વહ", "વાઅહ", "🤩", "વાહન"]


def test_percentiles_are_exact(spark):
    draw = random.Random(2)
    rows = [("a", float(draw.randrange(50))) for _ in range(3000)] + [("b", draw.random()) for _ in range(30000)] + [("c", 1.5), ("a", None)]
    held = {k: sorted(v for x, v in rows if x == k and v is not None) for k in "abc"}
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.25, 0.5, 0.95, 1.0):
        got = {r.k: (r.n, r.value) for r in metrics.nth_percentile(df, "k", "v", p).collect()}
        assert got == {k: (len(h), h[min(len(h) - 1, int(len(h) * p))]) for k, h in held.items()}


def test_edges_of_the_evaluation(spark):
    menus = spark.createDataFrame([("a", ["x", "🙂"]), ("b", ["y"]), (None, None)], "typed string, menu array<string>")
    keywords = spark.createDataFrame([("a", "🙂", 0.95), ("gone", "🌟", 0.95), ("weak", "🌟", 0.1)], "code string, emoji string, confidence double")
    r = evaluation.emoji_quality(menus, keywords).first()
    assert (r.positive, r.visible, r.recall, r.negative, r.wrong) == (2, 1, 0.5, 2, 0)
    empty = evaluation.emoji_quality(menus.limit(0), keywords.limit(0)).first()
    assert empty.recall is None and empty.false_positive is None
    one = evaluation.fingerprint(menus).first()
    assert one == evaluation.fingerprint(menus.repartition(3).orderBy(F.desc("typed"))).first() != evaluation.fingerprint(menus.limit(2)).first()
    assert evaluation.fingerprint(menus.limit(0)).first().n == 0
    texts = spark.createDataFrame([("🙂",), ("",), (None,), ("\ufe0fx",), ("x\u200d",), ("a\x07",), ("\ufffd",)], "t string")
    assert [r[0] for r in texts.select(emoji.is_sequence(F.col("t"))).collect()] == [True, False, False, False, False, False, False]


def test_a_step_moves_towards_gold(spark):
    rows = [("r", True, *[1.0] * 10), ("r", False, *[0.0] * 10), ("alone", True, *[1.0] * 10)]
    df = spark.createDataFrame(rows, "roman string, gold boolean, " + ", ".join(f"{f} double" for f in training.FEATURES))
    sums = training.gradients(df, {}).first().asDict()
    assert sums["pairs"] == 1 and sums["soft"] == -0.5
    assert training.step({"soft": 1.0}, sums)["soft"] == pytest.approx(1.04)
    none = training.gradients(df.limit(0), {}).first().asDict()
    assert training.step({"soft": 1.0}, none)["soft"] == 1.0
    x = spark.createDataFrame([(25.0,), (-25.0,), (0.0,)], "x double").select(training.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in x] == [1.0, 0.0, 0.5]


def test_text_forms(spark, tables, tmp_path):
    sinks.lexicon_text(tables.lexicon, str(tmp_path / "l"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "l")).collect()]
    assert "ghar\tઘર\t900\t0" in lines and "kam\tકામ\t80\t1" in lines
    ranked = tables.index.where("prefix = 'wa'").withColumn("rank", F.when(F.col("roman") == "wah", 1).otherwise(2))
    sinks.prefix_text(ranked, str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["wa\tવાહ\x1f700\x1fwah\x1eવાહન\x1f500\x1fwahan"]
    sinks.stems_json(spark.createDataFrame([("a", 3), ("b", 9), ("c", 1)], "word string, n long"), str(tmp_path / "s"), 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ['{"a":3,"b":9}']
    store = spark.createDataFrame([("r", "ક", 2, 10, 0, "ક"), ("r", "ખ", 1, 5, 0, "ક")], "roman string, native string, explicit_count int, last_used long, legacy_count int, preferred string")
    sinks.learning_store(store, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).select("roman", "preferred_native", "natives.ક.explicit_count").first() == ("r", "ક", 2)
    sinks.rewritten(tables.lexicon, spark.createDataFrame([("ghar", "ઘડ", 1), ("new", "નવ", 2)], "roman string, native string, weight int"), str(tmp_path / "n"))
    again = {r.roman: r.native for r in spark.read.parquet(str(tmp_path / "n")).collect()}
    assert again["ghar"] == "ઘડ" and again["new"] == "નવ" and len(again) == 6


def test_validity_of_an_empty_table(spark, tables):
    assert validity(tables.evidence.limit(0), tables.evidence).count() == 0
