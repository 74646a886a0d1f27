from pyspark.sql import functions as F

from tarkash.operators import counts, learning, lookup, menu, metrics, splits


def test_argmax_ties_go_to_the_smaller_value(spark):
    rows = spark.createDataFrame([("a", "y", 3), ("a", "x", 3), ("b", "z", 1)], "k string, v string, n int")
    assert {(r.k, r.v) for r in counts.argmax(rows, "k", "v").collect()} == {("a", "x"), ("b", "z")}


def test_percentile_takes_the_listed_place(spark):
    rows = spark.range(2500).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    assert metrics.nth_percentile(rows, "k", "v", 0.95).first().value == 2375.0


def test_ranking_counts_missing_as_zero(spark):
    rows = spark.createDataFrame([(1,), (3,), (6,), (7,), (None,)], "p int")
    got = metrics.ranking(rows, "p").first()
    assert (got.n, got.top1, got.top3, got.recall6) == (5, 0.2, 0.4, 0.6)


def test_second_selection_promotes_and_the_latest_wins(spark):
    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "a", 3), ("r", "b", 4), ("r", "c", 5)], "k string, v string, t int")
    assert [(r.preferred, r["at"]) for r in learning.preferred(rows, "k", "v", "t", "t").collect()] == [("b", 4)]


def test_purge_keeps_strong_entries(spark):
    lexicon = spark.createDataFrame([("a", 50), ("b", 150), ("c", 50)], "w string, n int")
    test = spark.createDataFrame([("a",), ("b",)], "w string")
    assert {r.w for r in splits.purge(lexicon, test, "w", "n", 100).collect()} == {"b", "c"}


def test_lattice_equals_a_plain_beam(spark):
    pairs, passes, beam, most = [("i", "ee", 1.0), ("ee", "i", 1.0), ("s", "sh", 2.0), ("aa", "a", 0.5)], 2, 5, 3.0
    words = ["kitis", "seeds", "aaa", "x", "sisi"]

    def plain(word):
        front = {word: 0.0}
        for _ in range(passes):
            more = dict(front)
            for form, cost in front.items():
                for a, b, c in pairs:
                    for i in range(len(form) - len(a) + 1):
                        if form[i : i + len(a)] == a and cost + c <= most:
                            alt = form[:i] + b + form[i + len(a) :]
                            more[alt] = min(more.get(alt, 99), cost + c)
            front = dict(sorted(more.items(), key=lambda x: (x[1], len(x[0]), x[0]))[:beam])
        return {(word, f, c) for f, c in front.items()}

    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in lookup.lattice(df, pairs, passes, beam, F.lit(most)).collect()}
    assert got == set().union(*map(plain, words))


def test_layout_puts_latin_second_and_emoji_after_three_words(spark):
    items = [("w1", 0, 0.0), ("w2", 1, 0.0), ("w3", 2, 0.0), ("w4", 2, 0.0), ("lat", 3, 0.0), ("pre", 4, 0.0), ("e1", 5, 0.95), ("e2", 5, 0.2)]
    df = spark.createDataFrame([(items,)], "items array<struct<native:string,tier:int,confidence:double>>")
    assert df.select(menu.layout(F.col("items"), cap=9)).first()[0] == ["w1", "lat", "w2", "w3", "e1", "w4", "pre", "e2"]


def test_layout_without_words_leaves_out_sure_emoji(spark):
    items = [("lat", 3, 0.0), ("e1", 5, 0.95), ("e2", 5, 0.2)]
    df = spark.createDataFrame([(items,)], "items array<struct<native:string,tier:int,confidence:double>>")
    assert df.select(menu.layout(F.col("items"))).first()[0] == ["lat", "e2"]
