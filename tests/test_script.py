import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tarkash.functions import decoder, script
from tarkash.functions.spellings import alternates, doubles, leading, lengths, loans, nasals, retroflex, swaps, visarga
from tarkash.functions.transliterate import Transliterator, phonetic_forms, tokens, transliterate


def values(spark, fn, words):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    return [r[1] for r in rows.select("i", fn(F.col("w"))).orderBy("i").collect()]


def syllables(word):
    """A plain reader of syllables: what stands to the left decides what may follow."""
    follows = {
        "": "VC", "V": "VCM", "C": "VCNHmM", "N": "VCHmM", "H": "CJ", "J": "C", "m": "VCM", "M": "VC",
    }
    state = ""
    for c in word:
        k = ord(c)
        kind = (
            "V" if 0x0A85 <= k <= 0x0A94 else "C" if 0x0A95 <= k <= 0x0AB9 or k == 0x0AF9 else "N" if k == 0x0ABC else "H" if k == 0x0ACD
            else "J" if k in (0x200C, 0x200D) else "m" if 0x0ABE <= k <= 0x0ACC or 0x0AE2 <= k <= 0x0AE3 else "M" if 0x0A81 <= k <= 0x0A83 else "?"
        )
        if kind not in follows[state]:
            return False
        state = kind
    return state not in ("", "H", "J")


def test_words_are_sequences_of_syllables(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("અકરૹ઼્ાીંઃ‍a", k=rng.randint(0, 5))) for _ in range(3000)]
    known = ["યસ", "પડી", "શ્રદ્ધા", "હું", "કિી", "ક્", "અા"]
    assert values(spark, script.is_gujarati_word, words + known) == [syllables(w) for w in words + known]
    assert values(spark, script.is_gujarati_word, ["ૐ", None]) == [True, False]


def test_roman_words(spark):
    assert values(spark, script.is_roman_word, ["yas", "o'brien", "-a", "a--b", "", None, "a" * 33]) == [True, True, False, False, False, False, False]
    assert values(spark, script.is_roman, ["ab", "a", ".'", "A-b", None, "a1"]) == [True, False, False, True, False, False]


def test_tokens_are_the_longest():
    assert tokens("chhkshaa1+q") == ["chh", "ksh", "aa", "1", "+", "q"]


def test_transliteration(spark):
    cases = {"kem": "કેમ", "pra": "પ્ર", "k+t": "ક્ત", "kagaL": "કગળ", "aavyu": "આવ્યુ", "gnaan": "જ્ઞાન", "a12": "અ૧૨", "": "", "om": "ૐ", "+": ""}
    assert values(spark, transliterate, [*cases, None]) == [*cases.values(), None]


def test_forms_hold_nasals_and_split_vowels(spark):
    got = values(spark, phonetic_forms, ["tu", "gai", "joi", "2.9", "ai", None])
    assert got[0] == ["તુ", "તું"]
    assert got[1] == ["ગૈ", "ગઈ", "ગઇ", "ગાઈ", "ગાઇ"]
    assert got[2] == ["જોઇ", "જોઈ"]
    assert got[3] == ["2.9"]
    assert got[4] == ["ઐ", "અઈ", "અઇ", "આઈ", "આઇ"]
    assert got[5] is None


def test_conjuncts_follow_the_policy():
    assert Transliterator([])("pra") == "પર" and Transliterator(["p|r"])("pra") == "પ્ર"


def test_postfix_and_weights(spark):
    assert values(spark, script.strip_postfix, ["ઘરમાંથી", "ઘરમાં", "ઘર", "માં", None]) == ["ઘર", "ઘર", None, None, None]
    rows = spark.createDataFrame([(1, 0), (2, 0), (1, 8), (8, 0), (1, 40), (None, None)], "n int, f int")
    assert [r[0] for r in rows.select(script.soft_weight(F.col("n"), F.col("f"))).collect()] == [75, 80, 80, 85, 85, 75]


def test_wiki_tokens_and_emoji_codes(spark):
    assert values(spark, script.clean_wiki_token, ["ગુજરાત (રાજ્ય)", "#x", "abcક", "(ક)ખગ,", None]) == ["ગુજરાત", None, None, "ખગ", None]
    assert values(spark, script.emoji_codes, ["Smile Face", "a-b", "1x", None]) == [["smileface", "smile", "face"], ["ab"], [], None]
    assert values(spark, script.matra_variants, ["કીકી", "", None])[:2] == [["કિકી", "કીકિ"], []]


def test_quality_reasons(spark):
    rows = spark.createDataFrame([("ક ખ", 200, True, False), ("ક ખ", 200, False, False), ("ક" * 17, 50, False, False), ("ક" * 29, 200, False, False), ("કનો", 50, False, True), ("કનો", 200, False, True)], "w string, n int, a boolean, s boolean")
    got = rows.select(script.quality_reason(*[F.col(c) for c in "wnas"])).collect()
    assert [r[0] for r in got] == [None, "space", "soft_long", "hard_long", "soft_postfix_dup", None]


def test_beam_equals_all_paths(spark):
    rng = np.random.default_rng(5)
    vocab = ["", "ક", "ા"]
    for _ in range(5):
        scores = rng.normal(size=(4, 3))
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        paths: dict[str, float] = {}
        for path in itertools.product(range(3), repeat=4):
            word = "".join(vocab[t] for t, _ in itertools.groupby(path))
            if word:
                paths[word] = paths.get(word, 0.0) + math.exp(sum(scores[i, t] for i, t in enumerate(path)))
        wanted = sorted(paths.items(), key=lambda x: -x[1])[:8]
        got = decoder.prefix_beam(scores, vocab, 8, 32)
        assert [w for w, _ in got] == [w for w, _ in wanted]
        assert np.allclose([s for _, s in got], [math.log(p) for _, p in wanted])
    rows = spark.createDataFrame([(scores.tolist(),), (None,), ([],)], "f array<array<double>>")
    first, none, empty = (r[0] for r in rows.select(decoder.decode(F.col("f"), vocab, 8, 32)).collect())
    assert [x.native for x in first] == [w for w, _ in got] and none is None and empty == []


def test_long_i_gives_short_variants():
    scores = np.log(np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9]]))
    got = dict(decoder.prefix_beam(scores, ["", "ક", "ી"], 8, 32))
    assert math.isclose(got["કિ"], got["કી"] - 0.5)


def test_spellings_of_a_word(spark):
    got = values(spark, alternates, ["nmste", "gai", "", None])
    assert got[0][0] == "nmste" and {"namste", "namaste", "nmasTe"} - set(got[0]) <= {"nmasTe"}
    assert "gaii" not in got[1] and got[2] == [""] and got[3] is None


def test_rules_change_one_place():
    assert list(swaps("ssa", "s", "sh")) == ["shsa", "ssha"]
    assert list(lengths("kai")) == ["kaai"] and list(lengths("ai")) == []
    assert list(doubles("himmat")) == ["him+mat"] and list(nasals("anka")) == ["aMka"]
    assert list(retroflex("goThni")) == ["goThNi"] and list(visarga("dukhd")) == ["dukHd"]
    assert list(loans("college")) == ["colleg"] and list(leading("avo")) == ["aavo"] and list(leading("aavo")) == ["avo"]


def test_closeness_and_penalties(spark):
    rows = spark.createDataFrame([("ab", "AB"), ("ab", "abc"), ("a", "abcdefgh"), ("abc", "abd"), ("abc", "xyz"), (None, "a"), ("", "a")], "a string, b string")
    assert [r[0] for r in rows.select(script.closeness(F.col("a"), F.col("b"))).collect()] == [100, 72, 40, 12, 0, 0, 0]
    assert values(spark, script.orthography_penalty, ["ાક", "ક્્ક", "કાીુ", "ક", "", None]) == [3.0, 2.5, 4.0, 0.0, 0.0, 0.0]


def test_only_short_a_added(spark):
    pairs = [("mne", "mane"), ("avo", "aavo"), ("kyare", "kyaare"), ("ab", "ab"), ("nmst", "namasta"), ("a.b", "a.ab"), ("ab", "abx"), ("", "a")]
    rows = spark.createDataFrame(pairs, "t string, k string")
    got = [r[0] for r in rows.select(script.only_short_a_added(F.col("t"), F.col("k"))).collect()]
    assert got == [True, False, False, False, True, True, False, False]


def test_numbers_and_addresses(spark):
    assert values(spark, script.is_number, ["2", "2.", ".5", "a2.5b", "2a", "", None]) == [True, True, True, True, False, False, False]
    assert values(spark, script.is_latin_literal, ["a@b", "x.com", "comma", "http://x", None]) == [True, True, False, True, False]
