"""Scores of a typed word's candidates: a base, adjustments by rule, and passes over its siblings.

All is column expressions and windows over the typed word, so one shuffle by it serves every rule
and the final rank. Rows come from ``candidates.merge``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.script import canonical, extends, unigram_score, user_boost
from tarkash.functions.transliterate import phonetic_forms
from tarkash.operators.candidates import STRONG, is_soft
from tarkash.operators.menu import DICT, EMOJI, EXACT, PERSONAL

# Digraphs typed for a plain letter, letters of two places, and their natives.
DIGRAPHS = (("chh", "ch"), ("chh", "c"), ("kh", "k"), ("gh", "g"), ("th", "t"), ("dh", "d"), ("ph", "p"), ("bh", "b"), ("sh", "s"), ("jh", "j"))
PLACES = {"n": ("ન", "ણ"), "N": ("ણ", "ન"), "t": ("ત", "ટ"), "T": ("ટ", "ત"), "d": ("દ", "ડ"), "D": ("ડ", "દ"), "l": ("લ", "ળ"), "L": ("ળ", "લ")}
LEXICAL = ("strict", "fuzzy", "near_exact", "stem_matra", "stem_postfix", "stem_inflection", "stem_compound")
ONSET = r"\A(?:[kgcjtdpbnmylrsvwxz]|ch|kh|gh|jh|th|dh|ph|bh|sh|tr|dr)a(?!a)"


def digraph_strip(typed: Column, key: Column) -> Column:
    """The key is the typed word with one digraph made plain."""

    def stripped(a: str, b: str) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(typed), F.lit(1)))
        return F.exists(places, lambda i: (F.substring(typed, i, F.lit(len(a))) == a) & (F.concat(F.substring(typed, F.lit(1), i - 1), F.lit(b), F.substring(typed, i + len(a), F.length(typed))) == key))

    found = [(F.length(typed) - F.length(key) == len(a) - len(b)) & stripped(a, b) for a, b in DIGRAPHS]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return F.coalesce(out, F.lit(False))


def vowel_lengthened(typed: Column, key: Column) -> Column:
    """The key doubles one inner vowel of the typed word before a consonant; w counts as v."""
    at = lambda i: F.substring(key, i, F.lit(1))
    inner = F.sequence(F.lit(2), F.greatest(F.length(key) - 1, F.lit(2)))
    shorter = lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key)))
    fits = lambda i: at(i).rlike("[aiuo]") & (at(i) == at(i - 1)) & at(i + 1).rlike("[^aiuo]") & (F.translate(shorter(i), "w", "v") == F.translate(typed, "w", "v"))
    return F.coalesce((F.length(key) == F.length(typed) + 1) & F.exists(inner, fits), F.lit(False))


def _points(cases: Sequence[tuple[Column, Column | float]]) -> Column:
    """The points of the first case that fits, else none; a null condition does not fit."""
    out = None
    for when, points in cases:
        out = F.when(when, points) if out is None else out.when(when, points)
    return out.otherwise(0.0)


def score(merged: DataFrame, known: DataFrame, lexicon: DataFrame, learnt: DataFrame | None = None, largest: int = 1, model: DataFrame | None = None) -> DataFrame:
    """``merged`` with ``score``, the adjusted ``tier``, ``evidence`` and ``attested``.

    ``known`` is ``validity`` of the natives, ``lexicon(roman, native, weight)`` gives the typed
    word's own entry, ``learnt(typed, native, explicit_count, preferred)`` the user's choices, and
    ``largest`` the largest unigram. ``model(typed, native, log_prob)`` adds a model's scores. A score that is no number becomes -1,000,000.
    """
    t, w, key, source, weight = F.col("typed"), F.col("native"), F.col("key"), F.col("source"), F.col("weight")
    rows = merged.join(known.select("native", F.col("score").alias("v"), "evidence", "unigram", "attested", "spell_ok"), "native", "left")
    rows = rows.join(lexicon.select(F.col("roman").alias("typed"), canonical(F.col("native")).alias("own"), F.col("weight").alias("own_weight")), "typed", "left")
    if learnt is None:
        rows = rows.withColumns({"explicit_count": F.lit(0), "preferred": F.lit(False)})
    else:
        rows = rows.join(learnt.select("typed", "native", "explicit_count", "preferred"), ["typed", "native"], "left")
    rows = rows.na.fill({"v": 0.0, "evidence": 0, "unigram": 0, "attested": False, "spell_ok": False, "own_weight": 0, "explicit_count": 0, "preferred": False})
    whole = Window.partitionBy("typed")
    rows = rows.withColumns({"strip": F.max(digraph_strip(t, key)).over(whole), "morph": F.max(extends(F.col("own"), w)).over(whole), "lengthened": vowel_lengthened(t, key)})

    uni, picks = 0.55 * F.log1p("unigram"), F.col("explicit_count")
    word, lexical = F.col("tier") != EMOJI, source.isin(*LEXICAL)
    strong = F.col("own").isNotNull() & (F.col("own_weight") >= STRONG)
    freq = 0.35 * F.log1p("weight")
    language = 0.6 * unigram_score(F.col("unigram"), F.lit(largest)) + user_boost(picks) - F.when(source == "phonetic", 0.15).otherwise(0.0)
    base = F.when(word, language).otherwise(0.2 * F.log1p("weight")) + freq + F.when(word & F.col("attested"), 1.4 * F.col("v")).otherwise(0.0) + F.when(word & F.col("spell_ok"), 0.35).otherwise(0.0) + 0.01 * F.col("closeness") + uni - 1.35 * F.col("cost")

    has = lambda x: w.contains(x)
    typed_has = lambda x: t.contains(x)
    twin = t.rlike(r"\A[nNtTdDlL]\z")
    place = lambda i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for a, b in PLACES.items() for x in (a, b[i])]), t), F.lit(""))
    double, stop = t.rlike("mm|nn|tt|kk|ll"), t.rlike("n[kgcjtdTDpb]")
    nasal_only = has("ં") & ~has("્")
    lead = w.startswith("આ") | w.rlike(r"\A[ક-હ]ા")
    rest = F.when(w.startswith("આ"), F.expr("substring(native, 2)")).otherwise(F.expr("substring(native, 3)"))
    only_onset = t.rlike(ONSET) & lead & ~rest.contains("ા") & F.expr("substring(typed, 3)").rlike("a(?!a)")
    bare_end = w.endswith("ા") & ~t.endswith("a")
    runs = F.regexp_count(t, F.lit("a+"))
    longs = F.greatest(F.lit(0), F.regexp_count(w, F.lit("ા")) - F.when(bare_end, 1).otherwise(0))
    later = (runs >= 1) & F.expr("substring(typed, 2)").contains("a")
    adjustments = [
        [(lexical & is_soft(weight) & (F.col("unigram") < 150), -(0.85 * freq + 2.8))],
        [((F.col("own") == w) & is_soft(F.col("own_weight")) & F.col("strip"), 3.2)],
        [(strong & ~twin & (F.col("own") == w) & F.col("morph"), 6.5), (strong & ~twin & extends(F.col("own"), w), -8.5)],
        [((source == "near_exact") & strong & (w != F.col("own")) & (F.length(key) > F.length(t)), -7.0)],
        [(lexical & (key == t) & (F.col("own_weight") >= STRONG), 2.0), (lexical & (F.length(key) > F.length(t) + 1), -1.5)],
        [(F.col("preferred") | (picks >= 2), 80.0), (picks > 0, F.least(F.lit(4.0), 1.2 * F.log1p(picks)))],
        [(has("ય") & ~typed_has("y"), -4.0)],
        [(t.rlike(r"\A[aiueoREOMH]\z") & (key != t), -30.0)],
        [(twin & (w == place(0)), 2.5), (twin & (w == place(1)), -0.35)],
        [(typed_has("d") & has("ડ") & ~has("દ"), -1.2)],
        [(typed_has("d") & has("દ"), 0.5)],
        [(t.startswith("sh") & w.startswith("શ"), 3.0), (t.startswith("sh") & w.startswith("સ"), -(3.0 + 0.5 * uni))],
        [(~typed_has("sh") & typed_has("s") & has("શ") & ~has("ષ"), -0.55)],
        [(~typed_has("sh") & typed_has("s") & has("સ") & ~has("શ"), 0.15)],
        [(typed_has("z") & ~typed_has("j") & w.startswith("ઝ"), 0.5), (typed_has("z") & ~typed_has("j") & w.startswith("જ"), -0.35)],
        [(double & has("્"), 5.5), (double & nasal_only, -(6.5 + 1.15 * uni)), (~double & has("ં") & stop, 0.35)],
        [(t.startswith("aa") & w.startswith("આ"), 3.5), (t.startswith("aa") & w.startswith("અ"), -4.0), (~t.startswith("aa") & only_onset, -3.8)],
        [(bare_end, -1.6)],
        [(later, 0.2 * longs)],
        [(later & (runs >= 2) & (longs >= 2), 2.5), (later & (runs >= 2), -1.2)],
        [(F.col("lengthened") & has("ા"), 5.25)],
        [(F.length(w) < 0.7 * F.length(t), -2.0)],
    ]
    total = base
    for cases in adjustments:
        total = total + _points(cases)
    fall = (strong & ~twin & extends(F.col("own"), w)) | ((source == "near_exact") & strong & (w != F.col("own")) & (F.length(key) > F.length(t)))
    fall = fall | (double & nasal_only) | (t.startswith("aa") & w.startswith("અ"))
    demoted = (source == "fuzzy") & strong & (w != F.col("own")) & ~F.col("lengthened")
    level = F.when(F.coalesce(demoted, F.lit(False)), DICT).when(F.coalesce(fall, F.lit(False)) & (F.col("tier") == EXACT), DICT).otherwise(F.col("tier"))
    level = F.when(F.col("preferred"), PERSONAL).otherwise(level)
    total = F.when(total.isNull() | F.isnan(total) | (F.abs(total) == float("inf")), -1e6).otherwise(total)
    rows = rows.withColumns({"score": total, "tier": level.cast("int")})
    if model is not None:
        rows = _arbitrated(rows, model)
    return _siblings(rows).select(*merged.columns, "score", "evidence", "attested")


def _arbitrated(rows: DataFrame, model: DataFrame, margin: float = 3.0, gap: float = 1.25) -> DataFrame:
    """Adds a model's scores, and lets a form of the typed word take an exact entry's place.

    It does so if the model puts it first, ``margin`` over the entry, which is no such form; or if
    the typed word ends in s, the entry in another sibilant, and the form is within ``gap`` of the
    best. Log probabilities count relative to the typed word's best.
    """
    whole = Window.partitionBy("typed")
    lead = F.col("log_prob") - F.max("log_prob").over(whole)
    relative = model.select("typed", "native", lead.alias("rel")).groupBy("typed", "native").agg(F.max("rel").alias("rel"))
    rows = rows.join(relative, ["typed", "native"], "left").withColumn("direct", F.array_contains(phonetic_forms(F.col("typed")), F.col("native")))
    boost = 1.5 * F.coalesce("rel", F.lit(0.0)) + F.when(F.col("source") == "neural", 3.0).otherwise(0.0)
    pick = lambda when, *cols: F.when(when, F.struct(*cols))
    seen, strict = F.col("rel").isNotNull(), (F.col("tier") == EXACT) & (F.col("source") == "strict")
    rows = rows.withColumns(
        {
            "score": F.col("score") + boost,
            "exact": F.min(pick(strict, "native", "rel", "direct")).over(whole),
            "first": F.max(pick(seen, "rel", "native", "direct")).over(whole),
            "form": F.max(pick(seen & F.col("direct"), "rel", "native")).over(whole),
        }
    )
    sibilant = F.col("typed").endswith("s") & F.col("exact.native").endswith("શ") & F.col("form.native").endswith("સ") & (F.col("form.rel") >= -gap)
    sure = F.col("first.direct") & ~F.col("exact.direct") & (F.col("first.rel") - F.col("exact.rel") >= margin)
    winner = F.when(sibilant, F.col("form.native")).when(sure, F.col("first.native"))
    won = F.when((F.length("typed") >= 2) & (winner != F.col("exact.native")), winner)
    rows = rows.withColumn("won", won)
    up, down = F.col("native") == F.col("won"), F.col("won").isNotNull() & (F.col("native") == F.col("exact.native"))
    return rows.withColumns(
        {
            "score": F.col("score") + F.when(up, margin).when(down, -margin).otherwise(0.0),
            "tier": F.when(up, EXACT).when(down, DICT).otherwise(F.col("tier")),
            "provenance": F.when(up, F.array_union("provenance", F.array(F.lit("neural_arbitration")))).otherwise(F.col("provenance")),
        }
    )


def _siblings(rows: DataFrame) -> DataFrame:
    """Soft entries against stems with endings, then exact entries against a lengthened spelling."""
    whole = Window.partitionBy("typed")
    source, weight, own = F.col("source"), F.col("weight"), F.col("own_weight")
    rows = rows.withColumns({"sign": F.max(source == "stem_matra").over(whole), "post": F.max(source == "stem_postfix").over(whole)})
    soft = (F.col("key") == F.col("typed")) & is_soft(own) & source.isin("strict", "fuzzy") & (F.col("tier") == DICT)
    points = _points([(soft & F.col("typed").rlike(r"[aeiou]\z") & F.col("sign") & ~F.col("post"), 5.5)])
    points = points + _points([((source == "stem_matra") & is_soft(own), -2.0), (source.isin("stem_postfix", "stem_inflection") & (weight >= STRONG), 4.5)])
    rows = rows.withColumn("score", F.col("score") + points)
    fits = (source == "fuzzy") & (F.col("cost") <= 4) & F.col("attested") & F.col("lengthened")
    winner = F.max(F.when(fits, F.struct("score", "evidence"))).over(whole)
    rows = rows.withColumn("best", winner)
    beaten = (F.col("tier") == EXACT) & (source == "strict") & (F.col("best.score") >= F.col("score") + 3) & (F.col("best.evidence") >= 4.25 * F.col("evidence"))
    return rows.withColumn("tier", F.when(beaten, DICT).otherwise(F.col("tier")))
