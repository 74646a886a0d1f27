"""Evaluation of menus against gold: latency, emoji, fingerprints, ablations, parity, eligibility, disagreement tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PICTURES = "[\U0001f000-\U0001faff☀-➿\U0001f1e6-\U0001f1ff]"
BUCKET_DIGITS = 3


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median, mean) of a measure; null measures are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"))


def emoji_quality(menus: DataFrame, keywords: DataFrame, least: float = 0.9) -> DataFrame:
    """One row: positive keywords and how many menus show one of their sure emoji, other words and how many show any picture.

    ``menus(typed, menu)``, ``keywords(code, emoji, confidence)``. A keyword counts if it has an emoji
    of ``least`` confidence; without a menu it shows none. Rates of nothing are null.
    """
    sure = keywords.where(F.col("confidence") >= least).groupBy("code").agg(F.collect_set("emoji").alias("wanted"))
    shown = sure.join(menus, F.col("code") == F.col("typed"), "left").agg(F.count("*").alias("positive"), F.count_if(F.coalesce(F.arrays_overlap("wanted", "menu"), F.lit(False))).alias("visible"))
    others = menus.join(keywords.select(F.col("code").alias("typed")).distinct(), "typed", "left_anti")
    wrong = F.exists("menu", lambda x: F.coalesce(x.rlike(PICTURES), F.lit(False)))
    counted = others.agg(F.count("*").alias("negative"), F.count_if(wrong).alias("wrong"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return shown.crossJoin(counted).select("positive", "visible", rate("visible", "positive").alias("recall"), "negative", "wrong", rate("wrong", "negative").alias("false_positive"))  # one row each


def fingerprint(menus: DataFrame) -> DataFrame:
    """(n, digest) of all menus, whatever their order or partitions.

    Rows are digested alone, then in the order of their digests within 4,096 buckets of them, and
    the buckets' digests in order: what one task gathers is a 4,096th of the digests.
    """
    row = F.sha2(F.concat_ws("\t", F.coalesce("typed", F.lit("")), F.array_join(F.coalesce("menu", F.array().cast("array<string>")), "\x1f", "")), 256)
    rows = menus.select(row.alias("d")).withColumn("b", F.substring("d", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("digest"))


def ablation(enabled: DataFrame, disabled: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row of ``enabled`` less ``disabled`` for each measure of two one-row reports."""
    off = disabled.select(*[F.col(m).alias(f"__{m}") for m in measures])
    return enabled.select(*measures).crossJoin(off).select(*[(F.col(m) - F.col(f"__{m}")).alias(m) for m in measures])  # one row each


def parity(left: DataFrame, right: DataFrame, key: str, menu: str) -> DataFrame:
    """(key, state): same, differs, left_only or right_only for each key of two tables of menus."""
    a = left.select(key, F.struct(F.col(menu).alias("m")).alias("a"))
    b = right.select(key, F.struct(F.col(menu).alias("m")).alias("b"))
    both = a.join(b, key, "full_outer")
    state = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a.m").eqNullSafe(F.col("b.m")), "same").otherwise("differs")
    return both.select(key, state.alias("state"))


def eligible(gold: DataFrame, test: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """Gold rows whose key is in the test set and not in the lexicon."""
    return gold.join(test.select(key).distinct(), key, "left_semi").join(lexicon.select(key).distinct(), key, "left_anti")


def disagreement_tags(roman: Column, ours: Column, gold: Column, tier: Column, top5: Column) -> Column:
    """array<string>: what may have parted our first candidate from gold, else other; lexicon_miss if gold is not among the five."""
    roman, ours, gold = (F.coalesce(c, F.lit("")) for c in (roman, ours, gold))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    bare = lambda c: F.translate(c, "ંઁ્", "")
    has = lambda c, x: F.contains(c, F.lit(x))
    tests = {
        "anusvara_n_stop": has(gold, "ં") & ~has(ours, "ં") & has(ours, "ન"),
        "long_a": count(gold, "ા") > count(ours, "ા"),
        "diphthong_ai_oi_ui": roman.rlike("ai|ay|oi|ui|ei") & gold.rlike("[ઈઇ]"),
        "typed_sh": roman.startswith("sh") & gold.startswith("શ") & ours.startswith("સ"),
        "v_w": has(roman, "w") & has(gold, "વ"),
        "z_j": has(roman, "z") & gold.rlike("[ઝજ]"),
        "schwa_vs_conjunct": count(gold, "્") != count(ours, "્"),
        "i_length": (has(gold, "ી") & has(ours, "િ")) | (has(gold, "િ") & has(ours, "ી")),
        "nasal_final_u": gold.endswith("ું") & ~ours.endswith("ું"),
        "geminate": roman.rlike("mm|nn|tt|kk|ll") & has(gold, "્") & ~has(ours, "્"),
        "english_loan": roman.rlike("sch|tion|qu|ck|school|college|doctor|hospital|london"),
        "soft_lex_win": F.coalesce(tier == 0, F.lit(False)) & (ours != gold),
        "orthography_glue": (bare(ours) == bare(gold)) & (ours != gold),
    }
    found = F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))
    missed = (gold != "") & ~F.coalesce(F.array_contains(top5, gold), F.lit(False))
    return F.when(missed, F.array_append(found, F.lit("lexicon_miss"))).otherwise(found)


def capture_cluster(gold: Column, menu: Column, weight: Column) -> Column:
    """ok_top1, missing, or how a candidate within the first six came to stand too low."""
    top = F.coalesce(F.get(menu, F.lit(0)), F.lit(""))
    place = F.array_position(F.slice(menu, 1, 6), gold)
    low = (
        F.when(gold.rlike("[ટડણળ]"), "dental_retroflex")
        .when(F.contains(gold, F.lit("ા")) & ~F.contains(top, F.lit("ા")), "vowel_length")
        .when((weight > 0) & (weight < 100), "soft_lost_to_stem")
        .otherwise("misranked")
    )
    return F.when(place == 1, "ok_top1").when(F.coalesce(place, F.lit(0)) == 0, "missing").otherwise(low)


def gate_failures(menu: Column, top1: Column, required: Column, forbidden_top1: Column, forbidden: Column) -> Column:
    """array<string> of what a hand-made case finds wrong with a menu: top1, missing, forbidden_top1, forbidden; null lists ask nothing."""
    none = F.array().cast("array<string>")
    first, six = F.get(menu, F.lit(0)), F.slice(menu, 1, 6)
    lists = [F.coalesce(c, none) for c in (required, forbidden_top1, forbidden)]
    tests = {
        "top1": top1.isNotNull() & ~first.eqNullSafe(top1),
        "missing": F.size(F.array_except(lists[0], six)) > 0,
        "forbidden_top1": F.coalesce(F.array_contains(lists[1], first), F.lit(False)),
        "forbidden": F.arrays_overlap(lists[2], six),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]))
