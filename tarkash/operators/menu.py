"""Order and layout of candidate menus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers, best first (fixed values).
PERSONAL, EXACT, DICT, PHONETIC, LATIN, PREFIX, EMOJI = -1, 0, 1, 2, 3, 4, 5


def ranked(candidates: DataFrame, typed: str) -> DataFrame:
    """``rank`` within a typed text: tier, then score, closeness and weight downwards, then index."""
    order = Window.partitionBy(typed).orderBy("tier", F.desc("score"), F.desc("closeness"), F.desc("weight"), "index")
    return candidates.withColumn("rank", F.row_number().over(order))


def layout(items: Column, before_emoji: int = 3, most_emoji: int = 2, confidence: float = 0.9, cap: int = 6) -> Column:
    """The menu of ranked items(native, tier, confidence).

    The best word, the Latin row, further words up to ``before_emoji``, the sure emoji, the other
    words, completions, and the other emoji. Without any word only the Latin row, completions and
    the emoji not counted as sure are laid out.
    """
    word = F.filter(items, lambda x: x["tier"] <= PHONETIC)
    latin = F.filter(items, lambda x: x["tier"] == LATIN)
    prefix = F.filter(items, lambda x: x["tier"] == PREFIX)
    emoji = F.filter(items, lambda x: x["tier"] == EMOJI)
    fit = F.filter(emoji, lambda x: x["confidence"] >= confidence)
    sure = F.slice(fit, 1, most_emoji) if most_emoji else fit
    rest = F.filter(emoji, lambda x: ~F.array_contains(sure, x))
    ahead = max(1, before_emoji)
    laid = F.when(F.size(word) > 0, F.concat(F.slice(word, 1, 1), F.slice(latin, 1, 1), F.slice(word, 2, max(0, ahead - 1)), sure, F.slice(word, ahead + 1, 1_000_000))).otherwise(F.slice(latin, 1, 1))
    return F.transform(F.slice(F.concat(laid, prefix, rest), 1, cap), lambda x: x["native"])
