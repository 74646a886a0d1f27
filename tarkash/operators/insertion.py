"""Filling a lexicon up to a cap, in an order of preference, without forms of known stems.

Whether a form comes in depends on the forms taken before it, through its stem alone. A stem is a
shorter word, so the rows are settled by the number of postfixes they carry: each level needs only
the level below it. A few joins take the place of one ordered pass over all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarkash.functions.script import is_soft, soft_weight, strip_postfix

Strip = Callable[[Column], Column]

# Postfixes that an input-method dictionary is filled without (fixed values).
DICTIONARY_POSTFIXES = ("માં", "ની", "ના", "ને", "નો", "નું", "થી")


def depth(word: Column, longest: int = 16, cut: Strip = strip_postfix) -> Column:
    """How many postfixes come off one after the other; a strip takes two characters or more."""
    start = F.struct(word.alias("w"), F.lit(0).alias("d"))

    def strip(state: Column, _: Column) -> Column:
        rest = cut(state["w"])
        return F.struct(F.coalesce(rest, state["w"]).alias("w"), F.when(rest.isNull(), state["d"]).otherwise(state["d"] + 1).alias("d"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, longest // 2))), start, strip, lambda state: state["d"])


def settle(rows: DataFrame, word: str, order: Column, known: DataFrame, longest: int, cut: Strip = strip_postfix) -> DataFrame:
    """Rows taken if, in ``order``, their stem is neither known nor the word of a row taken before.

    ``known`` holds a column of the same name. Words may repeat; a null word has no stem and is
    taken. One aggregate finds the deepest level, which the words' length bounds.
    """
    marked = rows.withColumns({"__o": order, "__s": cut(F.col(word)), "__d": F.coalesce(depth(F.col(word), longest, cut), F.lit(0))})
    known = known.select(F.col(word).alias("__s")).where("__s is not null").distinct()
    deepest = marked.agg(F.max("__d")).first()[0] or 0
    taken = last = marked.where("__d = 0")
    for d in range(1, deepest + 1):
        first = last.groupBy(F.col(word).alias("__s")).agg(F.min("__o").alias("__first"))
        level = marked.where(F.col("__d") == d).join(known, "__s", "left_anti").join(first, "__s", "left")
        last = level.where(F.col("__first").isNull() | (F.col("__first") > F.col("__o"))).select(*marked.columns)
        taken = taken.unionByName(last)
    return taken.drop("__s", "__d", "__o")


def soft_fill(lexicon: DataFrame, best: DataFrame, fan_in: DataFrame, blocked: DataFrame, most: int = 300_000, late: float = 0.92, longest: int = 16) -> DataFrame:
    """(roman, native, weight) of the pairs to add to ``lexicon(roman, native, weight)``.

    ``best(roman, native, n)`` has one row a roman, ``fan_in(native, fan_in)`` one a native,
    ``blocked(roman)`` names test keys. Words without a postfix come first, by evidence and roman,
    until the lexicon has ``most`` soft entries. Words with one follow if the soft entries have by
    then reached ``late`` of the cap, unless their stem is a native already. At most ``most`` rows
    meet in the task that cuts them off.
    """
    room = most - lexicon.where(is_soft(F.col("weight"))).count()
    fresh = best.where(~F.col("native").rlike("[  ]") & (F.length("native") <= longest))
    fresh = fresh.join(lexicon.select("roman"), "roman", "left_anti").join(blocked.select("roman"), "roman", "left_anti").join(fan_in, "native", "left")
    order = F.struct((-F.greatest("n", F.coalesce("fan_in", F.lit(0)))).cast("long").alias("e"), F.col("roman").alias("r"))
    bare = fresh.where(strip_postfix(F.col("native")).isNull()).orderBy(order).limit(max(0, room))
    added = bare.count()
    out = bare
    if room > added and most - room + added >= int(most * late):
        known = lexicon.select("native").union(bare.select("native"))
        tail = settle(fresh.where(strip_postfix(F.col("native")).isNotNull()), "native", order, known, longest)
        out = bare.unionByName(tail.orderBy(order).limit(room - added))
    return out.select("roman", "native", soft_weight(F.col("n"), F.col("fan_in")).alias("weight"))


def bare_fill(lexicon: DataFrame, best: DataFrame, blocked: DataFrame, most_added: int, most: int = 300_000, longest: int = 16) -> DataFrame:
    """As ``soft_fill``, for words without a postfix only and by count alone, under two caps."""
    room = min(most_added, most - lexicon.where(is_soft(F.col("weight"))).count())
    fresh = best.where(~F.col("native").rlike("[ ]") & (F.length("native") <= longest) & strip_postfix(F.col("native")).isNull())
    fresh = fresh.join(lexicon.select("roman"), "roman", "left_anti").join(blocked.select("roman"), "roman", "left_anti")
    return fresh.orderBy(F.desc("n"), "roman").limit(max(0, room)).select("roman", "native", soft_weight(F.col("n"), F.lit(0)).alias("weight"))


def dictionary_fill(lexicon: DataFrame, pairs: DataFrame, most: int = 40_000, longest: int = 16) -> DataFrame:
    """(roman, native, weight) of dictionary pairs to add: short romans first, no forms of natives.

    ``pairs(roman, native)``; the smallest native of a roman counts.
    """

    def cut(word: Column) -> Column:
        return F.coalesce(*[F.when(word.endswith(p) & (F.length(word) > len(p)), word.substr(F.lit(1), F.length(word) - len(p))) for p in DICTIONARY_POSTFIXES])

    fresh = pairs.groupBy("roman").agg(F.min("native").alias("native")).join(lexicon.select("roman"), "roman", "left_anti")
    fresh = fresh.where(~F.col("native").rlike("[ ]") & (F.length("native") <= longest))
    order = F.struct(F.length("roman").alias("n"), F.col("roman").alias("r"))
    kept = settle(fresh, "native", order, lexicon.select("native"), longest, cut)
    return kept.orderBy(order).limit(most).select("roman", "native", F.lit(80).alias("weight"))


def capped_words(words: DataFrame, most: int = 250_000, longest: int = 30) -> DataFrame:
    """(word): distinct words without forms of words kept, the best ``most`` of them.

    Words of 3 to 14 characters come first, then those without a postfix, then by length and word.
    """
    distinct = words.select("word").where("word is not null").distinct()
    bare = F.when(strip_postfix(F.col("word")).isNull(), 0).otherwise(1)
    size = F.length("word")
    kept = settle(distinct, "word", F.struct(bare.alias("b"), size.alias("n"), F.col("word").alias("w")), distinct.limit(0), longest)
    return kept.orderBy(F.when(size.between(3, 14), 0).otherwise(1), bare, size, "word").limit(most)


def prune_soft(lexicon: DataFrame, longest: int = 16) -> DataFrame:
    """The lexicon without soft phrases, long soft words and soft forms whose stem is a native."""
    natives = lexicon.select(F.col("native").alias("__s")).distinct().withColumn("__known", F.lit(True))
    marked = lexicon.withColumn("__s", strip_postfix(F.col("native"))).join(natives, "__s", "left")
    native = F.col("native")
    bad = native.rlike("[  ]") | (F.length(native) > longest) | F.coalesce(F.col("__known"), F.lit(False))
    return marked.where(~(is_soft(F.col("weight")) & F.coalesce(bad, F.lit(False)))).select(*[F.col(f"`{c}`") for c in lexicon.columns])


def upgrade_soft(lexicon: DataFrame, best: DataFrame, fan_in: DataFrame) -> DataFrame:
    """Raises a soft weight to the band that the counts of the same pair give."""
    seen = best.select("roman", "native", "n").join(fan_in, "native", "left")
    seen = seen.select("roman", "native", soft_weight(F.col("n"), F.col("fan_in")).alias("__w"))
    up = F.when(is_soft(F.col("weight")), F.greatest("weight", F.coalesce("__w", F.lit(0)))).otherwise(F.col("weight"))
    return lexicon.join(seen, ["roman", "native"], "left").select(*[(up.alias(c) if c == "weight" else F.col(f"`{c}`")) for c in lexicon.columns])


def precedence(exceptions: DataFrame, probes: DataFrame, seeds: DataFrame, personal: DataFrame) -> DataFrame:
    """(roman, native, weight) of four tables of (roman, native) and, for the last, weight.

    An exception (1000) wins over a probe (800), a probe over a seed (900, only where neither has
    the roman). A personal entry replaces a probe or seed that weighs less than its own weight, or
    fills a gap, and is stored at 700 at most. Repeats within a table: the smallest native, the
    heaviest personal entry.
    """
    tables = [exceptions.select("roman", "native", F.lit(1000).alias("w")), probes.select("roman", "native", F.lit(800).alias("w")), seeds.select("roman", "native", F.lit(900).alias("w")), personal.select("roman", "native", F.col("weight").cast("int").alias("w"))]
    rows = None
    for rank, t in enumerate(tables):
        part = t.withColumn("rank", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    pick = lambda rank: F.min(F.when(F.col("rank") == rank, F.struct((-F.col("w")).alias("o"), "native", "w")))
    g = rows.where("roman is not null and native is not null").groupBy("roman").agg(*[pick(r).alias(f"t{r}") for r in range(4)])
    base = F.coalesce("t0", "t1", "t2")
    wins = F.col("t0").isNull() & F.col("t3").isNotNull() & (base.isNull() | (F.col("t3.w") > base["w"]))
    return g.select("roman", F.when(wins, F.col("t3.native")).otherwise(base["native"]).alias("native"), F.when(wins, F.least("t3.w", F.lit(700))).otherwise(base["w"]).alias("weight"))
