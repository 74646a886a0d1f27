"""Training rows for models of romanised words: filters, splits, orders, copies, noise and a ranking step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.script import is_roman_word
from tarkash.operators.splits import trainer_family

FEATURES = ("soft", "strong", "stem_derived", "phonetic", "log_uni", "log_weight", "attested", "roman_len_ratio", "transform_cost", "user_count")
SHORTER = (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("sh", "s"))


def exclusions(*benchmarks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family) and (native): what benchmark tables of (roman, native) keep out of training."""
    rows = benchmarks[0].select("roman", "native")
    for more in benchmarks[1:]:
        rows = rows.unionByName(more.select("roman", "native"))
    families = rows.where(F.col("roman").isNotNull()).select(trainer_family(F.col("roman")).alias("family")).distinct()
    return families, rows.where(F.col("native").isNotNull()).select("native").distinct()


def training_pairs(sources: Sequence[DataFrame], families: DataFrame, natives: DataFrame) -> DataFrame:
    """(roman, native, n): well-formed pairs outside the exclusions, by the largest count plus the source's place.

    ``sources`` hold (roman, native, n); a null count is 1. A roman has 1 to 32 letters with single
    separators, a native at most twice as many characters, of the script and its joiners alone.
    """
    rows = None
    for place, df in enumerate(sources):
        part = df.select(F.lower(F.trim("roman")).alias("roman"), F.trim("native").alias("native"), (F.coalesce("n", F.lit(1)) + place).cast("long").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(is_roman_word(F.col("roman")) & F.length("native").between(1, 2 * F.length("roman")) & F.col("native").rlike(r"\A[઀-૿‌‍]+\z"))
    rows = rows.groupBy("roman", "native").agg(F.max("n").alias("n")).withColumn("family", trainer_family(F.col("roman")))
    return rows.join(families, "family", "left_anti").join(natives, "native", "left_anti").select("roman", "native", "n")


def hashed(*parts: Column | str) -> Column:
    """The first 8 hex digits of sha256 of the parts, NUL between them, as a number."""
    text = F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def in_validation(roman: Column, percent: int = 2) -> Column:
    """Whether the roman's family falls into the validation share; all spellings of a family fall together."""
    return hashed(trainer_family(roman)) % 100 < percent


def shuffled(pairs: DataFrame, seed: str, most: int | None = None) -> DataFrame:
    """``pairs(roman, native)`` with ``place`` in a seeded order, the first ``most`` of them if given.

    Ranges of the hash are sorted each for itself; only with ``most`` do that many rows meet.
    """
    keyed = pairs.withColumn("__h", F.sha2(F.concat_ws("\0", F.lit(seed), "roman", "native"), 256))
    if most is None:
        return keyed.orderBy("__h", "roman", "native").drop("__h")
    return keyed.orderBy("__h", "roman", "native").limit(most).drop("__h")


def label_targets(sources: Sequence[DataFrame], families: DataFrame, least: int) -> DataFrame:
    """(roman, native, source) of romans worth labelling, of the first source that has one, by length and roman.

    Romans are letters a-z alone, ``least`` long at least, and of no excluded family; of a source's
    rows of a roman the smallest native counts.
    """
    rows = None
    for place, df in enumerate(sources):
        part = df.select(F.lower(F.trim("roman")).alias("roman"), F.trim("native").alias("native"), "source", F.lit(place).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.col("roman").rlike(r"\A[a-z]+\z") & (F.length("roman") >= least))
    first = rows.groupBy("roman").agg(F.min(F.struct("place", "native", "source")).alias("f"))
    free = first.withColumn("family", trainer_family(F.col("roman"))).join(families, "family", "left_anti")
    return free.select("roman", "f.native", "f.source").orderBy(F.length("roman"), "roman")


def oversampled(pairs: DataFrame, pseudo: DataFrame, short: int = 4, long: int = 8, medium_copies: int = 1, pseudo_copies: int = 2) -> DataFrame:
    """``pairs`` with a row for each copy: three of short romans, more of medium ones without a pseudo-label, and of those with one."""
    size, marked = F.length("roman"), F.col("__pseudo").isNotNull()
    copies = F.when(size <= short, 3).when(marked, 1 + max(0, pseudo_copies - 1)).when(size < long, 1 + max(0, medium_copies)).otherwise(1)
    rows = pairs.join(pseudo.select("roman").distinct().withColumn("__pseudo", F.lit(True)), "roman", "left")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("__pseudo")


def variants(roman: Column) -> Column:
    """The spellings that noise chooses from: the word, w and v exchanged, one pair made short, one h left out."""
    once = lambda a, b: F.when(F.contains(roman, F.lit(a)), F.concat(F.substring_index(roman, a, 1), F.lit(b), F.substring(roman, F.instr(roman, a) + len(a), F.length(roman))))
    swap = lambda a, b: F.when(F.contains(roman, F.lit(a)), F.replace(roman, F.lit(a), F.lit(b)))
    found = [roman, swap("w", "v"), swap("v", "w"), *[once(a, b) for a, b in SHORTER], F.when(F.length(roman) > 3, once("h", ""))]
    return F.array_compact(F.array(*found))


def noisy(roman: Column, seed: str) -> Column:
    """One of the variants, chosen by a hash of seed and word."""
    found = variants(roman)
    return F.get(found, (hashed(seed, roman) % F.size(found)).cast("int"))


def candidate_lists(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, candidates): each key's values in order, each at its first place; a key's list is gathered whole."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(F.struct(*order)).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value])
    return first.groupBy(key).agg(listed.alias("candidates"))


def digit_bucket(roman: Column) -> Column:
    """train, val or test by the sum of the characters' codes modulo ten."""
    total = F.aggregate(F.filter(F.split(roman, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + F.ascii(c)) % 10
    return F.when(total < 8, "train").when(total == 8, "val").otherwise("test")


def sigmoid(x: Column) -> Column:
    return F.when(x >= 20, 1.0).when(x <= -20, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def features(roman: Column, native: Column, weight: Column, unigram: Column, attested: Column, source: Column, cost: Column, user: Column) -> dict[str, Column]:
    """What a ranking model sees of a candidate; nothing in it names the word."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    w = F.coalesce(weight.cast("double"), F.lit(0.0))
    found = [
        flag((w > 0) & (w < 100)),
        flag(w >= 100),
        flag(source.isin("stem_matra", "stem_postfix", "stem_inflection", "stem_derived")),
        flag(source.isNull() | (source == "phonetic")),
        F.log1p(F.coalesce(unigram, F.lit(0)).cast("double")),
        F.log1p(F.greatest(w, F.lit(0.0))),
        flag(attested),
        F.length(native) / F.greatest(F.length(roman), F.lit(1)),
        F.coalesce(cost.cast("double"), F.lit(0.0)),
        F.coalesce(user.cast("double"), F.lit(0.0)),
    ]
    return dict(zip(FEATURES, found, strict=True))


def dot(weights: dict[str, float], bias: float = 0.0) -> Column:
    """The linear score of feature columns."""
    out = F.lit(float(bias))
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name), F.lit(0.0)) * float(w)
    return out


def gradients(candidates: DataFrame, weights: dict[str, float], bias: float = 0.0) -> DataFrame:
    """One row: the pairs of gold and other candidates, and for each feature the pairwise logistic gradient.

    ``candidates(roman, gold boolean, features...)``. A roman's first gold row meets its others in a
    join on the roman, so the pairs are no more than the candidates.
    """
    rows = candidates.withColumn("__s", dot(weights, bias))
    gold = rows.where("gold").groupBy("roman").agg(F.min(F.struct("__s", *FEATURES)).alias("g"))
    pull = sigmoid(F.col("g.__s") - F.col("__s")) - 1.0
    sums = [F.coalesce(F.sum(pull * (F.col(f"g.{f}") - F.col(f))), F.lit(0.0)).alias(f) for f in FEATURES]
    return rows.where("not gold").join(gold, "roman").agg(F.count("*").alias("pairs"), *sums)


def step(weights: dict[str, float], sums: dict[str, float], rate: float = 0.08) -> dict[str, float]:
    """The weights after one step against the gradients; no pairs change nothing."""
    n = sums["pairs"]
    return {f: weights.get(f, 0.0) - (rate / n * sums[f] if n else 0.0) for f in FEATURES}


def top_short(lexicon: DataFrame, longest: int = 3, most: int = 500) -> DataFrame:
    """The heaviest entries of short romans; equal weights in a stable hash order."""
    rows = lexicon.where(F.length("roman").between(1, longest) & F.col("native").isNotNull() & (F.col("native") != ""))
    return rows.orderBy(F.desc(F.coalesce("weight", F.lit(0))), F.sha2(F.concat_ws("\0", F.lit("short"), "roman", "native"), 256)).limit(most)


def probe_words(sources: Sequence[DataFrame], most: int = 20_000) -> DataFrame:
    """(roman): the union of word lists, the shortest first, then by word, cut at the cap."""
    rows = sources[0].select("roman")
    for more in sources[1:]:
        rows = rows.union(more.select("roman"))
    return rows.where("roman <> ''").distinct().orderBy(F.length("roman"), "roman").limit(most)


def expanded_gold(fixtures: DataFrame, lexicon: DataFrame, seed: str, strong: int = 100, most: int = 300) -> DataFrame:
    """(roman, native): the fixtures, then strong romans of 3 to 12 letters in a seeded order, one native a roman, up to ``most``."""
    order = F.when(F.col("fixed"), F.lit("")).otherwise(F.sha2(F.concat_ws("\0", F.lit(seed), "roman"), 256))
    fixed = fixtures.select("roman", "native").withColumn("fixed", F.lit(True))
    more = lexicon.where((F.col("weight") >= strong) & F.length("roman").between(3, 12)).select("roman", "native").withColumn("fixed", F.lit(False))
    first = fixed.unionByName(more).groupBy("roman").agg(F.min(F.struct((~F.col("fixed")).alias("o"), "native", "fixed")).alias("f"))
    return first.select("roman", "f.native", "f.fixed").orderBy(F.desc("fixed"), order, "roman").limit(most).select("roman", "native")


def universe(lexicon: DataFrame, unigrams: DataFrame, stems: DataFrame, attested: DataFrame) -> DataFrame:
    """(native, unigram, stem, attested) of every native of any table, zero and false where it is missing."""
    parts = [
        lexicon.select("native"),
        unigrams.select("native", F.col("n").alias("unigram")),
        stems.select("native", F.col("n").alias("stem")),
        attested.select("native", F.lit(True).alias("attested")),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    g = rows.where(F.col("native").isNotNull()).groupBy("native")
    return g.agg(F.coalesce(F.max("unigram"), F.lit(0)).cast("long").alias("unigram"), F.coalesce(F.max("stem"), F.lit(0)).cast("long").alias("stem"), F.coalesce(F.max("attested"), F.lit(False)).alias("attested"))


def source_statistics(merged: DataFrame, wide: Sequence[str]) -> DataFrame:
    """(name, words): the union, the words of wide sources alone, and each source's words; of ``merged(word, sources)``."""
    only = F.size(F.array_except("sources", F.array(*[F.lit(x) for x in wide]))) == 0
    whole = merged.agg(F.count("*").alias("union"), F.count_if(only).alias("wide_only"))
    rows = whole.select(F.explode(F.map_from_arrays(F.array(F.lit("union"), F.lit("wide_only")), F.array("union", "wide_only"))).alias("name", "words"))
    return rows.unionByName(merged.select(F.explode("sources").alias("name")).groupBy("name").agg(F.count("*").alias("words")))
