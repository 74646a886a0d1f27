"""Candidates of typed words from a lexicon: hits, stems with endings, compounds, completions, emoji.

Every generator takes ``typed(typed)``, distinct lower-case words, and a lexicon of (roman, native,
weight), one row a roman, and gives ``COLUMNS``. Lookups are equality joins on exploded keys; which
side is broadcast is left to the planner, which knows the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarkash.functions.script import canonical, closeness, ends_bare
from tarkash.functions.spellings import alternates, queries
from tarkash.functions.transliterate import phonetic_forms
from tarkash.operators.menu import DICT, EMOJI, EXACT, LATIN, PHONETIC, PREFIX

COLUMNS = ("typed", "native", "key", "source", "weight", "cost", "tier")
STRONG = 100

# Vowel signs, postpositions and inflections by their roman spelling.
SIGNS = (("aa", "ા"), ("ii", "ી"), ("ee", "ી"), ("uu", "ૂ"), ("oo", "ૂ"), ("ai", "ૈ"), ("au", "ૌ"), ("i", "િ"), ("u", "ુ"), ("e", "ે"), ("o", "ો"))
POSTPOSITIONS = (
    ("omaanthi", "ઓમાંથી"), ("omaa", "ઓમાં"), ("one", "ઓને"), ("oni", "ઓની"), ("ona", "ઓના"), ("ono", "ઓનો"), ("onu", "ઓનું"),
    ("omathi", "ઓમાંથી"), ("omaan", "ઓમાં"), ("maanthi", "માંથી"), ("manthi", "માંથી"),
    ("mathi", "માંથી"), ("maan", "માં"), ("maa", "માં"), ("man", "માં"), ("ma", "માં"), ("onaa", "ોનાં"), ("ona", "ોના"), ("oni", "ોની"),
    ("one", "ોને"), ("valun", "વાળું"), ("vali", "વાળી"), ("vala", "વાળા"), ("valo", "વાળો"), ("walun", "વાળું"), ("wali", "વાળી"),
    ("wala", "વાળા"), ("walo", "વાળો"), ("thi", "થી"), ("nee", "ની"), ("nii", "ની"), ("noo", "નું"), ("nuu", "નું"), ("naa", "નાં"),
    ("naa", "ના"), ("ni", "ની"), ("nu", "નું"), ("na", "ના"), ("no", "નો"), ("ne", "ને"), ("aatmak", "ાત્મક"), ("tama", "તામાં"),
    ("pane", "પણે"), ("o", "ઓ"), ("s", "્સ"),
)
INFLECTIONS = (
    ("ishun", "ીશું"), ("ishu", "ીશું"), ("she", "શે"), ("sho", "શો"), ("shun", "શું"), ("vun", "વું"), ("vanu", "વાનું"), ("vani", "વાની"),
    ("vana", "વાના"), ("ta", "તા"), ("ti", "તી"), ("tun", "તું"),
)


def is_soft(weight: Column) -> Column:
    return (weight > 0) & (weight < STRONG)


def tier(source: Column, weight: Column, typed: Column, known: Column) -> Column:
    """EXACT for a strong strict hit, and for a near-exact one if the typed word is not in the lexicon; else DICT.

    A single letter with a twin of another place of articulation is never exact.
    """
    twin = typed.rlike(r"\A[nNtTdDlL]\z")
    exact = (source == "strict") | ((source == "near_exact") & ~known)
    return F.when(~twin & ~is_soft(weight) & exact, EXACT).otherwise(DICT)


def _out(rows: DataFrame) -> DataFrame:
    return rows.select("typed", canonical(F.col("native")).alias("native"), "key", "source", F.col("weight").cast("double").alias("weight"), F.col("cost").cast("double").alias("cost"), F.col("tier").cast("int").alias("tier"))


def exceptions(typed: DataFrame, table: DataFrame) -> DataFrame:
    """The native that ``table(roman, native)`` fixes for a typed word."""
    rows = typed.join(table.select(F.col("roman").alias("typed"), "native"), "typed")
    return _out(rows.select("*", F.col("typed").alias("key"), F.lit("strict").alias("source"), F.lit(0).alias("weight"), F.lit(0).alias("cost"), F.lit(EXACT).alias("tier")))


def hits(typed: DataFrame, lexicon: DataFrame, respell: bool = True) -> DataFrame:
    """Lexicon entries of the typed word and, with ``respell``, of its other spellings, at the lattice's cost or 2."""
    if respell:
        q = typed.select("typed", F.explode(queries(F.col("typed"))).alias("q")).select("typed", F.col("q.roman").alias("key"), F.col("q.cost").alias("c"))
    else:
        q = typed.select("typed", F.col("typed").alias("key"), F.lit(0.0).alias("c"))
    rows = q.join(lexicon.withColumnRenamed("roman", "key"), "key")
    strict = F.col("key") == F.col("typed")
    source = F.when(strict, "strict").otherwise("fuzzy")
    cost = F.when(strict, 0.0).otherwise(F.coalesce("c", F.lit(2.0)))
    return _out(rows.select("typed", "native", "key", source.alias("source"), "weight", cost.alias("cost"), tier(source, F.col("weight"), F.col("typed"), F.lit(True)).alias("tier")))


def _cuts(typed: DataFrame, rules: Sequence[tuple[str, str]], least: int) -> DataFrame:
    """(typed, stem, suffix, end): splits before each rule's suffix that leave ``least`` letters."""
    t = F.col("typed")
    table = [F.when(t.endswith(a) & (F.length(t) >= len(a) + least), F.struct(F.lit(a).alias("suffix"), F.lit(b).alias("end"), F.lit(i).alias("place"))) for i, (a, b) in enumerate(dict.fromkeys(rules))]
    rows = typed.select("typed", F.explode(F.array_compact(F.array(*table))).alias("r")).select("typed", "r.*")
    return rows.withColumn("stem", F.expr("substring(typed, 1, length(typed) - length(suffix))"))


def find_stems(stems: DataFrame, lexicon: DataFrame, respell: bool = True) -> DataFrame:
    """(stem, roman, native, weight): the stem's entry, else, with ``respell``, its heaviest other spelling's.

    Ties go to the earlier spelling. Only distinct stems without an entry are respelled.
    """
    stems = stems.select("stem").distinct()
    exact = stems.join(lexicon.withColumnRenamed("roman", "stem"), "stem").select("stem", F.col("stem").alias("roman"), "native", "weight")
    if not respell:
        return exact
    rest = stems.join(lexicon.select(F.col("roman").alias("stem")), "stem", "left_anti")
    other = rest.select("stem", F.posexplode(alternates(F.col("stem"))).alias("at", "roman")).join(lexicon, "roman")
    best = other.groupBy("stem").agg(F.min(F.struct((-F.col("weight")).alias("o"), "at", "roman", "native", "weight")).alias("b"))
    return exact.unionByName(best.select("stem", "b.roman", "b.native", "b.weight"))


def sign_stems(typed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """A known stem that ends in a bare consonant, and a vowel sign."""
    cuts = _cuts(typed.where(F.length("typed") >= 3), SIGNS, 2).where(~F.col("stem").rlike(r"[aeiou]\z"))
    rows = cuts.join(lexicon.withColumnRenamed("roman", "stem"), "stem").where(ends_bare(F.col("native")))
    rows = rows.select("typed", F.concat("native", "end").alias("native"), F.concat("stem", "suffix").alias("key"), F.lit("stem_matra").alias("source"), F.greatest("weight", F.lit(100)).alias("weight"), F.lit(0).alias("cost"), F.lit(DICT).alias("tier"))
    return _out(rows)


def postposition_stems(typed: DataFrame, lexicon: DataFrame, attested: DataFrame, most: int = 8, respell: bool = True) -> DataFrame:
    """A stem and a postposition, the longest that gives a word; ``attested(native)`` lists sure natives.

    A stem that ends in a vowel needs five letters, and a strong weight or attestation.
    """
    cuts = _cuts(typed.where(F.length("typed") >= 4), POSTPOSITIONS, 3)
    cuts = cuts.where((F.col("suffix") != "o") | (F.length("stem") >= 5))
    rows = cuts.join(find_stems(cuts, lexicon, respell), "stem").join(attested.select("native").distinct().withColumn("sure", F.lit(True)), "native", "left")
    vowel = F.col("stem").rlike(r"(?:e|i|o|u|aa|ii|ee|uu|oo|ai|au)\z")
    sure = (F.length("stem") >= 5) & ((F.col("weight") >= STRONG) | F.coalesce("sure", F.lit(False)))
    native = F.col("native")
    rows = rows.where((~vowel | sure) & (ends_bare(native) | native.rlike(r"[ાીુૂેૈોૌં]\z")))
    end = F.when(ends_bare(native) & F.col("end").startswith("ઓ"), F.concat(F.lit("ો"), F.expr("substring(end, 2)"))).otherwise(F.col("end"))
    rows = rows.select("typed", "place", F.concat(native, end).alias("native"), F.length("suffix").alias("size"), F.concat("roman", "suffix").alias("key"), F.greatest("weight", F.lit(120)).alias("weight"))
    rows = rows.withColumn("longest", F.max("size").over(Window.partitionBy("typed"))).where("size = longest")
    rows = rows.groupBy("typed", "native").agg(F.min(F.struct("place", "key", "weight")).alias("b")).select("typed", "native", "b.*")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("typed").orderBy("place", "native"))).where(F.col("r") <= most)
    return _out(rows.select("*", F.lit("stem_postfix").alias("source"), F.lit(0).alias("cost"), F.lit(DICT).alias("tier")))


def inflected_stems(typed: DataFrame, lexicon: DataFrame, respell: bool = True) -> DataFrame:
    """A stem, or the stem and a, with an inflection."""
    cuts = _cuts(typed, INFLECTIONS, 2)
    cuts = cuts.select("typed", "suffix", "end", "place", F.posexplode(F.array("stem", F.concat("stem", F.lit("a")))).alias("k", "stem"))
    rows = cuts.join(find_stems(cuts, lexicon, respell), "stem").withColumn("native", F.concat("native", "end"))
    rows = rows.groupBy("typed", "native").agg(F.min(F.struct("place", "k", F.concat("roman", "suffix").alias("key"), F.greatest("weight", F.lit(120)).alias("weight"))).alias("b"))
    return _out(rows.select("typed", "native", "b.key", "b.weight", F.lit("stem_inflection").alias("source"), F.lit(1).alias("cost"), F.lit(DICT).alias("tier")))


def compounds(typed: DataFrame, lexicon: DataFrame, sure: DataFrame, least: int = 8, part: int = 3, most: int = 8) -> DataFrame:
    """Two or three known parts; a part is strong or in ``sure(native, evidence, attested)``.

    The best by evidence, weight and fewer parts stay; ties go to the smaller native.
    """
    parts = lexicon.join(sure.select("native", "evidence", "attested"), "native", "left")
    parts = parts.where((F.col("weight") >= STRONG) | F.coalesce("attested", F.lit(False))).where(F.length("roman") >= part)
    parts = parts.select("roman", F.col("native").alias("w"), "weight", F.log1p(F.coalesce("evidence", F.lit(0))).alias("e"))
    rest = typed.where(F.length("typed") >= max(least, 2 * part)).select("typed", F.lit("").alias("native"), F.lit(None).cast("double").alias("weight"), F.lit(0.0).alias("e"), F.lit(0).alias("n"), F.col("typed").alias("left"))
    done = None
    for n in range(1, 4):
        cut = F.explode(F.sequence(F.lit(part), F.length("left"))).alias("k")
        step = rest.where(F.length("left") >= part).select("*", cut).withColumn("roman", F.expr("substring(left, 1, k)"))
        step = step.join(parts.select("roman", "w", F.col("weight").alias("pw"), F.col("e").alias("pe")), "roman")
        rest = step.select("typed", F.concat("native", "w").alias("native"), F.least("weight", "pw").alias("weight"), (F.col("e") + F.col("pe")).alias("e"), F.lit(n).alias("n"), F.expr("substring(left, k + 1)").alias("left"))
        full = rest.where((F.col("left") == "") & (F.col("n") > 1))
        done = full if done is None else done.unionByName(full)
    best = done.groupBy("typed", "native").agg(F.min(F.struct((-F.col("e")).alias("o"), (-F.col("weight")).alias("p"), "n", "weight")).alias("b"))
    order = Window.partitionBy("typed").orderBy("b.o", "b.p", "b.n", "native")
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    weight, cost = F.greatest("b.weight", F.lit(100)), F.greatest(F.lit(1), F.col("b.n") - 1)
    return _out(best.select("typed", "native", F.col("typed").alias("key"), F.lit("stem_compound").alias("source"), weight.alias("weight"), cost.alias("cost"), F.lit(DICT).alias("tier")))


def near_exact(typed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Entries that are an unknown typed word of four letters or more and a weak ending.

    The few endings are appended and looked up, so no range of the lexicon is searched.
    """
    fresh = typed.where(F.length("typed") >= 4).join(lexicon.select(F.col("roman").alias("typed")), "typed", "left_anti")
    ends = F.explode(F.array(*[F.lit(x) for x in ("n", "m", "ng", "un", "um", "h")])).alias("suffix")
    keys = fresh.select("typed", ends).withColumn("key", F.concat("typed", "suffix"))
    keys = keys.where(~(F.col("suffix").isin("n", "m") & F.col("key").rlike(r"(?:an|en|ian|ing|ers?|ors?|ly)\z")))
    rows = keys.join(lexicon.withColumnRenamed("roman", "key"), "key")
    source = F.lit("near_exact")
    return _out(rows.select("typed", "native", "key", source.alias("source"), "weight", (1.5 * F.length("suffix")).alias("cost"), tier(source, F.col("weight"), F.col("typed"), F.lit(False)).alias("tier")))


def _unseen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
    return rows if seen is None else rows.join(seen.select("typed", "native").distinct(), ["typed", "native"], "left_anti")


def completions(typed: DataFrame, index: DataFrame, most: int = 3, seen: DataFrame | None = None, respell: bool = False) -> DataFrame:
    """The heaviest longer entries of ``index(prefix, roman, native, weight)`` at the typed word.

    With ``respell`` its other spellings are looked up too. Natives in ``seen(typed, native)`` are left out.
    """
    seeds = typed.where(F.length("typed") >= 2)
    if respell:
        seeds = seeds.select("typed", F.explode(queries(F.col("typed"))["roman"]).alias("prefix")).where(F.length("prefix") >= 2)
    else:
        seeds = seeds.select("typed", F.col("typed").alias("prefix"))
    rows = _unseen(seeds.join(index, "prefix").where("roman <> typed"), seen)
    rows = rows.groupBy("typed", "native").agg(F.min(F.struct((-F.col("weight")).alias("o"), "roman", "weight")).alias("b"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("typed").orderBy("b.o", "b.roman", "native"))).where(F.col("r") <= most)
    return _out(rows.select("typed", "native", F.col("b.roman").alias("key"), F.lit("lexicon").alias("source"), "b.weight", F.lit(0).alias("cost"), F.lit(PREFIX).alias("tier")))


def script_forms(typed: DataFrame) -> DataFrame:
    """(typed, native, at): script forms of the typed word, of a lone letter's twin of another place, and of the other spellings, in that order."""
    twin = F.when(F.col("typed").rlike(r"\A[ntdl]\z"), F.upper("typed")).when(F.col("typed").rlike(r"\A[NTDL]\z"), F.lower("typed"))
    others = F.filter(alternates(F.col("typed")), lambda x: F.lower(x) != F.lower(F.col("typed")))
    keys = F.array_compact(F.concat(F.array("typed", twin), others))
    forms = typed.select("typed", F.posexplode(keys).alias("a", "form")).select("typed", "a", F.posexplode(phonetic_forms(F.col("form"))).alias("b", "native"))
    return forms.groupBy("typed", "native").agg(F.min(F.struct("a", "b")).alias("at")).where("native <> typed")


def phonetic(typed: DataFrame, known: DataFrame, most: int = 4, seen: DataFrame | None = None, floor: int = 50, forms: DataFrame | None = None) -> DataFrame:
    """Script forms of the typed word and its spellings, attested words first.

    ``known`` is ``validity`` of the forms; a form it lacks counts as invented. The order is unigram
    at all, spell_ok, attested, unigram, score, then that of the forms. ``seen`` are the candidates
    found before: their natives are left out. Beside an exact one of them a form must be known, and
    attested or spelled right if that one is strict, or all are weak; beside a strong strict one two
    forms are taken at most. After two forms with a unigram over ``floor`` only such forms follow.
    """
    rows = _unseen(script_forms(typed) if forms is None else forms, seen)
    rows = rows.join(known.select("native", "score", "unigram", "attested", "spell_ok", *[c for c in ("present",) if c in known.columns]), "native", "left")
    rows = rows.na.fill({"score": 0.0, "unigram": 0, "attested": False, "spell_ok": False, "present": False})
    cap = F.lit(most)
    if seen is not None:
        strict, soft = F.col("source") == "strict", F.col("weight") < STRONG
        exact = seen.where(F.col("tier") == EXACT).groupBy("typed").agg(F.max(strict).alias("strict"), F.min(soft).alias("soft"), F.max(strict & ~soft).alias("strong"))
        rows = rows.join(exact, "typed", "left")
        some, sure = F.col("strict").isNotNull(), F.col("attested") | F.col("spell_ok")
        present = F.col("present") if "present" in rows.columns else sure
        rows = rows.where(~some | present | ((F.col("strict") | F.col("soft")) & sure))
        cap = F.when(F.coalesce("strong", F.lit(False)), F.least(cap, F.lit(2))).otherwise(cap)
    order = Window.partitionBy("typed").orderBy(F.desc(F.col("unigram") > 0), F.desc("spell_ok"), F.desc("attested"), F.desc("unigram"), F.desc("score"), "at")
    backed = F.col("unigram") > floor
    before = F.coalesce(F.sum(backed.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("skip", ~backed & (before >= 2)).where("not skip")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap)
    level = F.when(F.col("attested"), DICT).otherwise(PHONETIC)
    return _out(rows.select("typed", "native", F.col("typed").alias("key"), F.lit("phonetic").alias("source"), F.lit(0).alias("weight"), F.lit(0).alias("cost"), level.alias("tier")))


def modelled(model: DataFrame, known: DataFrame) -> DataFrame:
    """The words that ``model(typed, native, log_prob)`` scored, weighed by their evidence."""
    rows = model.select("typed", "native").join(known.select("native", "evidence", "attested"), "native", "left")
    level = F.when(F.coalesce("attested", F.lit(False)), DICT).otherwise(PHONETIC)
    return _out(rows.select("typed", "native", F.col("typed").alias("key"), F.lit("neural").alias("source"), F.coalesce("evidence", F.lit(0)).alias("weight"), F.lit(0).alias("cost"), level.alias("tier")))


def sure_emoji(typed: DataFrame, menu: DataFrame, by_code: DataFrame, by_native: DataFrame, most: int = 2) -> DataFrame:
    """(typed, emoji, confidence, weight): the surest of the typed word and of its natives."""
    own = typed.join(by_code.withColumnRenamed("code", "typed"), "typed").select("typed", "emoji", "weight", "confidence")
    via = menu.select("typed", "native").distinct().join(by_native, "native").select("typed", "emoji", "weight", "confidence")
    best = own.unionByName(via).groupBy("typed", "emoji").agg(F.max(F.struct("confidence", "weight")).alias("b"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("b.confidence"), F.desc("b.weight"), "emoji"))).where(F.col("r") <= most)
    return best.select("typed", "emoji", "b.confidence", "b.weight")


def emoji(typed: DataFrame, menu: DataFrame, by_code: DataFrame, by_native: DataFrame, most: int = 2) -> DataFrame:
    """The surest emoji of the typed word, ``by_code(code, emoji, weight, confidence)``, and of its natives."""
    best = sure_emoji(typed, menu, by_code, by_native, most)
    return _out(best.select("typed", F.col("emoji").alias("native"), F.col("typed").alias("key"), F.lit("emoji").alias("source"), "weight", F.lit(0).alias("cost"), F.lit(EMOJI).alias("tier")))


def latin(typed: DataFrame) -> DataFrame:
    return _out(typed.select("typed", F.col("typed").alias("native"), F.col("typed").alias("key"), F.lit("latin").alias("source"), F.lit(0).alias("weight"), F.lit(0).alias("cost"), F.lit(LATIN).alias("tier")))


def placed(generated: Sequence[DataFrame], first: int = 0) -> DataFrame:
    """The rows of generators with ``place``, the generator's number from ``first`` on."""
    rows = None
    for place, df in enumerate(generated, first):
        part = df.select(*COLUMNS, F.lit(place).alias("place"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def merge(*generated: DataFrame) -> DataFrame:
    """``merged`` of generators, the one named first before the others."""
    return merged(placed(generated))


def merged(rows: DataFrame) -> DataFrame:
    """One row a typed word and native of ``placed`` rows: of the best tier, then of the first generator.

    An equal tier changes nothing but ``provenance``, the sources of all rows. A better tier takes
    over source and key, keeps the first cost, and the larger weight and closeness count.
    """
    rows = rows.withColumn("closeness", closeness(F.col("typed"), F.col("key")))
    order = F.struct("place", F.when(F.col("source") == "strict", 0).otherwise(1), -F.col("weight"), F.length("key"), "cost", "key")
    first = F.min(F.struct(order.alias("o"), "cost")).alias("first")
    best = F.min(F.struct("tier", order.alias("o"), "source", "key")).alias("best")
    g = rows.groupBy("typed", "native").agg(first, best, F.max("weight").alias("weight"), F.max("closeness").alias("closeness"), F.array_sort(F.collect_set("source")).alias("provenance"))
    return g.select("typed", "native", "best.key", "best.source", "weight", "first.cost", "best.tier", "closeness", "provenance", F.col("first.o").alias("index"))
