"""Queries on word tests and on filling, pruning and merging lexicons, each with its SQL.

Natives of the filling queries are consonants alone, so an ending of ``POSTFIXES`` is always one that
was put on, and a stem never has another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.functions import script
from tarkash.operators import insertion, labels, scoring, splits
from tarkash.plans.evaluation import C, W
from tarkash.plans.lexicon import token_unigrams
from tarkash.plans.menus import BARE, LATIN, SCRIPT, _canonical, _stripped, listed, values, word_counts

ODD = (
    "", "a", "Ab", "o'brien", "o''x", "-a", "a-b+c", "x.com", "me@x", "http://a", "12", "1.5", ".5", "3.", "v1.2", "ઘર", "ઘરમાં", "ઘરની", "ક્ષ", "કિી", "ક્", "અા", "ૐ", "હું", "શ્રદ્ધા", "પડી",
    "યસ", "કઇ", "કાઇ", "ઘર કામ", "smile_face", "heart-eyes", "(abc) def", "#x", "ક઼", "é", "é", "ABCab" * 8, "કખગ" * 8, "ાક", "ક્્ક", "કાા", "ીકીલી",
)
VOWELS = "aeiou"
ENDS = ("", "માં", "ની", "")
MOST, LATE = 700, 0.0


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(x,) for x in ODD], "w string")
    own = word_counts(spark, sf_dir).select(F.explode(F.array("word", F.translate("word", LATIN, SCRIPT))).alias("w"))
    return odd.union(own).distinct()


def word_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    tests = {
        "gujarati": script.is_gujarati(w), "roman": script.is_roman(w), "roman_word": script.is_roman_word(w), "gujarati_word": script.is_gujarati_word(w), "quality": script.is_quality(w),
        "number": script.is_number(w), "literal": script.is_latin_literal(w), "bare": script.ends_bare(w), "code": script.is_emoji_code(w), "token": script.clean_wiki_token(w), "nfc": script.nfc(w),
        "canonical": script.canonical(w), "learning_key": script.learning_key(w), "family": splits.trainer_family(w), "stem": script.strip_postfix(w), "penalty": script.orthography_penalty(w),
        "codes": F.array_join(script.emoji_codes(w), ","), "variants": F.array_join(script.matra_variants(w), ","), "consonants": script.skeleton(w),
    }
    return _words(spark, sf_dir).select("w", *[c.alias(k) for k, c in tests.items()])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    keys = [w, F.concat(w, F.lit("a")), F.substring(w, 1, 3), F.reverse(w), *[F.replace(w, F.lit(a), F.lit(b)) for a, b in (("a", "aa"), ("i", "ii"), ("o", "oo"), ("w", "v"), ("t", "th"), ("c", "ch"), ("th", "t"), ("h", ""))]]
    return word_counts(spark, sf_dir).select(w.alias("a"), F.explode(F.array(*keys)).alias("b")).select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(F.col("p.a").alias("typed"), F.col("p.b").alias("key")).distinct()


def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("typed"), F.col("key")
    return _pairs(spark, sf_dir).select(
        "typed", "key", script.closeness(t, k).alias("closeness"), script.extends(t, k).alias("extends"), scoring.digraph_strip(t, k).alias("strip"), scoring.vowel_lengthened(t, k).alias("lengthened"),
        F.round(script.unigram_score(F.length(t), F.length(k)), 6).alias("share"), F.round(script.user_boost(F.length(k)), 6).alias("boost"),
    )


def _plain(word: Column) -> Column:
    rest = [(a, b) for a, b in zip(LATIN, SCRIPT, strict=True) if a not in VOWELS]
    return F.translate(word, "".join(a for a, _ in rest) + VOWELS, "".join(b for _, b in rest))


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).where(F.length("word").between(3, 4)).withColumn("plain", _plain(F.col("word")))
    end = F.get(F.array(*[F.lit(e) for e in ENDS]), (F.col("n") % 4).cast("int"))
    return rows.where("plain <> ''").select(F.col("word").alias("roman"), F.concat("plain", end).alias("native"), "plain", "n")


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("n") % 2 == 0, 80).otherwise(120)
    return _base(spark, sf_dir).where("n % 3 = 0").select("roman", F.col("plain").alias("native"), weight.alias("weight"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir).where("n % 3 <> 0").select("roman", "native", "n")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    best = _best(spark, sf_dir)
    return _lexicon(spark, sf_dir), best, best.groupBy("native").agg(F.count("*").alias("fan_in")), best.where("n % 11 = 0").select("roman")


def soft_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insertion.soft_fill(*_tables(spark, sf_dir), most=MOST, late=LATE)


def bare_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, best, _, blocked = _tables(spark, sf_dir)
    return insertion.bare_fill(lexicon, best, blocked, 150, MOST)


def dictionary_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, best, _, _ = _tables(spark, sf_dir)
    return insertion.dictionary_fill(lexicon, best, 300)


def capped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insertion.capped_words(_base(spark, sf_dir).select(F.col("native").alias("word")), 200)


def upgraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon, best, fan_in, _ = _tables(spark, sf_dir)
    mixed = lexicon.unionByName(best.where("n % 5 = 0").select("roman", "native", F.lit(75).alias("weight")))
    return insertion.upgrade_soft(insertion.prune_soft(mixed), best, fan_in)


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir).withColumn("weight", F.when(F.col("n") % 2 == 0, 80).otherwise(120))
    native = F.when(F.col("n") % 7 == 0, F.concat("native", F.lit(" "), "native")).when(F.col("n") % 13 == 0, F.repeat(F.col("native"), 9)).otherwise(F.col("native"))
    rows = rows.select("roman", native.alias("native"), "weight", (F.col("n") % 14 == 0).alias("allowed"))
    known = rows.select(F.col("native").alias("stem")).distinct().withColumn("known", F.lit(True))
    rows = rows.withColumn("stem", script.strip_postfix(F.col("native"))).join(known, "stem", "left")
    return rows.select("roman", F.coalesce(script.quality_reason(F.col("native"), F.col("weight"), F.col("allowed"), F.col("known")), F.lit("kept")).alias("reason"))


def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir)
    part = lambda k, end: rows.where(F.col("n") % k == 0).select("roman", F.concat("plain", F.lit(end)).alias("native"), (F.col("n") * 7 % 1100).cast("int").alias("weight"))
    return insertion.precedence(part(7, "ક"), part(3, "ખ"), part(2, "ગ"), part(5, "ઘ"))


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = token_unigrams(spark, sf_dir).withColumn("native", F.translate("word", LATIN, SCRIPT))
    two = F.array(F.struct(F.col("native"), (-(n % 5)).cast("double").alias("log_prob")), F.struct(F.concat("native", F.lit("ક")).alias("native"), (-(n % 7) - 5).cast("double").alias("log_prob")))
    model = rows.select(F.col("word").alias("roman"), F.when(n % 9 == 0, F.slice(two, 1, 1)).when(n % 10 == 0, F.slice(two, 1, 0)).otherwise(two).alias("candidates"))
    gold = rows.where("n % 2 = 0").select(F.col("word").alias("roman"), F.when(n % 4 == 0, F.col("native")).otherwise(F.concat("native", F.lit("ખ"))).alias("native"))
    return labels.merge_labels(model, gold, 4.0, 4)


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_labels(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("words"))


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base(spark, sf_dir)
    counted = rows.where("n % 3 = 0").groupBy(F.col("plain").alias("word")).agg(F.max("n").alias("n"))
    return labels.boost(counted, rows.where("n % 3 <> 0").select(F.col("native").alias("word")))


def stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = token_unigrams(spark, sf_dir).where("n >= 5").select(F.col("word").alias("roman"))
    return labels.stress(keys, 400).select("roman", "place.t", "place.k")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_unigrams(spark, sf_dir).where("length(word) >= 2 and n >= 2").withColumn("key", F.substring("word", 1, 2))
    sums = rows.groupBy("key", F.length("word").alias("size")).agg(F.sum("n").alias("total"))
    return labels.lead_over_next(sums.groupBy("key", "total").agg(F.min("size").alias("size")), "key", "total").select("key", "size", "total", "lead")


QUERIES = {
    "q28_word_tests": word_tests,
    "q29_pair_tests": pair_tests,
    "q30_quality_reasons": quality_reasons,
    "q31_soft_fill": soft_fill,
    "q32_bare_fill": bare_fill,
    "q33_dictionary_fill": dictionary_fill,
    "q34_capped_words": capped_words,
    "q35_pruned_and_upgraded": upgraded,
    "q36_precedence": precedence,
    "q37_merged_labels": merged_labels,
    "q38_label_counts": label_counts,
    "q39_boosted": boosted,
    "q62_stress": stress,
    "q63_leads": leads,
}

BLOCK = r"[\x{0A80}-\x{0AFF}]"
WORD = script.WORD.removeprefix(r"\A").removesuffix(r"\z")
SIGN = script.MATRA
POSTFIX = "coalesce(" + ", ".join(f"CASE WHEN ends_with({{x}}, '{p}') AND length({{x}}) > {len(p) + 1} THEN substr({{x}}, 1, length({{x}}) - {len(p)}) END" for p in script.POSTFIXES) + ")"
FIRST = "regexp_replace(string_split(regexp_split_to_array(string_split(trim(w), chr(9))[1], '\\s+')[1], chr(0))[1], '\\s*\\([^)]*\\)\\s*', '', 'g')"
TOKEN = f"trim(trim({FIRST}), '.,;:!?\"''`|/\\')"
SQUEEZED = "regexp_replace({x}, '[^a-z0-9'']', '', 'g')"
CODE = "regexp_full_match({x}, '[a-z][a-z0-9''-]{{0,31}}')"
PLAIN = "translate(word, '" + "".join(a for a in LATIN if a not in VOWELS) + VOWELS + "', '" + "".join(b for a, b in zip(LATIN, SCRIPT, strict=True) if a not in VOWELS) + "')"
B = f"{C}, b AS MATERIALIZED (SELECT word AS roman, plain || {listed(ENDS)}[n % 4 + 1] AS native, plain, n FROM (SELECT *, {PLAIN} AS plain FROM c WHERE length(word) BETWEEN 3 AND 4) WHERE plain <> '')"
L = f"""{B}, lex AS MATERIALIZED (SELECT roman, plain AS native, CASE WHEN n % 2 = 0 THEN 80 ELSE 120 END AS weight FROM b WHERE n % 3 = 0),
best AS MATERIALIZED (SELECT roman, native, n FROM b WHERE n % 3 <> 0), fan AS (SELECT native, count(*) AS fan_in FROM best GROUP BY native), blocked AS (SELECT roman FROM best WHERE n % 11 = 0)"""
FRESH = f"""{L}, fresh AS MATERIALIZED (SELECT *, greatest(n, fan_in) AS e, {POSTFIX.format(x="native")} AS stem FROM best JOIN fan USING (native) WHERE roman NOT IN (SELECT roman FROM lex) AND roman NOT IN (SELECT roman FROM blocked)),
room AS (SELECT greatest(0, {MOST} - count(*)) AS room FROM lex WHERE weight < 100)"""
BAND = "CASE WHEN {e} >= 40 OR n >= 8 THEN 85 WHEN {e} >= 8 OR n >= 2 THEN 80 ELSE 75 END"
DICT_STEM = "coalesce(" + ", ".join(f"CASE WHEN ends_with(native, '{p}') AND length(native) > {len(p)} THEN substr(native, 1, length(native) - {len(p)}) END" for p in insertion.DICTIONARY_POSTFIXES) + ")"
LABELS = f"""{C}, m AS (SELECT word AS roman, n, translate(word, '{LATIN}', '{SCRIPT}') AS top, CASE WHEN n % 9 = 0 THEN 'Infinity'::DOUBLE ELSE (n % 7) + 5 - (n % 5) END AS lead FROM c WHERE length(word) >= 4 AND (n % 10 <> 0 OR n % 9 = 0)),
v AS (SELECT roman, top, gold, CASE WHEN NOT regexp_full_match(top, '{WORD}') THEN 'rejected_invalid' WHEN gold IS NULL THEN 'novel_added' WHEN top <> gold AND lead >= 4 THEN 'overridden' ELSE 'kept_gold' END AS verdict
  FROM (SELECT *, CASE WHEN n % 4 = 0 THEN top WHEN n % 2 = 0 THEN top || 'ખ' END AS gold FROM m))"""

ORACLE = {
    "q28_word_tests": f"""{W}, u AS (SELECT DISTINCT w FROM (SELECT unnest({listed(ODD)}) AS w UNION ALL SELECT unnest([word, translate(word, '{LATIN}', '{SCRIPT}')]) FROM w))
SELECT w, regexp_matches(w, '{BLOCK}') AS gujarati, regexp_full_match(lower(w), '[a-z.''-]{{2,32}}') AND regexp_matches(lower(w), '[a-z]') AS roman,
  length(w) <= 32 AND regexp_full_match(w, '[A-Za-z]+(?:[+''-][A-Za-z]+)*') AS roman_word, regexp_full_match(w, '{WORD}') AS gujarati_word, regexp_full_match(w, '[અ-ઑક-હ]{BLOCK}{{1,29}}') AND regexp_matches(w, '[ક-હ]') AS quality,
  regexp_matches(w, '^\\d+\\.?$|^\\.\\d+$|\\d\\.\\d') AS number, regexp_matches(w, '(?i)@|://|(?:^|\\.)(?:com|org|net|edu|io|gov)(?:\\b|$)') AS literal, {BARE.format(x="w")} AS bare, {CODE.format(x="w")} AS code,
  CASE WHEN NOT starts_with(trim(w), '#') AND length({TOKEN}) >= 2 AND regexp_matches({TOKEN}, '{BLOCK}') AND len(regexp_extract_all({TOKEN}, '[A-Za-z]')) <= length({TOKEN}) // 2 THEN {TOKEN} END AS token,
  nfc_normalize(trim(w)) AS nfc, {_canonical("w")} AS canonical, regexp_replace(lower(w), '[^a-z+]', '', 'g') AS learning_key,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower(w), '[^a-z+'']', '', 'g'), 'w', 'v'), 'a+', 'a', 'g'), 'e+', 'e', 'g'), 'i+', 'i', 'g'), 'o+', 'o', 'g'), 'u+', 'u', 'g') AS family,
  {POSTFIX.format(x="w")} AS stem, CASE WHEN regexp_matches(w, '^{SIGN}') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + 2.5::DOUBLE * len(list_filter(range(1, length(w)), lambda i: substr(w, i, 2) = '્્'))
    + 2.0::DOUBLE * len(list_filter(range(1, length(w)), lambda i: regexp_matches(substr(w, i, 2), '^{SIGN}{SIGN}'))) AS penalty,
  array_to_string(list_filter(list_concat([squeezed], parts), lambda x: {CODE.format(x="x")}), ',') AS codes,
  array_to_string(list_transform(list_filter(range(1, length(w) + 1), lambda i: substr(w, i, 1) = 'ી'), lambda i: substr(w, 1, i - 1) || 'િ' || substr(w, i + 1)), ',') AS variants, translate(lower(w), 'aeiou', '') AS consonants
FROM (SELECT w, squeezed, list_filter(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN list_position(raw, raw[i]) = i AND raw[i] <> squeezed THEN raw[i] END), lambda x: x IS NOT NULL) AS parts FROM (
  SELECT w, {SQUEEZED.format(x="lower(trim(w))")} AS squeezed, list_filter(list_transform(regexp_split_to_array(lower(trim(w)), '[\\s_/|+-]+'), lambda x: {SQUEEZED.format(x="x")}), lambda x: length(x) >= 2) AS raw FROM u))""",
    "q29_pair_tests": f"""{W}, k AS (SELECT word AS a, unnest([word, word || 'a', substr(word, 1, 3), reverse(word), replace(word, 'a', 'aa'), replace(word, 'i', 'ii'), replace(word, 'o', 'oo'), replace(word, 'w', 'v'), replace(word, 't', 'th'), replace(word, 'c', 'ch'), replace(word, 'th', 't'), replace(word, 'h', '')]) AS b FROM w),
p AS (SELECT a AS typed, b AS key FROM k UNION SELECT b, a FROM k)
SELECT typed, key, (CASE WHEN length(typed) = 0 OR length(key) = 0 THEN 0 WHEN typed = key THEN 100 WHEN starts_with(typed, key) OR starts_with(key, typed) THEN 80 - least(40, abs(length(typed) - length(key)) * 8)
    ELSE greatest(0, 6 * len(list_filter(range(1, least(length(typed), length(key)) + 1), lambda i: substr(typed, 1, i) = substr(key, 1, i))) - 4 * abs(length(typed) - length(key))) END)::INT AS closeness,
  length(typed) > 0 AND starts_with(key, typed) AND length(key) > length(typed) AS extends, {_stripped()} AS strip,
  length(key) = length(typed) + 1 AND len(list_filter(range(2, greatest(length(key) - 1, 2) + 1), lambda i: regexp_matches(substr(key, i, 1), '[aiuo]') AND substr(key, i, 1) = substr(key, i - 1, 1)
    AND regexp_matches(substr(key, i + 1, 1), '[^aiuo]') AND translate(substr(key, 1, i - 1) || substr(key, i + 1), 'w', 'v') = translate(typed, 'w', 'v'))) > 0 AS lengthened,
  round(CASE WHEN length(typed) > 0 AND length(key) > 0 THEN ln(1 + length(typed)) / ln(1 + length(key)) ELSE 0.0 END, 6) AS share, round(CASE WHEN length(key) > 0 THEN least(0.9, ln(1 + length(key)) / 3.5) ELSE 0.0 END, 6) AS boost FROM p""",
    "q30_quality_reasons": f"""{B}, q AS (SELECT roman, CASE WHEN n % 7 = 0 THEN native || ' ' || native WHEN n % 13 = 0 THEN repeat(native, 9) ELSE native END AS native, n % 2 = 0 AS soft, n % 14 = 0 AS allowed FROM b)
SELECT roman, CASE WHEN contains(native, ' ') AND allowed THEN 'kept' WHEN contains(native, ' ') THEN 'space' WHEN soft AND length(native) > 16 THEN 'soft_long' WHEN length(native) > 28 THEN 'hard_long'
  WHEN soft AND coalesce({POSTFIX.format(x="native")} IN (SELECT native FROM q), FALSE) THEN 'soft_postfix_dup' ELSE 'kept' END AS reason FROM q""",
    "q31_soft_fill": f"""{FRESH}, bare AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY -e, roman) AS r FROM fresh WHERE stem IS NULL), room WHERE r <= room),
tail AS (SELECT *, row_number() OVER (ORDER BY -e, roman) AS r FROM fresh WHERE stem IS NOT NULL AND stem NOT IN (SELECT native FROM lex) AND stem NOT IN (SELECT native FROM bare)),
added AS (SELECT count(*) AS added FROM bare),
allof AS (SELECT roman, native, n, fan_in FROM bare UNION ALL SELECT roman, native, n, fan_in FROM tail, room, added WHERE room > added AND r <= room - added)
SELECT roman, native, {BAND.format(e="greatest(n, fan_in)")} AS weight FROM allof""",
    "q32_bare_fill": f"""{FRESH} SELECT roman, native, {BAND.format(e="n")} AS weight FROM (SELECT *, row_number() OVER (ORDER BY n DESC, roman) AS r FROM fresh WHERE stem IS NULL), room WHERE r <= least(150, room)""",
    "q33_dictionary_fill": f"""{L}, d AS MATERIALIZED (SELECT *, {DICT_STEM} AS stem, row_number() OVER (ORDER BY length(roman), roman) AS o FROM best WHERE roman NOT IN (SELECT roman FROM lex)),
f AS (SELECT native, min(o) AS o FROM d WHERE stem IS NULL GROUP BY native),
k AS (SELECT d.*, row_number() OVER (ORDER BY d.o) AS r FROM d LEFT JOIN f ON f.native = d.stem WHERE d.stem IS NULL OR (d.stem NOT IN (SELECT native FROM lex) AND (f.o IS NULL OR f.o > d.o)))
SELECT roman, native, 80 AS weight FROM k WHERE r <= 300""",
    "q34_capped_words": f"""{B}, d AS (SELECT DISTINCT native AS word FROM b), s AS MATERIALIZED (SELECT word, {POSTFIX.format(x="word")} AS stem FROM d)
SELECT word FROM s WHERE stem IS NULL OR stem NOT IN (SELECT word FROM s) ORDER BY CASE WHEN length(word) BETWEEN 3 AND 14 THEN 0 ELSE 1 END, stem IS NOT NULL, length(word), word LIMIT 200""",
    "q35_pruned_and_upgraded": f"""{L}, x AS MATERIALIZED (SELECT * FROM lex UNION ALL SELECT roman, native, 75 FROM best WHERE n % 5 = 0),
y AS (SELECT * FROM x WHERE NOT (weight < 100 AND coalesce({POSTFIX.format(x="native")} IN (SELECT native FROM x), FALSE)))
SELECT y.roman, y.native, CASE WHEN weight < 100 AND n IS NOT NULL THEN greatest(weight, {BAND.format(e="greatest(n, fan_in)")}) ELSE weight END AS weight FROM y LEFT JOIN (SELECT * FROM best JOIN fan USING (native)) s ON s.roman = y.roman AND s.native = y.native""",
    "q36_precedence": f"""{B}, t AS (SELECT roman, CASE WHEN n % 7 = 0 THEN plain || 'ક' END AS x, CASE WHEN n % 3 = 0 THEN plain || 'ખ' END AS p, CASE WHEN n % 2 = 0 THEN plain || 'ગ' END AS s, CASE WHEN n % 5 = 0 THEN plain || 'ઘ' END AS d, (n * 7 % 1100)::INT AS w FROM b),
u AS (SELECT *, coalesce(x, p, s) AS base, CASE WHEN x IS NOT NULL THEN 1000 WHEN p IS NOT NULL THEN 800 WHEN s IS NOT NULL THEN 900 END AS bw FROM t)
SELECT roman, CASE WHEN wins THEN d ELSE base END AS native, CASE WHEN wins THEN least(w, 700) ELSE bw END AS weight FROM (SELECT *, x IS NULL AND d IS NOT NULL AND (base IS NULL OR w > bw) AS wins FROM u) WHERE base IS NOT NULL OR d IS NOT NULL""",
    "q37_merged_labels": f"{LABELS} SELECT roman, CASE WHEN verdict = 'kept_gold' THEN gold ELSE top END AS native, verdict FROM v",
    "q38_label_counts": f"{LABELS} SELECT verdict, count(*) AS words FROM v GROUP BY verdict",
    "q39_boosted": f"""{B}, k AS MATERIALIZED (SELECT plain AS word, max(n) AS n FROM b WHERE n % 3 = 0 GROUP BY plain), f AS MATERIALIZED (SELECT DISTINCT native AS word, {POSTFIX.format(x="native")} AS stem FROM b WHERE n % 3 <> 0)
SELECT word, max(n)::BIGINT AS n FROM (SELECT * FROM k UNION ALL SELECT word, {labels.FLOOR} FROM f WHERE stem IS NULL OR (stem NOT IN (SELECT word FROM k) AND stem NOT IN (SELECT word FROM f WHERE stem IS NULL))) GROUP BY word""",
    "q62_stress": f"""{C}, k AS (SELECT word AS k FROM c WHERE n >= 5), s AS (SELECT k, 0 AS t, k AS roman FROM k UNION ALL SELECT k, 1, k || 'a' FROM k
  UNION ALL SELECT k, 2, CASE WHEN contains(k, 'v') THEN substr(k, 1, instr(k, 'v') - 1) || 'w' || substr(k, instr(k, 'v') + 1) ELSE k || 'i' END FROM k)
SELECT roman, t, k FROM (SELECT roman, min(t)::INT AS t, first(k ORDER BY t, k) AS k FROM s GROUP BY roman) ORDER BY t, k LIMIT 400""",
    "q63_leads": f"""{C}, s AS (SELECT substr(word, 1, 2) AS key, length(word)::INT AS size, sum(n)::BIGINT AS total FROM c WHERE length(word) >= 2 AND n >= 2 GROUP BY ALL), u AS (SELECT key, total, min(size) AS size FROM s GROUP BY key, total)
SELECT key, size, total, (total - next)::BIGINT AS lead FROM (SELECT *, row_number() OVER w AS r, lead(total) OVER w AS next FROM u WINDOW w AS (PARTITION BY key ORDER BY total DESC)) WHERE r = 1""",
}
