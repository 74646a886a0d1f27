"""Typed words to menus over a lexicon made of the part names, each step with its SQL.

The names' words are the romans, a letter-by-letter mapping gives the natives, and counts give the
weights and the evidence. Other spellings and script forms, which no SQL expresses, are off in the
queries with SQL and on in q44.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarkash.functions.script import MATRA
from tarkash.operators import candidates, counts, engine, validity
from tarkash.operators.scoring import DIGRAPHS, LEXICAL, PLACES
from tarkash.sources.stages import Stages
from tarkash.sources.tables import table

LATIN, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ાબકદેફગહિજકલમનોપકરસતુવવકયઝ"
ENDINGS = ("", "maa", "thi", "ne", "i", "aa", "ta", "she", "o", "vali", "blue", "redtan")
EXCEPTIONS = (("red", "લાલ"), ("blue", "વાદળી"))
EMOJI = (("red", "🔴", 50, 0.95), ("red", "❤", 70, 0.95), ("blue", "🔵", 40, 0.9), ("rose", "🌹", 90, 0.97), ("rose", "🥀", 20, 0.3))
LARGEST = 100
POLICY = engine.Policy(families=tuple(f for f in engine.FAMILIES if f not in ("phonetic", "model")), respell=False)


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    return table(spark, sf_dir, "part").select(words).groupBy("word").agg(F.count("*").alias("n"))


def tables(spark: SparkSession, sf_dir: str) -> engine.Tables:
    n = F.col("n")
    words = word_counts(spark, sf_dir).where(F.length("word") >= 2).withColumn("native", F.translate("word", LATIN, SCRIPT))
    lexicon = words.select(F.col("word").alias("roman"), "native", F.when(n % 3 == 0, 80).otherwise(100 + n).cast("int").alias("weight"), "n")
    evidence = words.groupBy("native").agg(F.max("n").alias("unigram"), F.max(n % 7).alias("stem"), F.max(n % 2 == 0).alias("attested"))
    prefixes = lexicon.select("*", F.explode(F.sequence(F.lit(2), F.least(F.lit(6), F.length("roman")))).alias("k")).select(F.expr("substring(roman, 1, k)").alias("prefix"), "roman", "native", "weight")
    index = counts.top_per_key(prefixes, "prefix", 8, F.desc("weight"), F.col("roman")).drop("rank")
    learnt = lexicon.where(n % 5 == 0).select(F.col("roman").alias("typed"), "native", (n % 4).cast("int").alias("explicit_count"), (n % 10 == 0).alias("preferred"))
    exceptions = spark.createDataFrame(EXCEPTIONS, "roman string, native string")
    by_code = spark.createDataFrame(EMOJI, "code string, emoji string, weight int, confidence double")
    keep = Stages()
    return engine.Tables(keep(lexicon.drop("n")), keep(evidence), exceptions, keep(index), by_code, None, learnt, None, LARGEST)


def typed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.col("word")
    longer = F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat(word, e))
    shorter = F.when(F.length(word) > 4, F.array(F.expr("substring(word, 1, length(word) - 1)"), F.expr("substring(word, 1, length(word) - 2)"))).otherwise(F.array().cast("array<string>"))
    return word_counts(spark, sf_dir).select(F.explode(F.concat(longer, shorter)).alias("typed")).distinct()


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.generate(typed_words(spark, sf_dir), tables(spark, sf_dir), POLICY)


def menu_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _generated(spark, sf_dir)
    return rows.select("typed", "native", "key", "source", "weight", "cost", "tier", "closeness", F.array_join("provenance", ",").alias("provenance"))


def menu_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validity.validity(_generated(spark, sf_dir), tables(spark, sf_dir).evidence)
    return rows.withColumn("score", F.round("score", 6))


def menu_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = engine.rank(Stages()(_generated(spark, sf_dir)), tables(spark, sf_dir), POLICY)
    return ranked.select("typed", "native", "tier", F.round("score", 6).alias("score"), "rank")


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine.menus(typed_words(spark, sf_dir), tables(spark, sf_dir), POLICY)
    return rows.select("typed", F.array_join("menu", " | ").alias("menu"))


def full_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families and other spellings, for the distinct words themselves; no SQL expresses the spellings."""
    rows = engine.menus(word_counts(spark, sf_dir).select(F.col("word").alias("typed")), tables(spark, sf_dir))
    return rows.select("typed", F.array_join("menu", " | ").alias("menu"))


QUERIES = {"q40_menu_candidates": menu_candidates, "q41_menu_validity": menu_validity, "q42_menu_scores": menu_scores, "q43_menus": menus, "q44_full_menus": full_menus}


def values(rows: tuple, names: str) -> str:
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


def listed(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


BARE = "regexp_matches({x}, '[ક-રલળવ-હ]$')"
TWIN = "regexp_matches({x}, '^[nNtTdDlL]$')"


def _canonical(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, 'અા', 'આ', 'g'), '([ાિીુૂેૈોૌ])ઇ', '\\1ઈ', 'g')"


def _cuts(rules, least: int) -> str:
    unique = list(dict.fromkeys(rules))
    rows = tuple((a, b, i) for i, (a, b) in enumerate(unique))
    return f"SELECT typed, suffix, ending, place, substr(typed, 1, length(typed) - length(suffix)) AS stem FROM t, {values(rows, 'suffix, ending, place')} WHERE ends_with(typed, suffix) AND length(typed) >= length(suffix) + {least}"


BASE = f"""
WITH w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part) GROUP BY word),
l AS MATERIALIZED (SELECT word AS roman, translate(word, '{LATIN}', '{SCRIPT}') AS native, (CASE WHEN n % 3 = 0 THEN 80 ELSE 100 + n END)::INT AS weight, n FROM w WHERE length(word) >= 2),
ev AS MATERIALIZED (SELECT native, max(n) AS unigram, max(n % 7) AS stem, max((n % 2 = 0)::INT) = 1 AS attested FROM l GROUP BY native),
t AS MATERIALIZED (SELECT DISTINCT typed FROM (
  SELECT word || e AS typed FROM w, (SELECT unnest({listed(ENDINGS)}) AS e)
  UNION ALL SELECT substr(word, 1, length(word) - k) FROM w, (SELECT unnest([1, 2]) AS k) WHERE length(word) > 4)),
ix AS (SELECT prefix, roman, native, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, roman) AS r FROM (
    SELECT substr(roman, 1, k::INT) AS prefix, roman, native, weight FROM (SELECT *, unnest(range(2, least(6, length(roman)) + 1)) AS k FROM l))) WHERE r <= 8),
exc AS (SELECT * FROM {values(EXCEPTIONS, "roman, native")}),
emo AS (SELECT * FROM {values(EMOJI, "code, emoji, weight, confidence")}),
learnt AS (SELECT roman AS typed, native, (n % 4)::INT AS explicit_count, n % 10 = 0 AS preferred FROM l WHERE n % 5 = 0),
g0 AS (SELECT typed, native, typed AS key, 'strict' AS source, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS cost, 0 AS tier, 0 AS place FROM t JOIN exc ON roman = typed),
g1 AS (SELECT typed, native, typed AS key, 'strict' AS source, weight::DOUBLE AS weight, 0.0::DOUBLE AS cost, CASE WHEN weight >= 100 AND NOT {TWIN.format(x="typed")} THEN 0 ELSE 1 END AS tier, 1 AS place FROM t JOIN l ON roman = typed),
c2 AS ({_cuts(candidates.SIGNS, 2)}),
g2 AS (SELECT typed, native || ending AS native, stem || suffix AS key, 'stem_matra' AS source, greatest(weight, 100)::DOUBLE AS weight, 0.0::DOUBLE AS cost, 1 AS tier, 2 AS place
  FROM c2 JOIN l ON roman = stem WHERE length(typed) >= 3 AND NOT regexp_matches(stem, '[aeiou]$') AND {BARE.format(x="native")}),
c3 AS ({_cuts(candidates.POSTPOSITIONS, 3)}),
p3 AS (SELECT typed, place, native || CASE WHEN {BARE.format(x="native")} AND starts_with(ending, 'ઓ') THEN 'ો' || substr(ending, 2) ELSE ending END AS native, length(suffix) AS size, stem || suffix AS key, greatest(weight, 120) AS weight
  FROM (SELECT c3.*, l.native, l.weight, coalesce(ev.attested, FALSE) AS sure FROM c3 JOIN l ON l.roman = c3.stem LEFT JOIN ev ON ev.native = l.native)
  WHERE length(typed) >= 4 AND (suffix <> 'o' OR length(stem) >= 5)
    AND (NOT regexp_matches(stem, '(?:e|i|o|u|aa|ii|ee|uu|oo|ai|au)$') OR (length(stem) >= 5 AND (weight >= 100 OR sure)))
    AND ({BARE.format(x="native")} OR regexp_matches(native, '[ાીુૂેૈોૌં]$'))),
b3 AS (SELECT typed, native, min(place) AS place, first(key ORDER BY place, key, weight) AS key, first(weight ORDER BY place, key, weight) AS weight
  FROM (SELECT *, max(size) OVER (PARTITION BY typed) AS longest FROM p3) WHERE size = longest GROUP BY typed, native),
g3 AS (SELECT typed, native, key, 'stem_postfix' AS source, weight::DOUBLE AS weight, 0.0::DOUBLE AS cost, 1 AS tier, 3 AS place FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY place, native) AS r FROM b3) WHERE r <= 8),
c4 AS ({_cuts(candidates.INFLECTIONS, 2)}),
p4 AS (SELECT typed, native || ending AS native, place, k, roman || suffix AS key, greatest(weight, 120) AS weight FROM (SELECT *, stem || a AS look FROM c4, (VALUES (0, ''), (1, 'a')) AS v(k, a)) JOIN l ON roman = look),
g4 AS (SELECT typed, native, first(key ORDER BY place, k, key, weight) AS key, 'stem_inflection' AS source, first(weight ORDER BY place, k, key, weight)::DOUBLE AS weight, 1.0::DOUBLE AS cost, 1 AS tier, 4 AS place FROM p4 GROUP BY typed, native),
parts AS MATERIALIZED (SELECT l.roman, l.native AS w, l.weight, ln(1 + coalesce(greatest(ev.unigram, ev.stem), 0)) AS e FROM l LEFT JOIN ev ON ev.native = l.native WHERE (l.weight >= 100 OR coalesce(ev.attested, FALSE)) AND length(l.roman) >= 3),
s1 AS MATERIALIZED (SELECT typed, p.w AS native, p.weight, p.e, substr(typed, length(p.roman) + 1) AS rest FROM t JOIN parts p ON starts_with(typed, p.roman) WHERE length(typed) >= 8),
s2 AS MATERIALIZED (SELECT typed, s.native || p.w AS native, least(s.weight, p.weight) AS weight, s.e + p.e AS e, substr(rest, length(p.roman) + 1) AS rest FROM s1 s JOIN parts p ON starts_with(rest, p.roman)),
s3 AS (SELECT typed, s.native || p.w AS native, least(s.weight, p.weight) AS weight, s.e + p.e AS e FROM s2 s JOIN parts p ON rest = p.roman),
d5 AS (SELECT typed, native, weight, e, 2 AS n FROM s2 WHERE rest = '' UNION ALL SELECT typed, native, weight, e, 3 FROM s3),
b5 AS (SELECT typed, native, max(e) AS e, first(weight ORDER BY -e, -weight, n) AS weight, first(n ORDER BY -e, -weight, n) AS n FROM d5 GROUP BY typed, native),
g5 AS (SELECT typed, native, typed AS key, 'stem_compound' AS source, greatest(weight, 100)::DOUBLE AS weight, greatest(1, n - 1)::DOUBLE AS cost, 1 AS tier, 5 AS place FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY -e, -weight, n, native) AS r FROM b5) WHERE r <= 8),
g6 AS (SELECT typed, native, typed || s AS key, 'near_exact' AS source, weight::DOUBLE AS weight, 1.5 * length(s) AS cost, CASE WHEN weight >= 100 THEN 0 ELSE 1 END AS tier, 6 AS place
  FROM t, (SELECT unnest(['n', 'm', 'ng', 'un', 'um', 'h']) AS s) JOIN l ON roman = typed || s
  WHERE length(typed) >= 4 AND typed NOT IN (SELECT roman FROM l) AND NOT (s IN ('n', 'm') AND regexp_matches(typed || s, '(?:an|en|ian|ing|ers?|ors?|ly)$'))),
g7 AS (SELECT typed, typed AS native, typed AS key, 'latin' AS source, 0.0::DOUBLE AS weight, 0.0::DOUBLE AS cost, 3 AS tier, 7 AS place FROM t),
before AS MATERIALIZED (SELECT typed, {_canonical("native")} AS native, key, source, weight, cost, tier, place FROM (
  SELECT * FROM g0 UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4 UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM g7)),
p8 AS (SELECT t.typed, ix.native, ix.roman, ix.weight FROM t JOIN ix ON ix.prefix = t.typed WHERE length(t.typed) >= 2 AND ix.roman <> t.typed AND NOT EXISTS (SELECT 1 FROM before b WHERE b.typed = t.typed AND b.native = ix.native)),
b8 AS (SELECT typed, native, max(weight) AS weight, first(roman ORDER BY -weight, roman) AS roman FROM p8 GROUP BY typed, native),
g8 AS (SELECT typed, {_canonical("native")} AS native, roman AS key, 'lexicon' AS source, weight::DOUBLE AS weight, 0.0::DOUBLE AS cost, 4 AS tier, 8 AS place FROM (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY -weight, roman, native) AS r FROM b8) WHERE r <= 3),
g9 AS (SELECT typed, emoji AS native, typed AS key, 'emoji' AS source, weight::DOUBLE AS weight, 0.0::DOUBLE AS cost, 5 AS tier, 9 AS place FROM (SELECT t.typed, emo.*, row_number() OVER (PARTITION BY t.typed ORDER BY confidence DESC, weight DESC, emoji) AS r FROM t JOIN emo ON code = t.typed) WHERE r <= 2),
a AS (SELECT * FROM before UNION ALL SELECT * FROM g8 UNION ALL SELECT * FROM g9),
o AS (SELECT *, CASE WHEN source = 'strict' THEN 0 ELSE 1 END AS strict,
  (CASE WHEN typed = key THEN 100 WHEN starts_with(typed, key) OR starts_with(key, typed) THEN 80 - least(40, abs(length(typed) - length(key)) * 8)
    ELSE greatest(0, 6 * len(list_filter(range(1, least(length(typed), length(key)) + 1), lambda i: substr(typed, 1, i) = substr(key, 1, i))) - 4 * abs(length(typed) - length(key))) END)::INT AS closeness FROM a),
m AS MATERIALIZED (SELECT typed, native,
  first(key ORDER BY tier, place, strict, -weight, length(key), cost, key, source) AS key, first(source ORDER BY tier, place, strict, -weight, length(key), cost, key, source) AS source,
  max(weight) AS weight, first(cost ORDER BY place, strict, -weight, length(key), cost, key) AS cost, min(tier)::INT AS tier, max(closeness) AS closeness,
  array_to_string(list_sort(list(DISTINCT source)), ',') AS provenance,
  first(place ORDER BY place, strict, -weight, length(key), cost, key) AS i0, first(strict ORDER BY place, strict, -weight, length(key), cost, key) AS i1,
  first(-weight ORDER BY place, strict, -weight, length(key), cost, key) AS i2, first(length(key) ORDER BY place, strict, -weight, length(key), cost, key) AS i3,
  first(key ORDER BY place, strict, -weight, length(key), cost, key) AS i5 FROM o GROUP BY typed, native)"""

SIGN = "'" + MATRA + "'"
VALID = f""",
words AS (SELECT DISTINCT native FROM m),
probes AS (SELECT DISTINCT native, stem || e AS probe FROM (SELECT native, substr(native, 1, length(native) - length(s)) AS stem FROM words, (SELECT unnest({listed(validity.SUFFIXES)}) AS s) WHERE ends_with(native, s) AND length(native) > length(s) + 1), (SELECT unnest({listed(("", *validity.EXTENSIONS))}) AS e)),
found AS (SELECT p.native, max(greatest(unigram, stem, CASE WHEN attested THEN 50 ELSE 0 END)) AS hit, max(greatest(CASE WHEN unigram > 50 THEN unigram ELSE 0 END, stem)) AS real FROM probes p JOIN ev ON ev.native = p.probe GROUP BY p.native),
known AS (SELECT words.native, coalesce(unigram, 0) AS u, coalesce(attested, FALSE) AS a, ev.native IS NOT NULL AS present,
  greatest(coalesce(ev.stem, 0), coalesce(hit, 0), CASE WHEN coalesce(attested, FALSE) THEN 50 ELSE 0 END) AS st, greatest(coalesce(ev.stem, 0), coalesce(real, 0)) AS re
  FROM words LEFT JOIN ev ON ev.native = words.native LEFT JOIN found ON found.native = words.native),
val AS MATERIALIZED (SELECT native, greatest(0.0, ln(1 + u) + 0.35 * ln(1 + CASE WHEN a THEN 50 ELSE 0 END) + CASE WHEN u > 0 THEN 0.35 ELSE 0.7 END * ln(1 + st)
    - 0.25 * (length(native) - length(replace(native, '્', '')))
    - (CASE WHEN regexp_matches(substr(native, 1, 1), {SIGN}) THEN 3.0 ELSE 0.0 END
      + 2.5 * len(list_filter(range(1, length(native)), lambda i: substr(native, i, 2) = '્્'))
      + 2.0 * len(list_filter(range(1, length(native)), lambda i: regexp_matches(substr(native, i, 1), {SIGN}) AND regexp_matches(substr(native, i + 1, 1), {SIGN}))))) AS score,
  greatest(u, st)::BIGINT AS evidence, u::BIGINT AS unigram, st::BIGINT AS stem, u > 0 OR re > 0 AS attested, a AS spell_ok, u > 50 AS uni_strong, present FROM known)"""


def _stripped() -> str:
    one = lambda a, b: f"(length(typed) - length(key) = {len(a) - len(b)} AND substr(typed, i, {len(a)}) = '{a}' AND substr(typed, 1, i - 1) || '{b}' || substr(typed, i + {len(a)}) = key)"
    return f"len(list_filter(range(1, length(typed) + 1), lambda i: {' OR '.join(one(a, b) for a, b in DIGRAPHS)})) > 0"


def _case(*pairs: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + " ELSE 0.0 END"


def _has(x: str) -> str:
    return f"contains(native, '{x}')"


def _place(i: int) -> str:
    return "CASE typed " + " ".join(f"WHEN '{a}' THEN '{b[i]}'" for a, b in PLACES.items()) + " ELSE '' END"


STRONG = "(own IS NOT NULL AND own_weight >= 100)"
EXTENDS = "(own IS NOT NULL AND length(own) > 0 AND starts_with(native, own) AND length(native) > length(own))"
MATCHES = "regexp_matches(typed, '{}')".format
RULES = [
    (("lexical AND weight > 0 AND weight < 100 AND unigram < 150", "-(0.85 * freq + 2.8)"),),
    (("own = native AND own_weight > 0 AND own_weight < 100 AND strip", "3.2"),),
    ((f"{STRONG} AND NOT twin AND own = native AND morph", "6.5"), (f"{STRONG} AND NOT twin AND {EXTENDS}", "-8.5")),
    ((f"source = 'near_exact' AND {STRONG} AND native <> own AND length(key) > length(typed)", "-7.0"),),
    (("lexical AND key = typed AND own_weight >= 100", "2.0"), ("lexical AND length(key) > length(typed) + 1", "-1.5")),
    (("preferred OR explicit_count >= 2", "80.0"), ("explicit_count > 0", "least(4.0, 1.2 * ln(1 + explicit_count))")),
    ((f"{_has('ય')} AND NOT contains(typed, 'y')", "-4.0"),),
    ((MATCHES("^[aiueoREOMH]$") + " AND key <> typed", "-30.0"),),
    ((f"twin AND native = {_place(0)}", "2.5"), (f"twin AND native = {_place(1)}", "-0.35")),
    ((f"contains(typed, 'd') AND {_has('ડ')} AND NOT {_has('દ')}", "-1.2"),),
    ((f"contains(typed, 'd') AND {_has('દ')}", "0.5"),),
    (("starts_with(typed, 'sh') AND starts_with(native, 'શ')", "3.0"), ("starts_with(typed, 'sh') AND starts_with(native, 'સ')", "-(3.0 + 0.5 * uni)")),
    ((f"NOT contains(typed, 'sh') AND contains(typed, 's') AND {_has('શ')} AND NOT {_has('ષ')}", "-0.55"),),
    ((f"NOT contains(typed, 'sh') AND contains(typed, 's') AND {_has('સ')} AND NOT {_has('શ')}", "0.15"),),
    (("contains(typed, 'z') AND NOT contains(typed, 'j') AND starts_with(native, 'ઝ')", "0.5"), ("contains(typed, 'z') AND NOT contains(typed, 'j') AND starts_with(native, 'જ')", "-0.35")),
    ((f"dbl AND {_has('્')}", "5.5"), (f"dbl AND {_has('ં')} AND NOT {_has('્')}", "-(6.5 + 1.15 * uni)"), (f"NOT dbl AND {_has('ં')} AND " + MATCHES("n[kgcjtdTDpb]"), "0.35")),
    (("starts_with(typed, 'aa') AND starts_with(native, 'આ')", "3.5"), ("starts_with(typed, 'aa') AND starts_with(native, 'અ')", "-4.0"), ("NOT starts_with(typed, 'aa') AND only_onset", "-3.8")),
    (("bare_end", "-1.6"),),
    (("later", "0.2 * longs"),),
    (("later AND runs >= 2 AND longs >= 2", "2.5"), ("later AND runs >= 2", "-1.2")),
    ((f"lengthened AND {_has('ા')}", "5.25"),),
    (("length(native) < 0.7 * length(typed)", "-2.0"),),
]
SHORT_A = "a(?:[^a]|$)"
SCORED = f""",
j AS (SELECT m.*, val.score AS v, val.evidence, val.unigram, val.attested, val.spell_ok, {_canonical("l.native")} AS own, coalesce(l.weight, 0) AS own_weight,
  coalesce(learnt.explicit_count, 0) AS explicit_count, coalesce(learnt.preferred, FALSE) AS preferred
  FROM m JOIN val ON val.native = m.native LEFT JOIN l ON l.roman = m.typed LEFT JOIN learnt ON learnt.typed = m.typed AND learnt.native = m.native),
f AS (SELECT *, bool_or({_stripped()}) OVER (PARTITION BY typed) AS strip, bool_or({EXTENDS}) OVER (PARTITION BY typed) AS morph,
  length(key) = length(typed) + 1 AND len(list_filter(range(2, greatest(length(key) - 1, 2) + 1), lambda i: regexp_matches(substr(key, i, 1), '[aiuo]') AND substr(key, i, 1) = substr(key, i - 1, 1)
    AND regexp_matches(substr(key, i + 1, 1), '[^aiuo]') AND translate(substr(key, 1, i - 1) || substr(key, i + 1), 'w', 'v') = translate(typed, 'w', 'v'))) > 0 AS lengthened,
  0.55 * ln(1 + unigram) AS uni, 0.35 * ln(1 + weight) AS freq, source IN ({", ".join(f"'{x}'" for x in LEXICAL)}) AS lexical, {TWIN.format(x="typed")} AS twin, {MATCHES("mm|nn|tt|kk|ll")} AS dbl,
  ends_with(native, 'ા') AND NOT ends_with(typed, 'a') AS bare_end, len(regexp_extract_all(typed, 'a+')) AS runs, len(regexp_extract_all(typed, 'a+')) >= 1 AND contains(substr(typed, 2), 'a') AS later,
  greatest(0, length(native) - length(replace(native, 'ા', '')) - CASE WHEN ends_with(native, 'ા') AND NOT ends_with(typed, 'a') THEN 1 ELSE 0 END) AS longs,
  {MATCHES("^(?:[kgcjtdpbnmylrsvwxz]|ch|kh|gh|jh|th|dh|ph|bh|sh|tr|dr)" + SHORT_A)} AND (starts_with(native, 'આ') OR regexp_matches(native, '^[ક-હ]ા'))
    AND NOT contains(CASE WHEN starts_with(native, 'આ') THEN substr(native, 2) ELSE substr(native, 3) END, 'ા') AND regexp_matches(substr(typed, 3), '{SHORT_A}') AS only_onset FROM j),
x AS (SELECT *, (CASE WHEN tier <> 5 THEN 0.6 * CASE WHEN unigram > 0 THEN ln(1 + unigram) / ln(1 + {LARGEST}) ELSE 0.0 END + CASE WHEN explicit_count > 0 THEN least(0.9, ln(1 + explicit_count) / 3.5) ELSE 0.0 END ELSE 0.2 * ln(1 + weight) END
    + freq + CASE WHEN tier <> 5 AND attested THEN 1.4 * v ELSE 0.0 END + CASE WHEN tier <> 5 AND spell_ok THEN 0.35 ELSE 0.0 END + 0.01 * closeness + uni - 1.35 * cost
    + {" + ".join(_case(*r) for r in RULES)}) AS s,
  CASE WHEN preferred THEN -1 WHEN source = 'fuzzy' AND {STRONG} AND native <> own AND NOT lengthened THEN 1
    WHEN tier = 0 AND (({STRONG} AND NOT twin AND {EXTENDS}) OR (source = 'near_exact' AND {STRONG} AND native <> own AND length(key) > length(typed)) OR (dbl AND {_has('ં')} AND NOT {_has('્')}) OR (starts_with(typed, 'aa') AND starts_with(native, 'અ'))) THEN 1
    ELSE tier END AS level FROM f),
y AS (SELECT *, s + CASE WHEN key = typed AND own_weight > 0 AND own_weight < 100 AND source IN ('strict', 'fuzzy') AND level = 1 AND {MATCHES("[aeiou]$")} AND sign AND NOT post THEN 5.5 ELSE 0.0 END
    + CASE WHEN source = 'stem_matra' AND own_weight > 0 AND own_weight < 100 THEN -2.0 WHEN source IN ('stem_postfix', 'stem_inflection') AND weight >= 100 THEN 4.5 ELSE 0.0 END AS score
  FROM (SELECT *, bool_or(source = 'stem_matra') OVER (PARTITION BY typed) AS sign, bool_or(source = 'stem_postfix') OVER (PARTITION BY typed) AS post FROM x)),
z AS MATERIALIZED (SELECT typed, native, level::INT AS tier, score, row_number() OVER (PARTITION BY typed ORDER BY level, score DESC, closeness DESC, weight DESC, i0, i1, i2, i3, cost, i5)::INT AS rank FROM y)"""

LAID = """,
items AS (SELECT typed, list(struct_pack(native := z.native, tier := z.tier, confidence := CASE WHEN z.tier = 5 THEN coalesce(e.confidence, 0.0) ELSE 0.0 END) ORDER BY rank) AS items
  FROM z LEFT JOIN (SELECT emoji, max(confidence) AS confidence FROM emo GROUP BY emoji) e ON e.emoji = z.native GROUP BY typed),
kinds AS (SELECT typed, list_filter(items, lambda i: i.tier <= 2) AS w, list_filter(items, lambda i: i.tier = 3) AS la, list_filter(items, lambda i: i.tier = 4) AS p, list_filter(items, lambda i: i.tier = 5) AS em, list_slice(list_filter(items, lambda i: i.tier = 5 AND i.confidence >= 0.9), 1, 2) AS su FROM items)
SELECT typed, array_to_string(list_transform(list_slice(
  list_concat(list_concat(CASE WHEN len(w) > 0 THEN list_concat(list_concat(list_concat(list_slice(w, 1, 1), list_slice(la, 1, 1)), list_concat(list_slice(w, 2, 3), su)), list_slice(w, 4, 100000)) ELSE list_slice(la, 1, 1) END, p),
  list_filter(em, lambda i: NOT list_contains(su, i))), 1, 6), lambda i: i.native), ' | ') AS menu FROM kinds"""

ORACLE = {
    "q40_menu_candidates": BASE + " SELECT typed, native, key, source, weight, cost, tier, closeness, provenance FROM m",
    "q41_menu_validity": BASE + VALID + " SELECT * REPLACE (round(score, 6) AS score) FROM val",
    "q42_menu_scores": BASE + VALID + SCORED + " SELECT typed, native, tier, round(score, 6) AS score, rank FROM z",
    "q43_menus": BASE + VALID + SCORED + LAID,
}
