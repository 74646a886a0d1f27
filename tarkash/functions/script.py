"""Tests and projections of Gujarati and romanised words, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Postpositions, longest first (fixed values).
POSTFIXES = ("માંથી", "વાળું", "વાળી", "વાળા", "વાળો", "માં", "થી", "ની", "નું", "નાં", "ના", "ને", "નો")
SOFT, SOFT_MID, SOFT_HIGH, STRONG = 75, 80, 85, 100

VOWEL, CONSONANT, MATRA, MODIFIER = r"[અ-ઔ]", r"[ક-હૹ]", r"[ા-ૌૢૣ]", r"[ઁ-ઃ]"
LETTER = rf"{CONSONANT}઼?"
CLUSTER = rf"{LETTER}(?:્[‌‍]?{LETTER})*{MATRA}?"
WORD = rf"\A(?:ૐ|(?:(?:{VOWEL}|{CLUSTER}){MODIFIER}?)+)\z"


def nfc(text: Column) -> Column:
    """Canonical composition of the trimmed text; null stays null. Spark has no such function."""

    @F.pandas_udf("string")
    def composed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: unicodedata.normalize("NFC", x.strip()), na_action="ignore")

    return composed(text)


def is_gujarati(word: Column) -> Column:
    """Some character is of the Gujarati block; null is not."""
    return F.coalesce(word.rlike(r"[઀-૿]"), F.lit(False))


def is_roman(word: Column) -> Column:
    """2 to 32 of a-z, full stop, apostrophe and hyphen, any case, at least one letter."""
    return F.coalesce(F.lower(word).rlike(r"\A(?=.*[a-z])[a-z.'-]{2,32}\z"), F.lit(False))


def is_roman_word(word: Column) -> Column:
    """At most 32 letters with single separators between them."""
    return F.coalesce((F.length(word) <= 32) & word.rlike(r"\A[A-Za-z]+(?:[+'-][A-Za-z]+)*\z"), F.lit(False))


def is_gujarati_word(word: Column) -> Column:
    """A sequence of well-formed syllables."""
    return F.coalesce(word.rlike(WORD), F.lit(False))


def is_quality(word: Column) -> Column:
    """2 to 30 characters of the block, beginning with a vowel or consonant and holding a consonant."""
    return F.coalesce(word.rlike(r"\A(?=.*[ક-હ])[અ-ઑક-હ][઀-૿]{1,29}\z"), F.lit(False))


def is_number(word: Column) -> Column:
    return F.coalesce(word.rlike(r"\A\d+\.?\z|\A\.\d+\z|\d\.\d"), F.lit(False))


def is_latin_literal(word: Column) -> Column:
    """Looks like an address: an at sign, a scheme, or a well-known top-level domain."""
    return F.coalesce(word.rlike(r"(?i)@|://|(?:^|\.)(?:com|org|net|edu|io|gov)(?:\b|$)"), F.lit(False))


def closeness(a: Column, b: Column) -> Column:
    """100 for equal words, 40 to 80 for a prefix, else 6 a shared leading letter less 4 a letter of difference."""
    a, b = F.lower(a), F.lower(b)
    apart = F.abs(F.length(a) - F.length(b))
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    shared = F.size(F.filter(places, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    missing = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    near = F.startswith(a, b) | F.startswith(b, a)
    return F.when(missing, 0).when(a == b, 100).when(near, 80 - F.least(F.lit(40), apart * 8)).otherwise(F.greatest(F.lit(0), shared * 6 - apart * 4)).cast("int")


def orthography_penalty(native: Column) -> Column:
    """3 for a sign that opens the word, 2.5 a doubled joiner, 2 a pair of vowel signs."""
    signs = r"[ા-ૌૢૣ]"
    count = lambda p: F.regexp_count(native, F.lit(p)).cast("double")
    return F.coalesce(3.0 * count(rf"\A{signs}") + 2.5 * count("્(?=્)") + 2.0 * count(f"{signs}(?={signs})"), F.lit(0.0))


def extends(base: Column, native: Column) -> Column:
    """The native word is the base and something more."""
    return F.coalesce((F.length(base) > 0) & native.startswith(base) & (F.length(native) > F.length(base)), F.lit(False))


def only_short_a_added(typed: Column, key: Column) -> Column:
    """The key is the typed word with single a's put in, none of them beside the end of another a."""
    extra = r"(?:(?<!a)a)?"
    plain = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9])", r"\\$1")
    letters = F.transform(F.split(typed, ""), lambda c: F.when(c == "a", c).otherwise(F.concat(F.lit(extra), plain(c))))
    pattern = F.concat(F.lit(r"\A"), F.array_join(letters, ""), F.lit(extra + r"\z"))
    return F.coalesce((F.length(key) > F.length(typed)) & (F.length(typed) > 0) & F.regexp_like(key, pattern), F.lit(False))

def clean_wiki_token(line: Column) -> Column:
    """The first token of a list's line without brackets and outer punctuation, or null.

    Comments, words under two characters, words without Gujarati and words over half Latin give null.
    """
    raw = F.trim(line)
    first = F.split(F.split(raw, "\t").getItem(0), r"\s+").getItem(0)
    word = F.btrim(F.trim(F.regexp_replace(first, r"\s*\([^)]*\)\s*", "")), F.lit(".,;:!?\"'`|/\\"))
    keep = ~raw.startswith("#") & (F.length(word) >= 2) & is_gujarati(word) & (F.regexp_count(word, F.lit("[A-Za-z]")) <= F.floor(F.length(word) / 2))
    return F.when(keep, word)


def strip_postfix(word: Column, postfixes: Sequence[str] = POSTFIXES) -> Column:
    """The word without the first postfix that leaves over one character, or null."""
    return F.coalesce(*[F.when(word.endswith(p) & (F.length(word) > len(p) + 1), word.substr(F.lit(1), F.length(word) - len(p))) for p in postfixes])


def is_soft(weight: Column) -> Column:
    return F.coalesce((weight > 0) & (weight < STRONG), F.lit(False))


def soft_weight(n: Column, fan_in: Column, freq: Column | int = 0, many_sources: Column | bool = False, morph: Column | bool = False) -> Column:
    """75, 80 or 85 by evidence: the larger of count and fan-in, 5 less for a morphological form."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    n, freq = F.coalesce(n, F.lit(0)), lit(freq)
    evidence = F.greatest(n, F.coalesce(fan_in, F.lit(0)))
    evidence = F.when(lit(morph), F.greatest(evidence - 5, F.lit(0))).otherwise(evidence)
    high = lit(many_sources) | (freq >= 500) | (evidence >= 40) | (n >= 8)
    return F.when(high, SOFT_HIGH).when((freq >= 50) | (evidence >= 8) | (n >= 2), SOFT_MID).otherwise(SOFT)


def quality_reason(native: Column, weight: Column, allowed: Column, stem_known: Column, soft_most: int = 16, hard_most: int = 28) -> Column:
    """Why a lexicon entry goes, the first that fits, or null: space, soft_long, hard_long, soft_postfix_dup.

    An allowed phrase is kept whatever its length.
    """
    soft, size, phrase = weight < STRONG, F.length(native), native.rlike("[  ]")
    return (
        F.when(phrase & allowed, F.lit(None))
        .when(phrase, "space")
        .when(soft & (size > soft_most), "soft_long")
        .when(size > hard_most, "hard_long")
        .when(soft & F.coalesce(stem_known, F.lit(False)), "soft_postfix_dup")
    )


def canonical(native: Column) -> Column:
    """Independent vowels where two signs were typed for one."""
    return F.regexp_replace(F.regexp_replace(native, "અા", "આ"), "([ાિીુૂેૈોૌ])ઇ", "$1ઈ")


def learning_key(roman: Column) -> Column:
    return F.regexp_replace(F.lower(roman), "[^a-z+]", "")


def ends_bare(native: Column) -> Column:
    """The last character is a consonant that carries its own a."""
    return F.coalesce(native.rlike(r"[ક-રલળવ-હ]\z"), F.lit(False))


def is_emoji_code(code: Column) -> Column:
    return F.coalesce(code.rlike(r"\A[a-z][a-z0-9'-]{0,31}\z"), F.lit(False))


def emoji_codes(phrase: Column) -> Column:
    """The phrase run together, then its parts of two characters or more, valid codes only, in order."""
    squeeze = lambda x: F.regexp_replace(x, r"[^a-z0-9']", "")
    raw = F.lower(F.trim(phrase))
    parts = F.filter(F.transform(F.split(raw, r"[\s_/|+-]+"), squeeze), lambda x: F.length(x) >= 2)
    return F.array_distinct(F.filter(F.concat(F.array(squeeze(raw)), parts), is_emoji_code))


def matra_variants(native: Column) -> Column:
    """The word with one long i sign made short, for every such sign."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(native), F.lit(1))), lambda i: F.substring(native, i, F.lit(1)) == "ી")
    return F.transform(places, lambda i: F.overlay(native, F.lit("િ"), i, F.lit(1)))


def skeleton(roman: Column) -> Column:
    return F.translate(F.lower(roman), "aeiou", "")


def unigram_score(n: Column, largest: Column) -> Column:
    """log1p(n) / log1p(largest), zero where either is not positive."""
    return F.when((n > 0) & (largest > 0), F.log1p(n) / F.log1p(largest)).otherwise(0.0)


def user_boost(n: Column) -> Column:
    return F.when(n > 0, F.least(F.lit(0.9), F.log1p(n) / 3.5)).otherwise(0.0)
