"""Roman to Gujarati by rule: greedy tokens, vowel signs and the conjuncts of a policy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VIRAMA, ANUSVARA = "્", "ં"

# Each roman token's independent letter and vowel sign.
VOWELS = {
    "a": ("અ", ""), "aa": ("આ", "ા"), "i": ("ઇ", "િ"), "ee": ("ઈ", "ી"), "ii": ("ઈ", "ી"), "u": ("ઉ", "ુ"),
    "oo": ("ઊ", "ૂ"), "uu": ("ઊ", "ૂ"), "R": ("ઋ", "ૃ"), "RR": ("ૠ", "ૄ"), "E": ("ઍ", "ૅ"), "e": ("એ", "ે"),
    "ai": ("ઐ", "ૈ"), "O": ("ઑ", "ૉ"), "o": ("ઓ", "ો"), "au": ("ઔ", "ૌ"), "M": ("ં", "ં"), "H": ("ઃ", "ઃ"),
}
# Consonants and clusters that are one token.
CONSONANTS = {
    "k": "ક", "kh": "ખ", "g": "ગ", "gh": "ઘ", "ng": "ઙ", "c": "ચ", "ch": "ચ", "chh": "છ", "j": "જ", "jh": "ઝ", "ny": "ઞ",
    "T": "ટ", "Th": "ઠ", "D": "ડ", "Dh": "ઢ", "N": "ણ", "t": "ત", "th": "થ", "d": "દ", "dh": "ધ", "n": "ન",
    "p": "પ", "ph": "ફ", "f": "ફ", "b": "બ", "bh": "ભ", "m": "મ", "y": "ય", "r": "ર", "l": "લ", "L": "ળ", "v": "વ", "w": "વ",
    "sh": "શ", "Sh": "ષ", "s": "સ", "h": "હ", "x": "ક્ષ", "ksh": "ક્ષ", "gy": "જ્ઞ", "gn": "જ્ઞ", "gny": "જ્ઞ", "jny": "જ્ઞ",
    "dv": "દ્વ", "shr": "શ્ર", "tr": "ત્ર", "sth": "સ્થ", "str": "સ્ત્ર", "z": "ઝ", "om": "ૐ",
}
# Consonants that join the one before them, and the trial family.
CONJUNCTS = (
    "v|y", "k|y", "g|y", "c|y", "ch|y", "j|y", "t|y", "d|y", "n|y", "p|y", "b|y", "m|y", "r|y", "l|y", "s|y", "sh|y", "h|y", "T|y", "D|y", "p|r",
    "t|r", "k|r", "g|r", "d|r", "b|r", "s|r", "sh|r", "f|r", "ph|r", "k|v", "t|v", "d|v", "s|v", "n|v", "dh|v", "t|n", "s|n", "s|t", "s|k", "s|th",
    "t|th",
)
TRIAL_CONJUNCTS = (
    "m|p", "t|k", "r|sh", "r|th", "l|p", "n|d", "n|dh", "k|t",
)

DIGITS = {str(d): chr(0x0AE6 + d) for d in range(10)}
TOKEN = re.compile("|".join(sorted((re.escape(t) for t in [*VOWELS, *CONSONANTS, "+"]), key=len, reverse=True)) + "|.", re.DOTALL)
BARE = re.compile("[ક-રલળવ-હ]\\Z")
NUMBER = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|[0-9]*\.[0-9]+)\Z")


def tokens(roman: str) -> list[str]:
    """Longest tokens from the left; other characters stand alone."""
    return TOKEN.findall(roman)


class Transliterator:
    """Transliteration under a set of conjunct pairs ``left|right``."""

    def __init__(self, conjuncts: Iterable[str] = (*CONJUNCTS, *TRIAL_CONJUNCTS)):
        self.joins = {tuple(pair.split("|")) for pair in conjuncts}

    def __call__(self, roman: str) -> str:
        row = tokens(roman)
        out = ""
        for here, after in zip(row, [*row[1:], ""], strict=False):
            if here in VOWELS:
                alone, sign = VOWELS[here]
                out += sign if BARE.search(out) else alone
            elif here in CONSONANTS:
                joined = after == "+" or (here, after) in self.joins
                out += CONSONANTS[here] + (VIRAMA if joined else "")
            elif here == "+":
                out += VIRAMA if BARE.search(out) else ""
            else:
                out += DIGITS.get(here, here)
        return out

    def split_vowels(self, roman: str) -> list[str]:
        """Spellings in which a typed diphthong is a vowel sign and an independent i, or a and y.

        At most three places of each diphthong count. One that opens the word has fixed nuclei for
        ai and ay; one after a vowel has none.
        """
        text, found = roman.lower(), []
        for pair in ("ai", "ay", "oi", "ui", "ei"):
            places = 0
            for m in re.finditer(f"(?={pair})", text):
                if places == 3:
                    break
                if pair == "ai" and text[: m.start()].endswith("a"):
                    continue
                nuclei = self._nuclei(pair, self(text[: m.start()]))
                places += bool(nuclei)
                rest = self(text[m.start() + 2 :])
                found += [n + rest for n in nuclei]
        return found

    @staticmethod
    def _nuclei(pair: str, before: str) -> list[str]:
        if not before:
            return {"ai": ["ઐ", "અઈ", "અઇ", "આઈ", "આઇ"], "ay": ["અય", "આય"]}.get(pair, [])
        if not BARE.search(before):
            return []
        signs = {"ai": ["", "ા"], "ay": ["", "ા"], "oi": ["ો"], "ui": ["ુ", "ૂ"], "ei": ["ે"]}[pair]
        return [before + sign + end for sign in signs for end in (["ય"] if pair == "ay" else ["ઈ", "ઇ"])]

    def forms(self, roman: str) -> list[str]:
        """The base form, split vowels, and each with a nasal after a final u; no repeats, not the input.

        Western numbers stay as they are.
        """
        if NUMBER.match(roman):
            return [roman]
        each = [x for form in [self(roman), *self.split_vowels(roman)] for x in (form, nasal_u(form))]
        return [x for x in dict.fromkeys(each) if x and x != roman]


def nasal_u(native: str) -> str | None:
    return native + ANUSVARA if native.endswith("ુ") else None


def _column(fn: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def apply(text: pd.Series) -> pd.Series:
        return text.map(fn, na_action="ignore")

    return apply


def transliterate(roman: Column, conjuncts: Iterable[str] = (*CONJUNCTS, *TRIAL_CONJUNCTS)) -> Column:
    """The base form in Arrow batches; null stays null."""
    return _column(Transliterator(conjuncts), "string")(roman)


def phonetic_forms(roman: Column, conjuncts: Iterable[str] = (*CONJUNCTS, *TRIAL_CONJUNCTS)) -> Column:
    """All script forms of a roman text, in order."""
    return _column(Transliterator(conjuncts).forms, "array<string>")(roman)
