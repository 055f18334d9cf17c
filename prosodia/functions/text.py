"""Text: normalisation, syllables, stress marks, vowels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from prosodia.functions.deferred import arrow_function

# Fixed values of the Russian alphabet: vowels, and consonants by falling sonority.
VOWELS = "аеёиоуыэюя"
SONORITY = {"лмнрй": 3, "бвгджз": 2, "кпстфхцчшщ": 1, "ьъ": 0}
SOFTENERS = "ьъ"
ACUTE = "́"
#: Vowels that are expected to weaken, those that scores look at, and all of them in the order of their test.
REDUCIBLE, SCORED = "аоеяи", "аоеия"

#: A Latin alphabet for the same rules.
LATIN_VOWELS = "aeiouyäöüáéíóúàèêëïîôûâùœæ"
LATIN_SONORITY = {"lmnrjw": 3, "bvgdz": 2, "kptsfhcqxßçñ": 1}


def has_vowel(s: Column, vowels: str = VOWELS) -> Column:
    return F.lower(s).rlike(f"[{vowels}]")


def clean_word(s: Column, letters: str = "а-яёА-ЯЁ") -> Column:
    """Only the given letters, lower-cased."""
    return F.lower(F.regexp_replace(s, f"[^{letters}]", ""))


def clean_recognised(s: Column) -> Column:
    """A recogniser's token: trimmed, lower-cased, only digits, Latin and Russian letters and hyphens."""
    return F.regexp_replace(F.lower(F.trim(s)), "[^0-9a-zа-яё-]", "")


def spaced_words(s: Column) -> Column:
    """Words of a reference: what is neither letter, digit, underscore nor space parts them, hyphens too."""
    return F.filter(F.split(F.lower(F.regexp_replace(s, r"(?U)[^\w\s]", " ")), r"(?U)\s+"), lambda w: w != "")


def found_words(s: Column) -> Column:
    """Words of an error rate: ё is е, runs of digits, Latin and Russian letters and hyphens."""
    return F.regexp_extract_all(F.translate(F.lower(s), "ё", "е"), F.lit("([0-9a-zа-я-]+)"), 1)


def vowel_count(s: Column, vowels: str = VOWELS) -> Column:
    return F.regexp_count(F.lower(s), F.lit(f"[{vowels}]"))


def main_vowel(s: Column, vowels: str = VOWELS) -> Column:
    """The first vowel of the set, or null."""
    return F.nullif(F.regexp_extract(F.lower(s), f"[{vowels}]", 0), F.lit(""))


def nucleus_count(text_count: Column, word: Column, syllable_count: Column, vowels: str = VOWELS) -> Column:
    """The stored count, else the vowels of the word, else the stored number of syllables, else 0."""
    return F.coalesce(F.when(text_count.isNotNull(), F.greatest(text_count, F.lit(0))), F.when(F.coalesce(word, F.lit("")) != "", vowel_count(word, vowels)), syllable_count, F.lit(0))


def grid_quote(s: Column) -> Column:
    """Text for an annotation grid: quotes doubled, line ends as spaces."""
    return F.replace(F.regexp_replace(s, r"\r\n|\r|\n", " "), F.lit('"'), F.lit('""'))


def span_bounds(syllables: Column) -> Column:
    """Start and end character of each syllable in its word."""
    step = lambda acc, s: F.concat(acc, F.array(F.struct(F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)).alias("start"), (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)) + F.char_length(s)).alias("end"))))
    return F.aggregate(syllables, F.expr("cast(array() as array<struct<start:int,end:int>>)"), step)


def split_syllables(word: str, vowels: str = VOWELS, sonority: dict[str, int] = SONORITY, softeners: str = SOFTENERS) -> list[str]:
    """Syllables by rising sonority: between two vowels the split comes before the longest strictly rising onset.

    A word of at most one vowel is one syllable; neighbouring vowels part; a softener stays with the consonant before it.
    """
    level = {c: v for group, v in sonority.items() for c in group}
    low = word.lower()
    at = [i for i, c in enumerate(low) if c in vowels]
    if len(at) < 2:
        return [word]
    cuts = [0]
    for left, right in zip(at, at[1:], strict=False):
        units: list[int] = []  # first character of each consonant with what softens it
        for i in range(left + 1, right):
            if not (units and low[i] in softeners and low[i - 1] not in softeners):
                units.append(i)
        cut = right
        if units:
            k = len(units) - 1
            while k and level.get(low[units[k - 1]], 0) < level.get(low[units[k]], 0):
                k -= 1
            cut = units[k]
        cuts.append(cut)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]


@arrow_function("array<string>")
def syllables(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else split_syllables(w))


@arrow_function("array<string>")
def latin_syllables(word: pd.Series) -> pd.Series:
    return word.map(lambda w: None if w is None else split_syllables(w, LATIN_VOWELS, LATIN_SONORITY, ""))


def stress_index(accented: str, units: list[str], vowels: str = VOWELS) -> int:
    """The stressed syllable by marks in an accented form, -1 if there are none.

    One syllable is 0. A combining acute after a vowel wins over ``+`` before (or else after) one, and that over ``ё``.
    """
    if len(units) <= 1:
        return 0
    low = unicodedata.normalize("NFD", accented.lower()).replace("й", "й").replace("ё", "ё")
    bare, acute, plus, yo = 0, None, None, None
    pending = False
    for i, c in enumerate(low):
        if c in vowels:
            nxt = low[i + 1] if i + 1 < len(low) else ""
            if nxt == ACUTE and acute is None:
                acute = bare
            if plus is None and (pending or (nxt == "+" and (low[i + 2] if i + 2 < len(low) else "") not in vowels)):
                plus = bare
            if c == "ё" and yo is None:
                yo = bare
            bare += 1
        pending = c == "+"
    vowel = next((v for v in (acute, plus, yo) if v is not None), None)
    if vowel is None:
        return -1
    seen = 0
    for k, u in enumerate(units):
        seen += sum(c in vowels for c in u.lower())
        if vowel < seen:
            return k
    return -1


@arrow_function("int")
def stressed_syllable(accented: pd.Series, units: pd.Series) -> pd.Series:
    return pd.Series([-1 if a is None or u is None else stress_index(a, list(u)) for a, u in zip(accented, units, strict=True)])


def manual_stress(labels: Column) -> Column:
    """The position of the one label with ``+``, an acute or ``ё``; null for none or several."""
    marked = F.filter(F.transform(labels, lambda s, i: F.when(F.lower(s).rlike(f"[+{ACUTE}´ё]"), i)), lambda i: i.isNotNull())
    return F.when(F.size(marked) == 1, F.get(marked, F.lit(0)))


def joined_syllables(units: Column) -> Column:
    return F.array_join(units, "-")


# Fixed hint texts of reports.
HINTS = {
    "duration": "слог «%s» слишком длинный (%.0f%% от ударного)",
    "energy": "слог «%s» слишком громкий (%.0f%% от ударного)",
    "quality": "гласный в слоге «%s» недостаточно редуцирован",
    "substitution": "ожидалось «%s», прозвучало «%s»",
    "deletion": "пропущен слог «%s»",
    "insertion": "лишний слог «%s»",
}


def hint(kind: str, *values: Column) -> Column:
    return F.format_string(HINTS[kind], *values)
