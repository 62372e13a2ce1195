"""Text functions as column expressions; nothing here runs Python on the executors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from passageworks.functions.wordlists import FOLD_FROM, FOLD_TO, IRREGULAR_FORMS, KEEP_WORDS, STOP_STEMS, SUFFIXES

#: Runs of letters, joined by one inner apostrophe or hyphen.
WORD = r"\p{IsAlphabetic}+(?:['’-]\p{IsAlphabetic}+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalize(word: Column) -> Column:
    """One possessive ending off, lower case, accents folded; whatever is still not a-z or 0-9 goes."""
    bare = F.regexp_replace(word, "['’][sS]$", "")
    folded = F.regexp_replace(F.translate(F.lower(bare), FOLD_FROM, FOLD_TO), "[^a-z0-9]", "")
    # never null (null counts as empty): else filters for nulls are worked out on every word below a join
    return F.coalesce(F.when(word.rlike("^[A-Za-z0-9]*$"), F.lower(word)).otherwise(folded), F.lit(""))


def finish(base: Column) -> Column:
    """A doubled final consonant is halved (from four letters), then a final e goes (over three), then a final i turns y (over two)."""
    single = F.regexp_replace(base, r"^(.{2,})([bdgmnprt])\2$", "$1$2")
    return F.regexp_replace(F.regexp_replace(single, "^(.{3,})e$", "$1"), "^(.{2,})i$", "$1y")


#: One alternative for each ending, in order: three letters stay at least, among them a vowel; a bare s stays after s, u and i.
ENDING = "^(?:" + "|".join(f"(?=.*[aeiouy].*{s}$)({'.{2,}[^sui]' if s == 's' else '.{3,}'}){s}" for s in SUFFIXES) + ")$"
ANY_ENDING = "(?:" + "|".join(SUFFIXES) + ")$"
KEPT_PART = "".join(f"${k}" for k in range(1, len(SUFFIXES) + 1))


def stem(norm: Column) -> Column:
    """Stem of a normalised word: irregular forms, kept and short words, then the first ending that leaves a stem."""
    irregular = F.create_map(*(F.lit(x) for pair in IRREGULAR_FORMS.items() for x in pair))
    listed = norm.isin(list(IRREGULAR_FORMS))
    ended = F.when(norm.rlike(ANY_ENDING), F.regexp_replace(norm, ENDING, KEPT_PART)).otherwise(norm)
    base = F.when(listed, F.element_at(irregular, norm)).otherwise(ended)
    return F.coalesce(F.when(~listed & ((F.length(norm) <= 3) | norm.isin(KEEP_WORDS)), norm).otherwise(finish(base)), F.lit(""))


def stems_among(text: Column, asked: list[str]) -> Column:
    """The stems of a text's words that are among a few, in word order, with repeats.

    A stem is its word's beginning, but for its last letter, unless the word is irregular: all other words are not stemmed.
    """
    norms = F.transform(words(text), normalize)
    begun = lambda n: reduce(or_, (n.startswith(s[:-1]) for s in asked), n.isin(list(IRREGULAR_FORMS)))
    return F.filter(F.transform(F.filter(norms, begun), stem), lambda s: s.isin(asked))


def is_stop(stemmed: Column) -> Column:
    return stemmed.isin(STOP_STEMS)


def flatten(text: Column) -> Column:
    """Normalised words between single spaces, for phrase containment."""
    return F.concat(F.lit(" "), F.array_join(F.transform(words(text), lambda w: F.concat(normalize(w), F.lit(" "))), ""))


def concept_code(text: Column) -> Column:
    """H or G and 1 to 9999 as an upper-case code without leading zeros, else null."""
    number = F.regexp_extract(text, r"^[HhGg]\+?0*([1-9][0-9]{0,3})$", 1)
    return F.when(number != "", F.concat(F.upper(F.substring(text, 1, 1)), number))


def squash(name: Column) -> Column:
    """Lower-case letters and digits; a leading roman or spelled ordinal and a space become its digit."""
    low = F.lower(name)
    bare = F.regexp_replace(low, r"[^\p{IsAlphabetic}\p{IsDigit}]", "")
    out = bare
    for spelled, digit in reversed((("iii", "3"), ("ii", "2"), ("i", "1"), ("first", "1"), ("second", "2"), ("third", "3"))):
        out = F.when(low.startswith(f"{spelled} "), F.concat(F.lit(digit), F.substr(bare, F.lit(len(spelled) + 1)))).otherwise(out)
    return out


def within(a: Column, b: Column, most: int) -> Column:
    """Edit distance with adjacent swaps (each stretch edited once), or null past ``most``.

    A bounded Levenshtein distance is tested first: a swap costs it two at most. Only pairs that pass run
    the row-by-row recurrence.
    """
    letters_a, letters_b = F.split(a, ""), F.split(b, "")
    n = F.length(b)
    first = F.sequence(F.lit(0), n)

    def row(state: Column, i: Column) -> Column:
        here, last = state["last"], state["before"]
        letter, previous = F.get(letters_a, i - 1), F.get(letters_a, i - 2)

        def cell(out: Column, j: Column) -> Column:
            cost = F.when(letter == F.get(letters_b, j - 1), 0).otherwise(1)
            plain = F.least(F.get(here, j) + 1, F.get(out, j - 1) + 1, F.get(here, j - 1) + cost)
            swapped = (i > 1) & (j > 1) & (letter == F.get(letters_b, j - 2)) & (previous == F.get(letters_b, j - 1))
            return F.concat(out, F.array(F.when(swapped, F.least(plain, F.get(last, j - 2) + 1)).otherwise(plain)))

        made = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.array(i), cell)
        return F.struct(made.alias("last"), here.alias("before"))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    distance = F.aggregate(rows, F.struct(first.alias("last"), first.alias("before")), row, lambda s: F.get(s["last"], n))
    near = (F.abs(F.length(a) - n) <= most) & (F.levenshtein(a, b, 2 * most) >= 0)
    return F.when(near, F.when(distance <= most, distance))
