"""Word stems (Porter, 1980) and folding as column expressions, with the same rules as DuckDB SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# a word is runs of consonants and vowels; y is a vowel after a consonant, and a consonant as the first letter (written Y here)
RUN_C, RUN_V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME = f"^(?:{RUN_C})?{RUN_V}{RUN_C}"  # one or more pairs of a vowel run and a consonant run
ONE = f"^(?:{RUN_C})?{RUN_V}{RUN_C}(?:{RUN_V})?$"
MORE = f"^(?:{RUN_C})?{RUN_V}{RUN_C}{RUN_V}{RUN_C}"
VOWEL = f"^(?:{RUN_C})?[aeiouy]"
SHORT = f"^{RUN_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
# Suffixes and what stands for them.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()

TOKEN = "[\\p{L}\\p{N}\\x{300}-\\x{36f}]+"
BETWEEN = "[^\\p{L}\\p{N}\\x{300}-\\x{36f}]+"


def _folds() -> tuple[str, str]:
    """Small letters with marks and their base letters, then the marks, which have none."""
    pairs = []
    for code in (*range(0xDF, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and all(map(unicodedata.combining, marks)) and chr(code).lower() == chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def folded(word: Column) -> Column:
    """Lower case, without diacritics."""
    return F.translate(F.lower(word), MARKED, PLAIN)


class _Spark:
    """Steps of the rules as columns."""

    @staticmethod
    def matches(w: Column, pattern: str) -> Column:
        return w.rlike(pattern)

    @staticmethod
    def part(w: Column, pattern: str, k: int) -> Column:
        return F.regexp_extract(w, pattern, k)

    @staticmethod
    def choose(*cases: tuple, other: Column) -> Column:
        out = other
        for when, then in reversed(cases):
            out = F.when(when, then).otherwise(out)
        return out

    @staticmethod
    def join(a: Column, b: Column | str) -> Column:
        return F.concat(a, F.lit(b) if isinstance(b, str) else b)

    @staticmethod
    def cut(w: Column, n: int) -> Column:
        return F.substr(w, F.lit(1), F.length(w) - n)

    @staticmethod
    def both(a: Column, b: Column) -> Column:
        return a & b

    @staticmethod
    def negated(a: Column) -> Column:
        return ~a

    @staticmethod
    def named(w: Column, names: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), w)


class _Sql:
    """The same steps as DuckDB SQL."""

    matches = staticmethod(lambda w, pattern: f"regexp_matches({w}, '{pattern}')")
    part = staticmethod(lambda w, pattern, k: f"regexp_extract({w}, '{pattern}', {k})")
    choose = staticmethod(lambda *cases, other: "(case " + " ".join(f"when {a} then {b}" for a, b in cases) + f" else {other} end)")
    join = staticmethod(lambda a, b: f"({a} || {repr(b) if b.isalpha() else b})")
    cut = staticmethod(lambda w, n: f"substr({w}, 1, length({w}) - {n})")
    both = staticmethod(lambda a, b: f"({a} and {b})")
    negated = staticmethod(lambda a: f"not {a}")
    named = staticmethod(lambda w, names: f"(case {w} " + " ".join(f"when '{a}' then '{b}'" for a, b in names.items()) + " end)")


def steps(say: type) -> list:
    """The rules in order: each takes a word and gives the next."""
    suffixed = lambda names: f"^(.+?)({'|'.join(names)})$"

    def plural(w):
        return say.choose((say.matches(w, "^.+(?:ss|i)es$"), say.cut(w, 2)), (say.matches(w, "^.+[^s]s$"), say.cut(w, 1)), other=w)

    def past(w):
        stem = say.part(w, "^(.+?)(?:ed|ing)$", 1)
        again = say.choose(
            (say.matches(stem, "(?:at|bl|iz)$"), say.join(stem, "e")), (say.matches(stem, DOUBLE), say.cut(stem, 1)), (say.matches(stem, SHORT), say.join(stem, "e")), other=stem
        )
        agreed = say.choose((say.matches(say.part(w, "^(.+?)eed$", 1), SOME), say.cut(w, 1)), other=w)
        return say.choose((say.matches(w, "^.+eed$"), agreed), (say.matches(stem, VOWEL), again), other=w)

    def last_y(w):
        return say.choose((say.matches(say.part(w, "^(.+)y$", 1), VOWEL), say.join(say.cut(w, 1), "i")), other=w)

    def mapped(names):
        def step(w):
            pattern = suffixed(names)
            return say.choose((say.matches(say.part(w, pattern, 1), SOME), say.join(say.part(w, pattern, 1), say.named(say.part(w, pattern, 2), names))), other=w)

        return step

    def long_suffix(w):
        pattern, ion = suffixed(STEP_4), say.part(w, "^(.+?[st])ion$", 1)
        listed = say.choose((say.matches(say.part(w, pattern, 1), MORE), say.part(w, pattern, 1)), other=w)
        return say.choose((say.matches(w, pattern), listed), (say.matches(ion, MORE), ion), other=w)

    def last_e(w):
        stem = say.part(w, "^(.+)e$", 1)
        return say.choose((say.matches(stem, MORE), stem), (say.both(say.matches(stem, ONE), say.negated(say.matches(stem, SHORT))), stem), other=w)

    def double_l(w):
        return say.choose((say.both(say.matches(w, "ll$"), say.matches(w, MORE)), say.cut(w, 1)), other=w)

    return [plural, past, last_y, mapped(STEP_2), mapped(STEP_3), long_suffix, last_e, double_l]


def stems(words: Column) -> Column:
    """The stem of each folded word of an array; other words than of three or more letters a to z stay."""
    long = lambda w: w.rlike("^[a-z]{3,}$")
    out = F.transform(words, lambda w: F.struct(long(w).alias("long"), F.when(long(w), F.regexp_replace(w, "^y", "Y")).otherwise(w).alias("w")))
    # a step at a time over the array, so that no expression is repeated within another
    for step in steps(_Spark):
        out = F.transform(out, _each(step))
    return F.transform(out, lambda x: F.when(x["long"], F.regexp_replace(x["w"], "^Y", "y")).otherwise(x["w"]))


def _each(step):
    return lambda x: F.struct(x["long"].alias("long"), F.when(x["long"], step(x["w"])).otherwise(x["w"]).alias("w"))


def stem_sql(source: str) -> str:
    """A query (w, s) of the distinct words ``w`` of a source and their stems ``s``."""
    long = "regexp_matches(w, '^[a-z]{3,}$')"
    out = f"select w, case when {long} then regexp_replace(w, '^y', 'Y') else w end as s from ({source})"
    for step in steps(_Sql):
        out = f"select w, case when {long} then {step('s')} else s end as s from ({out})"
    return f"select w, case when {long} then regexp_replace(s, '^Y', 'y') else s end as s from ({out})"
