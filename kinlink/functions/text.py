"""Normalising names and addresses, as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions.lexicon import ABBR, ADDR_STOP, DIGITS_AS_LETTERS, LEGAL, SOUNDS


@cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: those with one such character, it, and those with more."""
    single, to, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        d = unicodedata.normalize("NFKD", c)
        if d != c and (plain := d.encode("ascii", "ignore").decode()):
            if len(plain) == 1:
                single.append(c)
                to.append(plain)
            else:
                several[c] = plain
    return "".join(single), "".join(to), several


def fold_ascii(s: Column) -> Column:
    """NFKD without what is not ASCII."""
    single, to, several = _folds()
    rare = "[" + "".join(several) + "]"
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    spelled = F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    known = F.translate(F.when(s.rlike(rare), spelled).otherwise(s), single, to)
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(F.regexp_replace(known, r"[^\x00-\x7F]", ""))


def words(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def normalize(s: Column) -> Column:
    """ASCII where there is any, lower case, & as a word, words of letters, digits and _, abbreviations spelled out once; null as empty."""
    s = F.coalesce(s.cast("string"), F.lit(""))
    plain = fold_ascii(s)
    low = F.replace(F.lower(F.when(plain == "", s).otherwise(plain)), F.lit("&"), F.lit(" and "))
    abbreviations = F.create_map(*(F.lit(x) for pair in ABBR.items() for x in pair))
    spelled = F.transform(words(F.regexp_replace(low, r"[^\p{L}\p{N}_ ]", " ")), lambda w: F.coalesce(F.try_element_at(abbreviations, w), w))
    return F.array_join(spelled, " ")


def core_name(name: Column) -> Column:
    """A normalised name without legal forms; the whole name if nothing else is in it."""
    kept = F.array_join(F.filter(words(name), lambda w: ~w.isin(*LEGAL)), " ")
    return F.when(kept == "", name).otherwise(kept)


def country(s: Column) -> Column:
    """Trimmed of white space and lowered; null as empty."""
    return F.lower(F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), r"^\s+|\s+$", ""))


def phonetics(tokens: Column) -> Column:
    """The sound codes of an array of tokens, one stage of the code after the other so that none is computed twice."""

    def sounds(t: Column) -> Column:
        for a, b in SOUNDS:
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    def letters(t: Column) -> Column:
        return F.regexp_replace(F.when(t.rlike("[a-z]"), F.translate(t, *DIGITS_AS_LETTERS)).otherwise(t), r"(.)\1+", "$1")

    def consonants(t: Column) -> Column:
        return F.concat(F.left(t, F.lit(1)), F.regexp_replace(F.substr(t, F.lit(2)), "[aeiou]", ""))

    return F.transform(F.transform(F.transform(tokens, sounds), letters), consonants)


def phonetic(token: Column) -> Column:
    return F.get(phonetics(F.array(token)), F.lit(0))


def number(token: Column) -> Column:
    """Without leading zeros; 0 if nothing is left."""
    return F.regexp_replace(F.regexp_replace(token, "^0+", ""), "^$", "0")


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def is_alpha(token: Column) -> Column:
    return token.rlike(r"^\p{L}+$")


def is_stop(token: Column) -> Column:
    return token.isin(*ADDR_STOP)


def digit_runs(s: Column) -> Column:
    """The distinct numbers among a text's runs of digits."""
    return F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"(\p{Nd}+)"), F.lit(1)), number))


def number_tokens(tokens: Column) -> Column:
    """The distinct tokens with a digit, as numbers, in order of first sight."""
    return F.array_distinct(F.transform(F.filter(tokens, has_digit), number))


def rare_words(tokens: Column) -> Column:
    """The distinct alphabetic words of five letters or more that are not stop words."""
    return F.array_distinct(F.filter(tokens, lambda w: (F.length(w) >= 5) & is_alpha(w) & ~is_stop(w)))


def initials(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda w: F.left(w, F.lit(1))), "")


def is_third_source(entity_id: Column) -> Column:
    return entity_id.startswith("S3")
