"""Scalar expressions over text; all stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "a-záéíóúüñ"
VOWELS = "aeiouáéíóúü"


def words(c: Column) -> Column:
    """Runs of letters, digits and underscores, lower case; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), F.array().cast("array<string>"))


def tokens(c: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """whole words of the Spanish alphabet with at least `least` letters, without stop words."""
    found = F.filter(words(c), lambda w: w.rlike(f"^[{LETTERS}]{{{least},}}$"))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def loose_tokens(c: Column, least: int = 4, stop: list[str] | None = None) -> Column:
    """letter runs without word bounds, of three letters at least, then of `least`."""
    found = F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"([{LETTERS}]{{3,}})"), 1), lambda w: F.length(w) >= least)
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def space_count(c: Column) -> Column:
    """Number of tokens parted by white space, 0 for null or blank."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s]+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def occurrences(c: Column, term: str) -> Column:
    """Substring occurrences that don't overlap."""
    return (F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / F.lit(len(term))


def unaccented(c: Column) -> Column:
    return F.translate(c, "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc")


_MARKED = {chr(i): unicodedata.normalize("NFD", chr(i)) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for i in range(a, b)}
_MARKED = {c: x[0] for c, x in _MARKED.items() if len(x) > 1 and all(map(unicodedata.combining, x[1:]))}


def stripped(c: Column) -> Column:
    """Latin letters of both cases without any of their accents, composed or combining."""
    return F.regexp_replace(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")


def plain(c: Column) -> Column:
    """lower case without accents, single spaces."""
    low = unaccented(F.lower(c))
    return F.trim(F.regexp_replace(low, r"[\s\x{00A0}]+", " "))


def slug(c: Column, joint: str, empty: str) -> Column:
    """letters and digits of the plain name, the rest a joint."""
    s = F.regexp_replace(plain(c), "[^a-z0-9]+", joint)
    s = F.regexp_replace(s, f"^{joint}+|{joint}+$", "")
    return F.when(s == "", empty).otherwise(F.coalesce(s, F.lit(empty)))


def alphabetic_ratio(c: Column) -> Column:
    """share of letters and spaces."""
    return F.length(F.regexp_replace(c, r"[^\p{L} ]", "")) / F.nullif(F.length(c), F.lit(0))
