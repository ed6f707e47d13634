"""Cleaning of recognised text and rules over pages and lines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def level(c: Column) -> Column:
    """Traffic light of a confidence."""
    return F.when(c >= 0.75, "verde").when(c >= 0.45, "amarillo").otherwise("rojo")


def state() -> Column:
    """P20: the best layer of a page."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(has("texto_limpio"), "limpio").when(has("texto_crudo"), "crudo").otherwise("ninguno")


def spacing(c: Column) -> Column:
    """single spaces, none before punctuation, one blank line at most."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), " ([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def preclean(c: Column) -> Column:
    """hyphens at line ends, spaces, lone page numbers, blank lines."""
    c = F.regexp_replace(c, r"([\p{L}])[-¬]\n([\p{L}])", "$1$2")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?m)^ ?\d{1,3} ?$", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalise(c: Column) -> Column:
    """the fixed order of the normalisation."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = F.regexp_replace(c, r"([\p{L}])[-¬]\n([\p{Ll}])", "$1$2")
    c = F.regexp_replace(c, r"([\p{L}])0([\p{L}])", "$1o$2")
    c = F.translate(c, "ﬁ‘’“”", "f''\"\"")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def dictionary(df: DataFrame, text: str, least: int) -> DataFrame:
    """F8: words of four letters with at least `least` occurrences."""
    w = df.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), 1)).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def clean_lines(c: Column) -> Column:
    """P10: stamps and lines with few letters dropped."""
    letters = lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", ""))
    keep = lambda x: ~(F.lower(x).contains("copia digital") | F.lower(x).contains("reproducción digital")) & ~((F.length(x) > 5) & (letters(x) / F.greatest(F.length(x), F.lit(1)) < 0.3))
    return F.array_join(F.filter(F.split(c, "\n"), keep), "\n")


def page_type(c: Column) -> Column:
    """Ordered rules over words and lines."""
    low = F.lower(c)
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"\d+\s*$")))
    n = F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), 1))
    return (
        F.when(n < 20, "vacia")
        .when(low.rlike(r"\b(director|redactor)\b[^\n]{0,40}\b(administrador|gerente)\b"), "creditos")
        .when((F.size(lines) >= 5) & (numbered >= 0.3 * F.size(lines)), "indice")
        .when(F.regexp_count(low, F.lit("pesos")) >= 4, "anuncios")
        .otherwise("normal")
    )


def title(c: Column) -> Column:
    """Capitals, else a capitalised line, else the first line."""
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 30)
    long = lambda x: F.regexp_extract_all(x, F.lit(r"(\p{L}{3,})"), 1)
    caps = lambda x: F.size(F.split(x, " ")).between(2, 12) & (F.size(long(x)) > 0) & (F.size(F.filter(long(x), lambda w: w == F.upper(w))) >= 0.7 * F.size(long(x)))
    firsts = F.filter(F.slice(lines, 1, 8), lambda x: x.rlike(r"^\p{Lu}") & ~x.rlike("[.,;:]$"))
    return F.coalesce(F.get(F.filter(lines, caps), F.lit(0)), F.get(firsts, F.lit(0)), F.get(lines, F.lit(0)))


def iso_date(c: Column) -> Column:
    """a year, month or day in ISO form as a full date."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)


def quotations(docs: DataFrame) -> DataFrame:
    """quoted passages of 20 to 500 characters and five words."""
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), 1) for p in ("«([^«»]{20,500})»", "“([^“”]{20,500})”")))
    enough = lambda x: F.size(F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ")) >= 5
    return docs.where("text is not null").select("doc_id", F.explode(F.filter(found, enough)).alias("cita"))


def join_hyphens(c: Column) -> Column:
    """A hyphen before a break, with up to four blank lines between; neighbours on both sides stay in place."""
    return F.regexp_replace(c, r"(?<=\p{L})[-¬][ \t\r]*\n(?:[ \t\r]*\n){0,4}[ \t\r]*(?=\p{L})", "")


@pandas_udf(StringType())
def rebuild_lines(s: pd.Series) -> pd.Series:
    """Lines flow together until a blank line, a heading or the end of a sentence before a capital."""

    def one(t: str) -> str:
        out: list[str] = []
        buffer = ""
        for line in (x.strip() for x in t.split("\n")):
            heading = bool(line) and line.upper() == line and any(ch.isalpha() for ch in line)
            if not line or heading:
                out += [x for x in (buffer, line) if x]
                buffer = ""
            elif buffer and buffer[-1] in ".!?" and line[:1].isupper() and len(buffer) > 200:
                out.append(buffer)
                buffer = line
            elif buffer.endswith("-"):
                buffer = buffer[:-1] + line
            else:
                buffer = f"{buffer} {line}".strip()
        return "\n".join([*out, buffer] if buffer else out)

    return s.map(one)


def respell(c: Column, rules: dict[str, str]) -> Column:
    """whole words of old spelling become their present forms, in the order of the rules (an argument, not data)."""
    for old, new in rules.items():
        c = F.regexp_replace(c, rf"(?<!\p{{L}}){re.escape(old)}(?!\p{{L}})", new)
    return c


def replace_word(c: Column, old: str, new: str, nth: int | None = None) -> Column:
    """every whole-word hit, or only the nth; a text with fewer hits stays as it is."""
    word = rf"(?<!\p{{L}}){re.escape(old)}(?!\p{{L}})"
    if nth is None:
        return F.regexp_replace(c, word, new)
    return F.regexp_replace(c, rf"(?s)\A((?:.*?{word}){{{nth - 1}}}.*?){word}", rf"$1{new}")


def lemmatise(words: DataFrame, table: dict[str, str]) -> DataFrame:
    """adds lema and origen to distinct words `w`."""
    made = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    found = F.try_element_at(made, F.lower("w"))
    return words.withColumn("lema", F.coalesce(found, F.lower("w"))).withColumn("origen", F.when(found.isNotNull(), "excepcion").otherwise("original"))
