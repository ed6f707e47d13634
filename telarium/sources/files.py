"""Sources: page texts, projects in JSON, web records; and the sinks' writers."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page file of <path>/<issue>/*.txt: (numero, pagina, texto)."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("f", F.input_file_name())
    return x.select(F.regexp_extract("f", r"([^/]+)/[^/]+\.txt$", 1).alias("numero"), F.regexp_extract("f", r"([^/]+)\.txt$", 1).alias("pagina"), F.col("value").alias("texto"))


def issue_text(p: DataFrame) -> DataFrame:
    """The pages of an issue in their order, parted by blank lines."""
    return p.groupBy("numero").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pagina", "texto"))), lambda x: x["texto"]), "\n\n").alias("texto"))


def corpora(p: DataFrame, main: DataFrame) -> DataFrame:
    """One corpus a folder, blank ones dropped; the main corpus replaces a folder of its name."""
    both = p.select(F.col("numero").alias("corpus"), "texto", F.lit(1).alias("r")).unionByName(main.select("corpus", "texto", F.lit(0).alias("r")))
    best = both.where("trim(texto) <> ''").withColumn("m", F.min("r").over(_by("corpus")))
    return best.where("r = m").select("corpus", "texto")


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)


def project(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """Project documents (a file or a line each), their articles embedded as an array."""
    reader = spark.read.schema(schema) if schema else spark.read
    doc = reader.json(path, multiLine=not lines)
    rest = [c for c in doc.columns if c != "articulos"]
    return doc.select(*rest, F.posexplode("articulos").alias("posicion", "a")).select(*rest, "posicion", "a.*")


def page_metadata(ocr: DataFrame, earlier: DataFrame) -> DataFrame:
    """Words, method and review flag of each page; the method of an earlier table (id, metodo) is kept."""
    n = F.size(F.regexp_extract_all(F.coalesce("texto_crudo", F.lit("")), F.lit(r"([^\s]+)"), 1))
    x = ocr.join(earlier, "id", "left")
    return x.select("id", "articulo_id", n.alias("palabras"), F.coalesce(F.nullif("metodo", F.lit("")), F.lit("conversor")).alias("metodo"), F.coalesce(F.col("confianza") < 0.6, F.lit(False)).alias("revisar"))


_TAG = r"""(?i)<meta\b((?:[^<>"']|"[^"]*"|'[^']*')*)>"""
_ATTRIBUTE = r"""([\p{L}\p{N}:_.-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""


def _attributes(tag: Column) -> Column:
    """Map of a tag's attributes, in any order and with any or no quotes; of equal ones the first holds, as browsers have it."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), lambda x: F.lower(x))
    values = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2), lambda x: F.when(x.rlike("^[\"']"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(first)


def meta_tags(html: Column) -> Column:
    """Map of name or property to content; each tag is taken whole, then its attributes are read. The last of a name wins."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(_TAG), 1), _attributes)
    get = lambda m, *ks: F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in ks))
    pairs = F.transform(tags, lambda m: F.struct(F.lower(get(m, "name", "property")).alias("k"), get(m, "content").alias("v")))
    pairs = F.filter(pairs, lambda x: x["k"].isNotNull() & x["v"].isNotNull())
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def clean_html(c: Column) -> Column:
    """Tags dropped, entities decoded, white space collapsed."""
    c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def metadata(df: DataFrame, html: str) -> DataFrame:
    """Title, author, date and language by precedence of the notations."""
    m = F.col("m")
    # what stands between the title's tags
    title = F.regexp_replace(F.regexp_substr(html, F.lit(r"(?i)<title\b[^<]*")), r"(?i)^<title\b[^>]*>", "")
    first = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in ks])
    x = df.withColumn("m", meta_tags(F.col(html))).withColumn("t", clean_html(title))
    return x.select(
        *[c for c in df.columns if c != html],
        F.coalesce(first("citation_title", "dc.title", "og:title"), F.nullif(F.col("t"), F.lit(""))).alias("titulo"),
        first("citation_author", "dc.creator", "author").alias("autor"), first("citation_date", "dc.date").alias("fecha"), first("dc.language", "language").alias("lengua"),
    )


def by_precedence(df: DataFrame, oai: str, html: str) -> DataFrame:
    """Title, author, date and origin; harvested record, then linked data of the page, then its tags."""
    m = F.col("m")
    tag = lambda name: F.nullif(clean_html(F.regexp_extract(F.coalesce(oai, F.lit("")), f"<dc:{name}>([^<]*)</dc:{name}>", 1)), F.lit(""))
    block = F.regexp_extract(html, r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script""", 1)
    ld = lambda path: F.nullif(F.get_json_object("ld", f"$.{path}"), F.lit(""))
    own = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in ks])
    x = df.withColumn("m", meta_tags(F.col(html))).withColumn("ld", block)
    head = F.nullif(clean_html(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)", 1)), F.lit(""))
    title = F.coalesce(tag("title"), ld("name"), ld("headline"), own("citation_title", "dc.title", "og:title"), head)
    author = F.coalesce(tag("creator"), ld("author.name"), own("citation_author", "dc.creator", "author"))
    date = F.coalesce(tag("date"), ld("datePublished"), own("citation_date", "dc.date", "date"))
    origin = F.when(tag("title").isNotNull(), "oai").when(ld("name").isNotNull(), "json-ld").otherwise("html")
    return x.select(*[c for c in df.columns if c not in (oai, html)], title.alias("titulo"), author.alias("autor"), date.alias("fecha"), origin.alias("origen"))


def write_lines(df: DataFrame, column: str, path: str, header: str = "", footer: str = "") -> None:
    """Sink of text formats: lines stream through the driver into one file, without holding them."""
    with open(path, "w", encoding="utf-8") as f:
        if header:
            f.write(header + "\n")
        for row in df.select(column).toLocalIterator():
            f.write(row[0] + "\n")
        if footer:
            f.write(footer + "\n")


def write_csv(df: DataFrame, path: str) -> None:
    """Sink of CSV with header, in as many files as the plan has partitions."""
    df.write.mode("overwrite").csv(path, header=True)


def write_manifest(path: str, kind: str, digest: str, sources: list[str], warnings: list[str]) -> None:
    """A side-car file with the origin of an export."""
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump({"formato": kind, "hash": digest, "fuentes": sources, "avisos": warnings, "archivo": os.path.basename(path)}, f, ensure_ascii=False, indent=1)
