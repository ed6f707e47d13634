"""Mentions consolidated into canonical entities, their confidence and links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from telarium.functions import text as T


def canonical(ents: DataFrame) -> DataFrame:
    """One row a type and normal name; partial aggregation keeps a hot name cheap."""
    x = ents.withColumn("norma", T.plain(F.col("texto")))
    qid = F.max_by(F.when(F.col("wikidata_id") != "", F.col("wikidata_id")), F.when(F.col("wikidata_id") != "", F.col("id")))
    c = x.groupBy("categoria", "norma").agg(F.max_by("texto", "id").alias("nombre"), qid.alias("wikidata"), F.count(F.lit(1)).alias("menciones"), F.countDistinct("articulo_id").alias("articulos"))
    return c.withColumn("canonica", F.concat(F.col("categoria"), F.lit(":"), T.slug(F.col("norma"), "-", "sin-nombre")))


def confidence(ents: DataFrame) -> DataFrame:
    """Mentions with `p`, the weighted mean of confidence, link and number of articles."""
    x = ents.withColumn("norma", T.plain(F.col("texto")))
    k = x.groupBy("categoria", "norma").agg(F.countDistinct("articulo_id").alias("n"))
    j = x.join(k, ["categoria", "norma"])
    linked = F.coalesce(F.col("wikidata_id") != "", F.lit(False))
    value = F.coalesce(0.3 * F.col("confianza"), F.lit(0.0)) + F.when(linked, 0.25).otherwise(0.0) + 0.45 * F.least(F.lit(1.0), F.col("n") / 4.0)
    weight = F.when(F.col("confianza").isNotNull(), 0.3).otherwise(0.0) + F.when(linked, 0.25).otherwise(0.0) + 0.45
    return j.withColumn("p", F.when(F.col("verificada") == 1, 1.0).otherwise(value / weight))


def vocabulary(aut: DataFrame, cache: DataFrame, rev: DataFrame) -> DataFrame:
    """Terms of three sources; a definition wins, then the order of the sources."""
    about = F.get_json_object("resultado", "$.description")
    v = (
        aut.select(F.lower("texto_norm").alias("termino"), "categoria", F.col("descripcion").alias("definicion"), F.lit(1).alias("fuente"))
        .unionByName(cache.select(F.lower("texto").alias("termino"), "categoria", about.alias("definicion"), F.lit(2).alias("fuente")))
        .unionByName(rev.select(F.lower("nombre").alias("termino"), "categoria", F.lit(None).cast("string").alias("definicion"), F.lit(3).alias("fuente")))
    )
    order = Window.partitionBy("termino", "categoria").orderBy((F.coalesce("definicion", F.lit("")) == "").cast("int"), "fuente", F.col("definicion").asc_nulls_last())
    return v.withColumn("p", F.row_number().over(order)).where("p = 1").drop("p")


def recognise(docs: DataFrame) -> DataFrame:
    """runs of capitalised words."""
    found = F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}+(?: (?:de |del |la )?\p{Lu}\p{Ll}+){1,20})"), 1)
    return docs.where("text is not null").select("doc_id", F.explode(found).alias("texto"))


def align(t: Column, a: Column, b: Column) -> Column:
    """the span moved out to the limits of the words it touches, by the runs of letters and digits at its ends."""
    at = lambda x: F.greatest(F.lit(0), F.least(x.cast("int"), F.length(t)))
    before = F.regexp_extract(F.substring(t, F.lit(1), at(a)), r"([\p{L}\p{N}]*)\z", 1)
    after = F.regexp_extract(F.substring(t, at(b) + 1, F.length(t)), r"\A([\p{L}\p{N}]*)", 1)
    return F.struct((at(a) - F.length(before)).alias("inicio"), (at(b) + F.length(after)).alias("fin"))


def link_scores(cache: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """score of the cached candidates."""
    r = F.from_json("resultado", "id string, label string, description string, confianza double")
    x = cache.where("resultado is not null").select("texto", "categoria", r.alias("r")).where("r.label is not null")
    label, text = F.lower("r.label"), F.lower("texto")
    match: Column = F.when(label == text, 2.0).otherwise(1.0 - F.least(F.lit(1.0), F.levenshtein(T.unaccented(label), T.unaccented(text)) / 20.0))
    score = match + F.when(F.coalesce("r.description", F.lit("")) != "", 0.5).otherwise(0.0) + F.coalesce("r.confianza", F.lit(0.0))
    return x.select("texto", "categoria", *([F.col("r.id").alias("qid")] if keep else []), F.round(score, 4).alias("puntaje"))
