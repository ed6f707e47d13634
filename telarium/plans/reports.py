"""Queries of further export tables and of word correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.plans import evaluation, similarity, sources
from telarium.plans.entities import N
from telarium.plans.lexical import sql_tokens, toks, valid_word
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query


@q("pf5_valid_words", f"with {sql_tokens(4)}, d as (select distinct w from (select unnest(t) as w from tok)) select w, not regexp_matches(w, '[aeiouáéíóúü]{{3}}|[^aeiouáéíóúü]{{5}}') and regexp_matches(w, '[aeiouáéíóúü]') and length(regexp_replace(w, '[^aeiouáéíóúü]', '', 'g')) / length(w) between 0.25 and 0.7 as valida from d", "documents")
def valid_words(docs: DataFrame) -> DataFrame:
    w = toks(docs, 4).select(F.explode("t").alias("w")).distinct()
    return w.select("w", valid_word(F.col("w")).alias("valida"))


@q("f32_word_correction", similarity._J18.replace("where puesto <= 5", "where puesto = 1").replace("select r as palabra, g as sugerencia, d, puesto from k", "select r as palabra, g as correccion from k"), "documents")
def correction(docs: DataFrame) -> DataFrame:
    """The most frequent word within two edits of each rare one."""
    return similarity.nearest_seeds(docs).where("puesto = 1").select("palabra", F.col("sugerencia").alias("correccion"))


@q("k17_glossary_csv", f"select categoria || ',' || {N} || ',' || count(distinct articulo_id) as linea from entidades group by categoria, {N}", "entidades")
def glossary_csv(ents: DataFrame) -> DataFrame:
    g = ents.groupBy("categoria", T.plain(F.col("texto")).alias("n")).agg(F.countDistinct("articulo_id").alias("k"))
    return g.select(F.concat_ws(",", "categoria", "n", F.col("k").cast("string")).alias("linea"))


@q("k19_benchmark_csv", f"with {evaluation._REF} select motor || ';' || count(*) || ';' || sum(levenshtein(ref, hyp)) as linea from o group by motor", "ocr")
def benchmark_csv(ocr: DataFrame) -> DataFrame:
    c = evaluation.cer(ocr)
    return c.select(F.concat_ws(";", "motor", F.col("paginas").cast("string"), F.col("errores").cast("string")).alias("linea"))


@q("k20_manifest", sources._HASH.replace("select sha256(string_agg(h, '' order by b)) as hash from b3", "select 'csv' as formato, sha256(string_agg(h, '' order by b)) as hash, (select count(*) from h) as documentos from b3"), "documents")
def manifest(docs: DataFrame) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("documentos"))
    return sources.corpus_hash(docs).crossJoin(n).select(F.lit("csv").alias("formato"), "hash", "documentos")  # one row each


_VERBS = "vendió|copió|pagó|criticó|celebró|recorrió"


@q("k22_relations_csv", rf"with r as (select unnest(regexp_extract_all(lower(text), '(?:el|la|un|una) \p{{L}}+ (?:{_VERBS}) (?:el|la|un|una) \p{{L}}+')) as r from documents where text is not null) select string_split(r, ' ')[2] as sujeto, string_split(r, ' ')[3] as verbo, string_split(r, ' ')[5] as objeto, count(*) as n from r group by 1, 2, 3", "documents")
def relations_csv(docs: DataFrame) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"((?:el|la|un|una) \p{{L}}+ (?:{_VERBS}) (?:el|la|un|una) \p{{L}}+)"), 1)
    r = docs.where("text is not null").select(F.explode(found).alias("x")).select(F.split("x", " ").alias("r"))
    return r.groupBy(F.get("r", F.lit(1)).alias("sujeto"), F.get("r", F.lit(2)).alias("verbo"), F.get("r", F.lit(4)).alias("objeto")).agg(F.count(F.lit(1)).alias("n"))


@q("k13_workbook_sheets", "select 'tipos' as hoja, coalesce(tipo, '?') as clave, count(*) as valor from articulos group by 2 union all select 'estados', coalesce(estado, '?'), count(*) from articulos group by 2 union all select 'categorias', categoria, count(*) from entidades group by 2", "articulos", "entidades")
def workbook(arts: DataFrame, ents: DataFrame) -> DataFrame:
    """The tables of the sheets, one under the other."""
    sheet = lambda df, name, c: df.groupBy(F.coalesce(c, F.lit("?")).alias("clave")).agg(F.count(F.lit(1)).alias("valor")).select(F.lit(name).alias("hoja"), "clave", "valor")
    return sheet(arts, "tipos", "tipo").unionByName(sheet(arts, "estados", "estado")).unionByName(sheet(ents, "categorias", "categoria"))


@q("s9_legacy_scan", "with a as (select numero, id, row_number() over (partition by numero order by id) as k from (select distinct numero, id from articulos where numero is not null)), t as (select numero, titulo, row_number() over (partition by numero order by id) as k from (select id, max(numero) as numero, max(titulo) as titulo from articulos where numero is not null group by id)) select a.id, t.titulo from a left join t on a.numero = t.numero and a.k = t.k", "articulos")
def legacy(arts: DataFrame) -> DataFrame:
    """Two layouts aligned by their position inside an issue."""
    there = arts.where("numero is not null")
    w = Window.partitionBy("numero").orderBy("id")
    a = there.select("numero", "id").distinct().withColumn("k", F.row_number().over(w))
    t = there.groupBy("id").agg(F.max("numero").alias("numero"), F.max("titulo").alias("titulo"))
    t = t.withColumn("k", F.row_number().over(w)).select("numero", "k", "titulo")
    return a.join(t, ["numero", "k"], "left").select("id", "titulo")
