"""Queries of agreement, error rates and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.functions.text import stripped
from telarium.operators.similarity import char_distance, word_distance
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_PAIRS = "p as (select lower(a.categoria) as m, lower(b.categoria) as x from (select art_id, texto_norm, arg_max(categoria, id) as categoria from anotaciones where fuente = 'anot_01' group by 1, 2) a join (select art_id, texto_norm, arg_max(categoria, id) as categoria from anotaciones where fuente = 'ner_auto' group by 1, 2) b using (art_id, texto_norm))"


def pairs(ann: DataFrame) -> DataFrame:
    """Last label of a person and of the machine on the same span."""
    one = lambda f, c: ann.where(F.col("fuente") == f).groupBy("art_id", "texto_norm").agg(F.lower(F.max_by("categoria", "id")).alias(c))
    return one("anot_01", "m").join(one("ner_auto", "x"), ["art_id", "texto_norm"]).select("m", "x")


@q("a51_confusion_matrix", f"with {_PAIRS} select m as manual, x as automatica, count(*) as n from p group by 1, 2", "anotaciones")
def confusion(ann: DataFrame) -> DataFrame:
    return pairs(ann).groupBy(F.col("m").alias("manual"), F.col("x").alias("automatica")).agg(F.count(F.lit(1)).alias("n"))


@q("a51_kappa", f"with {_PAIRS}, c as (select m, x, count(*) as n from p group by 1, 2), t as (select sum(n) as t, sum(case when m = x then n else 0 end) as d from c), e as (select sum(a.n * b.n) as e from (select m as k, sum(n) as n from c group by 1) a join (select x as k, sum(n) as n from c group by 1) b using (k)) select t as n, round(d / t, 4) as acuerdo, round(case when coalesce(e, 0) = t * t then 1.0 else (d / t - coalesce(e, 0) / (t * t)) / (1 - coalesce(e, 0) / (t * t)) end, 3) as kappa from t, e", "anotaciones")
def kappa(ann: DataFrame) -> DataFrame:
    """Agreement and Cohen's kappa; one class on both sides gives 1."""
    c = pairs(ann).groupBy("m", "x").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("m") == F.col("x"), F.col("n")).otherwise(0)).alias("d"))
    side = lambda k, s: c.groupBy(F.col(k).alias("k")).agg(F.sum("n").alias(s))
    e = side("m", "a").join(side("x", "b"), "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("e"))
    po, pe = F.col("d") / F.col("t"), F.col("e") / (F.col("t") * F.col("t"))
    out = t.crossJoin(e)  # one row each
    return out.select(F.col("t").alias("n"), F.round(po, 4).alias("acuerdo"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0))), 3).alias("kappa"))


_NORM = r"strip_accents(lower(trim(regexp_replace(regexp_replace({c}, '([\p{{L}}])[-¬]\s*\n\s*', '\1', 'g'), '\s+', ' ', 'g'), ' ')))"


def cer_norm(c: str):
    """hyphen breaks joined, single spaces, lower case, no accents."""
    x = F.regexp_replace(F.regexp_replace(c, r"([\p{L}])[-¬]\s*\n\s*", "$1"), r"\s+", " ")
    return stripped(F.lower(F.trim(x)))


@q("f29_cer_normaliser", "select id, " + _NORM.format(c="texto_crudo") + " as texto from ocr where texto_crudo is not null", "ocr")
def normaliser(ocr: DataFrame) -> DataFrame:
    """Every page, whatever its characters."""
    return ocr.where("texto_crudo is not null").select("id", cer_norm("texto_crudo").alias("texto"))


# DuckDB counts edits of bytes: every character beyond ASCII becomes a byte of its own there, one for one
_SPARE = "array_to_string(list_transform(generate_series(1, 31), lambda i: chr(i::int)), '')"
_REF = "r as (select id, motor, confianza, case when confianza >= 0.6 then 'alta' else 'baja' end as calidad, " + _NORM.format(c="texto_limpio") + " as ref, " + _NORM.format(c="coalesce(texto_crudo, '')") + f" as hyp from ocr where texto_limpio <> ''), ch as (select coalesce(string_agg(c, '' order by c), '') as f from (select distinct unnest(regexp_extract_all(ref || hyp, '[^ -~]')) as c from r)), o as (select id, motor, calidad, translate(ref, f, {_SPARE}) as ref, translate(hyp, f, {_SPARE}) as hyp from r, ch)"


def references(ocr: DataFrame) -> DataFrame:
    """Cleaned layers as references and raw ones as hypotheses; a missing hypothesis is empty, no page is left out."""
    r = ocr.where("texto_limpio <> ''").withColumn("texto_crudo", F.coalesce("texto_crudo", F.lit("")))
    return r.select("id", "motor", F.when(F.col("confianza") >= 0.6, "alta").otherwise("baja").alias("calidad"), cer_norm("texto_limpio").alias("ref"), cer_norm("texto_crudo").alias("hyp"))


@q("a52_cer", f"with {_REF} select motor, count(*) as paginas, sum(levenshtein(ref, hyp)) as errores, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 4) as cer from o group by 1", "ocr")
def cer(ocr: DataFrame) -> DataFrame:
    """Micro average: sum of edit distances over sum of reference lengths."""
    d = references(ocr).withColumn("d", char_distance("ref", "hyp"))
    return d.groupBy("motor").agg(F.count(F.lit(1)).alias("paginas"), F.sum("d").alias("errores"), F.round(F.sum("d") / F.nullif(F.sum(F.length("ref")), F.lit(0)), 4).alias("cer"))


@q("a52_wer", None, "ocr")
def wer(ocr: DataFrame) -> DataFrame:
    d = references(ocr).withColumn("d", word_distance("ref", "hyp"))
    return d.groupBy("motor").agg(F.sum("d").alias("errores"), F.round(F.sum("d") / F.nullif(F.sum(F.size(F.split("ref", " "))), F.lit(0)), 4).alias("wer"))


@q("a53_stratified_evaluation", f"with {_REF}, d as (select motor, calidad, levenshtein(ref, hyp) as d, length(ref) as n from o), u as (select 'motor' as estrato, motor as valor, d, n from d union all select 'calidad', calidad, d, n from d) select estrato, valor, count(*) as paginas, round(sum(d) / sum(n), 4) as cer from u group by 1, 2", "ocr")
def stratified(ocr: DataFrame) -> DataFrame:
    """The distance is computed once; the strata are unpivoted afterwards."""
    d = references(ocr).select("motor", "calidad", char_distance("ref", "hyp").alias("d"), F.length("ref").alias("n"))
    u = d.select(F.expr("stack(2, 'motor', motor, 'calidad', calidad) as (estrato, valor)"), "d", "n")
    return u.groupBy("estrato", "valor").agg(F.count(F.lit(1)).alias("paginas"), F.round(F.sum("d") / F.nullif(F.sum("n"), F.lit(0)), 4).alias("cer"))


@q("a54_regression_detector", "with b as (select motor, avg(confianza) as m, count(*) as n from ocr where id % 2 = 0 group by 1), c as (select motor, avg(confianza) as m, count(*) as n from ocr where id % 2 = 1 group by 1) select coalesce(b.motor, c.motor) as motor, round(c.m - b.m, 4) as cambio, case when c.motor is null then 'desaparecida' when b.m - c.m > 0.005 then 'regresion' when c.n < b.n * 0.9 then 'cobertura' else 'estable' end as estado from b full join c on b.motor = c.motor", "ocr")
def regression(ocr: DataFrame) -> DataFrame:
    """A base run and a current one (even and odd rows, both whole) compared route by route."""
    side = lambda k: ocr.where(F.col("id") % 2 == k).groupBy("motor").agg(F.avg("confianza").alias(f"m{k}"), F.count(F.lit(1)).alias(f"n{k}"))
    j = side(0).join(side(1), "motor", "full_outer")
    state = F.when(F.col("n1").isNull(), "desaparecida").when(F.col("m0") - F.col("m1") > 0.005, "regresion").when(F.col("n1") < F.col("n0") * 0.9, "cobertura").otherwise("estable")
    return j.select("motor", F.round(F.col("m1") - F.col("m0"), 4).alias("cambio"), state.alias("estado"))


@q("a55_split_merge", f"with {_REF}, w as (select id, string_split(ref, ' ') as a, string_split(hyp, ' ') as b from o), g as (select id, a, b, list_transform(generate_series(1, len(a) - 1), lambda i: a[i] || a[i + 1]) as ga, list_transform(generate_series(1, len(b) - 1), lambda i: b[i] || b[i + 1]) as gb from w) select id, len(list_filter(list_distinct(b), lambda x: list_contains(ga, x))) as unidas, len(list_filter(list_distinct(gb), lambda x: list_contains(a, x))) as partidas from g", "ocr")
def split_merge(ocr: DataFrame) -> DataFrame:
    """Words of the reading that are two of the reference, and pairs of the reading that are one of it."""
    w = references(ocr).select("id", F.split("ref", " ").alias("a"), F.split("hyp", " ").alias("b"))
    pair = lambda c: F.when(F.size(c) > 1, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.element_at(c, i), F.element_at(c, i + 1)))).otherwise(F.array().cast("array<string>"))
    return w.select("id", F.size(F.array_intersect("b", pair("a"))).alias("unidas"), F.size(F.array_intersect(pair("b"), "a")).alias("partidas"))


_USE = "event_type, count(*) as llamadas, sum(try_cast(json_extract_string(props, '$.k') as bigint)) as tokens, round(sum(value), 2) as costo"


@q("a43_usage_summary", f"select {_USE} from events where value > 0 group by 1", "events")
def usage(ev: DataFrame) -> DataFrame:
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("long")
    return ev.where("value > 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("llamadas"), F.sum(k).alias("tokens"), F.round(F.sum("value"), 2).alias("costo"))


@q("a44_total_cost", "select round(coalesce(sum(value), 0), 2) as costo from events where value > 0", "events")
def total(ev: DataFrame) -> DataFrame:
    return ev.where("value > 0").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("costo"))


@q("a67_batch_cost", "with p as (select * from (values ('p', 1.0), ('pur', 2.0), ('view', 0.5), ('', 0.1)) v(prefijo, precio)), m as (select event_id, event_type, value, precio, row_number() over (partition by event_id order by length(prefijo) desc) as r from events join p on starts_with(event_type, prefijo)) select event_type, round(sum(value * precio), 2) as costo from m where r = 1 group by 1", "events")
def batch_cost(ev: DataFrame) -> DataFrame:
    """Price of the longest prefix of each model; the price list is an expression."""
    price = F.when(F.col("event_type").startswith("pur"), 2.0).when(F.col("event_type").startswith("view"), 0.5).when(F.col("event_type").startswith("p"), 1.0).otherwise(0.1)
    return ev.groupBy("event_type").agg(F.round(F.sum(F.col("value") * price), 2).alias("costo"))


@q("a42_corpus_statistics", "select (select count(distinct id) from articulos) as articulos, (select count(*) from ocr) as paginas, (select count(*) from entidades) as menciones, (select count(distinct texto) from entidades) as nombres, (select count(*) from anotaciones) as anotaciones, (select count(*) from coocurrencias) as pares", "articulos", "ocr", "entidades", "anotaciones", "coocurrencias")
def statistics(arts: DataFrame, ocr: DataFrame, ents: DataFrame, ann: DataFrame, co: DataFrame) -> DataFrame:
    one = lambda df, e, n: df.agg(e.alias(n))
    count = F.count(F.lit(1))
    parts = [one(arts, F.countDistinct("id"), "articulos"), one(ocr, count, "paginas"), ents.agg(count.alias("menciones"), F.countDistinct("texto").alias("nombres")), one(ann, count, "anotaciones"), one(co, count, "pares")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@q("a66_table_counts", "select 'articulos' as tabla, count(*) as n from articulos union all select 'ocr', count(*) from ocr union all select 'entidades', count(*) from entidades", "articulos", "ocr", "entidades")
def table_counts(arts: DataFrame, ocr: DataFrame, ents: DataFrame) -> DataFrame:
    one = lambda df, t: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tabla"), "n")
    return one(arts, "articulos").unionByName(one(ocr, "ocr")).unionByName(one(ents, "entidades"))


@q("a65_class_statistics", "select label as clase, count(*) as n, round(count(*) * 100.0 / (select count(*) from embeddings), 1) as pct from embeddings group by 1", "embeddings")
def class_statistics(emb: DataFrame) -> DataFrame:
    c = emb.groupBy(F.col("label").alias("clase")).agg(F.count(F.lit(1)).alias("n"))
    t = F.broadcast(c.agg(F.sum("n").alias("t")))  # one row
    return c.crossJoin(t).select("clase", "n", F.round(F.col("n") * 100.0 / F.col("t"), 1).alias("pct"))


@q("a70_methods_summary", r"select count(*) as paginas, sum(len(regexp_extract_all(coalesce(texto_crudo, ''), '[\p{L}\p{N}]+'))) as palabras, count(distinct articulo_id) as articulos, round(avg(confianza), 4) as confianza, sum((trim(coalesce(texto_limpio, '')) <> '')::int) as revisadas from ocr", "ocr")
def methods(ocr: DataFrame) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.coalesce("texto_crudo", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return ocr.agg(F.count(F.lit(1)).alias("paginas"), F.sum(words).alias("palabras"), F.countDistinct("articulo_id").alias("articulos"), F.round(F.avg("confianza"), 4).alias("confianza"), F.sum((F.trim(F.coalesce("texto_limpio", F.lit(""))) != "").cast("int")).alias("revisadas"))


@q("pf19_frequent_corrections", "select nombre_nuevo, count(*) as n from revision_entidades where decision = 'renombrada' and nombre_nuevo <> '' group by 1 having count(*) >= 2", "revision_entidades")
def corrections(rev: DataFrame) -> DataFrame:
    return rev.where("decision = 'renombrada' and nombre_nuevo <> ''").groupBy("nombre_nuevo").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@q("a50_topic_statistics", "select seccion, count(*) as n, round(count(*) * 100.0 / (select count(*) from articulos), 1) as pct from articulos group by 1", "articulos")
def topics(arts: DataFrame) -> DataFrame:
    c = arts.groupBy("seccion").agg(F.count(F.lit(1)).alias("n"))
    t = F.broadcast(c.agg(F.sum("n").alias("t")))  # one row
    return c.crossJoin(t).select("seccion", "n", F.round(F.col("n") * 100.0 / F.col("t"), 1).alias("pct"))


@q("t11_recent_issues", "select numero, max(modificado) as ultimo from articulos where numero is not null group by 1 order by ultimo desc nulls last, numero limit 10", "articulos")
def recent(arts: DataFrame) -> DataFrame:
    g = arts.where("numero is not null").groupBy("numero").agg(F.max("modificado").alias("ultimo"))
    return g.orderBy(F.col("ultimo").desc_nulls_last(), "numero").limit(10)


@q("a14_issue_profile", r"with x as (select publicacion, lower(text) as t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where text is not null and publicacion is not null) select publicacion, sum(len(w)) as palabras, sum(len(list_filter(w, lambda y: y in ('teatro', 'zarzuela')))) as espectaculos, sum(len(regexp_extract_all(t, 'pesos'))) as precios from x group by 1", "documents")
def issue_profile(docs: DataFrame) -> DataFrame:
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    x = docs.where("text is not null and publicacion is not null").select("publicacion", F.lower("text").alias("t"), w.alias("w"))
    return x.groupBy("publicacion").agg(F.sum(F.size("w")).alias("palabras"), F.sum(F.size(F.filter("w", lambda y: y.isin("teatro", "zarzuela")))).alias("espectaculos"), F.sum(F.regexp_count("t", F.lit("pesos"))).alias("precios"))


