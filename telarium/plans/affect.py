"""Queries of polarity, emotion, frames, tone and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import affect as A
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_W = r"w as (select doc_id, publicacion, anio, source, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where text is not null)"
_NEG = f"len(list_filter(w[greatest(i - 3, 1):i - 1], lambda y: y in {_in(A.NEGATORS)})) > 0"
_POLAR = f"""{_W}, h as (select doc_id, publicacion, source, w, unnest(generate_series(1, len(w))) as i from w),
s as (select doc_id, case when w[i] in {_in(A.POSITIVE)} then case when {_NEG} then -1 else 1 end when w[i] in {_in(A.NEGATIVE)} then case when {_NEG} then 1 else -1 end end as v from h),
p0 as (select doc_id, sum((v = 1)::int) as pos, sum((v = -1)::int) as neg from s where v is not null group by 1),
pol as (select w.doc_id, publicacion, source, coalesce(pos, 0)::bigint as pos, coalesce(neg, 0)::bigint as neg, len(w) as n from w left join p0 using (doc_id)),
lab as (select *, round(case when pos + neg > 0 then (pos - neg) / (pos + neg) else 0 end, 3) as puntaje, case when pos > neg then 'positivo' when neg > pos then 'negativo' else 'neutro' end as etiqueta from pol)"""


def polar(docs: DataFrame) -> DataFrame:
    return A.polarity(docs.where("text is not null").select("doc_id", "publicacion", "source", T.words(F.col("text")).alias("w")))


@q("f10_polarity", f"with {_POLAR} select doc_id, pos, neg, puntaje, etiqueta, round(case when n > 0 then (pos + neg) / n else 0 end, 4) as densidad from lab", "documents")
def polarity(docs: DataFrame) -> DataFrame:
    """Lexicon polarity; a negator among the three words before turns the sign."""
    return polar(docs).select("doc_id", "pos", "neg", "puntaje", "etiqueta", "densidad")


@q("a30_polarity_distribution", f"with {_POLAR} select e as etiqueta, count(doc_id) as n from (values ('positivo'), ('negativo'), ('neutro')) v(e) left join lab on etiqueta = e group by e", "documents")
def polarity_distribution(docs: DataFrame) -> DataFrame:
    x = polar(docs)
    n = lambda e: F.count(F.when(F.col("etiqueta") == e, 1))
    labels = ("positivo", "negativo", "neutro")
    one = x.agg(F.array(*(F.struct(F.lit(e).alias("etiqueta"), n(e).alias("n")) for e in labels)).alias("a"))
    return one.select(F.inline("a"))


@q("a32_affective_polarisation", f"with {_POLAR}, c as (select publicacion, sum((etiqueta = 'positivo')::int) as p, sum((etiqueta = 'negativo')::int) as n, count(*) as t from lab where publicacion is not null group by 1) select publicacion, round(case when p + n > 0 then (p + n) / t * (1 - abs(p - n) / (p + n)) else 0 end, 3) as indice from c", "documents")
def polarisation(docs: DataFrame) -> DataFrame:
    p, n = (F.sum((F.col("etiqueta") == e).cast("int")).alias(e[0]) for e in ("positivo", "negativo"))
    c = polar(docs).where("publicacion is not null").groupBy("publicacion").agg(p, n, F.count(F.lit(1)).alias("t"))
    both = F.col("p") + F.col("n")
    index = F.when(both > 0, both / F.col("t") * (1 - F.abs(F.col("p") - F.col("n")) / both)).otherwise(0.0)
    return c.select("publicacion", F.round(index, 3).alias("indice"))


_AROUND = f"""{_W}, k as (select doc_id, w, unnest(generate_series(1, len(w))) as i from w where list_contains(w, 'valdoria')), m as (select doc_id, w[greatest(i - 25, 1):i + 24] as v from k where w[i] = 'valdoria'),
e as (select doc_id, len(list_filter(v, lambda y: y in {_in(A.POSITIVE)})) as p, len(list_filter(v, lambda y: y in {_in(A.NEGATIVE)})) as n from m)"""


@q("f11_entity_polarity", f"with {_AROUND} select doc_id, count(*) as menciones, sum(p) as pos, sum(n) as neg from e group by 1", "documents")
def entity_polarity(docs: DataFrame) -> DataFrame:
    """Windows from 25 words before each mention to 24 after it."""
    return A.around(docs.where("text is not null").select("doc_id", T.words(F.col("text")).alias("w")), "valdoria")


@q("a31_entity_polarity_corpus", f"with {_AROUND} select count(*) as menciones, coalesce(sum(p), 0) as pos, coalesce(sum(n), 0) as neg from e", "documents")
def entity_polarity_corpus(docs: DataFrame) -> DataFrame:
    x = A.around(docs.where("text is not null").select("doc_id", T.words(F.col("text")).alias("w")), "valdoria")
    return x.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("menciones", "pos", "neg")))


_FRAME = ", ".join("(" + " + ".join(f"(len(regexp_extract_all(' ' || array_to_string(w, ' '), ' {m}')))" for m in ms) + f") as {f}" for f, ms in A.FRAMES.items())
_FR = f"with {_W}, f as (select doc_id, publicacion, {_FRAME} from w), u as (unpivot f on {', '.join(A.FRAMES)} into name marco value n), r as (select *, row_number() over (partition by doc_id order by n desc, marco) as p, sum(n) over (partition by doc_id) as total from u), tres as (select doc_id, coalesce(string_agg(marco, ', ' order by p) filter (n > 0 and p <= 3), '') as primeros from r group by 1)"


@q("f12_frames", _FR + " select doc_id, case when n > 0 then marco else 'ninguno' end as marco, n as marcas, round(case when total > 0 then n * 100.0 / total else 0 end, 1) as pct, primeros from r join tres using (doc_id) where p = 1", "documents")
def frames(docs: DataFrame) -> DataFrame:
    """Marker counts, anchored on the left, and the dominant frame."""
    return A.frames(docs.where("text is not null").select("doc_id", "publicacion", T.words(F.col("text")).alias("w"))).select("doc_id", "marco", "marcas", "pct", "primeros")


@q("a33_frame_distribution", _FR + " select case when n > 0 then marco else 'ninguno' end as marco, count(*) as n from r where p = 1 group by 1", "documents")
def frame_distribution(docs: DataFrame) -> DataFrame:
    x = A.frames(docs.where("text is not null").select("doc_id", "publicacion", T.words(F.col("text")).alias("w")))
    return x.groupBy("marco").agg(F.count(F.lit(1)).alias("n"))


@q("a34_section_frame_matrix", _FR + ", m as (select coalesce(publicacion, '?') as seccion, case when n > 0 then marco else 'ninguno' end as marco from r where p = 1) select seccion, " + ", ".join(f"sum((marco = '{f}')::int) as {f}" for f in [*A.FRAMES, "ninguno"]) + " from m group by 1", "documents")
def section_frame(docs: DataFrame) -> DataFrame:
    x = A.frames(docs.where("text is not null").select("doc_id", "publicacion", T.words(F.col("text")).alias("w")))
    out = x.groupBy(F.coalesce("publicacion", F.lit("?")).alias("seccion")).pivot("marco", [*A.FRAMES, "ninguno"]).count()
    return out.fillna(0)


_EMO = ", ".join(f"len(list_filter(w, lambda y: y in {_in(ws)})) as {e}" for e, ws in A.EMOTIONS.items())


@q("f13_emotion", f"with {_W}, f as (select doc_id, {_EMO} from w), u as (unpivot f on {', '.join(A.EMOTIONS)} into name emocion value n), r as (select *, row_number() over (partition by doc_id order by n desc, emocion) as p, sum(n) over (partition by doc_id) as total from u) select doc_id, case when n > 0 then emocion else 'ninguna' end as dominante, total::bigint as total, round(case when total > 0 then n * 100.0 / total else 0 end, 1) as pct, primeros from r join (select doc_id, coalesce(string_agg(emocion, ', ' order by p) filter (n > 0 and p <= 3), '') as primeros from r group by 1) using (doc_id) where p = 1", "documents")
def emotion(docs: DataFrame) -> DataFrame:
    return A.emotions(docs.where("text is not null").select("doc_id", T.words(F.col("text")).alias("w")))


@q("f14_subjectivity", rf"with s as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[.!?]+'), lambda x: length(trim(x)) > 20) as s from documents where text is not null) select doc_id, len(s) as oraciones, round(case when len(s) > 0 then len(list_filter(s, lambda x: len(regexp_extract_all(x, '\y')) >= 0 and len(list_filter(regexp_extract_all(x, '\p{{L}}+'), lambda y: y in {_in(A.SUBJECTIVE)})) > len(list_filter(regexp_extract_all(x, '\p{{L}}+'), lambda y: y in {_in(A.FACTUAL)})))) / len(s) else 0 end, 3) as subjetividad from s".replace(r"len(regexp_extract_all(x, '\y')) >= 0 and ", ""), "documents")
def subjectivity(docs: DataFrame) -> DataFrame:
    """Share of the sentences with more subjective than factual words."""
    return A.subjectivity(docs.where("text is not null").select("doc_id", "text"))


_INT = r"round(least(1.0, 0.1 * least(len(regexp_extract_all(lower(text), '\p{L}+ísim[oa]')), 5) + 0.05 * least(len(regexp_extract_all(text, '!')), 5) + 0.08 * least(len(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda y: y in ('todo', 'nunca', 'siempre', 'jamás'))), 5) + case when regexp_matches(text, '[!?]{2}') then 0.15 else 0 end), 3)"


@q("f15_intensity", f"select doc_id, {_INT} as intensidad from documents where text is not null", "documents")
def intensity(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", A.intensity(F.col("text")).alias("intensidad"))


_TONES = ["click", "error", "login", "purchase", "view"]


@q("a25_tone_stats", "with c as (select event_type as tono, count(*) as n, avg(value) as m from events group by 1), t as (select sum(n) as total from c) select tono, n, round(n * 100.0 / total, 1) as pct, round(m, 3) as media from c, t", "events")
def tone_stats(ev: DataFrame) -> DataFrame:
    """Count, share and mean of each tone; event_type stands for the tone."""
    c = ev.groupBy(F.col("event_type").alias("tono")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    total = F.broadcast(c.agg(F.sum("n").alias("total")))  # one row
    return c.crossJoin(total).select("tono", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"), F.round("m", 3).alias("media"))


_DAY = "c as (select strftime(ts, '%Y-%m-%d') as dia, event_type as tono, count(*) as n from events group by 1, 2), t as (select dia, sum(n) as total from c group by 1)"


@q("a26_tone_by_period", f"with {_DAY} select dia, tono, n, round(n * 100.0 / total, 1) as pct from c join t using (dia)", "events")
def tone_by_period(ev: DataFrame) -> DataFrame:
    return A.shares(ev.select(F.date_format("ts", "yyyy-MM-dd").alias("dia"), F.col("event_type").alias("tono")), "dia", "tono")


@q("a27_tone_crosstab", "with c as (select coalesce(tipo, '?') as tipo, coalesce(estado, '?') as estado, count(*) as n from articulos group by 1, 2), t as (select tipo, sum(n) as total from c group by 1) select tipo, estado, n, round(n * 100.0 / total, 1) as pct from c join t using (tipo)", "articulos")
def crosstab(arts: DataFrame) -> DataFrame:
    x = arts.select(F.coalesce("tipo", F.lit("?")).alias("tipo"), F.coalesce("estado", F.lit("?")).alias("estado"))
    return A.shares(x, "tipo", "estado")


@q("a28_tone_comparison", "with a as (select event_type as tono, round(sum((ts < timestamp '2024-01-16')::int) * 100.0 / (select count(*) from events where ts < timestamp '2024-01-16'), 2) as pct_a, round(sum((ts >= timestamp '2024-01-16')::int) * 100.0 / (select count(*) from events where ts >= timestamp '2024-01-16'), 2) as pct_b from events group by 1) select tono, pct_a, pct_b, round(pct_b - pct_a, 2) as delta from a", "events")
def comparison(ev: DataFrame) -> DataFrame:
    """Shares of the first and the second half of the month."""
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    c = ev.groupBy(F.col("event_type").alias("tono")).agg(F.count(F.when(early, 1)).alias("a"), F.count(F.when(~early, 1)).alias("b"))
    t = F.broadcast(c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    pct = lambda x: F.round(F.col(x) * 100.0 / F.nullif(F.col(f"t{x}"), F.lit(0)), 2)
    out = c.crossJoin(t).select("tono", pct("a").alias("pct_a"), pct("b").alias("pct_b"))
    return out.withColumn("delta", F.round(F.col("pct_b") - F.col("pct_a"), 2))


@q("a29_tone_trend", f"with {_DAY}, p as (select dia, tono, round(n * 100.0 / total, 1) as pct, dense_rank() over (order by dia) - 1 as k from c join t using (dia)), g as (select tono, round(regr_slope(pct, k), 4) as pendiente from p group by 1) select tono, pendiente, case when pendiente > 0.5 then 'sube' when pendiente < -0.5 then 'baja' else 'estable' end as tendencia from g", "events")
def trend(ev: DataFrame) -> DataFrame:
    """Least-squares slope of the share over the index of the day."""
    p = A.shares(ev.select(F.date_format("ts", "yyyy-MM-dd").alias("dia"), F.col("event_type").alias("tono")), "dia", "tono")
    days = p.select("dia").distinct().withColumn("k", F.row_number().over(Window.orderBy("dia")) - 1)  # a row a day
    g = p.join(F.broadcast(days), "dia").groupBy("tono").agg(F.round(F.regr_slope("pct", "k"), 4).alias("pendiente"))
    return g.withColumn("tendencia", F.when(F.col("pendiente") > 0.5, "sube").when(F.col("pendiente") < -0.5, "baja").otherwise("estable"))
