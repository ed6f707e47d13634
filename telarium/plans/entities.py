"""Queries of mentions, canonical entities, review queues and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import entities as E
from telarium.operators.lexical import top
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

N = r"trim(regexp_replace(strip_accents(lower(texto)), '[\s\x{00A0}]+', ' ', 'g'), ' ')"
_ART = "a as (select id, arg_max(numero, coalesce(modificado, timestamp '1900-01-01')) as numero from articulos group by id)"


def articles(arts: DataFrame) -> DataFrame:
    """The last state of each article."""
    when = F.coalesce("modificado", F.lit("1900-01-01").cast("timestamp_ntz"))
    return arts.groupBy("id").agg(F.max_by("numero", when).alias("numero"))


@q("s20_ner_index", "select categoria, texto as entidad, count(distinct articulo_id) as n, md5(array_to_string(list_sort(list(distinct articulo_id)), ',')) as articulos from entidades where fuente is distinct from 'manual' group by 1, 2", "entidades")
def ner_index(ents: DataFrame) -> DataFrame:
    """Entity -> articles; the lists are compared by their digest."""
    d = ents.where(~F.col("fuente").eqNullSafe("manual")).groupBy("categoria", F.col("texto").alias("entidad")).agg(F.array_sort(F.collect_set("articulo_id")).alias("a"))
    return d.select("categoria", "entidad", F.size("a").alias("n"), F.md5(F.array_join("a", ",").cast("binary")).alias("articulos"))


@q("s7_entity_scan", "select id, texto, categoria, confianza from entidades where texto ilike '%valdoria%' and categoria = 'lugares'", "entidades")
def entity_scan(ents: DataFrame) -> DataFrame:
    return ents.where(F.col("texto").ilike("%valdoria%") & (F.col("categoria") == "lugares")).select("id", "texto", "categoria", "confianza")


@q("pf2_single_word_noise", rf"select id, not regexp_matches(texto, '\p{{L}}') or lower(trim(texto, '.')) in ('de', 'la', 'el', 'los', 'don', 'señor') or length(trim(texto, '.')) <= 1 as ruido from entidades where not contains(trim(texto), ' ')", "entidades")
def noise(ents: DataFrame) -> DataFrame:
    bare = F.trim("texto", F.lit("."))
    flag = ~F.col("texto").rlike(r"\p{L}") | F.lower(bare).isin("de", "la", "el", "los", "don", "señor") | (F.length(bare) <= 1)
    return ents.where(~F.trim("texto").contains(" ")).select("id", flag.alias("ruido"))


@q("pf3_false_person", "select id, texto from entidades where categoria = 'personas' and not contains(trim(texto), ' ') and lower(trim(texto)) in ('dios', 'señor', 'presidente', 'valdoria')", "entidades")
def false_person(ents: DataFrame) -> DataFrame:
    return ents.where((F.col("categoria") == "personas") & ~F.trim("texto").contains(" ") & F.lower(F.trim("texto")).isin("dios", "señor", "presidente", "valdoria")).select("id", "texto")


@q("pf4_personal_name", r"with x as (select id, texto, string_split(trim(texto), ' ') as t from entidades) select id, len(t) between 2 and 5 and len(list_filter(t, lambda w: not regexp_matches(w, '^\p{Lu}'))) = 0 and len(list_filter(t, lambda w: length(w) >= 3 and not regexp_matches(lower(w), '[aeiouáéíóúü]'))) = 0 and not regexp_matches(texto, '[\d@#;|]') and len(list_filter(t, lambda w: length(w) > 20)) = 0 as persona from x", "entidades")
def personal_name(ents: DataFrame) -> DataFrame:
    t = F.split(F.trim("texto"), " ")
    ok = F.size(t).between(2, 5) & F.forall(t, lambda w: w.rlike(r"^\p{Lu}") & ((F.length(w) < 3) | F.lower(w).rlike("[aeiouáéíóúü]")) & (F.length(w) <= 20)) & ~F.col("texto").rlike(r"[\d@#;|]")
    return ents.select("id", ok.alias("persona"))


@q("f22_plain_names", f"select distinct texto, {N} as norma from entidades", "entidades")
def plain_names(ents: DataFrame) -> DataFrame:
    return ents.select("texto").distinct().select("texto", T.plain(F.col("texto")).alias("norma"))


_CAN = rf"x as (select *, {N} as norma from entidades), c as (select categoria, norma, arg_max(texto, id) as nombre, arg_max(wikidata_id, id) filter (wikidata_id <> '') as wikidata, count(*) as menciones, count(distinct articulo_id) as articulos from x group by 1, 2)"
_ID = "categoria || ':' || case when s = '' then 'sin-nombre' else s end"


@q("f23_canonical_ids", f"with {_CAN}, s as (select *, trim(regexp_replace(norma, '[^a-z0-9]+', '-', 'g'), '-') as s from c) select categoria, norma, {_ID} as canonica from s", "entidades")
def canonical_ids(ents: DataFrame) -> DataFrame:
    return E.canonical(ents).select("categoria", "norma", "canonica")


@q("a48_canonical_fusion", f"with {_CAN} select categoria, norma, nombre, wikidata, menciones, articulos from c", "entidades")
def fusion(ents: DataFrame) -> DataFrame:
    """Mentions of one type and normal name; the last one gives the display name, the last id that is there is kept."""
    return E.canonical(ents).select("categoria", "norma", "nombre", "wikidata", "menciones", "articulos")


@q("j1_mention_canonical", f"with {_CAN}, s as (select *, trim(regexp_replace(norma, '[^a-z0-9]+', '-', 'g'), '-') as s from c) select x.id, {_ID} as canonica from x join s using (categoria, norma)", "entidades")
def mention_canonical(ents: DataFrame) -> DataFrame:
    m = ents.select("id", "categoria", T.plain(F.col("texto")).alias("norma"))
    return m.join(E.canonical(ents).select("categoria", "norma", "canonica"), ["categoria", "norma"]).select("id", "canonica")


@q("t8_index_merge", f"select distinct categoria, {N} as entidad, articulo_id from entidades", "entidades")
def index_merge(ents: DataFrame) -> DataFrame:
    """The union of two loads without duplicates."""
    x = ents.select("categoria", T.plain(F.col("texto")).alias("entidad"), "articulo_id", F.col("fuente").eqNullSafe("manual").alias("m"))
    return x.where("m").drop("m").unionByName(x.where("not m").drop("m")).distinct()


@q("t7_union_of_results", r"select articulo_id, categoria, texto from entidades union select a.articulo_id, 'fechas', unnest(regexp_extract_all(lower(a.texto_crudo), '\d{1,2} de (?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)')) from ocr a", "entidades", "ocr")
def union_results(ents: DataFrame, ocr: DataFrame) -> DataFrame:
    months = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
    found = F.explode(F.regexp_extract_all(F.lower("texto_crudo"), F.lit(rf"(\d{{1,2}} de (?:{months}))"), 1))
    d = ocr.where("texto_crudo is not null").select("articulo_id", F.lit("fechas").alias("categoria"), found.alias("texto"))
    return ents.select("articulo_id", "categoria", "texto").unionByName(d).distinct()


@q("j7_entities_by_article", "select articulo_id, categoria, count(distinct texto) as n, md5(array_to_string(list_sort(list(distinct texto)), '|')) as entidades from entidades group by 1, 2", "entidades")
def by_article(ents: DataFrame) -> DataFrame:
    g = ents.groupBy("articulo_id", "categoria").agg(F.array_sort(F.collect_set("texto")).alias("e"))
    return g.select("articulo_id", "categoria", F.size("e").alias("n"), F.md5(F.array_join("e", "|").cast("binary")).alias("entidades"))


@q("j8_index_by_issue", f"with {_ART} select numero, categoria, {N} as entidad, count(*) as menciones from entidades e join a on a.id = e.articulo_id group by 1, 2, 3", "entidades", "articulos")
def by_issue(ents: DataFrame, arts: DataFrame) -> DataFrame:
    x = ents.select("articulo_id", "categoria", T.plain(F.col("texto")).alias("entidad")).join(articles(arts), F.col("articulo_id") == F.col("id"))
    return x.groupBy("numero", "categoria", "entidad").agg(F.count(F.lit(1)).alias("menciones"))


@q("j9_geocoding", f"select distinct {N} as lugar, c.v as grado from entidades join (values ('valdoria', 4.6), ('puersamenmita', 6.2), ('alllabusbega', 3.4)) c(lugar, v) on {N} = c.lugar where categoria = 'lugares'", "entidades")
def geocoding(ents: DataFrame) -> DataFrame:
    """Places in a gazetteer of fixed size, on names without accents."""
    gaz = ents.sparkSession.createDataFrame([("valdoria", 4.6), ("puersamenmita", 6.2), ("alllabusbega", 3.4)], "lugar string, grado double")
    places = ents.where("categoria = 'lugares'").select(T.plain(F.col("texto")).alias("lugar")).distinct()
    return places.join(F.broadcast(gaz), "lugar")


@q("j14_apply_decisions", "with r as (select nombre, categoria, decision, nullif(trim(nombre_nuevo), '') as nuevo from revision_entidades), x as (select e.categoria, coalesce(case when r.decision = 'renombrada' then r.nuevo end, e.texto) as nombre, articulo_id from entidades e left join r on r.nombre = e.texto and r.categoria = e.categoria where r.decision is distinct from 'descartada') select categoria, nombre, count(distinct articulo_id) as articulos from x group by 1, 2", "entidades", "revision_entidades")
def decisions(ents: DataFrame, rev: DataFrame) -> DataFrame:
    """Discarded names dropped, renamed ones merged; reviewed names have one row each."""
    r = rev.select(F.col("nombre").alias("texto"), "categoria", "decision", F.nullif(F.trim("nombre_nuevo"), F.lit("")).alias("nuevo"))
    x = ents.join(r, ["texto", "categoria"], "left").where(~F.col("decision").eqNullSafe("descartada"))
    name = F.coalesce(F.when(F.col("decision") == "renombrada", F.col("nuevo")), F.col("texto"))
    return x.groupBy("categoria", name.alias("nombre")).agg(F.countDistinct("articulo_id").alias("articulos"))


@q("a17_volume_by_category", "select categoria, count(*) as menciones, count(distinct articulo_id) as articulos from entidades group by 1", "entidades")
def volume(ents: DataFrame) -> DataFrame:
    return ents.groupBy("categoria").agg(F.count(F.lit(1)).alias("menciones"), F.countDistinct("articulo_id").alias("articulos"))


@q("a18_top_entities", f"select {N} as entidad, count(distinct articulo_id) as articulos from entidades where categoria = 'personas' group by 1 order by 2 desc, 1 limit 20", "entidades")
def top_entities(ents: DataFrame) -> DataFrame:
    g = ents.where("categoria = 'personas'").groupBy(T.plain(F.col("texto")).alias("entidad")).agg(F.countDistinct("articulo_id").alias("articulos"))
    return top(g, 20, F.desc("articulos"), F.asc("entidad"))


@q("a19_entity_evolution", f"with {_ART}, x as (select {N} as entidad, numero from entidades e join a on a.id = e.articulo_id where categoria = 'lugares'), t as (select entidad from x group by 1 order by count(*) desc, entidad limit 8) select entidad, numero, count(*) as menciones from x semi join t using (entidad) group by 1, 2", "entidades", "articulos")
def evolution(ents: DataFrame, arts: DataFrame) -> DataFrame:
    """Mentions by issue of the eight most mentioned places."""
    x = ents.where("categoria = 'lugares'").select("articulo_id", T.plain(F.col("texto")).alias("entidad")).join(articles(arts), F.col("articulo_id") == F.col("id"))
    g = x.groupBy("entidad", "numero").agg(F.count(F.lit(1)).alias("menciones"))
    best = top(g.groupBy("entidad").agg(F.sum("menciones").alias("n")), 8, F.desc("n"), F.asc("entidad"))
    return g.join(F.broadcast(best.select("entidad")), "entidad", "left_semi")  # eight rows


_SCORE = "case when verificada = 1 then 1.0 else (coalesce(0.3 * confianza, 0) + case when wikidata_id <> '' then 0.25 else 0 end + case when n is not null then 0.45 * least(1.0, n / 4.0) else 0 end) / ((case when confianza is not null then 0.3 else 0 end) + case when wikidata_id <> '' then 0.25 else 0 end + case when n is not null then 0.45 else 0 end) end"


@q("a39_entity_confidence", f"with k as (select categoria, {N} as norma, count(distinct articulo_id) as n from entidades group by 1, 2), x as (select e.*, {N} as norma from entidades e) select id, round({_SCORE}, 4) as puntaje from x join k using (categoria, norma)", "entidades")
def confidence(ents: DataFrame) -> DataFrame:
    """Weighted mean of the signals that are there; verified mentions are certain."""
    return E.confidence(ents).select("id", F.round("p", 4).alias("puntaje"))


@q("a40_entity_grading", f"with k as (select categoria, {N} as norma, count(distinct articulo_id) as n from entidades group by 1, 2), x as (select e.*, {N} as norma from entidades e), s as (select categoria, round({_SCORE}, 4) as p from x join k using (categoria, norma)) select categoria, case when p >= 0.75 then 'verde' when p >= 0.45 then 'amarillo' else 'rojo' end as nivel, count(*) as n from s group by 1, 2", "entidades")
def grading(ents: DataFrame) -> DataFrame:
    from telarium.operators.cleaning import level

    x = E.confidence(ents).select("categoria", F.round("p", 4).alias("p"))
    return x.groupBy("categoria", level(F.col("p")).alias("nivel")).agg(F.count(F.lit(1)).alias("n"))


@q("a41_review_queue", f"with k as (select categoria, {N} as nombre, count(distinct articulo_id) as n, bool_or(wikidata_id <> '') as kb from entidades group by 1, 2), s as (select categoria, nombre, n, case when coalesce(kb, false) then 1.0 else least(1.0, 0.05 + 0.25 * n) end as puntaje from k) select categoria, nombre, n, round(puntaje, 2) as puntaje, case when puntaje >= 0.45 then 'amarillo' else 'rojo' end as nivel from s where puntaje < 0.75", "entidades")
def queue(ents: DataFrame) -> DataFrame:
    """Names below green, by the number of their articles."""
    g = ents.groupBy("categoria", T.plain(F.col("texto")).alias("nombre")).agg(F.countDistinct("articulo_id").alias("n"), F.max(F.coalesce(F.col("wikidata_id") != "", F.lit(False))).alias("kb"))
    s = g.withColumn("p", F.when(F.col("kb"), 1.0).otherwise(F.least(F.lit(1.0), 0.05 + 0.25 * F.col("n"))))
    return s.where("p < 0.75").select("categoria", "nombre", "n", F.round("p", 2).alias("puntaje"), F.when(F.col("p") >= 0.45, "amarillo").otherwise("rojo").alias("nivel"))


@q("a45_annotation_statistics", "select estado, categoria, count(*) as n, grouping(estado)::int + 2 * grouping(categoria)::int as nivel from anotaciones group by grouping sets ((estado), (categoria), ())", "anotaciones")
def annotation_statistics(ann: DataFrame) -> DataFrame:
    """Total, by state and by category in one pass."""
    out = ann.groupingSets([["estado"], ["categoria"], []], "estado", "categoria").agg(F.count(F.lit(1)).alias("n"), (F.grouping("estado") + 2 * F.grouping("categoria")).cast("int").alias("nivel"))
    return out


@q("a46_note_counts", "select categoria, count(*) as n, sum((estado = 'rechazada')::int) as rechazadas from anotaciones where coalesce(notas, '') <> '' group by 1", "anotaciones")
def note_counts(ann: DataFrame) -> DataFrame:
    return ann.where(F.coalesce("notas", F.lit("")) != "").groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("estado") == "rechazada").cast("int")).alias("rechazadas"))


@q("pf17_note_search", "select id, notas, estado from anotaciones where notas ilike '%dudoso%' and estado = 'confirmada'", "anotaciones")
def note_search(ann: DataFrame) -> DataFrame:
    return ann.where(F.col("notas").ilike("%dudoso%") & (F.col("estado") == "confirmada")).select("id", "notas", "estado")


@q("pf16_vocabulary_filter", "select texto_norm, categoria, descripcion from autoridades_cache where contains(lower(texto_norm || ' ' || coalesce(descripcion, '')), 'pintor') and categoria = 'personas'", "autoridades_cache")
def vocabulary_filter(aut: DataFrame) -> DataFrame:
    return aut.where(F.lower(F.concat("texto_norm", F.lit(" "), F.coalesce("descripcion", F.lit("")))).contains("pintor") & (F.col("categoria") == "personas")).select("texto_norm", "categoria", "descripcion")


@q("pf18_kb_search", "select texto_norm, categoria, wikidata_lbl from autoridades_cache where texto_norm ilike '%antonio%'", "autoridades_cache")
def kb_search(aut: DataFrame) -> DataFrame:
    return aut.where(F.col("texto_norm").ilike("%antonio%")).select("texto_norm", "categoria", "wikidata_lbl")


_VOC = "v as (select lower(texto_norm) as termino, categoria, descripcion as definicion, 1 as r from autoridades_cache union all select lower(texto), categoria, json_extract_string(resultado, '$.description'), 2 from cache_wikidata union all select lower(nombre), categoria, null, 3 from revision_entidades), k as (select *, row_number() over (partition by termino, categoria order by coalesce(definicion, '') <> '' desc, r, definicion) as p from v)"


@q("j16_vocabulary_merge", f"with {_VOC} select termino, categoria, definicion, r as fuente from k where p = 1", "autoridades_cache", "cache_wikidata", "revision_entidades")
def vocabulary(aut: DataFrame, cache: DataFrame, rev: DataFrame) -> DataFrame:
    """Three sources; a definition wins, then the order of the sources."""
    return E.vocabulary(aut, cache, rev)


@q("a68_vocabulary_statistics", f"with {_VOC}, u as (select * from k where p = 1) select categoria, r as fuente, count(*) as n from u group by grouping sets ((categoria), (r), ())", "autoridades_cache", "cache_wikidata", "revision_entidades")
def vocabulary_statistics(aut: DataFrame, cache: DataFrame, rev: DataFrame) -> DataFrame:
    return E.vocabulary(aut, cache, rev).groupingSets([["categoria"], ["fuente"], []], "categoria", "fuente").agg(F.count(F.lit(1)).alias("n"))


@q("a64_glossary", f"select categoria, {N} as palabra, arg_min(texto, id) as forma, count(distinct articulo_id) as articulos from entidades group by 1, 2", "entidades")
def glossary(ents: DataFrame) -> DataFrame:
    """The first form wins, articles are collected."""
    return ents.groupBy("categoria", T.plain(F.col("texto")).alias("palabra")).agg(F.min_by("texto", "id").alias("forma"), F.countDistinct("articulo_id").alias("articulos"))


@q("a56_entity_comparison", f"with x as (select distinct fuente, categoria, {N} as entidad from entidades where fuente is not null), k as (select categoria, count(distinct fuente) as m from x group by 1), c as (select categoria, entidad, count(*) as fuentes from x group by 1, 2) select categoria, entidad, fuentes, fuentes = m as comun from c join k using (categoria)", "entidades")
def entity_comparison(ents: DataFrame) -> DataFrame:
    """In how many sources each name is, and whether in all that have the category."""
    x = ents.where("fuente is not null").select("fuente", "categoria", T.plain(F.col("texto")).alias("entidad")).distinct()
    k = x.groupBy("categoria").agg(F.countDistinct("fuente").alias("m"))
    c = x.groupBy("categoria", "entidad").agg(F.count(F.lit(1)).alias("fuentes"))
    return c.join(F.broadcast(k), "categoria").select("categoria", "entidad", "fuentes", (F.col("fuentes") == F.col("m")).alias("comun"))  # a row a category


@q("a57_topic_comparison", "select seccion, count(distinct estado) = (select count(distinct estado) from articulos where seccion is not null) as comun, count(*) as n from articulos where seccion is not null group by 1", "articulos")
def topic_comparison(arts: DataFrame) -> DataFrame:
    x = arts.where("seccion is not null")
    m = F.broadcast(x.agg(F.countDistinct("estado").alias("m")))  # one row
    g = x.groupBy("seccion").agg(F.countDistinct("estado").alias("k"), F.count(F.lit(1)).alias("n"))
    return g.crossJoin(m).select("seccion", (F.col("k") == F.col("m")).alias("comun"), "n")


_NER = r"regexp_extract_all(text, '\p{Lu}\p{Ll}+(?: (?:de |del |la )?\p{Lu}\p{Ll}+){1,20}')"


@q("f20_named_entities", f"select doc_id, e as texto, count(*) as n from (select doc_id, unnest({_NER}) as e from documents where text is not null) group by 1, 2", "documents")
def recogniser(docs: DataFrame) -> DataFrame:
    """The rule that stands in for a model: runs of capitalised words."""
    return E.recognise(docs).groupBy("doc_id", "texto").agg(F.count(F.lit(1)).alias("n"))


@q("f21_align_spans", r"with t as (select articulo_id, arg_max(texto_crudo, id) as t from ocr where texto_crudo is not null group by 1), x as (select a.id, t, greatest(0, least(inicio_char, length(t)))::int as a, greatest(0, least(fin_char, length(t)))::int as b from anotaciones a join t on a.art_id = t.articulo_id where inicio_char is not null and fin_char is not null) select id, (a - length(regexp_extract(substr(t, 1, a), '([\p{L}\p{N}]*)$', 1)))::int as inicio, (b + length(regexp_extract(substr(t, b + 1), '^([\p{L}\p{N}]*)', 1)))::int as fin from x", "anotaciones", "ocr")
def align(ann: DataFrame, ocr: DataFrame) -> DataFrame:
    """Spans moved out to the limits of words of the article's last text."""
    t = ocr.where("texto_crudo is not null").groupBy("articulo_id").agg(F.max_by("texto_crudo", "id").alias("t"))
    x = ann.where("inicio_char is not null and fin_char is not null").join(t, F.col("art_id") == F.col("articulo_id"))
    return x.select("id", E.align(F.col("t"), F.col("inicio_char"), F.col("fin_char")).alias("s")).select("id", "s.inicio", "s.fin")


@q("f41_link_scores", "with c as (select texto, categoria, json_extract_string(resultado, '$.label') as label, coalesce(json_extract_string(resultado, '$.description'), '') as d, try_cast(json_extract_string(resultado, '$.confianza') as double) as conf from cache_wikidata where resultado is not null) select texto, categoria, round(case when lower(label) = lower(texto) then 2.0 else 1.0 - least(1.0, levenshtein(strip_accents(lower(label)), strip_accents(lower(texto))) / 20.0) end + case when d <> '' then 0.5 else 0 end + coalesce(conf, 0), 4) as puntaje from c where label is not null", "cache_wikidata")
def link_scores(cache: DataFrame) -> DataFrame:
    """Label match, description and rank of the cached candidates."""
    return E.link_scores(cache)


@q("f42_link_decision", "with c as (select texto, categoria, json_extract_string(resultado, '$.id') as qid, json_extract_string(resultado, '$.label') as label, coalesce(json_extract_string(resultado, '$.description'), '') as d, try_cast(json_extract_string(resultado, '$.confianza') as double) as conf from cache_wikidata where resultado is not null), s as (select texto, categoria, qid, round(case when lower(label) = lower(texto) then 2.0 else 1.0 - least(1.0, levenshtein(strip_accents(lower(label)), strip_accents(lower(texto))) / 20.0) end + case when d <> '' then 0.5 else 0 end + coalesce(conf, 0), 4) as p from c where label is not null), b as (select texto, arg_max(qid, struct_pack(p := p, qid := qid)) as qid, max(p) as p from s where p >= 0.3 group by 1) select texto, qid, round(least(1.0, p / 4), 4) as confianza from b where p / 4 >= 0.45", "cache_wikidata")
def link_decision(cache: DataFrame) -> DataFrame:
    """The best candidate of each text whose confidence suffices."""
    s = E.link_scores(cache, keep=["qid"]).where("puntaje >= 0.3")
    b = s.groupBy("texto").agg(F.max_by("qid", F.struct("puntaje", "qid")).alias("qid"), F.max("puntaje").alias("p"))
    return b.where("p / 4 >= 0.45").select("texto", "qid", F.round(F.least(F.lit(1.0), F.col("p") / 4), 4).alias("confianza"))


@q("u10_link_cache", "select texto, categoria, resultado is not null as hallado from cache_wikidata where algo_version = (select max(algo_version) from cache_wikidata) and consultado is not null", "cache_wikidata")
def link_cache(cache: DataFrame) -> DataFrame:
    """Rows of an older algorithm are misses; a null result is a known absence."""
    v = F.broadcast(cache.agg(F.max("algo_version").alias("v")))  # one row
    return cache.crossJoin(v).where("algo_version = v and consultado is not null").select("texto", "categoria", F.col("resultado").isNotNull().alias("hallado"))


@q("w17_pronoun_chains", r"with s as (select doc_id, regexp_split_to_array(text, '[.!?]+') as s from documents where text is not null), e as (select doc_id, unnest(s) as o, unnest(generate_series(1, len(s))) as k from s), p as (select doc_id, k, len(regexp_extract_all(o, '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,20}')) as personas, len(list_filter(regexp_extract_all(lower(o), '\p{L}+'), lambda w: w in ('él', 'ella', 'ellos', 'ellas', 'su', 'sus'))) as pron from e) select a.doc_id, a.k::int as oracion, a.personas::int as personas, sum(b.pron)::bigint as pronombres from p a join p b on b.doc_id = a.doc_id and b.k between a.k + 1 and a.k + 3 where a.personas > 0 group by 1, 2, 3", "documents")
def chains(docs: DataFrame) -> DataFrame:
    """Pronouns in the three sentences after a mention; neighbours are taken in the list of sentences."""
    s = F.split("text", "[.!?]+")
    x = docs.where("text is not null").select("doc_id", F.transform(s, lambda o: F.struct(F.size(F.regexp_extract_all(o, F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,20})"), 1)).alias("personas"), F.size(F.filter(F.regexp_extract_all(F.lower(o), F.lit(r"(\p{L}+)"), 1), lambda w: w.isin("él", "ella", "ellos", "ellas", "su", "sus"))).cast("long").alias("pron"))).alias("s"))
    rows = x.select("doc_id", "s", F.posexplode("s").alias("i", "e")).where(F.col("e.personas") > 0)
    after = F.slice("s", F.col("i") + 2, F.lit(3))
    return rows.where(F.size(after) > 0).select("doc_id", (F.col("i") + 1).alias("oracion"), "e.personas", F.aggregate(after, F.lit(0).cast("long"), lambda a, y: a + y["pron"]).alias("pronombres"))


@q("a58_coref_statistics", rf"select count(*) as cadenas, round(avg(n), 3) as media, max(n) as mayor from (select count(*) as n from (select doc_id, unnest({_NER}) as e from documents where text is not null) group by doc_id, e having count(*) > 1)", "documents")
def coref(docs: DataFrame) -> DataFrame:
    c = E.recognise(docs).groupBy("doc_id", "texto").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.agg(F.count(F.lit(1)).alias("cadenas"), F.round(F.avg("n"), 3).alias("media"), F.max("n").alias("mayor"))


_SVO = r"regexp_extract_all(lower(text), '(?:el|la|un|una) (\p{L}+) (vendió|copió|pagó|criticó|celebró|recorrió) (?:el|la|un|una) (\p{L}+)')"


@q("a59_relations_by_verb", rf"with r as (select unnest({_SVO}) as r from documents where text is not null) select regexp_extract(r, ' (vendió|copió|pagó|criticó|celebró|recorrió) ', 1) as verbo, count(*) as n, count(distinct r) as distintas from r group by 1", "documents")
def by_verb(docs: DataFrame) -> DataFrame:
    """Subject, verb and object triples grouped by verb."""
    verbs = "vendió|copió|pagó|criticó|celebró|recorrió"
    r = docs.where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"((?:el|la|un|una) \p{{L}}+ (?:{verbs}) (?:el|la|un|una) \p{{L}}+)"), 1)).alias("r"))
    return r.groupBy(F.regexp_extract("r", f" ({verbs}) ", 1).alias("verbo")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("r").alias("distintas"))


@q("a63_signature_frequency", "select autor, count(*) as n, count(distinct numero) as numeros from articulos where coalesce(trim(autor), '') not in ('', 'nan') group by 1 order by n desc, autor limit 60", "articulos")
def signatures(arts: DataFrame) -> DataFrame:
    g = arts.where(~F.coalesce(F.trim("autor"), F.lit("")).isin("", "nan")).groupBy("autor").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("numero").alias("numeros"))
    return top(g, 60, F.desc("n"), F.asc("autor"))


@q("t9_review_sample", "select id, texto, categoria, '' as codigo from entidades order by md5('42-' || id), id limit 100", "entidades")
def review_sample(ents: DataFrame) -> DataFrame:
    """A seeded sample with blank coding columns; the size is the feature."""
    return ents.orderBy(F.md5(F.concat(F.lit("42-"), F.col("id").cast("string")).cast("binary")), "id").limit(100).select("id", "texto", "categoria", F.lit("").alias("codigo"))
