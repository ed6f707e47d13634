"""Queries of similar texts, words and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.operators import similarity as S
from telarium.operators.lexical import counts, top
from telarium.plans.lexical import STOP, sql_tokens, toks
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_V = f"""{sql_tokens(4, True)}, n as (select count(*) as n from tok where len(t) > 0), e as (select doc_id, w, count(*) as tf from (select doc_id, unnest(t) as w from tok) group by 1, 2),
d as (select w, count(*) as df from e group by w), r as (select doc_id, w, tf * (ln(n / df) + 1) as y from e join d using (w), n), m as (select doc_id, sqrt(sum(y * y)) as norm from r group by 1), v as (select doc_id, w, y / norm as x from r join m using (doc_id))"""


@q("j4_similar_pairs", f"with {_V} select a.doc_id as a, b.doc_id as b, round(sum(a.x * b.x), 3) as sim from v a join v b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2 having sum(a.x * b.x) >= 0.8", "documents")
def similar_pairs(docs: DataFrame) -> DataFrame:
    return S.cosine_pairs(S.tfidf(toks(docs, 4, STOP)), 0.8).select("a", "b", F.round("sim", 3).alias("sim"))


@q("g6_intertextual_graph", f"with {_V}, s as (select a.doc_id as a, b.doc_id as b, sum(a.x * b.x) as sim from v a join v b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2 having sum(a.x * b.x) >= 0.25), x as (select a as nodo from s union all select b from s) select nodo, count(*) as grado from x group by 1", "documents")
def intertextual(docs: DataFrame) -> DataFrame:
    return S.cosine_degrees(S.tfidf(toks(docs, 4, STOP)), 0.25)


@q("j6_duplicate_pairs", f"with {sql_tokens(4)}, s as (select doc_id, list_distinct(t) as t from tok where len(t) > 0), e as (select doc_id, len(t) as n, unnest(t) as w from s), c as (select a.doc_id as a, b.doc_id as b, count(*) / least(any_value(a.n), any_value(b.n)) as c from e a join e b on a.w = b.w and a.doc_id < b.doc_id group by 1, 2) select a, b, round(c, 4) as coef from c where round(c, 4) >= 0.5", "documents")
def duplicate_pairs(docs: DataFrame) -> DataFrame:
    return S.overlap_pairs(toks(docs, 4), 0.5)


_J18 = f"with {sql_tokens(4)}, c as (select w, count(*) as n from (select unnest(t) as w from tok) group by w), e as (select *, translate(w, 'áéíóúüñ', '1234567') as f from c), p as (select r.w as r, g.w as g, g.n as gn, levenshtein(r.f, g.f) as d from e r join e g on r.n < 5 and g.n >= 5 and abs(length(r.w) - length(g.w)) <= 2), k as (select *, row_number() over (partition by r order by gn desc, d, g) as puesto from p where d <= 2) select r as palabra, g as sugerencia, d, puesto from k where puesto <= 5"


@q("j18_nearest_seeds", _J18, "documents")
def nearest_seeds(docs: DataFrame) -> DataFrame:
    """Frequent words within two edits of each rare word, the five most frequent.

    Words are met over three segments of the frequent one and shifted substrings, not all with all.
    """
    c = counts(toks(docs, 4))
    frequent = c.where("n >= 5").select(F.col("w").alias("g"), F.col("n").alias("gn"))
    rare = c.where("n < 5").select(F.col("w").alias("r"))
    size = lambda n: F.floor(n / 3)
    pieces = F.array(*(F.struct(F.lit(i).alias("i"), F.length("g").alias("m"), F.substring("g", size(F.length("g")) * i + 1, size(F.length("g")) if i < 2 else F.length("g") - 2 * size(F.length("g"))).alias("s")) for i in range(3)))
    index = frequent.select("g", "gn", F.explode(pieces).alias("k"))
    lengths = F.explode(F.sequence(F.greatest(F.length("r") - 2, F.lit(4)), F.length("r") + 2))
    p = rare.select("r", lengths.alias("m")).select("r", "m", F.explode(F.array(*map(F.lit, range(3)))).alias("i"))
    width = F.when(F.col("i") < 2, size(F.col("m"))).otherwise(F.col("m") - 2 * size(F.col("m")))
    start = size(F.col("m")) * F.col("i") + 1
    p = p.select("r", "m", "i", width.alias("width"), F.explode(F.sequence(F.greatest(start - 2, F.lit(1)), F.greatest(start + 2, F.lit(1)))).alias("at"))
    p = p.select("r", F.struct("i", F.col("m").cast("int").alias("m"), F.substring("r", F.col("at").cast("int"), F.col("width").cast("int")).alias("s")).alias("k")).distinct()
    near = p.join(index, "k").select("r", "g", "gn").distinct().withColumn("d", F.levenshtein("r", "g", 2)).where("d >= 0")
    rank = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("gn"), "d", "g"))
    return near.withColumn("puesto", rank).where("puesto <= 5").select(F.col("r").alias("palabra"), F.col("g").alias("sugerencia"), "d", "puesto")


# DuckDB counts edits of bytes: every character beyond ASCII becomes a byte of its own there, one for one
_SPARE = "array_to_string(list_transform(generate_series(1, 31), lambda i: chr(i::int)), '')"
_CH = "ch as (select coalesce(string_agg(c, '' order by c), '') as f from (select distinct unnest(regexp_extract_all({x}, '[^ -~]')) as c from x))"


@q("f28_bounded_levenshtein", f"with x as (select nombre, nombre_nuevo, strip_accents(nombre) as a, strip_accents(nombre_nuevo) as b from revision_entidades where nombre_nuevo <> ''), {_CH.format(x='a || b')} select nombre, nombre_nuevo, case when abs(length(nombre) - length(nombre_nuevo)) > 3 then 99 else levenshtein(translate(a, f, {_SPARE}), translate(b, f, {_SPARE})) end as d from x, ch", "revision_entidades")
def bounded(rev: DataFrame) -> DataFrame:
    """99 where the lengths differ by more than three."""
    from telarium.functions.text import stripped

    x = rev.where("nombre_nuevo <> '' and nombre is not null").withColumn("a", stripped(F.col("nombre"))).withColumn("b", stripped(F.col("nombre_nuevo")))
    return x.select("nombre", "nombre_nuevo", F.when(F.abs(F.length("nombre") - F.length("nombre_nuevo")) > 3, 99).otherwise(F.levenshtein("a", "b")).alias("d"))


@q("f27_levenshtein", f"with x as (select texto_norm, lower(strip_accents(wikidata_lbl)) as etiqueta from autoridades_cache where wikidata_lbl is not null), {_CH.format(x='texto_norm || etiqueta')} select texto_norm, etiqueta, levenshtein(translate(texto_norm, f, {_SPARE}), translate(etiqueta, f, {_SPARE})) as d from x, ch", "autoridades_cache")
def levenshtein(aut: DataFrame) -> DataFrame:
    from telarium.functions.text import stripped

    x = aut.where("wikidata_lbl is not null and texto_norm is not null").withColumn("etiqueta", stripped(F.lower("wikidata_lbl")))
    return x.select("texto_norm", "etiqueta", F.levenshtein("texto_norm", "etiqueta").alias("d"))


@q("f27_word_distance", None, "ocr")
def word_distance(ocr: DataFrame) -> DataFrame:
    x = ocr.where("texto_limpio <> '' and texto_crudo is not null")
    return x.select("id", S.word_distance("texto_limpio", "texto_crudo").alias("d"))


@q("f30_disagreement", None, "autoridades_cache")
def disagreement(aut: DataFrame) -> DataFrame:
    return aut.where("wikidata_lbl is not null").select("texto_norm", "categoria", S.disagreement("texto_norm", F.lower("wikidata_lbl")).alias("d"))


@q("f31_disputed_words", None, "autoridades_cache")
def disputed(aut: DataFrame) -> DataFrame:
    return aut.where("wikidata_lbl is not null").select("texto_norm", "categoria", S.disputed("texto_norm", F.lower("wikidata_lbl")).alias("palabras"))


@q("f46_corrected_share", None, "revision_entidades")
def corrected(rev: DataFrame) -> DataFrame:
    x = rev.where("nombre_nuevo <> ''")
    return x.select("nombre", "categoria", F.round(S.disagreement("nombre", "nombre_nuevo") * 100, 2).alias("pct"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
_COS = f"{_DOT.format(a='q.embedding', b='e.embedding')} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='e.embedding', b='e.embedding')}))"


@q("t4_vector_topk", f"with s as (select q.vec_id as consulta, e.vec_id, round({_COS}, 4) as sim from embeddings q, embeddings e where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by consulta order by sim desc, vec_id) as puesto from s) select * from r where puesto <= 10", "embeddings")
def vector_topk(emb: DataFrame) -> DataFrame:
    """Every id divisible by a hundred is a query against all rows."""
    return S.vector_topk(emb, emb.where("vec_id % 100 = 0"), 10)


@q("t5_similar_in_class", f"with s as (select q.vec_id as consulta, e.vec_id, round({_COS}, 4) as sim from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 100 = 0), r as (select *, row_number() over (partition by consulta order by sim desc, vec_id) as puesto from s) select * from r where puesto <= 5", "embeddings")
def similar_in_class(emb: DataFrame) -> DataFrame:
    """The stated queries against all rows of their class, joined in the JVM."""
    qs = emb.where("vec_id % 100 = 0").select(F.col("vec_id").alias("consulta"), F.col("embedding").alias("qv"), "label")
    s = emb.join(qs, "label").where("vec_id <> consulta").select("consulta", "vec_id", F.round(S.cosine(F.col("qv"), F.col("embedding")), 4).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("consulta").orderBy(F.desc("sim"), "vec_id"))
    return s.withColumn("puesto", rank).where("puesto <= 5")


_CEN = "c as (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(generate_series(1, len(embedding))) as i from embeddings) group by 1, 2), k as (select label, list(x order by i) as embedding from c group by 1)"


@q("m5_centroid_attribution", f"with {_CEN}, s as (select q.vec_id, e.label as candidata, round({_COS}, 4) as sim from embeddings q, k e), r as (select *, row_number() over (partition by vec_id order by sim desc, candidata) as puesto from s) select vec_id, candidata, sim, puesto from r where puesto <= 3", "embeddings")
def attribution(emb: DataFrame) -> DataFrame:
    """The three nearest class centroids of each vector."""
    parts = emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    cen = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("cv")).withColumnRenamed("label", "candidata")
    s = emb.crossJoin(F.broadcast(cen)).select("vec_id", "candidata", F.round(S.cosine(F.col("embedding"), F.col("cv")), 4).alias("sim"))  # a row a class
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "candidata"))
    return s.withColumn("puesto", rank).where("puesto <= 3")


@q("f36_search_summary", f"with {sql_tokens(4, True)}, h as (select doc_id, t from tok where list_contains(t, 'orquesta')), c as (select w, count(*) as n from (select unnest(t) as w from h) where w <> 'orquesta' group by w order by n desc, w limit 5) select (select count(*) from h) as documentos, string_agg(w, ', ' order by n desc, w) as terminos from c", "documents")
def search_summary(docs: DataFrame) -> DataFrame:
    h = toks(docs, 4, STOP).where(F.array_contains("t", "orquesta"))
    best = top(counts(h).where("w <> 'orquesta'"), 5, F.desc("n"), F.asc("w"))
    terms = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))), lambda z: z["w"]), ", ").alias("terminos"))
    return h.agg(F.count(F.lit(1)).alias("documentos")).crossJoin(terms)  # one row each


@q("f35_search_explanation", r"with s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) as o, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) as k from documents where contains(lower(text), 'orquesta')), n as (select doc_id, o, k, len(list_filter(regexp_extract_all(lower(o), '\p{L}+'), lambda w: w in ('orquesta', 'teatro', 'zarzuela'))) as n from s) select doc_id, max(n) as terminos, trim(arg_max(o, struct_pack(n := n, k := -k)), ' ' || chr(10)) as frase from n group by 1", "documents")
def explanation(docs: DataFrame) -> DataFrame:
    """The sentence with most of the terms, the first of equals."""
    s = docs.where(F.lower("text").contains("orquesta")).select("doc_id", F.posexplode(F.split("text", "[.!?]+")).alias("k", "o"))
    n = F.size(F.filter(F.regexp_extract_all(F.lower("o"), F.lit(r"(\p{L}+)"), 1), lambda w: w.isin("orquesta", "teatro", "zarzuela")))
    x = s.withColumn("n", n).groupBy("doc_id").agg(F.max("n").alias("terminos"), F.max_by("o", F.struct("n", -F.col("k"))).alias("frase"))
    return x.withColumn("frase", F.trim("frase", F.lit(" \n")))
