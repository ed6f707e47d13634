"""Queries of the word statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import lexical as L
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

STOP = ["que", "con", "por", "para", "una", "del", "las", "los", "nuestro", "nuestra", "aquel", "aquella", "según", "cuando", "pesos", "dijo", "the", "les"]
FIELD = {"prensa": ["gaceta", "periódico", "revista", "imprenta"], "escena": ["teatro", "zarzuela", "comedia", "orquesta"], "campo": ["cosecha", "hacienda", "cafetal", "molino"]}
_STOP = ", ".join(f"'{w}'" for w in STOP)


def sql_tokens(least: int = 3, stop: bool = False) -> str:
    """A CTE `tok` (doc_id, source, lang, anio, publicacion, t)."""
    keep = f"regexp_full_match(x, '[a-záéíóúüñ]{{{least},}}')" + (f" and x not in ({_STOP})" if stop else "")
    return rf"""tok as (select doc_id, source, lang, anio, publicacion,
  list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda x: {keep}) as t from documents)"""


def toks(docs: DataFrame, least: int = 3, stop: list[str] | None = None) -> DataFrame:
    return docs.select("doc_id", "source", "lang", "anio", "publicacion", T.tokens(F.col("text"), least, stop).alias("t"))


@q("a1_term_frequency", f"with {sql_tokens(3, True)}, e as (select doc_id, unnest(t) as w from tok) select w, count(*) as tf, count(distinct doc_id) as df from e group by w", "documents")
def term_frequency(docs: DataFrame) -> DataFrame:
    return L.frequencies(toks(docs, 3, STOP))


@q("f1_tokens", f"with {sql_tokens()} select doc_id, len(t) as n, array_to_string(t, ' ') as palabras from tok", "documents")
def tokens(docs: DataFrame) -> DataFrame:
    return toks(docs).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("palabras"))


@q("f2_tokens4", f"with {sql_tokens(4, True)} select doc_id, len(t) as n, array_to_string(t, ' ') as palabras from tok", "documents")
def tokens4(docs: DataFrame) -> DataFrame:
    return toks(docs, 4, STOP).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("palabras"))


@q("f3_loose_tokens", f"select doc_id, len(t) as n, array_to_string(t, ' ') as palabras from (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-záéíóúüñ]{{3,}}'), lambda x: length(x) >= 4 and x not in ({_STOP})) as t from documents where text is not null)", "documents")
def loose(docs: DataFrame) -> DataFrame:
    t = T.loose_tokens(F.col("text"), 4, STOP)
    return docs.where("text is not null").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("palabras"))


def _sql_ngrams(n: int) -> str:
    return f"with {sql_tokens()}, g as (select unnest(list_transform(generate_series(1, len(t) - {n - 1}), lambda i: array_to_string(t[i:i + {n - 1}], ' '))) as ngrama from tok where len(t) >= {n}) select ngrama, count(*) as n from g group by ngrama"


for _n in (2, 3):

    @q(f"a2_ngrams{_n}", f"select * from ({_sql_ngrams(_n)}) where n >= 3", "documents")
    def ngrams(docs: DataFrame, n: int = _n) -> DataFrame:
        """All n-grams that occur three times."""
        return L.ngrams(toks(docs), n).where("n >= 3")


@q("a2_ngrams_top", f"select * from (select * from ({_sql_ngrams(2)}) order by n desc, ngrama limit 100) where n >= 2", "documents")
def ngrams_top(docs: DataFrame) -> DataFrame:
    """The report: the top hundred first, the least frequency afterwards."""
    return L.top(L.ngrams(toks(docs), 2), 100, F.desc("n"), F.asc("ngrama")).where("n >= 2")


@q("a3_collocates", f"""with {sql_tokens(3, True)},
p as (select doc_id, t, unnest(generate_series(1, len(t))) as i from tok where list_contains(t, 'orquesta')),
h as (select t, i from p where t[i] = 'orquesta'),
x as (select unnest(list_concat(t[greatest(i - 5, 1):i - 1], t[i + 1:i + 5])) as w from h),
f as (select w, count(*) as f from x where w <> 'orquesta' group by w order by f desc, w limit 60),
tot as (select w, count(*) as n from (select unnest(t) as w from tok) group by w),
s as (select sum(n) as size, sum(n) filter (w = 'orquesta') as hit_n from tot), k as (select count(*) as windows from h)
select w, f, round(log2((f / windows) / ((hit_n / size) * (n / size) + 1e-10) + 1e-10), 3) as pmi
from f join tot using (w), s, k order by pmi desc, f desc, w limit 20""", "documents")
def collocates(docs: DataFrame) -> DataFrame:
    return L.collocates(toks(docs, 3, STOP), "orquesta", 5, 20)


@q("a4_lexical_network", f"""with {sql_tokens(3, True)}, c as (select w, count(*) as n from (select unnest(t) as w from tok) group by w order by n desc, w limit 40),
p as (select doc_id, unnest(t) as w, unnest(generate_series(1, len(t))) as i from tok), k as (select p.* from p semi join c using (w))
select least(a.w, b.w) as a, greatest(a.w, b.w) as b, count(*) as peso from k a join k b on a.doc_id = b.doc_id and a.i <> b.i and abs(a.i - b.i) <= 5
group by 1, 2 having count(*) >= 2""", "documents")
def lexical_network(docs: DataFrame) -> DataFrame:
    return L.lexical_network(toks(docs, 3, STOP), 40, 5, 2)


_PERIOD = f"with {sql_tokens(4, True)}, bp as (select anio as periodo, w, count(*) as n from (select anio, unnest(t) as w from tok where anio is not null) group by 1, 2)"


def by_period(docs: DataFrame) -> DataFrame:
    return L.counts(toks(docs.where("anio is not null"), 4, STOP).withColumnRenamed("anio", "periodo"), "periodo")


@q("a5_period_tfidf", _PERIOD + """, d as (select w, count(*) as df from bp group by w), t as (select periodo, sum(n) as total from bp group by 1), k as (select count(*) as k from t)
select periodo, w, round(n / total * (ln((k + 1) / (df + 1)) + 1), 6) as tfidf from bp join d using (w) join t using (periodo), k""", "documents")
def period_tfidf(docs: DataFrame) -> DataFrame:
    counted = by_period(docs)
    return L.period_tfidf(counted, docs.where("anio is not null").select("anio").distinct().count())


@q("a6_new_words", _PERIOD + "select min(periodo) as periodo, w, arg_min(n, periodo) as n from bp group by w having arg_min(n, periodo) >= 3", "documents")
def new_words(docs: DataFrame) -> DataFrame:
    return L.new_words(by_period(docs), 3)


@q("a7_discursive_change", _PERIOD + """, o as (select periodo, row_number() over (order by periodo) as k from (select distinct periodo from bp)),
x as (select k, bp.* from bp join o using (periodo)), m as (select k, any_value(periodo) as periodo, sqrt(sum(n * n)) as norm from x group by k),
d as (select a.k, sum(a.n * b.n) as dot from x a join x b on b.k = a.k + 1 and a.w = b.w group by a.k)
select a.periodo as desde, b.periodo as hasta, round(1 - coalesce(dot, 0) / (a.norm * b.norm), 4) as distancia from m a join m b on b.k = a.k + 1 left join d on d.k = a.k""", "documents")
def change(docs: DataFrame) -> DataFrame:
    return L.discursive_change(by_period(docs))


@q("a7_gains_losses", _PERIOD + """, o as (select periodo, row_number() over (order by periodo) as k from (select distinct periodo from bp)), x as (select k, w, n from bp join o using (periodo)),
j as (select coalesce(b.k - 1, a.k) as k, coalesce(a.w, b.w) as w, coalesce(b.n, 0) - coalesce(a.n, 0) as d from x a full join x b on b.k = a.k + 1 and a.w = b.w),
y as (select * from j where k between 1 and (select max(k) - 1 from o)),
r as (select *, row_number() over (partition by k order by d desc, w) as up, row_number() over (partition by k order by d, w) as down from y)
select periodo as desde, w, d as cambio from r join o using (k) where up <= 15 or down <= 15""", "documents")
def gains(docs: DataFrame) -> DataFrame:
    """Fifteen greatest gains and losses of each period against the next."""
    counted = by_period(docs)
    order = counted.select("periodo").distinct().withColumn("k", F.row_number().over(Window.orderBy("periodo")))  # a row a period
    x = counted.join(F.broadcast(order), "periodo")
    now, later = x.select("k", "w", "n"), x.select((F.col("k") - 1).alias("k"), "w", F.col("n").alias("m"))
    last = order.agg(F.max("k").alias("last"))
    y = now.join(later, ["k", "w"], "full_outer").crossJoin(F.broadcast(last)).where("k between 1 and last - 1")
    y = y.select("k", "w", (F.coalesce("m", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("cambio"))
    up = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("cambio"), "w"))
    down = F.row_number().over(Window.partitionBy("k").orderBy("cambio", "w"))
    kept = y.withColumn("up", up).withColumn("down", down).where("up <= 15 or down <= 15")
    return kept.join(F.broadcast(order), "k").select(F.col("periodo").alias("desde"), "w", "cambio")


@q("a8_events", f"""with {sql_tokens(4, True)}, o as (select anio, row_number() over (order by anio) as k from (select distinct anio from tok where anio is not null)),
dd as (select doc_id, k, t from tok join o using (anio)), win as (select o.k as v, doc_id, t from o join dd on dd.k between o.k and o.k + 2),
c as (select v, w, count(*) as n from (select v, unnest(t) as w from win) group by 1, 2),
tops as (select v, list(w) as ws from (select *, row_number() over (partition by v order by n desc, w) as r from c) where r <= 8 group by v),
s as (select v, count(*) as docs, round(avg(case when len(list_intersect(list_distinct(t), ws)) >= 3 then 1.0 else 0.0 end), 4) as coherencia from win join tops using (v) group by v)
select anio as desde, docs, coherencia from s join o on o.k = v where coherencia >= 0.4 order by coherencia desc, desde limit 20""", "documents")
def events(docs: DataFrame) -> DataFrame:
    """Windows of three years whose articles share the window's commonest words."""
    t = toks(docs.where("anio is not null"), 4, STOP)
    order = t.select("anio").distinct().withColumn("k", F.row_number().over(Window.orderBy("anio")))  # a row a year
    last = F.broadcast(order.agg(F.max("k").alias("last")))
    win = t.join(F.broadcast(order), "anio").crossJoin(last).select("doc_id", "t", F.explode(F.sequence(F.greatest(F.col("k") - 2, F.lit(1)), "k")).alias("v"))
    c = L.counts(win, "v")
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("n"), "w"))
    tops = c.withColumn("r", rank).where("r <= 8").groupBy("v").agg(F.collect_list("w").alias("ws"))
    share = F.round(F.avg(F.when(F.size(F.array_intersect("t", "ws")) >= 3, 1.0).otherwise(0.0)), 4)
    s = win.join(F.broadcast(tops), "v").groupBy("v").agg(F.count(F.lit(1)).alias("docs"), share.alias("coherencia"))
    out = s.where("coherencia >= 0.4").join(order, F.col("v") == F.col("k")).select(F.col("anio").alias("desde"), "docs", "coherencia")
    return L.top(out, 20, F.desc("coherencia"), F.asc("desde"))


@q("a9_vocabulary_trend", _PERIOD + "select periodo, round(sum(case when w in ('teatro', 'orquesta', 'zarzuela') then n else 0 end) / sum(n) * 10000, 2) as por_10000 from bp group by periodo", "documents")
def trend(docs: DataFrame) -> DataFrame:
    hit = F.when(F.col("w").isin("teatro", "orquesta", "zarzuela"), F.col("n")).otherwise(0)
    return by_period(docs).groupBy("periodo").agg(F.round(F.sum(hit) / F.sum("n") * 10000, 2).alias("por_10000"))


_CORPUS = "with c0 as (select publicacion as corpus, list_filter(regexp_extract_all(lower(text), '[a-záéíóúüñ]{3,}'), lambda x: length(x) >= 4 and x not in (" + _STOP + ")) as t from documents where text is not null and publicacion is not null), bc as (select corpus, w, count(*) as n from (select corpus, unnest(t) as w from c0) group by 1, 2)"


def by_corpus(docs: DataFrame) -> DataFrame:
    t = docs.where("text is not null and publicacion is not null").select(F.col("publicacion").alias("corpus"), T.loose_tokens(F.col("text"), 4, STOP).alias("t"))
    return L.counts(t, "corpus")


@q("a10_keyness", _CORPUS + """, aw as (select w, sum(n) as all_n from bc group by w), s as (select corpus, sum(n) as c from bc group by 1), t as (select sum(c) as total from s),
x as (select corpus, w, n::double as a, (all_n - n)::double as b, c::double as c, (total - c)::double as d from bc join aw using (w) join s using (corpus), t),
g as (select *, 2 * (a * ln(a / (c * (a + b) / (c + d))) + case when b > 0 then b * ln(b / (d * (a + b) / (c + d))) else 0 end) as g from x where d > 0),
r as (select corpus, w, a::bigint as n, round(case when a * d >= b * c then g else -g end, 1) as g2 from g),
z as (select *, row_number() over (partition by corpus order by g2 desc, n desc, w) as puesto from r) select * from z where puesto <= 40""", "documents")
def keyness(docs: DataFrame) -> DataFrame:
    return L.keyness(by_corpus(docs), 40)


_PROFILE = _CORPUS + """, s as (select corpus, sum(n) as c from bc group by 1), d as (select w, count(*) as df from bc group by w), k as (select count(*) as k from s),
pr as (select corpus, w, round(n / c * ln(k / df), 5) as peso from bc join d using (w) join s using (corpus), k where ln(k / df) > 0.1)"""


@q("a11_corpus_profile", _PROFILE + " select * from pr", "documents")
def profile(docs: DataFrame) -> DataFrame:
    return L.corpus_tfidf(by_corpus(docs))


@q("a12_cosine_matrix", _PROFILE + """, m as (select corpus, sqrt(sum(peso * peso)) as norm from pr group by 1)
select a.corpus as a, b.corpus as b, round(sum(a.peso * b.peso) / (any_value(x.norm) * any_value(y.norm)), 3) as coseno from pr a join pr b on a.w = b.w and a.corpus < b.corpus
join m x on x.corpus = a.corpus join m y on y.corpus = b.corpus where x.norm > 0 and y.norm > 0 group by 1, 2""", "documents")
def matrix(docs: DataFrame) -> DataFrame:
    return L.cosine_matrix(L.corpus_tfidf(by_corpus(docs)))


_FIELDS = [(c, w) for c, ws in FIELD.items() for w in ws]


@q("a13_field_density", "with n as (select publicacion, sum(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) as palabras, " + ", ".join(f"sum({'+'.join(f'''(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}''' for w in ws)}) as {c}" for c, ws in FIELD.items()) + " from documents where text is not null and publicacion is not null group by 1) select publicacion, " + ", ".join(f"round({c} / palabras * 1000, 2) as {c}" for c in FIELD) + " from n where palabras > 0", "documents")
def density(docs: DataFrame) -> DataFrame:
    """Substring occurrences of the terms of each field per thousand words."""
    low = F.lower("text")
    d = docs.where("text is not null and publicacion is not null").groupBy("publicacion").agg(
        F.sum(F.size(T.words(F.col("text")))).alias("palabras"),
        *(F.sum(sum((T.occurrences(low, w) for w in ws[1:]), T.occurrences(low, ws[0]))).alias(c) for c, ws in FIELD.items()),
    )
    return d.where("palabras > 0").select("publicacion", *(F.round(F.col(c) / F.col("palabras") * 1000, 2).alias(c) for c in FIELD))


@q("a15_token_density", f"with {sql_tokens()} select doc_id, round(len(list_filter(t, lambda x: x in ('teatro', 'zarzuela', 'comedia', 'orquesta'))) / len(t) * 1000, 2) as densidad from tok where len(t) > 0", "documents")
def token_density(docs: DataFrame) -> DataFrame:
    hits = F.size(F.filter("t", lambda x: x.isin(FIELD["escena"])))
    return toks(docs).where(F.size("t") > 0).select("doc_id", F.round(hits / F.size("t") * 1000, 2).alias("densidad"))


@q("a16_field_counts", f"with {sql_tokens()} select w, count(*) as n from (select unnest(t) as w from tok) where w in ('teatro', 'zarzuela', 'comedia', 'orquesta') group by w", "documents")
def field_counts(docs: DataFrame) -> DataFrame:
    return L.counts(toks(docs).withColumn("t", F.filter("t", lambda x: x.isin(FIELD["escena"]))))


@q("a20_words_by_issue", "select numero, sum(coalesce(palabras, 0)) as palabras, count(*) as articulos from articulos group by numero", "articulos")
def words_by_issue(arts: DataFrame) -> DataFrame:
    return arts.groupBy("numero").agg(F.sum(F.coalesce("palabras", F.lit(0))).alias("palabras"), F.count(F.lit(1)).alias("articulos"))


@q("a21_articles_by_type", "select coalesce(tipo, 'sin tipo') as tipo, count(*) as n from articulos group by 1 order by n desc, tipo limit 12", "articulos")
def by_type(arts: DataFrame) -> DataFrame:
    return L.top(arts.groupBy(F.coalesce("tipo", F.lit("sin tipo")).alias("tipo")).agg(F.count(F.lit(1)).alias("n")), 12, F.desc("n"), F.asc("tipo"))


@q("a22_zipf", f"with {sql_tokens()}, c as (select w, count(*) as n from (select unnest(t) as w from tok) group by w order by n desc, w limit 500), r as (select *, row_number() over (order by n desc, w) as puesto from c) select w, n, puesto, round(max(n) over () / puesto, 4) as ideal from r", "documents")
def zipf(docs: DataFrame) -> DataFrame:
    """Rank and frequency of the top 500 words, and the ideal first / rank."""
    best = L.top(L.counts(toks(docs)), 500, F.desc("n"), F.asc("w"))
    order = Window.orderBy(F.desc("n"), "w")  # 500 rows
    return best.withColumn("puesto", F.row_number().over(order)).withColumn("ideal", F.round(F.max("n").over(Window.partitionBy(F.lit(1))) / F.col("puesto"), 4))


@q("a23_length_histogram", "with m as (select min(palabras) as a, max(palabras) as b from articulos), c as (select least(30, 1 + floor((palabras - a) * 30.0 / greatest(b - a, 1)))::int as tramo from articulos, m where palabras is not null) select tramo, count(*) as n from c group by 1", "articulos")
def histogram(arts: DataFrame) -> DataFrame:
    """Thirty equal bins of article lengths."""
    ends = arts.agg(F.min("palabras").alias("a"), F.max("palabras").alias("b"))
    x = arts.where("palabras is not null").select("palabras").crossJoin(F.broadcast(ends))  # one row
    tramo = F.least(F.lit(30), 1 + F.floor((F.col("palabras") - F.col("a")) * F.lit(30.0) / F.greatest(F.col("b") - F.col("a"), F.lit(1)))).cast("int")
    return x.groupBy(tramo.alias("tramo")).agg(F.count(F.lit(1)).alias("n"))


@q("a24_confidence_quartiles", "select motor, count(*) as n, round(min(confianza), 4) as minimo, round(quantile_cont(confianza, 0.25), 4) as q1, round(quantile_cont(confianza, 0.5), 4) as mediana, round(quantile_cont(confianza, 0.75), 4) as q3, round(max(confianza), 4) as maximo from ocr where confianza is not null group by motor", "ocr")
def quartiles(ocr: DataFrame) -> DataFrame:
    """Values are counted first, so a group holds its distinct values and not its rows."""
    at = lambda p: F.round(F.percentile("confianza", F.lit(p), F.col("k")), 4)
    counted = ocr.where("confianza is not null").groupBy("motor", "confianza").agg(F.count(F.lit(1)).alias("k"))
    return counted.groupBy("motor").agg(F.sum("k").alias("n"), F.round(F.min("confianza"), 4).alias("minimo"), at(0.25).alias("q1"), at(0.5).alias("mediana"), at(0.75).alias("q3"), F.round(F.max("confianza"), 4).alias("maximo"))


@q("a61_overview", f"with {sql_tokens(3, True)}, e as (select unnest(t) as w from tok) select (select count(*) from tok) as documentos, count(*) as palabras, count(distinct w) as vocabulario from e", "documents")
def overview(docs: DataFrame) -> DataFrame:
    c = L.counts(toks(docs, 3, STOP)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("palabras"), F.count(F.lit(1)).alias("vocabulario"))
    return docs.agg(F.count(F.lit(1)).alias("documentos")).crossJoin(c)  # one row each


@q("t1_kwic", r"""with x as (select doc_id, replace(text, chr(10), ' ') as s from documents where text is not null),
p as (select doc_id, s, string_split(lower(s), 'orquesta') as parts from x where contains(lower(s), 'orquesta')),
h as (select doc_id, s, unnest(generate_series(1, len(parts) - 1)) as k, parts from p),
o as (select doc_id, s, k, list_sum(list_transform(parts[1:k], lambda y: length(y))) + 8 * (k - 1) as pos from h)
select doc_id, pos::bigint as posicion, substr(s, greatest(pos - 59, 1)::bigint, least(pos, 60)::bigint) as izquierda, substr(s, (pos + 1)::bigint, 8) as palabra, substr(s, (pos + 9)::bigint, 60) as derecha from o order by doc_id, pos limit 50""", "documents")
def kwic(docs: DataFrame) -> DataFrame:
    """Hits of a term with sixty characters on each side; the first fifty in the order of the corpus."""
    s, word = F.translate("text", "\n", " "), "orquesta"
    x = docs.where(F.lower("text").contains(word)).select("doc_id", s.alias("s"))
    parts = F.split(F.lower("s"), word)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, y: a + F.length(y)) + len(word) * (k - 1))
    at = x.select("doc_id", "s", F.explode(ends).alias("at"))
    out = at.select("doc_id", F.col("at").cast("long").alias("posicion"), F.substring("s", F.greatest(F.col("at") - 59, F.lit(1)), F.least(F.col("at"), F.lit(60))).alias("izquierda"), F.substring("s", F.col("at") + 1, F.lit(len(word))).alias("palabra"), F.substring("s", F.col("at") + len(word) + 1, F.lit(60)).alias("derecha"))
    return L.top(out, 50, F.asc("doc_id"), F.asc("posicion"))


@q("t2_dispersion", r"""with x as (select doc_id, lower(text) as s from documents where text is not null),
o as (select *, sum(length(s) + 1) over (order by doc_id) - length(s) - 1 as base, sum(length(s) + 1) over () as total from x),
p as (select *, string_split(s, 'teatro') as parts from o where contains(s, 'teatro')),
h as (select base, total, parts, unnest(generate_series(1, len(parts) - 1)) as k from p)
select round((base + list_sum(list_transform(parts[1:k], lambda y: length(y))) + 6 * (k - 1)) / total, 6) as lugar from h""", "documents")
def dispersion(docs: DataFrame) -> DataFrame:
    """Places of the hits in the concatenated corpus, as shares; offsets are running sums of range partitions."""
    # hits first: only lengths and places are sorted, never texts
    word = "teatro"
    parts = F.split(F.lower("text"), word)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda a, y: a + F.length(y)) + len(word) * (k - 1))
    s = docs.where("text is not null").select("doc_id", (F.length("text") + 1).alias("n"), F.when(F.lower("text").contains(word), ends).alias("ends"))
    bounds = s.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    cell = F.floor((F.col("doc_id") - F.col("lo")) * 1024 / (F.col("hi") - F.col("lo") + 1))
    s = s.crossJoin(F.broadcast(bounds)).withColumn("cell", cell).drop("lo", "hi")  # one row
    cells = s.groupBy("cell").agg(F.sum("n").alias("size"))  # 1024 rows
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("cell", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("total"))
    inside = Window.partitionBy("cell").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = s.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0))).where("ends is not null").join(F.broadcast(starts), "cell")
    return placed.select(F.explode("ends").alias("at"), "base", "start", "total").select(F.round((F.col("start") + F.col("base") + F.col("at")) / F.col("total"), 6).alias("lugar"))


_TERMS = ["teatro", "orquesta", "revista"]


_HITS = " + ".join(f"(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: x in ('{w}', '{w}s', '{w}es'))) > 0)::int" for w in _TERMS)


@q("t3_lexical_search", f"with h as (select doc_id, {_HITS} as n from documents where text is not null), s as (select doc_id, case when n = 3 then 1.0 else round(n / 3.0, 4) end as puntaje from h where n > 0) select doc_id, puntaje, row_number() over (order by puntaje desc, doc_id) as puesto from s order by puesto limit 50", "documents")
def search(docs: DataFrame) -> DataFrame:
    """Share of the terms found as whole words, with plural; all found is boosted and capped at one."""
    w = T.words(F.col("text"))
    hit = lambda t: F.exists(w, lambda x: x.isin(t, t + "s", t + "es")).cast("int")
    n = hit(_TERMS[0]) + hit(_TERMS[1]) + hit(_TERMS[2])
    s = docs.where("text is not null").select("doc_id", n.alias("n")).where("n > 0")
    s = s.select("doc_id", F.when(F.col("n") == 3, 1.0).otherwise(F.round(F.col("n") / 3.0, 4)).alias("puntaje"))
    best = L.top(s, 50, F.desc("puntaje"), F.asc("doc_id"))
    return best.withColumn("puesto", F.row_number().over(Window.orderBy(F.desc("puntaje"), "doc_id")))  # fifty rows


@q("t6_vocabulary_overlap", _CORPUS + """, v as (select distinct corpus, w from bc), s as (select corpus, count(*) as n from v group by 1)
select a.corpus as a, b.corpus as b, count(*) as comunes, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 4) as jaccard from v a join v b on a.w = b.w and a.corpus < b.corpus join s x on x.corpus = a.corpus join s y on y.corpus = b.corpus group by 1, 2""", "documents")
def overlap(docs: DataFrame) -> DataFrame:
    v = by_corpus(docs).select("corpus", "w")
    size = v.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    a, b = (v.select(F.col("corpus").alias(x), "w") for x in "ab")
    both = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("comunes"))
    sa, sb = (size.select(F.col("corpus").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    out = both.join(F.broadcast(sa), "a").join(F.broadcast(sb), "b")  # a row a corpus
    return out.select("a", "b", "comunes", F.round(F.col("comunes") / (F.col("na") + F.col("nb") - F.col("comunes")), 4).alias("jaccard"))


@q("t6_exclusive_words", _CORPUS + ", o as (select w, count(*) as k, min(corpus) as corpus, sum(n) as n from bc group by w having count(*) = 1), r as (select corpus, w, n, row_number() over (partition by corpus order by w) as puesto from o) select * from r where puesto <= 50", "documents")
def exclusive(docs: DataFrame) -> DataFrame:
    only = by_corpus(docs).groupBy("w").agg(F.count(F.lit(1)).alias("k"), F.min("corpus").alias("corpus"), F.sum("n").alias("n")).where("k = 1")
    return only.select("corpus", "w", "n", F.row_number().over(Window.partitionBy("corpus").orderBy("w")).alias("puesto")).where("puesto <= 50")


@q("t10_word_cloud", f"with {sql_tokens(4)}, c as (select w, count(*) as n from (select unnest(t) as w from tok) where not regexp_matches(w, '[aeiouáéíóúü]{{3}}|[^aeiouáéíóúü]{{5}}') and regexp_matches(w, '[aeiouáéíóúü]') group by w) select w, n from c where length(regexp_replace(w, '[^aeiouáéíóúü]', '', 'g')) / length(w) between 0.25 and 0.7 order by n desc, w limit 150", "documents")
def cloud(docs: DataFrame) -> DataFrame:
    """The commonest words that look like words (P5)."""
    c = L.counts(toks(docs, 4)).where(valid_word(F.col("w")))
    return L.top(c.select("w", "n"), 150, F.desc("n"), F.asc("w"))


def valid_word(w):
    """P5: a plausible share of vowels, no run of three vowels or five consonants."""
    share = F.length(F.regexp_replace(w, f"[^{T.VOWELS}]", "")) / F.length(w)
    return (F.length(w) >= 4) & ~w.rlike(r"\d") & w.rlike(f"[{T.VOWELS}]") & ~w.rlike(f"[{T.VOWELS}]{{3}}|[^{T.VOWELS}]{{5}}") & share.between(0.25, 0.7)


@q("f40_term_month_matrix", "select strftime(recibido, '%Y-%m') as mes, " + ", ".join(f"sum((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)})::bigint as {w}" for w in _TERMS) + " from documents where recibido is not null and text is not null group by 1", "documents")
def month_matrix(docs: DataFrame) -> DataFrame:
    mes = F.date_format("recibido", "yyyy-MM").alias("mes")
    return docs.where("recibido is not null and text is not null").groupBy(mes).agg(*(F.sum(T.occurrences(F.lower("text"), w)).cast("long").alias(w) for w in _TERMS))


@q("f48_jaccard_top50", f"""with {sql_tokens(4, True)}, b as (select publicacion, w, count(*) as n from (select publicacion, unnest(t) as w from tok where publicacion is not null) group by 1, 2),
r as (select *, row_number() over (partition by publicacion order by n desc, w) as p from b), s as (select publicacion, list(w) as ws from r where p <= 50 group by 1)
select a.publicacion as a, b.publicacion as b, round(len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))), 4) as jaccard from s a join s b on a.publicacion < b.publicacion""", "documents")
def jaccard_top(docs: DataFrame) -> DataFrame:
    """Jaccard of the fifty commonest words of each publication."""
    c = L.counts(toks(docs.where("publicacion is not null"), 4, STOP), "publicacion")
    s = c.withColumn("p", F.row_number().over(Window.partitionBy("publicacion").orderBy(F.desc("n"), "w"))).where("p <= 50").groupBy("publicacion").agg(F.collect_list("w").alias("ws"))
    a, b = (s.select(F.col("publicacion").alias(x), F.col("ws").alias(f"w{x}")) for x in "ab")
    j = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(j, 4).alias("jaccard"))  # a row a publication
