"""Queries of topic, style and vector models; their results are compared by tests of shape and co-membership."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.operators import models as M
from telarium.operators.similarity import cosine
from telarium.plans.lexical import STOP, toks
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query


@q("m1_lda", None, "documents")
def lda(docs: DataFrame) -> DataFrame:
    return M.lda(toks(docs, 4, STOP))[0]


@q("k2_topic_csv", None, "documents")
def topic_csv(docs: DataFrame) -> DataFrame:
    """Documents with the words of their topic."""
    found, topics = M.lda(toks(docs, 4, STOP))
    return found.join(F.broadcast(topics), "topico")  # a row a topic


@q("m2_nmf", None, "documents")
def nmf(docs: DataFrame) -> DataFrame:
    return M.nmf(toks(docs, 4, STOP))[0]


def _vectors(emb: DataFrame) -> DataFrame:
    return emb.where("embedding is not null").select(F.col("vec_id").alias("doc_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))


@q("m3_neural_topics", None, "embeddings")
def neural(emb: DataFrame) -> DataFrame:
    return M.clusters(_vectors(emb), 10)


_GRAMS = r"""w as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) as w from documents where length(text) > 0), k as (select doc_id, ' ' || w || ' ' as w, unnest([2, 3, 4]) as n from w),
g as (select doc_id, unnest(list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n))) as g from k), e as (select doc_id, g, count(*) as n from g group by 1, 2),
t as (select g, sum(n) as total, count(*) as df from e group by 1 order by total desc, g limit 3000), z as (select count(distinct doc_id) as z from e),
y as (select doc_id, e.g, (ln(n) + 1) * (ln((1.0 + z) / (1.0 + df)) + 1) as y from e join t using (g), z), m as (select doc_id, sqrt(sum(y * y)) as norm from y group by 1), v as (select doc_id, g, y / norm as x from y join m using (doc_id))"""


@q("m4_char_ngrams", f"with {_GRAMS} select doc_id, count(*) as rasgos, round(sum(x), 4) as suma, round(max(x), 4) as mayor from v group by 1", "documents")
def char_ngrams(docs: DataFrame) -> DataFrame:
    return M.char_ngrams(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rasgos"), F.round(F.sum("x"), 4).alias("suma"), F.round(F.max("x"), 4).alias("mayor"))


@q("k3_stylometry_csv", f"with {_GRAMS}, o as (select doc_id, publicacion as clase from documents where publicacion is not null and doc_id in (select doc_id from v)), s as (select clase, count(*) as docs from o group by 1), c as (select clase, g, sum(x) / any_value(docs) as c from v join o using (doc_id) join s using (clase) group by 1, 2), h as (select clase, sqrt(sum(c * c)) as norm from c group by 1), d as (select doc_id, clase as candidata, round(sum(x * c / norm), 4) as sim from v join c using (g) join h using (clase) group by 1, 2), r as (select *, row_number() over (partition by doc_id order by sim desc, candidata) as puesto from d) select * from r where puesto <= 3", "documents")
def stylometry(docs: DataFrame) -> DataFrame:
    """The three publications nearest in style to each document."""
    return M.nearest_styles(M.char_ngrams(docs), docs.select("doc_id", F.col("publicacion").alias("clase")))


@q("m6_style_clusters", None, "documents")
def style(docs: DataFrame) -> DataFrame:
    return M.clusters(M.char_vectors(docs, 500))


@q("m7_pca", None, "embeddings")
def pca(emb: DataFrame) -> DataFrame:
    return M.pca(_vectors(emb))


@q("m8_hierarchy", None, "embeddings")
def hierarchy(emb: DataFrame) -> DataFrame:
    return M.tree(_vectors(emb))


@q("m9_word2vec", None, "documents")
def word2vec(docs: DataFrame) -> DataFrame:
    return M.word2vec(toks(docs, 4, STOP)).getVectors().select(F.col("word").alias("palabra"), F.size(vector_to_array("vector")).alias("dimension"))


@q("m10_field_expansion", None, "documents")
def expansion(docs: DataFrame) -> DataFrame:
    """The fifteen words nearest to the centroid of the seeds."""
    v = M.word2vec(toks(docs, 4, STOP)).getVectors().select("word", vector_to_array("vector").alias("v"))
    seeds = v.where(F.col("word").isin("teatro", "orquesta", "zarzuela"))
    c = seeds.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("c"))
    s = v.crossJoin(F.broadcast(c)).where(~F.col("word").isin("teatro", "orquesta", "zarzuela"))  # one row
    return s.select(F.col("word").alias("palabra"), F.round(cosine(F.col("v"), F.col("c")), 4).alias("sim")).orderBy(F.desc("sim"), "palabra").limit(15)


@q("m11_corpus_similarity", None, "documents")
def corpus_similarity(docs: DataFrame) -> DataFrame:
    """Cosine of the mean word vectors of every two publications."""
    from pyspark.ml.stat import Summarizer

    t = toks(docs.where("publicacion is not null"), 4, STOP).where(F.size("t") > 0)
    v = M.word2vec(t).transform(t).groupBy("publicacion").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    a, b = (v.select(F.col("publicacion").alias(x), F.col("m").alias(f"m{x}")) for x in "ab")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(cosine(F.col("ma"), F.col("mb")), 3).alias("sim"))  # a row a publication


@q("m12_sentence_embeddings", None, "documents")
def embeddings(docs: DataFrame) -> DataFrame:
    e = M.hashed_embeddings(toks(docs, 3))
    norm = F.aggregate(vector_to_array("v"), F.lit(0.0), lambda s, x: s + x * x)
    return e.select("doc_id", F.round(norm, 6).alias("norma"))
