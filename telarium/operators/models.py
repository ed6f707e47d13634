"""Topic, style and vector models on Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import IDF, PCA, CountVectorizer, HashingTF, NGram, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.operators.lexical import top
from telarium.session import materialise

SEED = 42
PART = 1_000_000  # words that one task trains vectors on


def lda(toks: DataFrame, k: int = 5, steps: int = 15) -> tuple[DataFrame, DataFrame]:
    """M1: (doc_id, topico, peso) and (topico, palabras) of online LDA over words and word pairs."""
    t = NGram(n=2, inputCol="t", outputCol="g").transform(toks.where(F.size("t") > 0)).withColumn("x", F.concat("t", "g"))
    cv = CountVectorizer(inputCol="x", outputCol="v", minDF=2, maxDF=0.9, vocabSize=2000).fit(t)
    counted = materialise(cv.transform(t).select("doc_id", "v"), "cuentas")
    model = LDA(k=k, maxIter=steps, optimizer="online", seed=SEED, featuresCol="v").fit(counted)
    weights = model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("d"))
    best = F.array_max("d")
    docs = weights.select("doc_id", (F.array_position("d", best) - 1).cast("int").alias("topico"), F.round(best, 4).alias("peso"))
    words = F.array(*map(F.lit, cv.vocabulary))  # vocabSize words
    topics = model.describeTopics(15).select(F.col("topic").alias("topico"), F.array_join(F.transform("termIndices", lambda i: F.get(words, i)), ", ").alias("palabras"))
    return docs, topics


def nmf(toks: DataFrame, k: int = 5, features: int = 5000, steps: int = 30) -> tuple[DataFrame, DataFrame]:
    """M2: (doc_id, topico, peso) and (topico, palabras) by a non-negative factorisation of the TF-IDF of documents.

    The words' side (k x features numbers) travels to the tasks; each pass finds the documents' side from it row by row
    and sends back the sums that renew it, so no document leaves its task and ids may be of any kind.
    """
    each = toks.select("doc_id", F.explode("t").alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    each = materialise(each, "cuentas")
    size = each.select("doc_id").distinct().count()
    vocab = top(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")), features, F.desc("df"), F.asc("w")).collect()  # `features` rows
    words = sorted(r["w"] for r in vocab)
    spark, index = toks.sparkSession, {w: i for i, w in enumerate(words)}
    table = spark.createDataFrame([(r["w"], index[r["w"]], float(np.log((1 + size) / (1 + r["df"])) + 1)) for r in vocab], "w string, i int, idf double")
    rows = each.join(F.broadcast(table), "w").groupBy("doc_id").agg(F.collect_list(F.struct("i", (F.col("n") * F.col("idf")).alias("x"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y["x"] * y["x"]))
    rows = materialise(rows.select("doc_id", F.transform("v", lambda y: y["i"]).alias("i"), F.transform("v", lambda y: y["x"] / norm).alias("x")), "pesos")
    h = np.random.default_rng(SEED).random((k, max(1, len(words)))) + 0.1

    def solved(b, h):
        """The documents' side of a batch: multiplicative steps from ones."""
        at, x = b.column("i").flatten().to_numpy(), b.column("x").flatten().to_numpy()
        doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("i").offsets.to_numpy()))
        hh, target = h @ h.T, np.zeros((b.num_rows, k))
        for j in range(k):
            target[:, j] = np.bincount(doc, weights=x * h[j, at], minlength=b.num_rows)
        w = np.ones((b.num_rows, k))
        for _ in range(50):
            w *= target / np.maximum(w @ hh, 1e-12)
        return w, at, x, doc

    for _ in range(steps):

        def sums(batches, h=h):
            top_, low = np.zeros_like(h), np.zeros((k, k))
            for b in batches:
                if b.num_rows:
                    w, at, x, doc = solved(b, h)
                    for j in range(k):
                        top_[j] += np.bincount(at, weights=x * w[doc, j], minlength=h.shape[1])
                    low += w.T @ w
            v = np.concatenate([top_.ravel(), low.ravel()])
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(v)), "v": v})

        got = rows.select("i", "x").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        if not len(got):
            break
        h = h * got[: h.size].reshape(h.shape) / np.maximum(got[h.size :].reshape(k, k) @ h, 1e-12)

    def place(batches):
        for b in batches:
            if b.num_rows:
                w = solved(b, h)[0]
                best = w.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best.astype(np.int32)), pa.array(w[np.arange(len(w)), best] / np.maximum(w.sum(axis=1), 1e-12))], names=["doc_id", "topico", "peso"])

    kind = dict(rows.dtypes)["doc_id"]
    topics = [(j, ", ".join(words[i] for i in np.argsort(-h[j], kind="stable")[:15])) for j in range(k)] if words else []
    return rows.mapInArrow(place, f"doc_id {kind}, topico int, peso double"), spark.createDataFrame(topics, "topico int, palabras string")


def char_vectors(docs: DataFrame, size: int = 3000) -> DataFrame:
    """M4: (doc_id, v): unit vectors of character n-grams of two to four inside words, sublinear; a word counts as often as it stands."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    grams = F.flatten(
        F.transform(
            w,
            # the start at the first letter of a word shorter than n is dropped
            lambda x: F.flatten(F.array(*(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) + 3 - n)), lambda i: F.substring(F.concat(F.lit(" "), x, F.lit(" ")), i, F.lit(n))), lambda g: F.length(g) == n) for n in (2, 3, 4)))),
        )
    )
    t = docs.where("length(text) > 0").select("doc_id", grams.alias("x"))
    tf = HashingTF(inputCol="x", outputCol="f", numFeatures=size).transform(t)
    log = materialise(tf.select("doc_id", array_to_vector(F.transform(vector_to_array("f"), lambda y: F.when(y > 0, 1 + F.log(y)).otherwise(0.0))).alias("f")), "rasgos")
    weighted = IDF(inputCol="f", outputCol="i", minDocFreq=1).fit(log).transform(log)
    return Normalizer(inputCol="i", outputCol="v").transform(weighted).select("doc_id", "v")


def clusters(vectors: DataFrame, k: int = 5) -> DataFrame:
    """M6: (doc_id, grupo)."""
    model = KMeans(k=k, seed=SEED, featuresCol="v", maxIter=10).fit(vectors)
    return model.transform(vectors).select("doc_id", F.col("prediction").alias("grupo"))


def tree(vectors: DataFrame, k: int = 8) -> DataFrame:
    """M8: (doc_id, rama) by bisecting from the top."""
    model = BisectingKMeans(k=k, seed=SEED, featuresCol="v", maxIter=8).fit(vectors)
    return model.transform(vectors).select("doc_id", F.col("prediction").alias("rama"))


def pca(vectors: DataFrame) -> DataFrame:
    """M7: (doc_id, x, y); signs are indeterminate."""
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors)
    p = model.transform(vectors).select("doc_id", vector_to_array("p").alias("p"))
    return p.select("doc_id", F.round(F.get("p", F.lit(0)), 4).alias("x"), F.round(F.get("p", F.lit(1)), 4).alias("y"))


def word2vec(toks: DataFrame, size: int = 150, steps: int = 12):
    """M9: the fitted model. Every step trains a part of PART words in a task of its own and averages the parts; fewer words are one part."""
    t = materialise(toks.where(F.size("t") > 0).select("t"), "palabras")
    words = t.agg(F.sum(F.size("t"))).first()[0] or 0
    return Word2Vec(vectorSize=size, windowSize=6, minCount=3, maxIter=steps, seed=SEED, numPartitions=1 + words // PART, inputCol="t", outputCol="v").fit(t)


def hashed_embeddings(toks: DataFrame, size: int = 384) -> DataFrame:
    """Unit vectors of hashed words, the stand-in for a sentence model."""
    t = toks.where(F.size("t") > 0)
    pipe = Pipeline(stages=[HashingTF(inputCol="t", outputCol="f", numFeatures=size), Normalizer(inputCol="f", outputCol="v")])
    return pipe.fit(t).transform(t).select("doc_id", "v")


def char_ngrams(docs: DataFrame, features: int = 3000) -> DataFrame:
    """M4 in long form: (doc_id, g, x), unit vectors of character n-grams of two to four inside words.

    The `features` commonest n-grams; sublinear counts, smoothed idf. Nothing is hashed, so the weights are exact.
    """
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    of = lambda x, n: F.when(F.length(x) + 2 >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) + 3 - n, F.lit(1))), lambda i: F.substring(F.concat(F.lit(" "), x, F.lit(" ")), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.flatten(F.transform(w, lambda x: F.concat(of(x, 2), of(x, 3), of(x, 4))))
    each = docs.where("length(text) > 0").select("doc_id", F.explode(grams).alias("g")).groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("n"))
    each = materialise(each, "ngramas")
    n = each.select("doc_id").distinct().count()
    kept = top(each.groupBy("g").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("df")), features, F.desc("total"), F.asc("g"))
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1
    x = each.join(F.broadcast(kept.select("g", idf.alias("idf"))), "g").withColumn("y", (F.log("n") + 1) * F.col("idf"))  # `features` rows
    norm = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
    return x.join(norm, "doc_id").select("doc_id", "g", (F.col("y") / F.col("norm")).alias("x"))


def nearest_styles(vectors: DataFrame, of: DataFrame, k: int = 3) -> DataFrame:
    """K3/M5: (doc_id, candidata, sim, puesto), cosine with the mean vector of each class; of (doc_id, clase)."""
    v = materialise(vectors, "estilos")
    size = of.where("clase is not null").join(v.select("doc_id").distinct(), "doc_id").groupBy("clase").agg(F.count(F.lit(1)).alias("docs"))
    cen = v.join(of.where("clase is not null"), "doc_id").groupBy("clase", "g").agg(F.sum("x").alias("s")).join(size, "clase")
    cen = cen.select("clase", "g", (F.col("s") / F.col("docs")).alias("c"))
    cen = materialise(cen.join(cen.groupBy("clase").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm")), "clase").select("clase", "g", (F.col("c") / F.col("norm")).alias("c")), "centros")
    s = v.join(cen, "g").groupBy("doc_id", F.col("clase").alias("candidata")).agg(F.round(F.sum(F.col("x") * F.col("c")), 4).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("sim"), "candidata"))
    return s.withColumn("puesto", rank).where(F.col("puesto") <= k)
