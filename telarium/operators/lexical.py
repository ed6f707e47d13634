"""Word statistics of a corpus: frequencies, n-grams, collocates, keyness, change over periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in a total order; a report, so the limit is the feature."""
    return df.orderBy(*order).limit(n)


def counts(toks: DataFrame, *by: str) -> DataFrame:
    """(by, w, n) from tokens (by, t)."""
    return toks.select(*by, F.explode("t").alias("w")).groupBy(*by, "w").agg(F.count(F.lit(1)).alias("n"))


def frequencies(toks: DataFrame) -> DataFrame:
    """A1: term frequency and document frequency; one shuffle, by (document, word) sums first."""
    each = counts(toks, "doc_id")
    return each.groupBy("w").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def ngrams(toks: DataFrame, n: int) -> DataFrame:
    """A2: contiguous n-grams inside one document."""
    at = F.sequence(F.lit(1), F.size("t") - n + 1)
    gram = F.transform(at, lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))
    return toks.where(F.size("t") >= n).select(F.explode(gram).alias("ngrama")).groupBy("ngrama").agg(F.count(F.lit(1)).alias("n"))


def collocates(toks: DataFrame, word: str, window: int, top_n: int) -> DataFrame:
    """A3: neighbours within the window of each hit, preselected by frequency, ranked by the score."""
    t, hit = F.col("t"), F.lit(word)
    at = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.element_at(t, i) == hit)
    near = F.transform(
        at,
        lambda i: F.concat(
            F.slice(t, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window))), F.slice(t, i + 1, F.lit(window))
        ),
    )
    hits = toks.where(F.array_contains("t", word)).select(F.explode(near).alias("x"))
    windows = hits.agg(F.count(F.lit(1)).alias("windows"))
    found = hits.select(F.explode("x").alias("w")).where(F.col("w") != word).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    best = top(found, 3 * top_n, F.desc("f"), F.asc("w"))
    totals = counts(toks)
    size = totals.agg(F.sum("n").alias("size"), F.sum(F.when(F.col("w") == word, F.col("n"))).alias("hit_n"))
    scored = best.join(totals, "w").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(windows))  # one row each
    pw, pk = F.col("hit_n") / F.col("size"), F.col("n") / F.col("size")
    score = F.log2((F.col("f") / F.col("windows")) / (pw * pk + 1e-10) + 1e-10)
    return top(scored.select("w", "f", F.round(score, 3).alias("pmi")), top_n, F.desc("pmi"), F.desc("f"), F.asc("w"))


def lexical_network(toks: DataFrame, nodes: int, window: int, least: int) -> DataFrame:
    """A4: pairs inside the window among the most frequent words, each seen from both sides."""
    chosen = top(counts(toks), nodes, F.desc("n"), F.asc("w")).select("w")
    names = [r[0] for r in chosen.collect()]  # `nodes` rows
    # only the chosen words with their places; of those in order, at most `window` on each side can be in reach
    kept = F.filter(F.transform("t", lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda x: x["w"].isin(names))
    t = toks.select(kept.alias("k")).where(F.size("k") > 1)

    def around(x, j):
        near = F.slice("k", F.greatest(j + 1 - window, F.lit(1)), F.lit(2 * window + 1))
        near = F.filter(near, lambda y: (y["i"] != x["i"]) & (F.abs(y["i"] - x["i"]) <= window))
        return F.transform(near, lambda y: F.struct(F.least(x["w"], y["w"]).alias("a"), F.greatest(x["w"], y["w"]).alias("b")))

    each = t.select(F.explode(F.flatten(F.transform("k", around))).alias("p"))
    return each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("peso")).where(F.col("peso") >= least)


def period_tfidf(by_period: DataFrame, periods: int) -> DataFrame:
    """A5: tf x (ln((N + 1) / (df + 1)) + 1) from counts (periodo, w, n)."""
    total = by_period.groupBy("periodo").agg(F.sum("n").alias("total"))
    df = by_period.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    x = by_period.join(F.broadcast(total), "periodo").join(df, "w")  # a row a period
    idf = F.log((F.lit(periods) + 1) / (F.col("df") + 1)) + 1
    return x.select("periodo", "w", F.round(F.col("n") / F.col("total") * idf, 6).alias("tfidf"))


def new_words(by_period: DataFrame, least: int) -> DataFrame:
    """Words in the first period that has them, if they occur there `least` times."""
    first = by_period.groupBy("w").agg(F.min("periodo").alias("periodo"), F.min_by("n", "periodo").alias("n"))
    return first.where(F.col("n") >= least).select("periodo", "w", "n")


def discursive_change(by_period: DataFrame) -> DataFrame:
    """Cosine distance of each period's counts from the next one's."""
    periods = by_period.select("periodo").distinct()
    order = periods.withColumn("k", F.row_number().over(Window.orderBy("periodo")))  # a row a period
    x = by_period.join(F.broadcast(order), "periodo")
    norm = x.groupBy("k").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"), F.first("periodo").alias("periodo"))
    later = x.select((F.col("k") - 1).alias("k"), "w", F.col("n").alias("m"))
    dot = x.join(later, ["k", "w"]).groupBy("k").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    nxt = norm.select((F.col("k") - 1).alias("k"), F.col("norm").alias("norm2"), F.col("periodo").alias("hasta"))
    out = norm.join(nxt, "k").join(dot, "k", "left")
    d = 1 - F.coalesce(F.col("dot"), F.lit(0)) / (F.col("norm") * F.col("norm2"))
    return out.select(F.col("periodo").alias("desde"), "hasta", F.round(d, 4).alias("distancia"))


def keyness(by_corpus: DataFrame, top_n: int) -> DataFrame:
    """A10: signed log-likelihood of each word in each corpus against all others."""
    all_w = by_corpus.groupBy("w").agg(F.sum("n").alias("all_n"))
    size = by_corpus.groupBy("corpus").agg(F.sum("n").alias("c"))
    total = size.agg(F.sum("c").alias("total"))
    x = by_corpus.join(all_w, "w").join(F.broadcast(size), "corpus").crossJoin(F.broadcast(total))  # a row a corpus
    a, b = F.col("n"), F.col("all_n") - F.col("n")
    c, d = F.col("c"), F.col("total") - F.col("c")
    e1, e2 = c * (a + b) / (c + d), d * (a + b) / (c + d)
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    g = 2 * (part(a, e1) + part(b, e2))
    signed = F.round(F.when(a * d >= b * c, g).otherwise(-g), 1)
    scored = x.where(d > 0).select("corpus", "w", "n", signed.alias("g2"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("g2"), F.desc("n"), "w"))
    return scored.withColumn("puesto", rank).where(F.col("puesto") <= top_n)


def corpus_tfidf(by_corpus: DataFrame) -> DataFrame:
    """Tf x ln(N / df) of words whose idf exceeds 0.1."""
    size = by_corpus.groupBy("corpus").agg(F.sum("n").alias("c"))
    df = by_corpus.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    n = size.agg(F.count(F.lit(1)).alias("k"))
    x = by_corpus.join(df, "w").join(F.broadcast(size), "corpus").crossJoin(F.broadcast(n))  # a row a corpus
    idf = F.log(F.col("k") / F.col("df"))
    return x.where(idf > 0.1).select("corpus", "w", F.round(F.col("n") / F.col("c") * idf, 5).alias("peso"))


def cosine_matrix(profile: DataFrame) -> DataFrame:
    """Cosine of every two corpora by a join on the words they share."""
    norm = profile.groupBy("corpus").agg(F.sqrt(F.sum(F.col("peso") * F.col("peso"))).alias("norm"))
    a = profile.select(F.col("corpus").alias("a"), "w", F.col("peso").alias("x"))
    b = profile.select(F.col("corpus").alias("b"), "w", F.col("peso").alias("y"))
    dot = a.join(b, "w").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    na, nb = (norm.select(F.col("corpus").alias(c), F.col("norm").alias(f"n{c}")) for c in "ab")
    out = dot.join(F.broadcast(na), "a").join(F.broadcast(nb), "b")  # a row a corpus
    return out.where("na > 0 and nb > 0").select("a", "b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 3).alias("coseno"))
