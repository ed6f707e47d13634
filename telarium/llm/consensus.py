"""Problem 5: consensus of annotators by a mixture of competence and spamming.

Every label is either truthful (with the annotator's competence) or drawn from the annotator's own
guess distribution; expectation-maximisation yields the category of each span, each competence and
each guess distribution, which may depend on the true category. The spans are first reduced to their distinct label patterns with counts, so
that an iteration reads a small table and moves one row of annotators x categories sums per task; only
these parameters (a few dozen bytes an annotator) are on the driver.

Defined results: rows with a null span, annotator or category don't stand; of several standing labels
of one person on one span the one with the latest modificada_en holds (null is the earliest, ties go to
the largest id); ties between categories go to the alphabetically first; empty tables give no rows;
extra columns are ignored. Labels per span are at most one a person, so no group is unbounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.session import materialise, read

ITERATIONS = 40
TOLERANCE = 1e-3
MAX_PARAMETERS = 20_000_000
STATES = ("confirmada", "corregida")


def standing(df: DataFrame) -> DataFrame:
    """One label a person and span: (art_id, texto_norm, fuente, categoria)."""
    held = df.where(
        F.col("fuente").startswith("anot_") & F.col("estado").isin(*STATES) & F.col("categoria").isNotNull()
        & F.col("art_id").isNotNull() & F.col("texto_norm").isNotNull()
    )
    when = F.struct(F.coalesce("modificada_en", F.lit("0001-01-01").cast("timestamp")).alias("m"), "id")
    return held.groupBy("art_id", "texto_norm", "fuente").agg(F.max_by("categoria", when).alias("categoria"))


def spans(labels: DataFrame) -> DataFrame:
    """(art_id, texto_norm, etiquetas): the sorted `annotator=category` labels of each span."""
    pair = F.concat_ws("\u0001", "fuente", "categoria")
    return labels.groupBy("art_id", "texto_norm").agg(F.array_sort(F.collect_list(pair)).alias("etiquetas"))


class Model:
    """Competence, guess distributions and prior, with the E-step over batches of patterns.

    Competence and guesses may differ by the true category, for people who take one category for another
    throughout; both are shrunk to the person's overall values, which are all that the first steps use.
    """

    OVERALL = 8  # steps without a difference by category
    SHRINK = 4.0  # labels that the overall values count for

    def __init__(self, people: list[str], categories: list[str]):
        a, k = len(people), max(1, len(categories))
        if a * k * k > MAX_PARAMETERS:
            raise ValueError("too many annotators x categories for the parameters to be held")
        self.people, self.categories = people, categories
        self.code = {f"{p}\u0001{c}": i * k + j for i, p in enumerate(people) for j, c in enumerate(categories)}
        self.competence = np.full(a, 0.8)
        self.habit = np.full((a, k), 1.0 / k)
        self.theta = np.full((a, k), 0.8)  # by true category
        self.guess = np.full((a, k, k), 1.0 / k)  # by true category
        self.prior = np.full(k, 1.0 / k)

    def encode(self, labels: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all labels, and the number of labels of each pattern."""
        words = labels.flatten().dictionary_encode()
        codes = np.array([self.code[x] for x in words.dictionary.to_pylist()], np.int64)
        return codes[words.indices.to_numpy()], np.diff(labels.offsets.to_numpy())

    def _labels(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Annotator, category and pattern of each label."""
        return codes // len(self.categories), codes % len(self.categories), np.repeat(np.arange(len(n)), n)

    def posteriors(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Posterior of each pattern's categories; and annotator, category and pattern of each label."""
        who, what, item = self._labels(codes, n)
        p = (1 - self.theta[who]) * self.guess[who, :, what]
        p[np.arange(len(who)), what] += self.theta[who, what]
        log = np.tile(np.log(self.prior), (len(n), 1))
        np.add.at(log, item, np.log(p))
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(axis=1, keepdims=True), who, what, item

    def votes(self, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shares of votes in place of posteriors, for the first iteration."""
        who, what, item = self._labels(codes, n)
        p = np.full((len(n), len(self.categories)), 1e-3)
        np.add.at(p, (item, what), 1.0)
        return p / p.sum(axis=1, keepdims=True), who, what, item

    def update(self, seen: np.ndarray, prior: np.ndarray, step: int) -> float:
        """The M-step; seen[person, true category, label] are expected counts."""
        k = seen.shape[2]
        right = np.einsum("att->at", seen)
        guessed = (1 - self.theta) * np.einsum("att->at", self.guess)
        truthful = right * self.theta / (self.theta + guessed)
        spam = seen.copy()
        spam[:, np.arange(k), np.arange(k)] -= truthful
        self.competence = (truthful.sum(1) + 1.0) / (seen.sum((1, 2)) + 1.25)
        self.habit = (spam.sum(1) + 0.1) / (spam.sum((1, 2)) + 0.1 * k)[:, None]
        theta, guess = np.repeat(self.competence[:, None], k, 1), np.repeat(self.habit[:, None, :], k, 1)
        if step >= self.OVERALL:
            theta = (truthful + self.SHRINK * theta) / (seen.sum(2) + self.SHRINK)
            guess = (spam + self.SHRINK * guess) / (spam.sum(2, keepdims=True) + self.SHRINK)
        theta = np.clip(theta, 1e-6, 1 - 1e-6)
        moved = max(np.abs(theta - self.theta).max(initial=0), np.abs(guess - self.guess).max(initial=0))
        self.theta, self.guess = theta, guess
        self.prior = (prior + 0.5) / (prior.sum() + 0.5 * len(prior))
        return float(moved)


def fit(labels: DataFrame, patterns: DataFrame) -> Model:
    people = sorted(r[0] for r in labels.select("fuente").distinct().collect())  # one row an annotator
    categories = sorted(r[0] for r in labels.select("categoria").distinct().collect())
    model = Model(people, categories)
    if not people:
        return model
    a, k = len(people), len(categories)

    def encoded(batches):
        for b in batches:
            codes, n = model.encode(b.column("etiquetas"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(codes, pa.int32()))
            yield pa.RecordBatch.from_arrays([lists, b.column("n")], names=["c", "n"])

    patterns = materialise(patterns.select("etiquetas", "n").mapInArrow(encoded, "c array<int>, n double"), "codigos")
    for step in range(ITERATIONS):

        def sums(batches, model=model, first=step == 0):
            seen, prior = np.zeros((a, k, k)), np.zeros(k)
            for b in batches:
                if not b.num_rows:
                    continue
                codes, n = b.column("c").flatten().to_numpy().astype(np.int64), b.column("n").to_numpy()
                p, who, what, item = (model.votes if first else model.posteriors)(codes, np.diff(b.column("c").offsets.to_numpy()))
                for t in range(k):
                    seen[:, t] += np.bincount(who * k + what, weights=n[item] * p[item, t], minlength=a * k).reshape(a, k)
                prior += n @ p
            yield pa.RecordBatch.from_pydict({"i": np.arange(a * k * k + k), "v": np.concatenate([seen.ravel(), prior])})

        got = patterns.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        v = got.sort_values("i")["v"].to_numpy()
        moved = model.update(v[: a * k * k].reshape(a, k, k), v[a * k * k :], step)
        if step > model.OVERALL + 1 and moved < TOLERANCE:
            break
    return model


def consensus(df: DataFrame) -> tuple[DataFrame, Model]:
    """(art_id, texto_norm, categoria, confianza, acuerdo, personas) of every span, and the model.

    acuerdo is the share of the span's labels that have its category.
    """
    by_span = materialise(spans(standing(df)), "tramos")
    patterns = materialise(by_span.groupBy("etiquetas").agg(F.count(F.lit(1)).cast("double").alias("n")), "patrones")
    labels = patterns.select(F.explode("etiquetas").alias("e")).distinct()
    labels = labels.select(F.split("e", "\u0001")[0].alias("fuente"), F.split("e", "\u0001")[1].alias("categoria"))
    model = fit(labels, patterns)

    def decide(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes, n = model.encode(b.column("etiquetas"))
            p, _, what, item = model.posteriors(codes, n)
            best = p.argmax(axis=1)
            same = np.bincount(item, weights=(what == best[item]).astype(float), minlength=len(n))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("art_id"), b.column("texto_norm"), pa.array([model.categories[i] for i in best]),
                    pa.array(p[np.arange(len(n)), best]), pa.array(same / n), pa.array(n, pa.int64()),
                ],
                names=["art_id", "texto_norm", "categoria", "confianza", "acuerdo", "personas"],
            )

    schema = "art_id string, texto_norm string, categoria string, confianza double, acuerdo double, personas long"
    return by_span.mapInArrow(decide, schema), model


def p5_found(spark, sf_dir: str) -> DataFrame:
    found, _ = consensus(read(spark, sf_dir, "anotaciones"))
    return found.where("personas >= 3").select("art_id", "texto_norm", "categoria")


def p5_consenso(spark, sf_dir: str) -> DataFrame:
    return consensus(read(spark, sf_dir, "anotaciones"))[0]


def p5_fiabilidad(spark, sf_dir: str) -> DataFrame:
    """Each annotator's competence and most usual guess."""
    _, model = consensus(read(spark, sf_dir, "anotaciones"))
    rows = [
        (p, float(model.competence[i]), model.categories[int(model.habit[i].argmax())], float(model.habit[i].max()))
        for i, p in enumerate(model.people)
    ]
    return spark.createDataFrame(rows, "fuente string, competencia double, categoria_supuesta string, parte double")


def agreement(df: DataFrame) -> DataFrame:
    """(tramos, etiquetas, acuerdo, azar, alfa): agreement of two labels of one span, what chance gives, and
    Krippendorff's alpha (1 where all labels are alike), over the spans with two labels at least."""
    each = standing(df).groupBy("art_id", "texto_norm", "categoria").agg(F.count(F.lit(1)).alias("k"))
    m = each.groupBy("art_id", "texto_norm").agg(F.sum("k").alias("m"), F.sum(F.col("k") * (F.col("k") - 1)).alias("same"), F.collect_list(F.struct("categoria", "k")).alias("c")).where("m > 1")
    by = m.select(F.explode("c").alias("c")).groupBy("c.categoria").agg(F.sum("c.k").alias("n"))  # a row a category
    expected = by.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    seen = m.agg(F.count(F.lit(1)).alias("tramos"), F.coalesce(F.sum("m"), F.lit(0)).alias("etiquetas"), F.sum(F.col("same") / (F.col("m") - 1)).alias("same"))
    observed = F.col("same") / F.nullif(F.col("etiquetas"), F.lit(0))
    chance = F.col("pairs") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0))
    alpha = F.when(chance == 1, 1.0).otherwise(1 - (1 - observed) / (1 - chance))
    out = seen.crossJoin(expected)  # one row each
    return out.select("tramos", "etiquetas", F.round(observed, 6).alias("acuerdo"), F.round(chance, 6).alias("azar"), F.round(alpha, 6).alias("alfa"))


def p5_acuerdo(spark, sf_dir: str) -> DataFrame:
    return agreement(read(spark, sf_dir, "anotaciones"))


QUERIES = {"p5_acuerdo": p5_acuerdo, "p5_found": p5_found, "p5_consenso": p5_consenso, "p5_fiabilidad": p5_fiabilidad}
_LABELS = """
with s as (select art_id, texto_norm, fuente, arg_max(categoria, {'m': coalesce(modificada_en, timestamp '0001-01-01'), 'id': id}) as categoria
           from anotaciones where fuente like 'anot\\_%' escape '\\' and estado in ('confirmada', 'corregida') and categoria is not null group by 1, 2, 3),
e as (select art_id, texto_norm, categoria, count(*) as k from s group by 1, 2, 3),
m as (select art_id, texto_norm, sum(k) as m, sum(k * (k - 1)) as same from e group by 1, 2 having sum(k) > 1),
b as (select sum(k) as n from e join m using (art_id, texto_norm) group by categoria),
x as (select sum(n) as n, sum(n * (n - 1)) as pairs from b),
o as (select count(*) as tramos, sum(m) as etiquetas, sum(same / (m - 1)) as same from m)
"""
SQL = {
    "p5_acuerdo": _LABELS + """select tramos, etiquetas, round(same / etiquetas, 6) as acuerdo, round(pairs / (n * (n - 1)), 6) as azar,
 round(1 - (1 - same / etiquetas) / (1 - pairs / (n * (n - 1))), 6) as alfa from o, x""",
}
