"""Problem 9: mixing sources to target weights by entropy balancing.

The rate of a document is the one closest in entropy to one use that meets the token constraint of its
source: rate = min(cap, exp(lambda_source * tokens / mean tokens)). The mix is as large as the target
sources together. A source that its cap keeps below its share saturates: each of its documents is used cap
times, and the others take what is left in proportion to their weights (goals); the shortfall is reported.
The dual of the constraints is convex and separable. Documents of one source and size have one rate, so the
documents are counted by (source, size) once, and each distributed Newton step sums rate * tokens and its
derivative over those counts (one row a target source on the driver). Rates become copies by systematic
rounding along the sizes: running sums are taken inside small (source, size bin, hash) cells and offset by
the sums of the cells before, so no source is in one task.

Defined results: sources outside the targets and null sources take no part; documents without tokens
are never selected; a target source without documents has share 0 and the others keep their proportions;
repeated targets of a source: the largest weight holds, with its cap; rows of documents are units of their
own; a weight or cap of 0 or null selects nothing; empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.llm.tokenizer import count_tokens
from telarium.session import materialise, read

STEPS = 60
FULL = 1e12  # the multiplier of a source of which each document is used cap times
CELLS = 64


def wanted(targets: DataFrame) -> DataFrame:
    """(source, peso, cap): one row a source that can take part."""
    rows = targets.where("peso > 0 and max_repeticiones > 0 and source is not null")
    best = F.max(F.struct("peso", "max_repeticiones"))
    return rows.groupBy("source").agg(best.alias("b")).select("source", "b.peso", F.col("b.max_repeticiones").alias("cap"))


def sizes(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, doc_id, x, cap): tokens of the documents of the target sources."""
    docs = documents.select("doc_id", "source", "text").join(wanted(targets).select("source", "cap"), "source")
    tagged = docs.withColumn("k", F.struct("source", "doc_id", "cap"))
    counted = count_tokens(tagged, "k", "text").where("tokens > 0")
    return counted.select("k.source", "k.doc_id", F.col("tokens").alias("x"), "k.cap")


def goals(supply: dict[str, float], most: dict[str, float], weight: dict[str, float]) -> dict[str, float]:
    """Tokens of each source. The total is all tokens there are; sources that would need more than their
    most get their most, and the rest is shared by weight among the others."""
    open_, rest, goal = set(supply), sum(supply.values()), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= most[s]}
        if not full:
            return goal | {s: weight[s] * unit for s in open_}
        goal |= {s: most[s] for s in full}
        rest -= sum(most[s] for s in full)
        open_ -= full
    return goal


def solve(docs: DataFrame, targets: DataFrame) -> dict[str, tuple[float, float]]:
    """lambda and mean tokens of each source. Only target sources are on the driver."""
    counts = materialise(docs.groupBy("source", "x", "cap").agg(F.count(F.lit(1)).alias("n")), "tallas")
    x = F.col("n") * F.col("x")
    rows = counts.groupBy("source").agg(F.sum(x).alias("x"), (F.sum(x) / F.sum("n")).alias("m"), F.max("cap").alias("cap")).collect()
    have = {r["source"]: r for r in rows}
    weight = {r["source"]: r["peso"] for r in wanted(targets).collect() if r["source"] in have}
    most = {s: float(r["cap"] * r["x"]) for s, r in have.items()}
    goal = goals({s: float(r["x"]) for s, r in have.items()}, most, weight)
    # a saturated source has no finite multiplier: a power beyond every cap
    full = {s: FULL for s in goal if goal[s] >= most[s] * (1 - 1e-9)}
    lam = dict.fromkeys(set(goal) - set(full), 0.0)
    low, high = dict.fromkeys(lam, -50.0), dict.fromkeys(lam, 50.0 * 1000)
    spark = docs.sparkSession
    for _ in range(STEPS if lam else 0):
        table = spark.createDataFrame([(s, lam[s], float(have[s]["m"])) for s in lam], "source string, l double, m double")
        got = rated(counts, table).groupBy("source").agg(
            F.sum(F.col("rate") * x).alias("g"),
            F.sum(F.when(F.col("rate") < F.col("cap"), F.col("rate") * x * F.col("x") / F.col("m")).otherwise(0.0)).alias("d"),
        )
        done = True
        for r in got.collect():
            s, gap = r["source"], r["g"] - goal[r["source"]]
            if abs(gap) <= 1e-6 * goal[s]:
                continue
            done = False
            low[s], high[s] = (low[s], lam[s]) if gap > 0 else (lam[s], high[s])
            step = lam[s] - gap / r["d"] if r["d"] else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + min(high[s], max(4 * abs(lam[s]), 1.0) + lam[s])) / 2
        if done:
            break
    return {s: (v, float(have[s]["m"])) for s, v in (lam | full).items()}


def rated(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with their rate; the table has one row a target source."""
    power, cap = F.col("l") * F.col("x") / F.col("m"), F.col("cap").cast("double")
    rate = F.when(power >= F.log(cap), cap).otherwise(F.exp(F.greatest(power, F.lit(-700.0))))
    return docs.join(F.broadcast(table), "source").withColumn("rate", rate)


def mix(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, copias) of the selected documents."""
    docs = materialise(sizes(documents, targets), "tamanos")
    found = solve(docs, targets)
    table = docs.sparkSession.createDataFrame([(s, *v) for s, v in found.items()], "source string, l double, m double")
    cell = F.struct(F.floor(F.log2("x") * 8).alias("a"), F.pmod(F.xxhash64("doc_id", "x"), F.lit(CELLS)).alias("b"))
    rows = materialise(rated(docs, table).select("source", "doc_id", "x", "rate", cell.alias("c")), "tasas")
    sums = rows.groupBy("source", "c").agg(F.sum("rate").alias("r"))
    before = Window.partitionBy("source").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # cells, not documents
    starts = sums.select("source", "c", F.coalesce(F.sum("r").over(before), F.lit(0.0)).alias("start"))
    within = Window.partitionBy("source", "c").orderBy("x", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.sum("rate").over(within) + F.lit(0.5)
    placed = rows.join(starts, ["source", "c"]).withColumn("end", end)
    copies = (F.floor(F.col("end") + F.lit(1e-9)) - F.floor(F.col("end") - F.col("rate") + F.lit(1e-9))).cast("long")
    return placed.select("doc_id", "source", F.col("x").alias("tokens"), copies.alias("copias")).where("copias > 0")


def shares(selected: DataFrame, targets: DataFrame) -> DataFrame:
    """Target share, actual share and shortfall of each target source."""
    got = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copias")).alias("tokens"), F.count(F.lit(1)).alias("documentos"), F.max("copias").alias("max_copias"))
    every = Window.partitionBy(F.lit(1))  # one row a target source
    best = F.max(F.struct("peso", "max_repeticiones"))
    goal = targets.where("source is not null").groupBy("source").agg(best.alias("b")).select("source", "b.*")
    out = goal.join(got, "source", "left").withColumn("parte", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(every), F.lit(0)), F.lit(0.0)))
    aim = F.greatest(F.coalesce("peso", F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("objetivo", F.coalesce(aim / F.nullif(F.sum(aim).over(every), F.lit(0.0)), F.lit(0.0)))
    out = out.withColumn("falta", F.greatest(F.col("objetivo") - F.col("parte"), F.lit(0.0)))
    return out.fillna(0, ["tokens", "documentos", "max_copias"])


def p9_mezcla(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mezcla_objetivo"))


def p9_cuotas(spark, sf_dir: str) -> DataFrame:
    return shares(p9_mezcla(spark, sf_dir), read(spark, sf_dir, "mezcla_objetivo"))


QUERIES = {"p9_mezcla": p9_mezcla, "p9_cuotas": p9_cuotas}
SQL: dict[str, str] = {}
