"""Co-occurrence graphs and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators.lexical import top
from telarium.session import materialise


def mentions(ents: DataFrame) -> DataFrame:
    """(art, e): distinct normal names of an article."""
    return ents.where("categoria in ('personas', 'organizaciones', 'lugares')").select(F.col("articulo_id").alias("art"), T.plain(F.col("texto")).alias("e")).distinct()


def cooccurrence(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """(a, b, peso) of names in one article, a < b; optionally by another column of the mentions."""
    keys = ["art"] + ([by] if by else [])
    x, y = pairs.withColumnRenamed("e", "a"), pairs.withColumnRenamed("e", "b")
    out = x.join(y, keys).where("a < b")
    return out.groupBy(*([by] if by else []), "a", "b").agg(F.count(F.lit(1)).alias("peso"))


def graph(pairs: DataFrame, least: int, cap: int) -> DataFrame:
    """G1: edges of weight `least` between the `cap` most frequent names; isolated names drop out."""
    freq = pairs.groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(top(freq, cap, F.desc("n"), F.asc("e")).select("e"), "nodos")  # `cap` rows
    inner = pairs.join(F.broadcast(kept), "e", "left_semi")
    return cooccurrence(inner).where(F.col("peso") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("a", "b")).alias("nodo"), "peso")
    return both.groupBy("nodo").agg(F.count(F.lit(1)).alias("grado"), F.sum("peso").alias("fuerza"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, clase), the smallest id each node (id) reaches over links (a, b).

    Labels take the least label around them and jump to the label of their label; every step is a written
    table, so the lineage stays short and lost executors cost one step.
    """
    pairs = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "aristas")
    label = materialise(nodes.select("id", F.col("id").alias("clase")), "clases")
    while True:
        around = pairs.join(label, pairs["b"] == label["id"]).groupBy("a").agg(F.min("clase").alias("m"))
        step = label.join(around, label["id"] == around["a"], "left").select("id", F.least("clase", "m").alias("c"), "clase")
        jump = label.select(F.col("id").alias("j"), F.col("clase").alias("jc"))
        new = step.join(jump, step["c"] == jump["j"], "left").select("id", F.least("c", "jc").alias("clase"), (F.least("c", "jc") < F.col("clase")).alias("moved"))
        new = materialise(new, "clases")
        label = new.select("id", "clase")
        if not new.where("moved").limit(1).count():
            return label


def pagerank(edges: DataFrame, steps: int, damping: float = 0.85) -> DataFrame:
    """A fixed number of weighted steps over the undirected graph; each step is a written table."""
    both = edges.select("a", "b", "peso").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "peso"))
    out = both.groupBy("a").agg(F.sum("peso").alias("salida"))
    share = materialise(both.join(out, "a").select("a", "b", (F.col("peso") / F.col("salida")).alias("w")), "pesos")
    n = out.count()
    rank = out.select(F.col("a").alias("nodo"), F.lit(1.0 / max(n, 1)).alias("r"))
    for _ in range(steps):
        got = share.join(rank, share["a"] == rank["nodo"]).groupBy("b").agg(F.sum(F.col("w") * F.col("r")).alias("s"))
        rank = materialise(got.select(F.col("b").alias("nodo"), ((1 - damping) / max(n, 1) + damping * F.col("s")).alias("r")), "rango")
    return rank


def propagation(edges: DataFrame, steps: int) -> DataFrame:
    """Communities by weighted label propagation; ties go to the smaller label."""
    both = materialise(edges.select("a", "b", "peso").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "peso")), "aristas")
    label = both.select(F.col("a").alias("nodo"), F.col("a").alias("comunidad")).distinct()
    for _ in range(steps):
        votes = both.join(label, both["b"] == label["nodo"]).groupBy("a", "comunidad").agg(F.sum("peso").alias("v"))
        best = votes.groupBy("a").agg(F.min_by("comunidad", F.struct((-F.col("v")).alias("v"), "comunidad")).alias("comunidad"))
        label = materialise(best.select(F.col("a").alias("nodo"), "comunidad"), "comunidades")
    return label


def modularity(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(comunidades, modularidad) of a partition (nodo, comunidad), weighted."""
    of = lambda x: parts.select(F.col("nodo").alias(x), F.col("comunidad").alias(f"c{x}"))
    e = edges.join(of("a"), "a").join(of("b"), "b")
    ends = e.select(F.explode(F.array("ca", "cb")).alias("c"), "peso", (F.col("ca") == F.col("cb")).alias("inside"))
    by = ends.groupBy("c").agg(F.sum("peso").alias("k"), F.sum(F.when(F.col("inside"), F.col("peso")).otherwise(0)).alias("l"))  # a row a community
    total = by.agg(F.sum("k").alias("m2"))
    x = by.crossJoin(F.broadcast(total))  # one row
    q = F.sum(F.col("l") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2))
    return x.agg(F.count(F.lit(1)).alias("comunidades"), F.round(q, 4).alias("modularidad"))


def settled_pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """G3 of a graph capped by `graph` (cap x cap edges at most, held on the driver): steps until the ranks settle.

    Larger graphs take `pagerank`, whose steps are written tables.
    """
    rows = edges.select("a", "b", "peso").collect()
    nodes = sorted({x for r in rows for x in (r["a"], r["b"])})
    at = {x: i for i, x in enumerate(nodes)}
    n = len(nodes)
    w = np.zeros((n, n))
    for r in rows:
        w[at[r["a"]], at[r["b"]]] += r["peso"]
        w[at[r["b"]], at[r["a"]]] += r["peso"]
    rank = np.full(n, 1.0 / max(n, 1))
    share = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)
    for _ in range(most):
        new = (1 - damping) / max(n, 1) + damping * (rank @ share)
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < n * tolerance:
            break
    return edges.sparkSession.createDataFrame([(x, float(r)) for x, r in zip(nodes, rank, strict=True)], "nodo string, r double")


def centralities(edges: DataFrame) -> DataFrame:
    """Betweenness (weights are lengths, normalised) and closeness (steps, scaled by the part in reach).

    One search from each node, spread over the sources. For graphs capped by `graph`: the adjacency that is sent to
    the executors has cap x cap entries at most.
    """
    rows = edges.select("a", "b", "peso").collect()
    near: dict[str, dict[str, float]] = {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = float(w)
        near.setdefault(b, {})[a] = float(w)
    spark, n = edges.sparkSession, len(near)
    if not near:
        return spark.createDataFrame([], "nodo string, intermediacion double, cercania double")
    sources = spark.createDataFrame([(x,) for x in sorted(near)], "s string").repartition(8)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import heapq

        for batch in batches:
            out: list[tuple[str, float, float]] = []
            for s in batch["s"]:
                steps, queue = {s: 0}, [s]
                for v in queue:
                    for w in near[v]:
                        if w not in steps:
                            steps[w] = steps[v] + 1
                            queue.append(w)
                total, reach = sum(steps.values()), len(steps) - 1
                out.append((s, 0.0, reach / total * reach / (n - 1) if total else 0.0))
                order, dist, paths, before, heap = [], {s: 0.0}, {s: 1.0}, {s: []}, [(0.0, s)]
                done = set()
                while heap:
                    d, v = heapq.heappop(heap)
                    if v in done:
                        continue
                    done.add(v)
                    order.append(v)
                    for w, length in near[v].items():
                        way = d + length
                        if w not in dist or way < dist[w] - 1e-12:
                            dist[w], paths[w], before[w] = way, paths[v], [v]
                            heapq.heappush(heap, (way, w))
                        elif w not in done and abs(way - dist[w]) <= 1e-12:
                            paths[w] += paths[v]
                            before[w].append(v)
                gain = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        gain[v] += paths[v] / paths[w] * (1 + gain[w])
                    if w != s:
                        out.append((w, gain[w], 0.0))
            yield pd.DataFrame(out, columns=["nodo", "intermediacion", "cercania"])

    parts = sources.mapInPandas(search, "nodo string, intermediacion double, cercania double")
    pairs = F.lit(float(max((n - 1) * (n - 2), 1)))
    return parts.groupBy("nodo").agg(F.round(F.sum("intermediacion") / pairs, 6).alias("intermediacion"), F.round(F.sum("cercania"), 6).alias("cercania"))
