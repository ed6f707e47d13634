"""Queries of co-occurrence graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.operators import graph as G
from telarium.operators.lexical import top
from telarium.plans.entities import _ART, N, articles
from telarium.plans.registry import Plan
from telarium.session import materialise

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_M = f"m as (select distinct articulo_id as art, {N} as e from entidades where categoria in ('personas', 'organizaciones', 'lugares'))"
_E = f"{_M}, p as (select x.e as a, y.e as b, count(*) as peso from m x join m y on x.art = y.art and x.e < y.e group by 1, 2)"
_G = f"{_M}, k as (select e from m group by e order by count(*) desc, e limit 300), mk as (select m.* from m semi join k using (e)), g as (select x.e as a, y.e as b, count(*) as peso from mk x join mk y on x.art = y.art and x.e < y.e group by 1, 2 having count(*) >= 2)"


def capped(ents: DataFrame) -> DataFrame:
    return G.graph(G.mentions(ents), 2, 300)


@q("j2_cooccurrence", f"with {_E} select * from p", "entidades")
def cooccurrence(ents: DataFrame) -> DataFrame:
    """Every two names of an article; the weight is the number of articles."""
    return G.cooccurrence(G.mentions(ents))


@q("j3_coauthorship", "with a as (select distinct numero, trim(autor) as e from articulos where coalesce(trim(autor), '') not in ('', 'nan')), f as (select e from a group by e having count(*) >= 2), k as (select a.* from a semi join f using (e)) select x.e as a, y.e as b, count(*) as peso from k x join k y on x.numero = y.numero and x.e < y.e group by 1, 2", "articulos")
def coauthorship(arts: DataFrame) -> DataFrame:
    """Signatures of two issues at least, paired inside an issue."""
    a = arts.where(~F.coalesce(F.trim("autor"), F.lit("")).isin("", "nan")).select(F.col("numero").alias("art"), F.trim("autor").alias("e")).distinct()
    often = a.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return G.cooccurrence(a.join(often, "e", "left_semi").where("art is not null"))


@q("a49_cooccurrence_accumulate", "select least(entidad_a, entidad_b) as a, greatest(entidad_a, entidad_b) as b, categoria, count(*) as filas, sum(coalesce(peso, 0)) as peso from coocurrencias group by 1, 2, 3", "coocurrencias")
def accumulate(co: DataFrame) -> DataFrame:
    return co.groupBy(F.least("entidad_a", "entidad_b").alias("a"), F.greatest("entidad_a", "entidad_b").alias("b"), "categoria").agg(F.count(F.lit(1)).alias("filas"), F.sum(F.coalesce("peso", F.lit(0))).alias("peso"))


@q("g1_graph", f"with {_G} select * from g", "entidades")
def graph(ents: DataFrame) -> DataFrame:
    return capped(ents)


@q("g2_summary", f"with {_G}, n as (select a as x from g union select b from g) select (select count(*) from n) as nodos, count(*) as aristas, round(2.0 * count(*) / ((select count(*) from n) * ((select count(*) from n) - 1)), 4) as densidad from g", "entidades")
def summary(ents: DataFrame) -> DataFrame:
    g = capped(ents)
    n = G.degrees(g).agg(F.count(F.lit(1)).alias("nodos"))
    e = g.agg(F.count(F.lit(1)).alias("aristas"))
    return n.crossJoin(e).withColumn("densidad", F.round(2.0 * F.col("aristas") / F.nullif(F.col("nodos") * (F.col("nodos") - 1), F.lit(0)), 4))  # one row each


@q("g2_degree_centrality", f"with {_G}, b as (select a as nodo, peso from g union all select b, peso from g), d as (select nodo, count(*) as grado, sum(peso) as fuerza from b group by 1) select nodo, grado, fuerza, round(grado / ((select count(*) from d) - 1), 4) as centralidad from d order by grado desc, nodo limit 10", "entidades")
def degree(ents: DataFrame) -> DataFrame:
    d = G.degrees(capped(ents))
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("n")))  # one row
    x = d.crossJoin(n).select("nodo", "grado", "fuerza", F.round(F.col("grado") / F.nullif(F.col("n") - 1, F.lit(0)), 4).alias("centralidad"))
    return top(x, 10, F.desc("grado"), F.asc("nodo"))


@q("g2_components", f"with recursive {_G}, b as (select a, b from g union select b, a from g), r as (select a as id, a as clase from b union select b.a, r.clase from r join b on b.b = r.id and r.clase < b.a) select id, min(clase) as clase from r group by id", "entidades")
def graph_components(ents: DataFrame) -> DataFrame:
    g = capped(ents)
    return G.components(g, G.degrees(g).select(F.col("nodo").alias("id")))


_LP = "d as materialized (select a, b, peso from g union all select b, a, peso from g), c0 as (select distinct a as nodo, a as c from d)" + "".join(f", v{i} as materialized (select d.a, l.c, sum(peso) as v from d join c{i - 1} l on d.b = l.nodo group by 1, 2), c{i} as materialized (select a as nodo, arg_min(c, struct_pack(v := -v, c := c)) as c from v{i} group by 1)" for i in range(1, 9))
_GM = _G.replace("g as (", "g as materialized (", 1)


@q("g2_communities", f"with {_GM}, {_LP} select nodo, c as comunidad from c8", "entidades")
def communities(ents: DataFrame) -> DataFrame:
    return G.propagation(materialise(capped(ents), "aristas"), 8)


@q("g2_modularity", f"with {_GM}, {_LP}, e as (select x.c as ca, y.c as cb, peso from g join c8 x on x.nodo = a join c8 y on y.nodo = b), kk as (select c, sum(peso) as k, sum(l) as l from (select ca as c, peso, case when ca = cb then peso else 0 end as l from e union all select cb, peso, case when ca = cb then peso else 0 end from e) group by 1), mm as (select sum(k) as m2 from kk) select count(*) as comunidades, round(sum(l / m2 - (k / m2) * (k / m2)), 4) as modularidad from kk, mm", "entidades")
def graph_modularity(ents: DataFrame) -> DataFrame:
    g = materialise(capped(ents), "aristas")
    return G.modularity(g, G.propagation(g, 8))


_PR = "r0 as (select a as nodo, 1.0::double / (select count(*) from o) as r from o)" + "".join(f", r{i} as materialized (select b as nodo, 0.15 / (select count(*) from o) + 0.85 * sum(w * r) as r from s join r{i - 1} on a = nodo group by b)" for i in range(1, 61))


@q("g3_pagerank", f"with {_GM}, d as materialized (select a, b, peso from g union all select b, a, peso from g), o as materialized (select a, sum(peso) as salida from d group by a), s as materialized (select d.a, d.b, peso / salida as w from d join o using (a)), {_PR} select nodo, round(r, 5) as rango from r60", "entidades")
def pagerank(ents: DataFrame) -> DataFrame:
    """Ranks of the capped graph after they settled; the tolerance is far below what is shown."""
    return G.settled_pagerank(capped(ents), tolerance=1e-12).select("nodo", F.round("r", 5).alias("rango"))


@q("g3_pagerank_steps", f"with {_GM}, d as materialized (select a, b, peso from g union all select b, a, peso from g), o as materialized (select a, sum(peso) as salida from d group by a), s as materialized (select d.a, d.b, peso / salida as w from d join o using (a)), {_PR.partition(', r6 as')[0]} select nodo, round(r, 8) as rango from r5", "entidades")
def pagerank_steps(ents: DataFrame) -> DataFrame:
    """Five steps by joins, the form for graphs that no machine holds."""
    return G.pagerank(capped(ents), 5).select("nodo", F.round("r", 8).alias("rango"))


@q("g3_centralities", None, "entidades")
def centralities(ents: DataFrame) -> DataFrame:
    return G.centralities(capped(ents))


@q("k4_network_metrics", None, "entidades")
def metrics(ents: DataFrame) -> DataFrame:
    """Degree, centralities and community of each node."""
    g = materialise(capped(ents), "aristas")
    return G.degrees(g).join(G.centralities(g), "nodo").join(G.propagation(g, 8), "nodo").join(G.settled_pagerank(g).withColumnRenamed("r", "rango"), "nodo")


@q("g4_knowledge_graph", f"with x as (select categoria || ':' || {N} as s, articulo_id as o, id from entidades) select s as origen, 'mencionado_en' as predicado, o as destino, count(*) as evidencias from x group by 1, 3", "entidades")
def knowledge(ents: DataFrame) -> DataFrame:
    from telarium.functions import text as T

    s = F.concat(F.col("categoria"), F.lit(":"), T.plain(F.col("texto")))
    return ents.groupBy(s.alias("origen"), F.lit("mencionado_en").alias("predicado"), F.col("articulo_id").alias("destino")).agg(F.count(F.lit(1)).alias("evidencias"))


@q("g5_triple_upsert", "select entidad_a as s, coalesce(categoria, '') as p, entidad_b as o, arg_max(articulo_ids, id) filter (articulo_ids is not null) as evidencia, max(id) as ultimo from coocurrencias group by 1, 2, 3", "coocurrencias")
def triples(co: DataFrame) -> DataFrame:
    """Unique triples; evidence is kept if the new one is null."""
    seen = F.when(F.col("articulo_ids").isNotNull(), F.col("id"))
    return co.groupBy(F.col("entidad_a").alias("s"), F.coalesce("categoria", F.lit("")).alias("p"), F.col("entidad_b").alias("o")).agg(F.max_by("articulo_ids", seen).alias("evidencia"), F.max("id").alias("ultimo"))


@q("w12_network_series", f"with {_ART}, m as (select distinct numero, articulo_id as art, {N} as e from entidades x join a on a.id = x.articulo_id where categoria in ('personas', 'organizaciones', 'lugares') and numero is not null), p as (select x.numero, x.e as a, y.e as b, count(*) as peso from m x join m y on x.numero = y.numero and x.art = y.art and x.e < y.e group by 1, 2, 3), n as (select numero, count(distinct e) as nodos from m group by 1), c as (select numero, count(*) as aristas from p group by 1) select numero, nodos, aristas, round(2.0 * aristas / (nodos * (nodos - 1)), 4) as densidad from n join c using (numero)", "entidades", "articulos")
def series(ents: DataFrame, arts: DataFrame) -> DataFrame:
    """Nodes, edges and density of each issue."""
    m = G.mentions(ents).join(articles(arts).where("numero is not null"), F.col("art") == F.col("id")).select("numero", "art", "e")
    p = G.cooccurrence(m, "numero").groupBy("numero").agg(F.count(F.lit(1)).alias("aristas"))
    n = m.groupBy("numero").agg(F.countDistinct("e").alias("nodos"))
    return n.join(p, "numero").withColumn("densidad", F.round(2.0 * F.col("aristas") / (F.col("nodos") * (F.col("nodos") - 1)), 4))
