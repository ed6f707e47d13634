"""Problem 6: items that appear together, by an external sort of packed pair codes.

Names get dense 32-bit ids in code-point order; a pair is one 64-bit code. The codes with their records
are hash-partitioned by (code, record), sorted within partitions (Spark's sorter spills sorted runs and
merges them), and equal neighbours are collapsed and run-length counted. As the same (code, record)
always lands in one partition, the counts of the partitions add up, and a pair or name with a third of
all rows is spread over all tasks. Odds ratios use the continuity correction of one half.

Defined results: rows with a null name, without a list, with an unreadable list or of a name beside
itself take no part; null ids in a list are skipped and repeated ids count once; names are compared as
they are written; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.session import materialise, read

MIN_TOGETHER = 4
MIN_LIFT = 5


def baskets(df: DataFrame) -> DataFrame:
    """(a, b, arts): smaller name first, the distinct records of the row's list."""
    arts = F.array_distinct(F.array_compact(F.from_json("articulo_ids", "array<string>")))
    rows = df.where("entidad_a <> entidad_b").select(
        F.least("entidad_a", "entidad_b").alias("a"), F.greatest("entidad_a", "entidad_b").alias("b"), arts.alias("arts")
    )
    return rows.where("size(arts) > 0")


def dictionary(names: DataFrame) -> DataFrame:
    """(name, id): dense ids in the order of the names. The offsets of the partitions are on the driver."""
    ordered = materialise(names.distinct().repartitionByRange("name").sortWithinPartitions("name"), "nombres")
    local = ordered.select("name", F.monotonically_increasing_id().alias("m"))
    local = materialise(local.select("name", F.shiftright("m", 33).alias("part"), (F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("r")), "nombres")
    firsts = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first")).collect()  # one row a partition
    offset, offsets = 0, []
    for row in sorted(firsts, key=lambda r: r["first"].encode()):
        offsets.append((row["part"], offset))
        offset += row["n"]
    if offset >= 1 << 31:
        raise ValueError("more names than 31 bits hold")
    table = names.sparkSession.createDataFrame(offsets or [(0, 0)], "part long, start long")
    return local.join(F.broadcast(table), "part").select("name", (F.col("start") + F.col("r")).alias("id"))


def _distinct_runs(batches):
    """Drops equal neighbours of sorted (code, art) rows, across batches."""
    last = None
    for b in batches:
        code, art = b.column("code").to_numpy(), b.column("art").to_numpy()
        if not len(code):
            continue
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (art[1:] != art[:-1])
        new[0] = last != (code[0], art[0])
        last = (code[-1], art[-1])
        yield pa.RecordBatch.from_arrays([pa.array(code[new]), pa.array(art[new])], names=["code", "art"])


def _run_lengths(batches):
    """(code, n) of sorted codes; runs that cross batches come out in parts."""
    for b in batches:
        code = b.column("code").to_numpy()
        if not len(code):
            continue
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[starts]), pa.array(np.diff(np.append(starts, len(code))))], names=["code", "n"]
        )


def pair_counts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(code, n_ab), (id, n), (name, id) and the number of records."""
    rows = materialise(baskets(df), "cestas")
    ids = materialise(dictionary(rows.select(F.explode(F.array("a", "b")).alias("name"))), "diccionario")
    n = rows.select(F.explode("arts").alias("art")).agg(F.countDistinct("art")).first()[0]
    a, b = (ids.select(F.col("name").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
    coded = rows.join(a, "a").join(b, "b")
    code = F.shiftleft("ia", 32).bitwiseOR(F.col("ib"))
    pairs = coded.select(code.alias("code"), F.explode("arts").alias("s")).select("code", F.xxhash64("s").alias("art"))
    runs = pairs.repartition("code", "art").sortWithinPartitions("code", "art").mapInArrow(_distinct_runs, "code long, art long")
    runs = materialise(runs, "tramos")
    counts = runs.select("code").mapInArrow(_run_lengths, "code long, n long").groupBy("code").agg(F.sum("n").alias("n_ab"))
    each = F.explode(F.array(F.shiftright("code", 32), F.col("code").bitwiseAND(F.lit((1 << 32) - 1))))
    single = runs.select(each.alias("id"), "art").groupBy("id").agg(F.countDistinct("art").alias("n"))
    return counts, single, ids, n


def associations(df: DataFrame, least: int = 1) -> DataFrame:
    """Counts and association measures of each pair with at least `least` common records."""
    counts, single, ids, n = pair_counts(df)
    single = materialise(single, "sueltos").join(ids, "id")
    kept = counts.where(F.col("n_ab") >= least).select(
        F.shiftright("code", 32).alias("ia"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("ib"), "n_ab"
    )
    a = single.select(F.col("id").alias("ia"), F.col("name").alias("entidad_a"), F.col("n").alias("n_a"))
    b = single.select(F.col("id").alias("ib"), F.col("name").alias("entidad_b"), F.col("n").alias("n_b"))
    out = kept.join(a, "ia").join(b, "ib").withColumn("n", F.lit(n).cast("long"))
    x, y, z = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    rest = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    half = F.lit(0.5)
    return out.select(
        "entidad_a", "entidad_b", "n_ab", "n_a", "n_b", "n",
        (x * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("veces_azar"),
        F.log((x + half) * (rest + half) / ((y + half) * (z + half))).alias("log_razon"),
    )


def p6_found(spark, sf_dir: str) -> DataFrame:
    pairs = associations(read(spark, sf_dir, "coocurrencias"), MIN_TOGETHER)
    return pairs.where(F.col("n_ab") * F.col("n") >= MIN_LIFT * F.col("n_a") * F.col("n_b")).select("entidad_a", "entidad_b")


def p6_pares(spark, sf_dir: str) -> DataFrame:
    return associations(read(spark, sf_dir, "coocurrencias"))


_COUNTS = """
with r as (select least(entidad_a, entidad_b) as a, greatest(entidad_a, entidad_b) as b,
                  unnest(from_json(articulo_ids, '["varchar"]')) as art
           from coocurrencias where entidad_a <> entidad_b and articulo_ids is not null and articulo_ids <> ''),
p as (select a, b, count(distinct art) as n_ab from r where art is not null group by a, b),
s as (select e, count(distinct art) as k from (select a as e, art from r union all select b, art from r) where art is not null group by e),
t as (select count(distinct art) as n from r),
x as (select p.a as entidad_a, p.b as entidad_b, n_ab, sa.k as n_a, sb.k as n_b, n
      from p join s sa on sa.e = p.a join s sb on sb.e = p.b cross join t)
"""
SQL = {
    "p6_found": _COUNTS + f"select entidad_a, entidad_b from x where n_ab >= {MIN_TOGETHER} and n_ab * n >= {MIN_LIFT} * n_a * n_b",
    "p6_pares": _COUNTS
    + """select *, n_ab * n / (n_a * n_b)::double as veces_azar,
 ln((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))) as log_razon from x""",
}
QUERIES = {"p6_found": p6_found, "p6_pares": p6_pares}
