"""Upserts into stored tables, and differences of tables.

A target is a stored table with one row a key; merge joins it once with a batch of one row a key. What a column
becomes where both sides have the key is a rule of the caller: the target's value, the batch's, or a function of both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.session import materialise


def upsert(arts: DataFrame) -> DataFrame:
    """Partial aggregation by id; no window, so a repeated id costs no sort."""
    when = F.coalesce("modificado", F.lit("1900-01-01").cast("timestamp_ntz"))
    x = arts.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("archivo_origen", "numero", "titulo", "estado")), when.alias("w"))
    return x.groupBy("id").agg(
        F.min_by("archivo_origen", "w").alias("archivo_origen"), F.min_by("numero", "w").alias("numero"),
        F.max_by("titulo", "w").alias("titulo"), F.max_by("estado", "w").alias("estado"), F.max("w").alias("modificado"),
    )


def side(ents: DataFrame, source: str) -> DataFrame:
    """The mentions of one load, one row a key."""
    return ents.where(F.col("fuente") == source).groupBy("articulo_id", "texto", "categoria").agg(F.max("confianza").alias("c"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on the key, rows that differ."""
    key = ["articulo_id", "texto", "categoria"]
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumnRenamed("c", "c2").withColumn("in_b", F.lit(True)), key, "full_outer")
    change = F.when(F.col("in_a").isNull(), "agregada").when(F.col("in_b").isNull(), "quitada").when(~F.col("c").eqNullSafe(F.col("c2")), "modificada")
    return j.select(*key, change.alias("cambio")).where("cambio is not null")


def stored(df: DataFrame) -> DataFrame:
    """A target: written to the shared folder and read from there."""
    return materialise(df, "destino")


def merge(target: DataFrame, batch: DataFrame, on: list[str], rules: dict[str, str | Callable[[Column, Column], Column]]) -> DataFrame:
    """The target after the batch: 'old' keeps the target's value, 'new' takes the batch's, a function gets both.

    Rows of one side only stay as they are. A null of one side is a value like others for 'old' and 'new'.
    """
    t, b = target.withColumn("_in", F.lit(True)).alias("t"), batch.withColumn("_in", F.lit(True)).alias("b")

    def value(c: str) -> Column:
        old, new, rule = F.col(f"t.{c}"), F.col(f"b.{c}"), rules[c]
        both = old if rule == "old" else new if rule == "new" else rule(old, new)
        return F.when(F.col("b._in").isNull(), old).when(F.col("t._in").isNull(), new).otherwise(both).alias(c)

    return t.join(b, on, "full_outer").select(*on, *map(value, rules))


def replace(target: DataFrame, batch: DataFrame, on: list[str]) -> DataFrame:
    """The target without its rows of those keys that the batch has, and the batch; a null key is a key."""
    keys = batch.select(*(F.col(c).alias(f"_{c}") for c in on)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    return target.join(keys, same, "left_anti").unionByName(batch)


def stubs(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """A minimal row (id, titulo) for each parent that children name and the table lacks."""
    named = children.select(F.col(key).alias("id")).where("id is not null").distinct()
    return named.join(parents.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("titulo"))
