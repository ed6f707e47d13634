"""Problem 1: duplicates hidden by formatting, kept in an incremental ledger.

A ledger is a folder: one row per canonical key (table, key, copies, first_id) in bucket folders, and a
manifest for each update that says which version of each bucket holds. The number of buckets is chosen when
the ledger is made and stored with it. A batch is aggregated by key (map-side first, so a key with a third of
all rows moves one partial row per task) and full-outer-joined with those buckets of the ledger that it
touches; counts are added and the smallest id is kept. Touched buckets are written anew, a bucket by several
tasks; the others are neither read nor rewritten. The manifest is written last, so an update that dies
leaves the ledger as it was.

Defined results: a null text is no record and is left out; a null in a scope column is a value of its
own (nulls agree with each other); a text without letters and digits has the empty key and agrees
with others of its kind in its scope; an id that comes twice counts twice and is kept once; extra
columns are ignored; empty tables give an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.session import materialise, read, table_path

WORD = r"\p{L}\p{M}\p{Nd}"
BUCKET_BYTES = 128 << 20  # of a batch for which a bucket is made, 16 buckets at least
SPLITS = 8  # tasks that write one bucket, at most
BATCHES = 3
ROW = "tabla string, key binary, copies long, first_id long"


def _words(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[^{WORD}]+", " "))


def _field(c: Column) -> Column:
    """Words of a field; one comma between words turns `B, A` into `A B`."""
    bare = F.regexp_replace(c, f"^[^{WORD}]+|[^{WORD}]+$", "")
    parts = F.split(bare, ",")
    swapped = F.concat_ws(" ", _words(F.get(parts, F.lit(1))), _words(F.get(parts, F.lit(0))))
    return F.when(F.size(parts) == 2, swapped).otherwise(_words(bare))


def canonical(c: Column) -> Column:
    """The text without case, spacing, punctuation, order of fields and order around a lone comma."""
    low = F.lower(c)
    fields = F.array_sort(F.filter(F.transform(F.split(low, "[;|]"), _field), lambda x: x != ""))
    return F.when(low.rlike("[;|,]"), F.array_join(fields, "\u001f")).otherwise(_words(low))


def keyed(df: DataFrame, id_col: str, text: str, scope: list[str], table: str) -> DataFrame:
    """(tabla, key, id): the 128-bit key of table, scope and canonical text of each record."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`")), F.lit("!")) for c in scope]
    key = F.unhex(F.md5(F.concat_ws("\u001e", F.lit(table), *parts, canonical(F.col(f"`{text}`")))))
    rows = df.where(F.col(f"`{text}`").isNotNull())
    return rows.select(F.lit(table).alias("tabla"), key.alias("key"), F.col(f"`{id_col}`").alias("id"))


class Ledger:
    """A stored ledger at a path; make it with create, find it again with open."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, version: int, live: dict[int, int]):
        self.spark, self.path, self.buckets, self.version = spark, path, buckets, version
        self.live = live  # bucket -> version; at most `buckets` entries

    @classmethod
    def create(cls, spark: SparkSession, path: str, buckets: int) -> Ledger:
        new = cls(spark, path, buckets, 0, {})
        new._commit()
        return new

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        rows = spark.read.parquet(f"{path}/manifest")
        last = rows.agg(F.max("v")).first()[0]
        held = rows.where(F.col("v") == last).collect()  # one row a bucket
        return cls(spark, path, held[0]["buckets"], last, {r["bucket"]: r["part"] for r in held if r["bucket"] is not None})

    def _commit(self) -> None:
        rows = [(self.buckets, b, v) for b, v in self.live.items()] or [(self.buckets, None, None)]
        df = self.spark.createDataFrame(rows, "buckets int, bucket int, part int").coalesce(1)
        df.write.mode("overwrite").parquet(f"{self.path}/manifest/v={self.version}")

    def table(self, of: list[int] | None = None) -> DataFrame:
        """(bucket, tabla, key, copies, first_id) of the given or all buckets."""
        paths = [f"{self.path}/parts/part={v}/bucket={b}" for b, v in self.live.items() if of is None or b in of]
        kind = f"{ROW}, bucket int"
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).option("basePath", f"{self.path}/parts").parquet(*paths)

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def update(self, rows: DataFrame) -> Ledger:
        """The ledger after one more batch (tabla, key, id)."""
        rows = self.bucketed(rows)
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return self
        on = ["bucket", "tabla", "key"]
        b = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).alias("b")
        o = self.table(touched).alias("o")
        added = F.coalesce(F.col("o.copies"), F.lit(0)) + F.coalesce(F.col("b.copies"), F.lit(0))
        merged = o.join(b, on, "full_outer").select(*on, added.alias("copies"), F.least("o.first_id", "b.first_id").alias("first_id"))
        version = self.version + 1
        spread = merged.repartition("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SPLITS)))
        spread.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/parts/part={version}")
        new = Ledger(self.spark, self.path, self.buckets, version, self.live | dict.fromkeys(touched, version))
        new._commit()
        return new

    def vacuum(self) -> None:
        """Deletes versions of buckets that the ledger no longer holds; for when nobody reads older states."""
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        for part in fs.listStatus(root) if fs.exists(root) else ():
            v = int(part.getPath().getName().partition("=")[2])
            for bucket in fs.listStatus(part.getPath()):
                name, _, b = bucket.getPath().getName().partition("=")
                if name == "bucket" and self.live.get(int(b)) != v:
                    fs.delete(bucket.getPath(), True)


def copies(ledger: Ledger, rows: DataFrame) -> DataFrame:
    """(tabla, id_conservado, id_copia) of the rows that the ledger holds under an earlier id.

    Rows are joined with the keys that have copies; adaptive execution splits a hot key's rows, as the
    ledger's side has one row a key.
    """
    many = ledger.table().where("copies > 1").select("key", "first_id")
    found = rows.select("tabla", "key", "id").join(many, "key").where("id > first_id")
    return found.select("tabla", F.col("first_id").alias("id_conservado"), F.col("id").alias("id_copia"))


TABLES = {
    "entidades": ("id", "texto", ["articulo_id", "categoria"]),
    "anotaciones": ("id", "texto_orig", ["art_id", "fuente", "categoria"]),
}


def build(spark, sf_dir: str) -> tuple[Ledger, DataFrame]:
    """The ledger of both tables, delivered in BATCHES ranges of ids, and the keyed rows."""
    rows, size = [], 0
    for table, (id_col, text, scope) in TABLES.items():
        df = read(spark, sf_dir, table)
        low, high = df.agg(F.min(id_col), F.max(id_col)).first()
        low, wide = low or 0, (high or 0) - (low or 0) + 1
        batch = F.floor((F.col("id") - F.lit(low)) * F.lit(float(BATCHES)) / F.lit(float(wide))).cast("int")
        rows.append(keyed(df, id_col, text, scope, table).withColumn("lote", batch))
        size += int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    keys = materialise(reduce(DataFrame.unionByName, rows), "claves", partition_by=["lote"])
    ledger = Ledger.create(spark, table_path(spark, "ledger"), max(16, size // BUCKET_BYTES))
    for i in range(BATCHES):
        ledger = ledger.update(keys.where(F.col("lote") == i).select("tabla", "key", "id"))
        ledger.vacuum()  # no earlier state is read
    return ledger, keys


def p1_found(spark, sf_dir: str) -> DataFrame:
    return copies(*build(spark, sf_dir))


def p1_ledger(spark, sf_dir: str) -> DataFrame:
    """One row per record with its number of copies and its earliest id."""
    ledger, _ = build(spark, sf_dir)
    return ledger.table().select("tabla", F.lower(F.hex("key")).alias("clave"), "copies", "first_id")


_SQL_FIELD = r"""
  list_sort(list_filter(list_transform(regexp_split_to_array(lower({t}), '[;|]'), lambda f:
    case when len(string_split(regexp_replace(f, '^[^\p{{L}}\p{{M}}\p{{Nd}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}]+$', '', 'g'), ',')) = 2
    then trim(trim(regexp_replace(string_split(regexp_replace(f, '^[^\p{{L}}\p{{M}}\p{{Nd}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}]+$', '', 'g'), ',')[2], '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g'))
         || ' ' || trim(regexp_replace(string_split(regexp_replace(f, '^[^\p{{L}}\p{{M}}\p{{Nd}}]+|[^\p{{L}}\p{{M}}\p{{Nd}}]+$', '', 'g'), ',')[1], '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g')))
    else trim(regexp_replace(f, '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g')) end), lambda x: x <> ''))
"""
_E, _A = _SQL_FIELD.format(t="texto"), _SQL_FIELD.format(t="texto_orig")
SQL = {
    "p1_found": f"""
with k as (
  select 'entidades' as tabla, id, articulo_id as a, categoria as c, '' as f, {_E} as k from entidades
  union all
  select 'anotaciones', id, art_id, categoria, fuente, {_A} from anotaciones),
m as (select *, min(id) over (partition by tabla, a, c, f, k) as id_conservado from k)
select tabla, id_conservado, id as id_copia from m where id > id_conservado""",
    "p1_ledger": f"""
with k as (
  select 'entidades' as tabla, id, md5(concat_ws(chr(30), 'entidades', coalesce('=' || articulo_id, '!'), coalesce('=' || categoria, '!'), array_to_string({_E}, chr(31)))) as clave
  from entidades where texto is not null
  union all
  select 'anotaciones', id, md5(concat_ws(chr(30), 'anotaciones', coalesce('=' || art_id, '!'), coalesce('=' || fuente, '!'), coalesce('=' || categoria, '!'), array_to_string({_A}, chr(31))))
  from anotaciones where texto_orig is not null)
select tabla, clave, count(*) as copies, min(id) as first_id from k group by 1, 2""",
}
QUERIES = {"p1_found": p1_found, "p1_ledger": p1_ledger}
