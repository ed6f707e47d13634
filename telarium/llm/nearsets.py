"""Problem 2: groups of near-duplicate texts, by signatures over a partitioned universe and exact verification.

The universe of shingles is hashed into 2^SEGMENT_BITS segments, and the cost of a segment is its number of shingle
occurrences over all records. A record of n shingles may lack n - ceil(t n) of a partner's at most; so it is
indexed by one shingle more than that, those of its cheapest segments in one order for all records, and two
similar records agree in one. This is prefix filtering with a cost-based order; why the signatures are single
shingles and not segment subsets with their deletion neighbourhoods, the README says with figures. Every index
entry carries size, rank and a parity bitmap of the record's whole set, from which bounds on the overlap discard
most pairs inside the join; the rest are verified exactly on the whole sets.

Records with equal sets are collapsed while the sets are gathered, so groups of exact copies, however large,
cost one row each until the query asks for their pairs; there is one plan for all sizes. A set is kept as sorted
48-bit hashes in one binary value.

Defined results: null, empty and short texts (under min_words words) have no partners; rows that repeat an
id count as one row that has all their texts; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.operators.graph import components
from telarium.session import materialise, read

SEGMENT_BITS = 17
BYTES = 6  # of a shingle's hash
WORDS = 4  # 64-bit words of the parity bitmap


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def shingles(w: Column, k: int) -> Column:
    """The sorted distinct hashes of runs of k words (empty under k words)."""
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
    run = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, F.array_sort(F.array_distinct(run))).otherwise(F.array().cast("array<long>"))


def sets(df: DataFrame, id_col: str, text: str, k: int, min_words: int) -> DataFrame:
    """(id, h, s): hash of the set and the set itself, of texts with min_words words at least."""
    # bound to a lambda variable, the list of words is made once a text and not once a shingle
    short = F.array().cast("array<long>")
    made = F.transform(
        F.array(words(F.col(f"`{text}`"))), lambda w: F.when(F.size(w) >= min_words, shingles(w, k)).otherwise(short)
    )
    s = df.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.get(made, F.lit(0)).alias("s"))

    def packed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("s")
            v, n = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
            doc = np.repeat(np.arange(len(n)), n)
            v = (v.view(np.uint64) >> np.uint64(64 - 8 * BYTES)).astype(np.int64)
            order = np.lexsort((v, doc))
            v, doc = v[order], doc[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
            v, doc = v[new], doc[new]
            ends = np.cumsum(np.bincount(doc, minlength=len(n))) * BYTES
            data = v.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
            blobs = [data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([md5(x).digest() for x in blobs], pa.binary()), pa.array(blobs, pa.binary())], names=["id", "h", "s"])

    return s.where(F.size("s") > 0).mapInArrow(packed, f"id {dict(s.dtypes)['id']}, h binary, s binary")


def _flat(b, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of a column of packed sets."""
    sets_ = b.column(name).to_pylist()
    n = np.array([len(x) // BYTES for x in sets_], np.int64)
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    wide[:, :BYTES] = np.frombuffer(b"".join(sets_), np.uint8).reshape(-1, BYTES)
    return wide.view("<i8").ravel(), n


def segment_costs(reps: DataFrame) -> np.ndarray:
    """Shingle occurrences of each segment; one array of 2^SEGMENT_BITS counts, however large the data."""
    m = 1 << SEGMENT_BITS

    def count(batches):
        total = np.zeros(m, np.int64)
        for b in batches:
            total += np.bincount(_flat(b, "s")[0] & (m - 1), minlength=m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["g", "n"])

    got = reps.select("s").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    costs = np.zeros(m, np.int64)
    costs[got.column("g").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(costs, np.iinfo(np.int32).max).astype(np.int32)


def index(reps: DataFrame, costs: DataFrame, threshold: float) -> DataFrame:
    """(t, id, n, p, b0..b3): index entries of the allocated segments."""
    shared = reps.sparkSession.sparkContext.broadcast(costs)  # 2^SEGMENT_BITS counts of 4 bytes

    def entries(batches):
        cost = shared.value
        m = len(cost) - 1
        for b in batches:
            if not b.num_rows:
                continue
            v, n = _flat(b, "s")
            doc = np.repeat(np.arange(len(n)), n)
            # parity bitmap of the whole set
            bit = ((v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64) % (64 * WORDS)
            odd = (np.bincount(doc * 64 * WORDS + bit, minlength=len(n) * 64 * WORDS) & 1).astype(np.uint8)
            maps = np.packbits(odd.reshape(len(n), 64 * WORDS), axis=1).view(np.int64).reshape(len(n), WORDS)
            # cheapest segments first; one order for all records
            order = np.lexsort((v, cost[v & m], doc))
            rank = np.arange(len(v)) - np.repeat(np.cumsum(n) - n, n)
            units = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            keep = rank < np.repeat(units, n)
            v, rank, doc = v[order][keep], rank[keep], doc[order][keep]
            ids = b.column("id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v), ids, pa.array(n[doc].astype(np.int32)), pa.array(rank.astype(np.int32)), *(pa.array(maps[doc, i]) for i in range(WORDS))],
                names=["t", "id", "n", "p", *(f"b{i}" for i in range(WORDS))],
            )

    kind = dict(reps.dtypes)["id"]
    return reps.select("id", "s").mapInArrow(entries, f"t long, id {kind}, n int, p int, " + ", ".join(f"b{i} long" for i in range(WORDS)))


def candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that no bound on their overlap excludes; a is the smaller set."""
    x, y = entries.alias("x"), entries.alias("y")
    nx, ny = F.col("x.n"), F.col("y.n")
    need = F.ceil(F.lit(threshold) * (nx + ny) / F.lit(1 + threshold) - F.lit(1e-9))
    differ = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(WORDS)), F.lit(0))
    smaller = (nx < ny) | ((nx == ny) & (F.col("x.id") < F.col("y.id")))
    pairs = x.join(y, F.col("x.t") == F.col("y.t")).where(
        smaller
        & (nx >= F.lit(threshold) * ny - F.lit(1e-9))
        & (F.lit(1) + F.least(nx - F.col("x.p"), ny - F.col("y.p")) - 1 >= need)
        & (nx + ny - differ >= 2 * need)
    )
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def verify(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs whose whole sets reach the threshold."""
    ra = reps.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    rb = reps.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(ra, "a").join(rb, "b")

    def exact(batches):
        for b in batches:
            if not b.num_rows:
                continue
            va, na = _flat(b, "sa")
            vb, nb = _flat(b, "sb")
            row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)])
            v = np.concatenate([va, vb])
            order = np.lexsort((v, row))
            r, v = row[order], v[order]
            same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
            common = np.bincount(r[1:][same], minlength=len(na))
            sim = common / (na + nb - common)
            keep = pa.array(common * (1 + threshold) >= threshold * (na + nb) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "sim"]).filter(keep)

    kind = dict(reps.dtypes)["id"]
    return both.mapInArrow(exact, f"a {kind}, b {kind}, sim double")


def similar(df: DataFrame, id_col: str, text: str, k: int = 5, threshold: float = 0.8, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, rep) of each set of equal shingles, links (a, b, sim) between representatives."""
    made = sets(df, id_col, text, k, min_words)
    # the set of the smallest id stands for all that are equal; partial minima are taken before the shuffle
    first = made.groupBy("h").agg(F.min(F.struct("id", "s")).alias("x"))
    firsts = materialise(first.select("h", F.col("x.id").alias("rep"), "x.s"), "conjuntos")
    # the members are found by a second pass over the texts, so that no set is written twice
    members = made.select("id", "h").join(firsts.select("h", "rep"), "h")
    members = materialise(members.groupBy("id").agg(F.min("rep").alias("rep")), "miembros")
    reps = firsts.select(F.col("rep").alias("id"), "s")
    costs = segment_costs(reps)
    pairs = candidates(index(reps, costs, threshold), threshold)
    links = materialise(verify(pairs, reps, threshold), "enlaces")
    return members, links.groupBy("a", "b").agg(F.max("sim").alias("sim"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    members, links = similar(read(spark, sf_dir, "ocr"), "id", "texto_limpio", k=3, threshold=0.5, min_words=20)
    a = members.select(F.col("id").alias("x"), F.col("rep").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p2_grupos(spark, sf_dir: str) -> DataFrame:
    """One row per text with its class and its representative's number of links."""
    members, links = similar(read(spark, sf_dir, "ocr"), "id", "texto_limpio", k=3, threshold=0.5, min_words=20)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("enlaces"))
    classes = components(links, members.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
    out = members.join(classes, "rep").join(ends, "rep", "left")
    return out.select("id", "rep", "clase", F.coalesce("enlaces", F.lit(0)).alias("enlaces"))


_SETS = r"""
with w as (select id, regexp_extract_all(lower(texto_limpio), '[\p{L}\p{Nd}]+') as w from ocr where texto_limpio is not null),
s as (select id, list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s
      from w where len(w) >= 20),
e as (select id, len(s) as n, unnest(s) as t from s),
c as (select a.id as id_a, b.id as id_b, a.n as na, b.n as nb, count(*) as k from e a join e b on a.t = b.t and a.id < b.id group by all)
"""
SQL = {"p2_found": _SETS + "select id_a, id_b from c where 2 * k >= na + nb - k"}
QUERIES = {"p2_found": p2_found, "p2_grupos": p2_grupos}
