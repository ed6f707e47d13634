"""Problem 8: the corpus as ids of a byte-level tokenizer, in Spark higher-order functions.

The rank map is one literal: an array of small maps, found by crc32 of the piece. A word is encoded by a
fold that merges the adjacent pair of lowest rank over its array of byte pieces; each step ranks only the two
pairs that it makes. The words of the corpus are counted, and those of the most frequent (HOT at most, of
HOT_BYTES each) are folded once; they go into the plan as a second literal of the same form. A document is then
encoded where it was read: its words are looked up in that literal, and a word that isn't there is folded on the
spot. So nothing but counts of distinct words is shuffled, and every document takes the same way, but for those
with a word over LONG bytes, for which the fold is too slow: they take the same merges through a heap in
Python. Decoding looks pieces up in a literal array and concatenates the binaries. Where only the numbers of tokens are
wanted (`count_tokens`), no plan holds a literal.

Defined results: null, empty text -> an empty list; every row gives one row, repeated rows included;
special tokens' strings are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from telarium.session import materialise, read, short_plans

BUCKETS = 1 << 14
LONG = 4096
HOT, HOT_BYTES = 50_000, 40
# Fixed value: the split pattern of the tokenizer, here with Unicode white space.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file: below TELARIUM_TOKENIZERS, else of the installed package of public tokenizers."""
    folder = os.environ.get("TELARIUM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<hex piece, rank>>, by crc32; a constant that the optimizer folds."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        buckets[zlib.crc32(piece) % BUCKETS][piece.hex().upper()] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(table: Column, piece: Column) -> Column:
    return F.try_element_at(F.get(table, F.pmod(F.crc32(piece), F.lit(BUCKETS)).cast("int")), F.hex(piece))


def encode_word(word: Column, table: Column) -> Column:
    """array<int>: ids of one word; the constant stands in the plan once, bound to a lambda variable."""
    return F.get(F.transform(F.array(table), lambda t: _fold(word, t)), F.lit(0))


def _fold(word: Column, table: Column) -> Column:
    """Ranked merges over the bytes of the word; a piece carries the rank of its pair with the next one."""
    data = F.encode(word, "utf-8")
    none = F.lit(2147483647)
    rank = lambda a, b: F.coalesce(_rank(table, F.concat(a, b)), none)
    byte = lambda i: F.substring(data, i, F.lit(1))
    last = F.octet_length(data)
    pair = lambda i: F.when(i < last, rank(byte(i), byte(i + 1))).otherwise(none)
    item = lambda r, p: F.struct(r.alias("r"), p.alias("p"))
    start = F.transform(F.sequence(F.lit(1), last), lambda i: item(pair(i), byte(i)))

    def step(acc: Column, _: Column) -> Column:
        best = F.array_min(F.transform(acc, lambda x, j: F.struct(x["r"].alias("r"), j.alias("j"))))

        def merge(b: Column) -> Column:
            j = b["j"]
            before, here, right, after = (F.get(acc, j + k) for k in (-1, 0, 1, 2))
            made = F.concat(here["p"], right["p"])

            def put(m: Column) -> Column:
                new = item(F.when(after.isNotNull(), rank(m, after["p"])).otherwise(none), m)
                left = F.when(j > 0, F.array(item(rank(before["p"], m), before["p"]))).otherwise(F.slice(acc, F.lit(1), F.lit(0)))
                return F.concat(F.slice(acc, F.lit(1), F.greatest(j - 1, F.lit(0))), left, F.array(new), F.slice(acc, j + 3, F.size(acc)))

            return F.when(b["r"] == none, acc).otherwise(F.get(F.transform(F.array(made), put), F.lit(0)))

        return F.when(F.size(acc) < 2, acc).otherwise(F.get(F.transform(F.array(best), merge), F.lit(0)))

    pieces = F.aggregate(F.sequence(F.lit(1), last), start, step)
    whole = _rank(table, data)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(pieces, lambda x: _rank(table, x["p"])))


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, through a heap."""
    n = len(data)
    piece = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if not piece[i] or j >= n or len(piece[i]) + len(piece[j]) != size or ranks[piece[i] + piece[j]] != r:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n and (new := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (new, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p]


def frequent(words: DataFrame, ranks: dict[bytes, int]) -> Column:
    """array<map<word, ids>>, by crc32: the ids of the most frequent words, a constant.

    words is (word, n). The bound on n comes from the numbers of words by eighths of powers of two of their
    counts, so nothing is sorted; at most HOT words of HOT_BYTES bytes are on the driver.
    """
    words = words.where(F.octet_length("word") <= HOT_BYTES)
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = {r["k"]: r["n"] for r in words.groupBy(level.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # under 512 rows
    least, total = 1 << 30, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > HOT:
            break
        least = k
    parts = words.sparkSession.sparkContext.defaultParallelism  # few words, but each of some work
    made = words.where(level >= least).repartition(parts, "word").select("word", encode_word(F.col("word"), rank_map(ranks)).alias("ids"))
    buckets: list[dict[str, list[int]]] = [{} for _ in range(BUCKETS)]
    for word, ids in materialise(made, "frecuentes").collect():
        buckets[zlib.crc32(word.encode()) % BUCKETS][word] = ids
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,array<int>>>")


# every text with a word over LONG bytes has a run of a quarter as many characters of one kind
_RUN = "{" + str(LONG // 4) + "}"
GIANT = rf"(?U)\p{{L}}{_RUN}|\p{{N}}{_RUN}|[^\s\p{{L}}\p{{N}}]{_RUN}|\s{_RUN}"


def encode(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """(id_col, ids) of each row, written, so that the literals stay out of the plans that read them."""
    with short_plans(df.sparkSession):
        return materialise(_encoded(df, id_col, text, path), "ids")


def _encoded(df: DataFrame, id_col: str, text: str, path: str | None) -> DataFrame:
    """(id_col, ids) of each row, encoded where it was read; the plan holds the literals."""
    ranks = load_ranks(path or vocabulary_path())
    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text}`").alias("t"))
    split = F.regexp_extract_all("t", F.lit(PATTERN), 0)
    with short_plans(df.sparkSession):
        counts = docs.select(F.explode(split).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        hot = frequent(materialise(counts, "palabras"), ranks)
    none = F.array().cast("array<int>")

    def ids(c: Column) -> Column:
        look = lambda w: F.try_element_at(F.get(c["hot"], F.pmod(F.crc32(F.encode(w, "utf-8")), F.lit(BUCKETS)).cast("int")), w)
        return F.flatten(F.transform(split, lambda w: F.coalesce(look(w), _fold(w, c["ranks"]))))

    giant = F.coalesce((F.length("t") >= LONG // 4) & F.col("t").rlike(GIANT), F.lit(False))
    tables = F.array(F.struct(hot.alias("hot"), rank_map(ranks).alias("ranks")))
    found = F.when(F.length("t") > 0, F.get(F.transform(tables, ids), F.lit(0))).otherwise(none)
    here = docs.where(~giant).select(F.col("doc").alias(id_col), found.alias("ids"))
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary

    def heap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "ids": [[i for w in ws for i in merge_bytes(w.encode(), shared.value)] for ws in b["w"]]})

    there = docs.where(giant).select("doc", split.alias("w")).mapInPandas(heap, f"doc {dict(docs.dtypes)['doc']}, ids array<int>")
    return here.unionByName(there.withColumnRenamed("doc", id_col))


def count_tokens(df: DataFrame, id_col: str, text: str, path: str | None = None) -> DataFrame:
    """(id_col, tokens) of each row, without the ids.

    The vocabulary is a broadcast of the Python workers, not a literal: a plan with literals is described hundreds of
    times, each time in full, and these strings fill the driver's memory. The words of an Arrow batch are told apart once
    and take the merges of the heap.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PATTERN), 0).alias("w"))
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path or vocabulary_path()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = shared.value, {}

        def tokens(data: bytes) -> int:
            if data in ranks:
                return 1
            if len(data) > HOT_BYTES:
                return len(merge_bytes(data, ranks))
            if data not in known:
                if len(known) > 200_000:
                    known.clear()
                known[data] = len(merge_bytes(data, ranks))
            return known[data]

        for b in batches:
            lists = b.column("w")
            words = lists.flatten().dictionary_encode()
            each = np.array([tokens(w.encode()) for w in words.dictionary.to_pylist()], "int64")
            sums = np.concatenate([[0], np.cumsum(each[words.indices.to_numpy(zero_copy_only=False)])])
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype="int64")
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array((sums[ends] - sums[ends - sizes]).astype("int64"))], ["doc", "tokens"])

    schema = StructType([StructField("doc", docs.schema["doc"].dataType), StructField("tokens", LongType())])
    return docs.mapInArrow(count, schema).withColumnRenamed("doc", id_col)


def decode(df: DataFrame, ids: str, path: str | None = None) -> Column:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
    ranks = load_ranks(path or vocabulary_path())
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    data = F.array_join(F.transform(F.col(ids), lambda i: F.get(table, i)), "")
    return F.decode(F.unhex(data), "utf-8")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_texto(spark, sf_dir: str) -> DataFrame:
    """The round trip: each document decoded from its ids."""
    found = encode(read(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", decode(found, "ids").alias("text"))


SQL = {"p8_texto": "select doc_id, coalesce(text, '') as text from documents"}
QUERIES = {"p8_ids": p8_ids, "p8_texto": p8_texto}
