"""Problem 4: matching entities of two sources without keys, by a regularised Gaussian mixture.

What descriptions say of a trade is compared by words learned from the tables: two words tell the same trade
if they stand in the two descriptions of candidates whose years agree far more often than chance has it
(word_ties); nothing is known of trades beforehand.

Candidates come from the segment join of all names of both sides (labels, typed texts, and spellings of
mentions that carry the authority's id) and their shortened forms. Each candidate has a vector of
similarities of name, trade, birth, death (or foundation) and place, any of which may be missing. Two
Gaussians with shrunk diagonal covariances, one of matched and one of unmatched vectors, are fitted
without labels by expectation-maximisation; missing entries are integrated out. Transitivity is kept in
every E-step: rows of one authority id are one entity and share their evidence, and a row of the other
source belongs to one id or to none, so the posteriors of its ids compete. Only the parameters are on the
driver.

Defined results: rows with null names or without a result take no part; a null description is missing
evidence; repeated rows count once; a description of more than WORDS different words gives no evidence of trades; unreadable JSON is no result; ids that are null are an entity for each
row; ties stay below one half and are no match; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.llm.names import _agree, authority_ids, blocked, fold, forms, learn, plain, segment_join, tokens
from telarium.session import materialise, read

FEATURES = ("name", "trade", "birth", "death", "place")
STEPS = 25
FLOOR = 0.02  # added to every variance
PRIOR = 0.3
WORDS = 64
TIES, LIFT = 2, 2.0  # pairs of descriptions and times chance, at least, for two words to tell one trade
RARE = 0.15  # a word in at most this share of the descriptions of both sides tells the same as itself


def describe(text: str | None) -> tuple[list[str], int | None, int | None, str | None]:
    """Words beside years and place, year of birth or foundation, year of death, place."""
    if not text or not text.strip():
        return [], None, None, None
    birth = death = None
    years = re.search(r"(\d{4})\s*[-–—]\s*(\d{4})", text)
    if years:
        birth, death = int(years.group(1)), int(years.group(2))
    elif m := re.search(r"†\s*(\d{4})", text):
        death = int(m.group(1))
    elif m := re.search(r"(\d{4})", text):
        birth = int(m.group(1))
    # a place starts with a capital letter
    place = re.search(r"\b([A-ZÁÉÍÓÚÑÜ][^\W\d_]+(?:\s+(?:del?|la|las|los|[A-ZÁÉÍÓÚÑÜ][^\W\d_]+))*(?<!\bde)(?<!\bdel))", text)
    words = sorted({w for w in tokens(text if not place else text.replace(place.group(1), " ")) if len(w) > 2 and not w.isdigit()})
    return words if len(words) <= WORDS else [], birth, death, fold(plain(place.group(1))) if place else None


def described(df: DataFrame, text: str) -> DataFrame:
    """df with words, birth, death and place of a description; one call a distinct description."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([describe(x) for x in b["x"]], columns=["words", "birth", "death", "place"])
            yield pd.concat([b["x"].reset_index(drop=True), out.astype({"birth": "Int64", "death": "Int64"})], axis=1)

    seen = df.select(F.col(text).alias("x")).where("x is not null").distinct()
    parsed = seen.mapInPandas(rows, "x string, words array<string>, birth long, death long, place string")
    return df.join(parsed, df[text] == parsed["x"], "left").drop("x")


def sides(authorities: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a: authority look-ups; c: answers of the linker with their id."""
    a = authorities.where("texto_norm is not null").groupBy("texto_norm", "categoria").agg(F.max("wikidata_lbl").alias("label"), F.max("descripcion").alias("about"))
    a = a.select(F.xxhash64(F.lit("a"), "texto_norm", "categoria").alias("a"), "*")
    got = F.from_json("resultado", "id string, label string, description string")
    c = cache.where("texto is not null and resultado is not null").select("texto", "categoria", got.alias("r")).where("r is not null")
    c = c.groupBy("texto", "categoria").agg(F.max("r.id").alias("qid"), F.max("r.label").alias("label"), F.max("r.description").alias("about"))
    row = F.xxhash64(F.lit("c"), "texto", "categoria")
    c = c.select(row.alias("c"), "*").withColumn("qid", F.coalesce("qid", F.concat(F.lit("fila-"), F.col("c").cast("string"))))
    return described(a, "about"), described(c, "about")


def name_table(a: DataFrame, c: DataFrame, mentions: DataFrame) -> DataFrame:
    """(side, id, nombre, categoria): every name of each row, in its most plausible kind."""
    own = a.select(F.lit("a").alias("side"), F.col("a").alias("id"), "categoria", F.explode(F.array("texto_norm", "label")).alias("nombre"))
    own = own.unionByName(c.select(F.lit("c").alias("side"), F.col("c").alias("id"), "categoria", F.explode(F.array("texto", "label")).alias("nombre")))
    tied = authority_ids(mentions).join(c.select("qid", F.col("c").alias("id")), "qid").select(F.lit("c").alias("side"), "id", "categoria", "nombre")
    heads = r"(?i)^\W*(?:[\p{L}]{1,2}\.? |[\p{L}]+\.? (?:de |y |del |nacional))|\(|compa[nñ][ií]a|hermanos"
    kind = F.when(F.col("categoria").isin("personas", "organizaciones"), F.col("categoria")).otherwise(
        F.when(F.col("nombre").rlike(heads) & ~F.col("nombre").rlike(","), "organizaciones").otherwise("personas")
    )
    return own.unionByName(tied).where("nombre rlike '\\\\p{L}'").withColumn("categoria", kind).distinct()


def candidates(a: DataFrame, c: DataFrame, mentions: DataFrame) -> DataFrame:
    """(a, c, cost): pairs of rows with a common name or form; cost 0 for equal complete names."""
    names = materialise(name_table(a, c, mentions), "nombres")
    lex = learn(names.select("nombre", "categoria"))
    texts = names.select("nombre", "categoria", F.col("nombre").alias("texto"), F.lit(False).alias("alias")).distinct()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few, but each of some work
    rows = forms(texts.repartition(parts, "nombre"), lex).withColumn("k", F.xxhash64("categoria", "shape", "c", F.array_join("heads", "|")))
    rows = materialise(rows, "formas")
    parts = ["shape", "g", "s1", "s2", "heads"]
    keys = materialise(rows.groupBy("k").agg(*(F.min(x).alias(x) for x in ["categoria", "c", *parts]), F.max("own").alias("own")), "claves")
    near = segment_join(blocked(keys.where("own")).select(F.col("k").alias("l"), "b", "c"), blocked(keys).select(F.col("k").alias("r"), "b", "c"))
    near = near.join(keys.select(F.col("k").alias("l"), "shape", *(F.col(x).alias(f"l_{x}") for x in parts[1:])), "l")
    near = near.join(keys.select(F.col("k").alias("r"), *(F.col(x).alias(f"r_{x}") for x in parts[1:])), "r")
    known = rows.where("own and length(s2) > 1").groupBy(F.col("s2").alias("s")).agg(F.countDistinct("s1").alias("n")).where("n >= 4").select("s")
    near = materialise(_agree(known, near).select("l", "r", "d"), "cercanas")
    of = rows.join(names, ["nombre", "categoria"]).groupBy("side", "id", "k").agg(F.max("own").alias("own"))
    of = materialise(of, "filas")
    found = []
    for x, y in (("a", "c"), ("c", "a")):
        left = of.where((F.col("side") == x) & F.col("own")).select(F.col("id").alias(x), F.col("k").alias("l"))
        right = of.where(F.col("side") == y).select(F.col("id").alias(y), F.col("k").alias("r"), "own")
        found.append(left.join(near, "l").join(right, "r").select("a", "c", (F.col("d") + F.when(F.col("own"), 0.0).otherwise(1.5)).alias("cost")))
    return found[0].unionByName(found[1]).groupBy("a", "c").agg(F.min("cost").alias("cost"))


def _kind(a: Column, c: Column) -> Column:
    """The kind of entity of a candidate: the linker's, unless only the authority's is one that names are parsed by."""
    named = lambda x: x.isin("personas", "organizaciones")
    return F.when(named(a) & ~named(c), a).otherwise(c)


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(x, *(F.col(c).alias(f"{x}_{c}") for c in ("categoria", "words", "birth", "death", "place")))


def word_ties(pairs: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """(kind, wa, wc): words of the two sides that tell the same trade, by kind of entity.

    Counted over candidates whose years agree and whose other attributes don't differ: such pairs nearly always
    match, whatever the words. Rare words tell the same as themselves from the start.
    """
    p = pairs.join(_side(a, "a"), "a").join(_side(c, "c"), "c")
    differ = [F.coalesce(F.abs(F.col(f"a_{x}") - F.col(f"c_{x}")) > 0, F.lit(False)) for x in ("birth", "death")]
    differ.append(F.coalesce(F.levenshtein("a_place", "c_place", 2) < 0, F.lit(False)))
    same = (F.col("a_birth") == F.col("c_birth")) | (F.col("a_death") == F.col("c_death"))
    sure = p.where(same & ~differ[0] & ~differ[1] & ~differ[2]).select(_kind(F.col("a_categoria"), F.col("c_categoria")).alias("kind"), "a_words", "c_words")
    sure = materialise(sure.where("size(a_words) > 0 and size(c_words) > 0"), "seguras")
    one = lambda side, w: sure.select("kind", F.explode(side).alias(w)).groupBy("kind", w).agg(F.count(F.lit(1)).cast("double").alias(f"n_{w}"))
    both = sure.select("kind", F.explode("a_words").alias("wa"), "c_words").select("kind", "wa", F.explode("c_words").alias("wc"))
    both = both.groupBy("kind", "wa", "wc").agg(F.count(F.lit(1)).cast("double").alias("n")).where(F.col("n") >= TIES)
    size = sure.groupBy("kind").agg(F.count(F.lit(1)).cast("double").alias("size"))
    lift = F.col("n") * F.col("size") / (F.col("n_wa") * F.col("n_wc"))
    met = both.join(one("a_words", "wa"), ["kind", "wa"]).join(one("c_words", "wc"), ["kind", "wc"]).join(size, "kind").where(lift >= LIFT).select("kind", "wa", "wc")

    def rare(df: DataFrame) -> DataFrame:
        told = df.where("size(words) > 0").select(F.col("categoria").alias("kind"), "words")
        n = told.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
        seen = told.select("kind", F.explode("words").alias("wa")).groupBy("kind", "wa").agg(F.count(F.lit(1)).alias("n"))
        return seen.join(n, "kind").where(F.col("n") <= F.greatest(F.lit(1.0), F.col("size") * RARE)).select("kind", "wa")

    alike = rare(a).join(rare(c), ["kind", "wa"]).select("kind", "wa", F.col("wa").alias("wc"))
    return materialise(met.unionByName(alike).distinct(), "lazos")


def trades(pairs: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """(a, c, trade): 1 if a word of each side tells the same trade, 0 if both sides tell one and none is the same."""
    ties = word_ties(pairs, a, c)
    telling = {x: ties.select("kind", F.col(f"w{x}").alias("w")).distinct() for x in "ac"}

    def told(df: DataFrame, x: str) -> DataFrame:
        """The telling words of each row in each of the kinds of its candidates."""
        rows = kinds.select(F.col(x), "kind").distinct()
        words = rows.join(df.select(x, F.explode("words").alias("w")), x).join(telling[x], ["kind", "w"])
        return words.select(x, "kind", F.col("w").alias(f"w{x}"))

    both = pairs.join(a.select("a", F.col("categoria").alias("x")), "a").join(c.select("c", F.col("categoria").alias("y")), "c")
    kinds = materialise(both.select("a", "c", _kind(F.col("x"), F.col("y")).alias("kind")), "clases")
    left, right = materialise(told(a, "a"), "dichas"), materialise(told(c, "c"), "dichas")
    both = kinds.join(left.select("a", "kind").distinct(), ["a", "kind"]).join(right.select("c", "kind").distinct(), ["c", "kind"])
    met = both.join(left, ["a", "kind"]).join(ties, ["kind", "wa"]).join(right, ["c", "kind", "wc"])
    met = met.select("a", "c").distinct().withColumn("met", F.lit(1.0))
    return both.select("a", "c").join(met, ["a", "c"], "left").select("a", "c", F.coalesce("met", F.lit(0.0)).alias("trade"))


def vectors(pairs: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """(a, c, qid, FEATURES): similarities of the candidates, null where a side lacks the attribute."""
    pairs = materialise(pairs, "candidatas")
    p = pairs.join(_side(a, "a"), "a").join(_side(c, "c").join(c.select("c", "qid"), "c"), "c").join(trades(pairs, a, c), ["a", "c"], "left")

    def year(x: str) -> Column:
        gap = F.abs(F.col(f"a_{x}") - F.col(f"c_{x}"))
        return F.when(gap == 0, 1.0).when(gap == 1, 0.9).when(gap == 2, 0.6).when(gap.isNotNull(), 0.0)

    near = F.levenshtein("a_place", "c_place", 2)
    place = F.when(near >= 0, 1.0 - near * 0.1).when(near.isNotNull(), 0.0)
    return p.select("a", "c", "qid", F.exp(-F.col("cost") / 3).alias("name"), "trade", year("birth").alias("birth"), year("death").alias("death"), place.alias("place"))


def _ratio(model: dict) -> Column:
    """Log likelihood ratio of matched to unmatched, over the entries that are there."""

    def log(x: str, m: float, v: float) -> Column:
        return -0.5 * ((F.col(x) - m) * (F.col(x) - m) / v) - 0.5 * math.log(v)

    terms = [F.coalesce(log(x, *model[x][0]) - log(x, *model[x][1]), F.lit(0.0)) for x in FEATURES]
    return sum(terms[1:], terms[0])


def posteriors(v: DataFrame, model: dict) -> DataFrame:
    """v with p: rows of one id share their evidence, the ids of a row compete with each other and with none."""
    odds = math.log(model["pi"] / (1 - model["pi"]))
    scored = v.withColumn("llr", _ratio(model))
    by_id = scored.groupBy("a", "qid").agg(F.max("llr").alias("llr")).withColumn("e", F.exp(F.least(F.col("llr") + odds, F.lit(50.0))))
    total = by_id.groupBy("a").agg(F.sum("e").alias("total"))
    p = by_id.join(total, "a").select("a", "qid", (F.col("e") / (1 + F.col("total"))).alias("p"))
    return v.join(p, ["a", "qid"])


def fit(v: DataFrame) -> dict:
    """Expectation-maximisation from a rule: a candidate matches if most of its attributes agree."""
    parts = [F.col(x) for x in FEATURES[1:]]
    known = sum((x.isNotNull().cast("double") for x in parts), F.lit(0.0))
    agree = sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0))
    first = v.withColumn("p", F.when(known > 0, F.when(agree / known >= 0.6, 0.95).otherwise(0.05)).otherwise(F.col("name") * 0.6))
    model: dict = {}
    for step in range(STEPS):
        w = first if step == 0 else posteriors(v, model)
        sums = [F.avg("p").alias("pi")]
        for x in FEATURES:
            here = F.col(x).isNotNull()
            for k, q in enumerate((F.col("p"), 1 - F.col("p"))):
                sums += [F.sum(F.when(here, q)).alias(f"{x}{k}n"), F.sum(q * F.col(x)).alias(f"{x}{k}s"), F.sum(q * F.col(x) * F.col(x)).alias(f"{x}{k}q")]
        r = w.agg(*sums).first()
        if r["pi"] is None:
            return {}
        new: dict = {"pi": min(0.95, max(0.02, r["pi"]))}
        for x in FEATURES:
            new[x] = []
            for k in (0, 1):
                n = (r[f"{x}{k}n"] or 0.0) + 4 * PRIOR
                m = ((r[f"{x}{k}s"] or 0.0) + 4 * PRIOR * (0.9 if k == 0 else 0.3)) / n
                var = max(0.0, ((r[f"{x}{k}q"] or 0.0) + 4 * PRIOR * (0.81 if k == 0 else 0.2)) / n - m * m)
                new[x].append((m, var + FLOOR))
        moved = max([abs(new["pi"] - model["pi"])] + [abs(new[x][k][0] - model[x][k][0]) for x in FEATURES for k in (0, 1)]) if model else 1.0
        model = new
        if moved < 1e-3:
            break
    return model


def match(authorities: DataFrame, cache: DataFrame, mentions: DataFrame) -> DataFrame:
    """(texto_norm, categoria_aut, texto, categoria_cache, confianza) of all candidates."""
    a, c = sides(authorities, cache)
    a, c = materialise(a, "autoridades"), materialise(c, "cache")
    v = materialise(vectors(candidates(a, c, mentions), a, c), "vectores")
    model = fit(v)
    scored = posteriors(v, model) if model else v.withColumn("p", F.lit(0.0))
    out = scored.join(a.select("a", "texto_norm", F.col("categoria").alias("categoria_aut")), "a").join(c.select("c", "texto", F.col("categoria").alias("categoria_cache")), "c")
    return out.select("texto_norm", "categoria_aut", "texto", "categoria_cache", F.col("p").alias("confianza"))


def _tables(spark, sf_dir: str) -> DataFrame:
    return match(*(read(spark, sf_dir, t) for t in ("autoridades_cache", "cache_wikidata", "entidades")))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).where("confianza > 0.5").drop("confianza")


def p4_parejas(spark, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir)


QUERIES = {"p4_found": p4_found, "p4_parejas": p4_parejas}
SQL: dict[str, str] = {}
