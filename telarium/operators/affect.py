"""Lexicon measures of polarity, emotion, frames and subjectivity.

Every measure takes its words as an argument (a list, or lists by class). The lists here are small general ones of
Spanish, for use where there is none; `lexicon` makes such lists of a table (clase, termino).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMS = 20_000  # of a lexicon table that becomes part of a plan
POSITIVE = (
    "admirable alegre amable bello bella bueno buena célebre cordial digno digna elegante espléndido espléndida excelente famoso famosa feliz festivo festiva "
    "generoso generosa glorioso gloriosa grato grata hermoso hermosa ilustre justo justa luminoso luminosa magnífico magnífica mejor noble notable próspero "
    "próspera sabio sabia sereno serena triunfo útil valiente victoria virtuoso virtuosa"
).split()
NEGATIVE = (
    "absurdo absurda amargo amarga crisis cruel débil desastre dolor enfermo enferma error falso falsa feo fea fracasó fracaso grave helado helada horrible "
    "infeliz injusto injusta inútil lento lenta malo mala miserable miseria murió oscuro oscura peor pobre ruina ruinoso ruinosa severo severa sucio sucia "
    "temible terrible triste vicio violento violenta"
).split()
NEGATORS = ["no", "ni", "nunca", "sin", "jamás", "tampoco"]
# markers are beginnings of words
FRAMES = {
    "conflicto": ["huelga", "protest", "derrib", "guerra", "combat", "enfrent", "disput"],
    "cultura": ["teatr", "orquest", "novela", "poema", "pintur", "concierto", "libro"],
    "economia": ["pesos", "vendi", "mercado", "subast", "banco", "precio", "comerci", "export"],
    "educacion": ["escuela", "colegio", "maestr", "alumn", "universi", "enseñ"],
    "justicia": ["juez", "tribunal", "proceso", "sentenci", "delito", "cárcel", "abogad"],
    "moral": ["virtud", "vicio", "honor", "deber", "decencia", "pecado"],
    "politica": ["gobiern", "ministr", "congres", "elecci", "partido", "president", "alcald"],
    "progreso": ["ferrocarril", "tranv", "linotipia", "inaugur", "moderno", "electric", "industri"],
    "religion": ["iglesia", "obispo", "misa", "fieles", "párroco", "santo"],
    "salud": ["médico", "hospital", "epidemia", "enferm", "higiene", "vacuna"],
}
EMOTIONS = {
    "alegria": ["alegre", "alegría", "festivo", "festiva", "bailó", "cantó", "feliz", "risa"],
    "anticipacion": ["espera", "esperaba", "mañana", "pronto", "prepara", "anuncia"],
    "asco": ["asco", "sucio", "sucia", "inmundo", "inmunda", "podrido"],
    "confianza": ["amigo", "amiga", "fiel", "seguro", "segura", "leal", "confianza"],
    "ira": ["ira", "furia", "furioso", "furiosa", "indignado", "indignada", "protesta"],
    "miedo": ["miedo", "temor", "tembló", "oscuro", "oscura", "temible", "terror"],
    "sorpresa": ["apareció", "extraño", "extraña", "asombro", "inesperado", "inesperada", "sorpresa"],
    "tristeza": ["triste", "tristeza", "murió", "naufragó", "llanto", "luto", "pena"],
}
SUBJECTIVE = ["admirable", "acaso", "bello", "bella", "célebre", "creo", "elegante", "felizmente", "hermoso", "hermosa", "inútil", "parece", "quizá", "quizás", "triste"]
FACTUAL = ["año", "dijo", "inauguró", "kilómetros", "metros", "número", "pesos", "publicó", "según", "vendieron"]


def lexicon(table: DataFrame) -> dict[str, list[str]]:
    """Lists of terms by class of a table (clase, termino); at most TERMS rows, as they become part of the plan."""
    rows = table.select("clase", F.lower(F.trim("termino")).alias("termino")).where("clase is not null and termino <> ''").distinct().limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError("a lexicon of more terms than a plan should hold; join it instead")
    found: dict[str, list[str]] = {}
    for r in sorted(rows):
        found.setdefault(r["clase"], []).append(r["termino"])
    return found


def polarity(docs: DataFrame, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE, negators: list[str] = NEGATORS) -> DataFrame:
    """F10 over words `w`: positive and negative words, turned by a negator among the three before; density is their share."""
    negated = lambda i: F.arrays_overlap(F.slice("w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), F.array(*map(F.lit, negators)))
    value = F.transform(
        "w",
        lambda x, i: F.when(x.isin(positive), F.when((i > 0) & negated(i), -1).otherwise(1)).when(x.isin(negative), F.when((i > 0) & negated(i), 1).otherwise(-1)).otherwise(0),
    )
    x = docs.withColumn("v", value)
    n = lambda k: F.size(F.filter("v", lambda y: y == k)).cast("long")
    x = x.select(*[c for c in docs.columns if c != "w"], n(1).alias("pos"), n(-1).alias("neg"), F.size("w").alias("n"))
    both = F.col("pos") + F.col("neg")
    x = x.withColumn("densidad", F.round(F.coalesce(both / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 4)).drop("n")
    score = F.round(F.when(both > 0, (F.col("pos") - F.col("neg")) / both).otherwise(0.0), 3)
    return x.withColumn("puntaje", score).withColumn("etiqueta", F.when(F.col("pos") > F.col("neg"), "positivo").when(F.col("neg") > F.col("pos"), "negativo").otherwise("neutro"))


def around(docs: DataFrame, word: str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> DataFrame:
    """(doc_id, menciones, pos, neg) of the windows around a word."""
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: F.element_at("w", i) == word)
    window = lambda i: F.slice("w", F.greatest(i - 25, F.lit(1)), i + 24 - F.greatest(i - 25, F.lit(1)) + 1)
    x = docs.where(F.array_contains("w", word)).select("doc_id", F.transform(at, window).alias("v"))
    n = lambda ws: F.aggregate("v", F.lit(0).cast("long"), lambda a, y: a + F.size(F.filter(y, lambda z: z.isin(ws))))
    return x.select("doc_id", F.size("v").cast("long").alias("menciones"), n(positive).alias("pos"), n(negative).alias("neg"))


def _dominant(docs: DataFrame, values: dict[str, Column], none: str) -> DataFrame:
    """Adds k and n (the class with most hits, the first of equals), total, and up to three classes with hits in order."""
    pairs = F.array_sort(F.array(*(F.struct((-n).alias("m"), F.lit(k).alias("k")) for k, n in values.items())))
    x = docs.select(*[c for c in docs.columns if c != "w"], pairs.alias("p"))
    best, m = F.get("p", F.lit(0)), F.get("p", F.lit(0))["m"]
    some = F.transform(F.slice(F.filter("p", lambda y: y["m"] < 0), 1, 3), lambda y: y["k"])
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, y: a - y["m"])
    return x.select("*", F.when(m < 0, best["k"]).otherwise(none).alias("k"), (-m).alias("n"), total.alias("total"), F.array_join(some, ", ").alias("primeros")).drop("p")


def frames(docs: DataFrame, markers: dict[str, list[str]] = FRAMES) -> DataFrame:
    """hits of each frame's markers, which are beginnings of words; the dominant frame and the first three."""
    text = F.concat(F.lit(" "), F.array_join("w", " "))
    one = lambda m: F.regexp_count(text, F.lit(f" {m}"))
    values = {f: sum((one(m) for m in ms[1:]), one(ms[0])) for f, ms in markers.items()}
    x = _dominant(docs, values, "ninguno").withColumnRenamed("k", "marco").withColumnRenamed("n", "marcas")
    return x.withColumn("pct", F.round(F.when(F.col("total") > 0, F.col("marcas") * 100.0 / F.col("total")).otherwise(0.0), 1))


def emotions(docs: DataFrame, words: dict[str, list[str]] = EMOTIONS) -> DataFrame:
    """the emotion with most words and its share, and the first three."""
    one = lambda ws: F.size(F.filter("w", lambda y: y.isin(ws)))
    x = _dominant(docs, {e: one(ws) for e, ws in words.items()}, "ninguna")
    pct = F.round(F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0), 1)
    return x.select("doc_id", F.col("k").alias("dominante"), F.col("total").cast("long").alias("total"), pct.alias("pct"), "primeros")


def subjectivity(docs: DataFrame, subjective: list[str] = SUBJECTIVE, factual: list[str] = FACTUAL) -> DataFrame:
    """sentences over 20 characters; subjective if such words outnumber factual ones."""
    s = F.filter(F.split(F.lower("text"), "[.!?]+"), lambda x: F.length(F.trim(x)) > 20)
    words = lambda x: F.regexp_extract_all(x, F.lit(r"(\p{L}+)"), 1)
    n = lambda x, ws: F.size(F.filter(words(x), lambda y: y.isin(ws)))
    t = docs.select("doc_id", s.alias("s"))
    hits = F.size(F.filter("s", lambda x: n(x, subjective) > n(x, factual)))
    return t.select("doc_id", F.size("s").alias("oraciones"), F.round(F.when(F.size("s") > 0, hits / F.size("s")).otherwise(0.0), 3).alias("subjetividad"))


def intensity(c: Column) -> Column:
    """capped sums of superlatives, exclamations, quantifiers and repeated marks."""
    low = F.lower(c)
    few = lambda n: F.least(n, F.lit(5))
    quantifiers = F.size(F.filter(F.regexp_extract_all(low, F.lit(r"(\p{L}+)"), 1), lambda y: y.isin("todo", "nunca", "siempre", "jamás")))
    total = 0.1 * few(F.regexp_count(low, F.lit(r"\p{L}+ísim[oa]"))) + 0.05 * few(F.regexp_count(c, F.lit("!"))) + 0.08 * few(quantifiers) + F.when(c.rlike("[!?]{2}"), 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), total), 3)


def shares(df: DataFrame, period: str, label: str) -> DataFrame:
    """Count and share of each label in each period."""
    c = df.groupBy(period, label).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(period).agg(F.sum("n").alias("total"))
    return c.join(total, period).select(period, label, "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))
