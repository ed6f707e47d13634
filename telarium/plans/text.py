"""Queries of text cleaning, page and line rules, and quality of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import cleaning as C
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

# Words of one or two letters that are no fragments.
SHORT_OK = ["a", "y", "o", "e", "u", "de", "la", "el", "en", "un", "es", "se", "no", "lo", "al", "su", "si", "ya", "me", "te", "le", "mi", "tu", "ni", "os", "da", "va", "ha", "he", "fe", "ver", "df"]
_SHORT = ", ".join(f"'{w}'" for w in SHORT_OK)
_LAST = "(select arg_max(texto_crudo, id) as t, articulo_id from ocr where texto_crudo is not null group by articulo_id)"


def latest(ocr: DataFrame) -> DataFrame:
    """The last recognised text of each article."""
    return ocr.where("texto_crudo is not null").groupBy("articulo_id").agg(F.max_by("texto_crudo", "id").alias("t"))


@q("w14_latest_text", f"select articulo_id, t as texto from {_LAST}", "ocr")
def latest_text(ocr: DataFrame) -> DataFrame:
    return latest(ocr).withColumnRenamed("t", "texto")


_METRICS = rf"""m as (select id, articulo_id, len(x) as tokens, len(list_filter(x, lambda w: length(w) > 16)) as fundidas,
  len(list_filter(x, lambda w: length(w) <= 2 and w not in ({_SHORT}))) as fragmentos
  from (select id, articulo_id, regexp_extract_all(lower(coalesce(texto_crudo, '')), '\p{{L}}+') as x from ocr))"""
_VERDICT = """case when tokens < 200 then 'revisar' when fragmentos * 100.0 / tokens >= 20 then 'no_utilizable' when fragmentos * 100.0 / tokens >= 10 then 'revisar' when fundidas * 100.0 / tokens >= 1 then 'revisar' else 'utilizable' end"""


def metrics(ocr: DataFrame) -> DataFrame:
    x = F.regexp_extract_all(F.lower(F.coalesce("texto_crudo", F.lit(""))), F.lit(r"(\p{L}+)"), 1)
    t = ocr.select("id", "articulo_id", x.alias("x"))
    return t.select("id", "articulo_id", F.size("x").alias("tokens"), F.size(F.filter("x", lambda w: F.length(w) > 16)).alias("fundidas"), F.size(F.filter("x", lambda w: (F.length(w) <= 2) & ~w.isin(SHORT_OK))).alias("fragmentos"))


def verdict() -> Column:
    """Too little text, fragments, fused words."""
    share = lambda c: F.col(c) * 100.0 / F.nullif(F.col("tokens"), F.lit(0))
    return F.when(F.col("tokens") < 200, "revisar").when(share("fragmentos") >= 20, "no_utilizable").when((share("fragmentos") >= 10) | (share("fundidas") >= 1), "revisar").otherwise("utilizable")


@q("a35_quality_metrics", f"with {_METRICS} select * from m", "ocr")
def quality_metrics(ocr: DataFrame) -> DataFrame:
    return metrics(ocr)


@q("a36_verdict", f"with {_METRICS} select id, {_VERDICT} as veredicto from m", "ocr")
def page_verdict(ocr: DataFrame) -> DataFrame:
    return metrics(ocr).select("id", verdict().alias("veredicto"))


@q("a37_group_verdict", f"with {_METRICS}, g as (select articulo_id, sum(tokens) as tokens, sum(fundidas) as fundidas, sum(fragmentos) as fragmentos from m group by 1) select articulo_id, tokens, {_VERDICT} as veredicto from g", "ocr")
def group_verdict(ocr: DataFrame) -> DataFrame:
    """Raw counts are summed before the shares (micro average)."""
    g = metrics(ocr).groupBy("articulo_id").agg(*(F.sum(c).alias(c) for c in ("tokens", "fundidas", "fragmentos")))
    return g.select("articulo_id", "tokens", verdict().alias("veredicto"))


@q("a38_corpus_confidence", "with c as (select case when coalesce(confianza, 0) = 0 then 0.5 else confianza end + case when coalesce(texto_limpio, '') <> '' then 0.15 else 0 end as c0 from ocr), d as (select least(1, c0) as c from c) select count(*) as paginas, round(avg(c), 4) as media, sum((c >= 0.75)::int) as verde, sum((c >= 0.45 and c < 0.75)::int) as amarillo, sum((c < 0.45)::int) as rojo from d", "ocr")
def corpus_confidence(ocr: DataFrame) -> DataFrame:
    """Half where confidence is missing or zero, more where a cleaned layer exists."""
    c = F.when(F.coalesce("confianza", F.lit(0.0)) == 0, 0.5).otherwise(F.col("confianza")) + F.when(F.coalesce("texto_limpio", F.lit("")) != "", 0.15).otherwise(0.0)
    x = ocr.select(F.least(F.lit(1.0), c).alias("c"))
    n = lambda p: F.coalesce(F.sum(p.cast("int")), F.lit(0))
    return x.agg(F.count(F.lit(1)).alias("paginas"), F.round(F.avg("c"), 4).alias("media"), n(F.col("c") >= 0.75).alias("verde"), n((F.col("c") >= 0.45) & (F.col("c") < 0.75)).alias("amarillo"), n(F.col("c") < 0.45).alias("rojo"))


@q("pf14_traffic_light", "select id, case when confianza >= 0.75 then 'verde' when confianza >= 0.45 then 'amarillo' else 'rojo' end as nivel from ocr", "ocr")
def traffic_light(ocr: DataFrame) -> DataFrame:
    return ocr.select("id", C.level(F.col("confianza")).alias("nivel"))


@q("pf15_review_flag", "select id, coalesce(confianza < 0.6, false) or coalesce(version_motor = '1', false) as revisar from ocr", "ocr")
def review_flag(ocr: DataFrame) -> DataFrame:
    return ocr.select("id", (F.coalesce(F.col("confianza") < 0.6, F.lit(False)) | F.coalesce(F.col("version_motor") == "1", F.lit(False))).alias("revisar"))


@q("pf12_page_warnings", "with w as (select id, unnest(list_filter([case when coalesce(trim(texto_crudo), '') = '' then 'vacia' end, case when confianza < 0.3 then 'confianza' end, case when confianza is null then 'sin confianza' end, case when length(texto_crudo) < 300 then 'corta' end], lambda x: x is not null)) as aviso from ocr) select * from w", "ocr")
def warnings(ocr: DataFrame) -> DataFrame:
    found = F.array_compact(F.array(F.when(F.trim(F.coalesce("texto_crudo", F.lit(""))) == "", "vacia"), F.when(F.col("confianza") < 0.3, "confianza"), F.when(F.col("confianza").isNull(), "sin confianza"), F.when(F.length("texto_crudo") < 300, "corta")))
    return ocr.select("id", F.explode(found).alias("aviso"))


@q("pf13_empty_pages", r"select doc_id from documents where length(regexp_replace(lower(coalesce(text, '')), '[^a-záéíóúüñ]', '', 'g')) <= 2", "documents")
def empty_pages(docs: DataFrame) -> DataFrame:
    return docs.where(F.length(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), f"[^{T.LETTERS}]", "")) <= 2).select("doc_id")


@q("pf11_second_opinion", "select id, case when confianza is null then 'sin confianza' when confianza < 0.6 then 'confianza' when length(texto_crudo) < 400 then 'texto corto' end as motivo from ocr where confianza is null or confianza < 0.6 or length(texto_crudo) < 400", "ocr")
def second_opinion(ocr: DataFrame) -> DataFrame:
    why = F.when(F.col("confianza").isNull(), "sin confianza").when(F.col("confianza") < 0.6, "confianza").when(F.length("texto_crudo") < 400, "texto corto")
    return ocr.select("id", why.alias("motivo")).where("motivo is not null")


@q("pf1_minimum_length_filter", r"select doc_id, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) as palabras from documents where text is not null and trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' and len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) >= 100", "documents")
def minimum_length(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.space_count(F.col("text")).alias("palabras")).where("palabras >= 100")


@q("f5_spacing", r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as texto from documents where text is not null", "documents")
def spacing(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", C.spacing(F.col("text")).alias("texto"))


@q("f6_coordinate_lines", r"select id, regexp_replace(texto_crudo, '(?m)^[ \t]*\d{1,8}(?:[ \t]+\d{1,8}){0,5}[ \t]*$', '', 'g') as texto from ocr where texto_crudo is not null", "ocr")
def coordinates(ocr: DataFrame) -> DataFrame:
    return ocr.where("texto_crudo is not null").select("id", F.regexp_replace("texto_crudo", r"(?m)^[ \t]*\d{1,8}(?:[ \t]+\d{1,8}){0,5}[ \t]*$", "").alias("texto"))


_PRE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(texto_crudo, '([\p{L}])[-¬]\n([\p{L}])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '(?m)^ ?\d{1,3} ?$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@q("f9_page_preclean", f"select id, {_PRE} as texto from ocr where texto_crudo is not null", "ocr")
def preclean(ocr: DataFrame) -> DataFrame:
    return ocr.where("texto_crudo is not null").select("id", C.preclean(F.col("texto_crudo")).alias("texto"))


@q("f8_corpus_dictionary", r"select w, count(*) as n from (select unnest(regexp_extract_all(lower(texto_limpio), '\p{L}{4,}')) as w from ocr where texto_limpio is not null) group by w having count(*) >= 5", "ocr")
def dictionary(ocr: DataFrame) -> DataFrame:
    return C.dictionary(ocr, "texto_limpio", 5)


@q("f7_suspicious_words", r"""with d as (select w from (select unnest(regexp_extract_all(lower(texto_limpio), '\p{L}{4,}')) as w from ocr where texto_limpio is not null) group by w having count(*) >= 5),
t as (select id, unnest(regexp_extract_all(lower(texto_crudo), '\p{L}{4,}')) as w from ocr where texto_crudo is not null)
select id, w, count(*) as veces from t anti join d using (w) group by 1, 2""", "ocr")
def suspicious(ocr: DataFrame) -> DataFrame:
    """Words of four letters that the corpus has fewer than five times; the size of the dictionary decides its join."""
    t = ocr.where("texto_crudo is not null").select("id", F.explode(F.regexp_extract_all(F.lower("texto_crudo"), F.lit(r"(\p{L}{4,})"), 1)).alias("w"))
    seen = t.groupBy("id", "w").agg(F.count(F.lit(1)).alias("veces"))
    return seen.join(C.dictionary(ocr, "texto_limpio", 5).select("w"), "w", "left_anti").select("id", "w", "veces")


@q("f4_ocr_normalise", r"select id, regexp_replace(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(texto_crudo, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '([\p{L}])[-¬]\n([\p{Ll}])', '\1\2', 'g'), '([\p{L}])0([\p{L}])', '\1o\2', 'g'), 'ﬁ‘’“”', 'f''''\"\"'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as texto from ocr where texto_crudo is not null", "ocr")
def normalise(ocr: DataFrame) -> DataFrame:
    """Controls, hyphens, characters, digits in words, spaces, in this order."""
    return ocr.where("texto_crudo is not null").select("id", C.normalise(F.col("texto_crudo")).alias("texto"))


# Old spellings of whole words and their present ones; a table of one's own may take its place.
SPELLINGS = {"fué": "fue", "fuí": "fui", "dió": "dio", "vió": "vio", "á": "a", "ó": "o", "é": "e", "ú": "u", "quizá": "quizás", "obscuro": "oscuro", "obscura": "oscura", "substituir": "sustituir"}


def _nested(c: str, rules: dict[str, str]) -> str:
    for old, new in rules.items():
        c = rf"regexp_replace(regexp_replace({c}, '(^|[^\p{{L}}]){old}([^\p{{L}}]|$)', '\1{new}\2', 'g'), '(^|[^\p{{L}}]){old}([^\p{{L}}]|$)', '\1{new}\2', 'g')"
    return c


@q("f17_historical_spelling", f"select doc_id, {_nested('lower(text)', SPELLINGS)} as texto from documents where text is not null", "documents")
def spelling(docs: DataFrame) -> DataFrame:
    """Whole words only: what merely holds an old form keeps its letters."""
    return docs.where("text is not null").select("doc_id", C.respell(F.lower("text"), SPELLINGS).alias("texto"))


# Irregular forms and their lemmas, for use where there is no table of one's own.
LEMMAS = {
    "anduvo": "andar", "cantó": "cantar", "condujo": "conducir", "cupo": "caber", "dijeron": "decir", "dijo": "decir", "dio": "dar", "estuvo": "estar", "fueron": "ser",
    "había": "haber", "hizo": "hacer", "hubo": "haber", "pesos": "peso", "pudo": "poder", "puso": "poner", "quiso": "querer", "supo": "saber", "trajo": "traer", "tuvo": "tener",
    "vendieron": "vender", "vino": "venir", "vio": "ver",
}


@q("f18_lemmas", rf"""with t as (select doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) as w from documents where text is not null)
select coalesce(m.lema, t.w) as lema, case when m.lema is null then 'original' else 'excepcion' end as origen, count(*) as n from t left join (values {", ".join(f"('{k}', '{v}')" for k, v in LEMMAS.items())}) m(w, lema) using (w) group by 1, 2""", "documents")
def lemmas(docs: DataFrame) -> DataFrame:
    """The table of irregular forms, else the word itself, counted by lemma and origin."""
    t = docs.where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("w"))
    return C.lemmatise(t.groupBy("w").agg(F.count(F.lit(1)).alias("k")), LEMMAS).groupBy("lema", "origen").agg(F.sum("k").alias("n"))


@q("f47_alphabetic_ratio", r"select doc_id, round(length(regexp_replace(text, '[^\p{L} ]', '', 'g')) / length(text), 4) as razon from documents where length(text) > 0", "documents")
def alphabetic(docs: DataFrame) -> DataFrame:
    return docs.where("length(text) > 0").select("doc_id", F.round(T.alphabetic_ratio(F.col("text")), 4).alias("razon"))


@q("pf10_junk_lines", r"""select id, array_to_string(list_filter(string_split(texto_crudo, chr(10)), lambda l: not (contains(lower(l), 'copia digital') or contains(lower(l), 'reproducción digital')) and not (length(l) > 5 and length(regexp_replace(l, '[^\p{L}]', '', 'g')) / length(l) < 0.3)), chr(10)) as texto from ocr where texto_crudo is not null""", "ocr")
def junk_lines(ocr: DataFrame) -> DataFrame:
    return ocr.where("texto_crudo is not null").select("id", C.clean_lines(F.col("texto_crudo")).alias("texto"))


_PAGE = r"""case when n < 20 then 'vacia' when regexp_matches(low, '\b(director|redactor)\b[^\n]{0,40}\b(administrador|gerente)\b') then 'creditos' when len(l) >= 5 and len(list_filter(l, lambda x: regexp_matches(x, '\d+\s*$'))) >= 0.3 * len(l) then 'indice' when len(regexp_extract_all(low, 'pesos')) >= 4 then 'anuncios' else 'normal' end"""


@q("pf6_page_type", r"with x as (select id, lower(texto_crudo) as low, list_filter(string_split(texto_crudo, chr(10)), lambda y: trim(y) <> '') as l, len(regexp_extract_all(texto_crudo, '[\p{L}\p{N}]+')) as n from ocr where texto_crudo is not null) select id, " + _PAGE + " as tipo from x", "ocr")
def page_type(ocr: DataFrame) -> DataFrame:
    """Ordered rules: nearly empty, credits, index, advertisements."""
    return ocr.where("texto_crudo is not null").select("id", C.page_type(F.col("texto_crudo")).alias("tipo"))


_SECTIONS = {"Espectáculos": "teatro|zarzuela|comedia", "Economía": "pesos|mercado|subasta", "Letras": "poema|novela|ensayo"}


@q("pf7_section_detector", r"with x as (select doc_id, lower(substr(text, 1, 500)) as t, regexp_extract_all(lower(substr(text, 1, 500)), '[\p{L}]+') as w from documents where text is not null) select doc_id, case " + " ".join(f"when len(list_filter(w, lambda y: y in ({', '.join(repr(z) for z in p.split('|'))}))) > 0 then '{s}'" for s, p in _SECTIONS.items()) + " else 'General' end as seccion from x", "documents")
def section(docs: DataFrame) -> DataFrame:
    """The first section with a word in the first five hundred characters, which is part of the rule."""
    w = F.regexp_extract_all(F.lower(F.substring("text", 1, 500)), F.lit(r"([\p{L}]+)"), 1)
    has = lambda names: F.exists(w, lambda y: y.isin(names))
    found = F.coalesce(*[F.when(has(p.split("|")), s) for s, p in _SECTIONS.items()], F.lit("General"))
    return docs.where("text is not null").select("doc_id", found.alias("seccion"))


_AUTHOR = r"regexp_extract(substr(text, 1, 800), '(?:^|\n| )Por ((?:\p{Lu}\p{Ll}+ ){1,3}\p{Lu}\p{Ll}+)', 1)"


@q("pf8_author_extraction", f"select doc_id, case when {_AUTHOR} <> '' then {_AUTHOR} else 'anónimo' end as autor, case when {_AUTHOR} <> '' then 0.92 else 0.0 end as confianza from documents where text is not null", "documents")
def author(docs: DataFrame) -> DataFrame:
    """The by-line in the first eight hundred characters, which is part of the rule."""
    a = F.regexp_extract(F.substring("text", 1, 800), r"(?:^|\n| )Por ((?:\p{Lu}\p{Ll}+ ){1,3}\p{Lu}\p{Ll}+)", 1)
    return docs.where("text is not null").select("doc_id", F.when(a != "", a).otherwise("anónimo").alias("autor"), F.when(a != "", 0.92).otherwise(0.0).alias("confianza"))


_CAPS = r"len(list_filter(regexp_extract_all(l, '\p{L}{3,}'), lambda w: w = upper(w)))"


@q("pf9_title_extraction", r"""with x as (select id, list_filter(list_transform(string_split(texto_crudo, chr(10)), lambda l: trim(l)), lambda l: l <> '')[1:30] as ls from ocr where texto_crudo is not null),
y as (select id, ls, list_filter(ls, lambda l: len(string_split(l, ' ')) between 2 and 12 and len(regexp_extract_all(l, '\p{L}{3,}')) > 0 and """ + _CAPS + r""" >= 0.7 * len(regexp_extract_all(l, '\p{L}{3,}'))) as caps, list_filter(ls[1:8], lambda l: regexp_matches(l, '^\p{Lu}') and not regexp_matches(l, '[.,;:]$')) as firsts from x)
select id, coalesce(caps[1], firsts[1], ls[1]) as titulo from y""", "ocr")
def title(ocr: DataFrame) -> DataFrame:
    """A line of capitals among the first thirty, else a capitalised line without final punctuation, else the first."""
    return ocr.where("texto_crudo is not null").select("id", C.title(F.col("texto_crudo")).alias("titulo"))


@q("pf20_epistemic_state", "select id, case when trim(coalesce(texto_limpio, '')) <> '' then 'limpio' when trim(coalesce(texto_crudo, '')) <> '' then 'crudo' else 'ninguno' end as estado from ocr", "ocr")
def epistemic(ocr: DataFrame) -> DataFrame:
    return ocr.select("id", C.state().alias("estado"))


@q("a47_review_progress", "with e as (select case when trim(coalesce(texto_limpio, '')) <> '' then 'limpio' when trim(coalesce(texto_crudo, '')) <> '' then 'crudo' else 'ninguno' end as estado from ocr) select estado, count(*) as n, round(count(*) * 100.0 / (select count(*) from e), 1) as pct from e group by estado", "ocr")
def progress(ocr: DataFrame) -> DataFrame:
    e = ocr.groupBy(C.state().alias("estado")).agg(F.count(F.lit(1)).alias("n"))
    total = e.agg(F.sum("n").alias("total"))
    return e.crossJoin(F.broadcast(total)).select("estado", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("pct"))  # one row


@q("f37_seam_fragments", r"""with l as (select id, string_split(texto_crudo, chr(10)) as ls from ocr where texto_crudo is not null), e as (select id, unnest(generate_series(1, len(ls) - 1)) as linea, ls from l)
select id, linea::int as linea, trim(ls[linea]) as izquierda, trim(ls[linea + 1]) as derecha from e where regexp_matches(ls[linea], '[-¬]\s*$') and regexp_matches(ls[linea + 1], '^\s*\p{Ll}')""", "ocr")
def seams(ocr: DataFrame) -> DataFrame:
    """Lines that end in a hyphen before a line in lower case; neighbours are taken in the list, without a window."""
    ls = F.split("texto_crudo", "\n")
    pairs = F.transform(F.sequence(F.lit(1), F.size(ls) - 1), lambda i: F.struct(i.alias("linea"), F.element_at(ls, i).alias("a"), F.element_at(ls, i + 1).alias("b")))
    x = ocr.where("texto_crudo is not null and instr(texto_crudo, '\n') > 0").select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    x = x.where(F.col("a").rlike(r"[-¬]\s*$") & F.col("b").rlike(r"^\s*\p{Ll}"))
    return x.select("id", "linea", F.trim("a").alias("izquierda"), F.trim("b").alias("derecha"))


_JOIN = r"regexp_replace({t}, '(\p{{L}})[-¬][ \t\r]*\n(?:[ \t\r]*\n){{0,4}}[ \t\r]*(\p{{L}})', '\1\2', 'g')"


@q("w10_hyphen_joining", f"select id, {_JOIN.format(t=_JOIN.format(t=_JOIN.format(t='texto_crudo')))} as texto from ocr where texto_crudo is not null", "ocr")
def hyphens(ocr: DataFrame) -> DataFrame:
    """Words rejoined over a line break, over up to four blank lines."""
    return ocr.where("texto_crudo is not null").select("id", C.join_hyphens(F.col("texto_crudo")).alias("texto"))


@q("w11_line_rebuild", None, "ocr")
def rebuild(ocr: DataFrame) -> DataFrame:
    """Broken lines folded into paragraphs."""
    return ocr.where("texto_crudo is not null").select("id", C.rebuild_lines(F.col("texto_crudo")).alias("texto"))


@q("f19_date_entities", r"select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\d{1,2} de (?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?: de \d{4})?'))), '; ') as fechas from documents where text is not null", "documents")
def dates(docs: DataFrame) -> DataFrame:
    months = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"(\d{{1,2}} de (?:{months})(?: de \d{{4}})?)"), 1)
    return docs.where("text is not null").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), "; ").alias("fechas"))


@q("f25_page_ranges", r"with x as (select id, regexp_extract_all(coalesce(pagina_inicio::varchar, '') || '-' || coalesce(pagina_fin::varchar, ''), '\d+') as d from articulos) select id, d[1]::bigint as desde, greatest(d[-1]::bigint, d[1]::bigint) as hasta from x where len(d) > 0", "articulos")
def page_ranges(arts: DataFrame) -> DataFrame:
    d = F.regexp_extract_all(F.concat(F.coalesce(F.col("pagina_inicio").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("pagina_fin").cast("string"), F.lit(""))), F.lit(r"(\d+)"), 1)
    x = arts.select("id", d.alias("d")).where("size(d) > 0")
    return x.select("id", F.element_at("d", 1).cast("long").alias("desde"), F.greatest(F.element_at("d", -1).cast("long"), F.element_at("d", 1).cast("long")).alias("hasta"))


@q("f39_year_normalise", r"select id, case when regexp_full_match(trim(fecha_publicacion), '\d{4}') then trim(fecha_publicacion) || '-01-01' when regexp_full_match(trim(fecha_publicacion), '\d{4}-\d{2}') then trim(fecha_publicacion) || '-01' when regexp_full_match(trim(fecha_publicacion), '\d{4}-\d{2}-\d{2}') then trim(fecha_publicacion) end as fecha from articulos", "articulos")
def year(arts: DataFrame) -> DataFrame:
    return arts.select("id", C.iso_date(F.col("fecha_publicacion")).alias("fecha"))


@q("f45_author_cleanup", "select id, case when autor is null or lower(trim(autor)) in ('', 'nan', 'none', 'null', 's/a', '-') then 'Anónimo' else trim(autor) end as autor from articulos", "articulos")
def author_cleanup(arts: DataFrame) -> DataFrame:
    return arts.select("id", F.when(F.col("autor").isNull() | F.lower(F.trim("autor")).isin("", "nan", "none", "null", "s/a", "-"), "Anónimo").otherwise(F.trim("autor")).alias("autor"))


@q("f24_issue_slug", r"select distinct numero, case when s = '' then 'sin_numero' else coalesce(s, 'sin_numero') end as slug from (select numero, trim(regexp_replace(strip_accents(lower(numero)), '[^a-z0-9]+', '_', 'g'), '_') as s from articulos)", "articulos")
def issue_slug(arts: DataFrame) -> DataFrame:
    return arts.select("numero").distinct().select("numero", T.slug(F.col("numero"), "_", "sin_numero").alias("slug"))


@q("f34_quotations", r"select doc_id, unnest(list_filter(list_concat(regexp_extract_all(text, '«([^«»]{20,500})»', 1), regexp_extract_all(text, '“([^“”]{20,500})”', 1)), lambda x: len(string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ')) >= 5)) as cita from documents where text is not null", "documents")
def quotations(docs: DataFrame) -> DataFrame:
    return C.quotations(docs)


@q("j5_shared_quotes", r"with c as (select doc_id, unnest(list_concat(regexp_extract_all(text, '«([^«»]{20,500})»', 1), regexp_extract_all(text, '“([^“”]{20,500})”', 1))) as cita from documents where text is not null) select cita, count(distinct doc_id) as documentos, min(doc_id) as primero from c where len(string_split(trim(regexp_replace(cita, '\s+', ' ', 'g')), ' ')) >= 5 group by cita having count(distinct doc_id) >= 2", "documents")
def shared_quotes(docs: DataFrame) -> DataFrame:
    g = C.quotations(docs).groupBy("cita").agg(F.countDistinct("doc_id").alias("documentos"), F.min("doc_id").alias("primero"))
    return g.where("documentos >= 2")


@q("f38_cost_estimate", "select doc_id, length(coalesce(text, '')) // 4 + 1 + 1600 as tokens, round((length(coalesce(text, '')) // 4 + 1 + 1600) * 3.0 / 1000000, 6) as costo from documents", "documents")
def cost(docs: DataFrame) -> DataFrame:
    n = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4) + 1 + 1600
    return docs.select("doc_id", n.alias("tokens"), F.round(n * 3.0 / 1000000, 6).alias("costo"))


@q("f43_json_repair", "select texto, categoria, json_extract_string(resultado, '$.id') as id, json_extract_string(resultado, '$.label') as label, try_cast(json_extract_string(resultado, '$.confianza') as double) as confianza from cache_wikidata where resultado is not null", "cache_wikidata")
def json_repair(cache: DataFrame) -> DataFrame:
    """Fences stripped, the outer object kept and parsed."""
    body = F.regexp_extract(F.regexp_replace("resultado", r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    r = F.from_json(body, "id string, label string, confianza double")
    return cache.where("resultado is not null").select("texto", "categoria", r.alias("r")).select("texto", "categoria", "r.id", "r.label", "r.confianza")


@q("f44_json_flatten", "select texto, categoria, json_extract_string(resultado, '$.label') || ': ' || coalesce(json_extract_string(resultado, '$.description'), '') as plano from cache_wikidata where resultado is not null", "cache_wikidata")
def json_flatten(cache: DataFrame) -> DataFrame:
    r = F.from_json("resultado", "label string, description string")
    return cache.where("resultado is not null").select("texto", "categoria", r.alias("r")).select("texto", "categoria", F.concat(F.col("r.label"), F.lit(": "), F.coalesce("r.description", F.lit(""))).alias("plano"))


_ONCE = r"regexp_replace({t}, '(^|[^\p{{L}}])orquesta([^\p{{L}}]|$)', '\1banda\2', 'g')"


@q("f33_whole_word_replace", f"select doc_id, {_ONCE.format(t=_ONCE.format(t='text'))} as texto from documents where contains(text, 'orquesta')", "documents")
def replace_word(docs: DataFrame) -> DataFrame:
    """All hits, neighbours that share a separator too."""
    return docs.where(F.col("text").contains("orquesta")).select("doc_id", C.replace_word(F.col("text"), "orquesta", "banda").alias("texto"))


@q("f33_replace_nth", r"select doc_id, regexp_replace(text, '^((?s:.*?)(?:^|[^\p{L}])orquesta(?:[^\p{L}](?s:.*?[^\p{L}])?))orquesta([^\p{L}]|$)', '\1banda\2') as texto from documents where contains(text, 'orquesta')", "documents")
def replace_nth(docs: DataFrame) -> DataFrame:
    """The second hit only."""
    return docs.where(F.col("text").contains("orquesta")).select("doc_id", C.replace_word(F.col("text"), "orquesta", "banda", 2).alias("texto"))


@q("s13_extraction_mode", r"with p as (select articulo_id, avg(length(texto_crudo)) as largo, sum(length(regexp_replace(texto_crudo, '[^\p{L}\p{N} \n]', '', 'g'))) / sum(length(texto_crudo)) as limpio from ocr where length(texto_crudo) > 0 group by 1) select articulo_id, case when largo < 80 then 'escaneado' when limpio < 0.5 then 'escaneado con ruido' else 'digital' end as modo, round(limpio, 4) as limpio from p", "ocr")
def mode(ocr: DataFrame) -> DataFrame:
    p = ocr.where("length(texto_crudo) > 0").groupBy("articulo_id").agg(F.avg(F.length("texto_crudo")).alias("largo"), (F.sum(F.length(F.regexp_replace("texto_crudo", r"[^\p{L}\p{N} \n]", ""))) / F.sum(F.length("texto_crudo"))).alias("limpio"))
    return p.select("articulo_id", F.when(F.col("largo") < 80, "escaneado").when(F.col("limpio") < 0.5, "escaneado con ruido").otherwise("digital").alias("modo"), F.round("limpio", 4).alias("limpio"))


@q("s11_page_census", r"select articulo_id, count(*) as paginas, sum(len(regexp_extract_all(coalesce(texto_crudo, ''), '[\p{L}\p{N}]+'))) as palabras from ocr group by 1", "ocr")
def census(ocr: DataFrame) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.coalesce("texto_crudo", F.lit("")), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return ocr.groupBy("articulo_id").agg(F.count(F.lit(1)).alias("paginas"), F.sum(n).alias("palabras"))


# Marks of old spelling inside words.
MARKERS = {
    "acento": "^(?:fué|fuí|vió|dió|á|ó|é|ú)$", "ph": "ph|th", "doble": "ss|cc?ç", "enclitico": "(?:ó|aba|ía|aron|ieron)(?:me|te|se|le|lo|la|les|los|las)$",
    "superlativo": "ísim[oa]s?$", "equis": "^(?:dixo|dexar|baxo|exército|xefe)",
}
_OLD = "(" + " + ".join([f"(y in ({', '.join(repr(k) for k in LEMMAS)}))::int", *(f"regexp_matches(y, '{m}')::int" for m in MARKERS.values())]) + ")"
_OLDW = rf"x as (select doc_id, list_filter(list_transform(regexp_extract_all(lower(text), '\p{{L}}+'), lambda y: {{'y': y, 'n': {_OLD}}}), lambda z: true) as w from documents where text is not null)"


def _old(y: Column) -> Column:
    return sum((y.rlike(m).cast("int") for m in MARKERS.values()), y.isin(list(LEMMAS)).cast("int"))


@q("f16_historical_density", f"with {_OLDW} select doc_id, round(least(1.0, list_sum(list_transform(w, lambda z: z.n)) / len(w)), 4) as densidad from x where len(w) > 0", "documents")
def historical(docs: DataFrame) -> DataFrame:
    """Irregular forms and marks of old spelling over words, one at most."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    x = docs.where("text is not null").select("doc_id", w.alias("w")).where("size(w) > 0")
    n = F.aggregate("w", F.lit(0), lambda a, y: a + _old(y))
    return x.select("doc_id", F.round(F.least(F.lit(1.0), n / F.size("w")), 4).alias("densidad"))


@q("a60_archaisms", f"with {_OLDW}, u as (select doc_id, len(w) as palabras, unnest(list_filter(w, lambda z: z.n > 0)) as z from x), f as (select doc_id, palabras, z.y as y, count(*) as k, sum(z.n) as n from u group by 1, 2, 3), r as (select *, row_number() over (partition by doc_id order by k desc, y) as p from f) select doc_id, sum(k)::bigint as arcaismos, any_value(palabras)::bigint as palabras, round(least(1.0, sum(n) / any_value(palabras)), 4) as puntaje, string_agg(y, ', ' order by p) filter (p <= 5) as formas from r group by 1", "documents")
def archaisms(docs: DataFrame) -> DataFrame:
    """Old forms of each text that has any: their number, the score and the five commonest."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    x = docs.where("text is not null").select("doc_id", w.alias("w")).select("doc_id", F.size("w").alias("palabras"), F.filter("w", lambda y: _old(y) > 0).alias("o"))
    kinds = F.transform(F.array_distinct("o"), lambda y: F.struct((-F.size(F.filter("o", lambda z: z == y))).alias("k"), y.alias("y")))
    n = F.aggregate("o", F.lit(0), lambda a, y: a + _old(y))
    best = F.array_join(F.transform(F.slice(F.array_sort(kinds), 1, 5), lambda z: z["y"]), ", ")
    return x.where("size(o) > 0").select("doc_id", F.size("o").cast("long").alias("arcaismos"), F.col("palabras").cast("long").alias("palabras"), F.round(F.least(F.lit(1.0), n / F.col("palabras")), 4).alias("puntaje"), best.alias("formas"))
