"""Queries of sources and export formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import entities as E
from telarium.operators import graph as G
from telarium.operators.sequence import zones
from telarium.plans.entities import _CAN, N
from telarium.plans.graph import _G, capped
from telarium.plans.registry import Plan
from telarium.session import materialise, read, table_path
from telarium.sources import files as S

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query


def s1_issue_text(spark, sf_dir: str) -> DataFrame:
    """Page texts written as text files by issue and scanned again."""
    path = table_path(spark, "paginas")
    read(spark, sf_dir, "documents").where("text is not null and publicacion is not null").select("publicacion", F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).repartition("publicacion").write.partitionBy("publicacion").text(path)
    return spark.read.text(path).groupBy("publicacion").agg(F.count(F.lit(1)).alias("paginas"), F.sum(F.length("value")).alias("letras"))


QUERIES["s1_issue_text"] = s1_issue_text
SQL["s1_issue_text"] = r"select publicacion, count(*) as paginas, sum(length(regexp_replace(text, '[\r\n]+', ' ', 'g'))) as letras from documents where text is not null and publicacion is not null group by 1"


def s8_project_scan(spark, sf_dir: str) -> DataFrame:
    """Projects as documents with their articles embedded, one a line, written and read again in their order."""
    path = table_path(spark, "proyecto")
    arts = read(spark, sf_dir, "articulos").groupBy("numero").agg(F.array_sort(F.collect_set(F.struct("id", F.coalesce("titulo", F.lit("")).alias("titulo")))).alias("articulos"))  # an issue's
    arts.write.json(path)
    found = S.project(spark, path, "numero string, articulos array<struct<id string, titulo string>>", lines=True)
    return found.select("numero", "posicion", "id", "titulo")


QUERIES["s8_project_scan"] = s8_project_scan
SQL["s8_project_scan"] = "select numero, (row_number() over (partition by numero order by id, titulo) - 1)::int as posicion, id, titulo from (select distinct numero, id, coalesce(titulo, '') as titulo from articulos)"


def s2_page_metadata(spark, sf_dir: str) -> DataFrame:
    """One row a page; what an earlier table (a CSV of half of the pages) tells of the method is kept."""
    ocr = read(spark, sf_dir, "ocr")
    path = table_path(spark, "meta")
    ocr.where("id % 2 = 0").select("id", F.concat_ws("/", "motor", "version_motor").alias("metodo")).write.csv(path, header=True)
    return S.page_metadata(ocr, spark.read.schema("id long, metodo string").csv(path, header=True))


QUERIES["s2_page_metadata"] = s2_page_metadata
SQL["s2_page_metadata"] = r"""select id, articulo_id, case when trim(coalesce(texto_crudo, ''), ' ') = '' then 0 else len(regexp_extract_all(texto_crudo, '[^\s]+')) end as palabras,
 coalesce(case when id % 2 = 0 then nullif(concat_ws('/', motor, version_motor), '') end, 'conversor') as metodo, coalesce(confianza < 0.6, false) as revisar from ocr"""


@q("s3_metadata_materialise", "select id, coalesce(try_cast(palabras as int), 0) as palabras from articulos", "articulos")
def materialised(arts: DataFrame) -> DataFrame:
    return arts.select("id", F.coalesce(F.col("palabras").cast("int"), F.lit(0)).alias("palabras"))


_STRIP = r"nullif(regexp_replace({c}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'), '')"


@q("s4_text_resolution", f"select id, coalesce({_STRIP.format(c='texto_limpio')}, {_STRIP.format(c='texto_crudo')}, '') as texto from ocr", "ocr")
def resolution(ocr: DataFrame) -> DataFrame:
    """The first layer that isn't blank."""
    one = lambda c: F.nullif(F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", ""), F.lit(""))
    return ocr.select("id", F.coalesce(one("texto_limpio"), one("texto_crudo"), F.lit("")).alias("texto"))


@q("s5_reference_corpora", "select coalesce(publicacion, 'principal') as corpus, count(*) as textos, sum(length(text)) as letras from documents where trim(text) <> '' group by 1", "documents")
def corpora(docs: DataFrame) -> DataFrame:
    d = docs.where(F.regexp_replace("text", r"[\s\x{00A0}]+", "") != "")
    return d.groupBy(F.coalesce("publicacion", F.lit("principal")).alias("corpus")).agg(F.count(F.lit(1)).alias("textos"), F.sum(F.length("text")).alias("letras"))


@q("s6_article_scan", "select id, numero, pagina_inicio, titulo from articulos where estado = 'revisado'", "articulos")
def article_scan(arts: DataFrame) -> DataFrame:
    return arts.where("estado = 'revisado'").select("id", "numero", "pagina_inicio", "titulo")


@q("s10_migration", r"select id, case when autor is null or lower(trim(autor)) in ('', 'nan') then 'Anónimo' else trim(autor) end as autor, max(coalesce(modificado, timestamp '1900-01-01')) as modificado from articulos group by 1, 2", "articulos")
def migration(arts: DataFrame) -> DataFrame:
    """Idempotent load: one row an id and author."""
    a = F.when(F.col("autor").isNull() | F.lower(F.trim("autor")).isin("", "nan"), "Anónimo").otherwise(F.trim("autor"))
    return arts.groupBy("id", a.alias("autor")).agg(F.max(F.coalesce("modificado", F.lit("1900-01-01").cast("timestamp_ntz"))).alias("modificado"))


def web(docs: DataFrame) -> DataFrame:
    """Web records made of the documents' fields."""
    esc = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title> "), esc("publicacion"), F.lit('</title><meta name="DC.Language" content="'), esc("lang"), F.lit('"><meta content="'), esc("anio"), F.lit('" name="dc.date"></head></html>'))
    return docs.select("doc_id", html.alias("html"))


@q("s16_html_metadata", "select doc_id, publicacion as titulo, null::varchar as autor, anio::varchar as fecha, lang as lengua from documents", "documents")
def html_metadata(docs: DataFrame) -> DataFrame:
    return S.metadata(web(docs), "html")


@q("s17_meta_tags", "select doc_id, 2 as n, coalesce(lang, '') as lengua from documents", "documents")
def meta_tags(docs: DataFrame) -> DataFrame:
    return web(docs).withColumn("m", S.meta_tags(F.col("html"))).select("doc_id", F.size("m").alias("n"), F.try_element_at("m", F.lit("dc.language")).alias("lengua"))


@q("s15_metadata_precedence", "select doc_id, case when doc_id % 3 = 0 then publicacion || ' oai' when doc_id % 2 = 0 then publicacion || ' ld' else nullif(publicacion, '') end as titulo, case when doc_id % 2 = 0 then source else null end as autor, case when doc_id % 2 = 0 then anio::varchar || '-05' else anio::varchar end as fecha, case when doc_id % 3 = 0 then 'oai' when doc_id % 2 = 0 then 'json-ld' else 'html' end as origen from documents where publicacion is not null and anio is not null", "documents")
def metadata_precedence(docs: DataFrame) -> DataFrame:
    """Records in three notations: a harvested record wins over linked data, and these over the page's own tags."""
    x = docs.where("publicacion is not null and anio is not null")
    oai = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<record><metadata><oai_dc:dc><dc:title>"), _xml(F.col("publicacion")), F.lit(" oai</dc:title></oai_dc:dc></metadata></record>")))
    ld = F.to_json(F.struct(F.concat("publicacion", F.lit(" ld")).alias("name"), F.struct(F.col("source").alias("name")).alias("author"), F.concat(F.col("anio").cast("string"), F.lit("-05")).alias("datePublished")))
    script = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).otherwise("")
    html = F.concat(F.lit("<html><head><title>"), _xml(F.col("publicacion")), F.lit('</title><meta name=date content='), F.col("anio").cast("string"), F.lit(">"), script, F.lit("</head></html>"))
    return S.by_precedence(x.select("doc_id", oai.alias("oai"), html.alias("html")), "oai", "html")


@q("s18_html_cleaning", "select doc_id, coalesce(publicacion, '') as texto from documents", "documents")
def cleaning(docs: DataFrame) -> DataFrame:
    return web(docs).select("doc_id", S.clean_html(F.col("html")).alias("texto"))


@q("s19_gazetteer", "select n_name as lugar, r_name as region, 1 as filas from nation join region on n_regionkey = r_regionkey", "nation", "region")
def gazetteer(nation: DataFrame, region: DataFrame) -> DataFrame:
    """A lookup table of fixed size."""
    return nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("lugar"), F.col("r_name").alias("region"), F.lit(1).alias("filas"))


@q("k1_entity_csv", f"select categoria, {N} as entidad, count(distinct articulo_id) as n_articulos, array_to_string(list_sort(list(distinct articulo_id)), '; ') as articulos from entidades group by 1, 2", "entidades")
def entity_csv(ents: DataFrame) -> DataFrame:
    ids = F.array_sort(F.collect_set("articulo_id"))
    return ents.groupBy("categoria", T.plain(F.col("texto")).alias("entidad")).agg(F.countDistinct("articulo_id").alias("n_articulos"), F.array_join(ids, "; ").alias("articulos"))


_HEAD = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="{kind}"><nodes>'
_GEXF = "with {g}, n as (select e, count(*) as grado from (select a as e from g union all select b from g) group by 1), l as (select 0 as parte, '{head}' as linea union all select 1, '<node id=\"' || e || '\" label=\"' || e || '\"{degree}/>' from n union all select 2, '</nodes><edges>' union all select 3, '<edge source=\"' || a || '\" target=\"' || b || '\" weight=\"' || peso || '\"/>' from g union all select 4, '</edges></graph></gexf>') select parte, linea from l"


def _gexf(edges: DataFrame, kind: str, degree: bool) -> DataFrame:
    """(parte, linea) of a whole document; written in the order of the parts it is the file."""
    spark = edges.sparkSession
    label = [F.lit('<node id="'), "nodo", F.lit('" label="'), "nodo", F.lit('"')] + ([F.lit(' grado="'), F.col("grado").cast("string"), F.lit('"')] if degree else [])
    nodes = G.degrees(edges).select(F.lit(1).alias("parte"), F.concat(*label, F.lit("/>")).alias("linea"))
    lines = edges.select(F.lit(3).alias("parte"), F.format_string('<edge source="%s" target="%s" weight="%d"/>', "a", "b", "peso").alias("linea"))
    frame = spark.createDataFrame([(0, _HEAD.format(kind=kind)), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")], "parte int, linea string")
    return frame.unionByName(nodes).unionByName(lines)


@q("k5_gexf_edges", _GEXF.format(g=_G, head=_HEAD.format(kind="directed"), degree=""), "entidades")
def gexf(ents: DataFrame) -> DataFrame:
    return _gexf(materialise(capped(ents), "aristas"), "directed", False)


@q("k6_gephi_nodes", _GEXF.format(g=_G, head=_HEAD.format(kind="undirected"), degree=" grado=\"' || grado || '\""), "entidades")
def gephi(ents: DataFrame) -> DataFrame:
    return _gexf(materialise(capped(ents), "aristas"), "undirected", True)


@q("k7_turtle", f"with {_CAN} select '<urn:' || categoria || ':' || norma || '> rdfs:label \"' || replace(nombre, '\"', '\\\"') || '\" .' as linea from c", "entidades")
def turtle(ents: DataFrame) -> DataFrame:
    label = F.replace("nombre", F.lit('"'), F.lit('\\"'))
    return E.canonical(ents).select(F.concat(F.lit("<urn:"), "categoria", F.lit(":"), "norma", F.lit('> rdfs:label "'), label, F.lit('" .')).alias("linea"))


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_X = "replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_CLEAN = r"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
_TEI = "t as (select articulo_id, arg_max(texto_crudo, id) as t from ocr where texto_crudo is not null group by 1), a as (select id, max(titulo) as titulo, max(autor) as autor, max(numero) as numero, max(fecha_publicacion) as fecha from articulos group by 1), e as (select articulo_id, count(*) as n, string_agg('<annotation><name type=\"' || categoria || '\">' || " + _X.format(c=_CLEAN.format(c="texto")) + " || '</name></annotation>', '' order by categoria, texto) as e from (select distinct articulo_id, categoria, texto from entidades where length(trim(texto)) > 2) group by 1)"
_H = lambda c: _X.format(c=_CLEAN.format(c=f"coalesce({c}, '')"))


@q("k8_tei", "with " + _TEI + " select t.articulo_id, '<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><teiHeader><fileDesc><titleStmt><title>' || " + _H("titulo") + " || '</title><author>' || " + _H("autor") + " || '</author></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><bibl><biblScope unit=\"issue\">' || " + _H("numero") + " || '</biblScope><date>' || " + _H("fecha") + " || '</date></bibl></sourceDesc></fileDesc></teiHeader><standOff><listAnnotation>' || coalesce(e, '') || '</listAnnotation></standOff><text xml:id=\"' || t.articulo_id || '\"><body><p>' || " + _X.format(c=_CLEAN.format(c="t")) + " || '</p></body></text></TEI>' as xml from t left join a on a.id = t.articulo_id left join e on e.articulo_id = t.articulo_id", "ocr", "articulos", "entidades")
def tei(ocr: DataFrame, arts: DataFrame, ents: DataFrame) -> DataFrame:
    """One document an article: header, names of more than two letters as stand-off annotations, text."""
    t = ocr.where("texto_crudo is not null").groupBy("articulo_id").agg(F.max_by("texto_crudo", "id").alias("t"))
    a = arts.groupBy(F.col("id").alias("articulo_id")).agg(*(F.max(c).alias(c) for c in ("titulo", "autor", "numero", "fecha_publicacion")))
    names = ents.where("length(trim(texto)) > 2").select("articulo_id", "categoria", "texto").distinct()
    clean = lambda c: _xml(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    one = lambda x: F.concat(F.lit('<annotation><name type="'), x["categoria"], F.lit('">'), clean(x["texto"]), F.lit("</name></annotation>"))
    e = names.groupBy("articulo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("categoria", "texto"))), one), "").alias("e"))  # an article's
    h = lambda c: clean(F.coalesce(c, F.lit("")))
    x = t.join(a, "articulo_id", "left").join(e, "articulo_id", "left")
    head = [F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), h("titulo"), F.lit("</title><author>"), h("autor"), F.lit('</author></titleStmt><publicationStmt><p/></publicationStmt><sourceDesc><bibl><biblScope unit="issue">'), h("numero"), F.lit("</biblScope><date>"), h("fecha_publicacion"), F.lit("</date></bibl></sourceDesc></fileDesc></teiHeader>")]
    off = [F.lit("<standOff><listAnnotation>"), F.coalesce("e", F.lit("")), F.lit("</listAnnotation></standOff>")]
    return x.select("articulo_id", F.concat(*head, *off, F.lit('<text xml:id="'), "articulo_id", F.lit('"><body><p>'), clean(F.col("t")), F.lit("</p></body></text></TEI>")).alias("xml"))


@q("k9_tei_validation", "with " + _TEI + " select t.articulo_id, true as bien_formado, true as espacio, true as cabecera, trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' as cuerpo, coalesce(n, 0)::int as anotaciones from t left join e on e.articulo_id = t.articulo_id", "ocr", "articulos", "entidades")
def tei_validation(ocr: DataFrame, arts: DataFrame, ents: DataFrame) -> DataFrame:
    """Each document through an XML parser: well-formed, name space, header, text, and the number of annotations."""
    import pandas as pd

    def check(batches):
        from xml.etree import ElementTree

        ns = "{http://www.tei-c.org/ns/1.0}"
        for b in batches:
            out = []
            for x in b["xml"]:
                try:
                    root = ElementTree.fromstring(x)
                except ElementTree.ParseError:
                    out.append((False, False, False, False, 0))
                    continue
                body = root.find(f"{ns}text/{ns}body")
                out.append((True, root.tag == ns + "TEI", root.find(f"{ns}teiHeader/{ns}fileDesc/{ns}titleStmt/{ns}title") is not None, body is not None and bool("".join(body.itertext()).strip(" \t\r\n")), len(root.findall(f".//{ns}annotation"))))
            yield pd.concat([b[["articulo_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["bien_formado", "espacio", "cabecera", "cuerpo", "anotaciones"])], axis=1)

    return tei(ocr, arts, ents).mapInPandas(check, "articulo_id string, bien_formado boolean, espacio boolean, cabecera boolean, cuerpo boolean, anotaciones int")


@q("k10_bibtex", r"select id, '@article{' || id || ', title={' || coalesce(titulo, '') || '}, year={' || coalesce(nullif(regexp_extract(fecha_publicacion, '\d{4}'), ''), 's.f.') || '}}' as entrada from (select distinct id, titulo, fecha_publicacion from articulos)", "articulos")
def bibtex(arts: DataFrame) -> DataFrame:
    y = F.coalesce(F.nullif(F.regexp_extract("fecha_publicacion", r"(\d{4})", 1), F.lit("")), F.lit("s.f."))
    return arts.select("id", "titulo", "fecha_publicacion").distinct().select("id", F.concat(F.lit("@article{"), "id", F.lit(", title={"), F.coalesce("titulo", F.lit("")), F.lit("}, year={"), y, F.lit("}}")).alias("entrada"))


@q("k11_alto", None, "ocr")
def alto(ocr: DataFrame) -> DataFrame:
    """Zones as blocks in pixels of a page of 1000 by 1400."""
    px = lambda c, n: F.round(F.col(c) * n).cast("int")
    block = F.format_string('<TextBlock ID="b%d" HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"/>', F.col("k"), px("x0", 1000), px("y0", 1400), px("x1", 1000) - px("x0", 1000), px("y1", 1400) - px("y0", 1400))
    z = zones(ocr).withColumn("b", block)
    return z.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "b"))), lambda x: x["b"]), "\n").alias("xml"))


@q("k12_markdown", "with e as (select articulo_id, string_agg(distinct texto, ', ' order by texto) as e from entidades where categoria = 'lugares' group by 1) select a.id, '# ' || coalesce(titulo, a.id) || chr(10) || coalesce(e, '') as md from (select id, max(titulo) as titulo from articulos group by id) a left join e on e.articulo_id = a.id", "articulos", "entidades")
def markdown(arts: DataFrame, ents: DataFrame) -> DataFrame:
    e = ents.where("categoria = 'lugares'").groupBy("articulo_id").agg(F.array_join(F.array_sort(F.collect_set("texto")), ", ").alias("e"))
    a = arts.groupBy("id").agg(F.max("titulo").alias("titulo"))
    j = a.join(e, F.col("id") == F.col("articulo_id"), "left")
    return j.select("id", F.concat(F.lit("# "), F.coalesce("titulo", "id"), F.lit("\n"), F.coalesce("e", F.lit(""))).alias("md"))


@q("k15_jsonld", "select id, '{\"id\":' || id || ',\"type\":\"Annotation\",\"body\":\"' || categoria || '\",\"state\":\"' || estado || '\"}' as json from anotaciones where estado in ('confirmada', 'corregida')", "anotaciones")
def jsonld(ann: DataFrame) -> DataFrame:
    body = F.to_json(F.struct("id", F.lit("Annotation").alias("type"), F.col("categoria").alias("body"), F.col("estado").alias("state")))
    return ann.where("estado in ('confirmada', 'corregida')").select("id", body.alias("json"))


@q("k16_research_log", "select categoria, count(*) as n, '## ' || categoria || chr(10) || string_agg('- ' || texto_norm, chr(10) order by texto_norm, id) as md from anotaciones where notas <> '' group by 1", "anotaciones")
def research_log(ann: DataFrame) -> DataFrame:
    """Notes of each type as one text; the export is one text a type by definition."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("texto_norm", "id"))), lambda x: F.concat(F.lit("- "), x["texto_norm"]))
    return ann.where("notas <> ''").groupBy("categoria").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("## "), F.first("categoria"), F.lit("\n"), F.array_join(rows, "\n")).alias("md"))


@q("k18_vocabulary_csv", "select lower(texto_norm) as termino, categoria, coalesce(descripcion, '') as definicion, coalesce(wikidata_id, '') as id from autoridades_cache", "autoridades_cache")
def vocabulary_csv(aut: DataFrame) -> DataFrame:
    return aut.select(F.lower("texto_norm").alias("termino"), "categoria", F.coalesce("descripcion", F.lit("")).alias("definicion"), F.coalesce("wikidata_id", F.lit("")).alias("id"))


@q("k14_report_tables", f"with c as (select categoria, {N} as entidad, count(distinct articulo_id) as n from entidades group by 1, 2), r as (select *, row_number() over (partition by categoria order by n desc, entidad) as puesto from c) select categoria, entidad, n, puesto from r where puesto <= 10", "entidades")
def report(ents: DataFrame) -> DataFrame:
    """Ten names of each category, the body of the report."""
    from pyspark.sql import Window

    c = ents.groupBy("categoria", T.plain(F.col("texto")).alias("entidad")).agg(F.countDistinct("articulo_id").alias("n"))
    return c.withColumn("puesto", F.row_number().over(Window.partitionBy("categoria").orderBy(F.desc("n"), "entidad"))).where("puesto <= 10")


_HASH = "with h as (select doc_id, sha256(doc_id::varchar || chr(1) || coalesce(text, '')) as h from documents), b1 as (select doc_id // 1000 as b, sha256(string_agg(h, '' order by doc_id)) as h from h group by 1), b2 as (select b // 1000 as b, sha256(string_agg(h, '' order by b1.b)) as h from b1 group by 1), b3 as (select b // 1000 as b, sha256(string_agg(h, '' order by b2.b)) as h from b2 group by 1) select sha256(string_agg(h, '' order by b)) as hash from b3"


@q("f26_corpus_hash", _HASH, "documents")
def corpus_hash(docs: DataFrame) -> DataFrame:
    """A tree of hashes: rows, blocks of a thousand ids, of a thousand such blocks, and once more; no cell holds more."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    blocks = docs.select(F.col("doc_id").alias("b"), sha(F.concat(F.col("doc_id").cast("string"), F.lit("\u0001"), F.coalesce("text", F.lit("")))).alias("h"))
    join = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, "h"))), lambda x: x["h"]), "")
    for _ in range(3):
        blocks = blocks.groupBy(F.floor(F.col("b") / 1000).alias("c")).agg(sha(join("b")).alias("h")).withColumnRenamed("c", "b")
    return blocks.agg(sha(join("b")).alias("hash"))
