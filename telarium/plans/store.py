"""Queries of upserts, merges and differences of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.operators import store as S
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_WHEN = "coalesce(modificado, timestamp '1900-01-01')"


def halves(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of one table, in the order of c: what is stored already, and the batch."""
    low, high = df.agg(F.min(c), F.max(c)).first()
    cut = F.col(c) > F.lit(low + (high - low) / 2 if low is not None else None)
    return df.where(~cut | cut.isNull()), df.where(cut)


@q("u1_article_upsert", f"select id, arg_min(archivo_origen, {_WHEN}) as archivo_origen, arg_min(numero, {_WHEN}) as numero, arg_max(titulo, {_WHEN}) as titulo, arg_max(estado, {_WHEN}) as estado, max({_WHEN}) as modificado from (select id, coalesce(archivo_origen, '') as archivo_origen, coalesce(numero, '') as numero, coalesce(titulo, '') as titulo, coalesce(estado, '') as estado, modificado from articulos) group by id", "articulos")
def article_upsert(arts: DataFrame) -> DataFrame:
    """The stored article keeps its origin; a later delivery updates title and state."""
    old, new = (S.upsert(x) for x in halves(arts, "modificado"))
    return S.merge(S.stored(old), new, ["id"], {"archivo_origen": "old", "numero": "old", "titulo": "new", "estado": "new", "modificado": "new"})


@q("u2_replace_source", "select articulo_id, texto, categoria, fuente, count(*) as n from entidades where fuente is distinct from 'roberta_bne' group by all union all select distinct articulo_id, texto, categoria, fuente, 1 from entidades where fuente = 'roberta_bne'", "entidades")
def replace_source(ents: DataFrame) -> DataFrame:
    """The stored mentions of one source are replaced by a deduplicated load; those of other sources stay."""
    key = ["articulo_id", "texto", "categoria", "fuente"]
    target = S.stored(ents.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    load = ents.where("fuente = 'roberta_bne'").select(*key).distinct().withColumn("n", F.lit(1).cast("long"))
    return S.replace(target, load, ["fuente"])


@q("u2_stub_articles", "select distinct e.articulo_id as id, e.articulo_id as titulo from entidades e left join (select distinct id from articulos where estado = 'revisado') a on a.id = e.articulo_id where e.fuente = 'roberta_bne' and a.id is null", "articulos", "entidades")
def stub_articles(arts: DataFrame, ents: DataFrame) -> DataFrame:
    """Minimal rows for the articles that a load names and a store of reviewed articles lacks."""
    return S.stubs(S.stored(arts.where("estado = 'revisado'").select("id").distinct()), ents.where("fuente = 'roberta_bne'"), "articulo_id")


@q("u3_replace_article", "with k as (select articulo_id, max(id) as ultimo from entidades group by 1), f as (select e.articulo_id, e.fuente from entidades e join k on k.ultimo = e.id) select e.id, e.articulo_id, e.texto from entidades e join f on f.articulo_id = e.articulo_id and f.fuente is not distinct from e.fuente", "entidades")
def replace_article(ents: DataFrame) -> DataFrame:
    """The last load of an article replaces all that is stored for it."""
    last = ents.groupBy("articulo_id").agg(F.max_by(F.struct("fuente"), "id").alias("u"))
    load = ents.join(last, "articulo_id").where(F.col("fuente").eqNullSafe(F.col("u.fuente"))).select("id", "articulo_id", "texto")
    return S.replace(S.stored(ents.select("id", "articulo_id", "texto")), load, ["articulo_id"])


@q("u4_canonical_upsert", "select categoria, texto as nombre, arg_max(wikidata_id, id) filter (wikidata_id <> '') as wikidata from entidades group by 1, 2", "entidades")
def canonical_upsert(ents: DataFrame) -> DataFrame:
    """A null id never replaces one that is stored."""
    there = F.col("wikidata_id") != ""
    made = lambda x: x.groupBy("categoria", F.col("texto").alias("nombre")).agg(F.max_by(F.when(there, F.col("wikidata_id")), F.when(there, F.col("id"))).alias("wikidata"))
    old, new = map(made, halves(ents, "id"))
    return S.merge(S.stored(old), new, ["categoria", "nombre"], {"wikidata": lambda a, b: F.coalesce(b, a)})


@q("u5_layered_save", "select articulo_id, arg_min(texto_crudo, id) as crudo, arg_max(texto_limpio, id) filter (trim(texto_limpio) <> '') as limpio, count(*) as versiones from ocr where texto_crudo is not null group by 1", "ocr")
def layered(ocr: DataFrame) -> DataFrame:
    """The stored raw layer is never overwritten, the cleaned one is replaced by later ones that aren't empty."""
    has = F.trim("texto_limpio") != ""
    made = lambda x: x.groupBy("articulo_id").agg(F.min_by("texto_crudo", "id").alias("crudo"), F.max_by(F.when(has, F.col("texto_limpio")), F.when(has, F.col("id"))).alias("limpio"), F.count(F.lit(1)).alias("versiones"))
    old, new = map(made, halves(ocr.where("texto_crudo is not null"), "id"))
    return S.merge(S.stored(old), new, ["articulo_id"], {"crudo": "old", "limpio": lambda a, b: F.coalesce(b, a), "versiones": lambda a, b: a + b})


@q("u5_layer_history", "with r as (select articulo_id, id, texto_crudo, nullif(trim(texto_limpio), '') as l, creado from ocr where texto_crudo is not null), c as (select articulo_id, min(id) as id, 'crudo' as capa from r group by 1), v as (select articulo_id, id, l, lag(l) over (partition by articulo_id order by id) as p from r where l is not null) select c.articulo_id, c.id, c.capa, length(r.texto_crudo) as largo, r.creado from c join r using (id) union all select v.articulo_id, v.id, 'limpio', length(v.l), r.creado from v join r using (id) where p is distinct from v.l", "ocr")
def layer_history(ocr: DataFrame) -> DataFrame:
    """One row for each change of a layer: the first raw text, and every cleaned one that differs from the one before."""
    r = ocr.where("texto_crudo is not null").select("articulo_id", "id", "texto_crudo", F.nullif(F.trim("texto_limpio"), F.lit("")).alias("l"), "creado")
    raw = r.groupBy("articulo_id").agg(F.min_by(F.struct("id", F.length("texto_crudo").alias("largo"), "creado"), "id").alias("x")).select("articulo_id", "x.id", F.lit("crudo").alias("capa"), "x.largo", "x.creado")
    w = Window.partitionBy("articulo_id").orderBy("id")  # the versions of one article
    v = r.where("l is not null").select("articulo_id", "id", F.md5("l").alias("h"), F.length("l").alias("largo"), "creado").withColumn("p", F.lag("h").over(w))
    return raw.unionByName(v.where(~F.col("h").eqNullSafe(F.col("p"))).select("articulo_id", "id", F.lit("limpio").alias("capa"), "largo", "creado"))


@q("u6_kb_upsert", "select texto as nombre, categoria, max(confianza) as confianza, max(verificada) as verificada from entidades group by 1, 2", "entidades")
def kb(ents: DataFrame) -> DataFrame:
    made = lambda x: x.groupBy(F.col("texto").alias("nombre"), "categoria").agg(F.max("confianza").alias("confianza"), F.max("verificada").alias("verificada"))
    old, new = map(made, halves(ents, "id"))
    most = lambda a, b: F.greatest(a, b)
    return S.merge(S.stored(old), new, ["nombre", "categoria"], {"confianza": most, "verificada": most})


@q("u7_correction_counter", "select nombre_nuevo as correcto, count(*) as veces, arg_max(nombre, struct_pack(f := fecha, n := nombre)) as ultimo from revision_entidades where nombre_nuevo <> '' and fecha is not null group by 1", "revision_entidades")
def counter(rev: DataFrame) -> DataFrame:
    """Counts add up; the correction made last is kept."""
    made = lambda x: x.groupBy(F.col("nombre_nuevo").alias("correcto")).agg(F.count(F.lit(1)).alias("veces"), F.max(F.struct("fecha", "nombre")).alias("u"))
    old, new = map(made, halves(rev.where("nombre_nuevo <> '' and fecha is not null"), "fecha"))
    out = S.merge(S.stored(old), new, ["correcto"], {"veces": lambda a, b: a + b, "u": lambda a, b: F.greatest(a, b)})
    return out.select("correcto", "veces", F.col("u.nombre").alias("ultimo"))


@q("u8_tone_save", "select art_id, arg_max(categoria, id) as categoria from anotaciones group by 1", "anotaciones")
def tone_save(ann: DataFrame) -> DataFrame:
    """Delete and insert: one row an article, the last one."""
    made = lambda x: x.groupBy("art_id").agg(F.max_by("categoria", "id").alias("categoria"))
    old, new = map(made, halves(ann, "id"))
    return S.replace(S.stored(old), new, ["art_id"])


@q("u9_annotation_audit", "with v as (select art_id, texto_norm, fuente, id, categoria, estado, lag(categoria) over w as c0, lag(estado) over w as e0, lag(id) over w as i0 from anotaciones window w as (partition by art_id, texto_norm, fuente order by id)) select id, 'categoria' as campo, c0 as antes, categoria as despues from v where i0 is not null and c0 <> categoria union all select id, 'estado', e0, estado from v where i0 is not null and e0 <> estado", "anotaciones")
def audit(ann: DataFrame) -> DataFrame:
    """One row for each changed field of each later version of a span."""
    w = Window.partitionBy("art_id", "texto_norm", "fuente").orderBy("id")
    v = ann.select("id", "categoria", "estado", F.lag("categoria").over(w).alias("c0"), F.lag("estado").over(w).alias("e0"))
    u = v.select("id", F.expr("stack(2, 'categoria', c0, categoria, 'estado', e0, estado) as (campo, antes, despues)"))
    return u.where("antes <> despues")


_SIDE = "select articulo_id, texto, categoria, max(confianza) as c from entidades where fuente {p} group by 1, 2, 3"


@q("t12_project_diff", f"with a as ({_SIDE.format(p=chr(61) + chr(39) + 'manual' + chr(39))}), b as ({_SIDE.format(p=chr(61) + chr(39) + 'roberta_bne' + chr(39))}) select coalesce(a.articulo_id, b.articulo_id) as articulo_id, coalesce(a.texto, b.texto) as texto, coalesce(a.categoria, b.categoria) as categoria, case when a.texto is null then 'agregada' when b.texto is null then 'quitada' else 'modificada' end as cambio from a full join b on a.articulo_id = b.articulo_id and a.texto = b.texto and a.categoria = b.categoria where a.texto is null or b.texto is null or a.c is distinct from b.c", "entidades")
def diff(ents: DataFrame) -> DataFrame:
    """Added, removed and modified mentions between two loads."""
    return S.diff(S.side(ents, "manual"), S.side(ents, "roberta_bne"))


@q("t13_patch_apply", f"with a as ({_SIDE.format(p=chr(61) + chr(39) + 'manual' + chr(39))}), b as ({_SIDE.format(p=chr(61) + chr(39) + 'roberta_bne' + chr(39))}), u as (select *, 0 as v from a union all select *, 1 from b) select articulo_id, texto, categoria, arg_max(coalesce(c, -1), v) as c from u group by 1, 2, 3", "entidades")
def patch(ents: DataFrame) -> DataFrame:
    """Merge in which the newer side wins."""
    u = S.side(ents, "manual").withColumn("v", F.lit(0)).unionByName(S.side(ents, "roberta_bne").withColumn("v", F.lit(1)))
    return u.groupBy("articulo_id", "texto", "categoria").agg(F.max_by(F.coalesce("c", F.lit(-1.0)), "v").alias("c"))
