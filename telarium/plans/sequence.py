"""Queries of ordered pages, zones and article ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.operators import sequence as S
from telarium.plans.registry import Plan

PLAN = Plan()
QUERIES, SQL = PLAN.queries, PLAN.sql
q = PLAN.query

_P = r"""a as (select id, arg_max(struct_pack(numero := numero, pagina := pagina_inicio, autor := autor), coalesce(modificado, timestamp '1900-01-01')) as a from articulos where numero is not null group by id),
t as (select articulo_id as id, arg_max(texto_crudo, struct_pack(n := length(texto_crudo), id := id)) as t from ocr where texto_crudo is not null group by 1),
p as (select a.a.numero as numero, id, a.a.pagina as pagina, t, row_number() over (partition by a.a.numero order by a.a.pagina nulls first, id) as seq from a join t using (id))"""
_C = _P + r""", n as (select *, lead(t) over (partition by numero order by seq) as nx from p), c as (select *, coalesce(nx is not null and (regexp_matches(trim(t, ' '), '[-¬,]$') or regexp_matches(ltrim(nx, ' '), '^\p{Ll}')), false) as sigue from n)"""


@q("j13_page_continuity", f"with {_C} select numero, seq, id, sigue from c", "articulos", "ocr")
def continuity(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    return S.continuity(S.pages(arts, ocr)).select("numero", "seq", "id", "sigue")


@q("w2_segment_runs", f"with {_C}, k as (select *, sum((not coalesce(l, false))::int) over (partition by numero order by seq) as isla from (select *, lag(sigue) over (partition by numero order by seq) as l from c)) select numero, isla, count(*) as paginas, min(seq) as desde, sum(len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'))) as palabras from k group by 1, 2", "articulos", "ocr")
def runs(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    return S.segments(S.pages(arts, ocr))


@q("a69_segmentation_comparison", f"with {_C}, k as (select *, sum((not coalesce(l, false))::int) over (partition by numero order by seq) as isla from (select *, lag(sigue) over (partition by numero order by seq) as l from c)), s as (select numero, isla, count(*) as paginas from k group by 1, 2) select (select count(*) from p) as paginas, count(*) as segmentos, sum((paginas = 1)::int) as atomicos, round(avg(paginas), 4) as media from s", "articulos", "ocr")
def comparison(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    s = S.segments(S.pages(arts, ocr))
    return s.agg(F.sum("paginas").alias("paginas"), F.count(F.lit(1)).alias("segmentos"), F.sum((F.col("paginas") == 1).cast("int")).alias("atomicos"), F.round(F.avg("paginas"), 4).alias("media"))


@q("w1_segment_fold", None, "articulos", "ocr")
def fold(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    return S.fold(S.pages(arts, ocr))


@q("w3_chain_components", f"with {_C}, k as (select *, sum((not coalesce(l, false))::int) over (partition by numero order by seq) as isla from (select *, lag(sigue) over (partition by numero order by seq) as l from c)) select id, min(id) over (partition by numero, isla) as clase from k", "articulos", "ocr")
def chains(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    """Connected components of the continuity edges; they are chains, so islands suffice."""
    w = Window.partitionBy("numero").orderBy("seq")
    x = S.continuity(S.pages(arts, ocr)).withColumn("n", (~F.coalesce(F.lag("sigue").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("isla", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select("id", F.min("id").over(Window.partitionBy("numero", "isla")).alias("clase"))


@q("w4_ids_by_order", f"with {_P} select id, numero || '-a' || lpad(seq::varchar, 4, '0') as nuevo from p", "articulos", "ocr")
def ids_by_order(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    return S.pages(arts, ocr).select("id", F.concat("numero", F.lit("-a"), F.lpad(F.col("seq").cast("string"), 4, "0")).alias("nuevo"))


@q("w5_ids_by_page", f"with {_P}, r as (select *, row_number() over (partition by numero, pagina order by seq) as k from p) select id, numero || '_p' || lpad(coalesce(pagina, 0)::varchar, 4, '0') || '_' || lpad(k::varchar, 2, '0') as nuevo from r", "articulos", "ocr")
def ids_by_page(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("numero", "pagina").orderBy("seq"))
    return S.pages(arts, ocr).withColumn("k", k).select("id", F.concat("numero", F.lit("_p"), F.lpad(F.coalesce("pagina", F.lit(0)).cast("string"), 4, "0"), F.lit("_"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("nuevo"))


_Z = "z as (select id, k, round((length(t) - length(ltrim(t, ' '))) / 100, 4) as x0, round(k / n, 4) as y0, round(least(1.0, length(t) / 60), 4) as x1, round((k + 1) / n, 4) as y1, t from (select id, len(ls) as n, unnest(generate_series(0, len(ls) - 1)) as k, unnest(ls) as t from (select id, string_split(texto_crudo, chr(10)) as ls from ocr where texto_crudo is not null)) where trim(t, ' ') <> '')"


@q("s14_zones", f"with {_Z} select id, k::int as k, x0, y0, x1, y1 from z", "ocr")
def zones(ocr: DataFrame) -> DataFrame:
    """One positioned zone a line, the input of the spatial operators."""
    return S.zones(ocr).drop("t")


@q("s14_text_rebuild", None, "ocr")
def rebuild(ocr: DataFrame) -> DataFrame:
    return S.rebuild(S.zones(ocr))


@q("w6_reading_order", f"with {_Z}, b as (select *, case when x1 - x0 > 0.6 then 0 else 1 + floor(x0 / 0.08) end as col from z) select id, k::int as k, (row_number() over (partition by id order by col, y0, k))::int as orden from b", "ocr")
def reading_order(ocr: DataFrame) -> DataFrame:
    """Full-width zones first, then columns by their left edge, then from top to bottom."""
    column = F.when(F.col("x1") - F.col("x0") > 0.6, 0).otherwise(1 + F.floor(F.col("x0") / F.lit(0.08)))
    return S.zones(ocr).withColumn("c", column).select("id", "k", F.row_number().over(Window.partitionBy("id").orderBy("c", "y0", "k")).alias("orden"))


@q("w7_reading_bands", None, "ocr")
def reading_bands(ocr: DataFrame) -> DataFrame:
    return S.bands(S.zones(ocr))


@q("w8_repeated_headers", f"with {_Z} select upper(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) as clave, round(x1 / 0.02) as caja, count(distinct id) as paginas from z where y0 <= 0.12 group by 1, 2 having count(distinct id) >= 3", "ocr")
def repeated_headers(ocr: DataFrame) -> DataFrame:
    """Top zones with equal letters and a box of one width on three pages."""
    top = S.zones(ocr).where("y0 <= 0.12")
    g = top.groupBy(F.upper(F.regexp_replace("t", r"[^\p{L}]", "")).alias("clave"), F.round(F.col("x1") / F.lit(0.02)).alias("caja")).agg(F.countDistinct("id").alias("paginas"))
    return g.where("paginas >= 3")


@q("w9_drop_caps", f"with {_Z}, m as (select *, length(trim(t, ' ')) as n, median(length(t)) over (partition by id) as med from z) select id, k::int as k from m where n <= 3 and n * 1.8 <= med", "ocr")
def drop_caps(ocr: DataFrame) -> DataFrame:
    """Zones much smaller than the median of their page."""
    m = F.median(F.length("t")).over(Window.partitionBy("id"))
    x = S.zones(ocr).withColumn("m", m).withColumn("n", F.length(F.trim("t")))
    return x.where("n <= 3 and n * 1.8 <= m").select("id", "k")


@q("j10_zone_iou", f"with {_Z}, b as (select * from z), c as (select id, k, x0, y0 - (y1 - y0) / 4 as y0, x1, y1 from z), o as (select b.id, b.k as a, c.k as b, greatest(0, least(b.x1, c.x1) - greatest(b.x0, c.x0)) * greatest(0, least(b.y1, c.y1) - greatest(b.y0, c.y0)) as i, (b.x1 - b.x0) * (b.y1 - b.y0) as s1, (c.x1 - c.x0) * (c.y1 - c.y0) as s2 from b join c on b.id = c.id and b.y0 < c.y1 and c.y0 < b.y1), u as (select id, a, b, i / (s1 + s2 - i) as iou from o where s1 + s2 - i > 0) select id, a::int as a, arg_max(b, struct_pack(v := round(iou, 6), k := b))::int as b, round(max(iou), 4) as iou from u where iou >= 0.5 group by 1, 2", "ocr")
def zone_iou(ocr: DataFrame) -> DataFrame:
    """The best overlap of each zone among the zones of a second reading, on one page and with overlapping rows."""
    z = S.zones(ocr)
    b = z.select("id", F.col("k").alias("a"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    c = z.select("id", F.col("k").alias("b"), "x0", (F.col("y0") - (F.col("y1") - F.col("y0")) / 4).alias("y0"), "x1", "y1")
    o = b.join(c, "id").where("b_y0 < y1 and y0 < b_y1")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"b_{hi}", hi) - F.greatest(f"b_{lo}", lo))
    inter = side("x0", "x1") * side("y0", "y1")
    union = (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0")) + (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) - inter
    u = o.select("id", "a", "b", F.when(union > 0, inter / union).alias("iou")).where("iou >= 0.5")
    return u.groupBy("id", "a").agg(F.max_by("b", F.struct(F.round("iou", 6), "b")).alias("b"), F.round(F.max("iou"), 4).alias("iou"))


@q("j11_caption_matching", f"with {_Z}, f as (select * from z where length(t) >= 30), c as (select * from z where length(t) < 30), m as (select c.id, c.k as pie, min(f.k) as foto from c join f on f.id = c.id and c.y0 - f.y1 between -0.0001 and 0.03 and least(c.x1, f.x1) - greatest(c.x0, f.x0) >= 0.5 * (c.x1 - c.x0) group by 1, 2) select id, pie::int as pie, foto::int as foto from m", "ocr")
def captions(ocr: DataFrame) -> DataFrame:
    """A short zone right below a wide one, with half of its width in common; the first wide one wins."""
    z = S.zones(ocr)
    f = z.where(F.length("t") >= 30).select("id", F.col("k").alias("foto"), F.col("x0").alias("f0"), F.col("x1").alias("f1"), F.col("y1").alias("fy"))
    c = z.where(F.length("t") < 30)
    m = c.join(f, "id").where((F.col("y0") - F.col("fy")).between(-0.0001, 0.03) & (F.least("x1", "f1") - F.greatest("x0", "f0") >= 0.5 * (F.col("x1") - F.col("x0"))))
    return m.groupBy("id", F.col("k").alias("pie")).agg(F.min("foto").alias("foto"))


@q("j12_box_dedup", None, "ocr")
def dedup(ocr: DataFrame) -> DataFrame:
    return S.nms(S.zones(ocr).withColumn("c", F.length("t")).drop("t"))


@q("a62_layout_statistics", f"with {_Z} select id, count(*) as zonas, round(avg(case when (x1 - x0) * (y1 - y0) > 0 then (x1 - x0) * (y1 - y0) end), 3) as area from z group by 1", "ocr")
def layout(ocr: DataFrame) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return S.zones(ocr).groupBy("id").agg(F.count(F.lit(1)).alias("zonas"), F.round(F.avg(F.when(area > 0, area)), 3).alias("area"))


@q("w15_longest_version", "select articulo_id, arg_max(id, struct_pack(n := length(texto_crudo), i := -id)) as id, max(length(texto_crudo)) as largo from ocr where texto_crudo is not null group by 1", "ocr")
def longest(ocr: DataFrame) -> DataFrame:
    return ocr.where("texto_crudo is not null").groupBy("articulo_id").agg(F.max_by("id", F.struct(F.length("texto_crudo"), -F.col("id"))).alias("id"), F.max(F.length("texto_crudo")).alias("largo"))


@q("w13_version_history", "select articulo_id, id, motor, row_number() over (partition by articulo_id order by id) as version from ocr", "ocr")
def history(ocr: DataFrame) -> DataFrame:
    return ocr.select("articulo_id", "id", "motor", F.row_number().over(Window.partitionBy("articulo_id").orderBy("id")).alias("version"))


@q("j17_image_pairing", "select a.id, o.id as ocr_id from (select distinct id from articulos) a left join ocr o on lower(trim(o.articulo_id)) = lower(trim(a.id))", "articulos", "ocr")
def pairing(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    a = arts.select("id").distinct().withColumn("k", F.lower(F.trim("id")))
    return a.join(ocr.select(F.lower(F.trim("articulo_id")).alias("k"), F.col("id").alias("ocr_id")), "k", "left").select("id", "ocr_id")


@q("j15_pending_pages", "select distinct id from articulos where id not in (select articulo_id from ocr where trim(coalesce(texto_limpio, '')) <> '')", "articulos", "ocr")
def pending(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    done = ocr.where("trim(coalesce(texto_limpio, '')) <> ''").select(F.col("articulo_id").alias("id")).distinct()
    return arts.select("id").distinct().join(done, "id", "left_anti")




_STAGES = ["view", "click", "signup", "purchase", "error"]


@q("w16_stage_state", f"with m as (select user_id as proyecto, event_type as etapa, case when event_id % 5 = 0 then 'pending' else 'ready' end as estado, event_id as v, list_position([{', '.join(repr(x) for x in _STAGES)}], event_type) as k from events), l as (select proyecto, etapa, k, arg_max(estado, v) as estado, max(v) as v from m group by 1, 2, 3) select l.proyecto, l.etapa, case when l.estado = 'ready' and exists (select 1 from m where m.proyecto = l.proyecto and m.k < l.k and m.estado = 'ready' and m.v > l.v) then 'stale' else l.estado end as estado from l", "events")
def stage_state(ev: DataFrame) -> DataFrame:
    """Events as marks of the stages of each user's project."""
    marks = ev.select(F.col("user_id").alias("proyecto"), F.col("event_type").alias("etapa"), F.when(F.col("event_id") % 5 == 0, "pending").otherwise("ready").alias("estado"), F.col("event_id").alias("v"))
    return S.stage_states(marks, _STAGES)
