"""Ordered pages, zones and articles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"([\p{L}\p{N}]+)"


def pages(arts: DataFrame, ocr: DataFrame) -> DataFrame:
    """(numero, seq, id, pagina, autor, t): the last text of each article, in the order of its issue."""
    when = F.coalesce("modificado", F.lit("1900-01-01").cast("timestamp_ntz"))
    a = arts.where("numero is not null").groupBy("id").agg(F.max_by(F.struct("numero", "pagina_inicio", "autor"), when).alias("a")).select("id", "a.*")
    t = ocr.where("texto_crudo is not null").groupBy(F.col("articulo_id").alias("id")).agg(F.max_by("texto_crudo", F.struct(F.length("texto_crudo"), "id")).alias("t"))
    x = a.join(t, "id")
    order = Window.partitionBy("numero").orderBy(F.col("pagina_inicio").asc_nulls_first(), "id")
    return x.select("numero", F.row_number().over(order).alias("seq"), "id", F.col("pagina_inicio").alias("pagina"), "autor", "t")


def continuity(p: DataFrame) -> DataFrame:
    """Whether each page goes on in the next: an open end, or a start in lower case."""
    nxt = F.lead("t").over(Window.partitionBy("numero").orderBy("seq"))
    opened = F.trim("t").rlike(r"[-¬,]$") | F.ltrim(nxt).rlike(r"^\p{Ll}")
    return p.withColumn("sigue", F.coalesce(opened & nxt.isNotNull(), F.lit(False)))


def segments(p: DataFrame) -> DataFrame:
    """Runs of pages that go on, as islands."""
    w = Window.partitionBy("numero").orderBy("seq")
    x = continuity(p).withColumn("nuevo", (~F.coalesce(F.lag("sigue").over(w), F.lit(False))).cast("int"))
    x = x.withColumn("isla", F.sum("nuevo").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.size(F.regexp_extract_all("t", F.lit(WORDS), 1)))
    return x.groupBy("numero", "isla").agg(F.count(F.lit(1)).alias("paginas"), F.min("seq").alias("desde"), n.alias("palabras"))


def fold(p: DataFrame) -> DataFrame:
    """An ordered fold of the pages of an issue; known authors and long texts break a segment."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in pdf.sort_values("seq").itertuples():
            words = len(r.t.split())
            author = r.autor if isinstance(r.autor, str) and r.autor.strip() not in ("", "nan") else None
            last = out[-1] if out else None
            lower = r.t.lstrip()[:1].islower()
            if last and (not author or not last[4] or author == last[4]) and last[3] < 150 and lower:
                last[2] = r.seq
                last[3] += words
                last[4] = last[4] or author
            else:
                out.append([r.numero, r.seq, r.seq, words, author])
        kept = [x for x in out if x[3] >= 15]
        return pd.DataFrame(kept, columns=["numero", "desde", "hasta", "palabras", "autor"])

    return p.groupBy("numero").applyInPandas(one, "numero string, desde int, hasta int, palabras int, autor string")


def zones(ocr: DataFrame) -> DataFrame:
    """A zone for each line of a page: (id, k, x0, y0, x1, y1, t), coordinates from 0 to 1."""
    lines = F.split("texto_crudo", "\n")
    x = ocr.where("texto_crudo is not null").select("id", F.size(lines).alias("n"), F.posexplode(lines).alias("k", "t")).where("trim(t) <> ''")
    indent = F.length("t") - F.length(F.ltrim("t"))
    return x.select("id", "k", F.round(indent / 100, 4).alias("x0"), F.round(F.col("k") / F.col("n"), 4).alias("y0"), F.round(F.least(F.lit(1.0), F.length("t") / 60), 4).alias("x1"), F.round((F.col("k") + 1) / F.col("n"), 4).alias("y1"), "t")


def nms(z: DataFrame, limit: float = 0.45) -> DataFrame:
    """Greedy suppression of overlapping boxes in the order of their confidence, page by page."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in pdf.sort_values(["c", "k"], ascending=[False, True]).itertuples():
            free = True
            for o in kept:
                w, h = min(r.x1, o.x1) - max(r.x0, o.x0), min(r.y1, o.y1) - max(r.y0, o.y0)
                inter = max(0.0, w) * max(0.0, h)
                union = (r.x1 - r.x0) * (r.y1 - r.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - inter
                if union > 0 and inter / union > limit:
                    free = False
                    break
            if free:
                kept.append(r)
        return pd.DataFrame([(r.id, r.k) for r in kept], columns=["id", "k"])

    return z.groupBy("id").applyInPandas(one, "id long, k int")


def bands(z: DataFrame) -> DataFrame:
    """Wide zones part the page into bands; inside a band columns grow by overlap; then reading order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, band, columns = [], 0, []
        for r in pdf.sort_values(["y0", "x0", "k"]).itertuples():
            if r.x1 - r.x0 >= 0.62:
                band, columns = band + 1, []
                rows.append((band, -1, r.y0, r.k))
                band += 1
                continue
            for c, (a, b) in enumerate(columns):
                if min(b, r.x1) - max(a, r.x0) > 0.4 * max(1e-9, r.x1 - r.x0):
                    columns[c] = (min(a, r.x0), max(b, r.x1))
                    break
            else:
                c = len(columns)
                columns.append((r.x0, r.x1))
            rows.append((band, c, r.y0, r.k))
        rows.sort()
        return pd.DataFrame([(pdf["id"].iloc[0], r[3], i + 1) for i, r in enumerate(rows)], columns=["id", "k", "orden"])

    return z.groupBy("id").applyInPandas(one, "id long, k int, orden int")


def rebuild(z: DataFrame, tolerance: float = 0.003) -> DataFrame:
    """Spans gathered into lines, each anchored on the top of its first span, and joined."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lines: list[list] = []
        for r in pdf.sort_values(["y0", "x0"]).itertuples():
            if lines and abs(r.y0 - lines[-1][0]) <= tolerance:
                lines[-1][1].append((r.x0, r.t))
            else:
                lines.append([r.y0, [(r.x0, r.t)]])
        text = "\n".join(" ".join(t for _, t in sorted(x)) for _, x in lines)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "texto": [text]})

    return z.groupBy("id").applyInPandas(one, "id long, texto string")


def stage_states(marks: DataFrame, order: list[str]) -> DataFrame:
    """(proyecto, etapa, estado) from marks (proyecto, etapa, estado, v), v their order.

    A stage has its last mark; a ready one is stale if an earlier stage was marked ready or stale after it; stages out of the order neither
    change others nor are changed. The state is a function of the marks, so it can be told for any version.
    """
    at = F.array_position(F.array(*map(F.lit, order)), F.col("etapa"))
    touched = F.max(F.when(F.col("estado").isin("ready", "stale"), F.col("v"))).alias("touched")
    last = marks.groupBy("proyecto", "etapa").agg(F.max_by("estado", "v").alias("estado"), F.max("v").alias("v"), touched).withColumn("k", at)
    before = Window.partitionBy("proyecto").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # the stages of a project
    x = last.withColumn("changed", F.max(F.when(F.col("k") > 0, F.col("touched"))).over(before))
    stale = (F.col("estado") == "ready") & (F.col("k") > 0) & (F.col("changed") > F.col("v"))
    return x.select("proyecto", "etapa", F.when(stale, "stale").otherwise(F.col("estado")).alias("estado"))
