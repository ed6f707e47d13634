"""Problem 10: template residue, filler and error-page text.

Three detectors, all in built-in expressions over whole texts:
- placeholders: unfilled fields in the notations of templating languages and of typists;
- filler: stock phrases, keyboard runs, a word repeated in a row, and passages of lower-case words that
  lack any function word (invented Latin and the like);
- notices: texts with terms of failed or blocked pages, demands to enable scripts, or refusals to transcribe.
  Length is evidence: in a text of SHORT words or fewer one telling term suffices, in a longer one most sentences
  must have some. Evidence of the hosts comes from all lines of all documents: a line (digits masked) that SHARED
  documents of more than one source have in common is a response, not an article; a text of nothing but such
  lines, however long, is a notice if it has a term of notices or its body has no term in common with its address
  slug (publication and source) and with its title (the first of several lines).

Words inside «…» or “…”, and for notices sentences that report speech or writing, are quotations and
don't count. Defined results: null, blank and
symbol-only texts are no cases; a repeated doc_id is judged by all its rows together and comes out once;
extra columns are ignored; empty tables give no rows. A hot line (a third of all lines) is counted by
partial aggregation and never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.session import read

SHORT = 45  # words up to which one telling term makes a notice
SHARED = 4  # documents that share a response line, at least

FIELD = (
    "nombre|t[ií]tulo|subt[ií]tulo|titular|autor(?:a|es)?|fecha|lugar|texto|firma|secci[oó]n|pie|entradilla|resumen|"
    "cuerpo|n[uú]mero|p[aá]gina|precio|apellidos?|fotograf[ií]a|foto|imagen|publicaci[oó]n|direcci[oó]n|ciudad|"
    "name|title|author|date|place|text|your|section|caption|price|nom|titre|auteur|texte|lieu"
)
NAME = r"[\p{L}_][\p{L}\p{Nd}_.\- ]{0,40}"
PLACEHOLDERS = (
    rf"\{{\{{\{{?\s*{NAME}\s*\}}?\}}\}}",
    r"[$#]\{[^}\n]{1,40}\}",
    r"\{\$[\p{L}_]\w{0,40}\}",
    r"\{\d{1,2}\}",
    r"\{[\p{L}_]\w{1,40}\}",
    r"<%=?[^%\n]{1,60}%>",
    r"\{%[^%\n]{1,60}%\}",
    r"%\(\w{1,40}\)[sd]",
    r"%[\p{L}_]{3,40}%",
    rf"<<\s*{NAME}>>",
    rf"<!--\s*{NAME}\s*-->",
    r"(?i)<[^<>\n]{1,40} (?:pendiente|por completar|aqu[ií]|here|pending)>",
    r"@@\w{1,40}@@",
    r"##[\p{L}_]\w{1,40}##",
    r"\$[\p{L}_]{3,40}\$",
    r"__[\p{L}]\w{1,38}\w__",
    r"_{3,}\s*\([^)\n]{2,40}\)",
    r"\bX{3,}\s+[^\n]{1,40}?\s+X{3,}\b",
    r"\[\[[^\]\n]{2,40}\]\]",
    r"(?i)\[(?:insert\p{L}*|completar|rellenar|poner|pegar|escrib\p{L}+|fill|add|your|tu|su) [^\]\n]{1,40}\]",
    r"(?i)\[[^\]\n]{1,40} (?:aqu[ií]|here|ici|por completar|pendiente)\]",
    rf"(?i)\[falta (?:{FIELD}|\w+_\w+)\]",
    rf"\[(?:{FIELD.upper()})\]",
    rf"(?i)\[(?:{FIELD}) (?:del?|de la|of|du) [^\]\n]{{1,40}}\]",
    r"(?i)\[d{1,2}[/.-]m{1,2}[/.-][ay]{2,4}\]",
    r"«[\p{L}_]{2,40}_\d{1,3}»",
    r"(?i)«[\p{L}_]{2,40} (?:por completar|pendiente)»",
    r"\bTODO:\s*\p{Ll}",
    r"\b(?:FIXME|TBD):",
)
# what every placeholder has; a text without it needs no look at each pattern
SIGNS = r"[{%<@#$_\[]|X{3}|(?i:completar|pendiente)»|TODO:|FIXME:|TBD:"
FILLER = (
    r"\b(\p{L}{2,})(?:[\s,.]+\1\b){2}",
    r"\b(?:texto|p[aá]rrafo|t[ií]tulo|pie de foto|columna) (?:simulad[oa]|fingid[oa]|de (?:relleno|ejemplo|prueba|muestra))\b",
    r"(?:^|[.\n])\s*aqu[ií] va (?:el|la|un|una) (?:texto|t[ií]tulo|entradilla|foto|pie)",
    r"\b(?:sustituya|reemplace|cambie|borre) est[ea] (?:p[aá]rrafo|texto|l[ií]nea|frase)",
    r"\b(?:placeholder|dummy|sample|filler) (?:text|paragraph)\b",
    r"\b(?:faux texte|texte d'exemple|texte de remplissage)\b",
    r"\blorem ipsum\b",
    r"\b(?:asdf|qwer|qwerty|hjkl|jkl[ñ;]|zxcv)\p{L}*(?:\s+(?:asdf|qwer|qwerty|hjkl|jkl[ñ;]|zxcv)\p{L}*){2}",
    r"\bx{3,}(?:\s+x{3,}){2}",
)
FUNCTION = (
    "a|al|ante|bajo|con|contra|cuando|de|del|desde|donde|e|el|ella|en|entre|era|es|esta|este|la|las|le|les|lo|los|más|mi|"
    "muy|ni|no|nuestra|nuestro|o|para|pero|por|que|se|según|ser|si|sin|sobre|son|su|sus|tras|un|una|y|ya|aquel|aquella|"
    "the|of|and|to|is|was|for|on|with|as|by|at|from|that|near|l|d|du|des|les|est|dans|par|près|sur|une|depuis|vers|sans"
)


def _alternatives(words: str) -> str:
    """The words as one pattern that looks at each first letter once."""
    by: dict[str, list[str]] = {}
    for w in words.split("|"):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, reverse=True))})" for c, rest in sorted(by.items()))


# a run of lower-case words without a function word
WORDLESS = rf"(?:(?<![\p{{L}}\p{{M}}])(?!(?:{_alternatives(FUNCTION)})(?![\p{{L}}\p{{M}}]))\p{{Ll}}{{2,}}[ ,\n]{{1,3}}){{9}}\p{{Ll}}{{2,}}"

STRONG = (
    r"\b(?:active|activ\p{L}+|habilit\p{L}+|enable|activez|necesita|requiere|precisa|pide|desactivad\p{L}+|funciona|muestra|requires?|needs?)\b.{0,60}\b(?:javascript|js|scripts?|cookies)\b",
    r"\b(?:javascript|js|scripts?|cookies)\b.{0,60}\b(?:active|activ\p{L}+|habilit\p{L}+|enabled?|necesari\p{L}+|required|desactivad\p{L}+|disabled)\b",
    r"\b(?:http )?[45]\d\d\b.{0,5}\b(?:bad|gateway|not|forbidden|unavailable|service|internal|too|gone|unauthorized|timeout|request|servicio|p[aá]gina|error|no)\b",
    r"\b(?:error|c[oó]digo|http|status)[ :]{1,2}[45]\d\d\b",
    r"\b(?:not found|bad gateway|forbidden|service unavailable|gateway timeout|too many requests|internal server error|request rejected|access denied|acceso denegado)\b",
    r"\b(?:no|sin) (?:encontrad[oa]|disponible|existe|responde)\b",
    r"\b(?:no (?:he|hemos) recibido|no puedo|no podemos|no me es posible|no es posible|cannot|can't|unable to|je ne peux pas)\b.{0,60}\b(?:im[aá]gen(?:es)?|image|transcri\p{L}+|leer|cubierta|p[aá]gina|lectura)\b",
    r"\b(?:imagen|image|fotograf[ií]a|p[aá]gina)\b.{0,40}\b(?:no contiene texto|vac[ií]a|carece de|no se encuentra|contains no text)\b",
    r"\b(?:no est[aá] disponible|ha(?:n)? cambiado de direcci[oó]n|tard[oó] demasiado|no responde|no pudo abrirse|ha caducado|en mantenimiento)\b",
    r"\b(?:como asistente|as an ai|as a language model|adjunte la|vuelva a subir)",
    r"\b(?:requiere|precisa|necesita|requires) (?:una |a )?(?:sesi[oó]n|session|login|identificaci[oó]n|iniciar)\b",
    r"\b(?:fue|ha sido|han sido|was|has been) (?:retirad|movid|eliminad|borrad|trasladad\p{L}+ de direcci|bloquead|removed|moved|deleted|blocked)",
)
# stems one of which stands in every text that STRONG hits
STEMS = (
    r"javascript|\b(?:js|scripts?|cookies)\b|\b[45]\d\d\b|not found|gateway|forbidden|unavailable|too many requests|internal server|request rejected|"
    r"access denied|denegado|(?:no|sin) (?:encontrad|disponible|existe|responde)|no (?:he|hemos) recibido|no pued|no podemos|es posible|cannot|can't|unable to|"
    r"ne peux pas|no contiene|vac[ií]a|carece de|no se encuentra|contains no|no est[aá] disponible|cambiado de direcci|tard[oó] demasiado|no pudo abrirse|ha caducado|"
    r"en mantenimiento|como asistente|as an ai|language model|adjunte la|vuelva a subir|sesi[oó]n|session|login|identificaci|iniciar|"
    r"retirad|movid|eliminad|borrad|trasladad|bloquead|removed|moved|deleted|blocked"
)
# sentences that report what somebody said, wrote or read
REPORTED = r"(?U)(?:^|(?<=[.!?\n]))[^.!?\n]*?\b(?:dec[ií]an?|rezaba|dijo|dijeron|respondi[oó]|lament[oó]|escribi[oó]|escrito|cuenta|contaba|rieron|anunciaba|le[ií]a|said|read)\b[^.!?\n]*"
WEAK = (
    r"\b(?:lo sentimos|disculpe|sorry|oops|d[ée]sol[ée])\b", r"\b(?:error|fallo|incidencia|warning|aviso)\b",
    r"\b(?:servidor|server|nginx|apache|pasarela|gateway|base de datos|repositorio|navegador|browser|visor|enlace|url)\b",
    r"\b(?:p[aá]gina|documento|fichero|archivo|n[uú]mero|colecci[oó]n|sesi[oó]n|petici[oó]n|request)\b.{0,60}\b(?:solicitad\p{L}+|busca|retirad\p{L}+|movid\p{L}+|caducad\p{L}+|mantenimiento|disponible|rechazad\p{L}+|existe|abrirse|encuentra|encontrado)\b",
    r"\b(?:reintent\p{L}+|int[eé]ntelo|try again|vuelva a|recargue|reload|refresh|espere|wait|volveremos|m[aá]s tarde|later)\b",
    r"\b(?:no se pudo|no pudo|could not|couldn't|tard[oó] demasiado|timed? out|tiempo de espera|ha caducado|no responde|vac[ií]a|mantenimiento|demasiad[oa]s peticiones|unavailable|denied|denegado|identif[ií]quese|vuelva a identificarse)\b",
    r"\b(?:javascript|scripts?|cookies)\b", r"\b(?:transcri\p{L}+|asistente|assistant|adjunt\p{L}+)\b",
    r"\b(?:c[oó]digo|code|ref\.?|support id|identificador|incidencia|http|petici[oó]n)[ :.]{0,3}\(?(?:de la petici[oó]n: )?\d+",
)


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [c.rlike(p) for p in patterns])


def _hits(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [c.rlike(p).cast("int") for p in patterns])


def _unquoted(low: Column) -> Column:
    return F.regexp_replace(low, r"«[^«»\n]*»|“[^“”\n]*”", "«»")


def _masked(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\p{Nd}+", "#")


def responses(docs: DataFrame) -> DataFrame:
    """(doc_id, h): rows (by hash of the text) of nothing but lines that SHARED documents of more than one source have in common."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), _masked), lambda x: x.rlike(r"\p{L}")), lambda x: F.xxhash64(x)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("source", F.lit("")).alias("source"), lines.alias("k"))
    each = rows.select("doc_id", "h", "source", F.size("k").alias("n"), F.explode("k").alias("k"))
    seen = each.groupBy("k").agg(F.count(F.lit(1)).alias("of"), F.min("source").alias("a"), F.max("source").alias("b"))
    shared = seen.where((F.col("of") >= SHARED) & (F.col("a") < F.col("b"))).select("k")
    met = each.select("doc_id", "h", "n", "k").join(shared, "k").groupBy("doc_id", "h", "n").agg(F.countDistinct("k").alias("met"))
    return met.where("met = n").select("doc_id", "h").distinct()


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, hueco, relleno, aviso): the documents with at least one of the three."""
    docs = documents.select("doc_id", "text", "source", "publicacion").where(F.col("text").rlike(r"\p{L}"))
    # bound to a lambda variable, what is made of a text is made once and not once a pattern
    filler = F.exists(F.array(_unquoted(F.lower("text"))), lambda x: _any(x, tuple("(?U)" + p for p in FILLER)))
    lower = F.when(F.col("text").rlike(r"\p{Ll}"), F.col("text")).otherwise(F.lower("text"))
    marked = docs.select(
        "doc_id",
        (F.col("text").rlike(SIGNS) & _any(F.col("text"), PLACEHOLDERS)).alias("hueco"),
        (filler | lower.rlike(WORDLESS)).alias("relleno"),
        F.lit(False).alias("aviso"),
    )
    found = marked.where("hueco or relleno").unionByName(notices(docs))
    return found.groupBy("doc_id").agg(*(F.bool_or(c).alias(c) for c in ("hueco", "relleno", "aviso")))


def _terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, hueco, relleno, aviso) of the notices."""
    low = F.lower("text")
    # at least SHORT + 1 words; the pattern stops there
    short = ~F.col("text").rlike(rf"^[^\p{{L}}\p{{Nd}}]*+(?:[\p{{L}}\p{{Nd}}]++[^\p{{L}}\p{{Nd}}]++){{{SHORT}}}[\p{{L}}\p{{Nd}}]")
    title = F.substring_index(F.trim("text"), "\n", 1)
    rest = F.lower(F.substring(F.trim("text"), F.length(title) + 1, F.length("text")))
    lacks = lambda words, body: F.forall(words, lambda w: F.instr(body, w) == 0)
    slug = _terms(F.concat_ws(" ", "publicacion", F.translate("source", "_", " ")))
    strange = lambda x: lacks(slug, x) & F.exists(F.array(rest), lambda r: ~r.rlike(r"\p{L}") | lacks(_terms(title), r))
    strong, weak = (tuple("(?U)" + p for p in x) for x in (STRONG, WEAK))

    def evidence(told: Column) -> Column:
        """weak terms, and whether the text tells by itself."""
        sentences = F.filter(F.split(told, r"[.!?]+"), lambda x: x.rlike(r"\p{L}"))
        dense = F.exists(F.array(sentences), lambda s: F.size(F.filter(s, lambda x: _any(x, strong + weak))) * 2 > F.size(s))
        few = F.struct(_hits(told, strong).alias("s"), _hits(told, weak).alias("w"))
        brief = F.transform(F.array(few), lambda n: F.struct(n["w"].alias("weak"), ((n["s"] > 0) | (n["w"] > 1)).alias("told")))
        full = F.array(F.struct(F.lit(0).alias("weak"), (_any(told, strong) & dense).alias("told")))
        return F.when(short, F.get(brief, F.lit(0))).otherwise(F.get(full, F.lit(0)))

    made = F.regexp_replace(F.regexp_replace(_unquoted(low), REPORTED, " "), r"\s+", " ")
    seen = F.when(short | low.rlike(STEMS), F.get(F.transform(F.array(made), evidence), F.lit(0)))
    strange = F.exists(F.array(low), strange)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), strange.alias("mismatch"), seen.alias("e"))
    judged = rows.select("doc_id", "h", "mismatch", F.coalesce("e.weak", F.lit(0)).alias("weak"), F.coalesce("e.told", F.lit(False)).alias("told"))
    shared = responses(docs).withColumn("shared", F.lit(True))
    judged = judged.join(shared, ["doc_id", "h"], "left")
    notice = F.col("told") | (F.coalesce("shared", F.lit(False)) & ((F.col("weak") > 0) | F.col("mismatch")))
    return judged.where(notice).select("doc_id", F.lit(False).alias("hueco"), F.lit(False).alias("relleno"), F.lit(True).alias("aviso"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return residue(read(spark, sf_dir, "documents")).select("doc_id")


def p10_residuo(spark, sf_dir: str) -> DataFrame:
    return residue(read(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_residuo": p10_residuo}
SQL: dict[str, str] = {}
