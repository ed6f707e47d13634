"""Problem 3: variant spellings of names, by a pigeonhole segment join.

A name is parsed into given names and surnames (persons) or head and core (organisations), whatever
their order, titles, abbreviations or nicknames; given names and heads are learned from the names
themselves, as are short forms, from names that differ in one token only. Every name then yields its shortened forms (initials, dropped
further names or surnames). Names and forms of one shape are joined: a form is cut into k + 1 segments, an inverted index
of segments is looked up with position-shifted substrings of the name, and candidates are verified by
bounded edit distance on the whole and on the parts. Complete names that agree are one entity; a
shortened name joins the entity of its nearest form if that is only one, otherwise the one that a
reviewer's new name or a common authority id points to.

Only tables bounded by construction are on the driver: given names and heads that at least one in a
hundred names have. Defined results: null, empty and letterless names are linked to none but equal ones;
repeated rows count once; ties between entities link to none; extra columns are ignored; empty tables
give no rows. Names are never compared all with all, so a surname that a third of the names share
costs no more than others.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telarium.operators.graph import components
from telarium.session import materialise, read

EDITS = 2
LEAST = 5
FORMS, SHARE = 3, 400
SEVERAL = 6  # given names of which every shortened form is made
TITLES = {"don", "dona", "dr", "dra", "lic", "gral", "mons", "prof", "sr", "sra", "srta", "ing", "cap", "cnel", "pbro"}
LINKS = {"de", "del", "la", "las", "los", "y", "e"}
# Usual Spanish pet names, for collections too small to learn short forms from (short_forms).
NICKNAMES = {
    "menchu": "carmen", "lucho": "luis", "pili": "pilar", "chucho": "jesus", "bea": "beatriz", "chole": "soledad",
    "moncho": "ramon", "colas": "nicolas", "lalo": "eduardo", "tono": "antonio", "memo": "guillermo", "chente": "vicente",
    "beto": "alberto", "chabela": "isabel", "merche": "mercedes", "quique": "enrique", "lola": "dolores",
    "concha": "concepcion", "berto": "roberto", "nacho": "ignacio", "goyo": "gregorio", "paco": "francisco",
    "pancho": "francisco", "pepe": "jose", "nando": "fernando", "tere": "teresa", "rafa": "rafael", "manolo": "manuel",
    "charo": "rosario", "chayo": "rosario", "fina": "josefina", "maruja": "maria", "mati": "matilde", "alex": "alejandro",
    "pacho": "francisco", "pepita": "josefina", "marujita": "maria", "lolita": "dolores", "pepito": "jose",
}

# Usual given names, for collections too small to learn them from.
GIVEN = set(
    "adela agustin alberto alejandro alfonso alfredo alicia amalia ana andres angel antonio arturo aurora beatriz belisario bernardo "
    "camilo carlos carmen catalina cecilia celina clara concepcion consuelo cristina daniel dario david diego dolores domingo eduardo "
    "elena elisa elvira emilia emilio enrique ernesto esteban eugenia eva federico felipe fernando francisca francisco gabriel german "
    "gloria gonzalo gregorio guillermo gustavo hernan hugo ignacio ines isabel jaime javier jesus joaquin jorge jose josefina juan juana "
    "julia julian julio laura leonor lorenzo lucia luis luisa magdalena manuel marcos margarita maria mario marta martin matilde mercedes "
    "miguel nicolas octavio oscar pablo pedro pilar rafael ramon raul ricardo roberto rodrigo rosa rosario salvador santiago sebastian "
    "silvia sofia soledad susana teresa tomas ursula vicente victor zoraida".split()
)


def plain(s: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(ch))


def tokens(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain(s))


def fold(s: str) -> str:
    """Letters that sound alike in Spanish are one."""
    s = s.replace("ll", "y").replace("qu", "k").replace("ch", "#").replace("h", "").replace("#", "ch")
    s = re.sub(r"c(?=[ei])", "s", s).replace("z", "s").replace("v", "b").replace("c", "k")
    return re.sub(r"(.)\1", r"\1", s)


def deletions(s: str, k: int) -> set[str]:
    found = {s}
    for _ in range(k):
        found |= {x[:i] + x[i + 1 :] for x in found for i in range(len(x))}
    return found


class Lexicon:
    """Given names and heads of organisations, with what is one or two slips away from them."""

    def __init__(self, given: set[str], heads: set[str], short: dict[str, str] | None = None):
        self.learned = given
        self.short = NICKNAMES | (short or {})
        self.given = given = (given | GIVEN) - set(short or {})
        self.heads = {h: h.split() for h in heads}
        words = given | {w for h in heads for w in h.split() if w not in LINKS}
        self.near: dict[str, set[str]] = {}
        for w in words:
            for x in deletions(w, 1 if len(w) < 8 else 2):
                self.near.setdefault(x, set()).add(w)
        self.words = words
        self.memo: dict[tuple[str, bool], str | None] = {}
        self.snapped: dict[str, str] = {}

    def snap(self, t: str) -> str:
        """The known word that a token is one or two slips away from, or the token; each token is looked up once."""
        if t not in self.snapped:
            if len(self.snapped) > 200_000:
                self.snapped.clear()
            self.snapped[t] = self._snap(t)
        return self.snapped[t]

    def _snap(self, t: str) -> str:
        if t in self.words or len(t) < 4:
            return t
        hits = Counter(w for x in deletions(t, 1 if len(t) < 8 else 2) for w in self.near.get(x, ()))
        best = [w for w in hits if slips(t, w) <= (1 if len(w) < 7 else 2)]
        if not best:
            return t
        best.sort(key=lambda w: (slips(t, w), w))
        return best[0] if len(best) == 1 or slips(t, best[0]) < slips(t, best[1]) else t

    def first_name(self, t: str, dot: bool) -> str | None:
        """The given name that a token stands for."""
        if (t, dot) not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[t, dot] = self._first_name(t, dot)
        return self.memo[t, dot]

    def _first_name(self, t: str, dot: bool) -> str | None:
        if t in self.short and t not in self.given:
            return self.short[t]
        if dot and len(t) > 1 and t not in self.given:
            full = [g for g in self.given if g.startswith(t)] or [g for g in self.given if g[0] == t[0] and g[-1] == t[-1] and _subsequence(t, g)]
            common = [g for g in full if g in self.learned] or full
            if len(common) == 1:
                return common[0]
        s = self.snap(t)
        if s in self.given:
            return s
        if len(t) > 7:
            for i in range(3, len(t) - 2):
                if t[:i] in self.given and t[i:] in self.given:
                    return f"{t[:i]} {t[i:]}"
        return None


def slips(a: str, b: str) -> int:
    """Edit distance in which swapped neighbours are one slip."""
    if abs(len(a) - len(b)) > 3:
        return 9
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[-1] + 1, one[j] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        two, one = one, row
    return one[-1]


def _subsequence(a: str, b: str) -> bool:
    it = iter(b)
    return all(x in it for x in a)


def parse_person(name: str, lex: Lexicon) -> tuple[list[str], list[str]]:
    """Given names (or initials) and surnames (the last may be an initial)."""

    def part(s: str) -> list[tuple[str, str | None]]:
        out: list[tuple[str, str | None]] = []
        for m in re.finditer(r"[^\W_]+\.?", plain(s)):
            t = m.group().rstrip(".")
            full = lex.first_name(t, m.group().endswith("."))
            out += [(t, None)] if full is None else [(t, x) for x in full.split()]
        while len(out) > 1 and out[0][0] in TITLES:
            out = out[1:]
        if len(out) > 2 and out[0][0] == "d" and (out[1][1] or len(out[1][0]) == 1 and len(out) > 3 and "," not in name):
            if out[1][1]:
                out = out[1:]
        return out

    left, comma, right = name.partition(",")
    if comma and tokens(left) and tokens(right):
        surnames, given = part(left), part(right)
        if surnames and surnames[0][0] == "d" and len(surnames) > 1:
            surnames = surnames[1:]
        return [x or t for t, x in given], [t for t, _ in surnames]
    all_parts = part(name)
    if not all_parts:
        return [], []
    i = 0
    while i < len(all_parts) and (all_parts[i][1] or len(all_parts[i][0]) == 1):
        i += 1
    if i:
        return [x or t for t, x in all_parts[:i]], [t for t, _ in all_parts[i:]]
    i = 0
    while i < len(all_parts) and not all_parts[i][1] and len(all_parts[i][0]) > 1:
        i += 1
    if i == 1 and len(all_parts) > 2 and len(all_parts[1][0]) == 1 and all_parts[2][1]:
        i = 2  # a surname, the initial of the other, a given name
    return [x or t for t, x in all_parts[i:]], [t for t, _ in all_parts[:i]]


def abbreviates(short: list[str], head: list[str]) -> bool:
    """Whether the tokens stand for the head: cut words in order, initials, or one acronym."""
    content = [w for w in head if w not in LINKS]
    words = [w for w in short if w not in LINKS]
    if len(words) == 1 and len(words[0]) >= 2:
        w = words[0]
        if w in ("".join(x[0] for x in content), "".join(x[0] for x in head)):
            return True
        if 2 < len(w) < 5 and len(content) > 1 and w[0] == content[0][0] and w[-1] == content[-1][0] and _subsequence(w[:-1], content[0]):
            return True
    if len(words) == len(content) + 1 and len(words[0]) == len(words[1]) == 1:
        words = [words[0] + words[1], *words[2:]]
    if len(words) != len(content):
        return False
    return all(a == b or a[0] == b[0] and len(a) < len(b) and (b.startswith(a) or a[-1] == b[-1] and _subsequence(a, b) or _subsequence(a, b) and len(a) <= 4) for a, b in zip(words, content, strict=True))


def parse_organisation(name: str, lex: Lexicon) -> tuple[list[str], str]:
    """Heads that the name may have, and its core."""
    m = re.match(r"^(.*\w.*)\((.*\w.*)\)\W*$", name, re.S)
    if m:
        front, core = [lex.snap(t) for t in tokens(m.group(2))], [lex.snap(t) for t in tokens(m.group(1))]
        heads = [h for h, w in lex.heads.items() if front == w] or [h for h, w in lex.heads.items() if abbreviates(front, w)]
        if heads:
            return heads, _core(core)
    words = [lex.snap(t) for t in tokens(name)]
    for h, w in lex.heads.items():
        if words[: len(w)] == w and len(words) > len(w):
            return [h], _core(words[len(w) :])
    for n in range(min(6, len(words) - 1), 0, -1):
        if words[n - 1] in LINKS:
            continue
        heads = [h for h, w in lex.heads.items() if abbreviates(words[:n], w)]
        if heads:
            return heads, _core(words[n:])
    return [], " ".join(words)


def _core(words: list[str]) -> str:
    while len(words) > 1 and words[0] in LINKS:
        words = words[1:]
    return " ".join(words)


def surname_units(surnames: list[str]) -> list[str]:
    """Surnames, each with the particles before it; the last token is one of its own (an initial may look like a particle)."""
    units, lead = [], []
    for i, t in enumerate(surnames):
        if t in LINKS and i < len(surnames) - 1:
            lead.append(t)
        else:
            units.append(" ".join([*lead, t]))
            lead = []
    return units


def given_forms(given: list[str]) -> list[tuple[str, ...]]:
    """The names and what they are shortened to: the first stays or is an initial, others stay, are initials or are dropped.

    Beyond SEVERAL names only leading ones are kept, and initials stand for all of them or for all but the first.
    """
    if len(given) > SEVERAL:
        initials = [g[0] for g in given]
        return list(dict.fromkeys(tuple(x[:n]) for n in range(len(given), 0, -1) for x in (given, [given[0], *initials[1:]], initials)))
    options = [[g, g[0]] if i == 0 else [g, g[0], ""] for i, g in enumerate(given)]
    return list(dict.fromkeys(tuple(x for x in row if x) for row in product(*options)))


def person_rows(given: list[str], surnames: list[str]) -> list[tuple]:
    """(shape, given, first, second, own): the name itself (own) and its shortened forms.

    Names of which no given name is known have the shape n and keep two surnames in every form.
    """
    units = surname_units(surnames)
    if not units:
        return [("X", " ".join(given), "", "", True)]

    def row(g: tuple[str, ...], u: tuple[str, ...]) -> tuple[str, str, str, str]:
        first, second = (" ".join(u[:-1]), u[-1]) if len(u) > 1 else (u[0], "")
        kinds = "".join("i" if len(x) == 1 else "g" for x in g) or "n"
        return kinds + ("-" if not second else "i" if len(second) == 1 else "s"), " ".join(g), first, second

    # the last surnames are dropped, the last that is left may be an initial
    ends = [tuple(units[:n]) for n in range(len(units), 0, -1)]
    ends = [x for u in ends for x in ([u, *((*u[:-1], i) for i in dict.fromkeys((u[-1][0], u[-1].split()[-1][0])))] if len(u) > 1 else [u])]
    own = row(tuple(given), tuple(units))
    made = [row(g, u) for g in given_forms(given) for u in ends if g or len(u) > 1]
    return [(*own, True), *((*x, False) for x in dict.fromkeys(made) if x != own)]


def short_forms(people: DataFrame, given: set[str]) -> dict[str, str]:
    """Short form -> given name, from names that differ in one token only.

    A context is a name without one of its tokens, in any order. Where names of one context have just one given name
    there, the other tokens that stand in its place count for it; where they have two, the rarer counts for the other,
    as a usual short form may have been taken for a given name. A token is a short form of a given name if it stands
    for it FORMS times and in one of SHARE of the contexts of the name at least, mostly for this one, and in a tenth of its
    own contexts (surnames stand elsewhere); so their number is bounded whatever the number of people.
    """

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s in b["nombre"]:
                t = [x for x in tokens(s or "") if x not in TITLES and x not in LINKS]
                if 1 < len(t) < 8:
                    for i, x in enumerate(t):
                        if len(x) > 1:
                            out.append((" ".join(sorted(t[:i] + t[i + 1 :])), x, x in given))
            yield pd.DataFrame(out, columns=["c", "t", "known"])

    rows = people.mapInPandas(contexts, "c string, t string, known boolean").select(F.xxhash64("c").alias("c"), "t", "known").distinct()
    rows = materialise(rows, "contextos")
    much = rows.where("known").groupBy("t").agg(F.count(F.lit(1)).alias("much"))  # a row a given name
    most = rows.where("known").join(F.broadcast(much), "t").withColumn("x", F.struct("much", "t"))
    most = most.groupBy("c").agg(F.max("x").alias("g"), F.min("x").alias("h"), F.count(F.lit(1)).alias("k"))
    whole = most.where("k = 1").select("c", F.col("g.t").alias("g"))
    met = rows.where("not known").join(whole, "c").select("t", "g").unionByName(most.where("k = 2").select(F.col("h.t").alias("t"), F.col("g.t").alias("g")))
    met = met.groupBy("t", "g").agg(F.count(F.lit(1)).alias("n"))
    met = met.join(rows.groupBy("t").agg(F.count(F.lit(1)).alias("of")), "t")
    met = met.withColumn("all", F.sum("n").over(Window.partitionBy("t")))
    size = whole.groupBy("g").agg(F.count(F.lit(1)).alias("size"))  # a row a given name
    kept = met.join(F.broadcast(size), "g").where((F.col("n") >= FORMS) & (F.col("n") * SHARE >= F.col("size")) & (F.col("n") > 0.6 * F.col("all")) & (F.col("n") * 10 >= F.col("of")))
    return {r["t"]: r["g"] for r in kept.select("t", "g").collect()}


def learn(names: DataFrame) -> Lexicon:
    """Given names and heads that one in a hundred distinct names have, from their places in the names, and short forms."""
    names = materialise(names.where("categoria in ('personas', 'organizaciones')").select("nombre", "categoria").distinct(), "conocidos")  # read five times
    people, groups = (names.where(F.col("categoria") == x).select("nombre") for x in ("personas", "organizaciones"))

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for s in b["nombre"]:
                t = [x for x in tokens(s or "") if x not in TITLES]
                if len(t) > 1 and "," not in s:
                    seen.update((x, 0 if i == 0 else 1 if i < len(t) - 1 else 2, y) for i, (x, y) in enumerate(zip(t, [*t[1:], t[0]], strict=True)) if len(x) > 2)
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["t", "p", "y", "n"])

    # a share of the people have a given name, before several different names (their number stops growing, so its bound is
    # fixed), and it stands more often first than last
    got = people.mapInPandas(places, "t string, p int, y string, n long").groupBy("t", "p", "y").agg(F.sum("n").alias("n"))
    wide = got.groupBy("t").agg(*(F.sum(F.when(F.col("p") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(3)), F.sum((F.col("p") < 2).cast("int")).alias("next"))
    size = people.count()
    least = max(LEAST, size // 100)
    rows = wide.where((F.col("n0") + F.col("n1") >= least) & (F.col("next") >= LEAST) & (F.col("n0") > F.col("n2"))).collect()
    given = {r["t"] for r in rows}

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for s in b["nombre"]:
                t = tokens((s or "").partition("(")[0])
                seen.update(" ".join(t[:n]) for n in range(2, min(6, len(t))) if t[n - 1] not in LINKS and "." not in s)
            yield pd.DataFrame(list(seen.items()), columns=["h", "n"])

    count = groups.count()
    found = groups.mapInPandas(prefixes, "h string, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, count // 100)).collect()
    by = {r["h"]: r["n"] for r in found}
    heads = {h for h, n in by.items() if not any(x.startswith(h + " ") and m > 0.5 * n for x, m in by.items())}
    heads = {h for h in heads if not any(h.startswith(x + " ") for x in heads)}
    short = short_forms(people, given)
    return Lexicon(given - set(short), heads, short)


FORM = "categoria string, nombre string, alias boolean, shape string, g string, s1 string, s2 string, own boolean, heads array<string>, c string"


def forms(names: DataFrame, lex: Lexicon) -> DataFrame:
    """One row for each name (own) and each of its shortened forms."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for nombre, categoria, text, alias in zip(b["nombre"], b["categoria"], b["texto"], b["alias"], strict=True):
                if not tokens(text):
                    out.append((categoria, nombre, alias, "X", "", "", "", True, [], nombre))
                elif categoria == "personas":
                    for shape, g, s1, s2, own in person_rows(*parse_person(text, lex)):
                        out.append((categoria, nombre, alias, shape, g, fold(s1), fold(s2), own, [], f"{g} {fold(s1)} {fold(s2)}"))
                else:
                    heads, core = parse_organisation(text, lex)
                    out.append((categoria, nombre, alias, "o", "", fold(core), "", True, heads, fold(core)))
            yield pd.DataFrame(out, columns=["categoria", "nombre", "alias", "shape", "g", "s1", "s2", "own", "heads", "c"])

    return names.mapInPandas(rows, FORM)


def blocked(keys: DataFrame) -> DataFrame:
    """(k, b, c): what must be equal of two strings that agree (kind, shape and given names), and what may differ."""
    person = F.col("shape") != "o"
    block = F.concat_ws("/", F.substring("categoria", 1, 1), "shape", "g")
    return keys.select("k", block.alias("b"), F.when(person, F.concat_ws(" ", "s1", "s2")).otherwise(F.col("c")).alias("c"))


def segment_join(left: DataFrame, right: DataFrame, k: int = EDITS) -> DataFrame:
    """(l, r, d): pairs of equal `b` (block) whose strings `c` are within k edits; left (l, b, c), right (r, b, c).

    Each key carries its string, so a candidate is verified inside the join that meets it: candidates grow faster than
    the strings and nearly all are refuted; only pairs that hold are shuffled.
    """

    def cut(n: int) -> list[tuple[int, int]]:
        size, extra = divmod(n, k + 1)
        at, out = 0, []
        for i in range(k + 1):
            m = size + (i >= k + 1 - extra)
            out.append((at, m))
            at += m
        return out

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = [[f"{block}|{len(c)}|{i}|{c[p : p + m]}" for i, (p, m) in enumerate(cut(len(c)))] for block, c in zip(b["b"], b["c"], strict=True)]
            yield pd.DataFrame({"id": b["r"], "c": b["c"], "keys": keys})

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block, c in zip(b["b"], b["c"], strict=True):
                keys = set()
                for n in range(max(0, len(c) - k), len(c) + k + 1):
                    gap = len(c) - n
                    for i, (p, m) in enumerate(cut(n)):
                        # with i errors before the segment at most, or k - i after it
                        low = max(0, p - i, p + gap - (k - i))
                        high = min(len(c) - m, p + i, p + gap + (k - i))
                        keys.update(f"{block}|{n}|{i}|{c[s : s + m]}" for s in range(low, high + 1))
                out.append(list(keys))
            yield pd.DataFrame({"id": b["l"], "c": b["c"], "keys": out})

    def keyed(side: DataFrame, x: str, keys: Callable) -> DataFrame:
        rows = side.select(x, "b", "c").mapInPandas(keys, f"id {dict(side.dtypes)[x]}, c string, keys array<string>")
        rows = rows.select("id", "c", F.explode("keys").alias("key"))
        return rows.select(F.xxhash64("key").alias("key"), F.col("id").alias(x), F.col("c").alias(f"c{x}"))

    met = keyed(left, "l", probe).join(keyed(right, "r", index), "key")  # a key has its block
    return met.select("l", "r", F.levenshtein("cl", "cr", k).alias("d")).where("d >= 0").distinct()


def _agree(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keeps pairs of strings whose parts agree too: initials exactly, known given names and surnames not exchanged."""
    p = pairs
    for x in "lr":
        seconds = known.select(F.col("s").alias(f"{x}_s2"), F.lit(True).alias(f"{x}_known"))
        p = p.join(seconds, f"{x}_s2", "left")
    both = F.coalesce("l_known", F.lit(False)) & F.coalesce("r_known", F.lit(False)) & (F.col("l_s2") != F.col("r_s2"))
    far = lambda a, b, k: F.levenshtein(a, b, k) < 0
    org = F.col("shape") == "o"
    words_l, words_r = F.split("l_g", " "), F.split("r_g", " ")
    given = F.forall(F.zip_with(words_l, words_r, lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))
    # where no given name is known, a word of six letters may have one slip, a longer one two
    all_l, all_r = (F.split(F.concat_ws(" ", f"{x}_s1", f"{x}_s2"), " ") for x in "lr")
    nameless = (F.size(all_l) == F.size(all_r)) & F.forall(F.zip_with(all_l, all_r, lambda a, b: F.levenshtein(a, b) <= F.when(F.length(a) < 7, 1).otherwise(2)), lambda near: F.coalesce(near, F.lit(False)))
    heads = F.arrays_overlap("l_heads", "r_heads") | ((F.size("l_heads") == 0) & (F.size("r_heads") == 0))
    return p.where(F.when(org, heads).otherwise(given & (~F.col("shape").startswith("n") | nameless) & ~both & ~far(F.col("l_s1"), F.col("r_s1"), 2) & ~far(F.col("l_s2"), F.col("r_s2"), 2) & ~((F.length("l_s2") == 1) & (F.col("l_s2") != F.col("r_s2")))))


def link(names: DataFrame, ids: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """(categoria, nombre, entidad): the entity of every distinct name.

    names: (nombre, categoria, nuevo); nuevo is another name given to it, or null. ids: (nombre, categoria, qid),
    the authority id that most mentions of a name have. others: (nombre, categoria), further names to learn from.
    """
    names = materialise(names.where("nombre is not null and categoria is not null").distinct(), "nombres")
    seen = names.select("nombre", "categoria").unionByName(names.select(F.col("nuevo").alias("nombre"), "categoria").where("nombre is not null"))
    lex = learn(seen if others is None else seen.unionByName(others.select("nombre", "categoria").distinct()))
    texts = names.select("nombre", "categoria", F.col("nombre").alias("texto"), F.lit(False).alias("alias")).distinct().unionByName(
        names.where("nuevo rlike '\\\\p{L}' and nuevo <> nombre").select("nombre", "categoria", F.col("nuevo").alias("texto"), F.lit(True).alias("alias"))
    )
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # rows are few, but each of some work
    # k: distinct strings of the names themselves, and of forms
    key = F.xxhash64("categoria", "shape", "c", F.array_join("heads", "|"))
    rows = materialise(forms(texts.repartition(parts, "nombre"), lex).withColumn("k", key), "formas")
    parts = ["shape", "g", "s1", "s2", "heads"]
    own = rows.where("own").groupBy("k").agg(*(F.min(x).alias(x) for x in ["categoria", "c", *parts]))
    made = rows.where("not alias or own").groupBy("k").agg(*(F.min(x).alias(x) for x in ["categoria", "c", *parts]))
    own, made = materialise(own, "propias"), materialise(made, "hechas")
    left = blocked(own.where("shape <> 'X'")).select(F.col("k").alias("l"), "b", "c")
    right = blocked(made.where("shape <> 'X'")).select(F.col("k").alias("r"), "b", "c")
    near = segment_join(left, right)
    near = near.join(own.select(F.col("k").alias("l"), "shape", *(F.col(x).alias(f"l_{x}") for x in parts[1:])), "l")
    near = near.join(made.select(F.col("k").alias("r"), *(F.col(x).alias(f"r_{x}") for x in parts[1:])), "r")
    known = rows.where("own and length(s2) > 1").groupBy(F.col("s2").alias("s")).agg(F.countDistinct("s1").alias("n")).where("n >= 4").select("s")
    near = materialise(_agree(known, near).select("l", "r", "d"), "cercanas")

    # complete names of one shape that agree are one entity
    node = F.concat_ws("\u0001", "categoria", "nombre")
    mine = rows.where("own and not alias").select(node.alias("id"), "k", "shape")
    of_key = mine.select("k", "id").groupBy("k").agg(F.min("id").alias("id"))
    same = near.join(of_key.select(F.col("k").alias("l"), F.col("id").alias("a")), "l").join(of_key.select(F.col("k").alias("r"), F.col("id").alias("b")), "r")
    edges = same.where("a <> b").select("a", "b").unionByName(mine.join(of_key.withColumnRenamed("id", "a"), "k").where("id <> a").select("a", F.col("id").alias("b"))).distinct()
    base = materialise(components(edges, mine.select("id").distinct()), "base")

    # shortened names join the entity of their nearest form
    source = rows.where("not own and not alias").select(node.alias("from"), F.col("k").alias("r"))
    parents = source.join(base.withColumnRenamed("id", "from").withColumnRenamed("clase", "parent"), "from").select("r", "parent").distinct()
    children = rows.where("own").select(node.alias("id"), "alias", F.col("k").alias("l")).join(near, "l").join(parents, "r")
    children = children.join(base, "id").where("parent <> clase").groupBy("clase", "parent").agg(F.min(F.when(~F.col("alias"), F.col("d"))).alias("d"), F.min(F.when(F.col("alias"), F.col("d"))).alias("da"))
    # an alias may also be a complete name itself
    complete = rows.where("own and alias").select(node.alias("id"), F.col("k").alias("l")).join(near, "l").join(mine.select(F.col("k").alias("r"), F.col("id").alias("other")), "r")
    complete = complete.join(base, "id").join(base.select(F.col("id").alias("other"), F.col("clase").alias("parent")), "other").where("parent <> clase")
    complete = complete.groupBy("clase", "parent").agg(F.lit(None).cast("int").alias("d"), F.min("d").alias("da"))
    offers = children.unionByName(complete).groupBy("clase", "parent").agg(F.min("d").alias("d"), F.min("da").alias("da"))
    if ids is not None:
        q = ids.select(F.concat_ws("\u0001", "categoria", "nombre").alias("id"), "qid").join(base, "id").groupBy("clase", "qid").agg(F.count(F.lit(1)).alias("n"))
        q = q.groupBy("clase").agg(F.max_by("qid", F.struct("n", "qid")).alias("qid"))
        size = base.groupBy("clase").agg(F.count(F.lit(1)).alias("size"))
        q = materialise(q.join(size, "clase"), "autoridad")
        head = q.groupBy("qid").agg(F.max_by("clase", F.struct("size", "clase")).alias("parent"))
        agreed = q.join(head, "qid").where("clase <> parent").select("clase", "parent", F.lit(1).alias("q"))
    else:
        agreed = offers.select("clase", "parent", F.lit(1).alias("q")).limit(0)
    offers = materialise(offers.join(agreed, ["clase", "parent"], "full_outer"), "ofertas")
    # a shortened name that has a longer one itself is nobody's parent
    short = offers.where("d is not null").select(F.col("clase").alias("parent")).distinct()
    offers = offers.join(short, "parent", "left_anti")
    complete_shape = mine.join(base, "id").groupBy("clase").agg(F.max(F.col("shape").rlike("^(g+s|o)$")).alias("full"))
    rank = Window.partitionBy("clase").orderBy("rank")
    score = F.when(F.col("d").isNotNull(), F.col("d") * 4 - 2 * F.coalesce("q", F.lit(0)) - F.col("da").isNotNull().cast("int")).when(F.col("da").isNotNull(), 20 + F.col("da")).otherwise(40)
    best = offers.withColumn("rank", score).withColumn("best", F.min("rank").over(Window.partitionBy("clase"))).where("rank = best")
    chosen = best.groupBy("clase", "best").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).where("n = 1")
    chosen = chosen.join(complete_shape, "clase").where("best < 20 or not full").select("clase", "parent")
    up = chosen.select(F.col("clase").alias("a"), F.col("parent").alias("b"))
    roots = materialise(components(up, base.select(F.col("clase").alias("id")).distinct()), "raices")
    out = base.join(roots.select(F.col("id").alias("clase"), F.col("clase").alias("entidad")), "clase")
    return out.select(F.split("id", "\u0001")[0].alias("categoria"), F.substring_index("id", "\u0001", -1).alias("nombre"), "entidad")


def authority_ids(entities: DataFrame) -> DataFrame:
    """(nombre, categoria, qid) where at least two mentions and half of those with an id agree."""
    seen = entities.where("wikidata_id <> ''").groupBy(F.col("texto").alias("nombre"), "categoria", F.col("wikidata_id").alias("qid")).agg(F.count(F.lit(1)).alias("n"))
    best = seen.groupBy("nombre", "categoria").agg(F.max_by("qid", F.struct("n", "qid")).alias("qid"), F.max("n").alias("n"), F.sum("n").alias("all"))
    return best.where("n >= 2 and 2 * n > all").select("nombre", "categoria", "qid")


def p3_found(spark, sf_dir: str) -> DataFrame:
    reviewed = read(spark, sf_dir, "revision_entidades").where("categoria in ('personas', 'organizaciones')")
    names = reviewed.select("nombre", "categoria", F.col("nombre_nuevo").alias("nuevo"))
    mentions = read(spark, sf_dir, "entidades")
    met = mentions.where("categoria in ('personas', 'organizaciones')").select(F.col("texto").alias("nombre"), "categoria")
    found = materialise(link(names, authority_ids(mentions), met), "entidades")
    a, b = (found.select("entidad", "categoria", F.col("nombre").alias(f"nombre_{x}")) for x in "ab")
    return a.join(b, ["entidad", "categoria"]).where("nombre_a < nombre_b").select("categoria", "nombre_a", "nombre_b")


def p3_grupos(spark, sf_dir: str) -> DataFrame:
    """The entity of every spelling in entidades and revision_entidades."""
    reviewed = read(spark, sf_dir, "revision_entidades").select("nombre", "categoria", F.col("nombre_nuevo").alias("nuevo"))
    mentions = read(spark, sf_dir, "entidades")
    met = mentions.select(F.col("texto").alias("nombre"), "categoria", F.lit(None).cast("string").alias("nuevo"))
    names = reviewed.unionByName(met).where("categoria in ('personas', 'organizaciones')")
    return link(names, authority_ids(mentions))


QUERIES = {"p3_found": p3_found, "p3_grupos": p3_grupos}
SQL: dict[str, str] = {}
