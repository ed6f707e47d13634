"""Problem 7: noise in text from scanned pages, repaired by averaged perceptrons.

A page becomes lines with features of their place on the page. Three averaged perceptrons are trained on a
bounded sample of pages that have a cleaned layer (TRAIN_PAGES): one for the kind of a line (text, running
header, page number), one for line joins, one that edits the characters of words (keep, or a
replacement, deletion or insertion learned from the sample). Names of running headers come from all pages:
a heading is furniture if it mostly stands on the first line or between two lines of text; a page gets the
names among its own headings by a join. The lexicon counts the cleaned layers of all pages; it reaches the
executors as bit tables of fixed size (2^BITS bits), one for each of the counts LEVELS, which can take a word
for a more frequent one and nothing else. Cleaned layers are not free of faults: a word of any count may be a
slip for one that stands GAP levels higher (more than 16 times as frequent).

Defined results: null and empty raw texts give no lines; blank lines are counted and have no kind; pages
with a cleaned layer are not judged; repeated rows are judged each; very long pages are read once, line by
line; extra columns are ignored; empty tables, and tables without any cleaned layer, give what the rules
of form alone tell (page numbers) and no joins or characters without evidence.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.session import materialise, read

TRAIN_PAGES = 1500
BITS = 23
KNOWN, COMMON = 3, 40
LEVELS = (KNOWN, 10, *(COMMON * 4**i for i in range(10)))
GAP = 3
EPOCHS = 4

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
TOKEN = re.compile(r"[^\s«»¿?¡!()\[\]\"“”;:,.…]+")
HYPHENS = "-¬—–­"
DATE = re.compile(r"^[^,\d]{3,48}, \d{1,2} de \w+ de \d{4}$")
FOLIO = re.compile(r"^\W*(?:p[aá]g(?:ina|s)?\.?\s*|p\.\s*|n[uú]m\.\s*|fol(?:io)?\.\s*)?[\dlIOo]{1,3}\W*$", re.I)
SPACED = re.compile(r"^\s*(?:\S\s+){3,}\S\s*$")


class Perceptron:
    """Averaged multiclass perceptron over named features."""

    def __init__(self) -> None:
        self.w: dict[tuple, float] = defaultdict(float)
        self.total: dict[tuple, float] = defaultdict(float)
        self.at: dict[tuple, int] = defaultdict(int)
        self.t = 0

    def score(self, features: list, label: str) -> float:
        w = self.w
        return sum(w.get((f, label), 0.0) for f in features)

    def _add(self, key: tuple, v: float) -> None:
        self.total[key] += (self.t - self.at[key]) * self.w[key]
        self.at[key] = self.t
        self.w[key] += v

    def learn(self, gold: tuple[list, str], guess: tuple[list, str]) -> None:
        self.t += 1
        if gold != guess:
            for f in gold[0]:
                self._add((f, gold[1]), 1.0)
            for f in guess[0]:
                self._add((f, guess[1]), -1.0)

    def average(self) -> None:
        for key in list(self.w):
            self._add(key, 0.0)
            self.w[key] = self.total[key] / max(1, self.t)
        self.w = {k: v for k, v in self.w.items() if abs(v) > 1e-9}
        self.total, self.at = {}, {}


class Bits:
    """Words of each count of LEVELS as tables of fixed size."""

    def __init__(self, tables: list[np.ndarray]):
        self.tables = tables
        self.seen: dict[str, int] = {}

    def level(self, w: str) -> int:
        """How many of LEVELS the count of the word reaches; 0 for unknown words."""
        got = self.seen.get(w)
        if got is None:
            places = positions(w)
            got = 0
            for table in self.tables:
                if not all(table[p >> 3] >> (p & 7) & 1 for p in places):
                    break
                got += 1
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[w] = got
        return got

    def rank(self, w: str) -> int:
        """0 unknown, 1 known, 2 common."""
        got = self.level(w)
        return (got > 0) + (got > LEVELS.index(COMMON))

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "seen": {}}


def positions(w: str) -> tuple[int, int, int]:
    data, m = w.encode(), (1 << BITS) - 1
    a, b = zlib.crc32(data), zlib.adler32(data) * 2654435761 + zlib.crc32(data, 77)
    return a & m, b & m, (a + 3 * b >> 5) & m


def lexicon(pages: DataFrame) -> Bits:
    """Words of the cleaned layers by how often they occur, as bit tables."""
    text = F.lower(F.col("texto_limpio"))
    compounds, simple = (F.regexp_extract_all(text, F.lit(p), 1) for p in (r"(\p{L}+(?:-\p{L}+){1,4})", r"(\p{L}+)"))
    words = pages.where("texto_limpio is not null").select(F.explode(F.concat(compounds, simple)).alias("w"))
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= KNOWN)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, int], int] = defaultdict(int)
        for b in batches:
            for w, n in zip(b["w"], b["n"], strict=True):
                for p in positions(w):
                    for level in range(sum(n >= x for x in LEVELS)):
                        acc[level, p >> 5] |= 1 << (p & 31)
        yield pd.DataFrame([(k[0], k[1], v) for k, v in acc.items()], columns=["level", "i", "b"])

    got = counts.mapInPandas(bits, "level int, i long, b long").groupBy("level", "i").agg(F.bit_or("b").alias("b")).toArrow()
    tables = []
    for level in range(len(LEVELS)):
        table = np.zeros(1 << (BITS - 5), np.uint32)
        mask = got.column("level").to_numpy() == level
        table[got.column("i").to_numpy()[mask]] = got.column("b").to_numpy()[mask].astype(np.uint32)
        tables.append(table.view(np.uint8))
    return Bits(tables)


def core(line: str) -> str | None:
    """The name in a line that has the form of a heading, its letters folded; None for other lines."""
    s = line.strip()
    if not 4 <= len(s) <= 90 or not (s.upper() == s and re.search(r"[^\W\d_]{2}|[^\W\d_] [^\W\d_]", s) or " — " in s or " · " in s or DATE.match(s)):
        return None
    if SPACED.match(s):
        s = re.sub(r"\s+", "", s)
    s = re.sub(r"(?<=[^\W\d_])[015]|[015](?=[^\W\d_])", lambda m: "OIS"[("0", "1", "5").index(m.group())], s)
    for part in re.split(r"[/—–·,|]|\.\s|\d+", s):
        letters = re.sub(r"[\W\d_]", "", part).upper().replace("L", "I").replace("1", "I")
        if len(letters) >= 4:
            return letters
    return None


def headers(pages: DataFrame) -> DataFrame:
    """(c): names of running headers and stamps, from the places of headings on all pages."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, list[int]] = {}
        for b in batches:
            for text in b["texto_crudo"]:
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    if len(line) <= 90 and (c := core(line)):
                        s = acc.setdefault(c, [0, 0])
                        s[0] += 1
                        s[1] += k == 0 or (0 < k < len(lines) - 1 and bool(lines[k - 1].strip()) and bool(lines[k + 1].strip()))
        yield pd.DataFrame([(k, *v) for k, v in acc.items()], columns=["c", "n", "f"])

    got = pages.where("texto_crudo is not null").select("texto_crudo").mapInPandas(rows, "c string, n long, f long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    return materialise(got.where((F.col("n") >= KNOWN) & (F.col("f") * 2 >= F.col("n"))).select("c"), "cabeceras")


def headings(text: str) -> set[str]:
    return {c for line in text.split("\n") if len(line) <= 90 and (c := core(line))}


def with_names(pages: DataFrame, names: DataFrame) -> DataFrame:
    """Adds `names`: those among the headings of the page, found by a join."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, c) for i, text in zip(b["id"], b["texto_crudo"], strict=True) for c in headings(text)]
            yield pd.DataFrame(out, columns=["of", "c"])

    found = pages.select("id", "texto_crudo").mapInPandas(rows, "of long, c string").join(names, "c").groupBy("of").agg(F.collect_set("c").alias("names"))
    return pages.join(found, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "texto_crudo", "names")


def line_features(lines: list[str], k: int, names: set[str]) -> list:
    """Form of a line and its place on the page."""
    s = lines[k].strip()
    c = core(s)
    before = bool(k) and bool(lines[k - 1].strip())
    after = k + 1 < len(lines) and bool(lines[k + 1].strip())
    place = "first" if k == 0 else "second" if k == 1 else "last" if k == len(lines) - 1 else "inner"
    named, folio = c in names, bool(FOLIO.match(s))
    return ["bias", f"place={place}", f"near={before},{after}", f"name={named}", f"folio={folio}", f"named,place={named},{place}", f"heading={c is not None}", f"len={min(len(s) // 10, 7)}"]


def broken(left: str, right: str, bits: Bits) -> list:
    """Features of joining the last token of a line with the first of the next."""
    mark = left[-1:] in HYPHENS
    a, b = left.rstrip(HYPHENS).lower(), right.lower()
    tail = re.match(r"[^\W\d_]+(?:-[^\W\d_]+)*", b)
    b = tail.group() if tail else b
    j, hyphened = bits.rank(a + b), bits.rank(f"{a}-{b}")
    la, lb = bits.rank(a), bits.rank(b)
    return [
        "bias", f"mark={mark}", f"mark,j={mark},{j}", f"mark,h={mark},{hyphened > 0}", f"mark,a,b={mark},{la},{lb}", f"mark,j,a,b={mark},{j},{la},{lb}", f"mark,j,h={mark},{j > 0},{hyphened > 0}",
        f"mark,upper={mark},{right[:1].isupper()}", f"mark,short={mark},{len(a) < 3}", f"mark,end={mark},{bool(tail)}",
    ]


def edits(w: str, ops: dict[str, list[str]], bits: Bits) -> list[tuple[str, str, int]]:
    """(word, operation, place) of the known words, GAP levels more frequent than a known w, that one learned operation makes of w."""
    out = []
    own = bits.level(w)
    least = own + GAP if own else 1
    for i in range(len(w)):
        for n in (1, 2):
            for right in ops.get(w[i : i + n], ()) if i + n <= len(w) else ():
                v = w[:i] + right + w[i + n :]
                if bits.level(v) >= least:
                    out.append((v, f"{w[i : i + n]}>{right}", i))
    return out


def edit_features(w: str, v: str, op: str, i: int, bits: Bits) -> list:
    odd, own, known = not w.isalpha(), bits.level(w), bits.rank(v)
    out = ["bias", f"op={op}", f"op,prev={op},{w[i - 1 : i]}", f"op,next={op},{w[i + 1 : i + 2]}", f"known={known}", f"known,odd={known},{odd}", f"odd={odd}", f"len={min(len(w), 10)}", f"first={i == 0}"]
    return [*out, "own", f"own,gap={min(bits.level(v) - own, 7)}", f"own,op={op}"] if own else out


class Editor:
    """The trained models and what they need; sent to the executors by broadcast."""

    def __init__(self, bits: Bits, names: set[str]):
        self.bits, self.names = bits, names
        self.kind, self.join, self.char = Perceptron(), Perceptron(), Perceptron()
        self.ops: dict[str, list[str]] = {}
        self.cache: dict[str, int | None] = {}
        self.meant: dict[str, tuple[str, int] | None] = {}

    def kinds(self, lines: list[str]) -> list[str]:
        """'' for blank lines and text, 'cabecera' or 'folio' for furniture."""
        out = []
        for k, line in enumerate(lines):
            s = line.strip()
            if not s or len(s) > 90 or not (FOLIO.match(s) or core(s)):
                out.append("")
                continue
            f = line_features(lines, k, self.names)
            best = max(("", "cabecera", "folio"), key=lambda x: self.kind.score(f, x))
            out.append(best)
        return out

    def is_broken(self, left: str, right: str) -> bool:
        if not left or not right or not left.rstrip(HYPHENS)[-1:].isalnum() or not right[:1].isalnum():
            return False
        return self.join.score(broken(left, right, self.bits), "join") > 0

    def correct(self, w: str) -> tuple[str, int] | None:
        """The word meant by a word that is unknown or far rarer, and the place of the slip."""
        low = w.lower()
        if len(low) < 3:
            return None
        if low not in self.meant:
            if len(self.meant) > 500_000:
                self.meant.clear()
            best, top = None, 0.0
            for v, op, i in edits(low, self.ops, self.bits):
                s = self.char.score(edit_features(low, v, op, i, self.bits), "edit")
                if s > top:
                    best, top = (v, i), s
            self.meant[low] = best
        return self.meant[low]

    def slip(self, w: str) -> int | None:
        """Place of a misrecognised character in a token: a symbol or digit among letters, or a learned slip."""
        if len(w) > 2 and (m := re.search(r"(?<=[^\W\d_])[\d@#$%&*|/\\{}~^+=<>_]+(?=[^\W\d_])|^[@#$%&*|\\{}~^+=<>_](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[\d@#$%&*|\\{}~^+=<>_]$|^\d(?=[^\W\d_]{3})", w)):
            return m.start()
        got = None
        for part in WORD.finditer(w):
            if (c := self._cached(part.group())) is not None:
                got = part.start() + c
                break
        return got

    def _cached(self, w: str) -> int | None:
        low = w.lower()
        if low not in self.cache:
            if len(self.cache) > 500_000:
                self.cache.clear()
            parts = [low] if self.bits.level(low) or "-" not in low else low.split("-")
            found = None
            for p in parts:
                if c := self.correct(p):
                    found = low.index(p) + c[1]
                    break
            self.cache[low] = found
        return self.cache[low]


def body(lines: list[str], kinds: list[str]) -> list[int]:
    """Numbers of the lines of text."""
    return [k for k, line in enumerate(lines) if line.strip() and not kinds[k]]


def ends(line: str) -> tuple[str, str]:
    t = line.split()
    return (t[0], t[-1]) if t else ("", "")


def _clean(t: str) -> str:
    return t.strip("«»¿?¡!()[]\"“”;:,.…")


def judge(text: str, ed: Editor) -> list[tuple[int, str]]:
    """(line, kind) of a page, lines counted from 1."""
    lines = text.split("\n")
    kinds = ed.kinds(lines)
    out = [(k + 1, kind) for k, kind in enumerate(kinds) if kind]
    text_lines = body(lines, kinds)
    cut: dict[int, str] = {}
    for k, after in zip(text_lines, text_lines[1:], strict=False):
        left, right = ends(lines[k])[1], ends(lines[after])[0]
        if ed.is_broken(left.lstrip("«¿¡(\"“["), right):
            out.append((k + 1, "corte"))
            cut[k] = right
    faulty = set()
    tail = ""
    for n, k in enumerate(text_lines):
        tokens = TOKEN.findall(lines[k])
        if not tokens:
            tail = ""
            continue
        whole = None
        if k in cut and tokens:
            left = tokens[-1].rstrip(HYPHENS)
            joined = left + _clean(cut[k])
            place = ed.slip(joined)
            if place is not None:
                faulty.add(k if place < len(left) else text_lines[n + 1])
            whole = tokens.pop()
        if tail and tokens:
            tokens = tokens[1:]
        tail = whole or ""
        if any(ed.slip(t.strip(HYPHENS)) is not None for t in tokens):
            faulty.add(k)
    return out + [(k + 1, "caracter") for k in faulty]


def repair(text: str, ed: Editor) -> str:
    """Continuous paragraphs: furniture dropped, broken words joined, slips of learned kinds corrected."""
    lines = text.split("\n")
    kinds = ed.kinds(lines)
    text_lines = body(lines, kinds)
    out, glue = "", ""
    for k, after in zip(text_lines, [*text_lines[1:], None], strict=False):
        line = " ".join(lines[k].split())
        blank = after is not None and any(not lines[j].strip() for j in range(k + 1, after))
        out += glue + line
        right = ends(lines[after])[0] if after is not None else ""
        last = ends(line)[1].lstrip("«¿¡(\"“[")
        if after is not None and ed.is_broken(last, right):
            out, glue = out.rstrip(HYPHENS), ""
        elif last[-1:] == "-" and after is not None:
            glue = ""
        elif blank and out.rstrip("»\"”")[-1:] in ".?!:…":
            glue = "\n\n"
        else:
            glue = " " if not blank or line[-1:] not in ".?!" else "\n\n"
    return re.sub(r"[^\W_]*[\d@#]?[^\W\d_]+[\d@#]?[^\W_]*", lambda m: _meant(m.group(), ed), out)


def _meant(w: str, ed: Editor) -> str:
    c = ed.correct(w) if w.lower() != w.upper() else None
    if not c:
        return w
    return c[0].capitalize() if w[:1].isupper() else c[0]


def train(sample: list[tuple[str, str]], bits: Bits, names: set[str]) -> Editor:
    """The three models from (raw, cleaned) pages."""
    ed = Editor(bits, names)
    line_cases, join_cases, pairs, kept = [], [], Counter(), Counter()
    for raw, clean in sample:
        lines = raw.split("\n")
        words = {x.lower() for x in WORD.findall(clean)}
        halves = {h for w in words for h in w.split("-")}
        kinds = []
        for k, line in enumerate(lines):
            s = line.strip()
            if not s or not (FOLIO.match(s) or core(s)):
                kinds.append("")
                continue
            got = [x.lower() for x in WORD.findall(line)]
            gone = not got or sum(x in words for x in got) * 2 <= len(got) or core(s) in names
            gold = "folio" if FOLIO.match(s) and gone else "cabecera" if gone and core(s) in names else ""
            kinds.append(gold)
            line_cases.append((line_features(lines, k, names), gold))
        text_lines = body(lines, kinds)
        heads = set()
        for k, after in zip(text_lines, text_lines[1:], strict=False):
            left, right = ends(lines[k])[1].lstrip("«¿¡(\"“["), ends(lines[after])[0]
            a, b = left.rstrip(HYPHENS).lower(), _clean(right).lower()
            if not a or not b or not a[-1:].isalpha() or not b[:1].isalpha():
                continue
            b0 = re.match(r"[^\W\d_]+", b).group()
            if any(w == a + b or w == a + b0 or w.startswith(a + b0 + "-") for w in (a + b, a + b0)) and (a + b in words or a + b0 in words or any(w.startswith(a + b0 + "-") for w in words)):
                gold = "join"
                heads |= {a, b, b0}
            elif f"{a}-{b0}" in words or a in halves and b0 in halves or left[-1:] not in HYPHENS:
                gold = ""  # without a mark, a word that the clean page lacks isn't made
            else:
                continue
            join_cases.append((broken(left, right, bits), gold))
        there = {t.lower() for k in text_lines for t in (x.strip(HYPHENS) for x in TOKEN.findall(lines[k]))}
        lost = [w for w in words - there if len(w) > 2 and bits.level(w)]
        by = defaultdict(list)
        for w in lost:
            by[w[:1]].append(w)
            by[w[-1:]].append(w)
        for t in there - words - heads:
            if len(t) < 3 or not re.search(r"[^\W\d_]", t):
                continue
            found = None
            for w in {*by.get(t[:1], ()), *by.get(t[-1:], ())}:
                if abs(len(w) - len(t)) > 1:
                    continue
                i = 0
                while i < min(len(w), len(t)) and w[i] == t[i]:
                    i += 1
                j = 0
                while j < min(len(w), len(t)) - i and w[-1 - j] == t[-1 - j]:
                    j += 1
                x, y = t[i : len(t) - j], w[i : len(w) - j]
                if len(x) <= 2 and len(y) <= 2 and i + j >= 2:
                    found = (t, w, x, y, i)
                    break
            if found and found[2]:
                pairs[found] += 1
        kept.update(t for t in there & words if len(t) > 2)
    ops = Counter((x, y) for (_, _, x, y, _), n in pairs.items() for _ in range(n))
    for (x, y), n in ops.items():
        if n >= 3:
            ed.ops.setdefault(x, []).append(y)
    # a known word counts as a slip or as right, by which the sample has more often
    slips = Counter()
    for (t, *_), n in pairs.items():
        slips[t] += n
    char_cases = [(t, w) for t, w, *_ in pairs if not bits.level(t) or slips[t] > kept[t]]
    char_cases += [(t, None) for t, n in kept.items() if not bits.level(t) or n >= slips[t]]
    char_cases = [(f, gold) for t, gold in char_cases if (f := [(v, edit_features(t, v, op, i, bits)) for v, op, i in edits(t, ed.ops, bits)])]
    for _ in range(EPOCHS):
        for f, gold in line_cases:
            guess = max(("", "cabecera", "folio"), key=lambda x: ed.kind.score(f, x))  # noqa: B023
            ed.kind.learn((f, gold), (f, guess))
        for f, gold in join_cases:
            guess = "join" if ed.join.score(f, "join") > 0 else ""
            ed.join.learn((f if gold else [], "join"), (f if guess else [], "join"))
        for options, gold in char_cases:
            _learn_edit(ed, options, gold)
    for p in (ed.kind, ed.join, ed.char):
        p.average()
    return ed


def _learn_edit(ed: Editor, options: list[tuple[str, list]], gold: str | None) -> None:
    scored = [(ed.char.score(f, "edit"), v, f) for v, f in options]
    best = max(scored, key=lambda x: x[0])
    guess = best if best[0] > 0 else None
    right = next((x for x in scored if x[1] == gold), None) if gold else None
    if gold and not right:
        return
    ed.char.learn((right[2] if right else [], "edit"), (guess[2] if guess else [], "edit"))


def editor(pages: DataFrame) -> tuple[Editor, DataFrame]:
    """Counts of all pages, models of TRAIN_PAGES of them (those of smallest hash), and the names of headers."""
    bits, names = lexicon(pages), headers(pages)
    labelled = pages.where("length(trim(texto_limpio)) > 0 and length(texto_crudo) between 1 and 20000")
    sample = labelled.orderBy(F.xxhash64("id"), "id").limit(TRAIN_PAGES).select("texto_crudo", "texto_limpio").collect()
    met = [(c,) for c in {c for r in sample for c in headings(r[0])}]
    found = {r["c"] for r in names.join(pages.sparkSession.createDataFrame(met, "c string"), "c").collect()}  # at most those of the sample
    return train([(r[0], r[1]) for r in sample], bits, found), names


def judged(pages: DataFrame) -> DataFrame:
    """(id, linea, tipo) of the pages without a cleaned layer."""
    # by value: the executors need no copy of this package
    ed, names = editor(pages)
    shared = pages.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ed))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ed = pickle.loads(shared.value)
        for b in batches:
            ids, at, kind = [], [], []
            for i, text, own in zip(b["id"], b["texto_crudo"], b["names"], strict=True):
                ed.names = set() if own is None else set(own)
                for k, x in judge(text, ed):
                    ids.append(i)
                    at.append(k)
                    kind.append(x)
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "linea": pd.Series(at, dtype="int32"), "tipo": pd.Series(kind, dtype="object")})

    bare = pages.where("texto_crudo is not null and (texto_limpio is null or texto_limpio = '')").select("id", "texto_crudo")
    return with_names(bare, names).mapInPandas(rows, "id long, linea int, tipo string")


def repaired(pages: DataFrame) -> DataFrame:
    """(id, texto): readable paragraphs of every page, the cleaned layer's where there is one."""
    # by value: the executors need no copy of this package
    ed, names = editor(pages)
    shared = pages.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ed))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ed = pickle.loads(shared.value)
        for b in batches:
            out = []
            for text, own in zip(b["texto_crudo"], b["names"], strict=True):
                ed.names = set() if own is None else set(own)
                out.append(repair(text, ed))
            yield pd.DataFrame({"id": b["id"], "texto": out})

    has = F.length(F.trim(F.coalesce("texto_limpio", F.lit("")))) > 0
    mended = pages.where(~has & F.col("texto_crudo").isNotNull()).select("id", "texto_crudo")
    mended = with_names(mended, names).mapInPandas(rows, "id long, texto string")
    return mended.unionByName(pages.where(has).select("id", F.col("texto_limpio").alias("texto")))


def p7_found(spark, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "ocr").select("id", "texto_crudo", "texto_limpio"))


def p7_parrafos(spark, sf_dir: str) -> DataFrame:
    return repaired(read(spark, sf_dir, "ocr").select("id", "texto_crudo", "texto_limpio"))


QUERIES = {"p7_found": p7_found, "p7_parrafos": p7_parrafos}
SQL: dict[str, str] = {}
