"""Operators for training data: brute force, round trips and the defined results of odd inputs."""

import random
import string
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from compare import same
from pyspark.sql import functions as F

from telarium.llm import consensus, cooccur, ledger, linkage, mixture, names, nearsets, ocrtext, queries, residue, tokenizer

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, data, name):
    same(queries.queries()[name](spark, data).toPandas(), duck.execute(SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p7_found", "p9_cuotas"])
def test_runs(spark, data, name):
    assert queries.queries()[name](spark, data).limit(3).toPandas().shape[1] > 0


# 1: ledger


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("Pérez, Ana", "ana  PÉREZ.", True), ("a; b | c", "C;;B;a", True), ("Ana Pérez", "Pérez Ana", False), ("José", "Jose", False),
        ("", "…", True), ("uno,dos,tres", "tres dos uno", False), ("x, y; z", "z|y x", True), ("(Río), Luis,", "luis río", True), ("a​b", "a b", True),
    ],
)
def test_canonical(spark, a, b, equal):
    k = [r[0] for r in spark.createDataFrame([(a,), (b,)], "t string").select(ledger.canonical(F.col("t"))).collect()]
    assert (k[0] == k[1]) == equal


def test_ledger_increments(spark, tmp_path):
    kind = "id long, t string, s string, extra int, key int"
    rows = [(5, "A b", "x", 1, 1), (2, "a B!", "x", 1, 1), (3, "a b", None, 1, 1), (9, "A. B", None, 1, 1), (4, None, "x", 1, 1), (7, "otro", "x", 1, 1)]
    df = spark.createDataFrame(rows, kind)
    keys = lambda x: ledger.keyed(x, "id", "t", ["s"], "t")
    whole = ledger.Ledger.create(spark, f"{tmp_path}/whole", 3).update(keys(df))
    step = ledger.Ledger.create(spark, f"{tmp_path}/step", 5)
    for part in (df.where("id in (5, 3)"), df.where("id in (2, 7)"), df.where("id in (9, 4)"), df.where("id < 0")):
        step = ledger.Ledger.open(spark, f"{tmp_path}/step").update(keys(part))
        step.vacuum()
    step = ledger.Ledger.open(spark, f"{tmp_path}/step")
    assert (step.buckets, step.version) == (5, 3)
    view = lambda x: sorted((r["copies"], r["first_id"]) for r in x.table().collect())
    assert view(whole) == view(step) == [(1, 7), (2, 2), (2, 3)]
    found = ledger.copies(step, keys(df)).collect()
    assert {tuple(r) for r in found} == {("t", 2, 5), ("t", 3, 9)}


def test_ledger_any_batching(spark, tmp_path):
    """Whatever the batches and their order, the ledger is the same as one count by key, and joins with what it holds."""
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "A-B", "c", "C.", "d; e", "E|d", "", "¡!", "f"]), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    canon = lambda t: tuple(sorted(" ".join("".join(c if c.isalnum() else " " for c in f).split()) for f in t.lower().replace("|", ";").split(";")))
    want = defaultdict(list)
    for i, t, s in rows:
        want[canon(t), s].append(i)
    want = sorted((len(v), min(v)) for v in want.values())
    for n, order in ((1, [0]), (4, [2, 0, 3, 1])):
        step = ledger.Ledger.create(spark, f"{tmp_path}/l{n}", 4)
        for k in order:
            step = step.update(ledger.keyed(df.where(F.col("id") % n == k), "id", "t", ["s"], "t"))
        assert sorted((r["copies"], r["first_id"]) for r in step.table().collect()) == want


# 2: near-duplicate sets


@pytest.mark.parametrize("k, threshold, least", [(3, 0.5, 20), (5, 0.8, 5), (1, 0.7, 1)])
def test_similar_equals_brute_force(spark, k, threshold, least):
    rng = random.Random(k)
    base = [[rng.choice(string.ascii_lowercase[:12]) * rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(25)]
    texts = [" ".join(w) for w in base]
    for w in base:
        v = list(w)
        for _ in range(rng.randint(0, 6)):
            v[rng.randrange(len(v))] = rng.choice(["zz", "yy", "xx"])
        texts += [" ".join(v), " ".join(w[: len(w) // 2 + 1])]
    rows = [*enumerate(texts), (900, None), (901, ""), (902, texts[0].upper()), (903, "x")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "id long, texto string, h string")
    members, links = nearsets.similar(df, "id", "texto", k, threshold, least)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in links.collect()}
    got |= {(b, a) for a, b in got}
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
        if len(w) >= least and s:
            sets[i] = s
    assert set(rep) == set(sets)
    for i, j in combinations(sorted(sets), 2):
        common = len(sets[i] & sets[j])
        alike = common >= threshold * len(sets[i] | sets[j]) - 1e-9
        assert alike == (rep[i] == rep[j] or (rep[i], rep[j]) in got), (i, j)


def test_similar_of_nothing(spark):
    members, links = nearsets.similar(spark.createDataFrame([], "id long, t string"), "id", "t")
    assert members.count() == 0 and links.count() == 0


# 3: names


def test_names_link(spark):
    rows = [
        ("Antonio Guillermo Marmutelcal Barmacamo", "personas", None), ("A. G. Marmutelcal Barmacamo", "personas", ""), ("MARMUTELCAL BARMACAMO, ANTONIO", "personas", None),
        ("Don Antonio G. Marmutelcal Barmacmao", "personas", None), ("Antonio Marmutelcal B.", "personas", None), ("Luis Marmutelcal Barmacamo", "personas", None),
        ("Lucho Marmutelcal Barmacamo", "personas", None), ("El Zurdo", "personas", "Luis Marmutelcal Barmacamo"), ("", "personas", None), (None, "personas", None), ("¡!", "personas", None),
        ("Club Náutico de Tellasorvalo", "organizaciones", None), ("Club Náutico de Otralosorna", "organizaciones", None), ("Club Náutico Barpabingoz", "organizaciones", None),
        ("CN de Tellasorvalo", "organizaciones", None), ("Tellasorvalo (Club Náutico)", "organizaciones", None),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows * 2], "nombre string, categoria string, nuevo string, id int, clase string")
    got = defaultdict(set)
    for r in names.link(df.select("nombre", "categoria", "nuevo")).collect():
        got[r["entidad"]].add(r["nombre"])
    groups = sorted((sorted(g) for g in got.values() if len(g) > 1), key=lambda g: (len(g), g))
    assert groups == [
        ["CN de Tellasorvalo", "Club Náutico de Tellasorvalo", "Tellasorvalo (Club Náutico)"],
        ["El Zurdo", "Lucho Marmutelcal Barmacamo", "Luis Marmutelcal Barmacamo"],
        sorted(r[0] for r in rows[:5]),
    ]


def test_names_with_few_or_many_parts_link(spark):
    """No known given name, three given names, a name that is shortened already, compound surnames and three surnames."""
    pairs = [
        ("Zenquio Marmutelcal Barmacamo", "Zenquio Marmutelcal Barmacmao"), ("Juan Carlos Antonio Orfemoldero Pallacamez", "Juan Carlos Orfemoldero Pallacamez"),
        ("Juan C. Antonio Salmabusa Galtasores", "Juan C. A. Salmabusa Galtasores"), ("Antonio G. Tarlaberes Quinsamenes", "A. G. Tarlaberes Quinsamenes"),
        ("Luis G. Belmapeles Zartomenes", "Luis Belmapeles Zartomenes"), ("Pedro de la Corfehan Urlladala", "Pedro de la Corfehan"), ("Rosa Monrajaro Esmotoro Jarnipun", "Rosa Monrajaro Esmotoro"),
    ]
    apart = ["El Zurdo", "El Gordo", "Juan Urbano", "Juana Urbano"]
    df = spark.createDataFrame([(x, "personas", None) for p in pairs for x in p] + [(x, "personas", None) for x in apart], "nombre string, categoria string, nuevo string")
    entity = {r["nombre"]: r["entidad"] for r in names.link(df).collect()}
    assert [p for p in pairs if entity[p[0]] != entity[p[1]]] == []
    assert len({entity[x] for x in [p[0] for p in pairs] + apart}) == len(pairs) + len(apart)


def test_given_names_of_large_tables(spark):
    """Given names are learned though the words after them are few and the people many."""
    word = lambda kind, i: kind + "bcdfghjlmnprstvz"[i] + "al"
    rows = [(f"{word('gi', i)} {word('uno', j)} {word('dos', k)}", "personas") for i in range(16) for j in range(12) for k in range(14)]
    lex = names.learn(spark.createDataFrame(rows, "nombre string, categoria string"))
    plain = names.learn(spark.createDataFrame([], "nombre string, categoria string"))
    assert set(lex.given) - set(plain.given) == {word("gi", i) for i in range(16)}


def test_short_forms_are_learned(spark):
    """Short forms that no list holds, from people whose names differ in nothing else; surnames are none."""
    rng = random.Random(33)
    made = lambda k: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(k))
    given = {made(3): "z" + made(2) for _ in range(8)}
    seconds = [made(4) for _ in range(6)]
    rows, same = [], []
    for g, short in given.items():
        for i in range(60):
            first, second = made(5), rng.choice(seconds)
            rows.append((f"{g} {first} {second}".title(), "personas", None))
            if i % 4 == 0:
                rows.append((f"{short} {first} {second}".title(), "personas", None))
                same.append((rows[-2][0], rows[-1][0]))
    df = spark.createDataFrame(rows, "nombre string, categoria string, nuevo string")
    lex = names.learn(df.select("nombre", "categoria"))
    assert {k: v for k, v in lex.short.items() if k not in names.NICKNAMES} == {v: k for k, v in given.items()}
    entity = {r["nombre"]: r["entidad"] for r in names.link(df).collect()}
    assert sum(entity[a] == entity[b] for a, b in same) >= 0.97 * len(same)
    assert len(set(entity.values())) >= 0.97 * 8 * 60


@pytest.mark.parametrize("k", [1, 2])
def test_segment_join_equals_brute_force(spark, k):
    rng = random.Random(k)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    df = spark.createDataFrame([(i, "b", w) for i, w in enumerate(sorted(words))], "l long, b string, c string")
    got = {(r["l"], r["r"]): r["d"] for r in names.segment_join(df, df.withColumnRenamed("l", "r"), k).collect()}

    def dist(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
        return d[len(a), len(b)]

    ordered = sorted(words)
    brute = {(i, j): dist(a, b) for i, a in enumerate(ordered) for j, b in enumerate(ordered) if dist(a, b) <= k}
    assert got == brute


def test_segment_join_shuffles_no_candidates(spark):
    """F1, p3: of strings that all share a segment, only pairs within two edits leave the stage that meets them."""
    rng = random.Random(7)
    words = sorted({"comienzo" + "".join(rng.choice("abcdefghijklmnop") for _ in range(16)) for _ in range(300)})
    df = spark.createDataFrame([(i, "b", w) for i, w in enumerate([*words, words[0] + "a"])], "l long, b string, c string")
    found = names.segment_join(df, df.withColumnRenamed("l", "r"))
    assert {(r["l"], r["r"]) for r in found.collect()} == {*((i, i) for i in range(301)), (0, 300), (300, 0)}
    node, moved, nodes = found._jdf.queryExecution().executedPlan().finalPhysicalPlan(), [], []
    nodes.append(node)
    while nodes:
        x = nodes.pop()
        x = x.plan() if x.getClass().getSimpleName() == "ShuffleQueryStageExec" else x
        if x.getClass().getSimpleName() == "ShuffleExchangeExec":
            moved.append(x.metrics().apply("shuffleRecordsWritten").value())
        nodes += [x.children().apply(i) for i in range(x.children().size())]
    assert moved and max(moved) < 40 * 301, moved  # 90,000 candidates


def test_names_are_read_once_to_learn(spark, tmp_path, monkeypatch):
    """F1, p3: the names are read once, however much is learned from them, and the forms are written once."""
    rows = [(f"{g} Pere{x}z", "personas") for g in ("Ana", "Luis") for x in "abcdefgh"] + [("Club de Mar", "organizaciones"), (None, "personas")]
    mark = str(tmp_path / "leidas")

    def seen(batches):
        for b in batches:
            with open(mark, "a") as f:
                f.write("x" * len(b))
            yield b

    df = spark.createDataFrame(rows, "nombre string, categoria string").repartition(1).mapInPandas(seen, "nombre string, categoria string")
    names.learn(df)
    with open(mark) as f:
        assert len(f.read()) == len(rows)
    tables, write = [], names.materialise
    monkeypatch.setattr(names, "materialise", lambda df, name, *a: tables.append(name) or write(df, name, *a))
    found = names.link(spark.createDataFrame([(*r, None) for r in rows], "nombre string, categoria string, nuevo string"))
    assert found.count() == len(rows) - 1 and tables.count("formas") == 1


# 4: linkage


@pytest.mark.parametrize(
    "text, found",
    [
        ("compositor; 1854-1892; nacido en la villa de Puercasorrora", (["compositor", "nacido", "villa"], 1854, 1892, "puercasorrora")), ("† 1978; periodista", (["periodista"], None, 1978, None)),
        ("entidad de Alnopelgara Alta, desde 1868", (["desde", "entidad"], 1868, None, "alnopelgara alta")), (None, ([], None, None, None)), ("  ", ([], None, None, None)),
        ("academia fundada en 1913 en Teraberduzal", (["academia", "fundada"], 1913, None, "teraberduzal")),
        (" ".join(f"p{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)), ([], None, None, None)),
    ],
)
def test_describe(text, found):
    assert linkage.describe(text) == (*found[:3], linkage.fold(found[3]) if found[3] else None)


def _people(rng, n, ways):
    """Authorities and linker's answers about n people and n namesakes with other years and trades, in invented words."""
    made = lambda k: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(k))
    aut, cache, true = [], [], set()
    for i in range(n):
        name = f"carmen {made(4)} {made(3)}"
        for k in range(2):
            trade, birth, town = (i + k) % len(ways), 1700 + 137 * k + rng.randint(0, 90), made(4).title()
            label = name if not k else name.replace("carmen", "carmela")
            a, c = (rng.choice(ways[trade][x]) for x in (0, 1))
            years = rng.random() < 0.6
            if not k:
                aut.append((name, "personas", None, None, f"{a}, {birth}-{birth + 40}, {town}" if years else f"{a}; {town}" if rng.random() < 0.5 else a))
                true.add((name, label.title() + f" {i}"))
            said = f"{c} de {town} ({birth}-{birth + 40})" if years else c
            cache.append((label.title() + f" {i}" if not k else name.title() + f" ({i})", "personas", '{"id": "Q%d", "label": "%s", "description": "%s"}' % (2 * i + k, name.title(), said), 1.0, 2))
    return aut, cache, true


def test_trades_are_learned(spark):
    """Trades that no list holds: words that tell the same are found by people whose years agree, and tell namesakes apart."""
    rng = random.Random(44)
    ways = [(["zurrador", "peletero"], ["curtidor", "zurrante"]), (["alarife"], ["maestro de obras"]), (["boticario", "herbolario"], ["farmacopola"]), (["calafate"], ["carpintero de ribera"]), (["tahonero"], ["panadero", "hornero"])]
    aut, cache, true = _people(rng, 240, ways)
    a = spark.createDataFrame(aut, "texto_norm string, categoria string, wikidata_id string, wikidata_lbl string, descripcion string")
    c = spark.createDataFrame(cache, "texto string, categoria string, resultado string, consultado double, algo_version long")
    left, right = linkage.sides(a, c)
    left, right = linkage.materialise(left), linkage.materialise(right)
    pairs = linkage.candidates(left, right, spark.createDataFrame([], "texto string, categoria string, wikidata_id string"))
    ties = {(r["wa"], r["wc"]) for r in linkage.word_ties(pairs, left, right).collect() if r["wa"] != r["wc"]}
    of = lambda words: {w for x in words for w in linkage.tokens(x) if len(w) > 2}
    assert ties <= {(x, y) for a, c in ways for x in of(a) for y in of(c)} and len(ties) >= 8
    found = linkage.match(a, c, spark.createDataFrame([], "texto string, categoria string, wikidata_id string")).where("confianza > 0.5")
    got = {(r["texto_norm"], r["texto"]) for r in found.collect()}
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got), (len(got), len(true), len(got & true))


def test_linkage_tells_namesakes_apart(spark):
    aut, cache = [], []
    for i in range(40):
        name = f"antonio {'bcdfghjklm'[i % 10]}ar{'aeiou'[i // 10]}vescal{'aeiou'[i % 5]} roldan"
        aut.append((name, "personas", None, None, f"pintor, {1800 + i}-{1850 + i}, Villa{i}" if i % 4 else None, None))
        cache.append((name.title(), "personas", '{"id": "Q%d", "label": "%s", "description": "retratista de Villa%d (%d-%d)"}' % (i, name.title(), i, 1800 + i, 1850 + i), 1.0, 2))
    cache.append(("A. " + aut[1][0].title()[8:], "personas", '{"id": "Q900", "label": "%s", "description": "obispo de Otra (1700-1760)"}' % ("Andrés " + aut[1][0].title()[8:]), 1.0, 2))
    cache += [("Nadie", "personas", None, 1.0, 2), ("Roto", "personas", "{mal", 1.0, 2)]
    a = spark.createDataFrame(aut + aut[:3], "texto_norm string, categoria string, wikidata_id string, wikidata_lbl string, descripcion string, label string")
    c = spark.createDataFrame(cache, "texto string, categoria string, resultado string, consultado double, algo_version long")
    m = spark.createDataFrame([], "texto string, categoria string, wikidata_id string")
    got = {(r["texto_norm"], r["texto"]) for r in linkage.match(a, c, m).where("confianza > 0.5").collect()}
    assert got == {(x[0], x[0].title()) for x in aut}
    empty = linkage.match(a.limit(0), c.limit(0), m)
    assert empty.count() == 0


# 5: consensus


def test_consensus_trusts_the_competent(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(300):
        t = rng.choice(["personas", "lugares", "organizaciones"])
        truth[f"a{i}"] = t
        for who, skill in (("anot_1", 0.97), ("anot_2", 0.95), ("anot_3", 0.2), ("anot_4", 0.2)):
            label = t if rng.random() < skill else "lugares" if who in ("anot_3", "anot_4") else rng.choice(["personas", "lugares"])
            rows.append((len(rows), f"a{i}", "x", label, "confirmada", who, None))
    rows += [(9000, "a0", "x", "obras", "rechazada", "anot_1", None), (9001, "a0", "x", "obras", "confirmada", "ner_auto", None), (9002, None, "x", "obras", "confirmada", "anot_1", None)]
    df = spark.createDataFrame(rows, "id long, art_id string, texto_norm string, categoria string, estado string, fuente string, modificada_en timestamp")
    found, model = consensus.consensus(df)
    got = {r["art_id"]: r for r in found.collect()}
    right = sum(got[a]["categoria"] == t for a, t in truth.items()) / len(truth)
    assert right > 0.93 and set(got) == set(truth)
    skill = dict(zip(model.people, model.competence, strict=True))
    assert skill["anot_1"] > 0.85 and skill["anot_3"] < 0.5
    assert consensus.consensus(df.limit(0))[0].count() == 0


def test_consensus_sees_through_a_swap(spark):
    rng = random.Random(55)
    swap = {"lugares": "organizaciones", "organizaciones": "lugares", "personas": "personas"}
    rows, truth = [], {}
    for i in range(400):
        truth[f"a{i}"] = t = rng.choice(list(swap))
        for who in rng.sample(["anot_1", "anot_2", "anot_3", "anot_4", "anot_5"], 3):
            label = swap[t] if who == "anot_5" else t if rng.random() < 0.85 else rng.choice(list(swap))
            rows.append((len(rows), f"a{i}", "x", label, "confirmada", who, None))
    df = spark.createDataFrame(rows, "id long, art_id string, texto_norm string, categoria string, estado string, fuente string, modificada_en timestamp")
    found, _ = consensus.consensus(df)
    assert sum(r["categoria"] == truth[r["art_id"]] for r in found.collect()) / 400 > 0.95


def test_agreement_beyond_chance(spark):
    """Krippendorff's alpha of a table by hand: two of three spans agree in full."""
    rows = [("a", "anot_1", "p"), ("a", "anot_2", "p"), ("b", "anot_1", "q"), ("b", "anot_2", "q"), ("c", "anot_1", "p"), ("c", "anot_2", "q"), ("d", "anot_1", "p")]
    made = lambda rows: spark.createDataFrame([(i, a, "x", c, "confirmada", f, None) for i, (a, f, c) in enumerate(rows)], "id long, art_id string, texto_norm string, categoria string, estado string, fuente string, modificada_en timestamp")
    got = consensus.agreement(made(rows)).first()
    assert (got["tramos"], got["etiquetas"], got["acuerdo"], got["azar"]) == (3, 6, round(4 / 6, 6), 0.4)
    assert got["alfa"] == round(1 - (1 - 4 / 6) / 0.6, 6)
    assert consensus.agreement(made(rows[:2])).first()["alfa"] == 1.0
    assert consensus.agreement(made([])).first()["tramos"] == 0


def test_last_label_stands(spark):
    import datetime as d

    rows = [(1, "a", "x", "p", "confirmada", "anot_1", d.datetime(2024, 1, 2)), (2, "a", "x", "q", "confirmada", "anot_1", d.datetime(2024, 1, 1)), (3, "a", "x", "r", "confirmada", "anot_1", None), (4, "b", "x", "p", "corregida", "anot_1", None), (5, "b", "x", "q", "corregida", "anot_1", None)]
    df = spark.createDataFrame(rows, "id long, art_id string, texto_norm string, categoria string, estado string, fuente string, modificada_en timestamp")
    assert {(r["art_id"], r["categoria"]) for r in consensus.standing(df).collect()} == {("a", "p"), ("b", "q")}


# 6: co-occurrence


def test_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abcd"), rng.choice("abcde"), "[" + ", ".join(f'"r{rng.randint(1, 6)}"' for _ in range(rng.randint(0, 4))) + "]") for i in range(200)]
    rows += [(900, "a", None, '["r1"]'), (901, "a", "b", None), (902, "a", "b", ""), (903, "a", "b", "roto"), (904, "a", "b", '[null, "r9"]')]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "id long, entidad_a string, entidad_b string, articulo_ids string, categoria string, code int")
    import json

    at, alone, every = defaultdict(set), defaultdict(set), set()
    for _, a, b, ids in rows:
        try:
            arts = {x for x in json.loads(ids) if x}
        except (TypeError, ValueError):
            continue
        if a and b and a != b:
            at[min(a, b), max(a, b)] |= arts
            alone[a] |= arts
            alone[b] |= arts
            every |= arts
    got = {(r["entidad_a"], r["entidad_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in cooccur.associations(df).collect()}
    assert got == {k: (len(v), len(alone[k[0]]), len(alone[k[1]]), len(every)) for k, v in at.items() if v}
    assert cooccur.associations(df.limit(0)).count() == 0


# 7: scanned text

PAGES = [
    ("EL FARO DEL SUR 3\nLa casa grande del camino vie-\njo tiene una puerta y un niiestro\njardín. El maestro franco-\nespañol canta.\n( 3 )\nOtra línea más del texto.", "La casa grande del camino viejo tiene una puerta y un nuestro jardín. El maestro franco-español canta. Otra línea más del texto."),
]


def test_scanned_pages(spark):
    rows = [(i, PAGES[0][0], PAGES[0][1]) for i in range(60)]
    rows += [(100, PAGES[0][0], None), (101, None, None), (102, "", ""), (103, "\n\n", None), (104, "solo una línea " * 3000, "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, texto_crudo string, texto_limpio string, tipo int").select("id", "texto_crudo", "texto_limpio")
    got = defaultdict(set)
    for r in ocrtext.judged(df).collect():
        got[r["id"]].add((r["linea"], r["tipo"]))
    assert got[100] == {(1, "cabecera"), (2, "corte"), (3, "caracter"), (6, "folio")}
    assert not got[101] and not got[102] and not got[103]
    text = {r["id"]: r["texto"] for r in ocrtext.repaired(df).collect()}
    assert text[100] == PAGES[0][1] and text[0] == PAGES[0][1]
    assert ocrtext.judged(df.limit(0)).count() == 0


def test_slips_that_cleaned_layers_repeat(spark):
    """A misreading that stands in cleaned layers is still one, if its correction is far more frequent; a rare word is none."""
    right = "Es nuestro el jardín de la casa grande, y la loma queda lejos."
    rows = [(i, right.replace("nuestro", "nuesfro") if i % 2 else right, right) for i in range(240)]
    rows += [(400 + i, None, "Es nuesfro el jardín.") for i in range(5)]
    rows += [(500, "La loma queda lejos.\nEs nuesfro el jardín.", None)]
    df = spark.createDataFrame(rows, "id long, texto_crudo string, texto_limpio string")
    assert {(r["linea"], r["tipo"]) for r in ocrtext.judged(df).collect()} == {(2, "caracter")}
    text = {r["id"]: r["texto"] for r in ocrtext.repaired(df).collect()}
    assert text[500] == "La loma queda lejos. Es nuestro el jardín."


def test_rare_headers_of_large_tables(spark):
    pages = spark.range(100_003).select("id", F.when(F.col("id") < 3, "EL FARO DEL SUR\nuna línea").otherwise("una línea").alias("texto_crudo"))
    assert "EL FARO DEL SUR".replace(" ", "").replace("L", "I") in {r["c"] for r in ocrtext.headers(pages).collect()}


# 8: tokenizer


def test_encode_equals_library(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = tokenizer.load_ranks(tokenizer.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN[4:], mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", " ", "\n\n  x", "Él niño's 123 ¡olé! <|endoftext|>", "a" * 5000, "ábc" * 900, "😀 🇪🇸 é   x", "".join(rng.choice("aé ñ\n1-_'s😀") for _ in range(3000))]
    texts += ["".join(rng.choice(string.printable) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts + texts[:5])], "doc_id long, text string, word string, row int")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert len(got) == len(texts) + 5
    for i, t in enumerate(texts + texts[:5]):
        assert got[i] == (enc.encode_ordinary(t) if t else []), repr(t)
    back = tokenizer.encode(df, "doc_id", "text").select("doc_id", tokenizer.decode(df, "ids").alias("t"))
    assert {r["doc_id"]: r["t"] for r in back.collect()} == {i: t or "" for i, t in enumerate(texts + texts[:5])}
    tokens = {r["doc_id"]: r["tokens"] for r in tokenizer.count_tokens(df, "doc_id", "text").collect()}
    assert tokens == {i: len(x) for i, x in got.items()}


def test_repeated_rows_are_encoded_each(spark):
    df = spark.createDataFrame([(1, "hola"), (1, "hola"), (1, None)], "doc_id long, text string")
    assert Counter(len(r["ids"]) > 0 for r in tokenizer.encode(df, "doc_id", "text").collect()) == {True: 2, False: 1}


def test_counting_keeps_constants_out_of_plans(spark, monkeypatch):
    """p9: the driver describes a plan hundreds of times, each time with all its constants."""
    plans = []
    for module in (tokenizer, mixture):
        write = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, *a, write=write: plans.append(len(df._jdf.queryExecution().optimizedPlan().toString())) or write(df, *a))
    docs = [(1, None, "a"), (2, "", "a"), (3, "uno dos  tres", "b"), (4, "x" * 9000 + " 😀ñ", "b"), (5, "uno", None), (6, "uno dos  tres", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(1)
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 3)], "source string, peso double, max_repeticiones int")
    assert mixture.mix(df, goal).count() and plans and max(plans) < 20_000
    plans.clear()
    counted = tokenizer.count_tokens(df, "doc_id", "text")
    tokens = {r["doc_id"]: r["tokens"] for r in counted.collect()}
    assert max(plans, default=0) < 20_000
    ids = {r["doc_id"]: len(r["ids"]) for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert tokens == ids and tokens[1] == tokens[2] == 0
    assert not tokenizer.count_tokens(df.limit(0), "doc_id", "text").count()


# 9: mixture


def test_mixture_reaches_shares(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(["palabra"] * rng.randint(1, 60)), s) for s, n in (("a", 1500), ("b", 300), ("c", 200)) for i in range(n)]
    docs = [(k, *d[1:]) for k, d in enumerate(docs)] + [(9000, "x", None), (9001, None, "a"), (9002, "", "b"), (9003, "fuera", "z")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, x int")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 4), ("ausente", 0.1, 2), (None, 0.1, 2)], "source string, peso double, max_repeticiones int")
    chosen = mixture.mix(df, goal)
    got = {r["source"]: r for r in mixture.shares(chosen, goal).collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(got[s]["parte"] - w) < 0.01, (s, got[s])
        assert got[s]["max_copias"] <= got[s]["max_repeticiones"]
    assert got["ausente"]["parte"] == 0
    assert not chosen.where("doc_id >= 9000").count()
    assert mixture.mix(df.limit(0), goal).count() == 0


def test_scarce_sources_saturate(spark):
    """A source with one short document takes its cap and no more; the rest of the mix stays as large."""
    rng = random.Random(99)
    docs = [(i, " ".join(["palabra"] * rng.randint(5, 60)), s) for s, n in (("a", 900), ("b", 700), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([(k, *d[1:]) for k, d in enumerate(docs)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.2, 5), ("nadie", 0.0, 5)], "source string, peso double, max_repeticiones int")
    sizes = mixture.sizes(df, goal).groupBy("source").sum("x").collect()
    supply = {r[0]: r[1] for r in sizes}
    got = {r["source"]: r for r in mixture.shares(mixture.mix(df, goal), goal).collect()}
    assert got["c"]["tokens"] == 5 * supply["c"] and got["c"]["max_copias"] == 5
    total = sum(r["tokens"] for r in got.values())
    assert abs(total - sum(supply.values())) < 0.01 * total
    for s, w in (("a", 0.5), ("b", 0.3)):
        assert abs(got[s]["tokens"] - (sum(supply.values()) - got["c"]["tokens"]) * w / 0.8) < 0.01 * total
    assert got["c"]["falta"] > 0.19 and got["nadie"]["tokens"] == 0
    assert all(r["max_copias"] <= r["max_repeticiones"] for r in got.values())


def test_goals_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        names = "abcdef"[: rng.randint(1, 6)]
        supply = {s: float(rng.randint(1, 1000)) for s in names}
        weight = {s: rng.random() + 0.01 for s in names}
        most = {s: supply[s] * rng.randint(1, 5) for s in names}
        low, high = 0.0, 1e9
        for _ in range(200):  # the level at which min(most, weight * level) fills the total
            level = (low + high) / 2
            low, high = (level, high) if sum(min(most[s], weight[s] * level) for s in names) < sum(supply.values()) else (low, level)
        got = mixture.goals(supply, most, weight)
        assert all(abs(got[s] - min(most[s], weight[s] * high)) < 1e-6 * max(1, got[s]) for s in names)


# 10: residue


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Por {{autor}} en la plaza", "hueco"), ("Título: [INSERTAR FECHA]", "hueco"), ("La errata [sic] y el nombre [ilegible] del papel [roto]", None), ("Costaba $ 595 y $ 3,50 al año", None),
        ("Subió un 5% sobre lo previsto y un 3% sobre lo pagado", None), ("Con todo: el café llegó", None), ("TODO: pegar transcripción", "hueco"), ("Firmado @@fecha@@ hoy", "hueco"),
        ("Bla bla bla bla en la nota", "relleno"), ("Lorem magna cupidata laborum tempora elitra velita amet aliqua adipisci ipsum", "relleno"), ("Dejó escrito «aquí va el título» en la prueba", None),
        ("Este visor requiere JavaScript. Actívelo en su navegador.", "aviso"), ("404 Not Found\nnginx", "aviso"), ("No puedo transcribir esta imagen.", "aviso"), ("Un cartel decía que la página solicitada no existe, y todos rieron.", None),
        (None, None), ("", None), ("  \n", None), ("■", None), ("Llegó el tren a la plaza y cantó la orquesta de la ciudad.", None), ("palabra " * 20000 + "{{x}}", "hueco"),
    ],
)
def test_residue(spark, text, kind):
    df = spark.createDataFrame([(1, text, "s", "La Paleta", 7)], "doc_id long, text string, source string, publicacion string, n int")
    got = residue.residue(df).collect()
    assert [c for r in got for c in ("hueco", "relleno", "aviso") if r[c]] [:1] == ([kind] if kind else [])


def test_long_notices(spark):
    """Length doesn't hide a notice: most sentences tell, or all lines are shared by hosts and fit none of them; long prose is none."""
    notice = "Error 503 del servidor. La página solicitada no está disponible. Este visor requiere JavaScript y cookies. Inténtelo más tarde o vuelva a cargar. " * 4
    prose = "La orquesta tocó en la plaza y llegó el tren. Un error 404 salió en el visor aquel día. Después hubo baile, cena y un largo discurso del alcalde. " * 6
    shared = "\n".join(f"Renglón común de la casa con muchas palabras sueltas y turno {k}" for k in range(12))
    rows = [(1, notice, "s1", "Lumen"), (2, prose, "s1", "Lumen"), *((10 + i, shared, f"s{i % 3}", "Lumen") for i in range(6)), (30, shared + "\nRenglón propio", "s1", "Lumen")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, publicacion string")
    got = {r["doc_id"] for r in residue.residue(df).collect()}
    assert 1 in got and 2 not in got and 30 not in got, got
    # the lines of a text of several lines have terms in common with its title, so the shared ones are an article
    assert not got & set(range(10, 16))
    other = [(i, "Portal cerrado hoy\n" + shared.replace("casa", "sala"), f"s{i % 3}", "Lumen") for i in range(6)]
    df = spark.createDataFrame(other, "doc_id long, text string, source string, publicacion string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == set(range(6))


def test_shared_responses(spark):
    rows = [(i, f"Zona fuera de horario, turno {i}", f"s{i % 3}", "Lumen") for i in range(6)] + [(10, "Zona propia del puerto", "s1", "Lumen")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, publicacion string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == set(range(6))
    assert residue.residue(df.limit(0)).count() == 0
