"""Micro fixtures with results derived by hand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from telarium.functions import text as T
from telarium.operators import affect, cleaning, graph, lexical, models, sequence, similarity
from telarium.plans import evaluation
from telarium.plans import sequence as sequence_plans
from telarium.plans import similarity as similarity_plans
from telarium.plans import text as text_plans
from telarium.sources import files


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr.alias("x")).first()[0]


@pytest.mark.parametrize("value, least, found", [("Está ahí: niño, abc1 él", 3, ["está", "ahí", "niño"]), (None, 3, []), ("", 3, []), ("a_b cd", 2, ["cd"])])
def test_tokens(spark, value, least, found):
    assert one(spark, value, T.tokens(F.col("c"), least)) == found


@pytest.mark.parametrize("value, n", [(None, 0), ("", 0), ("  \n ", 0), (" a  b\nc ", 3)])
def test_space_count(spark, value, n):
    assert one(spark, value, T.space_count(F.col("c"))) == n


def test_slug(spark):
    assert one(spark, "Bogotá", T.slug(F.col("c"), "-", "sin-nombre")) == "bogota"
    assert one(spark, " ¡! ", T.slug(F.col("c"), "-", "sin-nombre")) == "sin-nombre"
    assert one(spark, None, T.slug(F.col("c"), "-", "sin-nombre")) == "sin-nombre"


def test_quality(spark):
    df = spark.createDataFrame([(1, "x", "de la el en un y o a"), (2, "x", None)], "id long, articulo_id string, texto_crudo string")
    got = {r["id"]: r for r in text_plans.metrics(df).collect()}
    assert (got[1]["tokens"], got[1]["fragmentos"], got[1]["fundidas"]) == (8, 0, 0)
    assert got[2]["tokens"] == 0
    m = spark.createDataFrame([(199, 0, 0), (1000, 100, 0), (1000, 200, 0), (1000, 0, 10), (1000, 99, 9)], "tokens int, fragmentos int, fundidas int")
    assert [r[0] for r in m.select(text_plans.verdict()).collect()] == ["revisar", "revisar", "no_utilizable", "revisar", "utilizable"]


@pytest.mark.parametrize("words, pos, neg", [(["ni", "alegre"], 0, 1), (["alegre"], 1, 0), (["triste"], 0, 1), (["nunca", "x", "y", "triste"], 1, 0), (["nunca", "x", "y", "z", "triste"], 0, 1), ([], 0, 0)])
def test_polarity(spark, words, pos, neg):
    df = spark.createDataFrame([(1, words)], "doc_id long, w array<string>")
    r = affect.polarity(df).first()
    assert (r["pos"], r["neg"]) == (pos, neg)


def test_cooccurrence(spark):
    index = {"Bolívar": "a1 a2 a3", "Santander": "a1 a2", "Bogotá": "a1 a2 a3 a4", "Caracas": "a1 a4", "Nariño": "a3 a4"}
    df = spark.createDataFrame([(a, e) for e, arts in index.items() for a in arts.split()], "art string, e string")
    got = {(r["a"], r["b"]): r["peso"] for r in graph.cooccurrence(df).collect()}
    assert got["Bogotá", "Bolívar"] == 3 and got["Bolívar", "Santander"] == 2 and got["Bogotá", "Caracas"] == 2 and got["Bogotá", "Nariño"] == 2 and got["Bolívar", "Nariño"] == 1


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 10), (10, 11), (11, 12), (12, 13)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 14)], "id long")
    got = {r["id"]: r["clase"] for r in graph.components(links, nodes).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, **dict.fromkeys(range(9, 14), 9)}


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "a string, b string, peso int")
    got = {r["nodo"]: r["intermediacion"] for r in graph.centralities(edges).collect()}
    # two of the three pairs of other nodes, as shares
    assert got == {"a": 0, "b": 0.666667, "c": 0.666667, "d": 0}


def test_network_sees_each_pair_twice(spark):
    df = spark.createDataFrame([(1, ["aaa", "bbb"])], "doc_id long, t array<string>")
    assert [tuple(r) for r in lexical.lexical_network(df, 5, 5, 1).collect()] == [("aaa", "bbb", 2)]


def test_cosine_pairs_equal_brute_force(spark):
    import math
    from itertools import combinations

    docs = [["a", "b", "c"], ["a", "b", "c", "c"], ["x", "y"], ["x", "y", "z"], ["a"], [], ["q", "a", "x"]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, t array<string>")
    n = sum(bool(d) for d in docs)
    freq = {w: sum(w in d for d in docs) for d in docs for w in d}
    vec = []
    for d in docs:
        v = {w: d.count(w) * (math.log(n / freq[w]) + 1) for w in d}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({w: x / norm for w, x in v.items()})
    for t in (0.3, 0.6, 0.9):
        brute = {(i, j) for i, j in combinations(range(len(docs)), 2) if sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) >= t}
        assert {(r["a"], r["b"]) for r in similarity.cosine_pairs(similarity.tfidf(df), t).collect()} == brute


def test_vector_topk_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = similarity.vector_topk(emb, emb.where("vec_id = 0"), 3).orderBy("puesto").collect()
    assert [(r["vec_id"], r["sim"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]


@pytest.mark.parametrize("a, b, d", [("kitten uno", "sitting uno", 1), ("", "", 0), ("a b c", "", 3), (None, "x", 1), ("a b c d", "b c x d", 2)])
def test_word_distance(spark, a, b, d):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(similarity.word_distance("a", "b")).first()[0] == d


def test_hyphens_and_lines(spark):
    assert one(spark, "una pala-\n\n bra y otra-\nmas", cleaning.join_hyphens(F.col("c"))) == "una palabra y otramas"
    assert one(spark, "uno\ndos\n\nTRES\ncuatro", cleaning.rebuild_lines(F.col("c"))) == "uno dos\nTRES\ncuatro"


def test_html(spark):
    html = '<html><title> A &amp; B </title><meta name="Author" content="X"><meta content="Y" name="author"><b>n</b></html>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    got = {r["id"]: r for r in files.metadata(df, "html").collect()}
    assert (got[1]["titulo"], got[1]["autor"]) == ("A & B", "Y")
    assert got[2]["titulo"] is None and got[3]["titulo"] is None


def test_page_scan(spark, tmp_path):
    for issue, page, text in (("n1", "p0002", "dos"), ("n1", "p0001", "uno"), ("n2", "p0001", "otro")):
        (tmp_path / issue).mkdir(exist_ok=True)
        (tmp_path / issue / f"{page}.txt").write_text(text)
    got = {r["numero"]: r["texto"] for r in files.issue_text(files.pages(spark, str(tmp_path))).collect()}
    assert got == {"n1": "uno\n\ndos", "n2": "otro"}


def test_write_lines_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "x string").coalesce(1)
    files.write_lines(df, "x", str(tmp_path / "f.txt"), "<g>", "</g>")
    assert (tmp_path / "f.txt").read_text() == "<g>\na\nb\n</g>\n"
    files.write_manifest(str(tmp_path / "f.txt"), "gexf", "0", ["x"], [])
    assert "gexf" in (tmp_path / "f.txt.json").read_text()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, t array<string>")
    assert lexical.frequencies(df).count() == 0 and lexical.ngrams(df, 2).count() == 0
    assert lexical.collocates(df, "x", 5, 5).count() == 0
    assert similarity.cosine_pairs(similarity.tfidf(df), 0.8).count() == 0


def test_error_rates_keep_every_page(spark):
    """Pages with characters beyond ASCII count too: soft hyphens, accents of any kind, other scripts."""
    rows = [(1, "Canción añeja", "Canción añeja"), (2, "la casa", "la ca\u00adsa"), (3, "la cȧsà é", "la casa e\u0301"), (4, "mar", "мar"), (5, "sol", None)]
    df = spark.createDataFrame([(i, "m", 0.9, ref, hyp) for i, ref, hyp in rows], "id long, motor string, confianza double, texto_limpio string, texto_crudo string")
    assert {(r["paginas"], r["errores"]) for r in evaluation.cer(df).collect()} == {(5, 0 + 1 + 0 + 1 + 3)}
    assert {r["id"]: r["texto"] for r in evaluation.normaliser(df).collect()} == {1: "cancion aneja", 2: "la ca\u00adsa", 3: "la casa e", 4: "мar"}
    assert evaluation.split_merge(df).count() == 5
    names = spark.createDataFrame([("Casa\u00a0Á", "Casa A"), ("“Luz”", "Luz")], "nombre string, nombre_nuevo string")
    assert sorted(r["d"] for r in similarity_plans.bounded(names).collect()) == [1, 2]


def test_zone_iou_equals_brute_force(spark):
    """Every zone is matched, against its neighbours too; the last wins on ties."""
    text = "una línea larga de la página que sigue\n  otra más corta\n\ncuatro\n" + "x" * 70 + "\n fin"
    df = spark.createDataFrame([(1, text), (2, "sola"), (3, None), (4, "")], "id long, texto_crudo string")
    z = [(r["id"], r["k"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in sequence.zones(df).collect()]
    expected = {}
    for i, k, *b in z:
        for j, m, x0, y0, x1, y1 in z:
            c = (x0, y0 - (y1 - y0) / 4, x1, y1)
            inter = max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1]))
            union = (b[2] - b[0]) * (b[3] - b[1]) + (c[2] - c[0]) * (c[3] - c[1]) - inter
            if i == j and union > 0 and inter / union >= 0.5:
                expected[i, k] = max(expected.get((i, k), (0, 0, 0)), (round(inter / union, 6), m, round(inter / union, 4)))
    got = {(r["id"], r["a"]): (r["b"], r["iou"]) for r in sequence_plans.zone_iou(df).collect()}
    assert got == {k: v[1:] for k, v in expected.items()} and len(got) == 6


def test_overlap_pairs_of_short_texts_equal_brute_force(spark):
    from itertools import combinations

    docs = [f"{a} {b}" for a, b in combinations(["casa grande", "puerta", "jardín viejo", "camino", "lejos", "maestro canta"], 2)] + ["", "casa", "sol y mar", None]
    df = spark.createDataFrame([(i, d, None, None, None, None) for i, d in enumerate(docs)], "doc_id long, text string, source string, lang string, anio int, publicacion string")
    words = {i: {w for w in d.split() if len(w) >= 4} for i, d in enumerate(docs) if d}
    expected = {(a, b): round(len(x & y) / min(len(x), len(y)), 4) for (a, x), (b, y) in combinations(words.items(), 2) if x and y and 2 * len(x & y) >= min(len(x), len(y))}
    assert {(r["a"], r["b"]): r["coef"] for r in similarity_plans.duplicate_pairs(df).collect()} == expected


def test_pairs_are_the_same_in_blocks_and_none_is_shuffled(spark, monkeypatch):
    """Both joins of texts against brute force over several blocks; their plans have no join and no distinct of pairs."""
    import random
    from itertools import combinations

    rng = random.Random(5)
    docs = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([((i * 7919) % 1000 - 300, d) for i, d in enumerate(docs)] + [(None, ["a"])], "doc_id long, t array<string>")
    monkeypatch.setattr(similarity, "BLOCK", 9)
    overlap, cosine = similarity.overlap_pairs(df, 0.5), similarity.cosine_pairs(similarity.tfidf(df), 0.6)
    for found in (overlap, cosine):
        assert "Join" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    sets = {r["doc_id"]: set(r["t"]) for r in df.where("doc_id is not null").collect() if r["t"]}
    expected = {(a, b): c for a, b in combinations(sorted(sets), 2) if (c := round(len(sets[a] & sets[b]) / min(len(sets[a]), len(sets[b])), 4)) >= 0.5}
    assert sorted((r["a"], r["b"], r["coef"]) for r in overlap.collect()) == sorted((*k, c) for k, c in expected.items())
    vec: dict = {}
    for r in similarity.tfidf(df).where("doc_id is not null").collect():
        vec.setdefault(r["doc_id"], {})[r["w"]] = r["x"]
    sims = {(a, b): sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) for a, b in combinations(sorted(vec), 2)}
    got = {(r["a"], r["b"]): r["sim"] for r in cosine.collect()}
    assert got.keys() == {k for k, x in sims.items() if x >= 0.6} and len(got) == cosine.count() > 5
    assert all(abs(x - sims[k]) < 1e-12 for k, x in got.items())


def test_char_vectors_equal_a_count_by_hand(spark):
    """Two to four characters of every word, repetitions included, before the weights of documents."""
    import math

    texts = ["la casa y la cosa la", "el sol", "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    grams = [Counter(f" {w} "[i : i + n] for w in t.split() for n in (2, 3, 4) for i in range(len(w) + 3 - n)) for t in texts]
    seen = Counter(g for c in grams for g in c)
    got = {r["doc_id"]: sorted(round(x, 6) for x in r["v"].toArray() if x) for r in models.char_vectors(df, 1 << 18).collect()}
    for i, c in enumerate(grams):
        v = [(1 + math.log(n)) * math.log(4 / (seen[g] + 1)) for g, n in c.items()]
        assert got[i] == sorted(round(x / math.sqrt(sum(y * y for y in v)), 6) for x in v if x)


def test_word2vec_has_the_size_of_the_survey(spark):
    m = models.word2vec(spark.createDataFrame([(["uno", "dos"] * 3,)], "t array<string>"))
    assert (len(m.getVectors().first()["vector"]), m.getMaxIter(), m.getWindowSize(), m.getMinCount()) == (150, 12, 6, 3)


def test_word2vec_trains_large_tables_in_parts(spark, monkeypatch):
    """As many tasks as parts of the words, and words of one kind of sentence stay nearest to each other."""
    docs = [([f"{k}{c}" for c in "abcd"] * 5,) for k in ("rio", "sol") for _ in range(60)]
    df = spark.createDataFrame(docs, "t array<string>")
    assert models.word2vec(df).getNumPartitions() == 1
    monkeypatch.setattr(models, "PART", 1000)
    m = models.word2vec(df)
    assert m.getNumPartitions() == 3
    assert {r["word"] for r in m.findSynonyms("rioa", 3).collect()} == {"riob", "rioc", "riod"}


def test_factorisation_finds_planted_topics(spark):
    """Documents of two vocabularies fall apart into two topics, with ids beyond 32 bits, and each topic lists its own words."""
    import random

    rng = random.Random(2)
    kinds = [[f"rio{c}" for c in "abcdefgh"], [f"sol{c}" for c in "abcdefgh"]]
    docs = [((1 << 40) + i, [rng.choice(kinds[i % 2]) for _ in range(30)]) for i in range(80)] + [(5, [])]
    found, topics = models.nmf(spark.createDataFrame(docs, "doc_id long, t array<string>"), 2)
    got = {r["doc_id"]: r["topico"] for r in found.collect()}
    assert len(got) == 80
    assert len({got[(1 << 40) + i] for i in range(0, 80, 2)}) == len({got[(1 << 40) + i] for i in range(1, 80, 2)}) == 1
    assert got[1 << 40] != got[(1 << 40) + 1]
    words = {r["topico"]: r["palabras"].split(", ")[:8] for r in topics.collect()}
    assert set(words[got[1 << 40]]) == set(kinds[0]) and set(words[got[(1 << 40) + 1]]) == set(kinds[1])


def test_attributes_in_any_order(spark):
    html = "<META content='uno' NAME=\"DC.Title\"><meta property=og:x content=dos/><meta name='dc.title' content=\"tres > dos\"><meta charset=utf-8><title lang=\"es\"> Hola </title>"
    got = spark.createDataFrame([(1, html)], "id int, h string").select(files.meta_tags(F.col("h")).alias("m")).first()["m"]
    assert got == {"og:x": "dos/", "dc.title": "tres > dos"}
    assert files.metadata(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), "h").orderBy("id").first()["titulo"] == "tres > dos"


def test_merge_and_replace(spark):
    from telarium.operators import store

    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, None, 3)], "id int, o string, n int")
    b = spark.createDataFrame([(2, "z", 5), (3, "w", None), (4, "v", 7)], "id int, o string, n int")
    got = store.merge(a, b, ["id"], {"o": "old", "n": lambda x, y: F.coalesce(y, x)}).collect()
    assert sorted(tuple(r) for r in got) == [(1, "x", 1), (2, "y", 5), (3, None, 3), (4, "v", 7)]
    assert sorted(r["id"] for r in store.replace(a, b.where("id < 3"), ["id"]).collect()) == [1, 2, 3]
    assert store.merge(a.limit(0), b.limit(0), ["id"], {"o": "old", "n": "new"}).count() == 0


@pytest.mark.parametrize("a, b", [("", ""), ("abc", ""), ("kitten", "sitting"), ("aaaa", "aa"), ("año·nuevo", "ano nuevos"), ("ab" * 40, "ba" * 40)])
def test_edit_distance_equals_table(a, b):
    from telarium.operators.similarity import edit_distance

    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    assert edit_distance(a, b) == row[-1]


def test_nth_word(spark):
    assert one(spark, "sol sol, sol y soles", cleaning.replace_word(F.col("c"), "sol", "luz")) == "luz luz, luz y soles"
    assert one(spark, "sol sol, sol", cleaning.replace_word(F.col("c"), "sol", "luz", 2)) == "sol luz, sol"
    assert one(spark, "sol", cleaning.replace_word(F.col("c"), "sol", "luz", 2)) == "sol"
    assert one(spark, "quizás el médico fué", cleaning.respell(F.col("c"), {"quizá": "quizás", "fué": "fue"})) == "quizás el médico fue"


def test_centralities_by_hand(spark):
    """A square with a heavy side and a tail: shortest ways by weight, shares of all pairs."""
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 5), ("d", "e", 1)], "a string, b string, peso int")
    got = {r["nodo"]: r for r in graph.centralities(edges).collect()}
    # ways through b: a-c a-d a-e; through c: a-d a-e b-d b-e; through d: a-e b-e c-e; of six pairs each
    assert {k: round(v["intermediacion"], 4) for k, v in got.items()} == {"a": 0.0, "b": 0.5, "c": 0.6667, "d": 0.5, "e": 0.0}
    assert got["d"]["cercania"] == 0.8 and got["e"]["cercania"] == 0.5
    ranks = {r["nodo"]: r["r"] for r in graph.settled_pagerank(edges, tolerance=1e-12).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == "d"
    parts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)], "nodo string, comunidad int")
    m, inside, k1, k2 = 9, 3, 8, 10
    assert graph.modularity(edges, parts).first()["modularidad"] == round((1 + 2) / m - (k1 / (2 * m)) ** 2 - (k2 / (2 * m)) ** 2, 4) and inside == 3


def _cosines(spark, df) -> dict:
    """The cosines of all pairs of texts, by brute force."""
    from itertools import combinations

    vec: dict = {}
    for r in similarity.tfidf(df).where("doc_id is not null").collect():
        vec.setdefault(r["doc_id"], {})[r["w"]] = r["x"]
    return {(a, b): sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) for a, b in combinations(sorted(vec), 2)}


def test_intertextual_graph_has_all_pairs_from_a_quarter_on(spark, monkeypatch):
    """F2, g6: texts that share some of their words are neighbours, not only near copies."""
    import random

    rng = random.Random(3)
    words = [a + b + "o" for a in ("cas", "puert", "jard", "camin", "maestr", "lej") for b in ("al", "er", "in")]
    texts = {(i * 7919) % 1000 - 300: " ".join(rng.choices(words, k=rng.randint(0, 9))) for i in range(70)}
    df = spark.createDataFrame([*texts.items(), (None, "casalo"), (5000, None)], "doc_id long, text string")
    df = df.select("doc_id", "text", *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "publicacion")), F.lit(None).cast("int").alias("anio"))
    sims = _cosines(spark, similarity_plans.toks(df, 4, similarity_plans.STOP))
    expected = Counter(x for pair, s in sims.items() if s >= 0.25 for x in pair)
    assert sum(0.25 <= s < 0.8 for s in sims.values()) > 100
    for block, rows, dense in ((20_000, 256, 1_000), (9, 4, 3), (20, 7, 0)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "ROWS", rows)
        monkeypatch.setattr(similarity, "DENSE", dense)
        assert {r["nodo"]: r["grado"] for r in similarity_plans.intertextual(df).collect()} == expected


def test_cosine_degrees_at_the_threshold_are_exact(spark):
    """A pair just at the threshold counts, one just under it doesn't, though single numbers can't tell them apart."""
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "d"]), (3, ["b", "e", "e"])], "doc_id long, t array<string>")
    sims = _cosines(spark, df)
    for pair, s in sims.items():
        for threshold in (s - 1e-12, s + 1e-12):
            expected = Counter(x for p, y in sims.items() if y >= threshold for x in p)
            if threshold > 0.01:
                assert {r["nodo"]: r["grado"] for r in similarity.cosine_degrees(similarity.tfidf(df), threshold).collect()} == expected, pair
