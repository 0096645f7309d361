"""Operators against literal values, brute force and the SQL of every query."""

import math
import os
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import fusion as X
from stacklight.operators import graph as G
from stacklight.operators import lexical as L
from stacklight.operators import links as K
from stacklight.operators import maintenance as M
from stacklight.operators import measures as ME
from stacklight.operators import pages as PG
from stacklight.operators import sections as SE
from stacklight.operators import structured as S
from stacklight.operators import textprep as P
from stacklight.operators import vectors as V
from stacklight.plans import registry

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


# --- every query with SQL, on the smallest tables ---


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def canon(df):
    cell = lambda x: "none" if x is None or x != x else f"{float(x):.6f}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


# --- tokens ---


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ti–6Al–4V", ["ti-6al-4v", "ti6al4v"]), ("γ′", ["γ'", "gamma'"]), ("x-ray", ["x-ray", "xray"]), ("a b γ", ["γ", "gamma"]), ("深冷声", ["深冷", "冷声"]), ("冷", ["冷"]),
        ("superalloy. 10.1016/j.msea", ["superalloy", "10.1016/j.msea", "101016jmsea"]), ("", []), ("the the", ["the", "the"]),
    ],
)
def test_index_tokens(spark, text, want):
    assert sorted(one(spark, T.index_tokens(F.col("t")), t=text)) == sorted(want)


def test_plans():
    assert [(t, v) for _, t, v, _ in L.plan("深冷声")] == [(["深冷", "冷声"], True)]
    assert [(t, v) for _, t, v, _ in L.plan("深冷")] == [(["深冷"], False)]
    assert [p for *_, p in L.plan("Ti-6Al")] == ["ti-6al", "ti6al"]
    assert [p for *_, p in L.plan("γ′ phase")] == ["γ' phase", "gamma prime phase"]
    assert L.normalize_keywords([" a ", "A", "", "b" * 200]) == ["a", "b" * 120]


def test_idf_and_saturation(spark):
    assert one(spark, L.idf(F.lit(10.0), F.lit(9))) >= 0 and one(spark, L.idf(F.lit(0.0), F.lit(1))) == 0
    assert one(spark, L.idf(F.lit(100.0), F.lit(3))) == pytest.approx(math.log(1 + 97.5 / 3.5))
    assert one(spark, L.saturate(F.lit(4.0))) == 0.5 and one(spark, L.saturate(F.lit(-1.0))) == 0
    assert one(spark, L.weighted_frequency(F.lit(2), F.lit(0), F.lit(0.0), F.lit(3.0), F.lit(0.5))) == 6


# --- fusion ---


def test_rrf(spark):
    f = lambda xs: X.admitted(spark.createDataFrame(xs, "k string, score double"), ["k"], 0.0)
    out = X.rrf({"keyword": (f([("A", 9.0), ("B", 7.0), ("C", 5.0)]), 1.0), "semantic": (f([("B", 0.9), ("C", 0.8), ("D", 0.7)]), 1.0)}, ["k"]).orderBy("rank").collect()
    assert [r["k"] for r in out] == ["B", "C", "A", "D"] and out[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_floors_only_rise(spark):
    d = spark.createDataFrame([("a", 0.55), ("a", 0.7), ("b", 0.5), ("c", 0.65)], "k string, score double")
    assert [(r["k"], r["rank"]) for r in X.admitted(d, ["k"], 0.52, 0.1).orderBy("rank").collect()] == [("a", 1), ("c", 2)]


def test_cursor_and_fingerprint():
    a, b = X.fingerprint("Creep  of", ["b", "A"]), X.fingerprint("creep of", ["a", "B "])
    assert a == b and X.read_cursor(X.cursor("p", a, 20), "p", a) == 20 and X.page_size(99, 50) == 20 and X.page_size(None, 8) == 8
    with pytest.raises(ValueError):
        X.read_cursor(X.cursor("p", a, 20), "p", "other")


# --- vectors ---


def test_quantize(spark):
    v = [float(np.float32(x)) for x in (0.1, -0.5, 0.9, -0.1, 0, 0.123, -0.999, 0.5)]
    d = spark.createDataFrame([(v,), ([0.0] * 4,)], "v array<float>")
    q, s = V.quantize(F.col("v"))
    out = d.select(q.alias("q"), s.alias("s")).collect()
    assert out[0]["q"] == [13, -64, 114, -13, 0, 16, -127, 64] and out[1]["s"] == 1


def test_grouped_top_k_is_not_crowded_out(spark):
    data = [(i, "big", [1.0, i * 1e-5]) for i in range(3000)] + [(3000 + i, f"d{i}", [1.0, 0.2 + i * 1e-3]) for i in range(300)]
    index = spark.createDataFrame(data, "id long, doc string, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    hits = V.scan(index, q, ["id", "doc"], dim=2)
    got = V.grouped_top_k(hits, ["doc"], "id", 2, 10).select("doc").distinct().count()
    assert got == 10
    x = np.array([r[2] for r in data])
    best = np.argsort(-np.round(x[:, 0] / np.linalg.norm(x, axis=1), 12), kind="stable")[:5]
    assert [r["id"] for r in V.top_k(V.scan(index, q, ["id", "doc"], dim=2, best=5), 5, "id").orderBy("rank").collect()] == [data[i][0] for i in best]


def test_scan_in_blocks_of_queries(spark):
    """More queries than are broadcast at a time, and what leaves a batch, change nothing."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    index = spark.createDataFrame([(i, f"d{i % 7}", i % 2, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)], "id long, doc string, lib int, vector array<float>")
    q = index.filter("id % 10 = 0").select(F.col("id").alias("query_id"), "vector", "lib")
    whole = {(r["query_id"], r["id"]): r["score"] for r in V.scan(index, q, ["id"], dim=8).collect()}
    assert len(whole) == 30 * 300
    assert whole == {(r["query_id"], r["id"]): r["score"] for r in V.scan(index, q, ["id"], dim=8, most=4).collect()}
    docs = lambda h: sorted(tuple(r) for r in V.top_k(h, 2, "id", ["query_id", "doc"]).select("query_id", "doc", "id", "rank").collect())
    assert docs(V.scan(index, q, ["id", "doc"], dim=8)) == docs(V.scan(index, q, ["id", "doc"], dim=8, per=(["doc"], 2), most=7))
    same = {(r["query_id"], r["id"]) for r in V.scan(index, q, ["id"], dim=8, same="lib", most=11).collect()}
    assert same == {(a, b) for a, b in whole if a % 2 == b % 2}
    stats = {r["query_id"]: r for r in V.scan_stats(index, q, dim=8, most=4).collect()}
    assert len(stats) == 30 and all(r["n"] == 300 and abs(r["high"] - max(s for (a, _), s in whole.items() if a == i)) < 1e-6 for i, r in stats.items())
    assert V.scan(index, q.limit(0), ["id"], dim=8).count() == 0 and V.scan(index.limit(0), q, ["id"], dim=8).count() == 0


def test_dimension_guard(spark):
    d = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<float>")
    with pytest.raises(Exception, match="expected 2 dimensions"):
        V.assert_dimension(d, "v", 2).collect()


def test_similar_documents(spark):
    hits = spark.createDataFrame([(7, 1, "a", 0, 0.8), (7, 1, "a", 1, 0.6), (7, 1, "a", 2, 0.5), (7, 2, "b", 0, 1.0), (8, 1, "a", 0, 0.8)], "search int, query_id long, doc string, chunk int, score double")
    searches = spark.createDataFrame([(7, 2, None), (8, 1, 0.9)], "search int, n_queries int, floor double")
    got = V.similar_documents(hits, ["doc"], "chunk", searches).collect()
    out = {r["doc"]: r for r in got}
    assert [(r["search"], r["doc"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, "b", 1), (7, "a", 2)]
    assert out["a"]["score"] == pytest.approx(0.75 * 0.35 + 0.25 * 0.7) and out["b"]["score"] == pytest.approx(0.75 * 0.5 + 0.25) and out["a"]["evidence"] == [0, 1, 2]


# --- structured ---


def test_predicates(spark):
    d = spark.createDataFrame([(1, "Alpha Beta"), (2, None), (3, "")], "id int, t string")
    ids = lambda c: [r["id"] for r in d.filter(c).orderBy("id").collect()]
    assert ids(S.matches(F.col("t"), "BETA", "endsWith")) == [1] and ids(S.matches(F.col("t"), "", "exact")) == [2, 3] and ids(S.matches(F.col("t"), "^al.*a$", "regex")) == [1]
    for bad in ("(a+)+", "(a|b)*", r"(a)\1", "x" * 200):
        with pytest.raises(ValueError):
            S.safe_pattern(bad)
    with pytest.raises(ValueError):
        S.year_range(F.col("t"), "soon")


def test_tags(spark):
    d = spark.createDataFrame([(1, ["A", "b"]), (2, ["c"]), (3, None)], "id int, tags array<string>")
    ids = lambda m, a: [r["id"] for r in d.filter(S.tag_filter(F.col("tags"), a, m)).orderBy("id").collect()]
    assert (ids("any", ["a", "c"]), ids("all", ["a", "b"]), ids("none", ["a"])) == ([1, 2], [1], [2, 3])


def test_trees_with_a_cycle(spark):
    n = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("y", "x", "Y")], "node string, parent string, name string")
    d = {(r["root"], r["node"]) for r in S.descendants(n.filter("parent is not null"), n.filter("node in ('a', 'x')")).collect()}
    assert d == {("a", "a"), ("a", "b"), ("a", "c"), ("x", "x"), ("x", "y")}
    p = {r["node"]: r["path"] for r in S.paths(n).collect()}
    assert p["c"] == "A/B/C" and p["a"] == "A" and set(p) == {"a", "b", "c", "x", "y"}


def test_colours(spark):
    assert one(spark, S.colour_matches(F.lit("#FFD400"), "Yellow")) and not one(spark, S.colour_matches(F.lit("#ffd400"), "#ff6666")) and one(spark, S.colour_name(F.lit("#2EA8E5"))) == "blue"


# --- text ---


def test_sentences():
    assert P.sentences("See Fig. 2 and cf. Ref. 3. It is 3. 5 mm wide! 好。是；1. next") == ["See Fig. 2 and cf. Ref. 3.", "It is 3. 5 mm wide!", "好。", "是；", "1. next"]
    assert P.sentences("version 1.2 e.g. this") == ["version 1.2 e.g. this"]


def test_chunks():
    text = "# Head\n\n" + "\n\n".join(f"p{i} " + "word " * 60 for i in range(12)) + "\n\n## Sub\n\n" + "sentence here. " * 200
    parts = P.chunks(text)
    assert all(len(p) <= P.TARGET + P.TOLERANCE + 20 for p in parts) and parts[0].startswith("# Head\n\np0") and any(p.startswith("## Sub\n\nsentence") for p in parts)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert P.chunks("x" * 4000) and max(map(len, P.chunks("x" * 4000))) <= 1500 and P.chunks("") == [] and P.chunks("# only") == ["# only"]
    assert P.positions(text, parts) == sorted(P.positions(text, parts))


def test_body():
    text = "# Intro\nbody ![a](b.png) text\n## Acknowledgements\nthanks\n## Results\nmore deadbeefdeadbeefdead\n[1] A. B. (2001)\nReferences\nold\n# References\n[2] X"
    body, gone = SE.body_for_index(text)
    assert "thanks" not in body and "more" in body and "deadbeef" not in body and "[1]" not in body and "old" in body and "[2]" not in body and gone["boilerplate"] > 0
    assert SE.no_body("References\nx") and SE.no_body("[1] A (2001)\ntext") and not SE.no_body("plain prose\nand more")


@pytest.mark.parametrize("name", SE.FORMAL_HEADINGS)
def test_formal_sections(name):
    text = f"# Intro\nbody\n## 3. {name.title()}:\nthanks\n# Results\nmore"
    body, gone = SE.body_for_index(text)
    assert body == "# Intro\nbody\n# Results\nmore" and gone["boilerplate"] == len(text) - len(body)
    assert SE.no_body(f"{name}\nsome text") and SE.no_body(f"> **# {name.upper()}.\nsome text") and not SE.no_body(f"{name} of something\nsome text")


def test_lines_of_no_body():
    assert [SE.reference_line(x) for x in ("[12] A. Bo, J. 531 (2012) 91", "[3] X, 1999", "[3] X 2001; 4", " [1] no year", "[1234] X (2001)", "[a] X (2001)", "x [1] (2001)", "[1]X (2001)")] == [True, True, True, False, False, False, False, False]
    assert [SE.image_line(x) for x in ("![a](images/b.png)", "[a](b)", " figures/1.png ", "Image/x y", "text ![a](b)", "![a](b) tail", "images/")] == [True, True, True, False, False, False, False]
    assert SE.cut_images("a ![x](y) b <IMG src='q'> c <imgs> ![open") == "a   b   c <imgs> ![open"
    assert SE.cut_opaque("see 0123456789abcdef and " + "Ab1+" * 8 + "Z end, deadbeef _0123456789abcdef") == "see   and   end, deadbeef _0123456789abcdef"
    assert SE.references_boundary("References\nx\n# 5. References:\ny") == 13 and SE.references_boundary("References are many") is None


def test_front_matter():
    abstract = "We measure " + " ".join(f"word{i}" for i in range(25)) + "."
    text = "\n\n".join([
        "# On Layered Garnet Films", "A. Bo, C. Deng", "$^{a}$ Department of Physics, University of X", "# A B S T R A C T", "Abstract: " + abstract, "Received 3 May 2019; accepted 4 June 2019", "doi: 10.1/x",
        "# Keywords", "garnet", "thin films", "# 1. Introduction", "On Layered Garnet Films", "doi: 10.1/y",
    ])
    body, gone = SE.front_matter(text, "On Layered Garnet Films", abstract, "A. Bo C. Deng")
    assert body == "# 1. Introduction\n\nOn Layered Garnet Films\n\ndoi: 10.1/y" and all(gone.values())
    assert SE.front_matter("First.\n\nSecond.", "A Longer Title Here", "", "")[0] == "First.\n\nSecond." and SE.front_matter("", "", "", "")[0] == ""
    # Behind the abstract two paragraphs in a row that nothing claims end the front matter.
    text = "\n\n".join([abstract, "Stray.", "doi: 10.1/x", "First of the body.", "Second of it.", "doi: 10.1/y"])
    assert SE.front_matter(text, "", abstract, "")[0] == "Stray.\n\nFirst of the body.\n\nSecond of it.\n\ndoi: 10.1/y"
    assert SE.affiliation("School of Mines, Golden, 80401") and SE.affiliation("中国科学院金属研究所，沈阳, 辽宁省") and not SE.affiliation("The university was founded by many people")
    assert SE.record_line("(21) 申请号 2020") and SE.record_line("CN 101234567 A") and SE.record_line("arXiv: 2001.01234") and not SE.record_line("We received data")


def test_text_helpers(spark):
    assert P.smart_truncate("one two three four", 12).endswith("…") and P.smart_truncate("short", 50) == "short"
    assert P.grep("aXbxc", "x", 1) == (2, [(1, "aXb"), (3, "bxc")])
    assert P.longest_prefix("abcdef", "zzabcdzz") == 4 and P.pack([5, 5, 20, 1, 1], 10, 2) == [0, 0, 1, 2, 2]
    assert P.window("a" * 10 + ". b", 0, 5)[1] == 11
    assert P.drop_repeated_lines("\n".join(["header line"] * 5 + ["x", "y"])) == "x\ny"
    assert SE.containment(["a", "a", "b"], ["a", "b"]) == pytest.approx(2 / 3)
    assert one(spark, T.redact(F.lit("at /home/u/x.pdf, https://h/home/u and C:\\a\\b"))) == "at [local path], https://h/home/u and [local path]"
    assert one(spark, T.citations(F.lit("[chunk:12], chunks 14-16、18; chunks 9-3; 第7段"))) == [7, 12, 14, 15, 16, 18]
    assert one(spark, T.measurements(F.lit("at 007 MPa and 3.5 mm, 12 mAx"))) == ["7MPa", "3.5mm"]
    assert PG.page_text("<style>x</style><p>a &amp; b</p><ul><li>c</ul><!-- d -->") == "a & b\n\n• c"
    assert one(spark, T.bigram_overlap(F.lit("abcd"), F.lit("xxabcdxx"))) == 1 and one(spark, T.bigram_overlap(F.lit("abcd"), F.lit("abxcd"))) == pytest.approx(2 / 3)
    for head, skip in (("References", True), ("致谢", True), ("## References", True), ("Referencesx", False), ("ordinary prose", False)):
        assert one(spark, T.boundary(F.lit(head + "\nx"))) is skip
    assert one(spark, T.reference_list(F.lit("[1] a [2] b [3] c [4] d [5] e [6]")))


def test_nfkc(spark):
    f = F.pandas_udf(T.nfkc, "string")
    assert [r[0] for r in spark.createDataFrame([("ﬁ５",), (None,)], "t string").select(f("t")).collect()] == ["fi5", None]


# --- graph ---


@pytest.mark.parametrize(("n", "want"), [(0, 0), (5, 5), (11, 11), (12, 12), (150, 13), (400, 20), (100000, 20)])
def test_representative_target(spark, n, want):
    assert one(spark, K.representative_target(F.lit(n))) == want


def test_representatives(spark):
    data = [(i, "d", i, [float(j == i // 50) for j in range(8)]) for i in range(400)]
    r = K.representatives(spark.createDataFrame(data, "id long, doc string, chunk_id int, vector array<float>"), ["doc"], "chunk_id", "vector").collect()
    assert {x["pos"] // 50 for x in r} == set(range(8))
    assert K.farthest_first(np.eye(5), [0], 3) == [0, 1, 2] and K.farthest_first(np.ones((5, 2)), [0], 3) == [0]


@pytest.mark.parametrize("fill_rows", [0, 1000])
def test_representatives_are_filled(spark, fill_rows):
    """Copies are passed over and the farthest others take their places, in one call or step by step."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 6)), 30, 0) + 1e-4 * rng.normal(size=(30, 6)), rng.normal(size=(34, 6))])
    data = [(i, doc, i, [float(v) for v in r]) for doc in ("a", "b") for i, r in enumerate(x if doc == "a" else x[:14])]
    data = [(k, d, c, v) for k, (_, d, c, v) in enumerate(data)]
    got = K.representatives(spark.createDataFrame(data, "id long, doc string, chunk_id int, vector array<float>"), ["doc"], "chunk_id", "vector", fill_rows).collect()
    for doc, n in (("a", 64), ("b", 14)):
        v = np.array([r[3] for r in data if r[1] == doc], "f4").astype("f8")
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        picks = []
        for b in range(12):
            band = range(b * n // 12, max(b * n // 12 + 1, (b + 1) * n // 12))
            centre = v[list(band)].mean(0)
            picks.append(max(band, key=lambda i: (round(float(u[i] @ centre / np.linalg.norm(centre)), 9), -i)))
        want = []
        for i in picks:
            if not want or max(round(float(u[i] @ u[j]), 9) for j in want) < 0.94:
                want.append(i)
        while len(want) < 12:
            near, k = min((max(0, *(round(float(u[i] @ u[j]), 9) for j in want)), i) for i in range(n))
            if near >= 0.94:
                break
            want.append(k)
        assert sorted(r["pos"] for r in got if r["doc"] == doc) == sorted(want)


def test_links_in_both_directions(spark):
    """A paper that covers another's one subject among many isn't covered by it: the link is weaker than its stronger side."""
    e = np.eye(8)
    docs = {"1:A": [0, 0, 0], "1:B": [0, 1, 2, 3, 4, 5], "1:C": [0, 0], "1:D": [6, 7], "2:E": [0, 0]}
    rows = [(d, k, e[i] + 0.01 * e[(i + k) % 8]) for d, ks in docs.items() for k, i in enumerate(ks)]
    v = spark.createDataFrame([(n, int(d[0]), d, [float(x) for x in vec]) for n, (d, _, vec) in enumerate(rows)], "id long, library long, document string, vector array<float>")
    got = {(r["source"], r["target"]): r for r in K.linked(v, v.select("id"), v, dim=8, block=2).collect()}
    assert ("1:A", "1:C") in got and not any("2:E" in k or "1:D" in k for k in got)
    assert got["1:A", "1:C"]["symmetric"] > 0.9 and all(got[a, b]["forward"] != got[a, b]["reverse"] or a + b in ("1:A1:C", "1:C1:A") for a, b in got if "1:B" in (a, b))
    assert K.linked(v.limit(0), v.select("id").limit(0), v.limit(0), dim=8).count() == 0




@pytest.mark.parametrize(("counts", "want"), [((1, 1, 0, 0), "open"), ((0, 1, 1, 0), "resolved"), ((0, 0, 1, 1), "dismissed"), ((0, 0, 0, 1), "stale"), ((0, 0, 0, 0), "open")])
def test_link_status(spark, counts, want):
    assert one(spark, G.link_status(dict(zip(("pending", "accepted", "rejected", "stale"), map(F.lit, counts))))) == want


@pytest.mark.parametrize(("term", "want"), [("nickel", True), ("ab", False), ("in718", True), ("300", False), ("合金", False), ("mm/min", False), ("gamma", False), ("mathrm", False), ("however", False)])
def test_usable_term(spark, term, want):
    assert one(spark, G.usable_term(F.lit(term))) is want


def test_concept_edges(spark):
    d = spark.createDataFrame([(1, x, c) for x, c in (("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 2), ("c", 3), ("d", 9))], "g int, doc string, c int")
    out = {(r["a"], r["b"]): r["score"] for r in G.concept_edges(d, "g", "doc", "c").collect()}
    assert out == {("a", "b"): pytest.approx(math.log(5 / 3) + math.log(5 / 4), abs=1e-6), ("a", "c"): pytest.approx(math.log(5 / 4), abs=1e-6), ("b", "c"): pytest.approx(math.log(5 / 4), abs=1e-6)}


def test_diversified_choice():
    import pandas as pd

    c = pd.DataFrame([(1, i, f"t{i % 4}", 0.5 + i / 100, "k", "s" if i < 5 else "z", False) for i in range(6)], columns=["concept_id", "claim_id", "text", "confidence", "kind", "source", "limitation"])
    got = G.diversified(c, 3)
    assert list(got["claim_id"]) == [5, 4, 3] and list(got["rank"]) == [1, 2, 3]


# --- maintenance ---


def test_queue(spark):
    d = spark.createDataFrame([(1, "refresh", 5, 1), (1, "delete", 3, 2), (1, "refresh", 9, 3), (2, "refresh", 1, 4), (2, "refresh", 7, 5)], "k int, op string, at int, seq int")
    assert {r["k"]: (r["operation"], r["at"]) for r in M.coalesced(d, ["k"], "op", "at", "seq").collect()} == {1: ("delete", 3), 2: ("refresh", 7)}
    assert [one(spark, M.delete_delay(F.lit(n))) for n in (1, 2, 4, 9)] == [60, 120, 480, 600] and [one(spark, M.embed_delay(F.lit(n))) for n in (0, 3, 9)] == [0, 600, 7200]
    assert [one(spark, M.circuit(F.lit(f), F.lit(s))) for f, s in ((1, 0), (3, 10), (3, 90), (9, 500), (9, 700))] == ["closed", "open", "half-open", "open", "half-open"]


def test_timing_and_budget(spark):
    d = spark.createDataFrame([(80.0,), (120.0,)], "ms double")
    assert M.timing(d, "ms").collect()[0]["allow"] == 3000
    assert M.scan_budget(10, 4) == pytest.approx(22) and M.scan_budget(10**6, 9) == 3600 and M.next_batch(1000, None) == 2000 and M.next_batch(10_000, 30_000) == 20_000 and M.next_batch(10_000, 10_500) == 10_000


def test_replace_index(spark, tmp_path):
    p = str(tmp_path / "index")
    spark.createDataFrame([(1, "a"), (2, "b")], "lib int, v string").write.partitionBy("lib").parquet(p)
    M.replace_index(spark.createDataFrame([("c", 2)], "v string, lib int"), p, "lib")
    assert sorted((r["lib"], r["v"]) for r in spark.read.parquet(p).collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        M.assert_complete(spark.range(3), 4)


def test_attachment(spark):
    d = spark.createDataFrame([(1, "a", True, False), (1, "b", False, False), (2, "c", True, False), (2, "d", True, False), (3, "e", True, True)], "k int, attachment string, readable boolean, generated boolean")
    assert {r["k"]: (r["candidates"], r["attachment"]) for r in M.attachment(d, ["k"]).collect()} == {1: (1, "a"), 2: (2, None), 3: (0, None)}


def test_retry_stream(spark, tmp_path):
    from stacklight.streaming import refresh as R

    src = tmp_path / "log"
    spark.createDataFrame([("a", i, True) for i in range(3)] + [("b", 0, True), ("b", 1, False)], "k string, seq int, failed boolean").coalesce(1).write.parquet(str(src))
    out: list = []
    q = R.retry_stream(spark.readStream.schema("k string, seq int, failed boolean").parquet(str(src)), "k", "failed").writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: (r["attempts"], r["state"]) for r in out} == {"a": (3, "retry"), "b": (0, "done")}


def test_stands_without_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "stacklight")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "stacklight.llm" not in open(os.path.join(folder, f)).read()
    assert sys.modules


def test_concept_edges_up_to_forty_papers(spark):
    """The application's bound: a concept of 40 papers makes all pairs, one of 41 none."""
    r = spark.createDataFrame([(1, f"d{i:02}", c) for c, n in (("wide", 40), ("over", 41)) for i in range(n)], "g int, d string, c string")
    got = G.concept_edges(r, "g", "d", "c").collect()
    assert len(got) == 40 * 39 // 2 and {x["shared"] for x in got} == {1}


def test_text_window_walks_the_whole_text(spark, tmp_path):
    text = "A plain sentence of words. " * 80
    spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(registry.queries()["text_window"](spark, str(tmp_path)).collect(), key=lambda r: r["stop"])
    assert len(got) > 2 and "".join(r["part"] for r in got) == text and got[-1]["stop"] == len(text)


def test_pages():
    html = "<style>x</style><h2 class='a'>He<b>ad</b></h2><p>a &amp; <em>b</em><br/>c</p><ul><li>x<li>y</ul><ol><li>one</li><li>two<ol><li>in</li></ol></li></ol><!-- no --><script>if (a < b) {}</script>end"
    assert PG.page_text(html) == "## He**ad**\n\na & *b*\nc\n\n• x\n• y\n\n1. one\n2. two\n\n1. in\n\nend"
    assert PG.page_text(html, markdown=False).startswith("Head\n\na & b") and PG.page_text("") == "" and PG.page_text("<p>open") == "open"
    assert PG.wrapped("aa bb cc\ndddddd e", 5) == "aa bb\ncc\ndddddd\ne"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("at 1750 K and 0.1 MPa", ["1750", "0.1"]), ("$3 5 0 ~ ^ { \\circ } \\mathrm { C }$", ["350"]), ("Pressure (MPa) 0.1(atm) 25 50 75 in", ["0.1", "25", "50", "75"]), ("| a | 12 | 3.5 |", ["12", "3.5"]),
        ("8.56 ± 0.2 wt. % of it", ["8.56"]), ("007 s, 12 mAx, 5 kgx, in 2019", ["7"]), ("$0. 1$ m / s", ["0.1"]), ("costs $5 and 3 h", ["3"]), ("", []), ("10 \\mu m wide", []),
    ],
)
def test_measured_values(text, want):
    assert ME.measured_values(text) == want


def test_compatibility_forms(spark):
    assert one(spark, T.fold(F.col("t")), t="Ｔｉ－６Ａｌ　ﾃｽﾄ ℃ ª ″") == "ti-6al テスト ℃ a '" 
    assert one(spark, T.fold(F.col("t")), t="ＧＲＡＩＮ") == L.fold("ＧＲＡＩＮ")
