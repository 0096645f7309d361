"""Notes, quotes, keywords of a query, structured documents."""

import json

import pytest
from pyspark.sql import functions as F

from stacklight.operators import blocks as B
from stacklight.operators import notes as N
from stacklight.plans import notes as PN


def test_blocks_and_sentences():
    note = "# Head\n\nOne line\nwent on. Two.\n\n- item one\n> quote\n| a |\n```\ncode\n```\n<!-- gone -->"
    assert [k for k, _ in N.blocks(note)] == ["heading", "prose", "item", "quote", "table", "code"]
    assert [s for _, _, s, _ in N.note_sentences(note)] == ["One line went on.", "Two.", "item one"]


@pytest.mark.parametrize(
    ("sentence", "source", "risks"),
    [
        ("The coating never fails in service (chunk 1).", "The coating did well.", {"absolute-language"}), ("The axes are parallel here (chunk 1).", "x", {"relation-word"}),
        ("It was seen in both (chunk 1, 2) and again chunk 2.", "x", {"multi-chunk-fusion"}), ("The EBSD map shows it well (chunk 1).", "The map shows it.", {"subject-not-in-cited-chunks"}),
        ("The method works for steel (chunk 1).", "The method may work for steel.", {"hedge-dropped"}), ("The gap is 175 nm wide (chunk 1).", "The gap is 175 nm under load.", {"condition-dropped", "quantity"}),
        ("It increased by 10 percent (chunk 1).", "x", {"direction-word", "quantity"}), ("It increased a little (chunk 1).", "x", None), ("Plain words about steel (chunk 1).", "x", None),
    ],
)
def test_audit(spark, sentence, source, risks):
    lines = spark.createDataFrame([(1, 0, 0, sentence, sentence)], "note long, block int, k int, sentence string, block_text string")
    chunks = spark.createDataFrame([(1, 1, source), (1, 2, "y")], "note long, chunk_id long, text string")
    got = N.audit(lines, chunks).collect()
    assert (set(got[0]["risks"]) if got else None) == risks


def test_keywords_of_a_query():
    got = {t: (w, o) for t, w, o in N.fallback_keywords("温度梯度影响的定向凝固 of the X-ray")}
    assert got["温度梯度影响"] == (0.9, "token") and got["ray"] == (0.9, "token") and got["温度"] == (0.3, "ngram") and got["度梯"][0] == 0.15 and "the" not in got and "of" in got and len(got) <= 16
    assert N.fallback_keywords("a") == [("a", 0.9, "token")] and N.keyword_source([" Creep ", "creep"], "x") == ("provided", [("Creep", 1.0, "provided")])


def test_quotes():
    source = "At $250\\,\\mathrm{MPa}$ the  strain\nwas 3mm in all."
    a, z = N.find_quote(source, "the strain was 3 mm")
    assert source[a:z] == "the  strain\nwas 3mm" and N.find_quote(source, "the stress") is None and N.find_quote(source, "") is None
    assert N.canonical_source("5MPa and 3 mm") == "5 MPa and 3 mm"
    m = N.mismatch("the viscous layer delays it strongly", "the viscous layer slows it")
    assert m["expected"].startswith("delays") and m["found"].startswith("slows") and N.mismatch("abc", "abd") is None


def test_structure():
    text = "Abstract: " + "words of it. " * 8 + "\n\nKeywords: alpha, beta, gamma, delta\n\n1. Start\nshort text here\n\n2. More\n" + "A sentence of the body. " * 60 + "\n\nReferences\n[1] X"
    units = N.structure(text)
    assert [k for k, *_ in units][:4] == ["abstract", "keywords", "section", "section"] and all(len(t) <= 500 for *_, t in units) and not any("[1] X" in t for *_, t in units)
    assert N.structure("") == [] and len(N.structure("x" * 3000)) > 5


def test_structured_document(spark):
    page = [
        {"type": "header", "page_idx": 0, "text": "Journal"}, {"type": "text", "page_idx": 0, "text_level": 1, "text": "2.1 Setup"}, {"type": "text", "page_idx": 0, "text": "The specimen was held in the scaf-"},
        {"type": "page_number", "page_idx": 0, "text": "7"}, {"type": "text", "page_idx": 1, "text": "fold of steel and"}, {"type": "text", "page_idx": 1, "text": "then the scaffold broke."},
        {"type": "table", "page_idx": 1, "table_body": "<table><tr><td>a</td><td>1</td></tr></table>"}, {"type": "text", "page_idx": 3, "text": "New part."},
    ]
    d = spark.createDataFrame([(1, json.dumps(page)), (2, "not json"), (3, None), (4, "[]")], "doc_id long, body string")
    got = [(r["kind"], r["text"]) for r in B.assemble(B.read(d, ["doc_id"], "body"), ["doc_id"]).orderBy("doc_id", "n").collect()]
    assert got == [("heading", "### 2.1 Setup"), ("text", "The specimen was held in the scaffold of steel and then the scaffold broke."), ("table", "| a | 1 |"), ("text", "New part.")]


def test_excerpt(spark):
    long = "word " * 60 + "membrane " + "tail " * 60
    r = spark.createDataFrame([(long,), ("a membrane",), ("none",), (None,)], "t string").select(N.excerpt(F.col("t"), "membrane").alias("x")).collect()
    assert r[0]["x"].startswith("…") and r[0]["x"].endswith("…") and "membrane" in r[0]["x"] and r[1]["x"] == "a membrane" and r[2]["x"] is None and r[3]["x"] is None


def test_claim_risks_reads_whole_cited_chunks(spark, tmp_path):
    """A hedge behind 2,000 characters and one in a chunk other than the first; uncited chunks don't count."""
    notes = [(1, "note", "a", "The method works for steel."), (2, "note", "b", "The method works for steel (chunk 3).")]
    chunks = [(1, "a", 0, "x " * 1500 + "It may work."), (2, "a", 1, "plain"), (3, "b", 0, "plain"), (4, "b", 3, "It may work."), (5, "b", 4, "This is not so.")]
    spark.createDataFrame([(i, s, 1, k, t) for i, s, k, t in notes], "doc_id long, source string, library_id long, item_key string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r, 1, k, c, t) for r, k, c, t in chunks], "row_id long, library_id long, item_key string, chunk_id int, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["note"]: r["risks"] for r in PN.claim_risks(spark, str(tmp_path)).collect()}
    assert "hedge-dropped" in got[1] and "hedge-dropped" in got[2]


@pytest.mark.parametrize(
    ("wording", "text"),
    [
        (N.ABSOLUTE, "ensuring that"), (N.ABSOLUTE, "it maximises the"), (N.ABSOLUTE, "can  not be"), (N.DIRECTION, "by enhancing it"), (N.DIRECTION, "the degradation of"), (N.RELATION, "coinciding planes"),
        (N.HEDGE, "is a bottleneck"), (N.HEDGE, "hard to say"), (N.HEDGE, "possibilities"), (N.HEDGE, "to some extent"), (N.COMMITTED, "not a unique"), (N.COMMITTED, "a proposed explanation"), (N.CONDITION, "held at 600 K"),
        (N.CONDITION, "at a $T$"), (N.CONDITION, "for a thin specimen"), (N.CONDITION, "with a grain of"), (N.NEGATION, "fails to"), (N.NEGATION, "未采用"),
    ],
)
def test_wording(spark, wording, text):
    assert spark.createDataFrame([(text,)], "t string").filter(N.says(F.col("t"), wording)).count() == 1


@pytest.mark.parametrize(("wording", "text"), [(N.NEGATION, "non-equilibrium"), (N.COMMITTED, "generally often"), (N.HEDGE, "mayor"), (N.CONDITION, "at the surface"), (N.DIRECTION, "droplet")])
def test_wording_that_says_nothing(spark, wording, text):
    assert spark.createDataFrame([(text,)], "t string").filter(N.says(F.col("t"), wording)).count() == 0


def test_best_structured_source(spark):
    files = [
        (1, "x_content_list.json", '[{"type": "text", "page_idx": 3, "text": "flat"}]'), (1, "x_content_list_v2.json", '[[{"type": "title", "content": {"text": "best", "level": 2}}], [{"type": "page_number", "text": "7"}, {"type": "paragraph", "text": "next"}]]'),
        (2, "model.json", '[[{"type": "text", "text": "m"}, {"type": "text", "text": ""}]]'), (3, "other.json", "[]"), (4, "content_list.json", "[]"),
    ]
    df = spark.createDataFrame(files, "d int, name string, body string")
    got = sorted(tuple(r) for r in B.read_best(df, ["d"], "name", "body").select("d", "format", "page", "kind", "text").collect())
    assert got == [(1, "content_list_v2", 0, "title", "best"), (1, "content_list_v2", 1, "paragraph", "next"), (2, "model", 0, "text", "m")]
    with pytest.raises(Exception, match="isn't JSON"):
        B.read_best(spark.createDataFrame([(1, "model.json", "[{")], "d int, name string, body string"), ["d"], "name", "body").collect()
