"""The registered queries on the smallest tables: SQL where there is one, brute force elsewhere."""

import os
import random
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest

from stacklight.llm import queries as Q
from stacklight.llm import canonical, nearest, splitting, tokenize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, name):
    got, want = Q.queries()[name](spark, DATA).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    row = lambda df: sorted(tuple("none" if x != x or x is None else f"{float(x):.6f}" for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert row(got) == row(want)


def test_found_rows_have_the_stated_columns(spark):
    want = {"p1_found": ["input_id", "concept_id"], "p2_found": ["row_id"], "p3_found": ["library_id", "concept_a", "concept_b"], "p4_found": ["row_id", "noise_kind"], "p5_found": ["id_a", "id_b"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_a", "doc_b"]}
    for name, columns in want.items():
        df = Q.queries()[name](spark, DATA)
        assert df.columns == columns and df.count() == df.dropDuplicates([c for c in columns if c != "ids"]).count()


def test_p1(spark):
    got = Q.p1_found(spark, DATA).toPandas()
    i, t = (pd.read_parquet(f"{DATA}/{n}.parquet") for n in ("wiki_concept_inputs", "wiki_concept_terms"))
    listed = {x for c in ("name_en", "name_zh", "abbreviation") for x in t[c] if x}
    fields = i[["canonical_name", "alias_text", "abbr"]]
    said, exact = fields.map(lambda x: isinstance(x, str) and bool(x.strip())).any(axis=1), fields.isin(listed).any(axis=1)
    assert set(got["input_id"]) == set(i["input_id"][said]) - set(i["input_id"][exact])
    # Names that differ in case only are found.
    low = {n.lower(): c for n, c in zip(t["name_en"], t["concept_id"]) if n}
    for k, n in zip(i["input_id"], i["canonical_name"]):
        if isinstance(n, str) and n.lower() in low and k in set(got["input_id"]):
            assert got.set_index("input_id")["concept_id"][k] == low[n.lower()]


def test_p1_on_altered_names(spark):
    """Listed names altered in known ways lead to their concepts; names of other meanings lead to none."""
    rng = random.Random(4)
    t = pd.read_parquet(f"{DATA}/wiki_concept_terms.parquet")
    listed = {n.lower() for n in t["name_en"] if n}
    en = [(n, c) for n, c in zip(t["name_en"], t["concept_id"]) if n and n.count(" ") and n.isascii()]

    def typo(n):
        k = rng.randrange(2, len(n) - 2)
        return rng.choice([n[:k] + n[k + 1 :], n[:k] + rng.choice("aeiorst") + n[k:], n[:k] + rng.choice("aeiorst") + n[k + 1 :], n[:k] + n[k + 1] + n[k] + n[k + 2 :]])

    ways = [str.upper, typo, lambda n: f"effect of {n}", lambda n: f"{n} process", lambda n: n.replace(" ", "_"), lambda n: "".join(chr(ord(c) + 0xFEE0) if c != " " else "　" for c in n), lambda n: f"{n.split(' ', 1)[1]} ({n.split(' ', 1)[0]})", lambda n: f"“{n}”;"]
    rows = [(way(n), c) for k, (n, c) in enumerate(en) for way in rng.sample(ways, 3)]
    firsts, seconds = [n.split(" ", 1)[0] for n, _ in en], [n.split(" ", 1)[1] for n, _ in en]
    rows += [(x, -1) for x in {f"{rng.choice(firsts)} {rng.choice(seconds)}" for _ in range(300)} if x not in listed]
    rows += [("ordinary unrelated index", -1), ("of the", -1), ("molybdenum groove", -1)]
    src = spark.createDataFrame([(i, n, None, None) for i, (n, _) in enumerate(rows)], "input_id long, canonical_name string, alias_text string, abbr string")
    got = {r["input_id"]: r["concept_id"] for r in canonical.map_names(src, spark.read.parquet(f"{DATA}/wiki_concept_terms.parquet")).collect()}
    right = [got[i] == c for i, (_, c) in enumerate(rows)]
    assert len(got) == len(rows) and np.mean(right) >= 0.97 and np.mean([ok for ok, (_, c) in zip(right, rows) if c == -1]) >= 0.97


def test_p4_against_proofs(spark):
    text = Q.p4_text(spark, DATA).toPandas().set_index("row_id")["clean_text"]
    proofs = pd.read_parquet(f"{DATA}/scan_proofs.parquet")
    assert np.mean([text[r] == c for r, c in zip(proofs["row_id"], proofs["clean_text"])]) >= 0.5
    proofs = pd.read_parquet("/root/testdata/sf0.1/scan_proofs.parquet")
    text = Q.p4_text(spark, "/root/testdata/sf0.1").toPandas().set_index("row_id")["clean_text"]
    assert np.mean([text[r] == c for r, c in zip(proofs["row_id"], proofs["clean_text"])]) >= 0.95
    assert Q.p4_text(spark, DATA).count() == len(pd.read_parquet(f"{DATA}/chunks.parquet"))


def test_p5(spark):
    v = pd.read_parquet(f"{DATA}/vectors_f32.parquet")
    v = v[v["vector"].map(lambda x: x is not None and len(x) == 64 and np.any(x))]
    m = np.stack(v["vector"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    ids = v["id"].to_numpy()
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(s)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.9}
    got = {tuple(r) for r in Q.p5_found(spark, DATA).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    near = Q.p5_neighbours(spark, DATA)
    assert {"query_chunk_id", "hit_chunk_id", "cosine", "rank"} <= set(near.columns) and near.count() == 10 * len(ids)


def test_p5_recall_where_few_lists_are_probed(spark):
    """9,924 usable vectors have 199 lists, of which 32 are probed."""
    v = pd.read_parquet("/root/testdata/sf0.1/vectors_f32.parquet")
    v = v[v["vector"].map(lambda x: x is not None and len(x) == 64 and np.any(x))]
    m = np.stack(v["vector"]).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = v["id"].to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    s = m[asked] @ m.T
    s[np.arange(len(asked)), asked] = -9
    got = defaultdict(set)
    for r in nearest.top_k(spark.read.parquet("/root/testdata/sf0.1/vectors_f32.parquet")).filter("id % 50 = 0").collect():
        got[r["id"]].add(r["neighbour"])
    assert np.mean([len(got[ids[i]] & set(ids[np.argsort(-s[k])[:10]])) / 10 for k, i in enumerate(asked)]) >= 0.9


def test_p6(spark):
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    enc = tokenize.encoder()
    assert {r["doc_id"]: list(r["ids"]) for r in Q.p6_ids(spark, DATA).collect()} == {i: enc.encode_ordinary(t or "") for i, t in zip(d["doc_id"], d["text"])}


def test_p7(spark):
    r = Q.p7_report(spark, DATA).toPandas()
    r = r[r["planned_tokens"] > 0]
    assert abs(r["reached_share"].sum() - 1) < 1e-9 and ((r["mixed_tokens"] - r["planned_tokens"]).abs() <= 3000).all() and (r["most_copies"] <= r["max_repeats"]).all()
    assert Q.p7_mixture(spark, DATA).count() > 0


def test_p8(spark):
    d = pd.read_parquet(f"{DATA}/documents.parquet").dropna(subset=["text"])
    where = defaultdict(set)
    for i, t in zip(d["doc_id"], d["text"]):
        for p in range(len(t) - 99):
            where[t[p : p + 100]].add(i)
    want = {p for s in where.values() for p in combinations(sorted(s), 2)}
    assert {tuple(r) for r in Q.p8_found(spark, DATA).collect()} == want
    assert Q.p8_shared(spark, DATA).count() == len(pd.read_parquet(f"{DATA}/documents.parquet"))


def test_p2_pieces(spark):
    p = Q.p2_pieces(spark, DATA).toPandas()
    units = p["piece_text"].map(lambda s: len(s.encode("utf-16-le")) // 2)
    assert (units <= splitting.LIMIT).all()
    for _, g in p.groupby(["library_id", "item_key"]):
        assert sorted(g["new_chunk_id"]) == list(range(len(g)))
    s = Q.p2_sessions(spark, DATA).toPandas()
    n = p.groupby(["library_id", "item_key"]).size()
    assert all(r.total_chunks == n.get((r.library_id, r.item_key), 0) for r in s.itertuples())
