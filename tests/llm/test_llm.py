"""The training-data operators against brute force, round trips and odd input."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import canonical, cooccurrence, mixing, nearest, scanned, spans, splitting, tokenize

LONG = "".join(random.Random(1).choice("abcdefghij klmnop\n") for _ in range(30_000))


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- canonical names ---

TERMS = "term_id long, concept_id long, term_role string, name_zh string, name_en string, abbreviation string, confidence double"
FIRST = [("cyclic", "循环"), ("thermal", "热致"), ("delayed", "延迟"), ("two-stage", "两段式")]
SECOND = [("grain growth", "晶粒长大"), ("creep", "蠕变"), ("void swelling", "空洞肿胀"), ("delamination", "分层")]


@pytest.fixture(scope="module")
def terms(spark):
    out, n = [], 0
    for a, (fe, fz) in enumerate(FIRST):
        for b, (se, sz) in enumerate(SECOND):
            if (a + b) % 4 != 3:
                n += 1
                out.append((n, n, "primary", fz + sz, f"{fe} {se}", "".join(w[0] for w in re.split("[ -]", f"{fe} {se}")).upper(), 0.9))
    return spark.createDataFrame(out, TERMS)


def mapped(spark, terms, entries):
    src = spark.createDataFrame([(i, *e, "x") for i, e in enumerate(entries)], "input_id long, canonical_name string, alias_text string, abbr string, concept_id string")
    return dict((r["input_id"], r["concept_id"]) for r in canonical.map_names(src, terms).collect())


def test_canonical(spark, terms):
    ids = {r["name_en"]: r["concept_id"] for r in terms.collect()}
    entries = [
        ("Cyclic Grain Growth", None, None), ("cyclic grian growth", None, None), ("growth of nothing", None, None), ("grain growth, cyclic", None, None),
        ("cycl. grain gro.", None, None), ("сусlіс creep", None, None), ("cyclic 蠕变", None, None), ("关于循环蠕变", None, None), ("n/a", None, "C.C."), (None, None, None),
        ("cyclic delamination", None, None), ("cyclicvoidswelling", "", "-"), ("the two stage creep process", None, None), ("TBD", "cyclic void swellings", "?"), ("", " ", None), ("cyclic delaminatoin", None, None),
    ]
    # The words around names are learnt: each stands around three concepts here.
    more = [f"{a}{n}{z}" for a, z in (("the ", ""), ("", " process")) for n in ("thermal creep", "two-stage creep", "cyclic grain growth")] + [f"关于{n}" for n in ("热致蠕变", "两段式蠕变", "循环晶粒长大")]
    got = mapped(spark, terms, entries + [(n, None, None) for n in more])
    want = ["cyclic grain growth", "cyclic grain growth", None, "cyclic grain growth", "cyclic grain growth", "cyclic creep", "cyclic creep", "cyclic creep", "cyclic creep", None, None, "cyclic void swelling", "two-stage creep", "cyclic void swelling", None, None]
    assert [got[i] for i in range(len(want))] == [ids.get(w, -1) if w else -1 for w in want]


def test_canonical_odd_tables(spark, terms):
    assert mapped(spark, terms.limit(0), [("cyclic creep", None, None)]) == {0: -1}
    assert mapped(spark, terms, []) == {}
    twice = spark.createDataFrame([(1, "cyclic creep", None, None)] * 2 + [(None, "creep", None, None), (2, LONG, LONG, LONG)], "input_id long, canonical_name string, alias_text string, abbr string")
    got = dict(rows(canonical.map_names(twice, terms).select("input_id", "concept_id")))
    assert set(got) == {1, 2} and got[1] > 0 and got[2] == -1


def test_similarity_join_is_exact(spark):
    rng = random.Random(3)
    words = lambda n: sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(2, 9))) for _ in range(n)})
    a, b = words(60), words(60)
    got = {(v, n) for v, n, _ in rows(canonical.similar(spark.createDataFrame([(x,) for x in a], "v string"), spark.createDataFrame([(x,) for x in b], "name string"), 0.5, 2))}
    grams = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
    want = {(x, y) for x in a for y in b if len(grams(x) & grams(y)) >= 0.5 * len(grams(x) | grams(y))}
    assert got == want and want


def test_edit_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert canonical.distance(a, b) == slow(a, b)


# --- splitting ---


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, LONG, "句子。" * 1200, "😀" * 2000, "para one.\n\n" * 400, "a" * 1501])
def test_split_limits(text):
    text = text.strip(splitting.BLANKS)
    parts = splitting.split_text(text)
    units = lambda s: len(s.encode("utf-16-le")) // 2
    assert all(0 < units(text[a:b]) <= splitting.LIMIT for a, b in parts)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(b1 >= a2 and units(text[a2:b1]) <= splitting.OVERLAP + 2 and a2 > a1 for (a1, b1), (a2, _) in zip(parts, parts[1:]))
    least = 1 + -(-(units(text) - splitting.LIMIT) // (splitting.LIMIT - splitting.OVERLAP))
    assert len(parts) <= least + 2


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, LONG, "句子。" * 1200, "😀" * 2000, "a😀" * 1500, "para one.\n\n" * 400, "e\u0301" * 1600])
@pytest.mark.parametrize("overlap", [0, 1, 100, 333])
def test_split_overlap_and_cover(text, overlap):
    """Neighbours overlap by what is asked, or by so little more that no character is parted; without it the pieces are the text."""
    text = text.strip(splitting.BLANKS)
    units = lambda s: len(s.encode("utf-16-le")) // 2
    parts = splitting.split_text(text, overlap=overlap)
    assert len(parts) > 1 and all(units(text[a:b]) <= splitting.LIMIT for a, b in parts)
    assert all(overlap <= units(text[a2:b1]) <= overlap + 1 for (_, b1), (a2, _) in zip(parts, parts[1:]))
    assert text[parts[0][0] : parts[0][1]] + "".join(text[b1:b2] for (_, b1), (_, b2) in zip(parts, parts[1:])) == text


def test_split_cuts_at_the_strongest_boundary():
    text = "one two three. " * 60 + "\n\n" + "four five six. " * 60
    (_, b), (a, _) = splitting.split_text(text.strip())
    assert text[:b].endswith("\n\n") and a < b


CHUNKS = "row_id long, library_id long, item_key string, chunk_id int, text string, chunk_lang string, enable_ocr boolean, created_at timestamp, id string, piece string"


def test_numbered_pieces(spark):
    import datetime

    t = datetime.datetime(2024, 1, 1)
    data = [
        (1, 1, "A", 0, "short", None, None, t, "x", "x"), (2, 1, "A", 2, "word " * 700, None, None, t, "x", "x"), (3, 1, "A", 2, "newer", None, None, t + datetime.timedelta(1), "x", "x"),
        (4, 1, "A", 5000, "word " * 700, None, None, None, "x", "x"), (5, None, "A", 1, "lost", None, None, t, "x", "x"), (6, 1, "B", 0, None, None, None, t, "x", "x"), (7, 1, "B", 1, " \n ", None, None, t, "x", "x"),
        (8, 1, None, 1, LONG, None, None, t, "x", "x"),
    ]
    c = spark.createDataFrame(data, CHUNKS)
    got = splitting.numbered_pieces(c).orderBy("item_key", "new_chunk_id").collect()
    assert [r["new_chunk_id"] for r in got] == list(range(len(got))) and {r["row_id"] for r in got} == {1, 3, 4}
    assert {r["row_id"] for r in splitting.oversized(c).collect()} == {2, 4, 8}
    s = spark.createDataFrame([(1, 1, "A", 9), (1, 1, "A", 9), (2, 1, "B", None), (3, None, None, 1)], "session_id long, library_id long, item_key string, total_chunks int")
    assert {r["session_id"]: r["total_chunks"] for r in splitting.corrected_sessions(s, c).collect()} == {1: len(got), 2: 0, 3: 0}
    assert splitting.numbered_pieces(c.limit(0)).count() == 0


# --- co-occurrence ---


@pytest.mark.parametrize("wide", [2, 512])
def test_cooccurrence(spark, wide):
    rng = random.Random(7)
    data = [(rng.choice([1, 2]), rng.randint(0, 15), rng.randint(0, 9)) for _ in range(300)] * 2 + [(1, None, 3), (None, 1, 3), (1, 2, None)]
    df = spark.createDataFrame([(*r, 0) for r in data], "library_id long, basket long, item long, g int")
    per = defaultdict(set)
    for g, b, i in data:
        if None not in (g, b, i):
            per[g, b].add(i)
    want = Counter((g, x, y) for (g, _), items in per.items() for x, y in combinations(sorted(items), 2))
    col = cooccurrence.baskets(df, "library_id", "basket", "item")
    assert {(g, a, b): n for g, a, b, n in rows(cooccurrence.pair_counts(col, wide))} == dict(want)
    out = cooccurrence.cooccurrence(df, "library_id", "basket", "item").collect()
    n = Counter(g for g, _ in per)
    one = Counter((g, i) for (g, _), items in per.items() for i in items)
    assert all(r["n"] == n[r["g"]] and r["n_a"] == one[r["g"], r["a"]] and abs(r["lift"] - r["n_ab"] * r["n"] / (r["n_a"] * r["n_b"])) < 1e-9 for r in out) and len(out) == len(want)
    assert cooccurrence.cooccurrence(df.limit(0), "library_id", "basket", "item").count() == 0


def test_item_keys(spark):
    df = spark.createDataFrame([("1:AB", 1), ("AB", 1), ("", 1), ("1:", 1), (None, 1), ("2:AB", 1), ("AB", None)], "k string, lib long")
    assert [r[0] for r in rows(df.select(cooccurrence.bare_item_key(F.col("k"), F.col("lib"))))][:6] == ["AB", "AB", None, None, None, "2:AB"]


# --- scanned pages ---


@pytest.mark.parametrize(("a", "b"), [("gamet", "garnet"), ("nano5cale", "nanoscale"), ("sliirry", "slurry"), ("levellecl", "levelled"), ("furriace", "furnace"), ("govcrns", "governs"), ("netvvork", "network")])
def test_skeletons_agree(a, b):
    assert scanned.skeleton(a) == scanned.skeleton(b)


PROSE = "The viscous garnet layer of the furnace delays the cross-linked strength of the coating in the scaffold."
SCAN = "ANNEALED CATHODE STRENGTH AND\nThe viscous gamet layer of the furnace delays the cross-\nlinked strength of the coat-\n\n12\n\ning in the scaffold.\nJournal of Layers   13"


def test_scanned(spark):
    c = [(i, 1, f"K{i}", 0, PROSE, "en", False) for i in range(40)]
    c += [(100, 1, "S", 1, SCAN, "en", True), (101, 1, "N", 2, "Runs of it\n12\n24\n36", "en", None), (102, None, None, None, None, None, None), (103, 1, "S", 3, "", None, True), (104, 1, "L", 4, LONG, None, False)]
    chunks = spark.createDataFrame(c, "row_id long, library_id long, item_key string, chunk_id int, text string, chunk_lang string, enable_ocr boolean").withColumn("line", F.lit("clash"))
    items = spark.createDataFrame([(1, "S", "Annealed cathode strength and cavity", "Journal of Layers"), (1, None, None, None), (2, "S", None, None)], "library_id long, item_key string, title string, publication_title string")
    kinds = scanned.noise(chunks, items)
    got = defaultdict(set)
    for r in scanned.found_noise(kinds).collect():
        got[r["row_id"]].add(r["noise_kind"])
    assert got[100] == {"hyphen", "glyph", "header", "folio"} and not got[101] and set(got) <= {100, 101, 104}
    text = {r["row_id"]: r["clean_text"] for r in scanned.repaired(chunks, kinds).collect()}
    assert len(text) == len(c) and text[100] == PROSE and text[0] == PROSE and text[102] is None and text[103] == ""
    empty = scanned.noise(chunks.limit(0), items)
    assert scanned.found_noise(empty).count() == 0 and scanned.repaired(chunks.limit(0), empty).count() == 0


# --- nearest vectors ---


def test_nearest(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 64))
    x = np.repeat(centres, 20, 0) + 0.5 * rng.normal(size=(600, 64))
    data = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)]
    data += [(1000 + i, [2.0 * float(v) for v in x[0]], "copy") for i in range(14)]
    data += [(2000, None, ""), (2001, [], ""), (2002, [0.0] * 64, ""), (2003, [1.0] * 32, ""), (2004, [float("nan")] + [1.0] * 63, ""), (None, [1.0] * 64, ""), (1, [float(v) for v in x[1]], "again")]
    df = spark.createDataFrame(data, "id long, vector array<float>, rep string")
    got = nearest.top_k(df, k=10, probes=12, keep=32).collect()
    ids = np.array([*range(600), *range(1000, 1014)])
    m = np.concatenate([x, np.repeat(x[:1] * 2, 14, 0)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -9)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r["id"]].append(r["neighbour"])
        assert abs(r["cosine"] - s[np.flatnonzero(ids == r["id"])[0], np.flatnonzero(ids == r["neighbour"])[0]]) < 1e-5
    assert set(by) == set(ids.tolist()) and all(len(v) == 10 for v in by.values())
    assert by[0] == [1000 + i for i in range(10)] and by[1000] == [0, *(1000 + i for i in range(1, 10))]
    rest = range(1, 600)
    best = {int(ids[i]): set(ids[np.lexsort((ids, -s[i]))[:10]].tolist()) for i in rest}
    assert np.mean([len(best[i] & set(by[i])) / 10 for i in rest]) >= 0.9
    assert nearest.top_k(df.limit(0)).count() == 0


def test_hot_list_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(300, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    got = nearest.top_k(df, k=3, list_max=20, keep=64).collect()
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-s[i])[:3]}
    assert len({(r["id"], r["neighbour"]) for r in got} & want) >= 0.9 * len(want)


def test_hot_cluster_of_distinct_vectors(spark):
    """A third of the rows lie in one cluster of mean cosine 0.98, much denser than the rest."""
    rng = np.random.default_rng(5)
    wide, centre = rng.normal(size=(4000, 64)), rng.normal(size=64)
    hot = centre / np.linalg.norm(centre) + np.sqrt((1 / 0.98 - 1) / 64) * rng.normal(size=(2000, 64))
    x = np.concatenate([hot, wide]).astype("f4")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>")
    m = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = m[:2000] @ m.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(2000) for j in np.argsort(-s[i])[:10]}
    got = {(r["id"], r["neighbour"]) for r in nearest.top_k(df, k=10).filter("id < 2000").collect()}
    assert len(got & want) >= 0.9 * len(want)


# --- tokens ---

TEXTS = ["", None, "  ", "Hello, world's  end\n\n", "深冷声阻尼 β-stabilized", "<|endoftext|> \x00\x1f", "😀👩‍👩‍👧 é́", LONG, "a" * 9000 + " b", " " * 7000, "it's " * 4000 + "\n" * 50 + "x1y2"]


@pytest.mark.parametrize("chunk", [1000, 200_000])
def test_tokens(spark, chunk):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = dict(rows(tokenize.encode_table(df, chunk=chunk, overlap=256, edge=64)))
    enc = tokenize.encoder()
    assert {k: list(v) for k, v in got.items()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = dict(rows(tokenize.decode_table(tokenize.encode_table(df, chunk=chunk, overlap=256, edge=64))))
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenize.encode_table(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", TEXTS)
def test_counting_in_runs(text):
    enc = tokenize.encoder()
    assert all(tokenize.count_tokens(enc, text or "", n) == len(enc.encode_ordinary(text or "")) for n in (1, 7, 100, 10_000))


def test_tokens_equal_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert t.encode(x, add_special_tokens=False).ids == tokenize.encoder().encode_ordinary(x)


# --- mixing ---


def test_pivot_keeps_mass_and_means():
    rng = np.random.default_rng(1)
    p, size = rng.random(40), rng.integers(1, 50, 40).astype(float)
    sums = np.zeros(40)
    for _ in range(2000):
        q = mixing.pivot(p, size, rng.random(40))
        assert ((q > 0) & (q < 1)).sum() <= 1 and abs((q * size).sum() - (p * size).sum()) < 1e-6
        sums += q
    assert np.abs(sums / 2000 - p).max() < 0.06


def test_mixture(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    docs = [(i, " ".join(word() for _ in range(rng.randint(5, 60))), rng.choice([" Big", "big", "BIG ", "small"] if i % 5 else ["small"]), 0) for i in range(900)]
    docs += [(1000, None, "big", 0), (1001, "", "small", 0), (1002, "unused", "other", 0), (1003, "no label", None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, copies int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 3), ("never", 0.0, None)], "source string, target_weight double, max_repeats int")
    mixed, report = mixing.mixture(d, t, bucket=64)
    m = mixed.collect()
    r = {x["source"]: x for x in report.collect()}
    assert {x["doc_id"] for x in m} <= set(range(900)) and all(1 <= x["copies"] <= (1 if x["source"] == "big" else 2) for x in m)
    assert abs(r["big"]["reached_share"] - 0.5 / 0.9) < 0.01 and abs(r["small"]["reached_share"] - 0.4 / 0.9) < 0.01 and r["absent"]["mixed_tokens"] == 0
    assert abs(r["small"]["mixed_tokens"] - r["small"]["planned_tokens"]) <= 150
    again, _ = mixing.mixture(d, t, bucket=64)
    assert sorted(rows(again)) == sorted(rows(mixed))
    none, rep = mixing.mixture(d.limit(0), t)
    assert none.count() == 0 and all(x["mixed_tokens"] == 0 for x in rep.collect())
    over, rep = mixing.mixture(d, t, budget=10**9)
    assert all(x["capped"] for x in rep.collect() if x["source"] != "absent" or x["tokens"] == 0) and over.filter("source = 'big'").count() == r["big"]["documents"]


# --- shared spans ---


def brute(docs, least=100):
    where = defaultdict(set)
    for i, t in docs.items():
        for p in range(len(t) - least + 1):
            where[t[p : p + least]].add(i)
    pairs = {p for s in where.values() for p in combinations(sorted(s), 2)}
    shared = {}
    for i, t in docs.items():
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - least + 1):
            if len(where[t[p : p + least]]) > 1:
                hit[p : p + least] = True
        shared[i] = int(hit.sum())
    return pairs, shared


@pytest.mark.parametrize(("hot", "per_shard", "chars", "segment"), [(500, 20_000, 10**7, 1 << 20), (2, 5, 3000, 700)])
def test_spans(spark, hot, per_shard, chars, segment):
    rng = random.Random(11)
    text = lambda n, abc="abcdefgh \n深": "".join(rng.choice(abc) for _ in range(n))
    common, exact, short = text(300), text(100), text(99)
    docs = {i: text(rng.randint(50, 900)) for i in range(40)}
    for i in (1, 5, 9):
        docs[i] = text(120) + common + text(30)
    docs[2] += common[50:200]
    docs[3], docs[4] = text(70) + exact + text(5), exact + text(200)
    docs[6], docs[7] = text(10) + short + text(90), text(44) + short + text(9)
    docs[8] = common[:100] + "X" + common[:100]
    docs[10] = docs[11] = text(400)
    docs[12] = "." * 500
    docs[13] = text(20) + "." * 130 + text(300)
    data = [(i, t, "x", "y") for i, t in docs.items()] + [(100, None, "x", "y"), (101, "", "x", "y")]
    df = spark.createDataFrame(data, "doc_id long, text string, id string, pos string")
    own, pairs, merged = spans.shared_spans(df, hot=hot, per_shard=per_shard, group_chars=chars, segment=segment)
    want, shared = brute(docs)
    got = rows(spans.found_pairs(own, pairs))
    assert set(got) == want and len(got) == len(want) and (10, 11) in want
    rep = {r["doc_id"]: r for r in spans.shared_report(df, own, merged).collect()}
    assert {i: rep[i]["shared_chars"] for i in docs} == shared and rep[100]["shared_chars"] == 0 and rep[11]["class_id"] == 10
    own, pairs, _ = spans.shared_spans(df.limit(0))
    assert spans.found_pairs(own, pairs).count() == 0


def test_han_pairs_are_learnt(spark):
    """A pair that no list has, told by the places of the one where the other is far more frequent."""
    texts = [f"{a}钢板{b}" * 3 for a in "在把用" for b in "上下中" for _ in range(4)] + ["在钡板上的", "把钡\n板下的", "用 钡板中"] + ["氯化钡水"]
    chunks = spark.createDataFrame([(i, 1, "K", t) for i, t in enumerate(texts)], "row_id long, library_id long, item_key string, text string")
    found = scanned.facts(chunks)
    pairs = scanned.han_pairs(found)
    assert ("钡", "钢") in pairs and set(pairs) - {p for x, y in scanned.HAN for p in ((x, y), (y, x))} == {("钡", "钢")}
    _, han = scanned.misread(chunks, scanned.word_groups(found), pairs)
    assert {(r["row_id"], r["line"], r["meant"]) for r in han.collect()} == {(36, 0, "钢"), (37, 0, "钢"), (38, 0, "钢")}


def test_bit_set_lets_all_its_words_through(spark):
    words = [f"wörd{i}" for i in range(5000)] + ["晶粒", "", "a"]
    sieve = scanned.Sieve(scanned.bit_set(spark.createDataFrame([(w,) for w in words], "word string")))
    assert sieve(set(words)) == set(words) and len(sieve({f"other{i}" for i in range(10_000)})) < 300
    assert scanned.Sieve(scanned.bit_set(spark.createDataFrame([], "word string")))({"a"}) == set()


def test_context_chooses_between_frequent_forms(spark):
    texts = ["the solar cell works"] * 20 + ["use the ceil function"] * 20 + ["a solar ce1l here", "that ce1l function"]
    chunks = spark.createDataFrame([(i, 1, "K", t) for i, t in enumerate(texts)], "row_id long, library_id long, item_key string, text string")
    groups = scanned.word_groups(scanned.facts(chunks))
    assert {r["row_id"]: r["meant"] for r in scanned.misread_words(chunks, groups).collect()} == {40: "cell", 41: "ceil"}
