"""Files in, tables and pages out."""

import json

from pyspark.sql import functions as F

from stacklight.sources import documents as D
from stacklight.sources import sinks as S


def test_files(spark, tmp_path):
    for name, body in (("A/x.html", "<p>page</p>"), ("A/y.txt", "plain"), ("A/z.cache.txt", " "), ("B/p.htm", "<b>only</b>"), ("B/q.pdf", "%PDF")):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(body)
    got = {r["paper"]: (r["kind"], r["text"]) for r in D.preferred(D.read_files(spark, str(tmp_path))).collect()}
    assert got == {"A": ("text", "plain"), "B": ("html", "only")}


def test_postings_are_read_by_range(spark, tmp_path):
    p = spark.range(5000).select(F.concat(F.lit("t"), F.lpad((F.col("id") % 500).cast("string"), 4, "0")).alias("term"), F.col("id").alias("doc_id"))
    S.write_postings(p, str(tmp_path / "p"), 8)
    back = spark.read.parquet(str(tmp_path / "p")).filter("term = 't0042'")
    assert back.count() == 10 and "EqualTo(term,t0042)" in back._jdf.queryExecution().executedPlan().toString()


def test_markdown_and_envelope(spark, tmp_path):
    S.write_markdown(spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string"), "n", str(tmp_path / "m"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "m")).collect()) == ["a", "b"]
    rows = spark.range(7).select((F.col("id") + 1).cast("int").alias("rank"), F.col("id").alias("key"))
    body = json.loads(S.envelope(rows, 2, 3).collect()[0]["body"])
    assert [x["key"] for x in body["results"]] == [2, 3, 4] and body["pagination"] == {"total": 7, "returned": 3, "offset": 2, "limit": 3, "hasMore": True, "nextOffset": 5}
    assert json.loads(S.envelope(rows.limit(0), 0, 3).collect()[0]["body"])["pagination"]["total"] == 0
