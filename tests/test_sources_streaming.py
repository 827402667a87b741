from __future__ import annotations

import gzip
import json

from pyspark.sql import functions as F

from tanzaku.sources import dumps as D
from tanzaku.streaming import ratings as S


def test_dump_and_candidates(spark, tmp_path):
    base = {"type": 2, "name": "x", "favorite": {"done": 60}, "meta_tags": ["OVA", "TV"], "date": "2016-07-03", "infobox": ""}
    rows = [base | {"id": 1}, base | {"id": 2, "type": 1}, base | {"id": 3, "date": "", "infobox": "{{\n|放送开始= 1999年4月\n}}"}, base | {"id": 4, "favorite": {"done": 49}}, base | {"id": 5, "meta_tags": ["短片"]}, base | {"id": 6, "date": "", "infobox": None}]
    f = tmp_path / "subject.jsonlines"
    f.write_text("\n".join(map(json.dumps, rows)) + "\n{broken")
    df = D.read_dump(spark, str(f), "subject")
    assert df.count() == 6
    assert {(r.id, r.air_year, r.form) for r in D.candidates(df).collect()} == {(1, 2016, "TV"), (3, 1999, "TV")}
    days = spark.createDataFrame([("2016-07-03",), ("2016",), ("2016-13-41",), (None,)], "d string").select(D.full_date(F.col("d")).alias("d")).collect()
    assert [str(r.d) for r in days] == ["2016-07-03", "None", "None", "None"]


def test_pages_manifest_nested(spark, tmp_path):
    (tmp_path / "html").mkdir()
    for i in (1, 3):
        with gzip.open(tmp_path / f"html/{i}.html.gz", "wt") as g:
            g.write(f"<p>{i}</p>")
    m = tmp_path / "m.jsonl"
    m.write_text("\n".join(json.dumps({"pageid": p, "rev": r}) for p, r in ((1, 1), (2, 1), (1, 2))))
    manifest = D.read_manifest(spark, str(m), "pageid", "pageid long, rev int")
    assert {(r.pageid, r.rev) for r in manifest.collect()} == {(1, 2), (2, 1)}
    pages, missing = D.read_pages(spark, str(tmp_path / "html"), manifest)
    assert [(r.pageid, r.html) for r in pages.collect()] == [(1, "<p>1</p>")] and [r.pageid for r in missing.collect()] == [2]
    n = tmp_path / "n.json"
    n.write_text(json.dumps({"items": [{"title": "a", "sites": [{"site": "s", "id": "1"}, {"site": "t"}]}, {"title": "b", "sites": []}]}))
    assert [(r.item, r.site, r.id) for r in D.read_nested(spark, str(n)).collect()] == [(0, "s", "1")]


def test_sheet_round_trip():
    rows = [{"n": 1, "kind": "plot", "question": "谁?", "state": "OK", "retrieval": "y", "answer": "r"}, {"n": 2, "kind": "song", "question": "什么", "state": "UNKNOWN", "retrieval": "", "answer": ""}]
    got = D.parse_sheet(D.render_sheet(rows))
    assert got == [rows[0], rows[1] | {"retrieval": None, "answer": None}]


def test_sidecar(spark, tmp_path):
    D.write_sidecar(spark.createDataFrame([("k", 3)], "key string, n int"), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).collect()[0].n == 3


def test_windowed_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "seen"), ("2024-01-01 11:00:00", "seen"), ("2024-01-02 10:00:00", "wish")]
    spark.createDataFrame(rows, "ts string, choice string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts string, choice string").parquet(str(tmp_path / "in"))
    q = S.windowed_answers(s).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(60)
    assert {(str(r.start)[:10], r.choice, r.n) for r in spark.table("win").collect()} == {("2024-01-01", "seen", 2), ("2024-01-02", "wish", 1)}


def test_merge_stream_is_idempotent(spark, tmp_path):
    src, dst = str(tmp_path / "docs"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("k long, t string").parquet(src)
    S.merge_stream(stream(), dst, "k", "t", str(tmp_path / "c")).awaitTermination(60)
    spark.createDataFrame([(1, "a"), (2, "c"), (3, None)], "k long, t string").coalesce(1).write.mode("append").parquet(src)
    S.merge_stream(stream(), dst, "k", "t", str(tmp_path / "c")).awaitTermination(60)
    S.merge_stream(stream(), dst, "k", "t", str(tmp_path / "other")).awaitTermination(60)  # all of it again
    got = spark.read.parquet(dst).groupBy("k").agg(F.max_by("t", "batch_id").alias("t"), F.count("*").alias("n"))
    assert {(r.k, r.t) for r in got.collect()} >= {(1, "a"), (3, None)}
