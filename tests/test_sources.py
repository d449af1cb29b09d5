"""Files, exports and streams."""

import datetime as dt
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.dedup import identity
from tidemark.plans.serve import export_frame
from tidemark.sources import files
from tidemark.streaming import incremental as I


def test_roster_encodings(spark, tmp_path):
    text = "name_en,name_ko,role_en,role_ko,fed,voter,vote_year,priority,aliases,x_handle\nAnn,안,G,이사,Board,1,2026,1,a|b,nan\n"
    for name, enc in (("u.csv", "utf-8"), ("k.csv", "euc-kr")):
        (tmp_path / name).write_bytes(text.encode(enc))
        r = files.read_roster(spark, str(tmp_path / name)).first()
        assert (r.name_en, r.name_ko, r.voter, r.aliases, r.x_handle) == ("Ann", "안", 1, "a|b", None)


def test_envelope(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"cache_type": "x", "count": 1, "articles": [{"title": "a", "url": "u"}, {"title": None}]}))
    assert [(r.seq, r.title) for r in files.read_envelope(spark, str(p)).collect()] == [(0, "a"), (1, None)]
    assert files.read_envelope(spark, str(tmp_path / "none.json"), tolerant=True).count() == 0
    p.write_text("{broken")
    assert files.read_envelope(spark, str(p), tolerant=True).count() == 0
    files.write_envelope(spark.createDataFrame([("a",)], "title string"), str(tmp_path / "out"), "x", 2026)
    assert spark.read.json(str(tmp_path / "out/about")).first()["count"] == 1


def test_latest_and_export(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.bin").write_text(str(k))
    assert files.latest_file(spark, str(tmp_path)).endswith(".bin")
    df = spark.createDataFrame([("2024-01-01", "m", ["a", None, "b"], 3), (None, "n", None, None)], "published_at string, member_name_en string, topics array<string>, news_score int")
    out = export_frame(df)
    assert len(out.columns) == 40 and out.first().Topics == "a | b" and [r.Date for r in out.collect()] == ["2024-01-01", None]
    files.write_export(out, str(tmp_path / "x"))
    back = files.read_export(spark, str(tmp_path / "x"), {"published_at": "Date", "news_score": "News_Score"}, {"extra": 1})
    assert {r.news_score for r in back.collect()} == {3.0, None} and "extra" in back.columns


def test_posts(spark, tmp_path):
    df = spark.createDataFrame([("m", "h", dt.datetime(2024, 1, 1), "x", "u", True, None), ("n", "h", None, None, None, None, "NO_POST")], "member string, x_handle string, posted_at timestamp, text string, url string, verified boolean, error string")
    files.write_posts(df, str(tmp_path / "p"))
    assert {(r.member, r.error) for r in files.read_posts(spark, str(tmp_path / "p")).collect()} == {("m", None), ("n", "NO_POST")}


def test_window_keeps_unknown(spark):
    rows = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "a", dt.date(2024, 1, 9)), (3, "a", None), (4, "b", dt.date(2020, 1, 1))], "seq long, member string, d date")
    cut = spark.createDataFrame([("a", dt.date(2024, 1, 5))], "member string, cutoff date")
    assert {r.seq for r in I.inside_window(rows, cut).collect()} == {2, 3, 4}


def test_stream_upsert_and_windows(spark, tmp_path):
    schema = "seq long, url string, published_at string, title string, ts timestamp"
    src = str(tmp_path / "in")
    for k in range(2):
        rows = [(0, "u1", f"2024-01-0{k + 1}", f"t{k}", dt.datetime(2024, 1, 1 + k, 1)), (1, f"v{k}", "2024-01-01", "x", dt.datetime(2024, 1, 1 + k, 2))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    key = identity(F.col("url"), F.lit(""), F.col("published_at"), F.col("title"))
    target = str(tmp_path / "out")
    stream = I.stream_of(spark, src, schema, 1)
    q = stream.writeStream.foreachBatch(I.upsert_sink(target, key)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    sink = I.upsert_sink(target, key)
    assert {r.title for r in sink.table(spark, schema).filter("url = 'u1'").collect()} <= {"t0", "t1"}
    assert sink.table(spark, schema).count() == 3
    counts = I.tumbling(I.stream_of(spark, src, schema).withColumn("score", F.lit(1)), "url")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.sql("select sum(n) from tumbled").first()[0] == 4


def test_upsert_sink_keeps_its_state(spark, tmp_path):
    schema = "seq long, url string, published_at string, title string"
    sink = I.upsert_sink(str(tmp_path / "sink"), F.col("url"), parts=8)
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    sink(batch((1, "a", "2024-01-01", "a1"), (2, "b", "2024-01-02", "b1")), 0)
    sink(batch((3, "a", "2024-01-03", "a2")), 1)
    sink(batch((9, "a", "2024-01-09", "never")), 1)  # a retry of a complete batch
    sink(batch((4, "c", "2024-01-04", "c1")), 2)
    got = lambda: {r.url: r.title for r in sink.table(spark, schema).collect()}
    assert got() == {"a": "a2", "b": "b1", "c": "c1"}
    assert sink._versions(spark) == [2, 3]  # older ones are gone
    with pytest.raises(RuntimeError):
        sink(batch((5, "d", "2024-01-05", "d1")), 7)
    assert got() == {"a": "a2", "b": "b1", "c": "c1"}
    assert I.upsert_sink(str(tmp_path / "new"), F.col("url")).table(spark, schema).count() == 0


def test_events_of_a_payload(spark, tmp_path):
    kind = "event_id: string, event_sources: array<string>, hawk_dove_score: double"
    p = tmp_path / "events.json"
    p.write_text(json.dumps({"count": 2, "events": [{"event_id": "EVT0001", "event_sources": ["OFFICIAL"], "hawk_dove_score": 2}, {"event_id": "EVT0002", "more": {}}]}))
    assert [(r.seq, r.event_id, r.event_sources, r.hawk_dove_score) for r in files.read_events(spark, str(p), kind).collect()] == [(0, "EVT0001", ["OFFICIAL"], 2.0), (1, "EVT0002", None, None)]
    for text in ("{broken", "{}", '{"events": null}'):
        p.write_text(text)
        assert files.read_events(spark, str(p), kind).count() == 0
    assert files.read_events(spark, str(tmp_path / "none.json"), "event_id string").count() == 0


def test_exactly_once(spark, tmp_path):
    schema = "id long, ts timestamp"
    for k in range(2):
        spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (2, datetime(2024, 1, 2))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = I.exactly_once(I.stream_of(spark, str(tmp_path / "in"), schema), "id").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.id for r in spark.sql("select id from once").collect()) == [1, 2]


def test_link_contexts_and_wire_limits(spark):
    from tidemark.sources import chains as K

    html = "<div><p>" + "x " * 1500 + "</p><article><h2>Desk</h2><a href='/s'>Talk</a> by <b>Doe</b></article></div><a>no link</a><script>var a = \"<a href='/n'>n</a>\"</script>"
    rows = K.link_contexts(spark.createDataFrame([(1, "https://x.org", html), (2, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.href, r.text, r.context) for r in rows] == [("/s", "Talk", "Desk Talk by Doe")]
    c = spark.createDataFrame([(k, "연합인포맥스", f"https://w.org/{k % 3}", "파월 - 연합인포맥스", "파월 의장은 기준금리를 유지한다고 밝혔다 말했다", "2024-01-05") for k in range(9)], "seq long, source string, url string, title string, text string, published_at string")
    assert [r.seq for r in K.wire_search(c, ["파월"], 2024, most=2).collect()] == [0, 1]


def test_roster_in_slices(spark, monkeypatch):
    from tidemark.operators import entity

    people = entity.roster(spark.createDataFrame([(k, f"Name{k:03d} Last{k:03d}", "", "", "", "", 0) for k in range(23)], "member_id int, name_en string, name_ko string, role_en string, role_ko string, aliases string, voter int"))
    a = spark.createDataFrame([(k, "", f"Name{k:03d} Last{k:03d} and Last{(k + 9) % 23:03d}", "", "") for k in range(23)], "seq long, speaker_raw string, title string, text string, url string")
    whole = {r.seq: (r.member_id, r.match_score) for r in entity.attribute(a, people).collect()}
    monkeypatch.setattr(entity, "ROSTER_SLICE", 5)
    assert {r.seq: (r.member_id, r.match_score) for r in entity.attribute(a, people).collect()} == whole and whole[22] == (22, 13)
