"""Catalogue differences, upserts, queues; files and meetings as sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import state
from corvane.sources import files as S
from corvane.sources import meetings as R

def now():
    return F.lit("2026-06-30 12:00:00").cast("timestamp")


def queue(spark):
    at = dt.datetime(2026, 6, 30, 11, 0)
    return spark.createDataFrame(
        [("a", "pending", at), ("b", "leased", at), ("c", "leased", dt.datetime(2026, 6, 30, 11, 45)), ("d", "done", at), ("e", "pending", dt.datetime(2026, 6, 30, 9, 0))],
        "sha string, status string, updated_at timestamp",
    )


def test_queue(spark):
    released = {r.sha: r.status for r in state.release_leases(queue(spark), now()).collect()}
    assert released == {"a": "pending", "b": "pending", "c": "leased", "d": "done", "e": "pending"}
    leased = {r.sha: r.status for r in state.lease(queue(spark), "sha", [F.asc("updated_at")], 1, now()).collect()}
    assert leased["e"] == "leased" and leased["a"] == "pending"
    new, skipped = state.complete(queue(spark), "sha", spark.createDataFrame([("a",), ("a",), ("d",), ("x",), (None,)], "sha string"), now())
    assert {r.sha: r.status for r in new.collect()}["a"] == "done"
    assert {r.sha: r.reason for r in skipped.collect()} == {"d": "already done", "x": "unknown"}


def test_difference_and_upsert(spark):
    old = spark.createDataFrame([("s", "a", "1"), ("s", "b", "1"), ("s", "c", None)], "source string, path string, sha string")
    new = spark.createDataFrame([("s", "a", "1"), ("s", "b", "2"), ("s", "d", "1")], "source string, path string, sha string")
    got = {r.path: r.change for r in state.difference(old, new, ["source", "path"], "sha").collect()}
    assert got == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added"}
    assert {r.path: r.sha for r in state.upsert(old, new, ["source", "path"]).collect()} == {"a": "1", "b": "2", "c": None, "d": "1"}
    assert state.insert_missing(old, new, ["source", "path"]).count() == 4
    again = state.upsert(new, new, ["source", "path"])
    assert {r.change for r in state.difference(new, again, ["source", "path"], "sha").collect()} == {"unchanged"}


def test_files(spark, tmp_path):
    (tmp_path / "notes/deep").mkdir(parents=True)
    (tmp_path / "notes/.git").mkdir()
    (tmp_path / "notes/a.md").write_text("# Alpha\n\n- [[X]] stage:: one\n")
    (tmp_path / "notes/deep/b.md").write_bytes(b"bad \xff byte\n")
    (tmp_path / "notes/.git/c.md").write_text("no")
    (tmp_path / "notes/d.txt").write_text("no")
    source = S.Source("notes", str(tmp_path / "notes"))
    found = S.scan(spark, source)
    assert sorted(r.rel_path for r in found.collect()) == ["a.md", "deep/b.md"]
    docs = {r.rel_path: r for r in S.read_documents(found, F.lit("2026-06-30").cast("date")).collect()}
    assert docs["a.md"].title == "Alpha" and docs["a.md"].facts[0].subject == "x" and docs["deep/b.md"].title == "b"
    assert "�" in docs["deep/b.md"].text
    assert S.stale(found, F.lit(0.0)).count() == 2 and S.stale(found, F.lit(9e12)).count() == 0
    S.save_sources([source], tmp_path / "sources.json", tmp_path)
    assert json.loads((tmp_path / "sources.json").read_text())["sources"][0]["root"] == "notes"
    assert S.load_sources(tmp_path / "sources.json", tmp_path)[0].root == str((tmp_path / "notes").resolve())
    with pytest.raises(ValueError):
        S.add_source([source], source)
    with pytest.raises(ValueError):
        S.add_source([], S.Source("x", str(tmp_path / "gone")))


def test_notes(spark):
    rows = spark.createDataFrame([(1, "A title", "Body", ["x|stage:: one", "owner:: Ann"]), (2, "A title", "More", None)], "note_id long, title string, text string, facts array<string>")
    got = {r.rel_path: r.text for r in S.notes(rows, "2026-06-30").collect()}
    assert set(got) == {"notes/2026-06-30-a-title.md", "notes/2026-06-30-a-title-2.md"}
    assert got["notes/2026-06-30-a-title.md"].endswith("## Facts\n\n- [[x]] stage:: one\n- owner:: Ann")
    with pytest.raises(ValueError):
        S.notes(rows, "2026-06-30", "../out")
    with pytest.raises(Exception, match="a fact must read"):
        S.notes(rows.withColumn("facts", F.array(F.lit("nothing"))), "2026-06-30").collect()


def answered(spark, *answers, kind="application/json"):
    return R.meetings_told(spark.createDataFrame([(k, kind, a) for k, a in enumerate(answers)], "page int, kind string, answer string"))


def test_meeting_answers(spark):
    one = spark.createDataFrame([('event: x\r\n\r\nevent: y\ndata: {"a":\ndata:1}\n\ndata: later\n',), ("event: x\n\n",)], "a string")
    assert [r[0] for r in one.select(R.first_event(F.col("a"))).collect()] == ['{"a":\n1}', None]
    got = answered(
        spark, json.dumps({"result": {"structuredContent": {"meetings": [{"id": "m", "attendees": [{"name": "A"}]}, 3]}}}),
        json.dumps({"result": {"content": [{"type": "text", "text": "no json"}, {"type": "text", "text": '[{"id": "n", "title": "T"}]'}]}}), "[]", json.dumps([{"id": "after the end"}]),
    ).collect()
    assert sorted((r.page, r.meeting_id, r.title, r.truncated) for r in got) == [(0, "m", None, False), (1, "n", "T", False)]
    assert next(r.attendees[0].name for r in got if r.page == 0) == "A"
    assert answered(spark, '{"results": [{"id": "x"}]}').head().truncated
    for bad in (json.dumps({"error": {"message": "no"}}), "no json"):
        with pytest.raises(Exception, match="the meeting service"):
            answered(spark, bad).collect()
    with pytest.raises(Exception, match="gave no JSON"):
        answered(spark, "event: x\n\n", kind="text/event-stream").collect()


def fake_source():
    def answers(url, headers, body):
        page = json.loads(body)["params"]["arguments"]["page"]
        listed = [{"id": f"m{page}", "name": None, "createdAt": "2026-01-02T03:04:05Z", "attendees": [{"name": None, "email": "a@b.c"}]}] if page < 2 else []
        return "text/event-stream", "data: " + json.dumps({"result": {"structuredContent": {"meetings": listed}}}) + "\n\n"

    class Faked(R.MeetingPages):
        transport = staticmethod(answers)

    return Faked


def test_meeting_source(spark):
    spark.dataSource.register(fake_source())
    rows = R.meetings_told(spark.read.format("meeting_pages").option("url", "x").load())
    assert sorted(r.meeting_id for r in rows.collect()) == ["m0", "m1"]
    listed = R.listing(rows).collect()
    assert listed[0].title == "Untitled meeting" and listed[0].attendees == ["a@b.c"]
    assert {r.rel_path for r in R.file_stems(R.listing(rows)).collect()} == {
        "meeting-transcripts/2026-01-02-untitled-meeting.md", "meeting-transcripts/2026-01-02-untitled-meeting-2.md",
    }


def test_missing_files(spark):
    now = F.lit("2026-06-30 00:00:00").cast("timestamp")
    rows = [("a", "leased"), ("b", "leased"), ("c", "pending"), ("d", "done")]
    queue = spark.createDataFrame(rows, "meeting_id string, status string").withColumn("updated_at", now)
    held = spark.createDataFrame([("a",), ("a",), (None,)], "meeting_id string")
    assert {r.meeting_id: r.status for r in state.mark_missing(queue, "meeting_id", held, now).collect()} == {"a": "leased", "b": "missing", "c": "pending", "d": "done"}
