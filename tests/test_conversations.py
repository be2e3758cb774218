"""Conversation tables: validation, numbering, cascade."""

import datetime as dt

from marketpulse.operators import conversations as cv

T = dt.datetime(2024, 1, 1)


def _sessions(spark):
    return spark.createDataFrame([("s1", T, "新對話 1"), ("s2", T, "custom"), ("s3", T, "新對話 2")],
                                 "id string, created_at timestamp_ntz, title string")


def test_rejects_bad_messages(spark):
    msgs = spark.createDataFrame([
        ("m1", "s1", "user", "hi", T), ("m2", "s1", "system", "x", T), ("m3", "s1", "bot", "", T),
        ("m4", "zz", "bot", "x", T), ("m5", None, "user", "x", T), ("m6", "s2", "bot", "ok", T)],
        "id string, session_id string, sender string, message string, created_at timestamp_ntz")
    ok, bad = cv.validate_messages(msgs, _sessions(spark))
    assert {r.id for r in ok.collect()} == {"m1", "m6"}
    assert {(r.id, r.reason) for r in bad.collect()} == {
        ("m2", "bad sender"), ("m3", "missing field"), ("m4", "unknown session"), ("m5", "missing field")}


def test_number_titles_continue_count(spark):
    new = spark.createDataFrame([("n2", T + dt.timedelta(hours=2), None), ("n1", T + dt.timedelta(hours=1), None),
                                 ("n3", T + dt.timedelta(hours=3), "mine")],
                                "id string, created_at timestamp_ntz, title string")
    out = {r.id: r.title for r in cv.number_titles(new, _sessions(spark)).collect()}
    assert out == {"n1": "新對話 3", "n2": "新對話 4", "n3": "mine"}


def test_rename_rejects_empty_title(spark):
    ch = spark.createDataFrame([("s1", "", 1), ("s2", "later", 3), ("s2", "renamed", 2), ("zz", "x", 1)],
                               "id string, new_title string, n int")
    out = [(r.id, r.title) for r in cv.rename_sessions(_sessions(spark), ch, "n").collect()]
    assert sorted(out) == [("s1", "新對話 1"), ("s2", "later"), ("s3", "新對話 2")]


def test_history_positions_of_a_long_session(spark):
    rows = [(f"m{k:03d}", "s1", "user", "x", T + dt.timedelta(seconds=k // 3)) for k in range(200)]
    m = spark.createDataFrame(rows[::-1], "id string, session_id string, sender string, message string, created_at timestamp_ntz")
    got = {r.id: r.pos for r in cv.histories(m).collect()}
    assert got == {f"m{k:03d}": k + 1 for k in range(200)}
    assert [r.pos for r in cv.history(m, "s1").collect()] == list(range(1, 201))
