"""Folds of events, and the stream that closes attempts, against folding one by one."""

import datetime
import random

from tracewell.operators import runs
from tracewell.streaming import stages

SCHEMA = "run_id long, document string, attempt int, attempts int, seq long, at timestamp, stage string, score double, parses boolean, pages int, words int, dropped int, reason string"
START = datetime.datetime(2024, 1, 1)


def event(seq, minute, attempt=1, stage="drafting", run=1, document=None, **more):
    at = START + datetime.timedelta(minutes=minute)
    values = {"attempts": None, "score": None, "parses": None, "pages": None, "words": None, "dropped": None, "reason": None} | more
    return (run, document, attempt, values["attempts"], seq, at, stage, values["score"], values["parses"], values["pages"], values["words"], values["dropped"], values["reason"])


def plain(events):
    """One by one in the order of seq."""
    groups = {}
    for run, document, attempt, attempts, seq, at, stage, score, parses, pages, words, dropped, reason in sorted(events, key=lambda e: e[4]):
        if attempt is None:
            continue
        g = groups.setdefault((run, document or "resume", attempt), {"attempts": attempts or attempt, "first_seq": seq, "events": 0, "last_at": at, "score": None, "parses": None, "pages": None, "words": None, "repaired": False, "dropped": 0, "reason": "", "outcome": "open"})
        g["events"] += 1
        g["last_at"] = max(g["last_at"], at)
        g["stage"] = stage
        for name, value in (("score", score), ("parses", parses), ("pages", pages), ("words", words)):
            if value is not None:
                g[name] = value
        if stage == "repaired":
            g |= {"repaired": True, "dropped": dropped or 0, "reason": reason or ""}
        if stage == "rejected":
            g |= {"outcome": "rejected", "reason": reason or ""}
        if stage == "scored":
            g["outcome"] = "finished"
    return groups


def folded(df):
    return {(r.run_id, r.document, r.attempt): {k: v for k, v in r.asDict().items() if k not in ("run_id", "document", "attempt")} for r in df.collect()}


def random_events(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        stage = rng.choice(["drafting", "repaired", "rejected", "scored", "verified"])
        maybe = lambda v: rng.choice([None, v])
        out.append(event(seq, rng.randint(0, 3000), rng.choice([None, 1, 2, 3]), stage, rng.randint(1, 9), rng.choice([None, "resume", "cover_letter"]), attempts=maybe(4), score=maybe(seq / 7), parses=maybe(seq % 2 == 0), pages=maybe(seq % 3), words=maybe(seq), dropped=maybe(2), reason=maybe(f"r{seq}")))
    return out


def test_fold_is_one_by_one(spark):
    events = random_events(500, 1)
    df = spark.createDataFrame(events, SCHEMA)
    assert folded(runs.attempt_folds(df)) == plain(events)
    assert runs.milestones(df).count() == sum(e[2] is None for e in events)


def test_repair_is_kept_by_a_later_score_and_a_rejection_ends(spark):
    log = [event(1, 0, stage="drafting", attempts=4), event(2, 1, stage="repaired", dropped=2, reason="unsupported_term×2"), event(3, 2, stage="scored", score=61.5), event(4, 3, 2, stage="rejected", reason="empty×1"), event(5, 4, None, "planning")]
    got = folded(runs.attempt_folds(spark.createDataFrame(log, SCHEMA)))
    assert (got[1, "resume", 1]["outcome"], got[1, "resume", 1]["repaired"], got[1, "resume", 1]["dropped"], got[1, "resume", 1]["reason"], got[1, "resume", 1]["attempts"]) == ("finished", True, 2, "unsupported_term×2", 4)
    assert (got[1, "resume", 2]["outcome"], got[1, "resume", 2]["attempts"]) == ("rejected", 2)


def stream(spark, folder, tmp, idle=10 * 60_000):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stages.run_to_files(stages.closed_attempts(events, "5 minutes", idle), str(tmp / "out"), str(tmp / "state"))


def put(spark, folder, name, events):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(str(folder / name))


def test_attempts_close_once_and_restarts_repeat_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    pattern = folder / "*"
    folder.mkdir()
    first = [event(1, 0, attempts=3), event(2, 1, 2), event(4, 8, 2, "repaired", dropped=1, reason="x")]
    put(spark, folder, "a", first)
    assert stream(spark, pattern, tmp_path).count() == 0  # the newest is minute 8: nothing is past

    late = [event(3, 4, stage="scored", score=50.0), event(9, 17, 3)]  # seq 3 is late, but within 5 minutes of minute 8
    put(spark, folder, "b", late)
    got = folded(stream(spark, pattern, tmp_path))
    assert got == {}  # the watermark is at minute 12, attempt 1 is open to minute 14

    more = [event(10, 26, 3, "rejected", reason="y"), event(11, 3, 1, "rejected")]  # the second is past the watermark
    put(spark, folder, "c", more)
    got = folded(stream(spark, pattern, tmp_path))
    want = plain([*first, *late])
    assert got == {k: want[k] for k in ((1, "resume", 1), (1, "resume", 2))}
    assert got[1, "resume", 1]["outcome"] == "finished"

    assert folded(stream(spark, pattern, tmp_path)) == got  # a restart without news
    put(spark, folder, "d", [event(12, 90, 4)])
    rows = stream(spark, pattern, tmp_path)
    assert rows.count() == 3 and folded(rows)[1, "resume", 3]["outcome"] == "rejected"


def test_stream_equals_batch(spark, tmp_path):
    events = random_events(400, 5)
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, "a", [*events, event(9999, 100_000, 1, run=77)])
    assert folded(stream(spark, folder / "*", tmp_path)) == plain(events)


def closing(spark, folder, tmp, idle=10 * 60_000):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stages.close_attempts(events, str(tmp / "closed"), str(tmp / "closed-state"), "5 minutes", idle)


def test_attempts_closed_by_aggregates(spark, tmp_path):
    folder, pattern = tmp_path / "in", tmp_path / "in" / "*"
    folder.mkdir()
    first = [event(1, 0, attempts=3), event(2, 1, 2), event(4, 8, 2, "repaired", dropped=1, reason="x"), event(5, 8, None)]
    late = [event(3, 4, stage="scored", score=50.0), event(9, 17, 3)]
    put(spark, folder, "a", first)
    assert folded(closing(spark, pattern, tmp_path)) == {}
    put(spark, folder, "b", late)
    assert folded(closing(spark, pattern, tmp_path)) == {}  # the watermark is at minute 12, attempt 1 is open to minute 14
    put(spark, folder, "c", [event(10, 26, 3, "rejected", reason="y"), event(11, 3, 1, "rejected")])  # the second is past the watermark
    got, want = folded(closing(spark, pattern, tmp_path)), plain([*first, *late])
    assert got == {k: want[k] for k in ((1, "resume", 1), (1, "resume", 2))}
    assert folded(closing(spark, pattern, tmp_path)) == got  # a restart without news
    put(spark, folder, "d", [event(12, 90, 4)])
    rows = closing(spark, pattern, tmp_path)
    assert rows.count() == 3 and folded(rows)[1, "resume", 3]["outcome"] == "rejected"


def test_closing_equals_batch_and_the_query_meets_python_with_no_attempt(spark, tmp_path, monkeypatch):
    from pyspark.sql.group import GroupedData

    from tracewell.plans import record_queries as q

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    events = random_events(400, 5)
    (tmp_path / "in").mkdir()
    put(spark, tmp_path / "in", "a", [*events, event(9999, 100_000, 1, run=77)])
    assert folded(closing(spark, tmp_path / "in" / "*", tmp_path)) == plain(events)
    told = spark.range(300).selectExpr("id event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 90)) ts", "id % 5 user_id", "element_at(array('click', 'view', 'error'), int(id % 3) + 1) event_type", "cast(id as double) value", "'{\"k\": 1}' props")
    told.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    everything = folded(q.attempt_folds(spark, str(tmp_path)))
    want = {k: v for k, v in everything.items() if v["last_at"] < "2024-03-29"}  # the newest event is of the 30th
    assert 0 < len(want) < len(everything) and folded(q.closed_attempts(spark, str(tmp_path))) == want
