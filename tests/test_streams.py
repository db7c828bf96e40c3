"""Streams over landed files, stopped and started again, against their batch twins."""

from datetime import datetime, timedelta

import pytest

from reviewlake.streaming import refresh as S

DAY = timedelta(days=1)
START = datetime(2024, 3, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKS)
    yield spark
    spark.conf.set(key, before)


def landed(spark, path, rows):
    """Files in the order given; each is one trigger's worth."""
    for rows_of_file in rows:
        spark.createDataFrame(rows_of_file, S.UPDATE).coalesce(1).write.mode("append").parquet(path)


def update(pr, day, draft, seq, head="h"):
    return (pr, head, draft, START + day * DAY, False, seq)


def test_a_draft_leaves_after_30_quiet_days(rocks, tmp_path):
    spark, src, out, state = rocks, str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    files = [
        [update(1, 0, True, 1), update(2, 0, True, 2), update(3, 0, False, 3), update(4, 0, True, 4), update(5, 0, True, 5)],
        [update(2, 20, True, 6, "h2"), update(4, 25, False, 7), update(9, 29.5, False, 8)],  # 2 is touched, 4 is ready for review
        [update(9, 33, False, 9)],  # the watermark passes day 30: 1 and 5 leave
        [update(5, 34, True, 10, "h5"), update(9, 52, False, 11)],  # 2 leaves at day 50; 5 is back
        [update(5, 80, False, 12), update(9, 81, False, 13)],  # 5 left at day 64, before it was ready
    ]
    got = []
    for some in files:
        landed(spark, src, [some])
        stream = S.expired_drafts(S.updates(spark, src, 1))
        S.append(stream, out, state).awaitTermination()
        now = {(r.pr, r.head, (r.touched_at - START).days, (r.expired_at - START).days) for r in spark.read.schema(S.EXPIRED).parquet(out).collect()}
        got.append(now)
    first = {(1, "h", 0, 30), (5, "h", 0, 30)}
    assert got[:2] == [set(), set()] and got[2] == first
    assert got[3] == first | {(2, "h2", 20, 50)}
    assert got[4] == got[3] | {(5, "h5", 34, 64)}
    everything = S.quiet_drafts(spark.read.schema(S.UPDATE).parquet(src))
    assert {(r.pr, r.head, (r.touched_at - START).days, (r.expired_at - START).days) for r in everything.collect()} == got[4]
    assert spark.read.parquet(out).count() == len(got[4]), "each once, restarts notwithstanding"


def test_an_older_update_doesnt_bring_a_draft_back(rocks, tmp_path):
    spark, src, out = rocks, str(tmp_path / "src"), str(tmp_path / "out")
    landed(spark, src, [[update(1, 10, False, 2)], [update(1, 9.5, True, 1)], [update(2, 90, False, 3)], [update(2, 95, False, 4)]])
    S.append(S.expired_drafts(S.updates(spark, src, 1)), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.schema(S.EXPIRED).parquet(out).count() == 0
    assert S.quiet_drafts(spark.read.schema(S.UPDATE).parquet(src).limit(0)).count() == 0


def test_sessions_take_late_rows_in(spark, tmp_path):
    src, out, state = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    landed(spark, src, [[update(1, 0, False, 1), update(1, 0.5, False, 2), update(2, 0.1, False, 3)], [update(1, 0.25, False, 4)], [update(3, 5, False, 5)], [update(3, 9, False, 6)]])
    S.append(S.sessions(S.updates(spark, src, 1), "pr", "updated_at"), out, state).awaitTermination()
    want = {(1, 3, 0.0, 0.5), (2, 1, 0.1, 0.1), (3, 1, 5.0, 5.0)}
    as_days = lambda rows: {(r.pr, r.rows, round((r.began - START) / DAY, 3), round((r["last"] - START) / DAY, 3)) for r in rows}
    assert as_days(spark.read.parquet(out).collect()) == want
    batch = S.sessions(spark.read.schema(S.UPDATE).parquet(src), "pr", "updated_at").collect()
    assert as_days(batch) == want | {(3, 1, 9.0, 9.0)}


def test_days_are_given_once_they_are_over(spark, tmp_path):
    src, out, state = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "state")
    landed(spark, src, [[update(1, 0, False, 1), update(1, 0.9, False, 2)], [update(2, 1.2, False, 3)], [update(2, 0.3, False, 4), update(2, 2.5, False, 5)], [update(2, 9, False, 6)], [update(2, 0.2, False, 7)]])
    S.append(S.per_day(S.updates(spark, src, 1), "updated_at"), out, state).awaitTermination()
    assert sorted(((r.day - START).days, r.rows) for r in spark.read.parquet(out).collect()) == [(0, 3), (1, 1), (2, 1)]
