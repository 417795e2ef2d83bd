"""Commits of stored tables: isolation, conflicts, crashes, replays, the change feed, retention."""

import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from revpulse.operators import lifecycle
from revpulse.sources.files import Folder
from revpulse.sources.keyed import Conflict, StoredTable

DAYS = [dt.datetime(2024, 1, 1 + d) for d in range(8)]


@pytest.fixture
def rows(spark):
    return lambda *r: spark.createDataFrame(list(r), "k int, at timestamp, x int").checkpoint()


@pytest.fixture
def table(spark, tmp_path, rows):
    made = StoredTable(spark, str(tmp_path / "t"), ["k", "at"], time="at")
    made.upsert(rows(*[(i, d, 0) for i, d in enumerate(DAYS)]))
    return made


def found(df):
    return {(r.k, r.x) for r in df.collect()}


def files(table):
    return {os.path.join(r, f) for r, _, fs in os.walk(f"{table.path}/data") for f in fs if f.startswith("part")}


def test_upsert_adds_only_what_changes(spark, table, rows):
    before = files(table)
    assert table.upsert(rows((3, DAYS[3], 5), (9, DAYS[4], 6), (5, DAYS[5], 0)), ["x"]).touched == ["2024-01-04", "2024-01-05"]
    assert before < files(table) and found(table.read()) == {(i, 0) for i in range(8) if i != 3} | {(3, 5), (9, 6)}
    again = files(table), table.version()
    assert table.upsert(rows((3, DAYS[3], 5), (9, DAYS[4], 6)), ["x"]) == again[1]  # nothing differs: no piece, no version
    assert table.upsert(rows((1, DAYS[0], 1)).limit(0)) == again[1] and files(table) == again[0]
    table.insert(rows((3, DAYS[3], 99), (10, DAYS[3], 7)))
    assert found(table.read(["2024-01-04"])) == {(3, 5), (10, 7)} and table.stats()["rows"] == 10
    inputs = {f.partition("stored_part=")[2][:10] for f in table.read(lambda day: day > "2024-01-05").inputFiles()}
    assert inputs == {"2024-01-06", "2024-01-07", "2024-01-08"}


def test_partial_columns_and_defaults(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "t"), ["k"], buckets=3)
    assert table.read() is None and table.stats()["rows"] == 0
    table.upsert(spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, None, None)], "k int, x string, y int"))
    table.upsert(spark.createDataFrame([(2, 21), (2, 22), (4, 40), (1, None)], "k int, y int"), ["y"], newest=[F.desc("y")], defaults={"x": "-"})
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", None), (2, "b", 22), (3, None, None), (4, "-", 40)]
    table.delete(spark.createDataFrame([(2,), (99,)], "k int"))
    assert sorted(r.k for r in table.read().collect()) == [1, 3, 4] and table.stats()["rows"] == 3
    table.insert(spark.createDataFrame([(2, "new", 1), (3, "other", 1)], "k int, x string, y int"))
    assert sorted(map(tuple, table.read().collect())) == [(1, "a", None), (2, "new", 1), (3, None, None), (4, "-", 40)]


def test_reader_keeps_its_version_while_others_write(table, rows):
    view, version = table.read(), table.version()
    table.upsert(rows((0, DAYS[0], 9)))
    table.fold(["2024-01-01"])
    table.move_older("2024-01-05 00:00:00")
    assert found(view) == {(i, 0) for i in range(8)} == found(table.read(version=version))
    assert found(table.read()) == {(i, 0) for i in range(4, 8)}


def test_killed_writer_leaves_no_trace(table, rows, monkeypatch):
    def killed(*_):
        raise KeyboardInterrupt

    before = found(table.read()), table.version()
    monkeypatch.setattr(Folder, "create", killed)
    for write in (lambda: table.upsert(rows((0, DAYS[0], 9))), lambda: table.put(rows((0, DAYS[0], 9))), lambda: table.fold(["2024-01-01"])):
        with pytest.raises(KeyboardInterrupt):
            write()
    monkeypatch.undo()
    assert (found(table.read()), table.version()) == before and len(table.folder.names("data")) == 4
    assert len(table.vacuum(hours=0)) == 3 and found(table.read()) == before[0]
    assert table.upsert(rows((0, DAYS[0], 9))).number == 2


def test_second_writer_of_a_day_is_refused_and_of_another_goes_on(table, rows):
    base = table.version()
    table.put(rows((0, DAYS[0], 1)), base=base)
    with pytest.raises(Conflict):
        table.put(rows((0, DAYS[0], 2)), base=base)
    assert table.put(rows((1, DAYS[1], 3)), base=base).number == 3
    with pytest.raises(Conflict):
        table.change(base, rows((0, DAYS[0], 4)), lambda old, new: table._images(old, new, None, {}))
    assert found(table.read(["2024-01-01", "2024-01-02"])) == {(0, 1), (1, 3)}


def test_writers_at_once_lose_nothing(spark, table, rows):
    """Eight writers add to one counter of one key and to keys of their own."""
    failed = []

    def work(n):
        try:
            other = StoredTable(spark, table.path, ["k", "at"], time="at")
            for turn in range(2):
                def attempt(base):
                    now = other.read(["2024-01-01"], base).where("k = 0").first().x
                    return other.change(base, rows((0, DAYS[0], now + 1), (100 + 10 * n + turn, DAYS[0], n)), lambda old, new: other._images(old, new, None, {}))
                other.retry(attempt)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = found(table.read(["2024-01-01"]))
    assert (0, 8) in got and len(got) == 9


def test_create_if_absent(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    made = []
    threads = [threading.Thread(target=lambda n=n: made.append((folder.create("versions/1.json", f"writer {n}"), n))) for n in range(8)]
    os.makedirs(tmp_path / "versions")
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (winner,) = [n for ok, n in made if ok]
    assert folder.read("versions/1.json") == f"writer {winner}" and folder.names("versions") == ["1.json"]


def test_batches_are_taken_once(table, rows):
    first = table.upsert(rows((0, DAYS[0], 1)), once=("w", 4))
    assert table.upsert(rows((0, DAYS[0], 2)), once=("w", 4)) == first and table.put(rows((0, DAYS[0], 3)), once=("w", 3)) == first
    table.upsert(rows((1, DAYS[1], 5)))
    table.put(rows((0, DAYS[0], 6)), once=("w", 5))
    assert table.commit_of(("w", 4)).number == first.number and table.commit_of(("w", 3)) is None and table.commit_of(("w", 9)) is None
    assert table.commit_of(("w", 5)).number == 4 and (0, 6) in found(table.read())
    table.upsert(rows((0, DAYS[0], 6)), once=("w", 6))  # changes nothing, but is remembered
    assert table.version().done == {"w": 6}


def test_pieces_are_folded(spark, tmp_path, rows):
    table = StoredTable(spark, str(tmp_path / "t"), ["k", "at"], time="at", most_pieces=3)
    for n in range(12):
        table.put(rows((n % 4, DAYS[0], n), (n, DAYS[1], n)))
        assert table.stats()["pieces"] <= 2 * 3
    assert found(table.read()) == {(8 + i, 8 + i) for i in range(4)} | {(i, i) for i in range(12)} | {(i, 8 + i) for i in range(4)} - {(8, 8)} | {(8, 8)}
    assert table.vacuum(versions=1, hours=0) and len(table.folder.names("versions")) == 1
    assert len(found(table.read(["2024-01-02"]))) == 12


def test_change_feed_and_audit(spark, tmp_path):
    table = StoredTable(spark, str(tmp_path / "config"), ["key"], buckets=2)
    day = lambda n, *pairs: spark.createDataFrame([(k, v, DAYS[n]) for k, v in pairs], "key string, value string, updated_at timestamp")
    table.upsert(day(0, ("a", "1"), ("b", "1"), ("c", None)), feed=True)
    table.upsert(day(1, ("a", "2"), ("b", "1"), ("c", "x"), ("d", "new")), feed=True)
    table.upsert(day(2, ("a", "2"), ("b", None)), feed=True)
    audit = {tuple(r) for r in lifecycle.config_audit_from(table.changes()).collect()}
    assert audit == {("a", "1", "2", DAYS[1]), ("c", None, "x", DAYS[1]), ("b", "1", None, DAYS[2])}
    table.delete(spark.createDataFrame([("d",)], "key string"), feed=True)
    kinds = sorted((r.version, r.kind, r.key) for r in table.changes().collect())
    assert kinds == [(1, "insert", "a"), (1, "insert", "b"), (1, "insert", "c"), (2, "insert", "d"), (2, "update", "a"), (2, "update", "b"), (2, "update", "c"),
                     (3, "update", "a"), (3, "update", "b"), (4, "delete", "d")]
    assert {r.version for r in table.changes(after=2, upto=3).collect()} == {3} and table.changes(after=4) is None


def test_move_older(spark, tmp_path, table, rows):
    table.upsert(rows((10, DAYS[3], 7), (11, DAYS[2] + dt.timedelta(hours=13), 1)))
    archive = StoredTable(spark, str(tmp_path / "archive"), ["k", "at"], time="at")
    assert table.move_older("2024-01-03 12:00:00", archive) == 3
    assert table.move_older("2024-01-03 12:00:00", archive) == 0
    assert table.move_older("2024-01-04 12:00:00", archive) == 3
    assert found(archive.read()) == {(0, 0), (1, 0), (2, 0), (3, 0), (10, 7), (11, 1)}
    assert found(table.read()) == {(i, 0) for i in range(4, 8)}


def test_archive_survives_a_crash_between_its_two_tables(spark, tmp_path, table, monkeypatch):
    archive = StoredTable(spark, str(tmp_path / "archive"), ["k", "at"], time="at")

    def killed(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(StoredTable, "drop_parts", killed)
    with pytest.raises(KeyboardInterrupt):
        table.move_older("2024-01-03 00:00:00", archive)
    monkeypatch.undo()
    assert archive.stats()["rows"] == 2 and table.stats()["rows"] == 8
    assert table.move_older("2024-01-03 00:00:00", archive) == 2
    assert found(archive.read()) == {(0, 0), (1, 0)} and table.stats()["rows"] == 6
