"""Files that are followed: every line arrives once, however the file changes."""

from __future__ import annotations

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tidelog.plans.store import Store
from tidelog.sources import growing
from tidelog.streaming import pipeline


def append(path, text):
    with open(path, "a", newline="") as file:
        file.write(text)


class Follower:
    """Runs a stream on what is there and gives back what it found since the last run."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.options.setdefault("globs", f"{folder}/*.log*")
        self.runs = 0

    def run(self):
        self.runs += 1
        found = []
        raw = growing.follow_lines(self.spark, **self.options)

        def keep(batch, number):
            found.extend((os.path.basename(r["file"]), r["message"]) for r in batch.orderBy("file_id", "position").collect())

        writer = raw.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.folder}-progress")
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(found)


def test_appended_renamed_and_truncated(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "a.log"
    append(log, "one\ntwo\nhal")
    append(folder / "b.log", "")
    follow = Follower(spark, folder)
    assert follow.run() == [("a.log", "one"), ("a.log", "two")]
    append(log, "f\n\nthree\r\n")
    append(folder / "b.log", "b\n")
    assert follow.run() == [("a.log", "half"), ("a.log", "three"), ("b.log", "b")]
    assert follow.run() == []

    # Rotation by renaming: the old file's new lines under its new name, the new file from its start.
    append(log, "last\n")
    os.rename(log, folder / "a.log.1")
    append(log, "one\ntwo\n")
    assert follow.run() == [("a.log", "one"), ("a.log", "two"), ("a.log.1", "last")]

    # Rotation by copying away and truncating, once to a shorter and once to a longer file.
    with open(log, "w") as file:
        file.write("new\n")
    assert follow.run() == [("a.log", "new")]
    with open(log, "w") as file:
        file.write("newer text that is longer\nx\n")
    assert follow.run() == [("a.log", "newer text that is longer"), ("a.log", "x")]
    os.remove(log)
    assert follow.run() == []


def test_record_cut_by_a_batch_comes_once_and_whole(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "a.log"
    append(log, "  orphan\nERROR x\n  at a\n")
    follow = Follower(spark, folder, multiline=True)
    assert follow.run() == [("a.log", "  orphan")]
    append(log, "  at b\n\n  alone\nnext\n  more")
    assert follow.run() == [("a.log", "  alone"), ("a.log", "ERROR x\n  at a\n  at b")]
    append(log, "\nend\n")
    assert follow.run() == [("a.log", "next\n  more")]


def test_quiet_file_ends_its_record(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    log = folder / "a.log"
    append(log, "ERROR x\n  at a")
    options = {"multiline": True, "progress": str(tmp_path / "ended"), "idle_seconds": 30}
    assert Follower(spark, folder, **options).run() == []
    os.utime(log, (time.time() - 60, time.time() - 60))
    assert Follower(spark, folder, **options).run() == [("a.log", "ERROR x\n  at a")]
    append(log, "\n  late\n")
    assert Follower(spark, folder, **options).run() == []
    append(log, "next\n")
    assert Follower(spark, folder, **options).run() == [("a.log", "  late")]


@pytest.mark.parametrize("read_from,age,want", [("end", None, 1), ("beginning", 600, 1), ("beginning", 9000, 3)])
def test_where_reading_begins(spark, tmp_path, read_from, age, want):
    folder = tmp_path / "in"
    folder.mkdir()
    append(folder / "a.log", "1\n2\n")
    os.utime(folder / "a.log", (time.time() - 3600, time.time() - 3600))
    follow = Follower(spark, folder, read_from=read_from, ignore_older_seconds=age)
    first = follow.run()
    append(folder / "a.log", "3\n")
    assert len(first + follow.run()) == want


def test_pieces_share_out_records(tmp_path):
    """Any cut of any text gives the records of the whole text, each in one piece."""
    pick = random.Random(7)
    for case in range(300):
        text = "".join(pick.choice(["a", "bc\n", "\n", "  x\n", "\td", "\r\n", "é\n"]) for _ in range(pick.randint(0, 40)))
        data = text.encode()
        path = tmp_path / f"{case}.log"
        path.write_bytes(data)
        for multiline in (False, True):
            with open(path, "rb") as file:
                end = growing._closed(file, len(data), multiline)
                whole, got = [], []
                for cuts, out in (([0, end], whole), (sorted({0, end, *(pick.randint(0, end) for _ in range(4))}), got)):
                    for a, b in zip(cuts, cuts[1:]):
                        piece = growing.Piece(str(path), "", "", "", 0, 0, a, b, end, 0, 0)
                        out.extend(growing._records(file, piece, multiline))
            assert got == whole
            # Nothing but line ends and blank lines is left out.
            assert b"".join(t for _, t in whole).replace(b"\n", b"") == data[:end].replace(b"\r\n", b"").replace(b"\n", b"")


def test_equal_lines_of_several_batches_are_stored_and_a_lost_checkpoint_adds_none(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    (folder / "h1").mkdir(parents=True)
    (folder / "h2").mkdir()
    same = "[2026-01-10 12:00:00.000] same\n"

    def run(checkpoint):
        raw = growing.follow_lines(spark, f"{folder}/*/*.log*", host_pattern=r"/(h\d)/", multiline=True)
        pipeline.ingest_stream(raw, store, str(tmp_path / checkpoint), host=None, every=None).awaitTermination()

    for _ in range(2):
        for host in ("h1", "h2"):
            append(folder / host / "web-out.log", same * 2)
        run("cp")
    os.rename(folder / "h1" / "web-out.log", folder / "h1" / "web-out__2026-01-10_00-00-00.log")
    append(folder / "h1" / "web-out.log", same)
    run("cp")

    def stored():
        rows = store.read("log_entries").groupBy("host", "service").agg(F.count("*"), F.countDistinct("id"))
        return sorted(map(tuple, rows.collect()))

    assert stored() == [("h1", "web", 3, 3), ("h2", "web", 3, 3)]
    run("lost")
    assert stored() == [("h1", "web", 3, 3), ("h2", "web", 3, 3)]
    shutil.copy(folder / "h2" / "web-out.log", folder / "h2" / "copy-out.log")
    run("cp")
    assert [r for r in stored() if r[1] == "copy"] == [("h2", "copy", 3, 3)]
