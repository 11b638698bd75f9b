"""Incremental reading of growing files equals reading them whole."""

import json
import os
import pickle
import random

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from turnwise.sources.transcripts import read_lines
from turnwise.streaming import tail


class Follow:
    """Runs of one stream over a folder, each resuming from the checkpoint."""

    def __init__(self, spark, tmp_path, **how):
        self.spark, self.root, self.tmp, self.how = spark, tmp_path / "in", tmp_path, how
        self.root.mkdir()

    def write(self, name, data, mode="wb", age=None):
        file = self.root / name
        file.parent.mkdir(exist_ok=True)
        with open(file, mode) as out:
            out.write(data)
        if age is not None:
            os.utime(file, (age, age))

    def run(self):
        """Rows of the new batches."""
        out = str(self.tmp / "out")
        lines = tail.stream_lines(self.spark, str(self.root), "*/*.jsonl", str(self.tmp / "positions"), **self.how)
        before = self.spark.read.parquet(out).count() if os.path.isdir(out) else 0
        q = lines.writeStream.option("checkpointLocation", str(self.tmp / "ck")).foreachBatch(
            lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        self.all = self.spark.read.parquet(out) if os.path.isdir(out) else None
        return (self.all.count() if self.all is not None else 0) - before

    def lines(self):
        """path to its lines in order: those of the newest generation."""
        got = {}
        newest = {r.path: r.g for r in self.all.groupBy("path").agg(F.max("generation").alias("g")).collect()}
        for r in sorted(self.all.where("value is not null").collect(), key=lambda r: (r.path, r.line_no)):
            if r.generation == newest[r.path]:
                got.setdefault(r.path, []).append(r.value)
        return got

    def whole(self):
        want = {}
        for r in sorted(read_lines(self.spark, f"{self.root}/*/*.jsonl").collect(), key=lambda r: (r.path, r.line_no)):
            want.setdefault(r.path, []).append(r.value)
        return want

    def covered(self):
        """Ranges of the newest generation lie end to end from the first byte."""
        for path in self.lines():
            rows = self.all.where(F.col("path") == path)
            newest = rows.agg(F.max("generation")).first()[0]
            at = 0
            for r in sorted(rows.where((F.col("generation") == newest) & F.col("upto").isNotNull()).collect(), key=lambda r: r.line_no):
                assert r.line_no == at
                at = r.upto
            assert at == len((self.root / path.split("/in/")[1]).read_bytes())


def body(rng, n):
    return b"".join(b'{"k": "%s"}\n' % (b"x" * rng.randrange(60)) + rng.choice([b"", b"", b"\n", b"\r\n"]) for _ in range(n))


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_added_shrunk_and_replaced_files_give_the_batch_answer(spark, tmp_path, block):
    rng = random.Random(block)
    f = Follow(spark, tmp_path, block_bytes=block)
    f.write("p/a.jsonl", body(rng, 40))
    f.write("p/b.jsonl", body(rng, 5))
    f.write("q/c.jsonl", b"")
    f.write("p/skip.txt", b"not matched\n")
    f.run()
    assert f.lines() == f.whole()
    f.covered()
    # Added lines, a new file, an unchanged one.
    f.write("p/a.jsonl", body(rng, 30), "ab")
    f.write("q/c.jsonl", "é ñ\n".encode(), "ab")
    f.write("q/d.jsonl", body(rng, 3))
    f.run()
    assert f.lines() == f.whole()
    assert f.all.where("path like '%b.jsonl' and batch > 0").count() == 0 and f.all.agg(F.max("generation")).first()[0] == 0
    f.covered()
    # Cut short; replaced by content of another length, of the same length, and by a longer one with the same beginning.
    f.write("p/a.jsonl", (f.root / "p/a.jsonl").read_bytes()[:7] + b'"}\n')
    f.write("p/b.jsonl", bytes((f.root / "p/b.jsonl").read_bytes()).replace(b"x", b"y"), age=1_800_000_000)
    f.write("q/d.jsonl", b"other\n" * 50)
    f.run()
    assert f.lines() == f.whole()
    f.covered()
    assert {r.path.split("/")[-1]: r.g for r in f.all.groupBy("path").agg(F.max("generation").alias("g")).collect()} == {"a.jsonl": 1, "b.jsonl": 1, "c.jsonl": 0, "d.jsonl": 1}
    # Nothing new: no batch.
    assert f.run() == 0


def test_a_half_written_line_waits(spark, tmp_path):
    f = Follow(spark, tmp_path)
    f.write("p/a.jsonl", b"one\ntw")
    f.run()
    assert list(f.lines().values()) == [["one"]]
    f.write("p/a.jsonl", b"o\nthree\n", "ab")
    f.run()
    assert list(f.lines().values()) == [["one", "two", "three"]]
    f.covered()


def test_a_bound_leaves_lines_for_the_next_run(spark, tmp_path):
    f = Follow(spark, tmp_path, max_bytes=100)
    f.write("p/a.jsonl", b"".join(b"line %03d\n" % i for i in range(50)))
    f.write("p/b.jsonl", b"x" * 500 + b"\n")
    seen = []
    for _ in range(12):
        f.run()
        seen.append(sum(map(len, f.lines().values())))
    assert seen[0] < 51 and seen[-1] == 51 and f.lines() == f.whole()
    f.covered()


def test_changes_that_no_manifest_of_the_query_saw(tmp_path):
    """A manifest written by a run that died is built upon, and the bytes between two committed ones are whole."""
    (tmp_path / "in").mkdir()
    reader = tail.TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / "pos")})
    first = reader.initialOffset()
    (tmp_path / "in/a").write_bytes(b"one\n")
    reader.latestOffset()
    (tmp_path / "in/a").write_bytes(b"one\ntwo\n")
    end = reader.latestOffset()
    assert end["n"] == 2 and [p.ranges for p in reader.partitions(first, end)] == [[(str(tmp_path / "in/a"), 0, 0, 8, True)]]
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    reader.commit(end)
    assert [o["n"] for o in reader._manifests()] == [2]


@pytest.mark.parametrize("budget", [{}, {"max_bytes": "400"}])
def test_no_list_of_all_files_is_held(tmp_path, monkeypatch, budget):
    """Few files are sorted at a time, what a task reads is not in its partition, and all files are read once."""
    monkeypatch.setattr(tail, "SORTED_ROWS", 4)
    monkeypatch.setattr(tail, "STEP_ROWS", 3)
    names = [str(tmp_path / f"in/{i % 7}/{i}.txt") for i in range(30)]
    for name in names:
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(name, "w") as out:
            out.write("one\n" * 10)
    (tmp_path / "in/no.log").write_bytes(b"not matched\n")
    (tmp_path / "in/8").symlink_to("gone")
    reader = tail.TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / "pos"), "pattern": "*/*.txt", "block_bytes": "10000", **budget})
    end, got = reader.initialOffset(), []
    while (after := reader.latestOffset()) != end:
        parts = reader.partitions(end, after)
        assert max(len(pickle.dumps(p)) for p in parts) < 400
        got += [r for p in parts for r in p.ranges]
        reader.commit(after)
        end = after
    for name in names:
        ranges = sorted(r[2:4] for r in got if r[0] == name)
        assert [low for low, _ in ranges] == [0, *(high for _, high in ranges[:-1])] and ranges[-1][1] == 40
    assert {r[0] for r in got} == set(names) and (budget or len(got) == 30)
    assert [p.name for p in (tmp_path / "pos").iterdir()] == [f"{end['n']:012d}-{end['id']}.json"]
    with open(names[3], "a") as out:
        out.write("two\nhal")
    os.remove(names[5])
    after = reader.latestOffset()
    assert [p.ranges for p in reader.partitions(end, after)] == [[(names[3], 0, 40, 44, True)]]
    if not budget:  # with one, the half line is looked at again
        assert reader.latestOffset() == after


def test_manifests_of_earlier_versions_are_read(tmp_path):
    reader = tail.TailReader({"path": str(tmp_path / "in"), "positions": str(tmp_path / "pos")})
    held = {f"/{n}": vars(tail.Seen(0, 5, 5, "h", "t", 5, i)) for i, n in enumerate("zab")}
    (tmp_path / "pos").mkdir()
    (tmp_path / "pos/000000000003-x.json").write_text(json.dumps(held))
    assert [(path, seen.modified) for path, seen in reader._manifest({"n": 3, "id": "x"})] == [("/a", 1), ("/b", 2), ("/z", 0)]


def test_the_tail_is_compared_too(tmp_path):
    store = pyarrow.fs.LocalFileSystem()
    data = b"h" * 5000 + b"\n" + b"t" * 50 + b"\n"
    (tmp_path / "a").write_bytes(data)
    seen = tail.look(store, str(tmp_path / "a"), len(data), 1, None)
    (tmp_path / "a").write_bytes(data.replace(b"t", b"u") + b"more\n")
    assert tail.look(store, str(tmp_path / "a"), len(data) + 5, 2, seen).generation == 1
    (tmp_path / "a").write_bytes(data + b"more\n")
    assert tail.look(store, str(tmp_path / "a"), len(data) + 5, 2, seen).generation == 0


def test_empty_folder(spark, tmp_path):
    assert Follow(spark, tmp_path).run() == 0
