"""The growing log: exact ranges, restarts, truncation and new files; commits that die at each step; revisions against a recompute."""

import io
import os
import random

import pytest
from pyspark.sql import functions as F

from lanternlog.sources import tail as T
from lanternlog.sources.log import parse_events
from lanternlog.streaming import ingest as I
from lanternlog.streaming.commits import CommittedTables

STAMP = "[Fri Jul 31 18:38:02 2026] "


class Counting(io.BytesIO):
    """A file that notes which bytes were read."""

    def __init__(self, data):
        super().__init__(data)
        self.lowest, self.highest, self.total = len(data), 0, 0

    def read(self, n=-1):
        at = self.tell()
        out = super().read(n)
        self.lowest, self.highest, self.total = min(self.lowest, at), max(self.highest, at + len(out)), self.total + len(out)
        return out


def split_lines(data, first):
    out, at = [], 0
    for part in data.split(b"\n")[:-1]:
        if at >= first:
            out.append((at, part))
        at += len(part) + 1
    return out


def test_ranges_hold_every_line_once_and_read_new_bytes_only(monkeypatch):
    rnd = random.Random(2)
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(T, "READ", size)
        for _ in range(60):
            data = b"".join(rnd.choice([b"", b"a", b"long line of it", b"\r"]) + b"\n" for _ in range(rnd.randrange(1, 12))) + rnd.choice([b"", b"partial"])
            end = T.last_line_end(io.BytesIO(data), len(data))
            assert end == data.rfind(b"\n") + 1
            first = rnd.choice([0, *(at for at, _ in split_lines(data, 0))])
            got = []
            for part in T.ranges("p", first, end, rnd.randrange(1, 20)):
                file = Counting(data)
                got += T.lines_of(file, part)
                assert file.total == 0 or (file.lowest >= first and file.highest <= end)
            assert got == split_lines(data, first)
    assert T.last_line_end(io.BytesIO(b"no line"), 7) == T.last_line_end(io.BytesIO(b""), 0) == 0


def test_a_poll_reads_the_new_bytes_alone(tmp_path, monkeypatch):
    """What lies before the last place isn't read again, but for the identity at the file's head."""
    log = tmp_path / "log.txt"
    log.write_bytes(b"x" * 2000 + b"\n" + b"old\n" * 5000)
    reader = T.LogTailReader(str(tmp_path), 1 << 20)
    start = reader.latestOffset()
    with log.open("ab") as f:
        f.write(b"new line\npart")
    read = []
    monkeypatch.setattr(T, "lines_of", lambda file, part, real=T.lines_of: (read.append(file := Counting(log.read_bytes())), real(file, part))[1])
    parts = reader.partitions(start, reader.latestOffset())
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["line"], r["offset"], r["next"]) for r in rows] == [("new line", 22001, 22010)]
    assert sum(f.total for f in read) == 9


def lines_seen(tables):
    return sorted((os.path.basename(r.path), r.offset, r.name) for r in I.events(tables).where("type = 'achievement'").collect())


def said(*names):
    return "".join(f"{STAMP}You have completed achievement: {n}\r\n" for n in names).encode()


def expected(folder):
    out = []
    for name in sorted(os.listdir(folder)):
        for at, part in split_lines((folder / name).read_bytes(), 0):
            text = part.decode("utf-8", "replace").strip()
            if "achievement: " in text:
                out.append((name, at, text.split("achievement: ")[1]))
    return out


def test_stream_follows_growing_truncated_and_new_logs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    tables = CommittedTables(spark, f"{tmp_path}/tables")
    run = lambda: I.ingest(spark, str(logs), tables, f"{tmp_path}/checkpoint").awaitTermination()
    run()
    assert I.events(tables).count() == 0
    (logs / "a.txt").write_bytes(said("one", "two") + b"bad \xff byte\n" + said("three")[:-9])
    run()
    assert [n for *_, n in lines_seen(tables)] == ["one", "two"]  # the line being written waits
    (logs / "a.txt").write_bytes((logs / "a.txt").read_bytes() + said("three")[-9:] + said("four"))
    (logs / "b.txt").write_bytes(said(*(f"b{i}" for i in range(30))))
    run()  # a restart: the stream is a new one under the same checkpoint
    assert lines_seen(tables) == expected(logs) and len(lines_seen(tables)) == 34
    before = len(tables.manifests())
    run()
    assert len(tables.manifests()) == before  # nothing new, no batch
    (logs / "a.txt").write_bytes(said("one"))  # truncated in place
    run()
    assert lines_seen(tables) == expected(logs) and len(lines_seen(tables)) == 31
    (logs / "b.txt").write_bytes(said("zero") + (logs / "b.txt").read_bytes())  # another log under the old name
    (logs / "a.txt").write_bytes(said("one", "again"))
    run()
    assert lines_seen(tables) == expected(logs) and len(lines_seen(tables)) == 33
    (logs / "a.txt").write_bytes(b"")
    run()
    assert lines_seen(tables) == expected(logs) and len(lines_seen(tables)) == 31
    (logs / "a.txt").write_bytes(said("fresh"))
    run()
    assert lines_seen(tables) == expected(logs)
    places = {os.path.basename(r.path): r.next for r in I.places(tables).collect()}
    assert places == {n: os.path.getsize(logs / n) for n in ("a.txt", "b.txt")}


@pytest.mark.parametrize("step", ["events", "places", "manifest", "after"])
def test_a_batch_that_dies_is_not_seen_and_comes_again(spark, tmp_path, monkeypatch, step):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.txt").write_bytes(said("one"))
    tables = CommittedTables(spark, f"{tmp_path}/tables")
    I.ingest(spark, str(logs), tables, f"{tmp_path}/checkpoint").awaitTermination()
    (logs / "a.txt").write_bytes(said("one", "two", "three"))
    real, dead = CommittedTables._write, []

    def die(*_):
        dead.append(1)
        raise RuntimeError("the machine is gone")

    if step in ("events", "places"):
        monkeypatch.setattr(CommittedTables, "_write", lambda self, rows, path: (real(self, rows, path), die()) if f"/{step}/" in path else real(self, rows, path))
    elif step == "manifest":
        monkeypatch.setattr(CommittedTables, "_publish", die)
    else:  # the manifest stands, the stream doesn't know
        commit = CommittedTables.commit
        monkeypatch.setattr(CommittedTables, "commit", lambda self, *a: (commit(self, *a), die()))
    with pytest.raises(Exception, match="the machine is gone"):
        I.ingest(spark, str(logs), tables, f"{tmp_path}/checkpoint").awaitTermination()
    monkeypatch.undo()
    assert dead and [n for *_, n in lines_seen(tables)] == (["one", "two", "three"] if step == "after" else ["one"])
    I.ingest(spark, str(logs), tables, f"{tmp_path}/checkpoint").awaitTermination()
    assert lines_seen(tables) == expected(logs) and I.places(tables).first().next == os.path.getsize(logs / "a.txt")
    assert tables.vacuum() == {"events": 1, "places": 2, "manifest": 2, "after": 0}[step]
    assert lines_seen(tables) == expected(logs) and tables.vacuum() == 0


def test_commits_have_one_name_and_one_writer(spark, tmp_path):
    tables = CommittedTables(spark, f"{tmp_path}/t")
    row = spark.createDataFrame([("x", 1)], "k string, n long")
    assert (tables.commit("a", {"t": row}), tables.commit("a", {"t": row}), tables.commit("b", {"t": row}, {"k": ["x"]})) == (0, None, 1)
    assert [(r.k, r.n, r.batch) for r in tables.read("t", "k string, n long").collect()] == [("x", 1, 1)]
    assert tables.read("other", "k string").count() == 0
    with pytest.raises(RuntimeError, match="another writer"):
        tables._publish(1, {})


def grammar(version):
    """A grammar that learns: version 1 doesn't know places, version 2 also reads merges better."""

    def parse(lines):
        out = parse_events(lines)
        if version == 1:
            return out.withColumn("type", F.when(F.col("type") != "zone", F.col("type")))
        return out.withColumn("zone", F.upper("zone")) if version == 3 else out

    return parse


def test_revisions_replace_their_types_only(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    rnd = random.Random(1)
    kinds = ["You have entered Place {}.", "You have completed achievement: Deed {}", "You have slain rat {}!", "Someone says, {}"]
    text = lambda n: "".join(STAMP + rnd.choice(kinds).format(rnd.randrange(50)) + "\n" for _ in range(n)).encode()
    (logs / "a.txt").write_bytes(text(200))
    (logs / "b.txt").write_bytes(text(100))
    tables = CommittedTables(spark, f"{tmp_path}/tables")
    first = {"achievement": (1, ["achievement:"])}
    assert I.backfill(spark, str(logs), tables, first) == ["achievement"] and I.events(tables).count() == 0  # nothing read yet: the guard alone
    live = lambda v: I.ingest(spark, str(logs), tables, f"{tmp_path}/checkpoint", grammar(v)).awaitTermination()
    live(1)
    (logs / "a.txt").write_bytes((logs / "a.txt").read_bytes() + text(50))
    columns = ["path", "offset", "type", "zone", "name", "target"]
    whole = lambda v: sorted(map(tuple, I.events_of(T.landed(spark, str(logs)), grammar(v)).select(columns).collect()), key=repr)
    seen = lambda: sorted(map(tuple, I.events(tables).select(columns).collect()), key=repr)
    parsed = []

    def counted(lines):
        parsed.append(lines.count())
        return grammar(2)(lines)

    second = first | {"zone": (1, ["You have entered"])}
    assert I.backfill(spark, str(logs), tables, second, counted) == ["zone"]
    gated = sum(b"You have entered" in line for f in ("a.txt", "b.txt") for line in (logs / f).read_bytes().splitlines()[: 200 if f == "a.txt" else 100])
    assert parsed == [gated]  # gated lines below the stream's places, none of the 50 new ones
    assert I.backfill(spark, str(logs), tables, second, counted) == [] and len(parsed) == 1
    live(2)  # the new lines come by the stream, with the new grammar
    assert seen() == whole(2)
    third = second | {"zone": (2, None), "kill": (1, ["slain"])}
    assert I.backfill(spark, str(logs), tables, third, grammar(3)) == ["kill", "zone"]
    assert seen() == whole(3) and any(r[3] and r[3].isupper() for r in seen())


def test_an_offset_of_a_short_file_is_known_again(tmp_path):
    log = tmp_path / "a.txt"
    log.write_bytes(b"short\n")
    reader = T.LogTailReader(str(tmp_path), 100)
    start = reader.latestOffset()
    log.write_bytes(b"short\n" + b"y" * 600 + b"\n")
    assert [(p.start, p.stop, p.reset) for p in reader.partitions(start, reader.latestOffset())][0] == (6, 106, False)
    log.unlink()
    assert reader.partitions(start, T.LogTailReader(str(tmp_path), 100).latestOffset()) == []
    log.write_bytes(b"other\n" + b"y" * 600 + b"\n")
    assert reader.partitions(start, reader.latestOffset())[0].reset
