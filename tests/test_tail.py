"""The tail source: lines of growing files, once each."""

import os

import pytest

from trafficscore.sources import tail
from trafficscore.sources.tail import LogTailReader, Span, tail_lines
from trafficscore.streaming.runner import drain


def _append(path, data):
    with open(path, "ab") as f:
        f.write(data)


class Tail:
    """A tail query that is started anew for every batch."""

    def __init__(self, spark, folder, scratch, **options):
        self.spark, self.folder, self.options = spark, folder, options
        self.out, self.ck, self.seen = os.path.join(scratch, "out"), os.path.join(scratch, "ck"), 0

    def run(self):
        lines = tail_lines(self.spark, self.folder, **self.options)
        drain(lines.writeStream.format("parquet").option("checkpointLocation", self.ck)
              .trigger(availableNow=True).start(self.out))
        rows = self.spark.read.schema("value string, file string, at long").parquet(self.out)
        return sorted((os.path.basename(r.file), r.at, r.value) for r in rows.collect())


def test_appended_lines_come_once_over_restarts(spark, scratch):
    folder = os.path.join(scratch, "logs")
    os.makedirs(folder)
    log = os.path.join(folder, "a.tsv")
    _append(log, b"old\nhalf")
    t = Tail(spark, folder, scratch)
    assert t.run() == []                                     # starts at the end
    _append(log, b" done\nnew\r\nopen")
    want = [("a.tsv", 4, "half done"), ("a.tsv", 14, "new")]
    assert t.run() == want
    assert t.run() == want                                   # nothing new
    _append(log, b"\n\n\xff\n")
    _append(os.path.join(folder, "b.tsv"), b"first\n")       # a later file from its first line
    _append(os.path.join(folder, ".hidden"), b"no\n")
    want += [("a.tsv", 19, "open"), ("a.tsv", 24, ""), ("a.tsv", 25, "�"), ("b.tsv", 0, "first")]
    assert t.run() == want
    os.remove(log)                                           # replaced by a longer file, other first line
    _append(log, b"x" * 40 + b"\nz\n")
    want += [("a.tsv", 0, "x" * 40), ("a.tsv", 41, "z")]
    assert t.run() == sorted(want)
    with open(log, "wb") as f:                               # cut short, same first line
        f.write(b"x" * 40 + b"\n")
    want.append(("a.tsv", 0, "x" * 40))
    assert t.run() == sorted(want)


def test_ranges_of_one_batch_share_no_line(spark, scratch):
    log = os.path.join(scratch, "one.tsv")
    lines = [("é" * (k % 7) + str(k)) for k in range(300)] + ["long" * 50, ""]
    _append(log, "".join(x + "\n" for x in lines).encode())
    t = Tail(spark, log, scratch, start="begin", splitBytes="23")
    rows = t.run()
    assert [v for _, _, v in rows] == lines


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_every_split_size_gives_every_line(scratch, size):
    log = os.path.join(scratch, "split.tsv")
    data = b"a\n\nbb\nccc\r\n" + b"d" * 30 + b"\ne\nopen"
    _append(log, data)
    reader = LogTailReader({"path": log, "start": "begin", "splitBytes": str(size)})
    got = [v for span in reader.partitions({}, reader.latestOffset()) for b in reader.read(span)
           for v in b.column(0).to_pylist()]
    assert got == ["a", "", "bb", "ccc", "d" * 30, "e"]


def test_offsets(scratch, monkeypatch):
    log = os.path.join(scratch, "offsets.tsv")
    reader = LogTailReader({"path": log})
    assert reader.latestOffset() == {}                       # not there yet
    _append(log, b"")
    monkeypatch.setattr(tail, "BLOCK", 8)
    assert reader.latestOffset() == {log: {"end": 0, "lines": ""}}
    _append(log, b"0123456789abcdefghij")                    # a line over several blocks
    assert reader.latestOffset()[log]["end"] == 0
    _append(log, b"\nk")
    one = reader.latestOffset()
    assert one[log]["end"] == 21
    _append(log, b"\nl\n")
    two = reader.latestOffset()
    assert [(s.low, s.high) for s in reader.partitions(one, two)] == [(21, 25)]
    with pytest.raises(ValueError):
        LogTailReader({"path": log, "start": "middle"})


def test_a_batch_whose_file_was_replaced(scratch):
    log = os.path.join(scratch, "gone.tsv")
    _append(log, b"a\nb\n")
    reader = LogTailReader({"path": log})
    span = reader.partitions({}, reader.latestOffset())[0]
    with open(log, "wb") as f:
        f.write(b"other\nlines\n")
    with pytest.raises(RuntimeError):
        list(reader.read(span))
    lenient = LogTailReader({"path": log, "failOnDataLoss": "false"})
    assert list(lenient.read(span)) == []
    os.remove(log)
    with pytest.raises(RuntimeError):
        list(reader.read(span))
    assert list(reader.read(Span("", 0, 0, 0, ""))) == []
