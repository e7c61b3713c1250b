"""Records, trees and audits against reading every byte."""

import gzip
import hashlib
import struct
from pathlib import Path

from pyspark.sql import functions as F

from facetline.llm import warc
from facetline.llm.shared import Scratch

SCHEMA = "page_id long, url string, html string, name string"


def pages(spark, n=700):
    rows = [(k, f"http://e.x/{k}\n", f"<p>{k}</p>" * (k % 7), "n") for k in range(n)] + [(None, None, None, "n"), (3, "http://e.x/3", "same", "n"), (3, "http://e.x/3", "same", "n")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def folder(scratch, k):
    return Path(scratch.path(f"files/{k}").removeprefix("file://"))


def test_records_are_where_the_catalogue_says(spark):
    scratch = Scratch(spark, "test-warc")
    catalogue = scratch.put(warc.write(pages(spark), scratch.path("files")), "catalogue").collect()
    assert len(catalogue) == 703
    for r in catalogue:
        raw = (folder(scratch, 0) / r.name).read_bytes()[r.offset : r.offset + r.length]
        record = gzip.decompress(raw)
        head, body = record.split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: resource") and f"Content-Length: {len(body) - 4}".encode() in head
        if r.page_id is not None and r.page_id != 3:
            assert body == (f"<p>{r.page_id}</p>" * (r.page_id % 7)).encode() + b"\r\n\r\n"


def test_audit_finds_what_differs(spark):
    scratch = Scratch(spark, "test-warc")
    damage = F.col("page_id") % 97 == 5
    catalogue = scratch.put(warc.write(pages(spark), scratch.path("files"), 2, damage), "catalogue")
    rows = catalogue.collect()
    lost = min(r.name for r in rows)
    short = max(r.name for r in rows)
    other = folder(scratch, 1)
    (other / lost).unlink()
    whole = (other / short).read_bytes()
    (other / short).write_bytes(whole[: len(whole) // 2])
    got = {(r.file, r.place): r for r in warc.audited(catalogue, scratch.path("files/0"), scratch.path("files/1"), scratch).collect()}
    assert len(got) == len(rows) + len({r.file for r in rows})
    assert {r.name for r in got.values() if r.page_id is None and r.length == -1 and r.damaged} == {lost, short}
    for r in rows:
        mine = (folder(scratch, 0) / r.name).read_bytes()[r.offset : r.offset + r.length]
        theirs = (other / r.name).read_bytes()[r.offset : r.offset + r.length] if r.name != lost else b""
        assert got[r.file, r.place].hash == hashlib.sha256(b"\0" + struct.pack("<qqq", r.place, r.offset, r.length) + mine).hexdigest()
        assert got[r.file, r.place].damaged == (mine != theirs)


def test_bytes_and_files_that_only_the_replica_has(spark):
    scratch = Scratch(spark, "test-warc")
    catalogue = scratch.put(warc.write(pages(spark), scratch.path("files"), 2), "catalogue")
    one, two = scratch.path("files/0"), scratch.path("files/1")
    names = sorted({r.name for r in catalogue.collect()})
    assert warc.audited(catalogue, one, two, scratch).where("damaged").count() == 0 and warc.extra_files(one, two) == []
    with open(folder(scratch, 1) / names[0], "ab") as file:
        file.write(b"x" * 5000)
    (folder(scratch, 1) / "stray.warc.gz").write_bytes(b"y")
    found = warc.audited(catalogue, one, two, scratch).where("damaged").collect()
    assert [(r.name, r.page_id, r.length) for r in found] == [(names[0], None, -1)]
    assert warc.extra_files(one, two) == ["stray.warc.gz"]


def test_a_catalogue_with_other_offsets(spark):
    scratch = Scratch(spark, "test-warc")
    catalogue = scratch.put(warc.write(pages(spark, 60), scratch.path("files"), 2), "catalogue")
    file = catalogue.first().file
    moved = (F.col("file") == file) & (F.col("place") == 5)
    wrong = catalogue.withColumn("offset", F.when(moved, F.col("offset") + 1).otherwise(F.col("offset")))
    cut = catalogue.where((F.col("file") != file) | (F.col("place") != 7))
    audit = lambda other: [(r.file, r.place) for r in warc.audited(catalogue, scratch.path("files/0"), scratch.path("files/1"), scratch, other).where("damaged").collect()]
    assert audit(wrong) == [(file, 5)] and audit(cut) == [(file, 7)]


def test_only_differing_branches_are_compared(spark):
    level = lambda rows: spark.createDataFrame(rows, "file long, place long, hash string")
    one = [level([(0, k, f"h{k}") for k in range(40)]), level([(0, 0, "a"), (0, 1, "b"), (0, 2, "c")]), level([(0, 0, "r")])]
    # the leaves below the first node differ too, but nothing above says so
    two = [level([(0, k, f"x{k}") for k in range(40)]), level([(0, 0, "a"), (0, 1, "B"), (0, 2, "c")]), level([(0, 0, "R")])]
    assert sorted(r.place for r in warc.differing(one, two).collect()) == list(range(16, 32))


def test_empty_table(spark):
    scratch = Scratch(spark, "test-warc")
    catalogue = scratch.put(warc.write(pages(spark).where("false"), scratch.path("files")), "catalogue")
    assert warc.audited(catalogue, scratch.path("files/0"), scratch.path("files/1"), scratch).count() == 0
