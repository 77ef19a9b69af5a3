"""Sources by kind, settled scans, managed copies, backups that refuse what has changed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators.vector import query_input
from siltstone.sources import files
from siltstone.sources.backup import Backup, Managed


def entries(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "logical_path string, content binary")


def test_sources_by_kind(spark, tmp_path):
    for name, text in (("a.md", "# a"), ("b.txt", "b"), ("c.jsonl", "{}"), ("sub/d.md", "d")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    names = lambda rows: sorted(r.logical_path for r in rows.collect())
    read = lambda uri, *a, **b: names(files.read_source(spark, uri, *a, **b))
    assert read(str(tmp_path)) == ["a.md", "b.txt", "c.jsonl", "sub/d.md"]
    assert read(str(tmp_path), "obsidian") == ["a.md", "sub/d.md"] and read(str(tmp_path), "jsonl") == ["c.jsonl"] and read(f"{tmp_path}/b.txt", "file") == ["b.txt"]
    assert files.read_source(spark, "-", text="hello").first().content == b"hello"
    pages = spark.createDataFrame([("http://x.org/a", "1"), ("http://x.org/a/b", "2"), ("http://x.org/ab", "3")], "url string, html string")
    assert read("http://x.org/a", pages=pages) == ["x.org/a", "x.org/a/b"]
    for bad in ({"kind": "ftp"}, {"kind": "web"}, {"kind": "text"}):
        with pytest.raises(ValueError):
            files.read_source(spark, "x", **bad)


def test_settled(spark):
    now = datetime(2024, 1, 1, 12)
    scan = spark.createDataFrame([("old", 1, now - timedelta(seconds=9)), ("new", 1, now), ("grown", 2, now - timedelta(seconds=9)), ("first", 1, now - timedelta(seconds=9))], "logical_path string, size_bytes long, mtime timestamp")
    before = scan.where("logical_path <> 'first'").withColumn("size_bytes", F.lit(1).cast("long"))
    assert [r.logical_path for r in files.settled(scan, before, now).collect()] == ["old"]


def test_a_flipped_byte_is_refused(spark, tmp_path):
    source = entries(spark, ("a.bin", bytes(range(256)) * 20), ("empty", b""), ("dir/b.txt", b"text"))
    held = Backup(spark, f"file://{tmp_path}/whole")
    held.take(source, size=1000)
    assert held.issues().isEmpty() and sorted((r.logical_path, bytes(r.content)) for r in held.restore().collect()) == sorted((r.logical_path, bytes(r.content)) for r in source.collect())
    with pytest.raises(Exception, match="exists"):
        held.take(source)
    pieces = spark.read.parquet(f"file://{tmp_path}/whole/ranges")
    flipped = F.when((F.col("path") == "a.bin") & (F.col("no") == 3), F.concat(F.substr("bytes", F.lit(1), F.lit(999)), F.lit(b"!"))).otherwise(F.col("bytes"))
    cases = {"changed": pieces.withColumn("bytes", flipped), "missing": pieces.where("path <> 'dir/b.txt'"), "surplus": pieces.unionByName(pieces.where("no = 0").withColumn("path", F.lit("more")).limit(1)), "changed2": pieces.where("path <> 'a.bin' or no <> 5")}
    for name, rows in cases.items():
        bad = Backup(spark, f"file://{tmp_path}/{name}")
        rows.write.parquet(f"{bad.root}/ranges")
        spark.read.parquet(f"file://{tmp_path}/whole/manifest").write.parquet(f"{bad.root}/manifest")
        assert [r.issue for r in bad.issues().collect()] == [name.rstrip("2")]
        with pytest.raises(ValueError, match="not whole"):
            bad.restore()


def test_managed_copies(spark, tmp_path):
    held = Managed(spark, f"file://{tmp_path}/managed")
    one = held.add("s1", entries(spark, ("a", b"x"), ("b", b"x"), ("c", b"y")))
    held.add("s2", entries(spark, ("a", b"x"), ("d", b"z")))
    assert one.count() == 3 and held.blobs().count() == 3
    for bad in ("../a", "/etc/a", "a/../../b", "C:\\a", "a\\..\\b", ""):
        with pytest.raises(Exception, match="leaves its folder"):
            held.add(f"bad{abs(hash(bad))}", entries(spark, (bad, b"x")))


def test_query_input():
    assert query_input("Find it.", " ＡＢ ") == "Find it.\nQuery: AB"
