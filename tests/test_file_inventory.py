"""File inventories of files that no row may hold, and line ends that fall between two pieces."""

import hashlib

import pytest

from scorefold.sources import readers as RD

TEXTS = [b"\r", b"\n", b"\r\n", b"a\r\nb\nc\r", b"a\r\r\n\n\rb", b"x" * 9 + b"\r\n" + b"\r" * 7 + b"\n", bytes(range(256)) * 20]


@pytest.mark.parametrize("piece", [1, 2, 5, 4 << 20])
def test_files_beyond_a_rows_limit_are_hashed_as_streams(spark, tmp_path, piece, monkeypatch):
    monkeypatch.setattr(RD, "PIECE", piece)
    for i, t in enumerate(TEXTS):
        (tmp_path / f"a file {i}%20ü.txt").write_bytes(t)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1)  # as a file of more than 2 GB meets the default
    try:
        got = {r["file"]: r for r in RD.file_inventory(spark, str(tmp_path / "*.txt")).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[f"a file {i}%20ü.txt"]
        assert (r["bytes"], r["sha256"]) == (len(t), hashlib.sha256(t).hexdigest())
        assert r["sha256_crlf"] == hashlib.sha256(t.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n")).hexdigest()
    assert all(RD._digests(str(tmp_path / f"a file {i}%20ü.txt"))[1] == got[f"a file {i}%20ü.txt"]["sha256_crlf"] for i in range(len(TEXTS)))  # in pieces of this size


def test_files_of_a_store_are_read_by_spark(spark, tmp_path):
    for i, t in enumerate(TEXTS):
        (tmp_path / f"{i}.txt").write_bytes(t)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.inventory.link./in", f"file://{tmp_path}")
    rows = lambda glob: sorted(tuple(r[c] for c in ("file", "bytes", "sha256", "sha256_crlf")) for r in RD.file_inventory(spark, glob).collect())
    assert rows("viewfs://inventory/in/*.txt") == rows(str(tmp_path / "*.txt")) and len(rows(str(tmp_path / "*.txt"))) == len(TEXTS)
