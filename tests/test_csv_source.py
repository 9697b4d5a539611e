import tempfile

import pytest
from pyspark.sql import functions as F

from larder.sources import csv as cs


def test_file_position_numbers_survive_split_files(spark):
    """Rows of one file spread over several input splits keep file order numbers."""
    path = tempfile.mkdtemp(prefix="larder-csv-")
    lines = ["k,v"] + [f"{i},v{i % 7}" for i in range(3000)]
    with open(f"{path}/a.csv", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    with open(f"{path}/b.csv", "w") as fh:
        fh.write("\n".join(lines[:101]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")   # force many splits per file
    try:
        df = cs.scan_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3
        rows = df.select("source_file", "k", "source_row_number").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for r in rows:
        assert r["source_row_number"] == int(r["k"]) + 2
    assert len(rows) == 3100


def test_na_tokens_become_null(spark):
    path = tempfile.mkdtemp(prefix="larder-csv-")
    with open(f"{path}/x.csv", "w") as fh:
        fh.write("a,b\nN/A,1\nnull,2\n,3\nok,4\n")
    vals = [r["a"] for r in cs.read_checked_csv(spark, path).orderBy(F.col("b").cast("int")).collect()]
    assert vals == [None, None, None, "ok"]


def test_broken_records_carry_reasons_and_none_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("näme,b\nÄ,1\nx,2,3\n".encode() + b"\xff\xfe,4\n" + "\ufffd,5\nshort\n\"q,u\",6\n".encode() + b"\xc3,7,8\n")
    got = cs.scan_csv(spark, str(tmp_path)).orderBy("source_row_number").collect()
    assert got[0].asDict().keys() >= {"näme", "b", "reject_reason", "source_file", "source_row_number"}
    assert [(r["näme"], r["b"], r["reject_reason"], r["source_row_number"]) for r in got] == [
        ("Ä", "1", None, 2), ("x", "2", cs.SURPLUS_FIELDS, 3), ("\ufffd\ufffd", "4", cs.BAD_ENCODING, 4),
        ("\ufffd", "5", None, 5),  # the replacement character itself is valid text
        ("short", None, None, 6), ("q,u", "6", None, 7), ("\ufffd", "7", cs.BAD_ENCODING, 8)]


def test_quoted_line_breaks_keep_record_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"two\nlines"\n2,"é"\n3,"a\n\nb"\n4,x,y\n', encoding="utf-8")
    got = cs.scan_csv(spark, str(tmp_path), multi_line=True).orderBy("source_row_number").collect()
    assert [(r["k"], r["v"], r["source_row_number"], r["reject_reason"]) for r in got] == [
        ("1", "two\nlines", 2, None), ("2", "é", 3, None), ("3", "a\n\nb", 4, None), ("4", "x", 5, cs.SURPLUS_FIELDS)]


def test_empty_files_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no data rows"):
        cs.scan_csv(spark, str(tmp_path))
