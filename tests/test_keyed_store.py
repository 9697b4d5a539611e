"""Copy-on-write tables: loads, replays, killed writers and deletion."""
import glob
import os

import pytest
from pyspark.sql import functions as F


from larder.operators.keyed_store import KeyedTable, delete_everywhere
from larder.sources import csv as cs
from larder.streaming import ingest as si

def part():
    return F.concat_ws("/", "org", F.floor(F.col("k") / 10))


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(tuple, df.select("org", "k", "v", "new").collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(o, k, f"{o}{k}", False) for o in ("a", "b c", "") for k in range(40)], "org string, k long, v string, new boolean")
    t.replace(df, part())
    return t


def incoming(spark, items):
    return spark.createDataFrame([(*i, n) for n, i in enumerate(items)], "org string, k long, v string, seq long")


def test_merge_rewrites_only_what_changes(spark, table):
    before = files(table.path)
    assert len(table.manifest()[0]) == 12
    load = incoming(spark, [("a", 3, "x"), ("a", 3, "y"), ("a", 77, "z"), ("b c", 12, None)])
    assert table.merge(load, ["org", "k"], "seq", part(), "new") == ["a/0", "a/7", "b c/1"]
    want = {(o, k): (f"{o}{k}", False) for o in ("a", "b c", "") for k in range(40)} | {("a", 3): ("y", True), ("a", 77): ("z", True), ("b c", 12): (None, True)}
    assert rows(table.read()) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    after = files(table.path)
    assert all(after[f] == m for f, m in before.items())  # nothing is written over
    version = table.version()
    assert table.merge(load, ["org", "k"], "seq", part(), "new") == []  # an equal load rewrites no file
    assert files(table.path) == after and table.version() == version
    table.clean()
    left = files(table.path)
    assert set(left) < set(after) and rows(table.read()) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_a_killed_load_is_not_seen_and_can_be_repeated(spark, table, monkeypatch):
    whole = rows(table.read())
    load = incoming(spark, [("a", 3, "x")])

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            table.merge(load, ["org", "k"], "seq", part(), "new")
    assert rows(table.read()) == whole
    half = f"{table.path}/manifests/version={table.version() + 1}"  # a manifest without a success mark
    os.makedirs(half)
    assert rows(table.read()) == whole
    assert table.merge(load, ["org", "k"], "seq", part(), "new") == ["a/0"]
    assert ("a", 3, "x", True) in rows(table.read()) and len(rows(table.read())) == 120


def test_a_load_mark_makes_a_replay_a_no_op(spark, table):
    load = spark.createDataFrame([("a", 1, "once", True)], "org string, k long, v string, new boolean")
    assert table.replace(load, part(), load="7-0") == ["a/0"]
    assert len(rows(table.read())) == 111
    assert table.replace(load.withColumn("v", F.lit("twice")), part(), load="7-0") == []
    assert ("a", 1, "once", True) in rows(table.read())


def test_drop_removes_folders_and_may_be_repeated(spark, table, tmp_path, monkeypatch):
    other = KeyedTable(spark, str(tmp_path / "other"))
    other.replace(table.read(), part())
    tables = {"child": table, "catalogue": other}
    gone = ["b c/0", "b c/1", "b c/2", "b c/3", "nobody/0"]
    with monkeypatch.context() as m:
        m.setattr(other, "drop", lambda _: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            delete_everywhere(tables, gone)
    assert len(rows(table.read())) == 80 and len(rows(other.read())) == 120  # children first
    assert delete_everywhere(tables, gone) == {"child": [], "catalogue": gone[:4]}
    for t in tables.values():
        assert {r["org"] for r in t.read().collect()} == {"a", ""}
        assert not any("b c" in f or "b%20c" in f for f in files(t.path))
    assert delete_everywhere(tables, gone) == {"child": [], "catalogue": []}


# --- streams

HEADER = ["sku", "wh", "day", "units", "extra"]
TARGETS = {"sku": "product_id", "wh": "warehouse_id", "day": "transaction_date", "units": "units_sold"}
MAPPINGS = [{"source_column": c, "target_field": TARGETS.get(c), "mapping_type": "manual" if c in TARGETS else "ignored",
             "is_confirmed": c in TARGETS, "default_value": None} for c in HEADER]


def run(spark, landing, target, checkpoint):
    products = spark.createDataFrame([(1,), (2,)], "product_id long")
    warehouses = spark.createDataFrame([(5, "W")], "warehouse_id long, warehouse_code string")
    stores = spark.createDataFrame([], "store_id long")
    si.stream_ingest(spark, str(landing), str(target), str(checkpoint), HEADER, MAPPINGS, products, warehouses, stores, max_files_per_trigger=1)


def test_stream_keeps_broken_rows_and_survives_a_kill_before_the_commit(spark, tmp_path, monkeypatch):
    landing, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    landing.mkdir()
    head = ",".join(HEADER) + "\n"
    (landing / "a.csv").write_bytes((head + "1,W,2024-01-01,3,n\n2,W,2024-01-02,4,n,surplus\n9,W,2024-01-03,5,n\n").encode() + b"1,W,2024-01-04,6,\xff\n")
    (landing / "b.csv").write_text(head + "2,W,2024-02-01,7,m\n")

    publish, calls = KeyedTable._publish, []

    def killed_once(self, *args):
        calls.append(1)
        if len(calls) == 2:  # rows of the second epoch are written, its manifest is not
            raise RuntimeError("killed")
        return publish(self, *args)

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", killed_once)
        with pytest.raises(Exception, match="killed"):
            run(spark, landing, target, checkpoint)
    assert si.ingested(spark, str(target)).select("dataset_id").distinct().count() == 1  # one whole epoch, no half one
    run(spark, landing, target, checkpoint)

    def found():
        return sorted((r["transaction_date"].isoformat(), r["units_sold"], r["reject_reason"], r["extras"]) for r in si.ingested(spark, str(target)).collect())

    want = found()
    assert [(d, u) for d, u, _, _ in want] == [("2024-01-01", 3.0), ("2024-01-02", 4.0), ("2024-01-03", 5.0), ("2024-01-04", 6.0), ("2024-02-01", 7.0)]
    assert [r for _, _, r, _ in want][:2] == [None, cs.SURPLUS_FIELDS] and want[3][2] == cs.BAD_ENCODING and want[2][2] is not None
    assert want[0][3] == '{"extra":"n"}'
    assert si.good(si.ingested(spark, str(target))).count() == 2 and si.rejects(si.ingested(spark, str(target))).count() == 3
    run(spark, landing, target, tmp_path / "fresh")  # every file again under another checkpoint
    assert found() == want


def test_stream_skips_an_epoch_that_was_published_before_the_checkpoint(spark, tmp_path, monkeypatch):
    landing, target, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    landing.mkdir()
    (landing / "a.csv").write_text(",".join(HEADER) + "\n1,W,2024-01-01,3,n\n")
    process = si._process

    def killed_after(*args):
        process(*args)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(si, "_process", killed_after)
        with pytest.raises(Exception, match="killed"):
            run(spark, landing, target, checkpoint)
    table = KeyedTable(spark, str(target))
    version = table.version()
    run(spark, landing, target, checkpoint)
    assert table.version() == version and table.read().count() == 1
