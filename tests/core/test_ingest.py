import pytest
from pyspark.sql import functions as F

from sensorframe.sources import ingest

LOG = "Instrument 7\nDate: today\n\nTime/sec, E1/V, Temp (C), NH4/NO3\n0, 0.1, 25, 1\nx, 0.2, 25, 1\n2, oops, n/a, 3\n3, 0.4\n4, NaN, 26, 5, 6\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.csv").write_text(LOG)
    (tmp_path / "logs" / "b.txt").write_text("time\tv/mV\n1\t2\n1\t3\n0.5\t4\n")
    (tmp_path / "logs" / "c.dat").write_text("nothing here\n1,2\n")
    return tmp_path


def test_logs(spark, folder):
    readings, issues, failed = ingest.read_logs(spark, str(folder / "logs"))
    got = {(r.file, r.channel, r.row_idx): (r.t_s, r.value, r.unit) for r in readings.collect()}
    assert got[("a.csv", "E1", 4)] == (0.0, 0.1, "V") and got[("a.csv", "Temp", 4)] == (0.0, 25.0, "C") and got[("a.csv", "NH4/NO3", 6)] == (2.0, 3.0, None)
    assert got[("a.csv", "E1", 6)][1] is None and got[("a.csv", "Temp", 7)][1] is None and ("a.csv", "E1", 5) not in got
    assert [got[("b.txt", "v", i)] for i in (1, 2, 3)] == [(1.0, 2.0, "mV"), (1.0, 3.0, "mV"), (0.5, 4.0, "mV")]
    assert sorted(map(tuple, issues.collect())) == [("a.csv", 5, "bad_time"), ("a.csv", 6, "bad_value"), ("a.csv", 7, "ragged_row"), ("a.csv", 8, "ragged_row")]
    assert [r.file for r in failed.collect()] == ["c.dat"]


def test_classes(spark, tmp_path):
    for name, content in (("a.csv", b"1,2"), ("b.txt", b"x\0y"), ("c.json", b"{}"), ("d.bin", b"\0"), ("e.txt", b"\x10\x01")):
        (tmp_path / name).write_bytes(content)
    got = {r.file: r.kind for r in ingest.classify(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "table", "b.txt": "binary", "c.json": "document", "d.bin": "unknown", "e.txt": "table"}


def test_documents(spark, tmp_path):
    lines = ['{"kind":"k","schema_version":2,"payload":{"x":1.5}}', '{"kind":"k","schema_version":1,"payload":{"x":2}}', '{"kind":"other","schema_version":2}', '{"kind":"k","schema_version":9}', "{oops", '{"kind":"k","schema_version":2,"payload":{"x":NaN}}']
    (tmp_path / "d.json").write_text("\n".join(lines))
    good, bad = ingest.read_documents(spark, str(tmp_path / "d.json"), "k", "x double", [1, 2])
    assert sorted(r.x for r in good.collect()) == [1.5, 2.0]
    reasons = sorted(r.reason for r in bad.collect())
    assert len(reasons) == 4 and {"kind", "version", "malformed"} <= set(reasons)


def test_truth_manifest_and_sinks(spark, folder):
    (folder / "t.csv").write_text("Timestamp,Reference\n1,2\nx,3\n")
    truth = ingest.read_truth(spark, str(folder / "t.csv"), {"t_s": ["time", "timestamp"], "truth": ["reference"]})
    assert [tuple(r) for r in truth.collect()] == [(1.0, 2.0), (None, 3.0)]
    readings, _, _ = ingest.read_logs(spark, str(folder / "logs"))
    manifest = spark.createDataFrame([("r1", "a.csv"), ("r2", "b.txt"), ("r2", "zz.csv")], "record string, file string")
    good, gone = ingest.run_manifest(manifest, readings)
    assert {r.record for r in good.collect()} == {"r1"} and [tuple(r) for r in gone.collect()] == [("r2", ["zz.csv"])]
    ingest.write_results(good, str(folder / "out"), ["record", "channel"])
    assert spark.read.parquet(str(folder / "out")).where("record = 'r1'").count() == good.count()


def test_history(spark):
    prior = spark.createDataFrame([("h1", "a", 1, "low"), ("h2", "a", 2, "mid")], "history_id string, k string, at int, level string")
    entries = spark.createDataFrame([("h2", "a", 2, "mid"), ("h3", "a", 3, "high"), ("h4", "a", 4, "low"), ("h9", "b", 1, "low")], prior.schema)
    got = {r.history_id: (r["index"], r.prior_level) for r in ingest.history(entries, prior, ["k"]).collect()}
    assert got == {"h3": (3, "mid"), "h4": (4, "high"), "h9": (1, None)}


def test_bundled_logs_are_read_like_files(spark, folder):
    """Bundles hold a log each in few files; what is read equals what files of their own give."""
    alone = ingest.read_logs(spark, str(folder / "logs"))
    logs = spark.createDataFrame([(p.name, p.read_text()) for p in (folder / "logs").iterdir()] + [("empty.txt", ""), ("gone\x1e.csv".replace("\x1e", ""), "time,a\n1,2\x1e")], "file string, value string")
    ingest.bundle_logs(logs.coalesce(1), str(folder / "bundle"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = [[tuple(r) for r in df.collect()] for df in ingest.read_logs(spark, str(folder / "bundle"), bundled=True)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(list((folder / "bundle").glob("part-*"))) == 1
    extra = ([("gone.csv", "a", 1, 1.0, 2.0, None)], [], [("empty.txt",)])
    for g, a, x in zip(got, alone, extra, strict=True):
        assert sorted(map(str, g)) == sorted(map(str, [*map(tuple, a.collect()), *x]))


def test_the_log_queries_write_no_file_per_sensor(spark, tmp_path, monkeypatch):
    from sensorframe.plans import q_ingest

    monkeypatch.setattr(q_ingest, "fresh_path", lambda s, name: str(tmp_path / name))
    q_ingest.logs(spark, "/root/testdata/sf0.001")
    files = list((tmp_path / "logs").rglob("part-*"))
    assert 0 < len(files) <= 8
