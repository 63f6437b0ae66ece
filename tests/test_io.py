"""Readers and writers not covered by the job tests."""

import pytest
from pyspark.sql import functions as F

from shipwatch.session import ensure_checkpoint_dir, shared_path
from shipwatch.sources import io


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.sparkContext.getCheckpointDir()
    assert configured and ensure_checkpoint_dir(spark) == configured
    assert shared_path(spark, "x/y").startswith(configured.rstrip("/") + "/")


def test_csv_round_trip_with_declared_schema(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id bigint, name string, v double")
    path = io.export_csv(df, str(tmp_path / "t_csv"))
    back = io.read_curated(spark, path, fmt="csv", schema=df.schema, required=["id", "v"], what="t")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == [(1, "a", 2.5), (2, "b", None)]
    with pytest.raises(ValueError, match="missing required"):
        io.read_curated(spark, path, fmt="csv", schema=df.schema, required=["nope"], what="t")


def test_json_report_round_trip(spark, tmp_path):
    rep = spark.range(1).select(F.lit(3).alias("n"), F.array(F.lit("a"), F.lit("b")).alias("xs"),
                                F.create_map(F.lit("k"), F.lit(0.5)).alias("m"))
    path = str(tmp_path / "r")
    assert io.write_json_report(rep, path) == {"n": 3, "xs": ["a", "b"], "m": {"k": 0.5}}
    back = io.read_json_report(spark, path).first()
    assert back["n"] == 3 and list(back["xs"]) == ["a", "b"] and back["m"]["k"] == 0.5
    with pytest.raises(ValueError):
        io.write_json_report(spark.range(2), str(tmp_path / "r2"))


def test_partitioned_write_clusters_rows(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("p"), F.col("id"))
    path = io.write_table(df.repartition(8), str(tmp_path / "pt"), partition_by=["p"], cluster_by=["id"])
    back = spark.read.parquet(path)
    assert back.count() == 1000
    assert back.filter("p = '1'").count() == len([i for i in range(1000) if i % 3 == 1])


def test_raw_csv_reads_missing_tokens(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_bytes("Id,Na me,v\n1,NA,nan\n2,caf\xe9,N/A\n3,NULL,\n4,nano,0\n".encode("latin-1"))
    got = [tuple(r) for r in io.read_raw_csv(spark, str(folder)).collect()]
    assert got == [("1", None, None), ("2", "caf\xe9", None), ("3", None, None), ("4", "nano", "0")]


def test_filtered_orders_are_exported(spark, tmp_path):
    from shipwatch.operators import filters
    from shipwatch.plans import catalog
    from tests.conftest import SF_SMALL
    lines = catalog.lines(spark, SF_SMALL)
    chosen = filters.apply_filters(lines, markets=["ASIA"], shipping_modes=["Same Day"])
    back = io.read_curated(spark, io.export_csv(chosen, str(tmp_path / "export")), "csv", lines.schema, what="export")
    assert back.count() == chosen.count() > 0
    assert back.agg(F.min("market"), F.max("market"), F.sum("quantity")).first() == chosen.agg(
        F.min("market"), F.max("market"), F.sum("quantity")).first()


def test_damaged_lines_are_set_aside(spark, tmp_path):
    path = tmp_path / "export.csv"
    lines = ['a,b,c', '1,"x, y",\u00e9', '2,only', '3,"p, q",r,s', '4,,nan', '5,u,v,w,x', '6,"say ""hi"", you",z']
    path.write_bytes("\n".join(lines).encode("latin-1"))
    good, bad = io.read_raw_csv_checked(spark, str(path))
    assert sorted(map(tuple, good.where("a <> '6'").collect())) == [("1", "x, y", "\u00e9"), ("4", None, None)]
    assert {(r.line, r.fields, r.expected, r.reason) for r in bad.collect() if not r.line.startswith("6")} == {
        ("2,only", 2, 3, "too few fields"), ('3,"p, q",r,s', 4, 3, "too many fields"), ("5,u,v,w,x", 5, 3, "too many fields")}
    # what is selected does not change what is damaged
    assert good.select("a").where("a <> '6'").count() == 2 and good.count() + bad.count() == 6
    with pytest.raises(FileNotFoundError):
        io.read_raw_csv_checked(spark, str(tmp_path / "none"))


def test_marks_and_store(spark, tmp_path):
    from shipwatch.sources.committed import Marks, Store
    marks = Marks(spark, str(tmp_path / "m"))
    assert marks.names() == [] and marks.read("one") is None
    marks.write("one", {"rows": 3, "text": "\u00e9"})
    marks.write("one", {"rows": 4, "text": "\u00e9"})
    assert marks.names() == ["one"] and marks.read("one") == {"rows": 4, "text": "\u00e9"}
    store, built = Store(spark, str(tmp_path / "s")), []

    def build(at):
        spark.range(3).write.parquet(at)
        built.append(at)
        if len(built) == 1:
            raise RuntimeError("broken after it wrote")

    with pytest.raises(RuntimeError):
        store.get("k", build)
    assert store.find("k") is None
    assert store.get("k", build) == store.get("k", build) == built[1] and len(built) == 2
