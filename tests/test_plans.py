import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from runwise import fixtures as fx
from runwise.plans import analyze_runs, run_workload
from runwise.operators import fit_curve, predict_curve, self_join
from runwise.session import s3a_conf, scratch_path, scratch_scope
from runwise.sources import config_record, generate_persons, person_ids, write_config_log, write_event_logs


def test_workload(spark, tmp_path):
    people = generate_persons(person_ids(spark, 500)).cache()
    path = str(tmp_path / "out")
    result = run_workload(people, path)
    written = spark.read.parquet(path)
    assert result.rows.first().rows == 500
    assert len(written.columns) == 23
    assert written.count() == result.joined_rows.first().pairs
    assert written.filter("surname <> another_surname").isEmpty()
    assert written.filter("another_address <> concat(another_street, ',', another_city)").isEmpty()
    assert [r["count"] for r in result.counts.collect()] == [r["count"] for r in result.other_counts.collect()]
    assert set(result.derived.columns) - set(people.columns) == {"fio", "address", "document"}


def test_workload_without_join(spark, tmp_path):
    path = tmp_path / "out"
    result = run_workload(generate_persons(person_ids(spark, 10)), str(path), need_to_join=False)
    assert result.joined_rows is None and not path.exists()


def test_analysis_from_logs_to_probe(spark, sf_dir):
    events, configs = scratch_path(spark, "events"), scratch_path(spark, "configs")
    write_event_logs(fx.log_events(spark, sf_dir), events)
    write_config_log(config_record(fx.config_runs(spark, sf_dir), fx.CONFIG_FIELDS), configs)
    result = analyze_runs(spark, events, configs, scratch_path(spark, "points"))
    assert result.points.count() == 8  # of nine with the peak metric, one has no configuration record
    probe = [r.prediction for r in result.probe.orderBy("rows").collect()]
    assert len(probe) == 5 and probe == sorted(probe)


def test_analysis_of_many_applications(spark, sf_dir, tmp_path, monkeypatch):
    """Files do not grow with the applications, and the points and the curve are those of one folder for each."""
    from runwise.sources import event_logs

    # the applications of the small tables, each with copies of its own
    copies = spark.range(20).withColumnRenamed("id", "copy")
    name = F.concat_ws("-", "application_attempt", "copy")
    events = fx.log_events(spark, sf_dir).crossJoin(copies).withColumn("application_attempt", name).drop("copy")
    runs = fx.config_runs(spark, sf_dir).crossJoin(copies).withColumn("application_attempt", name).withColumn("limit", (F.col("limit") + F.col("copy")).cast("string"))
    configs = scratch_path(spark, "configs")
    write_config_log(config_record(runs, fx.CONFIG_FIELDS), configs)

    def analyzed(folder):
        write_event_logs(events, str(tmp_path / folder))
        result = analyze_runs(spark, str(tmp_path / folder), configs, scratch_path(spark, "points"))
        return [sorted(map(tuple, df.collect())) for df in (result.points, result.probe)], len([*(tmp_path / folder).rglob("*.json.gz")])

    (points, probe), files = analyzed("shared")
    assert files <= 20 and len(points) == 160 and len(probe) == 5
    monkeypatch.setattr(event_logs, "OWN_FOLDERS", 1000)
    same, files = analyzed("own")
    assert files >= 200 and same == [points, probe]


def test_scratch_needs_a_shared_folder():
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077")
    )
    with pytest.raises(ValueError):
        scratch_path(cluster, "x")


def test_analysis_refuses_logs_it_cannot_decode(spark, tmp_path):
    (tmp_path / "app-1.lzf").write_bytes(b"x")
    (tmp_path / "app-2").write_text("{}\n")
    with pytest.raises(ValueError, match="app-1.lzf"):
        analyze_runs(spark, str(tmp_path), str(tmp_path), scratch_path(spark, "points"))


def test_scratch_tables_go_with_their_scope(spark, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    people = generate_persons(person_ids(spark, 300))
    with scratch_scope(spark):
        curve = fit_curve(people.selectExpr("cast(length(name) as double) rows", "cast(length(street) as double) mem"), local_points=2)
        with scratch_scope(spark):
            assert self_join(people, "surname", rows_per_task=100).count() > 300
            inside = set(os.listdir(base))
        between = set(os.listdir(base))
        assert predict_curve(curve, people.selectExpr("length(name) rows")).count() == 300
        assert before < between < inside
        kept = scratch_path(spark, "never_written")
    assert set(os.listdir(base)) == before and not os.path.exists(kept)
    outside = scratch_path(spark, "outside")
    people.write.parquet(outside)
    with scratch_scope(spark):
        pass
    assert spark.read.parquet(outside).count() == 300


def test_s3a_settings():
    conf = s3a_conf("http://store:9000", "a", "b")
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000" and len(conf) == 4
