import datetime
import glob
import tempfile
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest

from scriptflow import session
from scriptflow.sources import rows, storage
from scriptflow.sources.workspace import DEFAULT_INPUT, Workspace, prepare_input, run_ids


@pytest.fixture
def workspace(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "run"))


def test_read_write_and_record(spark, workspace):
    workspace.write(spark.range(3), "a/b.parquet")
    workspace.write(spark.range(5), "a/b.parquet")
    assert workspace.read("a/b.parquet").count() == 5
    workspace.read("a/b.parquet")
    assert workspace.inputs == ["a/b.parquet"]
    assert workspace.mapping == {"a/b.parquet": f"{workspace.base}/a/b.parquet"}


def test_absolute_paths_are_left_alone(spark, workspace, tmp_path):
    elsewhere = str(tmp_path / "elsewhere")
    workspace.write(spark.range(2), elsewhere)
    assert workspace.read(elsewhere).count() == 2
    assert workspace.inputs == [] and workspace.mapping == {}
    assert workspace.resolve("s3a://bucket/x") == "s3a://bucket/x"


@pytest.mark.parametrize("path", ["../x", "a/../../x", "../run/x"])
def test_leaving_the_base_is_refused(spark, workspace, path):
    with pytest.raises(ValueError, match="leaves the workspace"):
        workspace.write(spark.range(1), path)
    with pytest.raises(ValueError, match="leaves the workspace"):
        workspace.read(path)


def test_overwriting_what_is_read_is_refused(spark, workspace):
    workspace.write(spark.range(3), "t")
    workspace.write(spark.range(3), "t2")
    frame = workspace.read("t")
    for path in ("t", f"{workspace.base}/t", "./t/", "."):
        with pytest.raises(ValueError, match="reads its own target"):
            workspace.write(frame, path)
    workspace.write(frame.filter("id > 1"), "t2")
    assert workspace.read("t").count() == 3
    assert workspace.read("t2").count() == 1


def test_close_removes_the_base_only(spark, tmp_path):
    (tmp_path / "run_other").mkdir()
    with Workspace(spark, str(tmp_path / "run")) as workspace:
        workspace.write(spark.range(1), "t")
    assert [p.name for p in tmp_path.iterdir()] == ["run_other"]


@pytest.mark.parametrize("base", ["relative", "/", "a/b"])
def test_base_must_be_absolute_and_no_root(spark, base):
    with pytest.raises(ValueError, match="base must be absolute"):
        Workspace(spark, base)


def test_fresh_workspaces_differ(spark):
    first, second = Workspace.fresh(spark), Workspace.fresh(spark)
    assert first.base != second.base
    assert first.base.startswith(storage.shared_root(spark))


def test_prepared_input(spark, workspace):
    prepared = prepare_input(workspace, rows.default_input(spark))
    assert prepared.dtypes == [
        ("coluna_a", "bigint"),
        ("coluna_b", "string"),
        ("data_evento", "timestamp_ntz"),
    ]
    assert sorted(map(tuple, prepared.collect())) == [
        (15, "exemplo1", datetime.datetime(2022, 3, 10)),
        (25, "exemplo2", datetime.datetime(2023, 7, 22)),
        (35, "exemplo3", datetime.datetime(2024, 12, 5)),
    ]
    for file in glob.glob(f"{workspace.base}/{DEFAULT_INPUT}/*.parquet"):
        assert pq.read_schema(file).field("data_evento").type.unit == "us"


def test_run_ids_repeat(spark):
    df = spark.range(100)
    first = run_ids(df, "id").collect()
    assert sorted(first) == sorted(run_ids(df.repartition(7), "id").collect())
    assert all(len(r.run_id) == 32 and r.base_name == f"run_{r.run_id}" for r in first)


def test_run_ids_do_not_meet(spark):
    ids = run_ids(spark.read.parquet("/root/testdata/sf0.1/orders.parquet"), "o_orderkey")
    assert ids.select("run_id").distinct().count() == ids.count()


def test_shared_root_is_the_named_one():
    def session_with(master, **conf):
        return SimpleNamespace(
            conf=conf, sparkContext=SimpleNamespace(master=master)
        )

    named = {"spark.checkpoint.dir": "hdfs://n/shared/"}
    for master in ("yarn", "local[2]"):
        assert storage.shared_root(session_with(master, **named)) == "hdfs://n/shared"
    assert storage.shared_root(session_with("local[2]")).startswith(tempfile.gettempdir())
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_root(session_with("yarn"))


def test_staged_tables_lie_in_the_scratch_folder(spark):
    staged = storage.stage(spark.range(3).filter("id > 5"), "t")
    assert staged.count() == 0 and staged.dtypes == [("id", "bigint")]
    assert storage.exists(spark, storage.scratch_dir(spark))


def test_session_defaults(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_a_job_stops_its_session(monkeypatch):
    stopped = []
    built = SimpleNamespace(stop=lambda: stopped.append(True))
    monkeypatch.setattr(session, "build", lambda name, **conf: built)
    with session.job("a") as spark:
        assert spark is built and not stopped
    with pytest.raises(ZeroDivisionError), session.job("b"):
        1 / 0
    assert len(stopped) == 2


def test_s3a_conf():
    version = "3.4.2"
    plain = session.s3a_conf(version)
    assert plain == {
        "spark.jars.packages": "org.apache.hadoop:hadoop-aws:3.4.2",
        "spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem",
    }
    keyed = session.s3a_conf(version, "id", "secret", "us-east-1")
    assert keyed["spark.hadoop.fs.s3a.access.key"] == "id"
    assert keyed["spark.hadoop.fs.s3a.secret.key"] == "secret"
    assert keyed["spark.hadoop.fs.s3a.endpoint"] == "s3.us-east-1.amazonaws.com"
    with pytest.raises(ValueError, match="both keys"):
        session.s3a_conf(version, access_key="id")
