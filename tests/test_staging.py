import pytest

from lectern import staging


class FakeContext:
    def __init__(self, master, folder):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class FakeSession:
    """Only what staging_dir asks for; a real session has one master and one folder."""

    def __init__(self, master, setting=None, folder=None):
        self.setting = setting
        self.conf = self
        self.sparkContext = FakeContext(master, folder)

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.setting or default


def test_the_sessions_folder_is_used():
    assert staging.staging_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert staging.staging_dir(FakeSession("yarn", None, "hdfs:///set")) == "hdfs:///set"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.staging_dir(FakeSession("spark://host:7077"))
    session = FakeSession("local[2]")
    folder = staging.staging_dir(session)
    assert folder and staging.staging_dir(session) == folder


def test_a_staged_table_keeps_rows_and_types(spark):
    df = spark.sql("select 1 as a, 'x' as b, array(1, 2) as c, cast(null as string) as d")
    copy = staging.stage(df)
    assert copy.collect() == df.collect()
    assert copy.dtypes == df.dtypes
    assert spark.sparkContext.applicationId in copy.inputFiles()[0]


def test_large_rows_are_held_a_few_at_once(spark):
    from pyarrow import parquet

    copy = staging.stage(spark.range(0, 100, 1, 1), rows_held=8)
    assert sorted(r.id for r in copy.collect()) == list(range(100))
    [file] = copy.inputFiles()
    assert parquet.ParquetFile(file.removeprefix("file://")).num_row_groups == 13
