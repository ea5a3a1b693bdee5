import pytest

from depotlens import session


def test_written_tables_cut_lineage_and_can_be_dropped(spark):
    w = session.Workspace(spark)
    df, path = w.write(spark.range(10).selectExpr("id", "cast(null as string) as empty"), "t")
    assert df.columns == ["id", "empty"] and df.count() == 10 and session.exists(spark, path)
    assert "Range" not in df._jdf.queryExecution().toString()
    w.drop(path)
    assert not session.exists(spark, path)
    w.close()
    assert not session.exists(spark, w.root)


class Named:
    """A session of a cluster: only what shared_dir asks for."""

    def __init__(self, folder, master):
        self.conf = self.sparkContext = self
        self.folder, self.master = folder, master

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_the_shared_folder_is_the_cluster_s(spark):
    assert session.shared_dir(Named("hdfs:///shared/", "spark://host")) == "hdfs:///shared"
    with pytest.raises(ValueError):
        session.shared_dir(Named(None, "spark://host"))
    assert session.shared_dir(Named(None, "local[2]")).startswith("file:///")


def test_only_narrow_scans_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores + 3)
    assert session.spread(wide) is wide
