"""Versioned tables: rewrites beside the old version, conflicts, removal."""

import pytest
from pyspark.sql import functions as F

from quarry.sources.versions import VersionedTable


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_rewrite_and_remove(spark, tmp_path, prefix):
    t = VersionedTable(spark, prefix + str(tmp_path / "a b"))
    with pytest.raises(FileNotFoundError):
        t.read()
    with pytest.raises(FileNotFoundError):
        t.rewrite(lambda df: df)
    assert t.write(spark.range(10)) == 1
    before = t.read()
    assert t.rewrite(lambda df: df.where("id > 3").withColumn("x", F.lit(1))) == 2
    assert before.count() == 10 and t.read().count() == 6  # a reader of the old version is not disturbed
    with pytest.raises(Exception, match="(?i)exist"):
        t.write(spark.range(1), after=1)  # that version was rewritten already
    assert t.read().count() == 6
    assert t.remove_old() == 2  # the first version, and the one whose pointer failed
    assert t.read().count() == 6 and t.remove_old() == 0
    with pytest.raises(ZeroDivisionError):
        t.rewrite(lambda df: 1 / 0)
    assert t.read().columns == ["id", "x"]
