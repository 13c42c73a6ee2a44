import uuid

import pytest
from pyspark.sql import functions as F

from thermotrack.sources import tables
from thermotrack.sources.tables import drop_table, index_table_name, read_table, replace_table


def test_replace_and_drop(spark, tmp_path):
    first = spark.range(3)
    path = str(tmp_path / "t")
    assert replace_table(first, path).count() == 3
    assert replace_table(spark.range(5), path).count() == 5
    replace_table(first, "small_table")
    assert read_table(spark, "small_table").count() == 3
    drop_table(spark, "small_table")
    assert not spark.catalog.tableExists("small_table")


@pytest.mark.parametrize("kind", ["table", "folder"])
def test_replaced_by_its_own_rows(spark, tmp_path, kind):
    name = f"own_rows_{uuid.uuid4().hex}" if kind == "table" else str(tmp_path / "own")
    replace_table(spark.range(10), name)
    bigger = read_table(spark, name).select((F.col("id") + 100).alias("id"))
    assert replace_table(bigger.union(read_table(spark, name)), name).count() == 20
    broken = read_table(spark, name).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        replace_table(broken, name)
    assert read_table(spark, name).agg(F.sum("id")).first()[0] == 2 * 45 + 1000
    if kind == "table":
        assert [t.name for t in spark.catalog.listTables() if name in t.name] == [name]
        drop_table(spark, name)
    else:
        assert [p.name for p in tmp_path.iterdir()] == ["own"]


def test_old_rows_come_back_when_the_name_can_not_be_taken(spark, tmp_path, monkeypatch):
    name = str(tmp_path / "kept")
    replace_table(spark.range(3), name)
    whole = tables._Folders.rename

    def fails(self, old, new):
        if "__staged_" in old:
            raise OSError("lost")
        whole(self, old, new)

    monkeypatch.setattr(tables._Folders, "rename", fails)
    with pytest.raises(OSError, match="lost"):
        replace_table(spark.range(5), name)
    assert read_table(spark, name).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["kept"]


def test_default_names():
    assert index_table_name("a.b") == "a.b_ibm"
    assert index_table_name(None) == "ibm_result"
