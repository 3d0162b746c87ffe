"""Narrow tables whose rows become texts are dealt over tasks by their number of rows, whatever their files."""

import pytest

from tessera.sources import tables as T


@pytest.mark.parametrize("name", ["pyfiles", "sources", "known"])
def test_texts_of_one_small_file_are_many_tasks_work(spark, tmp_path, name):
    part = spark.range(3 * T.TASK_ROWS).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "cast(id % 50 as int) as p_size", "1.0D as p_retailprice")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    rows = T.view(spark, str(tmp_path), name)
    sizes = [n for n in rows.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n]
    assert len(sizes) >= 3 and max(sizes) < 1.2 * T.TASK_ROWS
    assert sum(sizes) == 3 * T.TASK_ROWS * (4 if name == "known" else 1)
