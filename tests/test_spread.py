"""Rows are dealt to all tasks, however the file holds them."""

from pyspark.sql import functions as F

from turnwise.session import spread


def test_one_row_group_is_dealt_to_every_task(spark, tmp_path):
    spark.range(40_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        table = spark.read.parquet(f"{tmp_path}/t")
        assert table.rdd.getNumPartitions() >= 4
        sizes = [r.n for r in spread(table).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(sizes) >= 4 and sum(sizes) == 40_000 and max(sizes) < 40_000 / 4
