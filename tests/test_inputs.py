"""Input tables of short rows are dealt to enough tasks."""

from pyspark.sql import functions as F

from fieldsift.queries import inputs


def _table(spark, folder, name, rows, files=1):
    rows.coalesce(files).write.parquet(f"{folder}/{name}.parquet")


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    part = spark.range(500).select(
        F.col("id").alias("p_partkey"),
        F.lit("steel").alias("p_name"),
        F.lit("Brand#1").alias("p_brand"),
        F.lit("TIN").alias("p_type"),
        (F.col("id") % 50).cast("int").alias("p_size"),
    )
    _table(spark, tmp_path, "part", part.union(part.where("p_partkey < 3")))
    people = spark.range(40).select(F.col("id").alias("key"), F.lit("who").alias("name"))
    _table(spark, tmp_path, "supplier", people.toDF("s_suppkey", "s_name"))
    _table(spark, tmp_path, "customer", people.toDF("c_custkey", "c_name"))
    cores = spark.sparkContext.defaultParallelism
    for made, rows in (
        (inputs.sheets(spark, tmp_path), 503),
        (inputs.material_files(spark, tmp_path), 503),
        (inputs.context_files(spark, tmp_path), 81),
    ):
        assert made.rdd.getNumPartitions() >= inputs.TASKS_A_CORE * cores
        assert made.count() == rows
        used = made.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used >= cores


def test_a_table_of_many_splits_stays_where_it_is(spark, tmp_path):
    rows = spark.range(100, numPartitions=inputs.TASKS_A_CORE * 8)
    assert inputs.spread_widely(rows) is rows
