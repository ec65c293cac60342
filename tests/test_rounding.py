from pyspark.sql import functions as F

from lexloom.functions.text import round_even


def test_named_columns_round_like_written_digits(spark):
    values = [0.5, 0.00005, 0.00015, 0.12345, 2.5, -0.00001, -1.00005, 0.74995, 123456.78905, 1e9 + 0.12345, 1e300, float("nan"), None]
    values += [k / 7 for k in range(-50, 50)] + [k / 20000 for k in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    got = rows.select(F.struct(round_even("x", 4)).cast("string").alias("a"), F.struct(round_even(F.col("x"), 4)).cast("string").alias("b"))
    assert all(r.a == r.b for r in got.collect())


def test_named_columns_are_not_written_out(spark):
    plan = spark.range(5).select((F.col("id") / 7).alias("x")).select(round_even("x", 4).alias("r"))
    assert "rint(" in plan._jdf.queryExecution().optimizedPlan().toString().lower()
