from quernel.llm import common


def test_small_batches_leave_the_session_alone(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.range(0, 5000, 1, 1).selectExpr("id", "cast(id AS string) AS text")
    sizes = lambda batches: (b.slice(0, 1) for b in batches)
    small = common.in_small_batches(df)
    assert small.mapInArrow(sizes, small.schema).count() == 5 and df.mapInArrow(sizes, df.schema).count() == 1
    assert spark.conf.get(name) == before == "10000" and common.in_small_batches(small) is small
    assert small.join(df, "id").count() == df.join(small, "id").count() == 5000
    assert common.stored(small, "small").count() == 5000
