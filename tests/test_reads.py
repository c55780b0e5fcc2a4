"""How often queries read their table, by the input records of all their stages."""

import pytest

from cyclewise.plans import catalog

SF = "/root/testdata/sf0.01"


def read_records(spark, job):
    """Rows that all stages of a job have read from files."""
    store = lambda: {(s.stageId(), s.attemptId()): s.inputRecords() for s in stages()}
    jvm = spark.sparkContext._jvm
    empty = jvm.java.util.ArrayList()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    status = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = status.stageList(empty, False, False, none, empty)
        return [found.apply(i) for i in range(found.length())]

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store()
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for key, n in store().items() if key not in before)


# Beyond the table itself, queries read the small tables that they have written: of units, of parts of a sensor.
@pytest.mark.parametrize(
    "name, table, more",
    [
        ("drift_ks", "events", 8_192),
        ("drift_summary", "events", 8_192),
        ("retain_last_n", "events", 0),
        ("scale_batch", "lineitem", 2_000),
        ("attach_test_rul", "lineitem", 2_000),
        ("per_condition_scale", "lineitem", 4_000),
        ("engine_status", "events", 60_000),
    ],
)
def test_two_reads(spark, name, table, more):
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    told = read_records(spark, lambda: catalog.queries()[name](spark, SF).write.format("noop").mode("overwrite").save())
    assert rows < told <= 2 * rows + more


def test_clusters_are_fitted_on_settings(spark):
    """The rows are read twice; the rounds of the fit read the different settings of each unit."""
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    settings = rows.select("l_suppkey", "l_returnflag", "l_tax").distinct().count()
    told = read_records(spark, lambda: catalog.queries()["cluster_scale"](spark, SF).write.format("noop").mode("overwrite").save())
    assert told <= 2 * rows.count() + 40 * settings
