"""Placed cohorts: instances that know their study's facts, so that nothing wide is shuffled."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlake.operators import audit, identity, remediate
from cohortlake.plans import cohort as model
from cohortlake.plans import queries

FOLDER = os.environ.get("COHORT_TABLES", "/root/testdata/sf0.001")
KEY = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def shuffled(spark, df):
    """Bytes that the stages of a run wrote for others."""
    sc = spark.sparkContext
    sc.setJobGroup("shuffled", "")
    df.write.format("noop").mode("overwrite").save()
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("shuffled")]
    sc._jsc.clearJobGroup()
    stages = {s for j in jobs for s in j.stageIds}
    found = store.stageList(None, False, False, none, None)
    return sum(x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size())) if x.stageId() in stages)


def lines(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with lines of no machine and no order, an order of no customer, an undated one, and a machine listed twice."""
    folder = str(tmp_path_factory.mktemp("odd"))
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    few = read("lineitem").filter("l_orderkey < 60")
    lost = few.filter("l_linenumber = 1").withColumn("l_suppkey", F.lit(-5).cast("bigint"))
    stray = few.filter("l_linenumber = 2").withColumn("l_orderkey", F.lit(-7).cast("bigint"))
    nameless = few.filter("l_linenumber = 3").withColumn("l_suppkey", F.lit(None).cast("bigint"))
    orders = read("orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")).cast("bigint"))
    orders = orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    tables = {"lineitem": few.unionByName(lost).unionByName(stray).unionByName(nameless), "orders": orders, "supplier": read("supplier").unionByName(read("supplier").limit(3))}
    for t in ("lineitem", "orders", "supplier", "customer", "nation", "region"):
        tables.get(t, read(t)).write.parquet(f"{folder}/{t}.parquet")
    return folder


def rows(df):
    return sorted(map(repr, df.collect()))


def test_locked_as_unplaced(spark, odd):
    def told(whole):
        return rows(identity.recover(remediate.apply_policy(identity.lock(whole, KEY), queries.POLICY), KEY).select("patient_id", F.array_sort(F.map_entries("original"))))

    placed = model.placed_tables(spark, odd, by_patient=True)
    assert placed.placed and told(placed) == told(model.from_tables(spark, odd)) != []


def test_policy_as_unplaced(spark, odd):
    tags = lambda whole: whole.instances.select("sop_instance_uid", F.array_sort(F.map_entries("attributes")))
    placed, plain = (remediate.apply_policy(x, queries.POLICY) for x in (model.placed_tables(spark, odd), model.from_tables(spark, odd)))
    assert not set(rows(tags(placed).distinct())) - set(rows(tags(plain)))
    told = placed.instances.select("of_study", "of_patient", "of_date", "of_shifted").distinct()
    assert not set(rows(told)) - set(rows(placed.studies.select("study_instance_uid", "patient_id", "study_date", "date_shifted").toDF(*told.columns)))


def test_restored_as_locked(spark, odd):
    placed = model.placed_tables(spark, odd, by_patient=True)
    back = identity.restore(remediate.apply_policy(identity.lock(placed, KEY), queries.POLICY), KEY)
    ids = lambda whole: whole.instances.select("sop_instance_uid", "of_patient")
    assert rows(ids(back).distinct()) == rows(ids(placed).distinct())


def test_locked_shuffles_little(spark):
    """Neither tokens nor attributes of instances are shuffled."""
    assert shuffled(spark, queries.queries()["locked_identities"](spark, FOLDER)) < 100 * lines(spark)


def test_own_findings_as_all(spark, odd):
    """Findings that stay in their rows change what those listed one by one change."""
    placed = model.placed_tables(spark, odd)
    own, all_of = remediate.remediate_own(placed, queries.POLICY), remediate.remediate(placed, audit.audit(placed, queries.POLICY), queries.POLICY)
    told = lambda whole: rows(whole.instances.select("sop_instance_uid", "of_study", "of_patient", "of_date", "of_shifted", F.array_sort(F.map_entries("attributes"))).distinct())
    assert told(own) == told(all_of) != told(placed)
    assert rows(own.studies) == rows(all_of.studies) and rows(own.patients) == rows(all_of.patients)


def test_audit_shuffles_little(spark):
    """No finding of an instance's attributes is shuffled."""
    assert shuffled(spark, queries.queries()["audit_after_remediate"](spark, FOLDER)) < 100 * lines(spark)
