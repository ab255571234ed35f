"""End-to-end ingest of the reference's raw contact table (read only),
checked against the goldens in FIXTURES.md. Skipped when the file is not
present."""

import os

import pytest
from pyspark.sql import functions as F

from respondo.operators import features, profile, rules, segments
from respondo.sources.delimited import read_raw_contacts

REFERENCE_TABLE = os.environ.get("RESPONDO_RAW_TABLE", "")  # a raw table of one's own
pytestmark = pytest.mark.skipif(not os.path.exists(REFERENCE_TABLE),
                                reason="reference table not available")


@pytest.fixture(scope="module")
def bank(spark):
    df = read_raw_contacts(spark, REFERENCE_TABLE)
    return df.withColumn("y", (F.col("y") == "yes").cast("int")).cache()


def test_shape_nulls_and_balance(bank):
    assert bank.count() == 4119 and len(bank.columns) == 21
    nulls = {r.feature: r["count"] for r in profile.null_profile(bank).collect()}
    assert nulls == {"emp_var_rate": 2384, "euribor3m": 422}
    bal = {r.y: r.rows for r in profile.class_balance(bank, "y").collect()}
    assert bal == {1: 451, 0: 3668}


def test_medians(bank):
    med = features.fit_medians(bank, ["emp_var_rate", "euribor3m"])
    assert med == {"emp_var_rate": -1.8, "euribor3m": 4.857}


def test_segment_goldens(bank):
    segs = {
        "long": F.col("duration") >= 300,
        "success": F.col("poutcome") == "success",
        "recent": (F.col("pdays") < 30) & (F.col("pdays") != 999),
        "previous": F.col("previous") > 0,
        "success_long": (F.col("poutcome") == "success") & (F.col("duration") >= 300),
        "student_200": (F.col("job") == "student") & (F.col("duration") >= 200),
        "retired_cell": (F.col("job") == "retired") & (F.col("contact") == "cellular"),
        "uni_prev": (F.col("education") == "university.degree") & (F.col("previous") > 0),
    }
    got = {r.segment: (r.positives, r.rows) for r in segments.conditional_rates(bank, segs).collect()}
    assert got == {"long": (308, 1113), "success": (92, 142), "recent": (100, 160),
                   "previous": (159, 596), "success_long": (44, 52), "student_200": (16, 43),
                   "retired_cell": (34, 122), "uni_prev": (64, 183)}
    rates = {(r.feature, r.value): round(r.rate_pct, 1) for r in
             segments.segment_response_rate(bank, ["job", "contact"]).collect()}
    assert rates[("job", "student")] == 23.2 and rates[("contact", "telephone")] == 5.2


def test_class_stats(bank):
    st = {r.y: r for r in segments.group_stats(bank, "y", ["duration"]).collect()}
    assert round(st[1].mean_duration, 2) == 560.79 and st[1].p75_duration == 761
    mode = {r.y: r.mode_value for r in segments.group_mode(bank, "y", "age").collect()}
    assert mode[1] == 31


def test_auto_approval_rule_counts(bank):
    got = {r.auto_rule: (r["count"], r.pos) for r in rules.auto_approval(bank)
           .groupBy("auto_rule").agg(F.count(F.lit(1)).alias("count"), F.sum("y").alias("pos"))
           .collect()}
    assert got == {0: (3643, 218), 1: (52, 44), 2: (16, 5), 3: (33, 13), 4: (20, 8),
                   5: (301, 145), 6: (2, 1), 7: (46, 15), 8: (6, 2)}
