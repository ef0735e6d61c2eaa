"""Risk scores, severities and category maps, as tables of input and expected output."""

from pyspark.sql import functions as F

from codequarry.functions import fixed_values as fv
from codequarry.functions import scoring
from codequarry.functions.text import lookup
from codequarry.operators import risk

TYPES = (*fv.RULE_DELTAS, "A_RULE_OF_NO_TABLE")
CATEGORIES = (*fv.CATEGORY_DELTAS, "STYLE")


def plain(type_, category, confidence, complexity):
    """The score in plain Python, and Python's own rounding of it."""
    base = 0.5 + fv.RULE_DELTAS.get(type_, 0.0) + fv.CATEGORY_DELTAS.get(category, 0.0)
    boost = next((v for limit, v in fv.COMPLEXITY_BOOSTS if complexity is not None and complexity >= limit), 0.0)
    raw = max(fv.SCORE_FLOOR, min(fv.SCORE_CEILING, base * confidence + (1.0 - confidence) * 0.5 + boost))
    band = next((name for limit, name in fv.SEVERITY_BANDS if raw >= limit), fv.LOWEST_SEVERITY)
    return raw, round(raw, 3), band


def test_scores_on_the_whole_grid(spark):
    grid = [(t, c, k / 40, cc) for t in TYPES for c in CATEGORIES for k in range(41) for cc in (None, 4.9, 5.0, 10.0)]
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(grid)], "i INT, type STRING, category STRING, confidence DOUBLE, cc DOUBLE")
    out = {r.i: (r.risk_raw, r.risk_score, r.severity) for r in risk.scored(df, F.col("cc")).collect()}
    assert all(out[i] == plain(*g) for i, g in enumerate(grid))


def test_rounding_is_that_of_the_exact_value(spark):
    values = [k / 2000 for k in range(2001)] + [k / 1000 for k in range(1001)]
    got = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select("x", scoring.rounded(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x, 3) for r in got)


def test_clamps(spark):
    df = spark.range(1).select(
        scoring.risk_raw(F.lit("SELF_COMPARISON"), F.lit("SECURITY"), F.lit(1.4), F.lit(50.0))
        .alias("high"),
        scoring.risk_raw(F.lit("UNUSED_VARIABLE"), F.lit("CODE_SMELL"), F.lit(4.0), F.lit(0.0))
        .alias("low"))
    row = df.first()
    assert (row.high, row.low) == (0.98, 0.05)


def test_bands_use_the_unrounded_score(spark):
    row = spark.range(1).select(scoring.severity(F.lit(0.7999)).alias("s"),
                                scoring.rounded(F.lit(0.7999)).alias("r")).first()
    assert (row.s, row.r) == ("high", 0.8)


def test_unlisted_eslint_rules_are_about_correctness(spark):
    rules = [*fv.ESLINT_CATEGORY, "a-rule-of-no-table"]
    df = spark.createDataFrame([(r,) for r in rules], "rule STRING")
    got = {r.rule: r.got for r in df.select("rule", lookup(F.col("rule"), fv.ESLINT_CATEGORY, "CORRECTNESS").alias("got")).collect()}
    assert got == {r: fv.ESLINT_CATEGORY.get(r, "CORRECTNESS") for r in rules}


def test_file_complexity_of_duplicate_paths_is_the_last_one(spark):
    stats = spark.createDataFrame([(1, "a", 3.0, 1), (1, "a", 11.0, 2), (1, "b", 1.0, 1)],
                                  "run_id INT, path STRING, complexity DOUBLE, ord INT")
    got = {r.path: r.complexity for r in risk.latest_stats(stats).collect()}
    assert got == {"a": 11.0, "b": 1.0}


def test_bucketed_tables_join_without_a_shuffle(spark):
    found = spark.range(4000).selectExpr(
        "id", "id % 7 AS run_id", "if(id % 3 = 0, 'hot.py', concat('f', id % 50, '.py')) AS file", "'EVAL' AS type", "'SECURITY' AS category",
        "0.5D AS confidence").unionByName(spark.sql(
            "SELECT -1L AS id, CAST(NULL AS BIGINT) AS run_id, CAST(NULL AS STRING) AS file, 'EVAL' AS type, 'SECURITY' AS category, 0.5D AS confidence"))
    stats = spark.range(350).selectExpr("id % 7 AS run_id", "concat('f', id DIV 7, '.py') AS path", "CAST(id % 13 AS DOUBLE) AS complexity")
    plain = {r.id: (r.risk_raw, r.severity) for r in risk.score(found, stats).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = risk.score(*risk.store(found, stats, "bucketed_test", 4))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {r.id: (r.risk_raw, r.severity) for r in out.collect()} == plain and len(plain) == 4001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
