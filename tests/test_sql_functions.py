"""The functions of spark.sql against the column functions and the candidates' rows."""

from pyspark.sql import functions as F

from waymark import queries
from waymark.functions import scalars as s
from waymark.functions import sql
from waymark.operators import candidates

TEXTS = ["  12 main\tst  apt 4 b3h4r2 ", "", None, "#5-10 rue St. John's, Halifax NS", "nova scotia", "N.S.", "B3H 4R2", "44.6", "#12", "ÉCOLE o'brien"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scalars_equal_the_column_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(t, float(i)) for i, t in enumerate(TEXTS)], "x string, d double")
    rows.createOrReplaceTempView("sql_function_rows")
    wanted = {
        "normalize_space(x)": s.normalize_space("x"), "unit_number(x)": s.unit_number("x"), "reference_unit(x)": s.reference_unit("x"), "city_name(x)": s.city_name("x"),
        "province_code(x)": s.province_code("x"), "street(x)": s.street("x"), "canonical_postal(x)": s.postal_code("x"), "base_key(x, x, x, x, x)": s.base_key("x", "x", "x", "x", "x"),
        "full_key(x, x)": s.full_key("x", "x"), "haversine_meters(d, d, 44D, -63D)": s.haversine_meters("d", "d", F.lit(44.0), F.lit(-63.0)), "is_valid_gps(x, '-63.5')": s.is_valid_gps("x", F.lit("-63.5")),
        "is_valid_postal(x)": s.is_valid_postal("x"), "fsa(x)": s.fsa("x"), "risk_tier(d / 10)": s.risk_tier(F.col("d") / 10),
    }
    got = spark.sql("SELECT x, " + ", ".join(f"{call} AS v{i}" for i, call in enumerate(wanted)) + " FROM sql_function_rows")
    assert "Python" not in _plan(got) and "Join" not in _plan(got) and "Exchange" not in _plan(got)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select("x", *[c.alias(f"v{i}") for i, c in enumerate(wanted.values())]).collect()))


def test_lateral_candidates_equal_candidate_rows(spark):
    sql.register(spark)
    raw = queries.derived(spark, "/root/testdata/sf0.001", "raw").select("raw_id", "raw_address_text", "city", "province", "postal_code")
    extra = spark.createDataFrame([(-1 - i, t, c, p, z) for i, (t, c, p, z) in enumerate([(None, None, None, None), ("", "", "", ""), ("12 MAIN ST HALIFAX NS", "halifax", "ns", None), ("5-10 king st b3h 4r2", "x", "ON", "K1A0B1")])], raw.schema)
    raw.union(extra).createOrReplaceTempView("sql_raw")
    got = spark.sql("SELECT r.raw_id, c.* FROM sql_raw r, LATERAL candidates(r.raw_address_text, r.city, r.province, r.postal_code) c")
    p = F.col("parsed")
    want = candidates.candidate_rows(candidates.parsed(spark.table("sql_raw"))).select(
        "raw_id", "rank", "parser_name", "score", p["street_number"], p["street_name"], p["unit_number"], p["city"].alias("parsed_city"), p["province"].alias("parsed_province"), p["postal_code"].alias("parsed_postal"), p["unit_source"]
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.toDF(*got.columns).collect()))
    assert "Python" not in _plan(got)
