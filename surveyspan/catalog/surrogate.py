"""A survey derived from the trade tables, so that every operator has data to work on.

Line items play households (and children), suppliers play survey clusters with
their geography and polygons, nations and regions play labels, and orders play
monthly case reports. All values are computed from keys, so they are the same on
every run and in any engine, and every table grows with its source. A PSU is a
tenth of a cluster (about 60 line items at every scale) and lies in one stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspan.operators.design import SurveyDesign
from surveyspan.plans.child import child_table
from surveyspan.plans.geography import cluster_geography
from surveyspan.plans.households import HouseholdRules, household_table
from surveyspan.plans.sanitation import TOILET_TYPES, sanitation_indicators
from surveyspan.plans.water import WATER_TYPES, water_indicators
from surveyspan.sources.codebook import Variable, attach_codebook

DESIGN = SurveyDesign(lonely_psu="adjust")
TOILET_CODES = [*TOILET_TYPES.values(), 99]
WATER_CODES = [*WATER_TYPES.values(), 99]

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; the stated schema spares a job that would infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(codes: list[int], index: str) -> str:
    return f"element_at(array({', '.join(map(str, codes))}), CAST({index} AS INT) + 1)"


URBAN_CODE = "CASE WHEN l_suppkey % 11 = 0 THEN 9 WHEN l_suppkey % 2 = 0 THEN 1 ELSE 2 END"
PSU = "l_suppkey * 10 + l_orderkey % 10"
WEIGHT = "CAST(round(l_quantity) AS BIGINT) * 1000000"
WEALTH = "CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 - 4000000000"


def raw_households(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS hhid",
        "l_suppkey AS hv001",
        "l_linenumber AS hv002",
        f"{WEIGHT} AS hv005",
        f"{PSU} AS hv021",
        "CAST(l_suppkey % 8 AS INT) AS hv022",
        "CAST(l_suppkey % 6 AS INT) AS shlocnew3",
        f"{URBAN_CODE} AS hv025",
        "CAST(l_suppkey % 25 AS INT) AS shregnew",
        "month(l_shipdate) AS hv006",
        f"{_pick(WATER_CODES, 'l_partkey % 23')} AS hv201",
        "CASE WHEN l_linenumber = 7 THEN if(l_partkey % 2 = 0, 998, 999) WHEN l_linenumber = 6 THEN 996 "
        "WHEN l_linenumber = 5 AND l_partkey % 10 = 0 THEN NULL ELSE CAST(round(l_quantity) AS INT) END AS hv204",
        f"{_pick(TOILET_CODES, '(l_partkey + l_linenumber) % 19')} AS hv205",
        "if(l_linenumber % 3 = 2, 9, l_linenumber % 3) AS hv225",
        "CASE l_orderkey % 13 WHEN 0 THEN 95 WHEN 1 THEN 98 WHEN 2 THEN 99 ELSE CAST(l_orderkey % 13 AS INT) END AS hv238",
        f"{WEALTH} AS hv271",
    )
    return attach_codebook(
        raw,
        [
            Variable("hv201", "source of drinking water", WATER_TYPES),
            Variable("hv205", "type of toilet facility", TOILET_TYPES),
            Variable("hv025", "type of place of residence", {"urban": 1, "rural": 2}),
        ],
    )


def raw_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber) AS caseid",
        "l_suppkey AS v001",
        "l_linenumber AS v002",
        f"{WEIGHT} AS v005",
        f"{PSU} AS v021",
        "CAST(l_suppkey % 8 AS INT) AS v022",
        f"{URBAN_CODE} AS v025",
        "CAST(l_suppkey % 25 AS INT) AS sregnew",
        "month(l_shipdate) AS v006",
        f"{WEALTH} AS v191",
        "CAST(l_partkey % 60 AS INT) AS hw1",
        "CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 7 AS INT) END AS b8",
        "if(l_orderkey % 5 = 0, 9, CAST(1 + l_orderkey % 2 AS INT)) AS b4",
        "CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber = 4 THEN 1 WHEN l_linenumber = 5 THEN 2 "
        "WHEN l_linenumber = 6 THEN 8 END AS h11",
        "if(l_tax = 0.08D, 9998, CAST(l_partkey * 37 % 1000 AS INT) - 600) AS hw70",
        "CASE WHEN l_orderkey % 9 = 0 THEN 1 WHEN l_orderkey % 31 <> 0 THEN 0 END AS hw13",
    )


def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS code",
        "CASE n_nationkey WHEN 0 THEN 'aire metropolitaine' WHEN 1 THEN \"grand'anse\" WHEN 2 THEN 'reste-ouest' "
        "ELSE lower(n_name) END AS label",
    )


def dhs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr("r_regionkey AS code", "lower(r_name) AS label")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")
    )
    return table(spark, sf_dir, "supplier").join(nations, F.expr("s_nationkey = n_nationkey"))


def _shared_geo_columns(cluster: str) -> list[str]:
    return [
        f"{cluster} AS DHSCLUST",
        "2012 AS DHSYEAR",
        f"concat('HT', {cluster}) AS DHSID",
        "CASE WHEN s_suppkey % 11 = 0 THEN 'X' WHEN s_suppkey % 2 = 0 THEN 'U' ELSE 'R' END AS URBAN_RURA",
        "if(s_suppkey % 10 = 0, 0D, 17.5D + (s_suppkey % 280) / 100D) AS LATNUM",
        "if(s_suppkey % 10 = 0, 0D, -74.5D + (s_suppkey % 330) / 100D) AS LONGNUM",
        "r_name AS ADM1NAME",
    ]


def geo_admin2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).selectExpr(
        *_shared_geo_columns("s_suppkey"), "n_name AS NAME_2", "n_nationkey AS ID_2"
    )


def geo_admin3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some clusters of this source are unknown to the other one."""
    return suppliers(spark, sf_dir).selectExpr(
        *_shared_geo_columns("if(s_suppkey % 20 = 7, s_suppkey + 1000000000, s_suppkey)"),
        "concat('HT', r_regionkey) AS A1_PCode",
        "CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS A2_Name",
        "concat('HT', s_suppkey) AS A2_PCode",
    )


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_geography(geo_admin2(spark, sf_dir), geo_admin3(spark, sf_dir))


def households(
    spark: SparkSession, sf_dir: str, rules: HouseholdRules | None = None, geo: bool = False, raw: DataFrame | None = None
) -> DataFrame:
    """Households; with ``geo`` each row also carries its cluster's geography. ``raw`` replaces the derived microdata."""
    return household_table(
        raw_households(spark, sf_dir) if raw is None else raw,
        region_labels(spark, sf_dir),
        dhs_labels(spark, sf_dir),
        geography(spark, sf_dir) if geo else None,
        rules,
    )


def indicators(spark: SparkSession, sf_dir: str, geo: bool = False) -> DataFrame:
    return water_indicators(sanitation_indicators(households(spark, sf_dir, geo=geo)))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return child_table(raw_children(spark, sf_dir), region_labels(spark, sf_dir))


def commune_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square per supplier, every third one with a smaller second piece."""

    def square(left: str, low: str, width: str) -> str:
        corners = [(left, low), (left, f"{low} + {width}"), (f"{left} + {width}", f"{low} + {width}"),
                   (f"{left} + {width}", low), (left, low)]
        return "array(" + ", ".join(f"struct({a} AS x, {b} AS y)" for a, b in corners) + ")"

    main, islet = square("x0", "y0", "side"), square("x0 + 2D", "y0", "side / 4D")
    placed = suppliers(spark, sf_dir).selectExpr(
        "*",
        "-74.5D + (s_suppkey % 330) / 100D AS x0",
        "17.5D + (s_suppkey % 280) / 100D AS y0",
        "(s_suppkey % 5 + 1) / 100D AS side",
    )
    return placed.selectExpr(
        "s_suppkey AS id",
        "r_name AS A1_Name",
        "if(n_nationkey = 3, \"L'Artibonite\", r_name) AS NAME_1",
        "n_name AS NAME_2",
        "concat(' ', s_name, '  ') AS A2_Name",
        "CASE n_nationkey WHEN 0 THEN 'Aire Métropolitaine' WHEN 1 THEN 'Grande-Anse' WHEN 2 THEN 'Reste-Ouest' "
        "ELSE initcap(n_name) END AS DHSREGFR",
        f"if(s_suppkey % 3 = 0, array({main}, {islet}), array({main})) AS rings",
    )


def priority_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).selectExpr(
        "s_name AS communes",
        "if(s_suppkey % 7 = 0, concat(s_name, ' Nord'), concat('  ', s_name)) AS commune",
        "concat(r_name, ' ') AS `Departement `",
        "CASE s_suppkey % 3 WHEN 0 THEN 'Phase 1' WHEN 1 THEN 'Phase 2' END AS Priority",
        "substring('ABCD', CAST(s_suppkey % 4 + 1 AS INT), 1) AS `Cholera Response (Mid-term Plan)`",
    )


def monthly_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case reports per nation and month; one nation reports no counts at all."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counted = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("Month"))
        .agg(F.count("*").alias("all"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("dead"))
    )
    silent = F.col("n_nationkey") == 4
    return counted.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("Departement"),
        "Month",
        F.when(~silent, F.col("all")).alias("Cases"),
        F.when(~silent, F.col("dead")).alias("Deaths"),
    )


POPULATION_FIXES = {"NATION 0": "NATION_0"}


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People per nation; one name is spelled differently and one nation is missing."""
    key = F.col("c_nationkey")
    counted = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count("*") * 1000).alias("pop"))
    name = (
        F.when(key == 0, "NATION 0")
        .when(key == 7, "ELSEWHERE")
        .otherwise(F.concat(F.lit("NATION_"), key.cast("string")))
    )
    return counted.select(name.alias("Departement"), "pop")
