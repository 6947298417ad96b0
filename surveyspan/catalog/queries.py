"""Registered queries: each pairs a Spark result with its SQL counterpart.

Every query reads whole tables. Doubles are rounded on both sides, because two
engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspan import functions as fn
from surveyspan.catalog import oracle as sql
from surveyspan.catalog import surrogate as sv
from surveyspan.functions.projection import TransverseMercator, to_projected
from surveyspan.operators import counts, order
from surveyspan.operators.design import SurveyDesign, design_summary
from surveyspan.operators.estimate import estimate_many, point_estimate
from surveyspan.operators.joins import keyed_join, lookup, place_lookup, quoted
from surveyspan.operators.places import tolerant_lookup
from surveyspan.operators.reshape import codes_with, codes_without
from surveyspan.plans import audit, child, cholera, geography, report, sanitation, tables, water
from surveyspan.plans.households import GEO_KEYS, HouseholdRules
from surveyspan.sources import polygons, shapes, sinks, stata
from surveyspan.sources.codebook import Variable, codebook_table, decode_labels, decode_with_table, label_table, strip_metadata, value_labels
from surveyspan.sources.tables import classify, read_code_classes, read_delimited, read_microdata, read_sheet_export
from surveyspan.staging import ensure_checkpoint_dir, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOILET, WATER = "improved_toilet", "impr_water_under30min"
DOMAINS = ["dhs_region", "region_name", "admin1", "admin2", "admin3", "region_urban"]


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle
        return query

    return keep


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, for queries that write a file and read it back."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(quoted(c), digits) for c in doubles})


# --- microdata and recodes -------------------------------------------------

HOUSEHOLD_OUT = (
    "hhid, cluster_id, hh_num, sample_wt, prim_sampling_unit, sample_strata, dhs_region, urban, region, "
    "interview_month, hv201, hv204, hv205, hv225, hv238, wealth_idx, time2water, water_source, toilet_source, "
    "share_toilet, num_share_toilet, region_name, region_urban, lat, lon, admin1, A1_PCode, admin2, ID_2, "
    "admin3, A2_PCode"
)


@register("recode_household", f"WITH {sql.households()} SELECT {HOUSEHOLD_OUT} FROM hh")
def recode_household(spark, sf):
    return sv.households(spark, sf, geo=True)


@register(
    "cluster_geography",
    f"WITH {sql.GEO} SELECT cluster_id, urban, lat, lon, admin1, A1_PCode, admin2, ID_2, admin3, A2_PCode FROM geo",
)
def cluster_geography(spark, sf):
    return sv.geography(spark, sf)


@register(
    "admin_lookup",
    f"WITH {sql.VERTICES} SELECT DISTINCT CASE WHEN NAME_1 = 'L''Artibonite' THEN 'Artibonite' ELSE NAME_1 END AS admin1, "
    "NAME_2 AS admin2 FROM vertex",
)
def admin_lookup(spark, sf):
    return geography.admin_lookup(sv.commune_layer(spark, sf))


@register(
    "sanitation_indicators",
    f"WITH {sql.indicators()} SELECT hhid, prim_sampling_unit, toilet_source, share_toilet, toilet_type, improved_toilet, "
    "impr_toilet_type FROM ind",
)
def sanitation_indicators(spark, sf):
    return sanitation.sanitation_indicators(sv.households(spark, sf)).select(
        "hhid", "prim_sampling_unit", "toilet_source", "share_toilet", "toilet_type", "improved_toilet", "impr_toilet_type"
    )


@register(
    "water_indicators",
    f"WITH {sql.indicators()} SELECT hhid, prim_sampling_unit, water_source, time2water, improved_water, "
    "impr_water_under30min, impr_water_dhs, impr_water_type FROM ind",
)
def water_indicators(spark, sf):
    return water.water_indicators(sv.households(spark, sf)).select(
        "hhid", "prim_sampling_unit", "water_source", "time2water", "improved_water", "impr_water_under30min",
        "impr_water_dhs", "impr_water_type",
    )


@register(
    "indicators_alternate",
    f"WITH {sql.indicators(alternate=True)} SELECT hhid, prim_sampling_unit, num_share_toilet, improved_toilet, "
    "improved_water, impr_water_under30min, impr_water_dhs FROM ind",
)
def indicators_alternate(spark, sf):
    hh = sv.households(spark, sf, HouseholdRules.alternate())
    both = water.water_indicators(sanitation.sanitation_indicators(hh, rules="alternate"), rules="alternate")
    return both.select(
        "hhid", "prim_sampling_unit", "num_share_toilet", "improved_toilet", "improved_water", "impr_water_under30min",
        "impr_water_dhs",
    )


def _class_table(spark, sf, source: str, classes: dict) -> DataFrame:
    """A classification table over the codes that the households hold."""
    codes = sv.households(spark, sf).select(F.col(source).alias("code")).distinct()
    named = fn.recode_sets(F.col("code"), classes)
    return codes.withColumn("improved", named).filter(F.col("improved").isNotNull())


@register("sanitation_from_table", ORACLES["sanitation_indicators"])
def sanitation_from_table(spark, sf):
    """The class lists come from a table, not from the package."""
    # The toilet classes as a classification file lists them.
    listed = {
        "Improved": (10, 11, 12, 13, 14, 15, 20, 21, 22, 41),
        "Unimproved": (23, 42, 43, 44, 45, 96),
        "open defecation": (30, 31),
    }
    table = _class_table(spark, sf, "toilet_source", listed)
    classes = sanitation.ToiletClasses.from_classes(read_code_classes(table))
    return sanitation.sanitation_indicators(sv.households(spark, sf), classes).select(
        *sanitation_indicators(spark, sf).columns
    )


@register(
    "stripped_labels",
    f"WITH {sql.households()} SELECT CAST(hv205 AS VARCHAR) AS hv205, count(*) AS n FROM hh GROUP BY 1",
)
def stripped_labels(spark, sf):
    """Without its labels a column decodes to its codes."""
    plain = strip_metadata(sv.households(spark, sf))
    return counts.group_count(decode_labels(plain, ["hv205"]), ["hv205"])


@register(
    "decode_labels",
    f"WITH {sql.LABELS}, {sql.households()} "
    "SELECT coalesce(w.label, CAST(hv201 AS VARCHAR)) AS hv201, coalesce(t.label, CAST(hv205 AS VARCHAR)) AS hv205, "
    "count(*) AS n FROM hh LEFT JOIN label_rows w ON w.variable = 'hv201' AND w.code = hv201 "
    "LEFT JOIN label_rows t ON t.variable = 'hv205' AND t.code = hv205 GROUP BY 1, 2",
)
def decode_labels_query(spark, sf):
    decoded = decode_labels(sv.households(spark, sf), ["hv201", "hv205"])
    return counts.group_count(decoded, ["hv201", "hv205"])


@register(
    "codebook_usage",
    f"WITH {sql.LABELS}, {sql.households()}, used AS (SELECT hv205 AS code, count(*) AS n FROM hh GROUP BY 1) "
    "SELECT code, label, n FROM (SELECT label, code FROM label_rows WHERE variable = 'hv205') FULL JOIN used USING (code)",
)
def codebook_usage(spark, sf):
    raw = sv.raw_households(spark, sf)
    labels = value_labels(codebook_table(raw), "hv205").select(F.col("code").cast("int").alias("code"), "label")
    used = counts.group_count(sv.households(spark, sf), ["hv205"]).withColumnRenamed("hv205", "code")
    return keyed_join(labels, used, "code", "full")


@register(
    "audit_recode",
    f"WITH {sql.households()} SELECT hv204 AS raw, time2water AS recoded, count(*) AS n, "
    "count(*) FILTER (WHERE hv204 IS NOT NULL AND time2water IS NULL) AS became_missing FROM hh GROUP BY 1, 2",
)
def audit_recode(spark, sf):
    return audit.audit_recode(sv.households(spark, sf), "hv204", "time2water")


@register("recode_from_stata", ORACLES["recode_household"])
def recode_from_stata(spark, sf):
    """The survey is converted to labelled microdata files, which are read in parallel and recoded."""
    path = scratch(spark, "survey")
    stata.write_labelled(sv.raw_households(spark, sf), path)
    raw = stata.read_labelled(spark, path)
    whole = {c: F.col(c).cast("bigint") for c in ("hv001", "hv005", "hv021", "hv271")}
    return sv.households(spark, sf, geo=True, raw=raw.withColumns(whole))


@register(
    "stata_labels",
    f"WITH {sql.LABELS}, {sql.households()} "
    "SELECT coalesce(w.label, CAST(hv201 AS VARCHAR)) AS hv201, count(*) AS n, "
    "'source of drinking water' AS description FROM hh LEFT JOIN label_rows w ON w.variable = 'hv201' AND w.code = hv201 GROUP BY 1",
)
def stata_labels(spark, sf):
    """Labels and descriptions come back from the files' own headers; only one variable is decoded from the records."""
    path = scratch(spark, "labels")
    stata.write_labelled(sv.raw_households(spark, sf), path)
    raw = stata.read_labelled(spark, path, columns=["hv201", "shregnew"]).filter(F.col("shregnew") != 12)
    described = raw.schema["hv201"].metadata["label"]
    return counts.group_count(decode_labels(raw, ["hv201"]), ["hv201"]).withColumn("description", F.lit(described))


@register("decode_label_table", ORACLES["decode_labels"])
def decode_label_table(spark, sf):
    """The same labels from a long table ``variable, code, label``."""
    hh = sv.households(spark, sf)
    labels = label_table([Variable("hv201", None, water.WATER_TYPES), Variable("hv205", None, sanitation.TOILET_TYPES)], spark)
    return counts.group_count(decode_with_table(hh, ["hv201", "hv205"], labels), ["hv201", "hv205"])


@register(
    "decode_long_table",
    """WITH named AS (SELECT code, min(label) AS label FROM (SELECT p_partkey AS code, p_name AS label FROM part
                       UNION ALL SELECT p_partkey, upper(p_brand) FROM part WHERE p_partkey % 3 = 0) GROUP BY code),
       sold AS (SELECT s_suppkey AS code, s_name AS label FROM supplier WHERE s_suppkey % 7 <> 0)
    SELECT l_orderkey, l_linenumber, coalesce(named.label, CAST(l_partkey AS VARCHAR)) AS l_partkey,
           coalesce(sold.label, CAST(l_suppkey AS VARCHAR)) AS l_suppkey, count(*) AS n
    FROM lineitem LEFT JOIN named ON named.code = l_partkey LEFT JOIN sold ON sold.code = l_suppkey GROUP BY 1, 2, 3, 4""",
)
def decode_long_table(spark, sf):
    """A label table that grows with the data, with several labels for some codes."""
    part, supplier = sv.table(spark, sf, "part"), sv.table(spark, sf, "supplier")
    labels = (
        part.selectExpr("'l_partkey' AS variable", "p_partkey AS code", "p_name AS label")
        .unionByName(part.filter("p_partkey % 3 = 0").selectExpr("'l_partkey' AS variable", "p_partkey AS code", "upper(p_brand) AS label"))
        .unionByName(supplier.filter("s_suppkey % 7 <> 0").selectExpr("'l_suppkey' AS variable", "s_suppkey AS code", "s_name AS label"))
    )
    items = sv.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return counts.group_count(decode_with_table(items, ["l_partkey", "l_suppkey"], labels), items.columns)


@register(
    "classes_joined",
    f"WITH {sql.indicators()} SELECT toilet_type, count(*) AS n FROM ind GROUP BY 1",
)
def classes_joined(spark, sf):
    """The classification joined as a table instead of read as literals."""
    listed = {"improved": sanitation.IMPROVED_TOILETS, "unimproved": sanitation.UNIMPROVED_TOILETS, "open defecation": sanitation.OPEN_DEFECATION}
    table = _class_table(spark, sf, "toilet_source", listed)
    return counts.group_count(classify(sv.households(spark, sf), "toilet_source", table, "toilet_type"), ["toilet_type"])


@register(
    "files_round_trip",
    """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row, o_orderkey, o_orderpriority,
              CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 6) AS price FROM orders""",
)
def files_round_trip(spark, sf):
    """Numbered CSV, typed read of it, a sheet export of that, and Parquet with labels, each read back."""
    orders = sv.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day"), F.round("o_totalprice", 6).alias("price")
    )
    first, second, third = (scratch(spark, n) for n in ("numbered", "sheet", "labelled"))
    sinks.write_numbered_csv(orders, first, [F.col("day").asc(), F.col("o_orderkey").asc()], keys=["day", "o_orderkey"])
    schema = "row bigint, o_orderkey bigint, o_orderpriority string, day date, price double"
    sinks.write_csv(read_delimited(spark, first, schema), second)
    sheet = read_sheet_export(spark, second, schema, lead_rows=True)
    sinks.write_parquet(sheet.select(F.col("row").alias("row", metadata={"label": "row number"}), *sheet.columns[1:]), third)
    return read_microdata(spark, third)


# --- scalar rules ------------------------------------------------------------

_ORDER_PRICE = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END"


@register(
    "null_rules",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority, {_ORDER_PRICE} AS price,
                   CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey % 100 AS INTEGER) END AS code FROM orders)
    SELECT o_orderkey,
           CASE WHEN price IS NULL THEN NULL WHEN price > 250000 THEN 'high' ELSE 'low' END AS ifelse_value,
           CASE WHEN price IS NULL THEN 'unknown' WHEN price > 250000 THEN 'high' ELSE 'low' END AS if_else_value,
           CASE WHEN price > 400000 THEN 3 WHEN price > 200000 THEN 2 WHEN code < 50 THEN 1 END AS case_when_value,
           CASE WHEN code NOT IN (98, 99) THEN code END AS na_if_value,
           coalesce(code IN (1, 2, 3), FALSE) AS is_in_value,
           CASE WHEN code > 90 THEN 90 ELSE code END AS replaced,
           CASE WHEN code IN (0, 1, 2, 3, 4) THEN 'a' WHEN code IN (5, 6, 7) THEN 'b' END AS recoded,
           CASE WHEN code = 95 THEN 10 ELSE code END AS top_coded,
           price IS NULL AS missing,
           {sql.r("price / nullif(code, 0)", "safe_ratio")}
    FROM o""",
)
def null_rules(spark, sf):
    o = sv.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_custkey") % 100).cast("int")).alias("code"),
    )
    price, code = F.col("price"), F.col("code")
    return o.select(
        "o_orderkey",
        fn.ifelse(price > 250000, "high", "low").alias("ifelse_value"),
        fn.if_else(price > 250000, "high", "low", "unknown").alias("if_else_value"),
        fn.case_when((price > 400000, 3), (price > 200000, 2), (code < 50, 1)).alias("case_when_value"),
        fn.na_if(code, 98, 99).alias("na_if_value"),
        fn.is_in(code, [1, 2, 3]).alias("is_in_value"),
        fn.replace_where(code, 90, code > 90).alias("replaced"),
        fn.recode_sets(code, {"a": range(5), "b": (5, 6, 7)}).alias("recoded"),
        fn.top_code(code, 95, 10).alias("top_coded"),
        price.isNull().alias("missing"),
        F.round(fn.ratio(price, code), 9).alias("safe_ratio"),
    )


@register(
    "text_rules",
    """SELECT p_partkey,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '-') AS title,
       lower(p_name) AS trimmed, p_brand || ', ' || p_type AS glued,
       string_split(p_brand || '_and_' || p_type, '_and_')[1] AS first_part,
       string_split(p_brand || '_and_' || p_type, '_and_')[2] AS second_part,
       CAST(NULL AS VARCHAR) AS no_part,
       printf('%.1f%%', p_size * 1e0 / 64 * 100) AS pct,
       TRY_CAST(CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_name END AS BIGINT) AS as_integer,
       CASE WHEN p_type = 'SMALL' THEN 'TINY' ELSE p_type END AS respelled
    FROM part""",
)
def text_rules(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    pair = fn.split_pair(fn.glue(brand, "_and_", kind), "_and_", "first_part", "second_part")
    return sv.table(spark, sf, "part").select(
        "p_partkey",
        fn.title_case(F.regexp_replace(F.lower(name), " ", "-")).alias("title"),
        fn.trim_text(F.concat(F.lit(" \t"), F.lower(name), F.lit(" \n "))).alias("trimmed"),
        fn.glue(brand, ", ", kind).alias("glued"),
        *pair,
        fn.split_pair(brand, "_and_", "x", "no_part")[1],
        fn.percent(F.col("p_size") / F.lit(64.0), 1).alias("pct"),
        fn.to_integer(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(name)).alias("as_integer"),
        fn.respell(kind, {"SMALL": "TINY"}).alias("respelled"),
    )


@register(
    "significant_digits",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           (l_extendedprice * l_discount - 100) * CASE l_linenumber WHEN 1 THEN 1e-6 WHEN 2 THEN 1e-3 WHEN 3 THEN 0e0 ELSE 1e0 END AS x
         FROM lineitem),
       k AS (SELECT *, CASE WHEN x <> 0 THEN 1 - floor(log10(abs(x))) END AS k FROM v)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN x = 0 THEN 0e0 WHEN k < 0 THEN round_even(x / (10e0 ** -k), 0) * (10e0 ** -k)
                ELSE round_even(x * (10e0 ** k), 0) / (10e0 ** k) END + 0e0 AS two_digits
    FROM k""",
)
def significant_digits(spark, sf):
    scale = F.when(F.col("l_linenumber") == 1, 1e-6).when(F.col("l_linenumber") == 2, 1e-3).when(
        F.col("l_linenumber") == 3, 0.0
    ).otherwise(1.0)
    x = (F.col("l_extendedprice") * F.col("l_discount") - 100) * scale
    return sv.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (fn.signif(x, 2) + F.lit(0.0)).alias("two_digits")
    )


@register(
    "code_sets",
    """SELECT 'without' AS operation, l_partkey AS code FROM
         (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
       UNION ALL
       SELECT 'with', code FROM (SELECT DISTINCT l_partkey AS code FROM lineitem WHERE l_returnflag = 'R'
                                 UNION ALL SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def code_sets(spark, sf):
    items = sv.table(spark, sf, "lineitem")
    returned = items.filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("code"))
    accepted = items.filter(F.col("l_returnflag") == "A").select(F.col("l_partkey").alias("code"))
    without = codes_without(returned, accepted).select(F.lit("without").alias("operation"), "code")
    both = codes_with(returned.distinct(), accepted.distinct()).select(F.lit("with").alias("operation"), "code")
    return codes_with(without, both)


# --- estimates ---------------------------------------------------------------


def _by(name: str, var: str, by: str | None, design: SurveyDesign = sv.DESIGN, **options) -> None:
    @register(
        name,
        f"WITH {sql.indicators()} SELECT {sql.contract(by)} FROM "
        + sql.estimate("ind", var, by, lonely=design.lonely_psu, **options),
    )
    def query(spark, sf):
        place = {"attach": sv.geography(spark, sf), "on": GEO_KEYS} if by and by.startswith("admin") else {}
        return rounded(point_estimate(sv.indicators(spark, sf), design, var, by, **place, **options))


_by("svymean_national", TOILET, None)
_by("svyby_dhs_region", TOILET, "dhs_region")
_by("svyby_region", TOILET, "region_name")
_by("svyby_admin1", WATER, "admin1")
_by("svyby_admin2", WATER, "admin2")
_by("svyby_admin3_nulls", TOILET, "admin3")
_by("svyby_cluster", TOILET, "cluster_id")
_by("svyby_psu_zero_se", TOILET, "prim_sampling_unit")
_by("svyby_keep_nulls", WATER, "prim_sampling_unit", omit_null=False)


@register(
    "svyby_wealth_mean",
    f"WITH {sql.indicators()} SELECT d AS region_name, {sql.r('avg', 'avg', 7)}, {sql.r('se', 'se', 7)}, "
    f"\"N\", {sql.r('unweighted_avg', 'unweighted_avg', 7)} FROM " + sql.estimate("ind", "wealth_idx", "region_name"),
)
def svyby_wealth_mean(spark, sf):
    table = point_estimate(sv.indicators(spark, sf), sv.DESIGN, "wealth_idx", "region_name")
    return rounded(table.select("region_name", "avg", "se", "N", "unweighted_avg"), 7)


@register(
    "svyby_far_domains",
    f"WITH {sql.indicators()}, far AS (SELECT *, hv205 + 1e6 * ascii(right(region_name, 1)) AS shifted FROM ind) "
    f"SELECT d AS region_name, {sql.r('avg', 'avg', 5)}, {sql.r('se', 'se')}, \"N\" FROM "
    + sql.estimate("far", "shifted", "region_name"),
)
def svyby_far_domains(spark, sf):
    """A continuous variable whose domains lie millions apart: the standard errors keep their digits."""
    hh = sv.indicators(spark, sf)
    shifted = F.col("hv205") + F.lit(1e6) * F.ascii(F.right("region_name", F.lit(1)))
    table = point_estimate(hh.withColumn("shifted", shifted), sv.DESIGN, "shifted", "region_name")
    return rounded(table.select("region_name", F.round("avg", 5).alias("avg"), "se", "N"))


@register(
    "estimate_many",
    f"WITH {sql.indicators()} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{b or 'national'}' AS by_var, {sql.contract('domain')} FROM {sql.estimate('ind', v, b)}"
        for v in (TOILET, WATER)
        for b in [None, *DOMAINS]
    ),
)
def estimate_many_query(spark, sf):
    hh, geo = sv.indicators(spark, sf), sv.geography(spark, sf)
    return rounded(estimate_many(hh, sv.DESIGN, [TOILET, WATER], DOMAINS, attach=geo, on=GEO_KEYS))


@register("estimate_many_joined_first", ORACLES["estimate_many"])
def estimate_many_joined_first(spark, sf):
    """The same estimates from households that already carry their geography."""
    return rounded(estimate_many(sv.indicators(spark, sf, geo=True), sv.DESIGN, [TOILET, WATER], DOMAINS))


# Two levels of a geography, and two columns that cut across PSUs.
_CROSSING = {"region_name": ["region_name", "dhs_region"], "interview_month": ["interview_month"], "hh_num": ["hh_num"]}


@register(
    "estimate_crossing",
    f"WITH {sql.indicators()} "
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, '{b or 'national'}' AS by_var, {sql.contract('domain')} "
        f"FROM {sql.estimate('ind', v, b and f'CAST({b} AS VARCHAR)')}"
        for v in (TOILET, WATER)
        for b in [None, "region_name", "dhs_region", "interview_month", "hh_num"]
    ),
)
def estimate_crossing(spark, sf):
    """Domains that cut across PSUs beside a geography: one scan, no product of the two."""
    by = [b for family in _CROSSING.values() for b in family]
    return rounded(estimate_many(sv.indicators(spark, sf), sv.DESIGN, [TOILET, WATER], by, families=list(_CROSSING.values())))


# Every stratum but one holds many PSUs; this one is reduced to a single PSU.
_LONELY_SQL = """, lone AS (
  SELECT * REPLACE (CASE WHEN prim_sampling_unit = first_psu THEN 99 ELSE sample_strata END AS sample_strata)
  FROM ind, (SELECT min(prim_sampling_unit) AS first_psu FROM ind)
)"""


def _lonely(rule: str) -> None:
    @register(
        f"lonely_psu_{rule}",
        f"WITH {sql.indicators()} {_LONELY_SQL} SELECT {sql.contract('admin1')} FROM "
        + sql.estimate("lone", TOILET, "admin1", lonely=rule),
    )
    def query(spark, sf):
        df = sv.indicators(spark, sf, geo=True)
        first = df.agg(F.min("prim_sampling_unit")).scalar()
        stratum = F.when(F.col("prim_sampling_unit") == first, 99).otherwise(F.col("sample_strata"))
        lone = df.withColumn("sample_strata", stratum)
        return rounded(point_estimate(lone, SurveyDesign(lonely_psu=rule), TOILET, "admin1"))


_lonely("adjust")
_lonely("remove")


@register(
    "design_summary",
    f"WITH {sql.indicators()} SELECT sample_strata AS stratum, count(DISTINCT prim_sampling_unit) AS n_psu, "
    "count(*) AS n_rows, sum(sample_wt) AS weight_total FROM ind GROUP BY 1",
)
def design_summary_query(spark, sf):
    return design_summary(sv.indicators(spark, sf), sv.DESIGN)


@register(
    "design_effect",
    f"WITH {sql.indicators()} SELECT {sql.contract('admin1')}, {sql.r('deff', 'deff', 6)} FROM "
    + sql.estimate("ind", TOILET, "admin1", deff=True),
)
def design_effect(spark, sf):
    hh, geo = sv.indicators(spark, sf), sv.geography(spark, sf)
    table = point_estimate(hh, sv.DESIGN, TOILET, "admin1", attach=geo, on=GEO_KEYS, deff=True)
    return rounded(table).withColumn("deff", F.round("deff", 6))


@register(
    "national_scalar",
    f"WITH {sql.indicators()} SELECT {sql.contract('admin3', 'x.')}, (SELECT {sql.r('avg', 'avg')} FROM "
    f"{sql.estimate('ind', WATER, None)}) AS national_avg FROM {sql.estimate('ind', WATER, 'admin3')} x",
)
def national_scalar(spark, sf):
    hh, geo = sv.indicators(spark, sf), sv.geography(spark, sf)
    many = estimate_many(hh, sv.DESIGN, [WATER], ["admin3"], attach=geo, on=GEO_KEYS)
    areas = tables.domain_table(many, WATER, "admin3")
    return rounded(tables.with_national(areas, tables.domain_table(many, WATER, None)))


# --- result tables -----------------------------------------------------------

_DISTRICTS = f"""WITH {sql.indicators()},
  names AS (SELECT n_name AS admin2, r_name AS admin1 FROM nation JOIN region ON n_regionkey = r_regionkey),
  parent AS (SELECT *, CASE WHEN d IS NOT NULL THEN row_number() OVER (ORDER BY avg DESC NULLS LAST, d) END AS rk
             FROM {sql.estimate('ind', TOILET, 'admin1')}),
  district AS (
    SELECT c.*, names.admin1, p.avg AS pavg, p.lb AS plb, p.ub AS pub, p.rk
    FROM {sql.estimate('ind', TOILET, 'admin2')} c LEFT JOIN names ON c.d = names.admin2
    LEFT JOIN parent p ON names.admin1 IS NOT DISTINCT FROM p.d
  )"""


def _nation_names(spark, sf) -> DataFrame:
    nation = sv.table(spark, sf, "nation").join(
        sv.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return nation.select(F.col("n_name").alias("admin2"), F.col("r_name").alias("admin1"))


def _districts(spark, sf) -> DataFrame:
    hh, geo = sv.indicators(spark, sf), sv.geography(spark, sf)
    return tables.district_table(hh, sv.DESIGN, TOILET, _nation_names(spark, sf), attach=geo, on=GEO_KEYS)


@register(
    "admin2_with_parent",
    f"{_DISTRICTS} SELECT admin1, {sql.contract('admin2')}, {sql.r('pavg', 'admin1_avg')}, {sql.r('plb', 'admin1_lb')}, "
    f"{sql.r('pub', 'admin1_ub')}, rk AS admin1_order FROM district",
)
def admin2_with_parent(spark, sf):
    return rounded(_districts(spark, sf))


@register(
    "dot_table",
    f"{_DISTRICTS} SELECT {sql.contract('admin2')}, admin1, row_number() OVER (ORDER BY avg NULLS LAST, d) AS admin2_order, "
    f"printf('%.0f%%', avg * 100) AS avg_label FROM district WHERE d IS NOT NULL",
)
def dot_table(spark, sf):
    table = tables.dot_table(_districts(spark, sf), "admin2")
    return rounded(table.drop("admin1_avg", "admin1_lb", "admin1_ub", "admin1_order"))


@register(
    "comparison_bands",
    f"{_DISTRICTS} SELECT DISTINCT admin1, {sql.r('plb', 'admin1_lb')}, {sql.r('pub', 'admin1_ub')}, "
    f"{sql.r('pavg', 'admin1_avg')} FROM district WHERE d IS NOT NULL",
)
def comparison_bands(spark, sf):
    return rounded(tables.comparison_bands(_districts(spark, sf)))


@register(
    "urban_rural_gap",
    f"""WITH {sql.indicators()},
    pair AS (SELECT *, string_split(d, '_and_')[1] AS region, string_split(d, '_and_')[2] AS urban
             FROM {sql.estimate('ind', TOILET, 'region_urban')}),
    mean AS (SELECT d AS region, avg AS region_avg FROM {sql.estimate('ind', TOILET, 'region_name')}),
    rk AS (SELECT region, row_number() OVER (ORDER BY region_avg NULLS LAST, region) AS region_order
           FROM mean WHERE region IN (SELECT region FROM pair WHERE urban = 'urban')),
    gap AS (SELECT pair.*, lag(avg) OVER (PARTITION BY pair.region ORDER BY urban) AS lagged, region_avg, region_order
            FROM pair LEFT JOIN mean USING (region) LEFT JOIN rk USING (region))
    SELECT region, urban, {sql.contract(None)}, {sql.r('lagged', 'lagged')}, {sql.r('region_avg', 'region_avg')}, region_order
    FROM gap""",
)
def urban_rural_gap(spark, sf):
    return rounded(tables.urban_rural_gap(sv.indicators(spark, sf), sv.DESIGN, TOILET))


@register(
    "compare_indicators",
    f"""WITH {sql.indicators()},
    wide AS (SELECT d AS region_name, a.avg AS t, b.avg AS w FROM {sql.estimate('ind', TOILET, 'region_name')} a
             FULL JOIN {sql.estimate('ind', WATER, 'region_name')} b USING (d)),
    longer AS (SELECT region_name, 'improved latrines' AS indicator, t AS value FROM wide
               UNION ALL SELECT region_name, 'improved water', w FROM wide),
    rk AS (SELECT region_name, row_number() OVER (ORDER BY t NULLS LAST, region_name) AS region_name_order
           FROM wide WHERE region_name IS NOT NULL)
    SELECT region_name, indicator, {sql.r('value', 'value')},
           CASE WHEN value < (SELECT median(value) FROM longer) THEN 'dark' WHEN value IS NOT NULL THEN 'light' END AS label_colour,
           region_name_order FROM longer LEFT JOIN rk USING (region_name)""",
)
def compare_indicators(spark, sf):
    many = stage(estimate_many(sv.indicators(spark, sf), sv.DESIGN, [TOILET, WATER], ["region_name"]))
    first, second = (tables.domain_table(many, v, "region_name") for v in (TOILET, WATER))
    return rounded(tables.compare_indicators(first, second, "region_name", "improved latrines", "improved water"))


@register(
    "household_report",
    f"WITH {sql.indicators()} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, {sql.contract('domain')} FROM "
        + sql.estimate("ind", var, by and f"CAST({by} AS VARCHAR)")
        for name, (var, by) in report.ESTIMATES.items()
    ),
)
def household_report(spark, sf):
    """Every estimate table of the household analysis, stacked."""
    return rounded(report.household_estimates(sv.indicators(spark, sf), sv.DESIGN, sv.geography(spark, sf)))


_ALTERNATE = sql.indicators(alternate=True)


@register(
    "reconcile_rules",
    f"""SELECT d AS region, {sql.r('a.avg', 'avg_primary')}, {sql.r('a.se', 'se_primary')}, a."N" AS "N_primary",
               {sql.r('b.avg', 'avg_alternate')}, {sql.r('b.se', 'se_alternate')}, b."N" AS "N_alternate",
               {sql.r('a.avg - b.avg', 'difference')}
        FROM (WITH {sql.indicators()} SELECT * FROM {sql.estimate('ind', TOILET, 'region')}) a
        FULL JOIN (WITH {_ALTERNATE} SELECT * FROM {sql.estimate('ind', TOILET, 'region')}) b USING (d)""",
)
def reconcile_rules(spark, sf):
    primary = point_estimate(sv.indicators(spark, sf), sv.DESIGN, TOILET, "region")
    hh = sv.households(spark, sf, HouseholdRules.alternate())
    second = point_estimate(sanitation.sanitation_indicators(hh, rules="alternate"), sv.DESIGN, TOILET, "region")
    return rounded(audit.reconcile(primary, second, "region"))


def _reconcile_water(name: str, var: str) -> None:
    @register(
        name,
        f"""SELECT d AS region, {sql.r('a.avg', 'avg_primary')}, {sql.r('a.se', 'se_primary')}, a."N" AS "N_primary",
                   {sql.r('b.avg', 'avg_alternate')}, {sql.r('b.se', 'se_alternate')}, b."N" AS "N_alternate",
                   {sql.r('a.avg - b.avg', 'difference')}
            FROM (WITH {sql.indicators()} SELECT * FROM {sql.estimate('ind', var, 'region')}) a
            FULL JOIN (WITH {_ALTERNATE} SELECT * FROM {sql.estimate('ind', var, 'region')}) b USING (d)""",
    )
    def query(spark, sf):
        primary = point_estimate(sv.indicators(spark, sf), sv.DESIGN, var, "region")
        hh = sanitation.sanitation_indicators(sv.households(spark, sf, HouseholdRules.alternate()), rules="alternate")
        second = point_estimate(water.water_indicators(hh, rules="alternate"), sv.DESIGN, var, "region")
        return rounded(audit.reconcile(primary, second, "region"))


_reconcile_water("reconcile_improved_water", "improved_water")
_reconcile_water("reconcile_water_under30min", "impr_water_under30min")
_reconcile_water("reconcile_water_dhs", "impr_water_dhs")


@register(
    "share_of_total",
    f"WITH {sql.indicators()}, c AS (SELECT toilet_type, improved_toilet, count(*) AS n FROM ind GROUP BY 1, 2) "
    f"SELECT toilet_type, improved_toilet, n, {sql.r('n / (SELECT sum(n) FROM c)', 'share')}, "
    "printf('%.1f%%', n / (SELECT sum(n) FROM c) * 100) AS pct FROM c",
)
def share_of_total(spark, sf):
    return rounded(counts.share_of_total(sv.indicators(spark, sf), ["toilet_type", "improved_toilet"]))


@register(
    "share_in_group",
    f"WITH {sql.indicators()}, c AS (SELECT region_name, improved_toilet, count(*) AS n FROM ind GROUP BY 1, 2), "
    "p AS (SELECT *, n / sum(n) OVER (PARTITION BY region_name) AS share FROM c) "
    f"SELECT region_name, improved_toilet, n, {sql.r('share', 'pct')} FROM p WHERE improved_toilet = 1",
)
def share_in_group(spark, sf):
    table = counts.share_in_group(sv.indicators(spark, sf), "region_name", TOILET)
    return order.descending(rounded(table), "pct")


@register(
    "domain_counts",
    f"WITH {sql.indicators()} SELECT admin3, CAST(sum(improved_toilet) AS BIGINT) AS \"households with improved sanitation\", "
    "count(*) AS \"total number of households\" FROM ind WHERE improved_toilet IS NOT NULL GROUP BY 1",
)
def domain_counts(spark, sf):
    return counts.domain_counts(
        sv.indicators(spark, sf, geo=True), TOILET, "admin3", "households with improved sanitation", "total number of households"
    )


@register(
    "crosstab_missing",
    f"WITH {sql.indicators()} SELECT toilet_type, count(*) FILTER (WHERE improved_toilet = 0) AS improved_toilet_0, "
    "count(*) FILTER (WHERE improved_toilet = 1) AS improved_toilet_1, "
    "count(*) FILTER (WHERE improved_toilet IS NULL) AS improved_toilet_missing FROM ind GROUP BY 1",
)
def crosstab_missing(spark, sf):
    return counts.crosstab(sv.indicators(spark, sf), "toilet_type", TOILET, [0, 1, None])


@register(
    "numbered_rows",
    """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS "row"
       FROM orders""",
)
def numbered_rows(spark, sf):
    keys = [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    numbered = order.row_numbers(sv.table(spark, sf, "orders"), keys, "row")
    return numbered.select("o_orderkey", "o_totalprice", "row")


@register("numbered_keys", ORACLES["numbered_rows"])
def numbered_keys(spark, sf):
    """The same numbers with only the sort columns sorted and staged."""
    keys = [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    numbered = order.row_numbers(
        sv.table(spark, sf, "orders"), keys, "row", keys=["o_orderpriority", "o_totalprice", "o_orderkey"]
    )
    return numbered.select("o_orderkey", "o_totalprice", "row")


@register(
    "exact_medians",
    f"""SELECT 'price' AS what, {sql.r("median(l_extendedprice)", "middle")} FROM lineitem
        UNION ALL SELECT 'quantity', {sql.r("median(l_quantity)", "middle")} FROM lineitem
        UNION ALL SELECT 'known', {sql.r("median(CASE WHEN l_linenumber > 2 THEN l_tax * l_extendedprice END)", "middle")} FROM lineitem""",
)
def exact_medians(spark, sf):
    """Many distinct values, heavy ties, and missing values."""
    items = sv.table(spark, sf, "lineitem")
    values = {
        "price": F.col("l_extendedprice"),
        "quantity": F.col("l_quantity"),
        "known": F.when(F.col("l_linenumber") > 2, F.col("l_tax") * F.col("l_extendedprice")),
    }
    parts = [
        order.exact_median(items.select(v.alias("v")), "v", "middle").select(F.lit(k).alias("what"), "middle")
        for k, v in values.items()
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# --- children ----------------------------------------------------------------


@register(
    "child_table",
    f"WITH {sql.CHILDREN} SELECT caseid, cluster_id, hh_num, sample_wt, prim_sampling_unit, sample_strata, urban, region, "
    "interview_month, wealth_idx, age_months, age_yrs, b4, h11, hw70, hw13, sex, diarrhea, stunting_eligible, "
    "stunting_score, stunted, sev_stunted, region_name FROM kid",
)
def child_table(spark, sf):
    return sv.children(spark, sf)


@register(
    "child_stunting_summary",
    f"WITH {sql.CHILDREN} SELECT region_name, {sql.r('avg(sev_stunted)', 'mean_sev_stunted')}, "
    f"{sql.r('avg(stunted)', 'mean_stunted')}, {sql.r('avg(stunting_score)', 'mean_stunting_score')}, count(*) AS n "
    "FROM kid WHERE stunting_score IS NOT NULL GROUP BY 1",
)
def child_stunting_summary(spark, sf):
    return rounded(child.stunting_summary(sv.children(spark, sf), "region_name"))


_MEASURED = f"WITH {sql.CHILDREN}, m AS (SELECT * FROM kid WHERE stunting_eligible AND stunting_score IS NOT NULL)"


def _stunting(name: str, by: str | None, subset_design: bool) -> None:
    @register(
        name,
        f"{_MEASURED} SELECT {sql.contract(by)}, {sql.r('deff', 'deff', 6)} FROM "
        + sql.estimate("m", "stunted", by, deff=True, sizes=None if subset_design else "kid"),
    )
    def query(spark, sf):
        table = child.stunting_estimates(sv.children(spark, sf), sv.DESIGN, by, subset_design=subset_design)
        return rounded(table).withColumn("deff", F.round("deff", 6))


_stunting("stunting_national", None, True)
_stunting("stunting_by_region", "region_name", True)
_stunting("stunting_by_region_full_design", "region_name", False)


# --- cholera -----------------------------------------------------------------

_RATES = f"""WITH {sql.CASES},
    people AS (SELECT CASE c_nationkey WHEN 7 THEN 'ELSEWHERE' ELSE 'NATION_' || c_nationkey END AS Departement,
                      count(*) * 1000 AS pop FROM customer GROUP BY c_nationkey),
    peak AS (SELECT Departement, CAST(coalesce(sum(Cases), 0) AS BIGINT) AS cases,
                    CAST(coalesce(sum(Deaths), 0) AS BIGINT) AS deaths, max(Cases / pop) AS x
             FROM cases LEFT JOIN people USING (Departement) GROUP BY 1),
    totals AS (SELECT Departement, cases, deaths,
                      CASE WHEN x = 0 THEN 0e0 ELSE round_even(x * 10e0 ** (1 - floor(log10(x))), 0) / 10e0 ** (1 - floor(log10(x))) END AS rate
               FROM peak)"""


@register("case_rates", f"{_RATES} SELECT Departement, cases, deaths, {sql.r('rate', 'rate')}, {sql.r('rate / 0.00059e0', 'fc')} FROM totals")
def case_rates(spark, sf):
    people = sv.population(spark, sf).withColumn(
        "Departement", fn.respell(F.col("Departement"), sv.POPULATION_FIXES)
    )
    return rounded(cholera.case_rates(sv.monthly_cases(spark, sf), people))


@register(
    "case_rate_map",
    f"{_RATES}, {sql.VERTICES} SELECT coalesce(NAME_2, Departement) AS NAME_2, {sql.r('long', 'long')}, {sql.r('lat', 'lat')}, "
    f"\"order\", piece, \"group\", id, A1_Name, NAME_1, A2_Name, DHSREGFR, cases, deaths, {sql.r('rate', 'rate')}, "
    f"{sql.r('rate / 0.00059e0', 'fc')} FROM vertex FULL JOIN totals ON NAME_2 = Departement",
)
def case_rate_map(spark, sf):
    people = sv.population(spark, sf).withColumn(
        "Departement", fn.respell(F.col("Departement"), sv.POPULATION_FIXES)
    )
    totals = cholera.case_rates(sv.monthly_cases(spark, sf), people, ranked=False)
    areas = geography.full_map_table(totals, sv.commune_layer(spark, sf), {"NAME_2": "Departement"})
    return rounded(polygons.polygon_vertices(areas, keep_empty=True))


@register(
    "monthly_series",
    f"WITH {sql.CASES} SELECT Departement, Month, CAST(sum(Cases) AS BIGINT) AS cases, CAST(sum(Deaths) AS BIGINT) AS deaths "
    "FROM cases GROUP BY 1, 2",
)
def monthly_series(spark, sf):
    return cholera.monthly_series(sv.monthly_cases(spark, sf))


@register(
    "monthly_series_national",
    f"WITH {sql.CASES} SELECT Month, CAST(sum(Cases) AS BIGINT) AS cases, CAST(sum(Deaths) AS BIGINT) AS deaths FROM cases GROUP BY 1",
)
def monthly_series_national(spark, sf):
    return cholera.monthly_series(sv.monthly_cases(spark, sf), None)


@register(
    "priority_communes",
    f"""WITH {sql.VERTICES}, listed AS (
      SELECT CASE WHEN s_suppkey % 7 = 0 THEN s_name || ' Nord' ELSE s_name END AS commune, r_name AS departement,
             CASE s_suppkey % 3 WHEN 0 THEN 'Phase 1' ELSE 'Phase 2' END AS priority,
             substr('ABCD', CAST(s_suppkey % 4 + 1 AS INTEGER), 1) AS response,
             CASE s_suppkey % 4 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 0 THEN 3 END AS prevalence2016,
             CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS prevalence2014
      FROM places WHERE s_suppkey % 3 <> 2),
    v AS (SELECT *, trim(A2_Name) AS commune, A1_Name AS departement FROM vertex)
    SELECT commune, departement, priority, response, prevalence2016, prevalence2014, {sql.VERTEX_COLUMNS}
    FROM listed FULL JOIN v USING (commune, departement)""",
)
def priority_communes(spark, sf):
    layer = geography.trimmed_commune_names(sv.commune_layer(spark, sf))
    areas = cholera.priority_communes(sv.priority_sheet(spark, sf), layer)
    return rounded(polygons.polygon_vertices(areas, keep_empty=True))


# --- geometry and maps -------------------------------------------------------


@register("polygon_vertices", f"WITH {sql.VERTICES} SELECT {sql.VERTEX_COLUMNS} FROM vertex")
def polygon_vertices(spark, sf):
    return rounded(polygons.polygon_vertices(sv.commune_layer(spark, sf)))


@register("layer_files", f"WITH {sql.VERTICES} SELECT {sql.VERTEX_COLUMNS.replace('A2_Name', 'rtrim(A2_Name) AS A2_Name')} FROM vertex")
def layer_files(spark, sf):
    """The layer is written as projected record files, read in parallel and brought back to degrees."""
    path = scratch(spark, "layer")
    shapes.write_layer(sv.commune_layer(spark, sf), path, TransverseMercator.utm(18))
    layer = shapes.read_layer(spark, path).drop("id").withColumnRenamed("id_attribute", "id")
    return rounded(polygons.polygon_vertices(layer))


_ZONE = TransverseMercator.utm(18)


@register(
    "projected_vertices",
    f"""WITH {sql.VERTICES},
    sphere AS (SELECT *, sin(radians(lat)) AS s, radians(long - {_ZONE.central_meridian}) AS turn FROM vertex),
    tangent AS (SELECT *, sinh(atanh(s) - {sql.ECCENTRICITY!r} * atanh({sql.ECCENTRICITY!r} * s)) AS t FROM sphere),
    angle AS (SELECT *, atan2(t, cos(turn)) AS u, asinh(sin(turn) / sqrt(t * t + cos(turn) * cos(turn))) AS v FROM tangent)
    SELECT id, "order", round({sql.easting(_ZONE)}, 4) AS easting, round({sql.northing(_ZONE)}, 4) AS northing FROM angle""",
)
def projected_vertices(spark, sf):
    vertices = polygons.polygon_vertices(sv.commune_layer(spark, sf)).select("id", "order", "long", "lat")
    flat = to_projected(vertices, _ZONE)
    return flat.select("id", "order", F.round("long", 4).alias("easting"), F.round("lat", 4).alias("northing"))


@register(
    "vertex_attributes",
    f"WITH {sql.VERTICES} SELECT {sql.VERTEX_COLUMNS} FROM vertex WHERE id IN (1, 2, 3, 50) AND piece = 1",
)
def vertex_attributes(spark, sf):
    """A layer kept in two tables, some polygons, and of those the first ring."""
    layer = sv.commune_layer(spark, sf)
    vertices = polygons.polygon_vertices(layer.select("id", "rings"))
    attributed = polygons.attach_attributes(polygons.select_pieces(vertices, [1, 2, 3, 50]), layer.drop("rings"))
    return rounded(attributed)


_CENTROIDS = f"""{sql.VERTICES},
    edge AS (SELECT *, lead(long) OVER w AS nx, lead(lat) OVER w AS ny FROM vertex
             WINDOW w AS (PARTITION BY id, piece ORDER BY "order")),
    moment AS (SELECT id, piece, A2_Name, NAME_2, sum(long * ny - nx * lat) AS c,
                      sum((long + nx) * (long * ny - nx * lat)) AS mx, sum((lat + ny) * (long * ny - nx * lat)) AS my
               FROM edge WHERE nx IS NOT NULL GROUP BY ALL),
    centre AS (SELECT id, mx / (3 * c) AS long, my / (3 * c) AS lat, A2_Name, NAME_2 FROM moment
               QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC) = 1)"""


@register("polygon_centroids", f"WITH {_CENTROIDS} SELECT id, {sql.r('long', 'long', 6)}, {sql.r('lat', 'lat', 6)}, A2_Name AS label FROM centre")
def polygon_centroids(spark, sf):
    return rounded(polygons.polygon_centroids(sv.commune_layer(spark, sf), "A2_Name"), 6)


def _map(name: str, var: str, by: str, vertex_name: str) -> None:
    others = sql.VERTEX_COLUMNS.replace(f", {vertex_name}", "")
    @register(
        name,
        f"WITH {sql.indicators()}, {sql.VERTICES.removeprefix(sql.PLACES + ',')} "
        f"SELECT {vertex_name}, {others}, {sql.contract(None, 'e.')} FROM vertex "
        f"LEFT JOIN {sql.estimate('ind', var, by)} e ON {vertex_name} IS NOT DISTINCT FROM e.d",
    )
    def query(spark, sf):
        place = {"attach": sv.geography(spark, sf), "on": GEO_KEYS} if by.startswith("admin") else {}
        areas = point_estimate(sv.indicators(spark, sf), sv.DESIGN, var, by, **place)
        mapped = geography.map_table(areas, sv.commune_layer(spark, sf), by, vertex_name)
        return rounded(polygons.polygon_vertices(mapped))


_map("map_table", TOILET, "region_name", "DHSREGFR")
_map("map_table_admin2", WATER, "admin2", "NAME_2")


@register(
    "centroid_labels",
    f"WITH {sql.indicators()}, {_CENTROIDS.removeprefix(sql.PLACES + ',')} "
    f"SELECT NAME_2 AS label, id, {sql.r('c.long', 'long', 6)}, {sql.r('c.lat', 'lat', 6)}, printf('%.0f%%', avg * 100) AS var_pct "
    f"FROM centre c LEFT JOIN {sql.estimate('ind', TOILET, 'admin2')} e ON NAME_2 = e.d",
)
def centroid_labels(spark, sf):
    layer = sv.commune_layer(spark, sf)
    hh, geo = sv.indicators(spark, sf), sv.geography(spark, sf)
    areas = point_estimate(hh, sv.DESIGN, TOILET, "admin2", attach=geo, on=GEO_KEYS)
    mapped = geography.map_table(areas, layer, "admin2", "NAME_2")
    centres = polygons.polygon_centroids(layer, "NAME_2")
    return rounded(geography.centroid_labels(centres, mapped, "NAME_2", "avg"), 6)


@register(
    "accent_join",
    f"""WITH {sql.indicators()},
    n AS (SELECT lower(strip_accents(region_name)) AS name_key, count(*) AS households FROM ind GROUP BY 1),
    v AS (SELECT lower(strip_accents(DHSREGFR)) AS name_key, count(*) AS polygons
          FROM (SELECT CASE n_nationkey WHEN 0 THEN 'Aire Métropolitaine' WHEN 1 THEN 'Grande-Anse' WHEN 2 THEN 'Reste-Ouest'
                       ELSE n_name END AS DHSREGFR FROM places) GROUP BY 1)
    SELECT name_key, households, polygons FROM n FULL JOIN v USING (name_key)""",
)
def accent_join(spark, sf):
    """Survey names without accents against map names with combining accents."""
    plain = F.translate("region_name", "é", "e")
    combining = F.regexp_replace(F.upper("DHSREGFR"), "É", "É")
    survey = sv.indicators(spark, sf).groupBy(plain.alias("name")).agg(F.count("*").alias("households"))
    mapped = sv.commune_layer(spark, sf).groupBy(combining.alias("name")).agg(F.count("*").alias("polygons"))
    keyed = [df.withColumn("name_key", fn.accent_key(F.col("name"))).drop("name") for df in (survey, mapped)]
    return keyed_join(keyed[0], keyed[1], "name_key", "full")


@register(
    "gazetteer_join",
    f"""WITH {sql.PLACES}
    SELECT c_name || ', HT' AS loc, c_name AS city, c_acctbal AS population, {sql.r('lon', 'lon')}, {sql.r('lat', 'lat')}
    FROM customer LEFT JOIN (SELECT 'Customer#' || substr(s_name, 10) || ', HT' AS loc,
      -74.5e0 + (s_suppkey % 330) / 1e2 AS lon, 17.5e0 + (s_suppkey % 280) / 1e2 AS lat FROM places) g ON c_name || ', HT' = g.loc""",
)
def gazetteer_join(spark, sf):
    key = F.col("s_suppkey")
    places = sv.suppliers(spark, sf).select(
        F.concat(F.lit("Customer#"), F.substring("s_name", 10, 100), F.lit(", HT")).alias("loc"),
        (F.lit(-74.5) + key % 330 / F.lit(100.0)).alias("lon"),
        (F.lit(17.5) + key % 280 / F.lit(100.0)).alias("lat"),
    )
    cities = sv.table(spark, sf, "customer").select(F.col("c_name").alias("city"), F.col("c_acctbal").alias("population"))
    return rounded(place_lookup(cities, "city", places, "HT"))


# Part names as places, and the same names with slips: case, accents, one edit, two edits.
_SLIPS = {
    1: "upper(full_name)",
    2: "replace(full_name, 'e', 'é')",
    3: "concat(substring(full_name, 1, 2), substring(full_name, 4))",
    4: "concat(substring(full_name, 1, 4), 'q', substring(full_name, 6))",
    5: "concat('x', substring(full_name, 1, length(full_name) - 1))",
}
_SLIPPED = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _SLIPS.items()) + " ELSE full_name END"


@register(
    "tolerant_places",
    f"""WITH full_names AS (SELECT p_partkey, concat(p_name, ' ', p_brand) AS full_name FROM part),
    asked AS (SELECT p_partkey, {_SLIPPED} AS name FROM full_names),
    place AS (SELECT full_name AS loc, min(p_partkey) AS first_key FROM full_names WHERE p_partkey % 4 <> 1 GROUP BY 1),
    near AS (
      SELECT n.name, loc, first_key, levenshtein(lower(strip_accents(n.name)), lower(loc)) AS d,
             CASE WHEN n.name = loc THEN -1 ELSE levenshtein(lower(strip_accents(n.name)), lower(loc)) END AS rank
      FROM (SELECT DISTINCT name FROM asked) n CROSS JOIN place
      WHERE levenshtein(lower(strip_accents(n.name)), lower(loc)) <= least(2, length(n.name) // 4)),
    best AS (SELECT name, any_value(loc) AS loc, any_value(first_key) AS first_key, any_value(d) AS distance, count(*) AS n_places
             FROM (SELECT *, min(rank) OVER (PARTITION BY name) AS least FROM near) WHERE rank = least GROUP BY name)
    SELECT p_partkey, asked.name, CASE WHEN n_places = 1 THEN loc END AS loc, distance, coalesce(n_places, 0) AS n_places,
           CASE WHEN n_places = 1 THEN first_key END AS first_key FROM asked LEFT JOIN best ON best.name = asked.name""",
)
def tolerant_places(spark, sf):
    part = sv.table(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' ', p_brand) AS full_name")
    gazetteer = part.filter("p_partkey % 4 <> 1").groupBy(F.col("full_name").alias("loc")).agg(F.min("p_partkey").alias("first_key"))
    return tolerant_lookup(part.selectExpr("p_partkey", f"{_SLIPPED} AS name"), "name", gazetteer)


@register(
    "label_lookup",
    "SELECT coalesce(n_name, CAST(l_suppkey % 30 AS VARCHAR)) AS code, count(*) AS n FROM lineitem "
    "LEFT JOIN nation ON l_suppkey % 30 = n_nationkey GROUP BY 1",
)
def label_lookup(spark, sf):
    coded = sv.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 30).alias("code"))
    names = sv.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return counts.group_count(lookup(coded, "code", names, "id", "n_name"), ["code"])
