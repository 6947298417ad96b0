"""The same results as plain SQL, written without the library, for DuckDB."""

from __future__ import annotations

from surveyspan.catalog.surrogate import TOILET_CODES, WATER_CODES
from surveyspan.plans.sanitation import TOILET_TYPES
from surveyspan.plans.water import WATER_TYPES

# Fixed values, written out once more so that a wrong list in the package does not pass.
IMPROVED_TOILETS = (10, 11, 12, 13, 14, 15, 20, 21, 22, 41)
OPEN_DEFECATION = (30, 31)
UNIMPROVED_TOILETS = (23, 42, 43, 44, 45, 96)
IMPROVED_WATER = (10, 11, 12, 13, 14, 20, 21, 31, 32, 41, 51)
UNIMPROVED_WATER = (30, 33, 34, 40, 42, 43, 61, 62, 71, 72, 96)
BOTTLED_WATER = (71, 72)


def _list(codes) -> str:
    return "(" + ", ".join(str(c) for c in codes) + ")"


def r(expression: str, name: str, digits: int = 9) -> str:
    """Rounded column; adding zero turns a negative zero into zero."""
    return f"round({expression}, {digits}) + 0e0 AS {name}"


_URBAN = "CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END"
_WEALTH = "(CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 - 4000000000) / 1e5"

PLACES = """
places AS (
  SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

GEO = PLACES + """,
geo2 AS (
  SELECT s_suppkey AS cluster_id,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS urban,
         CASE WHEN s_suppkey % 10 <> 0 THEN 17.5e0 + (s_suppkey % 280) / 1e2 END AS lat,
         CASE WHEN s_suppkey % 10 <> 0 THEN -74.5e0 + (s_suppkey % 330) / 1e2 END AS lon,
         r_name AS admin1, n_name AS admin2, n_nationkey AS ID_2
  FROM places
),
geo3 AS (
  SELECT CASE WHEN s_suppkey % 20 = 7 THEN s_suppkey + 1000000000 ELSE s_suppkey END AS cluster_id,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS urban,
         CASE WHEN s_suppkey % 10 <> 0 THEN 17.5e0 + (s_suppkey % 280) / 1e2 END AS lat,
         CASE WHEN s_suppkey % 10 <> 0 THEN -74.5e0 + (s_suppkey % 330) / 1e2 END AS lon,
         r_name AS admin1, 'HT' || r_regionkey AS A1_PCode,
         CASE WHEN s_suppkey % 10 <> 0 THEN s_name END AS admin3, 'HT' || s_suppkey AS A2_PCode
  FROM places
),
geo AS (
  SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id,
         CASE WHEN a.cluster_id IS NULL THEN b.urban ELSE a.urban END AS urban,
         coalesce(a.lat, b.lat) AS lat, coalesce(a.lon, b.lon) AS lon,
         coalesce(a.admin1, b.admin1) AS admin1, A1_PCode, admin2, ID_2, admin3, A2_PCode
  FROM geo2 a FULL JOIN geo3 b ON a.cluster_id = b.cluster_id
)"""


def households(camps: bool = False, top_coded: bool = False) -> str:
    sharing = (
        f"CASE WHEN l_orderkey % 13 = 0 THEN {10 if top_coded else 95} "
        "WHEN l_orderkey % 13 > 2 THEN CAST(l_orderkey % 13 AS INTEGER) END"
    )
    return GEO + f""",
hh0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS hhid,
         l_suppkey AS cluster_id, l_linenumber AS hh_num,
         CAST(CAST(round(l_quantity) AS BIGINT) AS DOUBLE) AS sample_wt,
         l_suppkey * 10 + l_orderkey % 10 AS prim_sampling_unit, CAST(l_suppkey % 8 AS INTEGER) AS sample_strata,
         coalesce(lower(r_name), CAST(l_suppkey % 6 AS VARCHAR)) AS dhs_region,
         {_URBAN} AS urban, CAST(l_suppkey % 25 AS INTEGER) AS region, CAST(month(l_shipdate) AS INTEGER) AS interview_month,
         list_extract({WATER_CODES}, l_partkey % 23 + 1) AS hv201,
         CASE WHEN l_linenumber = 7 AND l_partkey % 2 = 0 THEN 998 WHEN l_linenumber = 7 THEN 999
              WHEN l_linenumber = 6 THEN 996 WHEN l_linenumber = 5 AND l_partkey % 10 = 0 THEN NULL
              ELSE CAST(round(l_quantity) AS INTEGER) END AS hv204,
         list_extract({TOILET_CODES}, (l_partkey + l_linenumber) % 19 + 1) AS hv205,
         CASE WHEN l_linenumber % 3 = 2 THEN 9 ELSE l_linenumber % 3 END AS hv225,
         CAST(CASE l_orderkey % 13 WHEN 0 THEN 95 WHEN 1 THEN 98 WHEN 2 THEN 99 ELSE l_orderkey % 13 END AS INTEGER) AS hv238,
         {_WEALTH} AS wealth_idx,
         CASE n_nationkey WHEN 0 THEN 'Aire Métropolitaine' WHEN 1 THEN 'Grande-Anse' WHEN 2 THEN 'Reste-Ouest'
              ELSE upper(n_name[1]) || lower(n_name[2:]) END AS region_name,
         {sharing} AS num_share_toilet
  FROM lineitem LEFT JOIN region ON l_suppkey % 6 = r_regionkey LEFT JOIN nation ON l_suppkey % 25 = n_nationkey
  WHERE {'TRUE' if camps else 'l_suppkey % 25 <> 12'}
),
hh1 AS (
  SELECT *, CASE WHEN hv204 IN (998, 999) THEN NULL WHEN hv204 = 996 THEN 0 ELSE hv204 END AS time2water,
         nullif(hv201, 99) AS water_source, nullif(hv205, 99) AS toilet_source, nullif(hv225, 9) AS share_toilet,
         CASE urban WHEN 1 THEN region_name || '_and_urban' WHEN 0 THEN region_name || '_and_rural' END AS region_urban
  FROM hh0
),
hh AS (
  SELECT hh1.*, lat, lon, admin1, A1_PCode, admin2, ID_2, admin3, A2_PCode
  FROM hh1 LEFT JOIN geo ON hh1.cluster_id = geo.cluster_id AND hh1.urban IS NOT DISTINCT FROM geo.urban
)"""


def indicator_columns(alternate: bool = False) -> str:
    piped = [c for c in UNIMPROVED_WATER if c not in BOTTLED_WATER]
    dhs = IMPROVED_WATER + BOTTLED_WATER
    if alternate:
        toilet = f"CASE WHEN toilet_source IN {_list(IMPROVED_TOILETS)} AND share_toilet = 0 THEN 1 ELSE 0 END"
        water = f"CASE WHEN water_source IS NOT NULL THEN CAST(water_source IN {_list(IMPROVED_WATER)} AS INTEGER) END"
        bottled = f"CASE WHEN water_source IS NOT NULL THEN CAST(water_source IN {_list(dhs)} AS INTEGER) END"
    else:
        toilet = (
            f"CASE WHEN toilet_source IN {_list(IMPROVED_TOILETS)} AND share_toilet = 0 THEN 1 "
            f"WHEN toilet_source IN {_list(IMPROVED_TOILETS)} AND share_toilet = 1 THEN 0 "
            f"WHEN toilet_source IN {_list(UNIMPROVED_TOILETS + OPEN_DEFECATION)} THEN 0 END"
        )
        water = (
            f"CASE WHEN water_source IN {_list(IMPROVED_WATER)} THEN 1 "
            f"WHEN water_source IN {_list(UNIMPROVED_WATER)} THEN 0 END"
        )
        bottled = f"CASE WHEN water_source IN {_list(dhs)} THEN 1 WHEN water_source IN {_list(piped)} THEN 0 END"
    return f"""
    CASE WHEN toilet_source IN {_list(IMPROVED_TOILETS)} THEN 'improved'
         WHEN toilet_source IN {_list(UNIMPROVED_TOILETS)} THEN 'unimproved'
         WHEN toilet_source IN {_list(OPEN_DEFECATION)} THEN 'open defecation' END AS toilet_type,
    {toilet} AS improved_toilet,
    CASE WHEN toilet_source IN {_list(UNIMPROVED_TOILETS)} THEN 'unimproved'
         WHEN toilet_source IN {_list(OPEN_DEFECATION)} THEN 'open defecation'
         WHEN toilet_source IN {_list(IMPROVED_TOILETS)} AND share_toilet = 0 THEN 'improved-unshared'
         WHEN toilet_source IN {_list(IMPROVED_TOILETS)} AND share_toilet = 1 THEN 'improved-shared' END AS impr_toilet_type,
    {water} AS improved_water,
    {bottled} AS impr_water_dhs,
    CASE WHEN water_source IN {_list(BOTTLED_WATER)} THEN 'bottled'
         WHEN water_source IN {_list(IMPROVED_WATER)} THEN 'improved'
         WHEN water_source IN {_list(UNIMPROVED_WATER)} THEN 'unimproved' END AS impr_water_type,
    CASE WHEN time2water IS NULL OR water_source IS NULL THEN NULL
         WHEN time2water <= 30 AND water_source IN {_list(IMPROVED_WATER)} THEN 1 ELSE 0 END AS impr_water_under30min"""


def indicators(alternate: bool = False) -> str:
    return households(camps=alternate, top_coded=alternate) + f""",
ind AS (SELECT *, {indicator_columns(alternate)} FROM hh)"""


CHILDREN = f"""
kid0 AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS caseid,
         l_suppkey AS cluster_id, l_linenumber AS hh_num,
         CAST(CAST(round(l_quantity) AS BIGINT) AS DOUBLE) AS sample_wt,
         l_suppkey * 10 + l_orderkey % 10 AS prim_sampling_unit, CAST(l_suppkey % 8 AS INTEGER) AS sample_strata,
         {_URBAN} AS urban, CAST(l_suppkey % 25 AS INTEGER) AS region,
         CAST(month(l_shipdate) AS INTEGER) AS interview_month, {_WEALTH} AS wealth_idx,
         CAST(l_partkey % 60 AS INTEGER) AS age_months,
         CASE WHEN l_partkey % 11 <> 0 THEN CAST(l_partkey % 7 AS INTEGER) END AS age_yrs,
         CASE WHEN l_orderkey % 5 = 0 THEN 9 ELSE CAST(1 + l_orderkey % 2 AS INTEGER) END AS b4,
         CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber = 4 THEN 1 WHEN l_linenumber = 5 THEN 2
              WHEN l_linenumber = 6 THEN 8 END AS h11,
         CASE WHEN l_tax = 0.08e0 THEN 9998 ELSE CAST(l_partkey * 37 % 1000 AS INTEGER) - 600 END AS hw70,
         CASE WHEN l_orderkey % 9 = 0 THEN 1 WHEN l_orderkey % 31 <> 0 THEN 0 END AS hw13,
         CASE n_nationkey WHEN 0 THEN 'aire metropolitaine' WHEN 1 THEN 'grand''anse' WHEN 2 THEN 'reste-ouest'
              ELSE lower(n_name) END AS region_name
  FROM lineitem JOIN nation ON l_suppkey % 25 = n_nationkey
  WHERE l_suppkey % 25 <> 12
),
kid1 AS (
  SELECT *, CASE b4 WHEN 1 THEN 'male' WHEN 2 THEN 'female' END AS sex,
         CASE WHEN h11 IN (1, 2) THEN 1 WHEN h11 = 0 THEN 0 END AS diarrhea,
         hw13 = 0 AS stunting_eligible,
         CASE WHEN hw70 < 9996 THEN hw70 / 1e2 END AS stunting_score
  FROM kid0 WHERE age_yrs < 5
),
kid AS (
  SELECT *, CAST(stunting_score < -2 AS INTEGER) AS stunted, CAST(stunting_score < -3 AS INTEGER) AS sev_stunted FROM kid1
)"""


def estimate(rel: str, var: str, by: str | None, *, sizes: str | None = None, lonely: str = "adjust",
             omit_null: bool = True, deff: bool = False) -> str:
    """SELECT of ``d, avg, se, ci, lb, ub, N, unweighted_avg`` (unrounded) as a subquery."""
    domain = by or "'national'"
    lonely_term = {"adjust": "szz", "remove": "0"}[lonely]
    complete = "TRUE" if omit_null else "n = m"
    return f"""(
  WITH b AS (
    SELECT {domain} AS d, sample_strata AS h, prim_sampling_unit AS c,
           coalesce(sum(sample_wt) FILTER (WHERE {var} IS NOT NULL), 0) AS sw,
           coalesce(sum(sample_wt * {var}), 0) AS swy, coalesce(sum(sample_wt * {var} * {var}), 0) AS swyy,
           count({var}) AS n, count(*) AS m, sum({var}) AS sy
    FROM {rel} GROUP BY ALL
  ),
  s AS (SELECT sample_strata AS h, count(DISTINCT prim_sampling_unit) AS nh FROM {sizes or rel} GROUP BY ALL),
  t AS (
    SELECT d, sum(sw) AS tw, sum(swy) / nullif(sum(sw), 0) AS a, sum(swyy) AS twyy,
           CAST(sum(n) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS m, sum(sy) / nullif(sum(n), 0) AS u
    FROM b GROUP BY ALL
  ),
  z AS (
    SELECT b.d, b.h, sum((swy - a * sw) / tw) AS sz, sum(((swy - a * sw) / tw) ** 2) AS szz
    FROM b JOIN t ON b.d IS NOT DISTINCT FROM t.d GROUP BY ALL
  ),
  v AS (
    SELECT d, sum(CASE WHEN nh = 1 THEN {lonely_term} ELSE nh / (nh - 1) * (szz - sz * sz / nh) END) AS v
    FROM z JOIN s ON z.h = s.h GROUP BY ALL
  ),
  e AS (
    SELECT t.d, CASE WHEN t.d IS NOT NULL AND {complete} THEN a END AS avg,
           CASE WHEN t.d IS NOT NULL AND {complete} AND a IS NOT NULL THEN sqrt(greatest(v, 0)) END AS se,
           {'n' if omit_null else 'm'} AS nn, CASE WHEN {complete} THEN u END AS unweighted_avg, tw, twyy, n AS used
    FROM t JOIN v ON t.d IS NOT DISTINCT FROM v.d
  )
  SELECT d, avg, se, 2 * se AS ci, avg - 2 * se AS lb, avg + 2 * se AS ub, nn AS "N", unweighted_avg
         {', se * se * used / nullif((twyy - avg * avg * tw) / tw * used / nullif(used - 1, 0), 0) AS deff' if deff else ''}
  FROM e WHERE d IS NOT NULL OR nn > 0
)"""


def contract(name: str | None, prefix: str = "") -> str:
    """The rounded estimate columns, domain first."""
    columns = [f"{prefix}d AS {name}"] if name else []
    columns += [r(prefix + c, c) for c in ("avg", "se", "ci", "lb", "ub")]
    return ", ".join([*columns, f'{prefix}"N" AS "N"', r(prefix + "unweighted_avg", "unweighted_avg")])


CASES = """
cases AS (
  SELECT n_name AS Departement, CAST(date_trunc('month', o_orderdate) AS DATE) AS Month,
         CASE WHEN n_nationkey <> 4 THEN count(*) END AS Cases,
         CASE WHEN n_nationkey <> 4 THEN count(*) FILTER (WHERE o_orderstatus = 'F') END AS Deaths
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, n_nationkey, 2
)"""

VERTICES = PLACES + """,
shape AS (
  SELECT *, -74.5e0 + (s_suppkey % 330) / 1e2 AS x, 17.5e0 + (s_suppkey % 280) / 1e2 AS y, (s_suppkey % 5 + 1) / 1e2 AS side
  FROM places
),
piece AS (
  SELECT *, 1 AS piece, x AS px, y AS py, side AS w FROM shape
  UNION ALL SELECT *, 2, x + 2e0, y, side / 4e0 FROM shape WHERE s_suppkey % 3 = 0
),
vertex AS (
  SELECT px + dx * w AS long, py + dy * w AS lat, CAST((piece - 1) * 5 + k AS INTEGER) AS "order", piece,
         s_suppkey || '.' || piece AS "group", s_suppkey AS id, r_name AS A1_Name,
         CASE WHEN n_nationkey = 3 THEN 'L''Artibonite' ELSE r_name END AS NAME_1, n_name AS NAME_2,
         ' ' || s_name || '  ' AS A2_Name,
         CASE n_nationkey WHEN 0 THEN 'Aire Métropolitaine' WHEN 1 THEN 'Grande-Anse' WHEN 2 THEN 'Reste-Ouest'
              ELSE upper(n_name[1]) || lower(n_name[2:]) END AS DHSREGFR
  FROM piece, (VALUES (1, 0e0, 0e0), (2, 0e0, 1e0), (3, 1e0, 1e0), (4, 1e0, 0e0), (5, 0e0, 0e0)) AS corner(k, dx, dy)
)"""

VERTEX_COLUMNS = (
    f"{r('long', 'long')}, {r('lat', 'lat')}, \"order\", piece, \"group\", id, A1_Name, NAME_1, NAME_2, A2_Name, DHSREGFR"
)

LABELS = "label_rows(variable, label, code) AS (VALUES " + ", ".join(
    "('{}', '{}', {})".format(v, label.replace("'", "''"), code)
    for v, labels in (("hv201", WATER_TYPES), ("hv205", TOILET_TYPES))
    for label, code in labels.items()
) + ")"

# Fixed value: first eccentricity of the WGS 84 ellipsoid.
ECCENTRICITY = 0.08181919084262149
# The series of the transverse Mercator projection on that ellipsoid, from n = 0.0016792203863837.
MERCATOR_TERMS = (8.377318206244698e-04, 7.608527773572489e-07, 1.197645503242492e-09, 2.429170607201359e-12, 5.711757677865804e-15, 1.491117731258390e-17)
RECTIFYING_RADIUS = 6367449.145823415


def easting(zone) -> str:
    terms = " + ".join(f"{t!r} * cos({2 * j} * u) * sinh({2 * j} * v)" for j, t in enumerate(MERCATOR_TERMS, 1))
    return f"{zone.false_easting} + {zone.scale * RECTIFYING_RADIUS!r} * (v + {terms})"


def northing(zone) -> str:
    terms = " + ".join(f"{t!r} * sin({2 * j} * u) * cosh({2 * j} * v)" for j, t in enumerate(MERCATOR_TERMS, 1))
    return f"{zone.false_northing} + {zone.scale * RECTIFYING_RADIUS!r} * (u + {terms})"
