"""Design-weighted means with linearised standard errors, for many domains at once.

For domain d with rows i that have a value, ``avg = sum(w*y) / sum(w) = A/W`` and PSU c of
stratum h contributes ``z = (A_c - avg * W_c) / W``. The variance is
``sum_h n_h/(n_h-1) * (sum z^2 - (sum z)^2 / n_h)``, n_h being the number of PSUs of the
stratum in the whole design. PSUs without rows in the domain have z = 0, so they
need no rows of their own. (Binder 1983; Lumley 2004, J. Stat. Softw. 9(8).)

z is taken around the domain's own mean, not as a difference of larger sums, so domains whose
means lie far apart keep all digits of their standard errors.

Shape of the work:

1. one pass over the facts to PSU totals at the finest grouping of each family of domain columns (map-side combined);
2. roll-up of that reduced table to every requested domain column, then staged, one row per domain and PSU with a
   column per indicator and sum;
3. domain sums and means, joined back to the staged totals, then sums per domain and stratum
   with n_h beside them, then per domain; only then a row per indicator.

All aggregations are hash aggregations with partial sums and there is no window. The join in step 3 is an inner
join of reduced rows with one row per domain: it is broadcast while that table is small, and a domain that
holds most PSUs is the large side, which AQE may split.

A family is a set of domain columns that nest or follow from one another, such as the levels of a geography: its
coarser columns are derived from its finest grouping. Columns that cut across PSUs, such as age groups, belong in
families of their own. The facts are still read once, each row counting once for every family, and the reduced table grows
with the sum of the families' groupings, never with their product. :func:`domain_families` finds the families.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspan.operators.design import SurveyDesign
from surveyspan.operators.joins import lookup_join, quoted
from surveyspan.staging import stage

NATIONAL = "national"
_KEY = ["variable", "by_var", "domain"]
_SUMS = ["sw", "swy", "sy", "n_values"]
CONTRACT = ["avg", "se", "ci", "lb", "ub", "N", "unweighted_avg"]


def _required(name: str, role: str) -> Column:
    return F.coalesce(quoted(name), F.raise_error(F.lit(f"NULL {role} in design column {name}")))


def _families(by: Sequence[str], families: Sequence[Sequence[str]] | None) -> list[list[str]]:
    if families is None:
        return [list(by)]
    named = [b for family in families for b in family]
    if sorted(named) != sorted(by):
        raise ValueError(f"families must name every domain column once: {list(by)}")
    return [list(f) for f in families if f] or [[]]


def wide_totals(
    df: DataFrame,
    design: SurveyDesign,
    variables: Sequence[str],
    by: Sequence[str] = (),
    attach: DataFrame | None = None,
    on: Sequence[str] = (),
    squares: bool = False,
    families: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """PSU totals per domain, the only step that reads ``df``.

    Rows: ``by_id, domain, stratum, psu, n_rows`` and for indicator j the weighted and plain sums ``sw<j>, swy<j>, sy<j>,
    n_values<j>``. ``by_id`` is the place of the domain column in ``by``; the whole design is ``-1``. Rows without a
    value are kept (with empty sums), because n_h counts every PSU.

    The first aggregation groups by all columns of a ``family`` together (by default all of ``by`` are one): geographies
    nest, so it leaves about one row per PSU, and the domain roll-up multiplies only those.

    ``attach`` is a dimension that supplies some of the domain columns, matched ``on``
    its unique key. It is joined to the reduced table, so the facts meet no join.
    ``squares`` adds the weighted sum of squares that the design effect needs.
    """
    late = [b for b in by if attach is not None and b not in df.columns]
    early = [b for b in by if b not in late]
    keys = list(on) if late else []
    names = [*variables, *early, *keys, design.psu, design.stratum, design.weight]
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {absent}")
    if late and not keys:
        raise ValueError("attach needs the key columns in `on`")
    if NATIONAL in by:
        raise ValueError(f"'{NATIONAL}' is reserved for the whole design")
    parts = _families(by, families)

    w = F.col("_w")
    facts = df.select(
        *[quoted(b).cast("string").alias(f"_d{by.index(b)}") for b in early],
        *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        _required(design.stratum, "stratum").alias("stratum"),
        _required(design.psu, "PSU").alias("psu"),
        _required(design.weight, "weight").cast("double").alias("_w"),
        *[quoted(v).cast("double").alias(f"_y{j}") for j, v in enumerate(variables)],
    )
    sums = [F.count("*").alias("n_rows")]
    for j in range(len(variables)):
        y = F.col(f"_y{j}")
        sums += [
            F.sum(F.when(y.isNotNull(), w)).alias(f"sw{j}"),
            F.sum(w * y).alias(f"swy{j}"),
            F.sum(y).alias(f"sy{j}"),
            F.count(y).alias(f"n_values{j}"),
        ]
        if squares:
            sums.append(F.sum(w * y * y).alias(f"swyy{j}"))
    columns = [c for j in range(len(variables)) for c in _sum_names(j, squares)]

    def grouping(family: list[str]) -> list[str]:
        own = [f"_d{by.index(b)}" for b in family if b in early]
        return [*own, *([f"_k{i}" for i in range(len(keys))] if set(family) & set(late) else []), "stratum", "psu"]

    if len(parts) == 1:
        finest = facts.groupBy(*grouping(parts[0])).agg(*sums).withColumn("_family", F.lit(0))
    else:
        wanted = [grouping(f) for f in parts]
        every = [c for c in facts.columns if any(c in g for g in wanted)]
        grouped = facts.groupingSets([[F.col(c) for c in g] for g in wanted], *[F.col(c) for c in every])
        # each family's grouping id: one bit per column left out, in the order of the columns
        ids = [sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in g) for g in wanted]
        finest = grouped.agg(*sums, F.grouping_id().alias("_gid")).withColumn(
            "_family", F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("_gid")) - 1
        )
    if late:
        places = attach.select(
            *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            *[quoted(b).cast("string").alias(f"_d{by.index(b)}") for b in late],
        )
        place_keys = [f"_k{i}" for i in range(len(keys))]
        finest = lookup_join(finest, places, place_keys)

    def member(place: int, value: Column) -> Column:
        return F.struct(F.lit(place).alias("by_id"), value.alias("domain"))

    whole = member(-1, F.lit(NATIONAL))
    members = [
        F.array(*([whole] if n == 0 else []), *[member(by.index(b), F.col(f"_d{by.index(b)}")) for b in family])
        for n, family in enumerate(parts)
    ]
    own = members[0]
    for n, some in enumerate(members[1:], 1):
        own = F.when(F.col("_family") == n, some).otherwise(own)
    rolled = (
        finest.select(F.explode(own).alias("m"), "stratum", "psu", *columns, "n_rows")
        .groupBy("m.by_id", "m.domain", "stratum", "psu")
        .agg(*[F.sum(c).alias(c) for c in [*columns, "n_rows"]])
    )
    return rolled.select(
        "by_id", "domain", "stratum", "psu", "n_rows", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]
    )


def _sum_names(j: int | str, squares: bool) -> list[str]:
    return [f"{s}{j}" for s in [*_SUMS, *(["swyy"] if squares else [])]]


def _by_name(by: Sequence[str]) -> Column:
    return F.element_at(F.array(F.lit(NATIONAL), *[F.lit(b) for b in by]), F.col("by_id") + 2)


def cluster_totals(
    df: DataFrame,
    design: SurveyDesign,
    variables: Sequence[str],
    by: Sequence[str] = (),
    attach: DataFrame | None = None,
    on: Sequence[str] = (),
    squares: bool = False,
    families: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """:func:`wide_totals` in long form: ``variable, by_var, domain, stratum, psu``, the sums and ``n_rows``.

    The whole design appears as ``by_var = domain = 'national'``.
    """
    wide = wide_totals(df, design, variables, by, attach, on, squares, families)
    kept = _sum_names("", squares)
    indicators = F.array(
        *[F.struct(F.lit(v).alias("variable"), *[F.col(f"{s}{j}").alias(s) for s in kept]) for j, v in enumerate(variables)]
    )
    return wide.select(
        F.explode(indicators).alias("i"), _by_name(by).alias("by_var"), "domain", "stratum", "psu", "n_rows"
    ).select("i.variable", "by_var", "domain", "stratum", "psu", *[f"i.{s}" for s in kept], "n_rows")


def domain_families(df: DataFrame, design: SurveyDesign, by: Sequence[str]) -> list[list[str]]:
    """The families of some domain columns, found from the data in one narrow pass.

    Columns that are constant inside every PSU form one family. Every other column leads a family or joins that of
    the column that determines it. Only distinct pairs of values are counted, by one grouping per pair of columns.
    """
    names = [design.psu, *by]
    pairs = [(a, b) for a in range(len(names)) for b in range(1, len(names)) if a != b]
    if not pairs:
        return [[]]
    narrow = df.select(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    every = [F.col(f"c{i}") for i in range(len(names))]
    sets = sorted({tuple(sorted(p)) for p in pairs})
    combos = narrow.groupingSets([[F.col(f"c{i}") for i in s] for s in sets], *every).agg(F.grouping_id().alias("gid"))
    ids = {s: sum(1 << (len(names) - 1 - i) for i in range(len(names)) if i not in s) for s in sets}
    directed = F.array(
        *[
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(ids[tuple(sorted((a, b)))]).cast("long").alias("gid"), F.col(f"c{a}").alias("value")
            )
            for a, b in pairs
        ]
    )
    each = combos.select("gid", F.explode(directed).alias("p")).filter(F.col("gid") == F.col("p.gid"))
    widest = each.groupBy("p.a", "p.b", "p.value").count().groupBy("a", "b").agg(F.max("count").alias("n"))
    follows = {(r["a"], r["b"]) for r in widest.collect() if r["n"] == 1}  # one row per pair of columns
    inside = [b for b in range(1, len(names)) if (0, b) in follows]
    crossing = [b for b in range(1, len(names)) if b not in inside]
    out: list[list[int]] = [inside] if inside else []
    # a column that determines others stands before them
    for b in sorted(crossing, key=lambda x: (-sum((x, y) in follows for y in crossing), x)):
        home = next((f for f in out if f is not inside and (f[0], b) in follows), None)
        if home is None:
            out.append([b])
        else:
            home.append(b)
    return [[names[i] for i in f] for f in out]


def stratum_sizes(totals: DataFrame) -> DataFrame:
    """n_h of the whole design, from either form of the totals."""
    whole = totals.filter(F.col("by_id") == -1 if "by_id" in totals.columns else F.col("by_var") == NATIONAL)
    return whole.select("stratum", "psu").distinct().groupBy("stratum").agg(F.count("psu").alias("n_psu"))


def population_sizes(population: DataFrame, design: SurveyDesign) -> DataFrame:
    """n_h of a population other than the estimation rows, e.g. before subsetting."""
    frame = population.select(
        _required(design.stratum, "stratum").alias("stratum"), _required(design.psu, "PSU").alias("psu")
    )
    return frame.distinct().groupBy("stratum").agg(F.count("psu").alias("n_psu"))


def _stratum_variance(lonely_psu: str, j: str) -> Column:
    """What a stratum adds to a domain's variance, from the sums ``z<j>`` and ``zz<j>`` of its PSUs."""
    n, z, zz = F.col("n_psu"), F.col(f"z{j}"), F.col(f"zz{j}")
    lonely = zz if lonely_psu == "adjust" else F.lit(0.0)
    if lonely_psu == "fail":
        message = F.concat(F.lit("only one PSU in stratum "), F.col("stratum").cast("string"))
        lonely = F.raise_error(message).cast("double")
    message = F.concat(F.lit("stratum absent from the design: "), F.col("stratum").cast("string"))
    unknown = F.raise_error(message).cast("double")
    spread = n / F.nullif(n - 1, F.lit(0)) * (zz - z * z / n)
    # rounding can leave a tiny negative number where the PSUs do not differ
    return F.when(n.isNull(), unknown).when(n == 1, lonely).otherwise(F.greatest(spread, F.lit(0.0)))


def _with_spread(totals: DataFrame, design: SurveyDesign, sizes: DataFrame, keys: list[str], suffixes: list[str], squares: bool) -> DataFrame:
    """Per domain: its sums, mean ``_mean<j>`` and variance ``spread<j>`` of each indicator."""
    kept = [c for j in suffixes for c in _sum_names(j, squares)]
    domains = totals.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        *[F.sum(c).alias(f"_{c}") for c in [*kept, "n_rows"]]
    )
    means = domains.withColumns({f"_mean{j}": F.try_divide(f"_swy{j}", f"_sw{j}") for j in suffixes})
    own = F.col("domain").eqNullSafe(F.col("_domain"))
    for k in keys:
        own = own if k == "domain" else (F.col(k) == F.col(f"_{k}")) & own
    carried = [F.any_value(c).alias(c) for c in means.columns if c not in [f"_{k}" for k in keys]]
    per_stratum = (
        totals.select(*keys, "stratum", *[f"{s}{j}" for j in suffixes for s in ("sw", "swy")])
        .join(means, own)
        .withColumns({f"z{j}": F.try_divide(F.expr(f"swy{j} - _mean{j} * sw{j}"), F.col(f"_sw{j}")) for j in suffixes})
        .groupBy(*keys, "stratum")
        .agg(*[x for j in suffixes for x in (F.sum(f"z{j}").alias(f"z{j}"), F.sum(F.expr(f"z{j} * z{j}")).alias(f"zz{j}"))], *carried)
    )
    sized = per_stratum.join(sizes.withColumnRenamed("stratum", "_h"), F.col("stratum") == F.col("_h"), "left")
    return (
        sized.withColumns({f"spread{j}": _stratum_variance(design.lonely_psu, j) for j in suffixes})
        .groupBy(*keys)
        .agg(*[F.sum(f"spread{j}").alias(f"spread{j}") for j in suffixes], *carried)
    )


def estimates(
    totals: DataFrame,
    design: SurveyDesign,
    *,
    sizes: DataFrame | None = None,
    omit_null: bool = True,
    ci_factor: float = 2.0,
    deff: bool = False,
    variables: Sequence[str] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Estimates from (staged) PSU totals, one row per indicator and domain value.

    The totals are those of :func:`cluster_totals` or, with the ``variables`` and ``by`` they were made for,
    of :func:`wide_totals`. A NULL domain value has no estimate but keeps its sample size and plain mean.
    With ``omit_null=False`` one missing value makes the whole domain missing.
    """
    sizes = stratum_sizes(totals) if sizes is None else sizes
    kept = [*_sum_names("", deff), "mean"]
    if variables is None:
        spread = _with_spread(totals, design, sizes, _KEY, [""], deff)
        summed = spread.select(
            *_KEY, "spread", *[F.col(f"_{c}").alias("own_mean" if c == "mean" else c) for c in kept], F.col("_n_rows").alias("n_rows")
        )
    else:
        spread = _with_spread(totals, design, sizes, ["by_id", "domain"], [str(j) for j in range(len(variables))], deff)
        indicators = F.array(
            *[
                F.struct(
                    F.lit(v).alias("variable"), F.col(f"spread{j}").alias("spread"), *[F.col(f"_{c}{j}").alias("own_mean" if c == "mean" else c) for c in kept]
                )
                for j, v in enumerate(variables)
            ]
        )
        exploded = spread.select(_by_name(by).alias("by_var"), "domain", F.col("_n_rows").alias("n_rows"), F.explode(indicators).alias("i"))
        summed = exploded.select(
            F.col("i.variable").alias("variable"), "by_var", "domain", "i.spread", *[F.col("i.own_mean" if c == "mean" else f"i.{c}") for c in kept], "n_rows"
        )
    complete = F.lit(True) if omit_null else F.col("n_values") == F.col("n_rows")
    means = summed.select(
        "*",
        F.when(complete, F.col("own_mean")).alias("mean"),
        F.when(complete, F.try_divide("sy", "n_values")).alias("unweighted_avg"),
        (F.col("n_values") if omit_null else F.col("n_rows")).alias("N"),
    )
    se = F.sqrt("spread")
    known = F.col("domain").isNotNull()
    with_se = means.filter(known | (F.col("N") > 0)).withColumns(
        {
            "avg": F.when(known, F.col("mean")),
            "se": F.when(known & F.col("mean").isNotNull(), se),
        }
    )
    ci = F.col("se") * F.lit(float(ci_factor))
    result = with_se.withColumns({"ci": ci, "lb": F.col("avg") - ci, "ub": F.col("avg") + ci})
    if deff:
        # se^2 over the variance of the mean of a simple sample of the same size.
        simple = F.expr("try_divide(try_divide(swyy - avg * avg * sw, sw) * n_values, n_values - 1)")
        result = result.withColumn("deff", F.try_divide(F.expr("se * se * n_values"), simple))
    return result.select(*_KEY, *CONTRACT, *(["deff"] if deff else []))


def estimate_many(
    df: DataFrame,
    design: SurveyDesign,
    variables: Sequence[str],
    by: Sequence[str],
    *,
    attach: DataFrame | None = None,
    on: Sequence[str] = (),
    population: DataFrame | None = None,
    omit_null: bool = True,
    ci_factor: float = 2.0,
    deff: bool = False,
    families: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Several indicators for the whole design and for every domain column, from one scan.

    ``attach``/``on`` and ``families`` (sets of domain columns that nest): see :func:`wide_totals`.
    ``population`` is the table the design was declared on, when ``df`` is a
    subset of it (domain estimation). Left out, the design is ``df`` itself.
    """
    totals = stage(wide_totals(df, design, variables, by, attach, on, squares=deff, families=families))
    sizes = None if population is None else population_sizes(population, design)
    return estimates(
        totals, design, sizes=sizes, omit_null=omit_null, ci_factor=ci_factor, deff=deff, variables=variables, by=by
    )


def domain_table(many: DataFrame, variable: str, by: str | None, domain_type: str = "string") -> DataFrame:
    """One indicator and one domain column of :func:`estimate_many`, in contract form."""
    chosen = many.filter((F.col("variable") == variable) & (F.col("by_var") == (by or NATIONAL)))
    rest = [c for c in many.columns if c not in _KEY]
    keys = [F.col("domain").cast(domain_type).alias(by)] if by else []
    return chosen.select(*keys, *rest)


def point_estimate(
    df: DataFrame,
    design: SurveyDesign,
    var: str,
    by: str | None = None,
    *,
    attach: DataFrame | None = None,
    on: Sequence[str] = (),
    population: DataFrame | None = None,
    omit_null: bool = True,
    ci_factor: float = 2.0,
    deff: bool = False,
) -> DataFrame:
    """``<by>, avg, se, ci, lb, ub, N, unweighted_avg`` for one indicator.

    Without ``by`` the table has one row, the whole design. No order is promised;
    use ``order.descending(table, "avg")`` for the ranked form.
    """
    many = estimate_many(
        df, design, [var], [by] if by else [],
        attach=attach, on=on, population=population, omit_null=omit_null, ci_factor=ci_factor, deff=deff,
    )
    source = attach if by and by not in df.columns else df
    kind = source.schema[by].dataType.simpleString() if by else "string"
    return domain_table(many, var, by, kind)
