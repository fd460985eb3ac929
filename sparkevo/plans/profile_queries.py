"""Profiling, imputation, scaling and splits over lineitem, events, customer and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare, profile
from .registry import query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: events with every seventh value missing; lineitem has no key, so fills and row counts use events.
GAPS_SQL = "(select event_id, user_id, case when event_id % 7 <> 0 then value end as value, cast(user_id as double) as u from events)"


def gaps(t):
    return t("events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.col("user_id").cast("double").alias("u"))


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def each(template: str, columns=LINE) -> str:
    return " union all ".join(template.replace("{c}", c) for c in columns)


STATS_SQL = each(
    "select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std, min({c}) as min, max({c}) as max, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.25) as q25, quantile_cont({c}, 0.75) as q75, count(*) - count({c}) as missing, count(*) filter ({c} = 0) as zeros, count(distinct {c}) as \"unique\" from lineitem"
)
_STATS_ROUND = ["mean", "std", "min", "max", "median", "q25", "q75"]


@query(f"select feature, {', '.join(f'round({c}, 5) as {c}' for c in _STATS_ROUND)}, missing, zeros, \"unique\" from ({STATS_SQL})")
def feature_stats(t):
    return rounded(profile.feature_stats(t("lineitem"), LINE), _STATS_ROUND, 5)


@query(f"select cast(sum(missing) as bigint) as total_missing, count(*) filter (missing > 0) as features_with_missing, count(*) filter (std = 0) as constant_features from ({STATS_SQL})")
def stats_overview(t):
    return profile.stats_overview(profile.feature_stats(t("lineitem"), LINE))


@query(f"select feature, round(std * std, 4) as variance from ({STATS_SQL}) order by std * std desc, feature limit 3")
def top_variance_features(t):
    return rounded(profile.top_variance(profile.feature_stats(t("lineitem"), LINE), 3), ["variance"], 4)


CORR = [*LINE, "net"]
CORR_SQL = " union all ".join([f"select '{a}' as a, '{b}' as b, {'1.0::double' if a == b else f'corr({a}, {b})'} as r from (select *, l_extendedprice * (1 - l_discount) as net from lineitem)" for a in CORR for b in CORR if a != b] + [f"select '{c}', '{c}', 1.0::double" for c in CORR])


def priced(t):
    return t("lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


@query(f"select a, b, round(r, 6) as r from ({CORR_SQL})")
def correlation_matrix(t):
    return rounded(profile.correlations(priced(t), CORR), ["r"])


@query(f"select a, b, round(r, 6) as r from ({CORR_SQL}) where a < b and abs(r) > 0.5")
def high_corr_pairs(t):
    return rounded(profile.high_correlations(profile.correlations(priced(t), CORR), 0.5), ["r"])


@query(
    "with c as (select c_mktsegment as label, count(*) as n from customer group by 1), w as (select sum(n) as s, max(n) as hi, min(n) as lo, (select label from c order by n desc, label limit 1) as major, (select label from c order by n, label limit 1) as minor from c) "
    "select label, n, round(n / s, 6) as share, label = major as is_majority, label = minor as is_minority, round(hi / lo, 6) as ratio from c, w"
)
def class_balance(t):
    return rounded(profile.class_balance(t("customer"), "c_mktsegment"), ["share", "ratio"])


@query("with c as (select toxic as label, count(*) as n from labels group by 1), w as (select sum(n) as s, max(n) as hi, min(n) as lo, (select label from c order by n desc, label limit 1) as major, (select label from c order by n, label limit 1) as minor from c) select label, n, round(n / s, 6) as share, label = major as is_majority, label = minor as is_minority, round(hi / lo, 6) as ratio from c, w")
def imbalance_report(t):
    return rounded(profile.class_balance(t("labels"), "toxic"), ["share", "ratio"])


_IQR = "(select quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from {t})"


@query(each("select '{c}' as feature, count(*) filter ({c} < lo or {c} > hi) as outliers from lineitem, " + _IQR.replace("{k}", "0.25").replace("{t}", "lineitem")))
def outliers_iqr(t):
    return profile.outliers_by_feature(t("lineitem"), LINE, profile.iqr_bounds(t("lineitem"), LINE, 0.25))


@query(each("select '{c}' as feature, count(*) filter ({c} < m - 1.5 * s or {c} > m + 1.5 * s) as outliers from lineitem, (select avg({c}) as m, stddev_pop({c}) as s from lineitem)"))
def outliers_zscore(t):
    return profile.outliers_by_feature(t("lineitem"), LINE, profile.zscore_bounds(t("lineitem"), LINE, 1.5))


@query(f"select event_id, cast(coalesce(value < v.lo or value > v.hi, false) as bigint) + cast(u < w.lo or u > w.hi as bigint) as outliers from {GAPS_SQL} g, " + _IQR.format(c="value", k=0.5, t=GAPS_SQL) + " v, " + _IQR.format(c="u", k=0.2, t=GAPS_SQL) + " w")
def outliers_per_row(t):
    e = gaps(t)
    bounds = profile.iqr_bounds(e, ["value"], 0.5) | profile.iqr_bounds(e, ["u"], 0.2)
    return profile.outliers_by_row(e, ["value", "u"], bounds, ["event_id"])


_MISSING = "select '{c}' as feature, count(*) filter ({c} is null or isnan({c})) as nan_count, count(*) filter (isinf({c})) as inf_count, count(*) filter ({c} is null or isnan({c}) or isinf({c})) as missing, round(100.0 * count(*) filter ({c} is null or isnan({c}) or isinf({c})) / count(*), 6) as percent from {t}"


@query(each(_MISSING.replace("{t}", GAPS_SQL), ["value", "u"]))
def missing_profile(t):
    return rounded(profile.missing_by_feature(gaps(t), ["value", "u"]), ["percent"])


_WILD = "(select event_id, case event_id % 5 when 0 then null when 1 then 'nan'::double when 2 then 'infinity'::double else value end as value, case when event_id % 3 = 0 then '-infinity'::double else cast(user_id as double) end as u from events)"


@query(each(_MISSING.replace("{t}", _WILD), ["value", "u"]))
def detect_missing(t):
    wild = F.when(F.col("event_id") % 5 == 1, F.lit(float("nan"))).when(F.col("event_id") % 5 == 2, F.lit(float("inf"))).when(F.col("event_id") % 5 != 0, F.col("value"))
    u = F.when(F.col("event_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("user_id").cast("double"))
    return rounded(profile.missing_by_feature(t("events").select("event_id", wild.alias("value"), u.alias("u")), ["value", "u"]), ["percent"])


@query(f"select event_id, cast(value is null as bigint) + cast(u is null as bigint) as missing from {GAPS_SQL}")
def missing_per_row(t):
    return profile.missing_by_row(gaps(t), ["value", "u"], ["event_id"])


@query(each("select '{c}' as feature, cast(least(floor(({c} - lo) / (hi - lo) * 30), 29) as integer) as bin, count(*) as n from lineitem, (select min({c}) as lo, max({c}) as hi from lineitem) group by 1, 2"))
def histogram_30(t):
    return profile.histogram(t("lineitem"), LINE)


# --- imputation ----------------------------------------------------------------------------------


def _impute(strategy: str):
    return lambda t: rounded(prepare.Imputer(["value", "u"], strategy).fit_transform(gaps(t)), ["value", "u"]).drop("user_id")


def _impute_sql(filler: str) -> str:
    return f"select event_id, round(coalesce(value, {filler}), 6) as value, round(u, 6) as u from {GAPS_SQL}"


query(_impute_sql(f"(select avg(value) from {GAPS_SQL})"), "impute_mean")(_impute("mean"))
query(_impute_sql(f"(select quantile_cont(value, 0.5) from {GAPS_SQL})"), "impute_median")(_impute("median"))
query(_impute_sql(f"(select value from {GAPS_SQL} where value is not null group by value order by count(*) desc, value limit 1)"), "impute_mode")(_impute("mode"))
query(_impute_sql("0.0"), "impute_constant")(_impute("constant"))
query(f"select event_id, round(value, 6) as value, round(u, 6) as u from {GAPS_SQL} where value is not null", "impute_drop")(_impute("drop"))


def _ends(first: str, then: str) -> str:
    last = "last_value(value ignore nulls) over (order by event_id rows between unbounded preceding and current row)"
    after = "first_value(value ignore nulls) over (order by event_id rows between current row and unbounded following)"
    a, b = (last, after) if first == "f" else (after, last)
    return f"select event_id, round(coalesce({a}, {b}), 6) as value from {GAPS_SQL}"


@query(_ends("f", "b"))
def impute_ffill(t):
    return rounded(prepare.filled_over_all(gaps(t), "value", "event_id"), ["value"]).select("event_id", "value")


@query(_ends("b", "f"))
def impute_bfill(t):
    return rounded(prepare.filled_over_all(gaps(t), "value", "event_id", forward=False), ["value"]).select("event_id", "value")


# --- scaling -------------------------------------------------------------------------------------

PRICES = ["o_totalprice"]


def _scale(kind: str, **options):
    return lambda t: rounded(prepare.Scaler(PRICES, kind, **options).fit_transform(t("orders")), PRICES).select("o_orderkey", *PRICES)


def _scale_sql(expr: str, stats: str) -> str:
    return f"select o_orderkey, round({expr}, 6) as o_totalprice from orders, (select {stats} from orders)"


query(_scale_sql("(o_totalprice - m) / s", "avg(o_totalprice) as m, stddev_pop(o_totalprice) as s"), "scale_standard")(_scale("standard"))
query(_scale_sql("(o_totalprice - lo) * 4.0 / (hi - lo) - 1", "min(o_totalprice) as lo, max(o_totalprice) as hi"), "scale_minmax")(_scale("minmax", low=-1.0, high=3.0))
query(_scale_sql("(o_totalprice - m) / (b - a)", "quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as m, quantile_cont(o_totalprice, 0.75) as b"), "scale_robust")(_scale("robust"))
query(_scale_sql("o_totalprice / m", "max(abs(o_totalprice)) as m"), "scale_maxabs")(_scale("maxabs"))


@query("select kind, count(*) as n, 0.0::double as error from orders, (values ('standard'), ('minmax'), ('robust'), ('maxabs')) k(kind) group by 1")
def scale_roundtrip(t):
    """Greatest error of scaling and back, rounded to 6 digits, per scaler."""
    out = None
    for kind in ("standard", "minmax", "robust", "maxabs"):
        orders = t("orders").select("o_orderkey", *PRICES, F.col(PRICES[0]).alias("was"))
        s = prepare.get_scaler(kind, PRICES).fit(orders)
        error = s.inverse_transform(s.transform(orders)).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col(PRICES[0]) - F.col("was"))), 6).alias("error")).select(F.lit(kind).alias("kind"), "n", "error")
        out = error if out is None else out.unionByName(error)
    return out


# --- splits --------------------------------------------------------------------------------------

_RANK = "row_number() over (partition by c_mktsegment order by md5('42:'||cast(c_custkey as varchar)), c_custkey)"


@query(f"select c_custkey, c_mktsegment, cast(({_RANK} - 1) % 5 as integer) as fold from customer")
def stratified_kfold(t):
    return prepare.stratified_folds(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query(f"select c_custkey, c_mktsegment, {_RANK} <= floor(count(*) over (partition by c_mktsegment) * 0.2 + 0.5) as is_test from customer")
def stratified_split(t):
    return prepare.stratified_split(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")
