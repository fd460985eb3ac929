"""Metrics of hash-made predictions for labels and embeddings, and paired tests of monthly order values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform, uniform_sql
from ..operators import metrics
from ..operators import tests as paired_tests
from .profile_queries import rounded
from .registry import query

#: prob has 1,000 distinct values at most, so that ties occur.
_U = uniform_sql(42, "doc_id")
_P = f"floor(({_U} * 0.7 + toxic * 0.3) * 1000) / 1000"
PREDS_SQL = f"(select doc_id, toxic as label, {_P} as prob, cast({_P} >= 0.5 as integer) as prediction from labels)"


def preds(t):
    prob = F.floor((uniform(42, F.col("doc_id")) * 0.7 + F.col("toxic") * 0.3) * 1000) / 1000
    return t("labels").select("doc_id", F.col("toxic").alias("label"), prob.alias("prob")).withColumn("prediction", (F.col("prob") >= 0.5).cast("int"))


_V = uniform_sql(7, "vec_id")
CLASSES_SQL = f"(select vec_id, label, case when {_V} < 0.6 then label else cast(floor({_V} * 10) as integer) end as prediction from embeddings)"


def classes(t):
    u = uniform(7, F.col("vec_id"))
    return t("embeddings").select("vec_id", "label", F.when(u < 0.6, F.col("label")).otherwise(F.floor(u * 10).cast("int")).alias("prediction"))


def per_class_sql(source: str) -> str:
    return (
        f"select c as label, coalesce(hit / nullif(said, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall, coalesce(2.0 * hit / nullif(said + support, 0), 0) as f1, support from "
        f"(select c, (select count(*) from {source} where label = c and prediction = c) as hit, (select count(*) from {source} where prediction = c) as said, (select count(*) from {source} where label = c) as support "
        f"from (select label as c from {source} union select prediction from {source}))"
    )


PRF = ["precision", "recall", "f1"]
_ROUND_PRF = ", ".join(f"round({c}, 6) as {c}" for c in PRF)


@query(f"select count(*) as n, round(avg(cast(label = prediction as double)), 6) as accuracy from {PREDS_SQL}")
def m_accuracy(t):
    return rounded(metrics.accuracy(preds(t)), ["accuracy"])


@query(f"with p as {CLASSES_SQL}, c as (select label as v from p union select prediction from p) select a.v as label, b.v as prediction, (select count(*) from p where label = a.v and prediction = b.v) as n from c a, c b")
def m_confusion(t):
    return metrics.confusion(classes(t))


@query(f"select label, {_ROUND_PRF}, support from ({per_class_sql(CLASSES_SQL)})")
def m_per_class(t):
    return rounded(metrics.per_class(classes(t)), PRF)


def _averages_sql(source: str) -> str:
    macro = ", ".join(f"avg({c}) as {c}" for c in PRF)
    weighted = ", ".join(f"sum({c} * support) / sum(support) as {c}" for c in PRF)
    return f"select 'macro' as kind, {macro}, cast(sum(support) as bigint) as support from ({per_class_sql(source)}) union all select 'weighted', {weighted}, cast(sum(support) as bigint) from ({per_class_sql(source)})"


@query(f"select kind, {_ROUND_PRF}, support from ({_averages_sql(CLASSES_SQL)})")
def m_macro_weighted(t):
    return rounded(metrics.averages(classes(t)), PRF)


@query(f"select kind, {_ROUND_PRF}, support from (select cast(label as varchar) as kind, precision, recall, f1, support from ({per_class_sql(CLASSES_SQL)}) union all {_averages_sql(CLASSES_SQL)} union all select 'accuracy', a, a, a, n from (select avg(cast(label = prediction as double)) as a, count(*) as n from {CLASSES_SQL}))")
def m_report(t):
    return rounded(metrics.report(classes(t)), PRF)


@query(f"select {_ROUND_PRF} from ({per_class_sql(PREDS_SQL)}) where label = 1")
def m_binary(t):
    return rounded(metrics.binary(preds(t)), PRF)


@query(f"select round(avg(recall), 6) as balanced_accuracy from ({per_class_sql(CLASSES_SQL)}) where support > 0")
def m_balanced_accuracy(t):
    return rounded(metrics.balanced_accuracy(classes(t)), ["balanced_accuracy"])


def _auc_sql(source: str, score: str = "prob", positive: str = "label = 1") -> str:
    return f"(select (sum(rk) filter (is_pos) - count(*) filter (is_pos) * (count(*) filter (is_pos) + 1) / 2) / nullif(count(*) filter (is_pos) * count(*) filter (not is_pos), 0) as auc, count(*) filter (is_pos) as support from (select {positive} as is_pos, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2 as rk from {source}))"


@query(f"select round(auc, 6) as roc_auc from {_auc_sql(PREDS_SQL)}")
def m_roc_auc(t):
    return rounded(metrics.roc_auc(preds(t)), ["roc_auc"])


def _class_score_sql(c: int) -> str:
    return f"floor(({uniform_sql(f'ovr{c}', 'vec_id')} + case when label = {c} then 0.3 else 0 end) * 1000) / 1000"


@query("select round(sum(auc * support) / sum(support), 6) as roc_auc from (" + " union all ".join(f"select auc, support from {_auc_sql(f'(select label, {_class_score_sql(c)} as s from embeddings)', 's', f'label = {c}')}" for c in range(10)) + ")")
def m_roc_auc_ovr(t):
    score = [F.floor((uniform(f"ovr{c}", F.col("vec_id")) + F.when(F.col("label") == c, 0.3).otherwise(0.0)) * 1000) / 1000 for c in range(10)]
    return rounded(metrics.roc_auc_ovr(t("embeddings").select("label", F.array(*score).alias("probs"))), ["roc_auc"])


_CURVE = f"(select prob, sum(sum(label)) over (order by prob desc) as tp, sum(sum(1 - label)) over (order by prob desc) as fp, sum(label) as pos from {PREDS_SQL} group by prob)"


@query(f"with w as (select sum(label) as p, sum(1 - label) as n from {PREDS_SQL}) select prob as threshold, round(fp / n, 6) as fpr, round(tp / p, 6) as tpr from {_CURVE}, w union all select null, 0.0, 0.0")
def m_roc_curve(t):
    return rounded(metrics.roc_curve(preds(t)), ["fpr", "tpr"])


@query(f"select round(sum(pos * tp / (tp + fp)) / (select sum(label) from {PREDS_SQL}), 6) as average_precision from {_CURVE}")
def m_average_precision(t):
    return rounded(metrics.average_precision(preds(t)), ["average_precision"])


@query(f"select round((select avg(cast(label = prediction as double)) from {PREDS_SQL}), 6) as accuracy, {_ROUND_PRF}, round((select auc from {_auc_sql(PREDS_SQL)}), 6) as roc_auc from ({_averages_sql(PREDS_SQL)}) where kind = 'weighted'")
def m_summary(t):
    return rounded(metrics.summary(preds(t)), ["accuracy", *PRF, "roc_auc"])


@query(
    f"select round(a, 6) as accuracy, round(b, 6) as baseline, abs(a - b) < 0.01 as degenerate, case when r < 0.1 then 'poor' when r < 0.5 then 'partial' else 'good' end as minority from "
    f"(select avg(cast(label = prediction as double)) as a, greatest(avg(label), 1 - avg(label)) as b, avg(prediction) filter (label = 1) as r from {PREDS_SQL})"
)
def m_majority_baseline(t):
    return rounded(metrics.majority_baseline(preds(t)), ["accuracy", "baseline"])


# --- paired tests: monthly mean order values by priority ---------------------------------------

SCORES_SQL = "(select o_orderpriority as model, cast(strftime(o_orderdate, '%Y%m') as integer) as fold, round(avg(o_totalprice), 2) as score from orders group by 1, 2)"
BASELINE = "1-URGENT"
PAIRS_SQL = f"(select a.model, a.fold, a.score, b.score as base, a.score - b.score as d from {SCORES_SQL} a join {SCORES_SQL} b using (fold) where b.model = (select min(o_orderpriority) from orders) and a.model <> b.model)"


def scores(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("model"), F.date_format("o_orderdate", "yyyyMM").cast("int").alias("fold")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))


def pairs(t):
    s = scores(t)
    return paired_tests.paired(s, s.agg(F.min("model")).first()[0])


_T = "count(*) as n, avg(d) as mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) as t"
_W = f"(select model, count(*) as n, sum(case when d > 0 then rk when d = 0 then rk / 2 else 0 end) as w_plus, sum(case when d < 0 then rk when d = 0 then rk / 2 else 0 end) as w_minus from (select model, d, rank() over (partition by model order by abs(d)) + (count(*) over (partition by model, abs(d)) - 1) / 2 as rk from {PAIRS_SQL}) group by 1)"
_D = f"(select model, (avg(score) - avg(base)) / sqrt((var_samp(score) + var_samp(base)) / 2) as d from {PAIRS_SQL} group by 1)"
_LABEL = "case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as effect"


@query(f"select model, n, round(mean_diff, 4) as mean_diff, round(t, 5) as t from (select model, {_T} from {PAIRS_SQL} group by 1)")
def t_paired(t):
    return rounded(rounded(paired_tests.paired_t(pairs(t)), ["mean_diff"], 4), ["t"], 5)


@query(f"select model, n, w_plus, w_minus, least(w_plus, w_minus) as w from {_W}")
def t_wilcoxon(t):
    return paired_tests.wilcoxon(pairs(t))


@query(f"select model, round(d, 6) as d, {_LABEL} from {_D}")
def t_cohens_d(t):
    return rounded(paired_tests.cohens_d(pairs(t)), ["d"])


@query(f"select a.model, a.n, round(mean_diff, 4) as mean_diff, round(t, 5) as t, least(w_plus, w_minus) as w, round(d, 6) as d, {_LABEL} from (select model, {_T} from {PAIRS_SQL} group by 1) a join {_W} b using (model) join {_D} c using (model)")
def t_compare(t):
    s = scores(t)
    return rounded(rounded(rounded(paired_tests.compare(s, s.agg(F.min("model")).first()[0]), ["mean_diff"], 4), ["t"], 5), ["d"])
