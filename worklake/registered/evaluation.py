"""Threshold, ranking metrics, drift, gate rules, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.functions.arrays import as_doubles
from worklake.functions.scalars import hash_unit
from worklake.operators import drift as R
from worklake.operators import evaluate as E
from worklake.operators import governance as G
from worklake.operators import training
from worklake.operators.latest import flag_latest
from worklake.operators.outcomes import trial_evidence
from worklake.operators.quantiles import exact_quantiles
from worklake.operators.sampling import group_split
from worklake.registered.base import cte, query, table
from worklake.registered.drifting import REPORT as _REPORT
from worklake.registered.drifting import psi_sql
from worklake.registered.frames import sql_hash
from worklake.registered.reporting import model_daily, model_events
from worklake.session import materialize

# Scores with two digits, so that ties occur; the positives score higher on average.
cte("judged", f"""SELECT doc_id, quality AS y, round(CASE WHEN quality = 1 THEN 0.25 + 0.75 * p ELSE 0.85 * p END, 2) AS s FROM (
  SELECT doc_id, quality, {sql_hash("'judge:' || doc_id")} AS p FROM labels)""")


def judged(spark, sf):
    p = hash_unit(F.lit("judge"), F.col("doc_id").cast("string"))
    s = F.round(F.when(F.col("quality") == 1, 0.25 + 0.75 * p).otherwise(0.85 * p), 2)
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"), s.alias("s"))


cte("threshold", """SELECT coalesce((SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM {judged} WHERE y = 1)
  WHERE i = (SELECT floor((1 - CAST(0.95 AS DOUBLE)) * count(*)) FROM {judged} WHERE y = 1)), 0.5) AS threshold""")


@query("choose_threshold", "SELECT threshold FROM {threshold}")
def choose_threshold(spark, sf):
    return E.choose_threshold(judged(spark, sf), "y", "s", 0.95)


@query("classification_metrics", """SELECT n, round(prevalence, 6) AS prevalence, tp, fp, tn, fn, round(sens, 6) AS sensitivity, round(spec, 6) AS specificity,
  round(prec, 6) AS precision, round(CASE WHEN prec + sens > 0 THEN 2 * prec * sens / (prec + sens) ELSE 0 END, 6) AS f1 FROM (SELECT *,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS sens, coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS spec,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS prec FROM (SELECT count(*) AS n, avg(y) AS prevalence, count(*) FILTER (y = 1 AND s >= threshold) AS tp,
  count(*) FILTER (y = 0 AND s >= threshold) AS fp, count(*) FILTER (y = 0 AND s < threshold) AS tn, count(*) FILTER (y = 1 AND s < threshold) AS fn
  FROM {judged}, {threshold}))""")
def classification_metrics(spark, sf):
    rows = judged(spark, sf)
    t = E.choose_threshold(rows, "y", "s", 0.95).scalar()
    m = E.classification_metrics(rows, "y", "s", t)
    for c in ("prevalence", "sensitivity", "specificity", "precision", "f1"):
        m = m.withColumn(c, F.round(c, 6))
    return m


@query("auroc", """SELECT round(sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auroc
  FROM (SELECT s FROM {judged} WHERE y = 1) p CROSS JOIN (SELECT s FROM {judged} WHERE y = 0) n""")
def auroc(spark, sf):
    return E.auroc(judged(spark, sf), "y", "s").select(F.round("auroc", 6).alias("auroc"))


@query("auprc", """SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS auprc FROM (SELECT pos, CAST(sum(pos) OVER (ORDER BY s DESC) AS DOUBLE) AS tp,
  sum(n) OVER (ORDER BY s DESC) AS seen FROM (SELECT s, sum(y) AS pos, count(*) AS n FROM {judged} GROUP BY s))""")
def auprc(spark, sf):
    return E.auprc(judged(spark, sf), "y", "s").select(F.round("auprc", 6).alias("auprc"))


@query("brier", "SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM {judged}")
def brier(spark, sf):
    return E.brier(judged(spark, sf), "y", "s").select(F.round("brier", 6).alias("brier"))


@query("band_table", """SELECT CASE WHEN s >= 0.9 THEN 'P1' WHEN s >= 0.4 THEN 'P2' ELSE 'P3' END AS band, count(*) AS films, sum(y) AS positives
  FROM {judged} GROUP BY ALL""")
def band_table(spark, sf):
    return E.band_table(judged(spark, sf), "y", "s", 0.4, 0.9)


_QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


@query("score_quantiles", "SELECT " + ", ".join(f"round(quantile_cont(s, {p}), 6) AS {n}" for n, p in _QUANTILES.items()) + " FROM {judged}")
def score_quantiles(spark, sf):
    q = exact_quantiles(judged(spark, sf), [], "s", _QUANTILES)
    return q.select(*[F.round(n, 6).alias(n) for n in _QUANTILES])


# Candidate cuts of the first band.
CUTS = [0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999]


@query("p1_cut_sweep", """SELECT CAST(cut AS DOUBLE) AS cut, count(*) FILTER (s >= cut) AS p1, count(*) FILTER (s >= cut AND y = 1) AS p1_pos,
  count(*) FILTER (s >= 0.4 AND s < cut) AS p2, count(*) FILTER (s >= 0.4 AND s < cut AND y = 1) AS p2_pos,
  count(*) FILTER (s < 0.4) AS p3, count(*) FILTER (s < 0.4 AND y = 1) AS p3_pos
  FROM {judged} CROSS JOIN (VALUES (0.8), (0.9), (0.95), (0.98), (0.99), (0.995), (0.999)) c(cut) GROUP BY cut""")
def p1_cut_sweep(spark, sf):
    return E.p1_cut_sweep(judged(spark, sf), "y", "s", 0.4, CUTS)


# ---- drift

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_IS_REF = "l_shipdate < TIMESTAMP '1998-01-01'"
for _f in FEATURES:
    cte(f"psi_{_f}", f"""SELECT '{_f}' AS feature, CASE WHEN n_edges < 3 THEN 0.0 ELSE value END AS psi FROM (
  SELECT max(n_edges) AS n_edges, sum((a - e) * ln(a / e)) AS value FROM (
    SELECT b.n_edges, greatest(CAST(coalesce(c.ref, 0) AS DOUBLE) / b.n_ref, 0.0001) AS e,
      greatest(CAST(coalesce(c.cur, 0) AS DOUBLE) / greatest(b.n_cur, 1), 0.0001) AS a
    FROM (SELECT unnest(range(1, n_edges)) AS bin, n_edges, n_ref, n_cur FROM (SELECT len(edges) AS n_edges, n_ref, n_cur FROM (
      SELECT list_sort(list_distinct(quantile_cont({_f}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER ({_IS_REF}))) AS edges,
        count({_f}) FILTER ({_IS_REF}) AS n_ref, count({_f}) FILTER (NOT {_IS_REF}) AS n_cur FROM lineitem))) b
    LEFT JOIN (SELECT least(greatest(len(list_filter(edges, lambda x: x <= v)), 1), len(edges) - 1) AS bin, count(*) FILTER (is_ref) AS ref,
      count(*) FILTER (NOT is_ref) AS cur FROM (SELECT {_f} AS v, {_IS_REF} AS is_ref, edges FROM lineitem CROSS JOIN (
        SELECT list_sort(list_distinct(quantile_cont({_f}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER ({_IS_REF}))) AS edges FROM lineitem))
      GROUP BY ALL) c ON c.bin = b.bin))""")
cte("psi_all", " UNION ALL ".join(f"SELECT feature, round(psi, 6) AS psi FROM {{psi_{f}}}" for f in FEATURES))


def psi_rows(spark, sf):
    is_ref = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return R.psi(table(spark, sf, "lineitem"), FEATURES, is_ref)


@query("psi", "SELECT * FROM {psi_all}")
def psi(spark, sf):
    return psi_rows(spark, sf).select("feature", F.round("psi", 6).alias("psi"))


cte("in_scope_lines", f"""SELECT *, CASE WHEN l_orderkey % 50 = 0 THEN 'rare' ELSE l_returnflag END AS lot, {_IS_REF} AS is_ref FROM lineitem WHERE l_discount > 0""")
cte("lot_psi", psi_sql("{in_scope_lines}", FEATURES, "is_ref", "lot"))


@query("drift_report", f"""SELECT lot, n.rows, psi_max, psi_json, CASE WHEN n.rows < 1000 THEN 'TOO_FEW' WHEN psi_max >= 0.25 THEN 'ALERT' WHEN psi_max >= 0.10 THEN 'WARN' ELSE 'OK' END AS drift_level
  FROM (SELECT key AS lot, {_REPORT} FROM {{lot_psi}} GROUP BY key) p JOIN (SELECT lot, count(*) AS rows FROM {{in_scope_lines}} WHERE NOT is_ref GROUP BY lot) n USING (lot)""")
def drift_report(spark, sf):
    """Lots of later lines in scope (with a discount) against the stored bins of the earlier ones, which are read once."""
    is_ref = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    lines = table(spark, sf, "lineitem").where("l_discount > 0")
    reference = materialize(R.reference_bins(lines.where(is_ref), FEATURES), "bins")
    now = lines.where(~is_ref).withColumn("lot", F.when(F.col("l_orderkey") % 50 == 0, "rare").otherwise(F.col("l_returnflag")))
    counts = R.value_counts(now, FEATURES, "lot")
    sizes = now.groupBy("lot").agg(F.count(F.lit(1)).alias("rows"))
    return R.drift_report(R.psi_of_counts(reference, counts, "lot"), sizes, ["lot"], 0.10, 0.25, 1000)


@query("drift_level", """SELECT event_type, user_id, count(*) AS n, round(max(value) / 2000, 6) AS worst, CASE WHEN count(*) < 12 THEN 'TOO_FEW'
  WHEN max(value) / 2000 >= 0.25 THEN 'ALERT' WHEN max(value) / 2000 >= 0.10 THEN 'WARN' ELSE 'OK' END AS drift_level FROM events GROUP BY ALL""")
def drift_level(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("value") / 2000).alias("w"))
    return g.select("event_type", "user_id", "n", F.round("w", 6).alias("worst"),
                    R.drift_level(F.col("w"), F.col("n"), 0.10, 0.25, 12).alias("drift_level"))


# ---- gate and promotion: candidates are the persons' events rolled up

cte("candidates", """SELECT user_id AS candidate, round(0.9 + avg(k) / 1000, 6) AS auroc, round(0.85 + max(k) / 1000.0, 6) AS sensitivity,
  round(0.6 + avg(value) / 500, 6) AS specificity, round(0.05 + min(k) / 100.0, 6) AS brier, CASE WHEN max(k) < 98 THEN 100 ELSE 0 END AS built_limit,
  CASE WHEN min(k) < 2 THEN 'aaaa' ELSE 'bbbb' END AS feature_hash, CASE WHEN count(*) FILTER (event_type = 'error') > 13 THEN round(0.95 + min(k) / 1000.0, 6) END AS champion_auroc,
  CASE WHEN count(*) FILTER (event_type = 'click') > 13 THEN round(0.94 + min(k) / 1000.0, 6) END AS trial_auroc FROM {ev} GROUP BY user_id""")


def candidates(spark, sf):
    from worklake.registered.frames import events

    k, n = F.col("k"), lambda t: F.count_if(F.col("event_type") == t)
    return events(spark, sf).groupBy(F.col("user_id").alias("candidate")).agg(
        F.round(0.9 + F.avg(k) / 1000, 6).alias("auroc"), F.round(0.85 + F.max(k) / 1000.0, 6).alias("sensitivity"),
        F.round(0.6 + F.avg("value") / 500, 6).alias("specificity"), F.round(0.05 + F.min(k) / 100.0, 6).alias("brier"),
        F.when(F.max(k) < 98, 100).otherwise(0).alias("built_limit"), F.when(F.min(k) < 2, "aaaa").otherwise("bbbb").alias("feature_hash"),
        F.when(n("error") > 13, F.round(0.95 + F.min(k) / 1000.0, 6)).alias("champion_auroc"),
        F.when(n("click") > 13, F.round(0.94 + F.min(k) / 1000.0, 6)).alias("trial_auroc"))


GATE = [G.Rule("auroc", "auroc", at_least=0.94), G.Rule("sensitivity", "sensitivity", at_least=0.93),
        G.Rule("specificity", "specificity", at_least=0.65), G.Rule("brier", "brier", at_most=0.12)]


_INCUMBENT = "coalesce(champion_auroc, trial_auroc)"


@query("kpi_gate", f"""SELECT candidate, check_name, CAST(value AS DOUBLE) AS value, rule, passed FROM (
  SELECT candidate, 'auroc' AS check_name, auroc AS value, '>= 0.94' AS rule, auroc >= 0.94 AS passed FROM {{candidates}}
  UNION ALL SELECT candidate, 'sensitivity', sensitivity, '>= 0.93', sensitivity >= 0.93 FROM {{candidates}}
  UNION ALL SELECT candidate, 'specificity', specificity, '>= 0.65', specificity >= 0.65 FROM {{candidates}}
  UNION ALL SELECT candidate, 'brier', brier, '<= 0.12', brier <= 0.12 FROM {{candidates}}
  UNION ALL SELECT candidate, 'trained on the whole table', built_limit, 'no limit', built_limit = 0 FROM {{candidates}}
  UNION ALL SELECT candidate, 'feature hash matches', NULL, '== aaaa', feature_hash = 'aaaa' FROM {{candidates}}
  UNION ALL SELECT candidate, 'no regression against the incumbent', CASE WHEN {_INCUMBENT} IS NOT NULL THEN auroc END,
    CASE WHEN {_INCUMBENT} IS NULL THEN 'no incumbent yet' ELSE '>= ' || printf('%.4f', {_INCUMBENT} - CAST(0.01 AS DOUBLE)) END,
    coalesce(auroc >= {_INCUMBENT} - CAST(0.01 AS DOUBLE), true) FROM {{candidates}})""")
def kpi_gate(spark, sf):
    return G.gate(candidates(spark, sf), ["candidate"], GATE, "aaaa", 0.01).select("candidate", "check_name", "value", "rule", "passed")


@query("kpi_gate_verdict", """SELECT candidate, failed_checks = 0 AS passed, failed_checks FROM (SELECT candidate,
  CAST(NOT auroc >= 0.94 AS INT) + CAST(NOT sensitivity >= 0.93 AS INT) + CAST(NOT specificity >= 0.65 AS INT) + CAST(NOT brier <= 0.12 AS INT)
  + CAST(built_limit <> 0 AS INT) + CAST(feature_hash <> 'aaaa' AS INT)
  + CAST(NOT coalesce(auroc >= coalesce(champion_auroc, trial_auroc) - CAST(0.01 AS DOUBLE), true) AS INT) AS failed_checks FROM {candidates})""")
def kpi_gate_verdict(spark, sf):
    return G.verdict(G.gate(candidates(spark, sf), ["candidate"], GATE, "aaaa", 0.01), ["candidate"])


GO_LIVE = [G.Rule("days in trial", "days", at_least=7), G.Rule("reported positives", "positives", at_least=20),
           G.Rule("sensitivity", "sensitivity", at_least=0.8), G.Rule("specificity", "specificity", at_least=0.35)]


@query("go_live_criteria", """SELECT model, model_version, check_name, CAST(value AS DOUBLE) AS value, rule, coalesce(value >= bar, false) AS passed FROM (
  SELECT model, model_version, 'days in trial' AS check_name, days AS value, '>= 7' AS rule, 7 AS bar FROM {evidence}
  UNION ALL SELECT model, model_version, 'reported positives', positives, '>= 20', 20 FROM {evidence}
  UNION ALL SELECT model, model_version, 'sensitivity', sensitivity, '>= 0.8', 0.8 FROM {evidence}
  UNION ALL SELECT model, model_version, 'specificity', specificity, '>= 0.35', 0.35 FROM {evidence})""")
def go_live_criteria(spark, sf):
    return G.apply_rules(trial_evidence(model_daily(spark, sf), ["model", "model_version"]), ["model", "model_version"], GO_LIVE)


@query("model_event_log", """SELECT event_id, model, event, recorded_at, model_version, CASE WHEN row_number() OVER (PARTITION BY model ORDER BY recorded_at DESC,
  event_id DESC) = 1 THEN 1 ELSE 0 END AS is_last FROM {model_events}""")
def model_event_log(spark, sf):
    """The log appended kind by kind, read back whole."""
    from worklake.session import scratch_path
    from worklake.sources.tables import append_log

    path, rows = scratch_path(spark, "model_event"), model_events(spark, sf)
    for late in (False, True):
        append_log(rows.where((F.col("event") == "PROMOTED") == late), path)
    return flag_latest(spark.read.parquet(path), ["model"], ["recorded_at"], ["event_id"], "is_last")


cte("last_stage", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, stage ORDER BY recorded_at DESC, event_id DESC) AS rn FROM (
  SELECT *, CASE WHEN event = 'SILENT_TRIAL' THEN 'silent_trial' ELSE 'champion' END AS stage FROM {model_events}
  WHERE event <> 'GATE_PASSED' AND model IS NOT NULL)) WHERE rn = 1""")


@query("stage_state", """SELECT l.model, l.stage, l.model_version, l.event, l.recorded_at FROM {last_stage} l LEFT JOIN {last_stage} p
  ON l.stage = 'silent_trial' AND p.event = 'PROMOTED' AND p.model = l.model AND p.model_version = l.model_version
  AND l.recorded_at <= p.recorded_at WHERE p.model IS NULL""")
def stage_state(spark, sf):
    return G.stage_state(model_events(spark, sf).where("model is not null"), "recorded_at", "event_id")


@query("skip_if_same_hash", """SELECT candidate, CASE WHEN built_limit > 0 THEN 'REBUILD' WHEN feature_hash = 'aaaa' THEN 'SKIP' ELSE 'FAIL' END AS decision
  FROM {candidates}""")
def skip_if_same_hash(spark, sf):
    return candidates(spark, sf).select("candidate", G.build_decision("aaaa").alias("decision"))


# ---- training: embeddings by groups of ids, fitted on train, threshold from val, judged on test

# Regularisation strengths to compare, and the strength of the single head.
C_VALUES, C_HEAD = (0.5, 0.05, 0.01, 0.002), 0.05
TARGET = 0.95
SPLIT_SEED, VAL_SHARE = 42, 0.15

cte("vectors", f"""SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(label < 3 AS BIGINT) AS y, CASE WHEN vec_id // 4 % 5 = 0 THEN 'test'
  WHEN {sql_hash(f"'{SPLIT_SEED}:' || CAST(vec_id // 4 AS VARCHAR)")} < {VAL_SHARE} THEN 'val' ELSE 'train' END AS split FROM embeddings""")
_D = 64  # length of the vectors
_FREE = 2.0  # the intercept's input, so that its direction is not much flatter or steeper than the others
_STEPS = 600


def _sum_list(what: str, n: int) -> str:
    return "[" + ", ".join(what.replace("#", str(i + 1)) for i in range(n)) + "]"


cte("scaled", f"""SELECT vec_id, y, split, list_append(list_transform(list_zip(e, mean, std), lambda t: (t[1] - t[2]) / CASE WHEN t[3] = 0 THEN 1 ELSE t[3] END), {_FREE}) AS z
  FROM {{vectors}}, (SELECT {_sum_list('avg(e[#])', _D)} AS mean, {_sum_list('stddev_pop(e[#])', _D)} AS std FROM {{vectors}} WHERE split = 'train')""")
cte("learned", f"""SELECT z, y, n, CASE WHEN y = 1 THEN n / (CAST(2 AS DOUBLE) * pos) ELSE n / (CAST(2 AS DOUBLE) * (n - pos)) END AS weight
  FROM {{scaled}}, (SELECT count(*) AS n, sum(y) AS pos FROM {{scaled}} WHERE split = 'train') WHERE split = 'train'""")
# Accelerated gradient steps on |w|^2 / 2 + C * (weighted log loss); the intercept is free. The loss is strictly convex: any way that
# arrives at its minimum arrives at the same weights.
cte("fitted", f"""SELECT c, w FROM (WITH RECURSIVE step AS (
  SELECT c, 0 AS it, list_transform(range({_D + 1}), lambda i: CAST(0 AS DOUBLE)) AS w, list_transform(range({_D + 1}), lambda i: CAST(0 AS DOUBLE)) AS ahead
  FROM (SELECT CAST(unnest([{', '.join(map(str, C_VALUES))}]) AS DOUBLE) AS c)
  UNION ALL
  SELECT c, it + 1, new_w, list_transform(list_zip(new_w, w), lambda t: t[1] + pace * (t[1] - t[2])) FROM (
    SELECT c, it, w, list_transform(list_zip(ahead, g, range({_D + 1})), lambda t: t[1] - ((CASE WHEN t[3] < {_D} THEN t[1] ELSE 0 END) + c * t[2]) / steep) AS new_w,
      (1 - sqrt(least(1, c * n * 0.6) / steep)) / (1 + sqrt(least(1, c * n * 0.6) / steep)) AS pace FROM (
      SELECT c, it, w, ahead, any_value(n) AS n, 1 + c * any_value(n) * 2 AS steep, {_sum_list('sum(r * z[#])', _D + 1)} AS g FROM (
        SELECT s.*, l.z, l.n, l.weight * (1 / (1 + exp(-list_dot_product(l.z, s.ahead))) - l.y) AS r FROM step s, {{learned}} l WHERE s.it < {_STEPS})
      GROUP BY c, it, w, ahead)))
  SELECT c, w FROM step WHERE it = {_STEPS})""")
cte("swept", "SELECT c, vec_id, split, y, 1 / (1 + exp(-list_dot_product(z, w))) AS s FROM {scaled}, {fitted}")
cte("cut_off", f"""SELECT c, max(s) FILTER (i = k) AS threshold FROM (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY s) - 1 AS i,
  floor((1 - CAST({TARGET} AS DOUBLE)) * count(*) OVER (PARTITION BY c)) AS k FROM {{swept}} WHERE split = 'val' AND y = 1) GROUP BY c""")
cte("sweep_auc", """SELECT p.c, p.split, sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END) / count(*) AS auroc
  FROM (SELECT * FROM {swept} WHERE y = 1) p JOIN (SELECT * FROM {swept} WHERE y = 0) n ON n.c = p.c AND n.split = p.split GROUP BY ALL""")
cte("sweep_metrics", """SELECT c, split, n, prevalence, threshold, tp, fp, tn, fn, auroc, brier, sens AS sensitivity, spec AS specificity, prec AS precision,
  CASE WHEN prec + sens > 0 THEN 2 * prec * sens / (prec + sens) ELSE 0 END AS f1 FROM (SELECT *, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS sens,
    coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0) AS spec, coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS prec
  FROM (SELECT s.c, s.split, any_value(t.threshold) AS threshold, any_value(a.auroc) AS auroc, count(*) AS n, avg(y) AS prevalence, avg((s - y) * (s - y)) AS brier,
    count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y = 0 AND s >= threshold) AS fp,
    count(*) FILTER (y = 0 AND s < threshold) AS tn, count(*) FILTER (y = 1 AND s < threshold) AS fn
    FROM {swept} s JOIN {cut_off} t ON t.c = s.c JOIN {sweep_auc} a ON a.c = s.c AND a.split = s.split GROUP BY s.c, s.split))""")


def _vectors(spark, sf):
    group = F.expr("vec_id div 4")
    return table(spark, sf, "embeddings").select("vec_id", as_doubles(F.col("embedding")).alias("embedding"), (F.col("label") < 3).cast("bigint").alias("y"),
                                                 group_split(group, SPLIT_SEED, VAL_SHARE, group % 5 == 0).alias("split"))


def _sweep(spark, sf, strengths):
    """(certificate, probabilities per row and strength, ranked counts per strength and split with the strength's threshold)."""
    rows = _vectors(spark, sf)
    train = rows.where("split = 'train'")
    fits = training.train_heads(train, "embedding", "y", list(strengths))
    scored = rows.select("vec_id", "split", "y", F.posexplode(training.probabilities(F.col("embedding"), fits)).alias("_i", "s"))
    scored = scored.withColumn("c", F.get(F.array(*[F.lit(f.c) for f in fits]), F.col("_i"))).drop("_i")
    ranked = materialize(E.ranked_counts(E.score_counts(scored, "y", "s", ["c", "split"]), ["c", "split"]), "ranked")
    cut = E.thresholds(ranked.where("split = 'val'"), ["c"], TARGET)  # a row for each strength
    return training.certificate(train, "embedding", "y", fits), scored, ranked.join(cut, "c")


_RATIOS = ("prevalence", "threshold", "auroc", "brier", "sensitivity", "specificity", "precision", "f1")
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in _RATIOS)


@query("train_head", f"""SELECT split, n, tp, fp, tn, fn, {_ROUNDED}, true AS at_minimum FROM {{sweep_metrics}} WHERE c = {C_HEAD}""")
def train_head(spark, sf):
    """Fitted on train, its threshold chosen on val, its figures on each split; the gradient proves the fit."""
    proof, _, ranked = _sweep(spark, sf, [C_HEAD])
    metrics = E.model_metrics(ranked, ["c", "split", "threshold"])
    at = proof.select("c", (F.col("gradient") < 1e-9).alias("at_minimum"))
    return metrics.join(at, "c").select("split", "n", "tp", "fp", "tn", "fn", *[F.round(c, 5).alias(c) for c in _RATIOS], "at_minimum")


@query("train_head_scores", f"SELECT vec_id, split, y, round(s, 4) AS probability FROM {{swept}} WHERE c = {C_HEAD}")
def train_head_scores(spark, sf):
    _, scored, _ = _sweep(spark, sf, [C_HEAD])
    return scored.select("vec_id", "split", "y", F.round("s", 4).alias("probability"))


_SWEEP_QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


@query("c_sweep", f"""SELECT c, n, tp, fp, tn, fn, {_ROUNDED}, {', '.join(f'round({q}, 5) AS {q}' for q in _SWEEP_QUANTILES)}, round(val_brier, 5) AS val_brier,
  true AS at_minimum FROM {{sweep_metrics}} JOIN (SELECT c, {', '.join(f'quantile_cont(s, {p}) AS {q}' for q, p in _SWEEP_QUANTILES.items())} FROM {{swept}} WHERE split = 'test' GROUP BY c) USING (c)
  JOIN (SELECT c, brier AS val_brier FROM {{sweep_metrics}} WHERE split = 'val') USING (c) WHERE split = 'test'""")
def c_sweep(spark, sf):
    """A head per strength, all scored in one pass over the rows and ranked in one table of counts."""
    proof, _, ranked = _sweep(spark, sf, C_VALUES)
    test, metrics = ranked.where("split = 'test'"), E.model_metrics(ranked, ["c", "split", "threshold"])
    val = metrics.where("split = 'val'").select("c", F.round("brier", 5).alias("val_brier"))
    q = E.model_quantiles(test, ["c"], _SWEEP_QUANTILES)
    at = proof.select("c", (F.col("gradient") < 1e-9).alias("at_minimum"))
    out = metrics.where("split = 'test'").join(q, "c").join(val, "c").join(at, "c")
    return out.select("c", "n", "tp", "fp", "tn", "fn", *[F.round(c, 5).alias(c) for c in (*_RATIOS, *_SWEEP_QUANTILES)], "val_brier", "at_minimum")


@query("c_sweep_bands", """SELECT s.c, CAST(cut AS DOUBLE) AS cut, count(*) FILTER (s >= cut) AS p1, coalesce(sum(y) FILTER (s >= cut), 0) AS p1_pos,
  count(*) FILTER (s >= threshold AND s < cut) AS p2, coalesce(sum(y) FILTER (s >= threshold AND s < cut), 0) AS p2_pos, count(*) FILTER (s < threshold) AS p3,
  coalesce(sum(y) FILTER (s < threshold), 0) AS p3_pos FROM {swept} s JOIN {cut_off} t ON t.c = s.c
  CROSS JOIN (VALUES (0.8), (0.9), (0.95), (0.98), (0.99), (0.995), (0.999)) v(cut) WHERE split = 'test' AND CAST(cut AS DOUBLE) > threshold GROUP BY s.c, cut""")
def c_sweep_bands(spark, sf):
    """Rows and positives per band of every strength and candidate cut on test."""
    _, _, ranked = _sweep(spark, sf, C_VALUES)
    return E.model_bands(ranked.where("split = 'test'"), ["c"], CUTS)
