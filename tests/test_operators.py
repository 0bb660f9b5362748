"""Hand-checked cases and brute-force comparisons; scans run over one piece and over many."""

import bisect
import dataclasses
import math
import random
import statistics
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from worklake.functions import arrays, scalars
from worklake.operators import drift, evaluate, governance, latest, outcomes, recon, sampling, scoring, training
from worklake.operators.ordered import CHUNK, COUNT, MAX, SUM, chunk, running
from worklake.operators.quantiles import exact_quantiles



@pytest.fixture(params=["1000000", "8"])
def pieces(spark, request):
    """One piece, and pieces of a handful of rows."""
    spark.conf.set("spark.worklake.pieceRows", request.param)
    yield
    spark.conf.unset("spark.worklake.pieceRows")


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_running(spark, pieces):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.choice([None, *range(9)])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running(df, ["k"], [F.col("i")], {"n": (COUNT,), "s": (SUM, F.col("v")), "m": (MAX, F.col("v"))})
    by = {r["i"]: r for r in got.collect()}
    assert len(by) == 200
    for k in "ab":
        seen = []
        for n, (_, i, v) in enumerate([r for r in rows if r[0] == k], 1):
            seen += [] if v is None else [v]
            assert (by[i]["n"], by[i]["s"], by[i]["m"]) == (n, sum(seen) if seen else None, max(seen) if seen else None)


def test_quantiles(spark, pieces):
    rng = random.Random(2)
    groups = {k: [round(rng.gauss(0, 5), 1) for _ in range(n)] for k, n in (("a", 61), ("b", 10), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double")
    probs = {"q10": 0.1, "median": 0.5, "p90": (0.9, "index")}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        vs = sorted(groups[r["k"]])
        assert r["q10"] == pytest.approx(np.quantile(vs, 0.1))
        assert r["median"] == pytest.approx(statistics.median(vs))
        assert r["p90"] == vs[min(len(vs) - 1, int(0.9 * len(vs)))]
    everything = [v for vs in groups.values() for v in vs]
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.quantile(everything, 0.5))


def test_ranking_metrics_with_ties(spark, pieces):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(80)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert evaluate.auroc(df, "y", "s").first()[0] == pytest.approx(pairs / len(pos) / len(neg))
    ap = 0.0
    for t in sorted(set(s for _, s in rows), reverse=True):
        above = [y for y, s in rows if s >= t]
        ap += sum(1 for y, s in rows if y and s == t) / len(pos) * sum(above) / len(above)
    assert evaluate.auprc(df, "y", "s").first()[0] == pytest.approx(ap)
    assert evaluate.choose_threshold(df, "y", "s", 0.9).first()[0] == sorted(pos)[int(np.floor((1 - 0.9) * len(pos)))]
    assert evaluate.choose_threshold(df.where("y = 0"), "y", "s", 0.9).first()[0] == 0.5
    assert evaluate.brier(df, "y", "s").first()[0] == pytest.approx(np.mean([(s - y) ** 2 for y, s in rows]))


def psi_by_hand(ref, cur):
    """Cut points are interpolated between ranks; a value's bin is the number of inner cut points that it reaches."""
    ordered, cuts = sorted(ref), set()
    for tenth in range(11):
        below, part = divmod(tenth * (len(ordered) - 1), 10)
        step = ordered[min(below + 1, len(ordered) - 1)] - ordered[below]
        cuts.add(ordered[below] + step * part / 10)
    inner = sorted(cuts)[1:-1]
    if not inner:
        return 0.0
    held = [[sum(bisect.bisect_right(inner, x) == k for x in side) / len(side) for side in (ref, cur)] for k in range(len(inner) + 1)]
    total = 0.0
    for before, now in held:
        before, now = max(before, 1e-4), max(now, 1e-4)
        total += (now - before) * math.log(now / before)
    return total


def test_psi(spark, pieces):
    rng = np.random.default_rng(4)
    ref = {"smooth": rng.normal(0, 1, 400), "tied": rng.integers(0, 4, 400).astype(float), "flat": np.ones(400)}
    cur = {"smooth": rng.normal(1, 1, 150), "tied": rng.integers(1, 6, 150).astype(float), "flat": np.zeros(150)}
    rows = [(True, *map(float, r)) for r in zip(*ref.values())] + [(False, *map(float, r)) for r in zip(*cur.values())]
    df = spark.createDataFrame(rows, "is_ref boolean, smooth double, tied double, flat double")
    got = {r["feature"]: r["psi"] for r in drift.psi(df, list(ref), F.col("is_ref")).collect()}
    for f in ref:
        assert got[f] == pytest.approx(psi_by_hand(ref[f], cur[f]), abs=1e-9)


def test_bands_and_scope(spark):
    df = spark.createDataFrame([(.9, .4, .85), (.5, .4, .85), (.88, .92, .85), (.93, .92, .85), (.1, .4, .85)], "p double, t double, p1 double")
    assert [r[0] for r in df.select(scalars.priority_band(F.col("p"), F.col("t"), F.col("p1"))).collect()] == ["P1", "P2", "P3", "P1", "P3"]
    ages = spark.createDataFrame([("pediatric", 4), ("pediatric", 40), ("adult", 18), ("adult", 17), ("adult", None), ("all", 0)], "pop string, age int")
    assert [r[0] for r in ages.select(scalars.in_scope(F.col("pop"), F.col("age"))).collect()] == [True, False, True, False, True, True]


def test_decision_live_and_if_trials_were_live(spark):
    heads = [scoring.Head("a", scoring.CHAMPION, "pediatric", .5, .9, "a1"), scoring.Head("b", scoring.TRIAL, "adult", .5, .9, "b1"),
             scoring.Head("q", scoring.CHAMPION, "all", .9, 1.01, "q1", checks_quality=True)]
    rows = [(1, 4, .6, .99, .1), (2, 40, .6, .95, .1), (3, 40, .6, .95, .95)]
    df = spark.createDataFrame(rows, "id int, age int, _p0 double, _p1 double, _p2 double")
    got = {r["id"]: r for r in scoring.decide(df, "age", heads).collect()}
    assert [got[i]["priority"] for i in (1, 2, 3)] == ["P2", "NA", "NA"]
    assert [got[i]["shadow_priority"] for i in (1, 2, 3)] == ["P2", "P1", "NA"]
    assert [got[i]["shadow_model"] for i in (1, 2, 3)] == ["a", "b", None]
    assert [got[i]["quality_check"] for i in (1, 2, 3)] == ["OK", "OK", "UNSUITABLE"]
    long = scoring.heads_long(df, ["id"], "age", heads)
    assert long.count() == 9 and long.where("model = 'q' and priority is null and in_scope").count() == 3


def test_ties_between_heads_go_by_name(spark):
    heads = [scoring.Head(n, scoring.CHAMPION, "all", .5, .9, f"{n}1") for n in ("z", "m")]
    got = scoring.decide(spark.createDataFrame([(1, 30, .7, .7)], "id int, age int, _p0 double, _p1 double"), "age", heads).first()
    assert (got["triage_model"], got["model_version"], got["probability"]) == ("m", "m1", .7)


def test_evidence_and_go_live(spark):
    days = spark.createDataFrame([(date(2026, 10, d), "b", "b1", "silent_trial", 3, 0, 4, 9) for d in range(1, 9)],
                                 "business_date date, model string, model_version string, stage string, tp int, fn int, fp int, tn int")
    ev = outcomes.trial_evidence(days, ["model", "model_version"])
    r = ev.first()
    assert (r["days"], r["positives"], r["negatives"], r["sensitivity"], r["specificity"]) == (8, 24, 104, 1.0, 0.6923)
    rules = [governance.Rule("d", "days", at_least=7), governance.Rule("p", "positives", at_least=20),
             governance.Rule("s", "sensitivity", at_least=.8), governance.Rule("c", "specificity", at_least=.35)]
    fails = lambda df: governance.verdict(governance.apply_rules(df, ["model"], rules), ["model"]).first()["failed_checks"]
    assert fails(ev) == 0
    assert fails(ev.withColumn("days", F.lit(3))) == 1
    assert fails(ev.withColumn("positives", F.lit(0)).withColumn("sensitivity", F.lit(None).cast("double"))) == 2


def test_training_set_counts(spark):
    films = spark.createDataFrame([("train", int(i < 5), i) for i in range(8)] + [("val", i, i) for i in range(2)], "split string, y int, person int")
    assert values(outcomes.training_set_counts(films, "split", "y", "person").fillna(-1), "data_split", "films", "positives", "persons") == [
        ("all", 10, 6, 8), ("train", 8, 5, -1), ("val", 2, 1, -1)]


def test_trained_head_is_at_the_minimum(spark):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(120, 4)) * [1, 2, .5, 3], 0.1
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0.6).astype(int)
    df = spark.createDataFrame([(list(map(float, r)), int(v)) for r, v in zip(x, y)], "v array<double>, y int")
    fit = training.train_heads(df, "v", "y", [c])[0]
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(fit.mean, x.mean(0)) and np.allclose(fit.std, x.std(0))
    w, weight = np.array(fit.weights), np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    r = weight * (1 / (1 + np.exp(-(z @ w + fit.intercept))) - y)
    gradient = max(np.abs(w + c * (z.T @ r)).max(), abs(c * r.sum()))
    assert gradient < 1e-9
    proof = training.certificate(df, "v", "y", [fit, dataclasses.replace(fit, c=0.2)]).collect()
    assert abs(proof[0].gradient - gradient) < 1e-9 and proof[1].gradient > 1e-3  # the second isn't at the minimum of its loss
    both = np.array([r[0] for r in df.select(training.probabilities(F.col("v"), [fit, fit])).collect()])
    assert np.allclose(both, (1 / (1 + np.exp(-(z @ w + fit.intercept))))[:, None])
    head = scoring.Head("h", scoring.CHAMPION, "all", .5, .9, "1", weights=fit.weights, mean=fit.mean, std=fit.std, intercept=fit.intercept)
    p = [r[0] for r in df.select(scoring.linear_probability(F.col("v"), head)).collect()]
    assert np.allclose(p, 1 / (1 + np.exp(-(z @ w + fit.intercept))))


def test_array_stats(spark):
    a = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    r = arrays.array_stats(spark.createDataFrame([(a,)], "a array<float>"), "a").first()
    bends = [2 * a[i] - a[i - 1] - a[i + 1] for i in range(1, 6)]
    assert (r["mean"], r["std"], r["roughness"], r["size"]) == (pytest.approx(np.mean(a)), pytest.approx(np.std(a)), pytest.approx(np.var(bends)), 7)
    assert (r["p05"], r["p95"]) == (pytest.approx(np.quantile(a, .05)), pytest.approx(np.quantile(a, .95)))
    short = arrays.array_stats(spark.createDataFrame([([1.0, 2.0],)], "a array<float>"), "a").first()
    assert short["roughness"] is None and short["size"] == 2


def test_recon_status_and_replacement(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.5), (None, None), (1.0, None)], "e double, a double")
    status = lambda **kw: [r[0] for r in df.select(recon.recon_status(F.col("e"), F.col("a"), **kw)).collect()]
    assert status() == ["MATCHED", "MISMATCH", "MISMATCH", "MISMATCH"]
    assert status(tolerance=.5, explained=True) == ["MATCHED", "MATCHED", "EXPLAINED", "EXPLAINED"]
    old = spark.createDataFrame([(1, "bronze", "x"), (1, "gold", "y"), (2, "bronze", "z")], "d int, stage string, c string")
    assert values(recon.replace_stage(old, old.where("false"), "bronze", F.col("d") == 1), "d", "stage") == [(1, "gold"), (2, "bronze")]


def test_differences_count_a_missing_side_as_zero(spark):
    a = spark.createDataFrame([(1, 5, 2), (2, 1, 1)], "d int, x int, y int")
    b = spark.createDataFrame([(1, 5, 3), (3, 0, 4)], "d int, x int, y int")
    assert values(recon.differences(a, b, "d", ["x", "y"]), "d", "counter", "left_value", "right_value") == [
        (1, "y", 2, 3), (2, "x", 1, 0), (2, "y", 1, 0), (3, "y", 0, 4)]


def test_latest_flags_keep_every_row(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 5, 4)], "k string, t int, id int")
    assert values(latest.flag_latest(df, ["k"], ["t"], ["id"], "f"), "id", "f") == [(1, 0), (2, 0), (3, 1), (4, 1)]
    assert values(latest.flag_latest_date(df, "t"), "id", "is_latest") == [(1, 0), (2, 0), (3, 0), (4, 1)]


def test_split_by_group_never_leaks(spark):
    df = spark.range(500).select("id", (F.col("id") / 5).cast("int").alias("g"), (F.col("id") < 50).alias("held"))
    split = df.withColumn("split", sampling.group_split(F.col("g"), 42, .3, F.col("held")))
    assert sampling.keys_in_both(split, "split", "g", "train", "val").first()[0] == 0
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "val", "test"}
    assert split.where("held and split <> 'test'").count() == 0


def test_balanced_sample_prefers_near_blocks_when_they_hold_enough(spark):
    rows = [("s", 1, "near", i) for i in range(3)] + [("s", 0, "near", 100 + i) for i in range(20)] + [("s", 0, "far", 200 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "split string, y int, block string, id int")
    got = sampling.balanced_sample(df, "split", "y", "block", "id", 2, 3, 1)
    assert got.where("y = 1").count() == 2 and got.where("y = 0").count() == 6
    assert got.where("y = 0 and block = 'far'").count() == 0
    few = sampling.balanced_sample(df.where("not (y = 0 and block = 'near' and id > 101)"), "split", "y", "block", "id", 2, 3, 1)
    assert few.where("y = 0").count() == 6 and few.where("y = 0 and block = 'far'").count() >= 4


def test_gate_and_stage_state(spark):
    base = dict(m="x", auroc=.96, sensitivity=.99, specificity=.75, brier=.08, built_limit=0, feature_hash="h", champion_auroc=.965, trial_auroc=None)
    schema = "m string, auroc double, sensitivity double, specificity double, brier double, built_limit int, feature_hash string, champion_auroc double, trial_auroc double"
    rules = [governance.Rule("auroc", "auroc", at_least=.95), governance.Rule("brier", "brier", at_most=.12)]
    failed = lambda **kw: {r["check_name"] for r in governance.gate(spark.createDataFrame([tuple({**base, **kw}.values())], schema), ["m"], rules, "h", .01)
                           .where("not passed").collect()}
    assert failed() == set()
    assert failed(champion_auroc=.98) == {"no regression against the incumbent"}
    assert failed(champion_auroc=None) == set()
    assert failed(champion_auroc=None, trial_auroc=.98) == {"no regression against the incumbent"}
    assert failed(built_limit=9, feature_hash="other", brier=.2) == {"trained on the whole table", "feature hash matches", "brier"}
    events = spark.createDataFrame([(1, "x", "DEPLOYED", "v1", 1), (2, "x", "SILENT_TRIAL", "v2", 2), (3, "x", "PROMOTED", "v2", 3),
                                    (4, "x", "SILENT_TRIAL", "v3", 4)], "id int, model string, event string, model_version string, at int")
    state = lambda n: values(governance.stage_state(events.where(F.col("id") <= n), "at", "id"), "stage", "model_version")
    assert state(2) == [("champion", "v1"), ("silent_trial", "v2")]
    assert state(3) == [("champion", "v2")]
    assert state(4) == [("champion", "v2"), ("silent_trial", "v3")]


def test_names_that_hide_keys(spark):
    names = ["person123_bacteria_4.jpeg", "IM-0115-0001.jpeg", "NORMAL2-IM-0927-0001.jpeg", "other.png", "QC-BLUR-IM-1-2.png"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(scalars.person_from_file(F.col("n")).alias("k"), scalars.planted_kind(F.col("n")).alias("p"), scalars.planted_original(F.col("n")).alias("o")).collect()
    assert [r["k"] for r in got][:4] == ["person123", "IM-0115", "NORMAL2-IM-0927", "other"]
    assert (got[4]["p"], got[4]["o"]) == ("BLUR", "IM-1-2.png")


def test_quantiles_do_not_depend_on_pieces_or_partitions(spark):
    rng = random.Random(11)
    rows = [("same", 0.01), ("same", 0.01)] + [(f"g{n}", round(rng.random(), 2)) for n in (7, 53, 101) for _ in range(n)]
    probs = {f"q{i}": i / 10 for i in range(11)}
    found = []
    for parts, pieces in ((1, "1000000"), (4, "1000000"), (64, "5")):
        spark.conf.set("spark.worklake.pieceRows", pieces)
        df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
        found.append({r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()})
    spark.conf.unset("spark.worklake.pieceRows")
    assert found[0] == found[1] == found[2] and set(found[0]["same"][1:]) == {0.01}


def test_quantiles_of_counted_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, n int")
    assert exact_quantiles(df, [], "v", {"q": 0.4}, "n").first().q == pytest.approx(np.quantile([1] * 3 + [2] + [10] * 4, 0.4))


def test_pieces_hold_about_the_wanted_rows(spark):
    spark.conf.set("spark.worklake.pieceRows", "20000")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        rows = spark.range(200_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                                            F.hash("id").alias("v"), "id")
        cut = chunk(rows, ["k"], [F.col("v"), F.col("id")])
        sizes = [r["count"] for r in cut.groupBy(CHUNK).count().collect()]
        assert len(sizes) == 10 and max(sizes) <= 40_000
        n = running(cut, ["k"], [F.col("v"), F.col("id")], {"n": (COUNT,)})
        assert n.groupBy("k").agg(F.max("n").alias("m"), F.count_distinct("n").alias("d"), F.count("n").alias("c")).where("m <> c or d <> c").count() == 0
    finally:
        spark.conf.unset("spark.worklake.pieceRows")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_many_models_in_one_table(spark, pieces):
    rng = random.Random(5)
    rows = [(m, s, rng.randint(0, 1), round(rng.random(), 2)) for m in (0.1, 0.2) for s in ("val", "test") for _ in range(60)] + [(0.3, "val", 0, 0.4)]
    df = spark.createDataFrame(rows, "c double, split string, y int, s double")
    ranked = evaluate.ranked_counts(evaluate.score_counts(df, "y", "s", ["c", "split"]), ["c", "split"])
    cut = evaluate.thresholds(ranked.where("split = 'val'"), ["c"], 0.9)
    cuts = {r.c: r.threshold for r in cut.collect()}
    got = {(r.c, r.split): r for r in evaluate.model_metrics(ranked.join(cut, "c"), ["c", "split"]).collect()}
    bands = evaluate.model_bands(ranked.join(cut, "c").where("split = 'test'"), ["c"], [0.5, 0.95]).collect()
    assert cuts[0.3] == 0.5 and got[(0.3, "val")].auroc is None
    for c in (0.1, 0.2):
        one = df.where(F.col("c") == c)
        assert cuts[c] == evaluate.choose_threshold(one.where("split = 'val'"), "y", "s", 0.9).first()[0]
        for split in ("val", "test"):
            part, r = one.where(F.col("split") == split), got[(c, split)]
            plain = evaluate.classification_metrics(part, "y", "s", F.lit(cuts[c])).first()
            assert all(r[k] == pytest.approx(plain[k]) for k in ("n", "prevalence", "tp", "fp", "tn", "fn", "sensitivity", "specificity", "precision", "f1"))
            assert r.auroc == pytest.approx(evaluate.auroc(part, "y", "s").first()[0]) and r.auprc == pytest.approx(evaluate.auprc(part, "y", "s").first()[0])
            assert r.brier == pytest.approx(evaluate.brier(part, "y", "s").first()[0])
        plain = {r.cut: r for r in evaluate.p1_cut_sweep(one.where("split = 'test'"), "y", "s", cuts[c], [0.5, 0.95]).collect()}
        assert {r.cut: tuple(r[2:]) for r in bands if r.c == c} == {k: tuple(r[1:]) for k, r in plain.items()}


def test_only_touched_dates_are_read_again(spark):
    from worklake.session import scratch_path
    from worklake.sources import tables

    path = scratch_path(spark, "items")
    rows = [(date(2024, 1, d), 10 * d + i) for d in (1, 2, 3) for i in range(4)]
    tables.write_table(spark.createDataFrame(rows, "business_date date, item_id int"), path)
    arrived = spark.createDataFrame([(21,), (22,), (999,)], "item_id int")
    touched = outcomes.touched_dates(arrived, tables.read_table(spark, path), "item_id", "business_date")
    assert touched == [date(2024, 1, 2)]
    again = tables.read_table(spark, path, F.col("business_date").isin(touched))
    assert again.count() == 4 and len(again.inputFiles()) >= 1
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-02" in plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]


def test_audit_rows_sum_up_entities(spark):
    checks = spark.createDataFrame([("bronze", "MATCHED"), ("bronze", "EXPLAINED")], "stage string, status string")
    volumes = spark.createDataFrame([("bronze", "a", 5, 4, 1), ("bronze", "b", None, None, None)], "stage string, entity string, rows_in long, rows_out long, rows_rejected long")
    got = {r.entity: (r.rows_in, r.rows_out, r.rows_rejected, r.status) for r in recon.audit_rows(checks, volumes, ["stage"]).collect()}
    assert got == {"*": (5, 4, 1, "COMPLETED"), "a": (5, 4, 1, "COMMITTED"), "b": (None, None, None, "MISSING")}


def test_stored_bins_give_the_same_index(spark):
    rng = random.Random(9)
    rows = [(i < 300, "ab"[i % 2], rng.gauss(0, 1) + (i >= 300) * 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "ref boolean, lot string, v double")
    bins = drift.reference_bins(df.where("ref"), ["v"])
    now = df.where("NOT ref")
    whole = drift.psi(df, ["v"], F.col("ref")).first().psi
    assert drift.psi_of_counts(bins, drift.value_counts(now, ["v"])).first().psi == pytest.approx(whole)
    sizes = now.groupBy("lot").agg(F.count(F.lit(1)).alias("rows")).unionByName(spark.createDataFrame([("c", 0)], "lot string, rows long"))
    report = {r.lot: r for r in drift.drift_report(drift.psi_of_counts(bins, drift.value_counts(now, ["v"], "lot"), "lot"), sizes, ["lot"], 0.1, 0.25, 100).collect()}
    for lot in "ab":
        part = [v for ref, k, v in rows if not ref and k == lot]
        assert report[lot].psi_max == pytest.approx(round(psi_by_hand([v for ref, _, v in rows if ref], part), 4)) and report[lot].rows == 100
    assert (report["c"].psi_max, report["c"].psi_json, report["c"].drift_level) == (None, "{}", "TOO_FEW")
