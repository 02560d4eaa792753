"""Inline cases with values worked out from the rules, and figures that published files must agree with."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import labels, text
from quarry.operators import curves, effects, features, models, spectral
from quarry.plans import report
from quarry.sources import records

# A published table of ten answers (label, perplexity, mean and least log-probability, length).
BASELINE = [
    (1, 2.633460760116577, -0.96875, -6.875, 128), (1, 1.2947964668273926, -0.2578125, -3.40625, 70), (0, 2.173772096633911, -0.77734375, -4.625, 76), (0, 1.4157657623291016, -0.34765625, -4.0625, 74),
    (1, 1.5951155424118042, -0.466796875, -6.28125, 102), (1, 1.7287695407867432, -0.546875, -6.9375, 128), (1, 1.8313227891921997, -0.60546875, -6.46875, 109), (1, 1.522090196609497, -0.419921875, -3.5625, 65),
    (0, 1.7241748571395874, -0.54296875, -6.03125, 128), (1, 1.2925162315368652, -0.255859375, -5.875, 128),
]
# One metric's published p-values by layer, raw and corrected.
RAW_P = [
    2.514739212074047e-34, 1.7113567990873963e-22, 5.536328980446621e-06, 0.4196084966932806, 3.6201052257403286e-16, 6.166679810696444e-17,
    2.2109424452896115e-37, 1.513508817868084e-18, 1.6336598720550696e-25, 5.374682878083358e-13, 7.873981901940356e-31, 5.547618138948839e-26,
    1.130603772636497e-38, 1.6228108735544435e-35, 2.782786853967748e-39, 2.890968303284734e-27, 4.199461680663909e-52, 9.822777840475104e-50,
    2.478943063774194e-40, 5.456274402669171e-60, 1.4420592319018666e-57, 5.01910589268675e-50, 3.810478229089789e-56, 5.031869379519607e-55,
    6.835367045286325e-56, 3.3406490001498765e-56, 2.2954458359571248e-52, 2.6741030970219756e-48, 3.575673752875689e-49, 3.3224156166075484e-53,
    1.4248469318387657e-52, 2.2207629824935483e-60,
]
CORRECTED_P = [
    3.8319835612556907e-34, 2.1062852911844878e-22, 5.714920237880383e-06, 0.4196084966932806, 3.9945988697824316e-16, 7.047634069367365e-17,
    3.723692539435135e-37, 1.793788228584396e-18, 2.0910846362304892e-25, 5.732995069955581e-13, 1.1453064584640518e-30, 7.396824185265118e-26,
    2.0099622624648837e-38, 2.5964973976871095e-35, 5.2381870192334075e-39, 4.022216769787456e-27, 1.2216615798295008e-51, 2.4179145453477176e-49,
    4.957886127548388e-40, 8.730039044270674e-59, 1.5381965140286577e-56, 1.3384282380498e-49, 2.438706066617465e-55, 2.300283144923249e-54,
    3.645529090819373e-55, 2.438706066617465e-55, 7.345426675062799e-52, 5.704753273646881e-48, 8.172968578001574e-49, 1.3289662466430194e-52,
    5.066122424315611e-52, 7.1064415439793545e-59,
]


def long(spark, y, v):
    return spark.createDataFrame([("f", i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, v, strict=True))], "feature string, row_id long, y int, value double")


CASES = [
    ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":1}}', 0, 0), ('{"name":"f","arguments":"{\\"x\\":1}"}', '{"name":"f","arguments":{"x":1}}', 0, 0),
    ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":"1"}}', 0, 1), ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":1.0}}', 0, 0),
    ('{"name":"f","arguments":{"x":"1.50"}}', '{"name":"f","arguments":{"x":"1.5"}}', 0, 1), ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":1,"y":2}}', 0, 1),
    ('{"name":"f","arguments":{"x":1,"y":2}}', '{"name":"f","arguments":{"x":1}}', 1, 1), ('{"name":"f"}', '{"name":"g"}', 1, 1), ('{"name":"f"}', '{"name":"f","parameters":{}}', 1, 1),
    ("one text", "other words", 0, 0), ("text", "a ``` b", 1, 1), ("import x", "import y", 0, 0), ("text", '{"name":"f"}', 1, 1), ('{"name":"f"}', "text", 1, 1), ("{broken", '{"name":"f"}', 0, 0),
    ("42", "42", 1, None), ("{}", "{}", 0, 0), ('{"name":"f"}', '{"name":"f","arguments":{}}', 0, 0), ("null", "plain", 0, 0),
]
REACT = [
    ('Action: get\nAction Input: {"a": "X y"}', 'Action: GET Action Input: {"a":"xY"}', 0), ('Action: get Action Input: {"a": {"b":1}}', 'Action: get Action Input: {"a": {"b":1}}', 1),
    ('get(a="1", b=2)', 'get(a="1", b=2)', 0), ("f(a=1)", "f(a=1,b=2)", 0), ("f(a=1,b=2)", "f(a=1)", 1), ("plain text", "plain text", 1),
]


@pytest.mark.parametrize("case", CASES)
def test_structured(case):
    assert (labels.structured(*case[:2]), labels.structured(*case[:2], strict=True)) == case[2:]


@pytest.mark.parametrize("case", REACT)
def test_react(case):
    assert labels.react(*case[:2]) == case[2]


def test_taxonomies(spark):
    df = spark.createDataFrame([("exchange message",), ("multiple",), ("updated",), ("latest news",), ("sql query",)], "t string")
    got = [tuple(r) for r in df.select(text.domain("t", text.EIGHT), text.domain("t", text.THREE), text.domain("t", text.SIX, "Other")).collect()]
    assert got == [("communication", "finance", "Personal"), ("other", "other", "Finance"), ("other", "other", "Personal"), ("other", "other", "Search"), ("search", "other", "Other")]


def test_curves(spark):
    k = ["feature"]
    assert curves.auc(long(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), k).first()["auc"] == 0.75
    tied = long(spark, [0, 1, 1], [2, 2, 2])
    assert curves.auc(tied, k).first()["auc"] == 0.5 and curves.directed(tied, k, "pearson").first()["corr"] is None
    zero = features.unpivot(spark.createDataFrame([(0, 0, -0.0), (1, 1, 0.0)], "row_id int, y int, f double"), ["row_id", "y"], ["f"])
    assert curves.auc(zero, k).first()["auc"] == 0.5
    none = curves.best(long(spark, [1, 1, 0, 0], [1, 2, 3, 4]), k).first()
    assert (none["tp"], none["fp"], none["threshold"]) == (0, 0, math.inf)
    y, v = [1] * 20 + [0] * 20, [1 + i / 19 for i in range(19)] + [7150] + [3 + i / 19 for i in range(20)]
    r = curves.directed(long(spark, y, v), k, "pearson_strict").first()
    assert r["direction"] == "Positive" and abs(r["auc"] - 0.05) < 1e-12 and abs(r["corr"] - 0.159) < 2e-3
    assert curves.auc(long(spark, [1, 1], [1, 2]), k).first()["auc"] is None


def test_statistics(spark):
    p = spark.createDataFrame([("a", i, x) for i, x in enumerate((0.01, 0.04, 0.03, 0.005))], "m string, i int, p double")
    assert [round(r["p_adjusted"], 12) for r in effects.benjamini_hochberg(p, ["m"]).orderBy("i").collect()] == [0.02, 0.04, 0.04, 0.02]
    assert effects.cohens_d(long(spark, [1, 1, 0, 0], [2, 4, 1, 1]), ["feature"]).first()["d"] == pytest.approx(2.0)
    assert effects._beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12)
    assert effects._beta(5.0, 0.5, 10 / (10 + 2.228138852**2)) == pytest.approx(0.05, abs=1e-8)
    assert math.erfc(16.0 / math.sqrt(2)) > 0
    nan = spark.createDataFrame([(float("nan"),), (math.inf,), (1.0,)], "value double")
    assert [r[0] for r in features.clean(nan, "zero").collect()] == [0.0, math.inf, 1.0]
    assert features.clean(nan, "zero_inf").collect()[1][0] == np.finfo(float).max and features.clean(nan, "drop").count() == 2
    lo, hi = effects.bootstrap_auc(long(spark, [0, 1] * 40, [i + 15 * (i % 2) for i in range(80)]), ["feature"], draws=200).select("lo", "hi").first()
    assert 0.4 < lo < hi < 1


def baseline_file(tmp_path, name="test_manual_ppl.csv"):
    lines = ["is_hallucination,ppl,logprob_mean,logprob_min,len_gen", *(",".join(map(str, r)) for r in BASELINE)]
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_published_likelihoods(spark, tmp_path):
    df = records.csv(spark, baseline_file(tmp_path), records.BASELINE)
    x = features.unpivot(df.withColumn("row_id", F.monotonically_increasing_id()).withColumnRenamed("is_hallucination", "y"), ["row_id", "y"], ["ppl", "logprob_min"])
    got = {r["feature"]: r for r in curves.directed(x, ["feature"], "pearson_strict").collect()}
    assert got["ppl"]["auc"] == pytest.approx(0.5714285714285714) and got["ppl"]["direction"] == "Negative"
    assert got["logprob_min"]["auc"] == pytest.approx(0.6666666666666667) and got["logprob_min"]["direction"] == "Negative"
    flipped = x.withColumn("value", -F.col("value"))
    best = {r["feature"]: r for r in curves.best(flipped, ["feature"], "f1").collect()}
    assert (best["ppl"]["precision"], best["ppl"]["tpr"]) == (pytest.approx(0.7), 1.0)


def test_published_corrections(spark):
    df = spark.createDataFrame([("m", i, p, q) for i, (p, q) in enumerate(zip(RAW_P, CORRECTED_P, strict=True))], "metric string, layer int, p double, want double")
    got = effects.benjamini_hochberg(df, ["metric"]).collect()
    assert len(got) == 32
    for r in got:
        assert r["p_adjusted"] == pytest.approx(r["want"], rel=1e-12) and r["significant"] == (r["want"] < 0.05)


def test_models():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 2))
    y = (x[:, 0] + 0.5 * rng.standard_normal(80) > 0).astype(int)
    for pen in (False, True):
        w = models.newton(x, y, penalise_intercept=pen)
        x1 = np.column_stack([x, np.ones(80)])
        grad = np.array([1, 1, float(pen)]) * w + x1.T @ (1 / (1 + np.exp(-x1 @ w)) - y)
        assert np.abs(grad).max() < 1e-8
    assert models.area(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])) == 0.75


def test_spectra():
    a = np.zeros((4, 4))
    a[0, 1] = a[1, 0] = a[2, 3] = a[3, 2] = 1.0
    for kind in ("comb", "sym", "rw"):
        values = np.linalg.eigvalsh(spectral.laplacian(a, kind))
        assert abs(values[0]) < 1e-12 and abs(values[1]) < 1e-12
    full = np.ones((4, 4)) - np.eye(4)
    assert spectral.diagnostics(np.ones((4, 2)), spectral.laplacian(full, "comb"))[2] == pytest.approx(0, abs=1e-12)
    assert spectral.diagnostics(np.eye(4), spectral.laplacian(full, "comb"))[1] == pytest.approx(4)


def test_messages(spark):
    df = spark.createDataFrame([("USER: hi\nASSISTANT: yes {a} <|endoftext|>\nFUNCTION RESPONSE: 1\nUSER: more",)], "t string").withColumn("m", text.chat_turns("t"))
    r = df.select("m", text.merge_turns("m").alias("merged"), text.last_user("m").alias("u"), text.target_turn("m", True).alias("a"), text.template("m").alias("p")).first()
    assert [(x["role"], x["content"]) for x in r["m"]] == [("user", "hi"), ("assistant", "yes {a}"), ("tool", "1"), ("user", "more")]
    assert [(x["role"], x["content"]) for x in r["merged"]] == [("user", "hi"), ("assistant", "yes {a}"), ("user", "1\n\nmore")]
    assert r["u"]["content"] == "more" and r["a"]["content"] == "yes {a}" and r["p"].endswith("\nASSISTANT:")
    s = spark.createDataFrame([("['L1_HFER', 'L2_Entropy']", "x" * 50)], "f string, l string").select(text.list_literal("f"), text.ellipsis("l")).first()
    assert s[0] == ["L1_HFER", "L2_Entropy"] and s[1] == "x" * 37 + "..."


def test_files(spark, tmp_path):
    one = {"system": "s", "input_messages": [{"role": "user", "content": "q"}], "ground_truth": "g", "generated": "g", "label": 0, "domain_match": True}
    (tmp_path / "rec.jsonl").write_text("\n".join(json.dumps(one | {"label": i % 2}) for i in range(6)) + "\n")
    rec = records.jsonl(spark, f"{tmp_path}/rec.jsonl")
    assert rec.count() == 6 and rec.first()["input_messages"][0]["role"] == "user"
    names = [f"L{i}_{m}" for i in range(32) for m in features.METRICS]
    lines = [",".join(["is_hallucination", *names]), *(",".join(["1", *(f"{(r + 1) * (k + 1) / 1000}" for k in range(128))]) for r in range(5))]
    (tmp_path / "sweep.csv").write_text("\n".join(lines) + "\n")
    wide = records.sweep(spark, f"{tmp_path}/sweep.csv", 32).withColumn("row_id", F.monotonically_increasing_id()).withColumnRenamed("is_hallucination", "y")
    x = features.parsed(features.unpivot(wide, ["row_id", "y"], features.pick(wide.columns)))
    assert x.count() == 5 * 128 and x.where("layer is null").count() == 0 and features.enough(x, ["feature"]).count() == 0
    named = records.named_files(spark, baseline_file(tmp_path), records.BASELINE)
    assert named.select("dataset").distinct().first()[0] == "Test Manual"
    df = spark.createDataFrame([(1, "A"), (2, "B")], "row_id int, k string")
    records.append_new(df, f"{tmp_path}/t", "row_id")
    records.append_new(df.unionByName(spark.createDataFrame([(3, "C")], "row_id int, k string")), f"{tmp_path}/t", "row_id")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    from quarry.streaming.resume import run_once

    df.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        run_once(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert report.markdown(df.orderBy("row_id")).splitlines()[2] == "| 1 | A |" and r"\midrule" in report.latex(df, "k")


def test_groups_come_whole(spark):
    x = np.random.default_rng(9).standard_normal((300, 8))
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = spectral.by_group(df, "label", "embedding", "vec_id").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a = np.maximum(unit @ unit.T, 0)
    np.fill_diagonal(a, 0)
    d = a.sum(axis=1)
    values = np.linalg.eigvalsh(np.eye(300) - a / np.sqrt(d[:, None] * d[None, :]))
    assert len(got) == 1 and (got[0]["part"], got[0]["n"]) == (0, 300) and got[0]["fiedler"] == pytest.approx(values[1], abs=1e-9)


def test_bootstrap_query_draws(spark, monkeypatch):
    import inspect

    from quarry.plans import queries

    seen, own = [], effects.bootstrap_auc
    monkeypatch.setattr(effects, "bootstrap_auc", lambda *a, **k: (seen.append(inspect.signature(own).bind(*a, **k)), own(*a, **k))[1])
    queries.queries()["bootstrap_ci"](spark, "/root/testdata/sf0.001")
    for x in seen:
        x.apply_defaults()
    assert [x.arguments["draws"] for x in seen] == [1000]


def test_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(4)
    y, v = rng.integers(0, 2, 400), rng.integers(0, 60, 400)
    v = v + 12 * y
    df = long(spark, y, v)
    lo, hi = effects.bootstrap_auc(df, ["feature"]).select("lo", "hi").first()
    draws = []
    for _ in range(600):
        i = rng.integers(0, 400, 400)
        draws.append(models.area(y[i], v[i].astype(float)))
    assert lo == pytest.approx(np.quantile(draws, 0.025), abs=0.012) and hi == pytest.approx(np.quantile(draws, 0.975), abs=0.012)
    again = effects.bootstrap_auc(df.repartition(7), ["feature"]).select("lo", "hi").first()
    assert (lo, hi) == tuple(again)
    one = effects.bootstrap_auc(long(spark, [1, 1], [1, 2]), ["feature"], draws=10, fallback=(0.5, 0.5)).select("lo", "hi").first()
    assert tuple(one) == (0.5, 0.5)
    index = effects.bootstrap_auc(df, ["feature"], rule="index").select("lo", "hi").first()
    assert index["lo"] == pytest.approx(lo, abs=0.01) and index["hi"] == pytest.approx(hi, abs=0.01)


def test_running_sums_by_ranges(spark):
    from quarry.operators import ranks

    rng = np.random.default_rng(5)
    rows = [(None if k % 3 == 0 else f"g{k % 2}", float(v), float(k % 5)) for k, v in enumerate(rng.permutation(900))]
    got = ranks.running(spark.createDataFrame(rows, "g string, value double, p double").repartition(3), ["g"], "value", ["p"], bins=16).collect()
    assert len(got) == 900
    for r in got:
        own = [x for x in rows if x[0] == r["g"]]
        assert r["below_p"] == sum(p for _, v, p in own if v < r["value"]) and r["all_p"] == sum(p for _, _, p in own)


def test_fit_on_rows_and_unranking(spark):
    import itertools

    assert [models.unranked(k, 6, 3) for k in range(20)] == list(itertools.combinations(range(6), 3))
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.standard_normal(300) > 0.4).astype(int)
    df = spark.createDataFrame([(f, i, int(y[i]), float(x[i, k])) for i in range(300) for k, f in enumerate("ab")], "feature string, row_id long, y int, value double").repartition(4)
    for how in ({}, {"balanced": True}, {"penalise_intercept": True, "c": 0.3}):
        assert models.fit(df, ["a", "b"], **how) == pytest.approx(models.newton(x, y, **how), abs=1e-6)


def test_verified_and_calibrated(spark):
    rng = np.random.default_rng(2)
    y = (np.arange(120) % 3 == 0).astype(int)
    x = np.column_stack([y + 0.3 * rng.standard_normal(120), rng.standard_normal(120)])
    df = spark.createDataFrame([(f, i, int(y[i]), float(x[i, k])) for i in range(120) for k, f in enumerate("ab")], "feature string, row_id long, y int, value double")
    got = {r["config"]: r for r in models.verified(df, {"good": ["a"], "bad": ["b"], "lost": ["a", "c"]}).collect()}
    assert set(got) == {"good", "bad"} and got["good"]["passed"] and not got["bad"]["passed"] and got["good"]["tp"] + got["good"]["fn"] == 40
    r = models.calibrated(df.where("row_id % 2 = 0"), df.where("row_id % 2 = 1"), ["a", "b"]).first()
    assert r["auc_calibration"] > 0.95 and r["gap"] == pytest.approx(r["auc_calibration"] - r["auc_validation"]) and r["tp"] + r["fp"] + r["fn"] + r["tn"] == 60
    e = {r["n"]: r for r in models.efficiency(df, ["a", "b"], {1: ["a"], 2: ["a", "b"]}, sizes=(10, 60), trials=5).collect()}
    assert e[60]["percent_1"] == 100 and e[60]["percent_2"] == 100 and e[60]["valid_trials"] == 5


def test_reports(spark):
    one = spark.createDataFrame([("c1", 10, 4, 0.9, 0.8, 0.95, 0.5, 3.0, 1.0, 1.0, 5.0, 0.75, 0.75, 0.75, 5 / 6, 1 / 6)], "config string, n int, pos int, auc double, lo double, hi double, threshold double, tp double, fp double, fn double, tn double, recall double, precision double, f1 double, specificity double, fpr double")
    tests = spark.createDataFrame([("c1", "L1_HFER", 0.2, 0.1, 0.1, 0.05, 1.2, 0.0004)], "config string, feature string, i_mean double, i_std double, v_mean double, v_std double, d double, p double")
    text_ = report.config_report(one, tests)
    assert "## c1" in text_ and "- recall 0.7500 (3/4)" in text_ and "| positive | 1 | 3 |" in text_ and "| L1_HFER | 0.2000±0.1000 | 0.1000±0.0500 | +1.200 | 4.00e-04 | *** |" in text_
    cols = "feature string, auc double, recall double, precision double, detected long, d double, p double"
    best = spark.createDataFrame([("M-8B", "HFER", 0.7, 0.5, 0.4, 9, 0.3, 0.2), ("N", "HFER", 0.8, 0.5, 0.4, 9, 0.3, 1e-9)], "model string, " + cols)
    ppl = spark.createDataFrame([("M-8B", "ppl", 0.6, 0.5, 0.4, 8, 0.1, 0.01)], "model string, " + cols)
    bench = spark.createDataFrame([("L1_HFER", 0.6, 0.5, 0.4, 8, 0.1, 0.01), ("L2_HFER", 0.7, 0.5, 0.4, 8, 0.1, 0.01), ("L2_Entropy", 0.5, 0.5, 0.4, 8, 0.1, 0.01)], cols)
    rows = report.baseline_table(best, ppl, bench, "tools").splitlines()
    assert [r.split(" & ")[:3] for r in rows if " & " in r][1:] == [[r"\textbf{M}", "HFER", "0.7000"], ["", "ppl", "0.6000"], [r"\textbf{N}", "HFER", "0.8000"], [r"\textbf{tools}", "HFER", "0.7000"], ["", "Entropy", "0.5000"]]
    assert rows.count(r"\midrule") == 3 and "$<0.001$" in "\n".join(rows)
    profile = spark.createDataFrame([(1, 0.1, 0.01, 0.2, 0.02, 0.11, 0.09, 0.22, 0.18)], "layer int, v_mean double, v_std double, i_mean double, i_std double, v_upper double, v_lower double, i_upper double, i_lower double")
    assert "coordinates {(1,0.2000)}" in report.plot_source(profile, "HFER") and report.console(bench, "auc", 1).count("L2_HFER") == 1


def test_jobs_and_sinks(spark, tmp_path):
    from quarry.plans import jobs

    for n in "ab":
        (tmp_path / f"{n}.jsonl").write_text('{"label": 1, "generated": "x"}\nbroken\n{"label": 0, "generated": "y"}\n')
    todo = [jobs.Job(n, f"{tmp_path}/{n}.jsonl", f"{tmp_path}/{n}.out") for n in "abc"]

    def copy(s, job):
        good, counts = records.jsonl_counted(s, job.input)
        assert tuple(counts.first()) == (3, 1)
        if job.name == "b":
            raise RuntimeError("no luck")
        records.write_jsonl(good, job.output)

    steps = [jobs.Step("copy", copy, lambda j: j.output), jobs.Step("csv", lambda s, j: records.write_csv(s.read.json(j.output), f"{j.output}.csv"), lambda j: f"{j.output}.csv")]
    assert [(j.name, s.name) for j, s in jobs.plan(spark, todo, steps)] == [("a", "copy"), ("a", "csv"), ("b", "copy"), ("b", "csv")]
    assert jobs.execute(spark, jobs.plan(spark, todo, steps), f"{tmp_path}/log") == [("b", "copy", "no luck")]
    assert [(j.name, s.name) for j, s in jobs.plan(spark, todo, steps)] == [("b", "copy"), ("b", "csv")] and spark.read.json(f"{tmp_path}/log").count() == 1
    assert spark.read.option("header", True).csv(f"{tmp_path}/a.out.csv").count() == 2 and jobs.plan(spark, todo, steps, limit=1) == []
    (tmp_path / "mistral_math.csv").write_text("v\n1\n")
    assert records.named_files(spark, f"{tmp_path}/mistral_math.csv", "v int", prefix="mistral_").first()["dataset"] == "Math"
    assert records.hub(spark, "/root/testdata/sf0.001/nation.parquet", 3, 4, "n_nationkey").count() == 4
