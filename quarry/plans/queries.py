"""Queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import labels, text
from quarry.operators import curves, effects, features, models, sampling, spectral

METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, y, lang, source and four text features of labelled documents, long."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    n = F.length("text")
    less = lambda c: n - F.length(F.replace("text", F.lit(c), F.lit("")))
    wide = d.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("y"), "lang", "source", n.alias("chars"), less("\n").alias("lines"), less(",").alias("commas"), less(" ").alias("blanks"))
    return features.unpivot(wide, ["row_id", "y", "lang", "source"], ["chars", "lines", "commas", "blanks"])


DOCS = """d AS (SELECT d.doc_id AS row_id, CAST(quality AS INT) AS y, lang, source, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) AS lines,
 length(text) - length(replace(text, ',', '')) AS commas, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
x AS (SELECT row_id, y, lang, source, 'chars' AS feature, CAST(chars AS DOUBLE) AS value FROM d UNION ALL SELECT row_id, y, lang, source, 'lines', CAST(lines AS DOUBLE) FROM d
 UNION ALL SELECT row_id, y, lang, source, 'commas', CAST(commas AS DOUBLE) FROM d UNION ALL SELECT row_id, y, lang, source, 'blanks', CAST(blanks AS DOUBLE) FROM d)"""


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, y, layer, metric, value: line numbers as layers, measures as metrics, y a returned line."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linenumber").alias("layer"), *METRICS)
    return features.unpivot(li, ["row_id", "y", "layer"], list(METRICS)).withColumnRenamed("feature", "metric")


LAYERS = "x AS (" + " UNION ALL ".join(f"SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linenumber AS layer, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM lineitem" for m in METRICS) + ")"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _areas(keys: str, src: str = "x") -> str:
    return f"""g AS (SELECT {keys}, value, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS n FROM {src} GROUP BY {keys}, value),
w AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won FROM g),
a AS (SELECT {keys}, sum(won) / nullif(sum(p) * sum(n), 0) AS auc, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(p) + sum(n) AS BIGINT) AS n FROM w GROUP BY {keys})"""


def _curve(keys: str, start: bool = False) -> str:
    own = f"SELECT {keys}, value AS threshold, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY {keys}) AS pos, sum(n) OVER (PARTITION BY {keys}) AS neg FROM g WINDOW d AS (PARTITION BY {keys} ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    top = f" UNION ALL SELECT {keys}, CAST('Infinity' AS DOUBLE), 0e0, 0e0, sum(p), sum(n) FROM g GROUP BY {keys}" if start else ""
    return f"""c0 AS ({own}{top}), c1 AS (SELECT *, coalesce(tp / nullif(pos, 0), 0) AS tpr, coalesce(fp / nullif(neg, 0), 0) AS fpr, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM c0),
c AS (SELECT *, tpr - fpr AS j, coalesce(2e0 * precision * tpr / nullif(precision + tpr + 1e-8, 0), 0) AS f1 FROM c1)"""


_MOM = """m AS (SELECT {k}, CAST(count(CASE WHEN y = 0 THEN value END) AS DOUBLE) AS n0, CAST(count(CASE WHEN y = 1 THEN value END) AS DOUBLE) AS n1, avg(CASE WHEN y = 0 THEN value END) AS m0, avg(CASE WHEN y = 1 THEN value END) AS m1,
 var_samp(CASE WHEN y = 0 THEN value END) AS v0, var_samp(CASE WHEN y = 1 THEN value END) AS v1 FROM x GROUP BY {k})"""
_CORR = "covar_pop(value, CAST(y AS DOUBLE)) / nullif(stddev_pop(value) * stddev_pop(CAST(y AS DOUBLE)), 0)"
_T = "(m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0)"
KEYWORDS = {"the": ["the ", " th"], "der": ["der ", " die"], "que": ["que ", " de "]}


def _case(col: str, rules: dict[str, list[str]], other: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({col}), '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in rules.items()) + f" ELSE '{other}' END"


#: Expected and generated calls with the labels that the rules give them by hand (loose and strict; of answers one).
CALLS = [
    ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":1}}', 0, 0), ('{"name":"f","arguments":{"x":1}}', '{"name":"f","arguments":{"x":"1"}}', 0, 1),
    ('{"name":"f","arguments":{"x":1}}', 'the call is {"name":"f","arguments":{"x":1,"y":2}}', 0, 1), ('{"name":"f","arguments":{"x":1,"y":2}}', '{"name":"f","arguments":{"x":1}}', 1, 1),
    ('{"name":"f"}', '{"name":"g"}', 1, 1), ('{"name":"f"}', '{"name":"f","parameters":{}}', 1, 1), ("one text", "other words", 0, 0), ("text", "a ``` b", 1, 1),
    ("import x", "import y", 0, 0), ("text", '{"name":"f"}', 1, 1), ("{broken", '{"name":"f"}', 0, 0), ("42", "42", 1, None), ("{}", "{}", 0, 0),
]
ANSWERS = [
    ('Action: get\nAction Input: {"a": "X y"}', 'Action: GET Action Input: {"a":"xY"}', 0), ('Action: get Action Input: {"a": {"b":1}}', 'Action: get Action Input: {"a": {"b":1}}', 1),
    ('get(a="1", b=2)', 'get(a="1", b=2)', 0), ("f(a=1)", "f(a=1,b=2)", 0), ("f(a=1,b=2)", "f(a=1)", 1), ("plain text", "plain text", 1),
]


def dealt(spark: SparkSession, sf: str, cases: list[tuple]) -> DataFrame:
    """The rows of part, each with one of the cases."""
    of = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in cases]), (F.pmod("p_partkey", F.lit(len(cases))) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", of(0).alias("truth"), of(1).alias("generated"))


def _expected(cases: list[tuple], k: int) -> str:
    return f"([{', '.join('NULL' if c[k] is None else str(c[k]) for c in cases)}])[p_partkey % {len(cases)} + 1]"


Q = Callable[[SparkSession, str], DataFrame]


def _defined() -> dict[str, tuple[Q, str | None]]:
    k, ml = ["feature"], ["metric", "layer"]
    youden = lambda s, d: curves.best(doc_features(s, d), k).select("feature", "threshold")
    first_half = lambda s, d: doc_features(s, d).where("row_id % 2 = 0")
    other_half = lambda s, d: doc_features(s, d).where("row_id % 2 = 1")
    labelled = lambda s, d: table(s, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("y"))
    pick = "SELECT feature, threshold, tp, fp, tpr, fpr, precision, j, f1 FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY {o}) AS r FROM c {w}) WHERE r = 1"
    point = ["feature", "threshold", "tp", "fp", "tpr", "fpr", "precision", "j", "f1"]
    r6 = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    pts = f"SELECT feature, {r6(point[1:])} FROM ({{}})"
    ylab = "CAST(quality AS INT)"
    md = "md5(CAST({c} AS VARCHAR) || '|42')"
    lab = f"x AS (SELECT doc_id AS row_id, {ylab} AS y, row_number() OVER (PARTITION BY {ylab} ORDER BY {md.format(c='doc_id')}, doc_id) AS r FROM labels)"
    conv = "CASE WHEN role = 'system' THEN 'user' ELSE role END"
    conf = """h AS (SELECT x.feature, value {op} threshold AS hit, y FROM x JOIN t ON x.feature = t.feature), q AS (SELECT feature, CAST(count(*) FILTER (hit AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (hit AND y = 0) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (NOT hit AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT hit AND y = 0) AS DOUBLE) AS tn FROM h GROUP BY feature)"""
    thr = "t AS (SELECT feature, threshold FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY j DESC, threshold DESC) AS r FROM c) WHERE r = 1)"
    half = DOCS.replace("x AS (SELECT", "x0 AS (SELECT", 1) + ", x AS (SELECT * FROM x0 WHERE row_id % 2 = 0)"
    prof = "SELECT metric, layer, round(v_mean, 6) AS v_mean, round(v_std, 6) AS v_std, round(i_mean, 6) AS i_mean, round(i_std, 6) AS i_std, round(v_mean + v_std, 6) AS v_upper, round(v_mean - v_std, 6) AS v_lower, round(i_mean + i_std, 6) AS i_upper, round(i_mean - i_std, 6) AS i_lower FROM (SELECT metric, layer, avg(CASE WHEN y = 0 THEN value END) AS v_mean, {s}(CASE WHEN y = 0 THEN value END) AS v_std, avg(CASE WHEN y = 1 THEN value END) AS i_mean, {s}(CASE WHEN y = 1 THEN value END) AS i_std FROM x GROUP BY metric, layer)"
    d_sql = "coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0)), 0), 0)"
    by_lang = f"WITH {DOCS}, {_areas('lang, feature')}, b AS (SELECT lang, feature, greatest(auc, 1 - auc) AS auc FROM a WHERE auc IS NOT NULL)"
    langs = lambda s, d: curves.directed(doc_features(s, d), ["lang", "feature"]).where("auc is not null")
    pool = ["chars", "lines", "commas", "blanks"]
    auc_of = lambda s, d: curves.directed(doc_features(s, d), k)
    from pyspark.sql.window import Window

    return {
        "feature_auc": (lambda s, d: rounded(curves.auc(doc_features(s, d), k)), f"WITH {DOCS}, {_areas('feature')} SELECT feature, round(auc, 6) AS auc, pos, n FROM a"),
        "feature_auc_directed": (lambda s, d: rounded(auc_of(s, d).orderBy(F.desc("auc"), "feature").limit(10)), f"WITH {DOCS}, {_areas('feature')} SELECT feature, round(greatest(auc, 1 - auc), 6) AS auc, pos, n, CASE WHEN auc < 0.5e0 THEN 'Negative' ELSE 'Positive' END AS direction FROM a ORDER BY 2 DESC, 1 LIMIT 10"),
        "layer_auc": (lambda s, d: rounded(curves.auc(layers(s, d), ml)), f"WITH {LAYERS}, {_areas('metric, layer')} SELECT metric, layer, round(auc, 6) AS auc, pos, n FROM a"),
        "direction_pearson": (lambda s, d: rounded(curves.directed(doc_features(s, d), k, "pearson_strict").select("feature", "auc", "direction", "corr")), f"WITH {DOCS}, {_areas('feature')}, r AS (SELECT feature, {_CORR} AS corr FROM x GROUP BY feature) SELECT a.feature, round(CASE WHEN corr > 0 THEN auc ELSE 1 - auc END, 6) AS auc, CASE WHEN corr > 0 THEN 'Positive' ELSE 'Negative' END AS direction, round(corr, 6) AS corr FROM a JOIN r ON a.feature = r.feature"),
        "roc_curve": (lambda s, d: rounded(curves.curve(layers(s, d), ["metric"]).select("metric", "threshold", "tp", "fp", "tpr", "fpr")), f"WITH {LAYERS}, {_areas('metric')}, {_curve('metric')} SELECT metric, {r6(['threshold', 'tp', 'fp', 'tpr', 'fpr'])} FROM c"),
        "pr_curve": (lambda s, d: rounded(curves.curve(layers(s, d), ["metric"]).select("metric", "threshold", "precision", F.col("tpr").alias("recall"), "f1")), f"WITH {LAYERS}, {_areas('metric')}, {_curve('metric')} SELECT metric, round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(tpr, 6) AS recall, round(f1, 6) AS f1 FROM c"),
        "youden_threshold": (lambda s, d: rounded(curves.best(doc_features(s, d), k).select(*point)), f"WITH {DOCS}, {_areas('feature')}, {_curve('feature', True)} " + pts.format(pick.format(o="j DESC, threshold DESC", w=""))),
        "best_f1_point": (lambda s, d: rounded(curves.best(doc_features(s, d), k, "f1").select(*point)), f"WITH {DOCS}, {_areas('feature')}, {_curve('feature')} " + pts.format(pick.format(o="f1 DESC, threshold", w=""))),
        "max_precision_point": (lambda s, d: rounded(curves.best(doc_features(s, d), k, "precision").select(*point)), f"WITH {DOCS}, {_areas('feature')}, {_curve('feature')} " + pts.format(pick.format(o="precision DESC, tpr DESC, threshold", w="WHERE tpr > 0.005e0"))),
        "confusion_at_threshold": (lambda s, d: rounded(curves.confusion(doc_features(s, d), k, youden(s, d)).select("feature", "tp", "fp", "fn", "tn", "precision", F.col("tpr").alias("recall"))), f"WITH {DOCS}, {_areas('feature')}, {_curve('feature', True)}, {thr}, {conf.format(op='>=')} SELECT feature, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM q"),
        "calibrate_validate": (lambda s, d: rounded(curves.confusion(other_half(s, d), k, curves.best(first_half(s, d), k).select("feature", "threshold"), ">").select("feature", "tp", "fp", "fn", "tn", "balanced")), f"WITH {half}, {_areas('feature')}, {_curve('feature', True)}, {thr}, {conf.format(op='>').replace('FROM x JOIN', 'FROM x0 x JOIN').replace('x.feature = t.feature', 'x.feature = t.feature AND row_id % 2 = 1')} SELECT feature, tp, fp, fn, tn, round((coalesce(tp / nullif(tp + fn, 0), 0) + 1 - coalesce(fp / nullif(fp + tn, 0), 0)) / 2, 6) AS balanced FROM q"),
        "class_report": (lambda s, d: rounded(curves.class_report(doc_features(s, d), k, youden(s, d))), f"WITH {DOCS}, {_areas('feature')}, {_curve('feature', True)}, {thr}, {conf.format(op='>=')}, r AS (SELECT feature, 0 AS class, coalesce(tn / nullif(tn + fn, 0), 0) AS precision, coalesce(tn / nullif(tn + fp, 0), 0) AS recall, CAST(tn + fp AS BIGINT) AS support FROM q UNION ALL SELECT feature, 1, coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), CAST(tp + fn AS BIGINT) FROM q) SELECT feature, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM r"),
        "layer_profile_pop": (lambda s, d: rounded(effects.profile(layers(s, d), ml, 0)), f"WITH {LAYERS} " + prof.format(s="stddev_pop")),
        "layer_profile_samp": (lambda s, d: rounded(effects.profile(layers(s, d), ml, 1)), f"WITH {LAYERS} " + prof.format(s="stddev_samp")),
        "layer_separation": (lambda s, d: rounded(effects.profile(layers(s, d), ml).groupBy("metric").agg(F.avg("v_mean").alias("val_mean"), F.avg("i_mean").alias("inv_mean"), (F.avg("i_mean") - F.avg("v_mean")).alias("sep"))), f"WITH {LAYERS}, p AS (SELECT metric, layer, avg(CASE WHEN y = 0 THEN value END) AS v, avg(CASE WHEN y = 1 THEN value END) AS i FROM x GROUP BY metric, layer) SELECT metric, round(avg(v), 6) AS val_mean, round(avg(i), 6) AS inv_mean, round(avg(i) - avg(v), 6) AS sep FROM p GROUP BY metric"),
        "cohens_d_signed": (lambda s, d: rounded(effects.cohens_d(layers(s, d), ml)), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')} SELECT metric, layer, round({d_sql}, 6) AS d FROM m"),
        "cohens_d_abs": (lambda s, d: rounded(effects.cohens_d(layers(s, d), ml, absolute=True)), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')} SELECT metric, layer, round(abs({d_sql}), 6) AS d FROM m"),
        "mann_whitney_u": (lambda s, d: rounded(effects.mann_whitney(doc_features(s, d), k), 5), f"WITH {DOCS}, {_areas('feature')}, u AS (SELECT feature, sum(won) AS u, sum(p) AS n1, sum(n) AS n0, sum((p + n) * (p + n) * (p + n) - (p + n)) AS ties FROM w GROUP BY feature) SELECT feature, round(u, 5) AS u, round(greatest(abs(u - n1 * n0 / 2) - 0.5e0, 0) / nullif(sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / nullif((n1 + n0) * (n1 + n0 - 1), 0))), 0), 5) AS z FROM u"),
        "mann_whitney_p": (lambda s, d: effects.mann_whitney(doc_features(s, d), k, p=True), None),
        "welch_t": (lambda s, d: rounded(effects.welch(layers(s, d), ml), 5), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')} SELECT metric, layer, round({_T}, 5) AS t, round((v1 / n1 + v0 / n0) * (v1 / n1 + v0 / n0) / nullif(v1 / n1 * v1 / n1 / (n1 - 1) + v0 / n0 * v0 / n0 / (n0 - 1), 0), 5) AS df FROM m WHERE n1 > 1 AND n0 > 1"),
        "welch_p": (lambda s, d: effects.welch(layers(s, d), ml, p=True), None),
        "bh_adjust": (lambda s, d: rounded(effects.benjamini_hochberg(effects.welch(layers(s, d), ml).withColumn("p", F.exp(-F.abs("t"))), ["metric"]).select("metric", "layer", "p", "p_adjusted", "significant")), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')}, p AS (SELECT metric, layer, exp(-abs({_T})) AS p FROM m WHERE n1 > 1 AND n0 > 1), r AS (SELECT *, p * count(*) OVER (PARTITION BY metric) / row_number() OVER (PARTITION BY metric ORDER BY p) AS raw FROM p), q AS (SELECT *, least(1e0, min(raw) OVER (PARTITION BY metric ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM r) SELECT metric, layer, round(p, 6) AS p, round(adj, 6) AS p_adjusted, adj < 0.05e0 AS significant FROM q"),
        "bootstrap_ci": (lambda s, d: effects.bootstrap_auc(doc_features(s, d), k), None),
        "class_balance": (lambda s, d: rounded(labelled(s, d).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("pos"), F.avg("y").alias("rate"))), f"SELECT count(*) AS n, CAST(sum({ylab}) AS BIGINT) AS pos, round(avg({ylab}), 6) AS rate FROM labels"),
        "domain_counts_8way": (lambda s, d: table(s, d, "documents").groupBy(text.domain("text", text.EIGHT).alias("domain")).agg(F.count("*").alias("n")), f"SELECT {_case('text', text.EIGHT, 'other')} AS domain, count(*) AS n FROM documents GROUP BY 1"),
        "domain_custom": (lambda s, d: table(s, d, "documents").groupBy(text.domain("text", KEYWORDS).alias("domain")).agg(F.count("*").alias("n")), f"SELECT {_case('text', KEYWORDS, 'other')} AS domain, count(*) AS n FROM documents GROUP BY 1"),
        "category_6way": (lambda s, d: table(s, d, "pages").groupBy(text.domain("html", text.SIX, "Other").alias("category")).agg(F.count("*").alias("n")), f"SELECT {_case('html', text.SIX, 'Other')} AS category, count(*) AS n FROM pages GROUP BY 1"),
        "domain_rate": (lambda s, d: rounded(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("pos"), (100.0 * F.avg("toxic")).alias("percent"))), "SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS pos, round(100e0 * avg(toxic), 6) AS percent FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"),
        "token_counts": (lambda s, d: table(s, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z]+)"), F.lit(1))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z]+)', 1)) AS token FROM pages) GROUP BY token"),
        "best_feature_per_group": (lambda s, d: rounded(langs(s, d).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("auc"), "feature"))).where("r = 1").select("lang", "feature", "auc")), by_lang + " SELECT lang, feature, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auc DESC, feature) AS r FROM b) WHERE r = 1"),
        "top3_per_group": (lambda s, d: rounded(langs(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("auc"), "feature"))).where("rank <= 3").select("lang", "feature", "auc", "rank")), by_lang + " SELECT lang, feature, round(auc, 6) AS auc, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auc DESC, feature) AS r FROM b) WHERE r <= 3"),
        "universality": (lambda s, d: langs(s, d).groupBy("lang").agg(F.max_by("feature", "auc").alias("feature")).groupBy("feature").agg(F.count("*").alias("groups")), by_lang + " SELECT feature, count(*) AS groups FROM (SELECT lang, max_by(feature, auc) AS feature FROM b GROUP BY lang) GROUP BY feature"),
        "stratified_sample": (lambda s, d: sampling.stratified(labelled(s, d), "row_id", {0: 20, 1: 20}), f"WITH {lab} SELECT row_id, y FROM x WHERE r <= 20"),
        "holdout_anti_join": (lambda s, d: sampling.holdout(labelled(s, d), "row_id", {0: 20, 1: 20})[1], f"WITH {lab} SELECT row_id, y FROM x WHERE r > 20"),
        "simple_sample": (lambda s, d: sampling.simple(labelled(s, d), "row_id", 50).select("row_id"), f"SELECT doc_id AS row_id FROM labels ORDER BY {md.format(c='doc_id')}, doc_id LIMIT 50"),
        "stratified_folds": (lambda s, d: sampling.folds(labelled(s, d), "row_id"), f"WITH {lab} SELECT row_id, y, CAST((r - 1) % 5 AS INT) AS fold FROM x"),
        "standardize_pop": (lambda s, d: rounded(features.standardized(doc_features(s, d), k).select("row_id", "feature", "z")), f"WITH {DOCS}, st AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY feature) SELECT row_id, x.feature, round(coalesce((value - m) / nullif(s, 0), 0), 6) AS z FROM x JOIN st ON x.feature = st.feature"),
        "nan_policy": (lambda s, d: rounded(features.clean(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")), "zero").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 3), "SELECT count(*) AS n, round(sum(CASE WHEN event_id % 7 = 0 THEN 0e0 ELSE coalesce(value, 0) END), 3) AS total FROM events"),
        "feature_pairs": (lambda s, d: rounded(_pairs(auc_of(s, d))), f"WITH {DOCS}, {_areas('feature')}, b AS (SELECT feature, greatest(auc, 1 - auc) AS auc FROM a) SELECT p.feature AS f1, q.feature AS f2, round(p.auc + q.auc, 6) AS total FROM b p JOIN b q ON p.feature < q.feature"),
        "banded_pairs": (lambda s, d: _banded(curves.auc(layers(s, d), ml)), f"WITH {LAYERS}, {_areas('metric, layer')}, b AS (SELECT metric, layer, row_number() OVER (ORDER BY round(auc, 9) DESC, metric, layer) AS r FROM a) SELECT p.metric AS m1, p.layer AS l1, q.metric AS m2, q.layer AS l2 FROM b p JOIN b q ON q.r > p.r AND q.r <= 15 AND p.r <= 10"),
        "drift_report": (lambda s, d: rounded(doc_features(s, d).groupBy("feature", (F.col("row_id") % 2).cast("int").alias("half")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), curves.pearson().alias("corr")), 5), f"WITH {DOCS} SELECT feature, CAST(row_id % 2 AS INT) AS half, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round({_CORR}, 5) AS corr FROM x GROUP BY 1, 2"),
        "heatmap_pivot": (lambda s, d: rounded(effects.cohens_d(layers(s, d), ml, absolute=True).groupBy("metric").pivot("layer", list(range(1, 8))).agg(F.first("d")).select("metric", *[F.col(str(i)).alias(f"layer{i}") for i in range(1, 8)])), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')} SELECT metric, " + ", ".join(f"round(max(CASE WHEN layer = {i} THEN abs({d_sql}) END), 6) AS layer{i}" for i in range(1, 8)) + " FROM m GROUP BY metric"),
        "chat_merge_roles": (lambda s, d: text.merge_turn_rows(table(s, d, "conversations"), "conv_id", "turn", F.when(F.col("role") == "system", "user").otherwise(F.col("role")), "text").select("conv_id", F.col("run").cast("long").alias("run"), "role", F.col("turns").cast("long").alias("turns"), F.md5("content").alias("digest")), f"WITH a AS (SELECT conv_id, turn, text, {conv} AS role FROM conversations), b AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), c AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM b) SELECT conv_id, CAST(run AS BIGINT) AS run, role, count(*) AS turns, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM c GROUP BY conv_id, run, role"),
        "last_user_turn": (lambda s, d: table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text")), "SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id"),
        "exact_label": (lambda s, d: table(s, d, "conversations").where("role = 'assistant'").alias("a").join(table(s, d, "conversations").alias("b"), F.expr("a.conv_id = b.conv_id and b.turn = a.turn - 1")).select("a.conv_id", "a.turn", text.exact_label("a.text", "b.text").alias("label")), "SELECT a.conv_id, a.turn, CASE WHEN regexp_replace(a.text, '\\s+', '', 'g') = regexp_replace(b.text, '\\s+', '', 'g') THEN 0 ELSE 1 END AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role = 'assistant'"),
        "significance_stars": (lambda s, d: effects.welch(layers(s, d), ml).withColumn("p", F.exp(-F.abs("t"))).select("metric", "layer", effects.stars().alias("stars")), f"WITH {LAYERS}, {_MOM.format(k='metric, layer')}, p AS (SELECT metric, layer, exp(-abs({_T})) AS p FROM m WHERE n1 > 1 AND n0 > 1) SELECT metric, layer, CASE WHEN p < 0.001e0 THEN '***' WHEN p < 0.01e0 THEN '**' WHEN p < 0.05e0 THEN '*' ELSE 'ns' END AS stars FROM p"),
        "json_label": (lambda s, d: dealt(s, d, CALLS).select("p_partkey", labels.json_label()("truth", "generated").alias("loose"), labels.json_label(True)("truth", "generated").alias("strict")), f"SELECT p_partkey, {_expected(CALLS, 2)} AS loose, {_expected(CALLS, 3)} AS strict FROM part"),
        "react_label": (lambda s, d: dealt(s, d, ANSWERS).select("p_partkey", labels.react_label()("truth", "generated").alias("label")), f"SELECT p_partkey, {_expected(ANSWERS, 2)} AS label FROM part"),
        "lr_fit": (lambda s, d: models.coefficients(features.standardized(doc_features(s, d), k).select("row_id", "y", "feature", F.col("z").alias("value")), pool, penalise_intercept=True), None),
        "lr_cv_auc": (lambda s, d: models.search(doc_features(s, d), {2: pool}), None),
        "combo_sweep": (lambda s, d: models.search(doc_features(s, d), {2: pool, 3: pool, 4: pool}), None),
        "greedy_forward": (lambda s, d: models.greedy(doc_features(s, d), pool), None),
        "anchored_search": (lambda s, d: models.anchored(doc_features(s, d), "lines", [f for f in pool if f != "lines"]), None),
        "spectral_graph": (lambda s, d: spectral.by_row(table(s, d, "embeddings"), "embedding", "vec_id"), None),
        "likelihood": (lambda s, d: rounded(spectral.likelihood(table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("nll"))).select("vec_id", "ppl", "logprob_mean", "logprob_min", F.col("len_gen").cast("long").alias("len_gen"))), "WITH t AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(exp(avg(v)), 6) AS ppl, round(-avg(v), 6) AS logprob_mean, round(-max(v), 6) AS logprob_min, count(*) AS len_gen FROM t GROUP BY vec_id"),
    }


def _pairs(found: DataFrame) -> DataFrame:
    """All pairs of features: a theta join of a table with a row for each feature, which is never data-sized."""
    a, b = found.alias("a"), found.alias("b")
    return a.join(F.broadcast(b), F.expr("a.feature < b.feature")).select(F.col("a.feature").alias("f1"), F.col("b.feature").alias("f2"), (F.col("a.auc") + F.col("b.auc")).alias("total"))


def _banded(found: DataFrame, first: int = 10, second: int = 15) -> DataFrame:
    from pyspark.sql.window import Window

    r = found.orderBy(F.desc(F.round("auc", 9)), "metric", "layer").limit(second).withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.round("auc", 9)), "metric", "layer")))
    a, b = r.alias("a"), r.alias("b")
    return a.join(F.broadcast(b), F.expr(f"b.r > a.r and a.r <= {first}")).select(F.col("a.metric").alias("m1"), F.col("a.layer").alias("l1"), F.col("b.metric").alias("m2"), F.col("b.layer").alias("l2"))


def _all() -> dict[str, tuple[Q, str | None]]:
    from quarry.plans import studies

    return _defined() | studies.defined()


def queries() -> dict[str, Q]:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
