"""Queries of detector studies: joins, guards, verdicts, named detectors, searches, message parts; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions import text
from quarry.operators import curves, effects, features, joins, models, ranks, sampling, spectral
from quarry.plans import queries as core
from quarry.plans.queries import DOCS, LAYERS, doc_features, layers, rounded, table

POOL = ["chars", "lines", "commas", "blanks"]
CONFIGS = {"short": ["chars", "lines"], "marks": ["commas", "blanks"], "odd": ["chars", "nothing"]}
#: Prompts that meet each rule of the taxonomies, dealt to the rows of part.
PROMPTS = ["send an email now", "convert the currency", "weather of today", "an SQL schedule", "average of an area", "book a flight", "set an alarm", "find some news", "plain words", "a message on finance", "compute it", "a tip for the hotel"]
KEYS = ["metric", "layer"]


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[F.lit(p) for p in PROMPTS]), (F.pmod("p_partkey", F.lit(len(PROMPTS))) + 1).cast("int")).alias("prompt"))


_PROMPTS = f"m AS (SELECT p_partkey, ([{', '.join(repr(p) for p in PROMPTS)}])[p_partkey % {len(PROMPTS)} + 1] AS prompt FROM part)"


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id and its messages in order of turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = doc_features(spark, sf)
    return d.where("row_id % 2 = 0"), d.where("row_id % 2 = 1")


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONFIGS.items()), "config string, features array<string>")


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the scores of some errors missing (NaN)."""
    e = table(spark, sf, "events")
    lost = (F.col("event_type") == "error") & (F.col("event_id") % 100 == 0)
    return e.select(F.col("event_type").alias("feature"), (F.col("user_id") % 2).cast("int").alias("y"), F.when(lost, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


def _directed(keys: str, src: str = "x") -> str:
    return f"{core._areas(keys, src)}, b AS (SELECT {keys}, greatest(auc, 1 - auc) AS auc FROM a WHERE auc IS NOT NULL)"


def defined() -> dict[str, tuple[core.Q, str | None]]:
    k = ["feature"]
    areas, curve = core._areas("feature"), core._curve
    corr = f"r AS (SELECT feature, {core._CORR} AS corr FROM x GROUP BY feature)"
    flipped = "SELECT a.feature, round(CASE WHEN {c} THEN 1 - auc ELSE auc END, 6) AS auc, CASE WHEN {c} THEN 'Negative' ELSE 'Positive' END AS direction, round(corr, 6) AS corr FROM a JOIN r ON a.feature = r.feature"
    by_lang = lambda s, d: curves.directed(doc_features(s, d), ["lang", "feature"]).where("auc is not null")
    d_raw = "(m1 - m0) / nullif(sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / nullif(n1 + n0 - 2, 0)), 0)"
    half = lambda n: DOCS.replace("x AS (SELECT", f"x{n}_all AS (SELECT", 1) + f", x{n} AS (SELECT * FROM x{n}_all WHERE row_id % 2 = {n})"
    gap = lambda s, d: (lambda a, b: curves.auc(a, k).select("feature", F.col("auc").alias("a")).join(curves.auc(b, k).select("feature", F.col("auc").alias("b")), "feature").withColumn("gap", F.col("a") - F.col("b")).withColumn("verdict", effects.gap_verdict()))(*halves(s, d))
    fixed = {"chars": 500.0, "lines": 3.0, "commas": 10.0, "blanks": 100.0}
    fixed_rows = lambda s: s.createDataFrame(list(fixed.items()), "feature string, threshold double")
    fixed_sql = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {v}e0)" for f, v in fixed.items()) + ") AS v(feature, threshold))"
    hits = """h AS (SELECT x.feature, value {op} threshold AS hit, y FROM x JOIN t ON x.feature = t.feature), q AS (SELECT feature, CAST(count(*) FILTER (hit AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (hit AND y = 0) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (NOT hit AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT hit AND y = 0) AS DOUBLE) AS tn FROM h GROUP BY feature)"""
    config_sql = "c(config, feature) AS (VALUES " + ", ".join(f"('{c}', '{f}')" for c, fs in CONFIGS.items() for f in fs) + ")"
    case = core._case
    tallied = lambda s, d, rules, other: prompts(s, d).groupBy(text.domain("prompt", rules, other).alias("domain")).agg(F.count("*").alias("n"))
    tally = lambda rules, other: f"WITH {_PROMPTS} SELECT {case('prompt', rules, other)} AS domain, count(*) AS n FROM m GROUP BY 1"
    best_sql = f"WITH {DOCS}, {_directed('lang, feature')}, w1 AS (SELECT lang, feature FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auc DESC, feature) AS r FROM b) WHERE r = 1)"
    first_of = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("auc"), "feature"))).where("r = 1")
    winners = lambda s, d: (lambda w: w.groupBy("feature").agg(F.count("*").alias("groups")).join(F.broadcast(w.agg(F.count("*").alias("all"))), how="cross"))(first_of(by_lang(s, d)))
    guarded = "n0 AS (SELECT lang, count(*) AS n, sum(y) AS p FROM x WHERE feature = 'chars' GROUP BY lang HAVING count(*) >= 20 AND sum(y) >= 5 AND count(*) > sum(y))"
    turns = "SELECT conv_id, {v} FROM conversations {w} GROUP BY conv_id"
    names = lambda s, d: table(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("-8B (v1.0)")).alias("name"), F.concat(F.lit("L"), F.col("n_nationkey").cast("string"), F.lit("_Entropy")).alias("feature"))

    return {
        "auc_or_half": (lambda s, d: rounded(curves.auc_or_half(event_scores(s, d), k)), f"WITH x AS (SELECT event_type AS feature, CAST(user_id % 2 AS INT) AS y, CASE WHEN event_type = 'error' AND event_id % 100 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value FROM events), {areas}, bad AS (SELECT feature, max(CASE WHEN isnan(value) OR value IS NULL THEN 1 ELSE 0 END) AS bad FROM x GROUP BY feature) SELECT a.feature, CASE WHEN bad = 1 THEN 0.5e0 ELSE round(auc, 6) END AS auc FROM a JOIN bad ON a.feature = bad.feature"),
        "auc_negated": (lambda s, d: rounded(curves.auc(features.negated(doc_features(s, d), ["commas", "blanks"]), k)), f"WITH {DOCS.replace('x AS (SELECT', 'x0 AS (SELECT', 1)}, x AS (SELECT row_id, y, feature, CASE WHEN feature IN ('commas', 'blanks') THEN -value ELSE value END AS value FROM x0), {areas} SELECT feature, round(auc, 6) AS auc, pos, n FROM a"),
        "tool_call_share": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count_if(text.is_tool_call("props")).alias("calls"), F.count("*").alias("n")), "SELECT event_type, count(*) FILTER (contains(props, '{') AND contains(props, '}')) AS calls, count(*) AS n FROM events GROUP BY event_type"),
        "domain_filter": (lambda s, d: prompts(s, d).agg(F.count_if(text.domain_match("prompt", ["email", "news"])).alias("kept_off"), F.count_if(text.domain_match("prompt", ["email", "news"], on=True)).alias("kept_on")), f"WITH {_PROMPTS} SELECT count(*) AS kept_off, count(*) FILTER (contains(lower(prompt), 'email') OR contains(lower(prompt), 'news')) AS kept_on FROM m"),
        "auc_floor": (lambda s, d: rounded(curves.auc(doc_features(s, d), ["lang", "feature"]).where("auc > 0.5")), f"WITH {DOCS}, {core._areas('lang, feature')} SELECT lang, feature, round(auc, 6) AS auc, pos, n FROM a WHERE auc > 0.5e0"),
        "precision_floor": (lambda s, d: rounded(curves.curve(doc_features(s, d), k).where("precision > 0.20").groupBy("feature").agg(F.max("tpr").alias("recall"), F.count("*").alias("points"))), f"WITH {DOCS}, {areas}, {curve('feature')} SELECT feature, round(max(tpr), 6) AS recall, count(*) AS points FROM c WHERE precision > 0.20e0 GROUP BY feature"),
        "first_hit": (lambda s, d: table(s, d, "conversations").where(F.col("text").contains("der")).orderBy("conv_id", "turn").limit(1).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE contains(text, 'der') ORDER BY conv_id, turn LIMIT 1"),
        "label_sample": (lambda s, d: table(s, d, "labels").where("quality = 1").orderBy("doc_id").limit(7).select("doc_id"), "SELECT doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 7"),
        "positional_zip": (lambda s, d: joins.positional_zip(table(s, d, "customer").select("c_custkey"), table(s, d, "customer").select("c_acctbal", F.col("c_custkey").alias("by_balance")), ["c_custkey"], ["c_acctbal", "by_balance"]), "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer), b AS (SELECT c_acctbal, c_custkey AS by_balance, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer) SELECT a.position, c_custkey, c_acctbal, by_balance FROM a JOIN b ON a.position = b.position"),
        "config_features": (lambda s, d: rounded(joins.of_configs(curves.directed(doc_features(s, d), k), configs(s)).groupBy("config").agg(F.avg("auc").alias("mean"), F.max("auc").alias("most"), F.min("auc").alias("least"))), f"WITH {config_sql}, {DOCS}, {_directed('feature')} SELECT config, round(avg(auc), 6) AS mean, round(max(auc), 6) AS most, round(min(auc), 6) AS least FROM b JOIN c ON b.feature = c.feature GROUP BY config"),
        "known_configs": (lambda s, d: joins.with_known_features(configs(s), doc_features(s, d)).select("config"), f"WITH {config_sql}, {DOCS} SELECT config FROM c GROUP BY config HAVING count(*) FILTER (feature NOT IN (SELECT feature FROM x)) = 0"),
        "lookup_left": (lambda s, d: joins.lookup(table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), s.createDataFrame([("en", "English"), ("de", "German")], "lang string, name string"), "lang").select("lang", "name", "n"), "SELECT d.lang, name, count(*) AS n FROM documents d LEFT JOIN (VALUES ('en', 'English'), ('de', 'German')) AS v(lang, name) ON d.lang = v.lang GROUP BY d.lang, name"),
        "class_means": (lambda s, d: rounded(effects.class_means(layers(s, d), KEYS)), f"WITH {LAYERS} SELECT metric, layer, round(coalesce(avg(CASE WHEN y = 0 THEN value END), 0), 6) AS v_mean, round(coalesce(avg(CASE WHEN y = 1 THEN value END), 0), 6) AS i_mean, round(median(CASE WHEN y = 0 THEN value END), 6) AS v_median, round(median(CASE WHEN y = 1 THEN value END), 6) AS i_median FROM x GROUP BY metric, layer"),
        "distinct_counts": (lambda s, d: layers(s, d).groupBy("metric").agg(F.countDistinct("value").alias("values"), F.countDistinct("y").alias("classes")), f"WITH {LAYERS} SELECT metric, count(DISTINCT value) AS values, count(DISTINCT y) AS classes FROM x GROUP BY metric"),
        "universal_feature": (lambda s, d: winners(s, d).orderBy(F.desc("groups"), "feature").limit(1).select("feature", "groups", (F.col("groups") >= 0.5 * F.col("all")).alias("universal")), best_sql + " SELECT feature, count(*) AS groups, count(*) >= 0.5 * (SELECT count(*) FROM w1) AS universal FROM w1 GROUP BY feature ORDER BY groups DESC, feature LIMIT 1"),
        "direction_pearson_loose": (lambda s, d: rounded(curves.directed(doc_features(s, d), k, "pearson").select("feature", "auc", "direction", "corr")), f"WITH {DOCS}, {areas}, {corr} " + flipped.format(c="corr < 0")),
        "direction_inverted": (lambda s, d: rounded(curves.directed(doc_features(s, d), k, "inverted").select("feature", "auc", "direction", "corr")), f"WITH {DOCS}, {areas}, {corr} " + flipped.format(c="corr > 0")),
        "direction_none": (lambda s, d: rounded(curves.directed(doc_features(s, d), k, "none").select("feature", "auc", "direction")), f"WITH {DOCS}, {areas} SELECT feature, round(auc, 6) AS auc, 'Positive' AS direction FROM a"),
        "rates_unguarded": (lambda s, d: rounded(curves.confusion(doc_features(s, d), k, fixed_rows(s).withColumn("threshold", F.lit(1e12)), guarded=False).select("feature", "tp", "fp", "precision", F.col("tpr").alias("recall"))), f"WITH {DOCS}, t AS (SELECT DISTINCT feature, 1e12 AS threshold FROM x), {hits.format(op='>=')} SELECT feature, tp, fp, tp / nullif(tp + fp, 0) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM q"),
        "detected_counts": (lambda s, d: rounded(curves.detected(curves.best(doc_features(s, d), k, "f1")).select("feature", "tp", "detected")), f"WITH {DOCS}, {areas}, {curve('feature')}, z AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY f1 DESC, threshold) AS r FROM c) SELECT feature, round(tpr * pos, 6) AS tp, CAST(round(tpr * pos) AS BIGINT) AS detected FROM z WHERE r = 1"),
        "cohens_d_unguarded": (lambda s, d: rounded(effects.cohens_d(layers(s, d), KEYS, guarded=False)), f"WITH {LAYERS}, {core._MOM.format(k='metric, layer')} SELECT metric, layer, round({d_raw}, 6) AS d FROM m"),
        "verdict_bands": (lambda s, d: curves.directed(layers(s, d), KEYS).withColumn("auc", F.col("auc") + 0.4).select(*KEYS, effects.verdict().alias("verdict")), f"WITH {LAYERS}, {core._areas('metric, layer')}, b AS (SELECT metric, layer, greatest(auc, 1 - auc) + 0.4e0 AS auc FROM a) SELECT metric, layer, CASE WHEN auc >= 0.95e0 THEN 'excellent' WHEN auc >= 0.90e0 THEN 'very good' WHEN auc >= 0.85e0 THEN 'good' ELSE 'lower than expected' END AS verdict FROM b"),
        "generalisation_gap": (lambda s, d: rounded(gap(s, d)), f"WITH {half(0)}, {core._areas('feature', 'x0').replace('g AS', 'g0 AS').replace('FROM g)', 'FROM g0)').replace('w AS', 'w0 AS').replace('FROM w GROUP', 'FROM w0 GROUP').replace('a AS (', 'a0 AS (')}, x1 AS (SELECT * FROM x0_all WHERE row_id % 2 = 1), {core._areas('feature', 'x1')}, j AS (SELECT a0.feature, a0.auc AS a, a.auc AS b, a0.auc - a.auc AS gap FROM a0 JOIN a ON a0.feature = a.feature) SELECT feature, round(a, 6) AS a, round(b, 6) AS b, round(gap, 6) AS gap, CASE WHEN abs(gap) < 0.05e0 THEN 'excellent' WHEN abs(gap) < 0.10e0 THEN 'good' ELSE 'overfit' END AS verdict FROM j"),
        "fixed_threshold": (lambda s, d: rounded(curves.confusion(doc_features(s, d), k, fixed_rows(s), "<").select("feature", "tp", "fp", "fn", "tn", "precision", F.col("tpr").alias("recall"), "balanced")), f"WITH {DOCS}, {fixed_sql}, {hits.format(op='<')} SELECT feature, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round((coalesce(tp / nullif(tp + fn, 0), 0) + 1 - coalesce(fp / nullif(fp + tn, 0), 0)) / 2, 6) AS balanced FROM q"),
        "auc_sorted_default": (lambda s, d: rounded(curves.auc(doc_features(s, d), ["source", "feature"]).withColumn("auc", F.coalesce("auc", F.lit(0.0))).orderBy(F.desc("auc"), "source", "feature").limit(25).select("source", "feature", "auc")), f"WITH {DOCS}, {core._areas('source, feature')} SELECT source, feature, round(coalesce(auc, 0), 6) AS auc FROM a ORDER BY coalesce(auc, 0) DESC, source, feature LIMIT 25"),
        "distinct_sorted": (lambda s, d: table(s, d, "documents").select("lang", "source").distinct().orderBy("lang", "source"), "SELECT DISTINCT lang, source FROM documents ORDER BY lang, source"),
        "feature_sets_equal": (lambda s, d: table(s, d, "nation").select("n_nationkey", joins.same_features(F.array(F.lit("L1"), F.concat(F.lit("L"), (F.col("n_nationkey") % 3).cast("string"))), F.array(F.concat(F.lit("L"), (F.col("n_nationkey") % 2).cast("string")), F.lit("L1"), F.lit("L1"))).alias("same")), "SELECT n_nationkey, list_sort(list_distinct(['L1', 'L' || n_nationkey % 3])) = list_sort(list_distinct(['L' || n_nationkey % 2, 'L1', 'L1'])) AS same FROM nation"),
        "prompt_domains_8way": (lambda s, d: tallied(s, d, text.EIGHT, "other"), tally(text.EIGHT, "other")),
        "prompt_domains_3way": (lambda s, d: tallied(s, d, text.THREE, "other"), tally(text.THREE, "other")),
        "prompt_domains_general": (lambda s, d: tallied(s, d, text.THREE, text.GENERAL), tally(text.THREE, text.GENERAL)),
        "prompt_categories_6way": (lambda s, d: tallied(s, d, text.SIX, "Other"), tally(text.SIX, "Other")),
        "first_turns": (lambda s, d: conversations(s, d).select("conv_id", text.first_turns("messages").alias("f")).select("conv_id", F.md5("f.system").alias("last_system"), F.md5("f.user").alias("first_user"), F.md5("f.assistant").alias("first_assistant")), "WITH u AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS at_user FROM conversations GROUP BY conv_id) SELECT c.conv_id, md5(max_by(text, turn) FILTER (role = 'system')) AS last_system, md5(min_by(text, turn) FILTER (role = 'user')) AS first_user, md5(min_by(text, turn) FILTER (role = 'assistant' AND turn > at_user)) AS first_assistant FROM conversations c JOIN u ON c.conv_id = u.conv_id GROUP BY c.conv_id"),
        "template_prompt": (lambda s, d: conversations(s, d).select("conv_id", F.md5(text.template("messages")).alias("digest")), turns.format(v="md5(string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'ASSISTANT:') AS digest", w="")),
        "zero_shot_prompt": (lambda s, d: conversations(s, d).where(F.exists("messages", lambda m: m["role"] == "user")).select("conv_id", text.zero_shot("messages", F.lit("be brief")).alias("z")).select("conv_id", F.size("z").alias("n"), F.md5(F.element_at("z", -1)["content"]).alias("digest")), turns.format(v="CAST(2 AS INT) AS n, md5(max_by(text, turn)) AS digest", w="WHERE role = 'user'")),
        "name_forms": (lambda s, d: names(s, d).select("n_nationkey", text.short_label("feature").alias("short"), text.full_label(F.array("feature", F.lit("L1_HFER"))).alias("full"), text.safe_filename("name").alias("file"), text.display_name("name").alias("shown"), text.ellipsis(F.concat("name", F.lit(" and some more words to cut"))).alias("cut")), "WITH m AS (SELECT n_nationkey, n_name || '-8B (v1.0)' AS name, 'L' || n_nationkey || '_Entropy' AS feature FROM nation), e AS (SELECT *, name || ' and some more words to cut' AS long FROM m) SELECT n_nationkey, split_part(feature, '_', 1) AS short, feature || ', L1_HFER' AS full, replace(regexp_replace(name, '[^A-Za-z0-9 _-]', '', 'g'), ' ', '_') AS file, replace(name, '-8B', '') AS shown, CASE WHEN length(long) > 40 THEN substring(long, 1, 37) || '...' ELSE long END AS cut FROM e"),
        "layer_alignment": (lambda s, d: rounded((lambda m: spectral.aligned(m.withColumnRenamed("mean", "attention"), m.withColumnRenamed("mean", "hidden"), ["metric"]))(layers(s, d).groupBy(*KEYS).agg(F.avg("value").alias("mean"))).select("metric", "layer", "attention", "hidden"), 5), f"WITH {LAYERS}, m AS (SELECT metric, layer, avg(value) AS mean FROM x GROUP BY metric, layer) SELECT a.metric, a.layer, round(a.mean, 5) AS attention, round(h.mean, 5) AS hidden FROM m a JOIN m h ON a.metric = h.metric AND h.layer = a.layer + 1"),
        "sufficient_groups": (lambda s, d: features.enough(doc_features(s, d), ["source", "feature"], rows=5, positives=1, negatives=1).groupBy("source", "feature").agg(F.count("*").alias("n")), f"WITH {DOCS} SELECT source, feature, count(*) AS n FROM x GROUP BY source, feature HAVING count(*) >= 5 AND sum(y) >= 1 AND sum(1 - y) >= 1"),
        "domain_best_single": (lambda s, d: rounded(models.per_domain(doc_features(s, d), "lang", POOL).where("n_features = 1").select("lang", F.element_at("features", 1).alias("feature"), "auc")), f"WITH {DOCS}, {guarded}, {_directed('lang, feature')} SELECT lang, feature, round(auc, 6) AS auc FROM (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY auc DESC, feature) AS r FROM b JOIN n0 ON b.lang = n0.lang) WHERE r = 1"),
        "numbered_rows": (lambda s, d: ranks.numbered_by(table(s, d, "events").select("event_id", "value"), "value", ["event_id"], "place").select("event_id", "place"), "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS place FROM events"),
        "per_domain_search": (lambda s, d: models.per_domain(doc_features(s, d), "lang", POOL), None),
        "verify_detectors": (lambda s, d: models.verified(doc_features(s, d), {"single": ["chars"], "pair": ["chars", "lines"], "triplet": ["chars", "lines", "commas"], "lost": ["chars", "nothing"]}), None),
        "calibrate_validate_lr": (lambda s, d: models.calibrated(*halves(s, d), ["chars", "commas"]), None),
        "data_efficiency": (lambda s, d: models.efficiency(doc_features(s, d), POOL, {1: ["chars"], 2: ["chars", "commas"]}), None),
        "dual_pattern": (lambda s, d: models.search(features.negated(doc_features(s, d), ["commas", "blanks"]), {2: POOL, 4: POOL}, folds=0, scaled=False, penalise_intercept=False), None),
        "default_prediction": (lambda s, d: (lambda x: curves.confusion(models.scored(x, POOL, models.fit(x, POOL)).withColumn("k", F.lit(0)), ["k"], s.createDataFrame([(0, 0.5)], "k int, threshold double"), ">").drop("k"))(features.standardized(doc_features(s, d), k).withColumn("value", F.col("z")).drop("z")), None),
        "strict_sample": (lambda s, d: sampling.stratified(table(s, d, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("y")), "row_id", {0: 5, 1: 5}, strict=True), "WITH x AS (SELECT doc_id AS row_id, CAST(quality AS INT) AS y, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS r FROM labels) SELECT row_id, y FROM x WHERE r <= 5"),
    }
