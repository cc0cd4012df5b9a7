"""Queries: caption sources, configuration, models, training, registry."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.tables import settle, spread
from ..operators import registry, training
from ..sources import captions, intake, store
from . import derived as d
from .registry import query, rnd
from .streams import new_folder

EX = ["d_example"]

# ---- models derived from the part table ------------------------------------------

_MODEL_SQL = """select p_partkey as n, 'm-' || cast(p_partkey as string) as model_id, '2024.' || cast(p_size as string) as model_version,
  '2024-01-' || lpad(cast(1 + p_partkey % 28 as string), 2, '0') || 'T00:00:00.000Z' as created_at,
  (p_partkey % 64) / 64.0e0 as accuracy, (p_partkey % 100) / 100.0e0 as precision_, (p_partkey % 90) / 90.0e0 as recall,
  (p_partkey % 80) / 80.0e0 as f1, (p_partkey % 50) / 50.0e0 as auc, (p_size + 0.0e0) as examples,
  case when p_partkey % 9 = 0 then 0.9e0 else 0.5e0 end as review, case when p_partkey % 11 = 0 then 0.6e0 else 0.75e0 end as positive,
  case when p_partkey % 13 = 0 then 1 else 2 end as schema_version, p_partkey % 3 = 0 as has_boundary,
  (p_partkey % 40) / 8.0e0 as mae from {part}"""
MODEL_ALL_CTE = f"model_all as ({_MODEL_SQL.format(part='part')})"
VALID_MODEL = "schema_version = 2 and review <= positive and (not has_boundary or mae < 4)"
MODEL_CTE = f"{MODEL_ALL_CTE}, model as (select * from model_all where {VALID_MODEL})"


def model_documents(spark, sf):
    """Artifacts as JSON text, some of them invalid."""
    flat = spark.sql(_MODEL_SQL, part=spread(d.table(spark, sf, "part"), "p_partkey"))
    metric = {
        "accuracy": "accuracy", "precision": "precision_", "recall": "recall", "f1": "f1", "auc": "auc",
        "positivePrecision": "precision_", "positiveRecall": "recall", "reviewRecall": "f1",
    }
    profile = F.struct(
        F.lit(5.0).alias("startOffsetSeconds"), F.lit(30).alias("trainingExamples"), F.lit(8).alias("validationExamples"),
        F.lit(12).alias("videoGroups"), F.lit(4.0).alias("baselineMaeSeconds"), F.col("mae").alias("calibratedMaeSeconds"),
    )
    boundary = F.struct(F.lit(1).alias("version"), profile.alias("global"), F.struct(profile.alias("transcript")).alias("bySource"))
    n = F.col("n")
    body = F.struct(
        F.col("model_id").alias("modelId"), F.col("model_version").alias("modelVersion"),
        F.col("schema_version").alias("featureSchemaVersion"), F.col("created_at").alias("createdAt"),
        F.lit(0.5).alias("intercept"),
        F.struct(((n % 17) / 4.0 - 2).alias("alpha"), ((n % 5) / 2.0).alias("beta"), (-(n % 7) / 8.0).alias("gamma")).alias("weights"),
        F.struct("positive", "review").alias("thresholds"),
        F.struct(
            *[F.col(c).alias(k) for k, c in metric.items()], F.lit(1).alias("thresholdsCalibrated"),
            *[F.col("examples").alias(f"thresholdCalibration{k}") for k in ("Examples", "Positives", "Negatives", "Groups")],
        ).alias("metrics"),
        F.struct("examples").alias("trainingSetSummary"),
        F.when(F.col("has_boundary"), boundary).alias("boundaryCalibration"),
    )
    return flat.select(F.to_json(body).alias("document"))


def model_table(spark, sf):
    return intake.load_models(model_documents(spark, sf))


@query("load_models", f"with {MODEL_CTE} select model_id, model_version, created_at, positive, review, auc, case when has_boundary then mae end as mae from model")
def _(spark, sf):
    m = model_table(spark, sf)
    return m.select(
        "model_id", "model_version", "created_at", "thresholds.positive", "thresholds.review", "metrics.auc",
        F.col("boundary_calibration.by_source")["transcript"]["calibrated_mae_s"].alias("mae"),
    )


@query("upsert_models", f"""with {MODEL_CTE}, n as (select model_id, 'new' as model_version from model where n % 4 = 0 union all select model_id || '-x', 'new' from model where n % 10 = 0)
select model_id, model_version from n union all select model_id, model_version from model where n % 4 <> 0""")
def _(spark, sf):
    m = settle(model_table(spark, sf))
    number = F.regexp_extract("model_id", r"(\d+)$", 1).cast("int")
    new = m.filter(number % 4 == 0).withColumn("model_version", F.lit("new"))
    added = m.filter(number % 10 == 0).withColumn("model_version", F.lit("new")).withColumn("model_id", F.concat("model_id", F.lit("-x")))
    return registry.upsert_models(m, new.unionByName(added)).select("model_id", "model_version")


_UPSERTED = f"""with {MODEL_CTE}, n as (select model_id, 'new' as model_version from model where n % 4 = 0 union all select model_id || '-x', 'new' from model where n % 10 = 0)
select model_id, model_version from n union all select model_id, model_version from model where n % 4 <> 0"""


@query("model_table", _UPSERTED)
def _(spark, sf):
    root, m = new_folder(spark, "store"), settle(model_table(spark, sf))
    number = F.regexp_extract("model_id", r"(\d+)$", 1).cast("int")
    new = m.filter(number % 4 == 0).withColumn("model_version", F.lit("new"))
    added = m.filter(number % 10 == 0).withColumn("model_version", F.lit("new")).withColumn("model_id", F.concat("model_id", F.lit("-x")))
    store.upsert(m, root, "model")
    store.upsert(new.unionByName(added), root, "model")
    return store.listing(spark, root, "model").select("model_id", "model_version")


@query(
    "training_run_table",
    f"""with {MODEL_CTE} select 'run-' || model_id as id, created_at, model_id, cast(examples as bigint) as dataset_size,
  case when n % 5 = 0 then 'running' else 'completed' end as status from model""",
)
def _(spark, sf):
    """Each run is stored when it starts; most are stored again when they end."""
    root, m = new_folder(spark, "store"), settle(model_table(spark, sf))
    run = m.select(
        F.concat(F.lit("run-"), "model_id").alias("id"), "created_at", "model_id",
        F.try_element_at("training_set_summary", F.lit("examples")).cast("bigint").alias("dataset_size"), F.lit("running").alias("status"),
    )
    ended = run.filter(F.regexp_extract("model_id", r"(\d+)$", 1).cast("int") % 5 != 0).withColumn("status", F.lit("completed"))
    store.upsert(run.withColumn("dataset_size", F.lit(0).cast("bigint")), root, "training_run")
    store.upsert(run, root, "training_run")
    store.upsert(ended, root, "training_run")
    return store.listing(spark, root, "training_run")


_PROMOTION_SQL = """select 'r' || cast(user_id as string) as registry, 'e' || lpad(cast(event_id as string), 12, '0') as id,
  'm-' || cast(1 + event_id % 5 as string) as model_id, ts as promoted_at, case when event_id % 3 = 0 then 'rollback' else 'promote' end as action from {events}"""


def promotion_log(spark, sf):
    log = spark.sql(_PROMOTION_SQL, events=d.table(spark, sf, "events"))
    return log.withColumn("promoted_at", F.col("promoted_at").cast("timestamp"))


REPLAY = f"""log as (select *, row_number() over (partition by registry order by promoted_at, id) as k from ({_PROMOTION_SQL.format(events='events')}) l),
state as (
  select registry, cast(0 as bigint) as k, cast([] as varchar[]) as promoted, cast(null as varchar) as active, true as accepted, '' as id from (select distinct registry from log)
  union all
  select s.registry, l.k, case when action = 'promote' then list_append(promoted, model_id) else promoted end,
    case when action = 'promote' then model_id when active = model_id then
      promoted[len(promoted) - list_position(list_reverse(promoted), model_id)] else active end,
    action = 'promote' or coalesce(active = model_id, false), l.id
  from state s join log l on s.registry = l.registry and l.k = s.k + 1
)"""


@query("promotion_event_table", f"select id, registry, model_id, action from ({_PROMOTION_SQL.format(events='events')}) e")
def _(spark, sf):
    root, log = new_folder(spark, "store"), promotion_log(spark, sf)
    late = F.dayofmonth("promoted_at") > 15
    store.upsert(log.filter(~late), root, "promotion_event")
    store.upsert(log.filter(late), root, "promotion_event")
    return store.listing(spark, root, "promotion_event").select("id", "registry", "model_id", "action")


@query("replay_promotions", f"with recursive {REPLAY} select registry, id, accepted, active as active_model_id from state where k > 0")
def _(spark, sf):
    return registry.replay_promotions(promotion_log(spark, sf)).select("registry", "id", "accepted", "active_model_id")


_ACTIVE = f"""with recursive {REPLAY}, {MODEL_CTE},
t as (select registry, active as model_id from state where k > 0 qualify row_number() over (partition by registry order by k desc) = 1)
select registry, model_id, auc from t join model using (model_id)"""


@query("promoted_model", _ACTIVE)
def _(spark, sf):
    out = registry.promoted_model(promotion_log(spark, sf), model_table(spark, sf), None)
    return out.select("registry", "model_id", "metrics.auc")


@query("active_model", _ACTIVE)
def _(spark, sf):
    out = intake.active_model(model_table(spark, sf), promotion_log(spark, sf), None)
    return out.select("registry", "model_id", "metrics.auc")


def _least(column: str, minimum: str, label: str) -> str:
    return (
        f"case when {column} < {minimum} then '{label} must be at least ' || cast(cast({minimum} as decimal(28,3)) as varchar) "
        f"|| '; received ' || cast(cast({rnd(column, 3)} as decimal(28,3)) as varchar) || '.' end"
    )


def _worse(column: str, tolerance: str, label: str) -> str:
    t = lambda c: f"cast(cast({rnd(c, 3)} as decimal(28,3)) as varchar)"
    return (
        f"case when m.{column} + {tolerance} < b.{column} then '{label} regresses more than {float(tolerance[:-2]):.3f} from the promoted model (' "
        f"|| {t('m.' + column)} || ' vs ' || {t('b.' + column)} || ').' end"
    )


_MAE = "case when b.has_boundary and m.has_boundary and m.mae > b.mae + 0.5e0 then '{0} boundary MAE regresses more than 0.500 seconds (' || cast(cast(" + rnd("m.mae", 3) + " as decimal(28,3)) as varchar) || ' vs ' || cast(cast(" + rnd("b.mae", 3) + " as decimal(28,3)) as varchar) || ').' end"
_BLOCKERS = ", ".join(
    [_least("m.examples", x, label) for x, label in (("20e0", "Holdout calibration examples"), ("5e0", "Holdout positive examples"), ("5e0", "Holdout negative examples"), ("5e0", "Holdout video groups"))]
    + [_least("m.precision_", "0.9e0", "Display precision"), _least("m.recall", "0.5e0", "Display recall"), _least("m.f1", "0.9e0", "Review recall"), _least("m.auc", "0.7e0", "AUC")]
    + [_worse("precision_", "0.02e0", "Display precision"), _worse("recall", "0.05e0", "Display recall"), _worse("f1", "0.05e0", "Review recall"), _worse("auc", "0.03e0", "AUC")]
    + ["case when b.has_boundary and not m.has_boundary then 'Candidate removes the promoted model boundary calibration.' end", _MAE.format("Global"), _MAE.format("transcript")]
)


@query(
    "promotion_safety",
    f"""with {MODEL_CTE}, b as (select * from model where model_id = 'm-96'),
s as (select m.model_id, list_filter([{_BLOCKERS}], lambda x: x is not null) as blockers from model m, b)
select model_id, len(blockers) = 0 as safe, array_to_string(blockers, '|') as blockers from s""",
)
def _(spark, sf):
    m = settle(model_table(spark, sf))
    out = registry.promotion_safety(m, m.filter("model_id = 'm-96'"))
    return out.select("model_id", "safe", F.array_join("blockers", "|").alias("blockers"))


@query(
    "evaluation_report",
    f"""with {MODEL_CTE}, b as (select * from model where model_id = 'm-96') select m.model_id, 'validation' as mode, m.examples, m.positive as threshold, m.precision_ as "precision",
  floor((m.auc - b.auc) * 1e6 + 0.5e0) / 1e6 as auc_delta, floor((m.f1 - b.f1) * 1e6 + 0.5e0) / 1e6 as f1_delta, 8 as n_deltas from model m, b""",
)
def _(spark, sf):
    m = settle(model_table(spark, sf))
    return _report_columns(registry.evaluation_report(m, m.filter("model_id = 'm-96'")))


def _report_columns(report):
    c = F.col("threshold_calibration")
    return report.select(
        "model_id", c["mode"].alias("mode"), c["examples"].alias("examples"), c["positive"]["threshold"].alias("threshold"),
        c["positive"]["precision"].alias("precision"), F.col("metric_deltas")["auc"].alias("auc_delta"),
        F.col("metric_deltas")["f1"].alias("f1_delta"), F.size("metric_deltas").alias("n_deltas"),
    )


# The operator searches all fields of a row; the constant ones do not hold the term.
_MODEL_TEXT = """concat_ws(' ', model_id, model_version, created_at, positive, review, accuracy, precision_, recall, f1, auc, examples,
  (n % 17) / 4.0e0 - 2, (n % 5) / 2.0e0, -(n % 7) / 8.0e0, case when has_boundary then mae end)"""


@query("model_list", f"with {MODEL_CTE} select model_id, model_id = 'm-7' as is_promoted from model where contains({_MODEL_TEXT}, '7') order by model_id = 'm-7' desc, f1 desc, created_at desc, model_id")
def _(spark, sf):
    # Read twice: for the bounds of the order, then for the rows.
    return registry.model_list(settle(model_table(spark, sf)), "m-7", "7", sort="f1-desc").select("model_id", "is_promoted")


@query(
    "top_weights",
    f"""with {MODEL_CTE}, w as (select model_id, unnest(['alpha', 'beta', 'gamma']) as feature, unnest([(n % 17) / 4.0e0 - 2, (n % 5) / 2.0e0, -(n % 7) / 8.0e0]) as weight from model)
select model_id, feature, weight from w qualify row_number() over (partition by model_id order by abs(weight) desc, feature) <= 2""",
)
def _(spark, sf):
    return registry.top_weights(model_table(spark, sf), 2).select("model_id", "feature", "weight")


def _read_back(out, schema):
    """The rows that exported lines hold."""
    return out.select(F.from_json("value", schema).alias("m")).select("m.*")


@query(
    "export_model",
    f"""with {MODEL_CTE} select model_id, model_version, cast(schema_version as int) as feature_schema_version, created_at, 0.5e0 as intercept,
  (n % 17) / 4.0e0 - 2 as alpha, (n % 5) / 2.0e0 as beta, -(n % 7) / 8.0e0 as gamma, positive, review, accuracy, precision_, recall, f1, auc, examples,
  case when has_boundary then mae end as mae, case when has_boundary then 5.0e0 end as offset_s from model where model_id = 'm-3'""",
)
def _(spark, sf):
    models = model_table(spark, sf)
    m = _read_back(store.export_model(models, "m-3"), models.schema)
    of = lambda c, k, name=None: F.try_element_at(c, F.lit(k)).alias(name or k)
    boundary = F.col("boundary_calibration.by_source")["transcript"]
    return m.select(
        "model_id", "model_version", F.col("feature_schema_version").cast("int").alias("feature_schema_version"), "created_at", "intercept",
        *[of("weights", k) for k in ("alpha", "beta", "gamma")], "thresholds.positive", "thresholds.review",
        of("metrics", "accuracy"), of("metrics", "precision", "precision_"), *[of("metrics", k) for k in ("recall", "f1", "auc")],
        of("training_set_summary", "examples"), boundary["calibrated_mae_s"].alias("mae"), boundary["start_offset_s"].alias("offset_s"),
    )


@query(
    "export_evaluation",
    f"""with {MODEL_CTE}, b as (select * from model where model_id = 'm-96') select m.model_id, 'validation' as mode, m.examples, m.positive as threshold, m.precision_ as "precision",
  floor((m.auc - b.auc) * 1e6 + 0.5e0) / 1e6 as auc_delta, floor((m.f1 - b.f1) * 1e6 + 0.5e0) / 1e6 as f1_delta, 8 as n_deltas from model m, b where m.model_id = 'm-3'""",
)
def _(spark, sf):
    m = settle(model_table(spark, sf))
    report = registry.evaluation_report(m, m.filter("model_id = 'm-96'"))
    return _report_columns(_read_back(store.export_evaluation(report, "m-3"), report.schema))


# ---- training --------------------------------------------------------------------

SPLIT = """chars as (select k, video_id, string_split(k, '') as cs from (select distinct video_id, 'video:' || video_id as k from d_example) v),
fnv as (
  select k, video_id, cs, cast(0 as bigint) as i, cast(2166136261 as bigint) as h from chars
  union all
  select k, video_id, cs, i + 1, cast(((xor(h, cast(ascii(cs[i + 1]) as bigint))) * cast(16777619 as hugeint)) % 4294967296 as bigint) from fnv where i < len(cs)
), side as (select video_id, h % 5 = 0 as holdout from fnv where i = len(cs))"""


@query("trainable_features", "select unnest(['f_digits', 'f_english', 'f_french', 'f_length', 'f_lines']) as name")
def _(spark, sf):
    return training.trainable_features(d.examples(spark, sf))


@query("group_split", f"with recursive {SPLIT} select e.id, s.holdout from d_example e join side s on e.video_id = s.video_id", EX)
def _(spark, sf):
    return training.group_split(d.examples(spark, sf)).select("id", "holdout")


WEIGHTS = {"f_length": 1.5, "f_english": -0.5, "f_french": 0.25, "f_digits": -2.0, "f_lines": 0.75}
INTERCEPT = -0.25
_LOGIT = f"({INTERCEPT}e0" + "".join(f" + {k} * {v}e0" for k, v in WEIGHTS.items()) + ")"
SCORED = f"scored as (select id, label, 1.0e0 / (1.0e0 + exp(-{_LOGIT})) as score from d_example)"


def scored(spark, sf):
    return training.score_examples(d.examples(spark, sf), INTERCEPT, WEIGHTS)


@query("score_examples", f"with {SCORED} select id, {rnd('score', 9)} as score from scored", EX)
def _(spark, sf):
    from ..functions.numbers import js_round

    return scored(spark, sf).select("id", js_round(F.col("score"), 9).alias("score"))


def _quality(tp: str, fp: str, pos: str, n: str) -> str:
    p = f"(case when {tp} + {fp} = 0 then 0.0e0 else {tp} / cast({tp} + {fp} as double) end)"
    r = f"(case when {pos} = 0 then 0.0e0 else {tp} / cast({pos} as double) end)"
    f1 = f"(case when {p} + {r} = 0 then 0.0e0 else 2 * {p} * {r} / ({p} + {r}) end)"
    return (
        f"{n} as validation_examples, {tp} + {fp} as predicted_positive, {rnd(f'(({n} - {fp} - ({pos} - {tp})) / cast({n} as double))', 6)} as accuracy, "
        f"{rnd(p, 6)} as \"precision\", {rnd(r, 6)} as recall, {rnd(f1, 6)} as f1"
    )


@query(
    "confusion_at",
    f"""with {SCORED}, c as (select count(*) as n, count(*) filter (where label = 1) as pos, count(*) filter (where score >= 0.55 and label = 1) as tp,
  count(*) filter (where score >= 0.55 and label = 0) as fp from scored) select {_quality('tp', 'fp', 'pos', 'n')} from c""",
    EX,
)
def _(spark, sf):
    return training.confusion_at(scored(spark, sf), 0.55)


SWEEP = f"""{SCORED}, marks as (select distinct floor(score * 1e6 + 0.5e0) / 1e6 as threshold from scored),
c as (select threshold, count(*) filter (where score >= threshold and label = 1) as tp, count(*) filter (where score >= threshold and label = 0) as fp,
  (select count(*) from scored) as n, (select count(*) from scored where label = 1) as pos from marks, scored group by threshold),
sweep as (select threshold, {_quality('tp', 'fp', 'pos', 'n')} from c)"""


@query("threshold_sweep", f"with {SWEEP} select * from sweep", EX)
def _(spark, sf):
    return training.threshold_sweep(scored(spark, sf))


def _fbeta(b: float) -> str:
    return f"coalesce((1 + {b * b}e0) * \"precision\" * recall / nullif({b * b}e0 * \"precision\" + recall, 0), 0)"


THRESHOLDS = f"""ok as (select * from sweep where predicted_positive > 0),
p as (select threshold as positive from ok order by "precision" >= 0.9 desc, case when "precision" >= 0.9 then recall else {_fbeta(0.5)} end desc, "precision" desc, recall desc, threshold desc limit 1),
v as (select threshold as review from ok, p where threshold <= positive order by recall >= 0.95 desc, case when recall >= 0.95 then "precision" else {_fbeta(2.0)} end desc, recall desc, "precision" desc, threshold desc limit 1)"""


@query(
    "calibrate_thresholds",
    f"""with {SWEEP}, {THRESHOLDS}
select positive, review, true as calibrated, (select count(*) from scored) as examples, (select count(*) from scored where label = 1) as positives, (select count(*) from scored where label = 0) as negatives from p, v""",
    EX,
)
def _(spark, sf):
    return training.calibrate_thresholds(scored(spark, sf))


@query(
    "auc",
    f"""with {SCORED}, r as (select label, rank() over (order by score) as lo, count(*) over (partition by score) as ties from scored)
select (sum(case when label = 1 then lo + (ties - 1) / 2.0e0 end) - count(*) filter (where label = 1) * (count(*) filter (where label = 1) + 1) / 2.0e0)
  / (count(*) filter (where label = 1) * count(*) filter (where label = 0)) as auc from r""",
    EX,
)
def _(spark, sf):
    return training.auc(scored(spark, sf))


FEATS = d.EXAMPLE_FEATURES


def step_logit(feats: list[str]) -> str:
    return "b" + "".join(f" + w_{f} * {f}" for f in feats)


def trained_cte(feats: list[str]) -> str:
    """One row of state per step: the weights; each step sums over all training rows."""
    return f"""fit as materialized (select e.* from d_example e join side s on e.video_id = s.video_id where not s.holdout),
steps as (
  select 0 as step, 0.0e0 as b, {', '.join(f'0.0e0 as w_{f}' for f in feats)}
  union all
  select step + 1, {rnd(f'(b - {training.LEARNING_RATE}e0 * gb)', 6)}, {', '.join(rnd(f'(w_{f} - {training.LEARNING_RATE}e0 * (g_{f} + {training.L2}e0 * w_{f}))', 6) for f in feats)}
  from (select step, b, {', '.join(f'w_{f}' for f in feats)}, sum(e) / count(*) as gb, {', '.join(f'sum(e * {f}) / count(*) as g_{f}' for f in feats)}
    from (select steps.*, fit.*, 1.0e0 / (1.0e0 + exp(-({step_logit(feats)}))) - label as e from steps, fit where step < {training.ITERATIONS}) x
    group by step, b, {', '.join(f'w_{f}' for f in feats)}) y
), trained as (select * from steps where step = {training.ITERATIONS})"""


def weight_rows(feats: list[str]) -> str:
    return "select 'intercept' as name, b as weight from trained" + "".join(f" union all select '{f}', w_{f} from trained" for f in feats)


TRAINED = trained_cte(FEATS)
_WEIGHT_ROWS = weight_rows(FEATS)


@query("train_logistic", f"with recursive {SPLIT}, {TRAINED} {_WEIGHT_ROWS}", EX)
def _(spark, sf):
    ex = settle(training.group_split(d.examples(spark, sf)))
    intercept, weights = training.train_logistic(ex.filter("not holdout"), FEATS)
    return spark.createDataFrame([("intercept", intercept), *weights.items()], "name string, weight double")


def held_cte(feats: list[str]) -> str:
    return f"""scored as (select e.id, e.label, 1.0e0 / (1.0e0 + exp(-({step_logit(feats)}))) as score
  from d_example e join side s on e.video_id = s.video_id, trained where s.holdout)"""


AT_POSITIVE = f"""at_p as (select {_quality('tp', 'fp', 'pos', 'n')} from (select count(*) as n, count(*) filter (where label = 1) as pos,
  count(*) filter (where score >= positive and label = 1) as tp, count(*) filter (where score >= positive and label = 0) as fp from scored, p) c)"""


def artifact_sql(feats: list[str]) -> str:
    """What training makes of ``d_example``, as names and numbers."""
    return f"""{SPLIT}, {trained_cte(feats)}, {SWEEP.replace(SCORED, held_cte(feats))}, {THRESHOLDS}, {AT_POSITIVE}
{weight_rows(feats)} union all select 'positive', positive from p union all select 'review', review from v
union all select 'accuracy', accuracy from at_p union all select 'precision', "precision" from at_p union all select 'recall', recall from at_p
union all select 'f1', f1 from at_p union all select 'trainExamples', count(*) from fit union all select 'validationExamples', count(*) from scored"""


def artifact_rows(model):
    picked = lambda c, names: F.map_filter(c, lambda k, _: k.isin(*names))
    parts = F.map_concat(
        F.create_map(F.lit("intercept"), "intercept", F.lit("positive"), "thresholds.positive", F.lit("review"), "thresholds.review"),
        "weights", picked("metrics", ["accuracy", "precision", "recall", "f1"]),
        picked("training_set_summary", ["trainExamples", "validationExamples"]),
    )
    return model.select(F.explode(parts).alias("name", "weight"))


@query("model_artifact", f"with recursive {artifact_sql(FEATS)}", EX)
def _(spark, sf):
    return artifact_rows(training.model_artifact(d.examples(spark, sf), datetime(2024, 2, 1, tzinfo=timezone.utc)))


@query(
    "training_run",
    f"""with recursive {SPLIT} select 'run-7' as id, '2024-02-01' as created_at, count(*) as dataset_size, count(*) filter (where s.holdout) as validation_size,
  'completed' as status from d_example e join side s on e.video_id = s.video_id""",
    EX,
)
def _(spark, sf):
    model = training.model_artifact(d.examples(spark, sf), datetime(2024, 2, 1, tzinfo=timezone.utc))
    return training.training_run(model, "run-7", "2024-02-01").drop("model_id", "metrics")


# ---- caption sources ------------------------------------------------------------------


@query(
    "caption_events_to_cues",
    """select video_id, cue_idx, start_s, case when cue_idx % 5 = 0 then 0.0e0 else dur_s end as dur_s, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text
from d_cue where cue_idx % 4 <> 3""",
    ["d_cue"],
)
def _(spark, sf):
    cue = d.cues(spark, sf)
    half = (F.length("text") / 2).cast("int")
    segs = F.array(
        F.struct(F.substring("text", 1, 0).alias("utf8")),
        F.struct(F.substr("text", F.lit(1), half).alias("utf8")),
        F.struct(F.substr("text", half + 1).alias("utf8")),
    )
    event = F.to_json(
        F.struct(
            F.when(F.col("cue_idx") % 4 != 3, (F.col("start_s") * 1000).cast("bigint")).alias("tStartMs"),
            F.when(F.col("cue_idx") % 5 != 0, F.col("dur_s") * 1000).alias("dDurationMs"), segs.alias("segs"),
        )
    )
    payload = cue.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("cue_idx", event.alias("e")))).alias("es"))
    joined = F.array_join(F.transform("es", lambda e: e["e"]), ",")
    return captions.caption_events_to_cues(
        payload.select("video_id", F.concat(F.lit('{"events":['), joined, F.lit("]}")).alias("payload"))
    )


def player_pages(spark, sf):
    """Pages with a player object put in front of their body; every sixth page has none."""
    pages = d.table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    track = lambda lang, kind: F.concat(
        F.lit('{"baseUrl":"https://captions.example/t?v='), n, F.lit(f'&l={lang}","languageCode":"{lang}","name":{{"runs":[{{"text":"{lang}"}},{{"text":" }} x"}}]}}'),
        F.lit(f',"kind":"{kind}"' if kind else ""), F.lit("}"),
    )
    tracks = F.when(F.col("page_id") % 3 == 0, F.concat(track("fr", ""), F.lit(","), track("en", "asr"))).otherwise(
        F.concat(track("en", "asr"), F.lit(',{"languageCode":"xx"},'), track("en-GB", ""), F.lit(","), track("de", ""))
    )
    script = F.concat(
        F.lit("<script>var ytInitialPlayerResponse = {\"title\":\"a \\\"quoted\\\" } brace\",\"captions\":{\"playerCaptionsTracklistRenderer\":{\"captionTracks\":["),
        tracks, F.lit("]}}};var other = {};</script>"),
    )
    return pages.select(
        F.concat(F.lit("p"), n).alias("video_id"),
        F.when(F.col("page_id") % 6 == 5, F.col("html")).otherwise(F.concat(script, F.col("html"))).alias("html"),
    )


_TRACKS = """track as (
  select 'p' || page_id as video_id, 0 as track_idx, 'fr' as lang, cast(null as varchar) as kind from pages where page_id % 6 <> 5 and page_id % 3 = 0
  union all select 'p' || page_id, 1, 'en', 'asr' from pages where page_id % 6 <> 5 and page_id % 3 = 0
  union all select 'p' || page_id, 0, 'en', 'asr' from pages where page_id % 6 <> 5 and page_id % 3 <> 0
  union all select 'p' || page_id, 2, 'en-GB', null from pages where page_id % 6 <> 5 and page_id % 3 <> 0
  union all select 'p' || page_id, 3, 'de', null from pages where page_id % 6 <> 5 and page_id % 3 <> 0)"""


@query(
    "pages_to_caption_tracks",
    f"with {_TRACKS} select video_id, cast(track_idx as int) as track_idx, lang, kind, lang || ' }} x' as name, 'https://captions.example/t?v=' || substr(video_id, 2) || '&l=' || lang as base_url from track",
)
def _(spark, sf):
    return captions.pages_to_caption_tracks(player_pages(spark, sf))


@query(
    "pick_caption_track",
    f"""with {_TRACKS} select video_id, lang, kind from track
qualify row_number() over (partition by video_id order by case when starts_with(lang, 'en') and kind is null then 0 when starts_with(lang, 'en') then 1 else 2 end, track_idx) = 1""",
)
def _(spark, sf):
    return captions.pick_caption_track(captions.pages_to_caption_tracks(player_pages(spark, sf))).select("video_id", "lang", "kind")


@query(
    "prefer_fresh_snapshot",
    """select video_id, cue_idx, case when cast(video_id as int) % 3 = 0 then 'fresh' else 'fallback' end as origin from d_cue
where cast(video_id as int) % 3 = 0 and cue_idx > 0 or cast(video_id as int) % 3 = 2""",
    ["d_cue"],
)
def _(spark, sf):
    cue = d.cues(spark, sf)
    n = F.col("video_id").cast("int") % 3
    fresh = cue.filter((n == 0) & (F.col("cue_idx") > 0)).withColumn("origin", F.lit("fresh"))
    track = cue.filter(n == 1).select("video_id").distinct()
    fallback = cue.filter(n != 0).withColumn("origin", F.lit("fallback"))
    return captions.prefer_fresh_snapshot(fresh, track, fallback).select("video_id", "cue_idx", "origin")


_WATCH = """case page_id % 5 when 0 then 'https://www.youtube.com/watch?list=a&v=id' || cast(page_id as string) || '&t=3'
  when 1 then 'https://youtu.be/id' || cast(page_id as string) || '/extra' when 2 then 'https://m.youtube.com/watch?x=1'
  when 3 then 'https://www.youtube.com/shorts?v=1' else url end"""


@query(
    "pages_to_videos",
    """select page_id, 'id' || cast(page_id as string) as video_id, 'https://captions.example/?v=' || cast(page_id as string) || '&fmt=json3' as request_url from pages where page_id % 5 in (0, 1)""",
)
def _(spark, sf):
    pages = d.table(spark, sf, "pages").withColumn("url", F.expr(_WATCH))
    request = captions.caption_request_url(F.concat(F.lit("https://captions.example/?v="), "page_id", F.when(F.col("page_id") % 2 == 0, F.lit("&fmt=old")).otherwise(F.lit(""))))
    return captions.pages_to_videos(pages).select("page_id", "video_id", request.alias("request_url"))


@query(
    "load_phrase_groups",
    """select 'c' || page_id as config_id, 'own-' || page_id as group_id, p as phrase, cast(i as int) as phrase_ord from
  (select page_id, unnest(['go', 'now']) as p, unnest([0, 1]) as i from pages where page_id % 4 = 0) x
union all select 'c' || page_id, g, cast(null as varchar), cast(n as int) from (select page_id, unnest(['sponsor-start', 'ad-read-presence', 'return-to-content']) as g, unnest([19, 16, 9]) as n from pages where page_id % 4 in (1, 2)) y""",
)
def _(spark, sf):
    n = F.col("page_id").cast("string")
    group = lambda conf: F.concat(
        F.lit('[{"id":" own-'), n, F.lit(f' ","kind":"ad-read-start","confidence":{conf},"reasonLabel":"Own","phrases":[" go","now","go","",5]}}]')
    )
    doc = F.when(F.col("page_id") % 4 == 0, group("0.5")).when(F.col("page_id") % 4 == 1, group("1.5")).when(
        F.col("page_id") % 4 == 2, F.lit("not json")
    ).otherwise(F.lit("[]"))
    configs = d.table(spark, sf, "pages").select(F.concat(F.lit("c"), n).alias("config_id"), doc.alias("document"))
    out = settle(intake.load_phrase_groups(configs))
    own = out.filter("group_id like 'own-%'").select("config_id", "group_id", "phrase", "phrase_ord")
    rest = out.filter("group_id not like 'own-%'").groupBy("config_id", "group_id").agg(F.count(F.lit(1)).cast("int").alias("phrase_ord"))
    return own.unionByName(rest.withColumn("phrase", F.lit(None).cast("string")))

