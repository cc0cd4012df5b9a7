"""Queries: feedback store, dashboard, intake, status and streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..functions.tables import settle
from ..operators import admission, dashboard, feedback as fb, status, training
from ..sources import intake, schemas as S, store
from ..streaming import jobs
from . import derived as d
from .model import MODEL_CTE, artifact_rows, artifact_sql, model_table
from .registry import clock, query, rnd
from .streams import as_stream, drained, in_order, new_folder

FB = ["d_feedback"]
FR = ["d_feedback", "d_review"]
APP = "reelmark"

# ---- SQL pieces ---------------------------------------------------------------


def _num(x: str) -> str:
    return f"coalesce(regexp_replace(cast(cast({rnd(x, 3)} as decimal(28,3)) as varchar), '\\.?0+$', ''), 'null')"


def _txt(x: str) -> str:
    return f"coalesce(cast(to_json({x}) as varchar), 'null')"


KEYED = f"""keyed as (select *, case when client_id is not null and coalesce(video_id, video_url) is not null then 'feedback-v1-' || sha256(
  '{{"version":1,"clientId":' || {_txt('client_id')} || ',"video":' || {_txt('coalesce(video_id, video_url)')} || ',"occurrenceId":' || {_txt('occurrence_id')}
  || ',"occurrenceType":' || {_txt('occurrence_type')} || ',"source":' || {_txt('source')} || ',"startSeconds":' || {_num('start_s')}
  || ',"endSeconds":' || {_num('end_s')} || ',"feedback":' || {_txt('feedback')} || '}}') end as dedup_key from d_feedback)"""
FIRST = """stored as (select * from keyed where dedup_key is null
  union all select * from (select * from keyed where dedup_key is not null qualify row_number() over (partition by dedup_key order by received_at, id) = 1) s)"""
LAST = "last_review as (select * from d_review qualify row_number() over (partition by feedback_id order by reviewed_at desc, id desc) = 1)"
JOINED = f"""{LAST}, joined as (select f.*, coalesce(f.source, f.occurrence_type) as shown, r.label as review_label, r.reviewed_at, r.corrected_start_s, r.corrected_end_s
  from d_feedback f left join last_review r on f.id = r.feedback_id)"""
TRAIN_LABEL = "case review_label when 'positive' then 1 when 'false_positive' then 0 when 'duplicate' then 0 when 'ignored' then 0 end"
DATASET = f"""{JOINED}, dataset as (select id as feedback_id, occurrence_id, video_id, shown as source, start_s, review_label, {TRAIN_LABEL} as training_label,
  feature_schema_version, case when feat_total is null then 0 else 2 end as feature_count, coalesce(feature_schema_version = 2, false) as compatible,
  case when review_label is null then 'Feedback has not been reviewed yet.' when feat_total is null then 'Feedback payload does not include candidate features.'
    when review_label = 'wrong_timing' then 'wrong_timing is stored for boundary analysis, not confidence training.'
    when review_label = 'needs_more_data' then 'needs_more_data is stored for investigation, not confidence training.'
    when not coalesce(feature_schema_version = 2, false) then 'Feature schema ' || coalesce(cast(feature_schema_version as varchar), 'unknown') || ' is not compatible with active schema 2.' end as exclusion_reason,
  {rnd('(corrected_start_s - start_s)', 3)} as start_offset_s, {rnd('(corrected_end_s - end_s)', 3)} as end_offset_s,
  review_label = 'wrong_timing' and corrected_start_s is not null as boundary_trainable, model_confidence, received_at
  from joined)"""


def data(spark, sf):
    return d.feedback(spark, sf), d.reviews(spark, sf)


def keyed(spark, sf):
    return fb.dedup_key(d.feedback(spark, sf))


# ---- feedback store --------------------------------------------------------------


@query("dedup_key", f"with {KEYED} select id, dedup_key from keyed", FB)
def _(spark, sf):
    return keyed(spark, sf).select("id", "dedup_key")


@query("first_write_wins", f"with {KEYED}, {FIRST} select id, dedup_key, start_s, summary from stored", FB)
def _(spark, sf):
    return fb.first_write_wins(keyed(spark, sf)).select("id", "dedup_key", "start_s", "summary")


@query(
    "retry_counts",
    f"with {KEYED} select dedup_key, min_by(id, (received_at, id)) as stored_id, count(*) - 1 as retries from keyed where dedup_key is not null group by 1",
    FB,
)
def _(spark, sf):
    return fb.retry_counts(keyed(spark, sf))


@query(
    "resolve_retries",
    f"""with {KEYED}, r as (select id, coalesce(first_value(id) over (partition by dedup_key order by received_at, id), id) as first_id, dedup_key from keyed)
select id, case when dedup_key is null then id else first_id end as stored_id, dedup_key is not null and first_id <> id as deduplicated from r""",
    FB,
)
def _(spark, sf):
    return fb.resolve_retries(keyed(spark, sf)).select("id", "stored_id", "deduplicated")


@query(
    "backfill_keys",
    f"""with {KEYED}, taken as (select distinct dedup_key from keyed where dedup_key is not null and start_s < 600),
fresh as (select * from keyed where dedup_key is not null and start_s >= 450)
select id, dedup_key from fresh where dedup_key not in (select dedup_key from taken)
qualify row_number() over (partition by dedup_key order by received_at, id) = 1""",
    FB,
)
def _(spark, sf):
    rows = keyed(spark, sf)
    have = rows.filter("start_s < 600")
    lack = rows.filter("start_s >= 450").withColumn("dedup_key", F.lit(None).cast("string"))
    return fb.backfill_keys(have.unionByName(lack))


@query("latest_review", f"with {LAST} select feedback_id, id, label, corrected_start_s from last_review", ["d_review"])
def _(spark, sf):
    return fb.latest_review(d.reviews(spark, sf)).select(
        "feedback_id", "id", "label", F.col("boundary_correction.start_s").alias("corrected_start_s")
    )


@query(
    "training_examples",
    f"""with {JOINED} select 'example_' || id as id, id as feedback_id, video_id, {TRAIN_LABEL} as label, feature_schema_version, feat_total as total
from joined where feat_total is not null and {TRAIN_LABEL} is not null""",
    FR,
)
def _(spark, sf):
    out = fb.training_examples(*data(spark, sf))
    total = F.try_element_at("features", F.lit("evidenceTotal"))
    return out.select("id", "feedback_id", "video_id", "label", "feature_schema_version", total.alias("total"))


_ALL_EXAMPLES = """select 'x' || id as id, feedback_id, reviewed_at, label = 'positive' as good from d_review"""


@query(
    "purge_stale_examples",
    f"with e as ({_ALL_EXAMPLES}) select feedback_id, id, good from e qualify row_number() over (partition by feedback_id order by reviewed_at desc, id desc) = 1",
    ["d_review"],
)
def _(spark, sf):
    r = d.reviews(spark, sf)
    rows = r.select(
        F.concat(F.lit("x"), "id").alias("id"), "feedback_id", F.col("reviewed_at").alias("created_at"), (F.col("label") == "positive").alias("good")
    )
    return fb.purge_stale_examples(rows).select("feedback_id", "id", "good")


_DATASET_COLUMNS = [
    "feedback_id", "occurrence_id", "video_id", "source", "start_s", "review_label", "training_label", "feature_schema_version",
    "feature_count", "compatible", "exclusion_reason", "start_offset_s", "end_offset_s", "boundary_trainable",
]


@query("dataset_rows", f"with {DATASET} select {', '.join(_DATASET_COLUMNS)} from dataset", FR)
def _(spark, sf):
    return fb.dataset_rows(*data(spark, sf)).select(*_DATASET_COLUMNS)


@query(
    "training_readiness",
    f"""with {JOINED}, e as (select feature_schema_version = 2 as ok, {TRAIN_LABEL} as label from joined where feat_total is not null and {TRAIN_LABEL} is not null)
select 2 as feature_schema_version, count(*) as total_examples, count(*) filter (where ok) as compatible_examples, count(*) - count(*) filter (where ok) as incompatible_examples,
  count(*) filter (where ok and label = 1) as positive_examples, count(*) filter (where ok and label = 0) as negative_examples, true as ready, cast(null as varchar) as blocker from e""",
    FR,
)
def _(spark, sf):
    return fb.training_readiness(fb.training_examples(*data(spark, sf)))


BOUNDARY = f"""{JOINED}, boundary as (select id as feedback_id, video_id,
  case when occurrence_type = 'candidate' and feature_schema_version is not null then 'transcript' else shown end as source,
  start_s as predicted_start_s, end_s as predicted_end_s, corrected_start_s, corrected_end_s from joined
  where review_label = 'wrong_timing' and corrected_start_s is not null)"""


@query("boundary_examples", f"with {BOUNDARY} select * from boundary", FR)
def _(spark, sf):
    return fb.boundary_examples(*data(spark, sf))


CALIBRATED = f"""{BOUNDARY}, keyed_b as (
  select *, case when coalesce(video_id, '') <> '' then 'video:' || video_id else 'feedback:' || feedback_id end as k from boundary
  where predicted_start_s >= 0 and corrected_start_s >= 0 and trim(source) <> ''),
chars as (select k, string_split(k, '') as cs from (select distinct k from keyed_b) x),
fnv as (
  select k, cs, cast(0 as bigint) as i, cast(2166136261 as bigint) as h from chars union all
  select k, cs, i + 1, cast(((xor(h, cast(ascii(cs[i + 1]) as bigint))) * cast(16777619 as hugeint)) % 4294967296 as bigint) from fnv where i < len(cs)),
side as (select k, h % 5 = 0 as holdout from fnv where i = len(cs)),
delta as (select unnest([source, '*']) as source, b.k, holdout, corrected_start_s - predicted_start_s as sd, corrected_end_s - predicted_end_s as ed
  from keyed_b b join side s on b.k = s.k),
off as (
  select source, least(30.0e0, greatest(-30.0e0, median(sd) filter (where not holdout))) as so,
    case when count(ed) filter (where not holdout) >= 5 then least(30.0e0, greatest(-30.0e0, median(ed) filter (where not holdout))) end as eo,
    count(*) filter (where not holdout) as tr, count(distinct k) filter (where not holdout) as tg, count(*) filter (where holdout) as va,
    count(distinct k) filter (where holdout) as vg, count(distinct k) as g from delta group by source),
mae as (
  select d.source, sum(abs(sd) + coalesce(abs(ed), 0)) / sum(1.0e0 + (ed is not null)::int) as base,
    sum(abs(so - sd) + coalesce(abs(coalesce(eo, so) - ed), 0)) / sum(1.0e0 + (ed is not null)::int) as cal
  from delta d join off on d.source = off.source where holdout group by d.source)
select off.source, {rnd('so', 6)} as start_offset_s, {rnd('eo', 6)} as end_offset_s, tr as training_examples, va as validation_examples, g as video_groups,
  {rnd('base', 6)} as baseline_mae_s, {rnd('cal', 6)} as calibrated_mae_s
from off join mae on off.source = mae.source where tr >= 5 and tg >= 3 and va >= 2 and vg >= 2 and cal <= base - 0.25"""


@query("calibrate_boundaries", f"with recursive {CALIBRATED}", FR)
def _(spark, sf):
    return training.calibrate_boundaries(fb.boundary_examples(*data(spark, sf)))


# ---- dashboard -------------------------------------------------------------------


@query(
    "summary",
    f"""with {KEYED}, {MODEL_CTE}, {JOINED}, r as (select cast(sum(n) as bigint) as n from (select count(*) - 1 as n from keyed where dedup_key is not null group by dedup_key) k)
select count(*) as total_feedback, count(distinct client_id) as unique_clients, count(review_label) as reviewed_feedback, count(*) - count(review_label) as pending_feedback,
  (select count(*) from model) as model_versions, (select n from r) as deduplicated_feedback,
  cast(floor(count(review_label) * 100 / cast(count(*) as double) + 0.5e0) as bigint) as reviewed_percent from joined""",
    FR,
)
def _(spark, sf):
    feedback, review = data(spark, sf)
    return dashboard.summary(feedback, review, model_table(spark, sf), fb.retry_counts(fb.dedup_key(feedback)))


@query("source_distribution", f"with {JOINED} select shown as source, count(*) as n from joined group by 1", FR)
def _(spark, sf):
    return dashboard.source_distribution(d.feedback(spark, sf))


@query(
    "detector_quality",
    f"""with {JOINED}, q as (select shown as source, count(*) as total, count(review_label) as reviewed,
  {', '.join(f"count(*) filter (where review_label = '{x}') as {x}" for x in S.REVIEW_LABELS)} from joined group by 1)
select *, total - reviewed as pending, positive as trainable_positive, false_positive + duplicate + ignored as trainable_negative,
  floor(positive / cast(reviewed as double) * 1000 + 0.5e0) / 1000 as positive_rate from q""",
    FR,
)
def _(spark, sf):
    return dashboard.detector_quality(*data(spark, sf))


@query("label_distribution", f"with {JOINED} select review_label, count(*) as n from joined where review_label is not null group by 1", FR)
def _(spark, sf):
    return dashboard.label_distribution(*data(spark, sf))


@query(
    "review_throughput",
    f"with {JOINED} select strftime(reviewed_at, '%Y-%m-%d') as day, count(*) as reviewed from joined where reviewed_at is not null group by 1",
    FR,
)
def _(spark, sf):
    return dashboard.review_throughput(*data(spark, sf))


@query("unique_counts", "select count(distinct coalesce(video_id, video_url, id)) as unique_videos, count(distinct client_id) as unique_clients from d_feedback", FB)
def _(spark, sf):
    return dashboard.unique_counts(d.feedback(spark, sf))


ROLLUP = f"""{JOINED}, rollup_ as (select coalesce(video_id, 'unknown') as video_id, max_by(coalesce(video_url, ''), (received_at, id)) as video_url, count(*) as n_feedback,
  count(distinct client_id) as n_clients, count(*) - count(review_label) as n_pending, count(review_label) as n_reviewed,
  string_agg(distinct shown, ',' order by shown) as sources, max(received_at) as latest from joined group by 1)"""
_ROLLUP_COLUMNS = "video_id, nullif(video_url, '') as video_url, n_feedback, n_clients, n_pending, n_reviewed, sources, epoch_us(latest) as latest_us"


def _flat(rollup):
    return rollup.select(
        "video_id", "video_url", "n_feedback", "n_clients", "n_pending", "n_reviewed",
        F.array_join("sources", ",").alias("sources"), F.unix_micros("latest_received_at").alias("latest_us"),
    )


@query("video_rollup", f"with {ROLLUP} select {_ROLLUP_COLUMNS} from rollup_", FR)
def _(spark, sf):
    return _flat(dashboard.video_rollup(*data(spark, sf)))


@query(
    "video_search",
    f"""with {ROLLUP} select {_ROLLUP_COLUMNS} from rollup_ where contains(sources, 'frame-qr-code')
  and (contains(video_id, '1') or contains(coalesce(video_url, ''), '1') or video_id in (select coalesce(video_id, 'unknown') from joined where contains(client_id, '1')))""",
    FR,
)
def _(spark, sf):
    return _flat(dashboard.video_search(*data(spark, sf), query="1", source="frame-qr-code", sort="pending-desc"))


@query(
    "review_queue",
    """select f.id, start_s, regexp_replace(video_url, '$', '&t=' || cast(cast(floor(start_s + 0.5) as bigint) as varchar) || 's') as watch_url
from d_feedback f where coalesce(source, occurrence_type) = 'transcript' and f.id not in (select feedback_id from d_review)""",
    FR,
)
def _(spark, sf):
    return dashboard.review_queue(*data(spark, sf), source="transcript").select("id", "start_s", "watch_url")


@query("recent_reviews", f"with {JOINED} select id, review_label from joined where review_label is not null order by received_at desc, id limit 5", FR)
def _(spark, sf):
    return dashboard.recent_reviews(*data(spark, sf)).select("id", "review_label")


@query(
    "feedback_search",
    f"""with {JOINED} select id, summary, review_label from joined where review_label is not null and shown = 'frame-visible-link'
  and (contains(summary, 'click 4') or contains(occurrence_id, 'click 4'))""",
    FR,
)
def _(spark, sf):
    out = dashboard.feedback_search(
        *data(spark, sf), query="Click 4", source="frame-visible-link", status="reviewed", sort="model-desc"
    )
    return out.select("id", "summary", "review_label")


@query(
    "dataset_search",
    f"""with {DATASET} select d.feedback_id, d.exclusion_reason from dataset d join d_feedback f on d.feedback_id = f.id
where contains(f.summary, 'purchase 1') and not (d.exclusion_reason is null or d.boundary_trainable)""",
    FR,
)
def _(spark, sf):
    feedback, review = data(spark, sf)
    rows = fb.dataset_rows(feedback, review)
    out = dashboard.dataset_search(rows, feedback, query="PURCHASE 1", status="blocked", sort="confidence-desc")
    return out.select("feedback_id", "exclusion_reason")


def runs(m):
    """One training run per model."""
    return m.select(
        F.concat(F.lit("run-"), "model_id").alias("id"), "created_at", "model_id", F.lit(10).cast("bigint").alias("dataset_size"),
        F.lit(2).cast("bigint").alias("validation_size"), "metrics", F.lit("completed").alias("status"),
    )


def _label(x: str) -> str:
    return f"""case {x} when 'transcript' then 'Transcript' when 'frame-visible-link' then 'Visible links' when 'frame-qr-code' then 'QR codes'
  when 'frame-progress-bar' then 'Progress bars' else replace({x}, '-', ' ') end"""


def _fixed3(x: str) -> str:
    return f"cast(cast({rnd(x, 3)} as decimal(28,3)) as varchar)"


_FOUND = f"""{ROLLUP}, {MODEL_CTE}, f as (select 0 as kind_ord, row_number() over (order by received_at desc, id) as position, 'feedback:' || id as id, occurrence_id as title,
    coalesce(video_id, 'unknown video') || coalesce(' · ' || client_id, '') as meta, {_label('shown')} || ' · ' || {clock('start_s')} || ' · ' || summary as detail
  from joined where contains(coalesce(client_id, ''), '-7') or contains(occurrence_id, '-7')),
v as (select 1 as kind_ord, row_number() over (order by latest desc, video_id) as position, 'video:' || video_id as id, video_id as title,
    n_feedback || ' feedback · ' || n_clients || ' clients · ' || n_pending || ' pending' as meta,
    array_to_string(list_transform(string_split(sources, ','), lambda s: {_label('s')}), ', ') as detail
  from rollup_ where video_id in (select coalesce(video_id, 'unknown') from joined where contains(client_id, '-7'))),
m as (select 2 as kind_ord, row_number() over (order by created_at desc, model_id) as position, 'model:' || model_id as id, model_id as title, model_version as meta,
    'F1 ' || {_fixed3('f1')} || ' · accuracy ' || {_fixed3('accuracy')} as detail from model where contains(model_id, '-7')),
r as (select 3 as kind_ord, row_number() over (order by created_at desc, model_id) as position, 'training:run-' || model_id as id, model_id as title, 'completed' as meta,
    '10 examples · 2 validation' as detail from model where contains('run-' || model_id, '-7')),
found as (select * from f where position <= 5 union all select * from v where position <= 4 union all select * from m where position <= 4 union all select * from r where position <= 3)"""
_FOUND_COLUMNS = ["kind_ord", "position", "id", "title", "meta", "detail"]


# All four kinds together have more hits than the list takes.
@query("global_search", f"with {_FOUND} select {', '.join(_FOUND_COLUMNS)} from found order by kind_ord, position limit 12", FR)
def _(spark, sf):
    m = settle(model_table(spark, sf))
    out = dashboard.global_search(*data(spark, sf), m, runs(m), "-7")
    return out.select(*_FOUND_COLUMNS)


@query(
    "global_search_models",
    f"""with {MODEL_CTE}, m as (select 2 as kind_ord, 'model:' || model_id as id, model_version as meta from model where contains(model_id, 'm-7') order by created_at desc, model_id limit 4),
r as (select 3 as kind_ord, 'training:run-' || model_id as id, 'completed' as meta from model where contains('run-' || model_id, 'm-7') order by created_at desc, model_id limit 3)
select * from m union all select * from r""",
)
def _(spark, sf):
    feedback, review = data(spark, sf)
    m = settle(model_table(spark, sf))
    # No feedback and no video has the term, so the list is that of the two other kinds.
    return dashboard.global_search(feedback, review, m, runs(m), "m-7").select("kind_ord", "id", "meta")


@query(
    "run_comparison",
    f"""with {MODEL_CTE}, best as (select * from model where model_id = 'm-7'),
r as (select 'run-' || model_id as id, unnest(['accuracy', 'precision', 'recall', 'f1', 'auc']) as metric, unnest([accuracy, precision_, recall, f1, auc]) as run_value from model),
b as (select unnest(['accuracy', 'precision', 'recall', 'f1', 'auc']) as metric, unnest([accuracy, precision_, recall, f1, auc]) as promoted_value from best)
select r.id, r.metric, run_value, promoted_value from r left join b on r.metric = b.metric""",
)
def _(spark, sf):
    m = settle(model_table(spark, sf))
    return dashboard.run_comparison(runs(m), m.filter("model_id = 'm-7'"))


@query(
    "source_list",
    """select distinct coalesce(source, occurrence_type) as source, case coalesce(source, occurrence_type) when 'transcript' then 'Transcript' when 'frame-visible-link' then 'Visible links'
  when 'frame-qr-code' then 'QR codes' when 'frame-progress-bar' then 'Progress bars' else replace(coalesce(source, occurrence_type), '-', ' ') end as label from d_feedback""",
    FB,
)
def _(spark, sf):
    return dashboard.source_list(d.feedback(spark, sf))


# ---- intake ---------------------------------------------------------------------------


def payloads(spark, sf):
    """Feedback as JSON bodies; every seventh body breaks one rule."""
    f = d.feedback(spark, sf)
    bad = F.when(F.col("id").endswith("7"), F.substring("id", -2, 1).try_cast("int")).otherwise(-1)
    body = F.struct(
        F.when(bad == 0, F.lit("other")).otherwise(F.lit(APP)).alias("app"),
        F.when(bad == 1, 3).otherwise(2).alias("version"),
        F.when(bad == 2, F.lit("yesterday")).otherwise(F.col("created_at")).alias("createdAt"),
        F.when(bad == 3, F.lit("not ok!")).otherwise(F.col("client_id")).alias("clientId"),
        F.col("occurrence_id").alias("occurrenceId"),
        F.when(bad == 4, F.lit("missed-segment")).otherwise(F.col("occurrence_type")).alias("occurrenceType"),
        F.col("source"),
        F.col("start_s").alias("startSeconds"),
        F.when(bad == 5, F.col("start_s")).otherwise(F.col("end_s")).alias("endSeconds"),
        F.when(bad == 6, F.lit("")).otherwise(F.col("summary")).alias("summary"),
        F.when(bad == 7, F.lit("great")).otherwise(F.col("feedback")).alias("feedback"),
        F.when(bad == 8, F.lit(1.5)).otherwise(F.col("heuristic_confidence")).alias("heuristicConfidence"),
        F.col("model_confidence").alias("modelConfidence"),
        F.col("feature_schema_version").alias("featureSchemaVersion"),
        F.col("candidate_features").alias("candidateFeatures"),
    )
    json = F.to_json(body)
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))
    open_body = F.concat(F.lit('{"videoUrl":'), quoted("video_url"), F.lit(',"videoId":'), quoted("video_id"), F.lit(","))
    return f.select("id", "received_at", F.concat(open_body, F.substr(json, F.lit(2))).alias("body"))


_BAD = "case when right(id, 1) = '7' then try_cast(substr(id, length(id) - 1, 1) as int) end"


@query(
    "ingest_feedback",
    f"""with b as (select *, {_BAD} as bad from d_feedback)
select id, bad is null or bad = 9 as accepted, case when bad is null or bad = 9 then start_s end as start_s, case bad when 0 then 'app' when 1 then 'version' when 2 then 'createdAt' when 3 then 'clientId'
  when 4 then case when end_s is null then 'missedRange,missedLabel' else 'missedLabel' end when 5 then 'endSeconds' when 6 then 'summary' when 7 then 'feedback' when 8 then 'heuristicConfidence' end as errors from b""",
    FB,
)
def _(spark, sf):
    checked = intake.check_feedback(payloads(spark, sf), APP)
    ok = F.size("errors") == 0
    return checked.select("id", ok.alias("accepted"), "row.start_s", F.when(~ok, F.array_join("errors", ",")).alias("errors"))


@query(
    "validate_reviews",
    """with b as (select *, case when right(id, 1) = '4' then 1 when right(id, 1) = '8' then 2 when right(id, 1) = '2' then 3 else 0 end as bad from d_review)
select id, case when bad = 1 then 'label' when bad = 2 then case when label = 'wrong_timing' then 'correctionNeeded' end
  when bad = 3 then case when label <> 'wrong_timing' then 'correctionForbidden' end end as errors from b""",
    ["d_review"],
)
def _(spark, sf):
    r = d.reviews(spark, sf)
    last = F.substring("id", -1, 1)
    fix = F.when(last == "8", None).when(
        F.col("boundary_correction").isNotNull() | (last == "2"),
        F.struct(
            F.coalesce(F.col("boundary_correction.start_s"), F.lit(1.0)).alias("startSeconds"),
            F.col("boundary_correction.end_s").alias("endSeconds"),
        ),
    )
    body = F.to_json(F.struct(F.when(last == "4", F.lit("odd")).otherwise(F.col("label")).alias("label"), fix.alias("boundaryCorrection")))
    checked = intake.check_reviews(r.select("id", "feedback_id", "reviewed_at", body.alias("body")))
    return checked.select("id", F.get("errors", F.lit(0)).alias("errors"))


# ---- tables and exports -------------------------------------------------------------------


@query("feedback_table", "select id, summary from d_feedback", FB)
def _(spark, sf):
    root = new_folder(spark, "store")
    store.append(d.feedback(spark, sf), root, "feedback")
    return store.listing(spark, root, "feedback").select("id", "summary")


_NUMBER = r"cast(regexp_extract(id, '(\d+)', 1) as bigint)"


@query(
    "training_example_table",
    f"""with {JOINED} select 'example_' || id as id, id as feedback_id, video_id, case when {_NUMBER} % 3 = 0 then {TRAIN_LABEL} else -1 end as label
from joined where feat_total is not null and {TRAIN_LABEL} is not null and {_NUMBER} % 7 <> 0""",
    FR,
)
def _(spark, sf):
    """Examples come with an unknown label, every third is labelled later, every seventh is purged."""
    root, number = new_folder(spark, "store"), F.regexp_extract("feedback_id", r"(\d+)", 1).cast("bigint")
    rows = settle(fb.training_examples(*data(spark, sf)))
    store.upsert(rows.withColumn("label", F.lit(-1)), root, "training_example")
    store.upsert(rows.filter(number % 3 == 0), root, "training_example")
    store.delete(rows.filter(number % 7 == 0), root, "training_example")
    return store.listing(spark, root, "training_example").select("id", "feedback_id", "video_id", "label")


@query("export_dataset", f"with {DATASET} select {', '.join(_DATASET_COLUMNS)} from dataset", FR)
def _(spark, sf):
    """Exported lines, read back; the first line is the header."""
    feedback, review = data(spark, sf)
    ready = fb.training_readiness(fb.training_examples(feedback, review))
    rows = fb.dataset_rows(feedback, review)
    out = store.export_dataset(rows, ready, "2024-02-01T00:00:00.000Z")
    lines = out.filter(F.get_json_object("value", "$.generatedAt").isNull())
    return lines.select(F.from_json("value", rows.schema).alias("m")).select(*[f"m.{c}" for c in _DATASET_COLUMNS])


# ---- feedback and reviews to a model ------------------------------------------------------

# The examples of reviewed feedback take the place of the derived ones; rows without a video are groups of their own.
_TRAINED_ON = f"""{JOINED}, d_example as materialized (select id, case when coalesce(video_id, '') <> '' then 'video:' || video_id else 'feedback:' || id end as video_id,
  {TRAIN_LABEL} as label, feat_confidence as heuristicConfidence, feat_total as evidenceTotal
from joined where feat_total is not null and {TRAIN_LABEL} is not null and feature_schema_version = 2)"""
_PIPELINE = artifact_sql(["evidenceTotal", "heuristicConfidence"]).replace("'video:' || video_id as k", "video_id as k")


@query(
    "train_pipeline",
    f"""with recursive {_TRAINED_ON}, {_PIPELINE} union all select 'dataset_size', count(*) from d_example
union all select 'validation_size', count(*) from d_example e join side s on e.video_id = s.video_id where s.holdout""",
    FR,
)
def _(spark, sf):
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    model, run = training.train_pipeline(d.feedback(spark, sf), d.reviews(spark, sf), now, "run-1")
    sizes = F.explode(F.create_map(*[x for c in ("dataset_size", "validation_size") for x in (F.lit(c), F.col(c).cast("double"))]))
    return artifact_rows(model).union(run.filter("status = 'completed'").select(sizes.alias("name", "weight")))


# ---- status, admission, streams --------------------------------------------------------------


@query(
    "latest_status",
    """with n as (select *, row_number() over (partition by video_id order by updated_at desc) as r from d_status)
select video_id, phase, case when phase is null then 0.0e0 else least(1.0e0, greatest(0.0e0, progress)) end as progress, cast(greatest(0, sample_count) as bigint) as sample_count,
  phase in ('starting', 'transcript', 'frames', 'fusion') and updated_at < timestamp '2024-01-30 20:00:00' as stale from n where r = 1""",
    ["d_status"],
)
def _(spark, sf):
    now = F.lit("2024-01-30 20:00:15").cast("timestamp")
    return status.latest_status(d.view(spark, sf, "d_status"), now).drop("updated_at")


ACTIVITY = """select 'v' || cast(user_id as string) as video_id, event_id as ev_idx, cast(row_number() over w as int) as position from events
window w as (partition by user_id order by ts desc, event_id) qualify row_number() over w <= 16"""


def _seen_evidence(spark, sf):
    seen = d.table(spark, sf, "events").select(F.col("event_id").alias("ev_idx"), F.col("ts").cast("timestamp").alias("seen_at"))
    return d.evidence(spark, sf).select("video_id", "ev_idx", "source", "kind", "start_s").join(seen, "ev_idx")


@query("recent_activity", ACTIVITY)
def _(spark, sf):
    return status.recent_activity(_seen_evidence(spark, sf)).select("video_id", "ev_idx", "position")


ADMIT = """q as (select *, epoch_us(asked_at) as t from d_request), jump as (
  select client_key, t, request_id, min(t) over (partition by client_key order by t range between 21600000000 following and unbounded following) as nxt from q
), opening as (
  select client_key, min(t) as a from q group by 1
  union all
  select o.client_key, j.nxt from opening o join jump j on o.client_key = j.client_key and o.a = j.t where j.nxt is not null
), placed as (select q.*, o.a from q asof join opening o on q.client_key = o.client_key and q.t >= o.a),
ranked as (select *, row_number() over (partition by client_key, a order by t, request_id) as k from placed)"""


@query(
    "request_admission",
    f"with recursive {ADMIT} select client_key, request_id, k <= 6 as admitted, cast(case when k <= 6 then 6 - k else 0 end as int) as remaining from ranked",
    ["d_request"],
)
def _(spark, sf):
    out = admission.request_admission(d.view(spark, sf, "d_request"), 6, 21600.0)
    return out.select("client_key", "request_id", "admitted", "remaining")


@query("stream_dedup", f"with {KEYED}, {FIRST} select dedup_key, count(*) as n from stored group by 1", FB)
def _(spark, sf):
    stored = drained(spark, jobs.stream_dedup(as_stream(spark, d.feedback(spark, sf), 3)))
    return stored.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_latest_status",
    """with n as (select *, row_number() over (partition by video_id order by updated_at desc) as r, max(updated_at) over () as newest from d_status)
select video_id, phase, case when phase is null then 0.0e0 else least(1.0e0, greatest(0.0e0, progress)) end as progress, cast(greatest(0, sample_count) as bigint) as sample_count,
  phase in ('starting', 'transcript', 'frames', 'fusion') and updated_at < newest - interval 70 minute as stale
from n where r = 1""",
    ["d_status"],
)
def _(spark, sf):
    stream = in_order(spark, d.view(spark, sf, "d_status"), "updated_at")
    sent = drained(spark, jobs.latest_status(stream, 3600.0, "10 minutes"), "update")
    # A scan that falls silent is sent once more, as stale, after its last status.
    last = sent.groupBy("video_id").agg(
        F.max_by(F.struct("phase", "progress", "sample_count", "stale"), F.struct("batch", "stale")).alias("s")
    )
    return last.select("video_id", "s.*")


@query("stream_recent_activity", ACTIVITY)
def _(spark, sf):
    sent = drained(spark, jobs.recent_activity(as_stream(spark, _seen_evidence(spark, sf), 3)), "update")
    last = sent.groupBy("video_id").agg(F.max("batch").alias("batch"))
    return sent.join(last, ["video_id", "batch"]).select("video_id", "ev_idx", "position")


@query(
    "stream_admission",
    f"with recursive {ADMIT} select client_key, request_id, k <= 6 as admitted, cast(case when k <= 6 then 6 - k else 0 end as int) as remaining from ranked",
    ["d_request"],
)
def _(spark, sf):
    out = drained(spark, jobs.request_admission(in_order(spark, d.view(spark, sf, "d_request"), "asked_at"), 6, 21600.0))
    return out.select("client_key", "request_id", "admitted", "remaining")

