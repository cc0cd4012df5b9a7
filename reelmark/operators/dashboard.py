"""Reports and searches over feedback, reviews, models and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import clock_text, fixed_text, half_up, ratio
from ..functions.once import only
from ..sources.schemas import REVIEW_LABELS
from .feedback import source_of, with_review

# Fixed values (must match for right results).
SOURCE_LABELS = {
    "transcript": "Transcript",
    "frame-visible-link": "Visible links",
    "frame-qr-code": "QR codes",
    "frame-progress-bar": "Progress bars",
    "user-missed-segment": "Missed segments",
}
RUN_METRICS = ["accuracy", "precision", "recall", "f1", "auc"]
SEARCH_LIMITS = {"feedback": 5, "video": 4, "model": 4, "training": 3, "all": 12}
RECENT_REVIEWS = 5


def _source() -> Column:
    return source_of(F.col("source"), F.col("occurrence_type"))


def source_label(source: Column) -> Column:
    out = F.regexp_replace(source, "-", " ")
    for key, label in SOURCE_LABELS.items():
        out = F.when(source == key, F.lit(label)).otherwise(out)
    return out


def summary(feedback: DataFrame, review: DataFrame, models: DataFrame, retries: DataFrame) -> DataFrame:
    """One row of totals. ``retries``: output of ``retry_counts``."""
    joined = with_review(feedback, review)
    f = joined.agg(
        F.count(F.lit(1)).alias("total_feedback"),
        F.count_distinct(F.nullif("client_id", F.lit(""))).alias("unique_clients"),
        F.count("review_label").alias("reviewed_feedback"),
    )
    m = models.agg(F.count(F.lit(1)).alias("model_versions"))
    r = retries.agg(F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("deduplicated_feedback"))
    key = F.lit(1)
    one = f.withColumn("_k", key).join(m.withColumn("_k", key), "_k").join(r.withColumn("_k", key), "_k").drop("_k")
    share = ratio(F.col("reviewed_feedback") * 100, F.col("total_feedback"), 0.0)
    return one.withColumn("pending_feedback", F.col("total_feedback") - F.col("reviewed_feedback")).withColumn(
        "reviewed_percent", half_up(share).cast("bigint")
    )


def source_distribution(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(_source().alias("source")).agg(F.count(F.lit(1)).alias("n"))


def detector_quality(feedback: DataFrame, review: DataFrame) -> DataFrame:
    label = F.col("review_label")
    counts = [F.count(F.when(label == name, 1)).alias(name) for name in REVIEW_LABELS]
    out = (
        with_review(feedback, review)
        .groupBy(_source().alias("source"))
        .agg(F.count(F.lit(1)).alias("total"), F.count(label).alias("reviewed"), *counts)
    )
    rate = ratio(F.col("positive"), F.col("reviewed"), 0.0)
    return (
        out.withColumn("pending", F.col("total") - F.col("reviewed"))
        .withColumn("trainable_positive", F.col("positive"))
        .withColumn("trainable_negative", F.col("false_positive") + F.col("duplicate") + F.col("ignored"))
        .withColumn("positive_rate", half_up(rate * 1000) / 1000)
    )


def label_distribution(feedback: DataFrame, review: DataFrame) -> DataFrame:
    reviewed = with_review(feedback, review).filter("review_label is not null")
    return reviewed.groupBy("review_label").agg(F.count(F.lit(1)).alias("n"))


def review_throughput(feedback: DataFrame, review: DataFrame) -> DataFrame:
    reviewed = with_review(feedback, review).filter("reviewed_at is not null")
    return reviewed.groupBy(F.date_format("reviewed_at", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("reviewed")
    )


def unique_counts(feedback: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return feedback.agg(
        count(F.coalesce("video_id", "video_url", "id")).alias("unique_videos"),
        count(F.nullif("client_id", F.lit(""))).alias("unique_clients"),
    )


def video_rollup(feedback: DataFrame, review: DataFrame) -> DataFrame:
    """Per video; ``sources`` holds the closed set of evidence sources, so its size is bounded."""
    df = with_review(feedback, review)
    newest = F.struct(F.col("received_at"), F.col("id"))
    return df.groupBy(F.coalesce("video_id", F.lit("unknown")).alias("video_id")).agg(
        F.max_by("video_url", newest).alias("video_url"),
        F.count(F.lit(1)).alias("n_feedback"),
        F.count_distinct(F.nullif("client_id", F.lit(""))).alias("n_clients"),
        F.count(F.when(F.col("review_label").isNull(), 1)).alias("n_pending"),
        F.count("review_label").alias("n_reviewed"),
        F.array_sort(F.collect_set(_source())).alias("sources"),
        F.max("received_at").alias("latest_received_at"),
    )


def timecode_url(url: Column, seconds: Column) -> Column:
    """Watch link that starts at the given second; an older start mark is replaced."""
    mark = F.concat(F.lit("t="), F.greatest(F.lit(0), half_up(seconds)).cast("string"), F.lit("s"))
    fragment = F.regexp_extract(url, "#.*$", 0)
    base = F.regexp_replace(url, "#.*$", "")
    had = base.rlike(r"[?&]t=")
    replaced = F.regexp_replace(base, r"([?&])t=[^&]*", F.concat(F.lit("$1"), mark))
    added = F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), mark)
    valid = url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:.+")
    return F.when(valid, F.concat(F.when(had, replaced).otherwise(added), fragment))


def review_queue(feedback: DataFrame, review: DataFrame, source: str | None = None) -> DataFrame:
    """Pending feedback, newest first."""
    pending = feedback.join(
        review.select(F.col("feedback_id").alias("id")).distinct(), "id", "left_anti"
    ).withColumn("shown_source", _source())
    if source is not None:
        pending = pending.filter(F.col("shown_source") == source)
    return pending.withColumn("watch_url", timecode_url(F.col("video_url"), F.col("start_s"))).orderBy(
        F.col("received_at").desc(), "id"
    )


def recent_reviews(feedback: DataFrame, review: DataFrame, k: int = RECENT_REVIEWS) -> DataFrame:
    done = with_review(feedback, review).filter("review_label is not null")
    return done.orderBy(F.col("received_at").desc(), "id").limit(k)


def matches_query(row: Column, query: str) -> Column:
    """Case-insensitive substring of the row's JSON text; a blank query matches everything."""
    needle = query.strip().lower()
    if not needle:
        return F.lit(True)
    return F.lower(F.to_json(row)).contains(needle)


FEEDBACK_SORTS = ["received-desc", "received-asc", "model-desc", "heuristic-desc", "time-asc"]


def _feedback_order(sort: str) -> list[Column]:
    newest = [F.col("received_at").desc(), F.col("id")]
    zero = F.lit(0.0)
    first = {
        "received-asc": [F.col("received_at"), F.col("id")],
        "model-desc": [F.coalesce("model_confidence", zero).desc(), *newest],
        "heuristic-desc": [F.coalesce("heuristic_confidence", zero).desc(), *newest],
        "time-asc": [F.col("start_s"), *newest],
    }
    return first.get(sort, newest)


def feedback_search(
    feedback: DataFrame, review: DataFrame, query: str = "", source: str | None = None,
    status: str = "all", sort: str = "received-desc",
) -> DataFrame:
    df = with_review(feedback, review)
    df = df.filter(matches_query(F.struct(*[F.col(c) for c in df.columns]), query))
    if source is not None:
        df = df.filter(_source() == source)
    if status != "all":
        df = df.filter(F.col("review_label").isNull() if status == "pending" else F.col("review_label").isNotNull())
    return df.orderBy(*_feedback_order(sort))


VIDEO_SORTS = ["feedback-desc", "pending-desc", "reviewed-desc", "recent-desc", "video-asc"]


def _client_matches(feedback: DataFrame, query: str) -> DataFrame:
    """Videos one of whose clients contains the query."""
    hit = F.lower(F.nullif("client_id", F.lit(""))).contains(query.strip().lower())
    return feedback.filter(hit).select(F.coalesce("video_id", F.lit("unknown")).alias("video_id")).distinct()


def video_search(
    feedback: DataFrame, review: DataFrame, query: str = "", source: str | None = None, sort: str = "feedback-desc"
) -> DataFrame:
    out = video_rollup(feedback, review)
    if query.strip():
        by_client = _client_matches(feedback, query).withColumn("_by_client", F.lit(True))
        shown = F.struct(F.col("video_id").alias("videoId"), F.col("video_url").alias("url"), F.col("sources"))
        out = (
            out.join(by_client, "video_id", "left")
            .filter(F.col("_by_client") | matches_query(shown, query))
            .drop("_by_client")
        )
    if source is not None:
        out = out.filter(F.array_contains("sources", source))
    first = {
        "pending-desc": [F.col("n_pending").desc()],
        "reviewed-desc": [F.col("n_reviewed").desc()],
        "recent-desc": [F.col("latest_received_at").desc()],
        "video-asc": [],
    }.get(sort, [F.col("n_feedback").desc()])
    return out.orderBy(*first, "video_id")


def _top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows with their position; the window only sees those rows."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def global_search(
    feedback: DataFrame, review: DataFrame, models: DataFrame, runs: DataFrame, query: str
) -> DataFrame:
    """Best hits of four kinds in one list: ``kind_ord, category, position, id, title, meta, detail``."""
    if not query.strip():
        query = "\0"
    dot = F.lit(" · ")
    f = with_review(feedback, review)
    fields = {
        "id": "id", "videoId": "video_id", "videoUrl": "video_url", "clientId": "client_id",
        "occurrenceId": "occurrence_id", "source": "source", "summary": "summary", "reason": "reason",
        "feedback": "feedback", "review": "review_label", "notes": "notes", "transcriptContext": "transcript_context",
    }
    row = F.struct(*[F.col(c).alias(n) for n, c in fields.items()])
    hits = (
        _top(f.filter(matches_query(row, query)), [F.col("received_at").desc(), F.col("id")], SEARCH_LIMITS["feedback"])
        .select(
            F.lit(0).alias("kind_ord"), F.lit("Feedback").alias("category"), "position",
            F.concat(F.lit("feedback:"), F.col("id")).alias("id"), F.col("occurrence_id").alias("title"),
            F.concat_ws(" · ", F.coalesce("video_id", F.lit("unknown video")), F.nullif("client_id", F.lit(""))).alias("meta"),
            F.concat(source_label(_source()), dot, clock_text(F.col("start_s")), dot, F.col("summary")).alias("detail"),
        )
    )
    videos = (
        _top(
            video_search(feedback, review, query),
            [F.col("latest_received_at").desc(), F.col("video_id")], SEARCH_LIMITS["video"],
        )
        .select(
            F.lit(1).alias("kind_ord"), F.lit("Video").alias("category"), "position",
            F.concat(F.lit("video:"), F.col("video_id")).alias("id"), F.col("video_id").alias("title"),
            F.concat(
                F.col("n_feedback"), F.lit(" feedback · "), F.col("n_clients"), F.lit(" clients · "),
                F.col("n_pending"), F.lit(" pending"),
            ).alias("meta"),
            F.array_join(F.transform("sources", source_label), ", ").alias("detail"),
        )
    )
    metric = F.coalesce(fixed_text(F.col("metrics.f1"), 3), F.lit("-"))
    accuracy = F.coalesce(fixed_text(F.col("metrics.accuracy"), 3), F.lit("-"))
    found_models = (
        _top(
            models.filter(matches_query(F.struct(*models.columns), query)),
            [F.col("created_at").desc(), F.col("model_id")], SEARCH_LIMITS["model"],
        )
        .select(
            F.lit(2).alias("kind_ord"), F.lit("Model").alias("category"), "position",
            F.concat(F.lit("model:"), F.col("model_id")).alias("id"), F.col("model_id").alias("title"),
            F.col("model_version").alias("meta"),
            F.concat(F.lit("F1 "), metric, F.lit(" · accuracy "), accuracy).alias("detail"),
        )
    )
    found_runs = (
        _top(
            runs.filter(matches_query(F.struct(*runs.columns), query)),
            [F.col("created_at").desc(), F.col("id")], SEARCH_LIMITS["training"],
        )
        .select(
            F.lit(3).alias("kind_ord"), F.lit("Training").alias("category"), "position",
            F.concat(F.lit("training:"), F.col("id")).alias("id"), F.col("model_id").alias("title"),
            F.col("status").alias("meta"),
            F.concat(
                F.col("dataset_size"), F.lit(" examples · "), F.col("validation_size"), F.lit(" validation")
            ).alias("detail"),
        )
    )
    out = hits.unionByName(videos).unionByName(found_models).unionByName(found_runs)
    return out.orderBy("kind_ord", "position").limit(SEARCH_LIMITS["all"])


DATASET_SORTS = ["received-desc", "received-asc", "time-asc", "confidence-desc", "trainable-first"]


def dataset_search(
    rows: DataFrame, feedback: DataFrame, query: str = "", source: str | None = None,
    status: str = "all", sort: str = "received-desc",
) -> DataFrame:
    """``rows``: output of ``dataset_rows``; the search text also covers the feedback row."""
    payload = feedback.select(
        F.col("id").alias("feedback_id"), "model_confidence",
        F.struct(*[F.col(c) for c in feedback.columns if c not in ("id", "received_at")]).alias("payload"),
    )
    df = rows.join(payload, "feedback_id", "left")
    df = df.filter(matches_query(F.struct(*rows.columns, "payload"), query)).drop("payload")
    if source is not None:
        df = df.filter(F.col("source") == source)
    any_trainable = F.col("trainable") | F.col("boundary_trainable")
    wanted = {"trainable": any_trainable, "blocked": ~any_trainable, "incompatible": ~F.col("compatible")}
    if status in wanted:
        df = df.filter(wanted[status])
    newest = [F.col("received_at").desc(), F.col("feedback_id")]
    first = {
        "received-asc": [F.col("received_at"), F.col("feedback_id")],
        "time-asc": [F.col("start_s"), *newest],
        "confidence-desc": [F.coalesce("model_confidence", F.lit(0.0)).desc(), *newest],
        "trainable-first": [F.col("trainable").desc(), *newest],
    }
    return df.orderBy(*first.get(sort, newest))


def run_comparison(run: DataFrame, promoted: DataFrame) -> DataFrame:
    """Run metrics next to those of the promoted model: ``id, metric, run_value, promoted_value``.

    Without a promoted model there is nothing to compare with; a second one is an error.
    """
    shown = F.filter(F.map_entries("metrics"), lambda e: e["key"].isin(RUN_METRICS))
    r = run.select("id", F.inline(shown))
    one = promoted.agg(only(F.struct("metrics")).alias("p")).filter("p is not null")
    p = one.select(F.explode("p.metrics").alias("key", "promoted_value"))
    has = one.select(F.lit(1).alias("_k"))
    return (
        r.withColumn("_k", F.lit(1))
        .join(has, "_k", "left_semi")
        .join(p, "key", "left")
        .select("id", F.col("key").alias("metric"), F.col("value").alias("run_value"), "promoted_value")
    )


def source_list(feedback: DataFrame) -> DataFrame:
    out = feedback.select(_source().alias("source")).distinct().withColumn("label", source_label(F.col("source")))
    return out.orderBy("label", "source")


