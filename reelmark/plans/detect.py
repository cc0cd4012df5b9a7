"""Queries: captions, links, codes, fusion, features, scores, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tables import settle
from ..operators import (
    evaluation,
    features as ft,
    fusion,
    links,
    playback,
    pool_features as pf,
    reports,
    scoring,
    transcript,
)
from ..sources import schemas as S
from . import derived as d
from .registry import clock, query, rnd

PHRASES = [
    {"id": "start", "kind": S.START, "confidence": 0.85, "reason_label": "Start cue", "phrases": ["of the", "the of"]},
    {"id": "presence", "kind": S.PRESENCE, "confidence": 0.5, "reason_label": "Presence cue", "phrases": ["by", "is"]},
    {"id": "end", "kind": S.END, "confidence": 0.7, "reason_label": "End cue", "phrases": ["and the", "to the"]},
]
MODEL = scoring.Model(
    "model-a", "2024.01.01.000000", -1.5,
    {"heuristicConfidence": 2.25, "evidenceTotal": 0.125, "qrCount": -0.5, "isOpenEnded": -0.75, "nearbyEndCue": 1.5},
    {"positive": 0.75, "review": 0.5},
    {"start_offset_s": 2.5, "end_offset_s": None},
    {"transcript": {"start_offset_s": 5.0, "end_offset_s": 6.0}, "frame-qr-code": {"start_offset_s": -3.25, "end_offset_s": -250.0}},
)

# ---- SQL pieces -----------------------------------------------------------


def norm(x: str) -> str:
    plain = f"replace(replace(lower({x}), '''', ''), chr(8217), '')"
    return f"trim(regexp_replace({plain}, '\\s+', ' ', 'g'))"


NEG = r"\b(?:not|never|without|isnt|wasnt|werent|arent|wont|didnt|doesnt|dont|no)\b(?:\s+\w+){0,3}\s*$"
NOT_ONLY = r"\bnot\s+only\s*$"


def negated(prefix: str) -> str:
    return f"(not regexp_matches(right({prefix}, 64), '{NOT_ONLY}') and regexp_matches(right({prefix}, 64), '{NEG}'))"


WINDOWS = f"""windows as (
  select video_id, cue_idx, start_s, dur_s, text,
         {norm("concat_ws(' ', text, lead(text) over (partition by video_id order by cue_idx))")} as window_text,
         length({norm("text")}) as cur_len
  from d_cue
)"""
HITS = f"""phrase as (
  select * from (values (0, 'start', 'ad-read-start', 0.85e0, 'Start cue', 'of the', 'of the'),
    (1, 'start', 'ad-read-start', 0.85e0, 'Start cue', 'the of', 'the of'),
    (2, 'presence', 'ad-read-presence', 0.5e0, 'Presence cue', 'by', '\\bby\\b'),
    (3, 'presence', 'ad-read-presence', 0.5e0, 'Presence cue', 'is', '\\bis\\b'),
    (4, 'end', 'ad-read-end', 0.7e0, 'End cue', 'and the', 'and the'),
    (5, 'end', 'ad-read-end', 0.7e0, 'End cue', 'to the', 'to the')) p(ord, group_id, kind, confidence, label, phrase, pattern)
), cut as (
  select w.*, p.*, regexp_split_to_array(window_text, pattern) as parts
  from windows w join phrase p on contains(window_text, phrase)
), piece as (
  select *, unnest(parts) as part, generate_subscripts(parts, 1) as i from cut
), spot as (
  select *, sum(length(part)) over (partition by video_id, cue_idx, ord order by i) + (i - 1) * length(phrase) as position
  from piece
), hit as (
  select * from spot where i < len(parts) and position < cur_len
), kept_hit as (
  select * from hit where not {negated("left(window_text, cast(position as int))")}
), cue_evidence as (
  select video_id, cast(cue_idx as bigint) as ev_idx, 'transcript' as source, kind, start_s, start_s + dur_s as end_s,
         confidence, label || ': "' || phrase || '".' as reason, group_id as raw_group, text as raw_text, phrase as raw_phrase,
         window_text
  from kept_hit
  qualify row_number() over (partition by video_id, cue_idx order by ord, position) = 1
)"""

# All phrase groups of a candidate: a row names one or several.
GROUPS = "list_distinct(flatten(list(string_split(raw_group, ',')) filter (where raw_group is not null)))"

# Recursive fixed-anchor clusters; positions are whole seconds, so "more than 6" is "7 or more".
ITEMS = """frame as (
  select *, case source
      when 'frame-qr-code' then 'qr:' || lower(raw_value)
      when 'frame-visible-link' then 'link:' || lower(coalesce(raw_text, raw_href))
      else 'progress:' || cast(floor(bar_start / 4 + 0.5) * 4 as bigint) || ':' || cast(floor(bar_y / 4 + 0.5) * 4 as bigint)
           || ':' || cast(floor((bar_end - bar_start + 1) / (801 - bar_start) + 0.5) as bigint) end as fp
  from d_evidence where source <> 'transcript'
), place as (
  select distinct video_id, kind, source, fp, start_s from frame
), jump as (
  select *, min(start_s) over (partition by video_id, kind, source, fp order by start_s
                               range between 7 following and unbounded following) as next_s from place
), anchor as (
  select video_id, kind, source, fp, min(start_s) as anchor_s from place group by all
  union all
  select a.video_id, a.kind, a.source, a.fp, j.next_s
  from anchor a join jump j on a.video_id = j.video_id and a.kind = j.kind and a.source = j.source and a.fp = j.fp
    and a.anchor_s = j.start_s
  where j.next_s is not null
), placed as (
  select f.*, a.anchor_s from frame f asof join anchor a
    on f.video_id = a.video_id and f.kind = a.kind and f.source = a.source and f.fp = a.fp and f.start_s >= a.anchor_s
), best as (
  select *, row_number() over (partition by video_id, kind, source, fp, anchor_s order by confidence desc, start_s, ev_idx) as r,
         first_value(ev_idx) over (partition by video_id, kind, source, fp, anchor_s order by start_s, ev_idx) as first_idx
  from placed
), item as (
  select video_id, first_idx as ev_idx, source, kind, anchor_s as start_s, confidence, reason, raw_value, raw_text, raw_signal,
         raw_detector, raw_group, box_x, box_y, bar_y, bar_start, bar_end from best where r = 1
  union all
  select video_id, ev_idx, source, kind, start_s, confidence, reason, raw_value, raw_text, raw_signal,
         raw_detector, raw_group, box_x, box_y, bar_y, bar_start, bar_end from d_evidence where source = 'transcript'
)"""
FUSE = f"""seed as (select video_id, ev_idx as cand_idx, start_s as cand_s from item where kind = 'ad-read-start'),
near_item as (
  select s.cand_idx, s.cand_s, i.* from seed s join item i on s.video_id = i.video_id and i.kind = 'ad-read-presence'
    and abs(i.start_s - s.cand_s) <= 20
), end_item as (
  select s.cand_idx, s.cand_s, i.* from seed s join item i on s.video_id = i.video_id and i.kind = 'ad-read-end'
    and i.start_s > s.cand_s and i.start_s <= s.cand_s + 240
  qualify row_number() over (partition by s.video_id, s.cand_idx order by i.start_s, i.ev_idx) = 1
), lone as (
  select * from item where kind = 'ad-read-presence' and video_id not in (select video_id from seed)
), flagged as (
  select *, case when start_s - lag(start_s) over w <= 20 then 0 else 1 end as opens from lone
  window w as (partition by video_id order by start_s, ev_idx)
), chained as (
  select *, sum(opens) over (partition by video_id order by start_s, ev_idx) as chain from flagged
), cluster as (
  select *, min(start_s) over (partition by video_id, chain) as cluster_s,
         first_value(ev_idx) over (partition by video_id, chain order by start_s, ev_idx) as cand_idx
  from chained
), stat as (
  select video_id, cluster_s, cand_idx, count(*) as n_items,
    bool_or(source in ('frame-qr-code', 'frame-visible-link') and coalesce(raw_signal, '') = 'sponsor-cta') as has_sponsor_frame,
    count(distinct case when source = 'frame-visible-link' and raw_detector = 'transcript' then 'transcript' else source end) > 1
      as has_two_channels,
    bool_and(source = 'frame-qr-code' and coalesce(raw_signal, '') <> 'sponsor-cta') as all_generic_qr
  from cluster group by all
), good as (
  select * from stat where has_sponsor_frame or has_two_channels or (n_items >= 3 and all_generic_qr)
), member as (
  select s.cand_idx, s.cand_s, true as seeded, i.* from seed s join item i on s.video_id = i.video_id and s.cand_idx = i.ev_idx
     and i.kind = 'ad-read-start'
  union all select cand_idx, cand_s, true, * exclude (cand_idx, cand_s) from near_item
  union all select cand_idx, cand_s, true, * exclude (cand_idx, cand_s) from end_item
  union all select c.cand_idx, c.cluster_s, false, c.* exclude (opens, chain, cluster_s, cand_idx)
    from cluster c join good g on c.video_id = g.video_id and c.cluster_s = g.cluster_s
), scored as (
  select video_id, cand_idx, min(cand_s) as start_s, bool_or(seeded) as seeded, count(*) as n_evidence,
    least(0.98e0, {rnd('''cast(sum(cast(cast(confidence as decimal(12,6)) * (case when source in ('frame-progress-bar', 'frame-qr-code') then 0.50
       when source = 'frame-visible-link' then 0.65 when kind = 'ad-read-start' then 0.75 when kind = 'ad-read-end' then 0.20
       else 0.45 end)::decimal(4,2) as decimal(20,8))) as double)''', 3)}) as confidence,
    min(case when seeded and kind = 'ad-read-end' then member.start_s end) as detected_end_s
  from member group by video_id, cand_idx
), cand as (
  select *, coalesce(detected_end_s, case when seeded and confidence >= 0.8 then start_s + 120 end) as end_s from scored
)"""


def avg_sql(value: str, cond: str) -> str:
    total = f"cast(sum(case when {cond} then cast({value} as decimal(24,6)) end) as double)"
    return f"coalesce({rnd(f'({total} / nullif(count(case when {cond} then 1 end), 0))', 6)}, 0.0e0)"


def max_sql(cond: str) -> str:
    return f"coalesce({rnd(f'max(case when {cond} then m.confidence end)', 6)}, 0.0e0)"


def _count(cond: str) -> str:
    return f"cast(count(case when {cond} then 1 end) as double)"


_BOX = "m.source = 'frame-qr-code' and box_x is not null"
_BAR = "m.source = 'frame-progress-bar' and bar_y is not null"
_SRC = {"Transcript": "transcript", "Qr": "frame-qr-code", "ProgressBar": "frame-progress-bar", "VisibleLink": "frame-visible-link"}


def features_cte(text_hits: str = "0.0e0", cta_hits: str = "0.0e0") -> str:
    has = {k: f"count(case when m.source = '{v}' then 1 end) > 0" for k, v in _SRC.items()}

    def flag(c: str) -> str:
        return f"case when {c} then 1.0e0 else 0.0e0 end"

    cols = {
        "heuristicConfidence": rnd("c.confidence", 6),
        "evidenceTotal": "cast(count(*) as double)",
        "transcriptStartCount": _count("m.source = 'transcript' and kind = 'ad-read-start'"),
        "transcriptPresenceCount": _count("m.source = 'transcript' and kind = 'ad-read-presence'"),
        "transcriptEndCount": _count("m.source = 'transcript' and kind = 'ad-read-end'"),
        "qrCount": _count("m.source = 'frame-qr-code'"),
        "progressBarCount": _count("m.source = 'frame-progress-bar'"),
        "visibleLinkCount": _count("m.source = 'frame-visible-link'"),
        "qrLocationCount": _count(_BOX),
        "avgQrBoxAreaPixels": avg_sql("4800.0", _BOX),
        "avgQrBoxCenterX": avg_sql("box_x + 40", _BOX),
        "avgQrBoxCenterY": avg_sql("box_y + 30", _BOX),
        "avgProgressBarWidthPixels": avg_sql("bar_end - bar_start + 1", _BAR),
        "avgProgressBarY": avg_sql("bar_y", _BAR),
        "avgProgressBarRows": avg_sql("3.0", _BAR),
        "startSeconds": rnd("c.start_s", 6),
        "durationSeconds": f"coalesce({rnd('(c.end_s - c.start_s)', 6)}, 0.0e0)",
        "isOpenEnded": flag("c.end_s is null"),
        "normalizedVideoPosition": rnd("(c.start_s / 1800.0e0)", 6),
        "evidenceTimeSpanSeconds": rnd("(max(m.start_s) - min(m.start_s))", 6),
        "hasTranscriptAndQr": flag(f"{has['Transcript']} and {has['Qr']}"),
        "hasTranscriptAndVisibleLink": flag(f"{has['Transcript']} and {has['VisibleLink']}"),
        "hasTranscriptAndProgressBar": flag(f"{has['Transcript']} and {has['ProgressBar']}"),
        "hasQrAndVisibleLink": flag(f"{has['Qr']} and {has['VisibleLink']}"),
        "isFrameOnly": flag(f"not {has['Transcript']}"),
        "isTranscriptOnly": flag("count(case when m.source = 'transcript' then 1 end) = count(*)"),
        "matchedPhraseGroupCount": f"cast(coalesce(len({GROUPS}), 0) as double)",
        "sponsorPhraseHitCount": text_hits,
        "callToActionPhraseHitCount": cta_hits,
        "nearbyEndCue": "case when bool_or(kind = 'ad-read-end' and case when c.end_s is not null then abs(m.start_s - c.end_s) <= 10 "
        "else m.start_s >= c.start_s and m.start_s <= c.start_s + 240 end) then 1.0e0 else 0.0e0 end",
    }
    for name, src in _SRC.items():
        cols[f"max{name}Confidence"] = max_sql(f"m.source = '{src}'")
        cols[f"avg{name}Confidence"] = avg_sql("m.confidence", f"m.source = '{src}'")
    listed = ",\n    ".join(f'{cols[n]} as "{n}"' for n in ft.FEATURE_NAMES)
    return f"""feature as (
  select c.video_id, c.cand_idx,
    {listed}
  from cand c join member m on c.video_id = m.video_id and c.cand_idx = m.cand_idx
  group by c.video_id, c.cand_idx, c.confidence, c.start_s, c.end_s
)"""


_LOGIT = f"({MODEL.intercept}e0" + "".join(f' + "{n}" * {w}e0' for n, w in MODEL.weights.items()) + ")"
SCORED_CTE = f"""applied as (
  select c.video_id, c.cand_idx, c.start_s, c.end_s, {rnd(f'(1.0e0 / (1.0e0 + exp(-{_LOGIT})))', 6)} as confidence,
         {rnd('c.confidence', 6)} as heuristic_confidence
  from cand c join feature f on c.video_id = f.video_id and c.cand_idx = f.cand_idx
), primary_src as (
  select m.video_id, m.cand_idx, m.source from member m join cand c on m.video_id = c.video_id and m.cand_idx = c.cand_idx
  qualify row_number() over (partition by m.video_id, m.cand_idx order by case when m.kind = 'ad-read-start' then 0 else 1 end,
    abs(m.start_s - c.start_s), m.start_s, m.ev_idx) = 1
), shifted as (
  select a.*, greatest(0.0e0, {rnd("(a.start_s + case p.source when 'transcript' then 5.0e0 when 'frame-qr-code' then -3.25e0 else 2.5e0 end)", 6)}) as s2,
    {rnd("(a.end_s + case p.source when 'transcript' then 6.0e0 when 'frame-qr-code' then -250.0e0 else 2.5e0 end)", 6)} as e2
  from applied a join primary_src p on a.video_id = p.video_id and a.cand_idx = p.cand_idx
), moved as (
  select video_id, cand_idx, confidence, heuristic_confidence,
    case when e2 is null or e2 > s2 + 1 then s2 else start_s end as start_s,
    case when e2 is null or e2 > s2 + 1 then e2 else end_s end as end_s
  from shifted
)"""

FUSED = f"with recursive {ITEMS},\n{FUSE}"
FEATURED = f"{FUSED},\n{features_cte()}"
APPLIED = f"{FEATURED},\n{SCORED_CTE}"
EV = ["d_evidence"]


# ---- jobs shared by several queries -----------------------------------------


def phrase_column():
    return transcript.phrase_array(PHRASES)


def cue_evidence(spark, sf):
    return transcript.transcript_evidence(d.cues(spark, sf), phrase_column())


def members(spark, sf):
    return fusion.candidate_members(d.evidence(spark, sf))


def candidates_and_members(spark, sf):
    member = settle(members(spark, sf))
    return fusion.candidates_of(member), member


def videos(candidate):
    return candidate.select("video_id").distinct().withColumn("duration_s", F.lit(1800.0))


def featured(spark, sf):
    """Coalesced evidence, its pool and the pool's features; no candidate is paired with its evidence."""
    items = settle(fusion.coalesce_frames(d.evidence(spark, sf)))
    parts = fusion.pool_parts(items)
    pool = settle(fusion.candidate_pool(items, True, parts))
    return items, pool, pf.pool_features(items, pool, videos(pool), parts=parts)


def applied(spark, sf):
    items, pool, vector = featured(spark, sf)
    return scoring.apply_model(pool, vector, MODEL), items


# ---- captions ---------------------------------------------------------------


@query("cue_windows", f"with {WINDOWS} select video_id, cue_idx, window_text, cur_len from windows", ["d_cue"])
def _(spark, sf):
    out = transcript.cue_windows(d.cues(spark, sf))
    return out.select("video_id", "cue_idx", "window_text", F.col("cur_len").cast("bigint").alias("cur_len"))


_HIT_COLUMNS = "select video_id, cue_idx, phrase, cast(position as int) as position"


@query("phrase_hits", f"with {WINDOWS}, {HITS} {_HIT_COLUMNS} from hit", ["d_cue"])
def _(spark, sf):
    hits = transcript.phrase_hits(transcript.cue_windows(d.cues(spark, sf)), phrase_column())
    return hits.select("video_id", "cue_idx", "phrase", "position")


@query("drop_negated", f"with {WINDOWS}, {HITS} {_HIT_COLUMNS} from kept_hit".replace("d_cue", "d_cue_not"), ["d_cue_not"])
def _(spark, sf):
    hits = transcript.phrase_hits(transcript.cue_windows(d.view(spark, sf, "d_cue_not")), phrase_column())
    return transcript.drop_negated(hits).select("video_id", "cue_idx", "phrase", "position")


@query(
    "transcript_evidence",
    f"with {WINDOWS}, {HITS} select video_id, ev_idx, kind, start_s, end_s, confidence, reason, window_text as context_text, "
    "raw_group as phrase_group_id from cue_evidence",
    ["d_cue"],
)
def _(spark, sf):
    return cue_evidence(spark, sf).select(
        "video_id", "ev_idx", "kind", "start_s", "end_s", "confidence", "reason", "raw.context_text", "raw.phrase_group_id"
    )


@query("normalize_text", f"select doc_id, {norm('text')} as norm from documents")
def _(spark, sf):
    docs = d.table(spark, sf, "documents")
    return docs.select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))


# ---- links and codes ----------------------------------------------------------


def sql_text_semantic(x: str) -> str:
    cases = "".join(
        f"\n  when regexp_matches({x}, '{p}') and not {negated(f'''regexp_split_to_array({x}, '{p}')[1]''')} then '{n}'"
        for n, p in tx.PROMO_TEXT_PATTERNS
    )
    return f"case{cases} end"


def sql_url_semantic(x: str) -> str:
    rest = f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '^https?://+', ''), '^[^/?#@]*@', ''), '^([^/?#:]*):\\d*', '\\1')"
    delim = tx.URL_DELIMITERS.replace("'", "''")
    return f"nullif(regexp_extract({rest}, '(?:^|{delim})({'|'.join(tx.PROMO_URL_TOKENS)})(?:$|{delim})', 1), '')"


def sql_links(x: str) -> str:
    def rep(t: str, p: str, r: str, flags: str) -> str:
        return f"regexp_replace({t}, '{p}', '{r}', '{flags}')"

    t = rep(x, r"\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*", ".", "gi")
    t = rep(t, r"([A-Za-z])\s+\.\s*([A-Za-z])", r"\1.\2", "g")
    t = rep(t, r"([A-Za-z])\s*\.\s+([a-z])", r"\1.\2", "g")
    t = rep(t, r"\s*(?:\bslash\b|/)\s*", "/", "gi")
    t = rep(t, r"https\s*:\s*/\s*/", "https://", "gi")
    t = rep(t, r"http\s*:\s*/\s*/", "http://", "gi")
    pattern = "(?i)@?" + tx.LINK.replace("'", "''")
    found = f"list_filter(regexp_extract_all({t}, '{pattern}'), lambda m: not starts_with(m, '@'))"
    bare = f"list_transform({found}, lambda m: regexp_replace(m, '{tx.LINK_TAIL}', ''))"
    full = f"list_transform({bare}, lambda m: case when regexp_matches(m, '(?i)^https?://') then m else 'https://' || m end)"
    origin = "regexp_extract(m, '(?i)^https?://[^/?#\\\\]*')"
    host = f"regexp_replace(regexp_replace(lower({origin}), '^(https://.*):(443)?$', '\\1'), '^(http://.*):(80)?$', '\\1')"
    rest = f"substr(m, length({origin}) + 1)"
    raw = f"translate(regexp_extract({rest}, '^[^?#]*'), '\\', '/')"
    segments = f"string_split(case when starts_with({raw}, '/') then substr({raw}, 2) else {raw} end, '/')"
    # Folding on the string itself: a double dot cuts the last segment off, a closing dot leaves a slash.
    folded = (
        f"list_reduce(list_prepend('', list_concat({segments}, case when regexp_matches(lower({segments}[-1]), '^(\\.|%2e){{1,2}}$') then [''] else [] end)), "
        "lambda acc, s: case when lower(s) in ('..', '.%2e', '%2e.', '%2e%2e') then regexp_replace(acc, '/[^/]*$', '') when lower(s) in ('.', '%2e') then acc else acc || '/' || s end)"
    )
    esc = lambda x, chars: f"array_to_string(list_transform(string_split({x}, ''), lambda c: case when regexp_matches(c, '[^\\x21-\\x7E]|[{chars}]') then url_encode(c) else c end), '')"
    query, fragment = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)", f"regexp_extract({rest}, '(#.*)$', 1)"
    whole = f"{host} || {esc(folded, '\"<>^`{}')} || {esc(query, '\"<>' + chr(39) * 2)} || {esc(fragment, '\"<>`')}"
    return f"list_transform({full}, lambda m: {whole})"


@query(
    "promo_text_semantic",
    f"with n as (select video_id, {norm('text')} as t from d_link) select video_id, {sql_text_semantic('t')} as semantic from n",
    ["d_link"],
)
def _(spark, sf):
    return d.links(spark, sf).select("video_id", tx.promo_text_semantic(F.col("text")).alias("semantic"))


@query("promo_url_semantic", f"select video_id, {sql_url_semantic('url')} as semantic from d_link", ["d_link"])
def _(spark, sf):
    return d.links(spark, sf).select("video_id", tx.promo_url_semantic(F.col("url")).alias("semantic"))


_CONTEXT = f"""with n as (select *, {norm('text')} as t from d_link),
c as (select *, {sql_url_semantic('url')} as u, {sql_text_semantic('t')} as x from n)"""


@query(
    "classify_link_context",
    f"""{_CONTEXT} select video_id, case when coalesce(u, x) is null then 'low-signal' else 'sponsor-cta' end as signal,
  coalesce(u, x) as matched_semantic,
  case when u is not null then 'URL contains promotional semantic "' || u || '"'
       when x is not null then 'surrounding text contains promotional semantic "' || x || '"'
       else 'URL and surrounding text contain no promotional semantics' end as reason from c""",
    ["d_link"],
)
def _(spark, sf):
    c = links.classify_link_context(F.col("text"), F.array("url"))
    return d.links(spark, sf).select("video_id", c.alias("c")).select("video_id", "c.*")


@query(
    "extract_links",
    f"""with found as (select video_id, {sql_links('plain')} as all_links from d_link),
one as (select video_id, unnest(all_links) as link, generate_subscripts(all_links, 1) as i from found),
kept as (select * from one qualify row_number() over (partition by video_id, lower(link) order by i) = 1)
select video_id, link, cast(row_number() over (partition by video_id order by i) as bigint) as position from kept""",
    ["d_link"],
)
def _(spark, sf):
    out = d.links(spark, sf).select("video_id", F.posexplode(tx.extract_links(F.col("plain"))).alias("position", "link"))
    return out.withColumn("position", (F.col("position") + 1).cast("bigint"))


_LINK_EV = f"""with n as (select *, {norm('text')} as t, {sql_links('text')} as found from d_link),
one as (select video_id, unnest(found) as link, generate_subscripts(found, 1) as i from n),
kept as (select * from one qualify row_number() over (partition by video_id, lower(link) order by i) = 1),
joined as (select video_id, string_agg(link, ' ' order by i) as links, min_by({sql_url_semantic('link')}, i) filter (where {sql_url_semantic('link')} is not null) as u
  from kept group by video_id),
c as (select n.*, j.links, coalesce(j.u, {sql_text_semantic('t')}) as semantic from n join joined j on n.video_id = j.video_id)"""


@query(
    "transcript_link_evidence",
    f"""{_LINK_EV} select video_id, start_s, links, semantic, case when semantic is null then 0.18e0 else 0.58e0 end as confidence,
  case when semantic is null then 'Detected URL in video text, but it has no promotional semantics.'
       else 'Detected sponsor-like link in video text.' end as reason from c""",
    ["d_link"],
)
def _(spark, sf):
    out = links.transcript_link_evidence(d.links(spark, sf).withColumn("dur_s", F.lit(4.0)))
    return out.select(
        "video_id", "start_s", F.array_join("raw.links", " ").alias("links"), F.col("raw.matched_semantic").alias("semantic"),
        "confidence", "reason",
    )


@query(
    "screen_text_evidence",
    f"""{_LINK_EV} select video_id, start_s, links, semantic, case when semantic is null then 0.24e0 else 0.72e0 end as confidence
  from c""",
    ["d_link"],
)
def _(spark, sf):
    parts = F.array(F.col("text"), F.lit(""), F.lit(None).cast("string"))
    seen = d.links(spark, sf).select("video_id", F.col("cue_idx").alias("obs_idx"), F.col("start_s").alias("t_s"), parts.alias("parts"))
    return links.screen_text_evidence(seen).select(
        "video_id", "start_s", F.array_join("raw.links", " ").alias("links"),
        F.col("raw.matched_semantic").alias("semantic"), "confidence",
    )


_PAYLOAD = """case page_id % 5 when 0 then url || '/offer' when 1 then url when 2 then 'USE CODE SAVE' || cast(page_id as string)
  when 3 then 'hello from page ' || cast(page_id as string) else 'shop' || cast(page_id as string) || '.example/deal' end"""


@query(
    "qr_payload_evidence",
    f"""with o as (select page_id, {_PAYLOAD} as value, case page_id % 3 when 0 then 'native' when 1 then 'direct' else 'upscaled' end as detector
  from pages),
c as (select *, page_id % 5 in (0, 1, 4) as is_url, {sql_url_semantic('value')} as token from o),
s as (select *, case when is_url then token is not null else page_id % 5 = 2 end as sponsor from c)
select 'p' || cast(page_id as string) as video_id, case when not sponsor then 0.32e0 when detector = 'native' then 0.9e0
    when detector = 'upscaled' then 0.82e0 else 0.85e0 end as confidence,
  case when is_url then 'url' when sponsor then 'promo-code' else 'plain-text' end as payload_type,
  case when sponsor then 'sponsor-cta' else 'low-signal' end as signal,
  case when detector <> 'native' then {rnd('(page_id / 2.0e0 + 7)', 2)} end as box_x from s""",
)
def _(spark, sf):
    page = d.table(spark, sf, "pages")
    at = F.struct(F.col("page_id").cast("double").alias("x"), F.lit(2.0).alias("y"))
    seen = page.select(
        F.concat(F.lit("p"), "page_id").alias("video_id"), F.col("page_id").alias("obs_idx"), F.lit(1.0).alias("t_s"),
        F.expr(_PAYLOAD).alias("value"),
        F.expr("case page_id % 3 when 0 then 'native' when 1 then 'direct' else 'upscaled' end").alias("detector"),
        F.struct(at.alias("top_left"), at.alias("bottom_right")).alias("location"), F.lit(2.0).alias("scale"),
        F.lit(7.0).alias("offset_x"), F.lit(0.0).alias("offset_y"),
    )
    return links.qr_payload_evidence(seen).select(
        "video_id", "confidence", "raw.payload_type", "raw.signal", F.col("raw.location.top_left.x").alias("box_x")
    )


# ---- fusion ---------------------------------------------------------------------


@query("coalesce_frames", f"with recursive {ITEMS} select video_id, ev_idx, source, kind, start_s, confidence from item", EV)
def _(spark, sf):
    out = fusion.coalesce_frames(d.evidence(spark, sf))
    return out.select("video_id", "ev_idx", "source", "kind", "start_s", "confidence")


@query(
    "seed_mode",
    """with s as (select distinct video_id from d_evidence where kind = 'ad-read-start')
select e.video_id, ev_idx, s.video_id is not null as seeded from d_evidence e left join s on e.video_id = s.video_id""",
    EV,
)
def _(spark, sf):
    seeded, unseeded = fusion.seed_mode(d.evidence(spark, sf))
    cols = ["video_id", "ev_idx"]
    return seeded.select(*cols, F.lit(True).alias("seeded")).unionByName(
        unseeded.select(*cols, F.lit(False).alias("seeded"))
    )


@query(
    "seed_presence",
    """select s.video_id, s.ev_idx as cand_idx, p.ev_idx, p.start_s from d_evidence s join d_evidence p on s.video_id = p.video_id
where s.kind = 'ad-read-start' and p.kind = 'ad-read-presence' and abs(p.start_s - s.start_s) <= 20""",
    EV,
)
def _(spark, sf):
    return fusion.seed_presence(d.evidence(spark, sf)).select("video_id", "cand_idx", "ev_idx", "start_s")


@query(
    "seed_end",
    """with s as (select distinct video_id, start_s as seed_s from d_evidence where kind = 'ad-read-start')
select s.video_id, seed_s, e.start_s as end_at, e.ev_idx as end_idx from s join d_evidence e on s.video_id = e.video_id
where e.kind = 'ad-read-end' and e.start_s > seed_s and e.start_s <= seed_s + 240
qualify row_number() over (partition by s.video_id, seed_s order by e.start_s, e.ev_idx) = 1""",
    EV,
)
def _(spark, sf):
    out = fusion.seed_end(d.evidence(spark, sf))
    return out.select("video_id", "seed_s", "end_at", F.col("end_row.ev_idx").alias("end_idx"))


@query("presence_clusters", f"{FUSED} select video_id, ev_idx, start_s, cluster_s from cluster", EV)
def _(spark, sf):
    items = settle(fusion.coalesce_frames(d.evidence(spark, sf)))
    return fusion.presence_clusters(fusion.seed_mode(items)[1]).select("video_id", "ev_idx", "start_s", "cluster_s")


@query(
    "eligible_clusters",
    f"{FUSED} select video_id, cluster_s, cand_idx, n_items, has_sponsor_frame, has_two_channels, all_generic_qr from good",
    EV,
)
def _(spark, sf):
    items = settle(fusion.coalesce_frames(d.evidence(spark, sf)))
    out = fusion.eligible_clusters(fusion.presence_clusters(fusion.seed_mode(items)[1]))
    return out.select(
        "video_id", "cluster_s", "cand_idx", "n_items", "has_sponsor_frame", "has_two_channels", "all_generic_qr"
    )


@query("candidate_members", f"{FUSED} select video_id, cand_idx, cand_s, seeded, ev_idx, source, kind, start_s from member", EV)
def _(spark, sf):
    return members(spark, sf).select("video_id", "cand_idx", "cand_s", "seeded", "ev_idx", "source", "kind", "start_s")


@query(
    "score_candidates",
    f"{FUSED} select video_id, cand_idx, start_s, seeded, confidence, n_evidence, detected_end_s from scored",
    EV,
)
def _(spark, sf):
    out = fusion.score_candidates(members(spark, sf))
    return out.select("video_id", "cand_idx", "start_s", "seeded", "confidence", "n_evidence", "detected_end_s")


_POOL = "select video_id, cand_idx, start_s, end_s, confidence, n_evidence from cand"


@query("infer_end", f"{FUSED} select video_id, cand_idx, end_s, detected_end_s is null and end_s is not null as assumed from cand", EV)
def _(spark, sf):
    out = fusion.infer_end(fusion.score_candidates(members(spark, sf)))
    assumed = F.col("detected_end_s").isNull() & F.col("end_s").isNotNull()
    return out.select("video_id", "cand_idx", "end_s", assumed.alias("assumed"))


@query("candidate_pool", f"{FUSED} {_POOL}", EV)
def candidate_pool(spark, sf):
    out = fusion.candidate_pool(d.evidence(spark, sf))
    return out.select("video_id", "cand_idx", "start_s", "end_s", "confidence", "n_evidence")


@query("heuristic_candidates", f"{FUSED} {_POOL} where confidence >= 0.4", EV)
def _(spark, sf):
    out = fusion.heuristic_candidates(d.evidence(spark, sf))
    return out.select("video_id", "cand_idx", "start_s", "end_s", "confidence", "n_evidence")


# The caption pipeline end to end: conversations as cues, phrases, fusion.
_CUE_ITEMS = f"""{WINDOWS}, {HITS}, item as (
  select video_id, ev_idx, source, kind, start_s, confidence, reason, cast(null as varchar) as raw_value, raw_text,
    cast(null as varchar) as raw_signal, cast(null as varchar) as raw_detector, raw_group, raw_phrase, cast(null as double) as box_x,
    cast(null as double) as box_y, cast(null as double) as bar_y, cast(null as double) as bar_start, cast(null as double) as bar_end
  from cue_evidence
), {FUSE}"""


@query("caption_candidates", f"with {_CUE_ITEMS} {_POOL}", ["d_cue"])
def caption_candidates(spark, sf):
    """Captions to candidates in one job; the flagship query."""
    evidence = settle(cue_evidence(spark, sf))
    out = fusion.candidate_pool(evidence)
    return out.select("video_id", "cand_idx", "start_s", "end_s", "confidence", "n_evidence")


# ---- features and scores -----------------------------------------------------------


@query("candidate_features", f"{FEATURED} select * from feature", EV)
def _(spark, sf):
    return featured(spark, sf)[2]


@query(
    "phrase_group_ids",
    f"{FUSED} select video_id, cand_idx, coalesce(array_to_string(list_sort({GROUPS}), ','), '') as groups from member group by all",
    EV,
)
def _(spark, sf):
    out = ft.phrase_group_ids(members(spark, sf))
    return out.select("video_id", "cand_idx", F.array_join("phrase_group_ids", ",").alias("groups"))


_CONTEXT_SQL = f"""context as (
  select c.video_id, c.cand_idx, nullif(trim(regexp_replace(string_agg(u.text, ' ' order by u.cue_idx), '\\s+', ' ', 'g')), '') as transcript_context
  from cand c join d_cue u on c.video_id = u.video_id and u.start_s + u.dur_s >= greatest(0, c.start_s - 20)
    and u.start_s <= coalesce(c.end_s, c.start_s) + 20
  group by all
)"""


@query("transcript_context", f"with {_CUE_ITEMS}, {_CONTEXT_SQL} select * from context", ["d_cue"])
def _(spark, sf):
    evidence = settle(cue_evidence(spark, sf))
    return ft.transcript_context(settle(fusion.candidate_pool(evidence)), d.cues(spark, sf))


@query("score", f"{APPLIED} select video_id, cand_idx, confidence as model_confidence from applied", EV)
def _(spark, sf):
    return scoring.score(featured(spark, sf)[2], MODEL).select("video_id", "cand_idx", "model_confidence")


@query("apply_model", f"{APPLIED} select video_id, cand_idx, start_s, end_s, confidence, heuristic_confidence, 'model-a' as model_id, 'downloaded' as model_source from applied", EV)
def _(spark, sf):
    out, _ = applied(spark, sf)
    return out.select(
        "video_id", "cand_idx", "start_s", "end_s", "confidence", "heuristic_confidence", "model_id", "model_source"
    )


@query("apply_boundary_offsets", f"{APPLIED} select video_id, cand_idx, start_s, end_s from moved", EV)
def _(spark, sf):
    candidate, items = applied(spark, sf)
    return scoring.apply_boundary_offsets(candidate, fusion.boundary_members(items), MODEL).select("video_id", "cand_idx", "start_s", "end_s")


_BAND = "case when confidence >= 0.75 then 'display' when confidence >= 0.5 then 'review' else 'reject' end"


@query("select_bands", f"{APPLIED} select video_id, cand_idx, confidence, {_BAND} as band from applied", EV)
def _(spark, sf):
    candidate, _ = applied(spark, sf)
    return scoring.select_bands(candidate, MODEL).select("video_id", "cand_idx", "confidence", "band")


@query(
    "candidate_view",
    f"""{FUSED}, src as (select video_id, cand_idx, string_agg(l, ' + ' order by r) as sources from (
  select distinct video_id, cand_idx, case source when 'transcript' then 0 when 'frame-qr-code' then 1 when 'frame-visible-link' then 2 else 3 end as r,
    case source when 'transcript' then 'transcript' when 'frame-qr-code' then 'QR' when 'frame-visible-link' then 'visible link' else 'progress bar' end as l
  from member) x group by all)
select c.video_id, c.cand_idx, cast(floor(start_s + 0.5) as bigint) || '-' || coalesce(cast(cast(floor(end_s + 0.5) as bigint) as varchar), 'open') as view_id,
  {clock('start_s')} || '-' || coalesce({clock('end_s')}, '?') || ' · ' || cast(floor(confidence * 100 + 0.5) as bigint) || '% · ' || sources as summary
from cand c join src s on c.video_id = s.video_id and c.cand_idx = s.cand_idx""",
    EV,
)
def _(spark, sf):
    pool = settle(fusion.candidate_pool(d.evidence(spark, sf), sources=True))
    return scoring.candidate_view(pool, fusion.pool_sources(pool)).select("video_id", "cand_idx", "view_id", "summary")


@query(
    "evidence_view",
    f"""{FUSED} select video_id, cand_idx, ev_idx, source, case
  when raw_value is not null then raw_value || coalesce(' (QR box ' || cast(box_x as bigint) || ',' || cast(box_y as bigint) || ' 80x60)', '')
  when bar_y is not null then 'Progress bar x=' || cast(bar_start as bigint) || '-' || cast(bar_end as bigint) || ' y=' || cast(bar_y as bigint) || ' rows=3'
  else raw_text end as detail from member""",
    EV,
)
def _(spark, sf):
    return scoring.evidence_view(members(spark, sf)).select("video_id", "cand_idx", "ev_idx", "source", "detail")


@query(
    "top_candidates",
    f"""{APPLIED}, shown as (select * from applied where confidence >= 0.75)
select video_id, cand_idx, cast(row_number() over w as int) as position, count(*) over (partition by video_id) as candidate_count
from shown window w as (partition by video_id order by start_s, cand_idx) qualify row_number() over w <= 5""",
    EV,
)
def _(spark, sf):
    candidate, _ = applied(spark, sf)
    out = scoring.top_candidates(settle(scoring.select_bands(candidate, MODEL)))
    return out.select("video_id", "cand_idx", "position", "candidate_count")


@query(
    "evidence_counts",
    """select video_id, count(*) filter (where source = 'transcript') as transcript,
  count(*) filter (where source = 'frame-progress-bar') as progress_bar, count(*) filter (where source = 'frame-qr-code') as qr_code,
  count(*) filter (where source = 'frame-visible-link') as visible_link, count(*) as total from d_evidence group by video_id""",
    EV,
)
def _(spark, sf):
    return scoring.evidence_counts(d.evidence(spark, sf))


_REPORT = """select 'q' || cast(event_id as string) as report_id, 'v' || cast(user_id as string) as video_id,
  case event_id % 6 when 0 then cast(event_id % 1700 as string) when 1 then cast(event_id % 29 as string) || ':' || lpad(cast(event_id % 70 as string), 2, '0')
    when 2 then '0:' || cast(event_id % 30 as string) || ':' || lpad(cast(event_id % 60 as string), 2, '0') when 3 then ' 1:20 '
    when 4 then cast(event_id % 1000 as string) || '.5' else 'soon' end as start_text,
  case event_id % 4 when 0 then cast(event_id % 1900 as string) when 1 then cast(event_id % 31 as string) || ':' || lpad(cast(event_id % 60 as string), 2, '0')
    when 2 then '29:59.25' else '1:75' end as end_text, 1800.0e0 as duration_s"""


def _code(c: str) -> str:
    t = f"trim({c})"
    n = f"len(string_split({t}, ':'))"
    p = lambda i: f"try_cast(string_split({t}, ':')[{i}] as double)"
    seconds = f"case {n} when 3 then {p(1)} * 3600 + {p(2)} * 60 + {p(3)} when 2 then {p(1)} * 60 + {p(2)} else {p(1)} end"
    fits = f"({n} = 1 or {p(-1)} < 60) and ({n} < 3 or {p(2)} < 60)"
    return f"case when regexp_full_match({t}, '(?:\\d+:){{0,2}}\\d+(?:\\.\\d+)?') and {fits} then {rnd('(' + seconds + ')', 3)} end"


PARSED = f"""parsed as (select *, {_code('start_text')} as start_s, {_code('end_text')} as end_s from ({_REPORT} from events) r),
checked as (select *, case when start_s is null or end_s is null then 'bad_timecode' when end_s <= start_s then 'end_not_after_start'
  when end_s - start_s > 600 then 'too_long' when end_s > duration_s + 1 then 'beyond_duration' end as error from parsed)"""


def report_rows(spark, sf):
    return spark.sql(_REPORT + " from {events}", events=d.table(spark, sf, "events"))


@query("parse_reports", f"with {PARSED} select report_id, video_id, start_s, end_s, error from checked")
def _(spark, sf):
    good, bad = reports.parse_reports(report_rows(spark, sf))
    cols = ["report_id", "video_id", "start_s", "end_s"]
    return good.select(*cols, F.lit(None).cast("string").alias("error")).unionByName(bad.select(*cols, "error"))


@query(
    "missed_segment_evidence",
    f"""with {PARSED} select report_id, e.video_id, e.ev_idx, e.source from checked r join d_evidence e on r.video_id = e.video_id
  and e.start_s >= r.start_s and e.start_s <= r.end_s where error is null""",
    EV,
)
def _(spark, sf):
    good, _ = reports.parse_reports(report_rows(spark, sf))
    return reports.missed_segment_evidence(good, d.evidence(spark, sf)).select("report_id", "video_id", "ev_idx", "source")


_CUE_REPORT = """cue_report as (select video_id, 'r' || cast(cue_idx as string) as report_id, start_s, start_s + 10 as end_s, 100.0e0 as duration_s from d_cue)"""


@query(
    "missed_segment_context",
    f"""with {WINDOWS}, {HITS}, {_CUE_REPORT},
said as (select r.video_id, r.report_id, nullif(trim(regexp_replace(string_agg(u.text, ' ' order by u.cue_idx), '\\s+', ' ', 'g')), '') as transcript_context
  from cue_report r join d_cue u on r.video_id = u.video_id and u.start_s + u.dur_s >= greatest(0, r.start_s - 10) and u.start_s <= r.end_s + 10 group by all),
ev as (select r.video_id, r.report_id, count(*) as n, max(confidence) as best, count(*) filter (where kind = 'ad-read-start') as starts
  from cue_report r join cue_evidence e on r.video_id = e.video_id and e.end_s >= r.start_s and e.start_s <= r.end_s group by all)
select r.video_id, r.report_id, transcript_context, coalesce(n, 0) as n_evidence, best as heuristic_confidence, cast(starts as double) as starts
from cue_report r left join said s on r.video_id = s.video_id and r.report_id = s.report_id
left join ev on r.video_id = ev.video_id and r.report_id = ev.report_id""",
    ["d_cue"],
)
def _(spark, sf):
    cue = d.cues(spark, sf)
    report = cue.select(
        "video_id", F.concat(F.lit("r"), "cue_idx").alias("report_id"), "start_s", (F.col("start_s") + 10).alias("end_s"),
        F.lit(100.0).alias("duration_s"),
    )
    out = reports.missed_segment_context(report, settle(cue_evidence(spark, sf)), cue, MODEL)
    starts = F.try_element_at("candidate_features", F.lit("transcriptStartCount"))
    return out.select("video_id", "report_id", "transcript_context", "n_evidence", "heuristic_confidence", starts.alias("starts"))


SKIP = f"""{FUSED}, skippable as (select c.* from cand c where end_s is not null and end_s - start_s between 3 and 240 and confidence >= 0.72
  and exists (select 1 from member m where m.video_id = c.video_id and m.cand_idx = c.cand_idx and m.kind = 'ad-read-end' and abs(m.start_s - c.end_s) <= 10))"""


def skippable(spark, sf):
    pool = settle(fusion.candidate_pool(d.evidence(spark, sf)))
    return scoring.skippable(pool, fusion.seen_ends(pool))


@query("skippable", f"{SKIP} select video_id, cand_idx, start_s, end_s, confidence from skippable", EV)
def _(spark, sf):
    return skippable(spark, sf).select("video_id", "cand_idx", "start_s", "end_s", "confidence")


@query(
    "skip_offers",
    f"""{SKIP} select t.session_id, t.video_id, t.pos_s as from_s, s.cand_idx, least(duration_s, end_s + 0.15e0) as to_s
from d_tick t join skippable s on t.video_id = s.video_id and t.pos_s >= s.start_s and t.pos_s < s.end_s
where is_playing and least(duration_s, end_s + 0.15e0) - t.pos_s >= 1.25e0""",
    ["d_evidence", "d_tick"],
)
def _(spark, sf):
    out = playback.offers(d.ticks(spark, sf), skippable(spark, sf))
    return out.select("session_id", "video_id", "from_s", "cand_idx", "to_s")


# ---- evaluation ----------------------------------------------------------------------

_CASES = """bench_case as (select video_id as case_id, max(start_s) + 60.0e0 as duration_s from d_cue group by video_id),
expected as (select video_id as case_id, cast(cue_idx as int) as exp_idx, start_s + cue_idx % 3 as start_s, start_s + 20 + cue_idx * 4 as end_s
  from d_cue where cue_idx % 3 = 0 and strlen(video_id) % 2 = 0)"""


def cases(spark, sf):
    cue = d.cues(spark, sf)
    bench = cue.groupBy(F.col("video_id").alias("case_id")).agg((F.max("start_s") + 60.0).alias("duration_s"))
    expected = cue.filter("cue_idx % 3 = 0 and length(video_id) % 2 = 0").select(
        F.col("video_id").alias("case_id"), F.col("cue_idx").alias("exp_idx"),
        (F.col("start_s") + F.col("cue_idx") % 3).alias("start_s"), (F.col("start_s") + 20 + F.col("cue_idx") * 4).alias("end_s"),
    )
    return bench, expected


def detected_cases(spark, sf):
    found = evaluation.case_candidates(d.cues(spark, sf), None, phrase_column())
    return found.withColumnRenamed("video_id", "case_id").select("case_id", "cand_idx", "start_s", "end_s")


_DETECTED = f"""{_CUE_ITEMS}, {_CASES}, det as (select video_id as case_id, cand_idx, start_s, end_s from cand where confidence >= 0.4),
raw_pair as (
  select e.case_id, exp_idx, cand_idx, d.start_s as det_s, abs(d.start_s - e.start_s) as start_error, abs(d.end_s - e.end_s) as end_error,
    case when d.end_s is null then 0.0e0 else greatest(0, least(e.end_s, d.end_s) - greatest(e.start_s, d.start_s))
      / (greatest(e.end_s, d.end_s) - least(e.start_s, d.start_s)) end as iou, d.end_s is null as is_open
  from expected e join det d on e.case_id = d.case_id
), pair as (
  select *, case when is_open then 0.1e0 * (1 - start_error / 12.0e0) else iou end as score from raw_pair
  where case when is_open then start_error <= 12 else iou >= 0.3 end
)"""
_MATCHED = f"""{_DETECTED}, ranked as (
  select *, row_number() over (partition by case_id order by score desc, start_error, coalesce(end_error, 1e300), exp_idx, det_s, cand_idx) as r from pair
), walk as (
  select case_id, cast(0 as bigint) as r, cast([] as bigint[]) as used_e, cast([] as bigint[]) as used_d, false as picked from (select distinct case_id from ranked)
  union all
  select w.case_id, k.r, case when free then list_append(used_e, cast(exp_idx as bigint)) else used_e end,
    case when free then list_append(used_d, cast(cand_idx as bigint)) else used_d end, free
  from walk w join ranked k on w.case_id = k.case_id and k.r = w.r + 1,
    lateral (select not list_contains(used_e, cast(exp_idx as bigint)) and not list_contains(used_d, cast(cand_idx as bigint)) as free) f
), matched as (
  select k.case_id, exp_idx, cand_idx, {rnd('iou', 4)} as iou, {rnd('start_error', 4)} as start_error, {rnd('end_error', 4)} as end_error
  from walk w join ranked k on w.case_id = k.case_id and w.r = k.r where picked
)"""
_OUTCOME = f"""{_MATCHED}, outcome as (
  select c.case_id, c.duration_s, coalesce(e.n, 0) as n_expected, coalesce(t.n, 0) as n_detected, coalesce(m.n, 0) as n_matched
  from bench_case c left join (select case_id, count(*) n from expected group by 1) e on c.case_id = e.case_id
  left join (select case_id, count(*) n from det group by 1) t on c.case_id = t.case_id
  left join (select case_id, count(*) n from matched group by 1) m on c.case_id = m.case_id
)"""
_P = "(case when sum(n_detected) = 0 then 1.0e0 else sum(n_matched) / cast(sum(n_detected) as double) end)"
_R = "(case when sum(n_expected) = 0 then 1.0e0 else sum(n_matched) / cast(sum(n_expected) as double) end)"
_METRIC = f"""{_OUTCOME}, o as (
  select count(*) as cases, count(*) filter (where n_expected = 0) as negative_cases,
    cast(sum(n_expected) as bigint) as expected_segments, cast(sum(n_detected) as bigint) as detected_segments, cast(sum(n_matched) as bigint) as matched_segments,
    {_P} as p, {_R} as r, count(*) filter (where n_expected = 0 and n_detected = 0) as clean, sum(duration_s) as total_s
  from outcome
), m as (
  select count(*) as n, count(end_error) as closed, sum(start_error) as s, sum(end_error) as e,
    sum(start_error) filter (where end_error is not null) as cs from matched
), metric as (select cases, cases - negative_cases as positive_cases, negative_cases, expected_segments, detected_segments, matched_segments,
  expected_segments - matched_segments as misses, detected_segments - matched_segments as false_positives,
  {rnd('p', 4)} as "precision", {rnd('r', 4)} as recall, {rnd('(case when p + r = 0 then 0.0e0 else 2 * p * r / (p + r) end)', 4)} as f1,
  {rnd('(case when negative_cases = 0 then 1.0e0 else clean / cast(negative_cases as double) end)', 4)} as negative_case_accuracy,
  {rnd('((detected_segments - matched_segments) * 3600.0e0 / total_s)', 4)} as false_positives_per_hour,
  {rnd('(case when matched_segments = 0 then 1.0e0 else closed / cast(matched_segments as double) end)', 4)} as closed_boundary_rate,
  {rnd('(s / n)', 4)} as start_mae_s, {rnd('(e / closed)', 4)} as end_mae_s, {rnd('((cs + e) / (2 * closed))', 4)} as boundary_mae_s from o, m)"""


def benchmark(spark, sf):
    bench, expected = cases(spark, sf)
    return evaluation.run_benchmark(bench, expected, d.cues(spark, sf), None, phrase_column())


@query(
    "validate_cases",
    f"""with {_CASES}, bad as (select distinct e.case_id from expected e join bench_case c on e.case_id = c.case_id where e.end_s > c.duration_s)
select case_id, case when case_id in (select case_id from bad) then 'Case contains an invalid expected segment.' end as error from bench_case""",
    ["d_cue"],
)
def _(spark, sf):
    good, bad = evaluation.validate_cases(*cases(spark, sf))
    return good.select("case_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("case_id", "error"))


@query("pair_segments", f"with {_DETECTED} select case_id, exp_idx, cand_idx, {rnd('iou', 6)} as iou, start_error, end_error from pair", ["d_cue"])
def _(spark, sf):
    from ..functions.numbers import js_round

    pairs = evaluation.pair_segments(cases(spark, sf)[1], detected_cases(spark, sf))
    return pairs.select("case_id", "exp_idx", "cand_idx", js_round(F.col("iou"), 6).alias("iou"), "start_error", "end_error")


@query("match_segments", f"with recursive {_MATCHED} select case_id, cast(exp_idx as bigint) as exp_idx, cand_idx, iou, start_error, end_error from matched", ["d_cue"])
def _(spark, sf):
    return evaluation.match_segments(evaluation.pair_segments(cases(spark, sf)[1], detected_cases(spark, sf)))


_VALID = "expected as (select video_id as case_id"


def _valid_only(sql: str) -> str:
    """The benchmark run leaves out invalid cases."""
    return sql.replace(
        "det as (select video_id as case_id, cand_idx, start_s, end_s from cand where confidence >= 0.4)",
        "bad_case as (select distinct e.case_id from expected_all e join bench_all c on e.case_id = c.case_id where e.end_s > c.duration_s), "
        "bench_case as (select * from bench_all where case_id not in (select case_id from bad_case)), "
        "expected as (select * from expected_all where case_id not in (select case_id from bad_case)), "
        "det as (select video_id as case_id, cand_idx, start_s, end_s from cand where confidence >= 0.4 and video_id not in (select case_id from bad_case))",
    ).replace("bench_case as (select video_id", "bench_all as (select video_id").replace(_VALID, _VALID.replace("expected", "expected_all"))


@query(
    "case_outcomes",
    _valid_only(f"with recursive {_OUTCOME} select case_id, n_expected, n_detected, n_matched, n_expected - n_matched as misses, n_detected - n_matched as false_positives from outcome"),
    ["d_cue"],
)
def _(spark, sf):
    return benchmark(spark, sf)["outcomes"].drop("duration_s")


@query("benchmark_metrics", _valid_only(f"with recursive {_METRIC} select * from metric"), ["d_cue"])
def _(spark, sf):
    return benchmark(spark, sf)["metrics"]


_GATE_SQL = " union all ".join(
    f"select {i} as gate_ord, '{name}' as metric from metric where \"{name}\" {'<' if side == 'min' else '>'} {evaluation.GATES[name]}e0"
    for i, (name, _, side, _) in enumerate(evaluation.GATE_LABELS)
)


@query("benchmark_gates", _valid_only(f"with recursive {_METRIC} {_GATE_SQL}"), ["d_cue"])
def _(spark, sf):
    return evaluation.benchmark_gates(benchmark(spark, sf)["metrics"]).select("gate_ord", "metric")


def _pct(x: str) -> str:
    return f"cast(cast({rnd(f'({x} * 100)', 1)} as decimal(28,1)) as varchar) || '%'"


def _short(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast(cast({rnd(x, 2)} as decimal(28,2)) as varchar) end"


@query(
    "benchmark_report",
    _valid_only(
        f"""with recursive {_METRIC}, head as (select unnest(['Segment detection benchmark',
  cases || ' cases · ' || expected_segments || ' expected · ' || detected_segments || ' detected',
  'precision ' || {_pct('"precision"')} || ' · recall ' || {_pct('recall')} || ' · F1 ' || {_pct('f1')},
  'negative accuracy ' || {_pct('negative_case_accuracy')} || ' · false positives/hour ' || {_short('false_positives_per_hour')},
  'closed boundaries ' || {_pct('closed_boundary_rate')} || ' · boundary MAE ' || coalesce({_short('boundary_mae_s')} || 's', 'n/a')]) as line,
  unnest(['0', '1', '2', '3', '4']) as line_key from metric)
select 0 as section, line_key, line from head
union all select 1, case_id, case when n_expected = n_matched and n_detected = n_matched then 'PASS ' else 'FAIL ' end || case_id || ': expected ' || n_expected
  || ', detected ' || n_detected || ', matched ' || n_matched from outcome"""
    ),
    ["d_cue"],
)
def _(spark, sf):
    run = benchmark(spark, sf)
    return evaluation.benchmark_report(run["metrics"], run["outcomes"])


@query(
    "source_detection_quality",
    f"""{FUSED}, e as (select distinct video_id as case_id, source from d_evidence),
t as (select distinct m.video_id as case_id, m.source from member m join cand c on m.video_id = c.video_id and m.cand_idx = c.cand_idx where c.confidence >= 0.9),
q as (select coalesce(e.source, t.source) as source, count(e.case_id) as n_expected, count(*) filter (where e.case_id is not null and t.case_id is not null) as n_detected,
  count(*) filter (where t.case_id is null) as n_missed, count(*) filter (where e.case_id is null) as n_false_positive
  from e full join t on e.case_id = t.case_id and e.source = t.source group by 1)
select *, {rnd('(n_detected / cast(n_expected as double))', 3)} as recall,
  {rnd('(case when n_detected + n_false_positive = 0 then 1.0e0 else n_detected / cast(n_detected + n_false_positive as double) end)', 3)} as "precision" from q""",
    EV,
)
def _(spark, sf):
    """Which sources of a video's evidence are found again in its sure candidates."""
    candidate, member = candidates_and_members(spark, sf)
    sure = member.join(candidate.filter("confidence >= 0.9").select("video_id", "cand_idx"), ["video_id", "cand_idx"], "left_semi")
    of_case = [F.col("video_id").alias("case_id"), "source"]
    return evaluation.source_detection_quality(d.evidence(spark, sf).select(*of_case), sure.select(*of_case))
