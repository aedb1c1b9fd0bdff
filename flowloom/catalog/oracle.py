"""SQL that computes the result of each registered query independently, for DuckDB.

Only the inputs (the flow views and the constants of the test fixtures) are shared with the Spark
side. Order keys, splits, routes, votes, attributions and texts are written out anew.
"""

from __future__ import annotations

from flowloom import fixed_values as fv
from flowloom import fixtures
from flowloom.schema import AGENTS as DETECTORS
from flowloom.schema import ALL_CLASSES, CANONICAL, POSITION, V1

ORACLE: dict[str, str] = {}

VIEW = [*V1, *fixtures.VIEW_V2_FEATURES]
_cols = ", ".join(fixtures.select_list(fixtures.FLOW_COLUMNS))
FLOWS = f"flows as (select *, {fixtures.LABEL_SQL} as Label from (select {_cols} from lineitem))"
_event_cols = ", ".join(fixtures.select_list(fixtures.EVENT_FLOW_COLUMNS))
EVENTS = f"event_flows as (select *, {fixtures.LABEL_SQL} as Label from (select {_event_cols} from events))"


def text(value) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def number(value: float) -> str:
    return f"{value!r}::double"


def values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(r) + ')' for r in rows)})"


ALIASES = values("aliases", "word, class", [(text(w), text(c)) for w, c in fv.CLASS_ALIASES.items()])
CLASSES = values(
    "classes",
    "version, class, id",
    [("'v1'", text(c), str(i)) for c, i in fv.V1_CLASS_IDS.items()]
    + [("'v2'", text(c), str(i)) for c, i in fv.V2_CLASS_IDS.items()],
)


def _known(version: str) -> str:
    known = {"v1": list(fv.V1_CLASS_IDS), "v2": list(fv.V2_CLASS_IDS)}.get(version, [*ALL_CLASSES, "Unknown"])
    return "[" + ", ".join(map(text, known)) + "]"


AGENTS = values(
    "agents",
    "idx, agent, version, model_type, width, known",
    [
        (str(i), text(n), text(v), text(m), "39" if v == "v2" else "8", _known(v))
        for i, (n, v, m) in enumerate(fv.AGENT_ROWS, 1)
    ],
)
FEATURES = values("features", "pos, name, since", [
    (str(i), text(f), "'v1'" if f in V1 else "'v2'") for i, f in enumerate(CANONICAL)
])

PRESENT = " + ".join(f"({f} is not null)::int" for f in V1)
_filled = ", ".join(f"coalesce({f}, 0.0::double) as {f}" for f in VIEW)
NAMED = f"""named as (
  select flow_id, request_id, dataset_version, attack_hint, Attack, Label, {_filled}, {PRESENT} as present,
    case when attack_hint is null or attack_hint = '' then 'Unknown' else coalesce(a.class, attack_hint) end as norm
  from flows left join aliases a on lower(attack_hint) = a.word)"""

# (condition, confidence if it holds, confidence if not) in the order of the detectors
SCORERS = (
    ("IN_PKTS <= 4", 0.9375, 0.75),
    ("IN_PKTS <= 4 or IN_PKTS >= 49", 0.96875, 0.625),
    ("OUT_BYTES < 256", 0.5, 0.375),
    ("LONGEST_FLOW_PKT >= 1024", 0.625, 0.25),
    ("IN_BYTES > 90000", 0.875, 0.6875),
    ("TCP_FLAGS >= 31", 0.8125, 0.5625),
    ("OUT_PKTS > 32", 1.0, 0.125),
)
_prediction = "case idx " + " ".join(f"when {i} then ({c})::int" for i, (c, _, _) in enumerate(SCORERS, 1)) + " end"
_confidence = (
    "case idx "
    + " ".join(f"when {i} then case when {c} then {number(y)} else {number(n)} end" for i, (c, y, n) in enumerate(SCORERS, 1))
    + " end"
)
ALLOWED = "(attack_hint is null or attack_hint = '' or list_contains(known, norm))"
VOTES = f"""votes as (
  select n.*, idx, agent, {_prediction} as prediction, {_confidence} as confidence
  from named n join agents on present >= 6.4 and {ALLOWED})"""


def tally(votes: str, key: str, name: str = "tally") -> str:
    good = "prediction in (0, 1) and isfinite(confidence)"
    return f"""{name} as (
  select {key},
    coalesce(sum(confidence) filter (where {good} and prediction = 0), 0.0::double) as b,
    coalesce(sum(confidence) filter (where {good} and prediction = 1), 0.0::double) as a,
    count(*) filter (where {good} and prediction = 0) as nb,
    count(*) filter (where {good} and prediction = 1) as na
  from {votes} group by {key})"""


OUTCOME = """case when coalesce(na + nb, 0) = 0 then 'unknown' when a > b then 'anomaly' else 'benign' end as prediction,
    case when coalesce(na + nb, 0) = 0 then 0.0::double when a > b then a / na when nb > 0 then b / nb
      when a + b > 0 then greatest(a, b) / (a + b) else 0.0::double end as confidence,
    coalesce(b, 0.0::double) as vote_benign, coalesce(a, 0.0::double) as vote_anomaly"""
DECIDED = f"""decided as (
  select n.*, {OUTCOME} from named n left join tally using (flow_id))"""

BASE = [FLOWS, ALIASES, AGENTS, NAMED, VOTES]
DECISIONS = [*BASE, tally("votes", "flow_id"), DECIDED]
DETECTED = "case prediction when 'anomaly' then attack_hint when 'benign' then 'Benign' end"
SPOILT = f"""spoilt as (
  select flow_id, agent, {fixtures.SPOILT_PREDICTION} as prediction, {fixtures.SPOILT_CONFIDENCE} as confidence
  from votes)"""


def oracle(name: str, ctes, select: str) -> None:
    ORACLE[name] = f"with {', '.join(ctes)} {select}"


V1_LIST = ", ".join(V1)
COMPLETE = " and ".join(f"{f} is not null" for f in V1)
KEY = f"md5('{fv.SEED}|' || flow_id)"


def split(source: str, strata: str = "Label", share: float = fv.TEST_SHARE) -> list[str]:
    """CTEs that add an exact stratified split to a source; the last is ``split_rows``."""
    return [
        f"sizes as (select {strata} as s, count(*) as n, sum(count(*)) over () as total from {source} group by 1)",
        f"""parts as (select s, n, total, ceil(total * {number(share)})::bigint as tests,
              (ceil(total * {number(share)})::bigint * n) // total as base,
              (ceil(total * {number(share)})::bigint * n) % total as rest from sizes)""",
        """quotas as (select s, base + case when row_number() over (order by rest desc, s)
              <= tests - sum(base) over () then 1 else 0 end as quota from parts)""",
        f"""split_rows as (select r.* exclude (rn), case when rn <= quota then 'test' else 'train' end as split
              from (select *, row_number() over (partition by {strata} order by {KEY}) as rn from {source}) r
              join quotas on {strata} = s)""",
    ]


def scaled(source: str, fit: str, features, keep: str) -> list[str]:
    bounds = ", ".join(f"min({f}) as lo_{f}, max({f}) as hi_{f}" for f in features)
    cells = ", ".join(
        f"case when hi_{f} = lo_{f} then case when {f} is not null then 0.0::double end "
        f"else ({f} - lo_{f}) / (hi_{f} - lo_{f}) end as {f}"
        for f in features
    )
    return [
        f"bounds as (select {bounds} from {source} where {fit})",
        f"scaled_rows as (select {keep}, {cells} from {source}, bounds)",
    ]


# --- sources and sinks ---------------------------------------------------------------------------
RAW = f"IPV4_SRC_ADDR, L4_SRC_PORT, IPV4_DST_ADDR, L4_DST_PORT, {V1_LIST}, Attack, Label"
oracle("q_s1_csv_source", [FLOWS], f"select flow_id, {RAW} from flows")
ORACLE["q_s2_first_rows"] = (
    f"with numbered as (select *, row_number() over () as place from lineitem), "
    f"flows as (select {_cols}, place from numbered) select flow_id, IN_BYTES, Attack from flows where place <= 5000"
)
_line_flows = (
    f"lines as (select *, {fixtures.LABEL_SQL} as Label from (select {_cols}, l_linenumber as line from lineitem))"
)
_asked = """asked as (
  select *, unnest(range(line % 3)) as pos, false as broken from lines where line <> 7
  union all select *, 0, true from lines where line = 7)"""
oracle(
    "q_s3_requests",
    [_line_flows, _asked],
    """select flow_id, pos::int as pos, case when broken then 'v1' else dataset_version end as dataset_version,
       case when not broken then attack_hint end as attack_type,
       case when not broken then IN_PKTS + pos end as IN_PKTS from asked""",
)
_given = {f: f"case when not broken then {f}{' + pos' if f == 'IN_PKTS' else ''} end" for f in V1}
_lacking = ", ".join(f"case when ({v}) is null then '{f}' end" for f, v in _given.items())
oracle(
    "q_s4_validate",
    [_line_flows, _asked],
    f"""select flow_id, pos::int as pos, {', '.join(f'{v} as {f}' for f, v in _given.items())},
        case when broken then 0.0::double else coalesce(MIN_TTL, 0.0::double) end as MIN_TTL, 0.0::double as SERVER_TCP_FLAGS,
        concat_ws(',', {_lacking}) as missing,
        case when not broken and {COMPLETE} then 'valid' else 'quarantine' end as status from asked""",
)
_complete = f"complete as (select flow_id, {V1_LIST}, Attack, Label from flows where {COMPLETE})"
oracle("q_s5_test_classes", [FLOWS, _complete, *split("complete")], "select flow_id, Attack from split_rows where split = 'test'")

# --- projection, filter, cleansing ---------------------------------------------------------------
oracle("q_p1_drop_incomplete", [FLOWS], f"select flow_id, {V1_LIST}, Attack, Label from flows where {COMPLETE}")
oracle("q_p2_features_label", [FLOWS], f"select flow_id, {V1_LIST}, Label from flows")
oracle("q_p3_features_attack", [FLOWS], f"select flow_id, {V1_LIST}, Attack, Label from flows")
_wide = ", ".join(f"coalesce({f}, 0.0::double) as {f}" if f in VIEW else f"0.0::double as {f}" for f in CANONICAL)
oracle("q_p4_canonical", [FLOWS], f"select flow_id, {_wide} from flows")
_in_order = sorted(VIEW, key=POSITION.__getitem__)
_there = ", ".join(f"case when {f} is not null then '{f}' end" for f in _in_order)
oracle(
    "q_p5_available_features",
    [FLOWS],
    f"select flow_id, concat_ws(',', {_there}) as available from flows",
)
_mask = " || ".join(f"case when {f} is not null then '1' else '0' end" if f in VIEW else "'0'" for f in CANONICAL)
oracle("q_p6_feature_mask", [FLOWS], f"select flow_id, {_mask} as mask from flows")
_count = " + ".join(f"({f} is not null)::int" for f in VIEW)
oracle("q_p7_feature_counts", [FLOWS], f"select flow_id, {_count} as available, 39 - ({_count}) as missing from flows")
oracle(
    "q_p8_common_features",
    [FLOWS],
    " union all ".join(
        f"select '{f}' as feature, count({f}) filter (where dataset_version = 'v1') as v1_values, "
        f"count({f}) filter (where dataset_version = 'v2') as v2_values from flows"
        for f in V1
    ),
)
oracle("q_p9_tag_version", [FLOWS], "select flow_id, dataset_version, Attack from flows")
oracle(
    "q_p10_agent_slices",
    [FLOWS, f"canon as (select flow_id, {_wide} from flows)"],
    "select flow_id, 8 as narrow_size, 39 as wide_size, "
    + ", ".join(f"{f} as narrow_{i}" for i, f in enumerate(V1))
    + ", "
    + ", ".join(f"{CANONICAL[i]} as wide_{i}" for i in (0, 7, 12, 13, 14, 21, 33, 38))
    + " from canon",
)
oracle("q_p11_class_filter", [FLOWS], "select flow_id, Attack, IN_BYTES from flows where lower(Attack) = 'benign'")
oracle(
    "q_p12_valid_votes",
    [*BASE, SPOILT],
    "select * from spoilt where prediction in (0, 1) and not isnan(confidence) and not isinf(confidence)",
)
oracle(
    "q_p13_finite",
    [*BASE, SPOILT],
    "select flow_id, agent, case when isfinite(confidence) then confidence else 0.0::double end as confidence from spoilt",
)

# --- taxonomy -------------------------------------------------------------------------------------
_names = f"""names as (
  select flow_id, dataset_version, Attack,
    case when attack_hint is null or attack_hint = '' then 'Unknown' else coalesce(h.class, attack_hint) end as hinted_class,
    coalesce(k.class, upper(Attack)) as attack_class
  from flows left join aliases h on lower(attack_hint) = h.word left join aliases k on lower(Attack) = k.word)"""
oracle("q_t1_normalize", [FLOWS, ALIASES, _names], "select flow_id, hinted_class, attack_class from names")
_ids = """named_ids as (
  select n.*, h.id as hid, k.id as kid from names n
  left join classes h on h.version = n.dataset_version and h.class = n.hinted_class
  left join classes k on k.version = n.dataset_version and k.class = n.attack_class)"""
oracle(
    "q_t2_attack_id",
    [FLOWS, ALIASES, CLASSES, _names, _ids],
    "select flow_id, coalesce(hid, -1) as hint_id, coalesce(kid, -1) as attack_id from named_ids",
)
oracle(
    "q_t3_known_attack",
    [FLOWS, ALIASES, CLASSES, _names, _ids],
    "select flow_id, hid is not null as hint_known, kid is not null as attack_known from named_ids",
)
oracle(
    "q_t4_all_classes",
    [FLOWS, ALIASES, CLASSES],
    """select c.class as attack_class, count(flow_id) as flows from (select distinct class from classes) c
       left join (select flow_id, coalesce(a.class, Attack) as k from flows left join aliases a on lower(Attack) = a.word)
       on k = c.class group by 1""",
)
_rare = ", ".join(map(text, fv.RARE_CLASSES))
_common = ", ".join(map(text, fv.COMMON_CLASSES))
GROUP = f"""case when lower(Attack) in ({_rare}) then 'rare' when lower(Attack) in ({_common}) then 'common'
  when lower(Attack) = 'benign' then 'benign' else 'other' end"""


def cap(other: int = 0) -> str:
    return f"case {GROUP} when 'rare' then 5000 when 'common' then 2000 when 'benign' then 5000 else {other} end"


oracle("q_t5_sampling_group", [FLOWS], f"select flow_id, {GROUP} as sampling_group, {cap()} as cap from flows")

# --- routing ----------------------------------------------------------------------------------------
oracle(
    "q_j1_agent_catalogue",
    [FLOWS, AGENTS],
    """select agent, version as dataset_version, model_type, width as feature_count, 8 as required,
       array_to_string(list_sort(known), ',') as known_attacks,
       (select count(*) from flows where version = 'both' or flows.dataset_version = version) as version_flows
       from agents""",
)
oracle(
    "q_j2_feature_catalogue",
    [FLOWS, FEATURES, "counts as (" + " union all ".join(f"select '{f}' as f, count({f}) as n from flows" for f in VIEW) + ")"],
    "select pos, name, since as since_version, coalesce(n, 0) as flows from features left join counts on f = name",
)
oracle("q_j3_feature_overlap", BASE, "select flow_id, agent from named, agents where present >= 7")
oracle("q_j4_attack_aware", BASE, f"select flow_id, agent from named, agents where present >= 7 and {ALLOWED}")
_lists = f"""lists as (
  select flow_id,
    coalesce(string_agg(agent, ',' order by idx) filter (where ok), '') as participating,
    coalesce(string_agg(agent, ',' order by idx) filter (where not ok), '') as abstaining,
    coalesce(string_agg(agent, ',' order by idx) filter (where not ok and model_type <> 'lstm'), '') as abstaining_loaded
  from (select *, present >= 7 and {ALLOWED} as ok from named, agents) group by flow_id)"""
oracle("q_j5_participating", [*BASE, _lists], "select flow_id, participating from lists")
oracle(
    "q_j5_one_agent",
    BASE,
    f"select flow_id, attack_hint from named, agents where idx = 1 and present >= 7 and {ALLOWED}",
)
oracle("q_j6_abstaining", [*BASE, _lists], "select flow_id, abstaining, abstaining_loaded from lists")
oracle(
    "q_j7_can_classify",
    BASE,
    """select norm as attack_class, count(*) as flows, agent, list_contains(any_value(known), norm) as known
       from named, agents group by norm, agent""",
)
oracle("q_j8_routing_summary", BASE, "select attack_hint, agent, count(*) as flows from votes group by 1, 2")

# --- sampling, splitting, scaling -------------------------------------------------------------------
oracle("q_m1_union", [FLOWS], "select flow_id, IN_BYTES, MIN_TTL, coalesce(MAX_TTL, 0.0::double) as MAX_TTL, Attack from flows")
oracle(
    "q_m2_ratio_sample",
    [FLOWS],
    f"""select flow_id, dataset_version, Attack from (
         select *, row_number() over (partition by dataset_version order by {KEY}) as rn,
           count(*) over (partition by dataset_version) as n from flows)
       where rn <= floor(n * case dataset_version when 'v1' then 0.25::double else 0.75::double end)""",
)
_v2_complete = " and ".join(f"{f} is not null" for f in VIEW)
_both = f"""both_complete as (select * from flows where {COMPLETE} and (dataset_version = 'v1' or {_v2_complete}))"""
_mixed = f"""mixed as (
  select flow_id, {V1_LIST}, Attack, Label, dataset_version from (
    select *, row_number() over (partition by dataset_version order by {KEY}) as rn,
      count(*) over (partition by dataset_version) as n from both_complete)
  where rn <= floor(n * case dataset_version when 'v1' then 0.375::double else 0.625::double end))"""
oracle(
    "q_m3_mix",
    [FLOWS, _both, _mixed, *split("mixed"), *scaled("split_rows", "split = 'train'", V1, "flow_id, Attack, Label, dataset_version, split")],
    "select * from scaled_rows",
)


def capped(source: str, other: int = 0) -> str:
    return f"""capped as (select * exclude (rn) from (
      select *, row_number() over (partition by lower(Attack) order by {KEY}) as rn from {source}) where rn <= {cap(other)})"""


oracle("q_m4_class_capped", [FLOWS, capped("flows")], "select flow_id, Attack, IN_BYTES from capped")
oracle("q_m4_other_classes", [FLOWS, capped("flows", 100)], "select flow_id, Attack, IN_BYTES from capped")
oracle("q_m5_size_cap", [FLOWS], f"select flow_id, Attack, IN_BYTES from flows order by {KEY} limit 5000")
oracle(
    "q_m5_smart_sample",
    [FLOWS, _both, capped("both_complete")],
    f"""select flow_id, Attack, Label, {V1_LIST}, coalesce(MIN_TTL, 0.0::double) as MIN_TTL, 0.0::double as DNS_QUERY_ID
        from capped order by {KEY} limit 8000""",
)
oracle("q_m6_shuffle", [FLOWS], f"select flow_id, Attack, {KEY} as order_key from flows")
oracle("q_m7_stratified_split", [FLOWS, *split("flows")], "select flow_id, Attack, Label, split from split_rows")
oracle(
    "q_m7_split_by_class", [FLOWS, *split("flows", "Attack", 0.3)], "select flow_id, Attack, Label, split from split_rows"
)
oracle(
    "q_m8_quick_split",
    [FLOWS],
    f"""select flow_id, Label, case when ('0x' || substr({KEY}, 1, 8))::bigint / 4294967296::double < 0.2::double
        then 'test' else 'train' end as split from flows""",
)
_canon = f"canon as (select flow_id, dataset_version, Label, {_wide} from flows)"
oracle(
    "q_m9_fit_bounds",
    [FLOWS, _canon, *split("canon")],
    " union all ".join(
        f"select '{f}' as feature, min({f}) as low, max({f}) as high from split_rows where split = 'train'"
        for f in CANONICAL
    ),
)
oracle(
    "q_m10_scale",
    [FLOWS, _canon, *split("canon"), *scaled("split_rows", "split = 'train'", VIEW, "flow_id")],
    "select * from scaled_rows",
)
oracle(
    "q_m11_prepare",
    [FLOWS, _complete, *split("complete"), *scaled("split_rows", "split = 'train'", V1, "flow_id, Attack, Label, split")],
    "select * from scaled_rows",
)

# --- aggregation --------------------------------------------------------------------------------------
_sums = """count(*) as total, count(*) filter (where Label = 0) as benign, count(*) filter (where Label = 1) as malicious,
  array_to_string(list_sort(list_distinct(list(Attack))), ',') as classes"""
oracle("q_a1_profile", [FLOWS], f"select {_sums} from flows")
oracle(
    "q_a2_class_distribution",
    [FLOWS],
    """select Attack, count(*) as flows, count(*)::double / (select count(*) from flows)::double * 100 as percent
       from flows group by 1""",
)
oracle(
    "q_a3_version_profile",
    [FLOWS],
    f"""select dataset_version, {_sums}, count(*)::double / (select count(*) from flows)::double * 100 as percent
        from flows group by 1""",
)
oracle("q_a4_distinct_classes", [FLOWS], "select distinct lower(Attack) as attack_class from flows")
_matrix = """count(*) filter (where prediction = 1 and Label = 1) as tp, count(*) filter (where prediction = 1 and Label = 0) as fp,
  count(*) filter (where prediction = 0 and Label = 0) as tn, count(*) filter (where prediction = 0 and Label = 1) as fn"""
_confusion = f"confusion as (select agent, {_matrix} from votes group by 1)"
oracle("q_a5_confusion", [*BASE, _confusion], "select * from confusion")
_quality = """case when tp + fp + tn + fn = 0 then 0.0::double else (tp + tn)::double / (tp + fp + tn + fn)::double end as accuracy,
  case when tp + fp = 0 then 0.0::double else tp::double / (tp + fp)::double end as precision,
  case when tp + fn = 0 then 0.0::double else tp::double / (tp + fn)::double end as recall,
  case when 2 * tp + fp + fn = 0 then 0.0::double else (2 * tp)::double / (2 * tp + fp + fn)::double end as f1_score"""
oracle("q_s7_report", [*BASE, _confusion], f"select agent, {_quality} from confusion")
_judged = """judged as (
  select Attack, Label, case prediction when 'anomaly' then 1 when 'benign' then 0 end as prediction from decided)"""
oracle(
    "q_a6_quality",
    [*DECISIONS, _judged, _confusion],
    f"""select *, {_quality} from
        (select * from confusion union all select 'ensemble', {_matrix} from judged)""",
)
oracle(
    "q_a7_detection_rate",
    [*DECISIONS, _judged],
    """select Attack, count(*) as flows, count(*) filter (where prediction = Label) as "right",
       (count(*) filter (where prediction = Label))::double / count(*)::double as detection_rate from judged group by 1""",
)

# --- scoring --------------------------------------------------------------------------------------------
_steps = " + ".join(f"({f} - floor({f} / 16) * 16.0::double) * ({f} - floor({f} / 16) * 16.0::double)" for f in V1)
_errors = f"errors as (select flow_id, Attack, ({_steps}) / 8.0::double as error from named)"
oracle(
    "q_l5_threshold",
    [FLOWS, ALIASES, NAMED, _errors],
    "select quantile_disc(error, 0.95) as threshold from errors where Attack = 'Benign'",
)
oracle(
    "q_e2_default_confidence",
    BASE,
    "select flow_id, agent, case when TCP_FLAGS >= 16 then confidence else 0.8::double end as confidence from votes",
)
oracle(
    "q_e3_neural_score",
    [FLOWS],
    """select flow_id, (p > 0.5)::int as prediction, abs(p - 0.5::double) * 2 as confidence
       from (select flow_id, (IN_BYTES % 1024) / 1024::double as p from flows)""",
)
oracle(
    "q_e4_reconstruction_score",
    [FLOWS, ALIASES, NAMED, _errors],
    """select flow_id, error, (error > 64)::int as prediction, least(abs(error - 64) / 64::double, 1.0::double) as confidence
       from errors""",
)
oracle(
    "q_e5_missing_models",
    [*BASE, "few as (select * from votes where idx not in (3, 4))", tally("few", "flow_id"), DECIDED],
    """select flow_id, null::int as agent_4_lstm_v2__prediction, 0.0::double as agent_4_lstm_v2__confidence,
       prediction, confidence from decided""",
)
oracle(
    "q_e6_rule_scores",
    [FLOWS, ALIASES, NAMED],
    "select flow_id, "
    + ", ".join(
        f"({c})::int as {n}__prediction, case when {c} then {number(y)} else {number(o)} end as {n}__confidence"
        for (n, _, _), (c, y, o) in zip(fv.AGENT_ROWS, SCORERS)
    )
    + " from named",
)
oracle("q_e7_votes", BASE, "select flow_id, agent, prediction, confidence from votes")
oracle("q_e8_vote", DECISIONS, "select flow_id, prediction, confidence, vote_benign, vote_anomaly from decided")
oracle("q_e8_vote_long", [*BASE, SPOILT, tally("spoilt", "flow_id")], f"select flow_id, {OUTCOME} from tally")
_sides = {
    side: " + ".join(f"case when p{i} = {p} then c{i} else 0.0::double end" for i in range(1, 8))
    for side, p in (("b", 0), ("a", 1))
}
oracle(
    "q_e9_collapse",
    [
        *BASE,
        "requests as (select request_id, "
        + ", ".join(
            f"arg_min(prediction, flow_id) filter (where idx = {i}) as p{i}, avg(confidence) filter (where idx = {i}) as c{i}"
            for i in range(1, 8)
        )
        + " from votes group by 1)",
        f"tally as (select request_id, {_sides['b']} as b, {_sides['a']} as a, "
        + ", ".join(f"{' + '.join(f'coalesce((p{i} = {p})::int, 0)' for i in range(1, 8))} as {n}" for n, p in (("nb", 0), ("na", 1)))
        + " from requests)",
    ],
    f"select request_id, {OUTCOME} from (select distinct request_id from flows) left join tally using (request_id)",
)
_ballots = "ballots as (select flow_id, string_agg(agent || '=' || prediction, ',' order by idx) as ballots from votes group by 1)"
oracle(
    "q_e10_result_record",
    [*DECISIONS, _lists, _ballots],
    """select flow_id, prediction, confidence, participating as participating_agents, abstaining as abstaining_agents,
       coalesce(ballots, '') as ballots, vote_benign, vote_anomaly,
       case when participating = '' then 'No agents can participate with available features' end as error
       from decided join lists using (flow_id) left join ballots using (flow_id)""",
)
oracle("q_e11_detected_type", DECISIONS, f"select flow_id, prediction, {DETECTED} as detected_attack_type from decided")
oracle(
    "q_e12_score_batch",
    DECISIONS,
    f"select flow_id, Attack, prediction, confidence, {DETECTED} as detected_attack_type from decided",
)
oracle("q_flagship_summary", DECISIONS, "select Attack, prediction, count(*) as flows from decided group by 1, 2")

# --- attribution ---------------------------------------------------------------------------------------------
_weights = values(
    "weights",
    "aidx, pos, feature, weight, mean",
    [
        (str(a), str(j), text(f), number(fixtures.explainer_weight(a, j)), number(fixtures.EXPLAINER_MEANS[j]))
        for a in range(1, 8)
        for j, f in enumerate(V1)
    ],
)
_cells = "cells as (" + " union all ".join(
    f"select flow_id, {j} as pos, {f} as x from named" for j, f in enumerate(V1)
) + ")"
_values = """shap as (
  select v.flow_id, v.agent, v.idx, w.pos, w.feature, w.weight * (c.x - w.mean) as shap_value,
    abs(w.weight * (c.x - w.mean)) as importance
  from votes v join weights w on w.aidx = v.idx join cells c on c.flow_id = v.flow_id and c.pos = w.pos)"""
_tops = """tops as (
  select * from (select *, row_number() over (partition by flow_id, agent order by importance desc, pos) as rank from shap)
  where rank <= 5)"""
_combined = """combined as (
  select * from (
    select *, row_number() over (partition by flow_id order by importance desc, pos) as rank from (
      select flow_id, feature, any_value(pos) as pos, sum(importance) / count(*) as importance
      from tops group by flow_id, feature)) where rank <= 5)"""
EXPLAINED = [*DECISIONS, _weights, _cells, _values, _tops, _combined]
oracle(
    "q_x2_linear_attribution",
    [FLOWS, ALIASES, NAMED, _weights, _cells],
    """select flow_id, 'agent_5_rf_v1' as agent, feature, abs(weight * (x - mean)) as importance, weight * (x - mean) as shap_value
       from cells join weights using (pos) where aidx = 5""",
)
oracle(
    "q_x2_all_detectors",
    [FLOWS, ALIASES, NAMED, AGENTS, _weights, _cells],
    """select flow_id, agent, feature, abs(weight * (x - mean)) as importance, weight * (x - mean) as shap_value
       from cells join weights using (pos) join agents on idx = aidx""",
)
oracle("q_x4_background", [FLOWS, ALIASES, NAMED], f"select flow_id, {V1_LIST} from named order by {KEY} limit 50")
oracle(
    "q_x5_batch_importance",
    [*BASE, _weights, _cells, _values],
    """select agent, feature, importance, shap_value, rank from (
         select *, row_number() over (partition by agent order by importance desc, pos) as rank from (
           select agent, feature, any_value(pos) as pos, sum(importance) / count(*) as importance,
             sum(shap_value) / count(*) as shap_value from shap group by 1, 2)) where rank <= 5""",
)
oracle(
    "q_x6_top_per_flow",
    EXPLAINED,
    """select flow_id, agent, string_agg(feature, ',' order by rank) as features,
       max(importance) filter (where rank = 1) as importance, max(shap_value) filter (where rank = 1) as shap_value
       from tops group by 1, 2""",
)
oracle("q_x7_combined", EXPLAINED, "select flow_id, rank, feature, importance from combined")
_line = "rank || '. ' || feature || ' (' || case when shap_value > 0 then 'increased' else 'decreased' end"
oracle(
    "q_x8_agent_text",
    EXPLAINED,
    f"""select d.flow_id, coalesce('agent_7_unknown detected anomaly based on:' || chr(10) || lines,
          'No significant features identified.') as explanation
        from decided d left join (
          select flow_id, string_agg({_line} || ' anomaly score by ' || printf('%.4f', importance) || ')' || chr(10), ''
            order by rank) as lines
          from tops where agent = 'agent_7_unknown' and rank <= 3 group by 1) using (flow_id)""",
)
oracle(
    "q_x8_all_detectors",
    EXPLAINED,
    f"""select d.flow_id, a.agent, coalesce(a.agent || ' detected anomaly based on:' || chr(10) || lines,
          'No significant features identified.') as explanation
        from decided d cross join agents a left join (
          select flow_id, agent, string_agg({_line} || ' anomaly score by ' || printf('%.4f', importance) || ')' || chr(10), ''
            order by rank) as lines
          from tops where rank <= 3 group by 1, 2) t on t.flow_id = d.flow_id and t.agent = a.agent""",
)
_summaries = """summaries as (
  select d.flow_id, 'Ensemble Decision: ' || upper(prediction) || chr(10) || 'Key Contributing Factors:' || chr(10)
    || coalesce(lines, '') as summary
  from decided d left join (
    select flow_id, string_agg(rank || '. ' || feature || ' (importance: ' || printf('%.4f', importance) || ')' || chr(10), ''
      order by rank) as lines from combined group by 1) using (flow_id))"""
oracle("q_x9_ensemble_text", [*EXPLAINED, _summaries], "select flow_id, summary from summaries")
_shares = ", ".join(
    f"case when coalesce(total, 0) = 0 then 0.0::double else i{k} / total end * 100 as share_{k}" for k in (1, 2, 3)
)
oracle(
    "q_x10_contribution",
    [*EXPLAINED],
    f"""select flow_id, {_shares} from decided left join (
          select flow_id, {", ".join(f"max(importance) filter (where rank = {k}) as i{k}" for k in range(1, 6))},
            coalesce(i1, 0) + coalesce(i2, 0) + coalesce(i3, 0) + coalesce(i4, 0) + coalesce(i5, 0) as total
          from combined group by 1) using (flow_id)""",
)
_raw = {
    f: (
        f"trunc({f} / 1024 * 1000)" if "PKTS" in f
        else f"trunc({f} / 1024 * 100000)" if "BYTES" in f
        else f"{f} / 1024 * 10000" if "DURATION" in f
        else f"{f} / 1024"
    )
    for f in V1
}
oracle(
    "q_x11_raw_value",
    [FLOWS, ALIASES, NAMED],
    "select flow_id, "
    + ", ".join(f"{v} as raw_{f}" for f, v in _raw.items())
    + """, printf(' (Actual value: %.4f)', L7_PROTO / 1024) as text_L7_PROTO,
       printf(' (Actual: %.6f normalized, ~%d bytes estimated)', IN_BYTES / 1024, trunc(IN_BYTES / 1024 * 100000)::bigint) as text_IN_BYTES,
       printf(' (Actual: %.4f normalized, ~%d packets estimated)', IN_PKTS / 1024, trunc(IN_PKTS / 1024 * 1000)::bigint) as text_IN_PKTS,
       printf(' (Actual: %.6f normalized, ~%.1fms estimated)', FLOW_DURATION_MILLISECONDS / 1024,
         FLOW_DURATION_MILLISECONDS / 1024 * 10000) as text_FLOW_DURATION_MILLISECONDS
       from named""",
)
_briefings = f"""briefings as (
  select d.flow_id,
    case when names is null
      then 'System classified this as ' || upper(prediction) || ' with ' || printf('%.1f', confidence * 100) || '% confidence.'
    when prediction = 'benign' then replace(replace({text(fv.BRIEFING_BENIGN.replace('%s%%', '{p}%').replace('%s', '{n}'))},
      '{{p}}', printf('%.1f', confidence * 100)), '{{n}}', names)
    else replace(replace({text(fv.BRIEFING_ANOMALY.replace('%s%%', '{p}%').replace('%s', '{n}'))},
      '{{p}}', printf('%.1f', confidence * 100)), '{{n}}', names) end as briefing
  from decided d left join (
    select flow_id, string_agg(feature, ', ' order by rank) as names from combined where rank <= 3 group by 1) using (flow_id))"""
oracle("q_x12_briefing", [*EXPLAINED, _briefings], "select flow_id, briefing from briefings")
oracle(
    "q_s8_responses",
    [*EXPLAINED, _lists, _summaries, _briefings],
    f"""select flow_id, prediction, confidence, participating as participating_agents, abstaining as abstaining_agents,
        summary, feature as top_feature, briefing as interpretation, vote_benign, vote_anomaly, {DETECTED} as detected_attack_type
        from decided join lists using (flow_id) join summaries using (flow_id) join briefings using (flow_id)
        left join (select flow_id, feature from combined where rank = 1) using (flow_id)""",
)
_rules = {
    "why": "q like '%why%' and (q like '%anomaly%' or q like '%attack%')",
    "agents": "q like '%agent%'",
    "actions": "q like '%what%' and q like '%do%'",
    "false_positive": "q like '%false positive%'",
    "features": "q like '%feature%' or q like '%important%'",
}
_words = {name: words for name, _, words in fv.ANSWER_RULES}
oracle(
    "q_x13_answers",
    [
        "asked as (select *, lower(text) as q from conversations)",
        "ruled as (select *, case when text is null or text = '' then null "
        + " ".join(f"when {c} then '{n}'" for n, c in _rules.items())
        + " else 'default' end as rule from asked)",
    ],
    "select conv_id, turn, rule, case rule "
    + " ".join(f"when '{n}' then {text(w)}" for n, w in _words.items())
    + f" when 'default' then {text(fv.ANSWER_DEFAULT_HEAD)} || text || {text(fv.ANSWER_DEFAULT_TAIL)} end as answer from ruled",
)

# --- streaming -------------------------------------------------------------------------------------------------
_event_votes = f"""votes as (
  select event_id, {_prediction} as prediction, {_confidence} as confidence
  from (select *, 0.0::double as LONGEST_FLOW_PKT from event_flows), agents)"""
_event_decided = f"decided as (select e.*, {OUTCOME} from event_flows e left join tally using (event_id))"
STREAM = [EVENTS, AGENTS, _event_votes, tally("votes", "event_id"), _event_decided]
ALARM = "(Label = 1 or prediction <> 'benign')"
oracle("q_r1_score_stream", STREAM, "select event_id, Attack, prediction, confidence, vote_benign, vote_anomaly from decided")
oracle(
    "q_r2_totals",
    STREAM,
    f"select count(*) as samples_processed, count(*) filter (where {ALARM}) as anomalies_detected from decided",
)
oracle(
    "q_r3_latest",
    STREAM,
    """select event_id, (Label = 0)::int as benign, (Label = 1)::int as anomaly from decided
       order by ts desc, event_id desc limit 20""",
)
ORACLE["q_r3_latest_state"] = ORACLE["q_r3_latest"]  # the same rows, kept in the state store
# Alerts round exact halves up: 81.25 is 81.3.
oracle(
    "q_r4_alerts",
    STREAM,
    f"""select event_id, Attack as attack_type, confidence, '⚠️ ' || upper(Attack) || ' DETECTED! Confidence: '
        || round(confidence::decimal(38, 18) * 100, 1)::decimal(10, 1)::varchar || '%' as alert from decided where {ALARM}""",
)
oracle(
    "q_r5_windowed",
    [
        *STREAM,
        "timed as (select *, (epoch_us(ts) // 3600000000) * 3600 as w from decided)",
    ],
    f"""select w as window_start, w + 3600 as window_end, count(*) as flows, count(*) filter (where {ALARM}) as alarms,
        (count(*) filter (where {ALARM}))::double / count(*)::double as alarm_rate
        from timed where (w + 3600) * 1000000 <= (select max(epoch_us(ts)) from timed) - 3600000000 group by w""",
)
oracle(
    "q_r6_records",
    STREAM,
    """select event_id, prediction, confidence, Label as actual_label,
       case prediction when 'benign' then 'Benign' end as predicted_attack_type, Attack as actual_attack_type from decided""",
)

# --- run metadata -------------------------------------------------------------------------------------------------
_run_cols = ", ".join(fixtures.select_list(fixtures.RUN_STEP_COLUMNS))
_log = f"""log as (
  select * exclude (status0), case when err is not null then 'error' else status0 end as status from (
    select * rename (status as status0), start_time + to_seconds(floor(value)::bigint) as end_time,
      case when {fixtures.IS_ERROR} then '[' || strftime(start_time, '%H:%M:%S') || '] failed at ' || floor(value)::bigint end as err,
      case when {fixtures.IS_SLOW} then '[' || strftime(start_time, '%H:%M:%S') || '] slow by ' || floor(value)::bigint end as warn
    from (select {_run_cols}, event_type, user_id, value from events)))"""
oracle(
    "q_g1_run_log",
    [_log],
    """select run_id, dataset_name, step, status, coalesce(err, '') as errors, coalesce(warn, '') as warnings, seconds,
       accuracy, f1_score, strftime(start_time, '%Y-%m-%d %H:%M:%S') as started, strftime(end_time, '%Y-%m-%d %H:%M:%S') as ended
       from log""",
)
_seconds = ", ".join(
    f"sum(seconds) filter (where step = '{s}') as seconds_{s}" for s in ("click", "error", "purchase", "signup", "view")
)
_last = "arg_max({0}, row(end_time, step)) filter (where {0} is not null)"
oracle(
    "q_g2_run_summary",
    [_log],
    f"""select run_id, {_last.format('dataset_name')} as dataset, arg_max(step, row(end_time, step)) as current_step,
        case when count(err) > 0 then 'error' else arg_max(status, row(end_time, step)) end as workflow_status,
        count(err) as error_count, count(warn) as warning_count, {_seconds},
        {", ".join(f"{_last.format(m)} as {m}" for m in ("accuracy", "precision", "recall", "f1_score"))}
        from log group by 1""",
)
oracle(
    "q_g3_ready_runs",
    [_log],
    "select run_id from log group by 1 having count(err) = 0 and count(nullif(dataset_name, '')) > 0",
)
oracle(
    "q_g4_duration",
    [_log],
    "select run_id, (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000000::double as total_seconds from log group by 1",
)
oracle(
    "q_g5_last_errors",
    [_log],
    """select run_id, recency, err as error from (
         select *, row_number() over (partition by run_id order by end_time desc, step desc) as recency
         from log where err is not null) where recency <= 3""",
)


# --- trained detectors: what must hold whatever they learn ------------------------------------------------------
_test_flows = f"""test_flows as (
  select * from flows where ('0x' || substr({KEY}, 1, 8))::bigint / 4294967296::double < 0.2::double)"""


def _constants(names, *columns: str) -> str:
    return " union all ".join(f"select {', '.join([text(n) + ' as agent', *columns])}" for n in names)


_learned = ("true as bounded", "true as better_than_constant")
for _name, _kind in {
    "q_l1_boosted_trees": "xgboost", "q_l2_random_forests": "random_forest", "q_l3_neural": "lstm",
    "q_l4_reconstruction": "autoencoder", "q_l6_train_all": None,
}.items():
    ORACLE[_name] = _constants([a.name for a in DETECTORS if _kind in (None, a.model_type)], *_learned)
oracle(
    "q_s6_saved_models",
    [FLOWS, _test_flows],
    _constants(
        [a.name for a in DETECTORS], "true as loaded", "(select count(*) from test_flows) as n_rows", "0::bigint as n_differ"
    ),
)
oracle(
    "q_e1_model_votes",
    [*BASE, _test_flows, "judging as (select flow_id, string_agg(agent, ',' order by idx) as agents from votes group by 1)"],
    """select flow_id, Attack, coalesce(agents, '') as participating, true as votes_sound, true as decision_sound
       from test_flows left join judging using (flow_id)""",
)
ORACLE["q_x1_global_importance"] = " union all ".join(
    f"select {text(a.name)} as agent, {len(a.features)}::bigint as n_features, true as none_below_0, true as sum_is_1"
    for a in DETECTORS
    if a.model_type in ("random_forest", "xgboost")
)
ORACLE["q_x3_sampled_shapley"] = "select true as any_flagged, true as all_sums_exact"

# --- further forms -------------------------------------------------------------------------------------------------
oracle(
    "q_s1_ingest",
    [FLOWS],
    """select Attack, count(*) as n_rows, count(*) as n_ids from flows
       where L4_SRC_PORT is null or L4_SRC_PORT::bigint % 97 <> 0 group by 1
       union all select '(quarantine)', count(*), 0 from flows where L4_SRC_PORT::bigint % 97 = 0""",
)
oracle(
    "q_m11_smart",
    [
        FLOWS,
        _both,
        capped("both_complete"),
        f"""sample as (select flow_id, Attack, Label, {", ".join(f"coalesce({f}, 0.0::double) as {f}" for f in VIEW)}
            from capped order by {KEY} limit {fv.SMART_SAMPLE_SIZE})""",
        *split("sample"),
        *scaled("split_rows", "split = 'train'", VIEW, "flow_id, Attack, Label, split"),
    ],
    "select * from scaled_rows",
)
oracle(
    "q_m11_table",
    [FLOWS, _complete, *split("complete")],
    "select flow_id, Attack from split_rows where split = 'test'",
)
# Without the last detector's model; flows that only it was to judge are undecided and not explained.
_few_votes = [VOTES.replace("votes as (", "all_votes as (", 1), "votes as (select * from all_votes where idx <> 7)"]
oracle(
    "q_x12_missing_model",
    [
        FLOWS, ALIASES, AGENTS, NAMED, *_few_votes, tally("votes", "flow_id"), DECIDED, _weights, _cells, _values, _tops,
        _combined, _briefings,
    ],
    """select b.flow_id, briefing, coalesce(n, 0)::int as n_explained from briefings b
       left join (select flow_id, count(*) as n from votes group by 1) using (flow_id)""",
)

oracle(
    "q_x12_filtered",
    [*EXPLAINED, _summaries, _briefings],
    """select flow_id, summary, briefing, n::int as n_explained
       from briefings join summaries using (flow_id) join (select flow_id, count(*) as n from votes group by 1) using (flow_id)
       join combined using (flow_id)
       where briefing like '%ANOMALY%' and rank = 1 and feature = 'IN_BYTES'""",
)
