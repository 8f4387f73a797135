"""Evaluation of predictions as SQL: parsed texts, scores, failure tags, and what aggregates over them."""

from __future__ import annotations

from sightline.functions import vocabulary as V
from sightline.operators.evaluation import FACT_TASKS, LABEL_TASKS
from sightline.plans import parser_sql as P

SAID = f"SELECT *, {P.json_object('prediction')} AS obj FROM pred WHERE prediction IS NOT NULL"
WORDS = "SELECT list_sort(list_distinct(flatten(list(" + P.atoms("defect_type") + ")))) AS words FROM pred"


def _row_of(location: str) -> str:
    return f"((list_position({V.LOCATIONS!r}, {location}) - 1) // 3)"


def _column_of(location: str) -> str:
    return f"((list_position({V.LOCATIONS!r}, {location}) - 1) % 3)"


ADJACENT = f"coalesce(abs({_row_of('location')} - {_row_of('said_location')}) <= 1 AND abs({_column_of('location')} - {_column_of('said_location')}) <= 1, false)"


def _sets(t: str, p: str, prefix: str = "") -> str:
    both, nt, np = f"len(list_intersect({t}, {p}))", f"len({t})", f"len({p})"
    empty = f"{nt} = 0 AND {np} = 0"
    return (
        f"{both} = {nt} AND {both} = {np} AS {prefix}exact_match, CASE WHEN {empty} THEN 1.0 ELSE coalesce({both} / nullif({np}, 0), 0) END::DOUBLE AS {prefix}precision, "
        f"CASE WHEN {empty} THEN 1.0 ELSE coalesce({both} / nullif({nt}, 0), 0) END::DOUBLE AS {prefix}recall, CASE WHEN {empty} THEN 1.0 ELSE 2 * {both} / ({nt} + {np}) END::DOUBLE AS {prefix}f1"
    )


PARSED = f"""SELECT prediction_no, run_id, instruction_id, image_id, task_family, category, condition, defect_type, location, visual_severity, prediction, obj,
  {P.condition("prediction", "obj")} AS said_condition, {P.product("prediction", "obj")} AS said_product, {P.location("prediction", "obj")} AS said_location, {P.severity("prediction", "obj")} AS said_severity,
  {P.defects("prediction", "obj", "words")} AS said_defects, {P.semantic("prediction", "obj", "words")} AS said_semantic, {P.atoms("defect_type")} AS true_defects, {P.canonical(P.atoms("defect_type"))} AS true_semantic,
  {", ".join(f"{v} AS {k}" for k, v in P.uncertainty("prediction").items())} FROM said, voc"""

_KEYS = "list_distinct(coalesce(json_keys(obj), []))"
SCORED = f"""SELECT *, said_condition IS NOT DISTINCT FROM condition AS condition_correct, said_product IS NOT DISTINCT FROM category AS product_correct, said_location IS NOT DISTINCT FROM location AS location_correct,
  said_severity IS NOT DISTINCT FROM visual_severity AS severity_correct, {ADJACENT} AS adjacent, {_sets("true_defects", "said_defects", "strict_")}, {_sets("true_semantic", "said_semantic")},
  obj IS NOT NULL AS json_valid, CAST(len(list_intersect({_KEYS}, {V.REPORT_KEYS!r})) AS INT) AS present, CAST(len(list_filter({_KEYS}, lambda k: NOT list_contains({V.REPORT_KEYS!r}, k))) AS INT) AS unsupported FROM par"""

COVERED = f"""SELECT *, json_valid AND present = {len(V.REPORT_KEYS)} AS schema_valid, present / {len(V.REPORT_KEYS)}::DOUBLE AS completeness,
  (condition_correct::INT + (said_product IS NULL OR product_correct)::INT + strict_f1 + (said_location IS NULL OR location_correct)::INT) / 4 AS fact_coverage FROM sco"""

_REPORT = "task_family = 'structured_report' AND json_valid"
_TAGS = [
    "CASE WHEN unsupported_root_cause THEN 'unsupported_root_cause' END",
    "CASE WHEN unsupported_safety_claim THEN 'unsupported_safety_claim' END",
    "CASE WHEN task_family = 'binary_inspection' AND NOT condition_correct THEN CASE WHEN condition IS NOT DISTINCT FROM 'anomalous' THEN 'false_negative' ELSE 'false_positive' END END",
    "CASE WHEN task_family = 'product_identification' AND NOT product_correct THEN 'wrong_product' END",
    "CASE WHEN task_family = 'defect_identification' AND NOT exact_match THEN CASE WHEN f1 > 0 THEN 'partial_compound_defect' ELSE 'wrong_defect' END END",
    "CASE WHEN task_family = 'localization' AND NOT location_correct THEN CASE WHEN adjacent THEN 'adjacent_location' ELSE 'wrong_location' END END",
    "CASE WHEN task_family = 'structured_report' AND NOT json_valid THEN 'invalid_json' END",
    f"CASE WHEN {_REPORT} AND NOT schema_valid THEN 'missing_required_field' END",
    f"CASE WHEN {_REPORT} AND unsupported > 0 THEN 'unsupported_field' END",
    f"CASE WHEN {_REPORT} AND NOT condition_correct THEN 'wrong_condition' END",
    f"CASE WHEN {_REPORT} AND NOT product_correct THEN 'wrong_product' END",
    f"CASE WHEN {_REPORT} AND NOT exact_match THEN 'wrong_defect' END",
    f"CASE WHEN {_REPORT} AND NOT location_correct THEN 'wrong_location' END",
    f"CASE WHEN {_REPORT} AND NOT severity_correct THEN 'wrong_severity' END",
    "CASE WHEN task_family = 'uncertainty' AND NOT abstains THEN 'failed_to_abstain' END",
    f"CASE WHEN task_family NOT IN ({', '.join(repr(t) for t in V.TASKS if t not in FACT_TASKS)}) AND fact_coverage < 1 THEN 'incomplete_or_incorrect_facts' END",
]
EVALUATED = f"SELECT *, list_sort(list_distinct(list_filter([{', '.join(_TAGS)}], lambda x: x IS NOT NULL))) AS tags FROM cov"

#: What any query over evaluated rows (``ev``) needs.
VIEWS = {"said": SAID, "voc": WORDS, "par": PARSED, "sco": SCORED, "cov": COVERED, "ev": EVALUATED}

_TASKS_OF_LABELS = "(" + ", ".join(f"'{t}'" for t in LABEL_TASKS) + ")"
LABELLED = f"""SELECT task_family, coalesce(CASE task_family WHEN 'binary_inspection' THEN condition WHEN 'product_identification' THEN category ELSE location END, 'None') AS truth,
  CASE task_family WHEN 'binary_inspection' THEN said_condition WHEN 'product_identification' THEN said_product ELSE said_location END AS said, adjacent FROM ev WHERE task_family IN {_TASKS_OF_LABELS}"""
CELLS = "SELECT task_family, truth, coalesce(said, '__unparsed__') AS predicted, count(*) AS n FROM lab GROUP BY ALL"
LABELS = """SELECT task_family, label, coalesce(sum(n) FILTER (truth = label AND predicted = label), 0) AS tp, coalesce(sum(n) FILTER (predicted = label), 0) AS said, coalesce(sum(n) FILTER (truth = label), 0) AS support
  FROM cells JOIN (SELECT DISTINCT task_family, unnest([truth, predicted]) AS label FROM cells) USING (task_family) WHERE label <> '__unparsed__' GROUP BY ALL"""
RATES = "SELECT *, coalesce(tp / nullif(said, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall FROM labels"
F1S = "SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1 FROM rated"


def _long(table: str, metrics: dict[str, str], where: str, group: str = "task_family", label: str = "NULL") -> str:
    """One row per metric."""
    return " UNION ALL ".join(f"SELECT {group} AS task_family, '{name}' AS metric, CAST({label} AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS said, CAST({value} AS DOUBLE) AS value FROM {table} WHERE {where} GROUP BY ALL" for name, value in metrics.items())


_avg = lambda c: f"avg(({c})::INT)"
_CLAIMS = {"unsupported_root_cause_rate": _avg("unsupported_root_cause"), "unsupported_safety_claim_rate": _avg("unsupported_safety_claim")}
_DEFECT = {f"{p}exact_match": _avg(f"{p}exact_match") for p in ("", "strict_")} | {f"{p}{m}": f"avg({p}{m})" for p in ("", "strict_") for m in ("precision", "recall", "f1")}
_STRUCTURED = {
    "json_valid_rate": _avg("json_valid"), "schema_valid_rate": _avg("schema_valid"), "field_completeness": "avg(CASE WHEN json_valid THEN completeness ELSE 0 END)",
    "condition_accuracy": _avg("json_valid AND condition_correct"), "product_accuracy": _avg("json_valid AND product_correct"), "defect_f1": "avg(CASE WHEN json_valid THEN f1 ELSE 0 END)",
    "strict_defect_f1": "avg(CASE WHEN json_valid THEN strict_f1 ELSE 0 END)", "location_accuracy": _avg("json_valid AND location_correct"), "severity_accuracy": _avg("json_valid AND severity_correct"),
    "unsupported_field_rate": _avg("json_valid AND unsupported > 0"),
}
_PLAIN = " UNION ALL ".join(
    [
        _long("ev", {"count": "count(*)"}, f"task_family IS NULL OR task_family NOT IN {_TASKS_OF_LABELS}"),
        _long("ev", _DEFECT, "task_family = 'defect_identification'"),
        _long("ev", _STRUCTURED, "task_family = 'structured_report'"),
        _long("ev", {"appropriate_abstention_accuracy": _avg("abstains AND NOT unsupported_root_cause AND NOT unsupported_safety_claim"), **_CLAIMS}, "task_family = 'uncertainty'"),
        _long("ev", {"mean_fact_coverage": "avg(fact_coverage)", **_CLAIMS}, f"task_family IN ({', '.join(repr(t) for t in FACT_TASKS)})"),
    ]
)
_OVERALL = {"count": "sum(n)", "accuracy": "coalesce(sum(n) FILTER (truth = predicted), 0) / sum(n)", "unparseable_count": "coalesce(sum(n) FILTER (predicted = '__unparsed__'), 0)", "unparseable_rate": "coalesce(sum(n) FILTER (predicted = '__unparsed__'), 0) / sum(n)"}
_OF_LABELS = " UNION ALL ".join(
    [
        _long("cells", _OVERALL, "true"),
        _long("f1s", {f"macro_{m}": f"avg({m})" for m in ("precision", "recall", "f1")}, "true"),
        _long("f1s", {m: f"max({m})" for m in ("precision", "recall", "f1", "support")}, "true", label="label"),
        _long("lab", {"adjacent_tolerance_accuracy": _avg("adjacent")}, "task_family = 'localization'"),
        """SELECT t.task_family, 'confusion' AS metric, t.truth AS label, p.predicted AS said, CAST(coalesce(c.n, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT task_family, truth FROM cells) t
           JOIN (SELECT DISTINCT task_family, predicted FROM cells) p USING (task_family) LEFT JOIN cells c ON c.task_family = t.task_family AND c.truth = t.truth AND c.predicted = p.predicted""",
    ]
)
#: (task_family, metric, label, said, value) of all tasks, ``tm``, with what it needs.
TASK_VIEWS = VIEWS | {"lab": LABELLED, "cells": CELLS, "labels": LABELS, "rated": RATES, "f1s": F1S, "tm": f"SELECT task_family, metric, label, said, round(value, 6) AS value FROM ({_PLAIN} UNION ALL {_OF_LABELS})"}

CATEGORIES = "SELECT category, count(*) AS n, round(avg((len(tags) > 0)::INT), 9) AS failure_rate, round(avg(unsupported_root_cause::INT), 9) AS root_cause_rate, round(avg(unsupported_safety_claim::INT), 9) AS safety_claim_rate FROM ev GROUP BY 1"
TAGS = "SELECT tag, count(*) AS n FROM (SELECT unnest(list_concat(['*evaluated'], CASE WHEN len(tags) > 0 THEN ['*failed'] ELSE [] END, tags)) AS tag FROM ev) GROUP BY 1"
UNPARSED = f"SELECT * FROM ev WHERE task_family IN {_TASKS_OF_LABELS} AND CASE task_family WHEN 'binary_inspection' THEN said_condition WHEN 'product_identification' THEN said_product ELSE said_location END IS NULL"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


PROFILE = f"""SELECT kind, category, item, count(*) AS w FROM (
  SELECT 'defect' AS kind, category, unnest(true_semantic) AS item FROM ev WHERE condition = 'anomalous' AND task_family IN {_in(V.DEFECT_TASKS)} AND NOT exact_match
  UNION ALL SELECT 'location', category, location FROM ev WHERE condition = 'anomalous' AND task_family IN {_in(V.LOCALIZATION_TASKS)} AND location IS NOT NULL AND NOT location_correct) GROUP BY ALL"""

_MARKED = "coalesce(nullif(array_to_string({}, '+'), ''), '**unparsed**')"
#: (kind, task_family, category, truth, said, adjacent) of the anomalous rows that failure analysis looks at.
FAILURES = f"""SELECT 'defect' AS kind, task_family, category, {_MARKED.format("true_semantic")} AS truth, {_MARKED.format("said_semantic")} AS said, false AS adjacent FROM ev WHERE condition = 'anomalous' AND task_family IN {_in(V.DEFECT_TASKS)}
  UNION ALL SELECT 'location', task_family, category, coalesce(location, '**missing_truth**'), coalesce(said_location, '**unparsed**'), adjacent FROM ev WHERE condition = 'anomalous' AND task_family IN {_in(V.LOCALIZATION_TASKS)}"""
_COUNT = "SELECT kind, '{0}' AS metric, CAST(NULL AS VARCHAR) AS value, count(x.kind) FILTER ({1}) AS n FROM (SELECT unnest({2}) AS kind) k LEFT JOIN fail x USING (kind) GROUP BY ALL"
_BOTH = "['defect', 'location']"
ANALYSIS = " UNION ALL ".join(
    [
        _COUNT.format("records", "true", _BOTH), _COUNT.format("exact", "truth = said", _BOTH), _COUNT.format("unparsed", "said = '**unparsed**'", _BOTH), _COUNT.format("adjacent", "adjacent", "['location']"),
        "SELECT kind, 'task', task_family, count(*) FROM fail GROUP BY ALL", "SELECT kind, 'errors', coalesce(category, '**unknown**'), count(*) FROM fail WHERE truth <> said GROUP BY ALL", "SELECT 'all', 'records', NULL, count(*) FROM ev",
    ]
)
FAILURE_VIEWS = VIEWS | {"fail": FAILURES, "confused": "SELECT kind, truth, said, count(*) AS n FROM fail GROUP BY ALL"}
FAILURE_SQL = f"""SELECT kind, metric, value, CAST(NULL AS VARCHAR) AS truth, CAST(NULL AS VARCHAR) AS said, n, CAST(NULL AS BIGINT) AS rank FROM ({ANALYSIS})
  UNION ALL SELECT kind, 'confusion', NULL, truth, said, n, CASE WHEN truth <> said THEN row_number() OVER (PARTITION BY kind, truth <> said ORDER BY n DESC, truth, said) END FROM confused"""


def views_of(source: str) -> dict[str, str]:
    """``VIEWS`` over another table of predictions than all of them."""
    return VIEWS | {"said": SAID.replace("FROM pred", f"FROM {source}"), "voc": WORDS.replace("FROM pred", f"FROM {source}")}


_VALIDATION = "SELECT * FROM pred WHERE instruction_id IN (SELECT instruction_id FROM rec WHERE split = 'validation')"
_ITEMS = f"""SELECT instruction_id, category, 'defect' AS kind, unnest({P.canonical(P.atoms("defect_type"))}) AS item FROM rec WHERE task_family IN {_in(V.DEFECT_WEIGHTED_TASKS)}
  UNION ALL SELECT instruction_id, category, 'location', location FROM rec WHERE task_family IN {_in(V.LOCATION_WEIGHTED_TASKS)} AND location IS NOT NULL"""
_WEIGHED = "SELECT r.instruction_id, CAST(coalesce(s.score, 0) AS BIGINT) AS score FROM rec r LEFT JOIN (SELECT instruction_id, sum(w) AS score FROM items JOIN wd USING (kind, category, item) GROUP BY 1) s USING (instruction_id)"
_POOL = "SELECT instruction_id, r.task_family, r.condition, r.category, w.score FROM rec r JOIN weighed w USING (instruction_id) WHERE r.split = 'train' AND r.task_family IS NOT NULL AND r.condition IS NOT NULL AND r.category IS NOT NULL"
#: Records weighed by the mistakes of the validation predictions (``weighed``), and those of them that may be selected (``hard``).
HARD_VIEWS = {"vpred": _VALIDATION, **views_of("vpred"), "wd": PROFILE, "items": _ITEMS, "weighed": _WEIGHED, "hard": _POOL}


def corpus_print(table: str, by: str) -> str:
    """(by, n, fingerprint): the digest of identifiers as ``aggregates.corpus_fingerprint`` takes it, over buckets."""
    return f"""SELECT {by}, CAST(sum(c) AS BIGINT) AS n, sha256(string_agg(f, chr(10) ORDER BY b)) AS fingerprint FROM (
      SELECT {by}, ('0x' || substr(sha256(instruction_id), 1, 8))::BIGINT % 4096 AS b, count(*) AS c, sha256(string_agg(instruction_id, chr(10) ORDER BY instruction_id) || chr(10)) AS f FROM {table} GROUP BY ALL) GROUP BY ALL"""
