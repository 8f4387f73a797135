"""The parsers as SQL, generated from the same fixed values."""

from __future__ import annotations

from sightline.functions import vocabulary as V
from sightline.functions.parsers import ORDINALS, any_of
from sightline.plans.views import strip_sql


def label(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(coalesce({strip_sql(x)}, ''), '&', ' and ')), '[^a-z0-9]+', '_', 'g'), '_')"


def name(x: str) -> str:
    return f"trim(regexp_replace(lower({strip_sql(x)}), '[^a-z0-9]+', '_', 'g'), '_')"


def text(x: str) -> str:
    return rf"coalesce(lower(trim(regexp_replace({x}, '\s+', ' ', 'g'))), '')"


def _object(x: str) -> str:
    return f"CASE WHEN {x} LIKE '{{%}}' AND json_valid({x}) THEN CASE WHEN json_type({x}) = 'OBJECT' THEN {x} END END"


def json_object(x: str) -> str:
    t = strip_sql(x)
    unfenced = strip_sql(f"regexp_replace({t}, '(?i)```(json)?', '', 'g')")
    braces = rf"regexp_extract({t}, '(?s)\{{.*\}}')"
    return f"coalesce({_object(t)}, CASE WHEN contains({t}, '```') THEN {_object(unfenced)} END, {_object(braces)})"


def has(obj: str, key: str) -> str:
    return f"coalesce(list_contains(json_keys({obj}), '{key}'), false)"


def field(obj: str, key: str, kinds: tuple[str, ...] = ("VARCHAR",)) -> str:
    wanted = ", ".join(f"'{k}'" for k in kinds)
    return f"CASE WHEN json_type({obj}, '$.{key}') IN ({wanted}) THEN json_extract_string({obj}, '$.{key}') END"


def first_present(obj: str, *keys: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(obj, k)} THEN {field(obj, k)}" for k in keys) + " END"


def _in(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _phrases(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def _condition_text(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{any_of(V.NORMAL_PATTERNS)}') THEN 'normal' WHEN regexp_matches({x}, '{any_of(V.ANOMALOUS_PATTERNS)}') THEN 'anomalous' WHEN {_phrases(x, V.NORMAL_PHRASES)} THEN 'normal' END"


def condition(x: str, obj: str) -> str:
    value = "coalesce(" + ", ".join(field(obj, k, ("VARCHAR", "BOOLEAN")) for k in V.CONDITION_FIELDS) + ")"
    by_value = f"CASE WHEN {value} IS NOT NULL THEN CASE WHEN {_in(label(value), V.NORMAL_WORDS)} THEN 'normal' WHEN {_in(label(value), V.ANOMALOUS_WORDS)} THEN 'anomalous' ELSE {_condition_text(text(value))} END END"
    none = f"CASE WHEN {has(obj, 'defect_type')} THEN json_type({obj}, '$.defect_type') = 'NULL' ELSE {has(obj, 'defect')} AND json_type({obj}, '$.defect') = 'NULL' END"
    by_defect = f"CASE WHEN {none} OR {_in(label(first_present(obj, 'defect_type', 'defect')), V.NO_DEFECT_WORDS)} THEN 'normal' END"
    return f"coalesce(CASE WHEN {obj} IS NOT NULL THEN coalesce({by_value}, {by_defect}) END, {_condition_text(text(x))})"


def _alias(x: str, aliases: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains('_' || {x} || '_', '_{a}_') THEN '{aliases[a]}'" for a in sorted(aliases, key=len, reverse=True)) + " END"


def product(x: str, obj: str) -> str:
    aliases = {k: k for k in V.CATEGORIES} | V.PRODUCT_ALIASES
    return "coalesce(" + ", ".join([*(_alias(label(field(obj, k)), aliases) for k in ("product", "category", "object", "product_category")), _alias(label(x), aliases)]) + ")"


def _grid(x: str) -> str:
    ordinal = "(" + "|".join(ORDINALS) + ")"
    pattern = rf"\b{ordinal}\s+row\s*,?\s*(?:and\s+)?(?:the\s+)?{ordinal}\s+column\b"
    number = lambda i: f"CASE regexp_extract({x}, '{pattern}', {i}) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ORDINALS.items()) + " END"
    cell = f"['top', 'center', 'bottom'][{number(1)}] || '_' || ['left', 'center', 'right'][{number(2)}]"
    return f"nullif(replace({cell}, 'center_center', 'center'), '')"


def _location_text(x: str) -> str:
    return f"coalesce({_grid(text(x))}, {_alias(label(x), {k: k for k in V.LOCATIONS} | V.LOCATION_ALIASES)})"


def location(x: str, obj: str) -> str:
    return f"coalesce({_location_text(first_present(obj, 'location', 'region'))}, {_location_text(x)})"


def severity(x: str, obj: str) -> str:
    value = label(first_present(obj, "visual_severity", "severity"))
    by_field = f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SEVERITY_WORDS.items()) + " END"
    by_text = "CASE " + " ".join(f"WHEN list_contains(string_split({label(x)}, '_'), '{s}') THEN '{s}'" for s in V.SEVERITIES) + " END"
    return f"coalesce({by_field}, {by_text})"


def atoms(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda a: {label('a')}), lambda a: a <> '')))"


def canonical(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DEFECT_ALIASES.items())
    return f"list_sort(list_distinct(list_transform({x}, lambda a: CASE a {whens} ELSE a END)))"


_DEFECT_KEYS = ("defect_type", "defect", "issue")


def _defect_kind(obj: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(obj, k)} THEN json_type({obj}, '$.{k}')" for k in _DEFECT_KEYS) + " END"


def _listed(obj: str) -> str:
    """Atoms of the strings in a JSON list."""
    items = "CASE " + " ".join(f"WHEN {has(obj, k)} THEN json_extract({obj}, '$.{k}[*]')" for k in _DEFECT_KEYS) + " END"
    strings = f"list_transform(list_filter({items}, lambda i: json_type(i) = 'VARCHAR'), lambda i: {label('json_extract_string(i, ' + chr(39) + '$' + chr(39) + ')')})"
    return f"list_sort(list_distinct(list_filter({strings}, lambda a: a <> '')))"


def _holds(x: str, a: str) -> str:
    return f"contains('_' || {label(x)} || '_', '_' || {a} || '_')"


def _defects(x: str, obj: str, by_text: str, wrap) -> str:
    kind, none = _defect_kind(obj), "CAST([] AS VARCHAR[])"
    return f"""CASE WHEN {obj} IS NOT NULL AND coalesce({kind}, 'NULL') = 'NULL' THEN {none} WHEN {obj} IS NOT NULL AND {kind} = 'VARCHAR' THEN {wrap(atoms(first_present(obj, *_DEFECT_KEYS)))}
      WHEN {obj} IS NOT NULL AND {kind} = 'ARRAY' THEN {wrap(_listed(obj))} ELSE {by_text} END"""


def defects(x: str, obj: str, vocabulary: str) -> str:
    """Strict."""
    return _defects(x, obj, f"list_sort(list_filter({vocabulary}, lambda a: a <> '' AND {_holds(x, 'a')}))", lambda a: a)


def _canonical_each(x: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.DEFECT_ALIASES.items())
    return f"list_transform({x}, lambda c: CASE c {whens} ELSE c END)"


def semantic(x: str, obj: str, vocabulary: str) -> str:
    """With aliases: a single-word alias in the text counts unless a longer alias there holds the word."""
    found = f"list_filter({sorted(V.DEFECT_ALIASES)!r}, lambda a: {_holds(x, 'a')})"
    accepted = f"list_filter({found}, lambda a: contains(a, '_') OR len(list_filter({found}, lambda b: b <> a AND list_contains(string_split(b, '_'), a))) = 0)"
    matches = f"list_filter({vocabulary}, lambda a: a <> '' AND {_holds(x, 'a')})"
    known = f"list_concat({_canonical_each(vocabulary)}, {_canonical_each(found)})"
    by_text = f"list_sort(list_distinct(list_intersect(list_concat({_canonical_each(matches)}, {_canonical_each(accepted)}), {known})))"
    return _defects(x, obj, by_text, canonical)


def uncertainty(x: str) -> dict[str, str]:
    return {"abstains": _phrases(text(x), V.ABSTENTION_PHRASES), "unsupported_root_cause": _phrases(text(x), V.ROOT_CAUSE_PHRASES), "unsupported_safety_claim": _phrases(text(x), V.SAFETY_PHRASES)}
