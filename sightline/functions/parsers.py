"""Labels out of free model text, as Column expressions.

Where the text holds a JSON object (whole, in a code fence or between the first and the last brace), its fields win; else
phrases of the normalised text decide. ``parse`` is the entry point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vocabulary as V
from sightline.functions.text import ColumnOrName, built_once, norm_label, norm_text, split_compound, strip


def _only_object(t: Column) -> Column:
    """The text if it is exactly one JSON object, else null.

    As the one element of an array nothing may follow it, which the parser alone would accept.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    alone = F.try_variant_get(inside, "$[1]", "variant").isNull()
    return F.when(t.startswith("{") & t.endswith("}") & inside.isNotNull() & alone, t)


def json_object_text(c: ColumnOrName) -> Column:
    """The text of the JSON object in ``c``: the whole text, else without code fences, else from the first to the last brace."""
    t = strip(c)
    unfenced = F.when(F.contains(t, F.lit("```")), strip(F.regexp_replace(t, "(?i)```(json)?", "")))
    braces = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.coalesce(_only_object(t), _only_object(unfenced), _only_object(braces))


def has_key(obj: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(obj), key), F.lit(False))


#: The fields of reports that any parser reads.
FIELDS = ["condition", "status", "result", "pass", "defect_type", "defect", "issue", "product", "category", "object", "product_category", "location", "region", "visual_severity", "severity"]

PRODUCT_FIELDS = ["product", "category", "object", "product_category"]


def _s(key: str) -> Column:
    """A field as text, if it is a string."""
    return F.col(f"__s_{key}")


def _has(key: str) -> Column:
    return F.array_contains("__keys", key)


def _is_null(key: str) -> Column:
    """The key is there and its value is JSON null."""
    return _has(key) & (F.col(f"__k_{key}") == "VOID")


def _first_present(*keys: str) -> Column:
    """The string under the first key that is there, whatever later keys hold."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        out = F.when(_has(key), _s(key)).otherwise(out)
    return out


def _padded(label: str) -> Column:
    return F.concat(F.lit("_"), F.col(label), F.lit("_"))


def _apart(names: Column) -> Column:
    """``names`` as they are, by a function that no generated stage takes in: it ends the stage there, as all steps in one outgrow what the JVM compiles."""
    return F.filter(names, lambda k: k.isNotNull())


@built_once
def _steps(column: str) -> list[dict[str, Column]]:
    """The helper columns of ``with_parts``, step by step."""
    t = F.col("__t")
    alone = lambda k: F.when(F.col(f"__p{k}").isNotNull() & F.try_variant_get(F.col(f"__p{k}"), "$[1]", "variant").isNull(), F.col(f"__{k}"))
    return [
        {"__t": strip(column)},
        {"__u": F.when(F.contains(t, F.lit("```")), strip(F.regexp_replace(t, "(?i)```(json)?", ""))), "__b": F.when(F.contains(t, F.lit("{")), F.regexp_extract(t, r"(?s)\{.*\}", 0))},
        {f"__p{k}": F.try_parse_json(F.when(F.col(f"__{k}").startswith("{") & F.col(f"__{k}").endswith("}"), F.concat(F.lit("["), F.col(f"__{k}"), F.lit("]")))) for k in "tub"},
        {"obj": F.coalesce(*map(alone, "tub"))},
        {"__v": F.try_parse_json("obj"), "__keys": _apart(F.coalesce(F.json_object_keys("obj"), F.array().cast("array<string>"))), "__text": norm_text(column), "__label": norm_label(column)},
        {f"__f_{k}": F.try_variant_get("__v", f"$.{k}", "variant") for k in FIELDS},
        {f"__k_{k}": F.coalesce(F.schema_of_variant(f"__f_{k}"), F.lit("")) for k in FIELDS},
        {f"__s_{k}": F.when(F.col(f"__k_{k}").isin(["STRING", "BOOLEAN"] if k in V.CONDITION_FIELDS else ["STRING"]), F.try_variant_get(f"__f_{k}", "$", "string")) for k in FIELDS},
        {"__c": F.coalesce(*map(_s, V.CONDITION_FIELDS)), "__l": _first_present("location", "region"), "__sv": norm_label(_first_present("visual_severity", "severity")), "__d": norm_label(_first_present("defect_type", "defect"))},
        {"__c_label": norm_label("__c"), "__c_text": norm_text("__c"), "__apart": _apart(F.col("__keys")), "__l_label": norm_label("__l"), "__l_text": norm_text("__l"), **{f"__p_{k}": norm_label(_s(k)) for k in PRODUCT_FIELDS}},
        # labels between underscores, in which whole words and phrases are looked for
        {"__keys": F.col("__apart"), "__in_label": _padded("__label"), "__in_l": _padded("__l_label"), **{f"__in_{k}": _padded(f"__p_{k}") for k in PRODUCT_FIELDS}},
    ]


def with_parts(df: DataFrame, column: str) -> DataFrame:
    """Adds what parsers share, step by step, so that each step is computed once: ``obj``, the text of the JSON object, and helper columns.

    One step's columns are used several times by the next, which keeps the optimizer from merging them into one huge expression.
    Columns that no later expression needs are pruned.
    """
    for step in _steps(column):
        df = df.withColumns(step)
    return df


def _any_phrase(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def any_of(patterns: list[str]) -> str:
    """One pattern for all, so that a text is scanned once."""
    return "|".join(patterns)


def _condition_of_text(text: Column) -> Column:
    return (
        F.when(text.rlike(any_of(V.NORMAL_PATTERNS)), "normal")
        .when(text.rlike(any_of(V.ANOMALOUS_PATTERNS)), "anomalous")
        .when(_any_phrase(text, V.NORMAL_PHRASES), "normal")
    )


@built_once
def said_condition() -> Column:
    """normal, anomalous or null."""
    label = F.col("__c_label")
    by_value = F.when(F.col("__c").isNotNull(), F.when(label.isin(V.NORMAL_WORDS), "normal").when(label.isin(V.ANOMALOUS_WORDS), "anomalous").otherwise(_condition_of_text(F.col("__c_text"))))
    none = F.when(_has("defect_type"), _is_null("defect_type")).otherwise(_is_null("defect"))
    by_defect = F.when(none | F.col("__d").isin(V.NO_DEFECT_WORDS), "normal")
    return F.coalesce(F.when(F.col("obj").isNotNull(), F.coalesce(by_value, by_defect)), _condition_of_text(F.col("__text")))


def _longest_alias(padded: Column, aliases: dict[str, str]) -> Column:
    """The value of the longest alias that the padded text holds; of equal length the one stated first."""
    ordered = sorted(aliases, key=len, reverse=True)
    return F.coalesce(*(F.when(F.contains(padded, F.lit(f"_{a}_")), F.lit(aliases[a])) for a in ordered))


@built_once
def said_product() -> Column:
    """One of the categories, or null."""
    aliases = {k: k for k in V.CATEGORIES} | V.PRODUCT_ALIASES
    return F.coalesce(*(_longest_alias(F.col(f"__in_{k}"), aliases) for k in PRODUCT_FIELDS), _longest_alias(F.col("__in_label"), aliases))


#: Ordinals of rows and columns.
ORDINALS = {"first": 1, "1st": 1, "one": 1, "second": 2, "2nd": 2, "two": 2, "third": 3, "3rd": 3, "three": 3}
_ORDINAL = "(" + "|".join(ORDINALS) + ")"
ROW_COLUMN = rf"\b{_ORDINAL}\s+row\s*,?\s*(?:and\s+)?(?:the\s+)?{_ORDINAL}\s+column\b"


def _grid_cell(text: Column) -> Column:
    number = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in pair))
    row, column = (F.try_element_at(number, F.regexp_extract(text, ROW_COLUMN, i)) for i in (1, 2))
    rows, columns = (F.array(*map(F.lit, names)) for names in (("top", "center", "bottom"), ("left", "center", "right")))
    name = F.concat_ws("_", F.get(rows, row - 1), F.get(columns, column - 1))
    return F.when(row.isNotNull() & column.isNotNull(), F.when((row == 2) & (column == 2), "center").otherwise(name))


@built_once
def said_location() -> Column:
    """One of the nine grid cells, or null."""
    aliases = {k: k for k in V.LOCATIONS} | V.LOCATION_ALIASES
    return F.coalesce(_grid_cell(F.col("__l_text")), _longest_alias(F.col("__in_l"), aliases), _grid_cell(F.col("__text")), _longest_alias(F.col("__in_label"), aliases))


@built_once
def said_severity() -> Column:
    """none, minor, moderate, major or null."""
    words = F.create_map(*(F.lit(x) for pair in V.SEVERITY_WORDS.items() for x in pair))
    tokens = F.split("__label", "_")
    return F.coalesce(F.try_element_at(words, F.col("__sv")), *(F.when(F.array_contains(tokens, s), F.lit(s)) for s in V.SEVERITIES))


def canonical_atoms(atoms: Column) -> Column:
    """Sorted distinct atoms with spelling variants and plurals made one."""
    aliases = F.create_map(*(F.lit(x) for pair in V.DEFECT_ALIASES.items() for x in pair))
    return F.array_sort(F.array_distinct(F.transform(atoms, lambda a: F.coalesce(F.try_element_at(aliases, a), a))))


def vocabulary_atoms(df: DataFrame, column: str) -> DataFrame:
    """One-row DataFrame with the sorted atoms of all compound labels of ``column``."""
    return df.select(F.explode(split_compound(column)).alias("a")).agg(F.array_sort(F.collect_set("a")).alias("vocabulary"))


@built_once
def _found_aliases() -> Column:
    """The defect aliases that the text names, longest first."""
    ordered = sorted(V.DEFECT_ALIASES, key=len, reverse=True)
    return F.array_compact(F.array(*(F.when(F.contains(F.col("__in_label"), F.lit(f"_{a}_")), F.lit(a)) for a in ordered)))


def _accepted_aliases(found: Column) -> Column:
    """Without those that are a single word of a longer one."""
    inside = lambda a, longer: (longer != a) & F.contains(F.concat(F.lit("_"), longer, F.lit("_")), F.concat(F.lit("_"), a, F.lit("_")))
    return F.filter(found, lambda a: F.contains(a, F.lit("_")) | ~F.exists(found, lambda longer: inside(a, longer)))


@built_once
def said_defects(vocabulary: str, semantic: bool = False) -> Column:
    """Sorted defect atoms: those of the JSON field, else those of the vocabulary that the text names."""
    keys = ("defect_type", "defect", "issue")
    value, kind = F.lit(None).cast("variant"), F.lit("VOID")
    for k in reversed(keys):
        value, kind = F.when(_has(k), F.col(f"__f_{k}")).otherwise(value), F.when(_has(k), F.col(f"__k_{k}")).otherwise(kind)
    items = F.filter(F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING")
    listed = F.filter(F.transform(items, lambda v: norm_label(F.try_variant_get(v, "$", "string"))), lambda a: a != "")
    as_list, as_text = F.array_sort(F.array_distinct(listed)), split_compound(_first_present(*keys))
    padded, vocabulary = F.col("__in_label"), F.col(vocabulary)
    matches = F.filter(vocabulary, lambda a: (a != "") & F.contains(padded, F.concat(F.lit("_"), a, F.lit("_"))))
    none = F.array().cast("array<string>")
    wrap = canonical_atoms if semantic else (lambda a: a)
    by_text = F.array_sort(matches)
    if semantic:
        aliases = F.create_map(*(F.lit(x) for pair in V.DEFECT_ALIASES.items() for x in pair))
        by_alias = F.transform(_accepted_aliases(F.col("__aliases")), lambda a: F.element_at(aliases, a))
        by_text = F.array_sort(F.array_distinct(F.concat(canonical_atoms(matches), by_alias)))
    there = F.col("obj").isNotNull()
    return F.when(there & (kind == "VOID"), none).when(there & (kind == "STRING"), wrap(as_text)).when(there & kind.startswith("ARRAY"), wrap(as_list)).otherwise(by_text)


UNCERTAINTY = {"abstains": V.ABSTENTION_PHRASES, "unsupported_root_cause": V.ROOT_CAUSE_PHRASES, "unsupported_safety_claim": V.SAFETY_PHRASES}


def parse(df: DataFrame, column: str, what: list[str], vocabulary: str | None = None) -> DataFrame:
    """Adds what the text of ``column`` says.

    ``what``: any of obj, said_condition, said_product, said_location, said_severity, said_defects, said_semantic, and the keys of
    UNCERTAINTY. The defect sets need ``vocabulary``, a column with the known atoms.
    """
    makers = {"said_condition": said_condition, "said_product": said_product, "said_location": said_location, "said_severity": said_severity}
    out = {}
    for name in what:
        if name in makers:
            out[name] = makers[name]()
        elif name in ("said_defects", "said_semantic"):
            out[name] = said_defects(vocabulary, name == "said_semantic")
        elif name in UNCERTAINTY:
            out[name] = _any_phrase(F.col("__text"), UNCERTAINTY[name])
    parts = with_parts(df, column)
    if "said_semantic" in what:
        parts = parts.withColumn("__aliases", _found_aliases())
    keep = [c for c in df.columns if c != vocabulary]
    return parts.select(*keep, *(["obj"] if "obj" in what else []), *(c.alias(k) for k, c in out.items()))
