"""Evaluation of predictions: one projection parses every text once, and all metrics aggregate over it.

Rows: instruction_id, task_family, category, condition, defect_type, location, visual_severity, prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vocabulary as V
from sightline.functions.parsers import UNCERTAINTY, canonical_atoms, parse, vocabulary_atoms
from sightline.functions.text import built_once, split_compound
from sightline.operators.metrics import UNPARSED, adjacent, safe_divide, set_scores
from sightline.storage import cut_lineage

FACT_TASKS = ["evidence_explanation", "technician_note"]
LABEL_TASKS = ["binary_inspection", "product_identification", "localization"]


def parsed(rows: DataFrame, vocabulary_from: DataFrame | None = None) -> DataFrame:
    """Rows with everything that texts say, and the true and said defect sets, strict and semantic.

    The vocabulary is the set of defect atoms of ``vocabulary_from`` (default: the rows), as small as the set of labels.
    """
    vocabulary = vocabulary_atoms(vocabulary_from if vocabulary_from is not None else rows, "defect_type")
    keyed = rows.filter(F.col("prediction").isNotNull()).join(F.broadcast(vocabulary))  # vocabulary: one row
    keyed = keyed.withColumns({"true_defects": split_compound("defect_type"), "true_semantic": canonical_atoms(split_compound("defect_type"))})
    return parse(keyed, "prediction", ["obj", "said_condition", "said_product", "said_location", "said_severity", "said_defects", "said_semantic", *UNCERTAINTY], "vocabulary")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


@built_once
def _score_steps() -> list[dict[str, Column]]:
    """The columns of ``evaluated``, step by step."""
    strict, semantic = set_scores("true_defects", "said_defects"), set_scores("true_semantic", "said_semantic")
    keys = F.coalesce(F.json_object_keys("obj"), F.array().cast("array<string>"))
    required = F.array(*map(F.lit, V.REPORT_KEYS))
    scores = {
        "condition_correct": _same("said_condition", "condition"), "product_correct": _same("said_product", "category"), "location_correct": _same("said_location", "location"), "severity_correct": _same("said_severity", "visual_severity"),
        "adjacent": adjacent("location", "said_location"), **{f"strict_{k}": v for k, v in strict.items()}, **semantic,
        "json_valid": F.col("obj").isNotNull(), "present": F.size(F.array_intersect(keys, required)), "unsupported": F.size(F.array_except(keys, required)),
    }
    product_ok = F.col("said_product").isNull() | F.col("product_correct")
    location_ok = F.col("said_location").isNull() | F.col("location_correct")
    coverage = (F.col("condition_correct").cast("double") + product_ok.cast("double") + F.col("strict_f1") + location_ok.cast("double")) / 4
    facts = {"schema_valid": F.col("json_valid") & (F.col("present") == len(V.REPORT_KEYS)), "completeness": F.col("present") / F.lit(float(len(V.REPORT_KEYS))), "fact_coverage": coverage}
    task = F.col("task_family")
    report = (task == "structured_report") & F.col("json_valid")
    fact = ~task.isin([t for t in V.TASKS if t not in FACT_TASKS])
    partial = F.when(F.col("f1") > 0, "partial_compound_defect").otherwise("wrong_defect")
    tags = {
        "root": F.when(F.col("unsupported_root_cause"), "unsupported_root_cause"), "safety": F.when(F.col("unsupported_safety_claim"), "unsupported_safety_claim"),
        "binary": F.when((task == "binary_inspection") & ~F.col("condition_correct"), F.when(F.col("condition").eqNullSafe(F.lit("anomalous")), "false_negative").otherwise("false_positive")),
        "product": F.when((task == "product_identification") & ~F.col("product_correct"), "wrong_product"), "defect": F.when((task == "defect_identification") & ~F.col("exact_match"), partial),
        "place": F.when((task == "localization") & ~F.col("location_correct"), F.when(F.col("adjacent"), "adjacent_location").otherwise("wrong_location")),
        "json": F.when((task == "structured_report") & ~F.col("json_valid"), "invalid_json"), "missing": F.when(report & ~F.col("schema_valid"), "missing_required_field"), "extra": F.when(report & (F.col("unsupported") > 0), "unsupported_field"),
        "r_condition": F.when(report & ~F.col("condition_correct"), "wrong_condition"), "r_product": F.when(report & ~F.col("product_correct"), "wrong_product"), "r_defect": F.when(report & ~F.col("exact_match"), "wrong_defect"),
        "r_location": F.when(report & ~F.col("location_correct"), "wrong_location"), "r_severity": F.when(report & ~F.col("severity_correct"), "wrong_severity"),
        "abstain": F.when((task == "uncertainty") & ~F.col("abstains"), "failed_to_abstain"), "facts": F.when(fact & (F.col("fact_coverage") < 1), "incomplete_or_incorrect_facts"),
    }
    return [scores, facts, {"tags": F.array_sort(F.array_distinct(F.array_compact(F.array(*tags.values()))))}]


def evaluated(rows: DataFrame) -> DataFrame:
    """Parsed rows with scores of all kinds and the sorted failure tags of their task."""
    for step in _score_steps():
        rows = rows.withColumns(step)
    return rows


def _truth_and_said() -> tuple[Column, Column]:
    """True and said label of a row of one of the label tasks; a missing truth is the label None."""
    task = F.col("task_family")
    choose = lambda binary, product, place: F.when(task == "binary_inspection", F.col(binary)).when(task == "product_identification", F.col(product)).when(task == "localization", F.col(place))
    return F.coalesce(choose("condition", "category", "location"), F.lit("None")), choose("said_condition", "said_product", "said_location")


def label_metrics(rows: DataFrame) -> DataFrame:
    """(task_family, metric, label, said, value) of the label tasks.

    Per task count, accuracy, macro means and what was unparsed, per label precision, recall, f1 and support, and the confusion of all
    labels, zeros included. One aggregation over the rows yields the cells; all else is as small as they are.
    """
    truth, said = _truth_and_said()
    own = rows.filter(F.col("task_family").isin(LABEL_TASKS))
    cells = own.groupBy("task_family", truth.alias("truth"), F.coalesce(said, F.lit(UNPARSED)).alias("predicted")).agg(F.count("*").alias("n"), F.count_if("adjacent").alias("near"))
    cells = cut_lineage(cells, "cells")
    none, task = F.lit(None).cast("string"), "task_family"
    row = lambda metric, value, label=none, with_=none: F.struct(F.lit(metric).alias("metric"), label.alias("label"), with_.alias("said"), value.cast("double").alias("value"))
    right, lost = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("predicted") == UNPARSED, F.col("n")).otherwise(0))
    whole = cells.groupBy(task).agg(F.sum("n").alias("n"), right.alias("right"), lost.alias("lost"), F.sum("near").alias("near"))
    whole = whole.select(task, F.explode(F.array(row("count", F.col("n")), row("accuracy", F.col("right") / F.col("n")), row("unparseable_count", F.col("lost")), row("unparseable_rate", F.col("lost") / F.col("n")), row("adjacent_tolerance_accuracy", F.col("near") / F.col("n")))).alias("r"))
    whole = whole.filter("r.metric <> 'adjacent_tolerance_accuracy' OR task_family = 'localization'")
    sides = cells.select(task, "n", (F.col("truth") == F.col("predicted")).alias("hit"), F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(True).alias("true")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("true")))).alias("s"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    labels = sides.groupBy(task, F.col("s.label").alias("label")).agg(total(F.col("s.true") & F.col("hit")).alias("tp"), total(F.col("s.true")).alias("support"), total(~F.col("s.true")).alias("said")).filter(F.col("label") != UNPARSED)
    labels = labels.select(task, "label", "support", safe_divide("tp", "said").alias("precision"), safe_divide("tp", "support").alias("recall"))
    labels = labels.withColumn("f1", safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    macro = labels.groupBy(task).agg(*(F.avg(m).alias(m) for m in ("precision", "recall", "f1"))).select(task, F.explode(F.array(*(row(f"macro_{m}", F.col(m)) for m in ("precision", "recall", "f1")))).alias("r"))
    each = labels.select(task, F.explode(F.array(*(row(m, F.col(m), F.col("label")) for m in ("precision", "recall", "f1", "support")))).alias("r"))
    columns = cells.groupBy(task).agg(F.collect_set("predicted").alias("c"))  # labels
    spine = cells.select(task, "truth").distinct().join(columns, task).select(task, "truth", F.explode("c").alias("predicted"))
    dense = spine.join(cells.drop("near"), [task, "truth", "predicted"], "left").select(task, row("confusion", F.coalesce("n", F.lit(0)), F.col("truth"), F.col("predicted")).alias("r"))
    return whole.unionByName(macro).unionByName(each).unionByName(dense).select(task, "r.*")


def plain_metrics(rows: DataFrame) -> DataFrame:
    """(task_family, metric, value) of the other tasks: every task has its own metrics, one aggregation yields them all."""
    valid = F.col("json_valid")
    mean = lambda c: F.avg(c.cast("double"))
    by_task = {
        "defect_identification": {k: mean(F.col(k)) for k in ("exact_match", "precision", "recall", "f1", "strict_exact_match", "strict_precision", "strict_recall", "strict_f1")},
        "structured_report": {
            "json_valid_rate": mean(valid), "schema_valid_rate": mean(F.col("schema_valid")), "field_completeness": mean(F.when(valid, F.col("completeness")).otherwise(0.0)), "condition_accuracy": mean(valid & F.col("condition_correct")),
            "product_accuracy": mean(valid & F.col("product_correct")), "defect_f1": mean(F.when(valid, F.col("f1")).otherwise(0.0)), "strict_defect_f1": mean(F.when(valid, F.col("strict_f1")).otherwise(0.0)),
            "location_accuracy": mean(valid & F.col("location_correct")), "severity_accuracy": mean(valid & F.col("severity_correct")), "unsupported_field_rate": mean(valid & (F.col("unsupported") > 0)),
        },
        "uncertainty": {"appropriate_abstention_accuracy": mean(F.col("abstains") & ~F.col("unsupported_root_cause") & ~F.col("unsupported_safety_claim"))},
    }
    claims = {"unsupported_root_cause_rate": mean(F.col("unsupported_root_cause")), "unsupported_safety_claim_rate": mean(F.col("unsupported_safety_claim"))}
    by_task |= {t: {"mean_fact_coverage": mean(F.col("fact_coverage")), **claims} for t in FACT_TASKS}
    by_task["uncertainty"] |= claims
    names = sorted({m for ms in by_task.values() for m in ms})
    cells = []
    for name in names:
        value = F.lit(None).cast("double")
        for t, ms in by_task.items():
            if name in ms:
                value = F.when(F.col("task_family") == t, ms[name]).otherwise(value)
        cells.append(F.struct(F.lit(name).alias("metric"), value.alias("value")))
    own = rows.filter(~F.coalesce(F.col("task_family").isin(LABEL_TASKS), F.lit(False)))
    flat = own.groupBy("task_family").agg(F.array(F.struct(F.lit("count").alias("metric"), F.count("*").cast("double").alias("value")), *cells).alias("m"))
    return flat.select("task_family", F.explode("m").alias("m")).select("task_family", "m.metric", "m.value").filter("value IS NOT NULL")


#: The metrics of ``plain_metrics``, as columns of the report per task.
PLAIN = [
    "count", "exact_match", "precision", "recall", "f1", "strict_exact_match", "strict_precision", "strict_recall", "strict_f1", "json_valid_rate", "schema_valid_rate", "field_completeness", "condition_accuracy", "product_accuracy", "defect_f1",
    "strict_defect_f1", "location_accuracy", "severity_accuracy", "unsupported_field_rate", "appropriate_abstention_accuracy", "mean_fact_coverage", "unsupported_root_cause_rate", "unsupported_safety_claim_rate",
]


def task_metrics(rows: DataFrame) -> DataFrame:
    """(task_family, metric, label, said, value) of all tasks in long form; label and said are null but for metrics of labels."""
    none = F.lit(None).cast("string")
    return plain_metrics(rows).select("task_family", "metric", none.alias("label"), none.alias("said"), "value").unionByName(label_metrics(rows))


def category_rollup(rows: DataFrame) -> DataFrame:
    """Rows, failure rate and claim rates per category."""
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.avg((F.size("tags") > 0).cast("double")).alias("failure_rate"), F.avg(F.col("unsupported_root_cause").cast("double")).alias("root_cause_rate"), F.avg(F.col("unsupported_safety_claim").cast("double")).alias("safety_claim_rate"))


def overall(rows: DataFrame) -> DataFrame:
    """(tag, n) of every tag, and evaluated and failed rows under ``*evaluated`` and ``*failed``."""
    marks = F.concat(F.array(F.lit("*evaluated")), F.when(F.size("tags") > 0, F.array(F.lit("*failed"))).otherwise(F.array().cast("array<string>")), F.col("tags"))
    return rows.select(F.explode(marks).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def unparsed_rows(rows: DataFrame) -> DataFrame:
    """Rows of the three label tasks whose text gave no label."""
    return rows.filter(F.col("task_family").isin(LABEL_TASKS) & _truth_and_said()[1].isNull())


def set_label(atoms: Column) -> Column:
    """The atoms joined by +, or a mark for none."""
    return F.coalesce(F.nullif(F.array_join(atoms, "+"), F.lit("")), F.lit("**unparsed**"))


def failure_analysis(rows: DataFrame) -> DataFrame:
    """Defects and locations of anomalous rows: (kind, metric, value, truth, said, n, rank).

    Metrics: records (of kind all, too), exact, unparsed and, of locations, adjacent; task by task_family and errors by category in ``value``; confusion per
    (truth, said), those that differ ranked per kind by (n descending, truth, said). A row without a true location is an error.
    """
    from pyspark.sql import Window

    bad, no = rows.filter((F.col("condition") == "anomalous")), F.lit(False)
    defects = bad.filter(F.col("task_family").isin(V.DEFECT_TASKS)).select(F.lit("defect").alias("kind"), "task_family", "category", set_label(F.col("true_semantic")).alias("truth"), set_label(F.col("said_semantic")).alias("said"), no.alias("adjacent"))
    places = bad.filter(F.col("task_family").isin(V.LOCALIZATION_TASKS)).select(F.lit("location").alias("kind"), "task_family", "category", F.coalesce("location", F.lit("**missing_truth**")).alias("truth"), F.coalesce("said_location", F.lit("**unparsed**")).alias("said"), "adjacent")
    sorts = ["kind", "task_family", "category", "truth", "said"]
    combos = cut_lineage(defects.unionByName(places).groupBy(*sorts).agg(F.count("*").alias("n"), F.count_if("adjacent").alias("near")), "combos")  # labels only

    none, wrong, zero = F.lit(None).cast("string"), F.col("truth") != F.col("said"), F.lit(0).cast("bigint")
    cell = lambda metric, n, value=none: F.struct(F.lit(metric).alias("metric"), value.alias("value"), n.alias("n"))
    if_ = lambda c: F.when(c, F.col("n")).otherwise(zero)
    cells = [cell("records", F.col("n")), cell("exact", if_(~wrong)), cell("unparsed", if_(F.col("said") == "**unparsed**")), cell("task", F.col("n"), F.col("task_family")), cell("errors", if_(wrong), F.coalesce("category", F.lit("**unknown**")))]
    near = F.when(F.col("kind") == "location", F.array(cell("adjacent", F.col("near")))).otherwise(F.array().cast("array<struct<metric:string,value:string,n:bigint>>"))
    counts = combos.select("kind", F.explode(F.concat(F.array(*cells), near)).alias("c")).select("kind", "c.*")
    spine = rows.sparkSession.createDataFrame([(k, m, None, 0) for k in ("defect", "location") for m in ("records", "exact", "unparsed", *["adjacent"][: k == "location"])], "kind string, metric string, value string, n bigint")
    counts = counts.unionByName(spine).groupBy("kind", "metric", "value").agg(F.sum("n").alias("n")).filter("metric <> 'errors' OR n > 0")
    counts = counts.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), F.lit("records").alias("metric"), none.alias("value"), "n"))
    confusion = combos.groupBy("kind", "truth", "said").agg(F.sum("n").alias("n")).withColumns({"metric": F.lit("confusion"), "value": none})
    place = F.row_number().over(Window.partitionBy("kind", wrong).orderBy(F.desc("n"), "truth", "said")).cast("bigint")  # pairs of labels
    confusion = confusion.withColumn("rank", F.when(wrong, place))
    out = ["kind", "metric", "value", "truth", "said", "n", "rank"]
    return counts.withColumns({"truth": none, "said": none, "rank": F.lit(None).cast("bigint")}).select(*out).unionByName(confusion.select(*out))


def error_profile(rows: DataFrame) -> DataFrame:
    """Weights of mistakes: (kind, category, item, w) counts of wrong anomalous rows per true defect atom and per true location."""
    bad = rows.filter(F.col("condition") == "anomalous")
    atoms = bad.filter(F.col("task_family").isin(V.DEFECT_TASKS) & ~F.col("exact_match")).select(F.lit("defect").alias("kind"), "category", F.explode("true_semantic").alias("item"))
    places = bad.filter(F.col("task_family").isin(V.LOCALIZATION_TASKS) & F.col("location").isNotNull() & ~F.col("location_correct")).select(F.lit("location").alias("kind"), "category", F.col("location").alias("item"))
    return atoms.unionByName(places).groupBy("kind", "category", "item").agg(F.count("*").alias("w"))


#: Rows of a table of weights that may be broadcast, as maps per category; beyond it weights are joined by a shuffle.
MAX_WEIGHTS = 50_000


def hard_scores(records: DataFrame, weights: DataFrame) -> DataFrame:
    """Records with ``score``: the weights of their defect atoms and location under their category, where their task counts them.

    Weights are as many as labels, so records look them up in a broadcast map and aren't shuffled.
    """
    none = F.array().cast("array<string>")
    defect = F.when(F.col("task_family").isin(V.DEFECT_WEIGHTED_TASKS), canonical_atoms(split_compound("defect_type"))).otherwise(none)
    place = F.when(F.col("task_family").isin(V.LOCATION_WEIGHTED_TASKS) & F.col("location").isNotNull(), F.array(F.col("location"))).otherwise(none)
    items = F.concat(F.transform(defect, lambda a: F.concat(F.lit("defect:"), a)), F.transform(place, lambda a: F.concat(F.lit("location:"), a)))
    keyed = records.withColumn("__items", items)
    named = weights.filter("category IS NOT NULL").select("category", F.concat_ws(":", "kind", "item").alias("__item"), F.col("w").cast("bigint").alias("w"))
    if weights.limit(MAX_WEIGHTS + 1).count() <= MAX_WEIGHTS:
        maps = named.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("__item", "w"))).alias("__weights"))
        found = F.aggregate("__items", F.lit(0).cast("bigint"), lambda sum_, i: sum_ + F.coalesce(F.try_element_at("__weights", i), F.lit(0)))
        return keyed.join(F.broadcast(maps), "category", "left").withColumn("score", F.coalesce(found, F.lit(0)).cast("bigint")).drop("__items", "__weights").select(*records.columns, "score")
    sums = keyed.select("instruction_id", "category", F.explode("__items").alias("__item")).join(named, ["category", "__item"]).groupBy("instruction_id").agg(F.sum("w").cast("bigint").alias("score"))
    return records.join(sums, "instruction_id", "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("bigint"))
