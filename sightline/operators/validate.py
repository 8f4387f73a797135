"""Checks and constructors of records: problems are columns, bad rows go to a dead-letter output, and strict runs raise at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import vocabulary as V
from sightline.functions.parsers import has_key, json_object_text
from sightline.functions.text import ColumnOrName, col, norm_name, norm_token, strip

#: Accepted names of annotation columns.
HEADER_ALIASES = {
    "object": ["object", "category", "class", "object_name"], "split": ["split", "set", "set_type", "subset"], "label": ["label", "condition", "status", "anomaly"],
    "image": ["image", "image_path", "img", "img_path"], "mask": ["mask", "mask_path", "ground_truth", "gt_path"], "defect_type": ["defect_type", "defect", "anomaly_type", "fault_type"],
}
REQUIRED = ["label", "image", "mask"]
NULL_WORDS = ["none", "null", "na", "nan", ""]
NORMAL_LABELS = ["normal", "good", "0", "false"]
NORMAL_SEGMENTS, ANOMALOUS_SEGMENTS = ["normal", "good"], ["anomaly", "anomalous", "defect", "defective", "bad"]


def resolve_headers(names: list[str]) -> dict[str, str]:
    """Canonical name -> name in the file; raises if label, image or mask is missing."""
    import re

    by_name = {re.sub("[^a-z0-9]+", "_", n.strip().lower()).strip("_"): n for n in names}
    found = {c: by_name[next(a for a in aliases if a in by_name)] for c, aliases in HEADER_ALIASES.items() if any(a in by_name for a in aliases)}
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"annotation columns missing: {missing}")
    return found


def path_segments(path: ColumnOrName) -> Column:
    return F.filter(F.split(F.replace(col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def infer_condition(path: ColumnOrName) -> Column:
    """normal or anomalous by a path segment; normal wins."""
    tokens = F.transform(path_segments(path), norm_token)
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return F.when(has(NORMAL_SEGMENTS), "normal").when(has(ANOMALOUS_SEGMENTS), "anomalous")


def find_category(path: ColumnOrName, categories: list[str] = V.CATEGORIES) -> Column:
    """The first segment that names a category."""
    return F.get(F.filter(F.transform(path_segments(path), norm_token), lambda x: x.isin(categories)), 0)


def candidate_mask(path: ColumnOrName) -> Column:
    """Where the mask of an image should lie: Images read as Masks, with the suffix png."""
    moved = F.array_join(F.transform(F.split(col(path), "/"), lambda x: F.when(x == "Images", "Masks").when(x == "images", "masks").otherwise(x)), "/")
    return F.regexp_replace(moved, r"\.[^./]*$", ".png")


def clean_path(path: ColumnOrName) -> Column:
    """Forward slashes and no leading dots or slashes; null for null-like words."""
    return F.when(~F.coalesce(norm_name(path).isin(NULL_WORDS), F.lit(True)), F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^[./]+", ""))


def path_candidates(path: ColumnOrName, csv_dir: ColumnOrName, root: str, dataset: str = "visa") -> Column:
    """Where a path of an annotation may lie, in the order to try: beside the file, below the root, below the root without a leading dataset folder."""
    clean = clean_path(path)
    parts = F.split(clean, "/")
    rest = F.when(norm_name(F.get(parts, 0)) == dataset, F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")))
    return F.array_compact(F.array(F.concat(col(csv_dir), F.lit("/"), clean), F.concat(F.lit(root + "/"), clean), rest))


def resolve_path(rows: DataFrame, candidates: str, files: DataFrame, ident: str) -> DataFrame:
    """Adds ``resolved``: the first candidate among ``files`` (path), else the first one."""
    tried = rows.select(ident, F.posexplode(candidates).alias("pos", "path")).join(files.select("path").distinct(), "path", "left_semi")
    first = tried.groupBy(ident).agg(F.min_by("path", "pos").alias("__found"))
    return rows.join(first, ident, "left").withColumn("resolved", F.coalesce("__found", F.get(candidates, F.lit(0)))).drop("__found")


def parse_label(label: ColumnOrName) -> dict[str, Column]:
    """condition, defect_type and error of an annotation label."""
    token = norm_name(F.coalesce(col(label), F.lit("")))
    atoms = F.filter(F.transform(F.split(col(label), ","), norm_name), lambda x: x != "")
    empty = token.isin([w for w in NULL_WORDS if w]) | (strip(F.coalesce(col(label), F.lit(""))) == "")
    normal = token.isin(NORMAL_LABELS)
    bad = ~normal & (empty | (F.size(F.coalesce(atoms, F.array().cast("array<string>"))) == 0))
    return {
        "condition": F.when(normal, "normal").when(~bad, "anomalous"),
        "defect_type": F.when(~normal & ~bad, F.array_join(atoms, ",")),
        "error": F.when(~normal & empty, "label is empty").when(bad, "label holds no defect"),
    }


def parse_source_split(value: ColumnOrName) -> Column:
    token = norm_name(F.coalesce(col(value), F.lit("")))
    return F.when(token.isin("train", "training"), "train").when(token.isin("test", "testing", "validation", "val"), "test").otherwise("unknown")


def category_error(named: ColumnOrName, folder: ColumnOrName, expected: list[str] = V.CATEGORIES) -> Column:
    """The first rule that the category of a row breaks, or null."""
    name = F.nullif(norm_name(F.coalesce(col(named), F.lit(""))), F.lit(""))
    chosen = F.coalesce(name, norm_name(folder))
    return F.when(name.isNotNull() & (name != norm_name(folder)), "category differs from folder").when(~F.coalesce(chosen.isin(expected), F.lit(False)), "unexpected category")


def defect_override(explicit: ColumnOrName, from_label: ColumnOrName) -> Column:
    """The explicit defect column where it isn't blank, on normal rows too."""
    return F.coalesce(F.nullif(norm_name(F.coalesce(col(explicit), F.lit(""))), F.lit("")), col(from_label))


def rows_to_records(rows: DataFrame, expected: list[str] = V.CATEGORIES) -> DataFrame:
    """Annotation rows (file, row_number, folder, object, split, label, image, mask, defect_type) as records with the first error of each."""
    label = parse_label("label")
    stem = F.regexp_replace(F.element_at(F.split(clean_path("image"), "/"), -1), r"\.[^.]*$", "")
    category = F.coalesce(F.nullif(norm_name(F.coalesce(F.col("object"), F.lit(""))), F.lit("")), norm_name("folder"))
    image, mask = clean_path("image"), clean_path("mask")
    problem = F.coalesce(
        category_error("object", "folder", expected), label["error"], F.when(image.isNull(), "image path is empty"), F.when((label["condition"] == "normal") & mask.isNotNull(), "normal row has a mask"), F.when((label["condition"] == "anomalous") & mask.isNull(), "anomalous row has no mask")
    )
    return rows.select(
        "file", "row_number", F.concat_ws("_", F.lit("visa"), category, label["condition"], stem).alias("image_id"), category.alias("category"), label["condition"].alias("condition"),
        defect_override("defect_type", label["defect_type"]).alias("defect_type"), parse_source_split("split").alias("source_split"), image.alias("image_path"), mask.alias("mask_path"), problem.alias("error"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``duplicate_of``: the first key that an earlier row has taken, or null.

    A row that is a duplicate by one key doesn't reserve its other keys, so keys are decided one after the other.
    """
    from sightline.storage import cut_lineage

    out = rows.withColumn("duplicate_of", F.lit(None).cast("string"))
    for key in keys:
        alive = F.col("duplicate_of").isNull() & F.col(key).isNotNull()
        first = out.filter(alive).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
        out = out.join(first, key, "left").withColumn("duplicate_of", F.coalesce("duplicate_of", F.when(F.col("__first") < F.struct(*order), F.lit(key)))).drop("__first")
    return cut_lineage(out, "first-wins").select(*rows.columns, "duplicate_of")


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters)."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def strict_gate(dead: DataFrame, strict: bool) -> None:
    """Raises in strict runs if there are dead letters; to be called after all outputs are written."""
    if strict and not dead.isEmpty():
        raise ValueError("strict run with invalid rows")


def message_fields(messages: ColumnOrName = "messages") -> dict[str, Column]:
    """prompt, image and answer of a chat record."""

    def of(role: str, kind: str) -> Column:
        message = F.get(F.filter(col(messages), lambda m: m["role"] == role), 0)
        part = F.get(F.filter(message["content"], lambda p: p["type"] == kind), 0)
        return part["image" if kind == "image" else "text"]

    return {"prompt": of("user", "text"), "image": of("user", "image"), "answer": of("assistant", "text")}


def message_problems(messages: ColumnOrName = "messages") -> Column:
    """Sorted names of the rules on the shape of messages that a record breaks."""
    m = col(messages)
    count = lambda i, kind: F.size(F.filter(F.get(m, i)["content"], lambda p: p["type"] == kind))
    mixed = F.exists(m, lambda x: F.exists(x["content"], lambda p: F.coalesce(((p["type"] == "image") & (p["image"].isNull() | p["text"].isNotNull())) | ((p["type"] == "text") & (p["text"].isNull() | p["image"].isNotNull())), F.lit(True))))
    rules = {
        "two_messages": F.size(m) != 2,
        "roles": (F.get(m, 0)["role"] != "user") | (F.get(m, 1)["role"] != "assistant"),
        "user_parts": (count(0, "image") != 1) | (count(0, "text") != 1),
        "assistant_parts": (count(1, "image") != 0) | (count(1, "text") != 1),
        "mixed_part": mixed,
    }
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(True)), F.lit(k)) for k, v in rules.items()))))


def path_contained(path: ColumnOrName) -> Column:
    """A relative path that never leaves its root."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    step = lambda depth, x: F.when(depth < 0, depth).when(x == "..", depth - 1).when(x.isin("", "."), depth).otherwise(depth + 1)
    return F.coalesce(~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (F.aggregate(F.split(p, "/"), F.lit(0), step) >= 0), F.lit(False))


def path_suffix(path: ColumnOrName, anchor: str = "data/raw/visa") -> Column:
    """The path from the first occurrence of ``anchor`` on whole segments, any case; null if there is none."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return F.nullif(F.regexp_extract(p, rf"(?i)(?:^|/)({anchor}(?:/.*)?)$", 1), F.lit(""))


def report_key_problems(answer: ColumnOrName, fmt: ColumnOrName) -> Column:
    """invalid_json, or the missing keys of a JSON answer; empty for other formats."""
    obj = json_object_text(answer)
    missing = F.array_compact(F.array(*(F.when(~has_key(obj, k), F.lit(f"missing:{k}")) for k in sorted(V.REPORT_KEYS))))
    none = F.array().cast("array<string>")
    whole = strip(answer).startswith("{") & strip(answer).endswith("}")
    return F.when(col(fmt) != "json", none).when(obj.isNull() | ~whole, F.array(F.lit("invalid_json"))).otherwise(missing)


def privileged_markers(answer: ColumnOrName) -> Column:
    """The forbidden markers that an answer shows, sorted."""
    low = F.lower(F.coalesce(col(answer), F.lit("")))
    return F.array_sort(F.filter(F.array(*map(F.lit, V.PRIVILEGED_MARKERS)), lambda m: F.contains(low, m)))


def record_problems(split: ColumnOrName, expected_split: ColumnOrName, task: ColumnOrName, prompt: ColumnOrName, answer: ColumnOrName, fmt: ColumnOrName) -> Column:
    """All problems of an instruction record, one string each."""
    single = [
        F.when(~col(split).eqNullSafe(col(expected_split)), "wrong split"), F.when(~F.coalesce(col(task).isin(V.TASKS), F.lit(False)), "unsupported task"),
        F.when(strip(F.coalesce(col(prompt), F.lit(""))) == "", "empty prompt"), F.when(strip(F.coalesce(col(answer), F.lit(""))) == "", "empty answer"),
    ]
    return F.concat(F.array_compact(F.array(*single)), F.transform(privileged_markers(answer), lambda m: F.concat(F.lit("marker:"), m)), report_key_problems(answer, fmt))


IMAGE_SUFFIXES = r"(?i)\.(jpg|jpeg|png)$"


def benchmark_problems(rows: DataFrame, quotas: DataFrame, images: DataFrame, frozen: DataFrame) -> DataFrame:
    """All that is wrong with a benchmark: (error, key, detail).

    ``rows``: instruction_id, split, task_family, image_id, image, one per line of it; ``quotas``: task_family, n; ``images``: image_id, width, height;
    ``frozen``: fingerprint, of one row or none. Repeated identifiers, other splits than test, task counts, a digest that differs, and images that are
    outside the root, of another kind, unknown or empty.
    """
    from sightline.operators.aggregates import corpus_fingerprint, expected_counts, repeated

    line = lambda df, error, key, detail: df.select(F.lit(error).alias("error"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    twice = line(repeated(rows, "instruction_id"), "duplicate_id", F.col("value"), F.col("n"))
    other = line(rows.filter(~F.col("split").eqNullSafe(F.lit("test"))), "split_mismatch", F.col("instruction_id"), F.col("split"))
    counts = expected_counts(rows.filter("task_family IS NOT NULL").groupBy("task_family").agg(F.count("*").alias("n")).join(quotas.select("task_family"), "task_family", "left_semi"), quotas, "task_family")
    counts = line(counts, "task_quota", F.col("task_family"), F.concat_ws("<>", "expected", "found"))
    # an empty benchmark has a digest of nothing, so it differs as well
    now = corpus_fingerprint(rows.withColumn("__all", F.lit(1)), "instruction_id", ["__all"]).agg(F.max("fingerprint").alias("now"))
    was = frozen.agg(F.max("fingerprint").alias("was"))
    digest = now.join(F.broadcast(was)).filter("now IS DISTINCT FROM was")  # one row each
    digest = line(digest, "digest_mismatch", F.col("now"), F.col("was"))
    seen = rows.select("image_id", "image").distinct().join(images.select("image_id", "width", "height", F.lit(True).alias("known")), "image_id", "left")
    bad = F.when(~path_contained("image"), "outside the root").when(~F.col("image").rlike(IMAGE_SUFFIXES), "unsupported kind").when(F.col("known").isNull(), "not found")
    bad = bad.when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "empty")
    pictures = line(seen.withColumn("why", bad).filter("why IS NOT NULL"), "image", F.coalesce("image_id", "image"), F.col("why"))
    return twice.unionByName(other).unionByName(counts).unionByName(digest).unionByName(pictures)


def threshold_gate(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, value, bound, low or high, passed). ``metrics``: name, value; ``thresholds``: name, kind (min or max), bound. A missing value fails."""
    both = thresholds.join(metrics, "name", "left")
    ok = F.when(F.col("value").isNull(), False).when(F.col("kind") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return both.select("name", "kind", "bound", "value", ok.alias("passed"))


def release_status(checks: DataFrame) -> DataFrame:
    """One row: blocked if any check failed, else pending if any is pending, else ready; and the counts. ``checks``: status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pass", "pending", "fail")]
    return checks.agg(*counts).withColumn("state", F.when(F.col("fail") > 0, "blocked").when(F.col("pending") > 0, "pending").otherwise("ready"))

