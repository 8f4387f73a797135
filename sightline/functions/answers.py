"""Template answers as Column expressions over image rows.

Columns: category, condition, defect_type, nine_grid_location, anomaly_area_ratio, visual_severity. The wording is fixed.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import humanize

MISSING = "unspecified visual anomaly"


#: The wording of each kind of answer, for normal images and for others.
WORDING = {
    "binary": (
        "The item is normal. The dataset annotation contains no anomaly mask for this image, so no defect is identified.",
        "The item is defective. The annotated defect is {defect} in the {place} region.",
    ),
    "product": ("The product category is {category}.", "The product category is {category}."),
    "defect": ("No defect is annotated for this image.", "The annotated defect is {defect}."),
    "location": ("No anomaly location is available because the image is annotated as normal.", "The anomaly centroid falls in the {place} region."),
    "explanation": (
        "This image is classified as normal because the source annotation provides no anomaly mask or defect label. This does not prove the absence of every possible real-world issue; it reflects the available annotation.",
        "The inspection fails because the source annotation marks {defect}. The mask covers {percent}% of the image and its centroid lies in the {place} region. The project-defined visual severity is {severity}.",
    ),
    "technician": (
        "QC note: {category} sample appears normal under the supplied annotation. No anomaly region is marked.",
        "QC note: Reject {category} sample for manual review. Annotated issue: {defect}; location: {place}; visual severity: {severity}.",
    ),
    "uncertainty": (
        "No root cause can be determined from this image. The source only indicates that no visual anomaly was annotated.",
        "The visible annotation supports describing {defect}, but the mechanical root cause and safety impact cannot be established from this image alone.",
    ),
}
#: What reports recommend for normal images and for others, and their note.
ACTIONS = ("Accept under the current visual inspection criteria.", "Send the item for manual verification and do not pass automatic quality control.")
SAFETY_NOTE = "Mechanical safety and root cause cannot be determined from this image alone."


def pieces(form: str) -> list[tuple[str, str | None]]:
    """Text and the name of the part that follows it, for each part of a wording."""
    return [(text, name) for text, name, _, _ in Formatter().parse(form)]


def _filled(form: str, parts: dict[str, Column]) -> Column:
    """The wording with a column for each name; null where a part is."""
    out = []
    for words, name in pieces(form):
        out += [F.lit(words)] * bool(words) + ([parts[name]] if name else [])
    return F.concat(*out)


def status() -> Column:
    return F.when(F.col("condition") == "anomalous", "defective").otherwise("normal")


def location_text() -> Column:
    return humanize(F.nullif(F.col("nine_grid_location"), F.lit("")), MISSING)


def percent_text(ratio: Column) -> Column:
    """The ratio in percent with three decimals of its exact binary value, ties to even.

    The built-in format rounds the shortest decimal form, half up, which differs only where that form ends in a 5 at the fourth decimal. There
    the difference from the tie decides, which two halves of the number give exactly.
    """
    r = ratio * 100
    product = r * 10_000
    nearest = F.rint(product)
    split = r * float(2**27 + 1)
    high = split - (split - r)
    beyond = (product - nearest) + ((high * 10_000 - product) + (r - high) * 10_000)
    below = F.floor(nearest / 10).cast("bigint")
    tie = (F.abs(product - nearest) < 1e-6) & (F.pmod(nearest, F.lit(10.0)) == 5.0)
    thousandths = below + ((beyond > 0) | ((beyond == 0) & (below % 2 == 1))).cast("bigint")
    whole = F.floor(thousandths / 1000).cast("bigint")
    return F.when(tie, F.format_string("%d.%03d", whole, thousandths - whole * 1000)).otherwise(F.format_string("%.3f", r))


def _json_text(c: Column) -> Column:
    escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', '\\\\"')
    return F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null"))


def answers() -> dict[str, Column]:
    """The answer of each kind."""
    normal = F.col("condition") == "normal"
    defect, place, kind = humanize(F.nullif(F.col("defect_type"), F.lit("")), MISSING), location_text(), F.col("category")
    parts = {"defect": defect, "place": place, "category": kind, "severity": F.col("visual_severity"), "percent": percent_text(F.col("anomaly_area_ratio"))}
    out = {name: F.when(normal, _filled(if_normal, parts)).otherwise(_filled(other, parts)) for name, (if_normal, other) in WORDING.items()}
    fields = {
        "condition": _json_text(status()), "defect_type": _json_text(F.when(~normal, defect)), "location": _json_text(F.when(~normal, place)), "product": _json_text(kind),
        "recommended_action": _json_text(F.when(normal, ACTIONS[0]).otherwise(ACTIONS[1])), "safety_note": F.lit(f'"{SAFETY_NOTE}"'), "visual_severity": _json_text(F.col("visual_severity")),
    }
    inner = [x for i, (name, c) in enumerate(fields.items()) for x in (F.lit((", " if i else "") + f'"{name}": '), c)]
    out["json"] = F.concat(F.lit("{"), *inner, F.lit("}"))
    return out
