"""Writers of records, assignments, reports and bundles."""

from __future__ import annotations

import html
import json
import os
import shutil
import tarfile
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line; nulls are kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def partitioned_jsonl(df: DataFrame, path: str, split: str, order: str, files_per_split: int = 1) -> None:
    """A folder per split, ordered by ``order``: rows are spread by range, so that files can be read one after the other."""
    ranged = df.repartitionByRange(files_per_split * 3, split, order).sortWithinPartitions(split, order)
    ranged.write.partitionBy(split).option("ignoreNullFields", "false").json(path)


def csv_assignments(df: DataFrame, path: str, columns: list[str], order: str) -> None:
    """Columns as text, null as the empty string, ordered."""
    rows = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("header", "true").option("emptyValue", "").csv(path)


def union_columns(frames: list[DataFrame]) -> DataFrame:
    """Rows of all, with the sorted union of their columns."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*sorted(out.columns))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def report(df: DataFrame, limit: int = 100_000) -> list[dict]:
    """Rows of a small aggregate as plain values for a JSON report."""
    from sightline.storage import bounded_rows

    return [r.asDict(recursive=True) for r in bounded_rows(df, limit, "report")]


def atomic_json(tree: object, path: str) -> None:
    """Indented JSON, moved into place once it is whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".tmp")
    draft.write_text(json.dumps(tree, indent=2, ensure_ascii=False, default=str) + "\n", encoding="utf-8")
    os.replace(draft, target)


def mirror(source: str, target: str) -> bool:
    """Copies a file beside its target and moves it into place; false if there is nothing to copy."""
    if not Path(source).is_file():
        return False
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    draft = target + ".tmp"
    shutil.copyfile(source, draft)
    os.replace(draft, target)
    return True


def gallery(df: DataFrame, columns: list[str], path: str, limit: int = 500) -> dict[str, int]:
    """An HTML page with one card per row of a small sample; returns how many values of each column it covers."""
    rows = report(df.select(*columns), limit)
    cards = ["<div class='card'>" + "".join(f"<p><b>{html.escape(c)}</b> {html.escape(str(r[c]))}</p>" for c in columns) + "</div>" for r in rows]
    Path(path).write_text("<!doctype html><meta charset='utf-8'><body>" + "\n".join(cards) + "</body>", encoding="utf-8")
    return {c: len({str(r[c]) for r in rows}) for c in columns}


def dataset_card(title: str, facts: dict[str, object], path: str) -> None:
    """A markdown card of a summary."""
    lines = [f"# {title}", "", *(f"- **{k}**: {v}" for k, v in facts.items()), ""]
    Path(path).write_text("\n".join(lines), encoding="utf-8")


def tar_bundle(folders: list[str], target: str) -> dict[str, int]:
    """A tar.gz of folders; returns how many files each holds."""
    counts = {}
    with tarfile.open(target, "w:gz") as tar:
        for folder in folders:
            names = sorted(p for p in Path(folder).rglob("*") if p.is_file())
            counts[folder] = len(names)
            for p in names:
                tar.add(p, arcname=str(Path(Path(folder).name) / p.relative_to(folder)))
    return counts


def snapshot_zip(root: str, target: str, excluded: list[str], max_bytes: int) -> list[dict]:
    """A zip of a tree without excluded names and large files, with a manifest of sizes and digests."""
    import hashlib

    manifest = []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(root).rglob("*")):
            relative = p.relative_to(root)
            if not p.is_file() or p.resolve() == Path(target).resolve() or any(part in excluded for part in relative.parts) or p.stat().st_size > max_bytes:
                continue
            z.write(p, str(relative))
            manifest.append({"path": relative.as_posix(), "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()})
        z.writestr("MANIFEST.json", json.dumps(manifest, indent=2))
    return manifest
