"""Getting archives onto disk before Spark reads them. These steps run on the driver."""

from __future__ import annotations

import os
import tarfile
import urllib.error
import urllib.request
from pathlib import Path


def head(url: str, timeout: float = 30) -> dict[str, str | int | None]:
    """Length, etag and time of a resource; nulls where the server doesn't tell or can't be reached."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            size = answer.headers.get("Content-Length")
            return {"length": int(size) if size else None, "etag": answer.headers.get("ETag"), "modified": answer.headers.get("Last-Modified")}
    except (urllib.error.URLError, OSError, ValueError):
        return {"length": None, "etag": None, "modified": None}


def download(url: str, target: str, chunk: int = 1 << 20, timeout: float = 60, force: bool = False) -> int:
    """Fetches ``url``, continuing a partial file; returns the size.

    A server that ignores the range makes it start again; "range not satisfiable" means the part is whole. The length told by the
    server is checked before the part is moved into place.
    """
    path, part = Path(target), Path(target + ".part")
    if path.exists() and not force:
        return path.stat().st_size
    path.parent.mkdir(parents=True, exist_ok=True)
    if force:
        part.unlink(missing_ok=True)
    expected, have = head(url, timeout)["length"], part.stat().st_size if part.exists() else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer, open(part, "ab" if have and answer.status == 206 else "wb") as out:
            while block := answer.read(chunk):
                out.write(block)
    except urllib.error.HTTPError as error:
        if error.code != 416:
            raise
    size = part.stat().st_size
    if expected is not None and size != expected:
        raise OSError(f"{size} bytes of {expected} arrived")
    os.replace(part, path)
    return size


def extract(archive: str, target: str, force: bool = False) -> str:
    """Unpacks a tar; refuses links and paths that leave ``target``; returns the single top folder, or ``target``."""
    root = Path(target).resolve()
    root.mkdir(parents=True, exist_ok=True)
    with tarfile.open(archive) as tar:
        members = tar.getmembers()
        for m in members:
            where = (root / m.name).resolve()
            if m.issym() or m.islnk() or not (m.isfile() or m.isdir()) or (where != root and root not in where.parents):
                raise ValueError(f"unsafe member: {m.name}")
        for m in members:
            if m.isfile() and (root / m.name).exists() and not force:
                continue
            tar.extract(m, root, filter="data")
    tops = {Path(m.name).parts[0] for m in members if Path(m.name).parts}
    return str(root / tops.pop()) if len(tops) == 1 else str(root)


def acquire(url: str, archive: str, target: str, expected: dict[str, int], receipt: str, force: bool = False) -> dict[str, object]:
    """Downloads, digests and unpacks an archive, counts its files by suffix, checks the counts, and writes a receipt of all that.

    ``expected``: suffix (lower case, with its dot) -> number of files. Counts that differ raise, after the receipt is written.
    """
    import hashlib
    from collections import Counter
    from datetime import UTC, datetime

    from sightline.sources.sinks import atomic_json

    remote = head(url)
    size = download(url, archive, force=force)
    digest = hashlib.sha256()
    with open(archive, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    root = extract(archive, target, force)
    found = Counter(p.suffix.lower() for p in Path(root).rglob("*") if p.is_file())
    wrong = {suffix: {"expected": n, "found": found[suffix]} for suffix, n in sorted(expected.items()) if found[suffix] != n}
    facts = {"url": url, "remote": remote, "bytes": size, "sha256": digest.hexdigest(), "root": root, "files": dict(sorted(found.items())), "differences": wrong, "acquired_at_utc": datetime.now(UTC).isoformat()}
    atomic_json(facts, receipt)
    if wrong:
        raise ValueError(f"unexpected numbers of files: {wrong}")
    return facts


def load_config(path: str, fields: dict[str, type]) -> dict[str, object]:
    """A YAML or JSON mapping with just the known fields, of the known types."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        import json

        tree = json.loads(text)
    else:
        import yaml

        tree = yaml.safe_load(text)
    if not isinstance(tree, dict):
        raise ValueError("a mapping is expected")
    unknown = sorted(set(tree) - set(fields))
    wrong = sorted(k for k, v in tree.items() if k in fields and not isinstance(v, fields[k]))
    if unknown or wrong:
        raise ValueError(f"unknown fields {unknown}, wrong types {wrong}")
    return tree
