"""Order keys that don't depend on partitioning, row order or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import ColumnOrName, col


def stable_key(*parts: ColumnOrName) -> Column:
    """sha256 of the parts joined by a vertical bar; a null part counts as the empty string."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(p).cast("string"), F.lit("")) for p in parts)), 256)


def tie_breaker(seed: ColumnOrName, value: ColumnOrName) -> Column:
    """sha256 of ``seed:value``."""
    return F.sha2(F.concat(col(seed).cast("string"), F.lit(":"), col(value).cast("string")), 256)


def unit(hexdigest: Column) -> Column:
    """The first 13 hex digits as a number in [0, 1): 52 bits, exact in a double."""
    return F.conv(F.substring(hexdigest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform(seed: ColumnOrName, value: ColumnOrName) -> Column:
    """A reproducible uniform number in [0, 1) for ``value`` under ``seed``."""
    return unit(tie_breaker(seed, value))
