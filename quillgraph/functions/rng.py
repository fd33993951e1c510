"""A portable random source: 32 bits of md5(key), the same in Spark, DuckDB and Python."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(*parts) -> Column:
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    return u32(*parts) / F.lit(float(1 << 32))


def u32_py(*parts) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def u32_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::bigint)"
