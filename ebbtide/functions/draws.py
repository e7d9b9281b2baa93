"""Random draws as pure functions of a key.

``rand(seed)`` depends on the partition a row sits in, so a lost executor or another
cluster size changes it. Hashing the row's own key does not. One md5 holds four
independent 32-bit uniforms (``part`` 0 to 3), so rows that need several draws hash once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_TO_32 = 4294967296.0


def uniform(key: list[Column], salt: str, part: int = 0) -> Column:
    """A draw from [0, 1) that is fixed by the key, the salt and the part."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key], F.lit(salt)))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint") / F.lit(TWO_TO_32)


def normal(key: list[Column], salt: str, part: int = 0) -> Column:
    """Standard normal by Box-Muller from parts ``part`` and ``part + 1``."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(key, salt, part)))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(key, salt, part + 1))
