"""Seeded draws as pure functions of row keys, so plans do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = 1 << 60  # 15 hex digits


def draw(*parts) -> Column:
    """Uniform bigint in ``[0, 2**60)`` from the ``:``-joined parts (columns or literals)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in the open interval (0, 1)."""
    return (draw(*parts).cast("double") + 1.0) / float(SPAN + 1)


def gaussian(*parts) -> Column:
    """Standard normal value from two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(*parts, "u")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(*parts, "v"))
