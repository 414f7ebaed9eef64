"""Reproducible random draws as column expressions.

A draw depends only on its key columns, so a lost task redraws the same number and two
engines that hash the same text agree.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60
_RANGE = float(2**DRAW_BITS)


def _text(part: object) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw(*parts: object) -> Column:
    """A uniform integer in [0, 2^60) keyed by ``parts``."""
    digest = F.md5(F.concat_ws("|", *[_text(p) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def uniform(*parts: object) -> Column:
    """A uniform double in (0, 1)."""
    return (draw(*parts).cast("double") + F.lit(0.5)) / F.lit(_RANGE)


def normal(*parts: object) -> Column:
    """A standard normal double (Box-Muller on two draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "radius")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "angle"))


def draw_slice(value: Column, slices: int) -> Column:
    """Order-preserving slice number of a draw; the slices are equally likely."""
    return F.floor(value / F.lit(2**DRAW_BITS // slices)).cast("int")


def driver_draw(*parts: object) -> int:
    """The same draw for a fixed, small key set known on the driver."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[: DRAW_BITS // 4], 16)


def driver_normal(*parts: object) -> float:
    def unit(name: str) -> float:
        return (float(driver_draw(*parts, name)) + 0.5) / _RANGE

    return math.sqrt(-2.0 * math.log(unit("radius"))) * math.cos(2.0 * math.pi * unit("angle"))
