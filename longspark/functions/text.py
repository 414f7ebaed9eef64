"""Text expressions: identifiers, normalised decision text, metadata fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters unified before two decision texts are compared.
ARROW = "→"
DASHES = "—–−"


def normalize_text(text: Column) -> Column:
    """Lower case, unified dashes and arrows, single spaces, no outer space."""
    plain = F.translate(text, DASHES, "-" * len(DASHES))
    plain = F.replace(plain, F.lit(ARROW), F.lit("->"))
    return F.trim(F.regexp_replace(F.lower(plain), r"\s+", " "))


def joined_name(*parts: Column) -> Column:
    """Names such as ``flow__jump__uncertainty``."""
    return F.concat_ws("__", *[p.cast("string") for p in parts])


def parse_flag(text: Column) -> Column:
    """``true/1`` and ``false/0`` in any case; anything else is null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False))


def metadata_field(metadata: Column, name: str) -> Column:
    return F.get_json_object(metadata, f"$.{name}")
