"""Number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = 1 << 46  # 100 * 2^46 stays below 2^53, so the scaled integer part is exact


def percent_text(score: Column) -> Column:
    """One-decimal percentage of a score in [0, 100], rounded on the exact binary value.

    ``format_string`` rounds the shortest decimal text half up (12.25 -> 12.3); the expected
    text follows the stored binary number, ties to even (12.25 -> 12.2, 12.35 -> 12.3).
    """
    # the texts differ only where the shortest decimal form is a tie: an odd number of twentieths
    twentieths = F.round(score * 20).cast("bigint")
    tied_text = (F.pmod(twentieths, F.lit(2)) == 1) & (twentieths / F.lit(20.0) == score)
    # exact comparison of 20 * score with that number, both scaled by 2^46
    scaled = score * F.lit(float(_SCALE))
    whole = F.floor(scaled).cast("bigint")
    part = (scaled - whole) * 20
    gap = twentieths * F.lit(_SCALE) - whole * 20
    below = (twentieths - 1) / 2
    up = (part > gap) | ((part == gap) & (F.pmod(below, F.lit(2)) == 1))
    settled = (below + F.when(up, 1).otherwise(0)) / 10
    return F.format_string("%.1f%%", F.when(tied_text, settled).otherwise(score))
