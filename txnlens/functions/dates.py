"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def whole_days(start, end) -> Column:
    """Whole days from ``start`` to ``end``, floored like a timedelta's ``days``.

    23:00 to 01:00 the next day is 0 days, the reverse is -1; ``datediff`` would
    give 1 and -1 because it only looks at calendar dates.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("bigint")
