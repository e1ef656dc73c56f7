"""Exact arithmetic on amounts stored as doubles with two decimal places.

Sums of doubles depend on the order in which tasks finish. Amounts are therefore counted
in whole hundredths and turned back into a double at the end, so that a result does not
change with the partitioning or after a task is run again. Single amounts fit a bigint,
which is far cheaper to compute with than a decimal; only sums need more digits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_BITS = 20


def hundredths(column: str) -> Column:
    """The amount in hundredths. An amount that is not a whole number of them ends the job.

    Nothing is rounded away: a whole number of hundredths, divided by 100, is the nearest double
    to the amount and so the stored one, and any other double differs from it. Not-a-number
    and infinite amounts end the job as well; null stays null.
    """
    amount = F.col(column)
    units = F.rint(amount * 100)
    message = F.concat(F.lit(f"{column} is no whole number of hundredths: "), amount.cast("string"))
    return (
        F.when(amount.isNull(), F.lit(None).cast("bigint"))
        .when(~F.isnan(amount) & (F.abs(units) < 2**53) & (units / 100 == amount), units.cast("bigint"))
        .otherwise(F.raise_error(message).cast("bigint"))
    )


def exact_sum(units: Column) -> Column:
    """Sum of any whole units, as a decimal, that may be beyond a bigint.

    Three parts of the number are summed apart as bigints and put together once per group:
    decimals in the sum itself would cost more per row and more bytes in the shuffle. The
    upper part of a bigint has 24 bits, so each sum holds for up to 2^39 rows.
    """
    mask = F.lit(2**PART_BITS - 1)
    upper = F.sum(F.shiftright(units, 2 * PART_BITS))
    middle = F.sum(F.shiftright(units, PART_BITS).bitwiseAND(mask))
    lower = F.sum(units.bitwiseAND(mask))
    step = F.lit(2**PART_BITS)
    return (upper.cast("decimal(20,0)") * step + middle) * step + lower


def as_amount(units: Column | str, places: int) -> Column:
    """Units with ``places`` decimal places as an amount."""
    units = F.col(units) if isinstance(units, str) else units
    return (units.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-places))).cast("double")
