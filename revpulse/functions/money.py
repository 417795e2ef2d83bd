"""Money and rounding as native column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount) -> Column:
    """A two-decimal amount as whole cents.

    Sums of BIGINT stay on the fast long path of the hash aggregate and are exact;
    a DECIMAL(10,2) sum needs 20 digits and falls back to BigDecimal buffers.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount.cast("decimal(16,2)") * F.lit(100)).cast("bigint")


def from_cents(total) -> Column:
    total = F.col(total) if isinstance(total, str) else total
    return (total.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)")


def mean_of_cents(total, count) -> Column:
    """Exact mean of a sum of cents, rounded half up to two decimals; null for no rows."""
    amount = total.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")
    return F.round(F.try_divide(amount, count.cast("decimal(18,0)")), 2).cast("decimal(20,2)")


def round_half_even(value: Column, digits: int) -> Column:
    """Half-to-even rounding of a double at the given scale."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale
