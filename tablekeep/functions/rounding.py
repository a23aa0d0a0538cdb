"""Rounding by the exact value of a double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Round a double to the nearest decimal, exact ties to even.

    ``round`` works on the shortest decimal form, so it takes 0.5025, which is a
    little less than that as a double, for a tie; formatting looks at the double.
    """
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit("")).cast("double")
