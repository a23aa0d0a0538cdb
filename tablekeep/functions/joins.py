"""Joins that hold up when many keys are missing."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(keys: list[str]) -> Column:
    """Zero, but not to the optimizer, which would take a constant out of the keys again."""
    return F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint"))


def _salted(left: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    return left.withColumn("_salt", F.when(missing, F.xxhash64(*spread)).otherwise(_zero(keys)))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Left join on ``keys`` in which rows without a key are dealt out by ``spread``.

    Such rows match nothing, but a plain join sends all of them to the task of the null key.
    """
    salted = _salted(left, keys, spread)
    return salted.join(right.withColumn("_salt", _zero(keys)), [*keys, "_salt"], "left").drop("_salt")


def lookup_lists(left: DataFrame, lists: dict[str, DataFrame], key: str, spread: list[str]) -> DataFrame:
    """``left`` with one array per name of ``lists``: the other fields of the frame's rows of the same ``key``.

    Rows without a key are dealt out as in :func:`lookup`. Every frame is shuffled once, ``left`` included, however
    many arrays it gets; rows of ``left`` stay as many as they are.
    """
    joined = _salted(left, [key], spread)
    for name, frame in lists.items():
        fields = F.struct(*[c for c in frame.columns if c != key])
        listed = frame.filter(F.col(key).isNotNull()).withColumn("_salt", _zero([key])).groupBy(key, "_salt")
        joined = joined.join(listed.agg(F.collect_list(fields).alias(name)), [key, "_salt"], "left")
    return joined.drop("_salt")
