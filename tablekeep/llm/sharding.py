"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside their source, ranked, and placed by their fractional rank
(rank - 1/2) / size of the source. Cutting that order into equal pieces gives every shard the mixture of the
whole, within one row per source. Both rankings are exact and distributed: rows are counted per bucket of the
sort key, counts are summed up per source, and only the rows of one bucket are sorted together, so a source
with a third of all rows is spread over many tasks.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablekeep.llm.common import staged

#: Rows that one bucket holds on average, or the square root of all rows if that is more: neither the rows of a
#: bucket nor the number of buckets, whose counts are summed up in order, grows faster than that root.
BUCKET_ROWS = 2000
#: Hexadecimal digits of the shuffle key that choose its bucket.
DIGITS = 8


def _running_start(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each bucket: a sum over counts, one row per bucket."""
    order = Window.partitionBy(*by).orderBy("bucket") if by else Window.orderBy("bucket")
    return counts.withColumn("start", F.sum("n").over(order) - F.col("n"))


def interleave(rows: DataFrame, shards: int, key: Column, source: str = "source") -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; the sizes of shards differ by one row at most.

    ``key`` is the seeded shuffle key: text of hexadecimal digits. Ties, such as rows that share an id, stand in the
    order of doc_id and then of a hash of the whole row; rows without a key are dealt by that hash. A null source is a
    source of its own. An empty table gives no rows, repeated rows are placed like any other rows. Columns named shard
    or slot are replaced; all others, whatever their names, are passed on.
    """
    names = rows.columns
    quoted = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    # columns go by numbers inside, so no name of theirs can meet one of these
    kept = [(i, n) for i, n in enumerate(names) if n == source or n.lower() not in ("shard", "slot")]
    row_hash = F.xxhash64(*quoted)
    keyed = rows.select(
        *[c.alias(f"c{i}") for i, c in enumerate(quoted)],
        row_hash.alias("row_hash"),
        F.coalesce(key, F.md5(row_hash.cast("string"))).alias("shuffle_key"),
    )
    own, doc_id = f"c{names.index(source)}", f"c{names.index('doc_id')}"
    sizes = staged(keyed.groupBy(F.col(own).alias("stratum")).agg(F.count(F.lit(1)).alias("stratum_rows")), "strata")
    total = sizes.agg(F.coalesce(F.sum("stratum_rows"), F.lit(0)).alias("n")).first().n
    buckets = max(1, min(total // BUCKET_ROWS, math.isqrt(total)))
    # first ranking: inside each source, by the shuffle key
    spread = F.coalesce(F.conv(F.substring("shuffle_key", 1, DIGITS), 16, 10).cast("long"), F.lit(0))
    keyed = keyed.withColumn("bucket", F.floor(spread * buckets / 16**DIGITS).cast("long"))
    counts = keyed.groupBy(F.col(own).alias("stratum"), "bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = (
        _running_start(counts, ["stratum"])
        .join(
            sizes.withColumnRenamed("stratum", "sized"), F.col("stratum").eqNullSafe(F.col("sized"))
        )
        .select("stratum", "bucket", "start", "stratum_rows")
    )
    inside = Window.partitionBy(own, "bucket").orderBy("shuffle_key", doc_id, "row_hash")
    ranked = (
        keyed.withColumn("inside", F.row_number().over(inside))
        .join(
            starts.withColumnRenamed("bucket", "start_bucket"),
            F.col(own).eqNullSafe(F.col("stratum")) & (F.col("bucket") == F.col("start_bucket")),
        )
        .withColumn("rank", F.col("start") + F.col("inside"))
        .withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("stratum_rows")))
        .select(*[f"c{i}" for i, _ in kept], "rank", "fraction")
    )
    # second ranking: over all sources, by the fractional rank
    placed = staged(
        ranked.withColumn("bucket", F.floor(F.col("fraction") * buckets).cast("long")), "ranked"
    )
    starts = _running_start(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), [])
    inside = Window.partitionBy("bucket").orderBy("fraction", own, "rank")
    at = placed.withColumn("inside", F.row_number().over(inside)).join(
        starts.select("bucket", "start"), "bucket"
    )
    position = F.col("start") + F.col("inside") - 1
    return (
        at.withColumn("position", position)
        .withColumn("shard", F.expr(f"cast(position * {shards} div {max(1, total)} as int)"))
        .withColumn(
            "slot",
            F.expr(f"position - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}"),
        )
        .select(*[F.col(f"c{i}").alias(n) for i, n in kept], "shard", "slot")
    )
