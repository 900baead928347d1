"""Sharding by rendezvous hashing.

Every shard draws a number for every record key, from a hash of both and the shard's weight; the record goes to the
shard with the greatest. A new shard changes none of the other draws, so it only takes records into itself.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.staging import stage


def draw(key: Column, shard: int, weight: float) -> Column:
    """The shard's number for a key: weight / -ln(u), u evenly spread in (0, 1) by a hash of the key's text and the shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11)
    return F.lit(float(weight)) / -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53)))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the greatest draw, the lower one of equals. Shards of weight 0 get nothing."""
    if not any(weight > 0 for weight in weights) or not all(0 <= weight < math.inf for weight in weights):
        raise ValueError("weights must be 0 or more, one of them above 0")
    draws = F.array(*[draw(key, shard, weight) if weight else F.lit(-1.0) for shard, weight in enumerate(weights)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def numbered(df: DataFrame, group: str, name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order in which they lie.

    The rows are written to the shared folder with the partition and place they have, so both stay what they are. They
    are counted per partition and group, and a row's number is the count in the partitions before its own plus its
    place in its own: no task sees more of a group than one input partition holds.
    """
    placed = stage(df.withColumn("in_partition", F.spark_partition_id()).withColumn("in_order", F.monotonically_increasing_id()), name="placed")
    counts = placed.groupBy("in_partition", group).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("in_partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("in_partition").alias("of_partition"), F.col(group).alias("of_group"), before.alias("before"))
    place = F.row_number().over(Window.partitionBy("in_partition", group).orderBy("in_order")) - 1
    joined = placed.withColumn("place", place).join(offsets, (F.col("in_partition") == F.col("of_partition")) & F.col(group).eqNullSafe(F.col("of_group")))
    return joined.select(*df.columns, (F.col("before") + F.col("place")).alias(name))


def shard_records(docs: DataFrame, weights: Sequence[float], more: Sequence[float] = (1.0,), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (the shard once those of `more` are added) of every row.

    The size is the text's bytes and 16 more; a null text has no bytes and the checksum of an empty one. Null keys are
    hashed as one key, repeated keys go to one shard, and each row has a slot of its own. Other columns are not read.
    An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    id_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(whole).cast("long") + 16).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        winner(id_text, weights).alias("shard"),
        winner(id_text, [*weights, *more]).alias("grown_shard"),
    )
    return numbered(rows, "shard", "slot").select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
