"""Items that appear together: basket collapsing.

Baskets become sorted arrays of item numbers without repeats, identical arrays are grouped into one
with a weight, pairs are enumerated once for each distinct basket and the weights are summed.
A basket is cut into blocks of ``BLOCK`` items before it is collected, so no array and no row is larger than
a block: small baskets are one block and collapse whole; of large ones every pair of blocks is a row of
its own, and these rows are dealt to all tasks before their pairs are made.

Two exact bounds keep the enumeration small, neither loses a pair of the result:
``n_ab <= min(n_a, n_b)``, so an item in fewer than ``min_count`` baskets has no pair, and
``n_ab * n >= min_lift * n_a * n_b`` needs ``n >= min_lift * max(n_a, n_b)``, so an item in more than
``n / min_lift`` baskets has none either. The second removes just those items that would make the
heaviest groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.runtime import cut, sized, skew_join

#: Items of a block; a row of the enumeration makes at most BLOCK * BLOCK pairs.
BLOCK = 256


def cooccurring_pairs(df: DataFrame, basket: str | Column, items: str | Column, min_count: int = 6, min_lift: float = 3.0) -> DataFrame:
    """Pairs of items of ``items`` (an array column) that share baskets more often than chance.

    Result: ``item_a < item_b`` (byte order), ``n_ab``, ``n_a``, ``n_b``, ``n`` (baskets with an item),
    ``lift = n_ab * n / (n_a * n_b)``, ``conviction_ab = (n - n_b) * n_a / (n * (n_a - n_ab))`` and
    ``conviction_ba`` (NULL where every basket with the one holds the other), for pairs with
    ``n_ab >= min_count`` and ``lift >= min_lift``.

    A basket named by several rows is the union of their items. Rows with a NULL basket, NULL arrays,
    empty arrays and NULL items add nothing; an item named twice counts once. Other columns are not
    read. An empty table gives no rows.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    rows = df.select(col(basket).alias("basket"), F.filter(col(items), lambda x: x.isNotNull()).alias("items")).where("basket is not null and size(items) > 0")
    n = rows.select("basket").distinct().count()
    flat = rows.select("basket", F.explode("items").alias("item"))
    counted = flat.groupBy("item").agg(F.count("*").alias("occurrences"))
    words = cut(counted.where(F.col("occurrences") >= min_count).withColumn("id", F.monotonically_increasing_id()))
    total = words.agg(F.sum("occurrences")).first()[0] or 0
    pairs_in = cut(skew_join(flat, words, "item", "occurrences", total).select("basket", "id").distinct())

    sizes = pairs_in.groupBy("id").agg(F.count("*").alias("n_item"))
    sizes = cut(sizes.where((F.col("n_item") >= min_count) & (F.col("n_item") * F.lit(min_lift) <= F.lit(n))))
    kept = skew_join(pairs_in, sizes.withColumn("w", F.col("n_item")), "id", "w", total).select("basket", "id")
    # items of a basket go to blocks by a hash; the count of a basket is made in parts, so a huge one is no heavy group
    counts = kept.groupBy("basket").agg(F.count("*").alias("k"))
    large = cut(counts.where(F.col("k") > BLOCK).select("basket", F.ceil(F.col("k") / F.lit(BLOCK / 2)).cast("int").alias("blocks")))
    dealt = kept.join(sized(large), "basket", "left").select("basket", "id", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    arrays = cut(dealt.groupBy("basket", "blocks", "block").agg(F.sort_array(F.collect_list("id")).alias("b")))
    inside = arrays.where("size(b) > 1").groupBy("b").agg(F.count("*").alias("weight")).select("weight", F.col("b").alias("l"), F.col("b").alias("r"), F.lit(True).alias("same"))
    # of a large basket: each block beside all later ones
    blocks = arrays.where("blocks > 1").select("basket", "block", "b", "blocks")
    left = blocks.where("block < blocks - 1").select("basket", F.col("b").alias("l"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"))
    across = left.repartition("basket", "block").join(blocks.select("basket", "block", F.col("b").alias("r")), ["basket", "block"]).select(F.lit(1).cast("bigint").alias("weight"), "l", "r", F.lit(False).alias("same"))
    # by number, as adaptive execution would merge partitions by the bytes of the blocks and not by the pairs they make
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = inside.unionByName(across).repartition(tasks, F.xxhash64("l", "r"))
    firsts = every.select("weight", "r", "same", F.posexplode("l").alias("i", "x"))
    pairs = firsts.select("weight", "x", F.explode(F.when(F.col("same"), F.slice("r", F.col("i") + 2, F.greatest(F.size("r") - F.col("i") - 1, F.lit(0)))).otherwise(F.col("r"))).alias("y"))
    together = pairs.select("weight", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("c")).groupBy("a", "c").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_count)

    side = sized(sizes)
    ends = sized(words.select("id", "item"))
    scored = (
        together.join(side.select(F.col("id").alias("a"), F.col("n_item").alias("n_1")), "a")
        .join(side.select(F.col("id").alias("c"), F.col("n_item").alias("n_2")), "c")
        .where(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_1") * F.col("n_2"))
        .join(ends.select(F.col("id").alias("a"), F.col("item").alias("item_1")), "a")
        .join(ends.select(F.col("id").alias("c"), F.col("item").alias("item_2")), "c")
    )
    turn = F.col("item_1") > F.col("item_2")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    out = scored.select(pick("item_1", "item_2").alias("item_a"), pick("item_2", "item_1").alias("item_b"), "n_ab", pick("n_1", "n_2").alias("n_a"), pick("n_2", "n_1").alias("n_b"), F.lit(n).cast("bigint").alias("n"))
    conviction = lambda one, other: F.try_divide((F.col("n") - F.col(other)) * F.col(one), F.col("n") * (F.col(one) - F.col("n_ab")))
    return out.select(
        "*",
        (F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        conviction("n_a", "n_b").alias("conviction_ab"),
        conviction("n_b", "n_a").alias("conviction_ba"),
    )
