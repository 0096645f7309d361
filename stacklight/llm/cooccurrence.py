"""Items that appear together: basket collapsing.

Rows (basket keys, item) are deduplicated, each basket becomes its sorted array of distinct items, identical arrays
of a group collapse into one weighted array, pairs are enumerated once per distinct array, and weights are summed.

Cases: rows with a null in a key or in the item are ignored; repeated rows count once; a basket with one item has no
pair but counts as a basket; an empty input gives no rows. Columns other than the named ones are dropped first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = 512
"""Items of a basket that are paired within one row; a wider basket is cut into blocks of this many, and each pair of
blocks becomes a row of its own, so that no task builds the pairs of an unbounded basket at once."""


def baskets(rows: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """(group, items, weight): each distinct sorted item array of a group and the number of baskets that hold it."""
    r = rows.select(F.col(group).alias("g"), F.col(basket).alias("b"), F.col(item).alias("i")).dropna()
    return (
        r.distinct()
        .groupBy("g", "b")
        .agg(F.array_sort(F.collect_list("i")).alias("items"))
        .groupBy("g", "items")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def pair_counts(collapsed: DataFrame, wide: int = WIDE) -> DataFrame:
    """(g, a, b, n_ab) with a < b. Partial sums run before the shuffle on (g, a, b)."""
    n_blocks = F.ceil(F.size("items") / F.lit(wide)).cast("int")
    block = lambda k: F.slice(F.col("items"), (k * wide + 1).cast("int"), F.lit(wide))
    left = collapsed.filter(F.size("items") > 1).select("*", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("ba"))
    both = left.select("*", F.explode(F.sequence("ba", n_blocks - 1)).alias("bb"))
    parts = both.select("g", "weight", (F.col("ba") == F.col("bb")).alias("same"), block(F.col("ba")).alias("xs"), block(F.col("bb")).alias("ys"))
    one = parts.select("g", "weight", "same", "ys", F.posexplode("xs").alias("p", "a"))
    rest = F.when(F.col("same"), F.slice(F.col("ys"), F.col("p") + 2, F.lit(wide))).otherwise(F.col("ys"))
    return one.select("g", "weight", "a", F.explode(rest).alias("b")).groupBy("g", "a", "b").agg(F.sum("weight").alias("n_ab"))


def cooccurrence(rows: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """(g, a, b, n_ab, n_a, n_b, n, lift, conviction): one row per pair of items that share a basket.

    lift = n_ab * n / (n_a * n_b); conviction of a -> b = (1 - n_b/n) / (1 - n_ab/n_a), null where n_ab = n_a."""
    collapsed = baskets(rows, group, basket, item)
    totals = collapsed.groupBy("g").agg(F.sum("weight").alias("n"))
    singles = collapsed.select("g", "weight", F.explode("items").alias("i")).groupBy("g", "i").agg(F.sum("weight").alias("n_i"))
    pairs = pair_counts(collapsed)
    out = (
        pairs.join(singles.select("g", F.col("i").alias("a"), F.col("n_i").alias("n_a")), ["g", "a"])
        .join(singles.select("g", F.col("i").alias("b"), F.col("n_i").alias("n_b")), ["g", "b"])
        .join(totals, "g")
    )
    d = lambda c: F.col(c).cast("double")
    return out.withColumn("lift", d("n_ab") * d("n") / (d("n_a") * d("n_b"))).withColumn(
        "conviction", F.when(F.col("n_ab") < F.col("n_a"), (1 - d("n_b") / d("n")) / (1 - d("n_ab") / d("n_a")))
    )


def bare_item_key(key: Column, library: Column) -> Column:
    """``item_key`` without a leading ``<library_id>:`` of its own library; empty becomes null."""
    prefix = F.concat(library.cast("string"), F.lit(":"))
    bare = F.when(F.startswith(key, prefix), F.substr(key, F.length(prefix) + 1)).otherwise(key)
    return F.when(bare != "", bare)


def concept_readings(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """Valid source rows as (library_id, paper, concept_id), one per paper and concept.

    The hot ``term_id`` never shuffles alone: rows are first deduplicated per (library, paper, term), then the term list
    joins (a fixed reference list, left to the optimiser's size check), then the concepts of a paper are deduplicated."""
    s = sources.select("library_id", "term_id", bare_item_key(F.col("item_key"), F.col("library_id")).alias("paper"))
    s = s.dropna(subset=["library_id", "term_id", "paper"]).distinct()
    t = terms.select("term_id", "concept_id").dropna().distinct()
    return s.join(t, "term_id").select("library_id", "paper", "concept_id")


def found_pairs(scored: DataFrame, min_count: int = 4, min_lift: int = 4) -> DataFrame:
    """Pairs in at least ``min_count`` baskets that occur ``min_lift`` times as often as chance; exact in integers."""
    ok = (F.col("n_ab") >= min_count) & (F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return scored.filter(ok)
