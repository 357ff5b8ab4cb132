"""General shapes that several analyses share: running budgets, duplicates, snapshots, first matches in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sediment.shared import cut

#: Passages that are compared with every text at a time.
SHORT = 1000


def within_budget(rows: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """The longest prefix of each group, in ascending ``order`` (columns), whose sizes add up to ``budget`` at most, with
    ``running``. Rows are dealt into ranges of group and order; sums of whole ranges (a row a range and group) give each
    range its start, so a large group is not sorted in one place."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(rows.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part", *group).agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    same = dealt["_part"] == starts["_part"]
    for g in group:
        same = same & dealt[g].eqNullSafe(starts[g])
    frame = Window.partitionBy(dealt["_part"], *[dealt[g] for g in group]).orderBy(*[dealt[c] for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(starts, same).select(*[dealt[c] for c in rows.columns], (F.sum(dealt[size]).over(frame) + F.col("_start")).alias("running"))
    return found.filter(F.col("running") <= budget)


def top_per_group(rows: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with ``rank``. Spark ranks within tasks before the shuffle, so a
    large group costs n rows a task."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def duplicates(rows: DataFrame, key: Column, identity: str) -> DataFrame:
    """Every occurrence but the first of a key, by ``identity``, with ``first_id``: the minimum is aggregated and joined,
    so a key with very many rows is not gathered."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.min(identity).alias("first_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return keyed.join(first, "_key").filter(F.col(identity) != F.col("first_id")).drop("_key")


def conflicts(rows: DataFrame, key: Column, place: str) -> DataFrame:
    """``key, places`` of the keys that occur in several places."""
    pairs = rows.select(key.alias("key"), place).distinct()
    return pairs.groupBy("key").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")


def missing(references: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """References whose ``key`` is not among ``known``."""
    return references.join(known.select(key).distinct(), key, "left_anti")


def counted(values: DataFrame, column: str, known: tuple[str, ...], blank: str, other: str = "OTHER") -> DataFrame:
    """``status, n`` of each known value (0 if need be) and all others as ``other``; null and blank count as ``blank``."""
    status = F.upper(F.trim(F.coalesce(column, F.lit(""))))
    status = F.when(status == "", blank).otherwise(status)
    n = values.select(F.when(status.isin(*known), status).otherwise(other).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in (*known, other)])).alias("status"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", cheap: tuple[str, ...] = ("mtime", "size"), proof: str = "sha256") -> DataFrame:
    """``key, state`` over both snapshots: new, deleted, unmodified (cheap columns equal), touched (they differ, the
    proof is equal) or modified."""
    cols = [*cheap, proof]
    a = old.select(key, *[F.col(c).alias(f"_old_{c}") for c in cols], F.lit(True).alias("_was"))
    b = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_is"))
    same = F.lit(True)
    for c in cheap:
        same = same & F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
    state = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "deleted")
        .when(same, "unmodified")
        .when(F.col(f"_old_{proof}").eqNullSafe(F.col(f"_new_{proof}")), "touched")
        .otherwise("modified")
    )
    return a.join(b, key, "full").select(key, state.alias("state"))


def first_contained(texts: DataFrame, passages: DataFrame, key: str, text: str, item: str, passage: str, words: int = 5) -> DataFrame:
    """``key, item``: of the passages that a text contains, the least item. Texts and passages meet on a hash of whole
    words within the passage, so only a text with these words in a row is compared; passages with too few words for
    that are compared with every text, in blocks of SHORT passages."""
    def parts(c: Column) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    split = passages.select(item, passage, parts(F.col(passage)).alias("_w"))
    anchored = split.filter(F.size("_w") >= words + 2).select(item, passage, F.xxhash64(F.array_join(F.slice("_w", 2, words), " ")).alias("_at"))
    short = split.filter((F.size("_w") < words + 2) & F.col(passage).isNotNull()).select(item, passage)
    rows = texts.select(key, text, parts(F.col(text)).alias("_w"))
    places = F.when(F.size("_w") >= words, F.sequence(F.lit(1), F.size("_w") - (words - 1)))
    hashes = F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("_w", i, words), " "))))
    met = rows.select(key, F.explode(hashes).alias("_at")).join(anchored.select(item, "_at"), "_at").select(key, item).distinct()
    whole = met.join(texts.select(key, text), key).join(passages.select(item, passage), item).filter(F.col(text).contains(F.col(passage)))
    found = whole.select(key, item)
    blocks = -(-short.count() // SHORT)
    for block in range(blocks):
        part = short if blocks == 1 else short.filter(F.pmod(F.xxhash64(item, passage), F.lit(blocks)) == block)
        found = found.unionByName(texts.join(F.broadcast(part), F.col(text).contains(F.col(passage))).select(key, item))
    return found.groupBy(key).agg(F.min(item).alias(item))


def sessions(events: DataFrame, who: str, when: str, gap_minutes: int) -> DataFrame:
    """``who, started, ended, n`` of runs of events with gaps of less than ``gap_minutes``."""
    w = F.session_window(when, f"{gap_minutes} minutes")
    return events.groupBy(who, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("ended")).select(who, F.col("w.start").alias("started"), "ended", "n")


def fair_cut(rows: DataFrame, budget: int, length: str, *groups: str) -> DataFrame:
    """``groups, n, cut``: the largest length that the rows of a group may have each, so that together they take ``budget``
    at most; null where all fit as they are, 0 where not even one of each does. Null lengths count as 0; without groups
    there is one row, and none of an empty table.

    With the k shortest rows whole, the others share what is left: (budget - their sum) / (number of the others). Every k
    gives a cut that fits, and the best of them is the answer, so it is one maximum over prefix sums. These run over how
    often each length occurs, not over the rows.
    """
    keys = ("_one", *groups)
    sizes = rows.select(F.lit(1).alias("_one"), *groups, F.coalesce(F.col(length), F.lit(0)).cast("long").alias("_size"))
    counts = sizes.groupBy(*keys, "_size").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_size")).alias("_all"))
    steps = counts.withColumns({"_k": below("_n"), "_whole": below(F.col("_n") * F.col("_size"))})
    same = reduce(lambda a, g: a & steps[g].eqNullSafe(totals[g]), groups, steps["_one"] == totals["_one"])
    each = F.floor((F.lit(budget) - F.col("_whole")) / (F.col("n") - F.col("_k"))).cast("long")
    found = steps.join(totals, same).select(*[steps[g].alias(g) for g in groups], "n", "_all", each.alias("_each"))
    found = found.groupBy(*groups, "n", "_all").agg(F.max("_each").alias("_cut"))
    return found.select(*groups, "n", F.when(F.col("_all") > budget, F.greatest("_cut", F.lit(0))).alias("cut"))
