"""Accounts that act on the same items together, by basket collapsing.

A basket is what acted on one item within one time cell as wide as the window, so
all its members are close enough.  Baskets with the same members are collapsed into
one with a weight, pairs are enumerated once per distinct basket, and weights are
summed.  Members of neighbouring cells are paired by their exact times, which only
the borders of cells need.  The sums are the counts themselves.

A basket of many members is split by hash of the member into parts of about
``part`` members, and pairs of parts are baskets; all baskets go this way, most as
one part with itself, so no array grows with the data.

What can be left out without losing a pair is left out first:

* accounts with fewer than ``min_count`` items, and accounts with so many that no
  partner could lift the pair to ``min_lift`` (``n_ab <= min(n_a, n_b)``);
* items that only one remaining account touched;
* of each account, its ``min_count - 1`` most popular items.  Of the common items of a
  pair, in order of popularity, only the first ``min_count - 1`` can be among these of
  either side; so a pair with ``min_count`` common items meets in a basket, and the
  summed weight lacks at most ``min_count - 1``.  For the pairs whose weight can
  suffice, the items left out, which are a constant number per account, are looked up
  and added.  An item that holds a third of all rows is thus in nobody's baskets,
  unless all of an account's items are such.

Defined results: rows with null account, item or time are ignored; of repeated
rows the earliest counts; an empty table gives no pairs; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.session import cut


def first_events(events: DataFrame) -> DataFrame:
    """The earliest event per ``(account, item)`` of ``events(account, item, t)``."""
    return events.groupBy("account", "item").agg(F.min("t").alias("t"))


def collapsed_baskets(seated: DataFrame) -> DataFrame:
    """Distinct baskets ``(one, other, weight)`` of ``seated(item, cell, account, part, parts)``.

    ``other`` is empty if the pairs are those inside ``one``, else they run across.
    """
    own, last = F.col("part"), F.col("parts") - 1
    seat = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), F.lit(right).alias("right"))
    left = F.transform(F.sequence(own, last), lambda j: seat(own, j, False))
    right = F.when(own > 0, F.transform(F.sequence(F.lit(0).cast("long"), own - 1), lambda i: seat(i, own, True)))
    seats = seated.select("item", "cell", "account", F.explode(F.concat(left, F.coalesce(right, F.array()))).alias("s"))
    member = lambda right: F.array_sort(F.collect_list(F.when(F.col("s.right") == right, F.col("account"))))
    baskets = seats.groupBy("item", "cell", "s.i", "s.j").agg(member(False).alias("one"), member(True).alias("other"))
    full = F.when(F.col("i") == F.col("j"), F.size("one") > 1).otherwise((F.size("one") > 0) & (F.size("other") > 0))
    return baskets.filter(full).groupBy("one", "other").agg(F.count("*").alias("weight"))


def _pairs_of_baskets(baskets: DataFrame) -> DataFrame:
    members = baskets.select("weight", "one", "other", F.posexplode("one").alias("i", "a"))
    rest = F.when(F.size("other") == 0, F.slice("one", F.col("i") + 2, F.size("one"))).otherwise(F.col("other"))
    pairs = members.select("weight", "a", F.explode(rest).alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def basket_pairs(events: DataFrame, window: int, part: int = 256) -> DataFrame:
    """``(a, b, weight)``: the number of items that a and b touched at most ``window`` apart.

    ``events(account, item, t)`` has one row per account and item.  Residents of a
    cell, and guests, who come from the cell before, are first reduced to cells with
    company, by a hash of the cell: a collision keeps a row for nothing.
    """
    seat = F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")
    seats = events.select("account", "item", "t", seat).withColumn("cell", F.floor(F.col("t") / window) + F.col("guest"))
    seats = seats.withColumn("key", F.xxhash64("item", "cell"))
    company = seats.groupBy("key").agg(F.count("*").alias("k"), F.min("guest").alias("g")).filter("k > 1 and g = 0")
    near = cut(seats.join(cut(company.select("key"), "company"), "key", "left_semi").drop("key"), "near")
    residents = near.filter("guest = 0").drop("guest")
    sizes = residents.groupBy("item", "cell").agg(F.count("*").alias("size"))
    large = cut(sizes.filter(F.col("size") > part).select("item", "cell", F.ceil(F.col("size") / part).alias("parts")), "large")
    parted = lambda df: df.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    seated = parted(residents.join(large, ["item", "cell"], "left")).withColumn("part", F.pmod(F.xxhash64("account"), F.col("parts")))
    inside = _pairs_of_baskets(collapsed_baskets(seated))
    # guests are split as in their own cell, and residents meet every part of them
    before = large.select("item", (F.col("cell") + 1).alias("cell"), "parts")
    guests = parted(near.filter("guest = 1").join(before, ["item", "cell"], "left"))
    guests = guests.select("item", "cell", F.pmod(F.xxhash64("account"), F.col("parts")).alias("part"), F.col("account").alias("b"), F.col("t").alias("t_b"))
    hosts = parted(residents.join(before, ["item", "cell"], "left"))
    hosts = hosts.select("item", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("account").alias("a"), F.col("t").alias("t_a"))
    across = hosts.join(guests, ["item", "cell", "part"]).filter(F.col("t_a") - F.col("t_b") <= window)
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1).cast("long").alias("weight"))
    return inside.unionByName(across).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def cooccurring_pairs(events: DataFrame, window: int, min_count: int = 3, min_lift: float = 5.0, part: int = 256) -> DataFrame:
    """Pairs of accounts with ``n_ab >= min_count`` and lift ``>= min_lift``.

    ``events(account, item, t)``, ``t`` and ``window`` in one unit.  Result
    ``(a, b, n_ab, n_a, n_b, n, lift, conviction)`` with ``a < b``: ``n_ab`` items
    both touched at most ``window`` apart, ``n_a`` and ``n_b`` items of each, ``n``
    items in all, ``lift = n_ab * n / (n_a * n_b)`` and ``conviction = (1 - n_b / n) /
    (1 - n_ab / n_a)`` of a towards b, null where b follows without exception.
    """
    rows = events.select("account", "item", "t").filter("account is not null and item is not null and t is not null")
    first = cut(first_events(rows), "first")
    n = first.select("item").distinct().count()
    per_account = first.groupBy("account").agg(F.count("*").alias("n_items"))
    # n_ab <= min(n_a, n_b), so lift <= n / max(n_a, n_b); tables per account are written, so that small ones are broadcast
    able = cut(per_account.filter((F.col("n_items") >= min_count) & (F.col("n_items") * F.lit(float(min_lift)) <= n)), "able")
    live = first.join(able, "account", "left_semi")
    shared = live.groupBy("item").agg(F.count("*").alias("popularity")).filter("popularity > 1")
    live = cut(live.join(shared, "item"), "live")
    still = live.groupBy("account").agg(F.count("*").alias("n_live")).filter(F.col("n_live") >= min_count)
    still = cut(still.select("account"), "still")
    live = live.join(still, "account", "left_semi")
    top = Window.partitionBy("account").orderBy(F.desc("popularity"), "item")
    spared = cut(live.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= min_count - 1), "spared")
    last = spared.filter(F.col("place") == min_count - 1).select("account", F.col("popularity").alias("p"), F.col("item").alias("i"))
    after = F.col("p").isNull() | (F.col("popularity") < F.col("p")) | ((F.col("popularity") == F.col("p")) & (F.col("item") > F.col("i")))
    kept = live.join(last, "account", "left").filter(after).select("account", "item", "t")
    pairs = basket_pairs(kept, window, part)
    for side in ("a", "b"):
        pairs = pairs.join(able.select(F.col("account").alias(side), F.col("n_items").alias(f"n_{side}")), side)
    enough = lambda count: (count >= min_count) & (count * F.lit(n) >= F.col("n_a") * F.col("n_b") * F.lit(float(min_lift)))
    pairs = cut(pairs.filter(enough(F.col("weight") + (min_count - 1))), "pairs")
    side = lambda df, x: df.select(F.col("account").alias(x), "item", F.col("t").alias(f"t_{x}"))
    # what one side spared meets all of the other side, what only the other spared meets what the one kept
    met_a = pairs.join(side(spared, "a"), "a").join(side(live, "b"), ["b", "item"])
    met_b = pairs.join(side(spared, "b"), "b").join(side(kept, "a"), ["a", "item"])
    close = F.abs(F.col("t_a") - F.col("t_b")) <= window
    added = met_a.filter(close).select("a", "b").unionByName(met_b.filter(close).select("a", "b")).groupBy("a", "b").agg(F.count("*").alias("more"))
    full = pairs.join(added, ["a", "b"], "left").withColumn("n_ab", F.col("weight") + F.coalesce("more", F.lit(0)))
    full = full.filter(enough(F.col("n_ab"))).withColumn("n", F.lit(n).cast("long"))
    lift = F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))
    conviction = (1 - F.col("n_b") / n) / F.expr("nullif(1 - n_ab / n_a, 0)") if n else F.lit(None).cast("double")
    return full.select("a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), conviction.alias("conviction"))
