"""Pairs of sets that share one of their rarest elements: an exact prefix filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def rare_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among ``sets(node, part, c, tokens)``: all pairs of nodes with different c whose token sets may
    have 100 * intersection >= percent * union; ``part`` tells the sets of one node apart.

    Linked sets of n and m tokens share ``percent`` of n, so of each set's tokens in one order the first
    n - ceil(percent * n) + 1 must meet. In this order tokens of one c alone come first: they take their places of
    the prefix but meet nothing, so they needn't be moved. The others follow by frequency, rarest first: what many sets hold comes
    last, and is compared on only where a set has nothing rarer. What two sets share comes at or after their first common token, so
    a pair counts only if what follows its places in both is enough for a link.
    """
    sets = materialize(sets.filter(F.size("tokens") > 0), "sets")
    tokens = sets.select("node", "part", "c", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("least"), F.max("c").alias("most"))
    mixed = materialize(counts.filter("least < most").select("token", "f"), "mixed-tokens")
    held = tokens.select("node", "part", "token").join(mixed.hint("merge"), "token")
    held = held.groupBy("node", "part").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    held = held.join(sets.select("node", "part", "c", F.size("tokens").alias("n")).distinct(), ["node", "part"])
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("t"))
    first = F.slice("t", F.lit(1), F.col("room"))
    held = held.withColumn("room", room.cast("int")).filter("room > 0").select("node", "c", "n", (F.col("n") - F.size("t")).alias("before"), F.posexplode(first["token"]).alias("at", "token"))
    held = materialize(held.select("node", "c", "n", "token", (F.col("n") - F.col("before") - F.col("at")).alias("left")), "prefixes")
    side = lambda x: held.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("node", "c", "n", "left")))
    similar = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    enough = F.least("left_a", "left_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    met = side("a").join(side("b").hint("merge"), "token").filter((F.col("c_a") < F.col("c_b")) & similar & enough)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
