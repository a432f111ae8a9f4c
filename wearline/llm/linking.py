"""Links between items that share buckets, and their connected groups, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wearline.session import discard, materialize

Step = Callable[[DataFrame], DataFrame]


def _smaller(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where(
        F.col("node") != F.col("root")
    )


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (node > root).

    Large: every larger neighbour of a node is tied to the node's smallest neighbour. Small: a
    node and its smaller neighbours are tied to the smallest of them.
    """
    if large:
        both = edges.select(F.col("node").alias("at"), F.col("root").alias("to")).union(
            edges.select(F.col("root").alias("at"), F.col("node").alias("to"))
        )
    else:
        both = edges.select(F.col("node").alias("at"), F.col("root").alias("to"))
    # Written apart, so that a node with very many neighbours can be split in the join.
    least = materialize(both.groupBy("at").agg(F.min("to").alias("least")))
    tied = both.join(least.select(F.col("at").alias("of"), "least"), F.col("at") == F.col("of"))
    tied = tied.withColumn("least", F.least("least", "at"))
    if large:
        out = tied.where(F.col("to") > F.col("at")).select(F.col("to").alias("node"), F.col("least").alias("root"))
    else:
        out = tied.select(F.col("to").alias("node"), F.col("least").alias("root")).union(
            least.select(F.col("at").alias("node"), F.col("least").alias("root"))
        )
    return out.where(F.col("node") != F.col("root")).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link, the component's smallest node excepted.

    ``edges`` has long columns ``a`` and ``b``. Alternates large and small stars until every node is
    tied to the smallest of its component; the number of rounds grows with the logarithm of the
    longest chain. Each round is written to the shared folder.
    """
    current = materialize(_smaller(edges).distinct())
    before = _digest(current)
    while before[0]:
        before_stars, current = current, materialize(_stars(_stars(current, large=True), large=False))
        discard(before_stars)
        after = _digest(current)
        if after == before:
            break
        before = after
    return current.select("node", F.col("root").alias("component"))


def _open_rows(rows: DataFrame, grouped: DataFrame, fits: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows of the buckets that hold more than one component, with their ``component``.

    Components only grow, so the other buckets have nothing left to compare, and with ``fits`` nor has a bucket of
    two rows that don't fit. ``rows``, a written table, is deleted.
    """
    named = rows.select("bucket", "node", "mark").join(
        grouped.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left"
    )
    named = materialize(named.withColumn("component", F.coalesce("component", "node")).drop("of"))
    discard(rows)
    found = [F.min("component").alias("low"), F.max("component").alias("high")]
    several = F.col("low") != F.col("high")
    if fits is not None:
        found += [F.count("*").alias("n"), F.min_by("mark", "node").alias("first"), F.max_by("mark", "node").alias("last")]
        several = several & ((F.col("n") > 2) | fits(F.col("first"), F.col("last")))
    mixed = named.groupBy("bucket").agg(*found).where(several).select("bucket")
    still_open = materialize(named.join(mixed, "bucket", "left_semi"))
    discard(named)
    return still_open


def _buckets_of(rows: DataFrame) -> DataFrame:
    """(owner, buckets): all buckets of each node."""
    return rows.groupBy(F.col("node").alias("owner")).agg(F.collect_set("bucket").alias("buckets"))


def link(
    members: DataFrame,
    fits: Callable[[Column, Column], Column],
    screen: Step,
    confirm: Step,
    narrow: Step | None = None,
    fits_narrowed: Callable[[Column, Column], Column] | None = None,
    rounds: int = 1,
    least_shared: Callable[[Column, Column], Column] | None = None,
    spread: bool = False,
) -> DataFrame:
    """(node, component) by all confirmed links between nodes that share a bucket.

    ``members`` has long ``bucket, node, mark``. ``fits(mark, mark)`` and ``screen``, on distinct pairs
    ``a < b``, are cheap necessary conditions; ``confirm`` keeps the true links. ``narrow`` gives
    the nodes that are still open better marks, for which ``fits_narrowed`` is a sharper condition.
    ``least_shared(mark, mark)`` says how many buckets two linked nodes share at least; the last
    step leaves out pairs that share fewer.

    First every node is compared to the smallest fitting of its buckets' smallest nodes. Groups of
    near copies collapse there, with one comparison per node. In each of ``rounds`` more, nodes
    outside are compared to one node per bucket, chosen by a hash, as long as their components
    differ. At last all pairs in one bucket are compared whose components still differ. So no link
    that could join two components is left out, and the pairs inside a component are not made.

    ``spread``, for nodes of one mark each, chooses another node of a group for each of its buckets, so that a node
    meets as many of the group as they share buckets. A chosen node has then been compared to its whole bucket and
    leaves it, which empties small buckets. The last step makes a pair once, in the first open bucket
    that both are in, instead of once per shared bucket. It can't go with ``least_shared``, which counts them.
    """
    centres = members.groupBy("bucket").agg(
        F.min("node").alias("centre"), F.max("node").alias("last"), F.min_by("mark", "node").alias("mark_centre")
    )
    centres = centres.where(F.col("centre") != F.col("last")).drop("last").withColumnRenamed("bucket", "of")
    shared = materialize(members.join(centres, F.col("bucket") == F.col("of")).drop("of"))
    star = shared.where((F.col("node") != F.col("centre")) & fits(F.col("mark"), F.col("mark_centre")))
    star = star.select(F.col("centre").alias("a"), F.col("node").alias("b"))
    nearest = screen(star.distinct()).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(confirm(nearest))
    apart = fits if spread else None
    rows = _open_rows(shared, components(links), apart)
    for seed in range(rounds):
        place = F.xxhash64(F.lit(seed), "node", "bucket") if spread else F.xxhash64(F.lit(seed), "node")
        chosen = rows.groupBy("bucket").agg(
            F.min_by("node", place).alias("centre"),
            F.min_by("component", place).alias("of_centre"),
            F.min_by("mark", place).alias("mark_centre"),
        )
        chosen = chosen.withColumnRenamed("bucket", "of")
        met = rows.join(chosen, F.col("bucket") == F.col("of"))
        if spread:
            met = materialize(met.where(F.col("node") != F.col("centre")))
        near = met.where((F.col("component") != F.col("of_centre")) & fits(F.col("mark"), F.col("mark_centre")))
        pairs = near.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        links = materialize(links.select("a", "b").union(confirm(screen(pairs.distinct())).select("a", "b")))
        if spread:
            discard(rows)
        rows = _open_rows(met if spread else rows, components(links), apart)
    written = rows
    if narrow is not None:
        marks = materialize(narrow(rows.select("node").distinct()).select(F.col("node").alias("of"), "better"))
        rows = rows.join(marks, F.col("node") == F.col("of")).drop("mark", "of").withColumnRenamed("better", "mark")
        fits = fits_narrowed or fits
    columns = ["bucket", "node", "mark", "component"]
    if spread:
        rows = rows.join(_buckets_of(written), F.col("node") == F.col("owner"))
        rows = rows.withColumn("before", F.filter("buckets", lambda other: other < F.col("bucket")))
        columns.append("before")
    left, right = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in columns]) for side in "ab")
    meet = (
        (F.col("bucket_a") == F.col("bucket_b"))
        & (F.col("node_a") < F.col("node_b"))
        & (F.col("component_a") != F.col("component_b"))
        & fits(F.col("mark_a"), F.col("mark_b"))
    )
    if spread:
        pairs = left.join(right, meet & ~F.arrays_overlap("before_a", "before_b"))
        pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    else:
        pairs = left.join(right, meet)
        least = F.lit(1) if least_shared is None else least_shared(F.col("mark_a"), F.col("mark_b"))
        pairs = pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
            F.count("*").alias("n"), F.max(least).alias("least")
        )
        pairs = pairs.where(F.col("n") >= F.col("least")).select("a", "b")
    last = confirm(screen(pairs))
    found = components(links.union(last.select("a", "b")))
    discard(written)
    return found
