import random

from pyspark.sql import functions as F

from tests.llm.helpers import groups
from wearline.llm import linking


def test_components_of_chains_stars_and_random_edges(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(rng.randrange(200, 320), rng.randrange(200, 320)) for _ in range(70)]
    linked = {frozenset(e) for e in edges}
    want = groups(320, lambda i, j: frozenset((i, j)) in linked)
    rng.shuffle(edges)
    got = dict(linking.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert all(got.get(i, i) == want[i] for i in range(320))


def test_no_edges(spark):
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_inside_a_component_are_not_made(spark):
    """Many near copies in a bucket: confirmations stay linear in the bucket's size."""
    n, asked = 300, []
    members = spark.createDataFrame([(7, i, 0) for i in range(n)] + [(8, n - 1, 0), (8, n, 0)], "bucket long, node long, mark long")

    def confirm(pairs):
        asked.append(pairs.count())
        return pairs

    got = dict(linking.link(members, lambda x, y: x == y, lambda p: p, confirm).collect())
    assert all(got.get(i, i) == 0 for i in range(n + 1))
    assert asked[0] == n and sum(asked) <= n + 2


def test_spread_choices_lose_no_link_and_make_each_pair_once(spark):
    """Nodes that share many buckets: the last step's join gives no pair twice, and chosen rows may leave their buckets."""
    rng = random.Random(6)
    place = {i: set(rng.sample(range(12), 5)) for i in range(70)}
    pairs = [(i, j) for i in range(70) for j in range(i + 1, 70) if place[i] & place[j]]
    near = {p for p in pairs if rng.random() < 0.5}
    linked = {p for p in near if rng.random() < 0.05}
    members = spark.createDataFrame([(b, i, i) for i in place for b in place[i]], "bucket long, node long, mark long")
    fitting = ",".join(f"{i}-{j}" for i, j in near)
    fits = lambda x, y: F.array_contains(F.split(F.lit(fitting), ","), F.concat_ws("-", F.least(x, y), F.greatest(x, y)))
    made = []

    def screen(pairs):
        made.append([tuple(r) for r in pairs.collect()])
        return pairs

    def confirm(pairs):
        return spark.createDataFrame([p for p in map(tuple, pairs.select("a", "b").collect()) if p in linked], "a long, b long")

    got = dict(linking.link(members, fits, screen, confirm, spread=True).collect())
    want = groups(70, lambda i, j: tuple(sorted((i, j))) in linked)
    assert all(got.get(i, i) == want[i] for i in range(70)) and len(set(want)) < 60
    assert len(made[-1]) == len(set(made[-1])) > 100
