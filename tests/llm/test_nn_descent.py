import numpy as np

from ledgerloom.llm.frames import table
from ledgerloom.llm.nn_descent import COSINE, link_graph, near_duplicates

SCHEMA = "vec_id long, embedding array<double>, label int, node string, `order` string, `a.b` string"


def by_hand(rows):
    """Links of every row with every other row, and the smallest id reachable."""
    d = max((len(v) for _, v in rows if v is not None), default=0)
    units = np.zeros((len(rows), d))
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array([*v, *[0.0] * (d - len(v))])
            units[k] = x / np.abs(x).max()
            units[k] /= np.linalg.norm(units[k])
    linked = units @ units.T >= COSINE
    np.fill_diagonal(linked, False)
    ids = [1 << 62 if i is None else i for i, _ in rows]
    least = np.array(ids)
    while True:
        near = np.where(linked, least, 1 << 62).min(1)
        if (near >= least).all():
            break
        least = np.minimum(least, near)
    public = [None if x == 1 << 62 else int(x) for x in least]
    order = [(-1 if i is None else i, n, -1 if c is None else c, o == x) for (i, _), n, c, o, x in zip(
        rows, linked.sum(1).tolist(), public, ids, least.tolist(), strict=True)]
    return sorted(order)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in rows], SCHEMA)
    found = near_duplicates(df.repartition(3)).collect()
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2], r[3]) for r in found)


def spread(pick, n, d, cosine):
    """Vectors that all have about this cosine with each other."""
    middle = pick.normal(size=d)
    x = pick.normal(size=(n, d))
    x -= np.outer(x @ middle, middle) / (middle @ middle)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.sqrt(cosine) * middle / np.linalg.norm(middle) + np.sqrt(1 - cosine) * x


def numbered(x, first=0):
    return [(first + k, v.tolist()) for k, v in enumerate(x)]


def test_groups_chains_and_loners(spark):
    pick = np.random.default_rng(3)
    d = 128
    middles = pick.normal(size=(40, d))
    pairs = np.concatenate([middles + pick.normal(size=middles.shape) * s for s in (0.0, 0.05, 0.25, 0.4)])
    turn = np.linspace(0, 3, 20)
    chain = np.outer(np.cos(turn), np.eye(d)[0]) + np.outer(np.sin(turn), np.eye(d)[1])
    rows = numbered(np.concatenate([pick.normal(size=(300, d)), pairs, chain, 5.0 * pairs[:7]]))
    # Lists of eight are full of links here, without any two vectors in one ball.
    rows += numbered(spread(pick, 60, d, 0.93), 1000)
    # One hot group of near copies, and one of exact copies.
    rows += numbered(spread(pick, 150, d, 0.99), 2000) + [(3000 + k, [1.0, 2.0]) for k in range(120)]
    assert run(spark, rows) == by_hand(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf")])]
    rows += [(7, [1.0]), (8, [2.0, 0.0, 0.0]), (9, [1e300, 1e-300]), (9, [1e-300]), (9, [-1.0]), (7, [1.0])]
    rows += [(None, [0.0, 0.0, 3.0]), (None, [0.0, 0.0, 4.0]), (None, [3.0, 0.0, 0.1]), (None, None)]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, []) == [] and run(spark, [(5, None)]) == [(5, 0, 5, True)]


def test_recall_is_audited(spark):
    given = table(spark, "/root/testdata/sf0.01", "embeddings").selectExpr("vec_id as `order`", "embedding as vector")
    graph = link_graph(given)
    assert graph.recall >= 0.98 and graph.nodes.agg({"copies": "sum"}).first()[0] == 500
