import numpy as np

import pytest

from chronotext.llm.embed_dedup import alike, block_of, choose, linked, near_duplicate_vectors, packed, projection_keys, spanning_links, unpacked


def brute_groups(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for a, b in np.argwhere(np.triu(x @ x.T >= threshold, 1)):
        pairs.add((ids[a], ids[b]))
        p, q = sorted((top(ids[a]), top(ids[b])))
        root[q] = p
    return pairs, {i: top(i) for pair in pairs for i in pair}


def planted(n, seed, noise):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    for k in range(0, n // 2, 5):  # groups of five
        x[k + 1 : k + 5] = x[k] + noise * rng.standard_normal((4, 64))
    return x


def test_recall_against_brute_force(spark):
    x = planted(3000, 1, 0.2)
    ids = list(range(0, 6000, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").repartition(7)
    pairs, groups = brute_groups(ids, x, 0.9)
    got = {r.vec_id: r.group_id for r in near_duplicate_vectors(df).collect()}
    found = sum(a in got and got.get(a) == got.get(b) for a, b in pairs)
    assert len(pairs) > 2000 and found >= 0.95 * len(pairs)
    assert all(groups[i] == groups.get(g) for i, g in got.items())


def test_window_crosses_partitions(spark):
    x = planted(400, 2, 0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    _, groups = brute_groups(list(range(400)), x, 0.9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all partitions
    try:
        got = {r.vec_id: r.group_id for r in near_duplicate_vectors(df, passes=16).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == groups


def test_links_span_all_pairs_of_the_window():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((20, 8)), 6, axis=0).astype(np.float32) + 0.2 * rng.standard_normal((120, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for w in (3, 16):
        want = [(i, j) for j in range(120) for i in range(max(0, j - w), j) if x[i] @ x[j] >= 0.9]

        def comps(pairs):
            root = list(range(120))
            for i, j in pairs:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        i, j, sure = spanning_links(x, np.zeros(120, np.float32), w, 0.9)
        assert sure.mean() > 0.99
        assert comps(zip(i.tolist(), j.tolist())) == comps(want)


def test_keys_order_as_bits():
    x = np.random.default_rng(4).standard_normal((50, 8)).astype(np.float32)
    k = projection_keys(x, 2, 0)
    assert k.shape == (50, 2) and k.dtype == np.int64 and len(np.unique(k[:, 0])) == 50
    assert (projection_keys(x * 5, 2, 0) == k).all()


def test_odd_rows(spark):
    a = [1.0, 2.0, 3.0]
    rows = [(1, a, "x", 1), (2, a, "y", 2), (2, a, "y", 2), (3, None, "z", 3), (None, a, "", 4), (4, [], "", 5), (5, [0.0, 0.0, 0.0], "", 6), (6, [float("nan"), 1.0, 1.0], "", 7), (7, [1.0, 2.0], "", 8), (8, [2.0, 4.0], "", 9), (9, [None, 1.0, 2.0], "", 10)]
    rows += [(100 + i, [3.0, -1.0, 0.5], "copies", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, id int")
    got = {r.vec_id: r.group_id for r in near_duplicate_vectors(df).collect()}
    assert got == {1: 1, 2: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(300)}
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def at_threshold(n, dim, pairs, cos, mean, rng):
    """n unit vectors of that mean mutual cosine, of which the first pairs * 2 are pairs of nearly that cosine."""
    c = np.zeros(dim)
    c[0] = np.sqrt(mean)

    def own(k):
        y = rng.standard_normal((k, dim))
        y[:, 0] = 0
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    x = c + np.sqrt(1 - mean) * own(n)
    rho = (cos - mean) / (1 - mean)
    for k in range(pairs):
        a = (x[2 * k] - c) / np.sqrt(1 - mean)
        z = own(1)[0]
        z -= (z @ a) * a
        x[2 * k + 1] = c + np.sqrt(1 - mean) * (rho * a + np.sqrt(1 - rho * rho) * z / np.linalg.norm(z))
    return x


@pytest.mark.parametrize("mean", [0.0, 0.6])
def test_recall_of_pairs_at_the_threshold(spark, mean):
    """Pairs of cosine 0.90 to 0.92, also where all vectors lie together."""
    rng = np.random.default_rng(6)
    x = at_threshold(20000, 64, 400, 0.91, mean, rng)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    pairs = [(2 * k, 2 * k + 1) for k in range(400) if x[2 * k] @ x[2 * k + 1] >= 0.9001 * np.linalg.norm(x[2 * k]) * np.linalg.norm(x[2 * k + 1])]
    got = {r.vec_id: r.group_id for r in near_duplicate_vectors(df).collect()}
    assert len(pairs) > 350 and sum(a in got and got[a] == got.get(b) for a, b in pairs) >= 0.93 * len(pairs)


def test_passes_grow_slowly_with_the_number_of_vectors():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = np.zeros(64)
    plans = [choose(x, c, n, 0.9, 0.97) for n in (100, 10_000, 10**6, 10**8, 10**10)]
    passes = [p for p, _ in plans]
    assert passes == sorted(passes) and passes[0] == 1 and passes[1] <= 12 and passes[3] < 120


def test_errors_bound_the_packed_cosines():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, e = unpacked([r.tobytes() for r in packed(x)], 48)
    slack = e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-5
    assert (np.abs(x @ x.T - y @ y.T) <= slack).all() and slack.max() < 0.05


def test_window_reaches_over_small_partitions(spark):
    """Many partitions with a few rows of a pass each lose no pair of the window."""
    x = planted(300, 9, 0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    _, groups = brute_groups(list(range(300)), x, 0.9)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r.vec_id: r.group_id for r in near_duplicate_vectors(df, passes=2, window=300).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == groups  # a window of all rows compares all pairs


@pytest.fixture
def many_blocks(spark):
    """Partitions, and so blocks, of few rows."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("mean", [0.0, 0.6])
def test_no_link_at_the_threshold_is_lost(spark, many_blocks, mean):
    """A sample's angles and a window lost some of these pairs."""
    x = at_threshold(12000, 64, 2000, 0.903, mean, np.random.default_rng(10)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    pairs, groups = brute_groups(list(range(len(x))), x.astype(np.float64), 0.9)
    assert len(pairs) > 1900
    assert {r.vec_id: r.group_id for r in near_duplicate_vectors(df).collect()} == groups


def test_groups_over_blocks_that_are_apart(spark, many_blocks):
    """Large groups, narrow or chained, copies in several blocks, an id with two vectors, and two lengths."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.standard_normal((6, 24)), 300, axis=0)
    x += np.repeat([0.02, 0.05, 0.2, 0.3, 0.4, 0.6], 300)[:, None] * rng.standard_normal(x.shape)
    x[1750:] = x[7]
    x = x.astype(np.float32)
    _, groups = brute_groups(list(range(1800)), x.astype(np.float64), 0.9)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = [(5000 + i, v[:5].tolist()) for i, v in enumerate(x[:600])]
    _, short = brute_groups([i for i, _ in other], x[:600, :5].astype(np.float64), 0.9)
    rows += other + [(9000, x[10].tolist()), (9000, x[310].tolist())]  # joins two groups
    first, second = groups[10], groups[310]
    assert first != second and len(set(groups.values())) > 3
    want = {i: min(first, second) if g in (first, second) else g for i, g in groups.items()} | short | {9000: min(first, second)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert {r.vec_id: r.group_id for r in near_duplicate_vectors(df).collect()} == want


@pytest.mark.parametrize("dim", [1, 2, 7, 64])
def test_linked_blocks_against_brute_force(dim):
    rng = np.random.default_rng(dim)
    x = np.repeat(rng.standard_normal((300, dim)), 3, axis=0)
    x = (x + 0.25 * rng.standard_normal(x.shape)).astype(np.float32)[rng.permutation(900)]
    _, groups = brute_groups(list(range(900)), x.astype(np.float64), 0.9)
    want = np.array([groups.get(i, i) for i in range(900)])
    a, b = block_of(x[:500]), block_of(x[500:])
    root = np.r_[linked(a, a, np.arange(500), 0.9), 500 + linked(b, b, np.arange(400), 0.9)]
    assert (linked(a, b, root, 0.9) == want).all()


def test_cosines_next_to_the_threshold_are_decided_in_double_precision():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((4000, 2)).astype(np.float32)
    turn = np.arccos(0.9) + np.linspace(-2e-6, 2e-6, 4000)
    y = np.stack([x[:, 0] * np.cos(turn) - x[:, 1] * np.sin(turn), x[:, 0] * np.sin(turn) + x[:, 1] * np.cos(turn)], axis=1).astype(np.float32)
    p, q = x.astype(np.float64), y.astype(np.float64)
    want = (p * q).sum(axis=1) >= 0.9 * np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1))
    got = np.array([linked(block_of(x[k : k + 1]), block_of(y[k : k + 1]), np.arange(2), 0.9)[1] == 0 for k in range(4000)])
    assert 1000 < want.sum() < 3000 and (alike(x, y, 0.9) == want).all() and (got == want).all()
