"""Trees, boosting and k-means against plain versions of their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom import session
from packetloom.operators import clusters, trees
from packetloom.operators.trees import Gini, Newton


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, vector array<double>, label int")


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


def plain_cart(x, y, classes):
    """Predictions on the training rows of a tree that tries every cut of every feature."""
    out = np.zeros(len(y), int)

    def go(rows):
        counts = np.bincount(y[rows], minlength=classes)
        best = None
        if np.count_nonzero(counts) > 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for low, high in zip(values[:-1], values[1:]):
                    cut = low / 2 + high / 2
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    gain = sum((np.bincount(y[p], minlength=classes) ** 2).sum() / len(p) for p in (left, right))
                    if best is None or gain > best[0]:
                        best = gain, left, right
        if best is None:
            out[rows] = np.argmax(counts)
            return 1
        return 1 + go(best[1]) + go(best[2])

    return go(np.arange(len(y))), out


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(260, 4)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.1)) % 3
    return x, np.where(rng.random(260) < 0.1, rng.integers(0, 3, 260), y)


@pytest.mark.parametrize("handover", [20_000, 40])
def test_tree_equals_the_plain_one(spark, mixed, monkeypatch, handover):
    monkeypatch.setattr(trees, "HANDOVER", handover)
    x, y = mixed
    model = trees.fit_forest(frame(spark, x, y), 3)
    nodes, want = plain_cart(x, y, 3)
    # A leaf of the top that goes on in a part is one node in two rows.
    assert model.nodes.where("next < 0").count() == nodes
    assert (predicted(model, frame(spark, x, y)) == want).all()


def test_depth_has_no_limit(spark):
    # Labels alternate along one feature: best cuts peel the ends, so a chain of cuts is needed.
    x = np.array([[2.0**i] for i in range(60)])
    y = np.arange(60) % 2
    df = frame(spark, x, y)
    model = trees.fit_forest(df, 2)
    assert (predicted(model, df) == y).all()
    children = {r.node: (r.left, r.right) for r in model.nodes.where("part = 1 and feature >= 0").collect()}
    depth = lambda n: 1 + max(map(depth, children[n])) if n in children else 0
    assert depth(0) > 30
    stump = trees.fit_forest(df, 2, depth=1)
    assert stump.nodes.where("feature >= 0").count() == 1


@pytest.mark.parametrize("count", [1, 15])
def test_node_tables_hold_together(spark, mixed, monkeypatch, count):
    monkeypatch.setattr(trees, "HANDOVER", 50)
    x, y = mixed
    df = frame(spark, x, y)
    model = trees.fit_forest(df, 3, trees=count)
    rows = {(r.tree, r.part, r.node): r for r in model.nodes.collect()}
    for (tree, part, _), r in rows.items():
        if r.feature >= 0:
            assert r.rows == rows[tree, part, r.left].rows + rows[tree, part, r.right].rows
        elif r.next > 0:
            assert r.rows == rows[tree, r.next, 0].rows and part == 0
        else:
            assert abs(sum(r.value) - 1) < 1e-9
    assert len({t for t, _, _ in rows}) == count
    if count == 1:
        assert rows[0, 0, 0].rows == len(y)
    else:  # some 63 % of the rows are in a sample
        assert all(0.5 * len(y) < rows[t, 0, 0].rows < 0.75 * len(y) for t in range(count))
        assert (predicted(model, df) == y).mean() > 0.95
    # The same trees from rows dealt otherwise, apart from samples, which hash row numbers.
    if count == 1:
        again = trees.fit_forest(df.repartition(5, "label"), 3)
        assert sorted(map(str, again.nodes.collect())) == sorted(map(str, model.nodes.collect()))


def test_large_models_meet_rows_in_a_shuffle(spark, mixed, monkeypatch, tmp_path):
    monkeypatch.setattr(trees, "HANDOVER", 50)
    x, y = mixed
    df = frame(spark, x, y)
    for model in (trees.fit_forest(df, 3, trees=4), trees.fit_boosted(df, 3, 2, 4)):
        whole = model.transform(df).orderBy("id").collect()
        with monkeypatch.context() as m:
            m.setattr(trees, "SHARED_NODES", 0)
            parts = model.transform(df).orderBy("id").collect()
        assert [r.prediction for r in parts] == [r.prediction for r in whole]
        assert np.allclose([r.probability for r in parts], [r.probability for r in whole])
        model.save(str(tmp_path / "m"))
        again = trees.TreeModel.load(spark, str(tmp_path / "m"))
        assert again.transform(df).orderBy("id").collect() == whole


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_forests_take_their_trees_in_waves(spark, mixed, monkeypatch):
    monkeypatch.setattr(trees, "HANDOVER", 50)
    x, y = mixed
    df = frame(spark, x, y)
    whole = trees.fit_forest(df, 3, trees=15)
    want = whole.transform(df).orderBy("id").collect()
    monkeypatch.setattr(trees, "WAVE_ROWS", 0, raising=False)
    monkeypatch.setattr(trees, "LEAST_WAVE", 4, raising=False)
    monkeypatch.setattr(trees, "SHARED_NODES", 0)
    before = shuffle_bytes(spark)
    waves = trees.fit_forest(df, 3, trees=15)
    got = waves.transform(df).orderBy("id").collect()
    # Neither rows dealt to trees nor copies of nodes stay on disk.
    assert shuffle_bytes(spark) - before < 300_000
    assert sorted(map(str, waves.nodes.collect())) == sorted(map(str, whole.nodes.collect()))
    assert [r.prediction for r in got] == [r.prediction for r in want]
    assert np.allclose([r.probability for r in got], [r.probability for r in want])


def plain_boost(x, y, classes, rounds, depth, rule):
    """Margins of a booster that sums gradients row by row over all cuts between bins."""
    outputs = classes if classes > 2 else 1
    margins = np.zeros((len(y), outputs))
    for _ in range(rounds):
        both = trees.gradients(margins, y, classes)
        step = np.zeros_like(margins)
        for k in range(outputs):
            g, h = both[:, k, 0], both[:, k, 1]

            def go(rows, level, g=g, h=h, k=k):
                score = lambda p: g[p].sum() ** 2 / (h[p].sum() + rule.ridge)
                best = None
                for f in range(x.shape[1]) if level < depth else ():
                    for cut in np.unique(x[rows, f])[:-1]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(h[left].sum(), h[right].sum()) < rule.least_hessian:
                            continue
                        gain = score(left) + score(right)
                        if best is None or gain > best[0]:
                            best = gain, left, right
                if best is None or best[0] - score(rows) <= rule.least_gain:
                    step[rows, k] = -rule.rate * g[rows].sum() / (h[rows].sum() + rule.ridge)
                else:
                    go(best[1], level + 1)
                    go(best[2], level + 1)

            go(np.arange(len(y)), 0)
        margins += step
    return margins


@pytest.mark.parametrize("classes,handover,write", [(2, 20_000, 2), (3, 20_000, 20), (3, 60, 2), (2, 60, 20)])
def test_boosting_equals_the_plain_one(spark, mixed, monkeypatch, classes, handover, write):
    monkeypatch.setattr(trees, "HANDOVER", handover)
    monkeypatch.setattr(trees, "WRITE_EVERY", write)
    x, y = mixed
    y = np.minimum(y, classes - 1)
    df = frame(spark, x, y)
    model = trees.fit_boosted(df, classes, 5, 4)
    margins = plain_boost(x, y, classes, 5, 4, Newton())
    p = trees.softmax(margins) if classes > 2 else np.hstack([1 - trees.sigmoid(margins), trees.sigmoid(margins)])
    got = np.array([r.probability for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, p, atol=1e-9)
    assert {r.tree for r in model.nodes.select("tree").collect()} == set(range(5 * (classes if classes > 2 else 1)))


def test_boosting_learns(spark, mixed):
    x, y = mixed
    df = frame(spark, x, y)
    assert (predicted(trees.fit_boosted(df, 3, 30, 8), df) == y).mean() > 0.95


def test_odd_tables(spark):
    one_class = frame(spark, [[1.0, 2.0], [3.0, 4.0]], [0, 0])
    assert predicted(trees.fit_forest(one_class, 2), one_class).tolist() == [0, 0]
    assert predicted(trees.fit_boosted(one_class, 2, 2, 3), one_class).tolist() == [0, 0]
    alike = frame(spark, [[1.0], [1.0], [1.0]], [1, 0, 1])  # cannot be told apart
    assert predicted(trees.fit_forest(alike, 2), alike).tolist() == [1, 1, 1]
    some = trees.fit_forest(one_class, 2).transform(one_class.where("id < 0"))
    assert some.count() == 0


def test_gini_takes_splits_that_gain_nothing():
    x = np.array([[0.0, 0], [0, 1], [1, 0], [1, 1]])
    stats = np.array([[1, 0, 1], [0, 1, 1], [0, 1, 1], [1, 0, 1]], float)
    nodes = trees.finish(trees.Plan(Gini(2), 2), 0, 1, 0, x, stats)
    assert len(nodes.feature) == 7 and all(max(v) == 1 for f, v in zip(nodes.feature, nodes.value) if f < 0)


def test_splits_of_bytes_and_doubles_agree():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 256, 3000).astype(np.uint8)
    stats = rng.integers(0, 5, (3000, 3)).astype(float)
    bins = np.stack([bins, rng.integers(0, 4, 3000).astype(np.uint8)], 1)
    at, left, _ = trees.candidates(bins, stats)
    other, left_of, between = trees.candidates(bins.astype(float), stats)
    for f in range(2):
        found = dict(zip(at[:, f].tolist(), left[:, f].tolist()))
        real = between[:, f]
        assert real.any() and all(found[int(np.floor(c))] == sums for c, sums in zip(other[real, f], left_of[real, f].tolist()))


def plain_lloyd(x, centers, most, least):
    for n in range(most):
        place = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        new = np.array([x[place == k].mean(0) if (place == k).any() else c for k, c in enumerate(centers)])
        shift = ((new - centers) ** 2).sum()
        centers = new
        if shift <= least:
            break
    return centers, ((x[:, None] - centers) ** 2).sum(2).min(1).sum(), n + 1


def test_all_center_sets_in_one_scan(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1, (60, 3)) for c in (0, 4, 9)])
    df = frame(spark, x, [0] * 180)
    starts = [x[rng.choice(180, k, replace=False)] for k in (2, 3, 5, 3)]
    starts.append(np.vstack([x[0], [1e6] * 3]))  # a center without rows stays where it is
    counter = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lloyd", "lloyd")
    fitted = clusters.fit_many(df, starts)
    jobs = len(counter.getJobIdsForGroup("lloyd"))
    least = clusters.TOLERANCE * x.var(0).mean()
    for start, model in zip(starts, fitted):
        centers, inertia, rounds = plain_lloyd(x, start, clusters.MAX_ITERATIONS, least)
        assert np.allclose(model.centers, centers) and model.inertia == pytest.approx(inertia) and model.iterations == rounds
    # An iteration is a job of its map stage and one of its result, whatever the number of sets.
    assert jobs <= 2 * (max(m.iterations for m in fitted) + 1) + 4


def test_silhouettes_of_all_fits_at_once(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 1, (40, 2)) for c in (0, 5, 12)])
    df = frame(spark, x, [0] * 120)
    fitted = clusters.fit_sweep(df, range(2, 5), restarts=2)
    scores = clusters.silhouettes(df, "id", fitted, block_rows=33)
    for k, model in fitted.items():
        placed = model.transform(df).select("id", F.col("vector").alias("point"), F.col("prediction").alias("cluster"))
        assert scores[k] == pytest.approx(clusters.silhouette(placed, "id"), abs=1e-6)
    assert max(scores, key=scores.get) == 3


def test_cluster_model_round_trip(spark, tmp_path):
    model = clusters.ClusterModel(np.array([[0.0, 1.0], [5.0, 5.0]]), 1.5)
    model.save(spark, str(tmp_path / "k"))
    again = clusters.ClusterModel.load(spark, str(tmp_path / "k"))
    assert np.array_equal(again.centers, model.centers) and again.inertia == 1.5
    df = frame(spark, [[0, 0], [9, 9]], [0, 0])
    assert [r.prediction for r in again.transform(df).orderBy("id").collect()] == [0, 1]


def test_distances_of_near_rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)) + 1e3
    y = np.vstack([x[:40], x[40:80] + 1e-9, rng.normal(size=(50, 5))])
    assert np.allclose(clusters.distances(x, y), np.sqrt(((x[:, None] - y) ** 2).sum(2)), rtol=1e-11, atol=0)


def test_blocks_of_a_silhouette_are_not_copied(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 1, (100, 40)) for c in (0, 1, 4)])
    placed = frame(spark, x, np.arange(300) // 100).select("id", F.col("vector").alias("point"), F.col("label").alias("cluster"))
    before = shuffle_bytes(spark)
    got = clusters.silhouette_rows(placed, "id", block_rows=5).orderBy("id").collect()
    assert shuffle_bytes(spark) - before < 5_000_000
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    own = np.arange(300) // 100
    means = np.stack([far[:, own == c].sum(1) / (100 - (own == c)) for c in range(3)], 1)
    within = means[np.arange(300), own]
    means[np.arange(300), own] = np.inf
    near = means.min(1)
    assert np.allclose([r.silhouette for r in got], (near - within) / np.maximum(near, within))


@pytest.mark.parametrize("classes", [2, 3])
def test_boosting_over_levels_equals_the_plain_one(spark, mixed, monkeypatch, classes):
    monkeypatch.setattr(trees, "HANDOVER", 8)
    x, y = mixed
    y = np.minimum(y, classes - 1)
    df = frame(spark, x, y)
    margins = plain_boost(x, y, classes, 2, 4, Newton())
    p = trees.softmax(margins) if classes > 2 else np.hstack([1 - trees.sigmoid(margins), trees.sigmoid(margins)])
    model = trees.fit_boosted(df, classes, 2, 4)
    assert model.nodes.where("next > 0").count() > 0
    got = np.array([r.probability for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose(got, p, atol=1e-9)


def test_bins_are_handed_over_with_more_rows(spark, mixed, monkeypatch):
    monkeypatch.setattr(trees, "HANDOVER", 60)
    x, y = mixed
    levels, level = [], trees._level
    monkeypatch.setattr(trees, "_level", lambda *a: levels.append(1) or level(*a))
    trees.fit_boosted(frame(spark, x, y), 3, 2, 4)
    assert not levels  # 260 rows of bins are fewer than 60 of doubles


def test_smaller_children_give_the_larger_ones():
    rng = np.random.default_rng(8)
    bins = np.minimum(rng.integers(0, 400, (4000, 3)), 255).astype(np.uint8)
    g = np.rint(rng.normal(size=4000) * trees._EXACT / 4) / trees._EXACT
    stats = np.stack([g + (bins[:, 0] > 90) * 0.5, np.full(4000, 0.25), np.ones(4000)], 1)
    plan = trees.Plan(Newton(), 3, 6)
    nodes = trees.finish(plan, 0, 1, 0, bins, stats)
    # Doubles are sorted instead; their cuts are midpoints of the same two bins.
    other = trees.finish(plan, 0, 1, 0, bins.astype(float), stats)
    assert nodes.feature == other.feature and nodes.rows == other.rows and nodes.value == other.value and len(nodes.feature) > 20


@pytest.mark.parametrize("rule", [Newton(), Gini(3)])
def test_cells_add_up_rows_by_slot_and_bin(rule):
    rng = np.random.default_rng(9)
    cuts = [np.arange(1.0), np.zeros(0), np.arange(255.0), np.arange(1.0), np.arange(4.0)]
    layout = trees.Layout.of(cuts)
    n = trees.CHUNK + 1000  # the packed sums of a chunk are full
    bins = np.stack([rng.integers(0, size, n) for size in layout.sizes]).astype(np.uint8)
    if rule.groups == 1:
        g = np.rint(rng.uniform(-1, 1, n) * trees._EXACT) / trees._EXACT
        stats = np.stack([np.where(np.arange(n) < trees.CHUNK, -1, g), np.abs(g), np.ones(n)], 1)
    else:
        stats = np.zeros((n, 4))
        stats[np.arange(n), rng.integers(0, 3, n)] = np.where(np.arange(n) < trees.CHUNK, 17, rng.integers(1, 18, n))
        stats[:, 3] = 1
    for slots in (1, 2, 40):
        slot = rng.integers(0, slots, n)
        got = trees.cells(bins, slot, slots, stats, rule, layout)
        for place, (begin, size) in enumerate(zip(layout.begins, layout.sizes)):
            for c in range(rule.channels):
                want = np.bincount(slot * size + bins[place], stats[:, c], slots * size).reshape(slots, size)
                assert (got[c, :, begin : begin + size] == want).all()


def test_parts_of_a_round_do_not_share_a_task(spark, mixed):
    # Equal shares of the rows for each task, whatever the hash of (tree, part).
    x, y = mixed
    df = frame(spark, x, y)
    shares = trees._shares(df, {(tree, 1): 100.0 for tree in range(5)}, 1000)
    assert sorted(shares.values()) == list(range(5))
    some = trees._shares(df, {(0, part): float(size) for part, size in enumerate([90, 10, 10, 10, 10] * 8)}, 1000)
    loads = np.bincount(list(some.values()), [[90, 10, 10, 10, 10][part % 5] for _, part in some])
    assert loads.max() < 2 * loads.mean()


def test_features_of_one_value_have_no_bins(spark, monkeypatch):
    x = np.array([[1.0, 5.0, float(i % 3)] for i in range(90)])
    df = frame(spark, x, np.arange(90) % 3)
    cuts = trees.cut_points(df, F.col("vector"))
    assert [len(c) for c in cuts] == [0, 0, 2]
    assert trees.Layout.of(cuts).cells == 3
    model = trees.fit_boosted(df, 3, 8, 3)
    assert (predicted(model, df) == np.arange(90) % 3).all()
    none = frame(spark, x[:, :2], np.arange(90) % 3)
    for handover in (20_000, 5):  # in one task, and by levels
        monkeypatch.setattr(trees, "HANDOVER", handover)
        assert trees.fit_boosted(none, 3, 2, 3).nodes.where("feature >= 0").count() == 0


def test_margins_are_kept_once(spark, mixed, monkeypatch):
    x, y = mixed
    written, removed = [], []
    path_of, remove = trees.table_path, trees.remove_path
    monkeypatch.setattr(trees, "table_path", lambda s, n: written.append(path_of(s, n)) or written[-1])
    monkeypatch.setattr(trees, "remove_path", lambda s, p: removed.append(p) or remove(s, p))
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    trees.fit_boosted(frame(spark, x, y), 3, 7, 3)
    margins = [p for p in written if "/margins-" in p]
    assert len(margins) == 3 and removed == margins[:-1]


@pytest.mark.parametrize("tried", [None, 2])
def test_coded_values_give_the_trees_of_doubles(tried):
    rng = np.random.default_rng(3)
    # Few values, one value, many values; more rows than are sorted.
    x = np.stack([rng.integers(-5, 6, 3000) / 4, np.full(3000, 2.0), rng.normal(size=3000), rng.integers(0, 200, 3000) ** 2.0], 1)
    label = ((x[:, 0] > 0.3).astype(int) + (x[:, 2] * x[:, 3] > 900)) % 3
    stats = np.zeros((3000, 4))
    stats[np.arange(3000), label], stats[:, -1] = rng.integers(1, 4, 3000), 1
    features = trees.Features.of([np.unique(c) if len(np.unique(c)) <= trees.BINS else None for c in x.T])
    assert features.coded.tolist() == [0, 3] and features.wide.tolist() == [2] and features.bytes_of_row == 10
    plan = trees.Plan(Gini(3), 4, tried=tried)
    got = trees.finish_values(plan, 5, 1, 0, trees.Rows(features, *features.packed(x)), stats)
    want = trees.finish(plan, 5, 1, 0, x, stats)
    assert got == want and len(got.feature) > 50


def test_values_of_features(spark):
    x = np.array([[float(i % 7), float(i), -0.0 if i % 2 else 0.0, float("nan") if i == 3 else 1.0] for i in range(600)])
    known = trees.few_values(frame(spark, x, np.zeros(600, int)).repartition(3), F.col("vector"))
    assert known[0].tolist() == list(range(7)) and known[1] is None and known[2].tolist() == [0.0] and known[3] is None
    # Features of one value need no cuts; those of no rows have none.
    cuts = trees.cut_points(frame(spark, x[:, :3], np.zeros(600, int)), F.col("vector"), single={2})
    assert [len(c) > 0 for c in cuts] == [True, True, False]
    assert trees.few_values(frame(spark, x[:0], []), F.col("vector")) == []


def test_threads_share_the_removal_of_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    first, second = session.shuffles_removed(spark), session.shuffles_removed(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "true"  # one is still inside
    second.__exit__(None, None, None)
    assert spark.conf.get(key) == before
