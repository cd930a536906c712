"""Forest, boosting and attributions by their invariants, on small parameters."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import alerts, attribution, boosting, forest, quality
from tallywatch.operators.features import build_features
from tallywatch.operators.rules import AmountStats, score_rules
from tallywatch.plans.models import alert_attributions, load_models, score_batch, train_models
from tallywatch.sources import tables


@pytest.fixture(scope="module")
def features(txn):
    return build_features(txn).persist()


@pytest.fixture(scope="module")
def store(spark, txn, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    return folder, train_models(txn, folder, rounds=5, trees=10)


def test_expected_path():
    assert forest.expected_path(1) == 0 and forest.expected_path(2) == 1
    assert abs(forest.expected_path(256) - 10.244770920) < 1e-6


def test_hand_made_tree():
    """Root splits feature 0 at 1.0: one row alone below, two together above."""
    trees = forest.Forest(
        feature=np.array([0, 0, 0], dtype=np.int32),
        threshold=np.array([1.0, np.inf, np.inf]),
        lower=np.array([1, 1, 2], dtype=np.int32),
        upper=np.array([2, 1, 2], dtype=np.int32),
        path=np.array([0.0, 1.0, 2.0]),
        roots=np.array([0], dtype=np.int32),
        depth=2,
        sample_size=3,
    )
    c = forest.expected_path(3)
    assert np.allclose(trees.raw_scores(np.array([[0.5], [1.0], [2.0]])), [-(2 ** (-1 / c))] * 2 + [-(2 ** (-2 / c))])


def test_tree_samples_are_bounded(spark):
    rows = spark.range(5000).select(F.col("id").alias("txn_id"), *(F.lit(0.0).alias(c) for c in C.FEATURE_COLUMNS))
    samples, size = forest.tree_samples(rows, 5000, trees=7, rows_per_tree=256, seed=1)
    counts = [r["count"] for r in samples.groupBy("tree_id").count().collect()]
    assert size == 256 and len(counts) == 7 and set(counts) == {256}
    assert samples.groupBy("tree_id", "txn_id").count().filter("count > 1").count() == 0
    every, size = forest.tree_samples(rows.limit(100), 100, trees=3, rows_per_tree=256, seed=1)
    assert size == 100 and every.count() == 300


def test_outliers_score_lower(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(2000, len(C.FEATURE_COLUMNS)))
    data[:10] += 8
    df = spark.createDataFrame(pd.DataFrame(data, columns=C.FEATURE_COLUMNS).assign(txn_id=range(2000)))
    grown = forest.Forest.from_nodes(*forest.fit_forest(df, 2000, trees=50, rows_per_tree=256))
    raw = forest.with_anomaly_raw(df, grown)
    planted = raw.filter("txn_id < 10").agg(F.max("anomaly_raw")).first()[0]
    bulk = raw.filter("txn_id >= 10").agg(F.percentile_approx("anomaly_raw", 0.01)).first()[0]
    assert -1 <= planted < bulk <= 0


def plain_isolation_tree(x, limit, rng):
    """The tree as nested recursion: (feature, threshold, lower, upper) or a path length."""

    def grow(rows, depth):
        if depth < limit and len(rows) > 1:
            for feature in rng.permutation(x.shape[1]):
                values = [x[r, feature] for r in rows]
                if min(values) < max(values):
                    cut = rng.uniform(min(values), max(values))
                    cut = cut if cut < max(values) else min(values)
                    lower = grow([r for r in rows if x[r, feature] <= cut], depth + 1)
                    return feature, cut, lower, grow([r for r in rows if x[r, feature] > cut], depth + 1)
        return depth + forest.expected_path(len(rows))

    return grow(list(range(len(x))), 0)


def test_growth_matches_a_plain_twin():
    x = np.round(np.random.default_rng(2).normal(size=(300, 4)), 1)
    x[:, 3] = 1.0
    x[250:] = x[0]
    nodes = forest.grow_tree(x, 9, np.random.default_rng([7, 1])).set_index("node_id")

    def tree(node):
        n = nodes.loc[node]
        return n["path"] if n["feature"] < 0 else (n["feature"], n["threshold"], tree(n["lower"]), tree(n["upper"]))

    assert tree(0) == plain_isolation_tree(x, 9, np.random.default_rng([7, 1]))


def test_forest_does_not_depend_on_layout(features):
    a, _ = forest.fit_forest(features, 1000, trees=3, rows_per_tree=200)
    b, _ = forest.fit_forest(features.repartition(7), 1000, trees=3, rows_per_tree=200)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_pattern_values_match_subsets():
    """The tables equal Shapley values computed over all subsets."""
    share, value, m = np.array([[0.3, 0.6, 0.9]]), np.array([2.0]), 3
    got = attribution.pattern_values(share, value)[0]
    for pattern in range(2**m):
        holds = [(pattern >> i) & 1 for i in range(m)]

        def worth(subset):
            return 2.0 * math.prod(holds[i] if i in subset else share[0][i] for i in range(m))

        for j in range(m):
            others = [i for i in range(m) if i != j]
            total = 0.0
            for mask in range(2 ** len(others)):
                subset = {others[i] for i in range(len(others)) if mask >> i & 1}
                weight = math.factorial(len(subset)) * math.factorial(m - len(subset) - 1) / math.factorial(m)
                total += weight * (worth(subset | {j}) - worth(subset))
            assert abs(total - got[pattern][j]) < 1e-12


def test_subtrees_of_any_size_explain_the_same(spark, features, store):
    models = load_models(spark, store[0])
    entry = tables.latest_model(spark, f"{store[0]}/registry")
    nodes = spark.read.parquet(entry["classifier_path"])
    x = features.select(*C.FEATURE_COLUMNS).limit(300).toPandas().to_numpy(float)
    alone = attribution.build_tables(nodes, most_cells=0)  # a leaf a table
    assert len(alone.blocks) > 2 * len(models.leaf_tables.blocks)
    assert np.abs(alone.explain(x) - models.leaf_tables.explain(x)).max() < 1e-12


def test_rows_are_explained_once(spark, features, store):
    """Listing attributions makes a filter of them, which must not run the explanation again below."""
    listed = attribution.with_attributions(features, load_models(spark, store[0]).leaf_tables).select("txn_id", F.posexplode("attributions"))
    assert listed._jdf.queryExecution().executedPlan().toString().count("explain(") == 1


def test_training_and_attribution_sum(spark, features, store):
    folder, entry = store
    models = load_models(spark, folder)
    assert models.version == entry["model_version"] and tables.models_ready(spark, f"{folder}/registry")
    assert 0 <= entry["precision"] <= 1 and entry["dataset_rows"] == 1000
    explained = attribution.with_impacts(features, models.leaf_tables)
    total = F.aggregate("impacts", F.lit(models.leaf_tables.base), lambda a, b: a + b)
    both = boosting.with_probability(explained.withColumn("total", total), models.classifier)
    worst = both.agg(
        F.max(F.abs(F.col("probability") - 1 / (1 + F.exp(-F.col("total"))))),
        F.count_if((F.col("prediction") == 1) != (F.col("probability") > 0.5)),
    ).first()
    assert worst[0] < 1e-9 and worst[1] == 0


def test_classifier_beats_base_rate(spark, features, store):
    models = load_models(spark, store[0])
    row = quality.classifier_metrics(boosting.with_probability(features, models.classifier)).first()
    assert row["recall"] > 0.5 and row["precision"] > 2 * 0.027


def test_hybrid_batch(spark, txn, store):
    models = load_models(spark, store[0])
    scored = score_batch(txn, C.V2, models, penalise=True).persist()
    assert scored.count() == 1000
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 100
    assert scored.filter("(score >= 70) <> (risk_level = 'HIGH')").count() == 0
    assert scored.filter("size(attributions) > 3").count() == 0
    assert scored.agg(F.max("anomaly_raw") - F.min("anomaly_raw")).first()[0] > 0


def test_without_models(txn):
    scored = score_batch(txn)
    assert scored.filter("size(attributions) = 0").count() == 1000 and "model_score" not in scored.columns


def test_weak_supervision(spark, txn, tmp_path):
    entry = train_models(txn.drop("label"), str(tmp_path), rounds=2, trees=5)
    assert entry["precision"] is None and load_models(spark, str(tmp_path)) is not None


def test_alert_attributions(spark, txn, store):
    models = load_models(spark, store[0])
    made = alerts.generate_alerts(score_rules(txn), "b", F.col("ts"))
    explained = alerts.explain_alerts(made, lambda missing: alert_attributions(missing, models))
    assert explained.count() == made.count()
    assert explained.filter("size(attributions) = 0 OR size(attributions) > 5").count() == 0
    # The stored fields of an alert say what its row says: the same attributions come from the rows themselves.
    lone = build_features(txn, AmountStats(rows=1), models.codes, stateless=True)
    direct = {r["txn_id"]: r["attributions"] for r in attribution.with_attributions(lone, models.leaf_tables, 5).collect()}
    ids = {r["alert_id"]: r["txn_id"] for r in made.collect()}
    assert all(r["attributions"] == direct[ids[r["alert_id"]]] for r in explained.collect())


# --- boosting ----------------------------------------------------------------------------------------


def labelled(spark, n=1200):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(n, len(C.FEATURE_COLUMNS))), 1)
    x[:, 2] = rng.integers(0, 2, n)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) * 0.3) > 1).astype(int)
    pdf = pd.DataFrame(x, columns=C.FEATURE_COLUMNS).assign(label=y, txn_id=range(n))
    return spark.createDataFrame(pdf), x, y


def plain_tree(x, g, h, depth, edges):
    """Every split of every node tried one by one: (node, feature, threshold, G, H) from the root on."""
    out = {}

    def grow(node, rows, level):
        gt, ht = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        for f in range(x.shape[1]) if level < depth else ():
            for e in edges[f]:
                low = rows[x[rows, f] <= e]
                gl, hl = g[low].sum(), h[low].sum()
                if hl >= 1 and ht - hl >= 1:
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, e))
        out[node] = (best[1], gt, ht)
        if best[1]:
            low = x[rows, best[1][0]] <= best[1][1]
            grow(2 * node + 1, rows[low], level + 1)
            grow(2 * node + 2, rows[~low], level + 1)

    grow(0, np.arange(len(x)), 0)
    return out


def test_trees_match_a_plain_booster(spark, tmp_path):
    rows, x, y = labelled(spark)
    counts = (int((y == 0).sum()), int(y.sum()))
    edges = boosting.bin_edges(rows, 16).edges
    nodes = boosting.boost(rows, str(tmp_path / "b"), (1.0, 4.0), counts, 3, 3, 0.5, bins=boosting.Bins(edges)).collect()
    margin, weight = np.zeros(len(x)), np.where(y == 1, 4.0, 1.0)
    for tree in (1, 2, 3):
        p = 1 / (1 + np.exp(-margin))
        expected = plain_tree(x, weight * (p - y), weight * p * (1 - p), 3, edges)
        found = {r["node_id"]: r for r in nodes if r["tree_id"] == tree}
        assert set(found) == set(expected)
        for node, (split, gt, ht) in expected.items():
            r = found[node]
            assert (r["feature"], r["threshold"]) == (split or (-1, None))
            assert r["gradient"] == pytest.approx(gt, abs=1e-6) and r["cover"] == pytest.approx(ht, abs=1e-6)
            if not split:
                assert r["value"] == pytest.approx(-0.5 * gt / (ht + 1), abs=1e-6)
        at = np.zeros(len(x), int)
        for _ in range(3):
            split = [expected[n][0] for n in at]
            at = np.array([n if s is None else 2 * n + 1 + (x[i, s[0]] > s[1]) for i, (n, s) in enumerate(zip(at, split))])
        margin += np.array([-0.5 * expected[n][1] / (expected[n][2] + 1) for n in at])
    model = boosting.Booster.from_nodes(spark.createDataFrame(nodes, boosting.NODE_SCHEMA))
    assert np.allclose(model.margins(x), margin, atol=1e-6)


def test_trees_do_not_depend_on_where_nodes_are_finished(spark, tmp_path):
    rows, _, y = labelled(spark)
    counts = (int((y == 0).sum()), int(y.sum()))

    def grown(name, df, local_rows):
        table = boosting.boost(df, str(tmp_path / name), (1.0, 3.7), counts, 7, 4, 0.3, local_rows=local_rows)
        return sorted(map(tuple, table.collect()), key=repr)

    whole = grown("whole", rows, 10_000)
    assert len(whole) > 50
    assert grown("spread", rows.repartition(5), 60) == whole
    assert grown("levels", rows.repartition(3), 1) == whole


def test_the_driver_gets_few_histograms(features, tmp_path, monkeypatch):
    got, collect = [], boosting.RDD.collect

    def counted(rdd):
        rows = collect(rdd)
        arrays = [h for r in rows for h in ([r] if isinstance(r, np.ndarray) else r[1:] if isinstance(r, tuple) else [])]
        got.append(sum(h.size // h.shape[-2] // h.shape[-1] for h in arrays if isinstance(h, np.ndarray)))
        return rows

    monkeypatch.setattr(boosting.RDD, "collect", counted)
    negatives, positives = quality.class_counts(features)[1::-1]
    boosting.boost(features, str(tmp_path / "few"), (1.0, 8.0), (negatives, positives), 2, 5, 0.1, local_rows=20)
    assert max(got) <= boosting.MOST_COLLECTED


def test_rows_end_where_a_walk_ends():
    rng = np.random.default_rng(5)
    tree = boosting.Tree(6)
    for node in range(63):
        if node == 0 or (tree.feature[(node - 1) // 2] >= 0 and rng.random() < 0.9):
            tree.feature[node], tree.bin[node] = rng.integers(0, 15), rng.integers(0, 255)
    codes = rng.integers(0, 256, (15, 500)).astype(np.uint8)
    for row, got in zip(codes.T, tree.place(codes)):
        at = 0
        while at < 127 and tree.feature[at] >= 0:
            at = 2 * at + 1 + int(row[tree.feature[at]] > tree.bin[at])
        assert at == got


def test_one_class_and_no_rows(spark, tmp_path):
    rows, _, _ = labelled(spark, 50)
    same = boosting.boost(rows.withColumn("label", F.lit(0)), str(tmp_path / "a"), (1.0, 1.0), (50, 0), 2, 3, 0.1)
    assert same.filter("feature >= 0").count() == 0 and same.count() == 3
    none = boosting.boost(rows.limit(0), str(tmp_path / "b"), (1.0, 1.0), (0, 0), 2, 3, 0.1)
    model = boosting.Booster.from_nodes(none)
    assert none.count() == 1 and (model.margins(np.zeros((2, len(C.FEATURE_COLUMNS)))) == 0).all()
    absent = rows.withColumn("amount_usd", F.when(F.col("txn_id") > 5, F.col("amount_usd")))
    assert boosting.with_probability(absent, model).filter("probability = 0.5 AND prediction = 0").count() == 50


def test_a_bounded_sample_weighs_as_much_as_all_rows(spark, tmp_path):
    rows, _, y = labelled(spark, 3000)
    counts = (int(y.sum()), int((y == 0).sum()))
    nodes = boosting.fit_classifier(rows, counts, str(tmp_path / "s"), rounds=1, depth=2, most_rows=1000)
    root = nodes.filter("tree_id = 1 AND node_id = 0").first()
    # A quarter of the weight of all rows, which is twice the negatives, is the Hessian at even odds.
    assert root["cover"] == pytest.approx(counts[1] / 2, rel=0.1)


def test_the_classifier_is_fitted_on_all_rows(spark, tmp_path):
    """More rows of a class than were once drawn of it: every one is stored and has its share in the first Hessian."""
    positives, negatives = 60_000, 2_060_000
    ids = F.col("id").alias("txn_id")
    features = [F.lit(0.0).alias(c) for c in C.FEATURE_COLUMNS]
    rows = spark.range(0, positives + negatives, 1, 4).select(ids, (F.col("id") < positives).cast("int").alias("label"), *features)
    nodes = boosting.fit_classifier(rows, (positives, negatives), str(tmp_path / "s"), rounds=1, depth=2)
    assert nodes.filter("tree_id = 1 AND node_id = 0").first()["cover"] == pytest.approx(negatives / 2, rel=1e-9)
    blocks = spark.read.parquet(str(tmp_path / "s")).agg(F.sum(F.octet_length("label")), F.sum(F.octet_length("codes"))).first()
    assert tuple(blocks) == (positives + negatives, len(C.FEATURE_COLUMNS) * (positives + negatives))


def test_tasks_grow_with_the_rows(spark, tmp_path):
    """No bound on tasks makes them larger with the rows; they are whole waves, and a task holds a part of its rows at a time."""
    for rows in (4_800_000, 180_000_000, 5_000_000_000):
        tasks = boosting.tasks_of(rows, 131_072, 6)
        assert rows / tasks <= 32 * 131_072 and tasks % 6 == 0
    rows, _, _ = labelled(spark)
    boosting.packed_blocks(rows.repartition(12), boosting.bin_edges(rows, 16)).write.parquet(str(tmp_path / "b"))
    parts = boosting.parts_of(spark.read.parquet(str(tmp_path / "b")), 2, 0.0, 60).map(lambda part: len(part.label)).collect()
    assert sum(parts) == 1200 and len(parts) > 4 and max(parts) <= 240


def test_growing_a_tree_moves_no_rows(spark, tmp_path, monkeypatch):
    """Levels need the rows where they are: nothing is dealt anew but histograms, and a task per core reads the rows."""
    rows, _, y = labelled(spark)
    dealt, partition = [], boosting.RDD.partitionBy
    monkeypatch.setattr(boosting.RDD, "partitionBy", lambda rdd, n, *f: dealt.append(f) or partition(rdd, n, *f))
    boosting.boost(rows, str(tmp_path / "b"), (1.0, 3.7), (int((y == 0).sum()), int(y.sum())), 2, 4, 0.3, local_rows=400)
    assert not any(f and f[0](7) == 7 for f in dealt)
    assert boosting.tasks_of(2_400_000, 131_072, 12) == 12 and boosting.tasks_of(131_072, 131_072, 12) == 1
    assert boosting.tasks_of(200_000, 131_072, 60) == 6 and boosting.tasks_of(4_000_000, 131_072, 4) == 8


@pytest.mark.parametrize("depth", [3, 6, 7])
def test_margins_are_those_of_a_walk(spark, depth):
    """By masks of leaves where a tree has a bit for each, else step by step: the same doubles."""
    rng, trees = np.random.default_rng(depth), []
    bins = boosting.Bins(tuple(np.arange(9.0) for _ in C.FEATURE_COLUMNS))
    for _ in range(4):
        trees.append(boosting.Tree(depth))
        trees[-1].value = rng.normal(size=2 ** (depth + 1) - 1)
        for node in range(2**depth - 1):
            if node == 0 or (trees[-1].feature[(node - 1) // 2] >= 0 and rng.random() < 0.95):
                trees[-1].feature[node], trees[-1].bin[node] = rng.integers(0, 15), rng.integers(0, 9)
    nodes = boosting.node_rows(trees, bins, 0.25)
    model = boosting.Booster.from_nodes(spark.createDataFrame(nodes, boosting.NODE_SCHEMA))
    assert [masks is not None for masks in model.masks] == [True, *(depth <= 6 or (t.feature >= 0).sum() < 64 for t in trees)]
    x = rng.integers(-1, 10, (200, len(C.FEATURE_COLUMNS))) + rng.choice([0.0, 0.5], (200, 1))
    table = {row[:2]: row for row in nodes}
    for row, margin in zip(x, model.margins(x)):
        total = 0.0
        for tree in range(5):
            at = table[tree, 0]
            while at[2] >= 0:
                at = table[tree, at[4] if row[at[2]] <= at[3] else at[5]]
            total += at[6]
        assert total == margin


def test_forest_scores_are_those_of_a_walk():
    rng = np.random.default_rng(8)
    data = np.round(rng.normal(size=(400, 5)), 1)
    grown = pd.concat([forest.grow_tree(data[i::3], 8, rng).assign(tree_id=i) for i in range(3)])
    trees = forest.Forest.from_nodes(type("Nodes", (), {"toPandas": lambda self: grown})(), 134)
    total = np.zeros(len(data))
    for i in range(3):
        nodes = grown[grown["tree_id"] == i].set_index("node_id")
        for r, row in enumerate(data):
            at = nodes.loc[0]
            while at["feature"] >= 0:
                at = nodes.loc[at["lower"] if row[int(at["feature"])] <= at["threshold"] else at["upper"]]
            total[r] += at["path"]
    assert (trees.raw_scores(data) == -np.exp2(-total / 3 / forest.expected_path(134))).all()
    records, paths, roots, bits = trees._steps
    inner = np.isfinite(records.view(float)[::2])  # the children of a node lie side by side, so that a step fetches one record
    assert len(paths) == len(grown) and len(np.unique(records.view(np.int64)[1::2][inner] >> bits)) == inner.sum()
