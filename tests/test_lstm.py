"""The sequence classifier: gradients against differences, padding, what it learns, and scoring by tasks."""

import numpy as np
import pytest

from lagline.plans import experiment, lstm


def random_batch(rng, rows=5, steps=4, numbers=3, texts=2, levels=6):
    return rng.standard_normal((rows, steps, numbers)), rng.integers(0, levels, (rows, steps, texts)), rng.integers(1, steps + 1, rows)


@pytest.mark.parametrize("norm", [False, True])
def test_gradients_against_differences(norm):
    rng = np.random.default_rng(3)
    net = lstm.Network(3, 2, 6, hidden=5, norm=norm).drawn(rng, np.float64)
    batch, y = random_batch(rng), np.array([1, 0, 0, 1, 0])
    drop = rng.random((5, 5)) * 2
    loss = lambda: lstm.weighted_loss(net.forward(*batch, drop)[0], y, 3.0)[0]
    logit, keep = net.forward(*batch, drop)
    slopes = net.backward(lstm.weighted_loss(logit, y, 3.0)[1], keep)
    assert set(slopes) == set(net.w)
    for name, w in net.w.items():
        flat = w.reshape(-1)
        for k in rng.choice(flat.size, min(12, flat.size), replace=False):
            old = flat[k]
            flat[k] = old + 1e-6
            up = loss()
            flat[k] = old - 1e-6
            down = loss()
            flat[k] = old
            assert slopes[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-6, abs=1e-7), name


def test_padding_changes_nothing():
    rng = np.random.default_rng(0)
    net = lstm.Network(3, 2, 6, hidden=5).drawn(rng, np.float64)
    x, codes, lengths = random_batch(rng)
    more = np.concatenate((x, rng.standard_normal((5, 3, 3))), axis=1), np.concatenate((codes, codes[:, :3]), axis=1), lengths
    assert np.allclose(net.forward(x, codes, lengths)[0], net.forward(*more)[0])


def test_average_precision():
    y, s = np.array([1, 0, 1, 0, 1]), np.array([0.9, 0.8, 0.8, 0.1, 0.1])
    assert lstm.average_precision(y, s) == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert lstm.average_precision(np.array([0, 0]), np.array([0.1, 0.2])) == 0.0


def test_learns_from_history_and_scores_by_tasks(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        n = int(rng.integers(1, 6))
        steps = [(k, float(rng.standard_normal()), 0, int(rng.integers(0, 3))) for k in range(n)]
        y = int(steps[0][1] + (steps[-1][3] == 2) > 1.0)  # the first number and the last code
        rows.append((i, "train" if i % 10 < 7 else "val" if i % 10 < 8 else "test", y, y, steps))
    df = spark.createDataFrame(rows, "rid long, split string, y_true int, y_fit int, history array<struct<rid: long, z_a: double, missing_a: int, code_b: int>>")
    fit = lstm.sequence_model(df.where("split = 'val'"), lstm.Settings(rate=0.01, epochs=25, patience=8), length=5)
    record = experiment.run_seeds(df, (0,), fit)
    got = record["seeds"][0]["scores"]
    assert got["test"]["average_precision"] > 0.85 and got["val"]["average_precision"] > 0.85
    score = fit(df.where("split = 'train'"), 0)
    assert score(df).columns == [*df.columns, "score"] and 1 < len(score.log) <= 25
    a = score(df).orderBy("rid").toPandas()["score"]
    assert np.allclose(a, score(df.repartition(7)).orderBy("rid").toPandas()["score"], atol=1e-5)  # whatever the batches
    with pytest.raises(experiment.ExperimentError):
        lstm.sequence_model(df, most_rows=10, length=5)(df, 0)
    with pytest.raises(experiment.ExperimentError):
        fit(df.where("y_fit = 0"), 0)


def test_presets():
    assert lstm.PRESETS["fixed15"].patience is None and lstm.PRESETS["sqrt_weight_slow"].warm_up
    rng = np.random.default_rng(2)
    net = lstm.Network(3, 2, 6, hidden=5).drawn(rng)
    x, codes, lengths = random_batch(rng, rows=40)
    y = np.arange(40) % 4 == 0
    log = lstm.train(net, (x.astype(np.float32), codes, lengths), y.astype(int), lstm.Settings(epochs=3, patience=None, root_weight=True, warm_up=True), rng)
    assert [e["epoch"] for e in log] == [1, 2, 3] and all(np.isfinite(e["train_loss"]) for e in log)
