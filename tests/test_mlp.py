"""Training over partitions against plain numpy on the whole table."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import mlp as M


def table(spark, n=300, seed=3, width=4, outputs=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    label = x[:, :outputs].argmax(1)
    y = np.eye(outputs)[label]
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, inputs array<double>, wanted array<double>")


def layers_of(sizes, seed=0):
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-np.sqrt(6 / (a + b)), np.sqrt(6 / (a + b)), (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def loss(layers, x, y):
    for w, c in layers:
        x = 1 / (1 + np.exp(-(x @ w.T + c)))
    return ((x - y) ** 2).sum()


def test_gradient_is_the_slope_of_the_error():
    rng = np.random.default_rng(1)
    x, y, sizes = rng.normal(size=(7, 4)), rng.random((7, 3)), (4, 5, 3)
    layers = layers_of(sizes)
    values = M.flat(layers)
    slope, error = M.gradient(x, y, layers)
    assert abs(error - loss(layers, x, y)) < 1e-12
    for k in range(len(values)):
        step = np.eye(len(values))[k] * 1e-6
        rise = (loss(M.unflat(values + step, sizes), x, y) - loss(M.unflat(values - step, sizes), x, y)) / 2e-6
        assert abs(rise - slope[k]) < 1e-6


def test_descend_is_full_batch_descent(spark):
    sizes = (4, 3, 3)
    x, y, rows = table(spark)
    found, errors = M.descend(rows.repartition(7), sizes, rate=0.5, epochs=6)
    values = M.flat(layers_of(sizes))
    wanted = []
    for _ in range(6):
        slope = np.zeros_like(values)
        own = M.unflat(values, sizes)
        wanted.append(loss(own, x, y) / len(x))
        # the chain rule, a sample at a time
        for a, b in zip(x, y):
            h = 1 / (1 + np.exp(-(own[0][0] @ a + own[0][1])))
            o = 1 / (1 + np.exp(-(own[1][0] @ h + own[1][1])))
            d2 = 2 * (o - b) * o * (1 - o)
            d1 = (own[1][0].T @ d2) * h * (1 - h)
            slope += np.concatenate([np.outer(d1, a).ravel(), d1, np.outer(d2, h).ravel(), d2])
        values = values - 0.5 * slope / (len(x) * 3)
    assert np.abs(M.flat(found) - values).max() < 1e-9
    assert np.abs(np.array(errors) - wanted).max() < 1e-9


def test_descend_by_batches_takes_every_row_once_an_epoch(spark):
    x, y, rows = table(spark)
    deals = {r["id"]: r["d"] for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("d")).collect()}
    sizes, values, wanted = (4, 3, 3), M.flat(layers_of((4, 3, 3))), []
    for _ in range(3):
        total = 0.0
        for d in range(3):
            own = [i for i in range(len(x)) if deals[i] == d]
            slope, error = M.gradient(x[own], y[own], M.unflat(values, sizes))
            total += error
            values = values - 0.5 / (len(own) * 3) * slope
        wanted.append(total / len(x))
    found, errors = M.descend(rows.repartition(5), sizes, rate=0.5, epochs=3, batches=3)
    assert np.abs(M.flat(found) - values).max() < 1e-9 and np.abs(np.array(errors) - wanted).max() < 1e-9


def test_rows_that_take_no_part_and_empty_tables(spark):
    _, _, rows = table(spark, 40)
    odd = spark.createDataFrame([(100, None, [1.0, 0.0, 0.0]), (101, [1.0, None, 0.0, 0.0], [1.0, 0.0, 0.0]), (102, [1.0], [1.0, 0.0, 0.0]), (103, [1.0, 1.0, 0.0, 0.0], None), (None, [1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0])], rows.schema)
    plain, errors = M.descend(rows, (4, 3), epochs=2)
    mixed, same = M.descend(rows.unionAll(odd), (4, 3), epochs=2)
    assert np.allclose(M.flat(plain), M.flat(mixed), atol=1e-12) and np.allclose(errors, same, atol=1e-12)
    assert M.descend(rows.limit(0), (4, 3), epochs=2)[1] == []
    assert M.train(rows.limit(0), (4, 3), epochs=2).collect() == []
    a, b = (M.train(df, (4, 3), epochs=3).collect() for df in (rows, rows.unionAll(odd)))
    assert np.allclose([r["error"] for r in a], [r["error"] for r in b], atol=1e-12)


def by_hand(x, y, layers, rate, epochs):
    """Online steps, a sample at a time, each layer updated before its delta goes down."""
    layers, errors = [(w.copy(), c.copy()) for w, c in layers], []
    for _ in range(epochs):
        total = 0.0
        for a, b in zip(x, y):
            acts = [a]
            for w, c in layers:
                acts.append(1 / (1 + np.exp(-(w @ acts[-1] + c))))
            total += ((acts[-1] - b) ** 2).sum()
            back = acts[-1] - b
            for (w, c), low, high in list(zip(layers, acts, acts[1:]))[::-1]:
                delta = back * high * (1 - high)
                w -= rate * np.outer(delta, low)
                c -= rate * delta
                back = w.T @ delta
        errors.append(total)
    return layers, np.array(errors)


def test_online_training_is_one_sequence_or_averaged_shares(spark):
    sizes = (4, 3, 3)
    x, y, rows = table(spark, 120)
    rng = np.random.default_rng(0)
    first = [(rng.normal(0, 1, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    _, wanted = by_hand(x, y, first, 0.03, 8)
    found = [r["error"] for r in M.train(rows.repartition(5), sizes, epochs=8).orderBy("epoch").collect()]
    assert np.abs(np.array(found) - wanted / len(x)).max() < 1e-9

    shares = -(-120 // 30)
    deals = {r["id"]: r["d"] for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(shares)).alias("d")).collect()}
    layers, wanted = first, []
    for steps in (M.LOCAL, 5):
        copies = [(len(own), *by_hand(x[own], y[own], layers, 0.03, steps)) for own in ([i for i in range(120) if deals[i] == d] for d in range(shares))]
        values = sum(n * M.flat(own) for n, own, _ in copies) / 120
        wanted += (sum(e for _, _, e in copies) / 120).tolist()
        layers = M.unflat(values, sizes)
    found = [r["error"] for r in M.train(rows.repartition(5), sizes, epochs=M.LOCAL + 5, share=30).orderBy("epoch").collect()]
    assert np.abs(np.array(found) - wanted).max() < 1e-9
