"""A small multilayer perceptron with sigmoid units: forward pass and error as expressions, training by online steps in
shares whose copies are averaged, or by gradients summed over all partitions.

Both ways of training read rows of id, inputs and wanted (arrays of doubles). Rows with a null, or with arrays of another
length than the network's, take no part. What comes to the driver is one number for each parameter and epoch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.tables import remove, shared_folder, spread, totals

SIZES = (4, 3, 3, 3, 3)
RATE = 0.03
EPOCHS = 500
SHARE = 1024  # rows of a copy of the network
SIDE = 128  # copies that a task trains side by side
LOCAL = 25  # epochs between two averages

Layers = list[tuple[np.ndarray, np.ndarray]]


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def forward(inputs: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Outputs for an array of inputs; a layer is its weights, a row for each unit, and its biases."""
    out = inputs
    for weights, biases in layers:
        units = F.array(*(F.struct(F.array(*map(F.lit, w)).alias("w"), F.lit(b).alias("b")) for w, b in zip(weights, biases)))
        out = F.transform(F.array(out), lambda x: F.transform(units, lambda u: sigmoid(F.aggregate(F.zip_with(x, u["w"], lambda a, w: a * w), u["b"], lambda s, t: s + t))))[0]
    return out


def squared_error(outputs: Column, wanted: Column) -> Column:
    return F.aggregate(F.zip_with(outputs, wanted, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def usable(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    full = lambda name, n: (F.size(name) == n) & ~F.exists(name, lambda x: x.isNull())
    return rows.select("id", "inputs", "wanted").filter(F.col("id").isNotNull() & full("inputs", sizes[0]) & full("wanted", sizes[-1]))


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def unflat(values: np.ndarray, sizes: tuple[int, ...]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((values[at : at + a * b].reshape(b, a), values[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def online(inputs: np.ndarray, wanted: np.ndarray, sizes: np.ndarray, layers: Layers, rate: float, epochs: int) -> tuple[Layers, np.ndarray]:
    """Copies trained side by side, a sample of each at a time: ``inputs`` is samples x width x copies, the first
    ``sizes[i]`` samples of a copy count. Each layer is updated before its delta goes on to the layer below. Returns
    the copies' layers, copies last, and, for each epoch, the summed squared error."""
    copies = inputs.shape[2]
    w = [np.repeat(a[:, :, None], copies, 2) for a, _ in layers]
    c = [np.repeat(b[:, None], copies, 1) for _, b in layers]
    errors, least = np.zeros(epochs), sizes.min()
    for epoch in range(epochs):
        for i, (x, y) in enumerate(zip(inputs, wanted)):
            acts = [x]
            for a, b in zip(w, c):
                acts.append(1 / (1 + np.exp(-((a * acts[-1]).sum(1) + b))))
            back = acts[-1] - y if i < least else np.where(i < sizes, acts[-1] - y, 0.0)
            errors[epoch] += (back * back).sum()
            for k in range(len(w) - 1, -1, -1):
                delta = back * acts[k + 1] * (1 - acts[k + 1])
                step = rate * delta
                w[k] -= step[:, None] * acts[k]
                c[k] -= step
                if k:
                    back = (w[k] * delta[:, None]).sum(0)
    return list(zip(w, c)), errors


def train(rows: DataFrame, sizes: tuple[int, ...] = SIZES, rate: float = RATE, epochs: int = EPOCHS, seed: int = 0, share: int = SHARE) -> DataFrame:
    """epoch, error: online gradient descent, a sample at a time in the order of ``id`` (ids are unique).

    A table of up to ``share`` rows is one sequence. A larger one is dealt by a hash of the id into shares of about that many
    rows; each trains a copy for ``LOCAL`` epochs, then all go on from the copies' mean by rows. A task holds ``SIDE`` shares,
    however large the table is. The error is that of each copy on its own rows.
    """
    rng = np.random.default_rng(seed)
    layers = [(rng.normal(0, 1, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    count = len(flat(layers))
    rows = usable(rows, sizes)
    n = rows.count()
    shares = max(1, -(-n // share))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)))
    dealt = dealt.withColumn("task", F.floor(F.col("share") / SIDE))

    def one_round(layers: Layers, steps: int):
        def run(data: pd.DataFrame) -> pd.DataFrame:
            parts = [part.sort_values("id") for _, part in data.groupby("share")]
            lengths = np.array([len(part) for part in parts])
            x, y = (np.zeros((lengths.max(), width, len(parts))) for width in (sizes[0], sizes[-1]))
            for i, part in enumerate(parts):
                x[: len(part), :, i], y[: len(part), :, i] = np.stack(part["inputs"]), np.stack(part["wanted"])
            trained, errors = online(x, y, lengths, layers, rate, steps)
            weighted = [(w @ lengths, c @ lengths) for w, c in trained]
            value = np.concatenate([flat(weighted), errors])
            return pd.DataFrame({"k": np.arange(len(value), dtype="int32"), "value": value})

        return run

    errors: list[float] = []
    while n and len(errors) < epochs:
        steps = min(epochs - len(errors), epochs if shares == 1 else LOCAL)
        found = totals(dealt.groupBy("task").applyInPandas(one_round(layers, steps), "k int, value double"), count + steps) / n
        layers = unflat(found[:count], sizes)
        errors += found[count:].tolist()
    return rows.sparkSession.createDataFrame(list(enumerate(errors)), "epoch int, error double")


def gradient(x: np.ndarray, y: np.ndarray, layers: Layers) -> tuple[np.ndarray, float]:
    """Sum over the samples of the gradient of their squared error, flat, and that error."""
    acts = [x]
    for w, c in layers:
        acts.append(1 / (1 + np.exp(-(acts[-1] @ w.T + c))))
    back, out = 2 * (acts[-1] - y), []
    for k in range(len(layers) - 1, -1, -1):
        delta = back * acts[k + 1] * (1 - acts[k + 1])
        out.append((delta.T @ acts[k], delta.sum(0)))
        back = delta @ layers[k][0]
    return flat(out[::-1]), float(((acts[-1] - y) ** 2).sum())


def descend(rows: DataFrame, sizes: tuple[int, ...] = SIZES, rate: float = RATE, epochs: int = EPOCHS, batches: int = 1, seed: int = 0) -> tuple[Layers, list[float]]:
    """Layers and each epoch's error after gradient descent on the mean squared error over samples and outputs.

    A step sums its gradient over all partitions and the parameters travel with the next step's tasks. An epoch takes ``batches``
    steps, over rows dealt by a hash of the id: batches grow with the table, their number and so the number of jobs
    does not. The rows are written once as matrices of one batch each, so a step reads its own. The error is the mean over samples
    of the sum over outputs, measured before each update. A table without usable rows keeps the first layers and has no
    errors.
    """
    rng = np.random.default_rng(seed)
    bound = lambda a, b: np.sqrt(6 / (a + b))
    layers = [(rng.uniform(-bound(a, b), bound(a, b), (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    values, spark = flat(layers), rows.sparkSession
    path = f"{shared_folder(spark, 'mlp')}/mlp-{uuid.uuid4().hex}"

    def matrices(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c, width in (("inputs", sizes[0]), ("wanted", sizes[-1])))
            deal = part.column("deal").to_numpy(zero_copy_only=False)
            for d in np.unique(deal):
                own = deal == d
                yield pa.RecordBatch.from_pydict({"deal": pa.array([int(d)], pa.int32()), "x": [x[own].tobytes()], "y": [y[own].tobytes()]})

    def step(values: np.ndarray):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, own = np.zeros(len(values) + 2), unflat(values, sizes)
            for part in parts:
                for a, b in zip(part.column("x"), part.column("y")):
                    x, y = (np.frombuffer(m.as_buffer()).reshape(-1, width) for m, width in ((a, sizes[0]), (b, sizes[-1])))
                    slope, error = gradient(x, y, own)
                    out += np.append(slope, (error, len(x)))
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(len(out), dtype="int32")), "value": pa.array(out)})

        return run

    errors = []
    try:
        dealt = spread(usable(rows, sizes)).withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
        dealt.select("deal", F.col("inputs").cast("array<double>"), F.col("wanted").cast("array<double>")).mapInArrow(matrices, "deal int, x binary, y binary").write.partitionBy("deal").parquet(path)
        blocks = spark.read.schema("x binary, y binary, deal int").parquet(path)
        for _ in range(epochs):
            error, samples = 0.0, 0.0
            for d in range(batches):
                found = totals(blocks.filter(F.col("deal") == d).select("x", "y").mapInArrow(step(values), "k int, value double"), len(values) + 2)
                error, samples = error + found[-2], samples + found[-1]
                if found[-1]:
                    values = values - rate / (found[-1] * sizes[-1]) * found[:-2]
            if not samples:
                break
            errors.append(float(error / samples))
    finally:
        remove(spark, path)
    return unflat(values, sizes), errors


def classifier(rows: DataFrame, layers: list[int], seed: int = 1):
    """The library's perceptron (softmax outputs and logistic loss, not the model above)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=100).fit(rows)
