"""[13] Embedding whitening by hierarchical SVD merging.

Every partition folds its rows, centred, into a state: the number of rows, exact sums, all singular values and all
right singular vectors (as many as there are dimensions or rows; none is cut off).  A merge of two states stacks their
scaled vectors, appends one row that corrects for the distance of the two means, and takes the SVD of the stack,
which loses nothing: stack' stack is the scatter of both sets about their common mean.  States are merged in groups
of FAN, level by level, until one is left, so no task and not the driver holds more than FAN + 1 states, each of
dimensions ** 2 doubles.  Principal axes and variances are those of the last state.

Whitened rows are then checked as a whole: their covariance is made by the same kind of tree and held against the
identity.

Odd input: rows whose vector is null, empty or holds null or non-finite entries are left out, as are those with an entry
over 2 ** 56, whose x isn't a long.  Vectors of several lengths: those of the length that most usable vectors have stay (of equally
many, the longest).  Rows whose vec_id is null or repeated are rows like any others.  Equal eigenvalues: any axes of their plane, the same
for all rows.  Components without variance (constant or dependent dimensions, a single row) have null in whitened and 0
in explained, and identity_error is about the others; it is 0 if there is none.  No usable row: no result rows.
A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields, remove, table, tidy, tune, written

#: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: States that are merged in one task, and entries of rows that are worked on at once.
FAN, ENTRIES = 8, 1 << 19
#: Variance below this share of the largest, for each dimension, is rounding.
NOISE = 1e-13
STATE = "dim int, part bigint, n bigint, total array<decimal(38,0)>, scales array<double>, axes binary"


class Model(NamedTuple):
    """n rows with exact sums `total` by dimension, eigenvalues by falling size, and their unit axes as rows."""

    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x of the rows that count."""
    entry = lambda e: F.coalesce((F.abs(e) <= float(1 << 56)) & ~F.isnan(e), F.lit(False))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", entry)
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE) + OFFSET)
    return vectors.select("vec_id", "embedding").where(good).select("vec_id", x.alias("x"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of its rows, and the rows, a bounded number of entries at once."""
    column = batch.column("x")
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    lengths = np.diff(offsets)
    for dim in np.unique(lengths):
        rows, step = np.flatnonzero(lengths == dim), max(1, ENTRIES // int(dim))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, flat[offsets[part][:, None] + np.arange(dim)]


def _sums(x: np.ndarray) -> list[int]:
    """Exact sums by column."""
    if int(np.abs(x).max()) < (1 << 62) // len(x):
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def mean(n: int, total: list[int]) -> np.ndarray:
    """Means of x - OFFSET, rounded once."""
    return np.array([(t - n * OFFSET) / n for t in total])


class State(NamedTuple):
    """rows' rows is the scatter of n rows about their mean."""

    n: int
    total: list[int]
    rows: np.ndarray


def stacked(a: State, b: State) -> np.ndarray:
    """Both states' rows and the correction for their means."""
    apart = (mean(a.n, a.total) - mean(b.n, b.total)) * np.sqrt(a.n / (a.n + b.n) * b.n)
    return np.vstack([a.rows, b.rows, apart])


def merge(a: State, b: State) -> State:
    """One state of both sets of rows, with all its singular values, by an SVD of the stack."""
    _, scales, axes = np.linalg.svd(stacked(a, b), full_matrices=False)
    return State(a.n + b.n, [x + y for x, y in zip(a.total, b.total)], scales[:, None] * axes)


def fold(state: State | None, x: np.ndarray) -> State:
    """The state with some more rows: a triangular factor in place of the rows, which holds the same scatter."""
    new = State(len(x), _sums(x), np.zeros((0, x.shape[1])))
    new = new._replace(rows=(x - OFFSET).astype(np.float64) - mean(new.n, new.total))
    if state is None:
        return new._replace(rows=np.linalg.qr(new.rows, mode="r"))
    return State(state.n + new.n, [a + b for a, b in zip(state.total, new.total)], np.linalg.qr(stacked(state, new), mode="r"))


def _svd(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, scales, axes = np.linalg.svd(rows, full_matrices=False)
    return scales, axes


def _row(dim: int, part: int, state: State) -> dict:
    from decimal import Decimal

    scales, axes = _svd(state.rows)
    return {"dim": dim, "part": part, "n": state.n, "total": [Decimal(t) for t in state.total], "scales": scales.tolist(), "axes": axes.tobytes()}


def _state(row: dict) -> State:
    scales = np.array(row["scales"])
    axes = np.frombuffer(row["axes"]).reshape(len(scales), row["dim"])
    return State(row["n"], [int(t) for t in row["total"]], scales[:, None] * axes)


def _leaf(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    states: dict[int, State] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            states[x.shape[1]] = fold(states.get(x.shape[1]), x)
    part = TaskContext.get().partitionId()
    for dim, state in states.items():
        yield pa.RecordBatch.from_pylist([_row(dim, part, state)], schema=arrow)


def tree(states: DataFrame, schema: str, join: Callable[[list[dict]], dict], name: str) -> DataFrame:
    """One row for each dim of states (dim, part, ...), which join makes of at most FAN rows at a time; level by level, each written."""
    held = written(states, name)
    # Rows of one dim are numbered by their partition, so a level has one FAN-th of them, and at most one row short of FAN more.
    while held.groupBy("dim").count().where("count > 1").limit(1).count():

        def joined(key: tuple, group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["part"])
            return pa.Table.from_pylist([join(rows) | {"dim": rows[0]["dim"], "part": key[1].as_py()}], schema=arrow)

        arrow = fields(schema, held.sparkSession)
        following = written(held.withColumn("lot", F.floor(F.col("part") / FAN)).groupBy("dim", "lot").applyInArrow(lambda key, group: joined(key, group.drop_columns("lot")), schema), name)
        remove(held.sparkSession, held)
        held = following
    return held


def _merged(rows: list[dict]) -> dict:
    state = _state(rows[0])
    for row in rows[1:]:
        state = merge(state, _state(row))
    return _row(rows[0]["dim"], 0, state)


def fit(x: DataFrame) -> Model | None:
    """The model of usable's rows; None without any.  One state, of dimensions ** 2 doubles, comes to the driver."""
    arrow = fields(STATE, x.sparkSession)
    states = tree(x.select("x").mapInArrow(tidy(lambda b: _leaf(b, arrow)), STATE), STATE, _merged, "whitening")
    best = states.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    remove(x.sparkSession, states)
    if not best:
        return None
    row = best[0].asDict()
    scales, dim = np.array(row["scales"]), row["dim"]
    values, axes = np.zeros(dim), np.zeros((dim, dim))
    values[: len(scales)], axes[: len(scales)] = scales**2 / row["n"], np.frombuffer(row["axes"]).reshape(-1, dim)
    return Model(row["n"], [int(t) for t in row["total"]], values, axes)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums of (n * x - total) ** 2 by row; None beyond 64 bits."""
    y, rest = x - OFFSET, [t - n * OFFSET for t in total]
    most = int(np.abs(y).max()) * n + max(map(abs, rest))
    if most * most * x.shape[1] < 1 << 63:
        z = n * y - np.array(rest, np.int64)
        return (z * z).sum(1).tolist()
    about, out = ((y - np.array(rest, np.float64) / n) ** 2).sum(1) * float(n) ** 2, []
    for row, size in zip(y, about.tolist()):
        exact = sum((n * a - b) ** 2 for a, b in zip(row.tolist(), rest)) if size < 1.01 * 2.0**63 else 1 << 63
        out.append(exact if exact < 1 << 63 else None)
    return out


def kept_components(model: Model, most: int = COMPONENTS) -> tuple[int, int]:
    """How many components are given, and how many of these have variance."""
    given = min(most, len(model.values))
    return given, int((model.values[:given] > model.values[0] * NOISE * len(model.values)).sum()) if model.values[0] > 0 else 0


def _projection(model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    _, real = kept_components(model, most)
    return mean(model.n, model.total), model.axes[:real].T / np.sqrt(model.values[:real])


def whiten(x: DataFrame, model: Model, most: int = COMPONENTS) -> DataFrame:
    """vec_id, deviation, and whitened (the components with variance) of usable's rows of the model's length."""
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation bigint, whitened array<double>"
    arrow, dim = fields(schema, x.sparkSession), len(model.total)
    centre, project = _projection(model, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in _matrices(batch):
                if part.shape[1] == dim:
                    white = ((part - OFFSET) - centre) @ project
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                    columns = [batch.column("vec_id").take(pa.array(rows)), pa.array(deviations(part, model.n, model.total), pa.int64()), flat]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return x.mapInArrow(tidy(run), schema)


SPREAD = "dim int, part bigint, n bigint, centre array<double>, scatter binary"


def _spread(white: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """Number of rows and covariance of whitened, centred before multiplying, by the same tree of merges."""
    arrow = fields(SPREAD, white.sparkSession)

    def join(a: tuple, b: tuple) -> tuple:
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])

    def row(part: int, s: tuple) -> dict:
        return {"dim": size, "part": part, "n": s[0], "centre": s[1].tolist(), "scatter": s[2].tobytes()}

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            if batch.num_rows:
                w = np.asarray(batch.column("whitened").flatten()).reshape(-1, size)
                centre = w.mean(0)
                new = (len(w), centre, (w - centre).T @ (w - centre))
                held = new if held is None else join(held, new)
        if held:
            yield pa.RecordBatch.from_pylist([row(TaskContext.get().partitionId(), held)], schema=arrow)

    def merged(rows: list[dict]) -> dict:
        states = [(r["n"], np.array(r["centre"]), np.frombuffer(r["scatter"]).reshape(size, size)) for r in rows]
        held = states[0]
        for s in states[1:]:
            held = join(held, s)
        return row(0, held)

    states = tree(white.select("whitened").mapInArrow(tidy(leaf), SPREAD), SPREAD, merged, "spread")
    last = states.first()
    remove(white.sparkSession, states)
    return last["n"], np.frombuffer(last["scatter"]).reshape(size, size) / last["n"]


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """The contract's rows: one for each usable vector and component."""
    spark = vectors.sparkSession
    tune(spark)
    x = usable(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    model = fit(x)
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    given, real = kept_components(model, most)
    white, error = whiten(x, model, most), 0.0
    if real:
        error = float(np.abs(_spread(white, real)[1] - np.eye(real)).max())
    trace = float(model.values.sum())
    shares = [float(v) / trace if at < real else 0.0 for at, v in enumerate(model.values[:given])]
    rows = white.select("vec_id", "deviation", "whitened", F.explode(F.sequence(F.lit(1), F.lit(given))).alias("component"))
    explained = F.element_at(F.array(*map(F.lit, shares)), F.col("component"))
    return rows.select("vec_id", "component", F.lit(model.n).cast("bigint").alias("n"), "deviation", F.get("whitened", F.col("component") - 1).alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))


def query(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
