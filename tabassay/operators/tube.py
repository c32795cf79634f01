"""Regression with the epsilon-insensitive loss, for the kernel machine.

Minimises half the squared coefficients plus C times the sum of max(0, |residual| - epsilon).
The kink is smoothed: the loss is quadratic over a stretch of ``width`` beyond the tube, which
shrinks from the label's deviation to a thousandth of the tube, each stage starting from the
last. One pass over the rows gives the loss, its gradient and its curvature, a number for each
pair of coefficients; a Newton step with a backtracking search drives it, in a fraction of the
passes that a quasi-Newton step needs. Beyond ``MOST_SQUARED`` coefficients the curvature would
be too large to add up, and a limited-memory quasi-Newton step (Nocedal 1980) takes its place.
Only sums by coefficients reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps that shape the next one.
MEMORY = 10
STAGES = 5
ENOUGH = 1e-6

#: Coefficients whose pairs are summed.
MOST_SQUARED = 512

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]
#: Value, gradient, curvature, and the values at parts of the way back.
Curved = Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray, np.ndarray]]
#: The parts of a step that are taken back when it was too long.
BACK = 1.0 - 2.0 ** -np.arange(1, 21)


def smoothed(residuals: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each residual and its derivative."""
    beyond = np.maximum(np.abs(residuals) - epsilon, 0.0)
    near = beyond < width
    loss = np.where(near, beyond**2 / (2 * width), beyond - width / 2)
    return loss, np.sign(residuals) * np.minimum(beyond / width, 1.0)


def quasi_newton(objective: Objective, start: np.ndarray, steps: int) -> np.ndarray:
    """A minimum of a smooth convex function, by its value and gradient."""
    at = start
    value, gradient = objective(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(gradient).max(initial=0.0) <= ENOUGH * max(1.0, abs(value)):
            break
        direction, shares = gradient.copy(), []
        for moved, turned in reversed(moves):
            share = moved @ direction / (moved @ turned)
            direction -= share * turned
            shares.append(share)
        if moves:
            moved, turned = moves[-1]
            direction *= moved @ turned / (turned @ turned)
        else:
            direction /= max(1.0, float(np.linalg.norm(gradient)))
        for (moved, turned), share in zip(moves, reversed(shares), strict=True):
            direction += (share - turned @ direction / (moved @ turned)) * moved
        slope, length = gradient @ direction, 1.0
        while True:
            there = at - length * direction
            next_value, next_gradient = objective(there)
            if next_value <= value - 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        moved, turned = there - at, next_gradient - gradient
        if moved @ turned > 1e-12:
            moves = [*moves, (moved, turned)][-MEMORY:]
        done = value - next_value <= 1e-9 * max(abs(value), 1.0)
        at, value, gradient = there, next_value, next_gradient
        if done:
            break
    return at


def newton(objective: Curved, start: np.ndarray, steps: int) -> np.ndarray:
    """A minimum of a smooth convex function, by its value, gradient and curvature.

    ``objective(at, back)`` also gives the values at ``at + b * back`` for the shares b of
    ``BACK``: a step that is too long is known by one pass, and its best part is taken.
    """
    at = start
    value, gradient, curvature, _ = objective(at, np.zeros_like(at))
    for _ in range(steps):
        if np.abs(gradient).max(initial=0.0) <= ENOUGH * max(1.0, abs(value)):
            break
        # Where no row bends the loss a coefficient has no curvature: a little keeps it solvable.
        least = 1e-10 * max(float(np.trace(curvature)) / len(at), 1e-10)
        direction = np.linalg.solve(curvature + least * np.eye(len(at)), gradient)
        there = at - direction
        found = objective(there, direction)
        shares = np.array([0.0, *BACK])
        values = np.array([found[0], *found[3]])
        if values.argmin():
            there = there + shares[values.argmin()] * direction
            found = objective(there, direction)
        if found[0] < value:
            at, gradient, curvature = there, found[1], found[2]
        done = value - found[0] <= 1e-9 * max(abs(value), 1.0)
        value = min(value, found[0])
        if done:
            break
    return at


def packed(rows: DataFrame) -> DataFrame:
    """The numbers of many rows as the bytes of one block, so that a pass only copies them."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = [batch.column("x").flatten().to_numpy(), batch.column("y").to_numpy()]
                blocks = [pa.array([part.tobytes()], pa.binary()) for part in parts]
                yield pa.RecordBatch.from_arrays(blocks, ["x", "y"])

    return rows.mapInArrow(pack, "x binary, y binary")


def _sums(
    rows: DataFrame, point: np.ndarray, epsilon: float, width: float, back: np.ndarray | None = None
) -> np.ndarray:
    """Of all packed rows, the summed loss and its gradient by coefficients and intercept.

    With a way ``back``, the losses at its parts and the second derivatives by each pair of
    coefficients follow.
    """
    size, squared = len(point), back is not None
    way = BACK if squared else BACK[:0]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        pairs, losses = np.zeros((size, size) if squared else (0, 0)), np.zeros(len(way))
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                y = np.frombuffer(y.as_buffer())
                x = np.frombuffer(x.as_buffer()).reshape(len(y), -1)
                residuals = x @ point[:-1] + point[-1] - y
                loss, slope = smoothed(residuals, epsilon, width)
                total[0] += loss.sum()
                total[1:-1] += slope @ x
                total[-1] += slope.sum()
                if squared:
                    turn = x @ back[:-1] + back[-1]
                    for i, share in enumerate(way if back.any() else ()):
                        losses[i] += smoothed(residuals + share * turn, epsilon, width)[0].sum()
                    beyond = np.abs(residuals) - epsilon
                    bent = x[(beyond > 0) & (beyond < width)]
                    pairs[:-1, :-1] += bent.T @ bent / width
                    pairs[-1, :-1] += bent.sum(axis=0) / width
                    pairs[-1, -1] += len(bent) / width
        if squared:
            pairs[:-1, -1] = pairs[-1, :-1]
        parts = np.concatenate([total, losses, pairs.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(parts)), pa.int32()), pa.array(parts)], ["place", "part"]
        )

    found = rows.mapInArrow(add, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    table = found.toArrow()
    out = np.zeros(size + 1 + len(way) + size * size * squared)
    out[table["place"].to_numpy()] = table["part"].to_numpy()
    return out


class _Common(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    pass


class TubeRegression(Estimator, _Common, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of a linear model under the epsilon-insensitive loss."""

    cost = Param(Params._dummy(), "cost", "weight of the loss, C", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half the tube's width", TypeConverters.toFloat)
    fitIntercept = Param(Params._dummy(), "fitIntercept", "with an intercept", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, **kwargs: Any):
        super().__init__()
        self._setDefault(
            cost=1.0, epsilon=0.1, maxIter=1000, fitIntercept=True, predictionCol="prediction"
        )
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs: Any) -> TubeRegression:
        return self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TubeModel:
        cost, epsilon = self.getOrDefault("cost"), self.getOrDefault("epsilon")
        rows = dataset.select(
            F.col(self.getLabelCol()).cast("double").alias("y"),
            vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
        )
        blocks = packed(rows).persist()
        try:
            first = rows.agg(F.max(F.size("x")), F.avg("y"), F.stddev_pop("y")).first()
            if first[1] is None:
                raise ValueError("there is no training row")
            with_intercept = self.getOrDefault("fitIntercept")
            point = np.zeros(first[0] + 1)
            point[-1] = first[1] if with_intercept else 0.0
            squared = len(point) <= MOST_SQUARED
            least = max(epsilon, 1e-3) * 1e-3
            for width in np.geomspace(max(first[2], least), least, STAGES):

                def objective(
                    at: np.ndarray, back: np.ndarray | None = None, width: float = width
                ) -> tuple:
                    sums = _sums(blocks, at, epsilon, width, back)
                    gradient = cost * sums[1 : len(at) + 1]
                    gradient[:-1] += at[:-1]
                    if not with_intercept:
                        gradient[-1] = 0.0
                    value = cost * sums[0] + 0.5 * at[:-1] @ at[:-1]
                    if back is None:
                        return value, gradient
                    losses, pairs = np.split(sums[len(at) + 1 :], [len(BACK)])
                    there = at[:-1] + BACK[:, None] * back[:-1]
                    values = cost * losses + 0.5 * (there**2).sum(axis=1) if back.any() else losses + np.inf
                    curvature = cost * pairs.reshape(len(at), len(at))
                    curvature[range(len(at) - 1), range(len(at) - 1)] += 1.0
                    if not with_intercept:
                        curvature[-1], curvature[:, -1] = 0.0, 0.0
                        curvature[-1, -1] = 1.0
                    return value, gradient, curvature, values

                steps = -(-self.getOrDefault("maxIter") // STAGES)
                point = (newton if squared else quasi_newton)(objective, point, steps)
        finally:
            blocks.unpersist()
        return TubeModel(
            featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
            predictionCol=self.getPredictionCol(), weights=point.tolist(),
        )


class TubeModel(Model, _Common, DefaultParamsReadable, DefaultParamsWritable):
    """A linear model: coefficients, and the intercept last."""

    weights = Param(Params._dummy(), "weights", "coefficients and intercept", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, **kwargs: Any):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.getOrDefault("weights")[:-1])

    @property
    def intercept(self) -> float:
        return self.getOrDefault("weights")[-1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        *weights, intercept = self.getOrDefault("weights")
        listed = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
        products = F.zip_with(
            vector_to_array(F.col(self.getFeaturesCol())), listed, lambda x, w: x * w
        )
        predicted = F.aggregate(products, F.lit(float(intercept)), lambda a, x: a + x)
        return dataset.withColumn(self.getPredictionCol(), predicted)
