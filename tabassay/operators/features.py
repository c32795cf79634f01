"""A fitted feature matrix as SQL expressions, so that it is saved with the model.

Imputation values, category levels and scaling are fitted on the training rows and
written into one ``SQLTransformer`` statement. Scoring therefore repeats exactly what
training did, one record at a time or in bulk, without Python code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.functions.families import columns_of
from tabassay.functions.missing import quoted
from tabassay.operators.cleaning import MAX_LEVELS, UNKNOWN, sanitize, scaling_stats
from tabassay.operators.cleaning import numeric_means
from tabassay.operators.frames import aggregate
from tabassay.operators.profile import top_values, value_counts

# Internal columns carry a prefix no table is expected to use, so that a feature may be
# called "label" or "features".
PREFIX = "__feat_"
VECTOR = "__features"
KERNEL_VECTOR = "__kernel_features"
LABEL = "__label"
FOLD = "__fold"
RESERVED = ("prediction", "probability", "rawPrediction", "predicted_class")


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(value: float) -> str:
    return f"({value!r}D)" if math.isfinite(value) else "CAST(NULL AS DOUBLE)"


@dataclass
class FeaturePlan:
    """Encoded feature names, the SQL that computes each, and the raw inputs they need."""

    names: list[str] = field(default_factory=list)
    expressions: list[str] = field(default_factory=list)
    inputs: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [PREFIX + n for n in self.names]

    def stages(self) -> list[Transformer]:
        made = ", ".join(f"{e} AS {_name(c)}" for e, c in zip(self.expressions, self.columns))
        return [
            SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__"),
            VectorAssembler(inputCols=self.columns, outputCol=VECTOR),
        ]

    def encode(self, df: DataFrame) -> DataFrame:
        """The encoded columns alone, under their feature names."""
        return df.select(*[F.expr(e).alias(n) for e, n in zip(self.expressions, self.names)])


def numbered(names: Sequence[str]) -> list[str]:
    """The names, repeated ones with ``_2``, ``_3``.. at the end."""
    out: list[str] = []
    taken = set(names)
    for name in names:
        made, k = name, 1
        while made in out or (k > 1 and made in taken):
            k += 1
            made = f"{name}_{k}"
        out.append(made)
    return out


def _category_levels(
    df: DataFrame, columns: Sequence[str], limit: int
) -> dict[str, tuple[str, list[str]]]:
    """Mode and sorted levels per string column, from one value count."""
    rows: dict[str, list[tuple[int, str]]] = {c: [] for c in columns}
    if columns:
        for r in top_values(value_counts(df, columns), limit + 1).collect():
            rows[r["column_name"]].append((r["cnt"], r["value"]))
    out = {}
    for c, found in rows.items():
        if len(found) > limit:
            raise ValueError(f"column '{c}' has more than {limit} distinct values")
        mode = min(found, key=lambda x: (-x[0], x[1]))[1] if found else UNKNOWN
        out[c] = (mode, sorted(v for _, v in found) or [UNKNOWN])
    return out


def fit_features(
    train: DataFrame,
    columns: Sequence[str] | None = None,
    scaling: str | None = None,
    max_levels: int = MAX_LEVELS,
) -> FeaturePlan:
    """Mean and mode imputation, first-level-dropped one-hot encoding, optional scaling.

    Numbers and booleans come first, in table order, then the levels of the strings. A
    value never seen in training gives zeros.
    """
    data = train if columns is None else train.select(*[quoted(c) for c in columns])
    numbers, texts = columns_of(data, "numeric"), columns_of(data, "string")
    flags = columns_of(data, "boolean")
    means = numeric_means(data, numbers)
    true_share = aggregate(
        data, [F.avg(quoted(c).cast("double")).alias(str(i)) for i, c in enumerate(flags)]
    )
    categories = _category_levels(data, texts, max_levels)

    plan = FeaturePlan()
    for c in data.columns:
        q = _name(c)
        if c in numbers:
            value = f"nanvl(CAST({q} AS DOUBLE), CAST(NULL AS DOUBLE))"
            mean = means[c] if means[c] is not None else 0.0
            plan.names.append(sanitize(c))
            plan.expressions.append(f"coalesce({value}, {_number(mean)})")
            plan.inputs[c] = "double"
        elif c in flags:
            fill = "true" if (true_share[str(flags.index(c))] or 0.0) > 0.5 else "false"
            plan.names.append(sanitize(c))
            plan.expressions.append(f"CAST(coalesce({q}, {fill}) AS DOUBLE)")
            plan.inputs[c] = "boolean"
    for c in texts:
        mode, known = categories[c]
        plan.inputs[c] = "string"
        for level in known[1:]:
            plan.names.append(sanitize(f"{c}_{level}"))
            plan.expressions.append(
                f"CASE WHEN coalesce({_name(c)}, {_text(mode)}) = {_text(level)} "
                "THEN 1.0D ELSE 0.0D END"
            )
    plan.names = numbered(plan.names)
    if not plan.names:
        raise ValueError("no usable feature is left")
    if scaling is not None:
        stats = scaling_stats(plan.encode(data), plan.names, scaling)
        plan.expressions = [
            f"(({e}) - {_number(stats[n][0])}) / {_number(stats[n][1])}"
            for n, e in zip(plan.names, plan.expressions)
        ]
    return plan


def polynomial(df: DataFrame, columns: Sequence[str], degree: int) -> DataFrame:
    """Add ``poly_1..`` holding all products of the columns up to ``degree``."""
    made = VectorAssembler(inputCols=list(columns), outputCol="__base").transform(df)
    expand = PolynomialExpansion(degree=degree, inputCol="__base", outputCol="__poly")
    values = vector_to_array(F.col("__poly"))
    count = math.comb(len(columns) + degree, degree) - 1
    added = [values[i].alias(f"poly_{i + 1}") for i in range(count)]
    return expand.transform(made).select(*[quoted(c) for c in df.columns], *added)


def fill_absent_inputs(df: DataFrame, inputs: dict[str, str]) -> DataFrame:
    """Add inputs a scoring table lacks: 0, false, or a string that is no level."""
    blank = {"double": F.lit(0.0), "boolean": F.lit(False), "string": F.lit("")}
    absent = {c: blank[k] for c, k in inputs.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def kernel_stages(
    plan: FeaturePlan, encoded: DataFrame, width: int, seed: int = 42
) -> list[Transformer]:
    """Random Fourier features of the RBF kernel with gamma 1 / (d * variance).

    The projection is drawn once and written into the statement, so it is saved and
    distributed like any other expression (Rahimi and Recht 2007).
    """
    exprs = []
    for i, n in enumerate(plan.names):
        exprs += [F.avg(quoted(n)).alias(f"m_{i}"), F.avg(quoted(n) ** 2).alias(f"q_{i}")]
    row = aggregate(encoded, exprs)
    d = len(plan.names)
    mean = sum(row[f"m_{i}"] for i in range(d)) / d
    variance = sum(row[f"q_{i}"] for i in range(d)) / d - mean**2
    gamma = 1.0 / (d * variance) if variance > 0 else 1.0
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 * gamma), (width, d))
    shifts = rng.uniform(0.0, 2.0 * math.pi, width)
    norm = math.sqrt(2.0 / width)
    made = []
    for k in range(width):
        dot = " + ".join(
            f"{_number(float(w))} * {_name(c)}" for w, c in zip(weights[k], plan.columns)
        )
        made.append(f"{_number(norm)} * cos({dot} + {_number(float(shifts[k]))}) AS `__kernel_{k}`")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(made)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"__kernel_{k}" for k in range(width)], outputCol=KERNEL_VECTOR),
    ]
