"""Kernels that need the whole matrix of a layer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compensated(weights: DataFrame, moments: DataFrame, layer: str, row: str, values: str, second: str, damping: float = 0.01, rows_per_task: int = 512, group: int = 128) -> DataFrame:
    """Ternary codes of weight rows whose rounding errors are passed on to the weights not yet coded.

    ``moments`` holds, for each layer, the flattened matrix of second moments of its inputs. Its inverse, by Cholesky factors, says
    how the error of one input is best made up for by the later ones. Each ``group`` of neighbouring weights of a row has a scale, the
    mean magnitude of its weights; the last group may be shorter. Rows are independent, so a layer's rows are dealt to tasks, each with the layer's matrix. Returns ``(layer, row, w, q)``.
    """
    n_parts = F.ceil(F.count("*") / rows_per_task).cast("int").alias("parts")
    parts = weights.groupBy(F.col(layer).alias("of_layer")).agg(n_parts)
    dealt = weights.select(F.col(layer).alias("layer"), F.col(row).cast("long").alias("row"), F.col(values).alias("w"))
    dealt = dealt.join(parts, F.col("layer") == F.col("of_layer")).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).drop("of_layer", "parts")
    spread = moments.select(F.col(layer).alias("layer"), F.col(second).alias("h")).join(parts, F.col("layer") == F.col("of_layer"))
    spread = spread.select("layer", "h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(own: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(matrix):
            return pd.DataFrame(columns=["layer", "row", "w", "q"])
        w = np.stack(own["w"].to_numpy()).astype(np.float64)
        n = w.shape[1]
        h = np.asarray(matrix["h"].iloc[0], np.float64).reshape(n, n)
        h = (h + h.T) / 2
        h = h + max(damping * np.trace(h) / n, np.finfo(np.float64).eps) * np.eye(n)
        upper = np.linalg.cholesky(np.linalg.inv(h)).T
        begins = np.arange(0, n, group)
        scales = np.maximum(np.add.reduceat(np.abs(w), begins, axis=1) / np.diff(np.append(begins, n)), 1e-12)
        left, q = w.copy(), np.zeros_like(w)
        for i in range(n):
            scale = scales[:, i // group]
            q[:, i] = np.rint(np.clip(left[:, i] / scale, -1, 1)) * scale
            left[:, i + 1 :] -= np.outer((left[:, i] - q[:, i]) / upper[i, i], upper[i, i + 1 :])
        return pd.DataFrame({"layer": own["layer"], "row": own["row"], "w": list(w), "q": list(q)})

    kind = dict(weights.dtypes)[layer]
    out = dealt.groupBy("layer", "part").cogroup(spread.groupBy("layer", "part")).applyInPandas(run, f"layer {kind}, row long, w array<double>, q array<double>")
    return out.withColumnRenamed("layer", layer).withColumnRenamed("row", row)
