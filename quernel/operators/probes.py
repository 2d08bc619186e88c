"""Linear probes over groups of vectors, fitted where the rows lie.

Logistic probes take Newton steps. Tasks sum the loss, gradient and Hessian of their own rows at the present weights,
one block a group; blocks of a group are added up by key, and its step is solved where they meet. The driver keeps each
group's weights and no row, so neither a task nor the driver holds a group. A group costs (width + 1)**2 numbers in a
task, whatever its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.functions import signals as S
from quernel.operators import metrics
from quernel.session import ship, written


def scales(hidden: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """mean and sd (population, 1 where there is none) of each position over all rows of a group, as arrays."""
    at = hidden.select(*keys, F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"), S.safe_sd(F.stddev_pop("x")).alias("s"))
    listed = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("p"))
    return listed.select(*keys, F.transform("p", lambda p: p["m"]).alias("mean"), F.transform("p", lambda p: p["s"]).alias("sd"))


def block(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of the log loss of rows x (their last column 1) at weights w, in one flat array."""
    z = x @ w
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    loss = np.logaddexp(0, z).sum() - z @ y
    return np.concatenate([[loss], x.T @ (p - y), ((x.T * (p * (1 - p))) @ x).ravel()])


def newton_step(summed: np.ndarray, w: np.ndarray, c: float) -> tuple[float, np.ndarray]:
    """(objective w.w / 2 + c x loss without the intercept's square, the step that lowers it)."""
    d = len(w)
    ridge = np.append(np.ones(d - 1), 0)
    gradient, hessian = summed[1 : d + 1], summed[d + 1 :].reshape(d, d)
    return float(c * summed[0] + ridge @ (w * w) / 2), np.linalg.solve(c * hessian + np.diag(ridge + 1e-10), -(c * gradient + ridge * w))


def logistic_weights(rows: DataFrame, groups: set[int], scaled: list[tuple[np.ndarray, np.ndarray]], c: float = 1.0, steps: int = 60, tol: float = 1e-10) -> list[np.ndarray]:
    """Weights (intercept last) of each group's ridge logistic regression on standardized vectors; 0 for others than groups.

    rows: g, label, vec. A step that does not lower the objective is halved."""
    sc = rows.sparkSession.sparkContext
    w = [np.zeros(len(m) + 1) for m, _ in scaled]
    last: list[tuple[float, np.ndarray] | None] = [None] * len(scaled)
    open_ = set(groups)
    scale = sc.broadcast(scaled)
    for _ in range(steps):
        if not open_:
            break
        now = sc.broadcast({g: w[g] for g in open_})

        def partial(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                g, y = np.asarray(b.column("g")), np.asarray(b.column("label")).astype(float)
                values = np.asarray(b.column("vec").flatten()).astype(float)
                ends = np.concatenate([[0], np.cumsum(np.asarray(b.column("vec").value_lengths()))])
                for one in np.unique(g):
                    if int(one) not in now.value:
                        continue
                    at = np.flatnonzero(g == one)
                    mean, sd = scale.value[one]
                    x = np.stack([values[ends[i] : ends[i + 1]] for i in at])
                    got = block(np.hstack([(x - mean) / sd, np.ones((len(at), 1))]), y[at], now.value[int(one)])
                    total[int(one)] = total[int(one)] + got if int(one) in total else got
            yield pa.RecordBatch.from_pydict({"g": list(total), "data": [v.tobytes() for v in total.values()]}, pa.schema([("g", pa.int32()), ("data", pa.binary())]))

        summed = rows.mapInArrow(partial, "g int, data binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1]))).reduceByKey(np.add)
        for g, (value, step) in summed.map(lambda kv, now=now: (kv[0], newton_step(kv[1], now.value[kv[0]], c))).collect():
            before = last[g]
            if before is not None and value > before[0] + 1e-9 * abs(before[0]) and np.abs(w[g] - before[1]).max() > tol:
                w[g] = (w[g] + before[1]) / 2
                continue
            last[g] = (value, w[g])
            w[g] = w[g] + step
            if np.abs(step).max() < tol:
                open_.discard(g)
        now.unpersist()
    return w


def logistic_probe(hidden: DataFrame, keys: list[str], c: float = 1.0) -> DataFrame:
    """Standardized ridge logistic regression for each group, whatever its rows, judged on the rows it isn't fitted to.

    hidden: keys, label, vec and fit (whether the row is fitted to). Positions are scaled over all rows. Gives coef,
    bias, mean, sd and the AUROC over the rows that are not fitted to (over all, if there are none). A group that is
    fitted to one class or to nothing has weights of 0. Groups are few (layers, detectors); rows without vec are left out."""
    spark = hidden.sparkSession
    ship(spark)
    hidden = hidden.where(F.col("vec").isNotNull())
    found = scales(hidden, keys).collect()  # one row a group
    number = spark.createDataFrame([(*(r[k] for k in keys), i) for i, r in enumerate(found)], _schema(hidden, keys, "g int"))
    rows = hidden.where("fit").join(F.broadcast(number), keys)
    rows = written(rows.select("g", F.col("label").cast("int").alias("label"), F.col("vec").cast("array<double>").alias("vec")), "probe-rows")
    both = {r["g"] for r in rows.groupBy("g").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).where("p > 0 and n > 0").collect()}
    scaled = [(np.array(r["mean"]), np.array(r["sd"])) for r in found]
    w = logistic_weights(rows.where(F.col("g").isin(*both)), both, scaled, c)
    made = [(*(r[k] for k in keys), x[:-1].tolist(), float(x[-1]), list(r["mean"]), list(r["sd"])) for r, x in zip(found, w, strict=True)]
    probe = spark.createDataFrame(made, _schema(hidden, keys, "coef array<double>, bias double, mean array<double>, sd array<double>"))
    rest = hidden.groupBy(*keys).agg(F.bool_and("fit").alias("alone"))
    judged = hidden.join(F.broadcast(probe), keys).join(F.broadcast(rest), keys).where(~F.col("fit") | F.col("alone"))
    scored = judged.select(*keys, "label", F.round(S.probe_score(F.col("vec"), F.col("coef"), F.col("bias"), F.col("mean"), F.col("sd")), 9).alias("score"))
    return probe.join(F.broadcast(metrics.auroc(scored, keys)), keys)


def mean_difference_probe(hidden: DataFrame, keys: list[str]) -> DataFrame:
    """coef and bias along the difference of the class means of the rows to fit to, centred between them, and mean and sd
    over all rows, for vectors standardized by these. hidden: keys, label, vec, fit."""
    at = hidden.select(*keys, "label", "fit", F.posexplode("vec").alias("pos", "x"))
    of = lambda k: F.avg(F.when(F.col("fit") & (F.col("label") == k), F.col("x")))
    m = at.groupBy(*keys, "pos").agg(F.avg("x").alias("mean"), S.safe_sd(F.stddev_pop("x")).alias("sd"), of(1).alias("a"), of(0).alias("b"))
    w, c = F.coalesce((F.col("a") - F.col("b")) / F.col("sd"), F.lit(0.0)), F.coalesce(((F.col("a") + F.col("b")) / 2 - F.col("mean")) / F.col("sd"), F.lit(0.0))
    g = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", w.alias("w"), c.alias("c"), "mean", "sd"))).alias("p"))
    part = lambda k: F.transform("p", lambda p: p[k])
    return g.select(*keys, part("w").alias("coef"), (-S.dot(part("w"), part("c"))).alias("bias"), part("mean").alias("mean"), part("sd").alias("sd"))


def _schema(df: DataFrame, keys: list[str], more: str) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), more])
