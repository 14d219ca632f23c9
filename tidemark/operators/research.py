"""Walk-forward research: purged folds, logistic fits, scores, greedy long/flat backtests and their roll-up.

Folds are arithmetic on an observation's place in its series, so rows find their folds by a generated sequence and no
range join. Every (config, fold) is a group of its own, and all of them fit and score in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import values as V
from tidemark.operators.features import BACK, FEATURES
from tidemark.operators.scans import compounded
from tidemark.sources.tables import stored

#: Rows of one fit that a task takes; larger fits are summed by Spark, epoch by epoch.
TASK_ROWS = 1_000_000
LEAST_VARIANCE = 1e-18
#: Values of the order that a task of a greedy run takes.
CHUNK = 4096
MODEL = "config int, fold int, n long, means array<double>, scales array<double>, weights array<double>, intercept double"


@dataclass(frozen=True)
class Folds:
    train: int = 5000
    test: int = 500
    step: int = 500
    horizon: int = 12
    embargo: int = 1
    expanding: bool = True

    @property
    def gap(self) -> int:
        return self.horizon + self.embargo

    @property
    def first_test(self) -> int:
        return self.train + self.gap

    def count(self, rows: int) -> int:
        """How many folds so many observations give; test slices never overlap, so a step is a test slice."""
        if self.step != self.test or min(self.train, self.test, self.horizon) < 1 or self.embargo < 0:
            raise ValueError("folds are not valid")
        n = (rows - self.test - self.first_test) // self.step + 1
        if n < 1:
            raise ValueError("too few rows for one fold")
        return n


@dataclass(frozen=True)
class Config:
    learning_rate: float
    epochs: int
    l2: float
    buy_from: float
    sell_to: float


#: The three candidates that are always trained together.
CANDIDATES = (Config(0.05, 60, 0.001, 0.52, 0.40), Config(0.05, 80, 0.01, 0.56, 0.40), Config(0.03, 100, 0.05, 0.60, 0.38))


def plan(spark: SparkSession, rows: int, spec: Folds) -> DataFrame:
    """fold, train_start, train_stop, test_start, test_stop: half-open ranges of places."""
    start = F.col("id") * spec.step + spec.first_test
    stop = start - spec.gap
    return spark.range(spec.count(rows)).select(F.col("id").cast("int").alias("fold"), (F.lit(0) if spec.expanding else stop - spec.train).cast("long").alias("train_start"), stop.alias("train_stop"), start.alias("test_start"), (start + spec.test).alias("test_stop"))


def members(obs: DataFrame, rows: int, spec: Folds) -> DataFrame:
    """obs once for each fold whose training or test slice holds it: columns place, fold, part ('train' or 'test')."""
    n = spec.count(rows)
    place = F.col("idx") - BACK
    steps = lambda x: F.floor(x / spec.step).cast("int")
    # the first fold whose training stops behind this place, and the last whose training has begun
    low = F.greatest(F.lit(0), steps(place - spec.train) + 1)
    high = F.lit(n - 1) if spec.expanding else F.least(F.lit(n - 1), steps(place))
    train = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    tested = F.floor((place - spec.first_test) / spec.step).cast("int")
    test = F.when((place >= spec.first_test) & (tested < n), F.array(tested)).otherwise(F.array().cast("array<int>"))
    tagged = lambda folds, part: F.transform(folds, lambda k: F.struct(k.alias("fold"), F.lit(part).alias("part")))
    return obs.withColumn("place", place).withColumn("__m", F.explode(F.concat(tagged(train, "train"), tagged(test, "test")))).withColumn("fold", F.col("__m.fold")).withColumn("part", F.col("__m.part")).drop("__m")


def scaler(rows: DataFrame, by: Sequence[str], columns: Sequence[str] = FEATURES) -> DataFrame:
    """Mean and scale of every column for each group; a column that hardly varies has scale 1."""
    aggregates = [a for c in columns for a in (F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}"))]
    found = rows.groupBy(*by).agg(*aggregates)
    return found.select(*by, *[x for c in columns for x in (F.col(f"mean_{c}"), F.when(F.col(f"var_{c}") > LEAST_VARIANCE, F.sqrt(f"var_{c}")).otherwise(1.0).alias(f"scale_{c}"))])


def descend(x: np.ndarray, y: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(means, scales, weights, intercept): so many epochs of full-batch steps from zero, a ridge on the weights alone."""
    means, variance = x.mean(axis=0), x.var(axis=0)
    scales = np.sqrt(np.where(variance > LEAST_VARIANCE, variance, 1.0))
    z, w, b = (x - means) / scales, np.zeros(x.shape[1]), 0.0
    for _ in range(config.epochs):
        error = 1 / (1 + np.exp(-np.clip(z @ w + b, -700, 700))) - y
        b -= config.learning_rate * error.mean()
        w = w - config.learning_rate * (z.T @ error / len(y) + config.l2 * w)
    return means, scales, w, float(b)


def fit(rows: DataFrame, configs: Sequence[Config] = CANDIDATES, columns: Sequence[str] = FEATURES, task_rows: int = TASK_ROWS) -> DataFrame:
    """A model for each config and each fold of rows (fold, label, columns); see MODEL for what comes back.

    Folds of up to task_rows rows are fitted in one task each. If any fold is larger, Spark sums gradients over all
    tasks instead, an epoch a job; the driver then holds weights only.
    """
    largest = rows.groupBy("fold").count().agg(F.max("count")).first()[0] or 0
    if largest > task_rows:
        return fit_distributed(rows, configs, columns)
    columns = list(columns)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        config, fold = int(key[0]), int(key[1])
        ordered = part.sort_values("idx", kind="stable")
        means, scales, w, b = descend(ordered[columns].to_numpy(float), ordered["label"].to_numpy(float), configs[config])
        return pd.DataFrame({"config": [config], "fold": [fold], "n": [len(part)], "means": [means.tolist()], "scales": [scales.tolist()], "weights": [w.tolist()], "intercept": [b]})

    each = F.explode(F.array(*[F.lit(k) for k in range(len(configs))]))
    return rows.select("fold", "idx", "label", *columns).withColumn("config", each).groupBy("config", "fold").applyInPandas(run, MODEL)


def fit_distributed(rows: DataFrame, configs: Sequence[Config], columns: Sequence[str] = FEATURES) -> DataFrame:
    """The same fits with gradients summed by Spark: a row's part of a gradient is a column expression."""
    spark = rows.sparkSession
    stats = {r.fold: r for r in scaler(rows, ["fold"], columns).collect()}
    counts = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}
    means, scales = ({k: np.array([r[f"{p}_{c}"] for c in columns]) for k, r in stats.items()} for p in ("mean", "scale"))
    z = F.array(*[(F.col(c) - F.element_at(F.col("__mean"), i + 1)) / F.element_at(F.col("__scale"), i + 1) for i, c in enumerate(columns)])
    fixed = spark.createDataFrame([(k, means[k].tolist(), scales[k].tolist()) for k in stats], "fold int, __mean array<double>, __scale array<double>")
    scaled = rows.join(F.broadcast(fixed), "fold").select("fold", "label", z.alias("z"))
    models = {(c, k): (np.zeros(len(columns)), 0.0) for c in range(len(configs)) for k in stats}
    for epoch in range(max(c.epochs for c in configs)):
        live = [(c, k, w.tolist(), b) for (c, k), (w, b) in models.items() if epoch < configs[c].epochs]
        now = spark.createDataFrame(live, "config int, fold int, w array<double>, b double")
        linear = F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t) + F.col("b")
        error = scaled.join(F.broadcast(now), "fold").select("config", "fold", "z", (V.sigmoid(linear) - F.col("label")).alias("e"))
        sums = error.groupBy("config", "fold").agg(F.sum("e").alias("e"), *[F.sum(F.col("e") * F.element_at("z", i + 1)).alias(f"g{i}") for i in range(len(columns))]).collect()
        for r in sums:
            (w, b), c, n = models[r.config, r.fold], configs[r.config], counts[r.fold]
            gradient = np.array([r[f"g{i}"] for i in range(len(columns))]) / n + c.l2 * w
            models[r.config, r.fold] = w - c.learning_rate * gradient, b - c.learning_rate * r.e / n
    return spark.createDataFrame([(c, k, counts[k], means[k].tolist(), scales[k].tolist(), w.tolist(), float(b)) for (c, k), (w, b) in models.items()], MODEL)


def linear_score(columns: Sequence[str], means: Column, scales: Column, weights: Column, intercept: Column) -> Column:
    """Score of a model whose parameters are array columns beside the features."""
    total = intercept
    for i, c in enumerate(columns):
        total = total + (F.col(c) - F.get(means, F.lit(i))) / F.get(scales, F.lit(i)) * F.get(weights, F.lit(i))
    return V.sigmoid(total)


def score_folds(tests: DataFrame, models: DataFrame, configs: Sequence[Config] = CANDIDATES, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Test rows with each config's score and action; models (configs times folds rows) are broadcast if they are few."""
    models = stored(models, "models")  # counted here and read by the join: fitted once
    if models.count() > 100_000:
        joined = tests.join(models, "fold")
    else:
        joined = tests.join(F.broadcast(models), "fold")
    score = linear_score(columns, F.col("means"), F.col("scales"), F.col("weights"), F.col("intercept"))
    thresholds = F.array(*[F.struct(F.lit(c.buy_from).alias("buy"), F.lit(c.sell_to).alias("sell")) for c in configs])
    of = F.get(thresholds, F.col("config"))
    return joined.select("config", "fold", "place", "label", "forward_return", score.alias("score")).withColumn("action", V.action(F.col("score"), of["buy"], of["sell"]))


def visited(scored: DataFrame, by: Sequence[str], hold: int, order: str = "place", tail: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Rows that a greedy long/flat run looks at: by, order, entered. After a buy it skips `hold` rows.

    The last `tail` rows of a slice (hold, if not given) are not looked at: a position could not end within it. order is a
    whole number, unique in a slice. A slice is cut into chunks of `chunk` values of order. What a chunk does depends only on how many rows
    the chunk before it still skips, fewer than hold; so every chunk says for each such number what it passes on, these maps
    (one short row a chunk) are put together in order, and then each chunk marks its own rows. No task sees a slice.
    """
    left_out, slots = hold if tail is None else tail, max(hold, 1)
    narrow = scored.select(*by, order, (F.col("action") == "buy").alias("__buy"), F.floor(F.col(order) / chunk).alias("__chunk"))
    rows = stored(narrow, "actions")  # read three times: for sizes, maps and marks
    later = Window.partitionBy(*by).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "__chunk").agg(F.count("*").alias("__rows"))
    sizes = sizes.select(*by, "__chunk", F.greatest(F.lit(left_out) - F.coalesce(F.sum("__rows").over(later), F.lit(0)), F.lit(0)).alias("__out"))
    keyed = rows.join(sizes, [*by, "__chunk"])
    typed = {f.name: f.dataType.simpleString() for f in keyed.schema}
    head = ", ".join(f"{c} {typed[c]}" for c in by)

    def buys_of(part: pd.DataFrame) -> tuple[np.ndarray, int]:
        n = max(0, len(part) - int(part["__out"].iloc[0]))
        return np.flatnonzero(part["__buy"].to_numpy(bool)[:n]), n

    def passed_on(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        buys, _ = buys_of(part)
        rest = np.zeros(len(buys) + 1, np.int64)  # what is left to skip if this buy is the next one taken
        following = np.searchsorted(buys, buys + hold)
        for k in range(len(buys) - 1, -1, -1):
            rest[k] = rest[following[k]] if following[k] < len(buys) else max(0, buys[k] + hold - len(part))
        first = np.searchsorted(buys, np.arange(slots))
        out = np.where(first < len(buys), rest[first], np.maximum(np.arange(slots) - len(part), 0))
        return part.iloc[:1][[*by, "__chunk"]].assign(__map=[out.tolist()])

    def composed(maps: pd.DataFrame) -> pd.DataFrame:
        maps = maps.sort_values("__chunk", kind="stable")
        skip, now = [], 0
        for one in maps["__map"]:
            skip.append(now)
            now = int(one[now])
        return maps[[*by, "__chunk"]].assign(__skip=skip)

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        buys, n = buys_of(part)
        at = int(part["__skip"].iloc[0])
        seen, entered = np.arange(n) >= at, np.zeros(n, bool)
        while (k := np.searchsorted(buys, at)) < len(buys):
            entered[buys[k]] = True
            seen[buys[k] + 1 : buys[k] + hold] = False
            at = buys[k] + hold
        return part.iloc[:n].assign(entered=entered)[seen][[*by, order, "entered"]]

    maps = keyed.groupBy(*by, "__chunk").applyInPandas(passed_on, f"{head}, __chunk long, __map array<long>")
    skips = maps.groupBy(*by).applyInPandas(composed, f"{head}, __chunk long, __skip long")
    return keyed.join(skips, [*by, "__chunk"]).groupBy(*by, "__chunk").applyInPandas(marked, f"{head}, {order} {typed[order]}, entered boolean")


def trades(scored: DataFrame, by: Sequence[str], hold: int, cost_bps: float, order: str = "place") -> DataFrame:
    """Looked-at rows of scored with entered, correct (the label was foreseen) and net return where a position was entered."""
    looked = scored.join(visited(scored, by, hold, order), [*by, order])
    return looked.withColumn("correct", (F.col("entered").cast("int") == F.col("label")).cast("int")).withColumn("net", F.when(F.col("entered"), F.col("forward_return") - cost_bps / V.BPS))


def equity(rows: DataFrame, by: Sequence[str], order: Sequence[str], change: str = "net") -> DataFrame:
    """rows with equity, peak (never below 1) and drawdown after each of them, compounding `change` in order (unique within by)."""
    run = compounded(rows, by, order, V.growth(F.col(change)))
    return run.withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(1.0))


def performance(rows: DataFrame, by: Sequence[str], order: Sequence[str], change: str = "net") -> DataFrame:
    """count, net return and largest drawdown of rows compounded in order."""
    last = F.max_by("equity", F.struct(*order))
    return equity(rows, by, order, change).groupBy(*by).agg(F.count("*").alias("trades"), (last - 1).alias("net_return"), F.max("drawdown").alias("max_drawdown"))


def fold_metrics(traded: DataFrame, by: Sequence[str], order: str = "place") -> DataFrame:
    """One row a fold: evaluated rows, accuracy, trades, gross and net return, largest drawdown."""
    base = traded.groupBy(*by).agg(F.count("*").alias("evaluated"), F.avg("correct").alias("accuracy"), F.count_if("entered").alias("trades"))
    entered = traded.filter("entered")
    net = performance(entered, by, [order]).drop("trades")
    gross = performance(entered, by, [order], "forward_return").select(*by, F.col("net_return").alias("gross_return"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return base.join(net, by, "left").join(gross, by, "left").select(*by, "evaluated", "accuracy", "trades", zero("gross_return"), zero("net_return"), zero("max_drawdown"))


def roll_up(metrics: DataFrame, by: Sequence[str], test_rows: int, order: str = "fold") -> DataFrame:
    """One row a report: folds compounded in order, accuracy weighted by the rows that were looked at.

    Its drawdown is the largest of any fold and of the run over folds; its worst fold has the least net return.
    """
    across = performance(metrics, by, [order], "net_return").select(*by, F.col("net_return").alias("aggregate_net_return"), F.col("max_drawdown").alias("across"))
    summed = metrics.groupBy(*by).agg(
        F.count("*").alias("folds"), (F.count("*") * test_rows).alias("oos_rows"), F.sum("trades").alias("trades"),
        (F.sum(F.col("accuracy") * F.col("evaluated")) / F.sum("evaluated")).alias("aggregate_accuracy"), F.min("net_return").alias("worst_fold_net_return"), F.max("max_drawdown").alias("within"),
    )
    return summed.join(across, by).withColumn("max_drawdown", F.greatest("within", "across")).drop("within", "across")


def report_faults(metrics: DataFrame, report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Reports whose totals are not those of their folds; there must be none."""
    own = metrics.groupBy(*by).agg(F.sum("trades").alias("__trades"), F.count("*").alias("__folds"))
    return report.join(own, by, "left").filter(~(F.col("trades").eqNullSafe(F.col("__trades")) & F.col("folds").eqNullSafe(F.col("__folds")))).drop("__trades", "__folds")


def walk_forward(obs: DataFrame, spec: Folds, configs: Sequence[Config] = CANDIDATES, cost_bps: float = 24.0, columns: Sequence[str] = FEATURES) -> tuple[DataFrame, DataFrame]:
    """(fold metrics, roll-up) of every config.

    Observations and looked-at rows are written to the shared folder, since several jobs read them.
    """
    obs = stored(obs, "observations")
    rows = obs.count()
    parts = members(obs, rows, spec)
    models = fit(parts.filter("part = 'train'"), configs, columns)
    traded = stored(trades(score_folds(parts.filter("part = 'test'"), models, configs, columns), ["config", "fold"], spec.horizon, cost_bps), "traded")
    metrics = fold_metrics(traded, ["config", "fold"])
    return metrics, roll_up(metrics, ["config"], spec.test)


def final_models(obs: DataFrame, configs: Sequence[Config] = CANDIDATES, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Each config fitted on all observations."""
    return fit(obs.withColumn("fold", F.lit(0)), configs, columns)
