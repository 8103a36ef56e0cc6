"""Forecasts of a row-ordered series at several horizons, trained together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions.maths import dot, doubles
from loomtab.models.arrays import block_columns, summed
from loomtab.models.linear import kernel_map
from loomtab.models.losses import Linear
from loomtab.models.shared_pass import Problem, fit_all, training_table
from loomtab.models.shared_trees import held_out_sums, training_rows
from loomtab.operators import metrics
from loomtab.operators.aggregates import fold_summary
from loomtab.operators.columns import stack_frames
from loomtab.operators.neighbors import Side, knn_join, neighbor_mean
from loomtab.operators.ordering import ordinal, shifted
from loomtab.operators.ranking import best_model, last_value
from loomtab.operators.splits import kfold, split
from loomtab.plans.leaderboard import Entry
from loomtab.plans.search import fold_predictions


def horizon_table(df: DataFrame, order: str, value: str, horizons: Mapping[str, int], lags: int = 5) -> DataFrame:
    """(horizon, code, position, order, value, lag_1.., target, n): one copy of the series per horizon.

    ``target`` is the value ``horizons[name]`` rows ahead and NULL on the last rows, which are
    the ones to forecast.
    """
    placed = ordinal(df, order)
    shifts = {f"lag_{i}": (value, -i) for i in range(1, lags + 1)}
    shifts |= {f"ahead_{name}": (value, steps) for name, steps in horizons.items()}
    looked = shifted(placed, "position", shifts)
    names = list(horizons)
    copies = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("horizon"), F.lit(i).alias("code"), F.lit(horizons[n]).alias("steps"), F.col(f"ahead_{n}").alias("target"))
                for i, n in enumerate(names)
            ]
        )
    )
    return looked.select(
        order, "position", value, *[f"lag_{i}" for i in range(1, lags + 1)], copies.alias("h")
    ).select("*", "h.*").drop("h")


def scaled_features(table: DataFrame, columns: Sequence[str], fit_on: str = "train") -> DataFrame:
    """Lags rescaled to [-1, 1] per horizon as 'features'; rows without a full history are left out.

    ``fit_on='train'`` takes the ranges from rows whose target is known; 'all' from every row.
    """
    complete = table.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    base = complete.filter("target IS NOT NULL") if fit_on == "train" else complete
    ranges = base.groupBy("code").agg(
        *[e for c in columns for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    )
    joined = complete.join(F.broadcast(ranges), "code")  # one row per horizon
    scaled = [
        F.coalesce(
            F.try_divide(2.0 * F.col(c) - F.col(f"lo_{c}") - F.col(f"hi_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)
        )
        for c in columns
    ]
    return joined.select(*table.columns, F.array(*scaled).alias("features"))


def linear_forecasts(ready: DataFrame, order: str, strength: float = 1e-3, loss: str = "squared", folds: int = 5) -> dict[str, DataFrame]:
    """Fit one linear model per horizon (and per fold) in shared passes.

    Returns 'metrics' (four hold-out metrics per horizon), 'folds' (mean r2 and its standard
    error) and 'forecast' (prediction for the last row of each horizon).
    """
    known = split(kfold(ready.filter("target IS NOT NULL"), order, folds), order)
    codes = [(r["code"], r["horizon"]) for r in ready.select("code", "horizon").distinct().orderBy("code").collect()]
    width = ready.select(F.size("features")).first()[0]
    family = Linear(width, loss)
    train = known.filter("split = 'train'").withColumn("_cell", F.col("code") * F.lit(folds) + F.col("fold"))
    center, spread = train.agg(F.avg("target"), F.stddev_pop("target")).first()
    spread = spread or 1.0
    table = training_table(train.withColumn("_target", (F.col("target") - F.lit(center)) / F.lit(spread)), "features", "_target", "_cell")
    try:
        parts = [_HorizonProblem(family, l2=strength, first=c * folds, last=c * folds + folds - 1) for c, _ in codes]
        held = [
            _HorizonProblem(family, l2=strength, first=c * folds, last=c * folds + folds - 1, holdout=c * folds + f)
            for c, _ in codes
            for f in range(folds)
        ]
        fit_all(table, [*parts, *held])
    finally:
        table.unpersist()

    def predicted(df: DataFrame, models: Mapping[int, Problem], code: str) -> DataFrame:
        answer = F.lit(None).cast("double")
        for c, p in models.items():
            line = dot(F.col("features"), doubles(p.theta[:-1])) + F.lit(float(p.theta[-1]))
            answer = F.when(F.col(code) == c, line * F.lit(spread) + F.lit(center)).otherwise(answer)
        return df.withColumn("prediction", answer)

    final = dict(zip([c for c, _ in codes], parts))
    by_cell = dict(zip([c * folds + f for c, _ in codes for f in range(folds)], held))
    test = predicted(known.filter("split = 'test'"), final, "code")
    cross = metrics.regression(predicted(train, by_cell, "_cell"), "target", "prediction", ["horizon", "fold"])
    future = predicted(ready, final, "code")
    return {
        "metrics": metrics.regression(test, "target", "prediction", ["horizon"]),
        "folds": fold_summary(cross, "r2", ["horizon"]),
        "forecast": last_value(future, "prediction", order, ["horizon"]),
    }


def searched_forecasts(
    ready: DataFrame, order: str, entries: Sequence[Entry], folds: int = 5, parallelism: int = 4
) -> dict[str, DataFrame]:
    """Search any list of regressors at every horizon, refit the best one of each and forecast with it.

    Returns 'search' (mean r2 over folds and its standard error per horizon and candidate, or the
    error of a candidate that failed), 'metrics' (hold-out metrics of the winners) and 'forecast'
    (their value for the last row). Candidates of a shared kind are cross-validated together over all
    horizons and folds: trees by the shared histogram learner, neighbours by one ranked join a horizon,
    rbf machines as one wide linear fit. The rest take a job a horizon and candidate.
    """
    known = split(kfold(ready.filter("target IS NOT NULL"), order, folds), order).persist()
    train = known.filter("split = 'train'")
    names = [r["horizon"] for r in ready.select("horizon").distinct().orderBy("horizon").collect()]

    by = ["horizon", "candidate"]
    together: dict[str, list[Entry]] = {}
    for entry in entries:
        if entry.shared:
            together.setdefault(entry.shared[0], []).append(entry)
    alone = [e for e in entries if not e.shared]

    def crossed(cell: tuple[str, Entry]) -> list[tuple]:
        horizon, entry = cell
        try:
            out = fold_predictions(entry.train, train.filter(F.col("horizon") == horizon), "fold", folds, 1)
            scores = metrics.regression(out.select("fold", "target", "prediction"), "target", "prediction", ["fold"])
            return [(horizon, entry.name, r["fold"], r["r2"], None) for r in scores.collect()]
        except Exception as error:  # a failed candidate is a result, not the end of the search
            return [(horizon, entry.name, None, None, f"{type(error).__name__}: {str(error)[:500]}")]

    def crossed_together(kind: str) -> list[tuple]:
        try:
            return CROSSED[kind](train, together[kind], folds)
        except Exception as error:
            return [(h, e.name, None, None, f"{type(error).__name__}: {str(error)[:500]}") for h in names for e in together[kind]]

    def chosen(horizon: str) -> tuple[DataFrame, DataFrame]:
        entry = next(e for e in entries if e.name == winners[horizon])
        model = entry.train(train.filter(F.col("horizon") == horizon))
        test = model.transform(known.filter((F.col("split") == "test") & (F.col("horizon") == horizon)))
        future = model.transform(ready.filter(F.col("horizon") == horizon))
        return tuple(df.select("horizon", F.lit(entry.name).alias("candidate"), order, "target", "prediction") for df in (test, future))

    with ThreadPoolExecutor(parallelism) as pool:
        single = pool.map(crossed, [(h, e) for h in names for e in alone])
        rows = [r for part in [*pool.map(crossed_together, list(together)), *single] for r in part]
        scores = ready.sparkSession.createDataFrame(rows, "horizon string, candidate string, fold int, r2 double, error string")
        table = fold_summary(scores, "r2", by).join(scores.groupBy(*by).agg(F.max("error").alias("error")), by)
        table = ready.sparkSession.createDataFrame(table.toArrow(), table.schema)
        winners = {r["horizon"]: r["candidate"] for r in best_model(table.filter("mean IS NOT NULL"), "mean", by=["horizon"]).collect()}
        if not winners:
            raise ValueError(f"every candidate failed, the first with {rows[0][-1] if rows else 'no row'}")
        tests, futures = zip(*pool.map(chosen, [h for h in names if h in winners]))
    return {
        "search": table,
        "metrics": metrics.regression(stack_frames(tests), "target", "prediction", by),
        "forecast": last_value(stack_frames(futures), "prediction", order, by),
    }


Scored = list[tuple[str, str, int, float, None]]


def _horizons(train: DataFrame) -> list[tuple[int, str]]:
    return [(r["code"], r["horizon"]) for r in train.select("code", "horizon").distinct().orderBy("code").collect()]


def _tree_scores(train: DataFrame, entries: Sequence[Entry], folds: int) -> Scored:
    """Fold scores of single trees and boosting; a forest's members are summed over their folds' held-out rows."""
    codes = _horizons(train)
    cells = [(h, c, f, e) for c, h in codes for e in entries for f in range(folds)]
    groups = [[replace(s, part=c, holdout=f) for s in e.shared[1]] for _, c, f, e in cells]
    rows = training_rows(train, "features", F.col("target"), F.col("position"), "code", "fold").persist()
    try:
        sums = held_out_sums(rows, groups)
    finally:
        rows.unpersist()
    return [(h, e.name, f, _r2(s), None) for (h, _, f, e), s in zip(cells, sums) if s["n"]]


def _r2(s: Mapping[str, float]) -> float | None:
    spread = s["squares"] - s["total"] ** 2 / s["n"]
    return float(1.0 - s["off_squares"] / spread) if spread > 0 else None


def _neighbor_scores(train: DataFrame, entries: Sequence[Entry], folds: int) -> Scored:
    """Every number of neighbours and every fold from one ranked join a horizon: a row's own fold is excluded."""
    out: Scored = []
    for code, horizon in _horizons(train):
        rows = train.filter(F.col("code") == code)
        side = Side(rows, "position", "features", "target", "fold")
        found = knn_join(side, side, max(e.shared[1] for e in entries))
        answers = found.select("id", *[neighbor_mean(F.col("neighbors"), e.shared[1]).alias(f"p{i}") for i, e in enumerate(entries)])
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"p{i}").alias("prediction")) for i in range(len(entries))])).alias("e")
        truth = rows.select(F.col("position").cast("bigint").alias("id"), "fold", "target")
        scored = answers.join(truth, "id").select("fold", "target", each).select("fold", "target", "e.*")
        scores = metrics.regression(scored, "target", "prediction", ["i", "fold"])
        out += [(horizon, entries[r["i"]].name, r["fold"], r["r2"], None) for r in scores.collect()]
    return out


def _rbf_scores(train: DataFrame, entries: Sequence[Entry], folds: int) -> Scored:
    """Epsilon-insensitive machines of all kernel widths, horizons and folds as one linear fit over one wide feature row."""
    codes, wide = _horizons(train), train
    for i, e in enumerate(entries):
        gamma, components = e.shared[1]
        wide = kernel_map(wide.withColumn(f"_map{i}", F.col("features")), "rbf", gamma=gamma, components=components, features=f"_map{i}")
    ends = np.cumsum([0, *(e.shared[1][1] for e in entries)]).tolist()
    wide = wide.withColumn("_wide", F.concat(*[f"_map{i}" for i in range(len(entries))])).withColumn("_cell", F.col("code") * F.lit(folds) + F.col("fold"))
    table = training_table(wide, "_wide", "target", "_cell")
    cells = [(i, c, f) for i in range(len(entries)) for c, _ in codes for f in range(folds)]
    problems = []
    for i, c, f in cells:
        problem = _HorizonProblem(Linear(ends[i + 1] - ends[i], "tube"), 1.0, c * folds, c * folds + folds - 1, c * folds + f, (ends[i], ends[i + 1]))
        problem.tol = 1e-6
        problems.append(problem)
    try:
        fit_all(table, problems)
        thetas = {cell: (p.span, p.theta) for cell, p in zip(cells, problems)}

        def work(batches) -> np.ndarray:
            totals = np.zeros((len(cells), 4))
            for batch in batches:
                block = block_columns(batch)
                for j, (i, c, f) in enumerate(cells):
                    held = block["fold"] == c * folds + f
                    (start, end), theta = thetas[i, c, f]
                    y = block["y"][held]
                    off = y - block["features"][held, start:end] @ theta[:-1] - theta[-1]
                    totals[j] += len(y), y.sum(), y @ y, off @ off
            return totals.ravel()

        sums = summed(table, work, table.rdd.getNumPartitions()).reshape(len(cells), 4)
    finally:
        table.unpersist()
    names = dict(codes)
    rows = [dict(zip(("n", "total", "squares", "off_squares"), s)) for s in sums]
    return [(names[c], entries[i].name, f, _r2(s), None) for (i, c, f), s in zip(cells, rows) if s["n"]]


CROSSED = {"trees": _tree_scores, "neighbors": _neighbor_scores, "rbf": _rbf_scores}


class _HorizonProblem(Problem):
    """A problem over the rows of one horizon: a run of fold codes, minus the held-out one."""

    def __init__(self, family: Linear, l2: float, first: int, last: int, holdout: int | None = None, span: tuple[int, int] | None = None):
        super().__init__(family, l2=l2, holdout=holdout, span=span, max_iter=100, tol=1e-8)
        self.first, self.last = first, last

    def bare(self) -> _HorizonProblem:
        return _HorizonProblem(self.family, self.l2, self.first, self.last, self.holdout, self.span)

    def sight(self):
        return *super().sight(), self.first, self.last

    def rows(self, block):
        y, weight = super().rows(block)
        weight[(block["fold"] < self.first) | (block["fold"] > self.last)] = 0.0
        return y, weight
