"""Many small Gaussian-process fits: one bounded group per task, scoring as a join.

``GROUP_LIMIT`` is a guard, not a cap: a larger group keeps its rows, with a ``problem``, and must be blocked first.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.functions import gp
from platewright.functions.common import hash60
from platewright.functions.normal import gaussian_nlpd
from platewright.functions.vectors import combined, component_distances, rbf
from platewright.operators import reshape
from platewright.operators.stability import attach, spread_out, stable

GROUP_LIMIT = 2000
PARAMS = ("lengthscale_multiplier", "sigma_main", "sigma_epi", "sigma_noise")


def _gaps(pdf: pd.DataFrame, parts: int) -> np.ndarray:
    c = gp.split_components(np.vstack(pdf["vec"].to_numpy()), parts)
    return gp.squared_gaps(c, c)


def _seed(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def _score(pdf: pd.DataFrame, score: str | None):
    return None if score is None else pdf[score].to_numpy(float)


def _problem_of(train: pd.DataFrame) -> str | None:
    if len(train) < 3:
        return "too_few_rows"
    return "too_many_rows" if len(train) > GROUP_LIMIT else None


def _fit_or_problem(pdf: pd.DataFrame, params: dict, parts: int, score: str | None = None):
    """The exact fit of a group's rows, or why there is none."""
    problem = _problem_of(pdf)
    if problem is None:
        try:
            return gp.Fit(_gaps(pdf, parts), pdf["y"].to_numpy(), pdf["sem"].to_numpy(float), params, _score(pdf, score)), None
        except ValueError as e:  # LinAlgError is one
            problem = "singular" if isinstance(e, np.linalg.LinAlgError) else str(e).replace(" ", "_")
    return None, problem


def fit_groups(
    df: DataFrame, group: str, key: str, params: dict, parts: int, score: str | None = None
) -> DataFrame:
    """One exact fit per group; returns its weights as rows (group, train_id, alpha, scale columns, problem).

    A group that cannot be fitted keeps its rows, with the ``problem`` that ``pack_models`` names and without weights.
    """
    schema = T.StructType(
        [
            df.schema[group],
            T.StructField("train_id", df.schema[key].dataType),
            *[
                T.StructField(n, T.DoubleType())
                for n in ("alpha", "y_mean", "y_sd", "lengthscale", "intercept", "slope")
            ],
            T.StructField("problem", T.StringType()),
        ]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        fit, problem = _fit_or_problem(pdf, params, parts, score)
        if fit is None:
            kept = pd.DataFrame({group: pdf[group], "train_id": pdf[key], "problem": problem})
            return kept.reindex(columns=schema.names)
        beta = (0.0, 0.0) if fit.beta is None else fit.beta
        return pd.DataFrame(
            {
                group: pdf[group],
                "train_id": pdf[key],
                "alpha": fit.alpha,
                "y_mean": fit.y_mean,
                "y_sd": fit.y_sd,
                "lengthscale": fit.lengthscale,
                "intercept": float(beta[0]),
                "slope": float(beta[1]),
                "problem": None,
            }
        )

    columns = [group, key, "vec", "y", "sem"] + ([score] if score else [])
    return spread_out(df.select(*columns), group).groupBy(group).applyInPandas(run, schema)


def score_candidates(
    candidates: DataFrame,
    train: DataFrame,
    weights: DataFrame,
    group: str,
    key: str,
    lengthscale: Column,
    sigma_main: float,
    sigma_epi: float,
    parts: int,
    width: int,
) -> DataFrame:
    """Posterior mean of any number of candidates: y_mean + y_sd * sum(k alpha), as join and sum."""
    basis = train.select(group, F.col(key).alias("train_id"), F.col("vec").alias("_vb")).join(
        weights, [group, "train_id"]
    )
    pairs = candidates.select(group, key, F.col("vec").alias("_va")).join(basis, group)
    d = component_distances("_va", "_vb", parts, width)
    k = combined(F.transform(d, lambda x: rbf(x, lengthscale)), sigma_main, sigma_epi)
    return (
        pairs.withColumn("_ka", k * F.col("alpha"))
        .groupBy(group, key, "y_mean", "y_sd")
        .agg(F.sum("_ka").alias("_s"))
        .select(group, key, (F.col("y_mean") + F.col("y_sd") * F.col("_s")).alias("predicted"))
    )


def pack_models(df: DataFrame, group: str, key: str, params: dict, parts: int) -> DataFrame:
    """One exact fit per group, packed into one row: ``group, model (binary), n_train, problem``.

    A group that cannot be fitted (fewer than three rows, a target that does not vary, no usable length scale, more rows
    than a dense fit takes, a singular matrix) has its ``problem`` and no model; the others go on.
    """
    kinds = [T.StructField("model", T.BinaryType()), T.StructField("n_train", T.LongType()), T.StructField("problem", T.StringType())]
    schema = T.StructType([df.schema[group], *kinds])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        fit, problem = _fit_or_problem(pdf, params, parts)
        model = None if fit is None else pickle.dumps((fit, np.vstack(pdf["vec"].to_numpy())))
        return pd.DataFrame([(pdf[group].iloc[0], model, len(pdf), problem)], columns=schema.names)

    return spread_out(df.select(group, key, "vec", "y", "sem"), group).groupBy(group).applyInPandas(run, schema)


def score_packed(
    candidates: DataFrame, packed: DataFrame, group: str, key: str, parts: int, chunk: int = 5000
) -> DataFrame:
    """Posterior mean, latent and observed SD of any number of candidates: ``group, key, predicted, sd_latent,
    sd_observed, problem``.

    The candidates of a group are cut by hash into chunks of about ``chunk`` rows, each of which meets the group's
    packed model in a task of its own; there is no row per candidate and train pair. Candidates of a group without a
    model are returned with its problem.
    """
    fields = [T.StructField(n, T.DoubleType()) for n in ("predicted", "sd_latent", "sd_observed")]
    schema = T.StructType(
        [candidates.schema[group], candidates.schema[key], *fields, T.StructField("problem", T.StringType())]
    )
    counts = stable(candidates.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_chunks")))
    rows = attach(candidates.select(group, key, "vec"), counts, [group])
    rows = rows.withColumn("_chunk", F.pmod(hash60(key), F.col("_chunks"))).drop("_chunks")
    models = packed.join(counts, group).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))

    def run(c: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = c[[group, key]].copy()
        if c.empty:
            return pd.DataFrame(columns=schema.names)
        problem = "no_model" if m.empty else m["problem"].iloc[0]
        columns = [[None] * len(c)] * 3
        if problem is None:
            fit, train = pickle.loads(m["model"].iloc[0])
            x, step = np.vstack(c["vec"].to_numpy()), max(1, 2_000_000 // (parts * len(train)))
            base = gp.split_components(train, parts)
            parts_of = [fit.predict(gp.squared_gaps(gp.split_components(x[i : i + step], parts), base)) for i in range(0, len(x), step)]
            columns = [np.concatenate(p) for p in zip(*parts_of, strict=True)]
        for f, values in zip(fields, columns, strict=True):
            out[f.name] = values
        return out.assign(problem=problem)

    keys = [group, "_chunk"]
    left = spread_out(rows, *keys).groupBy(*keys)
    return left.cogroup(models.select(*keys, "model", "problem").groupBy(*keys)).applyInPandas(run, schema)


_PREDICTED = (
    "observed", "predicted", "sd_latent", "sd_observed", "distance_scale", "lengthscale", "objective",
    "intercept", "slope", *PARAMS,
)
_REPORT = [
    T.StructField("converged", T.BooleanType()),
    *[T.StructField(n, T.IntegerType()) for n in ("iterations", "restarts", "converged_restarts")],
]
_PROBLEM = T.StructField("problem", T.StringType())


def _report(found: dict) -> tuple:
    """The search's report as columns; all null where parameters were given."""
    return tuple(found.get(f.name) for f in _REPORT)


def _predict_unit(train, test, unit, settings, parts, key, score) -> list[tuple]:
    """Prediction rows of one train/test split under every setting.

    A split that cannot be fitted keeps its test rows, with a ``problem`` and no prediction.
    """
    out: list[tuple] = []
    if test.empty:
        return out
    shared: dict = {}
    for s in settings:
        try:
            columns, tail = _predict_setting(train, test, unit, s, parts, score, shared)
            problem = None
        except (ValueError, np.linalg.LinAlgError) as e:
            problem = "singular" if isinstance(e, np.linalg.LinAlgError) else str(e).replace(" ", "_")
            columns, tail = np.full((3, len(test)), None), (None,) * (len(_PREDICTED) - 4 + len(_REPORT))
        for i, row in enumerate(test[[key, "y"]].itertuples(index=False)):
            out.append((*unit, s["name"], row[0], row[1], *[c[i] for c in columns], *tail, problem))
    return out


def _predict_setting(train, test, unit, s: dict, parts: int, score, shared: dict):
    """(mean, latent SD, observed SD) of the test rows, and what is the same for all of them."""
    problem = _problem_of(train)
    if problem:
        raise ValueError(problem)
    y, sem, zs = train["y"].to_numpy(), train["sem"].to_numpy(float), _score(train, score)
    shape = (1 if s["family"] == "global" else parts, s.get("pca"))
    if shape not in shared:
        xa, xb = np.vstack(train["vec"].to_numpy()), np.vstack(test["vec"].to_numpy())
        a, b = gp.reduce_on_train(gp.split_components(xa, shape[0]), gp.split_components(xb, shape[0]), shape[1])
        shared[shape] = (gp.squared_gaps(a, a), gp.squared_gaps(b, a))
    gaps, cross = shared[shape]
    found: dict = {}
    if "params" in s:
        params = {**gp.START, **s["params"]}
        if s["family"] != "epistatic":
            params["sigma_epi"] = 0.0
    else:
        params, _, found = gp.search(gaps, y, sem, s["family"], s["starts"], _seed(*unit, s["name"]), zs)
    fit = gp.Fit(gaps, y, sem, params, zs)
    value = fit.nll + gp.penalty(params, s["family"])
    # The linear mean of this very fit; its coefficients depend on the covariance parameters.
    beta = (None, None) if fit.beta is None else tuple(float(b) for b in fit.beta)
    tail = (fit.scale, fit.lengthscale, value, *beta, *[params[p] for p in PARAMS], *_report(found))
    return fit.predict(cross, _score(test, score)), tail


def _prediction_schema(df: DataFrame, units: list[T.StructField], key: str) -> T.StructType:
    return T.StructType(
        [
            *units,
            T.StructField("setting", T.StringType()),
            df.schema[key],
            *[T.StructField(n, T.DoubleType()) for n in _PREDICTED],
            *_REPORT,
            _PROBLEM,
        ]
    )


def predict_groups(
    roles: DataFrame,
    units: list[str],
    key: str,
    settings: list[dict],
    parts: int,
    score: str | None = None,
) -> DataFrame:
    """Fit each unit's ``role = 'train'`` rows and predict its test rows under every setting.

    A setting holds ``name`` and ``family`` (additive, epistatic, global), optionally ``pca`` and
    either fixed ``params`` or a number of ``starts`` for a search on the train rows. Test rows of a unit that cannot be
    fitted (fewer than three train rows, more than a dense fit takes, a constant target) come with a ``problem``.
    """
    schema = _prediction_schema(roles, [roles.schema[c] for c in units], key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        unit = [pdf[c].iloc[0] for c in units]
        train, test = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        out = _predict_unit(train, test, unit, settings, parts, key, score)
        return pd.DataFrame(out, columns=schema.names)

    columns = [*units, key, "vec", "y", "sem", "role"] + ([score] if score else [])
    return spread_out(roles.select(*columns), *units).groupBy(*units).applyInPandas(run, schema)


def predict_splits(
    df: DataFrame,
    group: str,
    fold: str,
    key: str,
    settings: list[dict],
    parts: int,
    k: int,
    nested: bool,
    score: str | None = None,
) -> DataFrame:
    """Predictions of every (outer, inner) split; inner = outer is the outer split itself.

    Each row is shuffled once, by its group, and the k (or k^2) splits are cut inside the bounded
    group instead of multiplying the vectors before the shuffle.
    """
    ids = [T.StructField(n, T.IntegerType()) for n in ("outer", "inner")]
    schema = _prediction_schema(df, [df.schema[group], *ids], key)
    splits = [(o, i) for o in range(k) for i in range(k) if nested or o == i]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        out: list[tuple] = []
        for o, i in splits:
            known = pdf if o == i else pdf[pdf[fold] != o]
            train, test = known[known[fold] != i], known[known[fold] == i]
            unit = [pdf[group].iloc[0], o, i]
            out += _predict_unit(train, test, unit, settings, parts, key, score)
        return pd.DataFrame(out, columns=schema.names)

    columns = [group, key, fold, "vec", "y", "sem"] + ([score] if score else [])
    return spread_out(df.select(*columns), group).groupBy(group).applyInPandas(run, schema)


def search_groups(df: DataFrame, group: str, key: str, family: str, starts: int, parts: int) -> DataFrame:
    """Hyper-parameters of every group by ``starts`` descents that step together; the lowest wins.

    Returns ``group, objective``, the parameters, ``converged, iterations, restarts, converged_restarts`` and a
    ``problem`` where a group cannot be fitted. A best descent that did not converge says so.
    """
    values = [T.StructField(n, T.DoubleType()) for n in ("objective", *PARAMS)]
    schema = T.StructType([df.schema[group], *values, *_REPORT, _PROBLEM])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        name, problem = pdf[group].iloc[0], _problem_of(pdf)
        row = (name, *[None] * (len(schema) - 2))
        if problem is None:
            try:
                y, sem = pdf["y"].to_numpy(), pdf["sem"].to_numpy(float)
                params, value, found = gp.search(_gaps(pdf, parts), y, sem, family, starts, _seed(name, family))
                row = (name, value, *[params[p] for p in PARAMS], *_report(found))
            except ValueError as e:
                problem = str(e).replace(" ", "_")
        return pd.DataFrame([(*row, problem)], columns=schema.names)

    return spread_out(df.select(group, key, "vec", "y", "sem"), group).groupBy(group).applyInPandas(run, schema)


def grid_selection(
    df: DataFrame, group: str, fold: str, key: str, grid: list[dict], parts: int, k: int
) -> DataFrame:
    """Nested choice over a fixed grid: each family's best point per outer fold, and its predictions there.

    ``grid`` holds ``family``, an absolute ``lengthscale`` and the three amplitudes. Every point is tried on every inner
    split; the smallest inner (MAE, RMSE, place in the grid) wins. Kernels of a group are made once for all splits
    and points. Returns ``group, outer, family, key, observed, predicted, sd_latent, sd_observed``, the point,
    ``inner_mae, inner_rmse`` and ``problem``, which stands for splits that cannot be fitted.
    """
    point = ("lengthscale", "sigma_main", "sigma_epi", "sigma_noise")
    doubles = ("observed", "predicted", "sd_latent", "sd_observed", *point, "inner_mae", "inner_rmse")
    schema = T.StructType(
        [
            df.schema[group], T.StructField("outer", T.IntegerType()), T.StructField("family", T.StringType()), df.schema[key],
            *[T.StructField(n, T.DoubleType()) for n in doubles], _PROBLEM,
        ]
    )
    families = list(dict.fromkeys(g["family"] for g in grid))
    members = {f: [i for i, g in enumerate(grid) if g["family"] == f] for f in families}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        name, folds, y = pdf[group].iloc[0], pdf[fold].to_numpy(), pdf["y"].to_numpy(float)
        out, gaps = [], None if len(pdf) > GROUP_LIMIT else _gaps(pdf, parts)
        for o in range(k):
            test = np.flatnonzero(folds == o)
            if not len(test):
                continue
            inner = [(np.flatnonzero((folds != o) & (folds != i)), np.flatnonzero(folds == i)) for i in range(k) if i != o]
            inner = [s for s in inner if len(s[1])]
            splits = [(np.flatnonzero(folds != o), test), *inner]
            problem = "too_many_rows" if gaps is None else "too_few_rows" if min(len(a) for a, _ in splits) < 3 or not inner else None
            if problem is None:
                try:
                    outer, *tried = gp.grid_predictions(gaps, y, pdf["sem"].to_numpy(float), splits, grid)
                except ValueError as e:
                    problem = str(e).replace(" ", "_")
                except np.linalg.LinAlgError:
                    problem = "singular"
            if problem is not None:
                out += [(name, o, f, pdf[key].iloc[t], y[t], *[None] * 9, problem) for f in families for t in test]
                continue
            error = np.concatenate([y[s[1]][None, :] - p[:, :, 0] for s, p in zip(inner, tried, strict=True)], axis=1)
            mae, rmse = np.abs(error).mean(axis=1), np.sqrt((error**2).mean(axis=1))
            for f, own in members.items():
                g = min(own, key=lambda i: (mae[i], rmse[i], i))
                at = [grid[g][p] for p in point]
                for j, t in enumerate(test):
                    out.append((name, o, f, pdf[key].iloc[t], y[t], *outer[g, j], *at, mae[g], rmse[g], None))
        return pd.DataFrame(out, columns=schema.names)

    columns = [group, key, fold, "vec", "y", "sem"]
    return spread_out(df.select(*columns), group).groupBy(group).applyInPandas(run, schema)


def boundary_hits(df: DataFrame, bounds: dict = gp.BOUNDS) -> DataFrame:
    """Flags for parameters within 2 % of the log span of either bound."""
    out = df
    flags = []
    for name, (low, high) in bounds.items():
        if name not in df.columns:
            continue
        x = F.log(F.col(name))
        span = F.lit(float(np.log(high) - np.log(low)))
        gap = F.least(F.abs(x - F.lit(float(np.log(low)))), F.abs(F.lit(float(np.log(high))) - x))
        out = out.withColumn(f"hit_{name}", gap <= F.lit(gp.BOUNDARY_SHARE) * span)
        flags.append(F.col(f"hit_{name}"))
    any_hit = flags[0]
    for f in flags[1:]:
        any_hit = any_hit | f
    return out.withColumn("any_hit", any_hit)


def setting_metrics(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Selection criteria per key: MAE, NLPD and RMSE."""
    err = F.col("observed") - F.col("predicted")
    return predictions.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.avg(gaussian_nlpd("observed", "predicted", "sd_observed")).alias("nlpd"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def nested_predictions(
    df: DataFrame, group: str, fold: str, key: str, settings: list[dict], parts: int, k: int
) -> DataFrame:
    """All settings on all inner and outer splits; the base table of every nested result."""
    return predict_splits(df, group, fold, key, settings, parts, k, nested=True)


def nested_selection(all_predictions: DataFrame, group: str) -> DataFrame:
    """Best setting per (group, outer fold) by inner (MAE, NLPD, RMSE), its outer predictions, and the
    SD scale fitted on the inner residuals of that setting only."""
    from platewright.operators.metrics import sigma_scale

    unit = [group, "outer"]
    inner = all_predictions.where(F.col("inner") != F.col("outer"))
    chosen = reshape.best_by(
        setting_metrics(inner, [*unit, "setting"]), unit, ["mae", "nlpd", "rmse"], "setting"
    ).select(*unit, "setting", F.col("mae").alias("inner_mae"))
    residuals = inner.join(chosen, [*unit, "setting"])
    scales = sigma_scale(residuals, unit, "sd_observed")
    outer = all_predictions.where(F.col("inner") == F.col("outer")).join(chosen, [*unit, "setting"])
    return (
        outer.join(scales, unit, "left")
        .withColumn("scale", F.coalesce("scale", F.lit(1.0)))
        .withColumn("sd_calibrated", F.col("sd_observed") * F.col("scale"))
        .drop("inner")
    )
