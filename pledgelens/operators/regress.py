"""Regressions by distributed sums: logit, least squares, censored, lasso.

A fit needs a few passes of :func:`~pledgelens.operators.gram.summed`; the
driver only solves systems as large as the number of predictors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.distributions import normal_two_sided
from .columns import class_sizes, design_matrix, fold_assign, present_columns, staged_features, to_matrix, varying_columns
from .gram import Steps, gram, summed, together
from .scaling import zscore
from .stored import stored

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054
LOG_2PI = math.log(2.0 * math.pi)


@dataclass
class Fit:
    """A fitted model; tables are one row per coefficient or one row in all."""

    label: str
    method: str
    names: list[str]
    n: int
    beta: np.ndarray | None = None
    cov: np.ndarray | None = None
    converged: bool = False
    skipped: bool = False
    stats: dict = field(default_factory=dict)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``feature, coef, std_err, z, p_value, ci_lo, ci_hi``."""
        rows = []
        for i, name in enumerate(self.names if self.beta is not None else []):
            b = float(self.beta[i])
            se = math.sqrt(max(self.cov[i, i], 0.0)) if self.cov is not None else None
            z = b / se if se else None
            p = normal_two_sided(z) if z is not None else None
            lo, hi = (b - Z95 * se, b + Z95 * se) if se is not None else (None, None)
            rows.append((name, b, se, z, p, lo, hi))
        return spark.createDataFrame(
            rows, "feature string, coef double, std_err double, z double, p_value double, ci_lo double, ci_hi double")

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row of fit statistics."""
        s = {k: (None if v is None else float(v)) for k, v in self.stats.items()}
        keys = ["r2", "adj_r2", "mcfadden_r2", "aic", "bic", "llf", "sigma", "n_censored", "n_uncensored"]
        row = (self.label, self.method, self.n, len(self.names), self.converged, self.skipped, *[s.get(k) for k in keys])
        return spark.createDataFrame([row], (
            "label string, method string, n bigint, n_params int, converged boolean, skipped boolean, "
            + ", ".join(f"{k} double" for k in keys)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _inverse(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def _too_small(label: str, method: str, names: list[str], n: int) -> Fit | None:
    return Fit(label, method, names, n, skipped=True) if len(names) >= n else None


# --------------------------------------------------------------------------
# Logit
# --------------------------------------------------------------------------
def logit(
    df: DataFrame, names: list[str], y: str, label: str = "logit", robust: str = "HC1",
    correction: bool = True, max_iter: int = 200, tol: float = 1e-8,
) -> Fit:
    """Maximum likelihood logit with sandwich errors.

    ``names`` includes the constant. ``correction`` applies the n / (n - k)
    factor of HC1; ``robust=None`` gives classical errors.
    """
    columns = [*names, y]
    return _alone(df.select(*columns), columns, _logit_steps(columns, names, y, label, robust, correction, max_iter, tol))


def _alone(data: DataFrame, columns: list[str], steps: Steps) -> Fit:
    data = data.persist()
    try:
        return together(data, columns, [steps])[0]
    finally:
        data.unpersist()


def _logit_steps(
    columns: list[str], names: list[str], y: str, label: str, robust: str | None = "HC1", correction: bool = True,
    max_iter: int = 200, tol: float = 1e-8,
) -> Steps:
    """The passes of :func:`logit` over rows of ``columns``."""
    k, own, at = len(names), [columns.index(c) for c in names], columns.index(y)
    counts = yield lambda rows: np.array([len(rows), np.nansum(rows[:, at])])
    n, positives = int(counts[0]), float(counts[1])
    skipped = _too_small(label, "logit", names, n)
    if skipped:
        return skipped
    beta, converged = np.zeros(k), False
    for _ in range(max_iter):
        def step(rows: np.ndarray, beta=beta) -> np.ndarray:
            x, t = rows[:, own], rows[:, at]
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
            return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (t - p)])

        out = yield step
        move = _solve(out[: k * k].reshape(k, k), out[k * k:])
        beta = beta + move
        if not np.all(np.isfinite(beta)):
            return Fit(label, "logit", names, n)
        if np.max(np.abs(move)) < tol:
            converged = True
            break

    def last(rows: np.ndarray) -> np.ndarray:
        x, t = rows[:, own], rows[:, at]
        eta = np.clip(x @ beta, -500, 500)
        p = 1.0 / (1.0 + np.exp(-eta))
        ll = float(np.sum(t * eta - np.logaddexp(0.0, eta)))
        return np.concatenate([
            ((x * (p * (1 - p))[:, None]).T @ x).ravel(), ((x * ((t - p) ** 2)[:, None]).T @ x).ravel(), [ll]])

    out = yield last
    bread, meat, llf = _inverse(out[: k * k].reshape(k, k)), out[k * k: 2 * k * k].reshape(k, k), float(out[-1])
    cov = bread
    if robust:
        cov = bread @ meat @ bread * (n / (n - k) if correction else 1.0)
    share = positives / n
    null = n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else 0.0
    stats = {"mcfadden_r2": 1 - llf / null if null else None, "llf": llf,
             "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf}
    return Fit(label, "logit", names, n, beta, cov, converged, False, stats)


def odds_ratios(coefficients: DataFrame) -> DataFrame:
    """Exponentials of coefficients and their interval, four decimals."""
    return coefficients.select(
        "feature", *[F.round(F.exp(c), 4).alias(n)
                     for c, n in (("coef", "OR"), ("ci_lo", "OR_lo"), ("ci_hi", "OR_hi"))])


def logit_fit_stats(df: DataFrame, y: str, probability: str, n_params: int) -> DataFrame:
    """Log-likelihood, McFadden R2, AIC and BIC of scored rows in one aggregate."""
    t, p = F.col(y).cast("double"), F.col(probability)
    ll = F.sum(F.when(t == 1, F.log(p)).otherwise(F.log(1 - p)))
    base = df.agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("k1"), ll.alias("llf"))
    share = F.col("k1") / F.col("n")
    null = F.col("n") * (share * F.log(share) + (1 - share) * F.log(1 - share))
    return base.select(
        "n", "llf", (1 - F.try_divide(F.col("llf"), null)).alias("mcfadden_r2"),
        (2 * F.lit(n_params) - 2 * F.col("llf")).alias("aic"),
        (F.lit(n_params) * F.log("n") - 2 * F.col("llf")).alias("bic"))


# --------------------------------------------------------------------------
# Least squares
# --------------------------------------------------------------------------
def ols(df: DataFrame, names: list[str], y: str, label: str = "ols", robust: str = "HC1") -> Fit:
    """Least squares with HC1 errors: one pass for the sums, one for the residuals."""
    columns = [*names, y]
    data = df.select(*names, F.col(y).cast("double").alias(y))
    return _alone(data, columns, _ols_steps(columns, names, y, label, robust))


def _ols_steps(columns: list[str], names: list[str], y: str, label: str, robust: str | None = "HC1") -> Steps:
    """The passes of :func:`ols` over rows of ``columns``."""
    k, own, at = len(names), [columns.index(c) for c in names], columns.index(y)
    g = yield lambda rows: _cross(rows[:, [*own, at]])
    g = g.reshape(k + 2, k + 2)
    n = int(round(g[-1, -1]))
    skipped = _too_small(label, "ols", names, n)
    if skipped:
        return skipped
    beta = _solve(g[:k, :k], g[:k, k])
    mean = g[k, -1] / n

    def residuals(rows: np.ndarray) -> np.ndarray:
        x, t = rows[:, own], rows[:, at]
        e = t - x @ beta
        return np.concatenate([((x * (e * e)[:, None]).T @ x).ravel(), [e @ e, np.sum((t - mean) ** 2)]])

    out = yield residuals
    meat, ssr, tss = out[: k * k].reshape(k, k), float(out[-2]), float(out[-1])
    bread = _inverse(g[:k, :k])
    cov = bread @ meat @ bread * n / (n - k) if robust else bread * ssr / (n - k)
    r2 = 1 - ssr / tss if tss > 0 else None
    llf = -n / 2 * (LOG_2PI + math.log(max(ssr, 1e-300) / n) + 1)
    stats = {
        "r2": r2, "adj_r2": None if r2 is None else 1 - (1 - r2) * (n - 1) / (n - k), "llf": llf,
        "aic": 2 * k - 2 * llf, "bic": k * math.log(n) - 2 * llf,
    }
    return Fit(label, "ols", names, n, beta, cov, True, False, stats)


def _cross(rows: np.ndarray) -> np.ndarray:
    """``X'X`` of the columns and a constant one."""
    x = np.column_stack([rows, np.ones(len(rows))])
    return (x.T @ x).ravel()


def vif(df: DataFrame, names: list[str]) -> DataFrame:
    """Variance inflation without the constant, so the R2 behind it is uncentred."""
    cols = [c for c in names if c != "const"]
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "feature string, VIF double")
    g = gram(df, cols)
    # Scaling to unit diagonal keeps the inversion stable; the result is unchanged.
    d = np.sqrt(np.diag(g))
    scaled = g / np.outer(d, d)
    rows = [(c, float(v)) for c, v in zip(cols, np.diag(_inverse(scaled)))]
    return spark.createDataFrame(rows, "feature string, VIF double").orderBy(F.desc("VIF"), "feature")


# --------------------------------------------------------------------------
# Censored regression
# --------------------------------------------------------------------------
#: Rational approximations of the normal distribution function near 0 and at medium distance (Cody, 1969): numerators, denominators.
_NEAR = ((0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582, 18154.981253343561249),
         (1.0, 47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956))
_MEDIUM = ((1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979, 597.27027639480026226,
            2494.5375852903726711, 6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218),
           (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755, 18615.571640885098091,
            34900.952721145977266, 38912.003286093271411, 19685.429676859990727))


def _log_normal_cdf(u: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, accurate far into the tail."""
    out, size = np.empty_like(u), np.abs(u)
    near = size <= 0.67448975
    z = u[near]
    out[near] = np.log(0.5 + z * np.polyval(_NEAR[0], z * z) / np.polyval(_NEAR[1], z * z))
    for inside, tail in (((size > 0.67448975) & (size <= math.sqrt(32.0)), lambda z: np.polyval(_MEDIUM[0], z) / np.polyval(_MEDIUM[1], z)),
                         (size > math.sqrt(32.0), _far_tail)):
        z, below = size[inside], u[inside] < 0
        log_tail = -0.5 * z * z + np.log(tail(z))
        out[inside] = np.where(below, log_tail, np.log1p(-np.exp(log_tail)))
    return out


def _far_tail(z: np.ndarray) -> np.ndarray:
    """The tail beyond z over exp(-z z / 2), by its continued fraction; for large z."""
    fraction = z.copy()
    for i in range(30, 0, -1):
        fraction = z + i / fraction
    return 1.0 / (math.sqrt(2.0 * math.pi) * fraction)


def tobit(
    df: DataFrame, names: list[str], y: str, lower: float = 0.0, label: str = "tobit",
    max_iter: int = 100, tol: float = 1e-8,
) -> Fit:
    """Left-censored regression by Newton steps on a concave likelihood.

    The parameters are beta / sigma and 1 / sigma, in which the likelihood has
    one maximum. Start: least squares on the uncensored rows, sigma at least 0.1.
    """
    columns = [*names, y]
    data = df.select(*names, F.col(y).cast("double").alias(y))
    return _alone(data, columns, _tobit_steps(columns, names, y, lower, label, max_iter, tol))


def _tobit_steps(
    columns: list[str], names: list[str], y: str, lower: float = 0.0, label: str = "tobit", max_iter: int = 100, tol: float = 1e-8,
) -> Steps:
    """The passes of :func:`tobit` over rows of ``columns``."""
    k, own, at = len(names), [columns.index(c) for c in names], columns.index(y)

    def start(rows: np.ndarray) -> np.ndarray:
        t = rows[:, at]
        return np.concatenate([[len(rows), np.sum(t <= lower), np.sum(t)], _cross(rows[t > lower][:, [*own, at]])])

    out = yield start
    n, censored = int(out[0]), int(out[1])
    free, mean = n - censored, out[2] / max(n, 1)
    counts = {"n_censored": censored, "n_uncensored": free}
    if free < k:
        return Fit(label, "tobit", names, n, skipped=True, stats=counts)
    g = out[3:].reshape(k + 2, k + 2)
    if free > k:
        b0 = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
        rss = max(g[k, k] - 2 * b0 @ g[:k, k] + b0 @ g[:k, :k] @ b0, 0.0)
        sigma0 = max(math.sqrt(rss / free), 0.1)
    else:
        b0 = np.zeros(k)
        spread = yield lambda rows: np.array([np.sum((rows[:, at] - mean) ** 2)])
        sigma0 = max(math.sqrt(spread[0] / n), 0.1)
    theta = np.concatenate([b0 / sigma0, [1.0 / sigma0]])

    def evaluate(theta: np.ndarray) -> Steps:
        def block(rows: np.ndarray) -> np.ndarray:
            x, t = rows[:, own], rows[:, at]
            z = np.column_stack([-x, t])
            u = z @ theta
            cut = t <= lower
            log_cdf = _log_normal_cdf(u[cut])
            hazard = np.exp(-0.5 * u[cut] ** 2 - 0.5 * LOG_2PI - log_cdf)
            slope, curve = -u, np.ones(len(t))
            slope[cut], curve[cut] = hazard, hazard * (hazard + u[cut])
            open_rows = int(np.sum(~cut))
            ll = np.sum(log_cdf) + open_rows * (math.log(theta[-1]) - 0.5 * LOG_2PI) - 0.5 * np.sum(u[~cut] ** 2)
            gradient, hess = z.T @ slope, -(z * curve[:, None]).T @ z
            gradient[-1] += open_rows / theta[-1]
            hess[-1, -1] -= open_rows / theta[-1] ** 2
            return np.concatenate([[ll], gradient, hess.ravel()])

        out = yield block
        return out[0], out[1: k + 2], out[k + 2:].reshape(k + 1, k + 1)

    ll, gradient, hess = yield from evaluate(theta)
    converged = False
    for _ in range(max_iter):
        move = -_solve(hess, gradient)
        # Where a predictor tells all censored rows its weight has no maximum: steps go on and gain no more than rounding.
        last, size = 0.5 * abs(gradient @ move) <= 1e-12 * (abs(ll) + 1.0), 1.0
        while theta[-1] + size * move[-1] <= 0:
            size /= 2
        improved = yield from evaluate(theta + size * move)
        while improved[0] < ll - 1e-9 * abs(ll) and size > 1e-8:
            size /= 2
            improved = yield from evaluate(theta + size * move)
        theta = theta + size * move
        done = last or (abs(improved[0] - ll) <= tol * (abs(ll) + tol) and np.max(np.abs(size * move)) < 1e-6)
        ll, gradient, hess = improved
        if done:
            converged = True
            break
    sigma = 1.0 / theta[-1]
    # Delta method back to beta and sigma.
    jac = np.zeros((k + 1, k + 1))
    jac[:k, :k] = np.eye(k) * sigma
    jac[:k, k] = -theta[:k] * sigma * sigma
    jac[k, k] = -sigma * sigma
    cov = jac @ _inverse(-hess) @ jac.T
    return Fit(label, "tobit", names, n, theta[:k] * sigma, cov[:k, :k], converged, False,
               {"llf": ll, "sigma": sigma, **counts})


# --------------------------------------------------------------------------
# L1 selection and the staged specifications
# --------------------------------------------------------------------------
@dataclass
class _Path:
    """One model on its way to the minimum of logistic loss plus penalties (the first weight is free): accepted weights, a direction and a step."""

    penalty: np.ndarray
    weights: np.ndarray
    value: float = math.inf
    move: np.ndarray | None = None
    slope: float = 0.0
    step: float = 1.0
    settled: bool = False

    def trial(self) -> np.ndarray:
        return self.weights if self.move is None else self.weights + self.step * self.move

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray, tol: float) -> None:
        """What the rows say of the trial: halve the step, or accept it and find the next direction."""
        trial = self.trial()
        value = loss + float(self.penalty @ np.abs(trial))
        if self.move is not None and value > self.value + 1e-4 * self.step * self.slope + 1e-12 * abs(self.value):
            self.step /= 2
            self.settled = self.step < 1e-6
            return
        self.weights, self.value = trial, value
        self.move = _l1_direction(trial, gradient, hessian, self.penalty)
        self.slope = float(gradient @ self.move) + float(self.penalty @ (np.abs(trial + self.move) - np.abs(trial)))
        self.step, self.settled = 1.0, float(np.abs(self.move).max()) < tol
        if not self.settled and -self.slope <= 1e-12 * (abs(value) + 1.0):
            # No more to gain than rounding: the last step is as good as a further pass would find it.
            self.weights, self.settled = trial + self.move, True


def _l1_direction(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The step to the minimum of the quadratic model plus penalties, by a search over the signs of the weights.

    The weights of given signs solve a linear system; a weight that would change its sign stops at 0 and leaves, the one that gains most
    joins. Each step lowers the value, so no set of signs comes twice, however alike the features are.
    """
    size = len(w)
    hessian = hessian + 1e-9 * max(float(np.trace(hessian)), 1e-9) / size * np.eye(size)
    goal, v = hessian @ w - gradient, w.copy()
    sign = np.sign(v)
    free = penalty <= 0
    sign[free] = 0.0
    active = free | (sign != 0)
    for _ in range(20 * size + 20):
        at = np.flatnonzero(active)
        z = _solve(hessian[np.ix_(at, at)], goal[at] - penalty[at] * sign[at])
        crossing = ~free[at] & (z * sign[at] < 0)
        if crossing.any():
            share = np.where(crossing, v[at] / np.where(crossing, v[at] - z, 1.0), 2.0)
            first = int(share.argmin())
            v[at] += min(max(share[first], 0.0), 1.0) * (z - v[at])
            out = at[first]
            v[out], sign[out], active[out] = 0.0, 0.0, False
            continue
        v[at] = z
        slack = goal - hessian @ v
        over = np.where(active, -1.0, np.abs(slack) - penalty)
        j = int(over.argmax())
        if over[j] <= 1e-9 * max(float(np.abs(goal).max()), 1e-300):
            break
        active[j], sign[j] = True, math.copysign(1.0, slack[j])
    return v - w


@dataclass(frozen=True)
class Cell:
    """An L1 logit over the rows outside ``fold`` (all if None): places of its features, a penalty for each and the weights of classes 0 and 1."""

    features: tuple[int, ...]
    penalty: tuple[float, ...]
    fold: int | None = None
    classes: tuple[float, float] = (1.0, 1.0)


#: Bytes of curvatures that a task holds in a pass of the L1 paths.
PATH_BYTES = 64 << 20


def l1_paths(data: DataFrame, names: list[str], y: str, cells: list[Cell], tol: float = 1e-7, max_passes: int = 60) -> list[np.ndarray]:
    """Weights (constant first) of each cell, all found together.

    ``data`` has the ``names`` on like scales, ``y`` and ``fold``. Every pass over the rows gives all cells the loss, gradient and curvature
    at their trial points; a cell then takes a proximal Newton step of its own.
    """
    paths = [_Path(np.array([0.0, *c.penalty]), np.zeros(len(c.features) + 1)) for c in cells]
    places = [np.array([0, *[f + 1 for f in c.features]]) for c in cells]
    columns, passes = [*names, y, "fold"], [0] * len(cells)
    while True:
        active, room = [], PATH_BYTES
        for i, p in enumerate(paths):
            if not p.settled and passes[i] < max_passes and (not active or 8 * len(p.weights) ** 2 <= room):
                active.append(i)
                passes[i] += 1
                room -= 8 * len(p.weights) ** 2
        if not active:
            return [p.weights for p in paths]
        trials = [paths[i].trial() for i in active]

        def block(rows: np.ndarray, trials=trials, active=active) -> np.ndarray:
            x = np.column_stack([np.ones(len(rows)), rows[:, :-2]])
            t, fold = rows[:, -2], rows[:, -1]
            out = []
            for i, trial in zip(active, trials):
                # Not all cells take all features.
                own = x if len(places[i]) == x.shape[1] else x[:, places[i]]
                weight = np.where(t > 0.5, cells[i].classes[1], cells[i].classes[0]) * (fold != (-1 if cells[i].fold is None else cells[i].fold))
                eta = own @ trial
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
                loss = ((np.logaddexp(0.0, eta) - t * eta) * weight).sum()
                out += [[loss], own.T @ ((p - t) * weight), ((own * (p * (1 - p) * weight)[:, None]).T @ own).ravel()]
            return np.concatenate(out)

        out, at = summed(data, columns, block), 0
        for i in active:
            k = len(paths[i].weights)
            paths[i].take(float(out[at]), out[at + 1: at + 1 + k], out[at + 1 + k: at + 1 + k + k * k].reshape(k, k), tol)
            at += 1 + k + k * k


def lasso_logit_paths(
    data: DataFrame, names: list[str], y: str, cells: list[tuple[float, int | None]], tol: float = 1e-7, max_passes: int = 60,
) -> np.ndarray:
    """Weights (constant first) of each cell ``(penalty, fold left out or None)`` over all ``names``."""
    every = tuple(range(len(names)))
    return np.stack(l1_paths(data, names, y, [Cell(every, (float(p),) * len(names), fold) for p, fold in cells], tol, max_passes))


def lasso_logit_cv(
    df: DataFrame, features: list[str], y: str, id_col: str, n_c: int = 10, folds: int = 3, seed: int = 42
) -> tuple[float | None, DataFrame]:
    """Best inverse penalty by cross-validated accuracy and the coefficients it keeps.

    Features are standardised; coefficients are sorted by absolute size, zeros left out. The models of all penalties and folds, and those
    of all rows, are one batch: a pass over the rows serves them all.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "feature string, coef double")
    # Read by five jobs before the rows are standardised; features may be dear.
    matrix = stored(to_matrix(df, features, [id_col, y]), "lasso-rows")
    names = varying_columns(matrix, present_columns(df, features))
    sizes = class_sizes(matrix, y)
    if not names or len(sizes) < 2:
        return None, empty
    folds = min(folds, min(sizes.values()))
    scaled = zscore(matrix.select(id_col, F.col(y).cast("double").alias("__y"), *names), names)
    data = fold_assign(scaled, id_col, "__y", folds, seed).select(*names, "__y", "fold").persist()
    try:
        grid = np.logspace(-4, 4, n_c)
        cells = [(1.0 / c, fold) for c in grid for fold in [*range(folds), None]]
        weights = lasso_logit_paths(data, names, "__y", cells).reshape(n_c, folds + 1, -1)

        def hits(rows: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(rows)), rows[:, :-2]])
            t, out = rows[:, -2] > 0.5, np.zeros((folds, n_c + 1))
            for fold in range(folds):
                own = rows[:, -1] == fold
                out[fold, :n_c] = ((x[own] @ weights[:, fold].T > 0) == t[own, None]).sum(axis=0)
                out[fold, n_c] = own.sum()
            return out.ravel()

        counted = summed(data, [*names, "__y", "fold"], hits).reshape(folds, n_c + 1)
    finally:
        data.unpersist()
    best = int((counted[:, :n_c] / counted[:, n_c:]).mean(axis=0).argmax())
    rows = sorted(((c, float(w)) for c, w in zip(names, weights[best, folds, 1:]) if w != 0), key=lambda r: (-abs(r[1]), r[0]))
    return float(grid[best]), spark.createDataFrame(rows, "feature string, coef double") if rows else empty


def staged_specs(
    df: DataFrame, id_col: str, flag: str = "is_successful", amount: str = "funding_pct",
    estimator: str = "ols", log_target: bool = False, specs: dict[str, list[str]] | None = None,
    with_lasso: bool = True,
) -> dict[str, DataFrame]:
    """Logit on the flag and OLS or Tobit on the amount, from controls to everything.

    Returns the two comparison tables, the full model's VIF and the L1 selection.
    """
    spark = df.sparkSession
    specs = specs or staged_features(df)
    if log_target:
        df = df.withColumn("__amount", F.log1p(amount))
    else:
        df = df.withColumn("__amount", F.col(amount).cast("double"))
    # All specifications share the rows, a table of the features that vary in any of them, and every pass over it.
    every = list(dict.fromkeys(c for features in specs.values() for c in features))
    matrix, names = design_matrix(df, every, [flag, "__amount"])
    columns = [*names, "__flag", "__amount"]
    matrix = matrix.select(*names, F.col(flag).cast("double").alias("__flag"), F.col("__amount").cast("double").alias("__amount")).persist()
    try:
        own = {name: ["const", *[c for c in features if c in names]] for name, features in specs.items()}
        steps: list[Steps] = [_logit_steps(columns, x, "__flag", name) for name, x in own.items()]
        if estimator == "tobit":
            steps += [_tobit_steps(columns, x, "__amount", 0.0, name) for name, x in own.items()]
        else:
            steps += [_ols_steps(columns, x, "__amount", name) for name, x in own.items()]
        fits = [f.summary(spark) for f in together(matrix, columns, steps)]
        *_, full = own.values()
        out = {"logit": _stack(fits[:len(own)]), estimator: _stack(fits[len(own):]), "vif": vif(matrix, full)}
    finally:
        matrix.unpersist()
    if with_lasso:
        out["lasso"] = lasso_logit_cv(df, list(specs.values())[-1], flag, id_col)[1]
    return out


def _stack(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
