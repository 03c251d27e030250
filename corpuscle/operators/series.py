"""Kernels on one short time series, in NumPy: they run inside one group of applyInPandas."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from corpuscle.functions.special import normal_ppf, t_logpdf, t_ppf, t_two_sided

# changepoints


def _costs(x: np.ndarray, model: str) -> Callable[[int, int], float]:
    """cost(i, j) of the segment x[i:j]."""
    if model == "l2":
        s, q = np.concatenate(([0], np.cumsum(x))), np.concatenate(([0], np.cumsum(x * x)))
        return lambda i, j: q[j] - q[i] - (s[j] - s[i]) ** 2 / (j - i)
    if model == "l1":
        return lambda i, j: float(np.abs(x[i:j] - np.median(x[i:j])).sum())
    if model == "normal":
        return lambda i, j: (j - i) * math.log(float(np.var(x[i:j])) + 1e-12)
    if model == "rbf":
        d = (x[:, None] - x[None, :]) ** 2
        middle = float(np.median(d[np.triu_indices(len(x), 1)]))
        # scaled distances are kept within [0.01, 100]; a point is at no distance from itself
        scaled = np.clip(d / middle if middle > 0 else d, 1e-2, 1e2)
        np.fill_diagonal(scaled, 0.0)
        k = np.exp(-scaled).cumsum(0).cumsum(1)
        k = np.pad(k, ((1, 0), (1, 0)))
        return lambda i, j: (j - i) - (k[j, j] - k[i, j] - k[j, i] + k[i, i]) / (j - i)
    raise ValueError(f"unknown cost {model!r}")


def detect_changepoints(x: np.ndarray, method: str = "pelt", penalty: float | None = None, model: str = "rbf", min_size: int = 2, jump: int = 5, width: int = 100) -> list[int]:
    """Where new segments begin."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4:
        raise ValueError("at least four observations are needed")
    if np.isnan(x).any():
        raise ValueError("the series has gaps")
    penalty = math.log(n) if penalty is None else penalty
    cost = _costs(x, model)
    if method == "pelt":
        ends = [k for k in range(0, n, jump) if k >= min_size] + [n]
        best, before, open_ = {0: 0.0}, {0: 0}, [0]
        for end in ends:
            options = [(best[s] + cost(s, end) + penalty, s) for s in open_ if end - s >= min_size]
            if not options:
                continue
            value, start = min(options)
            best[end], before[end] = value, start
            worth = {s for v, s in options if v - penalty <= value}
            open_ = [s for s in open_ if s in worth or end - s < min_size] + [end]
        found, at = [], n
        while at > 0:
            at = before.get(at, 0)
            if at:
                found.append(at)
        return sorted(found)
    if method == "binseg":
        cuts = [0, n]
        while True:
            gains = []
            for a, b in zip(cuts, cuts[1:]):
                for m in range(a, b):
                    if m % jump == 0 and m - a >= min_size and b - m >= min_size:
                        gains.append((cost(a, b) - cost(a, m) - cost(m, b), m))
            if not gains or max(gains)[0] <= penalty:
                return cuts[1:-1]
            cuts = sorted([*cuts, max(gains)[1]])
    if method == "window":
        half = min(width, n) // 2
        score = {m: cost(m - half, m + half) - cost(m - half, m) - cost(m, m + half) for m in range(half, n - half + 1, jump) if half >= min_size}
        found: list[int] = []
        for m in sorted(score, key=score.get, reverse=True):
            if score[m] <= penalty:
                break
            if all(abs(m - f) >= half for f in found):
                found.append(m)
        return sorted(m for m in found if 0 < m < n)
    raise ValueError(f"unknown method {method!r}")


# online changepoints


@dataclass
class RunLengths:
    """Normal-inverse-gamma beliefs for each possible run length; advance() takes one value."""

    hazard: float
    mu_0: float
    kappa_0: float
    alpha_0: float
    beta_0: float
    max_run: int | None = None

    def __post_init__(self) -> None:
        if not 0 < self.hazard < 1:
            raise ValueError("the hazard lies between 0 and 1")
        if min(self.kappa_0, self.alpha_0, self.beta_0) <= 0:
            raise ValueError("kappa, alpha and beta must be positive")
        if self.max_run is not None and self.max_run < 1:
            raise ValueError("the longest run is at least 1")
        self.p = np.array([1.0])
        self.mu, self.kappa, self.alpha, self.beta = (np.array([v]) for v in (self.mu_0, self.kappa_0, self.alpha_0, self.beta_0))

    def advance(self, x: float) -> np.ndarray:
        scale = np.sqrt(self.beta * (self.kappa + 1) / (self.alpha * self.kappa))
        seen = np.exp(t_logpdf(x, 2 * self.alpha, self.mu, scale)) * self.p
        p = np.concatenate(([seen.sum() * self.hazard], seen * (1 - self.hazard)))
        beta = self.beta + self.kappa * (x - self.mu) ** 2 / (2 * (self.kappa + 1))
        mu = (self.kappa * self.mu + x) / (self.kappa + 1)
        self.mu, self.kappa = np.concatenate(([self.mu_0], mu)), np.concatenate(([self.kappa_0], self.kappa + 1))
        self.alpha, self.beta = np.concatenate(([self.alpha_0], self.alpha + 0.5)), np.concatenate(([self.beta_0], beta))
        if self.max_run is not None and len(p) > self.max_run + 1:
            keep = self.max_run + 1
            p, self.mu, self.kappa, self.alpha, self.beta = (v[:keep] for v in (p, self.mu, self.kappa, self.alpha, self.beta))
        total = p.sum()
        self.p = p / total if total > 0 else np.full(len(p), 1 / len(p))
        return self.p


@dataclass(frozen=True)
class BocpdResult:
    posterior: np.ndarray
    map_run_length: np.ndarray
    cp_probability: np.ndarray

    def cp_probability_recent(self, threshold: int = 3) -> np.ndarray:
        return self.posterior[:, : threshold + 1].sum(axis=1)

    def detected_changepoints(self, threshold: int = 3) -> list[int]:
        return [i for i, r in enumerate(self.map_run_length) if i > threshold and r <= threshold]


def bocpd(x: np.ndarray, hazard: float = 0.01, mu_0: float | None = None, kappa_0: float = 1.0, alpha_0: float = 1.0, beta_0: float | None = None, max_run_length: int | None = None) -> BocpdResult:
    """Posterior of the run length after each value; priors default to those of the whole series."""
    x = np.asarray(x, float)
    if not len(x) or np.isnan(x).any():
        raise ValueError("the series is empty or has gaps")
    mu_0 = float(x.mean()) if mu_0 is None else mu_0
    if beta_0 is None:
        beta_0 = max(float(np.var(x, ddof=1)) * (alpha_0 - 0.5), 1e-6) if len(x) > 1 else 1e-6
    state = RunLengths(hazard, mu_0, kappa_0, alpha_0, beta_0, max_run_length)
    rows = [state.advance(float(v)) for v in x]
    table = np.zeros((len(x), max(map(len, rows))))
    for i, r in enumerate(rows):
        table[i, : len(r)] = r
    return BocpdResult(table, table.argmax(axis=1), table[:, 0])


# bursts


def kleinberg_bursts(counts: np.ndarray, totals: np.ndarray, s: float = 2.0, gamma: float = 1.0, n_states: int = 5) -> np.ndarray:
    """The state, from 0, of each period: the cheapest path of a chain whose rates rise by s."""
    if s <= 1:
        raise ValueError("s must exceed 1")
    if n_states < 2:
        raise ValueError("there are at least two states")
    if gamma < 0:
        raise ValueError("gamma must not be negative")
    r, d = np.asarray(counts, float), np.asarray(totals, float)
    if len(r) != len(d) or (d <= 0).any():
        raise ValueError("each period needs a positive total")
    if r.sum() == 0:
        return np.zeros(len(r), np.int64)
    rates = np.minimum(r.sum() / d.sum() * s ** np.arange(n_states), 0.999999)
    step = np.arange(n_states)
    up = gamma * math.log(max(len(r), 2)) * np.clip(np.subtract.outer(-step, -step), 0, None)
    emit = -(r[:, None] * np.log(rates) + (d - r)[:, None] * np.log1p(-rates))
    cost, back = up[0] + emit[0], []
    for e in emit[1:]:
        through = cost[:, None] + up
        back.append(through.argmin(axis=0))
        cost = through.min(axis=0) + e
    path = [int(cost.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1], np.int64)


# interrupted series


def interrupted(x: np.ndarray, event: int, level: float = 0.95) -> pd.DataFrame:
    """Least squares on time, a step at the event (an index), and a change of slope from it on."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4 or np.isnan(x).any():
        raise ValueError("at least four observations without gaps are needed")
    if not 0 < event < n:
        raise ValueError("the event lies outside the series")
    t = np.arange(n, dtype=float)
    post = (t >= event).astype(float)
    design = np.column_stack((np.ones(n), t, post, post * (t - event)))
    coef, *_ = np.linalg.lstsq(design, x, rcond=None)
    free = n - 4
    rest = x - design @ coef
    var = float(rest @ rest) / free if free else math.nan
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(design.T @ design)) * var, 0))
    with np.errstate(all="ignore"):
        ratio = coef / se
    half = t_ppf(0.5 + level / 2, free) * se if free else np.full(4, math.nan)
    return pd.DataFrame({
        "coefficient": ["intercept", "time", "level_change", "slope_change"], "coef": coef, "std_err": se, "t": ratio,
        "p_value": [t_two_sided(v, free) if free else math.nan for v in ratio], "ci_lower": coef - half, "ci_upper": coef + half,
    })


# minimisation


def minimise(f: Callable[[np.ndarray], float], x0: np.ndarray, steps: int = 400, scale: float = 0.5) -> np.ndarray:
    """Nelder-Mead from x0."""
    n = len(x0)
    points = [np.array(x0, float)] + [np.array(x0, float) + scale * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-10 * (1 + abs(values[0])):
            break
        middle = np.mean(points[:-1], axis=0)
        tried = middle + (middle - points[-1])
        v = f(tried)
        if v < values[0]:
            far = middle + 2 * (middle - points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            near = middle + 0.5 * ((tried if v < values[-1] else points[-1]) - middle)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


# structural series


def _filter(x: np.ndarray, obs: float, lev: float, slope: float, trend: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Kalman filter: (-log likelihood, last state, last covariance)."""
    k = 2 if trend else 1
    move = np.array([[1.0, 1.0], [0.0, 1.0]]) if trend else np.eye(1)
    noise = np.diag([lev, slope][:k])
    state = np.zeros(k)
    state[0] = x[0]
    cov = np.eye(k) * 1e6 * max(float(np.var(x)), 1e-8)
    cost, skip = 0.0, k
    for i, v in enumerate(x):
        if i:
            state, cov = move @ state, move @ cov @ move.T + noise
        f = cov[0, 0] + obs
        err = v - state[0]
        gain = cov[:, 0] / f
        state, cov = state + gain * err, cov - np.outer(gain, cov[0])
        if i >= skip:
            cost += 0.5 * (math.log(2 * math.pi * f) + err * err / f)
    return cost, state, cov


IMPACT_COLUMNS = (
    "observed", "counterfactual", "counterfactual_lower", "counterfactual_upper", "pointwise_effect", "pointwise_lower",
    "pointwise_upper", "cumulative_effect", "cumulative_lower", "cumulative_upper",
)


def causal_impact(
    x: np.ndarray, event: int, level: float = 0.95, n_samples: int = 1000, seed: int = 0, model: str = "local linear trend",
    min_pre_periods: int = 15, min_post_periods: int = 8, max_pre_post_ratio: float = 5.0,
) -> tuple[pd.DataFrame, dict[str, float]]:
    """What the series did from the event (an index) on, against the forecast from before.

    The model is fitted by maximum likelihood to the periods before the event; bands of the cumulative
    effect come from simulated paths.
    """
    x = np.asarray(x, float)
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")
    if model not in ("local linear trend", "local level"):
        raise ValueError(f"unknown model {model!r}")
    if n_samples < 1:
        raise ValueError("at least one path is simulated")
    n, pre, post = len(x), event, len(x) - event
    if np.isnan(x).any():
        raise ValueError("the series has gaps")
    if pre < min_pre_periods or post < min_post_periods:
        raise ValueError(f"{pre} periods before and {post} after the event; at least {min_pre_periods} and {min_post_periods} are needed")
    if post / pre > max_pre_post_ratio:
        raise ValueError("the window after the event is too long for the one before")
    past, trend = x[:event], model == "local linear trend"
    k = 2 if trend else 1
    size = max(float(np.var(past)), 1e-12)

    def cost(theta: np.ndarray) -> float:
        v = np.exp(np.clip(theta, -40, 40)) * size + 1e-14
        c = _filter(past, v[0], v[1], v[2] if trend else 0.0, trend)[0]
        return c if math.isfinite(c) else 1e12

    flat = float(np.var(past)) < 1e-18
    theta = np.array([-1.0, -2.0, -4.0][: k + 1])
    v = np.full(3, 1e-14) if flat else np.append(np.exp(np.clip(minimise(cost, theta), -40, 40)) * size + 1e-14, 0.0)[:3]
    _, state, cov = _filter(past, v[0], v[1], v[2] if trend else 0.0, trend)
    if flat:
        cov = np.zeros((k, k))
    move = np.array([[1.0, 1.0], [0.0, 1.0]]) if trend else np.eye(1)
    noise = np.diag([v[1], v[2]][:k])
    z = normal_ppf(0.5 + level / 2)
    mean, sd = np.empty(post), np.empty(post)
    s, c = state.copy(), cov.copy()
    for i in range(post):
        s, c = move @ s, move @ c @ move.T + noise
        mean[i], sd[i] = s[0], math.sqrt(max(c[0, 0] + v[0], 0))
    rng = np.random.default_rng(seed)
    root = np.linalg.cholesky(cov + 1e-16 * np.eye(k)) if not flat else np.zeros((k, k))
    states = state + rng.standard_normal((n_samples, k)) @ root.T
    paths = np.empty((n_samples, post))
    for i in range(post):
        states = states @ move.T + rng.standard_normal((n_samples, k)) * np.sqrt(np.diag(noise))
        paths[:, i] = states[:, 0] + rng.standard_normal(n_samples) * math.sqrt(v[0])
    tail = (1 - level) / 2
    effects = x[event:] - paths
    sums = effects.cumsum(axis=1)
    nan = np.full(pre, math.nan)
    table = pd.DataFrame({
        "observed": x, "counterfactual": np.concatenate((past, mean)),
        "counterfactual_lower": np.concatenate((nan, mean - z * sd)), "counterfactual_upper": np.concatenate((nan, mean + z * sd)),
        "pointwise_effect": np.concatenate((np.zeros(pre), x[event:] - mean)),
        "pointwise_lower": np.concatenate((nan, np.quantile(effects, tail, axis=0))), "pointwise_upper": np.concatenate((nan, np.quantile(effects, 1 - tail, axis=0))),
        "cumulative_effect": np.concatenate((np.zeros(pre), np.cumsum(x[event:] - mean))),
        "cumulative_lower": np.concatenate((nan, np.quantile(sums, tail, axis=0))), "cumulative_upper": np.concatenate((nan, np.quantile(sums, 1 - tail, axis=0))),
    })
    each = effects.mean(axis=1)
    base = float(mean.mean())
    avg = float((x[event:] - mean).mean())
    metrics = {
        "avg_effect": avg, "avg_effect_lower": float(np.quantile(each, tail)), "avg_effect_upper": float(np.quantile(each, 1 - tail)),
        "cumulative_effect": avg * post, "cumulative_effect_lower": float(table["cumulative_lower"].iloc[-1]),
        "cumulative_effect_upper": float(table["cumulative_upper"].iloc[-1]),
        "relative_effect": avg / base if abs(base) > 1e-12 else math.nan, "counterfactual_mean": base,
        "p_no_effect_mc": min(1.0, 2 * min(float((each <= 0).mean()), float((each >= 0).mean()))),
    }
    return table, metrics


# forecasts

EPSILON = 1e-6


def _smooth(x: np.ndarray, alpha: float, beta: float, level: float, slope: float) -> tuple[np.ndarray, float, float]:
    errors = np.empty(len(x))
    for i, v in enumerate(x):
        errors[i] = v - level - slope
        level, slope = level + slope + alpha * errors[i], slope + beta * errors[i]
    return errors, level, slope


def forecast(x: np.ndarray, horizon: int, level: float = 0.95, method: str = "auto", logit_transform: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, lower, upper). auto: exponential smoothing with additive trend from 8 values on, else Holt."""
    x = np.asarray(x, float)
    x = x[~np.isnan(x)]
    if len(x) < 4:
        raise ValueError("at least four observations are needed")
    y = np.log(np.clip(x, EPSILON, 1 - EPSILON) / (1 - np.clip(x, EPSILON, 1 - EPSILON))) if logit_transform else x
    method = ("ets" if len(y) >= 8 else "holt") if method == "auto" else method
    inside = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))

    def unpack(theta: np.ndarray) -> tuple[float, float, float, float]:
        alpha = float(inside(theta[0])) * 0.9998 + 1e-4
        return alpha, alpha * float(inside(theta[1])), float(theta[2]), float(theta[3])

    start = np.array([0.0, -2.0, y[0] - (y[-1] - y[0]) / (len(y) - 1), (y[-1] - y[0]) / (len(y) - 1)])
    theta = minimise(lambda t: float((_smooth(y, *unpack(t))[0] ** 2).sum()), start, steps=600)
    alpha, beta, first, slope = unpack(theta)
    errors, last, slope = _smooth(y, alpha, beta, first, slope)
    h = np.arange(1, horizon + 1)
    point = last + h * slope
    z = normal_ppf(0.5 + level / 2)
    if method == "ets":
        sigma2 = float((errors**2).mean())
        growth = np.concatenate(([0.0], np.cumsum((alpha + beta * h[:-1]) ** 2)))
        half = z * np.sqrt(sigma2 * (1 + growth))
    else:
        half = z * float(errors.std(ddof=1)) * np.sqrt(h)
    out = (point, point - half, point + half)
    return tuple(inside(v) for v in out) if logit_transform else out
