"""Dense NumPy versions of the per-series models, which the Spark expressions are tested against."""

import numpy as np

def _lagmat(x: np.ndarray, p: int) -> np.ndarray:
    n = len(x)
    return np.column_stack([x[p - i - 1:n - i - 1] for i in range(p)]) if p else np.zeros((n - p, 0))


def _arma_fit(z: np.ndarray, p: int, q: int):
    """Two-stage least squares; returns (coef, intercept, resid, sse, n_used)."""
    n = len(z)
    long_p = int(max(1, min(10, n // 4)))
    if n <= long_p + max(p, q) + 2:
        return None
    X = np.column_stack([np.ones(n - long_p), _lagmat(z, long_p)])
    beta, *_ = np.linalg.lstsq(X, z[long_p:], rcond=None)
    eps = np.zeros(n)
    eps[long_p:] = z[long_p:] - X @ beta
    start = long_p + max(p, q)
    rows = range(start, n)
    cols = [np.ones(len(rows))]
    cols += [z[[t - i for t in rows]] for i in range(1, p + 1)]
    cols += [eps[[t - j for t in rows]] for j in range(1, q + 1)]
    A = np.column_stack(cols)
    coef, *_ = np.linalg.lstsq(A, z[start:], rcond=None)
    resid = z[start:] - A @ coef
    return coef, eps, float(resid @ resid), len(resid), start


def _arma_forecast(z: np.ndarray, eps: np.ndarray, coef: np.ndarray, p: int, q: int, h: int) -> np.ndarray:
    hist = list(z)
    e = list(eps)
    out = []
    for _ in range(h):
        v = coef[0]
        v += sum(coef[1 + i] * hist[-1 - i] for i in range(p))
        v += sum(coef[1 + p + j] * e[-1 - j] for j in range(q))
        hist.append(v)
        e.append(0.0)
        out.append(v)
    return np.array(out)


def _undiff(y: np.ndarray, fc: np.ndarray, d: int) -> np.ndarray:
    """Integrate ``d`` times, each time from the last value of that level."""
    for k in range(d - 1, -1, -1):
        fc = np.diff(y, n=k)[-1] + np.cumsum(fc)
    return fc


def arima(y: np.ndarray, order: tuple[int, int, int], h: int) -> np.ndarray:
    p, d, q = order
    z = np.diff(y, n=d) if d else y.astype(float)
    fit = _arma_fit(z, p, q)
    if fit is None:
        return np.repeat(y[-1] if len(y) else np.nan, h)
    coef, eps, *_ = fit
    return _undiff(y, _arma_forecast(z, eps, coef, p, q, h), d)


def auto_arima(y: np.ndarray, h: int, max_p: int = 5, max_q: int = 5, max_d: int = 2):
    """Every order fitted and scored on the rows that all candidates have."""
    best = None
    for d in range(max_d + 1):
        z = np.diff(y, n=d) if d else y.astype(float)
        n = len(z)
        long_p = int(max(1, min(10, n // 4)))
        if n <= long_p:
            continue
        X = np.column_stack([np.ones(n - long_p), _lagmat(z, long_p)])
        beta, *_ = np.linalg.lstsq(X, z[long_p:], rcond=None)
        eps = np.zeros(n)
        eps[long_p:] = z[long_p:] - X @ beta
        rows = np.arange(int(max(1, min(10, len(y) // 4))) + max(max_p, max_q) + max_d - d, n)
        if len(rows) < 3:
            continue
        for p in range(max_p + 1):
            for q in range(max_q + 1):
                A = np.column_stack([np.ones(len(rows)), *[z[rows - i] for i in range(1, p + 1)], *[eps[rows - j] for j in range(1, q + 1)]])
                coef, *_ = np.linalg.lstsq(A, z[rows], rcond=None)
                sse, n_, k = float(((z[rows] - A @ coef) ** 2).sum()), len(rows), p + q + 1
                if n_ - k - 1 <= 0 or sse <= 0:
                    continue
                cand = (n_ * np.log(sse / n_) + 2 * k + 2 * k * (k + 1) / (n_ - k - 1), d, p, q)
                if best is None or cand < best[0]:
                    best = (cand, coef, z, eps)
    if best is None:
        return np.repeat(y[-1] if len(y) else np.nan, h), (0, 0, 0)
    (_, d, p, q), coef, z, eps = best
    return _undiff(y, _arma_forecast(z, eps, coef, p, q, h), d), (p, d, q)


def _loess(x: np.ndarray, y: np.ndarray, span: int, x_eval: np.ndarray) -> np.ndarray:
    n = len(x)
    q = min(span, n)
    out = np.empty(len(x_eval))
    for i, x0 in enumerate(x_eval):
        d = np.abs(x - x0)
        idx = np.argsort(d)[:q]
        dmax = max(d[idx].max(), 1e-12) * (1.0 if q < n else max(1.0, (span / n)))
        w = (1 - (d[idx] / (dmax * 1.000001)) ** 3) ** 3
        W = w.sum()
        if W <= 0:
            out[i] = y[idx].mean()
            continue
        xm = (w * x[idx]).sum() / W
        b_den = (w * (x[idx] - xm) ** 2).sum()
        ym = (w * y[idx]).sum() / W
        slope = 0.0 if b_den <= 1e-12 else (w * (x[idx] - xm) * (y[idx] - ym)).sum() / b_den
        out[i] = ym + slope * (x0 - xm)
    return out


def stl(y: np.ndarray, m: int, inner: int = 2, seasonal_window: int = 7):
    """STL (Cleveland et al. 1990) without robustness iterations."""
    n = len(y)
    t_win = int(np.ceil(1.5 * m / (1 - 1.5 / seasonal_window)))
    t_win += (t_win % 2 == 0)
    low_win = m + (m % 2 == 0)
    trend = np.zeros(n)
    season = np.zeros(n)
    idx = np.arange(n, dtype=float)
    average = lambda x, k: np.convolve(x, np.ones(k) / k, mode="valid")
    for _ in range(inner):
        detr = y - trend
        cycle = np.zeros(n + 2 * m)  # one cycle before and one after the series
        for p in range(m):
            pos = np.arange(p, n, m).astype(float)
            at = np.concatenate([[pos[0] - m], pos, [pos[-1] + m]])
            cycle[at.astype(int) + m] = _loess(pos, detr[p::m], seasonal_window, at)
        low = average(average(average(cycle, m), m), 3)  # n values again
        low = _loess(idx, low, low_win, idx)
        season = cycle[m:m + n] - low
        trend = _loess(idx, y - season, t_win, idx)
    return trend, season
