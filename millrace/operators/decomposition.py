"""PCA, truncated SVD, factor analysis, PLS and CCA from one Gram pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.functions.core import Estimator, Transformer, dot


def signed(components: np.ndarray) -> np.ndarray:
    """Rows whose entry of largest size is positive."""
    at = np.abs(components).argmax(axis=1)
    flip = np.sign(components[np.arange(len(components)), at])
    return components * np.where(flip == 0, 1, flip)[:, None]


class _Projection(Transformer):
    def transform(self, df, features=None, prefix="pc"):
        cols = self._ready(df, features)
        at = [c - float(m) for c, m in zip(cols, self.mean_)]
        return df.withColumns({f"{prefix}{k}": dot(at, w) for k, w in enumerate(self.components_)})

    def inverse_transform(self, df, features=None, prefix="pc"):
        z = [F.col(f"{prefix}{k}") for k in range(len(self.components_))]
        return df.withColumns({f"x{i}": dot(z, self.components_[:, i], float(self.mean_[i])) for i in range(self.width)})


class PCA(_Projection):
    """Eigenvectors of the covariance over n - 1; each component's largest entry is positive."""

    defaults = {"n_components": 0, "svd_solver": "full", "n_oversamples": 10, "n_iter": 5, "random_state": None}
    ignored = ("svd_solver", "n_oversamples", "n_iter", "random_state")

    def fit(self, df, features, label=None):
        return self.fit_moments(stats.moments(df, self._start(df, features)))

    def fit_sparse(self, df: DataFrame, n_rows: int, width: int, row="row_id", feature="feature_idx", value="value"):
        self.features, self.width = [f"x{i}" for i in range(width)], width
        return self.fit_moments(stats.sparse_moments(df, n_rows, width, row, feature, value))

    def fit_moments(self, m):
        if m.n < 2:
            raise ValueError("two rows at least")
        k = self.n_components or min(m.n, self.width)
        if k > min(m.n, self.width):
            raise ValueError("more components than rows or features")
        values, vectors = np.linalg.eigh(m.scatter)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        self.mean_, self.components_ = m.mean, signed(vectors[:, :k].T)
        self.singular_values_ = np.sqrt(values[:k])
        self.explained_variance_ = values[:k] / (m.n - 1)
        self.explained_variance_ratio_ = values[:k] / values.sum() if values.sum() else np.zeros(k)
        self.fitted = True
        return self


class TruncatedSVD(_Projection):
    """Right singular vectors without centring; ``explained_variance_`` is s^2 / (n - 1)."""

    defaults = {"n_components": 2}

    def fit(self, df, features, label=None):
        return self.fit_moments(stats.moments(df, self._start(df, features)))

    def fit_sparse(self, df, n_rows, width, row="row_id", feature="feature_idx", value="value"):
        self.features, self.width = [f"x{i}" for i in range(width)], width
        return self.fit_moments(stats.sparse_moments(df, n_rows, width, row, feature, value))

    def fit_moments(self, m):
        k = self.n_components
        if k > self.width:
            raise ValueError("more components than features")
        values, vectors = np.linalg.eigh(m.raw())
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        self.mean_, self.components_ = np.zeros(self.width), signed(vectors[:, :k].T)
        self.singular_values_ = np.sqrt(values[:k])
        self.explained_variance_ = values[:k] / max(1, m.n - 1)
        self.explained_variance_ratio_ = values[:k] / values.sum() if values.sum() else np.zeros(k)
        self.fitted = True
        return self


class FactorAnalysis(Estimator):
    """Maximum likelihood by EM on the covariance matrix."""

    defaults = {"n_components": 0, "max_iter": 1000, "tol": 1e-3}

    def fit(self, df, features):
        m = stats.moments(df, self._start(df, features))
        s, p, k = m.cov, self.width, self.n_components or self.width
        psi, old = np.maximum(np.diag(s).copy(), 1e-12), -np.inf
        for self.n_iter_ in range(1, self.max_iter + 1):
            root = np.sqrt(psi)
            values, vectors = np.linalg.eigh(s / np.outer(root, root))
            values, vectors = values[::-1], vectors[:, ::-1]
            w = root[:, None] * vectors[:, :k] * np.sqrt(np.maximum(values[:k] - 1, 0))
            psi = np.maximum(np.diag(s) - (w * w).sum(axis=1), 1e-12)
            sigma = w @ w.T + np.diag(psi)
            like = -0.5 * m.n * (p * np.log(2 * np.pi) + np.linalg.slogdet(sigma)[1] + np.trace(np.linalg.solve(sigma, s)))
            if abs(like - old) < self.tol:
                break
            old = like
        self.mean_, self.components_, self.noise_variance_, self.log_likelihood_ = m.mean, w, psi, float(like)
        self.covariance_ = w @ w.T + np.diag(psi)
        self.fitted = True
        return self

    def score(self, df) -> float:
        m = stats.moments(df, self._ready(df))
        d = m.mean - self.mean_
        _, logdet = np.linalg.slogdet(self.covariance_)
        return float(-0.5 * (self.width * np.log(2 * np.pi) + logdet + np.trace(np.linalg.solve(self.covariance_, m.cov + np.outer(d, d)))))


class _Cross(Estimator):
    """Pairs of directions by power iterations on X'X, X'Y and Y'Y: every deflation is bilinear in them."""

    defaults = {"n_components": 2, "scale": True, "max_iter": 500, "tol": 1e-6}
    canonical = False

    def fit(self, df: DataFrame, features, labels):
        labels = [labels] if isinstance(labels, str) else list(labels)
        cols, p, q = self._start(df, features, labels[0]), None, len(labels)
        p = self.width
        self.labels = labels
        m = stats.moments(df, [*cols, *[F.col(c).cast("double") for c in labels]])
        if self.n_components > min(p, m.n):
            raise ValueError("more components than features or rows")
        std = np.sqrt(np.diag(m.scatter) / (m.n - 1)) if self.scale else np.ones(p + q)
        std[std == 0] = 1.0
        s = m.scatter / np.outer(std, std)
        xx, xy, yy = s[:p, :p].copy(), s[:p, p:].copy(), s[p:, p:].copy()
        w_, c_, p_, q_, self.n_iter_ = [], [], [], [], []
        for _ in range(self.n_components):
            c = np.zeros(q)
            c[int(np.argmax(np.diag(yy)))] = 1.0
            w, old = None, None
            for k in range(1, self.max_iter + 1):
                w = xy @ c
                if self.canonical:
                    w = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ w
                w = w / max(np.linalg.norm(w), 1e-300)
                c = xy.T @ w
                if self.canonical:
                    c = np.linalg.pinv(yy, rcond=1e-10, hermitian=True) @ c
                c = c / max(np.linalg.norm(c), 1e-300)
                if old is not None and ((w - old) ** 2).sum() < self.tol or q == 1 and not self.canonical:
                    break
                old = w
            flip = np.sign(w[np.abs(w).argmax()]) or 1.0
            w, c = w * flip, c * flip
            tt, uu = w @ xx @ w, c @ yy @ c
            if tt < 1e-300:
                raise ValueError("no variance is left for another component")
            px = xx @ w / tt
            py = yy @ c / max(uu, 1e-300) if self.canonical else xy.T @ w / tt
            # X - t p', and Y - u p' (canonical) or Y - t q': the three products follow.
            a = np.eye(p) - np.outer(w, px)
            if self.canonical:
                b = np.eye(q) - np.outer(c, py)
                xy, yy, xx = a.T @ xy @ b, b.T @ yy @ b, a.T @ xx @ a
            else:
                xw = xy.T @ w
                yy = yy - np.outer(xw, py) - np.outer(py, xw) + tt * np.outer(py, py)
                xy, xx = a.T @ (xy - np.outer(xx @ w, py)), a.T @ xx @ a
            for store, v in ((w_, w), (c_, c), (p_, px), (q_, py)):
                store.append(v)
            self.n_iter_.append(k)
        self.x_weights_, self.y_weights_, self.x_loadings_, self.y_loadings_ = (np.array(v).T for v in (w_, c_, p_, q_))
        self.x_rotations_ = self.x_weights_ @ np.linalg.pinv(self.x_loadings_.T @ self.x_weights_)
        self.y_rotations_ = self.y_weights_ @ np.linalg.pinv(self.y_loadings_.T @ self.y_weights_)
        self._x_mean, self._x_std, self._y_mean, self._y_std = m.mean[:p], std[:p], m.mean[p:], std[p:]
        inner = self._regression(s[:p, :p], s[:p, p:])
        self.coef_ = (inner * (self._y_std[None, :] / self._x_std[:, None])).T
        self.intercept_ = self._y_mean - self.coef_ @ self._x_mean
        self.fitted = True
        return self

    def _regression(self, xx, xy):
        if not self.canonical:
            return self.x_rotations_ @ self.y_loadings_.T
        t = self.x_rotations_  # the target regressed on the scores
        return t @ np.linalg.pinv(t.T @ xx @ t) @ (t.T @ xy)

    def transform(self, df, features=None, prefix="xs"):
        at = [(c - float(m)) / float(s) for c, m, s in zip(self._ready(df, features), self._x_mean, self._x_std)]
        return df.withColumns({f"{prefix}{k}": dot(at, r) for k, r in enumerate(self.x_rotations_.T)})

    def transform_both(self, df, features=None):
        out = self.transform(df, features)
        at = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.labels, self._y_mean, self._y_std)]
        return out.withColumns({f"ys{k}": dot(at, r) for k, r in enumerate(self.y_rotations_.T)})

    def predict(self, df, features=None, out="prediction"):
        cols = self._ready(df, features)
        each = [dot(cols, w, float(b)) for w, b in zip(self.coef_, self.intercept_)]
        return df.withColumn(out, each[0] if len(each) == 1 else F.array(*each))

    def score(self, df) -> float:
        """Mean R squared of the targets."""
        from millrace.functions import metrics

        p = self.predict(df, out="_p")
        each = [p.withColumn("_q", F.col("_p") if len(self.labels) == 1 else F.col("_p")[k]) for k in range(len(self.labels))]
        return float(np.mean([metrics.r2_score(e, c, "_q") for e, c in zip(each, self.labels)]))


class PLSRegression(_Cross):
    """Partial least squares; Y is deflated by the X scores."""


class CCA(_Cross):
    """Canonical correlation: weights through the pseudo-inverses of X'X and Y'Y."""

    canonical = True
