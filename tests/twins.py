"""Plain numpy versions that queries are compared with."""

import numpy as np

from varistrata.functions import kernels


def twin_cca(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Canonical correlations by QR and SVD."""
    qx, _ = np.linalg.qr(x - x.mean(axis=0))
    qy, _ = np.linalg.qr(y - y.mean(axis=0))
    return np.linalg.svd(qx.T @ qy, compute_uv=False)


def twin_regression(x: np.ndarray, y: np.ndarray, fit: np.ndarray) -> list[tuple[float, float]]:
    """Scores on the first 1, 2, ... components, by least squares on the rows."""
    return kernels.component_regressions(x[fit], None, y[fit], (x[~fit], None, y[~fit]), cumulative=True)
