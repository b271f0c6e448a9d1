"""Gaussian components: numpy helpers for one model's few components."""

from __future__ import annotations

import numpy as np


def full(upper: list[float], d: int) -> np.ndarray:
    """Packed upper triangle to a symmetric matrix."""
    i, j = np.triu_indices(d)
    out = np.zeros((d, d))
    out[i, j] = upper
    out[j, i] = upper
    return out


def packed(matrix: np.ndarray) -> list[float]:
    i, j = np.triu_indices(matrix.shape[0])
    return [float(v) for v in matrix[i, j]]


def with_precision(c: dict) -> dict:
    """Add the packed inverse covariance, its whitening rows and the log determinant."""
    d = len(c["mu"])
    sigma = full(c["sigma"], d)
    root = np.linalg.cholesky(sigma)
    white = np.linalg.inv(root)
    c["prec"] = packed(white.T @ white)
    c["white"] = [[float(v) for v in row] for row in white]
    c["logdet"] = float(2.0 * np.log(np.diag(root)).sum())
    return c


def component(id_: int, tau: float, c: float, mu, sigma: np.ndarray, label: int) -> dict:
    mu = [float(v) for v in mu]
    return {"id": int(id_), "tau": float(tau), "c": float(c), "mu": mu, "sigma": packed(sigma), "label": int(label)}


def divergence(a: dict, b: dict) -> float:
    """Kullback-Leibler divergence of ``a`` from ``b``."""
    d = len(a["mu"])
    s1, s2 = full(a["sigma"], d), full(b["sigma"], d)
    gap = np.array(b["mu"]) - np.array(a["mu"])
    inv2 = np.linalg.inv(s2)
    logs = np.linalg.slogdet(s2)[1] - np.linalg.slogdet(s1)[1]
    return float(0.5 * (logs + np.trace(inv2 @ s1) + gap @ inv2 @ gap - d))


def symmetric_divergence(a: dict, b: dict) -> float:
    return 0.5 * (divergence(a, b) + divergence(b, a))


def nearest_partners(comps: list[dict]) -> list[tuple[int, int, float]]:
    """For each component the closest one of its label with a larger id: ``(id, id2, skld)``."""
    out = []
    for a in comps:
        near = [(symmetric_divergence(a, b), b["id"]) for b in comps if b["id"] > a["id"] and b["label"] == a["label"]]
        if near and a["label"] != 0:
            skld, other = min(near)
            out.append((a["id"], other, skld))
    return out


def free_id(used: set[int]) -> int:
    """The smallest id not taken."""
    i = 0
    while i in used:
        i += 1
    return i


def adopt(comps: list[dict], labels: dict[int, int]) -> list[dict]:
    """Unlabelled components take the label of their earliest row."""
    return [{**c, "label": labels.get(c["id"], c["label"])} for c in comps]


def em_step(comps: list[dict], sums: dict[int, tuple[float, np.ndarray, np.ndarray]], n: int, alpha: float, jitter: float):
    """One weighted update; ``sums`` holds per id the totals of q, q x and q (x-mu)(x-mu)'."""
    if n == 0:
        return comps
    out = []
    for c in comps:
        d = len(c["mu"])
        q, qx, qxx = sums.get(c["id"], (0.0, np.zeros(d), np.zeros((d, d))))
        new = {**c, "tau": (1 - alpha) * c["tau"] + alpha * q / n, "c": c["c"] + q}
        if q > 0:
            rate = min(1.0, q * ((1 - alpha) / (c["c"] + q) + alpha / n))
            mu = np.array(c["mu"])
            move = rate * (qx / q - mu)
            sigma = (1 - rate) * full(c["sigma"], d) + rate * qxx / q - np.outer(move, move) + jitter * np.eye(d)
            new["mu"], new["sigma"] = [float(v) for v in mu + move], packed(sigma)
        out.append(new)
    return out


def create(comps: list[dict], points: list[tuple[int, list[float]]], alpha: float, most: int) -> list[dict]:
    """New unit components at ``(label, x)`` points; the rest decays once.

    When the model is full the weakest old components make room; points come
    earliest first, and no more than ``most`` can be held at all.
    """
    points = points[:most]
    if not points:
        return comps
    room = most - len(points)
    old = [{**c, "tau": (1 - alpha) * c["tau"]} for c in comps]
    kept = {c["id"] for c in sorted(old, key=lambda c: (-c["tau"], -c["id"]))[:room]}
    out = [c for c in old if c["id"] in kept]
    for label, x in points:
        id_ = free_id({c["id"] for c in out})
        out.append(component(id_, alpha, 1.0, x, np.eye(len(x)), label))
    return out


def merge_closest(comps: list[dict], below: float) -> list[dict]:
    """Join the closest pair of one label into one component with the same moments."""
    pairs = nearest_partners(comps)
    if not pairs:
        return comps
    skld, i, j = min((p[2], p[0], p[1]) for p in pairs)
    if not skld < below:
        return comps
    a = next(c for c in comps if c["id"] == i)
    b = next(c for c in comps if c["id"] == j)
    tau = a["tau"] + b["tau"]
    fa, fb = a["tau"] / tau, b["tau"] / tau
    d = len(a["mu"])
    ma, mb = np.array(a["mu"]), np.array(b["mu"])
    sigma = fa * full(a["sigma"], d) + fb * full(b["sigma"], d) + fa * fb * np.outer(ma - mb, ma - mb)
    joined = component(i, tau, a["c"] + b["c"], fa * ma + fb * mb, sigma, a["label"])
    return [c for c in comps if c["id"] not in (i, j)] + [joined]


def split_largest(comps: list[dict], above: float, share: float, most: int) -> list[dict]:
    """Cut the component of largest volume in two along its main axis."""
    if not comps or len(comps) >= most:
        return comps
    d = len(comps[0]["mu"])
    volume, neg = max((float(np.linalg.det(full(c["sigma"], d))), -c["id"]) for c in comps)
    if not volume > above:
        return comps
    big = next(c for c in comps if c["id"] == -neg)
    values, vectors = np.linalg.eigh(full(big["sigma"], d))
    axis = vectors[:, -1]
    first = axis[np.argmax(np.abs(axis) > 1e-12)]
    shift = axis * (np.sign(first) or 1.0) * np.sqrt(share * values[-1])
    sigma = full(big["sigma"], d) - np.outer(shift, shift)
    mu = np.array(big["mu"])
    other = free_id({c["id"] for c in comps})
    halves = [
        component(big["id"], big["tau"] / 2, big["c"] / 2, mu + shift, sigma, big["label"]),
        component(other, big["tau"] / 2, big["c"] / 2, mu - shift, sigma, big["label"]),
    ]
    return [c for c in comps if c["id"] != big["id"]] + halves


def normalize(comps: list[dict]) -> list[dict]:
    total = sum(c["tau"] for c in comps)
    return [{**c, "tau": c["tau"] / total} for c in comps] if total > 0 else comps
