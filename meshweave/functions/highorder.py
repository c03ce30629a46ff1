"""Closest points of curved high-order elements, with a bound on the error.

Every element is taken as a tensor-product polynomial over the unit cube of its dimension: simplices, prisms and
pyramids by the map that collapses a side. In Bernstein form the control points of a part of the element enclose it, and
halving a part gives the control points of both halves.
"""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np

from meshweave.functions import shapes

DIMENSIONS = {"ho_edge": 1, "ho_tria": 2, "ho_quad": 2, "ho_tetra": 3, "ho_hexa": 3, "ho_prism": 3, "ho_pyram": 3}
#: Results are within this share of the element's size of the least distance.
PRECISION = 1e-7
#: Parts that are looked at together, which bounds the memory of a batch of any size.
TOGETHER = 4096


def collapsed(kind: str, c: np.ndarray) -> np.ndarray:
    """The parameters (n, 3) of an element at places `c` (n, dimension) of the unit cube."""
    u = np.zeros((len(c), 3))
    u[:, : c.shape[1]] = c
    if kind in ("ho_tria", "ho_tetra", "ho_prism"):
        u[:, 1] *= 1 - u[:, 0]
        if kind == "ho_tetra":
            u[:, 2] *= (1 - c[:, 0]) * (1 - c[:, 1])
    if kind == "ho_pyram":
        u[:, :2] *= 1 - c[:, 2:]
    return u


def bernstein(n: int, t: np.ndarray) -> np.ndarray:
    return np.stack([comb(n, i) * t**i * (1 - t) ** (n - i) for i in range(n + 1)], axis=-1)


@cache
def to_control(kind: str, order: int) -> np.ndarray:
    """The matrix from the nodes of an element to its control points, ((order + 1) ** dimension, nodes)."""
    d, t = DIMENSIONS[kind], np.linspace(0, 1, order + 1) if order else np.zeros(1)
    grid = np.stack(np.meshgrid(*[t] * d, indexing="ij"), axis=-1).reshape(-1, d)
    one = np.linalg.inv(bernstein(order, t))
    whole = np.ones((1, 1))
    for _ in range(d):
        whole = np.kron(whole, one)
    return whole @ shapes.ho_basis(kind, order, collapsed(kind, grid))


@cache
def halves(order: int) -> tuple[np.ndarray, np.ndarray]:
    """The matrices from the control points along an axis to those of its lower and of its upper half."""
    low = np.array([[comb(i, j) / 2**i if j <= i else 0 for j in range(order + 1)] for i in range(order + 1)])
    return low, low[::-1, ::-1]


def halved(control: np.ndarray, axis: int, order: int, d: int) -> np.ndarray:
    """(parts, halves, control points, 3): both halves of each part along an axis of the cube."""
    shaped = np.moveaxis(control.reshape(-1, *[order + 1] * d, 3), 1 + axis, -1)
    both = [np.moveaxis(shaped @ m.T, -1, 1 + axis).reshape(control.shape) for m in halves(order)]
    return np.stack(both, axis=1)


def least_distance(p: np.ndarray, control: np.ndarray) -> np.ndarray:
    """No point enclosed by the control points of a part is closer to its point than this: by their box, and by the plane
    across the line to their middle and to their nearest."""
    gap = np.maximum(np.maximum(control.min(axis=1) - p, p - control.max(axis=1)), 0)
    bound = np.sqrt((gap**2).sum(axis=1))
    away = p[:, None] - control
    near = ((away**2).sum(axis=2)).argmin(axis=1)
    for way in (p - control.mean(axis=1), away[np.arange(len(p)), near]):
        size = np.sqrt((way**2).sum(axis=1, keepdims=True))
        unit = np.divide(way, size, out=np.zeros_like(way), where=size > 0)
        bound = np.maximum(bound, np.einsum("nck,nk->nc", away, unit).min(axis=1))
    return bound


def located(kind: str, order: int, p: np.ndarray, v: np.ndarray, within: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(weights, closest point, squared distance, parameters) of points (n, 3) and elements (n, nodes, 3).

    Descent from the nearest of a net of places gives a distance that is nearly always the least. It is then proven or improved: parts of
    the element whose control points allow nothing closer, beyond PRECISION, go; others are halved, and their corners,
    which lie on the element, are where descent starts again if one is closer than what is known. Parts are kept on a
    stack, the nearest on top, so memory does not depend on how many there are in all. Points known to be farther than
    `within` (n) from their element get the weights of its first node.
    """
    d = DIMENSIONS[kind]
    if within is not None and order:
        full = np.einsum("cm,nmk->nck", to_control(kind, order), v)
        far = least_distance(p, full) > within
        if far.any():
            m = v.shape[1]
            out = np.tile(np.eye(m)[0], (len(p), 1)), v[:, 0].copy(), shapes.dot(p - v[:, 0], p - v[:, 0]), np.zeros((len(p), 3))
            if not far.all():
                for whole, made in zip(out, located(kind, order, p[~far], v[~far], within[~far]), strict=True):
                    whole[~far] = made
            return out
    weights, near, d2, u = shapes.ho_located(kind, order, p, v, starts_from=1)
    size = np.maximum(np.ptp(v, axis=1).max(axis=1, initial=0), 1e-300)
    best, u = np.sqrt(d2), u.copy()
    slack = PRECISION * size
    rows = np.flatnonzero(best > slack)
    if not len(rows) or not order:
        return weights, near, d2, u
    control = np.einsum("cm,nmk->nck", to_control(kind, order), v[rows])
    # rows, control points, lower corner in the cube, halvings so far of each axis
    stack = [(rows[k : k + TOGETHER], control[k : k + TOGETHER], np.zeros((len(rows[k : k + TOGETHER]), d)), np.zeros((len(rows[k : k + TOGETHER]), d), int)) for k in range(0, len(rows), TOGETHER)]
    corners = np.stack(np.meshgrid(*[[0, order]] * d, indexing="ij"), axis=-1).reshape(-1, d)
    corner_places = np.ravel_multi_index(tuple(corners.T), [order + 1] * d)
    improved = np.zeros(len(p), bool)
    while stack:
        row, c, low, cuts = stack.pop()
        bound = least_distance(p[row], c)
        least = best[row] if within is None else np.minimum(best[row], within[row] * (1 + 1e-9) + 2 * slack[row])
        open_ = (bound < least - slack[row]) & (cuts.sum(axis=1) < 40 * d)
        row, c, low, cuts, bound = row[open_], c[open_], low[open_], cuts[open_], bound[open_]
        if not len(row):
            continue
        at = np.sqrt(((c[:, corner_places] - p[row][:, None]) ** 2).sum(axis=2))
        nearest = at.argmin(axis=1)
        closer = at[np.arange(len(row)), nearest]
        better = np.flatnonzero(closer < best[row] - slack[row] / 4)
        if len(better):
            # of each point the closest corner
            first = better[np.lexsort([closer[better], row[better]])]
            first = first[np.unique(row[first], return_index=True)[1]]
            own = row[first]
            place = low[first] + (corners[nearest[first]] / order) / 2.0 ** cuts[first]
            w2, n2, d22, u2 = shapes.ho_located(kind, order, p[own], v[own], start=collapsed(kind, place))
            weights[own], near[own], d2[own], u[own] = w2, n2, d22, u2
            best[own], improved[own] = np.sqrt(d22), True
        # the widest axis of the control points is cut, the nearest parts come on top
        axis = cuts.argmin(axis=1)
        for a in np.unique(axis):
            mine = np.flatnonzero(axis == a)
            both = halved(c[mine], a, order, d)
            deeper = cuts[mine] + (np.arange(d) == a)
            up = low[mine] + (np.arange(d) == a) / 2.0 ** deeper
            made = (np.r_[row[mine], row[mine]], np.concatenate([both[:, 0], both[:, 1]]), np.concatenate([low[mine], up]), np.concatenate([deeper, deeper]))
            order_by = np.argsort(-np.r_[bound[mine], bound[mine]], kind="stable")
            for k in range(0, len(order_by), TOGETHER):
                some = order_by[k : k + TOGETHER]
                stack.append(tuple(x[some] for x in made))
    return weights, near, d2, u


@cache
def reach(kind: str, order: int) -> float:
    """How far, at most, an element goes from the middle of its nodes' box, as a multiple of the box's half: the sum of
    the sizes of its basis functions, bounded by the control points of a fine net of parts."""
    d = DIMENSIONS[kind]
    control = to_control(kind, order).T[:, :, None].repeat(3, axis=2)  # each basis function as a polynomial
    for _ in range(4):
        for a in range(d):
            both = halved(control, a, order, d)
            control = np.concatenate([both[:, 0], both[:, 1]])  # the functions of a part stay together
    parts = len(control) // to_control(kind, order).shape[1]
    largest = np.abs(control[:, :, 0]).max(axis=1)
    return float(largest.reshape(parts, -1).sum(axis=1).max()) if order > 1 else 1.0
