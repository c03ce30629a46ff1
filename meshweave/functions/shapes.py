"""Numpy kernels: positions, weights and measures of elements, for batches of (point, element) pairs.

Points are (n, 3), element vertices (n, m, 3). Every locating kernel gives weights (n, m), projections (n, 3), squared
distances (n,) and parameters (n, 3); the weights sum to one and reproduce linear fields at the projection.
"""

from __future__ import annotations

import json

import numpy as np

#: Corner parameters of the volume elements, in the numbering of the element tables.
CORNERS = {
    "prism6": np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [0, 1, 1]], float),
    "hexa8": np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1], [0, 1, 1]], float),
}
#: The faces of each standard cell, outward, by places of its vertices.
FACES = {
    "tetra4": [[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]],
    "pyram5": [[0, 3, 2, 1], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]],
    "prism6": [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]],
    "hexa8": [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]],
}
N_VERTICES = {"node": 1, "edge2": 2, "tria3": 3, "quad4": 4, "tetra4": 4, "pyram5": 5, "prism6": 6, "hexa8": 8}


def faces_of(kind: str, faces: str | None) -> list[list[int]]:
    """The faces of a standard cell, or those given (as JSON)."""
    return FACES.get(kind) or json.loads(faces)


#: How many faces of three and of four corners a standard cell has, and how many corners its base.
SIDES = {"tetra4": (4, 0, 3), "pyram5": (4, 1, 4), "prism6": (2, 3, 3), "hexa8": (0, 6, 4)}


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where lists laid end to end begin, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def from_faces(n_faces: np.ndarray, sizes: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells from their outward faces, all laid end to end: `n_faces` of each cell, `sizes` of each face, `corners` in turn.

    (kind, n_vertices, vertices, places): the place in SIDES of each cell's type, -1 for a polyhedron; how many vertices it
    has; these end to end, as mesh.from_cell_faces() orders them; the place of every corner among the cell's vertices
    in order of number. Cells with equal counts of faces are walked together.
    """
    n, face_at = len(n_faces), starts_of(n_faces)
    first, cell = starts_of(sizes), np.repeat(np.arange(n), n_faces)
    owner = np.repeat(cell, sizes)
    order = np.lexsort((corners, owner))
    value, of = corners[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    n_vertices = np.bincount(of[new], minlength=n)
    vertex_at, known = starts_of(n_vertices), value[new]
    places = np.empty(len(order), np.int64)
    places[order] = np.cumsum(new) - 1 - vertex_at[of]
    following = np.arange(1, len(corners) + 1)
    whole = sizes > 0
    following[first[1:][whole] - 1] = first[:-1][whole]
    after = places[following]
    tria, quad = (np.bincount(cell[sizes == k], minlength=n) for k in (3, 4))
    kind, vertices = np.full(n, -1), known.copy()
    for code, (name, (n_tria, n_quad, b)) in enumerate(SIDES.items()):
        m = N_VERTICES[name]
        rows = np.flatnonzero((tria == n_tria) & (quad == n_quad) & (n_faces == n_tria + n_quad) & (n_vertices == m))
        if not len(rows):
            continue
        steps = first[face_at[rows]][:, None] + np.arange(3 * n_tria + 4 * n_quad)
        p, q = places[steps], after[steps]
        lowest = face_at[rows] + (sizes[face_at[rows][:, None] + np.arange(n_tria + n_quad)] == b).argmax(axis=1)
        inner = places[first[lowest][:, None] + np.arange(b)[::-1]]
        base = np.take_along_axis(inner, (inner.argmin(axis=1)[:, None] + np.arange(b)) % b, axis=1)
        at_p, at_q = (x[:, :, None] == base[:, None] for x in (p, q))
        if m == b + 1:
            top = m * (m - 1) // 2 - base.sum(axis=1, keepdims=True)  # the one that the base leaves
        else:
            away = at_p.any(axis=2) != at_q.any(axis=2)
            meets = away[..., None] & (at_p | at_q)
            step = meets.argmax(axis=1)
            far = np.where(np.take_along_axis(p, step, axis=1) == base, np.take_along_axis(q, step, axis=1), np.take_along_axis(p, step, axis=1))
            top = np.where(meets.any(axis=1), far, -1)
        walk = np.concatenate([base, top], axis=1)
        closed = (np.sort(walk, axis=1) == np.arange(m)).all(axis=1)
        rows, walk = rows[closed], walk[closed]
        kind[rows] = code
        vertices[vertex_at[rows][:, None] + np.arange(m)] = known[vertex_at[rows][:, None] + walk]
    return kind, n_vertices, vertices, places


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cross products of vectors (3, n)."""
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


def fans(lengths: np.ndarray):
    """(lists, t) for t = 1, 2, ...: those of lists laid end to end that have a triangle 0, t, t + 1."""
    left, t = np.flatnonzero(lengths >= 3), 1
    while len(left):
        yield left, t
        t += 1
        left = left[lengths[left] >= t + 2]


def polygon_areas(v: np.ndarray, n_corners: np.ndarray) -> np.ndarray:
    """Vector areas (3, n) of polygons whose corners (3, corners) lie end to end."""
    first, area = starts_of(n_corners), np.zeros((3, len(n_corners)))
    for rows, t in fans(n_corners):
        at = first[rows]
        area[:, rows] += crossed(v[:, at + t] - v[:, at], v[:, at + t + 1] - v[:, at]) / 2
    return area


def cell_volumes(v: np.ndarray, apex: np.ndarray, n_faces: np.ndarray, sizes: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Volumes of cells over vertices v (3, any): signed cones of their outward faces, which lie end to end as in
    from_faces(), to each cell's `apex`; added up face by face."""
    first, by_face = starts_of(sizes), np.zeros(len(sizes))
    tip = np.repeat(apex, n_faces)
    for rows, t in fans(sizes):
        p = v[:, corners[first[rows]]]
        normal = crossed(v[:, corners[first[rows] + t]] - p, v[:, corners[first[rows] + t + 1]] - p)
        x, y, z = normal * (v[:, tip[rows]] - p)
        by_face[rows] += (x + y + z) / 6
    face_at, total, left, k = starts_of(n_faces), np.zeros(len(n_faces)), np.flatnonzero(n_faces > 0), 0
    while len(left):
        total[left] += by_face[face_at[left] + k]
        k += 1
        left = left[n_faces[left] > k]
    return -total


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=-1)


def on_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parameter in 0..1, closest point, squared distance) on the segment a-b."""
    along = b - a
    length = dot(along, along)
    t = np.clip(np.divide(dot(p - a, along), length, out=np.zeros_like(length), where=length > 0), 0, 1)
    near = a + t[..., None] * along
    return t, near, dot(p - near, p - near)


def edge(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    t, near, d2 = on_segment(p, v[:, 0], v[:, 1])
    return np.stack([1 - t, t], axis=1), near, d2, np.stack([t, 0 * t, 0 * t], axis=1)


def newell(v: np.ndarray) -> np.ndarray:
    """Twice the vector area of polygons."""
    c = v - v.mean(axis=1, keepdims=True)
    return np.cross(c, np.roll(c, -1, axis=1)).sum(axis=1)


def polygon(p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean-value coordinates on the mean plane; points outside take the weights of the closest point of the border."""
    n, m = v.shape[:2]
    normal = newell(v)
    size = np.sqrt(dot(normal, normal))
    unit = normal / np.where(size > 0, size, 1)[:, None]
    centre = v.mean(axis=1)
    first = v[:, 1] - v[:, 0]
    first = first - dot(first, unit)[:, None] * unit
    first /= np.maximum(np.sqrt(dot(first, first)), 1e-300)[:, None]
    second = np.cross(unit, first)
    flat = np.stack([np.einsum("nmk,nk->nm", v - centre[:, None], first), np.einsum("nmk,nk->nm", v - centre[:, None], second)], axis=2)
    q = np.stack([dot(p - centre, first), dot(p - centre, second)], axis=1)
    following = np.roll(flat, -1, axis=1)
    # inside: odd number of edges crossed by a ray to the right
    up = (flat[..., 1] > q[:, None, 1]) != (following[..., 1] > q[:, None, 1])
    rise = following[..., 1] - flat[..., 1]
    cross = flat[..., 0] + (q[:, None, 1] - flat[..., 1]) * np.divide(following[..., 0] - flat[..., 0], rise, out=np.zeros_like(rise), where=rise != 0)
    inside = (up & (cross > q[:, None, 0])).sum(axis=1) % 2 == 1
    t, near, d2 = on_segment(np.repeat(q[:, None], m, axis=1), flat, following)
    closest = d2.argmin(axis=1)
    rows = np.arange(n)
    eps2 = (1e-10 * np.sqrt(size)) ** 2
    border = ~inside | (d2[rows, closest] <= eps2)
    weights = np.zeros((n, m))
    k = rows[border]
    weights[k, closest[k]] += 1 - t[k, closest[k]]
    weights[k, (closest[k] + 1) % m] += t[k, closest[k]]
    k = rows[~border]
    if len(k):
        away = flat[k] - q[k][:, None]
        r = np.sqrt(dot(away, away))
        ahead = np.roll(away, -1, axis=1)
        sine = away[..., 0] * ahead[..., 1] - away[..., 1] * ahead[..., 0]
        half = np.divide(r * np.roll(r, -1, axis=1) - dot(away, ahead), sine, out=np.zeros_like(sine), where=sine != 0)
        w = (np.roll(half, 1, axis=1) + half) / r
        weights[k] = w / w.sum(axis=1, keepdims=True)
    at = np.where(border[:, None], near[rows, closest], q)
    projected = centre + at[:, :1] * first + at[:, 1:] * second
    return weights, projected, dot(p - projected, p - projected), np.concatenate([at, np.zeros((n, 1))], axis=1)


def tetra(p: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Barycentric coordinates, also of points outside."""
    frame = np.stack([v[:, 1] - v[:, 0], v[:, 2] - v[:, 0], v[:, 3] - v[:, 0]], axis=2)
    flat = np.abs(np.linalg.det(frame)) < 1e-300
    frame[flat] = np.eye(3)
    uvw = np.linalg.solve(frame, (p - v[:, 0])[..., None])[..., 0]
    uvw[flat] = np.nan
    return np.concatenate([1 - uvw.sum(axis=1, keepdims=True), uvw], axis=1)


def shape(kind: str, u: np.ndarray) -> np.ndarray:
    """Shape functions of the volume elements at parameters u (n, 3)."""
    x, y, z = u.T
    if kind == "prism6":
        return np.stack([(1 - x - y) * (1 - z), x * (1 - z), y * (1 - z), (1 - x - y) * z, x * z, y * z], axis=1)
    if kind == "hexa8":
        return np.stack([np.where(c[0], x, 1 - x) * np.where(c[1], y, 1 - y) * np.where(c[2], z, 1 - z) for c in CORNERS["hexa8"]], axis=1)
    if kind == "pyram5":  # the base's bilinear functions shrink towards the apex
        s = np.where(np.abs(1 - z) > 1e-12, 1 - z, 1e-12)
        return np.stack([(s - x) * (s - y) / s, x * (s - y) / s, x * y / s, (s - x) * y / s, z], axis=1)
    return np.concatenate([1 - u.sum(axis=1, keepdims=True), u], axis=1)


def on_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights of the corners, closest point, squared distance) on the triangles a, b, c; flat ones count by their sides."""
    u, v, w = b - a, c - a, p - a
    uu, uv, vv, wu, wv = dot(u, u), dot(u, v), dot(v, v), dot(w, u), dot(w, v)
    size = uu * vv - uv * uv
    good = size > 1e-24 * uu * vv
    safe = np.where(good, size, 1)
    s, t = (vv * wu - uv * wv) / safe, (uu * wv - uv * wu) / safe
    inner = good & (s >= 0) & (t >= 0) & (s + t <= 1)
    weights = np.stack([1 - s - t, s, t], axis=1)
    near = a + s[:, None] * u + t[:, None] * v
    d2 = np.where(inner, dot(p - near, p - near), np.inf)
    for i, j, x, y in ((0, 1, a, b), (1, 2, b, c), (2, 0, c, a)):
        along, at, far = on_segment(p, x, y)
        closer = ~inner & (far < d2)
        weights[closer] = 0
        weights[closer, i], weights[closer, j] = 1 - along[closer], along[closer]
        near[closer], d2[closer] = at[closer], far[closer]
    return weights, near, d2


def on_boundary(p: np.ndarray, v: np.ndarray, faces: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, closest point, squared distance) on the faces of cells; faces of over three corners are fans about their centre."""
    n, m = v.shape[:2]
    best_w, best, best_d2 = np.zeros((n, m)), np.zeros((n, 3)), np.full(n, np.inf)
    for face in faces:
        middle = np.zeros(m)
        middle[face] = 1 / len(face)
        if len(face) == 3:
            fans = [np.eye(m)[face]]
        else:
            fans = [np.stack([np.eye(m)[i], np.eye(m)[j], middle]) for i, j in zip(face, [*face[1:], face[0]], strict=True)]
        for fan in fans:
            w, near, d2 = on_triangle(p, *(np.einsum("m,nmk->nk", x, v) for x in fan))
            closer = d2 < best_d2
            best_w[closer], best[closer], best_d2[closer] = w[closer] @ fan, near[closer], d2[closer]
    return best_w, best, best_d2


def volume_cell(kind: str, p: np.ndarray, v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, ...]:
    """Newton's method for the parameters of a point in a standard cell, in coordinates of the cell's own size; a point
    outside takes the closest point of the faces. A cell in which the method does not arrive is taken apart into tetrahedra."""
    n = len(p)
    centre = v.mean(axis=1)
    size = np.maximum(np.sqrt(((v - centre[:, None]) ** 2).sum(axis=2)).max(axis=1, initial=0), 1e-300)
    vs, ps = (v - centre[:, None]) / size[:, None, None], (p - centre) / size[:, None]
    if kind == "tetra4":
        weights = tetra(ps, vs)
        u = weights[:, 1:].copy()
        lost = np.zeros(n, bool)
    else:
        u = np.full((n, 3), 0.3)
        for _ in range(rounds):
            gap = np.einsum("nm,nmk->nk", shape(kind, u), vs) - ps
            slope = np.stack([np.einsum("nm,nmk->nk", shape(kind, u + h) - shape(kind, u - h), vs) / 2e-6 for h in np.eye(3) * 1e-6], axis=2)
            bad = ~(np.abs(np.linalg.det(slope)) >= 1e-9)
            slope[bad] = np.eye(3)
            move = np.linalg.solve(slope, gap[..., None])[..., 0]
            u = np.clip(u - np.clip(move, -0.5, 0.5), -5, 0.999999 if kind == "pyram5" else 5)
            if not n or np.abs(move).max() < 1e-13:
                break
        weights = shape(kind, u)
        gap = np.einsum("nm,nmk->nk", weights, vs) - ps
        lost = ~(dot(gap, gap) < 1e-18)
    close = 1e-12 if kind == "tetra4" else 1e-9  # what the method reaches; such weights still give the point itself
    inside = (weights >= -close).all(axis=1) & (weights <= 1 + close).all(axis=1) & ~lost
    near, d2 = np.where(inside[:, None], p, 0.0), np.zeros(n)
    k = np.flatnonzero(~inside)
    if len(k):
        weights[k], near[k], d2[k] = on_boundary(p[k], v[k], FACES[kind])
        u[k] = np.clip(np.nan_to_num(u[k]), 0, 1)
    k = np.flatnonzero(lost)
    if len(k) and kind != "tetra4":
        in_parts, w, at = within_parts(p[k], v[k], FACES[kind])
        k = k[in_parts]
        weights[k], near[k], d2[k] = w[in_parts], at[in_parts], 0.0
    return weights, near, d2, u


def within_parts(p: np.ndarray, v: np.ndarray, faces: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inside, weights, place) by the tetrahedra between the centre of star-shaped cells and the fans about their face centres."""
    n, m = v.shape[:2]
    inside, weights = np.zeros(n, bool), np.zeros((n, m))
    best = np.full(n, np.inf)
    for face in faces:
        middle = np.zeros(m)
        middle[face] = 1 / len(face)
        for a, b in zip(face, [*face[1:], face[0]], strict=True):
            corners = np.stack([np.full(m, 1 / m), middle, np.eye(m)[a], np.eye(m)[b]])
            t = np.einsum("jm,nmk->njk", corners, v)
            size = np.maximum(np.abs(t - t[:, :1]).max(axis=(1, 2)), 1e-300)
            w = tetra((p - t[:, 0]) / size[:, None], (t - t[:, :1]) / size[:, None, None])
            out = np.where(np.isnan(w).any(axis=1), np.inf, -w.min(axis=1, initial=0))
            better = (out < 1e-10) & (out < best)
            inside |= better
            best[better], weights[better] = out[better], w[better] @ corners
    return inside, weights, np.einsum("nm,nmk->nk", weights, v)


def fans_of(m: int, faces: list[list[int]]) -> np.ndarray:
    """(triangles, 3, m): the triangles that the faces are taken as, about the middle of those of more than three corners,
    each corner as a mean of the cell's m vertices."""
    out = []
    for face in faces:
        if len(face) == 3:
            out.append(np.eye(m)[face])
        else:
            middle = np.zeros(m)
            middle[face] = 1 / len(face)
            out += [np.stack([np.eye(m)[i], np.eye(m)[j], middle]) for i, j in zip(face, [*face[1:], face[0]], strict=True)]
    return np.stack(out)


def mean_values(p: np.ndarray, v: np.ndarray, faces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(turns, weights) of points (n, 3) within cells (n, m, 3) of one set of outward faces.

    `turns` is the solid angle under which a point sees the faces, as a share of the whole: 1 inside, 0 outside, whatever
    the cell's shape. The weights are mean value coordinates on the sphere about the point; they give linear fields
    exactly in any closed cell, star-shaped or not, and mean nothing for points on the faces themselves.
    """
    fans = fans_of(v.shape[1], faces)
    weights, turns = np.zeros(v.shape[:2]), np.zeros(len(p))
    for fan in fans:
        t = np.einsum("jm,nmk->njk", fan, v) - p[:, None]
        d = np.maximum(np.sqrt(dot(t, t)), 1e-300)
        u = t / d[..., None]
        cosines = np.stack([dot(u[:, (i + 1) % 3], u[:, (i + 2) % 3]) for i in range(3)], axis=1)
        volume = np.linalg.det(u)
        turns += 2 * np.arctan2(volume, 1 + cosines.sum(axis=1))
        # the angle opposite each corner, and what the arc opposite adds to the integral of the normal over the triangle
        chord = np.stack([np.sqrt(dot(u[:, (i + 1) % 3] - u[:, (i + 2) % 3], u[:, (i + 1) % 3] - u[:, (i + 2) % 3])) for i in range(3)], axis=1)
        angle = 2 * np.arcsin(np.clip(chord / 2, 0, 1))
        normal = np.stack([np.cross(u[:, (i + 1) % 3], u[:, (i + 2) % 3]) for i in range(3)], axis=1)
        length = np.sqrt(dot(normal, normal))
        across = np.divide(angle, length, out=np.ones_like(angle), where=length > 1e-300)
        integral = (normal * across[..., None]).sum(axis=1) / 2
        # written in the corners: the share of a corner is the part of the integral along it, against the opposite plane
        seen = np.abs(volume) > 1e-14
        share = np.einsum("nik,nk->ni", normal, integral) / np.where(seen, volume, 1)[:, None] / d
        weights += np.where(seen[:, None], share, 0) @ fan
    total = weights.sum(axis=1, keepdims=True)
    return turns / (4 * np.pi), np.divide(weights, total, out=np.zeros_like(weights), where=total != 0)


def polyhedron(p: np.ndarray, v: np.ndarray, faces: list[list[int]]) -> tuple[np.ndarray, ...]:
    """Closed polyhedra of one set of outward faces, star-shaped or not: mean values inside, else the closest point of the
    faces. A face of more than three corners is a fan about its middle."""
    size = np.maximum(np.ptp(v, axis=1).max(axis=1, initial=0), 1e-300)
    weights, near, d2 = on_boundary(p, v, faces)
    k = np.flatnonzero(d2 > (1e-9 * size) ** 2)
    if len(k):
        turns, inner = mean_values((p[k] - v[k].mean(axis=1)) / size[k, None], (v[k] - v[k].mean(axis=1, keepdims=True)) / size[k, None, None], faces)
        inside = np.abs(turns) > 0.5
        weights[k[inside]], near[k[inside]], d2[k[inside]] = inner[inside], p[k[inside]], 0.0
    return weights, near, d2, np.zeros((len(p), 3))


def located(kind: str, p: np.ndarray, v: np.ndarray, faces: list[list[int]] | None = None) -> tuple[np.ndarray, ...]:
    if kind == "node":
        return np.ones((len(p), 1)), v[:, 0], dot(p - v[:, 0], p - v[:, 0]), np.zeros((len(p), 3))
    if kind == "edge2":
        return edge(p, v)
    if kind in ("tria3", "quad4", "poly2d"):
        return polygon(p, v)
    if kind == "poly3d":
        return polyhedron(p, v, faces)
    return volume_cell(kind, p, v)


def lagrange(order: int, u: np.ndarray) -> np.ndarray:
    """The one-dimensional basis of equidistant nodes, (n, order + 1)."""
    nodes = np.arange(order + 1) / order if order else np.zeros(1)
    out = np.ones((len(u), order + 1))
    for i in range(order + 1):
        for j in range(order + 1):
            if i != j:
                out[:, i] *= (u - nodes[j]) / (nodes[i] - nodes[j])
    return out


def ho_nodes(kind: str, order: int) -> list[tuple[int, int, int]]:
    """Node indices (i, j, k) of a high-order element, i fastest: the default ordering."""
    n, flat = range(order + 1), kind in ("ho_edge", "ho_tria", "ho_quad")
    keep = {
        "ho_edge": lambda i, j, k: j == 0, "ho_tria": lambda i, j, k: i + j <= order, "ho_quad": lambda i, j, k: True, "ho_tetra": lambda i, j, k: i + j + k <= order,
        "ho_hexa": lambda i, j, k: True, "ho_prism": lambda i, j, k: i + j <= order, "ho_pyram": lambda i, j, k: i <= order - k and j <= order - k,
    }[kind]
    return [(i, j, k) for k in ([0] if flat else n) for j in n for i in n if keep(i, j, k)]


def ho_basis(kind: str, order: int, u: np.ndarray) -> np.ndarray:
    """Nodal basis at parameters u (n, 3), by inverting the monomials that the element spans at its nodes."""
    if kind in ("ho_quad", "ho_hexa", "ho_edge"):
        axes = {"ho_edge": 1, "ho_quad": 2, "ho_hexa": 3}[kind]
        parts = [lagrange(order, u[:, a]) for a in range(axes)]
        whole = parts[0]
        for part in parts[1:]:  # i fastest
            whole = (part[:, :, None] * whole[:, None, :]).reshape(len(u), -1)
        return whole

    nodes = np.array(ho_nodes(kind, order), float) / max(order, 1)

    def monomials(x: np.ndarray) -> np.ndarray:
        if kind == "ho_prism":
            return np.stack([x[:, 0] ** i * x[:, 1] ** j * x[:, 2] ** k for i, j, k in ho_nodes(kind, order)], axis=1)
        if kind == "ho_pyram":
            s = np.where(np.abs(1 - x[:, 2]) > 1e-12, 1 - x[:, 2], 1e-12)
            return np.stack([(x[:, 0] / s) ** i * (x[:, 1] / s) ** j * s ** (order - k) if max(i, j) <= order - k else 0 * s for i, j, k in ho_nodes(kind, order)], axis=1)
        return np.stack([x[:, 0] ** i * x[:, 1] ** j * x[:, 2] ** k for i, j, k in ho_nodes(kind, order)], axis=1)

    return np.linalg.solve(monomials(nodes).T, monomials(u).T).T


def ho_located(kind: str, order: int, p: np.ndarray, v: np.ndarray, levels: int = 40, starts_from: int = 4, start: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """A point of a high-order element to which no other nearby is closer: damped Gauss-Newton steps from the
    `starts_from` nearest places of a grid of parameters, of which the best result counts, or from `start` (n, 3)
    alone. highorder.located() proves it or finds a closer one."""
    axes = {"ho_edge": 1, "ho_tria": 2, "ho_quad": 2}.get(kind, 3)
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 2 * order + 3)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    full = np.zeros((len(grid), 3))
    full[:, :axes] = grid

    def into(u: np.ndarray) -> np.ndarray:
        u = np.clip(u, 0, 1)
        if kind in ("ho_tria", "ho_tetra", "ho_prism"):
            side = u[:, : 2 if kind == "ho_prism" else axes]
            side /= np.maximum(1, side.sum(axis=1, keepdims=True))
        if kind == "ho_pyram":
            u[:, :2] = np.minimum(u[:, :2], 1 - u[:, 2:])
        return u

    if start is not None:
        begins = [into(start.copy())]
    else:
        full = into(full)
        starts = np.einsum("gm,nmk->ngk", ho_basis(kind, order, full), v)
        near_first = ((starts - p[:, None]) ** 2).sum(axis=2).argsort(axis=1)[:, :starts_from]
        begins = [full[near_first[:, k]].copy() for k in range(near_first.shape[1])]
    lower = lambda u, rows: ((np.einsum("nm,nmk->nk", ho_basis(kind, order, u), v[rows]) - p[rows]) ** 2).sum(axis=1)

    def descended(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = lower(u, slice(None))
        left = np.arange(len(u))  # those that the last step still brought closer, beyond rounding
        for _ in range(levels):
            at, own = u[left], v[left]
            gap = p[left] - np.einsum("nm,nmk->nk", ho_basis(kind, order, at), own)
            slope = np.stack([np.einsum("nm,nmk->nk", ho_basis(kind, order, at + h) - ho_basis(kind, order, at - h), own) / 2e-6 for h in np.eye(3)[:axes] * 1e-6], axis=2)
            move = np.zeros_like(at)
            move[:, :axes] = np.einsum("nak,nk->na", np.linalg.pinv(slope), gap)
            known, moved = best[left], np.zeros(len(left), bool)
            for scale in (1.0, 0.5, 0.1):
                tried = into(at + scale * move)
                made = lower(tried, left)
                better = made < known * (1 - 1e-15) - 1e-30
                at[better], known[better] = tried[better], made[better]
                moved |= better
            u[left], best[left] = at, known
            left = left[moved]
            if not len(left):
                break
        return u, best

    u, best = descended(begins[0])
    for begin in begins[1:]:
        other, made = descended(begin)
        better = made < best
        u[better], best[better] = other[better], made[better]
    weights = ho_basis(kind, order, u)
    near = np.einsum("nm,nmk->nk", weights, v)
    return weights, near, dot(p - near, p - near), u


def ear_clip(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles (places) of a simple polygon (m, 2), convex or not, by cutting ears off; the turn of the input stays."""
    places = list(range(len(flat)))
    x, y = flat.T
    turn = 1.0 if float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) >= 0 else -1.0

    def side(a: int, b: int, c: int) -> float:
        return turn * float((flat[b, 0] - flat[a, 0]) * (flat[c, 1] - flat[a, 1]) - (flat[b, 1] - flat[a, 1]) * (flat[c, 0] - flat[a, 0]))

    out = []
    while len(places) > 3:
        ears = []
        for k, b in enumerate(places):
            a, c = places[k - 1], places[(k + 1) % len(places)]
            size = side(a, b, c)
            others = [p for p in places if p not in (a, b, c)]
            if size > 0 and not any(min(side(a, b, p), side(b, c, p), side(c, a, p)) >= 0 for p in others):
                ears.append((size, k, a, b, c))
        if not ears:  # nothing but flat corners are left: cut the flattest
            k = min(range(len(places)), key=lambda k: abs(side(places[k - 1], places[k], places[(k + 1) % len(places)])))
            ears = [(0.0, k, places[k - 1], places[k], places[(k + 1) % len(places)])]
        _, k, a, b, c = max(ears)
        out.append((a, b, c))
        del places[k]
    return [*out, tuple(places)] if len(places) == 3 else out


#: Overlaps of at most this share of the smaller cell are rounding: the cells only touch.
NOTHING = 1e-13


def in_circle(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> float:
    """Positive where `d` lies within the circle through the counter-clockwise corners `a`, `b`, `c` of the plane."""
    m = np.array([[*(p - d), ((p - d) ** 2).sum()] for p in (a, b, c)])
    return float(np.linalg.det(m))


def delaunay(flat: np.ndarray, triangles: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """`triangles` (counter-clockwise, as of ear_clip()) over the corners `flat` (m, 2), with inner edges flipped until
    none has the opposite corner of its neighbour in the circle of its own triangle.

    Every edge knows its triangles; an edge that is flipped puts the four around it back on the list. A flip lowers the
    surface lifted onto a paraboloid, so the loop ends; circles through four corners count as flipped already.
    """
    size = max(np.ptp(flat, axis=0).max(initial=0.0), 1e-300)
    p, made = (flat - flat.mean(axis=0)) / size, [tuple(t) for t in triangles]
    owner: dict[tuple[int, int], int] = {(t[i], t[(i + 1) % 3]): k for k, t in enumerate(made) for i in range(3)}
    waiting = [e for e in owner if e[0] < e[1] and e[::-1] in owner]
    while waiting:
        a, b = waiting.pop()
        if (a, b) not in owner or (b, a) not in owner:
            continue
        k, n = owner[a, b], owner[b, a]
        c, d = (next(v for v in made[t] if v not in (a, b)) for t in (k, n))
        turn = lambda x, y, z: float((p[y] - p[x])[0] * (p[z] - p[x])[1] - (p[y] - p[x])[1] * (p[z] - p[x])[0])
        if in_circle(p[a], p[b], p[c], p[d]) <= 1e-12 or turn(c, d, b) <= 0 or turn(d, c, a) <= 0:
            continue
        del owner[a, b], owner[b, a]
        made[k], made[n] = (c, d, b), (d, c, a)
        for t in (k, n):
            owner |= {(made[t][i], made[t][(i + 1) % 3]): t for i in range(3)}
        waiting += [(a, d), (d, b), (b, c), (c, a)]
    return made


def clipped_areas(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Areas (n,) of the triangles `subject` (n, 3, 2) within the counter-clockwise triangles `window` (n, 3, 2)."""
    n = len(subject)
    points, count = subject, np.full(n, 3)
    for k in range(3):
        m = points.shape[1]
        if not n or not m:
            return np.zeros(n)
        a, b = window[:, k, None], window[:, (k + 1) % 3, None]
        side = (b[..., 0] - a[..., 0]) * (points[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (points[..., 0] - a[..., 0])
        real = np.arange(m) < count[:, None]
        after = np.where(np.arange(m) + 1 < count[:, None], np.arange(m) + 1, 0)
        ahead = np.take_along_axis(side, after, axis=1)
        following = np.take_along_axis(points, after[..., None], axis=1)
        crossing = real & ((side > 0) & (ahead < 0) | (side < 0) & (ahead > 0))
        share = np.divide(side, side - ahead, out=np.zeros_like(side), where=crossing)
        made = np.stack([points, points + share[..., None] * (following - points)], axis=2).reshape(n, 2 * m, 2)
        kept = np.stack([real & (side >= 0), crossing], axis=2).reshape(n, 2 * m)
        order = np.argsort(~kept, axis=1, kind="stable")
        count = kept.sum(axis=1)
        points = np.take_along_axis(made, order[..., None], axis=1)[:, : count.max(initial=0)]
    m = points.shape[1]
    if not m:
        return np.zeros(n)
    full = [0.5 * np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 2, 0] - t[:, 0, 0]) * (t[:, 1, 1] - t[:, 0, 1])) for t in (subject, window)]
    x, y = (np.where(np.arange(m) < count[:, None], points[..., i], points[:, :1, i]) for i in (0, 1))
    made = 0.5 * np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1))
    return np.where(made > NOTHING * np.minimum(*full), made, 0.0)


def clip_tetras(tetras: np.ndarray, owner: np.ndarray, point: np.ndarray, normal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of tetrahedra (n, 4, 3) on the inner side of their owners' planes (point, outward normal), with their owners."""
    side = np.einsum("njk,nk->nj", tetras - point[owner][:, None], normal[owner])
    order = np.argsort(side > 0, axis=1, kind="stable")  # inner corners first
    t, side = np.take_along_axis(tetras, order[..., None], axis=1), np.take_along_axis(side, order, axis=1)
    inner = (side <= 0).sum(axis=1)
    parts, owners = [t[inner == 4]], [owner[inner == 4]]

    def cut(k: np.ndarray, i: int, j: int) -> np.ndarray:
        return t[k, i] + (t[k, j] - t[k, i]) * (side[k, i] / (side[k, i] - side[k, j]))[:, None]

    for many, pieces in (
        (1, lambda c, k: [[t[k, 0], c(0, 1), c(0, 2), c(0, 3)]]),
        (2, lambda c, k: [[t[k, 0], c(0, 2), c(0, 3), t[k, 1]], [c(0, 2), c(0, 3), t[k, 1], c(1, 3)], [c(0, 2), t[k, 1], c(1, 2), c(1, 3)]]),
        (3, lambda c, k: [[t[k, 0], t[k, 1], t[k, 2], c(0, 3)], [t[k, 1], t[k, 2], c(0, 3), c(1, 3)], [t[k, 2], c(0, 3), c(1, 3), c(2, 3)]]),
    ):
        k = np.flatnonzero(inner == many)
        for piece in pieces(lambda i, j, k=k: cut(k, i, j), k) if len(k) else ():
            parts.append(np.stack(piece, axis=1))
            owners.append(owner[k])
    return np.concatenate(parts), np.concatenate(owners)


def tetra_volumes(t: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.det(t[:, 1:] - t[:, :1])) / 6 if len(t) else np.zeros(0)


def to_tetras(v: np.ndarray, faces: list[list[int]]) -> np.ndarray:
    """Star-shaped cells (n, m, 3) of one set of faces as tetrahedra (n, parts, 4, 3) about their centres; tetrahedra stay."""
    if v.shape[1] == 4:
        return v[:, None]
    centre, out = v.mean(axis=1), []
    for face in faces:
        if len(face) == 3:
            out.append(np.stack([centre, *(v[:, i] for i in face)], axis=1))
        else:
            middle = v[:, face].mean(axis=1)
            out += [np.stack([centre, middle, v[:, a], v[:, b]], axis=1) for a, b in zip(face, [*face[1:], face[0]], strict=True)]
    return np.stack(out, axis=1)


def outer_planes(v: np.ndarray, faces: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, outward normals, convex) of the faces of cells (n, m, 3): convex cells have flat faces with all corners behind them."""
    middle = v.mean(axis=1)
    points = np.stack([v[:, f].mean(axis=1) for f in faces], axis=1)
    normals = np.stack([newell(v[:, f]) for f in faces], axis=1)
    size = np.sqrt(dot(normals, normals))
    normals = normals / np.maximum(size, 1e-300)[..., None]
    normals *= np.where(dot(normals, points - middle[:, None]) < 0, -1, 1)[..., None]
    scale = np.abs(v - middle[:, None]).max(axis=(1, 2))
    above = np.einsum("nfk,nfmk->nfm", normals, v[:, None] - points[:, :, None]).max(axis=(1, 2))
    flat = np.stack([np.abs(np.einsum("nk,nmk->nm", normals[:, i], v[:, f] - points[:, i, None])).max(axis=1) for i, f in enumerate(faces)], axis=1).max(axis=1)
    return points, normals, (above <= 1e-12 * scale) & (flat <= 1e-12 * scale) & (size > 0).all(axis=1)


def overlap_volumes(a: np.ndarray, fa: list[list[int]], b: np.ndarray, fb: list[list[int]]) -> np.ndarray:
    """Common volumes of pairs of star-shaped cells, convex or not."""
    n = len(a)
    points, normals, convex = outer_planes(b, fb)
    out = np.zeros(n)

    def clipped(tetras: np.ndarray, owner: np.ndarray, points: np.ndarray, normals: np.ndarray, pair: np.ndarray) -> None:
        for k in range(points.shape[1]):
            tetras, owner = clip_tetras(tetras, owner, points[:, k], normals[:, k])
        np.add.at(out, pair[owner], tetra_volumes(tetras))

    parts = to_tetras(a, fa)
    k = np.flatnonzero(convex)
    clipped(parts[k].reshape(-1, 4, 3), np.repeat(np.arange(len(k)), parts.shape[1]), points[k], normals[k], k)
    k = np.flatnonzero(~convex)
    others = to_tetras(b[k], fb)
    for i in range(others.shape[1] if len(k) else 0):
        p, q, _ = outer_planes(others[:, i], FACES["tetra4"])
        clipped(parts[k].reshape(-1, 4, 3), np.repeat(np.arange(len(k)), parts.shape[1]), p, q, k)
    full = [tetra_volumes(to_tetras(x, f).reshape(-1, 4, 3)).reshape(n, -1).sum(axis=1) for x, f in ((a, fa), (b, fb))]
    return np.where(out > NOTHING * np.minimum(*full), out, 0.0)
