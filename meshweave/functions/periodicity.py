"""Periodic transforms: a group of affine moves, each with the one that undoes it, and their combinations."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshweave.functions.geometry import transformed


def images_of(transforms: dict[int, np.ndarray]) -> Column:
    """An array of (tr_id, x, y, z): where each transform takes the point x, y, z of a row."""
    axes = "xyz"
    return F.array(*(F.struct(F.lit(i).alias("tr_id"), *(c.alias(a) for a, c in zip(axes, transformed(*(F.col(a) for a in axes), m), strict=True))) for i, m in transforms.items()))


@dataclass(frozen=True)
class Transform:
    """One move: its matrix of three rows of four, the number that its maker gave (negative for the way back), the id
    that undoes it, those it is composed of, how often others were combined, and the first id that does the same."""

    kind: str
    matrix: np.ndarray
    external: int | None
    reverse: int
    parents: tuple[int, int] | None
    level: int
    same_as: int


@dataclass
class Periodicity:
    """Transforms by id, from 0. Every one that is added brings its reverse; combined() adds what two or three of them
    do one after the other. Moves that differ by no more than `tolerance` in any number are equivalent."""

    tolerance: float = 1e-9
    known: list[Transform] = field(default_factory=list)

    @staticmethod
    def _square(m: np.ndarray) -> np.ndarray:
        return np.vstack([m, [0, 0, 0, 1]])

    def _first(self, matrix: np.ndarray, at: int) -> int:
        return next((i for i, x in enumerate(self.known) if np.abs(x.matrix - matrix).max() <= self.tolerance), at)

    def _pair(self, kind: str, there: np.ndarray, external: int | None, parents: tuple[tuple[int, int] | None, tuple[int, int] | None], level: int) -> int:
        back, at = np.linalg.inv(self._square(there))[:3], len(self.known)
        self.known.append(Transform(kind, there, external, at + 1, parents[0], level, self._first(there, at)))
        self.known.append(Transform(kind, back, None if external is None else -external, at, parents[1], level, self._first(back, at + 1)))
        return at

    def add(self, matrix, external: int, kind: str = "mixed") -> int:
        """A move by its matrix (three rows of four), whose rotation must keep lengths; the id it has from now on."""
        made = np.asarray(matrix, float)
        if made.shape != (3, 4) or np.abs(made[:, :3] @ made[:, :3].T - np.eye(3)).max() > 1e-6:
            raise ValueError("a periodic transform is a rotation and a shift: three rows of four numbers")
        if any(x.level for x in self.known):
            raise ValueError("transforms are added before they are combined")
        return self._pair(kind, made, external, (None, None), 0)

    def add_translation(self, shift: tuple[float, float, float], external: int) -> int:
        return self.add(np.hstack([np.eye(3), np.reshape(np.asarray(shift, float), (3, 1))]), external, "translation")

    def add_rotation(self, degrees: float, axis: tuple[float, float, float], through: tuple[float, float, float], external: int) -> int:
        """A turn about the line along `axis` through a point."""
        u = np.asarray(axis, float)
        u = u / np.linalg.norm(u)
        cross = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
        a = np.radians(degrees)
        turn = np.cos(a) * np.eye(3) + np.sin(a) * cross + (1 - np.cos(a)) * np.outer(u, u)
        p = np.asarray(through, float)
        return self.add(np.hstack([turn, (p - turn @ p)[:, None]]), external, "rotation")

    def combined(self) -> None:
        """Add all combinations of two transforms (level 1) and of three (level 2) of different origin. Of those that do
        the same, also as one already known, one is kept; its way back comes with it, by the same two in turn."""
        if any(x.level for x in self.known):
            raise ValueError("the transforms are combined already")
        for level in (1, 2):
            base = len(self.known)
            for a in range(base):
                for b in range(base):
                    x, y = self.known[a], self.known[b]
                    if x.level != level - 1 or y.level or self.origins(b) & self.origins(a):
                        continue
                    made = (self._square(y.matrix) @ self._square(x.matrix))[:3]
                    still = np.abs(made - np.eye(4)[:3]).max() <= self.tolerance
                    if not still and self._first(made, -1) < 0:
                        self._pair("translation" if {x.kind, y.kind} == {"translation"} else "mixed", made, None, ((a, b), (y.reverse, x.reverse)), level)

    def origins(self, i: int) -> frozenset[int]:
        """The external numbers, without sign, that a transform is made of."""
        x = self.known[i]
        return frozenset([abs(x.external)]) if x.parents is None else self.origins(x.parents[0]) | self.origins(x.parents[1])

    def components(self, i: int) -> tuple[int, ...]:
        """The added transforms that a transform does, in their order."""
        x = self.known[i]
        return (i,) if x.parents is None else self.components(x.parents[0]) + self.components(x.parents[1])

    def transforms(self, level: int | None = None) -> dict[int, np.ndarray]:
        """The matrices by id, of one level or of all; of equivalent ones the first."""
        return {i: x.matrix for i, x in enumerate(self.known) if x.same_as == i and level in (None, x.level)}

    def reverse(self, i: int) -> int:
        """The id that undoes a transform; the first of those that do."""
        return self.known[self.known[i].reverse].same_as

    def id_of(self, external: int) -> int:
        return next(i for i, x in enumerate(self.known) if x.external == external)
