"""Elements of a slide, their roles, and the transforms between coordinate systems."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("points", "shapes", "images", "labels", "tables")
#: Which kind of boundaries counts first when none is named. Fixed values.
BOUNDARY_PRIORITY = ("proseg", "baysor", "stardist", "comseg", "cellpose")


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    matrix: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)

    @classmethod
    def scale(cls, sx: float, sy: float | None = None) -> Affine:
        return cls((sx, 0.0, 0.0, 0.0, sx if sy is None else sy, 0.0))

    @classmethod
    def shift(cls, dx: float, dy: float) -> Affine:
        return cls((1.0, 0.0, dx, 0.0, 1.0, dy))

    @classmethod
    def from_array(cls, matrix, axes: str = "xy") -> Affine:
        """From a square matrix over ``axes`` plus one; an axis besides x and y must not mix with them."""
        m = np.asarray(matrix, float)
        keep = [axes.index("x"), axes.index("y")]
        other = [i for i in range(len(axes)) if i not in keep]
        if any(m[i, j] or m[j, i] for i in other for j in keep):
            raise ValueError("an axis that is dropped must not be coupled with x or y")
        at = [*keep, len(axes)]
        r = m[np.ix_(at, at)]
        return cls(tuple(float(v) for v in r[:2].ravel()))

    def array(self) -> np.ndarray:
        return np.array([*self.matrix, 0, 0, 1], float).reshape(3, 3)

    def then(self, other: Affine) -> Affine:
        return Affine.from_array(other.array() @ self.array())

    def inverse(self) -> Affine:
        return Affine.from_array(np.linalg.inv(self.array()))

    @property
    def identity(self) -> bool:
        return bool(np.array_equal(self.array(), np.eye(3)))

    def points(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        if self.identity:
            return df
        a, b, c, d, e, f = (F.lit(v) for v in self.matrix)
        return df.withColumns({x: a * F.col(x) + b * F.col(y) + c, y: d * F.col(x) + e * F.col(y) + f})

    def shapes(self, df: DataFrame) -> DataFrame:
        """Vertices moved, bounding boxes computed anew."""
        if self.identity:
            return df
        from .functions.geometry import with_bounds

        a, b, c, d, e, f = self.matrix
        return with_bounds(
            df.withColumns(
                {
                    "xs": F.zip_with("xs", "ys", lambda x, y: a * x + b * y + c),
                    "ys": F.zip_with("xs", "ys", lambda x, y: d * x + e * y + f),
                }
            )
        )


@dataclass
class Dataset:
    """Named elements by kind, what each is used as, and where each lies.

    ``transforms[name]`` maps coordinate systems to the transform from the
    element's own frame.
    """

    elements: dict[str, dict[str, DataFrame]] = field(default_factory=lambda: {k: {} for k in KINDS})
    roles: dict[str, str] = field(default_factory=dict)
    transforms: dict[str, dict[str, Affine]] = field(default_factory=dict)

    def add(self, kind: str, name: str, df: DataFrame, role: str | None = None, transforms: dict[str, Affine] | None = None) -> DataFrame:
        if kind not in self.elements:
            raise KeyError(f"no such kind of element: {kind}")
        self.elements[kind][name] = df
        self.transforms[name] = transforms or {"global": Affine()}
        if role:
            self.roles[role] = name
        return df

    def get(self, kind: str, name: str | None = None, role: str | None = None) -> tuple[str, DataFrame]:
        """An element by name, else by role, else the only one; several are an error."""
        own = self.elements[kind]
        name = name or self.roles.get(role or "")
        if name is not None:
            if name not in own:
                raise KeyError(f"no {kind} named {name!r}; there are: {sorted(own)}")
            return name, own[name]
        if len(own) != 1:
            raise ValueError(f"{len(own)} {kind} elements: name one of {sorted(own)}")
        return next(iter(own.items()))

    def boundaries(self, name: str | None = None) -> tuple[str, DataFrame]:
        """The shapes used as cells: as named, by role, or by the fixed priority."""
        if name is None and "boundaries" not in self.roles:
            for p in BOUNDARY_PRIORITY:
                if f"{p}_boundaries" in self.elements["shapes"]:
                    return self.get("shapes", f"{p}_boundaries")
        return self.get("shapes", name, "boundaries")

    def between(self, source: str, target: str) -> Affine:
        """The transform from one element's frame to another's, through a system both know."""
        a, b = self.transforms[source], self.transforms[target]
        common = [s for s in a if s in b]
        if not common:
            raise ValueError(f"{source!r} and {target!r} share no coordinate system")
        for s in common:
            if a[s].identity and b[s].identity:
                return Affine()
        s = "global" if "global" in common else common[0]
        return a[s].then(b[s].inverse())

    def rebased(self, name: str, system: str = "microns") -> dict[str, Affine]:
        """The element's transforms when its own frame becomes ``system``."""
        own = self.transforms[name]
        back = own[system].inverse()
        return {s: Affine() if s == system else back.then(t) for s, t in own.items()}
