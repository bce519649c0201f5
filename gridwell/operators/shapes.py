"""Quality of cells by their shape: triangles and quadrilaterals in a plane;
tetrahedra, pyramids, wedges and hexahedra in space.

Each measure is 1 (angles: in degrees) for a regular cell, but for volumes and
jacobians, which are sizes. Cells of one kind are measured together in numpy; their
vertices come together once for all measures.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry as gm
from . import mesh as meshes

#: Per kind (axes, vertices): its edges, and of each corner the neighbours whose edges span it, turning alike.
EDGES = {
    (2, 3): [(0, 1), (1, 2), (2, 0)],
    (2, 4): [(0, 1), (1, 2), (2, 3), (3, 0)],
    (3, 4): [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    (3, 5): [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    (3, 6): [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3), (1, 4), (2, 5)],
    (3, 8): [(0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
}
CORNERS = {
    (2, 3): [(0, 1, 2), (1, 2, 0), (2, 0, 1)],
    (2, 4): [(0, 1, 3), (1, 2, 0), (2, 3, 1), (3, 0, 2)],
    (3, 4): [(0, 1, 2, 3), (1, 2, 0, 3), (2, 0, 1, 3), (3, 0, 2, 1)],
    (3, 5): [(0, 1, 3, 4), (1, 2, 0, 4), (2, 3, 1, 4), (3, 0, 2, 4)],
    (3, 6): [(0, 1, 2, 3), (1, 2, 0, 4), (2, 0, 1, 5), (3, 5, 4, 0), (4, 3, 5, 1), (5, 4, 3, 2)],
    (3, 8): [(0, 1, 3, 4), (1, 2, 0, 5), (2, 3, 1, 6), (3, 0, 2, 7), (4, 7, 5, 0), (5, 4, 6, 1), (6, 5, 7, 2), (7, 6, 4, 3)],
}
#: What a corner of a regular cell has in place of 1: of all edges of one length.
REGULAR = {(2, 3): 3**0.5 / 2, (2, 4): 1.0, (3, 4): 2**-0.5, (3, 5): 2**-0.5, (3, 6): 3**0.5 / 2, (3, 8): 1.0}
#: Directions across a quadrilateral or hexahedron, each as the vertices on its two sides.
ACROSS = {(2, 4): [((0, 3), (1, 2)), ((0, 1), (3, 2))], (3, 8): [((0, 3, 4, 7), (1, 2, 5, 6)), ((0, 1, 4, 5), (3, 2, 7, 6)), ((0, 1, 2, 3), (4, 5, 6, 7))]}
DIAGONALS = {(2, 4): [(0, 2), (1, 3)], (3, 8): [(0, 6), (1, 7), (2, 4), (3, 5)]}
MEASURES = ("jacobian", "scaled_jacobian", "edge_ratio", "skew", "diagonal_ratio", "min_angle", "max_angle")


def measured(p: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of cells (n, vertices, axes) of one kind; NaN where a kind has no such measure."""
    n, size, d = p.shape
    kind, none = (d, size), np.full(n, np.nan)
    length = lambda v: np.sqrt((v**2).sum(-1))
    out = dict.fromkeys(MEASURES, none)
    if kind not in EDGES:
        return out
    with np.errstate(divide="ignore", invalid="ignore"):
        edges = np.stack([length(p[:, b] - p[:, a]) for a, b in EDGES[kind]], 1)
        out["edge_ratio"] = edges.max(1) / edges.min(1)
        spans = np.stack([np.stack([p[:, b] - p[:, c[0]] for b in c[1:]], 1) for c in CORNERS[kind]], 1)
        det = np.linalg.det(spans)
        out["jacobian"] = det.min(1)
        whole = length(spans).prod(2)
        out["scaled_jacobian"] = np.where(whole > 0, det / np.where(whole > 0, whole, 1), 0).min(1) / REGULAR[kind]
        if d == 2:
            angle = np.degrees(np.arccos(np.clip((spans[:, :, 0] * spans[:, :, 1]).sum(2) / whole, -1, 1)))
            out["min_angle"], out["max_angle"] = angle.min(1), angle.max(1)
        if kind in ACROSS:
            axes = [p[:, list(b)].mean(1) - p[:, list(a)].mean(1) for a, b in ACROSS[kind]]
            axes = [a / length(a)[:, None] for a in axes]
            out["skew"] = np.stack([np.abs((axes[a] * axes[b]).sum(1)) for a in range(len(axes)) for b in range(a)], 1).max(1)
            diagonal = np.stack([length(p[:, b] - p[:, a]) for a, b in DIAGONALS[kind]], 1)
            out["diagonal_ratio"] = diagonal.min(1) / diagonal.max(1)
    return out


def quality(mesh: meshes.Mesh, size: str | None = None) -> DataFrame:
    """(domain_id, cell_id, measures): the least jacobian of a cell's corners, that
    scaled by the corner's edges (1 for a regular cell, more for a steep pyramid, 0 or
    less for a degenerate or folded cell), the longest edge over the shortest, the greatest cosine between
    directions across (skew), the shortest diagonal over the longest, and the least and
    greatest angle in a plane. A measure that a kind of cell doesn't have is null. size:
    with its length, area or volume, by this name."""
    axes = len(mesh.axes)
    more = [size] if size else []
    rows = meshes.gathered(mesh, p=gm._numbers(mesh, ()))
    rows = meshes.sized(rows, mesh.axes) if size else rows
    rows = rows.select("domain_id", "cell_id", F.size("c").alias("n"), F.flatten(F.transform("c", lambda c: c["p"])).alias("points"), *more)

    def run(batches):
        for batch in batches:
            count = np.asarray(batch.column(2))
            points, begin = np.asarray(batch.column(3).flatten()).reshape(-1, axes), np.cumsum(count) - count
            out = {m: np.full(len(count), np.nan) for m in MEASURES}
            for n in np.unique(count):
                these = np.flatnonzero(count == n)
                for m, v in measured(points[begin[these][:, None] + np.arange(n)]).items():
                    out[m][these] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(out[m], mask=~np.isfinite(out[m])) for m in MEASURES), *batch.columns[4:]], names=["domain_id", "cell_id", *MEASURES, *more])

    return rows.mapInArrow(run, "domain_id int, cell_id long, " + ", ".join(f"{m} double" for m in (*MEASURES, *more)))
