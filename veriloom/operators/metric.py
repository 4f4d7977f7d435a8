"""An exact metric index over vectors: pivot cells, their rings, and the triangle inequality.

Right-hand vectors go to the cell of the nearest of some pivots, and inside it to a ring of angles from the pivot; the
index is the pivots and each ring's narrowest and widest angle.  A probe with angle d to a pivot finds a partner
within angle t only in rings that reach from d - t to d + t, and only in cells of which it is at most t away: vectors of a
cell lie on its pivot's side of the plane half way to the probe's nearest pivot.  Probes are copied to those rings; what they meet there
is compared in full, so nothing is lost and only work is saved.

Pivots are a hash-picked sample, of which nothing but the saving depends; there are ``PIVOTS`` at most, and ``RINGS`` rings, so the
index has a bound whatever the table's size.  Dot products of vectors that aren't unit vectors are bounded by the longest
right-hand one.  Floors of 0 and less exclude nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIVOTS, BANDS = 1024, 64
RINGS = PIVOTS * BANDS
#: Angles are right to about 1e-8, where they are near 0.
SLACK = 1e-6


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles; vectors of different lengths are an error."""
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1:
        raise ValueError(f"vectors of {min(lengths)} and {max(lengths)} dimensions")
    return vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), lengths[0] if lengths else 0)


@dataclass
class Rings:
    pivots: np.ndarray
    #: For each ring, in the order of cells: its cell, number, least and greatest angle, rows.
    cell: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    longest: float
    key: str

    def angles(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles of vectors to all pivots, and their lengths; a null vector stands at a right angle to all."""
        if len(v) and v.shape[1] != self.pivots.shape[1]:
            raise ValueError(f"vectors of {v.shape[1]} and {self.pivots.shape[1]} dimensions")
        length = np.linalg.norm(v, axis=1)
        return np.arccos(np.clip(v @ self.pivots.T / np.where(length > 0, length, 1)[:, None], -1, 1)), length

    def _apart(self) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 0))

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and ring of each vector."""
        angles, _ = self.angles(v)
        cell = angles.argmin(axis=1)
        return cell, cell * BANDS + np.minimum(angles[np.arange(len(v)), cell] / math.pi * BANDS, BANDS - 1).astype(np.int64)

    def reach(self, v: np.ndarray, floor: np.ndarray, others: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, index of a ring) for all rings that can hold a partner with a product of at least ``floor``; ``others``: not of the row's own cell."""
        angles, length = self.angles(v)
        nearest = angles.argmin(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floor > 0, floor / (length * self.longest), -1.0)
        far = np.where(least > 1 + SLACK, -np.inf, np.arccos(np.clip(least, -1, 1)) + SLACK)
        cosines, apart = np.cos(angles), self._apart()[nearest]
        # the sine of the angle to the half-way plane; pivots too near to each other for that exclude nothing
        beyond = np.divide(cosines[np.arange(len(v)), nearest][:, None] - cosines, apart, out=np.zeros_like(cosines), where=apart > 1e-3)
        open_ = (beyond <= np.sin(np.clip(far, 0, math.pi / 2))[:, None] + SLACK) & (far > -np.inf)[:, None]
        if others:
            open_[np.arange(len(v)), nearest] = False
        row, cell = np.nonzero(open_)
        first = np.searchsorted(self.cell, np.arange(len(self.pivots) + 1))
        count = np.diff(first)[cell]
        row, at = np.repeat(row, count), np.repeat(first[cell], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        d = angles[row, self.cell[at]]
        held = (d - far[row] <= self.high[at]) & (d + far[row] >= self.low[at])
        return row[held], at[held]


#: Probes that one step compares with the rings.
STEP = 512


def _map(df: DataFrame, fn, schema: str, rings: int = 1) -> DataFrame:
    """``fn`` of steps of rows, so few that a step with all of ``rings`` is about a million pairs at most."""
    step = max(1, min(STEP, (1 << 20) // max(1, rings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                yield fn(batch.slice(i, step))

    return df.mapInArrow(run, schema)


def fit(right: DataFrame, n: int) -> Rings:
    """The index of rows (id, grp, v), all with a vector; about as many pivots as the root of their number."""
    most = min(PIVOTS, max(4, math.isqrt(n)))
    picked = right.orderBy(F.xxhash64("v", F.lit(7)), "v").limit(most).select("v").distinct().toArrow()
    v = matrix(picked.column("v").combine_chunks())
    length = np.linalg.norm(v, axis=1)
    rings = Rings(v[length > 0] / length[length > 0][:, None], *(np.zeros(0),) * 5, longest=0.0, key=right.schema["id"].dataType.simpleString())
    if not len(rings.pivots):
        rings.pivots = np.eye(1, v.shape[1] if v.ndim == 2 and v.shape[1] else 1)

    def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column("v"))
        _, ring = rings.place(v)
        angles, length = rings.angles(v)
        own = angles[np.arange(len(v)), ring // BANDS]
        return pa.record_batch({"ring": ring, "low": own, "high": own, "rows": np.ones(len(v), np.int64), "longest": length})

    stats = _map(right.select("v"), summed, "ring long, low double, high double, rows long, longest double")
    found = stats.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.max("longest").alias("longest")).toArrow().sort_by("ring")
    rings.ring, rings.low, rings.high, rings.rows = (found.column(c).to_numpy() for c in ("ring", "low", "high", "rows"))
    rings.cell, rings.longest = rings.ring // BANDS, float(found.column("longest").to_numpy().max(initial=0.0))
    return rings


def placed(rings: Rings, right: DataFrame, by_cell: bool = False) -> DataFrame:
    """Rows (bucket, id, grp, v) in the bucket of their ring, or of their cell."""
    group = right.schema["grp"].dataType.simpleString()

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        cell, ring = rings.place(matrix(batch.column("v")))
        return pa.record_batch({"bucket": cell if by_cell else ring} | {c: batch.column(c) for c in ("id", "grp", "v")})

    return _map(right.select("id", "grp", "v"), fn, f"bucket long, id {rings.key}, grp {group}, v {right.schema['v'].dataType.simpleString()}")


def own_cells(rings: Rings, left: DataFrame) -> DataFrame:
    return placed(rings, left, by_cell=True)


def copies(rings: Rings, left: DataFrame, others: bool = False) -> DataFrame:
    """Rows (bucket, id, grp, v) of probes (id, grp, v, floor), one for each ring that can hold a partner."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, at = rings.reach(matrix(batch.column("v")), batch.column("floor").to_numpy(), others)
        part = batch.take(pa.array(row))
        return pa.record_batch({"bucket": rings.ring[at]} | {c: part.column(c) for c in ("id", "grp", "v")})

    return _map(left.select("id", "grp", "v", "floor"), fn, f"bucket long, id {rings.key}, grp {left.schema['grp'].dataType.simpleString()}, v {left.schema['v'].dataType.simpleString()}", len(rings.ring))


def work(rings: Rings, left: DataFrame, others: bool = False) -> dict[str, int]:
    """How many copies the probes (v, floor) make, and how many pairs of vectors are compared."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, at = rings.reach(matrix(batch.column("v")), batch.column("floor").to_numpy(), others)
        return pa.record_batch({"copies": [len(at)], "pairs": [int(rings.rows[at].sum())]})

    row = _map(left.select("v", "floor"), fn, "copies long, pairs long", len(rings.ring)).agg(F.sum("copies"), F.sum("pairs")).first()
    return {"copies": row[0] or 0, "pairs": row[1] or 0}
