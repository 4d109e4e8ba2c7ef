"""Resampling as matrix products.

A replicate's weight of a unit is Poisson(1) by inverse distribution of a number in [0, 1); a unit is hashed once, and its numbers in the
replicates are the values of a random polynomial of degree 2 modulo a prime, so any three replicates are independent. A unit's weights don't
depend on its group: a task makes them once for a block of units (units x replicates) and multiplies the groups' totals with them. What leaves a
task is, for each group, the sums of all replicates so far; these add up over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The distribution function of Poisson(1) at 0, 1, 2, ..
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518)
#: The prime 2^31 - 1.
PRIME = 2147483647
#: Units whose weights are made together, and groups whose sums a task holds before it gives them on.
UNITS, GROUPS = 512, 256


def weights(k0: np.ndarray, k1: np.ndarray, k2: np.ndarray, replicates: int) -> np.ndarray:
    """(units, replicates): how often each unit is drawn."""
    b = np.arange(replicates, dtype=np.int64)
    u = (k0[:, None] + k1[:, None] * b + k2[:, None] * (b * b)) % PRIME / PRIME
    return np.searchsorted(POISSON, u, side="right").astype(float)


class GroupSums:
    """Sums over replicates of a few groups."""

    def __init__(self, replicates: int):
        self.replicates, self.sums = replicates, {}

    def add(self, keys: list[tuple], units: np.ndarray, totals: np.ndarray) -> None:
        """Rows of (group key, the unit's three coefficients, its two totals)."""
        names = dict.fromkeys(keys)
        for name in names:
            if name not in self.sums:
                self.sums[name] = np.zeros((2, self.replicates))
        place = {name: i for i, name in enumerate(names)}
        group = np.fromiter((place[k] for k in keys), np.int64, len(keys))
        distinct, unit = np.unique(units, axis=0, return_inverse=True)
        unit = unit.ravel()
        order = np.argsort(unit, kind="stable")
        edges = np.searchsorted(unit[order], np.arange(0, len(distinct) + UNITS, UNITS))
        for at, lo, hi in zip(range(0, len(distinct), UNITS), edges, edges[1:]):
            rows, own = order[lo:hi], distinct[at : at + UNITS]
            drawn = weights(own[:, 0], own[:, 1], own[:, 2], self.replicates)
            dense = np.zeros((2, len(place), len(own)))
            for side in (0, 1):
                np.add.at(dense[side], (group[rows], unit[rows] - at), totals[rows, side])
            met = np.flatnonzero(np.bincount(group[rows], minlength=len(place)))
            made = dense[:, met] @ drawn
            listed = list(place)
            for i, g in enumerate(met):
                self.sums[listed[g]] += made[:, i]

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, (t, n) in self.sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, t, n), schema)], schema=schema)
        self.sums = {}


def replicates_of(units: DataFrame, group: list[str], unit: str, top: str, bottom: str, replicates: int, seed: int) -> DataFrame:
    """(group, b, s): sum(top) / sum(bottom) over each replicate's resampled units (one row each); null where the bottom sum is 0. Null totals count as 0."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string")))
    made = [(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") % PRIME).alias(f"__k{i}") for i in range(3)]
    coded = units.select(*group, *made, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{n}") for c, n in ((top, "t"), (bottom, "n"))])
    fields = [coded.schema[g] for g in group]
    arrays = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "__t array<double>, __n array<double>"])
    width = len(group)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = GroupSums(replicates)
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(i) for i in range(width)], ("__t", pa.list_(pa.float64())), ("__n", pa.list_(pa.float64()))])
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                columns = [c.to_pylist() for c in part.columns[:width]]
                keys = list(zip(*columns)) if width else [()] * part.num_rows
                numbers = [np.asarray(c) for c in part.columns[width:]]
                held.add(keys, np.column_stack(numbers[:3]), np.column_stack(numbers[3:]))
                if len(held.sums) > GROUPS:
                    yield from held.rows(schema)
        if held.sums:
            yield from held.rows(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, kinds = None, None, None

        def done() -> pa.RecordBatch:
            t, n = total
            s = pa.array([pa.array(np.divide(t, n, out=np.zeros_like(t), where=n != 0), mask=n == 0)], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*[pa.array([v], k) for v, k in zip(key, kinds)], s], names=[*group, "s"])

        for batch in batches:
            kinds = [f.type for f in batch.schema][:width]
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns[:width])
                part = np.stack([np.asarray(c[i].values) for c in batch.columns[width:]])
                if row != key:
                    if key is not None:
                        yield done()
                    key, total = row, np.zeros_like(part)
                total += part
        if key is not None:
            yield done()

    parts = coded.mapInArrow(sums, arrays)
    parts = parts.repartition(*group).sortWithinPartitions(*group) if group else parts.coalesce(1)
    whole = parts.mapInArrow(merge, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "s array<double>"]))
    return whole.select(*group, F.posexplode("s").alias("b", "s"))
