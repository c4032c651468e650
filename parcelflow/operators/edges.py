"""Points held against the edges of shapes, batch by batch: what each task does for ``spatial.in_parcels``."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Points times shapes that are held against each other at once.
MOST_AT_ONCE = 1 << 20
#: Degrees by which a rounded crossing may lie beside its edge.
SLACK = 1e-9


def made_ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, rings) to (id, south, north, west, east, edges): all edges of a shape that a line of sight along a parallel can cross, and the box around them.

    An edge is four numbers: the latitudes of its ends, then their
    longitudes. Edges that lack a coordinate are none; shapes without edges
    hold nothing and go.
    """
    for batch in batches:
        ids, shapes = batch.columns
        rings = shapes.flatten()
        of_shape, of_ring = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype("i8") for x in (shapes, rings))
        lat, lon = (pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False) for x in rings.flatten().flatten())
        ends = np.cumsum(of_ring)
        after = np.arange(1, len(lat) + 1)
        after[ends[of_ring > 0] - 1] = (ends - of_ring)[of_ring > 0]
        edges = np.stack([lat, lat[after], lon, lon[after]], axis=1)
        of = np.repeat(np.repeat(np.arange(len(ids)), of_shape), of_ring)
        kept = (edges[:, 0] != edges[:, 1]) & ~np.isnan(edges).any(axis=1)
        edges, of = edges[kept], of[kept]
        shape, first, many = np.unique(of, return_index=True, return_counts=True)
        if len(shape):
            box = (f.reduceat(f(edges[:, i], edges[:, i + 1]), first) for i in (0, 2) for f in (np.minimum, np.maximum))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, 4 * np.cumsum(many)).astype("i4")), pa.array(edges.ravel()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(shape)), *map(pa.array, box), lists], ["id", "south", "north", "west", "east", "edges"])


class Place:
    """The points of one place."""

    def __init__(self, held: list[tuple[pa.Array, pa.Array, pa.Array]]):
        self.ids, lat, lon = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        self.lat, self.lon = lat.to_numpy(), lon.to_numpy()
        self.south, self.north, self.west, self.east = self.lat.min(), self.lat.max(), self.lon.min(), self.lon.max()

    def __len__(self) -> int:
        return len(self.ids)


def held(batches: Iterator[pa.RecordBatch], listed: bool) -> Iterator[pa.RecordBatch]:
    """(shape, its points in a place), or with their number, of rows (leaf, block, point, lat, lon, shape, edges) that come place by place, each one's points before its shapes.

    A point is in a shape by the even-odd rule over its edges. Only a place's
    points and one batch of shapes are held.
    """
    key, points, place = None, [], None
    for batch in batches:
        leaf, block, ids, lat, lon, shapes, edges = batch.columns
        is_shape = edges.is_valid().to_numpy(zero_copy_only=False)
        keys = np.stack([leaf.to_numpy(), block.to_numpy(), is_shape])
        changes = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in pairwise([0, *changes, batch.num_rows]):
            if is_shape[start]:
                if key == tuple(keys[:2, start]):
                    place = place or Place(points)
                    yield from _in_place(place, shapes[start:end], edges[start:end], listed)
            else:
                if key != tuple(keys[:2, start]):
                    key, points, place = tuple(keys[:2, start]), [], None
                points.append((ids[start:end], lat[start:end], lon[start:end]))


def _in_place(place: Place, shapes: pa.Array, edges: pa.ListArray, listed: bool) -> Iterator[pa.RecordBatch]:
    """Edges that no point's line of sight crosses are left out, those that all cross only turn the count; the rest is asked point by point."""
    many = pc.list_value_length(edges).to_numpy() // 4
    of = np.repeat(np.arange(len(shapes)), many)
    a, b, lon_a, lon_b = edges.flatten().to_numpy().reshape(-1, 4).T
    low, high = np.minimum(a, b), np.maximum(a, b)
    seen = (low <= place.north) & (high > place.south) & (np.maximum(lon_a, lon_b) >= place.west - SLACK)
    by_all = seen & (low <= place.south) & (high > place.north) & (np.minimum(lon_a, lon_b) > place.east + SLACK)
    odd = np.bincount(of[by_all], minlength=len(shapes)) % 2 == 1
    asked = np.flatnonzero(seen & ~by_all)
    some, first, many = np.unique(of[asked], return_index=True, return_counts=True)
    whole = odd.copy()
    whole[some] = False
    step = max(1, MOST_AT_ONCE // len(place))
    every = np.flatnonzero(whole)
    for i in range(0, len(every), step):
        these = every[i : i + step]
        at = np.tile(np.arange(len(place)), len(these)) if listed else None
        yield _answer(place, shapes, these, np.full(len(these), len(place)), at)
    for i in range(0, len(some), step):
        these, begin, n = some[i : i + step], first[i : i + step], many[i : i + step]
        inside = np.repeat(odd[these][:, None], len(place), axis=1)
        for k in range(n.max()):
            rows = np.flatnonzero(n > k)
            e = asked[begin[rows] + k]
            inside[rows] ^= _crossed(place, *(x[e][:, None] for x in (a, b, lon_a, lon_b)))
        counts = np.count_nonzero(inside, axis=1)
        at = None
        if listed:
            at = np.flatnonzero(inside)
            at -= np.repeat(np.arange(len(these)) * len(place), counts)
        yield _answer(place, shapes, these, counts, at)


def _crossed(place: Place, a: np.ndarray, b: np.ndarray, lon_a: np.ndarray, lon_b: np.ndarray) -> np.ndarray:
    """Whether each point's line of sight to the east crosses each edge; numbers are rounded as in ``geo.in_ring``."""
    x, wide = lon_a, lon_b - lon_a
    if wide.any():
        x = wide * (place.lat - a) / (b - a) + lon_a
    return ((a > place.lat) != (b > place.lat)) & (place.lon < x)


def _answer(place: Place, shapes: pa.Array, these: np.ndarray, counts: np.ndarray, at: np.ndarray | None) -> pa.RecordBatch:
    found = counts > 0
    these, counts = these[found], counts[found]
    answer = pa.array(counts) if at is None else pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype("i4")), place.ids.take(pa.array(at)))
    return pa.RecordBatch.from_arrays([shapes.take(pa.array(these)), answer], ["shape", "held"])
