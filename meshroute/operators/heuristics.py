"""Lower bounds of the way between two nodes, by their coordinates, for A*."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from meshroute.functions.geodesy import FLATTENING, RULER_HEURISTIC


def haversine(lat: np.ndarray, lon: np.ndarray, lat2: float, lon2: float, radius: float) -> np.ndarray:
    """The great-circle distance to one place."""
    a, b = np.radians(lat), np.radians(lat2)
    half = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(half, 1.0)))


def cheap_ruler(lat: np.ndarray, lon: np.ndarray, lat2: float, lon2: float, radius: float) -> np.ndarray:
    """The planar distance by the radii of curvature at the middle latitude, times RULER_HEURISTIC: it may be too long by
    that much over long ways."""
    c = np.cos(np.radians((lat + lat2) / 2))
    e2 = FLATTENING * (2 - FLATTENING)
    w2 = 1 / (1 - e2 * (1 - c * c))
    w = np.sqrt(w2)
    gap = np.abs(lon2 - lon)
    gap = np.minimum(gap, 360 - gap)
    east, north = np.radians(gap) * radius * w * c, np.radians(lat2 - lat) * radius * w * w2 * (1 - e2)
    return RULER_HEURISTIC * np.sqrt(east * east + north * north)


HEURISTICS = {"haversine": haversine, "cheap_ruler": cheap_ruler}


def lower_bound(name: str, lat: np.ndarray, lon: np.ndarray, target: int, radius: float) -> Callable[[int], float]:
    """A function of a node's index that gives its bound to the target's, both places in the arrays of coordinates."""
    return HEURISTICS[name](lat, lon, lat[target], lon[target], radius).tolist().__getitem__
