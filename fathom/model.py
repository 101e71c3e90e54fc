"""Fixed values and small records of the survey domain. SQL NULL is the only mark of a missing value."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
METRES_PER_DEGREE = 111320.0
REFERENCE_LEVEL = 13.21
LEVEL_LIMITS = (12.5, 15.5)
DEPTH_CAP = 8.0
DEPTH_STEP = 0.05
REGION = (-1.25, -1.0, 44.85, 45.1)  # west, east, south, north; an open interval
CONFIDENCE_METRES = (75.0, 175.0, 325.0)
IDW_NEIGHBOURS, IDW_SOFTEN, IDW_POWER = 16, 12.0, 2.0
TILE_PIXELS, TILE_LEVELS = 1024, (2, 4, 8)
SOURCE_PALETTE = ((182, 237, 240), (145, 205, 237), (107, 174, 232), (61, 144, 227), (32, 114, 214), (32, 76, 189), (25, 44, 168), (9, 9, 145))
DISPLAY_PALETTE = ((217, 246, 242), (198, 239, 238), (175, 229, 236), (150, 217, 235), (97, 185, 230), (50, 127, 205), (49, 88, 180), (37, 28, 88))
TAUBIN_LAMBDA, TAUBIN_MU = 0.5, -0.53
TAUBIN_ITERATIONS = (0, 4, 4, 4, 3, 2, 0, 0)
BLUR_SIGMA = (1.3, 1.3, 1.3, 1.3, 1.3, 1.1, 0.9, 0.8)
GATE_ACCURACY, GATE_SECONDS, TRACK_LENGTH = 20.0, 12.0, 800
DELIMITERS = (";", "\t", ",", "|")
HEADER_SYNONYMS = {
    "code": ("codegene", "code", "codelac", "identifiant"),
    "name": ("nombdcarthage", "nom", "name", "toponyme"),
    "date": ("dtgbathy", "date"),
    "lon": ("lon", "longitude"),
    "lat": ("lat", "latitude"),
    "depth": ("prof", "profondeur", "depth"),
}

SOUNDING = "code string, name string, date string, lon double, lat double, depth double"
GEO_POINT = "lon double, lat double, depth double, n int, date string"
ISLAND = "name string, osm_type string, osm_id long, ring array<struct<x double, y double>>"
GRID_CELL = "iy int, ix int, z double, conf int"
CLASS_CELL = "y int, x int, k int"
RING_POINT = "k int, ring_id long, i int, x double, y double"
EDGE = "geom_id long, part int, ring int, i int, x1 double, y1 double, x2 double, y2 double"
LEVEL = "level double, observed date, reference double"
FIX = "user_id long, event_id long, ts timestamp, lon double, lat double, accuracy double, speed double"
TILE = "map string, level int, tx int, ty int"


@dataclass(frozen=True)
class GeoRef:
    west: float
    south: float
    east: float
    north: float


@dataclass(frozen=True)
class GridSpec:
    """A grid over a GeoRef. ``registration``: node, centre or edge; ``rows``: south or north, the side of row 0; ``rounding``: even, up or down."""

    ref: GeoRef
    nx: int
    ny: int
    registration: str
    rows: str
    rounding: str
