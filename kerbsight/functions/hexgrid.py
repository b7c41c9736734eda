"""Hexagonal binning as plain column arithmetic.

A grid is a planar projection around the city plus pointy-top axial coordinates, so a cell is
the integer pair (q, r); the text id only names it. Joins, groupings and neighbour look-ups
use the pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ORIGIN_LAT, ORIGIN_LNG = 12.95, 77.6
KM_PER_LAT, KM_PER_LNG = 110.57, 108.48


@dataclass(frozen=True)
class HexGrid:
    prefix: str
    edge_km: float

    def axial(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        """(q, r) of the cell whose centre is nearest; null off the globe, for null and for NaN.

        Two nested floors in place of three-axis rounding: a short expression without branches
        stays cheap when Catalyst copies it into pushed-down filters and grouping keys.
        """
        valid = lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)
        x = (lng - ORIGIN_LNG) * KM_PER_LNG / (math.sqrt(3.0) * self.edge_km)
        y = (lat - ORIGIN_LAT) * KM_PER_LAT / self.edge_km + 1.0
        diagonal = F.floor(x + y)
        r = F.floor((diagonal + y - x) / 3.0)
        q = F.floor((diagonal + 2.0 * x + 1.0) / 3.0) - r
        return F.when(valid, q), F.when(valid, r)

    def cell_id(self, q: Column, r: Column) -> Column:
        """Text id; null when the cell is null (`concat` keeps nulls)."""
        return F.concat(F.lit(f"{self.prefix}:"), q.cast("string"), F.lit(":"), r.cast("string"))

    def parse_id(self, cell_id: Column) -> tuple[Column, Column]:
        """(q, r) of a text id; null unless the id names a cell of this grid."""
        pattern = f"^{self.prefix}:(-?[0-9]+):(-?[0-9]+)$"
        part = lambda i: F.nullif(F.regexp_extract(cell_id, pattern, i), F.lit(""))
        return part(1).try_cast("bigint"), part(2).try_cast("bigint")

    def centroid(self, q: Column, r: Column) -> tuple[Column, Column]:
        lat = ORIGIN_LAT + F.lit(1.5) * r * self.edge_km / KM_PER_LAT
        lng = ORIGIN_LNG + F.lit(self.edge_km * math.sqrt(3.0)) * (q + r / 2.0) / KM_PER_LNG
        return lat, lng

    def boundary(self, q: Column, r: Column) -> Column:
        """Closed ring of [lng, lat] pairs: six corners, the first one repeated."""
        lat, lng = self.centroid(q, r)
        corners = []
        for i in (0, 1, 2, 3, 4, 5, 0):
            angle = math.radians(60 * i - 30)
            corners.append(
                F.array(
                    lng + self.edge_km * math.cos(angle) / KM_PER_LNG,
                    lat + self.edge_km * math.sin(angle) / KM_PER_LAT,
                )
            )
        return F.array(*corners)

    @property
    def steps(self) -> tuple[float, float]:
        """Degrees of latitude between grid rows, and of longitude between the cells of a row."""
        return 1.5 * self.edge_km / KM_PER_LAT, math.sqrt(3.0) * self.edge_km / KM_PER_LNG


CITY = HexGrid("c", 1.4095)
STREET = HexGrid("s", 0.2058)
# The two resolutions that heatmap look-ups accept.
BY_RESOLUTION = {7: CITY, 9: STREET}


def grid_for(resolution: int) -> HexGrid:
    if resolution not in BY_RESOLUTION:
        raise ValueError(f"resolution must be 7 or 9, got {resolution}")
    return BY_RESOLUTION[resolution]


def add_hex_cells(df: DataFrame) -> DataFrame:
    """Street and city cell of every row, as integer pairs and as text ids."""
    street_q, street_r = STREET.axial(F.col("latitude"), F.col("longitude"))
    city_q, city_r = CITY.axial(F.col("latitude"), F.col("longitude"))
    return df.withColumns(
        {"street_q": street_q, "street_r": street_r, "city_q": city_q, "city_r": city_r}
    ).withColumns(
        {
            "cell_street": STREET.cell_id(F.col("street_q"), F.col("street_r")),
            "cell_city": CITY.cell_id(F.col("city_q"), F.col("city_r")),
        }
    )
