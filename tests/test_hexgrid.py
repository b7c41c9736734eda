import math
import random

import pytest
from pyspark.sql import functions as F

from kerbsight.functions import hexgrid
from kerbsight.functions.hexgrid import CITY, STREET, add_hex_cells, grid_for


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(rng.uniform(12.6, 13.3), rng.uniform(77.2, 78.0)) for _ in range(3000)]
    return spark.createDataFrame(rows, "latitude double, longitude double")


def centre(grid, q, r):
    lat = hexgrid.ORIGIN_LAT + 1.5 * r * grid.edge_km / hexgrid.KM_PER_LAT
    lng = hexgrid.ORIGIN_LNG + grid.edge_km * math.sqrt(3) * (q + r / 2) / hexgrid.KM_PER_LNG
    return lat, lng


@pytest.mark.parametrize("grid, q, r", [(STREET, "street_q", "street_r"), (CITY, "city_q", "city_r")])
def test_point_falls_into_the_cell_with_the_nearest_centre(points, grid, q, r):
    around = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
    for row in add_hex_cells(points).collect():

        def distance(dq, dr):
            lat, lng = centre(grid, row[q] + dq, row[r] + dr)
            return math.hypot(
                (lat - row["latitude"]) * hexgrid.KM_PER_LAT,
                (lng - row["longitude"]) * hexgrid.KM_PER_LNG,
            )

        assert min(around, key=lambda o: distance(*o)) == (0, 0)


def test_centroid_lies_in_its_own_cell(points):
    cells = add_hex_cells(points).select("street_q", "street_r").distinct()
    lat, lng = STREET.centroid(F.col("street_q"), F.col("street_r"))
    q, r = STREET.axial(F.col("lat"), F.col("lng"))
    back = cells.select("street_q", "street_r", lat.alias("lat"), lng.alias("lng"))
    assert back.where((q != F.col("street_q")) | (r != F.col("street_r"))).count() == 0


def test_ids_parse_back(points):
    df = add_hex_cells(points)
    q, r = STREET.parse_id(F.col("cell_street"))
    assert df.where(~((q == F.col("street_q")) & (r == F.col("street_r")))).count() == 0
    none = df.select(CITY.parse_id(F.col("cell_street"))[0].alias("q")).where("q IS NOT NULL")
    assert none.count() == 0


def test_coordinates_that_are_missing_have_no_cell(spark):
    rows = [(None, 77.5), (12.9, None), (float("nan"), 77.5), (200.0, 77.5)]
    df = add_hex_cells(spark.createDataFrame(rows, "latitude double, longitude double"))
    assert df.where("cell_street IS NOT NULL OR cell_city IS NOT NULL OR street_q IS NOT NULL").count() == 0


def test_boundary_is_a_closed_hexagon(spark):
    df = spark.createDataFrame([(4, -7)], "q long, r long")
    ring = df.select(STREET.boundary(F.col("q"), F.col("r")).alias("b")).first()["b"]
    assert len(ring) == 7 and ring[0] == ring[6]
    lat, lng = centre(STREET, 4, -7)
    for x, y in ring:
        km = math.hypot((y - lat) * hexgrid.KM_PER_LAT, (x - lng) * hexgrid.KM_PER_LNG)
        assert km == pytest.approx(STREET.edge_km)


def test_only_two_resolutions():
    assert grid_for(7) is CITY and grid_for(9) is STREET
    with pytest.raises(ValueError):
        grid_for(8)
