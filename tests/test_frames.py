"""Frame changes by fourteen parameters against plain matrices, and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import geodesy

# a set with all fourteen, of the size of those between a plate-fixed and a global frame
FULL = {"shift": (1005.3, -1909.21, -541.57), "scale": 0.36891, "turn": (26.78138, -0.42027, 10.93206), "shift_rate": (0.79, -0.6, -1.44), "scale_rate": -0.07201, "turn_rate": (0.06667, -0.75744, -0.05133), "epoch": 2010.0}


@pytest.mark.parametrize("parameters", [geodesy.ITRF2014_TO_ITRF2008, FULL])
@pytest.mark.parametrize("coordinate_frame", [False, True])
def test_frames(spark, parameters, coordinate_frame):
    points = [(4027893.0, 307045.0, 4919475.0, 2010.0), (-2700000.5, -4292000.25, 3855000.125, 2018.37), (1.0, 2.0, 3.0, 1999.5)]
    df = spark.createDataFrame(points, "x double, y double, z double, t double")
    there = geodesy.change_frame(*(F.col(c) for c in "xyzt"), parameters, False, coordinate_frame)
    df = df.select("*", *[c.alias(n) for c, n in zip(there, "uvw", strict=True)])
    back = geodesy.change_frame(*(F.col(c) for c in "uvwt"), parameters, True, coordinate_frame)
    for r in df.select("*", *[c.alias(f"b{n}") for c, n in zip(back, "xyz", strict=True)]).collect():
        years = r["t"] - parameters["epoch"]
        at = lambda k: np.array(parameters[k]) + years * np.array(parameters[f"{k}_rate"])  # noqa: E731, B023
        a, b, c = at("turn") * np.pi / 180 / 3600 / 1000 * (-1 if coordinate_frame else 1)
        m = np.array([[1, -c, b], [c, 1, -a], [-b, a, 1]])
        want = at("shift") * 1e-3 + (1 + at("scale") * 1e-9) * (m @ [r["x"], r["y"], r["z"]])
        np.testing.assert_allclose([r["u"], r["v"], r["w"]], want, atol=1e-8)
        np.testing.assert_allclose([r["bx"], r["by"], r["bz"]], [r["x"], r["y"], r["z"]], atol=1e-8)


def test_the_shift_at_the_reference_epoch_is_the_published_one(spark):
    df = spark.range(1).select(*[c.alias(n) for c, n in zip(geodesy.change_frame(*(F.lit(0.0),) * 3, F.lit(2010.0)), "xyz", strict=True)])
    assert [round(v * 1000, 9) for v in df.first()] == [1.6, 1.9, 2.4]
