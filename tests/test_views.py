"""Views of the driver's tables are those of their SQL to the last digit, on which ties depend."""

from conftest import SMALL
from trailmark.plans import views


def test_points_to_the_last_digit(spark, duck):
    got = sorted(tuple(map(float, r)) for r in views.points(spark, SMALL).collect())
    want = sorted(tuple(map(float, r)) for r in duck.execute(f"with {views.POINTS_SQL} select scan_id, x, y, z, intensity from v_points").fetchall())
    assert got == want
