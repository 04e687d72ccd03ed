from types import SimpleNamespace

from aerotally.plans import bind_agreement


def test_ag3_answers_for_every_image(spark):
    rows = [(i, 10 * i + k, 100.0 + k, 50.0, s) for i in (3, 4, 20) for k, s in enumerate(["a", "b", "c"])]
    marks = spark.createDataFrame(rows, "image long, id long, x double, y double, species string")
    got = bind_agreement.ag3(SimpleNamespace(marks=marks)).first()
    assert (got.points, got.locations, got.avg_users) == (9, 3, 3.0)
