import pytest
from pyspark.sql import functions as F

from fieldglass.operators import detections as D


def test_motion_and_reports(spark):
    rows = [(1, t, f, 10.0 * t + 2 * f + (f if t == 3 else 0), 5.0) for t in range(1, 4) for f in range(4) if not (t == 1 and f == 2)]
    points = spark.createDataFrame(rows, "clip int, track int, frame int, x double, y double")
    energy = {r["frame"]: (r["energy"], r["tracks"]) for r in D.motion_energy(points, "clip", "track", "frame", "x", "y").collect()}
    assert energy[1] == (pytest.approx(1 / 3), 3) and energy[2][1] == 2 and energy[3][1] == 2
    r = D.track_report(points, "clip", "track", "frame").first()
    assert (r["tracks"], r["least_people"], r["most_people"], r["longest_span"]) == (3, 2, 3, 4) and r["continuity"] == pytest.approx(11 / 12)


def test_filters(spark):
    people = spark.createDataFrame([(1, i, float(i), 0.0, True) for i in range(8)] + [(1, 8, 60.0, 40.0, True), (1, 9, 60.0, 20.0, False)], "f int, k int, x double, y double, s boolean")
    assert {r["k"] for r in D.drop_isolates(people, "f", "k", "x", "y", "s").collect()} == {*range(8), 9}
    boxes = spark.createDataFrame([(1, float(r), 10 + r / 10 + (40 if r == 50 else 0)) for r in range(0, 100, 10)], "f int, row double, h double")
    kept = {r["row"] for r in D.sideline_gate(boxes, "f", F.col("row"), F.col("h"), 5, (0, 100), 3.0).collect()}
    assert 50.0 not in kept and len(kept) == 9
    r = spark.range(1).select(D.not_official(F.lit("Referee")).alias("a"), D.not_official(F.lit("player")).alias("b"), D.still_play(F.array(F.lit("Still frame 3"))).alias("c"), D.caveats(F.lit(True), F.lit(10), F.lit(0.9), F.lit(0)).alias("d"), D.role_group(F.lit("CB"), {"cb": "corner"}).alias("e"), D.merged_probabilities(F.array(F.struct(F.lit("a").alias("name"), F.lit(0.2).alias("p")), F.struct(F.lit("b").alias("name"), F.lit(0.6).alias("p"))), {"a": "b"}).alias("f")).first()
    assert (r["a"], r["b"], r["c"], len(r["d"]), r["e"], r["f"]) == (False, True, True, 3, "corner", {"b": 0.6})


def test_registration(spark):
    pairs = spark.createDataFrame([(1, 10.0 + e, 5.0, 0.0, 0.0) for e in (-1.0, 0.0, 1.0)], "clip int, x double, y double, tx double, ty double")
    r = D.registration_error(pairs, "clip", "x", "y", "tx", "ty").first()
    assert r["offset_x"] == 10 and r["lateral"] == 0 and r["downfield"] == pytest.approx((2 / 3) ** 0.5) and r["usable"]
    fits = spark.createDataFrame([(1, 0, [9.0, 9.0], False), (1, 1, [1.0, 5.0], True), (1, 2, [0.0, 0.0], False), (1, 3, [3.0, 1.0], True)], "clip int, frame int, m array<double>, good boolean")
    got = [r["m"] for r in D.smoothed_matrix(fits, "clip", "frame", "m", "good").orderBy("frame").collect()]
    assert got == [None, [1.0, 5.0], [1.0, 5.0], [2.0, 3.0]]


def test_formation_and_snap(spark):
    line = [(1, 1.0, float(i)) for i in range(5)] + [(1, 5.0, 9.0), (1, 7.0, 2.5), (1, 6.0, -8.0)]
    r = D.formation(spark.createDataFrame(line, "clip int, d double, l double"), ["clip"], "d", "l").first()
    assert r["people"] == 8 and r["spread"] < 3 and r["line_depth"] == 1.0
    frames = spark.createDataFrame([(1, 1, 2.0, 22), (1, 2, 2.2, 22), (1, 3, 5.0, 22), (1, 4, 1.0, 5)], "clip int, frame int, spread double, n int")
    assert D.refine_snap(frames, "clip", "frame", "spread", "n").first()["frame"] == 2


def test_stitching(spark):
    rows = [(1, 1, "o", 0.0, 1.0, 0.0, 0.0, 5.0, 5.0, [1.0, 0.0]), (1, 2, "o", 1.3, 2.0, 6.0, 5.0, 9.0, 9.0, [1.0, 0.0]), (1, 3, "o", 1.2, 3.0, 6.0, 5.0, 9.0, 9.0, [0.95, 0.312]), (1, 4, "d", 1.3, 2.0, 6.0, 5.0, 9.0, 9.0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "clip long, track long, team string, start double, end double, sx double, sy double, ex double, ey double, look array<double>")
    assert {r["track"]: r["kept"] for r in D.stitch_fragments(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_gaps_and_mirrors(spark):
    calls = spark.createDataFrame([("a", "both"), ("a", "none"), ("a", "shell")], "team string, kind string")
    assert D.disguise_summary(calls, "team").first()["rate"] == pytest.approx(2 / 3)
    clean = spark.createDataFrame([(1, "x", "x"), (2, "y", "y")], "k int, t string, p string")
    film = spark.createDataFrame([(1, "x", "x"), (2, "y", "x")], "k int, t string, p string")
    r = D.domain_gap(clean, film, "k", "t", "p").first()
    assert (r["clean"], r["film"], r["agreement"], r["drop"]) == (1.0, 0.5, 0.5, 0.5)
    schema = "play int, t double, id string, x double, y double, vx double, vy double"
    d = spark.createDataFrame([(1, 0.5, "d", 0.0, 0.0, 1.0, 0.0)], schema)
    o = spark.createDataFrame([(1, 0.5, "near", 1.0, 0.0, 1.0, 0.0), (1, 0.5, "far", 9.0, 0.0, 1.0, 0.0), (1, 0.5, "away", 1.0, 0.0, -1.0, 0.0)], schema)
    assert D.mirror_scores(d, o, ["play"]).first()["receiver"] == "near"
