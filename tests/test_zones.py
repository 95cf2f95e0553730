import numpy as np
from pyspark.sql import functions as F

from cohortlake.operators import discover, zones

REGION = "serial_number string, text string, x int, y int, w int, h int"
ZONE = "serial_number string, rule_pos int, zone_pos int, r1 double, r2 double, c1 double, c2 double"


def test_fill_array():
    out, hit = zones.fill_array(np.full((50, 50), 9, np.uint8), [(10.5, 20.5, 10, 20)])
    assert hit and (out[10:20, 10:20] == 0).all() and out.sum() == 9 * (2500 - 100)
    out, _ = zones.fill_array(np.full((50, 50, 3), 9, np.uint8), [(10, 20, 10, 20)])
    assert (out[10:20, 10:20] == 0).all() and out[9, 9, 2] == 9
    out, hit = zones.fill_array(np.full((4, 10, 10), 9, np.uint16), [(0, 5, 0, 5), (8, 99, 8, 99)])
    assert hit and (out[:, :5, :5] == 0).all() and (out[:, 8:, 8:] == 0).all() and (out[:, 5:8, :] == 9).all()
    assert not zones.fill_array(np.ones((5, 5)), [(9, 10, 0, 1)])[1]


def test_redact_fills_all_zones_and_skips_what_is_done(spark):
    schema = "sop_instance_uid string, rows int, cols int, samples int, frames int, bits int, pixel_repr int, pixels binary, pixel_hash string, config_hash string"
    whole = bytearray(b"\xff" * 100)
    frames = spark.createDataFrame([("a", 10, 10, 1, 1, 8, 0, whole, "h", None), ("b", 10, 10, 1, 1, 8, 0, whole, "h", "same"), ("c", 10, 10, 1, 1, 8, 0, whole, "h", None)], schema)
    boxes = [(0.0, 5.0, 0.0, 5.0), (8.0, 10.0, 8.0, 10.0)]
    tasks = spark.createDataFrame([("a", boxes, "new"), ("b", boxes, "same")], "sop_instance_uid string, zones array<struct<r1: double, r2: double, c1: double, c2: double>>, config_hash string")
    got = {r.sop_instance_uid: r for r in zones.redact(frames, tasks).collect()}
    a = np.frombuffer(bytes(got["a"].pixels), np.uint8).reshape(10, 10)
    assert (a[:5, :5] == 0).all() and (a[8:, 8:] == 0).all() and a[9, 0] == 255 and got["a"].redacted and got["a"].config_hash == "new"
    assert bytes(got["b"].pixels) == bytes(whole) == bytes(got["c"].pixels) and not got["b"].redacted
    again = zones.redact(zones.redact(frames, tasks).drop("redacted"), tasks)
    assert again.filter("redacted").count() == 0


def test_leaks(spark):
    rules = spark.createDataFrame([("s", 0, 0, 0.0, 100.0, 0.0, 100.0)], ZONE)
    rows = [("s", "safe text", 10, 10, 50, 50), ("s", "new\ntext", 200, 200, 50, 50), ("s", "partial", 50, 0, 100, 100), ("s", "ab", 200, 0, 9, 9), ("t", "no rule", 0, 0, 5, 5)]
    got = {r.text: r for r in zones.verify(spark.createDataFrame(rows, REGION), rules).collect()}
    assert set(got) == {"new text", "partial", "no rule"}
    assert got["new text"].reason == "New Leak (Uncovered) (Cov: 0.00)" and got["partial"].coverage == 0.5 and got["partial"].leak_type == "PARTIAL_LEAK"


def test_suggestions(spark):
    rules = spark.createDataFrame([("s", 0, 0, 0.0, 50.0, 0.0, 50.0)], ZONE)
    leaks = zones.verify(spark.createDataFrame([("s", "text", 25, 25, 100, 100)], REGION), rules)
    (row,) = zones.suggestions(leaks).collect()
    assert row.action == "EXPAND_ZONE" and tuple(row.new_zone) == (0, 125, 0, 125)
    config = [{"serial_number": "s", "redaction_zones": [[0, 50, 0, 50]]}]
    assert zones.apply_suggestions(config, [{"serial_number": "s", "action": "EXPAND_ZONE", "original_zone": [0, 50, 0, 50], "new_zone": [0, 125, 0, 125]}]) == 1
    assert config[0]["redaction_zones"] == [[0, 125, 0, 125]]


CANDIDATE = "serial_number string, candidate long, source_index int, text string, confidence double, x int, y int, w int, h int, classification string"


def boxes(spark, rows):
    return spark.createDataFrame([("s", i, src, f"t{i}", 90.0, *box, "TEXT") for i, (src, box) in enumerate(rows)], CANDIDATE)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.candidate)
    return sorted(map(sorted, out.values()))


def test_clusters(spark):
    chain = boxes(spark, [(0, (0, 0, 10, 10)), (0, (5, 0, 10, 10)), (0, (14, 0, 10, 10)), (0, (100, 100, 5, 5)), (0, (105, 105, 5, 5))])
    assert groups(discover.clusters(chain, 0, 0)) == [[0, 1, 2], [3, 4]]
    apart = boxes(spark, [(0, (0, 0, 10, 10)), (0, (50, 0, 10, 10))])
    assert len(groups(discover.clusters(apart, 20, 10))) == 2 and len(groups(discover.clusters(apart, 100, 10))) == 1
    merged = discover.merged_boxes(discover.clusters(chain, 0, 0)).orderBy("cluster").collect()
    assert [(r.x, r.y, r.w, r.h) for r in merged] == [(0, 0, 24, 10), (100, 100, 10, 10)]


def test_clusters_against_brute_force(spark):
    import random

    r = random.Random(1)
    rows = [(0, (r.randrange(400), r.randrange(400), r.randrange(1, 40), r.randrange(1, 20))) for _ in range(150)]
    parent = list(range(len(rows)))
    find = lambda a: a if parent[a] == a else find(parent[a])
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if not (a[0] + a[2] + 7 < b[0] or a[0] - 7 > b[0] + b[2] or a[1] + a[3] + 3 < b[1] or a[1] - 3 > b[1] + b[3]):
                parent[find(i)] = find(j)
    want = {}
    for i in range(len(rows)):
        want.setdefault(find(i), set()).add(i)
    for seed in (1, 2):
        assert groups(discover.clusters(boxes(spark, rows).orderBy(F.rand(seed)), 7, 3)) == sorted(map(sorted, want.values()))


def test_zones_drop_noise_and_tell_stability(spark):
    rows = [(k % 5, (10, 10, 80, 20)) for k in range(10)] + [(5 + k, (1000 * (k + 1), 1000, 50, 50)) for k in range(3)]
    (zone,) = discover.zones(discover.clusters(boxes(spark, rows)), 20).collect()
    assert (zone.r1, zone.r2, zone.c1, zone.c2, zone.occurrence) == (10, 30, 10, 90, 0.25)
    status = lambda n, of: discover.stability(discover.zones(discover.clusters(boxes(spark, [(k, (0, 0, 9, 9)) for k in range(n)])), of, 0.0)).first().status
    assert (status(10, 10), status(6, 10), status(1, 10)) == ("STATIC_ALWAYS", "STATIC_FREQUENT", "TRANSIENT")


def test_classes(spark):
    rows = {"Smith^John": "NAME_PATTERN", "Hospital A": "PROPER_NOUN_CANDIDATE", "Dr. Smith": "PROPER_NOUN_CANDIDATE", "kvp: 120": "TEXT", "12345": "TEXT", "^": "TEXT", "a B c": "TEXT", "(Älter)": "PROPER_NOUN_CANDIDATE", " ": "TEXT"}
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", discover.classify_text(F.col("t")).alias("k")).collect()
    assert {r.t: r.k for r in got} == rows


def test_density(spark):
    cells = discover.density(boxes(spark, [(0, (0, 0, 10, 10)), (0, (100, 100, 10, 10)), (0, (0, 0, 10, 10))]), 2, 2)
    assert {(r.r, r.c): r.n for r in cells.collect()} == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 1}
    assert discover.heat_map(cells) == "|. |\n| .|"
