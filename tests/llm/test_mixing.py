from collections import defaultdict
from math import floor

from cohortlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


def targets(sizes):
    """Shares by weight; whoever is above the cap stops there and the excess is reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        share = {s: weight[s] * left / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= above
    return out


ROWS = [(i, "w " * (i % 17), "abcde"[min(i % 23 // 5, 4)] if i % 11 else None, 1) for i in range(500)] + [(1000, None, "a", 1), (1000, "", "z", 1), (None, "x y", "a", 1), (None, "x y", "a", 1), (7, "w w w", "b", 1)]


def test_budgets_are_exact(spark):
    got = mixing.mix(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, text, source, _ in ROWS:
        sizes[source] += len((text or "").split())
    expected, taken = targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert {s: taken[s] for s in sizes} == {s: floor(expected[s] + 1e-9) for s in sizes}


def test_reruns_agree_in_any_order(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    key = lambda d: sorted(map(str, mixing.mix(d).collect()))
    assert key(docs) == key(docs.repartition(7).orderBy("text"))


def test_caps_cascade(spark):
    rows = [(1, "a " * 100, "s1", 0), (2, "a " * 2, "s2", 0), (3, "a " * 3, "s3", 0)]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["s2"].target, got["s3"].target, got["s1"].target) == (6.0, 9.0, 90.0)
    assert (got["s1"].taken, got["s2"].taken, got["s3"].taken) == (90, 6, 9)


def test_nothing_to_take(spark):
    got = mixing.mix(spark.createDataFrame([(1, None, None, 0), (2, " ", "a", 0)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
