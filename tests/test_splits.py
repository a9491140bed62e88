import pytest

from chronospark.plans.splits import (
    Bounds,
    CombinedSplitter,
    ExpandingWindowSplitter,
    ForwardSingleWindowSplitter,
    SlidingWindowSplitter,
    WholeWindowSplitter,
    merge_neighbours,
    plan_splits,
    rows_in,
    tag_test_rows,
    tag_train_rows,
)


def ranges(splits):
    return [(s.train[0].start, s.train[0].end, s.test[0].start, s.test[0].end) for s in splits]


def test_bounds():
    assert Bounds(0, 5).union(Bounds(3, 9)) == Bounds(0, 9)
    assert Bounds(0, 5).intersection(Bounds(3, 9)) == Bounds(3, 5)
    assert Bounds(0, 2).intersection(Bounds(2, 4)) is None
    assert merge_neighbours([Bounds(4, 6), Bounds(0, 2), Bounds(2, 4), Bounds(8, 9)]) == [Bounds(0, 6), Bounds(8, 9)]


def test_sizes():
    assert rows_in(3, 10) == 3 and rows_in(0.25, 10) == 2
    for bad in (1.0, 2.5, 0, -1):
        with pytest.raises(ValueError):
            rows_in(bad, 10)


def test_expanding():
    assert ranges(plan_splits(ExpandingWindowSplitter(400, 200), 1000)) == [(0, 400, 400, 600), (0, 600, 600, 800), (0, 800, 800, 1000)]
    assert ranges(plan_splits(ExpandingWindowSplitter(0.4, 0.2), 1000)) == ranges(plan_splits(ExpandingWindowSplitter(400, 200), 1000))


def test_overlapping_and_start():
    found = ranges(ExpandingWindowSplitter(100, 300, overlapping_test_sets=True).splits(1000))
    assert [f[3] for f in found] == [1000] * 3
    found = ranges(ExpandingWindowSplitter(100, 300, start=400, subtract_initial_train_window_from_start=True).splits(1000))
    assert found[0] == (300, 400, 400, 700)


def test_sliding():
    assert ranges(plan_splits(SlidingWindowSplitter(300, 300), 1000)) == [(0, 300, 300, 600), (300, 600, 600, 1000)]
    assert ranges(SlidingWindowSplitter(300, 300, initial_window=500).splits(1000))[0] == (200, 500, 500, 800)


def test_single_and_whole_and_combined():
    assert ranges(plan_splits(ForwardSingleWindowSplitter(0.7), 100)) == [(0, 70, 70, 100)]
    assert ranges(plan_splits(WholeWindowSplitter(20), 100)) == [(0, 100, 80, 100)]
    found = plan_splits(CombinedSplitter((ForwardSingleWindowSplitter(0.5),), ForwardSingleWindowSplitter(0.8)), 100)
    assert [s.split_id for s in found] == [0, 1]


def test_gaps_and_merge():
    found = plan_splits(ExpandingWindowSplitter(400, 200), 1000, gap_before=10)
    assert [s.train[0].end for s in found] == [390, 590, 790]
    assert [s.train[0].start for s in plan_splits(ExpandingWindowSplitter(400, 200), 1000, gap_after=10)] == [0, 0, 0]
    found = ranges(plan_splits(ExpandingWindowSplitter(400, 290), 1000))
    assert found == [(0, 400, 400, 690), (0, 690, 690, 1000)]
    with pytest.raises(ValueError):
        plan_splits(ExpandingWindowSplitter(20, 5), 10)


@pytest.mark.parametrize("memory", [0, 7, 100])
def test_arithmetic_tags_equal_the_join(spark, memory):
    rows = spark.range(1000).withColumnRenamed("id", "rid")
    splits = plan_splits(ExpandingWindowSplitter(410, 130), 1000)
    got = {(r.split_id, r.rid, r.halo) for r in tag_test_rows(rows, splits, memory).collect()}
    want = {(s.split_id, i, i < s.test[0].start) for s in splits for i in range(max(0, s.test[0].start - memory), s.test[0].end)}
    assert got == want
    overlapping = plan_splits(ExpandingWindowSplitter(410, 130, overlapping_test_sets=True), 1000)
    got = {(r.split_id, r.rid) for r in tag_test_rows(rows, overlapping).collect()}
    assert got == {(s.split_id, i) for s in overlapping for i in s.test_rows()}
    got = {(r.split_id, r.rid) for r in tag_train_rows(rows, splits).collect()}
    assert got == {(s.split_id, i) for s in splits for i in s.train_rows()}
