from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import packing as P


def check_plan(histogram, capacity, **kw):
    lines = P.plan(histogram, capacity, **kw)
    used = Counter()
    for content, times in lines:
        assert times > 0 and 0 < sum(content) <= capacity
        for s in content:
            used[s] += times
    assert used == Counter({s: n for s, n in histogram.items() if n})
    return sum(t for _, t in lines)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.integers(1, 12), st.integers(2, 8))
def test_plan_uses_each_piece_once(histogram, groups, share):
    check_plan(histogram, 64, groups=groups, small_share=share)


def test_plan_is_close_to_the_bound():
    histogram = {s: 1000 + s % 17 for s in range(1, 2049, 3)}
    n = check_plan(histogram, 2048)
    assert n * 2048 * 0.97 < sum(s * c for s, c in histogram.items())


def test_empty():
    assert P.plan({}, 2048) == []


@pytest.mark.parametrize("capacity", [10, 2048])
def test_pack(spark, capacity):
    sizes = [0, None, -3, 1, 1, 1, 5, 10, 11, 20, 25, 7, 7, 7, 3, 3, 2, 9] * 7 + [6] * 150
    rows = [(i // 2, n, "x") for i, n in enumerate(sizes)]  # keys repeat, a column clashes
    got = P.pack(spark.createDataFrame(rows, "doc_id long, n_tokens int, container string").repartition(7), capacity=capacity).collect()
    pieces, room = defaultdict(list), defaultdict(list)
    for r in got:
        room[r.container].append((r.position, r.piece_tokens))
        pieces[r.doc_id].append(r.piece_tokens)
    want = defaultdict(list)
    for k, n, _ in rows:
        if n and n > 0:
            want[k] += [capacity] * ((n - 1) // capacity) + [(n - 1) % capacity + 1]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for filled in room.values():
        end = 0
        for at, n in sorted(filled):
            assert at == end
            end += n
        assert end <= capacity
    assert sorted(room) == list(range(len(room)))


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, n_tokens int")
    assert P.pack(empty).collect() == []
    assert P.fill_report(P.pack(empty)).collect()[0].containers == 0


def test_check_finds_what_is_broken(spark):
    counts = spark.createDataFrame([(1, 5), (2, 7), (3, 0), (4, None), (5, 12)], "doc_id long, n_tokens long")
    good = P.check(P.pack(counts, capacity=10), counts, capacity=10).first().asDict()
    assert good["documents"] == 3 and (good["over_full"], good["apart"], good["lost"], good["split"]) == (0, 0, 0, 0)
    rows = [(1, 0, 5, 0, 0), (2, 0, 7, 0, 4), (5, 0, 6, 1, 0), (5, 1, 5, 2, 1)]
    bad = P.check(spark.createDataFrame(rows, "doc_id long, piece int, piece_tokens long, container long, position long"), counts, capacity=10).first().asDict()
    assert (bad["over_full"], bad["apart"], bad["lost"], bad["split"]) == (1, 2, 1, 0)
