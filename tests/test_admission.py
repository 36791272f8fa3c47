"""M6 admission: fixtures, a hot batch split over many segments, and a
property test against a brute-force sequential fold."""
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from caravan.operators.admission import accepted, admit_bookings, steps
from helpers import rows


def brute(caps, used0, reqs):
    used = dict(used0)
    out = {}
    for rid, seq, b, n in sorted(reqs, key=lambda r: (r[2], r[1])):
        if b not in caps:
            out[rid] = (False, "BATCH_NOT_FOUND")
            continue
        u = used.get(b, 0)
        if u + n <= caps[b]:
            used[b] = u + n
            out[rid] = (True, None)
        else:
            out[rid] = (False, "NO_CAPACITY")
    return out


def _run(spark, caps, bookings, reqs, segments=None):
    b = spark.createDataFrame([(k, v) for k, v in caps.items()], "id string, max_adventurers int")
    bk = spark.createDataFrame(bookings, "batch_id string, travellers int") if bookings else None
    r = spark.createDataFrame(reqs, "request_id string, seq string, batch_id string, travellers int")
    out = admit_bookings(b, bk, r, segments=segments)
    return {x["request_id"]: (x["accepted"], x["error_code"]) for x in out.collect()}


def test_fixture_greedy_not_running_sum(spark):
    caps = {"b": 10, "full": 5}
    reqs = [("r1", "1", "b", 6), ("r2", "2", "b", 5), ("r3", "3", "b", 4), ("r4", "1", "full", 1),
            ("r5", "1", "b2", 1), ("r6", "4", "b", 11)]
    got = _run(spark, caps, [("full", 5)], reqs)
    assert got == {"r1": (True, None), "r2": (False, "NO_CAPACITY"), "r3": (True, None),
                   "r4": (False, "NO_CAPACITY"), "r5": (False, "BATCH_NOT_FOUND"), "r6": (False, "NO_CAPACITY")}


def test_hot_batch_spans_segments(spark):
    rnd = random.Random(7)
    caps = {"hot": 120, "a": 30, "z": 40}
    reqs = [(f"h{i}", f"{i:06d}", "hot", rnd.randint(1, 9)) for i in range(3000)]
    reqs += [(f"a{i}", f"{i:06d}", "a", rnd.randint(1, 9)) for i in range(40)]
    reqs += [(f"z{i}", f"{i:06d}", "z", rnd.randint(1, 9)) for i in range(40)]
    bookings = [("hot", 7), ("z", 50)]  # z starts over capacity
    got = _run(spark, caps, bookings, reqs, segments=16)
    assert got == brute(caps, dict(bookings), reqs)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(1, 6)), min_size=1, max_size=60),
       st.integers(3, 15), st.integers(1, 7))
def test_matches_sequential_fold(spark, reqs, cap, segs):
    caps = {"x": cap, "y": cap + 2}
    rr = [(f"r{i}", f"{i:04d}", b, n) for i, (b, n) in enumerate(reqs)]
    got = _run(spark, caps, None, rr, segments=segs)
    assert got == brute(caps, {}, rr)
    # admitted travellers never exceed capacity
    for b, c in caps.items():
        assert sum(n for rid, _, bb, n in rr if bb == b and got[rid][0]) <= c


def test_any_capacity_and_booked_sum(spark):
    """Free seats beyond 2e9, booked sums below zero and above the capacity: the same with 1, 4 and 64 segments."""
    rnd = random.Random(3)
    caps = {"neg": 10, "big": 2_000_000_000, "over": 5, "huge": 2_000_000_000}
    bookings = [("neg", -3), ("over", 9)]
    reqs = [(f"n{i}", f"{i:05d}", "neg", 1) for i in range(30)]
    reqs += [(f"b{i}", f"{i:05d}", "big", rnd.randint(1, 9)) for i in range(2000)]
    reqs += [(f"o{i}", f"{i:05d}", "over", 1) for i in range(30)]
    reqs += [(f"h{i}", f"{i:05d}", "huge", rnd.randint(1, 2 ** rnd.randint(1, 30))) for i in range(600)]
    want = brute(caps, dict(bookings), reqs)
    for segments in (1, 4, 64):
        assert _run(spark, caps, bookings, reqs, segments=segments) == want
    assert sum(ok for k, (ok, _) in want.items() if k[0] == "n") == 13


def test_turn_after_known_segments(spark):
    """All fits for many segments, then only small requests do."""
    caps = {"b": 5000}
    reqs = [(f"r{i}", f"{i:05d}", "b", 3 if i < 1600 else 1 + i % 7) for i in range(4000)]
    want = brute(caps, {}, reqs)
    for segments in (1, 7, 32):
        assert _run(spark, caps, None, reqs, segments=segments) == want


def test_adversarial_sizes(spark):
    """Halving requests: every start accepts a set of its own."""
    caps = {"b": 3000}
    reqs = [(f"r{i}", f"{i:05d}", "b", n) for i, n in enumerate(([1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1] * 40))]
    want = brute(caps, {}, reqs)
    assert _run(spark, caps, None, reqs, segments=16) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25), st.integers(1, 13))
def test_steps_compose(ns, top):
    lo, taken = steps(np.array(ns, np.int64), top)
    assert len(lo) <= top + 1 and list(lo) == sorted(set(lo.tolist()))
    for r in range(-2, top):
        left = r
        for n in ns:
            left -= n if n <= left else 0
        assert r - taken[np.searchsorted(lo, r, "right") - 1] == left
        assert r - np.array(ns, np.int64)[accepted(np.array(ns, np.int64), r)].sum() == left
