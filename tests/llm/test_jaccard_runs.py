"""The Jaccard join's runs: pairs of short ones, families of long ones."""
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import DOC
from test_searches import plain_components, plain_sets

from caravan.llm import jaccard_join as J


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_runs_in_batches(size):
    """However the sorted rows are cut into batches, the pairs and long rows are the same."""
    rnd = random.Random(size)
    rows = sorted({(d, rnd.randrange(40), (3 << 6) + d % 5) for d in range(30) for _ in range(rnd.choice([1, 2, 4, 9, 30]))})
    rows = sorted(r for r in rows for _ in range(rnd.choice([1, 1, 3])))  # copies side by side
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                                           pa.array([r[2] for r in part], pa.int32())], names=["digest", "node", "mark"])
               for part in (rows[i:i + size] for i in range(0, len(rows), size))]
    got = [tuple(r.values()) for b in J._runs(4)(iter(batches)) for r in b.to_pylist()]
    want = []
    for d in {r[0] for r in rows}:
        run = sorted({r[1:] for r in rows if r[0] == d})
        if len(run) > 4:
            want += [(n, d, m, True) for n, m in run]
        else:
            want += [(x[0], y[0], x[1], False) for i, x in enumerate(run) for y in run[i + 1:]]
    assert sorted(got) == sorted(want)


def _texts(rnd):
    """Groups of near copies, of near misses, and a passage that most documents share."""
    passage = " ".join(f"p{i}" for i in range(25))
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rnd.randint(30, 70))]
        for _ in range(rnd.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
            if rnd.random() < 0.7:
                at = rnd.randrange(len(w))
                w[at:at] = passage.split()
            texts.append(" ".join(w))
    return texts + [passage, passage + " end", "", None, texts[0]]


@pytest.mark.parametrize("width,percent,run,hub", [(2, 60, 2, 3), (3, 80, 3, 1000), (1, 50, 2, 2), (3, 80, 1, 2)])
def test_links_through_long_runs(spark, monkeypatch, width, percent, run, hub):
    """No link is lost, whichever runs are long."""
    monkeypatch.setattr(J, "RUN", run)
    monkeypatch.setattr(J, "HUB_ROWS", hub)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "WIDE_BLOCK", 8)
    texts = _texts(random.Random(run))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    want, _ = plain_components([r[0] for r in rows], plain_sets(texts, width), percent)
    got = {r["doc_id"]: r["component_id"] for r in J.similar_components(
        spark.createDataFrame(rows, DOC).repartition(4), width, percent).collect()}
    assert [got[i] for i in range(len(rows))] == list(want)
    assert len(set(want)) < len(rows)


def test_marks_count_shared_parts():
    """Sets that link share as many parts of a class as their marks say."""
    rnd = np.random.default_rng(7)
    for n in (12, 40, 150, 700):
        x = np.unique(rnd.integers(0, 2 ** 63, n, dtype=np.uint64))
        for out in range(0, n // 9):
            y = np.unique(np.concatenate([x[out:], rnd.integers(0, 2 ** 63, out, dtype=np.uint64)]))
            if 100 * (n - out) < 80 * (n + out):
                continue
            (dx, mx), (dy, my) = J.parts(x, 80), J.parts(y, 80)
            both = set(dx.tolist()) & set(dy.tolist())
            need = max(mx.max(initial=0) >> 6, my.max(initial=0) >> 6)
            assert len(both) >= min(need, 1) and (out or len(both) == len(dx))
            c, _ = J.size_class(max(len(x), len(y)), 80)
            shared = sum(1 for d, m in zip(dx.tolist(), mx.tolist()) if m & 63 == c and d in both)
            assert shared >= max([m >> 6 for m in mx.tolist() if m & 63 == c], default=0)
