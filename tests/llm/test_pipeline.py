"""Each stage of the corpus pipeline against a plain version, on its own input."""
import collections

import pytest
from llm_rows import DOC, ROWS
from pyspark.sql import functions as F
from test_searches import plain_components, plain_sets
from test_small_operators import key, packed_well, plain_line_dedup, plain_mix, whole_text_ids

import corpus_pipeline as P
from caravan.llm.common import scratch_table
from caravan.llm.line_dedup import MAX_RATIO

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.fixture(scope="module", params=["given", "odd"])
def stages(request, spark):
    """name -> (rows in, DataFrame out), each stage on the stage before."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(ROWS, DOC).unionByName(given.limit(120).withColumn("n_chars", F.lit(1).cast("long")))
    docs, out = scratch_table(given if request.param == "given" else odd, "test-docs"), {}
    for name, stage in P.STAGES:
        after = scratch_table(stage(spark, docs, SF), f"test-{name}")
        out[name] = (rows_of(docs), after)
        assert name == "packing" or after.columns == docs.columns
        docs = after
    return out


def test_language_id_stage(stages):
    before, after = stages["language_id"]
    got = collections.Counter((r[0], r[1]) for r in rows_of(after))
    want = collections.Counter((r[0], r[1]) for r in before if r[1] and any(c.isalpha() for c in r[1]))
    assert got == want
    assert all(r[2] is not None for r in rows_of(after))


def test_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], DOC)
    for name, stage in P.STAGES:
        out = stage(spark, empty, SF)
        assert out.collect() == [] and (name == "packing" or out.columns == empty.columns)


def test_stages_keep_columns_of_clashing_names(spark):
    """A column of its own with the name of a helper column goes through all stages but the last."""
    rows = [(i, f"the cat and the dog {i} " * 9, "en", "s", 1, 5, "h", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines long, "
                                       "host string, size int")
    for name, stage in P.STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, SF), f"test-clash-{name}")
        assert {(r.n_lines, r.host) for r in docs.collect()} == {(5, "h")}, name


def test_line_dedup_stage(stages):
    before, after = stages["line_dedup"]
    want = [(i, t, len(t)) for i, t, *_ in plain_line_dedup(before, MAX_RATIO)]
    assert sorted(((r[0], r[1], r[4]) for r in rows_of(after)), key=key) == sorted(want, key=key)


def test_jaccard_join_stage(stages):
    before, after = stages["jaccard_join"]
    sets = plain_sets([r[1] for r in before], 5)
    component, groups = plain_components([r[0] for r in before], sets, 80)
    kept = rows_of(after)
    assert len(kept) == groups + sum(not s for s in sets)
    assert {r[0] for r in kept} >= {c for c in component if c is not None}
    assert not collections.Counter(kept) - collections.Counter(before)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    copies = {(x[0], x[1]): x[5] for x in plain_mix(before)}
    want = collections.Counter()
    for r in before:
        want[r] += copies[(r[0], r[3])]
    assert collections.Counter(rows_of(after)) == +want


def test_packing_stage(stages):
    before, after = stages["packing"]
    out = [r.asDict() for r in after.collect()]
    want = collections.Counter()
    for r, ids in zip(before, whole_text_ids(r[1] for r in before)):
        for k, a in enumerate(range(0, len(ids) + 1, 2048)):
            want[(r[0], k, a, min(2048, len(ids) + 1 - a))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in out) == want
    assert packed_well(out, 2048) <= 1.1 * -(-sum(r["length"] for r in out) // 2048) + 1


def test_run(spark):
    assert P.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "mixing", "packing"]
