"""Copies of a document must not make it boilerplate."""
from llm_rows import DOC

import corpus_pipeline as P
from caravan.llm.common import scratch_table

FOOT = "footer of the site"


def own(i, k):
    return " ".join(f"word{i}x{k}x{j}" for j in range(12))


def test_one_full_copy_comes_out(spark):
    article = "\n".join(own("article", k) for k in range(6))
    near = [f"{article}\n".replace("article", "near") + own(f"end{i}", 0) for i in range(10)]
    texts = [article] * 40 + near + [f"{own(i, 0)}\n{own(i, 1)}\n{FOOT}" for i in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    lines = scratch_table(P.drop_boilerplate(spark, docs, ""), "test-copies")
    got = {r.doc_id: r.text for r in lines.collect()}
    assert all(got[i] == texts[i] for i in range(50))
    assert all(got[i] == texts[i].removesuffix("\n" + FOOT) for i in range(50, 110))
    kept = [r.text for r in P.drop_near_duplicates(spark, lines, "").collect()]
    assert kept.count(article) == 1 and "" not in kept
    assert sum(t in near for t in kept) >= 1 and len(set(kept)) == len(kept)
