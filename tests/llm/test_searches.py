"""Top-k search, Jaccard join, components, exact dedup and HTML extraction,
against plain Python."""
import collections
import hashlib
import html
import itertools
import json
import re

import numpy as np
import pytest
from llm_rows import ROWS
from pyspark.sql import functions as F

from caravan.llm import components, exact_dedup, html_extract, jaccard_join, topk


def key(v):
    return repr(v)


# ---------------------------------------------------------------- 3 top-k
def plain_top_k(rows, k, every):
    sound = []
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        sound.append((i, [int(np.floor(64 * float(np.float32(x)))) for x in v]))
    out = []
    for n, (i, v) in enumerate(sound):
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(sound) if m != n)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


KIND = "vec_id long, embedding array<float>, rank string"


@pytest.mark.parametrize("seed, block", [(0, 1024), (1, 50), (2, 17)])
def test_top_k(spark, monkeypatch, seed, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "FIT_ROWS", 60)
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(6, 5))
    rows = [(i, [float(x) for x in base[i % 6] + 0.2 * rnd.normal(size=5)]) for i in range(200)]
    rows += [(i, [0.5, 0.25, 0.0, -0.5, 0.1]) for i in range(200, 320)]  # one very common vector: ties
    rows += [(None, [1.0] * 5), (330, None), (331, []), (332, [1.0, None, 0.0, 0.0, 0.0]),
             (333, [float("nan")] * 5), (340, [float("inf")] * 5), (341, [1.0, 2.0]), (5, [9.0] * 5), (5, [9.0] * 5),
             (20, [9.0] * 5), (20, [-1.0] * 5)]  # rows that repeat an id, also a query's
    d = spark.createDataFrame([(*r, "clash") for r in rows], KIND).repartition(3)
    got = sorted(map(tuple, topk.top_k(d, k=7, every=20).collect()))
    assert got == plain_top_k(rows, 7, 20)


def test_top_k_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], "")], KIND)
    assert [tuple(r) for r in topk.top_k(d, k=20, every=20).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(d.where("vec_id = 0"), k=20, every=20).collect() == []
    assert topk.top_k(d.where("vec_id > 9"), k=20, every=20).collect() == []


def test_dual_tree_prunes():
    rnd = np.random.default_rng(4)
    centers = 40 * rnd.normal(size=(8, 3))
    d = np.concatenate([np.floor(c + rnd.normal(size=(200, 3))) for c in centers])
    s = topk.Search(d[:100], np.arange(100), d, np.arange(len(d)), 5)
    seen = []
    s.leaves = lambda a, b, f=s.leaves: (seen.append(len(a) * len(b)), f(a, b))
    s.pair(topk.cover_tree(d[:100], np.arange(100), 0), topk.cover_tree(d, np.arange(len(d)), 0))
    assert sum(seen) < 0.6 * 100 * len(d)
    want = np.sort(np.where(np.arange(len(d)) == np.arange(100)[:, None], -np.inf, d[:100] @ d.T))[:, ::-1][:, :5]
    assert (s.score == want).all()


# ---------------------------------------------------------------- 6 Jaccard join
def plain_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain_components(ids, sets, percent):
    label = list(range(len(ids)))
    for i, j in itertools.combinations(range(len(ids)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    out = []
    for i, x in enumerate(label):
        known = [ids[j] for j in range(len(ids)) if label[j] == x and ids[j] is not None]
        out.append(min(known, default=None) if sets[i] else ids[i])
    return out, len({x for x, s in zip(label, sets) if s})


def copies(seed, families=6, members=25, words=60):
    """Families of near copies around the threshold, some chained."""
    rnd = np.random.default_rng(seed)
    texts = []
    for f in range(families):
        base = [f"w{x}" for x in rnd.integers(0, 4000, words * (1 + f % 3))]
        passage = [f"p{x}" for x in range(50)]  # shared by every text of some families
        for m in range(members):
            t = list(base)
            for _ in range(rnd.integers(0, 6)):
                t[rnd.integers(len(t))] = f"x{rnd.integers(99)}"
            if m % 3 == 0:
                base = t  # a chain of changes
            texts.append(" ".join((passage if f % 2 else []) + t))
    return texts


@pytest.mark.parametrize("width, percent, block", [(3, 90, 128), (5, 80, 8), (1, 50, 4)])
def test_jaccard_components(spark, docs, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    monkeypatch.setattr(jaccard_join, "WIDE_BLOCK", 3 * block)
    if percent == 50:
        monkeypatch.setattr(jaccard_join, "CLASS_RATIO", 2.5)
    rows = [*ROWS, *[(1000 + i, t, "en", "s", 1) for i, t in enumerate(copies(width))]]
    d = spark.createDataFrame(rows, docs.schema).withColumn("node", F.lit("clash")).repartition(4)
    out = jaccard_join.similar_components(d, width, percent).collect()
    sets = plain_sets([r[1] for r in rows], width)
    want, groups = plain_components([r[0] for r in rows], sets, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(
        ((r[0], len(s), c) for r, s, c in zip(rows, sets, want)), key=key)
    kept = jaccard_join.one_of_each(d, width, percent)
    assert kept.columns == d.columns
    got = [r.doc_id for r in kept.collect()]
    assert set(got) >= set(want) - {None}
    assert len(got) == groups + sum(not s for s in sets)


def test_jaccard_without_documents(no_docs):
    assert jaccard_join.similar_components(no_docs, 3, 90).collect() == []
    assert jaccard_join.one_of_each(no_docs).collect() == []


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_digests_lose_no_pair(percent):
    """Pairs at the threshold share a digest, for all sizes."""
    rnd = np.random.default_rng(percent)
    for n in [*range(1, 130), 500, 2000]:
        for _ in range(4):
            x = np.unique(rnd.integers(0, 2 ** 63, n, dtype=np.uint64))
            # y: the most changes that still link
            out, add = 0, 0
            while 100 * (len(x) - out - 1) >= percent * (len(x) + add) and rnd.random() < 0.9:
                out += 1
            while 100 * (len(x) - out) >= percent * (len(x) + add + 1):
                add += 1
            y = np.unique(np.concatenate([rnd.permutation(x)[out:], rnd.integers(0, 2 ** 63, add, dtype=np.uint64)]))
            assert (x.tolist() == y.tolist() or
                    np.intersect1d(jaccard_join.digests(x, percent), jaccard_join.digests(y, percent)).size)


def test_linked_pairs_against_sets():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
    got = jaccard_join.linked_pairs(sets[:30], sets[20:], 60)
    for i, a in enumerate(sets[:30]):
        for j, b in enumerate(sets[20:]):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (100 * len(x & y) >= 60 * len(x | y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1200)] + [(7, 7), (5000, 5001), (5001, 5000),
                                                                                       (6005, 6001), (6005, 6003)]
    got = collections.defaultdict(set)
    for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.label].add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(301)), list(range(1000, 1200)), [5000, 5001],
                                               [6001, 6003, 6005]]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---------------------------------------------------------------- 5 exact dedup
def plain_dedup(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return sorted(((i, max((x for x in ids if x is not None), default=None), len(ids),
                    hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids), key=key)


@pytest.mark.parametrize("bits, options", [(256, None), (256, {"maxFilesPerTrigger": "1"}), (4, None)])
def test_exact_dedup(spark, docs, scratch, bits, options):
    path = f"{scratch}/documents.parquet"
    docs.withColumn("digest", F.lit("clash")).write.parquet(path)
    # a weak digest makes texts collide: full bytes must part them
    digest = exact_dedup.sha256 if bits == 256 else lambda t: F.substring(F.sha2(t, 256), 1, 1)
    out = exact_dedup.exact_dedup(spark, path, digest=digest, source_options=options).collect()
    want = plain_dedup(ROWS)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=key) == sorted((x[:3] for x in want), key=key)
    assert sum(r.kept for r in out) == len({x[3] for x in want})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    if bits == 256:
        assert sorted({(r.digest) for r in out}) == sorted({x[3] for x in want})


def test_exact_dedup_goes_on_with_new_files(spark, docs, scratch):
    path, work = f"{scratch}/documents.parquet", f"{scratch}/work"
    docs.where("doc_id <= 8").write.parquet(path)
    exact_dedup.exact_dedup(spark, path, work=work).collect()
    docs.where("doc_id > 8 or doc_id is null").write.mode("append").parquet(path)
    out = exact_dedup.exact_dedup(spark, path, work=work).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in out), key=key) == plain_dedup(ROWS)


def test_exact_dedup_of_one_file_and_of_none(spark, docs, no_docs, scratch):
    docs.toPandas().to_parquet(f"{scratch}/one.parquet")
    assert len(exact_dedup.exact_dedup(spark, f"{scratch}/one.parquet").collect()) == len(ROWS)
    no_docs.write.parquet(f"{scratch}/none")
    assert exact_dedup.exact_dedup(spark, f"{scratch}/none").collect() == []


# ---------------------------------------------------------------- 4 HTML extraction
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class=home>
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- x <p>no</p> -->
<div class="ad box">Buy</div><div id=page><div class="post-%d"><h1>Title &amp; more</h1><p>One  <b>bold</b>
 text &lt;here&gt;<br>next<p>Two&nbsp;%s<ul><li>i<li>j</ul><form><input>Name</form></div>
<div class="comments"><p>Reader says %s</div></div><aside>Side</aside><div role="contentinfo">Foot</div></body></html>"""
TEXT = "Title & more\nOne bold text <here>\nnext\nTwo %s\ni\nj"


def test_extract_by_wrapper(spark):
    long = "word " * 200
    rows = [(i, f"https://Blog.example.org:80/{i}?x", PAGE % (i, f"{long}{i}", f"{long}{i}")) for i in range(12)]
    rows += [(50, "https://other.org/", "<main><p>a</p></main><footer>f</footer>"), (51, None, "plain &amp; text"),
             (52, "odd", None), (53, "https://other.org/", ""), (54, "https://other.org/x", "<p>un<script>closed"),
             (55, "https://other.org/y", "<nav>only menu</nav>"), (55, "https://other.org/y", "<nav>only menu</nav>")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_extract.main_texts(d.repartition(5)).collect()]
    texts = [(i, u, TEXT % f"{long}{i}") for i, u, _ in rows[:12]]
    texts += [(50, rows[12][1], "a"), (51, None, "plain & text"), (52, "odd", ""), (53, "https://other.org/", ""),
              (54, "https://other.org/x", "un"), (55, "https://other.org/y", ""), (55, "https://other.org/y", "")]
    want = [(i, u, t, len(t)) for i, u, t in texts]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert html_extract.main_texts(d.where("page_id > 99")).collect() == []


def test_wrapper_is_a_union_free_expression():
    def wrap(*pages):
        x = html_extract.aligned([html_extract.expression(html_extract.parse(p)) for p in pages])
        return " ".join(html_extract.show(c) for c in x["c"])
    one = wrap("<body><h1>News</h1><ul><li>a<li>b</ul><p>x</p></body>")
    assert one == "<body> <h1> 'News' </> <ul> (<li> #TEXT </>)+ </> <p> 'x' </> </>"
    two = wrap("<body><h1>News</h1><ul><li>a<li>b</ul><p>x</p></body>", "<body><h1>News</h1><img><ul><li>c</ul><p>y</p></body>")
    assert two == "<body> <h1> 'News' </> (<img> </>)? <ul> (<li> #TEXT </>)+ </> <p> #TEXT </> </>"
    pairs = wrap("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")
    assert pairs == "<dl> (<dt> #TEXT </> <dd> #TEXT </>)+ </>"


def test_wrappers_do_not_depend_on_the_split(spark):
    rows = [(i, "https://h.org/", f"<body>{'<i>x</i>' if i % 3 else ''}<article>{'<p>t' * (i % 5 + 1)}{i}</article></body>")
            for i in range(60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = {n: [html_extract.article_path(json.loads(r.wrapper)) for r in html_extract.wrappers(d.repartition(n)).collect()]
             for n in (1, 4, 13)}
    assert paths == {n: [["body", "article"]] for n in paths}


def test_extract_given_pages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extract.main_texts(d).join(d.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1|br)>", body[1]) if body else []
        lines = (" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in blocks)
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)
