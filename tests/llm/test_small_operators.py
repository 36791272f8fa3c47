"""Line dedup, sharding, mixing, packing, token output and language ID on a
fixture of odd rows, against plain Python."""
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from llm_rows import DOC, EN, FR, ROWS
from pyspark.sql import functions as F

from caravan.llm import language_id, line_dedup, mixing, packing, sharding, token_output, tokens

NULLS = [(None,) * 5]


def key(v):
    return repr(v)


# ---------------------------------------------------------------- 1 line dedup
def plain_line_dedup(rows, ratio):
    strip = lambda x: x.strip(" \t\r\x0b\x0c")
    pages = {(r[3], r[1]) for r in rows if r[1] is not None}
    hosts = collections.Counter(h for h, _ in pages)

    def above(pages, among=None):
        seen = collections.Counter((h, x) for h, t in pages for x in {strip(y) for y in t.split("\n")} if x)
        return {(h, x) for (h, x), n in seen.items() if n >= 2 and n > ratio * hosts[h] and (among is None or (h, x) in among)
                and (n - ratio * hosts[h]) ** 2 > 4 * ratio * (1 - ratio) * hosts[h]}
    first = above(pages)

    def beside(h, t):
        lines = [strip(x) for x in t.split("\n")]
        return 2 * sum(len(x) for x in lines if (h, x) in first) <= sum(map(len, lines))
    cut = above({p for p in pages if beside(*p)}, first)
    out = []
    for r in rows:
        lines = None if r[1] is None else r[1].split("\n")
        keep = None if lines is None else [x for x in lines if (r[3], strip(x)) not in cut]
        out.append((r[0], None if keep is None else "\n".join(keep), len(lines or []), len(lines or []) - len(keep or [])))
    return sorted(out, key=key)


FOOT = "the footer of a site"
LINES = [(k, t, "en", h, 1) for k, (h, t) in enumerate(
    [("copies", f"article {'x ' * 30}\nits second line")] * 12
    + [("copies", f"page {k} {'y ' * 30}\n{FOOT}") for k in range(12)]
    + [("near", f"near {'z ' * 30}\nend {k}") for k in range(12)]
    + [("two", f"first page {'v ' * 20}\n {FOOT}\t"), ("two", f"{FOOT}\nsecond page {'w ' * 20}"), ("alone", FOOT), ("alone", FOOT),
       ("large", f"quoted line\nown {'u ' * 9}"), ("large", f"quoted line\nother {'u ' * 9}")]
    + [("large", f"large {k} {'u ' * 9}\n\n") for k in range(30)])]


def test_line_dedup(docs):
    d = docs.withColumn("host", F.lit("clash")).withColumn("digests", F.lit(1)).withColumn("row", F.lit("r"))
    out = line_dedup.drop_boilerplate_lines(d, F.col("source"), max_ratio=0.3)
    assert out.columns == [*d.columns, "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=key)
    assert got == plain_line_dedup(ROWS, 0.3)


def test_line_dedup_counts_distinct_texts(spark):
    out = line_dedup.drop_boilerplate_lines(spark.createDataFrame(LINES, DOC).repartition(3), F.col("source"))
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=key)
    assert got == plain_line_dedup(LINES, 0.05)
    dropped = {(LINES[i][3], n) for i, _, _, n in got}
    # copies and near copies stay whole, footers go at every size, one page says nothing, two of 32 too little
    assert dropped == {("copies", 0), ("copies", 1), ("near", 0), ("two", 1), ("alone", 0), ("large", 0)}


def test_line_dedup_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "a\nb", "s", 7, "x")], "doc_id long, text string, source string, N_lines long, n_dropped string")
    out = line_dedup.drop_boilerplate_lines(d, F.col("source"))
    assert [tuple(r) for r in out.collect()] == [(1, "a\nb", "s", 2, 0)]
    assert out.columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    kept = line_dedup.drop_boilerplate_lines(d, F.col("source"), counts=False)
    assert [tuple(r) for r in kept.collect()] == [(1, "a\nb", "s", 7, "x")] and kept.columns == d.columns


def test_line_dedup_empty(no_docs):
    assert line_dedup.drop_boilerplate_lines(no_docs, F.col("source")).collect() == []


# ---------------------------------------------------------------- 2 sharding
@pytest.mark.parametrize("n", [1, 3, 24])
def test_sharding(docs, n):
    out = [r.asDict() for r in sharding.shard_by_bytes(docs.withColumn("shard", F.lit("x")), n).collect()]
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=key) == sorted(
        ((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in ROWS), key=key)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    for s in range(n):
        rows = sorted((r for r in out if r["shard"] == s), key=lambda r: r["slot"])
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / n) <= largest
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)  # contiguous in id order


def test_sharding_empty_and_null(spark, docs, no_docs):
    assert sharding.shard_by_bytes(no_docs, 24).collect() == []
    one = sharding.shard_by_bytes(spark.createDataFrame(NULLS, docs.schema), 4).collect()
    assert [(r.doc_id, r.size, r.text_crc32, r.slot) for r in one] == [(None, 8, 0, 0)]


# ---------------------------------------------------------------- 8 mixing
def plain_targets(sizes, max_rate=3, weights=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % weights + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(max_rate * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > max_rate * sizes[s]}
        if not over:
            return {s: max_rate * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= over


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = collections.Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    target, out = plain_targets(by), []
    for r in rows:
        rate = target[r[3]] / by[r[3]] if by[r[3]] else 0
        u = int(hashlib.md5(f"mix-1:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out.append((r[0], r[3], size(r[1]), by[r[3]], round(target[r[3]], 6), int(rate) + (u < rate - int(rate))))
    return sorted(out, key=key)


def test_mixing(docs):
    d = docs.withColumn("size", F.lit("clash")).withColumn("rate", F.lit(7)).withColumn("key", F.lit(7))
    got = sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.copies)
                  for r in mixing.mix(d).collect()), key=key)
    assert got == plain_mix(ROWS)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    taken = {(x[0], x[1]): x[5] for x in got}
    want = collections.Counter()
    for r in ROWS:
        want[(r[0], r[1])] += taken[(r[0], r[3])]
    assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == +want


def test_mixing_plan_is_native(docs, capsys):
    mixing.mixed_documents(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_mixing_empty(spark, docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []
    assert [r.copies for r in mixing.mix(spark.createDataFrame(NULLS, docs.schema)).collect()] == [0]


# ---------------------------------------------------------------- tokens, 9, 10
def whole_text_ids(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokens.default_tokenizer())
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_word_ids_equal_whole_text_ids():
    import random
    rnd = random.Random(5)
    chars = "aAbzS'.,,;!-09 \n\té́́ÉΣσß»İ \u0085\x1c😀<|>½²٣_ǅ"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += [r[1] for r in ROWS] + ["a <|endoftext|> b", "x<|ENDOFTEXT|>y.", "don't. we'll, it's"]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.WordIds(tokens.default_tokenizer()).of(texts)]
    assert got == whole_text_ids(texts)


def test_word_ids_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 40)
    texts = [r[1] for r in ROWS]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.WordIds(tokens.default_tokenizer()).of(texts)]
    assert got == whole_text_ids(texts)


def test_word_ids_refuses_tokenizers_with_white_space():
    import public_tokenizers
    with pytest.raises(ValueError):
        tokens.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype("<u4")
    packed = token_output.pack(ids, bits)
    assert len(packed) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (0, 0), (3, 4), (17, 801), (999, 1000)):
        assert token_output.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


@pytest.mark.parametrize("block_ids", [7, 1 << 18])
def test_token_output(spark, docs, scratch, block_ids):
    path = f"{scratch}/tokens"
    token_output.write_tokens(docs.withColumn("part", F.lit("x")), path, block_ids=block_ids)
    got = sorted((r.asDict() for r in token_output.read_tokens(spark, path, with_ids=True).collect()),
                 key=lambda r: r["start"])
    rows = sorted(ROWS, key=lambda r: (-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode())))
    ids = [x + [2] for x in whole_text_ids(r[1] for r in rows)]
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    assert [r["ids"] for r in got] == ids
    assert [r["start"] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r["n_tokens"] for r in got] == [len(x) for x in ids]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    some = token_output.read_tokens(spark, path, where="first_doc <= 9 and last_doc >= 9").where("doc_id = 9")
    assert [(r.doc_id, r.n_tokens) for r in some.collect()] == [(9, len(ids[[r[0] for r in rows].index(9)]))]


def test_token_output_empty(spark, no_docs, scratch):
    token_output.write_tokens(no_docs, f"{scratch}/none")
    assert token_output.read_tokens(spark, f"{scratch}/none").collect() == []


def packed_well(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(docs, capacity):
    out = [r.asDict() for r in packing.pack_documents(docs.withColumn("rank", F.lit("x")), capacity=capacity).collect()]
    want = []
    for r, ids in zip(ROWS, whole_text_ids(r[1] for r in ROWS)):
        ids = ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a:a + capacity]
            want.append((r[0], k, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert packed_well(out, capacity) <= 1.25 * -(-sum(r["length"] for r in out) // capacity) + 1


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole_and_tight(seed):
    rnd = np.random.default_rng(seed)
    lengths = np.clip(rnd.lognormal(5 + seed % 4, 1.1, 20_000).astype(int), 1, 2048)
    hist = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.make_plan(hist)
    ranks, used = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, n, first, offset in plan.rows:
        ranks[length].append((rank, n))
        for k in range(n):
            used[first + k].append((offset, length))
    for length, n in hist.items():
        at = 0
        for rank, m in sorted(ranks[length]):
            assert rank == at
            at += m
        assert at == n
    packed_well([{"sequence_id": s, "offset": o, "length": x} for s, v in used.items() for o, x in v], 2048)
    assert len(used) == plan.n_sequences
    assert plan.n_sequences <= 1.06 * sum(k * n for k, n in hist.items()) / 2048 + 1


def test_linear_groups_have_equal_cardinality():
    groups = packing.linear_groups({9: 3, 8: 1, 5: 4, 2: 4}, 4)
    assert [(s, [tuple(r) for r in runs]) for s, runs in groups] == [
        (9, [(9, 0, 3)]), (8, [(8, 0, 1), (5, 0, 2)]), (5, [(5, 2, 2), (2, 0, 1)]), (2, [(2, 1, 3)])]


# ---------------------------------------------------------------- 7 language ID
def test_trigrams_ignore_other_characters():
    a, b = language_id.trigrams("  The, cat!! 12"), language_id.trigrams("the cat")
    assert a.tolist() == b.tolist() and len(a) == 7
    assert not len(language_id.trigrams("12 !")) and not len(language_id.trigrams(None))


def test_infer_against_plain_em():
    rnd = np.random.default_rng(3)
    p = rnd.dirichlet(np.ones(50) * 0.2, 3).T + 1e-4
    n = np.round(400 * (0.7 * p[:, 0] + 0.3 * p[:, 2]))
    mix = language_id.infer(p, n)
    assert set(mix) == {0, 2} and abs(sum(mix.values()) - 1) < 1e-3
    grid = np.linspace(0, 1, 1001)[1:-1]
    like = [n @ np.log(g * p[:, 0] + (1 - g) * p[:, 2]) for g in grid]
    assert abs(mix[0] - grid[int(np.argmax(like))]) < 0.02


def test_infer_against_all_language_sets():
    """A few hundred documents of one to three of five languages: the set chosen is
    the best of all sets by penalised likelihood (proportions by a long EM)."""
    import itertools
    rnd = np.random.default_rng(9)
    p = rnd.dirichlet(np.ones(80) * 0.3, 5).T + 1e-4
    p /= p.sum(axis=0)

    def value(s, n):
        pi = np.ones(len(s)) / len(s)
        for _ in range(400):
            pi = pi * ((n / (p[:, s] @ pi)) @ p[:, s]) / n.sum()
        return n @ np.log(p[:, s] @ pi) - language_id.PENALTY * np.log(n.sum() + 1) * (len(s) - 1), pi
    sets = [list(s) for k in range(1, 6) for s in itertools.combinations(range(5), k)]
    same = 0
    for _ in range(300):
        true = rnd.choice(5, rnd.integers(1, 4), replace=False)
        mix = p[:, true] @ rnd.dirichlet(np.ones(len(true)) * 3)
        n = rnd.multinomial(int(rnd.integers(20, 900)), mix / mix.sum()).astype(float)
        at = np.flatnonzero(n)
        got = language_id.infer(p[at], n[at])
        best = max(sets, key=lambda s: value(s, n)[0])
        loss = value(best, n)[0] - value(sorted(got), n)[0]
        same += sorted(got) == best
        assert loss < 1.0 or sorted(got) != best and loss < 3  # a greedy choice may miss by little
    assert same >= 294


def test_rare_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    rows = [(t, lang) for lang, t, k in (("en", EN, 5), ("fr", FR, 4), ("dirty", "x y z", 3)) for _ in range(k)]
    langs, table = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["en", "fr"] and table.shape == (language_id.BUCKETS, 2)


def test_language_id(spark, docs):
    more = [(100 + i, " ".join(w.split()[i % 7:] * 3), "en" if w is EN else "fr", "s", 1)
            for i in range(40) for w in (EN, FR)]
    d = spark.createDataFrame([*ROWS, *more], docs.schema).withColumn("score", F.lit("clash"))
    d = d.withColumn("lang_pred", F.lit("x"))
    out = language_id.identify(d).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(out) == len(ROWS) + len(more)
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i in (4, 5, 6, 13):
        assert [(r.lang_pred, r.score) for r in by[i]] == [("und", 0.0)]
    assert {r.lang_pred for r in by[7] + by[8]} == {"en"} and by[9][0].lang_pred == "fr"
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    kept = language_id.in_one_language(d)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({4, 5, 6, 13})
    assert kept.count() == len(out) - 4


def test_language_id_without_training_rows(spark, docs, no_docs):
    assert language_id.identify(no_docs).collect() == []
    d = spark.createDataFrame([(1, "the cat", None, "s", 1), *NULLS], docs.schema)
    assert {(r.lang_pred, r.score) for r in language_id.identify(d).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.98
