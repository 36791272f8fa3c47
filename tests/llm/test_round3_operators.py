"""Hard negatives, secret scans and periodic runs against plain versions."""
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caravan.llm import hard_negatives as H
from caravan.llm import periodic_runs as R
from caravan.llm import queries, secret_scan as S
from llm_rows import DOC, ROWS

VEC = "vec_id long, embedding array<float>, label int, score string, rank int"


# ---------------------------------------------------------------- 11
def plain_negatives(rows, every, k=5, m=5, percent=80, scale=256):
    sound = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        sound.append((i, label, [int(np.floor(scale * float(np.float32(x)))) for x in v]))

    def score(a, b):
        s = sum(x * y for x, y in zip(a[2], b[2]))
        return max(min(s, 2 ** 63 - 1), -2 ** 63)
    out = []
    for n, a in enumerate(sound):
        if a[0] % every:
            continue
        others = [(score(a, b), b[0], b[1]) for j, b in enumerate(sound) if j != n]
        best = sorted(((s, i) for s, i, label in others if label == a[1]), key=lambda x: (-x[0], x[1]))[:k]
        wrong = sorted(((s, i) for s, i, label in others if label != a[1]), key=lambda x: (-x[0], x[1]))
        for s, p in best:
            fits = [(t, i) for t, i in wrong if percent * s <= 100 * t <= 100 * s][:m]
            out += [(a[0], p, r, i, s, t) for r, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def _vectors(rnd, n, width=6):
    rows, common = [], [0.5] * width
    for i in range(n):
        v = [rnd.gauss(0, 1) * rnd.choice([0.1, 1, 5]) for _ in range(width)]
        if i % 3 == 0:
            v = common  # a third of all rows is one vector
        rows.append((i, v, rnd.randrange(3), "x", 1))
    return rows


def test_hard_negatives_against_plain(spark, monkeypatch):
    monkeypatch.setattr(H, "BUCKET", 16)
    monkeypatch.setattr(H, "ANCHORS", 4)
    rnd = random.Random(5)
    rows = _vectors(rnd, 150)
    rows += [(200, None, 1, "x", 1), (204, [1.0, None], 1, "x", 1), (208, [float("nan")] * 6, 1, "x", 1),
             (212, [float("inf")] * 6, 1, "x", 1), (216, [], 1, "x", 1), (220, [1.0] * 6, None, "x", 1),
             (None, [1.0] * 6, 1, "x", 1), (224, [1.0, 2.0], 1, "x", 1), (228, [0.0] * 6, 2, "x", 1),
             (232, [-1.0] * 6, 9, "x", 1)]
    df = spark.createDataFrame(rows, VEC).repartition(5)
    got = sorted(tuple(r) for r in H.hard_negatives(df, 4).collect())
    assert got == plain_negatives(rows, 4) and got


def test_hard_negatives_of_repeated_ids_and_huge_vectors(spark):
    rows = [(0, [3.0, 1.0], 1, "", 0), (0, [1.0, 3.0], 1, "", 0), (1, [2.0, 2.0], 2, "", 0), (1, [2.0, 2.0], 2, "", 0),
            (2, [2.0, 1.9], 1, "", 0), (100, [3e37, 1.0], 1, "", 0), (3, [2e37, 1.0], 1, "", 0), (4, [2e37, 1.0], 2, "", 0)]
    got = sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, VEC), 100).collect())
    assert got == plain_negatives(rows, 100)
    assert any(r[4] == 2 ** 63 - 1 for r in got)


def test_hard_negatives_of_nothing(spark):
    empty = H.hard_negatives(spark.createDataFrame([], VEC), 100)
    assert empty.collect() == [] and empty.columns[0] == "anchor_id"
    alone = spark.createDataFrame([(0, [1.0], 1, "", 0), (1, [1.0], 2, "", 0)], VEC)
    assert H.hard_negatives(alone, 100).collect() == []


def test_coordinate_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x *= rng.uniform(0.9, 1.0, size=(400, 1)) / np.sqrt((x * x).sum(axis=1))[:, None]  # of like length
    bucket, left = H.Bucket(x), 0
    for q in rng.normal(size=(60, 8)):
        s = x @ q
        for low in (0.7 * s.max(), 0.95 * s.max()):
            found = bucket.candidates(q, low)
            assert set(np.flatnonzero(s >= low)) <= set(found.tolist())
            left += len(found)
    assert left < 0.4 * 60 * 2 * 400


# ---------------------------------------------------------------- 12
def plain_base(text):
    out = []
    for kind, pattern, group, least in (
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def _secret_docs():
    rnd = random.Random(11)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(40)) for _ in range(260)]
    keys = ["AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(260)]
    words = ["".join(rnd.choice(["ation", "ing", "the", "er", "con", "pro", "ment"]) for _ in range(4)) for _ in range(400)]
    rows = [(i, f"é {rnd.choice(words)} token = \"{h}\" {rnd.choice(words)} x {k}", "en", "s", 1)
            for i, (h, k) in enumerate(zip(hexes[:200], keys[:200]))]
    rows += [(1000 + i, " ".join(rnd.choice(words) for _ in range(30)), "en", "s", 1) for i in range(200)]
    rows += [(2000, f"mail from {words[0]}: Password:hunter2 API_KEY = 'abc' apikey=abcdef0", "en", "s", 1),
             (2001, "AKIA123 akia and deadbeef", "en", "s", 1), (2002, "ſecret=abcdefgh", "en", "s", 1)]
    return rows, hexes, keys, words


def test_secret_scan_base_spans_stay(spark):
    rows, *_ = _secret_docs()
    rows = rows + [tuple(r) for r in ROWS]
    found = S.find_secrets(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    assert len(found) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append([s for s in plain_base(t or "")])
    for r in found:
        base = [(s["start"], s["end"], s["kind"]) for s in r["spans"] if s["base"]]
        assert base in texts[r["doc_id"]]
        assert [s["start"] for s in r["spans"]] == sorted(s["start"] for s in r["spans"])


def test_inferred_formats_add_what_patterns_miss(spark):
    rows, hexes, keys, words = _secret_docs()
    rows += [(3000 + i, f"seen {words[i]} here {keys[200 + i][:19]}", "en", "s", 1) for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in S.find_secrets(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    added = [s for i in range(60) for s in found[3000 + i] if not s["base"]]
    assert len(added) > 30 and all(s["kind"] == "access" for s in added)  # keys one character too short for the pattern
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[3000 + i][s["start"]:s["end"]] == keys[200 + i][:19] for i in range(60) for s in found[3000 + i])
    assert not any(found[1000 + i] for i in range(200)), "plain words are no secrets"


def test_merged_states():
    one = S.Automaton(["ab" * n for n in range(1, 200)])
    assert len(one.n) < 10 and sum(one.end) == 199  # a loop, not a tree of 400 states
    fixed = S.Automaton(["AKIA" + c for c in "BCDEFGHIJKLMNOP" * 40])
    assert [sorted(t) for t in fixed.to][0] == ["A"] and fixed.n[0] == 600
    table = fixed.log_table()
    assert S.log_likelihood(table, "AKIAB") > S.log_likelihood(table, "BAKIA") + 5
    assert S.Automaton([]).n == [0]


def test_secret_scan_without_labels_or_rows(spark):
    plain = spark.createDataFrame([(1, "only some ordinary words", "en", "s", 1), (2, None, None, None, None)], DOC)
    assert [r["spans"] for r in S.find_secrets(plain).collect()] == [[], []]
    assert S.find_secrets(spark.createDataFrame([], DOC)).collect() == []


def test_secret_query(spark, tmp_path):
    rows, *_ = _secret_docs()
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    for r in queries.op12_secret_scan(spark, str(tmp_path)).collect():
        base = plain_base(texts[r["doc_id"]])
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(b[2] == k for b in base) for k in S.KINDS)
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))


# ---------------------------------------------------------------- 13
def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            long = i + q - s
            piece = w[s:s + long]
            if long >= max(6, 4 * q) and not any(piece[p:] == piece[:-p] for p in range(1, q)):
                out.append((s, long, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random_words(rnd):
    n, k = rnd.randint(0, 90), rnd.choice([1, 2, 2, 3, 5, 30])
    w = [f"w{rnd.randrange(k)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 8:
            a, p = rnd.randrange(n), rnd.randint(1, 12)
            for i in range(a, min(n, a + rnd.randint(1, 60))):
                w[i] = w[a + (i - a) % p]
    return w


def test_periodic_runs_against_plain(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE_WORDS", 400)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([" ", "\n", " \t "]).join(_random_words(rnd)), "en", "s", 1) for i in range(1200)]
    rows += [(5000, "a " * 3000 + "b " * 3000, "en", "s", 1), (5001, "x y\u00a0z " * 500, "en", "s", 1)]
    found = {r["doc_id"]: r for r in R.periodic_runs(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    some = 0
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = plain_runs(w) if len(w) < 1000 else [tuple(r) for r in found[i]["runs"]]
        some += len(runs)
        assert [tuple(r) for r in found[i]["runs"]] == runs
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert found[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert some > 500
    assert [tuple(r) for r in found[5000]["runs"]] == [(0, 3000, 1), (3000, 3000, 1)]
    assert [tuple(r) for r in found[5001]["runs"]] == [(0, 1000, 2)]  # U+00A0 ends no word


def test_lag_scan_of_long_segments():
    for w in (list("ab" * 3000) + list("abc" * 2000), [0, 1] * 5 + [0] * 9 + [1, 0, 0] * 40):
        assert sorted(R.lag_scan(np.unique(w, return_inverse=True)[1]), key=lambda r: (r[0], r[2])) == plain_runs(w)


def test_periodic_query_against_plain(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(_random_words(rnd)), "en", "s", 1) for i in range(400)] + [tuple(r) for r in ROWS]
    rows = [r for r in rows if r[0] != 12] + [(-7, "a b " * 20, "en", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}

        def sha(t):
            return hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
                     sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
                     sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_periodic_runs_of_nothing(spark):
    assert R.periodic_runs(spark.createDataFrame([], DOC)).collect() == []
    none = R.periodic_runs(spark.createDataFrame([(None, None, None, None, None)], DOC)).collect()
    assert [tuple(r) for r in none] == [(None, [], "")]


def test_clashing_columns(spark):
    kind = T.StructType([*DOC.fields, T.StructField("spans", T.StringType()), T.StructField("runs", T.StringType()),
                         T.StructField("words", T.StringType()), T.StructField("collapsed", T.StringType())])
    df = spark.createDataFrame([(1, "a " * 9, "en", "s", 1, "x", "x", "x", "x")], kind)
    assert S.find_secrets(df).first()["spans"] == []
    assert R.periodic_runs(df).select(F.size("runs")).first()[0] == 1
