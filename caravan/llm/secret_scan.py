"""Operator 12, secret scans by grammar inference.

Fixed patterns find the plain cases (``base_spans``): assignments to a name that
tells a secret, access keys, long hex strings. Their values are the labelled
credentials. From them a probabilistic automaton is inferred for each kind: the
values form a prefix tree, and states whose ends and next characters do not
differ significantly (Hoeffding bound at ``ALPHA``, checked down to all common
continuations) are merged, the best attested first. One more automaton is inferred from
plain tokens, those outside of every base span.

Then every token of every text is scored. It is a secret if under some kind

* its mean log likelihood a character reaches what all but the lowest hundredth
  of the labelled values reach, and
* its log likelihood, plus the log of the kind's number of values, exceeds that
  of plain tokens by ``MARGIN``.

Such tokens are added to the base spans (kind: the one most likely); tokens that
touch a base span are not looked at again.

The labelled values and plain tokens that automata are fitted to are a sample:
one value (smallest hash) for each of ``SLOTS`` hash slots and kind, of at most
``MAX_VALUE`` characters. Numbers of values are counted over all texts, and all
texts are scored whole.

Defined results: a null or empty text has no spans; rows that repeat an id or a
text are rows of their own; a null id stays null; without labelled values only
base spans come out; an empty table gives no rows; other columns are not read.
Places are code points, ends exclusive.

Scale: two row-wise passes. Between them one row per (kind, slot) and batch is
aggregated, so what is shuffled and fitted does not grow with the texts; the
automata (a few hundred states) go to the tasks as closures.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caravan.llm.common import scratch_table, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex")
PLAIN = "plain"
# fixed patterns and lengths of the base spans
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the same as all maximal stretches, the shorter ones dropped
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20

TOKEN = re.compile(r"[A-Za-z0-9+/_.-]{8,}=*")
TOKEN_LENGTH = 8
SYMBOLS = 26 + 26 + 10 + 6  # characters a token can hold, and its end
SLOTS = 8192
MAX_VALUE = 200
ALPHA = 0.05
SMOOTHING = 0.05
MARGIN = 6.0
CACHE = 200_000  # scored tokens a worker remembers

SPANS = "array<struct<start: bigint, end: bigint, kind: string, base: boolean>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                             ("base", pa.bool_())]))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what the fixed patterns find."""
    out = []
    if ":" in text or "=" in text:  # an assignment needs one of them
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


def bare(token: str) -> str:
    """A token without the punctuation around it."""
    return token.strip(".-")


def outside(text: str, spans: list):
    """(start, token) of the tokens that touch no span."""
    taken = sorted((s[0], s[1]) for s in spans)
    for m in TOKEN.finditer(text):
        t = bare(m[0])
        if len(t) >= TOKEN_LENGTH and not any(s < m.end() and m.start() < e for s, e in taken):
            yield m.start() + m[0].index(t), t


# ---------------------------------------------------------------- labelled values
def _slot(value: str) -> tuple[int, int]:
    h = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big") >> 1
    return h % SLOTS, h


def _gather(batches):
    """(kind, slot, h, value, n): for each kind the value with the smallest hash
    of each slot; n counts the values (with the first slot)."""
    for b in batches:
        best: dict[tuple[str, int], tuple[int, str]] = {}
        n: dict[str, int] = defaultdict(int)
        seen: set[tuple[str, str]] = set()

        def take(kind: str, value: str) -> None:
            n[kind] += 1
            if len(value) > MAX_VALUE or (kind, value) in seen:
                return
            if len(seen) > CACHE:
                seen.clear()
            seen.add((kind, value))
            slot, h = _slot(value)
            if (kind, slot) not in best or (h, value) < best[kind, slot]:
                best[kind, slot] = (h, value)

        for text in b.column(1).to_pylist():
            spans = base_spans(text)
            for _, _, kind, value in spans:
                take(kind, value)
            if spans:
                plain = [t for _, t in outside(text, spans)]
            else:
                plain = [t for t in map(bare, TOKEN.findall(text)) if len(t) >= TOKEN_LENGTH]
            for t in plain:
                take(PLAIN, t)
        rows = [(k, s, h, v, 0) for (k, s), (h, v) in best.items()] + [(k, -1, 0, "", c) for k, c in n.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "slot", "h", "value", "n"), r, strict=True)) for r in rows],
                                         schema=_GATHERED)


_GATHERED = pa.schema([("kind", pa.string()), ("slot", pa.int32()), ("h", pa.int64()), ("value", pa.string()),
                       ("n", pa.int64())])


# ---------------------------------------------------------------- inference
class Automaton:
    """Frequency automaton: per state the number of values that end there and,
    per character, how many go on and where to."""

    def __init__(self, values: list[str]):
        self.end, self.n, self.to, self.count = [0], [0], [{}], [{}]
        for v in values:
            at = 0
            self.n[0] += 1
            for c in v:
                if c not in self.to[at]:
                    self.to[at][c] = len(self.n)
                    for table, empty in ((self.end, 0), (self.n, 0), (self.to, {}), (self.count, {})):
                        table.append(empty)
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.to[at][c]
                self.n[at] += 1
            self.end[at] += 1
        self._merge_states()

    def _differ(self, a: int, b: int) -> bool:
        na, nb = self.n[a], self.n[b]
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (na ** -0.5 + nb ** -0.5)
        if bound >= 1:
            return False
        ca, cb = self.count[a], self.count[b]
        return abs(self.end[a] / na - self.end[b] / nb) > bound or any(
            abs(ca.get(c, 0) / na - cb.get(c, 0) / nb) > bound for c in {*ca, *cb})

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if self._differ(x, y):
                return False
            todo += [(self.to[x][c], k) for c, k in self.to[y].items() if c in self.to[x]]
        return True

    def _distance(self, a: int, b: int) -> float:
        ca, cb, na, nb = self.count[a], self.count[b], self.n[a], self.n[b]
        return abs(self.end[a] / na - self.end[b] / nb) + sum(
            abs(ca.get(c, 0) / na - cb.get(c, 0) / nb) for c in {*ca, *cb})

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to state a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.end[x] += self.end[y]
            self.n[x] += self.n[y]
            for c, k in self.to[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + self.count[y][c]
                if c in self.to[x]:
                    todo.append((self.to[x][c], k))
                else:
                    self.to[x][c] = k

    def _merge_states(self) -> None:
        """Keeps a core of states; the best attested state next to it is merged
        with the closest compatible one of the core or joins it."""
        core, kept = [0], {0}
        while True:
            fringe = [(-self.n[k], k, s, c) for s in core for c, k in self.to[s].items() if k not in kept]
            if not fringe:
                break
            _, k, s, c = min(fringe)
            fits = [x for x in core if self._compatible(x, k)]
            if fits:
                x = min(fits, key=lambda x: (self._distance(x, k), x))
                self.to[s][c] = x
                self._fold(x, k)
            else:
                core.append(k)
                kept.add(k)
        name = {s: i for i, s in enumerate(core)}
        self.end, self.n = [self.end[s] for s in core], [self.n[s] for s in core]
        self.count = [self.count[s] for s in core]
        self.to = [{c: name[k] for c, k in self.to[s].items()} for s in core]

    def log_table(self) -> list:
        """Per state: ({character: (log probability, next state)}, log
        probability of any other character, of the end)."""
        out = []
        for end, n, count, to in zip(self.end, self.n, self.count, self.to, strict=True):
            whole = n + SMOOTHING * SYMBOLS
            out.append(({c: (math.log((k + SMOOTHING) / whole), to[c]) for c, k in count.items()},
                        math.log(SMOOTHING / whole), math.log((end + SMOOTHING) / whole)))
        return out


def log_likelihood(table: list, value: str) -> float:
    """A character that a state does not know leads back to the start."""
    at, total = 0, 0.0
    for c in value:
        known, other, _ = table[at]
        p, at = known.get(c, (other, 0))
        total += p
    return total + table[at][2]


def _learn(pdf: pd.DataFrame) -> pd.DataFrame:
    values = sorted(pdf["value"])
    table = Automaton(values).log_table()
    typical = sorted(log_likelihood(table, v) / (len(v) + 1) for v in values)
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "model": [json.dumps([table, typical[len(typical) // 100]])]})


def learn(rows: DataFrame) -> dict:
    """kind -> (automaton, lowest typical log likelihood, number of values) from
    (doc_id, text)."""
    found = rows.mapInArrow(_gather, "kind string, slot int, h long, value string, n long")
    best = scratch_table(found.groupBy("kind", "slot").agg(
        F.min(F.struct("h", "value")).alias("best"), F.sum("n").alias("n")), "secret-values")
    n = {r["kind"]: r["n"] for r in best.where("slot = -1").collect()}
    models = best.where("slot >= 0").select("kind", F.col("best.value").alias("value")).groupBy("kind").applyInPandas(
        _learn, "kind string, model string").collect()
    return {r["kind"]: (*json.loads(r["model"]), n[r["kind"]]) for r in models}


# ---------------------------------------------------------------- scoring
def judge(models: dict, token: str) -> str | None:
    """The kind of a token that is a secret, or None."""
    best = None
    plain = log_likelihood(models[PLAIN][0], token) + math.log(models[PLAIN][2]) if PLAIN in models else -math.inf
    for kind in KINDS:
        if kind not in models:
            continue
        table, floor, n = models[kind]
        score = log_likelihood(table, token)
        if score / (len(token) + 1) >= floor and score + math.log(n) > plain + MARGIN:
            if best is None or score + math.log(n) > best[0]:
                best = (score + math.log(n), kind)
    return best and best[1]


def _scan(models: dict):
    labelled = any(k in models for k in KINDS)

    def run(batches):
        known: dict[str, str | None] = {}

        def kind_of(token: str) -> str | None:
            if token not in known:
                if len(known) >= CACHE:
                    known.clear()
                known[token] = judge(models, token)
            return known[token]

        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                spans = [(s, KINDS.index(k), e, True) for s, e, k, _ in base]
                if labelled and any(kind_of(t) for t in set(map(bare, TOKEN.findall(text))) if len(t) >= TOKEN_LENGTH):
                    for s, t in outside(text, base):
                        k = kind_of(t)
                        if k:
                            spans.append((s, KINDS.index(k), s + len(t), False))
                out.append([{"start": s, "end": e, "kind": KINDS[k], "base": is_base}
                            for s, k, e, is_base in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (start, end, kind, base; by start,
    then kind as in ``KINDS``)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scan(learn(rows)), f"doc_id long, spans {SPANS}")


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
