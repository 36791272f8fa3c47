"""Token ids of whole texts with a public tokenizer file that drops white space.

Such a tokenizer's pattern never joins characters across white space, so the ids
of a text are those of its words in a row (``tests/llm`` holds this against
whole-text encoding, and ``WordIds`` refuses a file for which it is not so).
Words repeat, so each Python worker keeps the ids of the words it met lately: a
bounded cache, which changes the time and never the ids. A new word of letters
goes straight to the tokenizer's BPE model, one of letters and then marks as
these two; any other goes through the tokenizer's whole pipeline.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHE_WORDS = 500_000  # per generation; two generations are kept
CHUNK_BYTES = 1 << 18  # texts whose unknown words are encoded together
# Letters, then ASCII marks but the apostrophe (which the pattern treats apart).
_LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_PROBE = "One two,  three's\n'tis ÉTÉ. 4five <|x ...a.b c"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """word (bytes) -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        whole = self.tok.encode(_PROBE, add_special_tokens=False).ids
        if b"".join(self.of([_PROBE])) != struct.pack(f"<{len(whole)}I", *whole):
            raise ValueError(f"{path}: its ids do not depend on words alone")

    def _simple(self, s: str) -> bytes:
        """Ids of one run of letters or of ASCII marks."""
        if not s.isascii():
            s = self.byte_level.pre_tokenize_str(s)[0][0]
        ids = [t.id for t in self.model.tokenize(s)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, s: str) -> bytes:
        w = s.encode()
        ids = self.new.get(w)
        if ids is None:
            ids = self.old.get(w)
            if ids is None:
                ids = self._simple(s)
            self.new[w] = ids
        return ids

    def _learn(self, words: set[bytes]) -> None:
        rest = []
        for w in words:
            if (known := self.old.get(w)) is not None:
                self.new[w] = known
                continue
            s = w.decode()
            m = _LETTERS_MARKS.fullmatch(s)
            if m and (s.isascii() or m[1].isalpha() and unicodedata.is_normalized("NFC", s)) and m[1].lower() == m[1]:
                self.new[w] = self._part(m[1]) + (self._part(m[2]) if m[2] else b"")
            else:
                rest.append(w)
        for k in range(0, len(rest), 2000):
            part = rest[k:k + 2000]
            e = self.tok.encode([w.decode() for w in part], is_pretokenized=True, add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in part]
            for i, at in zip(e.ids, e.word_ids, strict=True):
                ids[at].append(i)
            for w, x in zip(part, ids, strict=True):
                self.new[w] = struct.pack(f"<{len(x)}I", *x)

    def of(self, texts):
        """Yields the ids of each text (str or None: empty), in order."""
        chunk, size, need = [], 0, set()
        for t in texts:
            b = (t or "").encode()
            if b"<|" not in b:  # special tokens are told by case; all else is lower-cased anyway
                b = b.lower()
            words = b.split()
            ids = list(map(self.new.get, words))
            if None in ids:
                need.update(w for w, x in zip(words, ids, strict=True) if x is None)
            chunk.append((words, ids))
            size += len(b)
            if size >= CHUNK_BYTES:
                yield from self._filled(chunk, need)
                chunk, size, need = [], 0, set()
        yield from self._filled(chunk, need)

    def _filled(self, chunk: list[tuple[list, list]], need: set[bytes]):
        """The chunk's ids, once its unknown words are learned."""
        self._learn(need)
        new = self.new
        for words, ids in chunk:
            yield b"".join([new[w] if x is None else x for w, x in zip(words, ids, strict=True)] if None in ids else ids)
        if len(new) > CACHE_WORDS:
            self.old, self.new = new, {}


def word_ids(path: str) -> WordIds:
    """This worker's cache for a tokenizer file; it outlives a task, since the
    worker process does. A worker keeps one cache: the next operator's replaces it."""
    name, cache = sys.__dict__.get("_caravan_cache", (None, None))
    if name != path:
        sys.__dict__["_caravan_cache"] = (None, None)
        cache = WordIds(path)
        sys.__dict__["_caravan_cache"] = (path, cache)
    return cache
