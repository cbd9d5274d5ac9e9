"""Token counts by rank-synchronous array merging.

Pre-tokens of a whole batch lie in one flat symbol array with segment bounds.
Each round finds the lowest-rank pair of every segment and merges all its
occurrences in all segments at once; finished segments leave the array.  What
survives are the tokens.  Equal chunks between white space are merged once per
worker and then looked up, as they dominate any corpus.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import memory, parts

#: Longer chunks are not remembered by a worker.
LONG_CHUNK = 64
#: Chunks that a worker remembers: over 100 bytes each, so less than 100 MB.
CHUNKS = 400_000
#: What may follow the letters of a word and is one pre-token by itself.
MARKS = frozenset(".,;:!?)")
NEVER = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class MergeTable:
    """A BPE vocabulary of the ``tokenizers`` JSON format as numpy arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.spaces = regex.compile(r"\s+").split
        self.memory = f"chunks of {path}"
        self.path, self._library = path, None
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Up to U+02FF, NFC changes nothing and lower case is by character; the
        # separators U+001C to U+001F are white space to Python alone.
        self.odd = re.compile("[\x1c-\x1f\u0300-\U0010ffff]").search
        # Unicode versions differ in which marks they reorder: those after 3.2 are the library's to judge.
        old = unicodedata.ucd_3_2_0.combining
        new_marks = [chr(c) for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)) and not old(chr(c))]
        self.new_marks = re.compile("[" + "".join(new_marks) + "]").search

    def by_library(self, text: str) -> bytes:
        """The ids of a text that only the library can judge; it is loaded for the first of them."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ranks(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The rank of the pairs that begin at these symbols."""
        after = np.minimum(at + 1, len(sym) - 1)
        key = np.where((seq[at] == seq[after]) & (after > at), sym[at] * self.size + sym[after], -1)
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[found] == key, self.rank[found], NEVER)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and how many each word has."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], dtype=np.int64)
        byte = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym, end = self.inner[byte], np.cumsum(size)
        sym[end - 1] = self.last[byte[end - 1]]
        seq = np.repeat(np.arange(len(words)), size)
        rank = self.ranks(sym, seq, np.arange(len(sym)))
        done_sym, done_seq = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            span = np.diff(np.r_[first, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, first), span)
            open_ = low != NEVER
            if not open_.all():
                done_sym.append(sym[~open_])
                done_seq.append(seq[~open_])
                sym, seq, rank, low = sym[open_], seq[open_], rank[open_], low[open_]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            if len(at) > 1:  # of overlapping pairs of one symbol, every other one counts
                new_run = np.r_[True, np.diff(at) != 1]
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            stays = np.ones(len(sym), dtype=bool)
            stays[at + 1] = False
            now = np.cumsum(stays)[at] - 1
            sym, seq, rank = sym[stays], seq[stays], rank[stays]
            touched = np.concatenate([now, np.maximum(now - 1, 0)])  # only these pairs are new
            rank[touched] = self.ranks(sym, seq, touched)
        sym, seq = np.concatenate(done_sym or [sym]), np.concatenate(done_seq or [seq])
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=len(words))

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of chunks between white space."""
        letters = lambda c: c.isalpha() and (c.isascii() or not self.odd(c))  # one pre-token; up to U+02FF all know the same letters
        whole = set(filter(letters, new))
        ended = [c for c in new if c[-1] in MARKS and letters(c[:-1])]  # two
        parts = {c: self.split(c) for c in new.difference(whole, ended)}
        words = list(whole.union([c[:-1] for c in ended], [c[-1] for c in ended], *parts.values()))
        if not words:
            return dict.fromkeys(new, b"")
        ids, n = self.merge(words)
        flat, stop = ids.astype("<u4").tobytes(), (np.cumsum(n) * 4).tolist()
        by_word = {w: flat[b:e] for w, b, e in zip(words, [0, *stop], stop, strict=False)}
        out = {c: by_word[c] for c in whole} | {c: by_word[c[:-1]] + by_word[c[-1]] for c in ended}
        return out | {c: b"".join([by_word[w] for w in p]) for c, p in parts.items()}

    def chunks(self, text: str | None) -> list[str] | None:
        """What lies between white space, normalised like the library does; None if a special string, a recent mark or an unassigned character is in it."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return None
        if not self.odd(text):
            return text.lower().split()
        if self.new_marks(text) or any(unicodedata.category(c) == "Cn" for c in set(text)):  # letters to one library may be nothing to another
            return None
        normal = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")  # a capital sigma has one lower case, also at the end of a word
        return [c for c in self.spaces(normal.lower()) if c]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids = memory(self.memory, CHUNKS)
        chunks = [self.chunks(t) for t in texts]
        fresh = self.learn(set().union(*filter(None, chunks)).difference(ids))
        ids.update(fresh)
        get = ids.__getitem__
        for t, row in zip(texts, chunks, strict=True):
            if row is None:
                yield self.by_library(t)
            else:
                yield b"".join(map(get, row))
        for c in fresh:
            if len(c) > LONG_CHUNK:
                del ids[c]


_TABLES: dict[str, MergeTable] = {}


def merge_table(path: str) -> MergeTable:
    """One table per worker and vocabulary."""
    if path not in _TABLES:
        _TABLES[path] = MergeTable(path)
    return _TABLES[path]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text.

    Returns the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.  A null
    or empty text has 0 of both; a null id stays null; repeated rows each get a
    row; an empty table gives an empty one; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merge_table(vocab_path)
        for batch in batches:
            for part in parts(batch, 1):
                n = [len(b) // 4 for b in bpe.encode(part.column(1).to_pylist())]
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(id_col, text_col)
    return rows.mapInArrow(count, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
