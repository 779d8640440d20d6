"""Byte-level BPE encoding of whole texts with the rank file of a public tokenizer."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the White_Space characters of Unicode, which \s stands for in PATTERN.
SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces kept in a worker's memo before it starts anew.
MEMO = 200_000


class Bpe:
    """Exact greedy-merge BPE by backtracking over longest matches.

    Every token of the vocabulary goes into one Aho-Corasick automaton over Latin-1 text. A text is covered from the
    left with the longest token that may follow the last one; where none may, the last token is taken back and its next
    shorter prefix tried. Whether two tokens may stand side by side, which is whether the merges would have kept them
    apart, is decided once a pair and remembered. A position that failed is never tried again, so the work is linear.
    """

    def __init__(self, rank_file: bytes):
        tokens = {}
        for line in rank_file.splitlines():
            if line:
                word, rank = line.split()
                tokens[base64.b64decode(word).decode("latin-1")] = int(rank)
        self.id = tokens
        self.text = {r: w for w, r in tokens.items()}
        self.auto = ahocorasick.Automaton()
        for w, r in tokens.items():
            self.auto.add_word(w, r)
        self.auto.make_automaton()
        self.shorter: dict[int, int] = {}
        for w, r in tokens.items():
            for k in range(len(w) - 1, 0, -1):
                p = tokens.get(w[:k])
                if p is not None:
                    self.shorter[r] = p
                    break
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.may: dict[tuple[int, int], bool] = {}
        for r in sorted(self.text):
            self.halves[r] = (r, r)
            w, left = self.text[r], self.shorter.get(r)
            while left is not None:
                right = tokens.get(w[len(self.text[left]) :])
                if right is not None and left < r and right < r and self._apart(left, right):
                    self.pairs[left, right] = r
                    self.halves[r] = (left, right)
                    break
                left = self.shorter.get(left)

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge across the border between ``a`` and ``b`` comes before the merges that made them."""
        limit, pairs, halves = 1 << 60, self.pairs, self.halves
        while True:
            joined = pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit = a
                a = halves[a][1]
                if a != limit:
                    continue
                limit, b2 = b + 1, halves[b][0]
                if b2 == b:
                    return True
                b = b2
            else:
                limit, b2 = b + 1, halves[b][0]
                if b2 != b:
                    b = b2
                    continue
                limit, a2 = a, halves[a][1]
                if a2 == a:
                    return True
                a = a2

    def apart(self, a: int, b: int) -> bool:
        ok = self.may.get((a, b))
        if ok is None:
            if len(self.may) > 2_000_000:
                self.may.clear()
            ok = self.may[a, b] = self._apart(a, b)
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        s = piece.decode("latin-1")
        whole = self.id.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [-1] * n
        size = [0] * n
        for end, r in self.auto.iter(s):
            k = len(self.text[r])
            at = end - k + 1
            if k > size[at]:
                size[at], longest[at] = k, r
        text, shorter, out = self.text, self.shorter, []
        open_ = bytearray(b"\x01" * (n + 1))
        pos, tok = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while True:
                end = pos + len(text[tok])
                if open_[end] and (last is None or self.apart(last, tok)):
                    out.append(tok)
                    pos = end
                    tok = longest[end] if end < n else -1
                    break
                less = shorter.get(tok)
                if less is not None:
                    tok = less
                    continue
                open_[pos] = 0
                out.pop()
                pos -= len(text[last])
                tok = last
                break
        return out


class Encoder(dict):
    """Ids by piece of text between blanks, filled on demand; :meth:`encode` takes a whole text."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        super().__init__()
        self.bpe = Bpe(rank_file)
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]")
        self.fine = regex.compile(spaced).findall
        # a blank belongs to the run of other characters behind it, so runs may be encoded one by one
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def __missing__(self, run: str) -> list[int]:
        ids = [i for piece in self.fine(run) for i in self.bpe.encode_piece(piece.encode("utf-8", "replace"))]
        if len(self) >= MEMO:
            self.clear()
        self[run] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.coarse(text))))


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return Encoder(rank_file, pattern)


def encode_corpus(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id, ids): the token ids of every text, without special tokens.

    A null and an empty text both have the empty list. Strings that look like special tokens are ordinary text. Rows
    are neither dropped nor merged; extra columns are left out. The rank file is read on the driver and broadcast: it
    holds a vocabulary and doesn't grow with the data (files over 64 MB are refused).
    """
    with open(rank_path, "rb") as f:
        ranks = f.read(64_000_001)
    if len(ranks) > 64_000_000:
        raise ValueError(f"{rank_path} is too large to be a vocabulary")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        for b in batches:
            flat, offsets = array("i"), [0]
            for text in b.column(1).to_pylist():
                if text:
                    flat.extend(enc.encode(text))
                offsets.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if len(flat) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
