"""Byte-level BPE encoding and decoding.

Tokens are found by an Aho-Corasick automaton over bytes mapped to Latin-1. A piece is
encoded from left to right with the longest token at each place; a token may follow another
only if merging would have left the two apart, which is decided from the merges that made
them and memoised. If no token fits, the walk goes back to the token before and takes a
shorter one; a place from which nothing fits is marked and never tried again, so the work
is linear in the piece. The result is what rank-ordered merging gives."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

#: Pieces whose ids are kept; the memo starts anew beyond that.
MEMO = 300_000
_LONG = 64


class BytePairEncoder:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import ahocorasick

        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {i: t for t, i in self.ranks.items()}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.find = regex.compile(pattern).findall
        self.machine = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.machine.add_word(t.decode("latin-1"), (i, len(t)))
        self.machine.make_automaton()
        self.shorter = {i: next((r for n in range(len(t) - 1, 0, -1) if (r := self.ranks.get(t[:n])) is not None), None) for t, i in self.ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.fits = functools.lru_cache(1 << 20)(self._fits)
        self.memo: dict[str, bytes] = {}
        for i in sorted(self.token):
            self._learn(i)
        self.fits.cache_clear()

    def _learn(self, i: int) -> None:
        """The last merge that makes token i, from lower-ranked tokens."""
        whole, left = self.token[i], self.shorter[i]
        self.parts[i] = None
        while left is not None:
            right = self.ranks.get(whole[self.size[left] :])
            if right is not None and left < i and right < i and self._fits(left, right):
                self.parts[i], self.merged[left, right] = (left, right), i
                return
            left = self.shorter[left]

    def _fits(self, left: int, right: int) -> bool:
        """Whether both tokens stay when their bytes stand side by side: undo merges, the latest
        first, and see that no merge across the border would have come before those undone."""
        bound = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            a, b = self.parts[left], self.parts[right]
            if left > right:
                if a:
                    bound, left = left, a[1]
                elif b:
                    bound, right = right + 1, b[0]
                else:
                    return True
            elif b:
                bound, right = right + 1, b[0]
            elif a:
                bound, left = left, a[1]
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(data), self.size, self.shorter, self.fits
        longest: list[int | None] = [None] * (n + 1)
        for end, (i, length) in self.machine.iter(data.decode("latin-1")):
            longest[end - length + 1] = i  # ends ascend, so the longest comes last
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + size[token]
                if open_[end] and (last is None or fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
                if token is None:
                    if last is None:
                        raise ValueError("the vocabulary lacks a byte of the text")
                    open_[at] = 0
                    out.pop()
                    at, token = at - size[last], last
                    break
        if at < n:
            raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces, memo = self.find(text), self.memo
        got = [memo.get(p) for p in pieces]
        if None in got:
            if len(memo) > MEMO:
                memo.clear()
            for k, x in enumerate(got):
                if x is None:
                    p = pieces[k]
                    if (x := memo.get(p)) is None:
                        x = np.array(self.encode_piece(p.encode()), "<u4").tobytes()
                        if len(p) <= _LONG:
                            memo[p] = x
                    got[k] = x
        return b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. A row is a result row: repeated rows and null doc_ids stay.
    ``path`` names the ranks file on each machine. No shuffle; a task holds one batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            # a slice at a time bounds what is held beside the batch
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                data = [own.decode(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id, ids, decoded``: both of the above in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the ids and of what they decode to."""
    from pyspark.sql import functions as F

    out = round_trip(docs, path)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
