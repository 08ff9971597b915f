"""Benchmark decontamination: documents with a window within a word edit distance of an item.

Texts are lower-cased and cut into runs of letters and digits; in scripts that put no blanks between words each
character is a word. An item of n words is found in every
window that a quarter of n edits turns into it. Steps:

1. Windows as long as the item are placed wherever the document shares three consecutive words with it
   (two for items under nine words). By the pigeonhole principle this loses no window within the distance.
2. Window and item are embedded by the CGK random walk, which maps edit distance to Hamming distance:
   three steps a word, each writes the current word and moves on if a random bit of (step, word) says so.
3. Bit sampling: the pair goes on if it agrees on all ``SAMPLE`` sampled places in one of the repetitions,
   over several walks. Blanks after a text's end count as places that agree, so unrelated windows often
   go on too; they cost time in step 4 and no result. The repetitions are set when fitting, on edited copies
   of at most 500 items of a pass at the very threshold, so that the target recall is reached on these; if
   no number of repetitions reaches it, all windows go on (``Items.recall`` tells which). Items are walked by length class,
   so that a long one doesn't lengthen the others' walks.
4. The edit distance is computed exactly, bit-parallel, over the windows' surroundings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import filter_texts
from .textnum import NOT_ALNUM, mix, windows, word_hashes

#: Least words of an item that is searched; share of edits; aimed recall; walks; sampled places; most repetitions a walk.
LEAST_WORDS, EDITS, RECALL, WALKS, SAMPLE, MOST = 5, 0.25, 0.99, 4, 2, 64
#: Bytes of item texts sent to the tasks at once; more items are searched in further passes.
PASS_BYTES = 8 << 20
#: Places of windows' walks at once.
WALK_PLACES = 1 << 22
_STEP_KEYS = np.random.default_rng(11).integers(1, 2**63, (WALKS, 1 << 16), dtype=np.uint64)


# Blocks of scripts without blanks between words: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af])")


def _normal(text: str | None) -> bytes:
    text = (text or "").lower()
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", text)
    return text.encode("utf-8", "replace")


def embed(h: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, n: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Walks over words h[start:start+n] of many windows at once; words outside [low, high) are blank."""
    at, out = np.zeros(len(start), np.int64), np.zeros((steps, len(start)), np.uint64)
    for j in range(steps):
        place = start + at
        inside = (place >= low) & (place < high) & (at < n)
        word = np.where(inside, h[np.clip(place, 0, len(h) - 1)], np.uint64(0))
        out[j] = word
        at += (mix(word ^ _STEP_KEYS[walk, j % _STEP_KEYS.shape[1]]) & np.uint64(1)).astype(np.int64)
    return out


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the text, and where that stretch ends.
    Bit-parallel: the differences down a column of the edit table are two integers."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score, best = full, 0, n, (n, 0)
    for k, w in enumerate(text):
        eq = masks.get(w, 0)
        across = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(across | plus)) & full, plus & across
        if score < best[0]:
            best = score, k + 1
    return best


class Items:
    """Items of one pass: seeds, walks and repetitions."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for (item, _), words in zip(rows, _split([t for _, t in rows])):
            if len(words) >= LEAST_WORDS:
                self.ids.append(item)
                self.words.append(words)
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.edits = (self.n * EDITS).astype(np.int64)
        self.seeds = {}
        for q in (2, 3):
            own = [i for i, n in enumerate(self.n) if (n >= 9) == (q == 3)]
            if own:
                seed = np.concatenate([windows(self.words[i], q) for i in own])
                item = np.concatenate([np.full(self.n[i] - q + 1, i) for i in own])
                place = np.concatenate([np.arange(self.n[i] - q + 1) for i in own])
                order = np.argsort(seed, kind="stable")
                sieve = np.zeros(1 << 20, bool)
                sieve[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.seeds[q] = seed[order], item[order], place[order], sieve
        if not self.ids:
            return
        # items of a class differ by less than a factor of two in length, so with 32 bits a place the walks of all
        # take some 24 bytes a word and walk
        self.cls = np.array([int(n).bit_length() for n in self.n])
        self.row, self.walks = np.zeros(len(self.n), np.int64), {}
        for c in np.unique(self.cls):
            own = np.flatnonzero(self.cls == c)
            self.row[own] = np.arange(len(own))
            flat, first = np.concatenate([self.words[i] for i in own]), np.concatenate([[0], np.cumsum(self.n[own])])
            steps = int(3 * self.n[own].max())
            self.walks[int(c)] = [embed(flat, first[:-1], first[:-1], first[1:], self.n[own], k, steps).astype(np.uint32) for k in range(WALKS)]
        self.places = np.random.default_rng(5).random((WALKS, MOST, SAMPLE))
        self.recall, self.repeats = 0.0, None
        self.repeats = self._calibrate()

    def _calibrate(self) -> int | None:
        """Repetitions that reach the recall on 500 items at most, edited up to the threshold; none if none do, as then
        every window is verified. ``recall`` is what was measured."""
        rng = np.random.default_rng(9)
        own = [int(i) for i in rng.permutation(len(self.ids))[:500]]
        copies = []
        for i in own:
            w = list(self.words[i])
            for _ in range(int(self.edits[i])):
                k, kind = rng.integers(0, len(w)), rng.integers(0, 3)
                w[k : k + (kind != 0)] = [] if kind == 2 else [np.uint64(rng.integers(1, 2**62))]
            copies.append(np.array(w, np.uint64))
        flat, first = np.concatenate(copies), np.concatenate([[0], np.cumsum([len(w) for w in copies])])
        item = np.array(own)
        for repeats in (4, 8, 16, 32, MOST):
            self.recall = float(self.agree(flat, first[:-1], first[:-1], first[1:], item, repeats).mean())
            if self.recall >= RECALL:
                return repeats
        self.recall = 1.0
        return None

    def agree(self, h, start, low, high, item, repeats: int | None = None) -> np.ndarray:
        """Which windows agree with their item in some repetition of some walk."""
        repeats = repeats or self.repeats
        if repeats is None:
            return np.ones(len(item), bool)
        out = np.zeros(len(item), bool)
        for c in np.unique(self.cls[item]):
            own = np.flatnonzero(self.cls[item] == c)
            out[own] = self._agree(h, start[own], low[own], high[own], item[own], repeats, self.walks[int(c)])
        return out

    def _agree(self, h, start, low, high, item, repeats: int, walks: list[np.ndarray]) -> np.ndarray:
        """For items of one class, whose walks are given."""
        out, n, row = np.zeros(len(item), bool), self.n[item], self.row[item]
        for k in range(WALKS):
            rest = np.flatnonzero(~out)
            if not len(rest):
                break
            walk = embed(h, start[rest], low[rest], high[rest], n[rest], k, int(3 * n[rest].max())).astype(np.uint32)
            for r in range(repeats):
                hit = np.ones(len(rest), bool)
                for u in self.places[k, r]:
                    j = (u * 3 * n[rest]).astype(np.int64)
                    hit &= walk[j, np.arange(len(rest))] == walks[k][j, row[rest]]
                out[rest[hit]] = True
        return out

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """``(text, item, edits, end)``: the best match of each item in each text."""
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for first, h, cut, _, _ in word_hashes([_normal(t) for t in texts], False, NOT_ALNUM):
            got = [x for q in self.seeds if (x := self._windows(h, cut, q)) is not None]
            if not got:
                continue
            text, item, start = (np.concatenate(x) for x in zip(*got))
            key = np.unique(np.stack([text, item, start]), axis=1)
            # so many windows at once that their walks take WALK_PLACES places
            ends = np.cumsum(3 * self.n[key[1]]) // WALK_PLACES
            edges = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), key.shape[1]]
            for a, z in zip(edges, edges[1:]):
                text, item, start = key[:, a:z]
                ok = self.agree(h, start, cut[text], cut[text + 1], item)
                self._verify(h, cut, text[ok], item[ok], start[ok], first, found)
        return [(t, i, *v) for (t, i), v in sorted(found.items())]

    def _windows(self, h, cut, q):
        seed, item, place, sieve = self.seeds[q]
        g = windows(h, q)
        at = np.flatnonzero(sieve[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(seed, g[at]), np.searchsorted(seed, g[at], "right")
        text = np.searchsorted(cut, at, "right") - 1
        ok = (hi > lo) & (at + q <= cut[text + 1])
        at, lo, n, text = at[ok], lo[ok], (hi - lo)[ok], text[ok]
        if not len(at):
            return None
        entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(text, n), item[entry], np.repeat(at, n) - place[entry]

    def _verify(self, h, cut, text, item, start, first, found):
        k, total = 0, len(text)
        while k < total:  # sorted by text, item and start: windows that overlap are one stretch
            t, i, a = int(text[k]), int(item[k]), int(start[k])
            n, d, z = int(self.n[i]), int(self.edits[i]), a
            while k < total and text[k] == t and item[k] == i and start[k] <= z + n + 2 * d:
                z = int(start[k])
                k += 1
            lo, hi = max(a - d, int(cut[t])), min(z + n + d, int(cut[t + 1]))
            edits, end = best_match(self.words[i].tolist(), h[lo:hi].tolist())
            if edits <= d:
                at = (first + t, i)
                found[at] = min(found.get(at, (edits, lo + end - int(cut[t]))), (edits, lo + end - int(cut[t])))


def _split(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, h, cut, _, _ in word_hashes([_normal(t) for t in texts], False, NOT_ALNUM):
        out += [h[a:z] for a, z in zip(cut, cut[1:])]
    return out


def passes(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items in passes of bounded size; null ids and texts are no items, equal texts count once each id."""
    rows, size = [], 0
    for r in benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text)
        if size >= PASS_BYTES:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def sent(spark: SparkSession, benchmark: DataFrame) -> Iterator:
    """The passes, each broadcast from a file; the driver holds one at a time."""
    for items in passes(benchmark):
        if items.ids:
            yield spark.sparkContext.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, item_words, end_word``: each document and each item found in it.

    Whole texts are searched. Null and empty texts and documents without a match give no row; items
    under five words are not searched; repeated rows give repeated rows. One scan of the documents for
    each pass of items (8 MB of texts, so most benchmarks are one pass), no shuffle."""
    schema = "doc_id long, item_id long, edits int, item_words int, end_word int"
    out = None
    for shared in sent(docs.sparkSession, benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                for i in range(0, b.num_rows, 1024):
                    part = b.slice(i, 1024)
                    keys = part.column(0).to_pylist()
                    got = items.find(part.column(1).to_pylist())
                    cols = [[keys[t] for t, _, _, _ in got], [items.ids[i] for _, i, _, _ in got], [e for _, _, e, _ in got], [int(items.n[i]) for _, i, _, _ in got], [z for _, _, _, z in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=[x.split()[0] for x in schema.split(", ")])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with their own columns; judged where the text is read."""
    out = docs
    for shared in sent(spark, benchmark):

        def clean(texts: list[str | None], shared=shared) -> np.ndarray:
            ok = np.ones(len(texts), bool)
            ok[[t for t, _, _, _ in shared.value.find(texts)]] = False
            return ok

        out = filter_texts(out, clean)
    return out
