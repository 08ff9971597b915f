"""Suffix-array dedup with a logarithmic family of indexes.

**Sparse suffix arrays.** Of the suffixes, those are kept that start at an anchor: in each window of 50
bytes, the 24-byte string with the least hash. Equal windows have equal anchors, wherever they stand, so no
match of 50 bytes escapes. Consecutive windows with one anchor form a run. An array's rows are suffixes in the order
of their bytes, to a depth of 24, each with a check over all bytes of its run. An index is an array for each bucket of a hash of the anchor:
suffixes with a common prefix of 24 bytes are in the same bucket, and buckets are even whatever the texts begin with.

**Levels.** A new batch of documents is merge-scanned against the arrays of all levels, bucket by bucket, and
becomes a level; before that, levels of equal size are merged, so there are logarithmically many.

**Matches.** In a scan, neighbours whose common prefix is a whole anchor are compared. A run that an earlier document has
byte for byte is removed whole. Runs that share an anchor but differ (at the ends of shared passages) are compared window by
window: their windows' hashes are aggregated to the smallest document. Runs are compared by 24 bytes and 48 bits of hash, windows by
64 bits of hash.

Each task keeps one row per distinct run of its batch, so that copies shrink before the shuffle; of an anchor
with very many different runs only ``HOT`` go to the arrays and all are compared window by window. A run in an
array that was asked about marks its anchor: whatever else has that anchor is asked about too, as some of its runs
are in no array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, parts
from .textnum import CHUNK, chunked, hash_spans, mix, pack_planes, powers, prefix_sums, release, unpack_planes

#: Bytes of a match, bytes of an anchor, runs of a packed array, distinct runs of an anchor kept in arrays, batches of documents.
LEAST, GRAM, ARRAY, HOT, BATCHES = 50, 24, 1_000_000, 256, 4
#: Bytes of a table for each bucket of the arrays: a worker holds a bucket of all levels.
BUCKET_BYTES = 64 << 20
_SPAN = LEAST - GRAM + 1
INDEX, CUT, ASK = 0, 1, 2
_KEY = f"S{GRAM}"  # bytes, compared from the first on
_FIELDS = (("keys", GRAM), ("checks", 6), ("docs", 8), ("tags", 2), ("starts", 5), ("lengths", 5), ("asked", 1))
_PACKED = "kind int, bucket int, n int, " + ", ".join(f"{f} binary" for f, _ in _FIELDS) + ", old boolean"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
_TYPES = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * len(_FIELDS), pa.bool_())


def anchored_runs(buf: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the bytes of texts set end to end, ``text`` naming each byte's text: first window, number of
    windows, anchor hash, check and anchor of each run."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    none = empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(_KEY)
    if n < LEAST:
        return none
    sums = prefix_sums(buf)
    _, down = powers(n + 1)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    # the place breaks ties: the leftmost of equal strings in a window
    bits = np.uint64(24)
    key = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    least, width = key, 1
    while width * 2 <= _SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < _SPAN:
        least = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.flatnonzero(text[: n - LEAST + 1] == text[LEAST - 1 :])
    if not len(start):
        return none
    a = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)]))
    count = np.diff(np.append(first, len(start)))
    lo, at = start[first], a[first]
    whole = hash_spans(sums, lo, lo + count + LEAST - 1)
    check = mix(whole + (at - lo).astype(np.uint64)) >> np.uint64(16)
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, GRAM)[at]).view(_KEY).ravel()
    return lo, count, mix(gram[at] + np.uint64(1)), check, key


def text_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """``text, start, windows, hash, check, anchor`` of runs; long texts in overlapping segments."""
    for first, last in chunked(texts):
        if last - first == 1 and len(texts[first]) > CHUNK:
            for at in range(0, len(texts[first]), CHUNK):
                buf = np.frombuffer(texts[first][at : at + CHUNK + LEAST - 1], np.uint8)
                lo, *rest = anchored_runs(buf, np.zeros(len(buf), np.int8))
                yield np.full(len(lo), first), lo + at, *rest
            continue
        size = np.array([len(t) for t in texts[first:last]])
        text = np.repeat(np.arange(len(size)), size)
        lo, *rest = anchored_runs(np.frombuffer(b"".join(texts[first:last]), np.uint8), text)
        own = text[lo] if len(lo) else lo
        yield own + first, lo - (np.cumsum(size) - size)[own], *rest


class Runs:
    """Columns of runs, as arrays of equal length."""

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update(columns)

    def take(self, which: np.ndarray) -> Runs:
        return Runs(**{k: v[which] for k, v in self.__dict__.items()})

    @staticmethod
    def join(many: list[Runs]) -> Runs:
        return Runs(**{k: np.concatenate([m.__dict__[k] for m in many]) for k in many[0].__dict__})

    def row(self, kind: int, bucket: int) -> tuple:
        n = len(self.docs)
        cols = [self.__dict__[f] for f, _ in _FIELDS[1:]]
        keys = self.keys
        if kind != INDEX:
            keys, cols[0] = keys[:0], np.zeros(n, np.uint64)
        # keys in order have long common prefixes, which a compressor finds
        packed = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(keys).tobytes())
        return (kind, bucket, n, packed, *[pack_planes(c, w) for c, (_, w) in zip(cols, _FIELDS[1:])], False)

    @staticmethod
    def unpack(n: int, data: list[bytes], old: bool) -> Runs:
        cols = {f: unpack_planes(d, n, w) for d, (f, w) in zip(data[1:], _FIELDS[1:])}
        cols["keys"] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[0], max_output_size=n * GRAM), _KEY)
        for f in ("docs", "starts", "lengths"):
            cols[f] = cols[f].view(np.int64)
        return Runs(**cols, old=np.full(n, old))


def resolve(runs: Runs) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The runs in the order of their anchors' bytes; which an earlier document has whole; which share their anchor with a
    different run of another document, or with more than ``HOT`` or with any asked about; which exceed ``HOT``
    runs of an anchor."""
    runs = runs.take(np.argsort(runs.keys, kind="stable"))  # merges arrays that are in order
    n, h = len(runs.docs), runs.keys
    cut, differs, hot = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    same = np.zeros(n + 1, bool)
    same[1:n] = h[1:] == h[:-1]
    at = np.flatnonzero(same[1:] | same[:-1])
    if len(at):
        group = np.cumsum(~same[at])
        at = at[np.lexsort((runs.starts[at], runs.docs[at], runs.checks[at], group))]
        doc, new = runs.docs[at], np.ones(len(at), bool)
        fresh = np.ones(len(at), bool)  # first of an anchor
        fresh[1:] = h[at][1:] != h[at][:-1]
        new[1:] = fresh[1:] | (runs.checks[at][1:] != runs.checks[at][:-1])
        first, anchor = np.cumsum(new) - 1, np.cumsum(fresh) - 1
        least = doc[new][first]
        cut[at] = doc > least
        starts = np.flatnonzero(fresh)
        kinds = np.add.reduceat(new.astype(np.int64), starts)
        many = (kinds > 1) & (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
        many |= (kinds > HOT) | (np.maximum.reduceat(runs.asked[at], starts) > 0)
        differs[at] = many[anchor] & (doc == least)
        hot[at] = (first - first[starts][anchor] >= HOT) & (doc == least)
    return runs, cut, differs, hot


def _joined_spans(runs: Runs) -> Runs:
    """Cuts as spans of bytes, where spans that touch are one; ``lengths`` are then bytes."""
    runs = runs.take(np.lexsort((runs.starts, runs.tags, runs.docs)))
    end = runs.starts + runs.lengths + LEAST - 1
    fresh = np.ones(len(end), bool)
    fresh[1:] = (runs.docs[1:] != runs.docs[:-1]) | (runs.tags[1:] != runs.tags[:-1]) | (runs.starts[1:] > end[:-1])
    last = np.append(np.flatnonzero(fresh)[1:], len(end)) - 1
    out = runs.take(fresh)
    out.lengths = end[last] - out.starts
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TYPES)], names=_NAMES)


def suffix_arrays(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed arrays of ``doc_id, tag, text``: a row per task's batch and bucket, and what the batch
    decides by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Runs] = []
        size = 0

        def flush():
            nonlocal held, size
            runs, cut, _, hot = resolve(Runs.join(held))
            held, size = [], 0
            # no later array tells that these anchors have more runs, so all of them are asked about here
            ask = ~cut & np.isin(runs.keys, runs.keys[hot]) if hot.any() else hot
            runs.asked[ask] = 1
            keep = runs.take(~cut & ~hot)
            keep = keep.take(np.argsort(keep.buckets, kind="stable"))
            edge = np.searchsorted(keep.buckets, np.arange(buckets + 1))
            rows = [keep.take(slice(a, z)).row(INDEX, b) for b, (a, z) in enumerate(zip(edge, edge[1:])) if z > a]
            some = int(runs.docs[0] % buckets)
            if cut.any():
                rows.append(_joined_spans(runs.take(cut)).row(CUT, some))
            if ask.any():
                rows.append(runs.take(ask).row(ASK, some))
            del runs, keep
            release()
            return _batch(rows)

        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids, tags = part.column(0).to_numpy(), part.column(1).to_numpy()
                for text, lo, n, h, c, key in text_runs([t.encode() for t in part.column(2).to_pylist()]):
                    if len(lo):
                        which = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
                        held.append(Runs(keys=key, buckets=which, checks=c, docs=ids[text], tags=tags[text].astype(np.uint64), starts=lo, lengths=n, asked=np.zeros(len(lo), np.uint64), old=np.zeros(len(lo), bool)))
                        size += len(lo)
                if size >= ARRAY:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "tag", "text").mapInArrow(run, _PACKED)


def merge_scan(packed: DataFrame, buckets: int, level: bool = True) -> DataFrame:
    """Merges the arrays of each bucket, old and new; what is new in the result is cut or asked about, and the rest, with
    ``level``, is the new level's array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            runs, cut, differs, hot = resolve(Runs.join(held))
            held.clear()
            rows, ask = [], differs & (runs.asked == 0)
            runs.asked[differs] = 1
            fresh = ~cut & ~hot & ~runs.old & level
            for kind, which in ((INDEX, fresh), (ASK, ask)):
                if which.any():
                    rows.append(runs.take(which).row(kind, now))
            if cut.any():
                rows.append(_joined_spans(runs.take(cut)).row(CUT, now))
            del runs
            release()
            return _batch(rows) if rows else None

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(len(_NAMES))]
            for kind, bucket, n, *data, old in zip(*cols):
                if held and bucket != now:
                    if (out := flush()) is not None:
                        yield out
                now = bucket
                if kind == INDEX:
                    held.append(Runs.unpack(n, data, old))
                else:
                    yield _batch([(kind, bucket, n, *data, False)])
        if held and (out := flush()) is not None:
            yield out

    return packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, _PACKED)


def merge_levels(packed: DataFrame, buckets: int) -> DataFrame:
    """One array per bucket out of those of two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush():
            runs = Runs.join(held)
            held.clear()
            return _batch([runs.take(np.argsort(runs.keys, kind="stable")).row(INDEX, now)])

        for b in batches:
            for kind, bucket, n, *data, old in zip(*[b.column(i).to_pylist() for i in range(len(_NAMES))]):
                if held and bucket != now:
                    yield flush()
                now = bucket
                held.append(Runs.unpack(n, data, old))
        if held:
            yield flush()

    return packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(run, _PACKED)


class SuffixIndex:
    """The family of indexes. Batches are added in ascending order of doc_id. ``save`` writes it to a folder from which
    ``load`` takes it up, so that later batches need not read earlier documents again but for the windows at
    the ends of shared passages."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int):
        self.spark, self.scratch, self.buckets = spark, scratch, buckets
        self.levels: list[tuple[int, str, DataFrame]] = []  # size in batches, table, rows
        self.found: list[DataFrame] = []
        self.count = 0

    def _merge(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a, x), (_, b, y) = self.levels.pop(), self.levels.pop()
            name = f"level-{self.count}-{2 * size}"
            merged = self.scratch.write(merge_levels(x.unionByName(y), self.buckets), name)
            for old in (a, b):
                self.scratch.drop(old)
            self.levels.append((2 * size, name, merged))

    def add(self, docs: DataFrame, level: bool = True) -> None:
        """``docs``: ``doc_id, tag, text`` without nulls. Without ``level`` the batch is scanned, but becomes no level: no
        other will be scanned against it."""
        self._merge()
        self.count += 1
        packed = suffix_arrays(docs, self.buckets)
        for _, _, rows in self.levels:
            packed = packed.unionByName(rows.withColumn("old", F.lit(True)))
        name = f"batch-{self.count}"
        got = self.scratch.write(merge_scan(packed, self.buckets, level), name, partition_by="kind")
        self.found.append(got.where(F.col("kind") != INDEX))
        if level:
            self.levels.append((1, f"{name}/kind={INDEX}", got.where(F.col("kind") == INDEX)))

    def save(self, path: str) -> None:
        """Writes the levels, and a row for each of them."""
        rows = [(size, k, self.buckets, self.count) for k, (size, _, _) in enumerate(self.levels)]
        for k, (_, _, level) in enumerate(self.levels):
            level.write.mode("overwrite").parquet(f"{path}/level-{k}")
        # runs that were asked about are no longer asked about, and hot ones are in no level
        self._found().where(F.col("kind") == ASK).write.mode("overwrite").parquet(f"{path}/asked")
        self.spark.createDataFrame(rows, "size int, level int, buckets int, batches int").coalesce(1).write.mode("overwrite").parquet(f"{path}/levels")

    @staticmethod
    def load(spark: SparkSession, scratch: Scratch, path: str) -> SuffixIndex:
        rows = sorted(spark.read.parquet(f"{path}/levels").collect(), key=lambda r: r.level)  # logarithmically many
        index = SuffixIndex(spark, scratch, rows[0].buckets)
        index.count = rows[0].batches
        index.found = [spark.read.parquet(f"{path}/asked")]
        # names of no table in this scratch: what a merge drops is not the saved folder
        index.levels = [(r.size, f"loaded-{r.level}", spark.read.parquet(f"{path}/level-{r.level}")) for r in rows]
        return index

    def close(self) -> None:
        for _, name, _ in self.levels:
            self.scratch.drop(name)
        self.levels = []

    def _found(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.unionByName(more)
        return out

    def spans(self, kind: int) -> DataFrame:
        """``doc_id, tag, spans``: per array the starts and lengths found in a document, as start * 2**32 + length."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, *data in zip(*[b.column(i).to_pylist() for i in range(5)]):
                    docs, tags, lo, size = (unpack_planes(d, n, w) for d, (_, w) in zip(data, _FIELDS[2:6]))
                    order = np.lexsort((tags, docs))
                    docs, tags, value = docs[order], tags[order], (lo << np.uint64(32) | size)[order]
                    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])]))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), pa.array(value.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(docs[first].view(np.int64)), pa.array(tags[first].astype(np.int32)), lists], names=["doc_id", "tag", "spans"])

        packed = self._found().where(F.col("kind") == kind).select("n", "docs", "tags", "starts", "lengths")
        return packed.mapInArrow(run, "doc_id long, tag int, spans array<long>")


def _gathered(spans: DataFrame) -> DataFrame:
    """One row per document; its spans are no more than its bytes."""
    return spans.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))


#: Windows that a task compares with each other before it sends them on.
WINDOWS = 1_000_000


def _run_windows(raw: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of asked runs; long texts in segments."""
    runs = np.unique(spans)
    lo, n = runs >> 32, runs & 0xFFFFFFFF
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys, places = [], []
    for s in range(0, len(raw), CHUNK):
        own = at[(at >= s) & (at < s + CHUNK)]
        if len(own):
            keys.append(hash_spans(prefix_sums(raw[s : s + CHUNK + LEAST]), own - s, own - s + LEAST))
            places.append(own)
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


#: Windows on their way: those of a bucket of hashes, of each batch and hash the ``first`` and then the others; or, with
#: ``lengths``, spans of bytes that are decided.
_WINDOWS = "bucket int, others boolean, n int, hashes binary, docs binary, tags binary, starts binary, lengths binary"
_WINDOW_TYPES = (pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 5)


def _least(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, and in it each window's smallest document; the different keys, and theirs."""
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    least = np.minimum.reduceat(doc[order], first)
    return order, np.repeat(least, np.diff(np.append(first, len(key)))), key[order][first], least


def _window_spans(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((tag, doc))
    doc, tag, value = doc[order], tag[order], (at << 32 | size)[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(value, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(doc[first], pa.int64()), pa.array(tag[first].astype(np.int32), pa.int32()), lists], names=["doc_id", "tag", "spans"])


def asked_windows(docs: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """Windows of the asked runs, packed by bucket: of each task's batch only the smallest document's for each hash; the others
    are decided, as a window of the batch has a smaller doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def row(bucket: int, others: bool, key, doc, tag, at, length) -> tuple:
            return (bucket, others, len(doc), key.tobytes(), pack_planes(doc, 8), pack_planes(tag, 2), pack_planes(at, 5), pack_planes(length, 5))

        def flush():
            nonlocal held, size
            key, doc, tag, at = (np.concatenate(c) for c in zip(*held))
            held, size = [], 0
            order, least, _, _ = _least(key, doc)
            key, doc, tag, at = key[order], doc[order], tag[order], at[order]
            own, rows, none = doc == least, [], np.zeros(0, np.int64)
            if not own.all():
                d = Runs(docs=doc[~own], tags=tag[~own], starts=at[~own], lengths=np.ones(len(own) - own.sum(), np.int64))
                d = _joined_spans(d)
                rows.append(row(int(d.docs[0] % buckets), False, key[:0], d.docs, d.tags, d.starts, d.lengths))
            key, doc, tag, at = key[own], doc[own], tag[own], at[own]
            again = np.concatenate([[False], key[1:] == key[:-1]])
            for others in (False, True):
                which = again == others
                k, *rest = key[which], doc[which], tag[which], at[which]
                edge = np.searchsorted((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                rows += [row(bucket, others, k[a:z], *[x[a:z] for x in rest], none) for bucket, (a, z) in enumerate(zip(edge, edge[1:])) if z > a]
            release()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _WINDOW_TYPES)], names=[x.split()[0] for x in _WINDOWS.split(", ")])

        for b in batches:
            for k in range(b.num_rows):
                raw = np.frombuffer(b.column(2)[k].as_py().encode(), np.uint8)
                key, at = _run_windows(raw, b.column(3)[k].values.to_numpy(zero_copy_only=False))
                held.append((key.view(np.uint64), np.full(len(at), b.column(0)[k].as_py()), np.full(len(at), b.column(1)[k].as_py(), np.int64), at))
                size += len(at)
                if size >= WINDOWS:
                    yield flush()
        if held:
            yield flush()

    return docs.select("doc_id", "tag", "text").join(_gathered(asked), ["doc_id", "tag"]).mapInArrow(run, _WINDOWS)


def earlier_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, tag, spans`` of windows that a document with a smaller doc_id has too. Of a bucket the first window of each batch
    and hash is held; the others of a batch, which a text with repeats may have in any number, pass as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None

        def spans(at: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            return _window_spans(*rest, at, np.full(len(at), LEAST))

        def settle():
            nonlocal held, known
            key, doc, tag, at = (np.concatenate(c) for c in zip(*held))
            held = []
            order, least, *known = _least(key, doc)
            cut = order[doc[order] > least]
            return spans(at[cut], doc[cut], tag[cut])

        for b in batches:
            for bucket, others, n, key, *data in zip(*[c.to_pylist() for c in b.columns]):
                doc, tag, at = (unpack_planes(d, n, w).view(np.int64) for d, w in zip(data, (8, 2, 5)))
                if not key:
                    yield _window_spans(doc, tag, at, unpack_planes(data[3], n, 5).view(np.int64))
                    continue
                if held and (bucket != now or others):
                    yield settle()
                now, key = bucket, np.frombuffer(key, np.uint64)
                if others:
                    cut = doc > known[1][np.searchsorted(known[0], key)]
                    yield spans(at[cut], doc[cut], tag[cut])
                else:
                    held.append((key, doc, tag, at))
        if held:
            yield settle()
        release()

    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "others").mapInArrow(run, "doc_id long, tag int, spans array<long>")


def _tagged(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, tag, text``; tags tell the texts of a repeated doc_id apart and are 0 elsewhere."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    again = own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(1).alias("again"))
    if again.isEmpty():
        return own.select("doc_id", F.lit(0).alias("tag"), "text")
    tag = F.when(F.col("again") == 1, F.pmod(F.xxhash64("text"), F.lit(65535)) + 1).otherwise(0).cast("int")
    return own.join(again, "doc_id", "left").select("doc_id", tag.alias("tag"), "text")


def dedup(spark: SparkSession, docs: DataFrame, batches: int = BATCHES, index_path: str | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept``: the bytes to remove from each whole text, as maximal spans, and
    the bytes that stay.

    Null texts count as empty; texts under 50 bytes lose nothing; a document never removes its own bytes,
    nor do rows with the same doc_id those of each other; a null doc_id is not smaller than any and loses
    nothing. Batches are ranges of doc_id of about equal size. Only integers (range bounds) reach the driver.

    ``index_path``: a folder where the index is kept for later. ``earlier``: the documents that are in it
    already, with smaller doc_ids than ``docs``; they are read for the ends of passages only and get no rows."""
    scratch = Scratch(spark, "suffix")
    own = _tagged(spark, docs)
    known = own.where("doc_id is not null")
    bounds = sorted(set(known.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)))
    if earlier is not None:
        index = SuffixIndex.load(spark, scratch, index_path)
    else:
        index = SuffixIndex(spark, scratch, max(2 * parts(spark, 8), by_bytes(docs.select("text"), BUCKET_BYTES)))
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = known
        if lo is not None:
            part = part.where(F.col("doc_id") > int(lo))
        if hi is not None:
            part = part.where(F.col("doc_id") <= int(hi))
        # an index that nobody keeps doesn't need its last batch
        index.add(part, level=hi is not None or index_path is not None)
    if index_path is not None:
        index.save(index_path if earlier is None else f"{index_path}-next")
    index.close()
    if earlier is not None:
        known = known.unionByName(_tagged(spark, earlier).where("doc_id is not null"))
    met = scratch.write(earlier_windows(asked_windows(known, index.spans(ASK), index.buckets), index.buckets), "met")
    spans = scratch.write(_gathered(index.spans(CUT).unionByName(met)), "spans")
    scratch.keep("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sizes, starts, ends, kept = [], [], [], []
                for text, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = text.encode()
                    lo, hi = _merged(np.array(s or [], np.int64))
                    edges = [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(raw)]
                    sizes.append(len(raw))
                    starts.append(lo.tolist())
                    ends.append(hi.tolist())
                    kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip((sizes, starts, ends, kept), kinds)]], names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    joined = own.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans; those that touch are one."""
    spans = np.sort(spans)
    lo, hi = spans >> 32, np.maximum.accumulate((spans >> 32) + (spans & 0xFFFFFFFF)) if len(spans) else spans
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    last = np.append(np.flatnonzero(first)[1:], len(lo)) - 1 if len(lo) else np.zeros(0, np.int64)
    return lo[first], hi[last]


def dedup_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, z: z - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return dedup(spark, docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
