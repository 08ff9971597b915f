"""Token ids in a file format of canonical, length-limited Huffman codes.

Ids are counted over all documents, code lengths come from package-merge, and codes are canonical, so
the lengths alone rebuild them. A block holds whole documents; its bits are decoded on their own by one
table of ``2**limit`` entries, from bit offsets kept every ``STEP`` ids, all of them in step. Blocks are rows
of a columnar file, as that is what every store of the cluster can write; a shard's blocks and the shards
ascend by doc_id."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, parts, text_of

#: Longest code in bits, ids of a block (at least one document), ids between bit offsets.
LIMIT, BLOCK, STEP = 20, 1 << 16, 128
#: Code points of a text that tell ranges of one doc_id apart, bytes of texts of a range at least.
HEAD, RANGE_BYTES = 16, 64 << 20
END_ID = 0
#: Words in one call of the library, bytes of texts whose words are found together.
GROUP, TOGETHER = 4096, 8 << 20
#: Words whose ids are kept; beyond that the older half stays, which holds the frequent ones.
WORDS = 1_500_000
#: Stands before a text's first word, which neither a blank nor a line end precedes.
_FIRST = "\x01"
# texts that aren't words between single blanks and one or two line ends alone: white space at an end, or runs of it at
# a blank, or longer, or of another kind; and the mark itself
_ODD = r"^$|^[ \n]|[ \n]$|  | \n|\n |\n\n\n|[\x01\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _text(t: str) -> pa.Scalar:
    return pa.scalar(t, pa.large_string())


class WordEncoder:
    """The tokenizers library, asked once for each distinct word.

    The ids of a word between single blanks, with the blank before it, don't depend on what surrounds it, nor do
    those of a word after a line end: of the pre-tokenizer's pieces only runs of white space are cut by what follows, and
    a line end beside a word is a piece of its own. Texts with other white space, or with an added token as
    ``<|endoftext|>``, are encoded whole. Splitting, finding distinct words, parting their ids and joining them
    again are Arrow kernels and array operations, and so is the look-up of words met before; no word is a Python object."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that spell an added token are the library's to split, whole
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_ODD, *added])
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.marks = {c: self.tokenizer.encode(c, add_special_tokens=False).ids[0] for c in ".,;:!?"}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without line ends, end to end, and how many each has: a few thousand words in one call,
        between line ends, which are an id of their own and in no id of a word."""
        n = len(words)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        edges = np.append(np.arange(0, n, GROUP), n)
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), words), _text("\n")).to_pylist()
        ids = [np.array(array("I", e.ids), "<u4") for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        flat = np.concatenate([x for g in ids for x in (g, [np.uint32(self.line)])]).astype("<u4")
        ends = np.flatnonzero(flat == self.line)
        if len(ends) != n:
            raise ValueError("line ends don't part words in this vocabulary")
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _known(self, words: pa.LargeStringArray) -> np.ndarray:
        """Where distinct words stand among the known ones; new ones are asked for and kept."""
        if len(self.known) > WORDS:
            half = WORDS // 2
            self.known, self.ids, self.ends = pa.concat_arrays([self.known.slice(0, half)]), self.ids[: self.ends[half]].copy(), self.ends[: half + 1].copy()
        at = pc.index_in(words, value_set=self.known)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        ids, count = self._parted(words.filter(pa.array(new)))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(int(new.sum()))
        self.known = pa.concat_arrays([self.known, words.filter(pa.array(new))])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(count))
        self.ids = np.append(self.ids, ids)
        return at

    def _words(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct words, each with the blank or the line end before it."""
        after = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        bare = after | pc.starts_with(words, _FIRST).to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(bare), pc.utf8_slice_codeunits(words, 1), pc.binary_join_element_wise(_text(" "), words, _text("")))
        # between a letter and a final mark pieces are always cut, so the word without it will do
        marked = pc.match_substring_regex(words, r"\p{L}[.,;:!?]$")
        last = pc.if_else(marked, pc.utf8_slice_codeunits(words, -1), _text("")).dictionary_encode()
        mark = np.array([self.marks.get(c, 0) for c in last.dictionary.to_pylist()], "<u4")[last.indices.to_numpy()]
        tail = marked.to_numpy(zero_copy_only=False).astype(np.int64)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words).dictionary_encode()
        which = self._known(stems.dictionary)[stems.indices.to_numpy()]
        start, count, ids = self.ends[which], np.diff(self.ends)[which], self.ids
        lead = after.astype(np.int64)
        size = lead + count + tail
        ends = np.cumsum(size)
        out = np.full(int(size.sum()), self.line, "<u4")
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(ends - size + lead, count) + step] = ids[np.repeat(start, count) + step]
        out[(ends - 1)[tail == 1]] = mark[tail == 1]
        offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts.fill_null("").cast(pa.large_string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        which = np.flatnonzero(odd)
        for k, ids in zip(which.tolist(), self._whole(texts.take(pa.array(which)).to_pylist())):
            out[k] = ids
        which = np.flatnonzero(~odd)
        if not len(which):
            return out
        spaced = pc.replace_substring(pc.binary_join_element_wise(_text(_FIRST), texts.take(pa.array(which)), _text("")), "\n", " \n")
        split = pc.split_pattern(spaced, " ")
        flat = split.flatten().dictionary_encode()
        ids = self._words(flat.dictionary).take(flat.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for k, a, z in zip(which.tolist(), at, at[1:]):
            out[k] = bytes(data[a:z])
        return out


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


_RAW = "shard long, block int, base long, doc_ids binary, sizes binary, ids binary, counts binary"


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``TOGETHER`` bytes, of at least one row."""
    held, size = [], 0
    for b in batches:
        rows = max(1, b.num_rows * TOGETHER // max(1, b.nbytes))
        for i in range(0, b.num_rows, rows):
            part = b.slice(i, rows)
            held.append(part)
            size += part.nbytes
            if size >= TOGETHER:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def tokenize(docs: DataFrame, path: str, n_parts: int) -> DataFrame:
    """Blocks of raw ids, each document followed by END_ID; sorted by doc_id, ties by text, nulls first.
    A shard is a range of doc_id and of the texts' first code points, so that rows of one doc_id are no single task's,
    and has its range's number. Its last row (block null) has the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = word_encoder(path), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        keys: list[int | None] = []
        ids: list[bytes] = []
        size = base = block = 0
        total = np.zeros(0, np.int64)
        kinds, names = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4), [x.split()[0] for x in _RAW.split(", ")]

        def close():
            nonlocal keys, ids, size, base, block, total
            flat = np.frombuffer(b"".join(ids), "<u4")
            count = np.bincount(flat, minlength=len(total))
            count[: len(total)] += total
            total = count
            # two bytes an id where that is enough: the sizes tell
            flat = flat.astype("<u2") if flat.max() < 1 << 16 else flat
            sizes = np.array([len(x) // 4 for x in ids], "<u4")
            nulls = np.array([k is None for k in keys], np.uint8)
            packed = np.array([k or 0 for k in keys], "<i8").tobytes() + nulls.tobytes()
            row = [[shard], [block], [base], [packed], [sizes.tobytes()], [flat.tobytes()], [None]]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=names)
            base, block, keys, ids, size = base + size, block + 1, [], [], 0
            return out

        for part in _together(batches):
            for k, x in zip(part.column(0).to_pylist(), encode(part.column(1))):
                keys.append(k)
                ids.append(x + end)
                size += len(x) // 4 + 1
                if size >= BLOCK:
                    yield close()
        if keys:
            yield close()
        if len(total):
            row = [[shard], [None], [base], [None], [None], [None], [total.astype("<i8").tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names=names)

    # null and empty texts are the same
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.repartitionByRange(n_parts, F.col("doc_id").asc(), F.substring("text", 1, HEAD).asc()).sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, _RAW)


def count_ids(raw: DataFrame) -> DataFrame:
    """``id, n`` over all shards; each shard sends one row per id it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                total = np.frombuffer(x, "<i8")
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return raw.where("block is null").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("the limit is too short for so many ids")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        every = np.concatenate([leaf, packages])
        rank = np.argsort(every, kind="stable")
        levels.append(rank < len(leaf))
        merged = every[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaf) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes ascend by length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    width = lengths[order].astype(np.int64)
    # each code fills a share of the code space; its start, cut to its length, is the code
    share = np.int64(1) << (LIMIT - width)
    codes[order] = (np.cumsum(share) - share) >> (LIMIT - width)
    return codes


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each LIMIT bits: the id they start with, and in the low byte the bits it takes."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    entry = (order.astype(np.int64) << 8) | lengths[order]
    table = np.repeat(entry, np.int64(1) << (LIMIT - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.full((1 << LIMIT) - len(table), 1, np.int64)])


#: Ids packed at once: arrays that stay in a core's cache.
_PACKED = 1 << 15


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits, most significant first, and the bit offset of every STEP-th id."""
    table = (codes << 8) | lengths
    total = int(lengths[ids].sum(dtype=np.int64))
    bits, offsets, base = np.zeros((total + 31 >> 5) + 2, np.uint64), [], 0
    for k in range(0, len(ids), _PACKED):
        entry = table[ids[k : k + _PACKED]]
        width = entry & 255
        ends = np.cumsum(width) + base
        at = ends - width
        word = at >> 5
        placed = (entry >> 8).astype(np.uint64) << (64 - (at & 31) - width).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        # codes share no bit, so a word's codes are joined, and what runs over goes to the next
        bits[word[first]] |= np.bitwise_or.reduceat(placed >> np.uint64(32), first)
        bits[word[first] + 1] |= np.bitwise_or.reduceat(placed & np.uint64(0xFFFFFFFF), first)
        offsets.append(at[::STEP])
        base = int(ends[-1])
    return bits.astype(">u4").tobytes(), np.concatenate(offsets or [np.zeros(0)]).astype("<u4")


def unpack(payload: bytes, offsets: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    words = np.frombuffer(payload, ">u4").astype(np.uint64)
    pair = (words[:-1] << np.uint64(32)) | words[1:]
    at = offsets.astype(np.int64)
    out = np.zeros((STEP, len(at)), np.uint32)
    top = len(pair) - 1
    for k in range(STEP):
        w = np.minimum(at >> 5, top)
        got = table[(pair[w] >> (np.int64(64 - LIMIT) - (at & 31)).astype(np.uint64)).astype(np.int64) & ((1 << LIMIT) - 1)]
        out[k] = got >> 8
        at += got & 255
    return out.T.reshape(-1)[:n]


_BLOCKS = "shard long, block int, base long, n_ids long, doc_ids binary, sizes binary, offsets binary, payload binary"


def huffman_blocks(raw: DataFrame, lengths: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for b in batches:
            for i in range(b.num_rows):
                part = b.slice(i, 1)
                raw_ids, n = part.column(5)[0].as_py(), int(np.frombuffer(part.column(4)[0].as_py(), "<u4").sum(dtype=np.int64))
                ids = np.frombuffer(raw_ids, "<u2" if len(raw_ids) == 2 * n else "<u4")
                payload, offsets = pack(ids, lengths, codes)
                more = [pa.array([len(ids)], pa.int64()), part.column(3), part.column(4), pa.array([offsets.tobytes()], pa.binary()), pa.array([payload], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *more], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return raw.where("block is not null").drop("counts").mapInArrow(run, _BLOCKS)


def write_ids(spark: SparkSession, docs: DataFrame, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Writes blocks and their code to the shared folder; returns both as read from there.

    Texts are tokenized once: raw ids are written first and deleted when the codes are. The driver gets
    a count per id of the vocabulary and no more."""
    raw = scratch.write(tokenize(docs, path, max(parts(spark), by_bytes(docs, RANGE_BYTES))), "raw", compression="snappy")
    got = count_ids(raw).collect()  # at most one row per id
    counts = np.zeros(max([r.id for r in got], default=0) + 1, np.int64)
    counts[[r.id for r in got]] = [r.n for r in got]
    lengths = code_lengths(counts)
    blocks = scratch.write(huffman_blocks(raw, lengths), "blocks", compression="none")
    codes = scratch.write(spark.createDataFrame([(bytes(lengths), LIMIT, STEP)], "lengths binary, code_limit int, step int"), "codes")
    scratch.drop("raw")
    return blocks, codes


def read_ids(blocks: DataFrame, codes: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: the ids of each document, decoded by the code file alone, as little-endian
    unsigned 32-bit integers; with ``digest`` their checksum ``ids_crc32`` in place of ids. It is an error if the code
    was written with another limit or step."""
    code = codes.first()
    if (code.code_limit, code.step) != (LIMIT, STEP):
        raise ValueError(f"the files have codes of {code.code_limit} bits and offsets every {code.step} ids")
    lengths = np.frombuffer(code.lengths, np.uint8)
    # a sum per shard; there are as many shards as ranges of documents
    sums = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    first, total = {}, 0
    for shard, n in sums:
        first[shard], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for shard, base, n, keys, sizes, offsets, payload in zip(*[b.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6, 7)]):
                ids = unpack(payload, np.frombuffer(offsets, "<u4"), n, table).astype("<u4")
                size = np.frombuffer(sizes, "<u4").astype(np.int64)
                ends = np.cumsum(size)
                key = np.frombuffer(keys, "<i8", len(size))
                null = np.frombuffer(keys, np.uint8, len(size), 8 * len(size)).astype(bool)
                each = zip((ends - size).tolist(), ends.tolist())
                data = pa.array([zlib.crc32(ids[a:z]) for a, z in each], pa.int64()) if digest else pa.array([ids[a:z].tobytes() for a, z in each], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64(), mask=null), pa.array(first[shard] + base + ends - size, pa.int64()), pa.array(size, pa.int64()), data], names=["doc_id", "start", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'binary'}")


def id_digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Per document, from the files read back: ``doc_id, start, n_tokens, ids_crc32``.

    Null and empty texts have the end id alone; rows with equal doc_ids follow each other by text;
    null doc_ids come first; an empty table gives no rows."""
    scratch = Scratch(spark, "ids")
    out = scratch.write(read_ids(*write_ids(spark, docs, path, scratch), digest=True), "digests")
    scratch.keep("digests")
    return out
