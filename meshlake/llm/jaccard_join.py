"""N-gram Jaccard join: documents whose sets of five-word shingles have a similarity of 0.75 or more.

1. Which texts can have a partner. A partner shares three quarters of a text's shingles at least. Each
   task sends 44-bit fingerprints of its shingles, sorted and packed per bucket; buckets count, per text, the
   shingles that another text has too. Most texts end here.
2. Sets of the rest; equal sets become one class.
3. Candidate groups: shingles of a class are ordered from rare to frequent, those of the class alone
   first; linked classes share one in the prefix that a link cannot spare. Connected components over
   shared prefix shingles hold all links.
4. Within a group, signature trees find the links (signature_tree.py). A large group is cut into blocks:
   first each block by itself, then one member of each block's components, then pairs of blocks that are
   not yet one component, hold sets of sizes that can link and share a prefix shingle. No pair of classes that can
   link and is in different components is left out.

Links are kept as a spanning forest, which gives the components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import signature_tree
from .common import Scratch, by_bytes, components, maybe_in, parts
from .textnum import pack_planes, release, unpack_planes, windows, word_hashes

#: Similarity as a fraction, words of a shingle, bits of a fingerprint, shingles of a packed batch.
NUM, DEN, WORDS, PRINT_BITS, BATCH = 3, 4, 5, 44, 2_000_000
#: Fingerprints have so many bits more than a table's size in bytes, if that is more than PRINT_BITS: few collide at any size.
SPARE_BITS = 10
#: Members and shingles of a block of a candidate group.
BLOCK, BLOCK_TOKENS = 512, 1_000_000
#: Blocks that share a shingle, up to which their pairs are listed shingle by shingle.
COMMON = 32
#: Bytes of a table for each bucket of fingerprints: a worker holds a bucket.
BUCKET_BYTES = 64 << 20


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; of the whole sequence if it has fewer
    words; empty without words. Only A-Z are lower-cased."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = []
    for _, h, cut, _, _ in word_hashes(data):
        five = windows(h, WORDS)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if z - a >= WORDS:
                out.append(np.unique(five[a : z - WORDS + 1]))
            else:
                out.append(windows(h[a:z], z - a) if z > a else np.zeros(0, np.uint64))
    return out


_PACKED = "bucket int, batch long, n int, docs int, prints binary, owners binary, ids binary, sizes binary"


def pack_prints(docs: DataFrame, buckets: int, bits: int = PRINT_BITS) -> DataFrame:
    """Per batch of texts: a row for each bucket with fingerprints and whose they are, and a row (bucket
    null) with the texts' ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, width = TaskContext.get().partitionId(), 0, -(-bits // 8)
        ids: list[int | None] = []
        sets: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, sets, held, seq
            batch, seq = (part << 24) | seq, seq + 1
            size = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), size)
            prints = np.concatenate(sets) >> np.uint64(64 - bits)
            order = np.argsort(prints, kind="stable")
            prints, owner = prints[order], owner[order]
            edge = np.searchsorted(prints, (np.arange(1, buckets, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64))
            edge = np.concatenate([[0], edge, [len(prints)]])
            rows = []
            for b in range(buckets):
                p, o = prints[edge[b] : edge[b + 1]], owner[edge[b] : edge[b + 1]]
                if len(p):
                    rows.append((b, batch, len(p), len(sets), pack_planes(np.diff(p, prepend=np.uint64(0)), width), pack_planes(o, 4), None, None))
            null = np.array([i is None for i in ids], np.uint8)
            rows.append((None, batch, 0, len(sets), None, None, np.array([i or 0 for i in ids], "<i8").tobytes() + null.tobytes(), size.astype("<i8").tobytes()))
            ids, sets, held = [], [], 0
            release()
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])

        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                new = shingle_sets(s.column(1).to_pylist())
                ids += s.column(0).to_pylist()
                sets += new
                held += sum(map(len, new)) + len(new)
                if held >= BATCH:
                    yield flush()
        if sets:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


_COUNTED = "batch long, docs int, shared binary, ids binary, sizes binary"


def count_shared(packed: DataFrame, buckets: int, bits: int = PRINT_BITS) -> DataFrame:
    """Per bucket and batch: how many of each text's fingerprints another text has too. Rows without a
    bucket pass through. A bucket's batches arrive one after another and are merged when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _COUNTED.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        now, held = None, []

        def merged():
            prints = np.concatenate([np.cumsum(unpack_planes(p, n, -(-bits // 8))) for _, n, _, p, _ in held])
            order = np.argsort(prints, kind="stable")  # merges sorted runs
            prints = prints[order]
            again = np.zeros(len(prints) + 1, bool)
            again[1:-1] = prints[1:] == prints[:-1]  # a text sends a fingerprint once, or twice if it collides
            shared = np.zeros(len(prints), bool)
            shared[order] = again[1:] | again[:-1]
            rows, at = [], 0
            for batch, n, docs, _, o in held:
                count = np.bincount(unpack_planes(o, n, 4)[shared[at : at + n]].astype(np.int64), minlength=docs)
                rows.append((batch, docs, pack_planes(count, 4), None, None))
                at += n
            held.clear()
            del prints, order, again, shared
            release()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for bucket, batch, n, docs, prints, owners, ids, sizes in zip(*[b.column(i).to_pylist() for i in range(8)]):
                if held and bucket != now:
                    yield merged()
                if bucket is None:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((batch, docs, None, ids, sizes), kinds)], names=names)
                else:
                    now = bucket
                    held.append((batch, n, docs, prints, owners))
        if held:
            yield merged()

    # rows of ids are dealt by batch, those of fingerprints by bucket
    where = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("batch"), F.lit(buckets)).cast("int"))
    return packed.repartitionById(buckets, where).sortWithinPartitions("bucket", "batch").mapInArrow(run, _COUNTED)


def doc_sizes(counted: DataFrame, n_parts: int) -> DataFrame:
    """``doc_id, n_shingles, candidate``: whether enough of a text's shingles are shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, own = None, None, None

        def flush():
            ids, sizes = own
            n = len(sizes)
            shared = total if total is not None else np.zeros(n, np.int64)
            null = np.frombuffer(ids, np.uint8, n, 8 * n).astype(bool)
            can = (DEN * shared >= NUM * sizes) & (sizes > 0) & ~null
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8", n), pa.int64(), mask=null), pa.array(sizes, pa.int64()), pa.array(can)], names=["doc_id", "n_shingles", "candidate"])

        for b in batches:
            for batch, docs, shared, ids, sizes in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if now is not None and batch != now:
                    yield flush()
                    total = own = None
                now = batch
                if ids is not None:
                    own = ids, np.frombuffer(sizes, "<i8")
                else:
                    c = unpack_planes(shared, docs, 4).astype(np.int64)
                    total = c if total is None else total + c
        if now is not None:
            yield flush()

    return counted.repartition(n_parts, "batch").sortWithinPartitions("batch").mapInArrow(run, "doc_id long, n_shingles long, candidate boolean")


def with_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, tokens, set_id``."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                sets = shingle_sets(s.column(1).to_pylist())
                data = [x.astype("<u8").tobytes() for x in sets]
                cols = [s.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(data, pa.binary()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in data], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "tokens", "set_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, tokens binary, set_id binary")


def candidate_groups(spark: SparkSession, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` over classes ``(rep, n, tokens)`` that share a prefix shingle, and ``(rep, token)``
    of the prefixes."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rep, n, x in zip(*[b.column(i).to_pylist() for i in range(3)]):
                tokens = np.frombuffer(x, "<i8")
                for k in range(0, len(tokens), 1 << 20):
                    t = tokens[k : k + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), rep)), pa.array(np.full(len(t), n))], names=["token", "rep", "n"])

    tokens = classes.select("rep", "n", "tokens").mapInArrow(explode, "token long, rep long, n long")
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # of n - ceil(3n/4) + 1 places of the prefix, shingles of the class alone take theirs first
    room = F.col("n") - F.expr(f"({NUM} * n + {DEN - 1}) div {DEN}") + 1 - (F.col("n") - F.size("t"))
    prefix = scratch.write(shared.where(room > 0).select("rep", F.explode(F.slice("t", F.lit(1), F.greatest(room, F.lit(1)).cast("int"))["token"]).alias("token")), "prefix")
    first = prefix.groupBy("token").agg(F.min("rep").alias("a"), F.count("*").alias("k")).where("k > 1")
    edges = prefix.join(first, "token").select("a", F.col("rep").alias("b"))
    return components(spark, edges, scratch, "groups"), prefix


def tree_links(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """``(a, b)``: links found by the signature tree within each group of rows ``keys, rep, comp, tokens``.
    Groups are of bounded size. ``comp``: the component known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keys)
        now, reps, comps, sets = None, [], [], []

        def flush():
            got = signature_tree.links(sets, NUM, DEN, np.array(comps))
            out = pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in got], pa.int64()), pa.array([reps[j] for _, j in got], pa.int64())], names=["a", "b"])
            large = len(reps) > 100
            reps.clear(), comps.clear(), sets.clear()
            if large:
                release()
            return out

        for b in batches:
            rows = [b.column(i).to_pylist() for i in range(k + 3)]
            for *key, rep, comp, x in zip(*rows):
                if key != now and reps:
                    yield flush()
                now = key
                reps.append(rep), comps.append(comp), sets.append(np.frombuffer(x, "<u8"))
        if reps:
            yield flush()

    n = parts(grouped.sparkSession)
    rows = grouped.select(*keys, "rep", "comp", "tokens").repartition(n, *keys).sortWithinPartitions(*keys, "rep")
    return rows.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``block``: their share of a group, cut by a hash into blocks of bounded size."""
    size = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    return rows.join(size, keys).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def block_pairs(blocks: DataFrame, prefix: DataFrame) -> DataFrame:
    """``(g, x, y)``: the pairs of blocks ``at`` of the rows ``g, rep, at`` that can hold a link, before any set is sent.

    A block has sets of one component (its pool) or of many (pool -1), of one class of sizes: linked sets are of the
    same or of neighbouring classes, as a class spans the factor within which sizes can link. And linked sets
    share a prefix shingle: pairs are listed by shingle where few blocks have it; blocks with a shingle that more
    have are paired with each other, which is a pair each and not one for each such shingle."""
    own = prefix.join(blocks.select("rep", "g", "at"), "rep").groupBy("g", "token", "at").agg(F.count("*").alias("c"))
    inner = (F.col("c") > 1) & (F.col("at.pool") == -1)
    own = own.select("g", "token", "at", inner.alias("inner"))
    common = own.groupBy("g", "token").agg(F.count("*").alias("blocks"), F.max("inner").alias("any")).where("blocks > 1 or any")
    own = own.join(common, ["g", "token"])
    rare, often = own.where(F.col("blocks") <= COMMON), own.where(F.col("blocks") > COMMON)

    def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
        x, y = rows.select(*keys, F.col("at").alias("x")), rows.select(*keys, F.col("at").alias("y"))
        return x.join(y, keys).select("g", "x", "y")

    every = paired(rare, ["g", "token"]).unionByName(paired(often.select("g", "at").distinct(), ["g"]))
    near = F.abs(F.col("x.cls") - F.col("y.cls")) <= 1
    return every.where("x < y or (x = y and x.pool = -1)").where("x.pool <> y.pool or x.pool = -1").where(near).distinct()


def group_links(spark: SparkSession, classes: DataFrame, groups: DataFrame, prefix: DataFrame, scratch: Scratch) -> DataFrame:
    member = classes.join(groups.withColumnsRenamed({"node": "rep", "component": "g"}).hint("merge"), "rep").select("g", "rep", "n", "tokens")
    member = scratch.write(_blocks(member, ["g"]), "members")
    found = scratch.write(tree_links(member.withColumn("comp", F.col("rep")), ["g", "block"]), "links-1")
    large = member.where("blocks > 1").drop("block", "blocks")
    if large.isEmpty():
        return found

    def labelled(links: DataFrame, name: str) -> DataFrame:
        comp = components(spark, links, scratch, name).withColumnsRenamed({"node": "rep", "component": "comp"})
        return large.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))

    # one member of each component so far: near copies in different blocks mostly meet here
    lead = labelled(found, "in-blocks").where("comp = rep")
    found = found.unionByName(scratch.write(tree_links(_blocks(lead, ["g"]), ["g", "block"]), "links-2"))
    # now every pair that is left: blocks of one component, or of the small ones together
    now = scratch.write(labelled(found, "leaders"), "labelled")
    size = now.groupBy("g", "comp").agg(F.count("*").alias("c"))
    now = now.join(size, ["g", "comp"]).withColumn("pool", F.when(F.col("c") >= BLOCK // 4, F.col("comp")).otherwise(F.lit(-1).cast("long")))
    # sizes that link differ by DEN / NUM at most, so their classes by one at most
    now = now.withColumn("cls", F.floor(F.log("n") / math.log(DEN / NUM) + 1e-9).cast("int"))
    now = _blocks(now.drop("c"), ["g", "pool", "cls"]).select("g", "rep", "n", "tokens", "comp", F.struct("pool", "cls", "block").alias("at"))
    now = scratch.write(now, "pools")
    pair = scratch.write(block_pairs(now, prefix), "pairs")
    if pair.isEmpty():
        return found
    both = pair.withColumn("at", F.explode(F.array_distinct(F.array("x", "y"))))
    sent = now.join(both, ["g", "at"]).select("g", "x", "y", "rep", "comp", "tokens")
    return found.unionByName(scratch.write(tree_links(sent, ["g", "x", "y"]), "links-3"))


def join_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null and empty texts and texts without words have no shingles and their own doc_id as component, as
    has any text without a partner. Rows with one doc_id are one node: its component is the smallest
    doc_id reachable from any of them. A null doc_id is linked with nothing and has no component."""
    scratch, n = Scratch(spark, "jaccard"), parts(spark)
    buckets = max(2 * max(n, 8), by_bytes(docs.select("text"), BUCKET_BYTES))
    bits = min(64, max(PRINT_BITS, SPARE_BITS + by_bytes(docs.select("text"), 1).bit_length()))
    sizes = scratch.write(doc_sizes(count_shared(pack_prints(docs, buckets, bits), buckets, bits), n), "sizes")
    ids = sizes.where("candidate").select("doc_id").distinct()
    # the bitmap keeps most texts out of the shuffle; joins that carry texts or sets shuffle at every size
    rest = docs.select("doc_id", "text").where("doc_id is not null").where(maybe_in(ids))
    sets = scratch.write(with_sets(rest.join(ids.hint("merge"), "doc_id", "left_semi")), "sets").where("n > 0")
    by_set = scratch.write(sets.groupBy("set_id").agg(F.min("doc_id").alias("rep")), "by-set")
    member = sets.select("doc_id", "set_id").join(by_set, "set_id")
    first = sets.join(by_set.withColumnRenamed("set_id", "s").hint("merge"), (F.col("set_id") == F.col("s")) & (F.col("doc_id") == F.col("rep")))
    # a doc_id may stand for several sets, so a class is a node of its own
    node = scratch.write(first.dropDuplicates(["set_id"]).select(F.xxhash64("set_id").alias("rep"), "n", "tokens", "set_id"), "classes")
    groups, prefix = candidate_groups(spark, node, scratch)
    found = group_links(spark, node, groups, prefix, scratch)
    name = node.select(F.col("rep"), "set_id").join(by_set.withColumnRenamed("rep", "doc"), "set_id").select("rep", "doc")
    a = name.select(F.col("rep").alias("a"), F.col("doc").alias("da"))
    b = name.select(F.col("rep").alias("b"), F.col("doc").alias("db"))
    link = found.join(a, "a").join(b, "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    copy = member.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    joined = components(spark, link.unionByName(copy), scratch, "result").withColumnRenamed("node", "doc_id")
    out = sizes.join(joined, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = scratch.write(out, "out")
    scratch.keep("out")
    return out


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with its own columns. Documents
    without words stay; of rows that repeat a doc_id all stay."""
    scratch = Scratch(spark, "keep-one")
    drop = scratch.write(join_documents(spark, docs).where("component_id <> doc_id").select("doc_id"), "drop").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
