"""Operators that compare documents with each other or with other tables, against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshlake.llm import decontaminate, jaccard_join, queries, signature_tree, suffix_dedup, textnum, url_filter
from meshlake.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, rep int, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 0, "clash", 1, 2) for d, t in rows], DOCS)


def corpus(seed, n=60, size=60):
    """Texts with copies, near copies, shared passages, repetitions and awkward cases."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words, k))
    base = [text(size) for _ in range(n)]
    passage, rows = text(30), []
    for i, t in enumerate(base):
        rows.append((3 * i, t))
        kind = i % 6
        w = t.split(" ")
        if kind == 0:
            rows.append((3 * i + 1, t))
        elif kind == 1:
            for _ in range(rng.integers(1, 4)):
                w[rng.integers(0, len(w))] = text(1)
            rows.append((3 * i + 1, " ".join(w)))
        elif kind == 2:
            rows.append((3 * i + 1, text(20) + " " + passage + text(20)))
        elif kind == 3:
            rows.append((3 * i + 1, t.upper().replace(" ", "\n")))
    rows += [(9001, None), (9002, ""), (9003, "  \t"), (9004, "one two"), (9005, "One TWO"), (9006, "x" * 700), (9000, "x" * 120), (9007, "ab" * 300)]
    rows += [(9010, base[0]), (9010, base[1]), (9010, base[1]), (None, base[2]), (None, None)]
    return rows


def brute_suffixes(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if d is not None:
                first[b[p : p + 50]] = min(d, first.get(b[p : p + 50], d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if d is not None and first[b[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    got = Counter(map(tuple, suffix_dedup.dedup_digests(spark, frame(spark, rows)).collect()))
    assert got == Counter(brute_suffixes(rows))
    assert suffix_dedup.dedup_digests(spark, frame(spark, [])).count() == 0


def test_windows_across_segment_borders(monkeypatch):
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 123, 4000, dtype=np.uint8)
    runs = np.array([[k, 40] for k in range(0, 3900, 37)] + [[0, 3951]], np.int64)
    spans = runs[:, 0] << 32 | runs[:, 1]
    whole = suffix_dedup._run_windows(raw, spans)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    cut = suffix_dedup._run_windows(raw, spans)
    assert sorted(zip(*(x.tolist() for x in whole))) == sorted(zip(*(x.tolist() for x in cut)))
    assert len(set(whole[0].tolist())) == len(set(whole[1].tolist())) == 3951


def test_suffix_levels(spark):
    scratch = Scratch(spark, "test")
    index = suffix_dedup.SuffixIndex(spark, scratch, 4)
    for k in range(5):
        index.add(frame(spark, [(10 * k + i, f"{k}{i} " * 40) for i in range(3)]).selectExpr("doc_id", "0 tag", "text"))
    assert [size for size, _, _ in index.levels] == [2, 2, 1] or [size for size, _, _ in index.levels] == [4, 1]


def test_arrays_are_in_the_order_of_suffixes(spark):
    """Each packed array has its suffixes in byte order, equal anchors share a bucket, and every window has its run."""
    rows = [(d, t) for d, t in corpus(4) if d is not None and t]
    docs = frame(spark, rows).selectExpr("doc_id", "0 tag", "text")
    scratch = Scratch(spark, "order")
    index = suffix_dedup.SuffixIndex(spark, scratch, 8)
    index.add(docs.where("doc_id < 90"))
    index.add(docs.where("doc_id >= 90"))
    index._merge()
    assert [size for size, _, _ in index.levels] == [2]
    bucket, texts = {}, {}
    for d, t in rows:
        texts.setdefault(d, []).append(t.encode())
    for r in index.levels[0][2].collect():
        runs = suffix_dedup.Runs.unpack(r.n, [r[f] for f, _ in suffix_dedup._FIELDS], False)
        assert (runs.keys[1:] >= runs.keys[:-1]).all() and len(runs.keys) == r.n
        for key, doc, at, n in zip(runs.keys.tolist(), runs.docs.tolist(), runs.starts.tolist(), runs.lengths.tolist()):
            assert bucket.setdefault(key, r.bucket) == r.bucket
            assert any(key in t[at : at + n + 49] for t in texts[doc])


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    monkeypatch.setattr(textnum, "CHUNK", 300)
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(97, 100, 2500, dtype=np.uint8))
    seen = np.zeros(len(data) - 49, int)
    for _, lo, n, *_ in suffix_dedup.text_runs([data]):
        for a, k in zip(lo, n):
            seen[a : a + k] += 1
    assert (seen == 1).all()
    text = ("word " * 50 + "y" * 900 + " tail").encode()
    got = list(textnum.word_hashes([text]))
    assert len(got) == 1 and len(got[0][1]) == len(text.split()) and [text[a:z] for a, z in zip(got[0][3], got[0][4])] == text.split()


def test_hot_anchors_stay_exact(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    n = 6
    runs = suffix_dedup.Runs(keys=np.full(n, b"a" * 24, "S24"), checks=np.array([1, 1, 2, 3, 4, 5], np.uint64), docs=np.array([1, 2, 3, 4, 5, 6]), tags=np.zeros(n, np.uint64), starts=np.zeros(n, np.int64), lengths=np.ones(n, np.int64), asked=np.zeros(n, np.uint64), old=np.zeros(n, bool))
    runs, cut, differs, hot = suffix_dedup.resolve(runs)
    assert cut.tolist() == [False, True, False, False, False, False] and differs.sum() == 5 and hot.sum() == 3


def hot_corpus():
    """A long text with one anchor in 1500 contexts, and a short one that shares a piece of one."""
    rng = np.random.default_rng(0)
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    some = letters(200_000)
    sums, (_, down) = textnum.prefix_sums(np.frombuffer(some.encode(), np.uint8)), textnum.powers(len(some) + 1)
    least = int(np.argmin(textnum.mix((sums[24:] - sums[:-24]) * down[: len(some) - 23])))
    blocks = [letters(30) + some[least : least + 24] + letters(30) for _ in range(1500)]
    return "".join(blocks), letters(20) + blocks[2][12:72] + letters(20)


@pytest.mark.parametrize("ids", [(1, 2), (2, 1)])
def test_hot_anchors_of_one_long_document(spark, ids):
    rows = [*zip(ids, hot_corpus()), *[(d, f"text {d}") for d in range(100, 120)]]  # both in the first batch
    got = Counter(map(tuple, suffix_dedup.dedup_digests(spark, frame(spark, rows).coalesce(1)).collect()))
    assert got == Counter(brute_suffixes(rows)) and any(r[0] == 2 and r[2] > 0 for r in got)


def test_hot_anchors_of_a_repeated_doc_id(spark):
    """Two rows of one doc_id in tasks of their own, with more runs of one anchor than the arrays keep."""
    rng = np.random.default_rng(1)
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    long, _ = hot_corpus()
    blocks = [long[i : i + 84] for i in range(0, 84 * 300, 84)]
    rows = [(5, "".join(blocks[:150])), (5, "".join(blocks[150:])), *[(d, letters(80)) for d in range(100, 140)], (900, letters(10) + " ".join(b[10:74] for b in blocks))]
    docs = frame(spark, rows).repartition(len(rows))
    got = Counter(map(tuple, suffix_dedup.dedup_digests(spark, docs).collect()))
    assert got == Counter(brute_suffixes(rows)) and any(r[0] == 900 and r[2] > 15_000 for r in got)


def test_later_batches_meet_the_saved_index(spark, tmp_path):
    rows = [r for r in corpus(7) if r[0] is not None]
    first, later = [r for r in rows if r[0] < 100], [r for r in rows if r[0] >= 100]
    old = frame(spark, first)
    suffix_dedup.dedup(spark, old, index_path=str(tmp_path / "index")).count()
    got = suffix_dedup.dedup(spark, frame(spark, later), index_path=str(tmp_path / "index"), earlier=old).collect()
    want = Counter(r for r in brute_suffixes(rows) if r[0] >= 100)
    assert Counter((r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in got) == want
    assert any(r[2] > 0 for r in want)


def test_an_asked_anchor_asks_for_the_rest():
    n = 2  # both of one document, the first kept of an anchor whose hot runs are in no array
    runs = suffix_dedup.Runs(keys=np.full(n, b"a" * 24, "S24"), checks=np.array([1, 2], np.uint64), docs=np.array([1, 1]), tags=np.array([1, 2], np.uint64), starts=np.zeros(n, np.int64), lengths=np.ones(n, np.int64), asked=np.array([1, 0], np.uint64), old=np.zeros(n, bool))
    assert suffix_dedup.resolve(runs)[2].all()


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    sets = [shingles(t) for _, t in rows]
    up = {d: d for d, _ in rows}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            e = rows[j][0]
            if d is not None and e is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(d), root(e)))
                up[b] = a
    return Counter((d, len(s), None if d is None else root(d)) for (d, _), s in zip(rows, sets))


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # read where the plan is made
    rng = np.random.default_rng(5)
    rows = corpus(3)
    base = rows[0][1].split(" ")
    for i in range(40):  # one large group of near copies, many just at the limit
        w = list(base)
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = f"q{rng.integers(0, 50)}"
        rows.append((5000 + i, " ".join(w)))
    got = Counter(map(tuple, jaccard_join.join_documents(spark, frame(spark, rows)).collect()))
    assert got == brute_join(rows)
    if block == 512:
        assert jaccard_join.join_documents(spark, frame(spark, [])).count() == 0
        kept = jaccard_join.keep_one(spark, frame(spark, rows))
        assert kept.columns == frame(spark, []).columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, c in brute_join(rows).elements() if d == c)


def test_signature_tree():
    rng = np.random.default_rng(8)
    for _ in range(20):
        sets = []
        for _ in range(60):
            own = set(rng.integers(0, 2**62, rng.integers(1, 40)).tolist()) if not sets or rng.random() < 0.4 else set(sets[rng.integers(0, len(sets))].tolist())
            own = {x for x in own if rng.random() > 0.08} | set(rng.integers(0, 2**62, rng.integers(0, 3)).tolist())
            sets.append(np.array(sorted(own or {1}), np.uint64))
        up = list(range(60))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for i in range(60):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 4 * len(a & b) >= 3 * len(a | b):
                    up[root(i)] = root(j)
        s = signature_tree.Sets(sets)
        for i, j in signature_tree.links(sets):
            assert root(i) == root(j)
            s.link(i, j)
        assert {(i, j) for i in range(60) for j in range(i) if s.root(i) == s.root(j)} == {(i, j) for i in range(60) for j in range(i) if root(i) == root(j)}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label
    assert components(spark, spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_of_an_ascending_chain(spark):
    """Labels that ascend along a chain: doublings, not rounds, grow with its length, and only with its logarithm."""
    n = 4000
    scratch = Scratch(spark, "chain")
    got = components(spark, spark.range(n).selectExpr("id a", "id + 1 b"), scratch)
    assert got.where("component = 0").count() == got.count() == n + 1
    assert len([x for x in scratch.names if "-e" in x]) <= 3 and len(scratch.names) <= 20


def test_blocks_of_one_giant_group_are_pruned(spark):
    """Blocks are paired only if they share a prefix shingle and their sizes can link."""
    rows, prefix = [], []
    for k in range(200):  # a shingle that all have, one that every tenth has, two sizes that can't link
        rows.append((1, k, (-1, k % 2 * 5, k)))
        prefix += [(k, 7)] if k < 100 else []
        prefix += [(k, 1000 + k % 10)]
    blocks = spark.createDataFrame(rows, "g long, rep long, at struct<pool:long,cls:int,block:int>")
    got = {(r.x.block, r.y.block) for r in jaccard_join.block_pairs(blocks, spark.createDataFrame(prefix, "rep long, token long")).collect()}
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if a % 2 == b % 2 and (a % 10 == b % 10 or (a < 100 and b < 100))}
    assert {p for p in got if p[0] != p[1]} == {(a, b) if (a % 2 * 5, a) < (b % 2 * 5, b) else (b, a) for a, b in want}


def edit_distance(a, b):
    """Least edits from a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_all_windows_go_on_if_the_recall_is_not_reached(monkeypatch):
    monkeypatch.setattr(decontaminate, "SAMPLE", 60)
    items = decontaminate.Items([(k, " ".join(f"w{k}x{j}" for j in range(40))) for k in range(30)])
    h, n = np.concatenate(items.words[::-1]), np.arange(30) * 40
    assert items.agree(h, n, n, n + 40, np.arange(30)).all()


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 7))) for _ in range(150)]
    text = lambda k: list(rng.choice(words, k))
    items = [(i, " ".join(text(int(rng.integers(5, 50))))) for i in range(25)] + [(100, None), (101, ""), (102, "too short"), (None, "a b c d e f")]
    rows = [(1000, None), (1001, ""), (1002, " ".join(text(30))), (None, items[0][1])]
    for i, t in items[:25]:
        for edits in (0, 0.1, 0.24, 0.5):
            w = t.split(" ")
            for _ in range(int(edits * len(w))):
                k = int(rng.integers(0, len(w)))
                w[k : k + 1] = [["zz"], [], [w[k], "yy"]][rng.integers(0, 3)]
            rows.append((i * 10 + int(edits * 10), " ".join(text(20) + w + text(20))))
    rows.append((2000, "!! " + items[3][1].upper().replace(" ", " ,\n")))
    rows.append(rows[5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(frame(spark, rows), bench).collect()
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    want = Counter()
    for d, t in rows:
        for i, s in items:
            a = split(s)
            if i is not None and len(a) >= 5 and (e := edit_distance(a, split(t))) <= len(a) // 4:
                want[d, i, e] += 1
    found = Counter((r.doc_id, r.item_id, r.edits) for r in got)
    assert not found - want  # every report is exact
    assert sum(found.values()) >= 0.97 * sum(want.values())
    assert {k for k in want if k[2] == 0} <= set(found)
    kept = decontaminate.drop_leaks(spark, frame(spark, rows), bench)
    bad = {r.doc_id for r in got}
    assert kept.columns == frame(spark, []).columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad)
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, rows), bench.where("false")).count() == 0


def test_items_in_very_long_texts(spark):
    rng = np.random.default_rng(9)
    word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 50_000, k))
    items = [(1, word(40)), (2, word(12))]
    parts = items[0][1].split(" ")
    near = " ".join(["zz" if k % 5 == 0 else w for k, w in enumerate(parts)])
    long = word(150_000) + " " + items[0][1] + " " + word(150_000) + " " + items[1][1]
    rows = [(1, long), (2, word(200_000) + " " + near), (3, word(200_000)), (4, items[1][1] + " " + "x" * 2_000_000)]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, 0), (1, 2, 0), (2, 1, 8), (4, 2, 0)}


def test_settings_come_back(spark):
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "777")
    try:
        jaccard_join.join_documents(spark, frame(spark, corpus(8)[:20])).count()
        assert [spark.conf.get(n) for n in names] == ["777", *before[1:]]
    finally:
        spark.conf.unset(names[0])


def test_scans_keep_their_tasks(spark):
    """Plans without a shuffle have as many tasks as their input, and scratch tables go."""
    import os

    from meshlake.llm import byte_bpe, secret_scan

    many = frame(spark, corpus(8)).repartition(13)
    import public_tokenizers

    for out in (secret_scan.scan_documents(many), secret_scan.redact(many), byte_bpe.encode_documents(many, public_tokenizers.path("byte_bpe_50k.tiktoken"))):
        assert out.rdd.getNumPartitions() == 13
    since = len(Scratch.made)
    out = jaccard_join.join_documents(spark, many)
    (own,) = Scratch.made[since:]
    assert os.listdir(own.root) == ["out"] and out.count() == many.count()
    Scratch.release(since)
    assert not os.path.exists(own.root)


def test_items_in_scripts_without_blanks(spark):
    item = "数据清洗需要在训练之前删除基准测试中的所有题目与答案"
    docs = frame(spark, [(1, "前文很长很长。" + item + "后文"), (2, "完全不同的内容没有关系" * 5), (3, "intro " + item[:3] + "x" + item[4:] + " outro")])
    got = {(r.doc_id, r.edits) for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(1, 0), (3, 1)}


def test_walks_take_room_by_length():
    few = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(50)]
    short, mixed = decontaminate.Items(few), decontaminate.Items([*few, (99, " ".join(f"z{j}" for j in range(3000)))])
    size = lambda items: sum(w.nbytes for walks in items.walks.values() for w in walks)
    assert size(mixed) <= size(short) + 3 * 3000 * 4 * decontaminate.WALKS and mixed.recall >= decontaminate.RECALL
    text = "before " + " ".join(f"z{j}" for j in range(3000) if j % 10) + " " + few[3][1]
    assert {(i, e) for _, i, e, _ in mixed.find([text * 3])} == {(3, 0), (50, 300)}


def test_url_filter(spark):
    canon = lambda u: f'<head><LINK rel="canonical" href="{u}"></head>'
    refresh = lambda u: f"<meta http-equiv='refresh' content='0; url={u}'>"
    pages = [
        (1, "https://Spam.COM/en/1#x", None), (2, "http://other.test/a", canon("https://spam.com/en/1")), (3, "http://third.test/b?q=1", refresh("//other.test/a")),
        (4, "https://www.example.com/en/77", "x"), (5, "http://mixed.test/", canon("https://example.com/en/7")), (6, "http://mixed2.test/", canon("http://mixed.test/")), (7, "http://a.com/en/x", canon("http://mixed.test/")),
        (8, None, canon("https://spam.com/en/1")), (9, "no scheme", None), (10, "http://example.net/de/8?x", None), (11, "http://a.net/de/8", None), (12, "http://rel.com/fr/x", canon("../en/zz")), (13, "http://r2.com/x", canon("/en/q")), (2, "http://other.test/a", None), (14, "http://notcom/en/", None),
    ]
    got = defaultdict(set)
    for r in url_filter.judge_pages(spark, spark.createDataFrame([(*p, "clash", "c") for p in pages], "page_id long, url string, html string, node string, rule string")).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    assert got[1] == {("spam.com", "/en/1", "com/en/", "block")}
    assert {v for k in (2, 3, 13) for *_, v in got[k]} == {"block"}
    assert got[4] == {("www.example.com", "/en/77", "example.com/en/7", "allow")}
    assert [next(iter(got[k]))[3] for k in (5, 6, 7)] == ["allow", "allow", "block"]
    assert got[8] == got[9] == {("", "", None, "allow")}
    assert next(iter(got[10]))[2:] == ("example.net/de/8", "block") and next(iter(got[11]))[2:] == ("net/de/", "allow") and next(iter(got[14]))[2] is None
    more = spark.createDataFrame([("http://new.test/", "http://third.test/b?q=1")], "source_url string, target_url string")
    table = spark.createDataFrame([*pages[:3], (20, "http://new.test/", None)], "page_id long, url string, html string")
    assert {r.verdict for r in url_filter.judge_pages(spark, table, redirects=more).collect()} == {"block"}
    assert url_filter.judge_pages(spark, table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from meshlake.llm import quality_classifier, secret_scan

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality_classifier.classify(spark, docs, labels).collect() if r.score >= 0.3}
    one = {d for d, _, c in brute_join([(d, rows[d].text) for d in sorted(good)]) if d == c}
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [split(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d for d in one if not any(" ".join(i) in " ".join(split(rows[d].text)) for i in items)}
    got, at = docs, docs
    wants = (good, one, left, left)
    for (_, stage), want in zip(corpus_pipeline.STAGES, wants):
        got = stage(spark, at, sf)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
        at = spark.createDataFrame(got.collect(), got.schema)
    for r in got.collect():
        assert not secret_scan.scan_text(r.text) and r.n_chars == len(r.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == left


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, name):
    import glob
    import os

    import duckdb

    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for p in glob.glob(f"{folder}/*.parquet"):
            con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cursor = con.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = sorted(cursor.fetchall(), key=repr)
    got = queries.queries()[name](spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want


def test_least_document_of_a_window():
    key, doc = np.array([7, 3, 7, 3, 2**63 + 1], np.uint64), np.array([5, 9, 2, 8, 1])
    order, least, keys, first = suffix_dedup._least(key, doc)
    assert dict(zip(order.tolist(), least.tolist())) == {0: 2, 2: 2, 1: 8, 3: 8, 4: 1}
    assert keys.tolist() == [3, 7, 2**63 + 1] and first.tolist() == [8, 2, 1]
