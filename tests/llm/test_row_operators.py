"""Operators that look at a row or a conversation at a time, against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from meshlake.llm import byte_bpe, chat_format, quality_classifier, quality_rules, secret_scan, token_output

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, ids int"
PAIN = [
    "", None, "   \n\t ", "one", "a b c d e a b c d e a b c d e", "Ünï cödé ☃ 漢字 text\x0bwith\x0cbreaks\r\n", "x" * 3000,
    "<|endoftext|> it's we'll  spaced   out 123 456!!!", "line one here\nline one here\nother #$%\n\n", "the cat sat on the mat " * 400, "\U0001f600" * 50 + " end",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], "s", 0, "clash", 1) for i, t in enumerate(PAIN)]
    rows += [(3, "one", "en", "s", 0, "clash", 1), (None, "no id here", None, None, None, None, None), (3, "one", "en", "s", 0, "clash", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_metrics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {g for g, n in Counter(five).items() if n > 1}
    covered = {i + k for i, g in enumerate(five) if g in often for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark, docs, empty):
    got = quality_rules.apply_rules(spark, docs).collect()
    want = Counter((r.doc_id, *brute_metrics(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules.apply_rules(spark, empty).count() == 0


def test_quality_rules_adapt(spark):
    rows = [(i, " ".join(f"word{(i * 7 + k * 13) % 997}x" for k in range(40)), "en", "s", 0, "", 0) for i in range(300)]
    rows += [(1000 + i, " ".join(f"wo{(i * 3 + k * 17) % 991}###" for k in range(40)), "en", "s", 0, "", 0) for i in range(10)]
    kept = {r.doc_id for r in quality_rules.apply_rules(spark, spark.createDataFrame(rows, DOCS)).where("kept").collect()}
    assert kept == set(range(300))


def test_quality_rules_differ_by_source(spark):
    """The same text passes in a source where its like is common, and fails in one where it is not."""
    plain = lambda i: " ".join(f"word{(i * 7 + k * 13) % 997}x" for k in range(40))
    marked = lambda i: " ".join(f"word{(i * 7 + k * 13) % 997}" + ("#" if k % 3 else "") for k in range(40))
    rows = [(i, marked(i) if i % 2 else plain(i), "en", "code", 0, "", 0) for i in range(400)]
    rows += [(1000 + i, plain(i), "en", "news", 0, "", 0) for i in range(400)] + [(2000, marked(1), "en", "news", 0, "", 0), (2001, marked(1), "en", "code", 0, "", 0)]
    rows += [(3000 + i, plain(i), None, None, 0, "", 0) for i in range(20)] + [(3100, marked(1), None, None, 0, "", 0)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark, spark.createDataFrame(rows, DOCS)).collect()}
    assert got[2001] and not got[2000] and all(got[i] for i in range(400)) and all(got[1000 + i] for i in range(400)) and all(got[3000 + i] for i in range(20))
    limits = {r.source: r for r in quality_rules.thresholds(quality_rules.sketch(quality_rules.with_rates(quality_rules.text_metrics(spark.createDataFrame(rows, DOCS))))).collect()}
    assert limits["code"].symbol_rate_hi > 2 * limits["news"].symbol_rate_hi


def test_repeats_under_equal_hashes(spark, monkeypatch):
    """Windows whose hashes collide are told apart by their words."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    texts = ["a b c d e x a b c d e y", "a b c d e f g h i j k", "p q p q p q p q p q"]
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_metrics(spark.createDataFrame([(i, t, "en", "s", 0, "", 0) for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == {i: brute_metrics(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", [*filter(None, PAIN), chat_format.HOSTILE, "<\\|im_end|> <|im_end|>", "<|line|>", "a <| b", "\\<\\\\|", "tail <"])
def test_chat_turns_come_back(text):
    for role in ("user", "assistant", text):
        out, lo, hi = chat_format.render_turn(role, text)
        assert [t[:2] for t in chat_format.parse(out + out)] == [(role, text)] * 2
        assert chat_format.unescape(out[lo:hi]) == text


def test_chat_digests(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "ROW_CHARS", 100)
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], PAIN[(c * 5 + t) % len(PAIN)], "x") for c in range(6) for t in range(c)]
    rows += [(None, 0, "assistant", "lost", "x"), (2, None, "user", "first", "x"), rows[3], rows[3]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(spark, table).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1), role or "", text or "") for k, t, role, text, _ in rows if k == c)
        turns, loss = "".join(f"{r}\n{t}\n" for _, r, t in own), "".join(t for _, r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-1].loss_sha256 == hashlib.sha256(chat_format.HOSTILE.encode()).hexdigest()
    assert chat_format.conversation_digests(spark, table.limit(0)).count() == 1


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = sorted(token_output.id_digests(spark, docs, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.id_digests(spark, empty, path).count() == 0


def test_token_files_over_the_whole_table(spark):
    """The call of the contract, on every document; and the files alone decode, block by block."""
    from tokenizers import Tokenizer

    from meshlake.llm.common import Scratch

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, docs = Tokenizer.from_file(path), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    hostile = [(10**6 + k, t) for k, t in enumerate(("a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "x" * 200_000, " ".join(f"w{j}" for j in range(120_000))))]
    docs = docs.unionByName(spark.createDataFrame(hostile, "doc_id long, text string"))
    scratch = Scratch(spark, "files")
    blocks, _ = token_output.write_ids(spark, docs, path, scratch)
    codes = spark.read.parquet(f"{scratch.root}/codes")
    got = {r.doc_id: r for r in token_output.read_ids(spark.read.parquet(f"{scratch.root}/blocks"), codes).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, bytes(got[r.doc_id].ids)) == (start, len(ids), ids.tobytes())
        start += len(ids)
    with pytest.raises(ValueError):
        token_output.read_ids(blocks, codes.withColumn("step", codes.step + 1))


def test_rows_of_one_doc_id_are_many_ranges(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(7, f"{k % 97} text {k}") for k in range(400)], "doc_id long, text string")
    raw = token_output.tokenize(docs, path, 8)
    assert raw.where("block is not null").select("shard").distinct().count() == 8
    got = sorted(token_output.id_digests(spark, docs, path).collect(), key=lambda r: r.start)
    assert len(got) == 400 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_words_and_pieces(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = token_output.WordEncoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(token_output, "GROUP", 5)
    monkeypatch.setattr(token_output, "WORDS", 20)
    rng = np.random.default_rng(6)
    parts = ["a", "the", "the,", "it's.", "..", "a1,", "é!", "-x:", "\n", " ", "  ", "\t", "'s", "don't", "12", "!?", "é", "\u00a0", "\u2028", "<|endoftext|>", "x" * 80, "\x01", "\n\n", "\n\n\n", ".\nThe", "\nThe", "x\n\ny", "\n<|endoftext|>"]
    texts = ["", *filter(None, PAIN), *("".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(300)), *(" ".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(300))]
    for i in range(0, len(texts), 7):
        for t, got in zip(texts[i : i + 7], own(pa.array(texts[i : i + 7], pa.string()))):
            assert np.frombuffer(got, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids


def test_huffman_codes():
    rng = np.random.default_rng(1)
    for counts in (np.array([5]), np.array([0, 3, 4]), 2 ** np.arange(40), rng.zipf(1.3, 5000), np.zeros(3, int)):
        lengths = token_output.code_lengths(counts.astype(float))
        used = lengths[lengths > 0].astype(int)
        assert ((lengths > 0) == (counts > 0)).all() and (len(used) < 2 or (2.0**-used).sum() == 1) and used.max(initial=0) <= token_output.LIMIT
        if len(used):
            ids = rng.choice(np.flatnonzero(counts), 1000)
            payload, offsets = token_output.pack(ids, lengths, token_output.canonical_codes(lengths))
            assert (token_output.unpack(payload, offsets, len(ids), token_output.decode_table(lengths)) == ids).all()


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 | -(-len(body).bit_length() // 8)]) + len(body).to_bytes(-(-len(body).bit_length() // 8), "big")
    return bytes([tag]) + size + body


def integer(k, size=1):
    return der(2, k.to_bytes(size, "big"))


NOISE = bytes((k * 89 + 7) % 251 for k in range(400))
OID = der(6, bytes.fromhex("2a864886f70d010101"))
EC_KEY = der(0x30, integer(1), der(4, NOISE[:32]), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))
RSA_KEY = der(0x30, integer(0), *[der(2, b"\1" + NOISE[k : k + 64]) for k in range(8)])
PRIVATE = {
    "pkcs8": der(0x30, integer(0), der(0x30, OID, der(5)), der(4, RSA_KEY)), "rsa": RSA_KEY, "dsa": der(0x30, integer(0), *[der(2, b"\1" + NOISE[k : k + 40]) for k in range(5)]), "ec": EC_KEY,
    "encrypted": der(0x30, der(0x30, OID, der(0x30, der(4, NOISE[:8]), integer(100))), der(4, NOISE[:160])),
    "store": der(0x30, integer(3), der(0x30, der(6, secret_scan.STORE_DATA), der(0xA0, der(4, NOISE[:90])))),
}
NOT_PRIVATE = {
    "public": der(0x30, der(0x30, OID, der(5)), der(3, b"\0" + der(0x30, der(2, b"\1" + NOISE[:128]), integer(65537, 3)))), "rsa public": der(0x30, der(2, b"\1" + NOISE[:128]), integer(65537, 3)),
    "certificate": der(0x30, der(0x30, der(0xA0, integer(2)), integer(77), der(0x30, OID), der(4, NOISE[:100])), der(0x30, OID, der(5)), der(3, NOISE[:128])),
    "digest": der(0x30, der(0x30, OID, der(5)), der(4, NOISE[:64])), "signature": der(0x30, der(2, NOISE[1:33]), der(2, NOISE[33:65])), "cut": RSA_KEY[:-1] + b"", "version": der(0x30, integer(9), der(4, NOISE[:60])),
}


def openssh(keys=1, cut=0):
    field = lambda x: len(x).to_bytes(4, "big") + x
    return b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + keys.to_bytes(4, "big") + field(NOISE[:51]) + field(NOISE[:136])[: -cut or None]


def test_keys_in_other_spellings():
    import base64

    for name, key in {**PRIVATE, "openssh": openssh()}.items():
        assert secret_scan.is_key(key), name
        flat, url = base64.b64encode(key).decode(), base64.urlsafe_b64encode(key).decode()
        wrap = lambda k, by, flat=flat: by.join(flat[i : i + k] for i in range(0, len(flat), k))
        pem = lambda by, wrap=wrap: by.join(["-----BEGIN PRIVATE KEY-----", wrap(64, by), "-----END PRIVATE KEY-----"])
        cases = [("keyhex", key.hex()), ("keyhex", key.hex().upper()), ("key64", flat), ("key64", url), ("key64", url.rstrip("=")), *(("key64", wrap(k, by)) for k in (64, 76) for by in ("\n", "\r\n", "\\n", "\n  ")), *(("pem", pem(by)) for by in ("\n", "\\n", "\\r\\n"))]
        for kind, spelt in cases:
            for head in ('see "', "key/" if kind == "key64" else "see ", "ab/cd1" if kind == "key64" else "é "):
                for tail in (" end", "\nword\nmore"):
                    assert (kind, len(head), len(head) + len(spelt)) in secret_scan.scan_text(head + spelt + tail), (name, kind, head)
                    assert secret_scan.clean_text(head + spelt + tail) == head + "[SECRET]" + tail
    for name, key in {**NOT_PRIVATE, "cut openssh": openssh(cut=1), "many": openssh(keys=3)}.items():
        flat = base64.b64encode(key).decode()
        for text in (flat, f"-----BEGIN PUBLIC KEY-----\n{flat}\n-----END PUBLIC KEY-----", f"key/{flat}"):
            assert not [s for s in secret_scan.scan_text(text) if s[0] not in ("hex", "assign")], name


def brute_base(text):
    """The base spans by patterns of their own, over every match and not only long ones."""
    t, out = text or "", []
    for m in re.finditer("(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A):
        out += [("assign", *m.span())] if len(m[2]) >= 8 else []
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_spans_over_the_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    long = ("word " * 50_000) + "AKIA" + "Z" * 16 + " token=" + "x" * 70_000 + " " + "0a" * 40_000
    more = [(-1, None), (-2, ""), (-3, long), (-4, "secret:secret=password='abcdefgh1'"), (-4, "secret:secret=password='abcdefgh1'"), (-5, "AKIA" + "0123456789abcdef" * 4 + "AKIA" * 8)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        base = brute_base(r.text)
        joined = ",".join(f"{k}:{a}:{z}" for k, a, z in base)
        want[r.doc_id, *(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest(), joined] += 1
    got = secret_scan.scan_documents(docs).collect()
    base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, base(r.spans)) for r in got) == want


def test_secrets(spark, docs, empty):
    import base64
    import json

    b64 = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    jwt = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(json.dumps({'sub': 'me'}).encode())}.abc"
    key = PRIVATE["pkcs8"]
    cases = [
        ("PassWord = 'abcdefgh' token:short", [("assign", 0, 20)]),
        ("é AKIAABCDEFGHIJKL0 AKIASHORT", [("access", 2, 19)]),
        ("0123456789abcdef" * 2 + "g", [("hex", 0, 32)]),
        (f"see {jwt} and eyJhbGciOiJub25l.notjson1.x", [("jwt", 4, 4 + len(jwt))]),
        (f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(key).decode()}\n-----END PRIVATE KEY-----", None),
        (f"-----BEGIN PRIVATE KEY-----\n{'QUJD' * 20}\n-----END PRIVATE KEY-----", []),
        (key.hex(), [("hex", 0, 2 * len(key)), ("keyhex", 0, 2 * len(key))]),
    ]
    for text, want in cases:
        got = secret_scan.scan_text(text)
        assert got == want if want is not None else {k for k, _, _ in got} == {"pem", "key64"}
    assert not secret_scan.is_private_der(key[:-1]) and not secret_scan.is_private_der(key + b"\0")
    assert secret_scan.scan_documents(docs).count() == docs.count() and secret_scan.scan_documents(empty).count() == 0
    clean = secret_scan.redact(spark.createDataFrame([(1, "my token=abcdefghij ok", "en", "s", 22, "", 0), (2, None, None, None, None, None, None)], DOCS)).collect()
    assert [r.text for r in clean] == ["my [SECRET] ok", None] and clean[0].n_chars == 14


def naive_bpe(data, ranks):
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_bpe_is_exact(spark, docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = np.random.default_rng(0)
    for _ in range(300):
        piece = bytes(rng.choice(np.frombuffer(b"abtheing  \xc3\xa9\xffqz", np.uint8), rng.integers(1, 30)))
        assert own.encode_piece(piece) == naive_bpe(piece, own.ranks)
    for t in filter(None, PAIN):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    got = Counter(byte_bpe.bpe_digests(docs, path).collect())
    want = Counter((r.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect() for i in [other.encode_ordinary(r.text or "")])
    assert Counter(map(tuple, got.elements())) == want
    assert byte_bpe.bpe_digests(empty, path).count() == 0
    apart = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, path), path)
    assert Counter(map(tuple, apart.collect())) == Counter(map(tuple, byte_bpe.round_trip(docs, path).collect()))


def test_classifier(spark, docs, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_classifier.classify(spark, docs, labels).collect()} == {0.5}
    assert quality_classifier.classify(spark, empty, labels).count() == 0
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(("w" * rng.integers(1, 9)) + ("" if i % 4 else "##") for _ in range(60)), "en", "s", 0, "", 0) for i in range(400)]
    data = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(spark, data, labels).collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert all(r.predicted == (r.doc_id % 4 > 0) for r in got if r.held_out)
    assert quality_classifier.keep_good(spark, data, labels).count() == sum(r.predicted for r in got)
    stats = quality_classifier.text_stats(PAIN[:1] + ["", PAIN[4]])
    assert not stats[:2].any() and np.isfinite(stats).all()


def test_held_out_accuracy(spark):
    """On documents whose labels weren't seen."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    rows = [r for r in quality_classifier.classify(spark, read("documents"), read("labels")).collect() if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [r.score for r in rows if labels[r.doc_id]], [r.score for r in rows if not labels[r.doc_id]]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(bad) >= 5 and auc >= 0.97 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) >= 0.95


def test_isotonic():
    at, value = quality_classifier.isotonic(np.arange(5.0), np.array([1.0, 0, 3, 2, 5]), np.array([5.0] * 5))
    assert (np.diff(value) >= 0).all() and np.isclose(value, [0.1, 0.5, 1.0]).all() and (np.diff(at) > 0).all()
