"""Secret scans: pattern matches, and candidates that are reported only if their structure holds.

Base64 and hex candidates are decoded, from every place in them where a key could start, and walked as
key encodings: DER whose nested lengths and elements are those of a private key, the container of OpenSSH keys with its
length-prefixed fields, PEM blocks around either, and signed tokens whose header and payload are JSON objects.
Public keys and certificates are no secrets. A key's own lengths say where it ends."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex")
# The base patterns. Letters of either case are spelt out, as case folding would also take non-ASCII letters.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so shorter ones drop as they would later
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[A-Za-z0-9+/=\s]|\\[nr]){16,}?)-----END \1-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
# Candidates for keys: runs of hex of either case, and of base64 of both alphabets over lines, whose ends may be escaped.
KEYHEX = re.compile(r"[0-9A-Fa-f]{72,}")
_BREAK = r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_C64 = "[A-Za-z0-9+/_-]"
KEY64 = re.compile(rf"(?<!{_C64}){_C64}{{48,}}(?:{_BREAK}{_C64}+)*")
_BLANK = re.compile(r"\\[nr]|\s")
_LINE_END = re.compile(_BREAK)
# How a key begins. A DER key is a SEQUENCE, so its first byte is 0x30.
OPENSSH = b"openssh-key-v1\0"
_START64 = re.compile("(?=M|b3BlbnNzaC1rZXktdjEA)")
_STARTHEX = re.compile("(?=30(?:8[1-4]|[2-7][0-9a-f])|" + OPENSSH.hex() + ")")
#: Least bytes of a key.
LEAST_KEY = 36
_STANDARD = str.maketrans("-_", "+/")
# DER tags, and the object identifier of plain data in a key store.
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30
STORE_DATA = bytes.fromhex("2a864886f70d010701")


def _elements(data: bytes, at: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the elements from at to end; none if lengths don't nest exactly to any depth."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or end - at < width:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if size > end - at or (tag & 0x20 and (depth > 16 or _elements(data, at, at + size, depth + 1) is None)):
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """One SEQUENCE that fills the data and is a private key by its elements: PKCS #1 (nine integers), DSA (six), SEC 1
    (version 1, key), PKCS #8 (version, algorithm, key), encrypted PKCS #8 (algorithm with parameters, key), or a
    PKCS #12 store. Public keys, certificates and digests have other elements."""
    top = _elements(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = _elements(data, *top[0][1:]) or []
    tags = [t for t, _, _ in inner]
    part = [data[a:z] for _, a, z in inner]
    below = [_elements(data, a, z) or [] if t == SEQUENCE else [] for t, a, z in inner]
    version = part[0][0] if tags[:1] == [INTEGER] and len(part[0]) == 1 else None
    rest = lambda k: all(t & 0xC0 == 0x80 for t in tags[k:])
    if version in (0, 1) and tags[:9] == [INTEGER] * 9 and tags[9:] in ([], [SEQUENCE]):
        return True
    if version == 0 and tags == [INTEGER] * 6:
        return True
    if version == 1 and tags[:2] == [INTEGER, OCTETS] and rest(2):
        return True
    if version in (0, 1) and tags[:3] == [INTEGER, SEQUENCE, OCTETS] and below[1] and below[1][0][0] == OID and rest(3):
        return True
    if tags == [SEQUENCE, OCTETS] and [t for t, _, _ in below[0]] == [OID, SEQUENCE]:
        return True
    store = version == 3 and tags[1:2] == [SEQUENCE] and below[1] and below[1][0][0] == OID
    return bool(store and data[below[1][0][1] : below[1][0][2]] == STORE_DATA and len(tags) <= 3)


def openssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH key that the data start with: the magic string, cipher, kdf and options, the number of
    keys, so many public keys and the private part, all but the number with their lengths. None if they don't nest."""
    if not data.startswith(OPENSSH):
        return None
    at = len(OPENSSH)

    def skip(at: int) -> int | None:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big") if len(data) >= at + 4 else len(data) + 1
        return end if end <= len(data) else None

    for _ in range(3):
        if (at := skip(at)) is None:
            return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return None
    for _ in range(keys + 1):
        if (at := skip(at)) is None:
            return None
    return at


def _decode64(text: str) -> bytes:
    """Base64 of either alphabet; what is no whole byte at the end is left out. Empty if it isn't base64."""
    text = text.translate(_STANDARD)
    try:
        return base64.b64decode(text[: len(text) - (len(text) % 4 == 1)] + "=" * (-len(text) % 4 % 3), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_key(data: bytes) -> bool:
    return is_private_der(data) or openssh_size(data) == len(data)


def key_size(head: bytes, rest) -> int | None:
    """Bytes of a key that starts with ``head``, by its own lengths; ``rest()`` gives all data that could be its."""
    if head.startswith(b"openss"):
        return openssh_size(rest())
    if len(head) < 6 or head[0] != SEQUENCE:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4:
        return None
    inner = head[2 + width : 3 + width]
    if inner and inner[0] not in (INTEGER, SEQUENCE):
        return None
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def keys_in(run: str, start: re.Pattern, per_byte: float, decode) -> list[tuple[int, int]]:
    """``(start, end)`` of keys in a run of digits, wherever in it they start. ``per_byte``: digits of a byte."""
    breaks = [m.span() for m in _LINE_END.finditer(run)]
    flat = _LINE_END.sub("", run) if breaks else run
    places = [k for a, z in zip([0, *(z for _, z in breaks)], [*(a for a, _ in breaks), len(run)]) for k in range(a, z)] if breaks else range(len(run))
    out, done = [], 0
    for m in start.finditer(flat.lower() if per_byte == 2 else flat):
        k = m.start()
        if k < done:
            continue
        size = key_size(decode(flat[k : k + 16]), lambda k=k: decode(flat[k:]))
        if size is None or size < LEAST_KEY:
            continue
        digits = math.ceil(size * per_byte)
        if k + digits <= len(flat) and is_key(decode(flat[k : k + digits])[:size]):
            done = k + digits
            out.append((places[k], places[done - 1] + 1))
    return out


def _from_hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _json_object(part: str) -> dict | None:
    try:
        got = json.loads(_decode64(part))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".", 2)
    return "alg" in (_json_object(head) or {}) and _json_object(body) is not None


def scan_text(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, ordered by start, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    for m in HEX.finditer(text):
        out.append(("hex", *m.span()))
    for m in KEYHEX.finditer(text):
        out += [("keyhex", m.start() + a, m.start() + z) for a, z in keys_in(m[0], _STARTHEX, 2, _from_hex)]
    if "-----BEGIN " in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if is_key(_decode64(_BLANK.sub("", m[2]).rstrip("=")))]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    for m in KEY64.finditer(text):
        for a, z in keys_in(m[0], _START64, 4 / 3, _decode64):
            z += m.start()
            out.append(("key64", m.start() + a, z + len(text[z : z + 2]) - len(text[z : z + 2].lstrip("="))))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``: one row per input row.

    Null texts count as empty: no spans, and the digest of the empty string. Rows with equal or
    null doc_ids are scanned each for itself. No shuffle; a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(t or "") for t in b.column(1).to_pylist()]
            base = [[s for s in f if s[0] in KINDS[:3]] for f in found]
            counts = [pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in KINDS[:3]]
            digest = pa.array([hashlib.sha256(_joined(f).encode()).hexdigest() for f in base], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, pa.array(list(map(_joined, found)), pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def clean_text(text: str) -> str:
    """The text with each run of overlapping spans replaced."""
    out, at = [], 0
    for _, a, b in scan_text(text):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The documents' own columns; each maximal run of overlapping spans in ``text`` becomes ``[SECRET]``
    and ``n_chars``, where there is one, is counted anew. Null texts stay null."""
    return map_texts(docs, clean_text)
