"""Secret scans: patterns, and candidates confirmed by their structure.

Three kinds come from patterns alone (``assign``, ``access``, ``hex``). The
others are reported only if what they encode parses: base64 or hex runs are
decoded, key encodings are walked (DER with its nested lengths, a wrapped key
by what its algorithm asks for, the OpenSSH container, armour within what is
decoded), and tokens must have a header that names a known algorithm, claims and
a signature, or the five parts of an encrypted one.

``scan`` gives the spans, ``redact`` the text without them; both are row-local.

Defined results: null and empty texts have no spans; a null id stays null;
repeated rows are scanned each; whole texts are scanned, of any length; spans
of different kinds may overlap, and a mask then covers their union. Positions
are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.plans.arrow import map_rows

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt", "jwe")
_ORDER = {k: i for i, k in enumerate(KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Runs, which go on over single line breaks with indentation.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++|(?<=[A-Za-z0-9+/_-]{40}))")
_ANYHEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]++(?:(?:[ \t]*+\r?\n[ \t]*+[0-9A-Fa-f]++)++|(?<=[0-9A-Fa-f]{48}))")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----).)*)-----END \1-----", re.S)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_JWE = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
_DEK = re.compile(r"(?m)^\s*DEK-Info:\s*[A-Z0-9-]+,(?:[0-9A-Fa-f]{2})+\s*$")
_PROC = re.compile(r"(?m)^\s*Proc-Type:\s*4\s*,\s*ENCRYPTED\s*$")
#: Names of signature algorithms. Fixed values.
SIGNATURES = frozenset(("HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "PS256", "PS384", "PS512", "ES256", "ES256K", "ES384", "ES512", "EdDSA", "Ed25519", "Ed448"))
#: Object identifiers of key algorithms, as DER has them. Fixed values.
_RSA = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
_EC = bytes.fromhex("2a8648ce3d0201")
_NUMBERS = (bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a864886f70d010301"))
_RAW = {bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57, bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56}
#: Elements of a key's sequence at most: those of RSA with further primes are ten.
_ITEMS = 16
_SSH = b"openssh-key-v1\0"
#: How a DER sequence that begins with a number of one byte, or the OpenSSH container, begins.
_STARTS = re.compile(rb"\x30(?=(?:[\x03-\x7F]|\x81.|\x82..|\x83...|\x84....)\x02\x01)|openssh-key-v1\0", re.S)
_STANDARD = str.maketrans("-_", "+/")


def decode_base64(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padding and white space ignored; None if it isn't any."""
    kept = re.sub(r"[\s=]+", "", text).replace("-", "+").replace("_", "/")
    if len(kept) % 4 == 1:
        return None
    try:
        return base64.b64decode(kept + "=" * (-len(kept) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_head(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the element at ``at``; the end may lie beyond ``data``."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return tag, at, at + n


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``data[start:end]`` exactly; None if they don't, or are more than a key has."""
    found = []
    while start < end:
        head = der_head(data, start)
        if head is None or head[2] > end or len(found) == _ITEMS:
            return None
        found.append(head)
        start = head[2]
    return found


def _bits(data: bytes, item: tuple[int, int, int]) -> int:
    return int.from_bytes(data[item[1] : item[2]], "big").bit_length()


def _rsa(data: bytes, items: list[tuple[int, int, int]]) -> bool:
    """Whether the numbers have the sizes of an RSA key: two primes as long as the modulus, the rest no longer than what they belong to."""
    if len(items) not in (9, 10) or any(t != 2 for t, _, _ in items[:9]) or len(items) == 10 and items[9][0] != 0x30:
        return False
    _, n, e, d, p, q, dp, dq, inverse = (_bits(data, x) for x in items[:9])
    return n >= 256 and 2 <= e < n and 0 < d <= n and abs(n - p - q) <= 16 and min(p, q) >= n // 4 and 0 < dp <= p and 0 < dq <= q and 0 < inverse <= p + 8


def _wrapped(data: bytes, algorithm: tuple[int, int, int], key: tuple[int, int, int]) -> bool:
    """Whether the octet string ``key`` holds what its algorithm asks for."""
    named = der_items(data, algorithm[1], algorithm[2])
    if not named or named[0][0] != 0x06:
        return False
    name, inner = data[named[0][1] : named[0][2]], der_items(data, key[1], key[2])
    if not inner or len(inner) != 1:
        return False
    tag, start, end = inner[0]
    if name in _RAW:
        return tag == 0x04 and end - start == _RAW[name]
    if name in _NUMBERS:
        return tag == 0x02 and end - start >= 16
    parts = der_items(data, start, end) if tag == 0x30 else None
    if name in _RSA:
        return bool(parts) and _rsa(data, parts)
    if name == _EC:
        return bool(parts) and [t for t, _, _ in parts[:2]] == [2, 4] and 16 <= parts[1][2] - parts[1][1] <= 72 and {t for t, _, _ in parts[2:]} <= {0xA0, 0xA1}
    return end - start >= 16  # another algorithm: one element that fills the string


def private_der(data: bytes, start: int = 0) -> int | None:
    """The length of the private key at ``start`` of ``data``; None if it isn't one."""
    head = der_head(data, start)
    if head is None or head[0] != 0x30 or head[2] > len(data):
        return None
    items = der_items(data, head[1], head[2])
    if not items or items[0][0] != 2 or items[0][2] - items[0][1] != 1:
        return None
    version, tags = data[items[0][1]], [t for t, _, _ in items]
    found = False
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
        found = _wrapped(data, items[1], items[2])
    elif version in (0, 1) and len(tags) >= 9:
        found = _rsa(data, items)
    elif version == 0 and tags == [2] * 6:  # p, q, g and two keys
        found = items[1][2] - items[1][1] >= 64 and 16 <= items[2][2] - items[2][1] <= 64
    elif version == 1 and tags[1:2] == [0x04] and set(tags[2:]) <= {0xA0, 0xA1}:  # a curve's key
        found = 16 <= items[1][2] - items[1][1] <= 72 and len(tags) > 2
    return head[2] - start if found else None


def locked_der(data: bytes) -> bool:
    """Whether ``data`` is an encrypted private key: its algorithm, then the encrypted bytes."""
    head = der_head(data)
    items = der_items(data, head[1], head[2]) if head and head[0] == 0x30 and head[2] == len(data) else None
    if not items or [t for t, _, _ in items] != [0x30, 0x04] or items[1][2] - items[1][1] < 16:
        return False
    named = der_items(data, items[0][1], items[0][2])
    return bool(named) and named[0][0] == 0x06


def private_ssh(data: bytes, start: int = 0) -> int | None:
    """The length of the OpenSSH private key container at ``start`` of ``data``."""
    if not data.startswith(_SSH, start):
        return None
    at = start + len(_SSH)

    def field() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    names = [field() for _ in range(3)]
    if any(x is None for x in names) or not names[0] or not names[1]:
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 64:
        return None
    for _ in range(count):
        key = field()
        n = int.from_bytes((key or b"")[:4], "big")
        if not key or not 3 <= n <= len(key) - 4:
            return None
    body = field()
    return at - start if body and len(body) % 8 == 0 else None


def _object(part: str) -> dict | None:
    """The JSON object that ``part`` encodes."""
    raw = decode_base64(part)
    try:
        value = json.loads(raw) if raw is not None else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _jwt(head: str, body: str, signature: str) -> bool:
    """A signed token: a known algorithm, claims, a signature."""
    top = _object(head)
    return top is not None and top.get("alg") in SIGNATURES and bool(_object(body)) and bool(signature) and decode_base64(signature) is not None


def _jwe(head: str, *parts: str) -> bool:
    """An encrypted token: names of two algorithms, and parts that decode."""
    top = _object(head)
    return top is not None and isinstance(top.get("alg"), str) and isinstance(top.get("enc"), str) and all(decode_base64(x) is not None for x in parts)


def _armoured(text: str) -> list[tuple[int, int]]:
    """Where armoured keys lie in ``text``."""
    found = []
    for m in _PEM.finditer(text):
        body = m[2].replace("\\r", "").replace("\\n", "\n")  # also as written in JSON
        raw = decode_base64(re.sub(r"(?m)^\s*[A-Za-z-]+:.*$", "", body))
        if raw and (private_der(raw) or private_ssh(raw) or locked_der(raw) or _PROC.search(body) and _DEK.search(body) and len(raw) >= 16 and len(raw) % 8 == 0):
            found.append(m.span())
    return found


def _encoded(text: str, lo: int, hi: int, bits: int) -> list[tuple[str, int, int]]:
    """Keys in the run ``text[lo:hi]`` of base64 (6 bits a character) or hex (4), at any byte of any phase."""
    pieces = [(m.start(), m.end()) for m in re.finditer(r"[^ \t\r\n]+", text[lo:hi])]
    run = "".join([text[lo + i : lo + j] for i, j in pieces])
    if len(run) < (40 if bits == 6 else 48):
        return []
    ends = list(accumulate(j - i for i, j in pieces))

    def place(i: int) -> int:
        k = bisect_right(ends, i)
        return lo + pieces[k][1] - (ends[k] - i)

    unit = 4 if bits == 6 else 2
    run, found = run.translate(_STANDARD) if bits == 6 else run, []
    for phase in range(unit):
        part = run[phase : len(run) - (len(run) - phase) % unit] if bits == 4 or (len(run) - phase) % 4 == 1 else run[phase:]
        raw, done = bytes.fromhex(part) if bits == 4 else binascii.a2b_base64(part + "=" * (-len(part) % 4)), 0
        whole = [("pem", a, b - a) for a, b in _armoured(raw.decode("latin-1"))] if b"-----BEGIN " in raw else []
        for kind, at, n in whole:
            found.append((kind, place(phase + at * 8 // bits), place(phase + -(-(at + n) * 8 // bits) - 1) + 1))
        for m in _STARTS.finditer(raw):
            at = m.start()
            if at < done:
                continue
            kind, parse = ("der", private_der) if m[0] == b"\x30" else ("ssh", private_ssh)
            n = parse(raw, at)
            if n is None:
                continue
            done = at + n
            end = place(phase + -(-done * 8 // bits) - 1) + 1
            pad = -done % 3 if bits == 6 else 0
            while pad and end < len(text) and text[end] == "=":
                end, pad = end + 1, pad - 1
            found.append((kind, place(phase + at * 8 // bits), end))
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then by the order of the kinds."""
    found = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [("pem", *x) for x in _armoured(text)]
    for m in _BASE64.finditer(text):
        if m.end() - m.start() >= 40:
            found += _encoded(text, *m.span(), 6)
    for m in _ANYHEX.finditer(text):
        if m.end() - m.start() >= 48:
            found += _encoded(text, *m.span(), 4)
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _JWT.finditer(text) if _jwt(*m.groups())]
        found += [("jwe", *m.span()) for m in _JWE.finditer(text) if _jwe(*m.groups())]
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]], x[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with the union of the spans replaced by one mark each."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` as rows (id, spans)."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("spans", SPANS)])

    def make():
        def work(ids, texts):
            return {"id": ids, "spans": [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find(t or "")] for t in texts]}

        return work

    return map_rows(df.select(id_col, text_col), make, schema)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with its texts masked and, if it has one, their length put right; other columns pass as they are."""
    schema = df.schema
    names = schema.names

    def make():
        def work(*columns):
            out = dict(zip(names, columns, strict=True))
            old = out[text_col]
            found = [find(x) if x else [] for x in old]
            out[text_col] = new = [mask(x, s) if s else x for x, s in zip(old, found, strict=True)]
            if length_col in out:
                out[length_col] = [len(x) if s else n for x, s, n in zip(new, found, out[length_col], strict=True)]
            return out

        return work

    return map_rows(df, make, schema)


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """The spans of every text of documents, counted and digested."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"),
        *(count(k) for k in BASE_KINDS),
        F.sha2(text(F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
