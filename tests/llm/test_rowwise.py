"""Operators that work on a row by itself: media, byte BPE, secrets, licences."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import bpe, license_texts, licenses, media, secrets

TEXTS = "doc_id long, text string, id string, media string, spans string"


def texts(spark, *given):
    """A frame with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(given)], TEXTS)


# ---------------------------------------------------------------- media


def _png(image: np.ndarray, kinds: list[int]) -> bytes:
    """An image with a row filter of its own for each row."""
    lines = b"".join(bytes([k]) + media.filter_rows(image, k)[y].tobytes() for y, k in enumerate(kinds))
    head = struct.pack(">IIBBBBB", image.shape[1], len(image), 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", zlib.compress(lines)) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("kinds", [[0] * 9, [1] * 9, [2] * 9, [3] * 9, [4] * 9, [4, 2, 2, 1, 3, 0, 4, 3, 2]])
def test_every_row_filter_is_undone(kinds):
    image = np.random.default_rng(1).integers(0, 256, (9, 64), dtype=np.uint8)
    assert (media.decode_png(_png(image, kinds)) == image).all()


def test_filters_by_the_standards_own_words():
    """Pixel by pixel, over images of many shapes and mixed filters."""
    rng = np.random.default_rng(7)
    for height, width in ((1, 1), (1, 64), (40, 3), (70, 64), (5, 200)):
        kinds, rows = rng.integers(0, 5, height).astype(np.uint8), rng.integers(0, 256, (height, width), dtype=np.uint8)
        out = [[0] * (width + 1) for _ in range(height + 1)]
        for y in range(height):
            for x in range(width):
                a, b, c = out[y + 1][x], out[y][x + 1], out[y][x]
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y + 1][x + 1] = (int(rows[y, x]) + (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
        assert media.unfilter(kinds, rows).tolist() == [r[1:] for r in out[1:]]


@given(st.binary(max_size=4000))
@settings(max_examples=60, deadline=None)
def test_png_round_trip(content):
    padded = media.pad(content)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(content)
    assert media.decode_png(media.encode_png(padded)).tobytes() == padded


def test_png_of_many_chunks_and_wrong_bytes():
    payload = media.pad(np.random.default_rng(2).integers(0, 256, 300_000, dtype=np.uint8).tobytes())
    stored = media.encode_png(payload)
    assert stored.count(b"IDAT") > 1 and media.decode_png(stored).tobytes() == payload
    for at in (3, 20, len(stored) // 2, len(stored) - 20):
        with pytest.raises(ValueError):
            media.decode_png(stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :])
    with pytest.raises(ValueError):
        media.decode_png(stored[:-12])


def test_media_rows(spark):
    given = [None, "", "abc", "abc", "é" * 40_000, "x" * 64]
    rows = {r["id"]: r for r in media.load(media.store(texts(spark, *given))).collect()}
    for i, t in enumerate(given):
        raw = (t or "").encode()
        assert rows[i]["n_bytes"] == len(raw) and rows[i]["payload"] == media.pad(raw)
    assert rows[2]["feature"] == rows[3]["feature"] and rows[2]["media_sha256"] == rows[3]["media_sha256"]
    assert media.store(texts(spark, "a").limit(0)).count() == 0


def test_media_that_cannot_be_read(spark):
    good = media.encode_png(media.pad(b"abc"))
    huge = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(50_000_000))) + media._chunk(b"IEND", b"")
    odd = _png(np.zeros((1, 7), np.uint8), [4])
    bad_filter = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes([9] + [0] * 64))) + media._chunk(b"IEND", b"")
    vast = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 4294967295, 4294967295, 8, 0, 0, 0, 0)) + good[33:]
    packed = zlib.compress(bytes(65))
    cut, more = (media.SIGNATURE + good[8:33] + media._chunk(b"IDAT", x) + media._chunk(b"IEND", b"") for x in (packed[:-4], packed + b"more"))
    files = [good, None, b"", b"no image", good[:-1], good[:30] + b"x" + good[31:], huge, odd, bad_filter, good.replace(media._chunk(b"IHDR", good[16:29]), media._chunk(b"IHDR", good[16:20])), vast, cut, more]
    df = spark.createDataFrame([(i, 3, x, "clash") for i, x in enumerate(files)], "id int, n_bytes long, media binary, error string")
    rows = {r["id"]: r for r in media.load(df).collect()}
    assert rows[0]["payload"] == media.pad(b"abc") and rows[0]["error"] is None
    assert rows[7]["payload"] == bytes(7) and len(rows[7]["feature"]) == 16
    for i in (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12):
        assert rows[i]["payload"] is None and rows[i]["feature"] is None and rows[i]["error"] and rows[i]["n_bytes"] == 3
        assert (rows[i]["media_bytes"], rows[i]["media_sha256"]) == ((None, None) if i == 1 else (len(files[i]), hashlib.sha256(files[i]).hexdigest()))


def plain_hash(image):
    """Means of 32 x 32 blocks, the cosine transform by its sum, the 8 x 8 lowest frequencies against their median."""
    height, width = image.shape
    blocks = [[image[min(y * height // 32, height - 1) : max((y + 1) * height // 32, min(y * height // 32, height - 1) + 1), x * width // 32 : (x + 1) * width // 32].mean() for x in range(32)] for y in range(32)]
    wave = [[np.cos(np.pi * (2 * x + 1) * k / 64) * np.sqrt((1 if k else 0.5) / 16) for x in range(32)] for k in range(8)]
    low = [sum(wave[u][y] * wave[v][x] * blocks[y][x] for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "0" + "".join("1" if round(c, 6) > round(rest[31], 6) else "0" for c in low[1:])
    return f"{int(bits, 2):016x}"


@pytest.mark.parametrize("height", [1, 2, 31, 32, 33, 70])
def test_cosine_hash_by_its_sum(height):
    rng = np.random.default_rng(height)
    for width in (64, 96):
        image = rng.integers(0, 256, (height, width), dtype=np.uint8)
        assert media.cosine_hash(image) == plain_hash(image)


def test_largest_pixels_are_unpacked():
    """A file packed as densely as can be is no damaged one."""
    payload = bytes(64 * 300_000)
    assert media.decode_png(media.encode_png(payload, 9)).tobytes() == payload


def test_op2(spark, sf_dir):
    rows = {r["doc_id"]: r for r in media.op2_media(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        payload, r = media.pad(d["text"].encode()), rows[d["doc_id"]]
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload))


# ---------------------------------------------------------------- byte BPE

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOOL = bpe.ByteBPE(VOCABULARY, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TOOL.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(TOOL.encode(text), "<i4").tolist()


def test_every_token_is_its_own_encoding():
    assert all(TOOL.tree(x) == (i,) for x, i in TOOL.ranks.items())


@given(st.text(max_size=200) | st.text("ab \n'sthe1.é", max_size=400))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert TOOL.decode(ids(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "=-" * 2001, " " * 999, "\n \n" * 50, "é" * 3001, "日本" * 700, "x" * 70 + " y" * 70, "a\x1cb\x85c\xa0 d  e"])
def test_long_matches(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_joins_are_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        raw = bytes(rng.choice(b"thaeinos  ..==\xc3\xa9") for _ in range(rng.randint(2, 120)))
        cut = rng.randint(0, len(raw))
        assert TOOL.join(TOOL.tree(raw[:cut]), TOOL.tree(raw[cut:])) == TOOL.merge(raw)
        assert TOOL._merge_long(raw) == TOOL.tree(raw)


def test_stores_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    tool = bpe.ByteBPE(VOCABULARY, public_tokenizers.PATTERN)
    text = " ".join(f"word{i}x{i * 7}" for i in range(500))
    assert np.frombuffer(tool.encode(text), "<i4").tolist() == LIBRARY.encode_ordinary(text)
    assert max(len(tool.words), len(tool.pieces), len(tool.pairs), len(tool.trees)) <= 50


def test_bpe_rows(spark):
    given = [None, "", "the cat", "the cat", "<|endoftext|> a", "word " * 30_000]
    found = {r["id"]: r for r in bpe.decode(bpe.encode(texts(spark, *given), VOCABULARY, public_tokenizers.PATTERN), VOCABULARY, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(given):
        assert found[i]["ids"] == LIBRARY.encode_ordinary(t or "") and found[i]["content"] == (t or "").encode()
    assert bpe.encode(texts(spark, "a").limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_op3(spark, sf_dir):
    rows = {r["doc_id"]: r for r in bpe.op3_bpe(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own, r = LIBRARY.encode_ordinary(d["text"]), rows[d["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(d["text"].encode()).hexdigest()


# ---------------------------------------------------------------- secrets


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    head = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


def number(n):
    return der(2, b"\1" + os.urandom(n - 1))


RSA = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), number(128), *[number(64)] * 5)
EC = der(0x30, der(2, b"\1"), der(4, os.urandom(32)), der(0xA0, der(6, b"*\x86H\xce=\3\1\7")))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"+ep")), der(4, der(4, os.urandom(32))))
string = lambda x: struct.pack(">I", len(x)) + x
SSH = b"openssh-key-v1\0" + string(b"none") * 2 + string(b"") + struct.pack(">I", 1) + string(string(b"ssh-ed25519") + string(os.urandom(32))) + string(os.urandom(136))
b64 = lambda x: base64.b64encode(x).decode()
url = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
JWT = f"{url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': '1234567890'})}.c2lnbmF0dXJl"


def kinds(text):
    return [k for k, _, _ in secrets.find(text)]


@pytest.mark.parametrize("key", [RSA, EC, PKCS8])
def test_keys_in_any_encoding(key):
    assert secrets.private_der(key) == len(key)
    for text in (b64(key), base64.urlsafe_b64encode(key).decode(), key.hex().upper()):
        (found,) = [x for x in secrets.find(f"see {text} there") if x[0] == "der"]
        assert found[1] == 4 and 4 + len(text) - 3 <= found[2] <= 4 + len(text)
    lines = "\n".join(re.findall(".{1,64}", b64(key)))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    assert ("pem", 3, 3 + len(pem)) in secrets.find(f"so {pem}\n")
    assert ("pem", 0, len(pem) + pem.count("\n")) in secrets.find(pem.replace("\n", "\\n"))
    assert "pem" not in kinds(pem.replace(b64(key)[:8], "AAAAAAAA"))
    assert "der" not in kinds(b64(key)[:-40]) and "der" not in kinds(b64(bytes([0x31]) + key[1:]))


def test_ssh_containers_and_tokens():
    assert secrets.private_ssh(SSH) == len(SSH)
    assert kinds(b64(SSH)) == ["ssh"] and kinds(b64(SSH)[:120]) == []
    assert kinds(f"Bearer {JWT}.") == ["jwt"]
    assert kinds(f"{url({'typ': 'JWT'})}.{url({'a': 1})}.x") == [] and kinds("eyJhbGciOiJIUzI1NiJ9.bm90anNvbg.x") == []
    locked = b64(os.urandom(64))  # bytes without a structure are no encrypted key
    legacy = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{locked}\n-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds(legacy) and "pem" not in kinds(legacy.replace("ENCRYPTED", "PLAIN"))
    armour = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n{}\n-----END ENCRYPTED PRIVATE KEY-----"
    info = der(0x30, der(0x30, der(6, b"*\x86H\x86\xf7\r\1\5\r"), der(0x30, der(4, os.urandom(8)))), der(4, os.urandom(64)))
    assert kinds(armour.format(b64(info))) == ["pem"]
    assert kinds(armour.format(locked)) == [] and kinds(armour.format(b64(b"some plain prose of forty bytes in all.."))) == []


def test_wrapped_keys_hold_what_their_algorithm_says():
    names = {"rsa": b"*\x86H\x86\xf7\r\1\1\1", "ec": b"*\x86H\xce=\2\1", "ed25519": b"+ep", "other": b"*\3\4"}
    wrap = lambda name, inner: der(0x30, der(2, b"\0"), der(0x30, der(6, names[name])), der(4, inner))
    bare = der(0x30, der(2, b"\1"), der(4, os.urandom(32)))
    good = {"rsa": RSA, "ec": bare, "ed25519": der(4, os.urandom(32)), "other": der(0x30, number(40))}
    prose = b"this is nothing but some ordinary prose, and no key at all"
    for name, inner in good.items():
        assert secrets.private_der(wrap(name, inner)) == len(wrap(name, inner))
        for bad in (prose, der(4, prose), inner[:-3], b""):
            assert name == "other" and bad == der(4, prose) or secrets.private_der(wrap(name, bad)) is None
        assert name == "other" or all(secrets.private_der(wrap(name, x)) is None for other, x in good.items() if other != name)
    lopsided = der(0x30, der(2, b"\0"), number(128), der(2, b"\1\0\1"), number(128), number(64), number(9), *[number(64)] * 3)
    assert secrets.private_der(lopsided) is None


def test_tokens_are_whole():
    head, claims = url({"alg": "HS256"}), url({"sub": "1"})
    assert kinds(f"{head}.{claims}.c2ln") == ["jwt"]
    for bad in (f"{head}.{url({})}.c2ln", f"{url({'alg': 'XX1'})}.{claims}.c2ln", f"{head}.{claims}.", f"{url({'alg': 'none'})}.{claims}."):
        assert kinds(bad) == []
    sealed = f"{url({'alg': 'RSA-OAEP', 'enc': 'A256GCM'})}.{'QUJD' * 9}.QUJDRA.{'QUJD' * 5}.QUJD"
    direct = f"{url({'alg': 'dir', 'enc': 'A256GCM'})}..QUJDRA.{'QUJD' * 5}.QUJD"
    assert secrets.find(f"x {sealed} y") == [("jwe", 2, 2 + len(sealed))] and kinds(direct) == ["jwe"]
    assert kinds(sealed.replace(url({"alg": "RSA-OAEP", "enc": "A256GCM"}), url({"alg": "RSA-OAEP"}))) == []


@pytest.mark.parametrize("key", [RSA, EC, PKCS8])
def test_armour_that_is_encoded_again(key):
    """As cluster manifests hold keys: the whole armour in base64."""
    lines = "\n".join(re.findall(".{1,64}", b64(key)))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----\n"
    for text in (b64(pem.encode()), pem.encode().hex().upper(), "\n  ".join(re.findall(".{1,76}", b64(pem.encode())))):
        (found,) = [x for x in secrets.find(f"tls.key: {text} end") if x[0] == "pem"]
        assert found[1] == 9 and abs(found[2] - 9 - len(text)) <= 5
        assert secrets.mask(f"k {text}", secrets.find(f"k {text}")).startswith("k [pem]")
    assert "pem" not in kinds(b64(pem.replace(b64(key)[:8], "AAAAAAAA").encode()))


@pytest.mark.parametrize("text", ["MIIEvAIBADAN" * 90_000, "MIICAgEA" * 130_000, b64(b"\x30\x84\0\1\0\0\2\1\0" * 90_000), "eyJ" * 300_000, "eyJh." * 200_000, "-----BEGIN PRIVATE KEY-----" * 40_000, "ab\n" * 340_000, "30820401020100" * 75_000, "token=" * 170_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    secrets.find(text)
    assert time.process_time() - began < 8  # a megabyte; a few seconds at most, even under load


def test_random_runs_are_no_keys():
    rng = random.Random(5)
    for _ in range(300):
        assert kinds(base64.b64encode(rng.randbytes(rng.randint(30, 400))).decode()) == []
        assert set(kinds(rng.randbytes(60).hex())) <= {"hex"}
    assert kinds("MI" * 20_000) == []


@pytest.mark.parametrize("key", [RSA, EC, PKCS8, SSH])
@pytest.mark.parametrize("width", [16, 64, 76])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n    "])
def test_wrapped_keys(key, width, gap):
    kind = "ssh" if key is SSH else "der"
    for whole in (b64(key), base64.urlsafe_b64encode(key).decode(), key.hex(), key.hex().upper()):
        lines = gap.join(re.findall(f".{{1,{width}}}", whole))
        assert (kind, 6, 6 + len(lines)) in secrets.find(f"key: |{lines}\n\nend")
        masked = secrets.mask(f"a {lines}", secrets.find(f"a {lines}"))
        assert masked in (f"a [{kind}]", "a [hex]")


@pytest.mark.parametrize("key", [RSA, EC, PKCS8, SSH])
def test_keys_behind_other_digits(key):
    kind = "ssh" if key is SSH else "der"
    for before in (1, 2, 3, 7):
        front = os.urandom(before).replace(b"\x30", b"\1")
        assert kind in kinds(b64(front + key)) and kind in kinds((front + key).hex().upper())
        assert (kind, 2 + before, 2 + before + 2 * len(key)) in secrets.find("x " + "A" * before + key.hex().upper() + " y")


PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, (p, fits)) in enumerate(PATTERNS.items()) for m in p.finditer(text) if fits(m)]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(found)]


@given(st.text("AKIZ09af=: '\"\n", max_size=80) | st.lists(st.sampled_from(["token", "API_KEY", "apikey=", "secret", ": ", "=", '"', "AKIA" + "A1" * 9, "0a" * 13, "é", " ", "ſecret=abcdefg", "passwd"]), max_size=14).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    assert [f"{k}:{s}:{e}" for k, s, e in secrets.find(text) if k in secrets.BASE_KINDS] == base_spans(text)


def test_secret_rows(spark):
    given = [None, "", "é token = abcdef0123", f"a {JWT} b", "token=" + "a" * 26]
    rows = {r["id"]: r["spans"] for r in secrets.scan(texts(spark, *given)).collect()}
    assert rows[0] == rows[1] == [] and [x[:] for x in rows[2]] == [("assign", 2, 20)]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(texts(spark, *given)).collect()}
    assert masked == {0: None, 1: "", 2: "é [assign]", 3: "a [jwt] b", 4: "[assign]"}
    assert secrets.redact(texts(spark, "a").limit(0)).count() == 0


def test_op4(spark, sf_dir):
    rows = {r["doc_id"]: r for r in secrets.op4_secrets(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own, r = base_spans(d["text"]), rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(x.startswith(k) for x in own) for k in secrets.BASE_KINDS]


# ---------------------------------------------------------------- licences


def test_license_rows(spark):
    given = [None, "", "Foo.\nLicensed under the Apache License, Version 2.0.", "x " * 50_000 + "\nreleased UNDER the *MIT* license\n", "Released under a license", "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."]
    rows = {r["doc_id"]: [(m["segment"], m["license"], round(m["dice"], 3)) for m in r["matches"]] for r in licenses.match_licenses(texts(spark, *given)).collect()}
    assert rows[0] == rows[1] == rows[4] == []
    assert rows[2] == [(1, "apache-2.0", 1.0)] and rows[3] == [(1, "mit", 1.0)]
    assert rows[5] == [(0, "cc-by-nc-4.0", 1.0), (1, "cc-by-nc-4.0", 1.0)]
    assert licenses.match_licenses(texts(spark, "a").limit(0)).count() == 0


def test_license_words_that_every_match_has(spark):
    """Texts are passed by for want of rare words only where nothing can match; without templates nothing does."""
    one = (("x", "the beta gamma of delta"),)
    texts = ["The BETA, gamma of delta", "betas gammas of deltas", "the beta gamma of", "of the", "", None, "alpha beta_gamma of delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lambda *given, **named: {r.doc_id: [m.license for m in r.matches] for r in licenses.match_licenses(docs, *given, **named).collect()}
    for bodies, hits in (None, [0, 2]), ((), [0, 2, 6]):  # only a window leaves out the alpha
        found = got(one, bodies=bodies)
        assert [i for i, m in found.items() if m] == hits
        assert got((), bodies=bodies) == {i: [] for i in range(len(texts))}


def test_license_dice_by_brute_force(spark):
    rng = random.Random(7)
    words = "licensed under the mit apache license version 2 0 gnu public released this work is".split()
    given = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = licenses.match_licenses(texts(spark, *given), threshold=0.5).select("doc_id", F.expr("transform(matches, m -> struct(m.license, round(m.dice, 9)))").alias("m")).collect()
    for r in rows:
        own = set(licenses._bigrams(given[r["doc_id"]]))
        expected = [(n, round(2 * len(own & set(b)) / (len(own) + len(b)), 9)) for n, b in ((n, licenses._bigrams(t)) for n, t in licenses.TEMPLATES) if own and 2 * len(own & set(b)) / (len(own) + len(b)) >= 0.5]
        assert sorted(x[:] for x in r["m"]) == sorted(expected)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


def test_license_notices_over_lines(spark):
    prose = "It was a long day. The shop is under the bridge and nothing of it is for sale\n"
    flat = lambda x: x.replace("\n", " ")
    given = [MIT, flat(MIT), f"{prose}\n{MIT}\n\n{prose}", f"{ISC}\n{prose}", flat(ISC), prose + BSD, "so it is\nLicensed under the MIT License.", prose, f"{MIT}\n{MIT}", "Released under the MIT License.\n" + BSD, None, "", "MIT", "we have it licensed under the\n  Apache License, Version 2.0, I think"]
    names = [["mit"], ["mit"], ["mit"], ["isc"], ["isc"], ["bsd-3-clause"], ["mit"], [], ["mit"] * 2, ["mit", "bsd-3-clause"], [], [], [], ["apache-2.0"]]
    rows = {r["doc_id"]: [(m["license"], round(m["dice"], 3)) for m in r["matches"]] for r in licenses.match_licenses(texts(spark, *given), bodies=licenses.BODIES).collect()}
    assert [[n for n, _ in rows[i]] for i in range(len(given))] == names
    assert all(d == 1.0 for i in range(len(given)) for _, d in rows[i])


def brute_windows(text, bodies):
    """{licence: highest Dice of any window of the text that begins and ends with a bigram of a clause}, from 0.8 on."""
    words, out = re.findall(r"[^\W_]+", text.lower()), {}
    grams = list(zip(words, words[1:]))  # noqa: B905
    for name, clause in bodies:
        own = re.findall(r"[^\W_]+", clause.lower())
        b = set(zip(own, own[1:]))  # noqa: B905
        hits = [i for i, g in enumerate(grams) if g in b]
        for at, i in enumerate(hits):
            window = set()
            for j in range(i, min(len(grams), i + 2 * len(own))):
                window.add(grams[j])
                if grams[j] in b and hits[at:]:
                    dice = 2 * len(window & b) / (len(window) + len(b))
                    if dice >= 0.8:
                        out[name] = max(out.get(name, 0), round(dice, 9))
    return out


def test_license_windows_by_brute_force(spark):
    rng = random.Random(12)
    prose = "the river was high that day and nobody knew what to do with the software or the notice of it".split()
    given = []
    for _, clause in licenses.BODIES:
        for share in (0.0, 0.06, 0.12):
            words = [w for w in clause.split() if rng.random() >= share]
            for _ in range(int(share * len(words))):
                words[rng.randrange(len(words))] = rng.choice(prose)
            words = [rng.choice(prose) for _ in range(rng.randrange(12))] + words + [rng.choice(prose) for _ in range(rng.randrange(12))]
            mark = rng.choice(["", "# ", " * ", "// ", "> "])
            given.append("".join(mark + " ".join(words[i : i + 9]) + "\n" for i in range(0, len(words), 9)))
    for text in license_texts.TEXTS.values():  # whole, and cut off
        given += [text, text[: len(text) * 2 // 3]]
    given += [" ".join(rng.choice(prose) for _ in range(400)), "\n".join(given[:8])]
    never = (("none", "no such words anywhere"),)
    found = licenses.match_licenses(texts(spark, *given), templates=never, bodies=licenses.BODIES).collect()
    assert len(found) == len(given) > 170
    for r in found:
        best = {}
        for m in r["matches"]:
            best[m["license"]] = max(best.get(m["license"], 0), round(m["dice"], 9))
        assert best == brute_windows(given[r["doc_id"]], licenses.BODIES), given[r["doc_id"]]
    assert sum(not r["matches"] for r in found) > 5


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0"""


def test_whole_notices_and_near_misses(spark):
    commented = lambda text, mark: "\n".join(mark + x for x in text.split("\n"))
    given = [GPL, APACHE, commented(GPL, "# "), commented(APACHE, " * "), f"int x;\n/*\n{commented(MIT, ' * ')}\n */", BSD, *license_texts.TEXTS.values()]
    names = ["gpl-3.0", "apache-2.0", "gpl-3.0", "apache-2.0", "mit", "bsd-3-clause", *license_texts.TEXTS]
    misses = ["Permission was granted to the software of the above notice, and copies of it are free", "The program is free and the library is free; you can modify either", "You may obtain a license at the office, or see the office for more details", "This software is provided in the hope that some copyright holders shall be held liable"]
    rows = {r["doc_id"]: r["matches"] for r in licenses.match_licenses(texts(spark, *given, *misses), bodies=licenses.BODIES).collect()}
    for i, name in enumerate(names):
        best = max(m["dice"] for m in rows[i])  # a line that matches by itself, as of the second notice, ends the search there
        assert best > 0.85 and name in {m["license"] for m in rows[i] if m["dice"] == best}
    assert not any(rows[len(given) + i] for i in range(len(misses)))
