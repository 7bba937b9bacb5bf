"""Base spans against the patterns as worded; unwrapped ones against secrets planted under known layers."""

import base64
import bz2
import gzip
import hashlib
import lzma
import os
import random
import re
import urllib.parse
import zlib

import pytest

pytest.importorskip("limen.llm")

from limen.llm import secret_scan as S  # noqa: E402
from limen.llm.queries import op13_secret_scan  # noqa: E402

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY = "password = hunter2hunter22"


def worded(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def spans(text):
    data = text.encode()
    base, every, complete = S.found(data)
    place = S.in_characters(data, list(every))
    assert complete
    return {(k, place[s], place[e]): way for (k, s, e), way in every.items()}, [(k, place[s], place[e]) for k, s, e in base]


def test_base_is_as_worded():
    rng = random.Random(1)
    bits = ["password", "PassWd", "secret:", "token", "api_key", "APIKEY", "=", ": ", '"', "'", " ", "abcdefghijkl", "short", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "é", "ſecret", "\n", "deadbeef", "K", "=x.y-z"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        every, base = spans(text)
        assert sorted(base) == sorted(worded(text)), text
        assert set(base) <= set(every)


def test_failing_match_takes_its_characters():
    assert spans("password=secret: abcdefghijklmnop")[1] == worded("password=secret: abcdefghijklmnop") == []


B64 = lambda b: base64.b64encode(b).decode()


@pytest.mark.parametrize(
    "hidden, way",
    [
        (urllib.parse.quote(KEY, safe=""), ("url",)),
        ("".join(f"%{x:02X}" for x in KEY.encode()), ("url",)),
        (urllib.parse.quote("".join(f"%{x:02X}" for x in KEY.encode())), ("url", "url")),
        ("".join(f"\\u{ord(c):04x}" for c in KEY), ("unicode",)),
        ("".join(f"&#x{ord(c):x};" for c in KEY), ("unicode",)),
        ("".join(f"\\x{ord(c):02x}" for c in KEY), ("unicode",)),
        ("".join(chr(0xFEE0 + ord(c)) if c != " " else c for c in KEY), ("unicode",)),
        (B64(KEY.encode()), ("base64",)),
        (B64(KEY.encode()).replace("+", "-").replace("/", "_"), ("base64",)),
        (B64(KEY.encode("utf-16-le")), ("base64", "utf16")),
        (B64(B64(KEY.encode()).encode()), ("base64", "base64")),
        (B64(gzip.compress(KEY.encode())), ("base64", "gzip")),
        (B64(zlib.compress(KEY.encode())), ("base64", "zlib")),
        (B64(bz2.compress(KEY.encode())), ("base64", "bzip2")),
        (B64(lzma.compress(KEY.encode())), ("base64", "xz")),
        (B64(gzip.compress(B64(zlib.compress(KEY.encode())).encode())), ("base64", "gzip", "base64", "zlib")),
        ("".join(f"%{x:02X}" for x in zlib.compress(KEY.encode())), ("url", "zlib")),
        (urllib.parse.quote(B64(b"x" + KEY.encode()) + "==", safe=""), ("base64",)),
    ],
)
def test_layers_map_to_the_text(hidden, way):
    before, after = "é… plain ", " end of it"
    every, base = spans(before + hidden + after)
    assert base == []
    mine = [(k, s, e) for (k, s, e), w in every.items() if w == way and k == "assign"]
    assert mine, every
    for _, s, e in mine:
        assert len(before) <= s < e <= len(before + hidden)
    if way in (("url",), ("unicode",)):
        assert mine == [("assign", len(before), len(before + hidden))]


def test_alignment_and_wrapped_lines():
    plain = "some words before " * 9 + KEY + " and some after" * 9
    lines = base64.encodebytes(plain.encode()).decode()
    for text in ("path/a" + B64(KEY.encode()), lines, lines.replace("\n", "\r\n")):
        [((kind, s, e), way)] = spans(text)[0].items()
        assert (kind, way) == ("assign", ("base64",))
        inside = re.sub(r"\s", "", text[s:e])
        assert any(b"hunter2hunter2" in base64.b64decode("A" * k + inside + "=" * (-(k + len(inside)) % 4)) for k in range(4))


def test_plain_and_escaped_parts_meet():
    assert spans("pass%77ord=abc%64efghijklmn")[0] == {("assign", 0, 27): ("url",)}


def test_cycles_and_breaks_end():
    assert spans(B64(gzip.compress(KEY.encode())[:-9]))[0]  # broken off: what came before counts
    spans("%25" * 1000 + "A" * 5000)
    spans("%" + "25" * 400 + "41")


def test_streams_of_many_pieces():
    inner = gzip.compress(os.urandom(6 << 20) + KEY.encode())
    text = B64(gzip.compress(inner)) + " tail"
    every = spans(text)[0]
    assert ("assign", 0, len(text) - 5 - text[:-5].count("=")) in every or any(w == ("base64", "gzip", "gzip") for w in every.values())


def test_bomb_is_flagged():
    base, every, complete = S.found(B64(zlib.compress(b"q" * 30_000_000)).encode() + b" " + KEY.encode(), most=1 << 22)
    assert not complete and base == [("assign", *S.ASSIGN.search(B64(zlib.compress(b"q" * 30_000_000)).encode() + b" " + KEY.encode()).span())]


def test_rows(spark):
    texts = [None, "", KEY, f"ü {KEY} AKIAABCDEFGHIJKLMN 0123456789abcdef", "x" * 3_000_000 + " " + KEY, B64(KEY.encode()), KEY]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, KEY, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string")
    got = S.secrets(df).collect()
    assert len(got) == len(rows)
    for (i, t, *_), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id,)))):
        assert r.doc_id == i
        base = worded(t or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))
        listed = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        if i == 5:
            assert r.spans and not base
    assert S.scan(df.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op13_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        base = ",".join(":".join(map(str, s)) for s in worded(d.text or ""))
        assert got[d.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
