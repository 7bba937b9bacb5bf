"""Payloads, urls and chunks that end like the version line that parts records."""

import base64
import hashlib
import random

import pytest

pytest.importorskip("limen.llm")

from limen.llm import warc  # noqa: E402

END = "WARC/1.1"


def test_awkward_ends(spark):
    rng = random.Random(1)
    pages = [
        (1, "http://a", "x" + END),
        (2, "http://a/" + END, "y"),
        (3, END, END),
        (4, "u", "z" * (warc.CHUNK - len(END)) + END + "rest"),
        (5, "u", "z" * (warc.CHUNK - len(END)) + END),
        (6, "u", END * 3 + "\r\n" + END),
        (7, "u", (END + "\r\n") * 5),
        (8, "u\r\n" + END, END + "\r"),
        (9, "u", "x" + END),
        (10, None, None),
        (11, "u", "".join(rng.choice([END, "\r\n", "\r", "W", "1", "x" * 40]) for _ in range(20_000))),
    ]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert (got[9].record_type, got[9].refers_to) == ("revisit", 1)


@pytest.mark.parametrize("most", [9, 10, 11, 16, 64])
def test_chunks_never_end_in_a_version(most):
    rng = random.Random(most)
    for _ in range(300):
        raw = "".join(rng.choice([END, "\r\n", END[:5], "x", "1"]) for _ in range(rng.randint(0, 12))).encode()
        parts = [bytes(p) for p in warc.chunks(memoryview(raw), most)]
        assert b"".join(parts) == raw and all(len(p) <= most for p in parts)
        assert all(p or not raw for p in parts)
        assert not any(warc.VERSION in p + b"\r\n\r\n" for p in parts)


def test_a_long_payload_is_written_in_parts(spark, tmp_path):
    df = spark.createDataFrame([("response", "urn:x", None, None, "D", b"ab" * (20 << 20))], "record_type string, record_id string, url string, refers_to string, digest string, payload binary")
    warc.write_archive(df, f"file://{tmp_path}/w")
    rows = warc.read_archive(spark, f"file://{tmp_path}/w", data=False).collect()
    assert len(rows) == (40 << 20) // warc.CHUNK and rows[-1].last and rows[-1].payload_bytes == 40 << 20
    assert rows[-1].payload_digest == warc.base32(hashlib.sha1(b"ab" * (20 << 20)).digest())
