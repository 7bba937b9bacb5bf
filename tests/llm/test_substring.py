"""Repeated units (lines, runs cut by content), held against brute force."""

import hashlib
import random
import re

import pytest

pytest.importorskip("limen.llm")

from limen.llm import substring  # noqa: E402

LEAST, WINDOW = 6, 5
PASSAGE = 2 * WINDOW + LEAST - 1


def text_of(rng, n):
    return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))


def tables():
    """Passages at other line breaks and in other case, whole copies, periodic text, repeated lines, short and null texts."""
    rng = random.Random(4)
    shared = [text_of(rng, n) for n in (LEAST - 1, LEAST, PASSAGE, 30, 60)]
    texts = [shared[4], None, "", " \n", "la " * 40, "la  LA\nla " * 9, f"\n{shared[1]}\r\nx", f"y\n{shared[1].upper()}"]
    for i in range(40):
        p = rng.choice(shared).split(" ")
        p = "".join(w.upper() + rng.choice([" ", "\n", "\t ", "\n\n"]) if i % 3 else w + " " for w in p)
        texts.append(rng.choice(["", text_of(rng, 9) + " "]) + p + rng.choice(["", text_of(rng, 20), "\x1cé " + p]))
    return [(i, t, i % 4) for i, t in enumerate(texts + texts[6:9])]


def plain_units(text):
    words = re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    out, at = set(), 0
    for line in text.split("\n"):
        n = len(re.findall(r"[^ \t\n\r\x0b\x0c]+", line))
        if n >= LEAST:
            out.add((at, at + n))
        at += n
    h = [int(hashlib.md5(w.encode()).hexdigest()[:6], 16) for w in words]
    runs = [sum(h[k + j] * pow(48271, j, 2**31 - 1) for j in range(4)) % (2**31 - 1) for k in range(len(words) - 3)]
    at = sorted({min(range(k, k + WINDOW), key=lambda x: (runs[x], x)) for k in range(len(runs) - WINDOW + 1)})
    out |= {(a, b + LEAST) for a, b in zip(at, at[1:]) if b + LEAST <= len(words)}
    return words, sorted(out)


def brute(rows):
    seen, out = {}, {}
    for i, text, _ in rows:
        words, found = plain_units(text or "")
        gone = set()
        for s, e in found:
            first = seen.setdefault(tuple(words[s:e]), (i, s))
            if first != (i, s):
                gone |= set(range(max(s, first[1] + e - s) if first[0] == i else s, e))
        out[i] = (words, gone)
    return out


def test_units_are_cut_wherever_they_stand(spark):
    rows = tables()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    found = {r.doc_id: r for r in substring.repeated_units(df, "line", LEAST, WINDOW).collect()}
    assert sorted(found) == sorted(want) and any(r.n_removed for r in found.values())
    for i, text, _ in rows:
        r, (words, gone) = found[i], want[i]
        assert (r.repeats, r.n_removed) == (bool(gone), len(gone))
        if text is None:
            assert r.text is None
            continue
        assert r.text.encode().lower().split() == [w.encode() for k, w in enumerate(words) if k not in gone]
        spans = [tuple(map(int, x.split("-"))) for x in r.removed_spans.split(",") if x]
        assert b" ".join(text[s:e].encode().lower() for s, e in spans).split() == [words[k].encode() for k in sorted(gone)]
        assert gone or r.text == text
    kept = substring.without_repeats(df, "line", LEAST, WINDOW)
    assert kept.columns == df.columns and {(r.doc_id, r.text, r.spans) for r in kept.collect()} == {(i, found[i].text, s) for i, _, s in rows}


def test_every_passage_long_enough_holds_a_whole_unit():
    rng = random.Random(3)
    for _ in range(300):
        p = [w.encode() for w in text_of(rng, PASSAGE).split()]
        around = [w.encode() for w in text_of(rng, 40).split()]
        a, b = rng.randint(0, 40), rng.randint(0, 40)
        inside = set()
        for before, after in ((around[:a], around[a:]), (around[b:], around[:b])):
            words = before + p + after
            at = len(before)
            found = {(s - at, e - at) for s, e in substring.units(words, [len(words)], LEAST, WINDOW).tolist() if s >= at and e <= at + PASSAGE}
            inside = found if not inside else inside & found
        assert inside


def test_paragraphs(spark):
    p = "a paragraph of more than six words stands\nover lines"
    df = spark.createDataFrame([(1, f"{p}\n\nx"), (2, f"y\n \n{p}")], "doc_id long, text string")
    found = {r.doc_id: r for r in substring.repeated_units(df, "paragraph", 8).collect()}
    assert (found[1].n_removed, found[2].n_removed, found[2].text) == (0, 10, "y")


def test_ids_that_are_null_or_repeat(spark):
    p = text_of(random.Random(1), 2 * PASSAGE)
    rows = [(None, p), (5, f"x {p} y"), (5, f"x {p} y"), (7, f"z {p}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.repeats, r.n_removed > PASSAGE) for r in substring.repeated_units(df, "line", LEAST, WINDOW).collect())
    assert found == [(0, True, True), (5, False, False), (5, False, False), (7, True, True)]
    assert substring.repeated_units(df.limit(0)).count() == 0


def test_ids_may_be_strings(spark):
    p = text_of(random.Random(2), 55)
    df = spark.createDataFrame([("b", f"one {p}"), ("a", f"two {p}")], "name string, body string")
    assert {r.name: r.repeats for r in substring.repeated_units(df, id_col="name", text_col="body").collect()} == {"a": False, "b": True}
