"""Repeated passages: units of every text are hashed, grouped over all documents, and kept once.

Two kinds of units, both runs of words (parts between ASCII white space, A-Z in lower case):

* lines (or paragraphs) of at least ``least`` words;
* runs cut by content, for passages that stand within lines or over them: each ``WINDOW`` consecutive places of a text
  pick the one whose ``RUN`` words have the least hash (the leftmost of equals), and a unit goes from each pick to
  ``least`` words behind the next. A passage of 2 * WINDOW + least - 1 words (49 as set) holds a whole unit wherever it
  stands, the same one in each text.

Units are normalised to words with one space between and hashed to 128 bits. Of equal units the one that ranks first,
by document id and then place, stays; the words of the others are cut, overlapping ones once. Where a unit overlaps its
own first place (periodic text), only the words beyond that go. Of a longer passage a unit's ends may stay: at most
WINDOW - 1 words before the first pick, as many behind the last unit. What is cut goes with the white space before it,
at the start of a text with that behind it. Spans are characters of the original, from the first word to the last.

Equal units never meet in one task: their first place is an aggregate that is written, and the units that have one
elsewhere are found by a join of which Spark splits skewed parts.

Defined results: null and shorter texts lose nothing, a null text stays null; a null id ranks last; rows that repeat
an id and its text lose the same, so a first place they share stays in each; words that meet over a cut are not looked
at again; a text may become empty; an empty table gives an empty result. Other columns are carried only by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_caches, release, remove, saved, ship, work_dir

LEAST = 20
WINDOW = 15
RUN = 4
#: Hashes of RUN words: 24 bits of each word's MD5, times powers of FACTOR, modulo PRIME; SQL can compute them as well.
FACTOR, PRIME = 48271, 2**31 - 1
KEPT_WORDS = 150_000
_BLANK = re.compile(rb"\n(?:[\x20\x09-\x0D]*\n)+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_hashes: dict[bytes, int] = {}


def picks(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """The places (word numbers) that windows pick, in order."""
    known = own_caches("substring", _hashes)
    if len(known) > KEPT_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:3], "big")
    places = len(words) - RUN + 1
    if places < window:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    run = sum(h[j : j + places] * pow(FACTOR, j, PRIME) for j in range(RUN)) % PRIME
    at = np.arange(places - window + 1) + np.lib.stride_tricks.sliding_window_view(run, window).argmin(axis=1)
    return at[np.r_[True, at[1:] != at[:-1]]]


def units(words: list[bytes], parts: list[int], least: int = LEAST, window: int = WINDOW) -> np.ndarray:
    """(first, end) word numbers of all units, each once; parts: the number of words of each line or paragraph."""
    ends = np.cumsum(parts)
    wide = np.asarray(parts) >= least
    at = picks(words, window)
    first = np.concatenate([(ends - parts)[wide], at[:-1]])
    end = np.concatenate([ends[wide], at[1:] + least])
    return np.unique(np.stack([first, end], axis=1)[end <= len(words)], axis=0)


def split(text: str, unit: str = "line") -> tuple[list[bytes], list[int]]:
    """The words of a text and the number of them in each line or paragraph."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    parts = [p.split() for p in (raw.split(b"\n") if unit == "line" else _BLANK.split(raw))]
    return [w for p in parts for w in p], [len(p) for p in parts]


def unit_rows(docs: DataFrame, unit: str, least: int, window: int) -> DataFrame:
    """(id, key, at, n, digest) of units: place and number of words; key tells texts of one id apart."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import xxhash

        from limen.llm.substring import split, units

        for b in batches:
            counts, places, digests = [], [np.zeros((0, 2), np.int64)], []
            for t in b.column(2):
                words, parts = split(t.as_py() or "", unit)
                found = units(words, parts, least, window)
                counts.append(len(found))
                places.append(found)
                digests += [xxhash.xxh3_128_digest(b" ".join(words[s:e])) for s, e in found.tolist()]
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            places = np.concatenate(places)
            new = [pa.array(places[:, 0], pa.int32()), pa.array(places[:, 1] - places[:, 0], pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *new], ["id", "key", "at", "n", "digest"])

    return docs.select("id", "key", "text").mapInArrow(run, f"id {id_type}, key long, at int, n int, digest binary")


def repeats(docs: DataFrame, unit: str, least: int, window: int) -> DataFrame:
    """(id, key, spans): of each text that loses words, the (first, end) of word numbers, which may overlap."""
    spark = docs.sparkSession
    path = work_dir(spark, "units")
    rows = saved(unit_rows(docs, unit, least, window), "units", path)
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("key"), F.col("at"))
    firsts = saved(rows.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("digest", "first"), "first-units")
    release(spark)
    found = rows.join(firsts, "digest")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    begin = F.when(own, F.greatest(F.col("at"), F.col("first.at") + F.col("n"))).otherwise(F.col("at"))
    lost = found.where(~(own & (F.col("at") == F.col("first.at"))))
    spans = lost.groupBy("id", "key").agg(F.collect_set(F.struct(begin.alias("first"), (F.col("at") + F.col("n")).alias("end"))).alias("spans"))
    spans = saved(spans, "lost-units")
    remove(spark, path)
    release(spark)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """What is left of text without spans of word numbers (merged); the characters of what went."""
    if not spans:
        return text, []
    at = [m.span() for m in _WORD.finditer(text)]
    kept, shown, here = [], [], 0
    for first, end in spans:
        if first:
            kept.append(text[here : at[first - 1][1]])
            here = at[end - 1][1]
        else:
            here = at[end][0] if end < len(at) else len(text)
        shown.append((at[first][0], at[end - 1][1]))
    return "".join([*kept, text[here:]]), shown


def _cut(docs: DataFrame, unit: str, least: int, window: int, carried: list[str]) -> DataFrame:
    ship(docs.sparkSession)
    lost = repeats(docs, unit, least, window).withColumnRenamed("id", "_id").withColumnRenamed("key", "_key")
    joined = docs.join(lost, docs["id"].eqNullSafe(lost["_id"]) & (docs["key"] == lost["_key"]), "left").select("id", "text", F.col("spans.first").alias("firsts"), F.col("spans.end").alias("ends"), *carried)
    types = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in ("id", "text", *carried)) + ", n_removed long, removed_spans string"

    def run(batches):
        import pyarrow as pa

        from limen.llm.substring import cut, merged

        for b in batches:
            texts, gone, shown = [], [], []
            for text, first, end in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                spans = merged(list(zip(first or (), end or ())))
                left, chars = cut(text, spans)
                texts.append(left), gone.append(sum(e - s for s, e in spans))
                shown.append(",".join(f"{s}-{e}" for s, e in chars))
            new = [pa.array(texts, pa.string()), pa.array(gone, pa.int64()), pa.array(shown, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), new[0], *b.columns[4:], *new[1:]], ["id", "text", *carried, "n_removed", "removed_spans"])

    return joined.mapInArrow(run, schema)


def _keyed(df: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("key"), *[F.col(c).alias(f"c_{c}") for c in carried])


def repeated_units(df: DataFrame, unit: str = "line", least: int = LEAST, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, repeats (whether it loses words), n_removed (words), removed_spans ("start-end,..." in the
    original), text (what is left)."""
    found = _cut(_keyed(df, id_col, text_col, []), unit, least, window, [])
    return found.select(F.col("id").alias(id_col), (F.col("n_removed") > 0).alias("repeats"), "n_removed", "removed_spans", F.col("text").alias(text_col))


def without_repeats(df: DataFrame, unit: str = "line", least: int = LEAST, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts cut, all columns and their order kept."""
    carried = [c for c in df.columns if c not in (id_col, text_col)]
    found = _cut(_keyed(df, id_col, text_col, carried), unit, least, window, [f"c_{c}" for c in carried])
    return found.select(*[F.col("id").alias(c) if c == id_col else F.col("text").alias(c) if c == text_col else F.col(f"c_{c}").alias(c) for c in df.columns])
