"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at single spaces into segments (a space is dropped by this family of tokenizers and no token, merge
or added token spans it), segments are gathered into batches of equal bytes, and a batch is encoded as the set of
words that it holds and that this worker has not met: the count of a text is the sum over its words. Counts of
words are kept in a table of bounded size in the worker process.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of added tokens inside a text are what
the library makes of them (one token); a null id stays null; equal rows give equal rows; an empty table an empty
result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Bytes (characters) of a segment and of a batch.
SEGMENT = 1 << 16
BATCH = 1 << 20
#: Words whose counts a worker keeps.
KEPT_WORDS = 1_000_000

#: Latin letters that keep their form under NFC, then ASCII signs without the apostrophe: two tokens' worth of
#: pieces that the pre-tokenizer always parts.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?")

_counters: dict[str, "WordCounter"] = {}


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """text cut at single spaces into parts of about ``most`` characters; a part without a space stays whole."""
    at, end = 0, len(text)
    while end - at > most:
        cut = text.rfind(" ", at + 1, at + most)
        if cut < 0:
            cut = text.find(" ", at + most)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class WordCounter:
    """Token counts of texts by one tokenizers file whose tokens never span white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words: dict[str, int] = {}
        self.runs: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        plain, parts, fresh = {}, set(), []
        for w in words:
            m = _SIMPLE.fullmatch(w)
            if m:
                plain[w] = pair = (m[1].lower(), m[2] or "")
                parts.update(p for p in pair if p and p not in self.runs)
            else:
                fresh.append(w)
        if parts:
            listed = list(parts)
            self.runs.update(zip(listed, self._encode(listed)))
        runs = self.runs
        runs[""] = 0
        for w, (a, b) in plain.items():
            self.words[w] = runs[a] + runs[b]
        if fresh:
            self.words.update(zip(fresh, self._encode(fresh)))

    def count(self, texts: list[str | None]) -> list[int]:
        found = [0] * len(texts)
        batch: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            for part in segments(text):
                batch.append((i, part.replace("\n", " ").split(" ")))
                size += len(part)
                if size >= BATCH:
                    self._count(batch, found)
                    batch, size = [], 0
        self._count(batch, found)
        return found

    def _count(self, batch: list[tuple[int, list[str]]], found: list[int]) -> None:
        for table in (self.words, self.runs):
            if len(table) > KEPT_WORDS:
                table.clear()
        get = self.words.get
        short, missing = [], set()
        for i, words in batch:
            counts = list(map(get, words))
            if None in counts:
                missing.update(w for w, c in zip(words, counts) if c is None)
                short.append((i, words))
            else:
                found[i] += sum(counts)
        if missing:
            self._learn(missing)
            for i, words in short:
                found[i] += sum(map(get, words))


def counter(path: str) -> WordCounter:
    """The worker's own counter for a file: it lives as long as the worker process."""
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_bytes, n_tokens, over_limit. tokenizer: place of a tokenizers file, on every machine."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from limen.llm.token_counts import counter

        count = counter(tokenizer).count
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count(b.column(2).to_pylist()), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
