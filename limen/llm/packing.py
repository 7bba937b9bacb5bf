"""Best-fit packing of token sequences into bins of one capacity.

Three steps. (1) Arrow functions encode every text and return pieces: lengths and checksums of ids, never the ids
of all texts at once. (2) Best-fit decreasing over the histogram of lengths, which has at most ``capacity`` rows
whatever the input: a segment tree over remaining capacities 0 to ``capacity`` finds the tightest open bin in
logarithmic time. Pieces of one length are interchangeable, so one lookup places a whole run of them; what comes
out equals placing them one by one. (3) Each piece gets its rank among those of its length, without meeting them
in one task, and finds its bin in the plan by that rank.

Defined results: a null or empty text is one piece, the end id alone; a document over the capacity is cut into
pieces of the capacity, the first being what remains (all full if nothing remains); every row is packed, rows that
repeat as well; a null id stays null; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_caches, range_ranked, saved, ship

CAPACITY = 2048
#: Chunks whose ids a worker keeps.
KEPT_CHUNKS = 200_000
#: Outside of these code points the pattern of the ranks is not relied upon.
_RARE = re.compile(r"[^\x00-ɏ]")
_SPECIAL = "<|"

_encoders: dict[str, "ChunkEncoder"] = {}


class ChunkEncoder:
    """Ids of a byte-level tokenizers file, as packed 32-bit little-endian, put together from chunks.

    A chunk starts at a space that a character other than white space follows: the pattern of the byte-level
    pre-tokenizer starts a token there whatever came before. Special strings are kept with what precedes them.
    New chunks are encoded by merge ranks taken from the file, those with rare characters or special strings by
    the library itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in vocab.items() if all(c in to_byte for c in piece)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        if _SPECIAL in chunk or _RARE.search(chunk):
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(chunk), "<u4").tobytes()

    @staticmethod
    def _starts(piece: str) -> bool:
        return piece != "" and not piece[0].isspace() and not piece.startswith(_SPECIAL)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        kept = self.kept
        if len(kept) > KEPT_CHUNKS:
            kept.clear()
        pieces = text.split(" ")
        found = list(map(kept.get, pieces))
        found[0] = None
        if None in found:
            starts = self._starts
            n = len(pieces)
            odd = [i for i, x in enumerate(found) if x is None]
            skip = -1
            for i in odd:
                if i <= skip:
                    continue
                if i and starts(pieces[i]) and (i + 1 == n or starts(pieces[i + 1])):
                    key = pieces[i]
                    ids = kept.get(key)
                    if ids is None:
                        ids = kept[key] = self._ids(" " + key)
                    found[i] = ids
                    continue
                a = i
                while a and not starts(pieces[a]):
                    a -= 1
                b = i + 1
                while b < n and not starts(pieces[b]):
                    b += 1
                found[a] = self._ids((" " if a else "") + " ".join(pieces[a:b]))
                for j in range(a + 1, b):
                    found[j] = b""
                skip = b - 1
        return b"".join(found)


def encoder(path: str) -> ChunkEncoder:
    known = own_caches("packing", _encoders)
    if path not in known:
        known[path] = ChunkEncoder(path)
    return known[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of packed ids."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    view, out, at = memoryview(ids), [], 0
    while at < n:
        m = first if not at else capacity
        out.append((at, m, zlib.crc32(view[4 * at : 4 * (at + m)])))
        at += m
    return out


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32. tokenizer: place of a byte-level tokenizers file."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from limen.llm.packing import cut, encoder

        encode, end = encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for b in batches:
            of, out = [], []
            for i, text in enumerate(b.column(1)):
                for k, piece in enumerate(cut(encode(text.as_py()) + end, capacity)):
                    of.append(i)
                    out.append((k, *piece))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


class CapacityTree:
    """Segment tree over remaining capacities 0 to top: how many runs of bins have each."""

    def __init__(self, top: int):
        self.n = 1 << top.bit_length()
        self.has = np.zeros(2 * self.n, np.int64)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.n
        while at:
            self.has[at] += by
            at >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` that a bin has, or -1."""
        at = least + self.n
        if self.has[at]:
            return least
        while at > 1:
            if not at & 1 and self.has[at + 1]:
                at += 1
                while at < self.n:
                    at = 2 * at if self.has[2 * at] else 2 * at + 1
                return at - self.n
            at >>= 1
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first_rank, first_bin, per_bin, base) in order of length and rank; the number of bins.

    The items of a length with ranks from first_rank on go to bins from first_bin on, per_bin to each, at base
    and after. counts: items by length. Runs of bins that are alike are held as (first bin, how many).
    """
    tree, runs = CapacityTree(capacity), {}
    bins = 0
    out = []

    def put(room: int, first: int, n: int) -> None:
        if n:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = capacity // length
                n = max(1, left // each)
                first, bins, room = bins, bins + n, capacity
            else:
                first, n = runs[room].pop()
                tree.add(room, -1)
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left and left < each:
                out.append((length, rank, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            if full < n:
                put(room, first + full, n - full)
    return sorted(out), bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset. pieces must be a written table."""
    spark = pieces.sparkSession
    ship(spark)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    ranked = range_ranked(pieces, ["length"], ["id", "piece"], "rank", "pack")
    table = np.array(plan, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        import pyarrow as pa

        plan = shared.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            rel = rank - plan[at, 1]
            each = plan[at, 3]
            out = pa.array(plan[at, 2] + rel // each), pa.array(plan[at, 4] + rel % each * length)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *out], [*names, "sequence_id", "offset"])

    id_type = pieces.schema["id"].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pack(saved(token_pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
    return found.withColumnRenamed("id", id_col)
