"""Unigram encoding and decoding of a SentencePiece model's pieces.

Pieces are held in a double-array trie over their UTF-8 bytes; a text is encoded by the path of pieces with the
largest sum of log scores (Viterbi), ties going to the path whose last piece starts first. A character that no
piece covers costs ``UNKNOWN`` below the worst score and becomes one byte piece for each of its bytes. White space
is the marker U+2581: a space becomes one, one is put in front, and decoding turns markers to spaces and takes the
first away.

No piece but runs of markers holds a marker elsewhere than in front, so no piece stands across the place between
another character and a marker: texts are encoded in units of a run of markers and the word after it, and each worker
keeps what it has encoded.

Defined results: null and empty texts have no pieces and decode to an empty text; U+2581 in a text is taken as a
space (as the model's normaliser does), such a text decodes to spaces; equal rows give equal rows; a null id stays
null; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
UNKNOWN = 10.0
KEPT_WORDS = 700_000
#: Longer words are encoded anew each time.
LONG = 64
#: A space and, as the group, the spaces and the word after it.
_UNIT = re.compile(r" ( *[^ ]*)")

#: Score of a place that no path reaches.
NEVER = float("-inf")

_models: dict[str, "Unigram"] = {}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class DoubleArray:
    """Trie with base and check: the child of state s by byte c is base[s] + c, if check there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = max(1024, 4 * sum(map(len, keys)))
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = hint = 256  # beyond any byte, so that each base is positive
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                self.value[state] = values[lo]
                lo += 1
            if lo >= hi:
                continue
            parts, at = [], lo
            while at < hi:
                c, end = keys[at][depth], at
                while end < hi and keys[end][depth] == c:
                    end += 1
                parts.append((c, at, end))
                at = end
            while self.check[free] >= 0:
                free += 1
            first = parts[0][0]
            # a lone child takes the first free place; others are looked for from the last such place on, where
            # the array is next to empty: lone children fill what is left between
            at = free if len(parts) == 1 else hint
            check = self.check
            while at + 512 >= len(check):
                self._grow()
                check = self.check
            while any(check[at - first + c] >= 0 for c, _, _ in parts):
                at += 1
                if at + 512 >= len(check):
                    self._grow()
                    check = self.check
            if len(parts) > 1:
                hint = at
            base = at - first
            self.base[state] = base
            for c, a, b in parts:
                check[base + c] = state
                todo.append((base + c, a, b, depth + 1))
        for column, empty in ((self.base, 0), (self.check, -1), (self.value, -1)):
            column += [empty] * 256  # any base plus any byte is a place

    def _grow(self) -> None:
        n = len(self.check)
        self.base += [0] * n
        self.check += [-1] * n
        self.value += [-1] * n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


# Kinds of pieces in a model file.
NORMAL, USER, BYTE = 1, 4, 6


class Unigram:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        plain = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER)]
        if any(MARK in p[1:] and p.strip(MARK) for _, p, _ in plain):
            raise ValueError("a piece holds a marker inside a word")
        self.trie = DoubleArray([p.encode() for _, p, _ in plain], [i for i, _, _ in plain])
        self.longest = max((len(p.encode()) for _, p, _ in plain), default=1)
        self.score = [s for _, s, _ in pieces]
        self.unknown = min((s for _, _, s in plain), default=0.0) - UNKNOWN
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        at = set(self.bytes.values())
        self.byte_ids = np.zeros(len(pieces), bool)
        self.byte_ids[list(at)] = True
        self.raw = [bytes([int(p[3:5], 16)]) if i in at else p.replace(MARK, " ").encode() for i, (p, _, _) in enumerate(pieces)]
        self.kept: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path over a marked text. The trie is walked in place: most of the time goes here."""
        text = word.encode()
        n = len(text)
        base, check, value, score, longest = self.trie.base, self.trie.check, self.trie.value, self.score, self.longest
        best = [NEVER] * (n + 1)
        back, piece = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here == NEVER:
                continue
            lead = text[at]
            one = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            state, end, single = 0, at, False
            for c in text[at : at + longest]:
                to = base[state] + c
                if check[to] != state:
                    break
                state = to
                end += 1
                found = value[to]
                if found >= 0:
                    total = here + score[found]
                    if total > best[end]:
                        best[end], back[end], piece[end] = total, at, found
                    if end == one:
                        single = True
            if not single:
                total = here + self.unknown
                if total > best[one]:
                    best[one], back[one], piece[one] = total, at, -1
        out: list[int] = []
        at = n
        while at:
            start = back[at]
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.bytes[c] for c in reversed(text[start:at])]
            at = start
        return out[::-1]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        spaced = " " + text.replace(MARK, " ")
        words = _UNIT.findall(spaced) if "  " in spaced else spaced[1:].split(" ")
        found = list(map(kept.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    w = words[i]
                    ids = kept.get(w)
                    if ids is None:
                        ids = packed(self.viterbi(MARK + w.replace(" ", MARK)))
                        if len(w) <= LONG:
                            kept[w] = ids
                    found[i] = ids
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def model(path: str) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(read_model(path))
    return _models[path]


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: id_col, n_pieces, n_byte_pieces, ids_crc32 (packed 32-bit little-endian ids), decoded_crc32 (UTF-8
    of the decoded text), round_trip; with ids, the ids as well. path: the model file, on every machine."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from limen.llm.unigram import model

        m = model(path)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                found = m.encode(text)
                back = m.decode(found)
                out.append((len(found), int(m.byte_ids[found].sum()), zlib.crc32(found.tobytes()), zlib.crc32(back.encode()), back == text, found.tolist() if ids else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()))
            cols = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip", "ids"])

    found = rows.mapInArrow(run, f"id {id_type}, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean, ids array<int>")
    return found.select(F.col("id").alias(id_col), "n_pieces", "n_byte_pieces", "ids_crc32", "decoded_crc32", "round_trip", *(["ids"] if ids else []))
