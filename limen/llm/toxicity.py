"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features come from the whole text alone: densities of lexicon words (a fixed list, and word stems learnt from
training labels), lexicon words near second-person words, capitals, punctuation, obfuscated words. Each worker
knows the class of each word form that it has met, so a text costs a look-up a word.

Training reads labelled rows only, a hash sample of ``TRAIN_ROWS`` of them on average (documented bound: what is
fitted on the driver is this sample's features and the counts of candidate stems). Stems are learnt per fold: a
training row's features use stems counted on other folds. Trees are fitted on the same folds for out-of-fold
margins, on which the calibration is fitted.

Defined results: a null or empty text is scored like a text without words; without usable labels of both classes
every score is the share of toxic labels (0 without labels); labels that are null or of null ids are not used; of
repeated labels of one id the larger is; documents with a null id are scored and never train; equal rows give
equal scores; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_caches, saved, ship

#: Labelled rows that train, on average.
TRAIN_ROWS = 16_000
FOLDS = 4
#: Lengths of stems, the least number of toxic documents that have one, and how many stems are kept.
STEMS = (3, 4, 5, 6)
LEAST_DOCS = 3
MOST_STEMS = 20_000
#: Log of how much likelier a stem is in toxic documents.
LEAST_WEIGHT = 2.5
NEAR = 4
#: Word forms that a worker keeps.
KEPT_WORDS = 300_000

# Insults and second-person words.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers trash garbage worthless pathetic disgusting scum clown fool jerk creep ugly filthy vermin hate kill shut".split())
SECOND = frozenset("you your yours yourself u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch sie usted ustedes ti tuyo vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

NAMES = ["insults", "stem_rate", "stem_sum", "stem_max", "stem_hits", "near", "second", "capitals", "all_caps", "punctuation", "marks", "obfuscated", "repeated", "log_words", "word_length", "distinct_stems"]
_LETTERS = re.compile(r"[^\W\d_]")
_ODD = re.compile(r"[^\W\d_][\d@$!|*.\-_+]+[^\W\d_]")
_LONG = re.compile(r"(.)\1\1")
_EDGE = string.punctuation + "¡¿«»„“”‘’"


def plain(word: str) -> str:
    """The word without signs around it, in lower case, look-alike signs inside as letters."""
    core = word.strip(_EDGE.replace("@", "").replace("$", ""))
    return core.lower().translate(LEET).strip(_EDGE) if core else ""


def stems(form: str) -> list[str]:
    return [form[:k] for k in STEMS if len(form) > k] + ([form + "$"] if len(form) >= min(STEMS) else [])


class Words:
    """What each word form amounts to: a row of numbers, kept for the worker's life."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, 13), np.float32)

    def learn(self, word: str) -> int:
        form = plain(word)
        weight, which = 0.0, 0
        for s in stems(form):
            w = self.lexicon.get(s, 0.0)
            if w > weight:
                weight, which = w, zlib.crc32(s.encode())
        upper = sum(map(str.isupper, word))
        letters = len(_LETTERS.findall(word))
        signs = sum(not c.isalnum() and not c.isspace() for c in word)
        marks = word.count("!") + word.count("?")
        at = self.at[word] = len(self.at)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = (weight, form in INSULTS, form in SECOND, letters, upper, upper > 1 and upper == letters, signs, marks, bool(_ODD.search(word)), bool(_LONG.search(word)), len(word), which % (1 << 20), bool(form))
        return at

    def features(self, text: str | None) -> np.ndarray:
        if len(self.at) > KEPT_WORDS:
            self.at.clear()
        words = (text or "").split()
        at = list(map(self.at.get, words))
        if None in at:
            for i, x in enumerate(at):
                if x is None:
                    at[i] = self.at.get(words[i], -1)
                    if at[i] < 0:
                        at[i] = self.learn(words[i])
        rows = self.rows[at].astype(float) if at else np.zeros((0, 13))
        n = max(1.0, rows[:, 12].sum()) if len(rows) else 1.0
        weight = rows[:, 0]
        hit = (weight > 0) | (rows[:, 1] > 0)
        second = np.flatnonzero(rows[:, 2])
        near = 0
        if hit.any() and len(second):
            spots = np.flatnonzero(hit)
            i = np.searchsorted(second, spots)
            gap = np.minimum(np.abs(spots - second[np.minimum(i, len(second) - 1)]), np.abs(spots - second[np.maximum(i - 1, 0)]))
            near = int((gap <= NEAR).sum())
        letters, chars = max(1.0, rows[:, 3].sum()), max(1.0, rows[:, 10].sum())
        return np.array([
            rows[:, 1].sum() / n, (weight > 0).sum() / n, weight.sum() / math.sqrt(n), weight.max() if len(rows) else 0.0,
            (weight > 0).sum(), near / n, rows[:, 2].sum() / n, rows[:, 4].sum() / letters, rows[:, 5].sum() / n,
            rows[:, 6].sum() / chars, rows[:, 7].sum() / chars, rows[:, 8].sum() / n, rows[:, 9].sum() / n, math.log1p(n), chars / n,
            len(np.unique(rows[weight > 0, 11])),
        ])


_words: dict[int, Words] = {}


def words_alone() -> dict[int, Words]:
    """The worker's tables of words, after those of other operators are emptied."""
    return own_caches("toxicity", _words)


def words_of(key: int, lexicon: dict[str, float]) -> Words:
    """The worker's own table for one lexicon; only the latest is kept."""
    known = words_alone()
    if key not in known:
        known.clear()
        known[key] = Words(lexicon)
    return known[key]


# --- trees -----------------------------------------------------------------------------------------------------


class Trees:
    """Boosted regression trees for the logistic loss, on features cut into quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 2.0, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty, self.least = rounds, depth, rate, bins, penalty, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        margin = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, y - q, q * (1 - q))
            margin += self._leaf(binned, tree)
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Nodes (feature, bin, value) of a whole tree of the given depth; feature -1 sends all to the left."""
        size = (1 << self.depth + 1) - 1
        tree = np.zeros((size, 3))
        tree[:, 0] = -1
        node = np.zeros(len(g), np.int64)
        wide = self.bins + 1
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-6)
            for f in range(binned.shape[1]):
                key = (node - first) * wide + binned[:, f]
                gs = np.bincount(key, g, n * wide).reshape(n, wide).cumsum(1)
                hs = np.bincount(key, h, n * wide).reshape(n, wide).cumsum(1)
                cs = np.bincount(key, minlength=n * wide).reshape(n, wide).cumsum(1)
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(cs < self.least) | (ct - cs < self.least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    tree[first + k, :2] = f, at[k]
            f = tree[node, 0].astype(np.int64)
            right = (f >= 0) & (binned[np.arange(len(g)), np.maximum(f, 0)] > tree[node, 1])
            node = 2 * node + 1 + right
        gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
        tree[:, 2] = self.rate * gs / (hs + self.penalty)
        return tree

    def _leaf(self, binned: np.ndarray, tree: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            f = tree[node, 0].astype(np.int64)
            node = 2 * node + 1 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > tree[node, 1]))
        return tree[node, 2]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.start + sum(self._leaf(binned, t) for t in self.trees)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on margin (pool adjacent violators)."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least margin, largest margin
    for m, v in zip(margin[order], y[order]):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, c, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += c
            blocks[-1][3] = hi
    at = [e for b in blocks for e in ((b[2], b[0] / b[1]), (b[3], b[0] / b[1]))]
    return np.array([a for a, _ in at]), np.array([b for _, b in at])


# --- training --------------------------------------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y, fold) of a hash sample of the labelled rows that are not held out."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    usable = usable.withColumn("fold", F.crc32(F.col("_id").cast("string").cast("binary")) % (FOLDS + 1)).where("fold <> 0")
    share = min(1.0, rows / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "_id").select("text", "y", (F.col("fold") - 1).cast("int").alias("fold"))


def learn_stems(train: DataFrame) -> list[dict[str, float]]:
    """Weights of stems counted on all folds, then without each of them."""
    ship(train.sparkSession)

    def of_docs(batches, wanted):
        import pyarrow as pa

        from limen.llm.toxicity import FOLDS, plain, stems, words_alone

        words_alone()
        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, y, fold in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = {s for w in set(text.split()) for s in stems(plain(w))}
                for s in found if wanted is None else found & wanted:
                    counts.setdefault(s, [0] * (2 * FOLDS))[FOLDS * y + fold] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.list_(pa.int64()))], ["stem", "n"])

    def counted(rows: DataFrame, wanted) -> DataFrame:
        each = rows.select("text", "y", "fold").mapInArrow(lambda it: of_docs(it, wanted), "stem string, n array<bigint>")
        return each.groupBy("stem").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * FOLDS)])

    toxic = counted(train.where("y = 1"), None).withColumn("a", sum((F.col(f"n{i}") for i in range(FOLDS, 2 * FOLDS)), F.lit(0)))
    # 8 candidates for each stem that is kept, the most frequent first: a bound on what the driver gathers
    found = toxic.where(F.col("a") >= LEAST_DOCS).orderBy(F.col("a").desc(), "stem").limit(8 * MOST_STEMS).collect()
    a = {r["stem"]: [r[f"n{i}"] for i in range(FOLDS, 2 * FOLDS)] for r in found}
    wanted = train.sparkSession.sparkContext.broadcast(frozenset(a))

    def clean_side(batches):
        return of_docs(batches, wanted.value)

    clean = train.where("y = 0").select("text", "y", "fold").mapInArrow(clean_side, "stem string, n array<bigint>")
    b = {r["stem"]: [r[f"n{i}"] for i in range(FOLDS)] for r in clean.groupBy("stem").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(FOLDS)]).collect()}
    sizes = np.zeros((2, FOLDS))
    for r in train.groupBy("y", "fold").count().collect():
        sizes[r["y"], r["fold"]] = r["count"]
    out = []
    for without in (None, *range(FOLDS)):
        use = [f for f in range(FOLDS) if f != without]
        nt, nc = sizes[1, use].sum(), sizes[0, use].sum()
        weights = {}
        for s, counts in a.items():
            t = sum(counts[f] for f in use)
            c = sum(b[s][f] for f in use) if s in b else 0
            if t >= LEAST_DOCS:
                w = math.log((t + 0.25) / (nt + 0.5)) - math.log((c + 0.25) / (nc + 0.5))
                # frequent in toxic documents, next to absent elsewhere
                if w >= LEAST_WEIGHT:
                    weights[s] = w * math.sqrt(min(1.0, t / 8))
        out.append(dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:MOST_STEMS]))
    return out


class Model:
    """Lexicon, trees and calibration; small, sent to executors as a broadcast."""

    def __init__(self, lexicon, trees, knots, constant=0.0):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant
        self.key = zlib.crc32(repr(sorted(lexicon.items())).encode())

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        words = words_of(self.key, self.lexicon)
        x = np.array([words.features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    train = saved(training_rows(docs, labels, id_col, text_col, rows), "toxic-train")
    totals = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if len(totals) < 2:
        n = sum(totals.values())
        return Model({}, None, None, totals.get(1, 0) / n if n else 0.0)
    whole, *others = learn_stems(train)
    shared = train.sparkSession.sparkContext.broadcast(others)

    def measure(batches):
        import pyarrow as pa

        from limen.llm.toxicity import Words, words_alone

        words_alone()
        tables = [Words(x) for x in shared.value]
        for b in batches:
            x = [tables[f].features(t).tolist() for t, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    found = train.select("text", "y", "fold").mapInArrow(measure, "y int, fold int, x array<double>").toPandas()
    x, y, fold = np.array(found["x"].tolist(), dtype=float), found["y"].to_numpy(float), found["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same trees whatever the order of rows
    x, y, fold = x[order], y[order], fold[order]
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        own = fold == f
        if own.any() and len(set(y[~own])) == 2:
            margin[own] = Trees().fit(x[~own], y[~own]).margin(x[own])
    return Model(whole, Trees().fit(x, y), isotonic(margin, y))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """Per row: id_col, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, rows))
    plain_rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()), pa.float64())], ["_id", "score"])

    found = plain_rows.mapInArrow(run, f"_id {plain_rows.schema['_id'].dataType.simpleString()}, score double")
    rest = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 == 0
    return found.select(F.col("_id").alias(id_col), F.coalesce(rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs with a score below 0.5, all columns; columns go by place, so their names do not matter."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, rows))
    at = docs.columns.index(text_col)
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for b in batches:
            yield b.filter(pa.array(model.score(b.column(at).to_pylist()) < 0.5, pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
