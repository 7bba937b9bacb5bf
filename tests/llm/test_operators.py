"""Each operator on a small table of awkward rows, held against brute force."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("limen.llm")
P = pytest.importorskip("public_tokenizers")

from limen.llm import exact_dedup, jaccard, packing, sharding, substring, token_counts, topk, toxicity, unigram, warc  # noqa: E402

WORDS = "alpha beta Gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(n))


def rows():
    base, line = prose(1, 60), "this very line of ten words stands in many texts"
    near = base.split(" ")
    near[30] = "changed"
    texts = [base, base, " ".join(near), base.replace(" ", "\t\n"), None, "", " \n ", "one two", "one  two", "ONE TWO", line, f"{line}\n{prose(2, 30)}", f"{prose(3, 30)}\n{line}\nend", prose(4, 6000), "x" * 50_000, "a<|endoftext|> b  <|endoftext|>", "😀 中文 ▁x\r\n\x0b.", line, line]
    texts += [prose(100 + i, 40) + "\n" + line for i in range(20)] + [base] * 20
    return [(i, t, "en" if i % 2 else None, None if i % 3 else "s", "z") for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, id string, node string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows."""
    r = rows()[:14]
    return spark.createDataFrame([*r, *r, (None, "one two", None, None, None), (None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {i: t for i, t, *_ in rows()}
byte_bpe = P.path("byte_bpe_50k.json")
word_bpe = P.path("word_bpe_49k.json")
pieces = P.path("piece_bpe_32k.model")


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_awkward_tables_do_not_crash(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for df in (odd, none):
        n = df.count()
        assert exact_dedup.exact_dedup(df).count() == n
        assert jaccard.similar_sets(df).count() == n
        assert sharding.sharded(df, 3).count() == n
        assert token_counts.token_counts(df, word_bpe).count() == n
        assert unigram.encoded(df, pieces).count() == n
        assert substring.repeated_units(df).count() == n
        assert toxicity.toxicity(df, labels).count() == n
        assert packing.packed(df, byte_bpe).where("piece = 0").count() == n
        assert substring.without_repeats(df).columns == df.columns
        assert exact_dedup.drop_exact(df).columns == df.columns


def test_exact_dedup(docs):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in TEXTS.items()}
    groups = collections.defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for i, r in got(exact_dedup.exact_dedup(docs)).items():
        g = groups[norm[i]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), i == min(g), hashlib.sha256(norm[i].encode()).hexdigest())
    assert {r.doc_id for r in exact_dedup.drop_exact(docs).collect()} == {min(g) for g in groups.values()}


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    at[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_similar_sets(docs):
    want = brute_components(TEXTS)
    assert {i: (r.n_shingles, r.component_id) for i, r in got(jaccard.similar_sets(docs)).items()} == want
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets_of_variants(spark, seed):
    """Variants of a few texts, near the limit, with a passage that all share."""
    rng = random.Random(seed)
    texts, common = {}, prose(9, 25)
    for g in range(5):
        base = prose(seed * 50 + g, rng.randint(20, 90)).split(" ")
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
            texts[len(texts)] = " ".join(w) + (" " + common if rng.random() < 0.7 else "")
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {i: (r.n_shingles, r.component_id) for i, r in got(jaccard.similar_sets(df)).items()} == brute_components(texts)


def test_groups_alone_find_all_links(spark, monkeypatch):
    """The last step decides everything that leaders leave."""
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 0)
    test_similar_sets_of_variants(spark, 3)


def test_sharding(docs):
    found = got(sharding.sharded(docs, 4))
    sizes = collections.Counter()
    for i, r in found.items():
        raw = (TEXTS[i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
    assert set(sizes) <= set(range(4))
    for s in sizes:
        assert sorted(r.slot for r in found.values() if r.shard == s) == list(range(sum(r.shard == s for r in found.values())))
    assert max(sizes.values()) <= sum(sizes.values()) / 4 + max(r.size for r in found.values())


def test_token_counts(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_bpe)
    for i, r in got(token_counts.token_counts(docs, word_bpe, limit=30)).items():
        n = len(library.encode(TEXTS[i] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXTS[i] or "").encode()), n, n > 30)


ALPHABET = ["a", "b", "E", "é", " ", "  ", "\n", "\t", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'S", "1", "²", "ß", "İ", "Σ", "中文", "\xa0", "́", "*", "#.", "don't", "ﬁ", "😀", "\x1c", "\x85", "_"]


def test_cached_encoders_equal_the_libraries():
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    counter, encoder = token_counts.WordCounter(word_bpe), packing.ChunkEncoder(byte_bpe)
    assert counter.count(texts) == [len(e.ids) for e in Tokenizer.from_file(word_bpe).encode_batch(texts, add_special_tokens=False)]
    for t, e in zip(texts, Tokenizer.from_file(byte_bpe).encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == e.ids, repr(t)


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(byte_bpe)
    rows_ = packing.packed(docs, byte_bpe, capacity=512).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    lengths = []
    for i, t in TEXTS.items():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 512 or k == 0
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert len(by_bin) == len(plain_best_fit(lengths, 512))


def plain_best_fit(items, capacity):
    room = []
    for x in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits)[1]] -= x
        else:
            room.append(capacity - x)
    return room


def test_best_fit_over_lengths_equals_item_by_item():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([7, 16, 37])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 70))]
        counts = collections.Counter(items)
        plan, bins = packing.best_fit_decreasing(counts, capacity)
        assert bins == len(plain_best_fit(items, capacity))
        assert sorted({p[0] for p in plan}) == sorted(counts)


def test_top_k(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:60] = v[40]
    data = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    data += [(1000, None, 0), (1100, [float("nan")] * 8, 0), (1200, [1.0, None] + [0.0] * 6, 0), (None, [1.0] * 8, 0), (1300, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    found = topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, block_rows=64).collect()
    q = np.floor(1024 * v.astype(float)).astype(np.int64)
    for i in range(0, 300, 100):
        s = q @ q[i]
        want = sorted(((-int(x), j) for j, x in enumerate(s) if j != i))[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == i)
        assert mine == [(k + 1, j, -x) for k, (x, j) in enumerate(want)]
    assert not [r for r in found if r.query_id in (1000, 1100, 1200, 1300)]


def test_bit_sums_equal_inner_products():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, d, k = int(rng.integers(1, 150)), int(rng.integers(1, 9)), int(rng.integers(1, 14))
        v = rng.integers(-900, 900, (n, d))
        ids = rng.permutation(2 * n)[:n].astype(np.int64)
        low, index, _ = topk.slices(v)
        q = rng.integers(-5, 6, d) * int(rng.integers(1, 300))
        mine = sorted(topk.search_block(ids, low, index, int(ids[0]), q, k), key=lambda x: (-x[1], x[0]))
        assert mine == sorted(((int(i), int(x)) for i, x in zip(ids, v @ q) if i != ids[0]), key=lambda x: (-x[1], x[0]))[:k]


def test_warc(spark):
    marker = "é WARC/1.1\r\n WARC/1.1\r\nWARC/1.1\r\n"
    data = [(1, "u", "x" * 200_000), (2, None, None), (3, "u", ""), (4, "a", marker), (5, "b", marker), (None, "n", "zz"), (7, "n", "zz"), (8, "q", None), (8, "q", None), (9, "\r\n", "\r\n\r\n")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", F_lit())
    first = {}
    for i, _, h in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    rows_ = warc.round_trip(df).collect()
    assert len(rows_) == len(data)
    for r in rows_:
        h = next(x for i, _, x in data if i == r.page_id) or ""
        own = first[h] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[h]))
    assert warc.round_trip(df.limit(0)).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_warc_chunks_hold_no_version_line():
    raw = b"ab" + warc.VERSION * 3 + b"z" * 10
    for most in (1, 5, 11, 64):
        parts = [bytes(p) for p in warc.chunks(memoryview(raw), most)]
        assert b"".join(parts) == raw and all(len(p) <= most and warc.VERSION not in p for p in parts)


def test_unigram_equals_the_library_on_known_characters():
    spm = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as M

    m = M.ModelProto()
    with open(pieces, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for p in m.pieces:  # the library sums in single precision
        p.score = max(p.score, -40000.0)
    library = spm.SentencePieceProcessor(model_proto=m.SerializeToString())
    mine = unigram.Unigram([(p.piece, p.score, p.type) for p in m.pieces])
    for s in [prose(i, 30) for i in range(40)] + ["a  b", " x", "the tion and"]:
        ids = mine.encode(s)
        score = lambda x: sum(mine.score[i] for i in x)
        assert not mine.byte_ids[ids].any()
        assert score(ids) == score(library.encode(s)) and mine.decode(ids) == s


def test_unigram_is_optimal_and_round_trips(docs):
    tiny = unigram.Unigram([("<unk>", 0.0, 2), *[(f"<0x{b:02X}>", 0.0, 6) for b in range(256)], ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("bab", -4.0, 1)])

    def best(text):
        if not text:
            return 0.0
        options = [tiny.unknown + best(text[1:])] if text[0] not in "▁ab" else []
        return max(options + [tiny.score[i] + best(text[len(p) :]) for i, p in enumerate(["", *[""] * 256, "▁", "a", "b", "ab", "▁a", "bab"]) if p and text.startswith(p)])

    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("ab é") for _ in range(rng.randint(1, 9)))
        ids = tiny.encode(s).tolist()
        raw = [i for i in ids if not tiny.byte_ids[i]]
        unknown = sum(c == "é" for c in s)
        assert sum(tiny.score[i] for i in raw) + unknown * tiny.unknown == pytest.approx(best("▁" + s.replace(" ", "▁")))
        assert tiny.decode(tiny.encode(s)) == s
    for i, r in got(unigram.encoded(docs, pieces)).items():
        assert r.round_trip or "▁" in TEXTS[i] or TEXTS[i] is None
        assert r.decoded_crc32 == zlib.crc32((TEXTS[i] or "").replace("▁", " ").encode())


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(7)
    data, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = prose(i, 40).split(" ")
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["grobulus", "grobnik", "snarkfest"]) + rng.choice(["", "ly", "er"])
        data.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(data, "doc_id long, text string, score string")
    found = got(toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")))
    held = [i for i, r in found.items() if r.held_out]
    assert held == [i for i in found if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].predicted == (i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_isotonic_is_monotone_and_averages():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x))).astype(float)
    at, value = toxicity.isotonic(x, y)
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= -1e-12).all()
    assert np.interp(x, at, value).mean() == pytest.approx(y.mean(), abs=0.02)
