"""run() on a small corpus against a plain chain of its stages."""

import random

import pytest

pytest.importorskip("limen.llm")
pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")

from test_operators import brute_components, plain_best_fit, prose  # noqa: E402
from test_substring import plain_units  # noqa: E402


def corpus():
    rng = random.Random(8)
    texts, labels = [], []
    passage = prose(900, 60)
    for i in range(240):
        w = prose(i, 80).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(6):
                w[rng.randrange(80)] = rng.choice(["grobulus", "grobnik", "snarkfest"])
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    clean = [t for t, (_, y) in zip(texts, labels) if not y]
    near = clean[3].split(" ")
    near[40] = "changed"
    texts += [clean[0], clean[1].replace(" ", "\n"), " ".join(near), f"{clean[5]} {passage} tail", f"{clean[7]}\n{passage} end"]
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], labels


def test_run_equals_plain_stages(spark, tmp_path, monkeypatch):
    import test_substring
    from tokenizers import Tokenizer

    monkeypatch.setattr(test_substring, "LEAST", 20)
    monkeypatch.setattr(test_substring, "WINDOW", 15)
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # the classifier's decisions are the operator's own; the planted ones must be among them
    left = {r.doc_id: r.text for r in pipeline.not_toxic(spark, docs, sf).collect()}
    assert sum(i in left for i, y in labels if y) <= 2 and sum(i not in left for i, y in labels if not y) <= 4
    first = {}
    for i in sorted(left):
        first.setdefault(" ".join(left[i].split()), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, (_, c) in brute_components(left).items() if i == c}
    assert not {240, 241, 242} & set(left)
    seen, cut = {}, {}
    for i in sorted(left):
        words, units = plain_units(left[i])
        gone = {k for s, e in units if seen.setdefault(tuple(words[s:e]), (i, s)) != (i, s) for k in range(s, e)}
        cut[i] = " ".join(w for k, w in enumerate(left[i].split()) if k not in gone)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: 1 + len(library.encode(t, add_special_tokens=False).ids) for i, t in cut.items() if "\n" not in t}
    found = pipeline.run(spark, sf).collect()
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert set(got) == set(cut)
    assert len({r.sequence_id for r in found}) == len(plain_best_fit(list(got.values()), 2048))
    assert got[243] == want[243] and sum(got[i] == n for i, n in want.items()) >= len(want) - 1  # one text keeps a line break
