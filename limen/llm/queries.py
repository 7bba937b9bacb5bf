"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, jaccard, merkle, packing, secret_scan, sharding, substring, token_counts, topk, toxicity, unigram, warc
from .common import table
from .exact_dedup import exact_dedup


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, where the package of them is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), limit=2048)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), shards=24)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP6_SQL = """
WITH v AS (SELECT vec_id, [cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_sets(table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_units(table(spark, sf_dir, "documents"), unit="line", least=20, window=15)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, text, low, regexp_extract_all(low, '[^\x20\x09-\x0D]+') AS words, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS pieces FROM d),
k AS (SELECT doc_id, unnest(generate_series(1, len(words))) AS pos, unnest(words) AS word FROM w),
h AS (SELECT doc_id, pos, CAST('0x' || substr(md5(word), 1, 6) AS BIGINT) AS h FROM k),
r AS (SELECT doc_id, pos, (h + 48271 * lead(h, 1) OVER o + 182605794 * lead(h, 2) OVER o + 1291394886 * lead(h, 3) OVER o) % 2147483647 AS run FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, min(run * 4194304 + pos) OVER o % 4194304 AS pick, count(*) OVER o AS n FROM r WHERE run IS NOT NULL
    WINDOW o AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
runs AS (SELECT doc_id, pick AS first, lead(pick) OVER (PARTITION BY doc_id ORDER BY pick) + 20 AS stop FROM (SELECT DISTINCT doc_id, pick FROM p WHERE n = 15)),
l AS (SELECT doc_id, unnest(generate_series(1, len(string_split(low, chr(10))))) AS k, unnest(string_split(low, chr(10))) AS line FROM w),
c AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY k) + 1 AS stop, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
u AS (SELECT doc_id, first, stop FROM runs WHERE stop IS NOT NULL UNION SELECT doc_id, CAST(stop - n AS BIGINT), CAST(stop AS BIGINT) FROM c WHERE n >= 20),
v AS (SELECT doc_id, first, stop, array_to_string(words[first:stop - 1], ' ') AS unit FROM u JOIN w USING (doc_id) WHERE stop <= len(words) + 1),
f AS (SELECT *, first_value(doc_id) OVER o AS owner, first_value(first) OVER o AS place FROM v WINDOW o AS (PARTITION BY unit ORDER BY doc_id, first)),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(CASE WHEN owner = doc_id THEN greatest(first, place + stop - first) ELSE first END, stop - 1)) AS pos FROM f WHERE owner <> doc_id OR place <> first),
-- the pieces of a text alternate between white space and words: word k is piece 2k or 2k - 1
x AS (SELECT doc_id, unnest(generate_series(1, len(pieces))) AS j, unnest(pieces) AS piece, CASE WHEN regexp_matches(low, '^[\x20\x09-\x0D]') THEN 0 ELSE 1 END AS lead FROM w),
y AS (SELECT doc_id, j, piece, (j + lead) % 2 = 0 AS is_word, (j + lead) // 2 AS word, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY j) - length(piece) AS start FROM x),
z AS (SELECT y.*, g.pos IS NOT NULL AS gone, CASE WHEN g.pos IS NULL THEN 0 ELSE y.word - row_number() OVER (PARTITION BY y.doc_id, g.pos IS NULL, is_word ORDER BY y.word) END AS island FROM y LEFT JOIN g ON y.doc_id = g.doc_id AND y.is_word AND y.word = g.pos),
s AS (SELECT doc_id, string_agg(CAST(a AS BIGINT) || '-' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed_spans, CAST(sum(n) AS BIGINT) AS n_removed
    FROM (SELECT doc_id, min(start) AS a, max(start + length(piece)) AS b, count(*) AS n FROM z WHERE is_word AND gone GROUP BY doc_id, island) GROUP BY doc_id),
-- white space goes with a lost word behind it, pos the start of a text also with the lost words before it
e AS (SELECT *, coalesce(lead(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS before_gone, coalesce(bool_and(gone OR NOT is_word) OVER (PARTITION BY doc_id ORDER BY j), false) AS all_gone,
    bool_or(gone) OVER (PARTITION BY doc_id ORDER BY j) AS any_gone FROM z),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY j) FILTER (NOT CASE WHEN is_word THEN gone ELSE before_gone OR (all_gone AND any_gone) END) AS left_over FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) > 0 AS repeats, coalesce(n_removed, 0) AS n_removed, coalesce(removed_spans, '') AS removed_spans, CASE WHEN text IS NULL THEN NULL ELSE coalesce(left_over, '') END AS text
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_elkan_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64)


def _op11_sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    far = "cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v.v, c.c)]) AS BIGINT)"
    parts = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, [cast(floor({centroids.SCALE} * cast(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT v, sha256('1:' || coalesce(cast(vec_id AS VARCHAR), '')) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT n, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS m FROM (SELECT v.*, c.j, {far} AS d FROM v, c{r} c) GROUP BY n)")
        if r < rounds:
            # floor of a quotient of whole numbers, exactly
            parts.append(f"""s{r} AS (SELECT m.j AS j, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, generate_series(1, {dims}) g(i) GROUP BY m.j, i),
n{r} AS (SELECT j, list(cast((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j),
c{r + 1} AS (SELECT c{r}.j, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} ON c{r}.j = n{r}.j)""")
    last = f"""SELECT vec_id, cast(m.j AS INTEGER) AS cluster, m.d AS distance, cast(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia,
    cast(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON a.m.j = c.j"""
    return "WITH " + ",\n".join(parts) + "\n" + last


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"), MANIFEST_FIELDS, merkle.lowered_text_leaf(MANIFEST_FIELDS))


def _op12_sql(group_levels: int = 7, top_levels: int = 2) -> str:
    """Levels are written out: enough for 8^7 documents of a language and 64 languages; a lone node stays as it is."""
    framed = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(cast({c} AS VARCHAR))) || ':' || {c} END"
    digest = lambda text: "sha256(" + " || ".join(framed(text if f == "text" else f) for f in MANIFEST_FIELDS) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # crc32 is no function of this SQL: bitwise, from a table of its own
    crc = """t(i, c) AS (SELECT i, list_reduce(list_concat([i], generate_series(1, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) FROM range(256) r(i)),
ct AS (SELECT list(c ORDER BY i) AS tab FROM t),
d AS (SELECT documents.*, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(x)::BIGINT for x in string_split(cast(doc_id AS VARCHAR), '')]), lambda c, x: xor(ct.tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc FROM documents, ct)"""
    parts = [crc, f"l0 AS (SELECT lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, doc_id, {digest('text')} AS node, CASE WHEN crc % 3 = 0 THEN {digest(low)} END AS forged FROM d)"]

    def climb(name: str, levels: int) -> None:
        for h in range(levels):
            parts.append(f"{name}s{h} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, string_agg(node, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, string_agg(node, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM {name}{h})")
            parts.append(f"{name}{h + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node FROM {name}s{h} GROUP BY g, i // 8)")

    climb("l", group_levels)
    parts.append(f"k0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, g AS lang, node FROM l{group_levels})")
    climb("k", top_levels)
    now, proof, joins = "coalesce(l0.forged, l0.node)", [], []
    for name, levels in (("l", group_levels), ("k", top_levels)):
        for h in range(levels):
            at = f"{name}s{h}"
            own = f"l0.i // {8**h}" if name == "l" else f"top.i // {8**h}"
            joins.append(f"JOIN {at} ON {at}.i = {own} AND {at}.g IS NOT DISTINCT FROM " + ("l0.g" if name == "l" else "0"))
            proof.append(f"coalesce({at}.a, '') || coalesce({at}.b, '')")
    steps = [f"SELECT l0.doc_id, l0.node AS leaf, top.node AS subroot, k{top_levels}.node AS root, sha256({' || '.join(proof)}) AS proof_sha256, {now} AS f0, "
             + ", ".join(f"{name}s{h}.n > 1 AS m{at}, coalesce({name}s{h}.a, '') AS a{at}, coalesce({name}s{h}.b, '') AS b{at}" for at, (name, h) in enumerate([("l", h) for h in range(group_levels)] + [("k", h) for h in range(top_levels)]))
             + f" FROM l0 JOIN k0 top ON top.lang IS NOT DISTINCT FROM l0.g {' '.join(joins)} CROSS JOIN k{top_levels}"]
    parts.append(f"p0 AS ({steps[0]})")
    for at in range(group_levels + top_levels):
        parts.append(f"p{at + 1} AS (SELECT *, CASE WHEN m{at} THEN sha256(a{at} || f{at} || b{at}) ELSE f{at} END AS f{at + 1} FROM p{at})")
    end = group_levels + top_levels
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, f{end} AS folded_root, f{end} = root AS verified FROM p{end}"


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_toxicity": op2_toxicity,
        "op3_kd_sharding": op3_kd_sharding,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_top_k": op6_top_k,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_elkan_centroids": op11_elkan_centroids,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": OP4_SQL,
        "op6_top_k": OP6_SQL,
        "op9_substring_dedup": OP9_SQL,
        "op11_elkan_centroids": _op11_sql(),
        "op12_merkle_manifest": _op12_sql(),
    }
