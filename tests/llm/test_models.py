"""Vectors, URLs, quality, languages and the pipeline against plain versions on small tables."""

import random
import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from public_tokenizers import path

import corpus_pipeline
from rankloom.llm import bloom, language, multi_index, quality, url_filter
from rankloom.llm.catalog import ORACLE_SQL, QUERIES
from rankloom.llm.components import components, joined_by

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def _near_vectors(rows, threshold=0.98):
    made = {}
    for at, (vec_id, vector, label) in enumerate(rows):
        fine = vec_id is not None and label is not None and vector and None not in vector
        x = np.array(vector, float) if fine else None
        if fine and np.isfinite(x).all() and x.any():
            made[at] = (label, x / np.linalg.norm(x))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = Counter()
    for i, (label, x) in made.items():
        for j, (other, y) in made.items():
            if i < j and label == other and len(x) == len(y) and float(x @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(j)] = find(i)
    smallest = {}
    for i in range(len(rows)):
        smallest[find(i)] = min(smallest.get(find(i), math.inf), math.inf if rows[i][0] is None else rows[i][0])
    return Counter((row[0], links[i], None if row[0] is None else smallest[find(i)]) for i, row in enumerate(rows))


def test_near_vectors(spark):
    random = np.random.default_rng(0)
    rows = []
    for _ in range(12):
        base = random.standard_normal(16)
        for _ in range(12):
            step = random.standard_normal(16)
            near = base + step * np.linalg.norm(base) / np.linalg.norm(step) * random.uniform(0.05, 0.25)
            rows.append((near.astype(np.float32).tolist(), int(random.integers(3))))
    # A large group of copies, and of near copies, of one label.
    rows += [(rows[0][0], 1)] * 40
    rows += [((np.array(rows[5][0]) * 1.7).tolist(), 2), ([0.0] * 16, 1), ([float("nan")] + [1.0] * 15, 1), ([float("inf")] * 16, 1)]
    rows += [([None] + [1.0] * 15, 1), (None, 1), (rows[0][0], None), ([], 1), ([1.0, 2.0], 1), ([2.0, 4.0], 1)]
    rows = [(i, vector, label, "extra") for i, (vector, label) in enumerate(rows)] + [(None, rows[0][0], 1, "extra")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, kept string").repartition(3)
    got = multi_index.near_vectors(df).collect()
    want = _near_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) or r.vec_id is None for r in got)


def test_near_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 7)
    test_near_vectors(spark)


def test_near_vectors_recall_of_the_given_table(spark, root):
    df = spark.read.parquet(f"{root}/embeddings.parquet")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in multi_index.near_vectors(df, 0.5).collect())
    want = _near_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()], 0.5)
    reached = sum(min(n, got[key]) for key, n in want.items())
    assert reached >= 0.9 * sum(want.values())


def test_traversal_is_in_order_and_complete():
    random = np.random.default_rng(0)
    index = multi_index.Index([np.zeros((6, 2)), np.zeros((6, 2))], 1.0)
    a, b = np.sort(random.random(6)), np.sort(random.random(6))
    met = list(index.traverse(a, b))
    sums = [a[i] + b[j] for i, j in met]
    assert sums == sorted(sums) and len(met) == int(((a[:, None] + b[None, :]) <= 1.0).sum())


def test_empty_vectors(spark):
    assert multi_index.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_components_of_links_in_two_parts(spark):
    dice = random.Random(5)
    edges = [tuple(dice.sample(range(60), 2)) for _ in range(45)]
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    pairs = lambda df: sorted((r.node, r.component) for r in df.collect())
    known = components(frame(edges[:25]))
    assert pairs(joined_by(known, frame(edges[25:]))) == pairs(components(frame(edges)))
    assert pairs(joined_by(known, frame(edges[:25]))) == pairs(known)
    assert pairs(joined_by(components(frame([])), frame(edges[:25]))) == pairs(known)


def test_components(spark):
    random = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(30)]
    edges += [(2000, 2001 + i) for i in range(200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in parent if find(i) != i}


URLS = [
    None, "", "no scheme/org/", "http://", "https://A.Example.ORG/es/1?q=1", "https://example.org/en/12#x", "https://example.org/en/2",
    "http://x.com/fr/", "http://x.com/FR/", "http://com/de/a", "http://notcom/de/a", "http://org", "http://org/", "http://a.org?x=/",
    "http://a.example.net#top", "http://www.spam-farm.example.net/a", "http://spam-farm.example.org/fr/", "http://SPAM-FARM.x.net/\n/b",
    "ftp://h://two/x", "http://é.example.ORG/en/1", "http://adult-x.com/de/", "http://www.spam-farm.example.net/a",
]


def _judged(df, name="op4_url_filter"):
    connection = duckdb.connect()
    connection.register("pages", df.select("page_id", "url").toPandas().astype({"url": object}))
    return Counter(connection.execute(ORACLE_SQL[name]).fetchall())


@pytest.fixture
def url_table(spark, tmp_path):
    rows = [(i, u, "<p>", "extra") for i, u in enumerate(URLS)] + [(4, URLS[4], "<p>", "extra")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("max_words", [1 << 20, 0])
def test_urls(spark, root, url_table, monkeypatch, max_words):
    """Filters and the join beyond their bound judge alike."""
    monkeypatch.setattr(bloom, "MAX_WORDS", max_words)
    for at in (root, url_table):
        got = QUERIES["op4_url_filter"](spark, at)
        connection = duckdb.connect()
        glob = f"{at}/pages.parquet" if at == root else f"{at}/pages.parquet/*.parquet"
        connection.execute(f"CREATE VIEW pages AS SELECT * FROM '{glob}'")
        want = Counter(connection.execute(ORACLE_SQL["op4_url_filter"]).fetchall())
        if at == url_table:  # one row of the table repeats
            want = Counter({(r.page_id, r.host, r.path, r.rule, r.verdict): n for r, n in Counter(got.collect()).items()})
            plain = {row[0]: row for row in connection.execute(ORACLE_SQL["op4_url_filter"]).fetchall()}
            assert all(plain[key[0]] == key for key in want) and want.total() == len(URLS) + 1
        assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == want


def test_cascade_is_exact(spark):
    keys = spark.range(5000).selectExpr("concat('host', id, '.net') AS key", "id % 7 = 0 AS listed").cache()
    filters = url_filter.cascade(keys)
    assert len(filters) > 2
    from pyspark.sql import functions as F

    assert keys.filter(url_filter.listed_by(filters, F.col("key")) != F.col("listed")).count() == 0
    assert url_filter.cascade(keys.filter("NOT listed")) == []
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), spark.createDataFrame([], "host string")).count() == 0


def _fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def test_quality(spark):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rows = quality.quality_scores(docs, quality.fit(docs, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (_fold(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert np.mean([a for a, b in held if b == 1]) > 0.97


def test_dual_coordinate_descent_separates():
    random = np.random.default_rng(0)
    rows = [(i % 2, np.unique(np.append(random.integers(10, 300, 20), i % 2))) for i in range(200)]
    scale = quality.log_count_ratios(rows)
    weights, bias = quality.dual_coordinate_descent(rows, scale, 1.0, 20)
    assert all((weights[places].sum() + bias > 0) == bool(label) for label, places in rows)


def _odd_docs(spark):
    texts = [None, "", "!!! 123", "x" * 5000, "word " * 2000, "ordinary words in a row", "ordinary words in a row"]
    rows = [(i, t, "en", "s", len(t or ""), 0.1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[5], (None, "words", None, None, None, None)], DOCS).repartition(3)


def test_quality_of_odd_tables(spark):
    docs = _odd_docs(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7)] + [(3, None, 0), (99, 1, 0), (None, 1, 0), (4, 5, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.quality_scores(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, quality.fit(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert quality.quality_scores(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_languages(spark):
    docs, pieces = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path("piece_bpe_32k.model")
    rows = language.languages(docs, pieces, *language.fit(docs, pieces)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (_fold(r.doc_id, 4) == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.97


def test_forward_sums_all_segmentations():
    made = language.pieces(path("piece_bpe_32k.model"))
    random = np.random.default_rng(0)
    chances = random.random((made.size, 2)) / 50
    chances[made.none] = 0

    def plain(word):
        total = [np.ones(2)]
        for j in range(1, len(word) + 1):
            total.append(sum(total[i] * chances[made.ids.get(word[i:j], made.unknown if j - i == 1 else made.none)] for i in range(j)))
        return np.log(total[-1])

    words = ["the", "a", "élan", "international", "數字", "of"]
    got = language.log_chances(words, made, chances)
    assert np.allclose(got, [plain(language.START + w) for w in words])
    long = language.log_chances(["ab" * 4000], made, chances)
    assert np.isfinite(long).all()


def _expected_plain(words, langs, weights, made, chances):
    """Expected piece counts by listing every segmentation."""

    def ways(word):
        if not word:
            yield []
        for j in range(1, len(word) + 1):
            piece = made.ids.get(word[:j], made.unknown if j == 1 else made.none)
            if piece != made.none:
                yield from ([piece, *rest] for rest in ways(word[j:]))

    want = Counter()
    for word, lang, weight in zip(words, langs, weights):
        found = [(way, math.prod(chances[piece, lang] for piece in way)) for way in ways(language.START + word)]
        for way, chance in found:
            for piece in way:
                want[piece * chances.shape[1] + lang] += weight * chance / sum(c for _, c in found)
    return want


def test_expected_counts_are_those_of_all_segmentations():
    made = language.pieces(path("piece_bpe_32k.model"))
    random = np.random.default_rng(2)
    chances = random.random((made.size, 3)) / 50
    chances[made.none] = 0
    words, langs, weights = ["the", "a", "élan", "station", "數字", "the"], np.array([0, 1, 2, 1, 0, 2]), np.array([3.0, 1, 2, 5, 1, 7])
    got = Counter()
    for key, total in zip(*language.expected(words, langs, weights, made, chances)):
        got[int(key)] += int(total) * language._STEP
    want = _expected_plain(words, langs, weights, made, chances)
    assert got.keys() <= want.keys() and all(abs(got[key] - n) < 1e-5 for key, n in want.items())


def test_long_runs_are_learned_from(spark):
    """As in text written without blanks: each segmentation of a run covers all its letters."""
    made = language.pieces(path("piece_bpe_32k.model"))
    random = np.random.default_rng(3)
    chances = random.random((made.size, 2)) / 50
    chances[made.none] = 0
    sizes = {i: len(piece) for piece, i in made.ids.items()} | {made.unknown: 1}
    short, langs = ["station", "數字"], np.array([1, 0])
    for words in (short, ["station" * 5, "數字" * 20], ["station" * 400, "數字" * 1500]):
        keys, totals = language.expected(words, langs, np.array([3.0, 2.0]), made, chances)
        for lang, weight in ((0, 2), (1, 3)):
            letters = sum(int(n) * language._STEP * sizes[int(key) // 2] for key, n in zip(keys, totals) if key % 2 == lang)
            assert abs(letters - weight * (len(words[langs.tolist().index(lang)]) + 1)) < 1e-2
    runs = {"aa": "thestationofthelastlineintown", "bb": "數字文本語言模型"}
    rows = [(i, runs[lang] * (2 + i % 40), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    docs, pieces = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), path("piece_bpe_32k.model")
    langs, learned = language.fit(docs, pieces)
    assert langs == ["aa", "bb"] and all(len(set(learned[:, i])) > 3 for i in range(2))
    assert all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in language.languages(docs, pieces, langs, learned).collect())


def test_languages_with_rare_words_are_learned_beside_large_ones(spark):
    """More frequent words of one language take nothing from another, whatever their number and names."""
    letters = "abcdefghijklmnopqrst"
    word = lambda n: "".join(letters[n // 20**k % 20] for k in range(5))
    rows = [(i, " ".join(word(600 * i + k) for k in range(600)) + "\n", "aa") for i in range(560)]
    rows = [(i, 2 * text, lang) for i, text, lang in rows] + [(1000 + i, f"żółw{letters[i]} gęś{letters[i]}", "zz") for i in range(20)]
    docs, pieces = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4), path("piece_bpe_32k.model")
    langs, chances = language.fit(docs, pieces)
    assert langs == ["aa", "zz"] and chances.shape[1] == 2
    pred = language.languages(docs.filter("doc_id >= 1000 OR doc_id < 20"), pieces, langs, chances).collect()
    assert all(r.lang_pred == ("zz" if r.doc_id >= 1000 else "aa") for r in pred)
    again = language.fit(docs.repartition(7), pieces)[1]
    assert (again == chances).all()


def test_languages_of_odd_tables(spark):
    docs, pieces = _odd_docs(spark), path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in language.languages(docs, pieces, *language.fit(docs, pieces)).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0 and rows[5].lang_pred == "en"
    none = docs.limit(0)
    assert language.languages(none, pieces, *language.fit(none, pieces)).count() == 0
    unlabelled = docs.withColumn("lang", docs["source"].substr(9, 1)).filter("lang IS NULL")
    assert {r.lang_pred for r in language.languages(docs, pieces, *language.fit(unlabelled, pieces)).collect()} == {"und"}


def test_pipeline_stages(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    before = docs
    from rankloom.llm import minhash, secret_scan, suffixes
    from rankloom.session import cut_lineage

    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, before, root))
        assert after.schema == before.schema, name
        if name == "quality classifier":
            labels = spark.read.parquet(f"{root}/labels.parquet")
            scores = quality.quality_scores(before, quality.fit(before, labels)).filter("predicted = 1")
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.collect()}
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash.near_duplicates(before).filter("kept").collect()}
        elif name == "suffix-array dedup":
            spans = {r.doc_id: r.spans for r in suffixes.repeat_report(before).collect()}
            raw = {r.doc_id: r.text.encode() for r in before.collect()}
            for r in after.collect():
                assert r.n_chars == len(r.text)
                assert len(raw[r.doc_id]) - len(r.text.encode()) - sum(e - b for b, e in spans[r.doc_id]) in range(0, 8 * len(spans[r.doc_id]) + 1)
        else:
            assert all(not secret_scan.base_spans(r.text) for r in after.collect())
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, root).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before.collect()}
    whole = corpus_pipeline.run(spark, root).collect()
    key = lambda r: (r.doc_id, r.doc_tokens, hashlib.md5(str(r.ids).encode()).hexdigest() if r.length == r.doc_tokens else "")
    assert Counter(map(key, whole)).keys() >= {key(r) for r in pieces if r.length == 1}
    assert {(r.doc_id, r.doc_tokens) for r in whole} == {(r.doc_id, r.doc_tokens) for r in pieces}


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs = _odd_docs(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Equal documents became one; the null id is left alone.
    assert sorted({r.doc_id for r in rows}, key=repr) == sorted([None, 0, 1, 2, 3, 4, 5], key=repr)
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
