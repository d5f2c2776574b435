"""Cases that the operators' contracts and docstrings name, and plain versions of what SQL cannot say."""

import itertools
import math
import time

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

import corpus_pipeline
from rankloom.llm import bpe, common, language, minhash, multi_index, quality, secret_scan, suffixes


# --- vectors -------------------------------------------------------------------------


def links_of(spark, rows, kind="double", label="int", threshold=0.98):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label {label}")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in multi_index.near_vectors(df, threshold).collect())


def test_vectors_of_one_component_are_compared_by_sign(spark):
    rows = [(1, [1.0], 1), (2, [2.0], 1), (3, [-4.0], 1), (4, [1.0, 0.0], 1), (5, [0.0], 1), (6, [-0.5], 1)]
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 3, False)]
    assert links_of(spark, rows) == want
    assert links_of(spark, rows, "float") == want


def test_components_of_doubles_stay_doubles(spark):
    rows = [(1, [1e300, 1e300], 1), (2, [2e300, 2e300], 1), (3, [1e-300, 1e-300], 1), (4, [1e300, -1e300], 1), (5, [float("inf"), 1.0], 1)]
    assert links_of(spark, rows) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    assert links_of(spark, rows, label="string") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_an_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.001], 1), (3, [0.001, 1.0], 1), (3, [0.0, 3.0], 1)]
    got = links_of(spark, rows)
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]


def test_links_at_the_registered_threshold(spark):
    """Planted pairs just above 0.98, some moved in one half only."""
    random = np.random.default_rng(7)
    rows = []
    for i in range(1500):
        x = random.standard_normal(32)
        x /= np.linalg.norm(x)
        aside = random.standard_normal(32)
        if i % 3 == 0:
            aside[16:] = 0
        aside -= (aside @ x) * x
        aside /= np.linalg.norm(aside)
        cosine = 0.9801 + 0.004 * random.random()
        rows += [(2 * i, x.tolist(), i % 5), (2 * i + 1, (cosine * x + math.sqrt(1 - cosine**2) * aside).tolist(), i % 5)]
    made = np.array([r[1] for r in rows])
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    near = (made @ made.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = links_of(spark, rows)
    assert all(n <= want for (_, n, _, _), want in zip(got, near.sum(axis=1).tolist()))
    assert sum(n for _, n, _, _ in got) >= 0.999 * near.sum() > 0


# --- language ------------------------------------------------------------------------


def test_words_are_letters_with_their_marks():
    assert language.words_of("½ ² ① 12_3 Ⅷ") == []
    assert language.words_of("हिन्दी Éte été") == ["हिन्दी", "éte", "été"]


def test_texts_without_letters_have_no_language(spark):
    docs = spark.createDataFrame([(i, "wort und satz" if i % 2 else "word and clause", "de" if i % 2 else "en") for i in range(40)] + [(90, "½ ² ①", None), (91, None, None), (92, "ⅷ 5", "en")], "doc_id bigint, text string, lang string")
    file = path("piece_bpe_32k.model")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs, file, *language.fit(docs, file)).collect()}
    assert [got[i] for i in (90, 91, 92)] == [("und", 0.0)] * 3
    assert got[1][0] == "de" and got[2][0] == "en"


def test_a_text_is_scored_by_all_its_segmentations():
    made = language.pieces(path("piece_bpe_32k.model"))
    random = np.random.default_rng(2)
    chances = random.random((made.size, 2))
    chances[made.none] = 0
    chances /= chances.sum(axis=0)
    for word in ("cat", "ünde", "xqzk", "हि"):
        marked = language.START + word
        total = np.zeros(2)
        for cuts in itertools.product((0, 1), repeat=len(marked) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            parts = [marked[a:b] for a, b in zip(edges, edges[1:])]
            ids = [made.ids.get(p, made.unknown if len(p) == 1 else made.none) for p in parts]
            total += np.prod(chances[ids], axis=0)
        assert np.allclose(language.log_chances([word], made, chances)[0], np.log(total))


# --- quality -------------------------------------------------------------------------


def test_descent_solves_the_dual_problem():
    """Against projected gradient steps on the whole dual, without shrinking or order."""
    random = np.random.default_rng(4)
    rows = [(int(random.random() < 0.4), np.unique(random.integers(0, 40, 12)).astype(np.int32)) for _ in range(60)]
    scale = np.zeros(quality.PLACES)
    scale[:40] = quality.log_count_ratios(rows)[:40]
    weights, bias = quality.dual_coordinate_descent(rows, scale, 0.5, 400)
    x = np.zeros((60, 41))
    for i, (_, places) in enumerate(rows):
        x[i, places] = scale[places]
    x[:, 40] = 1.0
    y = np.array([1.0 if label else -1.0 for label, _ in rows])
    share = (y > 0).mean()
    bounds = np.where(y > 0, 0.5 / (2 * share), 0.5 / (2 * (1 - share)))
    alphas, kernel = np.zeros(60), (x * y[:, None]) @ (x * y[:, None]).T
    step = 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(200_000):
        alphas = np.clip(alphas - step * (kernel @ alphas - 1), 0, bounds)
    want = (alphas * y) @ x
    assert np.allclose(weights[:40], want[:40] * scale[:40], atol=1e-3)
    assert abs(bias - want[40]) < 1e-2


def test_a_repeated_id_is_learned_from_once(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(70)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id bigint, quality int")
    held = quality.held_out(F.col("doc_id"))
    assert len(quality.labelled_sample(docs, labels, 100)) == labels.filter(~held).count()


def test_long_shapes_stay_apart():
    assert quality.shape("a1" * 10) != quality.shape("a1" * 11)


# --- secrets -------------------------------------------------------------------------


def test_added_spans_keep_clear_of_base_spans():
    random = np.random.default_rng(6)
    alphabet = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    model = np.full((secret_scan._ENDS + 1, secret_scan._ENDS + 1), 9.0)
    for _ in range(50):
        parts = []
        for _ in range(random.integers(1, 12)):
            value = "".join(random.choice(alphabet, random.integers(8, 50)))
            parts.append(random.choice([f"token={value}", value, f"AKIA{value.upper()}", "plain words", "0123456789abcdef" * 3]))
        text = " ".join(parts)
        base = secret_scan.base_spans(text)
        every = secret_scan.random_spans(text, model, [])
        want = [s for s in every if not any(s[1] < e and b < s[2] for _, b, e in base)]
        assert secret_scan.random_spans(text, model, base) == want


def test_scanning_is_linear_in_a_text():
    model = np.zeros((secret_scan._ENDS + 1, secret_scan._ENDS + 1))

    def seconds(n):
        text = "token=0123456789abcdef0123 someotherlongordinaryword " * n
        start = time.process_time()
        secret_scan.scan(text, model)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 24 * max(seconds(2_000), 0.02)


# --- bpe -----------------------------------------------------------------------------


def test_ids_outside_the_vocabulary_decode_to_nothing(spark):
    rows = [(1, [31373, None, 995, -1, 10**6]), (2, None), (3, [])]
    got = bpe.bpe_decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), path("byte_bpe_50k.json")).collect()
    assert [r.text for r in sorted(got)] == ["hello world", "", ""]


# --- stages --------------------------------------------------------------------------

ODD_NAMES = ["key_id", "key_text", "_marks", "marks", "own", "_key_id", "_key_text", "_at", "row", "count", "anchor", "rep"]


@pytest.mark.parametrize("name", ["one_of_each", "no_repeats", "no_secrets"])
def test_stages_keep_columns_of_any_name(spark, root, name):
    passage = "a passage that several documents share word for word, " * 6
    texts = [None, "", passage + "one", "two " + passage, "token = \"0123456789abcdef0123456789abcdef01234567\"", passage + "one", "few words", "few words"]
    rows = [(i % 6, text, f"en{i}", 3, *[str(i)] * len(ODD_NAMES)) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in ODD_NAMES))
    out = getattr(corpus_pipeline, name)(spark, docs, root)
    assert out.columns == docs.columns
    # Texts and ids link rows 0, 1, 6 and 7, and rows 2, 3 and 5.
    assert out.count() == (3 if name == "one_of_each" else len(rows))


def test_repeats_with_few_suffixes_to_a_group(spark, monkeypatch):
    """Crowded anchors: edges of a shared passage, and texts that repeat themselves."""
    random = np.random.default_rng(8)
    passage = "".join(random.choice(list("abcdefgh "), 320))
    texts = ["".join(random.choice(list("xyz "), random.integers(0, 260))) + passage + "".join(random.choice(list("xyz "), random.integers(0, 260))) for _ in range(30)]
    texts += ["ab" * 300, "abc" * 250, "a" * 700, passage[:199], passage[:200], passage[100:] + passage[:250], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    raws = [t.encode() for t in texts]
    times = {}
    for raw in raws:
        for p in range(len(raw) - 199):
            times[raw[p : p + 200]] = times.get(raw[p : p + 200], 0) + 1
    want = []
    for raw in raws:
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - 199):
            if times[raw[p : p + 200]] > 1:
                covered[p : p + 200] = True
        want.append(int(covered.sum()))
    for most in (256, 3, 1, 0):
        monkeypatch.setattr(suffixes, "GROUP_RUNS", most)
        got = {r.doc_id: r.n_removed for r in suffixes.repeat_report(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


# --- workers -------------------------------------------------------------------------


def test_a_worker_keeps_one_operators_caches():
    made = minhash.shingler(5)
    assert minhash.shingler(5) is made
    quality.indicators()
    assert len(common._KEPT) == 1 and minhash.shingler(5) is not made


# --- packing -------------------------------------------------------------------------


def test_words_equal_the_library():
    """Plain texts are encoded as a whole, others by their parts: both as the library does."""
    from rankloom.llm import packing

    words = packing.Words(path("word_bpe_49k.json"))
    plain = ["a", "b", " ", "  ", "\n", "\t", "\r", ".", ",", "..!", "5", "12", "Ä", "ø", "į", "«", "¿", "|", "{", "~", "&", "_", "Zq", "é", "-", '"', "@", "#", "x" * 30]
    odd = ["'s", "don't", "½", "²", "ª", "µ", "×", "̀", "€", "\U0001f600", "数", "\xa0", "İ", "Σ", "\x00", "\x1c", "ŉ", "<|", "ı", "\x7f", "\x0b"]
    random = np.random.default_rng(9)
    rows = ["".join(random.choice(plain, random.integers(0, 40))) for _ in range(3000)]
    rows += ["".join(random.choice(plain + odd, random.integers(0, 40))) for _ in range(3000)] + ["", "a" * 3000, "<|endoftext|> a"]
    assert all(packing._NOT_PLAIN.search(row) is None for row in rows[:3000])
    want = [np.array(words.tokenizer.encode(row, add_special_tokens=False).ids, "<u4").tobytes() + packing._END for row in rows]
    assert words.encode(rows) == want


def test_cached_words_have_two_generations(monkeypatch):
    from rankloom.llm import packing

    monkeypatch.setattr(packing, "_CACHE", 20)
    words = packing.Words(path("word_bpe_49k.json"))
    rows = [" ".join(f"it's{i % 7} wörd{i % 31}€ {i}" for i in range(k, k + 9)) for k in range(0, 300, 5)]
    for row in rows:
        assert words.encode([row]) == [np.array(words.tokenizer.encode(row, add_special_tokens=False).ids, "<u4").tobytes() + packing._END]
    assert len(words.known) <= 20 + 27 and words.older
