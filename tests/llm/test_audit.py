"""Sanitising, source divergence and alignment against plain versions on small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from public_tokenizers import path
from pyspark.sql import functions as F

from rankloom.llm import alignment, catalog, divergence, sanitise

SCHEMA = "doc_id bigint, text string, lang string, source string, key_id string, start string, term string, row string"
PATHS = (path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def frame(spark, rows):
    """``(doc_id, text, lang, source)`` with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*row, "x", "y", "z", "w") for row in rows], SCHEMA)


# --- sanitising ----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(value):
    return re.sub("[^0-9]", "", value)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


VALID = [
    ("email", EMAIL, lambda v: True),
    ("ip", IP, lambda v: all(int(part) <= 255 for part in v.split("."))),
    ("card", CARD, lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", PHONE, lambda v: 9 <= len(digits(v)) <= 15),
]


def plain_base(text):
    return [(kind, m.start(), m.end(), m.group()) for kind, pattern, valid in VALID for m in pattern.finditer(text) if valid(m.group())]


def plain_near(text, kind, pattern, valid):
    """(entity, words around) of each valid match, the texts reaching to the pattern's next match."""
    found, ends = list(pattern.finditer(text)), [0]
    ends += [m.end() for m in found]
    begins = [m.start() for m in found] + [len(text)]
    for i, m in enumerate(found):
        if valid(m.group()):
            before, behind = text[ends[i] : m.start()], text[m.end() : begins[i + 1]]
            left, right = before[-sanitise.CONTEXT :], behind[: sanitise.CONTEXT]
            if len(before) > sanitise.CONTEXT:
                left = regex.sub(r"^[\p{L}\p{M}]+", "", left)
            if len(behind) > sanitise.CONTEXT:
                right = regex.sub(r"[\p{L}\p{M}]+$", "", right)
            value = m.group().lower() if kind in ("email", "ip") else digits(m.group())
            words = [w.lower() for w in regex.findall(r"[\p{L}\p{M}]+", left) + regex.findall(r"[\p{L}\p{M}]+", right)]
            yield f"{kind}:{value}", tuple(dict.fromkeys(words))


def plain_telling(texts):
    both, around, of_entity, of_word = Counter(), defaultdict(set), Counter(), Counter()
    for text in texts:
        near = defaultdict(dict)
        entities = set()
        for kind, pattern, valid in VALID:
            for entity, words in plain_near(text, kind, pattern, valid):
                entities.add(entity)
                for word in words:
                    near[entity, word].setdefault(words, None)
        of_entity.update(entities)
        both.update(near.keys())
        for pair, sets in near.items():
            # One surrounding is counted for a document; the fixture has one for each entity.
            around[pair].add(next(iter(sets)))
        of_word.update({w.lower() for w in regex.findall(r"[\p{L}\p{M}]+", text)})
    out = {}
    for (entity, word), n in both.items():
        if len(around[entity, word]) < sanitise.SUPPORT:
            continue
        removed = n == of_word[word]
        told = math.log2(n * len(texts) / (of_word[word] * of_entity[entity]))
        if removed or told >= math.log2(len(texts) / of_entity[entity]) / sanitise.ALPHA:
            if out.get(word) != "remove":
                out[word] = "remove" if removed else "generalise"
    return out


def plain_spans(text, telling):
    base = plain_base(text)
    added = []
    for m in regex.finditer(r"[\p{L}\p{M}]+", text):
        if m.group().lower() in telling and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            added.append(("term", m.start(), m.end(), m.group()))
    return base, added


FILL = "common words of no weight stand here and there in a row of many such words that all documents share "
PERSON = [
    f"{FILL}alpha{i} the Zephyrine quarry keeper writes from ada.l@mail.example.com about {chr(97 + i)}stone to us. {FILL}" for i in range(6)
]
PRIVATE = [
    None, "", " ", "a@b.c.@d.e", "a@b.c_d@e.f @ x@y a.b@c", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.2.3 1..2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1111x 41111111111111112 0000000000000",
    "+1 (234) 567-8900. ++12 345 6789 0 +123456789 +1-- 2 ", "ß@x.y 𝔘 z@q.w é+49 1234 56789é", "9" * 5000, "a.b-c_d%" * 2000, "x@" * 2000 + "y.z",
    "1.2.3.4 " * 500 + "a@b.cc " * 300, "+" * 3000 + "1 " * 30, "1.2.3." * 999,
    *PERSON, PERSON[0], "the ZEPHYRINE is not named, Zephyrine@x.org is", "quarry and keeper", "Zephyrine " * 30,
    *[f"{FILL}{i} {FILL}" for i in range(300)],
]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans).encode()).hexdigest()


def test_spans_equal_patterns_and_statistics(spark):
    rows = [(i, text, "en", "s") for i, text in enumerate(PRIVATE)] + [(None, PERSON[1], "en", "s")] * 2
    docs = frame(spark, rows)
    spans = sanitise.private_spans(docs)
    telling = plain_telling([row[1] or "" for row in rows])
    assert telling["zephyrine"] == "generalise" and telling["writes"] == "remove"
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"]) for r in sanitise.digests(spans).collect()))
    want = []
    for at, text, *_ in rows:
        base, added = plain_spans(text or "", telling)
        counts = Counter(kind for kind, *_ in base)
        want.append((at is None, at or 0, digest(base), *(counts[k] for k in sanitise.KINDS), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base + added)))
    assert got == sorted(want)
    assert any("term" in row[-1] and not row[3] for row in got)


def test_sanitised_texts(spark):
    docs = frame(spark, [(i, text, "en", "s") for i, text in enumerate(PRIVATE)])
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitised(docs, sanitise.private_spans(docs)).collect()}
    telling = plain_telling([text or "" for text in PRIVATE])
    assert len(texts) == len(PRIVATE) and texts[0] is None and texts[1] == ""
    for at, text in enumerate(PRIVATE):
        if text:
            base, added = plain_spans(text, telling)
            marks = [(a, b, sanitise.MARKS[k]) for k, a, b, _ in base] + [(a, b, sanitise.MARKS[telling[w.lower()]]) for _, a, b, w in added]
            out, last = "", 0
            for a, b, mark in sorted(marks):
                out += text[last:a] + (mark if last <= a else "")
                last = max(last, b)
            assert texts[at] == out + text[last:]


def test_sums_of_many_lengths(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 1000)], "x array<int>")
    for row in df.select("x", sanitise._sums_before(F.col("x")).alias("sums")).collect():
        assert row["sums"] == [sum(row["x"][:i]) for i in range(len(row["x"]))]


def test_given_table_base_spans(spark, root):
    docs = spark.read.parquet(f"{root}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = catalog.op11_sanitise(spark, root).collect()
    assert len(got) == len(texts)
    assert all(r["base_sha256"] == digest(plain_base(texts[r["doc_id"]])) for r in got)


# --- divergence ----------------------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    df = Counter((lang, t) for lang, _, words in docs for t in set(words))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= min_docs:
            kept[lang].append(t)
    groups, langs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        own = Counter(t for t in words if df[lang, t] >= min_docs)
        groups[lang, source] += own
        langs[lang] += own

    def share(counts, lang):
        v, total = len(kept[lang]), sum(counts.values())
        return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * v) for t in kept[lang]}

    out = []
    for (lang, source), counts in groups.items():
        p, q = share(counts, lang), share(langs[lang], lang)
        pairs = []
        for (other_lang, other), theirs in groups.items():
            if other_lang == lang and other != source:
                r = share(theirs, lang)
                pairs.append((-sum(abs(p[t] - r[t]) for t in kept[lang]), other.encode()))
        terms = [(q[t] - p[t], t.encode()) for t in kept[lang] if counts[t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def audit_rows():
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)] + ["É", "é", "ÀB", "数字"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60))) + "/X1y", rng.choice(["en", "de"]), f"s{rng.integers(0, 9) if i % 3 else 0}") for i in range(300)]
    rows += [(300, None, None, None), (301, "alone here", "fr", "s1"), (302, "", "fr", "s2"), (303, "Waa " * 5000, "en", "long"), (304, "waa", "de", None)]
    return rows + rows[:20]


@pytest.mark.parametrize("limits", [{}, {"shard_keys": 7, "wave_bytes": 400, "slot_block": 16, "source_block": 2}])
def test_divergence_equals_plain_counts(spark, rows, limits, monkeypatch):
    data = audit_rows()
    got = rows(divergence.source_divergence(frame(spark, data), min_docs=8, top=5, **limits))
    assert sorted(got) == plain_divergence(data, 8, 5)


def test_divergence_flushes_what_it_holds(spark, monkeypatch):
    data = audit_rows()
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    monkeypatch.setattr(divergence, "HELD_SLOTS", 10)
    docs = divergence.grouped_texts(frame(spark, data))
    kept = divergence.kept_terms(docs, 8)
    counts = divergence.group_counts(docs, divergence.hash_shards(kept, 50))
    assert counts.filter("lang = 'en' AND source = 'long'").agg(F.sum("n")).first()[0] == 5000


def test_perfect_hashes_are_minimal():
    for n in (1, 2, 3, 7, 500, 5000):
        keys = [f"key {i}".encode() for i in range(n)]
        seeds = divergence.perfect_hash(keys)
        assert sorted(divergence.slots_of(*divergence.key_hashes(keys), n, seeds).tolist()) == list(range(n))


def test_shares_do_not_overflow():
    counts, whole = [0, 1, 10**13, 8 * 10**14], 10**15
    want = [1 + 10**9 * (c + 5) // whole for c in counts]
    assert divergence.exact_shares(np.array(counts), np.array(whole)).tolist() == want


def test_divergence_of_no_documents(spark):
    assert divergence.source_divergence(frame(spark, [])).collect() == []


def test_divergence_without_kept_terms(spark, rows):
    data = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", "z")]
    assert sorted(rows(divergence.source_divergence(frame(spark, data)))) == plain_divergence(data, 30, 50)


def test_divergence_equals_its_statement(spark, root):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    want = duck.execute(catalog.ORACLE_SQL["op12_divergence"]).fetchall()
    assert sorted(map(tuple, catalog.op12_divergence(spark, root).collect())) == sorted(want)


# --- alignment -----------------------------------------------------------------------

ALIGNED = [
    None, "", " ", "a", "  x\n\n y", "<unk> <s> <|endoftext|> <0x41>", "▁x", "日本語 ​ ế 𝔘 ÀÉ", "x" * 700, "\x00\x01", "plain words, once and again; plain words.",
    "plain words, once and again; plain words.", "antidisestablishmentarianism " * 300,
]


def plain_alignment(texts):
    both = alignment.aligner(*PATHS)
    rows, held = [], Counter()
    for text in texts:
        a, b = (side.encode([text])[0] if text else [] for side in (both.a, both.b))
        whole = b" " + (text or "").encode()
        if not text or any(b"".join(side.bytes_of[i] for i in ids) != whole for side, ids in ((both.a, a), (both.b, b))):
            rows.append((0, 0, [], Counter()))
            continue
        places = []
        for side, ids in ((both.a, a), (both.b, b)):
            ends = np.cumsum([len(side.bytes_of[i]) for i in ids]).tolist()
            places.append(list(zip(ids, [0, *ends], ends)))
        links = Counter((i, j) for i, u, v in places[0] for j, x, y in places[1] if x < v and u < y)
        cuts = sorted({v for _, _, v in places[0]} & {v for _, _, v in places[1]})
        groups = [tuple([i for i, u, v in place if low <= u and v <= high] for place in places) for low, high in zip([0, *cuts], cuts)]
        rows.append((len(a), len(b), groups, links))
        held.update(links.keys())
    best = Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    out = []
    for n_a, n_b, groups, links in rows:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        sha = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        n_best = sum(m for pair, m in links.items() if held[pair] == best[pair[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), n_best, sum(m * held[pair] for pair, m in links.items()), sha))
    return out, [groups for _, _, groups, _ in rows]


@pytest.mark.parametrize("wave", [1_000_000, 40])
def test_alignment_equals_plain_overlaps(spark, root, wave):
    texts = ALIGNED + [t for t in pq.read_table(f"{root}/documents.parquet").column("text").to_pylist() if t and len(t) < 900][:30]
    docs = frame(spark, [(i, text, "en", "s") for i, text in enumerate(texts)] + [(None, "a", "en", "s")]).repartition(3)
    want, _ = plain_alignment([*texts, "a"])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, *r[1:]) for r in alignment.alignment_report(docs, *PATHS, wave_pairs=wave).collect())
    assert got == [(i == len(texts), i % len(texts), *row) for i, row in enumerate(want)]


def test_both_libraries_of_a_agree():
    side = alignment.aligner(*PATHS).a
    signs = [" ", "  ", "\n", "'s", "a", "É", "9", "½", "-", "\u0300", "xyz" * 9, "€", "\U0001f600", "数", "\xa0", "\u3000", "\u200b"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(signs, rng.integers(1, 60))) for _ in range(2000)] + ["<|endoftext|>", "a" * 50_000]
    assert side.encode(texts) == [side._slow(text) for text in texts]
    blanks = "x" + " " * 1_200_000 + "y"
    assert len(side.encode([blanks])[0]) > 1_000_000


def test_aligned_groups(spark):
    docs = frame(spark, [(i, text, "en", "s") for i, text in enumerate(ALIGNED)])
    _, want = plain_alignment(ALIGNED)
    got = {r["doc_id"]: [(list(g["a"]), list(g["b"])) for g in r["groups"]] for r in alignment.aligned_groups(docs, *PATHS).collect()}
    assert [got[i] for i in range(len(ALIGNED))] == want


def test_alignment_holds_bounded_counts(spark, monkeypatch):
    docs = frame(spark, [(i, text, "en", "s") for i, text in enumerate(ALIGNED)])
    want = sorted(map(tuple, alignment.alignment_report(docs, *PATHS).collect()), key=repr)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 5)
    monkeypatch.setattr(alignment, "TEXT_BYTES", 10)
    monkeypatch.setattr(alignment, "PAIR_BYTES", 10)
    assert sorted(map(tuple, alignment.alignment_report(docs, *PATHS).collect()), key=repr) == want


def test_empty_tables(spark):
    none = frame(spark, [])
    assert alignment.alignment_report(none, *PATHS).collect() == []
    assert sanitise.digests(sanitise.private_spans(none)).collect() == []
