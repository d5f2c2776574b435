import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import beam, prefix
from rankloom.session import cut_lineage, recorded_steps

SEQS = "corpus_id string, tokens array<int>"
PROBES = "probe_id string, tokens array<int>"
SMALL = [("a", [5, 6]), ("b", [5, 6, 7]), ("c", [5, 8]), ("d", [5, 8])]


def allowed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["probe_id"], set())
        if r["token"] is not None:
            out[r["probe_id"]].add(r["token"])
    return out


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(SMALL, SEQS)


@pytest.fixture(scope="module")
def probes(spark):
    return spark.createDataFrame([("root", []), ("5", [5]), ("56", [5, 6]), ("58", [5, 8]), ("567", [5, 6, 7]), ("9", [9])], PROBES)


def test_next_tokens_and_policies(small, probes):
    found = prefix.next_tokens(prefix.build_prefix_index(small), probes)
    assert allowed(found) == {"root": {5}, "5": {6, 8}, "56": {7, -1}, "58": {-1}, "567": {-1}, "9": set()}
    passed = allowed(prefix.next_tokens_policy(found, "pass"))
    assert passed == {"root": {5}, "5": {6, 8}, "56": {7, -1}, "58": set(), "567": set(), "9": set()}
    stopped = allowed(prefix.next_tokens_policy(found, "stop"))
    assert stopped == {"root": {5}, "5": {6, 8}, "56": {0}, "58": {0}, "567": {0}, "9": set()}


def test_shared_shadowed_and_lengths(small, rows):
    assert rows(prefix.shared_sequences(small)) == [("c", 2)]
    assert rows(prefix.shadowed_documents(small)) == [("b",)]
    assert rows(prefix.index_length(small)) == [(4, 4)]
    assert rows(prefix.index_length(small.union(small))) == [(8, 4)]
    assert rows(prefix.index_length(small.filter("false"))) == [(0, 0)]
    assert prefix.enumerate_sequences(small.union(small)).count() == 4
    prefix.check_shared_start(small)
    with pytest.raises(ValueError):
        prefix.check_shared_start(small.union(small.select(F.lit("x"), F.array(F.lit(9)))))


def test_sequence_documents(spark, small, rows):
    outputs = spark.createDataFrame([("q", [5, 8]), ("q", [5, 6, 7]), ("q", [5])], "query_id string, tokens array<int>")
    ordered = small.withColumn("ord", F.ascii("corpus_id"))
    every = prefix.sequence_documents(outputs, ordered).select("corpus_id")
    assert rows(every) == [("b",), ("c",), ("d",)]
    first = prefix.sequence_documents(outputs, ordered, "first").select("corpus_id")
    assert rows(first) == [("b",), ("c",)]
    assert rows(prefix.unmatched_sequences(outputs, ordered).select("tokens")) == [([5],)]


def test_adding_equals_rebuilding(spark, small, rows):
    added = spark.createDataFrame([("e", [5, 8]), ("f", [5, 9]), ("g", [5, 9])], SEQS)
    columns = ["depth", "h1", "h2", "prev", "token", "n_seq", "n_paths", "ends"]
    grown = prefix.add_sequences(prefix.build_prefix_index(small), small, added)
    assert rows(grown.select(columns)) == rows(prefix.build_prefix_index(small.union(added)).select(columns))


def _many(seed, n=400):
    dice = random.Random(seed)
    out = []
    for i in range(n):
        body = [dice.choice([3, 4]) if dice.random() < 0.8 else dice.choice([5, -1, 6]) for _ in range(dice.choice([0, 1, 2, 3, 5, 9, 14]))]
        out.append((f"d{i}", [0, *body]))
    return out + [("e", [])]


def _plain_edges(data):
    paths = {}
    for _, tokens in data:
        paths[tuple(tokens)] = paths.get(tuple(tokens), 0) + 1
    edges = {}
    for path, n in paths.items():
        for d in range(len(path) + 1):
            key = (path[:d], path[d] if d < len(path) else -1, d < len(path))
            old = edges.get(key, (0, 0, False))
            edges[key] = (old[0] + n, old[1] + 1, old[2] or d == len(path) - 1)
    return sorted((len(p), p[-1] if p else None, t, *e) for (p, t, _), e in edges.items())


@pytest.mark.parametrize("partitions, batch", [(1, 10_000), (7, 10_000), (7, 3), (40, 1)])
def test_index_of_sorted_neighbours(spark, partitions, batch):
    data = [(i, [t if t >= 0 else 7 for t in tokens]) for i, tokens in _many(partitions)]
    names = ["spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = [spark.conf.get(name) for name in names]
    try:
        for name, value in zip(names, (partitions, batch)):
            spark.conf.set(name, value)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sequences = spark.createDataFrame(data, SEQS)
        got = prefix.build_prefix_index(sequences, shared_start=False).select("depth", "prev", "token", "n_seq", "n_paths", "ends").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(_plain_edges(data), key=repr)
        half = spark.createDataFrame(data[:200], SEQS), spark.createDataFrame(data[150:], SEQS)
        grown = prefix.add_sequences(prefix.build_prefix_index(half[0]), *half).select("depth", "prev", "token", "n_seq", "n_paths", "ends").collect()
        assert sorted(map(tuple, grown), key=repr) == sorted(_plain_edges(data[:200] + data[150:]), key=repr)
        paths = {tuple(t) for _, t in data if t}
        want = sorted((list(p), any(p[:n] in paths for n in range(1, len(p))), any(q != p and q[: len(p)] == p for q in paths)) for p in paths)
        nested = prefix.nested_paths(sequences).collect()
        assert sorted((list(r["tokens"]), r["shadowed"], r["continued"]) for r in nested) == want
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_index_checks_the_first_id(spark, small):
    prefix.build_prefix_index(small, shared_start=True)
    with pytest.raises(ValueError):
        prefix.build_prefix_index(small.union(spark.createDataFrame([("x", [9])], SEQS)), shared_start=True)


def test_adding_beyond_the_bound_equals_rebuilding(spark, small, rows, monkeypatch):
    monkeypatch.setattr(prefix, "fits", lambda df: False)
    test_adding_equals_rebuilding(spark, small, rows)


def test_append_index(spark, small):
    first = prefix.build_prefix_index(small)
    second = prefix.build_prefix_index(spark.createDataFrame([("x", [40, 41]), ("y", [42])], SEQS))
    probes = spark.createDataFrame(
        [("5", [5]), ("5/40", [5, 40]), ("9", [9]), ("40", [40]), ("56", [5, 6]), ("root", [])], PROBES
    )
    got = allowed(prefix.append_index(first, second, 8, probes))
    assert got == {"5": {6, 40, 42}, "5/40": {41}, "9": set(), "40": {41}, "56": {7, -1}, "root": {5}}
    nothing = prefix.build_prefix_index(small.filter("false"))
    assert allowed(prefix.append_index(first, nothing, 8, probes)) == allowed(prefix.next_tokens(first, probes))


@pytest.mark.parametrize("fits", [True, False])
def test_appended_indexes_are_read_once(spark, small, monkeypatch, fits):
    read = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(token):
        read.add(1)
        return token

    first = cut_lineage(prefix.build_prefix_index(small)).withColumn("token", seen("token"))
    second = prefix.build_prefix_index(spark.createDataFrame([("x", [40, 41]), ("y", [42])], SEQS))
    probes = spark.createDataFrame([("5", [5]), ("8", [5, 6]), ("5/40", [5, 40]), ("again", [5])], PROBES)
    monkeypatch.setattr(prefix, "fits", lambda df: fits)
    monkeypatch.setattr(prefix, "_LISTED_ROWS", 1)
    got = allowed(prefix.append_index(first, second, 8, probes))
    assert got == {"5": {6, 40, 42}, "again": {6, 40, 42}, "8": {7, -1}, "5/40": {41}}
    assert read.value == prefix.build_prefix_index(small).count()


@pytest.mark.parametrize("longest", [1, 6, 23])
def test_longest_beginning_by_bisection(spark, longest):
    dice = random.Random(longest)
    body = lambda n: [dice.choice([3, 4]) for _ in range(n)]
    stored = [(f"d{i}", [0, *body(dice.randint(0, longest))]) for i in range(40)]
    asked = [(f"p{i}", [0, *body(dice.randint(0, longest + 9))]) for i in range(60)]
    asked += [("other", [7, 3]), ("root", []), *[(f"copy{i}", asked[0][1]) for i in range(5)]]
    edges = prefix.build_prefix_index(spark.createDataFrame(stored, SEQS))
    got = {r["probe_id"]: r["matched"] for r in prefix._walked(edges, spark.createDataFrame(asked, PROBES)).collect()}
    known = {tuple(s[:n]) for _, s in stored for n in range(len(s) + 1)}
    assert got == {p: max(n for n in range(len(t) + 1) if tuple(t[:n]) in known) for p, t in asked}


def test_index_round_trip(spark, small, tmp_path, rows):
    edges = prefix.build_prefix_index(small)
    path = prefix.index_path(str(tmp_path), "t", 4, "g", False)
    stored = prefix.prefix_index(spark, path, lambda: edges, create=True)
    assert rows(stored.select(sorted(stored.columns))) == rows(edges.select(sorted(edges.columns)))
    again = prefix.prefix_index(spark, path, None, create=False)
    assert again.filter("depth = 1").count() == 2


def _stepwise(sequences, queries, num_beams, max_steps, scores, step_of=None):
    """Plain beam search, one step at a time, over Python sets."""
    paths = {tuple(t) for _, t in sequences}
    step_of = step_of or (lambda tokens, token, wanted: scores[tokens[-1], token] + (beam.QUERY_BONUS if token in wanted else 0.0))
    out = {}
    for query, wanted in queries:
        state = [((0,), 0.0, False)]
        for _ in range(max_steps):
            grown = [b for b in state if b[2]]
            for tokens, total, done in state:
                if done:
                    continue
                for token in {p[len(tokens)] for p in paths if len(p) > len(tokens) and p[: len(tokens)] == tokens}:
                    longer = tokens + (token,)
                    grown.append((longer, total + step_of(tokens, token, wanted), longer in paths))
            grown.sort(key=lambda b: (-round(b[1] / max(len(b[0]) - 1, 1), 9), b[0]))
            state = grown[:num_beams]
        out[query] = [(list(t), round(s / max(len(t) - 1, 1), 6)) for t, s, _ in state]
    return out


@pytest.mark.parametrize("num_beams, max_steps, seed", [(1, 20, 1), (3, 20, 2), (3, 5, 4), (200, 20, 5)])
def test_beam_search_equals_stepwise_search(spark, monkeypatch, num_beams, max_steps, seed):
    monkeypatch.setattr(beam, "_FEW", 1 if seed % 2 else 6)
    dice = random.Random(seed)
    data = []
    for i in range(60):
        body = [dice.choice([3, 4, 5, 6]) for _ in range(dice.randint(1, 14))]
        data.append((f"d{i}", [0, *body]))
        if dice.random() < 0.3:
            data.append((f"e{i}", [0, *body, dice.choice([3, 4])]))
    sequences = spark.createDataFrame(data, SEQS)
    queries = [("q1", [3, 9]), ("q2", [4, 5]), ("q3", [])]
    scores = {(r["prev"], r["token"]): r["logp"] for r in beam.bigram_scores(prefix.distinct_paths(sequences)).collect()}
    found = beam.constrained_beam_search(
        beam.stored_search_index(sequences),
        spark.createDataFrame(queries, "query_id string, tokens array<int>"),
        num_beams,
        max_steps,
    )
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((list(r["tokens"]), round(r["score"], 6)))
    assert got == _stepwise(data, queries, num_beams, max_steps, scores)


def _nested_table(seed):
    dice = random.Random(seed)
    data = []
    for i in range(60):
        body = [dice.choice([3, 4, 5]) for _ in range(dice.randint(1, 9))]
        data.append((f"d{i}", [0, *body]))
        if dice.random() < 0.4:
            data.append((f"e{i}", [0, *body, *[dice.choice([3, 4]) for _ in range(dice.randint(1, 3))]]))
    return data


def _found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((list(r["tokens"]), round(r["score"], 6)))
    return got


@pytest.mark.parametrize("num_beams, max_steps, seed", [(2, 20, 1), (5, 20, 2), (5, 4, 3), (300, 20, 4)])
def test_search_through_complete_sequences(spark, monkeypatch, num_beams, max_steps, seed):
    """Under policy pass the marker is an id like others where a complete sequence goes on."""
    monkeypatch.setattr(beam, "_FEW", 1 if seed % 2 else 6)
    data = _nested_table(seed)
    sequences = spark.createDataFrame(data, SEQS)
    queries = [("q1", [3, 9]), ("q2", [4, 5]), ("q3", [])]
    whole = {tuple(t) for _, t in data}
    left = {p for p in whole if any(q != p and q[: len(p)] == p for q in whole)}
    exits = spark.createDataFrame([(p[-1],) for p in left], "prev int")
    scores = {(r["prev"], r["token"]): r["logp"] for r in beam.bigram_scores(prefix.distinct_paths(sequences), exits=exits).collect()}
    found = beam.constrained_beam_search(
        beam.stored_search_index(sequences, "pass"), spark.createDataFrame(queries, "query_id string, tokens array<int>"), num_beams, max_steps
    )
    searched = [(None, [*p, -1] if p in left else list(p)) for p in whole]
    assert _found(found) == _stepwise(searched, queries, num_beams, max_steps, scores)
    lost = prefix.unmatched_sequences(found, sequences).collect()
    assert {tuple(r["tokens"]) for r in lost} == {tuple(r["tokens"]) for r in found.collect()} - whole
    if num_beams == 300:
        assert {tuple(r["tokens"]) for r in lost} == {(*p, -1) for p in left}


@pytest.mark.parametrize("num_beams, max_steps, seed", [(3, 20, 1), (5, 5, 2), (300, 20, 3)])
def test_search_with_a_scorer_of_whole_beginnings(spark, monkeypatch, num_beams, max_steps, seed):
    from rankloom.plans.catalog import prefix_scorer

    monkeypatch.setattr(beam, "_FEW", 1 if seed % 2 else 6)
    data = _nested_table(seed)
    sequences = spark.createDataFrame(data, SEQS)
    queries = [("q1", [3, 9]), ("q2", [4, 5]), ("q3", [])]
    found = beam.constrained_beam_search(
        beam.stored_search_index(sequences), spark.createDataFrame(queries, "query_id string, tokens array<int>"), num_beams, max_steps,
        beam.BatchScorer(prefix_scorer),
    )

    def step(tokens, token, wanted):
        return -(((sum(tokens) + 7 * token) % 101) + 1) / 101 + (0.5 if token in wanted else 0.0)

    assert _found(found) == _stepwise(data, queries, num_beams, max_steps, None, step)


def test_full_width_search_is_exhaustive(spark):
    data = [(f"d{i}", [0, *body]) for i, body in enumerate(itertools.product([3, 4, 5], repeat=3))]
    sequences = spark.createDataFrame(data, SEQS)
    queries = spark.createDataFrame([("q", [4])], "query_id string, tokens array<int>")
    found = beam.constrained_beam_search(beam.stored_search_index(sequences), queries, num_beams=100)
    assert {tuple(r["tokens"]) for r in found.collect()} == {tuple(t) for _, t in data}
    run = beam.beams_to_run(found, sequences.union(sequences.withColumn("corpus_id", F.concat("corpus_id", F.lit("x")))))
    assert run.count() == 54


def test_edges_of_the_start_are_dealt_to_tasks(spark, monkeypatch):
    """One task met all of them, of one file, with every query."""
    monkeypatch.setattr(beam, "_FIRST_EDGES", 2)
    sequences = spark.createDataFrame([(f"d{i}", [0, 3 + i, 1]) for i in range(40)], "corpus_id string, tokens array<int>")
    index = beam.stored_search_index(sequences)
    dealt = beam.round_edges(index, [1])
    assert sorted(dealt.collect()) == sorted(index.edges.filter("depth = 1").collect())
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.select(F.spark_partition_id()).distinct().count() > 8
    found = beam.constrained_beam_search(index, spark.createDataFrame([("q", [7, 9])], "query_id string, tokens array<int>"), 3)
    assert [list(r["tokens"]) for r in found.orderBy("rank").collect()] == [[0, 7, 1], [0, 9, 1], [0, 3, 1]]


@pytest.mark.parametrize("policy", ["stop", "pass"])
def test_search_paths_over_many_partitions(spark, monkeypatch, policy):
    """What a partition's paths share with those of others; a path walked alone or at the edge counts as any other."""
    paths = {tuple(t) for _, t in _nested_table(7)}
    monkeypatch.setattr(beam, "_in_order", lambda df: df.repartitionByRange(9, "tokens").sortWithinPartitions("tokens"))
    if policy == "stop":
        kept = {p for p in paths if not any(q != p and q == p[: len(q)] for q in paths)}
    else:
        kept = {(*p, -1) if any(q != p and p == q[: len(p)] for q in paths) else p for p in paths}
    found = beam.search_paths(spark.createDataFrame([(list(p),) for p in paths], "tokens array<int>"), policy).collect()
    assert {tuple(r["tokens"]) for r in found} == kept and len(found) == len(kept)
    for r in found:
        p = tuple(r["tokens"])
        assert r["starts"] == [d for d in range(1, len(p)) if d == 1 or any(q[:d] == p[:d] and q[d] != p[d] for q in kept if len(q) > d)]
        assert r["counts"] == [sum(q[: d + 1] == p[: d + 1] for q in kept) for d in r["starts"]]
    ordered = sorted(found, key=lambda r: r["p"])
    shared = [sum(1 for _ in itertools.takewhile(lambda t: t[0] == t[1], zip(a["tokens"], b["tokens"]))) for a, b in zip(ordered, ordered[1:])]
    assert [r["before"] for r in ordered[1:]] == shared


def test_an_index_leaves_its_tables_only(spark, tmp_path):
    """Steps and shuffle files of the build stayed until the session ended."""
    with recorded_steps() as steps:
        beam.write_search_index(spark.createDataFrame(_nested_table(3), SEQS), str(tmp_path / "index"))
    assert len(steps) >= 5 and not any(os.path.exists(step) and any(f.endswith(".parquet") for f in os.listdir(step)) for step in steps)


def test_search_in_an_empty_index(spark, small):
    queries = spark.createDataFrame([("q", [4])], "query_id string, tokens array<int>")
    empty = beam.stored_search_index(small.filter("false"))
    assert beam.constrained_beam_search(empty, queries).count() == 0


def test_hot_keys_are_dealt_to_slices(spark, small, probes, rows, monkeypatch):
    from rankloom.operators import skew

    edges = prefix.build_prefix_index(small)
    many = probes.unionByName(spark.createDataFrame([(f"r{i}", []) for i in range(30)] + [(f"n{i}", [7]) for i in range(30)], PROBES))
    docs = small.unionByName(spark.createDataFrame([(f"x{i}", [5, 8]) for i in range(30)], SEQS))
    outputs = spark.createDataFrame([("q", [5, 8]), ("p", [5, 8]), ("q", [5, 6])], "query_id string, tokens array<int>")
    want = rows(prefix.next_tokens(edges, many)), rows(prefix.sequence_documents(outputs, docs).select("query_id", "corpus_id"))
    monkeypatch.setattr(skew, "SLICE_ROWS", 4)
    assert (rows(prefix.next_tokens(edges, many)), rows(prefix.sequence_documents(outputs, docs).select("query_id", "corpus_id"))) == want


def test_paths_are_not_shuffled_with_their_beginnings(spark, capsys):
    dice = random.Random(2)
    stored = [(f"d{i}", [0, *[dice.choice([3, 4]) for _ in range(dice.randint(1, 12))], 1]) for i in range(60)]
    found = beam.search_paths(prefix.distinct_paths(spark.createDataFrame(stored, SEQS)))
    found.explain()
    assert "hashpartitioning(tokens" not in capsys.readouterr().out
    paths = {tuple(t) for _, t in stored}
    parts = {p: {d for d in range(1, len(p)) if d == 1 or any(o[:d] == p[:d] and o[d] != p[d] for o in paths if len(o) > d)} for p in paths}
    assert {tuple(r["tokens"]): set(r["starts"]) for r in found.collect()} == parts
