"""Beam search limited to stored sequences, for all queries at once.

The search index holds edges between the places where stored sequences part, each with the
log-probabilities of its steps, so a round joins the beams with the edges of their depths
and with nothing else.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.functions.fixed import MAX_LENGTH, NUM_BEAMS
from rankloom.functions.tokens import START_ID, TERMINAL, cut_at_pad, prefix_hashes
from rankloom.operators.prefix import KEY, _in_order, _shared_lengths, distinct_paths, read_prefix_index, sequence_documents, write_prefix_index
from rankloom.session import BROADCAST_BYTES, BROADCAST_ROWS, cut_lineage, drop_step, fits, scratch_path, workers_find_package

SMOOTHING = 0.1
QUERY_BONUS = 2.0
_MEAN_DIGITS = 9
# Sequences ahead of a beam that its query may bring into one group for the last steps.
_FEW = 32
# Edges of the start that a task of the first round joins with every query.
_FIRST_EDGES = 2_048

# (log-probability of the transition, token, ids of the query) -> score of the step, as a column expression
Scorer = Callable[[Column, Column, Column], Column]


@dataclass(frozen=True)
class BatchScorer:
    """A scorer that sees whole beginnings, such as a language model.

    ``make`` is called once in each Python worker. What it returns gets Arrow batches of
    ``(query_tokens, tokens, label)``, the ids of the query, a beginning and what may follow
    it, and returns a ``list<double>`` array: for each id of the label the score of the step
    to it, given the query, the beginning and the ids of the label before it.
    """

    make: Callable[[], Callable[[pa.RecordBatch], pa.Array]]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)


_LOADED: dict[str, Callable[[pa.RecordBatch], pa.Array]] = {}


def _loaded(scorer: BatchScorer) -> Callable[[pa.RecordBatch], pa.Array]:
    if scorer.name not in _LOADED:
        _LOADED[scorer.name] = scorer.make()
    return _LOADED[scorer.name]


def query_bonus_scorer(bonus: float = QUERY_BONUS) -> Scorer:
    """The transition's log-probability, plus a bonus for ids that the query holds."""
    return lambda logp, token, query_tokens: logp + F.when(F.array_contains(query_tokens, token), bonus).otherwise(0.0)


def bigram_scores(paths: DataFrame, smoothing: float = SMOOTHING, exits: DataFrame | None = None) -> DataFrame:
    """``(prev, token, logp)``: smoothed log-probability of each transition of the corpus.

    ``paths`` is ``(tokens, n_seq)``, as ``distinct_paths`` gives it. ``exits (prev)`` asks
    for the step to the terminal marker, a transition that never occurs.
    """
    position = F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i")
    steps = (
        paths.filter(F.size("tokens") > 1)
        .select("n_seq", "tokens", position)
        .select(F.get("tokens", F.col("i") - 1).alias("prev"), F.get("tokens", F.col("i")).alias("token"), "n_seq")
    )
    pairs = steps.groupBy("prev", "token").agg(F.sum("n_seq").alias("n"))
    totals = pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    n_tokens = pairs.agg(F.countDistinct("token").alias("v")).scalar()
    if exits is not None:
        never = exits.select("prev", F.lit(TERMINAL).alias("token"), F.lit(0).cast("bigint").alias("n")).distinct()
        pairs = pairs.unionByName(never)
    share = (F.col("n") + smoothing) / (F.col("n_prev") + smoothing * n_tokens)
    return pairs.join(totals, "prev").select("prev", "token", F.log(share).alias("logp"))


_PLACED = (
    "tokens array<int>, starts array<int>, counts array<bigint>, before int, x int, y int, continued boolean, "
    "head boolean, tail boolean, from_head array<bigint>, from_tail array<bigint>"
)
_PLACED_ROWS = 4_096


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _place(drop_shadowed: bool):
    """What one sorted partition tells of its paths.

    ``starts``: depths where a path parts from another one here, and ``counts``, the paths that go on
    with it there. ``before``, ``x`` and ``y``: ids shared with the path before it, the first and the last one. ``from_head``
    and ``from_tail``: how many paths share each number of ids with the first and the last one. A path
    that goes on from a whole one is left out with ``drop_shadowed``, as far as that one lies here.
    """

    def run(batches):
        flat, sizes, shared, last = [], [], [], None
        for batch in batches:
            for at in range(0, batch.num_rows, _PLACED_ROWS):
                rows = [np.asarray(row, np.int32) for row in batch.column("tokens").slice(at, _PLACED_ROWS).to_pylist()]
                shared.append(_shared_lengths(rows, last))
                flat.append(np.concatenate(rows))
                sizes.append(np.array([len(row) for row in rows], np.int64))
                last = rows[-1]
        if last is None:
            return
        flat, sizes, shared = np.concatenate(flat), np.concatenate(sizes), np.concatenate(shared)
        continued = np.r_[shared[1:] == sizes[:-1], False]
        if drop_shadowed:
            keep, cover, common = np.ones(len(sizes), bool), 0, []
            least = 0
            for at, (size, here) in enumerate(zip(sizes.tolist(), shared.tolist())):
                least = min(least, here)
                keep[at] = not 0 < cover <= here
                if keep[at]:
                    common.append(least)
                    cover, least = size, size
            flat, sizes, shared, continued = flat[np.repeat(keep, sizes)], sizes[keep], np.array(common, np.int64), continued[keep]
        n = len(sizes)
        rows, depths, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for depth in np.unique(shared[1:]).tolist():
            if depth < 1:
                continue
            # Paths that share their first ids are neighbours.
            group, after = np.cumsum(shared < depth) - (shared[0] < depth), np.cumsum(shared <= depth) - (shared[0] <= depth)
            parts = np.zeros(group[-1] + 1, bool)
            parts[group[1:][shared[1:] == depth]] = True
            here = np.flatnonzero(parts[group])
            rows.append(here)
            depths.append(np.full(len(here), depth))
            counts.append(np.bincount(after)[after[here]])
        rows, depths, counts = np.concatenate(rows), np.concatenate(depths), np.concatenate(counts)
        order = np.argsort(rows, kind="stable")
        of_row = np.bincount(rows, minlength=n)
        x = np.minimum.accumulate(np.r_[sizes[0], shared[1:]])
        y = np.minimum.accumulate(np.r_[sizes[-1], shared[:0:-1]])[::-1]
        share = lambda lengths, size: [int((lengths >= depth).sum()) for depth in range(1, size + 1)]
        from_head, from_tail = [None] * n, [None] * n
        from_head[0], from_tail[-1] = share(x, int(sizes[0])), share(y, int(sizes[-1]))
        ends = np.r_[0, np.cumsum(sizes)]
        of_starts = np.r_[0, np.cumsum(of_row)]
        depths, counts = depths[order], counts[order]
        for at in range(0, n, _PLACED_ROWS):
            to = min(at + _PLACED_ROWS, n)
            cut, own = slice(at, to), slice(of_starts[at], of_starts[to])
            place = np.arange(at, to)
            yield pa.RecordBatch.from_arrays(
                [
                    _lists(sizes[cut], flat[ends[at] : ends[to]], pa.int32()),
                    _lists(of_row[cut], depths[own], pa.int32()),
                    _lists(of_row[cut], counts[own], pa.int64()),
                    *[pa.array(v[cut], pa.int32()) for v in (shared, x, y)],
                    pa.array(continued[cut]),
                    pa.array(place == 0),
                    pa.array(place == n - 1),
                    pa.array(from_head[cut], pa.list_(pa.int64())),
                    pa.array(from_tail[cut], pa.list_(pa.int64())),
                ],
                ["tokens", "starts", "counts", "before", "x", "y", "continued", "head", "tail", "from_head", "from_tail"],
            )

    return run


_AROUND = "part int, first array<int>, last array<int>, of_first array<bigint>, of_last array<bigint>, before int, shadow int, goes_on boolean"


def _around(edges_of_parts: list) -> list[tuple]:
    """What the partitions tell of each other, from the first and last path of each: two paths a partition.

    Depths where the first and the last path part from any path, how many of all paths share each
    number of ids with them, the ids that the first one shares with the partition before, the length of a whole path of earlier
    partitions that begins the first one, and whether the next partition goes on from the last one.
    """
    parts: dict[int, dict] = {}
    for row in edges_of_parts:
        of = parts.setdefault(row["part"], {})
        for kind, there in (("head", row["head"]), ("tail", row["tail"])):
            if there:
                of[kind] = np.asarray(row["tokens"], np.int32), set(row["starts"]), row[f"from_{kind}"]
    numbers = sorted(parts)
    common = lambda a, b: int(np.argmax(np.r_[a[: len(b)] != b[: len(a)], True]))
    line = [(number, kind, *parts[number][kind]) for number in numbers for kind in ("head", "tail")]
    begins: list[set] = [set(starts) for *_, starts, _ in line]
    met = [common(a[2], b[2]) for a, b in zip(line, line[1:])]
    for at, depth in enumerate(met, 1):
        # The only path of a partition does not part from itself.
        own = {depth} if line[at - 1][0] != line[at][0] or depth < max(len(line[at - 1][2]), len(line[at][2])) else set()
        begins[at] |= {d for d in begins[at - 1] if d <= depth} | own
    for at in range(len(met), 0, -1):
        depth = met[at - 1]
        own = {depth} if line[at - 1][0] != line[at][0] or depth < max(len(line[at - 1][2]), len(line[at][2])) else set()
        begins[at - 1] |= {d for d in begins[at] if d <= depth} | own
    totals: dict[bytes, int] = {}
    for at, (_, kind, tokens, _, counts) in enumerate(line):
        seen = met[at - 1] if kind == "tail" else 0
        for depth in range(seen + 1, len(tokens) + 1):
            key = tokens[:depth].tobytes()
            totals[key] = totals.get(key, 0) + counts[depth - 1]
    out, cover = [], None
    for at in range(0, len(line), 2):
        (number, _, first, *_), (_, _, last, *_) = line[at], line[at + 1]
        of = lambda tokens: [totals[tokens[:depth].tobytes()] for depth in range(1, len(tokens) + 1)]
        shadow = len(cover) if cover is not None and 0 < len(cover) <= common(cover, first) else None
        goes_on = at + 2 < len(line) and met[at + 1] == len(last)
        out.append((number, sorted(begins[at]), sorted(begins[at + 1]), of(first), of(last), met[at - 1] if at else 0, shadow, goes_on))
        if shadow is None or common(cover, last) < shadow:
            cover = last
    return out


def search_paths(paths: DataFrame, policy: str = "stop") -> DataFrame:
    """``(p, tokens, starts, counts, before)``: sequences a search can reach, with the depths where they part from others.

    ``p`` numbers them in sorted order; ``counts`` are the sequences that share the id behind each start, and
    ``before`` the first ids that the sequence before it shares. ``stop``: a sequence that continues beyond the end of another one
    is left out, as a search stops at the first end. ``pass``: a search goes through it. There the terminal marker is one of the allowed ids, as
    it is in the list of next tokens, and a beam that takes it is dead: it ends with the
    marker, which no stored sequence holds; ``continued`` marks those.

    In sorted order neighbours share the most, so a walk over a partition finds where its paths part. Only the
    beginnings of a partition's first and last path go on in others; those few paths are compared by the driver.
    """
    if policy not in ("stop", "pass"):
        raise ValueError(f"policy must be 'pass' or 'stop', not {policy!r}")
    stop = policy == "stop"
    while True:
        placed = _in_order(paths.select("tokens")).mapInArrow(_place(stop), _PLACED)
        placed = cut_lineage(placed.withColumn("part", F.spark_partition_id()).withColumn("p", F.monotonically_increasing_id()))
        around = _around(placed.filter("head OR tail").select("part", "tokens", "starts", "head", "tail", "from_head", "from_tail").collect())
        known = F.broadcast(paths.sparkSession.createDataFrame(around, _AROUND))
        placed_here, placed = placed, placed.drop("from_head", "from_tail").withColumnRenamed("before", "shared").join(known, "part")
        if not stop or all(shadow is None for *_, shadow, _ in around):
            break
        # A whole path of an earlier partition begins some here: without them no path begins another.
        paths = cut_lineage(placed.filter("shadow IS NULL OR x < shadow").select("tokens"))
        drop_step(placed_here)
    goes_on = F.lit(False) if stop else F.col("continued") | (F.col("tail") & F.col("goes_on"))
    inside = lambda array, shared: F.filter(array, lambda d: d <= F.col(shared))
    found = F.array_union(F.array_union("starts", F.array(F.lit(1))), F.array_union(inside("first", "x"), inside("last", "y")))
    here = lambda d: F.get("of_parts", F.array_position("parts", d).cast("int") - 1)
    count = lambda d: F.when(d < F.col("x"), F.get("of_first", d)).when(d < F.col("y"), F.get("of_last", d)).otherwise(F.coalesce(here(d), F.lit(1)))
    tokens = F.when(goes_on, F.concat("tokens", F.array(F.lit(TERMINAL)))).otherwise(F.col("tokens"))
    out = placed.select(
        "p", "x", "y", F.col("starts").alias("parts"), F.col("counts").alias("of_parts"), "of_first", "of_last", tokens.alias("tokens"), goes_on.alias("continued"),
        F.when(F.col("head"), F.col("before")).otherwise(F.col("shared")).alias("before"), F.array_sort(found).alias("found"),
    ).withColumn("found", F.filter("found", lambda d: d < F.size("tokens")))
    return out.select("p", "tokens", F.col("found").alias("starts"), F.transform("found", count).alias("counts"), "before", "continued")


def step_scores(paths: DataFrame, bigrams: DataFrame) -> DataFrame:
    """``(p, i, logp)``: the log-probability of each step of the paths.

    The transitions are read here, once, and by no search. A path goes by its number, a transition by one number too.
    Stored, so that what this join shuffles is gone before its rows are shuffled back to the paths.
    """
    pair = lambda prev, token: (prev.cast("bigint") * (1 << 32) + token).alias("pair")
    steps = (
        paths.filter(F.size("tokens") > 1)
        .select("p", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - 1)).alias("i"))
        .select("p", "i", pair(F.get("tokens", F.col("i") - 1), F.get("tokens", F.col("i"))))
    )
    known = bigrams.select(pair(F.col("prev"), F.col("token")), "logp")
    return cut_lineage(steps.join(F.broadcast(known) if fits(known) else known, "pair").select("p", "i", "logp"), "zstd")


def scored_paths(paths: DataFrame, scores: DataFrame) -> DataFrame:
    """``paths`` with ``logps``, the log-probability of each step: one shorter than ``tokens``."""
    logps = F.transform(F.array_sort(F.collect_list(F.struct("i", "logp"))), lambda s: s["logp"])
    return paths.join(scores.repartition("p").groupBy("p").agg(logps.alias("logps")), "p")


def branches(scored: DataFrame) -> DataFrame:
    """One row per place where paths may part and id that follows it, with the ids up to the next place.

    Of the paths that go on with the same id only the first one in sorted order lists it.
    """
    h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
    until = F.coalesce(F.get("starts", F.col("at") + 1), F.size("tokens"))
    placed = scored.select("tokens", "starts", "counts", "logps", "before", F.posexplode("starts").alias("at", "depth"))
    return placed.filter(F.col("depth") >= F.col("before")).select(
        "depth",
        h1.alias("h1"),
        h2.alias("h2"),
        F.get("tokens", F.col("depth")).alias("token"),
        F.get("counts", F.col("at")).alias("n_paths"),
        F.slice("tokens", F.col("depth") + 1, until - F.col("depth")).alias("label"),
        F.slice("logps", F.col("depth"), until - F.col("depth")).alias("logps"),
    )


def branch_edges(rows: DataFrame) -> DataFrame:
    """Edges between the places where stored sequences part.

    One row per branching prefix and next token: ``label`` holds the ids from there to the
    next branching, or to the end of the only sequence left, ``logps`` their scores, ``logp``
    the first of them, and ``n_paths`` counts the sequences behind it. A search has a choice at branchings only,
    and there are fewer of them than sequences.
    """
    return rows.select(*KEY, "token", "n_paths", F.get("logps", F.lit(0)).alias("logp"), "label", "logps")


def path_tails(scored: DataFrame) -> DataFrame:
    """What lies behind the first edge of each path with few sequences behind it.

    Rows are ``(depth, h1, h2, token)``, the edge's key, and ``ids`` and ``logps`` from there
    to the path's end. Every path is behind one such edge.
    """
    few = F.filter(F.arrays_zip("starts", "counts"), lambda s: s["counts"] <= _FEW)
    fronts = scored.withColumn("depth", F.get(few, F.lit(0))["starts"]).filter("depth IS NOT NULL")
    h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
    rest = F.size("tokens") - F.col("depth")
    return fronts.select(
        "depth",
        h1.alias("h1"),
        h2.alias("h2"),
        F.get("tokens", F.col("depth")).alias("token"),
        F.slice("tokens", F.col("depth") + 1, rest).alias("ids"),
        F.slice("logps", F.col("depth"), rest).alias("logps"),
    )


EDGE_SCHEMA = "h1 long, h2 long, token int, n_paths long, logp double, label array<int>, logps array<double>, depth int"
TAIL_SCHEMA = "h1 long, h2 long, token int, ids array<int>, logps array<double>, depth int"


@dataclass(frozen=True)
class SearchIndex:
    """Stored tables of a search: branch edges, and the ends of sequences behind edges with few of them."""

    edges: DataFrame
    tails: DataFrame


def write_search_index(sequences: DataFrame, path: str, policy: str = "stop") -> SearchIndex:
    """Build and store the tables of a search. Each step is deleted when the next ones are written."""
    spark = sequences.sparkSession
    distinct = cut_lineage(distinct_paths(sequences))
    paths = search_paths(distinct, policy)
    exits = paths.filter("continued").select(F.element_at("tokens", -2).alias("prev")) if policy == "pass" else None
    bigrams = cut_lineage(bigram_scores(distinct, exits=exits))
    drop_step(distinct)
    scores = step_scores(paths, bigrams)
    drop_step(bigrams)
    scored = cut_lineage(scored_paths(paths, scores), "zstd")
    drop_step(paths)
    drop_step(scores)
    write_prefix_index(branch_edges(branches(scored)), f"{path}/edges")
    write_prefix_index(path_tails(scored), f"{path}/tails")
    drop_step(scored)
    return read_search_index(spark, path)


def read_search_index(spark, path: str) -> SearchIndex:
    return SearchIndex(read_prefix_index(spark, f"{path}/edges", EDGE_SCHEMA), read_prefix_index(spark, f"{path}/tails", TAIL_SCHEMA))


def stored_search_index(sequences: DataFrame, policy: str = "stop") -> SearchIndex:
    """A search index in fresh shared scratch space."""
    return write_search_index(sequences, scratch_path(sequences.sparkSession, "search-index"), policy)


_PENDING = "array<struct<token:int,step:double>>"
_FRONT = "struct<depth:int,h1:bigint,h2:bigint,token:int>"
_STATE = ["query_id", "query_tokens", "tokens", "total", "ends", "n_paths", "pending", "front"]
_OPEN_ENDED = 1 << 62


def _mean() -> Column:
    return F.col("total") / F.greatest(F.size("tokens") - 1, F.lit(1))


def _best(beams: DataFrame, num_beams: int) -> DataFrame:
    order = [F.desc(F.round(_mean(), _MEAN_DIGITS)), F.asc("tokens")]
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return beams.withColumn("rank", rank).filter(F.col("rank") <= num_beams)


def _at_end(max_steps: int) -> Column:
    through = (F.col("n_paths") == 1) & (F.size("pending") == 0)
    return F.col("ends") | through | (F.size("tokens") > max_steps)


def _consume(state: DataFrame, n: Column, max_steps: int) -> DataFrame:
    """Move every beam ``n`` of its pending steps forward, and mark those at an end."""
    steps = F.slice("pending", F.lit(1), F.col("_n"))
    moved = state.withColumn("_n", F.greatest(F.least(n, F.size("pending"), max_steps + 1 - F.size("tokens")), F.lit(0)))
    return moved.select(
        "query_id",
        "query_tokens",
        F.concat("tokens", F.transform(steps, lambda s: s["token"])).alias("tokens"),
        F.aggregate(steps, F.col("total"), lambda t, s: t + s["step"]).alias("total"),
        "ends",
        "n_paths",
        F.slice("pending", F.col("_n") + 1, F.size("pending")).alias("pending"),
        "front",
        "active",
    ).withColumn("ends", _at_end(max_steps))


def _with_steps(rows: DataFrame, scorer: Scorer | BatchScorer) -> DataFrame:
    """``rows`` with ``pending``, the scored ids of ``label``, in place of ``label`` and ``logps``."""
    if not isinstance(scorer, BatchScorer):
        step = F.zip_with(
            "label", "logps", lambda t, logp: F.struct(t.alias("token"), scorer(logp, t, F.col("query_tokens")).cast("double").alias("step"))
        )
        return rows.withColumn("pending", step).drop("label", "logps")
    workers_find_package(rows.sparkSession)
    rows = rows.drop("logps")

    def run(batches):
        score = _loaded(scorer)
        for batch in batches:
            steps = score(batch.select(["query_tokens", "tokens", "label"])) if batch.num_rows else pa.array([], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, steps.cast(pa.list_(pa.float64()))], [*batch.schema.names, "steps"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    scored = rows.mapInArrow(run, f"{kinds}, steps array<double>")
    step = F.zip_with("label", "steps", lambda t, s: F.struct(t.alias("token"), s.alias("step")))
    return scored.withColumn("pending", step).drop("label", "steps")


def _searching() -> Column:
    return ~F.col("ends") & (F.col("n_paths") > 1)


def _branching() -> Column:
    return F.col("active") & _searching() & (F.size("pending") == 0)


def _ready(state: DataFrame, max_steps: int) -> DataFrame:
    """The beams of each query moved on to the next branching of one of them.

    A query stays active while one of its open beams has more than ``_FEW`` sequences ahead.
    Between branchings nothing can be cut, so all go the same number of steps; without a
    branching ahead they go to their ends.
    """
    of_query = W.partitionBy("query_id")
    ahead = F.max(F.when(~F.col("ends"), F.col("n_paths"))).over(of_query)
    to_branching = F.min(F.when(_searching(), F.size("pending"))).over(of_query)
    moved = state.withColumn("active", F.coalesce(ahead > _FEW, F.lit(False))).withColumn("_to", F.coalesce(to_branching, F.size("pending")))
    return _consume(moved, F.when(F.col("active"), F.col("_to")).otherwise(0), max_steps)


def round_edges(index: SearchIndex, depths: list[int]) -> DataFrame:
    """The edges that beams of these depths meet.

    All queries begin at one place and each of them meets all its edges, which may lie in
    one row group: they are dealt to tasks of bounded size.
    """
    edges = index.edges.filter(F.col("depth").isin(depths))
    if depths != [1]:
        return edges
    cores = edges.sparkSession.sparkContext.defaultParallelism
    return edges.repartition(max(cores, -(-edges.count() // _FIRST_EDGES)), "token")


def _complete(state: DataFrame, index: SearchIndex, num_beams: int, max_steps: int, scorer: Scorer | BatchScorer, small: bool) -> DataFrame:
    """The last steps of queries with few sequences ahead, query by query.

    Every open beam has passed an edge with few sequences behind it; their ends are found by
    the key of that edge. A query brings at most ``num_beams`` times ``_FEW`` sequences, so it
    fits in one task; there its beams are cut step by step among those sequences.
    """
    begun = state.filter(~F.col("ends")).select("query_id", "query_tokens", "total", "tokens", "front.*")
    depths = [row["depth"] for row in begun.select("depth").distinct().collect()]
    ended = state.filter("ends").select("query_id", "total", "tokens", F.array().cast(_PENDING).alias("pending"))
    if depths:
        there = index.tails.filter(F.col("depth").isin(depths))
        done = F.size("tokens") - F.col("depth")
        room = F.lit(max_steps + 1) - F.size("tokens")
        ahead = (
            there.join(F.broadcast(begun) if small else begun, [*KEY, "token"])
            .filter((F.size("ids") > done) & (F.slice("ids", F.lit(1), done) == F.slice("tokens", F.col("depth") + 1, done)))
            .select("query_id", "query_tokens", "total", "tokens", F.slice("ids", done + 1, room).alias("label"), F.slice("logps", done + 1, room).alias("logps"))
            .distinct()
        )
        ended = ended.unionByName(_with_steps(ahead, scorer).select(*ended.columns))

    def last_steps(frame: pd.DataFrame) -> pd.DataFrame:
        heads = [tuple(t) for t in frame["tokens"]]
        paths = [head + tuple(s["token"] for s in steps) for head, steps in zip(heads, frame["pending"])]
        sums = [
            list(itertools.accumulate((s["step"] for s in steps), initial=total))
            for total, steps in zip(frame["total"], frame["pending"])
        ]
        alive = range(len(paths))
        for size in range(min(map(len, heads)) + 1, max(map(len, paths)) + 1):
            beams: dict[tuple, list[int]] = {}
            for at in alive:
                beams.setdefault(paths[at][:size], []).append(at)
            if len(beams) > num_beams:

                def place(prefix: tuple) -> tuple:
                    at = beams[prefix][0]
                    total = sums[at][max(len(prefix) - len(heads[at]), 0)]
                    return -round(total / max(len(prefix) - 1, 1), _MEAN_DIGITS), prefix

                alive = [at for prefix in sorted(beams, key=place)[:num_beams] for at in beams[prefix]]
        whole = {paths[at]: sums[at][-1] for at in alive}
        return pd.DataFrame(
            {
                "query_id": [frame["query_id"].iloc[0]] * len(whole),
                "tokens": [list(path) for path in whole],
                "total": list(whole.values()),
            }
        )

    return ended.groupBy("query_id").applyInPandas(last_steps, "query_id string, tokens array<int>, total double")


def constrained_beam_search(
    index: SearchIndex,
    queries: DataFrame,
    num_beams: int = NUM_BEAMS,
    max_steps: int = MAX_LENGTH + 1,
    scorer: Scorer | BatchScorer | None = None,
) -> DataFrame:
    """``(query_id, rank, tokens, score)``: the best stored sequences of each query.

    ``queries`` is ``(query_id, tokens)``. Beams are cut to ``num_beams`` by mean step
    score after every step at which a query has more than it may keep. Complete sequences
    stay in the table and compete with the open ones.

    Between two branchings nothing can be cut, so each round moves the beams of a query
    straight to its next branching, and takes the one step there by a join with the branch
    edges of that depth. A round reads no other table. A query with few
    sequences ahead of every open beam leaves the rounds, and the last steps of all those
    queries are taken together, each query in one small group. The driver sees the depths in
    use, at most ``max_steps`` numbers a round.
    """
    scorer = scorer or query_bonus_scorer()
    begun = queries.select(
        "query_id",
        F.array_distinct("tokens").alias("query_tokens"),
        F.array(F.lit(START_ID)).alias("tokens"),
        F.lit(0.0).alias("total"),
        F.lit(False).alias("ends"),
        F.lit(_OPEN_ENDED).alias("n_paths"),
        F.array().cast(_PENDING).alias("pending"),
        F.lit(None).cast(_FRONT).alias("front"),
    )
    state = cut_lineage(_ready(begun, max_steps))
    # What a round joins is bounded by the queries, the beams and the steps.
    small = fits(state.select("query_id", "query_tokens", "tokens"), BROADCAST_ROWS // num_beams, BROADCAST_BYTES // num_beams)
    while True:
        # Depths differ between queries; the folders of the others are not read.
        depths = [row["d"] for row in state.filter(_branching()).select(F.size("tokens").alias("d")).distinct().collect()]
        if not depths:
            break
        h1, h2 = prefix_hashes(F.col("tokens"), F.size("tokens"))
        at_branch = state.filter(_branching()).select(
            "query_id", "query_tokens", "tokens", "total", "front", F.size("tokens").alias("depth"), h1.alias("h1"), h2.alias("h2")
        )
        edges = round_edges(index, depths)
        met = edges.select(*KEY, "token", "n_paths", "logp").join(F.broadcast(at_branch) if small else at_branch, KEY)
        # One step for every choice; the ids behind it only for the beams that are kept.
        if isinstance(scorer, BatchScorer):
            scored = _with_steps(met.withColumn("label", F.array("token")).withColumn("logps", F.array("logp")).drop("logp"), scorer)
            step = F.get("pending", F.lit(0))["step"]
        else:
            scored, step = met, scorer(F.col("logp"), F.col("token"), F.col("query_tokens"))
        grown = scored.select(
            "query_id",
            "query_tokens",
            F.concat("tokens", F.array("token")).alias("tokens"),
            (F.col("total") + step).alias("total"),
            F.lit(False).alias("ends"),
            "n_paths",
            F.array().cast(_PENDING).alias("pending"),
            "front",
            F.struct(*KEY, "token").alias("edge"),
        )
        # The other beams of a query take one step meanwhile, unless none of it branches.
        still = F.max(F.when(_branching(), 1).otherwise(0)).over(W.partitionBy("query_id"))
        others = _consume(state.filter("active").withColumn("_still", still).filter(~_branching()), F.col("_still"), max_steps)
        others = others.select(*_STATE, F.lit(None).cast(_FRONT).alias("edge"))
        kept = cut_lineage(_best(grown.unionByName(others), num_beams).drop("rank"))
        stepped = kept.filter("edge IS NOT NULL").drop("pending").select("*", "edge.*")
        if small:
            stepped = F.broadcast(stepped)
        behind = edges.select(*KEY, "token", F.slice("label", 2, F.size("label")).alias("label"), F.slice("logps", 2, F.size("logps")).alias("logps"))
        front = F.when(F.col("front").isNull() & (F.col("n_paths") <= _FEW), F.col("edge")).otherwise(F.col("front"))
        moved = _with_steps(behind.join(stepped, [*KEY, "token"]).withColumn("front", front), scorer).select(*_STATE)
        beams = moved.unionByName(kept.filter("edge IS NULL").select(*_STATE)).withColumn("ends", _at_end(max_steps))
        waiting = state.filter(~F.col("active"))
        state = cut_lineage(_ready(beams, max_steps).unionByName(waiting))
    finished = _complete(state, index, num_beams, max_steps, scorer, small)
    return _best(finished, num_beams).select("query_id", "rank", "tokens", _mean().alias("score"))


def beams_to_run(beams: DataFrame, sequences: DataFrame) -> DataFrame:
    """Run of a beam search: ``exp(score)``; a document keeps its best sequence's score."""
    # Read twice: which sequences are wanted, and whose they are.
    outputs = cut_lineage(beams.select("query_id", cut_at_pad(F.col("tokens")).alias("tokens"), F.exp("score").alias("score")))
    return (
        sequence_documents(outputs, sequences)
        .groupBy("query_id", "corpus_id")
        .agg(F.max("score").alias("score"))
    )
