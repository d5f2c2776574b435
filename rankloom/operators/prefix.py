"""The prefix index: which token may follow a given beginning of a stored sequence.

Input is ``sequences (corpus_id, tokens ARRAY<INT>)``, framed with the start id. The index
is a table of edges, one per (prefix, next token) pair that occurs::

    depth   length of the prefix
    h1, h2  128-bit key of the prefix
    prev    last id of the prefix, null at the root
    token   next id, or -1 where a sequence is complete
    n_seq   stored sequences through this edge, copies counted
    n_paths distinct sequences through this edge
    ends    some sequence is complete right after ``token``
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.tokens import START_ID, TERMINAL, prefix_hashes
from rankloom.operators.skew import dealt_join
from rankloom.session import cut_lineage, fits, scratch_path, shuffles_dropped, workers_find_package

KEY = ["depth", "h1", "h2"]
EDGE_SCHEMA = "h1 long, h2 long, prev int, token int, n_seq long, n_paths long, ends boolean, depth int"
_EDGE = [*KEY, "prev", "token"]
# Rows that one task lists where probes meet the beginnings of an index.
_LISTED_ROWS = 4_000_000


def check_shared_start(sequences: DataFrame) -> None:
    """Fail unless all sequences begin with the same id."""
    if sequences.select(F.element_at("tokens", 1).alias("first")).distinct().limit(2).count() > 1:
        raise ValueError("sequences start with different tokens")


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """``(tokens, n_seq)``: copies of a sequence are counted once and before anything else."""
    return sequences.groupBy("tokens").agg(F.count(F.lit(1)).alias("n_seq"))


def with_prefixes(paths: DataFrame, shortest: int = 0) -> DataFrame:
    """One row per path and prefix length, with the prefix key."""
    spread = paths.filter(F.size("tokens") >= shortest).withColumn(
        "depth", F.explode(F.sequence(F.lit(shortest), F.size("tokens")))
    )
    h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
    return spread.withColumn("h1", h1).withColumn("h2", h2)


def _in_order(paths: DataFrame) -> DataFrame:
    """Distinct paths, range-partitioned and sorted: a path's neighbours share the most with it."""
    workers_find_package(paths.sparkSession)
    return paths.repartitionByRange("tokens").sortWithinPartitions("tokens")


def _shared_lengths(rows: list[np.ndarray], before: np.ndarray | None) -> np.ndarray:
    """For each row of a sorted list how many first ids it shares with the row before it."""
    sizes = np.array([len(row) for row in rows], np.int64)
    width = max(int(sizes.max()), 0 if before is None else len(before))
    # Places without an id hold a number that no id has; the last column differs in every row.
    table = np.full((len(rows) + 1, width + 1), -9, np.int64)
    table[0] = -8 if before is None else -9
    if before is not None:
        table[0, : len(before)] = before
    flat = np.concatenate(rows)
    at = np.repeat(np.arange(1, len(rows) + 1), sizes)
    table[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    table[:, width] = -10 - np.arange(len(rows) + 1)
    return np.minimum((table[1:] != table[:-1]).argmax(axis=1), sizes)


_NEW_EDGES = "tokens array<int>, depths array<int>, n_seq array<bigint>, n_paths array<bigint>, ends array<boolean>, first boolean"


def _walk(batches):
    """Edges of sorted paths, each listed once, with the path that brought it and its counts.

    An edge begins where a path leaves the common beginning with the one before it, and ends
    where a later path leaves it. Edges that are open at the end of a batch are handed on.
    ``first`` marks the edges of a partition's first path: another partition may have them too.
    """
    held: dict[int, list] = {}  # depth -> [n_seq, n_paths, ends, first] of the last path's open edges
    last = None

    def listed(out):
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.bool_()]
        names = ["tokens", "depths", "n_seq", "n_paths", "ends", "first"]
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    def closed(tokens, edges):
        """Rows of edges ``depth -> [n_seq, n_paths, ends, first]`` of one path."""
        for flag in (True, False):
            chosen = [(d, *e[:3]) for d, e in edges.items() if e[3] is flag]
            if chosen:
                depths, n_seq, n_paths, ends = zip(*chosen)
                yield tokens, list(depths), list(n_seq), list(n_paths), list(ends), flag

    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = [np.asarray(row, np.int64) for row in batch.column("tokens").to_pylist()]
        n_seq, n_new = batch.column("n_seq").to_numpy(), batch.column("n_new").to_numpy()
        sizes = np.array([len(row) for row in rows], np.int64)
        shared = _shared_lengths(rows, last)
        at_start = last is None
        out, edges = [], [dict() for _ in rows]
        if not at_start:
            cut = int(shared[0])
            out += closed(last.tolist(), {d: e for d, e in held.items() if d >= cut})
            held = {d: e for d, e in held.items() if d < cut}
        still: dict[int, list] = {}
        for depth in range(int(sizes.max()) + 1):
            # Where the edge of this depth changes; a path that is too short has none.
            begins = shared <= depth
            begins[0] = True
            starts = np.flatnonzero(begins)
            sums_seq, sums_new = np.add.reduceat(n_seq, starts), np.add.reduceat(n_new, starts)
            for k, (row, x, y) in enumerate(zip(starts.tolist(), sums_seq.tolist(), sums_new.tolist())):
                if sizes[row] < depth:
                    continue
                if row == 0 and depth in held:
                    old = held[depth]
                    edge = [old[0] + x, old[1] + y, old[2], old[3]]
                else:
                    edge = [x, y, bool(sizes[row] == depth + 1), bool(at_start and row == 0)]
                # The edge of the last path goes on into the next batch.
                if k == len(starts) - 1 and sizes[-1] >= depth:
                    still[depth] = edge
                else:
                    edges[row][depth] = edge
        for row, of_row in enumerate(edges):
            out += closed(rows[row].tolist(), of_row)
        held, last = still, rows[-1]
        yield listed(out)
    if last is not None:
        yield listed(list(closed(last.tolist(), held)))


def _edges(paths: DataFrame) -> DataFrame:
    """Edges of distinct paths ``(tokens, n_seq, n_new)``; every path is shuffled once.

    Only edges on a partition's first path can occur in two partitions: those are summed up.
    """
    found = cut_lineage(_in_order(paths.select("tokens", F.col("n_seq").cast("bigint").alias("n_seq"), F.col("n_new").cast("bigint").alias("n_new"))).mapInArrow(_walk, _NEW_EDGES))
    one = F.explode(F.arrays_zip("depths", "n_seq", "n_paths", "ends")).alias("e")
    spread = found.select("tokens", "first", one).select("tokens", "first", F.col("e.depths").alias("depth"), "e.n_seq", "e.n_paths", "e.ends")
    h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
    edges = spread.select(
        F.col("depth"), h1.alias("h1"), h2.alias("h2"),
        F.get("tokens", F.col("depth") - 1).alias("prev"),
        F.coalesce(F.get("tokens", F.col("depth")), F.lit(TERMINAL)).alias("token"),
        "n_seq", "n_paths", "ends", "first",
    )
    # One path per partition at most: its edges, of any partition, are few.
    double = cut_lineage(edges.filter("first").select(*KEY, "token").distinct())
    few = F.broadcast(double) if fits(double) else double
    merged = _summed(edges.join(few, [*KEY, "token"], "left_semi").drop("first"))
    return edges.join(few, [*KEY, "token"], "left_anti").select(*merged.columns).unionByName(merged)


def _summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*_EDGE).agg(F.sum("n_seq").alias("n_seq"), F.sum("n_paths").alias("n_paths"), F.max("ends").alias("ends"))


def build_prefix_index(sequences: DataFrame, shared_start: bool = False) -> DataFrame:
    """All edges of all sequences; shared prefixes are stored once.

    ``shared_start`` fails unless all sequences begin with the same id.
    """
    if shared_start:
        check_shared_start(sequences)
    return _edges(cut_lineage(distinct_paths(sequences).withColumn("n_new", F.lit(1))))


def add_sequences(edges: DataFrame, known: DataFrame, added: DataFrame) -> DataFrame:
    """Edges after inserting ``added`` next to the ``known`` sequences.

    Only the new sequences are walked; a path that is known already adds to the inserts
    but not to the distinct paths. An index that is much larger than what is added stays
    where it is: its rows are met by the new edges.
    """
    old = known.select("tokens").distinct().withColumn("_old", F.lit(True))
    paths = (
        distinct_paths(added)
        .join(old, "tokens", "left")
        .withColumn("n_new", F.when(F.col("_old"), F.lit(0)).otherwise(F.lit(1)))
    )
    new = cut_lineage(_edges(cut_lineage(paths.drop("_old"))))
    if not fits(new):
        return _summed(edges.unionByName(new))
    more = new.select(*KEY, "token", F.col("n_seq").alias("_seq"), F.col("n_paths").alias("_paths"), F.col("ends").alias("_ends"))
    grown = edges.join(F.broadcast(more), [*KEY, "token"], "left").select(
        *_EDGE,
        (F.col("n_seq") + F.coalesce("_seq", F.lit(0))).alias("n_seq"),
        (F.col("n_paths") + F.coalesce("_paths", F.lit(0))).alias("n_paths"),
        (F.col("ends") | F.coalesce("_ends", F.lit(False))).alias("ends"),
    )
    met = edges.join(F.broadcast(more.select(*KEY, "token")), [*KEY, "token"], "left_semi").select(*KEY, "token")
    return grown.unionByName(new.join(cut_lineage(met), [*KEY, "token"], "left_anti").select(*grown.columns))


def with_key(probes: DataFrame) -> DataFrame:
    depth = F.size("tokens")
    h1, h2 = prefix_hashes(F.col("tokens"), depth)
    return probes.withColumn("depth", depth).withColumn("h1", h1).withColumn("h2", h2)


def next_tokens(edges: DataFrame, probes: DataFrame) -> DataFrame:
    """``(probe_id, token)`` for every token allowed after a probe's ``tokens``.

    A complete sequence is followed by -1. An unknown prefix keeps one row with no token.
    A beginning that very many probes share is dealt to several tasks.
    """
    keyed = with_key(probes.select("probe_id", "tokens")).drop("tokens")
    return dealt_join(keyed, edges.select(*KEY, "token"), KEY, "probe_id", "left").select("probe_id", "token")


def next_tokens_policy(allowed: DataFrame, policy: str) -> DataFrame:
    """How a search treats complete sequences.

    ``pass``: a probe followed by -1 alone has nothing allowed, all else stays.
    ``stop``: where -1 is among the tokens only 0 is allowed.
    """
    if policy not in ("pass", "stop"):
        raise ValueError(f"policy must be 'pass' or 'stop', not {policy!r}")
    allowed = allowed.select("probe_id", "token")
    # Only counts are gathered by probe. The tokens of a probe stay where they are, unless
    # it is one of those that a complete sequence decides.
    flags = allowed.groupBy("probe_id").agg(F.count("token").alias("n"), F.max(F.col("token") == TERMINAL).alias("ends"))
    decided = flags.filter("ends" if policy == "stop" else "ends AND n = 1").select("probe_id")
    decided = cut_lineage(decided)
    few = F.broadcast(decided) if fits(decided) else decided
    answer = F.lit(START_ID if policy == "stop" else None).cast("int").alias("token")
    return allowed.join(few, "probe_id", "left_anti").unionByName(decided.select("probe_id", answer))


def _of_outputs(sequences: DataFrame, outputs: DataFrame) -> DataFrame:
    """The stored sequences that are an output; outputs that are few are sent to them, so the others are not shuffled."""
    asked = outputs.select("tokens").distinct()
    return sequences.join(F.broadcast(asked), "tokens", "left_semi") if fits(asked) else sequences


def sequence_documents(outputs: DataFrame, sequences: DataFrame, which: str = "all") -> DataFrame:
    """Documents whose sequence equals an output's ``tokens``; one row per document.

    The join compares whole arrays; the documents of a sequence that very many share are
    dealt to several tasks. ``which='first'`` keeps the first inserted document of a sequence
    (least ``ord``) and drops the others before the join.
    """
    sequences = _of_outputs(sequences, outputs)
    if which == "first":
        docs = sequences.groupBy("tokens").agg(F.min_by("corpus_id", "ord").alias("corpus_id"))
    elif which == "all":
        docs = sequences.select("tokens", "corpus_id").distinct()
        return dealt_join(docs, outputs, ["tokens"], "corpus_id")
    else:
        raise ValueError(f"which must be 'all' or 'first', not {which!r}")
    return outputs.join(docs, "tokens")


def unmatched_sequences(outputs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Outputs that are no stored sequence."""
    return outputs.join(_of_outputs(sequences, outputs).select("tokens").distinct(), "tokens", "left_anti")


def enumerate_sequences(sequences: DataFrame) -> DataFrame:
    """Every distinct stored path down to the document id."""
    return sequences.select("tokens", "corpus_id").distinct()


def index_length(sequences: DataFrame) -> DataFrame:
    """Number of inserts, copies counted, and of distinct paths. Both are 0 when empty."""
    return sequences.agg(
        F.count(F.lit(1)).alias("n_inserts"), F.countDistinct("tokens", "corpus_id").alias("n_paths")
    )


def _stored(edges: DataFrame) -> DataFrame:
    """The index by depth in scratch space: it is built once, however many rounds ask it."""
    path = scratch_path(edges.sparkSession, "prefix-index")
    write_prefix_index(edges.select(*KEY, "token"), path)
    return read_prefix_index(edges.sparkSession, path, "h1 long, h2 long, token int, depth int")


def _walked(first: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes with ``matched``, the length of their longest beginning in the index.

    Every beginning of a stored path is in the index, so the length is found by bisection: a
    probe asks for one beginning a round, and a round reads only the depths that can be
    asked for in it (odd multiples of its step). All rounds together read the index once.
    """
    state = cut_lineage(probes.select("probe_id", "tokens", F.lit(0).alias("matched")))
    longest = state.agg(F.max(F.size("tokens"))).first()[0] or 0
    deepest = first.agg(F.max("depth")).first()[0] or 0
    most = min(longest, deepest)
    step = 1 << (most.bit_length() - 1) if most else 0
    while step:
        depth = F.col("matched") + step
        asks = depth <= F.least(F.size("tokens"), F.lit(most))
        h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
        asking = state.filter(asks).withColumn("depth", depth).withColumn("h1", h1).withColumn("h2", h2)
        nodes = first.filter(F.col("depth") % (2 * step) == step).select(*KEY).distinct().withColumn("_in", F.lit(True))
        reached = F.when(F.col("_in"), F.col("depth")).otherwise(F.col("matched"))
        answered = dealt_join(asking, nodes, KEY, "probe_id", "left").select("probe_id", "tokens", reached.alias("matched"))
        state = cut_lineage(answered.unionByName(state.filter(~asks)))
        step //= 2
    return state


def count_appended(first: DataFrame, second: DataFrame, begin_token: int, probes: DataFrame) -> DataFrame:
    """``(probe_id, n_tokens, begins)``: how many tokens ``append_index`` allows after each probe.

    ``begins`` tells whether the second index begins there. Its first tokens are counted
    once, not listed for every such probe.
    """
    first, second = _stored(first), _stored(second)
    walked = _walked(first, probes)
    whole = F.col("matched") == F.size("tokens")
    if second.isEmpty():
        starts, begin = F.lit(0), F.lit(False)
    else:
        starts = second.filter("depth = 0").agg(F.count(F.lit(1))).scalar()
        begin = F.coalesce(F.col("token") == begin_token, F.lit(False))
    inside = next_tokens(first, walked.filter(whole) if not second.isEmpty() else probes)
    counted = inside.groupBy("probe_id").agg(F.count(F.when(~begin, F.col("token"))).alias("n"), F.max(begin).alias("begins"))
    out = counted.select("probe_id", (F.col("n") + F.when(F.col("begins"), starts).otherwise(0)).alias("n_tokens"), "begins")
    if second.isEmpty():
        return out
    suffix = F.slice("tokens", F.col("matched") + 1, F.size("tokens"))
    beyond = next_tokens(second, walked.filter(~whole).select("probe_id", suffix.alias("tokens")))
    return out.unionByName(beyond.groupBy("probe_id").agg(F.count("token").alias("n_tokens")).withColumn("begins", F.lit(False)))


def append_index(first: DataFrame, second: DataFrame, begin_token: int, probes: DataFrame) -> DataFrame:
    """``next_tokens`` over two indexes, the second attached at ``begin_token``.

    A probe found in the first index gets its tokens there; ``begin_token`` among them is
    replaced by the root tokens of the second. A probe that leaves the first index part of
    the way is looked up in the second from the point where it left. An empty second index
    is ignored.
    """
    first, second = _stored(first), _stored(second)
    if second.isEmpty():
        return next_tokens(first, probes)
    walked = _walked(first, probes)
    whole = F.col("matched") == F.size("tokens")
    inside = cut_lineage(next_tokens(first, walked.filter(whole)))
    at_begin = F.col("token").eqNullSafe(F.lit(begin_token))
    begun = inside.filter(at_begin).select("probe_id")
    # Every such probe is followed by the same ids, so they are sent to the probes, not joined by one key.
    roots = cut_lineage(second.filter("depth = 0").select("token"))
    tasks = -(-begun.count() * roots.count() // _LISTED_ROWS)
    listed = begun.repartition(max(1, tasks)).crossJoin(F.broadcast(roots) if fits(roots) else roots)
    suffix = F.slice("tokens", F.col("matched") + 1, F.size("tokens"))
    left = walked.filter(~whole).select("probe_id", suffix.alias("tokens"))
    return inside.filter(~at_begin).unionByName(listed).unionByName(next_tokens(second, left))


def shared_sequences(sequences: DataFrame) -> DataFrame:
    """Groups of documents that cannot be told apart: least id and size of each group."""
    return (
        sequences.groupBy("tokens")
        .agg(F.min("corpus_id").alias("first_corpus_id"), F.count(F.lit(1)).alias("n_docs"))
        .filter(F.col("n_docs") > 1)
        .select("first_corpus_id", "n_docs")
    )


def _cover(batches):
    """Whether a whole path before it begins a path, and whether the next one goes on from it."""

    def listed(out):
        kinds = [pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.bool_()]
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["tokens", "shadowed", "continued", "first"])

    waiting, cover, last = None, 0, None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = [np.asarray(row, np.int64) for row in batch.column("tokens").to_pylist()]
        shared, out = _shared_lengths(rows, last).tolist(), []
        for row, common in zip(rows, shared):
            if waiting is not None:
                # cover: length of the shortest whole path that begins the last one
                out.append((*waiting, common == len(last), waiting_first))
            shadowed = last is not None and 0 < cover <= common
            if not shadowed:
                cover = len(row)
            waiting, waiting_first, last = (row.tolist(), shadowed), last is None, row
        yield listed([(tokens, shadowed, continued, first) for tokens, shadowed, continued, first in out])
    if waiting is not None:
        yield listed([(*waiting, False, waiting_first)])


def nested_paths(sequences: DataFrame) -> DataFrame:
    """``(tokens, shadowed, continued)`` of the distinct paths.

    ``shadowed``: another whole path is a proper beginning of it; ``continued``: it is one
    itself. In sorted order a beginning comes right before what goes on from it, so one walk
    over the neighbours finds both, but for paths that another partition continues. Those
    begin some partition's first path, so they are few and looked up by their keys.
    """
    paths = cut_lineage(distinct_paths(sequences).select("tokens").filter(F.size("tokens") > 0))
    walked = cut_lineage(_in_order(paths).mapInArrow(_cover, "tokens array<int>, shadowed boolean, continued boolean, first boolean"))
    firsts = with_prefixes(walked.filter("first").select("tokens"), 1).filter(F.col("depth") < F.size("tokens"))
    firsts = cut_lineage(firsts.select(*KEY, F.slice("tokens", F.lit(1), F.col("depth")).alias("begun")).distinct())
    few = F.broadcast(firsts) if fits(firsts) else firsts
    across = cut_lineage(with_key(paths).join(few, KEY).filter(F.col("tokens") == F.col("begun")).select(*KEY, F.col("tokens").alias("begun")))
    # Paths are as long as the sequences at most, so these are few numbers.
    depths = [row["depth"] for row in across.select("depth").distinct().collect()]
    if not depths:
        return walked.drop("first")
    few = F.broadcast(across) if fits(across) else across
    at = F.explode(F.array(*map(F.lit, depths)))
    h1, h2 = prefix_hashes(F.col("tokens"), F.col("depth"))
    begun = walked.select("tokens", at.alias("depth")).filter(F.col("depth") <= F.size("tokens")).withColumn("h1", h1).withColumn("h2", h2)
    met = begun.join(few, KEY).filter(F.slice("tokens", F.lit(1), F.col("depth")) == F.col("begun"))
    marks = met.groupBy("tokens").agg(F.max(F.col("depth") < F.size("tokens")).alias("behind"), F.max(F.col("depth") == F.size("tokens")).alias("ahead"))
    none = F.lit(False)
    return walked.join(marks, "tokens", "left").select(
        "tokens", (F.col("shadowed") | F.coalesce("behind", none)).alias("shadowed"), (F.col("continued") | F.coalesce("ahead", none)).alias("continued")
    )


def shadowed_documents(sequences: DataFrame) -> DataFrame:
    """Documents a search never reaches, as another whole sequence is a proper prefix of theirs."""
    shadowed = nested_paths(sequences).filter("shadowed").select("tokens")
    return sequences.join(shadowed, "tokens", "left_semi").select("corpus_id")


def prefix_fanout(edges: DataFrame) -> DataFrame:
    """Branching by depth: prefixes, edges, and the widest prefix."""
    per_prefix = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("fanout"))
    return per_prefix.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n_prefixes"), F.sum("fanout").alias("n_edges"), F.max("fanout").alias("max_fanout")
    )


def write_prefix_index(edges: DataFrame, path: str) -> None:
    """Parquet in one folder per depth, so that a search step reads a single depth.

    Rebalancing gives a depth as many tasks and files as its rows need.
    """
    with shuffles_dropped(edges.sparkSession):
        edges.hint("rebalance", "depth").write.mode("overwrite").partitionBy("depth").parquet(path, compression="zstd")


def read_prefix_index(spark, path: str, schema: str = EDGE_SCHEMA) -> DataFrame:
    """The schema is given, not inferred: an empty index has no file to read it from."""
    return spark.read.schema(schema).parquet(path)


def index_path(root: str, task: str, max_length: int, generator: str, chunked: bool) -> str:
    """Where the index of a task, length, generator and chunking mode is kept."""
    return f"{root}/task={task}/max_length={max_length}/generator={generator}/chunked={str(chunked).lower()}"


def prefix_index(spark, path: str, build, create: bool) -> DataFrame:
    """Build and store the index, or reload the stored one."""
    if create:
        write_prefix_index(build(), path)
    return read_prefix_index(spark, path)
