"""Near-duplicates of vectors by an inverted multi-index.

Vectors of unit length are cut into halves. Each half has a codebook of its own, and the
pairs of codes form a grid of cells; every vector lies in the cell of its nearest codes. A
query visits cells in the order of a lower bound of the distance to anything inside them,
by traversing the two sorted code lists together, and stops at the bound that reaches the
target recall (measured on a sample when the codebooks are fitted; never more than the
bound that no linked pair exceeds). Cosines of the vectors met are then computed exactly.

Equal vectors of a label form a class and only classes are compared. A cell's vectors and
its visitors are dealt to blocks of bounded size, so a crowded cell becomes many tasks. A
block returns counts and a spanning forest, never its pairs.

Defined results: vectors that are null, empty or zero, or hold a null or a number that is
not finite, and rows with a null id or label, link with nothing; vectors of different
length link with nothing; one component is compared by its sign; repeated rows are vectors
of their own, and so are rows that repeat an id with other vectors; labels of any type are
equal as strings; components of doubles stay doubles; codes at equal distance are taken in
their order; vectors of any length are read whole; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.components import components
from rankloom.operators.ordering import number_all
from rankloom.session import cut_lineage

SAMPLE_ROWS = 20_000
CODES_MAX = 1024
TARGET_RECALL = 0.999
ASKED = 4000
BLOCK_ROWS = 512
_SCHEMA = "rep bigint, label string, w bigint, vector array<{kind}>, cell int, visits array<int>"


def code_count(rows: int) -> int:
    """Codes per half: the number of cells grows with the square root of the rows."""
    return int(min(CODES_MAX, max(2, 2 ** round(np.log2(max(rows, 1)) / 4))))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def k_means(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    random = np.random.default_rng(0)
    codes = rows[random.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        nearest = squared_distances(rows, codes).argmin(axis=1)
        for code in range(len(codes)):
            mine = rows[nearest == code]
            if len(mine):
                codes[code] = mine.mean(axis=0)
    return codes


class Index:
    """Two codebooks and the bound at which a traversal stops."""

    def __init__(self, halves: list[np.ndarray], bound: float):
        self.halves, self.bound = halves, bound
        self.gaps = [np.sqrt(squared_distances(codes, codes)) for codes in halves]

    def half_bounds(self, rows: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest code, and for each code a lower bound of the squared distance to its side of the border."""
        far = squared_distances(rows, self.halves[half])
        nearest = far.argmin(axis=1)
        ahead = far - far[np.arange(len(rows)), nearest][:, None]
        least = np.maximum(ahead, 0) / np.maximum(2 * self.gaps[half][nearest], 1e-12)
        least[np.arange(len(rows)), nearest] = 0
        return nearest, least**2

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        cut, width = rows.shape[1] // 2, len(self.halves[1])
        (first, low_a), (second, low_b) = self.half_bounds(rows[:, :cut], 0), self.half_bounds(rows[:, cut:], 1)
        order_a, order_b = low_a.argsort(axis=1, kind="stable"), low_b.argsort(axis=1, kind="stable")
        cells = first * width + second
        visits = []
        for i, own in enumerate(cells.tolist()):
            met = self.traverse(low_a[i][order_a[i]], low_b[i][order_b[i]])
            visited = [own, *(c for a, b in met if (c := int(order_a[i][a]) * width + int(order_b[i][b])) != own)]
            visits.append(np.array(visited, np.int32))
        return cells.astype(np.int32), visits

    def traverse(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places in two ascending lists by ascending sum, up to the bound (multi-sequence order)."""
        a, b = a.tolist(), b.tolist()
        heap, seen = [(a[0] + b[0], 0, 0)], {(0, 0)}
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > self.bound:
                return
            yield i, j
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[x] + b[y], x, y))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # Scaled first, so that no square overflows or vanishes.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_index(sample: np.ndarray, rows: int, threshold: float, recall: float = TARGET_RECALL) -> Index:
    """Codebooks of a sample, and the bound found by asking for partners at the threshold itself."""
    made = unit(sample)
    cut, k = made.shape[1] // 2, code_count(rows)
    index = Index([k_means(made[:, :cut], k), k_means(made[:, cut:], k)], 0.0)
    random = np.random.default_rng(1)
    # The vectors of a small sample are asked for several partners each.
    asked = made[np.resize(random.permutation(len(made)), ASKED)]
    aside = random.standard_normal(asked.shape)
    aside -= (aside * asked).sum(1, keepdims=True) * asked
    aside /= np.maximum(np.sqrt((aside * aside).sum(1, keepdims=True)), 1e-12)
    partner = threshold * asked + np.sqrt(1 - threshold**2) * aside
    cost = np.zeros(len(asked))
    for half, part in enumerate((slice(None, cut), slice(cut, None))):
        lows = index.half_bounds(asked[:, part], half)[1]
        cost += lows[np.arange(len(asked)), index.half_bounds(partner[:, part], half)[0]]
    # Unit vectors of this cosine are never further apart than the last term.
    index.bound = float(min(np.quantile(cost, recall), 2 - 2 * threshold + 1e-9))
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(classes: DataFrame, index: Index) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells, visits = shared.value.place(unit(_matrix(batch.column("vector"))))
                columns = [batch.column(n) for n in ("rep", "label", "w", "vector")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cells), pa.array(visits, pa.list_(pa.int32()))],
                    ["rep", "label", "w", "vector", "cell", "visits"],
                )

    kind = classes.schema["vector"].dataType.elementType.simpleString()
    return classes.select("rep", "label", "w", "vector").mapInArrow(run, _SCHEMA.format(kind=kind))


def _forest(hits: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """For each row and column with a hit, an edge to the smallest id of its block component."""
    top, side = left.copy(), right.copy()
    largest = np.iinfo(np.int64).max
    while True:
        new_side = np.minimum(side, np.where(hits, top[:, None], largest).min(axis=0))
        new_top = np.minimum(top, np.where(hits, new_side[None, :], largest).min(axis=1))
        if (new_side == side).all() and (new_top == top).all():
            break
        top, side = new_top, new_side
    nodes = np.concatenate((np.stack((left, top), 1)[hits.any(axis=1)], np.stack((right, side), 1)[hits.any(axis=0)]))
    return np.unique(nodes, axis=0)


def _compare(threshold: float):
    names = ["rep", "links", "other"]

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        if asks.all() or not asks.any():
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        ids, w = table.column("rep").to_numpy(), table.column("w").to_numpy()
        made, cells = unit(_matrix(table.column("vector"))), table.column("home").to_numpy()
        q, h = np.flatnonzero(asks), np.flatnonzero(~asks)
        hits = (made[q] @ made[h].T >= threshold) & (ids[q][:, None] != ids[h][None, :])
        if not hits.any():
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        # A pair that each side finds by its own visit is counted by each for itself.
        asked_cells, at = np.unique(cells[q], return_inverse=True)
        visits = [set(v) for v in table.column("visits").take(pa.array(h)).to_pylist()]
        back = np.array([[int(c) in v for v in visits] for c in asked_cells])[at]
        found = np.concatenate((np.stack((ids[q], (hits * w[h]).sum(axis=1)), 1), np.stack((ids[h], ((hits & ~back) * w[q][:, None]).sum(axis=0)), 1)))
        found = found[found[:, 1] > 0]
        edges = _forest(hits, ids[q], ids[h])
        none = np.zeros(len(edges), np.int64)
        return pa.table(
            {
                "rep": pa.array(np.concatenate((found[:, 0], edges[:, 0]))),
                "links": pa.array(np.concatenate((found[:, 1], none))),
                "other": pa.array(np.concatenate((found[:, 0], edges[:, 1]))),
            }
        )

    return run


def class_links(classes: DataFrame, index: Index, threshold: float) -> DataFrame:
    """``(rep, links, other)``: partial link counts of classes, and edges that connect the linked ones."""
    placed = cut_lineage(_placed(classes, index))
    homes = placed.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("home_blocks"))
    visits = placed.select("label", F.explode("visits").alias("cell"))
    asks = visits.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("ask_blocks"))
    blocks = cut_lineage(homes.join(asks, ["label", "cell"]))
    columns = ["label", "cell", "s", "t", "asks", "rep", "w", "vector", "home", "visits"]

    def of(name):
        return F.pmod(F.xxhash64("rep"), name).cast("int")

    def all_of(name):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    at_home = placed.withColumn("home", F.col("cell")).join(blocks, ["label", "cell"])
    at_home = at_home.withColumn("asks", F.lit(False)).withColumn("s", of("home_blocks")).withColumn("t", all_of("ask_blocks"))
    asking = placed.withColumnRenamed("cell", "home").withColumn("cell", F.explode("visits")).join(blocks, ["label", "cell"])
    asking = asking.withColumn("asks", F.lit(True)).withColumn("t", of("ask_blocks")).withColumn("s", all_of("home_blocks"))
    dealt = at_home.select(columns).union(asking.select(columns))
    return dealt.groupBy("label", "cell", "s", "t").applyInArrow(_compare(threshold), "rep bigint, links bigint, other bigint")


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType()) else "double"
    numbers = F.col("embedding").cast(f"array<{kind}>")
    good = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = good & (F.size(numbers) > 0) & F.exists(numbers, lambda x: x != 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.when(F.coalesce(usable, F.lit(False)), numbers).alias("vector"),
    )
    # Adding 0 makes equal vectors equal bit by bit.
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind))).withColumn("size", F.size("vector"))
    keyed = rows.withColumn("key_a", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector"))).withColumn(
        "key_b", F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(1), "vector", "label"))
    )
    # A vector of one component has no halves: a zero behind it changes no cosine.
    zero = F.when(F.col("size") == 1, F.array(F.lit(0.0).cast(kind))).otherwise(F.array().cast(f"array<{kind}>"))
    classes = cut_lineage(
        keyed.filter("vector IS NOT NULL")
        .groupBy("key_a", "key_b")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("w"), F.first("label").alias("label"), F.first("size").alias("size"), F.first("vector").alias("vector"))
        .withColumn("vector", F.concat("vector", zero))
    )
    # A class is named by its smallest id, or by its place where an id occurs with several vectors.
    repeated = classes.groupBy("first").count().filter("count > 1").limit(1).count() > 0
    if repeated:
        classes = cut_lineage(number_all(classes, [F.asc("first"), F.asc("key_a"), F.asc("key_b")], "rep"))
    else:
        classes = classes.withColumn("rep", F.col("first"))
    sizes = [(r["n"], r["rows"]) for r in classes.groupBy(F.col("size").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy("n").collect()]
    found = spark.createDataFrame([], "rep bigint, links bigint, other bigint")
    for size, count in sizes:
        of_size = classes.filter(F.col("size") == size)
        # At most SAMPLE_ROWS vectors reach the driver.
        sample = of_size.select("rep", "vector").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).toArrow()
        index = fit_index(_matrix(sample.column("vector")), count, threshold)
        found = found.union(class_links(of_size, index, threshold))
    found = cut_lineage(found)
    at = components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    judged = cut_lineage(
        classes.select("key_a", "key_b", "rep", "w")
        .join(links, "rep", "left")
        .join(at, F.col("rep") == F.col("node"), "left")
        .select("key_a", "key_b", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    if repeated:
        names = classes.select(F.col("rep").alias("component"), "first")
        judged = cut_lineage(judged.join(names, "component").select("key_a", "key_b", "links", F.col("first").alias("component")))
    return (
        keyed.select("vec_id", "key_a", "key_b")
        .join(judged, ["key_a", "key_b"], "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
