"""Near-duplicates of word shingles: banded MinHash, odd sketches, exact verification.

1. Each document becomes the set of its distinct five-word shingles (64-bit hashes).
   Documents with equal sets form a class, and only classes are compared.
2. A class has 100 MinHash samples. Bands of four are bucket keys: a pair of similarity
   0.75 shares none of the 25 buckets with a chance below 1 in 10,000.
3. The samples are also folded into an odd sketch: a bitmap of the parities of (sample,
   value) pairs. The number of ones in the XOR of two sketches estimates the similarity,
   so a candidate that is far too different goes before any set is read.
4. What is left is verified on the full sets. First each bucket's classes are compared
   with one of them, in two rounds; then only classes of a bucket that are not yet
   connected are compared with each other. A group of n near copies costs n comparisons, not n squared,
   and no link between different components is left out.

Defined results: words are runs without ASCII blanks, A-Z in lower case. A text of fewer
than five words is one shingle; one without words, or a null, has no shingles and links
with nothing. A row with a null ``doc_id`` links with nothing, has no component and is
kept. Rows that repeat a ``doc_id`` count as one document (with different texts: each
text has its own links, and they are linked through the id). An empty table gives no rows;
texts of any length are read whole, and so is a set that is compared. Extra columns are not
read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import bloom
from rankloom.llm.common import HASH_ENTRIES, kept_in_worker, slices, texts
from rankloom.llm.components import components, joined_by
from rankloom.operators.ordering import number_all
from rankloom.session import cut_lineage

WORDS = 5
SAMPLES = 100
BAND_ROWS = 4
SKETCH_BITS = 512
# A candidate whose sketches estimate less than this is not verified; the standard error
# at 0.75 is below 0.05.
SKETCH_FLOOR = 0.5
# Classes of one bucket that are compared with each other get sketches of more samples
# (standard error 0.01), which tell a pair just below the bound from one above it.
SHARP_SAMPLES, SHARP_BITS, SHARP_FLOOR = 2048, 4096, 0.7
# Copies of a set that meets many others are dealt to as many tasks as it has blocks.
PAIRS_PER_BLOCK = 200
# Classes of one bucket that meet each other are dealt to blocks of about this many.
BLOCK_CLASSES = 2048

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = values + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        parts, known = text.encode().lower().split(), self.known
        if not parts:
            return np.empty(0, np.uint64)
        new = set(parts).difference(known)
        if len(known) + len(new) > HASH_ENTRIES:
            known.clear()
            new = set(parts)
        for word in new:
            known[word] = xxhash.xxh3_64_intdigest(word)
        codes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        width = min(self.words, len(codes))
        n = len(codes) - width + 1
        with np.errstate(over="ignore"):
            total = np.full(n, np.uint64(width), np.uint64)
            for at in range(width):
                total = mix(total ^ codes[at : at + n])
        return np.unique(total)


def shingler(words: int) -> Shingler:
    return kept_in_worker(("shingles", words), lambda: Shingler(words))


@functools.lru_cache(maxsize=4)
def _factors(samples: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(2 * samples, dtype=np.uint64))
    return seeds[:samples] | np.uint64(1), seeds[samples:]


def minhash(shingles: np.ndarray, samples: int) -> np.ndarray:
    odd, flips = _factors(samples)
    least = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        step = max(1, (1 << 18) // samples)
        for start in range(0, len(shingles), step):
            block = shingles[start : start + step, None]
            least = np.minimum(least, ((block ^ flips) * odd).min(axis=0))
    return least


def odd_sketch(values: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the (sample, value) pairs per bit, as 64-bit words."""
    with np.errstate(over="ignore"):
        places = mix(values ^ mix(np.arange(len(values), dtype=np.uint64))) % np.uint64(bits)
    ones = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).view(np.int64)


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    groups = values[: len(values) // rows * rows].reshape(-1, rows)
    key = np.arange(len(groups), dtype=np.uint64)
    for at in range(rows):
        key = mix(key ^ groups[:, at])
    return key.view(np.int64)


def profiles(docs: DataFrame, words: int = WORDS, samples: int = SAMPLES) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, sketch, bands)``: set_a and set_b identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shingler(words)
        for batch in slices(batches):
            rows = []
            for text in texts(batch):
                found = made.shingles(text)
                if len(found):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                    values = minhash(found, samples)
                    rows.append((len(found), int(digest[0]), int(digest[1]), odd_sketch(values, SKETCH_BITS), bands(values, BAND_ROWS)))
                else:
                    rows.append((0, 0, 0, None, None))
            n, a, b, sketch, keys = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(a, pa.int64()),
                    pa.array(b, pa.int64()),
                    pa.array(sketch, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch array<bigint>, bands array<bigint>"
    )


def sketch_distance(a: Column, b: Column, bits: int = SKETCH_BITS) -> Column:
    """Ones in the XOR of two sketches."""
    words = range(bits // 64)
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in words), F.lit(0))


def sketch_bound(floor: float = SKETCH_FLOOR, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """The expected distance of a pair whose similarity is ``floor``."""
    different = 2 * samples * (1 - floor)
    return int(np.ceil(bits / 2 * (1 - (1 - 2 / bits) ** different)))


def chosen_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the documents with the given ids (and maybe of a few others).

    A Bloom filter of the ids, of bounded size, picks the documents in the scan, so their
    texts are not shuffled; more ids than it can hold are met by a join.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("id IS NOT NULL")
    made, chosen = bloom.holding(named, ids, F.col("id"), F.col("id"))
    return named.join(ids, "id", "left_semi") if made is None else chosen


def set_names(found: list[np.ndarray]) -> list[pa.Array]:
    """``set_a`` and ``set_b`` of shingle sets; 0 for an empty one."""
    names = np.zeros((len(found), 2), np.int64)
    for at, shingles in enumerate(found):
        if len(shingles):
            names[at] = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
    return [pa.array(names[:, 0]), pa.array(names[:, 1])]


def of_classes(docs: DataFrame, wanted: DataFrame, words: int, name: str, kind: str, make) -> DataFrame:
    """``(rep, name)``: what ``make`` says of the shingle sets of the classes ``(rep, doc, set_a, set_b)``.

    A class is found by a document's id and the set itself, as an id may repeat with other texts.
    """
    keys = ["id", "set_a", "set_b"]

    def run(batches):
        made = shingler(words)
        for batch in slices(batches):
            found = [made.shingles(text) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *set_names(found), make(found)], [*keys, name])

    wanted = wanted.select("rep", F.col("doc").alias("id"), "set_a", "set_b")
    made = chosen_texts(docs, wanted.select("id").distinct()).mapInArrow(run, f"id bigint, set_a bigint, set_b bigint, {name} {kind}")
    return made.groupBy(*keys).agg(F.max(name).alias(name)).join(wanted, keys).select("rep", name)


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(rep, hashes)`` of the shingle sets of the given classes."""
    return of_classes(docs, wanted, words, "hashes", "binary", lambda found: pa.array([x.tobytes() for x in found], pa.binary()))


def sharp_sketches(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(rep, sharp)``: sketches of many samples of the given classes."""

    def make(found):
        return pa.array([odd_sketch(minhash(x, SHARP_SAMPLES), SHARP_BITS) for x in found], pa.list_(pa.int64()))

    return of_classes(docs, wanted, words, "sharp", "array<bigint>", make)


def numbered(filled: DataFrame, made: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Classes with a number ``rep`` of their own, and pairs of classes that share a document's id.

    The number is the smallest id; where an id repeats with other texts, it is the place by smallest id and set.
    """
    name = F.struct("set_a", "set_b")
    several = filled.groupBy("doc_id").agg(F.min(name).alias("low"), F.max(name).alias("high")).filter("low <> high").select("doc_id")
    several = cut_lineage(several)
    if not several.limit(1).count():
        return made.withColumn("rep", F.col("doc")), None
    classes = number_all(made, [F.col("doc"), F.col("set_a"), F.col("set_b")], "rep")
    classes = cut_lineage(classes)
    texts_of = filled.join(several, "doc_id").select("doc_id", "set_a", "set_b").distinct().join(classes.select("rep", "set_a", "set_b"), ["set_a", "set_b"])
    first = texts_of.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return classes, cut_lineage(texts_of.join(first, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct())


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union of their full sets."""
    reps = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = cut_lineage(sets_of(docs, classes.join(reps, "rep"), words))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_BLOCK).cast("int").alias("n_blocks"))
    left = (
        blocks.join(sets, F.col("a") == F.col("rep"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select("a", "block", F.col("hashes").alias("hashes_a"))
    )
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "n_blocks").cast("int").alias("block"))
    right = dealt.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hashes_b")), "b")

    def run(batches):
        for batch in slices(batches, "hashes_a", "hashes_b"):
            hits = []
            for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                hits.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hits))

    return right.join(left, ["a", "block"]).select("a", "b", "hashes_a", "hashes_b").mapInArrow(run, "a bigint, b bigint")


def met_in_blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of rows of one bucket with different ``at``, each once, as ``columns`` with _a and _b.

    A bucket is cut into blocks by the hash of ``rep``, as many as its size asks for, and
    each two blocks meet under a key of their own: no task gets all of a large bucket.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("blocks"))
    placed = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))

    def side(end: str, s: Column, t: Column) -> DataFrame:
        return placed.select("bucket", s.alias("s"), t.alias("t"), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    left = side("a", F.col("own"), F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0), "own")), F.col("own"))
    once = (F.col("s") < F.col("t")) | (F.col("rep_a") < F.col("rep_b"))
    return left.hint("merge").join(right, ["bucket", "s", "t"]).filter((F.col("at_a") != F.col("at_b")) & once)


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    made = cut_lineage(profiles(docs, words))
    filled = made.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut_lineage(
        filled.groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")
        )
    )
    classes, links = numbered(filled, classes)
    repeated = links is not None
    sketches, bound = classes.select("rep", "sketch"), sketch_bound()
    placed = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = cut_lineage(placed.join(shared, "bucket").select("bucket", "rep", F.col("rep").alias("at")))

    def close(pairs: DataFrame) -> DataFrame:
        of_a = sketches.select(F.col("rep").alias("a"), F.col("sketch").alias("sketch_a"))
        of_b = sketches.select(F.col("rep").alias("b"), F.col("sketch").alias("sketch_b"))
        both = pairs.join(of_a, "a").join(of_b, "b")
        return both.filter(sketch_distance(F.col("sketch_a"), F.col("sketch_b")) <= bound).select("a", "b")

    def relabelled(members: DataFrame, at: DataFrame) -> DataFrame:
        """Members of the buckets that hold more than one component."""
        now = (
            members.select("bucket", "rep")
            .join(at, F.col("rep") == F.col("node"), "left")
            .select("bucket", "rep", F.coalesce("component", "rep").alias("at"))
        )
        apart = now.groupBy("bucket").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low < high")
        return cut_lineage(now.join(apart.select("bucket"), "bucket"))

    at = None
    # What is done for links costs the new ones only, and nothing once no bucket holds classes that are apart.
    # Stars: first around each bucket's smallest id, which is the same class in many buckets;
    # then around one by hash, which is another class in every bucket.
    for place in (F.col("rep"), F.xxhash64("bucket", "rep")):
        if members.isEmpty():
            break
        leaders = members.groupBy("bucket").agg(F.min_by(F.struct("rep", "at"), place).alias("leader"))
        star = members.join(leaders, "bucket").filter(F.col("at") != F.col("leader.at"))
        pairs = star.select(F.least("rep", "leader.rep").alias("a"), F.greatest("rep", "leader.rep").alias("b")).distinct()
        found = verified(cut_lineage(close(pairs)), docs, classes, words, percent)
        found = cut_lineage(found)
        at = joined_by(at, found) if at is not None else components(found if links is None else links.union(found))
        members = relabelled(members, at)
    if at is None:
        at = components(links if links is not None else members.select(F.col("rep").alias("a"), F.col("at").alias("b")))

    # Classes of one bucket that the stars left apart meet each other, in the first bucket
    # they share.
    if not members.isEmpty():
        sharp = cut_lineage(sharp_sketches(docs, classes.join(members.select("rep").distinct(), "rep"), words))
        rows = cut_lineage(members.join(classes.select("rep", "bands"), "rep").join(sharp, "rep").select("bucket", "rep", "at", "bands", "sharp"))
        near = sketch_distance(F.col("sharp_a"), F.col("sharp_b"), SHARP_BITS) <= sketch_bound(SHARP_FLOOR, SHARP_SAMPLES, SHARP_BITS)
        common = F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        crossing = met_in_blocks(rows, ["rep", "at", "bands", "sharp"]).filter(near & (F.get(common, F.lit(0)) == F.col("bucket")))
        pairs = cut_lineage(crossing.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")))
        at = joined_by(at, cut_lineage(verified(pairs, docs, classes, words, percent)))

    placed_classes = classes.join(at, F.col("rep") == F.col("node"), "left").select(
        "set_a", "set_b", F.coalesce("component", "rep").alias("component")
    )
    if repeated:
        named = classes.select(F.col("rep").alias("component"), "doc")
        placed_classes = placed_classes.join(named, "component").select("set_a", "set_b", F.col("doc").alias("component"))
    placed_classes = cut_lineage(placed_classes)
    return (
        made.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(placed_classes, ["set_a", "set_b"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component")))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
