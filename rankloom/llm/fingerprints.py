"""Document fingerprints: sums of wide vectors hashed from paragraphs.

A paragraph (a line) is hashed to a wide vector: eight lanes of 32 bits from the whole
paragraph, and 64 signed lanes in which each of its pieces of up to eight words counts +1
or -1. A document's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo
2^32. So it does not depend on the paragraphs' order, and a paragraph is inserted by
adding its vector and deleted by subtracting it. Fingerprints are equal if the paragraphs
are; the signed lanes estimate how much two documents share: their cosine is 1 for equal
pieces and near 0 for unrelated ones, whatever the lengths.

Everything is DataFrame functions: texts are taken apart with ``explode`` and the lanes
are plain sums, so Spark adds up inside the tasks that read a text.

Defined results: a null text is an empty one, whose fingerprint is 0 in every lane; empty
paragraphs add nothing; rows that repeat another's id and text are one document in the
order and get one result each; rows with a null ``doc_id`` come first in the order; a
single document is its own next one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import row_key
from rankloom.operators.ordering import number_all
from rankloom.session import cut_lineage

EXACT_LANES = 8
SIGNED_LANES = 64
LANE = (1 << 32) - 1
# Pieces of a paragraph: up to eight words.
PIECE = r"\S+(?:\s+\S+){0,7}"
KEYS = ["key_id", "key_text"]


def _modulo(total: Column) -> Column:
    return total.bitwiseAND(F.lit(LANE))


def lane_sums(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and the sums ``e0..`` and ``s0..`` over the text's paragraphs and their pieces."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.col(text), "\n")).alias("paragraph"))
    pieces = paragraphs.select(*keys, "paragraph", F.posexplode_outer(F.regexp_extract_all("paragraph", F.lit(PIECE), F.lit(0))).alias("at", "piece"))
    # A paragraph's own hash counts with its first piece, or alone where it has none.
    own = (F.coalesce(F.col("at"), F.lit(0)) == 0) & (F.col("paragraph") != "")
    # The number comes first, as a seed: the paragraph itself is hashed for every word.
    words = [F.when(own, F.xxhash64(F.lit(i), "paragraph")).otherwise(F.lit(0)).alias(f"h{i}") for i in range(EXACT_LANES // 2)]
    hashed = pieces.select(*keys, *words, F.when(F.col("piece").isNotNull(), F.xxhash64("piece")).alias("p"))
    exact = [
        F.sum(_modulo(F.shiftright(f"h{i}", shift))).alias(f"e{2 * i + shift // 32}") for i in range(EXACT_LANES // 2) for shift in (0, 32)
    ]
    signed = [F.sum(F.coalesce(1 - 2 * F.shiftright("p", j).bitwiseAND(F.lit(1)), F.lit(0))).alias(f"s{j}") for j in range(SIGNED_LANES)]
    return hashed.groupBy(*keys).agg(*exact, *signed)


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``lanes``: the exact lanes, then the signed ones, each modulo 2^32."""
    names = [f"e{i}" for i in range(EXACT_LANES)] + [f"s{j}" for j in range(SIGNED_LANES)]
    return lane_sums(texts, keys, text).select(*keys, F.array(*[_modulo(F.col(n)) for n in names]).alias("lanes"))


def inserted(lanes: Column, paragraph: Column) -> Column:
    """Lanes of the document with one more paragraph, whose own lanes are ``paragraph``."""
    return F.zip_with(lanes, paragraph, lambda a, b: _modulo(a + b))


def deleted(lanes: Column, paragraph: Column) -> Column:
    """Lanes of the document with one paragraph less."""
    return F.zip_with(lanes, paragraph, lambda a, b: _modulo(a - b))


def as_text(lanes: Column) -> Column:
    """The lanes in hexadecimal, eight digits each."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _signed(lanes: Column) -> Column:
    part = F.slice(lanes, EXACT_LANES + 1, SIGNED_LANES)
    return F.transform(part, lambda x: F.when(x > LANE // 2, x - (LANE + 1)).otherwise(x).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the cosine of the signed lanes, at least 0."""
    x, y = _signed(a), _signed(b)
    size = F.sqrt(_dot(x, x) * _dot(y, y))
    near = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / size))).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(near)


def _links(docs: DataFrame) -> DataFrame:
    """Per distinct row its own key, size and ``copies``, the previous document's key and how many characters that one wants."""
    sizes = docs.select(*row_key(), "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    rows = sizes.groupBy(*KEYS, "doc_id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("key_text")]
    numbered = cut_lineage(number_all(rows, order, "number"))
    count = numbered.count()
    before = numbered.select(
        F.pmod(F.col("number") + 1, F.lit(max(count, 1))).alias("number"),
        F.col("key_id").alias("prev_id"),
        F.col("key_text").alias("prev_text"),
        F.floor(F.col("n") / 4).alias("wanted"),
    )
    return cut_lineage(numbered.join(before, "number").select(*KEYS, "doc_id", "copies", "prev_id", "prev_text", "wanted"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """Each distinct row with its key, its text, and its text edited with the next document's first characters.

    ``(doc_id, key_id, key_text, copies, prev_id, prev_text, n_chars, text, edited)``
    """
    links = _links(docs)
    # The id comes from the links: with only keys and text, both uses of ``own`` shuffle the
    # same columns of the documents, and Spark does it once.
    keyed = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    own = keyed.join(links, KEYS)
    if links.filter("copies > 1").limit(1).count():
        own = own.dropDuplicates(KEYS)
    heads = own.select(F.col("prev_id").alias("key_id"), F.col("prev_text").alias("key_text"), F.substring("text", F.lit(1), F.col("wanted").cast("int")).alias("head"))
    n = F.length("text")
    kept = F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int"))
    return own.join(heads, KEYS).select(
        "doc_id", *KEYS, "copies", "prev_id", "prev_text", n.cast("bigint").alias("n_chars"), "text", F.concat(kept, "head").alias("edited")
    )


def edit_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row."""
    both = edited_texts(docs).select(
        "doc_id", *KEYS, "copies", "prev_id", "prev_text", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edit"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("body")))).alias("v"),
    ).select("*", "v.is_edit", "v.body")
    carried = ["doc_id", *KEYS, "copies", "prev_id", "prev_text", "n_chars", "edited_sha256", "is_edit"]
    made = cut_lineage(fingerprints(both, carried, "body"))
    plain, edits = made.filter("NOT is_edit"), made.filter("is_edit")
    edits = edits.select(*KEYS, F.col("lanes").alias("edited_lanes"))
    following = plain.select(F.col("prev_id").alias("key_id"), F.col("prev_text").alias("key_text"), F.col("lanes").alias("next_lanes"))
    joined = plain.join(edits, KEYS).join(following, KEYS)
    once = joined.select(
        "copies", "doc_id", "n_chars", "edited_sha256", as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
    # As many rows as there were.
    return once.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
