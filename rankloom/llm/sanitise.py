"""Personal data and the words that give it away, by corpus statistics.

Addresses and numbers are found by their patterns. Each distinct one is a protected entity.
How much a word tells about an entity is measured over the corpus: their pointwise mutual
information, log2(n(word, entity) N / (n(word) n(entity))), against what there is to know,
the entity's own information, log2(N / n(entity)). N counts documents; a word goes with an
entity in a document where it stands within ``CONTEXT`` characters before or behind it. A
word that tells all of it (it occurs with the entity only) is removed; one that tells at
least 1/``ALPHA`` of it is generalised. Such words become spans wherever they occur, also
in documents that do not name the entity.

Evidence must come from ``SUPPORT`` different surroundings, so copies of one passage alone
prove nothing.

DataFrame functions only. Positions are code points: the texts between matches are measured
and summed up.

Defined results: a null text is an empty one, without spans; an empty table gives no rows;
repeated rows count as often as they occur, and each has the same spans; words are compared
in lower case; an added span that meets a base span is left out; texts of any length are
read whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.bloom import holding
from rankloom.llm.common import row_key
from rankloom.session import cut_lineage, fits

KINDS = ["email", "ip", "card", "phone"]
ADDED = "term"
CONTEXT = 60
SUPPORT = 3
ALPHA = 1.1
MARKS = {"remove": "", "generalise": "[word]", **{kind: f"[{kind}]" for kind in KINDS}}

# The given patterns. A run is begun at its first sign only and never given back, which finds
# the same matches but takes no second look at a long run.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for the pattern to be tried.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
LETTERS = r"[\p{L}\p{M}]+"
_KEY = ["key_id", "key_text"]
# Lengths are summed up in blocks of so many.
_BLOCK = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, x: total + x)


def _sums_before(numbers: Column) -> Column:
    """For each place of an array of ints the sum of all places before it."""
    n = F.size(numbers)

    def in_blocks(heads: Column) -> Column:
        def at(i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return F.get(heads, block) + _sum(F.slice(numbers, block * _BLOCK + 1, i % _BLOCK))

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    last = F.floor((n - 1) / _BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda j: _sum(F.slice(numbers, j * _BLOCK + 1, F.lit(_BLOCK))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("heads"))
    heads = F.aggregate(
        blocks,
        start,
        lambda held, x: F.struct((held["total"] + x).alias("total"), F.concat(held["heads"], F.array(held["total"])).alias("heads")),
    )["heads"]
    return F.when(n > 0, _let(heads, in_blocks)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches, leftmost first: ``array<struct<start, end, value, before, behind>>`` with the texts around."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def placed(both: Column) -> Column:
        values, gaps = both["values"], both["gaps"]
        steps = F.zip_with(gaps, values, lambda gap, value: F.length(gap) + F.coalesce(F.length(value), F.lit(0)))

        def with_starts(sums: Column) -> Column:
            return F.transform(
                values,
                lambda value, i: F.struct(
                    (F.get(sums, i) + F.length(F.get(gaps, i))).alias("start"),
                    (F.get(sums, i) + F.length(F.get(gaps, i)) + F.length(value)).alias("end"),
                    value.alias("value"),
                    F.get(gaps, i).alias("before"),
                    F.get(gaps, i + 1).alias("behind"),
                ),
            )

        return _let(_let(steps, _sums_before), with_starts)

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("values"))
    return _let(both, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weight(digit: Column, i: Column) -> Column:
        twice = 2 * digit.cast("int")
        return F.when(i % 2 == 0, digit.cast("int")).when(twice > 9, twice - 9).otherwise(twice)

    return _sum(F.transform(F.split(F.reverse(digits), ""), weight)) % 10 == 0


def _small(part: Column) -> Column:
    number = F.ltrim(part, F.lit("0"))
    return (F.length(number) <= 3) & (F.coalesce(number.try_cast("int"), F.lit(0)) <= 255)


_VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: F.forall(F.split(value, r"\."), _small),
    "card": lambda value: F.when(F.length(_digits(value)).between(13, 19), _luhn(_digits(value))).otherwise(False),
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}


def words_in(text: Column) -> Column:
    """Runs of letters as they stand."""
    return F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))


def _near(match: Column) -> Column:
    """Words close to a match, in lower case; a word that the bound cuts is left out."""
    before, behind = F.right(match["before"], F.lit(CONTEXT)), F.left(match["behind"], F.lit(CONTEXT))
    before = F.when(F.length(match["before"]) > CONTEXT, F.regexp_replace(before, f"^{LETTERS}", "")).otherwise(before)
    behind = F.when(F.length(match["behind"]) > CONTEXT, F.regexp_replace(behind, f"{LETTERS}$", "")).otherwise(behind)
    return F.array_distinct(F.transform(F.concat(words_in(before), words_in(behind)), F.lower))


def _of_kind(text: Column, kind: str) -> Column:
    def named(match: Column) -> Column:
        value = F.lower(match["value"]) if kind in ("email", "ip") else _digits(match["value"])
        return F.struct(
            F.lit(kind).alias("kind"), match["start"].alias("start"), match["end"].alias("end"),
            F.concat(F.lit(kind + ":"), value).alias("entity"), _near(match).alias("near"),
        )

    found = F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _VALID[kind](m["value"])), named)
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,entity:string,near:array<string>>>"))


def base_spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, its key, a number of its own, and the spans of the patterns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(*[_of_kind(text, kind) for kind in KINDS])
    return docs.select("doc_id", *row_key(), F.monotonically_increasing_id().alias("row"), spans.alias("spans"))


def _terms(docs: DataFrame, wanted: DataFrame, *own: Column) -> DataFrame:
    """A row per document and distinct word of it that is among the wanted ``term``."""
    few = F.broadcast(wanted) if fits(wanted) else wanted
    words = docs.select(*own, F.explode(F.array_distinct(words_in(F.coalesce("text", F.lit(""))))).alias("word"))
    return words.withColumn("term", F.lower("word")).join(few, "term")


def telling_words(docs: DataFrame, found: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``(term, action)``: words to remove or to generalise."""
    named = found.select("row", F.explode("spans").alias("s")).select("row", "s.entity", "s.near")
    often = named.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    total = found.agg(F.count(F.lit(1))).scalar()
    known = F.log2(total / F.col("n_entity"))

    def tells(n_word: Column) -> Column:
        told = F.log2(F.col("n_both") * total / (n_word * F.col("n_entity")))
        return (F.col("n_both") == n_word) | (told >= known / alpha)

    near = (
        named.select("row", "entity", F.explode("near").alias("term"), F.xxhash64("near").alias("around"))
        .groupBy("row", "entity", "term")
        .agg(F.min("around").alias("around"))
    )
    pairs = (
        near.groupBy("entity", "term", "around")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_around"))
        .filter(F.col("n_around") >= support)
    )
    # A word is in no fewer documents than it is near some entity: most common words go here.
    least = near.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    pairs = cut_lineage(pairs.join(often, "entity").join(least, "term").filter(tells(F.col("n_near"))))
    # A word counts once in a document, however it is spelt there.
    candidates = pairs.select("term").distinct()
    few = F.broadcast(candidates) if fits(candidates) else candidates
    words = F.array_distinct(F.transform(words_in(F.coalesce("text", F.lit(""))), F.lower))
    counts = docs.select(F.explode(words).alias("term")).join(few, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    return (
        pairs.join(counts, "term")
        .filter(tells(F.col("n_term")))
        .groupBy("term")
        .agg(F.when(F.max(F.col("n_both") == F.col("n_term")), F.lit("remove")).otherwise(F.lit("generalise")).alias("action"))
    )


def _word_spans(docs: DataFrame, found: DataFrame, telling: DataFrame) -> DataFrame:
    """``(key, added)``: the telling words' spans in each document that has some, apart from base spans."""
    hits = cut_lineage(_terms(docs, telling, *row_key()).groupBy(*_KEY).agg(F.collect_set(F.struct("word", "action")).alias("words")))
    texts = docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))
    both = F.xxhash64(*_KEY)
    _, possible = holding(texts, hits, both, both)
    spelt = F.array_join(F.transform("words", lambda w: w["word"]), "|")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), spelt, F.lit(r")(?![\p{L}\p{M}])"))
    removed = F.transform(F.filter("words", lambda w: w["action"] == "remove"), lambda w: w["word"])
    spans = F.transform(
        matches(F.col("text"), pattern),
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(F.array_contains("removed", m["value"]), F.lit("remove")).otherwise(F.lit("generalise")).alias("action")),
    )
    own = possible.join(hits, _KEY).dropDuplicates(_KEY).withColumn("removed", removed).withColumn("pattern", pattern)
    rows = own.select(*_KEY, F.explode(spans).alias("s")).select(*_KEY, "s.*")
    base = found.join(hits.select(*_KEY), _KEY, "left_semi").select(*_KEY, F.explode("spans").alias("s")).select(*_KEY, "s.start", "s.end", F.lit("base").alias("action"))
    # One document to a window: where the base spans before end, and where the next begins.
    order = W.partitionBy(*_KEY).orderBy("start", F.col("action") != "base")
    of_base = F.col("action") == "base"
    ended = F.max(F.when(of_base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    next_one = F.min(F.when(of_base, F.col("start"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    apart = (F.coalesce("ended", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    kept = rows.unionByName(base).withColumn("ended", ended).withColumn("next", next_one).filter(~of_base & apart)
    return kept.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("added"))


def private_spans(docs: DataFrame, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """``(doc_id, key, row, spans, added)``: the spans of the patterns, by kind and start, and of the telling words."""
    found = cut_lineage(base_spans(docs))
    telling = cut_lineage(telling_words(docs, found, support, alpha))
    none = F.array().cast("array<struct<start:int,end:int,action:string>>")
    if telling.isEmpty():
        return found.withColumn("added", none)
    added = cut_lineage(_word_spans(docs, found, telling))
    return found.join(added, _KEY, "left").withColumn("added", F.coalesce("added", none))


def digests(spans: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, n_terms, base_sha256, spans)``."""

    def written(kind: Column, span: Column) -> Column:
        return F.concat_ws(":", kind, span["start"].cast("string"), span["end"].cast("string"))

    base = F.transform("spans", lambda s: written(s["kind"], s))
    added = F.transform("added", lambda s: written(F.lit(ADDED), s))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return spans.select(
        "doc_id", *map(count, KINDS), F.size("added").cast("bigint").alias("n_terms"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, added), ",").alias("spans"),
    )


def sanitised(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with spans replaced by marks; spans that overlap are replaced by the first one's mark."""
    every = spans.dropDuplicates(_KEY).select(
        *_KEY,
        F.explode(
            F.concat(
                F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("mark"))),
                F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["action"].alias("mark"))),
            )
        ).alias("s"),
    ).select(*_KEY, "s.*")
    before = W.partitionBy(*_KEY).orderBy("start", "end", "mark").rowsBetween(W.unboundedPreceding, -1)
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    cuts = (
        every.withColumn("last", F.coalesce(F.max("end").over(before), F.lit(0)))
        .withColumn("mark", F.when(F.col("last") <= F.col("start"), F.get(F.map_values(F.map_filter(marks, lambda k, _: k == F.col("mark"))), F.lit(0))).otherwise(""))
        .groupBy(*_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("start", "last", "end", "mark"))).alias("cuts"), F.max("end").alias("tail"))
    )
    texts = docs.select("doc_id", "text", *row_key())
    pieces = F.transform(
        "cuts", lambda c: F.concat(F.substring("text", c["last"] + 1, F.greatest(c["start"] - c["last"], F.lit(0))), c["mark"])
    )
    whole = F.concat(F.array_join(pieces, ""), F.substring("text", F.col("tail") + 1, F.length("text")))
    return texts.join(cuts, _KEY, "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(whole).alias("text"))
