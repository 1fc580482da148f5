"""Document fingerprints: a homomorphic multiset hash over paragraphs, in built-in functions only.

A fingerprint is a vector of integers, the sum of the vectors of a text's paragraphs, each lane modulo a power of
two. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its
vector (``combine``, ``remove``). The lanes:

- 4 wide ones, modulo 2^62: hashes of the whole paragraph, each with a seed of its own. They decide equality.
- 1 count of sentences and 42 packed ones of three fields each, modulo 2^20: how many sentences of the paragraph have
  a given bit of their hash set. Twice a field less the count is a sum of +1 and -1, so the squared distance of two
  texts' lanes estimates the size of the difference of their multisets of sentences, which ``likeness`` uses. With 126
  such sums the estimate has a standard error of about an eighth of the true difference: likenesses of texts that are
  alike are sharp, those of unlike texts are near 0 within some 0.1. Only the wide lanes tell equality.

Paragraphs end at line feeds. Null texts are empty; an empty text has one empty paragraph and no sentence. Equal texts
have equal fingerprints; texts without any sentence are like each other only if they are equal. Very long texts take a
step for each sentence; beyond 2^20 sentences the fields wrap, as they are modulo. Rows that repeat get equal answers
each; of rows that share an id the greatest text is what others have as their next. Other columns of ``docs`` are not
read, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound, text_of, written

WIDE, PACKED, SHIFTS, FIELD = 4, 42, 21, 20
WIDE_MASK = 2**62 - 1
ONES = sum(1 << (21 * k) for k in range(3))  # one bit of each field
FIELDS = sum((2**FIELD - 1) << (21 * k) for k in range(3))
SENTENCES = r"\n|(?<=[.!?]) "


def fingerprint(text: Column) -> Column:
    """The lanes of a text: array<long> of WIDE + 1 + PACKED."""
    whole = F.transform(F.split(text, "\n", -1), lambda p: F.array(*[F.xxhash64(F.lit(k), p).bitwiseAND(F.lit(WIDE_MASK)) for k in range(WIDE)]))
    zero = lambda n: F.array_repeat(F.lit(0).cast("long"), n)
    wide = F.aggregate(whole, zero(WIDE), lambda acc, h: F.zip_with(acc, h, lambda a, x: (a + x).bitwiseAND(F.lit(WIDE_MASK))))
    sentences = F.filter(F.split(text, SENTENCES, -1), lambda s: s != "")
    hashes = F.transform(sentences, lambda s: F.xxhash64(F.lit(11), s))
    shifts = F.array(*map(F.lit, range(SHIFTS)))
    added = lambda h: lambda a, s: a + F.call_function("shiftrightunsigned", h, s).bitwiseAND(F.lit(ONES))
    wrapped = lambda h: lambda a, s: added(h)(a, s).bitwiseAND(F.lit(FIELDS))

    def folded(found: Column, seed: int) -> Column:
        hashes = F.transform(found, lambda s: F.xxhash64(F.lit(seed), s))
        fold = lambda step: F.aggregate(hashes, zero(SHIFTS), lambda acc, h: F.zip_with(acc, shifts, step(h)))
        return F.when(F.size(found) < 2**FIELD, fold(added)).otherwise(fold(wrapped))  # no field is full before

    return F.concat(wide, bound(sentences, lambda found: F.concat(F.array(F.size(found).cast("long")), folded(found, 11), folded(found, 12))))


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets of paragraphs together."""
    return F.transform(a, lambda x, i: (x + F.get(b, i)).bitwiseAND(_mask(i)))


def remove(a: Column, b: Column) -> Column:
    """``a`` without the paragraphs of ``b``. A bit above each field is lent, so that no field borrows from the next."""
    return F.transform(a, lambda x, i: (x + _lent(i) - F.get(b, i)).bitwiseAND(_mask(i)))


def _mask(i: Column) -> Column:
    return F.when(i < WIDE, F.lit(WIDE_MASK)).when(i == WIDE, F.lit(2**40 - 1)).otherwise(F.lit(FIELDS))


def _lent(i: Column) -> Column:
    return F.when(i < WIDE, F.lit(2**62)).when(i == WIDE, F.lit(2**40)).otherwise(F.lit(ONES * 2**FIELD))


def text_form(lanes: Column) -> Column:
    """Lower-case hexadecimal digits, 16 for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _norm(lanes: Column, other: Column | None = None) -> Column:
    """The sum over all fields of the squared sums of +1 and -1 of a fingerprint, or of the difference of two."""
    size = 2**FIELD
    n = F.get(lanes, WIDE) - (F.get(other, WIDE) if other is not None else F.lit(0))

    def squared(packed: Column, i: Column) -> Column:
        total = None
        for k in range(3):
            part = lambda x: F.shiftrightunsigned(x, 21 * k).bitwiseAND(F.lit(size - 1))  # noqa: B023, E731
            count = part(packed) - (part(F.get(other, i + WIDE + 1)) if other is not None else F.lit(0))
            value = (count * 2 - n).cast("double")
            wrapped = value - F.rint(value / (2.0 * size)) * (2.0 * size)
            total = wrapped * wrapped if total is None else total + wrapped * wrapped
        return total

    return F.aggregate(F.transform(F.slice(lanes, WIDE + 2, PACKED), squared), F.lit(0.0), lambda a, x: a + x)


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 less the estimated share of sentences (squared counts) in which the multisets differ."""
    both = _norm(a) + _norm(b)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - _norm(a, b) / both)
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(near)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """(__k, n, target) for each distinct id, and what stands for a null id. The target is the id that
    stands before it in ascending order, its next in descending order; the smallest one's next is the largest. Null ids count as one below all.

    Ids are dealt out by ranges with sampled bounds, so that a few ids far off leave the ranges even; a range's rows are
    ordered by themselves, and a row for each range tells what stands before it.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.length(text_of())).cast("long").alias("n"))
    ids = ids.select(F.col("doc_id").cast("long").alias("__k"), "n")
    ranged = written(ids.repartitionByRange(F.col("__k").asc_nulls_first()).withColumn("__b", F.spark_partition_id()), "id-ranges")
    low, high = ranged.agg(F.min("__k"), F.max("__k")).first()
    low, high = (0, -1) if low is None else (low, high)
    keyed = ranged.withColumn("__k", F.coalesce("__k", F.lit(low - 1)))
    ordered = Window.partitionBy("__b").orderBy("__k")
    ranges = keyed.groupBy("__b").agg(F.max("__k").alias("__last")).withColumn("__before", F.lag("__last").over(Window.orderBy("__b"))).select("__b", "__before")
    nexts = keyed.withColumn("__lag", F.lag("__k").over(ordered)).join(F.broadcast(ranges), "__b")
    return nexts.select("__k", "n", F.coalesce("__lag", "__before", F.lit(high)).alias("target")), low - 1


def edited_report(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): n_chars, edited_sha256, the fingerprints and two likenesses.

    In the edited text the last third is replaced by the first characters of the next document. Rows that share an id
    are the next document of the same row: the one with the greatest text stands for them. Texts are dealt out by id
    once; the next document sends its fingerprint and no more characters than asked for.
    """
    nexts, null_id = with_next(docs)
    # The one exchange of texts: what follows groups and joins by the same key, on the same columns.
    # Each text's fingerprint is made before it, once for the row itself and for the row whose next it is.
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("__k"), text_of().alias("text"))
    texts = texts.withColumn("__own", fingerprint(F.col("text"))).repartition("__k")
    greatest = texts.groupBy("__k").agg(F.max(F.struct("text", "__own")).alias("__top"))
    asked = nexts.select(F.col("target").alias("__k"), F.col("__k").alias("__for"), F.floor(F.col("n") / 3).cast("int").alias("__need"))
    heads = greatest.join(asked, "__k").select("__for", F.expr("left(__top.text, __need)").alias("__head"), F.col("__top.__own").alias("__next"))
    rows = texts.join(heads, F.col("__k") == F.col("__for")).withColumn("n_chars", F.length("text").cast("long"))
    third = F.least(F.floor(F.col("n_chars") / 3), F.length("__head")).cast("int")
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("__edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("__head"), F.lit(1), third)))
    rows = rows.select("__k", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), "__own", fingerprint(F.col("__edited")).alias("__other"), "__next")
    return rows.select(
        F.when(F.col("__k") != null_id, F.col("__k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_form(F.col("__own")).alias("fingerprint"),
        text_form(F.col("__other")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__other")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )
