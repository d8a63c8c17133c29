r"""Document fingerprints: threshold-scaled sketches, in DataFrame operations only.

A text is lower-cased and cut into words ``[^\x20\x09-\x0D]+``; its shingles are
five words (fewer words: all of them), hashed to 32 bits.  The sketch keeps every
shingle hash below a quarter of the range, so sketches of any texts can be merged
and compared.  A text of at most ``WHOLE`` different shingles keeps all its hashes
and says so (its scale is 1); the union of two such sketches stays whole while it
is that small.  Sketches are compared at the lower of their scales, so short texts
are compared exactly among themselves, and a short text with a long one by those of
its hashes that a long text would have kept.

Containment is the share of the smaller sketch found in the other; two empty
sketches are alike (1), an empty and another are not (0).  A short text of n
shingles none of which a long text would have kept (0.75 ** n of such texts: 18 % at
6, 3 % at 12) gives no evidence and counts as not contained.

Null text is empty; repeated rows give repeated rows; of rows that share a doc_id
the one with the least head and sketch is the next document of another id; a row
without doc_id has no next document and is not one; one document alone is its own
next; an empty table gives an empty table.  Other columns are left behind, whatever
their names; a text of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpointed
from .common import texts

WORDS = 5
#: Hashes kept: those of the unsigned 32-bit range below 2**30, a quarter.
LIMIT = 1 << 30
#: Different shingles up to which a text keeps all its hashes.
WHOLE = 64


def _bound(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once per row."""
    return F.transform(F.array(value), then)[0]


def shingles(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def over(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WORDS))))
        return F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _bound(F.transform(words, lambda w: F.xxhash64(w)), over)


def _low(hashes: Column) -> Column:
    return F.filter(hashes, lambda x: (x >= 0) & (x < LIMIT))


def _scaled(every: Column) -> Column:
    """The sketch of different hashes: whether it is whole, and the hashes, ascending as signed numbers."""
    whole = F.size(every) <= WHOLE
    return F.struct(whole.alias("whole"), F.array_sort(F.when(whole, every).otherwise(_low(every))).alias("hashes"))


def sketch(text: Column) -> Column:
    """The text's sketch: whole (its scale is 1) and hashes."""
    short = F.transform(shingles(text), lambda h: F.shiftright(h, 32).cast("int"))
    return _bound(F.array_distinct(short), _scaled)


def merged(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles together."""
    both = _bound(F.array_union(a["hashes"], b["hashes"]), _scaled)
    scaled = F.struct(F.lit(False).alias("whole"), F.array_sort(_low(F.array_union(a["hashes"], b["hashes"]))).alias("hashes"))
    return F.when(a["whole"] & b["whole"], both).otherwise(scaled)


def _at_one_scale(a: Column, b: Column, then) -> Column:
    """``then(hashes of a, hashes of b)`` at the lower of the two scales."""
    one = a["whole"] == b["whole"]
    pair = F.struct(F.when(one, a["hashes"]).otherwise(_low(a["hashes"])).alias("a"), F.when(one, b["hashes"]).otherwise(_low(b["hashes"])).alias("b"))
    return _bound(pair, lambda p: then(p["a"], p["b"]))


def containment(a: Column, b: Column) -> Column:
    def share(x: Column, y: Column) -> Column:
        least = F.least(F.size(x), F.size(y))
        return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)

    none = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(none & (a["whole"] == b["whole"]), 1.0).otherwise(_at_one_scale(a, b, share))


def resemblance(a: Column, b: Column) -> Column:
    def share(x: Column, y: Column) -> Column:
        return _bound(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) > 0, n / (F.size(x) + F.size(y) - n)).otherwise(0.0))

    none = (F.size(a["hashes"]) == 0) & (F.size(b["hashes"]) == 0)
    return F.when(none & (a["whole"] == b["whole"]), 1.0).otherwise(_at_one_scale(a, b, share))


def spelled(sketch_: Column) -> Column:
    """A sketch as text: its scale's mark and eight hex digits for each hash."""
    digits = F.transform(sketch_["hashes"], lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.concat(F.when(sketch_["whole"], "1:").otherwise("4:"), F.array_join(digits, ""))


def next_lower(ids: DataFrame) -> DataFrame:
    """doc_id and next_id, the next smaller doc_id there is; the smallest gets the largest.

    Ids are dealt out by range and ordered inside each range; only the ranges' largest
    ids, one for each partition, are ordered in one task.
    """
    known = ids.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id")
    known = checkpointed(known.select("doc_id", F.spark_partition_id().alias("range")))
    inside = known.withColumn("lower", F.lag("doc_id").over(Window.partitionBy("range").orderBy("doc_id")))
    ends = known.groupBy("range").agg(F.max("doc_id").alias("largest"))
    one = Window.orderBy("largest")
    before = ends.select(
        "range",
        F.coalesce(F.lag("largest").over(one), F.last("largest").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"),
    )
    return inside.join(before, "range").select("doc_id", F.coalesce("lower", "before").alias("next_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and sketch of every document."""
    return texts(docs).select("doc_id", "text", sketch(F.col("text")).alias("sketch"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and its next document (see the query's contract).

    Texts move once, by doc_id, for a document's own row and for its part as
    another's next alike (the two exchanges are equal, so Spark makes one); sketches
    are made after it, and only the heads and sketches that are needed move on, to
    their owners.
    """
    rows = texts(docs).select("doc_id", "text")
    named = rows.where("doc_id is not null")
    sizes = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).alias("n"))
    wanted = next_lower(docs).join(sizes, "doc_id").select(F.col("doc_id").alias("owner"), "next_id", F.expr("cast(n div 2 as int)").alias("room"))
    found = named.join(wanted, named["doc_id"] == wanted["next_id"]).select(
        "owner", F.struct(F.when(F.col("room") > 0, F.left("text", F.col("room"))).otherwise("").alias("head"), sketch(F.col("text")).alias("sketch")).alias("part"),
    )
    heads = found.groupBy("owner").agg(F.min("part").alias("part"))
    both = named.join(heads, named["doc_id"] == heads["owner"]).select("doc_id", "text", F.col("part.head").alias("head"), F.col("part.sketch").alias("next_sketch"))
    alone = rows.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), sketch(F.lit("")).alias("next_sketch"))
    n = F.length("text")
    half = F.expr("cast(length(text) div 2 as int)")
    edited = F.concat(F.left("text", n - half), F.left("head", half))
    pairs = both.unionByName(alone).select("doc_id", n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("sketch"), edited.alias("edited"), "next_sketch")
    return pairs.withColumn("edited_sketch", sketch(F.col("edited")))


def digest(pairs: DataFrame) -> DataFrame:
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), spelled(a).alias("fingerprint"), spelled(b).alias("edited_fingerprint"),
        containment(a, b).alias("near_edited"), containment(a, c).alias("near_next"), resemblance(a, b).alias("jaccard_edited"), resemblance(a, c).alias("jaccard_next"),
    )
