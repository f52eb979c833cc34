"""Line dedup: deletion-neighbourhood join, in DataFrame operations only.

A document's lines are trimmed; empty ones are kept and never compared. A line goes if an earlier line is equal to it,
or is within one edit (a character replaced, added or taken away), where one edit is at most the ``share`` of the
shorter line's characters that the caller allows (0: equal lines only, 1: one edit in lines of any length). Earlier means a smaller doc_id (null first), then a smaller hash of the text, then a smaller line number.

1. Equal lines are one row with their first place, by a hash grouping.
2. Two lines within one edit agree in their first or in their last m characters, m being half the shorter one's length.
   Only lines that share such a half with another go on, and only with the other half as the edit's place.
3. These emit their deletion neighbourhood as 64-bit keys: for each place, the line without that character, together
   with the place (two lines that meet there differ in that character only), and without it (for meeting a line that
   is shorter by one, which emits itself). A hash of a line is the XOR of hashes of (place, character), so all the
   neighbourhood's keys of a line come from running XORs, in time proportional to its length. The XORs run over pieces
   of ``PIECE`` characters, the pieces' own over the line, so that no task sorts a long line's characters.
4. Whatever meets at a key is within one edit, so the earliest there is all that is needed: no pairs are built.
   Groups at a key are small by construction (lines that differ in one given character, or by one added). The pairs
   (line, earliest) are checked by their edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, input_partitions, unused

#: One edit in 16 characters is near; the characters of a piece.
SHARE, PIECE = 1 / 16, 4096
#: A join side of at most so many rows of some 40 bytes is broadcast; a larger one is shuffled.
FEW = 400_000


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, print (hash of the text), at (line number from 0), line (trimmed), key, for each line that is not empty."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    lines = own.select("doc_id", F.xxhash64("text").alias("print"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    trimmed = lines.select("doc_id", "print", "at", F.btrim("raw", F.lit(" \t\r\x0b\x0c")).alias("line")).filter("line != ''")
    return trimmed.withColumn("key", F.struct(F.xxhash64("line", F.lit(1)).alias("a"), F.xxhash64(F.lit(2), "line").alias("b")))  # 128 bits: equal keys are equal lines


def place() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "print", "at")


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def near_earlier(docs: DataFrame, firsts: DataFrame, halves: DataFrame, share: float) -> DataFrame:
    """key, first place of the earliest line within one edit, for lines that have an earlier one."""
    wanted = halves.filter(F.col("n") * share >= 1)
    sides = wanted.select("key", "n", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), m.alias("m"), F.col(col).alias("h")) for side, m, col in ((0, F.expr("n div 2"), "left_a"), (0, F.expr("(n - 1) div 2"), "left_b"), (1, F.expr("n div 2"), "right_a"), (1, F.expr("(n - 1) div 2"), "right_b"))])).alias("s")).select("key", "n", "s.*").distinct()
    shared = sides.groupBy("side", "m", "h").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    active = sides.join(shared, ["side", "m", "h"]).groupBy("key", "n").agg(
        F.min(F.when(F.col("side") == 0, F.col("m"))).alias("after"), F.max(F.when(F.col("side") == 1, F.col("n") - F.col("m"))).alias("until"))
    active = cut(active, "active-lines")
    texts = cut(occurrences(docs).select("key", "line", place().alias("own")).join(few(active), "key").join(firsts, "key").filter(F.col("own") == F.col("first")).select("key", "line", "n", "after", "until", "first").dropDuplicates(["key"]), "active-texts")
    pieces = texts.select("key", "n", "after", "until", F.posexplode(F.regexp_extract_all("line", F.lit(f"(?s).{{1,{PIECE}}}"), 0)).alias("b", "piece"))
    whole_of = lambda back: F.aggregate(F.transform(F.split("piece", ""), lambda c, j: F.when(c == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.col("b") * PIECE + j - back, c))), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))
    pieces = pieces.select("*", whole_of(0).alias("own_s"), whole_of(1).alias("own_m"))
    line = Window.partitionBy("key").orderBy("b")
    before, all_ = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0).cast("long"))
    pieces = pieces.select("*", xor("own_s", before).alias("base_s"), xor("own_m", before).alias("base_m"), F.bit_xor("own_s").over(all_).alias("t"), F.bit_xor("own_m").over(all_).alias("u")).repartition(input_partitions(docs.sparkSession), "key", "b")  # by number, as a piece's characters take a thousand times its room
    chars = pieces.select("key", "n", "after", "until", "b", "base_s", "base_m", "t", "u", F.posexplode(F.split("piece", "")).alias("j", "c")).filter("c != ''").withColumn("i", F.col("b") * PIECE + F.col("j"))
    same, moved = F.xxhash64("i", "c"), F.xxhash64(F.col("i") - 1, "c")
    upto = Window.partitionBy("key", "b").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    ran = chars.select("key", "n", "i", "after", "until", same.alias("s"), F.bit_xor(same).over(upto).bitwiseXOR(F.col("base_s")).alias("a"), F.bit_xor(moved).over(upto).bitwiseXOR(F.col("base_m")).alias("g"), "t", "u")
    within = ran.filter("i = 0 or i >= after or i < until")
    can = (F.col("i") >= F.col("after")) | (F.col("i") < F.col("until"))
    # the line without character i, with and without the place; and, once, the line itself as the shorter one
    replaced = F.when(can, F.struct(F.xxhash64(F.lit("r"), "n", "i", F.col("t").bitwiseXOR(F.col("s"))).alias("v"), F.lit(0).alias("role")))
    longer = F.when(can, F.struct(F.xxhash64(F.lit("d"), F.col("n") - 1, F.col("a").bitwiseXOR(F.col("s")).bitwiseXOR(F.col("u")).bitwiseXOR(F.col("g"))).alias("v"), F.lit(1).alias("role")))
    itself = F.when(F.col("i") == 0, F.struct(F.xxhash64(F.lit("d"), "n", F.col("t")).alias("v"), F.lit(2).alias("role")))
    keys = within.select("key", F.explode(F.array_compact(F.array(replaced, longer, itself))).alias("k")).select("key", "k.v", "k.role").distinct()
    at = Window.partitionBy("v")
    met = keys.withColumn("c", F.count("*").over(at)).filter("c > 1").select("v", "role", "key")
    met = cut(met.join(texts.select("key", "first"), "key"), "meetings")
    head = lambda role: F.min(F.when(F.col("role") == role, F.struct("first", "key"))).over(at)
    best = met.withColumn("other", F.when(F.col("role") == 0, head(0)).when(F.col("role") == 1, head(2)).otherwise(head(1)))
    pairs = best.filter("other is not null and other.first < first").select("key", F.col("other.key").alias("other"), F.col("other.first").alias("earlier")).distinct()
    of = texts.select(F.col("key").alias("other"), F.col("line").alias("other_line"))
    sure = pairs.join(texts.select("key", "line"), "key").join(of, "other").filter(F.levenshtein("line", "other_line", 1) >= 0)
    return sure.groupBy("key").agg(F.min("earlier").alias("earlier"))


def duplicate_lines(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, print, at, near (boolean), kept_doc_id, kept_at of each line of ``docs`` (doc_id, text) that goes.

    ``kept_...`` is the earliest line that makes it go: an equal one's first place (near false), or the earliest line
    within one edit of it (near true, for a first place only). A null text has no lines. Rows with equal doc_id and
    text are one document; of equal lines in one document the first stays. Lines and texts of any length are whole. Other
    columns are ignored; an empty table gives no rows.
    """
    n = F.char_length("line")
    part = lambda side, m: F.xxhash64(F.left("line", m) if side == 0 else F.right("line", m), F.lit(7))
    every = occurrences(docs).select("doc_id", "print", "at", "key", n.alias("n"), part(0, F.expr("char_length(line) div 2")).alias("left_a"), part(0, F.expr("(char_length(line) - 1) div 2")).alias("left_b"), part(1, F.expr("char_length(line) div 2")).alias("right_a"), part(1, F.expr("(char_length(line) - 1) div 2")).alias("right_b"))
    every = cut(every, "lines")
    firsts = cut(every.groupBy("key").agg(F.min(place()).alias("first"), *[F.first(c).alias(c) for c in ("n", "left_a", "left_b", "right_a", "right_b")]), "distinct-lines")
    near = cut(near_earlier(docs, firsts.select("key", "first"), firsts.drop("first"), share), "near-lines")
    known = firsts.select("key", "first").join(near, "key", "left")
    of = every.select("doc_id", "print", "at", "key").distinct().join(known, "key")
    later = place() != F.col("first")
    gone = of.filter(later | F.col("earlier").isNotNull())
    why = F.when(later, F.col("first")).otherwise(F.col("earlier"))
    return gone.select("doc_id", "print", "at", (~later).alias("near"), why["doc_id"].alias("kept_doc_id"), why["at"].alias("kept_at"))


def line_report(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_equal, n_near, gone (numbers of the lines that go, ascending) of each document that loses lines."""
    rows = duplicate_lines(docs, share)
    return rows.groupBy("doc_id", "print").agg(F.count_if(~F.col("near")).alias("n_equal"), F.count_if("near").alias("n_near"), F.array_sort(F.collect_list("at")).alias("gone")).drop("print")


def line_deduped(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """``docs`` with their texts less the lines that go; a text all of whose lines go becomes empty. Columns unchanged, whatever their names."""
    ident, text_hash, gone = unused(docs, 3)
    rows = duplicate_lines(docs, share).groupBy(F.col("doc_id").alias(ident), F.col("print").alias(text_hash)).agg(F.collect_set("at").alias(gone))
    joined = docs.join(rows, F.col("doc_id").cast("long").eqNullSafe(F.col(ident)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash)), "left")
    lines = F.transform(F.split(F.col("text").cast("string"), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(lines, lambda s: ~F.array_contains(gone, s["i"])), lambda s: s["x"]), "\n")
    return joined.select(*[F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
