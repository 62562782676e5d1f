"""Document fingerprints by one-permutation MinHash, with column functions only.

The distinct five-word sequences of a text are hashed once.  The upper seven bits of a hash
choose one of 128 bins, and each bin keeps its smallest value.  An empty bin takes the value
of a bin that is not empty, tried in an order of its own that depends on nothing but the
bin (optimal densification).  The fingerprint is the low eight bits of each bin's value, hashed
with the bin, as 256 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecohort.llm.common import shuffle_partitions

WORDS = 5
BINS = 128
_VALUE_BITS = 56
#: Bins tried one by one before all bins that hold something are ranked.
_TRIES = 4


def with_fingerprint(df: DataFrame, text_col: str, name: str, words: int = WORDS) -> DataFrame:
    """Add the fingerprint of a text column.

    A-Z and other cased letters are lower-cased, words end at a space or at the characters 9
    to 13.  A text of fewer words is one sequence; null, empty and blank texts have the
    fingerprint ``''``.  Equal texts have equal fingerprints.
    """
    w, s, m, v, h = (f"_{name}_{x}" for x in "wsmvh")
    split = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, F.transform(split, lambda x: F.xxhash64(x)))
    sequence = F.when(
        F.size(w) >= words,
        F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - words, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]),
        ),
    ).otherwise(F.filter(F.array(F.xxhash64(F.col(w))), lambda _: F.size(w) > 0))
    df = df.withColumn(h, F.transform(sequence, lambda x: F.shiftrightunsigned(x, 1)))
    df = df.withColumn(s, F.sort_array(h))
    bin_of = lambda x: F.shiftright(x, _VALUE_BITS)
    df = df.withColumn(
        m, F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.coalesce(F.get(s, i - 1), F.lit(-1)))))
    )
    df = df.withColumn(f"{m}b", F.transform(m, lambda x: bin_of(x)))
    at = lambda b: F.get(m, F.array_position(f"{m}b", b.cast("bigint")).cast("int") - 1)
    df = df.withColumn(v, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: at(b)))

    def filled(value: Column, b: Column) -> Column:
        tries = [F.get(v, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(_TRIES)]
        rest = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("o"), x.alias("x"))))["x"]
        return F.coalesce(value, *tries, rest)

    # A bin's code hashes the value with the bin, or bins that share a value would agree by chance together.
    code = lambda x, b: F.xxhash64(filled(x, b), b).bitwiseAND(F.lit(255).cast("bigint"))
    digits = F.transform(v, lambda x, b: F.lpad(F.hex(code(x, b)), 2, "0"))
    df = df.withColumn(name, F.when(F.size(m) > 0, F.lower(F.array_join(digits, ""))).otherwise(F.lit("")))
    return df.drop(w, s, m, v, h, f"{m}b")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated share of common sequences: equal bytes, corrected for chance agreement.

    Two empty fingerprints are alike (1), an empty one and another are not (0).
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.size(F.filter(
        F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2))
    ))
    chance = 1 / 256
    share = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(share)


def _ordered_buckets(rows: DataFrame, id_col: str, buckets: int) -> DataFrame:
    """Add ``_bucket``, non-decreasing in the id; nulls are first."""
    edges = sorted(set(rows.select(F.col(id_col).cast("double").alias("x")).approxQuantile(
        "x", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    rows = rows.withColumn("_x", F.col(id_col).cast("double"))
    if not edges:
        return rows.withColumn("_bucket", F.when(F.col("_x").isNull(), -1.0).otherwise(0.0)).drop("_x")
    cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")
    rows = cut.transform(rows)
    return rows.withColumn("_bucket", F.when(F.col("_x").isNull(), -1.0).otherwise(F.col("_b"))).drop("_x", "_b")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of a text and of its edited form.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The edited text has its last half (rounded down) of code points replaced by as many
    leading ones of the next text (by id, nulls first, then text; after the last the first),
    or by all it has.  Null counts as empty.  A single row is its own next.  Equal rows take
    their places in any order.  Other columns are not read.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = 4 * shuffle_partitions(docs.sparkSession)
    rows = _ordered_buckets(rows, "doc_id", buckets)
    # The first text of each bucket follows the last one of the bucket before.
    heads = rows.groupBy("_bucket").agg(F.min("doc_id").alias("_head"))
    around = Window.orderBy("_bucket")  # at most ``buckets`` + 2 rows
    heads = heads.select(
        "_bucket", "_head",
        F.coalesce(F.lag("_bucket").over(around), F.last("_bucket").over(
            around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"),
    )
    same = rows.doc_id.eqNullSafe(heads["_head"]) & (rows["_bucket"] == heads["_bucket"])
    follow = rows.join(F.broadcast(heads), same).groupBy("_before").agg(F.min("text").alias("_follow"))
    follow = with_fingerprint(follow, "_follow", "_follow_print").withColumnRenamed("_before", "_bucket")

    w = Window.partitionBy("_bucket").orderBy("doc_id", "text")
    rows = rows.withColumn("_next", F.lead("text").over(w)).join(follow, "_bucket", "left")
    half = F.expr("length(text) div 2").cast("int")
    after = F.coalesce("_next", "_follow")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(after, F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("_last", F.col("_next").isNull()).drop("_next", "_follow")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").drop("edited")
    next_print = F.when(F.col("_last"), F.col("_follow_print")).otherwise(F.lead("fingerprint").over(w))
    rows = rows.withColumn("_next_print", next_print)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "_next_print").alias("near_next"),
    )
