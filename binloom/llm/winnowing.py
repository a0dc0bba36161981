"""Document fingerprints by winnowing, as DataFrame expressions.

A text's tokens (words; each character of scripts that don't space words) are hashed to numbers below the prime P. The hash
of a gram of k tokens is the rolling polynomial t[0] B^(k-1) + ... + t[k-1] modulo P, so that the next gram's is (hash - t[0]
B^(k-1)) B + t[k]. Column expressions keep no running state; all places roll at once, by the same polynomial's other rule:
two runs side by side give the hash of both (widths 1, 2, 4 and 5 for k = 5). Every window of w grams gives up its minimum,
the rightmost of equal ones, with its position. Whatever run of w + k - 1 tokens two texts share, they share a fingerprint
that lies in it.

Defined results: case is ignored; a text of fewer than k tokens has one gram, all of it; one of fewer than w grams one
window; a null or empty text has no fingerprint, and two of these are alike (1). Positions count tokens from 0. Columns that
are carried along may have any name; one named as the output column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, read

UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
POSITIONS = 2**31 - 1
#: Modulus and base of the rolling hash: products of two residues stay below 2^62.
P, B = 2**31 - 1, 1_000_003


def residue(x: Column) -> Column:
    return F.pmod(x, F.lit(P).cast("bigint"))


def selected(df: DataFrame, text: str, out: str, k: int = 5, w: int = 8) -> DataFrame:
    """df (which has no column _h, _n, _m or _few) with out, an ascending-by-window array of longs: 31 bits of gram hash, then 31 bits that fall with the position."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    df = df.withColumn("_h", F.transform(tokens, lambda t: residue(F.xxhash64(t)))).withColumn("_n", F.size("_h")).withColumn("_m", F.col("_h"))

    def joined(left: str, width: int, right: str, more: int) -> Column:
        """Hashes of runs of width + more tokens."""
        many = F.greatest(F.col("_n") - (width + more - 1), F.lit(0))
        return F.zip_with(F.slice(left, 1, many), F.slice(right, width + 1, many), lambda x, y: (x * pow(B, more, P) + y) % P)

    width = 1
    for bit in bin(k)[3:]:
        df, width = df.withColumn("_m", joined("_m", width, "_m", width)), 2 * width
        if bit == "1":
            df, width = df.withColumn("_m", joined("_m", width, "_h", 1)), width + 1
    short = F.when(F.col("_n") > 0, F.array(residue(F.xxhash64("_h")))).otherwise(F.array().cast("array<bigint>"))
    grams = F.when(F.col("_n") >= k, F.col("_m")).otherwise(short)
    packed = lambda x, i: F.shiftleft(x, 31).bitwiseOR(F.lit(POSITIONS).cast("bigint") - i)
    df = df.withColumn("_m", F.transform(grams, packed)).drop("_h", "_n")
    # the least of a window of w from two windows of a power of two
    n, span = F.size("_m"), 1
    df = df.withColumn("_few", F.when((n < w) & (n > 0), F.array(F.array_min("_m"))).when(n == 0, F.col("_m")))
    while span < w:
        shift = min(span, w - span)
        left = F.greatest(F.size("_m") - shift, F.lit(0))
        df = df.withColumn("_m", F.when(F.col("_few").isNull(), F.zip_with(F.slice("_m", 1, left), F.slice("_m", shift + 1, left), lambda x, y: F.least(x, y))))
        span += shift
    return df.withColumn(out, F.coalesce("_few", F.array_distinct("_m"))).drop("_m", "_few")


def hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 31)


def position_of(packed: Column) -> Column:
    return (F.lit(POSITIONS) - packed.bitwiseAND(F.lit(POSITIONS).cast("bigint"))).cast("int")


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", k: int = 5, w: int = 8) -> DataFrame:
    """docs with out: array of (position, hash), by position. A column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    names = [f"c{i}" for i in range(len(kept))]
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], F.col(f"`{text}`").alias("t"))
    pairs = F.transform("f", lambda x: F.struct(position_of(x).alias("position"), hash_of(x).alias("hash")))
    return selected(df, "t", "f", k, w).select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.array_sort(pairs).alias(out))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union).cast("double")


def with_next(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, Window]:
    """Rows (key, text, tie, ghost) dealt into ranges of the key, and the window that runs through a range, keys falling.

    The rows that begin a range stand once more, as ghosts, at the end of the range before (those of the first range at
    the end of the last), so each row but a ghost finds its successor in its own range. Null keys come last. Bounds and
    the keys that begin a range reach the driver: two numbers a range.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key), whole.alias(text), F.xxhash64(whole).alias("tie"))
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col(key))) if cuts else F.lit(0)
    at = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(above).cast("int")
    firsts = docs.groupBy(at.alias("range")).agg(F.max(key).alias("first")).orderBy("range").collect()
    order = [F.col("ghost"), F.col(key).desc_nulls_last(), F.col("tie")]
    dealt = docs.withColumn("range", at).withColumn("ghost", F.lit(0))
    if firsts:
        before = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
        begins = docs.where(F.col(key).isin([r["first"] for r in firsts if r["first"] is not None]) | F.col(key).isNull())
        begins = begins.withColumn("_at", at).groupBy("_at", key).agg(F.min_by(text, "tie").alias(text), F.min("tie").alias("tie"))
        to = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_at"))
        dealt = dealt.union(begins.select(key, text, "tie", to.cast("int").alias("range"), F.lit(1).alias("ghost")))
    return dealt.repartition(n, "range"), Window.partitionBy("range").orderBy(*order)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint is 8 hex digits for each selected gram, in order; positions has the gram's first token for each."""
    rows, by_id = with_next(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(by_id)).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    )
    rows = selected(selected(rows.drop("next"), "text", "own"), "edited", "other")
    told = lambda c: F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(hash_of(x)), 8, "0"))), "")
    hashes = lambda c: F.array_distinct(F.transform(c, hash_of))
    rows = rows.select(
        "doc_id", "range", "ghost", "tie", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        told("own").alias("fingerprint"), told("other").alias("edited_fingerprint"), F.transform("own", position_of).alias("positions"),
        F.transform("other", position_of).alias("edited_positions"), hashes("own").alias("own"), hashes("other").alias("other"),
    )
    rows = rows.withColumn("following", F.lead("own").over(by_id)).where("ghost = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("own", "other").alias("near_edited"), likeness("own", "following").alias("near_next"), "positions", "edited_positions",
    )
