"""Document fingerprints: SimHash over weighted terms, and a search by permuted block tables. DataFrame operations only.

Terms are pairs of neighbouring words (the last word forms a term of its own), a term's weight is how often it occurs. Each
occurrence votes on 64 signed bits; a bit of the fingerprint is 1 if over half of the weight says so. Votes are counted in
32 sums of two 32-bit lanes each, so a text may have up to 2**31 words.

The edited text of a document is its text with the last quarter replaced by the beginning of the next document's. Documents
are ordered by doc_id (null first), then by a hash of the text; rows with equal doc_id and text are one document there and
get a result row each, with equal values. After the last document comes the first. An empty table gives an empty result. A
text is split in one task, whatever its length. Only doc_id and text are read, so other columns may have any name.

The search cuts 64 bits into BLOCKS blocks. Of two fingerprints within RADIUS bits at least BLOCKS - RADIUS blocks are
equal, so there is a table for each choice of that many blocks, keyed by them: every table is the same set of fingerprints
in another permutation of the blocks. A pair counts in the first table that it shares only.

Null text is empty; a text without words has fingerprint zero.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import GAP, before, matched, ordered, table, with_hot_keys, written

BITS, RADIUS, BLOCKS = 64, 3, 6
_LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    """Hashes (bigint) of all term occurrences; null for a text without words."""
    words = F.array_remove(F.split(text, GAP), "")
    return F.when(F.size(words) > 0, F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.xxhash64(a, b)))


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fp (bigint). Votes are summed where the rows are, so an exchange carries one row for each text."""
    each = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("term"))
    lanes = [F.sum(F.shiftrightunsigned("term", k).bitwiseAND(F.lit(_LANES))).alias(f"s{k}") for k in range(32)]
    votes = each.groupBy(*keys).agg(F.count("term").alias("n"), *lanes)
    return votes.select(*keys, _bits().alias("fp"))


def _bits() -> Column:
    out = F.lit(0).cast("bigint")
    for k in range(32):
        for lane, bit in ((F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k), (F.shiftrightunsigned(f"s{k}", 32), k + 32)):
            mask = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(lane * 2 > F.col("n"), F.lit(mask).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return out


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_chars, copies (rows that are this document), nxt (struct of the next document's key), prv, need (code points that the previous document takes)."""
    ids = written(docs.groupBy("doc_id", "h", "n_chars").agg(F.count("*").alias("copies")), "fingerprint-ids")
    line = ordered(ids, [F.col("doc_id").asc_nulls_first(), F.col("h")], "fingerprint-order")
    line = before(line, {"_earlier": F.lit(1)}).withColumn("at", F.col("_earlier") + F.col("_row"))
    key = F.struct("doc_id", "h", "n_chars")
    # neighbours by place: inside a part by its own order, at its ends by the first and last rows of parts
    w = Window.partitionBy("_part").orderBy("_row")
    line = line.withColumns({"nxt": F.lead(key).over(w), "prv": F.lag(key).over(w)})
    ends = line.groupBy("_part").agg(F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"), F.max("_row").alias("_top"))
    whole = Window.partitionBy()
    by = whole.orderBy("_part")  # as many rows as parts
    edge = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lead("first").over(by), F.first("first").over(edge)).alias("after"), F.coalesce(F.lag("last").over(by), F.last("last").over(edge)).alias("ahead"))
    line = line.join(ends, "_part").withColumns({"nxt": F.coalesce("nxt", "after"), "prv": F.coalesce("prv", "ahead")})
    return line.select("doc_id", "h", "n_chars", "copies", "nxt", "prv", F.floor(F.col("prv.n_chars") / 4).cast("int").alias("need"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_chars, nxt, copies, text, edited. Texts are exchanged once; what a next document lends travels beside them."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"h": F.xxhash64("text"), "n_chars": F.char_length("text").cast("bigint")})
    near = written(neighbours(base), "fingerprint-neighbours")
    both = matched(base, near.select("doc_id", "h", "n_chars", F.struct("nxt", "prv", "need", "copies").alias("near")), ["doc_id", "h", "n_chars"])
    lent = both.select("near.prv.*", F.substring(F.col("text"), F.lit(1), F.col("near.need")).alias("lent")).groupBy("doc_id", "h", "n_chars").agg(F.max("lent").alias("lent"))
    got = matched(both, lent, ["doc_id", "h", "n_chars"])
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    return got.select("doc_id", "h", "n_chars", F.col("near.nxt").alias("nxt"), F.col("near.copies").alias("copies"), "text", F.concat(F.substring(F.col("text"), F.lit(1), kept.cast("int")), "lent").alias("edited"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_chars, edited_sha256, fp, edited_fp, next_fp of every row."""
    rows = with_edits(docs)
    keys = ["doc_id", "h", "n_chars", "nxt", "copies", "which"]
    long = rows.select(
        "doc_id", "h", "n_chars", "nxt", "copies",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")))).alias("x"),
    ).select("doc_id", "h", "n_chars", "nxt", "copies", "x.*")
    fps = simhash(long, [*keys, "sha"])
    # rows that repeat a document vote several times each; the majority is the same
    one = written(fps.groupBy("doc_id", "h", "n_chars", "nxt", "copies").agg(F.max("sha").alias("edited_sha256"), F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp")), "fingerprints")
    nxt = one.select(F.struct("doc_id", "h", "n_chars").alias("nxt"), F.col("fp").alias("next_fp"))
    mine = one.select("*", F.col("nxt.doc_id").alias("n_id"), F.col("nxt.h").alias("n_h"), F.col("nxt.n_chars").alias("n_n"))
    other = nxt.select(F.col("nxt.doc_id").alias("n_id"), F.col("nxt.h").alias("n_h"), F.col("nxt.n_chars").alias("n_n"), "next_fp")
    out = matched(mine, other, ["n_id", "n_h", "n_n"]).drop("n_id", "n_h", "n_n")
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("nth", "copies")


def _block(fp: Column, i: int, blocks: int) -> Column:
    lo, hi = BITS * i // blocks, BITS * (i + 1) // blocks
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def within(queries: DataFrame, distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q, fp: all fingerprints of `distinct` (column fp) within radius of those of `queries` (column q, distinct)."""
    choices = list(combinations(range(blocks), blocks - radius))

    def tables(c: Column) -> Column:
        rows = []
        for t, choice in enumerate(choices):
            key = F.lit(0).cast("bigint")
            for i in choice:
                width = BITS * (i + 1) // blocks - BITS * i // blocks
                key = F.shiftleft(key, width).bitwiseOR(_block(c, i, blocks))
            rows.append(F.struct(F.lit(t).alias("t"), key.alias("key")))
        return F.explode(F.array(*rows))

    left = queries.select("q", tables(F.col("q")).alias("k")).select("q", "k.*")
    right = distinct.select("fp", tables(F.col("fp")).alias("k")).select("fp", "k.*")
    x = F.col("q").bitwiseXOR(F.col("fp"))
    # the first table of a pair: the lowest equal blocks
    first, seen = F.lit(True), [F.when(_block(x, i, blocks) == 0, 1).otherwise(0) for i in range(blocks)]
    for t, choice in enumerate(choices):
        others = [seen[i] for i in range(max(choice)) if i not in choice]
        if others:
            total = others[0]
            for o in others[1:]:
                total = total + o
            first = first & ((F.col("t") != t) | (total == 0))
    return left.join(right, ["t", "key"]).filter((F.bit_count(x) <= radius) & first).select("q", "fp")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = written(fingerprint(docs), "fingerprint-rows")
    asked = got.filter(F.col("doc_id") % 100 == 0).select(F.col("fp").alias("q")).distinct()
    counts = written(got.groupBy("fp").agg(F.count("*").alias("copies")), "fingerprint-distinct")
    near = within(asked, counts.select("fp")).filter("q <> fp").groupBy("q").agg(F.count("*").alias("near"))
    named = written(counts.join(near.withColumnRenamed("q", "fp"), "fp", "left").select("fp", "near", "copies"), "fingerprint-near")
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    searched = with_hot_keys(got, named, ["fp"], "copies")
    out = searched.select(
        "doc_id", "h", "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        F.when(F.col("doc_id") % 100 == 0, F.coalesce("near", F.lit(0))).alias("within_radius"),
    )
    return out.drop("h")
