"""Document fingerprints by SimHash, with DataFrame functions only.

Every term of a text votes with its weight on the 64 bits of its hash; a bit is set if more than half of the weight
sets it. Tables of permuted blocks find all fingerprints within a Hamming radius: two fingerprints that differ in at
most r bits agree on at least ``blocks - r`` blocks, so that a table for each choice of so many blocks, keyed by
their bits, has the pair in one bucket.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import staged

BITS = 64
#: Two counters of 32 bits in one long: bits i and i + 32 of a hash, shifted by i.
LANES = (1 << 32) + 1
LOW = (1 << 32) - 1
#: Characters of a term that count as weight. Weights of a text must stay below 2^31: about 10^8 terms.
LONGEST = 12


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys and fingerprint (long) of every row; ``keys`` must tell rows apart. Texts without terms have zero.

    Votes are summed where the terms are, so that only 33 numbers a row are shuffled.
    """
    exploded = rows.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("_term"))
    weighted = exploded.select(*keys, F.xxhash64("_term").alias("_h"), F.least(F.length("_term"), F.lit(LONGEST)).cast("long").alias("_w"))
    votes = [
        F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_v{i}") for i in range(BITS // 2)
    ]
    summed = weighted.groupBy(*keys).agg(F.sum("_w").alias("_total"), *votes)

    def bits(lanes: Column, i: Column) -> Column:
        """Bits i and i + 32 of the fingerprint."""
        low, high = lanes.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(lanes, 32)
        shifted = lambda count, at: F.when(2 * count > F.col("_total"), F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(0)
        return shifted(low, i) + shifted(high, i + 32)

    # One small function for all lanes: the generated code stays short.
    lanes = F.array(*(F.col(f"_v{i}") for i in range(BITS // 2)))
    fingerprint = F.aggregate(F.transform(lanes, bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return summed.select(*keys, fingerprint.alias("fingerprint"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def in_order(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """doc_id, text, next_text, bucket and place: rows in ascending order of id, ties by text, nulls first.

    The order is kept by ranges of ids: a window runs inside a range, and the last row of a range looks up the first
    one of the next range (after the last range, of the first). Ranges come from quantiles, one row of borders.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [F.lit(i / buckets) for i in range(1, buckets)] or [F.lit(0.5)]
    borders = rows.agg(F.percentile_approx("doc_id", F.array(*shares), 10_000).alias("b")).first()["b"] or []
    border = F.array(*(F.lit(b) for b in sorted(set(borders)))).cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(border, lambda b: b < F.col("doc_id"))))
    rows = rows.withColumns({"bucket": bucket, "rank": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    order = Window.partitionBy("bucket").orderBy("rank", "doc_id", "text")
    placed = rows.withColumns({"place": F.row_number().over(order), "following": F.lead("text").over(order)})
    # One row for each range: where the next one begins.
    begins = sorted((r["bucket"], r["rank"]) for r in rows.groupBy("bucket").agg(F.min("rank").alias("rank")).collect())
    follow = [(a, b, rank) for (a, _), (b, rank) in zip(begins, begins[1:] + begins[:1])]
    starts = docs.sparkSession.createDataFrame(follow, "bucket int, to int, rank long")
    firsts = (
        rows.join(F.broadcast(starts.select(F.col("to").alias("bucket"), "rank")), ["bucket", "rank"])
        .groupBy(F.col("bucket").alias("to")).agg(F.min(F.struct("doc_id", "text"))["text"].alias("first_text"))
    )
    nexts = starts.join(firsts, "to").select("bucket", "first_text")
    return placed.join(nexts, "bucket", "left").select("doc_id", "text", F.coalesce("following", "first_text").alias("next_text"), "bucket", "place")


def edited(text: str, following: str) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many of the following text, or all."""
    return F.expr(f"concat(substring({text}, 1, cast(ceil(length({text}) / 2.0) AS int)), substring({following}, 1, cast(floor(length({text}) / 2.0) AS int)))")


def block_masks(blocks: int) -> list[int]:
    base, more = divmod(BITS, blocks)
    widths = [base + (i < more) for i in range(blocks)]
    masks = [((1 << w) - 1) << sum(widths[:i]) for i, w in enumerate(widths)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def permuted_tables(blocks: int, radius: int) -> list[tuple[int, list[int]]]:
    """For each choice of blocks - radius blocks: their mask, and the masks of the other blocks before the last of them.

    A pair is taken from the table of its first equal blocks only: all of those other blocks must differ.
    """
    masks = block_masks(blocks)
    return [
        (sum(masks[i] for i in chosen), [masks[i] for i in range(chosen[-1]) if i not in chosen]) for chosen in combinations(range(blocks), blocks - radius)
    ]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fp, distance) for every fp of ``prints`` within ``radius`` bits of a fingerprint of ``queries``.

    Both frames have a column fp of distinct fingerprints; the query's own fingerprint is found as well if it is there.
    """
    tables = permuted_tables(blocks, radius)
    pad = [-1] * radius
    keyed = lambda df, name: df.select(
        F.col("fp").alias(name),
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask)).alias("key")) for t, (mask, _) in enumerate(tables)))).alias("at"),
    ).select(name, "at.t", "at.key")
    queried = keyed(queries, "query")
    differ = F.array(*(F.array(*(F.lit(m) for m in (others + pad)[:radius])) for _, others in tables))
    queried = queried.select("query", "t", "key", *(differ[F.col("t")][i].alias(f"m{i}") for i in range(radius)))
    xor = F.col("query").bitwiseXOR(F.col("fp"))
    first_table = reduce(lambda a, b: a & b, (xor.bitwiseAND(F.col(f"m{i}")) != 0 for i in range(radius)))
    # Equal fingerprints agree in every table: they are taken from the first one.
    near = (F.bit_count(xor) <= radius) & (first_table | ((xor == 0) & (F.col("q.t") == 0)))
    joined = queried.alias("q").join(keyed(prints, "fp").alias("p"), (F.col("q.t") == F.col("p.t")) & (F.col("q.key") == F.col("p.key")) & near)
    return joined.select("query", "fp", F.bit_count(xor).alias("distance"))


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 50, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (longs), near_edited, near_next, n_near.

    The edited text takes its second half from the next row in order of (id, text); the last row goes on with the
    first. n_near is, for ids divisible by ``every``, the number of other rows within ``radius`` bits, else null. Null
    texts are empty; texts without terms have fingerprint zero; equal texts have equal fingerprints. Null ids come first
    in order and are never queries. An empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = in_order(docs, doc_id, text, buckets).withColumn("edited", edited("text", "next_text"))
    keys = ["doc_id", "bucket", "place", "n_chars", "edited_sha256"]
    both = rows.select(
        "doc_id", "bucket", "place", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.inline(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edited"), F.coalesce("edited", F.lit("")).alias("body")))),
    )
    prints = staged(simhash(both, [*keys, "is_edited"], "body"), "prints")
    pair = prints.groupBy(*keys).agg(
        F.max(F.when(~F.col("is_edited"), F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("is_edited"), F.col("fingerprint"))).alias("edited_fingerprint")
    )
    order = Window.partitionBy("bucket").orderBy("place")
    placed = pair.withColumn("following", F.lead("fingerprint").over(order))
    firsts = prints.filter("place = 1 AND NOT is_edited").select("bucket", F.col("fingerprint").alias("first"))
    ranges = firsts.agg(F.sort_array(F.collect_list(F.struct("bucket", "first"))).alias("all"))
    nexts = ranges.select(
        F.inline(F.zip_with("all", F.concat(F.slice("all", 2, buckets + 1), F.slice("all", 1, 1)), lambda a, b: F.struct(a["bucket"].alias("bucket"), b["first"].alias("first"))))
    )
    found = placed.join(nexts, "bucket", "left").withColumn("next_fingerprint", F.coalesce("following", "first"))
    own = prints.filter("NOT is_edited")
    counted = own.groupBy(F.col("fingerprint").alias("fp")).agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asked"))
    near = within_radius(counted.filter("asked").select("fp"), counted.select("fp"), radius)
    n_near = near.join(counted.select("fp", "rows"), "fp").groupBy(F.col("query").alias("fingerprint")).agg((F.sum("rows") - 1).alias("n_near"))
    return found.join(n_near, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"), F.when(F.col("doc_id") % every == 0, F.col("n_near")).alias("n_near"),
    )
