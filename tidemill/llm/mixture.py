"""Mixing sources to target weights by a low-discrepancy schedule.

The mixture is a row of slots of equal size in tokens. Slot k gets the point k * g mod 1 (golden ratio, in integers);
the cumulative target weights map points to sources, so every stretch of the mixture holds each source in proportion.
Each source is shuffled (by hash, anew for each repeat), laid end to end and cut into blocks of exactly that size; its
n-th slot takes its n-th block. A record that crosses the border of blocks comes out in pieces, one per block, each with
the token it begins at, so shares are exact to a block and don't depend on the length of records.

The size of the mixture is the largest at which no record is used more than its source's cap. Sources of the targets
that have no tokens can't contribute; their share is spread over the others in proportion and reported. With ``fill``
the size is that of all tokens of the targets' sources (or total_tokens): a source that can't fill its share is used up
to its cap, what it lacks is spread over the others in proportion, and feasible_share tells the result.

Running totals within a source go over hash buckets and a summary of one row per bucket, so a source with most of the
corpus is spread over as many tasks as there are buckets.

Defined results: records without a source, of a source without a target, or without tokens (null or empty text) are
left out; several target rows for one source add their shares and keep the smallest cap; a cap below 1 leaves a
source out; no targets or no documents give an empty mixture; repeated records count as records of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import materialize

# The odd integer nearest to 2**31 divided by the golden ratio.
GOLDEN, POINTS = 1_327_217_885, 2**31
BUCKETS = 1024
CHUNK = 65_536


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    cap: int
    tokens: int
    weight: float  # of the sources that have tokens


@dataclass(frozen=True)
class Mixture:
    records: DataFrame
    shares: list[Share]
    slots: int
    block_tokens: int


def plan(targets: DataFrame, sized: DataFrame) -> list[Share]:
    """Target sources with their tokens. Collected: one row per source in the targets, whatever the corpus."""
    wanted = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("t"), F.min("max_repeats").alias("cap"))
    totals = sized.groupBy(F.col("source").alias("s")).agg(F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(totals, F.col("source") == F.col("s"), "left").select("source", "t", "cap", F.coalesce("tokens", F.lit(0)).alias("tokens")).orderBy("source").collect()
    have = sum(r.t for r in rows if r.tokens)
    return [Share(r.source, r.t, r.cap, r.tokens, r.t / have if r.tokens else 0.0) for r in rows]


def _source_of(point: Column, shares: list[Share]) -> Column:
    """The source whose stretch of the cumulative weights holds the point (an integer below POINTS)."""
    out, upto, live = None, 0.0, [s for s in shares if s.weight > 0]
    for s in live[:-1]:
        upto += s.weight
        hit = point < int(upto * POINTS)
        out = F.when(hit, s.source) if out is None else out.when(hit, s.source)
    last = F.lit(live[-1].source)
    return last if out is None else out.otherwise(last)


def schedule(spark: SparkSession, slots: int, shares: list[Share]) -> DataFrame:
    """slot, source, nth: which block of its source each slot takes. Ranks over chunks, never over a whole source."""
    point = (F.col("id") % POINTS) * F.lit(GOLDEN) % POINTS
    laid = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), _source_of(point, shares).alias("source"))
    chunks = laid.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    inside = laid.withColumn("i", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    return inside.join(carried, ["source", "chunk"]).select("slot", "source", (F.col("i") + F.col("earlier")).alias("nth"))


def blocks(sized: DataFrame, shares: list[Share], slots: int, block_tokens: int, seed: int) -> DataFrame:
    """Pieces of records with use (from 1), first_token, n_tokens, offset in tokens within their source's repeats, and block."""
    spark = sized.sparkSession
    needed = []
    for s in shares:
        if s.weight > 0:
            # a few blocks more than the share: the schedule is off by a few slots at most
            tokens = (slots * s.weight + 8) * block_tokens
            needed.append((s.source, s.tokens, int(min(s.cap, tokens // s.tokens + 1))))
    uses = spark.createDataFrame(needed, "source string, source_tokens long, uses int")
    spread = sized.join(F.broadcast(uses), "source").select("*", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("use"))
    spread = spread.withColumn("h", F.xxhash64("doc_id", "use", F.lit(seed))).withColumn("bucket", F.pmod(F.col("h"), F.lit(BUCKETS)))
    sums = spread.groupBy("source", "use", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source", "use").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("source", "use", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ahead = Window.partitionBy("source", "use", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = spread.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
    offset = (F.col("use") - 1) * F.col("source_tokens") + F.col("earlier") + F.col("ahead")
    placed = inside.join(carried, ["source", "use", "bucket"]).withColumn("offset", offset)
    first, last = F.floor(F.col("offset") / block_tokens), F.floor((F.col("offset") + F.col("n_tokens") - 1) / block_tokens)
    cut = placed.select("source", "doc_id", "use", "n_tokens", "offset", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block_tokens - F.col("offset"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_tokens - F.col("offset"), F.col("n_tokens"))
    return cut.select("source", "doc_id", "use", begin.alias("first_token"), (end - begin).alias("n_tokens"), (F.col("offset") + begin).alias("offset"), "block")


def filled(shares: list[Share], total: float) -> tuple[list[Share], float]:
    """Shares of a mixture of ``total`` tokens in which sources that can't fill theirs are used up to their cap, and its size."""
    sizes: dict[str, float] = {}
    while True:
        free = [s for s in shares if s.weight > 0 and s.source not in sizes]
        left, weight = total - sum(sizes.values()), sum(s.weight for s in free)
        short = {s.source: float(s.tokens * s.cap) for s in free if left * s.weight / weight > s.tokens * s.cap}
        if not short:
            break
        sizes |= short
    sizes |= {s.source: left * s.weight / weight for s in free}
    size = sum(sizes.values())
    return [replace(s, weight=sizes.get(s.source, 0.0) / size) for s in shares], size


def mix(
    documents: DataFrame, targets: DataFrame, sized: DataFrame | None = None, block_tokens: int = 2048, seed: int = 7, total_tokens: int | None = None, fill: bool = False
) -> Mixture:
    """The mixture: slot, source, doc_id, use, first_token, n_tokens, offset. ``total_tokens`` asks for less than the largest
    size or, with ``fill``, for another size than all tokens."""
    if sized is None:
        from tidemill.llm.encode import token_counts

        wanted = targets.select(F.col("source").alias("__s")).distinct()
        known = documents.join(F.broadcast(wanted), F.col("source") == F.col("__s"), "left_semi")
        sized = materialize(token_counts(known.select("doc_id", "source", "text"), ["doc_id", "source"]).where(F.col("n_tokens") > 0))
    shares = plan(targets, sized)
    live = [s for s in shares if s.weight > 0]
    spark = documents.sparkSession
    if not live:
        none = spark.createDataFrame([], "slot long, source string, doc_id long, use int, first_token long, n_tokens long, offset long")
        return Mixture(none, shares, 0, block_tokens)
    if fill:
        shares, size = filled(shares, total_tokens or sum(s.tokens for s in live))
    else:
        largest = min(s.tokens * s.cap / s.weight for s in live)
        size = min(largest, total_tokens or largest)
    slots = max(1, int(-(-size // block_tokens)))
    placed = blocks(sized, shares, slots, block_tokens, seed)
    plan_ = schedule(spark, slots, shares).select(F.col("source").alias("__s"), "slot", "nth")
    out = placed.join(plan_, (F.col("source") == F.col("__s")) & (F.col("block") == F.col("nth")))
    return Mixture(out.select("slot", "source", "doc_id", "use", "first_token", "n_tokens", "offset"), shares, slots, block_tokens)


def shares_reached(made: Mixture) -> DataFrame:
    """Per target source: target and reached share, tokens and records in the mixture and available, most uses of a record,
    and the tokens that the mixture leaves out."""
    spark = made.records.sparkSession
    got = made.records.groupBy(F.col("source").alias("__s")).agg(
        F.sum("n_tokens").alias("tokens"),
        F.count_if(F.col("first_token") == 0).alias("records"),
        F.max("use").alias("most_uses"),
        # a record's further uses are pieces with a use above 1
        F.sum(F.when(F.col("use") == 1, F.col("n_tokens"))).alias("__used"),
    )
    rows = [(s.source, s.target, s.weight, s.cap, s.tokens) for s in made.shares]
    asked = spark.createDataFrame(rows, "source string, target_share double, feasible_share double, max_repeats int, available_tokens long")
    joined = asked.join(got, F.col("source") == F.col("__s"), "left")
    total = F.sum("tokens").over(Window.partitionBy())
    return joined.select(
        "source",
        "target_share",
        "feasible_share",
        F.coalesce(F.try_divide("tokens", total), F.lit(0.0)).cast("double").alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        "max_repeats",
        "available_tokens",
        (F.col("available_tokens") - F.coalesce("__used", F.lit(0))).alias("unused_tokens"),
    )
