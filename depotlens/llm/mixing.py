"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's texts are shuffled by a hash and laid end to end; that stream, repeated at most max_repeats times, is cut into blocks of
equally many tokens.  The mixture is a sequence of slots.  Slot i maps its van der Corput point, the bits of i reversed, through the
cumulative number of blocks of the sources, so that every stretch of the mixture holds each source in nearly its share and the whole
holds exactly the planned blocks.  The slots of a source are ranked, and the r-th slot takes the source's r-th block.

The plan: each source gets its target share of the total; one that cannot, since max_repeats times its tokens are fewer, gives all it may,
and the rest of the total goes to the others in proportion to their targets, until none is beyond its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotlens.functions.arrow import slices
from depotlens.llm.encoding import default_tokenizer, encoder
from depotlens.operators.prefix_sum import running_sum
from depotlens.session import Workspace, spread

#: Tokens of a block.
BLOCK_TOKENS = 256
#: Texts and slots that a bucket of a running sum should hold.
BUCKET_ROWS = 100_000


def source_name(c: Column | str) -> Column:
    """Sources are compared without letter case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, "(?U)^\\s+|\\s+$", ""))


def token_counts(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Appends n_tokens of the column text, which is dropped; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in slices(batches, "text"):
            counts = [len(encode(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])

    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType())])
    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, schema)


def plan_blocks(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int, block: int = BLOCK_TOKENS) -> dict[str, int]:
    """Blocks of each source: water-filling of the total under the limits of repetition.

    ``available``: tokens by source; ``targets``: (share, max_repeats) by source.  A source without tokens, share or repeats gets none.
    The fractions of blocks go to the largest remainders that their limits allow (ties: by name).
    """
    limit = {s: available.get(s, 0) * max(0, r) // block for s, (w, r) in targets.items()}
    weight = {s: max(0.0, w) for s, (w, _) in targets.items()}
    blocks = total // block
    fixed: dict[str, int] = {}
    while True:
        free = [s for s in weight if s not in fixed and weight[s] > 0]
        left, share = blocks - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] / share * left >= limit[s]] if share else []
        if not over:
            break
        fixed |= {s: limit[s] for s in over}
    exact = {s: weight[s] / share * left for s in free} if share else {}
    plan = {s: fixed.get(s, int(exact.get(s, 0))) for s in weight}
    spare = min(blocks, sum(limit[s] for s in plan if weight[s] > 0)) - sum(plan.values())
    for s in sorted(exact, key=lambda x: (int(exact[x]) - exact[x], x)):
        if spare > 0 and plan[s] < limit[s]:
            plan[s] += 1
            spare -= 1
    return plan


def _reversed_bits(i: str, bits: int) -> Column:
    """The lowest ``bits`` bits of column i in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), max(1, bits), "0")), 2, 10).cast("bigint")


def schedule(spark: SparkSession, plan: dict[str, int]) -> DataFrame:
    """(slot, source, source_block): a low-discrepancy order of all planned blocks; source_block counts a source's slots from 0.

    Slots are generated and mapped in parallel; the table of the plan has one row for each source."""
    sources = sorted(s for s, n in plan.items() if n > 0)
    n = sum(plan[s] for s in sources)
    if not n:
        return spark.createDataFrame([], "slot bigint, source string, source_block bigint")
    bits = (n - 1).bit_length()
    points = spark.range(1 << bits).select(F.col("id").alias("i"), _reversed_bits("id", bits).alias("v")).where(F.col("v") < n)
    # With few sources a chain of comparisons stays inside generated code.
    bound, source = 0, None
    for s in sources:
        bound += plan[s]
        source = F.when(F.col("v") < bound, F.lit(s)) if source is None else source.when(F.col("v") < bound, F.lit(s))
    slots = points.select("i", source.alias("source"), F.lit(1).alias("one")).withColumn("bucket", F.floor(F.col("i") / BUCKET_ROWS).cast("bigint"))
    ranked = running_sum(slots, ["source"], "bucket", ["i"], "one", "source_block")
    ordered = running_sum(ranked.withColumn("all", F.lit(0)), ["all"], "bucket", ["i"], "one", "slot")
    return ordered.select(F.col("slot").cast("bigint").alias("slot"), "source", F.col("source_block").cast("bigint").alias("source_block"))


class Mixture:
    """A planned mixture of documents; see the module.

    ``documents`` needs doc_id, source, text; ``targets`` source, target_share, max_repeats (null repeats count as 1, null or negative
    shares as 0; of several rows for one source the shares add up and the fewest repeats hold).  Documents of sources that are not
    named or null, and texts without tokens, take no part.  ``total_tokens``: by default the tokens of the named sources.
    Both tables may have other columns, and may be empty: then so is the mixture.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK_TOKENS, tokenizer: str | None = None, seed: int = 0):
        spark = self.spark = documents.sparkSession
        self.block, self.work = block, Workspace(spark)
        # One row for each source: as small as the list of targets.
        named = targets.select(source_name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("repeats")).where("source is not null")
        self.targets = {r["source"]: (float(r["share"]), int(r["repeats"])) for r in named.groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).collect()}
        docs = documents.select("doc_id", source_name("source").alias("source"), "text").where(F.col("source").isin(list(self.targets)) & F.col("text").isNotNull() & (F.col("text") != ""))
        sized, _ = self.work.write(token_counts(docs, tokenizer or default_tokenizer()).where("n_tokens > 0"), "sized")
        tokens = {r["source"]: (r["n"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}
        self.available = {s: n for s, (n, _) in tokens.items()}
        self.total = sum(self.available.values()) if total_tokens is None else total_tokens
        self.plan = plan_blocks(self.available, self.targets, self.total, block)
        # A shuffled stream by source: the hash is the order, its upper part the bucket.
        most = max((d for _, d in tokens.values()), default=0)
        bits = max(1, (most // BUCKET_ROWS).bit_length())
        h = F.xxhash64("doc_id", F.lit(seed))
        streamed = sized.withColumns({"h": F.shiftrightunsigned(h, 1), "bucket": F.shiftrightunsigned(h, 64 - bits)})
        self.stream = running_sum(streamed, ["source"], "bucket", ["h", "doc_id"], "n_tokens", "begin").select("source", "doc_id", "n_tokens", F.col("begin").cast("bigint").alias("begin"))

    def schedule(self) -> DataFrame:
        return schedule(self.spark, self.plan)

    def pieces(self) -> DataFrame:
        """(slot, source, source_block, repeat, doc_id, token_from, token_to): which tokens of which document fill each slot."""
        per_source = lambda values, kind: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()], F.lit(None)).cast(kind)
        used = {s: n * self.block for s, n in self.plan.items() if n > 0}
        if not used:
            return self.spark.createDataFrame([], "slot bigint, source string, source_block bigint, repeat int, doc_id bigint, token_from bigint, token_to bigint")
        s = self.stream.withColumns({"used": per_source(used, "bigint"), "period": per_source(self.available, "bigint")}).where("used is not null")
        # A document lies once in each repetition of its stream that is used, and there in each block that it touches.
        rounds = F.ceil((F.col("used") - F.col("begin")) / F.col("period")).cast("int")
        laid = s.where(F.col("begin") < F.col("used")).withColumn("repeat", F.explode(F.sequence(F.lit(0), rounds - 1)))
        start = F.col("begin") + F.col("repeat") * F.col("period")
        laid = laid.withColumns({"start": start, "end": F.least(start + F.col("n_tokens"), F.col("used"))})
        b = F.lit(self.block)
        cut = laid.withColumn("source_block", F.explode(F.sequence(F.floor(F.col("start") / b).cast("bigint"), F.floor((F.col("end") - 1) / b).cast("bigint"))))
        first = F.greatest("start", F.col("source_block") * b) - F.col("start")
        last = F.least("end", (F.col("source_block") + 1) * b) - F.col("start")
        filled = cut.select("source", "source_block", "repeat", "doc_id", first.cast("bigint").alias("token_from"), last.cast("bigint").alias("token_to"))
        return filled.join(self.schedule(), ["source", "source_block"]).select("slot", "source", "source_block", "repeat", "doc_id", "token_from", "token_to")

    def shares(self) -> DataFrame:
        """What the mixture really holds, counted from its pieces: one row for each named source."""
        held = self.pieces().groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"), F.countDistinct("slot").alias("blocks"), F.max("repeat").alias("last"))
        total = sum(self.plan.values()) * self.block
        rows = [(s, float(w), r, self.available.get(s, 0)) for s, (w, r) in sorted(self.targets.items())]
        named = self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint")
        out = named.join(held, "source", "left")
        tokens = F.coalesce("tokens", F.lit(0)).cast("bigint")
        return out.select(
            "source", "target_share", (tokens / F.lit(total) if total else F.lit(None).cast("double")).alias("actual_share"), "max_repeats", (F.coalesce("last", F.lit(-1)) + 1).alias("repeats"), "available_tokens", tokens.alias("tokens"), F.coalesce("blocks", F.lit(0)).cast("bigint").alias("blocks"),
            (tokens < F.lit(total) * F.col("target_share") - self.block).alias("limited"),
        )
