"""Mixing of sources by temperature, with DataFrame functions only.

A source's share q of the corpus's tokens (words) becomes a weight proportional to q ** alpha. The exponent is found by
repeated sections of [0, 1] on a grid of 2 ** -20: the largest alpha whose weights have at least the target entropy
(``evenness`` times that of equal weights), or the least alpha for which no source is repeated more than ``max_repeats`` times, if
that is larger. Weights times the budget are token budgets for each source, realised as permutations of blocks: the leading bits
of a document's hash name its block; an epoch is a permutation of the source's blocks; as many whole epochs are taken as the
budget holds, then the first blocks of one more, then the first documents of the block where the budget ends.

Scale: one pass sums tokens by (source, block); sections and permutations run on these sums, at most ``2 ** BLOCK_BITS`` rows for
each source. The block where a budget ends is cut by hash once more, and of its ``2 ** BLOCK_BITS`` parts only the one where the
budget ends is ordered by document. The plan is joined back by broadcast while it is
below ``BROADCAST_ROWS`` rows, else by a shuffle on source and block, which deals a source out over all its blocks.

Defined results: a null source is a source; documents without words weigh nothing and come with their block; a source without
any word has weight 0 and yields no rows; rows equal in doc_id and text are taken together; null doc_ids are allowed; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .work import Work, fresh

EVENNESS, MAX_REPEATS, SEED = 0.95, 4.0, 17
GRID_BITS, SECTION_BITS, BLOCK_BITS = 20, 5, 10
BROADCAST_ROWS = 100_000
#: Of the hash: 60 bits, so that they fit a long.
HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def document_hash(seed: int) -> Column:
    return _hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))


def block_order(seed: int, epoch: Column, source: Column, block: Column) -> Column:
    """The key by which an epoch orders its blocks."""
    return _hash(F.lit(str(seed)), epoch.cast("string"), F.coalesce(source, F.lit("")), block.cast("string"))


def _section(shares: DataFrame, budget: float, step: int, low: int) -> list[tuple[int, float, float]]:
    """Entropy and greatest repetition of the weights at the grid points low, low + step, ..."""
    points = F.array(*[F.lit(low + i * step) for i in range((1 << SECTION_BITS) + 1)])
    alpha = F.col("k") / (1 << GRID_BITS)
    powered = shares.select("q", "tokens", F.explode(points).alias("k")).withColumn("p", F.pow("q", alpha))
    sums = powered.groupBy("k").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("tokens")).alias("most"))
    rows = sums.select("k", (F.log("z") - F.col("plogp") / F.col("z")).alias("entropy"), (F.col("most") / F.col("z") * budget).alias("repeats")).collect()
    return sorted((r.k, r.entropy, r.repeats) for r in rows)


def find_exponent(shares: DataFrame, budget: float, target_entropy: float, max_repeats: float) -> int:
    """The exponent, in steps of the grid, from columns q (share) and tokens of each source."""
    top = 1 << GRID_BITS

    def last(holds) -> int:
        """The largest grid point from 0 on where ``holds``, which doesn't hold again once it has ceased to; -1 for none."""
        low, step = 0, top >> SECTION_BITS
        while True:
            points = [p for p in _section(shares, budget, step, low) if p[0] <= top]
            kept = -1
            for k, entropy, repeats in points:
                if not holds(entropy, repeats):
                    break
                kept = k
            if kept < 0 or kept == top or step == 1:
                return kept
            low, step = kept, max(1, step >> SECTION_BITS)

    tiny = 1e-12
    by_entropy = max(0, last(lambda entropy, repeats: entropy >= target_entropy - tiny))
    by_repeats = min(top, last(lambda entropy, repeats: repeats > max_repeats + tiny) + 1)
    return max(by_entropy, by_repeats)


def plan_mix(docs: DataFrame, budget: int | None = None, evenness: float = EVENNESS, max_repeats: float = MAX_REPEATS, seed: int = SEED, work: Work | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): weights and budgets of each source; for each source and block the whole copies to take, and the
    greatest document hash of one more copy (null for none). ``budget`` is in words; by default the corpus's own number."""
    work = work or Work(docs.sparkSession, "mixing")
    narrow = docs.select("source", word_count(F.col("text")).alias("n_tokens"), document_hash(seed).alias("u"))
    narrow = work.save(narrow.withColumn("block", F.shiftright("u", HASH_BITS - BLOCK_BITS)), "narrow")
    blocks = work.save(narrow.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), "blocks")
    totals = work.save(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), "totals")
    total, count = totals.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total = total or 0
    budget = total if budget is None else budget
    shares = totals.withColumn("q", F.col("tokens") / F.lit(max(total, 1)))
    target = F.log(F.lit(float(max(count, 1))))
    entropy = evenness * docs.sparkSession.range(1).select(target).first()[0]
    k = find_exponent(shares, float(budget), entropy, max_repeats) if count else 1 << GRID_BITS
    raw = shares.withColumn("p", F.pow("q", F.lit(k) / (1 << GRID_BITS)))
    z = raw.agg(F.sum("p")).first()[0] or 1.0
    sources = raw.select("source", "tokens", "q", (F.col("p") / z).alias("weight")).withColumn("budget", F.floor(F.col("weight") * budget + F.lit(1e-6)).cast("long"))
    sources = work.save(sources.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")), "sources")

    small = F.broadcast(sources.select(F.col("source").alias("__s"), "epochs", "rest")) if count <= BROADCAST_ROWS else sources.select(F.col("source").alias("__s"), "epochs", "rest")
    planned = blocks.join(small, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    order = Window.partitionBy("source").orderBy(block_order(seed, F.col("epochs"), F.col("source"), F.col("block")), "block")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planned = planned.withColumn("left", F.col("rest") - before)
    whole = F.col("epochs") + (F.col("left") >= F.col("tokens")).cast("int")
    planned = work.save(planned.select("source", "block", whole.alias("copies"), F.when((F.col("left") > 0) & (F.col("left") < F.col("tokens")), F.col("left")).alias("left")), "planned")

    ends = planned.filter("left is not null").select(F.col("source").alias("__s"), F.col("block").alias("__b"), "left")
    edge = narrow.join(F.broadcast(ends) if count <= BROADCAST_ROWS else ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    edge = edge.select("source", "block", "left", "n_tokens", "u", F.shiftright("u", HASH_BITS - 2 * BLOCK_BITS).alias("part"))
    parts = edge.groupBy("source", "block", "part").agg(F.sum("n_tokens").alias("tokens"), F.max("u").alias("last"), F.max("left").alias("left"))
    parts = parts.withColumn("before", F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("part")) - F.col("tokens"))
    parts = work.save(parts.filter("before <= left"), "parts")
    whole = parts.filter("before + tokens <= left").select("source", "block", F.col("last").alias("u"))
    at = parts.filter("before + tokens > left").select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("part").alias("__p"), "before")
    inner = edge.join(F.broadcast(at) if count <= BROADCAST_ROWS else at, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")) & (F.col("part") == F.col("__p")))
    upto = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "block", "part").orderBy("u"))  # rows of one hash together
    inner = inner.withColumn("upto", upto).filter("upto <= left").select("source", "block", "u")
    cuts = whole.unionByName(inner).groupBy("source", "block").agg(F.max("u").alias("cut"))
    cuts = cuts.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "cut")
    final = planned.join(cuts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")), "left").select("source", "block", "copies", "cut")
    return sources, work.save(final, "plan").filter("copies > 0 or cut is not null")


def _copies(docs: DataFrame, blocks: DataFrame, seed: int) -> tuple[DataFrame, str, str]:
    """``docs`` with a row for each time a document is taken, and the names of the columns that hold its block and epoch."""
    u, block, epoch, times, source, key, copies, cut = (fresh(docs, x) for x in ("hash_", "block", "epoch", "times", "of_source", "of_block", "copies", "cut"))
    plan = blocks.withColumnsRenamed({"source": source, "copies": copies, "cut": cut}).withColumnRenamed("block", key)
    if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    hashed = docs.withColumn(u, document_hash(seed)).withColumn(block, F.shiftright(u, HASH_BITS - BLOCK_BITS))
    joined = hashed.join(plan, F.col("source").eqNullSafe(F.col(source)) & (F.col(block) == F.col(key)))
    taken = joined.withColumn(times, F.col(copies) + F.coalesce((F.col(u) <= F.col(cut)).cast("int"), F.lit(0))).filter(F.col(times) > 0)
    return taken.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(times) - 1))), block, epoch


def mixed_order(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block, block_order: a row for each time a document is taken.

    The mix is read in ascending (epoch, block_order, doc hash): blocks of all sources follow one another in random order.
    """
    _, blocks = plan_mix(docs, seed=seed, **options)
    taken, block, epoch = _copies(docs.select("doc_id", "source", "text"), blocks, seed)
    return taken.select("doc_id", "source", word_count(F.col("text")).alias("n_tokens"), F.col(epoch).alias("epoch"), F.col(block).alias("block"), block_order(seed, F.col(epoch), F.col("source"), F.col(block)).alias("block_order"))


def mix_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes it."""
    _, blocks = plan_mix(docs.select("doc_id", "source", "text"), seed=seed, **options)
    return _copies(docs, blocks, seed)[0].select(*docs.columns)
