"""Mixing sources to target weights, in DataFrame operations only.

Temperature mixing: a source with the share p of all tokens gets a weight in proportion to p^a. A smaller exponent a flattens the
weights, which raises their entropy and the passes over small sources. Taken is the largest a in [0, 1] at which the entropy
still reaches its target, or, if some source would then repeat more often than the limit allows, the smallest a that keeps to
the limit. It is bisected, five halvings at a time, each as one aggregate over the table of sources.

The weights are realised on a budget of tokens, by default the least at which no document is left out. A source of T tokens
is due weight * budget tokens: whole passes, and for the rest a part of one more. For that part its documents are dealt by hash
into blocks; blocks are taken in order up to the one in which the rest runs out, and in that one the documents, in hash
order, that start before it does. Only this block of a source is ever put in order.

Tokens are words (runs of other characters than ASCII white space), at least 1 for each row, so null and empty texts count
too. A null source is a source. Rows that repeat are rows of their own, with equal hashes, and are taken alike.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritrail.llm.shared import written

#: Least entropy of the weights as a share of the greatest possible, most passes over a source, tokens in a block.
ENTROPY_SHARE, MOST_PASSES, BLOCK_TOKENS = 0.97, 2.0, 2_000_000
#: Halvings of the exponent's interval in one aggregate, and aggregates.
_HALVINGS, _ROUNDS = 5, 6
_OUT = ("mix_tokens", "mix_weight", "mix_copies", "mix_block", "mix_order", "mix_orders")


def n_tokens(text: Column) -> Column:
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("long")


def _exponent(sums: DataFrame, entropy_share: float, most_passes: float, budget: float | None) -> tuple[float, float]:
    """The exponent, and the budget."""
    whole = sums.agg(F.sum("source_tokens").cast("double").alias("all"), F.max("source_tokens").alias("most"), F.min("source_tokens").alias("fewest"), F.count("*").alias("n")).first()
    share = F.col("source_tokens") / F.lit(whole["all"])
    low, high = 0.0, 1.0

    def measured(grid: list[float]):
        """(z, entropy of the weights) at each exponent, with z the sum of p^a."""
        powers = [F.pow(share, F.lit(a)) for a in grid]
        row = sums.agg(F.array(*map(F.sum, powers)).alias("z"), F.array(*(F.sum(p * F.ln(share)) for p in powers)).alias("l")).first()
        return [(z, log(z) - a * pl / z) for a, z, pl in zip(grid, row["z"], row["l"], strict=True)]

    def spent(a: float, z: float) -> float:
        return budget or whole["most"] * z / (whole["most"] / whole["all"]) ** a

    def too_low(a: float, z: float, entropy: float) -> bool:
        passes = (whole["fewest"] / whole["all"]) ** a / z * spent(a, z) / whole["fewest"]
        return entropy >= entropy_share * log(whole["n"]) - 1e-12 or passes > most_passes + 1e-12

    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / 2**_HALVINGS for k in range(2**_HALVINGS + 1)]
        k = sum(too_low(a, *x) for a, x in zip(grid, measured(grid), strict=True))  # it holds up to some exponent
        low, high = grid[max(k - 1, 0)], grid[min(k, len(grid) - 1)]
    return high, spent(high, measured([high])[0][0])


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES, budget: float | None = None) -> DataFrame:
    """docs with mix_tokens, mix_weight (of its source), mix_copies (how often the mix takes it), mix_block, mix_order and mix_orders.

    mix_order decides which documents the last pass over a source still takes; mix_orders has a number for each pass that takes the
    document, drawn anew for every pass, by which a reader orders that pass.

    Columns of these names are replaced, all others and all rows stay. An empty table stays empty.
    """
    docs = docs.drop(*_OUT)
    hashed = F.shiftright(F.xxhash64(key, text, source), 1)
    marked = docs.withColumns({"mix_tokens": n_tokens(F.col(text)), "mix_order": hashed})
    slim = written(marked.select(F.col(source).alias("mix_source"), "mix_tokens", "mix_order"))
    sums = written(slim.groupBy("mix_source").agg(F.sum("mix_tokens").alias("source_tokens")))
    nothing = sums.isEmpty()
    exponent, spent = (1.0, 0.0) if nothing else _exponent(sums, entropy_share, most_passes, budget)
    power = F.pow(F.col("source_tokens").cast("double"), F.lit(exponent))
    z = 1.0 if nothing else sums.agg(F.sum(power)).first()[0]
    due = F.col("mix_weight") * F.lit(spent)
    passes = F.floor(due / F.col("source_tokens") + F.lit(1e-9))
    plan = sums.withColumn("mix_weight", power / F.lit(z)).withColumns(
        {"__passes": passes, "__rest": F.greatest(F.round(due - passes * F.col("source_tokens")), F.lit(0.0)).cast("long"), "__blocks": F.ceil(F.col("source_tokens") / F.lit(BLOCK_TOKENS))}
    )
    block = F.pmod(F.xxhash64("mix_order"), F.col("__blocks"))
    same = F.col("mix_source").eqNullSafe(F.col("__s"))
    plan = written(plan.withColumnRenamed("mix_source", "__s"))

    dealt = slim.join(plan, same).withColumn("__block", block)
    filled = dealt.groupBy("__s", "__block").agg(F.sum("mix_tokens").alias("__filled"), F.first("__rest").alias("__rest"))
    before = F.sum("__filled").over(Window.partitionBy("__s").orderBy("__block")) - F.col("__filled")
    last = filled.withColumn("__left", F.col("__rest") - before).filter("__left > 0").groupBy("__s").agg(F.max_by(F.struct(F.col("__block").alias("block"), F.col("__left").alias("left")), "__block").alias("__last"))
    last = written(last.select(F.col("__s").alias("__s2"), F.col("__last.block").alias("__last_block"), F.col("__last.left").alias("__left")))
    cut = dealt.join(last, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__block") == F.col("__last_block")))
    start = F.coalesce(F.sum("mix_tokens").over(Window.partitionBy("__s").orderBy("mix_order").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = cut.withColumn("__start", start).filter("__start < __left").groupBy("__s2").agg(F.max("mix_order").alias("__last_order"), F.first("__last_block").alias("__last_block"))
    plan = written(plan.join(cut, F.col("__s").eqNullSafe(F.col("__s2")), "left").select("__s", "mix_weight", "__passes", "__blocks", "__last_block", "__last_order"))

    own = "__plan"
    while own in docs.columns:
        own += "_"
    of = lambda k: F.col(own)[k]
    out = marked.join(plan.select(F.struct(*plan.columns).alias(own)), F.col(source).eqNullSafe(of("__s"))).withColumn("mix_block", F.pmod(F.xxhash64("mix_order"), of("__blocks")))
    more = (F.col("mix_block") < of("__last_block")) | ((F.col("mix_block") == of("__last_block")) & (F.col("mix_order") <= of("__last_order")))
    out = out.withColumn("mix_copies", (of("__passes") + F.when(more, 1).otherwise(0)).cast("long")).withColumn("mix_weight", of("mix_weight"))
    each = F.transform(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")), lambda turn: F.xxhash64("mix_order", turn))
    out = out.withColumn("mix_orders", F.when(F.col("mix_copies") > 0, each).otherwise(F.array().cast("array<long>")))
    return out.select(*docs.columns, *_OUT)
