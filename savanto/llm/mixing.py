"""Mixing sources to target weights.

The token shares of the sources are raised to a temperature exponent between 0 (equal weights) and 1
(the shares as they are) and normalised. The exponent is bisected: the flattest mixture that repeats no
source more than a limit, or the one nearest to the shares whose entropy meets a target. With a budget of
tokens every source gets its quota of whole documents, as one permutation of its blocks after another: a
source that gets more than it has is gone through again in another order, and the last pass ends where
the quota does. Without a budget the source with the largest share per weight is used exactly once, so
every document appears at least once.

A source's documents are dealt to blocks by a hash; each pass orders the blocks, and the documents of a
block, by other hashes. Only one row for each source, and one for each block, are ever put in order by
themselves, so a source with most of the documents is spread like any other.

Null texts have no tokens; a source without tokens is passed once, whole. A null source is a source.
Rows that repeat are documents of their own; equal hashes are ordered by text. An empty table gives an
empty result. All other columns are kept; columns named like the results are replaced, and no
column may be named ``__mix_`` and something. Long texts are rows like any other; a block is a number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from savanto.llm.common import whole_text
from savanto.session import written
from savanto.skew import broadcast_if_small

#: Documents in a block, about.
BLOCK = 4096
#: Halvings of the exponent, and those decided by one pass over the sources.
STEPS, AT_ONCE = 60, 6


def words(text: Column) -> Column:
    """Words between blanks; an empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ", -1))).cast("long")


@dataclass(frozen=True)
class Target:
    """What the exponent must meet: no source repeated more than ``repeats`` times, or, if given, an
    ``entropy`` of the weights in nats (capped by that of equal weights)."""

    repeats: float = 2.0
    entropy: float | None = None
    budget: int | None = None


def weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent for t in tokens]
    all_ = sum(raised)
    return [r / all_ for r in raised]


def quotas(tokens: list[int], exponent: float, budget: int | None) -> list[int]:
    """Tokens of each source."""
    w = weights(tokens, exponent)
    whole = max(t / x for t, x in zip(tokens, w, strict=True)) if budget is None else budget
    return [math.floor(x * whole + 0.5) for x in w]


def exponent(tokens: list[int], target: Target) -> float:
    """The exponent that meets the target, by bisection."""
    shares = [t / sum(tokens) for t in tokens]

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        return [(math.fsum(p**e for p in shares), math.fsum(p**e * math.log(p) for p in shares)) for e in exponents]

    return _bisected(target, sum(tokens), min(tokens), max(tokens), sums)


def _bisected(target: Target, total: int, least: int, most: int, sums: Callable[[list[float]], list[tuple[float, float]]]) -> float:
    """The exponent, from the tokens of all sources, of the smallest and of the largest, and from the sums
    over the sources of ``p ** e`` and ``p ** e * ln p`` at several exponents at a time."""
    low, high = least / total, most / total
    by_entropy = target.entropy is not None

    def good(exponents: list[float]) -> dict[float, bool]:
        if by_entropy:
            kept = [math.log(s) - e * d / s >= target.entropy for e, (s, d) in zip(exponents, sums(exponents), strict=True)]
        elif target.budget is None:
            # per token the smallest source is repeated most, the largest once
            kept = [(low**e / low) / (high**e / high) <= target.repeats for e in exponents]
        else:
            kept = [low**e / s * target.budget / least <= target.repeats for e, (s, _) in zip(exponents, sums(exponents), strict=True)]
        return dict(zip(exponents, kept, strict=True))

    def middles(best: float, other: float, depth: int) -> set[float]:
        if not depth:
            return set()
        middle = (best + other) / 2
        return {middle} | middles(middle, other, depth - 1) | middles(best, middle, depth - 1)

    # entropy falls with the exponent: the largest good one; repeats fall too: the smallest good one
    best, other = (0.0, 1.0) if by_entropy else (1.0, 0.0)
    if good([other])[other]:
        return other
    for _ in range(STEPS // AT_ONCE):
        decided = good(sorted(middles(best, other, AT_ONCE)))
        for _ in range(AT_ONCE):
            middle = (best + other) / 2
            best, other = (middle, other) if decided[middle] else (best, middle)
    return best


def _hash(*parts: Column | str | int) -> Column:
    """Hexadecimal digits that depend on all parts."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """``(source, tokens, docs, quota, n_blocks)`` for each source; the driver sees sums over them only."""
    found = written(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-sources")
    live = found.where("tokens > 0")
    total, least, most = live.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    quota = F.lit(0).cast("long")
    if total:
        share = F.col("tokens") / F.lit(float(total))

        def sums(exponents: list[float]) -> list[tuple[float, float]]:
            raised = live.select(share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("e")).withColumn("r", F.pow("p", "e"))
            rows = raised.groupBy("e").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.log("p")).alias("d")).collect()
            at = {r["e"]: (r["s"], r["d"]) for r in rows}
            return [at[e] for e in exponents]

        e = _bisected(target, total, least, most, sums)
        all_ = sums([e])[0][0]
        whole = most / ((most / total) ** e / all_) if target.budget is None else target.budget
        quota = F.when(F.col("tokens") > 0, F.floor(F.pow(share, F.lit(e)) / F.lit(all_) * F.lit(float(whole)) + 0.5)).otherwise(quota)
    return found.select("source", "tokens", "docs", quota.alias("quota"), F.ceil(F.col("docs") / BLOCK).alias("n_blocks"))


def mix(docs: DataFrame, target: Target = Target(), seed: int = 1, tokens: Column | None = None) -> DataFrame:  # noqa: B008
    """The rows of the mixture: all columns of ``docs`` with ``n_tokens``, ``epoch`` (the pass, from 0) and
    ``place`` (the row's place in its source's pass, from 0)."""
    measure = words(whole_text()) if tokens is None else tokens
    sized = docs.drop("n_tokens", "epoch", "place").withColumn("n_tokens", measure)
    light = written(sized.select("source", "doc_id", F.col("n_tokens").alias("tokens")), "mixing-sizes")
    sources = broadcast_if_small(plan(light, target))
    same = lambda df: df["source"].eqNullSafe(sources["source"])

    in_blocks = lambda n: F.pmod(F.conv(F.substring(_hash(seed, F.coalesce("doc_id", F.lit(-1))), 1, 8), 16, 10).cast("long"), F.col(n))
    blocks = (
        light.join(sources.select("source", "n_blocks"), same(light))
        .select(light["source"], "tokens", in_blocks("n_blocks").alias("block"))
        .groupBy("source", "block")
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    )
    # passes: a source without tokens one; the last one takes what is left of the quota
    of_source = sources.select("source", F.col("tokens").alias("of_source"), "quota")
    n_epochs = F.when(F.col("of_source") > 0, F.ceil(F.col("quota") / F.col("of_source"))).otherwise(1)
    passes = (
        blocks.join(of_source, same(blocks))
        .select(blocks["source"], "block", "tokens", "docs", "of_source", "quota", n_epochs.cast("long").alias("n"))
        .where("n > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    )
    before = Window.partitionBy("source", "epoch").orderBy(_hash(seed, F.col("epoch"), "block", F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("quota") - F.col("epoch") * F.col("of_source") - F.coalesce(F.sum("tokens").over(before), F.lit(0))
    # one block name for the join and the window, so that texts move once
    name = lambda source, block: F.concat_ws(":", block.cast("string"), F.coalesce(source, F.lit("")), source.isNull().cast("string"))
    schedule = (
        passes.select("source", "block", "epoch", "of_source", left.alias("left"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first"))
        .where("left > 0 or of_source = 0")
        # names that no column of the documents is likely to have
        .select(
            name(F.col("source"), F.col("block")).alias("__mix_block"), F.col("epoch").alias("__mix_epoch"), (F.col("of_source") == 0).alias("__mix_whole"),
            F.col("left").alias("__mix_left"), F.col("first").alias("__mix_first"),
        )
    )
    schedule = written(schedule, "mixing-schedule")

    of_blocks = sources.select(F.col("source").alias("__mix_source"), F.col("n_blocks").alias("__mix_blocks"))
    spread = sized.join(of_blocks, sized["source"].eqNullSafe(F.col("__mix_source")))
    spread = spread.withColumn("__mix_block", name(F.col("source"), in_blocks("__mix_blocks"))).drop("__mix_source", "__mix_blocks")
    chosen = spread.join(schedule, "__mix_block")
    order = [_hash(seed, F.col("__mix_epoch"), "doc", F.coalesce("doc_id", F.lit(-1))), F.col("doc_id"), F.col("text")]
    in_block = Window.partitionBy("__mix_block", "__mix_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = chosen.withColumn("__mix_used", F.coalesce(F.sum("n_tokens").over(in_block), F.lit(0))).withColumn(
        "place", F.col("__mix_first") + F.coalesce(F.count(F.lit(1)).over(in_block), F.lit(0))
    )
    return out.where("__mix_used < __mix_left or __mix_whole").select(*sized.columns, F.col("__mix_epoch").alias("epoch"), "place")
