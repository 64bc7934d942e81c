"""Jaro-Winkler similarity from string functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_SCALE = 0.1
BOOST_FROM = 0.7
TAKEN = "\0"  # stands where a letter has been matched


def _matches(a: Column, b: Column) -> Column:
    """``(left, rest)``: the letters of ``a`` that match, in order, and ``b`` with its matched letters taken out.

    A letter matches the first equal one of ``b``, not yet taken, no further away than half the longer length.
    """
    reach = F.greatest(F.floor(F.greatest(F.length(a), F.length(b)) / 2) - 1, F.lit(0)).cast("int")

    def step(state: Column, i: Column) -> Column:
        letter = F.substr(a, i, F.lit(1))
        low = F.greatest(i - reach, F.lit(1))
        place = F.instr(F.substr(state["rest"], low, i + reach - low + 1), letter)
        found = place > 0
        return F.struct(
            F.when(found, F.concat(state["left"], letter)).otherwise(state["left"]).alias("left"),
            F.when(found, F.overlay(state["rest"], F.lit(TAKEN), low + place - 1, F.lit(1))).otherwise(state["rest"]).alias("rest"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(F.lit("").alias("left"), b.alias("rest")), step)


def _similarity(a: Column, b: Column, found: Column) -> Column:
    left, rest = found["left"], found["rest"]
    m = F.length(left)
    taken = F.filter(F.sequence(F.lit(1), F.length(b)), lambda j: F.substr(rest, j, F.lit(1)) == TAKEN)
    swapped = F.size(F.filter(F.transform(taken, lambda j, k: F.substr(b, j, F.lit(1)) != F.substr(left, k + 1, F.lit(1))), lambda x: x))
    jaro = (m / F.length(a) + m / F.length(b) + (m - F.floor(swapped / 2)) / m) / 3.0
    same = [F.substr(a, F.lit(1), F.lit(n)) == F.substr(b, F.lit(1), F.lit(n)) for n in (4, 3, 2, 1)]
    shorter = F.least(F.length(a), F.length(b))
    prefix = F.coalesce(*[F.when((shorter >= n) & s, F.lit(n)) for n, s in zip((4, 3, 2, 1), same, strict=True)], F.lit(0))
    boosted = F.when(jaro > BOOST_FROM, jaro + prefix * PREFIX_SCALE * (1.0 - jaro)).otherwise(jaro)
    return F.when(m == 0, F.lit(0.0)).otherwise(boosted)


def jaro_winkler(a: str | Column, b: str | Column) -> Column:
    """Jaro similarity, raised by a common prefix of up to four letters when above 0.7.

    Feed it blocked, distinct pairs only. NULL if either side is NULL; the letter ``\\0`` matches nothing.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    # bound once by a one-element array, so that the walk over the letters is made once
    found = F.transform(F.array(_matches(a, b)), lambda m: _similarity(a, b, m))[0]
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(found)


def may_reach(a: str | Column, b: str | Column, above: float) -> Column:
    """Whether the similarity can be over ``above``: a cheap bound by the letters both share.

    Jaro is at most ``(c/|a| + c/|b| + 1) / 3`` for ``c`` common letters, and the prefix adds at most
    four tenths of what is missing to 1.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    count = lambda text, letter: F.length(text) - F.length(F.replace(text, letter, F.lit("")))
    letters = F.array_distinct(F.split(a, ""))
    common = F.aggregate(letters, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    most = (common / F.greatest(F.length(a), F.lit(1)) + common / F.greatest(F.length(b), F.lit(1)) + 1) / 3.0
    return (a == b) | (F.greatest(most, most + 0.4 * (1.0 - most)) > above)
