"""Mixing documents to target weights by iterative proportional fitting, in Spark SQL.

The tokens of each cell (source, language, topic) are raked under caps: what a cell gives is its tokens times a factor for
each of its values, at most all its tokens, and in turn the factors of each marginal are scaled to its targets. First the
share of tokens asked for, `keep`, is lowered to what each value's tokens allow, so it is an upper bound. After `rounds`
rounds what each cell gives is held, a few plain rounds without caps make the marginals exact, and if a cell is then above
its tokens, all are scaled down alike. So expected tokens have the target marginals, whatever `keep` is; `marginals()`
tells how far they are off (targets that no mixture of the cells meets can't be reached). A cell's share of its tokens is the
probability with which each of its documents is kept: when its keyed hash, a number in [0, 1) from its id alone, is below it.

Targets are (tokens of the value) ** power, normalised: power 1 keeps a marginal, 0 makes it uniform. Explicit weights
by value may be given instead; values without one get 0, and all weights of values that do not occur are ignored.

Sums over the cells of a value are grouped aggregates, with partial sums before their exchange, joined back to the cells;
what is global (the number of tokens, the largest probability) is one number.

Edge cases: null sources, languages and topics are a value of their own. Texts without tokens weigh nothing and have
the probability of their cell, 1 if the whole cell has no tokens. Repeated rows get the same decision. An empty table gives no rows.
Extra columns are kept; those named as the ones added here are replaced. Cells number at most as many as combinations
of values and are never collected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, rest, write_table

ADDED = ("n_tokens", "weight", "probability", "selected")


def words(text: Column) -> Column:
    """How many runs of other characters than space and U+0009 to U+000D a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 48 bits of a keyed MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _targets(cells: DataFrame, name: str, target: float | dict) -> tuple[DataFrame, float]:
    """(v, share) for each value of a marginal, and the most tokens that its values allow in all."""
    by = cells.groupBy(F.col(name).alias("v")).agg(F.sum("tokens").alias("t"))
    if isinstance(target, dict):
        if not target:
            raise ValueError(f"no target weights for {name}")
        given = F.create_map(*[x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))])
        value = F.coalesce(F.element_at(given, F.coalesce(F.col("v").cast("string"), F.lit("null"))), F.lit(0.0))
    else:
        value = F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(float(target)))).otherwise(0.0)
    known = by.withColumn("w", value)
    total, least = known.agg(F.sum("w"), F.min(F.when(F.col("w") > 0, F.col("t") / F.col("w")))).first()
    share = F.when(F.lit(total or 0.0) > 0, F.col("w") / F.lit(total or 1.0)).otherwise(0.0)
    return known.select("v", share.alias("share")), (least or 0.0) * (total or 0.0)


def rake(cells: DataFrame, targets: dict[str, float | dict], rounds: int = 12, keep: float = 0.5, plain: int = 4) -> DataFrame:
    """cells (one row each: the marginals and tokens) with weight (shares that sum to 1) and probability."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    most, c, tokens = keep * total, cells, F.col("tokens").cast("double")
    for name, target in targets.items():
        shares, allowed = _targets(cells, name, target)
        most = min(most, allowed)
        c = c.join(shares.select(F.col("v").alias("_v"), F.col("share").alias(f"_share_{name}")), F.col(name).eqNullSafe(F.col("_v"))).drop("_v")
    c = write_table(c.withColumn("_x", tokens * F.lit(most / total if total else 0.0)), "raking")
    capped = F.least("_x", tokens)
    names = [*targets]
    for step in range((rounds + plain) * len(names)):
        name, last = names[step % len(names)], rounds * len(names)
        x = capped if step == last else F.col("_x")  # from here on what each cell gives is held
        now = c.groupBy(F.col(name).alias("_v")).agg(F.sum(capped if step <= last else "_x").alias("_now"))
        fit = F.when(F.col("_now") > 0, x * F.lit(most) * F.col(f"_share_{name}") / F.col("_now")).otherwise(0.0)
        new = write_table(c.join(now, F.col(name).eqNullSafe(F.col("_v"))).withColumn("_x", fit).drop("_v", "_now"), "raking")
        drop_table(c)
        c = new
    p = F.when(F.col("tokens") > 0, F.col("_x") / tokens)
    whole, high = c.agg(F.sum("_x"), F.max(p)).first()
    weight = F.col("_x") / F.lit(whole) if whole else F.lit(0.0)
    return c.select(*targets, "tokens", weight.alias("weight"), F.coalesce(p / F.lit(max(1.0, high or 0.0)), F.lit(1.0)).alias("probability"))


def marginals(raked: DataFrame, name: str, target: float | dict) -> DataFrame:
    """(v, target, share, shortfall) of a marginal: its targets, and what the expected tokens of raked cells have."""
    shares, _ = _targets(raked, name, target)
    by = raked.groupBy(F.col(name).alias("_v")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("x"))
    total = by.agg(F.sum("x")).first()[0] or math.inf
    out = shares.join(by, F.col("v").eqNullSafe(F.col("_v"))).select("v", F.col("share").alias("target"), (F.col("x") / F.lit(total)).alias("share"))
    return out.withColumn("shortfall", F.col("target") - F.col("share"))


def mix(docs: DataFrame, marginals: dict[str, Column], targets: dict[str, float | dict], key: str = "doc_id", text: str = "text", keep: float = 0.5, rounds: int = 12, seed: str = "mix:") -> DataFrame:
    """docs plus the marginals' columns where new, n_tokens, weight (of the cell), probability and selected."""
    names = list(marginals)
    plain = docs.select(*[F.col(f"`{c}`") for c in rest(docs, *ADDED)])
    rows = plain.withColumns({f"_m_{n}": c for n, c in marginals.items()} | {"n_tokens": words(F.col(text))})
    cells = rows.groupBy(*[F.col(f"_m_{n}").alias(n) for n in names]).agg(F.sum("n_tokens").alias("tokens"))
    cells = write_table(cells, "cells")
    raked = write_table(rake(cells, targets, rounds, keep), "raked")
    drop_table(cells)
    cells = raked
    cells = cells.select(*[F.col(n).alias(f"_c_{n}") for n in names], F.col("weight").alias("_c_weight"), F.col("probability").alias("_c_probability"))
    out = rows.join(cells, [F.col(f"_m_{n}").eqNullSafe(F.col(f"_c_{n}")) for n in names])
    new = [F.col(f"_m_{n}").alias(n) for n in names if n not in plain.columns]
    chosen = draw(F.col(key), seed) < F.col("_c_probability")
    return out.select(*[F.col(f"`{c}`") for c in plain.columns], *new, "n_tokens", F.col("_c_weight").alias("weight"), F.col("_c_probability").alias("probability"), chosen.alias("selected"))
