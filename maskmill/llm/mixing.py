"""Mixing sources to target weights by Pfair scheduling (operator 1).

Target weights are exact fractions; scaled to whole numbers without a common divisor they are the shares, and their sum is the
period P. Block k of a source with share a may start at slot floor(k P / a) and is due by slot ceil((k + 1) P / a). Slot by slot
the released block with the earliest deadline goes first; so in every prefix each source is less than one block from its target
weight. The schedule repeats every P slots, so the driver works out one period only, and a block's slot follows from its number
by arithmetic.

When a source runs out, a new phase begins in which the others keep their shares: no row is left out or repeated, and there
are no more phases than sources. All phases together have at most MAX_SLOTS slots to work out and to broadcast, or ValueError.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

BLOCK_ROWS = 16
MAX_SOURCES, MAX_SLOTS = 10_000, 500_000
MIX_COLUMNS = ("mix_block", "mix_slot", "mix_position")
_NULL = "\u0000null"


def exact(weight) -> Fraction:
    """A whole number, fraction or decimal as it is written; a float next to a simple fraction is that fraction."""
    found = Fraction(str(weight)) if isinstance(weight, float) else Fraction(weight)
    near = found.limit_denominator(1000)
    if found <= 0:
        raise ValueError("weights must be above 0")
    return near if isinstance(weight, float) and abs(found - near) < Fraction(1, 10**12) else found


def shares(weights: dict) -> dict:
    """The weights as whole numbers without a common divisor."""
    fractions = {k: exact(w) for k, w in weights.items()}
    scale = math.lcm(*(f.denominator for f in fractions.values()))
    whole = {k: int(f * scale) for k, f in fractions.items()}
    divisor = math.gcd(*whole.values())
    return {k: w // divisor for k, w in whole.items()}


def one_period(share: dict) -> list:
    """The source of each slot: earliest deadline first among released blocks; ties to the larger share, then the name."""
    p = sum(share.values())
    waiting = [(0, str(k), k, 0) for k in share]
    heapq.heapify(waiting)
    ready: list = []
    out = []
    for slot in range(p):
        while waiting and waiting[0][0] <= slot:
            _, name, k, n = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(n + 1) * p // share[k]), -share[k], name, k, n))
        _, _, name, k, n = heapq.heappop(ready)
        out.append(k)
        if n + 1 < share[k]:
            heapq.heappush(waiting, ((n + 1) * p // share[k], name, k, n + 1))
    return out


def phases(blocks: dict, share: dict) -> tuple[list[tuple], list[tuple]]:
    """Rows (source, phase, first block, end block, first slot, share, period) and (source, phase, number, slot in period).

    blocks: how many blocks each source has. There is at most one phase for each source, each worked out over one period.
    """
    left, first, base, out, pattern = {k: n for k, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, [], []
    for phase in range(len(blocks)):
        if not left:
            break
        own = shares({k: share[k] for k in left})
        if len(pattern) + sum(own.values()) > MAX_SLOTS:
            raise ValueError(f"the schedule has more than {MAX_SLOTS} slots: give weights with a smaller common denominator")
        order = one_period(own)
        p, at = len(order), {k: [] for k in own}
        for slot, k in enumerate(order):
            pattern.append((k, phase, len(at[k]), slot))
            at[k].append(slot)
        last = min((n - 1) // own[k] * p + at[k][(n - 1) % own[k]] for k, n in left.items())
        rounds, rest = divmod(last + 1, p)
        for k in list(left):
            done = rounds * own[k] + sum(s < rest for s in at[k])
            out.append((k, phase, first[k], first[k] + done, base, own[k], p))
            first[k] += done
            left[k] -= done
            if not left[k]:
                del left[k]
        base += last + 1
    return out, pattern


def _numbered(df: DataFrame, group: str, order_by: list, rows_each: int = 2000) -> DataFrame:
    """df with `number`: the row's place in its group in the order of order_by's hash, counted without gathering a group.

    Rows fall into buckets of about rows_each by that hash; bucket sizes are summed in two levels, and only a bucket's rows
    are sorted together.
    """
    spark, digest = df.sparkSession, F.xxhash64(*order_by)
    total = df.count()
    fine = max(1, math.ceil(math.sqrt(total / rows_each)))
    hashed = df.withColumn("__h", digest).withColumn("__b", F.pmod(F.shiftright("__h", 20), F.lit(fine * fine))).withColumn("__a", (F.col("__b") / fine).cast("long"))
    sizes = cut(hashed.groupBy(group, "__a", "__b").agg(F.count("*").alias("n")))
    tops = sizes.groupBy(group, "__a").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(group, "__a", F.coalesce(F.sum("n").over(before(group).orderBy("__a")), F.lit(0)).alias("__top"))
    starts = sizes.select(group, "__a", "__b", F.coalesce(F.sum("n").over(before(group, "__a").orderBy("__b")), F.lit(0)).alias("__in"))
    starts = starts.join(tops, [group, "__a"]).select(group, "__b", (F.col("__top") + F.col("__in")).alias("__start"))
    place = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", *order_by))
    return hashed.withColumn("__p", place).join(starts, [group, "__b"]).withColumn("number", F.col("__start") + F.col("__p") - 1).drop("__h", "__a", "__b", "__p", "__start")


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", order_cols: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with mix_position: the row's place in the mix (ascending; the last block of a source may leave a gap), mix_slot:
    its block's slot, and mix_block: the block's number in its source.

    weights: target weight of each source (None names the null source); sources it does not name have the smallest weight in
    it. None: all equal. Rows of a source go in an order fixed by a hash of order_cols (default: the id); rows that share them
    take the places next to each other, in any order. Every row stays, once; columns of docs by the names of the new ones are
    replaced. An empty table gives an empty table. At most MAX_SOURCES sources, or ValueError.
    """
    spark = docs.sparkSession
    own = F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))
    kept = [c for c in docs.columns if c not in MIX_COLUMNS]
    # columns under names of their own, so that the ones nobody asks for are not read
    keyed = docs.select(*(F.col(c).alias(f"__doc{i}") for i, c in enumerate(kept)), own.alias("source"), F.struct(*(order_cols or [id_col])).alias("key"))
    counts = {r[0]: r[1] for r in keyed.groupBy("source").count().limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    given = {_NULL if k is None else str(k): exact(w) for k, w in (weights or {}).items()}
    least = min(given.values(), default=Fraction(1))
    share = shares({k: given.get(k, least) for k in counts}) if counts else {}
    rows, pattern = phases({k: -(-n // block_rows) for k, n in counts.items()}, share)
    phase_table = spark.createDataFrame(rows, "source string, phase int, k_from long, k_to long, base long, share long, period long")
    pattern_table = spark.createDataFrame(pattern, "source string, phase int, turn long, slot long")
    numbered = _numbered(keyed, "source", ["key"]).withColumn("block", F.floor(F.col("number") / block_rows))
    # both tables have at most MAX_SLOTS rows
    placed = numbered.join(F.broadcast(phase_table), "source").where((F.col("block") >= F.col("k_from")) & (F.col("block") < F.col("k_to")))
    k = F.col("block") - F.col("k_from")
    placed = placed.withColumn("turn", F.pmod(k, F.col("share"))).join(F.broadcast(pattern_table), ["source", "phase", "turn"])
    slot = (F.col("base") + F.floor(k / F.col("share")) * F.col("period") + F.col("slot")).cast("long")
    position = (slot * block_rows + F.pmod(F.col("number"), F.lit(block_rows))).cast("long")
    return placed.select(*(F.col(f"__doc{i}").alias(c) for i, c in enumerate(kept)), F.col("block").alias("mix_block"), slot.alias("mix_slot"), position.alias("mix_position"))
