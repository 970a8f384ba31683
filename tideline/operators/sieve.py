"""Parting rows by a bit set, so that only rows which may have one of some keys are exchanged."""
from pyspark.sql import functions as F

from tideline.session import materialize

#: Bits of a set at most: 16 MB, whatever the number of keys.
MOST = 1 << 27


class Sieve:
    """A bit set over hashes of ``keys`` (their columns ``on``): 16 to 32 bits a key while that is below ``most``.

    ``split`` gives the rows that may have one of the keys, with all that have one and about one other in 16 or fewer (more where ``most`` binds), and
    the rows that have none. Nothing is exchanged; the first part still needs an exact join. ``keys`` is read twice. Only the set, one row, is broadcast.
    Sets with another ``salt`` let other rows through.
    """

    def __init__(self, keys, on, most=MOST, salt=0):
        size = min(most, 1 << max(12, (16 * keys.count() - 1).bit_length()))
        self.place = f"pmod(xxhash64({salt}, {', '.join(on)}), {size})"
        masks = keys.selectExpr(f"{self.place} AS bit").groupBy(F.expr("bit div 64").alias("at")).agg(
            F.expr("bit_or(shiftleft(1L, cast(bit % 64 AS int)))").alias("mask"))
        every = keys.sparkSession.range(size // 64).withColumnRenamed("id", "at").join(masks, "at", "left").select("at", F.coalesce("mask", F.lit(0)).alias("mask"))
        bits = every.agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("masks")).select(F.transform("masks", lambda x: x["mask"]).alias("sieve_"))
        self.bits = materialize(bits, "sieve", compact=True)

    def split(self, rows):
        found = F.expr(f"getbit(get(sieve_, cast({self.place} div 64 AS int)), cast({self.place} % 64 AS int)) = 1")
        bits = F.broadcast(self.bits)
        return rows.join(bits, found, "left_semi"), rows.join(bits, found, "left_anti")


def without(rows, gone, on, exchanged=lambda rows, join: join(rows), most=MOST):
    """``rows`` whose columns ``on`` are not among the keys ``gone`` (stored), exactly, with their other columns exchanged for few rows only.

    Of the rows that a set over ``gone`` lets through, those it lets through wrongly are found by their keys alone; a second set over these takes them back.
    ``exchanged`` may pack rows around the join.
    """
    near, clear = Sieve(gone, on, most).split(rows)
    spared = materialize(near.select(*on).join(gone, [*on], "left_anti"), "spared", compact=True)
    back, _ = Sieve(spared, on, most, salt=1).split(near)
    return clear.unionByName(exchanged(back, lambda rows: rows.join(gone, [*on], "left_anti")))
