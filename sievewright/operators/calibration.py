"""Scales of sources that measure the same entities: pairwise offsets, known conversions, a source graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.session import drop_staged, lookup_join, stage

#: Powers of ten between units of amount or mass per volume that an offset may snap to.
CONVERSIONS = tuple(float(x) for x in range(-15, 16, 3))


def pairwise_offsets(rows: DataFrame, entity: str, source: str, log_value: str, least: int = 5, spread: float = 0.3) -> DataFrame:
    """(a, b, offset, links): the robust offset log(b) - log(a) of sources that share `least` entities or more.

    An entity has one median a source. Each is linked to the source of its smallest name only, and to the next one in
    order, so an entity in n sources gives 2n links at most and never all pairs. The offset is the median difference;
    links with a median absolute deviation above `spread` are no scale and are left out.
    """
    one = rows.where(F.col(entity).isNotNull() & F.col(source).isNotNull() & F.col(log_value).isNotNull() & ~F.isnan(log_value)).groupBy(F.col(entity).alias("e"), F.col(source).alias("s")).agg(F.median(log_value).alias("x"))
    order = Window.partitionBy("e").orderBy("s")
    near = one.select("e", F.col("s").alias("b"), F.col("x").alias("xb"), F.lag("s").over(order).alias("a"), F.lag("x").over(order).alias("xa")).where("a is not null")
    first = one.groupBy("e").agg(F.min(F.struct("s", "x")).alias("m")).select("e", F.col("m.s").alias("a"), F.col("m.x").alias("xa"))
    star = one.select("e", F.col("s").alias("b"), F.col("x").alias("xb")).join(first, "e").where("b > a")
    links = near.select("e", "a", "b", (F.col("xb") - F.col("xa")).alias("d")).union(star.select("e", "a", "b", F.col("xb") - F.col("xa"))).distinct()
    middle = links.groupBy("a", "b").agg(F.median("d").alias("offset"), F.count("*").alias("links")).where(F.col("links") >= least)
    off = links.join(middle, ["a", "b"]).groupBy("a", "b", "offset", "links").agg(F.median(F.abs(F.col("d") - F.col("offset"))).alias("mad"))
    return off.where(F.col("mad") <= spread).select("a", "b", "offset", "links")


def snapped(offsets: DataFrame, most: float = 0.5) -> DataFrame:
    """offsets with the nearest known conversion in place of an offset within `most` of it; others are left out."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.col("offset") - c).alias("gap"), F.lit(c).alias("to")) for c in CONVERSIONS]))
    return offsets.withColumn("_b", best).where(F.col("_b.gap") <= most).select("a", "b", F.col("_b.to").alias("offset"), "links")


def propagate(offsets: DataFrame, known: DataFrame) -> DataFrame:
    """(source, shift, hops): what to add to each source's log values, from sources whose shift is known.

    known holds (source, shift). Each round reaches the neighbours of reached sources, by the link with most entities;
    a shift once set stays, so conflicts further on do not move it. It ends when a round reaches no source, after as many
    rounds as the longest shortest chain has links. Sources that no link reaches are left out.
    """
    both = stage(offsets.select("a", "b", "offset", "links").union(offsets.select(F.col("b"), F.col("a"), -F.col("offset"), "links")))
    done = stage(known.select("source", F.col("shift").cast("double").alias("shift"), F.lit(0).alias("hops")))
    for n in count(1):
        step = both.join(done.select(F.col("source").alias("a"), "shift"), "a").join(done.select(F.col("source").alias("b")), "b", "left_anti")
        new = step.groupBy("b").agg(F.max_by(F.col("shift") - F.col("offset"), F.struct("links", "a")).alias("shift"))
        grown = stage(done.union(new.select(F.col("b").alias("source"), "shift", F.lit(n))))
        more = grown.where(F.col("hops") == n).limit(1).count()
        drop_staged(done)
        done = grown
        if not more:
            return done


def calibrate(rows: DataFrame, entity: str, source: str, log_value: str, known: DataFrame, least: int = 5) -> DataFrame:
    """rows with `common`, their log value on the scale of the known sources; null where no chain of shared entities leads there."""
    shifts = propagate(snapped(pairwise_offsets(rows, entity, source, log_value, least)), known)
    return lookup_join(rows, shifts.select(F.col("source").alias(source), "shift"), [source], "left", row_size=96).withColumn("common", F.col(log_value) + F.col("shift")).drop("shift")
