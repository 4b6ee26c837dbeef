"""Traces: one text a capture that holds what generates its tables, and the tables back from it.

A line "DYAD STATS v3 frames=N" is followed by a line of 13 numbers a frame: the filtered colour's mean and covariance, the
ground law's lightness, intercept and slope, and 1 for the prior law. "DYAD GROUNDHUE v2 frames=N" is followed by the law's
rotation and 1 for the fitted law. Version 2 of the numbers stands for tables of shells; version 1 has nine numbers and the
prior law. Other lines are notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import mixtures, pairtree, solve
from voxlake.operators.lineage import spread
from voxlake.operators.pairtree import COVARIANCE, LAB

NUMBERS = (*LAB, *COVARIANCE, "delta_l", "alpha", "beta")


def _line(*values: Column) -> Column:
    return F.concat_ws(" ", *[v.cast("string") for v in values])


def write(solved: solve.Solve, notes: dict[str, Column] | None = None) -> DataFrame:
    """(capture, trace) of a solve. notes: further lines by their names, of columns of solved.captures."""
    flag = lambda c: F.when(c, "1").otherwise("0")
    rows = solved.frames.select("capture", "t", "gain", _line(*[F.col(c) for c in NUMBERS], flag(~F.col("fitted"))).alias("stats"), _line(F.col("rot_a"), F.col("rot_b"), flag(F.col("fitted"))).alias("hue"))
    lists = rows.groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("t", "stats", "hue"))).alias("f"), F.first("gain").alias("gain"))
    n = F.size("f").cast("string")
    number = lambda c: F.format_string("%.6g", c)
    mix = F.concat(F.lit("DYAD MIXTURE phases="), F.when(F.col("two_phase"), "2").otherwise("1"), *[x for k, c in (("muF", "mf"), ("muB", "mb"), ("piB", "pb"), ("sigma", "sd")) for x in (F.lit(f" {k}="), number(F.col(f"fit.{c}")))],
                   F.lit(" sStar="), number(mixtures.crossover()), F.lit(" tau="), number(mixtures.temperature()), F.lit(" alpha="), number(F.col("gain")))
    more = [F.concat(F.lit(f"{k} "), v) for k, v in (notes or {}).items()]
    stats, hues = F.array_join(F.col("f.stats"), "\n"), F.array_join(F.col("f.hue"), "\n")
    text = F.concat_ws("\n", mix, *more, F.concat(F.lit("DYAD STATS v3 frames="), n), stats, F.concat(F.lit("DYAD GROUNDHUE v2 frames="), n), hues)
    return lists.join(solved.captures, "capture").select("capture", text.alias("trace"))


def parse(traces: DataFrame) -> DataFrame:
    """(capture, i, version, numbers, hue) of traces(capture, trace), a row a frame: numbers as doubles, hue the rotation and
    the fitted flag where the trace has them.

    The numbers' lines end with the first that has another count of words. A trace without such a header or line, or with a
    word that is no number among them, gives no row.
    """
    lines = traces.select("capture", F.posexplode(F.split("trace", "\n")).alias("k", "line")).withColumn("words", F.filter(F.split("line", " "), lambda w: w != ""))
    own = Window.partitionBy("capture")
    after = own.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)

    def section(header: str, fits: Column) -> DataFrame:
        """Lines below the first header, up to the first that does not fit; i from 0."""
        at = F.min(F.when(F.col("line").rlike(header), F.struct("k", F.regexp_extract("line", header, 1).cast("int").alias("version"))))
        below = lines.withColumn("at", at.over(own)).where("k > at.k").withColumn("version", F.col("at.version")).withColumn("fits", fits)
        kept = below.withColumn("good", F.coalesce(F.min(F.col("fits").cast("int")).over(after), F.lit(1))).where("good = 1 and fits")
        return kept.withColumn("i", (F.col("k") - F.col("at.k") - 1).cast("int"))

    want = F.when(F.col("version") == 1, 9).otherwise(13)
    stats = section("^DYAD STATS v([123])", F.size("words") == want).select("capture", "i", "version", F.transform("words", lambda w: w.try_cast("double")).alias("numbers"))
    broken = stats.where(F.exists("numbers", lambda v: v.isNull())).select("capture").distinct()
    two = F.col("words")[0].try_cast("double").isNotNull() & F.get("words", F.lit(1)).try_cast("double").isNotNull()
    hues = section("^DYAD GROUNDHUE v([12])", F.size("words").isin(2, 3) & two)
    hue = hues.select("capture", "i", F.struct(F.col("words")[0].cast("double").alias("a"), F.col("words")[1].cast("double").alias("b"), (F.coalesce(F.get("words", F.lit(2)), F.lit("")) == "1").alias("fitted")).alias("hue"))
    return stats.join(broken, "capture", "left_anti").join(hue, ["capture", "i"], "left")


def tables(parsed: DataFrame) -> DataFrame:
    """(capture, i, idx, r8, g8, b8): the 256 colours of every parsed frame."""
    number = lambda k: F.get("numbers", F.lit(k))
    key = F.struct("capture", "i").alias("t")
    old = F.col("version") == 1
    # A law that is neither capped nor fitted maps log chroma without a bound, which a cap at infinity is.
    laws = {
        "fitted": ~old & F.coalesce(F.col("hue.fitted"), F.lit(False)), "capped": old | (number(12) != 0), "delta_l": number(9), "alpha": F.when(old, solve.PRIOR["alpha"]).otherwise(number(10)),
        "beta": F.when(old, solve.PRIOR["beta"]).otherwise(number(11)), "rot_a": F.when(old, 1.0).otherwise(F.coalesce("hue.a", F.lit(1.0))), "rot_b": F.when(old, 0.0).otherwise(F.coalesce("hue.b", F.lit(0.0))),
    }
    # A line is short, so that few tasks would take all frames, but their trees cost much.
    frames = spread(parsed, "capture", "i").select(key, "version", *[number(k).alias(c) for k, c in enumerate((*LAB, *COVARIANCE))], *[laws[c].alias(c) for c in solve.LAW])
    # A row of a frame carries its law to its leaves, so that no leaf is joined.
    by = ["t", *solve.LAW]
    trees = pairtree.figures(frames.where("version = 3").withColumn("axes", pairtree.axes()).withColumn("steps", pairtree.generations()), by)
    points = pairtree.displayed(pairtree.shells(frames.where("version < 3").withColumn("axes", pairtree.axes()), [*by, "version"]))
    start = F.element_at(F.array(*[F.lit(sum(pairtree.LADDER[:k])) for k in range(len(pairtree.LADDER))]), F.col("level") + 1)
    leaf = (start + F.col("j")).alias("leaf")
    first = points.where("version = 1 and level = 0").select("t", F.col("ll").alias("light"))
    shown = points.join(first, "t", "left").withColumn("delta_l", F.coalesce(solve.PRIOR["light"] - F.col("light"), "delta_l"))
    leaves = trees.unionByName(shown.select(*by, leaf, *LAB, "r8", "g8", "b8"))
    return solve.table(leaves).select("t.capture", "t.i", "idx", "r8", "g8", "b8")
