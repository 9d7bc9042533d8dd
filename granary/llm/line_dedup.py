"""Repeated passages of lines, found by winnowing over line hashes.

Every line of a document has a hash. Windows of 50 words or more start at each
line and end at each line; of each window the line with the least hash (the
last one, if several) is selected. Its hash is the fingerprint and stands for
all windows that select it, so there are far fewer places than windows. A
window's selection follows from its lines alone: whatever passage of 50 words
or more, in whole lines, two places share, they share a selected line of.

Fingerprints that occur at more than one place join positions: only the windows
around such places are verified, line by line, by the hash of all their lines.
Verified windows that overlap extend a match both ways: each line of a
repeated run lies in a window inside the run that starts or ends in it, and
so each such window has an earlier place just if the run has. Runs that have an
earlier place are deleted. A line that occurs everywhere costs no pairs of
its places: each window is compared with the first place of its lines.

All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common

#: Words of a window: passages of as many words or more are found.
WORDS = 50
KEY = ["d", "th"]


def _line(x):
    x = F.trim(x)
    words = F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    return F.struct(F.xxhash64(x).alias("h"), words.alias("w"))


def line_rows(df: DataFrame) -> DataFrame:
    """One row for each line with words of each distinct (doc_id, text) of df: d, th, line, h, w, at, before.

    line counts all lines from 0, at those with words, before the words ahead of the line. d is doc_id and th a hash
    of the text, which tells rows with the same doc_id apart.
    """
    rows = df.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("th"), F.transform(F.split("text", "\n"), _line).alias("lines"))
    rows = rows.groupBy(*KEY).agg(F.first("lines").alias("lines"))
    each = rows.select(*KEY, F.posexplode("lines").alias("line", "x")).select(*KEY, "line", "x.*").where("w > 0")
    order = Window.partitionBy(*KEY).orderBy("line")
    words = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return each.select("*", (F.row_number().over(order) - 1).alias("at"), (words - F.col("w")).alias("before"))


def windows(lines: DataFrame, words: int = WORDS) -> DataFrame:
    """d, th, from, to (lines), first, last (the same, by at), h and place: windows, and the hash and the line (by at) that each selects.

    Windows are such that any two lines next to each other in a run of that many words are in one of the run's windows:
    those that start at a line, those that end at a line, and lines that have the words alone with their next one.
    """
    own = Window.partitionBy(*KEY)
    starting = own.orderBy("before").rangeBetween(0, words - 1)
    ending = own.orderBy("after").rangeBetween(-(words - 1), 0)
    following = own.orderBy("before").rowsBetween(0, 1)

    def window(frame, fits):
        ends = [f(c).over(frame).alias(n) for f, c, n in ((F.min, "line", "from"), (F.max, "line", "to"), (F.min, "at", "first"), (F.max, "at", "last"))]
        return F.struct(*ends, F.min(F.struct("h", (-F.col("at")).alias("back"))).over(frame).alias("least"), fits.alias("fits"))

    # An ending window that would be short without its last line is a starting one too.
    found = lines.withColumn("after", F.col("before") + F.col("w")).select(
        *KEY,
        window(starting, F.sum("w").over(starting) >= words).alias("a"),
        window(ending, F.sum("w").over(ending) - F.col("w") >= words).alias("b"),
        window(following, (F.col("w") >= words) & (F.count("w").over(following) == 2)).alias("c"),
    )
    each = found.select(*KEY, F.explode(F.filter(F.array("a", "b", "c"), lambda x: x["fits"])).alias("x"))
    return each.select(*KEY, "x.from", "x.to", "x.first", "x.last", F.col("x.least.h").alias("h"), (-F.col("x.least.back")).alias("place"))


def selected(found: DataFrame) -> DataFrame:
    """One row for each place that a window selects: d, th, place and its fingerprint h."""
    return found.select(*KEY, "place", "h").distinct()


def _verifiable(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Windows (d, th, from, to) with the hashes k1 and k2 of all their lines."""
    wanted = found.groupBy(*KEY).agg(F.collect_set(F.struct("from", "to", "first", "last")).alias("xs"))
    whole = lines.groupBy(F.col("d").alias("d2"), F.col("th").alias("th2")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("all"))
    both = wanted.join(whole, common.same(F.col("d"), F.col("d2")) & (F.col("th") == F.col("th2")))

    def hashed(x, hs):
        part = F.slice(hs, x["first"] + 1, x["last"] - x["first"] + 1)
        return F.struct(x["from"].alias("from"), x["to"].alias("to"), F.xxhash64(part).alias("k1"), F.xxhash64(F.lit(1), part).alias("k2"))

    return both.select(*KEY, F.explode(common.let(F.col("all.h"), lambda hs: F.transform("xs", lambda x: hashed(x, hs)))).alias("x")).select(*KEY, "x.*")


def repeated_runs(df: DataFrame, words: int = WORDS) -> DataFrame:
    """d, th and runs: an array of (from, to), the lines of passages of each (doc_id, text) of df that stand at an earlier place too.

    df has doc_id and text (not null). Lines count from 0, `to` is inside; runs don't overlap.
    """
    lines = common.materialize(line_rows(df), "lines")
    found = common.materialize(windows(lines, words), "windows")
    shared = selected(found).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    candidates = common.materialize(_verifiable(found.join(shared, "h", "left_semi"), lines), "candidates")
    place = F.struct(*KEY, "from")
    # Written, so that the join has a shuffle of its own, whose large partitions adaptive execution can split.
    first = common.materialize(candidates.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first", narrow=True)
    later = candidates.join(first, ["k1", "k2"]).where(place != F.col("first"))
    # Windows that overlap become one run.
    order = Window.partitionBy(*KEY).orderBy("from", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.select(*KEY, "from", "to").withColumn("new", F.when(F.col("from") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*KEY, "island").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def line_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, added: bool = False) -> DataFrame:
    """df without the later copies of repeated passages in its texts; with n_lines and n_deleted if `added`.

    A passage is a run of whole lines, compared without spaces at their ends
    and with lines without words left out, of `words` words or more. It
    repeats if the same lines stand at an earlier place: in a row with a
    smaller doc_id, in one with the same doc_id and another text, or further up. The
    earliest place stays. Runs that overlap their own copy lose all but what
    comes first. Null texts stay null, and a text whose lines all go becomes
    empty. Rows that repeat both doc_id and text count once and are cut alike. A
    null doc_id comes before any other; doc_ids may be of any type that has an order. Very
    long texts are one row of line hashes in memory. Rows and other columns all
    stay, but columns named n_lines or n_deleted are replaced if `added`; an empty table gives an empty one.
    """
    common.prepare(df.sparkSession)
    if added:
        df = df.drop("n_lines", "n_deleted")
    rows = df.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    runs = common.materialize(repeated_runs(rows, words).toDF("d", "th", "runs"), "runs")
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(text)
    inner = df.toDF(*names)
    t, key = F.col(names[at]), F.col(names[df.columns.index(doc_id)])
    joined = inner.join(common.checked_broadcast(runs), common.same(key, F.col("d")) & (F.xxhash64(t) == F.col("th")) & t.isNotNull(), "left")
    split = F.split(t, "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["from"], r["to"])))

    def cut(parts):
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    new = F.when(F.col("runs").isNull(), t).otherwise(common.let(split, cut))
    deleted = F.when(F.col("runs").isNull(), 0).otherwise(F.aggregate("runs", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1))
    out = joined.select(
        *[(new if i == at else F.col(n)).alias(n) for i, n in enumerate(names)],
        *([F.when(t.isNull(), 0).otherwise(F.size(split)).alias("n_lines"), F.when(t.isNull(), 0).otherwise(deleted).alias("n_deleted")] if added else []),
    )
    return out.toDF(*df.columns, *(["n_lines", "n_deleted"] if added else []))
