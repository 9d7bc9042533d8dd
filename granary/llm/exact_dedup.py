"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed size. Distinct blocks are sorted and
numbered: a block's number is its name. Adjacent names are paired, distinct
pairs numbered the same way, and so on until each document has one name.
Equal names (of documents with as many blocks) mean equal texts: names are
given to contents, not to hashes. A hash only carries a name back to where
its block stands, after it is proved that no two blocks share the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common

#: Characters of a block, and of its begin that tells its range in sorted order.
BLOCK, BEGIN = 4096, 64


def _numbered(distinct: DataFrame, by: list[str], label: str) -> DataFrame:
    """Distinct rows in sorted order of `by`, numbered from 0 without gaps, as a table: the same names for any layout.

    Partitions are ranges; a row's number is its place in its partition and the rows of the ranges before.
    """
    # Ranges of contents are cut by how they begin: their bounds are sampled to the driver, where whole blocks would be too much.
    ranges = [F.substring(c, 1, BEGIN) if c == "content" else F.col(c) for c in by]
    rows = distinct.repartitionByRange(*ranges).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = common.materialize(rows.select([c for c in rows.columns if c != "content"]), label)
    # The upper bits of `at` number the partition. One row for each range goes through one task.
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("ahead"))
    numbered = placed.withColumn("part", part).join(F.broadcast(ahead), "part")
    return numbered.withColumn("name", F.col("at") - F.shiftleft(F.col("part"), 33) + F.col("ahead")).drop("at", "part", "ahead")


def _name_blocks(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Names by hash pair, and the seed of hashes that tell all blocks apart."""
    for seed in range(8):
        hashed = blocks.select("content", *_hashes(seed)).distinct()
        names = _numbered(hashed, ["content"], "blocks")
        if names.count() == names.select("h1", "h2").distinct().count():
            return names, seed
    raise RuntimeError("no hash tells all blocks apart")


def _hashes(seed: int):
    return F.xxhash64(F.lit(2 * seed), "content").alias("h1"), F.xxhash64(F.lit(2 * seed + 1), "content").alias("h2")


def text_names(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct (doc_id, text) of df: doc_id, sha, n_blocks, name and copies.

    Texts must not be null. Two rows have equal texts just if they have equal
    n_blocks and name. copies: how many rows there were.
    """
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    parts = F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)
    names, seed = _name_blocks(df.select(F.explode(parts).alias("content")))
    where = (
        df.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), parts.alias("parts"))
        .select("doc_id", "sha", F.size("parts").alias("n_blocks"), F.posexplode("parts").alias("at", "content"))
        .select("doc_id", "sha", "n_blocks", "at", *_hashes(seed))
        .groupBy("doc_id", "sha", "n_blocks", "at", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    key = ["doc_id", "sha", "n_blocks", "copies"]
    level = common.materialize(where.join(names, ["h1", "h2"]).select(*key, "at", "name"), "level")
    most = level.agg(F.max("n_blocks")).first()[0] or 1
    done, width = [level.where("n_blocks = 1").select(*key, "name")], 1
    while width < most:
        width *= 2
        pairs = (
            level.where(F.col("n_blocks") > width // 2)
            .groupBy(*key, F.expr("at div 2").alias("at"))
            .agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        )
        pairs = common.materialize(pairs, "pairs")
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], "names")
        level = common.materialize(pairs.join(names, ["a", "b"]).select(*key, "at", "name"), "level")
        done.append(level.where(F.col("n_blocks") <= width).select(*key, "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(df: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest doc_id stays. Rows that
    repeat both doc_id and text count in group_size, and one of them stays. A null
    doc_id is less than any other; if a group has no other, keep_id is
    null. An empty table gives an empty one. Other columns aren't read.
    """
    common.prepare(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("doc_id"), common.lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    names = text_names(rows, block)
    groups = names.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = common.materialize(groups, "groups")
    return (
        names.join(groups, ["n_blocks", "name"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
