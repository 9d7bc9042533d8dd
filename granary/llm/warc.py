"""WARC records of pages, and a Merkle fixity audit of replicas.

A replica's tree has a leaf for each record: the hash of its place in the
file and of its bytes. A node hashes its children, up to 16 in order of
offset, and so stands for a range of offsets; the root of a file stands for
all of it. An audit compares roots and goes down only where nodes differ.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm import common

#: Records of a file, by page number; and children of a node.
RECORDS, CHILDREN = 1000, 16
#: Files that pages without a number are dealt out to.
STRAY = 1024
#: When records were made, as they say: pages don't know, and equal pages are to give equal records.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(name: Column, url: Column, body: Column) -> Column:
    """A WARC/1.0 resource record, as text. name: what its record id is made of. Null url or body: empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    uuid = F.regexp_replace(F.md5(name.cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def parsed(content: bytes):
    """Records of a WARC file: offset, length, headers (names in lower case) and body of each. The last offset is where it isn't one any more."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            break
        lines = content[at:end].split(b"\r\n")[1:]
        headers = {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
        size = headers.get("content-length", "")
        stop = end + 4 + int(size) if size.isdigit() else len(content) + 1
        if not content.startswith(b"\r\n\r\n", stop):
            break
        yield at, stop + 4 - at, headers, content[end + 4 : stop]
        at = stop + 4


def read_records(files: DataFrame) -> DataFrame:
    """file, offset, length, type, id, uri, date, headers and body of the records of WARC files (path, content: not compressed).

    Headers that are missing are null. A file that ends or breaks inside a record gives the records before.
    A file is in one task's memory whole, as Spark reads binary files. Null contents and empty tables give no rows.
    """
    common.prepare(files.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                path = batch.column(0)[i].as_py()
                for offset, length, h, body in parsed(content or b""):
                    own = [[path], [offset], [length], *([h.get(n)] for n in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date")), [list(h.items())], [body]]
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.map_(pa.string(), pa.string()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(own, kinds, strict=True)], names=[f"c{j}" for j in range(9)])

    schema = "file string, offset long, length long, type string, id string, uri string, date string, headers map<string,string>, body binary"
    return common.map_arrow(files.select("path", "content"), run, schema, keep=False)


def leaves(records: DataFrame) -> DataFrame:
    """file, seq, offset, length, sha and hash of records (file, id, record), in order of id within a file.

    Records that share file and id stand in order of their hash. seq and
    offset start at 0. Only hashes and lengths are shuffled, not records.
    """
    own = Window.partitionBy("file").orderBy(F.col("id").asc_nulls_first(), "sha")
    sized = records.select("file", "id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"))
    placed = sized.select(
        "file", "id", (F.row_number().over(own) - 1).cast("long").alias("seq"),
        (F.sum("length").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "sha",
    )
    return placed.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "sha"), 256))


def tree(leaf: DataFrame) -> DataFrame:
    """All nodes above the leaves: file, level (1: parents of leaves), node, begin, end and hash.

    The root is a file's only node of the highest level; all files have as many levels.
    """
    most = leaf.agg(F.max("seq")).first()[0]
    level, width, out = 0, (most or 0) + 1, None
    below = leaf.select("file", F.col("seq").alias("node"), F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end"), "hash")
    while out is None or width > 1:
        level, width = level + 1, -(-width // CHILDREN)
        below = (
            below.groupBy("file", F.expr(f"node div {CHILDREN}").alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("k"), "begin", "end", "hash"))).alias("x"))
            .select("file", "node", F.array_min("x.begin").alias("begin"), F.array_max("x.end").alias("end"), F.sha2(F.array_join("x.hash", ","), 256).alias("hash"))
        )
        # Each level is computed once: the one above and the union both read it.
        below = common.materialize(below, "nodes")
        own = below.select("file", F.lit(level).alias("level"), "node", "begin", "end", "hash")
        out = own if out is None else out.unionByName(own)
    return out


def _differing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose hash is missing on one side or not the same."""
    both = a.select(*key, F.col("hash").alias("a")).join(b.select(*key, F.col("hash").alias("b")), key, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(*key)


def audit(leaf_a: DataFrame, leaf_b: DataFrame) -> DataFrame:
    """file and seq of the records at which two replicas differ, one missing on one side included.

    Goes down from the roots: a level's nodes are compared only below nodes
    that differ. A differing length moves all that follow it in its file,
    which then differ too. Equal replicas, and empty ones, give no rows.
    """
    a, b = tree(leaf_a), tree(leaf_b)
    top = max(x.agg(F.max("level")).first()[0] or 1 for x in (a, b))
    at = None
    for level in range(top, -1, -1):
        if level:
            own = [x.where(F.col("level") == level).select("file", "node", "hash") for x in (a, b)]
        else:
            own = [x.select("file", F.col("seq").alias("node"), "hash") for x in (leaf_a, leaf_b)]
        if at is not None:
            above = at.select("file", F.col("node").alias("above"))
            own = [x.withColumn("above", F.expr(f"node div {CHILDREN}")).join(above, ["file", "above"], "left_semi").drop("above") for x in own]
        at = common.materialize(_differing(*own, ["file", "node"]), "differing")
    return at.withColumnRenamed("node", "seq")


def page_records(pages: DataFrame, change: Column | None = None) -> DataFrame:
    """file, id and record of pages (page_id, url, html). Pages with a null page_id go to files below 0, by url.

    change: a new body for the rows where it isn't null (to plant damage).
    """
    body = F.col("html") if change is None else F.coalesce(change, "html")
    file = F.coalesce(F.expr(f"page_id div {RECORDS}"), -1 - F.pmod(F.xxhash64("url"), F.lit(STRAY)))
    name = F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return pages.select(file.alias("file"), F.col("page_id").alias("id"), record_bytes(name, F.col("url"), body).alias("record"))


def fixity_audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each record of the original: id, file, seq, offset, length, sha and corrupt.

    Both have file, id and record. corrupt tells where the replica differs.
    Repeated records have a row each; an empty original gives an empty table. Other columns aren't read. Bodies may be long:
    they are hashed where they lie. Offsets of one file are added up in one task, whose rows have hashes alone.
    """
    common.prepare(original.sparkSession)
    a, b = common.materialize(leaves(original), "leaves"), common.materialize(leaves(replica), "leaves")
    found = audit(a, b).withColumn("corrupt", F.lit(True))
    return a.join(found, ["file", "seq"], "left").select("id", "file", "seq", "offset", "length", "sha", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
