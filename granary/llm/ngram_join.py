"""Jaccard join of documents on word shingles, as a blocked sparse product.

The matrix has a row for each distinct shingle set and a column for each
shingle; its product with its transpose counts overlaps. Two sets link
when 9 * overlap >= 4 * (n_a + n_b), that is at a similarity of 0.8. Size
gives most of the bounds that keep the product small:

* of a set of n, in a fixed order of shingles, the first n - ceil(0.8 n) + 1
  columns suffice: sets that link share one of them. Blocks of columns are
  the partitions of these entries by shingle;
* an overlap counted over those columns bounds the whole one: of two sets,
  the one whose entries end first can gain n - p beyond its p entries. Pairs
  below the bound are discarded, the others counted over all columns.

Columns with over 20 entries are left out of the product, and the rows that had
one are taken through again with those columns last in the order: what they
share besides is found by other columns. In the last pass, which few rows
reach, the order is by the exact number of entries. Columns that are still long
are worked off by components: each entry is counted against one central row;
of the rest only pairs of different components are, and only if sizes and
the entries that are left from this column on allow a link.

Sets are made of 63-bit hashes of shingles, and rows with the same 128-bit hash
of their set count as one set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

#: Words of a shingle.
WORDS = 5
#: Entries of a column that is multiplied out; passes over the rows that have longer ones.
ENTRIES, PASSES = 20, 3
#: Long columns known to all tasks: the longest ones, 512 KB. Which they are changes the order, not the links.
LONG = 1 << 16
#: Ratio of the sizes of a band: a little more than that of two sets that link at most.
BAND = 1.26
#: Texts that are split at once, and rows of token sets in a batch.
TEXTS, SETS = 250, 200
#: Rows of entries in a batch.
ROWS = 30_000
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(z: np.ndarray, more: np.ndarray) -> np.ndarray:
    z = z * MIX_A + more
    z ^= z >> np.uint64(29)
    z *= MIX_B
    z ^= z >> np.uint64(32)
    return z


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its set of shingle hashes (63 bits, sorted)."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    real = np.fromiter(map(bool, words), bool, len(words))
    index = coded.indices.to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    keep = real[index] if len(words) else np.zeros(0, bool)
    hashes = own[index][keep] if len(words) else np.zeros(0, np.uint64)
    ends = np.append(0, np.cumsum(keep))[ends]
    z = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        z = _mix(z, hashes[k : k + len(z)])
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(z[a : b - WORDS + 1] >> np.uint64(1)))
        elif b > a:
            few = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                few = _mix(few, h)
            out.append(few >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def taken(n):
    """Entries of a set of n that the product needs."""
    return n - -(-4 * n // 5) + 1


def _ordered(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, int]:
    """The entries of a set that the product needs, and the order of the last one. Long columns come last."""
    n = len(s)
    long = np.zeros(n, bool)
    if len(last):
        at = np.minimum(np.searchsorted(last, s), len(last) - 1)
        long = last[at] == s
    first = np.concatenate([s[~long], s[long]])[: taken(n)]
    cold = n - int(long.sum()) >= len(first)
    return first, int(first[-1]) - (1 << 63 if cold else 0)


def _set_rows(df: DataFrame, last: np.ndarray | None) -> DataFrame:
    """df (doc_id, text) as doc_id, n, h1, h2, ord and x: of each set its size, key, order and entries, or all of it if last is None."""
    import xxhash

    shared = df.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        last = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                sets = shingle_sets(batch.column(1))
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                if last is None:
                    order, x = [0] * len(sets), sets
                else:
                    both = [_ordered(s, last) if len(s) else (s, 0) for s in sets]
                    order, x = [o for _, o in both], [f for f, _ in both]
                ends = np.append(0, np.cumsum([len(f) for f in x]))
                flat = np.concatenate(x) if x else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.array(order, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64))),
                ], names=[f"c{j}" for j in range(6)])

    kind = df.select("doc_id").schema[0].dataType.simpleString()
    return common.map_arrow(df.select("doc_id", "text"), run, f"doc_id {kind}, n long, h1 long, h2 long, ord long, x array<bigint>", keep=False)


def _columns(batches):
    """Works off sorted entries (token, id, n): overlaps of pairs in short columns, entries of long ones, and each row's shared entries.

    Gives kind, a, b and c: 0, a pair and its overlap; 1, a long column and a
    row in it; 2, a row and how many of its entries others have too. Of a
    column that is too long only a flag is held, so memory is bounded.
    """
    held = [np.zeros(0, np.int64)] * 3
    long_token = None

    def work(token, row, n, final):
        nonlocal long_token, held
        parts = []
        if not len(token):
            return parts
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(start, len(token)))
        if long_token is not None and token[0] != long_token:
            long_token = None
        known = long_token is not None  # the first column goes on from before, and is long
        length = np.repeat(size, size)
        if known:
            length[: size[0]] = ENTRIES + 1
        end = len(token)
        if not final:
            if known and len(start) == 1:
                end, held = len(token), [np.zeros(0, np.int64)] * 3
            elif size[-1] > ENTRIES:
                long_token, held = token[-1], [np.zeros(0, np.int64)] * 3
            else:
                end, held = start[-1], [token[start[-1] :], row[start[-1] :], n[start[-1] :]]
                long_token = None
        token, row, n, length = token[:end], row[:end], n[:end], length[:end]
        shared = length > 1
        token, row, n, length = token[shared], row[shared], n[shared], length[shared]
        if not len(token):
            return parts
        ids, often = np.unique(row, return_counts=True)
        parts.append((2, ids, np.zeros(len(ids), np.int64), often))
        long = length > ENTRIES
        if long.any():
            parts.append((1, token[long], row[long], np.ones(int(long.sum()), np.int64)))
        token, row, n = token[~long], row[~long], n[~long]
        lefts, rights = [], []
        for k in range(1, min(ENTRIES, len(token))):
            i = np.flatnonzero((token[k:] == token[:-k]) & (row[k:] != row[:-k]) & (5 * np.minimum(n[k:], n[:-k]) >= 4 * np.maximum(n[k:], n[:-k])))
            if len(i):
                lefts.append(np.minimum(row[i], row[i + k]))
                rights.append(np.maximum(row[i], row[i + k]))
        if lefts:
            pairs, often = np.unique(np.stack([np.concatenate(lefts), np.concatenate(rights)]), axis=1, return_counts=True)
            parts.append((0, pairs[0], pairs[1], often))
        return parts

    def out(parts):
        for kind, a, b, c in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a), pa.array(b), pa.array(c, pa.int64())], names=["c0", "c1", "c2", "c3"])

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        yield from out(work(*[np.concatenate([h, x]) for h, x in zip(held, new, strict=True)], False))
    yield from out(work(*held, True))


def _pass(rows: DataFrame, k: int) -> DataFrame:
    """What _columns gives for rows (id, n, x), as a table."""
    spark = rows.sparkSession
    entries = rows.select(F.explode("x").alias("token"), "id", "n")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with common.batch_rows(spark, ROWS):
        sorted_rows = entries.repartition(parts, "token").sortWithinPartitions("token")
        return common.materialize(common.map_arrow(sorted_rows, _columns, "kind int, a long, b long, c long", keep=False), f"pass{k}")


def _overlaps(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            keep.append(9 * int((y[at] == x).sum()) >= 4 * (len(x) + len(y)))
        b = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["c0", "c1"])


class _Join:
    """The sets of a table, and what is known of their links."""

    def __init__(self, df: DataFrame):
        self.docs = df
        self.spark = df.sparkSession
        self.sets = common.materialize(_set_rows(df, np.zeros(0, np.uint64)), "sets")
        full = self.sets.where("n > 0")
        #: One row for each distinct set: id, its key, its size and its smallest doc_id.
        self.rows = common.materialize(
            full.groupBy("h1", "h2").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "rows"
        )

    def again(self, ids: DataFrame, last: np.ndarray | None) -> DataFrame:
        """id, n, ord and x of the rows with these ids, from their texts."""
        wanted = common.materialize(self.rows.join(ids, "id", "left_semi"), "wanted", narrow=True)
        names = wanted.select(F.col("doc_id").alias("w")).distinct()
        small = common.checked_broadcast(common.materialize(names, "names", narrow=True))
        texts = self.docs.join(small, common.same(F.col("doc_id"), F.col("w")), "left_semi")
        found = _set_rows(texts, last).select("h1", "h2", "ord", "x")
        return found.join(wanted.select("id", "h1", "h2", "n"), ["h1", "h2"]).select("id", "n", "ord", "x").dropDuplicates(["id"])

    def rarest_first(self, ids: DataFrame) -> DataFrame:
        """id, n, ord and x of the rows with these ids; the order is by how many of these rows have a shingle."""
        with common.batch_rows(self.spark, SETS):
            whole = common.materialize(self.again(ids, None).select("id", "n", "x"), "whole")
        entries = whole.select("id", "n", F.explode("x").alias("token"))
        counts = entries.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
        sorted_sets = entries.join(counts, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("all"))
        first = sorted_sets.select("id", "n", F.slice("all", F.lit(1), (F.col("n") - F.expr("(4 * n + 4) div 5") + 1).cast("int")).alias("first"))
        shared = F.transform(F.filter("first", lambda e: e["f"] > 1), lambda e: e["token"])
        return first.select("id", "n", F.element_at("first", -1).alias("ord"), shared.alias("x"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets link, counted over all columns."""
        pairs = common.materialize(pairs, "pairs", narrow=True)
        if pairs.isEmpty():
            return pairs
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        with common.batch_rows(self.spark, SETS):
            whole = common.materialize(self.again(ids, None).select("id", "x"), "whole")
            both = pairs.join(whole.toDF("a", "x"), "a").join(whole.toDF("b", "y"), "b").select("a", "b", "x", "y")
            return common.materialize(common.map_arrow(both, _overlaps, "a long, b long", keep=False), "links")

    def candidates(self) -> tuple[list[DataFrame], DataFrame, DataFrame]:
        """Tables of pairs to count, entries (token, id, pos) of columns that stayed long, and bounds of the rows in the last pass."""
        ids = self.rows.select("h1", "h2", "id", F.col("doc_id").alias("own"))
        first = self.sets.join(ids, (self.sets.h1 == ids.h1) & (self.sets.h2 == ids.h2) & common.same(F.col("doc_id"), F.col("own")))
        rows = first.select("id", "n", "ord", "x")
        found, known = [], np.zeros(0, np.uint64)
        for k in range(PASSES):
            if k:  # else the table of sets has them
                rows = common.materialize(rows, "entries")
            made = _pass(rows, k)
            facts = rows.select("id", "n", "ord", F.size("x").alias("listed"))
            long = made.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("id"))
            hot = common.materialize(long.select("id").distinct(), "hot", narrow=True)
            shared = made.where("kind = 2").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("shared"))
            bounds = facts.join(shared, "id", "left").select("id", "n", "ord", "listed", (F.col("n") - F.expr("(4 * n + 4) div 5") + 1).alias("p"), F.coalesce("shared", F.lit(0)).alias("shared"))
            pairs = made.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"))
            pairs = self._within(pairs, bounds, hot, k + 1 < PASSES)
            found.append(common.materialize(pairs, "pairs", narrow=True))
            if k + 1 == PASSES or hot.isEmpty():
                columns = long.select("token").distinct()
                return found, rows.select("id", F.posexplode("x").alias("pos", "token")).join(columns, "token", "left_semi"), bounds
            if k + 2 < PASSES:
                columns = long.groupBy("token").count().orderBy(F.desc("count"), "token").limit(LONG).select("token").toArrow()["token"].to_numpy()
                known = np.union1d(known, columns.astype(np.uint64))
            rows = self.again(hot, known) if k + 2 < PASSES else self.rarest_first(hot)
        raise AssertionError("there is a last pass")

    def _within(self, pairs: DataFrame, bounds: DataFrame, hot: DataFrame, more: bool) -> DataFrame:
        """Pairs that size and counted entries allow to link; those of two rows that are taken through again are left to that."""
        side = bounds.join(hot.withColumn("hot", F.lit(True)), "id", "left").select("id", F.struct("n", "ord", "p", "shared", F.coalesce("hot", F.lit(False)).alias("hot")).alias("s"))
        both = pairs.join(side.toDF("a", "x"), "a").join(side.toDF("b", "y"), "b")
        low = F.when(F.col("x.ord") <= F.col("y.ord"), F.col("x")).otherwise(F.col("y"))
        need = 4 * (F.col("x.n") + F.col("y.n"))
        two = F.col("x.hot") & F.col("y.hot")
        most = low["n"] - low["p"] + F.when(two, low["shared"]).otherwise(F.col("c"))
        return both.where((9 * most >= need) & (~two if more else F.lit(True))).select("a", "b")

    def of_long_columns(self, long: DataFrame, bounds: DataFrame, edges: DataFrame) -> DataFrame:
        """Links (a, b) of rows that share a column that stayed long, up to what components need."""
        entries = common.materialize(long, "long", narrow=True)
        if entries.isEmpty():
            return edges
        central = entries.groupBy("id").agg(F.count(F.lit(1)).alias("columns"))
        hub = entries.join(central, "id").groupBy("token").agg(F.max(F.struct("columns", "id")).alias("top")).select("token", F.col("top.id").alias("hub"))
        near = entries.join(hub, "token").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        edges = edges.union(self.linked(near))
        members = common.materialize(entries.select("id").distinct(), "members", narrow=True)
        label = common.components(self.rows.select("id"), edges).join(members, "id", "left_semi")
        # The largest size that a row's partner can have if the row's entries end first and this is the first of its
        # entries that they share: then they share no more of them than are listed from here on.
        reach = bounds.select("id", "n", "ord", "p", "listed")
        far = F.expr("(9 * (n - p + listed - pos) - 4 * n) div 4")
        told = common.materialize(entries.join(reach, "id").join(label, "id").withColumn("reach", far).withColumn("can", F.col("reach") * 5 >= F.col("n") * 4), "told", narrow=True)
        often = told.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
        least = told.where("can").groupBy("token").agg(F.min("ord").alias("from"))
        facts = often.where("labels > 1").join(least, "token").select("token", F.col("top.label").alias("main"), "from")
        left = common.materialize(told.join(facts, "token").where("can or ord >= from").withColumn("other", F.col("label") != F.col("main")), "left", narrow=True)
        # Sizes that allow a link lie in the same band or in the next one.
        band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
        a = left.where("can").select("token", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda x: x + band)).alias("band"), *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "ord", "reach", "label", "other")])
        b = left.select("token", band.alias("band"), *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "ord", "label", "other")])
        fits = "ord_a <= ord_b and id_a != id_b and label_a != label_b and n_b <= reach_a and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)"
        cross = a.where("other_a").join(b, ["token", "band"]).where(fits).select("id_a", "id_b").union(a.where("not other_a").join(b.where("other_b"), ["token", "band"]).where(fits).select("id_a", "id_b"))
        return edges.union(self.linked(cross.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()))

    def components(self) -> DataFrame:
        """id and label: the smallest id that links reach."""
        found, long, bounds = self.candidates()
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.union(more)
        edges = self.linked(pairs.distinct())
        return common.components(self.rows.select("id"), self.of_long_columns(long, bounds, edges))


def ngram_join(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles and component_id.

    A text's set has its distinct shingles of five words (A-Z in lower
    case, cut at white space), or its whole sequence if it has fewer words.
    Two rows link at a Jaccard similarity of 0.8 or more. component_id is the smallest
    doc_id that links reach, the row's own included; rows of equal sets
    are in one component. Null texts, and texts without words, have no
    set and link with nothing: component_id is the row's doc_id. Null doc_ids
    don't count for component_id unless a component has no other. Repeated
    rows have a row each; an empty table gives an empty one.
    """
    common.prepare(df.sparkSession)
    join = _Join(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    labels = common.materialize(join.rows.join(join.components(), "id"), "labels", narrow=True)
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = labels.join(smallest, "label").select("h1", "h2", "component_id")
    full = join.sets.select("doc_id", F.col("n").alias("n_shingles"), "h1", "h2")
    out = full.where("n_shingles > 0").join(known, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(full.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
