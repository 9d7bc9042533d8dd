"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams that every match must
contain (`trigram_query`). One pass over the texts writes postings for the
trigrams of all queries: for each trigram and block of documents, the sorted
ids of the documents that have it. Queries are answered on postings alone, by
intersection and union within a block. Only candidates are verified with the
regex; rules without a mandatory trigram are verified on all documents.

All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm import common

#: Ids of a posting list at most.
POSTINGS = 4096
#: Matches of a text whose places are added up at once.
BLOCK = 256
#: Alternatives of an exact set of strings before it turns into a query.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches fail whose group is shorter than `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # The greedy run and its least length in one: a run that is too short holds no match that isn't.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further rules of this scan.
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
KINDS = tuple(r.kind for r in (*BASE, *FURTHER))

#: A query is True (all documents), a trigram, or ("and" | "or", queries).
Query = object


def _all(kind: str, parts) -> Query:
    """parts joined by and, or by or, with True taken as what it means."""
    parts = list(dict.fromkeys(parts))
    if kind == "or" and True in parts:
        return True
    if kind == "or":  # what asks for more than another alternative adds nothing
        sets = [trigrams(p) if p is not True and (isinstance(p, str) or all(isinstance(x, str) for x in p[1]) and p[0] == "and") else None for p in parts]
        parts = [p for p, own in zip(parts, sets, strict=True) if own is None or not any(other is not None and other < own for other in sets)]
    parts = [p for p in parts if p is not True]
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings) -> Query:
    """What texts must contain that contain one of the strings."""
    return _all("or", [_all("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node) -> set[str] | None:
    """All strings that a part of a regex matches, in lower case, or None if there are too many to list."""
    op, value = node
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "SUBPATTERN":
        return _exact(value[-1])
    if name == "BRANCH":
        sets = [_exact(x) for x in value[1]]
        found = None if None in sets else set().union(*sets)
        return found if found is None or len(found) <= EXACT else None
    if name == "MAX_REPEAT" and value[1] <= 4:
        one = _exact(value[2])
        if one is None:
            return None
        found = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(one, repeat=n)}
        return found if len(found) <= EXACT else None
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 4:
        return {chr(v).lower() for _, v in value}
    return None


def _exact(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        own = _strings(node)
        if own is None or len(found) * len(own) > EXACT:
            return None
        found = {a + b for a in found for b in own}
    return found


def _needs(nodes) -> Query:
    """The query of a sequence: of runs of listable parts, and of what stands between them."""
    queries, run = [], {""}
    for node in nodes:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= EXACT:
            run = {a + b for a in run for b in own}
            continue
        queries.append(_of_strings(run))
        run = own if own is not None else {""}
        op, value = node
        if own is None and str(op) == "SUBPATTERN":
            queries.append(_needs(value[-1]))
        elif own is None and str(op) == "BRANCH":
            queries.append(_all("or", [_needs(x) for x in value[1]]))
        elif own is None and str(op) == "MAX_REPEAT" and value[0]:
            queries.append(_needs(value[2]))
    queries.append(_of_strings(run))
    return _all("and", queries)


def trigram_query(regex: str) -> Query:
    """Trigrams (in lower case) that every text with a match has; True if none is mandatory."""
    return _needs(regex_parser.parse(regex))


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(df: DataFrame, wanted: list[str]) -> DataFrame:
    """(block, trigram, rows): sorted row numbers of the texts of df that have a trigram, upper case counting as lower.

    df has row (long) and text. A list has the rows of one block of 4096 numbers.
    """
    low = F.lower("text")
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    return (
        df.select("row", F.explode(found).alias("trigram"))
        .groupBy(F.expr(f"row div {POSTINGS}").alias("block"), "trigram")
        .agg(F.sort_array(F.collect_set("row")).alias("rows"))
    )


def _answer(query: Query, lists: Column) -> Column:
    """Rows of a block that a query holds for, from a map of trigram to rows."""
    if isinstance(query, str):
        return F.coalesce(lists[F.lit(query)], F.array().cast("array<bigint>"))
    kind, parts = query
    return reduce(F.array_intersect if kind == "and" else F.array_union, [_answer(p, lists) for p in parts])


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row, kinds): for each row that a query holds for, the names of those queries."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("lists"))
    each = F.array(*[F.struct(F.lit(k).alias("kind"), _answer(q, F.col("lists")).alias("rows")) for k, q in queries.items()])
    return (
        lists.select(F.explode(each).alias("found"))
        .select("found.kind", F.explode("found.rows").alias("row"))
        .groupBy("row")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def spans(rule: Rule, text: str = "text") -> Column:
    """Array of (start, end, kind) of a rule's matches, leftmost and not overlapping, failing ones left out.

    The text between matches and the matches themselves take turns; their
    lengths, in code points, add up to where each match stands. They are
    added up by blocks, so that no list of all matches so far is copied for each match.
    """
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    checked = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.least else whole
    kind = F.lit(KINDS.index(rule.kind))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    numbers = F.array().cast("array<int>")

    def sized(m):
        return F.struct(F.coalesce(F.length(m["gap"]), F.lit(0)).alias("gap"), F.length(m["whole"]).alias("size"), F.length(m["part"]).alias("part"))

    def ahead(totals):
        """For each number the sum of those before it."""
        start = F.struct(F.lit(0).alias("at"), numbers.alias("all"))
        return F.aggregate(totals, start, lambda done, t: F.struct((done["at"] + t).alias("at"), F.concat(done["all"], F.array(done["at"])).alias("all")), lambda done: done["all"])

    def step(done, m):
        begin = done["at"] + m["gap"]
        end = begin + m["size"]
        own = F.array(F.struct(begin.alias("start"), end.alias("end"), kind.alias("kind")))
        return F.struct(end.alias("at"), F.when(m["part"] >= rule.least, F.concat(done["found"], own)).otherwise(done["found"]).alias("found"))

    def placed(ms):
        def block(b):
            return F.slice(ms, b * BLOCK + 1, F.lit(BLOCK))

        blocks = F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda n, m: n + m["gap"] + m["size"]))
        return F.flatten(F.transform(ahead(totals), lambda at, b: F.aggregate(block(b), F.struct(at.alias("at"), empty.alias("found")), step, lambda done: done["found"])))

    # The last gap follows the last match; the pad keeps the three lists as long as each other.
    zipped = common.let(whole, lambda w: F.when(F.size(w) == 0, F.lit(None)).otherwise(F.arrays_zip(w.alias("whole"), F.split(text, rule.regex, -1).alias("gap"), (checked if rule.least else w).alias("part"))))
    matches = F.transform(F.filter(zipped, lambda m: m["whole"].isNotNull()), sized)
    return F.coalesce(common.let(matches, lambda ms: F.when(F.size(ms) > 0, placed(ms))), empty)


def scan_secrets(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = (*BASE, *FURTHER)) -> DataFrame:
    """One row for each row of df: doc_id and found, an array of (start, end, kind) sorted by start, then kind.

    kind is an index into KINDS; start and end count code points, the end is
    outside. Null and empty texts have no matches. Rows that repeat a
    doc_id are scanned each; rows whose doc_id is null too. A doc_id may be of
    any type. Time is in proportion to a text's length and matches, which all are in memory at once. An
    empty table gives an empty one. Other columns aren't read.
    """
    common.prepare(df.sparkSession)
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Two rows may share a number: a candidate is verified in any case.
    whole = isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    rows = rows.withColumn("row", F.coalesce(F.col("doc_id").cast("long") if whole else F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.lit(0)))
    wanted = sorted(set().union(*map(trigrams, indexed.values())))
    if wanted:
        index = postings(rows, wanted)
        found = common.materialize(candidates(index, indexed), "candidates")
        rows = rows.join(common.checked_broadcast(found), "row", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    each = [F.when(F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind), spans(r)).otherwise(none) if r.kind in indexed else spans(r) for r in rules]
    order = F.array_sort(F.transform(F.concat(*each), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select("doc_id", order.alias("found"))


def listed(found: Column) -> Column:
    """Matches as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
