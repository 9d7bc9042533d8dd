"""Byte-level BPE by DuckDB's recursive queries, inside each partition.

A partition's new words become rows of token positions. A recursive query
joins them with the merge table and contracts the leftmost pair of the least
rank in each word, until no word has a pair left; what is left, in order, are
each word's ids, and its bytes are read back from the ids. Words are kept in a
table of bounded size, so a frequent word is encoded once; those met again are
kept for the worker's next partition.

A word of n bytes makes up to n * n / 2 rows, one for each token and round. So words
are put together to queries by that figure, and a word of over 256 bytes is
encoded in pieces that overlap. Its tokens are those of the pieces, cut
over where two pieces agree. This is exact: tokens are the encoding of their
bytes if each two neighbours alone are the encoding of theirs, as the first
merge across a boundary would also be made among the two neighbours alone.
Each cut is checked so; pieces double if one has no place for a cut.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from granary.llm import common

#: Known words, and characters that they and their ids take, beyond which those that weren't met again go.
KEPT, HELD = 300_000, 10_000_000
#: Rows that a recursive query may make, over all rounds, and queries after which the database is opened anew, as its memory grows with them.
ROWS, QUERIES = 250_000, 32
#: A position takes this many bits of a merge's sort key.
POSITION_BITS = 32
#: Longer words (in bytes) are encoded in pieces of that size.
PIECE = 256
#: Below this character, letters are the same ones in all versions of Unicode that matter.
LATIN_END = "\u0250"
#: Texts looked up at once, and characters of them beyond which no other text is added.
TEXTS, CHARACTERS = 250, 2_000_000
SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Rows hold a token, the one after it (-1: none) and their place; a merge at
#: place p keeps row p + 1, drops row p and renews what row p - 1 says of the next.
RECURSION = f"""
WITH RECURSIVE step(w, pos, t, u, it) AS (
  SELECT w, pos, t, u, 0 FROM start
  UNION ALL
  SELECT s.w, CASE WHEN s.pos > b.p THEN s.pos - 1 ELSE s.pos END, CASE WHEN s.pos = b.p + 1 THEN b.m ELSE s.t END,
         CASE WHEN s.pos = b.p - 1 THEN b.m ELSE s.u END, s.it + 1
  FROM step s JOIN (
    SELECT w, CAST(min(key) & {(1 << POSITION_BITS) - 1} AS INTEGER) AS p, CAST(min(key) >> {POSITION_BITS} AS INTEGER) AS m
    FROM (SELECT s2.w, (CAST(merges.m AS BIGINT) << {POSITION_BITS}) | s2.pos AS key
          FROM step s2 JOIN merges ON s2.t = merges.a AND s2.u = merges.b) GROUP BY w
  ) b ON s.w = b.w
  WHERE s.pos <> b.p AND s.it < $rounds
), last AS (SELECT w, max(it) AS it FROM step GROUP BY w)
"""  # fmt: skip

#: Ids of each word, in their order.
ENCODE = f"""{RECURSION}
SELECT step.w, t FROM step JOIN last ON step.w = last.w AND step.it = last.it ORDER BY step.w, pos
"""

#: What a word is after so many rounds.
ADVANCE = f"""{RECURSION}
SELECT step.w, pos, t, u, step.it FROM step JOIN last ON step.w = last.w AND step.it = last.it ORDER BY step.w, pos
"""

DECODE = """
SELECT w, string_agg(bytes, '' ORDER BY pos) AS decoded FROM ids JOIN vocabulary ON t = vocabulary.id GROUP BY w ORDER BY w
"""


class Encoder:
    """A vocabulary in an in-process database, and the words met so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        #: Where two words can't be cut apart at a single space.
        self.spaces = regex.compile(r" \s|\s ")
        #: The shortcut of cutting at single spaces holds for patterns that let a word take one space in front.
        self.cut = self.pattern.findall("a bé 1 ,x\n\ny") == ["a", " bé", " ", "1", " ,", "x", "\n", "\n", "y"] or self.pattern.findall("a b\nc") == ["a", " b", "\n", "c"]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        a, b, m = (array("i") for _ in range(3))
        for word, rank in self.ranks.items():
            for i in range(1, len(word)):
                left, right = self.ranks.get(word[:i]), self.ranks.get(word[i:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    m.append(rank)
        self.tables = {"merges": pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "m": pa.array(m, pa.int32())})}
        self.tables["vocabulary"] = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [w.hex() for w in self.ranks]})
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int32)
        self.sizes[list(self.ranks.values())] = [len(w) for w in self.ranks]
        self.db, self.asked = None, 0
        self.decimal = pa.array([str(i) for i in range(len(self.sizes))])
        #: A vocabulary's bytes one after another, and where those of an id begin and how many they are.
        self.told, self.bytes, self.at, self.long = None, *(np.zeros(0, x) for x in (np.uint8, np.int64, np.int64))
        #: Words that are tokens as they are: the library doesn't merge them.
        self.whole = {text: m for w, m in self.ranks.items() if (text := w.decode("utf-8", "replace")).encode() == w}
        del self.ranks
        #: Ids (decimal, joined by commas) of what follows a space in a text, by that without the
        #: space; and of words that follow none.
        self.spaced_ids: dict[str, str] = {}
        #: Of these, what a later call met again.
        self.again: set[str] = set()
        self.held = 0
        self.plain_ids: dict[str, str] = {}
        #: Bytes decoded from the ids of a word, where they aren't the bytes of the word: else these needn't be held again.
        self.other: dict[str, bytes] = {}

    def open(self) -> None:
        """Load the tables into a database of this process."""
        import duckdb

        if self.db is None:
            self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": "", "preserve_insertion_order": False})
            for name, rows in self.tables.items():
                self.db.register("rows", rows)
                self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
                self.db.unregister("rows")
        if self.told is not (told := self.tables["vocabulary"]):
            long, of = pc.binary_length(told["bytes"]).to_numpy() // 2, told["id"].to_numpy()
            self.bytes = np.frombuffer(bytes.fromhex("".join(told["bytes"].to_pylist())), np.uint8)
            self.at, self.long = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
            self.at[of], self.long[of] = np.cumsum(long) - long, long
            self.told = told

    def shut(self) -> None:
        """Give the database's memory back."""
        if self.db is not None:
            self.db.close()
        self.db, self.asked = None, 0

    def close(self) -> None:
        """Hold no database and no words."""
        self.forget()
        self.shut()

    def rest(self) -> None:
        """A worker that waits for its next task holds no database, and of the words those that were met again."""
        self.cut_down()
        self.shut()

    def forget(self) -> None:
        """Empty the tables of known words."""
        for known in (self.spaced_ids, self.again, self.plain_ids, self.other):
            known.clear()
        self.held = 0

    def thin(self) -> None:
        """If the tables of known words are full, cut them down."""
        if len(self.spaced_ids) <= KEPT and len(self.plain_ids) <= KEPT // 4 and self.held <= HELD:
            return
        self.cut_down()

    def cut_down(self) -> None:
        """Of the known words that follow a space, keep what was met again since the last time, half of what the tables may hold at most."""
        ids, again, other = self.spaced_ids, self.again, self.other
        self.spaced_ids, self.again, self.other = {}, set(), {}
        self.forget()
        for w in again:
            if len(self.spaced_ids) >= KEPT // 2 or self.held > HELD // 2:
                break
            self.hold(" " + w, ids[w], other.get(" " + w))

    def ids_of(self, word: str) -> str:
        return self.spaced_ids[word[1:]] if word[0] == " " else self.plain_ids[word]

    def bytes_of(self, words: list[str]) -> bytes:
        """Bytes decoded from the ids of known words, one after another."""
        if self.other:
            return b"".join([self.other[w] if w in self.other else w.encode("utf-8", "surrogatepass") for w in words])
        return "".join(words).encode("utf-8", "surrogatepass")

    def hold(self, word: str, ids: str, other: bytes | None = None) -> None:
        self.held += len(word) + len(ids)
        if word[0] == " ":
            self.spaced_ids[word[1:]] = ids
        else:
            self.plain_ids[word] = ids
        if other is not None:
            self.other[word] = other
            self.held += len(word) + len(other)

    def keep(self, words: list[str], raw: list[bytes], ids: list[str], decoded: list[bytes]) -> None:
        """What hold() does, for many words."""
        self.spaced_ids.update((w[1:], i) for w, i in zip(words, ids, strict=True) if w[0] == " ")
        self.plain_ids.update((w, i) for w, i in zip(words, ids, strict=True) if w[0] != " ")
        self.held += sum(map(len, words)) + sum(map(len, ids))
        if decoded != raw:
            other = {w: d for w, r, d in zip(words, raw, decoded, strict=True) if d != r}
            self.other |= other
            self.held += sum(len(w) + len(d) for w, d in other.items())

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """Bytes of each list of ids."""
        rows = pa.table({
            "w": np.repeat(np.arange(len(ids)), [len(x) for x in ids]),
            "pos": np.concatenate([np.arange(len(x)) for x in ids] or [np.zeros(0, np.int64)]),
            "t": pa.array([i for x in ids for i in x], pa.int32()),
        })
        self.db.register("ids", rows)
        got = dict(self.db.execute(DECODE).fetchall())
        self.db.unregister("ids")
        return [bytes.fromhex(got.get(i, "")) for i in range(len(ids))]

    def read(self, got: pa.Table) -> tuple[list[str], list[bytes]]:
        """Ids (decimal, joined by commas) of each word of rows (w, t), and the bytes decoded from them."""
        w, t = got["w"].to_numpy(), got["t"].to_numpy()
        begin = np.append(np.flatnonzero(np.diff(w, prepend=-1)), len(t))
        ids = pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), self.decimal.take(pa.array(t))), ",")
        size = self.long[t]
        end = np.append(0, np.cumsum(size))
        own = self.bytes[np.repeat(self.at[t] - end[:-1], size) + np.arange(end[-1])]
        decoded = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(end[begin].astype(np.int32)), pa.py_buffer(own)])
        return ids.to_pylist(), decoded.to_pylist()

    def start(self, words: pa.Array) -> tuple[pa.Table, np.ndarray]:
        """The bytes of words (binary) as rows of tokens, and how many each word has."""
        size = np.diff(np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1])
        end = np.cumsum(size)
        t = self.byte[np.frombuffer(words.buffers()[2], np.uint8)[: end[-1]]]
        u = np.append(t[1:], -1).astype(np.int32)
        u[end - 1] = -1
        return pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": (np.arange(len(t)) - np.repeat(end - size, size)).astype(np.int32), "t": t, "u": u}), size

    def ask(self, query: str, rows: pa.Table, rounds: int) -> pa.Table:
        if self.asked >= QUERIES:
            self.shut()
            common.release()
        self.open()
        self.asked += 1
        self.db.register("start", rows)
        try:
            return self.db.sql(query, params={"rounds": rounds}).to_arrow_table()
        finally:
            self.db.unregister("start")

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words (none empty), which may be long: rounds are shared out over queries so that none makes too many rows."""
        out: list[np.ndarray] = []
        for part in _steps(words):
            rows, _ = self.start(pa.array(part, pa.binary()))
            while True:
                rounds = max(1, ROWS // len(rows))
                got = self.ask(ADVANCE, rows, rounds)
                rows = got.select(["w", "pos", "t", "u"])
                if not len(got) or pc.max(got["it"]).as_py() < rounds:
                    break
            w, t = rows["w"].to_numpy(), rows["t"].to_numpy()
            out += np.split(t, np.flatnonzero(np.diff(w)) + 1)
        return out

    def merge_long(self, word: bytes, piece: int = PIECE) -> np.ndarray:
        """Ids of a word, from pieces that overlap by half."""
        half = piece // 2
        if len(word) <= piece:
            return self.merge([word])[0]
        begin = range(0, len(word) - half, half)
        ids = self.merge([word[i : i + piece] for i in begin])
        ends = [i + np.cumsum(self.sizes[x]) for i, x in zip(begin, ids, strict=True)]
        # Places inside an overlap where a token ends in both pieces; the nearest to the middle comes first.
        places = []
        for k in range(1, len(ids)):
            both = np.intersect1d(ends[k - 1], ends[k])
            both = both[(both > begin[k]) & (both < min(begin[k] + half, len(word)))]
            places.append(both[np.argsort(np.abs(both - begin[k] - half // 2), kind="stable")])
        cuts, open_cuts = [-1] * len(places), list(range(len(places)))
        for turn in range(max(map(len, places))):
            wanted = {}
            for k in open_cuts:
                if turn < len(places[k]):
                    at = places[k][turn]
                    left, right = ids[k][np.searchsorted(ends[k], at)], ids[k + 1][np.searchsorted(ends[k + 1], at) + 1]
                    wanted.setdefault((int(left), int(right)), []).append((k, int(at)))
            if not wanted:
                break
            at = [x[0][1] for x in wanted.values()]
            again = self.merge([word[i - self.sizes[a] : i + self.sizes[b]] for i, (a, b) in zip(at, wanted, strict=True)])
            for pair, got in zip(wanted, again, strict=True):
                if got.tolist() == list(pair):
                    for k, i in wanted[pair]:
                        cuts[k] = i
            open_cuts = [k for k in open_cuts if cuts[k] < 0]
            if not open_cuts:
                break
        if open_cuts:
            return self.merge_long(word, 2 * piece)
        first, last = [-1, *cuts], [*cuts, len(word)]
        return np.concatenate([x[(e > a) & (e <= b)] for x, e, a, b in zip(ids, ends, first, last, strict=True)])

    def learn(self, words: list[str]) -> None:
        """Encode words that aren't known, and decode their ids."""
        whole = self.whole
        alone = [w for w in words if w in whole]
        for w in alone:
            self.hold(w, str(whole[w]))
        rest = [w for w in words if w not in whole]
        raw = [w.encode("utf-8", "surrogatepass") for w in rest]
        # By length: a query makes as many rounds as its longest word needs.
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(size, kind="stable")
        size = size[order]
        short, total, begin = int(np.searchsorted(size, PIECE, "right")), np.cumsum(size * (size + 1) // 2), 0
        while begin < short:
            end = min(short, max(begin + 1, int(np.searchsorted(total, ROWS + (total[begin - 1] if begin else 0), "right"))))
            part = order[begin:end].tolist()
            rows, sizes = self.start(pa.array([raw[i] for i in part], pa.binary()))
            got = self.ask(ENCODE, rows, int(sizes.max()))
            self.keep([rest[i] for i in part], [raw[i] for i in part], *self.read(got))
            begin = end
        for i in order[short:].tolist():
            ids = self.merge_long(raw[i])
            self.keep([rest[i]], [raw[i]], [",".join(map(str, ids.tolist()))], self.decode([ids.tolist()]))

    def parts(self, text: str) -> tuple[list[str], bool]:
        """Pieces of a text that encode apart from each other; whether each but the first has lost a space in front."""
        if self.cut and not self.spaces.search(text):
            return text.split(" "), True
        return self.pattern.findall(text), False

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """Number of ids, ids (decimal, joined by commas) and decoded bytes of each text."""
        self.thin()
        spaced_ids = self.spaced_ids
        split = [self.parts(t) for t in texts]
        every = set().union(*[parts[1:] for parts, cut in split if cut])
        new = every.difference(spaced_ids)
        self.again |= every - new
        #: Pieces of several words, with the space that they had lost; plain letters are one word.
        findall = self.pattern.findall
        single, several = set(), {}
        for p in new:
            if p.isalpha() and max(p) < LATIN_END:
                single.add(" " + p)
            else:
                several[p] = findall(" " + p)
        heads = {parts[0]: findall(parts[0]) for parts, cut in split if cut}
        wanted = single.union(*several.values(), *heads.values(), *[parts for parts, cut in split if not cut])
        plain_ids = self.plain_ids
        self.learn([w for w in wanted if (w[1:] not in spaced_ids if w[0] == " " else w not in plain_ids)])
        for p, words in several.items():
            if len(words) > 1:
                raw, decoded = (" " + p).encode("utf-8", "surrogatepass"), self.bytes_of(words)
                self.hold(" " + p, ",".join([self.ids_of(w) for w in words]), None if decoded == raw else decoded)
        out = []
        for t, (parts, cut) in zip(texts, split, strict=True):
            first = heads[parts[0]] if cut else parts
            own, decoded = [self.ids_of(w) for w in first], self.bytes_of(first)
            if cut:
                own += map(spaced_ids.__getitem__, parts[1:])
                # Where no known word decodes to other bytes than its own, the rest of the text is what its words decode to.
                decoded += self.bytes_of([" " + p for p in parts[1:]] if self.other else [t[len(parts[0]) :]])
            text = ",".join(own)
            out.append((text.count(",") + 1 if own else 0, text, decoded))
        return out


def _steps(words: list[bytes]) -> Iterator[list[bytes]]:
    """words in parts of which none makes more rows in a recursive query than ROWS, but for one word alone."""
    part, rows = [], 0
    for w in words:
        own = len(w) * (len(w) + 1) // 2
        if part and rows + own > ROWS:
            yield part
            part, rows = [], 0
        part.append(w)
        rows += own
    if part:
        yield part


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, process: int) -> Encoder:
    del process  # a database isn't shared with a forked process
    return Encoder(path, pattern)


def encoder(path: str, pattern: str) -> Encoder:
    e = _encoder(path, pattern, os.getpid())
    e.open()
    return e


def bpe_encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of its texts, and token_ids (array of int) if asked for.

    ranks: path of a file of base64 tokens and ranks, on every machine;
    pattern: what cuts a text into words. ids_sha256 is over the decimal ids
    joined by commas, decoded_sha256 over the bytes decoded from the ids.
    Null and empty texts have no ids. Special tokens aren't known. Rows are
    independent and stay where they lie, so repeated rows and ties need no
    rule; an empty table gives an empty one. Columns of df with these names
    are replaced, all others stay.
    """
    common.prepare(df.sparkSession)
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * ids)
    at = df.columns.index(text)

    def run(batches):
        e = encoder(ranks, pattern)
        gc.disable()  # nothing here refers to itself, and the tables of words are slow to walk
        try:
            for batch in common.pieces(batches, at, TEXTS, CHARACTERS):
                got = e.encode([t or "" for t in batch.column(at).to_pylist()])
                own = [
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got]),
                    pa.array([hashlib.sha256(g[2]).hexdigest() for g in got]),
                ]
                if ids:
                    own.append(pa.array([np.fromstring(g[1], np.int32, sep=",") if g[1] else [] for g in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[f"c{j}" for j in range(batch.num_columns + len(own))])
        finally:
            gc.enable()
            e.rest()

    return common.map_arrow(df, run, SCHEMA + ", token_ids array<int>" * ids)


def bpe_decode(df: DataFrame, ranks: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded (binary): the bytes of an array of ids. A null array gives null, an empty one no bytes.

    Ids that aren't in the vocabulary, and nulls among ids, are left out.
    """
    common.prepare(df.sparkSession)
    df = df.drop("decoded")
    at = df.columns.index(ids)

    def run(batches):
        e = encoder(ranks, pattern)
        try:
            for batch in common.pieces(batches, at, TEXTS, CHARACTERS):
                lists = batch.column(at).to_pylist()
                raw = e.decode([x or [] for x in lists])
                own = pa.array([None if x is None else r for x, r in zip(lists, raw, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[f"c{j}" for j in range(batch.num_columns + 1)])
        finally:
            e.close()

    return common.map_arrow(df, run, "decoded binary")
