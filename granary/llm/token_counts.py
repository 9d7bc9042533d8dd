"""Token counts by a whole-token shortcut over a piece vocabulary.

The vocabulary merges pairs of symbols by score, leftmost first among equal
scores. Two facts about it are proved from the model file before any text is
read (`Vocabulary`):

* no piece holds a word mark behind another character, so a merge never
  crosses from one word (marks first, then other characters) into the next,
  and no piece joins a character that occurs in single-character pieces only,
  so such characters cut a word into runs;
* for each piece, merging its own characters either gives that piece as the
  one result, or doesn't. The first kind are the whole tokens.

Counting then is a set lookup for words that are whole tokens; only the rest
go through the merge loop, whose counts are kept in a bounded table.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm import common

MARK = "▁"
#: Entries of the table of counted words, and the longest word kept in it.
KEPT, LONGEST = 300_000, 64
#: Texts whose words are looked up at once.
STEP = 200
SCHEMA = "n_bytes long, n_tokens long, n_whole long"


class Vocabulary:
    """A piece model's merges, and what can be proved about them."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only pair-merge models without text normalization are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.bytes = train.byte_fallback
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece spans words")
        joined = sorted(set(chain.from_iterable(p for p in self.score if len(p) > 1)))
        #: Characters that some longer piece holds; all others stand alone.
        self.runs = re.compile("[" + "".join(map(re.escape, joined)) + "]+")
        self.whole = {p for p in self.score if len(p) > 1 and self.merged(p) == 1}

    def alone(self, char: str) -> int:
        return 1 if char in self.score or not self.bytes else len(char.encode("utf-8", "surrogatepass"))

    def merged(self, word: str) -> int:
        """Tokens of a run of characters, by merging pairs."""
        score = self.score
        symbols = list(word)
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        queue = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and (s := score.get(pair := symbols[left] + symbols[right])) is not None:
                heapq.heappush(queue, (-s, left, right, pair))

        for i in range(len(symbols) - 1):
            offer(i)
        while queue:
            _, left, right, pair = heapq.heappop(queue)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != pair or after[left] != right:
                continue
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return sum(1 if len(s) > 1 else self.alone(s) for s in symbols if s)

    def count(self, word: str) -> int:
        """Tokens of a word: marks, then other characters."""
        if word in self.whole:
            return 1
        total = end = 0
        for run in self.runs.finditer(word):
            total += sum(map(self.alone, word[end : run.start()]))
            text, end = run[0], run.end()
            total += 1 if text in self.whole else self.merged(text)
        return total + sum(map(self.alone, word[end:]))


class Counter:
    """Counts texts; keeps what it has counted in a table of bounded size."""

    def __init__(self, vocabulary: Vocabulary, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.vocabulary = vocabulary
        self.merges = SentencePieceProcessor(model_proto=model)
        #: Words without their mark that are known to be one token.
        self.whole = {p[1:]: 1 for p in vocabulary.whole if p[0] == MARK}
        self.known: dict[str, int] = dict(self.whole)

    def words(self, text: str) -> list[str]:
        """Words, each without one leading mark."""
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in re.findall(r" +[^ ]*", " " + text)]
        return text.split(" ")

    def learn(self, words: list[str]) -> None:
        """Merge words that aren't known. The library puts one mark before each, as a text's words have it."""
        self.known.update(zip(words, map(len, self.merges.encode(words, num_threads=1)), strict=True))

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """Of each text: tokens, and how many words are one token."""
        if len(self.known) >= KEPT:
            self.known = dict(self.whole)
        split = [self.words(t) if t else [] for t in texts]
        rest = {w for words in split for w in words}.difference(self.known)
        once = {w: self.vocabulary.count(MARK + w.replace(" ", MARK)) for w in rest if not w or len(w) > LONGEST or " " in w}
        self.learn([w for w in rest if w not in once])
        out, get, whole = [], self.known.get, self.whole
        for words in split:
            found = list(map(get, words))
            if None in found:
                found = [once[w] if n is None else n for w, n in zip(words, found, strict=True)]
            out.append((sum(found), sum(map(whole.__contains__, words))))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    with open(path, "rb") as f:
        vocabulary = Vocabulary(model := f.read())
    if not vocabulary.prefix:
        raise ValueError("only models that put a mark before the text are supported")
    return Counter(vocabulary, model)


def token_counts(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """df with n_bytes (UTF-8), n_tokens and n_whole for the texts of a column.

    model: path of the piece model, on every machine. n_whole counts words
    that are one token. Null and empty texts have 0 of each; columns of df
    with these names are replaced, all others stay. Rows are counted one by
    one, where they lie: nothing is shuffled, repeated rows and ties need no
    rule, and an empty table gives an empty one.
    """
    common.prepare(df.sparkSession)
    df = df.drop("n_bytes", "n_tokens", "n_whole")
    at = df.columns.index(text)

    def run(batches):
        c = counter(model)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = [g for i in range(0, len(texts), STEP) for g in c.count(texts[i : i + STEP])]
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())],
                names=[f"c{i}" for i in range(batch.num_columns + 3)],
            )

    return common.map_arrow(df, run, SCHEMA)
