"""Mixing a corpus to target weights by soft domain membership.

A classifier fitted on the labelled table gives each document a posterior
over domains (naive Bayes over what occurs in a text: hashed words, marks at
their ends, levels of capitals and of repetition). A document with t
tokens and posterior p, repeated r times, adds r * t * p[k] expected tokens
to domain k. Projected gradient descent looks for rates r >= 0 that minimize

    sum over k of (expected tokens of k - target of k) ** 2 / (total ** 2)
    + (PULL / total) * sum over documents of t * (r - 1) ** 2,

so rates stay near 1 where targets allow. A step needs the domains' totals
alone, which each iteration sums over all documents; a document's rate
follows from its posterior and the totals of the steps before, so no state
is kept and a lost executor costs one task.
"""

from __future__ import annotations

import logging
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

LOG = logging.getLogger(__name__)

#: Buckets of words without the marks around them, and of marks at a word's end.
BUCKETS, ENDS = 1 << 18, 1 << 12
MARKS = string.punctuation + "«»¿¡…–—“”„’‘"
#: Bounds of levels of a text's share of words in capitals, and of words that repeat the one before.
SHARES = (1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
FEATURES = BUCKETS + ENDS + 2 * (len(SHARES) + 1)
#: Twice the log likelihood ratio that chance may reach, and the least log ratio of a word that counts.
CHANCE, LIFT = 9.0, 0.5
#: Words at most whose buckets a task remembers.
CODES = 1 << 16
#: Strength of the pull of rates to 1, and the most that a rate can be unless the caller says otherwise.
PULL, MOST = 1e-3, 20.0
#: Iterations at most, and the largest miss (of each target; of all tokens where that is 0) at which they end.
ROUNDS, CLOSE = 60, 0.01
#: Domains at most: bounds the broadcast matrix.
DOMAINS = 64
#: Words of a batch that are looked up at once are split from this many texts, and from no other text beyond so many bytes.
TEXTS, BYTES = 250, 2 << 20


class _Codes(dict):
    """For a word: the bucket of what it is without marks, the bucket of the marks at its end, each from 1 (0: none), and if it is in capitals."""

    def __missing__(self, word):
        import xxhash

        own = word.strip(MARKS)
        lower = own.lower()
        end = word[len(word.rstrip(MARKS)) :] if own else word
        code = (xxhash.xxh64_intdigest(lower) & (BUCKETS - 1)) + 1 if own else 0
        code += ((xxhash.xxh64_intdigest(end) & (ENDS - 1)) + 1 if end else 0) << 24
        code += (len(own) > 1 and lower != own and own.upper() == own) << 48
        if len(word) <= 64:
            if len(self) >= CODES:
                self.clear()
            self[word] = code
        return code


def _features(texts: pa.Array, codes: _Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (at most TEXTS) and features that occur in them, each once, and the number of words of each row."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = np.fromiter((codes[w] for w in words), np.int64, len(words))
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = code[index] > 0
    index, rows = index[real], rows[real]
    tokens = np.bincount(rows, minlength=len(texts))
    own, end, capital = (code & 0xFFFFFF) - 1, ((code >> 24) & 0xFFFFFF) - 1, code >> 48
    end[end >= 0] += BUCKETS
    keys = []
    for feature in (own, end):
        at = feature[index] >= 0
        keys.append(rows[at] * FEATURES + feature[index[at]])
    again = np.zeros(len(index), bool)
    again[1:] = (index[1:] == index[:-1]) & (rows[1:] == rows[:-1])
    some = np.flatnonzero(tokens)
    for group, flag in enumerate((capital[index], again)):
        share = np.bincount(rows, flag, len(texts))[some] / tokens[some]
        keys.append(some * FEATURES + BUCKETS + ENDS + group * (len(SHARES) + 1) + np.digitize(share, SHARES))
    key = np.unique(np.concatenate(keys).astype(np.int32)).astype(np.int64)
    return key // FEATURES, key % FEATURES, tokens


def fit_domains(labelled: DataFrame, domains: list[str]) -> np.ndarray:
    """Weights (features, then any word, then the log prior, by domains) from rows of text and domain.

    A weight is the log of how much likelier a feature is in a domain than
    in all. It is 0 unless a likelihood ratio test tells the domain from the
    others by the feature, and is drawn to 0 where that is close: sums of
    many weights that fit chance would recall the labelled rows and no others.
    The weight of any word makes a domain's words as likely in sum as all
    words are, so that a long text without a domain's words isn't of it.
    """
    where = {d: k for k, d in enumerate(domains)}

    def count(batches):
        codes = _Codes()
        for batch in batches:
            for name in pc.unique(batch.column(1)).to_pylist():
                if name not in where:
                    continue
                texts = batch.column(0).filter(pc.equal(batch.column(1), name))
                total = np.zeros(FEATURES, np.int64)
                for part in common.pieces([pa.RecordBatch.from_arrays([texts], names=["c0"])], 0, TEXTS, BYTES):
                    found, n = np.unique(_features(part.column(0), codes)[1], return_counts=True)
                    total[found] += n
                at = np.append(np.flatnonzero(total), FEATURES)
                n = np.append(total, len(texts))[at]
                yield pa.RecordBatch.from_arrays([pa.array([where[name]] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], names=["c0", "c1", "c2"])

    found = common.map_arrow(labelled.select("text", "domain"), count, "domain int, feature int, n long", keep=False)
    rows = found.groupBy("domain", "feature").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FEATURES + 1, len(domains)))
    counts[rows["feature"].to_numpy(), rows["domain"].to_numpy()] = rows["n"].to_numpy()
    prior = counts[-1] + 1
    every = counts[:-1].sum(1)
    words = np.arange(FEATURES) < BUCKETS + ENDS
    # Words count against all words that texts have, so that a domain's long texts make no word its own; shares against texts.
    size = counts[: BUCKETS + ENDS].sum(0) + 1
    base = np.where(words, every, 0)
    weights = np.zeros((FEATURES + 2, len(domains)))
    weights[-1] = np.log(prior / prior.sum())
    for k in range(len(domains)):
        n, part = counts[:-1, k], np.where(words, size[k] / size.sum(), prior[k] / prior.sum())
        expected = every * part
        lift = np.log((n + part + 1e-12) / (expected + part + 1e-12))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(n > 0, n * np.log(n / expected), 0) + np.where(every > n, (every - n) * np.log((every - n) / (every - expected)), 0))
        sure = np.clip(1 - CHANCE / np.maximum(ratio, 1e-9), 0, 1)
        own = np.where(words & (np.abs(lift) < LIFT), 0, lift * sure)
        weights[:-2, k] = own
        weights[-2, k] = -np.log1p(base @ np.expm1(own) / max(base.sum(), 1))
    return weights


def posteriors(df: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """df with tokens (words of the text) and p, the posterior over domains, as its last columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        table, codes = shared.value, _Codes()
        live = table[:-2].any(1)
        for batch in common.pieces(batches, at, TEXTS, BYTES):
            n = batch.num_rows
            rows, found, tokens = _features(batch.column(at), codes)
            size = np.bincount(rows[found < BUCKETS + ENDS], minlength=n)
            rows, found = rows[live[found]], found[live[found]]
            p = np.stack([np.bincount(rows, table[found, k], n) for k in range(table.shape[1])], 1).astype(float)  # without rows they would be integers
            p += size[:, None] * table[-2] + table[-1]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * p.shape[1] + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64()), flat], names=[f"c{j}" for j in range(batch.num_columns + 2)])

    return common.map_arrow(df, run, "tokens long, p array<double>")


def rates(p: np.ndarray, steps: list[np.ndarray], most: float = MOST) -> np.ndarray:
    """Rates of documents by their posteriors, after the steps (scaled gradients over domains)."""
    r = np.ones(len(p))
    for gradient in steps:
        r = np.clip(r - (p @ gradient + PULL * (r - 1)), 0.0, most)
    return r


def _matrix(column) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _miss(miss: np.ndarray, targets: np.ndarray) -> float:
    """The largest miss as a part of its target."""
    return float(np.max(np.abs(miss) / np.where(targets > 0, targets, 1)))


def fit_rates(table: DataFrame, targets: np.ndarray, most: float = MOST) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps of the projected gradient for documents (tokens, p), and the shares of domains that they reach.

    targets: shares of all tokens by domain, adding up to 1. The gradient is
    scaled by the inverse of the curvature, which is the mean of p p' over
    the tokens of documents whose rate isn't at a bound; a step that makes
    the miss larger is taken again at half its length.
    """
    k = len(targets)

    def sums(steps):
        def run(batches):
            total, outer = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                t, p = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                if len(t):
                    r = rates(p, steps, most)
                    total += (t * r) @ p
                    free = t * ((r > 0) & (r < most))
                    outer += (p * free[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k), pa.int32()), pa.array(np.append(total, outer.ravel()))], names=["c0", "c1"])

        got = common.map_arrow(table.select("tokens", "p"), run, "at int, x double", keep=False).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        out = np.zeros(k * k + k)
        out[got["at"].to_numpy()] = got["x"].to_numpy()
        return out[:k], out[k:].reshape(k, k)

    steps: list[np.ndarray] = []
    reached, outer = sums(steps)
    whole = reached.sum()
    if not whole:
        return steps, np.zeros(k)
    miss, length = reached / whole - targets, 1.0
    for _ in range(ROUNDS):
        if _miss(miss, targets) <= CLOSE or length < 1e-3:
            break
        step = length * np.linalg.solve(outer / whole + PULL * np.eye(k), miss)
        reached, next_outer = sums([*steps, step])
        if np.linalg.norm(reached / whole - targets) > np.linalg.norm(miss):
            length /= 2
            continue
        steps.append(step)
        miss, outer, length = reached / whole - targets, next_outer, min(1.0, 2 * length)
    return steps, miss + targets


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", tokens: str | None = None, keep_text: bool = True, most: float = MOST) -> DataFrame:
    """df with tokens, domain, posterior (of that domain) and rate for each row.

    labelled: rows of text and domain; nulls, and domains without a target, are left out.
    targets: weight by domain; they are scaled to add up to 1. tokens: a column of token counts
    (null: 0) that the targets hold for; without it they hold for words cut at white space.
    rate is how often a document is to be taken: 0 leaves it out, 2.5 takes it twice or three
    times; it is `most` at most (infinite: no bound). A domain that no document leans to
    can't reach its target; rates then come as near as they can, and a warning is
    logged with the shares reached. Null and empty texts have no words: their rate follows
    from the priors. Equal texts have equal rates. Texts may be long: a batch is split by rows and bytes, a text
    is in memory whole. keep_text: without it the text column is left out, and isn't written between the passes.
    Columns of df with the new names are replaced (but a column of token counts by itself);
    rows and other columns stay. Empty tables give empty ones.
    """
    spark = df.sparkSession
    common.prepare(spark)
    domains = sorted(targets)
    if not 0 < len(domains) <= DOMAINS:
        raise ValueError(f"there must be from 1 to {DOMAINS} domains")
    weight = np.array([targets[d] for d in domains], float)
    weight /= weight.sum()
    model = fit_domains(labelled.where("text is not null and domain is not null"), domains)
    df = df.drop(*{"tokens", "domain", "posterior", "rate"} - {text, tokens})
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    own = [c for c, n in zip(inner.columns, names, strict=True) if (keep_text or n != text) and n not in ("tokens", "domain", "posterior", "rate")]
    count = F.col("tokens") if tokens is None else F.coalesce(F.col(f"c{names.index(tokens)}").cast("long"), F.lit(0))
    # Texts go through the classifier once: posteriors are written with what the result has.
    table = common.materialize(posteriors(inner, model, f"c{names.index(text)}").select(*own, count.alias("tokens"), "p"), "posteriors")
    steps, reached = fit_rates(table, weight, most)
    met = _miss(reached - weight, weight) <= CLOSE
    LOG.log(logging.INFO if met else logging.WARNING, "targets %s: shares of %s reached for %s", "met" if met else "not met", reached.round(5).tolist(), domains)
    at = table.columns.index("p")

    def run(batches):
        for batch in batches:
            p = _matrix(batch.column(at))
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            new = [
                pa.array([domains[b] for b in best], pa.string()),
                pa.array(p[np.arange(len(p)), best] if len(p) else np.zeros(0)),
                pa.array(rates(p, steps, most) if len(p) else np.zeros(0)),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[f"c{j}" for j in range(batch.num_columns + 3)])

    out = common.map_arrow(table, run, "domain string, posterior double, rate double").drop("p")
    return out.toDF(*[names[int(c[1:])] for c in own], "tokens", "domain", "posterior", "rate")


def take(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df's rows as often as their rate says: the whole part, and once more by a hash of the key below the rest.

    Equal keys have equal luck. Columns stay, rate too; a null rate counts as 0.
    """
    luck = F.pmod(F.xxhash64(F.lit("mix"), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = (F.floor("rate") + F.when(luck < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    plain = [f"c{i}" for i in range(len(df.columns))]
    return df.select("*", copies.alias("n")).toDF(*plain, "n").drop("n").toDF(*df.columns)
