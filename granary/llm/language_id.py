"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams (1 to 3, inside words with a mark at both ends) fall into
2**16 buckets. Training counts them by language, as sparse partial sums;
the matrix of log probabilities is broadcast. Scoring makes the sparse
matrix of documents by distinct words of a batch and multiplies it with the
words' own sums of log probabilities, which come from the matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import common

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages at most; bounds the broadcast matrix to 64 MB.
LANGUAGES = 256
UNKNOWN = "und"
LETTER = r"\p{L}"
#: Distinct words whose n-grams are expanded at once.
STEP = 40_000


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and for each the number of its word."""
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters of the word from here on
    found, owner = [], []
    mixed = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        mixed = (mixed[:m] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in ORDERS:
            inside = left[:m] >= n
            found.append(((mixed[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64))
            owner.append(word[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words of texts, and for each occurrence its word's number and its row."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if "" in words:  # what stands before a space at a text's begin, and after one at its end
        real = index != words.index("")
        index, rows = index[real], rows[real]
    return words, index, rows


def trained(df: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log probabilities (buckets by languages) of labelled rows.

    Every language has the same prior, so it isn't part of the matrix.
    """
    counted = common.map_arrow(
        df.select(F.col(lang).alias("lang"), F.col(text).alias("text")), _count, "lang string, bucket int, n long", keep=False
    )
    # A label too many would make the matrix, and what the driver gathers, larger than the bound: so they are counted first.
    langs = sorted(r[0] for r in df.select(F.col(lang)).distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"there are over {LANGUAGES} languages")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, max(1, len(langs))), 0.5)
    where = {x: i for i, x in enumerate(langs)}
    at = np.fromiter((where[x] for x in summed["lang"].to_pylist()), np.int64, len(summed))
    counts[summed["bucket"].to_numpy(), at] += summed["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype(np.float32)


def _count(batches):
    for batch in batches:
        for lang in pc.unique(batch.column(0)).to_pylist():
            texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
            words, index, _ = split(texts)
            often = np.bincount(index, minlength=len(words))
            total = np.zeros(BUCKETS)
            for i in range(0, len(words), STEP):
                bucket, owner = grams(words[i : i + STEP])
                total += np.bincount(bucket, often[i : i + STEP][owner], BUCKETS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["c0", "c1", "c2"])


def scored(texts: pa.Array, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the best language's column and its posterior probability."""
    words, index, rows = split(texts)
    of_word = np.zeros((len(words), matrix.shape[1]), np.float64)
    for i in range(0, len(words), STEP):
        bucket, owner = grams(words[i : i + STEP])
        for k in range(matrix.shape[1]):
            of_word[i : i + STEP, k] = np.bincount(owner, matrix[bucket, k], min(STEP, len(words) - i))
    total = np.stack([np.bincount(rows, of_word[index, k], len(texts)) for k in range(matrix.shape[1])], 1)
    best = total.argmax(1)
    return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def predict_languages(df: DataFrame, training: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with lang_pred and score for the texts of a column.

    training: labelled rows, of which all count but those whose text or label
    is null. score is the posterior probability of lang_pred among the learned
    languages (uniform prior). Texts that are null, empty or without a letter get
    lang_pred "und" and score 0; so do all texts if nothing was learned. Long texts count
    whole; a text is in memory whole, a batch is split by its rows. Repeated rows have a row each.
    Equal posteriors: the first language by name. Columns of df with these
    names are replaced, all others stay; rows stay where they lie.
    """
    spark = df.sparkSession
    common.prepare(spark)
    rows = training.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    langs, matrix = trained(rows, "text", "lang")
    shared = spark.sparkContext.broadcast((langs, matrix))
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)

    def run(batches):
        import regex

        letter = regex.compile(LETTER)
        langs, matrix = shared.value
        for batch in batches:
            texts = batch.column(at)
            best, score = scored(texts, matrix)
            known = [bool(langs and t and letter.search(t)) for t in texts.to_pylist()]
            pred = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=[f"c{i}" for i in range(batch.num_columns + 2)])

    return common.map_arrow(df, run, "lang_pred string, score double")
