"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams (with word boundaries) and of
the word itself, all hashed into one table; a document's vector is the mean of its words' vectors;
a linear softmax over two classes scores it. Table and softmax are trained together, so a
misspelling that was never seen shares n-gram vectors with words that were.

Training takes at most ``sample_rows`` labelled rows (the smallest by a hash of the id, so any
table has its sample and small tables are taken whole). Scoring runs over all rows in tasks: the
model is linear, so a word's contribution to the two logits is a constant that a task computes
once and caches.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spare, with_fields

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
GRAMS = (3, 4, 5, 6)
CACHE = 150_000
#: The softmax works on means over many words; this keeps its weights of order one.
SCALE = 8.0
BASE = np.uint64(0x100000001B3)
#: Characters of words hashed at once (one word at least), and of text scored at once (one text at least).
BLOCK_LETTERS, BLOCK_CHARS = 160_000, 1 << 20


def words_of(text: str | None) -> set[str]:
    """The distinct words: a bag, so that repeating a word does not change a score."""
    return set(WORD.findall((text or "").lower()))


def powers(n: int) -> np.ndarray:
    """The first powers of the base; they grow with the longest word met."""
    if len(POWERS[0]) < n:
        POWERS[0] = np.cumprod(np.full(max(n, 64), BASE, np.uint64), dtype=np.uint64)
    return POWERS[0]


POWERS = [np.zeros(0, np.uint64)]


def blocks_of(words: list[str]) -> Iterator[list[str]]:
    """The words in blocks of about ``BLOCK_LETTERS`` letters."""
    first, letters = 0, 0
    for i, w in enumerate(words):
        letters += len(w)
        if letters >= BLOCK_LETTERS:
            yield words[first : i + 1]
            first, letters = i + 1, 0
    if first < len(words):
        yield words[first:]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words and of their n-grams, word after word, and how many each word has.

    All words are hashed at once, by polynomials over their code points.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    word_of = np.repeat(np.arange(len(marked)), lengths)
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # characters up to the end of the word
    whole = np.add.reduceat(codes * powers(int(lengths.max()))[np.arange(len(codes)) - np.repeat(starts, lengths)], starts) if len(marked) else codes
    hashes, owners, rolling = [_mixed(whole, 0)], [np.arange(len(marked))], codes
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * BASE + codes[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(left[: len(rolling)] >= n)
            hashes.append(_mixed(rolling[inside], n))
            owners.append(word_of[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owner, minlength=len(marked))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Buckets of 64-bit hashes; each length of n-gram has its own salt."""
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    """What each n-gram bucket adds to the margin of class 1, and the bias; ``constant`` where nothing could be learned."""

    margins: np.ndarray
    bias: float
    constant: float | None = None

    def word_margins(self, words: list[str]) -> list[float]:
        """The mean margin over each word's n-grams."""
        out: list[float] = []
        for block in blocks_of(words):
            grams, sizes = grams_of(block)
            sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.margins[grams], len(sizes))
            out.extend((sums / sizes).tolist())
        return out

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        bags = [words_of(x) for x in texts]
        new = set().union(*bags) - cache.keys()
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set().union(*bags)
        words = list(new)
        cache.update(zip(words, self.word_margins(words), strict=True))
        out = []
        for bag in bags:
            margin = (math.fsum(map(cache.__getitem__, bag)) / len(bag) if bag else 0.0) + self.bias  # fsum: the order of a set does not matter
            out.append(1.0 / (1.0 + math.exp(-min(50.0, max(-50.0, margin)))))
        return out

    def score(self, text: str | None, cache: dict[str, float]) -> float:
        return self.scores([text], cache)[0]


def train(texts: Iterable[str | None], labels: list[int], dim: int = 4, epochs: int | None = None, batch: int | None = None, rate: float = 0.02, decay: float = 1e-5, seed: int = 0) -> Model:
    """Adam over mini-batches; the gradients reach the softmax, the document means and the n-gram table alike."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, float(labels[0]) if labels else 0.0)
    epochs = epochs or int(np.clip(60_000 // len(labels), 5, 20))
    batch = batch or int(np.clip(len(labels) // 60, 8, 128))
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    docs = []
    for text in texts:
        words = sorted(words_of(text))
        own = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words))
        docs.append((own, np.full(len(words), 1 / max(1, len(words)), np.float32)))
    known, grams, lengths = list(vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    vocabulary.clear()
    for block in blocks_of(known):
        own, counts = grams_of(block)
        grams.append(own)
        lengths.append(counts)
    del known
    gram_ids, sizes = np.concatenate(grams), np.concatenate(lengths)
    gram_at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    y = np.asarray(labels, np.int64)
    table = rng.uniform(-1, 1, (BUCKETS, dim)).astype(np.float32) / dim
    softmax, bias = (rng.normal(0, 1, (dim, 2)) * 4).astype(np.float32), np.zeros(2, np.float32)
    params = [table, softmax, bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    share = max(1, int((y == 1).sum())) / max(1, len(y))
    weight = np.where(y == 1, np.sqrt((1 - share) / share) if share < 1 else 1.0, 1.0)
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            word_ids = np.concatenate([docs[r][0] for r in rows])
            word_w = np.concatenate([docs[r][1] for r in rows])
            doc_of = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            words, inverse = np.unique(word_ids, return_inverse=True)
            n = sizes[words]
            flat = np.repeat(gram_at[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            g = gram_ids[flat]
            word_of = np.repeat(np.arange(len(words)), n)
            inv_n = (1.0 / n).astype(np.float32)
            vec = np.stack([np.bincount(word_of, table[g, d], len(words)) for d in range(dim)], 1) * inv_n[:, None]
            mean = np.stack([np.bincount(doc_of, vec[inverse, d] * word_w, len(rows)) for d in range(dim)], 1)
            z = mean @ softmax * SCALE + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            dz = p
            dz[np.arange(len(rows)), y[rows]] -= 1
            dz *= (weight[rows] / len(rows))[:, None]
            d_mean = dz @ softmax.T * SCALE
            d_vec = np.stack([np.bincount(inverse, d_mean[doc_of, d] * word_w, len(words)) for d in range(dim)], 1) * inv_n[:, None]
            d_table = np.stack([np.bincount(g, d_vec[word_of, d], BUCKETS) for d in range(dim)], 1)
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for i, (param, grad) in enumerate(zip(params, (d_table + decay * table, mean.T @ dz * SCALE, dz.sum(0)), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.99 * v[i] + 0.01 * grad**2
                param -= (now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    margins = table.astype(np.float64) @ (softmax[:, 1] - softmax[:, 0]).astype(np.float64) * SCALE
    return Model(margins, float(bias[1] - bias[0]))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    sample_rows: int = 12_000,
    sample_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fits the model on a bounded sample of labelled rows.

    The bounds are ``sample_rows`` labelled ids, smallest by a hash of the id, and ``sample_bytes``
    bytes of words: tasks reduce each whole text to its distinct words, and the sample ends before
    the row that would pass the bound. ``usable`` (over the labels' columns) says which labels may be
    learned. Ids with several labels count by the largest, several texts of an id by the smallest;
    null ids, labels and texts are not learned. Without both classes the score is a constant.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known if usable is None else known.filter(usable)
    sample = (
        known.groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col)).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64(F.col("_id").cast("string")))
        .orderBy("_order", "_id")
        .limit(sample_rows)
    )
    texts = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(sample), "_id")  # sample_rows rows at most
    one_each = joined.groupBy("_order", "_id", "_label").agg(F.min("_text").alias("_text"))
    bags = Scratch(documents.sparkSession, "toxicity").save(one_each.select("_order", F.col("_id").cast("string").alias("_id"), "_label", "_text").mapInArrow(_bags, "place bigint, id string, label int, words string"), "bags")
    sizes = sorted(_rows(bags.select("place", "id", F.octet_length("words").alias("size"))))
    total, last = 0, None
    for place, own_id, size in sizes:
        total += size
        if total > sample_bytes:
            break
        last = (place, own_id)
    if last is None:
        return train([], [])
    rows = sorted(_rows(bags.filter((F.col("place") < last[0]) | (F.col("place") == last[0]) & (F.col("id") <= last[1]))))
    return train((words for _, _, _, words in rows), [int(label > 0) for _, _, label, _ in rows])


def _rows(df: DataFrame) -> list[tuple]:
    """The rows of a table of bounded size."""
    return list(zip(*(c.to_pylist() for c in df.toArrow().columns), strict=True))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [" ".join(sorted(words_of(x.as_py()))) for x in batch.column("_text")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_order", "_id", "_label")), pa.array(words, pa.string())], ["place", "id", "label", "words"])


def _scorer(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = pickle.loads(shared.value), {}
        for batch in batches:
            scores, block, chars = [], [], 0
            for x in batch.column(text_col):
                block.append(x.as_py())
                chars += len(block[-1] or "")
                if chars >= BLOCK_CHARS:
                    scores += model.scores(block, cache)
                    block, chars = [], 0
            scores += model.scores(block, cache)
            names = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    return run


def score_documents(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` plus ``score``, 0 to 1; a text without words (or null) gets the bias alone.

    A column ``score`` of the input is replaced. Rows are scored one by one, so repeated rows,
    ties and empty tables need no rule.
    """
    documents = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # one number a bucket
    (text,) = spare(documents, "_text")
    return documents.withColumn(text, F.col(text_col)).mapInArrow(_scorer(shared, text), with_fields(documents, "score double"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text has remainder 2 by 4: those labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fits on the labels that are not held out and scores all documents: adds held_out, score, predicted."""
    model = fit(documents, labels, ~held_out(id_col), id_col=id_col, text_col=text_col)
    scored = score_documents(documents.drop("held_out", "predicted"), model, text_col)
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
