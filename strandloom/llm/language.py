"""Language identification: error-correcting output codes over binary n-gram classifiers.

Every language has a codeword; a binary classifier for each bit tells on which side of that bit a
text's language lies. A text is the relative frequency of its character n-grams (1 to 3 letters, lower
case, word boundaries included) hashed into one table; a bit's margin is linear in it. Decoding sums,
for each language, a logistic loss of every bit's margin against its codeword, weighted by how well
that bit did on the training rows, and takes the language with the smallest sum. A text whose two
best languages are close is flagged as ambiguous.

Codewords: all splits of the languages in two for up to five languages (7 bits for four, any two
words 4 apart), beyond that the best of several random draws, with distinct words.

Training takes at most ``sample_rows`` texts of each language and ``sample_bytes`` of n-gram counts;
scoring runs over all whole texts in tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spare, with_fields
from .toxicity import held_out

BUCKETS = 1 << 14
LONGEST = 3
#: Code points that are hashed at once.
BLOCK = 1 << 18
UNKNOWN = "und"
#: The margins grow with this, so that weights stay of order one.
SCALE = 40.0


def letters() -> np.ndarray:
    """Whether each code point is a letter (any Unicode category L)."""
    if not LETTER:
        LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return LETTER[0]


LETTER: list[np.ndarray] = []


def grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(where they start, buckets) of the n-grams of each length.

    An n-gram holds a letter, and other characters, which all count as one, only at its ends.
    """
    letter = letters()[codes]
    plain = np.where(letter, codes, 32).astype(np.uint32)
    rolling, inside = plain, letter
    for n in range(1, LONGEST + 1):
        if n > 1:
            rolling = rolling[:-1] * np.uint32(0x01000193) + plain[n - 1 :]
            # letters all through but for the first and the last character
            inside = letter[:-1] | letter[1:] if n == 2 else _middle(letter, n)
        at = np.flatnonzero(inside)
        h = (rolling[at] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        yield at, (h >> np.uint32(32 - 14)).astype(np.int32)


def _middle(letter: np.ndarray, n: int) -> np.ndarray:
    inside = letter[1 : len(letter) - n + 2].copy()
    for i in range(2, n - 1):
        inside &= letter[i : len(letter) - n + 1 + i]
    return inside


def blocks(text: str, most: int = BLOCK) -> Iterator[np.ndarray]:
    """The lower-cased text's code points after and before a blank, in stretches that overlap by two."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, max(1, len(codes) - LONGEST + 1), most):
        yield codes[a : a + most + LONGEST - 1]


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for codes, last in _marked(text or ""):
        for at, own in grams(codes):
            total += np.bincount(own if last else own[at < BLOCK], minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used.astype(np.int32), total[used].astype(np.int32)


def _marked(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """The blocks, and whether each is the last: n-grams that start in an overlap belong to the next block."""
    found = None
    for codes in blocks(text):
        if found is not None:
            yield found, False
        found = codes
    if found is not None:
        yield found, True


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n x bits of -1 and 1: no bit is constant, no two bits split alike, all words differ."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        return np.array([[1] * bits, *([1 if (b + 1) >> i & 1 == 0 else -1 for b in range(bits)] for i in range(n - 1))], np.int8)
    rng, bits, best = np.random.default_rng(seed), 5 * int(np.ceil(np.log2(n))), (-1, None)
    for _ in range(64):
        words = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.int8)
        same = words.astype(np.int32) @ words.T
        apart = int(((bits - same) // 2 + np.eye(n, dtype=np.int32) * bits).min())
        if apart > best[0] and (np.abs(words.sum(0, dtype=np.int64)) < n).all():
            best = (apart, words)
    if best[0] < 1:
        raise ValueError("no distinct codewords were drawn")
    return best[1]


@dataclass
class Model:
    """Languages in order of their names, codewords, weights (buckets x bits), biases and each bit's share in decoding."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    share: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Texts x languages: the weighted logistic losses of the margins against the codewords."""
        return np.logaddexp(0, -margins[:, None] * self.words[None]) @ self.share

    def decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best, its share of exp(-loss), share of the second): ties go to the first name."""
        losses = self.losses(margins)
        order = np.argsort(losses, axis=1, kind="stable")
        p = np.exp(-(losses - losses.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        rows = np.arange(len(p))
        second = p[rows, order[:, 1]] if p.shape[1] > 1 else np.zeros(len(p))
        return order[:, 0], p[rows, order[:, 0]], second

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits, whether each text has a letter): short texts are hashed together."""
        sums, letters_in = np.zeros((len(texts), len(self.share))), np.zeros(len(texts), np.int64)
        found, a = np.zeros(len(texts), np.int64), 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) < BLOCK):
                size += len(texts[b])
                b += 1
            if size < BLOCK:  # one blank before each text and one after the last part them
                own = [x.lower() for x in texts[a:b]]
                starts = np.cumsum([0, *(len(x) + 1 for x in own)])
                self._add(np.frombuffer(f" {' '.join(own)} ".encode("utf-32-le", "surrogatepass"), np.uint32), starts, slice(a, b), sums, found, letters_in, True)
            else:
                for codes, last in _marked(texts[a]):
                    self._add(codes, np.array([0, len(codes) if last else BLOCK]), slice(a, a + 1), sums, found, letters_in, last)
            a = b
        return self.bias + sums / np.maximum(found, 1)[:, None] * SCALE, letters_in > 0

    def _add(self, codes: np.ndarray, starts: np.ndarray, rows: slice, sums: np.ndarray, found: np.ndarray, letters_in: np.ndarray, last: bool) -> None:
        for n, (at, own) in enumerate(grams(codes), 1):
            bounds = np.searchsorted(at, starts)
            bounds[-1] = len(at) if last else bounds[-1]
            many = np.diff(bounds)
            found[rows] += many
            if n == 1:
                letters_in[rows] += many
            some = np.flatnonzero(many)
            if len(some):
                sums[np.arange(rows.start, rows.stop)[some]] += np.add.reduceat(self.weights[own[: bounds[-1]]], bounds[:-1][some], axis=0)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the logistic losses of all bits at once; rows are (language, buckets, counts)."""
    languages = sorted({language for language, _, _ in rows})
    words = codewords(len(languages), seed)
    bits = words.shape[1]
    weights, bias = np.zeros((BUCKETS, bits)), np.zeros(bits)
    if len(languages) < 2:
        return Model(languages, words, weights, bias, np.ones(bits))
    of = {language: i for i, language in enumerate(languages)}
    y = np.array([of[language] for language, _, _ in rows])
    balance = len(rows) / len(languages) / np.bincount(y)[y]
    rng, step = np.random.default_rng(seed), 0
    params = [weights, bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def dense(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), BUCKETS))
        for i, r in enumerate(some):
            _, own, n = rows[r]
            x[i, own] = n / max(1, n.sum()) * SCALE
        return x

    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            x, side = dense(some), words[y[some]]
            z = x @ weights + bias
            pull = -side / (1 + np.exp(np.clip(side * z, -50, 50))) * balance[some, None] / len(some)
            step += 1
            now = rate * (1 - 0.9 * epoch / epochs)
            for i, (param, grad) in enumerate(zip(params, (x.T @ pull + decay * weights, pull.sum(0)), strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.99 * v[i] + 0.01 * grad**2
                param -= now * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
    right = np.zeros(bits)
    for a in range(0, len(rows), batch):
        some = np.arange(a, min(len(rows), a + batch))
        right += ((dense(some) @ weights + bias) * words[y[some]] > 0).sum(0)
    share = np.maximum(right / len(rows) - 0.5, 0.01)  # a bit that guesses counts next to nothing
    return Model(languages, words, weights, bias, share / share.mean())


def fit(documents: DataFrame, usable: Column | None = None, sample_rows: int = 500, most_rows: int = 50_000, sample_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on a bounded sample of the rows with a language.

    The bounds are ``sample_rows`` rows of each language, smallest by a hash of id and text,
    ``most_rows`` rows and ``sample_bytes`` bytes of n-gram counts in all (rows in that order,
    languages in turn): tasks reduce each whole text to its counts. ``usable`` says which rows may be learned. Rows without
    text, language or any letter are not learned; without a row no language is known.
    """
    known = documents.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known if usable is None else known.filter(usable)
    order = Window.partitionBy("lang").orderBy("place", "id")
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("place"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    sizes = Scratch(documents.sparkSession, "language").save(
        _ranked(rows, order, sample_rows, most_rows).mapInArrow(_counted, "lang string, rank int, buckets binary, counts binary"), "counts"
    )
    total, rows = 0, []
    listed = sizes.select("rank", "lang", (F.octet_length("buckets") + F.octet_length("counts")).alias("size")).orderBy("rank", "lang").toArrow()
    last = None
    for rank, lang, size in zip(*(c.to_pylist() for c in listed.columns), strict=True):
        total += size
        if total > sample_bytes:
            break
        last = (rank, lang)
    if last is None:
        return train([])
    kept = sizes.filter((F.col("rank") < last[0]) | (F.col("rank") == last[0]) & (F.col("lang") <= last[1])).orderBy("lang", "rank").toArrow()
    for lang, buckets, counts in zip(*(kept.column(c).to_pylist() for c in ("lang", "buckets", "counts")), strict=True):
        if buckets:
            rows.append((lang, np.frombuffer(buckets, np.int32), np.frombuffer(counts, np.int32)))
    return train(rows)


def _ranked(rows: DataFrame, order, most: int, in_all: int) -> DataFrame:
    """The first ``most`` rows of each language by hash, ``in_all`` at most: ids and hashes are ranked first, texts join afterwards.

    Only hashes low enough to leave some 2 * ``most`` rows of a language are ranked, so no language's
    rows meet in one task; where they leave fewer than ``most``, the sample has these. The languages
    are the first ``in_all`` by name.
    """
    keyed = rows.select("lang", "place", "id")
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("rows")).orderBy("lang").limit(in_all)
    low = keyed.join(F.broadcast(sizes), "lang").filter((F.col("place") / 2.0**63 + 1) / 2 <= 2.0 * most / F.col("rows"))
    few = low.select("lang", "place", "id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    few = few.groupBy("lang", "place", "id").agg(F.min("rank").alias("rank")).orderBy("rank", "lang", "place").limit(in_all)
    return rows.join(F.broadcast(few), ["lang", "place", "id"]).dropDuplicates(["lang", "place", "id"]).select("lang", "rank", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts_of(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("rank"), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], ["lang", "rank", "buckets", "counts"]
        )


def _predictor(shared, text_col: str, close: float, most_chars: int = 1 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shared.value)
        for batch in batches:
            predicted, scores, doubtful, texts, chars = [], [], [], [], 0

            def decode() -> None:
                margins, readable = model.margins(texts)
                best, score, second = model.decoded(margins) if model.languages else (None, np.zeros(len(texts)), np.zeros(len(texts)))
                for i, good in enumerate(readable & bool(model.languages)):
                    predicted.append(model.languages[best[i]] if good else UNKNOWN)
                    scores.append(float(score[i]) if good else 0.0)
                    doubtful.append(bool(not good or score[i] - second[i] < close))

            for x in batch.column(text_col):
                texts.append(x.as_py() or "")
                chars += len(texts[-1])
                if chars >= most_chars:
                    decode()
                    texts, chars = [], 0
            if texts:
                decode()
            names = [c for c in batch.schema.names if c != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(doubtful, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])

    return run


def predict(documents: DataFrame, model: Model, close: float = 0.2, text_col: str = "text") -> DataFrame:
    """All columns of ``documents`` plus lang_pred, score and ambiguous.

    ``score`` is the best language's share of exp(-loss); a text is ambiguous if the second comes
    nearer than ``close``. A null text and one without a letter are ``und`` with score 0 and
    ambiguous, as is every text if no language was learned. Columns of the input with the names of
    results are replaced. Rows are decided one by one, so repeated rows and empty tables need no rule.
    """
    documents = documents.drop("lang_pred", "score", "ambiguous")
    shared = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # buckets x bits
    (text,) = spare(documents, "_text")
    return documents.withColumn(text, F.col(text_col)).mapInArrow(_predictor(shared, text, close), with_fields(documents, "lang_pred string, score double, ambiguous boolean"))


def identified(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the languages of the rows that are not held out and decides all: adds held_out, lang_pred, score, ambiguous."""
    model = fit(documents, ~held_out(id_col), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(documents.drop("held_out"), model, text_col=text_col).withColumn("held_out", held_out(id_col))


def plain_margins(model: Model, text: str) -> list[float]:
    """For tests: the margins of one text, n-gram by n-gram."""
    padded, total, n_grams = f" {text.lower()} ", np.zeros(len(model.share)), 0
    padded = "".join(c if c.isalpha() else " " for c in padded)
    for n in range(1, LONGEST + 1):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if not gram.strip() or " " in gram[1:-1]:
                continue
            h = 0
            for c in gram:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = (h + n) * 0x9E3779B1 % 2**32
            h = (h ^ (h >> 15)) * 0x85EBCA77 % 2**32
            total += model.weights[h >> 18]
            n_grams += 1
    return (model.bias + total / max(1, n_grams) * SCALE).tolist()
