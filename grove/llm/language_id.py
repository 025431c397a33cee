"""Language ID: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

A word's subwords are its runs of 2 to 5 bytes, with the gaps around it. They are hashed into buckets, each of which has an embedding; a text is the
mean of its subwords' embeddings, and a softmax over the languages reads that mean. As nothing but a mean lies between, a trained model is one table of
(bucket, language), which tasks add up in whole numbers, so that a text's score depends on nothing else in its batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _MASKS, LOWER, U64, boxed, eight_bytes, mix, pieces, plus, quoted, unboxed

BITS = 15
SIZES = (2, 3, 4, 5)
DIMENSIONS = 16
TEXTS = 4_000  # learned from, over all languages
BUCKETS = 2_048  # an example that is learned from has at most so many buckets, its most frequent; predictions use all
MOST_LANGUAGES = 256
SHORT = (1, 3, 10)  # words of the slices that are learned from beside each whole text
EPOCHS, BATCH, RATE = 6, 64, 2.0
SCALE = 1 << 20
STEP = 1 << 17

#: Bytes of words: ASCII letters and those of longer characters
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def subwords(data: np.ndarray, off: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the subwords of texts laid end to end, and the numbers of their texts, some at a time; numbers never descend within a piece."""
    n, k = len(data), len(off) - 1
    framed = np.full(n + k + 9, 32, np.uint8)  # a gap before each text and one at the end
    framed[np.arange(n) + np.repeat(np.arange(1, k + 1), np.diff(off))] = np.where(LETTER[data], LOWER[data], 32)
    begin = off[:-1] + np.arange(k)
    letter, view = framed != 32, eight_bytes(framed)
    last = n + k  # the gap at the end
    for a in range(0, last, step):
        i = np.arange(a, min(a + step, last))
        on = letter[i] | letter[i + 1]
        for size in SIZES:
            if size > 2:
                on = on & letter[i + size - 2] if size > 3 else letter[i + 1]
            x = i[on & (i + size <= last + 1)]
            if len(x):
                h = mix((view[x] & _MASKS[size]) * U64(0x9E3779B97F4A7C15) + U64(size))
                yield (h >> U64(64 - BITS)).astype(np.int64), np.searchsorted(begin, x, "right") - 1


def has_letter(text: bytes) -> bool:
    """Whether a character is a letter of any script."""
    ascii_only = np.frombuffer(text, np.uint8)
    if LETTER[ascii_only[ascii_only < 128]].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class LanguageModel:
    """table: of whole numbers, SCALE times what a subword in a bucket adds to each language; a score under `least` is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the languages for each text; equal ones where a text has no subword."""
        total = np.zeros((len(off) - 1, len(self.languages)), np.int64)
        count = np.zeros(len(off) - 1, np.int64)
        for bucket, text in subwords(data, off, max(1 << 10, STEP * 4 // max(4, len(self.languages)))):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            total[text[first]] += np.add.reduceat(self.table[bucket].astype(np.int64), first)
            count += np.bincount(text, minlength=len(count))
        logits = total / (SCALE * np.maximum(count, 1))[:, None] + self.bias * (count > 0)[:, None]
        return softmax(logits / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def examples(text: bytes) -> list[bytes]:
    """A text and slices of a few of its words, from places that its checksum tells, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for x, n in enumerate(SHORT):
        if len(words) > n:
            at = zlib.crc32(text, x) % (len(words) - n + 1)
            out.append(b" ".join(words[at : at + n]))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and counts of each example of the chosen texts."""
    for b in batches:
        rows = []
        for key, lang, text in zip(b.column("key").to_pylist(), b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for x, part in enumerate(examples(raw) if has_letter(raw) else ()):
                count = np.zeros(1 << BITS, np.int64)
                for bucket, _ in subwords(np.frombuffer(part, np.uint8), np.array([0, len(part)])):
                    count += np.bincount(bucket, minlength=1 << BITS)
                col = np.sort(np.argsort(-count, kind="stable")[: min(BUCKETS, np.count_nonzero(count))])
                if len(col):
                    rows.append((key, lang, x, col.astype(np.int32), (count[col] / count[col].sum()).astype(np.float32)))
        cols = [[r[i] for r in rows] for i in range(5)]
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "lang", "part", "col", "share"])


def _means(rows: list[int], first: np.ndarray, col: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and shares of some examples one after the other, and where each begins."""
    n = np.diff(first)[rows]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1][rows], n)
    return col[at], share[at], np.cumsum(n) - n


def fit(col: np.ndarray, share: np.ndarray, first: np.ndarray, label: np.ndarray, n_labels: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and bias by stochastic gradient descent on the cross entropy of sparse examples."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)) / DIMENSIONS
    weight, bias = rng.uniform(-1, 1, (DIMENSIONS, n_labels)), np.zeros(n_labels)
    steps = EPOCHS * max(1, -(-len(label) // BATCH))
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for x in range(0, len(order), BATCH):
            rows = order[x : x + BATCH]
            rate = RATE * (1 - done / steps)
            c, s, begin = _means(rows, first, col, share)
            mean = np.add.reduceat(embed[c] * s[:, None], begin)
            error = softmax(mean @ weight + bias)
            error[np.arange(len(rows)), label[rows]] -= 1
            error /= len(rows)
            down = error @ weight.T
            weight -= rate * mean.T @ error
            bias -= rate * error.sum(0)
            by = np.argsort(c, kind="stable")
            edge = np.flatnonzero(np.r_[True, c[by][1:] != c[by][:-1]])
            step = np.add.reduceat((np.repeat(down, np.diff(np.r_[begin, len(c)]), axis=0) * s[:, None])[by], edge)
            # a bucket's embedding moves by its share of a text, so the step is scaled up by how many share a text
            embed[c[by][edge]] -= rate * DIMENSIONS * step
            done += 1
    return embed, weight, bias


def calibrate(logits: np.ndarray, label: np.ndarray, error: float) -> tuple[float, float]:
    """The temperature of least cross entropy, and the least score from which on no more than `error` of the examples are wrong."""
    if len(label) < 20:
        return 1.0, 0.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(label)), label], 1e-300)).mean()
    temperature = min(np.geomspace(0.05, 20, 121).tolist(), key=loss)
    p = softmax(logits / temperature)
    score, wrong = p.max(1), p.argmax(1) != label
    by = np.argsort(-score, kind="stable")
    fine = np.flatnonzero(np.cumsum(wrong[by]) <= error * np.arange(1, len(by) + 1))
    return float(temperature), float(score[by[fine[-1]]]) if len(fine) else 1.0


def train_languages(docs: DataFrame, lang: str = "lang", text: str = "text", texts: int = TEXTS, error: float = 0.01) -> LanguageModel:
    """A model of the languages of docs, fitted on about `texts` of them (equally many of each language, where it has so many distinct ones).

    Which texts are taken depends on their hashes alone, so every row is as likely, copies count once, and the driver holds at most 4 examples of
    each, of BUCKETS numbers at most (70 MB for TEXTS long texts). A fifth of them is kept from the fit, and tells the temperature and the score under which answers
    are rejected (`error`: the share of wrong answers among those that are not). Rows without text, letter or language are not learned from. More
    than MOST_LANGUAGES languages are an error; none, or no text, gives a model that answers nothing.
    """
    rows = docs.select(F.col(quoted(lang)).cast("string").alias("lang"), F.col(quoted(text)).cast("string").alias("text")).filter("lang is not null and text is not null")
    found = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in column {lang}")
    if not found:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.int32), np.zeros(0), 1.0, 0.0)
    each = -(-texts // len(found))
    share = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["n"])))])
    key = F.xxhash64("text", F.lit("language"))
    chosen = rows.withColumn("key", key).filter(F.pmod("key", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).dropDuplicates(["key", "lang"])
    got = chosen.select("key", "lang", "text").mapInArrow(_counts, "key long, lang string, part int, col array<int>, share array<float>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending"), ("part", "ascending")]).combine_chunks()
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.int32), np.zeros(0), 1.0, 0.0)
    label = np.searchsorted(languages, got.column("lang").to_pylist()) if len(languages) > 1 else np.zeros(got.num_rows, np.int64)
    lists = got.column("col").combine_chunks() if isinstance(got.column("col"), pa.ChunkedArray) else got.column("col")
    col = lists.flatten().to_numpy().astype(np.int64)
    first = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
    weights = got.column("share").combine_chunks() if isinstance(got.column("share"), pa.ChunkedArray) else got.column("share")
    value = weights.flatten().to_numpy().astype(np.float64)
    aside = np.mod(got.column("key").to_numpy() >> 30, 5) == 0
    if not (set(label[~aside]) >= set(label)):  # too few texts to keep some aside
        aside[:] = False
    learn, check = np.flatnonzero(~aside), np.flatnonzero(aside)
    c, s, begin = _means(learn, first, col, value)
    embed, weight, bias = fit(c, s, np.r_[begin, len(c)], label[learn], len(languages))
    table = np.round(embed @ weight * SCALE).astype(np.int32)
    c, s, begin = _means(check, first, col, value)
    logits = np.add.reduceat(table[c] / SCALE * s[:, None], begin) + bias if len(check) else np.zeros((0, len(languages)))
    temperature, least = calibrate(logits, label[check], error)
    return LanguageModel(languages, table, bias, temperature, least)


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs with lang_pred, score (the calibrated probability of lang_pred) and accepted (score is not rejected).

    Whole texts are read, in pieces of some megabytes, and nothing but the text: equal texts have equal results. A null text, an empty one and one
    without a letter of any script have lang_pred `und`, score 0 and accepted false; so has every text if the model knows no language.
    Columns named lang_pred, score or accepted are replaced; an empty table gives an empty table, repeated rows repeated rows.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]
    answers = np.array([*model.languages, "und"], object)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers for each of at most MOST_LANGUAGES

    def run(batches):
        model = shared.value
        for b, data, off in pieces(batches, "text"):
            raw = data.tobytes()
            known = np.array([bool(model.languages) and has_letter(raw[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], bool)
            p = model.scores(data, off) if model.languages else np.zeros((b.num_rows, 1))
            best = np.where(known, p.argmax(1), len(model.languages))
            score = np.where(known, p.max(1), 0.0)
            more = [pa.array(answers[best].tolist(), pa.string()), pa.array(score), pa.array(known & (score >= model.least))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "lang_pred", "score", "accepted"])

    rows = docs.select(boxed([c for c in names if c != text]), F.col(quoted(text)).cast("string").alias("text"))
    told = rows.mapInArrow(run, plus(rows, "lang_pred string, score double, accepted boolean"))
    return told.select(*unboxed(names, {text: F.col("text")}), "lang_pred", "score", "accepted")
