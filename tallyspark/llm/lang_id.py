"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded, filters of several widths run over fixed-length windows, each filter's maximum over the
window goes through a softmax layer. A text's probabilities are the mean of its windows', all of them, the last
one filled up with blanks. Training takes a bounded sample: about ``per_language`` documents of each language, those of
the smallest hashes, fewer if there are so many languages that ``MAX_SAMPLE`` documents are reached, and a few windows
of each, which are cut where the texts lie.

A text without a letter, or null, is ``und`` with score 0. Labels of null are not learned. Without any label
every text is ``und``. Repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices

WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Bounds of the training sample: documents of a language, documents in all, windows of a document.
PER_LANGUAGE, MAX_SAMPLE, WINDOWS_EACH = 300, 60_000, 4
STEPS, BATCH, RATE, SEED = 260, 64, 0.01, 20
UNKNOWN = "und"


class ByteCnn:
    """Parameters and passes of the network. Filters of all widths are one matrix; unused taps are zero."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.width, n = languages, max(WIDTHS), FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.taps = np.zeros((self.width, DIM, n), np.float32)
        for i, w in enumerate(WIDTHS):
            self.taps[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.kernel = rng.normal(0, 0.4, (self.width, DIM, n)).astype(np.float32) * self.taps
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, filters)"""
        count, length = windows.shape
        e = self.embed[windows].reshape(count, length * DIM)
        span = np.lib.stride_tricks.sliding_window_view(e, self.width * DIM, axis=1)[:, ::DIM]
        return np.ascontiguousarray(span).reshape(-1, self.width * DIM) @ self.kernel.reshape(self.width * DIM, -1)

    def pooled(self, windows: np.ndarray, where: bool = False):
        r = self.responses(windows).reshape(len(windows), windows.shape[1] - self.width + 1, -1)
        return (r.max(axis=1), r.argmax(axis=1)) if where else r.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(windows), 128):  # a block of responses stays small
            z = np.tanh(self.pooled(windows[i : i + 128])) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of some windows, by embedding, kernel, output and bias; only the position of a filter's maximum takes part."""
        n = len(x)
        top, at = self.pooled(x, where=True)
        hidden = np.tanh(top)
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        d_top = (p @ self.out.T) * (1 - hidden**2)
        d_embed, d_kernel = np.zeros_like(self.embed), np.zeros_like(self.kernel)
        for k in range(self.width):
            b = x[np.arange(n)[:, None], at + k]
            d_kernel[k] = np.einsum("bf,bfd->df", d_top, self.embed[b])
            np.add.at(d_embed, b, d_top[:, :, None] * self.kernel[k].T[None])
        return [d_embed, d_kernel * self.taps, hidden.T @ p, p.sum(axis=0)]

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> None:
        rng = np.random.default_rng(SEED + 1)
        weights = [self.embed, self.kernel, self.out, self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.array([rng.choice(by_label[k]) for k in rng.integers(0, len(by_label), BATCH)])
            for w, g, m, v in zip(weights, self.gradients(windows[pick], labels[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b" "), np.uint8).reshape(n, WINDOW)


def _sampled_windows(batches):
    for batch in slices(batches):
        cut = []
        for text in batch.column(0).to_pylist():
            w = windows_of(text.encode("utf-8", "replace"))
            n = min(len(w), WINDOWS_EACH)
            cut.append(w[[(2 * i + 1) * len(w) // (2 * n) for i in range(n)]].tobytes())
        yield pa.RecordBatch.from_pydict({"windows": pa.array(cut, pa.binary()), "lang": batch.column(1), "at": batch.column(2)})


def training_sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """(windows, lang) of about per_language documents each: those whose hash lies under their language's share."""
    rows = labelled.where("lang is not null and text is not null")
    share = rows.groupBy("lang").count()
    languages = share.count()
    if languages > MAX_SAMPLE:
        raise ValueError(f"{languages} languages are more than the {MAX_SAMPLE} documents of a sample")
    each = min(per_language, MAX_SAMPLE // max(1, languages))
    at = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(share), "lang").where(at * F.col("count") < each).select("text", "lang", at.alias("at"))
    found = chosen.mapInArrow(_sampled_windows, "windows binary, lang string, at double").limit(2 * MAX_SAMPLE).collect()
    return [(bytes(r["windows"]), r["lang"]) for r in sorted(found, key=lambda r: (r["lang"], r["at"], bytes(r["windows"])))]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> ByteCnn | None:
    """The network for the languages of ``labelled`` (doc_id, text, lang), or None without labels."""
    sample = training_sample(labelled, per_language)
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    number = {lang: k for k, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for w, _ in sample), np.uint8).reshape(-1, WINDOW)
    net = ByteCnn(languages)
    net.train(windows, np.repeat([number[lang] for _, lang in sample], [len(w) // WINDOW for w, _ in sample]))
    return net


def predict(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text); the network travels with the tasks (some 30 KB)."""

    def run(batches):
        for batch in slices(batches):
            names, scores, todo = [UNKNOWN] * len(batch), [0.0] * len(batch), []
            held: list[np.ndarray] = []

            def judge():
                if todo:
                    sums = np.add.reduceat(net.probabilities(np.concatenate(held)), np.cumsum([0, *map(len, held[:-1])]), axis=0)
                    for i, s, w in zip(todo, sums, held, strict=True):
                        k = int(s.argmax())
                        names[i], scores[i] = net.languages[k], min(1.0, float(s[k]) / len(w))
                    todo.clear()
                    held.clear()

            for i, text in enumerate(batch.column(1).to_pylist() if net else []):
                if text and any(map(str.isalpha, text)):
                    todo.append(i)
                    held.append(windows_of(text.encode("utf-8", "replace")))
                    if sum(map(len, held[-64:])) > 4096 or len(held) >= 256:
                        judge()
            judge()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = predict(docs, net)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is learned and whose score is at least min_score; text and columns unchanged."""
    net = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))

    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            stay = []
            for text in batch.column(at).to_pylist():
                ok = bool(net and text and any(map(str.isalpha, text)))
                stay.append(ok and float(net.probabilities(windows_of(text.encode("utf-8", "replace"))).mean(axis=0).max()) >= min_score)
            yield batch.filter(pa.array(stay, pa.bool_()))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
