"""Language identification by a byte convolutional network.

The network embeds bytes, applies filters of several widths, takes the maximum of each
filter over a window and ends in a softmax.  It is trained here in numpy on labelled
windows and applied to whole texts, cut into windows of a fixed length: a text's
log-probabilities are the mean over its windows, weighted by their bytes.

Training windows are a bounded sample: ``DOCS_PER_LANGUAGE`` distinct texts of each
language, those with the smallest hashes, up to ``WINDOWS_PER_DOC`` windows spread over each text.  The prediction
looks at the text alone.

Null texts, empty ones and texts without a letter get ``und`` and score 0.  Null labels
are not learned from.  Null ids, repeated rows and other columns pass through.  Very long texts
are predicted window by window.  Of equally likely languages the first by name is taken.
With no labelled text nothing is learned and every text is ``und``; an empty table can be
labelled with any model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civilspark.llm.common import sample_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 6
UNDETERMINED = "und"
WINDOWS_AT_ONCE = 32


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(windows, weights)``: all bytes of a text in rows of WINDOW, zero filled."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros((rows, WINDOW), np.uint8)
    out.reshape(-1)[: len(data)] = data
    weights = np.full(rows, WINDOW, np.float64)
    weights[-1] = len(data) - (rows - 1) * WINDOW
    return out, weights


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class ByteNet:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: (width * EMBEDDING, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray
    _tables: tuple = field(default=None, repr=False)

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        return cls(
            languages,
            normal(0.5, 256, EMBEDDING),
            [normal(1 / np.sqrt(w * EMBEDDING), w * EMBEDDING, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            normal(0.1, FILTERS * len(WIDTHS), len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.biases, self.weights, self.bias]

    def _responses(self, windows: np.ndarray):
        """Per width: filter outputs (batch, positions, FILTERS) and the patches."""
        embedded = self.embed[windows]
        for width, kernel, bias in zip(WIDTHS, self.filters, self.biases):
            n = WINDOW - width + 1
            patches = np.concatenate([embedded[:, k : k + n] for k in range(width)], axis=2)
            yield patches @ kernel + bias, patches

    def step(self, windows: np.ndarray, targets: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of ``parameters``."""
        batch = len(windows)
        pooled, where, kept = [], [], []
        for response, patches in self._responses(windows):
            at = response.argmax(1)
            pooled.append(np.take_along_axis(response, at[:, None], 1)[:, 0])
            where.append(at)
            kept.append(patches)
        hidden = np.concatenate(pooled, axis=1)
        active = np.maximum(hidden, 0)
        error = softmax(active @ self.weights + self.bias)
        error[np.arange(batch), targets] -= 1
        error /= batch
        to_hidden = (error @ self.weights.T) * (hidden > 0)
        to_embed = np.zeros_like(self.embed)
        to_filters, to_biases = [], []
        for i, width in enumerate(WIDTHS):
            grad = to_hidden[:, i * FILTERS : (i + 1) * FILTERS]
            picked = kept[i][np.arange(batch)[:, None], where[i]]  # (batch, FILTERS, w * E)
            to_filters.append(np.einsum("bfk,bf->kf", picked, grad))
            to_biases.append(grad.sum(0))
            back = grad[:, :, None] * self.filters[i].T[None]
            for k in range(width):
                bytes_there = windows[np.arange(batch)[:, None], where[i] + k]
                np.add.at(to_embed, bytes_there, back[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        return [to_embed, *to_filters, *to_biases, active.T @ error, error.sum(0)]

    def _lookup(self):
        """Filter outputs as sums of tables over byte pairs, so no window is multiplied.

        Table one: first two bytes of each filter; table two: what follows.
        """
        if self._tables is None:
            def part(kernel, k):
                return self.embed @ kernel[k * EMBEDDING : (k + 1) * EMBEDDING]

            pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
            two, three, four = self.filters
            first = np.concatenate([pair(part(f, 0), part(f, 1)) for f in self.filters], axis=1)
            first += np.concatenate(self.biases)
            last = part(three, 2)
            rest = pair(part(four, 2), part(four, 3))
            self._tables = tuple(np.ascontiguousarray(t, np.float32) for t in (first, last, rest))
        return self._tables

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        first, last, rest = self._lookup()
        out = []
        for start in range(0, len(windows), WINDOWS_AT_ONCE):
            part = windows[start : start + WINDOWS_AT_ONCE]
            wide = part.astype(np.int32)
            pairs = (wide[:, :-1] << 8) | wide[:, 1:]
            response = first[pairs]
            response[:, :-1, FILTERS : 2 * FILTERS] += last[part[:, 2:]]
            response[:, :-2, 2 * FILTERS :] += rest[pairs[:, 2:]]
            hidden = np.concatenate(
                [
                    response[:, : WINDOW - w + 1, i * FILTERS : (i + 1) * FILTERS].max(1)
                    for i, w in enumerate(WIDTHS)
                ],
                axis=1,
            )
            logits = np.maximum(hidden, 0).astype(np.float64) @ self.weights + self.bias
            out.append(np.log(softmax(logits) + 1e-12))
        return np.concatenate(out) if out else np.empty((0, len(self.languages)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.languages:
            return UNDETERMINED, 0.0
        windows, weights = windows_of(text)
        mean = (self.log_probabilities(windows) * weights[:, None]).sum(0) / weights.sum()
        shares = softmax(mean[None])[0]
        best = int(shares.argmax())
        return self.languages[best], float(min(1.0, shares[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(
    windows: np.ndarray, targets: np.ndarray, languages: list[str], steps: int = 500, seed: int = 1
) -> ByteNet:
    """Adam on batches of windows, every language drawn equally often."""
    rng = np.random.default_rng(seed)
    net = ByteNet.fresh(languages, seed)
    if not languages:
        return net
    by_language = [np.flatnonzero(targets == k) for k in range(len(languages))]
    parameters = net.parameters()
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    for t in range(1, steps + 1):
        drawn = np.concatenate([rng.choice(rows, max(1, 64 // len(languages))) for rows in by_language])
        rate = 0.01 * (1 - t / (steps + 1))
        gradients = net.step(windows[drawn], targets[drawn])
        for p, g, m, v in zip(parameters, gradients, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def training_windows(
    labelled: DataFrame, text: str, label: str, per_language: int = DOCS_PER_LANGUAGE
) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of a bounded sample: ``per_language`` distinct texts of each label.

    Without a labelled text the sample is empty.
    """
    rows = sample_texts(labelled, per_language, label, text)
    rows = rows.select("text", F.col("group").alias("lang"))

    def cut(batches):
        for batch in batches:
            data, langs = [], []
            for value, lang in zip(batch["text"], batch["lang"]):
                if not has_letter(value):
                    continue
                windows, _ = windows_of(value)
                picks = np.unique(np.linspace(0, len(windows) - 1, WINDOWS_PER_DOC).astype(int))
                data += [windows[i].tobytes() for i in picks]
                data.append(windows_of(value.upper())[0][0].tobytes())  # some shouting
                langs += [lang] * (len(picks) + 1)
            yield pd.DataFrame({"lang": langs, "window": data})

    # per_language * (WINDOWS_PER_DOC + 1) windows a language at most
    found = sorted(rows.mapInPandas(cut, "lang string, window binary").collect())
    languages = sorted({r.lang for r in found})
    windows = np.frombuffer(b"".join(r.window for r in found), np.uint8).reshape(-1, WINDOW)
    return windows, np.array([languages.index(r.lang) for r in found]), languages


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> ByteNet:
    return train(*training_windows(labelled, text, label))


def held_out(doc_id: str | Column) -> Column:
    """Documents that no model learns from: crc32 of the id as text, mod 3, is 1."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; nothing is shuffled.

    Columns of these names in ``docs`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop(*[c for c in ("lang_pred", "score") if c != text])
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]

    def label(batches):
        net = shared.value
        for batch in batches:
            found = [net.predict(value) for value in batch[at]]
            yield batch.assign(
                lang_pred=[f[0] for f in found], score=[f[1] for f in found]
            ).astype({"lang_pred": object, "score": float})

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    out = docs.toDF(*names).mapInPandas(label, f"{kinds}, lang_pred string, score double")
    return out.toDF(*docs.columns, "lang_pred", "score")
