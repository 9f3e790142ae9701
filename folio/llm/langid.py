"""Operator 10: language identification by a byte convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from folio.llm.bpe import frugal
from folio.llm.common import free_name, session_of

WIDTHS = (2, 3, 4)
WINDOW = 256
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Filters of several widths over bytes, max pooling over a window, softmax over languages.

    ``filters[w]`` is (w, 256, n): the response at a place is the sum of one row a byte, which is a convolution over one-hot bytes.
    """

    langs: list[str]
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.pairs = None

    def prepare(self) -> ByteNet:
        """Tables of byte pairs: a width-4 response is then two look-ups."""
        self.pairs = {}
        for w, f in self.filters.items():
            self.pairs[w] = [(f[i][:, None, :] + f[i + 1][None, :, :]).reshape(65536, -1) for i in range(0, w - 1, 2)]
        return self

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Windows (m, WINDOW) of bytes to the largest response of each filter: (m, filters)."""
        m, n = data.shape
        pair = data[:, :-1].astype(np.int32) << 8 | data[:, 1:]
        out = []
        for w, f in self.filters.items():
            length = n - w + 1
            sums = self.pairs[w][0][pair[:, :length]]
            for k, table in enumerate(self.pairs[w][1:], 1):
                sums += table[pair[:, 2 * k : 2 * k + length]]
            if w % 2:
                sums += f[w - 1][data[:, w - 1 : w - 1 + length]]
            out.append(sums.max(axis=1))
        return np.concatenate(out, axis=1)

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(data), 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: str) -> np.ndarray:
    """All bytes of a text as windows; the last is filled up with spaces."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    data = np.full(n * WINDOW, 32, np.uint8)
    data[: len(raw)] = raw
    return data.reshape(n, WINDOW)


def train(rows: list[tuple[str, str]], *, filters: int = 8, epochs: int = 15, rate: float = 0.01, seed: int = 7, per_text: int = 3) -> ByteNet:
    """Fit by Adam on windows of the texts; equal weight to each language."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    data, labels = [], []
    for text, lang in rows:
        own = windows_of(text)
        own = own[rng.permutation(len(own))[:per_text]]
        data.append(own)
        labels += [place[lang]] * len(own)
    x, y = np.concatenate(data), np.array(labels)
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(langs))) / len(langs))[y].astype(np.float32)
    f = {w: rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
    out = rng.normal(0, 0.3, (filters * len(WIDTHS), len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    params = [*f.values(), out, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), size):
            pick = order[at : at + size]
            b, t = x[pick], y[pick]
            responses, best = [], []
            for w in WIDTHS:
                n = WINDOW - w + 1
                r = sum(f[w][i][b[:, i : i + n]] for i in range(w))
                best.append(r.argmax(axis=1))
                responses.append(np.take_along_axis(r, best[-1][:, None, :], 1)[:, 0])
            hidden = np.concatenate(responses, axis=1)
            active = np.maximum(hidden, 0)
            z = active @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(t)), t] -= 1
            p *= weight[pick][:, None] / len(t)
            d_hidden = (p @ out.T) * (hidden > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g = np.zeros_like(f[w])
                d = d_hidden[:, k * filters : (k + 1) * filters]
                for i in range(w):
                    byte = np.take_along_axis(b, best[k] + i, 1)
                    np.add.at(g[i], (byte, np.arange(filters)[None, :]), d)
                grads.append(g)
            grads += [active.T @ p, p.sum(axis=0)]
            step += 1
            for p_, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return ByteNet(langs, f, out, bias)


#: Texts that a label gives at least, or all it has.
LEAST_TEXTS = 16


def is_held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, *, per_lang: int = 400, sample_chars: int = 1500, most_texts: int = 160_000) -> ByteNet | None:
    """A network from at most about ``per_lang`` labelled documents a language that aren't held out, and about ``most_texts`` in all.

    The sample is a hash threshold for each language, so it is bounded (``per_lang`` + a fluctuation, ``sample_chars`` code points each,
    from a place in the text that its hash names) and the same on every run. Where labels are so many that they pass ``most_texts``, each gives
    fewer texts, but ``LEAST_TEXTS`` or all it has; labels for which that leaves no room, those with the fewest documents, aren't learned (the
    ``most_texts`` / ``LEAST_TEXTS`` commonest are), so the driver's share is bounded however many labels there are. None without labelled rows.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~is_held_out())
    commonest = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, most_texts // LEAST_TEXTS))
    counts = {r["lang"]: r["n"] for r in commonest.collect()}
    if not counts:
        return None
    per_lang = min(per_lang, max(LEAST_TEXTS, most_texts // len(counts)))
    shares = session_of(docs).createDataFrame([(k, min(1.0, per_lang / n)) for k, n in sorted(counts.items())], "lang string, share double")
    unit = F.pmod(F.xxhash64("doc_id", F.lit("pick")), F.lit(1 << 30)) / float(1 << 30)
    sample_rows = labelled.join(F.broadcast(shares), "lang").where(unit < F.col("share"))
    room = F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("doc_id", F.lit("place")), room) + 1).cast("int")
    rows = sample_rows.select("doc_id", F.substring(F.col("text"), at, F.lit(sample_chars)).alias("text"), "lang")
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    return train([(r["text"], r["lang"]) for r in picked])


def predict(docs: DataFrame, net: ByteNet | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs, then the language and its score: the mean of log probabilities over all windows of the whole text.

    ``und`` with score 1 where the text is null or has no letter, and 0 where nothing was learned. The two columns are ``lang_pred`` and
    ``score``, with underscores added where ``keep`` has such names; kept columns may have any name.
    """
    shared = session_of(docs).sparkContext.broadcast((net.langs, net.filters, net.out, net.bias) if net else None)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ByteNet(*shared.value).prepare() if shared.value else None
        for texts in batches:
            preds, scores = [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                if not text or not LETTER.search(text):
                    preds.append("und")
                    scores.append(1.0)
                    continue
                if own is None:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                data = windows_of(text)
                total = sum(own.log_probabilities(data[k : k + 32]).sum(axis=0) for k in range(0, len(data), 32)) / len(data)
                p = np.exp(total - total.max())
                best = int(total.argmax())
                preds.append(own.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.StructArray.from_arrays([pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return frugal(run)(batches)

    # the text alone goes to Python; once, as it is not to be done again for a filter
    udf = F.arrow_udf(task, "lang_pred string, score double").asNondeterministic()
    both = free_name("found", keep)
    known = docs.select(*[f"`{c}`" for c in keep], udf("text").alias(both))
    return known.select(*[f"`{c}`" for c in keep], *[F.col(both)[c].alias(free_name(c, keep)) for c in ("lang_pred", "score")])


def identify_language(docs: DataFrame, **options) -> DataFrame:
    """Language of every whole text: doc_id, held_out, lang_pred, score.

    Learns from text and lang of rows whose crc32(doc_id as text) mod 3 is not 1, and predicts from text alone. Null text, or one
    without a letter: ``und``. Null doc_id hashes as the empty string. Repeated rows give repeated rows. No labelled
    row, or an empty table: every prediction is ``und``. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    net = fit(rows, **options)
    return predict(rows.withColumn("held_out", is_held_out()), net, ["doc_id", "held_out"])
