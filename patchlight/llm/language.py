"""Language identification by a byte convolutional network, trained in numpy and applied to windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext as vt
from .sample import drawn, unused

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """Bounds of training and the shape of the network."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 8
    embedding: int = 8
    #: At most so many labelled documents of each language, and windows of each document, evenly spread.
    docs_each: int = 300
    windows_each: int = 4
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    seed: int = 7


@dataclass
class Network:
    """Embedding, one bank of filters per width (as columns over the widest window), max pooling and softmax."""

    settings: Settings
    languages: list[str]
    embed: np.ndarray
    bank: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    mask: np.ndarray = field(repr=False)

    @classmethod
    def fresh(cls, settings: Settings, languages: list[str]) -> Network:
        rng = np.random.default_rng(settings.seed)
        e, most, f = settings.embedding, max(settings.widths), settings.filters
        mask = np.concatenate([np.repeat((np.arange(most * e) < w * e)[:, None], f, 1) for w in settings.widths], 1).astype(np.float32)
        bank = rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask
        dense = rng.normal(0, 0.3, (mask.shape[1], len(languages))).astype(np.float32)
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(settings, languages, rng.normal(0, 0.5, (256, e)).astype(np.float32), bank, zeros(mask.shape[1]), dense, zeros(len(languages)), mask)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Activations at every place, (windows, places, filters), and the unfolded bytes that they are made of."""
        most, e = max(self.settings.widths), self.settings.embedding
        held = self.embed[windows]
        n, places = len(windows), windows.shape[1] - most + 1
        unfolded = np.empty((n, places, most * e), np.float32)
        for k in range(most):
            unfolded[:, :, k * e : (k + 1) * e] = held[:, k : k + places]
        return (unfolded.reshape(-1, most * e) @ self.bank).reshape(n, places, -1), unfolded

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), 64):
            top = np.maximum(self.pooled(windows[i : i + 64])[0].max(1) + self.bias, 0)
            z = top @ self.dense + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + 64] = z / z.sum(1, keepdims=True)
        return out


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], settings: Settings) -> Network:
    """Fit by Adam on the cross-entropy, each language weighing the same."""
    net, rng = Network.fresh(settings, languages), np.random.default_rng(settings.seed + 1)
    weight = (1.0 / np.maximum(np.bincount(target, minlength=len(languages)), 1))[target]
    weight = (weight / weight.mean()).astype(np.float32)
    names = ("embed", "bank", "bias", "dense", "offset")
    moments = {n: (np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))) for n in names}
    step, most, e = 0, max(settings.widths), settings.embedding
    for _ in range(settings.epochs):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), settings.batch):
            at = order[i : i + settings.batch]
            x, n = windows[at], len(at)
            active, unfolded = net.pooled(x)
            place = active.argmax(1)
            before = np.take_along_axis(active, place[:, None, :], 1)[:, 0] + net.bias
            top = np.maximum(before, 0)
            z = top @ net.dense + net.offset
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            p[np.arange(n), target[at]] -= 1
            d = p * weight[at][:, None] / n
            d_top = (d @ net.dense.T) * (before > 0)
            seen = unfolded[np.arange(n)[:, None], place]  # (windows, filters, most * e)
            grads = {"dense": top.T @ d, "offset": d.sum(0), "bias": d_top.sum(0), "bank": np.einsum("nf,nfk->kf", d_top, seen) * net.mask}
            back = (d_top[:, :, None] * net.bank.T[None]).reshape(n, -1, most, e)
            which = x[np.arange(n)[:, None, None], place[:, :, None] + np.arange(most)]
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], which.ravel(), back.reshape(-1, e))
            step += 1
            for name in names:
                m, v = moments[name]
                m += 0.1 * (grads[name] - m)
                v += 0.001 * (grads[name] ** 2 - v)
                getattr(net, name)[...] -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as windows of equal length, the last of each filled up with zeros; the text and the bytes of each."""
    sizes = np.diff(offsets)
    each = -(-sizes // window)
    of = np.repeat(np.arange(len(sizes)), each)
    first = np.concatenate([[0], np.cumsum(each)])[:-1]
    begin = (np.arange(len(of)) - first[of]) * window
    out = np.zeros(len(of) * window, np.uint8)
    where = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + np.repeat(first * window, sizes)
    out[where] = data
    return out.reshape(-1, window), of, np.minimum(sizes[of] - begin, window)


def _sample(labelled: DataFrame, settings: Settings) -> tuple[np.ndarray, list[str]]:
    """Windows of the sampled documents, and the language of each."""
    named = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = drawn(named.filter(F.col("doc_id").isNotNull()), "lang", settings.docs_each)
    texts = named.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).select("lang", "text")
    window, most = settings.window, settings.windows_each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = vt.text_bytes(batch.column(1))
            for i, j in vt.slices(offsets):
                cuts, of, _ = cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], window)
                n = np.bincount(of, minlength=j - i)
                k = np.arange(len(of)) - (np.cumsum(n) - n)[of]
                keep = (k * most // n[of] != (k - 1) * most // n[of]) | (k == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[keep] + i)), pa.array([w.tobytes() for w in cuts[keep]], pa.binary())], ["lang", "window"])

    table = texts.mapInArrow(run, "lang string, window binary").toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    return np.frombuffer(b"".join(table["window"].to_pylist()), np.uint8).reshape(-1, window), table["lang"].to_pylist()


def identify(docs: DataFrame, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Predict the language of every text of ``docs``: its columns, then ``lang_pred`` and ``score``.

    ``labelled`` (``doc_id``, ``text``, ``lang``) teaches: of each language a bounded number of documents, drawn by the hash of
    their ids. A text is judged whole: its windows' probabilities are averaged by their bytes, and ``score`` is that of the
    best language (ties: the first by name).

    A null text or one without a letter is ``und`` with score 0, and so is every text if nothing is labelled. Repeated rows are
    judged alike; an empty table gives an empty result; columns named ``lang_pred`` or ``score`` are replaced.
    """
    windows, named = _sample(labelled, settings)
    languages = sorted(set(named))
    net = train(windows, np.searchsorted(languages, named), languages, settings) if languages else None
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    ready = kept.withColumn(unused("letter", kept.columns), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names, at = kept.columns, kept.columns.index("text")
    size = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            n, letter = batch.num_rows, batch.column(size).to_numpy(zero_copy_only=False)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if net:
                data, offsets = vt.text_bytes(batch.column(at))
                for i, j in vt.slices(offsets, 1 << 19):
                    cuts, of, held = cut(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], net.settings.window)
                    if len(of):
                        p = net.probabilities(cuts) * held[:, None]
                        total = np.zeros((j - i, p.shape[1]))
                        np.add.at(total, of, p)
                        total /= np.maximum(np.bincount(of, held, j - i), 1)[:, None]
                        best[i:j], score[i:j] = total.argmax(1), total.max(1)
            known = letter & (net is not None)
            found = pa.array(net.languages if net else [UNDETERMINED]).take(pa.array(best))
            pred = pc.if_else(pa.array(known), found, pa.scalar(UNDETERMINED))
            yield pa.RecordBatch.from_arrays([*batch.columns[:size], pred, pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], [*names, "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return ready.mapInArrow(run, schema)
