"""Operator 11, language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forward and backward, and labels every position with a distribution
over the languages, from the states of both directions there; a document's distribution is the mean over its positions.
Whole texts are read: a long text has as many windows as it takes. The network is trained in numpy by backpropagation
through time on a bounded sample of labelled excerpts, drawn evenly from the languages by a hash, and is then broadcast
(some tens of kilobytes). Windows of equal length are stepped through side by side, so a step is one small matrix product
for thousands of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import tidy

#: Bytes of a window, hidden units of a direction, excerpts of the training sample over all languages, characters of an excerpt.
WINDOW, HIDDEN, SAMPLE, EXCERPT = 64, 8, 2048, 512
#: Windows that are stepped through side by side in a task.
BATCH = 1024
#: Steps of training, windows of a step, and the rate of the first one.
STEPS, STEP_WINDOWS, RATE = 450, 128, 0.02
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions at index 0 (forward) and 1 (backward); gates in the order update, reset, candidate.

    ``table`` (2, 3 hidden, 257) has each byte's share of the gates (256 pads a window), ``inner`` (2, 3 hidden, hidden) the
    state's share, ``bias`` (2, hidden) that of the candidate's inner share; ``out`` (2, languages, hidden) and ``out_bias``
    make the labels. Windows are the last axis of all arrays, so that each gate is one piece of memory.
    """

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias]


def new_network(languages: list[str], hidden: int, seed: int) -> Network:
    r, near = np.random.default_rng(seed), 1 / np.sqrt(hidden)
    draw = lambda *shape: r.uniform(-near, near, shape).astype(np.float32)
    return Network(languages, draw(2, 3 * hidden, 257), draw(2, 3 * hidden, hidden), np.zeros((2, hidden), np.float32), draw(2, len(languages), hidden), np.zeros(len(languages), np.float32))


def forward(net: Network, bytes_: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (2, length, hidden, windows) after each byte of ``bytes_`` (length, windows), the backward ones at their own places.

    A pad (256) leaves the state as it is, so a window shorter than the others has the states that it would have alone.
    With ``keep``, also what backpropagation needs of each step.
    """
    length, n = bytes_.shape
    hidden = net.inner.shape[2]
    states, kept = np.empty((2, length, hidden, n), np.float32), []
    padded, bias = bool((bytes_ == 256).any()), net.bias[:, :, None]
    for d in (0, 1):
        h = np.zeros((hidden, n), np.float32)
        x, g = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            now = bytes_[t]
            np.take(net.table[d], now, axis=1, out=x, mode="clip")
            np.matmul(net.inner[d], h, out=g)
            zr = x[: 2 * hidden]
            zr += g[: 2 * hidden]
            zr *= 0.5  # the logistic function, by the hyperbolic tangent of half
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, c, inner = x[:hidden], x[hidden : 2 * hidden], x[2 * hidden :], g[2 * hidden :]
            inner += bias[d]
            if keep:
                inner_before = inner.copy()
            inner *= r
            c += inner
            np.tanh(c, out=c)
            if padded:  # the update gate of a pad is closed
                z[:, now == 256] = 1
            if keep:
                kept.append((d, t, now, h, z.copy(), r.copy(), c.copy(), inner_before))
            h = np.subtract(h, c, out=states[d, t])
            h *= z
            h += c
    return states, kept


def label(net: Network, states: np.ndarray) -> np.ndarray:
    """(length, languages, windows): the distribution at each position."""
    y = np.matmul(net.out[0], states[0])
    y += np.matmul(net.out[1], states[1])
    y += net.out_bias[:, None]
    y -= y.max(axis=1, keepdims=True)
    np.exp(y, out=y)
    y /= y.sum(axis=1, keepdims=True)
    return y


def gradients(net: Network, bytes_: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions that aren't pads, and its gradients in the order of ``weights``, through time."""
    length, n = bytes_.shape
    hidden = net.inner.shape[2]
    states, kept = forward(net, bytes_, keep=True)
    p = label(net, states)
    real = bytes_ != 256
    total = max(1, int(real.sum()))
    right = (target[None, :] == np.arange(len(net.languages))[:, None]).astype(np.float32)
    loss = -float((np.log((p * right).sum(axis=1) + 1e-9) * real).sum()) / total
    dy = (p - right) * (real[:, None, :] / np.float32(total))
    d_out = np.stack([np.matmul(dy, states[d].transpose(0, 2, 1)).sum(axis=0) for d in (0, 1)])
    d_states = [np.matmul(net.out[d].T, dy) for d in (0, 1)]
    d_table, d_inner, d_bias = (np.zeros_like(w) for w in net.weights()[:3])
    dh = [np.zeros((hidden, n), np.float32) for _ in (0, 1)]
    for d, t, now, before, z, r, c, inner in reversed(kept):
        dh[d] = dh[d] + d_states[d][t]
        to_c = dh[d] * (1 - z) * (1 - c * c)
        to_z = dh[d] * (before - c) * z * (1 - z)  # none at a pad, whose gate is 1
        to_r = to_c * inner * r * (1 - r)
        dg = np.concatenate([to_z, to_r, to_c * r])  # the candidate's inner share passes the reset gate
        d_inner[d] += dg @ before.T
        d_bias[d] += (to_c * r).sum(axis=1)
        d_table[d] += np.concatenate([to_z, to_r, to_c]) @ (now[:, None] == np.arange(257)).astype(np.float32)
        dh[d] = dh[d] * z + net.inner[d].T @ dg
    return loss, [d_table, d_inner, d_bias, d_out, dy.sum(axis=(0, 2))]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 42) -> Network:
    """Fit a network to windows (n, length) of bytes and the numbers of their languages, by Adam; the same for the same input.

    A step takes the next windows of a shuffled order, which begins anew as often as the steps need it.
    """
    net, r = new_network(languages, hidden, seed), np.random.default_rng(seed + 1)
    first, second = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()]
    order = np.concatenate([r.permutation(len(windows)) for _ in range(-(-steps * STEP_WINDOWS // len(windows)))])
    for step in range(1, steps + 1):
        chosen = order[(step - 1) * STEP_WINDOWS : step * STEP_WINDOWS]
        _, grads = gradients(net, np.ascontiguousarray(windows[chosen].T), target[chosen])
        norm, rate = np.sqrt(sum(float((g * g).sum()) for g in grads)), RATE * (1 - (step - 1) / steps)
        for w, g, m, v in zip(net.weights(), grads, first, second):
            g = g / max(norm, 1.0)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def windows_of(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """(windows, length): all bytes in order, the last window padded with 256."""
    b = np.frombuffer(raw, np.uint8).astype(np.int16)
    return np.pad(b, (0, -len(b) % length), constant_values=256).reshape(-1, length)


def _steps(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows, languages): the labels of each window summed over its positions."""
    out = np.empty((len(windows), len(net.languages)), np.float64)
    for a in range(0, len(windows), BATCH):
        b = np.ascontiguousarray(windows[a : a + BATCH].T)
        p = label(net, forward(net, b)[0])
        if (b == 256).any():
            p *= (b != 256)[:, None, :]
        out[a : a + BATCH] = p.sum(axis=0).T
    return out


def pooled(net: Network, texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """The mean distribution over all positions of each text, in order; windows of many texts are stepped through together.

    A text that fills a batch by itself is taken in parts, so memory is bounded by a batch and a text's own bytes.
    """
    waiting, held = [], 0

    def flush() -> Iterator[np.ndarray]:
        sums = _steps(net, np.concatenate([w for w, _ in waiting]))
        at = 0
        for w, size in waiting:
            yield sums[at : at + len(w)].sum(axis=0) / size
            at += len(w)

    for raw in texts:
        windows = windows_of(raw)
        if waiting and held + len(windows) > BATCH:
            yield from flush()
            waiting, held = [], 0
        waiting.append((windows, len(raw)))
        held += len(windows)
    if waiting:
        yield from flush()


def excerpts(docs: DataFrame, sample: int = SAMPLE, length: int = EXCERPT) -> list[tuple[str, str]]:
    """(language, excerpt) of at most ``sample`` rows of ``docs`` (id, text, lang), as many of each language, chosen by a hash.

    An excerpt begins anywhere in its text. The languages' rows are counted first, so that about four times the rows wanted of
    a language, those of the least hashes, are shuffled and ranked, however many rows it has.
    """
    size = F.char_length("text")
    docs = docs.filter(size > 0)
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    n = counts.limit(sample + 1).count()
    if n > sample:
        raise ValueError(f"more than {sample} languages: the sample has no room for one excerpt of each")
    each, top = sample // max(n, 1), 1 << 52
    below = counts.select("lang", F.least(F.lit(1.0), (4 * each + 50) / F.col("n")).alias("share"))  # no more rows than ``sample``
    place = F.xxhash64(F.lit(5), "id", "text")
    begin = 1 + F.pmod(place, F.greatest(size - length // 2, F.lit(1)))
    narrow = docs.select("lang", F.pmod(F.xxhash64(F.lit(6), "id", "text"), F.lit(top)).alias("o"), F.substring("text", begin.cast("int"), F.lit(length)).alias("t"))
    narrow = narrow.join(F.broadcast(below), "lang").filter(F.col("o") < F.col("share") * top)
    order = W.partitionBy("lang").orderBy("o", "t")
    best = narrow.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each)
    return [(r.lang, r.t) for r in best.orderBy("lang", "k").collect()]  # at most ``sample``


def fit(docs: DataFrame, sample: int = SAMPLE, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 42) -> Network | None:
    """A network for the languages of ``docs`` (id, text, lang), all labelled; None where there is nothing to learn from."""
    drawn = excerpts(docs, sample)
    languages = sorted({lang for lang, _ in drawn})
    if not languages:
        return None
    cut = [(windows_of(t.encode("utf-8", "surrogatepass")), languages.index(lang)) for lang, t in drawn]
    return train(np.concatenate([w for w, _ in cut]), np.concatenate([np.full(len(w), k) for w, k in cut]), languages, hidden, steps, seed)


def held_out(id_col: Column) -> Column:
    """A third of the ids, by CRC-32 of the id as text; a null id is the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def predict(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs``, with lang_pred and score (the share of the most probable language, ties to the first).

    A text that is null or has no letter is ``und`` with a score of 0, as is every text where there is no network.
    """
    if taken := {c.lower() for c in keep} & {"lang_pred", "score"}:
        raise ValueError(f"columns named like results must not be in keep: {sorted(taken)}")
    names = [f"in_{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            t = b.column(len(names))
            read = np.flatnonzero(t.is_valid().to_numpy(zero_copy_only=False)) if net else np.zeros(0, int)
            lang, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            for i, p in zip(read, pooled(net, (t[int(i)].as_py().encode("utf-8", "surrogatepass") for i in read))):
                # The last digits depend on which windows are stepped through together.
                lang[i], score[i] = net.languages[int(p.argmax())], min(1.0, round(float(p.max()), 5))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    kept = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(keep, names))
    out = src.mapInArrow(tidy(run), f"{kept}lang_pred string, score double")
    return out.withColumnsRenamed(dict(zip(names, keep)))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learnt from the rows that aren't held out and have a language.

    Rows are predicted from their text alone. Rows without a language or with an empty text teach nothing; repeated rows
    teach each; an empty table gives an empty result. The sample is bounded by ``sample`` excerpts of 512 characters over
    all languages; more languages than that raise ValueError. Other columns play no part.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    net = fit(src.filter(~held_out(F.col("id")) & F.col("lang").isNotNull()), sample, seed=seed)
    out = predict(src.withColumn("out", held_out(F.col("id"))), net, ["id", "out"])
    return out.select(F.col("id").alias("doc_id"), F.col("out").alias("held_out"), "lang_pred", "score")
