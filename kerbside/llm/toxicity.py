"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a hashed word embedding beside the mean of hashed character n-gram embeddings (so that inflected and
decorated forms resemble their stem). Two GRUs read windows of WINDOW words; attention pools their states into a logit.
Windows overlap by half and cover the whole text. A text's score is a logistic of four sums over its windows' logits (the
largest, the mean of the five largest, how many say so, and what share of all), fitted on training texts that the network hasn't seen:
one telling word may stand in a clean text, and several of them don't.

The network is trained in numpy on the driver, on at most SAMPLE labelled rows of each class (the bound is the
parameter `sample`; rows are taken in the order of a hash of their id). Labels are of whole texts: in a toxic one the
windows with the most telling n-grams, later those that the network scores highest, stand for the label.

Edge cases: a null or empty text is one empty window with a score of its own (0 to 1); null ids are scored and held out
as the text "" would be; repeated rows get equal scores; without labelled rows of both classes every score is the share
of toxic labels, smoothed; labels that are null don't count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import common as C

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 12, 8, 16
ROWS = 1 << 15
NGRAMS = (3, 4, 5)
SAMPLE = 2000
EPOCHS, BATCH = 8, 128
#: Windows that stand for a toxic text, and one training text in so many that the network doesn't see: the last line is fitted on these.
TELLING, UNSEEN = 3, 4
#: What a false alarm costs by a miss, where both labels are equally frequent.
CLEAN = 2.0
#: An n-gram that so many texts have counts half.
RARE = 10
FOLDS = 5


def ngrams(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the n-gram table of words, each between two marks, and bounds."""
    edge = np.concatenate(([0], np.cumsum(sizes + 2)))
    padded = np.zeros(edge[-1], np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[edge[:-1][owner] + 1 + inner] = data[starts[owner] + inner]
    word_of = np.repeat(np.arange(len(sizes)), sizes + 2)
    rows, owners = [], []
    for size in NGRAMS:
        h = np.full(max(len(padded) - size + 1, 0), size, np.uint64)
        for j in range(size):
            h = h * np.uint64(C.BASE) + padded[j : j + len(h)] + np.uint64(1)
        inside = np.flatnonzero(word_of[: len(h)] == word_of[size - 1 : size - 1 + len(h)])
        rows.append((C.mix(h[inside]) % np.uint64(ROWS)).astype(np.int32))
        owners.append(word_of[inside].astype(np.int32))
    owners, rows = np.concatenate(owners), np.concatenate(rows)
    order = np.argsort(owners, kind="stable")
    return rows[order], np.searchsorted(owners[order], np.arange(len(sizes) + 1))


def picked(values: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows, with new bounds."""
    n = np.diff(bounds)[rows]
    new = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(new[-1], values.dtype)
    for first in range(0, len(rows), 16384):  # bounded index arrays
        a, b = new[first], new[min(first + 16384, len(rows))]
        part = slice(first, first + 16384)
        out[a:b] = values[np.arange(a, b) + np.repeat(bounds[rows[part]] - new[:-1][part], n[part])]
    return out, new


class Vocabulary:
    """The distinct words of some texts: their rows in the word table and, as bounds and rows, in the n-gram table.

    Texts are taken in chunks, so that it holds little more than the words themselves.
    """

    def __init__(self, column):
        hashes, bounds, unique, rows, sizes, base = [], [np.zeros(1, np.int64)], [], [], [], 0
        for _, _, data, offsets in C.chunks(column, C.CHUNK_BYTES // 2):
            data = C.LOWER[data]
            starts, ends, own = C.words(data, offsets)
            hashed = C.slice_hash(C.prefix_hash(data), starts, ends)
            seen, at = np.unique(hashed, return_index=True)
            g, b = ngrams(data, starts[at], ends[at] - starts[at])
            hashes.append(hashed)
            bounds.append(own[1:] + base)
            unique.append(seen)
            rows.append(g)
            sizes.append(np.diff(b))
            base += len(hashed)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.bounds = np.concatenate(bounds)
        found, at = np.unique(join(unique, np.uint64), return_index=True)
        all_bounds = np.concatenate(([0], np.cumsum(join(sizes, np.int64)))).astype(np.int64)
        self.gram_rows, self.gram_bounds = picked(join(rows, np.int32), all_bounds, at)
        self.word_rows = (found % np.uint64(ROWS)).astype(np.int64)
        self.index = np.searchsorted(found, join(hashes, np.uint64)).astype(np.int32)

    def part(self, words: np.ndarray) -> Vocabulary:
        """Only some words; no texts."""
        out = Vocabulary.__new__(Vocabulary)
        out.word_rows = self.word_rows[words]
        out.gram_rows, out.gram_bounds = picked(self.gram_rows, self.gram_bounds, words)
        return out

    def pooled(self, table: np.ndarray, block: int = 16384) -> np.ndarray:
        """The mean of each word's n-gram rows (every word has one: its marks and a letter)."""
        out = np.zeros((len(self.word_rows), table.shape[1]), np.float32)
        for first in range(0, len(out), block):
            b = self.gram_bounds[first : first + block + 1]
            out[first : first + block] = np.add.reduceat(table[self.gram_rows[b[0] : b[-1]]], b[:-1] - b[0], axis=0) / np.diff(b)[:, None]
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word places (windows x WINDOW, padded with the last word), lengths, and bounds of each text's windows."""
        n = np.diff(self.bounds)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        bounds = np.concatenate(([0], np.cumsum(count)))
        k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
        first = np.repeat(self.bounds[:-1], count) + k * STRIDE
        length = np.clip(np.repeat(self.bounds[1:], count) - first, 0, WINDOW)
        places = first[:, None] + np.minimum(np.arange(WINDOW), np.maximum(length - 1, 0)[:, None])
        return np.minimum(places, max(len(self.index) - 1, 0)), length, bounds


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"words": 0.1 * draw(ROWS, WORD_DIM), "grams": 0.1 * draw(ROWS, CHAR_DIM)}
    for d in "fb":
        p |= {f"W{d}": draw(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"U{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"attend": draw(2 * HIDDEN, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}


def recur(x: np.ndarray, live: np.ndarray, u: np.ndarray, steps: range) -> tuple[np.ndarray, list]:
    """One GRU over projected inputs (windows, time, 3 x HIDDEN); its states and what the way back needs. A step beyond a window's length changes nothing."""
    h = np.zeros((len(x), HIDDEN), np.float32)
    states, kept = np.empty((len(x), WINDOW, HIDDEN), np.float32), []
    for t in steps:
        hu = h @ u
        g = sigmoid(x[:, t, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        m = np.tanh(x[:, t, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        kept.append((t, h, z, r, m, hu[:, 2 * HIDDEN :]))
        new = m + z * (h - m)
        h = new if live[:, t].all() else np.where(live[:, t, None], new, h)
        states[:, t] = h
    return states, kept


def recur_back(d_states: np.ndarray, kept: list, live: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    dx, du, dh = np.zeros((len(d_states), WINDOW, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((len(d_states), HIDDEN), np.float32)
    for t, h, z, r, m, hn in reversed(kept):
        dh = dh + d_states[:, t]
        on = live[:, t, None]
        d = np.where(on, dh, 0)
        dm = d * (1 - z) * (1 - m * m)
        dz = d * (h - m) * z * (1 - z)
        dr = dm * hn * r * (1 - r)
        dx[:, t] = np.concatenate((dz, dr, dm), 1)
        dhu = np.concatenate((dz, dr, dm * r), 1)
        du += h.T @ dhu
        dh = np.where(on, d * z + dhu @ u.T, dh)
    return dx, du


def forward(p: dict, inputs: np.ndarray, index: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows. inputs: a row for each distinct word; index: windows x WINDOW."""
    live = np.arange(WINDOW) < length[:, None]
    states, kept = [], {}
    for d, steps in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        projected = inputs @ p[f"W{d}"] + p[f"c{d}"] if len(inputs) else np.zeros((1, 3 * HIDDEN), np.float32)
        s, kept[d] = recur(projected[index], live, p[f"U{d}"], steps)
        states.append(s)
    h = np.concatenate(states, 2)
    e = np.where(live, h @ p["attend"], -1e9)
    e = np.exp(e - e.max(1, keepdims=True)) * live
    a = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
    pooled = np.einsum("ntk,nt->nk", h, a)
    return pooled @ p["out"] + p["bias"][0], (live, kept, h, a, pooled)


def summed(rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of their gradients."""
    order = np.argsort(rows, kind="stable")
    used, first = np.unique(rows[order], return_index=True)
    return used, np.add.reduceat(d[order], first, axis=0)


def gradients(p: dict, inputs: np.ndarray, index: np.ndarray, memory: tuple, d_logit: np.ndarray) -> dict[str, np.ndarray]:
    live, kept, h, a, pooled = memory
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    da = np.einsum("ntk,nk->nt", h, d_pooled)
    de = a * (da - (a * da).sum(1, keepdims=True))
    g["attend"] = np.einsum("ntk,nt->k", h, de)
    dh = a[:, :, None] * d_pooled[:, None, :] + de[:, :, None] * p["attend"]
    d_inputs = np.zeros_like(inputs)
    for k, d in enumerate("fb"):
        dx, g[f"U{d}"] = recur_back(dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], kept[d], live, p[f"U{d}"])
        flat = dx.reshape(-1, 3 * HIDDEN)
        by_word = np.zeros((len(inputs), 3 * HIDDEN), inputs.dtype)
        used, total = summed(index.ravel(), flat)
        by_word[used] = total
        g[f"c{d}"] = flat.sum(0)
        g[f"W{d}"] = inputs.T @ by_word
        d_inputs += by_word @ p[f"W{d}"].T
    g["inputs"] = d_inputs
    return g


def embed(p: dict, v: Vocabulary) -> np.ndarray:
    return np.concatenate((p["words"][v.word_rows], v.pooled(p["grams"])), 1)


def log_odds(v: Vocabulary, toxic: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each n-gram row by the texts that have it, drawn to 0 where these are few: else rare n-grams would say most."""
    seen = np.zeros((2, ROWS))
    n_grams = np.diff(v.gram_bounds)
    for label in (0, 1):
        for t in np.flatnonzero(toxic == label).tolist():
            own = np.unique(v.index[v.bounds[t] : v.bounds[t + 1]])
            at = np.repeat(v.gram_bounds[own], n_grams[own]) + (np.arange(n_grams[own].sum()) - np.repeat(np.cumsum(n_grams[own]) - n_grams[own], n_grams[own]))
            seen[label, np.unique(v.gram_rows[at])] += 1
    share = (seen + 0.5) / (np.array([[np.sum(toxic == 0)], [np.sum(toxic == 1)]]) + 1)
    return (np.log(share[1] / share[0]) * (seen.sum(0) / (seen.sum(0) + RARE))).astype(np.float32)


def summary(logit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four sums over each text's windows (every text has one)."""
    text = C.rows_of(bounds)
    by = np.lexsort((-logit, text))
    rank = np.arange(len(by)) - bounds[:-1][text[by]]
    first = np.where(rank < 5, logit[by], 0.0)
    n = np.diff(bounds)
    says = np.add.reduceat(sigmoid(logit.astype(np.float64)), bounds[:-1])
    return np.column_stack((np.maximum.reduceat(logit, bounds[:-1]), np.add.reduceat(first, bounds[:-1]) / np.minimum(n, 5), np.log1p(says), np.sqrt(says / n)))


def fitted(x: np.ndarray, y: np.ndarray, shrink: float = 1e-3) -> np.ndarray:
    """Weights and shift of a logistic that takes the label 0 as CLEAN times as frequent as 1, by Newton's steps."""
    z = np.column_stack((x, np.ones(len(x))))
    weight = np.where(y == 1, 1 / max(1, (y == 1).sum()), CLEAN / max(1, (y == 0).sum())) / (1 + CLEAN)
    w = np.zeros(z.shape[1])
    for _ in range(50):
        q = sigmoid(z @ w)
        h = (z * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ z + shrink * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, z.T @ (weight * (y - q)) - shrink * w), -2, 2)
    return w


def train(texts, toxic: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """The network's weights, and those of the line over a text's windows."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    kept = np.ones(len(toxic), bool)
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        if len(own) >= 4 * UNSEEN:
            kept[own[::UNSEEN]] = False
    rest = np.flatnonzero(~kept) if not kept.all() else np.arange(len(toxic))
    p = network(texts.take(pa.array(np.flatnonzero(kept))), toxic[kept], seed)
    p["line"] = fitted(summary(*window_logits(p, texts.take(pa.array(rest)))), toxic[rest])
    return p


def network(texts, toxic: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    p, rng = initial(seed), np.random.default_rng(seed)
    v = Vocabulary(texts)
    places, length, bounds = v.windows()
    index = v.index[places] if len(v.index) else places
    del places
    length = length.astype(np.int32)
    odds = log_odds(v, toxic)
    p["grams"][:, 0] = 0.5 * odds
    text = C.rows_of(bounds)
    # what a window's most telling word says, until the network can
    best = v.pooled(odds[:, None])[:, 0] if len(v.word_rows) else np.zeros(1, np.float32)
    hint = np.where(np.arange(WINDOW) < length[:, None], best[index], -9).max(1)
    dense = [k for k in p if k not in ("words", "grams")]
    m1, m2 = {k: np.zeros_like(p[k]) for k in dense}, {k: np.zeros_like(p[k]) for k in dense}
    grown = {k: np.full(ROWS, 1e-3, np.float32) for k in ("words", "grams")}
    step = 0

    def top(scores: np.ndarray, texts: np.ndarray, n: int = 1) -> np.ndarray:
        order = np.lexsort((-scores, text))
        first = order[np.arange(len(order)) - bounds[:-1][text[order]] < n]
        return first[np.isin(text[first], texts)]

    yes, no = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    for epoch in range(EPOCHS):
        if epoch in (3, 6):
            hint = logits(p, embed(p, v), index, length)
        chosen = top(hint, yes, TELLING)
        hard = top(hint, no)
        random = rng.choice(np.flatnonzero(np.isin(text, no)), size=len(no))
        batchable = np.concatenate((np.repeat(chosen, max(1, len(no) // max(1, len(chosen)) // 2)), hard, random))
        rng.shuffle(batchable)
        for first in range(0, len(batchable), BATCH):
            own = batchable[first : first + BATCH]
            # only this batch's words
            words, local = np.unique(index[own], return_inverse=True)
            local = local.reshape(index[own].shape)
            sub = v.part(words)
            counts = np.diff(sub.gram_bounds)
            inputs = embed(p, sub)
            logit, memory = forward(p, inputs, local, length[own])
            g = gradients(p, inputs, local, memory, ((sigmoid(logit) - toxic[text[own]]) / len(own)).astype(np.float32))
            step += 1
            for k in dense:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            for k, rows, d in (("words", sub.word_rows, g["inputs"][:, :WORD_DIM]), ("grams", sub.gram_rows, np.repeat(g["inputs"][:, WORD_DIM:] / counts[:, None], counts, axis=0))):
                used, total = summed(rows, d)
                grown[k][used] += (total**2).mean(1)
                p[k][used] -= 0.05 * total / np.sqrt(grown[k][used])[:, None]
    return p


def logits(p: dict, inputs: np.ndarray, index: np.ndarray, length: np.ndarray, block: int = 1024) -> np.ndarray:
    """Logits of windows without what training keeps: both directions by blocks, attention pooled as the states come."""
    out = np.empty(len(index), np.float32)
    projected = {d: (inputs @ p[f"W{d}"] + p[f"c{d}"] if len(inputs) else np.zeros((1, 3 * HIDDEN), np.float32)) for d in "fb"}
    for first in range(0, len(index), block):
        own, n = index[first : first + block], length[first : first + block]
        live = np.arange(WINDOW) < n[:, None]
        full = bool(live.all())
        states = np.empty((len(own), WINDOW, 2 * HIDDEN), np.float32)
        for k, (d, steps) in enumerate((("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1)))):
            h = np.zeros((len(own), HIDDEN), np.float32)
            x, u = projected[d], p[f"U{d}"]
            for t in steps:
                xt, hu = x[own[:, t]], h @ u
                g = xt[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
                g *= 0.5
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
                m = np.tanh(xt[:, 2 * HIDDEN :] + g[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
                new = m + g[:, :HIDDEN] * (h - m)
                h = new if full else np.where(live[:, t, None], new, h)
                states[:, t, k * HIDDEN : (k + 1) * HIDDEN] = h
        e = states @ p["attend"]
        if not full:
            e = np.where(live, e, -1e9)
        e = np.exp(e - e.max(1, keepdims=True)) * live
        e /= np.maximum(e.sum(1, keepdims=True), 1e-9)
        out[first : first + block] = ((states @ p["out"]) * e).sum(1) + p["bias"][0]
    return out


def window_logits(p: dict, texts) -> tuple[np.ndarray, np.ndarray]:
    """The logits of all windows of the texts, and each text's bounds."""
    v = Vocabulary(texts)
    places, length, bounds = v.windows()
    index = v.index[places] if len(v.index) else places
    return logits(p, embed(p, v), index, length), bounds


def scores(p: dict, texts) -> np.ndarray:
    """The score of each whole text."""
    if not len(texts):
        return np.zeros(0)
    x = summary(*window_logits(p, texts))
    return sigmoid(x @ p["line"][:-1] + p["line"][-1])


def fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Texts and labels of at most `sample` training rows of each class."""
    known = C.with_defaults(labels, doc_id="bigint", toxic="int").where("doc_id is not null and toxic in (0, 1)").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    rows = docs.join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("text", "toxic").orderBy(F.xxhash64("text")).toArrow()  # 2 x sample rows at most
    return rows["text"], np.asarray(rows["toxic"]).astype(np.int64)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    own = C.with_defaults(docs, doc_id="bigint", text="string")
    texts, toxic = labelled_sample(own, labels, sample)
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    weights = train(texts, toxic) if 0 < toxic.sum() < len(toxic) else None
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = batch.column(1)
            found = [scores(p, texts.slice(a, b - a)) if p else np.full(b - a, share) for a, b, _, _ in C.chunks(texts, C.CHUNK_BYTES // 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    scored = own.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
