"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Each step of a window takes what tables of fixed size know of a word (its smoothed log-odds to stand in documents
labelled 1, and how often it was seen) and of its character n-grams (mean, highest and lowest log-odds); two gated
recurrent units read the window from both ends, attention pools their states, and a linear layer gives the window's
score. A document's score is a logistic curve over its worst window, the mean of its worst few, and the number of its
windows, which overlap by half and cover the whole text.

Training knows labels of documents only. Round by round, the network learns from each document's currently worst
windows, seen through tables that were filled without the document's part of the sample, as it will see new texts.
One fold of the training rows is held back from all of this and calibrates the scores.

The sample is bounded by ``MOST_PER_CLASS`` documents of either label and by ``MOST_BYTES`` of their texts, chosen by a
hash of their ids, so training costs the same on any input. Scoring is one narrow pass in Arrow batches; the model (MODEL_BYTES at most) is broadcast.

Defined results: null and empty texts score as a window without words; repeated rows score alike; an empty table gives
no rows; without both labels in the training fold there is nothing to learn from, and every text gets the smoothed share
of label 1 (below 0.5 without any label); null labels are not used; a document labelled twice counts with each label; of
texts that share a doc_id the first in byte order is learned from; further columns are left alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import cut, narrow_batches, release, released
from millrace.llm.tokens import slices

WINDOW, STRIDE = 32, 16
HIDDEN, INPUTS = 8, 5
WORD_SLOTS, CHAR_SLOTS = 1 << 15, 1 << 16
GRAMS = (3, 4, 5)
MOST_PER_CLASS = 1500
MOST_BYTES = 64 << 20
EPOCHS = 12
PARTS = 3
AT_ONCE = 4096
WORDS_AT_ONCE = 1 << 14
TOP, LEAST_TO_CALIBRATE = 3, 20
FOLDS, HELD_OUT, CALIBRATES = 5, 0, 1
MODEL_BYTES = 8 << 20
EDGES = ".,;:!?'\"()[]{}#$%&*|<>-–—…«»¡¿"


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts, the texts' offsets in them, and the distinct words (lower case, without signs at their ends)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    raw = lists.values.dictionary_encode()
    clean = pc.utf8_trim(pc.utf8_lower(raw.dictionary), EDGES).dictionary_encode()
    index = clean.indices.to_numpy(zero_copy_only=False)[raw.indices.to_numpy(zero_copy_only=False)]
    full = pc.binary_length(clean.dictionary).to_numpy(zero_copy_only=False)[index] > 0 if len(index) else np.zeros(0, bool)
    bounds = lists.offsets.to_numpy()
    ends = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
    return index[full].astype(np.int32), ends, clean.dictionary


def slots_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its slot, the slots of its character n-grams one after the other, and where each word's begin.

    Words are taken WORDS_AT_ONCE at a time, as their n-grams need many times their memory.
    """
    parts = [_slots_of(words.slice(a, WORDS_AT_ONCE)) for a in range(0, len(words), WORDS_AT_ONCE)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
    word, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    return word, grams, np.concatenate([[0], np.cumsum(counts)])


def _slots_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import pandas as pd

    n = len(words)
    hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    marked = [f"^{w}$".encode() for w in words.to_pylist()]
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, marked), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    word_of = np.repeat(np.arange(n, dtype=np.int32), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(raw))
    rolled, all_slots, owners = raw.copy(), [], []
    for k in range(1, max(GRAMS)):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + raw[k:] if len(rolled) > 1 else rolled[:0]
        if k + 1 in GRAMS:
            whole = left[: len(rolled)] > k
            spread = (rolled[whole] ^ (rolled[whole] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            all_slots.append(((spread >> np.uint64(40)) % np.uint64(CHAR_SLOTS)).astype(np.int32))
            owners.append(word_of[: len(rolled)][whole])
    owner, slots = np.concatenate(owners), np.concatenate(all_slots)
    order = np.argsort(owner, kind="stable")
    return (hashed % np.uint64(WORD_SLOTS)).astype(np.int32), slots[order], np.bincount(owner, minlength=n)


def window_rows(ends: np.ndarray, pad: int, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of word numbers (``pad`` behind short texts), the text of each, and how many words each holds."""
    n = np.diff(ends)
    many = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, 1)
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = ends[:-1][text] + np.minimum(k * STRIDE, np.maximum(n[text] - WINDOW, 0))
    held = np.minimum(n[text], WINDOW)
    padded = np.append(index, np.int32(pad)).astype(np.int32)
    rows = np.empty((len(text), WINDOW), np.int32)
    for a in range(0, len(text), AT_ONCE):
        at = start[a : a + AT_ONCE, None] + np.arange(WINDOW)
        inside = np.arange(WINDOW) < held[a : a + AT_ONCE, None]
        rows[a : a + AT_ONCE] = padded[np.where(inside, at, len(index))]
    return rows, text, held


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tables:
    """What labelled documents say of hashed words and character n-grams; empty tables know nothing."""

    def __init__(self):
        self.words = np.zeros((WORD_SLOTS, 2), np.float32)
        self.chars = np.zeros(CHAR_SLOTS, np.float32)

    @classmethod
    def filled(cls, words: tuple, index: np.ndarray, ends: np.ndarray, labels: np.ndarray, use: np.ndarray) -> Tables:
        """Tables from the documents marked in ``use``."""
        out = cls()
        n = {k: int((labels[use] == k).sum()) for k in (0, 1)}
        seen = {name: np.zeros((2, size), np.int64) for name, size in (("words", WORD_SLOTS), ("chars", CHAR_SLOTS))}
        for doc in np.flatnonzero(use):
            word = np.unique(index[ends[doc] : ends[doc + 1]])
            grams = _part_of(words, word)[1]
            seen["words"][labels[doc]][np.unique(words[0][word])] += 1
            seen["chars"][labels[doc]][np.unique(grams)] += 1
        out.words[:, 0] = _log_odds(seen["words"], n)
        out.words[:, 1] = np.log1p(seen["words"].sum(0)) / 5
        out.chars[:] = _log_odds(seen["chars"], n)
        return out

    def vectors(self, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Input vectors of words from their slots, and a row of zeros behind them for padding."""
        word, grams, begins = words
        out = np.zeros((len(word) + 1, INPUTS), np.float32)
        out[:-1, :2] = self.words[word]
        counts = np.diff(begins)
        some = np.flatnonzero(counts)
        if len(some):
            odds = self.chars[grams]
            out[some, 2] = np.add.reduceat(odds, begins[:-1][some]) / counts[some]
            out[some, 3] = np.maximum.reduceat(odds, begins[:-1][some])
            out[some, 4] = np.minimum.reduceat(odds, begins[:-1][some])
        return out


class Network:
    """The parameters, inference and training."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = INPUTS, HIDDEN

        def some(*shape: int, by: float) -> np.ndarray:
            return (r.standard_normal(shape) * by).astype(np.float32)

        self.p = {"attention": some(2 * h, by=0.3), "out": some(2 * h, by=0.3), "bias": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": some(d, 3 * h, by=0.4), f"u{side}": some(h, 3 * h, by=0.3), f"c{side}": np.zeros(3 * h, np.float32)}
        self.curve = np.array([1.0, 0.0, 0.0, 0.0])
        self.tables = Tables()
        self.constant: float | None = None

    def nbytes(self) -> int:
        return self.tables.words.nbytes + self.tables.chars.nbytes + sum(x.nbytes for x in self.p.values())

    def _states(self, table: np.ndarray, u: np.ndarray, index: np.ndarray, mask: np.ndarray | None, back: bool) -> np.ndarray:
        h2 = 2 * HIDDEN
        out = np.empty((WINDOW, len(index), HIDDEN), np.float32)
        h = np.zeros((len(index), HIDDEN), np.float32)
        steps = np.ascontiguousarray(index.T)
        for t in reversed(range(WINDOW)) if back else range(WINDOW):
            x = table.take(steps[t], axis=0)
            g = h @ u
            gates = x[:, :h2] + g[:, :h2]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            new = gates[:, :HIDDEN] * g[:, h2:]
            new += x[:, h2:]
            np.tanh(new, out=new)
            kept = h - new
            kept *= gates[:, HIDDEN:]
            kept += new
            h = kept if mask is None else np.where(mask[:, t : t + 1], kept, h)
            out[t] = h
        return out

    def logits(self, vectors: np.ndarray, index: np.ndarray, held: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """The score of each window, or of some; windows with padding are run apart from full ones."""
        h2 = 2 * HIDDEN
        tables, us = [], []
        for side in "fb":
            half = np.ones(3 * HIDDEN, np.float32)
            half[:h2] = 0.5
            tables.append(np.ascontiguousarray((vectors @ self.p[f"w{side}"] + self.p[f"c{side}"]) * half))
            us.append(self.p[f"u{side}"] * half)
        some = np.arange(len(index)) if some is None else some
        out = np.empty(len(some), np.float32)
        full = np.flatnonzero(held[some] == WINDOW)
        for rows in (full, np.flatnonzero(held[some] < WINDOW)):
            for a in range(0, len(rows), AT_ONCE):
                place = rows[a : a + AT_ONCE]
                part = some[place]
                mask = None if rows is full else np.arange(WINDOW) < held[part][:, None]
                both = [self._states(tables[i], us[i], index[part], mask, i == 1) for i in (0, 1)]
                v, w = self.p["attention"], self.p["out"]
                s = both[0] @ v[:HIDDEN] + both[1] @ v[HIDDEN:]
                if mask is not None:
                    s = np.where(mask.T, s, -1e9)
                e = np.exp(s - s.max(0))
                said = both[0] @ w[:HIDDEN] + both[1] @ w[HIDDEN:]
                if mask is not None:
                    said = np.where(held[part] > 0, said, 0)
                out[place] = (e * said).sum(0) / e.sum(0) + self.p["bias"][0]
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The calibrated score of each text."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        index, ends, names = words_of(texts)
        rows, owner, held = window_rows(ends, len(names), index)
        logits = self.logits(self.tables.vectors(slots_of(names)), rows, held)
        return _sigmoid(worst_windows(logits.astype(np.float64), owner, len(texts)) @ self.curve[:3] + self.curve[3])

    def gradients(self, x_all: np.ndarray, held: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the weighted log loss over windows of input vectors (windows, steps, inputs)."""
        p, h, n_windows = self.p, HIDDEN, len(x_all)
        mask = (np.arange(WINDOW) < held[:, None]).astype(np.float32)
        kept: dict[str, list] = {}
        states = np.zeros((n_windows, WINDOW, 2 * h), np.float32)
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            now = np.zeros((n_windows, h), np.float32)
            kept[side] = []
            for t in order:
                m = mask[:, t : t + 1]
                x = x_all[:, t] @ p[f"w{side}"] + p[f"c{side}"]
                g = now @ p[f"u{side}"]
                r, z = _sigmoid(x[:, :h] + g[:, :h]), _sigmoid(x[:, h : 2 * h] + g[:, h : 2 * h])
                n = np.tanh(x[:, 2 * h :] + r * g[:, 2 * h :])
                new = m * (n + z * (now - n)) + (1 - m) * now
                kept[side].append((t, now, r, z, n, g[:, 2 * h :]))
                states[:, t, h * (side == "b") : h * (side == "b") + h] = new
                now = new
        s = np.where(mask > 0, states @ p["attention"], -1e9)
        e = np.exp(s - s.max(1, keepdims=True)) * mask
        a = e / np.maximum(e.sum(1, keepdims=True), 1e-9)
        pooled = (a[:, :, None] * states).sum(1)
        error = ((_sigmoid(pooled @ p["out"] + p["bias"][0]) - target) * weight / weight.sum()).astype(np.float32)
        d_pool = error[:, None] * p["out"]
        d_a = (states * d_pool[:, None]).sum(2)
        d_s = a * (d_a - (a * d_a).sum(1, keepdims=True))
        d_states = a[:, :, None] * d_pool[:, None] + d_s[:, :, None] * p["attention"]
        out = {
            "out": pooled.T @ error,
            "bias": error.sum(keepdims=True),
            "attention": np.einsum("bt,bth->h", d_s, states),
        }
        for side in "fb":
            u = p[f"u{side}"]
            d_w, d_u, d_c = np.zeros_like(p[f"w{side}"]), np.zeros_like(u), np.zeros(3 * h, np.float32)
            d_h = np.zeros((n_windows, h), np.float32)
            for t, before, r, z, n, g_n in reversed(kept[side]):
                m = mask[:, t : t + 1]
                d_h = d_h + d_states[:, t, h * (side == "b") : h * (side == "b") + h]
                live = d_h * m
                d_n = live * (1 - z) * (1 - n * n)
                d_r = d_n * g_n * r * (1 - r)
                d_z = live * (before - n) * z * (1 - z)
                d_in = np.concatenate([d_r, d_z, d_n], 1)
                d_g = np.concatenate([d_r, d_z, d_n * r], 1)
                d_h = live * z + d_g @ u.T + d_h * (1 - m)
                d_u += before.T @ d_g
                d_w += x_all[:, t].T @ d_in
                d_c += d_in.sum(0)
            out |= {f"w{side}": d_w, f"u{side}": d_u, f"c{side}": d_c}
        return out


def _part_of(words: tuple, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of some of the words, in the form of :func:`slots_of`."""
    word, grams, begins = words
    counts = np.diff(begins)[some]
    ends = np.cumsum(counts)
    at = np.repeat(begins[:-1][some] - (ends - counts), counts) + np.arange(counts.sum())
    return word[some], grams[at], np.concatenate([[0], ends])


def _log_odds(seen: np.ndarray, n: dict[int, int]) -> np.ndarray:
    """Smoothed log-odds of each slot to occur in documents labelled 1, nearer 0 the fewer have it."""
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    return (odds * seen.sum(0) / (seen.sum(0) + 3)).clip(-3, 5).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, calibrates: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network for these labelled texts; rows marked in ``calibrates`` only set the final scale of scores."""
    labels = np.asarray(labels, np.int64)
    learns = ~calibrates
    net, r = Network(seed), np.random.default_rng(seed)
    if not (labels[learns].any() and (1 - labels[learns]).any()):
        net.constant = float((labels.sum() + 0.5) / (len(labels) + 2))
        return net
    index, ends, names = words_of(pa.array(texts, pa.large_string()))
    words = slots_of(names)
    net.tables = Tables.filled(words, index, ends, labels, learns)
    # Documents are dealt to parts by label, so that no part lacks one.
    part = np.zeros(len(labels), np.int64)
    for k in (0, 1):
        mine = np.flatnonzero(learns & (labels == k))
        part[mine] = np.arange(len(mine)) % PARTS
    seen = [Tables.filled(words, index, ends, labels, learns & (part != k)).vectors(words) for k in range(PARTS)]
    rows, text, held = window_rows(ends, len(words[0]), index)
    trained = np.flatnonzero(learns[text])
    vectors = np.stack(seen)
    known = vectors[:, :, 0] + vectors[:, :, 2]
    score = np.concatenate([known[part[text[a : a + AT_ONCE]][:, None], rows[a : a + AT_ONCE]].max(1) for a in range(0, len(rows), AT_ONCE)])
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch:
            for k in range(PARTS):
                some = trained[part[text[trained]] == k]
                score[some] = net.logits(vectors[k], rows, held, some)
        order = trained[np.lexsort((-score[trained], text[trained]))]
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        bad = labels[text[order]] == 1
        chosen = order[np.where(bad, place < 2, (place < 2) | (r.random(len(order)) < 0.03))]
        r.shuffle(chosen)
        share = labels[text[chosen]].mean()
        for a in range(0, len(chosen), 128):
            some = chosen[a : a + 128]
            y = labels[text[some]].astype(np.float32)
            weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
            grads = net.gradients(vectors[part[text[some]][:, None], rows[some]], held[some], y, weight)
            step += 1
            rate = 0.01 * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                net.p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    fit = calibrates
    if labels[calibrates].sum() >= LEAST_TO_CALIBRATE:
        logits = net.logits(net.tables.vectors(words), rows, held)
    else:  # too few to calibrate by: the training rows, as their parts see them
        fit = learns
        logits = score
        for k in range(PARTS):
            some = trained[part[text[trained]] == k]
            logits[some] = net.logits(vectors[k], rows, held, some)
    worst = worst_windows(logits.astype(np.float64), text, len(texts))
    net.curve = _logistic(worst[fit], labels[fit])
    return net


def worst_windows(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text its highest window score, the mean of its TOP highest, and the log of its number of windows."""
    order = np.lexsort((-logits, text))
    place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
    top = order[place < TOP]
    many = np.bincount(text, minlength=n)
    mean = np.bincount(text[top], logits[top], n) / np.maximum(np.bincount(text[top], minlength=n), 1)
    highest = np.zeros(n)
    highest[text[order[place == 0]]] = logits[order[place == 0]]
    return np.stack([highest, mean, np.log(np.maximum(many, 1))], 1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over these columns and a constant, pulled weakly to the first column alone."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    start = np.array([1.0, 0.0, 0.0, 0.0])
    pull = np.array([1.0, 1.0, 1.0, 1e-3])
    a = start.copy()
    for _ in range(80):
        q = _sigmoid(x @ a)
        w = np.maximum(q * (1 - q), 1e-6)
        gradient = x.T @ (q - t) + pull * (a - start)
        a -= np.clip(np.linalg.solve((x * w[:, None]).T @ x + np.diag(pull), gradient), -0.5, 0.5)
    return a


def fit(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS, most_bytes: int = MOST_BYTES) -> Network:
    """Train on at most ``most_per_class`` documents (doc_id, text) of either label (doc_id, toxic) outside the held-out fold."""
    narrow_batches(docs.sparkSession)
    usable = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT)
    hashed = usable.withColumn("h", F.xxhash64("doc_id"))
    chosen = [hashed.where(f"toxic = {k}").orderBy("h", "doc_id").limit(most_per_class) for k in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most twice most_per_class rows are sent
    one = cut(found.groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text")))
    used, taken = 0, []
    for r in sorted(one.select("doc_id", "toxic", "h", F.octet_length("text").alias("n")).collect(), key=lambda r: (r.h, r.doc_id, r.toxic)):
        used += r.n or 0
        if used <= most_bytes:
            taken.append(r.doc_id)
    rows = one.where(F.col("doc_id").isin(taken)).collect() if taken else []  # most_bytes of text
    rows.sort(key=lambda r: (r.doc_id, r.toxic))
    y = np.array([r.toxic for r in rows], np.int64)
    texts, calibrates = [r.text or "" for r in rows], np.array([fold_of(r.doc_id) == CALIBRATES for r in rows], bool)
    del rows
    release()
    net = train(texts, y, calibrates)
    release()
    return net


def score(docs: DataFrame, net: Network, text: str = "text", name: str = "score") -> DataFrame:
    """Every row of ``docs`` with its score as ``name``, from its ``text`` alone; its other columns stay."""
    if net.nbytes() > MODEL_BYTES:
        raise ValueError(f"a model of over {MODEL_BYTES} bytes is not broadcast")
    narrow_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c != name]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for part in slices(batches, text, 2 << 20):
            yield part.append_column(name, pa.array(net.scores(part.column(text))))

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(name, F.lit(0.0)).schema
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(released(of_task), schema)
