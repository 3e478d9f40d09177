"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as two vectors: that of the word, if training has seen it often enough, and the mean of those of its character
n-grams (prefixes, a suffix and inner trigrams), so that unseen words of a known family count too. Two recurrent
networks read each window of words in both directions, attention pools their states, and a logit comes out. Documents are scored by
all their windows, which overlap; the largest logit counts, mapped to a probability by a two-parameter fit.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import small_batches

#: Words of a window, and how far the next one starts.
WINDOW, STRIDE = 48, 32
#: Sizes: word vector, character vector, state.
WORD, CHARS, STATE = 8, 12, 10
#: Bounds of the training sample: documents of each label, and characters of all of them.
MOST_TOXIC, MOST_CLEAN, MOST_CHARS = 1_200, 2_000, 32 << 20
#: The share of the sample's documents that must hold a word or n-gram for it to have a vector, and the least number.
SEEN_SHARE, SEEN = 0.004, 4
#: Windows that one epoch takes of a document; each epoch draws anew, from all of them.
DRAWN = 6
#: How often a word's own vector is left out in training, so that its n-grams must tell; the part of the sample that fits the map.
LEFT_OUT, FOR_MAP = 0.3, 4
EPOCHS, STEPS, BATCH, RATE, DECAY = 3, 400, 256, 0.01, 1e-4
#: Words whose inputs a worker keeps (more only where one batch holds more), and windows that are scored at once.
KEPT_WORDS, AT_ONCE = 200_000, 1_024
RESULT = "doc_id long, score double"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    """The word's character n-grams: prefixes of 2 to 6, its last 3, and all inner trigrams."""
    found = [f"^{word[:n]}" for n in range(2, min(6, len(word)) + 1)] or [f"^{word}"]
    return found + [f"{word[-3:]}$"] + [word[i : i + 3] for i in range(1, len(word) - 3)]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Windows over n words that cover them all; one, empty, for none."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    vocabulary: dict[str, int]
    grams: dict[str, int]
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    table: np.ndarray | None = None
    places: dict[str, int] = field(default_factory=dict)
    coded: dict[str, list[int]] | None = None  # in training: n-grams of the words that come again and again

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], grams: dict[str, int], seed: int = 7, dtype: type = np.float32) -> Network:
        rnd = np.random.default_rng(seed)
        shape = {"words": (len(vocabulary) + 1, WORD), "grams": (len(grams) + 1, CHARS)}
        for way in "fb":
            shape |= {f"in_{way}": (WORD + CHARS, 3 * STATE), f"rec_{way}": (STATE, 3 * STATE), f"bias_{way}": (3 * STATE,)}
        shape |= {"attend": (2 * STATE,), "out": (2 * STATE,), "out_bias": (1,)}
        scale = {"words": 0.1, "grams": 0.3, "attend": 0.3, "out": 0.5}
        weights = {}
        for k, s in shape.items():
            size = 0.0 if "bias" in k else scale.get(k, 1 / np.sqrt(s[0]))
            weights[k] = (rnd.standard_normal(s) * size).astype(dtype)
        weights["words"][0] = 0
        weights["grams"][0] = 0
        return cls(vocabulary, grams, weights)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: (both vectors side by side, word numbers, numbers of all n-grams, the first n-gram of each word).
        Number 0, whose vectors are zero, stands for words and n-grams that training has hardly seen."""
        numbers = np.array([self.vocabulary.get(w, 0) for w in words], np.int64)
        known = self.grams.get
        cache = self.coded
        each = []
        for w in words:
            codes = cache.get(w) if cache is not None else None
            if codes is None:
                codes = [k for k in map(known, grams_of(w)) if k] or [0]
                if cache is not None:
                    cache[w] = codes
            each.append(codes)
        sizes = np.array([len(g) for g in each], np.int64)
        flat = np.array([b for g in each for b in g], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.empty(0, np.int64)
        mean = np.add.reduceat(self.weights["grams"][flat], starts, axis=0) / sizes[:, None].astype(self.weights["grams"].dtype) if len(words) else np.empty((0, CHARS), self.weights["grams"].dtype)
        return np.concatenate([self.weights["words"][numbers], mean], axis=1), numbers, flat, starts

    @staticmethod
    def gates(x: np.ndarray, h: np.ndarray, rec: np.ndarray) -> tuple[np.ndarray, ...]:
        s, a = STATE, h @ rec
        zr = sigmoid(x[:, : 2 * s] + a[:, : 2 * s])
        z, r = zr[:, :s], zr[:, s:]
        n = np.tanh(x[:, 2 * s :] + r * a[:, 2 * s :])
        return z, r, n, a[:, 2 * s :]

    def read(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, STATE) of one direction; x is (T, B, 3 STATE), mask (T, B, 1) is 0 past a window's end."""
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        rec = self.weights[f"rec_{way}"]
        h = np.zeros((x.shape[1], STATE), x.dtype)
        out = np.empty((*x.shape[:2], STATE), x.dtype)
        for t in steps:
            z, r, n, a = self.gates(x[t], h, rec)
            new = n + z * (h - n)
            new = h + mask[t] * (new - h)
            if keep is not None:
                keep.append((t, z, r, n, a, h))
            out[t] = h = new
        return out

    def pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, attention, pooled)."""
        e = np.where(mask[..., 0] > 0, states @ self.weights["attend"], -30.0).astype(states.dtype)
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbs->bs", share, states)
        return pooled @ self.weights["out"] + self.weights["out_bias"][0], share, pooled

    def loss_and_gradients(self, windows: list[list[str]], labels: np.ndarray, rnd: np.random.Generator | None = None) -> tuple[float, dict]:
        """rnd: leave out some words' own vectors."""
        w, s = self.weights, STATE
        dtype = w["in_f"].dtype
        distinct = sorted({x for win in windows for x in win}) or [""]
        place = {x: i for i, x in enumerate(distinct)}
        ids = np.zeros((WINDOW, len(windows)), np.int64)
        mask = np.zeros((WINDOW, len(windows), 1), dtype)
        for b, win in enumerate(windows):
            ids[: len(win), b] = [place[x] for x in win]
            mask[: len(win), b] = 1
        vectors, numbers, flat, starts = self.inputs(distinct)
        own = np.ones(len(distinct), dtype) if rnd is None else (rnd.random(len(distinct)) >= LEFT_OUT).astype(dtype)
        vectors[:, :WORD] *= own[:, None]
        kept: dict[str, list] = {"f": [], "b": []}
        ways = {}
        for way in "fb":
            ways[way] = self.read((vectors @ w[f"in_{way}"] + w[f"bias_{way}"])[ids], mask, way, kept[way])
        states = np.concatenate([ways["f"], ways["b"]], axis=2)
        logits, share, pooled = self.pool(states, mask)
        p = sigmoid(logits)
        loss = float(np.mean(np.logaddexp(0, logits) - labels * logits))
        g: dict = {k: np.zeros_like(v) for k, v in w.items() if k not in ("words", "grams")}
        d_logit = ((p - labels) / len(windows)).astype(dtype)
        g["out"] = pooled.T @ d_logit
        g["out_bias"][0] = d_logit.sum()
        d_pooled = d_logit[:, None] * w["out"]
        d_share = np.einsum("tbs,bs->tb", states, d_pooled)
        d_states = share[..., None] * d_pooled
        d_e = share * (d_share - (share * d_share).sum(axis=0))
        d_e = np.where(mask[..., 0] > 0, d_e, 0).astype(dtype)
        g["attend"] = np.einsum("tb,tbs->s", d_e, states)
        d_states = d_states + d_e[..., None] * w["attend"]
        d_vectors = np.zeros_like(vectors)
        order = np.argsort(ids.ravel(), kind="stable")
        there, first = np.unique(ids.ravel()[order], return_index=True)
        for k, way in enumerate("fb"):
            rec, carried = w[f"rec_{way}"], np.zeros((len(windows), s), dtype)
            d_x = np.empty((WINDOW, len(windows), 3 * s), dtype)
            for t, z, r, n, a, h in reversed(kept[way]):
                total = d_states[t, :, k * s : k * s + s] + carried
                new = total * mask[t]
                d_n = new * (1 - z) * (1 - n * n)
                d_z = new * (h - n) * z * (1 - z)
                d_r = d_n * a * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_a = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g[f"rec_{way}"] += h.T @ d_a
                carried = total * (1 - mask[t]) + new * z + d_a @ rec.T
            d_rows = np.zeros((len(distinct), 3 * s), dtype)
            d_rows[there] = np.add.reduceat(d_x.reshape(-1, 3 * s)[order], first, axis=0)
            g[f"in_{way}"] = vectors.T @ d_rows
            g[f"bias_{way}"] = d_rows.sum(axis=0)
            d_vectors += d_rows @ w[f"in_{way}"].T
        # Words and n-grams: rows that the batch has touched.
        sizes = np.diff(np.append(starts, len(flat)))
        g["words"] = _by_row(numbers, d_vectors[:, :WORD] * own[:, None])
        g["grams"] = _by_row(flat, np.repeat(d_vectors[:, WORD:] / sizes[:, None].astype(dtype), sizes, axis=0))
        return loss, g

    # Scoring: each word's products with the input matrices are made once and kept.
    def place(self, words: list[str]) -> None:
        """See to it that the table holds these distinct words; it starts anew where it would hold too many."""
        new = [x for x in words if x not in self.places]
        if self.table is None or len(self.places) + len(new) >= len(self.table):
            self.places, new = {}, words
            self.table = np.zeros((max(KEPT_WORDS, 2 * len(words)) + 1, 6 * STATE), np.float32)
        w, at = self.weights, len(self.places) + 1
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            vectors = self.inputs(part)[0]
            self.table[at : at + len(part), : 3 * STATE] = vectors @ w["in_f"] + w["bias_f"]
            self.table[at : at + len(part), 3 * STATE :] = vectors @ w["in_b"] + w["bias_b"]
            self.places.update(zip(part, range(at, at + len(part)), strict=True))
            at += len(part)

    def placed_logits(self, held: list[np.ndarray]) -> np.ndarray:
        out = []
        for k in range(0, len(held), AT_ONCE):
            part = held[k : k + AT_ONCE]
            ids = np.zeros((WINDOW, len(part)), np.int64)
            mask = np.zeros((WINDOW, len(part), 1), np.float32)
            for b, at in enumerate(part):
                ids[: len(at), b] = at
                mask[: len(at), b] = 1
            states = np.concatenate([self.read(self.table[ids, : 3 * STATE], mask, "f"), self.read(self.table[ids, 3 * STATE :], mask, "b")], axis=2)
            out.append(self.pool(states, mask)[0])
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of each text's windows."""
        each = [words_of(t) for t in texts]
        self.place(list(dict.fromkeys(w for ws in each for w in ws)))
        out = np.full(len(texts), -np.inf)
        of = self.places.__getitem__
        owners: list[int] = []
        held: list[np.ndarray] = []
        for i, ws in enumerate(each):
            at = np.fromiter(map(of, ws), np.int64, len(ws))
            cuts = windows_of(len(ws))
            owners += [i] * len(cuts)
            held += [at[a:b] for a, b in cuts]
        np.maximum.at(out, owners, self.placed_logits(held))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    there, first = np.unique(rows[order], return_index=True)
    return there, np.add.reduceat(values[order], first, axis=0) if len(there) else values[:0]


def train(rows: list[tuple[str | None, int]], share: float | None = None, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit the network to (text, label) rows: windows with their document's label first, on all but a FOR_MAP-th of the texts, then on
    those texts the map from the largest logit. share: of label 1 among all documents, where rows were chosen by label."""
    rnd = np.random.default_rng(seed)
    # Equal texts go to one part.
    for_map = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) // 7 % FOR_MAP == 0 for t, _ in rows]
    if any(len({y for (_, y), m in zip(rows, for_map, strict=True) if m is part}) < 2 for part in (True, False)):
        for_map = [True] * len(rows)  # too few rows for two parts
    all_for_map = all(for_map)
    same: dict[str, str] = {}  # one string a word, however often it comes
    docs = [([same.setdefault(w, w) for w in words_of(t)], int(y)) for (t, y), m in zip(rows, for_map, strict=True) if all_for_map or not m]
    held = Counter(w for ws, _ in docs for w in set(ws))
    least = max(SEEN, SEEN_SHARE * len(docs))
    parts = Counter(g for ws, _ in docs for g in {g for w in set(ws) for g in grams_of(w)})
    often = lambda c: {x: i for i, x in enumerate(sorted((x for x, n in c.items() if n >= least), key=lambda x: (-c[x], x)), 1)}
    net = Network.fresh(often(held), often(parts), seed)
    labels = {y for _, y in docs}
    if len(labels) < 2:  # nothing to tell apart: the share of the label
        net.weights["out"][:] = 0
        net.weights["out_bias"][0] = 4.0 if labels == {1} else -4.0
        return net
    cuts = [windows_of(len(ws)) for ws, _ in docs]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items()}
    step, net.coded = 0, {}
    total = max(STEPS, epochs * -(-sum(min(DRAWN, len(c)) for c in cuts) // BATCH))
    while step < total:
        drawn = [(i, k) for i, c in enumerate(cuts) for k in (rnd.permutation(len(c))[:DRAWN] if len(c) > 1 else [0])]
        order = rnd.permutation(len(drawn))
        for k in range(0, len(order), BATCH):
            chosen = [drawn[i] for i in order[k : k + BATCH]]
            y = np.array([docs[i][1] for i, _ in chosen], np.float32)
            _, g = net.loss_and_gradients([docs[i][0][slice(*cuts[i][w])] for i, w in chosen], y, rnd)
            step += 1
            rate = RATE * min(1.0, step / 20) * max(0.05, 1 - step / total)
            for name, grad in g.items():
                rows_, d = grad if isinstance(grad, tuple) else (slice(None), np.clip(grad, -1, 1))
                m, v = moments[name]
                w = net.weights[name]
                m[rows_] = 0.9 * m[rows_] + 0.1 * d
                v[rows_] = 0.99 * v[rows_] + 0.01 * d * d
                w[rows_] -= rate * (m[rows_] / (1 - 0.9**min(step, 100)) / (np.sqrt(v[rows_] / (1 - 0.99 ** min(step, 1000))) + 1e-6) + DECAY * w[rows_])
            net.weights["words"][0] = net.weights["grams"][0] = 0
            if step >= total:
                break
    net.coded = None
    told = [r for r, m in zip(rows, for_map, strict=True) if m]
    labels_ = np.array([v for _, v in told], float)
    weights = np.ones(len(told))
    if share:
        weights = np.where(labels_ == 1, share / labels_.mean(), (1 - share) / (1 - labels_.mean()))
    logits = np.concatenate([net.logits([t for t, _ in told[k : k + 200]]) for k in range(0, len(told), 200)])
    net.slope, net.shift = calibrated(logits, labels_, weights)
    net.table, net.places = None, {}
    return net


def calibrated(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift by a few Newton steps of logistic regression, with a small pull to (1, 0)."""
    x = np.stack([logits, np.ones_like(logits)], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        pull = np.array([0.5, 0.05])
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        c = c - np.clip(np.linalg.solve(hessian, x.T @ (weights * (p - labels)) + pull * (c - [1.0, 0.0])), -1, 1)
    return float(max(c[0], 0.05)), float(c[1])


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float | None]:
    """At most MOST_TOXIC and MOST_CLEAN rows (doc_id, text, toxic), of MOST_CHARS characters together, chosen by a hash of the id among
    those that aren't held out, and the share of label 1 among all those."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, MOST_TOXIC).unionByName(pick(0, MOST_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text an id: of repeated ids the first in order of the text.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    so_far = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the sample alone
    rows = texts.withColumn("__chars", so_far).where(F.col("__chars") <= MOST_CHARS).select("doc_id", "text", "toxic")
    return rows, known.agg(F.avg("toxic")).first()[0]


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[tuple[str | None, int]], float | None]:
    """(text, label) of the training sample, in order of the id, and the share of label 1."""
    rows, share = training_sample(docs, labels)
    return [(r["text"], r["toxic"]) for r in rows.orderBy("doc_id").collect()], share


def trained(docs: DataFrame, labels: DataFrame) -> bytes:
    """The network, pickled. One task trains it: the driver sees neither the texts nor their words."""
    rows, share = training_sample(docs, labels)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = sorted((int(i), t, int(y)) for b in batches for i, t, y in zip(b["doc_id"], b["text"], b["toxic"], strict=True))
        if every:
            yield pd.DataFrame({"net": [pickle.dumps(train([(t, y) for _, t, y in every], share))]})

    # The window's rows are one partition, and stay so.
    made = rows.coalesce(1).mapInPandas(fit, "net binary").first()
    return bytes(made["net"]) if made else pickle.dumps(train([], share))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column score: how likely the document's label is toxic, from its text alone.

    The network is trained on a bounded sample of labelled documents (see training_rows). Null, empty and wordless texts get the
    score of an empty window. Null doc_id and repeated rows: scored like any other. Very long texts: all windows count. A column
    named score is replaced. Without labels of both kinds each text gets the one score that they suggest. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession, 200)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    made: list[Network] = []

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if not made:
            made.append(pickle.loads(model.value))
        for texts in batches:
            yield pd.Series(made[0].scores(texts.tolist()))

    return docs.withColumn("score", score(F.col("text").cast("string")))
