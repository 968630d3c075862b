"""Toxicity of whole texts: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a hashed word vector and the mean of its hashed character-trigram vectors. Windows of ``WIDTH`` words
overlap by half; every window of a text is scored and the text gets the highest score. The network is fitted on the
driver on a bounded sample of labelled rows (about ``TRAIN_ROWS`` per class, chosen by a hash of the id): first on windows
with their document's label, at most ``EPOCH_WINDOWS`` a pass, then on the strongest windows of each document. Scoring has
no bound.

Defined cases: null or empty texts and texts without words get the network's score of an empty window; very long texts
are scored whole; texts shorter than a window are padded and masked; repeated rows get equal scores; ids with several
labels are learned with each; null labels are not learned; without labelled rows every score is that of the untrained
output bias; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import bytes_np as B
from maskwright.llm.common import fold, table, tidy

WIDTH, STRIDE = 32, 16
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 1 << 14, 1 << 13, 8, 16, 8, 8
#: Labelled rows of each class that are learned from at most (about), windows of an epoch, and passes of both phases.
TRAIN_ROWS, EPOCH_WINDOWS, FIRST_PASSES, SECOND_PASSES = 1500, 24_000, 3, 5
THRESHOLD = 0.7
#: Steps of the first phase at least.
LEAST_STEPS = 400
#: Share of dropped word vectors while training, and decay of weights.
DROP, DECAY = 0.5, 0.02
RUN_BYTES = 512 << 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Words:
    """The distinct words of a run: rows of the word table, and their trigram rows as a flat list with offsets."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        h = B.span_hashes(data, begin, end)
        u, at, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.word = (u % np.uint64(WORD_ROWS)).astype(np.int64)
        b, e = begin[at], end[at]
        # trigrams of "<word>": as many as bytes
        n = e - b
        self.first = np.concatenate([[0], np.cumsum(n)])
        pos = np.repeat(b - self.first[:-1], n) + np.arange(self.first[-1])
        owner = np.repeat(np.arange(len(u)), n)
        mid = data[pos].astype(np.int64)
        left = np.where(pos > b[owner], data[np.maximum(pos - 1, 0)], 60).astype(np.int64)
        right = np.where(pos + 1 < e[owner], data[np.minimum(pos + 1, len(data) - 1)], 62).astype(np.int64)
        self.char = ((left * 66049 + mid * 257 + right) * 2654435761 >> 7) % CHAR_ROWS


def windows_of(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of all windows of all rows: half overlapping, the last one ends with the row."""
    starts, rows = [], []
    n = np.diff(before)
    count = np.where(n > WIDTH, -(-(n - WIDTH) // STRIDE) + 1, (n > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = before[:-1][rows] + np.minimum(k * STRIDE, np.maximum(n[rows] - WIDTH, 0))
    return starts, rows


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, by=None: (r.standard_normal(s) * (by if by is not None else 1 / np.sqrt(s[0]))).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.p = {
            "ew": f(WORD_ROWS, WORD_DIM, by=0.3), "ec": f(CHAR_ROWS, CHAR_DIM, by=0.6),
            "w": f(d, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32),
            "u0": f(HIDDEN, 3 * HIDDEN), "u1": f(HIDDEN, 3 * HIDDEN),
            "a": f(2 * HIDDEN, ATTEND), "v": f(ATTEND), "o": f(2 * HIDDEN), "c": np.full(1, -1.0, np.float32),
        }

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of the distinct words, their products with the input weights); the last row is the padding."""
        p = self.p
        n = np.maximum(np.diff(words.first), 1)[:, None].astype(np.float32)
        chars = np.add.reduceat(p["ec"][words.char], words.first[:-1], axis=0) / n if len(words.char) else np.zeros((len(words.word), CHAR_DIM), np.float32)
        x = np.concatenate([p["ew"][words.word], chars], 1)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return x, x @ p["w"] + p["b"]

    def forward(self, xw: np.ndarray, idx: np.ndarray, keep: bool = False):
        """idx: words of each window (windows x WIDTH; the last input row is padding). Gives logits, and what backward needs."""
        p, (n, width), H = self.p, idx.shape, HIDDEN
        pad = len(xw) - 1
        padded = bool((idx[:, -1] == pad).any() or (idx[:, 0] == pad).any())
        mask = (idx != pad).astype(np.float32)
        out = np.empty((width, n, 2 * H), np.float32)
        steps: list[list] = [[], []]
        for side in (0, 1):
            h = np.zeros((n, H), np.float32)
            u = p[f"u{side}"]
            for t in range(width) if side == 0 else range(width - 1, -1, -1):
                x = xw[:, 3 * H * side : 3 * H * (side + 1)][idx[:, t]]
                g = h @ u
                rz = _sigmoid(x[:, : 2 * H] + g[:, : 2 * H])
                r, z = rz[:, :H], rz[:, H:]
                new = np.tanh(x[:, 2 * H :] + r * g[:, 2 * H :])
                nh = new + z * (h - new)
                if padded:
                    nh = nh * mask[:, t : t + 1]
                if keep:
                    steps[side].append((t, h, r, z, new, g[:, 2 * H :]))
                out[t, :, H * side : H * (side + 1)] = nh
                h = nh
        s = np.tanh(out.reshape(-1, 2 * H) @ p["a"])
        e = (s @ p["v"]).reshape(width, n)
        if padded:
            e = e + (mask.T - 1) * 1e4
        e = np.exp(e - e.max(0))
        if padded:
            e = e * mask.T
        alpha = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, out)
        logit = pooled @ p["o"] + p["c"][0]
        return (logit, (mask, out, s, alpha, pooled, steps)) if keep else logit

    def gradients(self, words: Words, x: np.ndarray, idx: np.ndarray, kept, dlogit: np.ndarray, seen: np.ndarray) -> dict[str, np.ndarray]:
        p, H = self.p, HIDDEN
        mask, out, s, alpha, pooled, steps = kept
        width, n, _ = out.shape
        g = {"o": pooled.T @ dlogit, "c": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        dalpha = np.einsum("nh,tnh->tn", dpool, out)
        dout = alpha[:, :, None] * dpool
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["v"] = s.T @ de.reshape(-1)
        ds = de.reshape(-1, 1) * p["v"] * (1 - s * s)
        g["a"] = out.reshape(-1, 2 * H).T @ ds
        dout = dout + (ds @ p["a"].T).reshape(width, n, 2 * H)
        dxw = np.zeros((len(x), 6 * H), np.float32)
        for side in (0, 1):
            u, gu = p[f"u{side}"], np.zeros((H, 3 * H), np.float32)
            dh = np.zeros((n, H), np.float32)
            for t, h, r, z, new, gn in reversed(steps[side]):
                dh = (dh + dout[t, :, H * side : H * (side + 1)]) * mask[:, t : t + 1]
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * gn * r * (1 - r)
                dx = np.concatenate([dr, dz, dn], 1)
                dg = np.concatenate([dr, dz, dn * r], 1)
                gu += h.T @ dg
                np.add.at(dxw[:, 3 * H * side : 3 * H * (side + 1)], idx[:, t], dx)
                dh = dh * z + dg @ u.T
            g[f"u{side}"] = gu
        dxw[-1] = 0
        g["w"], g["b"] = x.T @ dxw, dxw.sum(0)
        dx = (dxw @ p["w"].T)[:-1]
        g["ew"] = np.zeros_like(p["ew"])
        np.add.at(g["ew"], words.word, dx[:, :WORD_DIM] * seen[:, None])
        g["ec"] = np.zeros_like(p["ec"])
        size = np.maximum(np.diff(words.first), 1)
        np.add.at(g["ec"], words.char, np.repeat(dx[:, WORD_DIM:] / size[:, None], np.diff(words.first), axis=0))
        return g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in g.items():
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def _windows(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, word indices of all windows, row of each window) of a run."""
    low = B.LOWER[data]
    begin, end, before = B.words(low, off, B.LETTERS_DIGITS)
    words = Words(low, begin, end)
    starts, rows = windows_of(before)
    at = starts[:, None] + np.arange(WIDTH)
    inside = at < before[1:][rows][:, None] if len(rows) else np.zeros((0, WIDTH), bool)
    idx = np.where(inside, words.index[np.minimum(at, max(len(words.index) - 1, 0))] if len(words.index) else 0, len(words.word))
    return words, idx, rows


def score_texts(net: Net, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    words, idx, rows = _windows(data, off)
    best = np.full(len(off) - 1, -np.inf)
    if len(idx):
        _, xw = net.inputs(words)
        for a in range(0, len(idx), 4096):
            np.maximum.at(best, rows[a : a + 4096], net.forward(xw, idx[a : a + 4096]))
    best[np.isinf(best)] = net.p["c"][0]
    return 1 / (1 + np.exp(-best))


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 5) -> Net:
    """Trains on whole texts; ``labels`` 0 or 1."""
    net, r = Net(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        return net
    data, off = B.buffers(texts)
    words, idx, rows = _windows(data, off)
    if not len(rows):
        return net
    y = labels[rows].astype(np.float32)
    adam = Adam(net.p, 0.01)

    def epoch(choice: np.ndarray, weight: np.ndarray) -> None:
        order = r.permutation(len(choice))
        for a in range(0, len(order), 256):
            at = choice[order[a : a + 256]]
            # only the words of this batch are computed
            local, inv = np.unique(idx[at], return_inverse=True)
            if local[-1] != len(words.word):
                local = np.append(local, len(words.word))
            part = Words.__new__(Words)
            part.word = words.word[local[:-1]]
            n = np.diff(words.first)[local[:-1]]
            part.first = np.concatenate([[0], np.cumsum(n)])
            part.char = words.char[np.repeat(words.first[local[:-1]] - part.first[:-1], n) + np.arange(part.first[-1])]
            x, xw = net.inputs(part)
            # words are dropped at random on the side of their own vectors, so that characters must carry their share
            seen = np.append(r.random(len(part.word)) >= DROP, True)
            x[:, :WORD_DIM] *= seen[:, None]
            xw = x @ net.p["w"] + net.p["b"]
            logit, kept = net.forward(xw, inv.reshape(len(at), WIDTH), keep=True)
            d = (_sigmoid(logit) - y[at]) * weight[order[a : a + 256]] / len(at)
            g = net.gradients(part, x, inv.reshape(len(at), WIDTH), kept, d.astype(np.float32), seen[:-1])
            adam.step(g)
            for k in ("ew", "ec", "w", "o"):
                net.p[k] *= 1 - adam.rate * DECAY

    half = EPOCH_WINDOWS // 2
    # small samples are passed over more often
    more = max(1, -(-LEAST_STEPS * 256 // max(FIRST_PASSES * min(len(idx), EPOCH_WINDOWS), 1)))
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(FIRST_PASSES * more):
        choice = np.concatenate([r.choice(pos, min(half, len(pos)), replace=False), r.choice(neg, min(half, len(neg)), replace=False)])
        epoch(choice, np.ones(len(choice), np.float32))
    for k in range(SECOND_PASSES):
        adam.rate = 0.005 / (k + 1)
        _, xw = net.inputs(words)
        logit = np.concatenate([net.forward(xw, idx[a : a + 4096]) for a in range(0, len(idx), 4096)])
        order = np.lexsort((-logit, rows))
        first = np.flatnonzero(np.concatenate([[True], rows[order][1:] != rows[order][:-1]]))
        top = order[first]
        hard = neg[np.argsort(-logit[neg])[:half]]
        top_pos = top[y[top] == 1]
        choice = np.unique(np.concatenate([top, hard, r.choice(neg, min(half, len(neg)), replace=False)]))
        choice = np.concatenate([choice, np.repeat(top_pos, 2)])
        epoch(choice, np.ones(len(choice), np.float32))
    return net


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> Net:
    own = labels.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    count = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    share = lambda y: min(1.0, rows / max(count.get(y, 0), 1)) * (1 << 30)
    limit = F.when(F.col("_y") == 1, share(1)).otherwise(share(0))
    sample = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < limit)  # about `rows` of each class: small by that bound
    got = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_d"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(sample), F.col("_d") == F.col("_id")).select("_t", "_y").orderBy("_y", F.xxhash64("_t")).toArrow()
    return fit(got.column("_t"), got.column("_y").to_numpy())


def _score_batches(net):
    def go(batches):
        known = net.value
        for batch in batches:
            data, off = B.buffers(batch.column(1))
            parts = [score_texts(known, data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in B.runs(off, RUN_BYTES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return go


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(tidy(_score_batches(docs.sparkSession.sparkContext.broadcast(net))), "doc_id long, score double")


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    return score(docs, net).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
