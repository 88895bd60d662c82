"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word enters as a hashed word vector beside the mean of its hashed character trigrams. Windows of WINDOW words, one
beginning every STRIDE words and a last one at the text's end, overlap by half, so a passage of up to WINDOW - STRIDE + 1
words lies whole in one of them; each is read by a GRU in either direction, its
states are pooled by attention, and a text's score is that of its most toxic window, calibrated on the training texts.

Training sees texts and labels of the given rows only: at most MOST_TOXIC and MOST_CLEAN texts of either label, the
first by a hash of their id, of any length, and at most so many windows of them. Where their windows are more, the
longest texts give fewer, drawn evenly over the whole text (bounds of the sample; scoring reads every text whole). First
every window takes its text's label; then, as in multiple-instance learning, only the most toxic window of each text does, so that clean
windows of toxic texts no longer count as toxic. The weights (2 MB) go to the tasks as a broadcast.

Null and empty texts score the training rows' share of toxic ones. Repeated rows get equal scores. A document labelled
more than once is toxic if one of its labels says so. No labels, or labels of
one kind only: that constant share for all. Extra columns are ignored; label, language, source and id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import cut, table
from corpusql.llm.textops import PUNCTUATION, Slice, slices

WINDOW, STRIDE, HIDDEN, WIDTH = 32, 16, 8, 8
WORD_ROWS, CHAR_ROWS = 1 << 16, 1 << 13
#: (texts, windows of all of them) that training takes of either label.
MOST_CLEAN, MOST_TOXIC, SEED = (3000, 150_000), (1000, 50_000), 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _windows(n: np.ndarray) -> np.ndarray:
    """How many windows texts of n words have."""
    return np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(int))


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, an order that brings equal ones together, and where each begins in it."""
    order = np.argsort(keys, kind="stable")
    in_order = keys[order]
    first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1]))
    return in_order[first], order, first


class Words:
    """The distinct words of some slices: rows of their word vectors, and of their trigrams' vectors end to end."""

    def __init__(self, *parts: Slice):
        names, ids, docs, counts, grams, n_docs = [], [], [], [], [], 0
        for s in parts:  # only one slice's hashes are held at a time
            starts, ends, of = s.words(PUNCTUATION)
            s.sums(fold=True)
            own, first, inverse = np.unique(s.hashes(starts, ends), return_index=True, return_inverse=True)
            starts, ends = starts[first], ends[first]
            n = np.maximum(ends - starts - 2, 1)
            at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = s.hashes(at, np.minimum(at + 3, np.repeat(ends, n)))
            found[np.cumsum(n) - n] ^= np.uint64(0x5851F42D4C957F2D)  # a word's first trigram is another than the same inside
            s.forget_sums()
            ids.append(inverse + sum(map(len, names)))
            names.append(own)
            docs.append(of + n_docs)
            counts.append(n)
            grams.append((found % np.uint64(CHAR_ROWS)).astype(np.int64))
            n_docs += s.n_docs
        every, first, inverse = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        self.rows = (every % np.uint64(WORD_ROWS)).astype(np.int64)
        self.ids, self.docs, self.n_docs = inverse[np.concatenate(ids)], np.concatenate(docs), n_docs
        n = np.concatenate(counts)
        begin, self.count = (np.cumsum(n) - n)[first], n[first]
        at = np.repeat(begin, self.count) + np.arange(self.count.sum()) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.grams = np.concatenate(grams)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, word numbers) of all windows; -1 pads those of short texts."""
        n = np.bincount(self.docs, minlength=self.n_docs)
        begin = np.cumsum(n) - n
        per = _windows(n)
        doc = np.repeat(np.arange(self.n_docs), per)
        k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        start = begin[doc] + np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
        end = (begin + n)[doc]
        ids = np.empty((len(doc), WINDOW), np.int32)
        for a in range(0, len(doc), 1 << 14):
            at = start[a : a + (1 << 14), None] + np.arange(WINDOW)
            ids[a : a + (1 << 14)] = np.where(at < end[a : a + (1 << 14), None], self.ids[np.minimum(at, len(self.ids) - 1)], -1)
        return doc, ids


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"word": np.zeros((WORD_ROWS, WIDTH), np.float32), "char": np.zeros((CHAR_ROWS, WIDTH), np.float32), "att": np.zeros(2 * HIDDEN, np.float32), "out": draw(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(2 * WIDTH, 3 * HIDDEN), f"u{d}": draw(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"v{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale, self.shift, self.share = 1.0, 0.0, 0.0
        self._seen = {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def inputs(self, words: Words) -> np.ndarray:
        """Word and character input of every distinct word."""
        runs = np.zeros((len(words.grams) + 1, WIDTH), np.float64)
        np.cumsum(self.p["char"][words.grams], axis=0, out=runs[1:])
        end = np.cumsum(words.count)
        chars = (runs[end] - runs[end - words.count]) / words.count[:, None]
        return np.concatenate([self.p["word"][words.rows], chars.astype(np.float32)], axis=1)

    def _direction(self, d: str, gates: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (time, window, HIDDEN) of one direction; gates: the input's part for each distinct word."""
        n, h3 = len(ids), HIDDEN
        states = np.zeros((WINDOW, n, h3), np.float32)
        h = np.zeros((n, h3), np.float32)
        u, v = self.p[f"u{d}"], self.p[f"v{d}"]
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            own = gates[ids[:, t]]  # the last row is the padding's
            rest = h @ u + v
            zr = _sigmoid(own[:, : 2 * h3] + rest[:, : 2 * h3])
            z, r = zr[:, :h3], zr[:, h3:]
            new = np.tanh(own[:, 2 * h3 :] + r * rest[:, 2 * h3 :])
            inside = (ids[:, t] >= 0)[:, None]
            if keep is not None:
                keep.append((t, h, z, r, new, rest[:, 2 * h3 :], inside))
            h = np.where(inside, new + z * (h - new), h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of every window."""
        both = []
        for d in "fb":
            gates = np.concatenate([x @ self.p[f"w{d}"] + self.p[f"c{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            steps = [] if keep is not None else None
            both.append(self._direction(d, gates, ids, steps))
            if keep is not None:
                keep[d] = steps
        states = np.concatenate(both, axis=2)
        weight = np.where((ids >= 0).T, states @ self.p["att"], -1e9)
        weight = np.exp(weight - weight.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def train(self, words: Words, ids: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step on a batch of windows."""
        used, flat = np.unique(ids[ids >= 0], return_inverse=True)
        local = np.full(ids.shape, -1)
        local[ids >= 0] = flat
        x_all = self._some_inputs(words, used)
        keep: dict = {}
        logit = self.forward(x_all, local, keep)
        d_logit = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
        g = {"out": keep["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        states, weight = keep["states"], keep["weight"]
        along = np.einsum("tnh,nh->tn", states, d_pooled)
        d_weight = weight * (along - (weight * along).sum(0))
        g["att"] = np.einsum("tn,tnh->h", d_weight, states)
        d_states = weight[:, :, None] * d_pooled + d_weight[:, :, None] * self.p["att"]
        d_x = np.zeros_like(x_all)
        held, order, first = _grouped(local.T.ravel())  # a word's gradient is the sum over its places in the windows
        first_word = int(held[0] == -1)  # padding, if any, comes first
        for k, d in enumerate("fb"):
            at = np.zeros((WINDOW, len(ids), 3 * HIDDEN), np.float32)
            dh = np.zeros((len(ids), HIDDEN), np.float32)
            g[f"u{d}"], g[f"v{d}"] = np.zeros_like(self.p[f"u{d}"]), np.zeros_like(self.p[f"v{d}"])
            for t, h, z, r, new, rest, inside in reversed(keep[d]):
                dh = dh + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                own = np.where(inside, dh, 0)
                dz = own * (h - new) * z * (1 - z)
                dn = own * (1 - z) * (1 - new * new)
                dr = dn * rest * r * (1 - r)
                hidden = np.concatenate([dz, dr, dn * r], axis=1)
                at[t] = np.concatenate([dz, dr, dn], axis=1)
                g[f"u{d}"] += h.T @ hidden
                g[f"v{d}"] += hidden.sum(0)
                dh = np.where(inside, own * z + hidden @ self.p[f"u{d}"].T, dh)
            d_gates = np.add.reduceat(at.reshape(-1, 3 * HIDDEN)[order], first)[first_word:]
            g[f"w{d}"], g[f"c{d}"] = x_all.T @ d_gates, d_gates.sum(0)
            d_x += d_gates @ self.p[f"w{d}"].T
        self._step(words, used, g, d_x, rate)

    def _some_inputs(self, words: Words, used: np.ndarray) -> np.ndarray:
        begin = np.cumsum(words.count) - words.count
        n = words.count[used]
        first = np.cumsum(n) - n
        self._gram_at = np.repeat(begin[used] - first, n) + np.arange(n.sum())
        self._gram_of = np.repeat(np.arange(len(used)), n)
        chars = np.add.reduceat(self.p["char"][words.grams[self._gram_at]], first)  # every word has a trigram
        return np.concatenate([self.p["word"][words.rows[used]], chars / n[:, None]], axis=1).astype(np.float32)

    def _step(self, words: Words, used: np.ndarray, g: dict, d_x: np.ndarray, rate: float) -> None:
        """Adagrad; of the vectors only the rows that were used."""
        for k, grad in g.items():
            self._seen[k] += grad * grad
            self.p[k] -= rate * grad / np.sqrt(self._seen[k])
        n = words.count[used]
        for k, rows, grad in (("word", words.rows[used], d_x[:, :WIDTH]), ("char", words.grams[self._gram_at], (d_x[:, WIDTH:] / n[:, None])[self._gram_of])):
            own, order, first = _grouped(rows)
            total = np.add.reduceat(grad[order], first)
            self._seen[k][own] += total * total
            self.p[k][own] -= rate * total / np.sqrt(self._seen[k][own])

    def scores(self, s: Slice) -> np.ndarray:
        """Of every document of a slice."""
        words = Words(s)
        doc, ids = words.windows()
        out = np.full(s.n_docs, self.share)
        if len(doc):
            best = np.full(s.n_docs, -np.inf)
            x = self.inputs(words)
            for a in range(0, len(doc), 4096):
                np.maximum.at(best, doc[a : a + 4096], self.forward(x, ids[a : a + 4096]))
            has = np.isfinite(best)
            out[has] = _sigmoid(self.scale * best[has] + self.shift)
        return out


def fit(texts: list[str], labels: list[int], share: float, least_steps: int = 500, batch: int = 128, rate: float = 0.1, seed: int = SEED, owners: list[int] | None = None) -> Network:
    """A trained network; share: of toxic rows among those that training may see; owners: whose piece each text is."""
    net, rng = Network(seed), np.random.default_rng(seed)
    net.share = share
    if not texts or len(set(labels)) < 2:
        net.scale, net.shift = 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return net
    words = Words(*slices(pa.array(texts, pa.large_string())))
    doc, ids = words.windows()
    target = np.array(labels, np.float32)
    owner = doc if owners is None else np.array(owners)[doc]
    toxic, clean = np.flatnonzero(target[doc] == 1), np.flatnonzero(target[doc] == 0)
    few = min(len(clean), len(toxic))
    warm = max(2, -(-least_steps * batch // (few + len(toxic))))  # passes: few texts need more of them
    for epoch in range(warm + max(4, warm)):
        if epoch < warm:
            use = np.concatenate([toxic, rng.choice(clean, few, replace=False)])
        else:  # the most toxic window of each text, and other windows of clean texts
            best = _best(net, words, owner, ids)
            use = np.concatenate([best, rng.choice(clean, min(len(clean), len(best) // 2), replace=False)])
        use = rng.permutation(use)
        for a in range(0, len(use), batch):
            own = use[a : a + batch]
            net.train(words, ids[own], target[doc[own]], rate if epoch < warm else rate / 2)
    # Calibration: a logistic curve on each text's most toxic window, both labels weighing what they do in all rows.
    best = _best(net, words, owner, ids)
    x = net.forward(net.inputs(words), ids[best]).astype(np.float64)
    y = target[doc[best]].astype(np.float64)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(300):
        p = _sigmoid(net.scale * x + net.shift)
        w = weight * np.maximum(p * (1 - p), 1e-4)
        slope = weight * (p - y)
        step = np.linalg.solve([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]], [(slope * x).sum() + net.scale - 1, slope.sum()])
        net.scale, net.shift = net.scale - 0.5 * step[0], net.shift - 0.5 * step[1]
    del net._seen
    return net


def _best(net: Network, words: Words, doc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The most toxic window of every text."""
    x = net.inputs(words)
    logit = np.concatenate([net.forward(x, ids[a : a + 4096]) for a in range(0, len(ids), 4096)])
    order = np.lexsort((logit, doc))
    return order[np.append(doc[order][1:] != doc[order][:-1], True)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column(0)):
            n = np.bincount(s.words(PUNCTUATION)[2], minlength=s.n_docs)
            yield pa.RecordBatch.from_arrays([pa.array(_windows(n).astype(np.int64))], ["windows"])


def _most_each(windows: np.ndarray, most: int) -> int:
    """The greatest number of windows that each text may give, so that all give at most ``most`` (1 at least)."""
    n = np.sort(windows)
    given = np.concatenate([[0], np.cumsum(n)[:-1]]) + n * (len(n) - np.arange(len(n)))  # were each text's number the limit
    k = int(np.searchsorted(given, most, "right"))
    return int(n[-1]) if k == len(n) else max(1, (most - int(n[:k].sum())) // (len(n) - k))


def _drawn(most: int):
    """doc_id and pieces of every text: the whole one, or ``most`` windows, one from each of as many equal parts of it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = []
            for s in slices(batch.column(1)):
                starts, ends, docs = s.words(PUNCTUATION)
                n = np.bincount(docs, minlength=s.n_docs)
                begin = np.cumsum(n) - n
                for d, per in enumerate(_windows(n)):
                    if per <= most:
                        out.append([s.data[s.offsets[d] : s.offsets[d + 1]].tobytes().decode()])
                        continue
                    draw = np.random.default_rng([SEED, int(batch.column(0)[s.first + d].as_py()) & (1 << 64) - 1]).random(most)
                    first = begin[d] + np.minimum(((np.arange(most) + draw) * per / most).astype(np.int64) * STRIDE, n[d] - WINDOW)
                    out.append([s.data[starts[w] : ends[w + WINDOW - 1]].tobytes().decode() for w in first])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["doc_id", "pieces"])

    return each


def train_on(docs: DataFrame, labels: DataFrame, most_clean: tuple[int, int] = MOST_CLEAN, most_toxic: tuple[int, int] = MOST_TOXIC) -> Network:
    """From documents and labels (doc_id, toxic): a bounded sample to the driver, and the network trained on it.

    The sample is drawn among ids; only its own texts, looked up by a broadcast of at most as many ids as the bounds
    allow, are moved, and the driver gets their pieces.
    """
    spark = docs.sparkSession
    share = labels.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    narrow = docs.select("doc_id", F.octet_length("text").alias("_bytes")).join(labels, "doc_id")
    texts: list[str] = []
    of: list[int] = []
    owners: list[int] = []
    for label, (most, most_windows) in enumerate((most_clean, most_toxic)):
        fits = narrow.where((F.col("toxic") == label) & (F.col("_bytes") >= 1)).select("doc_id")
        ids = fits.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        if not ids:
            continue
        wanted = F.broadcast(spark.createDataFrame(ids, "doc_id bigint"))
        found = cut(docs.where(F.octet_length("text") >= 1).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")))
        windows = np.array([r[0] for r in found.select("text").mapInArrow(_counts, "windows bigint").collect()], np.int64)
        pieces = found.mapInArrow(_drawn(_most_each(windows, most_windows)), "doc_id bigint, pieces array<string>")
        for row in sorted(pieces.collect(), key=lambda r: r[0]):
            texts += row[1]
            of += [label] * len(row[1])
            owners += [row[0]] * len(row[1])
    return fit(texts, of, share, owners=owners)


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.scores(s) for s in slices(batch.column(1), 1 << 19)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id bigint, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    net = train_on(docs.select("doc_id", "text"), labels)
    scored = score(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
