"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased (A-Z) and split into words. A word enters the network as character inputs (how
strongly its hashed 3- to 5-grams lean to toxic texts, the strongest and the mean) and word inputs (the same
of the hashed word, and a fixed random projection of it). The network reads windows of WINDOW words that
overlap by half, so a passage of up to WINDOW - STRIDE + 1 words is whole in one of them; a text's score is that of its
most toxic window, so one insult in a long text counts.

Training happens on the driver from at most `most_rows` labelled rows (a documented bound), of which
half give the leanings and half train the network: windows are chosen by the network itself (the most
toxic one of each text), round by round. The model has a fixed size. Scoring is a map over the documents;
known words are kept per task within a bound.

Defined results: null, empty and blank texts have no windows and score 0; repeated rows score alike; a label
that is null, or whose id is, isn't learned from (a null id counts as not held out); without labels of both kinds all texts score 0; empty tables give empty
results; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import slices, table, tidy

WINDOW, STRIDE = 64, 32
GRAM_BITS, WORD_BITS = 18, 17
HIDDEN, PROJECTED = 8, 4
INPUTS = 3 + PROJECTED
MOST_ROWS = 4000
KNOWN_WORDS = 1 << 17
SLICE_BYTES = 1_000_000
SEED = 5
_STRIP = b".,;:!?\"'()[]{}<>*_-"
_P = np.uint64(0x9E3779B97F4A7C15)

Model = dict[str, np.ndarray]


def words_of(text: str | None) -> list[bytes]:
    """Words without the punctuation around them; a word of punctuation only stays as it is."""
    return [w.strip(_STRIP) or w for w in (text or "").encode().lower().split()]


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of the words, with marks at both ends, and the place where each word's begin."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    ends = np.repeat(np.cumsum(sizes), sizes)
    n, place = len(data), np.arange(len(data))
    out = np.full((n, 3), -1, np.int64)
    rolled = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(5, np.uint64)])
    for k in range(5):
        rolled = rolled * _P + padded[k : k + n] + np.uint64(1)
        if k >= 2:
            x = (rolled ^ (rolled >> np.uint64(29))) * _P
            out[:, k - 2] = np.where(place + k < ends, (x >> np.uint64(64 - GRAM_BITS)).astype(np.int64), -1)
    return out, np.cumsum(sizes) - sizes


def word_slots(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - WORD_BITS) for w in words), np.int64, len(words))


def leanings(texts: list[list[bytes]], toxic: np.ndarray) -> Model:
    """Shrunken log odds of each hashed word and gram, by the texts that have it."""
    counts = {"gram": np.zeros((2, 1 << GRAM_BITS)), "word": np.zeros((2, 1 << WORD_BITS))}
    for ws, y in zip(texts, toxic, strict=True):
        if ws := list(set(ws)):
            g = np.unique(grams(ws)[0])
            counts["gram"][y, g[g >= 0]] += 1
            counts["word"][y, np.unique(word_slots(ws))] += 1
    n = np.bincount(toxic, minlength=2)
    out = {}
    for name, c in counts.items():
        odds = np.log((c[1] + 0.5) / (n[1] + 1)) - np.log((c[0] + 0.5) / (n[0] + 1))
        out[name] = (odds * c.sum(0) / (c.sum(0) + 4) / 4).astype(np.float32)
    return out


def inputs(words: list[bytes], model: Model) -> np.ndarray:
    """The network's input for each word."""
    found, starts = grams(words)
    lean = np.where(found >= 0, model["gram"][found], 0)
    there = np.maximum(1, np.add.reduceat((found >= 0).sum(1), starts))
    slots = word_slots(words)
    signs = (slots[:, None] * np.array([2654435761, 40503, 2246822519, 3266489917]) >> 13 & 1) * 0.2 - 0.1
    top, mean = np.maximum.reduceat(lean.max(1), starts), np.add.reduceat(lean.sum(1), starts) / there
    return np.column_stack([top, mean, model["word"][slots], signs]).astype(np.float32)


def fresh_network(rng: np.random.Generator) -> Model:
    h, net = HIDDEN, {}
    for way in "fb":
        net |= {f"x{way}": rng.normal(0, 0.5, (INPUTS, 3 * h)), f"h{way}": rng.normal(0, 0.3, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
    net |= {"u": rng.normal(0, 0.4, (2 * h, h)), "v": rng.normal(0, 0.4, h), "w": rng.normal(0, 0.4, 2 * h), "b": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in net.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_way(gates, here: np.ndarray, net: Model, way: str, keep: list | None = None) -> np.ndarray:
    """States (time, window, HIDDEN) of one direction. gates(t): the inputs' share of the gates at time t."""
    steps, n = here.shape
    h, states = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32)
    whole = here.all(1)
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        gx, gh = gates(t), h @ net[f"h{way}"]
        zr = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        after = new + z * (h - new)
        if not whole[t]:
            after = np.where(here[t][:, None], after, h)
        if keep is not None:
            keep.append((t, h, z, r, new, gh[:, 2 * HIDDEN :]))
        h = states[t] = after
    return states


def pool(states: np.ndarray, here: np.ndarray, net: Model) -> tuple[np.ndarray, ...]:
    """Attention over time: logits of the windows, and what the gradient needs."""
    bent = np.tanh(states @ net["u"])
    e = np.where(here, bent @ net["v"], -1e9)
    a = np.exp(e - e.max(0))
    a /= a.sum(0)
    s = np.einsum("tn,tnh->nh", a, states)
    return s @ net["w"] + net["b"][0], bent, a, s


def gradient(x: np.ndarray, here: np.ndarray, y: np.ndarray, net: Model) -> Model:
    """Of the mean log loss over windows x (time, window, INPUTS)."""
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([run_way(lambda t, w=w: x[t] @ net[f"x{w}"] + net[f"c{w}"], here, net, w, kept[w]) for w in "fb"], 2)
    logit, bent, a, s = pool(states, here, net)
    d = (_sigmoid(logit) - y) / len(y)
    g = {"w": s.T @ d, "b": np.array([d.sum()])}
    ds = d[:, None] * net["w"]
    da = np.einsum("nh,tnh->tn", ds, states)
    de = a * (da - (a * da).sum(0))
    dbent = de[:, :, None] * net["v"] * (1 - bent**2)
    g |= {"v": np.einsum("tn,tnk->k", de, bent), "u": np.einsum("tnh,tnk->hk", states, dbent)}
    dstates = a[:, :, None] * ds + dbent @ net["u"].T
    for k, way in enumerate("fb"):
        gx, gh, gc = np.zeros_like(net[f"x{way}"]), np.zeros_like(net[f"h{way}"]), np.zeros_like(net[f"c{way}"])
        dh = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, h, z, r, new, hn in reversed(kept[way]):
            dh = dh + dstates[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            live = here[t][:, None]
            dn = np.where(live, dh * (1 - z) * (1 - new**2), 0)
            dz = np.where(live, dh * (h - new) * z * (1 - z), 0)
            dr = dn * hn * r * (1 - r)
            out, back = np.concatenate([dz, dr, dn], 1), np.concatenate([dz, dr, dn * r], 1)
            gx += x[t].T @ out
            gc += out.sum(0)
            gh += h.T @ back
            dh = np.where(live, dh * z, dh) + back @ net[f"h{way}"].T
        g |= {f"x{way}": gx, f"h{way}": gh, f"c{way}": gc}
    return g


def starts_of(n: int) -> list[int]:
    """Where the windows of n words begin; the last one ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def windows(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (window, time), -1 beyond a short text's end, and the text of each window."""
    out, of = [], []
    for k, r in enumerate(rows):
        if len(r):
            at = np.array(starts_of(len(r)))[:, None] + np.arange(WINDOW)
            out.append(np.where(at < len(r), r[np.minimum(at, len(r) - 1)], -1))
            of.append(np.full(len(at), k))
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros((0, WINDOW), np.int64), np.zeros(0, np.int64))


def window_logits(numbers: np.ndarray, shares: np.ndarray, net: Model) -> np.ndarray:
    """Logits of windows; shares: the inputs' share of both directions' gates, by word number."""
    out = []
    for k in range(0, len(numbers), 2048):
        part = np.ascontiguousarray(numbers[k : k + 2048].T)
        here = part >= 0
        ways = [run_way(lambda t, c=c: shares[part[t], c * 3 * HIDDEN : (c + 1) * 3 * HIDDEN], here, net, w) for c, w in enumerate("fb")]
        out.append(pool(np.concatenate(ways, 2), here, net)[0])
    return np.concatenate(out) if out else np.zeros(0)


def shares_of(x: np.ndarray, net: Model) -> np.ndarray:
    return np.concatenate([x @ net[f"x{w}"] + net[f"c{w}"] for w in "fb"], 1).astype(np.float32)


def train(texts: list[str], toxic: list[int], rounds: int = 5, epochs: int = 3, batch: int = 64) -> Model | None:
    """The model, or None without rows of both kinds. Repeatable: all choices come from one seed."""
    rng, y = np.random.default_rng(SEED), np.array(toxic, int)
    cut = [words_of(t) for t in texts]
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        half[own[: len(own) // 2]] = True
    if min(np.bincount(y[half], minlength=2)) < 1 or min(np.bincount(y[~half], minlength=2)) < 1:
        return None
    model = leanings([c for c, h in zip(cut, half, strict=True) if h], y[half])
    learn = [c for c, h in zip(cut, half, strict=True) if not h]
    labels = y[~half]
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in c], np.int64) for c in learn]
    x = inputs(list(number), model)
    numbers, of = windows(rows)
    net = fresh_network(rng)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    lean = x[:, 0] + x[:, 2]
    score = np.where(numbers >= 0, lean[numbers], -9).max(1)
    step = 0
    for turn in range(rounds):
        if turn:
            score = window_logits(numbers, shares_of(x, net), net)
        order = np.lexsort((score, of))
        top = order[np.flatnonzero(np.append(of[order][1:] != of[order][:-1], True))]
        clean = np.flatnonzero(labels[of] == 0)
        bad = top[labels[of[top]] == 1]
        more = rng.choice(clean, min(len(clean), len(bad)), replace=False)
        use = np.concatenate([top, more, *[bad] * max(1, (labels == 0).sum() // max(1, 2 * len(bad)))])
        for _ in range(epochs):
            use = rng.permutation(use)
            for k in range(0, len(use), batch):
                part = numbers[use[k : k + batch]].T
                g = gradient(np.where((part >= 0)[:, :, None], x[part], 0), part >= 0, labels[of[use[k : k + batch]]], net)
                norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
                step += 1
                for name, v in g.items():
                    m, q = state[name]
                    v = v * min(1, 5 / max(norm, 1e-9))
                    m += 0.1 * (v - m)
                    q += 0.01 * (v * v - q)
                    net[name] -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    logit = window_logits(numbers, shares_of(x, net), net)
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, of, logit)
    clean, bad = best[(labels == 0) & np.isfinite(best)], best[(labels == 1) & np.isfinite(best)]
    if len(clean) and len(bad):  # the threshold goes midway between the kinds
        net["b"] -= np.float32((np.quantile(clean, 0.999) + np.quantile(bad, 0.01)) / 2)
    return net | leanings(cut, y)


class Scorer:
    """A model with the gate shares of the words met so far, in a table of fixed size."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.number: dict[bytes, int] = {}
        self.shares = np.empty((KNOWN_WORDS, 6 * HIDDEN), np.float32)

    def score(self, texts: list[str | None]) -> list[float]:
        cut = [words_of(t) for t in texts]
        words = set().union(*cut)
        fresh = [w for w in words if w not in self.number]
        if len(self.number) + len(fresh) > len(self.shares):
            self.number, fresh = {}, list(words)
            if len(fresh) > len(self.shares):
                self.shares = np.empty((len(fresh), 6 * HIDDEN), np.float32)
        for k in range(0, len(fresh), 1 << 14):
            some, n = fresh[k : k + (1 << 14)], len(self.number)
            self.shares[n : n + len(some)] = shares_of(inputs(some, self.model), self.model)
            self.number |= zip(some, range(n, n + len(some)), strict=True)
        numbers, of = windows([np.fromiter(map(self.number.__getitem__, c), np.int64, len(c)) for c in cut])
        out = np.zeros(len(texts))
        np.maximum.at(out, of, _sigmoid(window_logits(numbers, self.shares, self.model).astype(np.float64)))
        return out.tolist()


def _score_rows(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                score = scorer.score(part.column(1).to_pylist()) if scorer else [0.0] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def held_out(doc_id) -> F.Column:
    """Whether a row's labels are kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """Train from at most most_rows rows, a third of them toxic if there are so many; only their texts come to the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("turn", F.xxhash64("doc_id"))
    chosen = known.filter("y = 1").orderBy("turn", "doc_id").limit(most_rows // 3).union(known.filter("y = 0").orderBy("turn", "doc_id").limit(most_rows - most_rows // 3))
    picked = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "turn", "y").agg(F.max("text").alias("text"))  # an id counts once
    rows = sorted((r.turn, r.doc_id, r.text, r.y) for r in picked.collect())
    return train([r[2] for r in rows], [r[3] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    model = fit(docs, labels, most_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_score_rows(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns as they were."""
    bad = toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
