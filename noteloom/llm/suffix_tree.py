"""Language-model scores from a probabilistic suffix tree over tokens.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end for each text. The tree's root
is the add-0.1 unigram distribution. Contexts of one or two tokens, of all words, are candidates; a next token
is one if it follows its context LEAST times or more. No bound depends on the size of the corpus.
A context is retained if its next-token distribution diverges from that of its suffix: its count times
the Kullback-Leibler divergence must reach DIVERGENCE, over the next tokens that pass a test of their
own. Their probabilities are discounted; all others have the suffix's, scaled so that all sum to one. A
token is scored in the state of the longest retained suffix of what precedes it, else in the root.

Jobs: one pass over the texts writes each block's dictionary and its texts as numbers of that dictionary;
counts of all words are one aggregation of the dictionaries, and go back to the blocks by a join with them,
so a word travels once per block and not once per occurrence. A block's ids and counts are one packed row from there on. Each block then sends its distinct triples,
packed, to owners of their last two tokens; an owner sums them and notes which blocks have what reaches LEAST.
Tests and states are joins and aggregations of the tables of these, and what is retained goes back by the
owners' notes, so that each block gets the part of the tree that it needs. build_tree() is the same on one
machine, for tests.

Defined results: null and blank texts are one end token; a null id counts as not held out; repeated rows
are each counted and scored; without training rows N and V are 0 and scores are those of the root;
an empty table gives an empty result; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import discard, slices, stored, table, tidy, tidy_group, tidy_groups

END = "\n"
LEAST = 3
DIVERGENCE = 20.0
TEST = 6.0
DISCOUNT = 0.5
BLOCK_CHARS = 16_000_000
BLOCK_WORDS = 1_000_000  # the cube of a block's words must fit in 63 bits
OWNER_TOKENS = 2_000_000
RUN_TOKENS = 200_000  # scored at a time

Tree = dict[str, np.ndarray]


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END.encode()]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers, and the dictionary of each block with its counts in training texts."""
    task, turn = TaskContext.get().partitionId(), 0
    number: dict[bytes, int] = {}
    trained, size = [], 0

    def dictionary() -> pa.RecordBatch:
        seen = np.bincount(np.concatenate(trained), minlength=len(number)) if trained else np.zeros(len(number), np.int64)
        n = len(number)
        words = pa.array([w.decode() for w in number], pa.string())
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *empty, pa.array(range(n), pa.int32()), words, pa.array(seen, pa.int64())], names)

    names = ["block", "doc_id", "held_out", "n_tokens", "numbers", "place", "word", "n"]
    block = task << 24
    for part in (x for batch in batches for x in slices(batch, 2, BLOCK_CHARS // 4)):
        ids, held, texts = (c.to_pylist() for c in part.columns)
        packed, sizes, begin = [], [], 0
        for k, text in enumerate(texts):
            seq = np.array([number.setdefault(w, len(number)) for w in tokens(text)], np.uint32)
            if not held[k]:
                trained.append(seq)
            packed.append(_pack(seq))
            sizes.append(len(seq))
            size += len(text or "")
            full = size > BLOCK_CHARS or len(number) > BLOCK_WORDS
            if full or k == len(texts) - 1:
                n = len(packed)
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(ids[begin : k + 1], pa.int64()), pa.array(held[begin : k + 1], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), *empty], names)
                packed, sizes, begin = [], [], k + 1
            if full:
                yield dictionary()
                turn += 1
                block, number, trained, size = task << 24 | turn, {}, [], 0
    if number:
        yield dictionary()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers below 2^32, byte by byte, so that their high bytes shrink."""
    sides = [np.ascontiguousarray(x, np.uint32) for x in arrays]
    planes = [x.view(np.uint8).reshape(-1, 4).T.tobytes() for x in sides]
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(x) for x in sides], np.uint32).tobytes() + b"".join(planes))


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(packed), [], 4 * n
    for size in np.frombuffer(raw, np.uint32, n).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64))
        at += 4 * size
    return out


VALUED = "block long, ids binary, counts binary"


def _valued(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's dictionary as one row: ids and counts of its words, by place."""
    rows = rows.sort_values("place")
    ids, counts = _pack(rows["id"].to_numpy()), zstandard.compress(rows["c"].to_numpy(np.int64).tobytes(), 1)
    return pd.DataFrame([(rows["block"].iloc[0], ids, counts)], columns=["block", "ids", "counts"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, id) of the words that have an id, from rows of _valued()."""
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = _unpack(packed.as_py(), 1)[0]
            place = np.flatnonzero(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), block, np.int64)), pa.array(place), pa.array(ids[place])], ["block", "place", "id"])


def _triples(owners: int):
    """Distinct (a, b, c) in a row in a block's texts, as ids (a is 0 where there is none), with their counts in training."""

    def run(words: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        ids = _unpack(words["ids"].iloc[0], 1)[0] if len(words) else np.zeros(0, np.int64)
        known, rank = np.unique(np.concatenate([[0], ids]), return_inverse=True)
        m, rank = len(known), rank[1:]
        seqs = [rank[_unpack(x, 1)[0]] for x in docs["numbers"]]
        if not seqs:
            return pd.DataFrame({"owner": [], "block": [], "keys": []})
        b = np.concatenate([np.concatenate([x[-1:], x[:-1]]) for x in seqs])
        a = np.concatenate([np.concatenate([[0], x[-1:], x[:-2]])[: len(x)] for x in seqs])
        c = np.concatenate(seqs)
        train = np.repeat(~docs["held_out"].to_numpy(bool), [len(x) for x in seqs])
        both = (b > 0) & (c > 0)
        keyed = ((b[both] * m + c[both]) * m + a[both]).astype(np.uint64) << np.uint64(1) | train[both]
        keyed.sort()
        code = keyed >> np.uint64(1)
        starts = np.flatnonzero(np.diff(code, prepend=~np.uint64(0)))
        n = np.add.reduceat((keyed & np.uint64(1)).astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
        code = code[starts].astype(np.int64)
        pair, a = code // m, known[code % m]
        b, c = known[pair // m], known[pair % m]
        mixed = (b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        owner = ((mixed >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
            begins = np.flatnonzero(np.diff(pair[part], prepend=-1))
            first = part[begins]
            out.append((owner[part[0]], docs["of"].iloc[0], _pack(np.diff(b[first], prepend=0), c[first], np.diff(begins, append=len(part)), a[part], n[part])))
        return pd.DataFrame(out, columns=["owner", "block", "keys"])

    return run


GRAMS = "owner long, block long, g long, a long, b long, c long, n long, keys binary"


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes that reach LEAST, and their sums."""
    found = np.concatenate(codes)
    order = np.argsort(found, kind="stable")  # codes of a block are sorted
    found = found[order]
    begins = np.flatnonzero(np.diff(found, prepend=-1))
    n = np.add.reduceat(np.concatenate(counts)[order], begins) if len(begins) else np.zeros(0, np.int64)
    return found[begins][n >= LEAST], n[n >= LEAST]


def _among(wanted: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in found (sorted) of what is wanted, -1 where it isn't there."""
    if not len(found):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
    return np.where(found[at] == wanted, at, -1)


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs (a is 0) and triples that reach LEAST, numbered by g, and for each block (n is 0) which of them it has."""
    pairs, counts, more = [], [], []
    for packed in rows["keys"]:
        b, c, runs, a, n = _unpack(packed, 5)
        pairs.append(np.cumsum(b) << 32 | c)
        counts.append(np.add.reduceat(n, np.cumsum(runs) - runs))
        more.append((runs, a, n))
    two, n2 = _summed(pairs, counts)
    own, codes, counts = [], [], []
    for pair, (runs, a, n) in zip(pairs, more, strict=True):
        at = _among(pair, two)
        each = np.repeat(at, runs)
        stays = (each >= 0) & (a > 0)
        own.append(at[at >= 0])
        codes.append(each[stays] << 32 | a[stays])
        counts.append(n[stays])
    three, n3 = _summed(codes, counts)
    lists = []
    for at, code in zip(own, codes, strict=True):
        found = _among(code, three)
        lists.append(_pack(np.diff(at, prepend=0), np.diff(found[found >= 0], prepend=0)))
    pair = np.concatenate([two, two[three >> 32]])
    k, owner = len(pair), rows["owner"].iloc[0]
    grams = {"owner": owner, "block": -1, "g": np.concatenate([np.arange(len(two)), np.arange(len(three))]), "a": np.concatenate([np.zeros(len(two), np.int64), three & 0xFFFFFFFF]), "b": pair >> 32, "c": pair & 0xFFFFFFFF, "n": np.concatenate([n2, n3])}
    noted = pd.DataFrame({"owner": owner, "block": rows["block"].to_numpy(), "g": 0, "a": 0, "b": 0, "c": 0, "n": 0, "keys": lists})
    return pd.concat([pd.DataFrame(grams | {"keys": [None] * k}), noted]) if k else noted


def _sent(parts: pd.DataFrame, noted: pd.DataFrame) -> pd.DataFrame:
    """What of the parts of the tree (kind, g, x, y, z, value) each block has."""
    sides = {}
    for kind, own in parts.groupby("kind"):
        own = own.sort_values("g")
        sides[kind] = [own[k].to_numpy() for k in ("g", "x", "y", "z", "value")]
    out = []
    for block, packed in zip(noted["block"], noted["keys"], strict=True):
        two, three = (np.cumsum(x) for x in _unpack(packed, 2))
        for kind, (g, x, y, z, value) in sides.items():
            at = _among(three if kind == 4 else two, g)
            at = at[at >= 0]
            if len(at):
                out.append((block, kind, _pack(x[at], y[at], z[at]), zstandard.compress(value[at].tobytes(), 1)))
    return pd.DataFrame(out, columns=["block", "kind", "keys", "floats"])


def _tested(candidates: DataFrame) -> DataFrame:
    """Candidates (n, total, before) with p, their discounted probability; null if they fail the test of their own."""
    expected = F.col("total") * F.col("before")
    gain = F.col("n") * F.log(F.col("n") / expected) - (F.col("n") - expected)
    return candidates.withColumn("p", F.when(gain >= TEST, (F.col("n") - DISCOUNT) / F.col("total"))).drop("n")


def _states(tested: DataFrame, context: list[str], name: str) -> DataFrame:
    """As _grow(): the retained contexts with scale."""
    sums = tested.filter("p IS NOT NULL").groupBy(*context).agg(F.max("total").alias("total"), F.sum("p").alias("own"), F.sum("before").alias("suffix"), F.sum(F.col("p") * F.log(F.col("p") / F.col("before"))).alias("part"))
    rest, other = F.greatest(1 - F.col("own"), F.lit(1e-9)), 1 - F.least(F.col("suffix"), F.lit(1 - 1e-9))
    stays = sums.filter(F.col("total") * (F.col("part") + rest * F.log(rest / other)) >= DIVERGENCE)
    return stored(stays.select(*context, F.log10(rest / other).alias("scale")), name)


def _tree(grams: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """States of one token (id, value), and owner, kind (2: entries after one token, 3: states of two, 4: their entries), g, x, y, z (ids), value;
    and the tables that both are read from."""
    pairs, threes = grams.filter("n > 0 AND a = 0").drop("block", "keys", "a"), grams.filter("n > 0 AND a > 0").drop("block", "keys")
    of_c = roots.select(F.col("id").alias("c"), "root")
    one = pairs.join(roots.select(F.col("id").alias("b"), F.col("seen").alias("total")), "b").join(of_c, "c")
    tested = stored(_tested(one.withColumn("before", F.pow(F.lit(10.0), "root"))), "one")
    s1 = _states(tested, ["b"], "one-states")
    lp = F.when(F.col("scale").isNotNull(), F.log10("p"))
    after = F.coalesce(lp, F.coalesce("scale", F.lit(0.0)) + F.col("root"))
    one = stored(tested.join(s1, "b", "left").select("b", "c", "owner", "g", lp.alias("lp"), after.alias("after")), "one-after")
    discard(grams.sparkSession, tested)
    contexts = pairs.select(F.col("b").alias("a"), F.col("c").alias("b"), F.col("n").alias("total"), "owner", "g")
    # every triple's last two tokens are a pair, whose probability in the shorter state is what the triple is tested against
    two = threes.join(contexts.drop("owner", "g"), ["a", "b"]).join(one.select("b", "c", "after"), ["b", "c"])
    two = _tested(two.withColumn("before", F.pow(F.lit(10.0), "after")).drop("after"))
    two = stored(two.filter("p IS NOT NULL"), "two")
    discard(grams.sparkSession)
    s2 = _states(two, ["a", "b"], "two-states")
    e2 = two.join(s2, ["a", "b"], "left_semi").withColumn("lp", F.log10("p"))
    zero = F.lit(0).cast("long")
    part = lambda df, kind, x, y, z, value: df.select("owner", F.lit(kind).alias("kind"), "g", F.col(x).alias("x"), F.col(y).alias("y"), z.alias("z"), F.col(value).alias("value"))
    e1 = part(one.filter("lp IS NOT NULL"), 2, "b", "c", zero, "lp")
    parts = e1.unionByName(part(s2.join(contexts, ["a", "b"]), 3, "a", "b", zero, "scale")).unionByName(part(e2, 4, "a", "b", F.col("c"), "lp"))
    return s1.select(F.col("b").alias("id"), F.col("scale").alias("value")), parts, [s1, one, two, s2]


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values at wanted keys (keys are sorted), nan where there is none."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.nan)


def _grow(context: np.ndarray, count: np.ndarray, n: np.ndarray, code: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of candidate next tokens (sorted by context): what is retained. before: the suffix's probability of each.

    Returns the retained contexts, their log10 scale of other tokens, and the entries' codes and log10 probabilities.
    """
    expected = count * before
    gain = n * np.log(n / expected) - (n - expected)
    keep = gain >= TEST
    context, count, n, code, before = (x[keep] for x in (context, count, n, code, before))
    if not len(context):
        return tuple(np.zeros(0, t) for t in (np.int64, float, np.int64, float))
    p = (n - DISCOUNT) / count
    states, at = np.unique(context, return_inverse=True)
    own, suffix = np.bincount(at, p), np.minimum(np.bincount(at, before), 1 - 1e-9)
    rest = np.maximum(1 - own, 1e-9)
    divergence = np.bincount(at, p * np.log(p / before)) + rest * np.log(rest / (1 - suffix))
    total = np.zeros(len(states))
    total[at] = count
    stays = total * divergence >= DIVERGENCE
    scale = np.log10(rest / (1 - suffix))
    inside = stays[at]
    return states[stays], scale[stays], code[inside], np.log10(p[inside])


def build_tree(codes: np.ndarray, n: np.ndarray, counts: np.ndarray, root: np.ndarray) -> Tree:
    """The tree over symbols 0..m-1 with their training counts and root log10 probabilities.

    codes: a*m+b for pairs, ((a+1)*m+b)*m+c for triples; n: their counts. Sorted by code.
    """
    m = len(counts)
    two = codes < m * m
    c2, n2 = codes[two], n[two]
    c3, n3 = codes[~two] - m * m, n[~two]
    s1, scale1, e1, p1 = _grow(c2 // m, counts[c2 // m], n2, c2, 10 ** root[c2 % m])
    tree = {"s1": s1, "scale1": scale1, "e1": e1, "p1": p1}
    total = _look(c2, n2.astype(float), c3 // m)
    known = ~np.isnan(total)
    c3, n3, total = c3[known], n3[known], total[known]
    before = 10 ** _depth_one(tree, c3 // m % m, c3 % m, root[c3 % m], m)
    s2, scale2, e2, p2 = _grow(c3 // m, total, n3, c3, before)
    return tree | {"s2": s2, "scale2": scale2, "e2": e2, "p2": p2, "m": np.array(m)}


def _depth_one(tree: Tree, last: np.ndarray, token: np.ndarray, root: np.ndarray, m: int) -> np.ndarray:
    """log10 probability after one token of context (-1: not a symbol)."""
    state = _find(tree, "s1", last)
    out, inside = root.astype(float), np.flatnonzero(state >= 0)
    out[inside] += tree["scale1"][state[inside]]
    inside = inside[token[inside] >= 0]
    entry = _find(tree, "e1", last[inside] * m + token[inside])  # only states have entries
    out[inside[entry >= 0]] = tree["p1"][entry[entry >= 0]]
    return out


def score(tree: Tree, symbols: np.ndarray, root: np.ndarray, end: int) -> np.ndarray:
    """log10 probability of each token of a text, in the state of its longest retained context."""
    return score_all(tree, symbols, root, end, np.zeros(1, np.int64))


def score_all(tree: Tree, symbols: np.ndarray, root: np.ndarray, end: int, begins: np.ndarray) -> np.ndarray:
    """score() of the tokens of texts that follow one another and begin at begins."""
    m = int(tree["m"])
    last, first = np.roll(symbols, 1), np.roll(symbols, 2)
    last[begins] = end
    first[begins[begins + 1 < len(symbols)] + 1] = end
    first[begins] = -1  # last, for a text of one token is followed by another's first
    pair = np.where((first >= 0) & (last >= 0), first * m + last, -1)
    out, state = np.full(len(symbols), np.nan), _find(tree, "s2", pair)
    inside = np.flatnonzero((state >= 0) & (symbols >= 0))
    entry = _find(tree, "e2", pair[inside] * m + symbols[inside])
    out[inside[entry >= 0]] = tree["p2"][entry[entry >= 0]]
    rest = np.flatnonzero(np.isnan(out))
    state, one = state[rest], _depth_one(tree, last[rest], symbols[rest], root[rest], m)
    scale = np.zeros(len(rest))
    scale[state >= 0] = tree["scale2"][state[state >= 0]]
    out[rest] = scale + one
    return out


def _find(tree: Tree, name: str, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys, -1 where there is none. The index of the keys is made once for a tree."""
    if not len(tree[name]):
        return np.full(len(wanted), -1)
    if f"{name} index" not in tree:
        tree[f"{name} index"] = pd.Index(tree[name])
    return tree[f"{name} index"].get_indexer(wanted)


def _runs(seqs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """seqs in turn, so many at a time as have RUN_TOKENS tokens, one at least."""
    held, n = [], 0
    for x in seqs:
        held.append(x)
        n += len(x)
        if n >= RUN_TOKENS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _scorer(total: int, distinct: int):
    low = np.log10(total + 0.1 * (distinct + 1)) if total else 0.0

    def run(rows: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        kind = rows["kind"].to_numpy()
        words = rows[kind == 0].iloc[0]
        count, ids = np.frombuffer(unpack(words["floats"]), np.int64), _unpack(words["keys"], 1)[0]
        by_id, m = np.argsort(ids), len(count)
        place = lambda x: by_id[np.searchsorted(ids, x, sorter=by_id)]
        tree = {"m": np.array(m)}
        states = rows[kind == 1].sort_values("place")
        tree |= {"s1": states["place"].to_numpy(np.int64), "scale1": states["scale"].to_numpy(float)}
        for k, (keys, values) in enumerate((("e1", "p1"), ("s2", "scale2"), ("e2", "p2")), 2):
            own = rows[kind == k]
            sides = [_unpack(x, 3) for x in own["keys"]]
            x, y, z = (place(np.concatenate([side[i] for side in sides])) if sides and (i < 2 or k == 4) else np.zeros(0, np.int64) for i in range(3))
            code = x * m + y
            code = code * m + z if k == 4 else code
            value = np.frombuffer(b"".join(unpack(x) for x in own["floats"]), float)
            order = np.argsort(code)
            tree |= {keys: code[order], values: value[order]}
        root = np.log10(count + 0.1) - low
        out = []
        for some in _runs(_unpack(x, 1)[0] for x in docs["numbers"]):
            symbols, begins = np.concatenate(some), np.cumsum([0] + [len(x) for x in some[:-1]])
            r = root[symbols]
            found, end = score_all(tree, symbols, r, int(symbols[-1]), begins), begins + [len(x) for x in some]
            known = np.add.reduceat(count[symbols] > 0, begins, dtype=np.int64)
            out += [(int(k), float(r[x:y].sum()), float(found[x:y].sum())) for k, x, y in zip(known, begins, end, strict=True)]
        docs = docs.assign(**{k: [x[i] for x in out] for i, k in enumerate(("n_known", "base_score", "score"))})
        return docs[["doc_id", "no_id", "held_out", "n_tokens", "n_known", "base_score", "score"]]

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    blocks = stored(rows.mapInArrow(tidy(_blocks), "block long, doc_id long, held_out boolean, n_tokens long, numbers binary, place int, word string, n long"), "blocks")
    words = blocks.filter("word IS NOT NULL").select("block", "place", "word", "n")
    summed = words.groupBy("word").agg(F.sum("n").alias("c")).sortWithinPartitions(F.desc("c"))
    counts = stored(summed.withColumn("row", F.monotonically_increasing_id()), "counts")
    part, rank = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    total, distinct, parts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.max(part), F.lit(0)) + 1).first()
    counts = counts.select("word", "c", F.when(F.col("c") >= LEAST, rank * parts + part + 1).otherwise(0).alias("id"))  # frequent words have small ids
    discard(docs.sparkSession)
    valued = words.join(counts, "word").select("block", F.col("place").cast("long").alias("place"), "c", "id")
    valued = stored(valued.groupBy("block").applyInPandas(tidy_group(_valued), VALUED), "valued")
    texts = blocks.filter("numbers IS NOT NULL").select(F.col("block").alias("of"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.isnull("doc_id").alias("no_id"), "held_out", "n_tokens", "numbers")
    texts = stored(texts, "texts")
    discard(docs.sparkSession, blocks)
    found = valued.select("block", "ids").groupBy("block").cogroup(texts.select("of", "held_out", "numbers").groupBy("of"))
    triples = found.applyInPandas(tidy_groups(_triples(total // OWNER_TOKENS + 1)), "owner long, block long, keys binary")
    grams = stored(triples.groupBy("owner").applyInPandas(tidy_group(_counted), GRAMS), "grams")
    discard(docs.sparkSession)
    low = F.lit(float(np.log10(total + 0.1 * (distinct + 1))) if total else 0.0)
    roots = counts.filter("id > 0").select("id", F.col("c").alias("seen"), (F.log10(F.col("c") + 0.1) - low).alias("root"))
    s1, parts, tables = _tree(grams, roots)
    noted = grams.filter("n = 0").select(F.col("owner").alias("from"), "block", "keys")
    sent = parts.groupBy("owner").cogroup(noted.groupBy("from")).applyInPandas(tidy_groups(_sent), "block long, kind int, keys binary, floats binary")
    sent = stored(sent, "sent")
    none = F.lit(None).cast("binary")
    discard(docs.sparkSession, grams, counts, *tables[1:])
    frequent = valued.select("block", "ids").mapInArrow(tidy(_frequent), "block long, place long, id long")  # rare words (id 0) are no states, and would be one hot key
    no_place, no_scale = F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("scale")
    rows = valued.select("block", F.lit(0).alias("kind"), no_place, no_scale, F.col("ids").alias("keys"), F.col("counts").alias("floats"))
    rows = rows.unionByName(frequent.join(s1, "id").select("block", F.lit(1).alias("kind"), "place", F.col("value").alias("scale"), none.alias("keys"), none.alias("floats")))
    rows = rows.unionByName(sent.select("block", "kind", no_place, no_scale, "keys", "floats"))
    scored = rows.groupBy("block").cogroup(texts.groupBy("of")).applyInPandas(
        tidy_groups(_scorer(total, distinct)), "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    doc_id = F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id")
    return scored.select(doc_id, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
