"""MinHash near-dedup by an inverted join of signature coordinates.

A document's set is its distinct 5-word shingles. Documents of equal sets form a class, and classes are
compared by one of their members. A signature has COORDINATES values, each hashed from FOLD minima, and a class
is posted under each coordinate-value pair that other classes have too. A pair is a candidate if at least MATCHES
coordinates collide; at similarity 0.85 fewer than 6 of 32 do with probability 1e-7.

1. Prefix: a class stays in its rarest lists only. It skips its MATCHES - 1 longest ones, for a pair that
   collides in MATCHES lists meets in one of the others too; who has fewer than MATCHES lists is in none.
2. Lists are merged by their leader, the class that is in the most and longest lists: collisions of the leader
   and each member are counted over all lists, and those that collide LEADS times or more join a family.
3. Within a family no pairs are made. Its centre is the set of shingles that more than half of it has, and a class is
   known by its difference from the centre. Two classes whose differences are small are similar enough whatever
   they are; any other pair must share so many elements of their differences that it meets under one of the rarest
   of each, at a place that still leaves enough (prefix and position filter). Pairs that do are compared
   exactly: the difference of two sets is that of their differences. Classes that are far from the centre and
   share a difference (a second version of a text and its copies) don't meet in its list: they are a family of their own, with
   their own centre, and so on; it has at most half of the classes, so there are few levels. Small families are done
   in one task each; of large ones, classes, elements and pairs are rows.
4. Classes that meet in a list but are of different families are counted one by one: those with MATCHES
   collisions are compared on full sets. A list with more than FEW_PAIRS such pairs is posted again under
   a further coordinate-value pair, which splits it. A class that has MATCHES collisions with some member of a family of
   VISITED classes or more is not paired with its members: it visits the family, and step 3 finds its links there.

Defined results: null or blank text has the empty set, links with nothing and stays; equal texts and
repeated rows are linked (all rows that share the smallest id stay); a row with null id joins its group
but never names it unless all ids are null; empty tables give empty results; further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import sent, slices, spread, spread_by_hash, stored, table, tidy

WORDS = 5
SIMILARITY = (85, 100)
COORDINATES = 32
FOLD = 3
MATCHES = 6
LEADS = 2
FEW_PAIRS = 1 << 20
FAMILY = 256  # classes of a family that one task may hold
FAMILY_SHINGLES = 500_000  # and their shingles
VISITED = 16  # classes of a family that others visit
MOST_LINKS = 1 << 17  # that one task may label
SEED = 11
SLICE_BYTES = 1_000_000
NO_ID = (1 << 63) - (1 << 41)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _Q
    return (x ^ (x >> np.uint64(29))) * _P


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text. Words are split at ASCII white space after lower-casing A-Z."""
    cut = [(t or "").encode().lower().split() for t in texts]
    sizes = [len(x) for x in cut]
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in cut for w in ws), np.uint64, sum(sizes))
    n = max(0, len(words) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled = rolled * _P + _mix(words[k : k + n])
    rolled = _mix(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= WORDS:
            out.append(np.unique(rolled[at : at + size - WORDS + 1]))
        elif size:
            whole = np.full(1, size, np.uint64)
            for w in _mix(words[at : at + size]):
                whole = whole * _Q + w
            out.append(_mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES values for each (non-empty) set."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, COORDINATES * FOLD, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, COORDINATES * FOLD, dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    for k in range(COORDINATES * FOLD):
        x = flat * a[k]
        x += b[k]
        x >>= np.uint64(16)
        c = k // FOLD
        out[:, c] = _mix(out[:, c] * _Q + np.minimum.reduceat(x, starts) + np.uint64(c))
    return out.view(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id and text; rows without an id get one above NO_ID that depends on the text."""
    stand_in = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), stand_in).alias("doc_id"), "text")


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """128 bits of each whole set, as two columns."""
    both = np.frombuffer(b"".join(blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(both[:, k])) for k in range(2)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            sets = shingle_sets(part.column(1).to_pylist())
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = np.zeros((len(sets), COORDINATES), np.int64)
            if full:
                keys[full] = signatures([sets[k] for k in full])
            sizes = pa.array([len(s) for s in sets], pa.int64())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, COORDINATES), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, *_digests(sets), rows], ["doc_id", "n_shingles", "h1", "h2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed sets of the rows (cls, text, ...)."""
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            members = pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist())], pa.binary())
            rest = [part.column(k) for k in range(2, part.num_columns)]
            yield pa.RecordBatch.from_arrays([part.column(0), members, *rest], ["cls", "members", *part.schema.names[2:]])


def _sets_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted (cls, and columns of whole numbers) with members, a row for each row of docs that has the id cls. How they meet
    is wanted's to say (sent() or spread_by_hash())."""
    rest = [c for c in wanted.columns if c != "cls"]
    texts = _named(docs).select(F.col("doc_id").alias("cls"), "text").join(wanted, "cls").select("cls", "text", *rest)
    return texts.mapInArrow(tidy(_sets), "cls long, members binary" + "".join(f", {c} long" for c in rest))


def _excess(d, n, similarity: tuple[int, int]):
    """Sets of n shingles that differ from the centre in d: x and y are linked if their excesses sum to at most share(similarity) times
    the elements that both differences have."""
    part, whole = similarity
    return d * (whole + part) - n * (whole - part)


def _share(similarity: tuple[int, int]) -> int:
    return 2 * sum(similarity)


def family_links(ids: list[int], sets: list[np.ndarray], similarity: tuple[int, int], sizes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is similar enough among a few sets, by their differences from the centre. Of sets that are
    themselves differences from one set, sizes are those of what they stand for."""
    n, held, share = len(sets), np.array([len(s) for s in sets]), _share(similarity)
    sizes = held if sizes is None else sizes
    values, element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), held)
    common = df * 2 > n
    place = np.cumsum(common) - 1
    has = np.zeros((n, int(common.sum())), bool)
    inside = common[element]
    has[owner[inside], place[element[inside]]] = True
    lacks, which = np.nonzero(~has)
    owner = np.concatenate([owner[~inside], lacks])
    often = np.concatenate([df[element[~inside]], n - df[common][which]])
    element = np.concatenate([element[~inside], np.flatnonzero(common)[which]])
    order = np.lexsort((element, often, owner))
    owner, often, element = owner[order], often[order], element[order]
    d = np.bincount(owner, minlength=n)
    begin = np.cumsum(d) - d
    excess = _excess(d, sizes, similarity)
    least = int(excess.argmin())
    core = excess + excess[least] <= 0
    links = [(ids[least], ids[k]) for k in np.flatnonzero(core).tolist() if k != least]
    if core.all():
        return links
    own = _shared_difference(owner, element, core)
    for x in np.unique(own[own >= 0]):
        some = np.flatnonzero(own == x).tolist()
        links += family_links([ids[k] for k in some], [element[begin[k] : begin[k] + d[k]] for k in some], similarity, sizes[some])
    other = np.where(core, excess[~core].min(), excess[least])
    need = np.maximum(1, -(-(excess + other) // share))
    at = np.arange(len(owner)) - begin[owner]
    posted = np.flatnonzero((at <= d[owner] - need[owner]) & (often > 1))
    posted = posted[np.argsort(element[posted], kind="stable")]
    left = d[owner] - at
    pairs = set()
    for group in np.split(posted, np.flatnonzero(np.diff(element[posted])) + 1):
        for k in range(1, len(group)):
            x, y = owner[group[k]], owner[group[:k]]
            can = np.minimum(left[group[k]], left[group[:k]]) * share >= excess[x] + excess[y]
            done = (core[x] & core[y]) | ((own[x] >= 0) & (own[x] == own[y]))
            pairs.update((int(x), int(z)) for z in y[can & ~done])
    for x, y in pairs:
        both = np.intersect1d(element[begin[x] : begin[x] + d[x]], element[begin[y] : begin[y] + d[y]], assume_unique=True)
        if excess[x] + excess[y] <= share * len(both):
            links.append((ids[x], ids[y]))
    return links


def _shared_difference(owner: np.ndarray, element: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Of each set that isn't in the core, the element of its difference that most of these share; -1 if none does."""
    out = ~core[owner]
    values, which, m = np.unique(element[out], return_inverse=True, return_counts=True)
    order = np.lexsort((values[which], m[which], owner[out]))
    owners, which = owner[out][order], which[order]
    last = np.flatnonzero(np.append(owners[1:] != owners[:-1], True)) if len(owners) else np.zeros(0, int)
    best = np.full(len(core), -1, np.int64)
    best[owners[last]] = np.where(m[which[last]] > 1, values[which[last]], -1)
    return best


def _families(similarity: tuple[int, int]):
    names = ["a", "b", "fam", "cls", "n", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of whole families, which follow one another; the sets of large families go on as they are."""
        links: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            k = len(links)
            sides = [pa.array([x[j] for x in links], pa.int64()) for j in range(2)]
            links.clear()
            return pa.RecordBatch.from_arrays([*sides, *(pa.nulls(k, pa.int64()) for _ in range(3)), pa.nulls(k, pa.binary())], names)

        held, of, last = {}, None, None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            return family_links([c for c, _ in held], [np.frombuffer(m, np.int64) for _, m in held], similarity, np.array(list(held.values())))

        for batch in batches:
            big = []
            for k, (fam, cls, salt, n) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                members = batch.column(4)[k].as_py()
                if fam != of:
                    links += close()
                    held, of, last = {}, fam, None
                if salt == 0:
                    held[cls, members] = n  # repeated rows are there once
                elif (cls, members) != last:
                    big.append(k)
                    last = (cls, members)
            if len(links) > 10_000:
                yield flush()
            if big:
                some = batch.take(pa.array(big))
                none = pa.nulls(len(big), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(some.column(k) for k in (0, 1, 3, 4))], names)
        links += close()
        yield flush()

    return run


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's sets have each shingle, by family."""
    for batch in batches:
        for part in slices(batch, 1, SLICE_BYTES):
            fam, members = part.column(0).to_numpy(), part.column(1).to_pylist()
            for f in np.unique(fam):
                values, n = np.unique(np.concatenate([np.frombuffer(m, np.int64) for m, g in zip(members, fam, strict=True) if g == f]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f)), pa.array(values), pa.array(n)], ["fam", "element", "df"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each set's difference from its family's centre, and whether the set has them; null if there is none."""
    names = ["fam", "cls", "row", "n", "element", "has"]
    for batch in batches:
        for part in slices(batch, 4, SLICE_BYTES // 4):
            heads = [part.column(k).to_numpy() for k in range(4)]
            here, found, has = [], [], []
            for k in range(part.num_rows):
                own, centre = np.frombuffer(part.column(4)[k].as_py(), np.int64), np.array(part.column(5)[k].as_py() or [], np.int64)
                more, less = np.setdiff1d(own, centre, assume_unique=True), np.setdiff1d(centre, own, assume_unique=True)
                here.append(len(more) + len(less))
                found += [more, less]
                has += [np.ones(len(more), bool), np.zeros(len(less), bool)]
            here = np.array(here)
            at, none = np.repeat(np.arange(len(here)), here), np.flatnonzero(here == 0)
            element = pa.concat_arrays([pa.array(np.concatenate(found)), pa.nulls(len(none), pa.int64())])
            at = np.concatenate([at, none])
            there = pa.array(np.concatenate([*has, np.ones(len(none), bool)]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at]) for x in heads), element, there], names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fam, cls, salt, n, list of numbers) with the list as bytes."""
    for batch in batches:
        members = pa.array([np.asarray(x.values, np.int64).tobytes() for x in batch.column(4)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], members], ["fam", "cls", "salt", "n", "members"])


def _salted(rows: DataFrame, work: str, family: int) -> DataFrame:
    """rows (fam, cls, work, ...) of families of two or more with salt: 0 where one task does the family, else by class."""
    totals = rows.groupBy("fam").agg(F.count(F.lit(1)).alias("nf"), F.sum(work).alias("work")).filter("nf > 1")
    small = stored(totals.select("fam", ((F.col("nf") <= family) & (F.col("work") <= FAMILY_SHINGLES)).alias("small")), "totals")
    salt = F.when(F.col("small"), F.lit(0)).otherwise(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) + 1).cast("long")
    return rows.join(sent(small), "fam").withColumn("salt", salt).drop("small")


def _in_families(sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of sets (fam, cls, salt, n, members): the links (a, b) of small families, and the sets (fam, cls, n, members) of large ones."""
    dealt = sets.repartition("fam", "salt").sortWithinPartitions("fam", "cls", "members").select("fam", "cls", "salt", "n", "members")
    done = stored(dealt.mapInArrow(tidy(_families(similarity)), "a long, b long, fam long, cls long, n long, members binary"), "family-links")
    return done.filter("a IS NOT NULL").select("a", "b"), done.filter("members IS NOT NULL").select("fam", "cls", "n", "members")


def large_family_links(sets: DataFrame, similarity: tuple[int, int], family: int = FAMILY) -> DataFrame:
    """family_links() of families of any size: sets (fam, cls, members)."""
    sets = sets.select("fam", "cls", (F.octet_length("members") / 8).cast("long").alias("n"), "members")
    found = None
    while True:
        links, inner = _level_links(sets, similarity)
        dealt = _salted(inner, "d", family).select("fam", "cls", "salt", "n", "diff").mapInArrow(tidy(_packed), "fam long, cls long, salt long, n long, members binary")
        more, sets = _in_families(dealt, similarity)
        links = links.unionByName(more)
        found = links if found is None else found.unionByName(links)
        if sets.isEmpty():
            return found


def _level_links(sets: DataFrame, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Of families of sets (fam, cls, n, members; the members may be differences from one set, n is the whole size): the links (a, b) but
    for those within families (fam, cls, n, d, diff) of sets that share a difference from the centre, which are returned too."""
    share = _share(similarity)
    counts = sets.select("fam", "members").mapInArrow(tidy(_shingle_counts), "fam long, element long, df long").groupBy("fam", "element").agg(F.sum("df").alias("df"))
    nf = stored(sets.groupBy("fam").agg(F.count(F.lit(1)).alias("nf")), "sizes")
    counts = stored(counts.filter("df > 1").join(sent(nf), "fam"), "shingles")
    centres = counts.filter(F.col("df") * 2 > F.col("nf")).groupBy("fam").agg(F.collect_list("element").alias("centre"))  # at most twice as large as the mean set
    numbered = sets.select("fam", "cls", F.monotonically_increasing_id().alias("row"), "n", "members")  # rows of one id may have different texts
    rows = numbered.join(sent(stored(centres, "centres"), F.size("centre")), "fam", "left").mapInArrow(tidy(_differences), "fam long, cls long, row long, n long, element long, has boolean")
    often = F.when(F.col("has"), F.coalesce("df", F.lit(1))).otherwise(F.col("nf") - F.col("df"))  # who lacks it has a row of counts
    rows = rows.join(sent(counts), ["fam", "element"], "left").withColumn("often", often)
    diffs = rows.groupBy("fam", "cls", "row", "n").agg(F.array_sort(F.collect_list(F.when(F.isnotnull("element"), F.struct("often", "element")))).alias("diff"))
    diffs = stored(diffs.withColumn("excess", _excess(F.size("diff").cast("long"), F.col("n"), similarity)), "differences")
    least = diffs.groupBy("fam").agg(F.min(F.struct("excess", "cls")).alias("least")).select("fam", F.col("least.excess").alias("low"), F.col("least.cls").alias("first"))
    first = diffs.join(sent(stored(least, "least")), "fam").withColumn("core", F.col("excess") + F.col("low") <= 0)
    edge = first.groupBy("fam").agg(F.min(F.when(~F.col("core"), F.col("excess"))).alias("edge")).filter("edge IS NOT NULL")
    known = first.join(sent(stored(edge, "edges")), "fam", "left")
    core_links = known.filter(F.col("core") & (F.col("cls") != F.col("first"))).select(F.col("first").alias("a"), F.col("cls").alias("b"))

    far = first.filter(~F.col("core")).select("fam", "row", F.explode("diff.element").alias("element"))
    shared = far.groupBy("fam", "element").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    inner = far.join(spread(shared), ["fam", "element"]).groupBy("fam", "row").agg(F.max(F.struct("m", "element")).alias("most"))
    inner = stored(inner.select("row", F.xxhash64("fam", "most.element").alias("inner")), "inner")

    other = F.when(F.col("core"), F.col("edge")).otherwise(F.col("low"))
    need = F.greatest(F.lit(1), F.ceil((F.col("excess") + other) / share))
    band = lambda x: F.floor(F.log2((x - F.col("low") + 1).cast("double"))).cast("int")
    kind = F.when(F.col("core"), F.lit(0)).when(F.isnotnull("inner"), F.lit(1)).otherwise(F.lit(2))
    which = F.when(F.col("core"), F.lit(0).cast("long")).otherwise(F.coalesce("inner", "row"))
    open_ = known.filter("edge IS NOT NULL").join(sent(inner), "row", "left").withColumn("grp", F.struct(kind.alias("kind"), which.alias("id")))
    open_ = open_.select("fam", "cls", "grp", "low", "excess", F.size("diff").alias("d"), need.alias("need"), "diff")
    posts = open_.select("fam", "cls", "grp", "low", "excess", "d", "need", F.posexplode("diff").alias("at", "x")).filter((F.col("at") <= F.col("d") - F.col("need")) & (F.col("x.often") > 1))
    left = F.col("d") - F.col("at")
    posts = stored(posts.select("fam", "cls", "grp", "low", "excess", F.col("x.element").alias("element"), left.alias("left"), band(F.col("excess")).alias("band"), (left * share - F.col("excess")).alias("reach")), "posts")
    # a class looks for partners that are as near to the centre as itself or nearer, and no further out than what is left reaches
    asks = posts.filter(F.col("reach") >= F.col("low")).withColumn("own", F.col("band")).withColumn("band", F.explode(F.sequence(F.lit(0), F.least("own", band(F.col("reach"))))))
    asks = asks.select("fam", "element", "band", F.col("cls").alias("b"), F.col("grp").alias("grp_b"), F.col("excess").alias("excess_b"), F.col("left").alias("left_b"), "own")
    # it asks the groups of a list, then the members of a group that can have a partner; never its own group
    groups = posts.groupBy("fam", "element", "band", "grp").agg(F.min("excess").alias("excess"), F.max("left").alias("left"), F.min("cls").alias("cls"))
    can = F.least("left", "left_b") * share >= F.col("excess") + F.col("excess_b")
    once = (F.col("own") > F.col("band")) | (F.col("b") > F.col("cls"))
    asked = asks.join(spread(groups), ["fam", "element", "band"]).filter(can & once & (F.col("grp") != F.col("grp_b"))).drop("excess", "left", "cls")
    members = posts.select("fam", "element", "band", "grp", "cls", "excess", "left")
    pairs = stored(asked.join(sent(members), ["fam", "element", "band", "grp"]).filter(can & once).select("fam", F.col("cls").alias("a"), "b").distinct(), "pairs")
    side = lambda c: diffs.select("fam", F.col("cls").alias(c), F.col("excess").alias(f"excess_{c}"), F.transform("diff", lambda x: x["element"]).alias(f"diff_{c}"))
    both = pairs.join(sent(side("a"), F.size("diff_a")), ["fam", "a"]).join(sent(side("b"), F.size("diff_b")), ["fam", "b"])
    both = both.filter(F.col("excess_a") + F.col("excess_b") <= F.size(F.array_intersect("diff_a", "diff_b")) * share)
    within = diffs.join(sent(inner), "row").select(F.col("inner").alias("fam"), "cls", "n", F.size("diff").cast("long").alias("d"), F.transform("diff", lambda x: x["element"]).alias("diff"))
    return core_links.unionByName(both.select("a", "b")), within


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all that is linked but the smallest of what links reach: that smallest one, and itself."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        x, y = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        x, y = x[x < y], y[x < y]
        np.minimum.at(label, y, x)
        while (label != label[label]).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[other]], ids[other]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what a task's links connect, MOST_LINKS or a batch at a time."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        sides = [np.concatenate([np.zeros(0, np.int64), *(x.column(k).to_numpy() for x in held)]) for k in range(2)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*sides)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= MOST_LINKS:
            yield flush()
    yield flush()


def labelled(links: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(cls, comp) of what is linked: comp is the smallest cls that links reach. Each task first leaves out links that its others imply.
    If `most` or fewer stay, one task labels all. Else each round takes the least label of the neighbours, then the label of
    the label; only whether labels moved comes to the driver."""
    few = stored(links.select("a", "b").mapInArrow(tidy(_stars), "a long, b long"), "links")
    if few.count() <= most:
        done = stored(few.repartition(1).mapInArrow(tidy(_stars), "a long, b long"), "labels")
        return done.select(F.col("b").alias("cls"), F.col("a").alias("comp")).union(done.select("a", "a").distinct())
    both = stored(few.union(few.select("b", "a")).distinct(), "links")
    linked = stored(both.select(F.col("a").alias("cls")).distinct().withColumn("comp", F.col("cls")), "labels")
    while True:
        near = both.join(spread(linked.select(F.col("cls").alias("b"), F.col("comp").alias("near"))), "b").groupBy("a").agg(F.min("near").alias("near"))
        low = linked.join(spread(near.withColumnRenamed("a", "cls")), "cls").select("cls", "comp", F.least("comp", "near").alias("low"))
        jump = linked.select(F.col("cls").alias("low"), F.col("comp").alias("further"))
        after = stored(low.join(spread(jump), "low").select("cls", F.least("low", "further").alias("comp"), (F.least("low", "further") != F.col("comp")).alias("moved")), "labels")
        linked = after.select("cls", "comp")
        if after.filter("moved").isEmpty():
            return linked


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp) of all nodes; those without links are their own component."""
    return nodes.select("cls").join(spread(labelled(links)), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"))


def _confirm(similarity: tuple[int, int]):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = similarity
        for batch in batches:
            for few in slices(batch, 2, SLICE_BYTES):  # sizes of a pair's sets are alike
                keep = []
                for x, y in zip(few.column(2), few.column(3), strict=True):
                    x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(whole * same >= part * (len(x) + len(y) - same))
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([few.column(0).filter(mask), few.column(1).filter(mask)], ["a", "b"])

    return confirm


def _collisions(x: str, y: str) -> F.Column:
    return F.size(F.array_intersect(x, y))


def cross_pairs(lists: DataFrame, few_pairs: int, matches: int, similarity: tuple[int, int], visited: int = VISITED) -> tuple[DataFrame, DataFrame]:
    """Of classes of different families that collide in enough lists: pairs (a, b) if both families have fewer than `visited` classes,
    else visits (fam, cls) of the larger family by classes of the other.

    lists: key, cls, n, fam, size (of the family), keys (the class's lists, rarest first), at (place of the list in keys), depth. A pair
    counts where its first common lists are, not in each list that has both.
    """
    part, whole = similarity
    found = visits = None
    while True:
        shares = lists.groupBy("key", "fam").agg(F.count(F.lit(1)).alias("m"))
        sums = shares.groupBy("key").agg(F.sum("m").alias("m"), F.max("m").alias("top"), F.count(F.lit(1)).alias("fams"))
        few_ = (F.col("m") - F.col("top")) * F.col("m") <= few_pairs
        open_ = stored(sums.filter("fams > 1").select("key", few_.alias("few")), "open")
        held = stored(lists.join(sent(open_), "key"), "held")
        last = F.col("depth") >= matches
        few = held.filter(F.col("few") | last)
        alike = F.least("n", "n_b") * whole >= F.greatest("n", "n_b") * part
        shared = _collisions("keys", "keys_b") >= matches
        small = few.filter(F.col("size") < visited).withColumn("before", F.slice("keys", F.lit(1), F.col("at") + 1))
        other = small.select(F.col("key").alias("k"), F.col("cls").alias("b"), F.col("fam").alias("fam_b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"), F.col("before").alias("before_b"))
        can = (F.col("cls") < F.col("b")) & (F.col("fam") != F.col("fam_b")) & alike & (_collisions("before", "before_b") == F.col("depth")) & shared
        pairs = stored(small.join(sent(other, F.size("keys_b")), (F.col("key") == F.col("k")) & can).select(F.col("cls").alias("a"), "b").distinct(), "across")
        found = pairs if found is None else found.union(pairs)
        # a class asks each larger family of its list once, and whether one of its members is near is all that counts
        large = few.filter(F.col("size") >= visited)
        hosts = large.groupBy("key", F.col("fam").alias("host")).agg(F.first("size").alias("host_size"), F.min("n").alias("least"), F.max("n").alias("most"))
        larger = F.struct("host_size", "host") > F.struct("size", "fam")
        asks = few.join(spread(hosts), "key").filter(larger & (F.col("n") * whole >= F.col("least") * part) & (F.col("most") * whole >= F.col("n") * part))
        members = large.select(F.col("key").alias("k"), F.col("fam").alias("fam_b"), F.col("n").alias("n_b"), F.col("keys").alias("keys_b"))
        near = asks.join(sent(members, F.size("keys_b")), (F.col("key") == F.col("k")) & (F.col("host") == F.col("fam_b")) & alike & shared, "left_semi")
        near = stored(near.select(F.col("host").alias("fam"), "cls").distinct(), "visits")
        visits = near if visits is None else visits.union(near)
        many = held.filter(~F.col("few") & ~last)
        if many.isEmpty():
            return found.distinct(), visits.distinct()
        stop = F.size("keys") - (matches - 1 - F.col("depth")) - 1  # a later place leaves too few lists to collide in
        again = many.filter(stop > F.col("at")).withColumn("next", F.explode(F.sequence(F.col("at") + 1, stop)))
        key = F.xxhash64("key", F.get("keys", F.col("next"))).alias("key")
        lists = stored(again.select(key, "cls", "n", "fam", "size", "keys", F.col("next").alias("at"), (F.col("depth") + 1).alias("depth")), "lists")


def near_dedup(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, few_pairs: int = FEW_PAIRS, matches: int = MATCHES, family: int = FAMILY, visited: int = VISITED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    sketched = stored(_named(docs).mapInArrow(tidy(_sketch), "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>"), "sketches")
    firsts = [F.first(F.col("keys")[k]).alias(f"k{k}") for k in range(COORDINATES)]
    classes = sketched.filter("n_shingles > 0").groupBy("h1", "h2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("cls"), *firsts)
    classes = stored(classes.select("h1", "h2", "n", "cls", F.array(*(f"k{k}" for k in range(COORDINATES))).alias("keys")), "classes")
    posted = classes.select("cls", F.explode("keys").alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = posted.join(spread(sizes), "key").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("met"))  # at most COORDINATES
    met = stored(met.filter(F.size("met") >= matches), "met")
    liked = F.aggregate("met", F.lit(0).cast("long"), lambda a, x: a + x["size"])
    lists = met.select("cls", liked.alias("liked"), F.posexplode(F.slice("met", F.lit(1), F.size("met") - matches + 1)).alias("at", "x"))
    lists = stored(lists.select(F.col("x.key").alias("key"), "cls", "liked", "at"), "lists")
    leaders = lists.groupBy("key").agg(F.max(F.struct("liked", "cls")).alias("top"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", F.col("top.cls").alias("leader"))
    led = lists.join(spread(leaders), "key").filter("leader <> cls").groupBy(F.col("leader").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))
    families = labelled(led.filter(F.col("collisions") >= LEADS))

    known = classes.select("h1", "h2", "n", "cls")
    sizes = families.groupBy(F.col("comp").alias("fam")).agg(F.count(F.lit(1)).alias("size"))
    families = stored(families.withColumnRenamed("comp", "fam").join(spread(sizes), "fam"), "families")
    in_lists = lists.join(sent(families), "cls", "left").select("key", "cls", "at", F.coalesce("fam", "cls").alias("fam"), F.coalesce("size", F.lit(1)).alias("size"))
    in_lists = in_lists.join(sent(met.select("cls", F.transform("met", lambda x: x["key"]).alias("keys")), F.size("keys")), "cls").join(sent(known.select("cls", "n")), "cls").withColumn("depth", F.lit(1))
    pairs, visits = cross_pairs(in_lists, few_pairs, matches, similarity, visited)

    own = families.select("fam", "cls").union(visits).join(sent(known.select("cls", "n")), "cls")
    wanted = stored(_salted(own, "n", family).select("cls", "fam", "salt"), "wanted")
    links, large = _in_families(_sets_of(spread_by_hash(wanted), docs).withColumn("n", (F.octet_length("members") / 8).cast("long")), similarity)
    if not large.isEmpty():
        links = links.unionByName(large_family_links(large, similarity, family))

    if not pairs.isEmpty():
        ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
        sets = stored(_sets_of(sent(stored(ends, "ends"), beyond=spread_by_hash), docs).distinct(), "sets")
        both = pairs.join(spread(sets.select(F.col("cls").alias("a"), F.col("members").alias("ma"))), "a").join(spread(sets.select(F.col("cls").alias("b"), F.col("members").alias("mb"))), "b")
        links = links.unionByName(both.select("a", "b", "ma", "mb").mapInArrow(tidy(_confirm(similarity)), "a long, b long"))

    named = known.join(spread(labelled(links)), "cls", "left").select("h1", "h2", F.col("n").alias("n_shingles"), F.coalesce("comp", "cls").alias("comp"))
    out = sketched.drop("keys").join(spread(named), ["h1", "h2", "n_shingles"], "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, matches: int = MATCHES) -> DataFrame:
    """The rows of docs that stay, one of each group, with their columns as they were."""
    kept = near_dedup(docs, similarity, matches=matches).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(spread_by_hash(kept), docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
