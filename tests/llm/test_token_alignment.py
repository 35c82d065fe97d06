import json
import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noteloom.llm import token_alignment as ta


def token_bytes():
    """Bytes of the ids of both vocabularies: of the first by its byte table, built anew here."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]
    hidden = [k for k in range(256) if k not in shown]
    letter = {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(hidden)}
    of_a = lambda k: bytes(letter[x] for x in a.id_to_token(k))
    piece = b.id_to_piece
    of_b = lambda k: bytes([int(piece(k)[3:5], 16)]) if piece(k).startswith("<0x") and len(piece(k)) == 6 else piece(k).replace("▁", " ").encode()
    return a, b, of_a, of_b


def test_ids_are_those_of_the_tokenizers_library(spark):
    """Of all texts of a scale, and of random strings of letters, marks, spaces and controls."""
    a = token_bytes()[0]
    t = ta.tokenizers(*ta.default_vocabularies())
    pick = random.Random(3)
    letters = [chr(x) for x in [*range(0x250), *range(0x2000, 0x2070), *range(0x3040, 0x30A0), 0x1F600, 0x1F468, 0x200D, 0x180E, 0xFEFF, *range(0x600, 0x660), *range(0x900, 0x960)]]
    common = [*letters[:128], *[" ", "\n", "'s", "'re", "a", "b", "1"] * 8]
    texts = ["".join(pick.choices(letters if k % 2 else common, k=pick.randrange(1, 40))) for k in range(4000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text]
    assert t.ids_of([f" {x}" for x in texts]) == [a.encode(f" {x}", add_special_tokens=False).ids for x in texts]


def test_other_vocabularies_go_by_the_library(tmp_path):
    """A file whose merges aren't in the order of ids has no ranks."""
    file = json.load(open(P.path("byte_bpe_50k.json")))
    file["model"]["merges"][:2] = file["model"]["merges"][1::-1]
    (tmp_path / "other.json").write_text(json.dumps(file))
    assert ta._by_rank(str(tmp_path / "other.json"), {}) is None
    other = ta.Tokenizers(str(tmp_path / "other.json"), P.path("piece_bpe_32k.model"))
    assert other.ids_of([" the cat"]) == [Tokenizer.from_file(str(tmp_path / "other.json")).encode(" the cat", add_special_tokens=False).ids]


def plain(rows):
    """The result of rows (doc_id, text), byte by byte and pair by pair."""
    a, b, of_a, of_b = token_bytes()
    out, linked, having = [], [], Counter()
    for _, text in rows:
        ia = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        want = f" {text}".encode() if text else b""
        if b"".join(map(of_a, ia)) != want or b"".join(map(of_b, ib)) != want:
            ia, ib = [], []
        ends = []
        for ids, of in ((ia, of_a), (ib, of_b)):
            at, own = 0, []
            for k in ids:
                at += len(of(k))
                own.append(at)
            ends.append(own)
        stops = sorted(set(ends[0]) & set(ends[1]))
        groups = defaultdict(lambda: ([], []))
        for side, ids in enumerate((ia, ib)):
            g = 0
            for k, end in zip(ids, ends[side]):
                groups[g][side].append(k)
                g += end == stops[g]
        links = Counter((x, y) for xs, ys in groups.values() for x in xs for y in ys)
        having.update(links.keys())
        linked.append(links)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, (x, y) in sorted(groups.items()))
        out.append([len(ia), len(ib), len(stops), sum(links.values()), sha256(told.encode()).hexdigest() if ia else ""])
    top = Counter()
    for (x, _), n in having.items():
        top[x] = max(top[x], n)
    for row, links in zip(out, linked):
        row[4:4] = [sum(n for (x, y), n in links.items() if having[x, y] == top[x]), sum(n * having[p] for p, n in links.items())]
    return sorted((str(i), *row) for (i, _), row in zip(rows, out))


def result(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in ta.alignment(df).collect())


@pytest.mark.parametrize("limits", [(1_000_000, 8_000_000, 2_000_000, 4096), (3000, 20_000, 50, 2)])
def test_documents(spark, monkeypatch, limits):
    """All of the smallest scale, also with slices, blocks and pieces so small that all of them are many."""
    for name, value in zip(("SLICE_BYTES", "BLOCK_BYTES", "PAIRS", "LONG_GROUP"), limits):
        monkeypatch.setattr(ta, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    if limits[0] < 10_000:
        t = ta.tokenizers(*ta.default_vocabularies())
        s = ta.Slice(t, [x for _, x in rows[:40]])
        key, times = s.links()
        monkeypatch.undo()
        whole = ta.Slice(t, [x for _, x in rows[:40]]).links()
        assert (key == whole[0]).all() and (times == whole[1]).all()
        rows = rows[:60]
        docs = docs.filter(F.col("doc_id").isin([i for i, _ in rows])).repartition(7)
    assert result(docs) == plain(rows)


def test_odd_texts(spark):
    texts = [None, "", " ", "  two  spaces\n\n\ttabs ", "a ▁ mark", "<|endoftext|> and <s> are text </s><unk>", "日本語テキスト😀 é ﬁ x", "\x00\x01", "same text", "same text", "naïve café " * 3000, "ÿ" * 5000, "x" * 20_000]
    rows = [*enumerate(texts), (None, "same text"), (3, "same text")]
    df = spark.createDataFrame([(i, t, 1, "z", 2) for i, t in rows], "doc_id long, text string, block int, a string, times int")
    got = result(df)
    assert got == plain(rows)
    by = {x[0]: x for x in got if x[0] != "3"}
    assert by["0"] == ("0", 0, 0, 0, 0, 0, 0, "") and by["4"][1] == 0 and by["5"][1] > 0
    assert ta.alignment(df.filter(F.lit(False))).count() == 0
