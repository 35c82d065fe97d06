import random
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq

from noteloom.llm import toxicity as tx


def corpus(n, seed):
    pick = random.Random(seed)
    words = ["".join(pick.choices("abcdefgh", k=pick.randrange(2, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        text = pick.choices(words, k=pick.randrange(20, 400))
        bad = k % 4 == 0
        for _ in range(1 + len(text) // 60 if bad else 0):
            text[pick.randrange(len(text))] = pick.choice(["zorg", "zorgish", "qix"]) + pick.choice(["", "a", "ba"])
        rows.append((k, " ".join(text), int(bad)))
    return rows


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in tx.fresh_network(rng).items()}
    x, y = rng.normal(size=(5, 3, tx.INPUTS)), np.array([0, 1, 1])
    here = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 1], [1, 0, 1], [1, 0, 1]], bool)

    def loss(net):
        ways = [tx.run_way(lambda t, w=w: x[t] @ net[f"x{w}"] + net[f"c{w}"], here, net, w) for w in "fb"]
        p = tx._sigmoid(tx.pool(np.concatenate(ways, 2), here, net)[0])
        return -np.mean(np.where(y, np.log(p), np.log(1 - p)))

    for name, g in tx.gradient(x, here, y, net).items():
        at = tuple(0 for _ in net[name].shape)
        moved = {s: net | {name: net[name] + s * 1e-2 * np.eye(1, net[name].size).reshape(net[name].shape)} for s in (1, -1)}
        assert abs((loss(moved[1]) - loss(moved[-1])) / 2e-2 - g[at]) < 2e-3, name


def test_every_word_is_in_a_window_and_windows_overlap():
    for n in (1, 63, 64, 65, 112, 113, 1000):
        at = tx.starts_of(n)
        assert set(range(n)) == {k for a in at for k in range(a, min(n, a + tx.WINDOW))}
        assert all(b - a <= tx.STRIDE for a, b in zip(at, at[1:]))


def plain_score(text, model):
    """One window at a time, one word at a time, as the network is defined."""
    words, h = tx.words_of(text), tx.HIDDEN
    best = 0.0
    for a in tx.starts_of(len(words)) if words else ():
        x = [tx.inputs([w], model)[0].astype(float) for w in words[a : a + tx.WINDOW]]
        ways = []
        for way in "fb":
            state, out = np.zeros(h), []
            for v in x if way == "f" else x[::-1]:
                gx, gh = v @ model[f"x{way}"] + model[f"c{way}"], state @ model[f"h{way}"]
                z, r = tx._sigmoid(gx[:h] + gh[:h]), tx._sigmoid(gx[h : 2 * h] + gh[h : 2 * h])
                new = np.tanh(gx[2 * h :] + r * gh[2 * h :])
                state = (1 - z) * new + z * state
                out.append(state)
            ways.append(out if way == "f" else out[::-1])
        s = np.concatenate([np.array(ways[0]), np.array(ways[1])], 1)
        e = np.tanh(s @ model["u"]) @ model["v"]
        e = np.exp(e - e.max())
        best = max(best, float(tx._sigmoid((e / e.sum()) @ s @ model["w"] + model["b"][0])))
    return best


def test_scores_against_a_plain_loop_over_windows():
    rows = corpus(160, 5)
    model = tx.train([t for _, t, _ in rows], [y for _, _, y in rows], rounds=2, epochs=1)
    texts = [t for _, t, _ in rows[:12]] + ["zorg", "", None, "a b " * 60, "qixba zorgish"]
    got = tx.Scorer(model).score(texts)
    assert np.allclose(got, [plain_score(t, model) for t in texts], atol=1e-4)


def test_known_words_are_forgotten_without_a_change(monkeypatch):
    rows = corpus(160, 6)
    model = tx.train([t for _, t, _ in rows], [y for _, _, y in rows], rounds=2, epochs=1)
    texts = [t for _, t, _ in rows[:40]]
    whole = tx.Scorer(model).score(texts)
    monkeypatch.setattr(tx, "KNOWN_WORDS", 150)
    small = tx.Scorer(model)
    assert np.allclose([small.score([t])[0] for t in texts], whole, atol=1e-5)


def test_held_out_labels_of_real_documents():
    """Area under the curve of labels the model has not seen, and errors either way, at the 0.1 scale."""
    d = "/root/testdata/sf0.1"
    texts = dict(zip(*(pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()), strict=True))
    known = {i: y for i, y in zip(*(pq.read_table(f"{d}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()), strict=True) if y is not None and i in texts}
    out = {i for i in known if crc32(str(i).encode()) % 5 == 0}
    learn = sorted(known.keys() - out, key=lambda i: (-known[i], crc32(str(i * 7).encode())))
    learn = [i for i in learn if known[i]][: tx.MOST_ROWS // 3] + [i for i in learn if not known[i]][: tx.MOST_ROWS - tx.MOST_ROWS // 3]
    model = tx.train([texts[i] for i in learn], [known[i] for i in learn])
    out = sorted(out)
    score, y = np.array(tx.Scorer(model).score([texts[i] for i in out])), np.array([known[i] for i in out])
    bad, clean = score[y == 1], score[y == 0]
    auc = np.mean((bad[:, None] > clean).mean(1) + (bad[:, None] == clean).mean(1) / 2)
    assert auc > 0.95, auc
    assert (bad >= 0.5).mean() > 0.85 and (clean >= 0.5).mean() < 0.06  # some labels are wrong


def test_held_out_accuracy_and_odd_rows(spark):
    rows = corpus(600, 3)
    labels = spark.createDataFrame([(i, y, i) for i, _, y in rows] + [(9001, None, 1)], "doc_id long, toxic int, score int")
    extra = [(9001, None, 0), (9002, "", 0), (9003, " \n", 0), (9004, "abc " * 20_000 + "zorg", 1), (9005, "!!", 0), (9005, "!!", 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + extra], "doc_id long, text string, score string")
    got = tx.toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(extra)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(by[i].predicted, y) for i, _, y in rows if by[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert by[9001].score == by[9002].score == by[9003].score == 0
    assert by[9004].predicted == 1
    assert tx.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in tx.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id = 9004").isEmpty() and not kept.filter("doc_id = 9001").isEmpty()
