"""Toxicity, quality and language-model scores."""

import zlib
from collections import Counter

import numpy as np
import pytest
from support import DATA

from chronospark.llm import lm, quality, toxicity
from chronospark.llm.labelled import held_out, logistic


@pytest.mark.parametrize("op", [toxicity, quality])
def test_edges_get_scores(op, spark, edges, empty, labelled, labels):
    model = op.train(labelled, labels, rows=500)
    out = op.score(edges, model).toPandas()
    assert len(out) == edges.count() and out["score"].between(0, 1).all()
    assert out[out["doc_id"] == 5]["score"].nunique() == 1
    assert set(out.columns) == set(edges.columns)
    assert op.score(empty, model).count() == 0
    own = op.score(labelled, model).toPandas()
    want = (own["doc_id"] % 2 == 1) if op is quality else (own["doc_id"] % 2 == 0)
    assert ((own["score"] >= 0.5) == want).mean() > 0.95


@pytest.mark.parametrize("op", [toxicity, quality])
def test_without_labels(op, edges, labelled, labels):
    model = op.train(labelled, labels.where("doc_id < 0"))
    assert op.score(edges, model).where("score IS NULL").count() == 0


def test_held_out_is_the_stated_rule(spark):
    rows = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def scored(text, lexicon=()):
    import pyarrow as pa

    return toxicity.clause_scores(toxicity.Tokens(pa.array([text])), list(lexicon))[0]


def test_grammar_weighs_context():
    plain, aimed, denied, quoted = (scored(t)[1] for t in ("Such an idiot.", "You idiot.", "He is not an idiot.", "They said the word idiot."))
    assert aimed > plain > quoted > denied > 0
    assert scored("I will kill you.")[4] > 1 > scored("They kill time.")[4]
    assert scored("You are kind.")[1] == 0 and scored("")[1] == 0
    assert scored("not now. idiot.")[1] == scored("idiot.")[1]  # clauses stand alone


def test_composition_equals_running_in_turn():
    machine = [toxicity.within(toxicity.NEGATION, toxicity.INSULT, toxicity.DENIED, 3), toxicity.within(toxicity.REPORT, toxicity.INSULT, toxicity.QUOTED, 12), toxicity.within(toxicity.TARGET, toxicity.INSULT, toxicity.AIMED, 4), toxicity.threats(), toxicity.weights()]
    rng = np.random.default_rng(1)
    to, worth = toxicity.grammar()
    for _ in range(50):
        state, states = 0, [m.start for m in machine]
        for symbol in rng.integers(0, 7, 20).tolist():
            got = worth[state, symbol]
            state = to[state, symbol]
            total, written = 1.0, symbol
            for i, m in enumerate(machine):
                states[i], written, w = m.step(states[i], written)
                total *= w
            assert got == total


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    model = {"w0": 0.3, "w": rng.standard_normal(9).astype(np.float32), "v": rng.standard_normal((9, 4)).astype(np.float32)}
    number, value = np.array([0, 3, 5, 8]), np.array([1, 0.5, 2, 1], np.float32)
    got = quality.raw_score(model, number, value, np.array([0, 4]))[0]
    want = model["w0"] + sum(model["w"][i] * x for i, x in zip(number, value)) + sum(model["v"][number[a]] @ model["v"][number[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert abs(got - want) < 1e-4


def test_logistic():
    x = np.linspace(-1, 1, 200)[:, None]
    w = logistic(x, (x[:, 0] > 0.2).astype(float))
    assert w[0] > 0 > w[1]


def words_of(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(k) + 32) if "A" <= k <= "Z" else k for k in text or "")), "\n"]


def test_base_scores_by_brute_force(spark, edges, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    # few words are broadcast, so that the others' join matters
    got = lm.score_documents(docs, path, common_words=50).toPandas()
    assert len(got) == docs.count()
    training, rows = Counter(), docs.collect()
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not out(r["doc_id"]):
            training.update(words_of(r["text"]))
    n, v = sum(training.values()), len(training)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(words_of(r["text"])), sum(training[w] > 0 for w in words_of(r["text"])), round(sum(np.log10((training[w] + 1) / (n + v + 1)) for w in words_of(r["text"])), 5)) for r in rows)
    have = sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got.itertuples())
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) <= 1e-4 for a, b in zip(have, want, strict=True))
    assert (got["train_tokens"] == n).all() and (got["score"] < 0).all()
    assert lm.score_documents(empty, path).count() == 0


def small_model(seed=3):
    """Counted tables of random ids, and weights that matter."""
    size, begin, end = 60, 58, 59
    rng = np.random.default_rng(seed)
    ids, borders = rng.integers(0, 58, 3000), np.arange(0, 3001, 300)
    n = np.bincount(ids, minlength=size).astype(float)
    n[end] = 10
    of = lm.classes(n, begin)
    share = np.log(rng.dirichlet(np.ones(lm.CLASSES), lm.TOPICS)).T.astype(np.float32)
    b = lm.Blocks(ids, borders, {"of": of}, begin, end)
    counts = np.bincount(((b.came * lm.CLASSES + b.goes) * lm.TOPICS + np.repeat(lm.fits(share, b), lm.BLOCK))[b.live], minlength=lm.CLASSES**2 * lm.TOPICS).astype(np.float32)
    w = lm.start_weights(share)
    for k in w:
        w[k] = w[k] + 0.3 * rng.standard_normal(w[k].shape).astype(np.float32)
    return {"of": of} | lm.probabilities(of, n, counts, begin), w, (begin, end, size)


def blocks_of(texts, t, begin, end):
    ids = np.concatenate([np.asarray(x, np.int64) for x in texts]) if texts else np.empty(0, np.int64)
    return lm.Blocks(ids, np.append(0, np.cumsum([len(x) for x in texts])), t, begin, end)


def logs(t, w, texts, begin, end):
    b = blocks_of(texts, t, begin, end)
    made = lm.log_probabilities(lm.ready(w), t, b)
    return [made[b.edge[i] * lm.BLOCK :][: len(x) + 1] for i, x in enumerate(texts)]


def plainly(t, w, text, begin, end):
    """The log probability of each id by attention written out for one place at a time."""
    came, goes = [begin, *text], [*text, end]
    x = w["e"][t["of"][came]].astype(np.float64)
    out = []
    for i in range(len(goes)):
        block = i // lm.BLOCK
        first = max(0, block - lm.BACK) * lm.BLOCK
        groups = [g for g in range(first, i + 1, lm.GROUP) if g + lm.GROUP - 1 <= i]
        keys = [x[g : g + lm.GROUP].mean(axis=0) for g in groups]
        e = np.array([np.exp(min(30, (x[i] @ w["q"]) @ (k @ w["k"]) / np.sqrt(lm.DIM) + w["r"][(i - (g + lm.GROUP - 1)) // lm.GROUP])) for k, g in zip(keys, groups)])
        c = sum((a * (k @ w["v"]) for a, k in zip(e, keys)), np.zeros(lm.DIM)) / (1 + e.sum())
        z = np.exp(c @ w["out"] + x[i] @ w["own"] + w["bias"])
        p = z / z.sum() @ t["step"][t["of"][came[i]] * lm.CLASSES + t["of"][goes[i]]]
        out.append(np.log(p) + t["within"][goes[i]])
    return np.array(out)


def test_batched_attention_is_plain_attention():
    t, w, (begin, end, _) = small_model()
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 58, n) for n in (0, 1, 7, 31, 32, 33, 150, 0, 1200, 64)]
    got = logs(t, w, texts, begin, end)
    for text, own in zip(texts, got, strict=True):
        assert np.allclose(own, plainly(t, w, text, begin, end), atol=1e-4)
    # what a batch holds beside a text doesn't change its score
    assert np.allclose(logs(t, w, [texts[6]], begin, end)[0], got[6], atol=1e-5)


def test_model_is_a_distribution():
    t, w, (begin, end, size) = small_model()
    ids = np.random.default_rng(5).integers(0, 58, 100)
    for at in (0, 1, 33, 90):
        total = sum(np.exp(logs(t, w, [np.append(ids[:at], i)], begin, end)[0][at]) for i in range(58)) + np.exp(logs(t, w, [ids[:at]], begin, end)[0][at])
        assert abs(total - 1) < 1e-4


def test_gradients():
    t, w, (begin, end, _) = small_model()
    w = {k: v.astype(np.float64) for k, v in w.items()}
    rng = np.random.default_rng(6)
    b = blocks_of([rng.integers(0, 58, n) for n in (100, 5, 40)], t, begin, end)
    loss = lambda: lm.gradients(lm.ready(w), t, b.came, b.goes, b.live, b.order)
    g = loss()[0]
    for k in w:
        flat, i = w[k].reshape(-1), int(np.argmax(np.abs(g[k].reshape(-1))))
        old = flat[i]
        flat[i] = old + 1e-4
        up = loss()[1]
        flat[i] = old - 1e-4
        down = loss()[1]
        flat[i] = old
        assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-3 * max(1, abs(g[k].reshape(-1)[i]))


def test_gradients_are_gathered_by_class_and_windows_not_copied():
    """Parts added one by one give the sum of the parts' own gradients; a block's keys are those that the next blocks read."""
    t, w, (begin, end, _) = small_model()
    rng = np.random.default_rng(7)
    b, ready = blocks_of([rng.integers(0, 58, n) for n in (400, 0, 33, 90)], t, begin, end), lm.ready(w)
    parts, whole = [], lm.Gradients(ready, t)
    for a in range(0, len(b), 5):
        z = min(len(b), a + 5)
        at, order = slice(a * lm.BLOCK, z * lm.BLOCK), np.minimum(b.order[a:z], np.arange(z - a))
        parts.append(lm.gradients(ready, t, b.came[at], b.goes[at], b.live[at], order))
        whole.add(b.came[at], b.goes[at], b.live[at], order)
    g = whole.take()
    assert set(g) == set(lm.SHAPES) and abs(whole.loss - sum(x for _, x in parts)) < 1e-3 * whole.loss
    for k, shape in lm.SHAPES.items():
        assert g[k].shape == shape and np.allclose(g[k], sum(x[k] for x, _ in parts), rtol=1e-3, atol=1e-3)
    k = lm.attend(ready, b.came, b.order)[2]
    assert k.shape == (len(b), lm.WIDE, lm.DIM) and np.shares_memory(k[0], k[1])
    # the place of a dead id says nothing
    none = lm.gradients(ready, t, b.came, b.goes, np.zeros_like(b.live), b.order)
    assert none[1] == 0 and not any(x.any() for x in none[0].values())


def test_training_lowers_the_loss_and_takes_every_id():
    t, w, (begin, end, _) = small_model()
    b = blocks_of([np.tile([1, 2, 3, 4], 200)] * 3, t, begin, end)
    own = lm.Trainer(w, 0.01)
    losses = []
    for _ in range(6):
        own.loss, own.seen = 0.0, 0
        own.learn(t, b)
        losses.append(own.loss)
        assert own.seen == 3 * 801
    assert losses[-1] < losses[0]


def test_subwords_spell_the_words():
    import public_tokenizers
    import pyarrow as pa

    from chronospark.llm.textnum import Words

    coder = lm.Subwords(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [None, "", " \n\t ", "one", "A B  c   d", "é ß 日本語 🙂   x", "x" * 3000, "\x1c a\x1cb it's don't", "a\u00a0 \u00a0b \u2003c", "one two one two three"]
    column = pa.array(texts, pa.string())
    for _ in range(2):  # the second time from the table
        ids, borders = coder.encode(column)
        for i, text in enumerate(texts):
            want = [k for w in words_of(text)[:-1] for k in coder.coder.encode_ordinary(" " + w)]
            assert ids[borders[i] : borders[i + 1]].tolist() == want
    hashes, first = coder.words(ids.astype(np.int64), borders)
    plain = Words(column)
    assert (first == plain.first).all()
    one = {}
    assert all(one.setdefault(a, b) == b for a, b in zip(plain.hash.tolist(), hashes.tolist(), strict=True)) and len(set(one.values())) == len(one)


def test_model_beats_its_base_and_hardly_heeds_partitions(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 1")
    got = lm.score_documents(docs, path).toPandas()
    out = got[got["held_out"]]
    assert out["score"].sum() > out["base_score"].sum()
    other = lm.score_documents(docs.repartition(7), path).toPandas().merge(got, on="doc_id")
    change = (other["score_x"] - other["score_y"]).abs()
    assert change.sum() / other["n_tokens_x"].sum() < 0.01


def test_lookup():
    keys = np.array([5, 5 + (1 << 20), 9, 1 << 60], np.uint64)  # the first two meet in the table
    look = lm.Lookup(keys, np.array([1.0, 2.0, 3.0, 4.0]))
    assert look.get(np.array([5 + (1 << 20), 5, 9, 7, 1 << 60, 5 + (2 << 20)], np.uint64)).tolist() == [2, 1, 3, 0, 4, 0]


def area(score, label):
    """The share of pairs of unlike labels that the scores put in order."""
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    one = label.sum()
    return (order[label].sum() - one * (one + 1) / 2) / (one * (len(label) - one))


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity, "toxic", 0.7), (quality, "quality", 0.95)])
def test_held_out_labels(op, label, least, spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    out = labels.where(held_out("doc_id"))
    rows = op.score(docs.join(out.select("doc_id"), "doc_id"), op.train(docs, labels)).join(out, "doc_id").toPandas()
    assert area(rows["score"].to_numpy(), rows[label].to_numpy() == 1) > least
