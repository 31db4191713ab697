"""Items' passages in blocks and cells, paraphrases with their answer, short sentences."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import leaks

NAMES = ["harbour", "lantern", "meadow", "granite", "orchard", "violet", "copper", "walnut", "saddle"]
ITEM = "item_id long, lang string, passage string, question string, answer string, doc_id long, text string"


def test_items_of_several_blocks_and_passes_are_found(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 2)
    line = [f"The {a} committee of {b} received exactly {k}7 letters about the {c} before winter." for k, (a, b, c) in enumerate(zip(NAMES, NAMES[1:] + NAMES[:1], NAMES[2:] + NAMES[:2]))]
    items = spark.createDataFrame([(1, "en", " ".join(line[:6]), None, None, 0, "x"), (2, "en", line[6], line[7], "", 0, "x")], ITEM)
    docs = spark.createDataFrame([(k, f"Some other words stand here. {x} More words follow it.") for k, x in enumerate(line)], "doc_id long, text string")
    got = {tuple(r) for r in leaks.leaked_items(spark, docs, items).collect()}
    assert got == {(k, 1) for k in range(6)} | {(6, 2), (7, 2)}


def test_cells_lose_no_candidate():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    vectors = leaks._unit(np.repeat(base, 20, axis=0) + 0.5 * rng.standard_normal((800, 24))).astype(np.float32)
    v = leaks._unit(np.repeat(base, 5, axis=0) + 0.6 * rng.standard_normal((200, 24))).astype(np.float32)
    centre, of = leaks._cells(vectors)
    order = np.argsort(of, kind="stable")
    vectors, of = vectors[order], of[order]
    radius = np.zeros(len(centre))
    np.maximum.at(radius, of, np.arccos(np.clip((vectors * centre[of]).sum(1), -1, 1)))
    none = np.empty(0)
    block = leaks.Block(none, none, none, none, none, vectors, [], centre.astype(np.float32), radius, np.searchsorted(of, np.arange(len(centre) + 1)), none)
    got = set(zip(*map(np.ndarray.tolist, block.candidates(v))))
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(v @ vectors.T >= leaks.COSINE))))
    assert want and got == want


def _paraphrased(rng, words, share, fresh):
    """words with a share of the lower-case ones replaced; names and numbers stay."""
    at = [i for i, w in enumerate(words) if w.islower()]
    for i in rng.sample(at, int(share * len(words))):
        words[i] = rng.choice(fresh)
    return words


@pytest.fixture(scope="module")
def paraphrases(spark):
    """Recall at each share of changed words, and pairs found that are none: answers alone, and like sentences with the answer."""
    rng = random.Random(21)
    common = [f"{a}{b}" for a in ("ba", "ko", "mi", "ra", "tu", "ve", "lo") for b in ("den", "sil", "mor", "tan", "pek")]
    items, rows, planted, decoys = [], [], {}, 0
    for i in range(120):
        name = f"Zor{chr(97 + i % 26)}{chr(97 + i // 26)}quin"
        words = [rng.choice(common) for _ in range(24)]
        for k, w in ((1, name), (6, f"{i}{rng.randint(10, 99)}"), (13, f"Hal{i}"), (20, f"{rng.randint(1000, 9999)}")):
            words[k] = w
        answer = " ".join(rng.choice(common) for _ in range(7))
        items.append((i, "en", " ".join(words).capitalize() + ".", None, answer, 0, "x"))
        share = (0.0, 0.15, 0.25, 0.4)[i % 4]
        filler = lambda: " ".join(rng.choice(common) for _ in range(20)).capitalize() + "."
        rows.append((1000 + i, f"{filler()} {' '.join(_paraphrased(rng, list(words), share, common)).capitalize()}. {filler()} It says {answer}."))
        planted[(1000 + i, i)] = share
        other = [f"Qua{rng.randint(0, 999)}" if w[0].isupper() else str(rng.randint(10_000, 99_999)) if w.isdigit() else w for w in words]
        rows += [(2000 + i, f"{filler()} {answer}. {filler()}"), (3000 + i, f"{' '.join(other)}. {answer}."), (4000 + i, filler())]
        decoys += 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in leaks.leaked_items(spark, docs, spark.createDataFrame(items, ITEM)).collect()}
    recall = {s: np.mean([p in got for p, x in planted.items() if x == s]) for s in sorted(set(planted.values()))}
    return recall, got - set(planted)


def test_paraphrases_are_found_with_their_answer(paraphrases):
    recall, wrong = paraphrases
    print(recall)
    assert recall[0.0] == 1 and recall[0.15] >= 0.95 and recall[0.25] >= 0.9
    assert len(wrong) <= 2, sorted(wrong)


def test_short_sentences_are_looked_up_whole(spark):
    items = spark.createDataFrame([(1, "en", "Wait here. The blue harbour reader keeps 77 lanterns by the granite door.", "Why?", "", 0, "x")], ITEM)
    docs = spark.createDataFrame([(1, "First this. Wait here. Then that."), (2, "They wait here for long. Wait there."), (3, "Wait\nhere.\n\nMore words follow."), (4, "So why? Nobody knows."), (5, "Nobody. Why? None.")], "doc_id long, text string")
    assert {r.doc_id for r in leaks.leaked_items(spark, docs, items).collect()} == {1, 3, 5}


def test_space_is_that_of_every_document(spark, monkeypatch):
    """Words of one document in thousands have their place in it: no document is left out of the decomposition."""
    seen, item_rows = [], leaks._item_rows
    monkeypatch.setattr(leaks, "_item_rows", lambda shared: seen.append(shared.value[0]) or item_rows(shared))
    rows = [(i, f"zalpha{i} zbeta{i}") if i < 50 else (i, f"common{i % 20} words{i % 20}") for i in range(6000)]
    items = spark.createDataFrame([(1, "en", "One item stands here alone.", None, None, 0, "x")], ITEM)
    leaks.leaked_items(spark, spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    hashed = leaks.arrays.bins(leaks.arrays.tokenize([t for _, t in rows[:50]]).hash, leaks.FEATURES)
    assert len(hashed) == 100 and (np.abs(seen[0][hashed]).max(1) > 1e-3).all()


def _cpu(*each):
    """Least CPU seconds of each of several functions, run by turns."""
    best = [np.inf] * len(each)
    for _ in range(9):
        for k, f in enumerate(each):
            began = time.thread_time()
            f()
            best[k] = min(best[k], time.thread_time() - began)
    return best


def test_sums_of_rows_are_right_and_cheap():
    """As reduceat gives them, which goes through the rows once a column, in at most three quarters of its CPU time."""
    rng = np.random.default_rng(2)
    size = np.maximum(1, rng.gamma(2, 10, 6000).astype(int))
    size[77] = 5000
    first, ids = np.cumsum(size) - size, (rng.random(int(size.sum())) ** 4 * leaks.FEATURES).astype(np.uint16)
    basis = rng.standard_normal((leaks.FEATURES, 112)).astype(np.float32)
    ends = np.append(first, len(ids))

    def slow():
        return np.concatenate([np.add.reduceat(basis.take(ids[ends[a] : ends[min(a + 48, len(first))]], 0), first[a : a + 48] - first[a], axis=0) for a in range(0, len(first), 48)])

    assert np.allclose(leaks.project(ids, first, basis), slow(), atol=1e-2)
    assert leaks.project(ids[:0], first[:0], basis).shape == (0, 112)
    fast, slowly = _cpu(lambda: leaks.project(ids, first, basis), slow)
    assert fast < 0.75 * slowly


def test_product_is_that_of_the_whole_matrix(monkeypatch):
    """Of (A'A)q nothing is lost where words occur in more rows than are added at once, or texts come in several stretches."""
    monkeypatch.setattr(leaks, "_AT_ONCE", 500)
    monkeypatch.setattr(leaks, "_RUN", 4)
    monkeypatch.setattr(leaks, "_ABREAST", 3)
    rng = np.random.default_rng(4)
    sizes = [rng.integers(1, 30, rng.integers(0, 9)).astype(np.int32) for _ in range(60)]
    words = [np.where(rng.random(x.sum()) < 0.4, 5, rng.integers(0, leaks.FEATURES, x.sum())).astype(np.uint16) for x in sizes]
    own = rng.random(60) < 0.2
    weight, q = (rng.random(leaks.FEATURES) + 0.1).astype(np.float32), rng.standard_normal((leaks.FEATURES, 6)).astype(np.float32)
    dense = np.zeros((sum(map(len, sizes)), leaks.FEATURES))
    np.add.at(dense, (np.repeat(np.arange(len(dense)), np.concatenate(sizes)), np.concatenate(words)), 1)
    dense *= weight
    # a row's length is taken from its words one by one
    length = np.add.reduceat(weight[np.concatenate(words)].astype(float) ** 2, np.cumsum(np.concatenate(sizes)) - np.concatenate(sizes))
    heavy = np.where(np.repeat(own, [len(x) for x in sizes]), 3.0, 1.0)
    want = dense.T @ ((dense @ q) * (heavy / length)[:, None])
    b = pa.RecordBatch.from_arrays([pa.array(own), pa.array([x.tobytes() for x in words], pa.binary()), pa.array([x.tobytes() for x in sizes], pa.binary())], names=["own", "columns", "sizes"])
    got = np.zeros(want.shape)
    for part in leaks._power(type("Shared", (), {"value": (q, weight, 3.0)}))(iter([b])):
        got[part.column("column").to_numpy()] += part.column("part").flatten().to_numpy().reshape(-1, 6)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_kept_share_is_that_of_the_words_there(monkeypatch):
    """Table by table the same as one pair after the other."""
    rng = np.random.default_rng(6)
    vocabulary = rng.integers(1, 1 << 62, 90).astype(np.uint64)
    size = rng.integers(1, 12, 25)
    words, rarity = rng.choice(vocabulary, size.sum()), rng.random(size.sum()).astype(np.float32)
    first = np.append(0, np.cumsum(size))
    none = np.empty(0)
    block = leaks.Block(none, words, rarity, first, np.add.reduceat(rarity, first[:-1]), none, [], none, none, none, none)
    length = rng.integers(3, 20, 40)
    start, n = np.cumsum(length) - length, int(length.sum())
    text = np.repeat(np.arange(8), 5)
    s = leaks.Sentences(start, length, rng.random(40) < 0.4, text, rng.choice(np.append(vocabulary, rng.integers(1, 1 << 62, 90).astype(np.uint64)), n), np.append(start[::5], n))
    u, q = rng.integers(0, 40, 300), rng.integers(0, 25, 300)
    want = []
    for i, j in zip(u, q):
        reach = int(size.max()) if s.window[i] else 0
        near = set(s.hash[max(s.bound[text[i]], start[i] - reach) : min(s.bound[text[i] + 1], start[i] + length[i] + reach)].tolist())
        mine = slice(first[j], first[j + 1])
        want.append(sum(r for w, r in zip(words[mine].tolist(), rarity[mine]) if w in near) / rarity[mine].sum())
    for table in (1, 400, 1 << 24):
        monkeypatch.setattr(leaks, "TABLE", table)
        assert np.allclose(block.kept_share(s, u, q), want, atol=1e-5)
    assert len(block.kept_share(s, u[:0], q[:0])) == 0
