"""Methods without a fixed contract: string tiling, classifier chain, recurrent network, trees, similarity search, pipeline."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from stratica.llm import decontam, gru, lm, quality, simhash, toxicity, transducer, trees
from tests.llm.fixtures import FIRST, awkward, empty, rows_of


def slow_tiles(doc: list, item: list, least: int) -> int:
    """Words covered by greedy tiling, by looking at all pairs of starts."""
    free_d, free_i, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and free_i[i + n] and free_d[d + n] and item[i + n] == doc[d + n] and doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        if best[0] < least:
            return covered
        n, i, d = best
        covered += n
        free_i[i : i + n] = free_d[d : d + n] = [False] * n


def test_greedy_tiles_against_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        doc, item = rng.integers(0, 4, rng.integers(0, 60)), rng.integers(1, 4, rng.integers(0, 25))
        tiles = decontam.greedy_tiles(doc, item, 3)
        assert sum(t.length for t in tiles) == slow_tiles(doc.tolist(), item.tolist(), 3)
        for t in tiles:
            assert np.array_equal(doc[t.doc_start : t.doc_start + t.length], item[t.item_start : t.item_start + t.length])


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.mark.parametrize(
    "text,leaked",
    [
        (ITEM, True),
        ("Before it. " + ITEM.upper().replace(" ", ", ") + " after it", True),
        (" ".join(ITEM.split()[10:] + ["between"] * 3 + ITEM.split()[:10]), True),
        (" ".join(w if k % 7 else "other" for k, w in enumerate(ITEM.split())), True),
        (" ".join(reversed(ITEM.split())), False),
        (" ".join(ITEM.split()[:8]), False),
        ("", False),
        (None, False),
    ],
)
def test_leaks(spark, text, leaked):
    docs = spark.createDataFrame([(1, text, 5)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, "!!"), (None, "short one")], "item_id long, text string")
    for block_chars in (1 << 20, 20):
        found = decontam.find_leaks(docs, items, block_chars=block_chars).collect()
        assert [r["item_id"] for r in found] == ([1] if leaked else [])
        assert decontam.drop_leaks(docs, items, block_chars=block_chars).count() == (0 if leaked else 1)


def test_leaks_equal_tiling_of_all_pairs():
    """The search for candidates loses no item: every document is also tiled with every item, as a whole."""
    rng = np.random.default_rng(2)
    word = lambda k: f"w{k}"
    items = [[word(k) for k in rng.integers(0, 12, n)] for n in rng.integers(0, 30, 40)]
    docs = [[word(k) for k in rng.integers(0, 14, rng.integers(0, 80))] for _ in range(60)]
    docs += [docs[k] + items[k][3:] + docs[-k] + items[k][:3] for k in range(40)]
    index = decontam.SeedIndex([(k, " ".join(x).encode()) for k, x in enumerate(items)], 3)
    found = {(d, k) for d, doc in enumerate(docs) for k, _ in index.leaks(" ".join(doc).encode(), 0.5)}
    expected = set()
    for d, doc in enumerate(docs):
        codes = np.array([index.codes.get(w.encode(), 0) for w in doc], dtype=np.int64)
        for k, item in enumerate(index.items):
            if len(item) and sum(t.length for t in decontam.greedy_tiles(codes.copy(), item, index.sizes[k])) >= 0.5 * len(item):
                expected.add((d, k))
    assert found == expected and len(expected) > 40


def test_leaks_of_awkward_rows(spark, sf_dir):
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), awkward(spark)
    assert decontam.find_leaks(docs, items).count() == 0
    assert rows_of(decontam.drop_leaks(docs, items)) == rows_of(docs)
    assert decontam.find_leaks(docs, items.where("false")).count() == 0
    assert decontam.find_leaks(empty(spark), items).count() == 0
    # exact leaks of the corpus, found by substring search
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    exact = documents.alias("d").crossJoin(items.alias("i")).where("contains(d.text, i.text)").selectExpr("d.doc_id", "i.item_id")
    assert set(rows_of(exact)) <= set(rows_of(decontam.find_leaks(documents, items), "doc_id", "item_id"))


def test_chain_equals_a_plain_one():
    """The links and their out-of-fold inputs against the same chain written out link by link, and categories from any vocabulary."""
    rng = np.random.default_rng(4)
    bad = rng.integers(1 << 40, 1 << 41, 8)
    label = rng.random(400) < 0.3
    features = [np.unique(np.concatenate([rng.integers(0, 300, 12), rng.choice(bad, rng.integers(1, 6)) if y else rng.integers(0, 300, 2)])) for y in label]
    chain = toxicity.fit(features, label[:, None].astype(float), toxicity.CATEGORIES, ["toxic"])
    hashes, codes = np.unique(np.concatenate(features), return_inverse=True)
    rows = toxicity.Rows(codes, np.cumsum([0, *map(len, features)]))
    fold = np.arange(400) % toxicity.FOLDS
    marks = np.zeros(400)
    for i in range(400):  # markers of the other folds, row by row
        use = [j for j in range(400) if fold[j] != fold[i]]
        z = toxicity.association(rows, label.astype(float), np.isin(np.arange(400), use), len(hashes))
        top = [k for k in np.argsort(-z, kind="stable")[: toxicity.MARKERS] if z[k] > toxicity.LEAST_Z]
        marks[i] = len(set(hashes[top].tolist()) & set(features[i].tolist()))
    least = {c.name: 0.0 if c.quantile is None else max(1.0, np.quantile(marks[label], c.quantile)) for c in toxicity.CATEGORIES}
    before, links = np.zeros((400, 3)), []
    for k, c in enumerate(toxicity.CATEGORIES):
        target = (label & (marks >= least[c.name])).astype(float)
        assert 0 < target.sum() < 400
        links.append(toxicity.fit_link(rows, before[:, :k], target, np.ones(400, bool), len(hashes)))
        for f in range(toxicity.FOLDS):
            other = toxicity.fit_link(rows, before[:, :k], target, fold != f, len(hashes))
            before[fold == f, k] = toxicity.sigmoid(other.logits(rows, before[:, :k]))[fold == f]
    assert set(hashes[marks_of(rows, label, len(hashes))].tolist()) >= set(bad.tolist())
    seen = np.zeros((400, 3))
    for k, link in enumerate(links):  # scoring: every link gets what the chain itself said before
        weight = dict(zip(hashes[link.codes].tolist(), link.weights.tolist(), strict=True))
        for i, own in enumerate(features):
            seen[i, k] = toxicity.sigmoid(link.bias + sum(weight.get(h, 0.0) for h in own.tolist()) + float(seen[i, :k] @ link.earlier))
    for i, own in enumerate(features):
        raw = chain.weights[[chain.table[h] for h in own.tolist() if h in chain.table]].sum(axis=0)
        p = np.zeros(3)
        for k in range(3):
            p[k] = toxicity.sigmoid(chain.bias[k] + raw[k] + p[:k] @ chain.earlier[k, :k])
        assert np.allclose(p, seen[i], atol=1e-9)
    assert chain.earlier[1, 0] != 0 and chain.earlier[2, :2].any()


def marks_of(rows, label, n):
    z = toxicity.association(rows, label.astype(float), np.ones(len(label), bool), n)
    return [k for k in np.argsort(-z, kind="stable")[: toxicity.MARKERS] if z[k] > toxicity.LEAST_Z]


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(k % 3, f"text number {k} of some words") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "fit", lambda features, *_: seen.append(len(features)))
        toxicity.fit_chain(docs, labels)
        patch.setattr(quality, "fit_trees", lambda x, *_: seen.append(len(x)))
        quality.fit_quality(docs, labels)
    assert seen == [3, 3]


def test_toxicity(spark, sf_dir):
    documents, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.fit_chain(documents, labels.where("doc_id % 4 <> 0"))
    scored = toxicity.score_toxicity(documents, chain)
    held = scored.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert sum(r["is_toxic"] == (r["toxic"] == 1) for r in held) >= 0.95 * len(held) and sum(r["toxic"] for r in held) > 5
    rows = awkward(spark)
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, chain).collect()}
    assert len(toxicity.score_toxicity(rows, chain).collect()) == rows.count()
    assert [found[FIRST + k]["p_toxic"] for k in (2, 3, 4)] == [0.0] * 3
    kept = rows.join(toxicity.score_toxicity(rows, chain).where("not is_toxic").select("doc_id").distinct(), "doc_id", "left_semi")
    assert rows_of(toxicity.drop_toxic(rows, chain).where("doc_id is not null")) == rows_of(kept)
    assert toxicity.score_toxicity(empty(spark), chain).count() == 0
    nothing = toxicity.fit_chain(documents, labels.where("false"))
    assert toxicity.score_toxicity(documents, nothing).where("is_toxic and p_toxic < 0.5").count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    words = [[b"bad"] * int(b) + [b"w%d" % k for k in rng.integers(0, 50, 5)] for b in rng.integers(0, 2, 400)]
    first = np.array([b"bad" in w for w in words], float)
    categories = [toxicity.Category("a", "bad"), toxicity.Category("b", "bad")]
    chain = toxicity.fit([toxicity.distinct_features(w) for w in words], first[:, None], categories, ["bad"])
    p = chain.probabilities([b"bad w1", b"w1 w2", b""])
    assert p[0].min() > 0.9 and p[1].max() < 0.1 and p[2].max() == 0 and chain.earlier[1, 0] > 0


def test_gru_gradients():
    rng = np.random.default_rng(4)
    w = gru.initial(rng.random(12), 3, 4, 5)
    for a in w.items():
        a += rng.standard_normal(a.shape).astype(np.float32) * 0.3
    w = gru.Weights(*[a.astype(np.float64) for a in w.items()])
    window = rng.integers(0, 12, (6, 3))
    window[4:, 1] = gru.NOTHING
    loss, grad, _ = gru.gradients(w, np.zeros((3, 5)), window, end=2)
    for a, g in zip(w.items(), grad.items(), strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in a.shape)
            before = a[at]
            a[at] = before + 1e-5
            up = gru.gradients(w, np.zeros((3, 5)), window, end=2)[0]
            a[at] = before - 1e-5
            down = gru.gradients(w, np.zeros((3, 5)), window, end=2)[0]
            a[at] = before
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_gru_scores_are_probabilities_over_whole_documents():
    rng = np.random.default_rng(6)
    w = gru.initial(rng.random(12), 3, 4, 5)
    for a in w.items():
        a += rng.standard_normal(a.shape).astype(np.float32) * 0.3
    documents = [rng.integers(0, 12, n) for n in (1, 31, 32, 33, 100, 7)]
    expected = []
    for d in documents:  # word by word, with the softmax over all words
        h, total = np.zeros((1, 5), np.float32), 0.0
        for token in d:
            each = gru.log_likelihood(w, np.repeat(h, 12, axis=0), np.arange(12))
            assert abs(np.exp(each).sum() - 1) < 1e-4
            total += each[token]
            h, _ = gru.step(w, h, w.x[[token]])
        expected.append(total)
    assert np.allclose(gru.score(w, documents, together=4), expected, atol=1e-3)
    assert w.unpack(w.pack()).pack() == w.pack()


def test_trees_are_monotonic():
    rng = np.random.default_rng(8)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600) > 0.6) ^ (x[:, 1] > 0.8)).astype(float)
    fitted = trees.fit_trees(x, y, np.array([1, 0, -1]))
    assert ((fitted.probability(x) > 0.5) == (y > 0.5)).mean() > 0.85
    for f, sign in ((0, 1), (2, -1)):
        for row in x[:20]:
            line = np.repeat(row[None], 50, axis=0)
            line[:, f] = np.linspace(0, 1, 50)
            assert (np.diff(fitted.raw(line)) * sign >= -1e-9).all()


def test_transducer(tmp_path):
    words = {f"{a}{b}{c}".encode(): [k, k + 1][: k % 3] for k, (a, b, c) in enumerate((a, b, c) for a in ("", "un", "re") for b in ("do", "play", "tie") for c in ("", "ing", "s"))}
    path = tmp_path / "lexicon"
    path.write_bytes(transducer.compile_lexicon(words))
    lexicon = transducer.Lexicon(str(path))
    asked = [*words, b"", b"un", b"doin", b"playings", b"\xff"]
    for word, ids in zip(asked, lexicon.outputs_of(asked), strict=True):
        assert ids == (np.array(words[word], "<u4").tobytes() if word in words else None)
    assert len(lexicon.final) < 25  # suffixes are shared


def near_copies(spark):
    rng = np.random.default_rng(11)
    rows, group = [], {}
    for g in range(30):
        words = [f"w{k}" for k in rng.integers(0, 5000, 300)]
        for c in range(6):
            own = list(words)
            for k in rng.choice(300, int(rng.integers(0, 6)), replace=False):
                own[k] = f"n{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(own)))
            group[len(rows) - 1] = g
    return spark.createDataFrame(rows, "doc_id long, text string"), group


def test_similar_documents(spark):
    docs, group = near_copies(spark)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()}
    texts = {r["doc_id"]: r["text"].split() for r in docs.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}
    links = [(a, b) for a in group for b in group if a < b and len(sets[a] & sets[b]) >= 0.83 * len(sets[a] | sets[b])]
    assert len(links) > 100 and sum(found[a] == found[b] for a, b in links) >= 0.95 * len(links)
    assert all(group[found[k]] == group[k] for k in found)


def test_one_of_each_stays(spark):
    docs = awkward(spark)
    found = rows_of(simhash.keep_one_of_each(docs), "doc_id")
    # 2, 3, 4 and the null text of the null id have no words; 7, 7 and 8 are copies; all else differs
    assert found == sorted([(FIRST + k,) for k in (1, 2, 5, 6, 7, 9, 10, 11)] + [(None,)], key=repr)
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


def test_pipeline_equals_its_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = documents
    steps = [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.stored(stage(spark, kept, sf_dir), f"test-{name}")
        assert kept.columns == documents.columns
        steps.append(kept.count())
    assert all(a > b for a, b in zip(steps, steps[1:], strict=False))
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == ids
    texts = [r["text"] for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(item in text for item in items for text in texts)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in labels.where("toxic = 0 and quality = 1").collect()} & {r["doc_id"] for r in documents.collect()}
    assert len(ids & toxic) <= 0.05 * len(toxic)
    judged = corpus_pipeline.quality_rules(spark, documents, sf_dir)
    assert len(clean & {r["doc_id"] for r in corpus_pipeline.toxicity_filter(spark, judged, sf_dir).collect()}) >= 0.95 * len(clean)
    decoded = corpus_pipeline.encoding(spark, kept, sf_dir).join(kept, "doc_id")
    assert decoded.where("decoded <> text").count() == 0


def exact_components(texts: dict[int, str], similarity: float = 0.8) -> dict[int, int]:
    """Smallest id reachable by links of at least that Jaccard similarity, by comparing all pairs."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.split()) for k, t in texts.items())}
    root = {k: k for k in texts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and top(a) != top(b) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in texts}


def test_unlike_documents_that_share_half_their_text(spark):
    """300 documents with a common half, among which pairs of about 0.85 are planted, and near copies of one document."""
    rng = np.random.default_rng(5)
    half = [f"c{k}" for k in range(150)]
    texts = {}
    for _ in range(260):
        texts[len(texts)] = half + [f"w{k}" for k in rng.integers(0, 10**6, 150)]
    for k in range(40):
        own = list(texts[k])
        for at in rng.choice(np.arange(150, 295), 5, replace=False):
            own[at] = f"n{rng.integers(0, 10**6)}"
        texts[len(texts)] = own
    base = [f"b{k}" for k in range(200)]
    for _ in range(60):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(1, 6)), replace=False):
            own[at] = f"m{rng.integers(0, 10**6)}"
        texts[len(texts)] = own
    texts = {k: " ".join(w) for k, w in texts.items()}
    expected = exact_components(texts)
    assert sum(expected[k] != k for k in range(260, 300)) >= 35
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == expected


def test_network_trains_on_every_training_document_once(spark, monkeypatch):
    texts = {k: " ".join(f"w{(k * 7 + j) % 900}" for j in range(300)) for k in range(1500)}  # 450,000 tokens
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = []

    def train_round(sample, replicas, model, text_col, rate):
        seen.extend(r[0] for r in sample.select(text_col).collect())
        return model.weights

    monkeypatch.setattr(lm, "train_round", train_round)
    lm.fit_model(docs, lm.stored(lm.count_words(docs, "text"), "counts"))
    assert sorted(seen) == sorted(texts.values())


def test_links_are_exact_at_the_threshold(spark):
    """Pairs of 90 shingles each: 80 in common are 0.80 of all 100, 79 are less."""
    texts, expected = {}, {}
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(94)]
        common = 80 if g % 2 else 79
        texts[2 * g], texts[2 * g + 1] = " ".join(words), " ".join(words[: common + 4] + [f"g{g}n{k}" for k in range(90 - common)])
        expected |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (common < 80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == expected


def test_scores_with_an_empty_head(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    counts = lm.stored(lm.count_words(docs, "text"), "counts")
    model = lm.build_model(counts, head=1, classes=4, class_size=8, hidden=4)
    assert not model.words and [r["n_known"] for r in lm.score_texts(docs, model, counts).collect()] == [4, 4]


def test_links_do_not_hang_on_the_order_of_shingles_or_sizes(spark, monkeypatch):
    """With no common shingles known, one pivot and small cells, as where tables are large, the links are the same."""
    docs, _ = near_copies(spark)
    expected = exact_components({r["doc_id"]: r["text"] for r in docs.collect()})
    for name, value in (("PIVOTS", 1), ("CELL_SHINGLES", 700)):
        monkeypatch.setattr(simhash, name, value)
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: simhash.Common(np.zeros(0, np.uint64), np.zeros(0, np.int8)))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == expected
