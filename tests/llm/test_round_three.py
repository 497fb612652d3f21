"""Centroid clustering, the tree encoder and the filter audit against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest

from stratica.llm import audit, exponion, monoid, quality, queries
from stratica.llm import trees as trees_module
from tests.llm.fixtures import awkward, empty, rows_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op13_filter_audit"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found, *columns) == sorted(result.fetchall(), key=repr)


# clustering


def plain_clusters(rows: list[tuple], count: int, rounds: int) -> list[tuple]:
    """All vectors against all centroids, in Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:count]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    if not centroids:
        return []
    for r in range(rounds + 1):
        own = [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                if members := [v for (_, v), (_, k) in zip(kept, own, strict=True) if k == j]:
                    centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True)]


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.mark.parametrize("spread", [0.02, 1.0, 5_000.0])
def test_clusters_equal_all_comparisons(spark, spread):
    """Few distinct values make ties, repeated vectors and empty clusters; large ones leave exact float64."""
    rng = np.random.default_rng(int(spread * 100))
    rows = [(k, (rng.integers(-2, 3, 64) * spread + (k % 7) * spread).astype(np.float32).tolist()) for k in range(160)]
    rows += [(200 + k, rows[3][1]) for k in range(60)] + [(3, rows[3][1]), (None, rows[5][1])]
    bad = [(500, None), (501, []), (502, rows[0][1][:63]), (503, [None, *rows[0][1][1:]]), (504, [math.nan, *rows[0][1][1:]]), (505, [math.inf, *rows[0][1][1:]]), (506, [3e38, *rows[0][1][1:]])]
    frame = spark.createDataFrame([(i, v, 1, 1, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, cluster int, n long, id long").repartition(5)
    expected = plain_clusters(rows, 40, 5)
    assert rows_of(exponion.cluster_vectors(frame), *COLUMNS) == sorted(expected, key=repr)


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert exponion.cluster_vectors(spark.createDataFrame([], schema)).count() == 0
    assert exponion.cluster_vectors(spark.createDataFrame([(None, [0.5] * 64), (1, [0.5] * 63)], schema)).count() == 0
    rows = [(1, [0.5] * 64), (1, [0.5] * 64), (2, [-0.25] * 64)]
    for some in (rows[:1], rows):
        assert rows_of(exponion.cluster_vectors(spark.createDataFrame(some, schema)), *COLUMNS) == sorted(plain_clusters(some, 40, 5), key=repr)


def test_balls_save_comparisons():
    """Bounds and balls give what all comparisons give, with a part of them."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 64))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 64))
    model = exponion.Centroids(x[:40].copy(), np.zeros(40))
    cluster, upper, lower = exponion.nearest(x, model, np.arange(40))
    compared = 0
    for _ in range(6):
        values = np.array([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else model.values[j] for j in range(40)])
        model = exponion.Centroids(values, np.sqrt(((values - model.values) ** 2).sum(axis=1)))
        cluster, upper, lower, n = exponion.search(x, model, cluster, upper, lower)
        compared += n
        assert np.array_equal(cluster, exponion.distances(x, model, np.arange(40)).argmin(axis=1))
        apart = np.sqrt(exponion.distances(x, model, np.arange(40)).astype(float))
        apart[np.arange(len(x)), cluster] = np.inf
        assert (lower <= apart.min(axis=1) + 1e-6).all()
    assert compared < 0.5 * 6 * 3000 * 40


# tree encoder


@pytest.fixture(scope="module")
def ranks():
    return monoid.Ranks(Path(RANKS).read_bytes(), public_tokenizers.PATTERN)


def test_tree_equals_the_library(spark, documents, ranks):
    docs = awkward(spark).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    expected = [(r["doc_id"], tuple(ranks.library.encode_ordinary(r["text"] or "")), bytearray((r["text"] or "").encode())) for r in docs.collect()]
    for leaf in (7, monoid.LEAF):
        codec = monoid.TreeCodec(awkward(spark).drop("ids"), RANKS, public_tokenizers.PATTERN, leaf)
        assert rows_of(codec.decode(codec.encode(docs)), "doc_id", "ids", "decoded") == sorted(expected, key=repr)
        packed = [(i, len(ids), bytearray(np.array(ids, "<u4").tobytes()), text) for i, ids, text in expected]
        assert rows_of(codec.round_trip(docs), "doc_id", "n_tokens", "packed", "decoded") == sorted(packed, key=repr)
    assert codec.decode(codec.encode(empty(spark))).count() == 0 and codec.round_trip(empty(spark)).count() == 0


ALPHABETS = ["abcdefgh", "ABCé ü", "漢字日本語、。", "12345", "  \n\t\r　\xa0", "'s't're", "'!?.,;—…", "👍🏽​᠎ก́", "\x00\x1c\x1d\x1f\x85", " the of and"]


def test_joins_at_any_border(ranks, monkeypatch):
    """Texts of all kinds of characters, halved down to single ones, with small windows and early joins by tokens."""
    rng = random.Random(7)
    for _ in range(250):
        parts = []
        for _ in range(rng.randint(1, 10)):
            letters, n = rng.choice(ALPHABETS), rng.choice([1, 2, 3, 8, 30, 300])
            parts.append("".join(rng.choice(letters) for _ in range(n)) if rng.random() < 0.7 else rng.choice(letters) * n)
        text = "".join(parts)
        monkeypatch.setattr(monoid, "LONG", rng.choice([64, 1024]))
        monkeypatch.setattr(monoid, "WINDOW", rng.choice([1, 4, 32]))
        tree = monoid.Tree(ranks, rng.choice([1, 2, 5, 17, 64, 500]))
        ids = tree.encode(text)
        assert ids.tolist() == ranks.library.encode_ordinary(text)
        assert tree.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["x" * 50_000, "漢字" * 20_000, " " * 30_000 + "a", "ab'" * 10_000, "!" * 20_000 + "'s", "é" * 30_001])
def test_long_pieces(ranks, text):
    assert monoid.Tree(ranks).encode(text).tolist() == ranks.library.encode_ordinary(text)


def test_neighbours_decide_an_encoding(ranks):
    """The rule behind joins by tokens, tried on random bytes: tokens are an encoding if and only if all neighbours are."""
    rng = random.Random(1)
    for _ in range(400):
        piece = "".join(rng.choice("abeinorst") for _ in range(rng.randint(30, 40))).encode()
        ids = ranks.merged(piece).tolist()
        both = lambda a, b: ranks.merged(ranks.outputs[a] + ranks.outputs[b]).tolist() == [a, b]
        assert all(both(a, b) for a, b in zip(ids, ids[1:], strict=False))
        cut = rng.randint(1, len(piece) - 1)
        halves = [*ranks.merged(piece[:cut]).tolist(), *ranks.merged(piece[cut:]).tolist()]
        assert all(both(a, b) for a, b in zip(halves, halves[1:], strict=False)) == (halves == ids)


# filter audit


def plain_audit(rows: list[tuple], labels: dict) -> list[tuple]:
    """Every order, document by document; rows: (id, text, source)."""
    first: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {x for x, yes in {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}.items() if yes}
        docs.append((source or "", failed, *labels.get(i, (0, 0))))
    out, totals = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            for step, x in enumerate(order, 1):
                own = [d for d in docs if d[0] == part and x in d[1]]
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                totals[part, x] += len(gone)
                out[part, order, step] = (len(left), len(gone), len(own) - len(gone), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
    return [(part, order, step, *v, totals[part, order[step - 1]]) for (part, order, step), v in out.items()]


def test_audit_of_awkward_rows(spark, documents):
    names = ("doc_id", "text", "source")
    docs = awkward(spark).select(*names).unionByName(documents.where("length(text) < 3000").select(*names)).unionByName(spark.createDataFrame([(2_000_000, "same text here twice", "src"), (2_000_001, "", None)], "doc_id long, text string, source string"))
    labels = spark.createDataFrame([(1_000_001, 1, 0), (1_000_008, 1, 1), (1_000_008, 0, None), (2_000_000, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    expected = plain_audit([tuple(r) for r in docs.collect()], {1_000_001: (1, 0), 1_000_008: (1, 1), 2_000_000: (0, 1), 3: (1, 0)})
    extra = docs.withColumns({"part": docs.doc_id, "doc": docs.doc_id, "mask": docs.doc_id, "first": docs.doc_id, "quality": docs.doc_id, "digest": docs.doc_id})
    found = audit.audit_filters(extra, labels.withColumn("n", labels.toxic))
    assert rows_of(found, "part", "filter_order", "step", *audit.COUNTS) == sorted(expected, key=repr)
    assert audit.audit_filters(empty(spark), labels).count() == 0
    assert {r["good_lost"] for r in audit.audit_filters(docs, labels.limit(0)).collect()} == {0}


def test_removal_polynomial():
    """Corners are counts, and the integral of a derivative is the mean over all orders."""
    rng = random.Random(2)
    counts = [rng.randint(0, 50) for _ in range(32)]
    removal = audit.Removal(counts)
    for chosen in range(32):
        assert removal.corner(chosen) == sum(n for m, n in enumerate(counts) if m & chosen)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += sum(n for m, n in enumerate(counts) if m >> i & 1 and not m & before)
        assert 120 * removal.shapley(i) == total


# quality rules: the verdict by a plain version


def plain_boost(x: list[list[float]], y: list[float], monotone: list[int], n_trees: int, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 10):
    """Boosted trees with loops over rows and cuts; trees are nested tuples (feature, cut, left, right) or leaf values."""
    n, n_features = len(x), len(x[0])
    prior = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    base = math.log(prior / (1 - prior))
    cuts = [sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(n_features)]
    score, trees = [base] * n, []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return min(max(-g / (h + l2), low), high)

    def gain_of(g: float, h: float, v: float) -> float:
        return -(g * v + 0.5 * (h + l2) * v * v)

    def grow(rows: list[int], grad, hess, level: int, low: float, high: float):
        g, h = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        value, best, found = leaf(g, h, low, high), 1e-6, None
        for f in range(n_features if level < depth and len(rows) >= 2 * min_rows else 0):
            for cut in cuts[f]:
                left = [i for i in rows if x[i][f] <= cut]
                if min(len(left), len(rows) - len(left)) < min_rows:
                    continue
                gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                vl, vr = leaf(gl, hl, low, high), leaf(g - gl, h - hl, low, high)
                if monotone[f] and (vr - vl) * monotone[f] < 0:
                    continue
                gain = gain_of(gl, hl, vl) + gain_of(g - gl, h - hl, vr) - gain_of(g, h, value)
                if gain > best + 1e-9:
                    best, found = gain, (f, cut, vl, vr, left)
        if found is None:
            for i in rows:
                score[i] += rate * value
            return rate * value
        f, cut, vl, vr, left = found
        middle, right = (vl + vr) / 2, [i for i in rows if i not in set(found[4])]
        a, b = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
        return f, cut, grow(left, grad, hess, level + 1, *a), grow(right, grad, hess, level + 1, *b)

    for _ in range(n_trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        trees.append(grow(list(range(n)), [a - b for a, b in zip(p, y, strict=True)], [max(a * (1 - a), 1e-6) for a in p], 0, -math.inf, math.inf))
    return base, trees


def plain_probability(base: float, trees: list, row: list[float]) -> float:
    total = base
    for node in trees:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        total += node
    return 1 / (1 + math.exp(-total))


def test_trees_equal_plain_ones():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(140, 4)), 2)
    y = ((x[:, 0] - 0.7 * x[:, 1] + 0.4 * rng.normal(size=140)) > 0).astype(float)
    monotone = [1, -1, 0, -1]
    fitted = trees_module.fit_trees(x, y, np.array(monotone), n_trees=6)
    base, plain = plain_boost(x.tolist(), y.tolist(), monotone, 6)
    expected = [plain_probability(base, plain, r) for r in x.tolist()]
    assert np.allclose(fitted.probability(x), expected, atol=1e-9)


def plain_features(text: str) -> list[float]:
    """The features of ``quality.FEATURES`` from the text, one by one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, some = len(words), max(len(words), 1)
    windows = Counter(tuple(words[k : k + 3]) for k in range(n - 2))
    repeated = {k + j for k in range(n - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, words))
    size = [len(w.encode()) for w in words]
    share = lambda pattern, of: len(re.findall(pattern, text)) / of
    stops = {w.decode() for w in quality.STOP_WORDS}
    lower = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    return [
        math.log1p(n), chars / some, share(r"[#*$%&|<>]", some), (len(lines) - len(set(lines))) / max(len(lines), 1), len(repeated) / some, len(set(words)) / some, share("[A-Z]", max(chars, 1)), share("[0-9]", max(chars, 1)),
        share("[!?]", some), n / max(len(lines), 1), sum(s <= 3 for s in size) / some, sum(s > 20 for s in size) / some, sum(lower(w) in stops for w in words) / some,
    ]


def test_quality_verdicts_anew(spark, sf_dir, documents):
    """``kept`` from plain features, walked through the fitted trees node by node."""
    fitted = quality.fit_quality(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = awkward(spark).select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    judged = {(r["doc_id"], r["n_words"], r["n_symbols"]): (r["base_failed"], r["kept"], r["score"]) for r in quality.judge_quality(docs, fitted).collect()}
    verdicts = Counter()
    for doc_id, text in [(r["doc_id"], r["text"] or "") for r in docs.collect()]:
        row, words = plain_features(text), re.findall(r"[^\x20\x09-\x0D]+", text)
        total = fitted.base
        for node in fitted.roots.tolist():
            while fitted.left[node] != node:
                node = int(fitted.left[node] if row[fitted.feature[node]] <= fitted.threshold[node] else fitted.right[node])
            total += fitted.value[node]
        failed, kept, score = judged[doc_id, len(words), len(re.findall(r"[#*$%&|<>]", text))]
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
        assert failed == (len(words) < 50 or 100 * row[4] * len(words) > 50 * len(words) + 1e-6) and kept == (not failed and score >= 0.5)
        verdicts[failed, kept] += 1
    assert verdicts[False, True] and verdicts[True, False] and verdicts[False, False]
