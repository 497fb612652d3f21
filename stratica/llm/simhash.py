"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 r bits share a variant that differs from either in at most r bits.  So
every distinct fingerprint emits all variants within half the radius, the variants are shuffled, and fingerprints
that meet on a variant are verified by their Hamming distance.  Only distinct fingerprints are shuffled: a group of
copies of any size is one row, and a variant can be met by no more fingerprints than its own ball holds (65 at
half-radius 1), so no group grows with the data.  Neighbours in a group are linked as a chain, never as all pairs.

The similarity search (``similar_documents``, ``keep_one_of_each``) starts from the same balls: texts whose fingerprints
meet are candidates, and their whole shingle sets decide.  Fingerprints of texts at a Jaccard similarity of 0.8 differ in
about ten of 64 bits, more than a ball of radius 2 reaches, so an exact completion follows: all texts that the balls left
apart and that share one of their rarest shingles are compared as well, which every pair at the similarity does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratica.llm.common import ascii_lower, drop_stored, map_rows, stored, texts

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
#: Similarity search: words of a shingle and the similarity that links.
WIDE_WORDS = 5
SIMILARITY = 0.8
#: Texts by which shingles are ordered, and most common shingles that travel with the tasks; they decide costs only.
ORDER_ROWS = 100_000
MOST_COMMON = 250_000
#: Rounds in which every node is compared with one pivot before all that is left is compared; shingles of the texts that
#: are held side by side while others are compared with them.
PIVOTS = 2
CELL_SHINGLES = 400_000


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of blank-joined words, repeats included; the whole sequence where it is shorter; none for no words."""
    import xxhash

    split = text.split()
    if not split:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(split)
    n = len(split) - words + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[:n].tolist(), (ends - 1)[words - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes; zero for no hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    for at in range(0, len(octets), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Id and ``_fp`` (the fingerprint as a signed long) of every row; a null text has no words."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("_fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prints = np.array([fingerprint(shingle_hashes(ascii_lower(t), shingle_words)) for t in texts(rows.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(prints.view(np.int64))], names=schema.names)

    return map_rows(docs.select(id_col, F.col(text_col).cast("string")), run, schema)


def ball_masks(half_radius: int) -> list[int]:
    """All 64-bit masks with at most ``half_radius`` ones, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(half_radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a < b) that connect all distinct ``_fp`` within ``radius`` bits of each other, as chains.

    With an odd radius the half is rounded up, and the verification leaves out pairs beyond the radius; there and
    for half-radii over 1 all ordered neighbours within the ball are compared, since a chain could break.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(half)])
    variants = prints.select("_fp", F.explode(F.transform(masks, lambda m: F.col("_fp").bitwiseXOR(m))).alias("_variant"))
    if radius == 2 * half:  # all that meet on a variant are within 2 * half = radius of each other
        met = variants.withColumn("a", F.lag("_fp").over(Window.partitionBy("_variant").orderBy("_fp"))).where("a is not null").select("a", F.col("_fp").alias("b"))
    else:
        group = variants.groupBy("_variant").agg(F.sort_array(F.collect_set("_fp")).alias("_all")).where(F.size("_all") > 1)
        met = group.select(F.posexplode("_all").alias("_at", "a"), "_all").select("a", F.explode(F.expr("slice(_all, _at + 2, size(_all))")).alias("b"))
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def stored_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges (u, v) in the shared folder, and their number and hash, which are taken while they are written."""
    seen = Observation()
    kept = stored(edges.distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash")), "links")
    return kept, (seen.get["n"], seen.get["hash"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with a link; large-star and small-star rounds.

    Each round's links are written to the shared folder, so lineage stays short and survives lost executors.
    A node's smallest neighbour is a partial aggregate; the join back is an equi-join that adaptive execution can
    split where one node has very many neighbours.
    """
    edges, now = stored_edges(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    for _ in range(max_rounds if now[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: every smaller neighbour of u, and u, hang on the smallest of them
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        before = now
        following, now = stored_edges(small.where("u <> v"))
        drop_stored(edges)
        edges = following
        if before == now:
            break
    else:
        if now[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Texts without words share the zero fingerprint and are linked like any other.  Rows with a null id take part;
    a component of null ids only has a null component_id.  Repeated rows are repeated; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = prints.groupBy("_fp").agg(F.min(id_col).alias("_least"))
    roots = components(ball_links(distinct.select("_fp"), radius))
    rooted = stored(distinct.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root")), "fingerprint-roots")
    least = stored(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")), "fingerprint-components")
    # both sides are read anew, so that adaptive execution can split a component or a text with very many rows
    classes = stored(rooted.join(least, "_root").select("_fp", "component_id"), "fingerprint-classes")
    drop_stored(rooted, least)
    return prints.join(classes, "_fp").select(id_col, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text_col: str) -> Column:
    """A hash of the text that tells a null from any text."""
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col).cast("string"))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(ascii_lower(text), words))


@dataclass(frozen=True)
class Common:
    """Shingles found often, ascending, and the range of each one's count; all others have range 0.

    They only say in which order the shingles of a text are taken, so a shingle that is missing here costs time, never a link.
    """

    hashes: np.ndarray
    levels: np.ndarray

    def rarest(self, hashes: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` first of distinct hashes in the order that all texts share: rare ones before common ones."""
        levels = np.zeros(len(hashes), dtype=np.int8)
        if len(self.hashes) and len(hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            levels = np.where(self.hashes[at] == hashes, self.levels[at], 0)
        return hashes[np.lexsort((hashes, levels))[:n]]


def common_shingles(docs: DataFrame, text_col: str, shingle_words: int, rows: int = ORDER_ROWS, most: int = MOST_COMMON) -> Common:
    """At most about ``most`` shingles of the highest counts among some ``rows`` texts."""
    total = docs.count()
    some = docs.select(F.col(text_col).cast("string").alias("_text")).where(F.pmod(F.xxhash64("_text"), F.lit(max(1, -(-total // rows)))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle_words) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))], names=["_shingle"])

    counts = stored(map_rows(some, run, "_shingle long").groupBy("_shingle").agg(F.count("*").alias("n")).where("n > 2").select("_shingle", F.floor(F.log2("n") * 2).cast("int").alias("level")), "shingle-counts")
    room, chosen = most, F.lit(False)
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        of = F.col("level") == r["level"]
        chosen = chosen | (of if r["n"] <= room else of & (F.pmod("_shingle", F.lit(1 << 20)) < int(room / r["n"] * (1 << 20))))
        room -= min(room, r["n"])
    found = counts.where(chosen).toArrow()  # bounded by ``most``
    drop_stored(counts)
    hashes, levels = found["_shingle"].to_numpy().view(np.uint64), found["level"].to_numpy().astype(np.int8)
    order = np.argsort(hashes)
    return Common(hashes[order], levels[order])


def least_overlap(n: int, similarity: float) -> int:
    """The fewest shingles that a text of ``n`` shares with any text of at least that similarity."""
    return math.ceil(similarity * n - 1e-9)


def least_overlap_with_larger(n: int, similarity: float) -> int:
    """The fewest shingles that a text of ``n`` shares with any text of at least that similarity that has no fewer shingles."""
    return math.ceil(2 * similarity / (1 + similarity) * n - 1e-9)


def shingled(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """Id, ``_key`` (a hash of the text), ``_node`` (a hash of its shingle set), ``_size`` of the set, ``_fp``, ``_rare`` and ``_first`` of every row.

    ``_fp`` is the fingerprint.  ``_rare`` are the first shingles in an order that all texts share, so many that any two
    sets of at least the similarity have one in common there: they share ``least_overlap``, and only fewer than that are
    left out.  By the same count the one in common is among the ``_first`` of the smaller set.
    """
    fields = [("_key", T.LongType()), ("_node", T.LongType()), ("_size", T.IntegerType()), ("_fp", T.LongType()), ("_rare", T.ArrayType(T.LongType())), ("_first", T.IntegerType())]
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *[T.StructField(*f) for f in fields]])
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        common = sent.value
        for rows in batches:
            hashes = [shingle_hashes(ascii_lower(t), shingle_words) for t in texts(rows.column(2))]
            prints = np.array([fingerprint(h) for h in hashes], dtype=np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            rare = [common.rarest(x, len(x) - least_overlap(len(x), similarity) + 1).view(np.int64) for x in sets]
            first = [len(x) - least_overlap_with_larger(len(x), similarity) + 1 for x in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(nodes), pa.array([len(x) for x in sets], pa.int32()), pa.array(prints), pa.array(rare, pa.list_(pa.int64())), pa.array(first, pa.int32())], names=schema.names)

    return map_rows(docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).cast("string").alias("_text")), run, schema)


def ball_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes of one fingerprint, or of fingerprints that meet on a variant: at most two for each node ``a``."""
    prints = stored(nodes.groupBy("_fp").agg(F.min("_node").alias("_of")), "ball-prints")
    same = nodes.select("_node", "_fp").join(prints, "_fp").where("_node <> _of").select(F.col("_node").alias("a"), F.col("_of").alias("b"))
    nearest = ball_links(prints.select("_fp"), radius).groupBy("b").agg(F.min("a").alias("a"))
    met = nearest.join(prints.select(F.col("_fp").alias("a"), F.col("_of").alias("_a")), "a").join(prints.select(F.col("_fp").alias("b"), F.col("_of").alias("_b")), "b")
    return same.unionByName(met.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


class Side:
    """Shingle sets of one side of a cell as an inverted index, so that a set meets only those that it shares shingles with."""

    def __init__(self, nodes: list[int], roots: list[int], sets: list[np.ndarray]):
        self.nodes, self.roots = nodes, roots
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.shingles, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.shingles) + 1))

    def overlaps(self, x: np.ndarray) -> np.ndarray:
        """How many shingles each set of this side shares with ``x``."""
        if not len(x) or not len(self.shingles):
            return np.zeros(len(self.nodes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        hit = at[self.shingles[at] == x]
        first, sizes = self.starts[hit], self.starts[hit + 1] - self.starts[hit]
        ends = np.cumsum(sizes)
        places = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.owners[places], minlength=len(self.nodes))

    def similar(self, x: np.ndarray, similarity: float) -> list[int]:
        """Places of the sets that have at least the Jaccard similarity with ``x``."""
        both = self.overlaps(x)
        return np.flatnonzero(both >= similarity * (self.sizes + len(x) - both) - 1e-9).tolist()


def verified(members: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """Links (a, b) of nodes within a cell that have at least the Jaccard similarity, by their whole texts.

    ``members`` are ``_cell, _left, _node, _root``: the nodes on the left of a cell are compared with all of it that have
    another root.  The left of a cell is held as an index, the rest streams by; of links that connect what is connected
    already only the first is given, so a cell gives fewer links than it has nodes.
    """
    placed = members.join(nodes.select("_node", F.col("_one._id").alias("_id"), F.col("_one._key").alias("_key")), "_node")
    own = docs.select(F.col(id_col).alias("_own"), text_key(text_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    rows = own.join(placed, F.col("_own").eqNullSafe(F.col("_id")) & (own["_key"] == placed["_key"])).select("_cell", "_left", "_node", "_root", "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, side = None, None
        waiting: dict[int, tuple[int, np.ndarray]] = {}
        above: dict[int, int] = {}

        def top(root: int) -> int:
            while (up := above.get(root, root)) != root:
                above[root] = above.get(up, up)
                root = up
            return root

        def meet(node: int, root: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
            for k in side.similar(own, similarity):
                x, y = top(side.roots[k]), top(root)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    yield side.nodes[k], node

        def close_left() -> Iterator[tuple[int, int]]:
            """The left is complete: it is indexed, and its own nodes meet."""
            nonlocal side
            side = Side(list(waiting), [r for r, _ in waiting.values()], [x for _, x in waiting.values()])
            if len(waiting) > 1:
                for node, (root, own) in waiting.items():
                    yield from meet(node, root, own)
            waiting.clear()

        def batch_of(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            for cell, left, node, root, text in zip(*(batch.column(k).to_pylist() for k in range(4)), texts(batch.column(4)), strict=True):
                if cell != current:
                    if side is None and waiting:
                        found += close_left()
                    current, side = cell, None
                    above.clear()
                own = shingle_set(text, shingle_words)
                if left:
                    waiting[node] = root, own
                    continue
                if side is None:
                    found += close_left()
                found += meet(node, root, own)
            yield from batch_of(found)
        if side is None and waiting:
            yield from batch_of(list(close_left()))

    dealt = rows.repartition("_cell").sortWithinPartitions("_cell", F.desc("_left"))
    return stored(map_rows(dealt, compare, "a long, b long"), "similar-links")


def hub_members(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of cells for stored pairs (a, b) of which few have the same ``a``: those of one ``b`` are dealt into cells of about ``CELL_SHINGLES``."""
    sized = pairs.join(nodes.select(F.col("_node").alias("a"), "_size"), "a")
    cells = stored(sized.groupBy("b").agg(F.greatest(F.ceil(F.sum("_size") / CELL_SHINGLES), F.lit(1)).cast("long").alias("_cells")), "hub-cells")
    placed = pairs.join(cells, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), "_cells")).alias("_cell"))
    side = lambda left, node: placed.select("_cell", F.lit(left).alias("_left"), F.col(node).alias("_node"), F.col(node).alias("_root"))
    return side(True, "b").distinct().unionByName(side(False, "a"))


def bundle_members(rooted: DataFrame, apart: DataFrame) -> DataFrame:
    """Members of cells for the nodes of shingles (``apart``) that have several roots.

    Shingles with the same smallest node are one bundle, as those of a group of near copies are: its nodes are compared once.
    All that are not of the bundle's largest root stand on the left, against all of it; both sides are dealt into parts of
    about ``CELL_SHINGLES``, so that no cell grows with the bundle.  Where there is one cell alone, as in nearly all bundles,
    a text on the left goes there once for both sides.
    """
    bundles = stored(rooted.join(apart, "_shingle").select("_low", "_node", "_root", "_size").distinct(), "bundles")
    by_root = bundles.groupBy("_low", "_root").agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    parts = lambda total: F.greatest(F.ceil(total / CELL_SHINGLES), F.lit(1)).cast("long")
    totals = by_root.groupBy("_low").agg(F.max(F.struct("_n", "_root", "_sum")).alias("_main"), F.sum("_sum").alias("_all"))
    cells = stored(totals.select("_low", F.col("_main._root").alias("_main"), parts(F.col("_all") - F.col("_main._sum")).alias("_lefts"), parts(F.col("_all")).alias("_rights")), "bundle-cells")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("_node"), n)
    rows = bundles.join(cells, "_low")
    left = rows.where("_root <> _main").select("_low", "_node", "_root", own("_lefts").alias("_i"), every("_rights").alias("_j"), F.lit(True).alias("_left"))
    alone = (F.col("_lefts") == 1) & (F.col("_rights") == 1)
    right = rows.where(~alone | (F.col("_root") == F.col("_main"))).select("_low", "_node", "_root", every("_lefts").alias("_i"), own("_rights").alias("_j"), F.lit(False).alias("_left"))
    return left.unionByName(right).select(F.xxhash64("_low", "_i", "_j").alias("_cell"), "_left", "_node", "_root")


def similar_roots(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Stored (node, root) for every node with a link to another: nodes that are at least that similar have the same root.

    First the texts that meet in a ball, and every text with the pivot of its rare shingles, are compared, so that a large
    group of near copies becomes one component at a cost in proportion to its size.  Then all that share a rare shingle and
    are still in different components are compared, in cells: no pair is left out.
    """
    near = lambda x, y: F.least(x, y) >= F.greatest(x, y) * similarity - 1e-9
    named = (id_col, text_col, shingle_words, similarity)
    as_links = lambda found: found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    rows = nodes.select("_node", "_size", "_first", F.posexplode("_rare").alias("_at", "_shingle")).select("_node", "_size", (F.col("_at") < F.col("_first")).alias("_short"), "_shingle")
    # the one shingle that a pair is sure to share is among the first of the smaller set
    several = stored(rows.groupBy("_shingle").agg(F.min("_node").alias("_low"), F.max("_node").alias("_high"), F.max("_short").alias("_any")).where("_low < _high and _any").select("_shingle"), "several-shingles")
    shared = stored(rows.join(several, "_shingle"), "shared-shingles")
    drop_stored(several)
    roots = done = None
    for k in range(PIVOTS):
        rooted = shared.withColumn("_root", F.col("_node")) if roots is None else shared.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node")).drop("root")
        rooted = rooted if roots is None else stored(rooted, "rooted-shingles")
        # stored, so that adaptive execution can split a shingle with very many rows
        pivots = stored(rooted.groupBy("_shingle").agg(F.min(F.struct("_root", "_node", "_size")).alias("_low"), F.max("_root").alias("_high")).where("_low._root < _high").select("_shingle", "_low"), "pivots")
        met = rooted.join(pivots, "_shingle").where((F.col("_root") > F.col("_low._root")) & near(F.col("_size"), F.col("_low._size")))
        counted = met.groupBy(F.col("_node").alias("a"), F.col("_low._node").alias("b")).agg(F.count("*").alias("_n"))
        fresh = counted if done is None else counted.join(done, ["a", "b"], "left_anti")
        pairs = fresh.groupBy("a").agg(F.max(F.struct("_n", "b")).alias("_best")).select("a", "_best.b")
        pairs = stored(pairs.unionByName(ball_pairs(nodes, radius)).distinct() if k == 0 else pairs, "pivot-pairs")
        links = verified(hub_members(pairs, nodes), nodes, docs, *named)
        following = stored(components(links if roots is None else links.unionByName(as_links(roots))), "similar-roots")
        both = pairs if done is None else stored(done.unionByName(pairs), "compared-pairs")
        drop_stored(links, pivots, *([] if roots is None else [roots, done, pairs, rooted]))
        roots, done = following, both
    rooted = stored(shared.join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_root", F.coalesce("root", "_node")).drop("root"), "rooted-shingles")
    apart = stored(rooted.groupBy("_shingle").agg(F.min("_root").alias("_least"), F.max("_root").alias("_high"), F.min("_node").alias("_low"), F.max("_short").alias("_any")).where("_least < _high and _any").select("_shingle", "_low"), "apart-shingles")
    drop_stored(shared, done)
    if apart.isEmpty():
        return roots
    links = verified(bundle_members(rooted, apart), nodes, docs, *named)
    final = stored(components(links.unionByName(as_links(roots))), "similar-roots")
    drop_stored(rooted, apart, links, roots)
    return final


def similar_nodes(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``_id, _key, _node``), and stored nodes with their ``_root`` and the row ``_one`` of the smallest id (null ids last)."""
    prints = stored(shingled(docs, id_col, text_col, shingle_words, similarity), "shingled")
    # copies are one node: rows of a node are reduced in the tasks before they are shuffled
    one = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key")).alias("_one")
    nodes = stored(prints.groupBy("_node").agg(one, *[F.first(c).alias(c) for c in ("_size", "_fp", "_rare", "_first")]), "similar-nodes")
    rows = stored(prints.select("_id", "_key", "_node"), "similar-rows")
    drop_stored(prints)
    roots = similar_roots(nodes, docs, id_col, text_col, shingle_words, similarity).withColumnRenamed("node", "_node")
    rooted = stored(nodes.select("_node", "_one").join(roots, "_node", "left").select("_node", "_one", F.coalesce("root", "_node").alias("_root")), "rooted-nodes")
    drop_stored(nodes, roots)
    return rows, rooted


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, component_id (the smallest id reachable by links of at least that similarity).

    The similarity is the Jaccard similarity of the sets of shingles, and every pair that reaches it is linked, no other.
    Texts without words are copies of each other.  Nulls and repeated rows as in ``near_duplicates``.
    """
    rows, nodes = similar_nodes(docs, id_col, text_col, shingle_words, similarity)
    least = stored(nodes.groupBy("_root").agg(F.min("_one").alias("_least")), "similar-least")
    # both sides are read anew, so that adaptive execution can split a component or a text with very many rows
    classes = stored(nodes.select("_node", "_root").join(least, "_root").select("_node", F.col("_least._id").alias("component_id")), "similar-classes")
    return rows.join(classes, "_node").select(F.col("_id").alias(id_col), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = WIDE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of every component of ``similar_documents``, all columns unchanged: that of the smallest id.

    Where several rows carry that id, the one with the smallest hash of its text stays, and of rows that are equal in both
    the one with the smallest hash of its columns; a component of null ids only keeps one row in the same way.
    """
    rows, nodes = similar_nodes(docs, id_col, text_col, shingle_words, similarity)
    chosen = nodes.groupBy("_root").agg(F.min("_one").alias("_one")).select("_one._id", "_one._key")
    again = rows.groupBy("_id", "_key").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("_id").alias("_again"), F.col("_key").alias("_of"))
    marked = stored(chosen.join(again, F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_key") == F.col("_of")), "left").select("_id", "_key", F.col("_of").isNotNull().alias("_repeated")), "similar-chosen")
    drop_stored(rows, nodes)

    def of(which: Column) -> DataFrame:
        own = marked.where(which)
        return docs.join(own, docs[id_col].eqNullSafe(own["_id"]) & (F.xxhash64(docs[text_col].isNull(), docs[text_col].cast("string")) == own["_key"]), "left_semi")

    once = of(~F.col("_repeated"))
    if marked.where("_repeated").isEmpty():
        return once
    # a partial aggregate picks one, so an id with very many rows is no hot key
    picked = of(F.col("_repeated")).groupBy(id_col, text_key(text_col)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_one")).select("_one.*")
    return once.unionByName(picked)
