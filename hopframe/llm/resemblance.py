"""Texts that share most of their word shingles.

A text is the set of its shingles of five words (of all its words if it has
fewer).  ``BANDS`` of ``ROWS`` minima put a text into buckets; a pair of
Jaccard similarity s meets in one with probability 1 - (1 - s**ROWS)**BANDS,
which leaves out about one pair in eight million at 0.8 and fewer above.

Pairs are never written.  Inside a bucket, signatures of ``SIGNATURE`` minima
tell which texts may be alike, and a walk over them leaves at most one edge per
text.  The components of these edges are clusters: a text is in one, and no
pair that meets in a bucket and may be alike lies across two.  The sets of a
cluster's texts are sent once, compared exactly all with all by products of
their incidence, and a walk over the pairs that are alike again leaves at most
one link per text.  Groups beyond ``BLOCK`` texts are cut into blocks and every
two blocks meet in a task of their own, so no group has to fit one task.  Links
join exactly the components that all alike pairs would.

A signature calls a pair at the threshold unlike with probability below one in
a million, and then only matters if no other text leads around it.

Nulls: texts without words have the empty set and are alike.  Rows of one key
hold one text and count once.  Very long texts are hashed in blocks; their sets
are held one at a time, and with their cluster's.  An empty table gives an
empty result.  Other columns do not matter.  Shingles are compared by 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import join_small, scratch, stored, way
from hopframe.llm._text import Tokens, chain, lower_table, pack, row_chunks, space_words, text_buffers, unpack
from hopframe.llm.simhash import components

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 40, 5
SIGNATURE = 128
BLOCK, SET_BLOCK = 20_000, 1000  # texts of a group that one task compares
SEEN = 100_000


def shingle_sets(column: pa.Array, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = text_buffers(column)
    for a, b in row_chunks(offsets, 1 << 20):
        bounds = offsets[a : b + 1]
        t = Tokens(raw[bounds[0] : bounds[-1]], bounds - bounds[0], space_words(), lower_table())
        words = t.hashes()
        runs = words[: max(0, len(words) - shingle + 1)]
        for k in range(1, shingle):
            runs = chain(runs, words[k : k + len(runs)])
        for first, last in zip(t.first[:-1], t.first[1:], strict=True):
            if last - first >= shingle:
                yield np.unique(runs[first : last - shingle + 1])
            else:
                short = words[first : min(first + 1, last)]
                for k in range(first + 1, last):
                    short = chain(short, words[k : k + 1])
                yield short


def minima(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least value of a shingle set under each hash."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), 2000):
        least = np.minimum(least, (values[at : at + 2000] * factors[:, None] + shifts[:, None]).min(axis=1))
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """The bucket of each band of minima."""
    rows = least.reshape(BANDS, ROWS)
    found = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        found = chain(found, rows[:, k])
    return found


def signature(least: np.ndarray) -> bytes:
    """One byte of each of the first minima."""
    return least[:SIGNATURE].astype(np.uint8).tobytes()


def _marked(rows: DataFrame) -> DataFrame:
    """(node, size, buckets, signature) of (node, text); a task marks a text it has just seen once only."""
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches):
        rng = np.random.default_rng(11)
        factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shifts = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        seen = set()
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            new = [i for i, node in enumerate(nodes) if node not in seen and not seen.add(node)]
            if len(seen) > SEEN:
                seen.clear()
            batch = batch.take(pa.array(new, pa.int64()))
            size, found, marks = [], [], []
            for values in shingle_sets(batch.column(1)):
                least = minima(values, factors, shifts)
                size.append(len(values))
                found.append(buckets(least).view(np.int64))
                marks.append(signature(least))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["node", "size", "buckets", "signature"],
            )

    found = rows.mapInArrow(run, f"node {kind}, size long, buckets array<long>, signature binary")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "buckets", "signature")])


def in_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """Deal (group, n, node, ...) so that any two rows of a group are together somewhere, at most about two blocks at a time."""
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = rows.withColumn("__own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"__i": F.least("__own", "__other"), "__j": F.greatest("__own", "__other")}).drop("__own", "__other", "n")
    return dealt.repartition(group, "__i", "__j").sortWithinPartitions(group, "__i", "__j", "node")


def walk(n: int, alike) -> list[tuple[int, int]]:
    """A spanning forest: ``alike(i, rest)`` says which of the places ``rest`` are alike with ``i``."""
    edges, rest = [], np.arange(n)
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            good = alike(i, rest)
            hits = rest[good].tolist()
            edges += [(i, j) for j in hits]
            queue += hits
            rest = rest[~good]
    return edges


def _edges(dealt: DataFrame, group: str, value: str, forest) -> DataFrame:
    """(a, b) from ``forest(values)`` of each dealt group, read in order."""
    kind = dealt.schema["node"].dataType.simpleString()

    def run(batches):
        last, nodes, values = None, [], []

        def done():
            pairs = forest(values) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], node_kind) for k in (0, 1)], ["a", "b"])

        node_kind = None
        for batch in batches:
            node_kind = batch.schema.field("node").type
            keys = zip(batch.column(group).to_pylist(), batch.column("__i").to_pylist(), batch.column("__j").to_pylist(), strict=True)
            for key, node, item in zip(keys, batch.column("node").to_pylist(), batch.column(value).to_pylist(), strict=True):
                if key != last:
                    if len(nodes) > 1:
                        yield done()
                    last, nodes, values = key, [], []
                nodes.append(node)
                values.append(item)
        if len(nodes) > 1:
            yield done()

    return dealt.select(group, "__i", "__j", "node", value).mapInArrow(run, f"a {kind}, b {kind}")


def may_be_alike(least: float):
    """A forest of the pairs whose signatures agree as far as texts at the threshold do, less five deviations."""
    enough = int(SIGNATURE * (least - 5 * (least * (1 - least) / SIGNATURE) ** 0.5))

    def forest(values):
        table = np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), SIGNATURE)
        return walk(len(values), lambda i, rest: np.count_nonzero(table[rest] == table[i], axis=1) >= enough)

    return forest


def overlaps(sets: list[np.ndarray], cells: int = 1 << 24) -> np.ndarray:
    """Sizes of all intersections, from products of incidence matrices over the shingles that stand in two sets at least."""
    n = len(sets)
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = np.bincount(place, minlength=len(names)) > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, column = owner[use], column[place[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((n, n), dtype=np.float32), max(1, cells // n)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, int(column[b - 1]) + 1 - at), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total


def are_alike(least: float):
    """A forest of the pairs whose whole sets have at least that similarity."""

    def forest(values):
        sets = [unpack(v) for v in values]
        sizes, both = np.array([len(s) for s in sets], dtype=np.float64), overlaps(sets)
        return walk(len(sets), lambda i, rest: both[i, rest] >= least * (sizes[i] + sizes[rest] - both[i, rest]))

    return forest


def _both_ways(links: DataFrame, purpose: str) -> DataFrame:
    one_way = links.distinct()
    return stored(one_way.union(one_way.select("b", "a")), purpose)


def _sets(rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """(component, n, node, shingles) of the texts in clusters."""
    kind = rows.schema["node"].dataType.simpleString()

    def gather(batches):
        for batch in batches:
            packed = pa.array([pack(v) for v in shingle_sets(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], ["node", "shingles"])

    found = join_small(rows, clusters.select("node"), ["node"], "left_semi").select("node", "text").mapInArrow(gather, f"node {kind}, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles")).join(clusters.hint(way(clusters)), "node")


def similar_texts(docs: DataFrame, key: str, text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(key, component_id: the least key reachable over pairs of similarity ``least`` and more); rows of one key hold one text."""
    rows = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        marked = stored(_marked(rows), "resemblance-marks")
        spread = marked.select(F.explode("buckets").alias("bucket"), "node")
        met = stored(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "resemblance-buckets")
        # forty rows a text, which Spark takes for one
        shared = spread.join(met.hint(way(met)), "bucket").join(marked.select("node", "signature").hint("merge"), "node")
        weak = _both_ways(_edges(in_blocks(shared, "bucket", BLOCK), "bucket", "signature", may_be_alike(least)), "resemblance-weak")
        named = stored(components(weak), "resemblance-clusters")
        sizes = named.groupBy("component").agg(F.count("*").alias("n"))
        clusters = stored(named.join(sizes.hint(way(named)), "component"), "resemblance-clusters")
        links = _both_ways(_edges(in_blocks(_sets(rows, clusters), "component", SET_BLOCK), "component", "shingles", are_alike(least)), "resemblance-links")
        groups = components(links)
        return keep(
            marked.select("node").join(groups.hint(way(groups)), "node", "left").select(F.col("node").alias(key), F.coalesce("component", "node").alias("component_id")),
            "resemblance",
        )
