"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the documents into segments of a few megabytes, as they
come, and stores for each segment and term the sorted positions of the term
(gaps, packed), beside one row with the segment's documents.  Positions run
over all documents of a segment with a gap between two, so a phrase never
spans documents.  Only terms of the test set are indexed if their number is
below a bound; beyond, all terms are, with the same result.

``match`` finds the rarest term of each test window by its count over all
segments, joins windows to segments on that term alone, and intersects the
offset-adjusted lists of the other terms, rarest first, inside each segment.
With ``slop`` 0 that is the exact phrase; otherwise terms may be displaced by
up to ``slop`` words (proximity), which is reported apart.

Nulls: a null or empty text has no words; an item without words has no window.
Items that repeat a text are reported each.  An item shorter than a window is
one window.  Rows without an id are reported like others.  An empty table of
documents gives an empty result, an empty test set leaves all documents clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm._store import scratch, stored
from hopframe.llm._text import Tokens, lower_table, pack_sorted, plain_words, row_chunks, text_buffers, unpack_sorted

WINDOW = 10
TERM_BOUND = 1_000_000  # 8 MB of hashes
SEGMENT_BYTES = 1 << 22


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> Tokens:
    return Tokens(raw, offsets, plain_words(), lower_table())


def test_windows(items: DataFrame, key: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(window, terms, items): the distinct windows of all items, each with its term hashes and the ids it stands in."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            t = _tokens(raw, offsets)
            h = t.hashes().view(np.int64)
            for r in range(batch.num_rows):
                words = h[t.first[r] : t.first[r + 1]]
                if len(words):
                    n = max(1, len(words) - width + 1)
                    terms = [words[i : i + width] for i in range(n)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[r].as_py()] * n, pa.string()), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"]
                    )

    found = items.select(F.col(key).cast("string").alias("item"), text).mapInArrow(run, "item string, terms array<long>")
    return found.groupBy("terms").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items")).select(
        F.xxhash64("terms").alias("window"), "terms", "items"
    )


def build_index(docs: DataFrame, terms: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(segment, term, n, places): packed postings; the row of a segment with a null term holds its documents in ``doc_ids`` and ``places`` their first position."""
    id_type = docs.schema[key].dataType
    id_name = id_type.simpleString()
    wanted = None if terms is None else np.sort(terms)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["segment", "term", "n", "places", "doc_ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(to_arrow_type(id_type))]
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            raw_all, offsets_all = text_buffers(batch.column(1))
            for a, b in row_chunks(offsets_all, SEGMENT_BYTES):
                bounds = offsets_all[a : b + 1]
                t = _tokens(raw_all[bounds[0] : bounds[-1]], bounds - bounds[0])
                h = t.hashes()
                counts = np.diff(t.first)
                # one free position between documents
                place = np.arange(len(h)) + np.repeat(np.arange(b - a), counts)
                heads = t.first[:-1] + np.arange(b - a)
                if wanted is not None:
                    if len(wanted):
                        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        known = wanted[at] == h
                    else:
                        known = np.zeros(len(h), dtype=bool)
                    h, place = h[known], place[known]
                order = np.argsort(h, kind="stable")
                h, place = h[order], place[order]
                cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
                stops = np.append(cuts[1:], len(h)) if len(cuts) else cuts
                rows = [
                    [segment] * (len(cuts) + 1),
                    [None, *h[cuts].view(np.int64).tolist()],
                    [b - a, *(stops - cuts).tolist()],
                    [
                        pack_sorted(np.append(heads, len(counts) + int(counts.sum())).astype(np.uint64)),
                        *(pack_sorted(place[i:j].astype(np.uint64)) for i, j in zip(cuts, stops, strict=True)),
                    ],
                ]
                columns = [pa.array(x, k) for x, k in zip(rows, kinds, strict=False)]
                docs_of = pa.ListArray.from_arrays(
                    pa.array([0] + [b - a] * (len(cuts) + 1), pa.int32()), ids.slice(a, b - a).cast(to_arrow_type(id_type))
                )
                yield pa.RecordBatch.from_arrays([*columns, docs_of], names)
                segment += 1

    return docs.select(key, text).mapInArrow(run, f"segment long, term long, n long, places binary, doc_ids array<{id_name}>")


def _near(have: np.ndarray, starts: np.ndarray, slop: int) -> np.ndarray:
    """Which starts have a position within ``slop``."""
    if not len(have):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(have, starts - slop)
    return (at < len(have)) & (have[np.minimum(at, len(have) - 1)] <= starts + slop)


def match(index: DataFrame, windows: DataFrame, key: str = "doc_id", width: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: n_words, hit words of exact windows, the items of those, and items that only come near within ``slop``.

    ``index`` and ``windows`` are stored tables.
    """
    id_type = index.schema["doc_ids"].dataType.elementType
    freq = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    placed = windows.select("window", "terms", "items", F.posexplode("terms").alias("at", "term"))
    # A term that stands nowhere settles its window: an inner join leaves such windows with fewer terms than they have.
    ranked = placed.join(freq, "term").groupBy("window").agg(
        F.first("terms").alias("terms"), F.first("items").alias("items"), F.array_sort(F.collect_list(F.struct("df", "at", "term"))).alias("by")
    ).where(F.size("by") == F.size("terms"))
    anchors = ranked.select("terms", "items", F.col("by")[0]["term"].alias("term"), F.transform("by", lambda x: x["at"]).alias("order"))
    asked = index.where("term is not null").select(F.col("segment").alias("in_segment"), "term").join(anchors, "term").select("in_segment", "terms", "items", "order")

    def run(lists: pa.Table, probes: pa.Table) -> pa.Table:
        return _match_segment(lists, probes, slop, to_arrow(id_type))

    def to_arrow(kind):
        from pyspark.sql.pandas.types import to_arrow_type

        return to_arrow_type(kind)

    return (
        index.groupBy("segment").cogroup(asked.groupBy("in_segment"))
        .applyInArrow(run, f"id {id_type.simpleString()}, n_words long, n_hit long, items array<string>, near_items array<string>")
        .withColumnRenamed("id", key)
    )


def _match_segment(lists: pa.Table, probes: pa.Table, slop: int, id_kind: pa.DataType) -> pa.Table:
    packed = lists.column("places")
    names = lists.column("term").to_pylist()
    place_of = {t: i for i, t in enumerate(names) if t is not None}
    head = names.index(None)
    heads = unpack_sorted(packed[head].as_py()).astype(np.int64)
    ids = lists.column("doc_ids")[head].values.cast(id_kind)
    n_docs = len(heads) - 1
    cache: dict[int, np.ndarray] = {}

    def places(term: int) -> np.ndarray:
        if term not in cache:
            i = place_of.get(term)
            cache[term] = np.zeros(0, dtype=np.int64) if i is None else unpack_sorted(packed[i].as_py()).astype(np.int64)
        return cache[term]

    marks = np.zeros(int(heads[-1]) + 1, dtype=np.int64)
    exact: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    for window, order, items in zip(probes.column("terms").to_pylist(), probes.column("order").to_pylist(), probes.column("items").to_pylist(), strict=True):
        if any(t not in place_of for t in window):
            continue
        starts = places(window[order[0]]) - order[0]
        loose = starts
        for at in order[1:]:
            have = places(window[at])
            starts = starts[_near(have, starts + at, 0)]
            if slop:
                loose = loose[_near(have, loose + at, slop)]
            elif not len(starts):
                break
        starts = starts[(starts >= 0)]
        if len(starts):
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + len(window), -1)
            for d in np.unique(np.searchsorted(heads, starts, side="right") - 1).tolist():
                exact.setdefault(d, set()).update(items)
        if slop:
            # the rarest term's document holds the match; the others must not reach into a neighbour
            of = np.searchsorted(heads, loose + order[0], side="right") - 1
            whole = (loose - slop >= heads[of] - slop) & (loose + len(window) - 1 - slop <= heads[of + 1] - 2)
            for d in np.unique(of[whole]).tolist():
                near.setdefault(d, set()).update(items)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(marks)[:-1] > 0)])
    hits = covered[heads[1:]] - covered[heads[:-1]]
    return pa.table({
        "id": ids,
        "n_words": pa.array(np.diff(heads) - 1, pa.int64()),
        "n_hit": pa.array(hits, pa.int64()),
        "items": pa.array([sorted(exact.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
        "near_items": pa.array([sorted(near.get(d, set()) - exact.get(d, set())) for d in range(n_docs)], pa.list_(pa.string())),
    })


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", width: int = WINDOW, slop: int = 0, bound: int = TERM_BOUND) -> DataFrame:
    """Build the index for a test set and match it: one row per document."""
    windows = stored(test_windows(items, width=width), "test-windows")
    vocabulary = windows.select(F.explode("terms").alias("term")).distinct()
    known = vocabulary.limit(bound + 1).toArrow().column("term").to_numpy().view(np.uint64)
    index = stored(build_index(docs, known if len(known) <= bound else None, key), "positional-index")
    return match(index, windows, key, width, slop)


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents without an exact window of any item; each row is judged by its own text, whatever rows share its id."""
    marked = docs.withColumn("__key", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    with scratch(docs.sparkSession) as keep:
        judged = contamination(marked.select("__key", F.col(text).alias("text")), items, "__key")
        bad = keep(judged.where("n_hit > 0").select("__key").distinct(), "contaminated")
    small = bad.limit(1_000_001).count() <= 1_000_000
    return marked.join(F.broadcast(bad) if small else bad, "__key", "left_anti").select(*docs.columns)
