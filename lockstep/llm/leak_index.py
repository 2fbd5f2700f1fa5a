"""Evaluation passages inside a training corpus, by a distributed positional inverted index.

:func:`build_index` tokenises the corpus once and stores its postings.  The index is
partitioned by document, as in distributed retrieval engines: a row holds a block of
documents, its terms, and for each term the places where it stands, in order, each
as its distance from the one before.  A document never runs over blocks.

:func:`phrase_matches` and :func:`leaks` answer test items from the stored index, each
block by itself, so nothing but results is shuffled.  For every run of ``min_words``
item words the rarest term of the block is the anchor; a run with a term that the
block lacks ends there.  The places of the anchors, shifted by their offset in the
item, are the candidate alignments; they are intersected with the lists of the
neighbouring terms, shifted alike, for all items at once, until the exact length of
the common phrase is known.

Test items go out in blocks of at most ``block_words`` words, one after the other
inside each task, so what is held at once is bounded, and the index is read once,
however many blocks of items there are.

Defined results: words are maximal runs of letters and digits in lower case, all
else separates; null and empty texts hold no words; items shorter than
``min_words`` have no match; repeated documents and items each count; ties in
rarity go to the earlier word; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.session import cut

_INDEX = "doc_ids array<bigint>, starts array<bigint>, terms array<string>, bounds array<bigint>, steps array<int>"
_HITS = "doc_id bigint, item_id bigint, doc_pos bigint, item_pos bigint, n_words bigint"
_LEAKS = "doc_id bigint, item_id bigint, longest bigint, covered bigint"

#: Words of documents in a block of the index.
BLOCK_TOKENS = 1 << 19


def tokenise(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, and the number of words of each."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+")
    offsets = parts.offsets.to_numpy()
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(filled)])
    return flat.filter(pa.array(filled)), np.diff(upto[offsets - offsets[0]])


def words(text: str | None) -> list[str]:
    return tokenise(pa.array([text], pa.string()))[0].to_pylist()


def _block(ids: list, tokens: list[pa.Array], sizes: list[np.ndarray]) -> tuple:
    """A row of the index.  A free place follows each document, so no phrase runs across."""
    lengths = np.concatenate(sizes).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    coded = pa.chunked_array(tokens, pa.large_string()).combine_chunks().dictionary_encode()
    coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    places = np.arange(len(codes), dtype=np.int64) + np.repeat(np.arange(len(lengths)), lengths)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
    places = places[order]
    steps = np.diff(places, prepend=0)
    steps[bounds[:-1]] = places[bounds[:-1]]
    return ids, starts, coded.dictionary, bounds, steps.astype(np.int32)


def build_index(documents: DataFrame) -> DataFrame:
    """Postings of all words of ``documents(doc_id, text)``, not yet written; see the module for the form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tokens, sizes, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            columns = _block(ids, tokens, sizes)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, k) if not isinstance(c, pa.Array) else c.cast(k)) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_ids", "starts", "terms", "bounds", "steps"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # as many texts as about fill the block; words have six characters or so, and at least one text is taken
                lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
                upto = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), 6 * (BLOCK_TOKENS - held))))
                found, counts = tokenise(batch.column(1).slice(at, upto - at))
                ids += batch.column(0).slice(at, upto - at).to_pylist()
                tokens.append(found)
                sizes.append(counts)
                held += len(found)
                at = upto
                if held >= BLOCK_TOKENS:
                    yield row()
                    ids, tokens, sizes, held = [], [], [], 0
        if ids:
            yield row()

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _INDEX)


class TestItems:
    """Words of a block of items as numbers, all in one array with a gap after each item."""

    __test__ = False

    def __init__(self, rows: list[tuple[int, str | None]]):
        tokens, sizes = tokenise(pa.array([t for _, t in rows], pa.string()))
        coded = tokens.dictionary_encode()
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.vocabulary = coded.dictionary
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.words = np.full(int((sizes + 1).sum()), len(self.vocabulary), np.int64)  # the gap is a term that no block has
        self.words[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy()


class PositionalIndex:
    """Postings of the item vocabulary in one block."""

    def __init__(self, terms: pa.Array, bounds: np.ndarray, steps: np.ndarray, items: TestItems):
        there = pc.index_in(items.vocabulary, value_set=terms.cast(pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = there >= 0
        counts = np.where(known, bounds[there + 1] - bounds[there], 0)
        self.frequency = np.append(counts, 0)
        self.bounds = np.concatenate([[0], np.cumsum(self.frequency)])
        first = np.where(known, bounds[there], 0)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        own = steps[np.repeat(first, counts) + inner].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(own)])
        self.places = upto[1:] - np.repeat(upto[self.bounds[:-2]], counts)
        # (term, place) as one number, in order, which makes all lists one
        self.keys = (np.repeat(np.arange(len(counts)), counts) << 32) + self.places

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each term stands at each place."""
        if not len(self.keys):
            return np.zeros(len(terms), bool)
        wanted = (terms << 32) + places
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (places >= 0)

    def reach(self, items: TestItems, offsets: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """How far the words after (or before) each alignment agree."""
        far = np.zeros(len(offsets), np.int64)
        alive, k = np.arange(len(offsets)), 0
        while len(alive):
            k += step
            at = offsets[alive] + k
            alive = alive[(at >= 0) & (at < len(items.words))]
            at = offsets[alive] + k
            alive = alive[self.has(items.words[at], places[alive] + k)]
            far[alive] = abs(k)
        return far

    def phrases(self, items: TestItems, least: int) -> np.ndarray:
        """Maximal common phrases of at least ``least`` words: rows of place, offset among the item words, length."""
        none = np.empty((0, 3), np.int64)
        if len(items.words) < least:
            return none
        rarity = self.frequency[items.words]
        windows = np.lib.stride_tricks.sliding_window_view(rarity, least)
        lowest = windows.argmin(axis=1)
        runs = np.flatnonzero(windows[np.arange(len(lowest)), lowest] > 0)
        anchors = np.unique(runs + lowest[runs])
        counts = rarity[anchors]
        offsets = np.repeat(anchors, counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        places = self.places[self.bounds[items.words[offsets]] + inner]
        behind = self.reach(items, offsets, places, -1)
        length = behind + 1 + self.reach(items, offsets, places, 1)
        long = length >= least
        found = np.stack([(places - behind)[long], (offsets - behind)[long], length[long]], axis=1)
        return np.unique(found, axis=0) if len(found) else none


def covered_words(parts: list[tuple[int, int, int]], slack: int) -> int:
    """The most item words in a chain of parts ``(doc_pos, item_pos, n_words)``.

    Parts of a chain lie in the order of the item, with at most ``slack`` other words
    between neighbours, in the document as in the item; where they overlap, words
    count once.
    """
    parts = sorted(parts)
    best: list[int] = []
    reach = longest = 0
    for j, (doc, item, n) in enumerate(parts):
        best.append(n)
        while reach < j and parts[reach][0] + longest + slack < doc:
            reach += 1
        for i in range(reach, j):
            d, k, m = parts[i]
            over = max(0, d + m - doc, k + m - item)
            if d < doc and k < item and over < n and doc - d - m <= slack and item - k - m <= slack:
                best[j] = max(best[j], best[i] + n - over)
        longest = max(longest, n)
    return max(best, default=0)


def _batches(items: DataFrame, block_words: int) -> Iterator[TestItems]:
    """Items come to the driver and go to the executors a block at a time; the block is the bound."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") // 6
        if size >= block_words:
            yield TestItems(block)
            block, size = [], 0
    if block:
        yield TestItems(block)


def _search(index: DataFrame, items: DataFrame, least: int, block_words: int, schema: str, report: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    """``report`` on the hits of each block of the index and of items: rows of doc_id, item_id, doc_pos, item_pos, n_words."""
    if least < 1:
        raise ValueError("min_words must be 1 or more")
    spark = index.sparkSession
    sent = [spark.sparkContext.broadcast(block) for block in _batches(items, block_words)]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = []
            for i in range(batch.num_rows):
                ids, starts, terms, bounds, steps = (c.slice(i, 1).flatten() for c in batch.columns)
                blocks.append((ids.to_numpy(zero_copy_only=False), starts.to_numpy(), terms, bounds.to_numpy(), steps.to_numpy()))
            for one in sent:
                block = one.load_from_path(one._path) if one._path else one.value  # not kept once it is done
                for ids, starts, terms, bounds, steps in blocks:
                    hits = PositionalIndex(terms, bounds, steps, block).phrases(block, least)
                    if len(hits):
                        doc = np.searchsorted(starts, hits[:, 0], side="right") - 1
                        item = np.searchsorted(block.starts, hits[:, 1], side="right") - 1
                        rows = np.column_stack([ids[doc], block.ids[item], hits[:, 0] - starts[doc], hits[:, 1] - block.starts[item], hits[:, 2], doc])
                        columns = report(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return index.mapInArrow(run, schema)


def phrase_matches(documents: DataFrame, items: DataFrame, min_words: int = 12, block_words: int = 1_000_000) -> DataFrame:
    """Maximal phrases of at least ``min_words`` common words: ``(doc_id, item_id, doc_pos, item_pos, n_words)``.

    ``documents(doc_id, text)`` and ``items(item_id, text)``; positions count words from 0.
    """
    return _search(cut(build_index(documents), "postings", "zstd"), items, min_words, block_words, _HITS, lambda rows: list(rows.T[:5]))


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, part_words: int | None = None, slack: int = 8, block_words: int = 1_000_000) -> DataFrame:
    """Documents and the items they hold: ``(doc_id, item_id, longest, covered, kind)``.

    ``longest`` counts the words of the longest common phrase, ``covered`` those of the
    best chain of phrases of ``part_words`` and more (see :func:`covered_words`).
    ``kind`` is ``phrase`` if ``longest`` reaches ``min_words``, else ``proximity`` if
    ``covered`` does.  Without ``part_words`` only phrases are found.
    """

    def report(rows: np.ndarray) -> list[np.ndarray]:
        pairs: dict[tuple, list] = defaultdict(list)
        for doc_id, item_id, doc_pos, item_pos, n, doc in rows.tolist():
            pairs[doc_id, item_id, doc].append((doc_pos, item_pos, n))
        out = [(d, i, max(n for *_, n in parts), covered_words(parts, slack)) for (d, i, _), parts in pairs.items()]
        return list(np.array(out, np.int64).T)

    found = _search(cut(build_index(documents), "postings", "zstd"), items, part_words or min_words, block_words, _LEAKS, report)
    per_pair = found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))
    kind = F.when(F.col("longest") >= min_words, "phrase").when(F.col("covered") >= min_words, "proximity")
    return per_pair.withColumn("kind", kind).filter("kind is not null")
