"""Mixing sources to target weights by hierarchical budgeting.

Weights run down a tree (domain, language, source or any other levels).  A node
cannot take more than its leaves hold times their allowed repeats; what it cannot
take goes to its siblings in proportion to their weights, and only if they are
full too does the parent's share shrink and pass to the parent's siblings.  Each
leaf then uses its documents in seeded epochs: whole epochs as often as its budget
holds them, and of the next one the prefix that still fits, counted in tokens.

The prefix of a leaf is found without sorting the leaf: sums per bucket of the
shuffling hash give the bucket where the budget ends, and only that bucket is
ordered.

Defined results: null and empty texts have no tokens and are never selected;
leaves of sources without a target get nothing but count in the total; targets
without documents have size 0 and are short; an empty table gives budgets of 0;
documents with equal ids are ordered alike and stay together.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranks of a byte-level tokenizer with 50,256 entries; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of those ranks.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leaves are combinations of a few categories; the budget is made on the driver.
MAX_LEAVES = 200_000
BUCKETS = 1 << 16
_LOADED: dict[str, object] = {}
_SENT: set[tuple[str, str]] = set()


def _tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker; its kind is told by the suffix."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encoding = tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = lambda text: len(encoding.encode_to_numpy(text, disallowed_special=()))
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _LOADED[path] = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda text: len(pieces.encode(text))
    return _LOADED[path]


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of a text, which is encoded as one, whatever its length."""
    return _tokenizer(path)(text) if text else 0


def _send(spark: SparkSession, path: str) -> str:
    """Send the file of a tokenizer to the executors once; its name there."""
    app = spark.sparkContext.applicationId
    if (app, path) not in _SENT:
        spark.sparkContext.addFile(path)
        _SENT.add((app, path))
    return path.rsplit("/", 1)[-1]


def token_sizes(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` of ``documents``, and ``n_tokens`` of ``text``."""
    schema = T.StructType([*[documents.schema[c] for c in keep], T.StructField("n_tokens", T.LongType())])
    name = _send(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = SparkFiles.get(name)
        for batch in batches:
            sizes = pa.array([count_tokens(t, there) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=schema.names)

    return documents.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


@dataclass(eq=False)
class Node:
    """A node of the budget tree."""

    weight: float = 0.0
    size: int = 0
    capacity: float = 0.0
    wanted: float = 0.0
    budget: float = 0.0
    children: dict[str | None, Node] = field(default_factory=dict)

    @property
    def short(self) -> bool:
        """Whether its own share of the mixture exceeds what it may contribute."""
        return self.wanted > self.capacity


def _share(node: Node) -> None:
    """What each child would contribute if none were short."""
    whole = sum(c.weight for c in node.children.values())
    for c in node.children.values():
        c.wanted = node.wanted * c.weight / whole if whole else 0.0
        _share(c)


def _fill(node: Node) -> None:
    """Divide the node's budget among its children by weight, none above its capacity."""
    left, open_ = node.budget, [c for c in node.children.values() if c.weight > 0]
    while open_:
        weight = sum(c.weight for c in open_)
        full = {c for c in open_ if left * c.weight / weight >= c.capacity}
        if not full:
            for c in open_:
                c.budget = left * c.weight / weight
            break
        for c in full:
            c.budget = c.capacity
        left -= sum(c.capacity for c in full)
        open_ = [c for c in open_ if c not in full]
    for c in node.children.values():
        _fill(c)


def budget_tree(leaves: list[tuple], weights: dict[tuple, float], repeats: dict[tuple, int], total: float | None = None) -> Node:
    """The filled tree of leaves ``(level_1, ..., level_n, size)``.

    ``weights`` and ``repeats`` are given for paths of any length; a node's
    repeats hold for all below it.  Among siblings without a given weight the
    size is the weight; siblings of weighted nodes without one get nothing.  A node
    cannot take what its children without weight hold.
    """
    root = Node()
    for path in [*weights, *[leaf[:-1] for leaf in leaves]]:
        at = root
        for step in path:
            at = at.children.setdefault(step, Node())
    for *path, size in leaves:
        at, cap = root, 0
        root.size += size
        for i, step in enumerate(path):
            at = at.children[step]
            at.size += size
            cap = repeats.get(tuple(path[: i + 1]), cap)
        at.capacity = float(size * cap)

    def settle(node: Node, path: tuple) -> None:
        given = any((*path, step) in weights for step in node.children)
        for step, child in node.children.items():
            child.weight = weights.get((*path, step), 0.0 if given else float(child.size))
            settle(child, (*path, step))
        if node.children:
            node.capacity = sum(c.capacity for c in node.children.values() if c.weight > 0)

    settle(root, ())
    root.wanted = float(root.size if total is None else total)
    root.budget = min(root.wanted, root.capacity)
    _share(root)
    _fill(root)
    return root


def leaf_sizes(sized: DataFrame, levels: list[str]) -> list[tuple]:
    """Tokens per leaf, on the driver; their number is checked."""
    rows = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()  # a check, not a cut
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves; use coarser levels")
    return [(*r[:-1], r[-1] or 0) for r in rows]


def leaves_of(root: Node, depth: int) -> list[tuple]:
    """``(path..., node)`` of the leaves."""
    found = []
    stack: list[tuple[tuple, Node]] = [((), root)]
    while stack:
        path, node = stack.pop()
        if len(path) == depth:
            found.append((*path, node))
        stack += [((*path, step), child) for step, child in node.children.items()]
    return found


def select_mixture(sized: DataFrame, doc_id: str, levels: list[str], root: Node, seed: int = 0) -> DataFrame:
    """``(doc_id, levels..., n_tokens, copies)`` of the mixture: how often each document is used."""
    spark = sized.sparkSession
    rows = []
    for *path, node in leaves_of(root, len(levels)):
        if node.size and node.budget > 0:
            whole = int(node.budget // node.size)
            rows.append((*path, whole, int(node.budget - whole * node.size)))
    kinds = [T.StructField(c, sized.schema[c].dataType) for c in levels]
    plan = spark.createDataFrame(rows, T.StructType([*kinds, T.StructField("whole", T.LongType()), T.StructField("rest", T.LongType())]))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in levels]
    docs = sized.filter("n_tokens > 0").alias("d").join(F.broadcast(plan.alias("p")), same).select("d.*", "p.whole", "p.rest")
    # the place in the leaf's next epoch
    place: Column = F.xxhash64(F.lit(seed), F.col("whole"), F.col(doc_id))
    docs = docs.withColumn("_place", place).withColumn("_bucket", F.pmod(F.col("_place"), F.lit(BUCKETS)))
    sums = docs.filter("rest > 0").groupBy(*levels, "rest", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    running = Window.partitionBy(*levels).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_n").over(running))
    # the first bucket that does not fit as a whole
    cuts = sums.filter(F.col("_upto") > F.col("rest")).groupBy(*levels).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_n")).alias("before"))).alias("cut"))
    cuts = F.broadcast(cuts.alias("c"))  # one row per leaf
    match = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in levels]
    docs = docs.alias("e").join(cuts, match, "left").select("e.*", "c.cut")
    inside = (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("_bucket") < F.col("cut._bucket")))
    at_cut = docs.filter((F.col("rest") > 0) & (F.col("_bucket") == F.col("cut._bucket")))
    order = Window.partitionBy(*levels).orderBy("_place", doc_id)
    at_cut = at_cut.withColumn("_sum", F.sum("n_tokens").over(order) + F.col("cut.before"))
    fits = at_cut.withColumn("extra", (F.col("_sum") <= F.col("rest")).cast("long"))
    others = docs.filter(~((F.col("rest") > 0) & F.coalesce(F.col("_bucket") == F.col("cut._bucket"), F.lit(False)))).withColumn("extra", F.coalesce(inside, F.lit(False)).cast("long"))
    picked = others.select(doc_id, *levels, "n_tokens", "whole", "extra").unionByName(fits.select(doc_id, *levels, "n_tokens", "whole", "extra"))
    picked = picked.withColumn("copies", F.col("whole") + F.col("extra"))
    return picked.filter("copies > 0").select(doc_id, *levels, "n_tokens", "copies")


def totals(mixture: DataFrame, level: str) -> dict[str | None, int]:
    """Tokens of a mixture per name of a level."""
    found: dict[str | None, int] = defaultdict(int)
    for row in mixture.groupBy(level).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect():
        found[row[0]] += row[1]
    return found
