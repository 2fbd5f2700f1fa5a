"""All pairs of sets with Jaccard similarity at or above a threshold, by pigeonhole partitioning.

Sets are rows ``(field, owner, value)``.  Values that only one set has cannot be
shared, and a set with too few shared values for any partner is dropped; so is a
set without another of like size, before anything is collected.  Sets with the
same values become one class.

The universe of values is split into segments, their number depending on the length
class (a power of two) of the larger set: rare values by hash, and apart from them
the common ones.  Two sets that are similar enough differ in at most ``H`` of the
values left.  The larger set picks allowances for its segments, 0 (equal), 1 (equal
but for one value) or none, so that their sum plus their number exceeds ``H``: by
the pigeonhole principle one picked segment then differs no more than allowed.
Picks go to the segments that the fewest sets are expected to share.  Common values
are split into the least number of segments that carries the allowances still
needed, so that such a segment holds several of them and few sets share all.  Equal
segments join on the hash of the segment, others on the hash with one value deleted
from either side.  Sets whose segments cannot carry enough allowances (values piled
into few segments) are joined by their rarest values instead, which is exact too.

Candidates carry 64 parity bits of their values; as many bits as differ, so many
values differ at least, which drops nearly all false candidates in the join.  What
is left is verified on 64-bit hashes of all values, and what passes on the values
themselves.

Nothing that grows with the data is held as one: a signature or value that very many
sets have is split by hash of the set, and sets of more than ``largest`` values, of
which there are few, are not collected but joined value by value and counted.

Defined results: rows with null field, owner or value are ignored; repeated rows
count once; sets below ``min_size`` are ignored; extra columns are ignored; an
empty table gives no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.session import cut

#: Sets of more values are compared by joining rows.
LARGEST = 1 << 17
#: Sets under one signature or value in one task; many more are split into parts of this size.
GROUP = 10_000
#: Signatures that are split, at most; with more sets the parts grow.
HOT = 100_000

_MASK = (1 << 64) - 1
_SPREAD = 0x9E3779B97F4A7C15


def least_overlap(a: int, b: int, t: float) -> int:
    """The least number of common values of similar sets of these sizes."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with 64-bit ids of set and value; ids of different fields differ."""
    rows = rows.select(*[F.col(c).cast("string").alias(c) for c in ("field", "owner", "value")])
    rows = rows.filter("field is not null and owner is not null and value is not null")
    return rows.withColumns({"oid": F.xxhash64("field", "owner"), "vid": F.xxhash64("value", "field")})


def set_classes(rows: DataFrame, threshold: float, min_size: int = 1, largest: int = LARGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sets that can have a partner, as classes of equal sets, in terms of ids.

    Returns ``classes(sid, size, values, bits)`` with the values that other sets share,
    rarest first, as structs ``(df, vid)``, ``members(oid, sid)`` of classes
    with two members or more, and ``large(oid, size)``, the sets that are similar to
    sets above ``largest``, if to any; those above it are in no class.
    """
    tokens = cut(_keyed(rows).select("oid", "vid").distinct(), "tokens")
    sizes = cut(tokens.groupBy("oid").agg(F.count("*").cast("int").alias("size")).filter(F.col("size") >= min_size), "sizes")
    large = sizes.filter(F.col("size") + 1e-9 >= largest * threshold)
    sizes = sizes.filter(F.col("size") <= largest)
    # sizes that some other set is near enough to; there are at most as many as the root of twice the rows
    kinds = sizes.groupBy("size").agg(F.count("*").alias("k"))
    by_size = Window.orderBy("size")
    before, after = F.lag("size").over(by_size), F.lead("size").over(by_size)
    near = (F.col("k") > 1) | (before + 1e-9 >= F.col("size") * threshold) | (after * threshold <= F.col("size") + 1e-9)
    kinds = kinds.withColumn("near", near).filter("near").select("size")
    left = tokens.join(sizes.join(kinds, "size", "left_semi"), "oid")
    common = left.groupBy("vid").agg(F.count("*").cast("int").alias("df")).filter("df > 1")
    shared = left.join(common, "vid")
    arrays = shared.groupBy("oid", "size").agg(F.array_sort(F.collect_list(F.struct("df", "vid"))).alias("values"))
    smallest = F.greatest(F.lit(min_size), F.ceil(F.col("size") * threshold - 1e-9))
    needed = F.ceil((F.col("size") + smallest) * (threshold / (1 + threshold)) - 1e-9)
    # parity of how many values have each of 64 hash places
    bit = lambda v: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(v["vid"], F.lit(64)).cast("int"))
    parity = F.aggregate("values", F.lit(0).cast("long"), lambda b, v: b.bitwiseXOR(bit(v)))
    arrays = cut(arrays.filter(F.size("values") >= needed).withColumn("bits", parity), "arrays")
    # a set with a value of its own equals no other
    whole = arrays.filter(F.size("values") == F.col("size")).select("oid", F.struct(F.xxhash64("values"), F.hash("values"), F.col("size")).alias("key"))
    several = whole.groupBy("key").agg(F.min("oid").alias("sid"), F.count("*").alias("k")).filter("k > 1").select("key", "sid")
    members = cut(whole.join(several, "key").select("oid", "sid"), "members")
    classes = arrays.join(members.filter("oid <> sid").select("oid"), "oid", "left_anti").withColumnRenamed("oid", "sid")
    return classes, members, large


def large_pairs(rows: DataFrame, large: DataFrame, threshold: float, largest: int = LARGEST) -> DataFrame:
    """``(field, a, b, overlap, similarity)`` of similar sets of which one has more than ``largest`` values."""
    if large.filter(F.col("size") > largest).isEmpty():
        return rows.sparkSession.createDataFrame([], "field string, a string, b string, overlap bigint, similarity double")
    whole = _keyed(rows).join(large, "oid").select("field", "owner", "value", "size").distinct()
    side = lambda x: whole.select("field", "value", F.col("owner").alias(x), F.col("size").alias(f"size_{x}"))
    small, great = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    met = side("a").join(side("b"), ["field", "value"]).filter((F.col("a") < F.col("b")) & (great > largest) & (small + 1e-9 >= great * threshold))
    counted = met.groupBy("field", "a", "b", "size_a", "size_b").agg(F.count("*").alias("overlap"))
    similarity = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    return counted.select("field", "a", "b", "overlap", similarity.alias("similarity")).filter(F.col("similarity") + 1e-9 >= threshold)


class Pigeonhole:
    """Signatures of sets for one threshold and least size."""

    def __init__(self, threshold: float, min_size: int, n_sets: int = 1, common: int = 64):
        self.t, self.min_size, self.n_sets, self.common = threshold, max(1, min_size), max(1, n_sets), common
        # within this many sizes the bound on the difference has passed its maximum
        self.period = math.ceil((1 + threshold) / threshold) + 1

    def most_different(self, g: int) -> int:
        """The most values in which similar sets of length class ``g`` differ."""
        top = (1 << (g + 1)) - 1
        return max(2 * n - 2 * least_overlap(n, n, self.t) for n in range(max(1, top - self.period), top + 1))

    def layouts(self, g: int) -> list[int]:
        """Numbers of segments of common values in use for length class ``g``."""
        out = [1]
        while 2 * out[-1] < self.most_different(g) + 1:
            out.append(2 * out[-1])
        return out

    def smallest(self, size: int) -> int:
        """The smallest partner of a set."""
        return max(self.min_size, math.ceil(size * self.t - 1e-9))

    def slack(self, size: int, shared: int) -> int:
        """The most values in which a set can differ from similar ones that are not larger."""
        return max((n + shared - 2 * least_overlap(n, size, self.t) for n in range(max(self.smallest(size), size - self.period), size + 1)), default=-1)

    def largest(self, size: int, shared: int) -> int:
        """The largest partner of a set with ``shared`` values others have."""
        return min(int(size / self.t + 1e-9), int(shared * (1 + self.t) / self.t - size + 1e-9))

    def split(self, values: list[tuple[int, int]], g: int) -> tuple[dict[int, list], list[tuple[int, int]]]:
        """Segments of the rare values, and the common values."""
        m, parts, common = self.most_different(g) + 1, {}, []
        for df, vid in values:
            if df > self.common:
                common.append((df, vid))
            else:
                parts.setdefault((vid >> 8) % m, []).append((df, vid))
        return parts, common

    @staticmethod
    def pile(common: list[tuple[int, int]], m: int) -> dict[int, list]:
        """Common values in ``m`` segments."""
        parts: dict[int, list] = {}
        for df, vid in common:
            parts.setdefault((vid >> 8) % m, []).append((df, vid))
        return parts

    @staticmethod
    def signature(kind: int, g: int, m: int, segment: int, x: int) -> int:
        """A signed hash; ``m`` is 0 for segments of rare values."""
        mixed = (x + ((g << 56) + (m << 29) + (segment << 2) + kind) * _SPREAD) & _MASK
        return mixed - (1 << 64) if mixed >> 63 else mixed

    @staticmethod
    def combined(part: list[tuple[int, int]]) -> int:
        x = 0
        for _, vid in part:
            x ^= vid
        return x

    def options(self, m: int, parts: dict[int, list]) -> list[tuple[float, int, int, int]]:
        """Allowances on offer: expected number of sets that share the signatures, segments, segment, allowance."""
        out = []
        for segment, part in parts.items():
            shares = [df / self.n_sets for df, _ in part]
            whole = math.prod(shares)
            out.append((self.n_sets * whole, m, segment, 0))
            if len(part) > 1:
                out.append((self.n_sets * (whole + sum(whole / s for s in shares)), m, segment, 1))
        return out

    def picks(self, size: int, values: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int, list]], bool]:
        """Picked segments ``(m, segment, allowance, values)``, and whether they suffice."""
        need = self.slack(size, len(values)) + 1
        if need <= 0:
            return [], True
        g = size.bit_length() - 1
        rare, common = self.split(values, g)
        offered = self.options(0, rare)
        for m in [0, *self.layouts(g)]:
            parts = {0: rare} | ({m: self.pile(common, m)} if m else {})
            full = offered + (self.options(m, parts[m]) if m else [])
            if len(full) >= need:
                chosen: dict[tuple[int, int], int] = {}
                for _, at, segment, allow in sorted(full)[:need]:
                    chosen[at, segment] = max(allow, chosen.get((at, segment), 0))
                return [(at, segment, allow, parts[at][segment]) for (at, segment), allow in chosen.items()], True
        return [], False

    def posted(self, size: int, values: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
        """Signatures under which a set is found by partners that are not larger, and the values that do so instead.

        The latter are the rarest values of a set whose segments do not suffice, one
        of which any partner has, with the number of sets that have them.
        """
        g, out = size.bit_length() - 1, []
        picks, enough = self.picks(size, values)
        for m, segment, allow, part in picks:
            x = self.combined(part)
            out.append(self.signature(1, g, m, segment, x))
            if allow:
                out += [self.signature(1, g, m, segment, x ^ vid) for _, vid in part]
                out.append(self.signature(2, g, m, segment, x))
        return out, [] if enough else values[: max(0, len(values) - least_overlap(self.smallest(size), size, self.t) + 1)]

    def probes(self, size: int, values: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
        """Signatures under which a set looks for partners that are not smaller; no values."""
        largest, out = self.largest(size, len(values)), []
        if largest < size:
            return out, []
        for g in range(size.bit_length() - 1, largest.bit_length()):
            rare, common = self.split(values, g)
            for m, parts in [(0, rare), *[(m, self.pile(common, m)) for m in (self.layouts(g) if common else [])]]:
                for segment, part in parts.items():
                    x = self.combined(part)
                    out.append(self.signature(1, g, m, segment, x))
                    if len(part) > 1:
                        out += [self.signature(2, g, m, segment, x ^ vid) for _, vid in part]
        return out, []


_SIGNED = "sig bigint, df bigint, sid bigint, sizes bigint, bits bigint"


def _signed(classes: DataFrame, make: str, rule: Pigeonhole) -> DataFrame:
    """Rows ``(sig, df, sid, sizes, bits)``; ``sizes`` holds the size and, in the low half, the number of shared values.

    ``df`` is the number of sets for values in place of signatures, else 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            flat = lists.flatten()
            first = int(offsets[0]) if len(offsets) else 0
            # ids as unsigned numbers, for the arithmetic on segments
            dfs, vids = flat.field(0).to_pylist(), flat.field(1).to_numpy().astype(np.int64).view(np.uint64).tolist()
            columns: list[list] = [[], [], [], [], []]
            for i, (sid, size, bits) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                lo, hi = int(offsets[i]) - first, int(offsets[i + 1]) - first
                signatures, instead = getattr(rule, make)(size, list(zip(dfs[lo:hi], vids[lo:hi])))
                marks = [0] * len(signatures) + [df for df, _ in instead]
                signatures += [v - ((v >> 63) << 64) for _, v in instead]
                n = len(signatures)
                for column, value in zip(columns, (signatures, marks, [sid] * n, [(size << 32) + hi - lo] * n, [bits] * n)):
                    column += value
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sig", "df", "sid", "sizes", "bits"])

    return classes.select("sid", "size", "values", "bits").mapInArrow(run, _SIGNED)


def candidate_pairs(classes: DataFrame, threshold: float, min_size: int = 1) -> DataFrame:
    """Distinct ``(a, b)`` of class ids with ``a < b``: a superset of the similar pairs of different classes."""
    rule = Pigeonhole(threshold, min_size, classes.count())
    names = ["sid", "sizes", "bits"]
    size, shared = (lambda x: F.shiftright(f"sizes_{x}", 32)), (lambda x: F.col(f"sizes_{x}").bitwiseAND(F.lit((1 << 32) - 1)))
    needed = F.ceil((size("r") + size("s")) * (threshold / (1 + threshold)) - 1e-9)
    possible = (F.col("sid_r") != F.col("sid_s")) & (size("r") <= size("s")) & (size("r") + 1e-9 >= size("s") * threshold)
    possible = possible & (F.bit_count(F.col("bits_r").bitwiseXOR(F.col("bits_s"))) <= shared("r") + shared("s") - 2 * needed)
    pair = [F.least("sid_r", "sid_s").alias("a"), F.greatest("sid_r", "sid_s").alias("b")]
    written = cut(_signed(classes, "posted", rule), "posted")
    posted, probes = written.filter("df = 0"), _signed(classes, "probes", rule)
    part = F.pmod(F.xxhash64("sid"), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    # signatures of very many sets are split into parts, which every probe visits
    counts = posted.groupBy("sig").agg(F.count("*").alias("k"))
    group = max(GROUP, written.count() // HOT)
    hot = F.broadcast(cut(counts.filter(F.col("k") > group).select("sig", F.ceil(F.col("k") / group).alias("parts")), "hot"))  # HOT rows at most
    split = lambda df, at: df.join(hot, "sig", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", at)
    as_part = lambda df, x: df.select("sig", "part", *[F.col(n).alias(f"{n}_{x}") for n in names])
    found = as_part(split(probes, every), "r").join(as_part(split(posted, part), "s"), ["sig", "part"]).filter(possible).select(*pair)
    # the values of sets without enough segments, split by how many sets have the value
    both = F.shiftleft(F.col("size").cast("long"), 32) + F.size("values")
    parts = F.ceil(F.col("df") / GROUP)
    short = written.filter("df > 0").withColumn("parts", parts).withColumn("part", every)
    wanted = cut(short.select("sig").distinct(), "short_values")
    spread = classes.select("sid", both.alias("sizes"), "bits", F.explode("values").alias("v")).select("sid", "sizes", "bits", F.col("v.vid").alias("sig"), F.col("v.df").alias("df"))
    spread = spread.join(wanted, "sig", "left_semi").withColumn("parts", parts).withColumn("part", part)
    # a merge join hands on rows one by one; the values of a long set would be held in memory otherwise
    by_value = as_part(spread, "r").hint("merge").join(as_part(short, "s"), ["sig", "part"]).filter(possible).select(*pair)
    return found.unionByName(by_value).distinct()


def _jaccard(values_a: Column, values_b: Column, size_a: Column, size_b: Column) -> tuple[Column, Column]:
    overlap = F.size(F.array_intersect(values_a, values_b))
    return overlap, overlap / (size_a + size_b - overlap)


def similar_classes(rows: DataFrame, threshold: float = 0.5, min_size: int = 1, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """Similar pairs between class representatives ``(field, a, b, overlap, similarity)``, and ``members(field, rep, owner)``.

    Members are those of classes with a similar class or of several owners.
    Members of one class have similarity 1 and are not listed as pairs; sets above
    ``largest`` are classes of their own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and at most at 1")
    classes, members, large = set_classes(rows, threshold, min_size, largest)
    pairs = candidate_pairs(classes, threshold, min_size)
    side = lambda n: classes.select(F.col("sid").alias(n), F.col("size").alias(f"size_{n}"), F.col("values.vid").alias(f"values_{n}"))
    overlap, similarity = _jaccard(F.col("values_a"), F.col("values_b"), F.col("size_a"), F.col("size_b"))
    hits = pairs.join(side("a"), "a").join(side("b"), "b").filter(similarity + 1e-9 >= threshold).select("a", "b")
    hits = cut(hits, "hits")
    # names and values of what was found, from a second scan
    ends = hits.select(F.explode(F.array("a", "b")).alias("oid"))
    wanted = ends.unionByName(members.select("oid")).distinct()
    named = _keyed(rows).join(cut(wanted, "wanted"), "oid", "left_semi").groupBy("oid", "field", "owner").agg(F.collect_set("value").alias("values"))
    named = cut(named, "named")
    one = lambda n: named.select(F.col("oid").alias(n), F.col("field").alias(f"field_{n}"), F.col("owner").alias(f"owner_{n}"), F.col("values").alias(f"values_{n}"))
    checked = hits.join(one("a"), "a").join(one("b"), "b").filter("field_a = field_b")
    overlap, similarity = _jaccard(F.col("values_a"), F.col("values_b"), F.size("values_a"), F.size("values_b"))
    checked = checked.select(F.col("field_a").alias("field"), "owner_a", "owner_b", overlap.cast("long").alias("overlap"), similarity.alias("similarity"))
    checked = checked.filter(F.col("similarity") + 1e-9 >= threshold)
    checked = checked.select("field", F.least("owner_a", "owner_b").alias("a"), F.greatest("owner_a", "owner_b").alias("b"), "overlap", "similarity")
    names = named.select("oid", "field", "owner")
    reps = names.select(F.col("oid").alias("sid"), F.col("owner").alias("rep"))
    several = members.join(names, "oid").join(reps, "sid").select("field", "rep", "owner")
    alone = names.join(members.select("oid"), "oid", "left_anti").select("field", F.col("owner").alias("rep"), "owner")
    great = large_pairs(rows, large, threshold, largest)
    ends = great.select("field", F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("owner", F.col("rep"))
    # a set below the bound may be similar to sets on both sides of it
    alone = alone.unionByName(ends.join(several.unionByName(alone), ["field", "owner"], "left_anti").select("field", "rep", "owner"))
    to_rep = several.select("field", F.col("owner").alias("end"), F.col("rep").alias("of"))
    for end in ("a", "b"):  # the pairs of large sets, too, are between representatives
        great = great.join(to_rep, (great["field"] == to_rep["field"]) & (great[end] == to_rep["end"]), "left").select(great["field"], *[F.coalesce("of", great[c]).alias(c) if c == end else great[c] for c in great.columns[1:]])
    great = great.select("field", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap", "similarity").distinct()
    return checked.unionByName(great), several.unionByName(alone)


def similar_pairs(rows: DataFrame, threshold: float = 0.5, min_size: int = 1, largest: int = LARGEST) -> DataFrame:
    """All similar pairs of owners ``(field, a, b)``, ``a < b``, members of classes expanded."""
    pairs, members = similar_classes(rows, threshold, min_size, largest)
    pairs, members = cut(pairs, "similar"), cut(members, "members")
    one = lambda n: members.select("field", F.col("rep").alias(n), F.col("owner").alias(f"owner_{n}"))
    across = pairs.join(one("a"), ["field", "a"]).join(one("b"), ["field", "b"]).select("field", F.col("owner_a").alias("x"), F.col("owner_b").alias("y"))
    many = members.groupBy("field", "rep").agg(F.count("*").alias("k")).filter("k > 1").select("field", "rep")
    copies = members.join(many, ["field", "rep"], "left_semi")
    inside = copies.select("field", "rep", F.col("owner").alias("x")).join(copies.select("field", "rep", F.col("owner").alias("y")), ["field", "rep"]).filter("x < y").select("field", "x", "y")
    return across.unionByName(inside).select("field", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
