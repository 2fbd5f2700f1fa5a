"""Keyword-stuffed and link-list documents, by block-wise compression.

The content of a document, apart from commit header and framing of diffs and
merges, is split by language: message and files of prose (text, markup) have the
document's language, other files that of their kind.  Of a diff the added and kept
lines count, the removed ones only where nothing else is there.  Blocks of about
512 bytes are compressed one by one, letters in lower case and digits that stand for
letters spelled out.  What a block should come to is the median ratio of blocks of
its length over the whole corpus, times the median factor of its language.  The
redundancy of a document is how many robust deviations (median absolute deviation
of its language) its content lies below that: extreme redundancy flags it.

Flagged documents are confirmed by the density of sentence punctuation: the share
of content on lines that are closed by the mark of a sentence (``. ! ?`` after a
word) or of a statement (``; { } ) :``), tags left out and links taken as a word.  Keyword and link
lists have hardly any.

Defined results: null and empty texts, and contents below ``min_bytes``, which do
not compress at all, are no case; a null or unknown language forms a class of its
own, as do all kinds of files with fewer than ``RARE`` documents together; texts
are read whole; repeated documents count each and get the same answer each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.session import cut

BLOCK = 512
#: Languages of fewer documents are pooled.
RARE = 20
#: The least deviation of a language, so that one of equal files does not flag noise.
LEAST_SPREAD = 0.05
#: Sections below this do not enter the spread of their language.
STEADY = 100

# Kinds of files that hold prose.
PROSE = frozenset("adoc htm html markdown md rst tex txt xhtml".split())
# Digits that stand for letters in disguised words.
_DISGUISE = str.maketrans("34015", "eaois")

_HEADER = re.compile(
    r"(commit [0-9a-f]{7,64}|From [0-9a-f]{40} .*|(?:Author|AuthorDate|Commit|CommitDate|Date|From|Subject|Merge|Signed-off-by|Reviewed-by|"
    r"Acked-by|Co-authored-by|Cc|Change-Id|Tested-by): ?.*)$"
)
_FRAMING = re.compile(
    r"(index [0-9a-f]+\.\.[0-9a-f]+.*|(?:---|\+\+\+) .*|@@ .*|(?:new|deleted) file mode .*|(?:old|new) mode .*|similarity index .*|"
    r"rename (?:from|to) .*|\\ No newline.*|GIT binary patch|Binary files .*|(?:literal|delta) \d+)$"
)
_CONFLICT = ("<<<<<<<", "=======", ">>>>>>>")
_TAG = re.compile(r"<[^<>]*>")
_LINK = re.compile(r"\]\([^()]*\)|[a-z]{1,10}://\S+|www\.\S+", re.I)
_CLOSED = re.compile(r"(?:[^\W\d_]{2}[\"')]*[.!?]|[;{}):])[\"'`]*$")
#: Closing marks that also separate the items of a list.
_SEPARATORS = ";:"


def _kind(path: str) -> str:
    name = path.rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1]


def sections(text: str, lang: str) -> dict[str, list[str]]:
    """Lines of content per language."""
    kept: dict[str, list[str]] = {}
    removed: dict[str, list[str]] = {}
    at, in_diff = lang, False
    for line in text.splitlines():
        to = kept
        if line.startswith("diff --git "):
            in_diff, kind = True, _kind(line)
            at = lang if kind in PROSE else f".{kind}"
            continue
        if in_diff:
            if _FRAMING.match(line):
                continue
            mark = line[:1]
            if mark in ("+", "-", " "):
                line = line[1:]
                to = removed if mark == "-" else kept
        elif _HEADER.match(line):
            continue
        line = line.strip()
        if line and not line.startswith(_CONFLICT):
            to.setdefault(at, []).append(line)
    for at, lines in removed.items():
        kept.setdefault(at, lines)
    return kept


def closed(line: str) -> bool:
    """Whether a line ends like a sentence or a statement."""
    plain = line
    if "://" in line or "](" in line or "www." in line.lower():
        plain = _LINK.sub("x", plain)
    if "<" in plain:
        plain = _TAG.sub("", plain).rstrip()
    if plain[-1:].isalnum() or not _CLOSED.search(plain[-200:]):
        return False
    return plain[-1] not in _SEPARATORS or plain.count(plain[-1]) == 1


def blocks(data: bytes) -> Iterator[tuple[int, int]]:
    """Raw and compressed sizes of blocks, all but the last of equal size."""
    if data:
        step = -(-len(data) // max(1, round(len(data) / BLOCK)))
        for i in range(0, len(data), step):
            part = data[i : i + step]
            yield len(part), len(zlib.compress(part, 9))


def measure(text: str | None, lang: str) -> list[tuple[str, int, int, int, int, int]]:
    """``(language, size_class, raw, packed, chars, closed_chars)`` per section and class of block lengths.

    There are at most two classes in a section; the characters stand with the first.
    """
    out = []
    for language, lines in sections(text or "", lang).items():
        per: dict[int, list[int]] = {}
        for raw, packed in blocks("\n".join(lines).lower().translate(_DISGUISE).encode("utf-8", "replace")):
            sums = per.setdefault(int(4 * math.log2(raw)), [0, 0])
            sums[0] += raw
            sums[1] += packed
        chars, shut = sum(map(len, lines)), sum(len(x) for x in lines if closed(x))
        for size_class, (raw, packed) in per.items():
            out.append((language, size_class, raw, packed, chars, shut))
            chars = shut = 0
    return out


_SCHEMA = "rid bigint, doc_id bigint, language string, class int, raw bigint, packed bigint, chars bigint, closed bigint"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << 40  # tells apart rows with one doc_id; fixed once written
    for batch in batches:
        rows = []
        for doc_id, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            at += 1
            rows += [(at, doc_id, *row) for row in measure(text, lang)]
        columns = list(zip(*rows)) if rows else [[]] * len(_KINDS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def _median(value) -> object:
    """The exact median to three places; a group thus has few distinct values, which bounds its state."""
    return F.percentile(F.round(value, 3), F.lit(0.5))


def redundancy(documents: DataFrame) -> DataFrame:
    """``(doc_id, bytes, ratio, expected, deviations, closed)`` of ``documents(doc_id, text, lang)``, one row per document with content.

    ``ratio`` and ``expected`` are compressed to raw bytes; ``deviations`` is negative
    where the content is more redundant than its language, weighted by the size of
    the sections; ``closed`` is the density of sentence punctuation.  Statistics are
    those of all documents.
    """
    lang = F.coalesce(F.nullif(F.lower(F.trim("lang")), F.lit("")), F.lit("und"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    rows = cut(texts.mapInArrow(_measure, _SCHEMA), "measured")
    # written tables, so their size is known to the engine, which broadcasts them if they are small
    known = rows.groupBy("language").agg(F.count_distinct("rid").alias("k")).filter(F.col("k") >= RARE)
    rows = rows.join(cut(known.select("language", F.lit(True).alias("known")), "languages"), "language", "left")
    rows = rows.withColumn("language", F.when(F.col("known"), F.col("language")).otherwise("*"))
    ratio = F.col("packed") / F.col("raw")
    base = rows.groupBy("class").agg(_median(ratio).alias("base"))
    based = rows.join(F.broadcast(base), "class")  # a block has at most 768 bytes, which makes 39 classes
    factors = cut(based.groupBy("language").agg(_median(ratio / F.col("base")).alias("factor")), "factors")
    based = based.join(factors, "language").withColumn("due", F.col("raw") * F.col("base") * F.col("factor"))
    parts = based.groupBy("rid", "doc_id", "language").agg(*[F.sum(c).alias(c) for c in ("raw", "packed", "due", "chars", "closed")])
    parts = cut(parts.withColumn("gap", F.log(F.col("packed") / F.col("due"))), "sections")
    spread = 1.4826 * _median(F.abs(F.when(F.col("raw") >= STEADY, F.col("gap"))))
    spreads = cut(parts.groupBy("language").agg(F.greatest(spread, F.lit(LEAST_SPREAD)).alias("spread")), "spreads")
    scored = parts.join(spreads, "language").withColumn("off", F.col("gap") / F.col("spread") * F.col("raw"))
    sums = scored.groupBy("rid", "doc_id").agg(*[F.sum(c).alias(c) for c in ("raw", "packed", "due", "off", "chars", "closed")])
    raw = F.col("raw")
    measures = {"ratio": F.col("packed") / raw, "expected": F.col("due") / raw, "deviations": F.col("off") / raw, "closed": F.col("closed") / F.col("chars")}
    return sums.select("doc_id", raw.alias("bytes"), *[F.round(c, 6).alias(n) for n, c in measures.items()])


def stuffed_documents(documents: DataFrame, deviations: float = 2.0, max_closed: float = 0.2, min_bytes: int = 64) -> DataFrame:
    """Documents that are keyword stuffing or lists of links, with their measures.

    ``deviations`` below its language make a content extremely redundant;
    ``max_closed`` is the most sentence punctuation that confirms it.
    """
    flagged = redundancy(documents).filter((F.col("bytes") >= min_bytes) & (F.col("deviations") <= -deviations))
    return flagged.filter(F.col("closed") <= max_closed)
