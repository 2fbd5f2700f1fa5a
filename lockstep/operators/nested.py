"""Nested records to related flat tables by shared inlining.

The operator has two front ends with one contract.

* JSON text of unsteady shape (``shred_json``): the schema graph is measured over
  all rows, a plan decides which elements get a table, and a second pass fills
  the tables.
* Typed Spark columns (``shred_typed``): the schema graph is the Spark schema, and
  the same plan makes the tables as plain projections and ``posexplode``.

Shared inlining, as used for element graphs of nested documents: an element is a
key of an object.  The root, every element that repeats, that is an object below
several parents, or that is recursive gets a table of its own; every other object
is inlined into its nearest ancestor with a table, as columns
``outer_inner``.  Inside, attributes are named by JSON pointers (``outer/inner``,
``~1`` for a slash in a key and ``~0`` for a tilde), so keys that look like paths
stay apart; where two column names of a table clash, ignoring case, the deeper one
gets a suffix.  Rows of child tables carry the key of their record, their own id,
the id of the parent row and their position, so parent links survive.

Defined results for untidy input:

* a text that is not one whole JSON object gives nothing (``NaN`` and
  ``Infinity`` are not JSON), neither does null;
* one value in place of a list is a list of that value; null in place of a list
  is an empty list; null elements give no row but keep their position;
* a list inside a list is walked in order, positions are joined;
* a scalar where objects are usual goes to the column ``value``;
* of repeated keys in an object the last one counts.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above so many (parent, key) edges the input is not one kind of record and a plan makes no sense.
MAX_EDGES = 20_000

_EDGE_SCHEMA = "parent string, child string, shape string, repeated boolean, n bigint"
_CELL_SCHEMA = T.StructType(
    [
        T.StructField("element", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent_element", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("lineage", T.StringType()),
        T.StructField("parent_path", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("cells", T.MapType(T.StringType(), T.StringType())),
    ]
)


class _NotJson(ValueError):
    pass


def _reject_constant(name: str):
    raise _NotJson(name)


def _clean(text: str) -> str:
    """Lone surrogates cannot be stored as UTF-8; they become question marks."""
    if text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def parse_record(text: str | None, root_key: str | None = None) -> dict | None:
    """The object of ``text``, or None.

    With ``root_key`` it is the object holding that key, at the top or one level
    down.  Numbers keep their spelling.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=str, parse_float=str, parse_constant=_reject_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    if root_key is None or root_key in value:
        return value
    for inner in value.values():
        if isinstance(inner, dict) and root_key in inner:
            return inner
    return None


def _scalar(value) -> str:
    if value is True:
        return "true"
    if value is False:
        return "false"
    return _clean(value)


def _flat(value) -> Iterator:
    """Elements below a value, lists inside lists opened."""
    stack = [value]
    while stack:
        top = stack.pop()
        if isinstance(top, list):
            stack.extend(reversed(top))
        else:
            yield top


def _add_edges(found: Counter, record: dict, root: str) -> None:
    """Count the edges of a record in ``found``."""
    stack = [(root, record)]
    while stack:
        name, obj = stack.pop()
        for key, value in obj.items():
            key = _clean(key)
            repeated = isinstance(value, list)
            for one in _flat(value) if repeated else (value,):
                if isinstance(one, dict):
                    found[name, key, "object", repeated] += 1
                    stack.append((key, one))
                elif one is not None:
                    found[name, key, "scalar", repeated] += 1


def schema_graph(df: DataFrame, payload: str, root: str = "record", root_key: str | None = None) -> DataFrame:
    """Edges ``(parent, child, shape, repeated, n)`` of the element graph of a JSON column."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                record = parse_record(text, root_key)
                if record is not None:
                    _add_edges(total, record, root)
        rows = [(p, c, s, r, n) for (p, c, s, r), n in total.items()]
        columns = list(zip(*rows)) if rows else [[], [], [], [], []]
        kinds = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["parent", "child", "shape", "repeated", "n"]
        )

    parts = df.select(F.col(payload).cast("string").alias("payload")).mapInArrow(profile, _EDGE_SCHEMA)
    return parts.groupBy("parent", "child", "shape", "repeated").agg(F.sum("n").alias("n"))


def _token(key: str) -> str:
    """A key as a part of a JSON pointer."""
    if "~" not in key and "/" not in key:
        return key
    return key.replace("~", "~0").replace("/", "~1")


@dataclass(frozen=True)
class InliningPlan:
    """Which elements have a table, and the columns of each table: pointers of attributes and their names."""

    root: str
    tables: frozenset[str]
    columns: dict[str, dict[str, str]] = field(default_factory=dict)
    below: dict[str, frozenset[str]] = field(default_factory=dict)

    @staticmethod
    def of(edges: list[tuple[str, str, str, bool]], root: str, separate: frozenset[str] = frozenset()) -> InliningPlan:
        parents: dict[str, set[str]] = defaultdict(set)
        children: dict[str, set[str]] = defaultdict(set)
        direct: dict[str, list[tuple[str, str]]] = defaultdict(list)
        tables = {root} | separate
        for parent, child, shape, repeated in edges:
            direct[parent].append((child, shape))
            if repeated:
                tables.add(child)
            if shape == "object":
                parents[child].add(parent)
                children[parent].add(child)
        tables |= {name for name, above in parents.items() if len(above) > 1}
        tables |= {name for name, reached in _reached(children).items() if name in reached}
        below = _reached({name: {c for c, _ in found} for name, found in direct.items()})
        columns: dict[str, set[str]] = {name: set() for name in tables}
        for name in tables:
            todo = [(name, "")]
            while todo:
                at, prefix = todo.pop()
                for child, shape in direct.get(at, ()):
                    pointer = prefix + _token(child)
                    if child in tables:
                        if shape == "scalar":
                            columns[child].add("value")
                    elif shape == "scalar":
                        columns[name].add(pointer)
                    else:
                        todo.append((child, f"{pointer}/"))
        return InliningPlan(root, frozenset(tables), {k: _named(v) for k, v in columns.items()}, {k: frozenset(v) for k, v in below.items()})

    def leads_to(self, element: str, wanted: frozenset[str]) -> bool:
        """Whether rows of wanted elements can lie at or below an element."""
        return element in wanted or bool(self.below.get(element, frozenset()) & wanted)


def _reached(children: dict[str, set[str]]) -> dict[str, set[str]]:
    """What lies below each name at any depth."""
    out: dict[str, set[str]] = {}
    for name in children:
        seen: set[str] = set()
        todo = list(children[name])
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo.extend(children.get(at, ()))
        out[name] = seen
    return out


def _plain(pointer: str) -> str:
    return "_".join(t.replace("~1", "/").replace("~0", "~") for t in pointer.split("/"))


def _named(pointers: set[str]) -> dict[str, str]:
    """Column names of pointers, distinct even without regard to case."""
    out, taken = {}, set()
    for pointer in sorted(pointers, key=lambda p: (p.count("/"), p)):
        name, n = _plain(pointer), 1
        while name.lower() in taken:
            n += 1
            name = f"{_plain(pointer)}~{n}"
        taken.add(name.lower())
        out[pointer] = name
    return out


def plan_inlining(graph: DataFrame, root: str = "record", separate: set[str] = frozenset()) -> InliningPlan:
    """The plan for a schema graph.  The graph has one row per kind of edge, which the bound checks.

    ``separate`` names elements that get a table in any case, so that tables
    expected downstream do not hang on the rows at hand.
    """
    rows = graph.select("parent", "child", "shape", "repeated").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} kinds of edges; these records have no common schema")
    return InliningPlan.of([tuple(r) for r in rows], root, frozenset(separate))


def _placed(value) -> Iterator[tuple[tuple[int, ...], object]]:
    """Elements of a list, or of one value in its place, with their positions; a list inside keeps one more."""
    for at, one in enumerate(value if isinstance(value, list) else [value]):
        if isinstance(one, list):
            yield from (((at, k), x) for k, x in enumerate(_flat(one)) if x is not None)
        elif one is not None:
            yield (at,), one


def _rows_of(record: dict, key: str, plan: InliningPlan, wanted: frozenset[str] | None = None, needed: frozenset[str] | None = None) -> Iterator[tuple]:
    """Rows of all tables, or of the wanted ones, for one record, parents first; only ``needed`` tables are entered."""
    # element, parent element, parent id, lineage, parent's path, pos, own id, own path, value
    stack = [(plan.root, None, None, "", "", 0, _token(key), "", record)]
    while stack:
        element, up, up_id, lineage, up_path, pos, own, path, value = stack.pop()
        cells: dict[str, str] = {}
        below = []
        if isinstance(value, dict):
            todo = [("", lineage, value)]
            while todo:
                prefix, line, obj = todo.pop()
                for name, inner in obj.items():
                    name = _clean(name)
                    if inner is None:
                        continue
                    pointer = prefix + _token(name)
                    deeper = f"{line}/{name}" if line else name
                    if name in plan.tables:
                        if needed is not None and name not in needed:
                            continue
                        for where, x in _placed(inner):
                            dotted = ".".join(map(str, where))
                            place = "/".join(map(str, where))
                            below.append((name, element, own, deeper, path, where[-1], f"{own}/{pointer}/{place}", f"{path}.{dotted}" if path else dotted, x))
                    elif isinstance(inner, dict):
                        todo.append((f"{pointer}/", deeper, inner))
                    elif not isinstance(inner, list):
                        cells[pointer] = _scalar(inner)
                    elif any(x is not None for x in _flat(inner)):
                        raise ValueError(f"{deeper} repeats, but the plan inlines it: it is the plan of other rows")
        else:
            cells["value"] = _scalar(value)
        if wanted is None or element in wanted:
            yield element, own, up, up_id, lineage, up_path, pos, cells
        stack.extend(reversed(below))


def shred_json(df: DataFrame, key: str, payload: str, plan: InliningPlan, root_key: str | None = None, elements: set[str] | None = None) -> DataFrame:
    """The rows of all tables, or of those of ``elements``, in one relation, ready for :func:`relation`.

    ``key`` must be unique in ``df``; it becomes the id of the root row, and the
    ids of rows below extend it, so a retried task gives the same ids.  The plan
    must come from the same rows: an element that repeats although it is inlined
    raises an error.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField("record", key_type), *_CELL_SCHEMA.fields])
    cells_type = pa.map_(pa.string(), pa.string())
    wanted = None if elements is None else frozenset(elements)
    needed = None if wanted is None else frozenset(t for t in plan.tables if plan.leads_to(t, wanted))

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at: list[int] = []
            rows: list[tuple] = []

            def flush():
                columns = list(zip(*rows)) if rows else [[] for _ in range(8)]
                kinds = [pa.string()] * 6 + [pa.int64(), cells_type]
                columns[7] = [list(c.items()) for c in columns[7]]
                arrays = [keys.take(pa.array(at, pa.int64()))]
                arrays += [pa.array(c, k) for c, k in zip(columns, kinds)]
                return pa.RecordBatch.from_arrays(arrays, names=schema.names)

            for i, text in enumerate(texts):
                record = parse_record(text, root_key)
                if record is None:
                    continue
                for row in _rows_of(record, str(keys[i].as_py()), plan, wanted, needed):
                    at.append(i)
                    rows.append(row)
                if len(rows) >= 20_000:
                    yield flush()
                    at.clear()
                    rows.clear()
            yield flush()

    return df.select(F.col(key), F.col(payload).cast("string")).mapInArrow(shred, schema)


LINKS = ["record", "id", "parent_element", "parent_id", "lineage", "parent_path", "pos"]


def relation(shredded: DataFrame, plan: InliningPlan, element: str, attributes: list[str] | None = None) -> DataFrame:
    """The flat table of one element: keys, links and one column per inlined attribute.

    Attributes are prefixed ``a_``, so they cannot clash with the link columns;
    ``attributes`` fixes which ones (as pointers), those that never occurred being
    null.  An attribute that repeats somewhere has a table of its own, and the
    first value of the row there is taken.
    """
    known = plan.columns.get(element, {})
    names = known if attributes is None else {p: known.get(p, _plain(p)) for p in attributes}
    own = {p: n for p, n in names.items() if p in plan.tables} if attributes is not None else {}
    out = shredded.filter(F.col("element") == element)
    out = out.select(*LINKS, *[F.col("cells").getItem(p).alias(f"a_{n}") for p, n in names.items() if p not in own])
    for pointer, name in own.items():
        values = shredded.filter((F.col("element") == pointer) & (F.col("parent_element") == element))
        first = F.min_by(F.col("cells").getItem("value"), F.struct("pos", "id")).alias(f"a_{name}")
        out = out.join(values.groupBy("record", F.col("parent_id").alias("id")).agg(first), ["record", "id"], "left")
    return out.select(*LINKS, *[f"`a_{n}`" for n in names.values()])


def typed_edges(schema: T.StructType, root: str) -> list[tuple[str, str, str, bool]]:
    """Edges of the element graph of a Spark schema."""
    out, todo = [], [(root, f) for f in schema.fields]
    while todo:
        parent, f = todo.pop()
        kind, repeated = f.dataType, False
        while isinstance(kind, T.ArrayType):
            kind, repeated = kind.elementType, True
        out.append((parent, f.name, "object" if isinstance(kind, T.StructType) else "scalar", repeated))
        if isinstance(kind, T.StructType):
            todo += [(f.name, inner) for inner in kind.fields]
    return out


def _flattened(items: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """A list inside a list as one list of what lies in it; a null list counts as one null element."""
    while isinstance(kind, T.ArrayType):
        items, kind = F.flatten(F.transform(items, lambda x: F.coalesce(x, F.array(F.lit(None))))), kind.elementType
    return items, kind


def shred_typed(df: DataFrame, key: str, columns: list[str], root: str = "record", separate: set[str] = frozenset()) -> tuple[dict[str, DataFrame], InliningPlan]:
    """Tables of nested columns by element, as :func:`relation` has them, and their plan; all JVM-side.

    The rules are those of JSON: structs are inlined unless they are shared, every
    array level becomes a table with its position, null lists and null elements give
    no rows, positions count all elements, a list in a list keeps one more position.
    Scalars keep their types; maps count as scalars.  ``key`` must be unique.
    """
    schema = T.StructType([df.schema[c] for c in columns])
    plan = InliningPlan.of(typed_edges(schema, root), root, frozenset(separate))
    tables: dict[str, DataFrame] = {}

    def project(rows: DataFrame, element: str, kind: T.DataType, line: str) -> None:
        """``rows`` has the links, ``path`` and ``item``, the element itself."""
        cells: list[Column] = []
        nested: list[tuple[str, str, str, T.DataType, Column]] = []

        def walk(struct: T.StructType, at: Column, prefix: str, line: str) -> None:
            for f in struct.fields:
                pointer, deeper = prefix + _token(f.name), f"{line}/{f.name}" if line else f.name
                if f.name in plan.tables:
                    nested.append((f.name, pointer, deeper, f.dataType, at[f.name]))
                elif isinstance(f.dataType, T.StructType):
                    walk(f.dataType, at[f.name], f"{pointer}/", deeper)
                else:
                    cells.append(at[f.name].alias(f"a_{plan.columns[element][pointer]}"))

        if isinstance(kind, T.StructType):
            walk(kind, F.col("item"), "", line)
        else:
            cells.append(F.col("item").alias("a_value"))
        table = rows.select(*LINKS, *cells)
        tables[element] = tables[element].unionByName(table, True) if element in tables else table
        for name, pointer, deeper, inner, items in nested:
            inner, items = (inner.elementType, items) if isinstance(inner, T.ArrayType) else (inner, F.array(items))
            up = [F.lit(element).alias("parent_element"), F.col("id").alias("parent_id"), F.lit(deeper).alias("lineage"), F.col("path").alias("parent_path")]
            below = rows.select("record", *up, F.posexplode(items).alias("pos", "item"))
            place = [F.col("pos").cast("string")]
            if isinstance(inner, T.ArrayType):
                flat, inner = _flattened(F.col("item"), inner.elementType) if isinstance(inner.elementType, T.ArrayType) else (F.col("item"), inner.elementType)
                below = below.withColumnRenamed("pos", "outer").select("*", F.posexplode(flat).alias("pos", "inner")).withColumn("item", F.col("inner"))
                place = [F.col("outer").cast("string"), F.col("pos").cast("string")]
            below = below.filter(F.col("item").isNotNull())
            dotted = F.concat_ws(".", F.when(F.col("parent_path") != "", F.col("parent_path")), *place)
            own = F.concat_ws("/", F.col("parent_id"), F.lit(pointer), *place)
            below = below.select("record", own.alias("id"), "parent_element", "parent_id", "lineage", "parent_path", F.col("pos").cast("long").alias("pos"), dotted.alias("path"), "item")
            project(below, name, inner, deeper)

    key_text = F.replace(F.replace(F.col(key).cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    none = lambda kind: F.lit(None).cast(kind)
    links = [F.col(key).alias("record"), key_text.alias("id"), none("string").alias("parent_element"), none("string").alias("parent_id"), F.lit("").alias("lineage"), F.lit("").alias("parent_path"), F.lit(0).cast("long").alias("pos")]
    project(df.select(*links, F.lit("").alias("path"), F.struct(*columns).alias("item")), root, schema, "")
    return tables, plan


def first_filled(*columns: Column) -> Column:
    """The first argument that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])
