"""Deeply nested semi-structured records as related flat tables.

1. `infer` walks all bodies once and merges their schemas: every path with the kinds of values met there, combined in each task before the
   shuffle. Paths that hold an array somewhere are levels; each level, however deep, becomes a child table. Objects between levels become
   prefixed columns of the level they are in; objects of more fields than a record may have are maps, and levels of their own.
2. `flat_table` walks down to one level, a narrow pass without a shuffle: every array on the way is exploded, each row carries its own surrogate
   key, that of its parent, its ordinal and those of its ancestors, and a typed column for each scalar of the merged schema.

Writers differ in habits, which are evened out at every level: a container may be an array, an object keyed by number, one bare element, or any of
these written as a JSON string; null elements count as places but give no row. `Habits` names what cannot be inferred: envelopes around an
element, the field with an element's own number, groups into which a list is split.

Walking is Python on Arrow batches, as no built-in function descends into a schema that is only known from the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Path = tuple[str, ...]
#: Name of the level within an array of arrays.
ITEM = "item"
#: Fields from which an object is a map rather than a record.
MAX_FIELDS = 2_000
#: Output rows of a batch.
ROWS = 10_000

_NUMBER = re.compile(r"\s*[0-9]{1,9}\s*\Z")
_JSON = re.compile(r'\s*[\[{"]')
TYPES = {"boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


class Habits(NamedTuple):
    """What is known of the writers, by path; the root is ().

    names: of tables, the path otherwise. envelopes: paths of wrapper objects around an element, the first that is there counts; its other fields
    stay. numbers: scalar field with the element's own number, which goes before its key, which goes before its place. groups: field of the
    parent whose objects each hold a part of the list, where it has no list itself. quoted: paths whose elements may be JSON written as a string.
    bare: column of elements that are no objects.
    """

    names: dict[Path, str] = {}
    envelopes: dict[Path, tuple[Path, ...]] = {}
    numbers: dict[Path, str] = {}
    groups: dict[Path, str] = {}
    quoted: frozenset[Path] = frozenset()
    bare: dict[Path, str] = {}

    def name(self, path: Path) -> str:
        return self.names.get(path) or "_".join(path) or "record"


class Schema(NamedTuple):
    """levels: path -> columns (path below the level, name, type). maps: those levels whose objects are keyed by any name."""

    levels: dict[Path, tuple[tuple[Path, str, str], ...]]
    maps: frozenset[Path]


def _reject(constant: str) -> None:
    raise ValueError(constant)


def parsed(text: str | None) -> Any:
    """The value of a JSON text; None where it is null, unreadable or nested beyond what can be read."""
    if not text:
        return None
    try:
        return json.loads(text, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None


def unquoted(v: Any) -> Any:
    """The value within a JSON string that itself is JSON, once or twice; other values as they are."""
    for _ in range(2):
        if not isinstance(v, str) or not _JSON.match(v) or (w := parsed(v)) is None:
            return v
        v = w
    return v


def numbered(v: Any) -> bool:
    return isinstance(v, dict) and bool(v) and all(map(_NUMBER.match, v))


def items(v: Any, is_map: bool = False) -> Iterator[tuple[int, str | None, Any]]:
    """(place from 1, key, element) of a container; a bare element is the only one."""
    v = unquoted(v)
    if isinstance(v, list):
        yield from ((i, None, x) for i, x in enumerate(v, 1))
    elif is_map and isinstance(v, dict) or numbered(v):
        yield from ((i, k, x) for i, (k, x) in enumerate(v.items(), 1))
    elif v is not None:
        yield 1, None, v


def element(v: Any, path: Path, habits: Habits) -> tuple[Any, int | None]:
    """An element in its ordinary form, and its own number."""
    if path in habits.quoted:
        v = unquoted(v)
    if not isinstance(v, dict):
        return v, None
    field = habits.numbers.get(path)
    number = _integer(v.get(field)) if field else None
    for envelope in habits.envelopes.get(path, ()):
        inner: Any = v
        for name in envelope:
            inner = inner.get(name) if isinstance(inner, dict) else None
        if isinstance(inner, dict):
            v = _merged(inner, v, envelope)
            break
    if field and number is None:
        number = _integer(v.get(field))
    for child, group in habits.groups.items():
        if child[:-1] == path and v.get(child[-1]) is None and isinstance(v.get(group), list):
            groups = v[group]
            parts = [g.get(child[-1]) for g in groups if isinstance(g, dict)]
            v = {**v, child[-1]: [x for p in parts if isinstance(p, list) for x in p], group: [{k: x for k, x in g.items() if k != child[-1]} if isinstance(g, dict) else g for g in groups]}
    return v, number


def _merged(inner: dict, outer: dict, envelope: Path) -> dict:
    """The inner object with the other fields of its envelope; where both have a field, the envelope's is called `outer_`."""
    rest = dict(outer)
    at = rest
    for name in envelope[:-1]:
        at[name] = dict(at[name])
        at = at[name]
    at.pop(envelope[-1])
    out = dict(inner)
    for k, x in rest.items():
        if x == {}:
            continue
        out[k if k not in out or out[k] == x else f"outer_{k}"] = x
    return out


def _integer(v: Any) -> int | None:
    if isinstance(v, bool) or v is None:
        return None
    try:
        n = int(v)
    except (TypeError, ValueError):
        return None
    return n if n == v or isinstance(v, str) and -(2**31) <= n < 2**31 else None


def _kind(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "bigint" if -(2**63) <= v < 2**63 else "string"
    return "double" if isinstance(v, float) else "string"


class Notes:
    """Kinds of values by path. A note under a quoted value counts only if its path holds containers elsewhere, which is seen when all are merged."""

    def __init__(self, habits: Habits) -> None:
        self.habits, self.seen, self.fields = habits, set(), {}

    def container(self, v: Any, path: Path, quoted: Path | None) -> None:
        if isinstance(v, list):
            self.seen.add((path, "array", quoted))
        elif numbered(v):
            self.seen.add((path, "array", quoted))
            v = list(v.values())
        else:
            v = [v]
        for x in v:
            if x is not None:
                self.element(x, path, quoted)

    def element(self, x: Any, path: Path, quoted: Path | None) -> None:
        x, _ = element(x, path, self.habits)
        if isinstance(x, dict):
            self.record(x, path, quoted)
        elif isinstance(x, list):
            self.container(x, (*path, ITEM), quoted)
        else:
            self.seen.add((path, _kind(x), quoted))

    def record(self, x: dict, path: Path, quoted: Path | None) -> None:
        self.seen.add((path, "object", quoted))
        names = self.fields.setdefault(path, set())
        names.update(x)
        if len(names) > MAX_FIELDS:
            self.seen.add((path, "map", quoted))
        wide = len(names) > MAX_FIELDS
        for k, v in x.items():
            at = (*path, "*" if wide else k)
            if isinstance(v, str):
                if at not in self.habits.bare and _JSON.match(v) and isinstance(w := unquoted(v), list | dict):
                    self.container(w, at, quoted or at)
                    self.seen.add((at, "json", quoted))
                else:
                    self.seen.add((at, "string", quoted))
            elif isinstance(v, list | dict):
                self.container(v, at, quoted)
            else:
                self.seen.add((at, _kind(v), quoted))


def infer(records: DataFrame, body: str, habits: Habits) -> Schema:
    """The merged schema of all bodies, in one pass. What is collected is bounded by the number of different paths of records."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(habits)
        for b in batches:
            for text in b.column(0).to_pylist():
                if (v := parsed(text)) is not None:
                    v = unquoted(v)
                    notes.container(v, (), None)
        got = [(json.dumps(p), k, json.dumps(q) if q is not None else None) for p, k, q in notes.seen]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got, strict=True)], names=["path", "kind", "quoted"])

    rows = records.select(body).mapInArrow(walk, "path string, kind string, quoted string").distinct().collect()
    return merge([(tuple(json.loads(r["path"])), r["kind"], tuple(json.loads(r["quoted"])) if r["quoted"] else None) for r in rows], habits)


def merge(notes: list[tuple[Path, str, Path | None]], habits: Habits) -> Schema:
    """The schema that holds every value met: bigint < double < string."""
    kinds: dict[Path, set[str]] = {(): {"array"}}
    for path, kind, quoted in sorted(notes, key=lambda n: (n[2] is not None, len(n[2] or ()), n[0], n[1])):
        if quoted is None or kinds.get(quoted, set()) & {"array", "object"} or quoted in habits.quoted:
            kinds.setdefault(path, set()).add(kind)
    children: dict[Path, int] = {}
    for path in kinds:
        children[path[:-1]] = children.get(path[:-1], 0) + bool(path)
    maps = {p for p, have in kinds.items() if "map" in have or "object" in have and children.get(p, 0) > MAX_FIELDS}
    for path in [p for p in kinds if any(p[:i] in maps for i in range(1, len(p)))]:  # fields of a map are its elements
        at = min((p for p in maps if path[: len(p)] == p), key=len)
        kinds.setdefault((*at, *path[len(at) + 1 :]), set()).update(kinds.pop(path))
    levels = {p for p, have in kinds.items() if "array" in have or p in maps}
    made: dict[Path, tuple[tuple[Path, str, str], ...]] = {}
    for level in sorted(levels):
        columns, taken = [], {"ordinal", "parent_key", "key"}
        for path in sorted(kinds, key=lambda p: (p != level, p)):
            if path[: len(level)] != level or path != level and any(path[:i] in levels for i in range(len(level) + 1, len(path) + 1)):
                continue
            have = {"string" if k == "json" else k for k in kinds[path] if k != "json" or not kinds[path] & {"array", "object"}} - {"array", "object", "map"}
            if not have or path == level and (have == {"null"} or not level):
                continue
            name = "_".join(path[len(level) :]) or habits.bare.get(level, "value")
            if path == level and (*level, name) in kinds:
                kinds[(*level, name)] |= have  # bare elements go into the column of that field
                continue
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            have -= {"null"}
            kind = have.pop() if len(have) == 1 else "double" if have and have <= {"bigint", "double"} else "string"
            columns.append((path[len(level) :], name, kind))
        made[level] = tuple(columns)
    return Schema(made, frozenset(maps))


def _text(v: Any) -> str | None:
    if isinstance(v, str):
        return v
    return None if v is None or isinstance(v, list | dict) else json.dumps(v)


def _whole(s: str | None) -> str | None:
    """The text with replacement characters for halves of surrogate pairs, which no table can hold."""
    return s if s is None or s.isascii() else s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _as(kind: str) -> Callable[[Any], Any]:
    if kind == "string":
        return lambda v: _whole(_text(v))
    if kind == "double":
        return lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None
    if kind == "bigint":
        return lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    return lambda v: v if isinstance(v, bool) else None


def _below(x: Any, path: Path, bare: bool) -> Any:
    if not path:
        return None if isinstance(x, dict | list) else x
    if bare and not isinstance(x, dict | list):
        return x
    for name in path:
        x = unquoted(x) if isinstance(x, str) else x
        x = x.get(name) if isinstance(x, dict) else None
    return x


def walk(body: Any, target: Path, levels: frozenset[Path], maps: frozenset[Path], habits: Habits, root: str) -> Iterator[tuple[str, str, int, tuple[int, ...], str | None, Any]]:
    """(key, parent key, ordinal, ordinals of the ancestors below the root, key in a map, element) of every element of one level."""

    def explode(v: Any, path: Path, key: str, above: tuple[int, ...]) -> Iterator[tuple]:
        label, used = habits.name(path), set()
        is_map = path in maps
        for place, k, x in items(v, is_map):
            if x is None:
                continue
            x, number = element(x, path, habits)
            if x is None or not path and not isinstance(x, dict):
                continue
            by_key = int(k) if k is not None and _NUMBER.match(k) and not is_map else None
            ordinal = number if number is not None else by_key if by_key is not None else place
            own = f"{key}/{label}:{_whole(k.strip()) if k is not None else place}"
            if own in used:
                own = f"{own}~{place}"
            used.add(own)
            if path == target:
                yield own, key, ordinal, above, k if is_map else None, x
            else:
                yield from step(x, path, own, (*above, ordinal) if path else above)

    def step(x: Any, path: Path, key: str, above: tuple[int, ...]) -> Iterator[tuple]:
        name = target[len(path)]
        at = (*path, name)
        if isinstance(x, list):
            y = x if name == ITEM else None
        else:
            x = unquoted(x) if isinstance(x, str) else x
            y = x.get(name) if isinstance(x, dict) else None
        if y is None:
            return
        if at in levels:
            yield from explode(y, at, key, above)
        else:
            yield from step(y, at, key, above)

    yield from explode(body, (), root, ())


def once(records: DataFrame, key: str, body: str) -> DataFrame:
    """(key, body, _root): distinct records with their surrogate root key. Only records whose key comes several times are shuffled with their bodies."""
    kept = records.select(F.col(key).alias("_id"), F.col(body).alias("_body")).where(F.col("_body").isNotNull())
    several = kept.groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_again"))
    same = F.col("_id").eqNullSafe(F.col("_again"))
    root = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    single = kept.join(several, same, "left_anti").withColumn("_root", root)
    place = F.row_number().over(Window.partitionBy("_id").orderBy("_body"))
    double = kept.join(several, same, "left_semi").distinct().withColumn("_n", place)
    double = double.withColumn("_root", F.when(F.col("_n") == 1, root).otherwise(F.concat_ws("~", root, F.col("_n").cast("string")))).drop("_n")
    return single.unionByName(double)


def flat_table(rows: DataFrame, key: str, schema: Schema, path: Path, habits: Habits, columns: bool = True) -> DataFrame:
    """The table of one level: `key`, ordinals of the ancestors (`<table>_no`), `<table>_key`, `parent_key`, `ordinal` and the level's columns. `rows` come from `once`."""
    levels = frozenset(schema.levels)
    above = [p for i in range(1, len(path)) if (p := path[:i]) in levels]
    wanted = schema.levels[path] if columns else ()
    bare = habits.bare.get(path)
    taken = {key, f"{habits.name(path)}_key", "parent_key", "ordinal", *[f"{habits.name(p)}_no" for p in above], *(["entry"] if path in schema.maps else [])}
    names = []
    for _, name, _ in wanted:
        while name.lower() in {t.lower() for t in taken}:
            name = f"_{name}"
        taken.add(name)
        names.append(name)
    makers = [(p, p == () or len(p) == 1 and p[0] == bare, _as(kind)) for p, _, kind in wanted]
    id_type = dict(rows.dtypes)["_id"]
    head = [f"{habits.name(p)}_no" for p in above] + [f"{habits.name(path)}_key", "parent_key", "ordinal"] + (["entry"] if path in schema.maps else [])
    head_types = [pa.int32()] * len(above) + [pa.string(), pa.string(), pa.int32()] + ([pa.string()] if path in schema.maps else [])
    quoted = [f"`{n.replace('`', '``')}`" for n in [*head, *names]]
    spark_types = ["int"] * len(above) + ["string", "string", "int"] + (["string"] if path in schema.maps else []) + [k for _, _, k in wanted]
    ddl = ", ".join([f"`{key}` {id_type}", *[f"{n} {t}" for n, t in zip(quoted, spark_types, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = head_types + [TYPES[k] for _, _, k in wanted]
        is_map = path in schema.maps
        for b in batches:
            ids, at, out = b.column(0), [], []

            def batch(ids: pa.Array, at: list[int], out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=[key, *head, *names])

            for i, (text, root) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (v := parsed(text)) is None:
                    continue
                for own, parent, ordinal, nos, entry, x in walk(v, path, levels, schema.maps, habits, root):
                    at.append(i)
                    out.append((*nos, own, parent, ordinal, *((entry,) if is_map else ()), *[f(_below(x, p, plain)) for p, plain, f in makers]))
                if len(out) >= ROWS:
                    yield batch(ids, at, out)
                    at, out = [], []
            if out:
                yield batch(ids, at, out)

    return rows.select("_id", "_body", "_root").mapInArrow(run, ddl)


def flatten(records: DataFrame, key: str, body: str, habits: Habits = Habits(), only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flat tables of nested records by name, or those named in `only`.

    Null, empty and unreadable bodies give no row in any table. Repeated records count once; records of one key with different bodies each
    count, with keys of their own. `key` is carried into every table; other columns of `records`, whatever their names, play no part.
    """
    schema = infer(records, body, habits)
    rows = once(records, key, body)
    return {habits.name(p): flat_table(rows, key, schema, p, habits) for p in schema.levels if not only or habits.name(p) in only}


#: The habits of the writers of job dumps.
DUMPS = Habits(
    names={(): "job", ("pages",): "page", ("pages", "lines"): "line"}, envelopes={(): (("payload", "job"), ("job",)), ("pages",): (("result",),)},
    numbers={("pages",): "page"}, groups={("pages", "lines"): "blocks"}, quoted=frozenset({(), ("pages",)}), bare={("pages", "lines"): "text"},
)


def flatten_dumps(dumps: DataFrame, only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Tables `job`, `page`, `line` and those of all other arrays of job dumps, keyed to their parents."""
    return flatten(dumps, "dump_id", "body", DUMPS, only)


def found_lines(dumps: DataFrame) -> DataFrame:
    """Distinct (dump_id, page_no, line_no) of all line records. No line anywhere gives no row."""
    schema = infer(dumps, "body", DUMPS)
    lines = ("pages", "lines")
    if lines not in schema.levels:
        return dumps.select("dump_id", F.lit(0).alias("page_no"), F.lit(0).alias("line_no")).where(F.lit(False))
    kept = dumps.select(F.col("dump_id").alias("_id"), F.col("body").alias("_body"), F.lit("").alias("_root")).where(F.col("_body").isNotNull())
    return flat_table(kept, "dump_id", schema, lines, DUMPS, columns=False).select("dump_id", "page_no", F.col("ordinal").alias("line_no")).distinct()
