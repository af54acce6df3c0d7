"""Schemas that drift between files: edit scripts between headers, and one consistent table."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from tickloom.operators.blocks import explode_range

#: Files of one stream that are compared in one task, at most.
BLOCK_FILES = 512
#: Costs of an edit: a keyword or nested field added or removed, a changed value, a changed type, a changed parent.  A value
#: changes from file to file, so that a rename of a single field needs the same one; nested fields may differ in part.
ADD, REMOVE, VALUE, TYPE, MOVE = 1.0, 1.0, 3.0, 3.0, 0.05
#: Keywords of a table of columns, at most; more are no vocabulary.
MOST_COLUMNS = 5000


def kind_of(value) -> str | None:
    """JSON type of a value; numbers are one type and null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(value)]


def subtree_distance(a, b) -> float:
    """Tree edit distance of two values: nested fields are added, removed or changed, elements of arrays in order."""
    if a == b and kind_of(a) == kind_of(b):
        return 0.0
    if kind_of(a) != kind_of(b):
        return TYPE
    if isinstance(a, dict):
        shared = sum(subtree_distance(a[k], b[k]) for k in a.keys() & b.keys())
        return shared + REMOVE * len(a.keys() - b.keys()) + ADD * len(b.keys() - a.keys())
    if isinstance(a, list):
        rows = list(range(len(b) + 1))
        for x in a:
            new = [rows[0] + 1]
            for j, y in enumerate(b):
                new.append(min(rows[j + 1] + REMOVE, new[j] + ADD, rows[j] + subtree_distance(x, y)))
            rows = new
        return float(rows[-1])
    return VALUE


def name_distance(a: str, b: str) -> float:
    """Edit distance of two names over the longer length, 0 to 1: breaks ties between renames."""
    rows = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(rows[j] + 1, new[j - 1] + 1, rows[j - 1] + (x != y)))
        rows = new
    return rows[-1] / max(len(a), len(b), 1)


def assigned(saving: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of the greatest total saving; pairs that save nothing are left out.

    Rows are added one by one along shortest augmenting paths over reduced costs: cubic in the number of rows, for any.
    """
    if not saving.size or saving.max() <= 0:
        return []
    if saving.shape[0] > saving.shape[1]:
        return sorted((i, j) for j, i in assigned(saving.T))
    cost = -np.maximum(saving, 0.0)
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, came, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last, base = i, -1, 0.0
        while at >= 0:
            reduced = base + cost[at] - row_price[at] - col_price
            closer = ~seen & (reduced < least)
            least[closer], came[closer] = reduced[closer], last
            last = int(np.argmin(np.where(seen, np.inf, least)))
            base, seen[last] = least[last], True
            at = row_of[last]
        row_price[i] += base
        used = seen & (row_of >= 0)
        row_price[row_of[used]] += base - least[used]
        col_price[seen] -= base - least[seen]
        while last >= 0:  # along the path every row moves to the next column
            before = came[last]
            row_of[last] = row_of[before] if before >= 0 else i
            last = before
    return sorted((int(r), j) for j, r in enumerate(row_of) if r >= 0 and saving[r, j] > 0)


def _below(path: tuple[str, ...], value) -> Iterator[tuple[tuple[str, ...], object]]:
    """Paths and values of all fields inside a value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield (*path, k), v
            yield from _below((*path, k), v)


def _paired(gone: dict[tuple, object], new: dict[tuple, object]) -> list[tuple[tuple, tuple]]:
    """Pairs of paths of a cheapest edit script between fields that went and fields that came.

    A pair costs the distance of the values, less than one for the names, and MOVE if the parent changes; it is in the script
    where that is cheaper than removing one field and adding the other.  Null values match nothing.
    """
    old, fresh = (sorted(k for k, v in d.items() if v is not None) for d in (gone, new))
    saving = np.zeros((len(old), len(fresh)))
    for (i, a), (j, b) in itertools.product(enumerate(old), enumerate(fresh)):
        far = subtree_distance(gone[a], new[b])
        if far < ADD + REMOVE:
            saving[i, j] = ADD + REMOVE - 0.1 - far - 0.9 * name_distance(a[-1], b[-1]) - MOVE * (a[:-1] != b[:-1])
    return [(old[i], fresh[j]) for i, j in assigned(saving)]


def pair_renames(gone: dict, new: dict) -> list[tuple[str, str]]:
    """Renames of a cheapest edit script between keywords of one header: (old name, new name)."""
    return [(a[0], b[0]) for a, b in _paired({(k,): v for k, v in gone.items()}, {(k,): v for k, v in new.items()})]


def edit_script(before: dict, now: dict, last: dict | None = None) -> list[tuple[str, str, str | None]]:
    """Cheapest script between two headers as trees: (field, kind, other name), fields as dotted paths.

    Kinds: added, removed, renamed (another name under the same parent), moved (to another parent, also into or out of a
    field that came or went as a whole), retyped.  ``last`` has the last non-null values of keywords that are null in
    ``before``.  A null has no type.
    """
    last = last or {}
    gone: dict[tuple, object] = {}
    new: dict[tuple, object] = {}
    out: list[tuple[str, str, str | None]] = []

    def compare(a: dict, b: dict, path: tuple) -> None:
        was = lambda k: a[k] if a[k] is not None or path else last.get(k)
        gone.update(((*path, k), was(k)) for k in a.keys() - b.keys())
        new.update(((*path, k), b[k]) for k in b.keys() - a.keys())
        for k in sorted(a.keys() & b.keys()):
            if b[k] is not None and was(k) is not None and kind_of(b[k]) != kind_of(was(k)):
                out.append((".".join((*path, k)), "retyped", None))
            elif isinstance(a[k], dict) and isinstance(b[k], dict):
                compare(a[k], b[k], (*path, k))

    compare(before, now, ())
    pairs = _paired(gone, new)
    for a, b in pairs:
        gone.pop(a), new.pop(b)
    # What is left may have moved into or out of fields that came or went as a whole.
    into = _paired(gone, {q: v for p, x in new.items() for q, v in _below(p, x)})
    out_of = _paired({q: v for p, x in gone.items() if p not in dict(into) for q, v in _below(p, x)}, new)
    pairs += into + out_of
    out += [(".".join(a), "renamed" if a[:-1] == b[:-1] else "moved", ".".join(b)) for a, b in pairs]
    out += [(".".join(p), "removed", None) for p in sorted(gone.keys() - dict(into).keys())]
    return out + [(".".join(p), "added", None) for p in sorted(new.keys() - {b for _, b in out_of})]


def header(text: str | None) -> dict | None:
    """Keywords in upper case; null for a text that isn't a JSON object. Of equal names the last non-null value counts."""
    try:
        pairs = json.loads(text, object_pairs_hook=lambda p: _Pairs(p))
    except (TypeError, ValueError):
        return None
    if not isinstance(pairs, _Pairs):
        return None
    out: dict = {}
    for k, v in pairs:
        v = _plain(v)
        if v is not None or k.upper() not in out:
            out[k.upper()] = v
    return out


class _Pairs(list):
    """Items of a JSON object in their order."""


def _plain(v):
    if isinstance(v, _Pairs):
        return {k: _plain(x) for k, x in v}
    return [_plain(x) for x in v] if isinstance(v, list) else v


CHANGES = "file_id bigint, stream string, seq bigint, field_name string, change_kind string, other_name string"


def _changes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edit scripts of whole blocks from sorted batches.

    A block's rows: first what it inherits (seq -1: the last non-null values of the stream, and the file before it), then
    its files in order.
    """
    at, before, last = None, None, {}
    for part in parts:
        out = []
        for file_id, stream, block, seq, text, inherited in zip(part["file_id"], part["stream"], part["block"], part["seq"], part["header_json"], part["inherited"]):
            if at != (stream, block):
                at, before, last = (stream, block), None, {}
            if inherited:
                last = {k: json.loads(v) for k, v in json.loads(text or "{}").items()} if inherited == 1 else last
                before = header(text) if inherited == 2 else before
                continue
            now = header(text)
            if now is None:
                continue
            if before is not None:
                out += [(file_id, stream, seq, k, kind, other) for k, kind, other in edit_script(before, now, last)]
            last.update((k, v) for k, v in now.items() if v is not None)
            before = now
        yield pd.DataFrame(out, columns=["file_id", "stream", "seq", "field_name", "change_kind", "other_name"])


@F.pandas_udf(MapType(StringType(), StringType()))
def _non_null(texts: pd.Series) -> pd.Series:
    """Non-null keywords of a header as JSON texts."""
    return texts.map(lambda t: {k: json.dumps(v) for k, v in (header(t) or {}).items() if v is not None})


def schema_changes(files: DataFrame) -> DataFrame:
    """Changes of every file's keywords against the file before it in its stream.

    ``files``: file_id, stream, seq, header_json.  Consecutive headers are compared as trees: the cheapest script of
    adding, removing, renaming and moving gives the changes (see edit_script), where a rename needs the same value under the
    new name (a split or join of keywords has other values, and so is removed and added).  A keyword is retyped if its JSON type differs from
    that of its last non-null value.  Streams are cut into blocks of files that are compared independently; each inherits
    the header before it and the last non-null values.

    Names are compared and reported in upper case; key order means nothing; a repeated file_id counts once; files whose
    header is null or no JSON object, or whose stream or seq is null, are skipped; the first file of a stream has no
    changes.  Output: file_id, stream, seq, field_name, change_kind (added, removed, renamed, moved, retyped),
    other_name (the new name of a renamed or moved field).
    """
    rows = files.select("file_id", "stream", F.col("seq").cast("long").alias("seq"), "header_json").where("stream is not null and seq is not null and get_json_object(header_json, '$') like '{%'").dropDuplicates(["file_id"])
    rows = rows.withColumn("block", F.expr(f"seq div {BLOCK_FILES}"))
    size = rows.groupBy("stream", "block").agg(F.max_by("header_json", F.struct("seq", "file_id")).alias("final"))
    w = Window.partitionBy("stream").orderBy("block")
    final = size.select("stream", "block", F.lag("final").over(w).alias("header_json")).where("header_json is not null").select(F.lit(None).cast("long").alias("file_id"), "stream", F.lit(-1).cast("long").alias("seq"), "header_json", "block", F.lit(2).alias("inherited"))
    # Last non-null value of every field at the end of each block: only of streams that have more than one.
    long_ones = size.groupBy("stream").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1").select("stream")
    fields = rows.join(long_ones, "stream", "left_semi").select("stream", "block", "seq", "file_id", F.explode(_non_null("header_json")).alias("k", "v"))
    latest = fields.groupBy("stream", "k", "block").agg(F.max_by("v", F.struct("seq", "file_id")).alias("v"))
    blocks = size.join(long_ones, "stream", "left_semi").select("stream", "block")
    names = latest.select("stream", "k").distinct()
    every = blocks.join(names, "stream").join(latest, ["stream", "block", "k"], "left")
    carried = every.select("stream", "block", "k", F.last("v", True).over(Window.partitionBy("stream", "k").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("v")).where("v is not null")
    state = carried.groupBy("stream", "block").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("header_json")).select(F.lit(None).cast("long").alias("file_id"), "stream", F.lit(-2).cast("long").alias("seq"), "header_json", "block", F.lit(1).alias("inherited"))
    whole = rows.withColumn("inherited", F.lit(0)).unionByName(final).unionByName(state)
    return whole.repartition("stream", "block").sortWithinPartitions("stream", "block", "seq", "file_id").mapInPandas(_changes, CHANGES)


def canonical_names(changes: DataFrame, support: int = 2, most: int = 10_000) -> dict[str, str]:
    """Name under which every renamed field goes in the consistent table: the alphabetically first of those it was renamed to or from.

    Renames are counted over all files; pairs seen in fewer than ``support`` files are left
    apart here, as they may be chance (stream_names has them for their own stream).  The graph has one
    node for each distinct keyword name, which is bounded by the vocabulary; more than ``most`` pairs raise an error.
    """
    pairs = changes.where("change_kind = 'renamed'").groupBy("field_name", "other_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).limit(most + 1).collect()
    if len(pairs) > most:
        raise ValueError("more distinct renames than a vocabulary of keywords has")
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    weight: dict[str, int] = {}
    for r in pairs:
        weight[r["field_name"]] = weight.get(r["field_name"], 0) + r["n"]
        a, b = find(r["field_name"]), find(r["other_name"])
        if a != b:
            root[max(a, b)] = min(a, b)
    groups: dict[str, list[str]] = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    # The name most often renamed away from is the original one.
    return {x: min(g, key=lambda y: (-weight.get(y, 0), y)) for g in groups.values() for x in g}


SPANS = "stream string, chain bigint, name string, from_seq bigint, from_file bigint, to_seq bigint, to_file bigint"


def _spans(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which chain of renames every name of a stream belongs to, and from which file until before which (null: no end).

    Rows: the renames of whole streams in their order.  Held are the chains of one stream that have a name just then.
    """
    at, held, ended, n = None, {}, {}, 0

    def closed():
        return [(at, c, k, *begin, None, None) for k, (c, begin) in held.items()]

    for part in parts:
        out = []
        for stream, seq, file_id, old, new in zip(part["stream"], part["seq"], part["file_id"], part["field_name"], part["other_name"]):
            if stream != at:
                out += closed()
                at, held, ended, n = stream, {}, {}, 0
            # A name that came back after it was renamed away is another field from there on.
            chain, begin = held.pop(old, (None, ended.get(old, (None, None))))
            if chain is None:
                chain, n = n, n + 1
            out.append((at, chain, old, *begin, seq, file_id))
            ended[old] = (seq, file_id)
            if new in held:
                c, since = held.pop(new)
                out.append((at, c, new, *since, seq, file_id))
            held[new] = (chain, (seq, file_id))
        yield _as_spans(out)
    yield _as_spans(closed())


def _as_spans(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["stream", "chain", "name", "from_seq", "from_file", "to_seq", "to_file"])
    return out.astype({c: "Int64" for c in ("chain", "from_seq", "from_file", "to_seq", "to_file")})


def stream_names(changes: DataFrame, names: dict[str, str]) -> DataFrame:
    """Names of renamed fields in the files of their stream: every rename counts, in its stream and from its file on.

    A field keeps its identity through all its renames, also over several (A to B, later B to C).  Its name in the table is
    that of its names, taken through ``names``, which was most often renamed away from in all streams, then the
    alphabetically first.  Renames of one stream are followed in one task; they are few beside its files.

    Output: stream, name, target, from_seq, from_file (first file that has it; null from the beginning), to_seq, to_file
    (first file behind; null without end).
    """
    renames = changes.where("change_kind = 'renamed'").select("stream", "seq", "file_id", "field_name", "other_name")
    spans = renames.repartition("stream").sortWithinPartitions("stream", "seq", "file_id").mapInPandas(_spans, SPANS).checkpoint()
    known = changes.sparkSession.createDataFrame([*names.items()], "name string, common string")
    through = lambda df: df.join(F.broadcast(known), "name", "left").withColumn("common", F.coalesce("common", "name"))
    away = through(renames.select(F.col("field_name").alias("name"))).groupBy("common").agg(F.count(F.lit(1)).alias("n"))
    chosen = through(spans.select("stream", "chain", "name").distinct()).join(away, "common", "left")
    chosen = chosen.groupBy("stream", "chain").agg(F.min(F.struct(-F.coalesce("n", F.lit(0)), "common"))["common"].alias("target"))
    return spans.join(chosen, ["stream", "chain"]).select("stream", "name", "target", "from_seq", "from_file", "to_seq", "to_file")


def _with_own_names(files: DataFrame, own: DataFrame) -> DataFrame:
    """Files with ``renamed``, the map of the names that hold in that file of its stream.

    Names are handed to the blocks of files they reach into, so that a block has those of its own files only.
    """
    block = lambda c: F.expr(f"{c} div {BLOCK_FILES}")
    placed = files.withColumn("block", block("seq"))
    w = Window.partitionBy("stream").orderBy("block")
    blocks = placed.where("stream is not null and block is not null").select("stream", "block").distinct().withColumn("at", F.row_number().over(w))
    edge = lambda b, at: blocks.select("stream", F.col("block").alias(b), F.col("at").alias(at))
    own = own.withColumns({"b0": block("from_seq"), "b1": block("to_seq")}).join(edge("b0", "lo"), ["stream", "b0"], "left").join(edge("b1", "hi"), ["stream", "b1"], "left")
    own = own.join(blocks.groupBy("stream").agg(F.max("at").alias("n")), "stream")
    each = explode_range(own, F.coalesce("lo", F.lit(1)), F.coalesce("hi", "n"), "at").join(blocks, ["stream", "at"])
    each = each.groupBy("stream", "block").agg(F.collect_list(F.struct("name", "target", "from_seq", "from_file", "to_seq", "to_file")).alias("own"))
    here = F.struct("seq", "file_id")
    holds = lambda r: (r["from_seq"].isNull() | (here >= F.struct(r["from_seq"], r["from_file"]))) & (r["to_seq"].isNull() | (here < F.struct(r["to_seq"], r["to_file"])))
    names = F.map_from_entries(F.transform(F.filter("own", holds), lambda r: F.struct(r["name"], r["target"])))
    return placed.join(each, ["stream", "block"], "left").withColumn("renamed", names).drop("own", "block")


def unified(files: DataFrame, names: dict[str, str], own: DataFrame | None = None) -> DataFrame:
    """One consistent table: the edit scripts compiled into one projection that every file goes through.

    ``own`` (stream_names) has the names that hold in some files of a stream only; they go before ``names``.  Where two
    keywords of a file would have one name, that which has it already keeps it, then that of ``own``, and the other stays
    under its own name: no value is lost.

    Output: file_id, stream, seq, fields (map of canonical keyword to text; strings as they are, other values as JSON).
    """

    @F.pandas_udf("map<string,string>")
    def project(texts: pd.Series, renamed: pd.Series) -> pd.Series:
        def one(t, here):
            here = dict(here) if here is not None else {}
            out = {}
            fields = {k: v for k, v in (header(t) or {}).items() if v is not None}
            target = {k: here.get(k, names.get(k, k)) for k in fields}
            for k in sorted(fields, key=lambda k: (target[k] != k, k not in here, k)):
                name = target[k] if target[k] not in out else k
                while name in out:
                    name += "_"
                out[name] = fields[k] if isinstance(fields[k], str) else json.dumps(fields[k])
            return out

        return pd.Series([one(t, h) for t, h in zip(texts, renamed)], dtype=object)

    rows = files.select("file_id", "stream", F.col("seq").cast("long").alias("__seq"), "seq", "header_json").dropDuplicates(["file_id"])
    if own is None:
        rows = rows.withColumn("renamed", F.lit(None).cast("map<string,string>"))
    else:
        rows = _with_own_names(rows.withColumnsRenamed({"seq": "__as", "__seq": "seq"}), own).withColumnsRenamed({"seq": "__seq", "__as": "seq"})
    return rows.select("file_id", "stream", "seq", project("header_json", "renamed").alias("fields"))


def typed_columns(table: DataFrame, prefix: str = "kw_", most: int = MOST_COLUMNS) -> DataFrame:
    """The fields of ``unified`` as columns of one type each: a number where at least half of a field's values are, else text.

    Values of a numeric field that are no number aren't lost: they stand in ``unparsed`` (a map).  Columns are in the order
    of their names; more than ``most`` of them raise an error.
    """
    kinds = table.select(F.explode("fields").alias("k", "v")).groupBy("k").agg(F.count("v").alias("n"), F.count(F.col("v").try_cast("double")).alias("m")).limit(most + 1).collect()
    if len(kinds) > most:
        raise ValueError("more distinct keywords than a table has columns")
    numeric = {r["k"]: 2 * r["m"] >= r["n"] for r in kinds}
    value = lambda k: F.try_element_at("fields", F.lit(k))
    columns = [(value(k).try_cast("double") if numeric[k] else value(k)).alias(prefix + k) for k in sorted(numeric)]
    numbers = [k for k in sorted(numeric) if numeric[k]]
    left = F.map_filter("fields", lambda k, v: k.isin(numbers) & v.isNotNull() & v.try_cast("double").isNull())
    return table.select("file_id", "stream", "seq", *columns, left.alias("unparsed"))
