"""The dataflow vocabulary: routes, batches, ordered collection, keyed state and document edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def route(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str = "other", into: str = "route") -> DataFrame:
    """Names the first rule that holds for each row; a rule that is null does not hold."""
    c = F
    for name, rule in rules:
        c = c.when(F.coalesce(rule, F.lit(False)), F.lit(name))
    return df.withColumn(into, c.otherwise(F.lit(otherwise)))


def split_two(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which the rule holds, and all others (null included)."""
    yes = F.coalesce(rule, F.lit(False))
    return df.where(yes), df.where(~yes)


def batch_rows(df: DataFrame, size: int, by: list[str], order: list[str]) -> DataFrame:
    """``batch`` and ``place`` of each row within its group, for batches of ``size`` in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(n / F.lit(size)).cast("bigint")).withColumn("place", n % size)


def first_per(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def last_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The last ``n`` rows of each group; ``order`` has the latest first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def collect_in_order(df: DataFrame, by: list[str], order: str, value: str, into: str) -> DataFrame:
    """One array per group, in the order given."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.transform(pairs, lambda p: p.v).alias(into))


def latest_per_key(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The latest values of each key: keyed state as a batch."""
    o = F.struct(*order)
    return df.groupBy(*by).agg(*[F.max_by(F.col(v), o).alias(v) for v in values])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def union_first_wins(frames: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """For each key the first row of the first frame that has it."""
    every = None
    for k, df in enumerate(frames):
        df = df.withColumn("_frame", F.lit(k))
        every = df if every is None else every.unionByName(df)
    return first_per(every, key, ["_frame", *order]).drop("_frame")


def dedupe_copies(files: DataFrame, by: list[str]) -> DataFrame:
    """Copy variants of a file: of names alike but for a mark of copying, the newest, largest, best by extension, last by name.

    Only groups that hold a marked name lose rows.
    """
    mark = r"[\s._-]*(copy|копия)(\s*\(\d+\)|\s*\d+)?$"
    stem = F.lower(F.trim(F.regexp_replace("file_name", r"\.[^.]*$", "")))
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    rank = F.when(ext == "txt", 3).when(ext == "srt", 2).when(ext == "vtt", 1).otherwise(0)
    df = files.withColumns({"_stem": F.trim(F.regexp_replace(stem, mark, "")), "_marked": stem.rlike(mark), "_rank": rank})
    group = Window.partitionBy(*by, "_stem")
    best = group.orderBy(F.desc("mtime"), F.desc("size"), F.desc("_rank"), F.lower(F.col("file_name")).desc())
    df = df.withColumns({"_any": F.max("_marked").over(group), "_n": F.row_number().over(best)})
    return df.where("not _any or _n = 1").drop("_stem", "_marked", "_rank", "_any", "_n")


def select_named(files: DataFrame, by: list[str], wanted: str, auto: str, order: list) -> DataFrame:
    """The files to read of each group, by the columns ``wanted`` and ``auto``, which hold names and are the same throughout a group.

    A wanted name selects the first file in ``order`` of that name, else of
    that stem, in any case of letters; where neither is there, all files stay.
    Without one (null or blank), the best file named ``auto`` is taken, or
    copy variants are dropped as by :func:`dedupe_copies`.
    """
    name, stem = F.lower("file_name"), F.lower(F.regexp_replace("file_name", r"\.[^.]*$", ""))
    w = F.lower(F.trim(F.col(wanted)))
    group = Window.partitionBy(*by)
    given = F.coalesce(w != "", F.lit(False))
    level = F.when(given, F.when(name == w, 0).when(stem == w, 1)).when(name == F.lower(F.trim(F.col(auto))), 0)
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    rank = F.when(ext == "txt", 3).when(ext == "srt", 2).when(ext == "vtt", 1).otherwise(0)
    best = F.when(given, F.lit(0)).otherwise(F.col("mtime"))
    df = files.withColumns({"_given": given, "_level": level, "_found": F.min(level).over(group)})
    first = group.orderBy(F.asc_nulls_last("_level"), F.desc(best), F.when(F.col("_given"), 0).otherwise(F.col("size")).desc(), F.when(F.col("_given"), 0).otherwise(rank).desc(), *order)
    df = df.withColumn("_place", F.row_number().over(first))
    plain = dedupe_copies(df.where("_found is null and not _given"), by)
    return df.where("(_found is not null and _place = 1) or (_found is null and _given)").unionByName(plain).drop("_given", "_level", "_found", "_place")


def locate_first(files: DataFrame, by: list[str], exact: Column, order: list) -> DataFrame:
    """One file of each group: that of the exact name, else the first in ``order``."""
    return first_per(files, by, [F.coalesce(F.col("file_name") == exact, F.lit(False)).desc(), *order])


def parse_pins(lines: DataFrame, line: str = "line") -> DataFrame:
    """``package`` and ``version`` of every line ``name==version``; blank lines and those that begin with # go, any other raises."""
    t = F.trim(F.col(line))
    rows = lines.where((t != "") & ~t.startswith("#"))
    at = F.instr(t, "==")
    name = F.when(at == 0, F.raise_error(F.concat(F.lit("not an exact pin: "), t))).otherwise(F.trim(F.substring(t, F.lit(1), at - 1)))
    return rows.withColumns({"package": name, "version": F.trim(F.substring(t, at + 2, F.length(t)))})


def pin_mismatches(pins: DataFrame, installed: DataFrame) -> DataFrame:
    """Pins (package, version) that ``installed`` (package, version) does not meet, each with a text that says how."""
    have = installed.select(F.col("package").alias("_package"), F.col("version").alias("_version"))
    j = pins.join(have, F.col("package") == F.col("_package"), "left").where("_package is null or not version <=> _version")
    how = F.when(F.col("_package").isNull(), "missing").otherwise(F.concat(F.lit("installed: "), F.coalesce("_version", F.lit("none"))))
    return j.withColumn("mismatch", F.concat("package", F.lit("=="), "version", F.lit(" ("), how, F.lit(")"))).drop("_package", "_version")


def spanning(df: DataFrame, by: list[str], value: str, into: str = "spans") -> DataFrame:
    """Whether a group's rows have more than one value; nulls do not count."""
    return df.groupBy(*by).agg((F.coalesce(F.min(value) != F.max(value), F.lit(False))).alias(into))


def elapsed_between(messages, first: int = 0, last: int = 2, field: str = "ts"):
    """Difference of a field between two messages of an array, by their places from 0; null where either is not there."""
    return F.get(messages, last)[field] - F.get(messages, first)[field]


def validate(df: DataFrame, reasons: dict[str, Column], into: str = "reasons") -> DataFrame:
    """Names of the checks that fail, in order, and ``ok`` where there are none."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in reasons.items()]))
    return df.withColumn(into, failed).withColumn("ok", F.size(into) == 0)


def graph_apply(nodes: DataFrame, edges: DataFrame, actions: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Edits, in order, of nodes (graph, id) and edges (graph, to_id, input, from_id, output).

    ``add``: id (a text, digits with an optional second part behind a colon;
    or none: the next number of the graph), overwrite. ``connect``: to,
    input, from, output; replaces the input's edge where both nodes exist.
    ``disconnect``: to, input, from, output; those given select. ``remove``:
    id; its edges go on both sides. A bad id or an empty selection raises.
    """
    import re

    for a in actions:
        kind = a["type"]
        given = [a[k] for k in ("id", "to", "from") if a.get(k) is not None]
        if bad := [i for i in given if not re.fullmatch(r"\d+(:\d+)?", str(i))]:
            raise ValueError(f"not a node id: {bad[0]}")
        if kind == "add":
            new = nodes.groupBy("graph").agg(F.coalesce(F.max(F.col("id").try_cast("bigint")) + 1, F.lit(1)).cast("string").alias("id"))
            if a.get("id") is not None:
                new = nodes.select("graph").distinct().withColumn("id", F.lit(str(a["id"])))
                if not a.get("overwrite"):
                    taken = nodes.where(F.col("id") == str(a["id"]))
                    new = new.join(taken.select("graph"), "graph", "left_anti")
            for c in nodes.columns:
                if c not in ("graph", "id"):
                    new = new.withColumn(c, F.lit(a.get(c)).cast(dict(nodes.dtypes)[c]))
            nodes = upsert(nodes, new.select(*nodes.columns), ["graph", "id"])
        elif kind == "connect":
            ends = [nodes.where(F.col("id") == str(a[k])).select("graph") for k in ("to", "from")]
            new = ends[0].join(ends[1], "graph", "left_semi")
            new = new.select("graph", F.lit(str(a["to"])).alias("to_id"), F.lit(a["input"]).alias("input"), F.lit(str(a["from"])).alias("from_id"), F.lit(int(a.get("output", 0))).alias("output"))
            edges = upsert(edges, new, ["graph", "to_id", "input"])
        elif kind == "disconnect":
            chosen = [F.col(c) == v for c, v in (("to_id", a.get("to")), ("input", a.get("input")), ("from_id", a.get("from")), ("output", a.get("output"))) if v is not None]
            if a.get("to") is None and a.get("from") is None:
                raise ValueError("disconnect needs a node on either side")
            all_ = chosen[0]
            for c in chosen[1:]:
                all_ = all_ & c
            edges = edges.where(~F.coalesce(all_, F.lit(False)))
        elif kind == "remove":
            i = str(a["id"])
            nodes = nodes.where(F.col("id") != i)
            edges = edges.where((F.col("to_id") != i) & (F.col("from_id") != i))
        else:
            raise ValueError(f"no such action: {kind}")
    return nodes, edges


def valid_ids(nodes: DataFrame, id_col: str = "id") -> DataFrame:
    """``valid``: digits, with an optional second number behind a colon."""
    return nodes.withColumn("valid", F.col(id_col).rlike(r"^\d+(:\d+)?$"))
