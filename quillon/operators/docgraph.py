"""References between documents: extraction, resolution, closure and cache rules."""
from __future__ import annotations

import functools
import json
from urllib.parse import urljoin, urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.reachability import components
from quillon.sources.scratch import materialise

DAY = 86400
#: What the parser raises for text that is not JSON, or is nested deeper than it goes.
NOT_JSON = (TypeError, ValueError, RecursionError)


def walk(value) -> list[tuple[str, bool]]:
    """Every ``$ref`` text at any depth, and whether it is its object's only key. Not recursive, so depth does not matter."""
    found, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found.append((x["$ref"], len(x) == 1))
            todo.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            todo.extend(reversed(x))
    return found


#: A ``$ref`` with a text, and the braces next to it. Within a JSON string every quote has a backslash before it, so nothing in strings looks like this.
_REF = r'(?:\{\s*)?(?<!\\)"\$ref"\s*:\s*"(?:[^"\\]++|\\.)*+"(?:\s*\})?'


def refs(body: str) -> Column:
    """References of a JSON document as ``array<struct<ref, sole_key>>``, in the order of the text; null for text that is not JSON, or that is larger or nested deeper than
    ``try_parse_json`` takes. Found in the text itself, by Spark's functions alone."""
    found = F.regexp_extract_all(F.col(body), F.lit(_REF), F.lit(0))
    values = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r'^(?:\{\s*)?"\$ref"\s*:\s*', ""), r"\s*\}$", ""))
    texts = F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>")
    sole = F.transform(found, lambda x: F.startswith(x, F.lit("{")) & F.endswith(x, F.lit("}")))
    pairs = F.zip_with(texts, sole, lambda t, s: F.struct(t.alias("ref"), s.alias("sole_key")))
    return F.when(F.try_parse_json(F.col(body)).isNotNull(), pairs)


def external(found: str = "refs") -> Column:
    return F.filter(found, lambda r: ~F.startswith(r["ref"], F.lit("#")))


def edges(docs: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``(src_url, ref, sole_key)``, one row a reference. Only those that are sole keys are resolved."""
    return docs.select(F.col(url).alias("src_url"), F.explode(refs(body)).alias("r")).select("src_url", "r.ref", "r.sole_key")


def split_ref(ref: str) -> tuple[Column, Column]:
    """URL and fragment, cut at the first ``#``; without one the fragment is empty."""
    at = F.instr(F.col(ref), "#")
    return F.substring_index(ref, "#", 1), F.when(at > 0, F.substring(F.col(ref), at + 1, F.length(ref))).otherwise("")


def resolve(base: str, ref: str) -> Column:
    """``struct<url, error>`` of a reference's URL part against the document that holds it. A URL with a scheme stays, an empty one is the base;
    a malformed one is an error."""
    @F.pandas_udf(T.StructType([T.StructField("url", T.StringType()), T.StructField("error", T.StringType())]))
    def join(bases: pd.Series, found: pd.Series) -> pd.DataFrame:
        def one(b, r):
            try:
                if r is not None and urlsplit(r).scheme:
                    return r, None
                if not b:
                    return None, "no base"
                return (urljoin(b, r), None) if r else (b, None)
            except ValueError:
                return None, "malformed URL"

        return pd.DataFrame([one(b, r) for b, r in zip(bases, found)], columns=["url", "error"])

    return join(base, ref)


def pointer(body: str, fragment: str) -> Column:
    """``struct<value, error>``: the JSON below a fragment such as ``/a/b``. Empty and ``/`` are the whole document, empty parts are skipped,
    nothing is unescaped, and arrays are not entered; a missing key is an error."""
    @F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
    def find(bodies: pd.Series, fragments: pd.Series) -> pd.DataFrame:
        def one(text, where):
            try:
                x = json.loads(text)
                for part in filter(None, (where or "").split("/")):
                    x = x[part] if isinstance(x, dict) else {}[part]
                return json.dumps(x, separators=(",", ":")), None
            except KeyError as e:
                return None, f"no key {e.args[0]}"
            except NOT_JSON:
                return None, "not JSON"

        return pd.DataFrame([one(t, w) for t, w in zip(bodies, fragments)], columns=["value", "error"])

    return find(body, fragment)


def cache_key(url: str) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def fresh(entries: DataFrame, now: float, ttl: float = DAY) -> DataFrame:
    """Entries that have not expired: an age equal to the time to live is fresh, a missing stamp is 0."""
    return entries.where(F.lit(now) - F.coalesce("timestamp", F.lit(0)) <= ttl)


def newest(entries: DataFrame, key: str = "url", stamp: str = "timestamp", tiebreak: str | None = None) -> DataFrame:
    """The last entry of each key. Taken by a maximum, so a key with very many entries is one row a task before the shuffle."""
    rest = [c for c in entries.columns if c != key]
    order = F.struct(*[F.col(c) for c in (stamp, tiebreak) if c])
    return entries.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_e")).select(key, "_e.*")


def lookups(wanted: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """URLs found in fresh entries, and the list to fetch, each URL once."""
    urls = wanted.select("url").distinct()
    return urls.join(cached, "url"), urls.join(cached, "url", "left_anti")


def closure(pairs: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All ``(src, dst)`` where dst is reached from src; cycles show as rows whose ends are equal.

    Paths double in length each round, so a chain of n documents takes about log2(n) rounds; a round joins only what the last one added.
    Each is written to the shared folder, and they end when nothing is added. With ``max_rounds``, needing more is an error. The result is as
    large as the number of pairs that reach each other; ``reachability`` counts and answers without it.
    """
    new = materialise(pairs.select("src", "dst").where("src is not null and dst is not null").distinct(), "closure")
    found, rounds = new, 0
    while not new.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"the closure is not complete after {max_rounds} rounds")
        follow = lambda one, two: one.join(two.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        longer = follow(new, found).union(follow(found, new)).distinct()
        new = materialise(longer.join(found, ["src", "dst"], "left_anti"), "closure")
        found, rounds = found.union(new), rounds + 1
    return found


def _target(base: str | None, ref: str) -> str | None:
    """URL and fragment that a reference points to, as ``url#fragment``; None for a malformed one."""
    try:
        where, _, fragment = urljoin(base or "", ref).partition("#")
    except ValueError:
        return None
    return f"{where}#{fragment}"


def _targets(url: str, body: str) -> Column:
    """``array<struct<key, ref>>`` of the references that inlining replaces, in the order of the text."""
    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("ref", T.StringType())])))
    def find(urls: pd.Series, bodies: pd.Series) -> pd.Series:
        def one(u, text):
            try:
                return [{"key": k, "ref": r} for r, sole in walk(json.loads(text)) if sole and not r.startswith("#") and (k := _target(u, r))]
            except NOT_JSON:
                return []

        return pd.Series([one(*x) for x in zip(urls, bodies)], dtype=object)

    return find(url, body)


def _filled(url: str, body: str, parts: str, max_bytes: int) -> Column:
    """``struct<resolved, unresolved>``: a body with its references replaced by ``parts``, resolved targets; the others are listed."""
    @F.pandas_udf(T.StructType([T.StructField("resolved", T.StringType()), T.StructField("unresolved", T.ArrayType(T.StringType()))]))
    def fill(urls: pd.Series, bodies: pd.Series, found: pd.Series) -> pd.DataFrame:
        def one(u, text, rows):
            try:
                top = [json.loads(text)]
            except NOT_JSON:
                return None, ["not JSON"]
            texts, failed, size = {x["key"]: x for x in (rows if rows is not None else ())}, [], len(text)
            todo = [(top, 0)]
            while todo:
                box, at = todo.pop()
                x = box[at]
                ref = x.get("$ref") if isinstance(x, dict) and len(x) == 1 else None
                if isinstance(ref, str) and not ref.startswith("#"):
                    y = texts.get(_target(u, ref))
                    if y is not None and y["resolved"] is None:
                        return None, list(y["unresolved"])
                    if y is not None:
                        size += len(y["resolved"])
                        if size > max_bytes:
                            return None, [f"larger than {max_bytes} characters"]
                        box[at] = json.loads(y["resolved"])
                    failed.extend([ref] if y is None else y["unresolved"])
                elif isinstance(x, (dict, list)):
                    todo.extend((x, k) for k in reversed(x if isinstance(x, dict) else range(len(x))))
            try:
                return json.dumps(top[0], separators=(",", ":")), failed
            except RecursionError:
                return None, ["nested too deep"]

        return pd.DataFrame([one(*x) for x in zip(urls, bodies, found)], columns=["resolved", "unresolved"])

    return fill(url, body, parts)


def fragments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the references of documents ``(url, body)`` share: ``(key, url, body, refs)``, each fragment that one points to and that is there, once; and
    ``(key, target)``, which of them point to which."""
    return _fragments(docs.select("url", "body", _targets("url", "body")["key"].alias("keys")))


def _fragments(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``fragments`` of documents ``(url, body, keys)``. Only documents that are referred to are shuffled with their text."""
    refs = docs.select(F.explode("keys").alias("key")).distinct()
    wanted = materialise(refs.withColumns({"url": F.substring_index("key", "#", 1), "fragment": F.expr("substring(key, instr(key, '#') + 1)")}), "wanted")
    bodies = docs.join(wanted.select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max("body").alias("_b"))
    pieces = wanted.join(bodies, "url").withColumn("body", pointer("_b", "fragment")["value"]).where("body is not null")
    pieces = materialise(pieces.select("key", "url", "body").withColumn("refs", _targets("url", "body")), "fragments")
    arcs = pieces.select("key", F.explode("refs.key").alias("target")).distinct().join(pieces.select(F.col("key").alias("target")), "target", "left_semi")
    return pieces, materialise(arcs.select("key", "target"), "arcs")


def _ways(inner: DataFrame, max_depth: int | None, max_ways: int) -> tuple[DataFrame, DataFrame]:
    """Ways along ``inner (component, key, target)`` that meet no fragment twice: ``(component, parent, id, key)``, a way that begins at a fragment having its key as id; and the components
    ``(component)`` in which more than ``max_ways`` ways have one length."""
    level = inner.select("component", "key").distinct().select("component", F.lit(None).cast("string").alias("parent"), F.col("key").alias("id"), "key", F.array("key").alias("open"))
    level = materialise(level, "ways")
    levels, over = [level], []
    while max_depth is None or len(levels) < max_depth:
        below = level.select("component", F.col("id").alias("parent"), "key", "open").join(inner, ["component", "key"]).where("not array_contains(open, target)")
        level = materialise(below.select("component", "parent", F.sha2(F.concat_ws(" ", "parent", "target"), 256).alias("id"), F.col("target").alias("key"), F.array_append("open", F.col("target")).alias("open")), "ways")
        if max_depth is None:
            many = level.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_ways).select("component")
            if not many.isEmpty():
                over.append(many)
                level = level.join(many, "component", "left_anti")
        if level.isEmpty():
            break
        levels.append(level)
    whole = functools.reduce(DataFrame.union, levels).drop("open")
    many = functools.reduce(DataFrame.union, over) if over else inner.select("component").limit(0)
    return whole.join(many, "component", "left_anti"), many


def inline(docs: DataFrame, max_depth: int | None = None, max_bytes: int = 16_000_000, max_ways: int = 10_000) -> DataFrame:
    """Documents ``(url, body)`` with ``resolved``: sole-key references replaced by what they point to, at any depth.

    Local references stay; a missing document, a missing key or a malformed URL stays too, and is listed in ``unresolved``. Text that is no JSON, or
    nested deeper than Python's parser goes, has no result and says so there, and so has a result of more than ``max_bytes`` characters: what is shared, ``fragments`` gives at any size.
    Without cycles every fragment is resolved once, however many places refer to it. Where fragments refer to each other, a reference back to one that is being resolved stays, so a
    fragment's result depends on how it was come to, and there is one row for each way through its component. Components in which more than ``max_ways`` ways have one length are cut instead:
    of their inner references those stay that do not lead to a greater key. With ``max_depth``, references nested deeper stay as well, and ways are counted over all fragments.

    Works from the bottom up, a round for each level, each written to the shared folder. A row never holds more than a fragment, or its own part of the result.
    """
    own = docs.select("url", "body").withColumn("id", F.concat(F.lit("document "), F.monotonically_increasing_id()))
    own = materialise(own.withColumn("keys", F.array_distinct(_targets("url", "body")["key"])), "inline")
    pieces, arcs = _fragments(own)
    if max_depth is None:
        cyclic = materialise(components(arcs.select(F.col("key").alias("src"), F.col("target").alias("dst"))).withColumnRenamed("node", "key"), "cyclic")
    else:
        cyclic = pieces.select("key", F.lit("").alias("component"))
    of = cyclic.select(F.col("key").alias("target"), F.col("component").alias("_to"))
    arcs = materialise(arcs.join(cyclic, "key", "left").join(of, "target", "left").select("key", "target", "component", (F.col("component") == F.col("_to")).alias("inner")), "arcs")
    # a node for each way within a component, and one for each other fragment; a way's first fragment stands for it by its key
    members = arcs.where("inner").select("component", "key", "target") if max_depth is None else arcs.select("component", "key", "target").union(pieces.select(F.lit(""), "key", F.lit(None).cast("string")))
    ways, cut = (materialise(x, name) for x, name in zip(_ways(members, max_depth, max_ways), ("all-ways", "cut")))
    single = pieces.select("key").join(ways.select("key"), "key", "left_anti")
    nodes = materialise(ways.select("id", "key").union(single.select(F.col("key").alias("id"), "key")), "inline-nodes")
    links = [ways.where("parent is not null").select(F.col("parent").alias("id"), "key", F.col("id").alias("node"))]
    outer = arcs.where("not coalesce(inner, false)").select("key", "target")
    kept = arcs.where("inner and target > key").join(cut, "component", "left_semi").select("key", "target")
    if max_depth is None:
        links.append(nodes.join(outer.union(kept), "key").select("id", F.col("target").alias("key"), F.col("target").alias("node")))
    links = materialise(functools.reduce(DataFrame.union, links), "inline-links")

    # a node's level is the longest way down from it
    front, levels = nodes.select("id"), []
    while not front.isEmpty():
        levels.append(front.withColumn("level", F.lit(len(levels))))
        front = materialise(links.join(front.select(F.col("id").alias("node")), "node", "left_semi").select("id").distinct(), "inline-front")
    depth = len(levels)
    levels = functools.reduce(DataFrame.union, levels).groupBy("id").agg(F.max("level").alias("level")).join(nodes, "id") if levels else nodes.withColumn("level", F.lit(0))
    levels = materialise(levels.select("id", "key", "level"), "inline-levels")
    links = materialise(links.join(levels.select("id", "level"), "id").select("id", "key", "node", "level"), "inline-links")
    nodes = materialise(levels.join(pieces.select("key", "url", "body"), "key").select("id", "level", "url", "body"), "inline-nodes")
    given: list[DataFrame] = []

    def resolved(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
        kind = "array<struct<key:string,resolved:string,unresolved:array<string>>>"
        if parts is not None:
            rows = rows.join(parts.groupBy("id").agg(F.collect_list(F.struct("key", "resolved", "unresolved")).alias("parts")), "id", "left")
        else:
            rows = rows.withColumn("parts", F.lit(None).cast(kind))
        return rows.withColumn("_x", _filled("url", "body", "parts", max_bytes))

    whole = []
    for of in range(depth):
        parts = functools.reduce(DataFrame.union, given).where(F.col("level") == of) if given else None
        filled = resolved(nodes.where(F.col("level") == of), parts).select(F.col("id").alias("node"), "_x.resolved", "_x.unresolved")
        whole.append(materialise(filled, "inline-filled"))
        given.append(materialise(links.join(whole[-1], "node").select("id", "level", "key", "resolved", "unresolved"), "inline-parts"))
    parts = None
    if whole and (max_depth is None or max_depth > 0):  # documents themselves come in once, when all fragments are done
        roots = own.select("id", F.explode("keys").alias("key"))
        parts = roots.join(functools.reduce(DataFrame.union, whole).withColumnRenamed("node", "key"), "key")
    return resolved(own, parts).select("url", "body", "_x.resolved", "_x.unresolved")


class Run:
    """What a stretch of one key's accesses, in order, makes of the time of the last fetch before it: ``exits[i]`` is the last fetch in it where ``times[i]`` is the first,
    for all that can be. Where ``whole``, all its times are there, and a fetch that is still fresh after them stays the last."""

    def __init__(self, times: np.ndarray, exits: np.ndarray, whole: bool):
        self.times, self.exits, self.whole = times, exits, whole

    @classmethod
    def of(cls, times: np.ndarray, ttl: float) -> Run:
        times = np.unique(times)
        after = np.searchsorted(times, times + ttl, side="right")
        last = np.where(after < len(times), after, np.arange(len(times)))
        while not np.array_equal(last, last[last]):
            last = last[last]
        n = int(after[0]) + 1  # a fetch before the stretch is no later than its first access
        return cls(times[:n], times[last[:n]], n >= len(times))

    def __call__(self, last: np.ndarray, ttl: float) -> np.ndarray:
        at = np.searchsorted(self.times, last + ttl, side="right")
        return np.where(at < len(self.times), self.exits[np.minimum(at, len(self.times) - 1)], last)

    def then(self, other: Run, ttl: float) -> Run:
        exits = other(self.exits, ttl)
        if not self.whole:
            return Run(self.times, exits, False)
        more = other.times > self.times[-1]
        return Run(np.append(self.times, other.times[more]), np.append(exits, other.exits[more]), other.whole)


def _entries(rows: DataFrame, key: str, seconds: str, ttl: float) -> DataFrame:
    """``(_key, _run, _last)``: the last fetch before each run but the first, of keys that have several.

    Runs are summed up by themselves, and the sums chained by doubling: in each round a run takes in as many runs before it as it spans already.
    """
    whole_numbers = isinstance(rows.schema[seconds].dataType, T.IntegralType)
    kind, number = ("<i8", "long") if whole_numbers else ("<f8", "double")
    of = rows.schema[key].dataType.simpleString()
    runs = rows.groupBy(F.col(key).alias("_key"), "_run").agg(F.lit(1)).select("_key", "_run")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_run")).cast("long") - 1  # no more rows than partitions, but for keys of one run
    several = runs.groupBy("_key").agg(F.min("_run").alias("_a"), F.max("_run").alias("_b")).where("_a < _b").select("_key")
    runs = materialise(runs.join(several.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left_semi").withColumn("n", nth), "runs")
    own = rows.select(F.col(key).alias("_key"), "_run", F.col(seconds).cast(number).alias("t")).join(runs.withColumnsRenamed({"_key": "_k", "_run": "_r"}), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_r")))
    names = ["_key", "_run", "n", "value", "times", "exits", "whole"]
    schema = f"_key {of}, _run int, n long, value {number}, times binary, exits binary, whole boolean"

    def packed(k, run, n, value, f):
        return (k, run, n, value, f.times.astype(kind).tobytes() if f else None, f.exits.astype(kind).tobytes() if f else None, f.whole if f else None)

    def first(k, frame):
        f = Run.of(frame["t"].to_numpy(), ttl)
        n = int(frame["n"].iloc[0])
        # the first run begins without a fetch, so its first access is one
        row = packed(frame["_key"].iloc[0], int(frame["_run"].iloc[0]), n, None if n else f.exits[0].item(), f if n else None)
        return pd.DataFrame([row], columns=names)

    def joined(frames):
        for frame in frames:
            out = []
            for k, run, n, value, times, exits, whole, before, *early in frame.itertuples(index=False, name=None):
                f = Run(np.frombuffer(times, kind), np.frombuffer(exits, kind), whole)
                if early[0] is None:
                    out.append(packed(k, run, n, f(np.array([before], kind), ttl)[0].item(), None))
                else:
                    out.append(packed(k, run, n, None, Run(np.frombuffer(early[0], kind), np.frombuffer(early[1], kind), early[2]).then(f, ttl)))
            yield pd.DataFrame(out, columns=names)

    left = materialise(own.select("_key", "_run", "n", "t").groupBy("_key", "_run").applyInPandas(first, schema), "run-sums")
    done, step = [left.where("value is not null")], 1
    left = left.where("value is null")
    while not left.isEmpty():
        early = functools.reduce(DataFrame.union, [left, *done]).select(F.col("_key").alias("_k"), (F.col("n") + step).alias("_n"), F.col("value").alias("before"), *(F.col(c).alias(f"early_{c}") for c in names[4:]))
        both = left.join(early, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("n") == F.col("_n"))).select(*names, "before", *(f"early_{c}" for c in names[4:]))
        both = materialise(both.mapInPandas(joined, schema), "run-sums")
        done.append(both.where("value is not null"))
        left, step = both.where("value is null"), 2 * step
    ends = functools.reduce(DataFrame.union, done).select(F.col("_key").alias("_k"), (F.col("n") + 1).alias("_n"), F.col("value").alias("_last"))
    return materialise(runs.join(ends, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("n") == F.col("_n"))).select("_key", "_run", "_last"), "entries")


def replay(accesses: DataFrame, key: str, seconds: str, ttl: float = DAY) -> DataFrame:
    """Accesses with ``fetched``: whether a cache would have fetched then. A fetch starts the clock anew and a hit does not. Of equal times of a key one
    fetches. Rows without a time are no accesses and fetch nothing; rows without a key are of one key.

    Accesses are put in order over all tasks, so a key of very many is a run in each of several. The last fetch before every run is found first, from sums of the runs; then each
    run is read as a stream with one number of state.
    """
    names = accesses.columns
    order = accesses.where(F.col(seconds).isNotNull()).repartitionByRange(key, seconds).sortWithinPartitions(key, seconds)
    rows = materialise(order.withColumn("_run", F.spark_partition_id()), "accesses")
    entries = _entries(rows, key, seconds, ttl)
    rows = rows.join(entries, F.col(key).eqNullSafe(F.col("_key")) & (rows["_run"] == entries["_run"]), "left").select(*(rows[c] for c in [*names, "_run"]), "_last")
    schema = T.StructType([*accesses.schema.fields, T.StructField("fetched", T.BooleanType())])

    def run(frames):
        now, last = None, None
        for frame in frames:
            hits = []
            for k, r, t, before in zip(frame[key], frame["_run"], frame[seconds], frame["_last"]):
                k = None if k != k else k
                if (k, r) != now:
                    now, last = (k, r), None if pd.isna(before) else before
                hits.append(last is None or t - last > ttl)
                if hits[-1]:
                    last = t
            yield frame[names].assign(fetched=hits)

    timed = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", seconds).mapInPandas(run, schema)
    return timed.union(accesses.where(F.col(seconds).isNull()).withColumn("fetched", F.lit(False)))


def host_summary(found: DataFrame, url: str = "url", source: str = "src_url") -> DataFrame:
    """Per host of the target: references, distinct targets and documents that refer."""
    host = F.try_parse_url(F.col(url), F.lit("HOST"))
    return found.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct(url).alias("n_targets"), F.count_distinct(source).alias("n_documents"))


__all__ = ["cache_key", "closure", "edges", "external", "fragments", "fresh", "host_summary", "inline", "lookups", "newest", "pointer", "refs", "replay", "resolve", "split_ref", "walk"]
