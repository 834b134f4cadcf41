"""Repeated passages by a run-length suffix index.

Every window of ``length`` bytes has an anchor, its least k-gram by hash, so equal windows have equal anchors at equal
places. The windows of one anchor, in one half of the possible places, form a segment; they have a core of bytes in
common, and its hash is the segment's key. Segments with equal bytes repeat as a whole and are settled by a count;
different segments of one key may share some windows. Those are put into indexes of bounded size: the run-compressed
Burrows-Wheeler transform of the distinct segments, with suffix-array samples and common-prefix lengths at run ends only.
Streaming over the text, the matching statistic of a position is the nearest sample before it less the distance, and
windows whose statistic reaches ``length`` occur elsewhere. Keys with more segments than an index holds are refined first:
the range of places is halved, which lengthens the core, until the groups are small.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_IDS, released, save, set_aside

#: Bytes of the k-grams; bytes of text that one numpy step scans and that one index holds, except for a longer value.
GRAM, STEP_BYTES, INDEX_BYTES = 16, 700_000, 400_000
#: Distinct segments of one key above which it is refined.
MANY_SEGMENTS = 1500


# ---------------------------------------------------------------- anchors

def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; bytes behind the end are 255."""
    x = np.append(data, np.full(8, 255, np.uint8)).astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return (x[:-4] << np.uint64(32) | x[4:])[: len(data)]


def segments(texts: list[bytes], length: int):
    """``(text number, first window, number of windows, place of the anchor from the first window on)``, an anchor a row."""
    use = [i for i, t in enumerate(texts) if len(t) >= length]
    if not use:
        return (np.zeros(0, np.int64),) * 4
    size = np.array([len(texts[i]) for i in use])
    data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
    w = _words(data)
    shifted = np.append(w[8:], np.zeros(min(8, len(w)), np.uint64))
    h = w * np.uint64(0x9E3779B97F4A7C15) ^ (shifted * np.uint64(0xC2B2AE3D27D4EB4F) + (w >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(max(24, len(data).bit_length()))
    ranked = ((h >> bits) << bits) | np.arange(len(h), dtype=np.uint64)
    span = length - GRAM + 1
    blocks = -(-len(h) // span)
    padded = np.append(ranked, np.full(blocks * span - len(h), ~np.uint64(0))).reshape(blocks, span)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(padded, axis=1).ravel()
    least = np.minimum(after[: len(h)], np.append(before[span - 1:], np.full(span - 1, ~np.uint64(0)))[: len(h)])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.cumsum(size) - size
    valid = np.zeros(len(h) + 1, np.int8)
    valid[start] += 1
    valid[start + size - length + 1] -= 1
    valid = np.cumsum(valid[:-1]).astype(bool)
    fresh = np.append(True, anchor[1:] != anchor[:-1])
    fresh[start] = True
    first = np.flatnonzero(fresh & valid)
    edge = np.flatnonzero(fresh | ~valid)
    stop = np.append(edge, len(h))[np.searchsorted(edge, first, side="right")]
    which = np.searchsorted(start, first, side="right") - 1
    return np.array(use)[which], first - start[which], stop - first, anchor[first] - first


def classes(first: np.ndarray, n: np.ndarray, place: np.ndarray, width: int):
    """Cuts rows of windows so that their anchor's places lie in one class of ``width`` places: which row, and the new
    first window, number of windows and place."""
    low = place - n + 1
    count = place // width - low // width + 1
    row = np.repeat(np.arange(len(n)), count)
    c = np.repeat(place // width, count) - (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    top, bottom = np.minimum(place[row], (c + 1) * width - 1), np.maximum(low[row], c * width)
    return row, first[row] + place[row] - top, top - bottom + 1, top


def core(part: bytes, place: int, low: int, high: int, length: int) -> int:
    """Key of a segment: hash of the bytes that every window with the anchor at a place from low to high (exclusive) has."""
    return xxhash.xxh3_64_intdigest(part[place - low: place - high + 1 + length], low) - (1 << 63)


def _scan(length: int):
    """Rows ``(key, seg, h, starts, n_windows, place)``: one for each distinct segment of a text."""
    names = ["key", "seg", "h", "starts", "n_windows", "place"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    width = max(1, length // 2)

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for hs, texts in _steps(zip(batch.column(0).to_pylist(), (x.as_py().encode() for x in batch.column(1)))):
                rows: dict[tuple, list] = {}
                text, first, n, place = segments(texts, length)
                row, first, n, place = classes(first, n, place, width)
                for i, a, m, o in zip(text[row].tolist(), first.tolist(), n.tolist(), place.tolist()):
                    part = texts[i][a: a + m - 1 + length]
                    low = o // width * width
                    k = i, core(part, o, low, low + width, length), digest(part, o), m, o
                    if k in rows:
                        rows[k].append(a)
                    else:
                        rows[k] = [a]
                cols = [[k[1] for k in rows], [k[2] for k in rows], [hs[k[0]] for k in rows], [np.array(a, "<i4").tobytes() for a in rows.values()], [k[3] for k in rows], [k[4] for k in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run, "key long, seg binary, h binary, starts binary, n_windows int, place int"


def _steps(rows):
    hs, texts, size = [], [], 0
    for h, t in rows:
        hs.append(h)
        texts.append(t)
        size += len(t)
        if size > STEP_BYTES:
            yield hs, texts
            hs, texts, size = [], [], 0
    if hs:
        yield hs, texts


# ---------------------------------------------------------------- index

class RunLengthIndex:
    """Run-compressed transform of a text whose last byte is unique, with samples at run ends."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n = n
        rank = np.unique(_words(text), return_inverse=True)[1].astype(np.int64)
        levels, size = [(8, rank)], 8
        while rank.max() < n - 1:
            key = rank * (n + 1) + np.append(rank[size:] + 1, np.zeros(min(size, n), np.int64))[:n]
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            size *= 2
            levels.append((size, rank))
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        transform = np.where(order > 0, text[order - 1], 0).astype(np.int16)
        transform[rank[0]] = -1
        heads = np.flatnonzero(np.append(True, np.diff(transform) != 0))
        #: Run letters and lengths: the transform itself is not kept.
        self.letters, self.runs = transform[heads], np.diff(np.append(heads, n))
        tails = np.append(heads[1:], n) - 1
        #: Text places at run ends, and their common prefix with the neighbour beyond the run.
        self.head_at, self.tail_at = order[heads], order[tails]
        common = self._common(text, levels, self.tail_at[:-1], self.head_at[1:])
        self.head_common, self.tail_common = np.append(0, common), np.append(common, 0)

    @staticmethod
    def _common(text, levels, a, b):
        words, n = _words(text), len(text)
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for size, rank in reversed(levels):
            while True:
                fits = np.maximum(a, b) + size <= n
                same = fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
                if not same.any():
                    break
                a, b, out = a + size * same, b + size * same, out + size * same
                if size != levels[-1][0]:
                    break
        rest = words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)]
        equal = np.zeros(len(a), np.int64)
        for k in range(1, 8):
            equal += (rest >> np.uint64(64 - 8 * k)) == 0
        return out + np.minimum(equal, n - np.maximum(a, b))

    def statistics(self) -> np.ndarray:
        """For each place the length of its longest match that starts at another place: streamed from the samples."""
        out = np.zeros(self.n, np.int64)
        for at, common in ((self.head_at, self.head_common), (self.tail_at, self.tail_common)):
            value = np.full(self.n, -1, np.int64)
            value[at] = common + at
            last = np.maximum.accumulate(np.where(value >= 0, np.arange(self.n), 0))
            out = np.maximum(out, value[last] - np.arange(self.n))
        return out


def shared_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of several different segments, which of its windows also start elsewhere in them."""
    size = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff\xfe", np.uint8)
    long = RunLengthIndex(text).statistics() >= length
    at = np.cumsum(size) - size
    return [long[a: a + n - length] for a, n in zip(at, size)]


def _spans(hit: np.ndarray) -> list[dict]:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).reshape(-1, 2)
    return [{"lo": a, "hi": b - 1} for a, b in edge.tolist()]


SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _index(length: int):
    """``(key, seg, windows)`` of segments, sorted by key, that have shared windows. Keys stay together in an index."""
    def run(batches):
        held, size, last = [], 0, None

        def close():
            found = [(k, s, _spans(hit)) for (k, s, _), hit in zip(held, shared_windows([p for _, _, p in held], length)) if hit.any()]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.binary(), SPANS))], ["key", "seg", "windows"])

        for batch in batches:
            for key, seg, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if size > INDEX_BYTES and key != last:
                    yield close()
                    held, size = [], 0
                held.append((key, seg, part.as_py()))
                size, last = size + len(held[-1][2]), key
        if held:
            yield close()

    return run, "key long, seg binary, windows array<struct<lo:int,hi:int>>"


def _halved(length: int):
    """Rows ``(origin, key, seg, part, place, low, high, at)`` with each range of places ``low`` to ``high`` cut into two. ``at`` is the first
    window's number in the segment that ``origin`` names."""
    names = ["origin", "key", "seg", "part", "place", "low", "high", "at"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            rows = []
            for origin, part, place, low, high, at in zip(*(batch.column(n).to_pylist() for n in ("origin", "part", "place", "low", "high", "at"))):
                n = len(part) - length + 1
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle, high)):
                    top, bottom = min(place, b - 1), max(place - n + 1, a)
                    if top >= bottom:
                        piece = part[place - top: place - bottom + length]
                        rows.append((origin, core(piece, top, a, b, length), xxhash.xxh3_128_digest(piece, top), piece, top, a, b, at + place - top))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run, "origin binary, key long, seg binary, part binary, place int, low int, high int, at int"


# ---------------------------------------------------------------- the job

def _small(df: DataFrame) -> DataFrame:
    """A broadcast side below a checked count (20 MB or so), else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4 else df


def _tagged(docs: DataFrame, length: int) -> DataFrame:
    """All columns, with ``_h`` (the text's digest), ``_keep`` (the least id of a repeated text), ``_whole`` (every byte repeats)."""
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_h", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    copied = rows.groupBy("_h").agg(F.min(F.col("doc_id").cast("long")).alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    copied = _small(save(copied.select("_h", "_keep", F.lit(True).alias("_copy")), "copies"))
    return rows.join(copied, "_h", "left").withColumn("_whole", F.coalesce("_copy", F.lit(False)) & (F.octet_length("text") >= length))


def _cut(length: int):
    """Segments' bytes, from ``(text, want)`` with a list of wanted segments for each text."""
    names = ["key", "seg", "part", "place", "n_segs"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            for text, want in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                rows = [(w["key"], w["seg"], data[a: a + w["n_windows"] - 1 + length], w["place"], w["n_segs"]) for w in want.as_py() for a in [int.from_bytes(w["starts"], "little")]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return run, "key long, seg binary, part binary, place int, n_segs long"


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    run, schema = _index(length)
    return parts.select("key", "seg", "part").repartition("key").sortWithinPartitions("key", "seg").mapInArrow(released(run), schema)


def _refined(parts: DataFrame, length: int) -> DataFrame | None:
    """Marks ``(key, seg, windows)`` of segments whose key has too many for one index.

    Each round halves the ranges of places: equal pieces are settled by a count, and groups that have become small are
    indexed. Only rows of groups that are still large go on; at a range of one place all pieces of a group are equal.
    """
    width = max(1, length // 2)
    low = (F.floor(F.col("place") / width) * width).cast("int")
    rows = parts.where(F.col("n_segs") > MANY_SEGMENTS).select(F.struct("key", "seg").alias("origin"), "part", "place", low.alias("low"), (low + width).alias("high"), F.lit(0).alias("at"))
    rows, marks = rows.withColumn("origin", F.concat(F.unhex(F.lpad(F.hex("origin.key"), 16, "0")), F.col("origin.seg"))), None
    while not rows.isEmpty():
        run, schema = _halved(length)
        rows = save(rows.mapInArrow(released(run), schema), "halves")
        distinct = rows.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"))
        groups = save(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n_segs"), F.max("n").alias("most")).where("n_segs > 1 or most > 1"), "groups")
        rows = save(rows.join(groups, "key").join(distinct.where("n > 1"), ["key", "seg"], "left"), "halves")
        last = F.octet_length("part") - length + F.col("at")
        whole = rows.where("n > 1").select("origin", F.array(F.struct(F.col("at").alias("lo"), last.cast("int").alias("hi"))).alias("spans"))
        some = rows.where(F.col("n_segs").between(2, MANY_SEGMENTS)).dropDuplicates(["key", "seg"])
        some = rows.select("key", "seg", "origin", "at").join(_indexed(some, length), ["key", "seg"])
        some = some.select("origin", _pairs(F.col("windows"), F.col("at")).alias("spans"))
        found = save(whole.union(some), "refined")
        marks = found if marks is None else marks.union(found)
        rows = rows.where(F.col("n_segs") > MANY_SEGMENTS).drop("n", "n_segs", "most")
    if marks is None:
        return None
    key = F.conv(F.hex(F.substring(F.col("origin"), 1, 8)), 16, -10).cast("long")
    return marks.select(key.alias("key"), F.substring(F.col("origin"), 9, 16).alias("seg"), F.explode("spans").alias("s")).groupBy("key", "seg").agg(F.collect_set("s").alias("places"))


def _pairs(spans, shift):
    """Spans moved by ``shift``."""
    return F.transform(spans, lambda w: F.struct((w["lo"] + shift).alias("lo"), (w["hi"] + shift).alias("hi")))


def _remove(length: int, at: int, names: list[str], whole: bool):
    """Takes the bytes that marked windows cover out of the text at column ``at``; the last column has the marks. ``whole``: characters
    that lose some of their bytes go as a whole."""
    def removed(text: bytes, marks) -> tuple[bytes, int, int]:
        if not marks:
            return text, 0, 0
        edge = np.zeros(len(text) + 1, np.int32)
        for m in marks:
            starts = np.frombuffer(m["starts"], "<i4")
            for lo, hi in [(0, m["n_windows"] - 1)] if m["windows"] is None else [(w["lo"], w["hi"]) for w in m["windows"]]:
                np.add.at(edge, starts + lo, 1)
                np.add.at(edge, starts + hi + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] > gone[:-1]).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return kept.decode("utf-8", "ignore").encode() if whole else kept, int(gone.sum()), spans

    def run(batches):
        for batch in batches:
            begin, rows, size = 0, [], 0
            for i, (text, marks) in enumerate(zip(batch.column(at), batch.column(batch.num_columns - 1))):
                data = text.as_py().encode()
                rows.append((len(data), *removed(data, marks.as_py())))
                size += len(data)
                if size > 8 * STEP_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(begin, i + 1 - begin)
                    new = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (2, pa.int64()), (3, pa.int64()), (1, pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], [*names, *NEW])
                    begin, rows, size = i + 1, [], 0

    return run


NEW = ("n_bytes", "n_removed", "n_spans", "kept")


def cut_repeats(docs: DataFrame, length: int = 400, whole_characters: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary: the remaining UTF-8 bytes).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another; all
    occurrences go, and strings are judged on the input. Texts are bytes of UTF-8, null is empty, matches never cross texts.
    A text of at least ``length`` bytes that another row repeats goes as a whole; shorter texts stay, whatever repeats.
    Rows that repeat an id count as rows of their own. Other columns pass through, whatever their names, and those four names are replaced.
    An empty table gives an empty result. With ``whole_characters``, ``kept`` has no characters that lost some of their bytes.

    Copies are counted by digest (one row a text and task after the partial sum) and scanned once. What is shuffled: a
    key for each segment (four in a window's length), a row of about 60 bytes for each whose key occurs again, texts with segments to compare, and texts that
    are not wholly copies. Keys with more than ``MANY_SEGMENTS`` different segments are refined, so no group is held as a whole.
    """
    names = [c for c in docs.columns if c not in NEW]
    own = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]  # no name of theirs meets one used here
    docs = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)])
    rows = _tagged(docs, length)
    # one row of each repeated text, or a few where ids repeat: those add nothing
    once = rows.where(~F.col("_whole") | F.col("doc_id").cast("long").eqNullSafe(F.col("_keep"))).where(F.octet_length("text") >= length)
    run, schema = _scan(length)
    found = save(once.select("_h", "text").mapInArrow(released(run), schema), "segments")
    # most keys occur once: only rows whose key occurs again go on
    again = save(found.groupBy("key").agg(F.sum(F.octet_length("starts")).alias("bytes")).where("bytes > 4").select("key"), "keys")
    found = save(found.join(_small(again), "key", "left_semi"), "segments")

    distinct = found.groupBy("key", "seg").agg(F.sum((F.octet_length("starts") / 4).cast("long")).alias("n"), F.min(F.struct("h", F.substring("starts", 1, 4).alias("starts"), "n_windows", "place")).alias("at"))
    distinct = save(distinct.select("key", "seg", "n", "at.*"), "distinct")
    several = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n_segs")).where("n_segs > 1")
    wanted = distinct.join(several, "key").select(F.col("h").alias("_h"), F.struct("key", "seg", "starts", "n_windows", "place", "n_segs").alias("want"))
    run, schema = _cut(length)
    parts = save(once.select("_h", "text").join(wanted.groupBy("_h").agg(F.collect_list("want").alias("want")), "_h").select("text", "want").mapInArrow(released(run), schema), "parts")

    marks = distinct.where("n > 1").select("key", "seg", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("windows"))
    marks = marks.union(_indexed(parts.where(F.col("n_segs") <= MANY_SEGMENTS), length))
    if (refined := _refined(parts, length)) is not None:
        marks = marks.union(refined)
    marked = found.join(marks, ["key", "seg"]).select(F.col("h").alias("_h"), F.struct("starts", "n_windows", "windows").alias("mark"))
    marked = save(marked.groupBy("_h").agg(F.collect_list("mark").alias("_marks")), "marked")

    size = F.octet_length("text").cast("long")
    gone = rows.where("_whole").select(*own, size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    # texts that are too short to lose anything stay where they are, however often one of them occurs
    long = F.octet_length("text") >= length
    rest = rows.where("not _whole").where(long).join(marked, "_h", "left").select(*own, "_marks")
    rest = rest.union(rows.where("not _whole").where(F.coalesce(~long, F.lit(True))).select(*own, F.lit(None).cast(marked.schema["_marks"].dataType)))
    schema = "".join(f"{c} {t}, " for c, t in docs.dtypes) + "n_bytes long, n_removed long, n_spans long, kept binary"
    return rest.mapInArrow(released(_remove(length, own.index("text"), own, whole_characters)), schema).union(gone).toDF(*names, *NEW)


def dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_chars``, where there is one, counted anew.

    Characters that lose some of their bytes go as a whole. Null texts become empty; other texts without repeats stay as they are.
    Columns may have any names. An empty table gives an empty result.
    """
    own, back = set_aside(docs, NEW)
    out = cut_repeats(own, length, whole_characters=True)
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in own.columns]).withColumnsRenamed(back)
