"""Document fingerprints by I-Match, in DataFrame functions only.

The distinct terms of a document whose inverse document frequency lies in a band are hashed once as a whole and once for each
of several randomised lexicon subsets. Subsets come in sizes from an eighth of the lexicon down to a five-hundredth, so that
short and long documents both have subsets that hold a few of their terms.

The same numbers are made of all distinct terms of a document. They count where the band says little: where a group of near
copies is so large that its own terms leave the band, and in tables so small that the band is empty.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import save, small

#: Terms are runs of letters and digits, lower-cased.
SEPARATOR = r"[^\p{L}\p{N}]+"
#: Subsets of each size, and the sizes as shares of the lexicon. A mask of 64 bits holds 62 subsets at most.
SUBSETS_EACH, ONE_IN = 15, (8, 32, 128, 512)
SUBSETS = SUBSETS_EACH * len(ONE_IN)
HALF = SUBSETS // 2
#: The lexicon is broadcast up to so many terms (about 60 bytes each), and joined by shuffle beyond.
BROADCAST_TERMS = 400_000
#: Documents with neighbouring ids that are ordered together at most, unless more than that share 1024 ids. Ranges of ids are powers of two: of 1024 ids, or
#: 16 times as many and so on.
BUCKET, FINE, STEP, LEVELS = 4096, 10, 4, 14
#: A document has few band terms if they are fewer than so many, or less than one in so many of its distinct terms.
FEW, FEW_ONE_IN = 3, 5


def terms(text: str) -> str:
    """SQL of a text's distinct terms."""
    return rf"array_remove(array_distinct(split(lower({text}), '{SEPARATOR.replace(chr(92), chr(92) * 2)}')), '')"


def place(subset: int) -> int:
    """Bit of a subset in the masks that ``fingerprints`` works with. Subsets half their count apart are 32 bits apart, so that one 64-bit number has both their numbers."""
    return subset if subset < HALF else subset - HALF + 32


def subsets(term: str, bit=int) -> str:
    """SQL of a term's mask: bit ``bit(i)`` is set if subset i holds the term. Each 64-bit hash is cut into as many subsets as it has bits for."""
    bits, n, at = [], 0, 64
    for i in range(SUBSETS):
        width = ONE_IN[i // SUBSETS_EACH].bit_length() - 1
        n, at = (n, at) if at + width <= 64 else (n + 1, 0)
        bits.append(f"if((shiftrightunsigned(xxhash64({term}, {n}), {at}) & {(1 << width) - 1}) = 0, {1 << bit(i)}L, 0L)")
        at += width
    return " | ".join(bits)


def lexicon(docs: DataFrame, text: str = "text", min_idf: float = math.log(50), max_idf: float = math.log(1000)) -> DataFrame:
    """``(term, mask)`` of terms with ``min_idf <= ln(documents / frequency) <= max_idf`` that more than one document has.

    ``mask`` has bit i set if subset i holds the term. Frequencies are counted over all documents, with a partial count
    before the shuffle. The lexicon cannot exceed the mean number of distinct terms of a document times exp(max_idf).
    """
    n = docs.count()
    counted = docs.select(F.explode(F.expr(terms(f"`{text}`"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = counted.where((F.col("df") > 1) & (F.col("df") >= math.ceil(n * math.exp(-max_idf))) & (F.col("df") <= math.floor(n * math.exp(-min_idf)))).select("term")
    return band.withColumn("mask", F.expr(subsets("term")))


def fingerprints(df: DataFrame, key: list[str], text: str, words: DataFrame) -> DataFrame:
    """``key``, ``prints`` and ``every`` for each row with terms. Both are arrays of 32-bit numbers, from -2**31 on: that of all terms of a
    set first, then that of each subset, null where a subset has none of them. The set is that of the band terms for
    ``prints``, which is null for rows with few of them, and that of all distinct terms for ``every``. Keys are unique.

    ``words`` has a column ``term``. A number is the exclusive or of its terms' hashes, so terms are neither gathered nor sorted. If ``df`` is partitioned by
    some of the keys, nothing but the lexicon moves.
    """
    found = df.select(*key, F.explode(F.expr(terms(f"`{text}`"))).alias("term")).join(words.select("term", F.lit(-1).cast("long").alias("band")), "term", "left")
    found = found.select(*key, F.expr("xxhash64(term) & 4294967295").alias("h"), F.expr(subsets("term", place)).alias("mask"), F.coalesce("band", F.lit(0).cast("long")).alias("band"))
    # each half of h2 has the term's hash, and of a pair of subsets those halves stay whose subset holds the term: no branches, no nulls, half as many sums
    found = found.withColumn("h2", F.expr("h | shiftleft(h, 32)")).select("*", F.expr("h2 & band").alias("b2"))
    pair = lambda i: f"(shiftrightunsigned(mask, {i}) & 4294967297L)"
    number = lambda h, i: F.expr(f"bit_xor({h} & (shiftleft({pair(i)}, 32) - {pair(i)}))")
    sets = found.groupBy(*key).agg(
        F.sum(-F.col("band")).alias("n_band"), F.count(F.lit(1)).alias("n_terms"), F.expr("bit_xor(b2)").alias("b"), F.expr("bit_xor(h2)").alias("e"), F.expr("bit_or(mask & band)").alias("b_held"), F.expr("bit_or(mask)").alias("e_held"),
        *[number(h, i).alias(f"{c}{i}") for c, h in (("b", "b2"), ("e", "h2")) for i in range(HALF)])

    def whole(c: str) -> str:
        low = lambda x: f"cast(({x} & 4294967295L) - 2147483648L as int)"
        halves = [f"{c}{i}" if i < HALF else f"shiftrightunsigned({c}{i - HALF}, 32)" for i in range(SUBSETS)]
        return f"array({', '.join([low(c), *[f'if(({c}_held & {1 << place(i)}L) = 0, null, {low(x)})' for i, x in enumerate(halves)]])})"

    return sets.select(*key, F.expr(f"if(n_band < {FEW} or n_band * {FEW_ONE_IN} < n_terms, null, {whole('b')})").alias("prints"), F.expr(whole("e")).alias("every"))


def printed(prints: str, every: str, text_hash: str):
    """The fingerprint as text: the numbers of the band terms, all ``-`` where these are few, a bar, and those of all terms. Without
    terms it is the text's own hash, so that only equal texts agree."""
    words = lambda c: f"array_join(transform({c}, x -> if(x is null, '-', lower(hex(x + 2147483648L)))), ' ')"
    none = "'" + " ".join("-" * (SUBSETS + 1)) + "'"
    return F.expr(f"if({every} is null, concat('text:', lower(hex({text_hash}))), concat(coalesce({words(prints)}, {none}), ' | ', {words(every)}))")


def likeness(a: str, b: str, a_every: str, b_every: str, a_hash: str, b_hash: str):
    """Share of equal numbers among those that either of two fingerprints has: of the band terms if both texts have enough of them,
    else of all terms; without terms: whether the texts are equal."""
    def share(x: str, y: str) -> str:
        either = f"size(filter(zip_with({x}, {y}, (x, y) -> x is not null or y is not null), z -> z))"
        return f"cast(size(filter(zip_with({x}, {y}, (x, y) -> coalesce(x = y, false)), z -> z)) as double) / {either}"

    return F.expr(f"case when {a_every} is null and {b_every} is null then if({a_hash} = {b_hash}, 1.0D, 0.0D) when {a_every} is null or {b_every} is null then 0.0D "
                  f"when {a} is null or {b} is null then {share(a_every, b_every)} else {share(a, b)} end")


def _ranges(rows: DataFrame) -> DataFrame:
    """``rows`` with ``low``: the lower end of the largest aligned range of ``key`` around it that has at most ``BUCKET`` rows of its ``part``.

    Rows are counted for each 1024 keys, and only these numbers are added up to larger ranges. So dense and sparse keys give ranges of
    hundreds to thousands of rows alike.
    """
    fine = save(rows.groupBy("part", F.shiftright("key", FINE).alias("block")).agg(F.count(F.lit(1)).alias("n")), "blocks")
    every = fine.select("part", "block", "n", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level")).withColumn("up", F.expr(f"shiftright(block, {STEP} * level)"))
    light = save(every.groupBy("part", "level", "up").agg(F.sum("n").alias("n")).where(F.col("n") <= BUCKET).select("part", "level", "up"), "ranges")
    level = every.drop("n").join(small(light), ["part", "level", "up"], "left_semi").groupBy("part", "block").agg(F.max("level").alias("level"))
    level = save(fine.join(small(save(level, "levels")), ["part", "block"], "left").select("part", "block", F.coalesce("level", F.lit(0)).alias("level")), "levels")
    low = F.expr(f"shiftleft(shiftright(key, {FINE} + {STEP} * level), {FINE} + {STEP} * level)")
    return rows.withColumn("block", F.shiftright("key", FINE)).join(small(level), ["part", "block"]).withColumn("low", low).drop("block", "level")


def _following(ranges: DataFrame) -> DataFrame:
    """``(part, low, next_part, next_low)``: the range that follows each in descending order; after the last comes the first.

    Ranges are sorted by the cluster and numbered in place. A range's follower has the next number; only the first ranges of each
    partition, as many as there are partitions, are put into one order.
    """
    order = [F.col("part").desc(), F.col("low").desc()]
    sort = save(ranges.select("part", "low").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "order")
    ahead = sort.select((F.col("at") - 1).alias("at"), F.col("part").alias("next_part"), F.col("low").alias("next_low"))
    firsts = sort.where(F.col("at").bitwiseAND((1 << 33) - 1) == 0).select(F.shiftright("at", 33).alias("task"), F.struct("part", "low").alias("first"))
    by_task = Window.orderBy("task")
    whole = by_task.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrap = firsts.select("task", F.coalesce(F.lead("first").over(by_task), F.first("first").over(whole)).alias("wrap"))
    out = sort.join(small(ahead), "at", "left").withColumn("task", F.shiftright("at", 33)).join(F.broadcast(wrap), "task")  # a row for each partition
    return out.select("part", "low", F.coalesce("next_part", "wrap.part").alias("next_part"), F.coalesce("next_low", "wrap.low").alias("next_low"))


def _after(heads: DataFrame, following: DataFrame, name: str) -> DataFrame:
    """The ``head`` of the range that follows each, as ``name``."""
    heads = heads.select(F.col("part").alias("next_part"), F.col("low").alias("next_low"), F.col("head").alias(name))
    return small(following).join(heads, ["next_part", "next_low"]).select("part", "low", name)


def edited_fingerprints(docs: DataFrame, min_idf: float = math.log(50), max_idf: float = math.log(1000)) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last half of the characters, rounded down, replaced by as many first characters of the next
    document in descending order of ``doc_id``; after the last comes the first. Null texts are empty. Rows that repeat an id
    follow each other by text, and rows without an id come last. A single row is its own next. Texts with few
    band terms are compared by all their terms, and texts without terms have their text's hash for a fingerprint. Texts are taken whole,
    whatever their length; other columns are not read. An empty table gives an empty result.

    Texts are shuffled once, by ranges of ids (of the texts' first bytes, for rows without one), and everything up to the fingerprints happens
    there; a neighbour across ranges comes from a table with one row a range. Ids may be dense or sparse; rows that
    repeat one id, or without id one beginning of seven bytes, are ordered in one task.
    """
    begin = F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # part 1 has the ids as keys; without doc_id beside them, both uses of the shuffled texts below are one
    rows = rows.select(F.when(F.col("doc_id").isNull(), 0).otherwise(1).alias("part"), F.coalesce("doc_id", -begin).alias("key"), "text")
    words = save(lexicon(rows, "text", min_idf, max_idf).select("term"), "lexicon")
    if words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = _ranges(rows)
    heads = save(rows.groupBy("part", "low").agg(F.min_by("text", F.struct(F.bitwise_not("key"), "text")).alias("head")), "heads")
    following = save(_following(heads), "following")
    heads = save(_after(heads, following, "_after"), "heads")
    bucket = ["part", "low"]
    order = Window.partitionBy(*bucket).orderBy(F.col("key").desc(), "text")
    near = rows.withColumns({"rn": F.row_number().over(order), "_next": F.lead("text").over(order)}).join(heads, bucket)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("_next", "_after"), F.lit(1), half))
    pair = near.select(*bucket, "rn", "key", "text", edited.alias("edited"))

    versions = pair.select(*bucket, "rn", F.explode(F.array(F.struct(F.lit(0).alias("version"), "text"), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")))).alias("v"))
    found = fingerprints(versions.select(*bucket, "rn", "v.*"), [*bucket, "rn", "version"], "text", words)
    of = lambda v: F.first(F.when(F.col("version") == v, F.struct("prints", "every")), ignorenulls=True)
    found = found.groupBy(*bucket, "rn").agg(of(0).alias("own"), of(1).alias("edit"))
    found = found.select(*bucket, "rn", *[F.col(f"{v}.{c}").alias(f"{v}_{c}") for v in ("own", "edit") for c in ("prints", "every")])
    facts = pair.select(*bucket, "rn", F.when(F.col("part") == 1, F.col("key")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("own_hash"), F.xxhash64("edited").alias("edit_hash"))
    done = save(facts.join(found, [*bucket, "rn"], "left"), "prints")

    whole = F.struct("own_prints", "own_every", "own_hash")
    heads = _after(done.where("rn = 1").select(*bucket, whole.alias("head")), following, "_after")
    after = F.coalesce(F.lead(whole).over(Window.partitionBy(*bucket).orderBy("rn")), F.col("_after"))
    out = done.join(heads, bucket).withColumn("_n", after).withColumns({f"next_{c}": F.col(f"_n.own_{c}") for c in ("prints", "every", "hash")})
    like = lambda v: likeness(*[f"{x}_{c}" for c in ("prints", "every", "hash") for x in ("own", v)])
    return out.select("doc_id", "n_chars", "edited_sha256", printed("own_prints", "own_every", "own_hash").alias("fingerprint"), printed("edit_prints", "edit_every", "edit_hash").alias("edited_fingerprint"),
                      like("edit").alias("near_edited"), like("next").alias("near_next"))
