"""Licence scans in DataFrame functions and Spark ML only.

Lines are classified by a multinomial logistic regression over hashed word n-grams, trained on windows of licence texts and notices
against prose. Neighbouring lines that may belong to a notice are joined to paragraphs, without comment marks and line ends, and
classified again as a whole. The probability is calibrated on held-out windows and on licences of no known family; below
one half the class is ``unknown``. A prediction counts when the paragraph's word pairs agree with a template of its family, and
with no other family's better.
"""
from __future__ import annotations

import functools
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import documents, save
from quillon.llm.license_texts import CC_SHORT, CC_VERSIONS, FRAMES, NAMES, PARAGRAPHS, PART_OF, PROSE, SPDX, UNLISTED, WHOLE

NONE, UNKNOWN = "none", "unknown"
FAMILIES = sorted({*NAMES, *PARAGRAPHS})
WORD = r"[^\p{L}\p{N}]+"
#: Words of which a notice that only names its licence has one.
CUE = "(?i)licen[sc]|released|distributed|available|under|terms|spdx|dedicat"
#: A notice that says that a licence does not hold; up to so many words it cannot be a licence's own text.
NEGATED, NOTICE_WORDS = r"(?i)\b(?:not|no longer|never|nor|isn't|aren't|wasn't)\b[^.;!?]*\b(?:licen[sc]ed|licen[sc]ing|covered|released|distributed|available|offered)\b", 20
#: Licence expressions: what stands before one, what parts its names, and the longest line that is read as one.
LEAD = r"(?i)^.*(?:spdx-license-identifier:|licen[sc]ed\s+under|licen[sc]ed|licen[sc]es?\s*:|\bunder)(?:\s+(?:the\s+)?terms\s+of)?(?:\s+(?:either|both))?(?:\s+the)?(?!\w)"
PARTS, EXPRESSION = r"(?i)\s+(?:or|and|with)\s+(?:the\s+)?|\s*[/,|]\s*|[()]", 200
#: Feature buckets; documents and lines of the corpus that training sees, as a mean (they are chosen by hash).
BUCKETS, TRAIN_DOCUMENTS, TRAIN_LINES = 1 << 12, 4000, 4000
#: A line may belong to a notice if its probability of ``none`` is below this.
SEED = 0.9
#: Share of a template's word pairs, or of the paragraph's, that have to agree.
AGREE = 0.6


def _sql_words(text: str) -> str:
    return rf"filter(split(lower({text}), '{WORD.replace(chr(92), chr(92) * 2)}'), w -> w <> '')"


def _pairs(words: str) -> str:
    """SQL of the distinct pairs of neighbouring words; a single word is a pair of its own."""
    return f"array_distinct(if(size({words}) < 2, {words}, transform(sequence(1, size({words}) - 1), i -> concat({words}[i - 1], ' ', {words}[i]))))"


def _literal(rows: list[tuple], schema: str, spark: SparkSession) -> DataFrame:
    """A small fixed table, as one JSON literal: plans stay small."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ':') for x in schema.split(', '))}>>")))


def _names() -> list[tuple[str, str]]:
    """Family and name: names in full, and short ones with their versions."""
    return [(f, n) for f, names in NAMES.items() for n in names] + [(f, f"{n} {v}") for f, n in CC_SHORT.items() for v in CC_VERSIONS]


def templates(spark: SparkSession) -> DataFrame:
    """``(family, kind, template, words, pairs)``: kind ``text`` (a paragraph), ``name`` (all its pairs have to be there) or ``whole`` (and
    nothing else, but for a copyright mark or whole sentences before)."""
    rows = [(f, "text", t) for f, texts in PARAGRAPHS.items() for t in texts] + [(f, "name", n) for f, n in _names()]
    rows += [(f, "name", f"SPDX-License-Identifier: {x}") for f, ids in SPDX.items() for x in ids] + [(f, "whole", t) for f, texts in WHOLE.items() for t in texts]
    out = _literal(rows, "family string, kind string, template string", spark).withColumn("words", F.expr(_sql_words("template")))
    return out.withColumn("pairs", F.expr(_pairs("words")))


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, at, line)`` of every line with letters or digits."""
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.where(F.col("line").rlike(r"[\p{L}\p{N}]"))


def _chosen(df: DataFrame, by: Column, n: int) -> DataFrame:
    """About ``n`` rows by hash: a count and a filter, whatever the number of rows."""
    return df.where(F.pmod(by, F.lit(max(1, df.count() // n))) == 0)


def _training(docs: DataFrame) -> DataFrame:
    """``(family, line, held)``: windows of templates, alone and between other words, prose that names licences, licences of no family, and
    lines of the corpus that mention none. A quarter, chosen by hash, is held out."""
    spark = docs.sparkSession
    phrases = [(f, frame.format(n)) for f, n in _names() for frame in FRAMES] + [(f, t) for f, texts in WHOLE.items() for t in texts] * 10
    phrases += [(f, f"SPDX-License-Identifier: {x}") for f, ids in SPDX.items() for x in ids]
    around = lambda t: F.explode(F.array(t, F.concat(t, F.lit(" see the file for details")), F.concat(F.lit("copyright 2024 by the authors "), t), F.concat(F.lit("the text and all of its parts are "), t)))
    short = _literal(phrases, "family string, t string", spark).select("family", around(F.col("t")).alias("line"))
    texts = [(f, t) for f, ts in PARAGRAPHS.items() for t in ts] + [(NONE, t) for t in PROSE] + [(UNKNOWN, t) for t in UNLISTED]
    # windows of the width of a line, every third word on, and paragraphs as they are
    cut = "flatten(transform(array(8, 14, 24), n -> transform(sequence(0, greatest(0, size(w) - n), 3), a -> array_join(slice(w, a + 1, n), ' '))))"
    # a text that holds another family's is that family's in part, and stays whole
    cuts = [(f, t, not any(o != t and o.rstrip(".") in t for _, o in texts)) for f, t in texts]
    long = _literal(cuts, "family string, t string, cut boolean", spark).withColumn("w", F.expr(_sql_words("t")))
    long = long.select("family", F.explode(F.expr(f"concat(array(t, t, t, t), if(cut, array_distinct({cut}), array()))")).alias("line"))
    some = _chosen(documents(docs), F.xxhash64("doc_id", F.lit(1)), TRAIN_DOCUMENTS)
    corpus = save(lines(some).where(~F.col("line").rlike("(?i)licen[sc]|copyright|warrant|redistribut|permission|rights reserved|spdx|public domain|free software")).select("line"), "license-lines")
    corpus = _chosen(corpus, F.xxhash64("line", F.lit(2)), TRAIN_LINES).select(F.lit(NONE).alias("family"), "line")
    rows = short.union(long).union(corpus)
    # unlisted licences are held out by text, so that none is known from its other windows
    unlisted = _literal([(t, i % 2 == 0) for i, t in enumerate(UNLISTED)], "t string, out boolean", spark)
    unlisted = unlisted.withColumn("w", F.expr(_sql_words("t"))).select(F.explode(F.expr(f"array_distinct(concat(array(t), {cut}))")).alias("line"), "out").groupBy("line").agg(F.max("out").alias("out"))
    return rows.join(F.broadcast(unlisted), "line", "left").select("family", "line", F.when(F.col("family") == UNKNOWN, F.col("out")).otherwise(F.pmod(F.xxhash64("line"), F.lit(4)) == 0).alias("held"))


class Model:
    """A fitted pipeline, its classes in order, and slope and shift that turn the best class's log odds into those of being right."""

    def __init__(self, pipeline: PipelineModel, classes: list[str], slope: float = 1.0, shift: float = 0.0):
        self.pipeline, self.classes, self.slope, self.shift = pipeline, classes, slope, shift

    def best(self, rows: DataFrame) -> DataFrame:
        """Adds ``best``, ``odds`` (log odds of the best class) and ``p_none``."""
        out = self.pipeline.transform(rows).withColumn("_p", vector_to_array("probability")).drop("words", "twos", "f1", "f2", "features", "rawPrediction", "probability")
        names, top = F.array(*[F.lit(c) for c in self.classes]), F.least(F.array_max("_p"), F.lit(1 - 1e-9))
        return out.select("*", F.element_at(names, F.col("prediction").cast("int") + 1).alias("best"), F.log(top / (1 - top)).alias("odds"), F.element_at("_p", 1).alias("p_none")).drop("_p", "prediction")

    def classify(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` (``none``, ``unknown`` or a name) and the calibrated ``probability`` of the best class."""
        sure = 1 / (1 + F.exp(-(F.lit(self.slope) * F.col("odds") + F.lit(self.shift))))
        out = self.best(rows).withColumn("probability", sure)
        return out.withColumn("family", F.when(F.col("best").isin(NONE, UNKNOWN) | (F.col("probability") >= 0.5), F.col("best")).otherwise(UNKNOWN)).drop("best", "odds", "p_none")


def fit(docs: DataFrame) -> Model:
    """Trains on three quarters of all template windows, of prose that names licences and of about ``TRAIN_LINES`` corpus lines, of at most
    so many words as they have. The rest, and half of the licences of no family, calibrate (a logistic fit on log odds)."""
    rows = save(_training(docs), "license-training")
    classes = [NONE, UNKNOWN, *FAMILIES]
    number = F.element_at(F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))]), F.col("family"))
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol="line", outputCol="words", pattern=WORD), NGram(n=2, inputCol="words", outputCol="twos"),
        HashingTF(numFeatures=BUCKETS // 2, inputCol="words", outputCol="f1", binary=True), HashingTF(numFeatures=BUCKETS, inputCol="twos", outputCol="f2", binary=True),
        VectorAssembler(inputCols=["f1", "f2"], outputCol="features"),
        LogisticRegression(family="multinomial", regParam=2e-4, maxIter=40, standardization=False)])
    # a few thousand rows: in so few tasks that gradients need no shuffle
    model = Model(pipeline.fit(rows.where("not held").coalesce(4).withColumn("label", number)), classes)
    said = model.best(rows.where("held")).where(~F.col("best").isin(NONE, UNKNOWN)).select("odds", F.when(F.col("best") == F.col("family"), 1.0).otherwise(0.0).alias("label"))
    said = save(said, "license-calibration")
    if said.select("label").distinct().count() == 2:
        found = LogisticRegression(regParam=1e-3).fit(VectorAssembler(inputCols=["odds"], outputCol="features").transform(said))
        if found.coefficients[0] > 0:
            model.slope, model.shift = float(found.coefficients[0]), float(found.intercept)
    return model


def held_out(docs: DataFrame, model: Model) -> DataFrame:
    """``(family, rows, found, right)`` over the held-out training rows: how many have the family, get it, and rightly."""
    said = save(model.classify(_training(docs).where("held").withColumnRenamed("family", "truth")).select("truth", "family"), "license-held")
    true = said.groupBy(F.col("truth").alias("family")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("truth") == F.col("family")).alias("right"))
    found = said.groupBy("family").agg(F.count(F.lit(1)).alias("found"))
    return true.join(found, "family", "left").select("family", "rows", F.coalesce("found", F.lit(0)).alias("found"), "right")


def _confirmed(units: DataFrame, unit: list[str]) -> DataFrame:
    """``units`` with ``agreement`` of the predicted family's best template, whether it is ``confirmed``, and whether by a name (``named``).

    Word pairs of the paragraphs (and single words, for names of one word) meet those of the templates in a join, whose template side is a fixed
    list. Units are few: lines and paragraphs that are predicted to be a licence.
    """
    t = templates(units.sparkSession).select(F.xxhash64("family", "kind", "template").alias("t"), F.col("family").alias("t_family"), "kind", F.lower("template").alias("t_text"), F.size("pairs").alias("t_pairs"), F.explode("pairs").alias("pair"))
    own = units.withColumn("_w", F.expr(_sql_words("line"))).withColumn("_p", F.expr(_pairs("_w")))
    met = own.select(*unit, "family", "line", F.size("_p").alias("n"), F.explode(F.array_union("_p", "_w")).alias("pair")).join(F.broadcast(t), "pair")
    met = met.groupBy(*unit, "t").agg(F.count(F.lit(1)).alias("both"), *[F.first(c).alias(c) for c in ("family", "line", "n", "t_family", "kind", "t_text", "t_pairs")])
    all_there = F.col("both") >= F.col("t_pairs")
    share = (F.when(F.col("kind") == "name", F.when(all_there & (F.col("line").rlike(CUE) | (F.col("n") <= F.col("t_pairs") + 1)), 1.0).otherwise(0.0))
             .when(F.col("kind") == "whole", F.when(all_there & F.expr("(line rlike '(?i)copyright|[(]c[)]|©' or lower(line) rlike concat('(^|[.!?] +)[^a-z]*', t_text, '[^a-z]*$'))"), 1.0).otherwise(0.0))
             .otherwise(F.least(F.lit(1.0), F.greatest(F.col("both") / F.col("t_pairs"), F.when(F.col("n") >= 6, F.col("both") / F.col("n")).otherwise(0.0)))))
    negated = F.col("line").rlike(NEGATED) & ((F.col("kind") == "name") | (F.col("n") < NOTICE_WORDS))
    met = met.withColumn("share", F.when(negated, 0.0).otherwise(share)).groupBy(*unit).agg(F.max("share").alias("most"), F.max(F.when(F.col("t_family") == F.col("family"), F.col("share"))).alias("agreement"),
                                                                F.max(F.when((F.col("t_family") == F.col("family")) & (F.col("kind") != "text"), F.col("share"))).alias("by_name"))
    met = met.select(*[F.col(c).alias(f"k_{c}") for c in unit], "most", "agreement", "by_name")
    out = units.join(met, _same(unit, "k_"), "left").select(*units.columns, F.coalesce("agreement", F.lit(0.0)).alias("agreement"), "most", F.coalesce(F.col("by_name") >= 1, F.lit(False)).alias("named"))
    return out.withColumn("confirmed", (F.col("agreement") >= AGREE) & (F.col("agreement") >= F.col("most") - 0.02) & ~F.col("family").isin(NONE, UNKNOWN)).drop("most")


def _expressions(rows: DataFrame, unit: list[str], model: Model) -> DataFrame:
    """``rows`` once for each family of a licence expression (names parted by ``or``, ``and``, ``with``, commas or slashes), with ``family``, ``probability`` and ``agreement``. A line is one if
    all its names are those of licences and the model says the same of each; what follows ``with`` is an exception and need not be known."""
    words = lambda c: F.concat_ws(" ", F.expr(_sql_words(c)))
    spark = rows.sparkSession
    known = [(f, n) for f, n in _names()] + [(f, x) for f, ids in SPDX.items() for x in ids]
    known = _literal(known, "t_family string, name string", spark)
    known = known.select("t_family", F.explode(F.array(words("name"), F.concat(words("name"), F.lit(" license")))).alias("t_words")).groupBy("t_words").agg(F.min("t_family").alias("t_family"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", LEAD, ""), r"(?i),\s*version", " version"), r"(?i)\s+with\s+[\w.-]*exception[\w.-]*", "")
    parts = F.filter(F.transform(F.split(text, PARTS), lambda x: F.trim(F.regexp_replace(x, r"^[\s:.;*#-]+|[\s:.;*#-]+$", ""))), lambda x: x != "")
    some = rows.where((F.length("line") <= EXPRESSION) & F.col("line").rlike(PARTS) & ~F.col("line").rlike(NEGATED)).withColumn("_parts", parts).where("size(_parts) between 2 and 8")
    each = some.select(*unit, F.size("_parts").alias("_n"), F.explode("_parts").alias("_part")).withColumn("t_words", words("_part"))
    each = save(each.join(F.broadcast(known), "t_words"), "license-parts")
    frame = F.when(F.col("_part").contains(" "), F.concat(F.lit("licensed under the "), F.col("_part"))).otherwise(F.concat(F.lit("SPDX-License-Identifier: "), F.col("_part")))
    said = model.classify(each.withColumn("line", frame)).where("family = t_family")
    whole = said.groupBy(*unit, "_n").agg(F.count(F.lit(1)).alias("_found"), F.collect_set(F.struct("family", "probability")).alias("_f")).where("_found = _n")
    whole = whole.select(*[F.col(c).alias(f"e_{c}") for c in unit], F.explode("_f").alias("_f")).select("*", "_f.family", "_f.probability").drop("_f")
    whole = whole.groupBy(*[f"e_{c}" for c in unit], "family").agg(F.max("probability").alias("probability"))
    return rows.join(whole, _same(unit, "e_")).select(*rows.columns, "family", "probability", F.lit(1.0).alias("agreement"))


def _same(names: list[str], prefix: str) -> Column:
    """Columns that equal those with a prefix, nulls included."""
    return functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{prefix}{n}")) for n in names])


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Licence paragraphs: ``(doc_id, text_hash, first, last, line, family, probability, agreement, confirmed)``, ``first`` and ``last`` being line numbers.

    A notice that denies a licence ("not licensed under ...") confirms none. An expression of several names comes as a row for each of their families.

    Every line of every whole text is classified. Lines that may belong to a notice, with at most one other line between two of them, are one
    paragraph. A confirmed paragraph comes as one row, and lines of it that name another family as further
    rows; of a paragraph that is not confirmed come its confirmed lines, or one row ``unknown`` if its class is not ``none``.
    Rows that repeat id and text are scanned as one. Texts are taken whole, whatever their length; an empty table gives no rows.
    """
    model = model or fit(docs)
    seeds = model.best(lines(docs)).where(F.col("p_none") < SEED).select("doc_id", "text_hash", "at", "line").dropDuplicates(["doc_id", "text_hash", "at"])
    text = Window.partitionBy("doc_id", "text_hash").orderBy("at")
    runs = save(seeds, "license-lines").withColumn("new", F.when(F.col("at") - F.lag("at").over(text) <= 2, 0).otherwise(1)).withColumn("run", F.sum("new").over(text)).drop("new")
    runs = save(runs, "license-runs")
    key = ["doc_id", "text_hash", "run"]
    joined = runs.groupBy(*key).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ").alias("line"))
    whole = save(_confirmed(save(model.classify(joined), "license-whole"), key), "license-whole")
    several = runs.join(whole.where("last > first").select(*[F.col(c).alias(f"r_{c}") for c in key], F.col("family").alias("r_family"), F.col("confirmed").alias("r_confirmed")),
                        _same(key, "r_"))
    single = model.classify(several.select(*key, "at", "line", "r_family", "r_confirmed")).where(~F.col("family").isin(NONE, UNKNOWN))
    single = _confirmed(save(single, "license-single"), [*key, "at"]).where("confirmed and (not r_confirmed or named and family <> r_family)")
    single = save(single.select(*key, F.col("at").alias("first"), F.col("at").alias("last"), "line", "family", "probability", "agreement", "confirmed"), "license-single")
    stated = _expressions(runs.select(*key, "at", "line"), [*key, "at"], model).select(*key, F.col("at").alias("first"), F.col("at").alias("last"), "line", "family", "probability", "agreement", F.lit(True).alias("confirmed"))
    said = whole.where("confirmed").select(*[F.col(c).alias(f"r_{c}") for c in [*key, "family"]])
    stated = save(stated.join(said, _same([*key, "family"], "r_"), "left_anti"), "license-stated")
    once = stated.select(*[F.col(c).alias(f"r_{c}") for c in [*key, "first"]]).distinct()
    single = single.join(once, _same([*key, "first"], "r_"), "left_anti").union(stated)
    rest = whole.join(single.select(*[F.col(c).alias(f"r_{c}") for c in key]).distinct(), _same(key, "r_"), "left_anti")
    rest = rest.where(~F.col("confirmed") & (F.col("family") != NONE)).withColumn("family", F.lit(UNKNOWN))
    cols = ["doc_id", "text_hash", "first", "last", "line", "family", "probability", "agreement", "confirmed"]
    return whole.where("confirmed").select(cols).union(single.select(cols)).union(rest.select(cols))


def document_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_lines, n_licenses, n_unknown, families, probability)`` of every row.

    ``families`` are the confirmed families, sorted and joined by commas (empty: none), without those whose text is part of another's that is
    there too. Null and empty texts have no lines. Rows that repeat an id have what their own text has, and so do rows without an
    id. An empty table gives an empty result.
    """
    n = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))).cast("long")
    every = documents(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), n.alias("n_lines"))
    found = save(scan(docs, model), "licenses")
    found = found.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("h")).agg(
        F.count_if("confirmed").alias("n_licenses"), F.count_if(~F.col("confirmed")).alias("n_unknown"), F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("f"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"))
    part = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in sorted(PART_OF.items())])
    less = F.array_except("f", F.transform(F.filter(part, lambda x: F.array_contains(F.col("f"), x["b"])), lambda x: x["a"]))
    found = found.withColumn("families", F.array_join(F.array_sort(less), ","))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
    return out.select("doc_id", "n_lines", zero("n_licenses"), zero("n_unknown"), F.coalesce("families", F.lit("")).alias("families"), "probability")
