"""Toxicity scores by gradient-boosted trees over dense features.

Features of a text: densities of lexicon words and of word beginnings, hits that appear only after
spelled-out characters are put back, hits near a second-person pronoun, capitals, punctuation, symbols
inside words, repeated characters, and length. All are built-in expressions over the whole text, so a
score costs one pass and no exchange of texts.

The labelled rows are dealt to three parts by a hash of their text: the lexicon is learned on the first,
the trees on the second, and an isotonic calibration of their output on the third. At most
``Training.rows`` labelled rows are used, taken in hash order; they are the only sample.

Null and empty texts have the features of no words and get a score like any other. Labels that are null
are not used; rows that repeat an id are scored each. If either label is missing in a part, all scores are
the share of toxic rows that was found (0 without any). Very long texts are used whole. Columns named like the
results are replaced, all others are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from savanto.llm.common import whole_text
from savanto.session import written

#: Second-person words (fixed values).
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vuestro".split()
#: Characters that stand for letters (fixed values).
STANDING_FOR = ("0134578@$!|", "oieastbasii")


@dataclass(frozen=True)
class Training:
    """Bounds and parameters of the fit."""

    rows: int = 20_000
    #: Entries of each lexicon; the fewest toxic rows that have one, and the least part of all toxic rows;
    #: and the least share of toxic rows among those that have it.
    entries: int = 1000
    least_rows: int = 3
    least_part: float = 0.01
    least_share: float = 0.8
    #: Letters of a word beginning.
    beginning: int = 4
    trees: int = 20
    depth: int = 3
    threshold: float = 0.3


@dataclass(frozen=True)
class Lexicon:
    words: tuple[str, ...] = ()
    beginnings: tuple[str, ...] = ()
    letters: int = 4


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def beginning(word: Column, letters: int) -> Column:
    """The first letters of a longer word."""
    return F.when(F.length(word) > letters, F.substring(word, 1, letters))


def among(value: Column, entries: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*entries), F.lit(False)) if entries else F.lit(False)


def features(docs: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, list[str]]:
    """All columns of ``docs`` with the feature columns, and their names."""
    text = F.col("__text")
    word = lambda w: (  # noqa: E731  the class of a word as one character
        F.when(among(w, lexicon.words), "L").when(w.isin(*SECOND_PERSON), "Y").when(among(beginning(w, lexicon.letters), lexicon.beginnings), "B").otherwise(".")
    )
    # words with characters that may stand for letters, put back and looked up again
    disguised = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}@$!|*]*\p{L}[0134578@$!|*][\p{L}\p{N}@$!|*]*|[0134578@$!|*]\p{L}[\p{L}\p{N}@$!|*]*)"), F.lit(1)),
        lambda w: among(F.translate(w, *STANDING_FOR), lexicon.words),
    )
    classed = (
        docs.withColumn("__text", whole_text())
        .withColumn("__classes", F.array_join(F.transform(plain_words(text), word), ""))
        .withColumn("__disguised", F.size(disguised))
    )
    classes = F.col("__classes")
    n_words, n_chars = F.length(classes), F.length(text)
    share = lambda n, of: n / F.greatest(of, F.lit(1))
    count = lambda pattern, of=text: F.regexp_count(of, F.lit(pattern)).cast("double")
    made = {
        "lexicon_density": share(count("L", classes), n_words),
        "lexicon_hits": F.log1p(count("L", classes)),
        "beginning_density": share(count("B", classes), n_words),
        "beginning_hits": F.log1p(count("B", classes)),
        "disguised_hits": F.log1p(F.col("__disguised").cast("double")),
        "second_person_near": F.log1p(count("[LB].{0,3}Y|Y.{0,3}[LB]", classes)),
        "second_person_density": share(count("Y", classes), n_words),
        "capitals": share(count(r"\p{Lu}"), n_chars),
        "shouted_words": share(count(r"\b\p{Lu}{3,}\b"), n_words),
        "punctuation": share(count(r"\p{P}"), n_chars),
        "exclamations": share(count("[!?]"), n_chars),
        "symbols_in_words": share(count(r"\p{L}[0-9@$*#]\p{L}"), n_words),
        "repeats": share(count(r"(.)\1\1"), n_words),
        "length": F.log1p(n_words.cast("double")),
    }
    names = [f"__f_{name}" for name in made]
    out = classed.select(*docs.columns, *[v.cast("double").alias(n) for n, v in zip(names, made.values(), strict=True)])
    return out, names


def learn_lexicon(rows: DataFrame, training: Training) -> Lexicon:
    """Entries that toxic rows have and others hardly do, the surest first."""

    least = max(training.least_rows, training.least_part * rows.agg(F.sum("toxic")).first()[0])

    def entries(of_row: Column) -> tuple[str, ...]:
        units = rows.select("toxic", F.explode(F.array_distinct(of_row)).alias("entry")).where("entry is not null")
        n = units.groupBy("entry").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
        share = F.col("bad") / F.col("n")
        best = n.where((F.col("bad") >= least) & (share >= training.least_share))
        return tuple(r["entry"] for r in best.orderBy(F.desc(share * F.log1p("bad")), "entry").limit(training.entries).collect())

    words = plain_words(F.col("text"))
    return Lexicon(
        entries(words),
        entries(F.transform(words, lambda w: beginning(w, training.beginning))),
        training.beginning,
    )


@dataclass(frozen=True)
class Model:
    """What :func:`fit` learned; without trees every score is ``prior``."""

    lexicon: Lexicon
    prior: float
    trees: PipelineModel | None = None
    calibration: object | None = None
    threshold: float = 0.3


def fit(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:  # noqa: B008
    """Learn from the rows of ``labels`` (``doc_id``, ``toxic``) that ``docs`` has."""
    one_each = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = one_each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.rows)
    # at most training.rows rows of two numbers
    sample = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(sample.withColumn("part", F.pmod(F.xxhash64("text", F.lit(7)), F.lit(10))), "labelled")
    part = {"lexicon": sample.where("part < 4"), "trees": sample.where("part between 4 and 7"), "calibration": sample.where("part > 7")}
    n, bad = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    counts = {r["part"]: (r["n"], r["bad"]) for r in sample.groupBy(F.when(F.col("part") < 4, "lexicon").when(F.col("part") < 8, "trees").otherwise("calibration").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()}
    prior = (bad or 0) / n if n else 0.0
    if any(not counts.get(name, (0, 0))[1] or counts[name][1] == counts[name][0] for name in part):
        return Model(Lexicon(), prior, threshold=training.threshold)
    lexicon = learn_lexicon(part["lexicon"], training)
    rows, names = features(part["trees"].select("text", "toxic"), lexicon)
    assembler = VectorAssembler(inputCols=names, outputCol="__features")
    boosted = GBTClassifier(
        featuresCol="__features", labelCol="toxic", predictionCol="__class",
        maxIter=training.trees, maxDepth=training.depth, stepSize=0.2, seed=1, checkpointInterval=-1,
    ).setProbabilityCol("__probability").setRawPredictionCol("__raw")
    model = PipelineModel([assembler, boosted.fit(assembler.transform(written(rows, "features").coalesce(4)))])
    held, _ = features(part["calibration"].select("text", "toxic"), lexicon)
    output = model.transform(held).select(vector_to_array("__probability")[1].alias("__p"), F.col("toxic").cast("double").alias("toxic"))
    calibration = IsotonicRegression(featuresCol="__p", labelCol="toxic", predictionCol="__score").fit(written(output, "calibration"))
    return Model(lexicon, prior, model, calibration, training.threshold)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    if model.trees is None:
        out = docs.drop("score", "predicted").withColumn("score", F.lit(float(model.prior)))
    else:
        rows, _ = features(docs.drop("score", "predicted"), model.lexicon)
        output = model.trees.transform(rows).withColumn("__p", vector_to_array("__probability")[1])
        kept = [c for c in docs.columns if c not in ("score", "predicted")]
        out = model.calibration.transform(output).select(*kept, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's labels may not be learned from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
