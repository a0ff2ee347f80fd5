"""Document quality learned from preferences between pairs of documents.

Every text becomes a fixed vector of features. A document labelled good is preferred to
one labelled bad; the Bradley-Terry model says it wins with probability
``sigmoid(w . (x_good - x_bad))``, and the weights follow from the logistic loss on the
feature differences of a bounded sample. The score ``w . x`` of all labelled documents is
cut at the quantile that leaves as large a share below as the labels call bad; the cut
becomes 0.7 on the scale from 0 to 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from censusloom.llm.common import map_batches, remainder, stored
from censusloom.llm.line_rules import repeat_words

TRAINING_DOCUMENTS = 20_000
ROUNDS = 3
CUT_SCORE = 0.7
REGULARISATION = 1e-3
_RANK_ACCURACY = 100_000  # ranks of scores are exact to this part of their number

FEATURES = (
    "log_words", "mean_word", "long_words", "upper", "letters", "digits", "symbols", "pipes", "doubled_marks",
    "sentence_ends", "unended_lines", "distinct_words", "top_word", "same_as_previous", "repeated_windows",
    "repeated_lines", "log_line_words", "capitalised",
)


def features(text: str | None) -> list[float]:
    """Shares and logarithms that describe a whole text; zeros for a text without words."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    counts = Counter(words)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    ends = sum(w.endswith((".", "!", "?", "…")) for w in words)
    return [
        math.log1p(n),
        min(chars / n, 30.0) / 10,
        sum(len(w) > 20 for w in words) / n,
        upper / max(1, letters),
        letters / chars,
        sum(map(str.isdigit, text)) / chars,
        sum(map(text.count, "#*$%&<>~^=+\\{}[]")) / n,
        min(1.0, text.count("|") / n),
        min(1.0, (text.count("!!") + text.count("??")) / n),
        ends / n,
        sum(not line.rstrip().endswith((".", "!", "?", "…", '"', ")")) for line in lines) / len(lines),
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        repeat_words(words) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        sum(w[0].isupper() for w in words) / n,
    ]


def with_features(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``features`` for every row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"ident": batch["ident"], "features": [features(t.as_py()) for t in batch["text"]]}

    slim = docs.selectExpr(f"`{ident}` AS ident", f"`{text}` AS text")
    return map_batches(slim, run, "ident bigint, features array<double>").withColumnRenamed("ident", ident)


def preference_pairs(labelled: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``difference`` of features, good minus bad, for ``rounds`` partners of every document.

    ``labelled`` is the bounded training sample (features, good, order). Documents of
    the smaller class meet as many partners as it takes for all of the larger to be used.
    """
    turn = F.row_number().over(Window.partitionBy("good").orderBy("order")) - 1
    sides = labelled.withColumn("turn", turn)
    sizes = {r.good: r["n"] for r in labelled.groupBy("good").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes.get(True, 0), sizes.get(False, 0)
    matches = max(good, bad)
    if not good or not bad:
        return labelled.select(F.col("features").alias("difference")).limit(0)
    # Match m of round r: good m meets bad m + r * stride, each modulo its number.
    matched = labelled.sparkSession.range(matches).select("id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    partner = (F.col("id") + F.col("r") * F.lit(7919)) % F.lit(bad)
    return (
        matched.select((F.col("id") % F.lit(good)).alias("winner"), partner.alias("loser"))
        .join(sides.where("good").select(F.col("turn").alias("winner"), F.col("features").alias("win")), "winner")
        .join(sides.where("NOT good").select(F.col("turn").alias("loser"), F.col("features").alias("lose")), "loser")
        .select(F.zip_with("win", "lose", lambda a, b: a - b).alias("difference"))
    )


def _dot(weights: Sequence[float], vector: str = "features") -> Column:
    return sum((F.col(vector)[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))


def cut_at_share(scored: DataFrame) -> float:
    """The score between the documents at the share of bad labels, from all rows of (score, good)."""
    rows, bad = scored.agg(F.count("*"), F.count_if(~F.col("good"))).first()
    if not rows:
        return 0.0
    # Ranks ``bad`` and ``bad + 1``, of those there are.
    shares = [(min(max(rank, 1), rows) - 0.5) / rows for rank in (bad, bad + 1)]
    below, above = scored.agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), _RANK_ACCURACY)).first()[0]
    return (below + above) / 2


def fit(sample: DataFrame, rounds: int = ROUNDS, regularisation: float = REGULARISATION) -> tuple[list[float], float]:
    """Weights of the raw features, and the cut: the quantile at the share of bad labels.

    ``sample`` holds (features, good, order) of the training documents, a bounded number.
    Without both labels the weights are zero.
    """
    width = len(FEATURES)
    spread = sample.agg(*[F.stddev_pop(F.col("features")[i]).alias(str(i)) for i in range(width)]).first()
    scales = [1 / s if (s := spread[str(i)]) and s > 1e-9 else 0.0 for i in range(width)]
    pairs = preference_pairs(sample, rounds).select(
        F.array(*[F.col("difference")[i] * F.lit(scale) for i, scale in enumerate(scales)]).alias("difference")
    )
    if pairs.isEmpty():
        return [0.0] * width, 0.0
    # Each preference in both directions, so that the model needs no intercept.
    both = pairs.select("difference", F.lit(1.0).alias("label")).unionByName(
        pairs.select(F.transform("difference", lambda x: -x).alias("difference"), F.lit(0.0).alias("label"))
    )
    rows = both.select(array_to_vector("difference").alias("features"), "label")
    rows = stored(rows, "pairs").repartition(8)
    model = LogisticRegression(
        fitIntercept=False, standardization=False, regParam=regularisation, maxIter=40, aggregationDepth=2
    ).fit(rows)
    weights = [float(c) * s for c, s in zip(model.coefficients, scales, strict=True)]
    return weights, cut_at_share(sample.select(_dot(weights).alias("score"), "good"))


def score(featured: DataFrame, weights: Sequence[float], cut: float) -> Column:
    """Score from 0 to 1 that is 0.7 at the cut."""
    shifted = _dot(weights) - F.lit(cut) + F.lit(math.log(CUT_SCORE / (1 - CUT_SCORE)))
    return 1 / (1 + F.exp(-F.least(F.greatest(shifted, F.lit(-40.0)), F.lit(40.0))))


def classify(
    docs: DataFrame, labels: DataFrame, training_documents: int = TRAINING_DOCUMENTS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document.

    Learns weights from at most ``training_documents`` labelled documents that are not held
    out, those of least md5 of the id, and the cut from all that are not held out. Empty and null texts have zero features and the score
    these give. Rows with repeated or null ids are scored one by one; labels that
    contradict each other count as bad; null labels are not used.
    """
    held_out = remainder("doc_id", 4) == 2
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = known.orderBy(order, "doc_id").limit(training_documents)
    featured = stored(with_features(docs), "features")
    sample = stored(
        featured.join(chosen, "doc_id")
        .dropDuplicates(["doc_id"])
        .select("features", (F.col("quality") == 1).alias("good"), order.alias("order")),
        "training",
    )
    weights, cut = fit(sample)
    if any(weights):
        # One score per id, so that a repeated id is no hot key of the join.
        scored = featured.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(_dot(weights)).alias("score"))
        judged = scored.join(known, "doc_id").select("score", (F.col("quality") == 1).alias("good"))
        cut = cut_at_share(stored(judged, "judged"))
    return featured.select(
        "doc_id", held_out.alias("held_out"), score(featured, weights, cut).alias("score")
    ).withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))
