"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of the letters of its words: a word is padded with starts and
closed by an end sign, and every symbol is predicted from the ``ORDER - 1`` before it.
The highest order uses counts, the lower ones the number of different symbols to the
left. All probabilities are interpolated when the model is made and kept in arrays
sorted by the 64-bit hash of their n-gram, one column per language, next to the back-off
weights of the contexts. A text gets the language of least cross-entropy per symbol.

For rejection every word counts in the language that suits it best, so a text that mixes
known languages stays. Texts far above the labelled documents outside the fit in this open
cross-entropy are in no known language and rejected. The limits are medians and
percentiles over all those documents, so single garbage or mislabelled ones move nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from censusloom.llm.common import claim, free_name, map_batches, remainder, remembered, rows_to_arrow, ship, stored

ORDER = 4
DOCUMENTS_PER_LANGUAGE = 1_000
CALIBRATION_SHARE = 5  # one of so many sampled documents stays outside the fit
LEAST_CALIBRATION = 20  # documents of a language from which its limit is measured
DEVIATIONS = 6.0
LEAST_SLACK = 0.5  # nats per symbol
HIGH_EXCESS = 0.95  # share of the documents whose excess, if any, raises the limit
MAX_MODEL_MB = 512
DISCOUNT_FLOOR = 0.1
UNKNOWN = "und"
_PAD, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MEMO_NUMBERS = 1_200_000  # remembered by one Python worker
_SURE_SYMBOLS = 60
_MEDIAN_TO_DEVIATION = 1.4826  # of a normal distribution


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; empty if the text has no letter."""
    words = _WORD.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def _hashes(grams: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points; its length counts, too."""
    found = np.full(len(grams), grams.shape[1] + 1, np.uint64)
    with np.errstate(over="ignore"):
        for column in grams.T:
            found = (found ^ column.astype(np.uint64)) * _MULTIPLIER
            found ^= found >> np.uint64(29)
    return found


def _codes(grams: Sequence[str]) -> np.ndarray:
    return np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), -1)


@dataclass
class Model:
    """Log-probabilities and back-off weights by hash, one column per language."""

    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order, from 1
    logs: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)  # by length, from 0
    back_offs: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # log-probability of a symbol never seen
    limits: np.ndarray | None = None  # open cross-entropy that long texts may have, by language
    spread: float = 1.0  # its deviation for one symbol

    def megabytes(self) -> float:
        return sum(a.nbytes for a in (*self.keys, *self.logs, *self.context_keys, *self.back_offs)) / 1e6

    def _find(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted hash, or -1."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``ORDER`` code points -> log-probability of the last one, by language."""
        order = grams.shape[1]
        out = np.zeros((len(grams), len(self.languages)))
        open_rows = np.arange(len(grams))
        for size in range(order, 0, -1):
            if not len(open_rows):
                return out
            part = grams[open_rows, order - size :]
            at = self._find(self.keys[size - 1], _hashes(part))
            hit = at >= 0
            out[open_rows[hit]] += self.logs[size - 1][at[hit]]
            missed = open_rows[~hit]
            if size > 1:
                context = self._find(self.context_keys[size - 1], _hashes(part[~hit, :-1]))
                known = context >= 0
                out[missed[known]] += self.back_offs[size - 1][context[known]]
            open_rows = missed
        out[open_rows] += self.floor
        return out

    def word_logs(self, words: Sequence[str]) -> np.ndarray:
        """Log-probability of each word with its end, by language."""
        if not words:
            return np.zeros((0, len(self.languages)))
        padded = (_PAD * (ORDER - 1)).join(["", *(w + _END for w in words)])
        codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
        lengths = np.array([len(w) + 1 for w in words])
        # Word i begins after its pads; its symbols are predicted one by one.
        starts = np.cumsum(lengths + ORDER - 1) - lengths
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        at = np.arange(lengths.sum()) + np.repeat(starts - first, lengths)
        return np.add.reduceat(self.log_probability(windows[at - (ORDER - 1)]), first, axis=0)


def fit(counts: dict[str, Counter], languages: Sequence[str]) -> Model:
    """Models from the counts of padded ``ORDER``-grams per language."""
    model = Model(list(languages))
    columns = len(model.languages)
    # counted[size][language]: gram -> count (highest order) or number of left neighbours
    counted: list[list[Counter]] = [[] for _ in range(ORDER + 1)]
    for language in model.languages:
        grams = counts.get(language, Counter())
        counted[ORDER].append(grams)
        for size in range(ORDER - 1, 0, -1):
            grams = Counter(g[1:] for g in grams)
            counted[size].append(grams)
    alphabet = len({g for one in counted[1] for g in one}) + 1
    model.floor = np.empty(columns)
    # Until measured: no worse than a uniform draw from the language's symbols.
    model.limits = np.log([len(grams) + 1 for grams in counted[1]])
    lower: list[dict[str, float]] = []
    tables: list[list[dict[str, float]]] = []  # by order: language -> gram -> probability
    weights: list[list[dict[str, float]]] = []  # by order: language -> context -> back-off
    for size in range(1, ORDER + 1):
        tables.append([])
        weights.append([])
        for column in range(columns):
            grams = counted[size][column]
            ones, twos = (sum(n == k for n in grams.values()) for k in (1, 2))
            discount = max(DISCOUNT_FLOOR, ones / (ones + 2 * twos)) if ones else DISCOUNT_FLOOR
            totals, kinds = Counter(), Counter()
            for gram, n in grams.items():
                totals[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            weight = {c: discount * kinds[c] / totals[c] for c in totals}
            if size == 1:
                rest = weight.get("", 1.0) / alphabet
                model.floor[column] = math.log(rest)
                table = {g: (n - discount) / totals[""] + rest for g, n in grams.items()}
            else:
                below = lower[column]
                table = {
                    g: (n - discount) / totals[g[:-1]] + weight[g[:-1]] * below[g[1:]] for g, n in grams.items()
                }
            tables[-1].append(table)
            weights[-1].append(weight)
        lower = tables[-1]
    # Every gram seen in some language gets the probability of each language.
    for size in range(1, ORDER + 1):
        contexts = sorted({c for one in weights[size - 1] for c in one})
        hashed = _hashes(_codes(contexts)) if size > 1 else np.empty(0, np.uint64)
        back = np.array([[math.log(w.get(c, 1.0)) for w in weights[size - 1]] for c in contexts])
        by = np.argsort(hashed)
        model.context_keys.append(hashed[by])
        model.back_offs.append(back[by] if size > 1 else back)
        grams = sorted({g for one in tables[size - 1] for g in one})
        codes = _codes(grams)
        if size == 1:
            logs = np.tile(model.floor, (len(grams), 1))
        else:
            below = model.log_probability(codes[:, 1:]) if grams else np.zeros((0, columns))
            context = model._find(model.context_keys[size - 1], _hashes(codes[:, :-1]))
            logs = below + model.back_offs[size - 1][context]
        for column, table in enumerate(tables[size - 1]):
            for row, gram in enumerate(grams):
                if gram in table:
                    logs[row, column] = math.log(table[gram])
        hashed = _hashes(codes)
        by = np.argsort(hashed)
        model.keys.append(hashed[by])
        model.logs.append(logs[by])
    return model


class _Scorer:
    """Scores texts word by word; words already scored are remembered."""

    def __init__(self, model: Model, numbers: int = _MEMO_NUMBERS):
        self.model, self.limit = model, numbers // (len(model.languages) + 5)
        self.rows: dict[str, int] = {}
        # The last column is the best of all; ``suits`` is its language, ``lengths`` the symbols.
        self.logs = np.zeros((0, len(model.languages) + 1))
        self.suits, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text: log-probabilities (by language, open), symbols, symbols of words by the language that suits them."""
        if len(self.rows) > self.limit:
            self.rows, self.logs = {}, self.logs[:0]
            self.suits, self.lengths = self.suits[:0], self.lengths[:0]
        logs = np.zeros((len(texts), self.logs.shape[1]))
        symbols = np.zeros(len(texts), np.int64)
        suited = [np.zeros(0, np.int64)] * len(texts)
        for at, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            rows = self.rows
            fresh = list({w for w in words if w not in rows})
            if fresh:
                rows.update(zip(fresh, range(len(rows), len(rows) + len(fresh)), strict=True))
                found = self.model.word_logs(fresh)
                self._add(found, np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1, len(rows) - len(fresh))
            chosen = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
            logs[at] = self.logs[chosen].sum(axis=0)
            suited[at] = np.bincount(self.suits[chosen], self.lengths[chosen]).astype(np.int64)
            symbols[at] = suited[at].sum()
        return logs, symbols, suited

    def _add(self, found: np.ndarray, lengths: np.ndarray, at: int) -> None:
        if at + len(found) > len(self.logs):
            size = 2 * (at + len(found)) + 1024
            self.logs = np.concatenate([self.logs[:at], np.zeros((size - at, self.logs.shape[1]))])
            self.suits, self.lengths = (np.concatenate([v[:at], np.zeros(size - at, np.int64)]) for v in (self.suits, self.lengths))
        end = at + len(found)
        self.logs[at:end, :-1], self.logs[at:end, -1] = found, found.max(axis=1)
        self.suits[at:end], self.lengths[at:end] = found.argmax(axis=1), lengths


def _scorer(model: Broadcast) -> _Scorer:
    """The scorer of this Python worker; another model replaces it."""
    held = remembered("scorers", dict)
    key = id(model.value)
    if key not in held:
        held.clear()
        held[key] = _Scorer(model.value)
    return held[key]


_SCORES = (
    "lang_pred string, score double, entropy double, open_entropy double, symbols bigint, "
    "suits array<int>, suited array<bigint>"
)


def _score_texts(scorer: _Scorer, texts: Sequence[str | None]) -> dict[str, list]:
    """The columns ``_SCORES``: all that is known of texts before the limits are."""
    names = np.array(scorer.model.languages, object)
    logs, symbols, suited = scorer(texts)
    some, least_one = symbols > 0, np.maximum(symbols, 1)
    entropy = -logs / least_one[:, None]
    entropy, open_entropy = entropy[:, :-1], entropy[:, -1]
    best = entropy.argmin(axis=1)
    least = entropy[np.arange(len(best)), best]
    gap = (entropy - least[:, None]) * np.minimum(symbols, _SURE_SYMBOLS)[:, None]
    places = [np.flatnonzero(s) for s in suited]
    return {
        "lang_pred": np.where(some, names[best], UNKNOWN).tolist(),
        "score": np.where(some, 1 / np.exp(-gap).sum(axis=1), 0.0).tolist(),
        "entropy": [x if s else None for x, s in zip(least.tolist(), some.tolist(), strict=True)],
        "open_entropy": [x if s else None for x, s in zip(open_entropy.tolist(), some.tolist(), strict=True)],
        "symbols": symbols.tolist(),
        "suits": [p.tolist() for p in places],
        "suited": [s[p].tolist() for s, p in zip(suited, places, strict=True)],
    }


def _scored(docs: DataFrame, model: Broadcast, text: str, keep: Sequence[str], names: dict[str, str]) -> DataFrame:
    """The columns ``keep`` of every row and its scores, each called as ``names`` says."""
    ship(docs.sparkSession)
    scores = T._parse_datatype_string(_SCORES)
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType(kept + [T.StructField(names[f.name], f.dataType) for f in scores.fields])
    arrow, owner = rows_to_arrow(scores), __name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        scorer = _scorer(model)
        for batch in batches:
            found = _score_texts(scorer, batch.column(text).to_pylist())
            columns = [batch.column(f.name) for f in kept] + [pa.array(found[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _rejected(model: Model, names: dict[str, str]) -> Column:
    """Whether the open cross-entropy exceeds what the languages of the words allow."""
    symbols, entropy, suits, suited = (F.col(names[n]) for n in ("symbols", "open_entropy", "suits", "suited"))
    limits = F.array(*[F.lit(float(x)) for x in model.limits])
    allowed = F.aggregate(
        F.zip_with(suits, suited, lambda place, n: F.get(limits, place) * n), F.lit(0.0), lambda a, b: a + b
    )
    excess = entropy - allowed / symbols - F.lit(DEVIATIONS * float(model.spread)) / F.sqrt(symbols)
    return (symbols == 0) | (F.when(symbols > 0, excess) > 0)


_NAMES = {f.split()[0]: f.split()[0] for f in _SCORES.split(", ")}


def identify(docs: DataFrame, model: Broadcast, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, open_entropy, symbols, rejected) for every row of ``docs``.

    ``entropy`` is the least cross-entropy in nats per symbol, ``open_entropy`` that with
    each word in its best language; ``score`` is the posterior of the language predicted,
    from at most ``_SURE_SYMBOLS`` symbols' worth of evidence. Null texts and texts
    without a letter are ``und`` with score 0, null entropy, and rejected. Ties go to the
    first language by name. Repeated and null ids are rows of their own.
    """
    slim = docs.selectExpr(f"CAST(`{ident}` AS bigint) AS ident", f"CAST(`{text}` AS string) AS text")
    found = _scored(slim, model, "text", ["ident"], _NAMES).withColumn("rejected", _rejected(model.value, _NAMES))
    return found.drop("suits", "suited").withColumnRenamed("ident", ident)


def _gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over all words of the sampled documents."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, counted in words.items():
            grams: Counter = Counter()
            for word, n in counted.items():
                padded = _PAD * (ORDER - 1) + word + _END
                for at in range(len(padded) - ORDER + 1):
                    grams[padded[at : at + ORDER]] += n
            if grams:
                yield {"lang": [lang] * len(grams), "gram": list(grams), "n": list(grams.values())}

    partial = map_batches(sample.select("lang", "text"), run, "lang string, gram string, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _calibrate(model: Model, found: DataFrame) -> None:
    """Set limits and spread from the scores of all documents that the models have not seen.

    Each language's limit is the median of the documents predicted in it, plus
    ``LEAST_SLACK`` and what their high percentile lies above the allowed deviations. A
    language with fewer than ``LEAST_CALIBRATION`` such documents keeps the limit of the fit.
    ``found`` has (lang_pred, open_entropy, symbols) and is read several times.
    """
    found = found.where("symbols > 0")
    middle = F.percentile_approx("open_entropy", 0.5, 10_000).alias("middle")
    centers = found.groupBy("lang_pred").agg(middle, F.count("*").alias("n")).where(F.col("n") >= LEAST_CALIBRATION)
    # One row per language.
    found = found.join(F.broadcast(centers), "lang_pred")
    deviation = F.col("open_entropy") - F.col("middle")
    spread = found.agg(F.percentile_approx(F.abs(deviation) * F.sqrt("symbols"), 0.5, 10_000)).first()[0]
    if spread is None:
        return
    model.spread = _MEDIAN_TO_DEVIATION * spread
    excess = deviation - F.lit(DEVIATIONS * model.spread) / F.sqrt("symbols")
    high = F.percentile_approx(excess, HIGH_EXCESS, 10_000).alias("high")
    for row in found.groupBy("lang_pred", "middle").agg(high).collect():
        model.limits[model.languages.index(row.lang_pred)] = row.middle + LEAST_SLACK + max(0.0, row.high)


def _teaching(docs: DataFrame, ident: str, text: str, lang: str, place: str) -> DataFrame:
    """``docs`` with the hash of each document that can teach in ``place``, null for the others.

    A document is an id with its text in a language. Rows without id, text, letters or
    language teach nothing.
    """
    usable = F.col(ident).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")
    return docs.withColumn(place, F.when(usable, F.md5(F.concat(F.col(ident).cast("string"), F.lit(" "), F.col(text)))))


def _fit_sample(labelled: DataFrame, documents_per_language: int) -> tuple[Model, DataFrame]:
    """The models, and (lang, place) of the documents that they rest on; ``labelled`` has lang, text, place."""
    spark = labelled.sparkSession
    usable = labelled.where("place IS NOT NULL")
    named = stored(usable.select("lang", "place"), "language-places")
    # The first places lie below a share of all hashes; with three times the share needed
    # they are all there but with negligible probability. One row per language.
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("place").alias("documents"))
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 2.0**32
    early = named.join(F.broadcast(sizes), "lang").where(
        share <= F.lit(3.0 * documents_per_language) / F.col("documents")
    )
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = early.select("lang", "place").distinct().withColumn("turn", turn).where(F.col("turn") <= documents_per_language)
    # At most ``documents_per_language`` places of each language are broadcast.
    fitted = stored(chosen.where(F.col("turn") % CALIBRATION_SHARE != 0).select("lang", "place"), "language-ids")
    same = ["lang", "place"]
    once = usable.join(F.broadcast(fitted), same).groupBy(same).agg(F.min("text").alias("text"))
    sample = stored(once, "language-sample")
    counts: dict[str, Counter] = {}
    for row in _gram_counts(sample).collect():
        counts.setdefault(row.lang, Counter())[row.gram] = row.n
    if counts:
        model = fit(counts, sorted(counts))
        if model.megabytes() > MAX_MODEL_MB:
            raise ValueError(f"the models take {model.megabytes():.0f} MB of {MAX_MODEL_MB}; lower documents_per_language")
    else:
        none, nothing = [np.empty(0, np.uint64)] * ORDER, [np.zeros((0, 1))] * ORDER
        model = Model([UNKNOWN], none, nothing, none, nothing, np.zeros(1), np.full(1, math.inf))
    return model, fitted


def train(
    labelled: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    documents_per_language: int = DOCUMENTS_PER_LANGUAGE,
) -> Broadcast:
    """Fit on at most ``documents_per_language`` documents of each language, calibrate on the others.

    A document is an id with its text in a language, however many rows repeat it. The
    sample takes those with the smallest md5 of id and text. One in
    ``CALIBRATION_SHARE`` of them is held back; these and all labelled documents outside
    the sample set the rejection limits. The model grows with the sample, not with the
    corpus, and is broadcast; one of more than ``MAX_MODEL_MB`` is an error. Rows without
    id, text, letters or language teach nothing; without any usable row every text is
    ``und`` and only texts without a letter are rejected.
    """
    rows = labelled.select(F.col(ident).alias("ident"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = _teaching(rows, "ident", "text", "lang", "place")
    model, fitted = _fit_sample(rows, documents_per_language)
    context = labelled.sparkSession.sparkContext
    raw = context.broadcast(model)
    outside = rows.where("place IS NOT NULL").join(F.broadcast(fitted), ["lang", "place"], "left_anti")
    _calibrate(model, stored(_scored(outside, raw, "text", [], _NAMES), "calibration"))
    return context.broadcast(model)


def score_once(docs: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, Column, dict[str, str]]:
    """Learn from documents whose crc32 remainder is not 1, and score every document, once.

    Returns the stored columns ``keep`` with their scores, whether a row is rejected, and the
    names of the score columns. The limits come from the stored scores, so no text is scored
    for them apart.
    """
    place = free_name(docs, "_place")
    label = free_name(docs, "_label")
    names = {n: free_name(docs, f"_{n}") for n in _NAMES}
    docs = docs.withColumn(label, F.when(remainder("doc_id", 3) != 1, F.col("lang")))
    docs = _teaching(docs, "doc_id", "text", label, place)
    model, fitted = _fit_sample(docs.select(F.col(label).alias("lang"), F.col("text"), F.col(place).alias("place")), DOCUMENTS_PER_LANGUAGE)
    raw = docs.sparkSession.sparkContext.broadcast(model)
    found = stored(_scored(docs, raw, "text", [*keep, label, place], names), "language-scores")
    seen = found.select(
        F.col(label).alias("lang"), F.col(place).alias("place"),
        *[F.col(names[n]).alias(n) for n in ("lang_pred", "open_entropy", "symbols")],
    ).where("place IS NOT NULL")
    _calibrate(model, seen.join(F.broadcast(fitted), ["lang", "place"], "left_anti"))
    return found, _rejected(model, names), names


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from documents whose crc32 remainder is not 1, then judge every document.

    Nulls, texts without letters and repeated rows are as in :func:`identify`: one row each.
    An empty table gives no rows.
    """
    slim = docs.select("doc_id", "text", "lang")
    found, rejected, names = score_once(slim, ["doc_id"])
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    results = [F.col(names[n]).alias(n) for n in ("lang_pred", "score", "entropy")]
    return found.select("doc_id", held_out, *results, rejected.alias("rejected"))


def in_known_languages(docs: DataFrame) -> DataFrame:
    """All columns of the documents that are not rejected; texts without a letter go, too.

    Repeated rows are kept or go together; an empty table gives no rows.
    """
    found, rejected, _ = score_once(docs, docs.columns)
    return found.where(~rejected).select(*[F.col(f"`{c}`") for c in docs.columns])
