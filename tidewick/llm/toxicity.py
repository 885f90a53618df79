"""Toxicity scores from a weighted lexicon, learned from labels and matched by Aho-Corasick."""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log, log1p, sqrt
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import cut, fresh

#: Characters that stand for Latin letters. 1 and l fall together with i.
LOOKALIKES = dict(zip("013457l8@$", "oieastibas", strict=True)) | dict(zip("авекмнорстухіѕј", "abekmhopctyxisj", strict=True)) | dict(zip("αβεικνορτυχ", "abeikvoptux", strict=True))

#: Phrases in which a term isn't meant as an insult.
EXCEPTIONS = ("pathetic fallacy", "trash can", "trash bin", "clown fish", "pond scum", "worthless check", "sore loser board game")

#: Labelled rows that the lexicon is learned from, at most.
MAX_ROWS = 20_000
#: Lengths of word beginnings that can be terms, next to whole words.
STEMS = (4, 5, 6, 7)
#: What a term needs: distinct contexts in toxic texts, the evidence G2, and how many times likelier it makes a word toxic.
MIN_CONTEXTS, MIN_G2, MIN_RATIO = 4, 20.0, 12.0
BIN = 0.05


class Folding(dict):
    """Maps code points for str.translate: lower case, no accents, lookalikes to letters, all else to a space."""

    def __missing__(self, point: int) -> str:
        parts = [LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", chr(point).lower()) if unicodedata.category(c) not in ("Mn", "Cf")]
        self[point] = "".join(c if c.isalnum() else " " for c in parts)
        return self[point]


def words_of(text: str, folding: Folding) -> list[str]:
    return text.translate(folding).split()


def terms_of(word: str) -> list[str]:
    """The candidates at a word: the word, and its beginnings. A leading space marks the start, a trailing one the end."""
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if k < len(word))]


class Model(NamedTuple):
    terms: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope: float

    def score(self, strength: float) -> float:
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, self.bias + self.slope * strength))))


def outside(best: dict[int, float], spared: list[tuple[int, int]]) -> dict[int, float]:
    """The hits that don't begin within a span, in one walk along both."""
    spans, kept, stop = iter(sorted(spared)), {}, -1
    span = next(spans, None)
    for at in sorted(best):
        while span and span[0] <= at:
            stop, span = max(stop, span[1]), next(spans, None)
        if at >= stop:
            kept[at] = best[at]
    return kept


def matcher(model: Model) -> Callable[[str], tuple[float, int]]:
    """Strength (weights by length) and number of hits of a text."""
    folding, tree = Folding(), ahocorasick.Automaton()
    for term, weight in model.terms.items():
        tree.add_word(term, (len(term), weight))
    for phrase in model.exceptions:
        folded = f" {' '.join(words_of(phrase, folding))} "
        tree.add_word(folded, (len(folded), None))
    if len(tree):
        tree.make_automaton()

    def match(text: str) -> tuple[float, int]:
        words = words_of(text, folding)
        if not words or not len(tree):
            return 0.0, 0
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in tree.iter(f" {' '.join(words)} "):
            begin = end - length + 1
            if weight is None:
                spared.append((begin, end))
            else:
                best[begin] = max(weight, best.get(begin, 0.0))
        if spared:
            best = outside(best, spared)
        return log1p(100.0 * sum(best.values()) / sqrt(len(words))), len(best)

    return match


def scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(model)
        for batch in batches:
            found = [match(text.as_py() or "") for text in batch.column("tox_text")]
            strengths = [s for s, _ in found]
            at = batch.schema.get_field_index("tox_text")
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "tox_text"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(strengths, pa.float64()), pa.array([n for _, n in found], pa.int64()), pa.array(list(map(model.score, strengths)), pa.float64())], names=[*names, "strength", "hits", "score"]
            )

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each candidate with a hash of the word and of the one before: copies of a text repeat contexts, other texts don't."""
    folding = Folding()
    for batch in batches:
        found, n = set(), 0
        for text in batch.column("text"):
            words = words_of(text.as_py() or "", folding)
            n += len(words)
            before = ""
            for word in words:
                context = zlib.crc32(f"{before} {word}".encode())
                found.update((term, context) for term in terms_of(word))
                before = word
        terms, contexts = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array([*terms, ""], pa.string()), pa.array([*contexts, 0], pa.int64()), pa.array([0] * len(terms) + [n], pa.int64())], names=["term", "context", "words"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often candidates come in clean texts, batch by batch; the term '' counts all words."""
    folding = Folding()
    for batch in batches:
        words, found = Counter(), Counter()
        for text in batch.column("text"):
            words.update(words_of(text.as_py() or "", folding))
        for word, n in words.items():
            found[""] += n
            for term in terms_of(word):
                found[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def training_rows(docs: DataFrame, labels: DataFrame, *, text: str, doc_id: str, toxic: str, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents that aren't held out, taken in the order of a hash."""
    known = labels.where((fold_of(doc_id) != 1) & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("text", "toxic")


def evidence(t: Column, c: Column, n1: int, n0: int) -> tuple[Column, Column]:
    """(log of the smoothed rate ratio, G2) of t of n1 toxic and c of n0 clean words."""
    ratio = F.log((t + 0.5) / (n1 + 1.0)) - F.log((c + 0.5) / (n0 + 1.0))
    share = n1 / max(n1 + n0, 1)
    part = lambda x, e: F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0)
    return ratio, 2 * (part(t, (t + c) * share) + part(c, (t + c) * (1 - share)))


def calibrate(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Bias and slope of a logistic curve through (strength, label, rows), by Newton steps with a small ridge."""
    total, ones = sum(n for *_, n in bins), sum(n for _, y, n in bins if y)
    bias, slope = log((ones + 0.5) / (total - ones + 0.5)) if total else -3.0, 0.0
    ridge = 0.02
    for _ in range(50):
        g0, g1, h00, h01, h11 = 0.0, -ridge * slope, 1e-9, 0.0, ridge
        for x, y, n in bins:
            p = 1 / (1 + exp(-max(-30.0, min(30.0, bias + slope * x))))
            g0, g1 = g0 + n * (y - p), g1 + n * (y - p) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        scale = min(1.0, 2.0 / max(abs(d0), abs(d1), 1e-12))
        bias, slope = bias + scale * d0, slope + scale * d1
        if max(abs(d0), abs(d1)) < 1e-6:
            break
    return bias, max(0.0, slope)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS, max_rows: int = MAX_ROWS) -> Model:
    """Learn the lexicon and the curve from labelled rows outside the held-out fold.

    Terms are words and beginnings of words that toxic rows hold in several distinct contexts and clean rows (almost)
    never: all that reach the thresholds of evidence, however many. What is gathered comes from ``max_rows`` rows at
    most; terms are counted and weighed in Spark, and the driver holds the lexicon and the bins of the strengths.
    Without labels the lexicon is empty and every score is the prior.
    """
    rows = cut(training_rows(docs, labels, text=text, doc_id=doc_id, toxic=toxic, max_rows=max_rows), "tox-rows")
    contexts = rows.where("toxic = 1").select("text").mapInArrow(_contexts, "term string, context long, words long")
    in_toxic = cut(contexts.groupBy("term", "context").agg(F.sum("words").alias("words")).groupBy("term").agg(F.count("*").alias("t"), F.sum("words").alias("words")), "tox-terms")
    in_clean = cut(rows.where("toxic = 0").select("text").mapInArrow(_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("c")), "tox-clean")
    n1 = in_toxic.where("term = ''").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n0 = in_clean.where("term = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    ratio, g2 = evidence(F.col("t"), F.coalesce("c", F.lit(0)), n1, n0)
    weighed = in_toxic.where((F.col("t") >= MIN_CONTEXTS) & (F.col("term") != "")).join(in_clean, "term", "left").select("term", ratio.alias("ratio"), g2.alias("g2"))
    good = weighed.where((F.col("ratio") >= log(MIN_RATIO)) & (F.col("g2") >= MIN_G2)).orderBy("term").collect()
    terms = {r["term"]: min(8.0, r["ratio"]) for r in good}
    draft = Model(terms, exceptions, 0.0, 0.0)
    bins = (
        rows.select(F.col("toxic"), F.col("text").alias("tox_text"))
        .mapInArrow(scorer(draft), "toxic int, strength double, hits long, score double")
        .groupBy((F.round(F.col("strength") / BIN) * BIN).alias("x"), "toxic")
        .count()
        .collect()
    )
    return Model(terms, exceptions, *calibrate([(r["x"], r["toxic"], r["count"]) for r in bins]))


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``strength``, ``hits``, ``score`` and ``predicted`` (columns of these names are replaced).

    A strength is log(1 + 100 * sum of the weights of the hits / sqrt(words)); of terms that start at one place the
    heaviest counts, and hits within an exception phrase don't. Null and empty texts have strength 0 and get the score
    of texts without hits. Whole texts are read, however long; repeated rows are scored alike; an empty table gives an
    empty table. No column but the text is an input of the score.
    """
    keep = docs.drop("strength", "hits", "score", "predicted")
    held = fresh(keep, "tox_rest")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep.columns]).alias(held), F.col(text).alias("tox_text"))
    kind = StructType([packed.schema[held], StructField("strength", DoubleType()), StructField("hits", LongType()), StructField("score", DoubleType())])
    scored = packed.mapInArrow(scorer(model), kind)
    return scored.select(f"{held}.*", "strength", "hits", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
