"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, bind, word_array

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is was for on with as that be at by this from or an are it a "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au ne pas "
    "el los las del se y por con para una su al lo como más"
).split()
SYMBOLS = "#*$%&|<>"
MARKS = "!?"


class Rule(NamedTuple):
    """Texts pass if ``low <= ratio <= high``; the ratio is ``part / whole``, 0 over nothing."""

    name: str
    part: str
    whole: str
    low: float
    high: float


#: The production table. Parts and wholes are columns of :func:`measures`.
RULES = (
    Rule("length", "n_words", "one", 20, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.10),
    Rule("marks", "n_marks", "n_words", 0.0, 0.30),
    Rule("stop_words", "n_stop", "n_words", 0.04, 1.0),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0.0, 0.60),
    Rule("echoes", "n_echo", "n_words", 0.0, 0.20),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.0, 0.30),
)


def pairwise(items: Column, n: Column, step: int) -> Column:
    """Hash of each element with that ``step`` places on: windows of twice the length."""
    return F.zip_with(F.slice(items, 1, n), F.slice(items, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows that the text holds at least twice, from the hashes of its words.

    Hashes are paired three times (1, 2, 4, 8 words); sorting (hash, place) brings equal windows together, and the
    places of those are sorted again to sum what they cover. All of it is linear or n log n in the words.
    """

    def places(windows: Column) -> Column:
        rows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
            return bind(
                same,
                lambda nxt: F.filter(
                    F.zip_with(
                        s,
                        F.zip_with(nxt, F.concat(F.array(F.lit(False)), F.slice(nxt, F.lit(1), F.size(nxt) - 1)), lambda a, b: a | b),
                        lambda e, twin: F.when(twin, e["i"]),
                    ),
                    lambda i: i.isNotNull(),
                ),
            )

        return F.array_sort(bind(rows, twins))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    def count(hashes: Column) -> Column:
        n = F.size(hashes)
        windows = bind(bind(pairwise(hashes, n - 1, 1), lambda h: pairwise(h, n - 3, 2)), lambda h: pairwise(h, n - 7, 4))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(places(h), covered)))

    return F.when(F.size(words) < 9, F.lit(0).cast("long")).otherwise(count(words))


def characters(text: Column, chars: str) -> Column:
    """How many of some ASCII characters a text has; removing them by one pattern is faster than translating all others."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, f"[{chars}]", ""))).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """What rules refer to; null text has no words and no lines."""
    body = F.coalesce(text, F.lit(""))
    words = word_array(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    stop = list(dict.fromkeys(STOP_WORDS))
    counted = bind(
        words,
        lambda w: bind(
            F.transform(w, lambda x: F.xxhash64(x)),
            lambda h: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.size(F.filter(w, lambda x: (F.length(x) <= 6) & F.lower(F.rtrim(x, F.lit(".,!"))).isin(stop))).cast("long").alias("n_stop"),
                F.size(F.filter(F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_echo"),
                repeated_words(h).alias("n_repeat_words"),
            ),
        ),
    )
    return {
        "counted": counted,
        "line_counts": bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
        "n_symbols": characters(body, SYMBOLS),
        "n_marks": characters(body, MARKS),
    }


def compile_rules(rules: tuple[Rule, ...], columns: dict[str, Column]) -> dict[str, Column]:
    """A boolean column ``passes_<name>`` for each row of the table."""
    out = {}
    for r in rules:
        ratio = F.when(columns[r.whole] == 0, 0.0).otherwise(columns[r.part] / columns[r.whole])
        out[f"passes_{r.name}"] = ratio.between(r.low, r.high)
    return out


def quality(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of each text, whether it fails the base, what each rule says, and ``kept``: the base and all rules passed.

    One row per row of ``docs``, with its id. Null, empty and blank texts have no words and fail the base. Very long
    texts are measured whole. Repeated rows are judged each on their own; other columns, whatever their names, are not
    read; an empty table gives an empty table. The plan is a scan and projections: no shuffle, no user functions.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_echo", "n_marks", "n_lines"]
    found = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in measures(F.col(text)).items()])
    flat = found.select("doc_id", "counted.*", "line_counts.*", "n_symbols", "n_marks").select("doc_id", *names)
    columns = {n: F.col(n) for n in names} | {"one": F.lit(1)}
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = flat.withColumn("base_failed", base).withColumns(compile_rules(rules, columns))
    passed = ~F.col("base_failed")
    for r in rules:
        passed = passed & F.col(f"passes_{r.name}")
    return judged.withColumn("kept", passed)
