"""Divergence of sources: how the terms of a source differ from those of its language and of the other sources.

All numbers are whole. Shares of terms are smoothed, so a term that a group lacks has a share too, the group's baseline;
sums over all terms are those of baselines plus corrections for the terms that groups have.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_skewed

#: Documents of a language that a term has to be in, and ranks that are listed.
MIN_DOCS, TOP = 3, 200
#: Shares are counted in parts of this whole.
UNIT = 1_000_000_000
#: Distinct terms that a task holds before it passes its counts on, and bytes of a text whose terms are held together.
HELD_TERMS, PIECE_BYTES = 200_000, 1 << 20
#: Bits that a round of the selection decides.
DIGIT = 16

#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def pieces(body: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    spaced, at = body.translate(TERM_BYTES), 0
    while at < len(spaced):
        stop = spaced.find(b" ", at + PIECE_BYTES)
        stop = len(spaced) if stop < 0 else stop
        yield spaced[at:stop].split()
        at = stop


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each group, summed over what a task holds; a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, size), pa.repeat(source, size), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], schema=COUNTS)
        held.clear()

    total = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c) for c in ("lang", "source", "text")), strict=True):
            n, docs = held[lang.as_py(), source.as_py()]
            before, seen = len(n), set()
            for terms in pieces(text.as_py().encode()):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            total += len(n) - before
            if total >= HELD_TERMS:
                yield from passed_on()
                total = 0
    yield from passed_on()


def share(count: Column, size: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (size + terms)); null where there are no terms."""
    scaled = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", scaled, (size + F.greatest(terms, F.lit(1))).cast("decimal(20,0)")) + 1)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are at most UNIT + 1, so squares fit."""
    return F.call_function("div", (p - q) * (p - q), q)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def common_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two sources have add to both pairs of them, beyond what each has added alone; summed in each batch.

    Rows (lang, source, term, p, base) come sorted by language and term; those of the last term wait for the next batch.
    """
    held = None
    for batch in _ended(batches):
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        if not table.num_rows:
            continue
        rows = table.to_batches()[0]
        lang, term = (rows.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
        starts = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])]))
        held = rows.slice(int(starts[-1])) if batch is not None else None
        if held is not None:
            rows, lang, starts = rows.slice(0, int(starts[-1])), lang[: starts[-1]], starts[:-1]
        if not rows.num_rows:
            continue
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        sources = rows.column("source").dictionary_encode()
        source, p, base = sources.indices.to_numpy(), rows.column("p").to_numpy(), rows.column("base").to_numpy()
        width, keys, values = len(sources.dictionary), [], []
        for step in range(1, int(np.diff(np.append(starts, rows.num_rows)).max())):
            left = np.flatnonzero(run[:-step] == run[step:])
            for a, b in ((left, left + step), (left + step, left)):
                keys.append((lang[a].astype(np.int64) * width + source[a]) * width + source[b])
                values.append(distances(p[a], p[b]) - distances(p[a], base[b]) - distances(base[a], p[b]) + distances(base[a], base[b]))
        if not keys:
            continue
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, value = key[new], np.add.reduceat(value, new)
        langs = rows.column("lang").dictionary_encode().dictionary
        name = lambda values, codes: values.take(pa.array(codes))
        yield pa.RecordBatch.from_arrays([name(langs, key // width // width), name(sources.dictionary, key // width % width), name(sources.dictionary, key % width), pa.array(value)], names=["lang", "source", "item", "value"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def largest(rows: DataFrame, by: list[str], value: str, item: str, k: int) -> DataFrame:
    """Rows of each group at ranks 1 to ``k``, with ``rank``: by ``value``, which is no less than 0, from the largest, then by UTF-8 bytes of ``item``.

    Radix selection finds the k-th value of every group at once: a histogram of the next 16 bits of the values that
    agree with what is known of it so far says which bits follow. Where more rows than wanted have that very value, the
    same goes on over two bytes of ``item`` at a time. What is sorted are ``k`` rows of a group; what a window sees before
    are the bins of one histogram.
    """
    bits, known = F.col(value), None
    running = Window.partitionBy(*by)
    for shift in range(64 - DIGIT, -1, -DIGIT):
        if known is None:
            mine = rows.select(*by, value).withColumns({"prefix": F.lit(0).cast("long"), "wanted": F.lit(k).cast("long")})
        else:
            mine = join_skewed(rows.select(*by, value), known.select(*by, "prefix", "wanted"), by).where(F.shiftright(bits, shift + DIGIT) == F.col("prefix"))
        bins = mine.groupBy(*by, "prefix", "wanted", F.shiftright(bits, shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.count("*").alias("n"))
        above = bins.withColumn("above", F.sum("n").over(running.orderBy(F.desc("digit"))) - F.col("n"))
        here = above.where("above < wanted and above + n >= wanted")
        # Groups of fewer rows than wanted have no such bin: they keep all rows.
        known = cut(here.select(*by, F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix"), (F.col("wanted") - F.col("above")).alias("wanted"), "n"), "radix-values")
    bound = known.select(*by, F.col("prefix").alias("least"), "wanted", (F.col("n") > F.col("wanted")).alias("tied"), F.lit(b"").alias("start"))
    open_groups, done, at = bound.where("tied"), [bound.where("not tied").withColumn("start", F.lit(None).cast("binary"))], 0
    ties = None
    while not open_groups.isEmpty():
        if ties is None:
            ties = cut(join_skewed(rows.select(*by, F.col(value).alias("v"), F.col(item).cast("binary").alias("bytes")), bound.where("tied").select(*by, "least"), by).where("v = least").select(*by, "bytes"), "radix-ties")
        mine = join_skewed(ties, open_groups, by).where(F.substring("bytes", 1, at) == F.col("start")) if at else join_skewed(ties, open_groups, by)
        bins = mine.groupBy(*by, "least", "wanted", "start", F.substring("bytes", at + 1, 2).alias("piece")).agg(F.count("*").alias("n"))
        before = bins.withColumn("before", F.sum("n").over(running.orderBy("piece")) - F.col("n")).where("before < wanted and before + n >= wanted")
        at += 2
        found = before.select(*by, "least", (F.col("wanted") - F.col("before")).alias("wanted"), ((F.col("before") + F.col("n") > F.col("wanted")) & (F.octet_length("piece") == 2)).alias("tied"), F.concat("start", "piece").alias("start"))
        found = cut(found, "radix-bytes")
        done.append(found.where("not tied"))
        open_groups = found.where("tied")
    ends = done[0]
    for part in done[1:]:
        ends = ends.unionByName(part)
    within = (bits > F.col("least")) | (bits == F.col("least")) & (F.col("start").isNull() | (F.substring(F.col(item).cast("binary"), F.lit(1), F.octet_length("start")) <= F.col("start")))
    # An inner join, which Spark can split, of rows with a bound for every group: of those without a k-th row, the least value there is.
    all_ends = rows.select(*by).distinct().join(ends.select(*by, "least", "start"), by, "left").withColumn("least", F.coalesce("least", F.lit(-1).cast("long")))
    chosen = join_skewed(rows, all_ends, by).where(within).drop("least", "start")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), item)).alias("rank")
    return chosen.select("*", rank).where(F.col("rank") <= k)


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and by which terms.

    Terms are runs of ASCII letters and of characters beyond ASCII, A to Z in lower case; a language keeps those of at
    least ``min_docs`` of its documents. A group's share of a term is p = 1 + floor(10**9 * (count + 1) / (N + V)), with N
    the group's occurrences of the V kept terms. Part ``pair`` has a row for each other source of the language, whose
    share is q: the sum of floor((p - q)**2 / q) over all V terms, 0 where there are none. Part ``term`` has the terms
    that the source holds more of than its language (p > q, q the language's share), the ``top`` of them.

    Tasks count the terms of many documents before a shuffle. A pair's sum is V times that of two baselines, corrected
    for what each source has (from a histogram of its shares) and for terms that both have; the latter are added up in
    tasks, which hold the sources of one term at a time and emit a sum for each pair, not pairs for each term. The top
    terms are found by :func:`largest`.

    Null text, lang and source are ''. Each row is a document, also one that repeats another. A group without terms has
    its pairs and no terms. Other columns are not read. An empty table gives an empty table.
    """
    body = lambda c, n: F.coalesce(F.col(c), F.lit("")).alias(n)
    rows = docs.select(body(lang, "lang"), body(source, "source"), body(text, "text")).mapInArrow(term_counts, "lang string, source string, term string, n long, docs long")
    counts = cut(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    of_lang = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = cut(counts.drop("docs").join(of_lang.drop("docs"), ["lang", "term"]), "divergence-terms")
    langs = of_lang.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_size"))
    sizes = terms.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("size"), zero("terms"), zero("lang_size"))
    groups = cut(groups.withColumn("base", share(F.lit(0), F.col("size"), F.col("terms"))), "divergence-groups")
    priced = join_skewed(terms, groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share(F.col("in_lang"), F.col("lang_size"), F.col("terms")).alias("q"), "base"
    )
    priced = cut(priced, "divergence-shares")

    whole = lambda c: c.cast("decimal(38,0)")
    # The sources of a language twice: the rows of the result, no more.
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    mine, other = F.col("base"), F.col("other_base")
    start = groups.join(others, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(whole(F.col("terms")) * distance(mine, other), F.lit(0)).cast("decimal(38,0)").alias("value"))
    levels = priced.groupBy("lang", "source", "p", "base").agg(F.count("*").alias("n"))
    alone = (
        join_skewed(levels, others, ["lang"])
        .where("source <> item")
        .groupBy("lang", "source", "item")
        .agg(F.sum(whole(F.col("n") * (distance(F.col("p"), other) - distance(mine, other)))).alias("as_source"), F.sum(whole(F.col("n") * (distance(other, F.col("p")) - distance(other, mine)))).alias("as_item"))
    )
    both_ways = alone.select("lang", F.explode(F.array(F.struct("source", "item", F.col("as_source").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("as_item").alias("value")))).alias("x")).select("lang", "x.*")
    together = priced.select("lang", "source", "term", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(common_terms, "lang string, source string, item string, value long")
    every = start.unionByName(both_ways).unionByName(together.withColumn("value", whole(F.col("value"))))
    sums = every.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)

    lead = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = largest(lead, ["lang", "source"], "value", "item", top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
