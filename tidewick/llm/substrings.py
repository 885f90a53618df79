"""Substring dedup: word sequences that occur more than once, found by seed and extend."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key
from .hashing import Windows, chunks, digests, joined, mix, ranges, signed

#: Words of a window, and of the seeds from which anchors are winnowed.
WINDOW, SEED = 35, 6


def winnow(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` consecutive seeds the place of the smallest, the first of equal ones."""
    best, span = np.arange(len(seeds)), 1

    def merge(best: np.ndarray, shift: int) -> np.ndarray:
        left, right = best[: len(best) - shift], best[shift:]
        return np.where(seeds[right] < seeds[left], right, left)

    while span * 2 <= width:
        best, span = merge(best, span), span * 2
    return merge(best, width - span) if width > span else best


#: What a row of a table of runs or windows says: a repeat, one whose windows are to be counted, one to be counted as two.
REPEAT, ONE, TWO = 0, 1, 2
RUNS = "k1 long, k2 int, first int, windows int, kind int"
RUN_COLUMNS = ["k1", "k2", "first", "windows", "kind"]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    changed = np.zeros(len(keys[0]), dtype=bool)
    changed[:1] = True
    for key in keys:
        changed[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(changed)


def merged(row: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (row, first, count) with those that follow each other in a row made one."""
    order = np.lexsort((first, row))
    row, first, stop = row[order], first[order], (first + count)[order]
    if not len(row):
        return row, first, stop
    reach = np.maximum.accumulate(stop + row * (1 << 40))
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] + row[1:] * (1 << 40) > reach[:-1])]))
    last = np.concatenate([new[1:], [len(row)]]) - 1
    return row[new], first[new], reach[last] - row[new] * (1 << 40) - first[new]


def keyed(batch: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(row)) for k in ("k1", "k2")]


def integers(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def runs_of(batch: pa.RecordBatch, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(row, first, windows, anchor, context, context2) of the runs of neighbouring windows of a text that choose one anchor.

    Equal windows choose equal anchors at equal offsets, whatever surrounds them. The context is a digest of all the words
    of the run's windows, as they are written, and of the anchor's offset: 128 bits that nobody can make agree for other
    words. The anchor only brings runs together.
    """
    found = []
    for chunk in chunks(batch.column("text"), spaced=True):
        n = len(chunk.words)
        if n < window:
            continue
        seeds = Windows(chunk.words)(seed)
        chosen = winnow(seeds, window - seed + 1)
        doc = np.repeat(np.arange(chunk.rows), np.diff(chunk.at))
        start = np.flatnonzero(doc[: len(chosen)] == doc[window - 1 :])
        if not len(start):
            continue
        anchor = chosen[start]
        new = starts_of(anchor, doc[start])
        count = np.diff(np.concatenate([new, [len(start)]]))
        first, at = start[new], anchor[new]
        offsets = (at - first).astype("<u2" if window < 1 << 16 else "<u8")
        shapes = [offsets[k : k + 1].tobytes() for k in range(len(offsets))]
        context = digests(map(bytes.__add__, shapes, chunk.spelled(first, first + count + window - 2)))
        owner = doc[first]
        found.append((chunk.first + owner, first - chunk.at[owner], count, seeds[at], *context))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else ()


def anchors(window: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of each text, after what its batch can decide: one row for each anchor and context.

    Runs whose anchor and context the batch holds twice are repeats; one of them goes on to stand for all. Where a batch
    holds several contexts of an anchor, they differ for sure: one of them tells the anchor's task, the others spread
    over tasks, so that no task gets all occurrences of a frequent anchor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = runs_of(batch, window, seed)
            if not runs:
                continue
            order = np.lexsort((runs[1], runs[0], runs[5], runs[4], runs[3]))
            row, first, count, anchor, context, context2 = (x[order] for x in runs)
            group = starts_of(anchor, context, context2)
            n = np.diff(np.concatenate([group, [len(row)]]))
            twice = np.repeat(n > 1, n)
            told = merged(row[twice], first[twice], count[twice])
            row, first, count, anchor, context, context2 = (x[group] for x in (row, first, count, anchor, context, context2))
            new = starts_of(anchor)
            contexts = np.diff(np.concatenate([new, [len(anchor)]]))
            differ, leads = np.repeat(contexts > 1, contexts), np.zeros(len(anchor), dtype=bool)
            leads[new] = True
            task = np.where(differ & ~leads, joined(anchor, context), anchor)
            every = np.concatenate([told[0], row])
            spread = mix(told[0].astype(np.uint64) + anchor[:1])
            yield pa.RecordBatch.from_arrays(
                [
                    *keyed(batch, every),
                    integers(np.concatenate([told[1], first])),
                    integers(np.concatenate([told[2], count])),
                    integers(np.concatenate([np.full(len(told[0]), REPEAT), np.where(n > 1, TWO, ONE)])),
                    signed(np.concatenate([spread, task])),
                    signed(np.concatenate([spread, anchor])),
                    signed(np.concatenate([spread, context])),
                    signed(np.concatenate([spread, context2])),
                    pa.array(np.concatenate([np.zeros(len(told[0]), dtype=bool), differ])),
                ],
                names=[*RUN_COLUMNS, "task", "anchor", "context", "context2", "differ"],
            )

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of runs that come sorted by anchor and context.

    Runs of one anchor and context are repeats; where an anchor has other contexts, too, one of them is counted as two
    with the others, which are counted as one each. The rows of the last context wait for the next batch.
    """
    held, seen = None, None
    for batch in _ended(batches):
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        if not table.num_rows:
            continue
        rows = table.to_batches()[0]
        kind = rows.column("kind").to_numpy()
        told = kind == REPEAT
        if told.any():
            yield rows.filter(pa.array(told)).select(RUN_COLUMNS)
            rows = rows.filter(pa.array(~told))
        kind, anchor, *context = (rows.column(c).to_numpy() for c in ("kind", "anchor", "context", "context2"))
        group = starts_of(anchor, *context)
        if batch is not None and len(group):
            held, rows = rows.slice(int(group[-1])), rows.slice(0, int(group[-1]))
            of_held = anchor[group[-1]]
            kind, anchor, group = kind[: group[-1]], anchor[: group[-1]], group[:-1]
        else:
            held, of_held = None, None
        if not len(group):
            continue
        ends = np.concatenate([group[1:], [len(kind)]])
        total = np.add.reduceat(kind, group)
        flag = np.logical_or.reduceat(rows.column("differ").to_numpy(zero_copy_only=False), group)
        of = anchor[group]
        new = starts_of(of)
        size = np.diff(np.concatenate([new, [len(of)]]))
        several = size > 1
        several[0] |= seen is not None and seen == of[0]
        several[-1] |= of_held is not None and of_held == of[-1]
        differ = np.repeat(several, size) | np.repeat(np.logical_or.reduceat(flag, new), size)
        seen = of[-1]
        twice = np.repeat(total > 1, ends - group)
        yield rows.filter(pa.array(twice & (kind == ONE))).select(RUN_COLUMNS).set_column(4, "kind", integers(np.full(int((twice & (kind == ONE)).sum()), REPEAT)))
        asked = rows.take(pa.array(group[differ])).select(RUN_COLUMNS)
        yield asked.set_column(4, "kind", integers(np.where(total[differ] > 1, TWO, ONE)))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, then None."""
    yield from batches
    yield None


def extensions(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of the runs asked for, after what their batch can decide: one row for each window.

    A window is the anchor extended both ways, known by a digest of its words as they are written. Windows that a batch
    holds twice are repeats; one row goes on to stand for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, found = batch.column("asked"), []
            for chunk in chunks(batch.column("text"), spaced=True):
                runs = asked.slice(chunk.first, chunk.rows)
                owner = np.repeat(np.arange(chunk.rows), pc.list_value_length(runs).to_numpy())
                flat = runs.flatten()
                first, count, kind = (flat.field(c).to_numpy() for c in ("first", "windows", "kind"))
                where = ranges(chunk.at[owner] + first, count)
                of = np.repeat(owner, count)
                found.append((chunk.first + of, where - chunk.at[of], np.repeat(kind, count), *digests(chunk.spelled(where, where + window - 1))))
            if not found:
                continue
            row, first, kind, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((kind, two, one))
            row, first, kind, one, two = (x[order] for x in (row, first, kind, one, two))
            group = starts_of(one, two)
            n = np.diff(np.concatenate([group, [len(row)]]))
            total = np.add.reduceat(kind, group)
            told = np.repeat(total > 1, n) & (kind == ONE)
            spans = merged(row[told], first[told], np.ones(int(told.sum()), dtype=np.int64))
            every = np.concatenate([spans[0], row[group]])
            spread = mix(spans[0].astype(np.uint64) + one[:1])
            yield pa.RecordBatch.from_arrays(
                [
                    *keyed(batch, every),
                    integers(np.concatenate([spans[1], first[group]])),
                    integers(np.concatenate([spans[2], np.ones(len(group), dtype=np.int64)])),
                    integers(np.concatenate([np.full(len(spans[0]), REPEAT), np.where(total > 1, TWO, ONE)])),
                    signed(np.concatenate([spread, one[group]])),
                    signed(np.concatenate([spread, two[group]])),
                ],
                names=[*RUN_COLUMNS, "hash", "hash2"],
            )

    return run


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeats among windows that come sorted by their hashes. The rows of the last one wait for the next batch."""
    held = None
    for batch in _ended(batches):
        table = pa.Table.from_batches([b for b in (held, batch) if b is not None]).combine_chunks()
        if not table.num_rows:
            continue
        rows = table.to_batches()[0]
        group = starts_of(*(rows.column(c).to_numpy() for c in ("hash", "hash2")))
        held = rows.slice(int(group[-1])) if batch is not None else None
        if held is not None:
            rows, group = rows.slice(0, int(group[-1])), group[:-1]
        if not len(group):
            continue
        kind = rows.column("kind").to_numpy()
        # A row that is told to be a repeat has a random hash; should it meet a window, it must not count.
        total = np.repeat(np.add.reduceat(kind, group), np.diff(np.concatenate([group, [len(kind)]])))
        yield rows.filter(pa.array((kind == REPEAT) | (total > 1) & (kind == ONE))).select(RUN_COLUMNS)


def removal(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts without the words that the given windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, begins, lengths = [], [], [], [], []
            for i in range(batch.num_rows):
                words = (batch.column("text")[i].as_py() or "").encode().split()
                spans = batch.column("spans")[i].values
                gone, starts, stops = 0, [], []
                if spans is not None and len(spans):
                    first, count = spans.field("first").to_numpy(), spans.field("windows").to_numpy()
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(steps, first, 1)
                    np.add.at(steps, first + count - 1 + window, -1)
                    keep = np.cumsum(steps[:-1]) == 0
                    edges = np.flatnonzero(np.diff(keep, prepend=True, append=True))
                    starts, stops = edges[0::2], edges[1::2]
                    gone = len(words) - int(keep.sum())
                    text = b" ".join(compress(words, keep.tolist()))
                else:
                    text = b" ".join(words)
                total.append(len(words))
                removed.append(gone)
                kept.append(text.decode())
                begins.append(list(map(int, starts)))
                lengths.append([int(b - a) for a, b in zip(starts, stops, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(begins, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "n_removed", "kept_text", "cut_starts", "cut_lengths"],
            )

    return run


def dedup_substrings(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Texts without the words of maximal repeats of ``window`` words or more: doc_id, n_words, n_removed, kept_text, cut_starts, cut_lengths.

    A window is repeated if its words also start anywhere else, in the same document or another; every occurrence goes,
    the first one too. ``cut_starts`` and ``cut_lengths`` are the maximal repeats of a document, in words.

    Seed: every window chooses one anchor by winnowing hashes of ``seed`` words, so equal windows choose equal anchors,
    and documents meet on anchors; anchors that occur once are done with. Occurrences that agree in the whole context of
    their windows are repeats, and one of them stands for all. Extend: where an anchor has several contexts, one
    occurrence of each is extended both ways to the windows that chose the anchor, and equal windows are counted.
    Counting replaces pairs of documents: the work is linear in the windows, whatever the size of a group, and no link is
    lost. Batches decide what they can before a shuffle, so a frequent passage sends one row for each batch.
    Runs and windows are equal if 128-bit digests of their words, as written, agree; anchors, for which a fast hash is
    enough, decide nothing on their own, so words made to share a hash only cost a comparison.

    Null and empty texts have no words. Texts shorter than a window are kept whole, with single spaces between words.
    Rows repeated whole are two documents, and repeat each other. Other columns are not read. An empty table gives an
    empty table.
    """
    # What goes from a row follows from its text, so rows are known by hashes of id and text, not by numbers.
    keys = ["k1", "k2"]
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(F.col(doc_id), F.sha2(F.col(text), 256)))
    # Inner joins ask for this filter on their own; with it in all plans, the scans and shuffles of texts are alike.
    whole = whole.where("k1 is not null and k2 is not null")
    runs = whole.select(*keys, "text").mapInArrow(anchors(window, seed), f"{RUNS}, task long, anchor long, context long, context2 long, differ boolean")
    met = cut(runs.repartition("task").sortWithinPartitions("anchor", "context", "context2").mapInArrow(meet, RUNS), "substring-runs")
    # Rows of one key are alike: what one of them asks for, the others need not ask again.
    asked = met.where(F.col("kind") != REPEAT).groupBy(*keys).agg(F.collect_set(F.struct("first", "windows", "kind")).alias("asked"))
    # Both joins read the texts with the same columns and key, so Spark shuffles the texts once.
    extended = whole.join(asked, keys).select(*keys, "text", "asked").mapInArrow(extensions(window), f"{RUNS}, hash long, hash2 long")
    counted = extended.repartition("hash", "hash2").sortWithinPartitions("hash", "hash2").mapInArrow(count, RUNS)
    spans = met.where(F.col("kind") == REPEAT).unionByName(counted).groupBy(*keys).agg(F.collect_set(F.struct("first", "windows")).alias("spans"))
    kind = whole.schema["doc_id"].dataType.simpleString()
    return (
        whole.join(spans, keys, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(removal(window), f"doc_id {kind}, n_words long, n_removed long, kept_text string, cut_starts array<bigint>, cut_lengths array<bigint>")
    )
