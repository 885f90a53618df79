"""Substring dedup against brute force where batches, tasks and contexts of anchors differ in many ways."""

import random
from collections import Counter

import pytest
from odd_rows import words

from tidewick.llm import substrings


def brute(rows, window):
    seen = Counter(tuple(w[k : k + window]) for w in (words(t) for _, t in rows) for k in range(len(w) - window + 1))
    want = Counter()
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        want[(i, len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep, strict=True) if y))] += 1
    return want


@pytest.mark.parametrize("seed, window, anchor, batch", [(1, 5, 2, 3), (2, 6, 3, 1), (3, 9, 2, 50), (4, 7, 7, 4), (5, 35, 6, 5)])
def test_repeats_against_brute_force(spark, docs, seed, window, anchor, batch):
    r = random.Random(seed)
    passages = [[f"p{k}w{j % 7}" for j in range(r.randint(window, 2 * window))] for k in range(4)]
    rows = []
    for k in range(70):
        text = []
        for _ in range(r.randint(0, 6)):
            text += r.choice(passages)[r.randint(0, 3) :] if r.random() < 0.5 else [f"u{r.randrange(40)}" for _ in range(r.randint(1, window))]
        rows.append((k // 2 if r.random() < 0.2 else k, " ".join(text)))
    rows += rows[:9]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = substrings.dedup_substrings(docs(rows), window=window, seed=anchor).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == brute(rows, window)


def test_a_frequent_phrase_with_other_contexts(docs):
    """An anchor with as many contexts as documents, some of which share a window."""
    r, phrase = random.Random(2), " ".join(f"f{k}" for k in range(12))
    rows = [(k, f"{' '.join(f'l{r.randrange(10**6)}' for _ in range(40))} {phrase} {' '.join(f'r{r.randrange(10**6)}' for _ in range(40))}") for k in range(60)]
    rows += [(100, " ".join(rows[3][1].split()[20:60])), (101, " ".join(rows[4][1].split()[35:75]))]
    found = substrings.dedup_substrings(docs(rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found) == brute(rows, 35)
