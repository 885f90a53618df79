"""Near copies that differ in how often they repeat a passage inside themselves."""

import random

from test_corpus import brute_classes, found_classes

from tidewick.llm import near


def test_copies_that_repeat_a_passage_are_candidates(docs):
    r, rows = random.Random(6), []
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(120)]
        again = base[:]
        again[r.randrange(70, 110)] = "edited"
        passage = r.choice([30, 60])
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(again[:passage] * r.choice([5, 20, 100]) + again[passage:]))]
    want = brute_classes(rows)
    assert len(want) == 60 and found_classes(near.dedup_near(docs(rows)).collect()) == want


def test_passages_that_one_copy_repeats_300_times(docs):
    """Sixty pairs of Jaccard 0.96 and more whose weights by counts are far apart."""
    rows = []
    for family in range(60):
        base = [f"f{family}w{k}" for k in range(204)]
        rows += [(2 * family, " ".join(base)), (2 * family + 1, " ".join(base[:64] * 300 + base[64:]))]
    found = found_classes(near.dedup_near(docs(rows)).collect())
    assert len(found) == 60 and all(len(g) == 2 for g in found)
