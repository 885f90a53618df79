"""What the toxicity lexicon learns, against a plain version of the learning."""

import zlib
from collections import Counter, defaultdict
from math import exp, log

import pytest

from tidewick.llm import toxicity as tox

FOLDER = "/root/testdata/sf0.1"


def plain_terms(rows):
    """Term -> weight from (text, toxic) rows: contexts in toxic texts, occurrences in clean ones."""
    folding, contexts, clean, n1, n0 = tox.Folding(), defaultdict(set), Counter(), 0, 0
    for text, toxic in rows:
        before = ""
        for word in tox.words_of(text or "", folding):
            places = [f" {word} "] + [" " + word[:k] for k in (4, 5, 6, 7) if len(word) > k]
            for term in places:
                if toxic:
                    contexts[term].add((before, word))
                else:
                    clean[term] += 1
            n1, n0, before = n1 + toxic, n0 + (not toxic), word
    found = {}
    for term, seen in contexts.items():
        t, c = len(seen), clean[term]
        ratio = log((t + 0.5) / (n1 + 1)) - log((c + 0.5) / (n0 + 1))
        expected = ((t + c) * n1 / (n1 + n0), (t + c) * n0 / (n1 + n0))
        g2 = 2 * sum(x * log(x / e) for x, e in zip((t, c), expected, strict=True) if x and e)
        if t >= 4 and ratio >= log(12) and g2 >= 20:
            found[term] = min(8.0, ratio)
    return found


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.toxic is not None}
    rows = [(r.text, known[r.doc_id]) for r in docs.select("doc_id", "text").collect() if r.doc_id in known]
    return tox.fit(docs, labels), rows


def test_the_lexicon_is_that_of_the_plain_version(learned):
    model, rows = learned
    want = plain_terms(rows)
    assert len(want) > 5 and model.terms.keys() == want.keys()
    assert all(model.terms[t] == pytest.approx(w, abs=1e-9) for t, w in want.items())


def test_the_curve_is_the_best_one(learned):
    """Bias and slope are where the likelihood of all training rows, with the ridge on the slope, has no gradient."""
    model, rows = learned
    match = tox.matcher(model)
    at = [(round(match(text or "")[0] / tox.BIN) * tox.BIN, toxic) for text, toxic in rows]
    missed = [toxic - 1 / (1 + exp(-(model.bias + model.slope * x))) for x, toxic in at]
    assert model.slope > 0
    assert abs(sum(missed)) < 1e-2 and abs(sum(m * x for m, (x, _) in zip(missed, at, strict=True)) - 0.02 * model.slope) < 1e-2
