"""Line dedup, quality rules, exact dedup and substring dedup against brute force on odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD, words
from pyspark.sql import functions as F

from tidewick.llm import common, exact, lines, rules, substrings

STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_lines(odd):
    held = defaultdict(set)
    for i, t in ODD:
        for line in (t or "").split("\n"):
            if len(key := lower(line.strip(STRIP))) >= 10:
                held[key].add(i)
    first = lambda ids: min(ids, key=lambda i: (i is None, i))
    want = Counter()
    for i, t in ODD:
        all_lines = (t or "").split("\n")
        keep = [x for x in all_lines if not (len(held.get(k := lower(x.strip(STRIP)), ())) >= 2 and first(held[k]) != i)]
        want[(i, len(all_lines), len(all_lines) - len(keep), "\n".join(keep))] += 1
    found = lines.dedup_lines(odd)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()) == want
    assert set(odd.columns) <= set(found.columns)


def test_line_threshold(docs):
    df = docs([(i, "a frequent line\nb") for i in range(3)])
    assert all(r.n_dropped == 0 for r in lines.dedup_lines(df, min_docs=4).collect())
    assert sum(r.n_dropped for r in lines.dedup_lines(df, min_docs=3).collect()) == 2


def test_many_dropped_lines_keep_their_order(docs):
    body = "\n".join(f"a shared line {k}" if k % 3 else f"own {k}" for k in range(3000))
    found = {r.doc_id: r.kept_text for r in lines.dedup_lines(docs([(1, body), (2, body + "\nlast")])).collect()}
    assert found[1] == body and found[2] == "\n".join([f"own {k}" for k in range(0, 3000, 3)] + ["last"])


def measured(text):
    w, body = words(text), text or ""
    where = defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    covered = {k + d for at in where.values() if len(at) > 1 for k in at for d in range(8)}
    full = [x for x in body.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", body)), len(full) - len(set(full)), len(covered)


def test_measures(docs):
    texts = [*[t for _, t in ODD], "a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "x " * 9, "x " * 8, "é#*$ %&|<> é\né\n é", "The first\nThe first\nthe"]
    found = rules.quality(docs(list(enumerate(texts))))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_rules_drop_junk_and_keep_prose(docs):
    prose = "The house on the hill is old and it was for a long time the home of the same two people, as we all know by now."
    junk = ["#tag *** " * 30, " | ".join(f"w{i}" for i in range(60)), "buy now! " * 5 + prose.upper().replace(" ", "!! "), "same same " * 40]
    found = {r.doc_id: r.kept for r in rules.quality(docs(list(enumerate([prose, *junk])))).collect()}
    assert found == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_rule_plan_has_no_exchange_and_no_python(odd):
    plan = rules.quality(odd.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def bare(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact(odd):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, i))
    found = exact.dedup_exact(odd).collect()
    assert len(found) == len(ODD)
    for r in found:
        group = groups[bare(r.text)]
        assert (r.keep_id, r.group_size, r.text_sha256) == (min(group)[3], len(group), hashlib.sha256(bare(r.text).encode()).hexdigest())
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})


def signed(docs, spread):
    rows = docs.repartition(spread).withColumn("r", F.monotonically_increasing_id())
    return common.cut(exact.signatures(rows, "text", "doc_id", "r"), "exact-test").repartition(spread)


def test_merge_in_several_rounds(docs):
    base = signed(docs([(k, str(k % 7)) for k in range(4000)]), 40)
    for fan_in in (2, 3, 64):
        found = exact.merge_runs(base, 40, fan_in).collect()
        assert sorted((r.doc, r.group_size) for r in found) == [(k, 572 if k < 3 else 571) for k in range(7)]


@pytest.mark.parametrize("column", ["n_bytes", "second"])
def test_a_digest_of_two_texts_is_an_error(docs, column):
    forged = signed(docs([(k, "same text") for k in range(40)]), 8).withColumn(column, F.when(F.col("doc") == 39, 1).otherwise(F.col(column)))
    with pytest.raises(Exception, match="two texts share a digest"):
        exact.merge_runs(forged, 8, 2).collect()


def test_runs_go_on_over_batches(spark, docs):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = exact.merge_runs(signed(docs([(k, str(k % 3)) for k in range(200)]), 2), 8, 8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.doc, r.group_size) for r in found) == [(0, 67), (1, 67), (2, 66)]


def test_substrings(docs):
    shared = " ".join(f"s{k}" for k in range(50))
    texts = [*[t for _, t in ODD], f"a b {shared} c", f"{shared}", f"x {shared.replace('s20 ', 'other ')} y", " ".join(f"s{k}" for k in range(34)), "r t " * 40, f"z {' '.join(f's{k}' for k in range(9, 45))}"]
    rows = list(enumerate(texts))
    seen = Counter(tuple(w[k : k + 35]) for w in map(words, texts) for k in range(len(w) - 34))
    want = {}
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                keep[k : k + 35] = [False] * 35
        want[i] = (len(w), len(w) - sum(keep), " ".join(x for x, y in zip(w, keep, strict=True) if y))
    found = substrings.dedup_substrings(docs(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == want
    assert all(sum(r.cut_lengths) == r.n_removed for r in found)


def test_empty_tables(docs):
    none = docs([])
    for found in (lines.dedup_lines(none), rules.quality(none), exact.dedup_exact(none), substrings.dedup_substrings(none)):
        assert found.count() == 0
