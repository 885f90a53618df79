"""Divergence of sources, interaction of filters and URL rules against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
import xxhash
from odd_rows import words
from pyspark.sql import functions as F

from tidewick.llm import divergence, interactions, queries, urls

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Divergence


def brute_divergence(rows, top):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOWER))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        others = [s for of, s in counts if of == lang]
        total = Counter()
        for s in others:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // whole for t in kept}

        p, q = shares(counts[lang, source]), shares(total)
        pairs = []
        for other in others:
            if other != source:
                o = shares(counts[lang, other])
                pairs.append((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode(), other))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item, -value, rank + 1) for rank, (value, _, item) in enumerate(sorted(found)[:limit])]
    return Counter(out)


def corpus(spark, rows):
    made = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, term long, value string")
    return made.repartition(5)


@pytest.mark.parametrize("top", [1, 3, 200])
def test_divergence(spark, top):
    draw = random.Random(top)
    vocabulary = ["ab", "Abc", "abd", "ä", "äö", "naïve", "x_y", "q-r", "中文", "zz9z", "b" * 40, "b" * 40 + "c", *(f"t{chr(97 + k)}" for k in range(20))]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", "", None]), " ".join(draw.choices(vocabulary, k=draw.randrange(30)))) for _ in range(90)]
    rows += [(None, None, None), ("xx", "s1", "only here"), ("xx", "s2", ""), ("yy", "s9", "alone alone"), ("en", "s1", "word " * 50_000)] + [("en", "s2", "same row twice")] * 4
    found = divergence.audit(corpus(spark, rows), top=top).collect()
    assert Counter(tuple(r) for r in found) == brute_divergence(rows, top)


def test_terms_are_passed_on_piece_by_piece(spark, monkeypatch):
    rows = [("en", f"s{k % 3}", " ".join(f"w{chr(97 + (k * j) % 26)}" for j in range(50))) for k in range(40)]
    batches = corpus(spark, rows).toArrow().to_batches(7)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "PIECE_BYTES", 3)
    total, docs = Counter(), Counter()
    for batch in divergence.term_counts(iter(batches)):
        for r in batch.to_pylist():
            total[r["source"], r["term"]] += r["n"]
            docs[r["term"]] += r["docs"]
    want, in_docs = Counter(), Counter()
    for _, source, text in rows:
        want.update((source, t) for t in TERM.findall(text))
        in_docs.update(set(TERM.findall(text)))
    assert {k: n for k, n in total.items() if k[1]} == dict(want) and {k: n for k, n in docs.items() if k} == dict(in_docs)


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_radix_selection(spark, k):
    """Values of all sizes, many ties, items that begin alike, repeats and groups of fewer rows than wanted."""
    draw = random.Random(k)
    values = [0, 1, 2, 65535, 65536, 2**40, 2**62, 10**18]
    rows = [(draw.choice("ab"), draw.choice(values), draw.choice(["", "a", "ab", "abc", "abcd", "abce", "ä", "äb", "é" * 9, "é" * 9 + "a"])) for _ in range(300)] + [("c", 7, "one")]
    found = divergence.largest(spark.createDataFrame(rows, "g string, v long, i string").repartition(4), ["g"], "v", "i", k).collect()
    want = []
    for g in "abc":
        best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]
        want += [(*r, place + 1) for place, r in enumerate(best)]
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_no_documents_no_divergence(spark):
    assert divergence.audit(corpus(spark, [("en", "s", "a")]).limit(0)).count() == 0


# Interactions


def brute_interactions(rows, labels):
    """rows: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    failed = []
    for doc_id, _, text in rows:
        body, found = text or "", words(text)
        f = {"A": len(found) < 100, "B": 100 * len(set(found)) < 80 * len(found), "C": 100 * sum("A" <= c <= "Z" for c in body) > 10 * len(body), "D": any(c in "#$%&*|" for c in body)}
        f["E"] = any(i is not None and doc_id is not None and i < doc_id and (t or "") == body for i, _, t in rows)
        failed.append({k for k, v in f.items() if v})
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {r[1] or "" for r in rows}:
        mine = [(i, s) for (i, lang, _), s in zip(rows, failed, strict=True) if (lang or "") == part]
        totals = Counter()
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                totals[name] += len(gone)
                redundant = sum(name in s and bool(s & set(order[:step])) for _, s in mine)
                out[part, "".join(order), step + 1] = [len(left), len(gone), redundant, sum(s == {name} for _, s in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (of, order, step), counts in out.items():
            if of == part:
                counts.append(totals[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_interactions(spark):
    draw = random.Random(3)
    texts = [None, "", "one two", "UPPER CASE", "a & b", " ".join(f"w{k}" for k in range(120)), " ".join(["again"] * 130), "Ü" * 50 + " A", "word " * 60000, " ".join(f"w{k}" for k in range(100)), "\t\n "]
    rows = [(draw.choice([None, *range(25)]), draw.choice(["en", "de", None, ""]), draw.choice(texts)) for _ in range(120)]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in range(20)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, lang string, text string, failed long, quality int").repartition(4)
    found = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(r) for r in found} == brute_interactions(rows, labels) and len(found) == 3 * 600


def test_more_parts_than_one_block(spark):
    docs = spark.range(150).select(F.col("id").alias("doc_id"), F.concat(F.lit("p"), "id").alias("lang"), F.lit("x").alias("text")).coalesce(1)
    found = interactions.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.count() == 150 * 600 and found.where("step = 5 and kept > 0").count() == 0
    assert interactions.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# URLs


def brute_urls(pairs, rules):
    out = []
    for i, url in pairs:
        rest = (url or "").partition("://")[2]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0].encode())), default=None)
        out.append((i, host, path, best and best[0] + best[1], best[2] if best else "allow"))
    return Counter(out)


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM/", "http://a.Example.com/en/x?y#z", "https://www.example.com/en/", "https://x.www.example.com/en/a", "http://example.com", "http://example.com?/en/", "http://example.com#/en/",
    "http://notexample.com/en/", "http://com.net/es/", "http://net/es", "http://a.net/fr/é/b", "x://y://com/", "http://a..net/es/", "http://net./es/", "http://münchen.de/straße/1", "http://" + "a." * 3000 + "net/es/" + "b" * 50000, "http://a.net/es/\nb",
]
RULES = [*queries.URL_RULES, ("münchen.de", "/straße", "block"), ("münchen.de", "/straß", "allow"), ("de", "", "block"), ("example.com", "/e", "allow")]


@pytest.mark.parametrize("shard_entries", [1, 4, 1 << 20])
def test_url_rules(spark, shard_entries):
    pairs = [*enumerate(URLS), (None, URLS[6]), (6, URLS[6])]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in pairs], "page_id long, url string, host string, rule string").repartition(3)
    index = urls.build_index(spark.createDataFrame(RULES, "host string, path string, verdict string"), shard_entries=shard_entries)
    found = urls.judge(pages, index).collect()
    assert Counter(tuple(r) for r in found) == brute_urls(pairs, RULES)
    assert urls.judge(pages.limit(0), index).count() == 0


def test_long_lists_are_split(spark):
    rules = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".example")).alias("host"), F.lit("/a").alias("path"), F.lit("block").alias("verdict"))
    index = urls.build_index(rules.unionByName(rules.withColumn("verdict", F.lit("allow"))), shard_entries=500)
    assert index.count() > 5 and index.agg(F.sum("entries")).first()[0] == 5000
    pages = spark.range(5500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), "id", F.lit(".example/abc")).alias("url"))
    assert urls.judge(pages, index).where("verdict = 'block'").agg(F.count("*"), F.max("page_id")).first() == (5000, 4999)


def test_odd_rules(spark):
    schema = "host string, path string, verdict string"
    index = urls.build_index(spark.createDataFrame([(None, "/x", "block"), ("", "/x", "block"), ("A.b", None, "block"), ("c", "/", "allow"), ("c", "/", "block")], schema))
    pages = spark.createDataFrame([(1, "http://a.B/x"), (2, "http://z/x"), (3, "http://c/")], "page_id long, url string")
    assert {(r.page_id, r.rule, r.verdict) for r in urls.judge(pages, index).collect()} == {(1, "a.b", "block"), (2, None, "allow"), (3, "c/", "block")}
    empty = urls.build_index(spark.createDataFrame([], schema))
    assert {r.verdict for r in urls.judge(pages, empty).collect()} == {"allow"}


def test_a_digest_alone_decides_nothing(spark, monkeypatch):
    """With one digest for all texts, binary search finds every entry, and whole strings decide."""
    index = urls.build_index(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    (file,) = index.collect()
    shard = urls.Shard(file.file)
    shard.keys = shard.keys * 0
    asked = [b"net/es/", b"net/xx/", b"example.com/en/"]
    import numpy as np

    assert sorted(shard.found(np.zeros(3, dtype=np.int64), asked, np.array([3, 3, 11]))) == [(0, True), (2, True)]
    assert not list(shard.found(np.zeros(1, dtype=np.int64), [b"net/es/"], np.array([4])))
    assert xxhash.xxh64_intdigest(b"net/es/", urls.SEED) - (1 << 64) * (xxhash.xxh64_intdigest(b"net/es/", urls.SEED) >> 63) == spark.range(1).select(F.xxhash64(F.lit("net/es/"))).first()[0]
