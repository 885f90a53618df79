"""Recall of near-dedup on the generated documents, against all pairs of the stated queries and all rows."""

import re
from collections import Counter, defaultdict

from tidewick.llm import near

FOLDER = "/root/testdata/sf0.1"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_links_of_every_hundredth_document(spark):
    """Every document with a Jaccard similarity of 0.8 or more to a query (doc_id divisible by 100) is in its class."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    holders = defaultdict(list)
    for query in (i for i in texts if i % 100 == 0):
        for shingle in texts[query]:
            holders[shingle].append(query)
    common = Counter()
    for i, own in texts.items():
        for shingle in own:
            common.update((query, i) for query in holders.get(shingle, ()) if query != i)
    links = [(q, i) for (q, i), n in common.items() if 10 * n >= 8 * (len(texts[q]) + len(texts[i]) - n)]
    of = {r.doc_id: r.class_id for r in near.dedup_near(docs).select("doc_id", "class_id").collect()}
    assert len(links) > 20
    assert [pair for pair in links if of[pair[0]] != of[pair[1]]] == []
