"""Words and texts that agree in sums and products of their parts: Thue-Morse sequences and their complements."""

from test_corpus import brute_classes, found_classes

from tidewick.llm import near, substrings


def thue_morse(n, one, two):
    return [two if k.bit_count() % 2 else one for k in range(n)]


LONG = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))


def test_long_words_are_told_apart(docs):
    shared = [" ".join(f"l{k}" for k in range(34)), " ".join(f"r{k}" for k in range(34))]
    found = substrings.dedup_substrings(docs([(k, f"{shared[0]} {w} {shared[1]}") for k, w in enumerate(LONG)])).collect()
    assert [r.n_removed for r in found] == [0, 0]
    rows = [(k, f"a b {w} c d") for k, w in enumerate(LONG)]
    assert found_classes(near.dedup_near(docs(rows)).collect()) == brute_classes(rows) == [["0"], ["1"]]


def test_texts_of_many_words_are_told_apart(docs):
    rows = [(k, " ".join(thue_morse(1024, *pair))) for k, pair in enumerate((("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")))]
    assert found_classes(near.dedup_near(docs(rows)).collect()) == brute_classes(rows)
    seen = [tuple(t.split()[k : k + 35]) for _, t in rows for k in range(990)]
    assert len(seen) == 3960
    found = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(docs(rows)).collect()}
    for k, text in rows:
        w, gone = text.split(), set()
        for at in range(990):
            if seen.count(tuple(w[at : at + 35])) > 1:
                gone |= set(range(at, at + 35))
        assert found[k] == len(gone)
