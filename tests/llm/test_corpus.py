"""WARC, chat, toxicity, mixing, near-dedup, packing and the pipeline against brute force and round trips."""

import base64
import glob
import hashlib
import io
import json
import math
import random
import re
import struct
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from odd_rows import ODD, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewick.llm import chat, common, mixing, near, packing, queries, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, record_type int")


PAGES = [(1, "http://a/\r\nX: y", "<p>ä</p>", "p", 1), (2, None, "<p>ä</p>", "p", 1), (3, "u", None, "p", 1), (4, "u", "", "p", 1), (4, "u", "", "p", 1), (None, "u", "n", "p", 1), (5, "u", "n", "p", 1), (6, "u", "a\r\n\r\nb" * 300000, "p", 1), (None, "u", "alone", "p", 1)]


def test_warc_round_trip(spark):
    largest = defaultdict(lambda: -1)
    for i, _, html, *_ in PAGES:
        largest[html or ""] = max(largest[html or ""], -1 if i is None else i)
    want = Counter()
    for i, _, html, *_ in PAGES:
        body, best = (html or "").encode(), largest[html or ""]
        response = best == -1 or i == best
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else best)] += 1
    found = warc.round_trip(pages(spark, PAGES)).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert {bytes(r.payload) for r in found if r.record_type == "response"} == {(p[2] or "").encode() for p in PAGES}


def test_small_payloads_are_never_revisits(spark):
    folder = common.new_path(spark, "warc-test")
    warc.write_archives(pages(spark, PAGES), folder, min_bytes=2).collect()
    kinds = {r.page_id: r.record_type for r in warc.read_archives(spark, folder).where("page_id is not null").collect()}
    assert kinds[3] == kinds[4] == kinds[5] == "response" and kinds[1] == "revisit"


def test_revisits_are_answered(spark):
    records = warc.round_trip(pages(spark, PAGES))
    assert records.where("record_type = 'revisit'").count() > 0 and warc.unresolved_revisits(records).count() == 0
    lost = records.where("record_type = 'revisit' or page_id <> 2")
    assert {r.page_id for r in warc.unresolved_revisits(lost).collect()} == {1}


def test_long_archives_take_linear_time():
    def seconds(n):
        record = zstandard.compress(bytes(range(256)) * 8)
        began = time.perf_counter()
        assert sum(1 for _ in warc.frames(record * n, "a")) == n
        return time.perf_counter() - began

    assert seconds(40000) < 100 * seconds(2000)


def test_no_pages_no_records(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def archive(spark):
    folder = common.new_path(spark, "warc-test")
    rows = [(i, f"http://h/{i}", "".join(random.Random(i).choices("abcdef <>/", k=3000)) + "<html><body>common text</body>" * 60, "p", 1) for i in range(600)]
    warc.write_archives(pages(spark, rows).coalesce(1), folder).collect()
    (name,) = glob.glob(folder.removeprefix("file://").removeprefix("file:") + "/*")
    return folder, open(name, "rb").read()


def test_dictionary_leads_and_damage_is_found(spark):
    _, data = archive(spark)
    magic, length = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and length > 1000
    records = [r for _, r in warc.frames(data, "a")]
    assert len(records) == 600 and all(warc.parse(r, "a")["payload_bytes"] == 3000 + 30 * 60 for r in records)
    with pytest.raises(warc.BadArchive, match="cut short"):
        list(warc.frames(data[:-5], "a"))
    with pytest.raises(warc.BadArchive):
        list(warc.frames(data[: 8 + length] + b"junk" + data[8 + length :], "a"))
    with pytest.raises(warc.BadArchive, match="dictionary"):
        list(warc.frames(data[:500], "a"))
    good = records[0]
    for bad, what in ((good.replace(b"Content-Length: 4", b"Content-Length: 5"), "length"), (good.replace(b"common", b"cammon"), "digest"), (good.replace(b"WARC-Type", b"Other"), "warc-type"), (b"X" + good, "not a WARC")):
        with pytest.raises(warc.BadArchive, match=what):
            warc.parse(bad, "a")


def test_archives_of_others(spark, tmp_path):
    """No dictionary, an unknown skippable frame, a metadata record."""
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a #1 50%.warc.zst").write_bytes(zstandard.compress(record) + struct.pack("<II", 0x184D2A50, 2) + b"zz" + zstandard.compress(record))
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_type, bytes(r.payload)) for r in found] == [("metadata", b"abc")] * 2


def test_archives_are_no_rows(spark):
    folder, _ = archive(spark)
    plan = warc.read_archives(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


@pytest.mark.parametrize("step", [1, 7, 1 << 14])
def test_archives_in_steps_of_any_size(monkeypatch, step):
    monkeypatch.setattr(warc, "STEP", step)
    bodies = [bytes([i]) * (i * 37 % 300) for i in range(60)]
    skipped = struct.pack("<II", 0x184D2A51, 50) + b"z" * 50
    data = skipped.join(map(zstandard.compress, bodies))
    found = list(warc.frames(io.BytesIO(data), "a"))
    assert [body for _, body in found] == bodies
    assert all(zstandard.ZstdDecompressor().decompressobj().decompress(data[at:]) == body for at, body in found)


def test_where_files_lie():
    assert warc.located("/a:b/c")[1] == "/a:b/c" and warc.located("file:/a/b")[1] == warc.located("file:///a/b")[1] == "/a/b"


# Chat


def logs(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int, conv string")


def talk(conv, *texts):
    return [(conv, k, "user" if k % 2 == 0 else "assistant", t, 9, "z") for k, t in enumerate(texts)]


def test_snapshots_collapse(spark):
    rows = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "x") + talk(4, "a", "b", "c") + talk(5, "b") + talk(6, "a") + talk(None, "n") + talk(7, None, "") + talk(8, "", "") + talk(3, "a", "x")
    found = {r.conv_id: r for r in chat.collapse(logs(spark, rows)).collect()}
    assert sorted(found, key=str) == [2, 3, 5, 7, 8, None]
    assert found[2].n_logs == 2 and found[2].rendered == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n" and found[3].n_turns == 2


def test_long_conversations_across_partitions(spark):
    """One conversation has most of the turns; a prefix of it goes."""
    texts = [f"t{k}" for k in range(3000)]
    rows = talk(1, *texts) + talk(2, *texts[:1700]) + talk(3, *texts[:1700], "other") + [t for c in range(10, 40) for t in talk(c, "hi")]
    found = chat.collapse(logs(spark, rows), segment=1000).collect()
    assert Counter(r.conv_id for r in found) == {1: 3, 3: 2, 10: 1}
    whole = "".join(r.rendered for r in sorted((r for r in found if r.conv_id == 1), key=lambda r: r.segment))
    assert whole == "".join(f"<|{'user' if k % 2 == 0 else 'assistant'}|>\n{t}\n" for k, t in enumerate(texts))


def test_random_logs_against_brute_force(spark):
    r = random.Random(2)
    convs = {c: tuple(r.choice("ab") for _ in range(r.randint(1, 6))) for c in range(120)}
    found = {x.conv_id for x in chat.collapse(logs(spark, [t for c, x in convs.items() for t in talk(c, *x)])).collect()}
    first = {}
    for c, x in convs.items():
        first.setdefault(x, c)
    assert found == {c for x, c in first.items() if not any(y[: len(x)] == x and len(y) > len(x) for y in first)}
    assert chat.collapse(logs(spark, [])).count() == 0


# Toxicity


MODEL = toxicity.Model({" idiot ": 6.0, " clown ": 5.0, " vil": 4.0}, toxicity.EXCEPTIONS, -3.0, 1.0)


@pytest.mark.parametrize("text, hits", [("An IDIOT.", 1), ("1d10t", 1), ("іdіоt", 1), ("ídìöt", 1), ("idiotic", 0), ("a clown fish", 0), ("a clown", 1), ("vilest vile", 2), ("devil", 0), ("", 0), ("...", 0), ("i​diot", 1)])
def test_matching(text, hits):
    strength, found = toxicity.matcher(toxicity.Model({" ".join(["", *toxicity.words_of(t, toxicity.Folding()), ""]) if t.endswith(" ") else " " + toxicity.words_of(t, toxicity.Folding())[0]: w for t, w in MODEL.terms.items()}, *MODEL[1:]))(text)
    assert found == hits and (strength > 0) == (hits > 0)


def test_length_weakens():
    match = toxicity.matcher(toxicity.Model({" bad ": 5.0}, (), 0, 1))
    assert match("bad")[0] > match("bad " + "fine " * 100)[0] > match("bad " + "fine " * 10000)[0] > 0


def brute_match(model, text):
    """Regular expressions over the folded text, one term and phrase after the other."""
    fold = lambda t: "".join(c if c.isalnum() else " " for c in (toxicity.LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", "".join(x.lower() for x in t)) if unicodedata.category(c) not in ("Mn", "Cf"))).split()
    w = fold(text)
    body = f" {' '.join(w)} " if w else ""
    best = defaultdict(float)
    for term, weight in model.terms.items():
        for m in re.finditer(f"(?={re.escape(term)})", body):
            best[m.start()] = max(best[m.start()], weight)
    for phrase in model.exceptions:
        folded = f" {' '.join(fold(phrase))} "
        for m in re.finditer(f"(?={re.escape(folded)})", body):
            for at in range(m.start(), m.start() + len(folded) - 1):
                best.pop(at, None)
    return (math.log1p(100 * sum(best.values()) / math.sqrt(len(w))) if w else 0.0), len(best)


def test_scores_against_regular_expressions(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    assert model.terms
    model = model._replace(terms=model.terms | {" clown ": 3.0, " trash ": 2.0, " sc": 1.0}, exceptions=(*model.exceptions, "clown fish trash"))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [t for _, t in ODD] + ["a clown fish trash can", "trash can trash", "p0nd sсum, pond scum", "ﬁlth ﬁlthy", "İdiot ½ ǆ", "trash can clown " * 50]
    match = toxicity.matcher(model)
    for text in texts:
        strength, hits = match(text or "")
        want = brute_match(model, text or "")
        assert (pytest.approx(strength), hits) == want, text


def test_ligatures_fold_whole():
    assert toxicity.words_of("ﬁlth", toxicity.Folding()) == toxicity.words_of("filth", toxicity.Folding())


def test_exceptions_take_linear_time():
    match, times = toxicity.matcher(MODEL), []
    for n in (2000, 32000):
        began = time.perf_counter()
        assert match("trash can idiot " * n)[1] == n
        times.append(time.perf_counter() - began)
    assert times[1] < 100 * times[0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    judged = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.fold_of() == 1)
    n = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] > 0.8 * (n[(1, 1)] + n[(1, 0)]) and n.get((0, 1), 0) < 0.01 * n[(0, 0)]


def test_held_out_labels_are_not_read(spark, docs):
    rows = [(i, f"word{i % 5} vilify the {'nasty' if i % 2 else 'nice'} text {i}") for i in range(400)]
    df = docs(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_of() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(df, labels) == toxicity.fit(df, flipped)


def test_scores_of_odd_rows(spark, odd, docs):
    found = toxicity.score(odd, MODEL).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in found)
    none = toxicity.fit(docs([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.terms == {} and toxicity.score(docs([]), none).count() == 0
    assert all(r.predicted == 0 for r in toxicity.score(odd, none).collect())


# Mixing


def test_targets_are_the_fixed_point_of_resharing(spark):
    r = random.Random(4)
    for _ in range(3):
        sizes = {f"s{k:02}": r.choice([0, 1, 50, 1000, 20000]) for k in range(r.randint(1, 9))}
        names = sorted(sizes)
        weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
        target = {n: 0.0 for n in names}
        rest, free = 1.5 * sum(sizes.values()), set(names)
        while free and rest > 1e-9:
            share = sum(weight[n] for n in free)
            for n in free:
                target[n] += rest * weight[n] / share
            over = {n for n in free if target[n] >= 2 * sizes[n]}
            rest = sum(target[n] - 2 * sizes[n] for n in over)
            target |= {n: 2.0 * sizes[n] for n in over}
            free -= over
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        for row in mixing.source_targets(df).collect():
            assert row.target == pytest.approx(target[row.source], abs=1e-6)


def test_mix(spark, docs):
    r = random.Random(1)
    rows = [(k, "w " * int(r.paretovariate(0.9) * 10 % 3000)) for k in range(600)] + ODD
    df = docs(rows).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4)))
    common.cut(df, "mix-test")
    stored = common.cut(df, "mix-test")
    found = mixing.mix_sources(stored).collect()
    again = mixing.mix_sources(stored).collect()
    key = lambda x: (str(x.doc_id), x.size, x.copies)
    assert sorted(map(key, found)) == sorted(map(key, again)) and len(found) == len(rows)
    taken, largest = Counter(), Counter()
    for x in found:
        assert 0 <= x.copies <= 2 and x.size == len(words(x.text))
        taken[x.source] += x.size * x.copies
        largest[x.source] = max(largest[x.source], x.size)
    for s, t in {x.source: x.target for x in found}.items():
        assert abs(taken[s] - t) <= 2 * largest[s] + 1e-6
    emitted = mixing.emit_copies(mixing.mix_sources(stored), stored.columns)
    assert emitted.columns == stored.columns and emitted.count() == sum(x.copies for x in found)


def test_draws_follow_the_fraction(docs):
    """Each document wins for its own hash: the limit is near the fraction, and more weight only adds winners."""
    df = common.cut(docs([(k, "w " * (1 + k % 7)) for k in range(4000)]).withColumn("source", F.lit("one")), "mix-test")
    won = {budget: {r.doc_id for r in mixing.mix_sources(df, budget=budget).collect() if r.copies > int(budget)} for budget in (0.2, 1.2, 1.5, 1.9)}
    assert won[0.2] == won[1.2] < won[1.5] < won[1.9]
    assert all(abs(len(ids) - 4000 * (budget % 1)) < 100 for budget, ids in won.items())


def test_copies_of_documents_with_a_column_copy(docs):
    df = docs([(1, "a b"), (2, "c")], copy=7, copies=8, size=9)
    found = mixing.emit_copies(mixing.mix_sources(df), df.columns).collect()
    assert {r["copy"] for r in found} == {7}


def test_mix_of_nothing(docs):
    assert mixing.mix_sources(docs([])).count() == 0
    assert [r.copies for r in mixing.mix_sources(docs([(1, None), (2, " ")])).collect()] == [0, 0]


# Near duplicates


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = not sets[a] and not sets[b] or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if same and find(a) != find(b):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(k)
    return sorted(sorted(map(str, (rows[k][0] for k in g))) for g in groups.values())


def found_classes(found):
    groups = defaultdict(list)
    for r in found:
        groups[(r.class_id, r.class_size)].append(r)
    for (_, n), rows in groups.items():
        assert len(rows) == n and sum(r.kept for r in rows) == 1
    return sorted(sorted(str(r.doc_id) for r in rows) for rows in groups.values())


def edited(r, base, share):
    w = list(base)
    for k in r.sample(range(len(w)), int(share * len(w))):
        w[k] = f"e{r.random()}"
    if r.random() < 0.3:
        del w[r.randrange(len(w)) :][: r.randint(0, 9)]
    return " ".join(w)


def test_near_copies_against_all_pairs(docs):
    """Families of copies with more and less edits, in chains too, so that classes need links that no centre has."""
    r = random.Random(8)
    rows, n = [], 0
    for family in range(12):
        base = [f"f{family}w{r.randrange(400)}" for _ in range(r.randint(30, 160))]
        for _ in range(r.choice([2, 5, 40])):
            text = edited(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06]))
            if r.random() < 0.3:
                base = text.split()
            rows.append((n := n + 1, text))
    rows += [(1000 + k, " ".join(f"u{r.random()}" for _ in range(40))) for k in range(30)]
    assert found_classes(near.dedup_near(docs(rows)).collect()) == brute_classes(rows)


@pytest.mark.parametrize("members, shingles", [(3, 10**9), (512, 400)])
def test_tiles_lose_no_link(docs, monkeypatch, members, shingles):
    """A family whose members are near the border of similarity, in buckets of several tiles."""
    monkeypatch.setattr(near, "TILE_MEMBERS", members)
    monkeypatch.setattr(near, "TILE_SHINGLES", shingles)
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = [(k, edited(r, base, r.choice([0.01, 0.02, 0.025, 0.03, 0.05]))) for k in range(30)]
    assert found_classes(near.dedup_near(docs(rows)).collect()) == brute_classes(rows)


def test_near_copies_of_odd_rows(odd, docs):
    found = near.dedup_near(odd).collect()
    assert len(found) == len(ODD)
    groups = defaultdict(set)
    for r in found:
        groups[" ".join(words(r.text))].add(r.class_id)
    assert all(len(g) == 1 for g in groups.values())
    assert near.dedup_near(docs([])).count() == 0


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(5)
    a, b = r.integers(1, 1 << 60, 300).astype(np.uint64), r.integers(1, 1 << 60, 300).astype(np.uint64)
    b[:200] = a[:200]
    wa, wb = 1 + r.random(300) * 3, 1 + r.random(300) * 3
    wb[:200] = wa[:200]
    exact = sum(1 / (sum(max(x / wa[k], y / wb[k]) for x, y in zip(wa[:200], wb[:200], strict=True)) + wa[200:].sum() / wa[k] + wb[200:].sum() / wb[k]) for k in range(200))
    sig = near.prob_min_hash(np.repeat([0, 1], 300), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    scaled = near.prob_min_hash(np.zeros(300, dtype=np.int64), a, 7 * wa, 1, 4000)
    assert (scaled[0] == near.prob_min_hash(np.zeros(300, dtype=np.int64), a, wa, 1, 4000)[0]).all()


# Packing


def check_packing(found, rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = [(i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows]
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0
    crc = lambda part: zlib.crc32(np.array(part, dtype="<u4").tobytes())
    want, have = Counter(), Counter()
    for i, all_ids in ids:
        want[(i, len(all_ids))] += 1
    for r in found:
        have[(r.doc_id, r.doc_tokens)] += r.length
        assert any(crc(x[r.start : r.start + r.length]) == r.ids_crc32 for i, x in ids if i == r.doc_id and len(x) == r.doc_tokens)
    assert have == Counter({k: k[1] * n for k, n in want.items()})


def test_packing(docs):
    rows = ODD + [(100 + k, f"It's the {k}th naïve CAFÉ, isn't it? <|endoftext|> 漢字 ΣΑΣ {'x' * k}" * (k % 7)) for k in range(60)]
    check_packing(packing.pack(docs(rows), tokenizer=TOKENIZER).collect(), rows)
    assert packing.pack(docs([]), tokenizer=TOKENIZER).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    encode, tokenizer = packing.Encoder(TOKENIZER, 2), Tokenizer.from_file(TOKENIZER)
    assert encode.by_word
    for text in ("a.b c!? 'tis é é", "<|startoftext|> x\x1cy z q", "THE!! don't. İ ß ÿ ½ ² ٣", "x" * 500 + " …"):
        assert np.frombuffer(encode(text), dtype=np.uint16).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("change", [{"truncation": {"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}}, {"added": "two words"}, {"added": "plain"}, {"added": "!?"}])
def test_other_steps_take_the_whole_tokenizer(tmp_path, change):
    with open(TOKENIZER, encoding="utf-8") as file:
        steps = json.load(file)
    if "added" in change:
        tokenizer = Tokenizer.from_file(TOKENIZER)
        tokenizer.add_tokens([change["added"]])
        tokenizer.save(str(tmp_path / "t.json"))
    else:
        (tmp_path / "t.json").write_text(json.dumps(steps | change), encoding="utf-8")
    encode, tokenizer = packing.Encoder(str(tmp_path / "t.json"), 2), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not encode.by_word
    for text in ("some plain words and two words more!? of explained text", ""):
        assert np.frombuffer(encode(text), dtype=np.uint16 if encode.code == "H" else np.uint32).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_encoder_agrees_on_whole_texts(spark):
    encode, tokenizer = packing.Encoder(TOKENIZER, 2), Tokenizer.from_file(TOKENIZER)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        assert np.frombuffer(encode(r.text), dtype=np.uint16).tolist() == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]


def test_hilbert_neighbours_touch():
    grid = np.array([[x, y] for x in range(16) for y in range(16)])
    keys = packing.hilbert(grid, bits=4)
    order = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(256)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# The pipeline


def test_pipeline_stages(spark, data):
    """Each stage on what the one before kept, held against plain Python."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = docs = common.cut(stage(spark, docs, data), "test-stage")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {n: {r.doc_id: r.text for r in f.collect()} for n, f in frames.items() if n != "packing"}
    assert texts["line dedup"].keys() == texts["toxicity"].keys()
    held = defaultdict(set)
    for i, t in texts["toxicity"].items():
        for line in t.split("\n"):
            held[line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].add(i)
    lowered = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for i, t in texts["toxicity"].items():
        keep = [x for x in t.split("\n") if not (len(k := lowered(x)) >= 10 and len(held[k]) > 1 and min(held[k]) != i)]
        assert texts["line dedup"][i] == "\n".join(keep)
    rows = sorted(texts["line dedup"].items())
    assert sorted(texts["near dedup"]) == sorted(min(map(int, g)) for g in brute_classes(rows))
    assert texts["mixing"].items() <= texts["near dedup"].items()
    check_packing(frames["packing"].collect(), [(r.doc_id, r.text) for r in frames["mixing"].collect()])


CLASHES = ("score", "strength", "hits", "predicted", "kept", "n_lines", "n_dropped", "kept_text", "class_id", "class_size", "size", "source_size", "target", "rate", "copies", "copy", "row", "k1", "other_columns", "gone")


def test_pipeline_keeps_columns_of_any_name(spark, odd, tmp_path):
    own = odd.drop(*CLASHES).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), F.monotonically_increasing_id().alias("mark"))
    docs = common.cut(own.withColumns({c: F.concat(F.lit(c), "mark") for c in CLASHES}), "pipeline-test")
    spark.createDataFrame([(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    whole = {r.mark: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.cut(stage(spark, docs, str(tmp_path)), "pipeline-test")
        assert out.columns == docs.columns
        for r in out.collect():
            want, got = whole[r.mark], r.asDict()
            changed = {c for c in docs.columns if want[c] != got[c]}
            assert changed <= ({"text", "n_chars"} if name == "line dedup" else set()), (name, changed)


def test_pipeline_of_odd_documents(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in packed} <= {i for i, _ in ODD} and all(r.n > 0 for r in packed) and len(packed) > 3
    spark.createDataFrame([], odd.schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_whole_queries_return_their_columns(spark, data):
    n = spark.read.parquet(f"{data}/documents.parquet").count()
    scored = queries.QUERIES["op3_toxicity"](spark, data)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and scored.count() == n
    assert scored.where("(score >= 0.7) <> (predicted = 1)").count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert found_classes(queries.QUERIES["op9_near_dedup"](spark, data).collect()) == brute_classes(rows)
    check_packing(queries.QUERIES["op10_packing"](spark, data).collect(), rows)
