"""Near-duplicate detection: ProbMinHash signatures, banding, verification and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from secrets import token_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_skewed, numbered
from .hashing import WordKeys, Windows, chunks, joined, mix, signed

#: Words of a shingle, similarity of a link, bands of a signature and registers of a band.
SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 20, 5
#: Members and shingles that a tile of a bucket has on average, at most.
TILE_MEMBERS, TILE_SHINGLES = 512, 500_000


def shingle_hashes(at: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle of some texts; a text of fewer words than a shingle is one shingle."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = Windows(words)(size)
    inside = np.flatnonzero(doc[: len(hashes)] == doc[size - 1 :]) if len(hashes) else np.empty(0, dtype=np.int64)
    docs, found = [doc[inside]], [hashes[inside]]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        whole = words[at[short]]
        for step in range(1, k):
            whole = joined(whole, words[at[short] + step])
        docs.append(short)
        found.append(mix(whole + np.uint64(k)))
    return np.concatenate(docs).astype(np.int64), np.concatenate(found)


def weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight) of the distinct elements of each row; an element found c times weighs 1 + log c."""
    order = np.lexsort((element, doc))
    doc, element = doc[order], element[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])]))
    return doc[new], element[new], 1.0 + np.log(np.diff(np.concatenate([new, [len(doc)]])))


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, registers: int) -> np.ndarray:
    """Signatures whose registers agree with the probability Jaccard similarity of two rows.

    Each element is a Poisson process with its weight as rate; its points, seeded by the element, fall on random
    registers, and a register keeps the element with the earliest point. Points come in time order, so an element ends
    once its last point is later than everything that its row's registers hold. All elements take a step together.
    """
    best = np.full(rows * registers, np.inf)
    time = np.zeros(len(element))
    points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last, step = np.empty(0), 0
    while len(element):
        step += 1
        drawn = mix(element + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        uniform = ((drawn >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
        time = time - np.log(uniform) / weight
        slot = doc * registers + (mix(drawn) % np.uint64(registers)).astype(np.int64)
        early = time < best[slot]
        np.minimum.at(best, slot[early], time[early])
        points.append((slot[early], time[early], element[early]))
        if step <= 8 or step % 8 == 0:
            last = best.reshape(rows, registers).max(axis=1)
        active = time < last[doc]
        if not active.all():
            doc, element, weight, time = doc[active], element[active], weight[active], time[active]
    signature = np.zeros(rows * registers, dtype=np.uint64)
    for slot, when, what in points:
        held = when == best[slot]
        signature[slot[held]] = what[held]
    return signature.reshape(rows, registers)


def band_keys(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, bands: int, band_rows: int) -> np.ndarray:
    """A hash for each band of each row's signature."""
    found = prob_min_hash(doc, element, weight, rows, bands * band_rows).reshape(rows, bands, band_rows)
    keys = np.zeros((rows, bands), dtype=np.uint64)
    for k in range(band_rows):
        keys = mix(keys + found[:, :, k] + np.arange(1, bands + 1, dtype=np.uint64))
    return keys


def digest(text: pa.StringScalar) -> bytes:
    """SHA-256 of the words with single spaces between."""
    return sha256(b" ".join((text.as_py() or "").encode().split())).digest()


def signatures(size: int, bands: int, band_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, digest of the words, band hashes); no bands without words.

    Links compare sets, so each text has the bands of a signature in which all shingles weigh the same: its probability
    Jaccard is the similarity of links. Where shingles repeat, the bands of the signature weighted by counts come on top.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                has = np.diff(chunk.at) > 0
                keys = np.zeros((chunk.rows, bands), dtype=np.uint64)
                even = keys
                doc, element = shingle_hashes(chunk.at, chunk.words, size)
                if len(doc):
                    doc, element, weight = weighted(doc, element)
                    keys = band_keys(doc, element, weight, chunk.rows, bands, band_rows)
                    even = keys.copy()
                    repeats = np.unique(doc[weight > 1])
                    mine = np.isin(doc, repeats)
                    if len(repeats):
                        even[repeats] = band_keys(np.searchsorted(repeats, doc[mine]), element[mine], np.ones(int(mine.sum())), len(repeats), bands, band_rows)
                # A key of both signatures counts once: equal bands of a text would look like two texts.
                both, held = np.hstack([keys, even]), np.hstack([np.repeat(has[:, None], bands, axis=1), even != keys])
                ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                rows = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), rows.column("doc_id"), pa.array(list(map(digest, rows.column("text"))), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), signed(both[held]))],
                    names=["row", "doc_id", "digest", "bands"],
                )

    return run


def shingler(size: int, key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distinct shingles of each text, sorted, by digests of their words under a secret key, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys(key)
        for batch in batches:
            for chunk in chunks(batch.column("text"), keys=keys):
                doc, element, _ = weighted(*shingle_hashes(chunk.at, chunk.words, size))
                n = np.bincount(doc, minlength=chunk.rows)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("rep").slice(chunk.first, chunk.rows), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), signed(element))], names=["rep", "n", "shingles"])

    return run


def similar(common: np.ndarray | int, n: np.ndarray | int, m: np.ndarray | int, similarity: float) -> np.ndarray | bool:
    return common >= similarity * (n + m - common)


def linked_pairs(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs (u, v) of similar shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, pivot_set, linked = None, np.empty(0, dtype=np.int64), []
            for i, pivot in enumerate(batch.column("v").to_pylist()):
                if pivot != last:
                    last, pivot_set = pivot, batch.column("pivot_set")[i].values.to_numpy()
                own = batch.column("member_set")[i].values.to_numpy()
                common = len(np.intersect1d(own, pivot_set, assume_unique=True))
                linked.append(bool(similar(common, len(own), len(pivot_set), similarity)))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    return run


class Block:
    """The members of one tile of a bucket, or of two, with their labels, sides and shingle sets."""

    def __init__(self) -> None:
        self.labels: list[int] = []
        self.sides: list[int] = []
        self.sets: list[np.ndarray] = []

    def links(self, similarity: float) -> Iterator[tuple[int, int]]:
        """Pairs of labels that similar members join, few enough to be a forest; two tiles give the pairs across.

        Sets become rows of bits over the shingles that several members have, and a member's row meets those of all
        members of other classes at once.
        """
        labels, sides = np.array(self.labels), np.array(self.sides)
        if len(self.sets) < 2 or (labels == labels[0]).all():
            return
        sizes = np.array([len(s) for s in self.sets])
        held, where, counts = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        place = np.cumsum(counts > 1) - 1
        shared = counts[where] > 1
        column, member = place[where[shared]], np.repeat(np.arange(len(sizes)), sizes)[shared]
        bits = np.zeros((len(sizes), ((counts > 1).sum() + 64) // 64 * 8), dtype=np.uint8)
        np.add.at(bits, (member, column >> 3), (1 << (column & 7)).astype(np.uint8))
        bits = bits.view(np.uint64)
        group, two = labels.copy(), (sides != sides[0]).any()
        for i in range(len(sizes)):
            ahead = (group != group[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
            if two:
                if sides[i] != sides[0]:
                    continue
                ahead &= sides != sides[i]
            else:
                ahead[: i + 1] = False
            others = np.flatnonzero(ahead)
            if not len(others):
                continue
            common = np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
            for j in others[similar(common, sizes[others], sizes[i], similarity)]:
                if group[j] != group[i]:
                    yield int(labels[i]), int(labels[j])
                    group[group == group[j]] = group[i]


def tile_links(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between classes from rows that come block after block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, Block()
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "high")), strict=True)
            labels, sides, sets = batch.column("label").to_pylist(), batch.column("tile").to_pylist(), batch.column("shingles")
            for i, key in enumerate(keys):
                if key != last:
                    found.extend(block.links(similarity))
                    last, block = key, Block()
                block.labels.append(labels[i])
                block.sides.append(sides[i])
                block.sets.append(sets[i].values.to_numpy())
            yield _pairs(found)
        yield _pairs(list(block.links(similarity)))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``links`` (u, v), for nodes with links.

    Large-star and small-star steps alternate until the links no longer change; each is an aggregate and a join by
    node, and what reaches the driver is a count and a checksum.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.join(least, F.col("u") == F.col("n"))
        if small:
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
        else:
            out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u > v").distinct()

    def sum_of(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "near-edges")
    before = sum_of(edges)
    while before[0]:
        edges = cut(star(star(edges, small=False), small=True), "near-edges")
        now = sum_of(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def undecided(members: DataFrame) -> DataFrame:
    """The rows (bucket, rep, label, ..) of buckets with more than one class."""
    several = members.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
    return join_skewed(members, several, ["bucket"])


def unlike(members: DataFrame) -> DataFrame:
    """One bucket of those with the same members, which bands of the same texts often have."""
    key = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2")]
    one = members.groupBy("bucket").agg(*key).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(one, "bucket")


def pivot_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of each bucket's members with one of them, the pivot: the one that shares buckets with most others.

    Overlapping buckets choose the same pivot, so their pairs fall together. Pairs of too different sizes are left out.
    """
    pivots = members.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "rep", "n")).alias("p"))
    met = join_skewed(members.select("bucket", "rep", "n"), pivots, ["bucket"]).where(F.col("rep") != F.col("p.rep"))
    near = F.least("n", "p.n") >= similarity * F.greatest("n", "p.n")
    pairs = met.where(near).select(F.col("rep").alias("u"), F.col("p.rep").alias("v")).distinct()
    own, other = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("member_set")), sets.select(F.col("rep").alias("v"), F.col("shingles").alias("pivot_set"))
    return pairs.join(own, "u").join(other, "v").select("u", "v", "member_set", "pivot_set").mapInArrow(linked_pairs(similarity), "u long, v long")


def block_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the classes of each bucket, from all pairs of its members of different classes.

    A bucket's members are dealt over tiles; a task takes a pair of tiles (or one with itself), compares in memory and
    returns at most as many links as there are classes. So a bucket of any size spreads over tasks of bounded size.
    """
    sized = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    tiles = F.greatest(F.ceil(F.col("m") / TILE_MEMBERS), F.least(F.ceil(F.col("total") / TILE_SHINGLES), F.col("m"))).cast("int")
    dealt = join_skewed(members, sized.select("bucket", tiles.alias("tiles")), ["bucket"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    blocks = dealt.select("bucket", "rep", "label", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("meets")).select(
        "bucket", F.least("tile", "meets").alias("low"), F.greatest("tile", "meets").alias("high"), "tile", "rep", "label"
    )
    rows = blocks.join(sets, "rep").select("bucket", "low", "high", "tile", "label", "shingles")
    return rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(tile_links(similarity), "u long, v long")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Merge the classes that links (u, v) between labels join."""
    merged = components(links).withColumnRenamed("label", "to")
    return labels.join(merged, F.col("label") == F.col("node"), "left").select("rep", F.coalesce("to", "label").alias("label"))


def classes(whole: DataFrame, *, size: int, similarity: float, bands: int, band_rows: int) -> DataFrame:
    """(row, doc_id, label) of each row of ``whole`` (row, doc_id, text); rows of a class share a label."""
    kind = whole.schema["doc_id"].dataType.simpleString()
    signed_rows = cut(whole.mapInArrow(signatures(size, bands, band_rows), f"row long, doc_id {kind}, digest binary, bands array<bigint>"), "near-signatures")
    # Texts of the same words are one representative from here on.
    reps = signed_rows.groupBy("digest").agg(F.min("row").alias("rep"))
    named = cut(join_skewed(signed_rows.select("row", "doc_id", "digest"), reps, ["digest"]).select("row", "doc_id", "rep"), "near-named")
    buckets = signed_rows.join(named.where("row = rep").select("row", "rep"), "row").select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    banded = cut(join_skewed(buckets, shared, ["bucket"]), "near-banded")
    weights = cut(banded.groupBy("rep").agg(F.sum("in_bucket").alias("weight")), "near-weights")
    texts = whole.select(F.col("row").alias("rep"), "text").join(weights.select("rep"), "rep")
    # Bands only bring texts together. What decides a link are shingles under a key that is drawn for this run, so that
    # no words can be chosen to share a hash; sets are stored once, so all tasks that read them have the same key.
    sets = cut(texts.select("rep", "text").mapInArrow(shingler(size, token_bytes(16)), "rep long, n long, shingles array<bigint>"), "near-sets")
    sized = cut(weights.join(sets.select("rep", "n"), "rep"), "near-sizes")
    sets = sets.drop("n")
    members = cut(unlike(banded.select("bucket", "rep")).join(sized, "rep"), "near-members")
    # What pivots leave undecided is compared in full; both ways only add links, and classes are their components.
    labels = cut(relabel(weights.select("rep", F.col("rep").alias("label")), pivot_links(members, sets, similarity)), "near-labels")
    left = cut(undecided(members.join(labels, "rep")).select("bucket", "rep", "label", "n"), "near-left")
    labels = relabel(labels, block_links(left, sets, similarity))
    return named.join(labels.withColumnRenamed("rep", "of"), F.col("rep") == F.col("of"), "left").select("row", "doc_id", F.coalesce("label", "rep").alias("label"))


def dedup_near(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``docs`` with ``class_id``, ``class_size`` and ``kept`` (columns of these names are replaced).

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least ``similarity``
    (words end at ASCII white space and are compared as they are); classes are the components of the links. A class is
    named by its smallest id, and the row with that id (the first, if it repeats) is kept.

    Candidates come from ProbMinHash signatures of the shingles in bands: two texts of probability Jaccard similarity j
    meet with probability 1 - (1 - j**band_rows)**bands, 0.9996 at 0.8. A text has two signatures: in one all shingles
    weigh the same, which makes j the similarity of links; in the other a shingle found c times weighs 1 + log c, which
    brings further candidates. Texts of the same words, known by SHA-256, are one text. All members of a bucket are
    compared with its pivot; buckets that still hold several classes are compared in full, tile by tile, by counting
    common shingles in memory. Shingles count as common by digests of their words under a key drawn for the run, which
    nobody who writes a text can know; what brings texts together needs no key, and so reruns agree. No pair of a bucket is left undecided, and the number of steps doesn't depend on the
    data, but for the rounds of the components.

    All texts without words (null, empty, blank) are one class. Texts of fewer words than a shingle are one shingle. A
    null id is larger than others; a class of null ids has a null name. An empty table gives an empty table.
    """
    row = fresh(docs, "near_row")
    whole = numbered(docs, row)
    found = classes(whole.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), size=size, similarity=similarity, bands=bands, band_rows=band_rows)
    found = cut(found, "near-classes")
    heads = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("head"), F.count("*").alias("class_size"))
    verdict = join_skewed(found, heads, ["label"]).select(F.col("row").alias(row), F.col("head.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("head.row")).alias("kept"))
    return whole.drop("class_id", "class_size", "kept").join(verdict, row).drop(row)
