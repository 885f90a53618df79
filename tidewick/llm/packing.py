"""Packing of documents into token sequences, in the order of a space-filling curve."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, parallelism

LENGTH = 4096
END = 2
#: Hashed features of a document's vector, dimensions and bits of the curve.
FEATURES, DIMS, BITS = 1024, 4, 12
#: Ids of a partition of the sort, about, where the session's partitions would be larger.
PART_IDS = 1 << 25
#: Words in a generation of a task's memory, and rows that are tokenized together.
CACHED_WORDS, SLICE = 400_000, 256


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of integers in [0, 2**bits)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations of each level
        low = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray encoding
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = top
    while q > 1:
        carry = np.where((x[dims - 1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Project hashed vectors to a few dimensions, squash them to the unit cube and take their Hilbert keys."""
    directions = np.random.default_rng(7).standard_normal((FEATURES, DIMS)).astype(np.float32)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = (vectors / np.maximum(norms, 1e-12)) @ directions
    unit = 0.5 + 0.5 * np.tanh(flat)
    return hilbert(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of few rows each, so that what is made of a part stays small."""
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


#: The steps before the merges of a tokenizer whose words can be encoded one by one.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Latin letters whose lower case is one letter and needs no composing, then marks other than the apostrophe.
PLAIN_WORD = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


#: The marks of a plain word, as bytes.
MARKS = bytes(b for b in range(33, 127) if PLAIN_WORD.fullmatch(f"a{chr(b)}") and not chr(b).isalpha())


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def within_words(token: dict) -> bool:
    """Whether an added token lies in one word that isn't plain: letters behind a mark, no white space, nothing stripped around it."""
    content = token["content"]
    return not (re.search(r"\s", content) or token["lstrip"] or token["rstrip"]) and bool(re.search(r"[!-/:-@\[-`{-~][^\W\d_]", content))


class Pieces(dict):
    """Ids of runs of small letters or of marks, straight from the merges."""

    def __init__(self, model, code: str):
        self.model, self.code, self.letters = model, code, byte_letters()

    def __missing__(self, piece: bytes) -> bytes:
        spelt = piece.decode() if piece.isascii() else "".join(map(self.letters.__getitem__, piece))
        found = array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[piece] = found
        return found


class Words(dict):
    """Ids of words, remembered in two generations, of which the older is dropped when the younger is full.

    A word of plain letters with marks behind is two pieces; all other words take the whole tokenizer.
    """

    def __init__(self, tokenizer, code: str):
        self.tokenizer, self.code, self.old = tokenizer, code, {}
        self.pieces = Pieces(tokenizer.model, code)

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            head = word.rstrip(MARKS)
            if head.isalpha():  # of bytes: ASCII letters
                found = self.pieces[head.lower()]
                if len(head) < len(word):
                    found += self.pieces[word[len(head) :]]
            elif plain := PLAIN_WORD.fullmatch(text := word.decode()):
                found = self.pieces[plain[1].lower().encode()]
                if plain[2]:
                    found += self.pieces[plain[2].encode()]
            else:
                found = self.whole(text)
        self[word] = found
        return found

    def ids(self, words: list[bytes]) -> bytes:
        found = b"".join(map(self.__getitem__, words))
        if len(self) > CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        return found


class Encoder:
    """Ids of texts as bytes, two each where the vocabulary allows it.

    Where nothing that the tokenizer does looks across white space, and it drops that, a text is the concatenation of
    its words' ids, and words are remembered.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        self.code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.tail = array(self.code, [end]).tobytes()
        self.by_word = all(steps[k] == v for k, v in WORD_STEPS.items()) and not any(steps.get(k) for k in ("post_processor", "truncation", "padding")) and all(map(within_words, steps["added_tokens"]))
        self.words = Words(tokenizer, self.code)

    def __call__(self, text: str) -> bytes:
        return (self.words.ids(text.encode().split()) if self.by_word else self.words.whole(text)) + self.tail


def tokenize(path: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ids of each text with its curve key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, end)
        kind = np.dtype(encode.code)
        sign = np.where(np.random.default_rng(11).integers(0, 2, 1 << 17) == 1, 1.0, -1.0).astype(np.float32)
        for whole in batches:
            for batch in slices(whole):
                packed = [encode(text.as_py() or "") for text in batch.column("text")]
                vectors = np.zeros((batch.num_rows, FEATURES), dtype=np.float32)
                for i, data in enumerate(packed):
                    mixed = np.frombuffer(data, dtype=kind).astype(np.int64) * 2654435761 % (1 << 32)
                    vectors[i] = np.bincount(mixed >> 22, weights=sign[mixed & 0x1FFFF], minlength=FEATURES)
                counts = [len(data) // kind.itemsize for data in packed]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(curve_keys(vectors)), pa.array(counts, pa.int64()), pa.array([kind.itemsize] * len(counts), pa.int32()), pa.array(packed, pa.binary())],
                    names=["doc_id", "curve", "n", "width", "ids"],
                )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids before each document within its sorted partition."""
    before = 0
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=[*batch.schema.names, "before"])
        before = int(ends[-1]) if len(ends) else before


def bounds(total: int, length: int) -> list[int]:
    """Starts of the sequences after the last full one: the rest is cut at powers of two, which need no padding."""
    at = total - total % length
    out = []
    for bit in range(length.bit_length() - 1, -1, -1):
        if total % length >> bit & 1:
            out.append(at)
            at += 1 << bit
    return out


def _pieces(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut each document where sequences end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = [], []
            doc_ids, texts = batch.column("doc_id"), batch.column("ids")
            begins = batch.column("position").to_pylist()
            widths = batch.column("width").to_pylist()
            totals = batch.column("total").to_pylist()
            for i, (begin, width, total) in enumerate(zip(begins, widths, totals, strict=True)):
                ids = np.frombuffer(texts[i].as_py(), dtype=np.uint16 if width == 2 else np.uint32).astype("<u4")
                whole = total - total % length
                rest = bounds(total, length)
                at = begin
                while at < begin + len(ids):
                    if at < whole:
                        number, first, stop = at // length, at - at % length, at - at % length + length
                    else:
                        k = max(j for j, b in enumerate(rest) if b <= at)
                        number, first, stop = whole // length + k, rest[k], rest[k + 1] if k + 1 < len(rest) else total
                    stop = min(stop, begin + len(ids))
                    part = ids[at - begin : stop - begin]
                    rows.append((at - begin, stop - at, zlib.crc32(part.tobytes()), len(ids), number, at - first))
                    docs.append(i)
                    at = stop
            names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = np.array(rows, dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(docs, pa.int64())), *(pa.array(columns[:, k]) for k in range(6))], names=["doc_id", *names])

    return run


def pack(docs: DataFrame, *, tokenizer: str, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of documents in sequences of ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are tokenized once, range-sorted by the Hilbert key of their hashed vectors (then id), and laid end to
    end along the curve; sequences are cuts of that stream, so that neighbours share sequences and only the last
    ``length`` ids could need padding. These are cut at powers of two, which need none. Positions are sums over the
    sorted partitions, one row for each partition.

    Null or empty text is just the ``end`` id. Copies of a text follow each other; repeated rows are packed as often as
    they come, in any order among themselves. Documents longer than a sequence span several. Other columns are not read.
    An empty table gives no pieces.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    ids = cut(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tokenize(tokenizer, end), f"doc_id {kind}, curve long, n long, width int, ids binary"),
        "pack-ids",
    )
    order = ["curve", "doc_id", "n"]
    parts = max(parallelism(spark), -(-ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // PART_IDS))
    ranged = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    part = fresh(ranged, "part")
    placed = cut(ranged.withColumn(part, F.spark_partition_id()).mapInArrow(_running, f"doc_id {kind}, curve long, n long, width int, ids binary, part int, before long"), "pack-sorted")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = (
        placed.groupBy("part")
        .agg(F.sum("n").alias("words"))
        .select(F.col("part").alias("of"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"), F.sum("words").over(everywhere).alias("total"))
    )
    # One row for each partition of the sort: its size is the number of tasks, whatever the input.
    laid = placed.join(F.broadcast(sums), F.col("part") == F.col("of"))
    return laid.select("doc_id", "width", "ids", (F.col("base") + F.col("before")).alias("position"), "total").mapInArrow(
        _pieces(length), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
