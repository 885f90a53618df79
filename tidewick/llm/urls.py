"""URL filters: rules for hosts and paths in sorted arrays of digests, which tasks map into memory and probe by binary search."""

from __future__ import annotations

import struct
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path
from .warc import located, open_sink

#: Entries of one file of an index, about.
SHARD_ENTRIES = 1 << 20
#: Seed of Spark's xxhash64.
SEED = 42
#: Fixed values of an index file: its first bytes, and the header behind them (entries, shapes, bytes of all texts).
MAGIC, HEAD = b"urlindex", "<8sqqq"

ALLOW, BLOCK = "allow", "block"
FOUND = "host string, path string, rule string, verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case, then up to ``?``, ``#`` or the end."""
    whole, upper = F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.when(F.instr(whole, "://") > 0, F.substr(whole, F.instr(whole, F.lit("://")) + 3)).otherwise("")
    shape = "^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, shape, 1), upper, upper.lower()), F.regexp_extract(rest, shape, 2)


def write_shards(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Write a partition's sorted entries to one file: keys, ends of texts, bytes of hosts, verdicts, shapes and texts.

    The name has a token of the task's attempt, and only names that the manifest has are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        keys = rows.column("key").to_numpy()
        hosts = [h.encode() for h in rows.column("host").to_pylist()]
        texts = [h + p.encode() for h, p in zip(hosts, rows.column("path").to_pylist(), strict=True)]
        blocked = np.array([v == BLOCK for v in rows.column("verdict").to_pylist()], dtype=np.uint8)
        lengths, in_host = np.array(list(map(len, texts)), dtype=np.int64), np.array(list(map(len, hosts)), dtype=np.int64)
        shapes = np.unique(np.stack([in_host, lengths - in_host], axis=1), axis=0)
        name = f"{folder}/{uuid.uuid4().hex}.index"
        with open_sink(name) as sink:
            sink.write(struct.pack(HEAD, MAGIC, len(keys), len(shapes), int(lengths.sum())))
            for part in (keys.astype("<i8"), np.cumsum(lengths).astype("<i8"), in_host.astype("<i8"), shapes.astype("<i8"), blocked):
                sink.write(part.tobytes())
            sink.write(b"".join(texts))
        yield pa.RecordBatch.from_pylist([{"file": name, "low": int(keys[0]), "high": int(keys[-1]), "entries": len(keys)}], schema=pa.schema([("file", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("entries", pa.int64())]))

    return run


def build_index(rules: DataFrame, *, host: str = "host", path: str = "path", verdict: str = "verdict", shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Write an index of ``rules`` to the shared folder; one row (file, low, high, entries) for each of its files.

    Spark sorts entries by their 64-bit digest into files of about ``shard_entries``, so a list of any size can be
    written. Hosts are compared in lower case (A to Z). Rules without a host are left out, a null path is ''; where rules
    of one host and path disagree, ``block`` wins.
    """
    spark, upper = rules.sparkSession, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    named = rules.select(F.translate(F.col(host), upper, upper.lower()).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path"), F.col(verdict).alias("verdict")).where("host <> ''")
    entries = named.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == BLOCK, BLOCK).otherwise(ALLOW)).alias("verdict"))
    keyed = cut(entries.withColumn("key", F.xxhash64(F.concat("host", "path"))), "url-rules")
    shards = max(1, -(-keyed.count() // shard_entries))
    sorted_rows = keyed.repartitionByRange(shards, "key").sortWithinPartitions("key", "host", "path")
    return cut(sorted_rows.mapInArrow(write_shards(new_path(spark, "url-index")), "file string, low long, high long, entries long"), "url-manifest")


class Shard:
    """A file of an index: mapped into memory where the shared folder is a mounted file system, else read."""

    def __init__(self, name: str):
        files, path = located(name)
        file = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.held = file.read_buffer()
        magic, n, shapes, size = struct.unpack_from(HEAD, self.held)
        if magic != MAGIC or len(self.held) != struct.calcsize(HEAD) + 25 * n + 16 * shapes + size:
            raise ValueError(f"{name}: not an index, or cut short")
        at, parts = struct.calcsize(HEAD), []
        for count, kind in ((n, "<i8"), (n, "<i8"), (n, "<i8"), (2 * shapes, "<i8"), (n, "u1"), (size, "u1")):
            parts.append(np.frombuffer(self.held, dtype=kind, count=count, offset=at))
            at += parts[-1].nbytes
        self.keys, self.ends, self.in_host, self.shapes, self.blocked, self.texts = parts

    def found(self, probes: np.ndarray, texts: list[bytes], in_host: np.ndarray) -> Iterator[tuple[int, bool]]:
        """(place of a probe, whether its rule blocks) of those whose whole text is an entry; entries that share a digest are all looked at."""
        first, last = np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")
        for i in np.flatnonzero(last > first):
            for k in range(first[i], last[i]):
                begin = self.ends[k - 1] if k else 0
                if self.in_host[k] == in_host[i] and self.texts[begin : self.ends[k]].tobytes() == texts[i]:
                    yield int(i), bool(self.blocked[k])


def probes_of(host: bytes, path: bytes, shapes: dict[int, list[int]]) -> Iterator[tuple[bytes, int]]:
    """(text, bytes of its host) of each rule that could fit: the host and what follows its dots, with beginnings of the path, where the index has entries of such lengths."""
    at = 0
    while at >= 0:
        suffix = host[at:]
        for size in shapes.get(len(suffix), ()):
            if size > len(path):
                break
            yield suffix + path[:size], len(suffix)
        dot = host.find(b".", at)
        at = dot + 1 if dot >= 0 else -1


def judged(files: list[tuple[str, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Host, path, rule and verdict of each row, from an index of ``files`` (name, smallest and largest key) in order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = defaultdict(set)
        for name, _, _ in files:
            for in_host, in_path in Shard(name).shapes.reshape(-1, 2).tolist():
                lengths[in_host].add(in_path)
        shapes = {k: sorted(v) for k, v in lengths.items()}
        for batch in batches:
            # A host and path that many rows share is probed once.
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            distinct = list(dict.fromkeys(pairs))
            owner, texts, in_host = [], [], []
            for i, (host, path) in enumerate(distinct):
                for text, size in probes_of(host.encode(), path.encode(), shapes):
                    owner.append(i)
                    texts.append(text)
                    in_host.append(size)
            keys = np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], dtype=np.uint64).view(np.int64)
            order, best = np.argsort(keys, kind="stable"), {}
            for name, low, high in files:
                mine = order[np.searchsorted(keys, low, "left", sorter=order) : np.searchsorted(keys, high, "right", sorter=order)]
                if not len(mine):
                    continue
                asked = [texts[k] for k in mine]
                for k, blocks in Shard(name).found(keys[mine], asked, np.array([in_host[k] for k in mine])):
                    rule = asked[k].decode()
                    choice = (len(rule), in_host[mine[k]], rule, BLOCK if blocks else ALLOW)
                    best[distinct[owner[mine[k]]]] = max(best.get(distinct[owner[mine[k]]], choice), choice)
            rules = [best.get(pair) for pair in pairs]
            kept = [batch.column(c) for c in batch.schema.names]
            more = [pa.array([r and r[2] for r in rules], pa.string()), pa.array([r[3] if r else ALLOW for r in rules], pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*batch.schema.names, "rule", "verdict"])

    return run


def judge(pages: DataFrame, index: DataFrame, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page: the longest rule of the index that fits its URL, and what it says.

    A rule fits its host and all subdomains, if the URL's path starts with the rule's. The longest in characters wins, of
    equally long ones that with the longer host. A URL that no rule fits has a null rule and is allowed.

    The driver and the tasks know the name and key range of each of the index's files, a row for each SHARD_ENTRIES
    rules; files are opened where they lie and mapped, so that a probe touches what binary search looks at. A digest that
    is found counts only if host and path are equal byte by byte.

    A null URL, and one without ``://``, has an empty host and path. Repeated rows are judged each. Other columns are not
    read. An empty table gives an empty table, an index without files allows all.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    files = sorted([(r.file, r.low, r.high) for r in index.select("file", "low", "high").collect()], key=lambda x: x[1])
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(judged(files), f"page_id {kind}, {FOUND}")
