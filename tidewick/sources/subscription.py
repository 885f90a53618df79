"""Push subscriptions as streams: a receiver appends what a server sends to a log, from which Spark streams.

A subscription can't be asked again for what it has sent, so messages are stored before any query sees them. The log is a
folder of files of whole lines (offset, message), written apart and moved; a query reads it as any folder of JSON files,
with its own checkpoint, and may be started again at any time. A receiver holds one file's messages in memory.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import struct
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import EVENT
from .shared import arrow_files

#: Messages of one file at most, and seconds until a file is written though it has fewer.
FILE_MESSAGES, LINGER = 1000, 1.0
MESSAGE = "offset long, message string"
#: Where the events of a block and of a transaction lie in a message.
_EVENTS = EVENT.simpleString().replace("struct<", "array<struct<", 1) + ">"
BODY = f"result struct<data: struct<value: struct<result_finalize_block: struct<events: {_EVENTS}>, TxResult: struct<result: struct<events: {_EVENTS}>>>>>"


def lines(host: str, port: int) -> Callable[[str], Iterator[str | None]]:
    """Messages of a server that takes one line and then sends a message a line; None while it is silent."""

    def connect(hello: str) -> Iterator[str | None]:
        with socket.create_connection((host, port), timeout=LINGER / 4) as link:
            link.sendall(hello.encode() + b"\n")
            held = b""
            while True:
                try:
                    more = link.recv(1 << 16)
                except TimeoutError:
                    yield None
                    continue
                if not more:
                    return
                *whole, held = (held + more).split(b"\n")
                yield from (line.decode() for line in whole)

    return connect


def websocket(url: str) -> Callable[[str], Iterator[str | None]]:
    """Text messages of a WebSocket server that is sent one message first; pings are answered, None while it is silent."""

    def frame(kind: int, data: bytes) -> bytes:
        mask, n = os.urandom(4), len(data)
        size = struct.pack("!B", 128 | n) if n < 126 else struct.pack("!BH", 254, n) if n < 1 << 16 else struct.pack("!BQ", 255, n)
        return bytes([0x80 | kind]) + size + mask + bytes(b ^ mask[k % 4] for k, b in enumerate(data))

    def connect(hello: str) -> Iterator[str | None]:
        to, held = urlparse(url), bytearray()
        with socket.create_connection((to.hostname, to.port or 80), timeout=LINGER / 4) as link:

            def take(n: int) -> Iterator[bytes | None]:
                """None while too few bytes are there, then the bytes."""
                while len(held) < n:
                    try:
                        more = link.recv(1 << 16)
                    except TimeoutError:
                        yield None
                        continue
                    if not more:
                        raise EOFError
                    held.extend(more)
                found = bytes(held[:n])
                del held[:n]
                yield found

            key = base64.b64encode(os.urandom(16)).decode()
            head = f"GET {to.path or '/'} HTTP/1.1\r\nHost: {to.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n"
            link.sendall(head.encode())
            try:
                answer = b""
                while not answer.endswith(b"\r\n\r\n"):
                    for byte in take(1):
                        answer += byte or b""
                if b" 101 " not in answer.split(b"\r\n")[0]:
                    raise ConnectionError(answer.split(b"\r\n")[0].decode())
                link.sendall(frame(1, hello.encode()))
                text = b""
                while True:
                    parts = []
                    for wanted in ("head", "size", "body"):
                        n = 2 if wanted == "head" else {126: 2, 127: 8}.get(parts[0][1] & 127, 0) if wanted == "size" else int.from_bytes(parts[1]) if parts[1] else parts[0][1] & 127
                        for got in take(n):
                            if got is None:
                                yield None
                            else:
                                parts.append(got)
                    (first, _), body = parts[0], parts[2]
                    kind = first & 15
                    if kind == 8:
                        return
                    if kind == 9:
                        link.sendall(frame(10, body))
                    elif kind in (0, 1, 2):
                        text += body
                        if first & 0x80:
                            yield text.decode()
                            text = b""
            except EOFError:
                return

    return connect


class Receiver(threading.Thread):
    """Appends a subscription's messages to the log ``folder``, numbered on from what is there, until the server closes."""

    def __init__(self, name: str, connect: Callable[[str], Iterator[str | None]], hello: Callable[[int], str], folder: str):
        """``hello`` makes the message that subscribes, from the number of messages that the log has: servers that can go on from there should."""
        super().__init__(name=name, daemon=True)
        self.connect, self.hello, self.url = connect, hello, f"{folder.rstrip('/')}/{name}"
        self.files, self.path = arrow_files(self.url)
        self.files.create_dir(self.path, recursive=True)
        self.error: BaseException | None = None
        self.stopping = threading.Event()

    def logged(self) -> int:
        """How many messages the log has; the name of a file says where it begins and ends."""
        found = self.files.get_file_info(fs.FileSelector(self.path))
        return max((int(f.base_name[16:31]) for f in found if f.base_name.endswith(".json")), default=0)

    def write(self, first: int, messages: list[str]) -> None:
        part = f"{self.path}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(part) as file:
            file.write("".join(json.dumps({"offset": first + k, "message": m}) + "\n" for k, m in enumerate(messages)).encode())
        self.files.move(part, f"{self.path}/{first:015d}-{first + len(messages):015d}.json")

    def run(self) -> None:
        first, held, since = self.logged(), [], time.monotonic()
        try:
            for message in self.connect(self.hello(first)):
                if message is not None:
                    held.append(message)
                if held and (len(held) >= FILE_MESSAGES or time.monotonic() - since >= LINGER):
                    self.write(first, held)
                    first, held = first + len(held), []
                if not held:
                    since = time.monotonic()
                if self.stopping.is_set():
                    break
        except BaseException as error:  # noqa: BLE001 - reported by whoever waits for the receiver
            self.error = error
        if held:
            self.write(first, held)

    def stop(self) -> None:
        self.stopping.set()
        self.join()


def messages(spark: SparkSession, receiver: Receiver, files_per_batch: int = 100) -> DataFrame:
    """(offset, message): the stream of a receiver's log."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(receiver.url)


def events(found: DataFrame) -> DataFrame:
    """(type, attributes) of the events in messages of blocks and transactions, in Spark; others have none."""
    value = F.from_json("message", BODY)["result"]["data"]["value"]
    both = F.coalesce(value["result_finalize_block"]["events"], value["TxResult"]["result"]["events"])
    return found.select(F.explode(both).alias("e")).select("e.type", "e.attributes")


def until_closed(query: StreamingQuery, receivers: list[Receiver], poll: float = 0.2) -> str | None:
    """Wait until the query or one of its subscriptions ends, let the query take in what is logged, and end all; the name of what closed."""
    closed = None
    while query.isActive and closed is None:
        closed = next((r.name for r in receivers if not r.is_alive()), None)
        time.sleep(poll)
    for receiver in receivers:
        receiver.stop()
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    return closed
