"""Push subscriptions over local sockets: logged, merged, ended and started again."""

import base64
import hashlib
import json
import socket
import struct
import threading

import pytest
from pyspark.sql import functions as F

from tidewick.sources import subscription
from tidewick.streaming import listener


def block(n):
    events = [{"type": "chain.trade.OrderSavedEvent", "attributes": [{"key": "n", "value": str(n), "index": True}]}, {"type": "other", "attributes": []}]
    return json.dumps({"result": {"data": {"type": "NewBlock", "value": {"result_finalize_block": {"events": events}}}}})


def tx(n):
    return json.dumps({"result": {"data": {"type": "Tx", "value": {"TxResult": {"result": {"events": [{"type": "chain.trade.OrderExecutedEvent", "attributes": [{"key": "n", "value": str(n)}]}]}}}}}})


class Server:
    """Sends messages from the number that a client names, and closes or stays silent at the end."""

    def __init__(self, made, close_after=None, web=False):
        self.made, self.close_after, self.web, self.hellos = made, close_after, web, []
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self.serve, daemon=True).start()

    def serve(self):
        while True:
            link, _ = self.socket.accept()
            threading.Thread(target=self.talk, args=(link,), daemon=True).start()

    def talk(self, link):
        file = link.makefile("rb")
        send = lambda text: link.sendall(text.encode() + b"\n")
        if self.web:
            key = next(line for line in iter(file.readline, b"") if line.startswith(b"Sec-WebSocket-Key")).split()[1]
            while file.readline() != b"\r\n":
                pass
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest()).decode()
            link.sendall(f"HTTP/1.1 101 Switching Protocols\r\nSec-WebSocket-Accept: {accept}\r\n\r\n".encode())
            size = file.read(2)[1] & 127
            mask = file.read(4)
            hello = bytes(b ^ mask[k % 4] for k, b in enumerate(file.read(size))).decode()

            def send(text):
                data = text.encode()
                half = len(data) // 2
                for first, part in ((0x01, data[:half]), (0x80, data[half:])):  # in two fragments, with a ping between
                    head = bytes([first, len(part)]) if len(part) < 126 else struct.pack("!BBH", first, 126, len(part))
                    link.sendall(head + part + (b"\x89\x01p" if first == 1 else b""))

        else:
            hello = file.readline().decode().strip()
        self.hellos.append(hello)
        for k in range(int(hello), len(self.made)):
            if self.close_after is not None and k >= self.close_after:
                break
            send(self.made[k])
        if self.close_after is not None:
            link.sendall(b"\x88\x00") if self.web else None
            link.shutdown(socket.SHUT_WR)
            while file.read(1):  # what the client still answers
                pass
            file.close()
            link.close()
        else:
            threading.Event().wait()


@pytest.fixture(autouse=True)
def small_files(monkeypatch):
    monkeypatch.setattr(subscription, "FILE_MESSAGES", 7)
    monkeypatch.setattr(subscription, "LINGER", 0.2)


def start(spark, blocks, transactions, folder, out):
    made = []
    for name, server in (("blocks", blocks), ("transactions", transactions)):
        connect = subscription.websocket(f"ws://127.0.0.1:{server.port}/websocket") if server.web else subscription.lines("127.0.0.1", server.port)
        made.append(subscription.Receiver(name, connect, str, str(folder / "log")))
        made[-1].start()
    heard = listener.listen(*[subscription.events(subscription.messages(spark, r)) for r in made], "chain.trade")
    return made, heard.writeStream.option("checkpointLocation", str(folder / "state")).format("parquet").start(out)


@pytest.mark.parametrize("web", [False, True])
def test_two_subscriptions_until_one_closes_and_again(spark, tmp_path, web):
    out = str(tmp_path / "out")
    blocks, transactions = Server([block(k) for k in range(40)], 23, web), Server([tx(k) for k in range(12)], None, web)
    receivers, query = start(spark, blocks, transactions, tmp_path, out)
    receivers[0].join(30)
    while receivers[1].logged() < 12:
        receivers[1].join(0.05)
    assert subscription.until_closed(query, receivers) == "blocks" and not query.isActive and not receivers[1].is_alive()

    def seen():
        rows = spark.read.parquet(out).select("type", F.col("attributes")[0]["value"].cast("int").alias("n")).collect()
        return sorted((r.type.rpartition(".")[2], r.n) for r in rows)

    assert seen() == [("OrderExecutedEvent", k) for k in range(12)] + [("OrderSavedEvent", k) for k in range(23)]
    # Again: the servers are asked for what the logs don't have yet, and the query goes on where it was.
    blocks.close_after = 40
    receivers, query = start(spark, blocks, transactions, tmp_path, out)
    assert subscription.until_closed(query, receivers) == "blocks"
    assert seen() == [("OrderExecutedEvent", k) for k in range(12)] + [("OrderSavedEvent", k) for k in range(40)]
    assert blocks.hellos == ["0", "23"] and transactions.hellos == ["0", "12"]
    assert len(list((tmp_path / "log" / "blocks").glob("*.json"))) >= 40 // 7


def test_a_server_that_refuses(tmp_path):
    receiver = subscription.Receiver("x", subscription.lines("127.0.0.1", 1), str, str(tmp_path))
    receiver.start()
    receiver.join(10)
    assert isinstance(receiver.error, OSError) and receiver.logged() == 0
