"""A data source for paged REST lists of trades: ``spark.read.format("paged_json")``.

A list gives a market's trades newest first, a page at a time, with a cursor for the next. Rows get ids from the second
and their place within it, so reading a second again gives the same ids; only whole seconds are returned.

As a stream, each step reads at most ``pages`` pages of a market. Steps are planned on the driver, which holds no trades:
a plan says for each market since which second, from which cursor and up to which second it is read. Tasks write down how
far they came. Plans and notes lie in the folder ``state``, so that a history that was left half read goes on where it
stopped, and a step that runs again does the same.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, urlencode
from urllib.request import urlopen

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .shared import arrow_files

FIELDS = "market_id string, id bigint, order_type string, price string, amount string, maker string, taker string, executed_at bigint, error string"
NAMES = tuple(f.split()[0] for f in FIELDS.split(", "))
#: Trades of a second that have ids of their own, pages of a step and of a market, seconds before a failed market is read again.
PLACES, PAGES, RETRY_SECONDS = 1 << 24, 20, 60


def fetch(url: str, market: str, limit: int, key: str) -> dict:
    with urlopen(f"{url}?{urlencode({'market': market, 'limit': limit, 'key': key})}", timeout=60) as answer:
        return json.load(answer)


def rows_of(market: str, second: int, newest_first: list[dict]) -> Iterator[tuple]:
    """The trades of a second, the oldest first."""
    for place, row in enumerate(reversed(newest_first)):
        known = {"market_id": row.get("market_id") or market, "id": second * PLACES + place, "executed_at": second, "error": None}
        yield tuple(known[n] if n in known else row.get(n) for n in NAMES)


class Walk:
    """Reads a market's pages down to the second ``since``; ``until`` (included) leaves out what is newer.

    After the trades, ``left`` is None, or the cursor and second from which the rest is read.
    """

    def __init__(self, options: dict[str, str], market: str, since: int, until: int | None = None, key: str = "", get: Callable = fetch):
        self.options, self.market, self.since, self.until, self.key, self.get = options, market, since, until, key, get
        self.left: tuple[str, int] | None = None
        self.newest = since

    def trades(self, pages: int | None = None) -> Iterator[tuple]:
        """Trades of whole seconds. Once ``pages`` are read, the second that is open is left for the next walk."""
        key = opened = self.key
        second, held, seen, told = None, [], 0, False
        while True:
            page = self.get(self.options["url"], self.market, int(self.options.get("limit", "500")), key)
            seen += 1
            for row in page["list"]:
                at = int(row["executed_at"])
                if self.until is not None and at > self.until:
                    continue
                if at < self.since:
                    yield from rows_of(self.market, second, held)
                    return
                self.newest = max(self.newest, at)
                if at != second:
                    yield from rows_of(self.market, second, held)
                    told, second, held, opened = told or bool(held), at, [], key
                held.append(row)
            key = page.get("next_key") or ""
            if not key:
                yield from rows_of(self.market, second, held)
                return
            if pages and seen >= pages and told:
                self.left = (opened, second)
                return


def listed(options: dict[str, str]) -> list[str]:
    """The markets: ``markets``, separated by commas, or those that the address ``markets_url`` lists now."""
    if "markets_url" in options:
        with urlopen(options["markets_url"], timeout=60) as answer:
            return json.load(answer)
    return options["markets"].split(",")


class Market(InputPartition):
    def __init__(self, market: str):
        self.market = market


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Market]:
        return [Market(m) for m in listed(self.options)]

    def read(self, partition: Market) -> Iterator[tuple]:
        return Walk(self.options, partition.market, int(self.options.get("since", "0"))).trades()


class Step(Market):
    """What a step reads of a market."""

    def __init__(self, number: int, market: str, since: int, until: int | None, key: str):
        super().__init__(market)
        self.number, self.since, self.until, self.key = number, since, until, key


class Notes:
    """Small JSON files in the shared folder."""

    def __init__(self, folder: str):
        self.files, self.folder = arrow_files(folder)

    def read(self, name: str) -> dict | None:
        try:
            with self.files.open_input_stream(f"{self.folder}/{name}") as file:
                return json.loads(file.read())
        except FileNotFoundError:
            return None

    def write(self, name: str, content: dict) -> None:
        """Written apart and moved, so that nobody reads half a note."""
        path = f"{self.folder}/{name}"
        part = f"{path}.{uuid.uuid4().hex}"
        self.files.create_dir(path.rpartition("/")[0], recursive=True)
        with self.files.open_output_stream(part) as file:
            file.write(json.dumps(content).encode())
        self.files.move(part, path)

    def delete(self, name: str) -> None:
        path = f"{self.folder}/{name}"
        self.files.delete_dir(path) if name.startswith("done-") else self.files.delete_file(path)

    def names(self, folder: str = "") -> list[str]:
        found = self.files.get_file_info(fs.FileSelector(f"{self.folder}/{folder}".rstrip("/"), allow_not_found=True))
        return [f.base_name for f in found]


class PageStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], get: Callable = fetch):
        self.options, self.get = options, get
        self.notes = Notes(options["state"])

    def initialOffset(self) -> dict:
        return {"step": 0}

    def last(self) -> int:
        return max((int(n[5:15]) for n in self.notes.names() if n.startswith("plan-") and n.endswith(".json")), default=0)

    def latestOffset(self) -> dict:
        step = self.last()
        plan = self.notes.read(f"plan-{step:010d}.json") or {"markets": {}}
        done = {m: self.notes.read(f"done-{step:010d}/{quote(m, safe='')}.json") for m, s in plan["markets"].items() if s["asked"]}
        if None in done.values():
            return {"step": step}
        following = self.planned(plan["markets"], done)
        if any(s["asked"] for s in following.values()):
            step += 1
            self.notes.write(f"plan-{step:010d}.json", {"markets": following})
        return {"step": step}

    def planned(self, markets: dict[str, dict], done: dict[str, dict]) -> dict[str, dict]:
        """What the next step reads, after what the tasks of the last one have noted; finished markets are asked for news."""
        after, now = {}, time.time()
        for market in dict.fromkeys([*markets, *listed(self.options)]):
            state = dict(markets.get(market) or {"since": 0, "newest": 0, "until": None, "key": "", "head": None, "again_at": 0, "finished": False})
            note = done.get(market)
            if note and note["error"]:
                state["again_at"] = now + float(self.options.get("retry_seconds", RETRY_SECONDS))
            elif note:
                state["newest"] = max(state["newest"], note["newest"])
                (state["key"], state["until"]), state["finished"] = note["left"] or ("", None), not note["left"]
                state["since"] = state["newest"] if state["finished"] else state["since"]
                state["again_at"] = 0
            state["asked"] = not state["finished"] and now >= state["again_at"]
            after[market] = state
        idle = [m for m, s in after.items() if s["finished"]]
        with ThreadPoolExecutor(16) as pool:
            for market, head in zip(idle, pool.map(self.head, idle), strict=True):
                if head != after[market]["head"]:
                    after[market] |= {"asked": True, "finished": False, "head": head}
        return after

    def head(self, market: str) -> int | None:
        """A digest of the newest second of a market's first page, which changes with each new trade."""
        try:
            rows = self.get(self.options["url"], market, int(self.options.get("limit", "500")), "")["list"]
        except Exception:  # noqa: BLE001 - the task that reads the market reports what is wrong
            return None
        return zlib.crc32(json.dumps([r for r in rows if r["executed_at"] == rows[0]["executed_at"]], sort_keys=True).encode())

    def partitions(self, start: dict, end: dict) -> list[Step]:
        steps = range(start["step"] + 1, end["step"] + 1)
        plans = {n: self.notes.read(f"plan-{n:010d}.json")["markets"] for n in steps}
        return [Step(n, m, s["since"], s["until"], s["key"]) for n, markets in plans.items() for m, s in markets.items() if s["asked"]]

    def read(self, partition: Step) -> Iterator[tuple]:
        """Trades of a market; a failure is a row with its error, and the step is tried again later."""
        walk = Walk(self.options, partition.market, partition.since, partition.until, partition.key, self.get)
        error = None
        try:
            yield from walk.trades(int(self.options.get("pages", PAGES)))
        except Exception as failure:  # noqa: BLE001 - one market must not stop the others
            error = f"{type(failure).__name__}: {failure}"
            yield tuple({"market_id": partition.market, "error": error}.get(n) for n in NAMES)
        note = {"left": walk.left, "newest": walk.newest, "error": error}
        self.notes.write(f"done-{partition.number:010d}/{quote(partition.market, safe='')}.json", note)

    def commit(self, end: dict) -> None:
        """Plans and notes before the last committed step aren't needed any more."""
        for name in self.notes.names():
            if name[:5] in ("plan-", "done-") and int(name[5:15]) < end["step"]:
                self.notes.delete(name)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)
