"""Boards that answer in pages, read with a plan for each system: search terms, offsets, or tokens from answer to answer.

A fetcher is a function (slug, Request) -> Answer, named as "module:function". What it raises is no failure of the read: it is a row with the error, and ends its slug only.
The stream holds the place of every open slug in its offsets, so a read that was killed goes on at the pages it had not finished.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from jobweave.sources.adapter import BACKOFF_SECONDS, Answer, named, with_retry


@dataclass(frozen=True)
class Request:
    term: str | None
    offset: int
    token: str | None
    limit: int


@dataclass(frozen=True)
class Paging:
    """How a system's pages follow one another. items, total, token: fields of an answer; a total that is no number is unknown, and pages go on until one is empty."""

    items: str
    limit: int = 100
    most: int = 1 << 30  # items of a slug, or of each term
    terms: tuple[str | None, ...] = (None,)
    total: str | None = None
    token: str | None = None  # only the next page's token leads on
    short_ends: bool = False  # a page with fewer items than the limit is the last
    wrapped: str | None = None  # a list of one object that holds items and total


#: The paging of the systems that need it.
PAGING = {
    "workday": Paging("jobPostings", limit=20, most=100, terms=("software engineer", "typescript", "javascript", "node"), short_ends=True),
    "workable": Paging("results", most=200, token="nextPage"),
    "smartrecruiters": Paging("content", most=200, total="totalFound"),
    "oracle": Paging("requisitionList", most=4000, total="TotalJobsCount", short_ends=True, wrapped="items"),
}


@dataclass(frozen=True)
class Place:
    """Where the reading of a slug stands."""

    term: int = 0
    offset: int = 0  # items of the term so far
    token: str | None = None
    page: int = 0  # pages of the slug so far
    done: bool = False


def number(value) -> int | None:
    """A count that may be a text; null where it is none."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        return int(value)
    except (TypeError, ValueError, OverflowError):
        return None


def after(paging: Paging, place: Place, payload: str) -> tuple[Place, int, str | None]:
    """The place behind an answer, how many items it holds, and what is wrong with it; a wrong answer ends its slug, an empty or last one its term."""
    over = replace(place, done=True)
    try:
        answer = json.loads(payload)
    except ValueError:
        return over, 0, "not JSON"
    if isinstance(answer, dict) and paging.wrapped:
        first = answer.get(paging.wrapped)
        if not isinstance(first, list) or (first and not isinstance(first[0], dict)):
            return over, 0, f"no list of objects in {paging.wrapped}"
        answer = first[0] if first else {paging.items: []}
    if not isinstance(answer, dict):
        return over, 0, "not an object"
    items = answer.get(paging.items)
    if not isinstance(items, list):
        return over, 0, f"no list in {paging.items}"
    read = place.offset + len(items)
    total = number(answer.get(paging.total)) if paging.total else None
    token = answer.get(paging.token) if paging.token else None
    ended = not items or read >= paging.most or (paging.short_ends and len(items) < paging.limit) or (total is not None and read >= total) or (paging.token is not None and not token)
    if not ended:
        return replace(place, offset=read, token=str(token) if token else None, page=place.page + 1), len(items), None
    more = place.term + 1 < len(paging.terms)
    return Place(place.term + 1 if more else place.term, 0 if more else read, None, place.page + 1, not more), len(items), None


def read_slug(fetch: Callable[[str, Request], Answer], paging: Paging, slug: str, place: Place, pages: int | None) -> Iterator[tuple[tuple | None, Place]]:
    """Rows (slug, term, page, payload, error) with the place behind each; an empty page gives no row."""
    read = 0
    while not place.done and (pages is None or read < pages):
        read += 1
        row = lambda payload, error, at=place: (slug, paging.terms[at.term], at.page, payload, error)
        try:
            answer = fetch(slug, Request(paging.terms[place.term], place.offset, place.token, paging.limit))
        except Exception as e:  # noqa: BLE001  a fetcher may fail in any way
            place = replace(place, done=True)
            yield row(None, f"{type(e).__name__}: {str(e)[:400]}"), place
            continue
        if answer.status != 200 or answer.payload is None:
            place = replace(place, done=True)
            yield row(None, f"status {answer.status}"), place
            continue
        place, n, error = after(paging, place, answer.payload)
        yield (row(answer.payload if error is None else None, error) if n or error else None), place


class Part(InputPartition):
    """Slugs with their places. epoch: of a stream; null: read to the end."""

    def __init__(self, places: dict[str, dict], epoch: int | None = None):
        self.places, self.epoch = places, epoch


class Pages:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict):
        self.slugs = sorted(set(json.loads(options["slugs"])))
        self.paging = Paging(**{k: tuple(v) if k == "terms" else v for k, v in json.loads(options["paging"]).items()})
        self.fetcher, self.wait = options["fetcher"], float(options.get("wait", BACKOFF_SECONDS))
        self.limited = options.get("limited", "false").lower() == "true"
        self.together = int(options.get("slugs_per_task", "8"))

    def parts(self, places: dict[str, dict], epoch: int | None = None) -> list[Part]:
        """A source that is limited is read in one task, so that a second refusal ends it for all."""
        slugs = sorted(places)
        size = max(1, len(slugs)) if self.limited else self.together
        return [Part({s: places[s] for s in slugs[k : k + size]}, epoch) for k in range(0, len(slugs), size)]

    def rows(self, part: Part, pages: int | None, places: dict[str, Place]) -> Iterator[tuple]:
        """The rows of a part; `places` is filled with where its slugs stand then."""
        fetch, refused = with_retry(named(self.fetcher), self.wait), False
        for slug, at in part.places.items():
            place = Place(**at)
            if refused:
                place = replace(place, done=True)
                yield slug, self.paging.terms[place.term], place.page, None, "not asked after a refusal"
            for row, place in read_slug(fetch, self.paging, slug, place, pages):  # noqa: B007
                if row is not None:
                    yield row
                    refused = self.limited and row[4] == "status 429"
            places[slug] = place


class PageReader(Pages, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts({s: asdict(Place()) for s in self.slugs})

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from self.rows(partition, None, {})


class PageStreamReader(Pages, DataSourceStreamReader):
    """Epochs of so many pages for each open slug. An epoch's offset holds the places that it begins at; tasks leave the places that they came to in the state folder, a file
    each, from which the next epoch's are made. An epoch that is run again begins at its own offset, and leaves the same files."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.state, self.pages = options["state"], int(options.get("pages_per_epoch", "1"))

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        system, path = fs.FileSystem.from_uri(self.state) if "://" in self.state or self.state.startswith("file:") else (fs.LocalFileSystem(), self.state)
        return system, "/".join([path.rstrip("/"), *names])

    def _put(self, value: dict, *names: str) -> None:
        """A file that is there as a whole or not at all."""
        system, path = self._at(*names)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{hashlib.sha1(json.dumps(value).encode()).hexdigest()[:8]}.part"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(value, sort_keys=True).encode())
        system.move(part, path)

    def _get(self, folder: str) -> dict[str, dict]:
        system, path = self._at(folder)
        out = {}
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    out[info.base_name] = json.loads(f.read())
        return out

    def initialOffset(self) -> dict:
        return {"epoch": -1, "open": {}}

    def latestOffset(self) -> dict:
        begun = self._get("epochs")
        if not begun:
            offset = {"epoch": 0, "open": {s: asdict(Place()) for s in self.slugs}} if self.slugs else self.initialOffset()
        else:
            offset = begun[max(begun)]
            left = {s: p for part in self._get(f"places-{offset['epoch']:09d}").values() for s, p in part.items()}
            open_ = {s: p for s, p in sorted(left.items()) if not p["done"]}
            # An epoch that is not finished is still the latest; with nothing open there is no more.
            if left.keys() != offset["open"].keys() or not open_:
                return offset
            offset = {"epoch": offset["epoch"] + 1, "open": open_}
        if offset["epoch"] >= 0:
            self._put(offset, "epochs", f"{offset['epoch']:09d}.json")
        return json.loads(json.dumps(offset, sort_keys=True))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(end["open"], end["epoch"]) if end["epoch"] > start["epoch"] else []

    def read(self, partition: Part) -> Iterator[tuple]:
        places: dict[str, Place] = {}
        yield from self.rows(partition, self.pages, places)
        name = hashlib.sha1("\n".join(partition.places).encode()).hexdigest()
        self._put({s: asdict(p) for s, p in places.items()}, f"places-{partition.epoch:09d}", f"{name}.json")

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """format("jobboard_pages"): slug, term, page, payload, error. Options: fetcher, slugs, paging (JSON), limited, wait, slugs_per_task; of a stream state, pages_per_epoch."""

    @classmethod
    def name(cls) -> str:
        return "jobboard_pages"

    def schema(self) -> str:
        return "slug string, term string, page int, payload string, error string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


def options(fetcher: str, slugs: list[str], paging: Paging, limited: bool = False, wait: float = BACKOFF_SECONDS, slugs_per_task: int = 8) -> dict[str, str]:
    return {"fetcher": fetcher, "slugs": json.dumps(slugs), "paging": json.dumps(asdict(paging)), "limited": str(limited).lower(), "wait": str(wait), "slugs_per_task": str(slugs_per_task)}


def pages(spark: SparkSession, fetcher: str, slugs: list[str], paging: Paging, **more) -> DataFrame:
    """All pages of the slugs: slug, term, page, payload; or the error that ended a slug."""
    spark.dataSource.register(PageSource)
    return spark.read.format("jobboard_pages").options(**options(fetcher, slugs, paging, **more)).load()


def page_stream(spark: SparkSession, fetcher: str, slugs: list[str], paging: Paging, state: str, pages_per_epoch: int = 1, **more) -> DataFrame:
    """The same as a stream, so many pages of each open slug to a micro-batch. state: a folder that the driver and all executors share, one for each crawl."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("jobboard_pages").options(**options(fetcher, slugs, paging, **more), state=state, pages_per_epoch=str(pages_per_epoch)).load()


def landed_page(slug: str, request: Request) -> Answer:
    """A fetcher over pages that were landed before, as folder|slug: the text files below slug=<slug>/key=<token, or offset, or term~offset>; a page that is not there is empty."""
    folder, _, own = slug.partition("|")
    key = request.token or (str(request.offset) if request.term is None else f"{request.term}~{request.offset}")
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    found = [i for i in system.get_file_info(fs.FileSelector(f"{path}/slug={own}/key={key}", allow_not_found=True)) if i.base_name.startswith("part-")]
    if not found:
        return Answer("{}", 404)
    with system.open_input_stream(found[0].path) as f:
        return Answer(f.read().decode())


#: Folders of landed rows.
BUCKETS = 64


def landed_row(slug: str, request: Request) -> Answer:
    """A fetcher over pages that were landed as rows (slug, key, payload), as folder|slug: Parquet below bucket=<crc32 of slug, line feed and key, modulo BUCKETS>, keys as of
    `landed_page`. A crawl opens a file for each page that it asks for, and pages that nobody asks for cost no file of their own; a page that is not there is empty."""
    folder, _, own = slug.partition("|")
    key = request.token or (str(request.offset) if request.term is None else f"{request.term}~{request.offset}")
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    bucket = zlib.crc32(f"{own}\n{key}".encode()) % BUCKETS
    files = [i.path for i in system.get_file_info(fs.FileSelector(f"{path}/bucket={bucket}", allow_not_found=True)) if i.base_name.startswith("part-")]
    if not files:
        return Answer("{}", 404)
    found = ds.dataset(files, filesystem=system, format="parquet").to_table(columns=["payload"], filter=(ds.field("slug") == own) & (ds.field("key") == key))
    return Answer(found["payload"][0].as_py()) if found.num_rows else Answer("{}", 404)
