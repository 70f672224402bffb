"""Files from the network into a cache on any store, outside of any query: the engine reads the cache.

Paths are uris that pyarrow opens (file://, hdfs://, s3://, ...), so the cache may be the folder that a cluster shares."""

from __future__ import annotations

import gzip
import hashlib
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable

from pyarrow import fs as pafs

from ..config import MAJOR_ROADS, MINOR_ROADS


def exists(uri: str) -> bool:
    store, path = pafs.FileSystem.from_uri(uri)
    return store.get_file_info(path).type == pafs.FileType.File


def write_bytes(uri: str, raw: bytes) -> str:
    """Write beside the file's place and rename, so that a reader never meets a part of it."""
    store, path = pafs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        out.write(raw)
    store.move(part, path)
    return uri


def fetch(url: str, uri: str, data: bytes | None = None, timeout: float = 300, opener: Callable = urllib.request.urlopen) -> str:
    """The cached file, downloaded if absent, and unpacked if it is gzip."""
    if exists(uri):
        return uri
    with opener(urllib.request.Request(url, data=data), timeout=timeout) as answer:
        raw = answer.read()
    return write_bytes(uri, gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


Box = tuple[float, float, float, float]


def tile_path(cache: str, key: str, box: Box) -> str:
    """Named by the box itself, so that an area whose box changed never meets another box's tile."""
    return f"{cache.rstrip('/')}/{key}-{hashlib.sha256(repr(box).encode()).hexdigest()[:16]}.json"


def fetch_tile(url: str, query: str, uri: str, retries: int = 4, pause: float = 2.0, backoff: float = 30.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> str:
    """Like fetch, with the query in the body, a pause after each download and growing waits between attempts."""
    if exists(uri):
        return uri
    for attempt in range(retries):
        try:
            fetch(url, uri, data=urllib.parse.urlencode({"data": query}).encode(), opener=opener)
            sleep(pause)
            return uri
        except OSError:
            sleep(backoff * (attempt + 1))
    raise RuntimeError(f"{url} gave nothing in {retries} attempts")


def _within(box: Box) -> str:
    """The service wants south, west, north, east."""
    x0, y0, x1, y1 = box
    return f"({y0},{x0},{y1},{x1})"


def oneway_query(box: Box) -> str:
    """Ways with a direction, by tag or by what they are."""
    implied = '["oneway"!="no"]'
    picks = ('["highway"]["oneway"~"^(yes|1|true|-1|reverse)$"]', f'["highway"]["junction"~"^(roundabout|circular)$"]{implied}', f'["highway"~"^motorway$"]{implied}')
    return "[out:json][timeout:240];\n(\n" + "".join(f"  way{pick}{_within(box)};\n" for pick in picks) + ");\nout tags geom;"


def roads_query(box: Box) -> str:
    """Drivable ways with their nodes."""
    classes = "|".join((*MAJOR_ROADS, *MINOR_ROADS))
    return f'[out:json][timeout:240];\nway["highway"~"^({classes})$"]["area"!="yes"]["access"!~"^(private|no)$"]{_within(box)};\nout body geom;'
