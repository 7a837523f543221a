"""Pages over HTTP as a data source: ``spark.read.format("weftline_http")`` gives the columns of a fetch log.

URLs are spread over partitions, so executors fetch side by side. Redirects are followed by hand, each hop under the network policy, and logged;
bodies are cut at the limits. A fetch that fails is a row with an error, not a failed job.
"""

from __future__ import annotations

import http.client
import ipaddress
import json
import socket
import ssl
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import sha256
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.functions.netpolicy import address_allowed
from weftline.session import ship
from weftline.sources.records import DECODED_LIMIT, ENCODED_LIMIT, decode_content

REDIRECTS, MOST_HOPS = (301, 302, 303, 307, 308), 10
SCHEMA = (
    "requested_url STRING, final_url STRING, redirects ARRAY<STRUCT<url: STRING, status: INT>>, http_status INT, content_type STRING, content_type_header STRING, "
    "body BINARY, raw_hash STRING, fetched_at TIMESTAMP, backend STRING, input_truncated STRING, error STRING"
)


class Refused(Exception):
    """A fetch that ends with an error code."""


def _connected(url: str, timeout: float, private: bool) -> tuple[http.client.HTTPConnection, str]:
    """A connection to an address that the policy allows, and the path to ask for. All addresses of a host must be allowed; the one checked is used."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise Refused("invalid_url")
    if parts.username or parts.password:
        raise Refused("blocked_by_policy")
    port = parts.port or (443 if parts.scheme == "https" else 80)
    try:
        addresses = [a[4][0] for a in socket.getaddrinfo(parts.hostname, port, type=socket.SOCK_STREAM)]
    except OSError as error:
        raise Refused("dns_failure") from error
    if not private and not all(address_allowed(str(ipaddress.ip_address(a.split("%")[0]))) for a in addresses):
        raise Refused("blocked_by_policy")
    if parts.scheme == "https":
        connection = http.client.HTTPSConnection(parts.hostname, port, timeout=timeout, context=ssl.create_default_context())
    else:
        connection = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
    connection._create_connection = lambda address, *a, **k: socket.create_connection((addresses[0], address[1]), *a, **k)
    return connection, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def fetch(url: str, timeout: float = 30.0, private: bool = False, encoded_limit: int = ENCODED_LIMIT, decoded_limit: int = DECODED_LIMIT) -> tuple:
    """One row of the source for a URL."""
    hops: list[dict] = []
    at, status, kind, header, body, cut, error = url, None, None, None, None, None, None
    try:
        while True:
            connection, path = _connected(at, timeout, private)
            try:
                connection.request("GET", path, headers={"Accept": "text/html,application/xhtml+xml,application/pdf,text/*;q=0.9,*/*;q=0.5", "Accept-Encoding": "gzip, deflate", "User-Agent": "weftline"})
                response = connection.getresponse()
                status, target = response.status, response.getheader("Location")
                if status in REDIRECTS and target:
                    hops.append({"url": at, "status": status})
                    following = urljoin(at, target)
                    if len(hops) > MOST_HOPS:
                        raise Refused("too_many_redirects")
                    if following in {h["url"] for h in hops}:
                        raise Refused("redirect_loop")
                    at = following
                    continue
                raw = response.read(encoded_limit + 1)
                cut = "compressed_limit" if len(raw) > encoded_limit else None
                header = response.getheader("Content-Type")
                kind = (header or "").split(";")[0].strip().lower() or None
                body, problem = decode_content(raw[:encoded_limit], response.getheader("Content-Encoding"), decoded_limit)
                cut = cut or (problem if problem == "decompressed_limit" else None)
                error = problem if body is None else "http_error" if not 200 <= status < 300 else None
                break
            finally:
                connection.close()
    except Refused as refused:
        error = str(refused)
    except TimeoutError:
        error = "timeout"
    except (OSError, http.client.HTTPException):
        error = "connect_failed"
    return (url, at, hops, status, kind, header, body, sha256(body).hexdigest() if body is not None else None, datetime.now(timezone.utc).replace(tzinfo=None), "http", cut, error)


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = list(dict.fromkeys(json.loads(options["urls"])))
        self.size = max(1, int(options.get("batch", "50")))
        self.timeout, self.private = float(options.get("timeout", "30")), options.get("private", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Urls(self.urls[i : i + self.size]) for i in range(0, len(self.urls), self.size)] or [_Urls([])]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch(url, self.timeout, self.private)


class HttpSource(DataSource):
    """Options: ``urls`` (a JSON list), ``batch`` (URLs a partition), ``timeout`` (seconds), ``private`` (whether private addresses are allowed)."""

    @classmethod
    def name(cls) -> str:
        return "weftline_http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def fetched(spark: SparkSession, urls: list[str], batch: int = 50, timeout: float = 30.0, private: bool = False) -> DataFrame:
    """The pages of a list of URLs. The list is the crawl frontier's next level, so the driver holds it; the bodies stay on the executors."""
    ship(spark)
    spark.dataSource.register(HttpSource)
    return spark.read.format("weftline_http").options(urls=json.dumps(urls), batch=str(batch), timeout=str(timeout), private=str(private)).load()
