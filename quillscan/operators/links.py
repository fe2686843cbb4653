"""Links: candidates in reading order, and their check where a caller asks for it."""

from __future__ import annotations

import ipaddress
import socket
import time
from collections.abc import Callable, Mapping
from typing import Any
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillscan.functions.regex import java
from quillscan.functions.text import matches
from quillscan.operators._findings import findings
from quillscan.tables import Tables

URL = java(r"https?://[^\s<>\])}]+")
ACTION = "Confirm the link manually or update/remove it from the publication."
# Limits of a check.
REDIRECTS, PORTS, RESPONSE_BYTES = 3, (80, 443), 64 * 1024
UNDONE = "could not be safely completed"
#: Tasks that may ask one host.
LANES = 2


def candidates(tables: Tables, max_links: int = 100) -> DataFrame:
    """The first ``max_links`` different URLs of each book in reading order, each at the first sentence that has it."""
    rows = tables.sentences.where(F.lower("text").contains("http")).select("*", F.posexplode(matches(F.col("text"), URL)).alias("nth", "url"))
    place = F.struct("ord", "nth", "file", "chapter", "par", "sent", "text")
    firsts = rows.groupBy("book_id", "url").agg(F.min(place).alias("f")).select("book_id", "url", "f.*")
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("ord", "nth"))
    return firsts.withColumn("n", order).where(F.col("n") <= max_links)


def safe_target(url: str, resolve: Callable | None = None) -> list | None:
    """Public addresses of an http(s) URL that may be asked, None if it must not be."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port or (443 if parts.scheme == "https" else 80)
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not host or parts.username or parts.password or "%" in parts.netloc or port not in PORTS:
        return None
    host = host.rstrip(".").casefold()
    if host == "localhost" or host.endswith(".localhost"):
        return None
    last = host.rsplit(".", 1)[-1]
    numeric = ":" in host or last.isdigit() or last.startswith("0x")
    try:
        if numeric:
            return [(host, port)] if ipaddress.ip_address(host).is_global and not ipaddress.ip_address(host).is_multicast else None
        answers = (resolve or socket.getaddrinfo)(host, port, type=socket.SOCK_STREAM)
    except (ValueError, OSError):
        return None
    addresses = [a[4][0] for a in answers]
    public = [ipaddress.ip_address(a.split("%")[0]) for a in addresses]
    return [(a, port) for a in addresses] if addresses and all(p.is_global and not p.is_multicast for p in public) else None


class Pool:
    """HEAD requests to addresses that were found safe, over connections that stay open while a host lets them."""

    def __init__(self) -> None:
        self.open: dict[tuple[str, str], socket.socket] = {}

    def _connected(self, url: str, timeout: float) -> socket.socket:
        import ssl

        target = safe_target(url)
        if not target:
            raise ValueError("unsafe link target")
        parts = urlsplit(url)
        sock = socket.create_connection(target[0], timeout)
        return ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname) if parts.scheme == "https" else sock

    def head(self, url: str, timeout: float) -> tuple[int, str | None]:
        """Status and redirect target; one new connection is tried where a kept one has gone."""
        import http.client

        parts = urlsplit(url)
        key, path = (parts.scheme, parts.netloc), (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        kept = self.open.pop(key, None)
        for sock in (kept, None) if kept else (None,):
            sock = sock or self._connected(url, timeout)
            try:
                sock.settimeout(timeout)
                sock.sendall(f"HEAD {path} HTTP/1.1\r\nHost: {parts.netloc}\r\nConnection: keep-alive\r\n\r\n".encode("ascii", "ignore"))
                answer = http.client.HTTPResponse(sock, method="HEAD")
                answer.begin()
                answer.read(RESPONSE_BYTES)
            except (OSError, http.client.HTTPException) as error:
                sock.close()
                if sock is not kept:
                    raise OSError(str(error)) from error
                continue
            if answer.will_close:
                sock.close()
            else:
                self.open[key] = sock
            return answer.status, answer.getheader("Location")
        raise OSError("no answer")

    def close(self) -> None:
        for sock in self.open.values():
            sock.close()
        self.open.clear()


def head(url: str, timeout: float) -> tuple[int, str | None]:
    """Status and redirect target from one HEAD request to the address that was found safe."""
    pool = Pool()
    try:
        return pool.head(url, timeout)
    finally:
        pool.close()


def outcome(url: str, timeout: float, check: Callable[[str, float], tuple[int, str | None]] | None = None) -> str:
    """``success``, ``HTTP status n`` or ``could not be safely completed``."""
    for step in range(REDIRECTS + 1):
        try:
            status, location = (check or head)(url, timeout)
        except (OSError, ValueError):
            break
        if 200 <= status < 300:
            return "success"
        if status >= 400:
            return f"HTTP status {status}"
        if not location or step == REDIRECTS:
            break
        url = urljoin(url, location)
    return UNDONE


def outcomes(urls: DataFrame, timeout: float = 5.0, check: Callable[[str, float], tuple[int, str | None]] | None = None, lanes: int = LANES, host_seconds: float | None = None) -> DataFrame:
    """(url, detail) of every different URL, each asked once however many books have it.

    URLs are dealt by host, so a host is asked by at most ``lanes`` tasks, one request after another over kept connections.
    With ``host_seconds``, what is left of a host's lane after so many seconds is not asked any more and told as not completed.
    """

    def run(batches):
        pool, spent = Pool(), {}
        try:
            for batch in batches:
                details = []
                for host, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if host_seconds is not None and spent.get(host, 0.0) >= host_seconds:
                        details.append(UNDONE)
                        continue
                    began = time.monotonic()
                    details.append(outcome(url, timeout, check or pool.head))
                    spent[host] = spent.get(host, 0.0) + time.monotonic() - began
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(details, pa.string())], names=["url", "detail"])
        finally:
            pool.close()

    host = F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#]*)", 1)), F.lit(""))
    rows = urls.select("url").distinct().select(host.alias("host"), "url", F.pmod(F.xxhash64("url"), F.lit(max(1, lanes))).alias("lane"))
    return rows.repartition("host", "lane").sortWithinPartitions("host", "lane", "url").select("host", "url").mapInArrow(run, "url string, detail string")


def link_findings(tables: Tables, rules: Mapping[str, Any], check=None) -> DataFrame:
    """A finding for every candidate whose check does not succeed. Runs requests on the executors: only if asked for."""
    part = rules.get("links", {}) if isinstance(rules.get("links", {}), Mapping) else {}
    timeout, most = max(0.1, float(part.get("timeout_seconds", 5))), max(0, int(part.get("max_links", 100)))
    rows = candidates(tables, most)
    rows = rows.join(outcomes(rows, timeout, check).where("detail <> 'success'"), "url")
    reason = F.concat(F.lit("Link verification was requested and "), F.col("url"), F.lit(" "), F.col("detail"), F.lit("; review the URL and its source context."))
    return findings(rows, "citations", "link_verification", "medium", reason, ACTION, 1.0)
