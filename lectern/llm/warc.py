"""WARC archives and their globally ordered capture index.

Tasks write archives of gzipped records and one sorted run of index entries each. Runs are merged externally: a
merge task holds one range of keys and, of at most ``FAN_IN`` runs, the blocks that reach into it; a loser tree
gives the entries in order. More runs than that take another level of merging. Ranges are cut by counts of entries
and keys end in the page id, so neither a busy host nor a busy URL makes a task large.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import map_batches, new_folder, place, put_file, text_of
from lectern.session import cut_lineage

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 32 << 20
GZIP_LEVEL = 3
RUN_ENTRIES = 50_000
BLOCK_ENTRIES = 1024
FAN_IN = 64
RANGE_ENTRIES = 20_000
#: Bytes of an archive that one task reads back.
READ_BYTES = 8 << 20
BLOCKS = "run string, range long, block int, entries int, first_key string, last_key string, lines binary"
_BLOCK_NAMES = ["run", "range", "block", "entries", "first_key", "last_key", "lines"]
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Host labels from the right, then path and query, in lower case without scheme, ``www`` and fragment."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    labels = host.split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    tail = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(labels))}{tail}){parts.path or '/'}{query}"


def entry_key(key: str, stamp: str, page: int) -> str:
    """Sorts by URL key, time and page."""
    return f"{key}\x01{stamp}\x01{page + (1 << 63):020d}"


class LoserTree:
    """Merge sorted iterators. Inner nodes keep the loser of their match, so the next winner replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.size = max(1, len(sources))
        self.heads = [next(s, None) for s in sources]
        self.losers = [-1] * self.size
        self.winner = self._play(1) if sources else -1

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None and (a is not None or i < j)
        return (a[0], i) < (b[0], j)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        i, j = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (i, j) if self._beats(i, j) else (j, i)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            at = self.winner
            yield self.heads[at]
            self.heads[at] = next(self.sources[at], None)
            node = (at + self.size) // 2
            while node:
                if self._beats(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def record(kind: str, page: int, url: str, stamp: datetime, payload: bytes, digest: str, refers) -> bytes:
    """One gzipped WARC record: a response with its payload, or a revisit of a response without it."""
    size = len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head if kind == "revisit" else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {stamp:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers}>")
    lines.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of a gzipped record."""
    whole = zlib.decompress(raw, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def block_batch(run: str, key_range: int, first: int, entries: list[tuple[str, str]]) -> Iterator[tuple]:
    """Cut sorted entries ``(key, line)`` into blocks."""
    for k, start in enumerate(range(0, len(entries), BLOCK_ENTRIES)):
        some = entries[start : start + BLOCK_ENTRIES]
        lines = zlib.compress("\n".join(f"{key}\x02{line}" for key, line in some).encode(), 1)
        yield run, key_range, first + k, len(some), some[0][0], some[-1][0], lines


def lines_of(block: bytes) -> Iterator[tuple[str, str]]:
    for line in zlib.decompress(block).decode().split("\n"):
        key, _, rest = line.partition("\x02")
        yield key, rest


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, exact, digest, refers_to``: pages with equal payloads of some size revisit that with the largest id.

    ``exact`` is a hash of the payload, which with the id stands for the page.
    """
    narrow = cut_lineage(
        pages.select("page_id", "exact", F.sha1("html").alias("digest"), F.octet_length("html").alias("size")), "payloads"
    )
    large = narrow.filter(F.col("size") >= REVISIT_BYTES)
    stays = large.groupBy("exact", "size").agg(F.max("page_id").alias("response"))
    return (
        narrow.join(stays, ["exact", "size"], "left")
        .select("page_id", "exact", "digest", F.expr("nullif(response, page_id)").alias("refers_to"))
        .dropDuplicates(["page_id", "exact"])
    )


def judged(clean: DataFrame) -> DataFrame:
    """Pages, each once, with their digests and what they revisit. Whole pages are dealt once, for both steps."""
    single = clean.repartition("page_id", "exact").dropDuplicates(["page_id", "url", "exact"])
    return single.join(revisits(clean), ["page_id", "exact"])


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    time_col: str | None = None,
    folder: str | None = None,
    run_entries: int = RUN_ENTRIES,
) -> DataFrame:
    """Write a record a page and return the sorted runs of index entries, as a written table of blocks.

    A missing page is an empty payload, a missing URL an empty one. Rows without an id are left out. Rows of one
    id are records of their own, unless URL and payload are the same too. Without ``time_col`` (a timestamp) a page is captured as many seconds after the epoch
    as its id says, so that runs over the same pages agree. Only archives that the runs name are ever read.
    """
    spark = pages.sparkSession
    target = folder or new_folder(spark, "archives")
    second = F.unix_timestamp(time_col) if time_col else F.pmod(F.col(id_col).cast("long"), F.lit(1 << 32))
    clean = (
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            text_of(url_col).alias("url"),
            text_of(html_col).alias("html"),
            F.coalesce(second, F.lit(0)).cast("long").alias("second"),
        )
        .filter("page_id is not null")
        .withColumn("exact", F.sha2("html", 256))
    )
    rows = judged(clean).select("page_id", "url", "html", "second", "digest", "refers_to")

    def write(batches):
        part, runs, archives = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        waiting: list[tuple[str, str]] = []
        entries: list[tuple[str, str]] = []
        size = 0

        def close_archive():
            nonlocal size, archives
            if held:
                uri = put_file(target, f"pages-{part:06d}-{archives:04d}.warc.gz", b"".join(held))
                entries.extend((key, f"{line}\t{uri}") for key, line in waiting)
                held.clear(), waiting.clear()
                size, archives = 0, archives + 1

        def close_run():
            nonlocal runs
            close_archive()
            entries.sort()
            out = list(block_batch(f"{part:06d}-{runs:04d}", 0, 0, entries))
            entries.clear()
            runs += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(column, kind)
                    for column, kind in zip(
                        zip(*out),
                        [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary()],
                    )
                ],
                names=_BLOCK_NAMES,
            )

        for batch in batches:
            for page, url, html, second, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                stamp = _EPOCH + timedelta(seconds=second)
                kind = "response" if refers is None else "revisit"
                safe = url.replace("\r", "%0D").replace("\n", "%0A")
                raw = record(kind, page, safe, stamp, html.encode(), digest, refers)
                key = entry_key(url_key(safe).translate(_NO_MARKS), f"{stamp:%Y%m%d%H%M%S}", page)
                waiting.append((key, f"{kind}\t{size}\t{len(raw)}"))
                held.append(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    close_archive()
                if len(entries) + len(waiting) >= run_entries:
                    yield close_run()
        if entries or waiting:
            yield close_run()

    return cut_lineage(map_batches(rows, write, BLOCKS), "index-runs")


#: Marks of the index lines that a URL may not hold.
_NO_MARKS = {1: "%01", 2: "%02", 9: "%09", 10: "%0A", 13: "%0D"}


def merge_level(blocks: DataFrame, groups: int, level: int, range_entries: int) -> DataFrame:
    """Merge the runs of each group into one, by ranges of keys."""
    numbered = blocks.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("long"))
    numbered = numbered.withColumn("id", F.concat_ws("/", "run", "range", "block"))
    # Entries of blocks that begin up to a key, cut into equal shares, number the range that the key is in.
    ends = numbered.select("group", "id", F.col("first_key").alias("key"), F.col("entries").alias("n")).unionByName(
        numbered.select("group", "id", F.col("last_key").alias("key"), F.lit(0).alias("n"))
    )
    upto = Window.partitionBy("group").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ends.withColumn("at", F.floor((F.sum("n").over(upto) - 1) / range_entries).cast("long"))
    spans = placed.groupBy("group", "id").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    cuts = placed.groupBy("group", "at").agg(F.min("key").alias("low"))
    following = Window.partitionBy("group").orderBy("at")
    cuts = cuts.withColumn("high", F.lead("low").over(following))
    reached = numbered.join(spans, ["group", "id"]).withColumn("at", F.explode(F.sequence("from", "to")))
    work = reached.join(cuts, ["group", "at"]).select("group", "at", "low", "high", "run", "range", "block", "lines")

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["run", "range", "block"])
        low, high = part["low"].iloc[0], part["high"].iloc[0]

        def entries(held: Iterable[bytes]) -> Iterator[tuple[str, str]]:
            for block in held:
                for key, line in lines_of(block):
                    if low <= key and (high is None or key < high):
                        yield key, line

        tree = LoserTree([entries(own["lines"].tolist()) for _, own in part.groupby("run", sort=True)])
        group, at = int(part["group"].iloc[0]), int(part["at"].iloc[0])
        return pd.DataFrame(list(block_batch(f"m{level}-{group:06d}", at, 0, list(tree))), columns=_BLOCK_NAMES)

    return cut_lineage(work.groupBy("group", "at").applyInPandas(merge, BLOCKS), "index-merged")


def merge_runs(blocks: DataFrame, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """Merge all runs into one: its blocks, in order of ``range`` and ``block``."""
    runs, level = blocks.select("run").distinct().count(), 0
    while True:
        # Groups are drawn by hash, so they are made half as full as a merge may be.
        groups = 1 if runs <= fan_in else -(-2 * runs // fan_in)
        blocks = merge_level(blocks, groups, level, range_entries)
        if groups == 1:
            return blocks
        runs, level = blocks.select("run").distinct().count(), level + 1


def captures(merged: DataFrame) -> DataFrame:
    """Entries of the merged index; ``range, block, nth`` put them in order of ``url_key``, ``stamp``, ``page_id``."""
    names = ["range", "block", "nth", "url_key", "stamp", "page_id", "record_type", "file", "offset", "length"]

    def work(batches):
        for batch in batches:
            for key_range, block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                rows = []
                for nth, (key, line) in enumerate(lines_of(raw)):
                    url, stamp, page = key.split("\x01")
                    kind, offset, length, uri = line.split("\t")
                    fixed = (key_range, block, nth, url, stamp, int(page) - (1 << 63))
                    rows.append((*fixed, kind, uri, int(offset), int(length)))
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
                kinds += [pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = (
        "range long, block int, nth int, url_key string, stamp string, page_id long, record_type string, "
        "file string, offset long, length long"
    )
    return map_batches(merged.select("range", "block", "lines"), work, schema)


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that index entries name, checking payloads against their digests.

    Returns ``page_id, url, stamp, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, the
    ``payload`` (null for a revisit). Tasks take stretches of archives, so each is read once from front to back.
    """
    names = ["page_id", "url", "stamp", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = (
        "page_id long, url string, stamp string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long"
    )
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def work(batches):
        name, source = None, None
        for batch in batches:
            rows = []
            for uri, offset, length, stamp in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != name:
                    if source:
                        source.close()
                    system, path = place(uri)
                    name, source = uri, system.open_input_file(path)
                fields, payload = parse(source.read_at(length, offset))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{uri} is damaged at {offset}")
                refers = fields.get("WARC-Refers-To")
                row = (
                    page_of(fields["WARC-Record-ID"]),
                    fields["WARC-Target-URI"],
                    stamp,
                    int(fields["WARC-Payload-Length"]),
                    digest,
                    kind,
                    page_of(refers) if refers else None,
                )
                rows.append((*row, payload if kind == "response" else None) if payloads else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    stretch = F.floor(F.col("offset") / READ_BYTES)
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    return map_batches(dealt.select("file", "offset", "length", "stamp"), work, schema)


def page_of(identifier: str) -> int:
    return int(identifier.removeprefix("<urn:page:").removesuffix(">"))
