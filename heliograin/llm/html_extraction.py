"""Operator 1: article texts by union-free expressions inferred for each host.

Each page becomes a tree of blocks whose adjacent repeats are folded. Trees of
one host are aligned one by one: text that differs becomes a slot, blocks that
some pages lack become optional, runs become repeated groups. The result, the
host's wrapper, tells where its pages differ and how much text stands where; it
is cut down to the ways to the article (an article element; else a block named
as content that holds most of the variable text; else the smallest block that
does), and every page is read along these ways, leaving out blocks whose
element or whose tokens of class, id or role name them as menu, header, footer, advert,
form, notice, comment and the like. Names are overruled where the wrapper shows
that hardly any text would be left without the blocks they name.

Wrappers are merged where the pages are read, then by host and a salt, then by
host: a host with a third of all pages sends one small tree from each task.
A wrapper's node has a bounded number of children: the lightest beyond it become
one place of any blocks, so generated names don't make it grow with the pages.
Pages meet the ways of their host by a broadcast while all ways are small, and
else by a shuffled join that leaves out the few large hosts, whose ways are
broadcast (``common.meet``); ways hold no text.

Defined results: a null or empty html gives the empty text; a page without its
wrapper's regions is read by a wrapper of its own; a null or unreadable url
belongs to the host ""; repeated rows give equal rows; an empty table gives an
empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import page_parts as P

#: Hosts whose wrappers a task holds before it sends them on.
HELD_HOSTS = 2000
SALTS = 16
_WRAPPER = "host string, pages long, wrapper string"


def _rows(found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.string()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([json.dumps(x[1], separators=(",", ":")) for x in found.values()], pa.string())],
        ["host", "pages", "wrapper"],
    )


def _inferred(batches):
    held: dict = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1)):
            tree = P.expression(P.parse(page.as_py()))
            n, known = held.get(host, (0, None))
            held[host] = (n + 1, tree if known is None else P.merged(known, tree))
        if len(held) > HELD_HOSTS:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _merged(t: pa.Table) -> pa.Table:
    pairs = sorted(zip(t.column("wrapper").to_pylist(), t.column("pages").to_pylist()))
    n, known = 0, None
    for raw, pages in pairs:
        tree = json.loads(raw)
        n, known = n + pages, tree if known is None else P.merged(known, tree)
    return pa.Table.from_batches([_rows({t.column("host")[0].as_py(): (n, known)})])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, pages, wrapper): one expression for each host, as JSON."""
    read = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("html is not null")
    part = read.mapInArrow(C.tidy(_inferred), _WRAPPER).withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    part = part.groupBy("host", "salt").applyInArrow(lambda t: _merged(t), _WRAPPER)
    return part.groupBy("host").applyInArrow(lambda t: _merged(t), _WRAPPER)


def _regions(batches):
    for b in batches:
        made = [json.dumps(P.regions(json.loads(w), n), separators=(",", ":")) for n, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], ["of", "pages", "regions"])


def article(page: str | None, regions: list | None) -> str:
    """The text of one page, its blocks joined by line ends."""
    if not page:
        return ""
    tree = P.parse(page)
    found = P.texts(tree, regions) if regions else []
    if not found:
        found = P.texts(tree, P.regions(P.expression(tree), 1))
    return "\n".join(found)


def _extracted(batches):
    known: dict[str | None, list | None] = {None: None}
    for b in batches:
        out = []
        for page, raw in zip(b.column(2), b.column(3).to_pylist()):
            if raw not in known:
                if len(known) > HELD_HOSTS:
                    known = {None: None}
                known[raw] = json.loads(raw)
            out.append(article(page.as_py(), known[raw]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_bytes: int = C.BROADCAST_BYTES) -> DataFrame:
    """Rows (id, url, text), a row for each page."""
    ways = C.cut(wrappers(pages, url_col, html_col).mapInArrow(C.tidy(_regions), "of string, pages long, regions string"))
    read = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    size = F.octet_length("of") + F.octet_length("regions")
    return C.meet(read, F.col("host"), ways, "of", "pages", size, most_bytes).select("id", "url", "html", "regions").mapInArrow(C.tidy(_extracted), "id long, url string, text string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract(C.table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
