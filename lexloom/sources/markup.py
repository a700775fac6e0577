"""Markup shredded once into a column of nodes; selectors are filters over it.

A node has its number, the number of the last node below it, tag, classes, attributes, whole text and the numbers of its
ancestors.  Nodes are numbered as they open, so what is below a node are the numbers from its own to its last: a slice.  `li`, `p`, `td`, `th`, `tr`
and `option` end an open element of their kind; void elements have no content.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import let

NODES = "array<struct<i:int,last:int,tag:string,cls:array<string>,attrs:map<string,string>,text:string,up:array<int>>>"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}


class _Shredder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.said: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open and tag in ENDS and self.nodes[self.open[-1]]["tag"] in ENDS[tag]:
            self._end(len(self.open) - 1)
        have = {k: v or "" for k, v in attrs}
        self.nodes.append({"i": len(self.nodes), "last": len(self.nodes), "tag": tag, "cls": have.get("class", "").split(), "attrs": list(have.items()), "text": "" if tag in VOID else len(self.said), "up": list(self.open)})
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[at]]["tag"] == tag:
                self._end(at)
                return

    def _end(self, at: int) -> None:
        """Elements open from `at` on end: their text are the stretches since they opened."""
        for i in self.open[at:]:
            node = self.nodes[i]
            node["last"], node["text"] = len(self.nodes) - 1, " ".join("".join(self.said[node["text"] :]).split())
        del self.open[at:]

    def close(self) -> None:
        super().close()
        self._end(0)

    def handle_data(self, data: str) -> None:
        self.said.append(data)


def nodes_of(body: str | None) -> list[dict]:
    shredder = _Shredder()
    shredder.feed(body or "")
    shredder.close()
    return shredder.nodes


def _shred(body: str):
    kind = pa.list_(pa.struct([("i", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("cls", pa.list_(pa.string())), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("up", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                nodes = pa.array([nodes_of(x.as_py()) for x in part.column(body)], kind)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c != body], nodes], [*[c for c in part.schema.names if c != body], "nodes"])

    return run


def shred(df: DataFrame, body: str) -> DataFrame:
    """`body` replaced by `nodes`; null or empty markup has none."""
    rest = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != body]
    return df.mapInArrow(_shred(body), ", ".join([*rest, f"nodes {NODES}"]))


def with_class(nodes: Column, name: str) -> Column:
    return F.filter(nodes, lambda n: F.array_contains(n["cls"], name))


def with_tag(nodes: Column, name: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"] == name)


def below(nodes: Column, node: Column) -> Column:
    """The nodes below one; `nodes` are all of a page or all below some node, without a gap."""
    return F.slice(nodes, node["i"] - F.get(nodes, F.lit(0))["i"] + 2, node["last"] - node["i"])


def _in(node: Column, outer: Column) -> Column:
    return F.exists(outer, lambda o: (node["i"] > o["i"]) & (node["i"] <= o["last"]))


def inside(nodes: Column, outer: Column) -> Column:
    """Nodes below any of the outer nodes."""
    return let(outer, lambda o: F.filter(nodes, lambda n: _in(n, o)))


def outside(nodes: Column, outer: Column) -> Column:
    return let(outer, lambda o: F.filter(nodes, lambda n: ~_in(n, o)))


def first_text(nodes: Column) -> Column:
    return F.coalesce(F.try_element_at(nodes, F.lit(1))["text"], F.lit(""))


def texts(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["text"])
