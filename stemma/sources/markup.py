"""Documents in markup as flat unit tables.

Spark schemas aren't recursive: a unit is a row (unit_id, parent_id, ordinal, depth, path, type, label, attrs, text),
in document order, parents before children. The parsers are Python generators over one document each, run by
mapInArrow where the bytes are; nothing is shuffled.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

UNITS = "unit_id int, parent_id int, ordinal int, depth int, path string, type string, label string, attrs map<string,string>, text string"
COLUMNS = {"unit_id": pa.int32(), "parent_id": pa.int32(), "ordinal": pa.int32(), "depth": pa.int32(), "path": pa.string(), "type": pa.string(), "label": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "text": pa.string()}
#: So many units go back to Spark at once, those of several documents together.
BATCH = 10_000
#: Elements whose content is no text, and those without an end tag: fixed by HTML.
SKIPPED = frozenset(("script", "style", "noscript", "svg", "math"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Units:
    """Collects rows and numbers them."""

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.children: dict[int | None, int] = {}

    def add(self, parent: int | None, kind: str, label: str | None = None, attrs: dict | None = None, text: str | None = None) -> int:
        ordinal = self.children.get(parent, 0)
        self.children[parent] = ordinal + 1
        up = self.rows[parent] if parent is not None else None
        path = (up["path"] + "." if up else "") + f"{ordinal:08d}"
        self.rows.append({"unit_id": len(self.rows), "parent_id": parent, "ordinal": ordinal, "depth": up["depth"] + 1 if up else 0, "path": path, "type": kind, "label": label, "attrs": {k: str(v) for k, v in (attrs or {}).items()}, "text": text})
        return len(self.rows) - 1


def markdown(text: str) -> list[dict]:
    """Headings nest sections; a blank line ends a paragraph; fenced blocks are text, headings in them too. S10, F05."""
    out = Units()
    open_: list[tuple[int, int]] = []  # level, section
    block: list[str] = []
    fence = None

    def flush() -> None:
        if block:
            out.add(open_[-1][1] if open_ else None, "paragraph", text=" ".join(x.strip() for x in block) if fence is None else "\n".join(block))
            block.clear()

    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence is not None:
            if mark and mark[1].startswith(fence) and line.strip() == mark[1]:
                if block:
                    out.add(open_[-1][1] if open_ else None, "code", text="\n".join(block))
                    block.clear()
                fence = None
            else:
                block.append(line)
            continue
        if mark:
            flush()
            fence = mark[1]
            continue
        head = re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if head:
            flush()
            level = len(head[1])
            while open_ and open_[-1][0] >= level:
                open_.pop()
            open_.append((level, out.add(open_[-1][1] if open_ else None, "section", label=head[2], attrs={"level": level})))
        elif line.strip():
            block.append(line)
        else:
            flush()
    if fence is not None and block:
        out.add(open_[-1][1] if open_ else None, "code", text="\n".join(block))
    else:
        flush()
    return out.rows


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.buffer, self.skip = Units(), [], [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.out.add(self.stack[-1][1] if self.stack else None, "text", text=text)
        self.buffer.clear()

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in SKIPPED:
            self.skip += tag in SKIPPED
            return
        self.flush()
        unit = self.out.add(self.stack[-1][1] if self.stack else None, tag, attrs={k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.stack.append((tag, unit))

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        self.flush()
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)


def html(text: str) -> list[dict]:
    """The tree of tags; loose text becomes a unit of its own. S11."""
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.out.rows


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xml(text: str) -> list[dict]:
    """The root's children as units; a root without elements is one unit. Text around elements keeps its place. S12."""
    out = Units()
    root = ElementTree.fromstring(text)

    def walk(e, parent) -> None:
        words = " ".join((e.text or "").split())
        leaf = len(e) == 0
        unit = out.add(parent, _local(e.tag), attrs={_local(k): v for k, v in e.attrib.items()}, text=words if leaf and words else None)
        if not leaf and words:
            out.add(unit, "text", text=words)
        for c in e:
            if isinstance(c.tag, str):
                walk(c, unit)
            tail = " ".join((c.tail or "").split())
            if tail:
                out.add(unit, "text", text=tail)

    for e in [root] if len(root) == 0 else root:
        walk(e, None)
    return out.rows


def tei(text: str) -> list[dict]:
    """The children of the body; a head becomes its parent's label and is no unit. S13."""
    root = ElementTree.fromstring(text)
    body = next((e for e in root.iter() if _local(e.tag) == "body"), root)
    rows = xml(ElementTree.tostring(body, encoding="unicode"))
    text_of = {}
    for r in rows:
        if r["text"]:
            at = r
            while at is not None and at["type"] != "head":
                at = rows[at["parent_id"]] if at["parent_id"] is not None else None
            if at is not None:
                text_of[at["unit_id"]] = (text_of.get(at["unit_id"], "") + " " + r["text"]).strip()
    heads = {r["unit_id"] for r in rows if r["type"] == "head" and r["parent_id"] is not None}
    gone = set(heads)
    for r in rows:
        if r["parent_id"] in gone:
            gone.add(r["unit_id"])
    for h in heads:
        up = rows[rows[h]["parent_id"]]
        up["label"] = up["label"] or text_of.get(h)
    out = Units()
    new: dict[int, int] = {}
    for r in rows:
        if r["unit_id"] not in gone:
            new[r["unit_id"]] = out.add(new.get(r["parent_id"]), r["type"], r["label"], r["attrs"], r["text"])
    return out.rows


def epub(data: bytes) -> list[dict]:
    """A chapter for each document item of the manifest, in its order, with the units of its body. S14."""
    out = Units()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if _local(e.tag) == "rootfile")
        folder = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
        package = ElementTree.fromstring(z.read(opf))
        meta = {_local(e.tag): (e.text or "").strip() for e in package.iter() if e.tag.startswith("{http://purl.org/dc/elements/1.1/}")}
        for e in package.iter():
            if _local(e.tag) == "item" and e.get("media-type") in ("application/xhtml+xml", "text/html"):
                chapter = out.add(None, "chapter", label=e.get("id"), attrs={"href": e.get("href") or "", **meta})
                rows = html(z.read(folder + e.get("href")).decode("utf-8", "replace"))
                body = next((r["unit_id"] for r in rows if r["type"] == "body"), None)
                new = {body: chapter}
                for r in rows:
                    if r["parent_id"] in new and r["unit_id"] != body and r["parent_id"] is not None:
                        new[r["unit_id"]] = out.add(new[r["parent_id"]], r["type"], r["label"], r["attrs"], r["text"])
    return out.rows


PARSERS = {"markdown": markdown, "html": html, "xml": xml, "tei": tei, "epub": epub}


def _batch(key: str, of: pa.DataType, keys: list, rows: list[dict]) -> pa.RecordBatch:
    columns = {key: pa.array(keys, of)}
    for name, kind in COLUMNS.items():
        values = [list(r["attrs"].items()) for r in rows] if name == "attrs" else [r[name] for r in rows]
        columns[name] = pa.array(values, kind)
    return pa.RecordBatch.from_pydict(columns)


def units(docs: DataFrame, kind: str, key: str, content: str) -> DataFrame:
    """key and the units of each document's content. A document that can't be parsed gives one unit of type "error"."""
    parser = PARSERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field(key).type
            keys: list = []
            rows: list[dict] = []
            for k, c in zip(batch.column(key).to_pylist(), batch.column(content).to_pylist(), strict=True):
                if c is None:
                    continue
                try:
                    found = parser(c)
                except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, StopIteration) as e:
                    only = Units()
                    only.add(None, "error", text=f"{type(e).__name__}: {e}")
                    found = only.rows
                keys.extend([k] * len(found))
                rows.extend(found)
                if len(rows) >= BATCH:
                    yield _batch(key, of, keys, rows)
                    keys, rows = [], []
            if rows:
                yield _batch(key, of, keys, rows)

    return docs.select(key, content).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, {UNITS}")
