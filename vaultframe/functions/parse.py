"""Documents to facts: one Arrow pass reads each text once and gives everything; the fact tables are explodes of its columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.functions import frontmatter, markdown
from vaultframe.session import spread

SPAN = "span_line:int,span_column:int,span_offset:bigint"
HEADING = f"ordinal:int,text:string,slug:string,level:int,{SPAN},body_offset:bigint,inside_container:boolean"
LINK = f"ordinal:int,family:string,embed:boolean,protocol:string,target:string,title:string,anchor:string,block_ref:string,{SPAN}"
TAG = f"ordinal:int,name:string,source:string,{SPAN}"
BLOCK = f"ordinal:int,block_id:string,{SPAN}"
PARSED = (
    "status string, body_offset bigint, body string, frontmatter string, frontmatter_diagnostic_count int, "
    f"headings array<struct<{HEADING}>>, links array<struct<{LINK}>>, tags array<struct<{TAG}>>, blocks array<struct<{BLOCK}>>"
)
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(spec: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _TYPES[t]) for n, t in (f.split(":") for f in spec.split(","))]))


def parse_text(text: str) -> tuple:
    """(status, body_offset, body, frontmatter, diagnostics, headings, links, tags, blocks) of one document."""
    block = frontmatter.read(text)
    body = text[block.body_start :]
    facts = markdown.Body(body)
    links, tags = [], []
    spans = markdown.Spans(text) if block.strings else None
    for field, value, start, stop, _ in block.strings:
        at = text[start:stop].find(value) if value else -1
        if at >= 0:  # only where the source carries the value literally
            for offset, link in markdown.wikilinks_in(value):
                line, column, byte = spans.at(start + at + offset)
                links.append({**link, "span_line": line, "span_column": column, "span_offset": byte})
        if field == "tags" and (name := markdown.whole_tag(value)):
            tags.append({"name": name, "source": "frontmatter", "span_line": None, "span_column": None, "span_offset": None})
    return (
        block.status,
        len(text[: block.body_start].encode("utf-8", "surrogatepass")),
        body,
        None if block.value is None else frontmatter.canonical(block.value),
        block.diagnostics,
        facts.headings,
        [{**x, "ordinal": i} for i, x in enumerate(links + facts.links)],
        [{**x, "ordinal": i} for i, x in enumerate(tags + facts.tags)],
        facts.blocks,
    )


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, body_offset, body, frontmatter, ..., headings, links, tags, blocks). A null text gives nulls and no facts; an empty
    one an empty body. Narrow: no shuffle. Each text is read whole and once."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), *map(_arrow, (HEADING, LINK, TAG, BLOCK))]
    names = [c.strip().split(" ")[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, texts = 0, 0, batch.column(1).to_pylist()
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 4_000_000:
                    rows = [(None,) * 9 if t is None else parse_text(t) for t in texts[start:i]]
                    if rows:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, i - start), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(9))], names=[key, *names])
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {PARSED}")


def facts(parsed: DataFrame, key: str, name: str) -> DataFrame:
    """One of the fact tables: headings, links, tags or blocks, a row a fact."""
    return parsed.select(F.col(key).alias("document"), F.explode(name).alias("f")).select("document", "f.*")


def block_ids(df: DataFrame, key: str, text: str) -> DataFrame:
    """(document, ordinal, block_id, spans): the block ids of texts. Only texts with a line that ends like one are parsed."""
    may = df.filter(F.col(text).rlike(r"(?m)(^|\s)\^[A-Za-z0-9_-]+\s*$"))
    return facts(parse(may, key, text), key, "blocks")
