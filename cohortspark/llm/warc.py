"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Each derivative refers to the record it was made from, repeats that record's target, date and payload digest,
and carries a digest of its own block. Record ids follow from the source record, so a second run gives the same.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import sliced, table

DATE = "2024-01-01T00:00:00Z"
LINE = "\r\n"
# Elements whose content is no text, and elements that end a line.
HIDDEN = ("head", "script", "style", "noscript", "template")
BLOCKS = "br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr|/?table|/?article|/?section|/?nav|/?footer|/?header|/?body|/?html|/?blockquote|/?pre"

_DROPPED = [re.compile(r"(?s)<!--.*?(-->|\Z)")] + [re.compile(rf"(?is)<{tag}\b.*?(</{tag}[ \t\n\r\f\v]*>|\Z)") for tag in HIDDEN]
_BREAK = re.compile(rf"(?i)<({BLOCKS})\b[^>]*(>|\Z)")
_TAG = re.compile(r"</?[A-Za-z!][^>]*(>|\Z)")
_SPACES, _LINES = re.compile(r"[ \t\r\f\v]+"), re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title")
_LANGUAGE = re.compile(r"(?is)<html\b[^>]*\blang=\"([^\"]*)\"")
_CHARSET = re.compile(r"(?is)<meta\b[^>]*\bcharset=\"?([A-Za-z0-9_-]+)")
_LINK = re.compile(r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"")


def plain_text(page: str) -> str:
    """The text of an HTML page, a line for each block."""
    for pattern in _DROPPED:
        page = pattern.sub("", page)
    page = html.unescape(_TAG.sub("", _BREAK.sub("\n", page)))
    return _LINES.sub("\n", _SPACES.sub(" ", page)).strip(" \n")


def fields(page: str) -> list[tuple[str, str]]:
    """What the metadata record says of a page: title, language, charset, links out."""
    found = [(name, m.group(1)) for name, m in (("title", _TITLE.search(page)), ("language", _LANGUAGE.search(page)), ("charset", _CHARSET.search(page))) if m]
    found += [("outlink", link) for link in _LINK.findall(page)]
    return [(name, _LINES.sub(" ", _SPACES.sub(" ", html.unescape(value))).strip(" \n")) for name, value in found]


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def record_id(kind: str, source: str) -> str:
    h = hashlib.md5(f"{kind}\n{source}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html): ids, target, headers, payload and its digest.

    Null values are empty. Repeated rows give repeated records.
    """
    empty = F.lit("")
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.coalesce(F.col("url").cast("string"), empty).alias("target_uri"), F.coalesce(F.col("html").cast("string"), empty).alias("payload"))
    return rows.select(
        "page_id", _uuid(F.concat(F.lit("response\n"), F.coalesce("page_id", empty), F.lit("\n"), "target_uri")).alias("record_id"), "target_uri",
        F.lit(date).alias("date"), F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n\r\n")).alias("headers"),
        "payload", F.concat(F.lit("sha256:"), F.sha2("payload", 256)).alias("payload_digest"),
    )


RECORD = "page_id string, type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, source_headers string, block string"
RECORD_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in RECORD.split(", ")])


def derive(records: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (application/warc-fields) and ``conversion`` (text/plain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, payloads in sliced(batches, "payload"):
            rows = []
            for source, payload in zip(part.drop_columns(["payload"]).to_pylist(), payloads, strict=True):
                page = payload.decode()
                named = fields(page)
                described = [*named, ("outlinks", str(sum(n == "outlink" for n, _ in named)))]
                for kind, content, block in (
                    ("metadata", "application/warc-fields", "".join(f"{n}: {v}{LINE}" for n, v in described)),
                    ("conversion", "text/plain; charset=utf-8", plain_text(page)),
                ):
                    raw = block.encode()
                    rows.append((source["page_id"], kind, record_id(kind, source["record_id"]), source["record_id"], source["target_uri"], source["date"], content, len(raw), digest(raw), source["payload_digest"], source["headers"], block))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), RECORD_ARROW, strict=True)], schema=RECORD_ARROW)

    return records.select("page_id", "record_id", "target_uri", "date", "headers", "payload_digest", "payload").mapInArrow(run, RECORD)


def record_text(records: DataFrame) -> Column:
    """A derivative as it stands in a WARC file: named headers, an empty line, the block, two line ends."""
    named = [
        ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    lines = [F.concat(F.lit(f"{name}: "), records[column].cast("string"), F.lit(LINE)) for name, column in named]
    return F.concat(F.lit(f"WARC/1.1{LINE}"), *lines, F.lit(LINE), records["block"], F.lit(2 * LINE))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(responses(table(spark, sf_dir, "pages")))
    return found.withColumn("page_id", F.col("page_id").cast("long")).withColumn("record_digest", F.sha2(record_text(found), 256))


OP3_SQL = rf"""
with pages_ as (
  select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload,
    md5('response' || chr(10) || cast(page_id as varchar) || chr(10) || coalesce(url, '')) as h
  from pages
),
source as (
  select *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' as source_id
  from pages_
),
shown as (
  select *, regexp_replace(payload, '<!--.*?(-->|\z)', '', 'gs') as p0 from source
),
hidden as (
  select *, {{hidden}} as p1 from shown
),
texts as (
  select *, regexp_replace(regexp_replace(p1, '<({BLOCKS})\b[^>]*(>|\z)', chr(10), 'gi'), '</?[A-Za-z!][^>]*(>|\z)', '', 'g') as p2,
    [case when regexp_matches(payload, '<title\b[^>]*>.*?</title', 'is') then ['title', regexp_extract(payload, '<title\b[^>]*>(.*?)</title', 1, 'is')] end,
     case when regexp_matches(payload, '<html\b[^>]*\blang="[^"]*"', 'is') then ['language', regexp_extract(payload, '<html\b[^>]*\blang="([^"]*)"', 1, 'is')] end,
     case when regexp_matches(payload, '<meta\b[^>]*\bcharset="?[A-Za-z0-9_-]+', 'is') then ['charset', regexp_extract(payload, '<meta\b[^>]*\bcharset="?([A-Za-z0-9_-]+)', 1, 'is')] end] as named,
    regexp_extract_all(payload, '<a\b[^>]*\bhref="([^"]*)"', 1, 'is') as links
  from hidden
),
both_ as (
  select *, unnest(['metadata', 'conversion']) as type,
    list_concat(list_filter(named, lambda x: x is not null), list_transform(links, lambda x: ['outlink', x])) as listed
  from texts
),
blocks as (
  select *, case type when 'conversion' then {{text}}
    else array_to_string(list_transform(listed, lambda x: x[1] || ': ' || {{value}} || chr(13) || chr(10)), '')
      || 'outlinks: ' || len(links) || chr(13) || chr(10) end as block
  from both_
),
made as (
  select *, md5(type || chr(10) || source_id) as m, strlen(block) as content_length, 'sha256:' || sha256(block) as block_digest,
    'sha256:' || sha256(payload) as source_payload_digest,
    case type when 'metadata' then 'application/warc-fields' else 'text/plain; charset=utf-8' end as content_type
  from blocks
),
ids as (
  select *, '<urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' as record_id from made
)
select page_id, type, record_id, source_id as refers_to, target_uri, '{DATE}' as date, content_type, content_length, block_digest,
  source_payload_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) || chr(13) || chr(10) as source_headers, block,
  sha256('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || type || chr(13) || chr(10) || 'WARC-Record-ID: ' || record_id || chr(13) || chr(10)
    || 'WARC-Refers-To: ' || source_id || chr(13) || chr(10) || 'WARC-Target-URI: ' || target_uri || chr(13) || chr(10)
    || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Block-Digest: ' || block_digest || chr(13) || chr(10)
    || 'WARC-Source-Payload-Digest: ' || source_payload_digest || chr(13) || chr(10) || 'Content-Type: ' || content_type || chr(13) || chr(10)
    || 'Content-Length: ' || content_length || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10)) as record_digest
from ids"""


def _hidden_sql() -> str:
    text = "p0"
    for tag in HIDDEN:
        text = rf"regexp_replace({text}, '<{tag}\b.*?(</{tag}[ \t\n\r\f\v]*>|\z)', '', 'gis')"
    return text


def _unescaped_sql(text: str) -> str:
    """The character references that occur in the tables, also without the closing sign; the ampersand last."""
    for name, code in (("copy", 169), ("middot", 183), ("quot", 34), ("lt", 60), ("gt", 62), ("amp", 38)):
        text = f"regexp_replace({text}, '&{name};?', chr({code}), 'g')"
    return text


def _squeezed_sql(text: str, line: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n[ \n]*', {line}, 'g'), ' ' || chr(10))"


OP3_SQL = OP3_SQL.replace("{hidden}", _hidden_sql()).replace("{text}", _squeezed_sql(_unescaped_sql("p2"), "chr(10)")).replace("{value}", _squeezed_sql(_unescaped_sql("x[2]"), "' '"))
