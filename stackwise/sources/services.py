"""Records from web services: OAI-PMH, SRU and library systems over HTTP(S).

Addresses are fetched by the executors, one row each; an OAI harvest follows its tokens, of which
each page holds the next, on one of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import expr as E
from .readers import records_of_text

_TOKEN = re.compile(r"<(?:[A-Za-z_][\w.-]*:)?resumptionToken[^>]*>([^<]*)")


def _get(url: str, headers: dict | None = None, timeout: int = 60) -> bytes:
    with urlopen(Request(url, headers=headers or {}), timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def fetch(spark: SparkSession, urls: list[str], headers: dict | None = None) -> DataFrame:
    """(file, content) of addresses."""
    return spark.createDataFrame([(u,) for u in urls], "file string").repartition(max(1, len(urls))).mapInArrow(_fetcher(headers), "file string, content binary")


def _fetcher(headers: dict | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([_get(url, headers)], pa.binary())], names=["file", "content"])

    return work


def read_urls(spark: SparkSession, urls: str | list[str], fmt: str = "marcxml", tags: str | None = None, headers: dict | None = None) -> DataFrame:
    return records_of_text(fetch(spark, [urls] if isinstance(urls, str) else urls, headers), fmt, tags)


def _option(name: str, value: str | None, first: str = "&") -> str:
    return "" if value is None else f"{first}{name}={quote(value, safe='~')}"


def read_sru(spark: SparkSession, base: str, query: str, max_records: int = 50) -> DataFrame:
    return read_urls(spark, f"{base}?version=1.1&operation=searchRetrieve&recordSchema=marcxml&maximumRecords={max_records}{_option('query', query)}")


def oai_pages(first: str, base: str, most: int | None = None) -> Iterator[tuple[str, bytes]]:
    url, n = first, 0
    while url and (most is None or n < most):
        content = _get(url)
        yield url, content
        n += 1
        token = _TOKEN.search(content.decode("utf-8", "replace"))
        token = token[1].strip() if token else ""
        url = f"{base}?verb=ListRecords{_option('resumptionToken', token)}" if token else None


def read_oai(spark: SparkSession, base: str, metadata_prefix: str = "marc21", set_: str | None = None, from_: str | None = None, until: str | None = None, pages: int | None = 1) -> DataFrame:
    """Records of a ListRecords answer; ``pages=None`` follows the tokens to the end."""
    first = f"{base}?verb=ListRecords&metadataPrefix={metadata_prefix}{_option('set', set_)}{_option('from', from_)}{_option('until', until)}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column(0).to_pylist():
                for url, content in oai_pages(start, base, pages):
                    yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([content], pa.binary())], names=["file", "content"])

    return records_of_text(spark.createDataFrame([(first,)], "file string").mapInArrow(work, "file string, content binary"), "marcxml")


def read_oai_page(spark: SparkSession, base: str, token: str) -> DataFrame:
    return read_urls(spark, f"{base}?verb=ListRecords{_option('resumptionToken', token)}")


def oai_token(spark: SparkSession, url: str) -> DataFrame:
    """(token, complete_list_size, cursor, expiration_date) of one answer."""
    xml = fetch(spark, [url]).selectExpr("decode(content, 'UTF-8') AS xml")
    size, cursor, until = (E.oai_token_attribute("xml", n) for n in ("completeListSize", "cursor", "expirationDate"))
    return xml.selectExpr(f"{E.oai_extract_token('xml')} AS token", f"try_cast({size} AS bigint) AS complete_list_size", f"try_cast({cursor} AS bigint) AS cursor", f"{until} AS expiration_date")


#: Record addresses of library systems, with the format of their answers.
ADDRESSES = {
    "alma": ("{base}/almaws/v1/bibs/{id}", "marcxml"),
    "alma_bibs": ("{base}/almaws/v1/bibs?view=full&expand=None&mms_id={id}", "marcxml"),
    "koha": ("{base}/api/v1/biblios/{id}", "marcxml"),
    "koha_public": ("{base}/api/v1/public/biblios/{id}", "marcxml"),
    "koha_opac": ("{base}/cgi-bin/koha/opac-export.pl?op=export&format=marcxml&bib={id}", "marcxml"),
    "worldshare": ("{base}/worldcat/manage/bibs/{id}", "marcxml"),
    "folio_srs": ("{base}/source-storage/records/{id}/formatted?idType=INSTANCE", "marcjson"),
    "folio_record": ("{base}/source-storage/records/{id}", "marcjson"),
    "folio_source_records": ("{base}/source-storage/source-records?limit={limit}&offset={offset}", "marcjson"),
}


def read_system(spark: SparkSession, system: str, base: str, id: str = "", apikey: str | None = None, **more) -> DataFrame:
    """A record (or page of records) of a library system in ``ADDRESSES``."""
    pattern, fmt = ADDRESSES[system]
    url = pattern.format(base=base, id=id, **more)
    return read_urls(spark, url + _option("apikey", apikey, "&" if "?" in url else "?"), fmt)


def read_alma_sru(spark: SparkSession, base: str, institution: str, query: str, max_records: int = 50) -> DataFrame:
    return read_sru(spark, f"{base}/view/sru/{institution}", query, max_records)


def put_record(url: str, body: str, headers: dict, confirm: bool = False) -> tuple[int, str, str]:
    """Writes one record back (status, content type, body); does so only with ``confirm``."""
    if not confirm:
        raise ValueError("confirm=True is needed to change a record")
    request = Request(url, body.encode(), headers | {"Content-Type": "application/xml"}, method="PUT")
    with urlopen(request, timeout=60) as answer:  # noqa: S310
        return answer.status, answer.headers.get("Content-Type", ""), answer.read().decode("utf-8", "replace")
