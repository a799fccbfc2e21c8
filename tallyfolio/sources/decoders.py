"""Bytes to text: plain text in the JVM, other formats through small Arrow-batched decoders."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfolio.slices import column_slices
from tallyfolio.sources.decode_helper import DecodeLimits, Decoder, Helper

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _run_text(run: ElementTree.Element) -> str:
    text = []
    for child in run:
        if child.tag == _W + "t":
            text.append(child.text or "")
        elif child.tag in (_W + "tab", _W + "ptab"):
            text.append("\t")
        elif child.tag == _W + "cr" or (child.tag == _W + "br"
                                        and child.get(_W + "type") in (None, "textWrapping")):
            text.append("\n")
        elif child.tag == _W + "noBreakHyphen":
            text.append("-")
    return "".join(text)


def decode_docx(data: bytes) -> str:
    """Body paragraphs in order, one per line; tables, headers and footers are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(_W + "body")
    lines = []
    for paragraph in body.findall(_W + "p"):
        runs = []
        for child in paragraph:
            if child.tag == _W + "r":
                runs.append(_run_text(child))
            elif child.tag == _W + "hyperlink":
                runs += [_run_text(run) for run in child.findall(_W + "r")]
        lines.append("".join(runs))
    return "\n".join(lines)


def default_decoders() -> dict[str, Decoder]:
    """Decoders of this package, the same wherever it runs; add your own for ``pdf``, ``doc`` or other formats."""
    return {"docx": decode_docx}


def decode_text(content: Column) -> Column:
    """Strict UTF-8; NULL for invalid bytes. Stays in the JVM."""
    return F.try_validate_utf8(content.cast("string"))


def decode_with(route: Column, content: Column, decoders: Mapping[str, Decoder], limits: DecodeLimits = DecodeLimits()) -> Column:
    """``struct<text, error>`` by the decoder of the route; NULL fields for routes without one.

    Contents of other routes are replaced by NULL before they would cross to Python. Decoders run in a helper process of
    their task: a file that is beyond the limits or ends the process has an error, and the others go on. A task holds a slice of
    the contents and texts, and its helper begins before there are any, so that it keeps none of them.
    """
    table = dict(decoders)

    def decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        helper = Helper(table, limits)
        try:
            helper.start()
            for routes, contents in column_slices(batches):
                answers = [(None, None) if data is None else helper.decode(name, data) for name, data in zip(routes, contents)]
                columns = [pa.array([answer[k] for answer in answers], pa.string()) for k in (0, 1)]
                yield pa.StructArray.from_arrays(columns, names=["text", "error"])
        finally:
            helper.close()

    if not table:
        return F.lit(None).cast("struct<text:string,error:string>")
    udf = F.arrow_udf(decode, "text string, error string")
    return udf(route, F.when(route.isin(list(table)), content))
