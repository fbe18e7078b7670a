"""Reading what PDF files say about themselves: Info map, XMP packet, text of the first page.

Files are read by ``pypdf`` where it is installed, and else by ``plainpdf``. Where a file is damaged or
encrypted the columns are NULL, so that identification goes on with the file name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.sources import plainpdf

try:
    from pypdf import PdfReader
except ImportError:
    PdfReader = None

PAGES = "normalized_path string, info map<string,string>, xmp string, page1_text string"


def read_pdf(path: str) -> dict:
    """Each part by itself: one that fails leaves the others."""
    out = {"normalized_path": path, "info": None, "xmp": None, "page1_text": None}
    try:
        reader = plainpdf.read(path) if PdfReader is None else PdfReader(path)
    except Exception:  # noqa: BLE001  (any damage means nothing can be read)
        return out
    if PdfReader is None:
        parts = {"info": reader.info, "xmp": reader.xmp, "page1_text": reader.page_text}
    else:
        parts = {
            "info": lambda: {str(k): str(v) for k, v in (reader.metadata or {}).items()},
            "xmp": lambda: reader.trailer["/Root"]["/Metadata"].get_data().decode("utf-8", "replace"),
            "page1_text": lambda: reader.pages[0].extract_text(),
        }
    for part, read in parts.items():
        try:
            out[part] = read()
        except Exception:  # noqa: BLE001
            continue
    return out


def read_documents(paths: DataFrame) -> DataFrame:
    """(normalized_path, info, xmp, page1_text) of ``paths`` (normalized_path)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                [read_pdf(p) for p in frame.normalized_path],
                columns=["normalized_path", "info", "xmp", "page1_text"],
            )

    return paths.select("normalized_path").mapInPandas(read, PAGES)
