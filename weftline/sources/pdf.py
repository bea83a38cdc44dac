"""Texts of PDF files, by whichever library the executors have; without one every row says so."""

from __future__ import annotations

import importlib.util
import io

import pyarrow as pa
from pyspark.sql import DataFrame

from weftline import ship
from weftline.sources.tables import pdf_metadata

LIBRARIES = ("pypdf", "PyPDF2")
SCHEMA = "path string, text string, pages int, metadata map<string,string>, success boolean, error string"


def available() -> str | None:
    """The library that would be used here."""
    return next((n for n in LIBRARIES if importlib.util.find_spec(n)), None)


def _read(data: bytes) -> tuple:
    name = available()
    if name is None:
        return None, 0, {}, False, "no PDF library"
    try:
        r = importlib.import_module(name).PdfReader(io.BytesIO(data))
        parts = [p.extract_text() or "" for p in r.pages]
        return "\n\n".join(parts), len(parts), {str(k): None if v is None else str(v) for k, v in (r.metadata or {}).items()}, True, None
    except Exception as e:  # a broken file is a row like others
        return None, 0, {}, False, f"{type(e).__name__}: {e}"


def pdf_texts(files: DataFrame) -> DataFrame:
    """A row of SCHEMA for each of files(path, content), pages' texts joined by blank lines."""
    ship(files.sparkSession)

    def run(batches):
        for r in batches:
            out = [_read(x or b"") for x in r.column("content").to_pylist()]
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([r.column("path"), *[pa.array([list(v.items()) for v in c] if k == kinds[2] else c, k) for c, k in zip(cols, kinds)]], names=["path", "text", "pages", "metadata", "success", "error"])

    d = files.select("path", "content").mapInArrow(run, SCHEMA)
    return d.withColumn("metadata", pdf_metadata(d["metadata"]))
