"""Several tables as the sheets of one XLSX file, written through Spark's file systems.

Rows become XML in tasks; the driver passes them on, a batch at a time, into the archive, which has a
temporary name until it is whole. A sheet holds ``MOST_ROWS`` rows, a limit of the format.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a sheet with its header, and namespaces of the format.
MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: What XML 1.0 cannot hold.
_CONTROL = {c: None for c in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF]}


class _Stream(io.RawIOBase):
    """A Hadoop output stream as a Python file."""

    def __init__(self, out: object) -> None:
        super().__init__()
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.out.write(bytearray(data))
        return len(data)


def _row(cells: Sequence[str | None]) -> str:
    parts = ["<c/>" if not c else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c.translate(_CONTROL))}</t></is></c>' for c in cells]
    return f"<row>{''.join(parts)}</row>"


def _lines(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``xml``: each row in order; lists, maps and records as JSON, nulls as empty cells."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    rows = df.orderBy(*order) if order else df
    text = rows.select(*[(F.to_json(c) if c in nested else F.col(c).cast("string")).alias(f"c{k}") for k, c in enumerate(df.columns)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"xml": [_row([None if v is None or v != v else v for v in r]) for r in frame.itertuples(index=False, name=None)]})

    return text.mapInPandas(run, "xml string")


def write_workbook(spark: SparkSession, path: str, sheets: Mapping[str, DataFrame], order: Mapping[str, Sequence[str]] | None = None) -> None:
    """Write tables as the sheets of one workbook, each with a header, its rows by the columns that ``order`` names for it.

    The file appears under its name once it is whole; a failure leaves what was there before. A table of more rows than a sheet
    holds is a ValueError.
    """
    jvm, place = spark._jvm.org.apache.hadoop.fs, path.rstrip("/")
    part = f"{place}.{uuid.uuid4().hex}.part"
    final, written = jvm.Path(place), jvm.Path(part)
    system = final.getFileSystem(spark._jsc.hadoopConfiguration())
    names = list(sheets)
    stream = system.create(written, True)
    try:
        with zipfile.ZipFile(io.BufferedWriter(_Stream(stream), 1 << 20), "w", zipfile.ZIP_DEFLATED) as book:
            types = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(names)))
            book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
            book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, n in enumerate(names))
            book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{listed}</sheets></workbook>')
            links = "".join(f'<Relationship Id="rId{k + 1}" Type="{_REL}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names)))
            book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
            for k, name in enumerate(names):
                with book.open(f"xl/worksheets/sheet{k + 1}.xml", "w") as sheet:
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>{_row(sheets[name].columns)}'.encode())
                    rows = 1
                    for line in _lines(sheets[name], (order or {}).get(name, ())).toLocalIterator():  # a partition at a time
                        rows += 1
                        if rows > MOST_ROWS:
                            raise ValueError(f"{name} has more rows than a sheet holds")
                        sheet.write(line["xml"].encode())
                    sheet.write(b"</sheetData></worksheet>")
        stream.close()
    except BaseException:
        stream.close()
        system.delete(written, False)
        raise
    system.delete(final, False)
    if not system.rename(written, final):
        raise OSError(f"{part} could not be renamed to {place}")
