"""SQL names for the engine: scalar functions as expressions, and table functions to use with LATERAL."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from foliospark import errors as E
from foliospark.operators import docx, pptx, xlsx
from foliospark.sources import package as P
from foliospark.sources.archive import Archive

SCALARS = (
    # A letter a place; seven places are enough for any column.
    "xl_column_name(i BIGINT) RETURNS STRING RETURN concat("
    + ", ".join(f"if(i >= {first}, char(65 + pmod((i - {first}) div {26**k}, 26)), '')" for k, first in reversed([(k, sum(26**j for j in range(1, k + 1))) for k in range(7)]))
    + ")",
    "csv_quote(v STRING, delimiter STRING) RETURNS STRING RETURN CASE WHEN contains(v, delimiter) OR contains(v, '\"') OR contains(v, char(10)) OR contains(v, char(13)) THEN concat('\"', replace(v, '\"', '\"\"'), '\"') ELSE v END",
    "sheet_slug(name STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-'), '^-|-$', ''), ''), 'sheet')",
)


def _open(content) -> Archive:
    return Archive(bytes(content or b""))


@udtf(returnType="ordinal int, part_type string, part_path string, text string, error string")
class OoxmlBlocks:
    """Text blocks of a document or presentation; a failure is a row with its code."""

    def eval(self, path: str, content: bytes):
        try:
            archive = _open(content)
            kind = P.type_for(P.document_type(archive), path or "")
            if kind == "xlsx":
                raise E.EngineError(E.ARGUMENT, "invalid argument: text extraction takes DOCX and PPTX")
            for i, (part_type, part, text) in enumerate((docx if kind == "docx" else pptx).blocks(archive)[0], 1):
                yield i, part_type, part, text, None
        except Exception as e:
            yield None, None, None, None, getattr(e, "code", E.IO)


@udtf(returnType="row_ord bigint, row_index bigint, column_index int, kind string, raw string, value string, error string")
class XlsxCells:
    """Cells of the sheet with a number, or of the first."""

    def eval(self, content: bytes, sheet_index: Row = None):
        try:
            opened = xlsx.open_workbook(_open(content), False)
            _, own = xlsx.select(opened.book.sheets, None, sheet_index, False)
            reader, data = xlsx.sheet_reader(opened, own)
            for n, (index, cells) in enumerate(reader.rows(data)):
                for column, c in cells.items():
                    yield n, index, column, c.kind, c.raw, c.value, None
        except Exception as e:
            yield None, None, None, None, None, None, getattr(e, "code", E.IO)


def register(spark: SparkSession) -> None:
    for s in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}")
    spark.udtf.register("ooxml_blocks", OoxmlBlocks)
    spark.udtf.register("xlsx_cells", XlsxCells)
