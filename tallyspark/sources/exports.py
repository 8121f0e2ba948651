"""Files for spreadsheets and importers: rows by preset, exact CSV, workbooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import UTC, date, datetime
from functools import partial
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import format_date, to_date
from ..functions.locales import csv_field, market, plain_amount
from ..functions.text import squeeze

#: Columns, file endings and kinds of the presets.
PRESETS = {
    "csv": ("Date", "Description", "Debit", "Credit", "Amount", "Balance"),
    "xlsx": ("Date", "Description", "Debit", "Credit", "Amount", "Balance", "Notes"),
    "quickbooks": ("Date", "Description", "Amount"),
    "xero": ("*Date", "*Amount", "Payee", "Description", "Reference"),
}
#: Statements that are workbooks in the making at a time.
BOOKS = 16
MIME = {"csv": "text/csv;charset=utf-8", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
EXCEL_DATES = {"YYYY-MM-DD": "yyyy-mm-dd", "DD/MM/YYYY": "dd/mm/yyyy", "MM/DD/YYYY": "mm/dd/yyyy", "DD.MM.YYYY": "dd.mm.yyyy", "DD-MMM-YYYY": "dd-mmm-yyyy"}


def money(cents: Column) -> Column:
    return (cents.cast("decimal(38,0)") / 100).cast("decimal(38,2)")


def preset_row(preset: str, locale: str | None = None, date_format: str | None = None, year: int = 2000) -> Column:
    """K2: an array of a transaction's fields (iso, description, debit_cents, credit_cents, amount_cents, balance_cents, flags). The date
    format is the one given or the market's."""
    m = market(locale)
    day = format_date(F.col("iso"), date_format or m.date_format, year)
    amount = lambda c: plain_amount(money(F.col(c)), m.decimal)
    description = F.coalesce(F.col("description"), F.lit(""))
    fields = {
        "quickbooks": [day, description, amount("amount_cents")],
        "xero": [day, amount("amount_cents"), F.lit(""), description, F.lit("")],
        "csv": [day, description, *[amount(c) for c in ("debit_cents", "credit_cents", "amount_cents", "balance_cents")]],
    }
    fields["xlsx"] = [*fields["csv"], F.array_join("flags", "; ")]
    return F.array(*fields[preset])


def csv_line(fields: Column, delimiter: str) -> Column:
    return F.array_join(F.transform(fields, lambda x: csv_field(x, delimiter)), delimiter)


def csv_files(rows: DataFrame, preset: str = "csv", locale: str | None = None, delimiter: str | None = None, bom: bool = True, newline: str = "\r\n", date_format: str | None = None, year: int = 2000, keys: list[str] = ["doc_id"], order: str = "idx") -> DataFrame:  # noqa: B006
    """K1, K3: one text for each statement, byte for byte, in column `content`, with row_count."""
    d = delimiter or market(locale).delimiter
    head = newline.join([d.join(PRESETS[preset]), ""])
    lines = rows.select(*keys, F.col(order).alias("_at"), csv_line(preset_row(preset, locale, date_format, year), d).alias("_line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_line"))), lambda x: F.concat(x["_line"], F.lit(newline))), "")
    return lines.groupBy(*keys).agg(F.concat(F.lit(("﻿" if bom else "") + head), body).alias("content"), F.count("*").alias("row_count"))


def file_name(source: Column, preset: str) -> Column:
    """K4: the name of an export of a source file."""
    stem = F.regexp_replace(F.coalesce(source, F.lit("bank-statement")), r"(?i)\.(?:pdf|ofx|qfx|csv|txt)$", "")
    stem = F.substring(F.regexp_replace(squeeze(F.regexp_replace(stem, r"[^A-Za-z0-9_.\- ]+", "")), " ", "-"), 1, 60)
    return F.concat(F.when(stem == "", "bank-statement").otherwise(stem), F.lit(f"-transactions.{'xlsx' if preset == 'xlsx' else 'csv'}"))


def balance_delta(keys: list[str] = ["doc_id"], order: str = "idx") -> Column:  # noqa: B006
    """Previous balance + amount - balance, as text; blank where one of the balances is missing."""
    previous = F.lag("balance_cents").over(Window.partitionBy(*keys).orderBy(order))
    off = money(previous + F.col("amount_cents") - F.col("balance_cents"))
    return F.coalesce(off.cast("string"), F.lit(""))


def workbook_rows(rows: DataFrame) -> DataFrame:
    """What the sheets Transactions and Raw show of each row: dates as such, notes without the multi-line flag, row number and delta."""
    return rows.select(
        "doc_id", "idx", to_date(F.col("iso")).alias("day"), "description", money(F.col("debit_cents")).alias("debit"), money(F.col("credit_cents")).alias("credit"),
        money(F.col("amount_cents")).alias("amount"), money(F.col("balance_cents")).alias("balance"), F.array_join(F.filter("flags", lambda f: f != "multiline-description"), "; ").alias("notes"),
        F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")).alias("row_no"), "page", "date_raw", balance_delta().alias("delta"), F.array_join("flags", "; ").alias("flags"), "raw_text",
    )


def _cell(at: str, value, style: int = 0) -> str:
    if value is None or value == "":
        return ""
    s = f' s="{style}"' if style else ""
    if isinstance(value, date):
        return f'<c r="{at}"{s}><v>{(value - date(1899, 12, 30)).days}</v></c>'
    if isinstance(value, str):
        return f'<c r="{at}"{s} t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
    return f'<c r="{at}"{s}><v>{value}</v></c>'


def _sheet(rows: list[list], widths: list[int], styles: list[int], frozen: bool) -> str:
    letters = "ABCDEFGHIJ"
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>' if frozen else ""
    cols = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths))
    body = "".join(f'<row r="{n}">' + "".join(_cell(f"{letters[i]}{n}", v, 1 if n == 1 else styles[i]) for i, v in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{view}<cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def workbook(rows: list, facts: list[tuple[str, object]], date_format: str = "YYYY-MM-DD", made: datetime | None = None) -> bytes:
    """K5, K7: a workbook of one statement from the collected rows of workbook_rows(): sheets Transactions, Summary and Raw."""
    rows = sorted(rows, key=lambda r: r["idx"])
    made = made or datetime.now(UTC)
    first = [list(PRESETS["xlsx"])] + [[r["day"], r["description"], r["debit"], r["credit"], r["amount"], r["balance"], r["notes"]] for r in rows]
    facts = [("Field", "Value"), *facts[:1], ("Generated", made.isoformat()), *facts[1:]]
    raw = [["Row", "Page", "Date as printed", "Balance delta", "Flags", "Source line"]] + [[r["row_no"], r["page"], r["date_raw"] or "", r["delta"], r["flags"], r["raw_text"]] for r in rows]
    sheets = {"Transactions": _sheet(first, [12, 46, 12, 12, 12, 14, 24], [2, 0, 3, 3, 3, 3, 0], True), "Summary": _sheet([list(f) for f in facts], [34, 78], [0, 0], False), "Raw": _sheet(raw, [6, 6, 16, 14, 26, 90], [0] * 6, True)}
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office, package, main = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in (1, 2, 3)) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in (1, 2, 3)) + f'<Relationship Id="rId4" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{head}<styleSheet xmlns="{main}"><numFmts count="2"><numFmt numFmtId="164" formatCode="{EXCEL_DATES.get(date_format, EXCEL_DATES["YYYY-MM-DD"])}"/><numFmt numFmtId="165" formatCode="#,##0.00"/></numFmts><fonts count="2"><font/><font><b/></font></fonts>'
        '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="4"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{i}.xml": text for i, text in enumerate(sheets.values(), 1)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def books(batches: Iterator[pa.RecordBatch], source: str | None, form: str) -> Iterator[pa.RecordBatch]:
    """K5: (doc_id, row_count, bytes) of statements(doc_id, rows). Rows as objects and finished workbooks take many times the room of the batch, so BOOKS statements are held as such at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BOOKS):
            some = batch.slice(at, BOOKS).to_pylist()
            made = [workbook(b["rows"], [("Source file", source or ""), ("Transactions extracted", len(b["rows"]))], form) for b in some]
            yield pa.RecordBatch.from_arrays([pa.array([b["doc_id"] for b in some], pa.int64()), pa.array([len(b["rows"]) for b in some], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "row_count", "bytes"])


def build_exports(rows: DataFrame, preset: str, source: str | None = None, locale: str | None = None, date_format: str | None = None, **options) -> DataFrame:
    """K3: a file for each statement: (doc_id, file_name, mime, row_count, content or bytes). The date format is the one given, or the market's."""
    name, mime = file_name(F.lit(source), preset), F.lit(MIME["xlsx" if preset == "xlsx" else "csv"])
    if preset != "xlsx":
        return csv_files(rows, preset, locale, date_format=date_format, **options).select("doc_id", name.alias("file_name"), mime.alias("mime"), "row_count", "content")
    form = date_format or market(locale).date_format
    # A workbook is made where its statement's rows meet.
    sheets = workbook_rows(rows).groupBy("doc_id").agg(F.collect_list(F.struct("idx", "day", "description", "debit", "credit", "amount", "balance", "notes", "row_no", "page", "date_raw", "delta", "flags", "raw_text")).alias("rows"))

    return sheets.mapInArrow(partial(books, source=source, form=form), "doc_id long, row_count long, bytes binary").select("doc_id", name.alias("file_name"), mime.alias("mime"), "row_count", "bytes")
