"""Report artifacts. Rows are written by the executors; only bounded summaries reach the driver."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, functions as F

MAX_SUMMARY_ROWS = 10_000


def small_rows(df: DataFrame, limit: int = MAX_SUMMARY_ROWS) -> list[dict]:
    """Collect a summary, refusing anything that is not summary-sized."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write them with the executors instead")
    return [r.asDict(recursive=True) for r in rows]


def write_rows(rows: DataFrame, path: str, fmt: str = "json") -> None:
    """Report rows as a distributed JSON or CSV folder; list columns are joined by ``;`` in CSV."""
    if fmt not in ("json", "csv"):
        raise ValueError("rows are written as json or csv")
    if fmt == "csv":
        arrays = [f.name for f in rows.schema.fields if f.dataType.typeName() == "array"]
        for name in arrays:
            rows = rows.withColumn(name, F.array_join(name, ";"))
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)


def counts_of(counts: list[dict], dimension: str) -> dict[str, int]:
    return dict(sorted((c["value"], c["files"]) for c in counts if c["dimension"] == dimension))


def summary_payload(summary: DataFrame, counts: DataFrame, generated_at: str) -> dict:
    grouped = small_rows(counts)
    dims = ("extension", "theme", "action", "source", "flag")
    return {
        "status": "ok",
        "generated_at": generated_at,
        "summary": {**small_rows(summary)[0], **{f"{d}_counts": counts_of(grouped, d) for d in dims}},
    }


def markdown(payload: dict) -> str:
    s = payload["summary"]
    lines = ["# Corpus report", "", f"- Generated: {payload['generated_at']}"]
    lines += [f"- {k.replace('_', ' ')}: {v}" for k, v in s.items() if not isinstance(v, dict)]
    for key, values in s.items():
        if isinstance(values, dict):
            lines += ["", f"## {key.replace('_', ' ')}", "", "| Value | Files |", "| --- | ---: |"]
            lines += [f"| {k} | {v} |" for k, v in values.items()]
    return "\n".join(lines) + "\n"


def column_name(index: int) -> str:
    """0 -> A, 25 -> Z, 26 -> AA."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def _sheet_xml(rows: list[list]) -> str:
    def cell(r: int, c: int, v) -> str:
        ref = f"{column_name(c)}{r}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    columns = max((len(r) for r in rows), default=1)
    widths = [min(60, max(10, *(len(str(r[c])) + 2 for r in rows if c < len(r)))) for c in range(columns)]
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, start=1))
    body = "".join(
        f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(values)) + "</row>"
        for r, values in enumerate(rows, start=1)
    )
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    return f'<worksheet xmlns="{ns}"><cols>{cols}</cols><sheetData>{body}</sheetData></worksheet>'


def write_xlsx(sheets: dict[str, list[list]], path: str) -> None:
    """A minimal workbook of summary sheets (name -> rows)."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    names = list(sheets)
    listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    links = "".join(
        f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)
    )
    sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    overrides = "".join(
        f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for i in range(1, len(names) + 1)
    )
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/>{overrides}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, name in enumerate(names, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(sheets[name]))


def report_workbook(payload: dict, path: str) -> None:
    s = payload["summary"]
    sheets = {"Summary": [["metric", "value"], *[[k, v] for k, v in s.items() if not isinstance(v, dict)]]}
    for key, values in s.items():
        if isinstance(values, dict):
            sheets[key] = [["value", "files"], *map(list, values.items())]
    write_xlsx(sheets, path)


def save_baseline(totals: DataFrame, per_query: DataFrame, path: str) -> None:
    """Evaluation totals and per-query metrics as two distributed JSON folders."""
    totals.write.mode("overwrite").json(f"{path}/totals")
    per_query.write.mode("overwrite").json(f"{path}/per_query")


def load_baseline(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/totals"), spark.read.json(f"{path}/per_query")


def write_json_file(payload: dict, path: str) -> None:
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2), encoding="utf-8")
