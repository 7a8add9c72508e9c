"""Turn the bytes of one file into text and metadata (small helpers used inside tasks)."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

IMAGE_EXTENSIONS = frozenset({".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp"})
# Encodings tried in order, and OpenXML namespaces.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DC = "{http://purl.org/dc/elements/1.1/}"

Ocr = Callable[[bytes, str], str]


class LoadError(Exception):
    """A file could not be turned into text."""


def decode_text(data: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return data.decode(encoding).removeprefix("﻿").strip()
        except UnicodeDecodeError:
            continue
    raise LoadError("codificação desconhecida")


def json_text(data: bytes) -> str:
    raw = data.decode("utf-8-sig").strip()
    if not raw:
        raise LoadError("Arquivo JSON vazio")
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, indent=2, sort_keys=True)
    except json.JSONDecodeError as exc:
        raise LoadError(f"JSON inválido: {exc}") from exc


def flatten_json(value, prefix: str = "") -> list[str]:
    """Leaves of a JSON value as ``path: value`` lines, in document order."""
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in flatten_json(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [line for i, v in enumerate(value) for line in flatten_json(v, f"{prefix}[{i}]")]
    shown = json.dumps(value, ensure_ascii=False)
    return [f"{prefix}: {shown}" if prefix else shown]


def core_properties(archive: zipfile.ZipFile) -> dict:
    if "docProps/core.xml" not in archive.namelist():
        return {}
    root = ElementTree.fromstring(archive.read("docProps/core.xml"))
    found = {"title": root.findtext(f"{DC}title"), "author": root.findtext(f"{DC}creator")}
    return {k: v.strip() for k, v in found.items() if v and v.strip()}


def docx_text(data: bytes) -> tuple[str, dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if "word/document.xml" not in archive.namelist():
                raise LoadError("DOCX sem conteudo principal")
            body = ElementTree.fromstring(archive.read("word/document.xml"))
            meta = core_properties(archive)
    except zipfile.BadZipFile as exc:
        raise LoadError(f"Falha ao abrir DOCX: {exc}") from exc
    texts = ["".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in body.iter(f"{WORD}p")]
    text = "\n\n".join(t for t in texts if t)
    if not text:
        raise LoadError("DOCX sem texto extraivel")
    return text, {**meta, "source_kind": "docx"}


def xlsx_text(data: bytes) -> tuple[str, dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = set(archive.namelist())
            read = lambda name: ElementTree.fromstring(archive.read(name))
            shared = []
            if "xl/sharedStrings.xml" in names:
                strings = read("xl/sharedStrings.xml").iter(f"{SHEET}si")
                shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in strings]
            targets = {r.get("Id"): r.get("Target", "").lstrip("/") for r in read("xl/_rels/workbook.xml.rels")}
            lines, sheets = [], []
            for sheet in read("xl/workbook.xml").iter(f"{SHEET}sheet"):
                target = targets.get(sheet.get(REL_ID), "")
                part = target if target.startswith("xl/") else f"xl/{target}"
                if not target or part not in names:
                    continue
                rows = [row for row in (sheet_row(r, shared) for r in read(part).iter(f"{SHEET}row")) if row]
                if rows:
                    sheets.append(sheet.get("name", "Sheet"))
                    lines += [f"[Sheet: {sheets[-1]}]", *rows]
            meta = core_properties(archive)
    except (KeyError, zipfile.BadZipFile) as exc:
        raise LoadError(f"Falha ao abrir XLSX: {exc}") from exc
    if not lines:
        raise LoadError("XLSX sem texto extraivel")
    return "\n".join(lines), {**meta, "source_kind": "xlsx", "sheet_names": sheets, "sheet_count": len(sheets)}


def sheet_row(row, shared: list[str]) -> str:
    values = []
    for cell in row.iter(f"{SHEET}c"):
        kind, raw = cell.get("t"), cell.findtext(f"{SHEET}v") or ""
        if kind == "s" and raw.isdigit() and int(raw) < len(shared):
            raw = shared[int(raw)]
        elif kind == "inlineStr":
            raw = "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
        values.append(raw.strip())
    return "\t".join(v for v in values if v)


def pdf_text(data: bytes, ocr: Ocr | None) -> tuple[str, dict]:
    try:
        from pypdf import PdfReader
    except ImportError as exc:
        raise LoadError("suporte a PDF indisponivel") from exc
    reader = PdfReader(io.BytesIO(data))
    pages = [(n, (p.extract_text() or "").strip()) for n, p in enumerate(reader.pages, start=1)]
    text = "\n\n".join(f"[Pagina {n}]\n{t}" for n, t in pages if t)
    meta = {"page_count": len(pages), "source_kind": "pdf"}
    info = reader.metadata or {}
    meta.update({k: str(v).strip() for k, v in (("title", info.get("/Title")), ("author", info.get("/Author"))) if v})
    if text:
        return text, meta
    if ocr is None:
        raise LoadError("PDF sem texto extraivel")
    text = ocr(data, ".pdf").strip()
    if not text:
        raise LoadError("OCR executado mas nao produziu texto para o PDF")
    return text, {**meta, "ocr_applied": True}


def image_text(data: bytes, extension: str, ocr: Ocr | None) -> tuple[str, dict]:
    if ocr is None:
        raise LoadError("Imagem requer OCR")
    text = ocr(data, extension).strip()
    if not text:
        raise LoadError("OCR executado mas nao produziu texto para a imagem")
    return text, {"ocr_applied": True, "source_kind": "image"}


def extract(data: bytes, extension: str, ocr: Ocr | None = None) -> tuple[str, dict]:
    """Text and metadata of one file, chosen by its extension."""
    if extension in (".txt", ".md", ".csv"):
        return decode_text(data), {}
    if extension == ".json":
        return json_text(data), {}
    if extension == ".docx":
        return docx_text(data)
    if extension == ".xlsx":
        return xlsx_text(data)
    if extension == ".pdf":
        return pdf_text(data, ocr)
    if extension in IMAGE_EXTENSIONS:
        return image_text(data, extension, ocr)
    raise LoadError(f"Extensão não suportada: {extension}")
