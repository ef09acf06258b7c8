"""Small workbooks and text documents as bytes, for tests and round trips."""

from __future__ import annotations

from xml.sax.saxutils import escape

from .ooxml import Box, letters
from .routing import as_zip

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _cell(r: int, c: int, v: object) -> str:
    ref = f"{letters(c)}{r + 1}"
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _sheet(cells: dict[tuple[int, int], object], merged: list[Box]) -> bytes:
    rows: dict[int, list[str]] = {}
    for (r, c), v in sorted(cells.items()):
        if v is not None:
            rows.setdefault(r, []).append(_cell(r, c, v))
    body = "".join(f'<row r="{r + 1}">{"".join(x)}</row>' for r, x in rows.items())
    spans = "".join(f'<mergeCell ref="{letters(c0)}{r0 + 1}:{letters(c1)}{r1 + 1}"/>' for r0, c0, r1, c1 in merged)
    return f'<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData>{f"<mergeCells>{spans}</mergeCells>" if spans else ""}</worksheet>'.encode()


def workbook(content: dict[str, tuple[dict[tuple[int, int], object], list[Box]]]) -> bytes:
    """name -> (cells, merged ranges)."""
    names = list(content)
    parts = {f"xl/worksheets/sheet{i}.xml": _sheet(*content[n]) for i, n in enumerate(names)}
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="r{i}"/>' for i, n in enumerate(names))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{SHEET}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>'.encode()
    targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(names)))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PACKAGE}">{targets}</Relationships>'.encode()
    return as_zip(parts)


def document(table: list[list[str]], paragraphs: list[str]) -> bytes:
    def p(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if rows else "")
    return as_zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'.encode()})
