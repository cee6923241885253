"""Tables of registrations and names: CSV with quotes, rows to paste, and what is pasted back."""

from __future__ import annotations

from pathlib import Path

COLUMNS = ("item", "status", "method", "rms", "overlap", "distance", "stopped", "references")


def quoted(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def registration_csv(rows: list[dict]) -> str:
    """With a byte-order mark, so that spreadsheets read it as UTF-8."""
    lines = [",".join(COLUMNS)] + [",".join(quoted(r.get(c)) for c in COLUMNS) for r in rows]
    return "﻿" + "\r\n".join(lines) + "\r\n"


def write_csv(path: str, rows: list[dict]) -> None:
    Path(path).write_text(registration_csv(rows), encoding="utf-8", newline="")


def name_rows(names: list[tuple[str, str]]) -> str:
    """Identity and name of each item, by tabs."""
    return "\n".join(["item\tname", *(f"{i}\t{n}" for i, n in names)])


def pasted_names(text: str, header: str = "name") -> list[str]:
    """The last column of pasted rows, less a header and empty rows."""
    cells = [line.split("\t")[-1].strip() for line in text.splitlines() if line.strip()]
    return cells[1:] if cells and cells[0].lower() == header else cells
