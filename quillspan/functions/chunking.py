"""Where a text is cut."""

from __future__ import annotations

TARGET, OVERLAP, LEAST_TEXT, FILL = 1200, 150, 100, 0.6
SEPARATORS = ("\n\n", ". ", "\n")


def boundary(text: str, start: int, limit: int = TARGET, least: float = FILL * TARGET) -> int:
    """End of the piece from ``start`` that does not reach the end of the text: after the last blank line, sentence or line end that leaves it more than ``least`` long, else at the limit."""
    for sep in SEPARATORS:
        at = text.rfind(sep, start, start + limit)
        if at - start > least:
            return at + len(sep)
    return start + limit


def chunk_text(text: str | None, limit: int = TARGET, overlap: int = OVERLAP, least_text: int = LEAST_TEXT) -> list[tuple[int, int, str]]:
    """(start, end, stripped text) of the chunks of a page or file; texts of fewer than ``least_text`` stripped characters have none. Offsets are into the stored text."""
    if text is None or len(text.strip()) < least_text:
        return []
    out, start = [], 0
    while start < len(text):
        end = len(text) if len(text) - start <= limit else boundary(text, start, limit, FILL * limit)
        body = text[start:end].strip()
        if body:
            out.append((start, end, body))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out
