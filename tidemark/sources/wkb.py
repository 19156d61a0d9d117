"""Well-known binary and text: the parts of points, lines and areas, and back.

``parts`` of a geometry are lists of positions: one for a point or a line, one
for each ring of an area, all of them for multiple forms and collections.
"""

from __future__ import annotations

import re
import struct

POINT, LINE, AREA = 1, 2, 3
NAMES = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5, "MULTIPOLYGON": 6, "GEOMETRYCOLLECTION": 7}
Parts = list[list[tuple[float, float]]]


class Damaged(ValueError):
    """Bytes or text that are no geometry."""


def parts(content: bytes) -> Parts:
    """The parts of a geometry in well-known binary, of either byte order; heights, measures and the identifier of a system are skipped."""
    found, end = _read(content, 0)
    if end != len(content):
        raise Damaged(f"{len(content) - end} bytes behind the geometry")
    return found


def _read(content: bytes, at: int) -> tuple[Parts, int]:
    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(content):
            raise Damaged("geometry cut off")
        out = struct.unpack_from(form, content, at)
        at += size
        return out

    (order,) = take("B")
    if order > 1:
        raise Damaged(f"byte order {order}")
    mark = "<" if order else ">"
    (kind,) = take(mark + "I")
    has_z, has_m = bool(kind & 0x80000000), bool(kind & 0x40000000)
    if kind & 0x20000000:
        take(mark + "I")
    kind &= 0x1FFFFFFF
    extra, kind = divmod(kind, 1000)
    wide = 2 + (has_z or extra in (1, 3)) + (has_m or extra in (2, 3))

    def line() -> list[tuple[float, float]]:
        (n,) = take(mark + "I")
        if n * 8 * wide > len(content) - at:
            raise Damaged("geometry cut off")
        flat = take(f"{mark}{n * wide}d")
        return list(zip(flat[::wide], flat[1::wide]))

    if kind == POINT:
        flat = take(f"{mark}{wide}d")
        return ([] if flat[0] != flat[0] else [[flat[:2]]]), at  # not a number: the empty point
    if kind == LINE:
        return [p for p in [line()] if p], at
    (n,) = take(mark + "I")
    if kind == AREA:
        return [p for p in (line() for _ in range(n)) if p], at
    if kind not in (4, 5, 6, 7):
        raise Damaged(f"kind {kind}")
    out: Parts = []
    for _ in range(n):
        inner, at = _read(content, at)
        out += inner
    return out, at


def binary(kind: int, held: Parts) -> bytes:
    """Well-known binary of a point, line or area (rings), or of several points (4) or lines (5)."""
    if kind in (4, 5):
        return struct.pack("<BII", 1, kind, len(held)) + b"".join(binary(kind - 3, [p]) for p in held)
    if kind == POINT:
        return struct.pack("<BI2d", 1, POINT, *held[0][0])
    lines = b"".join(struct.pack("<I", len(p)) + b"".join(struct.pack("<2d", *v) for v in p) for p in held)
    return struct.pack("<BI", 1, kind) + (struct.pack("<I", len(held)) if kind == AREA else b"") + lines


def text_parts(text: str) -> Parts:
    """The parts of a geometry in well-known text."""
    body = re.sub(r"^\s*SRID\s*=\s*\d+\s*;", "", text, flags=re.IGNORECASE)
    words = re.findall(r"[A-Za-z]+", body)
    if not words or any(w.upper() not in (*NAMES, "EMPTY", "Z", "M", "ZM", "E", "NAN") for w in words) or body.count("(") != body.count(")"):
        raise Damaged(text[:40])
    if words[0].upper().startswith("MULTIPOINT"):
        body = re.sub(r"\(\s*\(|\)\s*,\s*\(|\)\s*\)", lambda m: "," if "," in m.group() else m.group()[0], body)
    out: Parts = []
    try:
        for group in re.findall(r"\(([^()]+)\)", body):
            row = [tuple(float(x) for x in v.split()[:2]) for v in group.split(",")]
            if any(len(v) != 2 for v in row):
                raise Damaged(text[:40])
            out += [[v] for v in row] if words[0].upper() == "MULTIPOINT" else [row]
    except ValueError as why:
        raise Damaged(text[:40]) from why
    return out


def text(kind: int, held: Parts) -> str:
    """Well-known text of a point, line, area, or several points or lines."""
    row = lambda p: "(" + ", ".join(f"{x!r} {y!r}" for x, y in p) + ")"
    name = next(n for n, k in NAMES.items() if k == kind)
    return f"{name} {row(held[0])}" if kind in (POINT, LINE) else f"{name} ({', '.join(row(p) for p in held)})"
