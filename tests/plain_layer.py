"""A layer written by one plain loop, to hold the sink's bytes against."""

import os
import struct
import uuid
from collections.abc import Sequence

import numpy as np

from cantle.sources.shapefile_sink import polygon_record


def write_rows(path: str, rows, fields: Sequence[tuple[str, str, int, int]], prj: str) -> int:
    """Write (attributes..., parts) rows in order, each file under a temporary name until whole."""
    base = os.path.splitext(path)[0]
    mark = f".{uuid.uuid4().hex}"
    low, high, at, n = np.array([np.inf, np.inf]), np.array([-np.inf, -np.inf]), 50, 0
    width = 1 + sum(f[2] for f in fields)
    with open(base + ".shp" + mark, "wb") as shp, open(base + ".shx" + mark, "wb") as shx, open(base + ".dbf" + mark, "wb") as dbf:
        shp.write(b"\0" * 100)
        shx.write(b"\0" * 100)
        head = 33 + 32 * len(fields)
        dbf.write(b"\0" * 32 + b"".join(struct.pack("<11sc4xBB14x", f[0].encode()[:10], f[1].encode(), f[2], f[3]) for f in fields) + b"\r")
        for *values, parts in rows:
            body = polygon_record(parts)
            if len(body) > 4:
                box = struct.unpack("<4d", body[4:36])
                low, high = np.minimum(low, box[:2]), np.maximum(high, box[2:])
            shx.write(struct.pack(">2i", at, len(body) // 2))
            shp.write(struct.pack(">2i", n + 1, len(body) // 2) + body)
            at, n = at + 4 + len(body) // 2, n + 1
            cells = []
            for v, (_, kind, wide, decimals) in zip(values, fields, strict=True):
                if kind in "NF":
                    text = "" if v is None else f"{v:.{decimals}f}" if decimals else str(int(v))
                    cells.append(text[:wide].rjust(wide).encode())
                else:
                    raw = ("" if v is None else str(v)).encode()[:wide]
                    cells.append(raw.decode("utf-8", "ignore").encode().ljust(wide))
            dbf.write(b" " + b"".join(cells))
        dbf.write(b"\x1a")
        dbf.seek(0)
        dbf.write(struct.pack("<4BIHH", 3, 125, 1, 1, n, head, width))
        box = [*low, *high] if n and np.isfinite(low).all() else [0.0] * 4
        for f, words in ((shp, at), (shx, 50 + 4 * n)):
            f.seek(0)
            f.write(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0))
    for e, text in ((".prj", prj), (".cpg", "UTF-8")):
        with open(base + e + mark, "w", encoding="utf-8") as f:
            f.write(text)
    for e in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
        os.replace(base + e + mark, base + e)
    return n
