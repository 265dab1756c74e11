"""Rows of legacy workbooks (BIFF8 in a compound file) with the standard library: texts, numbers, Booleans and cached results."""

from __future__ import annotations

import struct


def _stream(data: bytes, names: tuple[str, ...] = ("Workbook", "Book")) -> bytes:
    """A named stream of a compound file."""
    if data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    n_fat, first_dir, cutoff, first_mini, _, first_more, n_more = struct.unpack_from("<I", data, 44)[0], *struct.unpack_from("<I", data, 48), *struct.unpack_from("<IIIII", data, 56)
    sector = lambda k: data[size * (k + 1) : size * (k + 2)]
    table = list(struct.unpack_from("<109I", data, 76))
    while n_more and first_more < 0xFFFFFFFA:
        more = struct.unpack(f"<{size // 4}I", sector(first_more))
        table += more[:-1]
        first_more, n_more = more[-1], n_more - 1
    fat: list[int] = []
    for k in table[:n_fat]:
        if k < 0xFFFFFFFA:
            fat += struct.unpack(f"<{size // 4}I", sector(k))

    def chain(first: int, links: list[int], read) -> bytes:
        out, seen = [], set()
        while first < 0xFFFFFFFA and first not in seen:
            seen.add(first)
            out.append(read(first))
            first = links[first] if first < len(links) else 0xFFFFFFFE
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    root = None
    for at in range(0, len(directory), 128):
        length = struct.unpack_from("<H", directory, at + 64)[0]
        name = directory[at : at + max(length - 2, 0)].decode("utf-16-le", "replace")
        first, total = struct.unpack_from("<II", directory, at + 116)
        if directory[at + 66] == 5:
            root = chain(first, fat, sector)
        elif name in names:
            if total >= cutoff:
                return chain(first, fat, sector)[:total]
            links = chain(first_mini, fat, sector)
            mini = list(struct.unpack(f"<{len(links) // 4}I", links))
            return chain(first, mini, lambda k: (root or b"")[small * k : small * (k + 1)])[:total]
    raise ValueError("no workbook in the compound file")


def _records(stream: bytes):
    at = 0
    while at + 4 <= len(stream):
        kind, length = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + length]
        at += 4 + length


def _shared(parts: list[bytes]) -> list[str]:
    """Texts of a shared table, which goes on in further records; a text's characters may change their width there."""
    out, k, at = [], 0, 8
    total = struct.unpack_from("<I", parts[0], 4)[0]

    def ahead():
        nonlocal k, at
        while k < len(parts) - 1 and at >= len(parts[k]):
            k, at = k + 1, 0

    def take(n: int) -> bytes:
        nonlocal at
        got = b""
        while n:
            ahead()
            piece = parts[k][at : at + n]
            if not piece:
                raise ValueError("shared texts end early")
            got, at, n = got + piece, at + len(piece), n - len(piece)
        return got

    for _ in range(total):
        length, flags = struct.unpack("<HB", take(3))
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while length:
            if at >= len(parts[k]):
                ahead()
                wide, at = parts[k][at] & 1, at + 1
            n = min(length, (len(parts[k]) - at) // (2 if wide else 1))
            text += take(n * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1")
            length -= n
        take(4 * runs + extra)
        out.append(text)
    return out


def _rk(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", raw & 0xFFFFFFFC))[0]
    return value / 100 if raw & 1 else value


def _short(data: bytes, at: int, width: int) -> str:
    length = data[at] if width == 1 else struct.unpack_from("<H", data, at)[0]
    wide = data[at + width] & 1
    body = data[at + width + 1 : at + width + 1 + length * (2 if wide else 1)]
    return body.decode("utf-16-le" if wide else "latin-1")


def rows(data: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, row from 1, cells) of the rows that have cells; numbers as Python shows a float."""
    stream = _stream(data)
    sheets, parts, shared = [], [], []
    for _, kind, body in _records(stream):
        if kind == 0x85:
            sheets.append((struct.unpack_from("<I", body)[0], _short(body, 6, 1)))
        elif kind == 0xFC:
            parts = [body]
        elif kind == 0x3C and parts and not shared:
            parts.append(body)
        elif parts and not shared:
            shared = _shared(parts)
        if kind == 0x0A:
            break
    out = []
    for begin, name in sheets:
        cells: dict[int, dict[int, str]] = {}
        last = None
        put = lambda r, c, v: cells.setdefault(r, {}).__setitem__(c, v)
        for _, kind, body in _records(stream[begin:]):
            if kind == 0x0A:
                break
            if kind in (0xFD, 0x0203, 0x027E, 0x0204, 0x0205, 0x06):
                r, c = struct.unpack_from("<HH", body)
                if kind == 0xFD:
                    put(r, c, shared[struct.unpack_from("<I", body, 6)[0]])
                elif kind == 0x0203:
                    put(r, c, str(struct.unpack_from("<d", body, 6)[0]))
                elif kind == 0x027E:
                    put(r, c, str(_rk(struct.unpack_from("<I", body, 6)[0])))
                elif kind == 0x0204:
                    put(r, c, _short(body, 6, 2))
                elif kind == 0x0205:
                    put(r, c, str(body[6]))
                elif body[12:14] != b"\xff\xff":
                    put(r, c, str(struct.unpack_from("<d", body, 6)[0]))
                else:
                    last = (r, c)
            elif kind == 0xBD:
                r, c = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    put(r, c + k, str(_rk(struct.unpack_from("<I", body, 6 + 6 * k)[0])))
            elif kind == 0x0207 and last:
                put(*last, _short(body, 0, 2))
        out += [(name, r + 1, [row.get(c) for c in range(max(row) + 1)]) for r, row in sorted(cells.items())] or [(name, 0, [])]
    return out
