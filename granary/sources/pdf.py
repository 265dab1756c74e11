"""The text of PDF pages with the standard library: Flate streams, object streams, page trees, ToUnicode maps.

Enough for text documents; encrypted files, other filters and fonts without a map to Unicode beyond Latin-1 are not read (a
file that cannot be parsed is an error of its row). A fuller library can take its place in ``formats.EXTRACTORS``.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*)", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _File:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        if b"/Encrypt" in data:
            raise ValueError("encrypted PDF")
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        stream, n, first = self.stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
        numbers = [int(x) for x in stream[:first].split()[: 2 * n]]
        places = numbers[1::2] + [len(stream) - first]
        for k, number in enumerate(numbers[0::2]):
            self.objects.setdefault(number, stream[first + places[k] : first + places[k + 1]])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if m is None:
            return b""
        head, raw = body[: m.start()], m[1]
        end = raw.rfind(b"endstream")
        raw = raw[: end if end >= 0 else len(raw)]
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(raw)
        if b"/Filter" in head and not re.search(rb"/Filter\s*\[\s*\]", head):
            raise ValueError("stream filter that is not supported")
        return raw

    def resolve(self, body: bytes, key: bytes) -> bytes:
        """A dictionary's value: the object it refers to, or what stands there."""
        m = re.search(key + rb"\s*(\d+\s+\d+\s+R|<<.*?>>|\[.*?\])", body, re.S)
        if m is None:
            return b""
        ref = _REF.fullmatch(m[1])
        return self.objects.get(int(ref[1]), b"") if ref else m[1]

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        out: list[bytes] = []

        def walk(body: bytes, above: bytes, seen: frozenset) -> None:
            own = above if b"/Resources" not in body else body
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids is None:
                out.append(body if b"/Resources" in body else body + b" /Resources " + self._resources(above))
                return
            for number in (int(x) for x in _REF.findall(kids[1])):
                if number not in seen and number in self.objects:
                    walk(self.objects[number], own, seen | {number})

        if root is None:
            return [b for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]
        walk(self.resolve(root, rb"/Pages"), b"", frozenset())
        return out

    def _resources(self, body: bytes) -> bytes:
        m = re.search(rb"/Resources\s*(\d+\s+\d+\s+R)", body)
        return m[1] if m else self.resolve(body, rb"/Resources") or b"<< >>"

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        return b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in _REF.findall(m[1])) if m else b""

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        at = page.find(b"/Resources")
        resources = self.resolve(page[at:], rb"/Resources") if at >= 0 else b""
        table = self.resolve(resources, rb"/Font")
        return {name: self._map(self.objects.get(int(n), b"")) for name, n in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", table)}

    def _map(self, font: bytes) -> dict[int, str]:
        m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", font)
        if m is None:
            return {}
        said = self.stream(self.objects.get(int(m[1]), b""))
        text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
        out: dict[int, str] = {}
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", said, re.S):
            out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", said, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                first = text(c)
                out |= {k: first[:-1] + chr(ord(first[-1]) + k - int(a, 16)) for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
        return out


def _bytes(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    body = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\(\r\n|.)", lambda m: b"" if m[1] in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _said(token: bytes, map_: dict[int, str]) -> str:
    data = _bytes(token)
    if not map_:
        return data.decode("latin-1")
    width = 2 if max(map_) > 255 or (len(data) % 2 == 0 and token.startswith(b"<") and all(int.from_bytes(data[k : k + 2]) in map_ for k in range(0, len(data), 2))) else 1
    return "".join(map_.get(int.from_bytes(data[k : k + width]), "") for k in range(0, len(data), width))


def _page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    inside, current = [], {}
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            inside = []
        elif t == b"]":
            stack.append(b"]")
        elif t[:1] in b"(<":
            (inside if stack[-1:] != [b"]"] else stack).append(t)
            stack.append(t)
        elif t[:1] == b"/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            if re.fullmatch(rb"[-+]?\d+\.?\d*|[-+]?\.\d+", t) and inside and float(t) < -200:
                inside.append(b"( )")
            stack.append(t)
        else:
            if t == b"Tf":
                current = fonts.get(next((x for x in reversed(stack) if x[:1] == b"/"), b""), {})
            elif t == b"TJ":
                out.append("".join(_said(x, current) for x in inside))
            elif t in (b"Tj", b"'", b'"'):
                text = next((x for x in reversed(stack) if x[:1] in b"(<"), None)
                out.append(("\n" if t != b"Tj" else "") + (_said(text, current) if text else ""))
            elif t in (b"Td", b"TD"):
                numbers = [x for x in stack if re.fullmatch(rb"[-+]?\d*\.?\d+", x)]
                out.append("\n" if numbers and float(numbers[-1]) != 0 else " ")
            elif t in (b"T*", b"Tm", b"ET"):
                out.append("\n")
            stack, inside = [], []
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(out)).strip()


def pages(data: bytes, most: int | None = None) -> list[str]:
    """The text of each page, the first ``most`` of them; a page that cannot be read says so."""
    file = _File(data)
    out = []
    for k, page in enumerate(file.pages()[:most], 1):
        try:
            out.append(_page_text(file.content(page), file.fonts(page)))
        except Exception as e:  # one page's fault is not the file's
            out.append(f"[page {k} extraction error: {e}]")
    return out


def text(data: bytes) -> str:
    return "\n\n".join(pages(data))
