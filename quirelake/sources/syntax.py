"""Objects of one PDF file: lexer, parser, cross-reference chain and recovery.

Values are Python's own: None, bool, int, ``Real`` (keeps its literal), bytes for strings,
``Name``, ``Ref``, list and dict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from quirelake.functions.codecs import CodecError, decode

MAX_NESTING, MAX_CHAIN = 500, 1000


class Name(str):
    __slots__ = ()


class Real(float):
    literal: str

    def __new__(cls, literal: str):
        value = super().__new__(cls, float(literal if literal.strip("+-") not in ("", ".") else "0"))
        value.literal = literal
        return value


class Ref(NamedTuple):
    num: int
    gen: int


class SyntaxProblem(ValueError):
    pass


_blank = re.compile(rb"(?:[\x00\t\n\f\r ]+|%[^\r\n]*)*")
_plain = re.compile(rb"[^\x00\t\n\f\r ()<>\[\]{}/%]*")
_number = re.compile(rb"[+-]?\d+$")
_real = re.compile(rb"[+-]*\d*\.\d*$")
_reference = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+R(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_header = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj(?![a-zA-Z])")
_escapes = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


class Reader:
    """Reads values from bytes at a position."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _blank.match(self.data, self.at).end()

    def value(self, depth: int = 0):
        if depth > MAX_NESTING:
            raise SyntaxProblem("nested too deeply")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise SyntaxProblem("the data end early")
        if data[at : at + 2] == b"<<":
            self.at += 2
            out: dict = {}
            while not self._end(b">>"):
                key = self.value(depth + 1)
                if not isinstance(key, Name):
                    raise SyntaxProblem(f"dictionary key at {at} is no name")
                value = self.value(depth + 1)
                if value is not None:
                    out[key] = value
            return out
        c = data[at : at + 1]
        if c == b"[":
            self.at += 1
            items = []
            while not self._end(b"]"):
                items.append(self.value(depth + 1))
            return items
        if c == b"(":
            return self._string()
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise SyntaxProblem("hex string without end")
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"/":
            m = _plain.match(data, at + 1)
            self.at = m.end()
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0]).decode("utf-8", "surrogateescape"))
        if m := _reference.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _plain.match(data, at)
        if not m[0]:
            raise SyntaxProblem(f"unexpected {c!r} at {at}")
        self.at = m.end()
        word = m[0]
        if _number.match(word):
            return int(word)
        if _real.match(word):
            return Real(word.decode())
        known = {b"true": True, b"false": False, b"null": None}
        if word in known:
            return known[word]
        raise SyntaxProblem(f"unknown word {word[:20]!r} at {at}")

    def _end(self, mark: bytes) -> bool:
        self.skip()
        if self.data.startswith(mark, self.at):
            self.at += len(mark)
            return True
        if self.at >= len(self.data):
            raise SyntaxProblem("the data end early")
        return False

    def _string(self) -> bytes:
        out, depth, i, data = bytearray(), 1, self.at + 1, self.data
        while i < len(data):
            c = data[i]
            if c == 0x5C:
                i += 1
                n = data[i] if i < len(data) else 0
                if n in _escapes:
                    out += _escapes[n]
                elif 0x30 <= n <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(data, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end() - 1
                elif n == 0x0D:
                    i += data[i + 1 : i + 2] == b"\n"
                elif n != 0x0A:
                    out.append(n)
            elif c == 0x29 and depth == 1:
                self.at = i + 1
                return bytes(out)
            else:
                depth += (c == 0x28) - (c == 0x29)
                out.append(c)
            i += 1
        raise SyntaxProblem("string without end")


@dataclass
class Entry:
    """Where an object is: at an offset, or in an object stream."""

    num: int
    gen: int
    kind: str
    offset: int = 0
    stream: int = 0
    index: int = 0
    section: int = 0


@dataclass
class Stored:
    value: object
    stream: bytes | None = None
    offset: int = -1


@dataclass
class Document:
    version: str = ""
    trailer: dict = field(default_factory=dict)
    entries: dict[tuple[int, int], Entry] = field(default_factory=dict)
    objects: dict[tuple[int, int], Stored] = field(default_factory=dict)
    diagnostics: list[tuple[str, str, int]] = field(default_factory=list)


def object_at(data: bytes, at: int, length_of=lambda ref: None) -> tuple[int, int, Stored]:
    m = _header.match(data, _blank.match(data, at).end())
    if not m:
        raise SyntaxProblem(f"no object at {at}")
    reader = Reader(data, m.end())
    value, stream = reader.value(), None
    reader.skip()
    if isinstance(value, dict) and data.startswith(b"stream", reader.at):
        start = re.compile(rb"stream(?:\r\n|\n|\r)?").match(data, reader.at).end()
        n = value.get("Length")
        n = length_of(n) if isinstance(n, Ref) else n
        if not isinstance(n, int) or not re.compile(rb"\s*endstream").match(data, start + n):
            end = data.find(b"endstream", start)
            end = end if end >= 0 else data.find(b"endobj", start)
            if end < 0:
                raise SyntaxProblem(f"stream at {start} without end")
            n = len(re.sub(rb"\r?\n?$", b"", data[start:end]))
        stream = data[start : start + n]
    return int(m[1]), int(m[2]), Stored(value, stream, m.start())


def filters_of(value: dict) -> tuple[list[str], list[dict]]:
    names, parms = value.get("Filter"), value.get("DecodeParms", value.get("DP"))
    names = names if isinstance(names, list) else [] if names is None else [names]
    parms = parms if isinstance(parms, list) else [parms]
    return [str(n) for n in names], [p if isinstance(p, dict) else {} for p in parms]


def _table(data: bytes, reader: Reader, section: int) -> tuple[list[Entry], dict]:
    out = []
    while True:
        reader.skip()
        m = re.compile(rb"(\d+)\s+(\d+)").match(data, reader.at)
        if not m:
            break
        reader.at = m.end()
        for num in range(int(m[1]), int(m[1]) + int(m[2])):
            row = re.compile(rb"\s*(\d+)\s+(\d+)\s+([nf])").match(data, reader.at)
            if not row:
                raise SyntaxProblem("bad cross-reference row")
            reader.at = row.end()
            out.append(Entry(num, int(row[2]), "offset" if row[3] == b"n" else "free", int(row[1]), section=section))
    if not data.startswith(b"trailer", reader.at):
        raise SyntaxProblem("no trailer")
    reader.at += 7
    return out, reader.value()


def _xref_stream(data: bytes, at: int, section: int) -> tuple[list[Entry], dict]:
    _, _, stored = object_at(data, at)
    value = stored.value
    if not isinstance(value, dict) or value.get("Type") != "XRef" or stored.stream is None:
        raise SyntaxProblem(f"no cross-reference at {at}")
    body, widths = decode(stored.stream, *filters_of(value))[0], value["W"]
    index = value.get("Index") or [0, value["Size"]]
    out, place = [], 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for num in range(first, first + count):
            fields = []
            for w in widths:
                fields.append(int.from_bytes(body[place : place + w], "big") if w else None)
                place += w
            kind = 1 if fields[0] is None else fields[0]
            a, b = fields[1] or 0, fields[2] or 0
            if kind == 0:
                out.append(Entry(num, b, "free", a, section=section))
            elif kind == 1:
                out.append(Entry(num, b, "offset", a, section=section))
            elif kind == 2:
                out.append(Entry(num, 0, "stream", stream=a, index=b, section=section))
    return out, value


def chain(data: bytes) -> tuple[list[Entry], dict]:
    """Entries of all sections, newest first, and the newest trailer."""
    found = list(re.finditer(rb"startxref\s+(\d+)", data))
    if not found:
        raise SyntaxProblem("no startxref")
    todo, seen, entries, trailer = [int(found[-1][1])], set(), [], None
    while todo:
        at = todo.pop(0)
        if at in seen or len(seen) > MAX_CHAIN:
            raise SyntaxProblem("cross-reference sections form a loop")
        seen.add(at)
        reader = Reader(data, at)
        reader.skip()
        if data.startswith(b"xref", reader.at):
            reader.at += 4
            own, last = _table(data, reader, len(seen))
            if isinstance(last.get("XRefStm"), int):
                own += _xref_stream(data, last["XRefStm"], len(seen))[0]
        else:
            own, last = _xref_stream(data, at, len(seen))
        entries += own
        trailer = last if trailer is None else trailer
        if isinstance(last.get("Prev"), int):
            todo.append(last["Prev"])
    return entries, trailer


def register(entries: list[Entry]) -> dict[tuple[int, int], Entry]:
    """First entry of each (number, generation); a number freed before hides later ones."""
    out: dict[tuple[int, int], Entry] = {}
    freed: set[int] = set()
    for e in entries:
        if e.kind == "free":
            if not any(k[0] == e.num for k in out):
                freed.add(e.num)
        elif e.num not in freed:
            out.setdefault((e.num, e.gen), e)
    return out


def recover(data: bytes) -> tuple[dict[tuple[int, int], Entry], dict]:
    """Entries by a scan of line starts for object headers, the last one winning, and the last trailer with a root."""
    out, trailer = {}, {}
    for m in re.finditer(rb"(?:^|[\r\n])[\t ]*(\d+)[\t ]+(\d+)[\t ]+obj(?![a-zA-Z])", data):
        out[(int(m[1]), int(m[2]))] = Entry(int(m[1]), int(m[2]), "offset", m.start(1))
    for m in re.finditer(rb"trailer", data):
        try:
            value = Reader(data, m.end()).value()
        except SyntaxProblem:
            continue
        if isinstance(value, dict) and ("Root" in value or not trailer):
            trailer = value
    return out, trailer


def load(data: bytes, repair: bool = True) -> Document:
    """All objects of a file. With ``repair`` damage is recorded in the diagnostics, else raised."""
    doc = Document()
    m = re.search(rb"%PDF-(\d+\.\d+)", data[:1024])
    doc.version = m[1].decode() if m else ""
    if not m:
        doc.diagnostics.append(("warning", "no header", 0))
    try:
        entries, doc.trailer = chain(data)
        doc.entries = register(entries)
        for e in doc.entries.values():
            if e.kind == "offset" and not _header.match(data, _blank.match(data, min(e.offset, len(data))).end()):
                raise SyntaxProblem(f"object {e.num} {e.gen} is not at {e.offset}")
    except (SyntaxProblem, CodecError, KeyError, TypeError, ValueError) as e:
        if not repair:
            raise
        doc.diagnostics.append(("warning", f"cross-reference rebuilt: {e}", 0))
        doc.entries, doc.trailer = recover(data)

    def length_of(ref):
        e = doc.entries.get((ref.num, ref.gen))
        return object_at(data, e.offset)[2].value if e and e.kind == "offset" else None

    def note(e: Exception, at: int) -> None:
        if not repair:
            raise e
        doc.diagnostics.append(("error", str(e), at))

    for key, e in sorted(doc.entries.items()):
        if e.kind == "offset":
            try:
                doc.objects[key] = object_at(data, e.offset, length_of)[2]
            except (SyntaxProblem, ValueError) as problem:
                note(problem, e.offset)
    inside = {(num, gen): s for (num, gen), s in doc.objects.items() if isinstance(s.value, dict) and s.value.get("Type") == "ObjStm" and s.stream is not None}
    if not doc.trailer.get("Root"):
        for s in doc.objects.values():
            if isinstance(s.value, dict) and s.value.get("Type") == "XRef" and "Root" in s.value:
                doc.trailer = s.value
    for (num, _), s in sorted(inside.items()):
        try:
            body, warnings = decode(s.stream, *filters_of(s.value))
            doc.diagnostics += [("warning", w, s.offset) for w in warnings]
            head = Reader(body)
            pairs = [(head.value(), head.value()) for _ in range(s.value["N"])]
            for member, at in pairs:
                e = doc.entries.get((member, 0))
                if (e is None and (member, 0) not in doc.objects) or (e is not None and e.kind == "stream" and e.stream == num):
                    doc.objects[(member, 0)] = Stored(Reader(body, s.value["First"] + at).value())
        except (SyntaxProblem, CodecError, KeyError, TypeError, ValueError) as problem:
            note(problem, s.offset)
    return doc


def text_of(data: bytes) -> str | None:
    """Text of a string: UTF-16 or UTF-8 by its mark, else Latin-1 where each byte is printable there."""
    if data[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return data.decode("utf-16", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    return data.decode("latin-1") if all(b in (9, 10, 13) or 32 <= b < 127 or b >= 161 for b in data) else None


def as_json(value):
    """JSON form: ``u:`` text, ``b:`` hex bytes, ``/Name``, ``N G R``; a real keeps its value."""
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, Name):
        return "/" + value.encode("utf-8", "surrogateescape").decode("utf-8", "backslashreplace")
    if isinstance(value, bytes):
        text = text_of(value)
        return f"b:{value.hex()}" if text is None else f"u:{text}"
    if isinstance(value, list):
        return [as_json(x) for x in value]
    if isinstance(value, dict):
        return {as_json(k): as_json(v) for k, v in value.items()}
    return float(value) if isinstance(value, Real) else value


def references(value, path: str = ""):
    """(path, target) of each reference within a value."""
    if isinstance(value, Ref):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            yield from references(v, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from references(v, f"{path}/{i}")
