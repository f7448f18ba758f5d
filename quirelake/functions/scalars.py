"""Scalar functions of documents as Column expressions: digests, dates, geometry, strings, codecs by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short filter names and their full forms.
FILTER_NAMES = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Bits of the permission word.
PERMISSIONS = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill_forms": 256, "accessibility": 512, "assemble": 1024, "print_high": 2048}


def snap_rotation(degrees: Column) -> Column:
    """Degrees to the nearest quarter turn, half up, from 0 to 270."""
    return F.pmod(F.floor((degrees + 45) / 90) * 90, F.lit(360)).cast("long")


def compose_rotation(existing: Column, angle: Column, add: Column) -> Column:
    return snap_rotation(F.when(add, existing + angle).otherwise(angle))


def transform_point(matrix: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = matrix
    return a * x + c * y + e, b * x + d * y + f


def transform_rectangle(matrix: list[Column], llx: Column, lly: Column, urx: Column, ury: Column) -> list[Column]:
    """Bounding box of the four mapped corners."""
    corners = [transform_point(matrix, x, y) for x in (llx, urx) for y in (lly, ury)]
    xs, ys = [p[0] for p in corners], [p[1] for p in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def concat_matrix(m: list[Column], n: list[Column]) -> list[Column]:
    """The matrix that applies ``n``, then ``m``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return [a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f]


def boxes(media: Column, crop: Column, other: Column) -> tuple[Column, Column, Column]:
    """Media, crop (else media) and another box (else crop)."""
    return media, F.coalesce(crop, media), F.coalesce(other, crop, media)


def allowed(word: Column, name: str) -> Column:
    return word.bitwiseAND(F.lit(PERMISSIONS[name])) != 0


def annotation_shown(flags: Column, required: int, forbidden: int) -> Column:
    return (flags.bitwiseAND(F.lit(required)) == required) & (flags.bitwiseAND(F.lit(forbidden)) == 0)


def format_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss'Z'")


def parse_date(text: Column) -> Column:
    """ISO text of ``D:YYYYMMDDHHmmSS`` with an optional zone; null if it is no date."""
    pattern = r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:Z|([+-])(\d{2})'(\d{2})'?)?$"
    part = [F.regexp_extract(text, pattern, i) for i in range(1, 10)]
    zone = F.when(part[6] == "", "Z").otherwise(F.concat(part[6], part[7], F.lit(":"), part[8]))
    return F.when(text.rlike(pattern), F.concat(part[0], F.lit("-"), part[1], F.lit("-"), part[2], F.lit("T"), part[3], F.lit(":"), part[4], F.lit(":"), part[5], zone))


def bits_needed(value: Column) -> Column:
    return F.when(value == 0, 0).otherwise(F.length(F.bin(value))).cast("long")


def hex_string(data: Column) -> Column:
    return F.concat(F.lit("<"), F.lower(F.hex(data)), F.lit(">"))


def utf16_bytes(text: Column) -> Column:
    """Byte order mark and UTF-16 big-endian bytes."""
    return F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))


def full_filter_name(name: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in FILTER_NAMES.items() for x in pair])[name], name)


def parse_version(text: Column) -> Column:
    """Struct (major, minor) of ``M.N``, null if it is none."""
    ok = text.rlike(r"^\d+\.\d+$")
    return F.when(ok, F.struct(F.try_element_at(F.split(text, r"\."), F.lit(1)).cast("int").alias("major"), F.try_element_at(F.split(text, r"\."), F.lit(2)).cast("int").alias("minor")))


def parse_reference(text: Column) -> Column:
    """Struct (num, gen) of ``N G`` or ``N G R``."""
    pattern = r"^\s*(\d{1,9})\s+(\d{1,5})(?:\s+R)?\s*$"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("long").alias("num"), F.regexp_extract(text, pattern, 2).cast("int").alias("gen")))


def joined_contents(streams: Column) -> Column:
    """Ordered streams as one, with a line feed after each that lacks one, but the last."""
    return F.aggregate(streams, F.lit(""), lambda acc, s: F.when(acc == "", s).when(acc.endswith("\n"), F.concat(acc, s)).otherwise(F.concat(acc, F.lit("\n"), s)))


def permission_word(allowed_names: dict[str, Column]) -> Column:
    """The permission word that allows what is true; bits that mean nothing are set, the first two are not."""
    word = F.lit(-4 & ~sum(PERMISSIONS.values()))
    for name, is_allowed in allowed_names.items():
        word = word + F.when(is_allowed, PERMISSIONS[name]).otherwise(0)
    return word


def decode_text(data: Column) -> Column:
    """Text of a string with a UTF-16 byte order mark, else of Latin-1 bytes."""
    tail = F.substring(data, 3, 1 << 30)
    mark = F.hex(F.substring(data, 1, 2))
    return F.when(mark == "FEFF", F.decode(tail, "UTF-16BE")).when(mark == "FFFE", F.decode(tail, "UTF-16LE")).otherwise(F.decode(data, "ISO-8859-1"))


def encode_text(text: Column) -> Column:
    """Latin-1 bytes where the text has no other characters, else UTF-16 with its mark."""
    return F.when(text.rlike(r"^[\x09\x0a\x0d\x20-\x7e\u00a1-\u00ff]*$"), F.encode(text, "ISO-8859-1")).otherwise(utf16_bytes(text))


def default_appearance(text: Column) -> Column:
    """Struct (font, size, colour operands) of the last font and colour set in an appearance string."""
    font = F.element_at(F.regexp_extract_all(text, F.lit(r"/(\S+)\s+[-\d.]+\s+Tf"), F.lit(1)), -1)
    size = F.element_at(F.regexp_extract_all(text, F.lit(r"/\S+\s+([-\d.]+)\s+Tf"), F.lit(1)), -1)
    colour = F.element_at(F.regexp_extract_all(text, F.lit(r"((?:[\d.]+\s+){1,4})(?:g|rg|k)(?:\s|$)"), F.lit(1)), -1)
    return F.struct(font.alias("font"), size.cast("double").alias("size"), F.trim(colour).alias("colour"))


def parse_rotation(text: Column) -> Column:
    """Struct (add, degrees, pages) of ``[+|-]angle[:range]``; null if it is none."""
    pattern = r"^([+-]?)(\d+)(?::(.*))?$"
    sign = F.regexp_extract(text, pattern, 1)
    degrees = F.regexp_extract(text, pattern, 2).cast("long")
    pages = F.regexp_extract(text, pattern, 3)
    return F.when(text.rlike(pattern), F.struct((sign != "").alias("add"), F.when(sign == "-", -degrees).otherwise(degrees).alias("degrees"), F.when(pages == "", "1-z").otherwise(pages).alias("pages")))


def parse_selector(text: Column) -> Column:
    """Struct (kind, num, gen) of ``trailer``, ``N`` , ``N,G`` or ``obj:N G R``; null if it is none."""
    pattern = r"^(?:obj:)?(\d{1,9})(?:[, ](\d{1,5}))?(?: R)?$"
    gen = F.regexp_extract(text, pattern, 2)
    return F.when(text == "trailer", F.struct(F.lit("trailer").alias("kind"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("int").alias("gen"))).when(
        text.rlike(pattern), F.struct(F.lit("object").alias("kind"), F.regexp_extract(text, pattern, 1).cast("long").alias("num"), F.when(gen == "", "0").otherwise(gen).cast("int").alias("gen"))
    )


def placement_matrix(box: list[Column], rect: list[Column]) -> list[Column]:
    """The matrix that fits a box into a rectangle, centred, at the largest scale that keeps its shape."""
    w, h = box[2] - box[0], box[3] - box[1]
    scale = F.least((rect[2] - rect[0]) / w, (rect[3] - rect[1]) / h)
    x = (rect[0] + rect[2]) / 2 - scale * (box[0] + box[2]) / 2
    y = (rect[1] + rect[3]) / 2 - scale * (box[1] + box[3]) / 2
    return [scale, F.lit(0.0), F.lit(0.0), scale, x, y]


#: The decode level from which each filter is undone.
DECODED_FROM = {"FlateDecode": 1, "LZWDecode": 1, "ASCII85Decode": 1, "ASCIIHexDecode": 1, "RunLengthDecode": 2, "DCTDecode": 3}
LEVELS = ("none", "generalized", "specialized", "all")


def decodable(name: Column) -> Column:
    """Whether a filter can be undone; the name is taken as it stands, abbreviations are not expanded."""
    return F.coalesce(name.isin(*DECODED_FROM), F.lit(False))


def decoded_at(filters: Column, level: str) -> Column:
    """Whether a chain of filters, an array of full names, is undone at a decode level; no filters need no decoding."""
    known = F.create_map(*[F.lit(x) for pair in DECODED_FROM.items() for x in pair])
    needed = F.transform(filters, lambda f: F.coalesce(F.try_element_at(known, f), F.lit(len(LEVELS))))
    return F.forall(needed, lambda n: n <= LEVELS.index(level))


def rotation_matrix(degrees: Column, llx: Column, lly: Column, urx: Column, ury: Column) -> list[Column]:
    """The matrix that draws a page of this media box as a /Rotate of 90, 180 or 270 shows it; otherwise the identity."""
    pick = lambda quarter, half, three, none: F.when(degrees == 90, quarter).when(degrees == 180, half).when(degrees == 270, three).otherwise(F.lit(none)).cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    return [
        pick(zero, -one, zero, 1.0), pick(-one, zero, one, 0.0), pick(one, zero, -one, 0.0), pick(zero, -one, zero, 1.0),
        pick(zero, llx + urx, lly + ury, 0.0), pick(llx + urx, lly + ury, zero, 0.0),
    ]


def file_identifier(data: Column, mark: str, info: Column) -> Column:
    """A repeatable identifier: MD5 of the hex MD5 of the bytes, a mark and the document information up to its first NUL."""
    return F.md5(F.concat(F.md5(data), F.lit(mark), F.substring_index(info, "\0", 1)))


def put(entries: Column, key: Column, value: Column) -> Column:
    """A map with one entry set, or taken out if the value is null: null and a missing entry are the same."""
    rest = F.map_filter(entries, lambda k, _: k != key)
    return F.when(value.isNull(), rest).otherwise(F.map_concat(rest, F.create_map(key, value)))


def in_key_order(entries: Column) -> Column:
    """The entries of a map whose value is not null, as an array of (key, value) by key."""
    return F.array_sort(F.map_entries(F.map_filter(entries, lambda _, v: v.isNotNull())))


def cipher(version: Column, filter_method: Column) -> Column:
    """Name of the cipher of an encryption dictionary: of its version, from 4 on of its crypt filter's method."""
    named = F.when(filter_method == "V2", "RC4").when(filter_method == "AESV2", "AES-128").when(filter_method == "AESV3", "AES-256").when(filter_method == "None", "none")
    return F.when(version.isin(1, 2, 3), "RC4").when(version.isin(4, 5), F.coalesce(named, F.lit("none")))
