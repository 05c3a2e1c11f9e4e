"""Text of a PDF page: glyphs placed by the content stream's operators, put together to lines and blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from tessera.sources.pdf_format import DEPTH, GAP, Name, PdfFile, Stream, Word, parsed

#: Widths are in thousandths of the font size; this one where a font tells none.
WIDTH = 500
#: In sizes of a font: a gap that is a space, one that parts columns, lines' distance within a block, lines that are level.
SPACE_GAP, COLUMN_GAP, LINE_GAP, LEVEL = 0.2, 2.5, 1.6, 0.5
#: What most of a page is: a string without escapes that is shown, perhaps on the next line.
SHOWN = re.compile(GAP + rb"(T\*)?" + GAP + rb"\(([^()\\]*)\)" + GAP + rb"Tj(?=[\x00\t\n\f\r ]|$)")
#: Names of glyphs that are not one letter, as encodings use them.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'",
    "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "colon": ":",
    "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "zero": "0", "one": "1", "two": "2", "three": "3",
    "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "quoteleft": "‘", "quoteright": "’",
    "quotedblleft": "“", "quotedblright": "”", "endash": "–", "emdash": "—", "bullet": "•", "ellipsis": "…",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "adieresis": "ä",
    "odieresis": "ö", "udieresis": "ü", "germandbls": "ß", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "Euro": "€",
}


def glyph(name: str) -> str:
    if found := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        return bytes.fromhex(found[1]).decode("utf-16-be", "replace") if found[1] else chr(min(int(found[2], 16), 0x10FFFF))
    return name if len(name) == 1 else GLYPHS.get(name.split(".")[0], "")


def to_unicode(data: bytes) -> dict[int, str]:
    """The map of codes to text that a font carries."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    number = lambda b: int.from_bytes(b, "big")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", data, re.DOTALL):
        items, at = [], 0
        while at < len(body):
            item, at = parsed(body, at)
            if item != b"" or not isinstance(item, Word):
                items.append(item)
        if kind == b"bfchar":
            out |= {number(a): text(b) for a, b in zip(items[::2], items[1::2], strict=False)}
            continue
        for first, last, target in zip(items[::3], items[1::3], items[2::3], strict=False):
            for k, code in enumerate(range(number(first), min(number(last), number(first) + 65535) + 1)):
                if isinstance(target, list):
                    out[code] = text(target[k]) if k < len(target) else ""
                else:
                    out[code] = text(target[:-2]) + chr(min(number(target[-2:]) + k, 0x10FFFF)) if len(target) < 4 else text((number(target) + k).to_bytes(len(target), "big"))
    return out


class Font:
    """Codes of a font to text and widths."""

    def __init__(self, pdf: PdfFile, font: dict):
        get = lambda d, k: pdf.resolve((d or {}).get(k))
        self.wide = get(font, "Subtype") == "Type0"
        own = get(font, "ToUnicode")
        self.map = to_unicode(own.data(pdf.resolve)) if isinstance(own, Stream) else {}
        self.widths: dict[int, float] = {}
        if self.wide:
            inner = pdf.resolve((get(font, "DescendantFonts") or [{}])[0]) or {}
            self.width = get(inner, "DW") or 1000
            listed = list(map(pdf.resolve, get(inner, "W") or []))
            while len(listed) > 1:
                if isinstance(listed[1], list):
                    self.widths |= {listed[0] + k: w for k, w in enumerate(listed[1])}
                    listed = listed[2:]
                else:
                    self.widths |= dict.fromkeys(range(listed[0], listed[1] + 1), listed[2]) if len(listed) > 2 else {}
                    listed = listed[3:]
        else:
            first, widths = get(font, "FirstChar") or 0, get(font, "Widths") or []
            self.widths = {first + k: w for k, w in enumerate(map(pdf.resolve, widths)) if w}
            self.width = get(get(font, "FontDescriptor"), "MissingWidth") or WIDTH
            encoding = get(font, "Encoding")
            base = encoding if isinstance(encoding, Name) else get(encoding, "BaseEncoding") if isinstance(encoding, dict) else None
            page = "mac-roman" if base == "MacRomanEncoding" else "cp1252"
            plain = {code: bytes([code]).decode(page, "ignore") for code in range(256)}
            code = 0
            for item in get(encoding, "Differences") or [] if isinstance(encoding, dict) else []:
                if isinstance(item, int):
                    code = item
                else:
                    plain[code] = glyph(item)
                    code += 1
            self.map = plain | self.map
            self.table = [self.map.get(code, "") for code in range(256)]

    def read(self, raw: bytes) -> tuple[str, float, int, int]:
        """(text, sum of the widths, codes, spaces that word spacing widens)."""
        if self.wide:
            codes = [raw[k] << 8 | raw[k + 1] for k in range(0, len(raw) - 1, 2)]
            return "".join([self.map.get(c, "") for c in codes]), sum([self.widths.get(c, self.width) for c in codes]), len(codes), 0
        width = sum([self.widths.get(c, self.width) for c in raw]) if self.widths else self.width * len(raw)
        return raw.decode("latin-1").translate(self.table), width, len(raw), raw.count(32)


@dataclass
class Span:
    x: float
    end: float
    y: float
    size: float
    text: str


Matrix = tuple[float, float, float, float, float, float]
SAME: Matrix = (1, 0, 0, 1, 0, 0)


def product(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (
        m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5],
    )


class Page:
    """Runs a page's operators and gathers spans."""

    def __init__(self, pdf: PdfFile, fonts: dict):
        self.pdf, self.fonts, self.spans = pdf, fonts, []

    def font(self, resources: dict, name: Any) -> Font | None:
        listed = self.pdf.resolve((resources or {}).get("Font")) or {}
        ref = listed.get(name)
        key = ref.number if hasattr(ref, "number") else id(ref)
        if key not in self.fonts:
            found = self.pdf.resolve(ref)
            self.fonts[key] = Font(self.pdf, found) if isinstance(found, dict) else None
        return self.fonts[key]

    def run(self, data: bytes, resources: dict, ctm: Matrix = SAME, depth: int = 0) -> None:
        stack: list[tuple] = []
        args: list[Any] = []
        text, line = SAME, SAME
        font, size, leading, apart, between, scale, rise = None, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
        at = 0

        def show(raw: bytes) -> None:
            nonlocal text
            if not font:
                return
            where = text if ctm is SAME else product(text, ctm)
            said, width, codes, spaces = font.read(raw)
            moved = (width / 1000 * size + apart * codes + between * spaces) * scale
            text = (*text[:4], moved * text[0] + text[4], moved * text[1] + text[5])
            after = text if ctm is SAME else product(text, ctm)
            height = ((size * where[2]) ** 2 + (size * where[3]) ** 2) ** 0.5 or 1.0
            if said:
                self.spans.append(Span(rise * where[2] + where[4], rise * after[2] + after[4], rise * where[3] + where[5], height, said))

        def down(x: float, y: float) -> None:
            nonlocal text, line
            text = line = (*line[:4], x * line[0] + y * line[2] + line[4], x * line[1] + y * line[3] + line[5])

        while at < len(data):
            if not args and (found := SHOWN.match(data, at)):
                if found[1]:
                    down(0, -leading)
                show(found[2])
                at = found.end()
                continue
            item, at = parsed(data, at)
            if not isinstance(item, Word):
                args.append(item)
                continue
            numbers = [a for a in args if isinstance(a, int | float)]
            match bytes(item):
                case b"q":
                    stack.append((ctm, font, size, leading, apart, between, scale, rise))
                case b"Q" if stack:
                    ctm, font, size, leading, apart, between, scale, rise = stack.pop()
                case b"cm" if len(numbers) == 6:
                    ctm = product(tuple(numbers), ctm)
                case b"BT":
                    text = line = SAME
                case b"Tf" if len(args) > 1 and numbers:
                    font, size = self.font(resources, args[0]), numbers[-1]
                case b"Td" if len(numbers) == 2:
                    down(*numbers)
                case b"TD" if len(numbers) == 2:
                    leading = -numbers[1]
                    down(*numbers)
                case b"Tm" if len(numbers) == 6:
                    text = line = tuple(numbers)
                case b"T*":
                    down(0, -leading)
                case b"TL" if numbers:
                    leading = numbers[0]
                case b"Tc" if numbers:
                    apart = numbers[0]
                case b"Tw" if numbers:
                    between = numbers[0]
                case b"Tz" if numbers:
                    scale = numbers[0] / 100
                case b"Ts" if numbers:
                    rise = numbers[0]
                case b"Tj" if args and isinstance(args[-1], bytes):
                    show(args[-1])
                case b"'" if args and isinstance(args[-1], bytes):
                    down(0, -leading)
                    show(args[-1])
                case b'"' if len(args) > 2 and isinstance(args[-1], bytes):
                    between, apart = numbers[0], numbers[1]
                    down(0, -leading)
                    show(args[-1])
                case b"TJ" if args and isinstance(args[-1], list):
                    for part in args[-1]:
                        if isinstance(part, bytes):
                            show(part)
                        elif isinstance(part, int | float):
                            text = product((1, 0, 0, 1, -part / 1000 * size * scale, 0), text)
                case b"Do" if args and depth < DEPTH:
                    form = self.pdf.resolve((self.pdf.resolve((resources or {}).get("XObject")) or {}).get(args[-1]))
                    if isinstance(form, Stream) and self.pdf.resolve(form.head.get("Subtype")) == "Form":
                        own = self.pdf.resolve(form.head.get("Resources")) or resources
                        matrix = tuple(self.pdf.resolve(form.head.get("Matrix")) or SAME)
                        self.run(form.data(self.pdf.resolve), own, product(matrix, ctm), depth + 1)
                case b"ID":
                    end = re.compile(rb"\sEI(?=\s|$)").search(data, at)  # an image in the stream
                    at = end.end() if end else len(data)
            args = []


def lines(spans: list[Span]) -> list[Span]:
    """Spans that are level and near to each other, as one, with spaces where gaps say so; from the top, then from the left."""
    levels: list[list[Span]] = []
    for span in sorted((s for s in spans if s.text), key=lambda s: -s.y):
        if levels and levels[-1][0].y - span.y < LEVEL * min(levels[-1][0].size, span.size):
            levels[-1].append(span)
        else:
            levels.append([span])
    out: list[Span] = []
    for level in levels:
        last = None
        for span in sorted(level, key=lambda s: s.x):
            gap = span.x - last.end if last else 0.0
            if last is None or gap > COLUMN_GAP * max(last.size, span.size):
                last = Span(span.x, span.end, level[0].y, span.size, span.text)
                out.append(last)
                continue
            wide = gap > SPACE_GAP * span.size and not last.text[-1:].isspace() and not span.text[:1].isspace()
            last.text += (" " if wide else "") + span.text
            last.end, last.size = max(last.end, span.end), max(last.size, span.size)
    return [s for s in out if s.text.strip()]


@dataclass
class Block:
    lines: list[Span]
    left: float
    right: float


def blocks(spans: list[Span]) -> list[str]:
    """Texts of the blocks: lines of about one size, one below the other; in order from the top, then from the left."""
    found: list[Block] = []
    near: list[Block] = []  # those that a line may still be close to
    largest = max((s.size for s in spans), default=0.0)
    for line in lines(spans):
        near = [b for b in near if b.lines[-1].y - line.y <= LINE_GAP * largest]
        for block in reversed(near):
            last = block.lines[-1]
            size = max(last.size, line.size)
            close = 0 < last.y - line.y <= LINE_GAP * size and min(last.size, line.size) > 0.8 * size
            if close and line.x < block.right and line.end > block.left:
                block.lines.append(line)
                block.left, block.right = min(block.left, line.x), max(block.right, line.end)
                break
        else:
            near.append(Block([line], line.x, line.end))
            found.append(near[-1])
    order = sorted(found, key=lambda b: (-round(b.lines[0].y, 1), b.lines[0].x))
    return ["\n".join(s.text for s in b.lines) for b in order]


def pages(pdf: PdfFile, begin: int, end: int) -> Iterator[tuple[int, str | None, list[str]]]:
    """(number, label, texts of the blocks) of pages."""
    fonts: dict = {}
    for number, page in pdf.pages(begin, end):
        own = Page(pdf, fonts)
        own.run(pdf.content(page), pdf.resolve(page.get("Resources")) or {})
        yield number, pdf.label(page), blocks(own.spans)

