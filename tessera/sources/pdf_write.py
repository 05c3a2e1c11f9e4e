"""Pages as a PDF file, written from its beginning to its end: what is kept meanwhile is a number a page."""

from __future__ import annotations

import re
import zlib
from typing import BinaryIO

#: Characters of a line, and children of a node of the page tree.
LINE, KIDS = 90, 64
MARGIN, WIDTH, HEIGHT = 50, 595, 842
#: Sizes of a title, of text and of a footer; lines are so many sizes apart, paragraphs two lines more.
TITLE, TEXT, FOOTER, APART = 18, 11, 8, 1.3
#: Characters that the second font has at most; a file that nears it is `full`.
CODES = 60_000
#: What the first font, Helvetica, shows by its own codes.
PLAIN = "".join(sorted(set(bytes(range(32, 256)).decode("cp1252", "ignore")) - {"\x7f"}))
RUNS = re.compile(f"(?s)[{re.escape(PLAIN)}]+|[^{re.escape(PLAIN)}]+")
SPECIAL = re.compile(rb"[()\\]")
BLANK_LINES = re.compile(r"\n\s*\n")
#: Where a line may be cut: a single space, not behind a hyphen, as readers would join the words.
CUT = re.compile("(?<=[^ -]) (?=[^ ])")


def wrapped(text: str) -> list[str]:
    """Lines of a paragraph: its own, cut at spaces."""
    out: list[str] = []
    for line in text.split("\n"):
        begin, end = 0, len(line)
        while end - begin > LINE and (cut := place(line, begin)) >= 0:
            out.append(line[begin:cut])
            begin = cut + 1
        out.append(line[begin:])
    return [x for x in out if x.strip()]


def place(line: str, begin: int) -> int:
    """The last place to cut such that the line is not too long, or else the first one; -1 where there is none."""
    at = begin + LINE + 1
    while (at := line.rfind(" ", begin + 1, at)) >= 0:
        if line[at - 1] not in " -" and line[at + 1 : at + 2] not in ("", " "):
            return at
    found = CUT.search(line, begin + LINE + 1)
    return found.start() if found else -1


class PdfWriter:
    """Writes pages as they come; `close` writes what refers to them."""

    # Numbers of the objects that others refer to.
    ROOT, RESOURCES, HELVETICA, OTHERS, DESCENDANT, DESCRIPTOR, MAP = range(1, 8)

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.offsets = out, 0, [0] * 8
        #: Open nodes of the page tree, from the pages up: number, kids, pages below.
        self.levels: list[tuple[int, list[int], list[int]] | None] = []
        self.codes: dict[str, int] = {}
        self.pages = 0
        self.put(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def reserved(self) -> int:
        self.offsets.append(0)
        return len(self.offsets) - 1

    def object(self, number: int, body: bytes) -> None:
        self.offsets[number] = self.at
        self.put(b"%d 0 obj\n%b\nendobj\n" % (number, body))

    def stream(self, number: int, data: bytes) -> None:
        packed = zlib.compress(data, 6)
        self.object(number, b"<< /Length %d /Filter /FlateDecode >>\nstream\n%b\nendstream" % (len(packed), packed))

    @property
    def full(self) -> bool:
        return len(self.codes) >= CODES

    def shown(self, lines: list[str], size: int) -> bytes:
        """The operators that show lines, one below the other, in runs of the two fonts."""
        out, font = [], b""
        for k, line in enumerate(lines):
            if k:
                out.append(b"T*")
            for run in RUNS.findall(line):
                wanted = b"/F1" if run[0] in PLAIN else b"/F2"
                if wanted != font:
                    font = wanted
                    out.append(b"%b %d Tf" % (font, size))
                if font == b"/F1":
                    out.append(b"(%b) Tj" % SPECIAL.sub(rb"\\\g<0>", run.encode("cp1252")))
                else:
                    codes = b"".join(self.codes.setdefault(c, len(self.codes) + 1).to_bytes(2, "big") for c in run)
                    out.append(b"<%b> Tj" % codes.hex().encode())
        return b" ".join(out)

    def page(self, text: str, label: str | None = None, title: str | None = None, footer: str | None = None) -> None:
        """A page of one column, as high as its lines need. Blank lines part paragraphs."""
        parts = [(TITLE, title)] * bool(title) + [(TEXT, p) for p in BLANK_LINES.split(text)] + [(FOOTER, footer)] * bool(footer)
        placed, down = [], 0.0
        for size, part in parts:
            if lines := wrapped(part):
                placed.append((down + APART * size, size, lines))
                down += APART * size * (len(lines) + 2)
        height = max(HEIGHT, round(down) + 2 * MARGIN)
        body = [b"BT 1 0 0 1 %d %.2f Tm %.2f TL %b ET" % (MARGIN, height - MARGIN - y, APART * size, self.shown(lines, size)) for y, size, lines in placed]
        content, number = self.reserved(), self.reserved()
        self.stream(content, b"\n".join(body))
        info = b"" if label is None else b" /PieceInfo << /Tessera << /LastModified (D:19700101000000Z) /Private <%b> >> >>" % label.encode("utf-8", "surrogatepass").hex().encode()
        self.object(
            number,
            b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %d %d] /Resources %d 0 R /Contents %d 0 R%b >>" % (self.node(0)[0], WIDTH, height, self.RESOURCES, content, info),
        )
        self.pages += 1
        self.add(number, 1, 0)

    def node(self, depth: int) -> tuple[int, list[int], list[int]]:
        if depth == len(self.levels):
            self.levels.append(None)
        self.levels[depth] = self.levels[depth] or (self.reserved(), [], [])
        return self.levels[depth]

    def add(self, kid: int, below: int, depth: int) -> None:
        _, kids, counts = self.node(depth)
        kids.append(kid)
        counts.append(below)
        if len(kids) == KIDS:
            self.finish(depth)

    def finish(self, depth: int, top: bool = False) -> int:
        """Write the open node of a level; all but the top one go to the level above."""
        number, kids, counts = self.node(depth)
        self.levels[depth] = None
        parent = b"" if top else b" /Parent %d 0 R" % self.node(depth + 1)[0]
        self.object(number, b"<< /Type /Pages%b /Count %d /Kids [%b] >>" % (parent, sum(counts), b" ".join(b"%d 0 R" % k for k in kids)))
        if not top:
            self.add(number, sum(counts), depth + 1)
        return number

    def character_map(self) -> bytes:
        lines = [b"<%04x> <%b>" % (code, c.encode("utf-16-be", "surrogatepass").hex().encode()) for c, code in self.codes.items()]
        parts = [lines[k : k + 100] for k in range(0, len(lines), 100)]
        body = b"\n".join(b"%d beginbfchar\n%b\nendbfchar" % (len(p), b"\n".join(p)) for p in parts)
        return (
            b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /Own def /CMapType 2 def\n"
            b"1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n%b\nendcmap end end" % body
        )

    def close(self) -> None:
        """The tree's open nodes, fonts, catalogue and cross references."""
        self.node(0)
        for depth in range(len(self.levels) + 1):
            if depth == len(self.levels) - 1:
                tree = self.finish(depth, top=True)
                break
            if self.levels[depth]:
                self.finish(depth)
        self.object(self.ROOT, b"<< /Type /Catalog /Pages %d 0 R >>" % tree)
        self.object(self.RESOURCES, b"<< /Font << /F1 %d 0 R /F2 %d 0 R >> >>" % (self.HELVETICA, self.OTHERS))
        self.object(self.HELVETICA, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
        self.object(self.OTHERS, b"<< /Type /Font /Subtype /Type0 /BaseFont /Other /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (self.DESCENDANT, self.MAP))
        system = b"/CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >>"
        self.object(self.DESCENDANT, b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Other %b /DW 1000 /FontDescriptor %d 0 R >>" % (system, self.DESCRIPTOR))
        self.object(
            self.DESCRIPTOR, b"<< /Type /FontDescriptor /FontName /Other /Flags 4 /FontBBox [0 -200 1000 800] /ItalicAngle 0 /Ascent 800 /Descent -200 /CapHeight 700 /StemV 80 >>"
        )
        self.stream(self.MAP, self.character_map())
        begin = self.at
        rows = b"".join(b"%010d 00000 n\r\n" % x for x in self.offsets[1:])
        self.put(b"xref\n0 %d\n0000000000 65535 f\r\n%btrailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(self.offsets), rows, len(self.offsets), self.ROOT, begin))
