"""A script's steps as clipboard XML: the definition's own text, cut out of a report, parsed and written again."""

from __future__ import annotations

from xml.parsers import expat
from xml.sax.saxutils import escape

from graphloom.sources.report_xml import encoding, open_report

# The clipboard class of the first kind of object that a snippet holds.
CLASSES = [("<Step ", "XMSS"), ("<CustomFunction ", "XMFN"), ("<BaseTable ", "XMTB"), ("<Script ", "XMSC"), ("<Layout", "XML2"), ("<Field ", "XMFD")]


def script_xml(path: str, name: str, script_id: str | None = None, chunk: int = 1 << 20) -> str:
    """The raw XML of the first script definition of that name (and id): a Script element that holds a StepList. References, which have none, are passed over.

    The parser says at which byte an element begins and ends, so the text comes as it stands in the file, however it is laid out in lines.
    """
    found: list[tuple[int, int]] = []
    open_: list[list] = []  # [start, wanted, has steps]
    parser = expat.ParserCreate()

    def start(tag, attrs):
        if tag == "Script":
            open_.append([parser.CurrentByteIndex, attrs.get("name") == name and (script_id is None or attrs.get("id") == str(script_id)), False])
        elif tag == "StepList" and open_:
            open_[-1][2] = True

    def end(tag):
        if tag == "Script":
            at, wanted, steps = open_.pop()
            if wanted and steps and not found:
                found.append((at, parser.CurrentByteIndex))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    with open_report(path) as f:
        while not found and (data := f.read(chunk)):
            parser.Parse(data, False)
        if not found:
            raise ValueError(f'script "{name}"' + (f" with id {script_id}" if script_id else "") + f" not found in {path}")
        first, last = found[0]
        f.seek(first)
        tail = "</Script>".encode("utf-16-le" if encoding(path) == "utf-16" else "utf-8")
        raw = f.read(last - first + len(tail))
    return raw.decode("utf-16-le" if encoding(path) == "utf-16" else "utf-8")


# Elements that the clipboard does without, and the references that stand for line ends and tabs in texts.
LEFT_OUT = frozenset(("StepText", "DisplayCalculation"))
TEXT_CODES = str.maketrans({"\n": "&#13;", "\r": "&#13;", "\t": "&#09;"})
COMMENT, RESTORE = "# (comment)", '<Restore state="False"></Restore>'


class _Writer:
    """Writes the steps of a script definition again while it is parsed."""

    def __init__(self):
        self.out: list[str] = []
        self.steps = 0
        self.open: list[str] = []
        self.step: int | None = None  # how deep the step lies
        self.skip: int | None = None  # how deep the element lies that is left out
        self.blank, self.literal = "", False
        self.bare_comment: int | None = None

    def start(self, tag: str, attrs: list[str]) -> None:
        self.open.append(tag)
        self.blank = ""
        if self.step is None and tag == "Step":
            self.step, self.steps = len(self.open), self.steps + 1
            pairs = dict(zip(attrs[::2], attrs[1::2]))
            self._tag(tag, attrs)
            self.bare_comment = len(self.out) if pairs.get("name") == COMMENT else None
        elif self.step is not None and self.skip is None:
            if tag in LEFT_OUT:
                self.skip = len(self.open)
                return
            if tag == "Restore":
                self.bare_comment = None
            self._tag(tag, attrs)

    def _tag(self, tag: str, attrs: list[str]) -> None:
        self.out.append("<" + tag + "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in zip(attrs[::2], attrs[1::2])) + ">")

    def end(self, tag: str) -> None:
        if self.step is not None and self.skip is None:
            if self.blank and not self.out[-1].startswith("</") and self.out[-1] != RESTORE:
                self.out.append(self.blank if tag != "Text" else self.blank.translate(TEXT_CODES))  # blanks alone are an element's text, not a gap
            self.out.append(f"</{tag}>")
        self.blank = ""
        if self.skip == len(self.open):
            self.skip = None
        if self.step == len(self.open):
            if self.bare_comment is not None:
                self.out.insert(self.bare_comment, RESTORE)
            self.step = self.bare_comment = None
        self.open.pop()

    def text(self, data: str) -> None:
        if self.step is None or self.skip is not None:
            return
        if self.literal:
            self.out.append(data)
        elif data.isspace():
            self.blank += data
        else:
            data, self.blank = escape(self.blank + data), ""
            self.out.append(data.translate(TEXT_CODES) if self.open[-1] == "Text" else data)

    def cdata(self, begins: bool) -> None:
        if self.step is not None and self.skip is None:
            self.out.append("<![CDATA[" if begins else "]]>")
        self.literal, self.blank = begins, ""


def snippet(xml: str) -> tuple[str, int]:
    """The steps of a script definition as one snippet, and their number: parsed and written again, one pass.

    Step texts and the rendered pieces of formulas are left out, gaps between elements too; in Text elements line ends and tabs become references; a
    comment without a Restore element gets one; no element closes itself; all else, literal sections included, is as it was.
    """
    w, parser = _Writer(), expat.ParserCreate()
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = w.start, w.end, w.text
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = (lambda: w.cdata(True)), (lambda: w.cdata(False))
    parser.Parse(xml, True)
    return '<fmxmlsnippet type="FMObjectList">' + "".join(w.out) + "</fmxmlsnippet>", w.steps


def clipboard_class(xml: str) -> str:
    """The class of the snippet's first kind in the order of CLASSES; steps by default."""
    return next((c for tag, c in CLASSES if tag in xml), "XMSS")
