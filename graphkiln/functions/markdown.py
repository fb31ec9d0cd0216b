"""HTML to Markdown, Markdown structure and chunking, as plain Python over the standard library for use in Arrow UDFs and UDTFs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements by how they are written.
SKIP = frozenset("script style noscript iframe head template".split())
BLOCK = frozenset("p div section article main header footer aside nav blockquote figure figcaption form address body html center fieldset dl dt dd".split())
HEADINGS = {f"h{k}": k for k in range(1, 7)}
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


@dataclass
class _Table:
    rows: list[list[str]] = field(default_factory=list)
    head: bool = False


class _Writer(HTMLParser):
    """Blocks of Markdown in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.prefix = ""
        self.skipped = 0
        self.lists: list[list] = []
        self.tables: list[_Table] = []
        self.link: str | None = None
        self.title = ""
        self.in_title = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(self.prefix + text)
        self.prefix = ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag == "table":
            self.flush()
            self.tables.append(_Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
            self.text = []
        elif tag in ("td", "th") and self.tables:
            self.text = []
            self.tables[-1].head |= tag == "th" and len(self.tables[-1].rows) <= 1
        elif tag in HEADINGS:
            self.flush()
            self.prefix = "#" * HEADINGS[tag] + " "
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            kind, number = self.lists[-1] if self.lists else ("ul", 0)
            self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{number}. " if kind == "ol" else "- ")
        elif tag == "br":
            self.text.append(" ")
        elif tag in ("b", "strong"):
            self.text.append("**")
        elif tag == "a":
            self.link = dict(attrs).get("href")
            if self.link:
                self.text.append("[")
        elif tag in BLOCK and not self.tables:
            self.flush()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(" ".join("".join(self.text).split()).replace("|", r"\|"))
            self.text = []
        elif tag == "table" and self.tables:
            self.write(self.tables.pop())
        elif tag in ("ul", "ol"):
            self.flush()
            if self.lists:
                self.lists.pop()
        elif tag in ("b", "strong"):
            self.text.append("**")
        elif tag == "a":
            if self.link:
                self.text.append(f"]({self.link})")
            self.link = None
        elif tag in HEADINGS or tag == "li" or (tag in BLOCK and not self.tables):
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.skipped:
            self.text.append(data)

    def write(self, table: _Table) -> None:
        rows = [r for r in table.rows if r]
        if not rows:
            return
        width = max(map(len, rows))
        head = rows.pop(0) if table.head else [f"Col{k}" for k in range(1, width + 1)]
        line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
        self.out.append("\n".join([line(head), line(["---"] * width), *map(line, rows)]))


def html_to_markdown(html: str | None) -> str:
    writer = _Writer()
    writer.feed(html or "")
    writer.close()
    writer.flush()
    joined = ""
    for part in writer.out:
        item = re.match(r"\s*(?:-|\d+\.) ", part)
        joined += ("\n" if item and re.search(r"(?:^|\n)\s*(?:-|\d+\.) [^\n]*$", joined) else "\n\n" if joined else "") + part
    return re.sub(r"\n{3,}", "\n\n", joined).strip()


def html_title(html: str | None) -> str:
    writer = _Writer()
    writer.feed(html or "")
    writer.close()
    return " ".join(writer.title.split())


#: Abbreviations that end in a full stop without ending a sentence.
ABBREVIATIONS = frozenset("ts. ths. pgs. gs. tp. qđ. đh. vd. stt. v.v. dr. mr. mrs. ms. prof. st. no. vs. etc. e.g. i.e. z.b. bzw. sr. sra.".split())
_END = re.compile(r"[.!?;。！？]+(?=\s+[\w\-*+\"'(\[])")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def sentences(text: str) -> list[str]:
    """Split after an end mark before white space and an upper-case letter, digit or list mark; not after abbreviations."""
    found, start = [], 0
    for m in _END.finditer(text):
        after = text[m.end() :].lstrip()[:1]
        last = text[start : m.end()].split()[-1].lower() if text[start : m.end()].split() else ""
        if not (after.isupper() or after.isdigit() or after in "-*+") or last in ABBREVIATIONS:
            continue
        found.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*found, text[start:].strip()] if s]


def count(text: str) -> int:
    return len(_TOKEN.findall(text))


def token_windows(text: str, most: int, overlap: int) -> list[str]:
    """Windows of ``most`` tokens, each ``most - overlap`` after the one before; the tail stays."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    step = max(1, most - overlap)
    return [text[spans[k][0] : spans[min(k + most, len(spans)) - 1][1]] for k in range(0, len(spans), step)]


def sections(markdown: str) -> list[tuple[str, str]]:
    """(heading path joined by ' > ', body), blank bodies left out."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in markdown.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else re.match(r"(#{1,6})\s+(.+?)\s*#*$", line)
        if not m:
            out[-1][1].append(line)
            continue
        level = len(m[1])
        stack = [x for x in stack if x[0] < level] + [(level, m[2])]
        out.append((" > ".join(x[1] for x in stack), []))
    return [(path, "\n".join(body).strip()) for path, body in out if "\n".join(body).strip()]


def blocks(text: str) -> list[str]:
    """Fences, tables, lists and paragraphs, each whole."""
    out: list[tuple[str, list[str]]] = []
    fenced = False
    for line in text.split("\n"):
        mark = line.lstrip().startswith("```")
        kind = "fence" if fenced or mark else "" if not line.strip() else "table" if line.count("|") >= 2 else "list" if re.match(r"\s*(?:[-*+]|\d+[.)])\s", line) else "text"
        fenced ^= mark
        if out and (out[-1][0] == kind or (kind == "text" and out[-1][0] == "list" and line.startswith("  "))):
            out[-1][1].append(line)
        else:
            out.append((kind, [line]))
    return ["\n".join(lines) for kind, lines in out if kind]


def _pieces(block: str, most: int, overlap: int) -> list[str]:
    if count(block) <= most:
        return [block]
    out: list[str] = []
    for sentence in sentences(block):
        if count(sentence) <= most:
            out.append(sentence)
            continue
        for clause in re.split(r"(?<=[;:])\s+|\n+", sentence):
            out += [clause] if count(clause) <= most else token_windows(clause, most, overlap)
    return [p for p in out if p.strip()]


def chunk(markdown: str | None, strategy: str = "section", most: int = 100, overlap: int = 20, least: int = 15) -> list[tuple[int, str, str]]:
    """(index, section, text): pieces packed up to ``most`` tokens; tiny ones join the one before if that stays near ``most``."""
    text = re.sub(r"\A\s*# [^\n]*\n?", "", markdown or "", count=1)
    if strategy == "fixed":
        parts = [("", token_windows(text, most, overlap))]
    elif strategy == "sentence":
        parts = [("", [p for s in sentences(text) for p in _pieces(s, most, overlap)])]
    else:
        parts = [(path, [p for b in blocks(body) for p in _pieces(b, most, overlap)]) for path, body in sections(text)]
    out: list[tuple[str, str]] = []
    for path, pieces in parts:
        packed: list[list[str]] = []
        sizes: list[int] = []
        for piece in pieces:
            n = count(piece)
            fits = strategy != "fixed" and packed and (sizes[-1] + n <= most or (n < least and sizes[-1] + n <= most + overlap))
            if fits:
                packed[-1].append(piece)
                sizes[-1] += n
            else:
                packed.append([piece])
                sizes.append(n)
        out += [(path, "\n".join(p)) for p in packed]
    return [(k, path, text) for k, (path, text) in enumerate(out)]


def split_by_chars(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters, cut between blocks, else lines, else words, else anywhere."""
    for mark in ("\n\n", "\n", " "):
        if len(text) <= most:
            return [text] if text.strip() else []
        units = text.split(mark)
        if len(units) > 1:
            out, held = [], ""
            for unit in units:
                joined = held + mark + unit if held else unit
                if len(joined) <= most:
                    held = joined
                else:
                    out += split_by_chars(held, most) if held else []
                    held = unit
            return out + split_by_chars(held, most)
    return [text[k : k + most] for k in range(0, len(text), most)]
