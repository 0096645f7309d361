"""Web pages as text: Markdown with headings, emphasis, lists and paragraphs, without scripts, styles and comments."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements without text, elements that part paragraphs, and marks of emphasis.
SILENT = ("script", "style", "noscript")
PARTING = ("p", "div", "section", "article", "header", "footer", "nav", "blockquote", "table", "tr")
EMPHASIS = (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*"))

_marks = dict(EMPHASIS)


class _Page(HTMLParser):
    """Writes Markdown while a page is read; lists keep their own numbers, so nested ones do too."""

    def __init__(self, markdown: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.markdown, self.out, self.silent, self.lists = markdown, [], 0, []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent += 1
        elif tag == "br":
            self.out.append("\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if self.markdown else ""))
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.out.append("\n")
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.out.append(f"\n{self.lists[-1]}. ")
            else:
                self.out.append("\n• ")
        elif tag in PARTING:
            self.out.append("\n\n")
        elif self.markdown and tag in _marks:
            self.out.append(_marks[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.out.append("\n")
        elif tag in PARTING or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif self.markdown and tag in _marks:
            self.out.append(_marks[tag])

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(data)


def page_text(html: str, markdown: bool = True) -> str:
    """The text of a page; spaces are single, blank lines at most one."""
    page = _Page(markdown)
    page.feed(html)
    page.close()
    lines = [re.sub(r"[ \t\xa0]+", " ", x).strip() for x in "".join(page.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def wrapped(text: str, width: int) -> str:
    """Lines of at most ``width`` characters, broken at spaces; a longer word stands alone."""
    out = []
    for line in text.split("\n"):
        held = ""
        for word in line.split(" "):
            if held and len(held) + 1 + len(word) > width:
                out.append(held)
                held = word
            else:
                held = f"{held} {word}" if held else word
        out.append(held)
    return "\n".join(out)
