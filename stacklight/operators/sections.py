"""Which parts of a paper's text are body: reference lists, sections of formalities, images, opaque runs, front matter.

Lines are taken apart by hand and compared with the fixed values below; every function maps one text to one result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache

# Headings of reference lists, of sections of formalities, and of the sections with which a body begins.
REFERENCE_HEADINGS = ("references", "reference", "bibliography", "references and notes", "literature cited", "参考文献", "參考文獻", "引用文献")
FORMAL_HEADINGS = (
    "credit authorship contribution statement", "declaration of competing interest", "declaration of competing interests", "declaration of conflicting interests",
    "conflict of interest", "conflicts of interest", "competing interests", "declaration of generative ai", "acknowledgement", "acknowledgements",
    "acknowledgment", "acknowledgments", "data availability", "data availability statement", "supplementary materials", "supplementary material",
    "supporting information", "author contributions", "funding", "致谢", "作者贡献", "利益冲突", "数据可用性",
)
BODY_HEADINGS = ("introduction", "background", "related work", "literature review", "引言", "前言", "绪论", "緒論", "研究背景")
# Labels of front matter, those of them that open a list of keywords, and the same in running text.
KEYWORD_LABELS = ("keywords", "keyword", "keywordsabstract", "indexterms", "关键词", "關鍵詞")
LABELS = (*KEYWORD_LABELS, "abstract", "graphicalabstract", "highlights", "articleinfo", "articleinformation", "摘要", "发明名称", "实用新型名称", "摘要附图", "作者简介", "基金项目", "通信作者")
KEYWORD_OPENINGS = ("keyword", "key words", "index terms", "关键词", "關鍵詞")
# Bounds of front matter and of its parts.
MAX_PARAGRAPHS, MAX_CHARS, SAME, SAME_AUTHORS, LEAST_ABSTRACT, LEAST_TITLE, MAX_TERM, MAX_TERMS = 25, 8000, 0.95, 0.6, 20, 3, 80, 20
# Words of an affiliation, of an address, and of a record's particulars.
ORGANISATIONS = (
    "department", "dept", "university", "universities", "université", "universite", "institut", "institute", "institutes", "institution", "laboratory", "laboratories",
    "college", "faculty", "school of", "academy", "hospital", "centre", "center for", "co. ltd", "co., ltd", "corporation",
)
ORGANISATIONS_HAN = ("大学", "學院", "学院", "研究所", "研究院", "实验室", "實驗室", "科学院", "集团", "公司")
COUNTRIES = (
    "china", "usa", "u.s.a", "united states", "uk", "united kingdom", "japan", "korea", "germany", "france", "spain", "italy", "canada", "australia",
    "netherlands", "denmark", "sweden", "singapore", "india", "portugal",
)
RECORD_DATES = ("received", "revised", "accepted", "available online", "published online")
RECORD_HAN = ("中图分类号", "文献标志码", "文献标识码", "文章编号", "收稿日期", "修回日期", "网络首发", "基金项目", "作者简介", "通信作者", "通讯作者")
PATENT_OFFICES = ("cn", "us", "ep", "wo", "jp")
IMAGE_FOLDERS = ("image", "images", "figure", "figures")


# --- lines ---


def heading(line: str) -> str | None:
    """The text of a Markdown heading, which may stand in a quotation or emphasis."""
    bare = line.lstrip(" \t>*_")
    if not bare.startswith("#") or not bare[1:].strip():
        return None
    hashes = len(bare) - len(bare.lstrip("#"))
    return bare[min(hashes, 6) :].strip()


def section_name(line: str) -> str:
    """A line without what stands around a section's name: quotation and emphasis, hashes, a number, one mark at the end."""
    bare = line.lstrip(" \t>*_")
    if bare.startswith("#"):
        bare = bare[min(6, len(bare) - len(bare.lstrip("#"))) :].lstrip(" \t")
    number = len(bare) - len(bare.lstrip("0123456789"))
    if number and bare[number : number + 1] in (".", "、", ")"):
        bare = bare[number + 1 :].lstrip(" \t")
    bare = bare.rstrip(" \t\r")
    return (bare[:-1].rstrip(" \t") if bare[-1:] in (":", "：", ".") else bare).lower()


def reference_line(line: str) -> bool:
    """``[12] ...`` with a year in brackets, after a comma or before a semicolon."""
    bare = line.lstrip()
    close = bare.find("]")
    if not bare.startswith("[") or not 2 <= close <= 4 or not bare[1:close].isdecimal():
        return False
    rest = bare[close + 1 :]
    if not rest[:1].isspace() or not rest.strip():
        return False
    for m in re.finditer(r"(?=(\d{4}))", rest):
        before, after = rest[: m.start()], rest[m.start() + 4 :]
        if before.endswith("(") and after.startswith(")") or before.rstrip().endswith(",") or after.startswith(";") and not (before[-1:].isalnum() or before.endswith("_")):
            return True
    return False


def image_line(line: str) -> bool:
    """Nothing but a link or an image, or the path of one."""
    bare = line.strip()
    link = bare.removeprefix("!")
    middle = link.find("]")
    if link.startswith("[") and link[middle + 1 : middle + 2] == "(" and link.find(")", middle) == len(link) - 1:
        return True
    folder, slash, name = bare.partition("/")
    return folder.lower() in IMAGE_FOLDERS and bool(slash and name) and not any(c.isspace() for c in name)


def cut_images(text: str) -> str:
    """Images within the text, as Markdown or as a tag, become a space."""
    out, at = [], 0
    while (i := text.find("![", at)) >= 0:
        j = text.find("]", i)
        k = text.find(")", j) if text[j + 1 : j + 2] == "(" and j > 0 else -1
        out.append(text[at : i if k >= 0 else i + 2])
        if k >= 0:
            out.append(" ")
        at = k + 1 if k >= 0 else i + 2
    text, out, at = "".join([*out, text[at:]]), [], 0
    low = text.lower() if len(text.lower()) == len(text) else text
    while (i := low.find("<img", at)) >= 0:
        k = text.find(">", i)
        tag = k >= 0 and not (text[i + 4].isalnum() or text[i + 4] == "_")
        out += [text[at:i], " "] if tag else [text[at : i + 4]]
        at = k + 1 if tag else i + 4
    return "".join([*out, text[at:]])


def cut_opaque(text: str) -> str:
    """Runs that nobody searches for become a space: 16 hexadecimal digits or more, 32 characters of base64 or more."""

    def one(m: re.Match) -> str:
        run = m[0]
        beside = text[m.start() - 1 : m.start()] == "_" or text[m.end() : m.end() + 1] == "_"
        core = run.strip("+/")
        if len(core) >= 32 and not beside:
            return run.replace(core, " ", 1)
        return "".join(" " if len(p) >= 16 and not beside and all(c in "0123456789abcdefABCDEF" for c in p) else p for p in re.split("([+/])", run))

    return re.sub("[A-Za-z0-9+/]{16,}", one, text)


# --- bodies ---


def references_boundary(text: str) -> int | None:
    """Offset of the last heading of a reference list."""
    found, at = None, 0
    for line in text.split("\n"):
        if section_name(line) in REFERENCE_HEADINGS:
            found = at
        at += len(line) + 1
    return found


def body_for_index(text: str) -> tuple[str, dict[str, int]]:
    """The body without references, sections of formalities, images and opaque runs; characters removed by kind."""
    removed = dict.fromkeys(("references", "boilerplate", "images", "opaque"), 0)
    at = references_boundary(text)
    if at is not None:
        removed["references"] = len(text) - at
        text = text[:at]
    kept, skipping = [], False
    for line in text.split("\n"):
        if heading(line) is not None:
            skipping = section_name(line) in FORMAL_HEADINGS
        if not skipping:
            kept.append(line)
    bare = "\n".join(kept)
    removed["boilerplate"] = len(text) - len(bare)
    lines = [x for x in cut_images(bare).split("\n") if not image_line(x) and not reference_line(x)]
    text = "\n".join(lines)
    removed["images"] = max(0, len(bare) - len(text))
    bare = cut_opaque(text)
    removed["opaque"] = max(0, len(text) - len(bare))
    return bare.strip(), removed


def no_body(text: str) -> bool:
    """Whether a chunk opens with the heading of formalities or references, or half of its lines or more are references or images."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return True
    odd = sum(reference_line(x) or image_line(x) for x in lines)
    return section_name(lines[0].strip()) in (*FORMAL_HEADINGS, *REFERENCE_HEADINGS) or odd * 2 >= len(lines)


# --- front matter ---


def letters(s: str) -> str:
    """Letters and digits only, in lower case, so that spaced-out words are words again."""
    return "".join(c for c in unicodedata.normalize("NFKC", s or "").lower() if c.isalnum())


def tokens(s: str) -> list[str]:
    """Words and single Han characters to compare by; formulas, tags and links are left out."""
    for opaque in (r"\$\$.*?\$\$", r"\$[^$\n]*\$", "<[^>]+>"):
        s = re.sub(opaque, " ", s or "", flags=re.S)
    return re.findall("[a-z0-9]+|[㐀-鿿]", unicodedata.normalize("NFKC", cut_images(s)).lower())


def containment(needle: list[str], hay: list[str]) -> float:
    """Share of the needle's tokens, with repeats, that the other has."""
    a, b = Counter(needle), Counter(hay)
    return sum(min(n, b[t]) for t, n in a.items()) / max(1, sum(a.values()))


@cache
def _keys(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(map(letters, words))


def _opens_body(title: str) -> bool:
    return letters(title).lstrip("0123456789") in _keys(BODY_HEADINGS)


def _word_in(words: tuple[str, ...], s: str) -> bool:
    return any((i := s.find(w, at)) >= 0 and not s[i - 1 : i].isalnum() * (i > 0) and not s[i + len(w) : i + len(w) + 1].isalnum() for w in words for at in _starts(w, s))


def _starts(word: str, s: str) -> list[int]:
    return [m.start() for m in re.finditer(re.escape(word), s)]


def front_limit(parts: list[str]) -> int:
    """The paragraph at which front matter ends at the latest: a numbered or known section, or its bounds."""
    size = 0
    for k, p in enumerate(parts[:MAX_PARAGRAPHS]):
        title = heading(p.strip().split("\n")[0]) if p.strip().startswith("#") else None
        if title is not None and (_opens_body(title) or title[:1].isdecimal() and len(title.split(None, 1)) == 2 and not title.split(None, 1)[0].strip("0123456789.．、)）")):
            return k
        size += len(p)
        if size > MAX_CHARS:
            return k
    return min(len(parts), MAX_PARAGRAPHS)


def affiliation(p: str) -> bool:
    """An organisation with an address or a mark before it."""
    low = p.strip().lower()
    if len(low) > 500 or not (_word_in(ORGANISATIONS, low) or any(w in low for w in ORGANISATIONS_HAN)):
        return False
    marked = low.startswith("$") and "$" in low[1:14] or low[1:2] == ")" and low[:1].isalnum() and len(low) > 2
    end = low.rstrip(" .;")
    place = any(4 <= len(d) <= 6 for d in re.findall(r"(?<![\w])\d+(?![\w])", low)) or any(end.endswith(c) and not end[: -len(c)][-1:].isalnum() for c in COUNTRIES)
    return marked or place or bool(re.search("[，,] *[一-鿿]{2,}[省市区县]", low))


def record_line(p: str) -> bool:
    """Identifiers, dates and classification codes that belong to the record; cover sheets and numbers of patents."""
    low = p.strip().lower()
    codes = re.findall(r"[（(]\s*\d\d\s*[)）]\s*\S", low)
    if any(w in low for w in ("doi:", "doi：", "doi :", "doi.org/", "all rights reserved", *RECORD_HAN)) or _word_in(("issn", "isbn"), low) or low.startswith("©"):
        return True
    if re.search(r"arxiv: *\d{4}\.\d{4,5}", low) or codes and low[:1] in "（(" and low.startswith(codes[0]) or len(codes) >= 3 and len(p) <= 2000:
        return True
    if any(re.search(r"\b(?:19|20)\d\d\b", low[i : i + len(w) + 46].split("\n")[0]) for w in RECORD_DATES for i in _starts(w, low)):
        return True
    office, number = low[:2], low[2:].replace(" ", "")
    return office in PATENT_OFFICES and bool(re.fullmatch(r"\d{6,}[a-z]\d?", number))


def _keyword_line(p: str) -> bool:
    bare = re.sub(r"\s+", " ", p.lstrip(" \t>*_#").lower())
    return bare.startswith(KEYWORD_OPENINGS) or letters(bare[:8]).startswith(KEYWORD_OPENINGS[3:])


def _term(p: str) -> bool:
    """Whether a paragraph behind a label of keywords is still one of them: short, no sentence within it, no section's name."""
    s = p.strip()
    return bool(s) and len(s) <= MAX_TERM and not re.search(r"[.。！？!?]\s+\S", s) and not _opens_body(s)


def front_matter(text: str, title: str, abstract: str, authors: str) -> tuple[str, dict[str, int]]:
    """The text without opening paragraphs that repeat its record; characters removed by kind.

    Labels, the abstract, the title in a paragraph of its size, authors, affiliations, keywords in the line of their label or
    in paragraphs behind it, and particulars of the record go. Behind the abstract, the second paragraph in a row that nothing claims ends it."""
    removed = dict.fromkeys(("title", "abstract", "authors", "affiliations", "keywords", "record", "labels"), 0)
    parts = re.split(r"\n\s*\n+", text)
    limit = front_limit(parts)
    if limit == 0 or not text.strip():
        return text, removed
    want_title, want_abstract, want_authors = tokens(title), tokens(abstract), tokens(authors)
    kept: list[str] = []
    terms: int | None = None
    found_abstract, unclaimed = False, None
    for k, p in enumerate(parts[:limit]):
        s = p.strip()
        name = heading(s) if s.startswith("#") and "\n" not in s else None
        body = name if name is not None else s
        kind, opens = None, False
        if terms is not None and s and name is None and terms < MAX_TERMS and _term(s):
            kind, opens = "keywords", True
        elif s:
            has = tokens(body)
            label = letters(re.sub(r"^\s*[（(]\s*\d{1,3}\s*[)）]", "", name)) if name is not None else None
            if label is not None and label in _keys(LABELS):
                kind = "labels"
            elif len(want_abstract) >= LEAST_ABSTRACT and containment(want_abstract, has) >= SAME:
                kind, found_abstract = "abstract", True
            elif len(want_title) >= LEAST_TITLE and len(body) <= 1.6 * len(title.strip()) + 20 and containment(want_title, has) >= SAME:
                kind = "title"
            elif want_authors and len(body) <= 600 and containment(want_authors, has) >= SAME_AUTHORS:
                kind = "authors"
            elif affiliation(body):
                kind = "affiliations"
            elif _keyword_line(s):
                kind = "keywords"
            elif record_line(s):
                kind = "record"
            opens = kind == "keywords" or kind == "labels" and label in _keys(KEYWORD_LABELS)
        terms = (0 if terms is None or kind != "keywords" or not _term(s) else terms + 1) if opens else None
        if kind:
            removed[kind] += len(p)
            continue
        if s and found_abstract and unclaimed == k - 1:
            return "\n\n".join([*kept, *parts[k:]]).strip(), removed
        if s:
            unclaimed = k
        kept.append(p)
    return "\n\n".join([*kept, *parts[limit:]]).strip(), removed
