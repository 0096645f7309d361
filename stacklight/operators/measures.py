"""Measured values of a text: numbers beside a unit, numbers behind a unit in brackets, and numbers in table rows.

Formulas are flattened first: digits that a scan has parted are joined within them only, for spaces between numbers mean
something elsewhere.
"""

from __future__ import annotations

import re

# Units, longest first where one begins another; commands of formulas and what they stand for.
UNITS = (
    "MPa", "GPa", "kPa", "K/s", "°C", "℃", "µm", "μm", "wt%", "at%", "vol%", "wt.%", "at.%", "vol.%", "kW", "MW", "kHz", "MHz", "kJ", "kN", "nm", "mm", "cm", "rpm", "ton", "min", "Hz", "mol", "kg", "%", "K", "W", "J",
    "N", "h", "s", "g", "m", "t",
)
COMMANDS = (("circ", "°"), ("%", "%"), ("mu", "µ"), ("pm", "±"), ("times", "x"), ("cdot", "·"))
WRAPPERS = ("mathrm", "text", "mathbf", "mathit", "rm")
MOST_BEHIND_UNIT, MOST_IN_NOTE = 24, 12

_meaning = dict(COMMANDS)
_number = re.compile(r"\d+(?:\.\d+)?")
_by_length = sorted(UNITS, key=len, reverse=True)


def _formula(s: str) -> str:
    """One formula: digits joined across spaces."""
    return " " + re.sub(r"(?<=\d)\.\s+(?=\d)", ".", re.sub(r"(?<=\d)\s+(?=\d)", "", s)) + " "


def flattened(text: str) -> str:
    """The text with formulas as they read: commands as their signs, wrappers and braces off, units whole."""
    parts = text.split("$")
    # Every second part stands between two dollar signs; a last one without its partner is plain text.
    text = "".join(_formula(p) if k % 2 and k < len(parts) - 1 else (p if k % 2 == 0 else "$" + p) for k, p in enumerate(parts))
    for w in WRAPPERS:
        text = re.sub(rf"\\{w}\s*\{{([^{{}}]*)\}}", r"\1", text)
    text = re.sub(r"\\([a-zA-Z]+|%)", lambda m: _meaning.get(m[1], next((_meaning[c] + m[1][len(c) :] for c in ("circ", "pm", "times", "cdot") if m[1].startswith(c)), " ")), text)
    text = re.sub(r"(?<=\d)\.\s+(?=\d)", ".", text.translate(str.maketrans("{}$~^_", " " * 6)))
    text = re.sub(r"[ \t]+", " ", text)
    text = re.sub(r"°\s*C", "°C", text)
    text = re.sub(r"\b(wt|at|vol)\s*\.?\s*%", r"\1%", text)
    return re.sub(r"\b([Km])\s*/\s*s", r"\1/s", text)


def _unit_at(s: str, i: int) -> int:
    """Where the unit that begins at ``i`` ends, or -1; no letter or sign of a unit may follow it."""
    for u in _by_length:
        if s.startswith(u, i):
            end = i + len(u)
            if not (s[end : end + 1].isascii() and s[end : end + 1].isalpha() or s[end : end + 1] in ("°", "µ", "μ") and end < len(s)):
                return end
    return -1


def _behind(s: str, i: int) -> int:
    """The first place from ``i`` on that isn't blank."""
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def measured_values(text: str) -> list[str]:
    """Distinct values as written, without leading zeros, in order of their kind and place."""
    s = flattened(text)
    out: dict[str, None] = {}
    add = lambda v: out.setdefault(v.lstrip("0") if v.lstrip("0")[:1].isdigit() else "0" + v.lstrip("0") if "." in v else "0")
    used = 0
    for m in _number.finditer(s):
        if m.start() < used:  # the uncertainty of the value before
            continue
        at = _behind(s, m.end())
        if s[at : at + 1] == "±" and (n := _number.match(s, _behind(s, at + 1))):
            at = _behind(s, n.end())
        if _unit_at(s, at) >= 0:
            add(m[0])
            used = at
    for m in re.finditer(r"\(([^()]*)\)", s):
        if any(m[1].startswith(u) and len(m[1]) - len(u) <= MOST_BEHIND_UNIT for u in UNITS):
            at = _behind(s, m.end())
            while n := _number.match(s, at):
                add(n[0])
                at = n.end()
                if s[at : at + 1] == "(" and 0 <= (close := s.find(")", at)) - at - 1 <= MOST_IN_NOTE:
                    at = close + 1
                while s[at : at + 1] in (" ", "\t") and at < len(s):
                    at += 1
    for line in s.split("\n"):
        if line.strip().startswith("|") and line.strip().endswith("|") and len(line.strip()) > 1:
            for n in _number.findall(line):
                add(n)
    return list(out)
