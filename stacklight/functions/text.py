"""Text functions as Column expressions; what only Python can do is at the end, as pandas functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Dashes and primes that are folded to "-" and "'"; Greek letters with their Latin spellings.
DASHES = "‐‑‒–—―−－"
PRIMES = "′″ʹ‘’‛＇"
GREEK = (
    ("α", "alpha"), ("β", "beta"), ("γ", "gamma"), ("δ", "delta"), ("ε", "epsilon"), ("ζ", "zeta"), ("η", "eta"),
    ("θ", "theta"), ("κ", "kappa"), ("λ", "lambda"), ("μ", "mu"), ("ν", "nu"), ("ξ", "xi"), ("π", "pi"), ("ρ", "rho"),
    ("σ", "sigma"), ("τ", "tau"), ("φ", "phi"), ("χ", "chi"), ("ψ", "psi"), ("ω", "omega"),
)
HAN = "㐀-䶿一-鿿豈-﫿"
CORE = "A-Za-z0-9À-ɏͰ-Ͽ"
LATIN_TOKEN = rf"[{CORE}]+(?:['\-_./][{CORE}]+)*'*"


def _compatible() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form is one other character, and these forms; built from the rule."""
    pairs = [(c, n) for c in map(chr, [*range(0xA0, 0xD800), *range(0xE000, 0x10000)]) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c and c not in DASHES + PRIMES]
    return "".join(c for c, _ in pairs), "".join(n for _, n in pairs)


# What folding replaces, character by character: compatibility forms, dashes, primes.
_from, _to = _compatible()
_to = _to.translate(str.maketrans({**dict.fromkeys(DASHES, "-"), **dict.fromkeys(PRIMES, "'")}))
FOLD_FROM, FOLD_TO = _from + DASHES + PRIMES, _to + "-" * len(DASHES) + "'" * len(PRIMES)


def fold(text: Column) -> Column:
    """Compatibility forms of one character, dashes, primes and case folded (forms of several characters: see ``nfkc``)."""
    return F.lower(F.translate(text, FOLD_FROM, FOLD_TO))


def has_han(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{HAN}]"))


def indexable(token: Column) -> Column:
    return (F.length(token) >= 2) | F.rlike(token, F.lit("^[Ͱ-Ͽ]$"))


def spelled(token: Column) -> Column:
    """Greek letters written out."""
    return reduce(lambda c, g: F.replace(c, F.lit(g[0]), F.lit(g[1])), GREEK, token)


def solid(token: Column) -> Column:
    return F.regexp_replace(token, r"[-_./]", "")


def variants(token: Column) -> Column:
    """The token, its solid form, and both with Greek letters written out; indexable ones, once each."""
    s = spelled(token)
    full = F.array_distinct(F.filter(F.array(token, solid(token), s, solid(s)), indexable))
    # Most tokens have neither a separator nor a Greek letter: their only form is themselves.
    return F.when(F.rlike(token, F.lit("[-_./Ͱ-Ͽ]")), full).otherwise(F.array(token))


def latin_tokens(folded: Column) -> Column:
    return F.filter(F.regexp_extract_all(folded, F.lit(LATIN_TOKEN), F.lit(0)), indexable)


def han_bigrams(folded: Column) -> Column:
    runs = F.regexp_extract_all(folded, F.lit(f"[{HAN}]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.flatten(F.transform(runs, pairs))


def query_tokens(text: Column) -> Column:
    """Tokens of a query: as written, without variants."""
    f = fold(text)
    return F.concat(latin_tokens(f), han_bigrams(f))


def index_tokens(text: Column) -> Column:
    """Tokens of an indexed text: Latin tokens with their variants, and Han pairs. Repeats stay: they are the frequency."""
    f = fold(text)
    return F.concat(F.flatten(F.transform(latin_tokens(f), variants)), han_bigrams(f))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\f\r]+", " "))


def cut_evidence(text: Column, limit: int = 220) -> Column:
    """Spaces collapsed; cut to ``limit`` characters with an ellipsis."""
    s = squeeze(text)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("…"))).otherwise(s)


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def chunk_language(text: Column) -> Column:
    """zh where more than 0.3 of what isn't space is Han."""
    rest = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when((rest > 0) & (han_count(text) / rest > 0.3), "zh").otherwise("en")


def document_language(declared: Column, text: Column) -> Column:
    """The declared language where it is known; else by the counts of Han and Latin letters."""
    d = F.lower(F.trim(declared))
    han, latin = han_count(text), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(d.startswith("zh"), "zh").when(d.startswith("en"), "en").when(han == 0, "en").when(han * 2 >= latin, "zh").otherwise("en")


def token_estimate(text: Column) -> Column:
    han = han_count(text)
    return F.ceil(han * 1.5 + (F.length(text) - han) / 4).cast("long")


def text_hash(text: Column) -> Column:
    """SHA-256 of the trimmed text with single spaces."""
    return F.sha2(squeeze(text), 256)


def char_bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; the text is cut into characters once."""
    c = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda x, y: F.concat(x, y)))


def bigram_codes(text: Column) -> Column:
    """``char_bigrams`` as numbers, one to one: small enough to be made once per text and joined."""
    c = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda x: F.ascii(x).cast("long"))
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda x, y: x * F.lit(1 << 21) + y))


def bigram_overlap(a: Column, b: Column) -> Column:
    """1 where b contains a; else the share of a's distinct character pairs that b has."""
    x = char_bigrams(a)
    return F.when((F.length(a) > 0) & F.contains(b, a), F.lit(1.0)).when(F.length(a) < 2, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, char_bigrams(b))) / F.size(x))


def boundary(text: Column) -> Column:
    """Whether a text's first line is a heading of a section that carries no body."""
    line = F.regexp_replace(F.split(F.trim(text), "\n")[0], r"^\s*(?:>+\s*)?(?:#{1,6}\s*)?(?:[-*+]\s+)?(?:\d+[.)]\s+)?[*_~`\s]*", "")
    return F.rlike(line, F.lit(BOILERPLATE))


# Openings of sections without a body of their own.
BOILERPLATE = (
    r"(?i)^(?:(?:references|bibliography)\b|参考文献|引用文献|acknowledg(?:e)?ments?\b|致谢|鸣谢|(?:conflicts? of interest|declaration of competing interest)\b"
    r"|利益冲突|funding\b|资助|基金项目|author contributions?\b|作者贡献|(?:supplementary|supporting information)\b|附录|data availability\b|数据可用性)"
)


def reference_list(text: Column) -> Column:
    """Many bracketed numbers, or many years beside many "et al"."""
    n = F.regexp_count(text, F.lit(r"\[\d{1,3}\]"))
    years, others = F.regexp_count(text, F.lit(r"\(?(?:19|20)\d{2}[)a-z]?")), F.regexp_count(text, F.lit(r"(?i)et al\.?"))
    return ((n >= 5) & (n / (F.greatest(F.length(text), F.lit(1)) / 200) >= 3)) | ((years >= 6) & (others >= 3))


def clean_for_index(text: Column) -> Column:
    """Line ends, spaces, control characters and blank lines made regular."""
    t = F.regexp_replace(text, r"\r\n|\r", "\n")
    t = F.regexp_replace(t, "[\\t\\u00a0\\u2000-\\u200b]", " ")
    t = F.regexp_replace(t, r" {3,}", "  ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]+$", "")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def quality(text: Column) -> Column:
    """100 less 40 for few letters, 30 for much punctuation, 30 for runs of it, 20 for short lines; 0 for an empty text."""
    full = F.length(F.regexp_replace(text, r"\s", ""))
    letters = F.regexp_count(text, F.lit("[a-zA-Z一-龥]"))
    marks = F.regexp_count(text, F.lit("[，。、；：！？…—,.;:!?\"'()\\[\\]-]"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    mean = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.size(lines), F.lit(1))
    score = (
        F.lit(100)
        - F.when(letters / F.greatest(full, F.lit(1)) < 0.4, 40).otherwise(0)
        - F.when(marks / F.greatest(F.length(text), F.lit(1)) > 0.25, 30).otherwise(0)
        - F.when(F.rlike(text, F.lit("[，。、；：,.;:]{4,}")), 30).otherwise(0)
        - F.when((F.size(lines) > 5) & (mean < 15), 20).otherwise(0)
    )
    return F.when(F.length(F.trim(text)) == 0, 0).otherwise(F.greatest(score, F.lit(0)))


def pdf_clean(text: Column) -> Column:
    """Hyphenated line ends joined, single line ends unwrapped, odd spaces made plain."""
    t = F.regexp_replace(text, "[\\u00a0\\u2000-\\u200b]", " ")
    t = F.regexp_replace(t, r"(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"([^\n])\n([^\n])", "$1 $2")
    return F.trim(F.regexp_replace(t, r"[ \t]+", " "))


# Roots below which a path is a local one.
LOCAL_ROOTS = "home|Users|users|root|tmp|var|private|mnt|media|opt|srv|Volumes|data"


def redact(text: Column, mark: str = "[local path]") -> Column:
    """Local absolute paths replaced; http, https and ftp addresses stay. A guard keeps addresses from being cut inside."""
    c = r"[^\s\"'<>|?*,;:()\[\]{}]"
    local = rf"file://{c}*|(?<![A-Za-z0-9])[A-Za-z]:[\\/]{c}*|\\\\\\\\{c}+|(?<![\w.])/(?:{LOCAL_ROOTS})/{c}*|(?<![\w.])/(?:{c}+/)+{c}+\.[A-Za-z0-9]{{1,8}}\b"
    # An address is marked at its head, so that the look-behind of the path pattern sees it.
    shielded = F.regexp_replace(text, rf"((?:https?|ftp)://)({c}*)", "\u0001$1$2\u0002")
    parts = F.split(shielded, "(?=\u0001)|(?<=\u0002)")
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\u0001"), F.translate(p, "\u0001\u0002", "")).otherwise(F.regexp_replace(p, local, mark))), "")


def citations(text: Column) -> Column:
    """Cited chunk numbers in order, once each: "chunk 3", "chunks 4-6, 9", 第n段; falling or too wide ranges give none."""
    whole = F.regexp_extract_all(text, F.lit(r"(?i)(?:\bchunks?|块|段)\s*[:：#]?\s*\d+(?:\s*(?:[-–—]|to|~|、|,|，)\s*\d+)*|第\s*\d+\s*(?:块|段)"), F.lit(0))
    parts = F.flatten(F.transform(whole, lambda g: F.split(F.regexp_replace(g, r"(?i)^(?:chunks?|块|段|第)\s*[:：#]?\s*|\s*(?:块|段)$", ""), r"\s*[、,，]\s*")))
    ends = F.transform(parts, lambda p: F.transform(F.split(p, r"(?i)\s*(?:[-–—]|to|~)\s*"), lambda e: F.try_to_number(F.trim(e), F.lit("999999999")).cast("long")))
    fine = F.filter(ends, lambda e: (F.size(e) <= 2) & e[0].isNotNull() & F.element_at(e, -1).isNotNull() & (F.element_at(e, -1) >= e[0]) & (F.element_at(e, -1) - e[0] <= 10000))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fine, lambda e: F.sequence(e[0], F.element_at(e, -1))))))


# Units of measured values.
UNITS = "MPa|GPa|kPa|Pa|rpm|mm|nm|µm|μm|cm|kJ/mol|S/cm|at\\.%|wt%|%|°C|K|Hz|eV|mA|V|N|h|s"


def measurements(text: Column) -> Column:
    """"value unit" strings, with leading zeros of values off, once each in order of appearance."""
    m = F.regexp_extract_all(text, F.lit(rf"\d+(?:\.\d+)?\s?(?:{UNITS})(?![A-Za-z])"), F.lit(0))
    return F.array_distinct(F.transform(m, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s", ""), r"^0+(?=\d)", "")))


def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility forms; for ``pandas_udf``."""
    return values.map(lambda s: unicodedata.normalize("NFKC", s) if isinstance(s, str) else s)
