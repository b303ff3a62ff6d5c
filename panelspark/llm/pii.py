"""Personal data with offset-preserving deobfuscation.

Four kinds are found by plain patterns in the text as it stands (base spans). A transducer then
rewrites disguises - homoglyphs and foreign digits, invisible characters, spelled digits, "(at)",
"[dot]", "name at host dot com" and "name at host.com" - and remembers for each rewritten piece where it came from. The
same patterns run over the rewritten text, and what they find there is mapped back to source
characters. Such a span is added if it holds at least one rewritten piece; base spans stay.

A lone digit word is rewritten if a dot stands between it and another letter or digit. Spoken digits
grouped by comma or line end are put together if groups in a row make a card or, after "plus", a
phone number. "at" before a host with plain dots is rewritten unless the word before it commonly leads to
a place ("me at host.com", LEADS) or the host starts with "www."; the host must end in a lower-case or
all upper-case label of letters. "@" with a blank behind it counts like "at" ("jane @ host . com"; a blank
before it alone is a handle, "thanks @host.com"). Dots with blanks on both sides are put together in
such a host, and between four numbers that make an address. Digits in three or more groups joined by dots
are a card if Luhn holds, but for thousands (all groups after the first of three digits). Gaps, labels
and hosts may have any length.

Patterns are applied leftmost and without overlap per kind; a match that fails its check (octets,
Luhn, digit count) is dropped and not retried. All scans are linear in the text's length.

Defined results: a null or empty text has no spans; ids and repeated rows pass through; an empty
table gives no rows. Only the two named columns are read, so other columns cannot clash (``redact``
keeps the table's other columns).
"""

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits that already failed, so only run starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_SOME_IP = re.compile(r"\.[0-9]+\.[0-9]")
_SOME_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append((start, end))
        at = text.find("@", max(end, at + 1))
    return found


def _octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _luhn(match: str) -> bool:
    digits = [ord(c) - 48 for c in match if "0" <= c <= "9"]
    if not 16 <= len(digits) <= 19:
        return False
    twice = [(2 * d - 9 if d > 4 else 2 * d) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def _callable(match: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in match) <= 15


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) in code points, by kind and start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _SOME_IP.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    if _SOME_CARD.search(text):
        found += [("card", *m.span()) for m in _CARD_RUN.finditer(text) if _luhn(m[0])]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if _callable(m[0])]
    return found


# Look-alike letters, and the digit words of four languages.
_LOOKALIKES = dict(
    zip(
        "абеорсухіјѕԁкмнтвАВЕКМНОРСТУХІЈЅαονιρκυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "a6eopcyxijsdkmhtbABEKMHOPCTYXIJSaovipkuABEZHIKMNOPTYX",
        strict=True,
    )
)
_DIGIT_WORDS = {
    w: str(d)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for d, w in enumerate(words.split())
} | {"oh": "0"}
#: Words before "at" that speak of a place and not of a mailbox. Names that mailboxes have (info, support,
#: team ...) are none, since a whole host follows.
LEADS = frozenset(
    "a about all am and are arrive arrived available based be been being blog bought browse browsing build built "
    "but buy check checked click code coming details documentation documents done download downloads everything "
    "files find for forum found free from further get go going guide had has have he her here him homepage hosted "
    "how i images in information is it join joined learn link links listed lives located look looked looking "
    "looks manual maintained me meet met more not now of on online only or our out page pages photos point "
    "pointed points posted published read reading register released remain resource see seen shopping she sign "
    "site sold source starts stay started store stored study stuff that the them then there they this those today "
    "try up updates us video videos view visit was we website were what when where who with work worked working "
    "works write you".split()
)
_INVISIBLE = "­​‌‍⁠﻿"


def _lookalike_table() -> dict[str, str]:
    """Look-alike letters, dots, hyphens and spaces, and by rule every wide, styled or foreign form
    whose compatibility form is one ASCII character, and every decimal digit."""
    table = dict(_LOOKALIKES) | {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "−": "-", " ": " "}
    table |= {chr(c): "-" for c in range(0x2010, 0x2016)} | {chr(c): " " for c in range(0x2000, 0x200B)}
    for block in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800), range(0x2460, 0x24FF)):
        for c in map(chr, block):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[c] = plain
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table


_TABLE = _lookalike_table()
_STRANGE = frozenset(_TABLE) | frozenset(_INVISIBLE)
_WORDS = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_RUN = re.compile(rf"(?<![^\W_])(?:plus[ -]+)?(?:(?:{_WORDS}|[0-9]+)[ -]+)+(?:{_WORDS}|[0-9]+)(?![^\W_])", re.I)
_RUN_PART = re.compile(rf"(plus)|({_WORDS})|([0-9]+)", re.I)
_TWO_WORDS = re.compile(rf"(?:{_WORDS})[ -]+(?:{_WORDS})", re.I)
_BY_DOT = re.compile(rf"(?<=[^\W_]\.)(?:{_WORDS})(?![^\W_])|(?<![^\W_])(?:{_WORDS})(?=\.[^\W_])", re.I)
_ITEM = rf"(?:{_WORDS}|[0-9]+)"
_GROUPS = re.compile(rf"(?<![^\W_])(?:plus[ \t,\r\n-]+)?(?:{_ITEM}[ \t,\r\n-]+)+{_ITEM}(?![^\W_])", re.I)
_GROUP = re.compile(rf"(?:plus[ \t,\r\n-]+)?{_ITEM}(?:[ \t-]+{_ITEM})*", re.I)
_TWO_IN_ROW = re.compile(rf"(?:{_WORDS})[ \t,\r\n-]+(?:{_WORDS})", re.I)
_AT = r"(?:at|arroba|@)"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_DOT = rf"(?:{_DOT_WORD}|\.)"
# Gaps and labels are possessive and tried only from where they begin, so that every scan stays linear.
_GAP, _BLANKS, _LABEL = r"[ \t]*+", r"[ \t]++", r"[A-Za-z0-9-]++"
_OPEN, _CLOSE = rf"(?<![ \t]){_GAP}[\[({{<]{_GAP}", rf"{_GAP}[\])}}>]{_GAP}"
_SPACED_DOT = rf"{_BLANKS}\.{_BLANKS}"
# In a host of spaced dots a label of mixed case begins the next sentence.
_SPACED_HOST = rf"{_LABEL}(?:{_SPACED_DOT}(?-i:[a-z0-9-]++|[A-Z0-9-]++)(?![\w-]))++"
_DISGUISE = re.compile(
    rf"(?P<at>{_OPEN}{_AT}{_CLOSE})"
    rf"|(?P<dot>{_OPEN}{_DOT}{_CLOSE})"
    rf"|(?P<at_word>(?<=[\w.+%-]){_BLANKS}(?:at|arroba){_BLANKS}"
    rf"(?={_LABEL}(?:{_BLANKS}{_DOT_WORD}{_BLANKS}|{_GAP}[\[({{<]{_GAP}(?:{_DOT_WORD}\b|\.))))"
    rf"|(?P<at_host>(?<=[\w.+%-])(?:{_BLANKS}(?:at|arroba){_BLANKS}|{_GAP}@{_BLANKS}|@(?={_SPACED_HOST}))(?!www\.)"
    rf"(?=(?P<host>{_LABEL}(?:\.{_LABEL})++|{_SPACED_HOST})"
    rf"(?:(?P<more>{_BLANKS}{_DOT_WORD}{_BLANKS}[\w-]|{_GAP}[\[({{<]{_GAP}{_DOT}{_GAP}[\])}}>])"
    r"|(?![A-Za-z0-9_-]|\.[A-Za-z0-9]))))"
    rf"|(?P<dot_word>(?<=[\w-]){_BLANKS}{_DOT_WORD}{_BLANKS}(?=[\w-]))",
    re.I,
)
_AT_HOST = re.compile(rf"a(?:t|rroba){_BLANKS}[a-z0-9-]++(?:\.[a-z0-9-]|{_SPACED_DOT})")
_SPACED_AT = re.compile(rf"[\w.+%-](?:{_GAP}@{_BLANKS}|@[a-z0-9-]++{_SPACED_DOT})[a-z0-9-]")
_GAPS = re.compile(_SPACED_DOT)
_SOME_SPACED_IP = re.compile(rf"[0-9]{_SPACED_DOT}[0-9]")
_SPACED_IP = re.compile(rf"(?<![\w.])[0-9]++(?:{_SPACED_DOT}[0-9]++){{3}}(?!\w)")
_SOME_DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]")
_DOTTED = re.compile(r"(?<![\w.])[0-9]++(?:\.[0-9]++){2,}+(?!\w)")
_LAST_WORD = re.compile(r"[\w.+%-]+\Z")
_BRACKETED = re.compile(rf"[\[({{<]{_GAP}(?:{_AT}|\.)")
_SPOKEN = frozenset(_DIGIT_WORDS)


class Rewritten:
    """A text with pieces replaced, and the way back to source positions."""

    def __init__(self, text: str):
        self.text, self.starts, self.pieces = text, [0], [(0, len(text), False)]

    def replace(self, sites: list[tuple[int, int, str]]) -> None:
        """``sites`` (start, end, replacement), ordered, in the present text."""
        out, starts, pieces, size, at = [], [], [], 0, 0

        def put(words, source):
            nonlocal size
            starts.append(size)
            pieces.append(source)
            out.append(words)
            size += len(words)

        def keep(a, b):
            while a < b:  # piece by piece, so that earlier rewrites keep their origin
                i = bisect_right(self.starts, a) - 1
                stop = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
                low, high, changed = self.pieces[i]
                shift = a - self.starts[i]
                source = (low, high, True) if changed else (low + shift, low + shift + stop - a, False)
                put(self.text[a:stop], source)
                a = stop

        for a, b, words in sites:
            keep(at, a)
            if words:
                put(words, (self.back(a)[0], self.back(b - 1)[1], True))
            at = b
        keep(at, len(self.text))
        self.text, self.starts, self.pieces = "".join(out), starts or [0], pieces or [(0, 0, False)]

    def back(self, at: int) -> tuple[int, int]:
        """Source positions (start, end) of the character at ``at``."""
        i = bisect_right(self.starts, at) - 1
        low, high, changed = self.pieces[i]
        return (low, high) if changed else (low + at - self.starts[i], low + at - self.starts[i] + 1)

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Source span of a span of the present text, and whether it differs from its source."""
        start, end = self.back(a)[0], self.back(b - 1)[1]
        first, last = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1)
        return start, end, end - start != b - a or any(p[2] for p in self.pieces[first:last])


def _spelled(match: re.Match) -> list[tuple[int, int, str]]:
    """One site for each run of spoken digits: separators go, words become digits."""
    if not _TWO_WORDS.search(match[0]):
        return []
    parts = [("+" if p[1] else _DIGIT_WORDS.get(p[0].lower(), p[0])) for p in _RUN_PART.finditer(match[0])]
    return [(*match.span(), "".join(parts))]


def _grouped(match: re.Match) -> list[tuple[int, int, str]]:
    """Sites for groups of spoken digits that only together are a card or a phone number."""
    groups = [
        (*g.span(), "".join("+" if p[1] else _DIGIT_WORDS.get(p[0].lower(), p[0]) for p in _RUN_PART.finditer(g[0])))
        for g in _GROUP.finditer(match.string, *match.span())
    ]
    sites, i = [], 0
    while i < len(groups):
        taken, digits = None, ""
        for j in range(i, len(groups)):
            digits += groups[j][2]
            if len(digits) > 19 or "+" in digits[1:]:
                break
            whole = _callable(digits) if digits[0] == "+" else _luhn(digits)
            if whole and _TWO_IN_ROW.search(match.string, groups[i][0], groups[j][1]):
                taken = j, digits
                if j == i or digits[0] != "+":
                    break
        if taken:
            sites.append((groups[i][0], groups[taken[0]][1], taken[1]))
        i = taken[0] + 1 if taken else i + 1
    return sites


def _spoken_sites(text: str) -> list[tuple[int, int, str]]:
    """Groups first; then runs and lone words that no group holds."""
    sites = [s for m in _GROUPS.finditer(text) if _TWO_IN_ROW.search(m[0]) for s in _grouped(m)]
    for more in (
        [s for m in _RUN.finditer(text) for s in _spelled(m)],
        [(*m.span(), _DIGIT_WORDS[m[0].lower()]) for m in _BY_DOT.finditer(text)],
    ):
        starts = [a for a, _, _ in sites]
        for a, b, words in more:
            i = bisect_right(starts, a)
            if (not i or sites[i - 1][1] <= a) and (i == len(starts) or b <= starts[i]):
                sites.append((a, b, words))
        sites = sorted(sites)
    return sites


def _to_mailbox(match: re.Match) -> bool:
    """Whether "at" before a host with plain dots speaks of a mailbox."""
    label = match["host"].rsplit(".", 1)[-1].strip()
    # a capital after the dot begins a sentence, unless the host itself is written with capitals
    one_case = label.islower() or label.isupper() or match["host"][0].isupper()
    if not match["more"] and not (len(label) > 1 and label.isascii() and label.isalpha() and one_case):
        return False
    before = _LAST_WORD.search(match.string, max(0, match.start() - 64), match.start())
    return not before or before[0].lower() not in LEADS


def _gap_sites(match: re.Match, name: int | str = 0) -> list[tuple[int, int, str]]:
    """A plain dot for every spaced one inside a group of a match."""
    return [(*g.span(), ".") for g in _GAPS.finditer(match.string, *match.span(name))]


def _dotted_card(match: re.Match) -> bool:
    groups = match[0].split(".")
    return _luhn(match[0]) and any(len(g) != 3 for g in groups[1:])


def _number_sites(text: str) -> list[tuple[int, int, str]]:
    """Addresses with spaced dots and cards with dots; the two cannot overlap."""
    spaced = [s for m in _SPACED_IP.finditer(text) if _octets(_GAPS.sub(".", m[0])) for s in _gap_sites(m)]
    cards = [(*m.span(), m[0].replace(".", "")) for m in _DOTTED.finditer(text) if _dotted_card(m)]
    return sorted(spaced + cards)


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans that appear only once disguises are taken off, in source code points."""
    # Cheap signs first: most texts show none of them.
    low = text.lower()
    strange = not text.isascii() and not _STRANGE.isdisjoint(text)
    marks = any(w in low for w in ("dot", "punkt", "punto", "point")) or _BRACKETED.search(low) or _AT_HOST.search(low)
    marks = marks or ("@" in low and _SPACED_AT.search(low))
    numbers = _SOME_SPACED_IP.search(low) or _SOME_DOTTED.search(low)
    tokens = low.replace("-", " ").replace(",", " ").replace(".", " ").split()
    spoken = _SPOKEN.intersection(tokens)
    if len(spoken) == 1:  # one digit word counts if it is repeated or a dot can stand next to it
        word = next(iter(spoken))
        spoken = marks or any(a == b == word for a, b in zip(tokens, tokens[1:])) or _BY_DOT.search(low)
    if not (strange or marks or spoken or numbers):
        return []
    plain = Rewritten(text)
    if strange:
        plain.replace([(i, i + 1, _TABLE.get(c, "")) for i, c in enumerate(text) if c in _STRANGE])
    sites = []
    for m in _DISGUISE.finditer(plain.text):
        if m["at_host"] is None:
            sites.append((*m.span(), "@" if m["at"] or m["at_word"] else "."))
        elif _to_mailbox(m):
            sites += [(*m.span(), "@")] if m["at_host"] != "@" else []
            sites += _gap_sites(m, "host")
    if sites:
        plain.replace(sites)
    sites = _number_sites(plain.text) if numbers or strange else []
    if sites:
        plain.replace(sites)
    sites = _spoken_sites(plain.text) if spoken or strange else []
    if sites:
        plain.replace(sites)
    found = []
    for kind, a, b in detect(plain.text):
        start, end, changed = plain.source(a, b)
        if changed:
            found.append((kind, start, end))
    return found


def spans_of(text) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) of a text, by kind as listed, then start and end."""
    if not text:
        return []
    base = detect(text)
    known = set(base)
    spans = [(*s, False) for s in base] + [(*s, True) for s in disguised(text) if s not in known]
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end, added)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b, "added": x} for k, a, b, x in spans_of(t)] for t in batch["text"]
            ]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        run, f"doc_id {kind}, spans array<struct<kind string, start long, end long, added boolean>>"
    )


def masked(text, spans) -> str | None:
    """The text with overlapping spans merged and each replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at, merged = [], 0, []
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The table with personal data masked and ``n_chars`` (if given) brought up to date."""

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, spans_of(t)), na_action="ignore")

    out = docs.withColumn(text, mask(F.col(text)))
    kind = dict(docs.dtypes)
    return out.withColumn(n_chars, F.length(text).cast(kind[n_chars])) if n_chars else out
