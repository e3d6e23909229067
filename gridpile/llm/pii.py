"""Personal data with exact source offsets, also where it is disguised: transducers, detection, and the way back."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Look-alikes of ASCII letters and signs; full-width forms and other scripts' digits follow from rules below.
_LOOKS = dict(zip(
    "аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαονρτΑΒΕΖΗΙΚΜΝΟΡΤΧΥ․。﹒﹫‐‑‒–—−﹣    ",
    "aeopcyxijsdhABEKMHOPCTXIJSaovptABEZHIKMNOPTXY...@-------    ", strict=True))
#: Further ones: phonetic, Armenian, Cyrillic and Greek letters, as pairs of a sign and what it looks like.
_MORE_LOOKS = ("\u0131i", "\u017fs", "\u0251a", "\u0261g", "\u0269i", "\u026fw", "\u028bu", "\u028fy", "\u03ba\u006b", "\u03c5u", "\u03c7x", "\u03c9w", "\u03f2c", "\u03f3j", "\u0410A", "\u0432b", "\u043ak", "\u043cm", "\u0442t", "\u0475v",
               "\u04afy", "\u04c0l", "\u04cfl", "\u051bq", "\u051dw", "\u0561w", "\u0563q", "\u0566q", "\u0570h", "\u0578n", "\u057du", "\u0581g", "\u0585o")
#: Small capitals, by their names.
_SMALL_CAPITALS = {c: n[-1].lower() for c in (*range(0x0250, 0x02B0), *range(0x1D00, 0x1D2C), *range(0xA730, 0xA732)) if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", n := unicodedata.name(chr(c), ""))}
_LOOKS_TABLE = {ord(k): v for k, v in (*_MORE_LOOKS, *_LOOKS.items())} | _SMALL_CAPITALS | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_INVISIBLE = "­​‌‍⁠﻿"
_BEYOND = re.compile("[\u0131\u017f\u0250-\u02af ­Ͱ-\U0010ffff]")
#: Digits spelled in English, German, French and Spanish.
_SPELLED = (
    ("zero", "oh", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "zwo", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "fuenf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"))
DIGIT_WORDS = {w: str(d) for d, words in enumerate(_SPELLED) for w in words}
#: By first letter, so that most words are passed over after one look.
_W = "(?:" + "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in DIGIT_WORDS if w[0] == c), key=lambda w: (-len(w), w)))})" for c in sorted({w[0] for w in DIGIT_WORDS})) + ")"
_P = r"(?:plus|más)[ -]+"
#: A digit word, said once or twice or three times.
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
_U = rf"(?:(?:do(?:uble|ppel|ble)|triple)[ -])?{_W}"
#: Two digit words or more, among which digits may stand; after a spelled sign a number may also come first.
_N = r"[ -]{1,2}[0-9]{1,15}"
_RUN = re.compile(rf"\b(?:{_P}[0-9]{{1,15}}(?:{_N}|[ -]{{1,2}}{_U})+|(?:{_P})?{_U}(?:[ ,.-]{{1,2}}{_U}|{_N})+)\b", re.I)
#: Letters that equal ASCII ones where case is ignored.
_CASELESS = str.maketrans("İıſ", "iis")
#: Parts of a run: the sign, a digit, and what keeps digits apart.
_PART = re.compile(rf"{_P}|{_U}|[,.] ", re.I)
#: Letters and digits in other shapes, one or several in a character, whose compatibility form is ASCII: letter-like, circled, raised and mathematical ones, ligatures.
_SHAPED = re.compile("[\u2070-\u209c\u2100-\u2134\u2460-\u24ff\u3380-\u33df\ufb00-\ufb06\U0001d400-\U0001d7ff\U0001f100-\U0001f12b\U0001f130-\U0001f149]")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_BRACKETED = re.compile(rf"{_OPEN}(at|ät|@|dot|\.|punkt|punto|point|ponto|arroba|arobase|klammeraffe){_CLOSE}", re.I)
#: It matches wherever _BRACKETED does, but starts with the bracket, which is faster to look for.
_BRACKETED_CORE = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|ät|@|dot|\.|punkt|punto|point|ponto|arroba|arobase|klammeraffe){_CLOSE}", re.I)
_BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.I)
#: A bare "at" counts only before a spelled or bracketed dot, or after a name with a digit or "_", or another sign inside it.
_BARE_AT = re.compile(r"(?:(?<=[A-Za-z0-9])\s{1,3}at\s{1,3}(?=[A-Za-z0-9-]{1,63}\s{0,3}[\[({<]?\s{0,3}\bdot\b)|(?<=[A-Za-z0-9._%+-])(?P<plain>\s{1,3}at\s{1,3})(?=[A-Za-z0-9-]{1,63}\.[A-Za-z]{2}))", re.I)
#: Words for the signs that stand for nothing else, before a name and a dot in words or as a sign.
_SAID_AT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}(?:arroba|arobase|klammeraffe)\s{1,3}(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z]|\s{1,3}(?:punto|ponto|punkt|point|dot)\s))", re.I)
#: A dot in words, which counts between digits and behind the one label that follows an "@" or a dot that counts.
_SAID_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}(?:punto|ponto|punkt|point)\s{1,3}(?=[A-Za-z0-9])", re.I)
#: name_at_host_dot_com, with _ or -.
_TIED_AT = re.compile(r"(?<=[A-Za-z0-9])([_-])at\1(?=[A-Za-z0-9]{1,63}\1dot\1[A-Za-z0-9])", re.I)
_TIED_DOT = re.compile(r"(?<=[A-Za-z0-9])([_-])dot\1(?=[A-Za-z0-9])", re.I)
_LABEL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_SIGNED = re.compile(r"[0-9_]|(?<=[A-Za-z])[.%+-]+(?=[A-Za-z])")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @, so in linear time."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = t.find("@", max(at + 1, done))
    return out


def ips(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(t) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(t: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(t: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(t) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15] if "+" in t else []


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def base_spans(t: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of undisguised data, by start and then kind."""
    return sorted(((s, k, e) for k, find in FIND.items() for s, e in find(t)), key=lambda x: (x[0], KINDS.index(x[1])))


class Normalised:
    """A text and its normal form; span() maps places in the normal form back to the source."""

    def __init__(self, text: str):
        self.text, self.cuts = text, None

    def rewrite(self, pattern: re.Pattern, to) -> None:
        """Replaces matches; the places of what stands in a replacement are those of the whole match."""
        parts, cuts, at, out = [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None or new == m[0]:
                continue
            parts += [self.text[at : m.start()], new]
            out += m.start() - at
            cuts.append((out, out + len(new), m.start(), m.end()))
            out += len(new)
            at = m.end()
        if cuts:
            self.text = "".join(parts) + self.text[at:]
            self.cuts = (cuts, self.cuts)

    def span(self, start: int, end: int) -> tuple[int, int]:
        layer = self.cuts
        while layer:
            cuts, layer = layer
            start, end = self._back(cuts, start)[0], self._back(cuts, end - 1)[1]
        return start, end

    @staticmethod
    def _back(cuts: list[tuple[int, int, int, int]], place: int) -> tuple[int, int]:
        low, high = 0, len(cuts)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if cuts[mid][0] <= place else (low, mid)
        if not low:
            return place, place + 1
        new_start, new_end, start, end = cuts[low - 1]
        return (start, end) if place < new_end and new_start < new_end else (place - new_end + end, place - new_end + end + 1)


def _may_be_disguised(t: str) -> bool:
    """Whether normalise() changes t: a character beyond Latin letters is rewritten, or one of its patterns matches."""
    return (not t.isascii() and _BEYOND.search(t) is not None) or any(p.search(t) for p in (_BRACKETED_CORE, _BARE_AT, _BARE_DOT, _RUN, _SAID_AT, _SAID_DOT, _TIED_AT, _TIED_DOT))


def _signed_before(m: re.Match) -> bool:
    start = m.start()
    while start and m.string[start - 1] in _LOCAL_CHARS:
        start -= 1
    return _SIGNED.search(m.string, start, m.start()) is not None


def _compatible(m: re.Match) -> str | None:
    plain = unicodedata.normalize("NFKC", m[0])
    return plain if plain.isascii() and (plain.isalnum() or plain == "+") else None


def _said(words: str) -> str:
    """The digit, or digits, of a digit word, which may have a word for a number of times before it."""
    *times, digit = words.replace("-", " ").split(" ")
    return DIGIT_WORDS[digit] * (_TIMES[times[0]] if times else 1)


def normalise(t: str) -> Normalised:
    n = Normalised(t.translate(_LOOKS_TABLE) if not t.isascii() else t)  # one character for one: places stay
    if not n.text.isascii():
        n.rewrite(re.compile(f"[{_INVISIBLE}]+"), lambda m: "")
        n.rewrite(_SHAPED, _compatible)
        n.rewrite(re.compile(r"(?![0-9])\d"), lambda m: str(unicodedata.digit(m[0])))
    n.rewrite(_BARE_AT, lambda m: "@" if m["plain"] is None or _signed_before(m) else None)
    n.rewrite(_BRACKETED, lambda m: "." if m[1].lower() in ("dot", ".", "punkt", "punto", "ponto", "point") else "@")
    n.rewrite(_BARE_DOT, lambda m: ".")
    n.rewrite(_TIED_AT, lambda m: "@")
    n.rewrite(_TIED_DOT, lambda m: ".")
    n.rewrite(_SAID_AT, lambda m: "@")
    counted = -1

    def said_dot(m: re.Match) -> str | None:
        nonlocal counted
        t, start = m.string, m.start()
        while start > max(counted, 0) and start > m.start() - 256 and t[start - 1] in _LABEL_CHARS:
            start -= 1
        number = t[m.start() - 1].isdigit() and t[m.end()].isdigit()
        if number or start == counted or (start < m.start() and start and t[start - 1] == "@"):
            counted = m.end()
            return "."
        return None

    n.rewrite(_SAID_DOT, said_dot)
    inside: list[tuple[int, int]] = [m.span() for m in _RUN.finditer(n.text)]
    if inside:
        runs = iter(inside)
        now = next(runs)

        def digit(m: re.Match) -> str | None:
            nonlocal now
            while now and m.start() >= now[1]:
                now = next(runs, None)
            if not now or m.start() < now[0]:
                return None
            return " " if m[0][0] in ",." else "+" if m[0][-1] in " -" else _said(m[0].translate(_CASELESS).lower())

        n.rewrite(_PART, digit)
    return n


def spans(t: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The base spans, and those with the disguised ones added; a span inside a base span of its kind adds nothing."""
    base = base_spans(t)
    if not _may_be_disguised(t):
        return base, base
    n = normalise(t)
    taken: dict[str, list[tuple[int, int]]] = {k: sorted((s, e) for s, x, e in base if x == k) for k in KINDS}
    added = []
    for k, find in FIND.items():
        mine, i = taken[k], 0
        for s, e in sorted(n.span(*x) for x in find(n.text)):
            while i < len(mine) and mine[i][1] <= s:
                i += 1
            if i == len(mine) or mine[i][0] >= e or s < mine[i][0] or e > mine[i][1]:
                added.append((s, k, e))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1]))) if added else base


def _joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all, n_added.

    Places count code points, ends are exclusive. Null texts are empty. Each row stands alone: repeated rows give equal
    results, a null doc_id stays null, other columns are ignored, an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [spans(t) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(x[1] == k for x in base) for base, _ in both], pa.int64()) for k in KINDS]
            shas = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, shas, pa.array([_joined(x) for _, x in both], pa.string()), pa.array([len(x) - len(base) for base, x in both], pa.int64())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def redact(t: str) -> str:
    """t with every found span replaced by the name of its kind; overlapping spans become one."""
    out, at = [], 0
    for s, k, e in spans(t)[1]:
        if s >= at:
            out += [t[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + t[at:]


def redact_documents(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with personal data replaced in every text, and n_chars, where there is such a column, counted again. Null texts stay null."""
    small_batches(documents.sparkSession)
    i = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [None if t is None else redact(t) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(clean, b.schema.field(i).type))

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length(text).cast(dict(documents.dtypes)["n_chars"])) if "n_chars" in documents.columns else out
