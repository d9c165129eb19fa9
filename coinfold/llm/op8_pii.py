"""Personal data found through disguises, with spans of the original text.

Four base patterns are matched on the text as it is. Then transducers rewrite it: homoglyphs and full-width characters
to ASCII, zero-width characters to nothing, spelled digits to digits, and "(at)", "[dot]" and the like to @ and full stops,
in any mix with the bare words and with white space of any length.
Each output character keeps the begin and end of what it stands for, so identifiers found in the normalised
text map back to source characters. Spans found so are added if they don't overlap a base span of their kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ in turn with the run of local characters before it: the same matches as a leftmost search, in linear time."""
    end = after = 0
    at = text.find("@")
    while at >= 0:
        left = text[max(end, after) : at]
        n = len(left) - len(left.rstrip(LOCAL))
        after = at + 1
        if n and (m := DOMAIN.match(text, at + 1)):
            yield at - n, m.end()
            end = m.end()
        at = text.find("@", max(after, end))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost, non-overlapping matches by kind; those that fail their check are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    for m in IP.finditer(text):
        if all(len(g := x.lstrip("0")) <= 3 and int(g or "0") <= 255 for x in m.groups()):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                found["phone"].append(m.span())
    return found


# Look-alikes of ASCII characters in Cyrillic and Greek.
HOMOGLYPHS = dict(zip("авеикмнорстухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeukmhopctyxijsdhqwABEKMHOPCTYXIJSaeikvoptuxABEZHIKMNOPTYX", strict=True))
# Other forms of @, full stop, hyphen and plus.
PUNCTUATION = {
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
    "﹢": "+", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
ZERO_WIDTH = "​‌‍⁠﻿­"
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
CHARS = {**HOMOGLYPHS, **PUNCTUATION, **dict.fromkeys(ZERO_WIDTH, ""), **{chr(0xFEE0 + i): chr(i) for i in range(0x21, 0x7F)}}
ODD = re.compile("[" + "".join(map(re.escape, CHARS)) + "]")
AT = r"[\(\[\{<]\s*+(?:at|@)\s*+[\)\]\}>]"
DOT = r"[\(\[\{<]\s*+(?:dot|\.)\s*+[\)\]\}>]"
DIGIT = "|".join(SPELLED)
# Bracketed forms stand anywhere; bare words count only as "name at host dot end", spelled digits only in runs of three.
# Only the cores are matched here: the white space around them is added by _address, so that runs of any length cost linear time.
MARKS = re.compile(
    rf"(?P<at>{AT})|(?P<dot>{DOT})|(?P<bare>@|(?<=\s)at(?=\s))"
    rf"|(?P<digits>(?<![A-Za-z])(?:{DIGIT}|[0-9]+)(?:[\x20-]{{1,2}}(?:{DIGIT}|[0-9]+)){{2,}}(?![A-Za-z]))",
    re.IGNORECASE,
)
SPACE = re.compile(r"\s*+")
LABEL = re.compile(r"[A-Za-z0-9-]++")
END = re.compile(r"[A-Za-z]{2,}+(?![A-Za-z0-9])")
BETWEEN = re.compile(rf"\.|\s*+(?:{DOT}|(?P<bare>(?<=\s)dot(?=\s)))\s*+", re.IGNORECASE)
ANOTHER = re.compile(rf"[A-Za-z0-9._%+-]*+(?:@|\s*+{AT})", re.IGNORECASE)
NUMBER = re.compile(rf"(?:{DIGIT})", re.IGNORECASE)
HINT = re.compile(rf"{AT}|{DOT}|\sdot\s|(?<![A-Za-z])(?:{DIGIT})[\x20-]{{1,2}}(?:{DIGIT}|[0-9])", re.IGNORECASE)


class Mapped:
    """A text under rewriting with, for each character, the begin and end of the source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) by the string, for edits in order."""
        out: list[str] = []
        begin: list[int] = []
        end: list[int] = []
        at = 0
        for a, b, new in edits:
            out.append(self.text[at:a] + new)
            begin.extend(self.begin[at:a])
            end.extend(self.end[at:a])
            begin.extend([self.begin[a]] * len(new))
            end.extend([self.end[b - 1]] * len(new))
            at = b
        out.append(self.text[at:])
        begin.extend(self.begin[at:])
        end.extend(self.end[at:])
        self.text, self.begin, self.end = "".join(out), begin, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.begin[a], self.end[b - 1]


def _before(text: str, i: int, least: int) -> int:
    """Where the white space that ends at i begins, not before `least`."""
    while i > least and text[i - 1].isspace():
        i -= 1
    return i


def _host(text: str, i: int) -> tuple[list[tuple[int, int]], int] | None:
    """The bare dots of the host at i, and where it ends: at its last label that can end a name behind a bracketed or bare dot.

    None without such a label. A name that belongs to a next address is left to that one.
    """
    label, marked, found = LABEL.match(text, i), False, None
    bare: list[tuple[int, int]] = []
    before = None  # found, as it was at the last bare dot
    while label:
        if marked and END.match(text, label.start()):
            found = len(bare), label.end()
        sep = BETWEEN.match(text, label.end())
        label = LABEL.match(text, sep.end()) if sep else None
        if label and sep[0] != ".":
            marked = True
            if sep["bare"]:
                bare.append(sep.span())
                before = found
    if found and ANOTHER.match(text, found[1]):
        found = before
    return found and (bare[: found[0]], found[1])


def _marks(text: str) -> list[tuple[int, int, str]]:
    edits = []
    edge = taken = 0  # where the last bracketed form and the last host end
    for m in MARKS.finditer(text):
        if m["digits"]:
            words = [x for x in NUMBER.finditer(m[0]) if m.start() + x.start() >= taken]
            if len(words) < 2:
                continue
            last = None
            for x in words:
                a, b = m.start() + x.start(), m.start() + x.end()
                gap = text[last:a] if last is not None else None
                if gap is not None and gap.strip(" -") == "" and len(gap) <= 2:
                    a = last
                edits.append((a, b, SPELLED[x[0].lower()]))
                last = b
            continue
        if m["bare"] and m.start() < taken:
            continue
        a, b = _before(text, m.start(), edge), SPACE.match(text, m.end()).end()
        if m["dot"]:
            edits.append((a, b, "."))
            edge = b
            continue
        # An @ as it is has white space on both sides or on none.
        even = m[0] != "@" or (a < m.start()) == (b > m.end())
        host = _host(text, b) if even and a > taken and text[a - 1] in LOCAL else None
        if m["at"] or host:
            edits.append((a, b, "@"))
            edge = b
        if host:
            edits += [(i, j, ".") for i, j in host[0]]
            taken = host[1]
    return sorted(edits)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    odd = not text.isascii() and ODD.search(text)
    if not odd and not HINT.search(text):
        return {}
    m = Mapped(text)
    if odd:
        m.rewrite([(x.start(), x.end(), CHARS[x[0]]) for x in ODD.finditer(text)])
    m.rewrite(_marks(m.text))
    out: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in base_spans(m.text).items():
        starts = [a for a, _ in base[kind]]
        for a, b in spans:
            s, e = m.source(a, b)
            i = bisect_left(starts, e)
            if e > s and not (i and base[kind][i - 1][1] > s):
                out.setdefault(kind, []).append((s, e))
    return out


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, ())))


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        base_list, all_list, added = [], [], []
        for t in x.column("text"):
            text = t.as_py() or ""
            base = base_spans(text)
            extra = added_spans(text, base)
            for k in KINDS:
                counts[k].append(len(base[k]))
            base_list.append(_listed(base))
            added.append(sum(map(len, extra.values())))
            all_list.append(_listed({k: base[k] + extra.get(k, []) for k in KINDS}) if extra else base_list[-1])
        digests = [hashlib.sha256(b.encode()).hexdigest() for b in base_list]
        yield pa.RecordBatch.from_arrays(
            [x.column("id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(digests, pa.string()), pa.array(all_list, pa.string()), pa.array(added, pa.int64())],
            ["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
        )


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): one row per row of `docs`.

    Null and empty texts have no spans: counts 0, spans empty. Repeated rows each give their row; a null id is passed on. The
    counts and base_sha256 cover the base matches; spans also lists those that deobfuscation adds.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(_detect, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
