"""Personal data by base patterns and a semi-Markov conditional random field.

The field scores whole candidate segments of a text: a segment's features are
its shape, its length, its type's own test (checksum, parts, digits) and the
words beside it. A dynamic program over the candidates of a cluster picks
boundaries and types together. Clusters are the stretches of
a text that hold a digit or an at sign, with the letter groups after the head of a spaced IBAN, parted where ``APART`` plain
characters stand between; a colon parts pieces, a bracket is a piece. Long clusters are cut only where no segment can
cross, which changes no result. A segment has at most ``LONGEST`` pieces.

Weights are trained here by maximum likelihood (forward-backward over the same
segments) on sentences made from formats of each type and look-alikes that are
none, ``TRAINING`` of them; nothing of the corpus is read for that. Base spans are always kept; spans the
field adds must not overlap them or each other.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import text_rows

KINDS = ("email", "ip", "card", "phone")  # the order that decides ties
# Base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # found by _addresses in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ADDED = ("iban", "ssn", "mac", "birth")  # further types only the field finds
TYPES = KINDS + ADDED
LONGEST = 13      # pieces of a segment, brackets included
WIDEST = 64       # characters of a segment of several pieces
MOST = 64         # pieces after which a cluster is cut at the next gap that no segment crosses
APART = 12
TRAINING = 600    # made sentences; the bound of the training set
PIECE = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+@:/()-")
REST = re.compile(r"[A-Za-z0-9._%+@:/()-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _digits(span: str) -> str:
    return re.sub("[^0-9]", "", span)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each kind that pass its test."""
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _emails(text)]
    if _ANY_DIGIT.search(text):
        out += [(a, b, "ip") for a, b in _addresses(text) if all(map(_small, text[a:b].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return out


_ANY_DIGIT = re.compile("[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text: str):
    """The pattern's leftmost matches, tried only before at signs; the rest of a long word cannot start one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _addresses(text: str):
    """Spans of the address pattern: four digit groups joined by dots, found run by run so that long runs stay linear."""
    for run in _DOTTED.finditer(text):
        groups, at, i = run.group().split("."), run.start(), 0
        if len(groups) < 4:
            continue
        starts = []
        for g in groups:
            starts.append(at)
            at += len(g) + 1
        while i + 3 < len(groups):
            if all(groups[i:i + 4]):
                yield starts[i], starts[i + 3] + len(groups[i + 3])
                i += 4
            else:
                i += 1


_DOTTED = re.compile(r"[0-9.]+")


def _pieces(text: str):
    """Maximal runs of piece characters that hold a digit or an at sign."""
    end = 0
    while m := _MARK.search(text, end):
        start = m.start()
        while start > end and text[start - 1] in PIECE:
            start -= 1
        end = REST.match(text, m.start()).end()
        yield start, end


_MARK = re.compile("[0-9@]")


# ---------------------------------------------------------------- the field

_FORMATS = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"), "ip": re.compile(r"(?:\d{1,3}\.){3}\d{1,3}"),
    "card": re.compile(r"\d(?:[ .-]?\d){12,18}"), "phone": re.compile(r"(?:\+|00|\()?\d[\d ().-]{7,}\d"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}"), "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "mac": re.compile(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}"),
    "birth": re.compile(r"\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}-\d{2}-\d{2}"),
}
_CUES = {"email": ("mail", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"),
         "phone": ("phone", "tel", "call", "fax", "mobile"), "iban": ("iban", "account"), "ssn": ("ssn", "social"),
         "mac": ("mac", "device"), "birth": ("born", "birth", "dob")}


def _iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _valid(kind: str, span: str) -> bool:
    digits = _digits(span)
    if kind == "ip":
        return all(map(_small, span.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and span[0] in "+0("
    if kind == "iban":
        return _iban_ok(span)
    if kind == "ssn":
        return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    if kind == "birth":
        return any(1900 <= int(y) <= 2025 for y in re.findall(r"\d{4}", span))
    return True


def features(kind: str, text: str, start: int, end: int) -> tuple[str, ...]:
    """Features of a whole segment under one type; none where the type's format does not cover it."""
    span = text[start:end]
    if not _FORMATS[kind].fullmatch(span):
        return ()
    before = text[max(0, start - 24):start].lower()
    cue = any(c in before for c in _CUES[kind])
    return (f"{kind}|format", f"{kind}|valid={_valid(kind, span)}", f"{kind}|cue={cue}",
            f"{kind}|edge={text[end:end + 1].isalnum() or text[start - 1:start].isalnum()}",
            f"{kind}|joined={any(c in span for c in ' -().')}")


_UNIT = re.compile(r"[()]|[^():]+")
_SPACED_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{1,4}(?![A-Za-z0-9]))+")
_LETTERS = re.compile(r"(?<= )[A-Z]+(?![A-Z0-9])")


def _units(text: str):
    """Pieces parted at colons and brackets, marks at their edges cut off, and the letter groups of spaced IBANs, in order."""
    letters = [(m.start() + g.start(), m.start() + g.end()) for m in _SPACED_IBAN.finditer(text) for g in _LETTERS.finditer(m.group())]
    letters.reverse()  # the next one last
    for first, last in _pieces(text):
        while letters and letters[-1][0] < first:
            yield letters.pop()
        for unit in _UNIT.finditer(text, first, last):
            start, end = unit.span()
            while end > start and text[end - 1] in ".,;-_/%":
                end -= 1
            while end > start and text[start] in ".,;-_/%":
                start += 1
            if end > start:
                yield start, end
    yield from reversed(letters)


def clusters(text: str) -> list[list[tuple[int, int]]]:
    """Pieces grouped where little stands between."""
    out: list[list[tuple[int, int]]] = []
    for start, end in _units(text):
        gap = start - out[-1][-1][1] if out else APART + 1
        if gap <= 1 or gap <= APART and len(out[-1]) < MOST:
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
    return out


def segments(text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """All candidates ``(first piece, last piece, type, features)`` of one cluster."""
    out = []
    for i in range(len(pieces)):
        for j in range(i, min(len(pieces), i + LONGEST)):
            if j > i and (pieces[j][0] - pieces[j - 1][1] > 1 or pieces[j][1] - pieces[i][0] > WIDEST):
                break
            for kind in TYPES:
                if found := features(kind, text, pieces[i][0], pieces[j][1]):
                    out.append((i, j, kind, found))
    return out


def decode(n: int, scored: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """The best set of segments: pieces outside one score 0; equal scores prefer the fewer segments."""
    best = [0.0] * (n + 1)
    back: list[tuple | None] = [None] * (n + 1)
    ending: dict[int, list] = {}
    for i, j, kind, score in scored:
        ending.setdefault(j, []).append((i, kind, score))
    for e in range(1, n + 1):
        best[e] = best[e - 1]
        for i, kind, score in ending.get(e - 1, ()):
            if best[i] + score > best[e] + 1e-12:
                best[e], back[e] = best[i] + score, (i, kind)
    out, e = [], n
    while e:
        if back[e] is None:
            e -= 1
        else:
            i, kind = back[e]
            out.append((i, e - 1, kind))
            e = i
    return out[::-1]


def _expected(n, scored):
    """Log partition sum and the marginal of every segment."""
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for e in range(1, n + 1):
        ahead[e] = ahead[e - 1]
        for i, j, _, s in scored:
            if j == e - 1:
                ahead[e] = add(ahead[e], ahead[i] + s)
    for b in range(n - 1, -1, -1):
        behind[b] = behind[b + 1]
        for i, j, _, s in scored:
            if i == b:
                behind[b] = add(behind[b], behind[j + 1] + s)
    return [math.exp(ahead[i] + s + behind[j + 1] - ahead[n]) for i, j, _, s in scored]


def _made(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A sentence with marked spans of some types and look-alikes that are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        body = "4" + d(14)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        sep = rng.choice(["", " ", "-", "."])
        return sep.join(body[i:i + 4] for i in range(0, 16, 4))

    def iban():
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        return f"DE{check:02d}{body}"

    makers = {
        "email": lambda: f"a{d(2)}@mail{d(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "card": card, "phone": lambda: rng.choice([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"(0{d(2)}) {d(4)}-{d(4)}",
                                                   f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)}-{d(7)}"]),
        "iban": iban, "ssn": lambda: f"1{d(2)}-4{d(1)}-7{d(3)}", "mac": lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
        "birth": lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1930, 2005)}",
    }
    none = [lambda: d(rng.randint(1, 9)), lambda: "9" + d(rng.randint(10, 20)), lambda: f"{d(1)}.{d(2)}", lambda: f"300.{d(3)}.{d(1)}.1",
            lambda: f"{d(3)}-{d(3)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(2026, 9000)}",
            lambda: f"2{d(3)}-{d(2)}-{d(2)}", lambda: f"XX00{d(16)}", lambda: f"{d(4)} {d(4)} {d(4)} 0000 {d(1)}"]
    text, spans = "", []
    for _ in range(rng.randint(1, 4)):
        text += rng.choice(["see ", "of the ", "and no ", "value "])
        if rng.random() < 0.6:
            kind = rng.choice(TYPES)
            text += rng.choice([c + " " for c in _CUES[kind]] + ["born "] * (kind == "birth") + [""] * (kind != "birth"))
            value = makers[kind]()
            spans.append((len(text), len(text) + len(value), kind))
        else:
            value = rng.choice(none)()
        text += value + rng.choice([" ", ", ", ". "])
    return text, spans


@lru_cache(maxsize=1)
def train(sentences: int = TRAINING, rounds: int = 25, rate: float = 0.5, seed: int = 7) -> dict[str, float]:
    """Weights by gradient ascent on the likelihood of the marked spans; the same on every machine."""
    rng, data = random.Random(seed), []
    for _ in range(sentences):
        text, spans = _made(rng)
        for pieces in clusters(text):
            options = segments(text, pieces)
            if options:
                truth = [(pieces[i][0], pieces[j][1], k) in spans for i, j, k, _ in options]
                data.append((len(pieces), options, truth))
    weights: dict[str, float] = {}
    for turn in range(rounds):
        slope: dict[str, float] = {}
        for n, options, truth in data:
            scored = [(i, j, k, sum(weights.get(f, -0.5) for f in found)) for i, j, k, found in options]
            for (_, _, _, found), p, t in zip(options, _expected(n, scored), truth):
                for f in found:
                    slope[f] = slope.get(f, 0.0) + t - p
        for f, g in slope.items():
            weights[f] = weights.get(f, -0.5) + rate * g / math.sqrt(len(data)) - 0.002 * weights.get(f, -0.5)
    return weights


def added_spans(text: str, weights: dict[str, float], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the best segmentation that overlap no taken one."""
    out = []
    for pieces in clusters(text):
        if all(any(s <= a and b <= e for s, e, _ in taken) for a, b in pieces):
            continue
        scored = [(i, j, k, sum(weights.get(f, -0.5) for f in found)) for i, j, k, found in segments(text, pieces)]
        for i, j, kind in decode(len(pieces), [s for s in scored if s[3] > 0]):
            a, b = pieces[i][0], pieces[j][1]
            if not any(s < b and a < e for s, e, _ in taken):
                out.append((a, b, kind))
    return out


def find_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """Base spans and all spans of one text, each by start, then kind as listed."""
    order = {k: i for i, k in enumerate(TYPES)}
    base = sorted(base_spans(text), key=lambda s: (s[0], order[s[2]], s[1]))
    every = base
    if "@" in text or _ANY_DIGIT.search(text):
        every = sorted(base + added_spans(text, weights, base), key=lambda s: (s[0], order[s[2]], s[1]))
    return base, every


def pii_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text, base, spans`` of every row; spans are ``(start, end, kind)`` in code points.

    Null and empty texts have none, repeated rows repeat, kinds at one start come
    in the order of ``TYPES``. An empty table gives no rows.
    """
    weights = train()
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches):
        import pyarrow as pa
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        shape = lambda found: [{"start": a, "end": b, "kind": k} for a, b, k in found]
        for batch in batches:
            both = [find_spans(t, weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([shape(b) for b, _ in both], kind),
                 pa.array([shape(s) for _, s in both], kind)], names=["doc_id", "text", "base", "spans"])

    return text_rows(docs).mapInArrow(run, f"doc_id bigint, text string, base {span}, spans {span}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null texts stay null, other columns as they are.

    Of overlapping base spans the earlier is replaced, with the later one's rest. ``n_chars`` follows the new text where the table has it.
    """
    from pyspark.sql import functions as F
    weights = train()

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redacted(t, find_spans(t, weights)[1]))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]
