"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns find emails, IP addresses, payment cards and phone numbers. The field labels the words
that hold a digit, an ``@`` or a ``+`` (all others are of no kind). Its potentials are those of a word's
shape, of neighbouring words' labels, and of *skip* links between distant words that are the same or
end in the same digits, which favour one label for both. Loopy message passing lets a mention that
is clear in one place settle the unclear ones elsewhere in the document. Weights maximise the
pseudo-likelihood of a sample. Its texts are labelled by the patterns; of those with a mention, a copy is
added in which the mentions are written with other separators, so that no pattern finds them but their label
is known. So the field learns more than the patterns say.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, column

KINDS = ["email", "ip", "card", "phone"]
#: Labels of a word: none, or 1 + the place of its kind in KINDS.
LABELS = 1 + len(KINDS)

#: Distinct documents that the weights are fitted on (lowest hash of the id and text first), and words taken of each (lowest
#: hash of their place first, so from the whole text).
SAMPLE = 4000
SAMPLE_WORDS = 200
STEPS = 300
RATE = 0.1
PENALTY = 1e-4

#: Rounds of message passing, part of the old message kept, least probability of an added label.
ROUNDS = 10
DAMPING = 0.3
LEAST = 0.95

Span = tuple[int, int, int]  # kind, start, end in code points

# Runs that cannot be given up make the searches linear; the matches are those of the plain patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_SIGN = re.compile(r"[0-9@+]")
_SPACE = frozenset("\x20\x09\x0a\x0b\x0c\x0d")
_NEXT_SPACE = re.compile(r"[\x20\x09-\x0D]")
_AROUND = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (match := _DOMAIN.match(text, at + 1)):
            end = match.end()
            yield 0, start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind and start; failing matches are dropped."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def words(text: str) -> list[tuple[int, int]]:
    """Start and end of the words that hold a digit, ``@`` or ``+``."""
    out, end = [], 0
    while match := _SIGN.search(text, end):
        start = match.start()
        while start > end and text[start - 1] not in _SPACE:
            start -= 1
        space = _NEXT_SPACE.search(text, match.end())
        end = space.start() if space else len(text)
        out.append((start, end))
    return out


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """The word without punctuation around it."""
    while start < end and text[start] in _AROUND:
        start += 1
    while end > start and text[end - 1] in _AROUND:
        end -= 1
    return start, end


_DIGIT_STEPS = [0, 1, 4, 7, 10, 13, 16, 20]
FEATURES = 30


def features(word: str) -> list[int]:
    """Numbers of the traits that a word has; 0 is the one that all have."""
    digits = sum("0" <= c <= "9" for c in word)
    out = [0, 1 + max(i for i, n in enumerate(_DIGIT_STEPS) if digits >= n)]
    letters = sum(c.isalpha() for c in word)
    runs = _DIGITS.findall(word)
    groups, longest = len(runs), max(map(len, runs), default=0)
    dots = word.count(".")
    traits = [
        "@" in word,
        "@" in word and "." in word[word.rfind("@") :],
        word[:1] == "+",
        digits == len(word),
        letters > 0,
        letters > digits,
        dots == 1,
        dots == 3 and not letters,
        dots > 3,
        "-" in word,
        "(" in word or ")" in word,
        "=" in word or "/" in word,
        any(ord(c) > 127 for c in word),
        digits > 0 and not letters and "@" not in word,
        len(word) > 24,
        groups == 2,
        groups == 3,
        groups == 4 and longest <= 3,
        groups >= 4 and longest == 4,
        groups > 4,
        digits >= 12 and luhn("".join(runs)),
    ]
    return out + [9 + i for i, has in enumerate(traits) if has]


def similar(word: str) -> str | None:
    """Words with the same value are linked: the last six digits, or all of a shorter or lettered word."""
    if any(c.isalpha() for c in word):
        return word.lower() if len(word) >= 6 else None
    digits = _NOT_DIGIT.sub("", word)
    return digits[-6:] if len(digits) >= 6 else None


@dataclass
class Graph:
    """Words of some documents and the links between them, by number."""

    traits: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    open_left: list[int]
    open_right: list[int]

    def add(self, text: str, found: list[tuple[int, int]]) -> None:
        """Append the words of one document; a neighbour outside the graph is of no kind."""
        base, latest = len(self.traits), {}
        for k, (start, end) in enumerate(found):
            trimmed = text[slice(*_trim(text, start, end))]
            self.traits.append(features(trimmed))
            if k and not text[found[k - 1][1] : start].strip("\x20\x09\x0a\x0b\x0c\x0d"):
                self.chain.append((base + k - 1, base + k))
            else:
                self.open_left.append(base + k)
                if k:
                    self.open_right.append(base + k - 1)
            key = similar(trimmed)
            if key is not None:
                if key in latest:
                    self.skip.append((latest[key], base + k))
                latest[key] = base + k
        if found:
            self.open_right.append(base + len(found) - 1)


def empty_graph() -> Graph:
    return Graph([], [], [], [], [])


@dataclass(frozen=True)
class Field:
    """Weights: of traits per label, of neighbouring labels, and of a skip link between equal labels."""

    shape: np.ndarray
    chain: np.ndarray
    skip: float


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _pairs(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.array(pairs, np.int64).reshape(-1, 2)
    return flat[:, 0], flat[:, 1]


def marginals(graph: Graph, field: Field) -> np.ndarray:
    """Probabilities of each word's labels after ROUNDS rounds of loopy message passing."""
    n = len(graph.traits)
    own = np.zeros((n, LABELS))
    flat = np.concatenate([np.asarray(t) for t in graph.traits]) if n else np.empty(0, np.int64)
    np.add.at(own, np.repeat(np.arange(n), [len(t) for t in graph.traits]), field.shape[flat])
    np.add.at(own, np.array(graph.open_left, np.int64), field.chain[0])
    np.add.at(own, np.array(graph.open_right, np.int64), field.chain[:, 0])
    (ca, cb), (sa, sb) = _pairs(graph.chain), _pairs(graph.skip)
    # every link both ways; potentials by label of the sender, then of the receiver
    sender, receiver = np.concatenate([ca, cb, sa, sb]), np.concatenate([cb, ca, sb, sa])
    back = np.concatenate([np.arange(len(ca)) + len(ca), np.arange(len(ca)), 2 * len(ca) + len(sa) + np.arange(len(sa)), 2 * len(ca) + np.arange(len(sa))])
    agree = np.eye(LABELS) * field.skip
    kinds = np.concatenate([np.repeat([0, 1], len(ca)), np.repeat([2], 2 * len(sa))])
    potential = np.stack([field.chain, field.chain.T, agree])[kinds]
    message = np.zeros((len(sender), LABELS))
    for _ in range(ROUNDS):
        belief = own.copy()
        np.add.at(belief, receiver, message)
        out = _log_sum((belief[sender] - message[back])[:, :, None] + potential, axis=1) if len(sender) else message
        out -= out.max(axis=1, keepdims=True, initial=-np.inf) if len(out) else 0
        message = DAMPING * message + (1 - DAMPING) * out
    belief = own.copy()
    np.add.at(belief, receiver, message)
    return np.exp(belief - _log_sum(belief, axis=1)[:, None]) if n else belief


def _admissible(kind: int, part: str) -> bool:
    """Whether a run of words can be of a kind at all."""
    digits = len(_NOT_DIGIT.sub("", part))
    if kind == 0:
        return re.fullmatch(r"[^@]+@[^@]+", part) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}([^0-9A-Za-z]+[0-9]{1,3}){3}", part) is not None and all(int(n) <= 255 for n in _DIGITS.findall(part))
    if any(c.isalpha() or c == "@" for c in part):
        return False
    return 12 <= digits <= 19 and luhn(_NOT_DIGIT.sub("", part)) if kind == 2 else 7 <= digits <= 15


def added_spans(text: str, found: list[tuple[int, int]], likely: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring words surely of one kind that no pattern has found."""
    taken = sorted((s, e) for _, s, e in base)
    label = np.where(likely.max(axis=1) >= LEAST, likely.argmax(axis=1), 0) if len(found) else []
    out, k = [], 0
    while k < len(found):
        to = k + 1
        while to < len(found) and label[to] == label[k] and not text[found[to - 1][1] : found[to][0]].strip("\x20\x09"):
            to += 1
        if label[k]:
            start, end = _trim(text, found[k][0], found[to - 1][1])
            if _admissible(label[k] - 1, text[start:end]) and not any(s < end and start < e for s, e in taken):
                out.append((int(label[k]) - 1, start, end))
        k = to
    return out


#: By kind, what a mention's separators become in a perturbed copy.
_REWRITES = [
    [(re.compile(r"\.(?=[^@]*$)"), ","), (re.compile(r"\.(?=[^@]*$)"), "_")],
    [(re.compile(r"\."), "-"), (re.compile(r"\."), ":"), (re.compile(r"\."), ",")],
    [(re.compile(r"(?<=[0-9])[\x20-]?(?=(?:[0-9]{4}){1,3}$)"), "."), (re.compile(r"(?<=[0-9])[\x20-]?(?=[0-9]{4}$)"), "/")],
    [(re.compile(r"[^0-9+]+"), "/"), (re.compile(r"(?<=[0-9])[^0-9]*(?=[0-9]{4}$)"), "_"), (re.compile(r"(?<=\+[0-9])[^0-9]*"), "/")],
]


def rewritten(kind: int, mention: str) -> str | None:
    """A mention with other separators, so that no pattern finds it, in a way chosen by the mention itself; null if there is none."""
    ways = _REWRITES[kind]
    for i in range(len(ways)):
        rewrite, by = ways[(len(mention) + sum(mention.encode()) + i) % len(ways)]
        new = rewrite.sub(by, mention)
        if not base_spans(new):
            return new
    return None


def perturbed(text: str, base: list[Span]) -> tuple[str, list[Span]]:
    """The text with its mentions rewritten where they can be, and where all are then.

    Of mentions that overlap only the first is taken.
    """
    parts, spans, at, shift = [], [], 0, 0
    for kind, start, end in sorted(base, key=lambda s: (s[1], s[0])):
        if start < at:
            continue
        old = text[start:end]
        new = rewritten(kind, old) or old
        parts += [text[at:start], new]
        spans.append((kind, start + shift, start + shift + len(new)))
        shift += len(new) - len(old)
        at = end
    return "".join([*parts, text[at:]]), spans


Taught = tuple[list[int], int, int, int, list[int]]


def _taught(text: str, spans: list[Span]) -> list[Taught]:
    """Per word of a text: traits, own label, labels to the left and right, number of skip links to each label."""
    found = words(text)
    graph = empty_graph()
    graph.add(text, found)
    label, ordered, k = [0] * len(found), sorted(spans, key=lambda s: (s[1], s[0])), 0
    for i, (start, end) in enumerate(found):
        while k < len(ordered) and ordered[k][2] <= start:
            k += 1
        # spans of two kinds may overlap, so the next one may hold the word too
        label[i] = min((1 + kind for kind, s, e in ordered[k : k + len(KINDS)] if s < end and start < e), default=0)
    left, right, linked = [0] * len(found), [0] * len(found), [[0] * LABELS for _ in found]
    for a, b in graph.chain:
        left[b], right[a] = label[a], label[b]
    for a, b in graph.skip:
        linked[a][label[b]] += 1
        linked[b][label[a]] += 1
    chosen = sorted(range(len(found)), key=lambda i: zlib.crc32(b"%d" % i))[:SAMPLE_WORDS]
    return [(graph.traits[i], label[i], left[i], right[i], linked[i]) for i in chosen]


def lessons(text: str) -> list[Taught]:
    """What a text teaches: its words, and those of a perturbed copy if it has a mention."""
    base = base_spans(text)
    return _taught(text, base) + (_taught(*perturbed(text, base)) if base else [])


def fit(documents: DataFrame) -> Field:
    """Weights from at most SAMPLE distinct documents. Without any word to learn from, nothing is of any kind.

    Rows equal in id and text are one document, and an id of very many rows counts row by row. Equal words with equal
    neighbours are counted on the executors; only distinct ones reach the driver, at most 2 SAMPLE SAMPLE_WORDS.
    """
    bound_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    chosen = texts.select("row").distinct().orderBy("row").limit(SAMPLE)

    def run(batches):
        for batch in batches:
            rows = [row for text in column(batch, "text") for row in lessons(text.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
                )

    names = ["traits", "own", "to_left", "to_right", "linked"]
    types = [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
    schema = "traits array<int>, own int, to_left int, to_right int, linked array<int>"
    sample = texts.join(F.broadcast(chosen), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    rows = sample.select("text").mapInArrow(run, schema).groupBy(*names).agg(F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    shape, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 0.0
    if not rows:
        shape[0, 0] = 10.0
        return Field(shape, chain, skip)
    x = np.zeros((len(rows), FEATURES))
    for i, row in enumerate(rows):
        x[i, row.traits] = 1
    same = np.array([row.linked for row in rows], float)
    weight = np.array([row.n for row in rows], float)[:, None]
    weight /= weight.sum()
    own, left, right = (np.eye(LABELS)[[row[c] for row in rows]] for c in names[1:4])
    params = [shape, chain, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        score = x @ params[0] + left @ params[1] + right @ params[1].T + params[2] * same
        gap = (np.exp(score - _log_sum(score, axis=1)[:, None]) - own) * weight
        slopes = [x.T @ gap, left.T @ gap + gap.T @ right, np.array([(gap * same).sum()])]
        for p, g, m, v in zip(params, slopes, first, second, strict=True):
            g = g + PENALTY * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(params[0], params[1], float(max(0.0, params[2][0])))


def find(documents: DataFrame, field: Field) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, base>>`` for every row, spans by kind and start."""
    bound_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for at in range(0, batch.num_rows, 256):
                part = [t.as_py() or "" for t in texts.slice(at, 256)]
                graph, base, found = empty_graph(), [], []
                for text in part:
                    found.append(words(text))
                    base.append(base_spans(text) if found[-1] else [])
                    graph.add(text, found[-1])
                likely, out, k = marginals(graph, field), [], 0
                for text, own, sure in zip(part, found, base, strict=True):
                    more = added_spans(text, own, likely[k : k + len(own)], sure)
                    k += len(own)
                    spans = sorted([(*s, True) for s in sure] + [(*s, False) for s in more])
                    out.append([{"kind": KINDS[s[0]], "start": s[1], "end": s[2], "base": s[3]} for s in spans])
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(out, kind)], names=["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean>>"
    )


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``documents(doc_id, text)``; see ``find``.

    Places count code points, ends are exclusive. A null text is empty and has no spans. Rows with a null or
    repeated id are searched like any other. Other columns are ignored.
    """
    return find(documents, fit(documents))
