"""Personal information inside free text: found by a conditional random field, replaced by typed
placeholders.

Texts are cut into segments at blank lines and ends of sentences. Digits look alike to the tagger, so
segments that only differ in digits are decoded once per task and remembered; what is found is
carried back to the text by its offsets. Decoding runs in batches of new segments. The exact check
behind the tagger only looks at what it found: a telephone number needs digits, a name a word of more
than one letter, an e-mail address its sign, and nothing blacked out counts.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import crf, pii_examples

EXAMPLES = 26  # fillings of each pattern that the tagger is trained on, and as many sentences without sense
DOCS = 256  # texts whose new segments are decoded together
MEMORY = 150_000  # segments remembered by a task

#: Ends of sentences: a full stop behind a word of four small letters or more, a figure or a closing
#: mark, and in front of a capital; a semicolon in front of one; a blank line.
CUT = re.compile(
    r"[.!?](?:(?<=[a-zß-ÿ]{4}[.!?])(?<!str\.)\s+(?=[A-ZÀ-Þ§\[(0-9])|(?<=[0-9)\]”»€█]\.)\s+(?=[A-ZÀ-Þ]))"
    r"|;(?<=[a-zß-ÿ)];)\s+(?=[A-ZÀ-Þ][a-zß-ÿ])"
    r"|\n[ \t\r\u00a0]*\n\s*"
)
BLANK = re.compile(r"[ \t\r\n ]+")
HIDDEN = re.compile(r"[█*…]|\[|\]")
STOP = re.compile(r"(?<=[a-zß-ÿ]{3})(?<!str)(?<!ave)(?<!vda)(?<!lvd)(?<!núm)[.;]\s+(?=[A-ZÀ-Þ0-9])")  # the end of a sentence, not of an abbreviation
WORD = re.compile(r"[^\W\d_]{2,}")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞŁŚŠŽ][^\W\d_]|[ÃÂ][\u0080-\u00bf]")

Span = tuple[int, int, str]


def segments(text: str) -> Iterator[tuple[int, str]]:
    """(begin, text) of the segments of a text whose digits are 0."""
    at = 0
    for m in CUT.finditer(text):
        end = m.start() + (text[m.start()] != "\n")
        if end > at:
            yield at, text[at:end]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


@functools.cache
def model(examples: int = EXAMPLES) -> crf.Crf:
    """The tagger, trained in this process on the segments of the labelled table."""
    rows = []
    for text, spans in pii_examples.table(examples):
        for begin, part in segments(crf.zeroed(text)):
            end = begin + len(part)
            rows.append((part, [(a - begin, b - begin, k) for a, b, k in spans if a >= begin and b <= end]))
    return crf.train(rows)


def proven(kind: str, text: str, before: str, behind: str) -> tuple[int, int] | None:
    """Begin and end of the find within `text`, without stray punctuation, or None."""
    a, b = 0, len(text)
    while b > a and (text[b - 1] in ",;:!?<>“”\"" or text[b - 1].isspace() or (text[b - 1] == "." and (kind != "NAME" or not re.search(r"\b\w\.$", text[:b])))):
        b -= 1
    while kind == "PHONE" and b > a and not text[b - 1].isdigit():
        b -= 1
    while a < b and (text[a] in ",;:.<>“”\"-–—•" or text[a].isspace() or (text[a] == "(" and (kind in ("NAME", "ID") or ")" not in text[a:b]))):
        a += 1
    if kind == "ADDRESS" and (end := STOP.search(text, a, b)):
        b = end.start()
    found = text[a:b]
    digits = sum(c.isdigit() for c in found)
    if kind == "EMAIL":
        good = bool(crf.MAIL.search(found))
    elif HIDDEN.search(found) or before.endswith(("█", "*", "…")) or behind.startswith(("█", "*", "…")):
        return None
    elif kind == "PHONE":
        if found.startswith("(") and found.count("(") > found.count(")"):
            a += 1
        good = 7 <= digits <= 15
    elif kind == "ID":
        good = digits >= 6
    elif kind == "ADDRESS":
        good = digits >= 1 and bool(WORD.search(found))
    else:
        good = digits == 0 and bool(CAPITAL.search(unicodedata.normalize("NFC", found)))
    return (a, b) if good and b > a else None


def spans_of(labels: np.ndarray, places: list[tuple[int, int]], text: str) -> tuple[Span, ...]:
    """Finds in a segment from the labels of its tokens."""
    out: list[Span] = []
    current: list | None = None

    def close() -> None:
        if current:
            a, b, kind = current
            if inner := proven(kind, text[a:b], text[max(0, a - 1) : a], text[b : b + 1]):
                out.append((a + inner[0], a + inner[1], kind))

    for i in np.flatnonzero(labels).tolist():
        label = crf.LABELS[labels[i]]
        begin, end = places[i]
        if label[0] == "I" and current and current[2] == label[2:] and current[3] == i - 1:
            current[1], current[3] = end, i
            continue
        if current:
            current = current[:3]
            close()
        current = [begin, end, label[2:], i]
    if current:
        current = current[:3]
        close()
    return tuple(out)


class Finder:
    """Finds in texts, remembering segments."""

    def __init__(self, tagger: crf.Crf):
        self.tagger, self.known = tagger, {}

    def find(self, texts: list[str]) -> list[list[Span]]:
        """Spans (begin, end, kind) in order, of each text."""
        cut = [list(segments(crf.zeroed(t))) for t in texts]
        if len(self.known) > MEMORY:
            self.known = {}
        new = list({s for parts in cut for _, s in parts if s not in self.known})
        if new:
            tokens = [crf.split(s) for s in new]
            for s, parts, labels in zip(new, tokens, self.tagger.decode([crf.types_of(t) for t in tokens])):
                self.known[s] = spans_of(labels, crf.places_of(parts), s) if len(labels) else ()
        known = self.known
        return [[(at + a, at + b, kind) for at, s in parts for a, b, kind in known[s]] for parts in cut]


def _run(docs: DataFrame, key: str, text: str, examples: int, schema: str, rows) -> DataFrame:
    tagger, kind = model(examples), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Finder(tagger)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                item, columns = rows(part, texts, searcher.find(texts))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(item, pa.int64())), *columns], names=["key", *[f"c{i}" for i in range(len(columns))]])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, schema.format(kind=kind)).withColumnRenamed("key", key)


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """(key, kind, found_text): one row per document and distinct find.

    kind is ADDRESS, EMAIL, ID, NAME or PHONE. Each run of spaces, tabs, line breaks and no-break spaces
    in found_text is one space. Null, empty and blank texts have no finds; repeated rows give repeated
    finds; a null key stays null; an empty table gives no row; whole texts are read, of any length.
    Other columns are not read.
    """

    def rows(part, texts, spans):
        item, kinds, finds = [], [], []
        for i, (t, s) in enumerate(zip(texts, spans)):
            for kind, value in dict.fromkeys((kind, BLANK.sub(" ", t[a:b])) for a, b, kind in s):
                item.append(i)
                kinds.append(kind)
                finds.append(value)
        return item, [pa.array(kinds, pa.string()), pa.array(finds, pa.string())]

    return _run(docs, key, text, examples, "key {kind}, c0 string, c1 string", rows).withColumnsRenamed({"c0": "kind", "c1": "found_text"})


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """(key, text): the text with each find replaced by its kind in square brackets, all else as it was;
    a null text stays null."""

    def rows(part, texts, spans):
        out = []
        for t, s, real in zip(texts, spans, part.column(1).is_valid().to_pylist()):
            pieces, at = [], 0
            for a, b, kind in s:
                pieces += [t[at:a], f"[{kind}]"]
                at = b
            out.append("".join([*pieces, t[at:]]) if real else None)
        return list(range(len(texts))), [pa.array(out, pa.string())]

    return _run(docs, key, text, examples, "key {kind}, c0 string", rows).withColumnRenamed("c0", "text")
