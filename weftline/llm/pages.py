"""Problem 10: keyword-stuffed and link-list pages (line shapes)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL = re.compile(r"(?:https?://|www\.)\S+|^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,6}(?:/\S*)?[,;]?$", re.I)
MARKUP = re.compile(r"<a\s[^<>]*>[^<>\n]*</a>|\[[^\[\]\n]*\]\((?:https?://|www\.)[^\s()]*\)", re.I)
TAG = re.compile(r"^#\w[\w-]*[,;]?$")
PRICE = re.compile(r"^[$€£]?\d+[.,]\d\d[$€£]?$")
LISTING = re.compile(r"^\s*[0-9a-f]+:\s|^\s*[0-9a-f]{6,}\s+<[^>]*>:?\s*$", re.I)
STOP = re.compile(r"[^\W_][.?!]['\"”)]*(?=\s|$)")
#: An end of sentence at the end of a line, also after a space or in other scripts.
ENDED = re.compile(r"[.?!…。？！]['\"”»)]*\s*$")
NUMBERED = re.compile(r"^(?:\d+[.)]|[-*+•])\s+")
#: A quantity and what is measured, as in recipes and parts lists.
MEASURE = re.compile(r"^(?:\d+(?:[.,/]\d+)?|[½¼¾⅓⅔])\s+[^\W\d_]")
# Words that bind sentences and that lists of keywords do without; lists of other languages are a parameter of the operator.
BINDING = frozenset([
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at", "by", "is", "are", "was", "were", "be", "it", "its", "that", "this", "with", "from", "as", "not", "no", "which", "who", "when", "if", "than", "i", "me", "my", "you", "he", "she", "we", "they", "has", "have", "had",
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "und", "oder", "aber", "zu", "auf", "aus", "mit", "von", "bei", "ist", "sind", "war", "nicht", "dass", "wenn", "als", "wie", "ich", "er", "sie", "wir", "es", "im", "nach",
    "le", "la", "les", "un", "une", "du", "et", "ou", "mais", "dans", "sur", "avec", "par", "est", "sont", "ne", "pas", "que", "qui", "quand", "je", "il", "elle", "nous", "au", "ce", "cette", "pour",
    "el", "los", "las", "una", "y", "o", "pero", "en", "con", "por", "son", "no", "cuando", "yo", "se", "del", "al", "lo", "su", "para", "como",
])
# Words before the last part of an enumeration.
CONJUNCTIONS = frozenset(["and", "or", "und", "oder", "et", "ou", "y", "e", "o", "u"])
#: Share of binding words from which an unpunctuated stretch is prose, and below which a long one is a list.
PROSE, BARE = 0.25, 0.04
WORD = re.compile(r"[^\W\d_]+")
#: Marks that part the entries of a list and no clauses of a sentence.
APART = r"\s*[|•·]\s*|\s[/~»]\s"
#: Longest line, in words, that can be an entry of a list, and fewest entries of a list.
ENTRY, ENTRIES = 7, 4
#: Words without an end of sentence from which a stretch isn't prose, and the
#: share of different words below which it repeats itself.
STRETCH, REPEATED = 12, 0.6


def _number(n: int) -> str:
    return str(n) if n < 8 else "8+" if n < 16 else "16+"


def _capitals(words: list[str]) -> str:
    if not words:
        return "-"
    if all(w.isupper() for w in words):
        return "A"
    first = sum(w[0].isupper() for w in words)
    return "T" if first == len(words) and first > 1 else "C" if words[0][0].isupper() else "a"


def _variety(words: list[str]) -> float:
    """Share of different words, as 40 words of the text would have it: longer
    texts repeat themselves more, shorter ones less."""
    if not words:
        return 1.0
    sample = [len(set(words[i : i + 40])) / len(words[i : i + 40]) for i in range(0, len(words), 40) if len(words[i : i + 40]) >= min(len(words), 20)]
    return sum(sample) / len(sample)


def binding_share(words: list[str]) -> float:
    return sum(w in BINDING for w in words) / len(words) if words else 0.0


def _repeats(words: list[str]) -> bool:
    """Whether an unpunctuated stretch repeats itself: within 40 words, in its
    runs of three words (a cycle of any length), by having far fewer different
    words than a text of its length, or, if it is long, by having none of the
    words that bind sentences. A stretch with many of these is prose with a
    refrain."""
    share = binding_share(words)
    if share >= PROSE:
        return False
    if _variety(words) < REPEATED + 0.1 or (len(words) >= 2 * STRETCH and share < BARE):
        return True
    threes = list(zip(words, words[1:], words[2:]))
    return len(words) >= 40 and (len(set(threes)) < 0.5 * len(threes) or len(set(words)) < 1.5 * len(words) ** 0.7)


def line_shape(line: str) -> tuple[str, int, str]:
    """(kind, words, shape) of a line. Kinds: ``links``, ``tags``, ``product``,
    ``cells`` (separated short entries), ``stuffed`` (a long stretch of few
    repeated words), ``listing``, ``table``, ``sentence``, and ``entry``, ``loose``
    and ``priced`` (a short line, a longer one without end of sentence, a name and
    its price; their neighbours decide). The shape holds the number of words, their
    capitals, the separators and the links."""
    tokens = line.split()
    n = len(tokens)
    links = len(MARKUP.findall(line)) or sum(bool(URL.search(t)) for t in tokens)
    body = NUMBERED.sub("", line.strip())
    words = WORD.findall(body)
    marks = "".join(sorted({c for c in body if c in "|,;#<>[](){}\t:/-–—"}))

    def shape(kind: str) -> tuple[str, int, str]:
        return kind, n, f"{kind} {_number(n)} {_capitals(words)} {marks} {min(links, 3)}"

    if LISTING.match(line):
        return shape("listing")
    if links and n <= links * 8:
        return shape("links")
    if sum(bool(TAG.match(t)) for t in tokens) * 2 > n and n:
        return shape("tags")
    cells = [c.strip() for c in line.split("\t")]
    if len(cells) > 1 and sum(bool(re.fullmatch(r"[\d.,%-]+", c)) for c in cells) * 2 >= len(cells):
        return shape("table")
    stops = len(STOP.findall(body))
    if any(PRICE.match(t) for t in tokens) and n <= 14 and not stops and (NUMBERED.match(line.strip()) or line.rstrip().endswith("]")):
        return shape("product")
    numbers = [t for t in tokens if any(c.isdigit() for c in t)]
    if n <= 14 and not stops and len(numbers) == 1 and words and numbers[0] in (tokens[0], tokens[-1]) and PRICE.match(numbers[0]):
        # a bare number may as well be a measurement, so it must have a sign or follow a mark or a name of several words
        if numbers[0][0] in "$€£" or numbers[0][-1] in "$€£" or (n > 2 and tokens[-2] in ("-", "–", "—", ":")) or (len(words) > 1 and words[0][0].isupper()):
            return shape("priced")
    low = [w.lower() for w in words]
    for mark in (APART, ",", ";"):
        parts = [p.split() for p in re.split(mark, body)]
        if len(parts) >= ENTRIES and max(map(len, parts)) <= ENTRY and stops <= len(parts) // 8:
            # commas and semicolons also part clauses, so those lists must be long or repeat themselves
            if mark != APART and any(w.lower() in CONJUNCTIONS for w in parts[-1][:3]):
                continue  # an enumeration within a sentence
            several = len(parts) >= 2 * ENTRIES and sum(len(p) > 1 or (len(p) == 1 and p[0][0].isalpha()) for p in parts) * 4 >= len(parts) * 3
            if mark == APART or (not stops and (several or _variety(low) < 0.75)):
                return shape("cells")
    if n >= STRETCH and stops * 40 <= n and _repeats(low):
        return shape("stuffed")
    if not stops and 1 < n <= 2 * ENTRY and MEASURE.match(body) and not NUMBERED.match(line.strip()):
        return shape("table")
    if not stops and 0 < n <= ENTRY:
        return shape("entry")
    if not stops and n and not ENDED.search(body):
        return shape("loose")
    return shape("sentence")


def page_words(text: str | None) -> tuple[int, Counter]:
    """(all words, words by shape of what is not a sentence, listing or table)
    of a page. Short lines count as a list if at least four follow each other,
    hardly any sentence ends among them and their words repeat; otherwise they
    are prose broken into short lines."""
    found: Counter = Counter()
    total = 0
    stretch: list[tuple[str, str, int, str]] = []  # neighbouring lines without end of sentence

    def close_entries(entries: list[tuple[str, str, int, str]]) -> None:
        if len(entries) >= ENTRIES:
            words = [w.lower() for _, line, _, _ in entries for w in WORD.findall(line)]
            several = sum(n for _, _, n, _ in entries) / len(entries)
            lines = {re.sub(r"\W+", " ", line.lower()).strip() for _, line, _, _ in entries}
            # single words recur in prose too, so a list of them must repeat more
            repeats = len(lines) < (0.7 if several >= 1.6 else 0.35) * len(entries)
            if binding_share(words) < PROSE and (repeats or (several >= 1.6 and _variety(words) < 0.85)):
                for _, _, n, shape in entries:
                    found[shape] += n

    def close() -> None:
        loose = any(kind == "loose" for kind, _, _, _ in stretch)
        if loose and _repeats([w.lower() for kind, line, _, _ in stretch for w in WORD.findall(line)]):
            for _, _, n, shape in stretch:
                found[shape] += n
        else:
            for kind, group in groupby(stretch, key=lambda x: x[0]):
                lines = list(group)
                if kind == "entry":
                    close_entries(lines)
                elif kind == "priced" and len(lines) >= ENTRIES:
                    for _, _, n, shape in lines:
                        found[shape] += n
                elif kind == "loose":
                    for _, line, n, shape in lines:
                        if _repeats([w.lower() for w in WORD.findall(line)]):
                            found[shape] += n
        stretch.clear()

    for line in (text or "").split("\n"):
        if not line.strip():
            continue
        kind, n, shape = line_shape(line)
        total += n
        if kind in ("entry", "loose", "priced"):
            stretch.append((kind, line, n, shape))
            continue
        close()
        if kind in ("links", "tags", "product", "cells", "stuffed"):
            found[shape] += n
    close()
    return total, found


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total, found = page_words(text)
            top = found.most_common(8)
            rows.append((key, total, sum(found.values()), sum(n for _, n in top), top[0][0] if top else None))
        columns = zip(*rows) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "words", "listed", "dominant", "shape"])


def page_shapes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, listed, dominant, shape) of every page: its blank-separated
    words, those in lines whose shape is that of repeated keywords, links,
    products or tags, those in its eight commonest such shapes, and the first
    of these. A null or empty text has no words; rows with a null key are left
    out, repeated rows come out as often. Whole texts are read, one pass, no
    exchange."""
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(_judge, "doc_id bigint, words bigint, listed bigint, dominant bigint, shape string")


def stuffed_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", share: float = 0.5) -> DataFrame:
    """(doc_id, shape) of the pages of which more than ``share`` of the words are
    in non-sentence shapes, however many those are, with the commonest shape."""
    pages = page_shapes(documents, key, text)
    return pages.filter(F.col("listed") > share * F.col("words")).select("doc_id", "shape").dropDuplicates(["doc_id"])
