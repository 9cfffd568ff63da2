"""Problem 8: evaluation texts leaking into training text (BM25, block-max WAND)."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrowkit import MIX, flat, global_codes, grams, local_codes, mix
from weftline.functions.tokens import words
from weftline.session import cut, grows

K1, B = 1.2, 0.75
#: Items in a block of a posting list, and words of items in one part of the index (some 5 MB).
BLOCK, PART_WORDS = 8, 100_000
#: Words between the beginnings of two passages: short passages score little above a span, so fewer items reach the threshold.
STRIDE = 6
#: Scores are sums of at most some 30 products of 32 bits.
ENOUGH = 1 - 1e-4


class ItemIndex:
    """A part of the inverted index: for each term the blocks of items that hold
    it, with the BM25 weight of each item and the greatest of the block.

    Weights of an item are divided by the least score that any ``span``
    consecutive words of it can have, so a passage that shares such a span
    scores at least 1: one threshold for all items, which loses none. Items
    with fewer words have no such span and aren't indexed. Memory grows with
    the postings: nothing is held for a term and a block without it.
    """

    def __init__(self, items: list[tuple[int, list[str], list[int], int]], count: int, mean: float, span: int):
        """``items``: (id, words, number of items that hold each word, number of
        words of the question); ``count`` and ``mean`` of all items."""
        self.span = span
        items = sorted((i for i in items if len(i[1]) >= span), key=lambda i: i[1:2])  # like items share blocks
        self.ids = np.array([i[0] for i in items], np.int64)
        self.size = np.array([len(i[1]) for i in items], np.int64)
        self.question = np.array([i[3] for i in items], np.int64)
        self.blocks = max(1, -(-len(items) // BLOCK))
        entries: dict[tuple[int, int], np.ndarray] = {}
        keys, places = [], []
        for j, (_, tokens, df, _) in enumerate(items):
            idf = {t: np.log(1 + (count - n + 0.5) / (n + 0.5)) for t, n in zip(tokens, df)}
            norm = K1 * (1 - B + B * len(tokens) / mean)
            score = {t: idf[t] * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(tokens).items()}
            least = min(sum(score[t] for t in set(tokens[p : p + span])) for p in range(len(tokens) - span + 1))
            codes = global_codes(pa.array(tokens))
            for t, c in dict(zip(tokens, codes.tolist())).items():
                entries.setdefault((c, j // BLOCK), np.zeros(BLOCK, np.float32))[j % BLOCK] = score[t] / least
            hashes, at = grams(codes, np.array([0, len(tokens)]), span)
            keys.append(self.with_item(hashes, np.full(len(hashes), j)))
            places.append(at)
        # terms are numbered by the length of their lists, longest first: a passage's sorted terms end with its rarest
        lists = Counter(c for c, _ in entries)
        order = sorted(lists, key=lambda c: (-lists[c], c))
        number = {c: k for k, c in enumerate(order)}
        held = sorted((number[c] * self.blocks + b, lanes) for (c, b), lanes in entries.items()) if entries else []
        self.entry = np.array([k for k, _ in held], np.int64)  # term * blocks + block
        self.lanes = np.array([x for _, x in held], np.float32).reshape(-1, BLOCK)
        self.most = self.lanes.max(axis=1)
        self.first = np.searchsorted(self.entry, np.arange(len(order) + 2) * self.blocks)  # of each term, and of unknown words
        self.upper = np.zeros(len(order) + 1, np.float32)
        np.maximum.at(self.upper, self.entry // self.blocks, self.most)
        codes = np.array(order, np.uint64)
        self.by_code = np.argsort(codes)
        self.codes = codes[self.by_code]
        spans, places = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in (keys, places))
        order = np.argsort(spans, kind="stable")
        self.spans, self.places = spans[order], places[order].astype(np.int64)

    @classmethod
    def of(cls, parts: dict) -> ItemIndex:
        """The index again from its ``vars``, which travel as plain arrays."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    @staticmethod
    def with_item(hashes: np.ndarray, item: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(hashes + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def terms(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the terms with these codes; unknown words get the one behind the last."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        none = len(self.codes)
        return np.where(self.codes[at] == codes, self.by_code[at], none) if none else np.full(len(codes), none)

    def _weights(self, of: np.ndarray, held: np.ndarray, first: np.ndarray, passage: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Sums of ``of`` over the entries of the ``first`` terms of each passage in a block."""
        n = first[passage]
        which = np.repeat(np.arange(len(passage)), n)
        key = held[passage[which], np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)] * self.blocks + block[which]
        at = np.searchsorted(self.entry, key)
        here = self.entry[np.minimum(at, len(self.entry) - 1)] == key
        which, found = which[here], of[at[here]]
        if found.ndim == 1:
            return np.bincount(which, found, minlength=len(passage))
        return np.stack([np.bincount(which, lane, minlength=len(passage)) for lane in found.T], axis=1) if len(passage) else np.zeros((0, BLOCK))

    def search(self, terms: np.ndarray, offsets: np.ndarray, size: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, item) of every passage of every row that reaches
        the threshold. Passages start every STRIDE words and are STRIDE - 1 words
        longer than a span, so each run of ``span`` words lies within one.

        Block-max WAND for a batch of passages: the terms of a passage are
        sorted by the length of their lists; up to the pivot their greatest
        weights together stay below the threshold, so an item must hold the
        pivot or a rarer term, and only their lists are opened. A block in them
        is left unless its own maxima, with the greatest weights before the
        pivot and then the maxima of those terms in the block, reach the
        threshold; only items of blocks that do are scored.
        """
        none, out = len(self.codes), []
        n = np.diff(offsets)
        per = -(-n // STRIDE)
        row = np.repeat(np.arange(len(n)), per)
        start = offsets[row] + STRIDE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        top = np.concatenate([[0.0], np.cumsum(self.upper[terms], dtype=np.float64)])
        width = self.span + STRIDE - 1
        stop = np.minimum(start + width, offsets[row + 1])
        live = top[stop] - top[start] >= ENOUGH
        row, start, stop = row[live], start[live], stop[live]
        for a in range(0, len(row), size):
            r, s, e = row[a : a + size], start[a : a + size], stop[a : a + size]
            at = s[:, None] + np.arange(width)
            held = np.where(at < e[:, None], terms[np.minimum(at, len(terms) - 1)], none)
            held.sort(axis=1)
            held[:, 1:][held[:, 1:] == held[:, :-1]] = none  # a word counts once
            held.sort(axis=1)
            upto = np.cumsum(self.upper[held], axis=1)
            opened = (upto >= ENOUGH) & (held < none)
            early = ((upto < ENOUGH) & (held < none)).sum(axis=1)  # the first terms of each passage
            below = np.where(upto < ENOUGH, upto, 0).max(axis=1)  # greatest weights before the pivot
            passage, column = np.nonzero(opened)
            term = held[passage, column]
            length = self.first[term + 1] - self.first[term]
            spot = np.repeat(self.first[term] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            pair, back = np.unique(np.repeat(passage, length) * self.blocks + self.entry[spot] % self.blocks, return_inverse=True)
            bound = np.bincount(back, self.most[spot], minlength=len(pair))
            passage, block = pair // self.blocks, pair % self.blocks
            keep = bound + below[passage] >= ENOUGH
            passage, block, bound = passage[keep], block[keep], bound[keep]
            each = self._weights(self.most, held, early, passage, block)
            keep = bound + each >= ENOUGH
            passage, block = passage[keep], block[keep]
            score = self._weights(self.lanes, held, (held < none).sum(axis=1), passage, block)
            hit, lane = np.nonzero(score >= ENOUGH)
            out.append((r[passage[hit]], s[passage[hit]], block[hit] * BLOCK + lane))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(c) for c in zip(*out))

    def verified(self, codes: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, place in the item) of the spans that a retrieved passage
        really shares with its item, word by word."""
        at = start[:, None] + np.arange(self.span + STRIDE - 1)
        held = codes[np.minimum(at, len(codes) - 1)]
        width = STRIDE
        acc = np.zeros((len(row), width), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.span):
                acc = mix(acc * MIX + held[:, j : j + width])
        inside = start[:, None] + np.arange(width) + self.span <= offsets[row + 1][:, None]
        keys = self.with_item(acc, np.broadcast_to(item[:, None], acc.shape))[inside]
        which = np.nonzero(inside)[0]
        lo, hi = np.searchsorted(self.spans, keys), np.searchsorted(self.spans, keys, "right")
        n = hi - lo
        spot = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        which = np.repeat(which, n)
        return row[which], item[which], self.places[spot]

    def covered(self, row: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, words of the question, words of the answer that lie in
        shared spans), one for each row and item."""
        if not len(row):
            return row, item, place, place
        word = (place[:, None] + np.arange(self.span)).ravel()
        rows = np.unique(np.stack([np.repeat(row, self.span), np.repeat(item, self.span), word], axis=1), axis=0)
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        heads = np.flatnonzero(new)
        asked = rows[:, 2] < self.question[rows[:, 1]]
        return rows[heads, 0], rows[heads, 1], np.add.reduceat(asked.astype(np.int64), heads), np.add.reduceat((~asked).astype(np.int64), heads)


def _build(count: int, mean: float, span: int):
    """Rows (part, id, words, df, question) sorted by part -> one pickled index a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, items = None, []

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([pickle.dumps(vars(ItemIndex(items, count, mean, span)))], pa.binary())], names=["index"])

        for batch in batches:
            for p, i, w, df, q in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and items:
                    yield done()
                    items = []
                part = p
                items.append((i, w, df, q))
        if items:
            yield done()

    return run


def _probe(parts: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), *[(c, pa.int32()) for c in COUNTS]]
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, values = flat(batch.column(1))
            local, tokens = local_codes(values)
            own = global_codes(pa.array(tokens, pa.string()))
            if not len(local):
                continue
            for part in parts:
                index = ItemIndex.of(pickle.loads(part.value))
                row, start, item = index.search(index.terms(own)[local], offsets)
                if len(parts) > 1 and part._path is not None:
                    part.__dict__.pop("_value", None)  # read again for the next batch, so that one part is held at a time
                row, item, question, answer = index.covered(*index.verified(own[local], offsets, row, start, item))
                n, q = index.size[item], index.question[item]
                columns = [ids[row], index.ids[item], q, question, n - q, answer]
                yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[k for k, _ in kinds])

    return run


COUNTS = ["question_words", "question_shared", "answer_words", "answer_shared"]


def leak_overlap(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", span: int = 12, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, question_words, question_shared, answer_words,
    answer_shared): documents and the test items with which they have at least
    ``span`` consecutive words in common, and how many words of the item's
    question and of its answer, its last sentence, lie in such spans. An item
    of one sentence is all question. No pair comes twice; of a repeated
    document id the greatest counts come out.

    The items are indexed; every passage of every document is a query against
    the index, and what reaches the threshold is verified word by word (64-bit
    hashes of the spans). The threshold is the least score of a shared span, so
    nothing is lost, and documents take no exchange but that for repeated ids.

    Words are the longest runs of letters and digits of the lower-cased text.
    Null ids and texts, and texts shorter than ``span`` words, match nothing.
    Document frequencies are counted over all items. Executors build the index
    in parts of about ``part_words`` words, each in one task; the driver hands
    on one part at a time. Documents are read and split into words once,
    however many parts there are; a task holds one part at a time.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_key).cast("bigint").alias("doc_id"), words(F.col(text)).alias("w")).filter((F.size("w") >= span) & F.col("doc_id").isNotNull())
    last = F.element_at(F.split(F.trim(F.col(text)), r"[.?!]\s+"), -1)
    rows = items.select(F.col(item_key).cast("bigint").alias("item_id"), words(F.col(text)).alias("w"), F.size(words(last)).alias("a")).dropna().filter(F.size("w") > 0)
    n = F.size("w")
    rows = cut(rows.select("item_id", "w", F.when(F.col("a") < n, n - F.col("a")).otherwise(n).alias("q")).distinct())
    count, total = rows.agg(F.count(F.lit(1)), F.sum(F.size("w"))).first()
    if not count:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, " + ", ".join(f"{c} int" for c in COUNTS))
    parts = max(1, -(-total // part_words))
    held = rows.select(F.xxhash64("item_id", "w").alias("key"), "*")
    terms = held.select("key", F.posexplode("w").alias("pos", "t"))
    df = terms.select("key", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    dfs = terms.join(grows(df), "t").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "df"))).alias("d"))
    ready = held.join(grows(dfs), "key").select(F.pmod("key", F.lit(parts)).alias("part"), "item_id", "w", F.transform("d", lambda x: x["df"]).alias("df"), "q")
    built = cut(ready.repartition(parts, "part").sortWithinPartitions("part", "item_id").mapInArrow(_build(count, total / count, span), "index binary"))
    shared = [spark.sparkContext.broadcast(bytes(r[0])) for r in built.toLocalIterator()]
    hits = docs.mapInArrow(_probe(shared), "doc_id bigint, item_id bigint, " + ", ".join(f"{c} int" for c in COUNTS))
    return hits.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in COUNTS])


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", span: int = 12, shard: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id) of ``leak_overlap``; ``shard`` is its ``part_words``."""
    return leak_overlap(documents, items, doc_key, item_key, text, span, shard).select("doc_id", "item_id")
