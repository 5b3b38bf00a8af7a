"""Benchmark decontamination by an FM-index per training shard.

A window is ``width`` consecutive words of a benchmark item (an item of
fewer words, but not none, is one window). Each task gathers whole documents
into shards of at most ``shard_words`` words, builds the FM-index of a shard
(documents end with separators of their own, so no window crosses them),
searches all windows backward, locates their occurrences and merges them into
the spans to remove. A document longer than a shard is indexed in pieces that
overlap by the longest window less a word. Nothing is shuffled.

The windows are a table that Spark makes: distinct pairs of a window and an
item that has it, so repeated items cost nothing and a long item is many rows.
The pairs are dealt by hash into blocks of ``block_bytes`` (a window of very
many items into several); each block is sent to the tasks and searched for in
all documents. With more than one block the documents are numbered and kept
first, and what the blocks found is merged by that number.

Cases: null or empty texts have no words; an empty benchmark, or items
without words, hit nothing; repeated items count once; an item without id
marks words but is not listed; repeated document rows each get their result;
input columns that clash with a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epilens.llm.common import ALNUM_FOLD, alnum_words, fresh, lean, prepare, stage, to_bytes
from epilens.llm.fm_index import FMIndex

WIDTH = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_PIECE_COLUMNS = ("n_words", "spans", "items")
RESULT = (*_PIECE_COLUMNS, "n_hit", "cleaned")

Windows = dict[tuple[bytes, ...], set]
_PAIRS = "item_id long, window binary"
_PAIR_BYTES = 100  # of a pair in the tasks, beside its words


def window_table(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window): the distinct windows of each item, their words joined
    by a space. items: (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0), b.column(1)):
                words = alnum_words(text.as_py())
                n = max(1, len(words) - width + 1) if words else 0
                for a in range(0, n, 1 << 14):
                    own = list({b" ".join(words[i : i + width]) for i in range(a, min(n, a + (1 << 14)))})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "window"]
                    )

    return items.select("item_id", "text").mapInArrow(lean(run), _PAIRS).distinct()


def _grouped(pairs) -> Windows:
    """Window -> ids of the items that have it."""
    out: Windows = {}
    for item, window in pairs:
        out.setdefault(tuple(bytes(window).split(b" ")), set()).add(item)
    return out


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Union of [start, stop) rows; touching spans become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    stop = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > stop[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.column_stack([spans[new, 0], stop[last]])


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Shard:
    """Documents of one shard, and the search over them."""

    def __init__(self, windows: Windows, limit: int):
        self.by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for w in windows:
            self.by_length.setdefault(len(w), []).append(w)
        self.windows, self.limit = windows, limit
        self.overlap = max(self.by_length, default=1) - 1
        self.clear()

    def clear(self) -> None:
        self.numbers, self.pieces, self.size = _Numbers(), [], 0
        self.n_words: list[int] = []

    def full(self) -> bool:
        return self.size >= self.limit

    def add(self, text: str | None) -> None:
        words = alnum_words(text)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        for at in range(0, len(ids), self.limit):
            self.pieces.append((len(self.n_words), at, ids[at : at + self.limit + self.overlap]))
        self.size += len(ids) + 1
        self.n_words.append(len(ids))

    def groups(self):
        """Pieces by index: as many as fit, at least one."""
        group, size = [], 0
        for p in self.pieces:
            if group and size + len(p[2]) > self.limit + self.overlap:
                yield group
                group, size = [], 0
            group.append(p)
            size += len(p[2])
        if group:
            yield group

    def results(self) -> Iterator[tuple[int, np.ndarray, list]]:
        """(words, merged spans, sorted item ids) of each document."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc, start, stop
        listed: set[tuple[int, object]] = set()
        for group in self.groups():
            found += self._search(group, listed)
        doc = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        span = np.concatenate([np.column_stack(f[1:]) for f in found]) if found else np.empty((0, 2), np.int64)
        order = np.argsort(doc, kind="stable")
        doc, span = doc[order], span[order]
        items: dict[int, list] = {}
        for d, item in listed:
            if item is not None:
                items.setdefault(d, []).append(item)
        for d, n in enumerate(self.n_words):
            a, b = np.searchsorted(doc, [d, d + 1])
            yield n, merge_spans(span[a:b]), sorted(items.get(d, ()))

    def _search(self, group, listed: set):
        parts = len(group)
        s = np.concatenate([x for k, (_, _, ids) in enumerate(group) for x in (ids + parts, [k])])
        index = FMIndex(s)
        starts = np.cumsum([0, *[len(ids) + 1 for _, _, ids in group]])[:-1]
        docs = np.array([d for d, _, _ in group])
        offset = np.array([o for _, o, _ in group])
        for length, own in self.by_length.items():
            known = [w for w in own if all(x in self.numbers for x in w)]
            if not known:
                continue
            patterns = np.array([[self.numbers[x] + parts for x in w] for w in known], np.int64)
            patterns = np.where(patterns > s.max(), -1, patterns)  # words of later pieces only
            keep = (patterns >= 0).all(axis=1)
            known = [w for w, k in zip(known, keep) if k]
            for p, at in index.occurrences(patterns[keep]):
                k = np.searchsorted(starts, at, side="right") - 1
                begin = at - starts[k] + offset[k]
                for d, w in np.unique(np.column_stack([docs[k], p]), axis=0).tolist():
                    listed.update((d, item) for item in self.windows[known[w]])
                yield docs[k], begin, begin + length


def remove_spans(text: str, spans) -> str:
    """``text`` without the words of the spans and what lies between them."""
    raw = to_bytes(text)
    words = [m.span() for m in _WORD.finditer(raw.translate(ALNUM_FOLD))]
    out, at = [], 0
    for start, stop in spans:
        out.append(raw[at : words[start][0]])
        at = words[stop - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def _search_block(docs: DataFrame, keep: list[str], text: str, windows: Windows, shard_words: int, cleaned: bool) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name in keep]
    fields = [*kept, T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.LongType()))]
    if cleaned:
        fields.append(T.StructField("cleaned", T.StringType()))
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    names = [f.name for f in kept]

    def flush(shard: Shard, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        found = list(shard.results())
        shard.clear()
        columns = [t.column(n).combine_chunks() for n in names]
        columns.append(pa.array([n for n, _, _ in found], pa.int64()))
        columns.append(pa.array([[{"start": a, "stop": b} for a, b in sp.tolist()] for _, sp, _ in found], _PA_SPANS))
        columns.append(pa.array([items for _, _, items in found], pa.list_(pa.int64())))
        if cleaned:
            texts = t.column(text).to_pylist()
            columns.append(pa.array([remove_spans(x, sp.tolist()) if len(sp) else x for x, (_, sp, _) in zip(texts, found)], pa.string()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(sent.value, shard_words), []
        for b in batches:
            texts, since = b.column(b.schema.get_field_index(text)), 0
            out = b.select(list(dict.fromkeys([*names, *([text] if cleaned else [])])))
            for i in range(b.num_rows):
                shard.add(texts[i].as_py())
                if shard.full():
                    yield flush(shard, [*held, out.slice(since, i + 1 - since)])
                    held, since = [], i + 1
            if since < b.num_rows:
                held.append(out.slice(since))
        if held:
            yield flush(shard, held)

    return docs.select(*[F.col(f"`{n}`") for n in dict.fromkeys([*names, text])]).mapInArrow(lean(run), T.StructType(fields))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    cleaned: bool = False,
) -> DataFrame:
    """Per document row: the columns ``keep`` (default: the id), ``n_words``,
    ``spans`` (hit word ranges, merged), ``items`` (ids with an occurring
    window, ascending), ``n_hit`` and, if ``cleaned``, the text without the
    spans."""
    prepare(docs.sparkSession)
    keep = [c for c in (keep or [doc_id]) if c.lower() not in RESULT]
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    pairs = stage(window_table(items, width), "benchmark-windows")
    size = pairs.agg(F.coalesce(F.sum(F.length("window") + _PAIR_BYTES), F.lit(0))).first()[0]
    blocks = -(-int(size) // block_bytes) or 1

    def block(b: int) -> Windows:
        own = F.pmod(F.xxhash64("item_id", "window"), F.lit(blocks)) == b
        return _grouped(tuple(r) for r in pairs.where(own).collect())  # about block_bytes

    if blocks == 1:
        return _with_hits(_search_block(docs, keep, text, block(0), shard_words, cleaned))
    number, shown = fresh(docs, "_row"), list(dict.fromkeys([*keep, text]))
    rows = docs.select(*[F.col(f"`{c}`") for c in shown]).withColumn(number, F.monotonically_increasing_id())
    rows = stage(rows, "contamination-rows")  # numbered once, however often they are read
    parts = None
    for b in range(blocks):
        part = _search_block(rows, [number], text, block(b), shard_words, False).where((F.size("spans") > 0) | F.lit(b == 0))
        parts = part if parts is None else parts.unionByName(part)
    found = parts.groupBy(F.col(number).alias("_of")).agg(
        F.first("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    found = rows.join(found, F.col(number) == F.col("_of"))
    out = [F.col(f"`{c}`") for c in keep] + [F.col(c) for c in _PIECE_COLUMNS]
    if cleaned:
        out.append(_removed(F.col(f"`{text}`"), F.col("spans")).alias("cleaned"))
    return _with_hits(found.select(*out))


def _merged(lists: Column) -> Column:
    """The union of each row's spans."""

    @F.arrow_udf(_SPANS)
    def union(lists: pa.Array) -> pa.Array:
        out = []
        for own in lists:
            spans = np.array([(x["start"], x["stop"]) for x in own.as_py() or ()], np.int64).reshape(-1, 2)
            out.append([{"start": a, "stop": b} for a, b in merge_spans(spans).tolist()])
        return pa.array(out, _PA_SPANS)

    return union(lists)


def _removed(text: Column, spans: Column) -> Column:
    """The text without the spans."""

    @F.arrow_udf("string")
    def remove(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = ((t.as_py(), own.as_py()) for t, own in zip(texts, lists))
        return pa.array([remove_spans(t, [(x["start"], x["stop"]) for x in own]) if own else t for t, own in rows], pa.string())

    return remove(text, spans)


def _with_hits(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.withColumn("n_hit", hit)
