"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words of letters and digits with one space between them. An item of n characters may
differ from its place in a document by k = n // ``per_error`` edits. It is split into k + 1 pieces; k edits leave one piece at least
untouched, so every match holds a piece exactly. All pieces are searched at once with an Aho-Corasick automaton, each hit
gives the window in which the item would lie, overlapping windows are merged, and Myers' bit-parallel algorithm finds
the smallest distance in the window and where it ends.

The automaton is built of items in blocks of at most ``BLOCK_CHARS`` characters, so what is sent to the executors is
bounded; a larger benchmark takes more passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from barspark.llm.common import pick, text_slices

PER_ERROR = 20
BLOCK_CHARS = 4 << 20
WORDS = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Words with one space before, between and after; empty if there is no word."""
    words = WORDS.findall(text.lower())
    return f" {' '.join(words)} " if words else ""


def budget(n: int, per_error: int = PER_ERROR) -> int:
    return n // per_error


def split_evenly(item: str, parts: int) -> list[tuple[int, str]]:
    """(offset, piece): ``parts`` pieces that make up the item; lengths differ by one at most."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` in ``text`` (first end of the smallest distance), None above ``most``.

    Myers' algorithm with one Python integer as the column of vertical differences, whatever the pattern's length.
    """
    m = len(pattern)
    if not m:
        return (0, 0)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = mask, 0, m
    best = (m, 0) if m <= most else None
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | vn
        xh = (((eq & vp) + vp) ^ vp) | eq
        hp = vn | ~(xh | vp) & mask
        hn = vp & xh
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp = hp << 1 & mask  # the text may start anywhere: the row above is all zeros
        hn = hn << 1 & mask
        vp = hn | ~(xv | hp) & mask
        vn = hp & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
    return best


class Matcher:
    """Automaton over the pieces of some items: (item id, normalised text, error budget)."""

    def __init__(self, items: list[tuple[int, str, int]]) -> None:
        self.items = items
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, k) in enumerate(items):
            for offset, piece in split_evenly(text, k + 1):
                places.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item number, distance, end in the normalised text), the best place of each item that matches."""
        if not self.items or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            start = end + 1 - size
            for i, offset in where:
                _, item, k = self.items[i]
                a, b = max(0, start - offset - k), min(len(text), start - offset + len(item) + k)
                if b - a >= len(item) - k:
                    windows.setdefault(i, []).append([a, b])
        found = []
        for i, spans in windows.items():
            _, item, k = self.items[i]
            best, spans = None, sorted(spans)
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                got = myers(item, text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
            if best:
                found.append((i, *best))
        return found


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str, int]]]:
    """Items in blocks of bounded size, read one partition at a time. Items without a word, or with a null text, match nothing."""
    block, size = [], 0
    for r in pick(benchmark, item_id=item_id, text=text).where("text is not null").toLocalIterator():
        t = normal(r["text"])
        if not t:
            continue
        block.append((r["item_id"], t, budget(len(t), per_error)))
        size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): each item found in each row of ``docs``, with its smallest edit distance.

    ``end`` is the place of the match's last character in the normalised text (the first of equal ones). Items whose texts are
    equal are each reported. Null or empty texts match nothing; repeated rows are each reported.
    """
    x = pick(docs, doc_id=doc_id, text=text)
    kind, item_kind = x.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, distance int, end long"
    arrow = to_arrow_type(item_kind)

    def searching(items: list[tuple[int, str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for part, texts in text_slices(batches):
                rows = [(j, *m) for j, t in enumerate(texts) for m in matcher.search(normal(t))]
                row, item, distance, end = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array([items[i][0] for i in item], arrow),
                                                  pa.array(distance, pa.int32()), pa.array(end, pa.int64())], ["doc_id", "item_id", "distance", "end"])
        return run

    out = None
    for items in item_blocks(benchmark, item_id, per_error=per_error, block_chars=block_chars):
        got = x.mapInArrow(searching(items), schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", per_error: int = PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of the rows in which no item was found. One filtering pass over the rows per block of items, no join."""
    def clean(items: list[tuple[int, str, int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items)
            for part, texts in text_slices(batches, text):
                yield part.filter(pa.array([not matcher.search(normal(t)) for t in texts], pa.bool_()))
        return run

    for items in item_blocks(benchmark, per_error=per_error, block_chars=block_chars):
        docs = docs.mapInArrow(clean(items), docs.schema)
    return docs
