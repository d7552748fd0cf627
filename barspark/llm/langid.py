"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1; a letter's vector is rotated by its place in the n-gram and the vectors of
an n-gram are bound by multiplication. A text is the sum (bundle) of its n-gram vectors, a language the sum over its
training texts, and a text is given the language whose prototype has the largest cosine with it.

N-grams are counted first, so each distinct one is bound once per slice of texts; the bundles are then a product of the
count matrix with the n-gram vectors. Letter vectors come from a generator seeded by the code point: nothing about the
alphabet is learned or limited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import pick, text_slices

DIMENSIONS = 1024
GRAM = 3
SEED = 20
GROUP = 256  # texts, or
GROUP_CHARS = 400_000  # letters, or
GROUP_CELLS = 40_000_000  # texts x letters, turned into one count matrix
GRAMS = 8192  # n-grams bound at a time
UNDETERMINED = "und"


class Letters:
    """Vectors of letters (0 is the space between words), made when first needed."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM) -> None:
        self.dimensions, self.gram = dimensions, gram
        self.of: dict[int, int] = {}
        self.rows: list[np.ndarray] = []
        self.is_letter = np.full(0x110000, 2, np.uint8)  # 2: not looked at yet

    def codes(self, text: str) -> np.ndarray:
        """Letters in lower case as numbers; what stands between words becomes one 0, and one 0 stands at either end."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.is_letter[raw]
        if (kind == 2).any():
            for c in np.unique(raw[kind == 2]).tolist():
                self.is_letter[c] = chr(c).isalpha()
            kind = self.is_letter[raw]
        codes = np.concatenate((np.zeros(1, np.int32), np.where(kind == 1, raw, 0).astype(np.int32), np.zeros(1, np.int32)))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        return codes[keep]

    def vector(self, code: int) -> int:
        if code not in self.of:
            self.of[code] = len(self.rows)
            self.rows.append(np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dimensions, np.int8) * 2 - 1)
        return self.of[code]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams given as rows of letter codes: letters rotated by their place, then multiplied."""
        letters, place = np.unique(grams, return_inverse=True)
        rows = np.array([self.vector(int(c)) for c in letters])
        base = np.stack(self.rows)[rows]
        out = np.ones((len(grams), self.dimensions), np.int8)
        place = place.reshape(grams.shape)
        for k in range(self.gram):
            out *= np.roll(base, self.gram - 1 - k, axis=1)[place[:, k]]
        return out


def counted(texts: list[np.ndarray], gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of coded texts: distinct n-grams (rows of codes), and (text, n-gram, count) triples of what each text holds."""
    width = np.array([max(0, len(t) - gram + 1) for t in texts])
    flat = np.concatenate(texts)
    letters, small = np.unique(flat, return_inverse=True)
    start = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    at = np.repeat(start - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
    key = np.zeros(len(at), np.int64)
    for k in range(gram):
        key = key * len(letters) + small[at + k]
    distinct, gram_of = np.unique(key, return_inverse=True)
    both = np.repeat(np.arange(len(texts)), width) * max(1, len(distinct)) + gram_of
    if len(texts) * len(distinct) <= 8 * len(both):  # counting by place is faster than sorting
        count = np.bincount(both, minlength=1)
        both = np.nonzero(count)[0]
        count = count[both]
    else:
        both, count = np.unique(both, return_counts=True)
    grams = np.empty((len(distinct), gram), np.int64)
    rest = distinct.copy()
    for k in reversed(range(gram)):
        grams[:, k] = letters[rest % len(letters)]
        rest //= len(letters)
    return grams, both // max(1, len(distinct)), both % max(1, len(distinct)), count


def cuts(coded: np.ndarray, gram: int) -> Iterator[np.ndarray]:
    """Stretches of a coded text of ``GROUP_CHARS`` n-grams, so that each n-gram is in one of them; none for a text without letters."""
    for at in range(0, len(coded) - gram + 1, GROUP_CHARS):
        yield coded[at:at + GROUP_CHARS + gram - 1]


def bundles(texts: list[str], letters: Letters) -> np.ndarray:
    """One bundle per text (rows of DIMENSIONS doubles); a text without letters has a row of zeros. Long texts count in chunks."""
    out = np.zeros((len(texts), letters.dimensions))
    coded = [letters.codes(t) for t in texts]
    todo, rows, size = [], [], 0

    def flush() -> None:
        nonlocal todo, rows, size
        if todo:
            grams, text, gram, count = counted(todo, letters.gram)
            got = np.zeros((len(todo), letters.dimensions))
            for at in range(0, len(grams), GRAMS):
                here = (gram >= at) & (gram < at + GRAMS) if len(grams) > GRAMS else slice(None)
                dense = np.zeros((len(todo), min(GRAMS, len(grams) - at)), np.float32)
                dense[text[here], gram[here] - at] = count[here]
                got += dense @ letters.bound(grams[at:at + GRAMS]).astype(np.float32)
            if len(set(rows)) == len(rows):
                out[rows] += got
            else:
                np.add.at(out, rows, got)
        todo, rows, size = [], [], 0

    for i, c in enumerate(coded):
        if len(c) < letters.gram:  # no letter at all: the two ends are one 0
            continue
        for part in cuts(c, letters.gram):
            todo.append(part)
            rows.append(i)
            size += len(part)
            if len(todo) >= GROUP or size >= GROUP_CHARS or len(todo) * size >= GROUP_CELLS:
                flush()
    flush()
    return out


@dataclass(frozen=True)
class Profiles:
    """Prototypes, one row per language, in the order of the languages' names."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    gram: int = GRAM

    def name(self, bundle: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each bundle; equal cosines go to the name that sorts first."""
        size = np.linalg.norm(bundle, axis=1)
        if not self.languages:
            return [UNDETERMINED] * len(bundle), np.zeros(len(bundle))
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-300)
        cosine = (bundle / np.maximum(size, 1e-300)[:, None]) @ unit.T
        best = cosine.argmax(axis=1)
        names = [self.languages[b] if s > 0 else UNDETERMINED for b, s in zip(best, size)]
        return names, np.where(size > 0, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0), 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", usable: Column | None = None, dimensions: int = DIMENSIONS, gram: int = GRAM) -> Profiles:
    """Bundle the texts of each language; rows with a null language or for which ``usable`` is not true teach nothing.

    Tasks return sums per language and dimension, which are added up by Spark; whole numbers, so the result does not
    depend on how the rows are spread. What reaches the driver is languages x dimensions numbers.
    """
    x = docs.where(F.col(f"`{lang}`").isNotNull() & (F.lit(True) if usable is None else usable))
    x = pick(x, lang=lang, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(dimensions, gram)
        sums: dict[str, np.ndarray] = {}
        for part, texts in text_slices(batches):
            names = part.column(0).to_pylist()
            for one in sorted(set(names)):
                add = bundle_sum([t for t, n in zip(texts, names) if n == one], letters)
                sums[one] = sums.get(one, 0) + add
        for one, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], ["lang", "dim", "v"])

    got = x.mapInArrow(run, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).toPandas()
    names = tuple(sorted(got["lang"].unique()))
    vectors = np.zeros((len(names), dimensions))
    vectors[[names.index(n) for n in got["lang"]], got["dim"]] = got["v"]
    return Profiles(names, vectors, gram)


def bundle_sum(texts: list[str], letters: Letters) -> np.ndarray:
    """The sum of the texts' bundles as whole numbers, without a bundle for each text."""
    total = np.zeros(letters.dimensions, np.int64)
    todo, size = [], 0

    def flush() -> None:
        nonlocal todo, size, total
        grams, _, gram, count = counted(todo, letters.gram)
        n = np.bincount(gram, weights=count, minlength=len(grams))
        for at in range(0, len(grams), GRAMS):
            total += np.rint(n[at:at + GRAMS] @ letters.bound(grams[at:at + GRAMS]).astype(np.float64)).astype(np.int64)
        todo, size = [], 0

    for t in texts:
        for part in cuts(letters.codes(t), letters.gram):
            todo.append(part)
            size += len(part)
            if size >= 4 * GROUP_CHARS:
                flush()
    if todo:
        flush()
    return total


def predict(docs: DataFrame, profiles: Profiles, keep: dict[str, str], text: str = "text") -> DataFrame:
    """The columns ``keep`` (new name: column) with ``lang_pred`` and ``score``, one row per input row.

    Texts that are null or hold no letter are ``und`` with score 0, and so is everything if no language was learned.
    """
    x = pick(docs, **keep, _text=text)
    schema = x.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters(profiles.vectors.shape[1] if profiles.languages else DIMENSIONS, profiles.gram)
        for part, texts in text_slices(batches, "_text"):
            names, score = profiles.name(bundles(texts, letters))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return x.mapInArrow(run, schema)
