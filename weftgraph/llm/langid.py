"""Language identification of texts that may mix languages.

Training counts hashed character n-grams of words per language over a bounded
sample of labelled rows; the table has BUCKETS columns, so the model's size
depends on the number of languages alone.  Scoring is one Arrow pass:

1. A word's letters fall into script ranges; the languages that were seen to
   use one of them are its candidates.
2. Each candidate's score is the word's mean n-gram log likelihood, scaled to
   evidence; languages that do not write the script get a fixed low score.
3. Viterbi over the words of a text, with a penalty for every switch, labels
   spans.  Texts of a batch run side by side, longest first, so a step is one
   numpy operation over all that are that long.

The language of a text is that of most letters; score is their share.

Defined cases: a null text, or one without letters, is `und` with score 0; so
is every text if there is no labelled row; equal texts get equal results; ties
go to the language first in order of name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm import textops
from weftgraph.llm.shared import free_names, lean

BUCKETS = 1 << 15
#: Rows of the training sample at most.
SAMPLE_ROWS = 20_000
#: Characters of texts that are labelled at a time (a longer text is taken alone), and words that are scored at a time.
BATCH_CHARS, SCORED_WORDS = 1_000_000, 20_000
SWITCH = 6.0
ABSENT = -12.0

#: First and last code point of the ranges, and their scripts.
SCRIPTS = [
    (0x0041, 0x024F, "latin"),
    (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"),
    (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"),
    (0xAC00, 0xD7AF, "hangul"),
]
_NAMES = [*dict.fromkeys(s for _, _, s in SCRIPTS), "other"]
_OTHER = len(_NAMES) - 1
_SPACE = 0x20
_classes: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its script plus one if it is a letter (alphanumeric, not a decimal digit), else 0; made once a process."""
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        alnum = [c for c in range(0x110000) if (ch := chr(c)).isalnum() and not ch.isdecimal()]
        scripts = np.full(0x110000, _OTHER, np.uint8)
        scripts[:0x250] = 0
        for a, b, name in SCRIPTS:
            scripts[a : b + 1] = _NAMES.index(name)
        table[alnum] = scripts[alnum] + 1
        _classes.append(table)
    return _classes[0]


class Words:
    """The lower-cased words (runs of letters) of several texts as arrays: first[k]:first[k + 1] are those of text k."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower() for t in texts]
        chars = np.frombuffer(f"  {' '.join(low)}  ".encode("utf-32-le"), np.uint32)
        kind = _letters()[chars]
        letter = kind > 0
        #: Code points with a space for whatever is not a letter, so a word's bounds are n-grams like any other.
        self.chars = np.where(letter, chars, _SPACE).astype(np.int64)
        edge = np.diff(letter.astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        size = np.fromiter(map(len, low), np.int64, len(low))
        begin = 2 + np.concatenate(([0], np.cumsum(size + 1)))
        self.first = np.searchsorted(self.start, begin)
        known = np.flatnonzero(letter & (kind != _OTHER + 1))
        at = np.searchsorted(known, self.start)
        at_known = known[np.minimum(at, max(len(known) - 1, 0))] if len(known) else self.start
        has = (at < len(known)) & (at_known < self.end)
        #: The script of a word's first letter in a known range.
        self.script = np.where(has, kind[at_known].astype(np.int64) - 1, _OTHER)

    def __len__(self) -> int:
        return len(self.start)

    def letters(self) -> np.ndarray:
        return self.end - self.start

    def buckets(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words a to b: hashed n-grams of one to three characters, bounds included, and the word itself; with each one's word."""
        start, end = self.start[a:b], self.end[a:b]
        lo, hi = int(start[0]) - 1, int(end[-1]) + 1
        c = self.chars[lo:hi]
        start, end = start - lo, end - lo
        inside = c != _SPACE
        word = np.cumsum(np.concatenate(([False], inside[1:] & ~inside[:-1]))) - 1
        one = np.flatnonzero(inside)
        two = np.flatnonzero(inside[:-1] | inside[1:])
        two_word = np.where(inside[two], word[two], word[np.minimum(two + 1, len(c) - 1)])
        three = one - 1
        sums = textops.prefix_sums(textops.mix(c.astype(np.uint64)))
        whole = (textops.range_hash(sums, start, end) % np.uint64(BUCKETS)).astype(np.int64)
        grams = [
            (c[one] * 40503) % BUCKETS,
            (c[two] * 69069 + c[two + 1] * 1566083 + 7) % BUCKETS,
            (c[three] * 69069 + c[three + 1] * 1566083 + c[three + 2] * 8121 + 1013) % BUCKETS,
            whole,
        ]
        return np.concatenate(grams), np.concatenate((word[one], two_word, word[one], np.arange(b - a)))


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, writes: np.ndarray):
        self.langs, self.logs, self.writes = langs, logs, writes

    def word_scores(self, words: Words) -> np.ndarray:
        """A row for each word: log evidence for each language."""
        out = np.empty((len(words), len(self.langs)), np.float32)
        for a in range(0, len(words), SCORED_WORDS):
            b = min(a + SCORED_WORDS, len(words))
            grams, word = words.buckets(a, b)
            size = np.bincount(word, minlength=b - a)
            sums = np.stack([np.bincount(word, self.logs[grams, k], b - a) for k in range(len(self.langs))], axis=1)
            sums *= (np.minimum(size, 24) / size)[:, None] / 3
            sums -= sums.max(axis=1, keepdims=True)
            np.maximum(sums, ABSENT, out=sums)
            allowed = self.writes[words.script[a:b]]
            out[a:b] = np.where(allowed | ~allowed.any(axis=1, keepdims=True), sums, ABSENT)
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; words of text k stand at first[k]:first[k + 1]."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], first[:-1][order]
    n, k = scores.shape
    stay = np.empty((n, k), bool)
    came = np.empty(n, np.int32)
    live = int((size > 0).sum())
    v = scores[begin[:live]].astype(np.float64)
    ends = np.zeros(len(size), np.int32)
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, steps + 2), "right")
    for t in range(1, steps + 1):
        more = int(alive[t])
        if more < len(v):
            ends[more : len(v)] = v[more:].argmax(axis=1)
            v = v[:more]
        if not more:
            break
        at = begin[:more] + t
        best = v.argmax(axis=1)
        top = v[np.arange(more), best] - switch
        keep = v >= top[:, None]
        stay[at], came[at] = keep, best
        v = np.where(keep, v, top[:, None]) + scores[at]
        if not t % 512:
            v -= v.max(axis=1, keepdims=True)
    out = np.empty(n, np.int32)
    state = ends.copy()
    for t in range(steps - 1, -1, -1):
        m = int(np.searchsorted(-size, -t, "left"))  # texts longer than t
        at = begin[:m] + t
        out[at] = state[:m]
        if t:
            kept = stay[at, state[:m]]
            state[:m] = np.where(kept, state[:m], came[at])
    return out


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of successive texts of about BATCH_CHARS characters (or bytes) together, one text at least."""
    off = np.concatenate(([0], np.cumsum(size)))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(off, off[at] + BATCH_CHARS, "right")) - 1)
        yield at, to
        at = to


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about sample_rows labelled rows, taken by a hash of the id.

    The counts that reach the driver are BUCKETS a language at most.
    """
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = rows.select("lang").count()
    every = max(1, -(-n // sample_rows))
    rows = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(every)) == 0).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        for batch in batches:
            held: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(text)
            for lang, texts in held.items():
                have = grams.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                for a, b in _runs(np.fromiter(map(len, texts), np.int64, len(texts))):
                    words = Words(texts[a:b])
                    for at in range(0, len(words), SCORED_WORDS):
                        to = min(at + SCORED_WORDS, len(words))
                        have[:BUCKETS] += np.bincount(words.buckets(at, to)[0], minlength=BUCKETS)
                    have[BUCKETS:] += np.bincount(words.script, minlength=len(_NAMES))
        for lang, have in grams.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], names=["lang", "bucket", "n"])

    found = rows.mapInArrow(lean(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    table = np.zeros((BUCKETS + len(_NAMES), len(langs)))
    if langs:
        table[found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"].to_pylist())] = found["n"].to_numpy()
    grams, scripts = table[:BUCKETS] + 0.5, table[BUCKETS:]
    logs = np.log(grams / grams.sum(axis=0))
    return Model(langs, logs.astype(np.float32), scripts >= 0.01 * scripts.sum(axis=0))


def label(docs: DataFrame, model: Model, *, text_col: str = "text", spans: bool = True, switch: float = SWITCH, names: tuple[str, ...] = ("_lang", "_score", "_spans")) -> DataFrame:
    """docs with a language, its score and, if asked for, spans (word starts and languages) of each row.

    names are those of the new columns; docs may not have them (free_names() finds some).
    """
    columns = docs.columns
    names = [*names[: 2 + spans]]
    if free_names(columns, *names) != names:
        raise ValueError(f"the table has a column named like one of {names}")
    langs = model.langs
    shared = docs.sparkSession.sparkContext.broadcast((langs, model.logs, model.writes))
    new = [F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), *[F.array().cast("array<struct<word:int,lang:string>>").alias(n) for n in names[2:]]]
    fields = docs.select("*", *new).schema
    names = [*columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = batch.column(columns.index(text_col))
            for at, to in _runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy()):
                n = to - at
                words = Words(texts.slice(at, n).to_pylist() if langs else [None] * n)
                off = words.first
                best, share = np.zeros(n, np.int64), np.zeros(n)
                path = np.zeros(0, np.int32)
                if len(words):
                    path = viterbi(own.word_scores(words), off, switch)
                    row = np.repeat(np.arange(n), np.diff(off))
                    tally = np.bincount(row * len(langs) + path, words.letters(), n * len(langs)).reshape(-1, len(langs))
                    best = tally.argmax(axis=1)
                    total = tally.sum(axis=1)
                    share = np.where(total > 0, tally.max(axis=1) / np.maximum(total, 1), 0)
                filled = np.diff(off) > 0
                cols = [*(c.slice(at, n) for c in batch.columns), pa.array([langs[b] if ok else "und" for b, ok in zip(best, filled)], pa.string()), pa.array(share)]
                if spans:
                    got = []
                    for a, b in zip(off[:-1], off[1:]):
                        edge = np.flatnonzero(np.concatenate(([True], path[a + 1 : b] != path[a : b - 1]))) if b > a else []
                        got.append([{"word": int(e), "lang": langs[path[a + e]]} for e in edge])
                    cols.append(pa.array(got, pa.list_(pa.struct([("word", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(lean(run), fields)
