"""Benchmark decontamination by templates.

Numbers, names and units of a text become typed placeholders; windows of the
remaining template are hash-joined with those of the benchmark, and along each
alignment the values in the placeholders must correspond one to one, so that a
question with other names and numbers is found and a mere look-alike is not.
Items that windows of the template cannot be sure to find, short ones and those
of names and numbers, are also looked for by their exact words.
"""

from __future__ import annotations

import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import as_bytes, doc_id, doc_key, table, text_key

#: Template words of a window; an item with fewer is one window. At least half of a window are words, not placeholders.
WINDOW = 8
#: Items with fewer words have no template; they are looked for by their exact words.
LEAST = 4
#: A benchmark of at most so many bytes of text is sent to each executor, where it takes some twenty times that; a larger one is joined by shuffled window hashes.
SENT_BYTES = 4 << 20
#: Words a worker keeps.
KEPT = 300_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Unit words, in lower case.
UNITS = frozenset(
    b"mm cm m km inch inches ft foot feet yard yards mile miles mg g kg ton tons oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons "
    b"second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees "
    b"gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres mph kmh".split()
)

WORD, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3
PLACEHOLDERS = np.array([0, 1, 2, 3], np.uint64) * np.uint64(0x9E3779B97F4A7C15)


class Lexicon(dict):
    """Number of each word met, with the hash of its core, its kind, and whether a sentence ends with it."""

    def __init__(self):
        self.hash, self.kind, self.stop = array.array("Q"), array.array("b"), array.array("b")

    def __missing__(self, word: bytes) -> int:
        core = word.strip(PUNCTUATION)
        low = core.decode(errors="replace").lower().encode()
        if core[:1].isdigit() and not core.translate(None, b"0123456789.,:/%-"):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if core[:2] != low[:2] else WORD  # two bytes: accented capitals too
        self.hash.append(xxhash.xxh64_intdigest(low or word))
        self.kind.append(kind)
        self.stop.append(word.rstrip(b"\"')]*")[-1:] in b".!?:" if word else 0)
        self[word] = at = len(self)
        return at

    def template(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Token, kind and exact token of each word, and whether the first has a capital; capitals count as names within a sentence only."""
        if len(self) > KEPT:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        kind = np.frombuffer(self.kind, np.int8)[at]
        stop = np.frombuffer(self.stop, np.int8)[at]
        token = np.frombuffer(self.hash, np.uint64)[at]
        capital = bool(len(words)) and kind[0] == CAPITAL
        if len(words):
            begins = np.append(1, stop[:-1]).astype(bool)
            kind = np.where((kind == CAPITAL) & begins, WORD, kind)
        return np.where(kind == WORD, token, PLACEHOLDERS[kind]), kind, token, capital


def windows(token: np.ndarray, kind: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of n template words that are words by half at least."""
    m = len(token) - n + 1
    if m < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + token[i : m + i]
    plain = np.append(0, np.cumsum(kind == WORD))
    at = np.flatnonzero(2 * (plain[n:] - plain[:-n]) >= n)
    return at, h[at]


def item_windows(known: Lexicon, words: list[bytes], n: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """An item's windows: (length, places, hashes, kinds); a negative length marks windows of exact words.

    A document may have anything before the item, also within a line or a
    sentence, so a first word with a capital is taken both as a word and as a
    name. Exact windows are given where a verbatim copy might have no window of
    the template otherwise.
    """
    if not words:
        return []
    token, kind, exact, capital = known.template(words)
    length = min(n, len(words))
    out, sure = [], False
    if len(words) >= LEAST:
        at, h = windows(token, kind, length)
        out.append((length, at, h, kind))
        sure = bool((at > 0).any()) or (len(at) > 0 and not capital)
        if capital:
            token, kind = token.copy(), kind.copy()
            token[0], kind[0] = PLACEHOLDERS[CAPITAL], CAPITAL
            first, h = windows(token[:length], kind[:length], length)
            out.append((length, first, h, kind))
            sure = sure or (len(at) > 0 and len(first) > 0)
    if not sure:
        at, h = windows(exact, np.zeros(len(words), np.int8), length)
        out.append((-length, at, h, np.zeros(len(words), np.int8)))
    return out


def document_windows(token: np.ndarray, kind: np.ndarray, exact: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a document's windows of one length, as in item_windows."""
    return windows(token, kind, n) if n > 0 else windows(exact, np.zeros(len(exact), np.int8), -n)


def slot(word: bytes) -> bytes:
    return word.strip(PUNCTUATION).lower() or word


def aligned(pairs: list[tuple], item_words: int) -> tuple[int, float, int]:
    """Windows that hold, the share of the item in them, and the slots whose values differ.

    pairs: (place in the document, place in the item, length, [slot places], [document's slots], [item's slots]).
    Windows of one alignment must map the item's values to the document's one to one; a window that breaks the map does not hold, and an alignment holds if at least half of its windows do.
    Windows of exact words, of negative length, hold if all of the item's do.
    """
    best = (0, 0.0, 0)
    exact: dict = {}
    for p in pairs:
        if p[2] < 0:
            exact.setdefault(p[0] - p[1], set()).add(p[1])
    for found in exact.values():
        if len(found) == item_words + 1 - min(-p[2] for p in pairs if p[2] < 0):
            best = max(best, (len(found), 1.0, 0))
    pairs = [p for p in pairs if p[2] > 0]
    for shift in {p[0] - p[1] for p in pairs}:
        there, back, seen, held, other = {}, {}, set(), 0, set()
        here = sorted((p for p in pairs if p[0] - p[1] == shift), key=lambda p: p[1])
        for _, at, n, slots, mine, theirs in here:
            t, b = dict(there), dict(back)
            if all(t.setdefault(y, x) == x and b.setdefault(x, y) == y for x, y in zip(mine, theirs)):
                there, back, held = t, b, held + 1
                seen.update(range(at, at + n))
                other.update(at + s for s, x, y in zip(slots, mine, theirs) if x != y)
        if 2 * held >= len(here):
            best = max(best, (held, round(len(seen) / item_words, 6), len(other)))
    return best


def index(items: list[tuple], n: int) -> tuple[dict, list]:
    """Windows of the benchmark by length: (sorted hashes, item, place); and each item's (id, slot values)."""
    known, found, rows = Lexicon(), {}, []
    for item_id, text in items:
        words = (text or b"").split()
        if not words:
            continue
        for length, at, h, _ in item_windows(known, words, n):
            found.setdefault(length, []).append((h, np.full(len(h), len(rows)), at))
        rows.append((item_id, [slot(w) for w in words]))
    out = {}
    for length, parts in found.items():
        h, item, at = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(h, kind="stable")
        if len(h):
            out[length] = h[by], item[by], at[by]
    return out, rows


MATCH = "did long, tk long, item_id long, windows long, coverage double, changed_slots long"


def _match_batch(out: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=[c.split()[0] for c in MATCH.split(", ")])


def _match_sent(sent):
    """sent: index() of the benchmark, as a broadcast variable, which an executor fetches once."""

    def run(batches):
        by_length, rows = sent.value
        known = Lexicon()
        for b in batches:
            out: list = [[] for _ in range(6)]
            for did, tk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                words = (text or b"").split()
                if not words:
                    continue
                token, kind, exact, _ = known.template(words)
                pairs: dict = {}
                for n, (hashes, item, place) in by_length.items():
                    at, h = document_windows(token, kind, exact, n)
                    lo = np.searchsorted(hashes, h)
                    for k in np.flatnonzero(hashes[np.minimum(lo, len(hashes) - 1)] == h):
                        p, j = int(at[k]), int(lo[k])
                        slots = np.flatnonzero(kind[p : p + n] != WORD).tolist() if n > 0 else []
                        mine = [slot(words[p + s]) for s in slots]
                        while j < len(hashes) and hashes[j] == h[k]:
                            i, q = int(item[j]), int(place[j])
                            pairs.setdefault(i, []).append((p, q, n, slots, mine, [rows[i][1][q + s] for s in slots]))
                            j += 1
                for i, found in pairs.items():
                    held, cover, changed = aligned(found, len(rows[i][1]))
                    if held:
                        for o, v in zip(out, (did, tk, rows[i][0], held, cover, changed)):
                            o.append(v)
            yield _match_batch(out)

    return run


WINDOWS = "row long, id long, tk long, words long, h long, n int, at long, slots array<int>, found array<binary>"


def _spread(lengths: list[int] | None, n: int):
    """Rows of all windows: a document's of the given lengths, or a benchmark item's own ones.

    row numbers the texts, with the partition in its high bits, so repeated rows stay apart.
    """

    def run(batches):
        known, row = Lexicon(), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list = [[] for _ in range(9)]
            for i, tk, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                words = (text or b"").split()
                row += 1
                if not words:
                    continue
                if lengths is None:
                    parts = item_windows(known, words, n)
                else:
                    token, kind, exact, _ = known.template(words)
                    parts = [(length, *document_windows(token, kind, exact, length), kind) for length in lengths]
                for length, at, hashes, kind in parts:
                    for p, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        slots = np.flatnonzero(kind[p : p + length] != WORD).tolist() if length > 0 else []
                        for o, v in zip(out, (row, i, tk, len(words), h, length, p, slots, [slot(words[p + s]) for s in slots])):
                            o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names=[c.split()[0] for c in WINDOWS.split(", ")])

    return run


def _align(batches):
    for b in batches:
        out: list = [[] for _ in range(6)]
        for did, tk, item_id, n, found in zip(*(c.to_pylist() for c in b.columns)):
            held, cover, changed = aligned([(p["at"], p["place"], p["n"], p["slots"], p["mine"], p["theirs"]) for p in found], n)
            if held:
                for o, v in zip(out, (did, tk, item_id, held, cover, changed)):
                    o.append(v)
        yield _match_batch(out)


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """did, tk (a hash of the text), item_id, windows, coverage, changed_slots of each document and benchmark item that share a template.

    The benchmark's size decides, by its measured bytes, whether its window
    hashes go to every task or both sides' windows are shuffled by hash; the
    results are the same. Items without a window of the template, those of
    fewer than LEAST words too, match documents that hold all their words,
    whatever their case and the punctuation around them. Null or empty texts
    match nothing; repeated items and documents match each on their own.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = spread(docs.select(doc_key().alias("did"), text_key().alias("tk"), "text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= sent_bytes:
        sent = docs.sparkSession.sparkContext.broadcast(index([(r["item_id"], r["text"].encode()) for r in items.collect()], n))
        return texts.mapInArrow(_match_sent(sent), MATCH)
    theirs = table(items.select("item_id", F.lit(0).cast("long").alias("tk"), "text").mapInArrow(_spread(None, n), WINDOWS), "benchmark")
    lengths = [r["n"] for r in theirs.select("n").distinct().collect()]  # at most 2 x WINDOW values
    mine = texts.mapInArrow(_spread(lengths, n), WINDOWS)
    right = theirs.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("words").alias("item_words"), "h", "n", F.col("at").alias("place"), F.col("found").alias("theirs"))
    both = mine.join(right, ["h", "n"])
    pairs = both.groupBy("row", "item_row", "id", "tk", "item_id", "item_words").agg(F.collect_list(F.struct("at", "place", "n", "slots", F.col("found").alias("mine"), "theirs")).alias("found"))
    return pairs.select("id", "tk", "item_id", "item_words", "found").mapInArrow(_align, MATCH)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, item_id, windows, coverage, changed_slots of each row and item that share a template, as matches() finds them.

    changed_slots is above 0 for a re-parameterised item. Rows with null ids
    are reported with a null id, repeated rows and items each on their own;
    null or empty texts and empty tables give no rows.
    """
    return matches(docs, benchmark, n, sent_bytes).select(doc_id("did").alias("doc_id"), "item_id", "windows", "coverage", "changed_slots")


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of docs, all columns, without those that hold a benchmark item or a re-parameterised one.

    Rows are told apart by id and text, so a null or repeated id does not take
    other rows along; null and empty texts stay; an empty benchmark removes
    nothing.
    """
    gone = table(matches(docs, benchmark, n, sent_bytes).select(F.col("did").alias("__lk_did"), F.col("tk").alias("__lk_tk")).distinct(), "contaminated")
    return docs.join(gone, (doc_key() == F.col("__lk_did")) & (text_key() == F.col("__lk_tk")), "left_anti")
