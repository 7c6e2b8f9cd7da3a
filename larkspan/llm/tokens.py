"""Token ids in files of range asymmetric numeral system (rANS) blocks with one shared table of frequencies.

A block holds whole documents. Its ids are cut into segments of LANES * STEPS;
lane k of a segment codes ids k, k + LANES, ... and the lanes of a segment write
into one stream of 32-bit words. The segments are independent: their states and
places in the stream, kept in the block's head, are the checkpoints from which
any segment is decoded alone; all segments of a block are coded side by side.

Layout of a block, little-endian: magic 4s, n_docs u32, n_ids u64, n_segments
u32, n_words u32, crc32 of the ids as u32; then n_docs x (id i64, ids u32);
n_segments x first word u32; n_segments x LANES states u64; the words u32.
Blocks are rows of Parquet files whose order is that of the documents.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import sys
import types
import unicodedata
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import spread
from .common import NO_ID, as_bytes, doc_id, doc_key, table

#: Frequencies sum to 2^BITS; states lie in [2^31, 2^63).
BITS = 20
LANES, STEPS = 32, 128
#: Ids of a block at least, but for the last of a file; a longer document makes a longer block.
BLOCK = 1 << 19
MAGIC = b"LKR1"
HEAD = "<4sIQIII"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words, and parts of words, whose ids a worker keeps, and their bytes at most; longer ones are encoded each time.
KEPT, KEPT_PARTS, KEPT_BYTES = 1_000_000, 1_000_000, 64

#: Texts encoded at once; their words are objects of over ten times their bytes.
TEXTS = 256
#: The key of packed words; no word is a string.
PACKED = "packed"


# The rules of a tokenizer file under which the ids of a text are those of its words in turn.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(rules: dict) -> bool:
    """Whether a tokenizer file has the rules that word-wise encoding relies on; added tokens hold no white space and start with <|."""
    added = all(t["content"].startswith("<|") and not t["content"].encode().split()[1:] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rules["added_tokens"])
    model = rules["model"]
    return added and rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["truncation"] is None and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]


def coder(path: str):
    """The tokenizer, which of its ids end a word (None if texts must be encoded whole), and the ids of words and of their parts met so far; kept by each worker."""
    kept = sys.modules.setdefault("_larkspan_tokens", types.ModuleType("_larkspan_tokens")).__dict__
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            words = by_words(json.load(f))
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        ends = None
        if words:
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        kept[path] = tokenizer, ends, {}, {}
    for known in kept[path][2:]:
        if PACKED in known:
            words, ids, stops = known.pop(PACKED)
            stops = stops.tolist()
            known.update(zip(words.split(b" "), map(ids.__getitem__, map(slice, [0, *stops], stops))))
    return kept[path]


def rest() -> None:
    """Packs what this worker keeps, some 200 MB of small objects, to a tenth until it encodes again: later stages need the memory."""
    module = sys.modules.get("_larkspan_tokens")
    for kept in [x for x in vars(module).values() if isinstance(x, tuple)] if module else []:
        for words in kept[2:]:
            words.pop(b"", None)  # its ids are none
            if words and PACKED not in words:
                packed = b" ".join(words), b"".join(words.values()), np.cumsum([len(x) for x in words.values()])
                words.clear()
                words[PACKED] = packed
    pa.default_memory_pool().release_unused()


def parted(word: bytes) -> tuple[bytes, bytes]:
    """A word and the ASCII punctuation at its end, where the tokenizer parts them too: after a letter or digit.

    Beyond ASCII, after a letter that is still one letter in lower case (of U+0130 a mark remains, which joins the punctuation) and in its composed form.
    """
    core = word.rstrip(PUNCTUATION)
    if not core or len(core) == len(word) or b"<|" in word:
        return word, b""
    if not (core[-1:].isalnum() if core[-1] < 128 else unicodedata.normalize("NFC", core.decode()[-1]).lower().isalpha()):
        return word, b""
    return core, word[len(core) :]


def _encode_parts(parts: list[bytes], tokenizer, ends: np.ndarray) -> dict[bytes, bytes]:
    """Ids of each part as little-endian 32-bit integers. Parts of letters alone go in together and are told apart by the ids that end a word."""
    out = {}
    text = [p.decode() for p in parts]
    plain = [k for k, t in enumerate(text) if t.isalpha()]
    rest = [k for k, t in enumerate(text) if not t.isalpha()]
    for at in range(0, len(plain), 1000):
        some = plain[at : at + 1000]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(text[k] for k in some)], add_special_tokens=False)[0].ids, np.int64)
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) != len(some):
            rest += some
            continue
        raw, stop = ids.astype("<u4").tobytes(), (4 * stop).tolist()
        out.update((parts[k], raw[a:z]) for k, a, z in zip(some, [0, *stop], stop))
    for at in range(0, len(rest), 4096):
        some = rest[at : at + 4096]
        out.update((parts[k], np.array(e.ids, "<u4").tobytes()) for k, e in zip(some, tokenizer.encode_batch_fast([text[k] for k in some], add_special_tokens=False)))
    return out


def _keep(kept: dict, new: dict[bytes, bytes], most: int) -> None:
    kept.update(islice(((w, ids) for w, ids in new.items() if len(w) <= KEPT_BYTES), max(0, most - len(kept))))


def encode_texts(texts: list[bytes], path: str, end_id: int) -> list[bytes]:
    """Ids of each whole text and the end id, as unsigned 32-bit integers.

    A tokenizer that lowers case, drops white space and never joins what it
    parts gives a text the ids of its words in turn; each word or part is then
    encoded once while kept. A text with the start of a special token's name is
    left in its case. Whether the file has these rules is checked when it is
    read; with others, texts are encoded whole.
    """
    tokenizer, ends, known, cores = coder(path)
    if ends is None:
        return [np.array([*e.ids, end_id], "<u4").tobytes() for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    words = [(t if b"<|" in t else t.lower()).split() for t in texts]
    found = [list(map(known.get, ws)) for ws in words]
    holes = [[k for k, x in enumerate(f) if x is None] for f in found]
    pieces = {w: None for ws, hs in zip(words, holes) for w in map(ws.__getitem__, hs)}
    for w in pieces:
        pieces[w] = parted(w)
    here = {b"": b""}
    here.update(_encode_parts([p for p in {x for two in pieces.values() for x in two if x} if p not in cores], tokenizer, ends))
    for w, (a, b) in pieces.items():
        pieces[w] = (here[a] if a in here else cores[a]) + (here[b] if b in here else cores[b])
    end = np.array([end_id], "<u4").tobytes()
    for ws, f, hs in zip(words, found, holes):
        for k in hs:
            f[k] = pieces[ws[k]]
        f.append(end)
    _keep(cores, here, KEPT_PARTS)
    _keep(known, pieces, KEPT)
    return list(map(b"".join, found))


CODED = "kind int, did long, n long, crc long, z binary, width int"


def _tokenize(path: str, end_id: int):
    """Rows of documents (kind 0), and one that counts the ids of the partition (kind 1: z has the counts)."""

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
        names = [c.split()[0] for c in CODED.split(", ")]
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                gc.disable()  # millions of small objects, none in a cycle
                try:
                    ids = encode_texts([t or b"" for t in as_bytes(part.column(1))], path, end_id)
                finally:
                    gc.enable()
                numbers = [np.frombuffer(x, "<u4") for x in ids]
                count = np.bincount(np.concatenate(numbers))
                total = _sum(total, count)
                width = [2 if len(count) <= 65536 else 4] * len(ids)
                z = [codec.compress(x.astype(f"<u{width[0]}").tobytes(), asbytes=True) for x in numbers]
                columns = ([0] * len(ids), part.column(0), [len(x) for x in numbers], [zlib.crc32(x) for x in ids], z, width)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        if len(total):
            z = codec.compress(total.astype("<i8").tobytes(), asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((1, NO_ID, len(total), 0, z, 8), kinds)], names=names)

    return run


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b.copy(), a
    a[: len(b)] += b
    return a


def _ids(z: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(z, decompressed_size=n * width, asbytes=True), f"<u{width}").astype(np.int64)


def _histogram(batches):
    rest()
    total = np.zeros(0, np.int64)
    for b in batches:
        for n, z in zip(*(c.to_pylist() for c in b.columns)):
            total = _sum(total, _ids(z, n, 8))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])


class Frequencies:
    """Counts scaled to sum to 2^BITS, each at least 1."""

    def __init__(self, counts: dict[int, int]):
        if len(counts) > 1 << (BITS - 1):
            raise ValueError("too many different ids")
        n = np.zeros(max(counts, default=0) + 1, np.int64)
        n[list(counts)] = list(counts.values())
        f = np.where(n > 0, np.maximum(1, n * (1 << BITS) // max(int(n.sum()), 1)), 0)
        while (excess := int(f.sum()) - (1 << BITS)) and f.any():
            top = int(f.argmax())
            f[top] -= min(excess, int(f[top]) // 2) if excess > 0 else excess
        self.f = f.astype(np.uint64)
        self.c = (np.cumsum(f) - f).astype(np.uint64)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))


def encode_block(ids: np.ndarray, dids: list[int], lengths: list[int], freq: Frequencies) -> bytes:
    """Any ids that the frequencies know; the last segment is filled up with the commonest id."""
    span = LANES * STEPS
    segments = max(1, -(-len(ids) // span))
    grid = np.full(segments * span, int(freq.f.argmax()), np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(segments, STEPS, LANES)
    # by step, the lanes of all segments side by side
    grid = np.ascontiguousarray(grid.transpose(1, 0, 2).reshape(STEPS, segments * LANES))
    f, c = freq.f[grid], freq.c[grid]
    top = f << np.uint64(63 - BITS)
    x = np.full(segments * LANES, 1 << 31, np.uint64)
    high, bits = np.uint64(32), np.uint64(BITS)
    lanes, out = [], []
    for t in range(STEPS - 1, -1, -1):
        full = np.flatnonzero(x >= top[t])
        some = x[full]
        lanes.append(full)
        out.append(some.astype("<u4"))  # the low 32 bits
        x[full] = some >> high
        q = x // f[t]
        x -= q * f[t]
        q <<= bits
        x += q
        x += c[t]
    # words of a segment stand in the order in which its decoder takes them: by step, then lane
    seg = np.concatenate(lanes[::-1]) // LANES
    words = np.concatenate(out[::-1])[np.argsort(seg, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(seg, minlength=segments)))[:-1]
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    docs = np.empty(len(dids), [("id", "<i8"), ("n", "<u4")])
    docs["id"], docs["n"] = dids, lengths
    return struct.pack(HEAD, MAGIC, len(dids), len(ids), segments, len(words), crc) + docs.tobytes() + first.astype("<u4").tobytes() + x.astype("<u8").tobytes() + words.tobytes()


def decode_block(block: bytes, freq: Frequencies, slots: np.ndarray, only: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their counts of ids, and the ids; of some segments alone (unchecked) or of all, checked."""
    magic, n_docs, n, segments, n_words, crc = struct.unpack_from(HEAD, block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = struct.calcsize(HEAD)
    docs = np.frombuffer(block, [("id", "<i8"), ("n", "<u4")], n_docs, at)
    at += docs.nbytes
    first = np.frombuffer(block, "<u4", segments, at).astype(np.int64)[only]
    at += 4 * segments
    x = np.frombuffer(block, "<u8", segments * LANES, at).reshape(segments, LANES)[only].astype(np.uint64)
    at += 8 * segments * LANES
    words = np.frombuffer(block, "<u4", n_words, at)
    x = x.ravel()
    grid = np.empty((STEPS, len(x)), slots.dtype)
    mask, high, bits, least = np.uint64((1 << BITS) - 1), np.uint64(32), np.uint64(BITS), np.uint64(1 << 31)
    for t in range(STEPS):
        slot = x & mask
        s = slots[slot.view(np.int64)]
        grid[t] = s
        x >>= bits
        x *= freq.f[s]
        x += slot
        x -= freq.c[s]
        need = np.flatnonzero(x < least)
        seg = need // LANES
        taken = np.bincount(seg, minlength=len(first))
        place = np.arange(len(need)) + (first - (np.cumsum(taken) - taken))[seg]
        x[need] = (x[need] << high) | words[np.minimum(place, n_words - 1)]  # a damaged block may point anywhere
        first = first + taken
    grid = grid.reshape(STEPS, -1, LANES).transpose(1, 0, 2)
    ids = grid.ravel()
    if only == slice(None):
        ids = ids[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    return docs["id"], docs["n"].astype(np.int64), ids


BLOCKS = "part int, seq long, n_ids long, block binary"


def _write(freq: Frequencies):
    def run(batches):
        rest()
        part, seq = TaskContext.get().partitionId(), 0
        parts, dids, lengths, size = [], [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([size], pa.int64()), pa.array([encode_block(np.concatenate(parts), dids, lengths, freq)], pa.binary())], names=["part", "seq", "n_ids", "block"])

        for b in batches:
            for did, n, z, w in zip(*(c.to_pylist() for c in b.columns)):
                parts.append(_ids(z, n, w))
                dids.append(did)
                lengths.append(n)
                size += n
                if size >= BLOCK:
                    yield full()
                    parts, dids, lengths, size, seq = [], [], [], 0, seq + 1
        if parts:
            yield full()

    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, Frequencies]:
    """The blocks (part, seq, n_ids, block) of all documents in ascending order of ids, written; and the shared frequencies.

    A document's ids are those of its whole text (null: empty) and the end id.
    Null ids come first; rows that share an id are ordered by their ids' bytes.
    """
    coded = table(spread(docs.select(doc_key().alias("did"), "text")).mapInArrow(_tokenize(tokenizer_path, end_id), CODED), "ids")
    counts = coded.where("kind = 1").select("n", "z").mapInArrow(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    freq = Frequencies({r["id"]: r["n"] for r in counts.collect()})  # one row per id of the vocabulary
    ordered = coded.where("kind = 0").repartitionByRange("did").sortWithinPartitions("did", "n", "crc", "z").select("did", "n", "z", "width")
    return table(ordered.mapInArrow(_write(freq), BLOCKS), "blocks"), freq


def _read(freq: Frequencies):
    def run(batches):
        rest()
        slots = freq.slots()
        for b in batches:
            for part, seq, block in zip(*(c.to_pylist() for c in b.columns)):
                dids, n, ids = decode_block(block, freq, slots)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part), pa.int32()), pa.array(np.full(len(n), seq), pa.int64()), pa.array(dids), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "seq", "did", "at", "n", "crc"])

    return run


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, from the files that it writes and reads back.

    A null or empty text has the end id alone; repeated rows follow each other;
    no rows give no rows. Totals of files, then of blocks within a file, give
    each block the ids before it.
    """
    blocks, freq = write(docs, tokenizer_path, end_id)
    rows = blocks.select("part", "seq", "block").mapInArrow(_read(freq), "part int, seq long, did long, at long, n long, crc long")
    files = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    files = files.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("files_before"))
    inside = blocks.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("blocks_before"))
    before = inside.join(files, "part").select("part", "seq", (F.col("files_before") + F.col("blocks_before")).alias("before"))
    return rows.join(before, ["part", "seq"]).select(doc_id("did").alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
