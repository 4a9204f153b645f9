"""Exact substring deduplication with a logarithmic family of suffix arrays.

A layer is a window length and what it counts: LETTERS takes 400 bytes, PASSAGES 51 words, however short they are in
bytes; there a text is its words' 64-bit hashes, white space apart. All layers go through the same steps at once:

Every window of a text is assigned to an anchor: the smallest-hash string of kgram symbols inside it, the first
of equals. Equal windows have equal anchors, so windows are dealt by anchor. Neighbouring windows with the same
anchor are a segment; a text of n bytes has about n / 150 of them, and only these travel:

1. An anchor that occurs once has no repeated window. Where all segments of an anchor are the same, all their
   windows are repeated. Equal segments of other anchors are repeated too, and are kept once from there on.
2. The distinct segments of the remaining anchors go to tasks by anchor. There they arrive in batches; a batch
   gets a suffix array, is merge-scanned against the existing levels for matches of a window, and levels of equal
   size are merged, so a segment takes part in a logarithmic number of merges (`LogIndex`).
3. An anchor with more than HOT distinct segments would make a task large. Its windows are counted one by one
   by hash of their bytes instead, in a partial aggregation.

Edge cases: a null text is empty; a text shorter than the window keeps all bytes; equal texts (repeated rows too)
repeat each other; rows are told apart by 128 bits of hash of doc_id and text, so a null or repeated doc_id does no
harm; an empty table gives no rows; other columns are ignored. Long texts are taken in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.common import map_arrow, materialize, read, shuffle_partitions, worker_cache

WORD = re.compile(r"\S+")


class Layer(NamedTuple):
    """Symbols of a window and of an anchor, and bytes of a symbol: 1 for bytes, 8 for hashes of words."""

    window: int
    kgram: int
    unit: int


LETTERS, PASSAGES = Layer(400, 96, 1), Layer(51, 12, 8)
#: Window starts that are taken at a time; with a window they have to stay below 2**20.
PIECE = (1 << 20) - 2 * LETTERS.window
#: Symbols of short texts that are taken together; few enough for a processor's cache.
TOGETHER = 1 << 15
#: Bytes of a batch, and distinct segments of an anchor beyond which it is hot.
BATCH, HOT = 1 << 22, 2000
BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64."""
    held = worker_cache("suffix")
    if "powers" not in held or len(held["powers"][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        held["powers"] = tuple(both)
    up, down = held["powers"]
    return up[:n], down[:n]


def segments(data: np.ndarray, window: int, kgram: int, ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor hash) of each segment of at most about 2 ** 20 symbols.

    ends: where the texts in data end, if it holds several one after another; no window reaches into the next."""
    n, width = len(data), window - kgram + 1
    if n < window:
        none = np.empty(0, np.int64)
        return none, none, none
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    h = (total[kgram:] - total[:-kgram]) * down[: n - kgram + 1]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    low20 = np.uint64(0xFFFFF)
    packed = (h & ~low20) | np.arange(len(h), dtype=np.uint64)
    count = n - window + 1
    rows = -(-len(packed) // width)
    full = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[: len(packed)] = packed
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & low20).astype(np.int64)
    # an anchor inside one text is in no other, so only windows across an end have to go
    whole = np.ones(count + 1, bool)
    for end in (ends or [n])[:-1]:
        whole[max(0, end - window + 1) : end] = False
    whole[count] = False
    change = np.concatenate(([True], np.diff(anchor) != 0, [True]))
    begins = whole & (change | np.concatenate(([True], ~whole[:-1])))
    stops = whole[:-1] & (change[1:] | ~whole[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    return first, last, h[anchor[first]].view(np.int64)


#: What tells rows apart.
KEY = ["row", "twin"]


def row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64(F.lit(1), "text", "doc_id").alias("twin")]


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def as_hashes(text: str | None) -> bytes:
    """Eight bytes a word."""
    words = (text or "").split()
    try:
        return b"".join(map(xxhash.xxh3_64_digest, words))
    except UnicodeEncodeError:
        return b"".join(xxhash.xxh3_64_digest(as_bytes(w)) for w in words)


def coded(text: str | None, unit: int) -> bytes:
    return as_bytes(text) if unit == 1 else as_hashes(text)


def symbols(data: bytes, unit: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if unit == 1 else np.uint64)


def pieces_of(texts: list[bytes], unit: int, window: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Short texts together, and long ones cut: (data, [(text number, its first symbol here, where that is in the text)])."""
    held: list[bytes] = []
    parts: list[tuple[int, int, int]] = []
    size = 0
    for number, raw in enumerate(texts):
        n = len(raw) // unit
        if n > TOGETHER:
            for at in range(0, n - window + 1, PIECE):
                yield raw[at * unit : (at + PIECE + window - 1) * unit], [(number, 0, at)]
        elif n >= window:
            if held and size + n > TOGETHER:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            held.append(raw)
            parts.append((number, size, 0))
            size += n
    if held:
        yield b"".join(held), parts


def all_segments(docs: DataFrame, layers: list[Layer]) -> DataFrame:
    """(row, twin, layer, first, last, anchor, seg) of every segment of every text; seg is a hash of the segment's bytes.

    Anchors of different layers are different but by chance, which does no harm."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*KEY, "layer", "first", "last", "anchor", "seg")}
        keys = {k: np.array(cols[k], np.int64) for k in KEY}
        for number, (window, kgram, unit) in enumerate(layers):
            for data, parts in pieces_of([coded(t, unit) for t in cols["text"]], unit, window):
                texts, starts, offsets = (np.array(p, np.int64) for p in zip(*parts, strict=True))
                first, last, anchor = segments(symbols(data, unit), window, kgram, [*starts[1:].tolist(), len(data) // unit])
                seg = [xxhash.xxh3_64_intdigest(data[f * unit : (e + window) * unit]) for f, e in zip(first.tolist(), last.tolist(), strict=True)]
                part = np.searchsorted(starts, first, "right") - 1
                move = (offsets - starts)[part]
                for k in KEY:
                    out[k].append(keys[k][texts[part]])
                for name, value in zip(("layer", "first", "last", "anchor", "seg"), (np.full(len(first), number), first + move, last + move, anchor ^ number, np.array(seg, np.uint64).view(np.int64)), strict=True):
                    out[name].append(value)
        return {n: np.concatenate(v) if v else [] for n, v in out.items()}

    return map_arrow(docs.select(*row_key(), "text"), run, "row long, twin long, layer int, first int, last int, anchor long, seg long")


def new_ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place of the first equal key, whether the key is not alone), the last two in that order."""
    order = np.argsort(key).astype(np.uint32)
    key = key[order]
    begins = np.concatenate(([True], key[1:] != key[:-1], [True]))
    del key
    return order, group_starts(begins[:-1]), ~(begins[:-1] & begins[1:])


def group_starts(begins: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where begins is true."""
    starts = np.flatnonzero(begins).astype(np.uint32)
    return np.repeat(starts, np.diff(starts, append=np.uint32(len(begins))))


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of length symbols at each position, in lexicographic order, by prefix doubling; zeros follow the end.

    A rank is the number of smaller strings. Only positions whose rank is shared are sorted again. Positions and ranks
    take 32 bits: a task holds segments of an anchor's distinct texts, of which HOT bounds the number."""
    n, have = len(text), 8 if text.dtype == np.uint8 else 1
    padded = np.concatenate((text, np.zeros(length + 8, text.dtype)))
    size = n + length
    key = np.zeros(size, np.uint64)
    for i in range(have):
        key <<= np.uint64(8)
        key |= padded[i : i + size]
    order, place, shared = new_ranks(key)
    del key, padded
    # one more, for what is beyond the end
    rank = np.zeros(size + 1, np.uint32)
    rank[order] = place
    left = order[shared]
    while have < length and len(left):
        step = min(have, length - have)
        own = rank[left]
        order, place, shared = new_ranks(own.astype(np.uint64) << np.uint64(32) | rank[np.minimum(left + np.uint32(step), np.uint32(size))])
        left, own = left[order], own[order]
        # a position keeps its old rank, and moves up by what is smaller among those that shared it
        place -= group_starts(np.concatenate(([True], own[1:] != own[:-1])))
        rank[left] = own + place
        left = left[shared]
        have += step
    return rank[:n]


class Level:
    """A text of concatenated segments, and its suffix array over their windows: starts in lexicographic order."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray):
        self.text, self.starts, self.numbers = text, starts, numbers


class LogIndex:
    """Levels of suffix arrays whose sizes are powers of two of a batch; finds the windows that occur twice."""

    def __init__(self, window: int, unit: int = 1):
        self.window, self.unit, self.levels, self.repeated, self.count = window, unit, [], [], 0

    def add(self, batch: list[bytes]) -> None:
        """Add segments of at least window symbols; their windows get the next numbers, segment by segment."""
        sizes = np.array([len(s) // self.unit for s in batch])
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - n, e - self.window + 1) for e, n in zip(ends, sizes, strict=True)])
        numbers = np.arange(self.count, self.count + len(starts))
        self.count += len(starts)
        self.repeated.append(np.zeros(len(starts), bool))
        flags = np.concatenate(self.repeated)
        self.repeated = [flags]
        level, order = self._sorted(symbols(b"".join(batch), self.unit), starts, numbers)
        self._scan(level, order, flags)
        rank = 0
        while rank < len(self.levels) and self.levels[rank] is not None:
            # this level is as large as what has been gathered: the scan's order is the merged level
            level, order = self._merge(self.levels[rank], level)
            self._scan(level, order, flags)
            self.levels[rank] = None
            rank += 1
        for other in self.levels[rank:]:
            if other is not None:
                merged, order = self._merge(other, level)
                self._scan(merged, order, flags)
        if rank == len(self.levels):
            self.levels.append(None)
        self.levels[rank] = level

    def _sorted(self, text: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[Level, np.ndarray]:
        ranks = prefix_ranks(text, self.window)[starts]
        order = np.argsort(ranks, kind="stable")
        return Level(text, starts[order], numbers[order]), ranks[order]

    def _merge(self, a: Level, b: Level) -> tuple[Level, np.ndarray]:
        return self._sorted(np.concatenate((a.text, b.text)), np.concatenate((a.starts, b.starts + len(a.text))), np.concatenate((a.numbers, b.numbers)))

    @staticmethod
    def _scan(level: Level, ranks: np.ndarray, flags: np.ndarray) -> None:
        """Neighbours in suffix order with equal ranks share a whole window."""
        same = np.flatnonzero(ranks[1:] == ranks[:-1])
        flags[level.numbers[same]] = True
        flags[level.numbers[same + 1]] = True


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeated_spans(docs: DataFrame, layers: list[Layer], batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """(row, twin, layer, first, last): runs of windows, by first and last start in symbols, that occur elsewhere too.

    Runs may overlap."""
    spark = docs.sparkSession
    segs = materialize(all_segments(docs, layers), "segments")
    most = segs.count()
    anchors = segs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("low"), F.max("seg").alias("high")).where("n > 1")
    # a table of its own, so that adaptive execution can split a hot anchor in the join
    anchors = materialize(anchors.select("anchor", (F.col("low") == F.col("high")).alias("same")), "anchors", most)
    again = materialize(segs.join(anchors, "anchor"), "again")
    found = [*KEY, "layer", "first", "last"]
    whole = again.where("same").select(found)
    distinct = again.where("not same").groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct(found)).alias("at"))
    distinct = materialize(distinct, "distinct", most)
    many = distinct.where("n > 1").select("anchor", "seg")
    several = again.where("not same").join(many, ["anchor", "seg"], "left_semi").select(found)
    hot_anchors = distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("anchor", F.lit(True).alias("hot"))
    asked = distinct.join(hot_anchors, "anchor", "left").select("at.*", "anchor", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    asked = asked.groupBy(KEY).agg(F.collect_list(F.struct("layer", "first", "last", "anchor", "n", "hot")).alias("want"))
    texts = docs.select(*row_key(), "text").join(asked, KEY).dropDuplicates(KEY)

    def cut(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*KEY, "layer", "first", "anchor", "n", "hot", "data")}
        for row, twin, text, want in zip(cols["row"], cols["twin"], cols["text"], cols["want"], strict=True):
            raw = {number: coded(text, layers[number].unit) for number in {w["layer"] for w in want}}
            for w in want:
                window, _, unit = layers[w["layer"]]
                data = raw[w["layer"]][w["first"] * unit : (w["last"] + window) * unit]
                for name, value in zip(out, (row, twin, w["layer"], w["first"], w["anchor"], w["n"], w["hot"], data), strict=True):
                    out[name].append(value)
        return out

    kinds = "row long, twin long, layer int, first int"
    pieces = materialize(map_arrow(texts.select(*KEY, "text", "want"), cut, f"{kinds}, anchor long, n long, hot boolean, data binary", rows=500), "pieces")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families = [LogIndex(window, unit) for window, _, unit in layers]
        held: list[list[bytes]] = [[] for _ in layers]
        size, owners = [0] * len(layers), [[] for _ in layers]
        for part in batches:
            for row, twin, number, first, data in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                held[number].append(data)
                owners[number].append((row, twin, first, len(data) // layers[number].unit - layers[number].window + 1))
                size[number] += len(data)
                if size[number] >= batch:
                    families[number].add(held[number])
                    held[number], size[number] = [], 0
        for number, family in enumerate(families):
            if held[number]:
                family.add(held[number])
            at, out = 0, []
            for row, twin, first, count in owners[number]:
                out += [(row, twin, number, first + a, first + b) for a, b in runs(family.repeated[0][at : at + count])]
                at += count
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=found)

    cool = pieces.where("not hot").repartition(shuffle_partitions(spark), "anchor").sortWithinPartitions("anchor").select(*KEY, "layer", "first", "data")
    indexed = cool.mapInArrow(index, f"{kinds}, last int")

    def windows(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in (*KEY, "layer", "first", "w", "n")}
        for row, twin, number, first, n, data in zip(*(cols[c] for c in (*KEY, "layer", "first", "n", "data")), strict=True):
            window, _, unit = layers[number]
            count = len(data) // unit - window + 1
            for name, value in zip(out, (row, twin, number, None, None, n), strict=True):
                out[name] += [value] * count if value is not None else []
            out["first"] += range(first, first + count)
            out["w"] += [xxhash.xxh3_128_digest(data[i : i + window * unit]) for i in range(0, count * unit, unit)]
        return out

    each = map_arrow(pieces.where("hot").select(*KEY, "layer", "first", "n", "data"), windows, f"{kinds}, w binary, n long", rows=500)
    counted = each.groupBy("layer", "w").agg(F.sum("n").alias("total")).where("total > 1").select("layer", "w")
    hot_found = each.join(counted, ["layer", "w"], "left_semi").select(*KEY, "layer", "first", F.col("first").alias("last"))
    return whole.union(several).union(indexed).union(hot_found)


def covered(spans: list, number: int, window: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols (start, end) that a layer's runs of windows cover."""
    return merged((s["first"], s["last"] + window) for s in spans if s["layer"] == number)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def with_spans(docs: DataFrame, cols: list[str], layers: list[Layer]) -> DataFrame:
    """cols, text and spans of every row; spans is null where nothing repeats."""
    spans = repeated_spans(docs, layers).groupBy(KEY).agg(F.collect_set(F.struct("layer", "first", "last")).alias("spans"))
    return docs.select(*cols, "text", *row_key()).join(spans, KEY, "left").select(*cols, "text", "spans")


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def digests(docs: DataFrame, window: int = LETTERS.window, words: int = PASSAGES.window) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) of every row.

    The removed bytes are those of the window of bytes alone. A passage is a maximal run of words that are covered by
    windows of words that occur elsewhere; many of them are shorter than the window of bytes."""
    layers = [LETTERS._replace(window=window), PASSAGES._replace(window=words)]

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["doc_id"], **{n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")}}
        for text, spans in zip(cols["text"], cols["spans"], strict=True):
            raw, gone, passages = as_bytes(text), covered(spans or [], 0, window), covered(spans or [], 1, words)
            digest = hashlib.sha256(kept_bytes(raw, gone)).hexdigest()
            for name, value in zip([*out][1:], (len(raw), sum(b - a for a, b in gone), len(gone), digest, len(passages), sum(b - a for a, b in passages)), strict=True):
                out[name].append(value)
        return out

    layout = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"
    return map_arrow(with_spans(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], layers), run, layout)


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes without the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def in_bytes(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as runs of bytes, from the first word's start to the last one's end."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    place = (lambda i: i) if text.isascii() else (lambda i: len(as_bytes(text[:i])))
    return [(place(places[a][0]), place(places[b - 1][1])) for a, b in spans]


def without_repeats(docs: DataFrame, window: int = LETTERS.window, words: int = PASSAGES.window) -> DataFrame:
    """documents without passages of so many bytes, or so many words, that occur elsewhere.

    A character that is covered in part stays; n_chars of a text that is cut is counted anew; a null text stays null."""
    layers = [LETTERS._replace(window=window), PASSAGES._replace(window=words)]

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts, n = [], []
        for text, spans, old in zip(cols["text"], cols["spans"], cols["n_chars"], strict=True):
            if spans:
                raw = as_bytes(text)
                gone = whole_characters(raw, covered(spans, 0, window)) + in_bytes(text, covered(spans, 1, words))
                text = kept_bytes(raw, merged(gone)).decode("utf-8", "surrogatepass")
                old = len(text)
            texts.append(text)
            n.append(old)
        return {"doc_id": cols["doc_id"], "text": texts, "lang": cols["lang"], "source": cols["source"], "n_chars": n}

    typed = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})
    return map_arrow(with_spans(typed, ["doc_id", "lang", "source", "n_chars"], layers), run, "doc_id long, text string, lang string, source string, n_chars long")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
