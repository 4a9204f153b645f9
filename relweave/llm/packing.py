"""Best-fit decreasing packing of token sequences.

Documents are encoded, given an end id, and cut into full windows; what is left of each goes into the tightest
open window that holds it. Pieces are dealt into groups of bounded size by a hash of (doc_id, start), so one
task packs at most about GROUP pieces and no source, copy group or long document makes a hot task; the cost is
at most a few unfilled windows a group.

Edge cases: a null text is empty and holds the end id only; a null doc_id is packed like any other; repeated
rows are packed once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.bpe import Bpe, id_bytes
from relweave.llm.bpe_codec import vocabulary
from relweave.llm.common import map_arrow, map_groups, materialize, read, worker_cache

WINDOW = 2048
#: Pieces that one task packs, on average.
GROUP = 16_384
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """Segment tree over remaining capacities: finds the smallest one that is at least some size."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node, count = self.leaves + capacity, self.count
        while node:
            count[node] += by
            node >>= 1

    def put(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(window, its capacity), the tightest with room for need; None if there is none."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not count[2 * node])
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.at[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each length, by best fit over falling lengths; ties go by position."""
    where: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree, made = OpenWindows(window), 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if (found := tree.take(lengths[i])) is None:
            found = made, window
            made += 1
        number, room = found
        where[i] = number, window - room
        if room > lengths[i]:
            tree.put(room - lengths[i], number)
    return where


def pieces(docs: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Full windows of every document, and its rest: (doc_id, start, length, ids_crc32, doc_tokens)."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        held, bpe = worker_cache("bpe"), Bpe.load(path)
        cache = held.get(("ids", path)) or held.setdefault(("ids", path), id_bytes(bpe))
        end, step = array("I", [END_ID]).tobytes(), 4 * window
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
        for k, text in zip(cols["k"], cols["t"], strict=True):
            data = b"".join([cache[c] for c in bpe.chunks(text or "")]) + end
            for at in range(0, len(data), step):
                part = data[at : at + step]
                for n, v in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4), strict=True):
                    out[n].append(v)
        return out

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")), run, PIECES)


def pack(parts: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """parts (of PIECES) with sequence_id and offset. parts is read twice, so it should be a table."""
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).cast("long"))

    def run(key: tuple, cols: dict[str, list]) -> Iterator[dict[str, list]]:
        where = best_fit_decreasing(cols["length"], window)
        yield cols | {"sequence_id": [key[0] << 32 | n for n, _ in where], "offset": [o for _, o in where]}

    return map_groups(dealt, ["g"], run, PIECES + ", sequence_id long, offset long", sort=["doc_id", "start", "ids_crc32"])


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    return pack(materialize(pieces(docs, path), "pieces"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary())
