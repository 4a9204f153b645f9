"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

A merge list has a sufficient lookahead L: whatever follows a prefix, token boundaries more than L symbols
before its end stay where they are. So a word of any length is encoded in a buffer of 2 L symbols: once the
buffer is full its tokens that end before the last L symbols are stable and are emitted. A word that ends
earlier is flushed. L comes from the chains of overlapping merge rules (`lookahead`).
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import regex

from relweave.llm.common import worker_cache

#: Fixed value: the pre-tokenizer's pattern of the word vocabulary.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = regex.compile(r"\p{White_Space}+")
#: str.split() also splits at these, which are no white space to the pre-tokenizer.
CONTROL = regex.compile("[\x1c-\x1f]")
END = "</w>"
#: A run of these after a word is one piece.
MARKS = ".,!?;:#$%&*)]}\""


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(shown)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def lookahead(rules: Iterable[tuple[str, str]]) -> int:
    """A sufficient lookahead, in symbols, of merge rules in order of priority; symbols are single characters.

    If two texts share a prefix, the leftmost boundary on which their states differ moves left only when a rule
    straddles it, and the boundary was set by a rule of higher priority. So the distance is at most that of the
    longest chain of rules, priority falling leftwards, in which each rule's string overlaps the start of the one
    before, or holds it. reach[s] is the longest distance from the start of s to the end of the prefix.
    """
    reach: dict[str, int] = {}  # of a whole rule string
    begins: dict[str, int] = {}  # of the rule strings with this start
    most = 1
    for left, right in rules:
        s = left + right
        far = len(s)
        for k in range(1, len(s)):
            far = max(far, begins.get(s[k:], 0) + k)
            for e in range(k + 2, len(s)):
                if (got := reach.get(s[k:e])) is not None:
                    far = max(far, got + k)
        reach[s] = max(reach.get(s, 0), far)
        for e in range(1, len(s) + 1):
            begins[s[:e]] = max(begins.get(s[:e], 0), far)
        most = max(most, far)
    return most


def newer() -> tuple[regex.Pattern, dict[int, str]]:
    """(pattern of a word's pieces, lower case) that are right for characters newer than Python's tables too.

    The regex module, Python and the tokenizers library follow different editions of Unicode. For characters that
    Python does not know and the regex module calls letters or numbers, the library's own matcher and lower case say
    what they are.
    """
    held = worker_cache("bpe")
    if "newer" not in held:
        from tokenizers import Regex, normalizers, pre_tokenizers

        unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
        asked = regex.findall(r"[\p{L}\p{N}]", unknown)
        cut, lower = pre_tokenizers.Split(Regex(WORD), "removed", invert=True), normalizers.Lowercase().normalize_str
        joined = lambda mark: {piece[1] for piece, _ in cut.pre_tokenize_str(" ".join(mark + c for c in asked)) if len(piece) == 2}
        letters, others = joined("a"), joined("!")
        none = r"[^\s\S]"
        held_in = lambda chars: "[" + "".join(sorted(chars)) + "]" if chars else none
        letter = rf"[[\p{{L}}--{held_in(asked)}]||{held_in(letters)}]"
        number = rf"[[\p{{N}}--{held_in(asked)}]||{held_in(set(asked) - letters - others)}]"
        rest = rf"[^[\p{{White_Space}}\p{{L}}\p{{N}}]--{held_in(others)}]"
        pattern = rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{rest}+"
        held["newer"] = regex.compile(pattern, regex.V1), {ord(c): low for c in asked if (low := lower(c)) != c}
    return held["newer"]


class Bpe:
    """A word-end BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + END] for c in chars]
        self.rank = {vocab[a] << 20 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.name = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.byte_of = {c: b for b, c in enumerate(chars)}
        one = lambda t: t[: -len(END) - 1] + chr(0xE000 + ord(t[-len(END) - 1])) if t.endswith(END) and len(t) > len(END) else t  # noqa: E731  a final symbol is one character
        self.lookahead = lookahead((one(a), one(b)) for a, b in pairs)
        self.buffer = 2 * self.lookahead
        self.pieces, self.lower = newer()

    @staticmethod
    def load(path: str) -> Bpe:
        cache = worker_cache("bpe")
        return cache.get(("bpe", path)) or cache.setdefault(("bpe", path), Bpe(path))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges on symbols, by priority, then from the left."""
        if len(ids) > 100:
            return self._merge_long(ids)
        get, none = self.rank.get, 1 << 30
        ranks = [get(ids[i] << 20 | ids[i + 1], none) for i in range(len(ids) - 1)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [new := self.made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, none)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], alive[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := get(ids[i] << 20 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (q, i))
            if (p := before[i]) >= 0 and (q := get(ids[p] << 20 | ids[i])) is not None:
                heapq.heappush(heap, (q, p))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def stream(self, symbols: Iterable[int]) -> Iterator[int]:
        """Tokens of one word, emitted once stable; holds at most `buffer` symbols."""
        held: list[int] = []
        for s in symbols:
            held.append(s)
            if len(held) >= self.buffer:
                stable, used = 0, 0
                tokens = self.merge(list(held))
                for t in tokens:
                    width = self.width(t)
                    if used + width > len(held) - self.lookahead:
                        break
                    used, stable = used + width, stable + 1
                yield from tokens[:stable]
                del held[:used]
        yield from self.merge(held)

    def width(self, token: int) -> int:
        name = self.name[token]
        return len(name) - len(END) if name.endswith(END) and len(name) > len(END) else len(name)

    def word(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        return self.merge(symbols) if len(symbols) <= self.buffer else list(self.stream(symbols))

    def chunk(self, text: str) -> list[int]:
        """Tokens of a lower-case string without white space."""
        if text.isalpha():
            return self.word(text)
        if not text.isascii():
            text = text.translate(self.lower)
        return [i for piece in self.pieces.findall(text) for i in self.word(piece)]

    def chunks(self, text: str) -> Iterator[str | int]:
        """Normalised strings without white space, and the ids of special tokens between them."""
        if "<|" in text and self.split_special is not None and self.split_special.search(text):
            at = 0
            for m in self.split_special.finditer(text):
                yield from normal_chunks(text[at : m.start()])
                yield self.special[m.group()]
                at = m.end()
            yield from normal_chunks(text[at:])
        else:
            yield from normal_chunks(text)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in ([c] if isinstance(c, int) else self.chunk(c))]


def normal_chunks(text: str) -> list[str]:
    """NFC, lower case by single characters, split at white space."""
    text = unicodedata.normalize("NFC", text)
    if "Σ" in text:  # no final form of sigma: each character is lowered by itself
        text = text.replace("Σ", "σ")
    if CONTROL.search(text):
        return [c for c in SPACE.split(text.lower()) if c]
    return text.lower().split()


class ChunkCache(dict):
    """Value of each chunk, made on a miss. Two generations of at most `cap` entries, so memory is bounded."""

    def __init__(self, make: Callable, cap: int = 400_000):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, chunk):
        got = self.old.get(chunk)
        if got is None:
            got = self.make(chunk)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        if not isinstance(chunk, str) or len(chunk) < 200:
            self[chunk] = got
        return got


def id_bytes(bpe: Bpe) -> ChunkCache:
    """Little-endian 32-bit ids of a chunk. A word and the marks after it are pieces of their own."""

    def make(c: str | int) -> bytes:
        if isinstance(c, str) and not c.isalpha() and (core := c.rstrip(MARKS)) != c and core.isalpha():
            return cache[core] + cache[c[len(core) :]]
        return array("I", [c] if isinstance(c, int) else bpe.chunk(c)).tobytes()

    cache = ChunkCache(make)
    return cache


class Decoder:
    """Incremental decoder: feed ids, get text.

    style "listed" gives the library's text for a file without a decoder: the vocabulary's strings with a space
    between. style "plain" maps byte-level characters to bytes and word ends to spaces; bytes become text through
    the UTF-8 state machine, which holds at most three bytes, and broken bytes become U+FFFD.
    """

    def __init__(self, bpe: Bpe, style: str = "listed"):
        self.bpe, self.style, self.first = bpe, style, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        out = []
        for i in ids:
            name = self.bpe.name[i]
            if self.style == "listed":
                data = name.encode() if self.first else b" " + name.encode()
                self.first = False
            elif name in self.bpe.special:
                data = name.encode()
            else:
                word = name.endswith(END) and len(name) > len(END)
                data = bytes(self.bpe.byte_of[c] for c in (name[: -len(END)] if word else name)) + b" " * word
            out.append(self.machine.decode(data))
        return "".join(out)

    def end(self) -> str:
        return self.machine.decode(b"", True)
