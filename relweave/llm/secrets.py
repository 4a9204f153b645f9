"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A string that a byte-pair vocabulary cuts into short tokens is unlike the text the vocabulary was made from, so
a low number of characters a token exposes keys and passwords. Candidates are long runs of key characters with a
letter; digests (hex of a digest's length), UUIDs and plain numbers are no secrets.

Spans are (kind, start, end) in code points, end exclusive. The kinds: assign, access, hex (fixed patterns,
leftmost, not overlapping within a kind) and token (this test), which is sought in what the others leave. A run that
is no secret as a whole, such as a path, is taken apart at its separators, and its random parts are secrets.

Edge cases: a null text is empty; an empty text has no spans; null or repeated doc_ids give one row each.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm.bpe_codec import vocabulary
from relweave.llm.common import map_arrow, read, worker_cache

#: Patterns of the three base kinds, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "token")

#: Runs that may be a key; the least length; characters a token below which a run counts as random.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RATIO = 2.0
LEAST = 16
SEPARATED = re.compile(r"[A-Za-z0-9]+")
#: Characters of a part that does not end a row of random parts, as a key may hold a separator twice in a row of a few.
SHORT = 3
#: Hex lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and the form of a UUID.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
ALL_HEX = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(spans)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def vocabulary_encoder(path: str):
    """A tiktoken encoding of a rank file, made once a worker."""
    held = worker_cache("secrets")
    if ("tiktoken", path) not in held:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        held["tiktoken", path] = tiktoken.Encoding("runs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held["tiktoken", path]


def is_known(run: str) -> bool:
    """A digest, a UUID or a number."""
    if ALL_HEX.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return True
    return not any(c.isalpha() for c in run)


def outside(start: int, end: int, taken: list[Span]) -> list[tuple[int, int]]:
    """What the taken spans, which are in order of their starts, leave of start to end."""
    out, at = [], start
    for _, s, e in taken:
        if s < end and e > at:
            if s > at:
                out.append((at, s))
            at = e
    return out + [(at, end)] * (at < end)


def random_parts(run: str, efficient) -> list[tuple[int, int]]:
    """Rows of neighbouring parts between separators that are each random, and LEAST characters or more together."""
    out: list[tuple[int, int]] = []
    row: tuple[int, int] | None = None
    for m in [*SEPARATED.finditer(run), None]:
        if m is not None and not efficient(m[0]):
            row = (row[0] if row else m.start(), m.end())
        elif m is None or len(m[0]) > SHORT:
            if row and row[1] - row[0] >= LEAST and not is_known(run[slice(*row)]):
                out.append(row)
            row = None
    return out


def token_spans(text: str, path: str, taken: list[Span], ratio: float = RATIO) -> list[Span]:
    def efficient(part: str) -> bool:
        return len(part) / len(vocabulary_encoder(path).encode_ordinary(part)) >= ratio

    out = []
    for m in RUN.finditer(text):
        for start, end in outside(*m.span(), taken):
            run = text[start:end]
            if end - start < m.end() - m.start():
                # a separator beside another span is no part of the key
                start += len(run) - len(run.lstrip("+/_=-"))
                run = text[start:end].rstrip("+/_-")
            if len(run) < LEAST or is_known(run):
                continue
            if not efficient(run):
                out.append(("token", start, start + len(run)))
            else:
                out += [("token", start + a, start + b) for a, b in random_parts(run, efficient)]
    return out


def scan(text: str, path: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = base_spans(text)
    return base, in_order(base + token_spans(text, path, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_secrets(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_token, base_sha256, spans) of every text."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": cols["k"], **{f"n_{k}": [] for k in KINDS}, "base_sha256": [], "spans": []}
        for text in cols["t"]:
            base, spans = scan(text or "", path)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in spans))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    kept = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    return map_arrow(kept, run, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every maximal run of covered characters replaced."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda s: s[1:]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, path: str) -> DataFrame:
    """documents with secrets replaced and n_chars counted anew; a text without secrets, or null, stays as it is."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t if t is None or not (found := scan(t, path)[1]) else redact(t, found) for t in cols["text"]]
        changed = [a is not b for a, b in zip(texts, cols["text"], strict=True)]
        return cols | {"text": texts, "n_chars": [len(t) if c else n for t, c, n in zip(texts, changed, cols["n_chars"], strict=True)]}

    kept = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return map_arrow(kept, run, "doc_id long, text string, lang string, source string, n_chars long")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
