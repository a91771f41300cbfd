"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

A text is cut into pieces by the tokenizer's pattern, and each piece's bytes, written as Latin-1, meet an Aho-Corasick
automaton of all tokens, which gives the longest token from a byte on.  Tokens are laid from the left: the longest first, a shorter prefix where its end is known to be a dead end or where it isn't compatible with the token
before it, and a step back where no prefix fits.  Two neighbours are compatible if merging their joined bytes gives the two
back; answers are memoised.  A row of pairwise compatible tokens is what merging by rank gives, and every end is
given up at most once, so a piece takes time in proportion to its length whatever its bytes.

The vocabulary's tables (tokens, the last merge of each, the longest token that is a prefix of each) are computed on the
driver from the given file, checked against ``MAX_TOKENS`` and broadcast as plain values; they don't grow with the corpus.
Workers keep the automaton, short pieces' ids and compatible pairs between tasks, each within a bound that only costs time.

Character classes are those of the installed ``tiktoken`` library, which is asked for the members of each class: the Unicode
versions of other libraries differ from it in thousands of characters.

Defined cases: null text is empty and has no tokens; bytes that aren't UTF-8 count as U+FFFD; a piece that is a token whole is
that token, as in the library; repeated rows are encoded one by one; ids may repeat or be null; a null list of token ids, and a
null entry in one, decode to nothing; an unknown token id is an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS = 1 << 20  # of a vocabulary that may be broadcast
_KEPT_PIECES, _KEPT_LENGTH = 1 << 19, 48  # memoised pieces, and the characters of the longest of them
_KEPT_PAIRS = 1 << 20
_AT_ONCE = 8 << 20  # bytes of text whose ids leave a task at once
PAIR_BASE = 1 << 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks of a file with a base-64 token and a rank a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
    if len(ranks) > MAX_TOKENS or max(ranks.values(), default=0) >= 2 * MAX_TOKENS:
        raise ValueError(f"{path}: more than {MAX_TOKENS} tokens")
    if missing := [i for i in range(256) if bytes([i]) not in ranks]:
        raise ValueError(f"{path}: no token for byte {missing[0]}")
    return ranks


def compatible(a: int, b: int, left: list[int], right: list[int], age: list[int], pairs: dict[int, int]) -> bool:
    """Whether merging by rank the joined bytes of tokens ``a`` and ``b`` gives the two back.

    Merges are undone from the last one; what then touches the border must not make a pair that would have been merged before
    the merge undone last.  Of equal ranks the left one is merged first.
    """
    bound = PAIR_BASE
    while True:
        if pairs.get(a * PAIR_BASE + b, bound) < bound:
            return False
        if age[a] > age[b]:
            bound = a
            a = right[a]
        elif age[b] >= 0:
            bound = b + 1
            b = left[b]
        else:
            return True


def merged(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that merging by rank leaves of a few bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while True:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in ranks]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def tables(ranks: dict[bytes, int]) -> dict[str, Any]:
    """Plain values by token id: ``tokens``; ``left`` and ``right``, the pair that a token is last merged from; ``age``, its rank, or -1
    of a byte; ``shorter``, the longest token that is a proper prefix, or -1; ``pairs``, merges by pair.

    A token that merging its own bytes doesn't give is kept for whole pieces only and has no other part.  Ranks must ascend
    along merges, as training gives them; others are an error.
    """
    size = max(ranks.values()) + 1
    tokens, left, right, age, shorter = [b""] * size, [-1] * size, [-1] * size, [-1] * size, [-1] * size
    pairs: dict[int, int] = {}
    reached = [False] * size
    for token, rank in sorted(ranks.items(), key=lambda item: (len(item[0]) > 1, item[1])):
        tokens[rank], reached[rank] = token, len(token) == 1
        for cut in range(len(token) - 1, 0, -1):
            a, b = ranks.get(token[:cut], size), ranks.get(token[cut:], size)
            if a < size and b < size and reached[a] and reached[b] and compatible(a, b, left, right, age, pairs):
                left[rank], right[rank], age[rank], reached[rank] = a, b, rank, True
                pairs[a * PAIR_BASE + b] = rank
                break
        if not reached[rank] and len(merged(token, ranks)) == 1:
            raise ValueError(f"the token of rank {rank} is merged from one of a higher rank")
    for token, rank in ranks.items():
        prefixes = (ranks.get(token[:cut], -1) for cut in range(len(token) - 1, 0, -1))
        shorter[rank] = next((p for p in prefixes if p >= 0 and reached[p]), -1)
    return {"tokens": tokens, "left": left, "right": right, "age": age, "shorter": shorter, "pairs": pairs, "reached": reached}


def class_members(name: str) -> str:
    """The members of a character class of the library's patterns, as ranges for the inside of brackets."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    points = np.array([ord(c) for c in bytes(own.encode_ordinary(every)).decode()])
    ends = np.flatnonzero(np.diff(points, append=-1) != 1)
    starts = np.concatenate(([0], ends[:-1] + 1))
    return "".join(f"\\U{points[s]:08x}-\\U{points[e]:08x}" for s, e in zip(starts, ends, strict=True))


def spelled_out(pattern: str) -> str:
    r"""``pattern`` with ``\p{..}``, ``\s`` and ``\S`` written as the members of the classes, for the standard library."""
    known: dict[str, str] = {}
    inside = False

    def members(name: str) -> str:
        if name not in known:
            known[name] = class_members(name)
        return known[name]

    def one(m: re.Match) -> str:
        nonlocal inside
        found = m[0]
        if found in ("[", "[^", "]"):
            inside = found != "]"
            return found
        if found == r"\S" and not inside:
            return f"[^{members(r'\s')}]"
        if found == r"\s" or re.fullmatch(r"\\p\{\w+\}", found):
            return members(found) if inside else f"[{members(found)}]"
        if re.fullmatch(r"\\\w", found):
            raise ValueError(f"the class {found} isn't supported")
        return found

    return re.sub(r"\\p\{\w+\}|\\.|\[\^?|\]", one, pattern)


def narrowed(pattern: str, below: int) -> str:
    """A pattern of ``spelled_out`` for texts whose characters are all below ``below``."""
    return re.sub(r"\\U([0-9a-f]{8})-\\U[0-9a-f]{8}", lambda m: m[0] if int(m[1], 16) < below else "", pattern)


class Coder:
    """Encodes texts on a worker from the broadcast values."""

    def __init__(self, vocabulary: dict[str, Any]):
        import ahocorasick

        self.tokens, self.left, self.right, self.age, self.shorter, self.pairs = (vocabulary[k] for k in ("tokens", "left", "right", "age", "shorter", "pairs"))
        self.size = [len(t) for t in self.tokens]
        self.width = max(self.size)
        self.whole = {t: i for i, t in enumerate(self.tokens) if t}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            if vocabulary["reached"][i]:
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.patterns = [re.compile(narrowed(vocabulary["pattern"], below)) for below in (0x80, 0x10000, 0x110000)]
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the memo before

    def compatible(self, a: int, b: int) -> bool:
        """The module's ``compatible``, memoised."""
        if len(self.fits) >= _KEPT_PAIRS:
            self.fits.clear()
        said = self.fits[a * PAIR_BASE + b] = compatible(a, b, self.left, self.right, self.age, self.pairs)
        return said

    def piece(self, raw: bytes) -> list[int]:
        """Token ids of the bytes of one match of the pattern."""
        if (whole := self.whole.get(raw)) is not None:
            return [whole]
        size, shorter, fits, longest = self.size, self.shorter, self.fits, self.automaton.iter_long
        text, width, out = raw.decode("latin-1"), self.width, []
        usable = bytearray(b"\1") * (len(raw) + 1)
        at, last = 0, -1
        token = next(longest(text[:width]))[1]
        while True:
            end = at + size[token]
            if usable[end]:
                good = last < 0 or fits.get(last * PAIR_BASE + token)
                if good is None:
                    good = self.compatible(last, token)
                if good:
                    out.append(token)
                    if end == len(raw):
                        return out
                    at, last = end, token
                    token = next(longest(text[end : end + width]))[1]  # every byte is a token, so the first match begins here
                    continue
            token = shorter[token]
            if token < 0:  # nothing goes on from here
                usable[at] = 0
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        """Token ids of a text as packed 32-bit numbers."""
        pattern = self.patterns[0 if text.isascii() else 2 if self.astral.search(text) else 1]
        seen, parts = self.seen, []
        for piece in pattern.findall(text):
            packed = seen.get(piece)
            if packed is None:
                packed = self.old.get(piece) or array("i", self.piece(piece.encode())).tobytes()
                if len(piece) <= _KEPT_LENGTH:
                    seen[piece] = packed
            parts.append(packed)
        if len(seen) >= _KEPT_PIECES:
            self.seen, self.old = {}, seen
        return b"".join(parts)


def _coder(vocabulary: dict[str, Any]) -> Coder:
    """The worker's coder, kept in the broadcast's value between tasks."""
    if "coder" not in vocabulary:
        vocabulary["coder"] = Coder(vocabulary)
    return vocabulary["coder"]


def vocabulary_of(path: str, pattern: str) -> dict[str, Any]:
    """What tasks need of the tokenizer in ``path`` with its ``pattern``."""
    return tables(read_ranks(path)) | {"pattern": spelled_out(pattern)}


def _runs(sizes: np.ndarray, at_once: int) -> Iterator[tuple[int, int]]:
    """Spans of rows with about ``at_once`` bytes each."""
    marks = np.cumsum(sizes) // at_once
    starts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(starts, starts[1:], strict=False) if a < b)


def _lists(values: list[bytes]) -> pa.Array:
    sizes = [len(v) // 4 for v in values]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(values), np.int32)))


def _encoded(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            raw = batch.column(1)
            sizes = pc.binary_length(raw).fill_null(0).to_numpy()
            for a, b in _runs(sizes, _AT_ONCE):
                texts = [(v or b"").decode("utf-8", "replace") for v in raw.slice(a, b - a).to_pylist()]
                ids = _lists([coder.encode(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], names=["id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """``id, ids``: the token ids of every whole text, by the tokenizer in ``path`` whose pieces ``pattern`` cuts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path, pattern))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_encoded(shared), f"id {kind}, ids array<int>")


def _decoded(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        size = np.array([len(t) for t in tokens])

        def texts(lists: pa.Array, counts: np.ndarray) -> pa.Array:
            flat = lists.flatten()
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            ids = flat.fill_null(0).to_numpy()
            unknown = there & ((ids < 0) | (ids >= len(size)) | (size[np.clip(ids, 0, len(size) - 1)] == 0))
            if unknown.any():
                raise ValueError(f"no token has the id {ids[unknown][0]}")
            ends = np.concatenate(([0], np.cumsum(np.where(there, size[ids], 0))))
            offsets = ends[np.concatenate(([0], np.cumsum(counts)))].astype(np.int32)
            data = b"".join(map(tokens.__getitem__, ids[there].tolist()))
            return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])

        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy()
            for a, b in _runs(counts, _AT_ONCE // 4):
                part = lists.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), part, texts(part, counts[a:b])], names=["id", "ids", "decoded"])

    return run


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``id, ids, decoded``: the bytes that the tokens of ``ids`` stand for."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = rows.sparkSession.sparkContext.broadcast(tokens)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("ids").cast("array<int>")).mapInArrow(_decoded(shared), f"id {kind}, ids array<int>, decoded binary")
