"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

A merge list fixes how far to the left the symbols that are still to come can change a tokenisation:
`MergeList.lookahead`. The transducer holds a window of symbols, applies the merges inside it, emits the
tokens that end at least that far before the window's end and drops their symbols. What it emits equals
the tokens of the whole piece, and its memory does not grow with the length of a piece.

The bound. Compare the merges of a prefix with those of the same prefix and a continuation, in order
of rank. Left of a border the two agree; at first the border is the prefix's end. It moves left only
where one of them merges the token s just left of it with the token y just right of it, so by |s|
symbols. The next move needs a merge (s', y') of a later rank in which y' starts where s started, so
that s lies on the left spine of y'. The longest such chain, weighted with |s|, bounds every move.

Decoding is incremental: tokens are turned into bytes or characters one by one, and a state machine of at
most three pending bytes turns bytes into text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class MergeList:
    """A vocabulary with ranked merges, as token numbers."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            self.rules.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Symbols beyond a token's end after which nothing that follows can change it."""
        parts = {made: pair for pair, (_, made) in sorted(self.rules.items(), key=lambda x: -x[1][0])}
        length: dict[int, int] = {}

        def symbols(token: int) -> int:
            if token not in length:
                length[token] = sum(map(symbols, parts[token])) if token in parts else 1
            return length[token]

        furthest: dict[int, int] = {}
        for (left, right), _ in sorted(self.rules.items(), key=lambda x: x[1][0]):
            reach, spine = furthest.get(right, 0), right
            while spine in parts:
                spine = parts[spine][0]
                reach = max(reach, furthest.get(spine, 0))
            furthest[left] = max(furthest.get(left, 0), reach + symbols(left))
        return max(furthest.values(), default=0) + 1

    def merged(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The tokens of one window and the number of symbols in each: lowest rank first, then leftmost."""
        if len(symbols) > SHORT:
            return self._merged_long(symbols)
        rule, tokens, widths = self.rules.get, list(symbols), [1] * len(symbols)
        found = [rule(pair, _NO) for pair in zip(tokens, tokens[1:])]
        while found and (best := min(found)) is not _NO:
            k = found.index(best)
            tokens[k : k + 2] = (best[1],)
            widths[k : k + 2] = (widths[k] + widths[k + 1],)
            del found[k]
            if k:
                found[k - 1] = rule((tokens[k - 1], tokens[k]), _NO)
            if k < len(found):
                found[k] = rule((tokens[k], tokens[k + 1]), _NO)
        return tokens, widths


    def _merged_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The same with a heap of the pairs that merge and linked neighbours: time in proportion to n log n.

        An entry counts only if its place still has the two tokens that it was made for.
        """
        rule, n = self.rules.get, len(symbols)
        tokens, widths = list(symbols), [1] * n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, found[1], a, b) for k, (a, b) in enumerate(zip(tokens, tokens[1:])) if (found := rule((a, b)))]
        heapify(heap)
        while heap:
            _, k, made, a, b = heappop(heap)
            j = after[k]
            if tokens[k] != a or j >= n or tokens[j] != b:
                continue
            tokens[k], tokens[j] = made, -1
            widths[k] += widths[j]
            after[k] = nearest = after[j]
            if nearest < n:
                before[nearest] = k
                if found := rule((made, tokens[nearest])):
                    heappush(heap, (found[0], k, found[1], made, tokens[nearest]))
            if (left := before[k]) >= 0 and (found := rule((tokens[left], made))):
                heappush(heap, (found[0], left, found[1], tokens[left], made))
        kept = [k for k in range(n) if tokens[k] >= 0]
        return [tokens[k] for k in kept], [widths[k] for k in kept]


_NO = (1 << 62, -1)
_SPACE = regex.compile(r"\s")


#: Characters of a segment, and pieces of a longer one that are encoded at a time; characters from which on a piece's ids come in parts,
#: and symbols up to which the pairs of a window are searched one by one.
SEGMENT, PIECES, LONG, SHORT = 1 << 16, 1 << 14, 1 << 12, 48


class Transducer:
    """Symbols in, stable tokens out. Memory: one window of a few lookaheads, whatever the piece's length."""

    def __init__(self, merges: MergeList, window: int | None = None):
        self.merges, self.reach = merges, merges.lookahead
        self.most = max(window or 0, 2 * self.reach + 2)

    def tokens(self, symbols: Iterable[int]) -> Iterator[int]:
        if isinstance(symbols, list) and len(symbols) <= self.most:
            yield from self.merges.merged(symbols)[0]
            return
        held: list[int] = []
        for symbol in symbols:
            if len(held) >= self.most:
                found, widths = self.merges.merged(held)
                done = 0
                for token, width in zip(found, widths):
                    if done + width > len(held) - self.reach:
                        break
                    done += width
                    yield token
                del held[:done]
            held.append(symbol)
        yield from self.merges.merged(held)[0]


class Tokenizer:
    """A tokenizer file of the public `tokenizers` format: lower-cased words with word ends over byte letters."""

    def __init__(self, path: str, remember: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = MergeList(model["vocab"], pairs)
        self.transducer = Transducer(self.merges)
        letters = byte_letters()
        self.inner = [model["vocab"][c] for c in letters]
        self.final = [model["vocab"][c + self.suffix] for c in letters]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {number: name for name, number in model["vocab"].items()} | {n: c for c, n in self.added.items()}
        self.names = [names[k] for k in range(max(names) + 1)]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.first = sorted({c[0] for c in self.added})
        self.remember, self.known = remember, {}
        byte = {letter: b for b, letter in enumerate(letters)}
        self.bytes = [self._bytes(name, number, byte) for number, name in enumerate(self.names)]

    def _bytes(self, name: str, number: int, byte: dict[str, int]) -> bytes:
        if name in self.added and self.added[name] == number:
            return name.encode() + b" "
        end = name.endswith(self.suffix) and len(name) > len(self.suffix)
        letters = name[: -len(self.suffix)] if end and self.suffix else name
        return bytes(byte[c] for c in letters) + (b" " if end else b"")

    @staticmethod
    def normalised(text: str) -> str:
        """NFC and lower case, each character by itself (so a final sigma gets no form of its own)."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")
        return text.lower()

    def symbols(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        found = [*map(self.inner.__getitem__, data)]
        found[-1] = self.final[data[-1]]
        return found

    def piece_ids(self, piece: str) -> bytes:
        """The little-endian ids of one piece; short pieces are remembered, up to a fixed number."""
        known = self.known.get(piece)
        if known is None:
            known = struct.pack(f"<{len(made := list(self.transducer.tokens(self.symbols(piece))))}I", *made)
            if len(piece) <= 64:
                if len(self.known) >= self.remember:
                    self.known.clear()
                self.known[piece] = known
        return known

    def piece_parts(self, piece: str) -> Iterator[bytes]:
        """The ids of a long piece, PIECES at a time: neither its symbols nor its ids are ever held together."""
        data = piece.encode("utf-8", "replace")
        symbols = (self.inner[b] if k < len(data) - 1 else self.final[b] for k, b in enumerate(data))
        tokens = self.transducer.tokens(symbols)
        while some := list(islice(tokens, PIECES)):
            yield struct.pack(f"<{len(some)}I", *some)

    def id_chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text, as chunks of little-endian unsigned 32-bit integers."""
        at = 0
        if self.special and any(c in text for c in self.first):
            for found in self.special.finditer(text):
                yield from self._plain(text[at : found.start()])
                yield self.added[found[0]].to_bytes(4, "little")
                at = found.end()
        yield from self._plain(text[at:] if at else text)

    def _plain(self, part: str) -> Iterator[bytes]:
        """The ids of a text without added tokens; of a long segment, the pieces are taken a bounded number at a time."""
        get, missing = self.known.get, self.piece_ids
        for segment in self.segments(part) if part else ():
            text = self.normalised(segment)
            if len(text) <= 2 * SEGMENT:
                yield b"".join([get(p) or missing(p) for p in self.piece.findall(text)])
            else:
                pieces = (m[0] for m in self.piece.finditer(text))
                while some := list(islice(pieces, PIECES)):
                    if max(map(len, some)) <= LONG:
                        yield b"".join([get(p) or missing(p) for p in some])
                        continue
                    for piece in some:
                        if len(piece) <= LONG:
                            yield get(piece) or missing(piece)
                        else:
                            yield from self.piece_parts(piece)

    @staticmethod
    def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
        """The text in segments that end before white space, which no piece and no composed character crosses; a segment is longer only where there is none."""
        start = 0
        while len(text) - start > most and (space := _SPACE.search(text, start + most)):
            yield text[start : space.start()]
            start = space.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        return list(memoryview(b"".join(self.id_chunks(text))).cast("I"))

    def decode(self, ids: Iterable[int]) -> str:
        """What decode(ids, skip_special_tokens=False) of the public library returns: the tokens' names, parted by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        """The readable text of all ids at once."""
        machine = TextMachine(self)
        return machine.feed(ids) + machine.end()


class TextMachine:
    """Ids to readable text, some at a time: a token's bytes go through a state machine that holds an unfinished character; a space where a word ends."""

    def __init__(self, tok: Tokenizer):
        self.table, self.machine = tok.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def end(self) -> str:
        return self.machine.decode(b"", True)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _row(tok: Tokenizer, text: str | None, keep_ids: bool = True) -> tuple[int, bytes, str, str, str]:
    """(tokens, ids, hash of the ids, of the decoded text, of the readable text), made chunk by chunk; without keep_ids nothing grows with the text."""
    ids_hash, decoded_hash, text_hash, count, chunks, names = hashlib.sha256(), hashlib.sha256(), hashlib.sha256(), 0, [], tok.names
    machine = TextMachine(tok)
    for chunk in tok.id_chunks(text or ""):
        ids_hash.update(chunk)
        numbers = memoryview(chunk).cast("I").tolist()
        decoded_hash.update(((" " if count and numbers else "") + " ".join([names[k] for k in numbers])).encode())
        text_hash.update(machine.feed(numbers).encode())
        count += len(numbers)
        if keep_ids:
            chunks.append(chunk)
    text_hash.update(machine.end().encode())
    return count, b"".join(chunks), ids_hash.hexdigest(), decoded_hash.hexdigest(), text_hash.hexdigest()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, ids (array of int; only with keep_ids), ids_sha256, decoded_sha256, text_sha256.

    decoded_sha256 is of what the public library's decode returns, text_sha256 of the readable text that the byte machine makes.

    Null texts count as empty and give no tokens; repeated rows are encoded one by one; other columns
    are ignored; an empty table gives no rows. The vocabulary file must be at the same path everywhere.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ids_type = "ids array<int>, " if keep_ids else ""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                rows = [_row(tok, text.as_py(), keep_ids) for text in part.column(1)]
                arrays = [part.column(0), pa.array([r[0] for r in rows], pa.int64())]
                names = [id_col, "n_tokens"]
                if keep_ids:
                    ends = pa.array([0, *_running(r[0] for r in rows)], pa.int32())
                    flat = pa.Array.from_buffers(pa.int32(), sum(r[0] for r in rows), [None, pa.py_buffer(b"".join(r[1] for r in rows))])
                    arrays.append(pa.ListArray.from_arrays(ends, flat))
                    names.append("ids")
                arrays += [pa.array([r[k] for r in rows], pa.string()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, "ids_sha256", "decoded_sha256", "text_sha256"])

    schema = f"`{id_col}` {kind}, n_tokens long, {ids_type}ids_sha256 string, decoded_sha256 string, text_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encoded, schema)


def _running(counts: Iterable[int]) -> Iterator[int]:
    total = 0
    for n in counts:
        total += n
        yield total
