"""Problem 6: encoding every text with a public byte-pair vocabulary, and decoding it again.

``Transducer`` encodes a stream of text in memory that doesn't grow with it.  Every text, short or long, is fed to it in
steps of FEED characters, and tokens leave it as soon as nothing that follows can change them.  What may follow matters
in three ways, each with a bounded sight that is known from the vocabulary:

* Text is cut into pieces by the vocabulary's pattern, which never looks more than SIGHT characters behind a piece.
* Within a piece, a border between two characters that no token of the merge list spans can never be merged over: what
  is before it and what is after it are encoded apart.  This takes one character of sight.
* Between such borders, for each prefix there is one last token that goes with the encoding before it, and the tokens of
  the whole come from following these back.  Which prefix the end will lead to is open, but it is one of the last L, where
  L is the longest token of the merge list: that lookahead suffices.  Tokens before the place where the ways back from
  all L prefixes have met are stable.

Most stretches are one character, whose tokens stand in a table; of longer ones that recur, a bounded table remembers the
short ones.  Where pieces and stretches begin is found for all characters of a step at once: characters that the tokens which
span borders can't tell apart are of one class, and it is known of each two classes whether a token spans their border.

``TextDecoder`` is the inverse: an incremental state machine from bytes to text that holds back an unfinished character.

Null and empty texts have the empty list of ids.  Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters fed at a time, those behind a piece that the pattern may need to see, and those of an open piece that wait for its end.
FEED, SIGHT, OPEN = 2048, 3, 256
#: Entries of a table of what recurs before it starts anew, and the longest text in it.
REMEMBERED, SHORT = 1 << 17, 32
#: How a piece goes on, by what it is made of.
_ON = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(r"[^\s\p{L}\p{N}]*"), "W": regex.compile(r"\s*")}
_WHITE = list(_ON).index("W")
_NEVER = 1 << 60
_SPACE, _QUOTE = 32, 39
#: What follows the quote of a contraction in PATTERN.
_CONTRACTED = [[ord(c) for c in end] for end in ("s", "t", "re", "ve", "m", "ll", "d")]
_NOTHING = np.empty(0, dtype=np.int32)
#: The vocabulary that a process used last, with what it has learned, for its next task.
_KEPT: list[Vocabulary] = []


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def _char_borders(token: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(what the token holds of the character before, of the one after) for each border of characters inside it."""
    starts = [i for i, b in enumerate(token) if b & 0xC0 != 0x80]
    for n, at in enumerate(starts):
        if at > 0:
            end = starts[n + 1] if n + 1 < len(starts) else len(token)
            yield token[starts[n - 1] if n else 0 : at], token[at:end]


class Vocabulary:
    """The merge list and what follows from it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.lookahead = max(map(len, ranks), default=1)
        self.pieces = regex.compile(pattern)
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self.spanned = {border for token in ranks if len(token) > 1 for border in _char_borders(token)}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._crossed: dict[str, bool] = {}
        self._ids: dict[str, list[int]] = {}
        self._packed: dict[str, bytes] = {}
        # of each code point: what it is made of (an index of _ON), the classes of its ends (0: not known yet), its tokens (each plus one) and their number
        self._kind = np.zeros(0x110000, dtype=np.uint8)
        self._left, self._right = np.zeros(0x110000, dtype=np.uint16), np.zeros(0x110000, dtype=np.uint16)
        self._char_ids, self._char_n = np.zeros((0x110000, 4), dtype=np.int32), np.zeros(0x110000, dtype=np.uint8)
        self._befores, self._afters = {b for b, _ in self.spanned}, {a for _, a in self.spanned}
        self._lefts: dict[tuple, int] = {}
        self._rights: dict[tuple, int] = {}
        self._spans = np.zeros((1, 1), dtype=bool)

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None of a single byte."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                _, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def _edge(self, token: bytes, side: int) -> list[bytes]:
        """The tokens that stand at one edge (0 left, 1 right) of the token while it is merged, from the byte on."""
        out = [token]
        while (parts := self.halves(out[-1])) is not None:
            out.append(parts[side])
        return out[::-1]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens may stand side by side: the merges leave the border between them alone.

        Merged apart, each side shows the border one token after another.  Whatever shows at the same time on both sides
        must not be merged before one of the two goes into its next; of equal merges the one further left comes first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._apart(self._edge(left, 1), self._edge(right, 0))
        return known

    def _apart(self, a: list[bytes], b: list[bytes]) -> bool:
        rank = self.ranks.get
        i = j = 0
        while True:
            until_a = rank(a[i + 1]) if i + 1 < len(a) else _NEVER
            until_b = rank(b[j + 1]) if j + 1 < len(b) else _NEVER
            over = rank(a[i] + b[j], _NEVER)
            if over < until_a and over <= until_b and over < _NEVER:
                return False
            if until_a == until_b == _NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def crossed(self, pair: str) -> bool:
        """Whether some token may span the border between two characters."""
        known = self._crossed.get(pair)
        if known is None:
            if len(self._crossed) > REMEMBERED:
                self._crossed.clear()
            a, b = pair[0].encode("utf-8"), pair[1].encode("utf-8")
            known = any((a[i:], b[:j]) in self.spanned for i in range(len(a)) for j in range(1, len(b) + 1))
            self._crossed[pair] = known
        return known

    def stretch(self, text: str) -> list[int]:
        """The tokens of a closed stretch."""
        ids = self._ids.get(text)
        if ids is None:
            run = _Run(self)
            ids = run.add(text.encode("utf-8")) + run.finish()
            self._remember(text, ids)
        return ids

    def _remember(self, text: str, ids: list[int]) -> None:
        if len(text) <= SHORT:
            if len(self._ids) > REMEMBERED:
                self._ids.clear()
            self._ids[text] = ids

    def _learn(self, codes: np.ndarray) -> None:
        for c in set(codes.tolist()):
            char = chr(c)
            data = char.encode("utf-8")
            left = tuple(data[i:] for i in range(len(data)) if data[i:] in self._befores)
            right = tuple(data[:j] for j in range(1, len(data) + 1) if data[:j] in self._afters)
            self._left[c] = self._lefts.setdefault(left, len(self._lefts) + 1)
            self._right[c] = self._rights.setdefault(right, len(self._rights) + 1)
            self._kind[c] = next(n for n, on in enumerate(_ON.values()) if on.match(char).end())
            ids = self.stretch(char)
            self._char_ids[c, : len(ids)], self._char_n[c] = [i + 1 for i in ids], len(ids)
        if self._spans.shape != (len(self._lefts) + 1, len(self._rights) + 1):
            self._spans = np.zeros((len(self._lefts) + 1, len(self._rights) + 1), dtype=bool)
            for left, i in self._lefts.items():
                for right, j in self._rights.items():
                    self._spans[i, j] = any((b, a) in self.spanned for b in left for a in right)

    def starts(self, text: str, codes: np.ndarray) -> np.ndarray:
        """Where pieces begin, for each character of a text that begins with a piece."""
        if not (known := self._left.take(codes) > 0).all():
            self._learn(codes[~known])
        if self.pieces.pattern != PATTERN:
            starts = np.zeros(len(codes), dtype=bool)
            starts[[m.start() for m in self.pieces.finditer(text)]] = True
            return starts
        kind = self._kind.take(codes)
        starts = np.empty(len(codes), dtype=bool)
        starts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        white = kind == _WHITE
        # the last white space before something else stands alone, or with what follows if it is a space
        after = np.flatnonzero(white[:-1] > white[1:]) + 1
        starts[after - 1] = True
        starts[after] = codes[after - 1] != _SPACE
        for at in np.flatnonzero(codes == _QUOTE).tolist() if "'" in text else ():
            if at == 0 or (kind[at - 1] != kind[at] and codes[at - 1] != _SPACE):
                said = codes[at + 1 : at + 3].tolist()
                for end in _CONTRACTED:
                    if said[: len(end)] == end:
                        starts[at + 1] = False
                        starts[at + 1 + len(end) : at + 2 + len(end)] = True
        return starts

    def closed(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The tokens of closed pieces, given where these begin."""
        cut = np.empty(len(codes) + 1, dtype=bool)
        cut[0] = cut[-1] = True
        np.logical_not(self._spans[self._left.take(codes[:-1]), self._right.take(codes[1:])], out=cut[1:-1])
        cut[1:-1] |= starts[1:]
        single = cut[:-1] & cut[1:]
        chars = codes[single]
        ids = self._char_ids.take(chars, axis=0).ravel()
        ids = ids[ids > 0] - 1
        first = np.flatnonzero(cut[:-1] & ~single)
        if not len(first):
            return ids
        last = np.flatnonzero(cut[1:] & ~single) + 1
        packed = self._packed
        blobs = [packed.get(part := text[i:j]) or self._pack(part) for i, j in zip(first.tolist(), last.tolist())]
        n = self._char_n.take(codes).astype(np.int64)  # of each place where a stretch begins
        n[first] = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        begins = cut[:-1]
        whose = np.repeat(single[begins], n[begins])
        out = np.empty(len(whose), dtype=np.int32)
        out[whose] = ids
        out[~whose] = np.frombuffer(b"".join(blobs), dtype=np.int32)
        return out

    def _pack(self, text: str) -> bytes:
        ids = np.array(self.stretch(text), dtype=np.int32).tobytes()
        if len(text) <= SHORT:
            if len(self._packed) > REMEMBERED:
                self._packed.clear()
            self._packed[text] = ids
        return ids

    def piece(self, text: str) -> list[int]:
        """The tokens of a closed piece."""
        ids = self._ids.get(text)
        if ids is not None:
            return ids
        ids, start = [], 0
        for i in range(1, len(text)):
            if not self.crossed(text[i - 1 : i + 1]):
                ids += self.stretch(text[start:i])
                start = i
        return ids + self.stretch(text[start:])


def _kept(ranks: dict[bytes, int], pattern: str) -> Vocabulary:
    if not _KEPT or _KEPT[0].pieces.pattern != pattern or _KEPT[0].ranks != ranks:
        _KEPT[:] = [Vocabulary(ranks, pattern)]
    return _KEPT[0]


class _Run:
    """The open tokens of one stretch."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.before = vocabulary, b"", None
        self.last: list[bytes] = [b""]  # of each prefix of data, the token it ends with

    def add(self, data: bytes) -> list[int]:
        ids = []
        for start in range(0, len(data), 1024):
            self._extend(data[start : start + 1024])
            if len(self.data) > self.v.lookahead:
                ids += self._stable()
        return ids

    def _extend(self, data: bytes) -> None:
        ranks, fits, endings = self.v.ranks, self.v.fits, self.v.endings
        first = len(self.data)
        self.data += data
        data, last = self.data, self.last
        for end in range(first + 1, len(data) + 1):
            found, at = [], end - 1
            while at >= 0 and (token := data[at:end]) in endings:
                if token in ranks:
                    found.append(token)
                at -= 1
            for token in reversed(found):
                at = end - len(token)
                left = last[at] if at else self.before
                if not left or fits(left, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the merge list doesn't cover every byte")

    def _stable(self) -> list[int]:
        """The tokens before the place that the ways back from all prefixes within the lookahead share."""
        live = set(range(max(0, len(self.data) - self.v.lookahead + 1), len(self.data) + 1))
        while len(live) > 1:
            end = max(live)
            live.remove(end)
            live.add(end - len(self.last[end]))
        return self._emit(live.pop())

    def _emit(self, end: int) -> list[int]:
        if end == 0:
            return []
        at, ids = end, []
        while at > 0:
            ids.append(self.v.ranks[self.last[at]])
            at -= len(self.last[at])
        self.before = self.last[end]
        self.data, self.last = self.data[end:], [b"", *self.last[end + 1 :]]
        return ids[::-1]

    def finish(self) -> list[int]:
        return self._emit(len(self.data))


class _Piece:
    """A piece that is still open: its stretches are closed at every border that no token spans."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.run, self.end = vocabulary, None, ""

    def add(self, text: str) -> list[int]:
        ids, start, end = [], 0, self.end
        for i, c in enumerate(text):
            if end and not self.v.crossed(end + c):
                ids += self._close(text[start:i])
                start = i
            end = c
        if start < len(text):
            self.run = self.run or _Run(self.v)
            ids += self.run.add(text[start:].encode("utf-8"))
        self.end = end
        return ids

    def _close(self, text: str) -> list[int]:
        if self.run is None:
            return self.v.stretch(text)
        run, self.run = self.run, None
        return run.add(text.encode("utf-8")) + run.finish()

    def finish(self) -> list[int]:
        return self.run.finish() if self.run else []


class Transducer:
    """feed() text and get the ids that are stable; finish() gives the rest."""

    def __init__(self, vocabulary: Vocabulary, most_open: int = OPEN):
        self.v, self.most_open = vocabulary, max(4, most_open)
        self.text = ""  # what isn't cut into pieces yet
        self.open: _Piece | None = None
        self.made_of = ""

    def feed(self, text: str) -> np.ndarray:
        if self.open is not None:
            return self._go_on(text)
        self.text += text
        if not self.text:
            return _NOTHING
        codes = _codes(self.text)
        starts = self.v.starts(self.text, codes)
        ends = np.append(np.flatnonzero(starts)[1:], len(codes))
        closed = ends[ends <= len(codes) - SIGHT]
        at = int(closed[-1]) if len(closed) else 0
        ids = self.v.closed(self.text[:at], codes[:at], starts[:at]) if at else _NOTHING
        self.text = self.text[at:]
        if len(self.text) > self.most_open:  # one piece that goes on, but for its last few characters
            body, self.text, self.open = self.text, "", _Piece(self.v)
            probe = body[1:2] if body[0] == " " and not body[1].isspace() else body[0]
            self.made_of = "W" if regex.match(r"\s", probe) else "L" if regex.match(r"\p{L}", probe) else "N" if regex.match(r"\p{N}", probe) else "S"
            lead = len(body) - len(body.lstrip(" ")) if self.made_of != "W" else 0
            led = np.array(self.open.add(body[:lead]), dtype=np.int32)
            ids = np.concatenate((ids, led, self._go_on(body[lead:])))
        return ids

    def _go_on(self, text: str) -> np.ndarray:
        text, self.text = self.text + text, ""
        end = _ON[self.made_of].match(text).end()
        more = text[:end]
        if self.made_of == "W" and more:  # the last white space of a run may belong to what follows
            more, self.text = more[:-1], more[-1]
        ids = self.open.add(more)
        if end < len(text):
            ids += self.open.finish()
            self.open = None
            return np.concatenate((np.array(ids, dtype=np.int32), self.feed(text[end:])))
        return np.array(ids, dtype=np.int32)

    def finish(self) -> np.ndarray:
        if self.open is not None:
            ids = np.array(self.open.add(self.text) + self.open.finish(), dtype=np.int32)
        else:
            ids = np.array([i for piece in self.v.pieces.findall(self.text) for i in self.v.piece(piece)], dtype=np.int32)
        self.open, self.text = None, ""
        return ids


class TextDecoder:
    """feed() ids and get the text that is complete; finish() gives the rest, broken characters as U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join([self.bytes_of[i] for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def ids_of(text: str | None, vocabulary: Vocabulary, feed: int = FEED) -> np.ndarray:
    if not text:
        return _NOTHING
    stream = Transducer(vocabulary, min(feed, OPEN))
    ids = [stream.feed(text[at : at + feed]) for at in range(0, len(text), feed)]
    return np.concatenate((*ids, stream.finish()))


def encode_text(text: str | None, vocabulary: Vocabulary, feed: int = FEED) -> list[int]:
    return ids_of(text, vocabulary, feed).tolist()


def encoded(docs: DataFrame, vocabulary_path: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row, one pass without a shuffle.  The vocabulary (a fixed file) is read once and broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([narrow.schema.fields[0], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _kept(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists = [ids_of(t, vocabulary) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
                flat = pa.array(np.concatenate(lists))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[id_col, "ids"])

    return narrow.mapInArrow(run, schema)


def decoded(codes: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row; a null list gives null, the empty list ''."""
    ranks = codes.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))
    narrow = codes.select(F.col(id_col).alias(id_col), F.col(ids_col).alias("_ids"))
    schema = T.StructType([narrow.schema.fields[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(ranks.value)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                    continue
                state = TextDecoder(vocabulary)
                parts = [state.feed(ids[i : i + 4096]) for i in range(0, len(ids), 4096)]
                texts.append("".join(parts) + state.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return narrow.mapInArrow(run, schema)
