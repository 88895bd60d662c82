"""Byte-level BPE: texts to token ids by a backtracking encoder, ids back to texts by a table of offsets.

A sequence of tokens is what merging by rank gives exactly if every token is what its own bytes merge to and no two
neighbours have a merge across their border that would come first. So a piece of text is encoded from the left: an
Aho-Corasick automaton over the reversed tokens tells in one pass the longest token that begins at each byte; it is taken
if the pair with the token before it is compatible, else the next shorter one is tried, and where none is left the last
token is given up and its end closed for good. Every byte is closed once at most, so time is linear in the piece.
Compatibility is read off the merge table and kept in a table of pairs.

Texts are cut into pieces as byte-level tokenizers cut them (letters, digits, other signs, white space, English endings),
for a whole slice of a batch at once on its UTF-8 bytes. Pieces tile the slice, so they are an Arrow string array over the
same buffer; its dictionary is encoded once and the ids are gathered. Special tokens in a text are their own ids, as the
library's default has it. The vocabulary file is read by the driver and broadcast: it is bounded by the vocabulary, not
by the corpus.

``encode`` adds n_tokens and ids (little-endian unsigned 32-bit integers end to end, as token shards are stored);
``decode`` adds the text of such ids. Null text: no tokens, and an empty text back. Null ids: null text. Ids that the
vocabulary has not are left out, bytes that are not UTF-8 become U+FFFD. Empty tables, repeated rows and extra columns
pass as they are; a column named n_tokens, ids or decoded is replaced. A text's memory is a few dozen times its bytes.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from corpusql.llm.common import table
from corpusql.llm.textops import Slice, slices

OTHER, LETTER, NUMBER, SPACE = range(4)
KEPT_PIECES, KEPT_PAIRS, SLICE = 400_000, 400_000, 1 << 20
# White space of the splitting pattern, and its endings of English words.
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers of Unicode 16 that older tables of the standard library lack, as first and last code points.
LATE_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
LATE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
ENDINGS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _classes() -> np.ndarray:
    """Letter, number, white space or other, of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    found = np.array([first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    for ranges, kind in ((LATE_LETTERS, LETTER), (LATE_NUMBERS, NUMBER)):
        for a, b in ranges:
            found[a : b + 1] = kind
    found[WHITE] = SPACE
    return found


def sign_bytes() -> dict[str, int]:
    """The printable sign that stands for each byte in vocabulary files: itself where it is printable, else the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The pieces of one vocabulary file (its JSON), and decoding by their offsets."""

    def __init__(self, content: str):
        found = json.loads(content)
        self._read(found)
        size = max(self.pieces, default=-1) + 1
        self.size = [len(self.pieces.get(i, b"")) for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum(np.array(self.size, np.int64))])
        self.table = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(size)), np.uint8)

    def _read(self, found: dict) -> None:
        signs = sign_bytes()
        self.ids = {bytes(signs[c] for c in p): i for p, i in found["model"]["vocab"].items()}
        self.special = {t["content"].encode(): t["id"] for t in found.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: p for p, i in self.ids.items()} | {i: p for p, i in self.special.items()}

    def decode_ids(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the table of all pieces by its offsets."""
        ids = ids[ids < len(self.offsets) - 1].astype(np.int64)
        n = self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(n)
        return self.table[np.repeat(self.offsets[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Codec(Vocabulary):
    """Encoding too: the merges, the automaton of the tokens and what is known of pairs and pieces."""

    def _read(self, found: dict) -> None:
        import ahocorasick

        super()._read(found)
        model, signs = found["model"], sign_bytes()
        plain = lambda piece: bytes(signs[c] for c in piece)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (self.ids[plain(p)] for p in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[self.pieces[left] + self.pieces[right]]
            if whole in self.made or any(self.made.get(x, (0, 0, -1))[2] > rank for x in (left, right)):
                raise ValueError("each token must have one merge, after those of its parts")
            self.rank[left, right] = rank
            self.made[whole] = (left, right, rank)
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self.usable = {i for p, i in self.ids.items() if len(p) == 1}
        for whole, (left, right, rank) in self.made.items():  # in the order of their ranks
            if left in self.usable and right in self.usable and self._first_across(left, right) == rank:
                self.usable.add(whole)
        self.longest = ahocorasick.Automaton()
        for i in self.usable:
            self.longest.add_word(self.pieces[i][::-1].decode("latin-1"), i)
        self.longest.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._kept: dict[bytes, bytes] = {}
        self.classes = _classes()
        self.shorter = [self._shorter(self.pieces.get(i, b"")) for i in range(max(self.pieces, default=-1) + 1)]

    def _shorter(self, piece: bytes) -> int:
        """The longest token that is a proper prefix, -1 where there is none."""
        return next((i for n in range(len(piece) - 1, 0, -1) if (i := self.ids.get(piece[:n])) in self.usable), -1)

    # Pairs ------------------------------------------------------------------------------------------------------------

    def _edge(self, token: int, side: int, kept: dict) -> list[tuple[int, int, int]]:
        """The tokens at one end of a token while it is merged: (token, rank that makes it, rank that takes it up)."""
        if token not in kept:
            chain, now = [token], token
            while now in self.made:
                now = self.made[now][side]
                chain.append(now)
            ranks = [self.made[t][2] if t in self.made else -1 for t in chain]
            kept[token] = [(t, ranks[k], ranks[k - 1] if k else 1 << 60) for k, t in enumerate(chain)]
        return kept[token]

    def _first_across(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the border of neighbours a and b, None where there is none.

        A pair at the border can merge while both exist. Of equal ranks the left place merges first: that takes up the
        left token of the pair before, and the right one only after.
        """
        best = None
        for left, _, left_ends in self._edge(a, 1, self._right):
            for right, _, right_ends in self._edge(b, 0, self._left):
                rank = self.rank.get((left, right))
                if rank is not None and rank < left_ends and rank <= right_ends and (best is None or rank < best):
                    best = rank
        return best

    def fits(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of neighbours a and b."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            known = self._pairs[a, b] = self._first_across(a, b) is None
        return known

    # Encoding ---------------------------------------------------------------------------------------------------------

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ids.get(piece)
        if whole in self.usable:
            return [whole]
        last = len(piece) - 1
        # Of the tokens found at one place the longest is told first, so from behind it is the one that stays.
        best = dict(reversed(list(self.longest.iter(piece[::-1].decode("latin-1")))))
        if len(best) <= last:
            raise ValueError("the vocabulary does not hold every byte of the text")
        size, shorter, pairs = self.size, self.shorter, self._pairs
        shut: set[int] = set()
        out: list[int] = []
        at, before, token = 0, -1, best[last]
        while True:
            end = at + size[token]
            if end not in shut:
                fits = True if before < 0 else pairs.get((before, token))
                if fits is None:
                    fits = self.fits(before, token)
                if fits:
                    out.append(token)
                    if end > last:
                        return out
                    at, before, token = end, token, best[last - end]
                    continue
            token = shorter[token]
            while token < 0:
                shut.add(at)
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
                token = shorter[token]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as stored; short pieces are kept for the slices to come."""
        kept = self._kept
        if len(kept) >= KEPT_PIECES:
            kept.clear()
        found = list(map(kept.get, pieces))
        for k, known in enumerate(found):
            if known is None:
                piece = pieces[k]
                found[k] = array("I", self.encode_piece(piece)).tobytes()
                if len(piece) <= 64:
                    kept[piece] = found[k]
        return found

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end, in the UTF-8 bytes of texts that ``offsets`` part."""
        n = len(data)
        if not n:
            return np.zeros(1, np.int64)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # characters
        byte = data[at].astype(np.int64)
        size = np.diff(at, append=n)
        point = np.where(byte < 0x80, byte, byte & (0xFF >> np.minimum(size + 1, 7)))
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            point[more] = point[more] << 6 | (data[at[more] + k] & 0x3F)
        kind = self.classes[point]
        chars = len(at)
        begins = np.zeros(chars + 1, bool)  # texts
        begins[np.searchsorted(at, offsets)] = True
        runs = begins.copy()
        runs[0] = runs[chars] = True
        runs[1:chars] |= kind[1:] != kind[:-1]
        first = np.flatnonzero(runs)
        last = first[1:]  # each run's end
        first = first[:-1]
        cut = runs.copy()
        # White space before something else leaves its last sign, which a blank joins to what follows.
        white = kind[first] == SPACE
        before = white & ~begins[last]
        cut[last[before] - 1] = True
        joined = last[before & (point[last - 1] == 0x20)]
        cut[joined] = False
        # An apostrophe alone and an ending of letters are a piece of their own.
        sign = (point[first] == 0x27) & (last - first == 1) & ~begins[last] & cut[first]
        for i in last[sign]:  # the letters' first character
            start = at[i]
            stop = at[min(i + 2, chars - 1)] + 1
            if kind[i] != LETTER:
                continue
            head = data[start:stop].tobytes()
            for ending in ENDINGS:
                if head.startswith(ending) and not begins[i + 1 : i + len(ending)].any():
                    cut[i] = False
                    cut[i + len(ending)] = True
                    break
        return np.append(at, n)[np.flatnonzero(cut)]

    def encode_slice(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's texts end to end, and how many each text has."""
        data, bounds = s.data, s.offsets
        marks: list[tuple[int, int, int]] = []
        for special, i in self.special.items():
            marks += [(p, p + len(special), i) for p in _places(data, special) if np.searchsorted(bounds, p, "right") == np.searchsorted(bounds, p + len(special), "left")]
        marks = _apart(sorted(marks, key=lambda m: (m[0], -m[1])))
        parts = np.unique(np.concatenate([bounds, *(np.array(m[:2]) for m in marks)])) if marks else bounds
        at = self.cuts(data, parts)
        taken = np.zeros(len(at), np.int64)
        if marks:  # a special token is one piece
            keep = np.ones(len(at), bool)
            for a, b, i in marks:
                keep[np.searchsorted(at, a, "right") : np.searchsorted(at, b)] = False
                taken[np.searchsorted(at, a)] = i + 1
            at, taken = at[keep], taken[keep]
        pieces = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        _, bounds_of, blob = coded.dictionary.buffers()
        bounds_of = np.frombuffer(bounds_of, np.int64)[: len(coded.dictionary) + 1].tolist()
        blob = blob.to_pybytes() if blob is not None else b""
        known = self._pieces([blob[a:b] for a, b in zip(bounds_of, bounds_of[1:], strict=False)])
        for place in np.flatnonzero(taken[:-1]):
            known.append(array("I", [taken[place] - 1]).tobytes())
            which = which.copy() if not which.flags.writeable else which
            which[place] = len(known) - 1
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.concatenate([[0], np.cumsum(sizes)])
        every = np.frombuffer(b"".join(known), np.uint32)
        n = sizes[which] if len(which) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        ids = every[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])] if len(n) else every[:0]
        run = np.concatenate([[0], ends])
        return ids, np.diff(run[np.searchsorted(at, bounds)])


def _places(data: np.ndarray, piece: bytes) -> list[int]:
    content, found, at = data.tobytes(), [], -1
    while (at := content.find(piece, at + 1)) >= 0:
        found.append(at)
    return found


def _apart(marks: list) -> list:
    out: list = []
    for m in marks:
        if not out or m[0] >= out[-1][1]:
            out.append(m)
    return out


_known: dict[tuple, Vocabulary] = {}


def _tables(kind: type, content):
    """A worker's tables of one vocabulary; another one's go."""
    key = (kind, getattr(content, "id", None), hash(content.value))
    if key not in _known:
        _known.clear()
        _known[key] = kind(content.value)
    return _known[key]


def read_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast string; a path on the driver, or one with a scheme that Spark reads."""
    if "://" in path:
        return spark.sparkContext.broadcast(bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode())
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _replaced(df: DataFrame, new: list[tuple[str, object]]) -> tuple[DataFrame, StructType]:
    rows = df.drop(*(name for name, _ in new))
    kind = StructType(list(rows.schema.fields))
    for name, t in new:
        kind = kind.add(name, t)
    return rows, kind


def encode(docs: DataFrame, vocabulary, column: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids of ``column``."""
    rows, kind = _replaced(docs, [("n_tokens", LongType()), ("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tables(Codec, vocabulary)
        for batch in batches:
            for s in slices(batch.column(column), SLICE):
                ids, counts = codec.encode_slice(s)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                stored = pa.Array.from_buffers(pa.large_binary(), s.n_docs, [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])
                kept = batch.slice(s.first, s.n_docs)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts), stored.cast(pa.binary())], [*kept.schema.names, "n_tokens", "ids"])

    return rows.mapInArrow(run, kind)


def decode(rows: DataFrame, vocabulary, column: str = "ids") -> DataFrame:
    """``rows`` with decoded, the text of the ids in ``column``."""
    rows, kind = _replaced(rows, [("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _tables(Vocabulary, vocabulary)
        for batch in batches:
            texts = [None if not x.is_valid else codec.decode_ids(np.frombuffer(x.as_buffer(), "<u4")).decode("utf-8", "replace") for x in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, kind)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(spark, public_tokenizers.path("byte_bpe_50k.json"))
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    back = decode(coded, vocabulary)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
