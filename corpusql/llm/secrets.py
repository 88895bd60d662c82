"""Secret scans: all rules as one deterministic automaton, run once over the bytes of every text.

The automaton's transition arrays are built on the driver and travel with the task. A slice of documents is cut after
bytes that lead from every state back to the start (no match can hold such a byte), which gives thousands of
independent pieces that numpy steps through together, one byte of each at a time. Only pieces that reached an accepting
state are looked at again, for the rules that they reached: read from behind, a rule's automaton marks every byte where a
match begins; from the first mark the anchored automaton runs to the longest match and stops where the rule can no longer
accept, and the next mark behind the match is taken. So the time is linear in the text, whatever it holds.

A private key goes on to its last line, if only bytes of such a key lie between; lines of first ones inside it are part of it.

Null text: empty, no spans. Spans of one kind never overlap; across kinds the order is by start, then rule. Repeated rows
each have their spans, an empty table none. Extra columns are carried by ``redact_secrets`` and ignored by ``secret_spans``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.automaton import Automaton
from corpusql.llm.common import table
from corpusql.llm.textops import Slice, slices


@dataclass(frozen=True)
class Rule:
    """kind: name; pattern: see automaton; least: bytes that a match must have; value: of an assignment, of what follows
    the sign; base: whether it is one of the three base rules; until: where a match goes on to (bytes, a regex), over bytes
    of the class ``over``."""

    kind: str
    pattern: str
    least: int = 0
    value: int = 0
    base: bool = False
    until: bytes = b""
    over: bytes = b""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


# Runs of hex digits are maximal, so asking for 8 at once loses no run of 24 and spares a second look at most words.
RULES = (
    Rule("assign", rf"({_any_case('password|passwd|secret|token|api_?key')})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", value=6, base=True),
    Rule("access", "AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", "[0-9a-f]{8,}", least=24, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", until=rb"-----END [A-Z ]*PRIVATE KEY-----", over=rb"[A-Za-z0-9+/=:,.\s-]"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", least=34),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("cloud", "AIza[0-9A-Za-z_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
_SIGN = frozenset(b":=")


class Scanner:
    """Both automata of a list of rules, as arrays that pickle."""

    def __init__(self, rules: tuple[Rule, ...] = RULES, piece: int = 192):
        self.rules, self.piece = rules, piece
        self.free = Automaton([r.pattern for r in rules], anywhere=True)
        fixed = Automaton([r.pattern for r in rules], anywhere=False)
        columns = np.arange(256)
        self.reset = np.all(self.free.step[:, self.free.classes[columns]] == 0, axis=0) & (self.free.accepts[0] == 0)
        self.anchored = fixed.step[:, fixed.classes[columns]].tolist()
        self.anchored_accepts, self.anchored_reach = fixed.accepts.tolist(), fixed.reachable().tolist()
        behind = [Automaton([r.pattern], anywhere=True, backward=True) for r in rules]
        self.behind = [(x.step[:, x.classes[columns]].tolist(), x.accepts.tolist()) for x in behind]

    def _pieces(self, s: Slice) -> np.ndarray:
        n = len(s.data)
        after = np.flatnonzero(self.reset[s.data]) + 1
        cuts = after[np.minimum(np.searchsorted(after, np.arange(self.piece, n, self.piece)), len(after) - 1)] if len(after) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([s.offsets, cuts]))
        return cuts[cuts <= n]

    def hits(self, s: Slice) -> Iterator[tuple[int, int, int]]:
        """(start, end, mask of rules) of the pieces in which a rule matched."""
        cuts = self._pieces(s)
        starts, lengths = cuts[:-1], np.diff(cuts)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
        columns = self.free.classes[s.data]
        flat, width = (self.free.step * self.free.columns).ravel().astype(np.int32), self.free.columns
        accepts = np.zeros(len(self.free.accepts) * width, np.int64)
        accepts[::width] = self.free.accepts
        state = np.zeros(len(starts), np.int32)
        found = np.zeros(len(starts), np.int64)
        for j, n in enumerate(live):
            state[:n] = flat[state[:n] + columns[starts[:n] + j]]
            found[:n] |= accepts[state[:n]]
        for k in np.flatnonzero(found):
            yield int(starts[k]), int(starts[k] + lengths[k]), int(found[k])

    def begins(self, data: bytes, k: int) -> list[int]:
        """Where matches of rule ``k`` begin, the last first."""
        step, accepts = self.behind[k]
        state, found = 0, []
        for j in range(len(data) - 1, -1, -1):
            state = step[state][data[j]]
            if accepts[state]:
                found.append(j)
        return found

    def matches(self, data: bytes, mask: int) -> Iterator[tuple[int, int, int]]:
        """(start, rule, end) of the leftmost longest matches, rule by rule, of those that satisfy their rule's length."""
        step, accepts, reach, n = self.anchored, self.anchored_accepts, self.anchored_reach, len(data)
        for k, rule in enumerate(self.rules):
            if not mask >> k & 1:
                continue
            end = 0
            for at in reversed(self.begins(data, k)):
                if at < end:
                    continue
                state, j = 0, at
                while j < n:
                    state = step[state][data[j]]
                    if state < 0 or not reach[state] >> k & 1:
                        break
                    j += 1
                    if accepts[state] >> k & 1:
                        end = j
                if end - at >= rule.least and (not rule.value or _value_length(data[at:end]) >= rule.value):
                    yield at, k, end

    def spans(self, s: Slice) -> dict[int, list[tuple[int, int, int]]]:
        """By document, sorted (start, rule, end) in bytes from the document's start."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for a, b, mask in self.hits(s):
            doc = int(np.searchsorted(s.offsets, a, "right")) - 1
            base = a - int(s.offsets[doc])
            for start, k, end in self.matches(s.data[a:b].tobytes(), mask):
                out.setdefault(doc, []).append((base + start, k, base + end))
        for doc, found in out.items():
            for k, rule in enumerate(self.rules):
                if rule.until and any(x[1] == k for x in found):
                    data = s.data[s.offsets[doc] : s.offsets[doc + 1]].tobytes()
                    found[:] = [x for x in found if x[1] != k] + _gone_on(data, rule, k, sorted(x for x in found if x[1] == k))
        return {d: sorted(v) for d, v in out.items()}


def _gone_on(data: bytes, rule: Rule, k: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The matches, each up to the next place of ``until`` where only bytes of ``over`` lie between; those inside another go."""
    lasts = [m.span() for m in re.finditer(rule.until, data)]
    starts = [a for a, _ in lasts]
    inside = np.zeros(256, bool)
    inside[[b for b in range(256) if re.match(rule.over, bytes([b]))]] = True
    other = np.flatnonzero(~inside[np.frombuffer(data, np.uint8)])
    out: list[tuple[int, int, int]] = []
    for start, _, end in found:
        if out and start < out[-1][2]:
            continue
        i, j = bisect_left(starts, end), int(np.searchsorted(other, end))
        if i < len(starts) and (j == len(other) or starts[i] <= other[j]):
            end = lasts[i][1]
        out.append((start, k, end))
    return out


def _value_length(match: bytes) -> int:
    """Length of what is assigned: after the first sign, blanks and at most one quote."""
    rest = match[next(i for i, c in enumerate(match) if c in _SIGN) + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) in code points, end exclusive, for every row of ``docs``."""
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for s in slices(batch.column(1)):
                for d, found in scanner.spans(s).items():
                    lead = (s.data[s.offsets[d] : s.offsets[d + 1]] & 0xC0) != 0x80
                    at = np.concatenate([[0], np.cumsum(lead)])
                    out[s.first + d] = [{"kind": rules[k].kind, "start": int(at[a]), "end": int(at[b])} for a, k, b in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id bigint, spans array<struct<kind string, start bigint, end bigint>>")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones united) replaced by ``mark``, and n_chars, where there is one, renewed."""
    scanner, names, schema = Scanner(rules), docs.columns, docs.schema
    at = names.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new: dict[int, str] = {}
            for s in slices(column):
                for d, found in scanner.spans(s).items():
                    data, parts, end = s.data[s.offsets[d] : s.offsets[d + 1]].tobytes(), [], 0
                    for a, _, b in found:
                        if a >= end:
                            parts += [data[end:a], mark.encode()]
                        end = max(end, b)
                    new[s.first + d] = b"".join([*parts, data[end:]]).decode()
            if new:
                texts = column.to_pylist()
                for i, t in new.items():
                    texts[i] = t
                arrays = list(batch.columns)
                arrays[at] = pa.array(texts, column.type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    counts = arrays[k].to_pylist()
                    for i, t in new.items():
                        counts[i] = len(t)
                    arrays[k] = pa.array(counts, arrays[k].type)
                batch = pa.RecordBatch.from_arrays(arrays, names)
            yield batch

    return docs.mapInArrow(each, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    of_base = "filter(spans, x -> x.kind in ({}))".format(", ".join(f"'{k}'" for k in base))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(of_base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
