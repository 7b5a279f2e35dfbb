"""Secret scanning with one combined deterministic automaton.

Rules are regular expressions over bytes (literals, classes, groups, | ? * + {m,n}). All are compiled together: Thompson automata are
joined, made deterministic by subset construction with the set of rules that end in each state, and minimised by partition
refinement. The transition array over byte classes is run once over each text's bytes, for all rules; it yields the ends of matches.
A reversed automaton of the one rule then walks back from an end to its leftmost start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import encoded, pieces


@dataclass(frozen=True)
class Rule:
    """``pattern`` must end in a run or a fixed text, so that the ends of one match have no gap; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    any_case: bool = False
    #: If given, the shortest length of what follows the last of ``after``, blanks and a quote.
    value: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=\-]+)""", any_case=True, value=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=20),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----([A-Za-z0-9+/=:,.\x09\x0A\x0D\x20]|-[A-Za-z0-9+/=:,.])*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("key_begin", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),  # a key that is cut off has this line alone
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
)
RULES = BASE + MORE


class _Nfa:
    """Thompson construction straight from the text of a pattern; ``backward`` reverses every concatenation."""

    def __init__(self, pattern: str, any_case: bool, backward: bool):
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []
        self.text, self.at, self.any_case, self.backward = pattern, 0, any_case, backward
        tree = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")
        self.start, self.end = self._state(), self._state()
        self._build(tree, self.start, self.end)

    def _state(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1

    def _choice(self):
        options = [self._sequence()]
        while self.text[self.at : self.at + 1] == "|":
            self.at += 1
            options.append(self._sequence())
        return ("or", options)

    def _sequence(self):
        parts = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self._atom()
            while (c := self.text[self.at : self.at + 1]) and c in "?*+{":
                self.at += 1
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, None))
                if c == "{":
                    inner, _, _ = self.text[self.at :].partition("}")
                    self.at += len(inner) + 1
                    first, comma, last = inner.partition(",")
                    low, high = int(first), (int(last) if last else None) if comma else int(first)
                part = ("repeat", part, low, high)
            parts.append(part)
        return ("then", parts)

    def _byte(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self):
        c = self.text[self.at]
        if c == "(":
            self.at += 1
            inner = self._choice()
            self.at += 1
            return inner
        if c != "[":
            return ("bytes", self._cased({self._byte()}))
        self.at += 1
        negated = self.text[self.at] == "^"
        self.at += negated
        found: set[int] = set()
        while self.text[self.at] != "]":
            low = self._byte()
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found |= set(range(low, self._byte() + 1))
            else:
                found.add(low)
        self.at += 1
        return ("bytes", frozenset(range(256)) - found if negated else self._cased(found))

    def _cased(self, found: set[int]) -> frozenset:
        if self.any_case:
            found = found | {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
        return frozenset(found)

    def _build(self, tree, start: int, end: int) -> None:
        if tree[0] == "bytes":
            self.on[start].append((tree[1], end))
        elif tree[0] == "or":
            for option in tree[1]:
                self._build(option, start, end)
        elif tree[0] == "then":
            parts = tree[1][::-1] if self.backward else tree[1]
            for part in parts:
                self._build(part, start, middle := self._state())
                start = middle
            self.eps[start].append(end)
        else:
            _, part, low, high = tree
            for _ in range(low):
                self._build(part, start, middle := self._state())
                start = middle
            if high is None:
                self.eps[start].append(loop := self._state())
                self._build(part, loop, again := self._state())
                self.eps[again].append(loop)
                start = loop
            for _ in range((high or low) - low):
                self.eps[start].append(end)
                self._build(part, start, middle := self._state())
                start = middle
            self.eps[start].append(end)


class Automaton:
    """A minimal deterministic automaton of several rules.

    ``classes`` maps bytes to classes; ``step[state + class]`` is the next state, states being multiples of the number of classes;
    states from ``accepting`` on end a match of the rules in ``ends``. State 0 is dead if ``anchored``, else the start.
    """

    def __init__(self, rules: Iterable[Rule], anchored: bool = False, backward: bool = False):
        parts = [_Nfa(r.pattern, r.any_case, backward) for r in rules]
        eps: list[list[int]] = []
        on: list[list[tuple[frozenset, int]]] = []
        starts, finals = [], {}
        for i, n in enumerate(parts):
            base = len(eps)
            eps += [[base + t for t in x] for x in n.eps]
            on += [[(s, base + t) for s, t in x] for x in n.on]
            starts.append(base + n.start)
            finals[base + n.end] = i
        kinds: dict[tuple, int] = {}
        sets = list({s for x in on for s, _ in x})
        table = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
        some = {c: b for b, c in reversed(list(enumerate(table)))}

        def closed(found: Iterable[int]) -> frozenset:
            out, todo = set(found), list(found)
            while todo:
                for t in eps[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(out)

        first = closed(starts)
        ids, todo, moves = {first: 0}, [first], []
        while todo:  # subset construction
            state, row = todo.pop(0), []
            for c in range(len(kinds)):
                nxt = closed({t for q in state for s, t in on[q] if some[c] in s} | (set() if anchored else set(starts)))
                if nxt not in ids:
                    ids[nxt] = len(ids)
                    todo.append(nxt)
                row.append(ids[nxt])
            moves.append(row)
        ends = [frozenset(finals[q] for q in s if q in finals) for s in ids]
        dead = [not s for s in ids]
        names: dict = {}
        block = [names.setdefault((e, d), len(names)) for e, d in zip(ends, dead)]
        while True:  # partition refinement
            names = {}
            finer = [names.setdefault((b, *(block[t] for t in row)), len(names)) for b, row in zip(block, moves)]
            if len(names) == len(set(block)):
                break
            block = finer
        chosen = {b: q for q, b in reversed(list(enumerate(block)))}
        start = block[0]
        zero = next((b for b, q in chosen.items() if dead[q]), None) if anchored else start
        order = sorted(chosen, key=lambda b: (bool(ends[chosen[b]]), b != zero, b))
        place = {b: i for i, b in enumerate(order)}
        width = len(kinds)
        self.classes, self.width = table, width
        self.step = [place[block[t]] * width for b in order for t in moves[chosen[b]]]
        self.accepting = width * next((i for i, b in enumerate(order) if ends[chosen[b]]), len(order))
        self.ends = {place[b] * width: sorted(ends[chosen[b]]) for b in order if ends[chosen[b]]}
        self.start = place[start] * width
        self.dead = 0 if anchored and zero is not None else -1

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(end, state) wherever some rule ends; one pass over the bytes."""
        step, accepting, s, out = self.step, self.accepting, self.start, []
        for i, c in enumerate(data.translate(self.classes), 1):
            s = step[s + c]
            if s >= accepting:
                out.append((i, s))
        return out

    def longest(self, data: bytes) -> int:
        """Length of the longest match at the beginning of ``data``."""
        step, s, best = self.step, self.start, 0
        for i, c in enumerate(data.translate(self.classes), 1):
            s = step[s + c]
            if s == self.dead:
                break
            if s >= self.accepting:
                best = i
        return best


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Automaton(rules)
        self.back = [Automaton([r], anchored=True, backward=True) for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, leftmost and not overlapping per rule, by start and then rule."""
        hits = self.all.hits(data)
        if not hits:
            return []
        last: dict[int, list[int]] = {}
        for end, state in hits:
            for r in self.all.ends[state]:
                runs = last.setdefault(r, [])
                if runs and runs[-1] == end - 1:
                    runs[-1] = end
                else:
                    runs.append(end)
        out = []
        for r, runs in last.items():
            done, rule = 0, self.rules[r]
            for end in runs:
                if not (length := self.back[r].longest(data[done:end][::-1])):
                    continue
                start, done = end - length, end
                if length >= rule.least and (not rule.value or _value(data[start:end]) >= rule.value):
                    out.append((start, end, r))
        return sorted(out, key=lambda x: (x[0], x[2]))


def _value(match: bytes) -> int:
    """Length of the value in a match of an assignment."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of bytes as spans of code points."""
    if data.isascii():
        return spans
    at, points, where = 0, 0, {}
    for b in sorted({x for s, e, _ in spans for x in (s, e)}):
        points += sum((c & 0xC0) != 0x80 for c in data[at:b])
        at = b
        where[b] = points
    return [(where[s], where[e], r) for s, e, r in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE)) -> DataFrame:
    """did, counts (map of kind to number, every kind present), base_sha256, spans ("kind:start:end,...", code points) of every row.

    Null and empty texts have no spans. Repeated rows give equal rows. Offsets count code points, end exclusive.
    """
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in pieces(batches):
            counts, digests, spans = [], [], []
            for data in encoded(batch.column(1)):
                found = code_points(data, scanner.spans(data)) if data else []
                number = [0] * len(kinds)
                for _, _, r in found:
                    number[r] += 1
                counts.append(list(zip(kinds, number)))
                digests.append(hashlib.sha256(",".join(f"{kinds[r]}:{s}:{e}" for s, e, r in found if r < n_base).encode()).hexdigest())
                spans.append(",".join(f"{kinds[r]}:{s}:{e}" for s, e, r in found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.map_(pa.string(), pa.int64())), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["did", "counts", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "did long, counts map<string,bigint>, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mask: str = "[{}]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; ``chars_col``, if there, is counted again where a text changed.

    Overlapping spans are replaced as one, under the kind that starts first. Null texts stay null.
    """
    scanner = Scanner(rules)
    place = docs.columns.index(text_col)

    def clean(data: bytes | None) -> str | None:
        if data is None:
            return None
        out, done = [], 0
        for s, e, r in scanner.spans(data):
            if s >= done:
                out += [data[done:s], mask.format(rules[r].kind).encode()]
            done = max(done, e)
        return b"".join([*out, data[done:]]).decode("utf-8", "replace")

    def run(batches):
        for batch in pieces(batches, column=text_col):
            columns = list(batch.columns)
            columns[place] = pa.array([clean(x) for x in columns[place].cast(pa.large_binary()).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col).cast(kind)))
    return out
