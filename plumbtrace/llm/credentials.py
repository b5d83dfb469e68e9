"""Secret scans: base patterns, and formats learned by grammar inference.

Credentials that the base patterns find in all documents are the labelled strings; of each kind, a bounded
number is learned from. They form a prefix tree; its states are merged, breadth first, wherever their
continuations are statistically compatible (Hoeffding bounds), which folds the tree into a
probabilistic automaton of the format. Every run of credential characters of every text, and every part of it
between dots, is scored by the automata: the log-likelihood for each character must be one that labelled credentials
reach, and the likelihood must exceed by far that of ordinary text, whose pairs of neighbouring characters are
counted over all documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbtrace.sources.scratch import materialise

#: Distinct credentials of each kind that formats are learned from at most.
CREDENTIALS_PER_KIND = 600
ALPHA = 0.01
#: Nats by which a format must be likelier than ordinary text.
MARGIN = 12.0
#: Share of labelled credentials that the learned bar leaves below it.
BELOW = 0.02

#: Kinds in order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: runs of credential characters, as long as the shortest base credential at least.
SHORTEST = 6
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_PART = re.compile(r"[^.]+")
#: Share of all characters that one needs for pairs to count as much as single characters; else credentials
#: that nothing labels would make their own rare characters ordinary.
BACK_OFF = 0.01
#: Before and after a run of ordinary text.
_EDGE = " "
#: Distinct runs that are remembered at once.
_KNOWN = 200_000


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, b, secret) for a, k, b, secret in sorted(found)]


class FormatAutomaton:
    """A probabilistic automaton inferred from strings by merging states of their prefix tree."""

    def __init__(self, strings: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.stop: list[int] = [0]
        for s in sorted(strings):
            at = 0
            for c in s:
                self.count[at][c] += 1
                if c not in self.next[at]:
                    self.next.append({})
                    self.count.append(Counter())
                    self.stop.append(0)
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self._score()

    def _total(self, q: int) -> int:
        return sum(self.count[q].values()) + self.stop[q]

    def _compatible(self, a: int, b: int) -> bool:
        """Every continuation of the two states has frequencies within the Hoeffding bound."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stop[a] / n - self.stop[b] / m) > bound:
                return False
            x, y = self.count[a], self.count[b]
            for c in x.keys() | y.keys():
                if abs(x[c] / n - y[c] / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pairs.append((self.next[a][c], self.next[b][c]))
        return True

    def _infer(self) -> None:
        settled, waiting = [0], deque(self.next[0][c] for c in sorted(self.next[0]))
        parent = {self.next[0][c]: (0, c) for c in self.next[0]}
        done = {0}
        while waiting:
            q = waiting.popleft()
            if q in done or q not in parent or self.next[parent[q][0]].get(parent[q][1]) != q:
                continue
            for r in settled:
                if self._compatible(r, q):
                    self.next[parent[q][0]][parent[q][1]] = r
                    self._fold(r, q)
                    break
            else:
                settled.append(q)
                done.add(q)
            for r in settled:  # states next to settled ones, that are not settled
                for c in sorted(self.next[r]):
                    x = self.next[r][c]
                    if x not in done and x not in parent:
                        parent[x] = (r, c)
                        waiting.append(x)
        self.states = settled

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state; what the state lacks is hung onto it."""
        pairs = [(into, tree)]
        while pairs:
            a, b = pairs.pop()
            self.stop[a] += self.stop[b]
            self.count[a].update(self.count[b])
            for c, x in self.next[b].items():
                if c in self.next[a]:
                    pairs.append((self.next[a][c], x))
                else:
                    self.next[a][c] = x

    def _score(self) -> None:
        self.table = {}
        for q in {0, *self.states, *(x for r in self.states for x in self.next[r].values())}:
            n = self._total(q)
            self.table[q] = ({c: math.log(k / (n + 1)) for c, k in self.count[q].items()}, dict(self.next[q]), math.log((self.stop[q] + 0.5) / (n + 1)))

    def log_likelihood(self, s: str) -> float:
        """-inf once the automaton has no way on."""
        at, total = 0, 0.0
        for c in s:
            row = self.table.get(at)
            if row is None or c not in row[0]:
                return -math.inf
            total += row[0][c]
            at = row[1][c]
        return total + (self.table[at][2] if at in self.table else -math.inf)

    def prefixes(self, s: str, start: int, ends: set[int]) -> Iterator[tuple[int, float]]:
        """(end, log-likelihood of s[start:end]) for those of `ends` that the automaton gets to."""
        at, total = 0, 0.0
        for k in range(start, len(s)):
            row = self.table.get(at)
            if row is None or s[k] not in row[0]:
                return
            total += row[0][s[k]]
            at = row[1][s[k]]
            if k + 1 in ends and at in self.table:
                yield k + 1, total + self.table[at][2]


class FormatModel:
    """Automata of all kinds, their bars, and the costs of ordinary text; `pairs` counts its pairs of neighbouring characters."""

    def __init__(self, credentials: dict[str, list[str]], pairs: Counter):
        after, before = Counter(), Counter()
        for (x, y), n in pairs.items():
            after[y] += n
            before[x] += n
        total = sum(after.values()) + 80
        self.single = {c: (n + 1) / total for c, n in after.items()}
        self.unseen, self.back_off = 1 / total, BACK_OFF * total
        self.pairs, self.before = dict(pairs), dict(before)
        self.costs: dict[str, float] = {}
        self.known: dict[str, list[tuple[str, int, int]]] = {}
        self.formats: dict[str, tuple[FormatAutomaton, float]] = {}
        for kind, strings in credentials.items():
            if len(strings) >= 20:
                # the bar comes from strings that the automaton has not seen
                learn, held = strings[::2], strings[1::2]
                automaton = FormatAutomaton(learn)
                rates = sorted(automaton.log_likelihood(s) / (len(s) + 1) for s in held)
                rates = [r for r in rates if r > -math.inf]
                if rates:
                    self.formats[kind] = automaton, rates[int(BELOW * len(rates))]
        # what an automaton accepts consists of characters that it knows; most texts hold no such run
        known = ("".join(map(re.escape, sorted({c for row, _, _ in a.table.values() for c in row}))) for a, _ in self.formats.values())
        self.gate = re.compile("|".join(f"[{x}]{{{SHORTEST},}}" for x in sorted(set(known)) if x) or "(?!)")

    def _cost(self, pair: str) -> float:
        """Log-probability of a character after another, backing off to that of the character alone."""
        if pair not in self.costs:
            x, y = pair
            n, single = self.before.get(x, 0), self.single.get(y, self.unseen)
            self.costs[pair] = math.log((self.pairs.get(pair, 0) + self.back_off * single) / (n + self.back_off))
        return self.costs[pair]

    def ordinary(self, s: str) -> float:
        """Log-likelihood as ordinary text, which holds words and numbers."""
        t = _EDGE + s + _EDGE
        plain = sum(self._cost(t[k:k + 2]) for k in range(len(t) - 1))
        return max(plain, -len(s) * math.log(10)) if s.isdigit() else plain

    def _likeliest(self, s: str, start: int, ends: set[int]) -> tuple[str, int] | None:
        best, score = None, MARGIN
        for kind, (automaton, bar) in self.formats.items():
            for end, p in automaton.prefixes(s, start, ends):
                n = end - start
                if n >= SHORTEST and p / (n + 1) >= bar:
                    gain = p - self.ordinary(s[start:end])
                    if gain > score:
                        best, score = (kind, end), gain
        return best

    def found(self, run: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of what has a learned format: the run, or parts of it that dots bound."""
        if run not in self.known:
            if len(self.known) >= _KNOWN:
                self.known.clear()
            parts = [m.span() for m in _PART.finditer(run)]
            ends, out, at = {b for _, b in parts} | {len(run)}, [], 0
            for a in sorted({0, *(a for a, _ in parts)}):
                best = self._likeliest(run, a, ends) if a >= at else None
                if best:
                    kind, at = best
                    out.append((kind, a, at))
            self.known[run] = out
        return self.known[run]

    def added(self, text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int]]:
        """What has a learned format and touches no base span."""
        hopes = self.gate.search
        if not hopes(text) or not any([self.found(run) for run in set(_CANDIDATE.findall(text)) if hopes(run)]):
            return []
        out, k = [], 0
        for m in _CANDIDATE.finditer(text):
            while k < len(base) and base[k][2] <= m.start():
                k += 1
            if not hopes(m[0]) or not self.found(m[0]):  # no part of it has a format either
                continue
            # base spans are in order of their starts; those that touch the run take the parts that they touch out of it
            taken = [(a, b) for _, a, b, _ in base[k:] if a < m.end() and m.start() < b] if k < len(base) and base[k][1] < m.end() else []
            for start, run in _left(m[0], m.start(), taken) if taken else [(m.start(), m[0])]:
                out += [(kind, start + a, start + b) for kind, a, b in self.found(run)]
        return out


def _left(run: str, start: int, taken: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """What the parts that touch none of `taken` leave of a run: (start, longest rows of such parts)."""
    rows: list[list[int]] = []
    joined = False
    for m in _PART.finditer(run):
        a, b = m.start() + start, m.end() + start
        if any(x < b and a < y for x, y in taken):
            joined = False
        elif joined:
            rows[-1][1] = b
        else:
            rows.append([a, b])
            joined = True
    return [(a, run[a - start:b - start]) for a, b in rows]


def train_formats(docs: DataFrame, text: str = "text", per_kind: int = CREDENTIALS_PER_KIND) -> FormatModel:
    """Learn from all documents, and of each kind's distinct credentials from the first by hash; without credentials no format is learned."""
    texts = docs.select(F.col(text).alias("text")).where("text is not null")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        secrets, runs, pairs = {k: set() for k in KINDS}, Counter(), Counter()
        for b in batches:
            for t in b["text"]:
                rest, at = [], 0
                for kind, start, end, secret in base_spans(t):
                    secrets[kind].add(secret)
                    if len(secrets[kind]) > 4 * per_kind:
                        secrets[kind] = set(sorted(secrets[kind], key=_order)[:per_kind])
                    rest.append(t[at:max(at, start)])
                    at = max(at, end)
                runs.update(_CANDIDATE.findall("\n".join([*rest, t[at:]])))
                if len(runs) > _KNOWN:
                    _count_pairs(runs, pairs)
                    runs.clear()
        _count_pairs(runs, pairs)
        rows = []
        for k, found in secrets.items():  # the first by hash of all are among the first of each task
            rows += [(k, s, 0) for s in sorted(found, key=_order)[:per_kind]]
        rows += [("", c, v) for c, v in pairs.items()]
        yield pd.DataFrame(rows, columns=["kind", "value", "n"])

    found = materialise(texts.mapInPandas(find, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "secrets_found")
    pairs = Counter({r.value: r.n for r in found.where("kind = ''").collect()})
    credentials = {
        k: [r.value for r in found.where(F.col("kind") == k).orderBy(F.sha2("value", 256), "value").limit(per_kind).collect()] for k in KINDS
    }
    return FormatModel(credentials, pairs)


def _count_pairs(runs: Counter, pairs: Counter) -> None:
    for run, n in runs.items():
        for x, y in zip(_EDGE + run, run + _EDGE):
            pairs[x + y] += n


def _order(s: str) -> tuple[str, str]:
    return hashlib.sha256(s.encode()).hexdigest(), s


_RESULT = "n_assign long, n_access long, n_hex long, base string, spans string"


def secret_spans(text: Column, model: FormatModel, spark) -> Column:
    """Struct: counts of base spans by kind, base spans and all spans as kind:start:end.

    Places count code points of the whole text, ends are exclusive; null and empty texts have none.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        formats = shared.value
        for texts in batches:
            rows = []
            for t in texts:
                base = base_spans(t) if t else []
                kinds = Counter(k for k, _, _, _ in base)
                spans = [x[:3] for x in base]
                every = sorted([*spans, *(formats.added(t, base) if t else [])], key=lambda x: (x[1], KINDS.index(x[0])))
                rows.append((*(kinds[k] for k in KINDS), *(",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in (spans, every))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base", "spans"])

    return scan(text)


def find_secrets(docs: DataFrame, **options) -> DataFrame:
    """`docs` (text) with a struct column `secrets`; a column of that name is replaced, others are passed on.

    Repeated rows have equal results; an empty table gives an empty result.
    """
    model = train_formats(docs, **options)
    return docs.withColumn("secrets", secret_spans(F.col("text"), model, docs.sparkSession))
