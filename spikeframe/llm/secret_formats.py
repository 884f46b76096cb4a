"""Secret scan: fixed patterns plus formats learned from labelled credentials.

The values found by the patterns are labelled credentials. Per kind, a prefix tree over character
classes is merged state by state where the frequencies agree (Hoeffding test, states of one depth
before states of different depths) into a probabilistic automaton. Another automaton is learned from
the tokens of 16 characters and more, with a letter, that no pattern touches; once more without those
that a format explains better, as unlabelled credentials are among them. Every such token is scored
by all automata and becomes a span of kind `format` if a credential format explains it better than
the other tokens' automaton does by a margin.

The patterns run over every whole text. The automata are fitted on at most `sample` distinct values
per kind, those with the smallest hash of the whole corpus, and their first `LONGEST` characters;
candidates are all tokens, whole.

Defined results: null and empty texts have no spans. Without labelled values of a kind, that kind
has no automaton. Repeated rows are scanned row by row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("assign", "access", "hex")
ORDER = {kind: k for k, kind in enumerate((*KINDS, "format"))}
# The base patterns. Runs are maximal, so their least lengths stand in the pattern
# where a match that fails it would hide nothing.
_ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LETTER = re.compile(r"[A-Za-z]")
LEAST = 16
#: An automaton learns from that much of a longer value, without an end; all of it is scored.
LONGEST = 128
#: Odds of about a thousand to one.
MARGIN = 7.0


def base_spans(text: str, words: list[str]) -> list[tuple[int, int, int, str]]:
    """(start, kind order, end, credential), by start then kind. `words` are the text's, split at white space."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    if any([len(w) >= 32 for w in words]):
        found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, words: list[str], taken) -> list[tuple[int, int, str]]:
    """Long tokens with a letter that no base span touches."""
    if not any([len(w) >= LEAST for w in words]):
        return []
    out, k = [], 0
    spans = sorted((s, e) for s, _, e, _ in taken)
    for m in _CANDIDATE.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            continue
        if _LETTER.search(m[0]):  # a number is no credential
            out.append((m.start(), m.end(), m[0]))
    return out


def symbol(c: str) -> str:
    """Character class: digit, hex letter, other letter by case; any other character is its own."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "z"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "Z"
    return c


class Automaton:
    """Probabilistic automaton: per state its visits, ends, and transitions by symbol and character.

    Prefix-tree states of one depth are merged first, which pools what is known of a position. Only then
    are states of different depths compared, with all that follows: a fixed length or a separator at a
    fixed place stays, because somewhere behind two such states one ends and the other goes on.
    """

    def __init__(self, values, alpha: float = 0.05, least: int = 8):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.chars: list[Counter] = [Counter()]
        self.ends, self.visits, self.depth = [0], [0], [0]
        for value in sorted(values):
            self._add(value)
        self.tree = len(self.next)
        self.into = list(range(self.tree))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.least = least
        self._merge_levels()
        self._merge_depths()
        self._tables()

    def _tables(self) -> None:
        whole, kinds = Counter(), Counter()
        for s in self.alive:
            whole.update(self.chars[s])
            kinds.update(self.count[s])
        total = whole.total() + len(self.alive)
        self.score_of, self.end_of = {}, {}
        for s in self.alive:
            for c, n in self.chars[s].items():
                kind = symbol(c)
                of_kind = self.count[s][kind]
                self.score_of[s, c] = math.log(of_kind / self.visits[s]) + math.log((n + 1) / (of_kind + self._size(kind)))
            for kind, n in self.count[s].items():  # a character not seen here, of a class that was
                self.score_of[s, None, kind] = math.log(n / self.visits[s]) - math.log(n + self._size(kind))
            self.end_of[s] = math.log((self.ends[s] + 0.5) / (self.visits[s] + 1))
        self.anywhere = {kind: math.log(n / total) - math.log(self._size(kind)) for kind, n in kinds.items()}

    @staticmethod
    def _size(c: str) -> int:
        return {"0": 10, "a": 6, "A": 6, "z": 20, "Z": 20}.get(c, 1)

    def _add(self, value: str) -> None:
        s = 0
        self.visits[0] += 1
        for char in value[:LONGEST]:
            c = symbol(char)
            self.count[s][c] += 1
            self.chars[s][char] += 1
            if c not in self.next[s]:
                self.next[s][c] = len(self.next)
                self.next.append({})
                self.count.append(Counter())
                self.chars.append(Counter())
                self.ends.append(0)
                self.visits.append(0)
                self.depth.append(self.depth[s] + 1)
            s = self.next[s][c]
            self.visits[s] += 1
        self.ends[s] += len(value) <= LONGEST

    def find(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = s = self.into[self.into[s]]
        return s

    def _alike(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) < self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether two states, and those behind them, have statistically equal futures."""
        todo, seen = [(a, b)], set()
        while todo:
            pair = todo.pop()
            a, b = map(self.find, pair)
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n1, n2 = self.visits[a], self.visits[b]
            if n1 < self.least or n2 < self.least:
                continue
            if not self._alike(self.ends[a], n1, self.ends[b], n2):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if not self._alike(self.count[a][c], n1, self.count[b][c], n2):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _merge(self, a: int, b: int) -> None:
        """Make two states one, and what follows them by equal symbols."""
        todo = [(a, b)]
        while todo:
            pair = todo.pop()
            a, b = sorted(map(self.find, pair))
            if a == b:
                continue
            self.into[b] = a
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            self.count[a].update(self.count[b])
            self.chars[a].update(self.chars[b])
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge_levels(self) -> None:
        levels = defaultdict(list)
        for s, d in enumerate(self.depth):
            levels[d].append(s)
        for d in sorted(levels):
            held = []
            for s in sorted({self.find(s) for s in levels[d]}, key=lambda s: (-self.visits[s], s)):
                for r in held:
                    if self._compatible(r, s):
                        self._merge(r, s)
                        break
                else:
                    held.append(s)

    def _merge_depths(self) -> None:
        red, blue = [0], [0]
        for s in blue:  # grows while it is walked: breadth first
            for c in sorted(self.next[self.find(s)]):
                t = self.find(self.next[self.find(s)][c])
                if t in blue:
                    continue
                blue.append(t)
                if self.visits[t] >= self.least:
                    for r in red:
                        if self.find(r) == r and self.visits[r] >= self.least and self._compatible(r, t):
                            self._merge(r, t)
                            break
                red.append(t)
        self.alive = sorted({self.find(s) for s in red})

    def likelihood(self, value: str, floor: float = math.log(1e-4)) -> float:
        """Mean log-likelihood per character.

        A step that no labelled value took costs `floor` once; from there characters are judged by
        their frequency anywhere in the format, and the end, in the wrong place, costs `floor` again.
        """
        s, total = 0, 0.0
        for char in value:
            c = symbol(char)
            if s is not None and c in self.next[s]:
                total += self.score_of[s, char] if (s, char) in self.score_of else self.score_of[s, None, c]
                s = self.find(self.next[s][c])
                continue
            if s is not None:
                s = None
                total += floor
            total += self.anywhere.get(c, floor)
        total += self.end_of[s] if s is not None else floor
        return total / (len(value) + 1)


def labelled_values(docs: DataFrame, sample: int) -> DataFrame:
    """kind, value: per task the values with the smallest hashes; kind `word` has the other long tokens."""
    def kernel(batches):
        held: dict[str, dict[bytes, str]] = defaultdict(dict)

        def trim(kind):
            held[kind] = dict(sorted(held[kind].items())[:sample])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = text or ""
                words = text.split()
                spans = base_spans(text, words)
                rows = [(KINDS[k], v) for _, k, _, v in spans] + [("word", v) for *_, v in candidates(text, words, spans)]
                for kind, value in rows:
                    held[kind][hashlib.blake2b(value.encode(), digest_size=8).digest()] = value[:LONGEST + 1]
                    if len(held[kind]) > 4 * sample + 100:
                        trim(kind)
        for kind in list(held):
            trim(kind)
        rows = [(kind, h.hex(), v) for kind, values in held.items() for h, v in values.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["kind", "hash", "value"])

    return docs.select("text").mapInArrow(kernel, "kind string, hash string, value string")


def fit(docs: DataFrame, sample: int = 500) -> dict[str, Automaton]:
    """One automaton per kind from at most `sample` distinct values of each."""
    scratch = Scratch(docs.sparkSession, "secret-formats")
    values = scratch.write(labelled_values(docs, sample), "values")
    found = {}
    for kind in (*KINDS, "word"):
        rows = (values.where(F.col("kind") == kind).dropDuplicates(["hash"]).orderBy("hash").limit(sample)
                .select("value").collect())
        if rows:
            found[kind] = Automaton([r["value"] for r in rows])
            if kind == "word":
                plain = [r["value"] for r in rows if best_margin(r["value"], found) <= MARGIN]
                found[kind] = Automaton(plain) if 0 < len(plain) < len(rows) else found[kind]
    scratch.delete()
    return found


def best_margin(value: str, automata: dict[str, Automaton]) -> float:
    """Log-likelihood of the value under the best credential format less that under the other tokens' automaton."""
    formats = [a.likelihood(value) for kind, a in automata.items() if kind != "word"]
    if not formats:
        return -math.inf
    other = automata["word"].likelihood(value) if "word" in automata else math.log(1e-4)
    return (max(formats) - max(other, math.log(1e-4))) * (len(value) + 1)


def scan(docs: DataFrame, automata: dict[str, Automaton] | None = None, sample: int = 500,
         margin: float = MARGIN) -> DataFrame:
    """doc_id, spans (array of kind, start, end in code points), by start then kind."""
    automata = fit(docs, sample) if automata is None else automata

    def kernel(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                words = text.split()
                base = base_spans(text, words)
                rows = [(s, k, e) for s, k, e, _ in base]
                rows += [(s, ORDER["format"], e) for s, e, v in candidates(text, words, base)
                         if best_margin(v, automata) > margin]
                names = (*KINDS, "format")
                out.append([{"kind": names[k], "start": s, "end": e} for s, k, e in sorted(rows)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(kernel, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digests(spans: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    def text(rows):
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "format")
    return spans.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
