"""Licence scans by template-markup matching: templates compile to automata over words.

The markup of license_templates is parsed into a nondeterministic automaton: a mandatory word is an edge, an optional
region can be passed by, and a replaceable one is so many edges that take any word, or one of its alternatives. One
automaton holds all templates and is made deterministic as words arrive. It is started wherever a word, or
two where the second is mandatory, can begin a template, which one vectorised look at all words finds, and accepts a
text's words from there only if all mandatory wording is there exactly. Starts that have come to the same state go on as
one, so a text is passed over once, however many places in it look like a beginning.

A match that a negation governs ("is not licensed under ...") isn't one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import kernels as K
from foliospark.llm import license_templates
from foliospark.llm.common import chunks, only, table

MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^<>]*)>>")
ANY = -1
_LENGTHS = re.compile(r"\.\{(\d+),(\d+)\}")
#: A negation in the same sentence, with three words at most between it and the match.
_NEGATED = re.compile(r"(?i)\b(?:not|never|neither|nor|cannot|no\s+longer|\w+n['’]t)(?:[^\w.!?;:]+\w+){0,3}[^\w.!?;:]*$")


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The lower-case words of a text and their hashes."""
    buf, start, end, _, h = K.hashed_words(pa.array([text]))
    low = K.lower(pa.array([text]))[0].as_py().encode()
    return [low[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)], h.tolist()


class Nfa:
    """Edges by state: (word hash or ANY, next); those for all words but some: (these, next); free moves; accepted licence by state."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []
        self.others: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.start = self.state()

    def state(self) -> int:
        self.edges.append([])
        self.others.append([])
        self.free.append([])
        return len(self.edges) - 1

    def literal(self, at: int, text: str) -> int:
        for h in words_of(text)[1]:
            new = self.state()
            self.edges[at].append((h, new))
            at = new
        return at

    def variable(self, at: int, match: str, until: list[int]) -> int:
        """``until`` has the next two mandatory words, or one if there is only one before the next markup."""
        end = self.state()
        if match == ".+":
            if not until:
                raise ValueError("replaceable words of any number need mandatory ones after them")
            inside = self.state()
            stop = frozenset(until[:1])
            for s in (at, inside):
                self.others[s].append((stop, inside))
            self.free[inside].append(end)
            if len(until) > 1:  # one state more: the word before was the first of the two
                maybe = self.state()
                for s in (at, inside):
                    self.edges[s].append((until[0], maybe))
                self.others[maybe].append((frozenset(until), inside))
                if until[0] != until[1]:
                    self.edges[maybe].append((until[0], maybe))
                    self.free[maybe].append(end)
            return end
        if lengths := _LENGTHS.fullmatch(match):
            least, most = map(int, lengths.groups())
            for i in range(most + 1):
                if i >= least:
                    self.free[at].append(end)
                if i < most:
                    new = self.state()
                    self.edges[at].append((ANY, new))
                    at = new
            return end
        for option in match.split("|"):
            self.free[self.literal(at, option)].append(end)
        return end

    def add(self, template: str, licence: int) -> None:
        at = self.state()
        self.free[self.start].append(at)
        open_: list[int] = []
        parts = MARKUP.split(template)
        for i, part in enumerate(parts):
            if i % 2 == 0:
                at = self.literal(at, part)
            elif part == "beginOptional":
                open_.append(at)
            elif part == "endOptional":
                if not open_:
                    raise ValueError("endOptional without beginOptional")
                end = self.state()
                self.free[at].append(end)
                self.free[open_.pop()].append(end)
                at = end
            else:
                found = re.search(r'match="([^"]*)"', part)
                if not found:
                    raise ValueError(f"var without match: {part}")
                at = self.variable(at, found[1], words_of(parts[i + 1])[1][:2])
        if open_:
            raise ValueError("beginOptional without endOptional")
        self.accepts[at] = licence

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    def openings(self) -> set[tuple[int, int]]:
        """The pairs of words that can begin a template; the second may be ANY."""
        out = set()
        for first, s in ((w, s) for q in self.closure([self.start]) for w, s in self.edges[q]):
            for q in self.closure([s]):
                if q in self.accepts:
                    raise ValueError("a template needs at least two words")
                out |= {(first, w) for w, _ in self.edges[q]} | {(first, ANY) for _ in self.others[q]}
        if any(first == ANY for first, _ in out) or any(self.others[q] for q in self.closure([self.start])):
            raise ValueError("a template can't begin with replaceable words")
        return out


class Automaton:
    """The templates' automaton, made deterministic on the way; made anew in each worker."""

    def __init__(self, templates=license_templates.TEMPLATES):
        self.names = [(name, category) for name, category, _ in templates]
        self.nfa = Nfa()
        for i, (_, _, texts) in enumerate(templates):
            for text in texts:
                self.nfa.add(text, i)
        openings = self.nfa.openings()
        self.alone = K.HashSet(np.array([first for first, second in openings if second == ANY], np.uint64))
        pairs = sorted(p for p in openings if ANY not in p)
        flat = np.array([h for p in pairs for h in p], np.uint64)
        grams = K.gram_hashes(flat, np.repeat(np.arange(len(pairs)), 2), 2)
        self.seeds = K.HashSet(grams[grams != 0])
        self.ids: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.moves: list[dict[int, int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.vocabulary = {w for e in self.nfa.edges for w, _ in e if w != ANY} | {w for e in self.nfa.others for words, _ in e for w in words}
        self.initial = self._id(self.nfa.closure([self.nfa.start]))

    def _id(self, states: frozenset[int]) -> int:
        if (i := self.ids.get(states)) is None:
            i = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            self.accepts.append(tuple(sorted({self.nfa.accepts[s] for s in states if s in self.nfa.accepts})))
        return i

    def step(self, i: int, word: int) -> int:
        """The next state, -1 for none."""
        if word not in self.vocabulary:
            word = ANY
        if (to := self.moves[i].get(word)) is None:
            after = self.nfa.closure([s for q in self.sets[i] for w, s in self.nfa.edges[q] if w in (word, ANY)] + [s for q in self.sets[i] for words, s in self.nfa.others[q] if word not in words])
            to = self.moves[i][word] = self._id(after) if after else -1
        return to

    def longest(self, words: np.ndarray, first: int, end: int) -> dict[int, int]:
        """For each licence accepted from word ``first`` on, the end of its longest match."""
        i, found = self.initial, {}
        for at in range(first, end):
            i = self.step(i, int(words[at]))
            if i < 0:
                break
            for licence in self.accepts[i]:
                found[licence] = at + 1
        return found

    def matches(self, owner: np.ndarray, h: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
        """(text, licence, first, end) of every match that no longer one contains, words numbered over all texts."""
        starts = np.union1d(self.seeds.find(K.gram_hashes(h, owner, 2)), self.alone.find(h))
        out = []
        for group in np.split(starts, np.flatnonzero(np.diff(owner[starts]) > 0) + 1):
            if not group.size:
                continue
            text, begin = int(owner[group[0]]), int(group[0])
            words = h[begin : int(np.searchsorted(owner, owner[begin], "right"))].tolist()
            found = self._pass(words, (group - begin).tolist())
            reach, last = -1, None
            for first, minus, licence in sorted((first, -end, licence) for (first, licence), end in found.items()):
                if -minus > reach or (first, minus) == last:
                    out.append((text, licence, begin + first, begin - minus))
                    reach, last = max(reach, -minus), (first, minus)
        return out

    def _pass(self, words: list[int], starts: list[int]) -> dict[tuple[int, int], int]:
        """The ends of the longest matches by (first word, licence). Of starts that meet in a state the first goes on: its match contains the others'."""
        found: dict[tuple[int, int], int] = {}
        active: dict[int, int] = {}
        waiting = iter([*starts, len(words)])
        at = start = next(waiting)
        while at < len(words):
            if at == start:
                if self.initial not in active:
                    active[self.initial] = at
                start = next(waiting)
            after: dict[int, int] = {}
            for state, first in active.items():
                if (to := self.step(state, words[at])) >= 0:
                    after[to] = min(first, after.get(to, first))
            at += 1
            for state, first in after.items():
                for licence in self.accepts[state]:
                    found[first, licence] = at
            active = after
            if not active:
                at = start
        return found


@lru_cache(4)
def automaton(templates=license_templates.TEMPLATES) -> Automaton:
    return Automaton(templates)


def _negated(buf: np.ndarray, begin: int, at: int) -> bool:
    """Whether a negation governs what is at ``at``; one on a line before does only if no new sentence begins there."""
    text = buf[max(begin, at - 160) : at].tobytes().decode(errors="ignore")
    if bytes(buf[at : at + 1]).isupper():
        text = text[text.rfind("\n") + 1 :]
    return _NEGATED.search(text) is not None


NAMES = ("doc_id", "license", "category", "first_word", "n_words", "matched")


def scan_batch(b: pa.RecordBatch, own: Automaton) -> pa.RecordBatch:
    texts = b.column("text")
    buf, start, end, owner, h = K.hashed_words(texts)
    before = np.searchsorted(owner, np.arange(b.num_rows))
    found = [f for f in own.matches(owner, h, b.num_rows) if not _negated(buf, int(start[before[f[0]]]), int(start[f[2]]))]
    return pa.record_batch(
        [
            b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
            pa.array([own.names[f[1]][0] for f in found], pa.string()),
            pa.array([own.names[f[1]][1] for f in found], pa.string()),
            pa.array([f[2] - int(before[f[0]]) for f in found], pa.int64()),
            pa.array([f[3] - f[2] for f in found], pa.int64()),
            pa.array([buf[start[f[2]] : end[f[3] - 1]].tobytes().decode() for f in found], pa.string()),
        ],
        names=list(NAMES),
    )


def scan(docs: DataFrame, templates=license_templates.TEMPLATES) -> DataFrame:
    """One row a match: doc_id, license, category, first_word (from 0), n_words and the matched text.

    One narrow Arrow pass, no shuffle. A match is the longest from its first word on; one that lies in a longer one
    isn't listed; two licences with the same words are both; one that a negation governs is left out. Every place of every
    text is looked at, in one pass. Null and empty texts, and texts with a mandatory word changed, give no row; a repeated row gives its matches again; a null
    doc_id stays null; other columns are ignored; no rows give no rows.
    """
    automaton(templates)  # a wrong template fails here

    def run(batches):
        own = automaton(templates)
        for b in chunks(batches, "text"):
            yield scan_batch(b, own)

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, license string, category string, first_word bigint, n_words bigint, matched string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
