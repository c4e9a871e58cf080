"""Problems 4 and 6: byte-level BPE as an automaton over merges.

``MergeArcs`` is the deterministic automaton that results from turning the merges, in order, into gadgets: at
first one state has an arc to itself for every byte; the merge of ``a`` and ``b`` into ``c`` sends every arc ``a``
to a copy of its target without the arc ``b``, and adds an arc ``c`` wherever ``a`` and then ``b`` could be read. The
state after an arc depends on its label only, so the automaton is the relation "label t may follow label a". It is
not written out (50,000 states of 50,000 arcs); an arc is found by walking the gadgets back in time through the
parts of both labels, and is kept.

``Encoder`` reads words with a suffix automaton of the vocabulary: a table gives, for each state and byte, the
next state and the longest label that ends there. The one label that may follow the label before it is the last
label of the word so far; the labels on the path are the ids.

``CountLattice`` holds the vocabulary in a double-array trie and runs a Viterbi pass that keeps counts instead
of paths. With unigram scores the best path decides, with merges the arcs of the automaton leave one path.
"""

from __future__ import annotations

import base64
import json
import re
from collections import deque

import regex

# The pattern that splits text before the merges, and the bytes that stand for themselves in the vocabulary file.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = ((33, 126), (161, 172), (174, 255))

_SPLIT = regex.compile(SPLIT)
#: The same for texts without non-ASCII and without the control characters on which the two libraries differ.
_SPLIT_ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_ODD = re.compile("[\x1c-\x1f]")
_NEVER = 1 << 60
_CACHE_LIMIT = 500_000
#: Longer words and segments are not kept, so that the bytes of what is kept are bounded too.
_CACHE_CHARS = 64


def split_words(text: str) -> list[str]:
    """The pieces of a text within which merges happen; joined they are the text."""
    return (_SPLIT_ASCII if text.isascii() and not _ODD.search(text) else _SPLIT).findall(text)


def _letters() -> dict[str, int]:
    plain = [b for low, high in PLAIN_BYTES for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Bytes of each id, and the merges (left, right, whole) in order.

    ``.json`` files state the merges. ``.tiktoken`` files give ranks; the merge that makes a token is the split of
    its bytes that earlier merges leave last.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = _letters(), model["vocab"]
        size = max(vocab.values()) + 1
        names = [b""] * size
        for name, i in vocab.items():
            names[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else b""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return names, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    names = [b""] * (max(ranks.values()) + 1)
    for name, i in ranks.items():
        names[i] = name
    merges = []
    for i, name in enumerate(names):
        if len(name) > 1:
            parts = [name[k : k + 1] for k in range(len(name))]
            while len(parts) > 2:
                options = [(ranks.get(x + y, _NEVER), k) for k, (x, y) in enumerate(zip(parts, parts[1:]))]
                rank, k = min(options)
                if rank >= i:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                merges.append((ranks[parts[0]], ranks[parts[1]], i))
    return names, merges


class MergeArcs:
    """Which label may follow which."""

    def __init__(self, size: int, merges: list[tuple[int, int, int]]):
        self.size = size
        self.at: dict[int, int] = {}
        self.birth = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.known: dict[int, bool] = {}
        for time, (a, b, c) in enumerate(merges):
            if self.birth[c] < 0 and self.reaches(a, b, time):
                self.at[a * size + b] = time
                self.birth[c], self.left[c], self.right[c] = time, a, b

    def reaches(self, a: int, t: int, time: int = _NEVER) -> bool:
        """Whether the state after ``a`` has an arc ``t`` once the merges before ``time`` are in."""
        birth, size, at = self.birth, self.size, self.at
        while True:
            if at.get(a * size + t, _NEVER) < time:
                return False
            x, y = birth[a], birth[t]
            if x < 0 and y < 0:
                return True
            if x > y:
                a, time = self.right[a], x
            elif y > x:
                t, time = self.left[t], y + 1
            else:
                a, t, time = self.right[a], self.left[a], x

    def follows(self, a: int, t: int) -> bool:
        key = a * self.size + t
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 4 * _CACHE_LIMIT:
                self.known.clear()
            found = self.known[key] = self.reaches(a, t)
        return found

    def alive(self, names: list[bytes]) -> list[int]:
        """Labels that the automaton can read: bytes, and wholes of merges."""
        return [i for i, name in enumerate(names) if len(name) == 1 or name and self.birth[i] >= 0]


class Encoder:
    """Text to ids and back; ``encode`` of a null or empty text is the empty list."""

    def __init__(self, path: str):
        self.names, merges = read_vocabulary(path)
        self.arcs = MergeArcs(len(self.names), merges)
        self._build(self.arcs.alive(self.names))
        self._words: dict[str, list[int]] = {}

    def _build(self, labels: list[int]) -> None:
        """The suffix automaton: ``step[state * 256 + byte]``, the longest label that ends in a state, and the next shorter one."""
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for i in labels:
            node = 0
            for byte in self.names[i]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    own.append(-1)
                node = children[node][byte]
            own[node] = i
        fail, longest = [0] * len(children), [-1] * len(children)
        self.step: dict[int, int] = {}
        self.shorter = [-1] * len(self.names)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node].items():
                back = fail[node]
                while back and byte not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(byte, 0) if node else 0
                longest[child] = own[child] if own[child] >= 0 else longest[fail[child]]
                if own[child] >= 0:
                    self.shorter[own[child]] = longest[fail[child]]
                queue.append(child)
        self._children, self._fail, self._longest = children, fail, longest

    def _next(self, state: int, byte: int) -> int:
        node = state
        while node and byte not in self._children[node]:
            node = self._fail[node]
        found = self.step[state << 8 | byte] = self._children[node].get(byte, 0)
        return found

    def encode_word(self, word: str) -> list[int]:
        found = self._words.get(word)
        if found is None:
            found = self._run(word.encode("utf-8", "replace"))
            if len(word) <= _CACHE_CHARS:
                if len(self._words) > _CACHE_LIMIT:
                    self._words.clear()
                self._words[word] = found
        return found

    def _run(self, data: bytes) -> list[int]:
        names, shorter, follows, step, longest = self.names, self.shorter, self.arcs.follows, self.step, self._longest
        state, last = 0, []
        for i, byte in enumerate(data):
            after = step.get(state << 8 | byte)
            state = self._next(state, byte) if after is None else after
            label = longest[state]
            while (start := i - len(names[label])) >= 0 and not follows(last[start], label):
                label = shorter[label]
            last.append(label)
        out, i = [], len(data) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(names[last[i]])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for word in split_words(text) if text else ():
            out += self.encode_word(word)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.names[i] for i in ids).decode("utf-8", "replace")


class DoubleArrayTrie:
    """Byte strings with values in two arrays: the child of node s by byte b is t = base[s] + b if check[t] == s."""

    def __init__(self, entries: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = {}
        for key, value in entries.items():
            node = 0
            for byte in key:
                node = children[node].setdefault(byte, len(children))
                if node == len(children):
                    children.append({})
            values[node] = value
        room = 2 * len(children) + 512
        self.base, self.check, self.value = [0] * room, [-1] * room, [-1] * room
        place = {0: 0}
        self.check[0] = 0
        free, queue = 1, deque([0])
        while queue:
            node = queue.popleft()
            if node in values:
                self.value[place[node]] = values[node]
            if not children[node]:
                continue
            labels = sorted(children[node])
            while self.check[free] >= 0:
                free += 1
            base = max(free - labels[0], 1)
            while any(self.check[base + b] >= 0 for b in labels):
                base += 1
                if base + 256 >= len(self.check):
                    for array, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                        array.extend([fill] * room)
            self.base[place[node]] = base
            for b in labels:
                self.check[base + b] = place[node]
                place[children[node][b]] = base + b
                queue.append(children[node][b])
            if base + 512 >= len(self.check):
                for array, fill in ((self.base, 0), (self.check, -1), (self.value, -1)):
                    array.extend([fill] * room)

    def starts(self, data: bytes, at: int):
        """(end, value) of every entry that stands in ``data`` at ``at``."""
        base, check, value = self.base, self.check, self.value
        node = 0
        for end in range(at, len(data)):
            nxt = base[node] + data[end]
            if nxt >= len(check) or check[nxt] != node or nxt == 0:
                return
            node = nxt
            if value[node] >= 0:
                yield end + 1, value[node]


class CountLattice:
    """Number of labels on the best path of a segment, without the path.

    ``scores`` (log probabilities by id) makes it the unigram model: the path with the highest sum, the shorter
    one of equal sums. ``arcs`` makes it the merge model. A byte that no entry covers counts as one label.
    """

    def __init__(self, names: list[bytes], scores: list[float] | None = None, arcs: MergeArcs | None = None):
        keep = arcs.alive(names) if arcs else [i for i, n in enumerate(names) if n]
        self.trie = DoubleArrayTrie({names[i]: i for i in keep})
        self.scores, self.arcs = scores, arcs
        self._known = _Counts(self)

    @classmethod
    def of_merges(cls, path: str) -> CountLattice:
        names, merges = read_vocabulary(path)
        return cls(names, arcs=MergeArcs(len(names), merges))

    def count(self, segment: str) -> int:
        return self._known[segment]

    def _count(self, segment: str) -> int:
        data = segment.encode("utf-8", "replace")
        return self._by_merges(data) if self.arcs else self._by_scores(data)

    def _by_merges(self, data: bytes) -> int:
        n = len(data)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        known, size, follows, room = self.arcs.known, self.arcs.size, self.arcs.follows, len(self.trie.check)
        for at in range(n):
            before, node, end = last[at] * size, 0, at
            while end < n:
                nxt = base[node] + data[end]
                if nxt >= room or check[nxt] != node or nxt == 0:
                    break
                node, end = nxt, end + 1
                label = value[node]
                if label >= 0 and last[end] < 0:
                    if at == 0 or (known[before + label] if before + label in known else follows(last[at], label)):
                        counts[end], last[end] = counts[at] + 1, label
        return counts[n]

    def _by_scores(self, data: bytes) -> int:
        scores, unknown = self.scores, min(self.scores) - 10.0
        best: list[tuple[float, int]] = [(0.0, 0)] + [(float("-inf"), 0)] * len(data)
        for at in range(len(data)):
            score, n = best[at]
            single = False
            for end, label in self.trie.starts(data, at):
                single |= end == at + 1
                best[end] = max(best[end], (score + scores[label], n - 1))
            if not single:
                best[at + 1] = max(best[at + 1], (score + unknown, n - 1))
        return -best[-1][1]

    def count_text(self, text: str | None) -> int:
        return sum(map(self._known.__getitem__, split_words(text))) if text else 0


class _Counts(dict):
    """Segment -> count; emptied when it holds too much. It travels to the workers empty."""

    def __init__(self, lattice: CountLattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, segment: str) -> int:
        found = self.lattice._count(segment)
        if len(segment) <= _CACHE_CHARS:
            if len(self) > _CACHE_LIMIT:
                self.clear()
            self[segment] = found
        return found

    def __reduce__(self):
        return _Counts, (self.lattice,)
