"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by the labels of its arcs.

The automaton reads token sequences and accepts those that the merges make of some text. It starts as one state with
an arc for each byte. A merge (u, v) of w adds an arc w beside each arc u after which v may be read, to where v leads;
then the state behind u is copied and the copy loses v, so that u and v never follow each other again. All arcs of a token
lead to one state, and a merge takes one arc, with what is later built on it, away from one copied state: the lost
arcs of a state are intervals of tokens, numbered so that what starts with a token follows it.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Words that a task remembers, and the bytes of the longest of them.
MEMO, MEMO_BYTES = 400_000, 64


class Words(dict):
    """A word's ids as unsigned 32-bit numbers, little end first; short words are remembered, a bounded number."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        found = array("I", self.automaton.word(data)).tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


class Automaton:
    """Tokens of words, bytes by their labels. ``labels`` are the tokens' bytes by id, ``merges`` pairs of ids and what
    each makes, in the order in which they apply."""

    def __init__(self, labels: dict[int, bytes], merges: Sequence[tuple[int, int, int]]):
        self.labels = labels
        made = {w for _, _, w in merges}
        known = {t for t in labels if t not in made}
        if len(made) < len(merges) or any(len(labels[t]) != 1 for t in known) or len(known) != 256:
            raise ValueError("the automaton starts from the 256 bytes, and each merge makes a token of its own")
        #: Of a merged token: when it was made, its left and its right part. A pair of parts: when it was merged.
        self._born, self._first, self._second, self._taken = {}, {}, {}, {}
        lost: dict[int, list[tuple[int, int]]] = {}
        live = set(known)
        for i, (u, v, w) in enumerate(merges):
            if u not in known or v not in known:
                raise ValueError("a merge takes parts that earlier merges made")
            known.add(w)
            if labels[w] != labels[u] + labels[v]:
                raise ValueError("a merged token has the bytes of its parts")
            if u in live and v in live and self._follows(u, v, i):
                live.add(w)
                self._born[w], self._first[w], self._second[w] = i, u, v
                self._taken[u, v] = i
                lost.setdefault(u, []).append((i, v))
        self._number(live)
        self._flatten(live, lost)
        self._open()

    def _spine(self, token: int, parts: dict[int, int], now: int) -> Iterator[tuple[int, int]]:
        """A token and its outer parts on one side, each with the time until which it looks back."""
        yield token, now
        while token in parts:
            now = self._born[token]
            token = parts[token]
            yield token, now

    def _follows(self, a: int, b: int, now: int) -> bool:
        """Whether b may be read after a: no merge took the arc, or one that it was built on, by when it was built. A merge of
        a token with itself takes the arc of what it makes at once."""
        left = list(self._spine(b, self._first, now))
        for r, since in self._spine(a, self._second, now):
            for x, until in left:
                taken = self._taken.get((r, x), now)
                if taken < since and taken <= until:
                    return False
        return True

    def _number(self, live: set[int]) -> None:
        """Numbers of tokens: one before all that start with it, the youngest of those first."""
        starts: dict[int, list[int]] = {}
        for t in sorted((t for t in live if t in self._born), key=self._born.get, reverse=True):
            starts.setdefault(self._first[t], []).append(t)
        self._place, self._end, n = {}, {}, 0
        stack = [(t, False) for t in sorted((t for t in live if t not in self._born), reverse=True)]
        while stack:
            t, done = stack.pop()
            if done:
                self._end[t] = n
                continue
            self._place[t] = n
            n += 1
            stack.append((t, True))
            stack.extend((x, False) for x in reversed(starts.get(t, ())))
        self._starts = starts

    def _interval(self, since: int, token: int) -> tuple[int, int]:
        """Numbers of a token, and of what was built on it from a time on."""
        built = self._starts.get(token, [])
        k = bisect_right(built, -since, key=lambda t: -self._born[t])
        return self._place[token], self._place[built[k]] if k < len(built) else self._end[token]

    def _flatten(self, live: set[int], lost: dict[int, list[tuple[int, int]]]) -> None:
        """The bounds of a state's lost arcs, sorted: an arc is lost if an odd number of them doesn't exceed it. Tokens
        whose arcs lead to one state share it."""
        states, spans = {}, [[]]

        def state(token: int, now: int) -> int:
            """Where a token's arcs lead at a time: what its right part led to when it was made, less what was lost since."""
            own = lost.get(token, [])
            k = bisect_left(own, (now, -1))
            base = state(self._second[token], self._born[token]) if token in self._second else 0
            if not k:
                return base
            if (token, k) not in states:
                found = sorted([*zip(spans[base][::2], spans[base][1::2], strict=True), *(self._interval(i, v) for i, v in own[:k])])
                out: list[int] = []
                for low, high in found:
                    if out and low <= out[-1]:
                        out[-1] = max(high, out[-1])
                    else:
                        out += low, high
                states[token, k] = len(spans)
                spans.append(out)
            return states[token, k]

        self.ids = sorted(live, key=self._place.get)
        self.lead = array("i", [state(t, 1 << 60) for t in self.ids])
        self.bounds = [array("i", s) for s in spans]

    def _open(self) -> None:
        """What encoding walks: bytes of the tokens as nested transitions, each with the lengths and numbers of the tokens
        that end on the way there at 256, longest first; and the state after each token."""
        self._root, self.words = {256: ()}, Words(self)
        self._longest = max(map(len, self.labels.values()))
        by_length = sorted(range(len(self.ids)), key=lambda place: len(self.labels[self.ids[place]]))
        for place in by_length:
            node, label = self._root, self.labels[self.ids[place]]
            for b in label:
                node = node.setdefault(b, {256: node[256]})
            node[256] = ((len(label), place), *node[256])
        states = [b.tolist() for b in self.bounds]
        self._after = [states[s] for s in self.lead]

    def word(self, data: bytes) -> list[int]:
        """The only path whose labels are these bytes: longest arcs first, back where none fits. A prefix has one path
        at most, so no place is reached twice and the steps grow with the word."""
        n, root, after, longest = len(data), self._root, self._after, self._longest
        at, lost, path, choices, reached = 0, [], [], [], bytearray(n + 1)
        while at < n:
            node = root
            for b in data[at : at + longest]:
                below = node.get(b)
                if below is None:
                    break
                node = below
            arcs = iter(node[256])
            while True:
                for size, t in arcs:
                    if not reached[at + size] and not bisect_right(lost, t) & 1:
                        break
                else:
                    path.pop()
                    at, lost, arcs = choices.pop()
                    continue
                break
            choices.append((at, lost, arcs))
            at += size
            reached[at] = 1
            path.append(t)
            lost = after[t]
        return [self.ids[t] for t in path]

    def emit(self, ids: Sequence[int]) -> bytes:
        """The bytes along a path: the label of each arc."""
        return b"".join(map(self.labels.__getitem__, ids))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("labels", "ids", "lead", "bounds")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()


class Splitter:
    """Words of a text as the vocabulary's library cuts them; special tokens stand apart, with their ids.

    ``rule`` is the pattern of words. ``stands_for`` names, for characters that the library and the ``regex`` package put
    into different classes (their Unicode versions differ), one that both put where the library has it.
    """

    def __init__(self, rule: str, special: dict[str, int], stands_for: dict[str, str]):
        self.__setstate__({"rule": rule, "special": special, "stands_for": stands_for})

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("rule", "special", "stands_for")}

    def __setstate__(self, state: dict) -> None:
        import regex

        self.__dict__.update(state)
        self._find = regex.compile(self.rule)
        near, far = ([c for c in self.stands_for if (c > "￿") is side] for side in (False, True))
        self._near = re.compile(f"[{''.join(map(re.escape, near))}]") if near else None
        self._far, self._beyond = set(far), re.compile("[\U00010000-\U0010ffff]")
        self._table = str.maketrans(self.stands_for)
        apart = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, apart))) if apart else None

    def parts(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Words up to each special token, and that token's id; after the last words there is none."""
        at = 0
        for m in self._special.finditer(text) if self._special else ():
            yield self.words(text[at : m.start()]), self.special[m[0]]
            at = m.end()
        yield self.words(text[at:] if at else text), None

    def words(self, text: str) -> list[str]:
        if not text.isascii() and (self._near and self._near.search(text) or self._far and not self._far.isdisjoint(self._beyond.findall(text))):
            return [text[slice(*m.span())] for m in self._find.finditer(text.translate(self._table))]
        return self._find.findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in a byte-level vocabulary: visible Latin-1 characters
    for themselves, the others, in order, from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def stand_ins(split: Callable[[str], list[tuple[int, int]]]) -> dict[str, str]:
    """Characters that ``split``, which gives the spans of words, puts into another class than ``regex``, and a letter, digit or sign for each.

    Only those are asked for that ``regex`` and Python's own tables tell apart, or don't know: Unicode versions differ in
    nothing else.
    """
    import unicodedata

    import regex

    kinds = [regex.compile(k) for k in (r"\p{L}", r"\p{N}")]
    kind = lambda c: 0 if kinds[0].match(c) else 1 if kinds[1].match(c) else 2
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    asked = [c for c in chars if kind(c) != "LN".find(unicodedata.category(c)[0]) % 3]
    sides = []
    for mark, other in (("ж", "1"), ("1", "ж")):
        cuts = {a for a, _ in split("".join(f"{mark}{c}{mark}{other}" for c in asked))}
        sides.append([4 * i + 1 not in cuts for i in range(len(asked))])
    theirs = [0 if letter else 1 if number else 2 for letter, number in zip(*sides, strict=True)]
    return {c: "ж1§"[k] for c, k in zip(asked, theirs, strict=True) if k != kind(c)}


def load(path: str) -> tuple[Automaton, Splitter]:
    """The automaton and the splitter of a byte-level vocabulary file; a file with other rules is refused."""
    import public_tokenizers
    import tokenizers

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
    if not plain or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("the automaton takes byte-level vocabularies without normaliser, prefix space or dropout")
    byte, ids = byte_alphabet(), model["vocab"]
    labels = {i: bytes(map(byte.__getitem__, t)) for t, i in ids.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    found = Automaton({i: t for i, t in labels.items() if i not in special.values()}, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
    found.labels |= {i: t.encode() for t, i in special.items()}
    library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return found, Splitter(public_tokenizers.PATTERN, special, stand_ins(lambda text: [span for _, span in library.pre_tokenize_str(text)]))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
PIECES = "ids array<int>, decoded string"


def encode(docs: DataFrame, automaton: Automaton, splitter: Splitter, *keys: str, digests: bool = False) -> DataFrame:
    """Ids of whole texts, and the text that the labels of their arcs spell.

    Returns the key columns with ``ids`` and ``decoded``, or with ``digests`` their number and SHA-256 digests in
    place of them, that of the ids over unsigned 32-bit numbers, little end first. Null and empty texts have no ids
    and decode to an empty text. Repeated rows and null keys give one row each. Other columns are left out,
    so their names can't clash. Rows stay where they are: no shuffle. A text takes memory in proportion to its size,
    what a task remembers of words is bounded; results don't depend on it.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((automaton, splitter))  # a vocabulary: its size doesn't depend on the data

    def start() -> Callable:
        machine, rule = shipped.value

        def one(text: str) -> tuple:
            found = []
            for words, special in rule.parts(text):
                found.extend(map(machine.words.__getitem__, words))
                if special is not None:
                    found.append(special.to_bytes(4, "little"))
            packed = b"".join(found)
            ids = np.frombuffer(packed, "<u4")
            decoded = machine.emit(ids.tolist()).decode(errors="replace")
            if digests:
                return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
            return ids.astype(np.int32), decoded

        return lambda batch: zip(*map(one, batch.column("text").to_pylist()), strict=True)

    return common.map_columns(common.texts(docs, *keys), DIGESTS if digests else PIECES, start, list(keys))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded; one row per document."""
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), *load(public_tokenizers.path("byte_bpe_50k.json")), "doc_id", digests=True)
