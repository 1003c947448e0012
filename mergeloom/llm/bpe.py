"""BPE by a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton whose
arcs are tokens.  It begins with one state and an arc for every letter; the
gadget for a merge u + v -> w changes it so that what it accepts is what the
merge makes of it: the state that u leads to loses its arc v, a new state for w
is a copy of the state that v led to as it was before, and every state that
still has an arc u gets an arc w.  A state is kept as the arcs cut from it: its
own, and the first so many of the state that it is a copy of.  Once all merges
are in, the automaton is tabulated: a row of bits for each state, a column for
each token, equal rows and equal columns once.  Exactly one path of the result
spells a word: its BPE encoding.

Pre-split words are encoded many at a time by two tables: a trie of the tokens'
letters says which tokens begin at each letter, and the transition table which
of them the state reached there has an arc for.  A prefix has one path at most,
so each place of a word has one state.  Decoding emits arc labels.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.llm.text import RollingHash, buffers, gather, trim, trimmed

NEVER = 1 << 30
#: What a code point is to the pre-split.
SPACES, LETTER, DIGIT, MARK, SPECIAL = range(5)
#: Ids that are decoded at a time.
DECODED = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints in Latin-1, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    extra = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(extra)) for b in range(256)]


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of a power of two slots, half of them free or more: each key at its slot or the next free one; -1 where there is none."""
    size = 1 << (2 * len(keys)).bit_length()
    held, value = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
    left, slot = np.arange(len(keys)), _slot(keys, size)
    while len(left):
        free = held[slot] < 0
        at, first = np.unique(slot[free], return_index=True)
        placed = np.flatnonzero(free)[first]
        held[at], value[at] = keys[left[placed]], values[left[placed]]
        stay = np.ones(len(left), bool)
        stay[placed] = False
        left, slot = left[stay], slot[stay] + 1 & size - 1
    return held, value


def _by_small(keys: np.ndarray) -> np.ndarray:
    """A stable order of small non-negative numbers; 16 bits sort in linear time."""
    return np.argsort(keys.astype(np.uint16) if keys.max(initial=0) < 1 << 16 else keys, kind="stable")


class TokenAutomaton:
    """The automaton of a vocabulary and its merges: letters, trie, states and transition bits, all in arrays.

    Letters are one character each, with the suffix at the end of a word; every
    other token must come from one merge.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.label = {i: s for s, i in vocab.items()}
        made = [left + right for left, right in merges]
        if len(set(made)) < len(made):
            raise ValueError("two merges make one token")
        letters = sorted(set(vocab) - set(made))
        if any(len(s.removesuffix(suffix) or s) > 1 for s in letters):
            raise ValueError("a token of several letters has no merge")
        self._construct(vocab, merges, letters)
        self._spell(letters)
        self._tabulate()
        trim()

    # ---- the merge gadgets ----

    def _construct(self, vocab: dict[str, int], merges: list[tuple[str, str]], letters: list[str]) -> None:
        #: (id, is the end of a word, merge, left part, right part) of each token that an arc has, in the order they come to be
        self.tokens = [(vocab[s], bool(self.suffix) and s.endswith(self.suffix), -1, -1, -1) for s in letters]
        number = {s: t for t, s in enumerate(letters)}
        cuts: list[list[tuple[int, int]]] = [[] for _ in letters]  # of each state: (token, merge), its own
        cut: dict[tuple[int, int], int] = {}
        copied: list[tuple[int, int]] = [(-1, 0)] * len(letters)  # of each state: which it is a copy of, and of how many own cuts

        def has_arc(state: int, token: int) -> bool:
            """Now.  The arc of a made token stands for that of its left part when the merge came."""
            while True:
                left, upto = token, NEVER
                while True:
                    at = cut.get((state, left))
                    if at is not None and at < bound and at <= upto:
                        return False
                    if self.tokens[left][2] < 0:
                        break
                    upto = min(upto, self.tokens[left][2])
                    left = self.tokens[left][3]
                return True

        for k, (left, right) in enumerate(merges):
            u, v = number.get(left), number.get(right)
            if u is None or v is None:
                continue
            # The arc is there unless the state of u, or one that it is a copy of, has lost it.
            state, bound, there = u, NEVER, True
            while there and state >= 0:
                there = has_arc(state, v)
                bound = min(bound, self.tokens[state][2]) if self.tokens[state][2] >= 0 else bound
                state = copied[state][0]
            if not there:
                continue  # nothing can be merged: no path has u before v
            w = number[left + right] = len(self.tokens)
            self.tokens.append((vocab[left + right], self.tokens[v][1], k, u, v))
            cuts.append([])
            copied.append((v, len(cuts[v])))
            cuts[u].append((v, k))
            cut[u, v] = k
        self._cuts, self._copied = cuts, copied

    def _tabulate(self) -> None:
        """state_of and column_of each token, and bits[state, column]: the transitions, equal rows and columns once.

        Row by row: an arc w exists where the arc u outlived the merge to w, so
        all rows follow their cuts in the order of the tokens' left depth.
        """
        n = len(self.tokens)
        made = np.array([t[2] for t in self.tokens])
        left = np.array([t[3] for t in self.tokens])
        final = np.array([t[1] for t in self.tokens], bool)
        depth = np.zeros(n, np.int64)
        for t in range(n):
            if left[t] >= 0:
                depth[t] = depth[left[t]] + 1
        order = np.argsort(depth, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        level = np.searchsorted(depth[order], np.arange(int(depth.max()) + 2))
        made_in, left_in = made[order], np.where(left[order] >= 0, place[left[order]], -1)
        rows = np.flatnonzero(~final)  # nothing follows the end of a word
        cuts = [(place[[v for v, _ in own]], np.array([k for _, k in own], np.int32)) if own else None for own in self._cuts]
        packed, known, same, state_of_row = [], {}, {}, np.empty(len(rows), np.int64)
        for r, t in enumerate(rows):
            state, most = int(t), len(self._cuts[t])
            while not most and state >= 0:
                state, most = self._copied[state]
            if (state, most) not in known:
                lost = np.full(n, NEVER, np.int32)  # when each arc is lost; -1 for one that never was
                above, upto = state, most
                while above >= 0:
                    if upto:
                        token, when = cuts[above][0][:upto], cuts[above][1][:upto]
                        lost[token] = np.minimum(lost[token], when)
                    above, upto = self._copied[above]
                for a, b in zip(level[1:-1], level[2:]):
                    lost[a:b][lost[left_in[a:b]] <= made_in[a:b]] = -1
                row = np.packbits(lost == NEVER)
                key = row.tobytes()
                if key not in same:
                    same[key] = len(packed)
                    packed.append(row)
                known[state, most] = same[key]
            state_of_row[r] = known[state, most]
        packed = np.stack(packed)
        del same, known
        column, one, seen = np.empty(n, np.int32), [], {}
        for a in range(0, n, 1 << 10):  # some tokens at a time
            bits = np.unpackbits(packed[:, a >> 3 : (a >> 3) + (1 << 7)], axis=1)[:, : n - a]
            for i, key in enumerate(map(bytes, np.packbits(bits, axis=0).T.copy())):
                if key not in seen:
                    seen[key] = len(seen)
                    one.append(a + i)
                column[order[a + i]] = seen[key]
        #: The first row is of the first state, which has all arcs; the last of the end, which has none.
        self.bits = np.zeros((len(packed) + 2, -(-len(one) // 8)), np.uint8)
        self.bits[0] = 255
        for a in range(0, len(packed), 1 << 8):
            self.bits[a + 1 : a + 1 + (1 << 8)][: len(packed) - a] = np.packbits(np.unpackbits(packed[a : a + (1 << 8)], axis=1)[:, one], axis=1)
        self.state_of = np.full(n, len(self.bits) - 1, np.int32)
        self.state_of[rows] = state_of_row + 1
        self.column_of = column
        self.id_of = np.array([t[0] for t in self.tokens], np.int32)
        del self._cuts, self._copied, self.tokens

    def _spell(self, letters: list[str]) -> None:
        """The trie: hashed keys (node, letter), the child of each, and the token that ends at each node."""
        self.letter = {s: i for i, s in enumerate(letters)}
        child: dict[int, int] = {}
        token_at = [-1]
        self.width = len(letters) + 1
        spelled: list[tuple[int, ...]] = []
        for t, (_, _, merge, u, v) in enumerate(self.tokens):
            spelled.append((t,) if merge < 0 else spelled[u] + spelled[v])
            node = 0
            for x in spelled[-1]:
                key = node * self.width + x
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = t
        keys = np.fromiter(child.keys(), np.int64, len(child))
        self.keys, self.child = _hashed(keys, np.fromiter(child.values(), np.int32, len(child)))
        self.token_at = np.array(token_at, np.int32)
        self.inner = np.zeros(len(token_at), bool)
        self.inner[keys // self.width] = True
        self.first_node = np.array([child.get(x, -1) for x in range(self.width)])

    # ---- words to paths ----

    def _children(self, key: np.ndarray) -> np.ndarray:
        """The child at each key, -1 if there is none."""
        slot = _slot(key, len(self.keys))
        held = self.keys[slot]
        out = np.where(held == key, self.child[slot], -1)
        left = np.flatnonzero((held != key) & (held >= 0))  # another key took the slot
        slot = slot[left]
        while len(left):
            slot = slot + 1 & len(self.keys) - 1
            held = self.keys[slot]
            hit = held == key[left]
            out[left[hit]] = self.child[slot[hit]]
            on = ~hit & (held >= 0)
            left, slot = left[on], slot[on]
        return out

    def paths(self, letters: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the paths of many words, one after another, and where each begins.

        letters: of all words, with the last of each as at the end of a word;
        word i is offsets[i] to offsets[i + 1], none empty.
        """
        n = np.diff(offsets)
        if not len(n):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        word = np.repeat(np.arange(len(n)), n)
        # Which tokens begin at each letter.
        at = np.arange(len(letters))
        left = (np.repeat(offsets[1:], n) - at).astype(np.int32)
        node = self.first_node[letters]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        long = 1
        while len(at):
            token = self.token_at[node]
            hit = np.flatnonzero((token >= 0) & (node >= 0))
            found.append((at[hit], token[hit], np.full(len(hit), long, np.int32)))
            on = np.flatnonzero((left[at] > long) & (node >= 0) & self.inner[node])
            at, node = at[on], node[on]
            node = self._children(node.astype(np.int64) * self.width + letters[at + long])
            same = np.flatnonzero(node >= 0)
            at, node = at[same], node[same]
            long += 1
        begin, token, length = (np.concatenate(part) for part in zip(*found))
        place = begin - offsets[:-1][word[begin]]
        order = _by_small(place)
        begin, token, length, place = begin[order], token[order], length[order], place[order]
        # All words go on from their i-th place together; a word of n letters has n + 1 places.
        spot = begin + word[begin]
        state = np.full(len(letters) + len(n), -1, np.int32)
        state[offsets[:-1] + np.arange(len(n))] = 0
        came = np.full(len(letters) + len(n), -1, np.int32)
        column, reached = self.column_of[token], self.state_of[token]
        cuts = np.searchsorted(place, np.arange(int(n.max()) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            here = state[spot[a:b]]
            arc = self.bits[here, column[a:b] >> 3] >> (7 - (column[a:b] & 7)) & 1
            ok = np.flatnonzero((here >= 0) & (arc > 0)) + a
            to = spot[ok] + length[ok]
            state[to], came[to] = reached[ok], token[ok]
        # Back from the ends.
        long_of = np.zeros(len(self.id_of), np.int32)
        long_of[token] = length
        spot, start = offsets[1:] + np.arange(len(n)), offsets[:-1] + np.arange(len(n))
        if (came[spot] < 0).any():
            raise ValueError("the vocabulary cannot spell a word")
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(n))
        while len(live):
            token = came[spot]
            steps.append((live, token))
            spot = spot - long_of[token]
            on = np.flatnonzero(spot > start[live])
            live, spot = live[on], spot[on]
        owner, token = (np.concatenate(part) for part in zip(*steps))
        order = _by_small(owner[::-1])
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(owner, minlength=len(n)))))
        return self.id_of[token[::-1][order]], first

    def _encode(self, word: str) -> list[int]:
        """The path of one word."""
        if not word:
            return []
        letters = [*word[:-1], word[-1] + self.suffix]
        if any(x not in self.letter for x in letters):
            raise ValueError(f"the vocabulary cannot spell {word!r}")
        return self.paths(np.array([self.letter[x] for x in letters]), np.array([0, len(letters)]))[0].tolist()


class WordTokenizer:
    """Lower-cased, pre-split text to ids and back, for vocabulary files with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        self.automaton = automaton = TokenAutomaton(model["vocab"], merges, suffix)
        letters = byte_letters()
        #: The letter of each byte, within a word and at its end.
        self.inside = np.array([automaton.letter[x] for x in letters])
        self.at_end = np.array([automaton.letter[x + suffix] for x in letters])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = automaton.label | {i: s for s, i in self.special.items()}
        size = max(labels) + 1
        written = [labels.get(i, "").encode() for i in range(size)]
        self.known = np.array([i in labels for i in range(size)])
        #: The arcs' labels, one after another.
        self.labels = np.frombuffer(b"".join(written), np.uint8)
        self.label_at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in written])))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        *self.contractions, letter, digit, mark = split.split("|")
        if (letter, digit, mark) != (r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+") or not all(c[0] == "'" and c[1:].isalpha() for c in self.contractions):
            raise ValueError("the file splits words by another rule")
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
        self.kind = np.full(0x110001, SPACES, np.uint8)
        self.kind[0x110000] = SPECIAL
        for k, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (MARK, r"[^\s\p{L}\p{N}]+")):
            for m in regex.finditer(pattern, every):
                self.kind[m.start() : m.end()] = k

    def _plain(self, text: str) -> str:
        """Normalized and in lower case."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Letter by letter, for a final sigma has no form of its own here.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def _pieces(self, points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of the pre-split begin and end; none goes over an edge."""
        kind = self.kind[points]
        starts = np.ones(len(points) + 1, bool)
        starts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == SPECIAL)
        starts[edge] = True
        # A contraction begins where a run of marks does: its mark is alone, and the letters after it are parted.
        end_of = np.repeat(np.flatnonzero(starts)[1:], np.diff(np.flatnonzero(starts)))
        quote = np.flatnonzero((points == 39) & starts[:-1] & starts[1:])
        taken = np.zeros(len(quote), bool)
        joined = np.zeros(len(points) + 1, bool)
        for letters in self.contractions:
            tail = np.frombuffer(letters[1:].encode("utf-32-le"), np.uint32)
            fits = ~taken
            for i, x in enumerate(tail, 1):
                inside = quote + i < len(points)
                at = np.minimum(quote + i, len(points) - 1)
                # Within the letters that follow the mark, and not over an edge.
                fits &= inside & (points[at] == x) & (end_of[np.minimum(quote + 1, len(points) - 1)] > at)
            fits &= ~np.isin(quote + 1, edge)
            taken |= fits
            joined[quote[fits] + 1] = True
            starts[np.minimum(quote[fits] + 1 + len(tail), len(points))] = True
        starts &= ~joined
        begin = np.flatnonzero(starts)
        begin, end = begin[:-1], begin[1:]
        kept = kind[begin] != SPACES
        return begin[kept], end[kept]

    def encode_texts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        parts: list[str] = []
        owner: list[int] = []  # of each part
        specials: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.marks and "<|" in text:
                for part in self.marks.split(text):
                    if part in self.special:
                        parts.append("\0")
                        specials.append(self.special[part])
                        owner.append(~i)
                    elif part:
                        parts.append(self._plain(part))
                        owner.append(i)
            else:
                parts.append(self._plain(text))
                owner.append(i)
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        whole = "".join(parts)
        part_at = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in parts])))
        who = np.array(owner)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        data = np.frombuffer(whole.encode(), np.uint8)
        if len(data) == len(points):
            byte_at = np.arange(len(points) + 1)
        else:
            byte_at = np.concatenate((np.zeros(1, np.int64), np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))))
        marked = part_at[:-1][who < 0]
        points[marked] = 0x110000
        begin, end = self._pieces(points, part_at)
        which_part = np.searchsorted(part_at, begin, side="right") - 1
        text_of = np.where(who < 0, ~who, who)[which_part]
        is_special = who[which_part] < 0
        start, stop = byte_at[begin], byte_at[end]
        plain = np.flatnonzero(~is_special)
        _, one, which = np.unique(RollingHash(data)(start[plain], stop[plain]), return_index=True, return_inverse=True)
        word, offsets = gather(data, start[plain[one]], stop[plain[one]])
        letters = self.inside[word]
        last = offsets[1:] - 1
        letters[last] = self.at_end[word[last]]
        ids, first = self.automaton.paths(letters, offsets)
        ids = np.concatenate((ids, np.array(specials, np.int32)))
        first = np.concatenate((first[:-1], np.arange(first[-1], first[-1] + len(specials) + 1)))
        piece = np.empty(len(begin), np.int64)
        piece[plain] = which
        piece[is_special] = len(one) + np.arange(len(specials))
        n = first[piece + 1] - first[piece]
        cut = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        flat = ids[np.repeat(first[piece] - cut[:-1], n) + np.arange(cut[-1])]
        return flat, cut[np.searchsorted(text_of, np.arange(len(texts) + 1))]

    def decode_ids(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """Of each list of ids the labels, with a space between; ids that the vocabulary lacks have none."""
        sound = (ids >= 0) & (ids < len(self.known))
        sound[sound] = self.known[ids[sound]]
        if not sound.all():
            upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(sound)))
            ids, first = ids[sound], upto[first]
        length = np.diff(self.label_at)[ids] + 1
        end = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
        parts = []
        last = np.zeros(len(ids), bool)  # of a list, without a space
        last[first[1:][first[1:] > first[:-1]] - 1] = True
        for i in range(0, len(ids), DECODED):
            some = ids[i : i + DECODED]
            out, at = gather(self.labels, self.label_at[some], self.label_at[some + 1], after=b" ")
            stay = np.ones(len(out), bool)
            stay[at[1:][last[i : i + DECODED]] - 1] = False
            parts.append(out[stay])
        offsets = end[first] - np.concatenate((np.zeros(1, np.int64), np.cumsum(first[1:] > first[:-1])))
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(np.array(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def _compiled(docs: DataFrame, path: str):
    """The tokenizer as a broadcast; its size is the vocabulary's, whatever the corpus.  One for each application and file; the driver keeps none."""
    context = docs.sparkSession.sparkContext
    held = _sent.get(path)
    if held is None or held[0] != context.applicationId:
        held = _sent[path] = (context.applicationId, context.broadcast(_loaded.get(path) or WordTokenizer(path)))
        trim()
    return held[1]


_sent: dict = {}


def encode_documents(docs: DataFrame, path: str, decoded: bool = False, most_bytes: int = 1 << 20) -> DataFrame:
    """docs with token_ids (array of int), and decoded if asked for, added; columns so named are replaced.

    A null or empty text has no tokens and decodes to "".  Repeated rows and
    other columns pass as they are; an empty table gives an empty table.  Whole
    texts are encoded, of any length: runs of texts of about ``most_bytes``
    are encoded together, a longer one by itself.  Words count as equal if their
    64-bit hashes within such a run are.
    """
    base = docs.drop("token_ids", "decoded")
    at = base.columns.index("text")
    schema = T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add("decoded", T.StringType())
    names, model = schema.names, _compiled(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for rows in byte_runs(batch, at, most_bytes):
                ids, first = own.encode_texts(rows.column(at).to_pylist())
                columns = [*rows.columns, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids))]
                if decoded:
                    columns.append(own.decode_ids(ids, first).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return base.mapInArrow(trimmed(run), schema)


def byte_runs(batch: pa.RecordBatch, at: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts have about most_bytes, or one row."""
    offsets, _ = buffers(batch.column(at))
    i = 0
    while i < batch.num_rows:
        j = min(batch.num_rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1))
        yield batch.slice(i, j - i)
        i = j


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with decoded, the labels of token_ids, added; null ids decode to ""."""
    base = encoded.drop("decoded")
    at = base.columns.index("token_ids")
    schema = T.StructType([*base.schema.fields, T.StructField("decoded", T.StringType())])
    names, model = schema.names, _compiled(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                lists = rows.column(at).fill_null([])
                first = np.concatenate((np.zeros(1, np.int64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, own.decode_ids(ids, first).cast(pa.string())], names)

    return base.mapInArrow(trimmed(run), schema)


def bpe_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode_documents(docs.select("doc_id", "text"), path, decoded=True)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
