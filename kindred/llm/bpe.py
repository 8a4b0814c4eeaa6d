"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The encoding of any prefix of a piece ends in exactly one token, and a
sequence of tokens is the encoding of its bytes exactly if every two
neighbours would be left apart when encoded alone (Berglund and van der
Merwe, "Formalizing BPE Tokenization", 2023). So an automaton that reads a
byte at a time only has to carry the tokens that may still be in progress:
their places in the trie of tokens. Each arc says which tokens may end at
the byte read. The one that does, if the piece ended there, is the one that
stays apart from the token that ends where it starts; the automaton keeps
what ended at the bytes not yet emitted, and does not carry it in its
states, so that it has no more of them than the trie has places. A token is
certain, and is emitted, once all tokens in progress follow from it; as none
is longer than the longest token, the lookahead is bounded by that. States
and arcs are made when first needed and kept until there are too many.
"""

from __future__ import annotations

import base64
import gc
import json
import re
from functools import lru_cache
from struct import Struct

import numpy as np
import regex

#: Splits text before the merges apply. Fixed value (the public pattern of this vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_STATES = 100_000
MAX_MEMO = 600_000
MEMO_CHARS = 64
NEVER = 1 << 40
#: A run of white space and what follows. A piece of PATTERN never spans the start of one.
CHUNK = re.compile(r"\s*\S+|\s+")
#: ids whose bytes are gathered at once: at 8 bytes a place, 8 MB where all are of 128 bytes
GATHER = 8192
PACK = [Struct(f"<{n}I").pack for n in range(33)]


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a .tiktoken rank file or a tokenizers .json of a byte-level BPE."""
    with open(path, "rb") as f:
        data = f.read()
    if not path.endswith(".json"):
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    spec = json.loads(data)
    added = {x["content"] for x in spec.get("added_tokens", ())}
    to_byte = {chr(c): b for b, c in enumerate(_printable())}
    return {bytes(to_byte[ch] for ch in t): i for t, i in spec["model"]["vocab"].items() if t not in added}


def _printable() -> list[int]:
    """The character that stands for each byte in .json vocabularies: itself if visible in Latin-1, else the next free one from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(b)
        else:
            out.append(free)
            free += 1
    return out


def merge(ranks: dict[bytes, int], piece: bytes, least: int = 1) -> list[int]:
    """The plain rule: join the leftmost pair of least rank until none, or only `least` parts, are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
    while len(pairs) >= least:
        best = min(pairs)
        if best == NEVER:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NEVER)
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one piece. The automaton is shared by all pieces.

    A state is a dict of the arcs known so far: byte -> (state, tokens that
    may end there); at LIST it has the trie node of each token in progress,
    longest first, the last is the root. Tokens that may end are those of two
    bytes and more, longest first, as (what `apart` knows of it, bytes,
    token), and the token of the byte itself, which ends if none of them does.
    """

    LIST = -1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = [0] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.length[i] = len(t)
        #: no token is longer, so what is certain lags behind the bytes read by at most two of these
        self.lookahead = 2 * max(self.length, default=1)
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        inner = set()
        for t, i in ranks.items():
            node = 0
            for c in t:
                k = node << 8 | c
                nxt = self.child.get(k)
                if nxt is None:
                    nxt = self.child[k] = len(self.token_at)
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    inner.add(node)
                node = nxt
            self.token_at[node] = i
        self.goes_on = [n in inner for n in range(len(self.token_at))]
        self._apart: list[dict[int, bool]] = [{} for _ in self.length]  # for each token: token before it -> apart
        self._n_apart = 0
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.start: dict = {self.LIST: (0,)}
        self.states: dict[int, dict] = {0: self.start}  # by the node of the longest token in progress: the others' nodes are its suffixes

    def halves(self, t: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins (itself twice for a byte); None if its bytes aren't encoded as it."""
        if t not in self._halves:
            x = self.bytes_of[t]
            got = None
            if len(x) == 1:
                got = (t, t)
            elif len(two := merge(self.ranks, x, 2)) == 2:
                got = (two[0], two[1])
            self._halves[t] = got
        return self._halves[t]

    def apart(self, a: int, b: int) -> bool:
        """Whether token b stays as it is after token a (a = -1: at the start).

        A merge across the border would join a suffix of a, as its merges
        leave it at that time, to a prefix of b. Undoing the merges of both
        from the last on gives the suffix and prefix that meet at any time; a
        joint token made before the merge undone would have come first.
        """
        if self._n_apart > 8 * MAX_STATES:
            for known in self._apart:
                known.clear()
            self._n_apart = 0
        ok = self.halves(b) is not None
        if ok and a >= 0:
            bytes_of, get, halves = self.bytes_of, self.ranks.get, self.halves
            x, y, before = a, b, NEVER
            while True:
                if get(bytes_of[x] + bytes_of[y], NEVER) < before:
                    ok = False
                    break
                one = len(bytes_of[x]) > 1, len(bytes_of[y]) > 1
                if not any(one):
                    break
                # the later merge is undone first; of equal ones the left came first
                if one[0] and (x > y or not one[1]):
                    before, x = x, halves(x)[1]
                else:
                    before, y = y + 1, halves(y)[0]
        self._apart[b][a] = ok
        self._n_apart += 1
        return ok

    def _arc(self, s: dict, c: int) -> tuple[dict, tuple]:
        new, may, byte = [], [], -1
        for node in s[self.LIST]:
            nxt = self.child.get(node << 8 | c)
            if nxt is not None:
                if self.goes_on[nxt]:
                    new.append(nxt)
                if (t := self.token_at[nxt]) >= 0:
                    if node:
                        may.append((self._apart[t], self.depth[nxt], t))
                    else:
                        byte = t
        new.append(0)
        state = self.states.get(new[0])
        if state is None:
            state = self.states[new[0]] = {self.LIST: tuple(new)}
        got = s[c] = (state, (tuple(may), byte))
        return got

    def _settle(self, ends: list, at: int = 0, before: int = -1) -> None:
        """Replace the tokens that may end, from place `at` on, by the one that does. before: the token before all these."""
        for i in range(at, len(ends)):
            may, ends_here = ends[i]
            for known, n, t in may:
                prev = ends[i - n] if i >= n else before
                ok = known.get(prev)
                if ok or ok is None and self.apart(prev, t):
                    ends_here = t
                    break
            ends[i] = ends_here

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        ends: list = []  # the token that ends at each byte not yet emitted
        s = self.start
        for at in range(0, len(piece), self.lookahead):
            if len(self.states) > MAX_STATES:
                nodes = s[self.LIST]
                self._forget()
                s = self.states.setdefault(nodes[0], {self.LIST: nodes})
            known = len(ends)
            for c in piece[at : at + self.lookahead]:
                got = s.get(c)
                if got is None:
                    got = self._arc(s, c)
                s, may = got
                ends.append(may)
            self._settle(ends, known, out[-1] if out else -1)
            if at + self.lookahead < len(piece):
                done = self._certain(ends, s)
                out += self._trace(ends[:done])
                del ends[:done]
        return out + self._trace(ends) if out else self._trace(ends)

    def _trace(self, ends: list[int]) -> list[int]:
        back, i, length = [], len(ends), self.length
        while i:
            t = ends[i - 1]
            back.append(t)
            i -= length[t]
        back.reverse()
        return back

    def _certain(self, ends: list, s: dict) -> int:
        """Where the tokens that all those in progress follow from end."""
        known = len(ends)
        while known and type(ends[known - 1]) is tuple:
            known -= 1
        self._settle(ends, known)
        at = {len(ends) - self.depth[x] for x in s[self.LIST]}
        while len(at) > 1:
            far = max(at)
            at.remove(far)
            at.add(far - self.length[ends[far - 1]])
        return at.pop()


class Irregular(Exception):
    """A space that goes on a run of white space, or begins a longer one."""


class Encoder(dict):
    """Ids of whole texts, as little-endian uint32 bytes. As a dict: a bounded memo from a word, with the space before it left out, to its ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine = Transducer(ranks)
        self.others: dict[str, bytes] = {}  # memo of chunks that aren't a space and a word
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.token_bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.token_bytes[i] = t
        #: bytes of all tokens in a row, and where each begins and how long it is
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.length = np.array(list(map(len, self.token_bytes)), np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.whole, self.steps = self._steps()

    def _steps(self) -> tuple[np.ndarray, list[bytes]]:
        """Which tokens are whole characters; for each state of Utf8, the state that each token leads to."""
        table = np.array([list(r) for r in Utf8.table()], np.uint8)
        to = np.repeat(np.arange(len(table), dtype=np.uint8)[:, None], len(self.length), 1)
        for at in range(int(self.length.max(initial=0))):
            has = np.flatnonzero(self.length > at)
            to[:, has] = table[to[:, has], self.flat[self.begin[has] + at]]
        return to[0] == 0, [r.tobytes() for r in to]

    def __missing__(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise Irregular
        if word.isascii() and word.isalpha():
            got = self._piece(" " + word)  # the usual case
        elif word.isascii() and word[:-1].isalpha() and word[-1] in ".,;:!?":
            got = self._piece(" " + word[:-1]) + self._piece(word[-1])
        elif len(parts := CHUNK.findall(" " + word)) > 1:
            return b"".join(map(self._chunk, parts))
        else:
            got = self._pieces(parts[0])
        if len(word) < MEMO_CHARS:
            if len(self) + len(self.others) >= MAX_MEMO:
                self.clear()
                self.others.clear()
            self[word] = got
        return got

    def _chunk(self, chunk: str) -> bytes:
        if chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace():
            return self[chunk[1:]]
        got = self.others.get(chunk)
        if got is None:
            got = self._pieces(chunk)
            if len(chunk) <= MEMO_CHARS:
                if len(self) + len(self.others) >= MAX_MEMO:
                    self.clear()
                    self.others.clear()
                self.others[chunk] = got
        return got

    def _pieces(self, chunk: str) -> bytes:
        return b"".join([self._piece(m[0]) for m in self.split.finditer(chunk)])

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            ids = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
            got = PACK[len(ids)](*ids) if len(ids) < len(PACK) else np.array(ids, dtype="<u4").tobytes()
            if len(piece) <= MEMO_CHARS:
                if len(self.pieces) >= MAX_MEMO:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, chunk by chunk. Where all spaces stand alone, they are where chunks begin, and others begin at the other white space between two of them."""
        if "  " not in text:
            first, *words = text.split(" ")
            if not first[-1:].isspace():
                try:
                    return b"".join([*map(self._chunk, CHUNK.findall(first)), *map(self.__getitem__, words)])
                except Irregular:
                    pass
        return b"".join(map(self._chunk, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        out, all_ids = [], np.frombuffer(ids, dtype="<u4")
        for i in range(0, len(all_ids), GATHER):
            ids_ = all_ids[i : i + GATHER]
            length = self.length[ids_]
            end = np.cumsum(length)
            at = np.repeat(self.begin[ids_] - end + length, length)
            at += np.arange(len(at))
            out.append(self.flat[at].tobytes())
        return b"".join(out)


class Utf8:
    """An incremental UTF-8 state machine: bytes in any cuts go in, whole characters come out.

    A table gives the next state for each state and byte. State 0 is between
    characters, BAD is after a byte that can't follow, the others say what may
    come next inside a character. Bytes that can't belong to a character come
    out as U+FFFD, as Python's decoder with errors="replace" has it.
    """

    #: lead byte range -> (continuation bytes, least and greatest next byte); from the Unicode standard, table 3-7
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    BAD = 1
    TABLE: list[bytes] = []

    @classmethod
    def table(cls) -> list[bytes]:
        """A row of 256 next states for each state; a state inside a character is (bytes to come, least and greatest next one)."""
        if not cls.TABLE:
            number = {None: 0, "bad": cls.BAD}
            rows = [bytearray([cls.BAD] * 256), bytearray([cls.BAD] * 256)]
            rows[0][:128] = bytes(128)

            def state(more: int, least: int, most: int) -> int:
                if not more:
                    return 0
                if (more, least, most) not in number:
                    k = number[more, least, most] = len(rows)
                    rows.append(bytearray([cls.BAD] * 256))
                    rows[k][least : most + 1] = bytes([state(more - 1, 0x80, 0xBF)]) * (most - least + 1)
                return number[more, least, most]

            for lo, hi, more, least, most in cls.LEADS:
                rows[0][lo : hi + 1] = bytes([state(more, least, most)]) * (hi - lo + 1)
            cls.TABLE = [bytes(r) for r in rows]
        return cls.TABLE

    def __init__(self) -> None:
        self.state, self.open = 0, b""

    def step(self, data: bytes) -> bool:
        """Go through data; whether it may go on as UTF-8."""
        table, s = self.table(), self.state
        for c in data:
            s = table[s][c]
        self.state = s
        return s != self.BAD

    def feed(self, data: bytes) -> str:
        if not self.open and not self.state and data.isascii():
            return data.decode("ascii")
        table, s, out = self.table(), self.state, []
        data, begin, at = self.open + data, 0, len(self.open)
        # begin: where the character starts whose bytes are being read; whole ones before it are in `done`
        done = 0
        while at < len(data):
            nxt = table[s][data[at]]
            if nxt == self.BAD:
                out.append(data[done:begin].decode("utf-8") + "\ufffd")
                if s == 0:
                    at += 1  # a byte that begins nothing
                done = begin = at  # what broke off inside a character is one mark, and its next byte is read anew
                s = 0
                continue
            at += 1
            s = nxt
            if s == 0:
                begin = at
        out.append(data[done:begin].decode("utf-8"))
        self.state, self.open = s, data[begin:]
        return "".join(out)

    def finish(self) -> str:
        rest, self.open, self.state = self.open, b"", 0
        return "\ufffd" if rest else ""


class Decoder:
    """Streaming decode: ids in blocks go in, their bytes come out; a Utf8 machine goes along and tells whether they are text so far.

    The machine goes a token at a time, by the state that its bytes lead to
    from each state. Tokens that are whole characters leave it between
    characters, so it stands still where all are.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.utf8 = encoder, Utf8()

    def feed(self, ids: bytes) -> bytes:
        e, s = self.encoder, self.utf8.state
        ids_ = np.frombuffer(ids, dtype="<u4")
        if s or not e.whole[ids_].all():
            steps = e.steps
            for i in ids_.tolist():
                s = steps[s][i]
            self.utf8.state = s
        return e.decode(ids)

    def finish(self) -> bool:
        """Whether all bytes were text."""
        return not self.utf8.state


def decode_stream(encoder: Encoder, blocks):
    """Text pieces for an iterable of id blocks (uint32 bytes); no piece ends inside a character."""
    machine = Utf8()
    for ids in blocks:
        yield machine.feed(encoder.decode(ids))
    yield machine.finish()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python process."""
    got = Encoder(load_ranks(path))
    gc.freeze()  # tables and memos hold no cycles: don't walk them again and again
    gc.set_threshold(200_000, 50, 1000)
    return got
