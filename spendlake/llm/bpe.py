"""Byte-pair tokenizers compiled to deterministic finite-state transducers.

A tokenizer file of the `tokenizers` library is compiled in two parts.

* Splitting. The pattern's classes (letter, number, space, other) are looked up per code point in a
  table that is probed from the library. Whether a piece starts at a character depends on a few
  neighbours only, so starts are found for a whole batch at once.
* Merging. A prefix of a piece has exactly one last token `t` such that `(last token before t, t)` is
  a pair that the merges leave alone. A state holds, for each open suffix that may still grow into a
  token, its place in the token trie, the last token before it and its token count relative to the
  prefix. That is a finite memory: each transition on a byte is deterministic, is annotated with the
  number of tokens it emits (a suffix may also take tokens back), and leads to a state that knows the
  last token. States and transitions are determinised when first met and kept in numpy tables.

Text runs through the tables in chunks of equal length, all chunks in step. A chunk's map from the
state it is entered in to (state left in, tokens emitted) is constant from its first piece start on.
What lies before that start, or the whole chunk where there is none, is run from every state that the
chunk before may leave; states soon agree, so these maps have few entries. Maps are then composed by a
parallel prefix scan, each step of which doubles the number of chunks a map spans, so a run of n chunks
without a start takes log2(n) steps.

Texts that hold special strings or characters outside the probed planes are encoded by the library
itself. So is a sample of texts in each batch, as an audit: when one differs, the batch is redone by
the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from . import text

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 1, 2, 3, 4, 0
CHUNK = 256
MAX_STATES, MAX_KNOWN = 1 << 16, 1 << 19
FEW = 64
#: Rounds in which chunks are run from guessed states before only the true ones are followed.
ROUNDS = 24
#: Text encoded at a time: the arrays for it take some 60 bytes each.
ENCODE_BYTES = 1 << 20
PLANE = 0x10000
AUDIT_EVERY = 512
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def probe(source: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point of the basic plane, as the library treats them."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(source.decode("utf-8"))
    kinds, lower = np.zeros(PLANE, np.uint8), np.arange(PLANE, dtype=np.int32)
    words = tok.normalizer is not None
    symbols = byte_symbols()
    for code in [*range(0xD800), *range(0xE000, PLANE)]:
        c = chr(code)
        if words:
            if code >= 0x300 and not 0x2010 <= code < 0x2070 and not 0x20A0 <= code < 0x20C0:
                continue
            norm = tok.normalizer.normalize_str(c)
            if len(norm) != 1 or (norm != " " and len(norm.encode()) != len(c.encode())):
                continue
            lower[code] = code if norm == " " else ord(norm)
            near = [p for p, _ in tok.pre_tokenizer.pre_tokenize_str("a" + norm + "a")]
            if norm == " " or near == ["a", "a"]:
                kinds[code] = SPACE
            elif len(near) == 1:
                kinds[code] = LETTER
            else:
                kinds[code] = NUMBER if len(tok.pre_tokenizer.pre_tokenize_str(norm + norm)) == 2 else OTHER
        else:
            pieces = [bytes(symbols[x] for x in p).decode() for p, _ in tok.pre_tokenizer.pre_tokenize_str("a" + c + c + "1!")]
            if pieces[0] != "a":
                kinds[code] = LETTER
            elif c + c + "1" in pieces:
                kinds[code] = NUMBER
            elif c + c in pieces:
                kinds[code] = SPACE if c.isspace() else OTHER
            else:
                kinds[code] = SPACE if pieces[1:3] == [c, c] or c == " " else OTHER
    if not words and kinds[ord("!")] == UNKNOWN:
        kinds[ord("!")] = OTHER
    return kinds, lower


class Transducer:
    """Lazily determinised merge transducer over symbols 0-255 (bytes) and 256-511 (a piece's last byte)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.final = bool(suffix)
        symbols, self.trie, self.ends = byte_symbols(), {}, {}
        special = {t["content"] for t in spec["added_tokens"]}
        self.spelling: dict[int, tuple[int, ...]] = {}
        self.single: dict[int, int] = {}
        vocab = model["vocab"]
        nodes = 1
        for token, i in vocab.items():
            if token in special:
                continue
            last = bool(suffix) and token.endswith(suffix) and token != suffix
            spelled = [symbols[c] for c in (token[: -len(suffix)] if last else token)]
            if last:
                spelled[-1] += 256
            self.spelling[i] = tuple(spelled)
            if len(spelled) == 1:
                self.single[spelled[0]] = i
            node = 0
            for s in spelled:
                key = node * 512 + s
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.ends[node] = i
        self.grows = {key // 512 for key in self.trie}
        self.below: dict[int, list[int]] = {}  # longer tokens below a node, where they are few
        for i, spelled in self.spelling.items():
            node = 0
            for s in spelled:
                if node and (found := self.below.setdefault(node, [])) is not None:
                    found.append(i)
                    if len(found) > FEW:
                        self.below[node] = None
                node = self.trie[node * 512 + s]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.parts = {i: (a, b, rank) for (a, b), (rank, i) in self.merges.items()}
        self.one_way = len(self.parts) == len(self.merges)
        self.stable: dict[int, bool] = {}
        self.size = np.zeros(max(self.spelling) + 1, np.int32)
        self.size[list(self.spelling)] = [len(x) for x in self.spelling.values()]
        self.reset()

    def reset(self) -> None:
        """Forget all states but the root; symbols get columns as they are met."""
        self.same: dict[tuple[int, int], int | None] = {}
        self.leader: dict[tuple[int, bytes], int] = {}
        self.column = np.full(512, -1, np.int32)
        self.width, self.n = 128, 1
        self.symbol_of: list[int] = []
        self.next = np.full((1024, self.width), -1, np.int32)
        self.emit = np.zeros((1024, self.width), np.int8)
        self.last = np.full(1024, -1, np.int32)
        self.items = [((0, -1, 0),)]
        self.index = {self.items[0]: 0}

    def merge(self, spelled: tuple[int, ...]) -> list[int]:
        parts = [self.single[s] for s in spelled]
        while len(parts) > 1:
            found = min((m[0], k) for k in range(len(parts) - 1) if (m := self.merges.get((parts[k], parts[k + 1])))) if any((parts[k], parts[k + 1]) in self.merges for k in range(len(parts) - 1)) else None
            if found is None:
                break
            k = found[1]
            parts[k : k + 2] = [self.merges[parts[k], parts[k + 1]][1]]
        return parts

    def untouched(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens alone.

        The merges that built both are undone from the latest on. While two parts face each other, a merge
        of the pair must not come before either is built into something larger; of equal merges the left
        one comes first.
        """
        built = float("inf")
        while True:
            joined = self.merges.get((left, right))
            if joined is not None and joined[0] < built:
                return False
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and of_left[2] > of_right[2]):
                left, built = of_left[1], of_left[2]
            else:
                right, built = of_right[0], of_right[2] + 0.5

    def fits(self, before: int, token: int) -> bool:
        """Whether the merges give `token` after the last token `before` (-1: at a piece's start)."""
        if token not in self.stable:
            self.stable[token] = self.merge(self.spelling[token]) == [token]
        if before < 0 or not self.stable[token]:
            return self.stable[token]
        if self.one_way:
            return self.untouched(before, token)
        return self.merge(self.spelling[before] + self.spelling[token]) == [before, token]

    def stand_in(self, node: int, before: int) -> int | None:
        """One last token for all that let the same longer tokens below `node` through; None if there are none."""
        key = (node, before)
        if key not in self.same:
            if (below := self.below[node]) is None:
                self.same[key] = before
            else:
                through = bytes(self.fits(before, t) for t in below)
                self.same[key] = self.leader.setdefault((node, through), before) if any(through) else None
        return self.same[key]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """Target and emitted count of one transition, by determinising it."""
        open_, token, count = [], -1, 0
        for node, before, rel in self.items[state]:
            at = self.trie.get(node * 512 + symbol)
            if at is None:
                continue
            if token < 0 and at in self.ends and self.fits(before, self.ends[at]):
                token, count = self.ends[at], rel + 1
            if at in self.grows and (stand_in := self.stand_in(at, before)) is not None:
                open_.append((at, stand_in, rel))
        if token < 0:
            raise ValueError(f"no token ends with symbol {symbol}")
        items = tuple((at, before, rel - count) for at, before, rel in open_) + ((0, token, 0),)
        if items not in self.index:
            if self.n == len(self.last):
                self.next = np.vstack([self.next, np.full_like(self.next, -1)])
                self.emit = np.vstack([self.emit, np.zeros_like(self.emit)])
                self.last = np.concatenate([self.last, np.full_like(self.last, -1)])
            self.index[items] = self.n
            self.items.append(items)
            self.last[self.n] = token
            self.n += 1
        return self.index[items], count

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """Table columns of symbols, adding those not met before."""
        for s in np.flatnonzero(np.bincount(symbols, minlength=512)):
            if self.column[s] < 0:
                if len(self.symbol_of) == self.width:
                    self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                    self.emit = np.hstack([self.emit, np.zeros_like(self.emit)])
                    self.width *= 2
                self.column[s] = len(self.symbol_of)
                self.symbol_of.append(int(s))
        return self.column[symbols]

    def advance(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of all lanes: new states, emitted counts."""
        at = states.astype(np.int64) * self.width + columns
        new = self.next.ravel()[at]
        if new.min(initial=0) < 0:
            for key in np.unique(at[new < 0]):
                state, column = divmod(int(key), self.width)
                target, count = self.step(state, self.symbol_of[column])
                self.next[state, column], self.emit[state, column] = target, count
            new = self.next.ravel()[at]
        return new, self.emit.ravel()[at]

    def run(self, symbols: np.ndarray, starts: np.ndarray, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Emitted count at each symbol and, if wanted, the last token there. A piece starts where starts is true."""
        n = len(symbols)
        if self.n > MAX_STATES or len(self.same) > MAX_KNOWN:
            self.reset()
        lanes = max(1, -(-n // CHUNK))
        cols = np.zeros(lanes * CHUNK, np.int32)
        cols[:n] = self.columns(symbols)
        fresh = np.ones(lanes * CHUNK, dtype=bool)  # padding is a run of pieces of its own
        fresh[:n] = starts
        cols, fresh = np.ascontiguousarray(cols.reshape(lanes, CHUNK).T), np.ascontiguousarray(fresh.reshape(lanes, CHUNK).T)
        emitted = np.zeros((CHUNK, lanes), np.int8)
        last = np.zeros((CHUNK, lanes), np.int32) if want_ids else None
        head = np.where(fresh.any(axis=0), fresh.argmax(axis=0), CHUNK)
        # from the first piece start of each chunk on, the chunk's map does not depend on its entry state
        state, at_start = np.zeros(lanes, np.int32), ~fresh
        for k in range(CHUNK):
            known = np.flatnonzero(head <= k) if k < head.max(initial=0) else None
            if known is None:
                state, emitted[k] = self.advance(state * at_start[k], cols[k])
                if want_ids:
                    last[k] = self.last[state]
            elif len(known):
                state[known], emitted[k, known] = self.advance(state[known] * at_start[k, known], cols[k, known])
                if want_ids:
                    last[k, known] = self.last[state[known]]
        todo = np.flatnonzero(head > 0)
        if len(todo):
            entry = self.entries(head, todo, state, cols)
            for k in range(int(head[todo].max())):
                going = np.flatnonzero(head[todo] > k)
                lane = todo[going]
                entry[going], emitted[k, lane] = self.advance(entry[going], cols[k, lane])
                if want_ids:
                    last[k, lane] = self.last[entry[going]]
        flat = emitted.T.reshape(-1)[:n]
        return flat, last.T.reshape(-1)[:n] if want_ids else None

    def entries(self, head: np.ndarray, todo: np.ndarray, state: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """State that each chunk of `todo` is entered in; `state`: what chunks with a start leave, whatever their entry.

        A node stands for a chunk and a state it may be entered in, and points to the node of the next chunk
        that it leads to. Nodes are added until every node's next one is there.
        """
        whole = head == CHUNK  # no start within: leaves what its entry leads to
        chunk, at = todo, np.where(whole[todo - 1], 0, state[todo - 1])  # after a whole chunk: a first guess
        true = np.flatnonzero(~whole[todo - 1] | (todo == 0))
        at[todo == 0] = 0
        keys, after, new = chunk.astype(np.int64) << 32 | at, np.zeros(0, np.int64), slice(0, len(todo))
        rounds = 0
        while True:
            c, left = keys[new] >> 32, (keys[new] & 0xFFFFFFFF).astype(np.int32)
            through = np.flatnonzero(whole[c])
            for k in range(CHUNK if len(through) else 0):
                left[through], _ = self.advance(left[through], cols[k, c[through]])
            leads = whole[c] & (c + 1 < len(head)) & (head[np.minimum(c + 1, len(head) - 1)] > 0)
            after = np.concatenate([after, np.where(leads, (c + 1) << 32 | left, -1)])
            rounds += 1
            more = np.setdiff1d(after[after >= 0], keys)
            if rounds > ROUNDS and len(more):  # states do not agree: follow the true ones only
                more = np.intersect1d(more, after[_reached(keys, after, keys[true])])
            if not len(more):
                break
            new = slice(len(keys), len(keys) + len(more))
            keys = np.concatenate([keys, more])
        hit = keys[_reached(keys, after, keys[true])]
        return (hit[np.argsort(hit, kind="stable")] & 0xFFFFFFFF).astype(np.int32)


def _reached(keys: np.ndarray, after: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Nodes on the ways from `begin`, by jumps of doubling length."""
    order = np.argsort(keys)
    place = np.minimum(np.searchsorted(keys[order], after), len(keys) - 1)
    jump = np.where((after >= 0) & (keys[order[place]] == after), order[place], len(keys))
    jump = np.append(jump, len(keys))
    mark = np.zeros(len(keys) + 1, dtype=bool)
    mark[:-1] = np.isin(keys, begin)
    while True:
        before = mark.sum()
        mark[jump[mark]] = True
        mark[-1] = False
        if mark.sum() == before and (jump[:-1] == len(keys)).all():
            return np.flatnonzero(mark[:-1])
        jump = jump[jump]


class Encoder:
    """Token counts and ids of Arrow text columns, as the library gives them for the file `source`."""

    def __init__(self, source: bytes, kinds: np.ndarray, lower: np.ndarray):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        self.library = Tokenizer.from_str(source.decode("utf-8"))
        self.kinds, self.lower = kinds, lower
        self.words = spec["normalizer"] is not None
        self.machine = Transducer(spec)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Symbols to run, piece starts among them, their row offsets, and rows that the library has to encode."""
        n = len(data)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        b = data[at].astype(np.int32)
        size = 1 + (b >= 0xC0) + (b >= 0xE0) + (b >= 0xF0)
        code = b.copy()
        for k, mask in ((2, 0x1F), (3, 0x0F)):
            w = np.flatnonzero(size == k)
            value = b[w] & mask
            for j in range(1, k):
                value = (value << 6) | (data[at[w] + j] & 0x3F)
            code[w] = value
        wide = size == 4
        code[wide] = 0
        kind = self.kinds[code]
        kind[wide] = UNKNOWN
        row_first = np.searchsorted(at, offsets)
        bad_char = kind == UNKNOWN
        bad = np.zeros(len(offsets) - 1, dtype=bool)
        if bad_char.any():
            bad[np.searchsorted(offsets, at[np.flatnonzero(bad_char)], side="right") - 1] = True
        mark = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if n > 1 else np.zeros(0, np.int64)
        if len(mark):
            whole = data.tobytes()
            for p in mark:
                if any(whole.startswith(s, p) for s in self.special):
                    bad[np.searchsorted(offsets, p, side="right") - 1] = True
        if self.words:
            small = self.lower[code]
            changed = np.flatnonzero((small != code) & ~wide)
            if len(changed):
                data, code = data.copy(), small
                one, two, three = (changed[size[changed] == k] for k in (1, 2, 3))
                data[at[one]] = small[one]
                data[at[two]], data[at[two] + 1] = 0xC0 | (small[two] >> 6), 0x80 | (small[two] & 0x3F)
                data[at[three]], data[at[three] + 1], data[at[three] + 2] = 0xE0 | (small[three] >> 12), 0x80 | ((small[three] >> 6) & 0x3F), 0x80 | (small[three] & 0x3F)
        m = len(at)
        first = np.zeros(m + 1, dtype=bool)
        first[row_first] = True
        final = first[1:]
        first = first[:-1]
        prev = np.empty_like(kind)
        prev[1:], prev[:1] = kind[:-1], UNKNOWN
        prev[first] = UNKNOWN
        start = first | (kind != prev)
        blank = code == 0x20
        if self.words:
            start |= kind == NUMBER
            opens = prev != OTHER
        else:
            after_blank = np.zeros(m, dtype=bool)
            after_blank[1:] = blank[:-1]
            after_blank &= ~first
            space, next_solid = kind == SPACE, np.zeros(m, dtype=bool)
            next_solid[:-1] = kind[1:] != SPACE
            next_solid &= ~final
            start |= space & next_solid
            start &= space | ~after_blank
            opens = (prev != OTHER) & ~after_blank
        quote = np.flatnonzero((code == 0x27) & opens)
        for p in quote:
            for c in _CONTRACTIONS:
                e = p + 1 + len(c)
                if e <= m and not first[p + 1 : e].any() and all(code[p + 1 + i] == ord(x) for i, x in enumerate(c)):
                    start[p], start[p + 1 : e] = True, False
                    if e < m and (kind[e] != SPACE):
                        start[e] = True
                    break
        starts = np.zeros(n, dtype=bool)
        starts[at] = start
        symbols = data.astype(np.int32)
        keep = np.ones(len(bad), dtype=bool)
        keep[bad] = False
        use = np.repeat(keep, np.diff(offsets))
        if self.words:
            solid = np.zeros(n, dtype=bool)
            solid[at] = kind != SPACE
            for j in (1, 2, 3):
                w = at[size > j]
                solid[w + j] = solid[w]
            use &= solid
        lens = np.add.reduceat(np.append(use, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if len(offsets) > 1 else np.zeros(0, np.int64)
        symbols, starts = symbols[use], starts[use]
        if self.words and len(symbols):
            # what comes after removed space or another row starts a piece; the byte before a start is a piece's last
            begin = np.cumsum(lens) - lens
            starts[begin[lens > 0]] = True
            symbols[np.append(starts[1:], True)] += 256
        return symbols, starts, np.concatenate([[0], np.cumsum(lens)]), np.flatnonzero(bad)

    def encode(self, column: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens per row and, if wanted, all ids in row order. Null texts count as empty."""
        data, offsets = text.buffers(column)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(rows, np.int64), np.zeros(0, np.uint32) if want_ids else None
        symbols, starts, offs, odd = self._pieces(data, offsets)
        emitted, last = self.machine.run(symbols, starts, want_ids)
        total = np.concatenate([[0], np.cumsum(emitted, dtype=np.int64)])
        counts = total[offs[1:]] - total[offs[:-1]]
        ids = None
        if want_ids:
            ends = np.zeros(len(symbols), dtype=bool)
            begin = np.flatnonzero(starts)
            at = np.append(begin[1:], len(symbols)) - 1
            while len(at):
                ends[at] = True
                back = at - self.machine.size[last[at]]
                more = back >= begin
                at, begin = back[more], begin[more]
            ids = last[ends].astype(np.uint32)
        by_hand = {int(r): t for r, t in zip(odd, self.by_library([column[int(r)].as_py() for r in odd]), strict=True)}
        audit = [r for r in range(0, rows, AUDIT_EVERY) if r not in by_hand]
        at = np.concatenate([[0], np.cumsum(counts)])
        for r, right in zip(audit, self.by_library([column[r].as_py() or "" for r in audit]), strict=True):
            if len(right) != counts[r] or (want_ids and not np.array_equal(right, ids[at[r] : at[r + 1]])):
                by_hand = dict(enumerate(self.by_library([x.as_py() or "" for x in column])))
                break
        if by_hand:
            if want_ids:
                ids = np.concatenate([by_hand.get(r, ids[at[r] : at[r + 1]]) for r in range(rows)])
            for r, t in by_hand.items():
                counts[r] = len(t)
        return counts, ids


_CACHE: dict[int, Encoder] = {}


def cached(source: bytes, kinds: np.ndarray, lower: np.ndarray) -> Encoder:
    """One encoder per file and Python worker, so its states last from batch to batch."""
    key = hash(source)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Encoder(source, kinds, lower)
    return _CACHE[key]


class Compiled:
    """A tokenizer file read and probed on the driver and sent to the executors once."""

    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            source = f.read()
        self.shared = spark.sparkContext.broadcast((source, *probe(source)))

    def encoder(self) -> Encoder:
        return cached(*self.shared.value)
