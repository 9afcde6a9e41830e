"""Token counts by a tokenizer that is compiled to finite-state transducers.

The tokenizer (a `tokenizers` file: splitting by letters, numbers and others, then byte-pair merges with word ends) becomes two deterministic transducers in cascade.

1. Splitter, over the classes of code points: its states are what the last piece may still take up, its output marks the first code point of every piece. A chunk of
   the text is a map from each of its states to the state behind the chunk; the maps of all chunks are composed by a parallel prefix scan, which gives each chunk's
   first state and with it its marks.
2. Merges, over the bytes of a piece: a state holds every way in which the last bytes can still be the beginning of a token, each with the last token before it and the tokens so far,
   less those of the way that ends here; each transition is annotated with the tokens that it adds (fewer than none where merges swallow some), and each state with those that the end of the piece adds. Two
   adjacent tokens are ones that the merges leave side by side exactly if no merge across their border comes before one of them is complete, so the way to a token is known as soon as it ends. States are made when a text first
   reaches them, up to a number, then anew; ways that no token can complete are left out. A chunk's map is constant from its first mark or white space on, so it is held as its head and as end state and count behind the head; composing chunks runs each head from the state that the chunk
   before ends in, all chunks at once, until no chunk begins in another state than the one it was run from (with a mark in every chunk: once).

Counts of texts are differences of the running sums of all emissions. Texts are read in runs of bounded size; a longer text is cut at white space. Normal forms, lower case and classes of code points are asked of
the file's own library when the tokenizer is compiled, on the driver; the compiled tables (bounded by the vocabulary and by Unicode) are broadcast.

Cases: null and empty texts and texts of white space have no token; a special token's string counts as one token, as the library has it; repeated rows are counted each;
very long texts take memory in proportion to a run, or to their longest stretch without white space; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Texts are counted in runs of about so many bytes, cut into chunks of CHUNK symbols that are run side by side.
RUN, CHUNK = 1 << 20, 512
#: The merge transducer is made anew beyond this many states (about 1 KB each).
MOST_STATES = 200_000
#: Last tokens count as one before nodes with at most so many tokens below.
FEW = 32
#: States of more transitions lie alone in the table.
MANY = 8
LIMIT = 2048

#: The pieces that the tokenizer file's splitting pattern must list, in its order.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Classes of code points, then those of an apostrophe by the length of the contraction that begins there.
OTHER, LETTER, NUMBER, SPACE, SHORT, LONG = range(6)
# States of the splitter: nothing open, letters, others, one or two more letters of a contraction.
FRESH, LETTERS, OTHERS, ONE, TWO = range(5)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark by state and class."""
    to, mark = np.zeros((5, 6), np.uint8), np.zeros((5, 6), bool)
    for s in range(5):
        to[s] = [OTHERS, LETTERS, FRESH, FRESH, ONE, TWO]
        mark[s] = [s != OTHERS, s != LETTERS, True, False, True, True]
    # Apostrophes inside a run of others belong to it.
    to[OTHERS, [SHORT, LONG]], mark[OTHERS, [SHORT, LONG]] = OTHERS, False
    to[TWO, LETTER], mark[TWO, LETTER] = ONE, False
    to[ONE, LETTER], mark[ONE, LETTER] = FRESH, False
    return to, mark


TO, MARK = _splitter()


def _compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan of state maps (rows): row k becomes the map of rows 0 to k, in log2 steps."""
    step = 1
    while step < len(maps):
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    return maps


def split_marks(kinds: np.ndarray) -> np.ndarray:
    """Is each symbol the first of a piece; kinds: classes of all code points."""
    n = len(kinds)
    lanes = -(-n // CHUNK)
    # White space behind the end changes nothing.
    grid = np.full(lanes * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, CHUNK).T)
    maps = np.tile(np.arange(5, dtype=np.uint8)[:, None], (1, lanes))
    flat = TO.ravel()
    for row in grid:
        maps = flat[maps * np.uint8(6) + row]
    before = np.zeros(lanes, np.uint8)
    before[1:] = _compose(maps.T)[:-1, FRESH]
    out, marks = np.empty((CHUNK, lanes), bool), MARK.ravel()
    for k, row in enumerate(grid):
        at = before * np.uint8(6) + row
        out[k], before = marks[at], flat[at]
    return out.T.ravel()[:n]


class Compiled:
    """What both transducers need of a tokenizer file; small enough to broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.json = f.read()
        told = json.loads(self.json)
        model = told["model"]
        split = [p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if model["type"] != "BPE" or split != [PIECES] or model["end_of_word_suffix"] != "</w>" or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only merges with word ends over letters, single numbers and others are compiled")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("added tokens are matched in the raw text only")
        self.specials = [t["content"] for t in told["added_tokens"]]
        self.kinds = self._kinds()
        self._merges(model)

    @staticmethod
    def _kinds() -> np.ndarray:
        """The class of every code point, as the library splits it between two letters or two others."""
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(PIECES), "removed", invert=True)
        kinds = np.full(0x110000, OTHER, np.uint8)
        for side in ("a", "!"):
            left = np.flatnonzero(kinds == OTHER)
            left = left[(left < 0xD800) | (left >= 0xE000)]
            for some in np.array_split(left, -(-len(left) // 4096)):
                # White space on both sides keeps one probe's pieces out of the next; each takes 4 code points.
                found = split.pre_tokenize_str(" ".join(side + chr(c) + side for c in some))
                ends = np.zeros(4 * len(some) + 4, np.uint8)
                ends[[z for _, (_, z) in found]] = 1
                one, two, three = (ends[k : 4 * len(some) : 4] > 0 for k in (1, 2, 3))
                if side == "a":
                    kinds[some[~one & ~two]] = LETTER
                    kinds[some[one & ~two]] = SPACE
                else:
                    kinds[some[one & two & three]] = NUMBER
        return kinds

    def _merges(self, model: dict) -> None:
        """Tokens by merge: parts, times of their own merge and of being merged; the trie of their bytes."""
        spelled = _spelled()
        units = {spelled[c]: c for c in spelled}
        # Numbers: byte b is b, byte b at a piece's end 256 + b, then one a merge.
        number = {units[b]: b for b in range(256)} | {units[b] + "</w>": 256 + b for b in range(256)}
        parts: list[tuple[int, int]] = [(k, k) for k in range(512)]
        self.rank: dict[tuple[int, int], int] = {}
        content = [bytes([b]) for b in range(256)] * 2
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b = number[left], number[right]
            if (a, b) in self.rank:
                continue
            self.rank[a, b] = len(parts)
            number.setdefault(left + right, len(parts))
            parts.append((a, b))
            content.append(content[a] + content[b])
            # A second way to one spelling is the same token for later merges only if the library has one id for both.
            if number[left + right] != len(parts) - 1:
                raise ValueError("two merges with one result")
        self.parts = parts
        last = [k >= 256 if k < 512 else None for k in range(len(parts))]
        for k in range(512, len(parts)):
            last[k] = last[parts[k][1]]
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, int] = {}
        self.final: dict[tuple[int, int], int] = {}
        nodes = 1
        for k, text in enumerate(content):
            if k >= 512 and not self._stays(k):
                continue
            node = 0
            for b in text[:-1] if last[k] else text:
                if (nxt := self.child.get((node, b))) is None:
                    nxt = self.child[node, b] = nodes
                    nodes += 1
                node = nxt
            if last[k]:
                self.final[node, text[-1]] = k
            else:
                self.token[node] = k

    def _stays(self, k: int) -> bool:
        """Do the merges turn this token's own bytes into it."""
        a, b = self.parts[k]
        return all(x < 512 or self._stays(x) for x in (a, b)) and self.beside(a, b, k)

    def beside(self, a: int, b: int, until: int = 1 << 30) -> bool:
        """Do the merges before `until` leave tokens a and b side by side.

        Down from a by its right parts and from b by its left parts, each part lives from its own merge to its whole's. A merge across the border
        happens if it comes while both of its parts live; of equal merges the one further left comes first.
        """
        x, x_ends = a, until
        while True:
            y, y_ends = b, until
            while True:
                at = self.rank.get((x, y))
                if at is not None and at < x_ends and (at <= y_ends if y_ends < until else at < until):
                    return False
                if y < 512:
                    break
                y, y_ends = self.parts[y][0], y
            if x < 512:
                return True
            x, x_ends = self.parts[x][1], x


def _spelled() -> dict[str, int]:
    """Bytes as byte-level vocabularies spell them: printable ones as themselves, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


class Transducer:
    """The merge transducer: state 0 is between pieces; a transition has the next state and the tokens that it adds, `ends[s]` has those of a piece's end.

    Transitions lie in one table: that of state s and byte b is at base[s] + b, where `owner` must name s. A state whose new transition meets another's
    moves to a base where all of its own are free; this part of the table is at most a quarter full. States of over MANY transitions have 256 places of their own behind it.
    """

    def __init__(self, compiled: Compiled):
        self.of = compiled
        up = {c: n for (n, _), c in compiled.child.items()}
        below: dict[int, list[int]] = {}
        for node, token in [*compiled.token.items(), *((n, t) for (n, _), t in compiled.final.items())]:
            while node:
                below.setdefault(node, []).append(token)
                node = up[node]
        #: The tokens below a node, where they are few.
        self.below = {n: tuple(ts) for n, ts in below.items() if len(ts) <= FEW}
        self.forget()

    def forget(self) -> None:
        self.beside: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.kind: dict[tuple, int] = {}
        # A state: the ways ((node, last token or -1, tokens), ...) before its last byte, and that byte.
        self.states: list[tuple] = [((), -1)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]
        self.full = 0
        self.chance = random.Random(0)
        self.base, self.ends = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.size = self.free = size + 256
        self.owner, self.to, self.adds = (np.full(2 * self.size, v, np.int32) for v in (-1, 0, 0))
        for s in range(len(self.states)):
            self._place(s)

    def _place(self, s: int) -> None:
        """Gives a state a base at which all its transitions are free, and writes them there."""
        moves = self.moves[s]
        if len(moves) <= MANY:
            while True:
                base = self.chance.randrange(self.size - 256)
                if all(self.owner[base + b] < 0 for b in moves):
                    break
        else:
            base = self.free
            self.free += 256
            if self.free > len(self.owner):
                self.owner, self.to, self.adds = (np.concatenate([x, np.full(self.size, v, np.int32)]) for x, v in ((self.owner, -1), (self.to, 0), (self.adds, 0)))
        self.base[s] = base
        for b, (to, adds) in moves.items():
            self.owner[base + b], self.to[base + b], self.adds[base + b] = s, to, adds

    def _add(self, s: int, byte: int, to: int, adds: int) -> None:
        at, moves = self.base[s] + byte, self.moves[s]
        self.full += 1
        moves[byte] = (to, adds)
        if len(moves) != MANY + 1 and self.owner[at] < 0:
            self.owner[at], self.to[at], self.adds[at] = s, to, adds
        else:
            self.owner[[self.base[s] + b for b in moves if b != byte]] = -1
            self._place(s)
        if 4 * self.full > self.size:
            self._table(2 * (self.size - 256))

    def _side(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (out := self.beside.get((a, b))) is None:
            out = self.beside[a, b] = self.of.beside(a, b)
        return out

    def _like(self, node: int, last: int) -> int | None:
        """One for all last tokens that allow the same tokens below a node; none if that is no token."""
        if (out := self.alike.get((node, last), -2)) == -2:
            allowed = tuple(t for t in self.below[node] if self._side(last, t))
            out = self.alike[node, last] = self.kind.setdefault((node, allowed), last) if allowed else None
        return out

    def _state(self, ways: list, byte: int) -> int:
        child, final = self.of.child, self.of.final
        held = []
        for node, last, n in ways:
            # A way that the byte ends is no way; ways that differ in nothing to come are one.
            if (node, byte) in child or (node, byte) in final:
                if node in self.below:
                    last = self._like(node, last)
                if last is not None:
                    held.append((node, last, n))
        key = (tuple(held), byte)
        if (s := self.number.get(key)) is None:
            s = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            if s == len(self.ends):
                self.base, self.ends = np.concatenate([self.base, self.base]), np.concatenate([self.ends, self.ends])
            self.base[s] = self.chance.randrange(self.size - 256)
            for node, last, n in held:
                t = final.get((node, byte))
                if t is not None and self._side(last, t):
                    self.ends[s] = n + 1
                    break
            else:
                raise AssertionError("no way ends here")
        return s

    def make(self, s: int, byte: int) -> None:
        """Adds a transition: the state's own last byte is now known not to end the piece."""
        ways, own = self.states[s]
        if own < 0:
            self._add(s, byte, self._state([(0, -1, 0)], byte), 0)
            return
        child, token = self.of.child, self.of.token
        out, here = [], None
        for node, last, n in ways:
            nxt = child.get((node, own))
            if nxt is None:
                continue
            out.append((nxt, last, n))
            t = token.get(nxt)
            if here is None and t is not None and self._side(last, t):
                here = (t, n + 1)
        last, added = here
        self._add(s, byte, self._state([*((node, x, n - added) for node, x, n in out), (0, last, 0)], byte), added)

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """What each symbol adds. Symbols: a byte, + 256 for the first of a piece, 512 for white space; the last is white space."""
        if len(self.states) > MOST_STATES:
            self.forget()
        n = len(symbols)
        lanes = -(-n // CHUNK)
        grid = np.full(lanes * CHUNK, 512, np.uint16)
        grid[:n] = symbols
        grid = grid.reshape(lanes, CHUNK)
        sync = grid >= 256
        head = np.where(sync.any(1), sync.argmax(1), CHUNK)
        grid = np.ascontiguousarray(grid.T)
        out = np.zeros((CHUNK, lanes), np.int32)
        start = np.zeros(lanes, np.int32)
        end = self._run(grid, start, out)
        while True:
            # A chunk's first state is the last one of the chunk before; only heads depend on it.
            now = np.concatenate([[0], end[:-1]]).astype(np.int32)
            wrong = np.flatnonzero((now != start) | ((head > 0) & (now == 0) & (start != 0)))
            if not len(wrong):
                break
            start[wrong] = now[wrong]
            longest = int(head[wrong].max()) + 1
            part = np.zeros((min(longest, CHUNK), len(wrong)), np.int32)
            stop = head[wrong]
            last = self._run(grid[: len(part), wrong], now[wrong], part, stop)
            rows, cols = np.nonzero(np.arange(len(part))[:, None] <= stop)
            out[rows, wrong[cols]] = part[rows, cols]
            whole = stop == CHUNK
            end[wrong[whole]] = last[whole]
        return out.T.ravel()[:n]

    def _run(self, grid: np.ndarray, state: np.ndarray, out: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
        """Runs all columns from their states; what is added goes to out. Columns of which `stop` is passed keep their state."""
        for k, row in enumerate(grid):
            breaks = row >= 256
            space = row == 512
            byte = row & 255
            at = np.where(breaks, 0, state)
            cell = self.base[at] + byte
            missing = np.flatnonzero((self.owner[cell] != at) & ~space)
            if len(missing):
                for key in np.unique(at[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                    self.make(key >> 8, key & 255)
                cell = self.base[at] + byte
            out[k] = np.where(breaks, self.ends[state], self.adds[cell])
            nxt = np.where(space, 0, self.to[cell])
            state = nxt if stop is None else np.where(k <= stop, nxt, state)
        return state


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WHITE = re.compile(r"[ \t-\r]")


class Counter:
    """Token counts of runs of texts."""

    def __init__(self, compiled: Compiled):
        from tokenizers import Tokenizer

        self.merges = Transducer(compiled)
        self.kinds = compiled.kinds
        self.ascii = compiled.kinds[:128]
        self.special = re.compile("|".join(map(re.escape, sorted(compiled.specials, key=len, reverse=True))) or r"(?!)")
        self.normalizer = Tokenizer.from_str(compiled.json).normalizer

    def _parts(self, text: str) -> Iterator[str]:
        """A text cut at white space into parts of about RUN code points: no piece and no normal form reaches across."""
        at = 0
        while len(text) - at > RUN:
            cut = _WHITE.search(text, at + RUN)
            to = cut.start() if cut else len(text)
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held: list[bytes] = []
        owner: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            between = self.special.split(text) if "<|" in text else [text]
            out[k] += len(between) - 1
            for stretch in between:
                for part in self._parts(stretch):
                    held.append(part.encode().translate(_FOLD) if part.isascii() else self.normalizer.normalize_str(part).encode())
                    owner.append(k)
                    size += len(held[-1])
                    if size > RUN:
                        np.add.at(out, owner, self._run(held))
                        held, owner, size = [], [], 0
        if held:
            np.add.at(out, owner, self._run(held))
        return out

    def _run(self, parts: list[bytes]) -> np.ndarray:
        """Tokens of each part; a space keeps parts apart and ends the last."""
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        kinds, at = self._classes(data)
        marks = split_marks(self._contractions(kinds, data, at))
        symbols = data.astype(np.uint16)
        if at is None:
            symbols[marks] += 256
            symbols[kinds == SPACE] = 512
        else:
            symbols[at[marks]] += 256
            symbols[at[kinds == SPACE]] = 512
            # White space of more than one byte: what follows its first byte is nothing either.
            wide = np.flatnonzero((kinds == SPACE) & (data[at] >= 128))
            for k in wide.tolist():
                symbols[at[k] : at[k + 1]] = 512
        total = np.concatenate([[0], np.cumsum(self.merges.emissions(symbols))])
        ends = np.cumsum([len(p) + 1 for p in parts])
        return np.diff(total[np.concatenate([[0], ends])])

    def _classes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Classes of the code points, and where they begin if not at every byte."""
        if not (data >= 128).any():
            return self.ascii[data], None
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        return self.kinds[points], np.flatnonzero((data & 0xC0) != 0x80)

    @staticmethod
    def _contractions(kinds: np.ndarray, data: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        """Apostrophes before the ends of contractions get classes of their own."""
        first = data if at is None else data[at]
        quotes = np.flatnonzero(first == 39)
        if not len(quotes):
            return kinds
        kinds = kinds.copy()
        padded = np.concatenate([first, np.full(2, 32, np.uint8)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        is_ = lambda x, letters: np.isin(x, np.frombuffer(letters, np.uint8))
        kinds[quotes[is_(one, b"stmd")]] = SHORT
        kinds[quotes[(is_(one, b"rv") & (two == 101)) | ((one == 108) & (two == 108))]] = LONG
        return kinds


_compiled: dict[str, Compiled] = {}


def token_counts(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) for each row; path: the tokenizer file, read on the driver only."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    shared = docs.sparkSession.sparkContext.broadcast(_compiled[path])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            column = batch.column(0).fill_null("")
            n = counter.counts(column.to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.compute.binary_length(column).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[id, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(text).cast("string").alias("_text"), F.col(id)).mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op11_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
