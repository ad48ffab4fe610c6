"""Token counts by a compiled finite-state tokenizer for byte-level BPE vocabularies.

Two machines run one after the other. The inner one reads the bytes of a pre-token: its state after a byte tells from
which places a token may still run on and which token precedes each, and each transition carries the number of tokens
that it adds to the encoding of what was read. The outer one reads segments, which begin where white
space follows a character that isn't white space; no pre-token spans such a place, so the machine is in its start
state there whatever came before. A transition on a segment carries its token count; both transition tables are
filled as the input asks for them.

A long text is cut into chunks anywhere. The state map of a chunk is (head, count, tail): what precedes its first
certain place is still open to the left, what follows its last one open to the right. Maps compose associatively,
so the chunks of a text are joined by a prefix scan in pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import pack, unpacked

CHUNK = 1 << 16  # characters of a chunk
MEMO = 600_000  # segments and pairs remembered; beyond that a table is started anew
TRANSITIONS = 300_000  # compiled transitions of the inner machine, likewise

# Fixed value: the split before the merges of byte-level BPE, with white space as Unicode defines it.
_PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
_PLACE = regex.compile(r"(?<=[^\p{White_Space}])(?=\p{White_Space})")
# texts whose white space is single blanks and line ends; anything else takes the general way
_ODD = re.compile("[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Counts the tokens of a text as the vocabulary's own library does (added special tokens count one each)."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.made = {a + b: (k, a, b) for (a, b), k in reversed(self.rank.items())}
        self.tokens = {bytes([b]) for b in range(256)} | set(self.made)
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.special = [t["content"] for t in model.get("added_tokens", []) if t.get("special")]
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.opening: dict[str, int] = {}  # segments as they stand
        self.spaced: dict[str, int] = {}  # segments by what follows their one blank
        self.spines: dict[tuple[bytes, bool], list] = {}
        self._fresh()

    def _spine(self, token: bytes, right: bool) -> list[tuple[int, int, bytes]]:
        """(made at, used at, piece): the pieces of the token that lie at its right (left) end while it is merged."""
        key = (token, right)
        if (found := self.spines.get(key)) is None:
            found, used, piece = [], 1 << 60, token
            while piece in self.made and len(piece) > 1:
                k, a, b = self.made[piece]
                found.append((k, used, piece))
                piece, used = (b if right else a), k
            found.append((-1, used, piece))
            self.spines[key] = found
        return found

    def fits(self, a: bytes, b: bytes) -> bool:
        """True if no merge crosses from token a to token b when both are encoded together.

        Two end pieces that exist at the same time merge across if their pair's rank comes before either is used up
        on its own side; at an equal rank the pair further left goes first.
        """
        key = (a, b)
        if (ok := self.pairs.get(key)) is None:
            ok = True
            for made_l, used_l, left in self._spine(a, True):
                for made_r, used_r, right in self._spine(b, False):
                    k = self.rank.get((left, right))
                    if k is not None and max(made_l, made_r) < min(used_l, used_r) and k < used_l and k <= used_r:
                        ok = False
                        break
                if not ok:
                    break
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile a transition of the inner machine: (next state, tokens added).

        A state holds, for every place from which a token may still run on, what lies between that place and here, the
        last token before the place, and how many tokens the encoding up to there has beyond the one up to here.
        """
        fitting, open_ = None, []
        for piece, before, ahead in self.states[state]:
            piece += bytes((byte,))
            if piece in self.tokens and fitting is None and (before is None or self.fits(before, piece)):
                fitting = (piece, ahead + 1)
            if piece in self.starts:
                open_.append((piece, before, ahead))
        last, added = fitting
        key = (*((p, b, n - added) for p, b, n in open_), (b"", last, 0))
        if (to := self.index.get(key)) is None:
            to = self.index[key] = len(self.states)
            self.states.append(key)
        out = self.table[state << 8 | byte] = (to, added)
        return out

    def _fresh(self) -> None:
        start = ((b"", None, 0),)
        self.states, self.index, self.table = [start], {start: 0}, {}

    def word(self, data: bytes) -> int:
        """Tokens of one pre-token: the sum over the transitions of its bytes."""
        if data in self.tokens:
            return 1
        if len(self.table) > TRANSITIONS:
            self._fresh()
        state = total = 0
        seen = self.table.get
        for byte in data:
            t = seen(state << 8 | byte)
            state, added = self._step(state, byte) if t is None else t
            total += added
        return total

    def segment(self, text: str) -> int:
        """Tokens of a text without special tokens, by pre-tokens."""
        return sum(self.word(p.encode()) for p in _PRETOKEN.findall(text))

    def _filled(self, table: dict[str, int], key: str, text: str) -> int:
        if (n := table.get(key)) is None:
            if len(table) >= MEMO:
                table.clear()
            n = table[key] = self.segment(text)
        return n

    def run(self, text: str) -> int:
        """Tokens of a text that begins and ends at certain places."""
        if not text:
            return 0
        if _ODD.search(text):  # segments by the general rule
            total, at = 0, 0
            for m in chain(_PLACE.finditer(text), [None]):
                end = m.start() if m else len(text)
                total += self._filled(self.opening, text[at:end], text[at:end])
                at = end
            return total
        lines = text.split("\n")
        total = len(lines) - 1  # a line end is a token of its own
        seen = self.spaced.get
        for line in lines:
            if not line:
                continue
            words = line.split(" ")
            if words[0]:
                total += self._filled(self.opening, words[0], words[0])
            counts = list(map(seen, words[1:]))
            if None in counts:
                counts = [self._filled(self.spaced, w, " " + w) if n is None else n for w, n in zip(words[1:], counts)]
            total += sum(counts)
        return total

    def state_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None where the chunk has no certain place, and all of it is the head."""
        first = _PLACE.search(chunk)
        if first is None:
            return chunk, None, ""
        a = first.start()
        b = a
        for m in _PLACE.finditer(chunk, max(a, len(chunk) - 512) - 1):  # the last place is near the end, or looked for in all
            b = m.start()
        if b == a:
            b = max(m.start() for m in _PLACE.finditer(chunk, max(a - 1, 0)))
        return chunk[:a], self.run(chunk[a:b]), chunk[b:]

    def compose(self, x: tuple, y: tuple) -> tuple:
        """The state map of two adjacent chunks."""
        if x[1] is None and y[1] is None:
            return self._open(x[0] + y[0])
        if x[1] is None:
            return self._joined(x[0] + y[0], y[1], y[2])
        if y[1] is None:
            head, n, tail = self._open(x[2] + y[0])
            return (x[0], x[1], head) if n is None else (x[0], x[1] + self.run(head) + n, tail)
        return x[0], x[1] + self.run(x[2] + y[0]) + y[1], y[2]

    def _open(self, text: str) -> tuple:
        return self.state_map(text) if _PLACE.search(text) else (text, None, "")

    def _joined(self, head: str, n: int, tail: str) -> tuple:
        h, m, t = self._open(head)
        return (h, n, tail) if m is None else (h, m + self.run(t) + n, tail)

    def chunked(self, text: str) -> int:
        """Tokens of a long text: state maps of its chunks, composed pairwise."""
        maps = [self.state_map(text[i:i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self.run(head) if n is None else self.run(head) + n + self.run(tail)

    def count(self, text: str) -> int:
        if self._special is not None and any(s in text for s in self.special):
            parts = self._special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return self.run(text) if len(text) <= CHUNK else self.chunked(text)


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One machine a worker, so that its transition tables last from task to task."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit in place of the text; other columns pass through.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    packed = pack(docs.select(*[f"`{c}`" for c in names], F.col(text).alias("_text")), "_text")
    schema = T.StructType([packed.schema["_rest"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = loaded(path)
        for batch in batches:
            counts = pa.array([machine.count(t.as_py() or "") for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), counts], ["_rest", "n_bytes", "n_tokens"])

    asked = packed.select("_rest", "_text", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes"))
    return asked.mapInArrow(counted, schema).select(*unpacked(names), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
