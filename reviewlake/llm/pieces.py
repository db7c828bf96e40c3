"""SentencePiece BPE by a merge-type prefix table, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

SPACE = "▁"
#: Characters of a part that is worth remembering.
LONGEST = 200
NONE = 1 << 60
#: Runs of letters after at most one mark, and single other characters.
RUNS = re.compile(f"{SPACE}?[^\\W\\d_{SPACE}]+|.", re.S)


class Encoder:
    """Ids of a text under a BPE model with byte fallback and identity normalisation.

    Two adjacent symbols merge when their concatenation is a piece; the best-scored merge goes first, the leftmost of
    equals. For each prefix of a segment, exactly one token can be the last of that prefix's encoding: one that ends
    there (an automaton reports those) and is compatible with the last token of the prefix it leaves. Storing that
    token for each prefix and walking back from the end recovers the ids, in time linear in the text. Pieces of one score, as
    runs of marks have, merge from the left, which is the order that compatibility undoes them in.
    """

    def __init__(self, model_file: str, remember: int = 250_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.piece[i][3:5], 16) for i in range(n) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.unk = sp.unk_id()
        self.hidden = {i for i in range(n) if sp.is_control(i)}
        self.id_of = {self.piece[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        order = sorted({sp.get_score(i) for i in self.id_of.values()}, reverse=True)
        place = {s: r for r, s in enumerate(order)}
        #: rank of a merge that makes the token, smaller first; characters are made by no merge
        self.rank = {i: place[sp.get_score(i)] if len(p) > 1 else -1 for p, i in self.id_of.items()}
        self.known = {p for p in self.id_of if len(p) == 1}
        self.pattern = re.compile(f"[{re.escape(''.join(sorted(self.known)))}]+|.", re.S)
        self.inner = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shift = n.bit_length()
        self.auto = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            if len(p) == 1 or self._halve(p, i):  # a token that isn't the encoding of its own text ends no prefix
                self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        #: what ids stand for one by one; bytes of longer characters, unknown and control ids need their neighbours
        self.plain = [chr(self.bytes[i]) if i in self.bytes else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.slow = {i for i, b in self.bytes.items() if b >= 128 or b == 32} | self.hidden | {self.unk}
        self.decimal = [str(i) for i in range(n)]
        self.length = {i: len(p) for p, i in self.id_of.items()}
        self.found: dict[str, tuple[int, ...]] = {}
        self.fits: dict[int, bool] = {}
        self.remember = remember

    def _halve(self, piece: str, i: int) -> bool:
        ids, last = self._merge(piece)
        if ids == [i]:
            self.halves[i] = last
        return ids == [i]

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The plain way, for the pieces themselves: merge the best pair until none is left. Also gives the last pair that merged."""
        sym: list[str] = list(text)
        left, right, last = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1)), None
        heap: list = []

        def push(a: int) -> None:
            b = right[a]
            if a >= 0 and b < len(sym) and (i := self.id_of.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (self.rank[i], a, b, len(sym[a]), len(sym[b])))

        for a in range(len(sym) - 1):
            push(a)
        while heap:
            _, a, b, la, lb = heapq.heappop(heap)
            if len(sym[a]) != la or len(sym[b]) != lb or right[a] != b or not lb:
                continue
            last = (self.id_of.get(sym[a], -1), self.id_of.get(sym[b], -1))
            sym[a], sym[b] = sym[a] + sym[b], ""
            right[a] = right[b]
            if right[b] < len(sym):
                left[right[b]] = a
            if left[a] >= 0:
                push(left[a])
            push(a)
        return [x for s in sym if s for x in self._ids(s)], last

    def _ids(self, symbol: str) -> list[int]:
        i = self.id_of.get(symbol)
        return [i] if i is not None else [self.byte_id[b] for b in symbol.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unk]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether [a, b] is the encoding of their joint text.

        Undo merges from the latest back on both sides of the border. At each step, had the two symbols that meet at
        the border a merge of their own that goes before the merge just undone, it would have been taken instead.
        """
        rank, halves, piece, id_of = self.rank, self.halves, self.piece, self.id_of
        x, y, later, strict = a, b, NONE, False
        while True:
            joint = id_of.get(piece[x] + piece[y])
            if joint is not None and (rank[joint] < later or rank[joint] == later and not strict):
                return False
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                return True
            # of equal ranks the left one merged first, so the right one is undone first
            if rx > ry:
                later, strict, x = rx, True, halves[x][1]
            else:
                later, strict, y = ry, False, halves[y][0]

    def _table(self, text: str) -> list[int]:
        """Ids of a segment of known characters, by its prefix table; last[n] is the token that ends the prefix of n."""
        n = len(text)
        last: list = [None] * n
        last.append(-1)  # before the first character, at index -1
        fits = self.fits
        done = -1
        for end, (i, size) in self.auto.iter(text):
            if end != done:
                before = last[end - size]
                if before is None:
                    continue
                if before >= 0:
                    key = before << self.shift | i
                    if key in fits:
                        if not fits[key]:
                            continue
                    else:
                        if len(fits) > 2 * self.remember:
                            fits.clear()
                        ok = fits[key] = self._compatible(before, i)
                        if not ok:
                            continue
                last[end] = i
                done = end
        ids, at, length = [], n - 1, self.length
        while at >= 0:
            i = last[at]
            if i is None:
                raise ValueError("no token ends the text: the vocabulary isn't one of pairwise merges")
            ids.append(i)
            at -= length[i]
        ids.reverse()
        return ids

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a text with no safe cut; remembered without its mark, or with one more where it has none."""
        key = text[1:] if text[0] == SPACE and text[1:2] != SPACE else SPACE + text
        ids = self.found.get(key)
        if ids is None:
            if len(text) == 1:
                ids = self._ids(text)
            elif self.known.issuperset(text):
                ids = self._table(text)
            else:  # characters that are no piece stand alone
                ids = [i for x in self.pattern.findall(text) for i in (self._table(x) if x[0] in self.known else self._ids(x))]
            ids = (*ids,)
            self.keep(key, ids)
        return ids

    def keep(self, key: str, ids: tuple[int, ...]) -> None:
        """Remember a part's ids. Parts of over `LONGEST` characters, hardly met again, are not, and all go when they would be over `remember` entries,
        so that what is held has a bound whatever the texts are."""
        if len(key) <= LONGEST:
            if len(self.found) >= self.remember:
                self.found.clear()
            self.found[key] = ids

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a text, cut where no piece holds the two characters that meet."""
        ids: list[int] = []
        held = ""
        for part in RUNS.findall(text):
            if held and held[-1] + part[0] not in self.inner:
                ids += self.part(held)
                held = part
            else:
                held += part
        return (*ids, *self.part(held))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        words = text.split(" ")
        if "" in words or SPACE in text:
            for part in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE)):
                out += self.segment(part)
            return out
        get = self.found.get
        for w in words:
            ids = get(w)
            if ids is None:
                if w.isalpha():
                    ids = self.part(SPACE + w)
                else:
                    ids = self.segment(SPACE + w)
                    if len(w) <= 12:
                        self.keep(w, ids)
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, the mark a space, the first one dropped, byte runs read as UTF-8."""
        if self.slow.isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids))[1 if len(ids) and self.plain[ids[0]][:1] == " " else 0 :]
        piece, raw = self.piece, self.bytes
        parts: list[str] = []
        run = bytearray()
        first = True
        for i in ids:
            b = raw.get(i)
            if b is not None:
                run.append(b)
                first = False
                continue
            if run:
                parts.append(utf8(run))
                run = bytearray()
            if i in self.hidden:
                continue
            p = " ⁇ " if i == self.unk else piece[i].replace(SPACE, " ")
            if first and p[:1] == " " and i != self.unk:
                p = p[1:]
            first = False
            parts.append(p)
        if run:
            parts.append(utf8(run))
        return "".join(parts)


def utf8(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is no part of a character."""
    try:
        return bytes(run).decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[at : at + n]).decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder for each model in a Python worker."""
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(model_file)
    return _encoders[model_file]


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode(docs: DataFrame, model_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the array<int> column `out`: all ids, without begin or end marks. Null is read as empty; empty has no ids."""

    def make():
        e = encoder(model_file)
        return lambda texts: [[e.encode(text_of(t)) for t in texts]]

    return add_columns(docs, text, [(out, T.ArrayType(T.IntegerType()))], make)


def digests(docs: DataFrame, model_file: str, text: str = "text", ids_too: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of decode(ids) in UTF-8), and with
    the ids themselves where asked for.

    Null is read as the empty text, which has no ids and decodes to the empty text. Texts are encoded whole, however
    long. Rows are encoded one by one; nothing is shuffled. Clashing column names give way.
    """

    def make():
        e = encoder(model_file)

        def work(texts):
            n, a, b, every = [], [], [], []
            for t in texts:
                ids = e.encode(text_of(t))
                if ids_too:
                    every.append(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(e.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            return [n, a, b, every] if ids_too else [n, a, b]

        return work

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return add_columns(docs, text, fields + [("ids", T.ArrayType(T.IntegerType()))] * ids_too, make)


def decode(rows: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the string column `out`: the text of the array column `ids` (null: empty)."""

    @F.pandas_udf(T.StringType())
    def text(column):
        e = encoder(model_file)
        return column.map(lambda x: e.decode([] if x is None else x.tolist()))

    return rows.withColumn(out, text(ids))
