"""BPE encoding and decoding by tree concatenation.

A text is cut into halves where a space stands between other characters, the halves into halves, down to leaves. A leaf's units, which are what
stands between spaces, are encoded one by one, looked up where they recur. Neighbours are concatenated: the units around a join are encoded
again by the library in a window that grows until its first and last unit have the ids that they have on their sides. A piece that the
tokenizer's own splitting leaves long has no such spaces: it is cut into halves by characters, its leaves are encoded in one batch, over
the library's threads where they are allowed, and windows of tokens grow around each join until they agree with both sides. A sequence is the encoding
of its text exactly if each pair of neighbours is the encoding of theirs, so agreement at both ends makes the concatenation exact.

Null texts count as empty; an empty text has no tokens; repeated rows give repeated results; any further columns of the
input are ignored; an empty table gives an empty result. Texts may be of any length: nothing is cut off.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, kept

#: Characters from which an unsplit piece is encoded as a tree, and of its leaves; units of a text's leaves; entries of a lookup cache.
LONG, LEAF, UNITS, CACHE = 256, 128, 128, 300_000
#: What the tokenizer never splits from a word before it, or does so behind the word: ASCII punctuation but the apostrophe and the signs of special tokens.
TAIL = ".,;:!?)]}\"%&*#$"


def bytes_to_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in same}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(n)
            n += 1
    return out


class TreeBPE:
    """Encoder and decoder over a byte-level tokenizer file, equal to the library's encode and decode."""

    def __init__(self, path: str, long: int = LONG, leaf: int = LEAF, units: int = UNITS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.raw = Tokenizer(self.model)  # merges only: no splitting, no special tokens
        spec = json.loads(self.tok.to_str())
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.mark = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        self.long, self.leaf, self.size, self.joins = long, leaf, units, 0
        self.chars = bytes_to_chars()  # as a table from Latin-1 characters
        back = {c: b for b, c in self.chars.items()}
        self.token_bytes: dict[int, bytes] = {}
        self.token_text: dict[int, str] = {}
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.token_text[i] = token
            self.token_bytes[i] = token.encode() if token in self.specials or any(c not in back for c in token) else bytes(back[c] for c in token)
        self.units, self.marks = Recent(self.unit, CACHE), {}
        # merges alone give a word of letters, as long as the tokenizer splits and maps as it is probed here
        self.plain = all(self.library(x) == self.word(x) for x in (" thing", "thing", " Éñß", " Thing")) and all(self.library(x + y) == self.library(x) + self.library(y) for x in (" thing", "é") for y in (*TAIL, "!!", ".,", TAIL))

    def library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """The ids of letters, perhaps with a space before them: the merges of their bytes alone."""
        return [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]

    # -- long unsplit pieces ---------------------------------------------------------------------------------
    def merge(self, text: str) -> list[int]:
        return self.raw.encode(text, add_special_tokens=False).ids

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' whole text from their encodings."""
        if not left or not right:
            return left + right
        self.joins += 1
        text, k = self.token_text, 2
        while True:
            i, j = min(k, len(left)), min(k, len(right))
            again = self.merge("".join(text[t] for t in left[-i:] + right[:j]))
            if (i == len(left) or again[0] == left[-i]) and (j == len(right) or again[-1] == right[j - 1]):
                return left[:-i] + again + right[j:]
            k *= 2

    def halves(self, n: int, most: int) -> list[int]:
        """The places at which n things are cut into halves until none has more than ``most``."""
        cuts, open_ = [], [(0, n)]
        while open_:
            i, j = open_.pop()
            if j - i > most:
                cuts.append((i + j) // 2)
                open_ += [(i, cuts[-1]), (cuts[-1], j)]
        return sorted(cuts)

    def tree(self, piece: str) -> list[int]:
        """The tokens of one unsplit piece, given in the byte-level alphabet."""
        at = [0, *self.halves(len(piece), self.leaf), len(piece)]
        level = [x.ids for x in self.raw.encode_batch([piece[i:j] for i, j in zip(at, at[1:], strict=False)], add_special_tokens=False)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    # -- any text -------------------------------------------------------------------------------------------
    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text between special tokens (False) and the special tokens (True), leftmost first."""
        at = 0
        for m in self.mark.finditer(text):
            if m.start() > at:
                yield False, text[at : m.start()]
            yield True, m[0]
            at = m.end()
        if at < len(text):
            yield False, text[at:] if at else text

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; of null: none."""
        out: list[int] = []
        for special, part in self.segments(text or ""):
            if special:
                out.append(self.specials[part])
                continue
            for piece, _ in self.tok.pre_tokenizer.pre_tokenize_str(part):
                out += self.tree(piece) if len(piece) > self.long else self.merge(piece)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")

    # -- digests of many texts ------------------------------------------------------------------------------
    def splits_at_spaces(self, text: str) -> bool:
        """Whether each space that is followed by something starts a piece, so what lies between can be encoded alone."""
        return "  " not in text and not text.endswith(" ") and not self.mark.search(text)

    def held(self, ids: list[int], unit: str = "") -> tuple[int, str, str]:
        """Number of ids, the ids with a comma before each, and what they decode to, bytes that are no UTF-8 escaped; if that is the unit, itself and no copy."""
        back = b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "surrogateescape")
        return len(ids), "," + ",".join(map(str, ids)) if ids else "", unit if back == unit else back

    def unit(self, unit: str) -> tuple[int, str, str]:
        """held() of a unit's ids; of a word with marks behind it, the parts are looked up."""
        if self.plain and max(unit) < "\u0250":  # Latin letters
            word = unit.rstrip(TAIL)
            if word != unit and word[-1:].isalpha():
                mark = unit[len(word) :]
                if mark not in self.marks and len(self.marks) < CACHE:
                    self.marks[mark] = self.held(self.library(mark))
                one, two = self.units[word], self.marks.get(mark) or self.held(self.library(mark))
                back = one[2] + two[2]
                return one[0] + two[0], one[1] + two[1], unit if back == unit else back
            if (unit[1:] if unit[0] == " " else unit).isalpha():
                return self.held(self.word(unit) if len(unit) <= self.long else self.tree(unit.encode().decode("latin-1").translate(self.chars)), unit)
        return self.held(self.encode(unit) if len(unit) > self.long else self.library(unit), unit)

    def joined(self, units: list[str], found: list[tuple]) -> list[tuple]:
        """found, the units' encodings, after windows around the joins of the tree's leaves have been encoded again."""
        for cut in self.halves(len(units), self.size):
            k = 1
            while True:
                self.joins += 1
                i, j = max(0, cut - k), min(len(units), cut + k)
                n, text, back = self.held(self.library("".join(units[i:j])))
                first, last = found[i], found[j - 1]
                # a unit that a window has taken in has no ids of its own to agree with
                if (i == 0 or first[1] and f"{text},".startswith(f"{first[1]},")) and (j == len(units) or last[1] and text.endswith(last[1])):
                    if text != "".join([x[1] for x in found[i:j]]):  # the window holds: it takes the place of its units
                        found[i:j] = [(n, text, back), *[(0, "", "")] * (j - i - 1)]
                    break
                k *= 2
        return found

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """The number of ids, and the SHA-256 of the joined ids and of the decoded text."""
        if text and self.splits_at_spaces(text):
            first, *rest = text.split(" ")
            units = [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
            n, ids, back = zip(*self.joined(units, list(map(self.units.__getitem__, units))), strict=True)
            n, ids, back = sum(n), "".join(ids)[1:], "".join(back).encode("utf-8", "surrogateescape")
        else:
            found = self.encode(text)
            n, ids, back = len(found), ",".join(map(str, found)), b"".join(map(self.token_bytes.__getitem__, found))
        back = back.decode("utf-8", "replace").encode()
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


def encoder(path: str) -> TreeBPE:
    """Held by a Python worker from task to task; one thread a task, if nothing else is asked for."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(TreeBPE, path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, ids array<int>, decoded string) for each row of docs."""

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 128):
                c = b.slice(at, 128)
                ids = [bpe.encode(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, without shuffling any of them."""

    def run(batches):
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                rows = [bpe.digest(t.as_py()) for t in c.column(1)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
