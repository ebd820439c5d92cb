"""BPE encoding and decoding of whole texts with a public tokenizer file.

A text of more than ``PIECE`` characters is encoded by tree concatenation: it is cut into halves of
halves wherever the cut falls, the pieces are dealt to all tasks and encoded there in parallel, and
neighbours are joined upward, ``FAN`` per round of the job and two by two inside it. A join
encodes a window around the cut and grows it until its tokens meet those of the left piece on one
side and those of the right piece on the other, ``AGREE`` tokens in a row each with the same ids
at the same places; the result is left tokens, window tokens, right tokens. A window that reaches
both ends is the whole text, and its tokens are the result. Pieces keep the places of their outer
``EDGE`` tokens; a window that outgrows them is taken as the whole.

Inside a piece (and a shorter text) the library encodes runs between white space, each distinct
short one once per worker as long as its cache has room (white space is a hard boundary of the
word-level vocabulary, so that ids are those of the runs in order). Where the tokenizer has the
usual word-end form (NFC, lower case, letters, digits and signs apart), runs of plain Latin
letters, digits and signs fall into such pieces beforehand, which raises the cache's hits and lets
the library's model encode them without normalising them again. The cache is bounded in bytes.

Defined results: a null text is encoded as an empty one: no ids, and decoded "". Special tokens
inside a text are recognised as the library does. One row per row; repeated rows are encoded
alike, extra columns are ignored by ``encoded`` (which returns doc_id, ids, decoded).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

PIECE = 32768
FAN = 8
AGREE = 8
EDGE = 256
#: Characters on either side of a cut that the first window takes.
REACH = 128
#: Bytes that a worker process keeps of runs it has met, and the longest run that is kept.
CACHE_BYTES = 96 << 20
CACHED_RUN = 256
_ENTRY = 120
#: Characters of long text that one task is dealt.
DEALT = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Signs that are always a piece of their own kind; the apostrophe and those of special tokens are not.
_SIGNS = re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")
_SAFE = f"{_LETTERS}0-9{_SIGNS}"
#: A run with any other character stays whole; other runs fall into letters, single digits and signs.
_PIECES = re.compile(rf"[{_SAFE}]*+[^{_SAFE} \t\n\r][^ \t\n\r]*+|[{_LETTERS}]++|[0-9]|[{_SIGNS}]++")
_UNSAFE = re.compile(rf"[^{_SAFE}]")
#: Fixed value: the split that makes the pieces above exact.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Only these are taken as boundaries; other white space stays inside a run and is the library's affair.
_RUN = re.compile(r"[^ \t\n\r]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are what runs in parallel
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@dataclass
class Piece:
    """A stretch of a text and its ids; ``head`` and ``tail`` are the places (start, end) of the outer
    tokens, counted from the stretch's start and from its end."""

    text: str
    ids: np.ndarray
    head: np.ndarray
    tail: np.ndarray


class Codec:
    """Encodes and decodes texts; keeps the ids of short runs it has met."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.tokenizer = load(path)
        self.cache_bytes = cache_bytes
        self._forget()
        #: Without a decoder the library joins the tokens by a blank, so that runs can be decoded one by one.
        self.joins = self.tokenizer.decoder is None
        self.by_pieces = self._has_word_form()
        self.letters = _byte_letters()
        self.runs = _PIECES if self.by_pieces else _RUN

    def _forget(self) -> None:
        """Half the cache starts anew; what it held stays at hand until the half fills up again, and is kept if met."""
        self.older = getattr(self, "ids", {}), getattr(self, "decoded", {})
        #: Of each run met: its ids as text joined by blanks, its decoded text; and runs without any id.
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.void: set[str] = set()
        self.held = 0

    def release(self) -> None:
        """Empties the cache: workers take turns, and memory kept by one that waits is lost to the others."""
        self._forget()
        self._forget()

    def _keep(self, w: str, joined: str, decoded: str) -> None:
        self.ids[w], self.decoded[w] = joined, decoded
        self.held += _ENTRY + getsizeof(w) + getsizeof(joined) + getsizeof(decoded)
        if not joined:
            self.void.add(w)

    def _missing(self, words: set[str]) -> set[str]:
        """Those of ``words`` that have to be encoded."""
        if self.held > self.cache_bytes // 2:
            self._forget()
        missing = words.difference(self.ids)
        ids, decoded = self.older
        known = [w for w in missing if w in ids]
        for w in known:
            self._keep(w, ids[w], decoded[w])
        return missing.difference(known)

    def _has_word_form(self) -> bool:
        form = json.loads(self.tokenizer.to_str())
        kinds = [n.get("type") for n in (form.get("normalizer") or {}).get("normalizers", [])]
        splits = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"].get("Regex") == _WORD_SPLIT
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and form["model"]["type"] == "BPE"
        )

    # ---- runs and their cache

    def _learn(self, words: list[str]) -> None:
        tokenize, letters, unsafe = self.tokenizer.model.tokenize, self.letters, _UNSAFE.search
        rest = []
        for w in words:
            if self.by_pieces and len(w) <= CACHED_RUN and not unsafe(w):
                low = w.lower()
                if not low.isascii():
                    low = low.encode().decode("latin-1").translate(letters)
                made = tokenize(low)
                self._keep(w, " ".join([str(t.id) for t in made]), " ".join([t.value for t in made]))
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False) if rest else ()):
            self._keep(w, " ".join(map(str, e.ids)), " ".join(e.tokens))

    def encode(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """The ids as text joined by blanks, and the decoded text, of each of a slice of texts."""
        parts = [self.runs.findall(text or "") for text in texts]
        missing = self._missing(set().union(*parts))
        if missing:
            self._learn(list(missing))
        out = []
        for runs in parts:
            if self.void and not self.void.isdisjoint(runs):
                runs = [w for w in runs if w not in self.void]
            joined = " ".join(map(self.ids.__getitem__, runs))
            if self.joins:
                out.append((joined, " ".join(map(self.decoded.__getitem__, runs))))
            else:
                out.append((joined, self.decode(np.fromstring(joined, np.int32, sep=" "))))
        for w in missing:
            if len(w) > CACHED_RUN:
                self.held -= _ENTRY + getsizeof(w) + getsizeof(self.ids.pop(w)) + getsizeof(self.decoded.pop(w))
                self.void.discard(w)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    # ---- pieces of long texts

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of ``text``, and the places of its first and last ``EDGE`` tokens or of all of them: those of
        the run for a cached one, of the token itself in a longer one."""
        words = self.runs.findall(text)
        distinct = set(words)
        missing = self._missing({w for w in distinct if len(w) <= CACHED_RUN})
        if missing:
            self._learn(list(missing))
        longer = {}
        for w in distinct:
            if len(w) > CACHED_RUN:
                e = self.tokenizer.encode(w, add_special_tokens=False)
                longer[w] = " ".join(map(str, e.ids)), e.offsets
        parts = [longer[w][0] if w in longer else self.ids[w] for w in words] if longer else list(map(self.ids.__getitem__, words))
        if longer or self.void:
            parts = [x for x in parts if x]
        ids = np.fromstring(" ".join(parts), np.int32, sep=" ")

        def places(start: int, most: float) -> np.ndarray:
            """Places of the tokens from a character on, up to about ``most`` of them."""
            found: list[tuple[int, int]] = []
            for m in self.runs.finditer(text, start):
                w, (a, b) = m.group(), m.span()
                if w in longer:
                    found += [(a + x, a + y) for x, y in longer[w][1]]
                elif self.ids[w]:
                    found += [(a, b)] * (self.ids[w].count(" ") + 1)
                if len(found) >= most:
                    break
            return np.array(found, np.int64).reshape(-1, 2)

        head, reach = places(0, EDGE)[:EDGE], 4 * EDGE
        if len(ids) <= EDGE:
            return ids, head, head
        while True:  # runs end at white space, so that the last of them are found from any blank on
            start = max(0, text.rfind(" ", 0, max(0, len(text) - reach)))
            tail = places(start, float("inf"))
            if len(tail) >= EDGE:
                return ids, head, tail[-EDGE:]
            reach *= 4

    def piece(self, text: str) -> Piece:
        ids, head, tail = self.tokens(text)
        return Piece(text, ids, head, tail - len(text))

    def join(self, left: Piece, right: Piece) -> Piece:
        """The piece of both texts; its ids are those of the whole."""
        mid, total = len(left.text), len(left.text) + len(right.text)
        reach = REACH
        while True:
            a, b = max(0, mid - reach), min(total, mid + reach)
            around = left.text[a:] + right.text[: b - mid]
            ids, places, tail = self.tokens(around)
            if a == 0 and b == total:
                return Piece(around, ids, places, tail - total)
            if len(ids) > len(places):  # a window beyond what places are kept of
                reach = total
                continue
            places = places + a
            window = [(i, s, e) for i, (s, e) in zip(ids.tolist(), places.tolist())]
            k, m = len(left.tail), len(right.head)
            before = [(i, s + mid, e + mid) for i, (s, e) in zip(left.ids[len(left.ids) - k :].tolist(), left.tail.tolist())]
            after = [(i, s + mid, e + mid) for i, (s, e) in zip(right.ids[:m].tolist(), right.head.tolist())]
            covered = (k == len(left.ids) or before[0][1] <= a) and (m == len(right.ids) or after[-1][2] >= b)
            start = (0, 0) if a == 0 else _meet(before, window, a, mid)
            stop = (m, len(window)) if b == total else _meet(after[::-1], window[::-1], mid, b)
            if a == 0:
                keep, x = 0, 0
            elif start:
                keep, x = len(left.ids) - k + start[0], start[1]
            if b == total:
                skip, y = len(right.ids), len(window)
            elif stop:
                skip, y = m - stop[0], len(window) - stop[1]
            if start and stop and x <= y:
                middle = places[x:y]
                joined = np.concatenate([left.ids[:keep], ids[x:y], right.ids[skip:]])
                gone, stays = len(left.ids) - keep, len(right.ids) - skip
                head, tail = left.head, right.tail
                if keep <= len(head):
                    head = np.concatenate([head[:keep], middle, right.head[skip:] + mid])
                if stays <= len(tail):
                    own = left.tail[: max(0, len(left.tail) - gone)]
                    tail = np.concatenate([own + mid - total, middle - total, tail[len(tail) - stays :]])
                return Piece(left.text + right.text, joined, head[:EDGE], tail[-EDGE:])
            reach = reach * 4 if covered else total

    def tree(self, pieces: list[Piece]) -> Piece:
        """Neighbours joined two by two, upward."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
        return pieces[0]


def _meet(side: list, window: list, low: int, high: int) -> tuple[int, int] | None:
    """The first ``AGREE`` tokens in a row, within low and high, that both have: how many tokens of each end there.

    For the right side both lists come reversed.
    """
    at = {t: k for k, t in enumerate(side) if t[1] >= low and t[2] <= high}
    found, last = 0, -1
    for k, t in enumerate(window):
        here = at.get(t)
        found = 0 if here is None else found + 1 if found and here == last + 1 else 1
        last = here
        if found == AGREE:
            return here + 1, k + 1
    return None


def halvings(length: int, piece: int = PIECE) -> int:
    """Pieces that halving makes of a text of this length."""
    count = 1
    while length > piece * count:
        count *= 2
    return count


def halves(text: str, piece: int = PIECE) -> list[str]:
    """``text`` cut into halves, those into halves, down to ``piece`` characters; cuts ignore what they fall on."""
    count = halvings(len(text), piece)
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process, so that the vocabulary is read once; tasks empty its cache when they end."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, ids array<int>, decoded string of every text."""
    return _encode(docs, path or vocabulary_path(), piece, "texts")


def digests(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encoded`` gives, hashed where it is made."""
    return _encode(docs, path or vocabulary_path(), piece, "digests")


def tokenised(docs: DataFrame, path: str | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded_sha256: the decoded text is hashed where it is made."""
    return _encode(docs, path or vocabulary_path(), piece, "ids")


_COLUMNS = {
    "texts": "ids array<int>, decoded string",
    "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string",
    "ids": "n_tokens long, ids array<int>, decoded_sha256 string",
}


def _columns(got: list[tuple[str, str]], kind: str) -> dict[str, pa.Array]:
    """The result columns of texts from their (ids as text, decoded text)."""

    def digest(x: str) -> str:
        return sha256(x.encode()).hexdigest()

    out = {}
    if kind != "texts":
        out["n_tokens"] = pa.array([joined.count(" ") + bool(joined) for joined, _ in got], pa.int64())
    if kind == "digests":
        out["ids_sha256"] = pa.array([digest(joined) for joined, _ in got], pa.string())
    else:
        ids = [np.fromstring(joined, np.int32, sep=" ") for joined, _ in got]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        out["ids"] = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
    if kind == "texts":
        out["decoded"] = pa.array([decoded for _, decoded in got], pa.string())
    else:
        out["decoded_sha256"] = pa.array([digest(decoded) for _, decoded in got], pa.string())
    return out


def _encode(docs: DataFrame, path: str, piece: int, kind: str) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for part in slices(batches, 1 << 19):
                columns = _columns(c.encode(part.column(1).to_pylist()), kind)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns.values()], ["doc_id", *columns])
        finally:
            c.release()

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > piece, F.lit(False))
    found = texts.filter(~is_long).mapInArrow(run, f"doc_id {id_type}, {_COLUMNS[kind]}")
    longest, characters = texts.filter(is_long).agg(F.max(F.length("text")), F.sum(F.length("text").cast("long"))).first()
    if longest is None:
        return found
    return found.unionByName(_long(texts.filter(is_long), path, piece, kind, longest, characters))


PIECES = "key binary, at long, text string, ids binary, head binary, tail binary"


def _long(texts: DataFrame, path: str, piece: int, kind: str, longest: int, characters: int) -> DataFrame:
    """The result of texts longer than ``piece``: pieces dealt, encoded and stored, then joined upward."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = halves(text.as_py(), piece)
                yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(parts), pa.binary()), "at": pa.array(range(len(parts)), pa.int64()), "text": parts})

    def record(key, at, pieces: list[Piece]) -> pa.RecordBatch:
        def raw(values, kind):
            return pa.array([np.ascontiguousarray(x, kind).tobytes() for x in values], pa.binary())

        made = [pa.array([p.text for p in pieces]), raw([p.ids for p in pieces], np.int32), raw([p.head for p in pieces], np.int64), raw([p.tail for p in pieces], np.int64)]
        return pa.RecordBatch.from_arrays([key, at, *made], ["key", "at", "text", "ids", "head", "tail"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            for part in slices(batches, 1 << 19):
                yield record(part.column(0), part.column(1), [c.piece(t) for t in part.column(2).to_pylist()])
        finally:
            c.release()

    def upward(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at").to_pylist()
        places = lambda raw: np.frombuffer(raw, np.int64).reshape(-1, 2)
        whole = codec(path).tree([Piece(r["text"], np.frombuffer(r["ids"], np.int32), places(r["head"]), places(r["tail"])) for r in rows])
        return pa.Table.from_batches([record(pa.array([rows[0]["key"]], pa.binary()), pa.array([rows[0]["at"] // FAN], pa.int64()), [whole])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                ids = np.frombuffer(one.column(1)[0].as_py(), np.int32)
                columns = _columns([(" ".join(map(str, ids.tolist())), c.decode(ids))], kind)
                yield pa.RecordBatch.from_arrays([one.column(0), *columns.values()], ["key", *columns])

    # A text is known by its hash, so that its pieces find one another; equal texts are encoded once.
    keyed = cut(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key"), "text"), "bpe-long")
    tasks = max(keyed.sparkSession.sparkContext.defaultParallelism, int(characters // DEALT))
    dealt = keyed.select("key", "text").mapInArrow(deal, "key binary, at long, text string").repartition(tasks, "key", "at")
    pieces = dealt.groupBy("key", "at").agg(F.first("text").alias("text"))
    pieces = cut(pieces.mapInArrow(encode, PIECES), "bpe-pieces")
    count = halvings(longest, piece)
    while count > 1:
        pieces = pieces.groupBy("key", F.floor(F.col("at") / FAN).alias("up")).applyInArrow(upward, PIECES)
        count = -(-count // FAN)
    found = cut(pieces.select("key", "ids").mapInArrow(finish, f"key binary, {_COLUMNS[kind]}"), "bpe-joined")
    return keyed.select("doc_id", "key").join(found, "key").drop("key")
