"""Byte-pair encoding as a streaming transducer, and decoding as a state machine.

Encoding reads a pretoken left to right.  For every prefix it keeps the last token of
that prefix's encoding: the one token that ends there and may stand behind the last
token of the prefix before it.  Whether b may follow a is a matter of the merge list
alone: the tokens on a's right edge and b's left edge must have no merge that would have
come before they were absorbed into a and b.  Two encodings that agree on a prefix share
its tokens, so a token is *stable*, and emitted, once the paths back from all prefixes
that a later token can start at run through it.  The merge list bounds how far that
looks ahead (``lookahead``); a transducer holds about as many bytes, however long its input.

Texts are cut into pretokens window by window, and the ids of short pretokens are kept
in a dictionary of bounded size.  Decoding turns ids into bytes and bytes into text
incrementally, holding an unfinished character at most.

Defined cases.  A null text is empty and has no ids.  Special tokens written in a text
become their ids, as the library does by default.  Repeated rows are encoded each; no
rows give no rows.  A merge list in which two merges make the same token is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.blocks import text_blocks

# Fixed value: how this kind of tokenizer cuts texts; white space is the Unicode property.
_S = r"\p{White_Space}"
PRETOKENS = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+")
# Characters that decide a match beyond its end: two letters of a contraction, or one after white space.
_MARGIN = 3
WINDOW_CHARS = 1 << 16
KEPT_PRETOKENS, KEPT_BYTES, KEPT_PAIRS, KEPT_BEGINNINGS = 500_000, 48, 600_000, 1_000_000
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Merges:
    """A merge list with what the transducer needs of it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet, vocab = byte_alphabet(), content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in plain.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        rules = [tuple(m if isinstance(m, list) else m.split(" ")) for m in content["model"]["merges"]]
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], rank) for rank, (a, b) in enumerate(rules)}
        if len(self.parts) != len(rules):
            raise ValueError("two merges make the same token")
        self.rank = {a << 20 | b: rank for a, b, rank in self.parts.values()}
        self.longest = max(map(len, self.bytes.values()))
        # Tokens on either edge of a token, with the rank of the merge that absorbs each; the token itself last absorbed.
        self.right_edge = {i: self._edge(i, 1) for i in plain.values()}
        self.left_edge = {i: self._edge(i, 0) for i in plain.values()}
        stable: dict[int, bool] = {}
        for i in [i for i in plain.values() if i not in self.parts] + list(self.parts):
            if i not in self.parts:
                stable[i] = len(self.bytes[i]) == 1
            else:
                a, b, rank = self.parts[i]
                stable[i] = stable[a] and stable[b] and not self._conflict(a, b, rank)
        self.by_bytes = {self.bytes[i]: i for i, ok in stable.items() if ok}
        self.lookahead = self._lookahead()
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        edge, absorbed = [], _NEVER
        while True:
            edge.append((token, absorbed))
            if token not in self.parts:
                return edge
            absorbed, token = self.parts[token][2], self.parts[token][side]

    def _conflict(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether a merge across the border of a and b would come before both stand whole, or before ``until``."""
        rank_of, left_edge = self.rank.get, self.left_edge[b]
        for x, x_absorbed in self.right_edge[a]:
            x <<= 20
            for y, y_absorbed in left_edge:
                rank = rank_of(x | y)
                # Of equal merges the left one goes first: it wins against y being absorbed, not against x.
                if rank is not None and rank < x_absorbed and rank <= y_absorbed and rank < until:
                    return True
        return False

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = not self._conflict(a, b)
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
        return known

    def _lookahead(self) -> int:
        """Bytes behind a border that can decide about it.

        A token stands unless a token on its right edge is merged, by an earlier rule, with
        one that follows; whether that one stands is decided in the same way by still
        earlier rules.  ``reach[t]`` lists (rank, bytes) of such chains that begin with a
        merge of t as left part, longest so far; ranks fall along a chain, so going
        through the rules in order sees every chain's end before its beginning.
        """
        reach: dict[int, list[tuple[int, int]]] = {}
        most = 0
        for a, b, rank in sorted(self.parts.values(), key=lambda p: p[2]):
            onward = 0
            for token, absorbed in self.right_edge[b]:
                limit = min(rank, absorbed)
                onward = max([onward, *(n for r, n in reach.get(token, ()) if r < limit)])
            n = len(self.bytes[b]) + onward
            most = max(most, n)
            known = reach.setdefault(a, [])
            if not known or n > known[-1][1]:
                known.append((rank, n))
        return most + self.longest


class Transducer:
    """Encodes one pretoken that arrives in pieces."""

    def __init__(self, merges: Merges):
        self._merges, self._data, self._before = merges, b"", None
        self._token, self._start = [None], [0]  # of the prefix that ends at each place of _data

    def feed(self, data: bytes) -> list[int]:
        """The ids that became stable."""
        out, step = [], max(1024, self._merges.lookahead)
        for at in range(0, len(data), step):
            self._read(data[at:at + step])
            out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._path(len(self._data))
        self.__init__(self._merges)
        return out

    def held(self) -> int:
        return len(self._data)

    def _read(self, more: bytes) -> None:
        merges, first = self._merges, len(self._data) + 1
        self._data = data = self._data + more
        get, token, start = merges.by_bytes.get, self._token, self._start
        for end in range(first, len(data) + 1):
            for at in range(max(0, end - merges.longest), end):
                found = get(data[at:end])
                if found is not None:
                    left = token[at] if at else self._before
                    if left is None or merges.may_follow(left, found):
                        token.append(found)
                        start.append(at)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _path(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self._token[end])
            end = self._start[end]
        return out[::-1]

    def _stable(self) -> list[int]:
        """Emit up to where the paths of all prefixes that later tokens can start at have met."""
        live = set(range(max(0, len(self._data) - self._merges.longest + 1), len(self._data) + 1))
        while len(live) > 1:
            furthest = max(live)
            live.remove(furthest)
            live.add(self._start[furthest])
        met = live.pop()
        out = self._path(met)
        if out:
            self._before = out[-1]
            self._data = self._data[met:]
            self._token = [None, *self._token[met + 1:]]
            self._start = [0, *(s - met for s in self._start[met + 1:])]
        return out


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self._pretokens = regex.compile(PRETOKENS)
        names = sorted(self.merges.special, key=len, reverse=True)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._known: dict[str, bytes] = {}
        self._last: dict[bytes, int] = {}  # of beginnings of pretokens: their last token

    def _short(self, pretoken: str) -> bytes:
        """The transducer on a pretoken at once; beginnings shared with earlier ones are not read again."""
        data, merges = pretoken.encode("utf-8", "replace"), self.merges
        if len(data) > KEPT_BYTES:
            machine = Transducer(merges)
            return array("I", machine.feed(data) + machine.finish()).tobytes()
        get, last, pairs = merges.by_bytes.get, self._last, merges.pairs
        n = done = len(data)
        whole = get(data)
        if whole is not None:
            return array("I", (whole,)).tobytes()
        while done and data[:done] not in last:
            done -= 1
        for end in range(done + 1, n + 1):
            for at in range(end):
                found = get(data[at:end])
                if found is not None:
                    if at:
                        left = last[data[:at]]
                        fits = pairs.get(left << 20 | found)
                        if not (merges.may_follow(left, found) if fits is None else fits):
                            continue
                    last[data[:end]] = found
                    break
        out, token_bytes = [], merges.bytes
        while n:
            out.append(last[data[:n]])
            n -= len(token_bytes[out[-1]])
        return array("I", out[::-1]).tobytes()

    def ids(self, text: str) -> Iterator[bytes]:
        """Little-endian 32-bit ids, in pieces."""
        for part in self._specials.split(text) if self._specials else [text]:
            if self._specials and part in self.merges.special:
                yield array("I", [self.merges.special[part]]).tobytes()
            elif part:
                yield from self._plain(part)

    def _plain(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            end = min(len(text), at + WINDOW_CHARS)
            window = text[at:end] if at or end < len(text) else text
            pretokens = self._pretokens.findall(window)
            size = len(window)
            if end < len(text):
                while pretokens and size > len(window) - _MARGIN:
                    size -= len(pretokens.pop())
            if not pretokens:  # one pretoken fills the window
                yield from self._long(text, at, end := self._pretokens.match(text, at).end())
                at = end
                continue
            yield self._known_ids(pretokens)
            at += size if end < len(text) else len(window)

    def _long(self, text: str, at: int, end: int) -> Iterator[bytes]:
        machine = Transducer(self.merges)
        for k in range(at, end, 4096):
            yield array("I", machine.feed(text[k:min(k + 4096, end)].encode("utf-8", "replace"))).tobytes()
        yield array("I", machine.finish()).tobytes()

    def _known_ids(self, pretokens: list[str]) -> bytes:
        known = self._known
        fresh = set(pretokens).difference(known)
        if fresh:
            if len(known) + len(fresh) > KEPT_PRETOKENS:
                known = self._known = {}
                fresh = set(pretokens)
            if len(self._last) > KEPT_BEGINNINGS:
                self._last.clear()
            known.update((p, self._short(p)) for p in fresh)
        out = b"".join(map(known.__getitem__, pretokens))
        for p in fresh if len(fresh) > KEPT_PRETOKENS else [p for p in fresh if len(p) > KEPT_BYTES]:
            del known[p]
        return out


class Decoder:
    """Text of ids that arrive in pieces; characters may lie across pieces."""

    def __init__(self, token_bytes: dict[int, bytes]):
        self._bytes, self._text = token_bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self._text.decode(b"".join(map(self._bytes.__getitem__, ids)))

    def finish(self) -> str:
        return self._text.decode(b"", True)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: binary of little-endian 32-bit ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                yield pa.record_batch([batch["doc_id"].slice(first, len(texts)),
                                       pa.array([b"".join(ids(t.decode("utf-8", "replace"))) for t in texts], pa.binary())],
                                      names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of what ``encode`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_bytes = encoder(path).merges.bytes
        for batch in batches:
            texts = []
            for ids in batch["ids"].to_pylist():
                machine = Decoder(token_bytes)
                texts.append(machine.feed(np.frombuffer(ids or b"", "<u4").tolist()) + machine.finish())
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded and decoded again.

    Ids are digested and decoded as they leave the transducer, so none are held for a whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = encoder(path)
        for batch in batches:
            for first, texts in text_blocks(batch["text"]):
                rows = [_digest(machine, t.decode("utf-8", "replace")) for t in texts]
                yield pa.record_batch([batch["doc_id"].slice(first, len(texts)),
                                       *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string())))],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _digest(machine: Encoder, text: str) -> tuple[int, str, str]:
    n, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(machine.merges.bytes)
    for ids in machine.ids(text):
        n += len(ids) // 4
        of_ids.update(ids)
        of_text.update(decoder.feed(np.frombuffer(ids, "<u4").tolist()).encode())
    of_text.update(decoder.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()
