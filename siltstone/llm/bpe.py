"""Byte-level BPE as a bounded-lookahead streaming transducer.

The merge list itself fixes how far ahead a token can still be changed: a merge
(p, q) is undone only by an earlier merge that takes q, or a right part of q
before q is formed, together with what follows; that merge may in turn be
undone further right by a still earlier one. ``Merges.lookahead`` follows these
chains of falling ranks once through the list. A token that ends at least that
many bytes before the end of what has been read is final and is emitted, so a
text, or a single run of letters, of any length is encoded in constant memory.

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, text_bytes

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+")]
BLOCK = 4096  # bytes or characters handled at once beyond the lookahead
CACHED = 500_000  # entries of a worker's memo of words, emptied when full
LONGEST = 48  # characters of a memoised word
PART = 65_536  # characters of a text coded at once
SHORT = 64  # bytes of a stretch that is merged pair by pair, or together with others
LEARNT = 1_000_000  # bytes of texts whose words are coded together


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class Merges:
    """A vocabulary of byte strings and its ranked merges of pairs of ids.

    ``tokens`` has the bytes of each id, ``pairs`` the merges in rank order as
    (left id, right id, merged id). A merge may only use single bytes and
    results of earlier merges, and no two may give the same id: then applying
    the merges by rank and by position are the same thing.
    """

    def __init__(self, tokens: dict[int, bytes], pairs: list[tuple[int, int, int]], special: dict[str, int] | None = None):
        self.tokens, self.special = tokens, special or {}
        self.order = {(a, b): r for r, (a, b, _) in enumerate(pairs)}
        self.first = [0] * 256
        made = set()
        for i, t in tokens.items():
            if len(t) == 1:
                self.first[t[0]] = i
                made.add(i)
        for a, b, c in pairs:
            if a not in made or b not in made or c in made:
                raise ValueError("the merge list must be in order of training")
            made.add(c)
        self.pairs = pairs
        self.memo = self.table = None
        self.lookahead = self._lookahead()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.longest_special = max(map(len, self.special), default=0)

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        ids = spec["model"]["vocab"]
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
        pairs = []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((ids[a], ids[b], ids[a + b]))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens |= {i: t.encode() for t, i in special.items()}
        return cls(tokens, pairs, special)

    def _lookahead(self) -> int:
        """Bytes to the right of a token beyond which nothing changes it."""
        reach: dict[int, int] = {}  # of a token as it stands, through merges of lower rank than those still to come
        inner: dict[int, int] = {}  # through its right parts before it was formed
        for p, q, made in self.pairs:
            beyond = max(reach.get(q, 0), inner.get(q, 0))
            inner[made] = beyond
            reach[p] = max(reach.get(p, 0), len(self.tokens[q]) + beyond)
        return max([0, *reach.values(), *inner.values()])

    def merge(self, data: bytes) -> list[int]:
        """Ids of one stretch of bytes."""
        ids = [self.first[b] for b in data]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        order, none = self.order.get, len(self.pairs)
        ranks = [order(pair, none) for pair in zip(ids, ids[1:])]  # only a merge's neighbours change theirs
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [self.pairs[best][2]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = order((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = order((ids[at - 1], ids[at]), none)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of many short stretches, each round of merges made in all of them at once.

        A round takes one token from every stretch that is not done, so those
        of one length stay one table; shorter stretches join it when it has
        come down to theirs.
        """
        if self.table is None:
            width = max(self.tokens) + 1
            keys = np.array([a * width + b for a, b, _ in self.pairs], np.int64)
            by = np.argsort(keys)
            self.table = width, np.append(keys[by], -1), np.append(by, 0), np.array([c for _, _, c in self.pairs] or [0]), np.array(self.first)
        width, keys, ranks, made, first = self.table
        none = len(self.pairs)

        def rank(left, right):
            key = left * width + right
            at = np.searchsorted(keys[:-1], key)
            return np.where(keys[at] == key, ranks[at], none)

        out = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        ids, order, place = np.zeros((0, 0), np.int64), np.zeros((0, 0), np.int64), np.zeros(0, np.int64)

        def done(ids, place):
            size, data = 4 * ids.shape[1], ids.astype("<u4").tobytes()
            for n, i in enumerate(place.tolist()):
                out[i] = data[n * size:(n + 1) * size]

        for length in range(max(by_length, default=0), 0, -1):
            if own := by_length.get(length):
                more = first[np.frombuffer(b"".join([words[i] for i in own]), np.uint8)].reshape(-1, length)
                if len(place):
                    ids, order = np.concatenate([ids, more]), np.concatenate([order, rank(more[:, :-1], more[:, 1:])])
                else:
                    ids, order = more, rank(more[:, :-1], more[:, 1:])
                place = np.concatenate([place, own])
            if not len(place):
                continue
            if length == 1:
                done(ids, place)
                break
            row = np.arange(len(place))
            at = order.argmin(1)
            best = order[row, at]
            if (ended := best == none).any():
                done(ids[ended], place[ended])
                ids, order, place, at, best, row = ids[~ended], order[~ended], place[~ended], at[~ended], best[~ended], row[: len(row) - ended.sum()]
            ids[row, at] = made[best]
            kept = np.ones(ids.shape, bool)
            kept[row, at + 1] = False
            ids = ids[kept].reshape(len(place), length - 1)
            kept = np.ones(order.shape, bool)
            kept[row, at] = False
            order = order[kept].reshape(len(place), length - 2)
            for side in (at - 1, at):  # the pairs beside what was merged
                r = np.flatnonzero((side >= 0) & (side < length - 2))
                order[r, side[r]] = rank(ids[r, side[r]], ids[r, side[r] + 1])
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, order = len(ids), self.order
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(order[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in order]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or order.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j] = self.pairs[r][2], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (found := order.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (found, a))
        return [i for i in ids if i >= 0]


class Transducer:
    """Ids of one pre-token that arrives in parts; memory stays below lookahead and block."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block, self.pending = merges, block, b""

    def feed(self, data: bytes) -> list[int]:
        out = []
        for lo in range(0, len(data), self.block):
            self.pending += data[lo:lo + self.block]
            if len(self.pending) > self.merges.lookahead + self.block:
                end, stable = 0, len(self.pending) - self.merges.lookahead
                for i in self.merges.merge(self.pending):
                    size = len(self.merges.tokens[i])
                    if end + size > stable:
                        break
                    end += size
                    out.append(i)
                self.pending = self.pending[end:]
        return out

    def finish(self) -> list[int]:
        out = self.merges.merge(self.pending)
        self.pending = b""
        return out


class StreamEncoder:
    """Ids of a text that arrives in parts, each as soon as it is final."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block = merges, block
        self.text = ""  # not split yet
        self.run = None  # class of a long pre-token that is under way
        self.word = Transducer(merges, block)

    def feed(self, text: str) -> list[int]:
        out = []
        for lo in range(0, len(text), self.block):
            self.text += text[lo:lo + self.block]
            out += self._drain(False)
        return out

    def finish(self) -> list[int]:
        return self._drain(True)

    def _drain(self, last: bool) -> list[int]:
        out, special = [], self.merges.split
        if special:
            while found := special.search(self.text):
                rest = self.text[found.end():]
                self.text = self.text[:found.start()]
                out += self._ordinary(True) + [self.merges.special[found[0]]]
                self.text = rest
        held = ""
        if special and not last:  # what may become a special token waits
            for n in range(min(self.merges.longest_special - 1, len(self.text)), 0, -1):
                if any(s.startswith(self.text[-n:]) for s in self.merges.special):
                    held, self.text = self.text[-n:], self.text[:-n]
                    break
        out += self._ordinary(last, len(held))
        self.text += held
        return out

    def _ordinary(self, last: bool, held: int = 0) -> list[int]:
        """Pre-tokens of self.text; unless ``last``, what later text may change stays."""
        out, at, text = [], 0, self.text
        if self.run is not None:
            found = RUNS[self.run].match(text)
            end = found.end() if found else 0
            if self.run == 3 and end:  # the last space may belong to the next word
                whole = end == len(text)
                end -= 1 if (not last or not whole) else 0
                out += self.word.feed(text[:end].encode())
                at = end
                if whole and not last:
                    self.text = text[at:]
                    return out
            else:
                out += self.word.feed(text[:end].encode())
                at = end
                if end == len(text) and not last:
                    self.text = ""
                    return out
            out += self.word.finish()
            self.run = None
        while at < len(text):
            found = PATTERN.match(text, at)
            if not last and found.end() + 3 > len(text):
                if found.end() - at > max(self.block, 3):  # longer than any contraction
                    kind = next(k for k, run in enumerate(RUNS) if run.match(found[0].lstrip(" ") or found[0]))
                    if found[0].isspace():
                        kind = 3
                    end = found.end() - (kind == 3)
                    if found.end() == len(text):
                        self.run = kind
                        out += self.word.feed(text[at:end].encode())
                        at = end
                break
            out += self.word.feed(found[0].encode()) + self.word.finish()
            at = found.end()
        self.text = text[at:]
        return out


class ByteToText:
    """Text of ids that arrive in parts; bytes of an unfinished character wait."""

    def __init__(self, merges: Merges):
        self.tokens = merges.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


class WordMemo(dict):
    """Little-endian ids that the transducer gives for words, as they follow a single space.

    A word holds no space at its ends, so the pre-tokens before and after it
    are split from it whatever they are. Other pre-tokens of short words have a
    memo of their own. Both have a bounded number of entries, each of a bounded
    length.
    """

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.transducer = merges, Transducer(merges)
        self.cuts = not any(c.isspace() for token in merges.special for c in token)
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of(cls, merges: Merges) -> WordMemo:
        """The one memo of ``merges`` in this process, so that a worker's next task finds what its last one coded."""
        if merges.memo is None:
            merges.memo = cls(merges)
        return merges.memo

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise KeyError(word)
        if word.isalpha():  # one pre-token
            ids = self._coded(" " + word)
        elif len(word) <= LONGEST and not (self.merges.split and self.merges.split.search(word)):
            ids = b"".join(map(self._part, PATTERN.findall(" " + word)))
        else:
            ids = self.plain(" " + word)
        if len(word) <= LONGEST:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids

    def learn(self, texts: list[str]) -> None:
        """Take in the short words of ``texts`` together; what is left out is coded when it is met."""
        words = set().union(*(text.split(" ") for text in texts))
        unseen = [w for w in words if w not in self]
        if len(self) + len(unseen) > CACHED:
            self.clear()
            unseen = words
        split = {}
        for w in unseen:
            if w.isalpha():
                if len(w) <= LONGEST:
                    split[w] = (" " + w,)
            elif w and len(w) <= LONGEST and not w[0].isspace() and not w[-1].isspace() and not (self.merges.split and self.merges.split.search(w)):
                split[w] = PATTERN.findall(" " + w)
        parts = list({p for of in split.values() for p in of})
        coded = [p.encode() for p in parts]
        short = [i for i, x in enumerate(coded) if len(x) <= SHORT]
        ids = dict(zip([parts[i] for i in short], self.merges.merge_many([coded[i] for i in short])))
        for w, of in split.items():
            if len(self) >= CACHED:
                break
            self[w] = b"".join([ids[p] if p in ids else self._part(p) for p in of])

    def _coded(self, part: str) -> bytes:
        return np.array(self.transducer.feed(part.encode()) + self.transducer.finish(), "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of a pre-token of a short word."""
        if part[0] == " " and part[1:].isalpha():
            return self[part[1:]]
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= CACHED // 4:
                self.parts.clear()
            ids = self.parts[part] = self._coded(part)
        return ids

    def plain(self, text: str) -> bytes:
        encoder = StreamEncoder(self.merges)
        return np.array(encoder.feed(text) + encoder.finish(), "<u4").tobytes()

    def _end(self, text: str, lo: int) -> int:
        """Where a part from ``lo`` of about ``PART`` characters ends: before a single space between two words."""
        if not self.cuts or len(text) - lo <= PART:
            return len(text)

        def splits(c):
            return not text[c - 1].isspace() and c + 1 < len(text) and not text[c + 1].isspace()

        c = text.rfind(" ", lo + 1, lo + PART)
        while c >= 0 and not splits(c):
            c = text.rfind(" ", lo + 1, c)
        if c < 0:
            c = text.find(" ", lo + PART)
            while c >= 0 and not splits(c):
                c = text.find(" ", c + 1)
        return c if c >= 0 else len(text)

    def encode(self, text: str):
        """Little-endian ids of a text, part by part; a part is of a bounded length whatever the text."""
        lo = 0
        while lo < len(text):
            hi = self._end(text, lo)
            if hi - lo > 2 * PART:  # nowhere to split: the stream goes through it
                encoder = StreamEncoder(self.merges)
                for at in range(lo, hi, PART):
                    yield np.array(encoder.feed(text[at: min(hi, at + PART)]), "<u4").tobytes()
                yield np.array(encoder.finish(), "<u4").tobytes()
            else:
                part = text[lo:hi]
                if len(text) > PART:
                    self.learn([part])
                words = part.split(" ")
                try:
                    first = b"" if lo and not words[0] else self._first(words[0])
                    yield first + b"".join(map(self.__getitem__, words[1:]))
                except KeyError:  # several spaces in a row, or other space beside one
                    yield self.plain(part)
            lo = hi

    def _first(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise KeyError(word)
        return self.plain(word)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row; a null text counts as empty.

    Repeated rows and null ids give one row each; other columns are ignored; an
    empty table gives no rows. Ids are hashed and decoded as they are emitted:
    beside the row's own text a task holds a part of it and a bounded memo.
    ``path`` is the vocabulary file, read once by the driver and broadcast (its
    size does not depend on the data).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Merges.load(path))

    def run(batches):
        import pyarrow as pa

        merges = sent.value
        memo = WordMemo.of(merges)
        for b in batches:
            counts, ids_hash, text_hash = [], [], []
            for first, last in slices(text_bytes(b.column(1))[1], LEARNT):
                texts = [value or "" for value in b.column(1).slice(first, last - first).to_pylist()]
                memo.learn([text for text in texts if len(text) <= PART])
                for text in texts:
                    n, ids, decoded, back = 0, hashlib.sha256(), hashlib.sha256(), ByteToText(merges)
                    for part in memo.encode(text):
                        n += len(part) // 4
                        ids.update(part)
                        decoded.update(back.feed(np.frombuffer(part, "<u4").tolist()).encode())
                    decoded.update(back.finish().encode())
                    counts.append(n)
                    ids_hash.append(ids.hexdigest())
                    text_hash.append(decoded.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
