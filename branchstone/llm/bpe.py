"""BPE encoding and decoding, speculate and verify."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pretokens, split
from .textscan import pieces

LONG = 1 << 20  # bytes of a text that is encoded part by part
BLOCK = 1 << 12  # bytes of a word that is encoded block by block
SHORT = 48  # bytes of a word that is merged by scanning
NONE = (1 << 60, -1)
MOST_WORDS = 400_000  # that a worker remembers; then it begins anew
MOST_HELD = 32 << 20  # characters of these words; likewise
MOST_PAIRS = 2_000_000  # likewise


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: its own where it has one, else one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer.json with a byte-level BPE model: token bytes, merges and special tokens."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = spec["added_tokens"]
    if model["type"] != "BPE" or not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    of = byte_characters()
    special = {t["content"]: t["id"] for t in added}
    tokens = {i: t.encode() if t in special else bytes(of[c] for c in t) for t, i in model["vocab"].items()}
    tokens |= {i: t.encode() for t, i in special.items()}
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {"tokens": [tokens.get(i, b"") for i in range(max(tokens) + 1)], "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges], "special": special}


class Codec:
    """Encodes and decodes with one vocabulary; remembers words and pairs it has seen."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.tokens, self.special = tokens, special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        apart = set(special.values())
        self.ids = {t: i for i, t in enumerate(tokens) if t and i not in apart}
        self.single = [self.ids[bytes((b,))] for b in range(256)]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in reversed(list(enumerate(merges)))}
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.compatible: dict[int, bool] = {}  # pair code -> whether the two tokens stay as they are side by side
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.exact_words = self.seen_words = 0
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.held = 0
        self.flat, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self._add(list(self.special), [[i] for i in self.special.values()])

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        self.held += sum(map(len, words))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))
        self.sizes = np.r_[self.sizes, np.fromiter(map(len, ids), np.int64, len(ids))]
        self.flat = np.r_[self.flat, np.array([i for x in ids for i in x], np.int64)]
        self.offset = np.cumsum(self.sizes) - self.sizes

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place; tokens that begin with the same two bytes bound its length."""
        ids, reach, out, at, n = self.ids, self.reach, [], 0, len(word)
        while at < n:
            end = min(n, at + reach.get(word[at : at + 2], 1))
            while (found := ids.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost first, until none is left."""
        if len(word) > BLOCK:
            return [i for block in self.blocks(word) for i in block]
        return self._merged(word)

    def _merged(self, word: bytes) -> list[int]:
        part = [self.single[b] for b in word]
        if len(part) > SHORT:
            return self._exact_long(part)
        rank, none = self.rank.get, NONE
        ranks = [rank(pair, none)[0] for pair in zip(part, part[1:], strict=False)]
        while ranks and (low := min(ranks)) < none[0]:
            k = ranks.index(low)
            part[k : k + 2] = [rank((part[k], part[k + 1]))[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((part[k], part[k + 1]), none)[0]
            if k:
                ranks[k - 1] = rank((part[k - 1], part[k]), none)[0]
        return part

    def _exact_long(self, part: list[int]) -> list[int]:
        """The same with a heap of pairs, for words where looking for the lowest again and again would be slow."""
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r[0], k, a, b) for k, (a, b) in enumerate(zip(part, part[1:], strict=False)) if (r := self.rank.get((a, b)))]
        heapify(heap)
        while heap:
            _, k, a, b = heappop(heap)
            j = after[k]
            if part[k] != a or j >= len(part) or part[j] != b:
                continue  # one of the two has merged otherwise
            part[k], part[j] = self.rank[a, b][1], -1
            after[k] = after[j]
            if after[k] < len(part):
                before[after[k]] = k
                if r := self.rank.get((part[k], part[after[k]])):
                    heappush(heap, (r[0], k, part[k], part[after[k]]))
            if before[k] >= 0 and (r := self.rank.get((part[before[k]], part[k]))):
                heappush(heap, (r[0], before[k], part[before[k]], part[k]))
        return [x for x in part if x >= 0]

    def _proposed(self, block: bytes) -> list[int]:
        """The encoding of a few bytes by themselves: greedy if that holds, exact if not."""
        out = self.greedy(block)
        good = all(map(self._stays, out)) and all(self._pair(a << 32 | b) for a, b in zip(out, out[1:], strict=False))
        return out if good else self._merged(block)

    def blocks(self, word: bytes) -> Iterator[list[int]]:
        """The ids of a long word, some at a time: blocks are encoded by themselves and joined where that changes nothing.

        Two encodings side by side are that of both if the tokens that meet are compatible. If they are not, tokens on
        both sides are encoded anew, more and more of them, until those that meet are. Little more than a block is held."""
        held: list[int] = []
        gone = False
        for at in range(0, len(word), BLOCK):
            new = self._proposed(word[at : at + BLOCK])
            back = ahead = 0
            left = right = not held or self._pair(held[-1] << 32 | new[0])
            middle: list[int] = []
            while not (left and right):
                back, ahead = (back if left and back else 2 * back + 4), (ahead if right and ahead else 2 * ahead + 4)
                low, high = max(0, len(held) - back), min(len(new), ahead)
                if not low and gone:
                    raise RuntimeError("a pair of tokens far back is not settled")
                middle = self._merged(b"".join(self.tokens[i] for i in [*held[low:], *new[:high]]))
                left = not low or self._pair(held[low - 1] << 32 | middle[0])
                right = high == len(new) or self._pair(middle[-1] << 32 | new[high])
            if middle:
                held, new = held[:low], [*middle, *new[high:]]
            held += new
            if len(held) > 4 * BLOCK:
                yield held[:-BLOCK]
                held, gone = held[-BLOCK:], True
        if held:
            yield held

    def _pair(self, code: int) -> bool:
        if (known := self.compatible.get(code)) is None:
            a, b = code >> 32, code & 0xFFFFFFFF
            if len(self.compatible) > MOST_PAIRS:
                self.compatible.clear()
            known = self.compatible[code] = self._merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _stays(self, i: int) -> bool:
        if (known := self.compatible.get(~i)) is None:
            known = self.compatible[~i] = self._merged(self.tokens[i]) == [i]
        return known

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Proposes tokens greedily, checks every adjacent pair, and merges exactly only the words that fail.

        Tokens are the BPE encoding of their bytes if and only if each is its own encoding and each adjacent pair is.
        Words of more than BLOCK bytes go by blocks."""
        out = [self.greedy(w) if len(w) <= BLOCK else self.exact(w) for w in words]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for x in out for i in x), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(out)), size)
        inner = np.flatnonzero(of[1:] == of[:-1])
        fails = np.zeros(len(out), bool)
        for codes, check, place in ((flat[inner] << 32 | flat[inner + 1], self._pair, of[inner]), (flat, self._stays, of)):
            code, back = np.unique(codes, return_inverse=True)
            good = np.fromiter(map(check, code.tolist()), bool, len(code))
            fails[place[~good[back]]] = True
        for k in np.flatnonzero(fails).tolist():
            out[k] = self.exact(words[k])
        self.seen_words += len(out)
        self.exact_words += int(fails.sum())
        return out

    def runs(self, text: str) -> Iterator[list[str]]:
        """The words of a long text, some at a time; special tokens are cut out before."""
        at = 0
        for found in self.split_special.finditer(text) if self.split_special else ():
            yield from pretokens(text[at : found.start()])
            yield [found[0]]
            at = found.end()
        yield from pretokens(text[at:] if at else text)

    def long_ids(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text of any length, some at a time."""
        for words in self.runs(text):
            if len(words) == 1 and len(raw := words[0].encode()) > BLOCK and words[0] not in self.special:
                yield from (np.array(x, np.int64) for x in self.blocks(raw))
            elif words:
                yield self.ids_of(words)[0]

    def pretokens(self, text: str) -> list[str]:
        if self.split_special is None or not any(s in text for s in self.special):
            return split(text)
        return [w for k, part in enumerate(self.split_special.split(text)) for w in ([part] if k % 2 else split(part))]

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and where each word's begin and the last one's end."""
        if len(self.words) > MOST_WORDS or self.held > MOST_HELD:
            self.forget()
        if fresh := list(set(words).difference(self.words)):
            self._add(fresh, self.encode_words([w.encode() for w in fresh]))
        index = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sizes = self.sizes[index]
        sums = np.r_[0, np.cumsum(sizes)]
        return self.flat[np.repeat(self.offset[index] - sums[:-1], sizes) + np.arange(sums[-1])], sums

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        lists = [self.pretokens(t) for t in texts]
        ids, sums = self.ids_of([w for x in lists for w in x])
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        return ids, np.diff(np.r_[0, sums[ends]])

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of some tokens."""
        sizes = self.size[ids]
        sums = np.r_[0, np.cumsum(sizes)]
        return self.bytes[np.repeat(self.at[ids] - sums[:-1], sizes) + np.arange(sums[-1])].tobytes()

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts in UTF-8; bytes that are none become replacement characters."""
        data, sums = self.raw(ids), np.r_[0, np.cumsum(self.size[ids])]
        ends = sums[np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:], strict=False)]


def codec_of(held: dict) -> Codec:
    """The codec of a broadcast vocabulary, which a worker builds once and keeps from task to task."""
    if "codec" not in held:
        held["codec"] = Codec(held["tokens"], held["merges"], held["special"])
    return held["codec"]


def long_digests(codec: Codec, text: str) -> tuple[int, str, str]:
    """Count and digests of a text that is encoded and decoded part by part, so that no list of all its tokens is held."""
    count, of_ids, of_text, decoder = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
    for ids in codec.long_ids(text):
        count += len(ids)
        of_ids.update(ids.astype("<u4"))
        of_text.update(decoder.decode(codec.raw(ids)).encode())
    of_text.update(decoder.decode(b"", True).encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()


def _encoded(vocabulary, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary.value)
        for batch in batches:
            for a, b, texts in pieces(batch, batch.num_columns - 1):
                if digests and len(texts[0]) > LONG:  # alone in its piece
                    found = long_digests(codec, texts[0].decode("utf-8", "replace"))
                    columns = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x]) for x in found)], names=[*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                ids, counts = codec.encode([t.decode("utf-8", "replace") for t in texts])
                decoded, ends = codec.decode(ids, counts), np.r_[0, np.cumsum(counts)]
                columns = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                columns.append(pa.array(counts))
                if digests:
                    raw = ids.astype("<u4")
                    columns.append(pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)], pa.string()))
                    columns.append(pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    columns.append(pa.array([d.decode() for d in decoded], pa.string()))
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *names])

    return run


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns `carry` of df (default: all but the text) with n_tokens, ids and decoded for each row.

    path: a tokenizer.json with a byte-level BPE model, read by the driver and broadcast (its size is the vocabulary's).
    Special tokens within a text become their ids; none is added. digests: return ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the UTF-8 form), as hex, in place of ids and decoded.
    Null and empty texts have no tokens; repeated rows each get their row; columns of df with the names of the new ones
    are replaced; an empty table gives an empty result. A text of any length is encoded whole."""
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    carry = [c for c in (carry or df.columns) if c != text_col and c.lower() not in new]
    rows = df.select(*[f"`{c}`" for c in carry], F.col(text_col).cast("binary").alias("__text"))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), kinds])
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    return rows.mapInArrow(_encoded(vocabulary, digests), schema)
