"""Token counts under a unigram model: distinct pre-tokens in a trie, one forward score for each shared prefix."""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import pretokens
from .textscan import pieces

MOST_NODES = 1_000_000  # of a worker's trie; then it begins anew
MOST_BYTES = 64 << 20  # of the words that end in it; likewise
LONG = 1 << 8  # bytes of a pre-token that is scored without nodes
SHIFT = 32  # a score is its cost above so many bits, and its number of tokens
UNKNOWN = 30_000_000  # the cost of a byte that is no token


def read_costs(path: str) -> dict[bytes, int]:
    """Cost of each token of a ranks file (base64 token, rank): minus the logarithm of Zipf's share of its rank, in
    whole millionths, so that sums do not depend on their order. The constant of that law is left out."""
    lines = Path(path).read_bytes().splitlines()
    return {base64.b64decode(t): round(1e6 * math.log(int(rank) + 2)) for t, rank in (line.split() for line in lines if line)}


class Trie:
    """Distinct pre-tokens as byte paths. Each node has the forward score of its prefix, the least cost and of equally
    cheap ones the fewest tokens, as one number; a word's count of tokens is stored where it ends."""

    def __init__(self, costs: dict[bytes, int]):
        self.scores = {t: cost << SHIFT | 1 for t, cost in costs.items()}
        self.unknown = UNKNOWN << SHIFT | 1
        self.reach: dict[bytes, int] = {}  # the longest token that ends with these two bytes
        for t in costs:
            self.reach[t[-2:]] = max(len(t), self.reach.get(t[-2:], 1))
        self.longest = max(map(len, costs), default=1)
        self.forget()

    def forget(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.best: list[int] = [0]  # the score of each node
        self.terminal: dict[str, int] = {"": 0}
        self.held = 0

    def step(self, raw: bytes, end: int, path: list[int], shift: int = 0) -> int:
        """The score of raw up to `end`; path[k - shift] is that of its first k bytes."""
        scores = self.scores
        low = path[end - 1 - shift] + scores.get(raw[end - 1 : end], self.unknown)
        for begin in range(max(0, end - self.reach.get(raw[max(0, end - 2) : end], 1)), end - 1):
            if (score := scores.get(raw[begin:end])) is not None and path[begin - shift] + score < low:
                low = path[begin - shift] + score
        return low

    def insert(self, raw: bytes) -> int:
        child, best = self.child, self.best
        node, path = 0, [0]
        for end, byte in enumerate(raw, 1):
            key = node << 8 | byte
            if (node := child.get(key, 0)) == 0:
                node = child[key] = len(best)
                best.append(self.step(raw, end, path))
            path.append(best[node])
        return best[node]

    def rolling(self, raw: bytes) -> int:
        """The score of a long word: of its prefixes only the last ones that a token can reach back to are held."""
        path, shift, keep = [0], 0, max(self.longest, 1)
        for end in range(1, len(raw) + 1):
            path.append(self.step(raw, end, path, shift))
            if len(path) > 4096 + keep:
                shift += len(path) - keep
                del path[:-keep]
        return path[-1]

    def count(self, word: str) -> int:
        raw = word.encode()
        if len(raw) > LONG:
            return self.rolling(raw) & ((1 << SHIFT) - 1)
        if len(self.best) > MOST_NODES or self.held > MOST_BYTES:
            self.forget()
        self.held += len(raw)
        n = self.terminal[word] = self.insert(raw) & ((1 << SHIFT) - 1)
        return n

    def counts(self, words: list[str]) -> int:
        """Tokens of a list of pre-tokens."""
        known, total = self.terminal.get, 0
        for word, times in Counter(words).items():
            if (n := known(word)) is None:
                n = self.count(word)
                known = self.terminal.get
            total += n * times
        return total


def _counted(costs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = costs.value
        if "trie" not in held:  # a worker builds it once and keeps it from task to task
            held["trie"] = Trie(held["costs"])
        trie = held["trie"]
        for batch in batches:
            for a, b, texts in pieces(batch, batch.num_columns - 1):
                found = []
                for text in texts:
                    words = tokens = 0
                    for parts in pretokens(text.decode("utf-8", "replace")):
                        words, tokens = words + len(parts), tokens + trie.counts(parts)
                    found.append((words, tokens))
                columns = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                columns += [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_pretokens", "n_tokens"])

    return run


def token_counts(df: DataFrame, path: str, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of df (default: all but the text) with n_pretokens and n_tokens of each whole text.

    A pre-token's tokens are those of its cheapest segmentation, of equally cheap ones that with the fewest tokens.
    path: a ranks file, read by the driver and broadcast (its size is the vocabulary's). A byte that is no token counts
    as a token of its own. Null and empty texts have none; repeated rows each get their row; columns of df with the names
    of the new ones are replaced; an empty table gives an empty result. The trie of a worker is bounded: it begins anew
    after MOST_NODES nodes or MOST_BYTES of words, and words of more than LONG bytes are scored in a rolling window with
    no nodes, neither of which changes a count."""
    new = ["n_pretokens", "n_tokens"]
    carry = [c for c in (carry or df.columns) if c != text_col and c.lower() not in new]
    rows = df.select(*[f"`{c}`" for c in carry], F.col(text_col).cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "n_pretokens long, n_tokens long"])
    costs = df.sparkSession.sparkContext.broadcast({"costs": read_costs(path)})
    return rows.mapInArrow(_counted(costs), schema)
