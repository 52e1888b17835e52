"""Token counts of whole texts by byte-pair merging, without making token ids.

A piece of text begins as one symbol a byte, kept in a linked list. A heap holds
its adjacent pairs by rank; the pair of lowest rank, the leftmost among equals,
is popped and merged until none is left. The count is the initial symbols minus
the merges.

The vocabulary file also says how a text is normalised and cut into pieces; that
is left to the library it is written for. Pieces never cross white space where
the file drops it, so texts are cut there first, and the counts of short fields
are remembered in each worker.

Defined results: a null text counts as empty, and an empty one has no tokens;
special strings inside a text count one each; rows that repeat are counted alike;
a null id stays null; an empty table gives an empty result; of the other columns
none is carried on, whatever their names.
"""

import functools
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parlance.llm.common import by_slices

# Counts are remembered for fields of so many bytes, and at most twice so many of them.
FIELD_BYTES = 64
MAX_REMEMBERED = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """A byte-pair vocabulary file in JSON.

    `drops_space` says that white space parts pieces and belongs to none of them.
    """

    path: str
    drops_space: bool = True


class PairRanks:
    """The merges of a vocabulary, by rank."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a vocabulary of plain byte-pair merges")
        if model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("prefixed or byte fallback symbols are not supported")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.end = model.get("end_of_word_suffix") or ""
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.merged = [left + right for left, right in pairs]
        self.known = frozenset(s for s in model["vocab"] if len(s.removesuffix(self.end)) == 1)

    def count(self, piece: str) -> int:
        """Symbols of a piece after all merges."""
        symbols: list[str | None] = list(piece)
        symbols[-1] += self.end
        if not self.known.issuperset(symbols):
            raise ValueError(f"no symbol of the vocabulary for a byte of {piece[:40]!r}")
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks, merged = self.ranks, self.merged
        heap = [
            (ranks[pair], at) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks
        ]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, at = heapq.heappop(heap)
            left, right = symbols[at], after[at]
            # A symbol that was merged since, or has got another neighbour, is passed over.
            if left is None or right >= n or left + symbols[right] != merged[rank]:
                continue
            symbols[at], symbols[right] = merged[rank], None
            merges += 1
            following = after[right]
            after[at] = following
            if following < n:
                before[following] = at
                rank = ranks.get((symbols[at], symbols[following]))
                if rank is not None:
                    heapq.heappush(heap, (rank, at))
            previous = before[at]
            if previous >= 0:
                rank = ranks.get((symbols[previous], symbols[at]))
                if rank is not None:
                    heapq.heappush(heap, (rank, previous))
        return n - merges


class _Remembered(dict):
    """Counts by key, made on demand, of short keys only.

    When it is full it becomes the older half and a new one begins; what is asked
    for again moves over, so frequent keys stay and rare ones go.
    """

    def __init__(self, count):
        super().__init__()
        self.make, self.older = count, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= FIELD_BYTES:
            if len(self) >= MAX_REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Counter:
    """Counts the tokens of texts, given as UTF-8, by one vocabulary."""

    def __init__(self, file: str, drops_space: bool):
        described = json.loads(file)
        library = Tokenizer.from_str(file)
        self.normalizer, self.pieces_of = library.normalizer, library.pre_tokenizer
        added = described["added_tokens"]
        for token in added:
            if token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError(f"added token {token['content']!r} is not matched literally")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        if drops_space and any(s.split() != [s] for s in special):
            raise ValueError("an added token holds white space")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.drops_space = drops_space
        self.pieces = _Remembered(PairRanks(described["model"]).count)
        self.fields = _Remembered(self._count_field)

    def _count_field(self, field: bytes) -> int:
        text = field.decode("utf-8")
        n, plain = 0, [text]
        if self.special is not None:
            plain = self.special.split(text)
            n = len(plain) - 1
        for part in plain:
            if self.normalizer is not None:
                part = self.normalizer.normalize_str(part)
            n += sum(self.pieces[piece] for piece, _ in self.pieces_of.pre_tokenize_str(part))
        return n

    def count(self, text: bytes) -> int:
        """bytes.split() parts at the six ASCII spaces and nothing else."""
        if self.drops_space:
            return sum(map(self.fields.__getitem__, text.split()))
        return self._count_field(text) if text else 0


@functools.lru_cache(maxsize=2)
def _counter(file: str, drops_space: bool) -> Counter:
    return Counter(file, drops_space)


def token_counts(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id: str = "doc_id", limit: int = 2048
) -> DataFrame:
    """Per row: id, n_bytes (of UTF-8), n_tokens, and over_limit for more than `limit` tokens.

    The file is read once, where the job is planned, and sent to the workers; its
    size is that of a vocabulary, whatever the table's. Rows stay where they are.
    """
    with open(vocabulary.path, encoding="utf-8") as opened:
        sent = docs.sparkSession.sparkContext.broadcast(opened.read())
    drops_space = vocabulary.drops_space
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[id].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _counter(sent.value, drops_space)
        texts = pc.fill_null(batch["text"].cast(pa.large_binary()), b"")
        counts = [counter.count(t) for t in _each(texts)]
        n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch["id"], n_bytes, pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            ["id", "n_bytes", "n_tokens", "over_limit"],
        )

    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    return by_slices(rows, "text", schema, work).withColumnRenamed("id", id)


def _each(texts: pa.Array) -> Iterator[bytes]:
    return (text.as_py() for text in texts)
