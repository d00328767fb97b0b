"""Edit-aware token counts.

A byte-pair tokenizer cuts a text into pieces first and encodes each piece by
itself, so a document's count is the sum over its pieces. The pieces of a document
are kept as the leaves of a segment tree that sums characters and tokens. An edit
cuts and encodes again only the leaves it touches, a little context before them,
and what follows until the new cuts meet an old leaf's start; then the sums above
the changed leaves are updated.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.common import documents

#: the vocabulary's path on every machine, and the pattern that cuts pieces (fixed values of that vocabulary)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the pattern looks at most this many characters past a piece's end
LOOKAHEAD = 3
LEAF_PIECES = 64
#: piece counts remembered by a worker
MEMORY = 1 << 18


class PieceCounter:
    """Cuts a text into pieces and counts each piece's tokens."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, pieces: list[str]) -> int:
        known, total = self.known, 0
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) <= 64:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = n
            total += n
        return total


class TokenTree:
    """A document's pieces in a segment tree of character and token sums."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter = counter
        pieces = counter.cut.findall(text)
        self.pieces, self.encoded = len(pieces), 0
        self.texts: list[str] = []
        self._place(0, 0, pieces, [])

    def _place(self, first: int, end: int, pieces: list[str], tokens: list[int]) -> None:
        """Puts leaves of ``pieces`` in place of the leaves ``first`` to ``end``; ``tokens`` are the leaves' counts so far."""
        runs = [pieces[i : i + LEAF_PIECES] for i in range(0, len(pieces), LEAF_PIECES)] or [[]]
        self.texts[first:end] = ["".join(run) for run in runs]
        tokens[first:end] = [self.counter.tokens(run) for run in runs]
        self.width = 1 << (len(tokens) - 1).bit_length()
        rest = [0] * (self.width - len(tokens))
        self.chars = [0] * self.width + [len(t) for t in self.texts] + rest
        self.tokens = [0] * self.width + tokens + rest
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        for sums in (self.chars, self.tokens):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``, the last leaf for the end."""
        node, first = 1, 0
        while node < self.width:
            node *= 2
            if at - first >= self.chars[node]:
                first += self.chars[node]
                node += 1
        leaf = min(node - self.width, len(self.texts) - 1)
        return leaf, first if node - self.width == leaf else self.chars[1] - self.chars[self.width + leaf]

    def edit(self, start: int, stop: int, replacement: str) -> None:
        """Replaces characters [start, stop), cut to the text, and updates the sums."""
        start = max(0, min(start, self.chars[1]))
        stop = max(start, min(stop, self.chars[1]))
        # pieces that end a look-ahead before the edit stay as they are
        first, base = self.find(max(0, start - LOOKAHEAD - 1))
        last, last_base = self.find(stop)
        old = "".join(self.texts[first : last + 1])
        new = old[: start - base] + replacement + old[stop - base :]
        # leaf starts after the edit, in the new text's characters from ``base``
        meets = {len(new): last + 1}
        reach, upto = 1, last + 1
        while True:
            ahead = self.texts[upto : upto + reach]
            for text in ahead:
                new += text
                upto += 1
                meets[len(new)] = upto
            reach *= 2
            at_end = upto == len(self.texts)
            pieces, met = [], len(new) if at_end else None
            for m in self.counter.cut.finditer(new):
                place = m.start()
                if place in meets and place >= start - base + len(replacement) and place + LOOKAHEAD < len(new):
                    met = place
                    break
                pieces.append(m[0])
            if met is not None:
                break
        end = meets[met]
        self.encoded += len(pieces)
        slots, full = end - first, -(-len(pieces) // LEAF_PIECES)
        if full > 2 * slots or slots > 4 * max(1, full):
            # leaves that the edit has made long are split, many short ones are merged
            self._place(first, end, pieces, self.tokens[self.width : self.width + len(self.texts)])
            return
        # as many leaves as before share the new pieces
        share = max(1, -(-len(pieces) // slots))
        for i in range(slots):
            run = pieces[i * share : (i + 1) * share]
            self.texts[first + i] = "".join(run)
            self.chars[self.width + first + i] = len(self.texts[first + i])
            self.tokens[self.width + first + i] = self.counter.tokens(run)
        low, high = (self.width + first) // 2, (self.width + end - 1) // 2
        while low >= 1:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2


EDIT = "struct<start:long,stop:long,replacement:string>"


@lru_cache(maxsize=1)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                tree = TokenTree(text or "", counter)
                before, pieces = tree.total, tree.pieces
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                rows.append((before, tree.total, pieces, tree.encoded))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc", "n_tokens", "edited_tokens", "n_pieces", "encoded_again"],
            )

    return run


def edited_counts(docs: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens, edited_tokens, n_pieces, encoded_again) for rows with ``text`` and ``edits``.

    ``edits`` is an array of (start, stop, replacement) in code points, applied
    in order, each to the text as it then is; positions outside are moved to the
    nearest end, null positions are 0 and null edits do nothing. ``doc`` is a
    struct of the columns ``keep``. ``encoded_again`` counts the pieces that edits
    had encoded. A null text is empty; rows are counted one by one, so repeated
    rows are no matter. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("doc"),
        F.col("text"),
        F.col("edits").cast(f"array<{EDIT}>").alias("edits"),
    )
    kept = rows.select("doc").schema["doc"].dataType.simpleString()
    counts = "n_tokens long, edited_tokens long, n_pieces long, encoded_again long"
    return rows.mapInArrow(_count(vocabulary), f"doc {kept}, {counts}")


def sample_edits(text) -> F.Column:
    """An edit log for a text: a deletion at a quarter, an insertion at half, a replacement at three quarters."""
    n = F.length(text)

    def edit(at, size: int, new) -> F.Column:
        start = F.floor(at).cast("long")
        return F.struct(start.alias("start"), (start + size).alias("stop"), new.alias("replacement"))

    return F.array(
        edit(n * 0.25, 7, F.lit("")), edit(n * 0.5, 0, F.substring(text, 1, 20)), edit(n * 0.75, 5, F.lit(" re-edited 42\n\n"))
    )


def op4_token_counts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", text.alias("text"), sample_edits(text).alias("edits"))
    return edited_counts(docs, ["doc_id"]).select("doc.doc_id", "n_tokens", "edited_tokens", "n_pieces", "encoded_again")
