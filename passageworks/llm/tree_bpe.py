"""Byte-level BPE with tree concatenation of long unsplit text."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from passageworks.llm.common import clean, slices

#: Code points of a leaf of a text's tree, and bytes of a leaf of an unsplit piece's tree.
LEAF = 2048
#: Halves of a text that are encoded at once; the encoder leaves the interpreter free meanwhile.
THREADS = 2
#: Code points on each side of a join that are looked through first.
REACH = 32
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def apart(character: str) -> bool:
    return character != " " and character.isprintable()


class TreeBpe:
    """Encoder equal to the tokenizers library on its JSON file, special string included."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tokenizer_path: str, leaf: int = LEAF, threads: int = THREADS) -> None:
        import tiktoken

        self.encoding = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})
        self.core, self.leaf, self.threads, self.tokenizer_path, self.splitter = self.encoding._core_bpe, leaf, threads, tokenizer_path, None
        self.sizes = [0] * (max(ranks.values()) + 1)
        for raw, number in ranks.items():
            self.sizes[number] = len(raw)
        self.joins, self._pool = 0, None

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes, from the encodings of both sides.

        A window around the join is encoded anew and grows until its first token is the left side's
        and its last the right side's token at that place. Then each two neighbouring tokens of the
        result stand next to each other in some true encoding, which makes the whole one true.
        """
        reach = 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.core.encode_single_piece(self.bytes_of(left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            reach *= 2

    def piece(self, raw: bytes) -> list[int]:
        """One unsplit piece, in the same way, but joined by tokens alone."""
        if len(raw) <= self.leaf:
            return self.core.encode_single_piece(raw)
        level = self.leaves(self.core.encode_single_piece, [raw[at : at + self.leaf] for at in range(0, len(raw), self.leaf)])
        while len(level) > 1:
            level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def leaves(self, encode: Callable[[str | bytes], list[int]], parts: list[str | bytes]) -> list[list[int]]:
        """Each part encoded: so many runs of neighbouring parts at once as there are threads."""
        if self._pool is None:
            self._pool = ThreadPoolExecutor(self.threads)
        each = -(-len(parts) // self.threads)
        runs = self._pool.map(lambda at: [encode(p) for p in parts[at : at + each]], range(0, len(parts), each))
        return [ids for run in runs for ids in run]

    def unsplit(self, text: str) -> list[int]:
        """A long window, as in text without spaces: the library's own splitter, then piece by piece."""
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.tokenizer_path).pre_tokenizer
        out: list[int] = []
        for _, (start, end) in self.splitter.pre_tokenize_str(text):
            out += self.piece(text[start:end].encode())
        return out

    def cuts(self, text: str, start: int, middle: int, end: int, reach: int) -> tuple[int, int] | None:
        """The nearest places left and right of ``middle``, at most ``reach`` away, where the text is split whatever stands around; or none.

        A printable character (so no white space, but the space itself is ruled out) and then a space is such a place: no piece of the
        splitter holds both, and its look ahead ends there. The ends of the two sides count too.
        """
        low, high = max(start, middle - reach), min(end, middle + reach)
        left = text.rfind(" ", low + 1, middle)
        while left > low and not apart(text[left - 1]):
            left = text.rfind(" ", low + 1, left)
        if left <= low:
            if low > start:
                return None
            left = start
        right = text.find(" ", middle, high)
        while right >= 0 and not apart(text[right - 1]):
            right = text.find(" ", right + 1, high)
        if right < 0:
            if high < end:
                return None
            right = end
        return left, right

    def met(self, ids: Iterator[int], size: int) -> int | None:
        """How many of ``ids`` have just ``size`` bytes together; none if no number of them has."""
        count = total = 0
        while total < size:
            total += self.sizes[next(ids)]
            count += 1
        return count if total == size else None

    def joined(self, text: str, left: tuple[int, int, list[int]], right: tuple[int, int, list[int]]) -> tuple[int, int, list[int]]:
        """Two neighbouring stretches (start, end, ids) as one: a window around the join is encoded anew, and grows until both sides agree.

        They agree if the window begins and ends where the text is always split, and both sides have tokens that begin and
        end just there.
        """
        self.joins += 1
        start, middle, end, reach = left[0], left[1], right[1], REACH
        while True:
            found = self.cuts(text, start, middle, end, reach)
            if found:
                gone = self.met(reversed(left[2]), len(text[found[0] : middle].encode()))
                over = self.met(iter(right[2]), len(text[middle : found[1]].encode()))
                if gone is not None and over is not None:
                    part = text[found[0] : found[1]]
                    window = self.core.encode_ordinary(part) if len(part) <= 2 * self.leaf else self.unsplit(part)
                    return start, end, left[2][: len(left[2]) - gone] + window + right[2][over:]
            reach *= 2

    def ordinary(self, text: str) -> list[int]:
        """Leaves in parallel, then joined pairwise up the tree."""
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        starts = range(0, len(text), self.leaf)
        found = self.leaves(self.core.encode_ordinary, [text[at : at + self.leaf] for at in starts])
        level = [(at, min(at + self.leaf, len(text)), ids) for at, ids in zip(starts, found, strict=True)]
        while len(level) > 1:
            level = [self.joined(text, level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0][2]

    def encode(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.ordinary(text)
        out: list[int] = []
        for k, part in enumerate(text.split(SPECIAL)):
            out += [SPECIAL_ID] * bool(k) + self.ordinary(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None = None, tokenizer: str | None = None, leaf: int = LEAF) -> TreeBpe:
    """The encoder of a vocabulary file; by default that of the public tokenizer files."""
    import public_tokenizers as public

    with open(vocabulary or public.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return TreeBpe(ranks, public.PATTERN, tokenizer or public.path(TOKENIZER), leaf)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep_ids: bool = False, keep_text: bool = False, vocabulary: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]) for every row, over whole texts.

    Null text counts as empty: no tokens, digests of nothing. Null ids and repeated rows: each is returned. Of equal merges the
    tokenizer takes the leftmost. Very long texts are encoded whole, from leaves of LEAF code points up. Other columns, of whatever
    name, are not read. Empty table: no rows. The vocabulary is read on each executor from the given path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, tokenizer)
        for part in slices(batches, 64):
            every = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
            decoded = [bpe.decode(ids) for ids in every]
            columns = [
                part.column(0),
                pa.array(map(len, every), pa.int64()),
                pa.array([hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for ids in every]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(every, pa.list_(pa.int32())))
                names.append("ids")
            if keep_text:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return clean(docs, id_col, text_col).mapInArrow(run, schema)
