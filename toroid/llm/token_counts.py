"""Exact token counts at every prefix, by prefix dynamic programming over a public byte-level BPE.

The vocabulary splits a text into pieces (words with the space before them, runs of digits, of signs, of white space)
and never merges across pieces. So the count of a text is a running sum over its pieces, and that sum is stored at
each piece's end: step i adds a piece to the prefix, and its count to the count of the prefix before. Counts of distinct
pieces are remembered, and the library encodes none of them.

Inside a piece the same is done over bytes (Merges.prefixes): of all tokens that end at byte i, one continues the encoding
of the prefix before it, and its count is that prefix's plus one. New pieces are taken in sorted order, so that a piece
starts from the prefix that it shares with the one before (Merges.totals). So every prefix of a text has its exact count, and
questions about truncation and budgets never call the encoder again. every_prefix() stores the counts at all characters.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Memory for the pieces a worker remembers (about); then it forgets all and starts again (results are the same). Longer
#: pieces are not remembered, and ENTRY is what a piece takes besides its characters.
CACHE_BYTES, LONG, ENTRY = 64_000_000, 256, 130
#: Pairs of tokens whose fit is remembered.
PAIRS = 300_000
#: Tokens of a document above which over_limit is set.
LIMIT = 1024

#: The vocabulary's fixed splitting pattern, in the standard library's terms; used where a text has only characters
#: on whose classes all Unicode versions agree. Other texts are split by the tokenizer library itself.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r"[\t\n\r -~¡¿-ſ\u2010-\u2027\u2030-\u2044€]*\Z")


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Merges:
    """Token counts of all prefixes of a piece, from the merges alone.

    Tokens are numbered by age: bytes first, then one for each merge in order. Of a piece's tokens only neighbours can go
    wrong: two tokens are neighbours in an encoding if, taking their merges back from the youngest on, no pair across
    the border would have been merged before the merge just taken back (fits). Encodings of prefixes are unique, so at each
    byte there is just one token that ends there and fits the last token of the prefix before it.
    """

    def __init__(self, merges: list[tuple[str, str]]):
        value = _byte_values()
        self.number = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = (bytes(value[c] for c in part) for part in (left, right))
            pair = (self.number[a], self.number[b])
            if a + b in self.number:
                raise ValueError("two merges make the same token")
            self.number[a + b] = self.pairs[pair] = len(self.halves)
            self.halves.append(pair)
        #: Length of the longest token that ends in these two bytes (or is this one).
        self.reach: dict[bytes, int] = {}
        for token in self.number:
            self.reach[token[-2:]] = max(len(token), self.reach.get(token[-2:], 1))
        self.fit: dict[tuple[int, int], bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether token b can follow token a in an encoding."""
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            known = self.fit[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        pairs, halves, before = self.pairs, self.halves, len(self.halves)
        while True:
            if pairs.get((a, b), before) < before:
                return False
            if a < 256 and b < 256:
                return True
            # of merges of the same age the left one came first, so the right one is taken back first
            if a > b:
                before, a = a, halves[a][1]
            else:
                before, b = b + 1, halves[b][0]

    def _extend(self, piece: bytes, counts: list[int], last: list[int]) -> None:
        """Go on with counts and last tokens of the first prefixes of piece, up to the whole of it."""
        token_of, known, reach = self.number.get, self.fit.get, self.reach.get
        for end in range(len(counts), len(piece) + 1):
            for start in range(max(0, end - reach(piece[max(0, end - 2) : end], 1)), end):
                token = token_of(piece[start:end])
                if token is None:
                    continue
                if start:
                    good = known((last[start], token))
                    if not (self.fits(last[start], token) if good is None else good):
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of piece[:n] for n from 0 to its length."""
        counts, last = [0], [-1]
        self._extend(piece, counts, last)
        return counts

    def totals(self, pieces: Iterable[str]) -> dict[str, int]:
        """Tokens of each of the pieces. In sorted order each keeps what it shares with the one before."""
        found, before, counts, last = {}, b"", [0], [-1]
        for text in sorted(pieces):
            piece, same = text.encode("utf-8", "surrogatepass"), 0
            for x, y in zip(piece, before):
                if x != y:
                    break
                same += 1
            del counts[same + 1 :], last[same + 1 :]
            self._extend(piece, counts, last)
            found[text], before = counts[-1], piece
        return found


def _check(layout: dict) -> None:
    """Refuse tokenizers that do more than split by the pattern above and merge bytes."""
    model, split = layout["model"], layout.get("pre_tokenizer") or {}
    plain = (
        model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "fuse_unk", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not layout.get("normalizer")
        and not any(t.get(k) for t in layout["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) and _byte_values().keys() <= model["vocab"].keys()
    )
    if not plain:
        raise ValueError("not a byte-level BPE with the known splitting pattern and no normaliser")


class PrefixCounter:
    """Counts tokens of prefixes as the tokenizer library would count them for the same prefix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        layout = json.loads(self.tokenizer.to_str())
        _check(layout)
        self._rules = layout["model"]["merges"]
        self._merges: Merges | None = None
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        #: Special strings inside a text are one token each, as is the library's default.
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[str, int] = {}
        self.held = 0

    @property
    def merges(self) -> Merges:
        """Read when a piece first asks for them."""
        if self._merges is None:
            self._merges = Merges([tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in self._rules])
        return self._merges

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without special strings; joined they are the text."""
        if _PLAIN.match(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is special)."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            if found.start() > at:
                yield text[at : found.start()], False
            yield found.group(), True
            at = found.end()
        if at < len(text):
            yield text[at:], False

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Token counts of pieces; new ones are counted together, by the merges."""
        new = [p for p in pieces if p not in self.known]
        size = sum(len(p) + ENTRY for p in new if len(p) <= LONG)
        if self.held + size > CACHE_BYTES:
            self.known, self.held = {}, 0
            new = list(pieces)
            size = sum(len(p) + ENTRY for p in new if len(p) <= LONG)
        counts = self.merges.totals(new)
        self.known |= {p: n for p, n in counts.items() if len(p) <= LONG}
        self.held += size
        return {p: n for p, n in counts.items() if len(p) > LONG}

    def count(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """For each text: piece ends (in characters) and the token counts of the prefixes that end there."""
        split = [[(self.pieces(part), special) if not special else ([part], True) for part, special in self.parts(t)] for t in texts]
        long = self.learn({p for parts in split for pieces, special in parts if not special for p in pieces})
        known = self.known
        for parts in split:
            lengths, counts = [], []
            for pieces, special in parts:
                lengths += map(len, pieces)
                counts += [1] if special else map(known.__getitem__, pieces) if not long else [known[p] if p in known else long[p] for p in pieces]
            yield list(accumulate(lengths)), list(accumulate(counts))

    def inside(self, prefix: str) -> int:
        """Tokens of the prefix of a piece, by the merges.

        It may split otherwise than the piece (say "'r" of "'re", or white space cut from the word after it), so it is
        split as a text of its own.
        """
        return sum(1 if special else sum(self.merges.prefixes(p.encode("utf-8", "surrogatepass"))[-1] for p in self.pieces(part)) for part, special in self.parts(prefix))

    def at(self, text: str, ends: list[int], counts: list[int], length: int) -> int:
        """Tokens of text[:length] from the stored table; only the piece that the cut falls into is looked up.

        White space that stands right before the cut joins the piece before it as it would in the prefix.
        """
        length = min(length, len(text))
        if length <= 0:
            return 0
        i = bisect_left(ends, length)
        if ends[i] == length and not text[length - 1].isspace():
            return counts[i]
        start = i
        if ends[i] > length and self.special and self.special.fullmatch(text, ends[i - 1] if i else 0, ends[i]):
            start = max(0, i - 1)  # half a special string is text, which may join the piece before it
        # back over white space: the prefix ends in it, so all of it is one piece there
        while start > 0 and text[ends[start - 1] - 1].isspace():
            start -= 1
        begin, before = (ends[start - 1], counts[start - 1]) if start else (0, 0)
        return before + self.inside(text[begin:length])

    def every_prefix(self, text: str) -> list[int]:
        """Tokens of text[:n] for n from 0 to its length."""
        ((ends, counts),) = self.count([text])
        found, done = [0], 0
        for end, count in zip(ends, counts):
            piece = text[done:end]
            if piece.isalpha() and piece.isascii() or piece[:1] == " " and piece[1:].isalpha() and piece.isascii():
                # a run of letters cut anywhere is still one piece, and fixes how white space before it is split; a lone space joins that
                own = self.merges.prefixes(piece.encode())
                base, first = count - own[-1], 1 if piece[0] != " " else 2
                found += [self.at(text, ends, counts, done + 1)] if first == 2 else []
                found += [base + n for n in own[first:]]
            else:
                found += [self.at(text, ends, counts, n) for n in range(done + 1, end + 1)]
            done = end
        return found


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_prefixes: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, and the prefix table: piece_ends (characters) with prefix_tokens at each of them.

    Counts are those of the library for the same text, without begin, end or added special tokens, truncation or
    padding; special strings inside a text are one token. Null counts as empty (0 tokens). Rows that repeat are counted
    each; an empty table gives an empty result; other columns are not read. path must be readable on executors; by
    default each finds the installed public tokenizer. A tokenizer that normalises, or that splits otherwise than by the
    known pattern, is refused with a ValueError.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path or _default_path())
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # about 4 MB of text at once
                end, size = at, 0
                while end < len(texts) and size < 4_000_000:
                    size += len(texts[end])
                    end += 1
                tables = list(own.count(texts[at:end]))
                columns = [batch.column(0).slice(at, end - at), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[at:end]], pa.int64()), pa.array([c[-1] if c else 0 for _, c in tables], pa.int64())]
                names = ["id", "n_bytes", "n_tokens"]
                if keep_prefixes:
                    columns += [pa.array([e for e, _ in tables], pa.list_(pa.int32())), pa.array([c for _, c in tables], pa.list_(pa.int32()))]
                    names += ["piece_ends", "prefix_tokens"]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = end

    schema = f"id {id_type}, n_bytes bigint, n_tokens bigint" + ", piece_ends array<int>, prefix_tokens array<int>" * keep_prefixes
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def longest_prefix(ends: list[int], counts: list[int], budget: int) -> int:
    """Characters of the longest run of whole pieces that has `budget` tokens at most, from the stored table alone."""
    i = bisect_right(counts, budget)
    return ends[i - 1] if i else 0


def fits(counted: DataFrame, budget: int) -> DataFrame:
    """counted (with its prefix table) and, for a token budget: fits, kept_chars and kept_tokens of whole pieces."""
    n = F.size(F.filter("prefix_tokens", lambda c: c <= budget))
    return counted.withColumns({
        "fits": F.col("n_tokens") <= budget,
        "kept_chars": F.when(n > 0, F.element_at("piece_ends", F.greatest(n, F.lit(1)))).otherwise(0),
        "kept_tokens": F.when(n > 0, F.element_at("prefix_tokens", F.greatest(n, F.lit(1)))).otherwise(0),
    })
