"""Benchmark decontamination by spaced-seed hashing.

Fixed masks select some token positions of a window and ignore the others; a seed is the hash of the tokens selected,
so a window still hits when the ignored tokens were changed. Seeds of the benchmark and of the documents are joined,
and around each hit the two token sequences are compared position by position on the hit's diagonal.

Document windows are screened inside the scan by a bitmap of the benchmark's seeds, of a bounded size whatever the size
of the benchmark; what passes goes into an exact join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toroid.llm.common import HOT_LEAST, HOT_SHARE, join_on_hot_key, materialise

#: Positions of a window that a mask selects (1) or ignores (0). Over all places of the changes, one of them lies on matches
#: in 95.7 % of stretches with 12 of 16 tokens matching, and more often in those with a larger share.
MASKS = ("11101011", "11001000111", "11010010011")
#: Masks of items of SPACED to LONG - 1 tokens: 96.8 % of stretches where 9 of 12 match, 98.6 % or more at other lengths.
MIDDLE_MASKS = ("111011", "11001011", "10100111")
#: Masks of items under SPACED tokens: one of them lies on matches wherever three quarters of LEAST_SPACED to SPACED - 1
#: tokens match. Items under LEAST_SPACED tokens are looked for as they are.
SHORT_MASKS = ("1111", "10111", "11011", "11101", "110011")
LEAST_SPACED, SPACED, LONG = 5, 10, 16
#: Matching tokens and share of matches that an overlap needs; an item under LEAST_MATCH / SHARE tokens needs the share alone.
LEAST_MATCH = 12
SHARE = 0.75
#: Bits of the screen for each benchmark seed, and the limits of its size as powers of two (128 kB, 32 MB). A seed sets two bits.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 1024, 20, 28
#: Tokens that are kept on both sides of a hit.
CONTEXT = 64
#: Characters that are worked on at once; a longer text is one piece.
PIECE = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
#: Characters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han) are tokens of their own; their marks are none.
_ALONE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_BASE, _MASK64 = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.multiply.accumulate(np.full(n - 1, base, np.uint64))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _apart(text: str) -> str:
    """The text with spaces around each character of a script without spaces."""
    return text if text.isascii() else _ALONE.sub(r" \1 ", _MARKS.sub(" ", text))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and the text each belongs to.

    Tokens are runs of letters and digits, lower-cased, and the single characters of scripts without spaces.
    """
    parts = [_apart(t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    is_word = _WORD[data]
    turns = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = turns[::2], turns[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
    hashes = _mixed((sums[ends] - sums[starts]) * inverse[starts])
    limits = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.searchsorted(limits, starts)


def seeds(hashes: np.ndarray, owner: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(seed, start) for each window of the mask that lies in one text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.full(n, sum(ord(c) << (i % 48) for i, c in enumerate(mask)), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    start = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return _mixed(total[start]), start


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PIECE characters, with the index of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE or i == len(texts) - 1:
            yield at, [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0


def _masks(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= LONG else MIDDLE_MASKS if n >= SPACED else SHORT_MASKS if n >= LEAST_SPACED else ("1" * n,) if n else ()


def _needed(n: int, least: int, share: float) -> float:
    """Matching tokens that an overlap with an item of n tokens needs."""
    return n if n < LEAST_SPACED else min(least, share * n)


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each benchmark item with its tokens and the seeds of all its windows."""
    for batch in batches:
        texts, tokens, found = batch.column(1).to_pylist(), [], []
        for t in texts:
            h, owner = token_hashes([t or ""])
            own = [x for mask in _masks(len(h)) for s, at in [seeds(h, owner, mask)] for x in zip(s.view(np.int64).tolist(), at.tolist())]
            tokens.append(h.view(np.int64).tolist())
            found.append([{"seed": k, "at": v} for k, v in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())])))], ["item_id", "tokens", "seeds"])


def _passes(screen: np.ndarray, bits: int, found: np.ndarray) -> np.ndarray:
    """Whether the screen has both bits of each seed."""
    good = np.ones(len(found), bool)
    for at in (found >> np.uint64(64 - bits), found & np.uint64((1 << bits) - 1)):
        at = at.astype(np.int64)
        good &= (screen[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return good


def _regions(screen, bits: int, masks: list[str]):
    """The stretches of each document that hold screened hits, with CONTEXT tokens around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(screen.value, np.uint8)
        for batch in batches:
            ids, starts, tokens, hits, kept = batch.column(0), [], [], [], []
            for first, texts in _pieces(batch.column(1).to_pylist()):
                h, owner = token_hashes(texts)
                all_seeds, all_at = [], []
                for mask in masks:
                    s, at = seeds(h, owner, mask)
                    good = _passes(held, bits, s)
                    all_seeds.append(s[good])
                    all_at.append(at[good])
                if not sum(map(len, all_seeds)):
                    continue
                s, at = np.concatenate(all_seeds), np.concatenate(all_at)
                order = np.argsort(at, kind="stable")
                s, at = s[order].view(np.int64), at[order]
                cuts = np.flatnonzero((np.diff(at) > CONTEXT) | (np.diff(owner[at]) > 0)) + 1
                first_token = np.searchsorted(owner, np.arange(len(texts) + 1))
                for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
                    doc = owner[at[a]]
                    lo, hi = max(first_token[doc], at[a] - CONTEXT), min(first_token[doc + 1], at[b - 1] + 16 + CONTEXT)
                    kept.append(first + doc)
                    starts.append(int(lo - first_token[doc]))
                    tokens.append(h[lo:hi].view(np.int64))
                    hits.append([{"seed": x, "at": y} for x, y in zip(s[a:b].tolist(), (at[a:b] - lo).tolist())])
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(kept, pa.int64())), pa.array(starts, pa.int32()), pa.array(tokens, pa.list_(pa.int64())),
                pa.array(hits, pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.int32())]))),
            ], ["id", "start", "tokens", "hits"])

    return run


def best_overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, share: float = SHARE) -> tuple[int, int, int]:
    """(matches, length, start in doc) of the best stretch of doc against item on a diagonal (doc position - item position).

    The best stretch has most matches of all in which `share` of the tokens match, and is the shortest of those.
    """
    lo, hi = max(0, diagonal), min(len(doc), diagonal + len(item))
    if hi <= lo:
        return 0, 0, 0
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    matches = np.r_[0, np.cumsum(same)]
    over = np.round(matches - share * np.arange(len(matches)), 9)  # does not fall over a stretch that has the share
    first = np.searchsorted(-np.minimum.accumulate(over), -over)  # first start from which it does not fall, for each end
    gained = matches - matches[first]
    if not gained.any():
        return 0, 0, 0
    found = []
    for end in np.flatnonzero(gained == gained.max()).tolist():
        hit = np.flatnonzero(same[first[end] : end]) + first[end]
        found.append((int(hit[-1] - hit[0] + 1), int(lo + hit[0])))
    length, start = min(found)
    return int(gained.max()), length, start


def _verify(least: int, share: float):
    """The best overlap of each pair of a region and an item, over all diagonals that they hit on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            docs, items, turns = (batch.column(i) for i in (2, 3, 4))
            for i in range(batch.num_rows):
                doc, item, best = np.array(docs[i].values), np.array(items[i].values), None
                for diagonal in turns[i].as_py():
                    m, n, at = best_overlap(doc, item, diagonal, share)
                    if m > 0 and m >= share * n and m >= _needed(len(item), least, share):
                        best = max(best or (m, -n, -at), (m, -n, -at))
                found.append((best[0], -best[1], -best[2]) if best else (None, None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], ["id", "item_id", "start", "matched", "compared", "at"])

    return run


def dealt_seeds(hits: DataFrame, known: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame]:
    """hits (region, seed, doc_at) and known (item, seed, item_at) with the cell _rows, _columns that each is joined in.

    A seed above `share` of all hits, or of all windows of the benchmark, is dealt into cells before the exchange: its hits
    into rows and its windows into columns, none much above the share (or `least`). Such seeds number 2 / share at most.
    """
    most_hits, most_known = (max(least, int(n * share)) for n in (hits.count(), known.count()))

    def parts(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > most).select("seed", F.ceil(F.col("n") / most).alias(name))

    hot = materialise(parts(hits, most_hits, "rows").join(parts(known, most_known, "columns"), "seed", "full"))

    def dealt(side: DataFrame, own: str, other: str, key: list[str]) -> DataFrame:
        marked = side.join(F.broadcast(hot), "seed", "left")
        mine = F.when(F.col(own).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*key), F.col(own))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)).cast("int") - 1))
        return marked.select(*side.columns, mine.alias(f"_{own}"), others.alias(f"_{other}"))

    return dealt(hits, "rows", "columns", ["region", "doc_at"]), dealt(known, "columns", "rows", ["item", "item_at"])


def candidate_pairs(hits: DataFrame, known: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """(region, item, diagonals) for each region and item that meet in a seed."""
    one, other = dealt_seeds(hits, known, share, least)
    met = one.join(other, ["seed", "_rows", "_columns"])
    return met.groupBy("region", "item").agg(F.collect_set(F.col("doc_at") - F.col("item_at")).alias("diagonals"))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST_MATCH, share: float = SHARE) -> DataFrame:
    """One row for each document and benchmark item that overlap: id, item_id, matched, compared, start (token number).

    An overlap is a stretch of at least `least` matching tokens (or `share` of an item too short for that) in which
    `share` of the tokens match. Items of under LEAST_SPACED tokens overlap where all their tokens stand in a row. Null and empty texts overlap
    nothing; an empty table on either side gives an empty result; rows that repeat an id count as one document, null ids
    too, and so do items. Every window of an item counts, also where its seed repeats. Of several overlaps of a pair the one with most matches is given, of those the shortest, of those the first.
    Columns other than those named are not read.
    """
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    pair = "array<struct<seed:bigint,at:int>>"
    items = benchmark.select(item_col, F.col(item_text).cast("string")).mapInArrow(_items, f"item_id {item_type}, tokens array<bigint>, seeds {pair}")
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()))
    known = items.select("item", F.explode("seeds").alias("s")).select("item", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    bits = min(MOST_BITS, max(LEAST_BITS, (known.count() * BITS_A_SEED).bit_length()))
    places = known.select(F.explode(F.array(F.shiftrightunsigned("seed", 64 - bits), F.col("seed").bitwiseAND(F.lit((1 << bits) - 1)))).alias("at"))
    screen = np.zeros(1 << bits - 15, "V4096")
    for row in places.groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("b")).collect():
        screen[row.k] = bytes(row.b)
    lengths = [r.n for r in items.select(F.least(F.size("tokens"), F.lit(LONG)).alias("n")).distinct().collect()]
    masks = sorted({mask for n in lengths for mask in _masks(n)})
    held = spark.sparkContext.broadcast(screen.tobytes())
    regions = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_regions(held, bits, masks), f"id {id_type}, start int, tokens array<bigint>, hits {pair}")
    regions = materialise(regions.withColumn("region", F.monotonically_increasing_id()))
    hits = regions.select("region", F.explode("hits").alias("h")).select("region", F.col("h.seed").alias("seed"), F.col("h.at").alias("doc_at"))
    pairs = materialise(candidate_pairs(hits, known))
    total = pairs.count()
    by_region, by_item = (pairs.groupBy(c).agg(F.count("*").alias("_n")) for c in ("region", "item"))
    docs_side = regions.join(by_region, "region").select("region", "id", "start", F.col("tokens").alias("doc"), "_n")
    items_side = items.join(by_item, "item").select("item", "item_id", "tokens", "_n")
    both = join_on_hot_key(pairs, materialise(docs_side), ["region"], "_n", total).drop("_n")
    both = join_on_hot_key(both, materialise(items_side), ["item"], "_n", total)
    checked = both.select("id", "item_id", "doc", "tokens", "diagonals", "start").mapInArrow(_verify(least, share), f"id {id_type}, item_id {item_type}, start int, matched int, compared int, at int")
    best = checked.where("matched is not null").groupBy("id", "item_id").agg(F.max(F.struct("matched", -F.col("compared"), -(F.col("start") + F.col("at")))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), F.col("b.matched").alias("matched"), (-F.col("b.col2")).alias("compared"), (-F.col("b.col3")).alias("start"))
