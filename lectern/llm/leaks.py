"""Problem 7: passages of held-out items inside the training documents.

Training suffix arrays, one for each shard (a block of a partition's documents): the suffixes that begin like some item
suffix, sorted by their first k folded code points.  Item suffixes that begin alike are searched once: every distinct run of
k code points of the items is binary-searched in the shard's array.  What the hash of a run proposes is verified on the code
points, so that order and ranges are exact.

Nothing is expanded item by item.  The items' runs are chained to stretches: as long as a run is always followed by the same
next one, wherever it stands, both belong to one stretch, so that a sentence that many items share is one stretch.  A document
matches stretches; following a match on gives its longest verbatim extent.  From the stretches follows the most that a document
can hold of an item (the matches, and between two of them the longest altered part there may be), and only where that
reaches the share are the matches laid out in both texts.  Stretches that more than COMMON items share propose no pair by
themselves, except for items that common stretches can fill.  So a stock sentence costs what it occurs, not that times its items.

Matches of a pair that follow closely in both texts, with only a few letters altered between them, form one piece.  An
item leaks into a document when pieces of at least ``least`` code points cover at least ``share`` of it.

The items are the query set: their arrays are built once, and broadcast in blocks of bounded size, each block against all
documents.  Nothing of the documents is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lectern.llm import codes

#: (k, the least piece) for runs of ideographs and for runs of letters of alphabets, which say less each
WIDE, NARROW = (8, 20), (16, 40)
SHARE = 0.5
#: Letters that may differ between two matches of one piece, and the longest stretch between them.
ALTERED, STRETCH = 4, 40
#: Code points of items in one block.
ITEM_BLOCK = 4_000_000
_BITS = 22
#: Items that share a stretch before it is common.
COMMON = 32


def _packed(flat: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The k codes from each place on, three to a number, first ones first: in this order they sort like the suffixes."""
    out = []
    for i in range(0, k, 3):
        word = np.zeros(len(at), dtype=np.uint64)
        for j in range(i, min(i + 3, k)):
            word = (word << np.uint64(21)) | flat[at + j].astype(np.uint64)
        out.append(word)
    return out


class _Stretches:
    """The items' runs of k codes: sorted, each once, and chained to stretches."""

    def __init__(self, items: _Items, k: int, at: np.ndarray):
        flat, of = items.codes, items.of
        self.k = k
        columns = _packed(flat, at, k)
        order = np.lexsort(columns[::-1])  # the items' suffix array, to depth k; equal runs in order of place
        fresh = np.ones(len(at), dtype=bool)
        if len(at) > 1:
            fresh[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        self.place = at[order[first]]  # of each run, by rank, where it stands first
        n = len(first)
        # what follows and what precedes each run wherever it stands, -1 at an end
        joined = (at[1:] == at[:-1] + 1) & (of[at[1:]] == of[at[:-1]]) if len(at) else np.zeros(0, bool)
        after = np.append(np.where(joined, rank[1:], -1), -1)[: len(at)]
        before = np.append(-1, np.where(joined, rank[:-1], -1))[: len(at)]
        self.head = np.ones(n, dtype=bool)  # whether a stretch begins with the run
        if n:
            low, high = (np.minimum.reduceat(x[order], first) for x in (after, before))
            top, peak = (np.maximum.reduceat(x[order], first) for x in (after, before))
            next_, last = np.where(low == top, low, -1), np.where(high == peak, high, -1)
            chained = last >= 0
            chained[chained] = next_[last[chained]] == np.flatnonzero(chained)
            self.head = ~chained
        by_place = np.argsort(self.place, kind="stable")  # runs of a stretch follow one another there
        number = np.cumsum(self.head[by_place]) - 1
        self.stretch = np.empty(n, dtype=np.int64)
        self.stretch[by_place] = number
        begins = self.place[by_place][self.head[by_place]]
        self.offset = self.place - begins[self.stretch] if n else np.zeros(0, np.int64)
        self.size = np.bincount(self.stretch, minlength=len(begins)).astype(np.int64)  # in runs
        # where stretches stand in items, by stretch
        starts = np.flatnonzero(self.head[rank]) if n else np.zeros(0, np.int64)
        which = self.stretch[rank[starts]] if n else np.zeros(0, np.int64)
        by = np.argsort(which, kind="stable")
        self.in_item = of[at[starts[by]]] if n else np.zeros(0, np.int64)
        self.in_place = at[starts[by]] - items.starts[self.in_item] if n else np.zeros(0, np.int64)
        self.upto = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(begins))))).astype(np.int64)
        self.stands = which[by]
        # runs by hash
        h = codes.grams(flat, k)[self.place] if n else np.zeros(0, np.uint64)
        by_hash = np.argsort(h, kind="stable")
        self.hashes, self.rank_of = h[by_hash], by_hash
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two runs of the items have one hash")
        self.bitmap = np.packbits(np.bincount((h >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS) > 0)

    def matches(self, shard: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, stretch, offset, place, runs): maximal matches of the shard with stretches."""
        none = (np.zeros(0, np.int64),) * 5
        h = codes.grams(shard, self.k)
        at = np.flatnonzero(np.unpackbits(self.bitmap).view(bool)[h >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.hashes):
            return none
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        doc = np.searchsorted(ends, at, "right")
        keep = (self.hashes[i] == h[at]) & (at + self.k <= ends[doc])
        at, rank, doc = at[keep], self.rank_of[i[keep]], doc[keep]
        for j in range(self.k):
            if not len(at):
                return none
            same = shard[at + j] == flat[self.place[rank] + j]
            if not same.all():
                at, rank, doc = at[same], rank[same], doc[same]
        array = np.argsort(rank, kind="stable")  # the shard's suffix array, to depth k
        wanted = np.arange(len(self.place))
        lo, hi = np.searchsorted(rank[array], wanted, "left"), np.searchsorted(rank[array], wanted, "right")
        found = np.repeat(wanted, hi - lo)  # the ranges follow one another, each suffix in one
        p, s, o = at[array], self.stretch[found], self.offset[found]
        doc = doc[array]
        by = np.lexsort((p, p - o, s, doc))
        p, s, o, doc = p[by], s[by], o[by], doc[by]
        first = np.ones(len(p), dtype=bool)
        first[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1]) | (p[1:] - o[1:] != p[:-1] - o[:-1]) | (p[1:] != p[:-1] + 1)
        begin = np.flatnonzero(first)
        return doc[begin], s[begin], o[begin], p[begin], np.diff(np.append(begin, len(p)))


class _Items:
    """The items of a block: their folded codes end to end, and the stretches of each kind of run."""

    def __init__(self, texts: list[str], share: float = SHARE):
        table = codes.alnum_table()
        parts = [c[c > 0] for c in (table[codes.points(t)] for t in texts)]
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1].astype(np.int64)
        self.codes = np.concatenate([np.zeros(0, np.uint32), *parts])
        self.of = np.repeat(np.arange(len(parts)), self.lengths)
        wide = np.concatenate(([0], np.cumsum(self.codes >= 0x2E80)))
        self.wide = np.array([wide[s + n] - wide[s] > 0.3 * n for s, n in zip(self.starts, self.lengths)], dtype=bool)
        self.need = share * self.lengths
        self.kinds = []
        for (k, _), is_wide in ((WIDE, True), (NARROW, False)):
            at = np.arange(max(0, len(self.codes) - k + 1))
            inside = self.of[at] == self.of[at + k - 1] if len(at) else at.astype(bool)  # no run crosses into the next item
            half = (wide[at + k] - wide[at]) * 2 >= k
            self.kinds.append(_Stretches(self, k, at[inside & (half == is_wide)]))
        # what common stretches can bring to each item at most
        most = np.zeros(len(parts))
        for kind in self.kinds:
            common = np.diff(kind.upto)[kind.stands] > COMMON
            gain = kind.size[kind.stands] + kind.k - 1 + STRETCH * -(-kind.size[kind.stands] // (kind.k + 1))
            most += np.bincount(kind.in_item[common], gain[common], minlength=len(parts))
        self.filled = most >= self.need  # by common stretches alone, perhaps


def _expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place in the ranges."""
    n = end - begin
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def _candidates(found: list[tuple], items: _Items) -> np.ndarray:
    """The pairs document * items + item of which the document may hold enough, sorted.

    Of each stretch in a document its distinct matches count, up to its length, and a longest altered part for each.
    """
    n_items = len(items.lengths)
    gains, proposals = [], []
    for kind, (doc, s, o, _, n) in zip(items.kinds, found):
        if not len(doc):
            gains.append((np.zeros(0, np.int64), np.zeros(0)))
            continue
        once = np.unique(np.stack([doc * len(kind.size) + s, o, n], axis=1), axis=0)
        key, first = np.unique(once[:, 0], return_index=True)
        letters = np.minimum(np.add.reduceat(once[:, 2] + kind.k - 1, first), kind.size[key % len(kind.size)] + kind.k - 1)
        gains.append((key, letters + STRETCH * np.diff(np.append(first, len(once)))))
        stretch, document = key % len(kind.size), key // len(kind.size)
        shared = kind.upto[stretch + 1] - kind.upto[stretch]
        rare = shared <= COMMON
        row, place = _expanded(kind.upto[stretch[rare]], kind.upto[stretch[rare] + 1])
        proposals.append(np.unique(document[rare][row] * n_items + kind.in_item[place]))
        filled = np.flatnonzero(items.filled[kind.in_item])  # places in items that common stretches can fill
        if (~rare).any() and len(filled):
            upto = np.searchsorted(kind.stands[filled], np.arange(len(kind.size) + 1))
            row, place = _expanded(upto[stretch[~rare]], upto[stretch[~rare] + 1])
            proposals.append(np.unique(document[~rare][row] * n_items + kind.in_item[filled[place]]))
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *proposals]))
    reach = np.full(len(pairs), -float(STRETCH))
    for kind, (key, gain) in zip(items.kinds, gains):
        if not len(key):
            continue
        by_item = np.argsort(kind.in_item, kind="stable")
        upto = np.searchsorted(kind.in_item[by_item], np.arange(n_items + 1))
        for at in range(0, len(pairs), 4096):  # an item's stretches, for so many pairs at a time
            part = pairs[at : at + 4096]
            row, place = _expanded(upto[part % n_items], upto[part % n_items + 1])
            want = (part // n_items)[row] * len(kind.size) + kind.stands[by_item[place]]
            i = np.minimum(np.searchsorted(key, want), len(key) - 1)
            reach[at : at + 4096] += np.bincount(row, np.where(key[i] == want, gain[i], 0.0), minlength=len(part))
    return pairs[reach >= items.need[pairs % n_items] - 1e-9] if len(pairs) else pairs


def _runs(pair: int, found: list[tuple], items: _Items, starts: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """The verbatim matches (in the shard, in the item, length) of one pair, those that go on in one another joined."""
    n_items = len(items.lengths)
    d, t = divmod(pair, n_items)
    parts = []
    for kind, (doc, s, o, p, n), bounds in zip(items.kinds, found, starts):
        i, j = bounds[d], bounds[d + 1]
        lo, hi = kind.upto[s[i:j]], kind.upto[s[i:j] + 1]
        if not len(lo):
            continue
        row, place = [], []
        for r, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):  # an item's places within a stretch are sorted
            x, y = np.searchsorted(kind.in_item[a:b], [t, t + 1]) + a
            row += [r] * (y - x)
            place += range(x, y)
        row, place = np.array(row, np.int64) + i, np.array(place, np.int64)
        parts.append(np.stack([p[row], kind.in_place[place] + o[row], n[row] + kind.k - 1], axis=1))
    runs = np.concatenate(parts)
    runs = runs[np.lexsort((runs[:, 0], runs[:, 0] - runs[:, 1]))]
    out: list[list[int]] = []
    for p, q, n in runs.tolist():
        if out and out[-1][0] - out[-1][1] == p - q and p <= out[-1][0] + out[-1][2]:
            out[-1][2] = max(out[-1][2], p + n - out[-1][0])
        else:
            out.append([p, q, n])
    return [tuple(r) for r in out]


def _alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two stretches between matches are the same but for a few letters: their edit distance is small."""
    x, y = a.tolist(), b.tolist()
    if len(x) > STRETCH or len(y) > STRETCH:
        return False
    most = max(ALTERED, min(len(x), len(y)) // 4)
    if abs(len(x) - len(y)) > most:
        return False
    while x and y and x[0] == y[0]:
        x, y = x[1:], y[1:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if max(len(x), len(y)) <= most:
        return True
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        if min(row) > most:
            return False
    return row[-1] <= most


def _covered(item: np.ndarray, doc: np.ndarray, runs: list[tuple[int, int, int]], least: int) -> tuple[int, int]:
    """Code points of the item in pieces of at least ``least``, and the longest verbatim match.  runs: (in doc, in item, length)."""
    pieces: list[list[int]] = []  # doc end, item start, item end
    open_: list[list[int]] = []
    for p, q, n in sorted(runs):
        open_ = [piece for piece in open_ if p - piece[0] <= STRETCH]  # others can't go on any more
        for piece in reversed(open_):
            dp, dq = p - piece[0], q - piece[2]
            if -8 < dp < 0 or -8 < dq < 0:  # overlapping by a repeated letter
                cut = max(-dp, -dq)
                if abs(dp - dq) <= 3 and n > cut:
                    piece[0], piece[2] = p + n, max(piece[2], q + n)
                    break
            elif dp >= 0 and dq >= 0 and _alike(item[piece[2] : q], doc[piece[0] : p]):
                piece[0], piece[2] = p + n, q + n
                break
        else:
            open_.append([p + n, q, q + n])
            pieces.append(open_[-1])
    mark = np.zeros(len(item), dtype=bool)
    for _, start, end in pieces:
        if end - start >= least:
            mark[start:end] = True
    return int(mark.sum()), max(n for _, _, n in runs)


def _of_shard(texts: list[str], items: _Items, share: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(document, item, covered, longest, share) of the leaks in one shard."""
    table = codes.alnum_table()
    flat = table[codes.points("".join(texts))]
    kept = flat > 0
    upto = np.concatenate(([0], np.cumsum(kept)))
    ends = upto[np.cumsum(np.array([len(t) for t in texts], dtype=np.int64))]
    shard = flat[kept]
    found = [kind.matches(shard, items.codes, ends) for kind in items.kinds]
    pairs = _candidates(found, items)
    if not len(pairs):
        return
    starts = [np.searchsorted(f[0], np.arange(len(texts) + 1)) for f in found]
    begin = np.concatenate(([0], ends))
    for pair in pairs.tolist():
        d, t = divmod(pair, len(items.lengths))
        s, n = items.starts[t], items.lengths[t]
        runs = [(p - int(begin[d]), q, m) for p, q, m in _runs(pair, found, items, starts)]
        covered, longest = _covered(items.codes[s : s + n], shard[begin[d] : ends[d]], runs, (WIDE if items.wide[t] else NARROW)[1])
        if covered >= share * n:
            yield d, t, covered, longest, covered / float(n)


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE
) -> DataFrame:
    """(id, item, covered, longest, share) of each pair of document and item where the item leaks.

    covered and longest count folded code points (letters and digits).  Null and empty texts on either side leak nothing;
    an item or a document that is given twice is one (id, item) pair all the same.  Without items the result is empty.
    """
    chosen = items.select(F.col(item_col).alias("_item"), F.col(item_text_col).cast("string").alias("_text")).where(F.length("_text") > 0)
    size = chosen.agg(F.sum(F.length("_text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-size // ITEM_BLOCK))
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")).where(F.length("_text") > 0)
    schema = StructType(
        [narrow.schema[id_col], StructField(item_col, items.schema[item_col].dataType), *StructType.fromDDL("covered int, longest int, share double").fields]
    )
    arrow = to_arrow_schema(schema)
    spark = docs.sparkSession
    out = None
    for b in range(n_blocks):
        rows = chosen.where(F.pmod(F.xxhash64("_item"), F.lit(n_blocks)) == b).collect()  # at most about ITEM_BLOCK code points
        shared = spark.sparkContext.broadcast(([r["_item"] for r in rows], _Items([r["_text"] for r in rows], share)))

        def run(batches, shared=shared):
            ids, index = shared.value
            item_ids = pa.array(ids, arrow.field(1).type)
            for batch in batches:
                found = []
                for at, block in codes.blocks(batch.column(1).to_pylist()):
                    found.extend((at + d, *rest) for d, *rest in _of_shard(block, index, share))
                d, t, *values = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d, pa.int64())), item_ids.take(pa.array(t, pa.int64())), *(pa.array(v, f.type) for v, f in zip(values, list(arrow)[2:]))],
                    schema=arrow,
                )

        part = narrow.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col, item_col).agg(F.max("covered").alias("covered"), F.max("longest").alias("longest"), F.max("share").alias("share"))


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents no item leaks into."""
    return docs.join(found.select(id_col).distinct(), id_col, "left_anti")
