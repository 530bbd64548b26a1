"""Best-fit packing of tokenised documents by linear grouping.

Every document becomes token ids and an end id; whatever is longer than a sequence is cut into full pieces, the first one
taking the remainder. The lengths of the pieces, counted, are the packing problem: a table of at most `CAPACITY` numbers,
whatever the number of documents. On it the driver

1. splits the large lengths, longest first, into groups of equal cardinality and rounds each up to its group's longest;
2. optimises configurations of these few sizes: pattern by pattern, the fullest one that the counts left allow, found
   by a knapsack, is repeated as often as they allow;
3. substitutes the groups' actual lengths, longest first, in runs of sequences that are alike;
4. best-fits the small lengths, longest first, into the fullest sequences that still have room, and opens new ones
   for what is left.

The plan is a list of runs (length, first rank, count, first sequence, place): pieces of a length are ranked, in two steps
so that no task holds a whole length, and each looks up its run.

Defined results: null text is the empty one and gives the end id alone; a text of any length is tokenised whole; rows
may repeat, each is packed on its own; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship, shuffle_partitions

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
TRIALS = ((0.125, 384), (0.25, 384), (0.34, 384), (0.5, 384), (0.125, 96))  # (share of the capacity from which lengths are large, groups)
CACHE = 400_000
# The tokenizer's own split, in terms that Python's re has; right for texts of the characters that ODD leaves out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
ODD = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ʯΑ-ώА-я‐-‧぀-ヿ丁-丂]"


def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit numbers. Words once seen are looked up; texts of unusual characters or with a special token's name go through the tokenizer whole."""
    import json

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        names = [re.escape(t["content"]) for t in json.load(f).get("added_tokens", []) if t["content"]]
    split, odd = re.compile(SPLIT).findall, re.compile("|".join([ODD, *names])).search
    words = word_encoder(path)

    class Seen(dict):
        def __missing__(self, word):
            if len(self) >= CACHE:
                self.clear()
            ids = self[word] = words(word)
            return ids

    seen = Seen()

    def encode(text: str) -> bytes:
        if odd(text):
            return array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([seen[w] for w in split(text)])

    return encode


def word_encoder(path: str):
    """word -> bytes of ids: the tokenizer's vocabulary as merge ranks, where the file allows, else the tokenizer itself."""
    import json

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    try:
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(printable))}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special = {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(shown[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        trial = " thereupon Überraschung façade 12345 !!! \n\n  x"
        if [i for w in re.findall(SPLIT, trial) for i in fast.encode_ordinary(w)] == slow.encode(trial, add_special_tokens=False).ids:
            return lambda w: array("I", fast.encode_ordinary(w)).tobytes()
    except (ImportError, KeyError):
        pass
    return lambda w: array("I", slow.encode(w, add_special_tokens=False).ids).tobytes()


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) -> a row for each piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            ids, pieces, starts, lengths, sums = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = encode(text.as_py() or "") + END.to_bytes(4, "little")
                n = len(tokens) // 4
                at, step, piece = 0, n % capacity or capacity, 0
                while at < n:
                    ids.append(doc_id)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(step)
                    sums.append(zlib.crc32(tokens[4 * at : 4 * (at + step)]))
                    at, step, piece = at + step, capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, sums)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def groups_of(lengths: list[int], counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: [(rounded size, [[length, count]...] longest first)], each of about the same cardinality."""
    total = sum(counts[s] for s in lengths)
    each, out, held = max(1, -(-total // groups)), [], []
    for s in sorted(lengths, reverse=True):
        left = counts[s]
        while left:
            room = each - sum(n for _, n in held)
            take = min(room, left)
            held.append([s, take])
            left -= take
            if take == room:
                out.append((held[0][0], held))
                held = []
    if held:
        out.append((held[0][0], held))
    return out


def fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many of each size make the fullest pattern that capacity and counts allow, with the largest size left in it."""
    first = next(i for i, n in enumerate(counts) if n)
    room = capacity - sizes[first]
    reach: dict[int, tuple[int, ...]] = {0: ()}
    best, done = 0, {0}
    for i in range(first, len(sizes)):  # sizes fall
        most = min(counts[i] - (i == first), room // sizes[i])
        if most < 1:
            continue
        for at in sorted(done, reverse=True):
            for k in range(1, most + 1):
                to = at + k * sizes[i]
                if to > room:
                    break
                if to not in reach:
                    reach[to] = reach[at] + (i,) * k
        done = set(reach)
        best = max(done)
        if best == room:
            break
    out = [0] * len(sizes)
    out[first] = 1
    for i in reach[best]:
        out[i] += 1
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): piece `first rank + i` of that length goes to sequence `first sequence + i`.

    Of the plans that TRIALS give, the first with the fewest sequences.
    """
    plans = [plan_once(counts, capacity, large, groups) for large, groups in TRIALS]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def plan_once(counts: dict[int, int], capacity: int, large: float, groups: int) -> list[tuple[int, int, int, int, int]]:
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    bins: list[list] = []  # [first sequence, how many alike, lengths in them, room]
    ranks = dict.fromkeys(counts, 0)
    runs, following = [], 0

    def put(first: int, n: int, held: list[int], s: int) -> None:
        runs.append((s, ranks[s], n, first, sum(held)))
        ranks[s] += n

    grouped = groups_of([s for s in counts if s >= large * capacity], counts, groups)
    merged: dict[int, list] = {}
    for size, members in grouped:  # groups that round to one size are one
        merged.setdefault(size, []).extend(members)
    sizes, members = list(merged), list(merged.values())
    left = [sum(n for _, n in m) for m in members]
    while any(left):
        pattern = fullest(sizes, left, capacity)
        times = min(n // k for n, k in zip(left, pattern, strict=True) if k)
        slots = [i for i, k in enumerate(pattern) for _ in range(k)]
        for i, k in enumerate(pattern):
            left[i] -= k * times
        while times:  # actual lengths: as many sequences alike as the heads of all lists allow
            heads, used = [], {}
            for i in slots:
                j, seen = 0, used.get(i, 0)
                while seen >= members[i][j][1] and members[i][j + 1 :]:
                    seen -= members[i][j][1]
                    j += 1
                heads.append((i, j))
                used[i] = used.get(i, 0) + 1
            alike = times
            for i, j in set(heads):
                alike = min(alike, max(1, members[i][j][1] // heads.count((i, j))))
            held: list[int] = []
            for i, j in heads:
                put(following, alike, held, members[i][j][0])
                held.append(members[i][j][0])
            for i, j in heads:
                members[i][j][1] -= alike
            for i in set(slots):
                members[i] = [m for m in members[i] if m[1] > 0]
            bins.append([following, alike, held, capacity - sum(held)])
            following += alike
            times -= alike
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def keep(b: list) -> None:
        if b[3] > 0 and b[1] > 0:
            if b[3] not in by_room:
                by_room[b[3]] = []
                insort(rooms, b[3])
            by_room[b[3]].append(b)

    for b in bins:
        keep(b)
    for s in sorted((s for s in counts if s < large * capacity), reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                per = min(capacity // s, n)
                b = [following, -(-n // per), [], capacity]
                following += b[1]
            fit = min(b[3] // s, max(1, n // b[1]))
            take = min(b[1], n)
            held = list(b[2])
            for _ in range(fit):
                put(b[0], take, held, s)
                held.append(s)
            n -= take * fit
            keep([b[0], take, held, b[3] - fit * s])
            keep([b[0] + take, b[1] - take, b[2], b[3]])
    return sorted(runs)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(runs)  # its size depends on the capacity and the number of groups alone
    parts = shuffle_partitions(spark)
    key = ("length", "_part")
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    totals = dealt.groupBy(*key).count().withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).drop("count")
    ranked = (
        dealt.withColumn("_local", F.row_number().over(W.partitionBy(*key).orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
        .join(totals, list(key))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_local")).alias("rank"))
    )

    def look_up(batches):
        table = sent.value
        lengths, firsts = table[:, 0], table[:, 1]
        for batch in batches:
            s, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            wide = np.int64(1) << 42
            at = np.searchsorted(lengths * wide + firsts, s * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(table[at, 3] + rank - firsts[at]), pa.array(table[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(look_up, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def packing_report(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return pack(durable(cut_pieces(docs, path, capacity)), capacity)


ship(__name__)
