"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Items are dealt over nodes, evenly or by ranges of a place. Each node packs its own best-fit
(decreasing) and emits the bins that are nearly full; bins with room left go up a tree as items of
their own, a few nodes to each next one, for another best-fit round, until one node is left.

Best-fit leaves at most one bin of a node half full or less, and two bins over half full never go
together. So no more bins can find a host, in the whole tree, than there are first nodes, and a node
hands up that many of its fuller bins, those with most room: more would save no sequence. Only bins
travel in these rounds; items follow by one join with the bins that moved.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, salt_of, table, written

CAPACITY = 2048
NODE = 20_000  # items of a node in the first round
FAN_IN = 8
SLACK = 8  # a bin with so few places left is nearly full
END = 0  # id after each document
TOKENIZER = "byte_bpe_50k.json"

# Fixed value: the split of byte-level BPE before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest count on from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def encoder(path: str):
    """text -> ids of the tokenizer file at path, as its library gives them by default: strings of added tokens are those tokens.

    Where ids follow the order of the merges, texts without such a string run by rank in tiktoken,
    several times as fast; all else runs in the library itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    vocab = model["vocab"]
    simple = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not model.get("ignore_merges") and not model.get("dropout")
    if not simple or not all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        return plain
    import tiktoken

    of = _bytes_of_characters()
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or r"(?!)")
    return lambda text: plain(text) if added.search(text) else fast(text)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32[, ids]): token pieces; row is unique.

    Null text is empty text, one end id. No text is cut off; a document over the capacity is cut
    into pieces."""
    path = path or tokenizer_path()
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path), TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length].tobytes()
                    for c, x in zip(out, (row, doc_id.as_py(), k, start, length, zlib.crc32(part), part), strict=False):
                        c.append(x)
                    row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, used): each size, in the given order, goes to the bin with the least room that holds it."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # which amounts of room some bin has
    where, offset, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    for i, n in enumerate(sizes.tolist()):
        at = mask >> n
        if at:
            room = n + (at & -at).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return where, offset, np.array(used, dtype=np.int64)


def first_round(node: str, length: str, bin_: str, at: str, capacity: int):
    """Best-fit over a node's items."""

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        size = t[length].to_numpy().astype(np.int64)
        order = np.lexsort((np.arange(len(size)), -size))
        where, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        where[order], offset[order], _ = best_fit(size[order], capacity)
        return t.drop_columns([node]).append_column(bin_, pa.array(where + (key[0].as_py() << 31))).append_column(at, pa.array(offset))

    return fit


def next_round(last: bool, capacity: int, fan_in: int, slack: int, carry: int):
    """What a node does with bins (node, bin, length, to, base): those of one `to` lie in one bin, which is named after its first.

    done: the bin stays as it is."""

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        old, at = np.unique(t["to"].to_numpy(), return_inverse=True)
        size = np.bincount(at, t["length"].to_numpy()).astype(np.int64)
        order = np.lexsort((old, -size))
        where, base, used = best_fit(size[order], capacity)
        host = old[order][np.unique(where, return_index=True)[1]]  # bins are opened in order
        new, start = np.empty_like(where), np.empty_like(base)
        new[order], start[order] = where, base
        room = capacity - used
        small = 2 * used <= capacity
        up = np.flatnonzero(room > slack)
        up = up[np.lexsort((host[up], -room[up], ~small[up]))]
        stays = np.ones(len(room), dtype=bool)
        stays[up[: int(small[up].sum()) + carry]] = last
        return pa.table({"node": np.full(len(at), key[0].as_py() // fan_in), "bin": t["bin"], "length": t["length"], "to": host[new[at]], "base": t["base"].to_numpy() + start[at], "done": stays[new[at]]})

    return fit


def pack(items: DataFrame, capacity: int = CAPACITY, node: int = NODE, fan_in: int = FAN_IN, slack: int = SLACK, place: str | None = None) -> DataFrame:
    """Adds sequence_id and offset to items(row long unique, length long from 1 to capacity, ...).

    Every item is placed whole, offsets are gapless from 0 and no sequence exceeds the capacity. The
    result depends on the rows alone (row numbers included). place: a column of numbers from 0 up;
    nodes are even ranges of it, and sequence_id follows it from node to node. Items of length 0 or
    over the capacity are not allowed. Other columns may have any names; only an input's own
    sequence_id and offset are replaced. An empty table gives none."""
    items = written(items.drop("sequence_id", "offset"), "pieces")
    rest = [c for c in items.columns if c != "row"]
    facts = items.agg(F.count("*").alias("n"), F.max(place or F.lit(0)).alias("top")).first()
    nodes = max(1, -(-facts.n // node))
    of, bin_, at = (free_name(items, x) for x in ("__node", "__bin", "__at"))
    number = F.expr(f"cast(least(greatest(coalesce(`{place}`, 0), 0) * {nodes} div {(facts.top or 0) + 1}, {nodes - 1}) as long)") if place else salt_of(F.col("row"), nodes).cast("long")
    kinds = ", ".join(f"`{n}` {k}" for n, k in items.dtypes)
    packed_ = written(items.withColumn(of, number).groupBy(of).applyInArrow(first_round(of, "length", bin_, at, capacity), f"{kinds}, `{bin_}` long, `{at}` long"), "packed")
    named = [F.col(c) for c in ("row", *rest)]
    if nodes == 1:
        return packed_.select(*named, F.col(bin_).alias("sequence_id"), F.col(at).alias("offset"))
    bins = packed_.groupBy(F.col(bin_).alias("bin")).agg(F.sum("length").cast("long").alias("length")).where(F.col("length") < capacity - slack)
    level = bins.select(F.floor(F.shiftright("bin", 31) / fan_in).alias("node"), "bin", "length", F.col("bin").alias("to"), F.lit(0).cast("long").alias("base"))
    moved, left = None, -(-nodes // fan_in)
    while True:
        last = left == 1
        fitted = written(level.groupBy("node").applyInArrow(next_round(last, capacity, fan_in, slack, nodes), "node long, bin long, length long, to long, base long, done boolean"), "packed-bins")
        part = fitted.where("done and bin <> to").select("bin", "to", "base")
        moved = part if moved is None else moved.unionByName(part)
        if last:
            break
        level, left = fitted.where("not done").drop("done"), -(-left // fan_in)
    old, new, base = (free_name(packed_, x) for x in ("__old", "__new", "__base"))
    moved = written(moved.toDF(old, new, base), "packed-moved")  # at most a row for each first node
    joined = packed_.join(moved, packed_[bin_] == moved[old], "left")
    return joined.select(*named, F.coalesce(new, bin_).alias("sequence_id"), (F.col(at) + F.coalesce(base, F.lit(0))).alias("offset"))


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, places: DataFrame | None = None) -> DataFrame:
    """Pieces of docs(doc_id, text) with sequence_id and offset.

    places(doc_id, place): documents are packed with those near them in that order, one row for each
    doc_id; documents without a place come first. Null and empty texts are one end id each. Rows that
    repeat a doc_id are packed each. Texts of any length are cut only where they exceed the capacity.
    Other columns of docs are not read. An empty table gives none."""
    found = pieces(docs, capacity, path, with_ids=with_ids)
    if places is None:
        return pack(found, capacity).drop("row")
    where = places.select(F.col("doc_id").cast("long").alias("id_"), F.col("place").cast("long").alias("place"))
    found = found.join(where, found["doc_id"].eqNullSafe(where["id_"]), "left").drop("id_")
    return pack(found, capacity, place="place").drop("row", "place")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
