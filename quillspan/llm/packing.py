"""Filling containers of fixed capacity with documents.

Method: large-item matching.  A document above one third of the capacity shares its container
with at most one other such document: those above a half open a container each and are matched
greedily with the largest of the rest that fits; the rest are paired among themselves.  Smaller
documents go to the fullest container with room for them, largest first.  A document larger than
a container is split into full containers and a remainder; no other document is split.

Documents are dealt into groups of bounded size by a hash of their id, so that every group has
the same mix of sizes and is packed in one task; a group wastes at most about one container.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents in a group, a bound on what one task holds: two numbers each.
GROUP_DOCUMENTS = 100_000
#: The vocabulary file of a public tokenizer; a parameter of every call.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the tokenizer of that vocabulary parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def encoder(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str = VOCABULARY):
    """A Column function: tokens of a text; null and empty texts have none."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return counted


def pack(sizes: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Containers of (item, size); every size is from 0 to ``capacity``."""
    third, half = capacity / 3, capacity / 2
    order = sorted(sizes, key=lambda x: (-x[1], x[0]))
    big = [x for x in order if x[1] > half]
    middle = [x for x in order if third < x[1] <= half]
    small = [x for x in order if x[1] <= third]
    bins: list[list[tuple[int, int]]] = []
    rooms: list[int] = []
    # big ones from the fullest: each takes the largest middle one that fits it
    ascending = sorted((s, i) for i, s in middle)
    for item in big:
        k = bisect_left(ascending, (capacity - item[1] + 1,)) - 1
        if k >= 0:
            s, i = ascending.pop(k)
            bins.append([item, (i, s)])
            rooms.append(capacity - item[1] - s)
        else:
            bins.append([item])
            rooms.append(capacity - item[1])
    while ascending:
        s, i = ascending.pop()
        mate = ascending.pop() if ascending else None
        bins.append([(i, s)] + ([(mate[1], mate[0])] if mate else []))
        rooms.append(capacity - s - (mate[0] if mate else 0))
    # small ones, largest first, into the fullest container that has room
    by_room: dict[int, list[int]] = {}
    for b, room in enumerate(rooms):
        by_room.setdefault(room, []).append(b)
    levels = sorted(by_room)
    for item in small:
        k = bisect_left(levels, item[1])
        if k == len(levels):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = levels[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], levels[k]
        bins[b].append(item)
        left = room - item[1]
        if left not in by_room:
            by_room[left] = []
            insort(levels, left)
        by_room[left].append(b)
    return bins


def pieces(tokens: int, capacity: int) -> list[int]:
    """The sizes a document is split into: itself, unless it is larger than a container."""
    full, rest = divmod(tokens, capacity)
    return [tokens] if tokens <= capacity else [capacity] * full + [rest] * (rest > 0)


def fill_containers(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = VOCABULARY, tokens: str | None = None) -> DataFrame:
    """One row per document and piece: ``<key>, piece_no, tokens, container_id``.

    ``container_id`` is ``<group>-<number>``; ``piece_no`` counts from 1.  Sizes are tokens of the
    vocabulary, or the column ``tokens`` where the caller has them.  Documents without a token
    (null and empty texts) are put in a container like all others.  Repeated rows are packed
    each.  An empty table has no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    size = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else count_tokens(vocabulary)(F.col(text))
    groups = max(1, math.ceil(documents.count() / GROUP_DOCUMENTS))
    sized = documents.select(F.col(key).alias("__k"), size.alias("__n"))
    dealt = sized.withColumn("__g", F.pmod(F.xxhash64("__k"), F.lit(groups)).cast("int")).repartition(groups, "__g")
    kind = dict(sized.dtypes)["__k"]

    def packed(g: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__k", "__n"], kind="stable", ignore_index=True)
        parts = [(row, no, s) for row, n in enumerate(pdf["__n"]) for no, s in enumerate(pieces(int(n), capacity), 1)]
        bins = pack([(j, s) for j, (_, _, s) in enumerate(parts)], capacity)
        place = {j: b for b, bin_ in enumerate(bins) for j, _ in bin_}
        return pd.DataFrame(
            {
                "__k": pdf["__k"].take([row for row, _, _ in parts]).to_numpy(),
                "piece_no": [no for _, no, _ in parts],
                "tokens": [s for _, _, s in parts],
                "container_id": [f"{g[0]}-{place[j]}" for j in range(len(parts))],
            }
        )

    out = dealt.groupBy("__g").applyInPandas(packed, f"__k {kind}, piece_no int, tokens long, container_id string")
    return out.withColumnRenamed("__k", key)


