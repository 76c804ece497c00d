"""Packing of token pieces into as few sequences as can be, by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most `capacity` tokens; all but a document's first piece are full, and a full piece is a
sequence of its own. The others are dealt into blocks of about `block_items` by a hash, each block a fair sample of
the lengths. Each block is worked on by several islands: an island evolves a population of packings (see grouping_ga), hands its elites to the next island
of its block, and evolves again from its own and the immigrants; the fittest packing of a block's islands counts. A block whose packing meets
its lower bound is done at once.

What blocks cost is a part of a sequence each. So the emptiest sequences of up to POOL blocks are then pooled into one new block, which evolves in the same way from the sequences as they are,
and so on until one pool is left: rounds grow with the logarithm of the number of blocks, and each round works on a small share of the one before. Blocks are independent
rows, dealt to tasks by their number, so any number of executors can share them.

Pieces are written to the shared folder with the number that identifies them; all that follows is a seeded function of these
rows, so lost tasks are run again with the same result.

Defined results: null texts are empty; an empty text is one piece that holds the end id alone; very long texts are cut into as many pieces as they need; equal rows and pieces of equal length are packed each; an empty
table gives an empty one; other columns stay, and columns named as the new ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.bpe_ids import pretoken_table
from lodestone.llm.common import bound_batches, free_name, materialize
from lodestone.llm.grouping_ga import Solution, best_fit, evolve

PIECE = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType()}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: the columns of docs without the text, piece, start, length, ids_crc32, and with ids=True the piece's ids, little-endian 32-bit."""
    new = PIECE | ({"ids": T.BinaryType()} if ids else {})
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in new]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])
    tail = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pretoken_table(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows, piece, start, length, crc, kept_ids = [], [], [], [], [], []
                for k, coded in enumerate(table.encode_batch([t or "" for t in part.column(text).to_pylist()])):
                    coded += tail
                    n = len(coded) // 4
                    low, high = 0, n % capacity or capacity
                    while low < n:
                        own = coded[4 * low : 4 * high]
                        piece.append(len(piece) and rows[-1] == k and piece[-1] + 1 or 0)
                        rows.append(k)
                        start.append(low)
                        length.append(high - low)
                        crc.append(zlib.crc32(own))
                        if ids:
                            kept_ids.append(own)
                        low, high = high, high + capacity
                take = pa.array(rows, pa.int64())
                columns = [*(part.column(n).take(take) for n in names), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept_ids, pa.binary())] if ids else []), names=[*names, *new])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


_ITEMS = "array<struct<size:int,uid:bigint,bin:bigint>>"
#: Blocks whose emptiest sequences make up a new block, and how many of a block's these are: one in SPARE, and some more in small blocks.
POOL, SPARE, LEAST_SPARE = 32, 20, 6
#: Island rows of a task, about.
ROWS_A_TASK = 2


def _epoch(islands: DataFrame, capacity: int, population: int, generations: int, elites: int, settle: float, seed: int) -> DataFrame:
    """Each row (block, island, items, immigrants) evolves on its own. Items with bins are a packing to start from."""
    kept = ["block", "island", "items"]
    new = pa.schema([("elites", pa.list_(pa.binary())), ("n_bins", pa.int64()), ("spread", pa.float64()), ("bins", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                items = row.column("items").flatten()
                lengths = items.field("size").to_pylist()
                immigrants = row.column("immigrants")[0].as_py()
                if not immigrants and len(items) and items.field("bin")[0].is_valid:
                    at = np.unique(items.field("bin").to_numpy(zero_copy_only=False), return_inverse=True)[1]
                    immigrants = [at.astype("<i4").tobytes(), best_fit(Solution([], []), list(range(len(lengths))), lengths, capacity).genome(len(lengths))]
                key = zlib.crc32(f"{seed} {row.column('block')[0].as_py()} {row.column('island')[0].as_py()}".encode())
                people = evolve(lengths, capacity, immigrants, population, generations, key, settle)
                n, best = len(lengths), people[0]
                out = {"elites": [p.genome(n) for p in people[:elites]], "n_bins": len(best.bins), "spread": float(best.fitness()[1]), "bins": np.frombuffer(best.genome(n), "<i4").tolist()}
                found = pa.RecordBatch.from_pylist([out], schema=new)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), *found.columns], names=[*kept, *new.names])

    return islands.select(*kept, "immigrants").mapInArrow(run, f"block long, island int, items {_ITEMS}, elites array<binary>, n_bins long, spread double, bins array<int>")


def evolved(items: DataFrame, n_blocks: int, capacity: int, islands: int, epochs: int, population: int, generations: int, elites: int, settle: float, seed: int) -> DataFrame:
    """(block, uid, size, bin): items (block, uid, size, bin or null) as the fittest packing of their block's islands has them."""
    tasks = max(1, -(-n_blocks * islands // ROWS_A_TASK))  # a count of its own: rows are few and small, but each is seconds of work
    # A block has a bounded number of items, whatever the data: the hash of a unique number deals them.
    blocks = items.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("size", "uid", "bin")), asc=False).cast(_ITEMS).alias("items"))
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("immigrants", F.array().cast("array<binary>"))
    for e in range(epochs):
        if e:
            ring = state.groupBy("block").agg(F.first("items").alias("items"), F.array_sort(F.collect_list(F.struct("island", "elites"))).alias("ring"))
            each = ring.select("block", "items", "ring", F.posexplode("ring").alias("at", "own"))
            neighbour = F.element_at("ring", ((F.col("at") + 1) % islands + 1).cast("int"))
            state = each.select("block", "items", F.col("own.island").alias("island"), F.array_distinct(F.concat("own.elites", neighbour["elites"])).alias("immigrants"))
        state = _epoch(state.repartition(tasks, "block", "island"), capacity, population, generations, elites, settle, seed + e)
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "bins"), F.struct("n_bins", "spread", "island")).alias("best"))
    return best.select("block", F.explode(F.arrays_zip("best.items", "best.bins")).alias("x")).select("block", F.col("x.items.uid").alias("uid"), F.col("x.items.size").alias("size"), F.col("x.bins").cast("long").alias("bin"))


def pack(pieces: DataFrame, capacity: int = 1024, block_items: int = 16_000, islands: int = 2, epochs: int = 2, population: int = 8, generations: int = 8, elites: int = 2, settle: float = 0.9, seed: int = 11) -> DataFrame:
    """pieces (rows with a length of 1 to capacity) with sequence_id and offset."""
    uid = free_name(pieces, "uid")
    pieces = materialize(pieces.drop("sequence_id", "offset").withColumn(uid, F.monotonically_increasing_id()), "pieces")
    loose = pieces.filter(F.col("length") < capacity).select(F.col(uid).alias("uid"), F.col("length").cast("int").alias("size"))
    n_blocks = max(1, round(loose.count() / block_items))
    items = loose.select(F.pmod(F.xxhash64(F.lit(seed), "uid"), F.lit(n_blocks)).alias("block"), "uid", "size", F.lit(None).cast("long").alias("bin"))
    done, level = None, 0
    while True:
        packed = evolved(items, n_blocks, capacity, islands, epochs, population, generations, elites, settle, seed + 100 * level)
        packed = materialize(packed.withColumn("bin", F.lit(level) * 2**56 + F.col("block") * 2**20 + F.col("bin")), "packed")
        if n_blocks == 1:
            done = packed if done is None else done.unionByName(packed)
            break
        fills = packed.groupBy("block", "bin").agg(F.sum("size").alias("fill"))
        by = Window.partitionBy("block")
        spare = fills.withColumn("k", F.row_number().over(by.orderBy("fill", "bin"))).withColumn("n", F.count("*").over(by)).filter(F.col("k") <= F.floor(F.col("n") / SPARE) + LEAST_SPARE).select("bin")
        marked = materialize(packed.join(spare.withColumn("spare", F.lit(True)), "bin", "left"), "spare")
        kept = marked.filter("spare IS NULL").drop("spare")
        done = kept if done is None else done.unionByName(kept)
        n_blocks, level = -(-n_blocks // POOL), level + 1
        items = marked.filter("spare").select(F.floor(F.col("block") / POOL).alias("block"), "uid", "size", "bin")
    before = Window.partitionBy("bin").orderBy(F.desc("size"), "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = done.select(F.col("uid").alias(uid), F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    full = pieces.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col(uid)).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.filter(F.col("length") < capacity).join(placed, uid)
    return full.unionByName(rest).drop(uid)
