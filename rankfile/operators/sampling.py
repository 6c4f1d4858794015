"""Sampling of positions along games: a sequential rule, as a fold over each game's rows, or inside a whole shard."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jitter(seed: int, shard, game, ply: int, most: int = 3) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{shard}|{game}|{ply}".encode(), digest_size=4).digest()) % (most + 1)


def sample_positions(rows: DataFrame, *, step: int, skip: int, cap: int, jitter_seed: int) -> DataFrame:
    """rows: shard, game_id, ply, key, in_check, game_over.  After a hit the next ply moves on by step and jitter even if the hit
    is dropped; a game stops at its end; the cap counts kept rows and is looked at before check and duplicates; a key is kept
    once in a shard.  Games of one shard depend on each other, so a shard is one group (its size is the generator's)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, kept = set(), []
        for game, some in pdf.sort_values(["game_id", "ply"]).groupby("game_id", sort=True):
            shard, count = some["shard"].iloc[0], 0
            after = skip + step + jitter(jitter_seed, shard, game, -1)
            for i, ply, key, check, over in zip(some.index, some["ply"], some["key"], some["in_check"], some["game_over"], strict=True):
                if over:
                    break
                if ply < after:
                    continue
                after = ply + step + jitter(jitter_seed, shard, game, int(ply))
                if count >= cap:
                    break
                if check or key in seen:
                    continue
                seen.add(key)
                kept.append(i)
                count += 1
        return pdf.loc[kept]

    return rows.groupBy("shard").applyInPandas(run, rows.schema)


def steps(seed: int, game: Column, ply: Column, most: int = 3) -> Column:
    """A jitter of 0 to ``most`` from a digest of seed, game and ply."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), game.cast("string"), ply.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % (most + 1)


def sampled_plies(rows: DataFrame, *, step: int, skip: int, cap: int, seed: int, game: str = "game_id") -> DataFrame:
    """rows: game, ply (numbers), key, in_check, game_over; gives (game, ply, key, place) of the sampled ones, place from 0.  The rule of
    ``sample_positions`` inside a game, as one fold over its rows in order: after a hit the next ply moves on by step and jitter even
    if the hit is dropped; a game stops at its end; the cap counts kept rows and is looked at before check and repeats; a key is kept
    once a game (``once_a_shard`` then keeps it once a shard).  The state holds the kept rows, ``cap`` at most.  A game's rows come
    together in one row, as long as a game may be.  It all stays in the JVM."""
    s = rows.select(game, F.struct(F.col("ply").cast("long").alias("ply"), F.col("key").cast("string").alias("key"), F.coalesce("in_check", F.lit(False)).alias("check"), F.coalesce("game_over", F.lit(False)).alias("over"), steps(seed, F.col(game), F.col("ply")).alias("jump")).alias("r"))
    games = s.groupBy(game).agg(F.sort_array(F.collect_list("r")).alias("_rows"))
    long = lambda x: F.lit(x).cast("long")
    first = F.struct((skip + step + steps(seed, F.col(game), F.lit(-1))).alias("after"), F.lit(False).alias("over"), F.array().cast("array<struct<ply:long,key:string>>").alias("kept"))

    def fold(state, r):
        over = state["over"] | r["over"]
        hit = ~over & (r["ply"] >= state["after"])
        keep = hit & (F.size(state["kept"]) < cap) & ~r["check"] & ~F.exists(state["kept"], lambda k: k["key"].eqNullSafe(r["key"]))
        return F.struct(F.when(hit, r["ply"] + long(step) + r["jump"]).otherwise(state["after"]).alias("after"), over.alias("over"), F.when(keep, F.concat(state["kept"], F.array(F.struct(r["ply"].alias("ply"), r["key"].alias("key"))))).otherwise(state["kept"]).alias("kept"))

    out = games.select(game, F.posexplode(F.aggregate("_rows", first, fold, lambda s: s["kept"])).alias("place", "_k"))
    return out.select(game, "_k.ply", "_k.key", F.col("place").cast("long").alias("place"))


def once_a_shard(kept: DataFrame, shard: str, *, game: str = "game_id") -> DataFrame:
    """Of the kept rows of a shard that share a key the first by game and ply."""
    first = kept.groupBy(shard, "key").agg(F.min(F.struct(game, "ply", "place")).alias("_f"))
    return first.select(shard, f"_f.{game}", "_f.ply", "key", "_f.place")
