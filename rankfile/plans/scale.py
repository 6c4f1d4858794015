"""Membership filters, seeded permutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfile.operators import bloom, permute

from .core import load, query

RATE = 0.01
BATCH = "select o_orderkey as k, o_custkey as c from orders where o_custkey % 40 = 0"
STATE = "select l_orderkey as k from lineitem where l_returnflag = 'R'"

# The filter spelled out as the set of (block, word, bit) that keys set; a state row passes when all of its bits are there.
PASSING = f"""b as ({BATCH}), s as ({STATE}), n as (select greatest(1, (count(distinct k) + {bloom.load_for(RATE) - 1}) // {bloom.load_for(RATE)})::bigint as blocks from b),
 set_bits as (select distinct h.block, w, (h.rest >> (6 * w)) & 63 as bit from (select ('0x' || substr(md5(k::varchar), 1, 15))::bigint % blocks as block, ('0x' || substr(md5(k::varchar), 16, 12))::bigint as rest from b, n) h, range(0, 8) r(w)),
 asked as (select id, w, block, (rest >> (6 * w)) & 63 as bit from (select row_number() over () as id, ('0x' || substr(md5(k::varchar), 1, 15))::bigint % blocks as block, ('0x' || substr(md5(k::varchar), 16, 12))::bigint as rest from s, n) h, range(0, 8) r(w)),
 passed as (select id from asked join set_bits using (block, w, bit) group by id having count(*) = 8)"""


def batch_and_state(spark, sf_dir):
    batch = load(spark, sf_dir, "orders").where("o_custkey % 40 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    state = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return batch, state


@query("bloom_unseen", f"select k, c from ({BATCH}) where k not in ({STATE})")
def bloom_unseen(spark, sf_dir):
    """A batch's keys that a large state does not hold: the exact anti-join behind a filter of the batch."""
    batch, state = batch_and_state(spark, sf_dir)
    return bloom.unseen(batch, state, "k", rate=RATE).select("k", "c")


@query("bloom_rates", f"""with {PASSING}, m as (select count(*) as n_state, sum(case when k in (select k from b) then 1 else 0 end)::bigint as n_members from s), p as (select count(*) as n_passed from passed)
 select n_state, n_members, n_passed, round((n_passed - n_members) / (n_state - n_members)::double, 8) as false_rate, (n_passed - n_members) / (n_state - n_members)::double <= 2 * {RATE} as within, n_passed * 10 <= n_state as tenfold from m, p""")
def bloom_rates(spark, sf_dir):
    """What a filter lets through: of the state's rows, the members, and how many others."""
    batch, state = batch_and_state(spark, sf_dir)
    blocks = bloom.blocks_for(batch.select("k").distinct().count(), RATE)
    # filters of two parts, merged
    parts = [bloom.built(batch.where(F.col("c") % 80 == r), "k", blocks) for r in (0, 40)]
    n_passed = bloom.passing(state, "k", bloom.merged(*parts), blocks).agg(F.count("*").alias("n_passed"))
    members = state.join(batch.select("k").distinct(), "k", "left_semi").agg(F.count("*").alias("n_members"))
    one = state.agg(F.count("*").alias("n_state")).crossJoin(members).crossJoin(n_passed)  # single rows
    rate = (F.col("n_passed") - F.col("n_members")) / (F.col("n_state") - F.col("n_members"))
    return one.select("n_state", "n_members", "n_passed", F.round(rate, 8).alias("false_rate"), (rate <= 2 * RATE).alias("within"), (F.col("n_passed") * 10 <= F.col("n_state")).alias("tenfold"))


def mixed_sql(x: str, key: int, size: str) -> str:
    return f"((((({x} + {key}) % 2147483648) * 1597334677) // 65536) % 2147483648 * 1181783497 // 8192) % {size}"


def pass_sql(source: str, keep: str, number: str, seed: int) -> str:
    """One pass of the network in SQL: ``source`` has the columns keep, number, n; the result has ``v`` for the number."""
    sql = f"select {keep}, n, a, b, {number} // b as l, {number} % b as r from (select *, (n + a - 1) // a as b from (select *, floor(sqrt(n - 1))::bigint + 1 as a from {source}))"
    keys = permute.Permutation(1, seed).keys
    for i in range(permute.ROUNDS):
        sql = f"select {keep}, n, a, b, (l + {mixed_sql('r', keys[2 * i], 'a')}) % a as l, r from ({sql})"
        sql = f"select {keep}, n, a, b, l, (r + {mixed_sql('l', keys[2 * i + 1], 'b')}) % b as r from ({sql})"
    return f"select {keep}, n, l * b + r as v from ({sql})"


def places_sql(name: str, source: str, keep: str, number: str, seed: int) -> str:
    """CTEs that end in ``name``(keep, place) for the rows of ``source``(keep, number, n)."""
    return f"""{name}_w(i, n, v) as (select i, n, v from ({pass_sql(f'(select {number} as i, {number}, n from {source})', 'i', number, seed)}) union all select i, n, v from ({pass_sql(f'(select i, n, v as x from {name}_w where v >= n)', 'i', 'x', seed)})),
 {name} as (select {keep}, w.v as place from {source} s join (select i, v from {name}_w where v < n) w on s.{number} = w.i)"""


@query("feistel_places", f"with recursive o as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as k, count(*) over () as n from orders), {places_sql('p', 'o', 's.o_orderkey, s.k', 'k', 42)} select o_orderkey, place, k as back from p")
def feistel_places(spark, sf_dir):
    """The place of every order in a seeded permutation, and the row number found back from the place."""
    from rankfile.operators import rank

    o = load(spark, sf_dir, "orders").select("o_orderkey")
    n = o.count()
    k = rank.numbered(o, "o_orderkey", "o_orderkey").withColumn("k", F.col("k") - 1)
    out = permute.permuted(permute.permuted(k, "k", n, seed=42), "place", n, seed=42, out="back", inverse=True)
    return out.select("o_orderkey", "place", "back")


@query("permuted_split", f"""with recursive g as (select o_custkey as game_id, min(o_orderkey) as first from orders group by o_custkey), gn as (select game_id, first, row_number() over (order by first, game_id) - 1 as k, count(*) over () as n from g), {places_sql('gp', 'gn', 's.game_id, s.first, s.n', 'k', 7)},
 part as (select game_id, first, case when place < greatest(1, round_even(n * 0.025, 0)) then 'val' else 'train' end as part from gp),
 t as (select o_orderkey as row_idx, o_custkey as game_id, row_number() over (order by first, o_orderkey) - 1 as k, count(*) over () as n from orders join part on o_custkey = game_id where part = 'train'), {places_sql('tp', 't', 's.game_id, s.row_idx', 'k', 8)}
 select game_id, row_idx, 'train' as part, place from tp union all select o_custkey, o_orderkey, part, null from orders join part on o_custkey = game_id where part = 'val'""")
def permuted_split(spark, sf_dir):
    """Groups dealt to train and val, and train rows shuffled, by seeded permutations."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game_id"), F.col("o_orderkey").alias("row_idx"))
    return permute.permuted_split(o, "game_id", "row_idx", fraction=0.025, seed=7).select("game_id", "row_idx", "part", "place")


@query("permuted_pool", f"""with recursive base as (select distinct l_partkey as k from lineitem where l_returnflag = 'R' and l_linenumber = 1), ext as (select distinct l_partkey as k from lineitem where l_returnflag = 'N' and l_partkey not in (select k from base)),
 b as (select k, row_number() over (order by k) - 1 as i, count(*) over () as n from base), e as (select k, row_number() over (order by k) - 1 as i, count(*) over () as n from ext), {places_sql('bp', 'b', 's.k', 'i', 9)}, {places_sql('ep', 'e', 's.k', 'i', 10)}
 select k, 0 as epoch, place from bp union all select k, 1, place + (select count(*) from base) from ep""")
def permuted_pool(spark, sf_dir):
    """A pool that is shuffled once, and an extension shuffled behind it."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_linenumber")
    return permute.shuffled_pool(li.where("l_returnflag = 'R' and l_linenumber = 1").select("k"), li.where("l_returnflag = 'N'").select("k"), "k", seed=9)
