"""Position rows made from lineitem by integer arithmetic, the same in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .core import run_sql

BLACK = ("rnbqkbnr", "r3k2r", "4k3", "2kr3r", "1n2k1n1", "6k1", "k7", "3qk2b")
MIDDLE = ("8", "pppppppp", "p3p3", "3P4", "PP2pp2", "2N2n2", "1B4b1", "q6Q", "R6r", "pP1pP1pP", "4p3", "P6p")
WHITE = ("RNBQKBNR", "R3K2R", "4K3", "2KR3R", "1N2K1N1", "6K1", "K7", "3QK2B")


def pick(index: str, options: tuple[str, ...]) -> str:
    return f"case ({index}) % {len(options)} " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end"


def key_part(seed: str) -> str:
    rows = [pick(seed, BLACK), *(pick(f"({seed}) * {m} + {a}", MIDDLE) for m, a in ((7, 1), (11, 2), (13, 3), (17, 4), (19, 5), (23, 6))), pick(f"({seed}) * 5 + 1", WHITE)]
    board = " || '/' || ".join(f"({r})" for r in rows)
    return f"{board} || (case when ({seed}) % 2 = 0 then ' w KQkq ' else ' b - ' end) || (case when ({seed}) % 9 = 0 then 'e6' else '-' end)"


POSITIONS = f"""
select l_orderkey as game_id, cast(l_linenumber as bigint) as row_idx,
       cast(year(l_shipdate) * 12 + month(l_shipdate) as bigint) as shard,
       ({key_part('l_orderkey % 997 + l_linenumber * 31')}) || ' 0 ' || cast(l_linenumber as varchar(4)) as fen,
       case l_orderkey % 4 when 0 then '1-0' when 1 then '0-1' when 2 then '1/2-1/2' else '*' end as result,
       l_orderkey % 5 = 0 as truncated,
       cast(l_partkey % 4001 as int) - 2000 as eval_cp,
       (l_orderkey + l_linenumber) % 13 <> 0 as ok,
       case (l_orderkey + l_linenumber) % 4 when 0 then 'e2e4' when 1 then 'd5e6' when 2 then 'a7a8q' else 'c3d5' end as move
from lineitem"""


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, POSITIONS)


def with_positions(sql: str) -> str:
    return f"with p as ({POSITIONS}) {sql}"


# a static evaluation, a search evaluation and a class for every line item
GAPS = """
select l_orderkey * 10 + l_linenumber as id, l_returnflag as class, l_linestatus as bucket,
       cast(l_quantity * 40 - 1000 as double) as static_cp, cast(l_extendedprice / 50 - 1000 as double) as search_cp,
       abs(1 / (1 + exp(-0.005756462732485115 * (l_extendedprice / 50 - 1000))) - 1 / (1 + exp(-0.005756462732485115 * (l_quantity * 40 - 1000)))) as gap
from lineitem"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, GAPS)
